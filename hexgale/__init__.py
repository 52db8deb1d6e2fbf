"""hexgale: gridded space-time disturbance analytics as plain PySpark DataFrame operators."""

__version__ = "0.1.0"
