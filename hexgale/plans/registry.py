"""Named queries: a Spark callable, an output schema and (where SQL can express it) a DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexgale.session import configure

# Output type letter -> (Spark type, SQL type).
_TYPES = {
    "l": ("bigint", "BIGINT"),
    "d": ("double", "DOUBLE"),
    "s": ("string", "VARCHAR"),
    "t": ("date", "DATE"),
    "b": ("boolean", "BOOLEAN"),
}
DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        df = self.run(spark, sf_dir)
        out = []
        for name, kind in self.columns:
            c = F.col(name).cast(_TYPES[kind][0])
            # Rounded, and -0.0 turned into 0.0, so that summation order does not show.
            out.append(((F.round(c, DIGITS) + F.lit(0.0)) if kind == "d" else c).alias(name))
        return df.select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = []
        for name, kind in self.columns:
            c = f'CAST("{name}" AS {_TYPES[kind][1]})'
            cols.append(f'(round({c}, {DIGITS}) + 0.0) AS "{name}"' if kind == "d" else f'{c} AS "{name}"')
        text = self.sql.strip()
        if text[:4].upper() == "WITH":
            # The final SELECT follows the marker, so CTEs stay at the top level.
            head, tail = text.split("--final--")
            return f"{head}\nSELECT {', '.join(cols)} FROM ({tail}) AS q"
        return f"SELECT {', '.join(cols)} FROM ({text}) AS q"


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name. ``columns`` is 'name:type ...'."""

    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        cols = tuple(tuple(c.split(":")) for c in columns.split())
        REGISTRY[name] = Query(name, fn, cols, sql)
        return fn

    return wrap
