import pytest

from hexgale.session import checkpoint_target, ensure_checkpoint_dir


def test_checkpoint_folder(spark):
    assert checkpoint_target("hdfs://x/shared", "yarn", "w") == "hdfs://x/shared"
    assert checkpoint_target(None, "local[8]", "w") == "w/_checkpoints"
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            checkpoint_target(None, master, "w")
    assert ensure_checkpoint_dir(spark)
