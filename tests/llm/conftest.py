import pytest


@pytest.fixture(autouse=True)
def shared_folder(spark, tmp_path_factory):
    """The folder a cluster would name in spark.checkpoint.dir."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
