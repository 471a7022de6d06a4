import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from lotwise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=4, partitions=4)


@pytest.fixture
def values(spark):
    """Evaluates column expressions over text rows and returns the plain values."""
    from pyspark.sql import functions as F

    def run(build, rows, schema="x string"):
        frame = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
        frame = frame.coalesce(1).withColumn("_n", F.monotonically_increasing_id())
        return [r.y for r in frame.select("_n", build().alias("y")).orderBy("_n").collect()]

    return run
