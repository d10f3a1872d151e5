import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marquee.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(8, "marquee-tests", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("ckpt"))})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Apply a Column -> Column function to texts, in order."""
    from pyspark.sql import functions as F

    def run(values, fn):
        df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
        return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]

    return run
