import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kestrelgraph.runtime import session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = session("4", 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def parquet(spark, tmp_path):
    """Write rows as Parquet files, a row group each, and read them back."""

    def write(rows, schema, files=1, name="t"):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, schema).repartition(files).write.mode("overwrite").parquet(path)
        return spark.read.schema(schema).parquet(path)

    return write


@pytest.fixture
def shuffled(spark):
    """Rows that the stages of a call wrote to shuffles."""

    def of(f):
        store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext

        def total():
            sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
            stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
            return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

        before = total()
        f()
        return sum(n for k, n in total().items() if k not in before)

    return of
