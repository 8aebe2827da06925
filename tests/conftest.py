import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from spanloom.session import get_spark

    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    os.environ["SPANLOOM_API_KEY"] = "k"  # the workers of the session inherit it
    s = get_spark("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('checkpoints')}"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
