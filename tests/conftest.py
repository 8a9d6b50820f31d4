import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from postpulse.session import prepare  # noqa: E402


_FOLDER = tempfile.mkdtemp(prefix="postpulse-tests-")
# Started while collecting, so that test modules can name columns at import.
_SESSION = (
    SparkSession.builder.master("local[4]").appName("tests")
    .config("spark.sql.shuffle.partitions", "4")
    .config("spark.sql.session.timeZone", "UTC")
    .config("spark.ui.enabled", "false")
    .config("spark.ui.showConsoleProgress", "false")
    .config("spark.checkpoint.dir", f"{_FOLDER}/shared")
    .config("spark.sql.warehouse.dir", f"{_FOLDER}/warehouse")
    .getOrCreate()
)
_SESSION.sparkContext.setLogLevel("OFF")


@pytest.fixture(scope="session")
def spark():
    return prepare(_SESSION)


@pytest.fixture
def texts(spark):
    """Evaluate a rule on hand-written texts."""

    def run(rule, *values):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "i int, t string")
        out = df.select("i", rule.alias("x")).orderBy("i").collect()
        return [r["x"] for r in out]

    return run
