import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from mediacat.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column_of(spark):
    """Values of a column expression over a list of texts."""
    from pyspark.sql import functions as F

    def run(values, make, schema="v string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
        rows = df.select("i", make(F.col("v")).alias("out")).collect()
        return [r.out for r in sorted(rows, key=lambda r: r.i)]

    return run
