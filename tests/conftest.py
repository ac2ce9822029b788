import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quirework.session import local_session  # noqa: E402

SPARK = local_session(name="quirework-tests")  # column expressions at module level need a context


@pytest.fixture(scope="session")
def spark():
    return SPARK


@pytest.fixture(scope="session")
def evaluate(spark):
    """Values of an expression over the rows of one column ``x``."""

    def run(expression, values, ddl="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {ddl}")
        return [r["y"] for r in rows.select("i", expression.alias("y")).orderBy("i").collect()]

    return run
