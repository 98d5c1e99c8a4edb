import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from assay.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        8,
        app="tests",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("scratch")),
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="2",
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Value of a column expression over one row of named inputs."""
    from pyspark.sql import functions as F

    def run(expression, **inputs):
        row = spark.range(1).select(*[F.lit(value).alias(name) for name, value in inputs.items()] or ["id"])
        return row.select(expression.alias("out")).first().out

    return run
