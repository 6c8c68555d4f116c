import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import functions as F  # noqa: E402

from tidemark.session import create_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = create_session("tests", **{
        "spark.master": "local[4]",
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "4g",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("catalog")),
    })
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Rows given as tuples, timestamps as text, under a DDL schema."""

    def build(schema: str, *rows):
        fields = [part.strip().rsplit(" ", 1) for part in schema.split(";")]
        text = ", ".join(f"{n} {'string' if t == 'timestamp_ntz' else t}" for n, t in fields)
        df = spark.createDataFrame(list(rows), text)
        return df.select(*[
            F.col(n).cast(t).alias(n) if t == "timestamp_ntz" else F.col(n) for n, t in fields
        ])

    return build


@pytest.fixture(scope="session")
def at():
    return lambda text: datetime.fromisoformat(text)
