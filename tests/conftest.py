import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lakesmith.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "2", "spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")), "spark.driver.memory": "4g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """table(ddl, rows): a DataFrame; times may be given as texts in UTC."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    def make(ddl, rows):
        schema = StructType.fromDDL(ddl)
        texts = StructType.fromDDL(ddl)
        timed = []
        for f in texts.fields:
            if f.dataType.typeName() in ("timestamp", "date"):
                timed.append((f.name, f.dataType))
                f.dataType = StructType.fromDDL("x string")["x"].dataType
        df = spark.createDataFrame(rows, texts)
        return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))

    return make


def rows_of(df, *columns):
    """The rows of some columns as sorted tuples."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)
