import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from keelmark.session import build_session  # noqa: E402

SF_DIR = os.environ.get("KEELMARK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": 4, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def scored(spark, sf_dir):
    """The scored test incidents, read from Parquet as a user of the library would."""
    from keelmark.session import new_folder
    from keelmark.sources.derived import scored_incidents

    path = new_folder(spark, "test-scored")
    scored_incidents(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)
