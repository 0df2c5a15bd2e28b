import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from tests.oracle import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session(4)
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
