import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    import __spark_entry__  # noqa: F401  (ships functions to Python workers by value)
    from bench import session

    spark = session("4")
    yield spark
    spark.stop()
