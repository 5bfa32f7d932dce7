import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from check import session
    from tabloom.functions.lineage import release

    spark = session()
    yield spark
    release(spark)


@pytest.fixture(scope="session")
def sf():
    return SF
