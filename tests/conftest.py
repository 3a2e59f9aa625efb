import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pkgloom.engine import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session(4, **{"spark.sql.shuffle.partitions": "4"})


DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def folder():
    if not DATA.exists():
        pytest.skip("the driver's tables are not here")
    return str(DATA)
