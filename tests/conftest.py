import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

DATA = Path(os.environ.get("LEDGERLOOM_TESTDATA", "/root/testdata")) / "sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import get_session

    s = get_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip("no test tables here")
    return str(DATA)


def rows(df, *columns):
    """The rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)
