import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from haulmark.session import local_session  # noqa: E402

TESTDATA = os.environ.get("HAULMARK_TESTDATA", "/root/testdata")
SMALL = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 4, app="haulmark-tests")


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def moves_fixture(spark):
    """Cells and candidates of the smallest tables, staged once."""
    from haulmark.plans import queries as Q
    from haulmark.session import staged
    cells = Q.cells(spark, SMALL)
    return cells, staged(Q.candidates_of(cells), "candidates")
