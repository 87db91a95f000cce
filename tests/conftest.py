import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pitpanel.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", cores=4, memory="4g")


@pytest.fixture
def day():
    return lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
