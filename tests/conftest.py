from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shiftgrid.session import ROWS_KEY, SLICES_KEY, get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session(
        "tests", spark__master="local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="4g", spark__ui__showConsoleProgress="false",
    )
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture(params=[1_000_000, 2])
def mode(request, spark):
    """Ordered operators with one slice and with several; both must agree."""
    spark.conf.set(ROWS_KEY, str(request.param))
    spark.conf.set(SLICES_KEY, "5")
    yield request.param
    spark.conf.unset(ROWS_KEY)
    spark.conf.set(SLICES_KEY, "0")
