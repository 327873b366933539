import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from corpusloom.session import build_session

    s = build_session("tests", cores=4, spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    yield s
    from corpusloom.session import clean

    clean(s)
    s.stop()


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=repr)
