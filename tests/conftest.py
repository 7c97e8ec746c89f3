import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from mopup.session import get_spark
    s = get_spark("local[4]", 8)
    yield s


@pytest.fixture
def tmpdir_path():
    import tempfile
    return tempfile.mkdtemp(prefix="mopup-test-", dir="/tmp")


def rows(df, order="row_id"):
    if order and order in df.columns:
        df = df.orderBy(order)
    return [r.asDict() for r in df.collect()]
