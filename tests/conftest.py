import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from strata.session import build_session
    s = build_session("local[4]", app_name="strata-tests", shuffle_partitions=8)
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as tuples (ordered by all columns for determinism)."""
    cols = cols or tuple(df.columns)
    return [tuple(r) for r in df.select(*cols).orderBy(*cols).collect()]
