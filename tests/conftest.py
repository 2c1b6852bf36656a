import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sceneloom.session import ensure_checkpoint_dir, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, memory="12g", shuffle_partitions=8)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    ensure_checkpoint_dir(s)
    yield s


def rows(df, *cols):
    """Sorted tuples of the given columns."""
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=lambda r: [(x is None, 0 if x is None else x) for x in r])
