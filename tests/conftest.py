import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from rowlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "rowlens-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def rows(frame, *names):
    """Rows as tuples of the named columns (all by default), in a stable order."""
    found = [tuple(r[n] for n in (names or frame.columns)) for r in frame.collect()]
    return sorted(found, key=lambda r: [(v is None, str(v)) for v in r])
