import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from checks.local import session

    s = session(cpus=4, partitions=4)
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield s
    s.stop()


@pytest.fixture
def rows():
    """Rows of a small result as sorted tuples, doubles rounded."""

    def collect(df, *columns, digits=9):
        picked = df.select(*columns) if columns else df
        out = [
            tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in picked.collect()
        ]
        return sorted(out, key=lambda r: [(v is not None, str(type(v)), v if v is not None else 0) for v in r])

    return collect
