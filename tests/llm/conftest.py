import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=3000):
    return " ".join(f"v{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def hard_rows():
    """(doc_id, text): nulls, blanks, repeated rows, copies, near copies, a shared passage and a long text."""
    rng = random.Random(4)
    base = prose(rng, 130).split()
    rows = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one"), (None, " ".join(base))]
    for k in range(10, 40):
        changed = list(base)
        for _ in range(rng.randrange(5)):
            changed[rng.randrange(len(base))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(changed)))
    passage = prose(rng, 60)
    rows += [(k, prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30 * (k % 3))) for k in range(50, 62)]
    rows += [(70, prose(rng, 30_000)), (71, "a " * 300), (72, "été " * 3 + "ÉTÉ"), (73, passage), (73, passage)]
    return rows


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table of (doc_id, text) rows; ``extra`` adds columns whose names operators use inside."""

    def make(rows, extra=False):
        full = [(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            for name in ("block", "bucket", "size", "part", "n", "score", "row", "rep", "key", "copies", "shard", "quality", "_lead"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make
