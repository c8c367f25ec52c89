import random

import pytest

#: Names that operators use inside; as extra columns they must not matter.
CLASHING = ["h", "s", "k", "k1", "n", "node", "text_crc32", "shard", "item", "size", "row", "bucket", "score", "ids", "words"]


@pytest.fixture
def clashing(spark):
    """A frame of (doc_id, text) rows with extra columns of clashing names."""

    def make(rows):
        schema = "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in CLASHING)
        return spark.createDataFrame([(*r, *range(len(CLASHING))) for r in rows], schema)

    return make


@pytest.fixture
def prose():
    """Invented prose: ``prose(seed, n)`` gives ``n`` words."""

    def make(seed, n):
        r = random.Random(seed)
        return " ".join("".join(r.choice(["ka", "lo", "mi", "ten", "ru", "se"]) for _ in range(r.randrange(1, 5))) for _ in range(n))

    return make
