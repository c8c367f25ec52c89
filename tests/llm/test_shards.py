import zlib

import numpy as np
import pytest

from tonelake.llm import shards
from tonelake.llm.shards import pack, shard_documents


def test_pack_balances_three_measures():
    r = np.random.default_rng(1)
    items = np.stack([r.integers(1, 1000, 4000), r.integers(1, 200, 4000), np.ones(4000, int)], axis=1)
    bins = pack(items, 24)
    for j in range(3):
        sums = np.bincount(bins, weights=items[:, j], minlength=24)
        assert sums.max() / sums.mean() < 1.02


def check(rows, n):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for s, members in by.items():
        assert 0 <= s < n
        assert sorted(m.slot for m in members) == list(range(len(members)))
    return by


def test_sizes_groups_and_slots(spark, clashing, prose):
    rows = [(i, prose(i % 700, 5 + i % 90)) for i in range(1400)]
    got = shard_documents(clashing(rows), 8).collect()
    by = check(got, 8)
    sizes = [sum(m["size"] for m in v) for v in by.values()]
    assert len(by) == 8 and max(sizes) / min(sizes) < 1.03
    texts = dict(rows)
    home = {}
    for r in got:
        raw = texts[r.doc_id].encode()
        assert r["size"] == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
        assert home.setdefault(raw, r.shard) == r.shard


def test_hot_group_is_split(spark, clashing, prose):
    rows = [(i, "one text that a third of all rows share") for i in range(600)] + [(1000 + i, prose(i, 30)) for i in range(1200)]
    by = check(shard_documents(clashing(rows), 6).collect(), 6)
    sizes = [sum(m["size"] for m in v) for v in by.values()]
    assert max(sizes) / min(sizes) < 1.1


@pytest.mark.parametrize("key", [None, 7])
def test_hot_group_of_repeated_keys_is_split(spark, prose, key):
    rows = [(key, "one text that a third of all rows share " * 5) for _ in range(1500)] + [(i, prose(i, 30)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    by = check(shard_documents(df, 12).collect(), 12)
    sizes = [sum(m["size"] for m in v) for v in by.values()]
    assert len(by) == 12 and max(sizes) - min(sizes) < 1000


def plain_pack(items, bins):
    """The rule of ``pack`` item by item: falling size, each where its product with the room left is highest."""
    share = [max(sum(x[j] for x in items), 1) / bins for j in range(3)]
    room, out = [[1.0] * 3 for _ in range(bins)], [None] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-sum(x / s for x, s in zip(items[i], share)), i)):
        v = [x / s for x, s in zip(items[i], share)]
        b = max(range(bins), key=lambda b: (round(sum(x * y for x, y in zip(v, room[b])), 9), -b))
        out[i] = b
        room[b] = [y - x for x, y in zip(v, room[b])]
    return out


def test_pack_follows_the_plain_rule():
    r = np.random.default_rng(5)
    for bins in (1, 3, 7):
        items = [[int(r.integers(1, 10**6)), int(r.integers(1, 10**4)), 1] for _ in range(150)]
        assert pack(np.array(items), bins).tolist() == plain_pack(items, bins)


def test_odd_rows(spark, clashing):
    rows = [(1, None), (2, ""), (None, "é"), (None, "é"), (1, None), (3, "long " * 30_000)]
    got = shard_documents(clashing(rows), 4).collect()
    check(got, 4)
    assert sorted((r.doc_id or 0, r["size"], r.text_crc32) for r in got)[0] == (0, 10, zlib.crc32("é".encode()))
    assert {(r["size"], r.text_crc32) for r in got if r.doc_id in (1, 2)} == {(8, 0)}
    assert shard_documents(clashing([]), 4).count() == 0


def test_cells_of_cells(spark, clashing, prose, monkeypatch):
    # 1400 groups in cells of 16, whose bins go through further levels before the driver sees them
    monkeypatch.setattr(shards, "CELL_GROUPS", 16)
    monkeypatch.setattr(shards, "TOP_CELLS", 4)
    monkeypatch.setattr(shards, "LANE_ROWS", 50)
    rows = [(i, prose(i, 5 + i % 90)) for i in range(1400)]
    got = shard_documents(clashing(rows), 8).collect()
    assert sorted(r.doc_id for r in got) == list(range(1400))
    sizes = [sum(m["size"] for m in v) for v in check(got, 8).values()]
    assert len(sizes) == 8 and max(sizes) / min(sizes) < 1.06
