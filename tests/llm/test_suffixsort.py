import collections
import random

import numpy as np
import pytest

from tonelake.llm.suffixsort import deep_shallow, repeated_bytes


def brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    count = collections.Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for (k, _), r in zip(rows, raw):
        gone = {i + j for i in range(len(r) - length + 1) if count[r[i : i + length]] > 1 for j in range(length)}
        spans = sum(i - 1 not in gone for i in gone)
        out.append((k, len(r), len(gone), spans, bytes(x for i, x in enumerate(r) if i not in gone)))
    return collections.Counter(out)


def check(df, rows, length, **options):
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeated_bytes(df, length, **options).collect())
    assert got == brute(rows, length)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
@pytest.mark.parametrize(("length", "shallow"), [(40, 8), (40, 16), (100, 64), (11, 64), (1, 0)])
def test_order_and_twins(letters, length, shallow):
    r = random.Random(length + shallow)
    parts = ["".join(r.choice(letters) for _ in range(r.randrange(5, 150))) for _ in range(8)]
    text = "".join(r.choice(parts) for _ in range(60)).encode()
    at = np.arange(len(text) - length + 1)
    order, twin = deep_shallow(np.frombuffer(text, np.uint8), at, length, shallow)
    strings = [text[i : i + length] for i in at]
    assert sorted(order) == list(at)
    assert [strings[i] for i in order] == sorted(strings)
    count = collections.Counter(strings)
    assert twin.tolist() == [count[x] > 1 for x in strings]
    cuts = [0, 1, 1, len(at) // 3, len(at)]  # groups apart, one of them empty
    order, twin = deep_shallow(np.frombuffer(text, np.uint8), at, length, shallow, np.diff(cuts))
    for i, j in zip(cuts, cuts[1:]):
        assert [strings[k] for k in order[i:j]] == sorted(strings[i:j])
        count = collections.Counter(strings[i:j])
        assert twin[i:j].tolist() == [count[x] > 1 for x in strings[i:j]]


def test_nothing_to_sort():
    order, twin = deep_shallow(np.zeros(0, np.uint8), np.zeros(0, np.int64), 40)
    assert len(order) == len(twin) == 0


@pytest.mark.parametrize(("length", "options"), [(100, {}), (37, {"gram": 16, "group_bytes": 300})])
def test_random_passages(spark, clashing, prose, length, options):
    r = random.Random(length)
    shared = [prose(i, 60) for i in range(6)]
    rows = []
    for i in range(100):
        parts = [prose(1000 + i * 7 + j, r.randrange(0, 40)) for j in range(r.randrange(1, 4))]
        for s in r.sample(shared, r.randrange(0, 3)):
            cut = r.randrange(0, 30)
            parts.insert(r.randrange(len(parts) + 1), s[cut : len(s) - r.randrange(0, 30)])
        rows.append((i, " é\n".join(parts)))
    check(clashing(rows), rows, length, **options)


@pytest.mark.parametrize("options", [{"group_bytes": 500}])
def test_common_passages_at_every_depth(spark, clashing, prose, options):
    """Passages that nearly all rows share, just under, at and over the length, so that groups crowd at every substring."""
    rows = []
    for n in (70, 90, 99, 100, 101, 130):
        p = prose(n, 60)[:n]
        rows += [(1000 * n + i, f"{prose(1000 * n + i, 12)}|{p}|{prose(7 + 1000 * n + i, 12)}") for i in range(40)]
    check(clashing(rows), rows, 100, gram=16, **options)


def test_periodic_and_repeated_within_one_text(spark, clashing, prose):
    rows = [(0, "a" * 399), (1, "b" * 400), (2, "c" * 401), (3, "ab" * 300), (4, prose(1, 150) + "x" + prose(1, 150)), (5, "abc" * 133 + "d"), (6, "q" * 5000 + "r" * 5000)]
    check(clashing(rows), rows, 400)
    check(clashing(rows), rows, 400, group_bytes=1000)


def test_odd_rows(spark, clashing, prose):
    p = prose(5, 200)
    rows = [(1, None), (2, ""), (3, "x" * 399), (4, p), (4, p), (None, p + " tail"), (None, "é" * 250), (7, "zé" + "é" * 250), (5, p.upper()), (6, "ü" * 30_000 + p), (8, prose(9, 20_000))]
    check(clashing(rows), rows, 400)
    assert repeated_bytes(clashing([]), 400).count() == 0


def test_spans_may_split_characters(spark, clashing):
    same = "é" * 100
    rows = [(1, "ü" + same), (2, "ã" + same + "x")]  # all three letters begin with the same byte
    check(clashing(rows), rows, 50)
