import collections
import random

import numpy as np
import pytest

from tonelake.llm import neardup
from tonelake.llm.bagminhash import Bags, signatures
from tonelake.llm.neardup import near_duplicates, one_of_each_class


def bag(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_signatures_are_unbiased(prose):
    r = random.Random(3)
    est, true = [], []
    for i in range(150):
        a = prose(i, r.choice([6, 20, 100, 400])).split()
        b = list(a)
        for _ in range(r.randrange(0, 1 + len(a) // 12)):
            b[r.randrange(len(b))] = f"x{r.random()}"
        # a word of the pair's own, as pairs that share a shingle also share its points
        a, b = a + [f"rep{i}"] * r.randrange(0, 40), b + [f"rep{i}"] * r.randrange(0, 40)
        bags = Bags([" ".join(a).encode(), " ".join(b).encode()])
        sig = signatures(bags, 2)
        est.append((sig[0] == sig[1]).mean())
        true.append(similarity(bag(" ".join(a)), bag(" ".join(b))))
        assert abs(true[-1] - bags.similarity(0, 1)) < 1e-12
    assert abs(np.mean(est) - np.mean(true)) < 0.012
    assert np.sqrt(np.mean((np.array(est) - true) ** 2)) < 0.06


def classes(rows):
    bags = [bag(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or similarity(bags[i], bags[j]) >= 0.8 - 1e-12:
                up[find(i)] = find(j)
    out = collections.defaultdict(list)
    for i, (k, _) in enumerate(rows):
        out[find(i)].append(k)
    return collections.Counter((k, min((x for x in ks if x is not None), default=None), len(ks)) for ks in out.values() for k in ks)


def check(df, rows):
    assert collections.Counter((r.doc_id, r.class_id, r.class_size) for r in near_duplicates(df).collect()) == classes(rows)


def edited(text, n, seed):
    r = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"ed{r.random()}"
    return " ".join(w)


def test_against_brute_force(spark, clashing, prose):
    rows = [(i, prose(i, 5 + i % 120)) for i in range(80)]
    for k in range(12):
        base = prose(900 + k, 60 + 15 * k)
        rows += [(1000 + 50 * k + j, edited(base, j % 3, 100 * k + j)) for j in range(6)]
    rows += [(5000, "w x " * 300), (5001, "w x " * 310), (5002, "w x " * 100)]
    check(clashing(rows), rows)


def test_large_group_of_near_copies(spark, clashing, prose):
    base = prose(7, 150)
    rows = [(i, edited(base, i % 4, i)) for i in range(250)] + [(1000 + i, base) for i in range(100)]
    check(clashing(rows), rows)


def test_odd_rows(spark, clashing, prose):
    p = prose(1, 40)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE two"), (6, p), (6, p), (None, p), (None, "alone here"), (7, "x" * 50_000), (6, "another text of the same key entirely")]
    check(clashing(rows), rows)
    assert near_duplicates(clashing([])).count() == 0


def test_one_of_each_class(spark, clashing, prose):
    p, q = prose(1, 100), prose(2, 100)
    df = clashing([(3, p), (1, edited(p, 1, 5)), (2, p), (9, q), (9, q), (None, q), (None, "nobody"), (None, "nobody")])
    got = one_of_each_class(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 9]


def spaced(words, slots, tag):
    """The words with others at every seventh place that ``slots`` names: each edit takes five shingles."""
    w = list(words)
    for s in slots:
        w[7 * s] = f"{tag}x{s}"
    return w


def test_buckets_beyond_a_block(spark, clashing, prose, monkeypatch):
    # versions are links of their base only, and share its buckets
    monkeypatch.setattr(neardup, "BUCKET", 32)
    base = prose(11, 404).split()
    r = random.Random(5)
    rows = [(0, " ".join(base))] + [(i, " ".join(spaced(base, r.sample(range(57), 8), f"v{i}"))) for i in range(1, 300)]
    check(clashing(rows), rows)


def test_links_among_many_near_misses(spark, clashing, prose):
    # texts are linked by twos; all others of the template are near in signature, but below 0.8
    base = prose(12, 404).split()
    r = random.Random(6)
    rows = []
    for i in range(150):
        s = r.sample(range(57), 10)
        both = spaced(base, s[:2], f"p{i}")
        rows += [(2 * i, " ".join(spaced(both, s[2:6], f"q{i}"))), (2 * i + 1, " ".join(spaced(both, s[6:], f"r{i}")))]
    check(clashing(rows), rows)


@pytest.mark.parametrize("block", [1024, 40])
def test_classes_over_blocks(spark, clashing, prose, monkeypatch, block):
    # versions of one base that are mostly no links of each other, and pairs that are links of nothing else
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BUCKET", block)
    base = prose(13, 404).split()
    r = random.Random(7)
    rows = [(i, " ".join(spaced(base, r.sample(range(57), 4 + i % 5), f"n{i}"))) for i in range(200)] + [(1000, " ".join(base))] * 2
    for i in range(30):
        far = spaced(base, r.sample(range(57), 12), f"far{i}")
        rows += [(2000 + 2 * i, " ".join(far)), (2001 + 2 * i, " ".join(spaced(far, [i % 57], f"twin{i}")))]
    check(clashing(rows), rows)


def test_overlap_is_of_words(prose):
    # regular texts that polynomial hashes modulo 2**64 cannot tell apart
    x = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    y = x.translate(str.maketrans("ab", "ba"))
    for lists in ([x, y], [" ".join(x), " ".join(y)]):
        exact, hashed = (Bags([t.encode() for t in lists], exact=e) for e in (True, False))
        true = similarity(bag(lists[0]), bag(lists[1]))
        assert abs(exact.similarity(0, 1) - true) < 1e-12 and abs(hashed.similarity(0, 1) - true) < 1e-12
    short = Bags([b"A b c", b"a B C", b"a b", b"a b c d e"], exact=True)
    assert len(set(short.shingle.tolist())) == 3 and short.similarity(0, 1) == 1 and short.similarity(0, 3) == 0


def test_rows_that_repeat_key_and_text(spark, clashing, prose):
    p = prose(3, 80)
    rows = [(None, p)] * 40 + [(5, edited(p, 1, 1))] * 30 + [(None, None)] * 20
    check(clashing(rows), rows)
