import collections
import random
import re

import numpy as np
import pytest

from tonelake.llm import substrings
from tonelake.llm.substrings import longest_repeats, suffix_dedup


def brute(rows, length):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = collections.Counter(tuple(w[i : i + length]) for w in docs for i in range(len(w) - length + 1))
    out = []
    for (k, _), w in zip(rows, docs):
        gone = {i + j for i in range(len(w) - length + 1) if count[tuple(w[i : i + length])] > 1 for j in range(length)}
        out.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return collections.Counter(out)


def check(df, rows, length):
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in suffix_dedup(df, length).collect()) == brute(rows, length)


@pytest.mark.parametrize("length", [35, 12, 4])
def test_random_passages(spark, clashing, prose, length):
    r = random.Random(length)
    shared = [prose(i, r.randrange(length - 2, 3 * length)) for i in range(6)]
    rows = []
    for i in range(120):
        parts = [prose(1000 + i * 7 + j, r.randrange(0, 60)) for j in range(r.randrange(1, 4))]
        for s in r.sample(shared, r.randrange(0, 3)):
            w = s.split()
            cut = r.randrange(0, 4)
            parts.insert(r.randrange(len(parts) + 1), " ".join(w[cut : len(w) - r.randrange(0, 4)]))
        rows.append((i, " \n".join(parts)))
    check(clashing(rows), rows, length)


def test_periodic_and_repeated_within_one_text(spark, clashing, prose):
    rows = [(0, "be " * 34), (1, "be " * 35), (2, "to " * 36), (3, "a b c " * 40), (4, prose(1, 50) + " x " + prose(1, 50)), (5, "a b " * 18 + "c"), (6, "q " * 500 + "r " * 500)]
    check(clashing(rows), rows, 35)


def test_odd_rows(spark, clashing, prose):
    p = prose(5, 80)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, p), (4, p), (None, p + " tail"), (None, "x y \x1c z"), (5, p.upper()), (6, "é" * 3000 + " " + p), (7, prose(9, 30_000))]
    check(clashing(rows), rows, 35)
    assert suffix_dedup(clashing([]), 35).count() == 0


def test_common_passage(spark, clashing, prose):
    p = prose(77, 60)
    rows = [(i, f"{prose(i, 20)} {p} {prose(5000 + i, 20)}" if i % 3 else prose(i, 90)) for i in range(300)]
    check(clashing(rows), rows, 35)


def test_carry_and_whole(spark, prose):
    p = prose(5, 80)
    df = spark.createDataFrame([(1, f"{p}\nmore", "x"), (2, f"{p} end", None), (3, "some\n text ", "y"), (4, None, "z")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.kept, r.lang) for r in suffix_dedup(df, 35, carry=("lang",), whole=True).collect()}
    assert got == {1: ("more", "x"), 2: ("end", None), 3: ("some\n text ", "y"), 4: (None, "z")}


def regular(letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(1024))


def test_words_that_polynomial_hashes_confuse(spark, clashing, prose):
    p = prose(3, 34)
    rows = [(1, f"{p} {regular('ab')}"), (2, f"{p} {regular('ba')}"), (3, " ".join(regular("xy"))), (4, " ".join(regular("yx")))]
    check(clashing(rows), rows, 35)


def test_many_rows_without_a_key(spark, clashing, prose):
    p = prose(4, 60)
    rows = [(None, f"{p} {i} {prose(i, 40)}" if i % 2 else prose(i, 50)) for i in range(200)] + [(None, p)] * 50
    check(clashing(rows), rows, 35)


@pytest.mark.parametrize("most", [4000, 150])
def test_groups_beyond_memory(spark, clashing, prose, monkeypatch, most):
    # the passage stands between words of its text's own, so its prefix has many paths
    monkeypatch.setattr(substrings, "GROUP_WORDS", most)
    p = prose(77, 60).split()
    r = random.Random(1)
    rows = []
    for i in range(90):
        a, b = sorted(r.sample(range(61), 2))
        rows.append((i, f"{prose(i, r.randrange(30))} {' '.join(p[a:b] if i % 3 else p)} {prose(5000 + i, r.randrange(30))}"))
    rows += [(900 + i, f"{prose(i, 20)} {'z ' * 90}") for i in range(3)] + [(1000, "a b c " * 60), (1001, "b c a " * 20)] + [(1002, " ".join(p))] * 3
    check(clashing(rows), rows, 35)


def test_longest_repeats():
    r = np.random.default_rng(2)
    for n, kinds, length in ((60, 2, 3), (90, 2, 8), (90, 3, 5), (20, 1, 7), (3, 5, 1), (0, 1, 3)):
        w = r.integers(0, kinds, n)
        got = longest_repeats(w, length)
        at = lambda i, k: tuple(w[i : i + k])  # noqa: B023, E731
        for i in range(n):
            best = max([k for k in range(1, n - i + 1) if any(j != i and at(j, k) == at(i, k) for j in range(n - k + 1))], default=0)
            if best < length:
                assert got[i] == 0
            else:
                assert length <= got[i] <= best
