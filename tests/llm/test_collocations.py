import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tonelake.llm import collocations as module
from tonelake.llm.collocations import DoubleArray, collocations


def brute(rows, least, keep):
    f = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = set()
    for lang, count in f.items():
        n = sum(c for p, c in count.items() if len(p) == 1)
        some = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        longer = collections.Counter()
        for p, a in some.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        left = []
        for p, a in some.items():
            if 100 * longer[p] >= 80 * a:
                continue
            score, _, l, r = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            left.append((-score, -a, " ".join(p).encode(), l, r))
        out |= {(lang, i + 1, p.decode(), -a, l, r, n, -score) for i, (score, a, p, l, r) in enumerate(sorted(left)[:keep])}
    return out


def made(seed, n):
    r = random.Random(seed)
    words = ["the", "of", "A", "b", "É", "ort", "x1", "Zü", "na", "rare%d"]
    rows = []
    for i in range(n):
        w = [r.choice(words[:9]) if r.random() < 0.9 else f"rare{r.randrange(200)}" for _ in range(r.randrange(0, 60))]
        for j in range(3, len(w), 9):
            w[j - 3 : j] = ["New", "York", "City"]
        rows.append((r.choice(["en", "de", None, "und"]), "".join(x + r.choice([" ", "\t ", ", ", ".", "\n", " \x0b", "-"] + [" "] * 9) for x in w)))
    return rows


def check(spark, rows, least=5, keep=2000, **options):
    df = spark.createDataFrame([(*r, i, "x", 0) for i, r in enumerate(rows)], "lang string, text string, f int, codes string, n int")
    got = [tuple(r) for r in collocations(df, least=least, keep=keep, **options).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, least, keep)


@pytest.mark.parametrize("options", [{}, {"words_at_once": 5, "trie_phrases": 40}])
def test_random_texts(spark, options):
    check(spark, made(3, 250), **options)


def test_ranks_end_and_ties(spark):
    check(spark, made(5, 60) + [("en", "a b. c d. e f. g h.")] * 5, keep=3)


def test_odd_rows(spark):
    check(spark, [("en", None), (None, ""), ("en", " \t ,,. \n"), ("en", "one"), ("de", "q " * 20_000), ("en", "x y x y x y x y x y x y")])
    check(spark, [("en", None)])
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations(empty).collect() == [] and collocations(empty).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_large_counts_are_exact(spark):
    from tonelake.llm.collocations import ranked

    big = 3 * 10**18
    phrases = spark.createDataFrame([([0], 2 * big), ([1], big + 1), ([0, 1], big)], "p array<int>, f long")
    words = spark.createDataFrame([(0, "en", "a"), (1, "en", "b")], "id int, lang string, word string")
    totals = spark.createDataFrame([("en", 3 * big + 1)], "lang string, n long")
    assert [tuple(r) for r in ranked(phrases, words, totals, 5).collect()] == [("en", 1, "a b", big, 2 * big, big + 1, 3 * big + 1, 2000000 * big // (3 * big + 1))]


@pytest.mark.parametrize("seed", range(4))
def test_double_array(seed):
    r = random.Random(seed)
    paths = {tuple(r.randrange(300) if r.random() < 0.5 else r.randrange(6) for _ in range(4)) for _ in range(3000)}
    levels = [sorted({p[:d] for p in paths}) for d in range(1, 5)]
    trie = DoubleArray([np.array(x, np.int32) for x in levels])
    states = np.concatenate(trie.states)
    assert len(set(states.tolist())) == len(states) == sum(map(len, levels))
    for d, rows in enumerate(levels):
        state = np.zeros(len(rows), np.int64)
        for c in np.array(rows).T:
            state = trie.step(state, c)
        assert (state == trie.states[d]).all()
    # every other step leads nowhere
    known = {p for x in levels for p in x}
    for d, rows in enumerate(levels[:3]):
        for w in range(0, 300, 7):
            found = trie.step(trie.states[d].copy(), np.full(len(rows), w))
            assert [x >= 0 for x in found] == [(*p, w) in known for p in rows]


def test_passes_over_texts_do_not_grow_with_candidates(spark, monkeypatch):
    df = spark.createDataFrame(made(7, 120), "lang string, text string")
    calls, plain = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda *a, **k: calls.append(1) or plain(*a, **k))
    passes = []
    for trie_phrases in (1 << 20, 40, 5):
        calls.clear()
        collocations(df, least=5, trie_phrases=trie_phrases)
        passes.append(len(calls))
    assert passes[0] == passes[1] == passes[2]


@pytest.mark.parametrize("hot", [0, 2, 9])
def test_tries_of_slices(monkeypatch, hot):
    """Windows of many slices, packed and dealt to tries, count each phrase once, whatever words are hot."""
    monkeypatch.setattr(module, "SLICE", 2000)
    rows = made(11, 120) + [("en", "a b " * 3000)]
    pieces = [[x for x in re.split(r"[ \t]+", p) if x] for _, t in rows for p in re.split(r"[.,;:!?\n\x0b]", re.sub("[A-Z]", lambda m: m[0].lower(), t))]
    words = [x for x, _ in collections.Counter(x for w in pieces for x in w).most_common()]
    known = {x: (pa.array([w.encode() for w in words]), np.arange(len(words), dtype=np.int32)) for x in ("en", "de", "und")}
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] or "und" for r in rows[i : i + 50]]), pa.array([r[1] for r in rows[i : i + 50]])], names=["lang", "text"]) for i in range(0, len(rows), 50)]
    held = collections.defaultdict(list)
    for mine, lang, raw in module.by_lang(iter(batches)):
        codes, piece, _ = module.codes_of(mine, lang, raw, known)
        for trie, depth, size, data in zip(*(c.to_pylist() for c in module.packed(*module.dealt(*module.windows(codes, piece), hot, 7)).columns), strict=True):
            held[trie, depth].append(module.unpacked(size, data))
    assert {d for _, d in held} == ({2, 3, 4} if hot else {2})
    got = {}
    for (_, depth), x in held.items():
        for d, first, last, n in module.nodes(depth, *np.concatenate(x, axis=1), 4):
            for f, z, m in zip(first.tolist(), last.tolist(), n.tolist(), strict=True):
                p = tuple(words[i - 1] for i in (f >> 32, f & module.LOW, z >> 32, z & module.LOW) if i)
                assert len(p) == d and p not in got
                got[p] = m
    want = collections.Counter(tuple(w[i : i + k]) for w in pieces for k in (2, 3, 4) for i in range(len(w) - k + 1))
    assert got == {p: n for p, n in want.items() if n >= 4}
