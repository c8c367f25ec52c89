import math
import random

import numpy as np
from pyspark.sql import functions as F

from tonelake.llm import topk
from tonelake.llm.topk import essential_from, maxscore, top_k


def brute(rows, k):
    held = lambda x: max(-(2**63), min(2**63 - 1, math.floor(x)))
    q = [(i, [held(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    q = [(i, v) for i, v in {(i, tuple(v)) for i, v in q}]
    out = set()
    for i, v in q:
        if i % 5 == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j) for j, w in q if j != i)
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


def run(spark, rows, k):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, score int, id int")
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, F.pmod("vec_id", F.lit(5)) == 0, k).collect()}


def test_against_brute_force(spark):
    r = random.Random(1)
    f = lambda x: float(__import__("numpy").float32(x))
    rows = [(i, [f(r.gauss(0, 1)) for _ in range(16)]) for i in range(300)]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_ties_copies_and_bad_vectors(spark):
    same = [0.5, -0.25]
    rows = [(0, same), (1, same), (2, same), (3, same), (3, same), (5, [1.0, None]), (6, None), (10, [float("nan"), 1.0]), (15, [float("inf"), 0.0]), (20, []), (None, same), (25, [1.0, 0.0, 0.0])]
    assert run(spark, rows, 3) == brute(rows, 3)


def test_huge_components(spark):
    rows = [(0, [1e20, -1e20]), (1, [2e20, 3e19]), (2, [-1e20, 1.0]), (5, [0.0, 0.0])]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_fewer_than_k_and_none(spark):
    assert run(spark, [(0, [1.0])], 5) == set()
    assert run(spark, [], 5) == set()
    assert run(spark, [(1, [1.0]), (2, [1.0])], 5) == set()


def test_fewer_terms_are_essential_as_results_come_in(monkeypatch):
    # one query against vectors in two steps: what is traversed at the second is a part of the terms
    assert [essential_from(np.array([1.0, 3.0, 6.0, 10.0]), room) for room in (0.5, 1.0, 5.9, 6.0, 99.0)] == [0, 1, 2, 3, 4]
    seen = []
    monkeypatch.setattr(topk, "essential_from", lambda sums, room: seen.append(essential_from(sums, room)) or seen[-1])
    r = np.random.default_rng(3)
    block = np.floor(r.normal(size=(6 * topk.STEP, 32)) * (256 * 0.7 ** np.arange(32))).astype(np.int64)
    q = block[:3]
    for own, ids, scores in maxscore(q, np.arange(3), block, np.arange(len(block)), 5):
        full = block @ q[own]
        want = sorted((-int(s), i) for i, s in enumerate(full) if i != own)[:5]
        assert [(-int(s), int(i)) for s, i in zip(scores, ids)] == want
    assert len(seen) == 15 and min(seen) > 8


def test_many_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "STEP", 16)
    monkeypatch.setattr(topk, "BLOCK", 100)
    r = random.Random(2)
    f = lambda x: float(np.float32(x))
    rows = [(i, [f(r.gauss(0, 1) * (1 if j < 4 else 0.02)) for j in range(24)]) for i in range(400)] + [(400 + i, [0.0] * 24) for i in range(4)]
    assert run(spark, rows, 5) == brute(rows, 5)
