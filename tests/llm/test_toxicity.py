import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from tonelake.llm.toxicity import drop_toxic, fit_characters, fit_toxicity, score_toxicity

BAD = ["rotter", "scoundrel", "vermin", "wretch"]


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "ten", "ru", "se"]) for _ in range(r.randrange(1, 4)))
    rows = []
    for i in range(800):
        words = [r.choice("ai") if r.random() < 0.06 else word() for _ in range(40)]
        if i % 5 == 0:
            for _ in range(2):
                words[r.randrange(40)] = r.choice(BAD)
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def fitted(tables):
    return fit_toxicity(*tables, held_out())


def test_held_out_accuracy(tables, fitted):
    docs, labels = tables
    got = score_toxicity(docs, fitted).join(labels, "doc_id").filter(held_out())
    assert got.count() > 100
    assert got.filter((F.col("score") >= 0.3).cast("int") != F.col("toxic")).count() <= 1


@pytest.mark.parametrize("text", ["sc0undrel", "r0tt3r", "v e r m i n", "w.r.e.t.c.h", "verrrrrmin", "$coundrel", "ROTTER!", "w-r-3-t-c-h", "scooundrel", "vveermiin", "a v e r m i n", "I r o t t e r", "sc ou nd re l", "ve rm in", "v 3 r m 1 n"])
def test_disguises(fitted, text):
    x, words = fitted.text(f"kalo mi ten {text} rute semi")
    assert fitted.score(x) >= 0.3 and len(words) == 1


def test_clean_texts_stay_clean(fitted):
    for text in ("kalo mi ten", "", None, "a b c d", "12345 6789 $$$ ###", "x@y.example 10.0.0.1 +1 (456) 555", "k" * 5000, "1a" * 3000):
        assert fitted.score(fitted.text(text)[0]) < 0.3


def test_frames(spark, clashing, fitted):
    df = clashing([(1, None), (2, ""), (3, "you rotter, you vermin"), (None, "kalo mi"), (3, "you rotter, you vermin"), (4, "mi " * 50_000)])
    got = score_toxicity(df, fitted).collect()
    assert len(got) == 6 and [r.doc_id for r in got if r.score >= 0.3] == [3, 3]
    left = drop_toxic(df, fitted)
    assert left.columns == df.columns and left.count() == 4
    assert score_toxicity(clashing([]), fitted).count() == 0


def test_counts_grow_with_the_corpus(spark, tables):
    docs, _ = tables
    once, twice = fit_characters(docs), fit_characters(docs.union(docs))
    assert (twice.counts == 2 * once.counts).all() and (twice.keys == once.keys).all()
    more = fit_characters(docs.union(spark.createDataFrame([(1, "".join(chr(0x4E00 + i) for i in range(3000)))], docs.schema)))
    assert len(more.keys) > len(once.keys) + 2900


def test_trigrams_are_counted_one_by_one(spark):
    texts = ["ab a, abc!", "", None, "Ab  ba", "été 世界 世界", "x" * 40]
    want = collections.Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            c = [0, 0, *map(ord, w), 0]
            want.update(zip(c[:-2], c[1:-1], c[2:]))
    got = fit_characters(spark.createDataFrame([(t,) for t in texts], "text string"))
    keys = [(int(k) >> 42, int(k) >> 21 & 0x1FFFFF, int(k) & 0x1FFFFF) for k in got.keys]
    found = {k: int(n) for k, n in zip(keys, got.counts) if k[1:] != (0, 0)}
    assert {k: n for k, n in found.items() if k[2]} == {k: n for k, n in want.items() if k[2]}
    assert all(n >= want[k] for k, n in found.items())


def test_words_that_count_only_if_they_come_twice(spark):
    # a stem stands once in clean texts, and several times, with other endings, in toxic ones
    r = random.Random(9)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "ten", "ru", "se"]) for _ in range(r.randrange(1, 4)))
    rows = []
    for i in range(900):
        words = [word() for _ in range(40)]
        for _ in range(3 if i % 6 == 0 else 1):
            words[r.randrange(40)] = "bozalur" + word()
        rows.append((i, " ".join(words), int(i % 6 == 0)))
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")
    got = score_toxicity(docs, fit_toxicity(docs, labels, held_out())).join(labels, "doc_id").filter(held_out())
    wrong = got.filter((F.col("score") >= 0.3).cast("int") != F.col("toxic")).count()
    assert wrong <= 0.03 * got.count()


def test_nothing_to_learn(spark, clashing, tables):
    docs, labels = tables
    for d, lab in ((docs, labels.limit(0)), (clashing([]), labels), (docs, labels.filter("toxic = 0"))):
        got = score_toxicity(docs.limit(3), fit_toxicity(d, lab, held_out()))
        assert got.filter("score >= 0.3").count() == 0
