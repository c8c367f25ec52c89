import re

from pyspark.sql import functions as F

from tonelake.llm import contamination
from tonelake.llm.contamination import contained_items


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items, threshold):
    d, q = {}, {}
    for k, t in docs:
        if k is not None:
            d.setdefault(k, set()).update(*(grams(t, n) for n in range(1, 6)))
    for k, t in items:
        if k is not None:  # a row under five words is one run of all its words
            q.setdefault(k, set()).update(grams(t, max(1, min(5, len(words(t))))))
    return {(k, i, len(g & s), len(s)) for k, g in d.items() for i, s in q.items() if s and len(g & s) >= threshold * len(s) - 1e-9}


def check(spark, docs, clashing, items, threshold=0.8):
    got = contained_items(clashing(docs), spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, size int"), threshold=threshold)
    assert {(r.doc_id, r.item_id, r.shared, r["size"]) for r in got.collect()} == brute(docs, items, threshold)
    return got


def test_planted_items(spark, clashing, prose):
    items = [(i, prose(i, 6 + 5 * i)) for i in range(30)] + [(99, "too short to count"), (98, None), (97, ""), (None, prose(1, 20)), (96, prose(3, 21))]
    docs = []
    for i in range(30):
        w = items[i][1].split()
        docs.append((i, prose(500 + i, 300) + " " + items[i][1].upper().replace(" ", ",\n") + ". " + prose(600 + i, 40)))
        w[len(w) // 2] = "changed"
        docs.append((100 + i, " ".join(w) + " " + prose(700 + i, 2000)))
        docs.append((200 + i, " ".join(w[: int(len(w) * 0.8)])))
    docs += [(1, prose(3, 21)), (None, items[5][1]), (900, None), (901, ""), (902, "a b c d"), (903, items[7][1]), (903, items[7][1])]
    check(spark, docs, clashing, items)
    check(spark, docs, clashing, items, 0.5)


def test_empty_tables(spark, clashing, prose):
    check(spark, [], clashing, [(1, prose(1, 20))])
    check(spark, [(1, prose(1, 20))], clashing, [])


def test_blocks_give_the_same(spark, clashing, prose, monkeypatch):
    import tonelake.llm.contamination as c

    monkeypatch.setattr(c, "SKETCH_ROWS", 12)
    monkeypatch.setattr(c, "CANDIDATE_ROWS", 0)
    items = [(i, prose(i, 30)) for i in range(8)]
    check(spark, [(i, prose(i % 9, 30)) for i in range(40)], clashing, items)


def test_rows_of_one_item_are_sketched_together(spark, clashing, prose):
    # the sketch of a row alone would be larger than that of the whole item, and of other shingles
    parts = [prose(40 + i, 9) for i in range(16)]
    items = [(1, p) for p in parts] + [(2, prose(3, 40)), (2, prose(3, 40)), (2, prose(4, 20))]
    docs = [(i, " | ".join(parts[:i])) for i in range(9, 17)] + [(100, prose(3, 40) + " " + prose(4, 20)), (101, prose(3, 40))]
    check(spark, docs, clashing, items)


def test_sketches_leave_documents_out(spark, clashing, prose):
    items = spark.createDataFrame([(i, prose(i, 60)) for i in range(20)], "item long, text string").select("item", contamination.words(F.col("text")).alias("w"))
    sketch = contamination.sketches(items, 0.8)
    assert {r["count"] for r in sketch.groupBy("item").count().collect()} == {int(64 * 0.2 + 0.01) + 1}
    # each document holds a few words of an item, so without sketches all were candidates
    docs = clashing([(100 * i + j, " ".join(prose(i, 60).split()[j : j + 6])) for i in range(20) for j in range(0, 54, 3)])
    docs = docs.select(F.col("doc_id").alias("doc"), contamination.words(F.col("text")).alias("w"))
    every = items.select("item", F.explode(contamination.hashes(F.col("w"))).alias("h")).distinct()
    n = contamination.candidates(docs, sketch).count()
    assert 0 < n < 0.7 * contamination.candidates(docs, every).count()


def test_short_items(spark, clashing, prose):
    items = [(1, "one"), (2, "two little words"), (3, "a run of four"), (4, prose(1, 30)), (4, "and more"), (5, ",.;")]
    docs = [(1, "One!"), (2, "two words little words"), (3, prose(2, 40) + " two, LITTLE words " + prose(3, 20)), (4, "a run of four"), (5, "run of four a"), (6, prose(1, 30) + " and more"), (7, prose(1, 30)), (8, "and more one")]
    got = check(spark, docs, clashing, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1), (8, 1), (3, 2), (4, 3), (6, 4), (7, 4)}


def test_a_passage_of_many_items_makes_no_candidates(spark, clashing, prose):
    """k documents and k items that share nine words."""
    common = prose(1, 9)
    for k in (30, 60):
        items = spark.createDataFrame([(i, f"{prose(1000 + i, 12)} item{i} {common} item{i} {prose(3000 + i, 12)}") for i in range(k)], "item long, text string").select("item", contamination.words(F.col("text")).alias("w"))
        docs = clashing([(i, f"{prose(5000 + i, 40)} {common} {prose(7000 + i, 40)}") for i in range(k)]).select(F.col("doc_id").alias("doc"), contamination.words(F.col("text")).alias("w"))
        assert contamination.candidates(docs, contamination.sketches(items, 0.8)).count() == 0
