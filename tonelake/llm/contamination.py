"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame operations only.

A test item's shingles in the order of their hashes are its MinHash sketch, those that fewer items share first, so that
what many items have in common is in no sketch as long as they have enough of their own. Items are partitioned by
size, and the sketch of a partition holds just so many least hashes that a document that contains
``threshold`` of the item must hold one of them: with at most ``u`` shingles, ``floor((1 - threshold)
* u) + 1``. So long documents need no sketch of their own, which would be blind to short items, and no
contained item is missed. A row of an item that is shorter than a shingle is one shingle as it is; documents then
have runs of as few words too.

First all documents stream past a broadcast table of the sketches, of at most ``SKETCH_ROWS`` rows; a
larger benchmark is taken in blocks of items, each with a scan of its own. A document that holds a
shingle of a sketch is a candidate for the item. Then the candidates alone are read again and verified
by exact containment: the part of the item's distinct shingles, compared word by word, that the
document holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.llm.common import written

WORDS, THRESHOLD = 5, 0.8
#: Rows of the broadcast table of sketches (24 bytes each), and of candidates that are broadcast.
SKETCH_ROWS, CANDIDATE_ROWS = 2_000_000, 200_000


def words(text: Column) -> Column:
    """Words in lower case: runs of letters, digits and marks; a null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+"), "")


def runs(w: Column, make, n: int = WORDS) -> Column:
    """``make`` of the runs of ``n`` words, as they follow, repeats included. ``w`` must be a column of its
    own: an expression would be evaluated again for each run."""
    starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: make(x, *[F.get(w, i + j) for j in range(1, n)]))


def shingles(w: Column, sizes: tuple[int, ...] = (WORDS,)) -> Column:
    """The runs of words as texts, of each of the sizes."""
    return F.concat(*[runs(w, lambda *x: F.concat_ws(" ", *x), n) for n in sizes])


def hashes(w: Column, sizes: tuple[int, ...] = (WORDS,)) -> Column:
    """Hashes of the runs of words, for sketches."""
    return F.concat(*[runs(w, F.xxhash64, n) for n in sizes])


def of_items(make, w: Column) -> Column:
    """What ``shingles`` or ``hashes`` make of an item's row: of its runs of words, or of all of it if that is shorter."""
    out = make(w)
    for n in range(1, WORDS):
        out = F.when(F.size(w) == n, make(w, (n,))).otherwise(out)
    return out


def sketch_size(size: Column, threshold: float) -> Column:
    """Least hashes that the sketch of the size's partition holds; partitions double in size."""
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(size.cast("double"))))
    # a hundredth against the rounding of the product
    return (F.floor(upper * (1 - threshold) + 0.01) + 1).cast("int")


def sketches(split: DataFrame, threshold: float) -> DataFrame:
    """Rows (h, item): the least hashes of each item of ``split(item, w)``, over all rows of the item, those of fewer items first."""
    whole = split.select("item", F.explode(F.array_distinct(of_items(hashes, F.col("w")))).alias("h")).distinct()
    place = F.row_number().over(Window.partitionBy("item").orderBy("items", "h"))
    size = whole.groupBy("item").agg(F.count("*").alias("size"))
    return whole.join(whole.groupBy("h").agg(F.count("*").alias("items")), "h").withColumn("place", place).join(size, "item").filter(F.col("place") <= sketch_size(F.col("size"), threshold)).select("h", "item")


def candidates(docs: DataFrame, sketch: DataFrame, sizes: tuple[int, ...] = (WORDS,)) -> DataFrame:
    """Distinct rows (doc, item) where a document of ``docs(doc, w)`` holds a shingle of the item's sketch."""
    blocks = max(1, -(-sketch.count() // SKETCH_ROWS))
    held = docs.select("doc", F.explode(hashes(F.col("w"), sizes)).alias("h"))
    parts = [sketch.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) for b in range(blocks)]
    return reduce(DataFrame.unionByName, [held.join(F.broadcast(part), "h").select("doc", "item") for part in parts]).distinct()


def contained_items(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Columns ``key``, ``item_key``, ``shared`` and ``size`` (distinct shingles), ``containment``: a row for
    each document and item of which it contains ``threshold`` or more.

    Texts are compared by lower-case words, so case, punctuation and spacing don't matter. An item of fewer than five
    words is held where its words follow each other. Texts without words hold nothing and are held by nothing; rows without a
    key take no part. Rows that repeat a document's key count as one document of all their shingles, and rows that repeat an
    item's key as one item likewise. Other columns take no part.
    """
    asked = items.select(items[item_key].alias("item"), words(items[item_text]).alias("w")).filter("item is not null")
    short = asked.select(F.size("w").alias("n")).filter(F.col("n").between(1, WORDS - 1)).distinct().collect()
    sizes = (WORDS, *sorted(r["n"] for r in short))
    split = docs.select(docs[key].alias("doc"), docs[text].alias("text")).filter("doc is not null")
    found = written(candidates(split.select("doc", words(F.col("text")).alias("w")), sketches(asked, threshold), sizes), "candidates")

    wanted = found.select("doc").distinct()
    few = found.count() <= CANDIDATE_ROWS
    again = split.join(F.broadcast(wanted) if few else wanted, "doc", "left_semi").select("doc", words(F.col("text")).alias("w"))
    held = again.select("doc", F.explode(shingles(F.col("w"), sizes)).alias("s")).distinct()
    of_item = asked.select("item", F.explode(F.array_distinct(of_items(shingles, F.col("w")))).alias("s")).distinct()
    size = of_item.groupBy("item").agg(F.count("*").alias("size"))
    shared = found.join(of_item, "item").join(held, ["doc", "s"]).groupBy("doc", "item").agg(F.count("*").alias("shared"))
    out = shared.join(size, "item").filter(F.col("shared") >= F.lit(threshold) * F.col("size") - F.lit(1e-9))
    return out.select(F.col("doc").alias(key), F.col("item").alias(item_key), F.col("shared").cast("long").alias("shared"), F.col("size").cast("long").alias("size"), (F.col("shared") / F.col("size")).alias("containment"))
