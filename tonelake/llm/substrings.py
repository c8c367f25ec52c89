"""Substring dedup over prefix-partitioned suffix trees.

A window of ``length`` words repeats if the node for it in the corpus' generalised suffix tree, at
depth ``length``, has two suffixes or more. The tree is never built whole:

1. Suffixes are sparse: of every window only the one behind its least ``PREFIX``-word hash stands for it,
   and consecutive windows with the same such prefix form a run. Equal windows have equal prefixes, so
   nothing is lost, and a prefix that occurs once is a leaf: none of its windows repeats.
2. Runs that are equal from end to end are one path; they are counted, and of each path one run goes on.
3. Runs are grouped by their prefix. A group fits in memory if it has at most ``GROUP_WORDS`` words; if
   not, its prefix is lengthened. A prefix of ``n`` words at distance ``a`` behind the window's start
   serves the windows at distances ``a`` to ``a + length - n``, so the windows are split into the nearer
   and the farther half, whose words in common are a longer prefix, until the group fits or the
   prefix is the whole window, which needs a count only.
4. For each group the subtree is built over its words: their suffixes in order, with the length of
   the common prefix of neighbours. Its internal nodes at depth ``length`` or more give the longest
   repeat from each position, and the words of these maximal repeats are removed.

Words are compared as such in step 4. Paths in step 2 are equal if two 64-bit hashes agree, whole
windows at the end of step 3 if their MD5 digests do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import forget, kept, slices, small_batches, written
from tonelake.llm.wordhash import STEP, Words, mix, numbered, of_runs, sliding_min, utf8, word_ids

#: Words of the prefix by which suffixes are grouped at first.
PREFIX = 10
#: Words of a group's runs that one subtree is built over at most.
GROUP_WORDS = 1 << 18
#: Bytes of text whose hashes a worker holds at once.
SLICE = 1 << 19
#: A row's identity: its key and 128 bits of its text. Rows that share it are copies of each other.
ROW = ["k1", "k2", "k3"]
KEYS = "k1 bigint, k2 bigint, k3 bigint"
#: A place is a number: the first word in its upper, the count of words in its lower half.
PLACE, WORDS_OF = 32, (1 << 32) - 1
TREE = ["key", *ROW, "place", "own", "text"]
#: A run on its way: its group, where it stands, whether it can be marked, its words, and how its windows lie to the group's prefix.
PART = pa.schema([
    ("key", pa.binary()), *[(k, pa.int64()) for k in ROW], ("place", pa.int64()), ("own", pa.bool_()), ("text", pa.binary()),
    ("low", pa.int32()), ("high", pa.int32()), ("x", pa.int32()), ("least", pa.int64()), ("large", pa.bool_()),
])


class Runs:
    """The runs of windows of some texts: ``doc``, ``start`` and ``end`` (words of all the texts),
    ``least`` (hash of the prefix), ``path`` (hash of the run's words), ``place``, and ``weight``: 2 if
    the run holds its prefix again for another of its windows, as it may repeat within itself."""

    def __init__(self, raw: list[bytes], length: int):
        w = Words(raw)
        prefix, n = min(PREFIX, length), len(w)
        hashes = of_runs(w.hash, prefix)
        least = sliding_min(hashes, length - prefix + 1)
        start = np.flatnonzero(w.doc[: max(0, n - length + 1)] == w.doc[length - 1 :])
        least, whole = least[start], of_runs(w.hash, length)[start]
        fresh = np.r_[True, (np.diff(start) != 1) | (least[1:] != least[:-1]) | (np.diff(w.doc[start]) != 0)][: len(start)]
        at = np.flatnonzero(fresh)
        run = np.cumsum(fresh) - 1
        again = hashes[start] == least
        again[:-1] &= run[1:] == run[:-1]
        again[-1:] = False
        self.weight = np.minimum(1 + np.bincount(run, weights=again, minlength=len(at)), 2).astype(np.int8)
        self.least = least[at]
        size = np.diff(np.r_[at, len(start)])
        order = (np.arange(len(start)) - np.repeat(at, size)).astype(np.uint64)
        sums = np.add.reduceat(mix(whole + order * STEP), at) if len(at) else np.zeros(0, np.uint64)
        self.path = mix(sums + size.astype(np.uint64))
        self.start, self.end = start[at], start[at] + size + length - 1
        self.doc = w.doc[self.start]
        self.place = ((self.start - w.first[self.doc]) << PLACE) + self.end - self.start


def _batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for b in batches:
        raw = utf8(b.column(text).to_pylist())
        for i, j in slices([len(r) for r in raw], SLICE):
            yield b.slice(i, j - i), raw[i:j]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def longest_repeats(words: np.ndarray, length: int) -> np.ndarray:
    """For each position of ``words`` the length of the longest run of words from it that starts at
    another position too, if it is ``length`` or more (from ``2 * length`` on it may be understated, but
    not below ``length``), else 0: the depth of the deepest internal node of the suffix tree on the
    suffix's path."""
    n = len(words)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    # words of their own behind the end, so that all suffixes are long enough
    padded = np.r_[words, int(words.max()) + 1 + np.arange(4 * length)]
    ranks = [np.unique(padded, return_inverse=True)[1]]  # ranks[k] orders the runs of 2**k words
    while 2 ** len(ranks) <= length:
        half = 2 ** (len(ranks) - 1)
        ranks.append(numbered(ranks[-1][:-half], ranks[-1][half:]))
    top = 2 ** (len(ranks) - 1)
    # the suffix array by the first 2 * top words, and what neighbours have in common
    order = np.lexsort((ranks[-1][top : top + n], ranks[-1][:n]))
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, dtype=np.int64)
    for k in [len(ranks) - 1, *range(len(ranks) - 1, -1, -1)]:
        x, y = a + common, b + common
        inside = np.maximum(x, y) < len(ranks[k])
        same = np.zeros(n - 1, dtype=bool)
        same[inside] = ranks[k][x[inside]] == ranks[k][y[inside]]
        common[same] += 2**k
    common[common < length] = 0
    out[order] = np.maximum(np.r_[common, 0], np.r_[0, common])
    return out


def subtrees(length: int):
    """Places (k1, k2, k3, place) of words in repeats, from runs (key, k1, k2, k3, place, own, text)
    ordered by key. Only runs that are ``own`` are marked. Small groups share a tree; a group is never
    cut."""

    def build(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids, count = word_ids(rows.column(6).to_pylist())
        first = np.cumsum(count) - count
        # a word of its own behind each run, so that no repeat goes beyond it
        words = np.insert(ids, first + count, len(ids) + np.arange(len(count)))
        depth = longest_repeats(words, length)
        first += np.arange(len(count))
        run = np.repeat(np.arange(len(count)), count + 1)
        start = np.flatnonzero((depth > 0) & np.array(rows.column(5).to_pylist(), dtype=bool)[run])
        # repeats that touch or overlap become one place
        reach = np.maximum.accumulate(start + depth[start])
        at = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]][: len(start)])
        begin, stop = start[at], reach[np.r_[at[1:] - 1, len(start) - 1]] if len(at) else reach
        run = run[begin]
        place = (rows.column(4).to_numpy()[run] >> PLACE) + begin - first[run]
        return pa.RecordBatch.from_arrays([*[rows.column(i).combine_chunks().take(pa.array(run)) for i in (1, 2, 3)], pa.array((place << PLACE) + stop - begin)], names=[*ROW, "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        words, last = 0, None
        for b in batches:
            start = 0
            for i, (key, place) in enumerate(zip(b.column(0).to_pylist(), b.column(4).to_pylist(), strict=True)):
                if key != last and words >= GROUP_WORDS:
                    yield build([*held, b.slice(start, i - start)])
                    held, words, start = [], 0, i
                last = key
                words += place & WORDS_OF
            held.append(b.slice(start))
        if words:
            yield build(held)

    return run


def split(length: int):
    """The two halves of each run whose group is too large, each with the longer prefix that its windows
    share. The distances of the windows' starts to the prefix at word ``x`` are ``low`` to ``high``;
    ``x`` is -1 at first: then each window has its prefix where its least hash stands first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                words = r["text"].split()
                windows = np.arange(len(words) - length + 1)
                if r["x"] >= 0:
                    x = np.full(len(windows), r["x"])
                else:
                    hashes = of_runs(Words([r["text"]]).hash, min(PREFIX, length))
                    here = np.flatnonzero(hashes == np.uint64(r["least"] & (2**64 - 1)))
                    x = here[np.searchsorted(here, windows)]
                far, middle = x - windows, (r["low"] + r["high"]) // 2
                for low, high in ((r["low"], middle), (middle + 1, r["high"])):
                    mine = np.flatnonzero((far >= low) & (far <= high))
                    # consecutive windows with the same prefix stay together
                    for part in np.split(mine, np.flatnonzero((np.diff(mine) != 1) | (np.diff(x[mine]) != 0)) + 1):
                        if len(part):
                            s, at = int(part[0]), int(x[part[0]])
                            text = words[s : int(part[-1]) + length]
                            key = hashlib.md5(b" ".join(words[at - low : at - high + length])).digest()
                            place = (((r["place"] >> PLACE) + s) << PLACE) + len(text)
                            out.append({**r, "key": key, "place": place, "text": b" ".join(text), "low": low, "high": high, "x": at - s})
            yield pa.RecordBatch.from_pylist(out, schema=b.schema)

    return run


def suffix_dedup(docs: DataFrame, length: int = 35, *, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """Columns ``key``, ``n_words``, ``n_removed`` and ``kept`` (the kept words joined by one space) for
    each row of ``docs``, and behind them the columns that ``carry`` names. With ``whole``, texts that
    lose nothing are kept as they are, null included.

    A null text has no words. Rows that repeat, key or not, are texts of their own, so their common
    windows repeat. Texts of fewer than ``length`` words lose nothing. Other columns take no part; an
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    carried = (key, *carry)
    fields = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carried))
    body = F.coalesce(docs[text], F.lit(""))
    base = docs.select(
        F.coalesce(docs[key].cast("bigint"), F.lit(-(2**63))).alias("k1"), F.xxhash64(body).alias("k2"), F.xxhash64(F.lit(1), body).alias("k3"),
        F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(carried)]).alias("id"), docs[text].alias("text"),
    )

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw in _batches(batches, 3):
            w = Runs(raw, length)
            doc = pa.array(w.doc)
            yield pa.RecordBatch.from_arrays([_signed(w.least), _signed(w.path), *[b.column(i).take(doc) for i in range(3)], pa.array(w.place), pa.array(w.weight)], names=["h", "s", *ROW, "place", "w"])

    suffixes = base.select(*ROW, "text").mapInArrow(prefixes, f"h bigint, s bigint, {KEYS}, place bigint, w tinyint")
    # written tables are dealt anew for each join, so that a prefix or path of very many runs is split there
    shared = written(suffixes.groupBy("h").agg(F.sum("w").alias("w")).filter("w >= 2").select("h"), "prefixes")
    live = kept(suffixes.join(shared, "h").select("h", "s", *ROW, "place"))
    paths = written(live.groupBy("h", "s").agg(F.count("*").alias("n"), F.min(F.struct(*ROW, "place")).alias("one")), "paths")
    marks = [live.join(paths.filter("n >= 2").select("h", "s"), ["h", "s"]).select(*ROW, "place")]
    # where a prefix branches, one run of each path goes on
    single = paths.filter("n = 1")
    several = paths.filter("n >= 2").join(single.select("h").distinct(), "h", "left_semi")
    asked = single.withColumn("own", F.lit(True)).unionByName(several.withColumn("own", F.lit(False))).select("h", "one.*", "own")
    words = F.col("place").bitwiseAND(F.lit(WORDS_OF))
    large = kept(asked.groupBy("h").agg(F.sum(words).alias("words")).filter(F.col("words") > GROUP_WORDS).select("h", F.lit(True).alias("large")))
    asked = asked.join(large, "h", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    asked = written(asked.groupBy(*ROW).agg(F.collect_set(F.struct("h", "place", "own", "large")).alias("asked")), "asked")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of the runs that are asked for."""
        high = length - min(PREFIX, length)
        for b in batches:
            out = []
            for k1, k2, k3, text, wanted in zip(*[c.to_pylist() for c in b.columns], strict=True):
                w = text.encode("utf-8", "surrogatepass").split()
                for x in wanted:
                    at, h = x["place"] >> PLACE, x["h"]
                    out.append((h.to_bytes(8, "little", signed=True), k1, k2, k3, x["place"], x["own"], b" ".join(w[at : at + (x["place"] & WORDS_OF)]), 0, high, -1, h, x["large"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(PART), PART.types, strict=True)], schema=PART)

    part = f"key binary, {KEYS}, place bigint, own boolean, text binary, low int, high int, x int, least bigint, large boolean"
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def in_trees(rows: DataFrame) -> DataFrame:
        return rows.select(*TREE).repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(subtrees(length), f"{KEYS}, place bigint")

    texts = base.select(*ROW, "text").join(asked, ROW).mapInArrow(runs, part)
    held = [live, large]
    if large.isEmpty():
        marks.append(in_trees(texts))
    else:
        held.append(texts := kept(texts))
        marks.append(in_trees(texts.filter("NOT large")))
        rest = texts.filter("large")
        while not rest.isEmpty():  # each round halves what is left of the windows' distances
            held.append(parts := kept(rest.mapInArrow(split(length), part)))
            group = ["key", "low", "high"]
            sizes = parts.groupBy(group).agg(F.count("*").alias("n"), F.sum(words).alias("words")).filter("n > 1")
            # a group is settled by its count if its prefix is the whole window
            settled = F.expr(f"CASE WHEN low = high THEN 'repeat' WHEN words <= {GROUP_WORDS} THEN 'tree' ELSE 'split' END")
            judged = parts.join(written(sizes.select(*group, settled.alias("state")), "sizes"), group)
            marks.append(judged.filter("state = 'repeat' AND own").select(*ROW, "place"))
            marks.append(in_trees(judged.filter("state = 'tree'")))
            rest = judged.filter("state = 'split'").select(*parts.columns)
    places = reduce(DataFrame.unionByName, marks)
    marked = written(places.groupBy(*ROW).agg(F.collect_set("place").alias("places")), "marks")
    for df in held:
        df.unpersist()
    for table in (shared, paths, asked):
        forget(table)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, left = [], [], []
            for text, places in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                gone = 0
                n_words.append(len(words))
                if places:
                    at = np.array(places, dtype=np.int64)
                    cover = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(cover, at >> PLACE, 1)
                    np.add.at(cover, (at >> PLACE) + (at & WORDS_OF), -1)
                    stays = np.cumsum(cover[:-1]) == 0
                    gone = len(words) - int(stays.sum())
                    words = [x for x, s in zip(words, stays.tolist(), strict=True) if s]
                n_removed.append(gone)
                left.append(text if whole and not gone else b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([*b.column(0).flatten(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(left, pa.string())], names=[*[f"c{i}" for i in range(len(carried))], "n_words", "n_removed", "kept"])

    out = base.join(marked, ROW, "left").select("id", "text", "places").mapInArrow(remove, f"{fields}, n_words bigint, n_removed bigint, kept string")
    return out.select(F.col("c0").alias(key), "n_words", "n_removed", "kept", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carried) if i])

