"""Removal of repeated byte strings by deep-shallow sorting of suffixes.

A string of ``length`` bytes that starts in two places is a pair of equal neighbours in the sorted list
of all suffixes. The list is never built whole:

1. Of every window of ``length`` bytes the least hash of its ``GRAM``-byte substrings stands for it, and
   consecutive windows with the same one form a run. Equal windows have the same least hash, so
   suffixes need to be sorted within the groups of one hash only, and a hash met once is done.
2. Runs that are equal from end to end are the same suffixes; they are counted, and each group
   sorts one of them.
3. A group's suffixes are sorted by ``deep_shallow``: multikey quicksort over 8-byte characters to a
   shallow depth, then blind tries for what still agrees there. Suffixes that meet in a leaf of a blind
   trie are equal in all ``length`` bytes.
4. A group of more than ``GROUP_BYTES`` is cut into runs of longer substrings, which only windows
   with more in common share; windows that still crowd at the longest are counted by their digests.

Bytes are compared as such in step 3. Runs in step 2 and windows at the end of step 4 are equal if
their 128-bit BLAKE2 digests are.
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
from tonelake.llm.wordhash import STEP, joined, mix, sliding_min, utf8

#: Bytes of the substring by which windows are grouped at first.
GRAM = 64
#: Bytes of a group's runs that are sorted together at most.
GROUP_BYTES = 1 << 20
#: Bytes to which quicksort goes before blind tries take over.
SHALLOW = 64
#: Bytes of text that a worker hashes at once.
SLICE = 1 << 19
#: A row's identity: its key and 128 bits of its text. Rows that share it are copies of each other.
ROW = ["k1", "k2", "k3"]
KEYS = "k1 bigint, k2 bigint, k3 bigint"
#: A place is a number: the first byte in its upper, the count of bytes in its lower half.
PLACE, SIZE_OF = 32, (1 << 32) - 1
PATH = ["h", "s1", "s2"]
PIECE = [("h", pa.int64()), *[(k, pa.int64()) for k in ROW], ("place", pa.int64()), ("own", pa.bool_()), ("text", pa.binary())]


class ByteRuns:
    """The runs of windows of some texts: ``doc``, ``start`` and ``end`` (bytes of all the texts),
    ``least`` (hash of the substring they share), ``place``, and ``weight``: 2 if the run holds that
    substring again for another of its windows, as it may repeat within itself."""

    def __init__(self, raw: list[bytes], gram: int, length: int):
        self.buffer = b"".join(raw)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        first = np.cumsum(sizes) - sizes
        hashes = gram_hashes(self.buffer, gram)
        least = sliding_min(hashes, length - gram + 1)
        windows = np.maximum(sizes - length + 1, 0)
        doc = np.repeat(np.arange(len(raw)), windows)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + first[doc]
        least, hashes = least[start], hashes[start]
        fresh = np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])][: len(doc)]
        at = np.flatnonzero(fresh)
        run = np.cumsum(fresh) - 1
        again = hashes == least
        again[:-1] &= run[1:] == run[:-1]
        again[-1:] = False
        self.weight = np.minimum(1 + np.bincount(run, weights=again, minlength=len(at)), 2).astype(np.int8)
        size = np.diff(np.r_[at, len(doc)])
        self.doc, self.least, self.start = doc[at], least[at].view(np.int64), start[at]
        self.end = self.start + size + length - 1
        self.place = ((self.start - first[self.doc]) << PLACE) + self.end - self.start

    def digests(self) -> np.ndarray:
        """Two columns of 64 bits: the digest of each run's bytes."""
        view = memoryview(self.buffer)
        out = b"".join(hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True))
        return np.frombuffer(out, dtype=np.int64).reshape(-1, 2)


def gram_hashes(buffer: bytes, gram: int) -> np.ndarray:
    """Hashes of each ``gram`` consecutive bytes: 8-byte words, joined by doubling, and at last two that overlap."""
    unit = 8 if gram >= 8 else 1
    n = max(0, len(buffer) - unit + 1)
    words = np.ndarray((n,), "<u8" if unit == 8 else "u1", buffer, strides=(1,)).astype(np.uint64)
    out, width = mix(words * STEP + STEP), unit
    while width < gram:
        step = min(width, gram - width)
        out = joined(out[: max(0, len(out) - step)], out[step:])
        width += step
    return out


def deep_shallow(text: np.ndarray, at: np.ndarray, length: int, shallow: int = SHALLOW, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of the ``length`` bytes from each of the positions ``at``, and which of them are equal to
    others. ``groups`` are the sizes of consecutive groups of positions that are sorted apart. All are worked on together,
    one step of each at a time."""
    n, shallow = len(at), min(shallow, length // 2) // 8 * 8
    words = np.ndarray((len(text),), ">u8", np.r_[text, np.zeros(8, np.uint8)].tobytes(), strides=(1,)).astype(np.uint64)
    order, twin = np.arange(n), np.zeros(n, dtype=bool)

    def members(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group of each member, and where it stands in ``order``."""
        group = np.repeat(np.arange(len(size)), size)
        return group, np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size) + first[group]

    # multikey quicksort: less than, equal to and greater than the pivot's character; only the equal go deeper
    size = np.array([n]) if groups is None else groups
    first, depth = np.cumsum(size) - size, np.zeros(len(size), np.int64)
    deep = [np.zeros((0, 2), np.int64)]
    while True:
        deeper = (depth >= shallow) & (size > 1)
        deep.append(np.stack([first[deeper], size[deeper]], axis=1))
        todo = (depth < shallow) & (size > 1)
        first, size, depth = first[todo], size[todo], depth[todo]
        if not len(first):
            break
        group, place = members(first, size)
        held = order[place]
        key = words[at[held] + depth[group]]
        pivot = words[at[order[first + size // 2]] + depth][group]
        part = group * 3 + 1 + (key > pivot) - (key < pivot)
        count = np.bincount(part, minlength=3 * len(first))
        order[place] = held[np.argsort(part, kind="stable")]
        start = np.cumsum(count).reshape(-1, 3) - count.reshape(-1, 3)
        first = (start - start[:, :1] + first[:, None]).ravel()
        size, depth = count, (depth[:, None] + np.array([0, 8, 0])).ravel()
    # blind tries: of a group the first goes down whole, the others leave its path at one byte each, and those that leave
    # at the same depth by the same byte are a group of their own
    first, size = np.concatenate(deep).T
    depth = np.full(len(first), shallow)
    while len(first):
        group, place = members(first, size)
        held = order[place]
        a, b, common = at[held], at[order[first]][group], depth[group]
        branch = np.full(len(held), length << 9)  # of those equal to the first; the others stand before or after
        open_ = np.flatnonzero(common < length)
        while len(open_):
            x, y = words[a[open_] + common[open_]], words[b[open_] + common[open_]]
            differ = x != y
            there, bits = open_[differ], x[differ] ^ y[differ]
            byte = (7 - np.searchsorted(1 << np.arange(8, 64, 8, dtype=np.uint64), bits, side="right")).astype(np.int64)
            common[there] += byte
            leaves = common[there] < length
            there, less = there[leaves], (x[differ] < y[differ])[leaves]
            own = text[a[there] + common[there]].astype(np.int64)
            branch[there] = np.where(less, common[there] << 8, (length << 10) - (common[there] << 8)) + own
            open_ = open_[~differ]
            common[open_] += 8
            open_ = open_[common[open_] < length]
        equal = branch == length << 9
        twin[held[equal & (np.bincount(group, weights=equal)[group] > 1)]] = True
        rank = group * ((length + 1) << 11) + branch
        turn = np.argsort(rank, kind="stable")
        order[place] = held[turn]
        rank, equal, common = rank[turn], equal[turn], common[turn]
        at_ = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
        size = np.diff(np.r_[at_, len(rank)])
        more = (size > 1) & ~equal[at_]
        first, depth, size = place[at_[more]], common[at_[more]] + 1, size[more]
    return order, twin


def sorted_groups(length: int):
    """Places (k1, k2, k3, place) of bytes that repeat, from pieces (h, k1, k2, k3, place, own, text) ordered
    by ``h``. Only pieces that are ``own`` are marked. Small groups are sorted together; a group is
    never cut."""

    def build(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        raw = rows.column("text").to_pylist()
        text = np.frombuffer(b"".join(raw), dtype=np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        first, windows = np.cumsum(sizes) - sizes, sizes - length + 1
        piece = np.repeat(np.arange(len(raw)), windows)
        offset = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
        hashes = rows.column("h").to_numpy()
        starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)])
        _, twin = deep_shallow(text, first[piece] + offset, length, groups=np.add.reduceat(windows, starts))
        marked = np.flatnonzero(twin & rows.column("own").to_numpy()[piece])
        piece, offset = piece[marked], offset[marked]
        # windows of a piece that touch or overlap become one place
        fresh = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | (offset[1:] > offset[:-1] + length)][: len(piece)])
        last = np.r_[fresh[1:], len(piece)][: len(fresh)] - 1
        piece, begin, stop = piece[fresh], offset[fresh], offset[last] + length
        place = (((rows.column("place").to_numpy()[piece] >> PLACE) + begin) << PLACE) + stop - begin
        return pa.RecordBatch.from_arrays([*[rows.column(k).combine_chunks().take(pa.array(piece)) for k in ROW], pa.array(place)], names=[*ROW, "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        total, last = 0, None
        for b in batches:
            start = 0
            for i, (h, place) in enumerate(zip(b.column(0).to_pylist(), b.column(4).to_pylist(), strict=True)):
                if h != last and total >= GROUP_BYTES:
                    yield build([*held, b.slice(start, i - start)])
                    held, total, start = [], 0, i
                last = h
                total += place & SIZE_OF
            held.append(b.slice(start))
        if total:
            yield build(held)

    return run


def _batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for b in batches:
        raw = b.column(text).to_pylist() if pa.types.is_binary(b.schema.field(text).type) else utf8(b.column(text).to_pylist())
        for i, j in slices([len(r) for r in raw], SLICE):
            yield b.slice(i, j - i), raw[i:j]


def _found(b: pa.RecordBatch, runs: ByteRuns, columns: list[int], names: list[str], *, text: bool) -> pa.RecordBatch:
    doc, digest = pa.array(runs.doc), runs.digests()
    out = [pa.array(runs.least), pa.array(digest[:, 0]), pa.array(digest[:, 1]), *[b.column(i).take(doc) for i in columns], pa.array(runs.place), pa.array(runs.weight)]
    if text:
        out.append(pa.array([runs.buffer[i:j] for i, j in zip(runs.start.tolist(), runs.end.tolist(), strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(out, names=[*PATH, *names, "place", "weight", *["text"] * text])


def finer(gram: int, length: int):
    """The runs by longer substrings of the pieces of crowded groups, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw in _batches(batches, 6):
            runs = ByteRuns(raw, gram, length)
            from_ = (b.column(4).to_numpy()[runs.doc] >> PLACE) << PLACE
            runs.place = runs.place + from_
            yield _found(b, runs, [1, 2, 3, 5], [*ROW, "own"], text=True)

    return run


def windows(length: int):
    """Each window of the pieces, by its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw in _batches(batches, 6):
            count = np.array([len(r) - length + 1 for r in raw])
            doc = np.repeat(np.arange(len(raw)), count)
            offset = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            digest = [hashlib.blake2b(raw[i][j : j + length], digest_size=16).digest() for i, j in zip(doc.tolist(), offset.tolist(), strict=True)]
            place = (((b.column(4).to_numpy()[doc] >> PLACE) + offset) << PLACE) + length
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), *[b.column(i).take(take) for i in (1, 2, 3)], pa.array(place), b.column(5).take(take)], names=["w", *ROW, "place", "own"])

    return run


def repeated_bytes(docs: DataFrame, length: int = 400, *, key: str = "doc_id", text: str = "text", gram: int = GRAM, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Columns ``key``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (binary) for each row of
    ``docs``: every byte goes that is covered by ``length`` bytes which also start anywhere else.

    A null text has no bytes. Rows that repeat, key or not, are texts of their own, so what they have in
    common repeats. Texts under ``length`` bytes lose nothing. Other columns take no part; an empty
    table gives an empty result. What is kept need not be UTF-8, as spans may begin within a character.
    """
    small_batches(docs.sparkSession)
    gram = min(gram, length)
    body = F.coalesce(docs[text], F.lit(""))
    base = docs.select(
        F.coalesce(docs[key].cast("bigint"), F.lit(-(2**63))).alias("k1"), F.xxhash64(body).alias("k2"), F.xxhash64(F.lit(1), body).alias("k3"),
        docs[key].alias("id"), docs[text].alias("text"),
    )
    size = F.col("place").bitwiseAND(F.lit(SIZE_OF))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw in _batches(batches, 3):
            yield _found(b, ByteRuns(raw, gram, length), [0, 1, 2], ROW, text=False)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw in _batches(batches, 0):
            found = ByteRuns(raw, gram, length)
            yield pa.RecordBatch.from_arrays([pa.array(found.least), pa.array(found.weight)], names=["h", "weight"])

    met = base.select("text").mapInArrow(hashes, "h bigint, weight tinyint")
    # written tables are dealt anew for each join, so that a hash or path of very many runs is split there
    shared = written(met.groupBy("h").agg(F.sum("weight").alias("weight")).filter("weight >= 2").select("h"), "grams")
    found = base.select(*ROW, "text").mapInArrow(runs, f"h bigint, s1 bigint, s2 bigint, {KEYS}, place bigint, weight tinyint")
    live = kept(found.join(shared, "h").select(*PATH, *ROW, "place"))
    paths = written(live.groupBy(*PATH).agg(F.count("*").alias("n"), F.min(F.struct(*ROW, "place")).alias("one")), "paths")
    marks = [live.join(paths.filter("n >= 2").select(*PATH), PATH).select(*ROW, "place")]
    # a group is sorted if a path in it stands alone: then one run of each of its paths
    groups = written(paths.groupBy("h").agg(F.min("n").alias("least"), F.sum(F.col("one.place").bitwiseAND(F.lit(SIZE_OF))).alias("bytes")).filter("least = 1").select("h", (F.col("bytes") > group_bytes).alias("large")), "groups")
    asked = paths.join(groups, "h").select("h", "one.*", (F.col("n") == 1).alias("own"), "large")
    asked = written(asked.groupBy(*ROW).agg(F.collect_set(F.struct("h", "place", "own", "large")).alias("asked")), "asked")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the runs that are asked for."""
        for b in batches:
            out = []
            for k1, k2, k3, text, wanted in zip(*[c.to_pylist() for c in b.columns], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for x in wanted:
                    at = x["place"] >> PLACE
                    out.append((x["h"], k1, k2, k3, x["place"], x["own"], raw[at : at + (x["place"] & SIZE_OF)], x["large"]))
            schema = pa.schema([*PIECE, ("large", pa.bool_())])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(schema), schema.types, strict=True)], schema=schema)

    piece = f"h bigint, {KEYS}, place bigint, own boolean, text binary"
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [k for k, _ in PIECE]

    def in_order(pieces: DataFrame) -> DataFrame:
        return pieces.select(*names).repartition(partitions, "h").sortWithinPartitions("h").mapInArrow(sorted_groups(length), f"{KEYS}, place bigint")

    pieces = base.select(*ROW, "text").join(asked, ROW).mapInArrow(cut, f"{piece}, large boolean")
    held, tables = [live], [shared, paths, groups, asked]
    if groups.filter("large").isEmpty():
        marks.append(in_order(pieces))
        pieces = None
    while pieces is not None:
        held.append(pieces := kept(pieces))
        marks.append(in_order(pieces.filter("NOT large")))
        crowd, gram = pieces.filter("large").select(*names), (gram + length + 1) // 2
        if crowd.isEmpty():
            break
        if length - gram < max(1, length // 8):
            held.append(each := kept(crowd.mapInArrow(windows(length), f"w binary, {KEYS}, place bigint, own boolean")))
            twice = written(each.groupBy("w").agg(F.count("*").alias("n")).filter("n >= 2").select("w"), "windows")
            marks.append(each.filter("own").join(twice, "w").select(*ROW, "place"))
            tables.append(twice)
            break
        held.append(parts := kept(crowd.mapInArrow(finer(gram, length), f"h bigint, s1 bigint, s2 bigint, {KEYS}, own boolean, place bigint, weight tinyint, text binary")))
        paths = written(parts.groupBy(*PATH).agg(F.count("*").alias("n"), F.max("weight").alias("weight"), F.min(F.struct(*ROW, "place")).alias("one")), "paths")
        marks.append(parts.filter("own").join(paths.filter("n >= 2").select(*PATH), PATH).select(*ROW, "place"))
        groups = paths.groupBy("h").agg(F.min("n").alias("least"), (F.count("*") + F.max("weight")).alias("of"), F.sum(F.col("one.place").bitwiseAND(F.lit(SIZE_OF))).alias("bytes"))
        groups = written(groups.filter("least = 1 AND of > 2").select("h", (F.col("bytes") > group_bytes).alias("large")), "groups")
        tables += [paths, groups]
        chosen = written(paths.join(groups, "h").select(*PATH, "n", "one", "large"), "chosen")
        tables.append(chosen)
        pieces = parts.join(chosen, PATH).filter(F.struct(*ROW, "place") == F.col("one")).select("h", *ROW, "place", (F.col("own") & (F.col("n") == 1)).alias("own"), "text", "large")
    places = reduce(DataFrame.unionByName, marks)
    marked = written(places.groupBy(*ROW).agg(F.collect_set("place").alias("places")), "marks")
    for df in held:
        df.unpersist()
    for table in tables:
        forget(table)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_bytes, n_removed, n_spans, left = [], [], [], []
            for text, places in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                for place in sorted(places or ()):
                    at = place >> PLACE
                    stop = at + (place & SIZE_OF)
                    if spans and at <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], stop)
                    else:
                        spans.append([at, stop])
                edges = [0, *[x for s in spans for x in s], len(raw)]
                n_bytes.append(len(raw))
                n_removed.append(sum(stop - at for at, stop in spans))
                n_spans.append(len(spans))
                left.append(b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)], pa.array(left, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = base.join(marked, ROW, "left").select("id", "text", "places").mapInArrow(remove, f"id {docs.schema[key].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.withColumnRenamed("id", key)
