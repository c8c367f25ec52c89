"""Near-duplicate classes by BagMinHash: band, compare signatures, verify multiset overlap.

Texts that are equal form one node. Two nodes that share a band and agree in ``AGREE`` registers of
their whole signatures are candidates, nodes of one component of the candidates are compared
exactly, word by word, and those of ``threshold`` weighted Jaccard similarity or more are links.
Classes are the links' components.

Neither step writes pairs: within a cell that holds a block of a group's nodes all are compared, and
only a spanning forest of what is linked leaves it. A group of more nodes than a block holds is dealt
into blocks. Then the node with most links of each block, the block's representative, is compared
with all nodes of the group; and last, what still is in no class with most of the group is compared
with all nodes of the group too. So a large group of near copies takes a few copies of each text,
and no link is left out, as only nodes of one class are never compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.bagminhash import BANDS, REGISTERS, ROWS, Bags, signatures
from tonelake.llm.common import forget, kept, slices, small_batches, written
from tonelake.llm.wordhash import utf8

THRESHOLD, WORDS = 0.8, 5
#: Nodes of a block when signatures are compared.
BUCKET = 2048
#: Registers, of all, that a pair must share to be checked (4 standard deviations below 0.8).
AGREE = 48
#: Nodes and bytes of text of a block in the exact check, and the texts of a shingle from which on
#: overlaps are counted by a product of matrices.
BLOCK, BLOCK_BYTES, CROWD = 1024, 2 << 20, 32
#: Bytes of text that a worker hashes at once.
SLICE = 1 << 19
EDGES = "cell bigint, a binary, b binary, lead boolean"


def band(i, sig="sig"):
    """The key of band ``i`` (a number or column) of a signature."""
    i = i if not isinstance(i, int) else F.lit(i)
    return F.xxhash64(i.cast("int"), F.substring(F.col(sig), i * (2 * ROWS) + 1, F.lit(2 * ROWS)))


def agreeing(cell: pa.Table) -> np.ndarray:
    """Which two of a cell's signatures agree in ``AGREE`` registers."""
    sig = np.frombuffer(b"".join(cell.column(2).to_pylist()), dtype="<u2").reshape(-1, REGISTERS)
    out = np.zeros((len(sig), len(sig)), dtype=bool)
    step = max(1, (1 << 22) // (len(sig) * REGISTERS))
    for i in range(0, len(sig), step):
        out[i : i + step] = (sig[i : i + step, None, :] == sig[None, :, :]).sum(axis=2, dtype=np.int16) >= AGREE
    return out


def overlaps(bags: Bags, docs: int) -> np.ndarray:
    """Shared shingles, with multiplicity, of every two of the texts; the diagonal is zero."""
    shared = np.zeros((docs, docs), dtype=np.float32)
    # a shingle of weight w is w items: the first, the second and so on of its text
    doc, shingle = np.repeat(bags.doc, bags.weight), np.repeat(bags.shingle, bags.weight)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(bags.weight) - bags.weight, bags.weight)
    item = shingle * (int(bags.weight.max(initial=0)) + 1) + place
    order = np.argsort(item, kind="stable")
    item, doc = item[order], doc[order]
    starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]][: len(item)])
    size = np.diff(np.r_[starts, len(item)])
    each = np.repeat(size, size)
    # items of many texts by a product of matrices, the others pair by pair
    many = np.flatnonzero(each > CROWD)
    column = np.repeat(np.arange(int((size > CROWD).sum())), size[size > CROWD])
    for s in range(0, int(column[-1]) + 1 if len(column) else 0, 1024):
        at = slice(*np.searchsorted(column, [s, s + 1024]))
        has = np.zeros((docs, 1024), dtype=np.float32)
        has[doc[many[at]], column[at] - s] = 1
        shared += has @ has.T
    few = (each > 1) & (each <= CROWD)
    item, doc = item[few], doc[few]
    for d in range(1, CROWD):
        same = np.flatnonzero(item[d:] == item[:-d])
        if not len(same):
            break
        np.add.at(shared, (doc[same], doc[same + d]), 1)
        np.add.at(shared, (doc[same + d], doc[same]), 1)
    np.fill_diagonal(shared, 0)
    return shared


def similar(threshold: float) -> Callable[[pa.Table], np.ndarray]:
    """Which two of a cell's texts have weighted Jaccard similarity ``threshold`` or more, by their words."""

    def linked(cell: pa.Table) -> np.ndarray:
        n = len(cell)
        bags = Bags(utf8(cell.column(2).to_pylist()), WORDS, exact=True)
        shared = overlaps(bags, n)
        out = np.zeros((n, n), dtype=bool)
        for i in range(0, n, 256):
            both = shared[i : i + 256].astype(np.float64)
            out[i : i + 256] = both / np.maximum(1, bags.total[i : i + 256, None] + bags.total[None, :] - both) >= threshold - 1e-12
        return out

    return linked


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each key, which is the first column and by which the batches are ordered."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        starts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1]
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
            if held and key[s] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = key[s]
    if held:
        yield pa.Table.from_batches(held)


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked node and the node with most links that links lead it to."""
    np.fill_diagonal(linked, False)
    degree = linked.sum(axis=1)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rest = degree > 0
    while rest.any():
        root = int(np.where(rest, degree, 0).argmax())
        front = found = np.arange(len(degree)) == root
        while front.any():
            front = linked[front].any(axis=0) & ~found
            found = found | front
        rest = rest & ~found
        found = np.flatnonzero(found)
        left.append(found[found != root])
        right.append(np.full(len(found) - 1, root))
    return np.concatenate(left), np.concatenate(right)


def spanned(linked: Callable[[pa.Table], np.ndarray]):
    """Rows (cell, a, b, lead) of the forest of each cell, and of the cell's representative, from rows
    (cell, node, content) ordered by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, bytes, bytes, bool]] = []

        def emit() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.bool_()), strict=True)], names=["cell", "a", "b", "lead"])

        for cell in groups(batches):
            if len(cell) < 2:
                continue
            key, node = cell.column(0)[0].as_py(), cell.column(1).to_pylist()
            links = linked(cell)
            a, b = forest(links)
            if len(a):
                lead = int(links.sum(axis=1).argmax())
                rows.append((key, node[lead], node[lead], True))
                rows += [(key, node[i], node[j], False) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
            if len(rows) >= 4096:
                yield emit()
        yield emit()

    return run


def components(links: DataFrame) -> DataFrame:
    """Columns ``node`` and ``comp`` (its component's least node) for the nodes of ``links(a, b)``.

    Each round takes the least label among a node and its neighbours, then the label's own label.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        new = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = new.join(jump, "comp", "left").select("node", "old", F.least("comp", "further").alias("comp"))
        new = written(new, "labels")
        settled = new.filter("comp <> old").isEmpty()
        forget(labels)
        labels = new
        if settled:
            return labels.select("node", "comp")


def spanning(members: DataFrame, compare: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Edges (a, b) that join the nodes which links lead to each other within a group, from
    ``members(group, node, load)``, where ``load`` is the part of a block that a node fills.
    ``compare`` takes cells (cell, node) and compares all nodes of each."""
    blocks = members.groupBy("group").agg(F.ceil(F.sum("load")).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = members.join(blocks, "group").withColumn("block", block).withColumn("cell", F.xxhash64("group", "block"))
    edges = written(compare(placed.select("cell", "node")), name)
    linked = lambda: edges.filter("NOT lead").select("a", "b").distinct()
    large = kept(placed.filter("blocks > 1"))
    if large.isEmpty():
        large.unpersist()
        return linked()

    def against_all(some: DataFrame, what: str) -> DataFrame:
        """Compare some nodes of the large groups, dealt into blocks of their own, with all of their group."""
        load = some.groupBy("group").agg(F.ceil(F.sum("load")).cast("int").alias("some_blocks"))
        own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("some_blocks")).cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = some.join(load, "group").select("group", "node", own.alias("i"), upto("blocks").alias("j"))
        every = large.join(load, "group").select("group", "node", F.col("block").alias("j"), upto("some_blocks").alias("i"))
        cells = rows.unionByName(every).select(F.xxhash64("group", "i", "j", F.lit(what)).alias("cell"), "node").distinct()
        return written(compare(cells), name)

    leads = edges.filter("lead").select("cell", F.col("a").alias("node"))
    edges = edges.unionByName(against_all(large.join(leads, ["cell", "node"], "left_semi"), "leads"))
    # nodes outside the class that holds most of their group
    comp = components(linked())
    of_class = kept(large.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    sizes = of_class.groupBy("group", "comp").agg(F.count("*").alias("n"))
    most = sizes.groupBy("group").agg(F.max(F.struct("n", "comp"))["comp"].alias("most"), F.count("*").alias("classes")).filter("classes > 1")
    others = kept(of_class.join(most, "group").filter("comp <> most").select("group", "node", "load", "blocks", "block"))
    if not others.isEmpty():
        edges = edges.unionByName(against_all(others, "others"))
    for df in (large, of_class, others):
        df.unpersist()
    return linked()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``key``, ``node`` (digest of the text), ``class_id`` and ``class_node`` (the least key of the
    class and a digest of its text) and ``class_size`` (rows) for each row of ``docs``.

    Words are split at white space and compared in ASCII lower case. Equal texts are of one class, the
    null text counting as empty; texts without words have no other links. Rows that repeat are rows of
    one class. A row without a key gets its class like any other; the class id is null only if all its
    keys are. Other columns take no part.
    """
    small_batches(docs.sparkSession)
    body = F.coalesce(docs[text], F.lit(""))
    base = docs.select(docs[key].cast("bigint").alias("k"), F.unhex(F.md5(body)).alias("node"), body.alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = utf8(b.column(2).to_pylist())
            for i, j in slices([len(r) for r in raw], SLICE):
                bags = Bags(raw[i:j], WORDS)
                sig = signatures(bags, j - i).astype("<u2")
                made = [s.tobytes() if n else None for s, n in zip(sig, bags.total, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(made, pa.binary()), pa.array([len(r) for r in raw[i:j]], pa.int64())], names=["k", "node", "sig", "bytes"])

    rows = kept(base.mapInArrow(sign, "k bigint, node binary, sig binary, bytes bigint"))
    nodes = kept(rows.groupBy("node").agg(F.min("k").alias("first"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("bytes").alias("bytes")))
    signed = nodes.filter("sig IS NOT NULL").select("node", "sig")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def in_cells(rows: DataFrame, linked) -> DataFrame:
        """Rows (cell, node, content), dealt and ordered by cell, compared in each."""
        return rows.repartition(partitions, "cell").sortWithinPartitions("cell").mapInArrow(spanned(linked), EDGES)

    banded = signed.select("node", F.explode(F.array(*[band(i) for i in range(BANDS)])).alias("group"))
    shared = banded.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1").select("group")
    members = banded.join(shared, "group").withColumn("load", F.lit(1.0 / BUCKET))
    candidates = written(spanning(members, lambda cells: in_cells(cells.join(signed, "node").select("cell", "node", "sig"), agreeing), "candidates"), "candidates")

    grouped = kept(components(candidates).join(nodes.select("node", "first", "bytes"), "node"))
    forget(candidates)
    # one row of each node; the hint keeps the plan the same at every size of the groups
    here = base["k"].eqNullSafe(grouped["first"]) & (base["node"] == grouped["node"])
    texts = kept(base.join(grouped.hint("merge"), here).select(base["node"], base["text"]).dropDuplicates(["node"]))

    def by_text(cells: DataFrame) -> DataFrame:
        return in_cells(cells.join(texts, "node").select("cell", "node", "text"), similar(threshold))

    load = F.greatest(F.lit(1.0 / BLOCK), F.col("bytes") / F.lit(BLOCK_BYTES))
    links = written(spanning(grouped.select(F.col("comp").alias("group"), "node", load.alias("load")), by_text, "verified"), "links")
    for df in (grouped, texts):
        df.unpersist()

    members = nodes.select("node", "first", "copies").join(components(links), "node", "left").select("node", "first", "copies", F.coalesce("comp", "node").alias("comp"))
    # the class goes by its least key, nulls last, and that row's text
    classes = members.groupBy("comp").agg(F.min(F.struct(F.col("first").isNull().alias("last"), "first", "node")).alias("least"), F.sum("copies").alias("class_size"))
    classes = classes.select("comp", F.col("least.first").alias("class_id"), F.col("least.node").alias("class_node"), "class_size")
    known = members.join(classes, "comp").select("node", "class_id", "class_node", "class_size")
    return rows.select("k", "node").join(known, "node").select(F.col("k").alias(key), "node", "class_id", "class_node", "class_size")


def one_of_each_class(docs: DataFrame, threshold: float = THRESHOLD, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their near-duplicate class: of each class one row
    of its least key; of rows that repeat that key and text, one."""
    found = near_duplicates(docs, threshold, key=key, text=text)
    stay = found.filter(F.col(key).eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("class_node")))
    none = F.lit(-(2**63))
    stay = stay.select(F.coalesce(key, none).alias("k"), "node").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(docs[key].cast("bigint"), none).alias("k"), F.unhex(F.md5(F.coalesce(docs[text], F.lit("")))).alias("node"))
    return rows.join(stay, ["k", "node"]).dropDuplicates(["k", "node"]).select("row.*")
