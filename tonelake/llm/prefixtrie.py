"""The trie of conversations by their first turns, built from adaptive radix trees.

A turn's id is the 16 bytes of a digest of its role and text, and a conversation's key is its ids joined. An
adaptive radix tree branches over single bytes: a node has room for 4, 16, 48 or 256 children and is laid out
anew as it fills, and bytes that all keys below share are one compressed path. Only byte depths that are
a multiple of ``WIDTH`` are turns and emit nodes, those inside a compressed path too.

No task holds the whole trie. Equal conversations are one key with a count. Keys are grouped by the turn at which they
leave the top, which at first is the root; a group of at most ``group_turns`` turns (or of a single key) is
one radix tree in one task. A larger group becomes a part of the top: the least and the greatest of its
keys tell how far all its keys agree, that path is compressed, and its keys are grouped anew by the turn
behind it. Counts of the top are sums over the groups below, in Spark, from the deepest to the root.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import small_batches, written

#: Bytes of a turn's id.
WIDTH = 16
#: Turns of the keys that one radix tree holds at most.
GROUP_TURNS = 1 << 16
#: Numbers of conversations that are joined into one row of members.
CHUNK = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


class Node:
    """A node of the radix tree. ``path`` are the bytes between its parent's branch and its own, ``leaf`` the key that ends
    here. Up to 16 children stand in the order of ``bytes_``, up to 48 are found by an index of 256, and
    beyond that their place is the byte."""

    __slots__ = ("path", "leaf", "room", "bytes_", "index", "children")

    def __init__(self, path: bytes, leaf=None):
        self.path, self.leaf = path, leaf
        self.room, self.bytes_, self.index, self.children = 4, bytearray(), None, []

    def child(self, byte: int) -> Node | None:
        if self.room <= 16:
            i = bisect_left(self.bytes_, byte)
            return self.children[i] if i < len(self.bytes_) and self.bytes_[i] == byte else None
        if self.room == 48:
            return self.children[self.index[byte]] if self.index[byte] < 255 else None
        return self.children[byte]

    def put(self, byte: int, node: Node) -> None:
        """A child where there is none, or in place of the one there."""
        if self.room <= 16:
            i = bisect_left(self.bytes_, byte)
            if i < len(self.bytes_) and self.bytes_[i] == byte:
                self.children[i] = node
                return
            if len(self.bytes_) < self.room:
                self.bytes_.insert(i, byte)
                self.children.insert(i, node)
                return
        elif self.room == 256 or self.index[byte] < 255:
            self.children[byte if self.room == 256 else self.index[byte]] = node
            return
        elif len(self.children) < 48:
            self.index[byte] = len(self.children)
            self.children.append(node)
            return
        self._grow()
        self.put(byte, node)

    def _grow(self) -> None:
        if self.room == 4:
            self.room = 16
        elif self.room == 16:
            self.room, self.index = 48, bytearray(b"\xff" * 256)
            for i, byte in enumerate(self.bytes_):
                self.index[byte] = i
            self.bytes_ = None
        else:
            self.room, self.children = 256, [self.children[i] if i < 255 else None for i in self.index]
            self.index = None

    def below(self) -> list[Node]:
        return self.children if self.room < 256 else [x for x in self.children if x is not None]


def insert(root: Node, key: bytes, leaf) -> None:
    """Put a key that isn't there yet."""
    parent, byte, node, at = None, 0, root, 0
    while True:
        path = node.path
        if not key.startswith(path, at):  # split the path where the key leaves it
            n = 0
            while n < len(path) and at + n < len(key) and path[n] == key[at + n]:
                n += 1
            upper = Node(path[:n])
            node.path = path[n + 1 :]
            upper.put(path[n], node)
            parent.put(byte, upper)  # the root's path is empty and never splits
            node = upper
        at += len(node.path)
        if at == len(key):
            node.leaf = leaf
            return
        parent, byte, below = node, key[at], node.child(key[at])
        at += 1
        if below is None:
            node.put(byte, Node(key[at:], leaf))
            return
        node = below


class Below:
    """What the trie below a place holds: its topmost turns, which wait for their parent's least member; members, least member,
    childless nodes, saved tokens, and one of its keys' lengths of texts."""

    __slots__ = ("tops", "n", "least", "leaves", "saved", "lens")

    def __init__(self, n: int = 0, least=None, lens=None):
        self.tops: list[tuple] = []
        self.n, self.least, self.lens, self.leaves, self.saved = n, least, lens, 0, 0

    def add(self, other: Below) -> None:
        self.tops += other.tops
        self.n += other.n
        self.leaves += other.leaves
        self.saved += other.saved
        self.least = other.least if self.least is None else min(self.least, other.least)
        self.lens = other.lens


def turns(root: Node, depth: int, parent: int) -> Iterator[tuple]:
    """The trie's nodes below a root at ``depth`` turns, children first: (depth, least member, the parent's, members,
    children, leaves, saved, digest of the ends). ``parent`` is the root's least member. A leaf is (members,
    least member, digest, lengths of texts)."""
    stack = [(root, depth * WIDTH, False, Below(), Below())]
    while stack:
        node, at, done, here, up = stack.pop()
        if not done:
            stack.append((node, at, True, here, up))
            stack += [(x, at + 1 + len(x.path), False, Below(), here) for x in node.below()]
            continue
        if node is root:
            yield from (x[:2] + (parent, *x[2:]) for x in here.tops)
            return
        ends = EMPTY
        if node.leaf:
            n, least, ends, lens = node.leaf
            here.add(Below(n, least, lens))
        for d in range(at // WIDTH, (at - len(node.path) - 1) // WIDTH, -1):  # the turns on the node's path
            below, here.tops = here.tops, []
            yield from (x[:2] + (here.least, *x[2:]) for x in below)
            here.saved += (here.n - 1) * here.lens[d - 1]
            here.leaves += not below
            here.tops.append((d, here.least, here.n, len(below), here.leaves, here.saved, ends if d * WIDTH == at else EMPTY))
        up.add(here)


NODE = pa.schema([("parent", pa.binary()), ("top", pa.bool_()), ("depth", pa.int64()), *[(k, pa.int64()) for k in ("least", "parent_least", "n", "children", "leaves", "saved")], ("ends", pa.string())])
NODES = "parent binary, top boolean, depth bigint, least bigint, parent_least bigint, n bigint, children bigint, leaves bigint, saved bigint, ends string"


def _in_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, 1 << 13)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), NODE.types, strict=True)], schema=NODE)


def radix_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each group of keys, from rows (group, parent, parent_least, depth, ids, lens, n, least, ends) ordered by
    group. ``depth`` turns lie above the group."""

    def of_group(tree: Node, parent: bytes, least: int, depth: int) -> Iterator[pa.RecordBatch]:
        return _in_batches((parent, x[0] == depth + 1, *x) for x in turns(tree, depth, least))

    tree, group, about = Node(b""), None, ()
    for b in batches:
        for g, parent, parent_least, depth, ids, lens, n, least, ends in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if g != group:
                if group is not None:
                    yield from of_group(tree, *about)
                tree, group, about = Node(b""), g, (parent, parent_least, depth)
            insert(tree, b"".join(ids[depth:]), (n, least, ends, lens))
    if group is not None:
        yield from of_group(tree, *about)


def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of the top's compressed paths, from rows (parent, parent_least, low, high, lens, least, n, children,
    leaves, saved, ends): depths ``low`` to ``high``, and what is below the last."""
    for b in batches:
        for parent, parent_least, low, high, lens, least, n, children, leaves, saved, ends in zip(*[c.to_pylist() for c in b.columns], strict=True):

            def path() -> Iterator[tuple]:
                total = saved
                for d in range(high, low - 1, -1):
                    total += (n - 1) * lens[d - 1] if d else 0
                    last = d == high
                    yield parent, d == low, d, least, parent_least if d == low else least, n, children if last else 1, leaves or 1, total, ends if last else EMPTY

            yield from _in_batches(path())


def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each key with its count, least member and the digest of its members, from rows (key, chunk, joined, n, least, ids, lens)
    ordered by key and chunk. Of a key's members only one chunk is held."""
    names = ["ids", "lens", "n", "least", "ends"]
    types = [pa.list_(pa.binary()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()]
    key = state = None
    for b in batches:
        out = []
        for k, _, joined, n, least, ids, lens in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if k != key:
                if key is not None:
                    out.append((*about, total, first, state.hexdigest()))
                key, state, about, total, first = k, hashlib.sha256(), (ids, lens), 0, least
            state.update(("," * (total > 0) + joined).encode())
            total += n
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*about, total, first, state.hexdigest()), types, strict=True)], names=names)


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) from rows (conv_id, turn, role, text): ``turns`` is an array of (id, len), by turn, null first.

    A null role or text is empty. Turns of the same number go by their ids; rows that repeat are turns of their
    own. Rows without a conv_id belong to no conversation. Other columns take no part. A conversation is one row, of 20
    bytes a turn.
    """
    role, text = (F.coalesce(conversations[c], F.lit("")) for c in ("role", "text"))
    turn = F.struct(conversations["turn"].alias("turn"), digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("id"), F.length(text).alias("len"))
    found = conversations.filter(conversations["conv_id"].isNotNull()).select(conversations["conv_id"].alias("conv_id"), turn.alias("turn"))
    return found.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("turn")), lambda x: F.struct(x["id"].alias("id"), x["len"].alias("len"))).alias("turns"))


def digest(text):
    return F.unhex(F.md5(text))


def _key(ids):
    return digest(F.array_join(F.transform(ids, F.hex), ""))


def prefix_trie(sequences: DataFrame, *, group_turns: int = GROUP_TURNS) -> DataFrame:
    """The trie's nodes, from rows (conv_id, turns) with one row for each conversation: conv_id (least member), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation without turns is a member of the root alone. An empty table has no node, not even the root. Other
    columns take no part.
    """
    small_batches(sequences.sparkSession)
    keyed = sequences.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.len").alias("lens"))
    keyed = keyed.select("*", _key(F.col("ids")).alias("key"), F.shiftright("conv_id", CHUNK.bit_length() - 1).alias("chunk"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = keyed.groupBy("key", "chunk").agg(joined.alias("joined"), F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("ids").alias("ids"), F.first("lens").alias("lens"))
    in_order = chunks.select("key", "chunk", "joined", "n", "least", "ids", "lens").repartition("key").sortWithinPartitions("key", "chunk")
    keys = written(in_order.mapInArrow(members, "ids array<binary>, lens array<int>, n bigint, least bigint, ends string"), "keys")

    root = F.lit(b"").alias("group"), F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("bigint").alias("parent_least"), F.lit(-1).cast("bigint").alias("depth")
    rest = keys.select(*root, "ids", "lens", "n", "least", "ends")
    lights: list[DataFrame] = []
    tops: list[DataFrame] = []
    ended: list[DataFrame] = []
    while True:
        found = rest.groupBy("group").agg(
            F.first("parent").alias("parent"), F.first("parent_least").alias("parent_least"), F.first("depth").alias("depth"), F.count("*").alias("keys"), F.sum(F.size("ids") - F.col("depth")).alias("turns"),
            F.sum("n").alias("n"), F.min("least").alias("least"), F.min(F.struct("ids", "lens")).alias("low"), F.max("ids").alias("high"),
        )
        large = ((F.col("turns") > group_turns) & (F.col("keys") > 1)) | (F.col("depth") < 0)
        leaves_at = F.array_position(F.zip_with("low.ids", "high", lambda x, y: x.eqNullSafe(y)), False)
        branch = F.when(leaves_at == 0, F.size("high").cast("long")).otherwise(leaves_at - 1)
        groups = written(found.select("group", "parent", "parent_least", "depth", "n", "least", F.col("low.lens").alias("lens"), branch.alias("branch"), large.alias("large")), "groups")
        light = rest.join(groups.filter("NOT large").select("group"), "group")
        light = light.select("group", "parent", "parent_least", "depth", "ids", "lens", "n", "least", "ends").repartition("group").sortWithinPartitions("group")
        lights.append(written(light.mapInArrow(radix_trees, NODES), "nodes"))
        top = groups.filter("large")
        if top.isEmpty():
            break
        tops.append(top)
        down = written(rest.join(top.select("group", "branch", F.col("least").alias("above")), "group"), "rest")
        ended.append(down.filter(F.size("ids") == F.col("branch")).select("group", "ends"))
        group = _key(F.slice("ids", 1, (F.col("branch") + 1).cast("int")))
        rest = down.filter(F.size("ids") > F.col("branch")).select(group.alias("group"), F.col("group").alias("parent"), F.col("above").alias("parent_least"), F.col("branch").alias("depth"), "ids", "lens", "n", "least", "ends")
    nodes = [lights.pop()]
    while tops:
        below = nodes[-1].filter("top").groupBy(F.col("parent").alias("group")).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        path = tops.pop().join(below, "group", "left").join(ended.pop(), "group", "left")
        none = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("children", "leaves", "saved")]
        path = path.select("parent", "parent_least", F.greatest(F.col("depth") + 1, F.lit(0)).alias("low"), "branch", "lens", "least", "n", *none, F.coalesce("ends", F.lit(EMPTY)).alias("ends"))
        nodes.append(written(path.mapInArrow(chains, NODES), "tops").unionByName(lights.pop()))
    out = reduce(DataFrame.unionByName, nodes)
    return out.select(F.col("least").alias("conv_id"), "depth", F.col("parent_least").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
