import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tonelake.llm.prefixtrie import Node, insert, prefix_trie, turn_sequences


def brute(convs):
    """Nodes of {conv_id: [(role, text), ..]}."""
    of = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            of[tuple(turns[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in of if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, who in of.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1]) if p else 0
    out = collections.Counter()
    for p, who in of.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(p))
        out[(min(who), len(p), min(of[p[:-1]]) if p else None, len(who), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def rows_of(spark, convs):
    r = random.Random(1)
    rows = [(c, i, role, text, 0, "x") for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int, depth string")


def check(spark, convs, turnless=(), **options):
    found = turn_sequences(rows_of(spark, convs))
    more = spark.createDataFrame([(c, []) for c in turnless], found.select("conv_id", "turns").schema)
    got = collections.Counter(tuple(r) for r in prefix_trie(found.unionByName(more), **options).collect())
    assert got == brute(convs | {c: [] for c in turnless})


def made(seed, n, turns=3, long=0):
    """Conversations that share first turns with others, some equal, some the beginning of others."""
    r = random.Random(seed)
    out, all_ = {}, []
    for c in r.sample(range(-50, 10 * n), n):
        old = r.choice(all_) if all_ and r.random() < 0.7 else []
        turns_ = old[: r.randrange(len(old) + 1)] + [(r.choice(["user", "bot"]), "é" * r.randrange(5)) for _ in range(r.randrange(turns))]
        if c % 17 == 0:
            turns_ += [("user", str(r.random())) for _ in range(long)]
        if turns_:
            out[c] = turns_
            all_.append(turns_)
    return out


@pytest.mark.parametrize("group_turns", [1 << 16, 40, 1])
def test_random_conversations(spark, group_turns):
    check(spark, made(2, 200, long=20), turnless=(5000, 5001, -60), group_turns=group_turns)


@pytest.mark.parametrize("group_turns", [1 << 16, 3])
def test_one_common_beginning(spark, group_turns):
    shared = [("system", f"rule {i}") for i in range(30)]
    convs = {c: shared + [("user", f"q{c % 7}"), ("bot", f"a{c}")][: c % 3] for c in range(120)}
    check(spark, convs, group_turns=group_turns)


def test_small_tables(spark):
    check(spark, {7: [("a", "b")]})
    check(spark, {7: [("a", "b")], 3: [("a", "b")]})
    check(spark, {}, turnless=(4, 2))
    assert prefix_trie(turn_sequences(rows_of(spark, {}))).collect() == []


def test_many_equal_conversations_in_chunks(spark):
    check(spark, {c: [("u", "x"), ("b", "y")] for c in [*range(4090, 4110), *range(-3, 3), 10**15]})


def test_nulls_ties_and_clashing_names(spark):
    rows = [(1, None, "u", "first"), (1, 0, None, "x"), (1, 0, "", None), (1, 0, "", None), (2, None, "u", "first"), (None, 1, "u", "gone"), (3, 5, "uf", "irst"), (4, 1, "u" * 2000, "long " * 50_000)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, turns int, key string")
    got = {r.conv_id: [(bytes(x.id), x.len) for x in r.turns] for r in turn_sequences(df).collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[1][0] == got[2][0] and [n for _, n in got[1]][0] == 5
    assert sorted(n for _, n in got[1][1:]) == [0, 0, 1] and got[3][0] != got[2][0] and got[4][0][1] == 250_000
    assert prefix_trie(turn_sequences(df).withColumn("ids", F.lit(1)).withColumn("least", F.lit(2))).filter("depth = 0").first().n_convs == 4


@pytest.mark.parametrize("children", [1, 4, 5, 16, 17, 48, 49, 256])
def test_node_layouts(children):
    order = list(range(256))
    random.Random(children).shuffle(order)
    root = Node(b"")
    for i in order[:children]:
        insert(root, bytes([i]) + b"tail", i)
    assert root.room == next(x for x in (4, 16, 48, 256) if children <= x)
    assert [getattr(root.child(i), "leaf", None) for i in range(256)] == [i if i in order[:children] else None for i in range(256)]
    assert len(root.below()) == children


def test_paths_split(spark):
    root = Node(b"")
    keys = [b"abcdef", b"abcdxy", b"ab", b"abcd", b"q", b"abcdefgh"]
    for k in keys:
        insert(root, k, k)
    found = []

    def walk(node, at):
        at += node.path
        if node.leaf:
            found.append((at, node.leaf))
        for b in range(256):
            if (x := node.child(b)) is not None:
                walk(x, at + bytes([b]))

    walk(root, b"")
    assert sorted(found) == sorted((k, k) for k in keys)
