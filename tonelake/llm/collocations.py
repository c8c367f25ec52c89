"""Collocations by counting tries over windows of words, each built from a share of all texts.

1. Words are counted in Spark; those of ``least`` occurrences or more get numbers, by falling frequency, and every text
   is written as the numbers of its words. A word that is rarer breaks a text as a stop does: no phrase with it can be
   a candidate.
2. At each word begins a window of up to four. Windows are sorted and counted in slices of texts, and dealt to tries by
   their first two words, in one shuffle. A word of more than ``TRIE_PHRASES`` occurrences is hot: windows that begin
   with two or three hot words are dealt by a word more, and what they count above that goes its own way, once for each
   slice. So no key has more than ``TRIE_PHRASES`` windows and slices, whatever a language repeats.
3. A trie is its windows in order: a node is a run with the same beginning, and its count is the run's. Runs below
   ``least`` are left out before the next level is looked at.

All texts are read twice, however many candidates there are. Only the numbers of the words go to all tasks, ``WORDS``
at a time; beyond that texts are read once more for each ``WORDS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonelake.llm.common import forget, slices, small_batches, written
from tonelake.llm.wordhash import LOWER, mix, utf8

#: Longest phrase, in words.
LONGEST = 4
#: Words that are broadcast at once to number texts, and windows of one trie.
WORDS, TRIE_PHRASES = 1 << 20, 1 << 20
#: Bytes of text that a worker handles at once.
SLICE = 1 << 23
#: Windows of slices that are held before they are packed, so that tries don't get a small row from each slice.
HELD = 1 << 20
#: Parts that a language's phrases are ranked in before all of its first ones are.
RANK_PARTS = 32
#: What a byte is: 0 of a word, 1 blank, 2 the end of a piece.
KIND = np.zeros(256, np.uint8)
KIND[[9, 32]] = 1
KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2
IDS = [f"w{i + 1}" for i in range(LONGEST)]
#: Mask of the lower of two words in a number, and what a window's row in a shuffle has: its words and its count.
LOW, ROW = (1 << 32) - 1, LONGEST + 1


def word_arrays(raw: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts, the number of each word's piece, and where it begins in the texts joined by one byte."""
    joined = b"\n" + b"\n".join(raw) + b"\n"
    buf, kind = (np.frombuffer(joined.translate(bytes(x)), np.uint8) for x in (LOWER, KIND))
    inside = kind == 0
    at = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = at[::2], at[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buf[inside])])
    return words, np.cumsum(kind == 2, dtype=np.int32)[starts], starts - 1


def by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, str, list[bytes]]]:
    """Runs of rows of one language, from as many batches as make a slice: the rows, the language, the texts. Columns are lang and text at first."""

    def runs(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held)
        for lang in pc.unique(table.column(0)).to_pylist():
            rows = table.filter(pc.equal(table.column(0), lang))
            raw = utf8(rows.column(1).to_pylist())
            for i, j in slices([len(r) for r in raw], SLICE):
                yield rows.slice(i, j - i), lang, raw[i:j]

    held, total = [], 0
    for b in batches:
        held.append(b)
        total += b.column(1).nbytes
        if total >= SLICE:
            yield from runs(held)
            held, total = [], 0
    if held:
        yield from runs(held)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts; a row without a word has the count of all."""
    for _, lang, raw in by_lang(batches):
        words = word_arrays(raw)[0]
        found = words.value_counts()
        word = pa.concat_arrays([found.field(0).cast(pa.string()), pa.nulls(1, pa.string())])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(word), pa.string()), word, pa.array(np.r_[found.field(1).to_numpy(), len(words)])], names=["lang", "word", "f"])


def codes_of(rows: pa.Table, lang: str, raw: list[bytes], known: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words of one language's texts, from a block {lang: (words, numbers)} or from ``codes`` of blocks before, -1 for other
    words; the words' pieces, and where they begin."""
    words, piece, starts = word_arrays(raw)
    block, numbers = known.get(lang, (pa.array([], pa.binary()), np.zeros(0, np.int32)))
    at = pc.index_in(words, value_set=block).fill_null(-1).to_numpy(zero_copy_only=False)
    codes = np.r_[numbers, -1].astype(np.int32)[at]
    if rows.num_columns > 2:
        codes = np.maximum(codes, np.frombuffer(b"".join(rows.column(2).to_pylist()), np.int32))
    return codes, piece, starts


def number_words(block):
    """Texts with the numbers of the words of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, lang, raw in by_lang(batches):
            codes, _, starts = codes_of(rows, lang, raw, block.value)
            ends = np.cumsum([len(r) + 1 for r in raw])
            offsets = np.r_[0, np.searchsorted(starts, ends)].astype(np.int32) * 4
            out = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(codes)])
            yield from pa.table([rows.column(0), rows.column(1), out], names=["lang", "text", "codes"]).to_batches(max_chunksize=256)

    return run


def windows(codes: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of two words or more, in order and each once, as numbers of their first and last two words (a word is its number
    and 1, or 0 for none), and their counts."""
    x = np.r_[codes.astype(np.int64) + 1, 0, 0]
    tied = np.r_[piece[1:] == piece[:-1], False, False, False][: len(x)]
    behind = np.where(tied[:-1], x[1:], 0)
    pairs, rank = np.unique(x[:-1] << 32 | behind, return_inverse=True)
    begins = np.flatnonzero((x[:-1] > 0) & (behind > 0))
    # pairs as their ranks, so that a window is one number that sorts fast
    tail = np.where(behind[begins + 1] > 0, rank[begins + 2 - (begins + 2 >= len(rank))] + 1, 0)
    tail[x[begins + 1] == 0] = 0
    key = np.sort(rank[begins] << 32 | tail)
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    key, n = key[at], np.diff(np.r_[at, len(key)])
    return pairs[key >> 32], np.r_[0, pairs][key & LOW], n


def dealt(first: np.ndarray, last: np.ndarray, n: np.ndarray, hot: int, tries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows (in order) with their tries: trie, depth, first, last, n. ``depth`` is the words they are dealt by, and the least length
    of the phrases that they count. Numbers below ``hot`` are hot."""
    second = (first >> 32 <= hot) & (first & LOW <= hot)
    third = second & (last > 0) & (last >> 32 <= hot)
    whole = ~second | (last > 0)
    depth = 2 + second + third
    rows = [(depth[whole], first[whole], last[whole], n[whole])]
    for d, own in ((2, second), (3, third)):
        if own.any():  # what is counted above the words that these windows are dealt by
            f, z, m = first[own], (last[own] >> 32 << 32) * (d == 3), n[own]
            at = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (z[1:] != z[:-1])])
            rows.append((np.full(len(at), d), f[at], z[at], np.add.reduceat(m, at)))
    depth, first, last, n = map(np.concatenate, zip(*rows, strict=True))
    by = np.where(depth > 3, last, np.where(depth > 2, last >> 32, 0))
    trie = (mix(mix(first.astype(np.uint64)) + by.astype(np.uint64)) >> np.uint64(1)).astype(np.int64) % tries
    return trie, depth, first, last, n


def packed(trie: np.ndarray, depth: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row for each trie and depth, with its windows as bytes of like weight, compressed."""
    place = trie * LONGEST + depth - 1
    order = np.argsort(place.astype(np.uint16) if place.max(initial=0) < 1 << 16 else place, kind="stable")
    place, first, last = place[order], first[order], last[order]
    at = np.flatnonzero(np.r_[True, place[1:] != place[:-1]][: len(place)])
    head = first >> 32
    step = np.diff(head, prepend=0)
    step[at] = head[at]
    planes = np.stack([step, first & LOW, last >> 32, last & LOW, n[order]], dtype=np.int32, casting="unsafe").view(np.uint8).reshape(ROW, -1, 4).transpose(0, 2, 1).copy()
    size = np.diff(np.r_[at, len(place)])
    data = [pa.compress(planes[:, :, i : i + m].tobytes(), codec="zstd", asbytes=True) for i, m in zip(at.tolist(), size.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array((place[at] // LONGEST).astype(np.int32)), pa.array((place[at] % LONGEST + 1).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(data, pa.binary())], names=["trie", "depth", "size", "data"])


def unpacked(size: int, data: bytes) -> np.ndarray:
    """The rows of ``packed``: first, last, n."""
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * ROW * size, codec="zstd"), np.uint8).reshape(ROW, 4, size)
    step, second, third, fourth, n = planes.transpose(0, 2, 1).copy().view(np.int32)[:, :, 0].astype(np.int64)
    return np.stack([np.cumsum(step) << 32 | second, third << 32 | fourth, n])


def deal_windows(block, hot: int, tries: int):
    """The windows of texts, packed by trie, from the numbers of the last block of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for rows, lang, raw in by_lang(batches):
            codes, piece, _ = codes_of(rows, lang, raw, block.value)
            held.append(dealt(*windows(codes, piece), hot, tries))
            total += len(held[-1][0])
            if total >= HELD:
                yield packed(*map(np.concatenate, zip(*held, strict=True)))
                held, total = [], 0
        if total:
            yield packed(*map(np.concatenate, zip(*held, strict=True)))

    return run


def nodes(depth: int, first: np.ndarray, last: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The nodes of a trie from ``depth`` on that count ``least`` or more: their depth, first and last words, and counts."""
    order = np.lexsort((last, first))
    first, last, n = first[order], last[order], n[order]
    for d in range(depth, LONGEST + 1):
        z = last >> 32 << 32 if d == 3 else last
        reach = z > 0 if d == 3 else z & LOW > 0 if d > 3 else np.ones(len(z), bool)
        first, last, n, z = first[reach], last[reach], n[reach], z[reach] * (d > 2)
        if not len(n):
            return
        at = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (z[1:] != z[:-1])])
        count = np.add.reduceat(n, at)
        good = count >= least
        yield d, first[at[good]], z[at[good]], count[good]
        stays = np.repeat(good, np.diff(np.r_[at, len(n)]))
        first, last, n = first[stays], last[stays], n[stays]


def count_tries(facts, least: int):
    """The phrases of tries that come one behind the other: w1 .. w4 (-1 for none), a, and of their first and last word how often they occur, and the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, lang, langs = facts.value

        def found(depth: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for d, first, last, count in nodes(depth, *np.concatenate(held, axis=1), least):
                ids = np.stack([first >> 32, first & LOW, last >> 32, last & LOW]).astype(np.int32) - 1
                columns = [*(pa.array(x) for x in ids), pa.array(count), pa.array(f[ids[0]]), pa.array(f[ids[d - 1]]), langs.take(pa.array(lang[ids[0]]))]
                yield pa.RecordBatch.from_arrays(columns, names=[*IDS, "a", "head", "tail", "lang"])

        held, key = [], None
        for b in batches:
            for trie, depth, size, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (trie, depth) != key and held:
                    yield from found(key[1], held)
                    held = []
                key = trie, depth
                held.append(unpacked(size, data))
        if held:
            yield from found(key[1], held)

    return run


class DoubleArray:
    """A trie over numbers as two arrays: the child of ``s`` by ``w`` is ``base[s] + w`` if ``check`` there is ``s``.
    State 0 is the root and -1 none. ``levels[d]`` has the phrases of ``d + 1`` words, a row each; of each row all but
    the last number must be a row of the level before. ``states[d]`` are their states."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.states = levels, []
        self.width = 1 + max((int(x.max()) for x in levels if len(x)), default=0)
        self.base, self.check = np.zeros(1, np.int64), np.full(1, -1, np.int64)
        self.used = np.ones(1, dtype=bool)
        parent = np.zeros(len(levels[0]), np.int64)
        for d, rows in enumerate(levels):
            if d:
                parent = np.zeros(len(rows), np.int64)
                for column in rows.T[:-1]:
                    parent = self.step(parent, column)
            self.states.append(self._place(parent, rows[:, -1].astype(np.int64)))
        del self.used

    def _grow(self, size: int) -> None:
        more = size - len(self.used)
        if more > 0:
            more = max(more, len(self.used) // 2)
            self.used = np.r_[self.used, np.zeros(more, bool)]
            self.base = np.r_[self.base, np.zeros(more, np.int64)]
            self.check = np.r_[self.check, np.full(more, -1, np.int64)]

    def _place(self, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """States for the children, most of a parent first; only children are looked for a common base for."""
        out = np.zeros(len(parent), np.int64)
        order = np.lexsort((word, parent))
        at = np.flatnonzero(np.r_[True, np.diff(parent[order]) != 0][: len(order)])
        size = np.diff(np.r_[at, len(order)])
        low, of = 1, 0
        for g in np.argsort(-size, kind="stable")[: int((size > 1).sum())].tolist():
            rows = order[at[g] : at[g] + size[g]]
            kids = word[rows]
            if 2 * size[g] <= of or not of:
                low, of = 1, int(size[g])
            tries = 64
            while True:  # bases whose first child would be at a free place from ``low`` on
                self._grow(low + tries + self.width + 1)
                free = low + np.flatnonzero(~self.used[low : low + tries])
                good = np.flatnonzero(~self.used[(free - kids[0])[:, None] + kids].any(axis=1))
                if len(good):
                    base = int(free[good[0]] - kids[0])
                    break
                low, tries = low + tries, min(2 * tries, max(64, (1 << 18) // int(size[g])))
            out[rows] = base + kids
            self.used[base + kids] = True
        single = order[at[size == 1]]
        if len(single):
            self._grow(len(self.used) + max(0, len(single) - int((~self.used).sum())))
            out[single] = np.flatnonzero(~self.used)[: len(single)]
            self.used[out[single]] = True
        self.base[parent] = out - word
        self.check[out] = parent
        return out

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        at = self.base[state] + word
        at[(at < 0) | (at >= len(self.check)) | (state < 0) | (word < 0)] = 0
        return np.where(self.check[at] == state, at, -1)


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 30, keep: int = 2000, words_at_once: int = WORDS, trie_phrases: int = TRIE_PHRASES) -> DataFrame:
    """Columns lang, rank, phrase, a, l, r, n, score: each language's first ``keep`` phrases of 2 to 4 words by score.

    A null text is empty, a null language ``und``. Rows that repeat count as often as they occur. Ties in the score go to
    the more frequent phrase, then to the lesser one in UTF-8. Other columns take no part; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text], F.lit("")).alias("text"))
    counted = base.mapInArrow(count_words, "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    some = written(counted.filter((F.col("f") >= least) | F.col("word").isNull()), "words")
    totals = some.filter("word IS NULL").select("lang", F.col("f").alias("n"))
    words = numbered(some.filter("word IS NOT NULL"))
    given, occurrences = words.count(), totals.agg(F.sum("n")).first()[0] or 0
    if not given:
        return spark.createDataFrame([], "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")

    hot = words.filter(F.col("f") > trie_phrases).count()
    tries = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-occurrences // trie_phrases))
    coded, broadcasts, before, f, of, langs = base, [], [], [], [], [r[0] for r in totals.select("lang").orderBy("lang").collect()]
    for start in range(0, given, words_at_once):  # a block of bounded size at a time
        table = words.filter(F.col("id").between(start, start + words_at_once - 1)).toArrow().sort_by("id")
        own = pc.index_in(table.column("lang").combine_chunks(), value_set=pa.array(langs)).to_numpy()
        f.append(table.column("f").to_numpy())
        of.append(own.astype(np.int32))
        text_of, number = table.column("word").combine_chunks().cast(pa.binary()), table.column("id").to_numpy()
        broadcasts.append(block := spark.sparkContext.broadcast({langs[x]: (text_of.take(pa.array(np.flatnonzero(own == x))), number[own == x]) for x in np.unique(own)}))
        if start + words_at_once < given:
            coded = written(coded.mapInArrow(number_words(block), "lang string, text string, codes binary"), "codes")
            before.append(coded)
    broadcasts.append(facts := spark.sparkContext.broadcast((np.concatenate(f), np.concatenate(of), pa.array(langs))))
    shares = coded.mapInArrow(deal_windows(block, hot, tries), "trie int, depth int, size int, data binary").repartitionById(tries, "trie").sortWithinPartitions("trie", "depth")
    phrases = written(shares.mapInArrow(count_tries(facts, least), ", ".join(f"{w} int" for w in IDS) + ", a bigint, head bigint, tail bigint, lang string"), "phrases")
    for x in broadcasts:
        x.unpersist()
    for x in before:
        forget(x)
    return first_ones(phrases, words.select("id", "lang", "word"), totals, keep)


def numbered(words: DataFrame) -> DataFrame:
    """Words with numbers without gaps from 0, by falling frequency: id, lang, word, f."""
    high, low = F.shiftright("place", 33).cast("int"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(words.orderBy(F.desc("f"), "lang", "word").withColumn("place", F.monotonically_increasing_id()), "placed")
    sizes = dict(placed.groupBy(high.alias("part")).count().collect())
    starts = np.r_[0, np.cumsum([sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)])].tolist()
    return placed.select((F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), high + 1) + low).cast("int").alias("id"), "lang", "word", "f")


def ranked(phrases: DataFrame, words: DataFrame, totals: DataFrame, keep: int) -> DataFrame:
    """The result from all phrases (p, f), single words among them, where ``p`` are numbers of words."""
    single = phrases.filter(F.size("p") == 1).select(F.col("p")[0].alias("id"), "f")
    ids = [F.coalesce(F.get("p", F.lit(i)), F.lit(-1)).alias(w) for i, w in enumerate(IDS)]
    many = phrases.filter(F.size("p") > 1).select(*ids, F.col("f").alias("a"), F.element_at("p", -1).alias("end"))
    many = many.join(single.select(F.col("id").alias("w1"), F.col("f").alias("head")), "w1").join(single.select(F.col("id").alias("end"), F.col("f").alias("tail")), "end")
    return first_ones(many.join(words.select(F.col("id").alias("w1"), "lang"), "w1"), words, totals, keep)


def first_ones(many: DataFrame, words: DataFrame, totals: DataFrame, keep: int) -> DataFrame:
    """The result from all phrases of two words and more: w1 .. w4 (-1 for none), a, counts ``head`` and ``tail`` of the first and the last word, lang."""
    small, wide = F.greatest("a", "head", "tail") < 1 << 42, lambda c: c.cast("decimal(20,0)")

    def cut(k: int, l: str, r: str):  # noqa: E741
        exact = F.expr(f"(CAST(a AS DECIMAL(20,0)) * 2000000) div (CAST({l} AS DECIMAL(20,0)) + CAST({r} AS DECIMAL(20,0)))")
        return F.struct(F.when(small, F.expr(f"(a * 2000000) div ({l} + {r})")).otherwise(exact).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))

    levels = {2: many.filter("w3 < 0"), 3: many.filter("w3 >= 0 AND w4 < 0"), 4: many.filter("w4 >= 0")}
    found = []
    for m, level in levels.items():
        cuts = [("head" if k == 1 else f"l{k}", "tail" if k == m - 1 else f"r{k}") for k in range(1, m)]
        for k in range(1, m):  # the parts of two words or more
            for n, name, on in ((k, f"l{k}", IDS[:k]), (m - k, f"r{k}", IDS[k:m])):
                if n > 1:
                    level = level.join(levels[n].select(*[F.col(w).alias(o) for w, o in zip(IDS, on, strict=False)], F.col("a").alias(name)), on)
        level = level.select(*IDS, "a", "lang", F.array_min(F.array(*[cut(k + 1, *c) for k, c in enumerate(cuts)])).alias("cut"))
        if m < LONGEST:  # the most frequent phrase of a word more around each; one of two words more is no more frequent
            over = levels[m + 1]
            around = over.select(*IDS[:m], "a").unionAll(over.select(*[F.col(w).alias(o) for w, o in zip(IDS[1:], IDS[:m], strict=False)], "a")).groupBy(*IDS[:m]).agg(F.max("a").alias("longer"))
            level = level.join(around, IDS[:m], "left").filter(F.col("longer").isNull() | (wide(F.col("longer")) * 100 < wide(F.col("a")) * 80))
        found.append(level.select(*IDS, "a", "lang", "cut.*"))
    order = [F.desc("score"), F.desc("a")]
    # only the first of a language and those that tie with the last of them are spelt out
    best = reduce(DataFrame.unionByName, found).withColumn("part", F.pmod(F.xxhash64(*IDS), F.lit(RANK_PARTS)))
    for by in (["lang", "part"], ["lang"]):
        best = best.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= keep)
    each = best.select("lang", "a", "l", "r", "score", F.array(*IDS).alias("p")).select("*", F.posexplode("p").alias("i", "id")).filter("id >= 0").join(words.select("id", "word"), "id")
    named = each.groupBy("lang", "p", "a", "l", "r", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    last = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).filter(F.col("rank") <= keep)
    return last.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
