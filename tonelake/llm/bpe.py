"""BPE encoding and decoding with a public tokenizer file.

Words of a batch are encoded together: the symbols of all new words stand in one flat array, each
round finds every word's lowest-ranked pair by binary search over the sorted pair keys, and merges
it. Words met before come from a cache. Only files of the kind ``word_bpe`` are read: NFC, white
space to one space, lower case, a splitting pattern, byte-level symbols and a mark on word ends.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import small_batches

#: Words, and bytes of words, that one worker's cache holds before it starts anew.
CACHE_WORDS, CACHE_BYTES = 400_000, 32 << 20
FAR = np.iinfo(np.int64).max


# Letters and numbers of Unicode 16 that Python's Unicode 15.1 lacks, and lower cases
# of later versions, as the library's own tables have them. Other libraries' tables may have more.
LETTERS_16 = [
    (7305, 7306), (42955, 42957), (42970, 42972), (67008, 67059), (68938, 68965), (68975, 68997), (69314, 69316), (70528, 70537), (70539, 70539), (70542, 70542), (70544, 70581),
    (70583, 70583), (70609, 70609), (70611, 70611), (72640, 72672), (78944, 82938), (90368, 90397), (93504, 93548), (101631, 101631), (124368, 124397), (124400, 124400),
]
NUMBERS_16 = [(68928, 68937), (71376, 71395), (72688, 72697), (90416, 90425), (93552, 93561), (118000, 118009), (124401, 124410)]
LOWER_17 = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Below this code point all tables agree.
AGREED = "\u0530"
RARE = re.compile(f"[{AGREED}-\U0010ffff]").search


@lru_cache(maxsize=1)
def stand_ins() -> dict[int, str]:
    """For each character that the regular expressions' tables class otherwise: one of its true class."""
    extra = {c: kind for kind, ranges in (("L", LETTERS_16), ("N", NUMBERS_16)) for a, b in ranges for c in range(a, b + 1)}
    letter, number, out = regex.compile(r"\p{L}").match, regex.compile(r"\p{N}").match, {}
    for c in range(ord(AGREED), sys.maxunicode + 1):
        ch = chr(c)
        kind = extra.get(c) or unicodedata.category(ch)[0]
        seen = "L" if letter(ch) else "N" if number(ch) else "other"
        if seen != (kind if kind in "LN" else "other"):
            out[c] = {"L": "ª", "N": "²"}.get(kind, "\ue000")
    return out


def byte_symbols() -> list[str]:
    """The printable character that byte-level BPE writes for each byte: printable Latin-1 bytes
    stand for themselves, the others follow from code point 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = np.empty(max([*vocab.values(), *self.special.values()]) + 1, dtype=object)
        for table in (vocab, self.special):
            self.tokens[list(table.values())] = list(table)
        end = model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[m[i]] for m in merges], dtype=np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.base = len(self.tokens) + 1
        keys = left * self.base + right
        # a pair that is listed twice counts by its later rank, as in the library's map
        order = np.lexsort((-np.arange(len(keys)), keys))
        first = np.r_[True, np.diff(keys[order]) != 0] if len(keys) else np.zeros(0, bool)
        order = order[first]
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        # merging all of a word's equal pairs at once is right if nothing they make merges earlier
        soonest = np.full(self.base, FAR)
        np.minimum.at(soonest, left, np.arange(len(left)))
        np.minimum.at(soonest, right, np.arange(len(right)))
        self.safe = soonest[self.made] > self.rank
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern.replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}")).findall
        self.spans = regex.compile(pattern).finditer
        # the same pattern over ASCII, for the faster engine
        self.split_ascii = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\t-\r a-z0-9]").replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]"), re.A).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self._forget()

    def _forget(self) -> None:
        self.held = 0
        self.index: dict[str, int] = {}
        self.flat: list[np.ndarray] = []
        self.parts: dict[str, str] = {}
        self.lengths: list[int] = []
        for content, i in self.special.items():
            self._keep("\0" + content, np.array([i], dtype=np.int32))

    def _keep(self, word: str, ids: np.ndarray) -> None:
        self.index[word] = len(self.flat)
        self.flat.append(ids)
        self.lengths.append(len(ids))
        self.parts[word] = " ".join(self.tokens[ids])

    def words(self, text: str) -> list[str]:
        """The words of a text; a special token stands as its content behind a NUL, which no word starts with alone."""
        if self.at_special and "<|" in text:
            out: list[str] = []
            for part in self.at_special(text):
                out += ["\0" + part] if part in self.special else self.plain(part)
            return out
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        # white space is in no word, so there is no need to reduce it first
        if text.isascii():
            return self.split_ascii(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if RARE(text):
            return self.rare(text.lower().translate(LOWER_17))
        return self.split(text.lower())

    def rare(self, text: str) -> list[str]:
        """Split by true classes: stand-ins of the same class are split, and the characters put back."""
        shown = text.translate(stand_ins())
        return [text[m.start() : m.end()] for m in self.spans(shown)]

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over the flat symbols; ``word`` says which word each belongs to, in order."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            paired = np.r_[word[1:] == word[:-1], False]
            at = np.flatnonzero(paired)
            key = symbols[at] * self.base + symbols[at + 1]
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[slot] == key
            at, slot = at[known], slot[known]
            owner = word[at]
            active = np.unique(owner)
            if len(active) < len(np.unique(word)) or not len(active):
                idle = ~np.isin(word, active)
                done.append((symbols[idle], word[idle]))
                move = np.cumsum(~idle) - 1
                symbols, word, at = symbols[~idle], word[~idle], move[at]
                if not len(symbols):
                    break
            start = np.r_[0, np.flatnonzero(np.diff(owner)) + 1]
            rank = self.rank[slot]
            best = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.r_[start, len(owner)]))
            hit = rank == best
            at, slot, owner = at[hit], slot[hit], owner[hit]
            # of overlapping pairs each second one stays; unsafe pairs merge one at a time
            joined = np.r_[False, (np.diff(at) == 1) & (owner[1:] == owner[:-1])]
            run = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
            take = (np.arange(len(at)) - run) % 2 == 0
            leading = np.r_[True, owner[1:] != owner[:-1]]
            take &= self.safe[slot] | leading
            at, slot = at[take], slot[take]
            symbols[at] = self.made[slot]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done:
            return symbols, word
        symbols, word = (np.concatenate([d[i] for d in done]) for i in (0, 1))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def learn(self, new: list[str]) -> None:
        """Encode words that the cache lacks."""
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        self.held += int(sizes.sum())
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[data[ends]]
        symbols, word = self.merge(symbols, np.repeat(np.arange(len(new)), sizes))
        cut = np.searchsorted(word, np.arange(1, len(new)))
        for w, ids in zip(new, np.split(symbols.astype(np.int32), cut), strict=True):
            self._keep(w, ids)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Offsets, flat ids and decoded texts. A missing text counts as empty."""
        if len(self.index) > CACHE_WORDS or self.held > CACHE_BYTES:
            self._forget()
        split = [self.words(t) if t else [] for t in texts]
        new = list({w for ws in split for w in ws if w not in self.index})
        if new:
            self.learn(new)
        index, parts = self.index, self.parts
        decoded = [" ".join([parts[w] for w in ws]) for ws in split]
        which = np.array([index[w] for ws in split for w in ws], dtype=np.int64)
        per_doc = np.array([len(ws) for ws in split], dtype=np.int64)
        used, inverse = np.unique(which, return_inverse=True)
        lengths = np.array([self.lengths[i] for i in used], dtype=np.int64)
        pool = np.concatenate([self.flat[i] for i in used]) if len(used) else np.zeros(0, np.int32)
        starts = np.cumsum(lengths) - lengths
        n = lengths[inverse] if len(used) else np.zeros(0, np.int64)
        before = np.cumsum(n) - n
        flat = pool[np.arange(int(n.sum())) + np.repeat((starts[inverse] if len(used) else n) - before, n)]
        ends = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(per_doc)]]
        return ends, flat, decoded

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by one space, as the library does for a file without a decoder; unknown ids are left out."""
        return " ".join(self.tokens[i] for i in ids if 0 <= i < len(self.tokens) and self.tokens[i] is not None)


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """One encoder for each worker and file."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def bpe_encode(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``key``, ``ids`` (array of int) and ``decoded`` for each row of ``docs``.

    Null and empty texts give no ids and an empty decoded text; equal rows give equal rows; other
    columns, whatever their names, take no part. ``path`` must be readable where the workers run.
    """
    small_batches(docs.sparkSession)
    kind = next(f.dataType.simpleString() for f in docs.schema if f.name == key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            ends, flat, decoded = bpe.encode_batch(b.column(1).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(decoded, pa.string())], names=[key, "ids", "decoded"])

    return docs.select(docs[key], docs[text]).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Per row: the count of ids and digests of the ids and of the decoded text."""
    return encoded.select(
        F.col(key),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
