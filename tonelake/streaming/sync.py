"""Container pages from pieces of files that arrive in a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tonelake.shipping import ship
from tonelake.sources.containers import PAGE, PageSync, page_row

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Pieces that came early are kept in blocks of so many, as each visit to the state costs more than the bytes it moves.
BLOCK = 32
PAGE_ROW = Row(*[c.split(" ")[0] for c in PAGE.split(", ")])


class _Sync(StatefulProcessor):
    """The unread tail of each file, and pieces that came before their turn. ``idle`` milliseconds without a piece end a
    file whose last piece never came."""

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tail = handle.getValueState("tail", "held binary, base bigint, good bigint, next bigint, last bigint, early bigint")
        self.early = handle.getMapState("early", "block bigint", "pieces array<bigint>, data array<binary>")

    def _feed(self, path: str, sync: PageSync, data: bytes, last: bool) -> Iterator[Row]:
        return (PAGE_ROW(*page_row(path, p).values()) for p in sync.feed(data, last))

    def _load(self) -> tuple[PageSync, int, int, int]:
        sync, found = PageSync(), self.tail.get()
        if found is None:
            return sync, 0, -1, 0
        held, sync.base, sync.good, at, last, early = found
        sync.held = bytes(held)
        return sync, at, last, early

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        sync, at, last, early = self._load()
        fresh: dict[int, bytes] = {}
        for r in rows:
            fresh[r.piece] = r.data or b""
            last = r.piece if r.last else last
        blocks: dict[int, dict[int, bytes]] = {}

        def block(b: int) -> dict[int, bytes]:
            if b not in blocks:
                found = self.early.getValue((b,)) if early else None
                blocks[b] = {p: bytes(d) for p, d in zip(*found, strict=True)} if found else {}
            return blocks[b]

        while True:
            b, run = at // BLOCK, []
            while at // BLOCK == b and (at in fresh or at in block(b)) and not (run and at - 1 == last):
                run.append(fresh.pop(at) if at in fresh else blocks[b][at])
                at += 1
            if not run:
                break
            yield from self._feed(key[0], sync, b"".join(run), at - 1 == last)
            if at // BLOCK > b and block(b):
                early -= len(blocks.pop(b))
                self.early.removeKey((b,))
        left: dict[int, dict[int, bytes]] = {}
        for piece, data in fresh.items():
            if piece > at:
                left.setdefault(piece // BLOCK, {})[piece] = data
        for b in {at // BLOCK, *left}:
            before = block(b)
            now = {p: d for p, d in (before | left.get(b, {})).items() if p > at}
            if b in left or len(now) < len(before):
                early += len(now) - len(before)
                if now:
                    self.early.updateValue((b,), (list(now), list(now.values())))
                else:
                    self.early.removeKey((b,))
        self.tail.update((sync.held, sync.base, sync.good, at, last, early))
        if self.idle and at != last + 1:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        sync, at, last, early = self._load()
        yield from self._feed(key[0], sync, b"", True)
        self.tail.update((sync.held, sync.base, sync.good, at, last, early))

    def close(self) -> None:
        pass


def sync_pages(pieces: DataFrame, idle: int | None = None) -> DataFrame:
    """One row for each good page, once it is whole, from a stream of (path, piece, data, last): pieces are numbered from 0
    within a file and may come in any order; those after a missing one wait in the state. The bytes behind the last
    good page are given up with the last piece, or after ``idle`` milliseconds without any. A piece that comes again
    counts once. Columns as ``read_pages``.
    """
    spark = pieces.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = pieces.select("path", "piece", "data", "last").filter("path IS NOT NULL AND piece IS NOT NULL")
    return rows.groupBy("path").transformWithState(_Sync(idle), PAGE, "append", "ProcessingTime" if idle else "None")
