"""Page sync in Structured Streaming against the batch reader."""

import random

import pytest
from pyspark.sql import Row

from tonelake.sources import containers as C
from tonelake.streaming.sync import _Sync, sync_pages

PIECES = "path string, piece long, data binary, last boolean"


def content(seed):
    r = random.Random(seed)
    packets = [(r.randbytes(r.choice([0, 10, 255, 3000, 70_000])), i * 960) for i in range(12)]
    data = bytearray(b"OggSjunk" + C.pack_stream(seed, packets) + b"x" * 50 + C.pack_stream(seed + 90, packets[:3]) + b"OggS\0")
    for _ in range(seed % 3):
        data[r.randrange(len(data))] ^= 255
    return bytes(data)


@pytest.fixture
def provider(spark):
    """The state store that the operator sets, set back for other tests."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    yield
    spark.conf.set(name, before)


def test_cut_anywhere_in_any_order(spark, tmp_path, provider):
    r = random.Random(2)
    rows = []
    for seed in range(4):
        data, at, piece = content(seed), 0, 0
        while at < len(data):
            n = r.choice([1, 30, 5000, 60_000])
            rows.append((str(seed), piece, data[at : at + n], at + n >= len(data)))
            at, piece = at + n, piece + 1
    rows += [("empty", 0, None, True), (None, 0, b"x", True)]
    r.shuffle(rows)
    rows += rows[:3]  # pieces that come again
    for i in range(3):
        spark.createDataFrame(rows[i::3], PIECES).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(PIECES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = sync_pages(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(240)
    got = [(r.path, r.page_off, r.end_off, r.skipped, bytes(r.body)) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    want = {(str(s), p.offset, p.end, p.skipped, bytes(p.body)) for s in range(4) for p in C.scan_pages(content(s))}
    assert len(got) == len(want) and set(got) == want


def test_a_silent_file_ends(spark, tmp_path, provider):
    whole = C.pack_stream(5, [(b"a" * 100, 0), (b"b", 960)])
    cut = C.build_page(9, 0, 0, 0, b"\xff" * 255, b"z" * 65025)[:300] + whole  # a page that never gets whole
    spark.createDataFrame([("x", 0, cut, False)], PIECES).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(PIECES).parquet(str(tmp_path / "in"))
    query = sync_pages(stream, idle=200).writeStream.format("memory").queryName("silent").outputMode("append").trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(60):
            if spark.table("silent").count() == 2:
                break
            query.awaitTermination(1)
        assert sorted(r.page_off for r in spark.table("silent").collect()) == [300, 300 + C.page_at(whole, 0).end]
    finally:
        query.stop()


class State(dict):
    """The state of one file, and how often it was visited."""

    visits = 0

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, key, schema):
        return self

    def _visit(self, f, *args):
        self.visits += 1
        return f(*args)

    def get(self, key=None):
        return self._visit(super().get, key)

    getValue = get

    def exists(self):
        return self._visit(self.__contains__, None)

    def containsKey(self, key):
        return self._visit(self.__contains__, key)

    def update(self, value):
        self._visit(self.__setitem__, None, value)

    def updateValue(self, key, value):
        self._visit(self.__setitem__, key, value)

    def removeKey(self, key):
        self._visit(self.pop, key, None)


@pytest.mark.parametrize("batches", [1, 2, 9])
def test_early_pieces_visit_the_state_in_blocks(batches):
    data, r = content(3), random.Random(batches)
    pieces = [Row(path="x", piece=i, data=data[at : at + 997], last=at + 997 >= len(data)) for i, at in enumerate(range(0, len(data), 997))]
    r.shuffle(pieces)
    state, sync, got = State(), _Sync(None), []
    sync.init(state)
    for i in range(batches):
        got += sync.handleInputRows(("x",), iter(pieces[i::batches]), None)
    assert [(p.page_off, p.end_off, p.skipped, p.body) for p in got] == [(p.offset, p.end, p.skipped, p.body) for p in C.scan_pages(data)]
    assert set(state) == {None} and state[None][-1] == 0  # nothing waits any more
    assert len(pieces) > 70 and state.visits <= batches * (4 + 2 * (1 + len(pieces) // 32))
