"""Container pages, packets and corpora: round trips, damage and file reading."""

import random

from tonelake.sources import containers as C


def stream(serial, n, seed):
    r = random.Random(seed)
    packets = [(r.randbytes(r.choice([0, 1, 254, 255, 256, 510, 3000, 70_000])), i * 960) for i in range(n)]
    return packets, C.pack_stream(serial, packets)


def test_round_trip():
    for seed in range(20):
        packets, data = stream(7, 12, seed)
        pages = list(C.scan_pages(data))
        assert pages[0].flags & C.FIRST and pages[-1].flags & C.LAST and [p.seq for p in pages] == list(range(len(pages)))
        got = list(C.scan_packets(iter(pages)))
        assert [g["payload"] for g in got] == [p for p, _ in packets]
        assert not any(g["hole_before"] for g in got) and got[0]["bos"] and got[-1]["eos"]
        assert got[-1]["granule"] == packets[-1][1]


def test_damage():
    packets, data = stream(7, 40, 3)
    pages = list(C.scan_pages(data))
    cut = pages[3]
    broken = data[: cut.offset + 30] + b"\x00\xff" + data[cut.offset + 32 :]
    assert [p.seq for p in C.scan_pages(broken)] == [p.seq for p in pages if p.seq != 3]
    got = list(C.scan_packets(C.scan_pages(broken)))
    assert sum(g["hole_before"] for g in got) == 1
    whole = {p for p, _ in packets}
    assert all(g["payload"] in whole for g in got) and len(got) < len(packets)
    junk = b"OggSjunk" * 3 + data + b"OggS"
    assert next(C.scan_pages(junk)).skipped == 24 and len(list(C.scan_pages(junk))) == len(pages)


def test_interleaved_and_chained():
    a, b = list(C.scan_pages(stream(1, 9, 1)[1])), list(C.scan_pages(stream(2, 9, 2)[1]))
    mixed = [p for pair in zip(a, b) for p in pair] + a[len(b) :] + b[len(a) :]
    got = list(C.scan_packets(iter(mixed + list(C.scan_pages(stream(1, 3, 5)[1])))))
    assert [g["payload"] for g in got if g["link"] == 0] == [p for p, _ in stream(1, 9, 1)[0]]
    assert [g["payload"] for g in got if g["link"] == 2] == [p for p, _ in stream(1, 3, 5)[0]]


def test_files(spark, tmp_path):
    packets, data = stream(5, 30, 8)
    (tmp_path / "a.ogg").write_bytes(data)
    (tmp_path / "b.ogg").write_bytes(b"")
    contents = C.files(spark, str(tmp_path))
    assert C.read_pages(contents).filter("crc_ok").count() == len(list(C.scan_pages(data)))
    got = C.read_packets(contents).orderBy("packet_no").collect()
    assert [bytes(g.payload) for g in got] == [p for p, _ in packets]


def test_corpora_and_raw_samples(spark, tmp_path):
    payloads = [b"a", b"", b"c" * 300]
    data = C.write_corpus(payloads)
    (tmp_path / "x").write_bytes(data + b"\xff\xff\x00")
    got = C.read_corpus(C.files(spark, str(tmp_path))).orderBy("packet_no").collect()
    assert [bytes(g.payload) for g in got] == payloads and got[0].rate == 48000 and got[0].channels == 2
    assert list(C.scan_corpus(b"")) == list(C.scan_corpus(b"OPUSPKT1")) == []
    samples = [0, 1, -1, 32767, -32768, 256, -257]
    df = spark.createDataFrame([("p", bytearray(b"".join(x.to_bytes(2, "little", signed=True) for x in samples)))], "path string, content binary")
    assert [r.samples for r in C.read_raw_pcm(df, 1, 3).orderBy("frame_no").collect()] == [samples[:3], samples[3:6]]


def test_pieces_give_the_same_pages():
    for seed in range(12):
        r = random.Random(seed)
        data = bytearray(b"OggSjunk" + stream(7, 15, seed)[1] + b"x" * 40 + stream(8, 5, seed)[1] + b"OggS\0")
        for _ in range(seed % 4):
            data[r.randrange(len(data))] ^= 255
        data = bytes(data)
        sync, got, at = C.PageSync(), [], 0
        while at < len(data):
            n = r.choice([1, 3, 20, 500, 9000])
            got += sync.feed(data[at : at + n], at + n >= len(data))
            at += n
        assert got == list(C.scan_pages(data))


def test_probe():
    from tonelake.functions.kernels import write_head

    data = C.pack_stream(3, [(write_head(2, 312, 48000), 0), (b"tags", 0), (b"x", 960)])
    assert C.probe(data)["pre_skip"] == 312 and C.probe(data[:40]) is None and C.probe(b"") is None
