"""Pages by byte ranges, the muxing sink, and sync in a stream."""

import io
import random

import pytest

from tonelake.functions.kernels import parse_head, write_head, write_tags
from tonelake.sources import containers as C
from tonelake.sources import ogg


def damaged(seed):
    r = random.Random(seed)
    inner = C.pack_stream(9, [(r.randbytes(300), 0), (r.randbytes(700), 960)])
    packets = [(r.choice([r.randbytes(r.choice([0, 10, 255, 3000, 70_000])), inner]), i * 960) for i in range(40)]  # pages inside packets
    data = bytearray(b"OggSjunk" + C.pack_stream(7, packets) + b"x" * r.choice([40, 400_000]) + C.pack_stream(8, packets[:5]) + b"OggS\0")
    for _ in range(seed % 4):
        data[r.randrange(len(data))] ^= 255
    return bytes(data)


@pytest.mark.parametrize("seed", range(6))
def test_ranges_give_all_pages_once(seed):
    data = damaged(seed)
    whole = list(C.scan_pages(data))
    for n in (1, 2, 7, 64):
        step = -(-len(data) // n)
        got = [p for at in range(0, len(data), step) for p in ogg.pages_from(io.BytesIO(data), at, min(at + step, len(data)), len(data))]
        assert got == whole


def test_source(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.ogg").write_bytes(damaged(i))
    (tmp_path / "empty.ogg").write_bytes(b"")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    want = {(i, p.offset, p.end, p.skipped, bytes(p.body)) for i in range(3) for p in C.scan_pages(damaged(i))}
    for options in ({}, {"ranges": 7}, {"rangeBytes": 30_000}):
        df = ogg.load_pages(spark, str(tmp_path), **options)
        got = [(int(r.path.split("/")[-1][0]), r.page_off, r.end_off, r.skipped, bytes(r.body)) for r in df.collect()]
        assert len(got) == len(want) and set(got) == want
    assert df.rdd.getNumPartitions() > 20
    assert ogg.load_pages(spark, f"file://{tmp_path}/1.ogg", ranges=3).count() == len(list(C.scan_pages(damaged(1))))
    (tmp_path / "none").mkdir()
    assert ogg.load_pages(spark, str(tmp_path / "none")).count() == 0


def test_ranges_in_one_task_check_each_page_once(tmp_path, monkeypatch):
    data = C.pack_stream(7, [(bytes([i]) * 700, i * 960) for i in range(60)])
    for i in range(4):
        (tmp_path / f"{i}.ogg").write_bytes(data)
    want = [(str(tmp_path / f"{i}.ogg"), p.offset) for i in range(4) for p in C.scan_pages(data)]
    checked, crc = [], C.page_crc
    monkeypatch.setattr(C, "page_crc", lambda x: checked.append(len(x)) or crc(x))
    reader = ogg.PageReader({"path": str(tmp_path), "ranges": 5})
    (task,) = reader.partitions()
    assert [r for b in reader.read(task) for r in zip(b["path"].to_pylist(), b["page_off"].to_pylist(), strict=True)] == want
    assert sum(checked) <= 4 * len(data)


def plain_pages(packets, delay):
    """Which packets end on which page, by the rule on muxing delay."""
    pages, held, segments, last, now = [], [], 0, 0, 0

    def flush():
        nonlocal held, segments, last
        if segments:
            n, done, out = 0, 0, []
            while done < segments:
                done += min(255, segments - done)
                here = []
                while held and n + held[0][1] <= done:
                    n += held[0][1]
                    here.append(held.pop(0)[0])
                out.append(here)
            pages.extend(out)
            held, segments, last = [], 0, now

    for i, (payload, granule) in enumerate(packets):
        need = len(payload) // 255 + 1
        if delay and granule - last > delay or segments + need > 255:
            flush()
        held.append((i, need))
        segments, now = segments + need, granule
        if delay and granule - last >= delay:
            flush()
    flush()
    return pages


@pytest.mark.parametrize("delay", [0, 960, 5000, 48000])
def test_packer(delay):
    r = random.Random(delay)
    packets, granule = [], 0
    for _ in range(300):
        granule += r.choice([120, 960, 2880, 5760])
        packets.append((r.randbytes(r.choice([0, 1, 254, 255, 256, 2000, 66_000])), granule))
    packer = ogg.Packer(5, delay)
    data = b"".join([page for i, p in enumerate(packets) for page in packer.add(*p, last=i == len(packets) - 1)])
    pages = list(C.scan_pages(data))
    assert sum(len(p.lacing) for p in pages) == sum(len(x) // 255 + 1 for x, _ in packets)
    want = plain_pages(packets, delay)
    assert [p.granule for p in pages] == [packets[w[-1]][1] if w else -1 for w in want]
    assert [x["payload"] for x in C.scan_packets(iter(pages))] == [x for x, _ in packets]
    assert pages[-1].flags & C.LAST and pages[0].flags & C.FIRST and sum(bool(p.flags & (C.LAST | C.FIRST)) for p in pages) in (1, 2)


def test_sink(spark, tmp_path):
    r = random.Random(4)
    rows = [(s, k, i, r.randbytes(r.choice([0, 30, 300])), 960 * i) for s in (1, 2, 70) for k in range(1 + s % 2) for i in range(1, 60)]
    want = {s: [x[3] for x in sorted(rows) if x[0] == s] for s in (1, 2, 70)}
    rows += [(3, 0, 1, None, None), (None, 0, 1, b"gone", 0)]
    r.shuffle(rows)
    path = str(tmp_path / "out")
    ogg.save_streams(spark.createDataFrame(rows, "stream_id long, link int, packet_no long, payload binary, granule long"), path, delay=4800, channels=1, vendor="me")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["1.opus", "2.opus", "3.opus", "70.opus"]
    for s, payloads in want.items():
        got = list(C.scan_packets(C.scan_pages((tmp_path / "out" / f"{s}.opus").read_bytes())))
        heads = [g for g in got if g["packet_no"] == 0]
        assert len(heads) == 1 + s % 2 and all(parse_head(h["payload"])["channels"] == 1 for h in heads)
        assert [g["payload"] for g in got if g["packet_no"] > 1] == payloads and not any(g["hole_before"] for g in got)
        assert sum(g["eos"] for g in got) == len(heads)


def test_pages_of_ranges_make_the_same_packets(spark, tmp_path):
    from tonelake.operators.streams import link_headers

    a, b = list(C.scan_pages(C.pack_stream(1, [(write_head(2, 312, 48000), 0), (write_tags(b"v", [b"A=b"]), 0)] + [(bytes([i]) * 3000, i * 960) for i in range(40)]))), list(C.scan_pages(C.pack_stream(2, [(b"no head", 0), (b"x", 960)])))
    raw = C.pack_stream(1, [(write_head(2, 312, 48000), 0), (write_tags(b"v", [b"A=b"]), 0)] + [(bytes([i]) * 3000, i * 960) for i in range(40)])
    other = C.pack_stream(2, [(b"no head", 0), (b"x", 960)])
    mixed = raw[: a[5].offset] + other[: b[0].end] + raw[a[6].offset :] + other[b[0].end :] + raw[: a[3].end]  # a lost page, two streams at once, a second link
    (tmp_path / "m.ogg").write_bytes(mixed)
    want = [(p["serial"], p["packet_no"], p["granule"], p["hole_before"], p["payload"]) for p in C.scan_packets(C.scan_pages(mixed))]
    df = C.packets_of_pages(ogg.load_pages(spark, str(tmp_path), ranges=9))
    got = [(r.serial, r.packet_no, r.granule, r.hole_before, bytes(r.payload)) for r in df.collect()]
    assert sorted(got) == sorted(want) and sum(g[3] for g in got) == 1
    links = {(r.link, r.serial): r for r in link_headers(df).collect()}
    assert sorted(links) == [(0, 1), (1, 2), (2, 1)]
    assert links[0, 1].channels == 2 and links[0, 1].comments == ["A=b"] and links[0, 1].error_code == 0 and links[2, 1].vendor == "v"
    assert links[1, 2].channels is None and links[1, 2].error_code != 0 and links[1, 2].last_granule == 960


def test_links_hold_each_event_once(spark, tmp_path):
    """Events of one number are packets of their own, as in SQL."""
    import duckdb

    from tonelake.plans import muxing

    rows = [(1, 5, 1), (1, 5, 2), (1, 6, 3), (2, 6, 1), (2, 6, 2), (2, 6, 2)]
    spark.createDataFrame(rows, "user_id long, event_id long, ts long").selectExpr("event_id", "timestamp_seconds(ts) AS ts", "user_id").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = muxing.links_of_files(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(muxing.ORACLES["links_of_files"])
    assert sorted(tuple(r[c] for c in want.columns) for r in found.collect()) == sorted(want.fetchall())


def test_headers_are_gathered_without_the_bytes_of_audio(spark):
    from tonelake.operators.streams import link_headers

    none = spark.createDataFrame([], C.PACKET.replace("link int", "link_off bigint"))
    plan = link_headers(none)._jdf.queryExecution().optimizedPlan().toString()
    project = next(line for line in plan[plan.index("Aggregate") :].splitlines() if "Project" in line)
    assert "CASE WHEN" in project and " payload#" not in project.split("CASE WHEN")[0]
