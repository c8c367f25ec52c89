"""Byte kernels: exhaustive small domains, wire cases and round trips."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonelake.functions import kernels as K
from tonelake.functions import toc


def h(text):
    return bytes.fromhex(text)


def test_self_delimited_single():
    p = K.parse_packet(h("00 05 01 02 03 04 05"), True)
    assert [len(f) for f in p.frames] == [5] and p.offset == 2


def test_self_delimited_cbr_with_padding():
    p = K.parse_packet(h("03 42 02 03 AA AB AC BA BB BC EE EF"), True)
    assert p.frames == [h("AA AB AC"), h("BA BB BC")] and p.padding == h("EE EF") and p.used == 12


@pytest.mark.parametrize("data", ["", "01 04 AA BB CC", "01 01 02 00", "02", "02 05 01", "03", "03 00", "03 31 00", "03 C2 FC"])
def test_bad_packets(data):
    with pytest.raises(K.BadBytes):
        K.parse_packet(h(data), data.startswith("01 04"))


def test_frame_limit():
    assert K.parse_packet(bytes(1276)).frames == [bytes(1275)]
    with pytest.raises(K.BadBytes):
        K.parse_packet(bytes(1277))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 255), st.lists(st.binary(max_size=400), min_size=1, max_size=6), st.integers(0, 3000))
def test_packet_round_trip(first, frames, pad_to):
    if len(frames) * K.frame_samples(first) > K.MAX_SAMPLES:
        with pytest.raises(K.BadBytes):
            K.build_packet(first, frames)
        return
    data = K.build_packet(first, frames, pad_to)
    assert len(data) >= pad_to
    p = K.parse_packet(data)
    assert p.frames == frames and p.toc & 0xFC == first & 0xFC and p.used == len(data)
    assert K.parse_packet(K.unpad_packet(data)).frames == frames


def test_merge():
    a, b = K.build_packet(0x08, [b"ab"]), K.build_packet(0x08, [b"c", b"de"])
    assert K.parse_packet(K.merge_packets([a, b])).frames == [b"ab", b"c", b"de"]
    with pytest.raises(K.BadBytes):
        K.merge_packets([a, K.build_packet(0x0C, [b"x"])])


def test_extension_cases():
    items = [K.Extension(3, 0, b"a"), K.Extension(32, 10, b"DRED"), K.Extension(33, 1, b"NOT DRED"), K.Extension(4, 4, b"")]
    data = K.write_extensions(items, 12, 27)
    # padding, a short one with its byte, a long one with a length, steps of one, three and six frames, and a last long one without
    want = b"\x01" * 4 + bytes([3 << 1 | 1]) + b"a" + b"\x02" + bytes([33 << 1 | 1, 8]) + b"NOT DRED" + b"\x03\x03" + bytes([4 << 1]) + b"\x03\x06" + bytes([32 << 1]) + b"DRED"
    assert data == want and len(data) == 27
    assert sorted(K.extensions(data, 12), key=lambda e: e.frame) == sorted(items, key=lambda e: e.frame)


def test_extension_repeats():
    # frame 0: short 3 with a byte, long 40 of two bytes; repeated for frames 1 and 2, the last without a length
    data = bytes([3 << 1 | 1, 7, 40 << 1 | 1, 2, 1, 2, 2 << 1, 8, 2, 3, 4, 9, 5, 6, 7])
    got = [(e.id, e.frame, e.data) for e in K.extensions(data, 3)]
    assert got == [(3, 0, b"\x07"), (40, 0, b"\x01\x02"), (3, 1, b"\x08"), (40, 1, b"\x03\x04"), (3, 2, b"\x09"), (40, 2, b"\x05\x06\x07")]


def test_repeats_are_said_once():
    """What a frame shares with all later ones; the reader knows no more than the format."""
    r = random.Random(3)
    shorter = 0
    for _ in range(1500):
        n = r.randrange(1, 12)
        kinds = [(i, r.randrange(2)) for i in (r.choice([3, 9, 31, 32, 40, 127]) for _ in range(r.randrange(5)))]
        items = [K.Extension(i, f, r.randbytes(b if i < 32 else r.choice([0, 3, 255, 300]))) for f in range(n) for i, b in kinds]
        items += [K.Extension(i, r.randrange(n), r.randbytes(1)) for i in (r.choice([3, 4, 50]) for _ in range(r.randrange(3)))]
        items = sorted(items, key=lambda e: e.frame)
        data = K.write_extensions(items, n)
        assert sorted(K.extensions(data, n), key=lambda e: e.frame) == items
        shorter += len(data) < sum(1 + len(e.data) + (e.id >= 32) for e in items)
    assert shorter > 300
    same = [K.Extension(i, f, bytes([f])) for f in range(3) for i in (3, 40)]
    assert K.write_extensions(same, 3) == bytes([3 << 1 | 1, 0, 40 << 1 | 1, 1, 0, 2 << 1, 1, 1, 1, 2, 2])


def test_packets_carry_extensions():
    r = random.Random(4)
    for _ in range(500):
        n = r.randrange(1, 5)
        frames = [r.randbytes(r.choice([3, 3, 7])) for _ in range(n)]
        items = [K.Extension(i, f, r.randbytes(r.randrange(2) if i < 32 else r.randrange(300))) for f in range(n) for i in r.sample([3, 40, 126], r.randrange(3))]
        data = K.build_packet(0x08, frames, carried=items)
        p = K.parse_packet(data)
        assert p.frames == frames and sorted(K.extensions(p.padding, n), key=lambda e: e.frame) == items
        if items:
            longer = K.build_packet(0x08, frames, len(data) + 40, items)
            p = K.parse_packet(longer)
            assert len(longer) == len(data) + 40 and p.frames == frames and sorted(K.extensions(p.padding, n), key=lambda e: e.frame) == items
            with pytest.raises(K.BadBytes):
                K.build_packet(0x08, frames, len(data) - len(K.write_extensions(items, n)), items)


def test_redundancy():
    mark = K.REDUNDANCY_MARK
    items = [K.Extension(126, 0, b"xx"), K.Extension(126, 1, mark), K.Extension(126, 2, mark + b"abc"), K.Extension(126, 3, mark + b"later")]
    assert K.redundancy(K.build_packet(0x08, [b"a"] * 4, carried=items)) == {"payload": b"abc", "frame_offset": 2 * 960 // 120}
    assert K.redundancy(K.build_packet(0x08, [b"a"] * 2))["payload"] is None
    with pytest.raises(K.BadBytes):
        K.redundancy(b"")


def test_extension_errors_count_and_raise():
    data = bytes([3 << 1 | 1, 7, 40 << 1 | 1, 200, 1])
    assert K.count_extensions(data, 2) == 1
    with pytest.raises(K.BadBytes):
        list(K.extensions(data, 2))


def test_random_extensions():
    r = random.Random(1)
    for _ in range(2000):
        n = r.randrange(1, 49)
        items = [K.Extension(i, r.randrange(n), r.randbytes(r.randrange(2) if i < 32 else r.randrange(300))) for i in (r.randrange(3, 128) for _ in range(r.randrange(8)))]
        data = K.write_extensions(items, n, r.randrange(200))
        assert sorted(K.extensions(data, n), key=lambda e: e.frame) == sorted(items, key=lambda e: e.frame)
    for _ in range(5000):
        K.count_extensions(r.randbytes(r.randrange(200)), r.randrange(1, 49))


def test_heads():
    data = K.write_head(2, 312, 48000, -256)
    assert K.parse_head(data) == {"version": 1, "channels": 2, "pre_skip": 312, "rate": 48000, "gain": -256, "family": 0, "streams": 1, "coupled": 1, "mapping": [0, 1]}
    six = K.write_head(6, 0, 44100, 0, 4, 2, [0, 4, 1, 2, 3, 5])
    assert K.parse_head(six)["mapping"] == [0, 4, 1, 2, 3, 5]
    for bad, code in ((b"x", K.NOT_FORMAT), (data[:12], K.BAD_HEADER), (data + b"x", K.BAD_HEADER), (data[:8] + b"\x10" + data[9:], K.BAD_VERSION), (data[:18] + b"\xff", K.UNSUPPORTED), (six[:-1] + b"\x09", K.BAD_HEADER)):
        with pytest.raises(K.BadBytes) as e:
            K.parse_head(bad)
        assert e.value.code == code


@given(st.binary(max_size=20), st.lists(st.binary(max_size=40), max_size=5), st.integers(0, 300))
def test_tags_round_trip(vendor, comments, pad):
    data = K.write_tags(vendor, comments, pad)
    assert not pad or (len(data) + 1) % 255 == 0
    got = K.parse_tags(data)
    assert (got["vendor"], got["comments"], got["suffix"]) == (vendor, comments, b"")
    assert K.parse_tags(K.write_tags(vendor, comments) + b"\x01rest")["suffix"] == b"\x01rest"


def test_pictures():
    png = K.PNG + b"\0\0\0\x0dIHDR" + (32).to_bytes(4, "big") * 2 + bytes([8, 6, 0, 0, 0]) + bytes(4)
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x11\x08\0\x10\0\x20\x03" + bytes(9)
    for data, size in ((png, (32, 32, 32, 0)), (jpeg, (32, 16, 24, 0)), (b"GIF89a\2\0\3\0\x91\0\0\0", (2, 3, 24, 4))):
        got = K.parse_picture(K.build_picture(3, b"image/", b"what", data))
        assert (got["width"], got["height"], got["depth"], got["colours"]) == size and got["data"] == data
    assert K.parse_picture(K.build_picture(1, b"image/png", b"", png))["format"] == "png"
    for bad in (b"abc", b"====", K.build_picture(1, b"image/jpeg", b"", jpeg)):
        with pytest.raises(K.BadBytes):
            K.parse_picture(bad)


def test_crc():
    assert K.page_crc(b"123456789") == 2309065087 and K.page_crc(b"") == 0


def test_inspectors_agree_with_the_parser(spark):
    r = random.Random(2)
    data = [r.randbytes(r.randrange(0, 12)) for _ in range(3000)]
    p = F.col("payload")
    rows = spark.createDataFrame([(bytearray(d),) for d in data], "payload binary").select(p, toc.frame_count(p).alias("n"), toc.total_samples(p).alias("t"), K.packet_udf()(p).alias("k")).collect()
    for x in rows:
        if x.k.error_code == 0:
            assert x.n == len(x.k.sizes)
            if x.t.error_code == 0:
                assert x.t.value == x.n * K.frame_samples(x.payload[0])


def test_length_fields(spark):
    sizes = spark.range(1276).select(F.col("id").cast("int").alias("n"))
    w = sizes.select("n", F.unhex(toc.write_length(F.col("n"))).alias("b")).select("n", toc.length_field(F.col("b"), 0).alias("f"), F.octet_length("b").alias("l"))
    assert w.filter("f.size <> n OR f.bytes <> l").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=300), min_size=2, max_size=2), min_size=1, max_size=4), st.integers(0, 2500))
def test_multistream_round_trip(streams, pad_to):
    packets = [K.build_packet(0x08 | i % 2 * 4, frames) for i, frames in enumerate(streams)]
    data = K.join_streams(packets, pad_to)
    assert len(data) >= pad_to
    assert [p.frames for p in K.split_streams(data, len(streams))] == streams
    assert K.unpad_streams(data, len(streams)) == K.join_streams(packets)


def test_multistream_needs_equal_durations():
    data = K.join_streams([K.build_packet(0x08, [b"a"]), K.build_packet(0x08, [b"b", b"c"])])
    with pytest.raises(K.BadBytes):
        K.split_streams(data, 2)


def test_header_columns(spark):
    """Headers by Columns against the plain writer and parser, and the matrix of a projection."""
    from pyspark.sql import functions as F

    from tonelake.functions import ambisonics, editing

    row = spark.range(1)
    six = F.struct(F.lit(4).alias("streams"), F.lit(2).alias("coupled"), F.array(*map(F.lit, (0, 4, 1, 2, 3, 5))).alias("mapping"))
    lit = F.lit
    got = row.select(
        editing.identification_header(lit(2), lit(312), lit(48000), lit(-256)).alias("plain"),
        editing.identification_header(lit(6), lit(0), lit(44100), lit(0), lit(1), six).alias("six"),
        editing.identification_header(lit(6), lit(0), lit(48000), lit(0), lit(3), F.struct(lit(3).alias("streams"), lit(3).alias("coupled"), lit(None).cast("array<int>").alias("mapping")), ambisonics.matrix_column(6, 1)).alias("sphere"),
        editing.identification_header(lit(3), lit(0), lit(48000), lit(0), lit(1)).alias("none"),
    ).first()
    assert bytes(got.plain) == K.write_head(2, 312, 48000, -256) and bytes(got.six) == K.write_head(6, 0, 44100, 0, 4, 2, [0, 4, 1, 2, 3, 5])
    cells = ambisonics.exported(6, 1)
    assert bytes(got.sphere)[18:21] == bytes([3, 3, 3]) and len(got.sphere) == 21 + 2 * 36
    assert [int.from_bytes(got.sphere[21 + 2 * i : 23 + 2 * i], "little", signed=True) for i in range(36)] == [v if v < 32768 else v - 65536 for v in cells]
    assert got.none is None


def test_crc_is_not_taken_byte_by_byte():
    def plain(data):
        r = 0
        for b in data:
            r = (r << 8 & 0xFFFFFFFF) ^ K.CRC[r >> 24 ^ b]
        return r

    r = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        data = r.randbytes(n)
        assert K.page_crc(data) == plain(data)
    data = r.randbytes(200_000)
    began = time.perf_counter()
    assert plain(data) == K.page_crc(data)
    loop = time.perf_counter() - began
    began = time.perf_counter()
    K.page_crc(data * 20)
    assert time.perf_counter() - began < 5 * loop
