import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from siltgate.llm import media, tiff


def image(h, w, dtype=np.uint8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 4, (h, w)).cumsum(1) % np.iinfo(dtype).max
    return x.astype(dtype)


@pytest.mark.parametrize("scheme", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("layout", [{"strip_rows": 7}, {"strip_rows": 1000}, {"tile": (16, 32)}])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
def test_round_trip(scheme, predictor, layout, order, dtype):
    x = image(45, 70, dtype)
    (page,) = tiff.decode(tiff.encode(x, scheme, predictor, order=order, **layout))
    assert page.pixels.dtype == dtype and (page.pixels == x).all()


@pytest.mark.parametrize("data", [b"", b"a", b"ab" * 5000, bytes(range(256)) * 60, b"\0" * 40000, random.Random(1).randbytes(30000)])
def test_codecs(data):
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_known_bytes():
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    # the TIFF 6.0 text's example string 7 7 7 8 8 7 7 6 6: codes 256 7 258 8 8 258 6 6 257 in nine bits each
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    assert tiff.lzw_decode(int(bits.ljust(88, "0"), 2).to_bytes(11, "big"), 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_pages_bigtiff_planes_and_float_predictor():
    a, b = image(9, 64), image(30, 64, seed=2)
    assert [p.pixels.shape for p in tiff.decode(tiff.encode_pages([a, b]))] == [(9, 64), (30, 64)]
    # a 64-bit file with two interleaved samples, built by hand
    raw = bytes(range(12))
    tags = [(256, 3, 3), (257, 3, 2), (258, 3, 8), (259, 3, 1), (273, 16, 16), (277, 3, 2), (279, 16, 12)]
    big = b"II" + struct.pack("<HHHQ", 43, 8, 0, 32) + raw + b"\0" * 4 + struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQ", t, k, 1) + struct.pack("<Q", v) for t, k, v in tags) + struct.pack("<Q", 0)
    assert tiff.decode(big)[0].pixels.reshape(-1).tolist() == list(range(12))
    # floating-point predictor: byte planes of a row, differenced
    x = np.linspace(0, 1, 8, dtype=">f4").reshape(1, 8)
    planes = x.view(np.uint8).reshape(8, 4).T.reshape(-1)
    diff = np.diff(planes.astype(np.int16), prepend=0).astype(np.uint8).tobytes()
    tags = [(256, 4, 8), (257, 4, 1), (258, 3, 32), (259, 3, 1), (273, 4, 8), (279, 4, 32), (317, 3, 3), (339, 3, 3)]
    one = b"II*\0" + struct.pack("<I", 40) + diff + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHI", t, k, 1) + struct.pack("<I", v) for t, k, v in tags) + struct.pack("<I", 0)
    assert np.allclose(tiff.decode(one)[0].pixels, x.astype("f4"))


def test_page_rows(spark):
    good = tiff.encode_pages([image(5, 64), image(6, 64)], tiff.LZW)
    rows = [(1, bytearray(good), "k"), (2, None, "k"), (3, bytearray(b"junk"), "k"), (4, bytearray(b""), "k"), (1, bytearray(good), "k")]
    df = spark.createDataFrame(rows, "file_id long, content binary, width string")
    out = media.pages(df).collect()
    assert sorted((r.file_id, r.page, r.height) for r in out if r.error is None) == [(1, 0, 5), (1, 0, 5), (1, 1, 6), (1, 1, 6)]
    assert sorted(r.file_id for r in out if r.error) == [2, 3, 4] and out[0].pixels == image(5, 64).tobytes()
    assert media.pages(df.limit(0)).collect() == []


def test_texts(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "y" * 65, "long " * 300_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a", 2)], "doc_id long, text string, feature int")
    out = {r.doc_id: r for r in media.round_trips(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + b"\0" * ((64 - len(raw) % 64) % 64 if raw else 64)
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        stored = media.to_tiff(full)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert out[None].feature == out[2].feature and out[0].media_sha256 == out[1].media_sha256
    assert len(tiff.decode(media.to_tiff(media.payload(b"z" * (64 * 20_000))))) == 2


def bilevel(rows, width, fill=1, scheme=tiff.PACKBITS, bits=1):
    """A little-endian file with one strip of samples of 1, 2 or 4 bits, built by hand."""
    packed = b""
    for r in rows:
        word = "".join(format(x, f"0{bits}b") for x in r)
        word += "0" * (-len(word) % 8)
        packed += bytes(int(word[i : i + 8][:: -1 if fill == 2 and scheme == tiff.PLAIN else 1], 2) for i in range(0, len(word), 8))
    body = tiff.pack_bits(packed) if scheme == tiff.PACKBITS else packed
    if fill == 2 and scheme != tiff.PLAIN:
        body = bytes(int(format(x, "08b")[::-1], 2) for x in body)
    tags = [(256, 3, width), (257, 3, len(rows)), (258, 3, bits), (259, 3, scheme), (262, 3, 1), (266, 3, fill), (273, 4, 8), (278, 3, len(rows)), (279, 4, len(body))]
    at = 8 + len(body) + len(body) % 2
    head = struct.pack("<2sHI", b"II", 42, at) + body + b"\0" * (len(body) % 2)
    return head + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0)


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("fill,scheme", [(1, tiff.PACKBITS), (2, tiff.PACKBITS), (1, tiff.PLAIN), (2, tiff.PLAIN)])
def test_samples_below_a_byte(bits, fill, scheme):
    rng = np.random.default_rng(bits)
    rows = rng.integers(0, 1 << bits, (9, 21))
    if fill == 2 and scheme == tiff.PLAIN and bits > 1:
        return  # only the order of single bits is defined there
    assert tiff.decode(bilevel(rows.tolist(), 21, fill, scheme, bits))[0].pixels.tolist() == rows.tolist()


def test_a_broken_page_leaves_the_others(spark):
    good = [np.full((4, 6), i, np.uint8) for i in (1, 2, 3)]
    data = bytearray(tiff.encode_pages(good, tiff.DEFLATE))
    places = [tags[tiff.STRIP_AT][0] for _, tags in tiff._directories(bytes(data))]
    data[places[1] : places[1] + 4] = b"\xff" * 4
    huge = bytearray(tiff.encode_pages(good[:1], tiff.PLAIN))
    head = next(iter([struct.unpack_from("<I", huge, 4)[0]]))
    for i in range(struct.unpack_from("<H", huge, head)[0]):
        if struct.unpack_from("<H", huge, head + 2 + 12 * i)[0] in (256, 257):
            struct.pack_into("<I", huge, head + 2 + 12 * i + 8, 4_000_000_000)
    rows = [(1, bytes(data)), (2, bytes(huge)), (3, b"GIF89a..."), (4, None), (4, bytes(tiff.encode(good[0])))]
    out = media.pages(spark.createDataFrame([(i, c, "mine") for i, c in rows], "id long, content binary, error string")).collect()
    got = {}
    for r in out:
        got.setdefault(r.id, []).append((r.page, r.error is None, r.pixels and r.pixels[0]))
    assert sorted(got[1]) == [(0, True, 1), (1, False, None), (2, True, 3)]
    assert got[2] == [(0, False, None)] and got[3] == [(None, False, None)]
    assert sorted(got[4], key=str) == [(0, True, 1), (None, False, None)]
    assert {r.height for r in out if r.id == 1 and r.error is None} == {4}


def test_size_of_a_page_is_a_parameter(spark):
    data = media.to_tiff(media.payload(b"x" * 5000))
    df = spark.createDataFrame([(1, bytearray(data))], "doc_id long, content binary")
    small, large = media.pages(df, most=1000).first(), media.pages(df).first()
    assert small.pixels is None and "larger than 1000" in small.error and large.error is None and len(large.pixels) == 5056


def test_lzw_over_cleared_tables():
    # the plain reading of the format: codes of byte strings, each in the width of its place
    import numpy as np

    from siltgate.llm import tiff

    def plain(data):
        table, size, codes, now = {bytes([i]): i for i in range(256)}, 258, [(256, 9)], b""
        width = lambda: 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
        for i in range(len(data)):
            more = now + data[i : i + 1]
            if more in table:
                now = more
                continue
            codes.append((table[now], width()))
            table[more], size, now = size, size + 1, data[i : i + 1]
            if size >= 4094:
                codes.append((256, width()))
                table, size = {bytes([j]): j for j in range(256)}, 258
        if now:
            codes.append((table[now], width()))
            size += 1
        codes.append((257, width()))
        text = "".join(f"{c:0{w}b}" for c, w in codes)
        text += "0" * (-len(text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))

    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 253, 254, 255, 511, 3835, 3836, 3837, 3838, 20_000):
        for top in (1, 4, 256):
            data = rng.integers(0, top, n).astype(np.uint8).tobytes()
            assert tiff.lzw_encode(data) == plain(data) and tiff.lzw_decode(plain(data), n) == data
