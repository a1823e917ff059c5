"""TIFF as a media column: write grey images, walk directories, decode pages.

The reader follows both byte orders, classic and 64-bit files, chained and
repeated-safe image directories, strips and tiles, no compression, PackBits,
LZW and deflate, and the horizontal and floating-point predictors.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

#: Tag numbers of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZE, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE, SAMPLE_FORMAT, FILL_ORDER = 322, 323, 324, 325, 339, 266
#: Bytes and struct codes of the field types 1-13 and 16-18.
FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Compression schemes.
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


#: What is said of a file without the format's first bytes.
FOREIGN = "not a TIFF file"


@dataclass
class Page:
    index: int
    tags: dict[int, tuple]
    pixels: np.ndarray = field(repr=False)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[at]])
            at += run
        else:
            to = at + 1
            while to < len(data) and to - at < 128 and (to + 1 >= len(data) or data[to] != data[to + 1]):
                to += 1
            out += bytes([to - at - 1]) + data[at:to]
            at = to
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes from the high bit on; the width grows one code early."""
    CLEAR, END = 256, 257
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, total, width, acc, bits, last = [], 0, 9, 0, 0, None
    n, grows, at, add, put = 258, 511, 0, table.append, out.append
    while True:
        if bits < width:
            more = data[at : at + 64]
            at += 64
            acc, bits = acc << 8 * len(more) | int.from_bytes(more, "big"), bits + 8 * len(more)
            if bits < width:
                break
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == CLEAR:
            del table[258:]
            n, width, grows, last = 258, 9, 511, None
            continue
        if code == END:
            break
        if last is None:
            entry = table[code]
        else:
            if code < n:
                entry = table[code]
                add(last + entry[:1])
            else:
                entry = last + last[:1]
                add(entry)
            n += 1
            if n == grows and width < 12:
                width, grows = width + 1, 2 * grows + 1
        put(entry)
        total += len(entry)
        last = entry
        if total >= size:
            break
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    acc, bits, out = 256, 9, bytearray()
    # a longer entry is the code of all but its last byte, and that byte
    known: dict[int, int] = {}
    find = known.get
    width, size, now = 9, 258, -1
    for byte in data:
        if now < 0:
            now = byte
            continue
        key = now << 8 | byte
        code = find(key)
        if code is not None:
            now = code
            continue
        acc, bits = acc << width | now, bits + width
        known[key] = size
        size += 1
        if size in (512, 1024, 2048):
            width += 1
        elif size >= 4094:
            acc, bits = acc << width | 256, bits + width
            known.clear()
            width, size = 9, 258
        if bits >= 512:
            full, bits = bits >> 3, bits & 7
            out += (acc >> bits).to_bytes(full, "big")
            acc &= (1 << bits) - 1
        now = byte
    if now >= 0:
        acc, bits, size = acc << width | now, bits + width, size + 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    acc, bits = acc << width | 257, bits + width
    return bytes(out + (acc << -bits % 8).to_bytes(-(-bits // 8), "big"))


def encode(pixels: np.ndarray, compression: int = DEFLATE, predictor: int = 1, strip_rows: int = 1024, tile: tuple[int, int] | None = None, order: str = "<", level: int = 1) -> bytes:
    """One grey page of 8- or 16-bit samples."""
    return encode_pages([pixels], compression, predictor, strip_rows, tile, order, level)


def encode_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, strip_rows: int = 1024, tile: tuple[int, int] | None = None, order: str = "<", level: int = 1) -> bytes:
    pack = {PLAIN: bytes, DEFLATE: lambda b: zlib.compress(b, level), OLD_DEFLATE: lambda b: zlib.compress(b, level), PACKBITS: pack_bits, LZW: lzw_encode}[compression]
    body: list[bytes] = []
    at = 8
    heads: list[tuple[int, list]] = []
    for pixels in pages:
        h, w = pixels.shape
        parts = []
        if tile:
            th, tw = tile
            for y in range(0, h, th):
                for x in range(0, w, tw):
                    block = np.zeros((th, tw), pixels.dtype)
                    got = pixels[y : y + th, x : x + tw]
                    block[: got.shape[0], : got.shape[1]] = got
                    parts.append(block)
        else:
            parts = [pixels[y : y + strip_rows] for y in range(0, h, strip_rows)]
        offsets, sizes = [], []
        for p in parts:
            if predictor == 2:
                p = np.concatenate([p[:, :1], p[:, 1:] - p[:, :-1]], 1)
            raw = pack(p.astype(p.dtype.newbyteorder(order)).tobytes())
            raw += b"\0" * (len(raw) & 1)
            offsets.append(at)
            sizes.append(len(raw))
            body.append(raw)
            at += len(raw)
        tags = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8 * pixels.dtype.itemsize]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1])]
        tags += [(TILE_WIDTH, 4, [tile[1]]), (TILE_HEIGHT, 4, [tile[0]]), (TILE_AT, 4, offsets), (TILE_SIZE, 4, sizes)] if tile else [(STRIP_AT, 4, offsets), (STRIP_ROWS, 4, [strip_rows]), (STRIP_SIZE, 4, sizes)]
        tags += [(SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        heads.append((at, sorted(tags)))
        at += 2 + 12 * len(tags) + 4
        extra = []
        for tag, kind, values in sorted(tags):
            code = FIELD[kind]
            raw = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(raw) <= 4:
                extra.append((tag, kind, len(values), raw.ljust(4, b"\0"), b""))
            else:
                extra.append((tag, kind, len(values), struct.pack(order + "I", at), raw + b"\0" * (len(raw) & 1)))
                at += len(extra[-1][4])
        heads[-1] = (heads[-1][0], extra)
        body.append(b"")  # placeholder: the directory needs the next one's place
        heads[-1] += (len(body) - 1, at)
    for n, (_, extra, slot, end) in enumerate(heads):
        nxt = heads[n + 1][0] if n + 1 < len(heads) else 0
        body[slot] = struct.pack(order + "H", len(extra)) + b"".join(struct.pack(order + "HHI", t, k, c) + v for t, k, c, v, _ in extra) + struct.pack(order + "I", nxt) + b"".join(e[4] for e in extra)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", heads[0][0]) + b"".join(body)


def _directories(data: bytes):
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise ValueError(FOREIGN)
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic == 42:
        size, count, entry, place = 4, "H", 12, "I"
        at = struct.unpack_from(order + "I", data, 4)[0]
    elif magic == 43:
        size, count, entry, place = 8, "Q", 20, "Q"
        at = struct.unpack_from(order + "Q", data, 8)[0]
    else:
        raise ValueError(FOREIGN)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + count, data, at)[0]
        if n * entry > len(data):
            raise ValueError(f"a directory of {n} entries in {len(data)} bytes")
        at += struct.calcsize(count)
        tags = {}
        for i in range(n):
            tag, kind = struct.unpack_from(order + "HH", data, at + i * entry)
            values = struct.unpack_from(order + place, data, at + i * entry + 4)[0]
            code = FIELD.get(kind)
            if code is None:
                continue
            if values > len(data):
                raise ValueError(f"tag {tag} with {values} values in {len(data)} bytes")
            full = f"{order}{values * len(code)}{code[0]}"
            where = at + i * entry + 4 + struct.calcsize(place)
            if struct.calcsize(full) > size:
                where = struct.unpack_from(order + place, data, where)[0]
            tags[tag] = struct.unpack_from(full, data, where)
        yield order, tags
        at = struct.unpack_from(order + place, data, at + n * entry)[0]


def _block(raw: bytes, scheme: int, size: int) -> bytes:
    if scheme == PLAIN:
        return raw
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(raw, size)
    if scheme == LZW:
        return lzw_decode(raw, size)
    if scheme == PACKBITS:
        return unpack_bits(raw, size)
    raise ValueError(f"compression {scheme} is not supported")


def _samples(raw: bytes, rows: int, width: int, bits: int, flip: bool) -> np.ndarray:
    """Rows of ``width`` samples of 1, 2 or 4 bits, each row padded to whole bytes, as bytes."""
    wide = -(-width * bits // 8)
    flat = np.frombuffer(raw, np.uint8, rows * wide).reshape(rows, wide)
    each = np.unpackbits(flat, axis=1, bitorder="little" if flip else "big").reshape(rows, -1, bits)
    order = np.arange(bits) if flip else np.arange(bits)[::-1]
    return (each << order.astype(np.uint8)).sum(2, dtype=np.uint8)[:, :width]


def _page(data: bytes, order: str, tags: dict[int, tuple], most: int) -> np.ndarray:
    one = lambda t, d=None: tags[t][0] if tags.get(t) else d
    w, h, spp = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    if not w or not h or not spp:
        raise ValueError("a page without size")
    depths = set(tags.get(BITS, (1,)))
    bits, kind, scheme, predictor = one(BITS, 1), one(SAMPLE_FORMAT, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    if len(depths) > 1 or bits not in (1, 2, 4, 8, 16, 32, 64) or kind not in (1, 2, 3) or kind == 3 and bits < 32:
        raise ValueError(f"samples of {bits} bits and format {kind} are not supported")
    if bits < 8 and predictor != 1:
        raise ValueError("a predictor needs samples of whole bytes")
    dtype = np.dtype({1: "u", 2: "i", 3: "f"}[kind] + str(max(1, bits // 8)))
    if h * w * spp * dtype.itemsize > most:
        raise ValueError(f"a page of {w} x {h} x {spp} samples is larger than {most} bytes")
    planes = spp if one(PLANAR, 1) == 2 and spp > 1 else 1
    deep = 1 if planes > 1 else spp
    tiled = TILE_WIDTH in tags
    bw, bh = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (w, min(h, one(STRIP_ROWS, h)))
    if not bw or not bh or bw * bh * deep * dtype.itemsize > most:
        raise ValueError(f"blocks of {bw} x {bh} samples")
    places, sizes = (tags[TILE_AT], tags[TILE_SIZE]) if tiled else (tags[STRIP_AT], tags[STRIP_SIZE])
    across, down = -(-w // bw), -(-h // bh)
    if len(places) != len(sizes) or len(places) < across * down * planes:
        raise ValueError(f"{len(places)} blocks where {across * down * planes} are needed")
    flip = one(FILL_ORDER, 1) == 2
    image = np.zeros((planes, h, w, deep), dtype)
    for n, (at, length) in enumerate(zip(places[: across * down * planes], sizes)):
        if at + length > len(data):
            raise ValueError("a block lies outside the file")
        plane, n = divmod(n, across * down)
        y, x = n // across * bh, n % across * bw
        rows = bh if tiled else min(bh, h - y)
        row_bytes = -(-bw * deep * bits // 8)
        packed = data[at : at + length]
        if flip and scheme != PLAIN:
            # the fill order holds for the compressed bytes
            packed = _FLIPPED[np.frombuffer(packed, np.uint8)].tobytes()
        raw = _block(packed, scheme, rows * row_bytes)
        if len(raw) < rows * row_bytes:
            raise ValueError("a block ends early")
        if bits < 8:
            block = _samples(raw, rows, bw * deep, bits, flip and scheme == PLAIN).reshape(rows, bw, deep)
        elif predictor == 3:
            flat = np.frombuffer(raw, np.uint8, rows * row_bytes).reshape(rows, -1, deep).transpose(0, 2, 1)
            summed = np.cumsum(flat, axis=2, dtype=np.uint8).transpose(0, 2, 1).reshape(rows, dtype.itemsize, bw * deep)
            block = np.ascontiguousarray(summed.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, bw, deep).astype(dtype)
        else:
            block = np.frombuffer(raw, dtype.newbyteorder(order), rows * bw * deep).reshape(rows, bw, deep)
            if predictor == 2:
                block = np.cumsum(block.astype(dtype), axis=1, dtype=dtype)
        got = block[: h - y, : w - x]
        image[plane, y : y + got.shape[0], x : x + got.shape[1]] = got
    pixels = image.transpose(1, 2, 0, 3).reshape(h, w, spp)
    return pixels[:, :, 0] if spp == 1 else pixels


#: Bytes of one page's samples, and of one of its blocks, at most: more is an error of that page.
MOST = 1 << 30
_FLIPPED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)).reshape(256, 8)[:, ::-1], axis=1).ravel()


def pages(data: bytes, most: int = MOST):
    """(index, page or the error that kept it from being read) in the order of the directories.

    A page that can't be read doesn't keep the others from it; where a directory itself is broken, the walk ends with its error.
    """
    walk, index = _directories(data), 0
    while True:
        try:
            order, tags = next(walk)
        except StopIteration:
            return
        except Exception as e:  # noqa: BLE001
            yield index, e
            return
        try:
            yield index, Page(index, tags, _page(data, order, tags, most))
        except Exception as e:  # noqa: BLE001
            yield index, e
        index += 1


def decode(data: bytes) -> list[Page]:
    """All pages of a file, in the order of its directories; raises at the first that can't be read."""
    out = []
    for _, page in pages(data):
        if isinstance(page, Exception):
            raise page
        out.append(page)
    return out
