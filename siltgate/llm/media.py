"""TIFF columns: one row per page of a binary column, and texts kept as grey pages."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiff
from .shingles import text_slices

#: Payload bytes are laid out in rows of this many samples.
ROW = 64
#: Rows of a page; longer payloads get further pages.
PAGE_ROWS = 16_384


def pages(files: DataFrame, content: str = "content", most: int = tiff.MOST) -> DataFrame:
    """One row per page of the TIFF in ``content``: the other columns, then page
    (int, from 0), width, height, samples (int), bits (int, of a returned sample: 8 at least), pixels (binary,
    big-endian samples in row order; samples of 1, 2 and 4 bits take a byte each) and error (string).

    Defined cases: a null, empty or foreign file gives one row with page null and
    the reason in error; a page that can't be read (unknown scheme, blocks outside the file or ending early, more
    than ``most`` bytes of samples; give more where workers have the memory) gives a row with its number and
    the reason, and the other pages stay; a directory that can't be read ends the file with such a row;
    a file without directories gives none. Columns named as those above are replaced.
    Every row stands for itself, so repeated rows repeat and an empty table gives an
    empty one. Pages leave the worker one by one.
    """
    own = ("page", "width", "height", "samples", "bits", "pixels", "error")
    keep = [c for c in files.columns if c != content and c not in own]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                data = b.column(content)[i].as_py()
                for index, p in tiff.pages(data, most) if data else [(None, ValueError("no content"))]:
                    if isinstance(p, Exception):
                        whole = index == 0 and str(p) == tiff.FOREIGN
                        row = (None if whole else index, *[None] * 5, f"{type(p).__name__}: {p}"[:200])
                    else:
                        h, w = p.pixels.shape[:2]
                        raw = p.pixels.astype(p.pixels.dtype.newbyteorder(">")).tobytes()
                        row = (index, w, h, 1 if p.pixels.ndim == 2 else p.pixels.shape[2], 8 * p.pixels.dtype.itemsize, raw, None)
                    same = [b.column(c).slice(i, 1) for c in keep]
                    kinds = [pa.int32()] * 5 + [pa.binary(), pa.string()]
                    yield pa.RecordBatch.from_arrays([*same, *(pa.array([x], k) for x, k in zip(row, kinds))], names=[*keep, *own])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name in keep]
    schema = ", ".join([*fields, "page int, width int, height int, samples int, bits int, pixels binary, error string"])
    return files.select(*keep, F.col(content).cast("binary").alias(content)).mapInArrow(run, schema)


#: Ways to write a page: compression, predictor, rows and columns of a tile (none: strips), byte order.
CODECS = [(tiff.PLAIN, 1, None, "<"), (tiff.PACKBITS, 1, None, ">"), (tiff.LZW, 1, None, "<"), (tiff.LZW, 2, (16, 32), ">"), (tiff.DEFLATE, 2, (32, 16), "<"), (tiff.OLD_DEFLATE, 1, None, ">"), (tiff.PACKBITS, 2, (16, 16), "<")]


def written(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` as (doc_id, content): whole texts as TIFF pages, in each of CODECS by doc_id in turn."""

    def run(batches):
        for whole in batches:
            for b in text_slices(whole, "text", 1 << 20):
                out = []
                for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                    grid = np.frombuffer(payload(t.as_buffer().to_pybytes() if t.is_valid else b""), np.uint8).reshape(-1, ROW)
                    scheme, predictor, tile, order = CODECS[(i or 0) % len(CODECS)]
                    out.append(tiff.encode_pages([grid[a : a + PAGE_ROWS] for a in range(0, len(grid), PAGE_ROWS)], scheme, predictor, 256, tile, order))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "content"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, content binary")


def payload(text: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of ROW."""
    return text.ljust(max(ROW, -(-len(text) // ROW) * ROW), b"\0")


def to_tiff(data: bytes) -> bytes:
    grid = np.frombuffer(data, np.uint8).reshape(-1, ROW)
    return tiff.encode_pages([grid[i : i + PAGE_ROWS] for i in range(0, len(grid), PAGE_ROWS)], tiff.DEFLATE, predictor=2, strip_rows=1024)


def from_tiff(media: bytes) -> np.ndarray:
    return np.concatenate([p.pixels for p in tiff.decode(media)])


def feature(grid: np.ndarray) -> str:
    """An 8 x 8 average hash (bands of rows, blocks of columns) and the mean sample."""
    rows = np.add.reduceat(grid.reshape(len(grid), 8, ROW // 8).sum(2, dtype=np.int64), np.minimum(np.arange(8) * len(grid) // 8, len(grid) - 1), axis=0)
    counts = np.maximum(np.diff(np.append(np.minimum(np.arange(8) * len(grid) // 8, len(grid) - 1), len(grid))), 1)
    means = rows / (counts[:, None] * (ROW // 8))
    bits = np.packbits((means > means.mean()).ravel()).tobytes().hex()
    return f"{bits}:{grid.sum(dtype=np.int64) / grid.size:.4f}"


def round_trips(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` stored as TIFF and read back: the digests of each document.

    Columns: doc_id, n_bytes, payload_bytes (long), payload_sha256, tail_crc32
    (long, of the last ROW bytes read back), media_bytes (long), media_sha256,
    feature. Null texts count as empty, whose payload is ROW zeros; texts of
    any length are kept whole; equal texts have equal values; other columns
    are ignored.
    """

    def run(batches):
        for whole in batches:
            for b in text_slices(whole, "text"):
                out = []
                for t in b.column("text"):
                    raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                    media = to_tiff(payload(raw))
                    grid = from_tiff(media)
                    back = grid.tobytes()
                    out.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature(grid)))
                cols = list(zip(*out)) if out else [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
