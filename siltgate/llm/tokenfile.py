"""Token-id files: a concatenated id array with Elias-Fano document boundaries.

A file holds, little-endian: the magic bytes, the number of documents and ids,
the bytes of one id (2 where the vocabulary fits, else 4), the document ids,
the boundaries (an Elias-Fano sequence of documents + 1 offsets) and the ids.
Files are rows (part, seq, content) of a table in the shared folder, so any
store that Spark can write holds them; parts and their files are in ascending
doc_id order.
"""

from __future__ import annotations

import re
import struct
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import eliasfano
from .scratch import Scratch
from .shingles import text_slices

MAGIC = b"SGTOKEN1"
_HEAD = struct.Struct("<8sQQBB6x")
#: Ids in one file, about.
FILE_IDS = 1 << 20
#: Chunks that a worker keeps the ids of; at twice as many it starts anew.
KNOWN = 1_500_000
#: Tables of file sizes with at most so many rows (under 32 MB) are broadcast.
BROADCAST_FILES = 500_000


def pack(doc_ids: np.ndarray, has_id: np.ndarray, ends: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    kind = {2: "<u2", 4: "<u4"}[width]
    bounds = np.concatenate([[0], ends])
    return _HEAD.pack(MAGIC, len(doc_ids), len(ids), width, 0) + doc_ids.astype("<i8").tobytes() + has_id.astype(np.uint8).tobytes() + eliasfano.encode(bounds) + ids.astype(kind).tobytes()


class TokenFile:
    """A read file: ``document(i)`` by select, ``bounds`` and ``ids`` in bulk."""

    def __init__(self, data: bytes) -> None:
        magic, self.n, total, width, _ = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", self.n, at)
        at += 8 * self.n
        self.has_id = np.frombuffer(data, np.uint8, self.n, at).astype(bool)
        self.offsets = eliasfano.Reader(data, at + self.n)
        self.ids = np.frombuffer(data, {2: "<u2", 4: "<u4"}[width], total, self.offsets.end)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.offsets.select(i) : self.offsets.select(i + 1)]

    def bounds(self) -> np.ndarray:
        return self.offsets.all()


class Coder:
    """Encodes texts with a ``tokenizers`` file, each distinct chunk once.

    The byte-level pre-tokenizer always starts a token at a space that is
    followed by something other than white space, so a text's ids are those of
    its chunks between such spaces, and a chunk's ids can be kept. Texts that hold
    one of the vocabulary's added tokens are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # a normalizer may change letters before added tokens are looked for
        self.added = [] if self.tok.normalizer else added
        self.any = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added and self.tok.normalizer else None
        self.vocab = self.tok.get_vocab_size()
        known = self.tok.get_vocab()
        self.opens = np.zeros(max(known.values()) + 1, bool)
        # the byte-level alphabet writes a space as this letter
        self.opens[[i for t, i in known.items() if t.startswith("\u0120")]] = True
        self._fresh()

    def _fresh(self) -> None:
        # chunks as they are, and those that start with a space under what follows it
        self.full: dict[str, int] = {}
        self.tail: dict[str, int] = {}
        self.known = 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.blank = np.zeros(1 << 16, bool)

    def _ids(self, part: list[str], before: str) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks one after the other, and each chunk's number of ids."""
        if before and not any(not p or p[0].isspace() for p in part):
            # one text of all chunks: a token that starts with a space starts a chunk
            ids = np.array(self.tok.encode(before + before.join(part), add_special_tokens=False).ids, np.uint32)
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(part) and at[0] == 0:
                return ids, np.diff(np.append(at, len(ids)))
        got = [e.ids for e in self.tok.encode_batch([before + p for p in part] if before else part, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes

    def _learn(self, index: dict[str, int], new: list[str], before: str) -> None:
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            ids, sizes = self._ids(part, before)
            n, k, m = len(ids), self.known, len(part)
            while self.used + n > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while k + m > len(self.at):
                self.at, self.size, self.blank = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.blank))
            index.update(zip(part, range(k, k + m)))
            self.at[k : k + m], self.size[k : k + m] = self.used + np.cumsum(sizes) - sizes, sizes
            self.blank[k : k + m] = [not p or p[0].isspace() for p in part]
            self.flat[self.used : self.used + n] = ids
            self.known, self.used = k + m, self.used + n

    def _look(self, index: dict[str, int], keys: list[str], before: str) -> np.ndarray:
        got = np.fromiter(map(index.get, keys, repeat(-1)), np.int64, len(keys))
        miss = np.flatnonzero(got < 0)
        if len(miss):
            self._learn(index, list(dict.fromkeys(keys[i] for i in miss.tolist())), before)
            got[miss] = [index[keys[i]] for i in miss.tolist()]
        return got

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and each text's number of ids."""
        apart = [i for i, t in enumerate(texts) if any(a in t for a in self.added) or self.any and self.any.search(t)]
        if not apart:
            return self._plain(texts)
        out = {i: np.array(self.tok.encode(texts[i], add_special_tokens=False).ids, np.uint32) for i in apart}
        rest = [i for i in range(len(texts)) if i not in out]
        if rest:
            ids, n = self._plain([texts[i] for i in rest])
            out |= zip(rest, np.split(ids, np.cumsum(n)[:-1]))
        return np.concatenate([out[i] for i in range(len(texts))]), np.array([len(out[i]) for i in range(len(texts))], np.int64)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.known > KNOWN:
            self._fresh()
        pieces = " ".join(texts).split(" ") if texts else []
        counts = np.array([t.count(" ") + 1 for t in texts], np.int64)
        heads = np.cumsum(counts) - counts
        chunk = self._look(self.tail, pieces, " ")
        first = heads.tolist()
        # a space before other white space or at the end: the plain split at spaces doesn't hold there
        blank = self.blank[chunk]
        blank[first] = False
        odd = np.logical_or.reduceat(blank, heads) if len(heads) else np.zeros(0, bool)
        chunk[first] = self._look(self.full, [pieces[i] for i in first], "")
        if odd.any():
            parts = np.split(chunk, heads[1:])
            for i in np.flatnonzero(odd).tolist():
                parts[i] = self._look(self.full, list(filter(None, _CHUNK.split(texts[i]))), "")
            counts = np.array([len(p) for p in parts], np.int64)
            chunk = np.concatenate(parts)
        size = self.size[chunk]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.at[chunk] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])])


_CHUNK = re.compile(r"(?= [^\s])")
_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _coders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _coders[path] = Coder(path)
    return _coders[path]


def write(docs: DataFrame, tokenizer: str, end_id: int, scratch: Scratch) -> DataFrame:
    """``docs(doc_id, text)`` as files: (part, seq, n_docs, n_ids, content)."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        c = coder(tokenizer)
        width = 2 if max(c.vocab, end_id + 1) <= 1 << 16 else 4
        held: list[tuple] = []
        have = 0

        def file():
            nonlocal held, have, seq
            ids, ends = np.concatenate([h[2] for h in held]), np.cumsum(np.concatenate([h[3] for h in held]))
            keys, has = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            data = pack(keys, has, ends, ids, width)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], names=["part", "seq", "n_docs", "n_ids", "content"])
            held, have, seq = [], 0, seq + 1
            return row

        for whole in batches:
            for b in text_slices(whole, "text", 1 << 20):
                ids, n = c.encode(b.column("text").fill_null("").to_pylist())
                out = np.full(len(ids) + len(n), end_id, np.uint32)
                keep = np.ones(len(out), bool)
                keep[np.cumsum(n + 1) - 1] = False
                out[keep] = ids
                col = b.column("doc_id")
                held.append((col.fill_null(0).to_numpy(zero_copy_only=False), col.is_valid().to_numpy(zero_copy_only=False), out, n + 1))
                have += len(out)
                if have >= FILE_IDS:
                    yield file()
        if held:
            yield file()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a second key keeps one repeated doc_id from filling a single part
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return scratch.table(ranged.mapInArrow(run, "part int, seq int, n_docs long, n_ids long, content binary"))


def documents(files: DataFrame) -> DataFrame:
    """The documents in files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches):
        for b in batches:
            for data, first in zip(b.column("content"), b.column("first").to_pylist()):
                f = TokenFile(data.as_buffer().to_pybytes())
                to = f.bounds()
                wide = f.ids.astype("<u4")
                crc = [zlib.crc32(wide[i:j]) for i, j in zip(to[:-1].tolist(), to[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, mask=~f.has_id), pa.array(first + to[:-1], pa.int64()), pa.array(np.diff(to), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    sizes = files.select("part", "seq", "n_ids")
    # one row a file: the running sum over files is the only ordered step
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    first = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))
    first = F.broadcast(first) if sizes.count() <= BROADCAST_FILES else first
    return files.join(first, ["part", "seq"]).select("content", "first").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the files of ``docs(doc_id, text)`` and reads them back (see ``documents``).

    Defined cases: a null or empty text is a document of the end id alone; a
    null doc_id comes before all others; rows that share a doc_id follow each
    other in the order of their texts' hash; an empty table gives no file and
    no row; other columns are ignored. Texts are encoded whole.
    """
    return documents(write(docs, tokenizer, end_id, Scratch(docs.sparkSession, "tokens")))
