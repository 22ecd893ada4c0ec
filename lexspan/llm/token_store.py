"""Token-ID output: fixed-width bit packing with block offsets, and a reader with random access.

A file holds consecutive documents. Each id takes the fewest bits that hold the vocabulary; ids are
packed in blocks of `BLOCK` ids that begin at byte borders, so any range is unpacked by numpy without
reading the rest. Layout (little-endian): magic, u32 bits, u32 ids in a block, u64 documents, u64 ids;
doc_id i64 and its validity u8 for each document; first id u64 for each document and the end; byte
offset u64 for each block and the end; the blocks.

Defined results: null and empty texts give the end id alone; null doc_ids come first; rows with equal
doc_id are all kept, in the order of their texts' hashes; an empty table gives no file and no row.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import _spark, _tokens

MAGIC, BLOCK = b"LXSPTOK1", 1 << 16
#: Ids after which a task begins another file.
FILE_IDS = 16 << 20
#: Ids of consecutive documents that are read at once.
IDS = 1 << 20


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def encode_file(doc_ids: list[int | None], first: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """first: index of each document's first id, and the end."""
    packed = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, packed)]).astype("<u8")
    return b"".join(
        [MAGIC, struct.pack("<IIQQ", bits, block, len(doc_ids), len(ids)), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is not None for x in doc_ids], np.uint8).tobytes(), first.astype("<u8").tobytes(), offsets.tobytes(), *packed]
    )


class TokenFile:
    """A file's documents. Header and offsets are read at once, blocks only as their ids are asked for."""

    def __init__(self, source):
        """source: bytes, or a seekable file."""
        self._file = io.BytesIO(source) if isinstance(source, (bytes, memoryview)) else source
        head = self._read(0, 32)
        if head[:8] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block, n, self.n_ids = struct.unpack_from("<IIQQ", head, 8)
        blocks = -(-self.n_ids // self.block)
        rest, at = self._read(32, 9 * n + 8 * (n + 1) + 8 * (blocks + 1)), 0
        ids = np.frombuffer(rest, "<i8", n, at)
        ok = np.frombuffer(rest, np.uint8, n, at := at + 8 * n)
        self.doc_ids = [int(x) if y else None for x, y in zip(ids, ok, strict=True)]
        self.first = np.frombuffer(rest, "<u8", n + 1, at := at + n).astype(np.int64)
        self.offsets = np.frombuffer(rest, "<u8", blocks + 1, at := at + 8 * (n + 1)).astype(np.int64)
        self.base = 32 + len(rest)

    def _read(self, at: int, n: int) -> bytes:
        self._file.seek(at)
        return self._file.read(n)

    def range(self, a: int, z: int) -> np.ndarray:
        """The ids numbered a to z - 1."""
        if a >= z:
            return np.zeros(0, np.uint32)
        k, m = a // self.block, (z - 1) // self.block + 1
        at = self.offsets[k : m + 1] - self.offsets[k]
        raw = self._read(self.base + int(self.offsets[k]), int(at[-1]))
        got = [unpack(raw[at[i - k] : at[i - k + 1]], self.bits, min(self.block, self.n_ids - i * self.block)) for i in range(k, m)]
        return np.concatenate(got)[a - k * self.block : z - k * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.range(int(self.first[i]), int(self.first[i + 1]))


def _writer(file: str, end_id: int, bits: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal k
            flat, first = np.concatenate(ids), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
            at = f"{folder}/tokens-{part:06d}-{k:04d}.bin"
            _spark.write_file(at, encode_file(docs, first, flat, bits))
            row = pa.record_batch([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([at]), pa.array([len(docs)], pa.int64()), pa.array([len(flat)], pa.int64())], ["part", "k", "path", "n_docs", "n_ids"])
            k += 1
            docs.clear(), sizes.clear(), ids.clear()
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                flat, off = _tokens.encode(file, some.column(1))
                n = some.num_rows
                out = np.full(len(flat) + n, end_id, np.uint32)
                keep = np.ones(len(out), bool)
                keep[off[1:] + np.arange(n)] = False
                out[keep] = flat
                docs += some.column(0).to_pylist()
                sizes.append(np.diff(off) + 1)
                ids.append(out)
                if sum(map(len, ids)) >= FILE_IDS:
                    yield close()
        if docs:
            yield close()

    return run


def write(docs: DataFrame, file: str, folder: str, end_id: int | None = None, bits: int | None = None) -> list[dict]:
    """Writes the ids of all texts, in ascending doc_id order over all files; gives a row for each file.

    Rows: path, n_docs, n_ids, start (ids in all files before it). There are as many rows as files.
    """
    vocab = _tokens.tokenizer(file).get_vocab_size()
    bits = bits or max(1, int(max(vocab - 1, end_id or 0)).bit_length())
    end_id = vocab - 1 if end_id is None else end_id
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, slim.rdd.getNumPartitions())
    dealt = slim.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = sorted(dealt.mapInArrow(_spark.bounded(_writer(file, end_id, bits, folder)), "part int, k int, path string, n_docs long, n_ids long").collect())
    out, start = [], 0
    for r in rows:
        out.append({"path": r["path"], "n_docs": r["n_docs"], "n_ids": r["n_ids"], "start": start})
        start += r["n_ids"]
    return out


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            with _spark.opened(at) as source:
                yield from _digests(TokenFile(source), start, at)


def _digests(f: TokenFile, start: int, path: str) -> Iterator[pa.RecordBatch]:
    a, n = 0, len(f.doc_ids)
    while a < n:
        b = min(max(a + 1, int(np.searchsorted(f.first, f.first[a] + IDS, "right")) - 1), n)
        ids = f.range(int(f.first[a]), int(f.first[b]))
        off = f.first[a : b + 1] - f.first[a]
        raw = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.record_batch([pa.array(f.doc_ids[a:b], pa.int64()), pa.array(f.first[a:b] + start), pa.array(np.diff(off)), pa.array(crc, pa.int64()), pa.array([path] * (b - a))], ["doc_id", "start", "n_tokens", "ids_crc32", "path"])
        a = b


def digests(spark, files: list[dict]) -> DataFrame:
    """One row for each document in the files: doc_id, start, n_tokens, ids_crc32, path."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, path string"
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.sparkContext.parallelize([(x["path"], x["start"]) for x in files], len(files))
    return spark.createDataFrame(rows, "path string, start long").mapInArrow(_spark.bounded(_reader), schema)
