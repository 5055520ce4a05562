"""Operator 1: token ids as length-delimited binary records with an offset index.

A record is: length of the payload (8 bytes), masked checksum of those 8 bytes (4), payload, masked checksum of
the payload (4); all little-endian. The payload is doc_id (8), whether there is one (1), bytes per id (1),
number of ids (4), ids. Ids take two bytes where the vocabulary allows. Beside each shard lies an index of
(offset, size) pairs, 16 bytes a record, so that a reader can visit records in any order.

Shards are ranges of doc_id: a lower shard holds lower ids, and records ascend within a shard (null ids first;
repeated ids by a hash of the text, which also parts them where ranges are cut). A task names its files after its attempt and reports them in the manifest; files of lost
attempts are never named, so a retry needs no clean-up. Memory: one Arrow batch, one block of ids and one
record. A null or empty text is a record that holds only the end id; rows that are equal in id and text are records
of their own; other columns are not looked at; an empty table gives no shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_path, parts, table, written
from .tokens import Encoder, crc, tokenizer_path

SHARD_BYTES = 64 << 20
#: Layouts, as text: compiled ones do not travel to executors.
_HEAD = "<qBBI"
_FRAME = "<QI"
MANIFEST = "part int, number int, path string, index_path string, records long, tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    """A crc32 rotated by 15 bits plus a constant, so that checksums of data holding checksums stay sound."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload at `at` and where the next record begins; ValueError on damage."""
    size, check = struct.unpack_from(_FRAME, data, at)
    if masked(bytes(data[at : at + 8])) != check:
        raise ValueError(f"damaged length at {at}")
    end = at + 12 + size
    payload = data[at + 12 : end]
    if len(payload) != size or masked(payload) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError(f"damaged record at {at}")
    return payload, end + 4


def pack(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack(_HEAD, doc_id or 0, doc_id is not None, width, len(ids)) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: memoryview) -> tuple[int | None, np.ndarray]:
    doc_id, known, width, n = struct.unpack_from(_HEAD, payload, 0)
    return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", n, struct.calcsize(_HEAD))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Shards:
    """Writes records into files of about SHARD_BYTES and keeps their manifest rows."""

    def __init__(self, folder: str, part: int, attempt: str, limit: int):
        self.fs, self.folder = _filesystem(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.uri, self.part, self.attempt, self.limit = folder, part, attempt, limit
        self.rows: list[tuple] = []
        self.out = None

    def add(self, doc_id: int | None, ids: np.ndarray, width: int) -> None:
        if self.out is None:
            self.name = f"part-{self.part:06d}-{len(self.rows):05d}-{self.attempt}"
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}.rec")
            self.index, self.at, self.tokens = [], 0, 0
        record = frame(pack(doc_id, ids, width))
        self.out.write(record)
        self.index += (self.at, len(record))
        self.at += len(record)
        self.tokens += len(ids)
        if self.at >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        with self.fs.open_output_stream(f"{self.folder}/{self.name}.idx") as f:
            f.write(np.asarray(self.index, "<u8").tobytes())
        self.rows.append((self.part, len(self.rows), f"{self.uri}/{self.name}.rec", f"{self.uri}/{self.name}.idx", len(self.index) // 2, self.tokens))
        self.out = None


def write_records(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes docs(doc_id, text) into shards under `folder` and returns the manifest."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "records")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = rows.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        shards = _Shards(folder, task.partitionId(), f"{task.stageId()}-{task.taskAttemptId()}", shard_bytes)
        encoder = Encoder(tokenizer)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, ids, counts in encoder.ids(batch.column(1)):
                at = 0
                for doc_id, n in zip(doc_ids[first : first + len(counts)], counts.tolist(), strict=True):
                    shards.add(doc_id, np.append(ids[at : at + n], end_id), width)
                    at += n
        shards.close()
        if shards.rows:
            names = [x.split()[0] for x in MANIFEST.split(", ")]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in shards.rows], pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("index_path", pa.string()), ("records", pa.int64()), ("tokens", pa.int64())]))

    return written(rows.mapInArrow(write, MANIFEST), "manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """Reads shards back: doc_id, start, n_tokens, ids_crc32 of every record.

    Starts come from the manifest alone, which has one row for each shard of SHARD_BYTES.
    """
    spark = manifest.sparkSession
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    shards = shards.select("path", "start").repartition(parts(spark), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, name = _filesystem(path)
                with system.open_input_file(name) as f:
                    data = memoryview(f.read_buffer())
                at, rows = 0, ([], [], [], [])
                while at < len(data):
                    payload, at = unframe(data, at)
                    doc_id, ids = unpack(payload)
                    for column, v in zip(rows, (doc_id, start, len(ids), crc(ids)), strict=True):
                        column.append(v)
                    start += len(ids)
                names = [x.split()[0] for x in READ.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names)

    return shards.mapInArrow(read, READ)


def read_at(path: str, index_path: str, positions) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records of one shard in the order asked for, through its index."""
    system, name = _filesystem(path)
    _, index_name = _filesystem(index_path)
    with system.open_input_file(index_name) as f:
        index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
    with system.open_input_file(name) as f:
        for i in positions:
            offset, size = map(int, index[i])
            f.seek(offset)
            yield unpack(unframe(memoryview(f.read(size)), 0)[0])


def op1_token_records(spark, sf_dir: str) -> DataFrame:
    return read_records(write_records(table(spark, sf_dir, "documents"), tokenizer_path(), 2))
