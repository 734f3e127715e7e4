"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A record is: u64 length of the payload, u32 masked CRC-32 of those eight bytes, the payload,
u32 masked CRC-32 of the payload; all little-endian. The payload holds a document's ids, as u16
where the vocabulary allows, else as u32. Masking turns the checksum by 15 bits and adds a constant, so that a checksum over
data that holds checksums keeps its worth.

`write_records` deals the documents by ranges of doc_id, sorts each range, and lets each task
write one file under a name of its own attempt, which it renames once complete: a task that is
run again, on any executor, leaves the same file. The index is a Parquet table of (file, place
in it, doc_id, byte offset, number of ids). `read_records` reads any rows of it, in any order.

A null text counts as empty: its record holds the end id alone. A null doc_id sorts first; rows
with equal ids follow each other by their text, so that repeated rows are each written. An
empty table gives an index without rows. Other columns are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import portions, shared_dir, width
from .token_ids import encoder

MASK_ADD = 0xA282EAD8  # fixed value of the record format
INDEX = "file int, place long, doc_id long, offset long, n_tokens long"
#: Ids that are read before a batch goes on.
FLUSH = 1 << 20


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_ADD) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframed(record: bytes) -> bytes:
    (length,) = struct.unpack_from("<Q", record)
    payload = record[12 : 12 + length]
    if struct.unpack_from("<I", record, 8)[0] != masked_crc(record[:8]) or struct.unpack_from("<I", record, 12 + length)[0] != masked_crc(payload):
        raise ValueError("a record's checksum does not match")
    return payload


def id_type(tokenizer: str) -> np.dtype:
    """The narrowest unsigned type for the vocabulary's ids."""
    return np.dtype("<u2" if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "<u4")


def _name(file: int) -> str:
    return f"part-{file:06d}.rec"


def write_records(docs: DataFrame, to: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files below `to` and the index to `to`/index; return the index."""
    spark = docs.sparkSession
    fs.FileSystem.from_uri(to)[0].create_dir(fs.FileSystem.from_uri(f"{to}/files")[1])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        file, place, offset = context.partitionId(), 0, 0
        store, path = fs.FileSystem.from_uri(f"{to}/files")
        temporary = f"{path}/.{_name(file)}.{context.taskAttemptId()}"
        out = None
        for batch in portions(batches, lambda b: b.column("text")):
            ids, at = encoder(tokenizer).encode(batch.column("text"))
            kind = id_type(tokenizer)
            raw, end, size = ids.astype(kind).tobytes(), np.array([end_id], kind).tobytes(), kind.itemsize
            records = [framed(raw[size * at[i] : size * at[i + 1]] + end) for i in range(batch.num_rows)]
            out = out or store.open_output_stream(temporary)
            out.write(b"".join(records))
            sizes = np.array([len(r) for r in records], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(records), file, np.int32)),
                    pa.array(np.arange(place, place + len(records))),
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(offset + np.cumsum(sizes) - sizes),
                    pa.array((sizes - 16) // size),
                ],
                names=["file", "place", "doc_id", "offset", "n_tokens"],
            )
            place, offset = place + len(records), offset + int(sizes.sum())
        if out:
            out.close()
            store.move(temporary, f"{path}/{_name(file)}")

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(width(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, INDEX).write.parquet(f"{to}/index")
    return spark.read.schema(INDEX).parquet(f"{to}/index")


def read_records(index: DataFrame, to: str) -> DataFrame:
    """The rows of `index` (any subset, in any order) with `ids`: what is read at their offsets, as u32."""

    def ids(record: bytes, n: int) -> bytes:
        payload = unframed(record)
        return payload if len(payload) == 4 * n else np.frombuffer(payload, "<u2").astype("<u4").tobytes()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(f"{to}/files")
        file, source = None, None
        for batch in batches:
            payloads: list[bytes] = []
            done = 0
            where = zip(batch.column("file").to_pylist(), batch.column("offset").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True)
            held = 0
            for i, (number, offset, n) in enumerate(where):
                if number != file:
                    if source:
                        source.close()
                    file, source = number, store.open_input_file(f"{path}/{_name(number)}")
                (size,) = struct.unpack("<Q", source.read_at(8, offset))
                payloads.append(ids(source.read_at(size + 16, offset), n))
                held += n
                if held > FLUSH or i == batch.num_rows - 1:
                    part = batch.slice(done, i + 1 - done)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payloads, pa.binary())], names=[*part.schema.names, "ids"])
                    payloads, done, held = [], i + 1, 0
        if source:
            source.close()

    return index.select("file", "place", "doc_id", "offset", "n_tokens").mapInArrow(read, f"{INDEX}, ids binary")


def record_digest(docs: DataFrame, tokenizer: str, end_id: int = 0, to: str | None = None) -> DataFrame:
    """Write the records, read them back: doc_id, start, n_tokens, ids_crc32 of each."""
    to = to or shared_dir(docs.sparkSession, "records")
    index = write_records(docs, to, tokenizer, end_id)
    read = read_records(index, to).select("file", "place", "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    # What lies before each file: one row for each file, which are as few as the writing tasks.
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    before = files.select("file", F.coalesce(F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("place")) - F.col("n_tokens")
    return read.join(F.broadcast(before), "file").select("doc_id", (F.col("before") + inside).alias("start"), "n_tokens", "ids_crc32")
