"""Token ids as length-delimited binary records, with a separate offset index.

A record is: its payload's length (unsigned 64 bits), the masked checksum of those 8 bytes (unsigned 32
bits), the payload, the masked checksum of the payload; all little-endian. The checksum is CRC-32 (that of
zlib; Python has no fast CRC-32C), rotated right by 15 bits plus 0xa282ead8, so that a checksum of data
that hold checksums stays sound. The payload is one byte (bytes of an id, plus 128 if doc_id is null), the
doc_id (signed 64 bits), then the ids, in 16 bits where the vocabulary allows. The index of a file is its
records' offsets and lengths, as pairs of signed 64-bit integers, for reads in any order.

Documents are sorted by doc_id (null first, ties by text, so that many of one id fill several ranges) into ranges; a task writes one file and its
index under a name of its own, and reports them in the manifest only when both are closed. A task that
runs again writes a new file, and what the manifest doesn't list doesn't count.

Null and empty texts give the end id alone; repeated rows and ids are written as often as they come. Other
columns of the input play no part. An empty table gives no file and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import Scratch, column, map_rows, rows
from .tokens import encoder, vocabulary

MASK_DELTA = 0xA282EAD8

#: Records written in one call.
TOGETHER = 256


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(record: bytes) -> bytes:
    """A record's payload; ValueError if a length or checksum is wrong."""
    length, crc = struct.unpack_from("<QI", record)
    if masked(record[:8]) != crc or len(record) != length + 16:
        raise ValueError("a record's length is damaged")
    payload = record[12:-4]
    if masked(payload) != struct.unpack_from("<I", record, len(record) - 4)[0]:
        raise ValueError("a record's payload is damaged")
    return payload


def pack(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack("<Bq", width | (128 if doc_id is None else 0), doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    width, doc_id = struct.unpack_from("<Bq", payload)
    return None if width & 128 else doc_id, np.frombuffer(payload, f"<u{width & 127}", offset=9).astype("<u4")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes the files to folder, a URI that all executors reach; the manifest: part, file, n_docs, n_tokens."""
    vocab = vocab or vocabulary()
    docs = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    # ranges see the beginnings of texts alone: their order is that of the texts, and samples stay small
    docs = docs.repartitionByRange("doc_id", F.substring("text", 1, 16)).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator) -> Iterator[dict]:
        from pyspark import TaskContext

        part, tok, name, at, index, n = TaskContext.get().partitionId(), encoder(vocab), uuid.uuid4().hex, 0, [], 0
        width, end = 2 if tok.size <= 1 << 16 else 4, struct.pack("<I", end_id)
        sink, held = None, []
        for d, raw in tok.stream(rows(batches, 0, 1)):
            if sink is None:
                store, path = opened(folder)
                store.create_dir(path, recursive=True)
                sink = store.open_output_stream(f"{path}/{name}.rec")
            tokens = np.frombuffer(raw + end, "<u4")
            held.append(frame(pack(d, tokens, width)))
            index += (at, len(held[-1]))
            at, n = at + len(held[-1]), n + len(tokens)
            if len(held) == TOGETHER:
                sink.write(b"".join(held))
                held = []
        if sink is not None:
            sink.write(b"".join(held))
            sink.close()
            with store.open_output_stream(f"{path}/{name}.idx") as f:
                f.write(np.array(index, "<i8").tobytes())
            yield {"part": [part], "file": [f"{folder}/{name}"], "n_docs": [len(index) // 2], "n_tokens": [n]}

    return map_rows(docs, run, "part int,file string,n_docs long,n_tokens long")


def read_index(file: str) -> np.ndarray:
    """Offset and length of each record of a file."""
    store, path = opened(f"{file}.idx")
    with store.open_input_stream(path) as f:
        return np.frombuffer(f.read(), "<i8").reshape(-1, 2)


def read_records(file: str, which: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of a file's records: all in order, or those asked for by number, in any order."""
    index = read_index(file)
    store, path = opened(f"{file}.rec")
    if which is None:
        with store.open_input_stream(path, buffer_size=1 << 20) as f:
            for _, length in index.tolist():
                yield unpack(unframe(f.read(length)))
    else:
        with store.open_input_file(path) as f:
            for offset, length in (index[i].tolist() for i in which):
                yield unpack(unframe(f.read_at(length, offset)))


def read_digests(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, read back file by file."""
    before = F.sum("n_tokens").over(W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1))  # a row for each file
    files = manifest.select("part", "file", F.coalesce(before, F.lit(0)).alias("base"))
    files = files.repartition(spark.sparkContext.defaultParallelism * 4, "part")

    def run(batches: Iterator) -> Iterator[dict]:
        for b in batches:
            for file, start in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                for d, ids in read_records(file):
                    for k, v in zip(out, (d, start, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                        out[k].append(v)
                    start += len(ids)
                yield out

    return map_rows(files, run, "doc_id long,start long,n_tokens long,ids_crc32 long")


def token_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes docs to the shared folder, reads the files back, and gives what was read."""
    scratch = Scratch(docs.sparkSession, "records")
    folder = scratch.path("files")
    manifest = scratch.table(write_records(docs, folder if "://" in folder or folder.startswith("file:") else f"file://{folder}", id_col, text_col, vocab, end_id), "manifest")
    return read_digests(docs.sparkSession, manifest)
