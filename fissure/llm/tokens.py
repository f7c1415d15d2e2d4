"""Token output: Arrow files of equal-length id sequences with masks.

A file is Arrow's random-access IPC format. Every record batch but the last has
the same number of rows, and each row is one sequence: `input_ids`, a
fixed-size list of unsigned ids, 16 bits wide where the vocabulary fits and else 32, and
`loss_mask`, a fixed-size list of booleans (one bit each), true for a real id and false for padding
behind the file's last id. Sequence i of a file is therefore at a known place of its memory map, and reading it copies nothing. Beside each
data file lies an index file with one row per document: doc_id, start (ids of
the file before it), n_tokens.
"""

from __future__ import annotations

import os
import posixpath
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fissure.llm.encoding import encoder, text_chunks
from fissure.llm.shared import materialise, new_folder, released, small_batches, table

END_ID = 1
SEQUENCE = 2048
ROWS_PER_BATCH = 64
MANIFEST = "part long, data_path string, index_path string, n_docs long, n_tokens long, n_sequences long"


def _filesystem(uri: str):
    """pyarrow's file system for a shared folder, and the path in it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Appends ids to a file as full sequences; pads only the last one."""

    def __init__(self, sink, sequence: int, narrow: bool):
        self.sequence = sequence
        self.dtype = np.uint16 if narrow else np.uint32
        self.schema = pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(self.dtype), sequence)), ("loss_mask", pa.list_(pa.bool_(), sequence))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.waiting: list[bytes] = []
        self.size = self.written = 0

    def add(self, ids: bytes) -> None:
        self.waiting.append(ids)
        self.size += len(ids)
        if self.size >= 4 * self.sequence * ROWS_PER_BATCH:
            self._flush()

    def _flush(self, last: bool = False) -> None:
        raw = b"".join(self.waiting)
        unit = 4 * self.sequence * ROWS_PER_BATCH
        end = len(raw) if last else len(raw) // unit * unit
        for at in range(0, end, unit):
            part = np.frombuffer(raw, "<u4", count=min(unit, end - at) // 4, offset=at)
            rows = -(-len(part) // self.sequence)
            ids, mask = np.zeros(rows * self.sequence, self.dtype), np.zeros(rows * self.sequence, bool)
            ids[: len(part)], mask[: len(part)] = part, True
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)]
            self.writer.write_batch(pa.record_batch(arrays, schema=self.schema))
            self.written += rows
        self.waiting, self.size = [raw[end:]], len(raw) - end

    def close(self) -> None:
        self._flush(last=True)
        self.writer.close()


def _write_partition(folder: str, path: str, sequence: int, end_id: int):
    """mapInArrow body: one data file and one index file per task, named by its attempt; the manifest tells which attempt counts."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        names = [posixpath.join(root, f"part-{part:06d}-{attempt}.{kind}.arrow") for kind in ("ids", "docs")]
        index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        end, enc = np.array([end_id], "<u4").tobytes(), encoder(path)
        docs = tokens = 0
        with fs.open_output_stream(names[0]) as sink, fs.open_output_stream(names[1]) as index_sink:
            ids, index = SequenceWriter(sink, sequence, max(enc.size - 1, end_id) < 1 << 16), pa.ipc.new_file(index_sink, index_schema)
            for batch in batches:
                for a, b, texts in text_chunks(batch.column(1)):
                    starts, counts = [], []
                    for raw in enc.encode(texts):
                        ids.add(raw + end)
                        starts.append(tokens)
                        counts.append(len(raw) // 4 + 1)
                        tokens += counts[-1]
                    docs += b - a
                    index.write_batch(pa.record_batch([batch.column(0).slice(a, b - a), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=index_schema))
            ids.close()
            index.close()
        if docs:
            row = [[part], *[[posixpath.join(folder, posixpath.basename(n))] for n in names], [docs], [tokens], [ids.written]]
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], ["part", "data_path", "index_path", "n_docs", "n_tokens", "n_sequences"])
        else:
            for name in names:
                fs.delete_file(name)

    return write


def write_tokens(docs: DataFrame, path: str, folder: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Encodes docs in ascending doc_id order into Arrow files under folder; returns their manifest.

    Files are named by partition and attempt, and partitions hold ascending ranges of
    doc_id, so file order is document order. A pair of files that the manifest lacks
    is that of an attempt that failed or came second. A null text is empty and gives the
    end id alone; null doc_ids come first; equal doc_ids are ordered by text, and repeated rows written each;
    an empty table writes no file. Columns besides doc_id and text are ignored.
    """
    folder = folder or new_folder(docs.sparkSession, "tokens")
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return materialise(rows.mapInArrow(released(_write_partition(folder, path, sequence, end_id)), MANIFEST), "manifest")


def _open(uri: str):
    fs, path = _filesystem(uri)
    if fs.type_name == "local":
        return pa.memory_map(path)
    return fs.open_input_file(path)


def read_sequence(data_path: str, i: int) -> tuple[pa.Array, pa.Array]:
    """Sequence i of a file and its mask: Arrow views of the memory map where the file is local."""
    batch = pa.ipc.open_file(_open(data_path)).get_batch(i // ROWS_PER_BATCH)
    return tuple(c[i % ROWS_PER_BATCH].values for c in batch.columns)


def _document_ids(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: rows (data_path, index_path, ahead) to a digest of each document's ids."""
    for batch in files:
        for row in batch.to_pylist():
            data, index = pa.ipc.open_file(_open(row["data_path"])), pa.ipc.open_file(_open(row["index_path"]))
            width = data.schema.field(0).type.list_size
            unit, held, view = width * ROWS_PER_BATCH, -1, None
            for i in range(index.num_record_batches):
                docs = index.get_batch(i)
                sums, starts, counts = [], docs.column(1).to_pylist(), docs.column(2).to_pylist()
                for start, count in zip(starts, counts, strict=True):
                    crc, at = 0, start
                    while at < start + count:
                        if at // unit != held:
                            held = at // unit
                            view = data.get_batch(held).column(0).flatten().to_numpy(zero_copy_only=True)
                        end = min(start + count, (held + 1) * unit)
                        crc = zlib.crc32(view[at - held * unit : end - held * unit].astype("<u4"), crc)
                        at = end
                    sums.append(crc)
                arrays = [docs.column(0), pa.array([row["ahead"] + s for s in starts], pa.int64()), docs.column(2), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start over all files, n_tokens, ids_crc32."""
    # One row per file; the order needs no more than their totals.
    ahead = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("data_path", "index_path", ahead.cast("long").alias("ahead"))
    return files.repartition("data_path").mapInArrow(_document_ids, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(manifest)
