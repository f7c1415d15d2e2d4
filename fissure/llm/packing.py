"""Packing: harmonic classes of document lengths, filled by count, with gaps filled by cutting."""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from fissure.llm.encoding import encoder, text_chunks
from fissure.llm.shared import released, small_batches, table

CAPACITY = 2048
END_ID = 1
#: Ids that a worker packs together; it then closes all its sequences, so memory is bounded.
BLOCK_TOKENS = 1 << 21
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class HarmonicPacker:
    """Packs one block of documents without knowing of any other.

    A document of n <= capacity ids is in class capacity // n, and a sequence of
    class j holds exactly j documents of it. A longer document fills
    sequences of its own; its rest joins the reserve. What a class's sequence leaves
    free (less than a further document of the class) is filled with pieces cut from
    the reserve. At the end of the block, documents of unfilled classes join
    the reserve too, and where it runs out so do the documents of the emptiest sequences. What then remains of
    it is cut into full sequences, of which the last alone is padded.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list] = defaultdict(list)
        self.reserve: deque = deque()
        self.gaps: list[list] = []
        self.closed: list[list] = []

    def add(self, doc: int, n: int) -> None:
        start = 0
        while n - start > self.capacity or n - start == self.capacity:
            self.closed.append([(doc, start, self.capacity)])
            start += self.capacity
        if n == start:
            return
        if start:
            self.reserve.append((doc, start, n - start))
            return
        j = self.capacity // n
        self.open[j].append((doc, 0, n))
        if len(self.open[j]) == j:
            self.gaps.append(self.open.pop(j))

    def _free(self, sequence: list) -> int:
        return self.capacity - sum(length for _, _, length in sequence)

    def _fill(self, sequence: list) -> None:
        free = self._free(sequence)
        while free and self.reserve:
            doc, start, length = self.reserve.popleft()
            taken = min(free, length)
            sequence.append((doc, start, taken))
            if taken < length:
                self.reserve.appendleft((doc, start + taken, length - taken))
            free -= taken

    def finish(self) -> list[list]:
        for j in sorted(self.open):
            self.reserve.extend(self.open[j])
        gaps = deque(sorted(self.gaps, key=self._free))
        while gaps:
            sequence = gaps.popleft()
            self._fill(sequence)
            while self._free(sequence) and gaps:  # the reserve ran out: the emptiest sequence becomes part of it
                self.reserve.extend(gaps.pop())
                self._fill(sequence)
            self.closed.append(sequence)
        while self.reserve:
            rest: list = []
            self._fill(rest)
            self.closed.append(rest)
        return self.closed


def _pack(path: str, capacity: int, end_id: int, block_tokens: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        end, sequences = np.array([end_id], "<u4").tobytes(), 0
        docs: list = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal sequences, held
            packer = HarmonicPacker(capacity)
            for i, (_, raw) in enumerate(docs):
                packer.add(i, len(raw) // 4)
            out = [[] for _ in range(7)]
            for sequence in packer.finish():
                offset = 0
                for i, start, length in sequence:
                    doc_id, raw = docs[i]
                    crc = zlib.crc32(memoryview(raw)[4 * start : 4 * (start + length)])
                    for column, value in zip(out, (doc_id, start, length, crc, len(raw) // 4, (part << 40) + sequences, offset), strict=True):
                        column.append(value)
                    offset += length
                sequences += 1
            docs.clear()
            held = 0
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)

        enc = None
        for batch in batches:
            enc = enc or encoder(path)
            keys = batch.column(0).to_pylist()
            for a, b, texts in text_chunks(batch.column(1)):
                for key, raw in zip(keys[a:b], enc.encode(texts), strict=True):
                    docs.append((key, raw + end))
                    held += len(raw) // 4 + 1
                if held >= block_tokens:
                    yield close()
        if docs:
            yield close()

    return pack


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece of a document: which of its ids lie where in which sequence.

    Each input partition is packed by itself, in blocks of about block_tokens ids;
    nothing is shuffled, and a lost task gives the same pieces when it is run again.
    A null or empty text is a document of the end id alone. Null doc_ids
    and repeated rows are packed like others, each row by itself; an empty table
    gives no rows; columns besides doc_id and text are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    rows = small_batches(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(released(_pack(path, capacity, end_id, block_tokens)), PIECES)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
