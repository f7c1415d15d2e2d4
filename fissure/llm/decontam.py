"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment on words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fissure.llm.shared import materialise, released, same_columns, shared_value, small_batches, table
from fissure.llm.words import ALNUM, ngrams, word_hashes

MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the best possible score of an item from which a passage counts as a copy of it.
SCORE = 0.6
#: Words in a seed. A copy with a share f of its words lost or replaced scores 1 - 1.5 f, so one that counts has lost at most 4 in
#: 15 and somewhere keeps three words in a row.
SEED = 3
#: Chance occurrences in the whole corpus below which a seed is rare; seeds in a row of which the rarest is taken in any case.
CHANCE, STRETCH = 0.01, 8
#: Words searched on either side of where a seed puts an item, as a share of the item's length.
SLACK = 0.5
#: Bytes of benchmark text that are broadcast at once; a larger benchmark is taken in blocks.
BLOCK_BYTES = 16_000_000
#: Bytes of passages whose alignments a task remembers, as many documents may share them word for word.
MEMO_BYTES = 8_000_000


@dataclass
class Items:
    """A block of the benchmark: words of each item, and its distinct words sorted."""

    ids: list[int]
    words: list[np.ndarray]

    def vocabulary(self) -> np.ndarray:
        return np.unique(np.concatenate([*self.words, np.empty(0, np.uint64)]))


@dataclass
class Seeds:
    """Seed hashes of one number of words, sorted; for each, the item's index and the seed's place in it."""

    length: int
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two word sequences with linear gaps, and where it ends in the passage."""
    best, end = 0, 0
    row = np.zeros(len(passage) + 1, np.int32)
    ramp = np.arange(len(passage) + 1, dtype=np.int32) * -GAP
    for word in item:
        new = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        # Gaps along the row: the best of all values before, each less its distance.
        row = np.maximum.accumulate(new + ramp) - ramp
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def make_seeds(items: Items, counts: dict[int, int], total: int) -> list[Seeds]:
    """n-grams of items that the corpus's word counts make rare, and the rarest of every STRETCH; shorter items are one seed each.

    Rarity goes by the words' frequencies, not by the n-gram's own: a passage that
    thousands of documents copied is still found by its seeds.
    """
    return [s for n in range(1, SEED + 1) if len((s := _seeds_of(items, counts, total, n)).hashes)]


def _seeds_of(items: Items, counts: dict[int, int], total: int, n: int) -> Seeds:
    vocabulary = items.vocabulary()
    bits = np.log2(max(total, 2)) - np.log2(np.array([max(counts.get(i, 0), 1) for i in range(len(vocabulary))], float))
    needed = np.log2(max(total, 2)) - np.log2(CHANCE)
    found = []
    for k, words in enumerate(items.words):
        if min(len(words), SEED) != n:
            continue
        grams = ngrams(words, n)
        info = np.convolve(bits[np.searchsorted(vocabulary, words)], np.ones(n), "valid")
        taken = info >= needed
        taken[[at + int(info[at : at + STRETCH].argmax()) for at in range(0, len(info), STRETCH)]] = True
        places = np.flatnonzero(taken)
        found.append((grams[places], np.full(len(places), k), places))
    if not found:
        return Seeds(n, *(np.empty(0, t) for t in (np.uint64, np.int64, np.int64)))
    hashes, item, place = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(hashes, kind="stable")
    return Seeds(n, hashes[order], item[order], place[order])


def _windows(hits: list[tuple[int, int]], length: int, words: int) -> list[tuple[int, int]]:
    """Merged ranges of a document's words where seeds (document place, item place) put an item."""
    slack = max(int(length * SLACK), SEED)
    out: list[tuple[int, int]] = []
    for begin in sorted({d - i for d, i in hits}):
        a, b = max(begin - slack, 0), min(begin + length + slack, words)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class Memo:
    """Alignments of an item with a passage, forgotten once the passages take more than MEMO_BYTES."""

    def __init__(self) -> None:
        self.held: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        self.size = 0

    def of(self, items: Items, k: int, passage: np.ndarray) -> tuple[int, int, int]:
        """Score, where the alignment ends in the passage, and how many of its words it covers."""
        key = (k, passage.tobytes())
        if key not in self.held:
            item = items.words[k]
            score, end = align(item, passage)
            length = align(item[::-1], passage[:end][::-1])[1] if score >= SCORE * MATCH * len(item) else 0
            self.size += len(key[1]) + 300
            if self.size > MEMO_BYTES:
                self.held, self.size = {}, len(key[1])
            self.held[key] = (score, end, length)
        return self.held[key]


def _hits(words: np.ndarray, seeds: list[Seeds]) -> dict[int, list[tuple[int, int]]]:
    """(document place, item place) of the seeds that a document holds, by item."""
    by_item: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for some in seeds:
        grams = ngrams(words, some.length)
        first = np.searchsorted(some.hashes, grams)
        for d in np.flatnonzero(some.hashes[np.minimum(first, len(some.hashes) - 1)] == grams).tolist():
            i = int(first[d])
            while i < len(some.hashes) and some.hashes[i] == grams[d]:
                by_item[int(some.item[i])].append((d, int(some.place[i])))
                i += 1
    return by_item


def _scan(words: np.ndarray, items: Items, seeds: list[Seeds], memo: Memo) -> list[tuple[int, float, int, int]]:
    """(item index, score, first word, words) for each item that a document holds a copy of."""
    out = []
    for k, hits in _hits(words, seeds).items():
        item, best = items.words[k], (0, 0, 0)
        for a, b in _windows(hits, len(item), len(words)):
            score, end, length = memo.of(items, k, words[a:b])
            best = max(best, (score, -(a + end - length), length))
        if best[0] >= SCORE * MATCH * len(item):
            out.append((k, best[0] / (MATCH * len(item)), -best[1], best[2]))
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def _word_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[dict[int, int], int]:
    """Occurrences in all documents of the benchmark's words, by their index, and of all words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums, total = shared.value, np.zeros(len(shared.value) + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    words = word_hashes(text, ALNUM)
                    total += len(words)
                    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                    np.add.at(sums, at[known[at] == words], 1)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int64()), pa.array([total, *sums[some].tolist()], pa.int64())], ["word", "n"])

    rows = _texts(docs).select("text").mapInArrow(released(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # At most one row for each benchmark word of the block.
    counts = {r["word"]: r["n"] for r in rows.collect()}
    return counts, counts.pop(-1, 0)


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).filter("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for i in range(blocks):
        some = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).distinct().collect()
        some = sorted((r for r in some if r["item_id"] is not None), key=lambda r: (r["item_id"], bytes(r["text"])))
        yield Items([r["item_id"] for r in some], [word_hashes(bytes(r["text"]), ALNUM) for r in some])


def find_copies(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, first_word, n_words): documents that hold a copy of a benchmark item.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. A document
    that shares a rare seed of SEED words with an item is aligned with it around each place; score
    is the alignment's share of the item's best one, and rows have at least SCORE. first_word and n_words tell
    where the best alignment lies. The benchmark is a query set: it is broadcast in blocks of bounded size, and each block scans all documents,
    so no pair of rows is shuffled, however many documents share a passage.

    An item of fewer than SEED words is found where all of them stand in a row. A copy with so many words put between the
    item's own that no three of them stay together is not found, though it may score enough.

    Null texts and texts or items without words match nothing; null item_ids are left out; a null doc_id
    is reported as null; repeated rows are reported each; one row for an item_id that repeats, its best; empty tables give no
    rows; other columns are ignored.
    """
    spark, out = docs.sparkSession, None
    schema = "doc_id long, item_id long, score double, first_word long, n_words long"
    for items in _blocks(benchmark):
        if not any(len(w) for w in items.words):
            continue
        seeds = make_seeds(items, *_word_counts(docs, items.vocabulary()))
        shared = shared_value(spark, (items, seeds))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            (items, seeds), memo = shared(), Memo()
            for batch in batches:
                rows = []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    best: dict[int, tuple] = {}
                    for k, *found in _scan(word_hashes(text, ALNUM), items, seeds, memo) if text else ():
                        item = items.ids[k]
                        best[item] = max(best.get(item, (0,)), tuple(found))
                    rows += [(key, item, *found) for item, found in sorted(best.items())]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "score", "first_word", "n_words"])

        found = _texts(docs).mapInArrow(released(scan), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def without_copies(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no copy of a benchmark item; null doc_ids stay."""
    copies = materialise(find_copies(docs, benchmark).select("doc_id").distinct(), "copies")
    few = copies.count() <= 1_000_000
    return docs.join(F.broadcast(copies) if few else copies, "doc_id", "left_anti").select(same_columns(docs))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
