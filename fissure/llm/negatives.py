"""Hard negatives: exact integer scores of anchors against all rows, several candidates in each wide integer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fissure.llm.shared import materialise, released, table

#: Components of the candidates that a task holds at once, and the least rows of a chunk where there is work for all tasks.
CHUNK_VALUES, LEAST_ROWS = 1 << 22, 512
#: Scores in memory at once, and bits that a double holds of a whole number.
SLICE_SCORES, WIDE_BITS = 1 << 20, 53
#: Fields of a wide integer where a single field outgrows a double.
MANY_FIELDS = 4
CODED = "vec_id long, label int, anchor boolean, dim int, raw binary"


class Packed:
    """Candidates of one length, packed for products with anchors.

    Components are biased to be at least 0. A wide integer holds one component of several candidates, each in a field wide
    enough for a whole inner product of biased components; a product with an anchor's component
    multiplies all fields at once, sums stay inside their fields, and the biases come off after unpacking. Where the
    fields of two or more candidates fit into 53 bits, or one does, the wide integer is a double: every product and sum is a whole
    number below 2^53, so the matrix product is exact in any order. Beyond that it is an unbounded integer.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        order = np.lexsort((labels, ids))  # by id: a place then breaks ties
        self.vectors, self.ids, self.labels = vectors[order], ids[order], labels[order]
        self.low = int(self.vectors.min(initial=0))
        self.top = int(self.vectors.max(initial=0)) - self.low
        self.sums = self.vectors.sum(1)
        self.packed: dict[int, np.ndarray] = {}

    def _wide(self, bits: int) -> tuple[np.ndarray, int]:
        """Wide integers (a row for each group of candidates) with fields of so many bits."""
        small = bits <= WIDE_BITS
        fields = WIDE_BITS // bits if small else MANY_FIELDS
        if bits not in self.packed:
            n, d = self.vectors.shape
            rows = -(-n // fields)
            biased = np.zeros((fields * rows, d), np.float64 if small else object)
            biased[:n] = (self.vectors if small else self.vectors.astype(object)) - self.low
            wide = biased[:rows].copy()
            for f in range(1, fields):
                wide += biased[f * rows : (f + 1) * rows] * (float(1 << bits * f) if small else 1 << bits * f)
            self.packed = {bits: wide}
        return self.packed[bits], fields

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products, anchors by candidates; those beyond 64 bits fail the job."""
        n, d = self.vectors.shape
        low = int(anchors.min(initial=0))
        bits = max(1, (d * self.top * (int(anchors.max(initial=0)) - low)).bit_length())
        wide, fields = self._wide(bits)
        if bits <= WIDE_BITS:
            products = ((anchors - low).astype(np.float64) @ wide.T).astype(np.int64)
            sums, of_anchors = self.sums, anchors.sum(1)
        else:
            products = (anchors.astype(object) - low) @ wide.T
            sums, of_anchors = self.vectors.astype(object).sum(1), anchors.astype(object).sum(1)
        mask = (1 << bits) - 1
        unpacked = np.concatenate([products >> bits * f & mask for f in range(fields)], axis=1)[:, :n]
        exact = unpacked + (self.low * of_anchors)[:, None] + (low * sums)[None, :] - d * low * self.low
        if exact.dtype == object:
            if exact.size and max(abs(exact.max()), abs(exact.min())) >= 1 << 63:
                raise OverflowError("a score has more than 64 bits")
            exact = exact.astype(np.int64)
        return exact


def _first(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k greatest allowed scores, greatest first, equal ones by column."""
    n = scores.shape[1]
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if max(abs(int(scores.max())), abs(int(scores.min()))) >= 1 << 40:  # ranks in place of scores that would overflow below
        scores = np.unique(scores, return_inverse=True)[1].reshape(scores.shape)
    worst, k = np.iinfo(np.int64).min, min(k, n)
    keys = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), worst)
    at = np.argpartition(keys, n - k, axis=1)[:, n - k :]
    best = np.take_along_axis(keys, at, 1)
    order = np.argsort(-best, axis=1)
    at, best = np.take_along_axis(at, order, 1), np.take_along_axis(best, order, 1)
    row, place = np.nonzero(best != worst)
    return row, at[row, place]


def _coded(scale: float):
    """mapInArrow body: (vec_id, label, anchor, embedding) to whole components as bytes, 2, 4 or 8 for each as a row needs."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(3)
            ends = vectors.offsets.to_numpy()
            whole = np.floor(vectors.values.to_numpy(zero_copy_only=False) * scale)
            if len(whole) and np.abs(whole[ends[0] : ends[-1]]).max(initial=0) >= 2.0**62:
                raise OverflowError("a component has more than 62 bits")
            whole, raw = whole.astype(np.int64), []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                x = whole[a:b]
                most = int(np.abs(x).max(initial=0))
                raw.append(x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends), pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "label", "anchor", "dim", "raw"])

    return code


def _vectors(raw: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(raw), dim), np.int64)
    widths = np.array([len(x) // dim if dim else 0 for x in raw])
    for w in np.unique(widths[widths > 0]):
        at = np.flatnonzero(widths == w)
        out[at] = np.frombuffer(b"".join(raw[i] for i in at), f"<i{w}").reshape(-1, dim)
    return out


def _mined(pick):
    """mapInArrow body over partitions sorted by (chunk, dim, side): holds a chunk's candidates and streams the anchors past them.

    pick(packed, scores, anchors) gives the output columns for a slice of anchors.
    """

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, packed, waiting = None, None, []
        for batch in batches:
            chunk, dim, side = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero((np.diff(chunk) != 0) | (np.diff(dim) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(chunk)], strict=True):
                part = batch.slice(a, b - a)
                key = (int(chunk[a]), int(dim[a])) if b > a else held
                if key != held:
                    held, packed, waiting = key, None, []
                if b > a and side[a] == 0:
                    waiting.append((_vectors(part.column(5).to_pylist(), key[1]), part.column(3).to_numpy(), part.column(4).to_numpy()))
                    continue
                if packed is None and waiting:
                    packed, waiting = Packed(*map(np.concatenate, zip(*waiting, strict=True))), []
                if packed is None:
                    continue  # no candidate of this length
                step = max(1, SLICE_SCORES // max(1, len(packed.ids)))
                for at in range(0, b - a, step):
                    some = part.slice(at, step)
                    found = pick(packed, packed.scores(_vectors(some.column(5).to_pylist(), key[1])), some)
                    if len(found[0]):
                        yield found

    return mine


def _positives(k: int):
    def pick(packed: Packed, scores: np.ndarray, some: pa.RecordBatch) -> pa.RecordBatch:
        ids, labels, marks = (some.column(i).to_numpy() for i in (3, 4, 6))
        row, at = _first(scores, (packed.labels[None, :] == labels[:, None]) & (packed.ids[None, :] != ids[:, None]), k)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row], marks[row], packed.ids[at], scores[row, at])], ["anchor_id", "mark", "positive_id", "positive_score"])

    return pick


def _negatives(k: int, low: int, high: int):
    names = ["anchor_id", "mark", "place", "positive_id", "positive_score", "negative_id", "negative_score"]

    def pick(packed: Packed, scores: np.ndarray, some: pa.RecordBatch) -> pa.RecordBatch:
        ids, labels, marks = (some.column(i).to_numpy() for i in (3, 4, 6))
        lists, out = some.column(7).to_pylist(), []
        other = (packed.labels[None, :] != labels[:, None]) & (packed.ids[None, :] != ids[:, None])
        for place in range(max(map(len, lists), default=0)):
            rows = np.array([i for i, found in enumerate(lists) if len(found) > place])
            positive = [lists[i][place] for i in rows]
            least = np.array([-(-low * p["positive_score"] // 100) for p in positive])[:, None]
            most = np.array([high * p["positive_score"] // 100 for p in positive])[:, None]
            here = scores[rows]
            row, at = _first(here, other[rows] & (here >= least) & (here <= most), k)
            mine = rows[row]
            out.append((ids[mine], marks[mine], np.full(len(row), place + 1), np.array([p["positive_id"] for p in positive], np.int64)[row], np.array([p["positive_score"] for p in positive], np.int64)[row], packed.ids[at], here[row, at]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names)

    return pick


def hard_negatives(rows: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """For each anchor and each of its nearest rows of the same label, the nearest rows of other labels within a margin of scores.

    rows: vec_id, label, embedding. Components become floor(scale * x), scores are exact inner products; greater scores come
    first, ties by smaller vec_id. An anchor's positives are its first rows of the same label; a positive's negatives are
    the first rows of other labels whose score is from low to high percent of the positive's.

    All rows are scored against all anchors, a stated query set, in blocks: candidates are dealt into chunks of bounded size by
    hash, anchors visit every chunk, and a chunk gives at most `positives` or `negatives` rows for each question. Nothing is sampled or left out.

    Rows with a null vec_id, label or vector, or with a null or non-finite component take no part. Vectors of different lengths
    have no product and never meet; empty vectors score 0. Rows of an anchor's own vec_id are never its partners. Rows that repeat
    vec_id, label and vector count once; a vec_id with several labels or vectors stands for a row each. An anchor without positives, and a positive
    without negatives, give no row. An empty table gives none; other columns are ignored. Components
    beyond 62 bits and scores beyond 64 fail the job.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    """
    spark = rows.sparkSession
    v = F.col("embedding").cast("array<double>")
    usable = F.forall(v, lambda x: F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False)))
    part = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), v.alias("embedding"))
    part = part.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(usable, F.lit(False)))
    if not part.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        part = part.distinct()
    coded = materialise(part.mapInArrow(released(_coded(float(scale))), CODED), "coded")

    total = coded.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("dim"), F.lit(0)).alias("numbers")).first()
    chunks = max(1, -(-total["numbers"] // CHUNK_VALUES), min(3 * spark.sparkContext.defaultParallelism, -(-total["rows"] // LEAST_ROWS)))
    key = ["chunk", "dim", "side"]
    candidates = coded.select(F.pmod(F.xxhash64("vec_id", "label", "raw"), F.lit(chunks)).cast("int").alias("chunk"), "dim", F.lit(0).alias("side"), "vec_id", "label", "raw")
    anchors = coded.filter("anchor").select("dim", "vec_id", "label", "raw", F.xxhash64("label", "raw").alias("mark"))

    def past_all(asking: DataFrame, pick, schema: str) -> DataFrame:
        """Every chunk's answer to every anchor."""
        visits = asking.withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))), "side": F.lit(1)})
        both = candidates.unionByName(visits, allowMissingColumns=True).select(*key, "vec_id", "label", "raw", *[c for c in asking.columns if c not in ("dim", "vec_id", "label", "raw")])
        return both.repartition(chunks, "chunk").sortWithinPartitions(*key).mapInArrow(released(_mined(pick)), schema)

    def ranked(found: DataFrame, by: list[str], score: str, other: str, most: int) -> DataFrame:
        at = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), other))
        return found.withColumn("rank", at).filter(F.col("rank") <= most)

    near = ranked(past_all(anchors, _positives(positives), "anchor_id long, mark long, positive_id long, positive_score long"), ["anchor_id", "mark"], "positive_score", "positive_id", positives)
    lists = near.groupBy(F.col("anchor_id").alias("vec_id"), "mark").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("positives"))
    asking = materialise(anchors.join(lists, ["vec_id", "mark"]).select("dim", "vec_id", "label", "raw", "mark", "positives"), "asking")
    schema = "anchor_id long, mark long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    hard = ranked(past_all(asking, _negatives(negatives, low, high), schema), ["anchor_id", "mark", "place"], "negative_score", "negative_id", negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh vector are moved on by one, as noise; every hundredth vector is an anchor."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)
