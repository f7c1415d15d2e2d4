"""Near-duplicate documents: SetSketch registers in bands, joint likelihood, exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fissure.llm.components import connected_components
from fissure.llm.shared import materialise, released, same_columns, small_batches, table
from fissure.llm.words import NOT_SPACE, shingle_set, stream, word_hashes

#: Registers: base of the exponential spacing, rate, largest value (fits 16 bits).
SPACING, RATE, LARGEST = 1.001, 20.0, (1 << 16) - 1
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
_FACTORS = stream(3, REGISTERS) | np.uint64(1)
#: Standard errors by which the likelihood must speak against a pair before it is left out.
SURE = 6.0
#: Ids that are broadcast to filter a scan; a longer list is joined by shuffle.
BROADCAST_IDS = 1_000_000
LONG = pa.int64()
#: Classes of a bucket that all its classes are compared with.
PIVOTS = 4
#: Shingles of a side of the blocks that compare what is then still apart, and columns of their products.
SIDE, COLUMNS = 1 << 20, 4096
#: Buckets with more than this share of all rows are dealt over several tasks, if they hold more rows than PART_ROWS.
HOT_SHARE, PART_ROWS = 1000, 1000
#: Rows that a Python task works on at once.
SLICE = 256


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set: truncated logarithms of the least of exponential values.

    Register i depends on the least value alone that the i-th hash gives any element,
    so the registers of a union are the elementwise maxima of the registers.
    """
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(least, (shingles[None, i : i + 512] * _FACTORS[:, None]).min(axis=1), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(SPACING)), 0, LARGEST).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def _log_likelihood(j: np.ndarray, u: np.ndarray, v: np.ndarray, more: np.ndarray, less: np.ndarray, equal: np.ndarray) -> np.ndarray:
    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * (SPACING - 1) / SPACING) / np.log(SPACING)

    p, q = chance(u - v * j), chance(v - u * j)
    tiny = 1e-12
    return more * np.log(np.maximum(p, tiny)) + less * np.log(np.maximum(q, tiny)) + equal * np.log(np.maximum(1 - p - q, tiny))


def likely(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs the registers do not rule out at Jaccard similarity `least`, and the estimates.

    ra, rb: registers by pair; na, nb: set sizes. The similarity's joint likelihood is that of
    how often one register is larger, smaller or equal. A pair is ruled out if
    its best value lies below `least` and is more likely than that by SURE standard errors.
    """
    more, less = (ra > rb).sum(1).astype(float), (ra < rb).sum(1).astype(float)
    equal = ra.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u
    most = np.minimum(na, nb) / np.maximum(na, nb)
    grid = np.linspace(0, 1, 65)[None, :] * most[:, None]
    columns = [x[:, None] for x in (u, v, more, less, equal)]
    ll = _log_likelihood(grid, *columns)
    best = ll.argmax(1)
    estimate = grid[np.arange(len(grid)), best]
    at = _log_likelihood(np.minimum(least, most), u, v, more, less, equal)
    keep = (most >= least - 1e-12) & ((estimate >= least) | (ll.max(1) - at <= SURE**2 / 2))
    return keep, estimate


def _slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches in slices of few rows, so that what is made of them takes little memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int | None, np.ndarray]]:
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        yield key, shingle_set(word_hashes(text, NOT_SPACE), n) if text else np.empty(0, np.uint64)


def sketch_documents(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit identity, and its registers (null for an empty set)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in _slices(batches):
            keys, sizes, marks, found = [], [], [], []
            for key, shingles in _sets(batch, n):
                keys.append(key)
                sizes.append(len(shingles))
                marks.append(xxh3_128_digest(shingles.tobytes()))
                found.append(registers(shingles).tobytes() if len(shingles) else None)
            high, low = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2).T if marks else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(keys, LONG), pa.array(sizes, LONG), pa.array(high, LONG), pa.array(low, LONG), pa.array(found, pa.binary())], ["doc_id", "n_shingles", "set_high", "set_low", "registers"])

    rows = _texts(docs)
    return rows.mapInArrow(released(sketch), "doc_id long, n_shingles long, set_high long, set_low long, registers binary")


def _texts(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def _near_sizes(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the registers do not rule out."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            keep, _ = likely(ra, rb, batch.column("na").to_numpy().astype(float), batch.column("nb").to_numpy().astype(float), percent / 100)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    right = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(released(estimate), "a long, b long")


def _set_marks(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, and its set's 128-bit identity (set_high, set_low) and elements; an empty set has no identity."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in _slices(batches):
            found = list(_sets(batch, n))
            marks = [np.frombuffer(xxh3_128_digest(s.tobytes()), np.int64).tolist() if len(s) else (None, None) for _, s in found]
            columns = [pa.array([k for k, _ in found], LONG), *[pa.array([m[i] for m in marks], LONG) for i in (0, 1)], pa.array([s.tobytes() for _, s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "set_high", "set_low", "shingles"])

    return docs.mapInArrow(released(sets), "doc_id long, set_high long, set_low long, shingles binary")


def _with_sets(rows: DataFrame, n: int) -> DataFrame:
    """rows (p_row, p_doc_id, p_text) with the identity of each text's set as p_high and p_low, null for an empty one."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in _slices(batches):
            found = [shingles for _, shingles in _sets(batch.select(["p_doc_id", "p_text"]), n)]
            marks = [np.frombuffer(xxh3_128_digest(s.tobytes()), np.int64).tolist() if len(s) else (None, None) for s in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([m[i] for m in marks], LONG) for i in (0, 1)]], [*batch.schema.names, "p_high", "p_low"])

    return rows.mapInArrow(released(add), StructType([*rows.schema.fields, StructField("p_high", LongType()), StructField("p_low", LongType())]))


def _shingles(reps: DataFrame, classes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(id, shingles): the sets of the given classes, from a second pass over the texts of their smallest doc_ids."""
    wanted = materialise(classes.join(reps.toDF("rep").distinct(), "rep", "left_semi").select("rep", "first_id", "set_high", "set_low"), "candidates")
    ids = wanted.select(F.col("first_id").alias("doc_id"))
    few = ids.count() <= BROADCAST_IDS
    texts = _texts(docs).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    found = _set_marks(texts, n).withColumnRenamed("doc_id", "first_id").join(F.broadcast(wanted) if few else wanted, ["first_id", "set_high", "set_low"])
    return materialise(found.select(F.col("rep").alias("id"), "shingles").dropDuplicates(["id"]), "shingles")


def _common(s: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Elements of s in each of several sorted sets, which lie one behind the other."""
    at = np.minimum(np.searchsorted(s, others), len(s) - 1)
    return np.add.reduceat((s[at] == others).astype(np.int64), np.cumsum(sizes) - sizes)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            keep = []
            for x, y in zip(batch.column("xs").to_pylist(), batch.column("ys").to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = int(_common(s, t, np.array([len(t)]))[0])
                keep.append(100 * common >= percent * (len(s) + len(t) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = _shingles(pairs.select(F.explode(F.array("a", "b"))), classes, docs, n)
    left, right = found.select(F.col("id").alias("a"), F.col("shingles").alias("xs")), found.select(F.col("id").alias("b"), F.col("shingles").alias("ys"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(released(similar), "a long, b long")


def _in_common(left: list[np.ndarray], right: list[np.ndarray], several: np.ndarray) -> np.ndarray:
    """Elements that each of some sets shares with each of others, as products of incidence matrices; several holds, sorted, those that stand in two sets or more."""

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(column, row) of each element that several sets have, by column."""
        flat, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(several, flat)
        known = several[np.minimum(at, len(several) - 1)] == flat
        order = np.argsort(at[known], kind="stable")
        return at[known][order], rows[known][order]

    out = np.zeros((len(left), len(right)), np.float32)  # counts far below 2^24 are exact
    if len(several):
        sides = [places(left), places(right)]
        for first in range(0, len(several), COLUMNS):
            parts = []
            for (column, row), n in zip(sides, out.shape, strict=True):
                a, b = np.searchsorted(column, [first, first + COLUMNS])
                part = np.zeros((n, min(COLUMNS, len(several) - first)), np.float32)
                part[row[a:b], column[a:b] - first] = 1
                parts.append(part)
            out += parts[0] @ parts[1].T
    return out


def _across(percent: int):
    """applyInPandas body: links of a block's left rows to right rows of other components, one for each such component."""

    def across(block: pd.DataFrame) -> pd.DataFrame:
        block = block.assign(at=np.arange(len(block)))
        sets = [np.frombuffer(x, np.uint64) for x in block["shingles"]]
        left, right = block[block["is_left"]], block[block["is_right"]]
        out = []
        if len(left) and len(right):
            once = block.drop_duplicates("rep")["at"]
            values, counts = np.unique(np.concatenate([sets[i] for i in once]), return_counts=True)
            common = _in_common([sets[i] for i in left["at"]], [sets[i] for i in right["at"]], values[counts > 1]).astype(np.int64)
            sizes = [np.array([len(sets[i]) for i in side["at"]]) for side in (left, right)]
            linked = 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)
            linked &= left["root"].to_numpy()[:, None] != right["root"].to_numpy()[None, :]
            rep, root = right["rep"].to_numpy(), right["root"].to_numpy()
            for i in np.flatnonzero(linked.any(1)):
                hit = np.flatnonzero(linked[i])
                _, first = np.unique(root[hit], return_index=True)
                out += [(left["rep"].iat[i], rep[j]) for j in hit[first]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return across


def _links_across(met: DataFrame, components: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Links between classes that meet in a bucket and that the pivots have left in different components.

    A bucket's classes are compared under its most frequent component: those outside it with all. Buckets
    with the same one share that work, and blocks whose sides hold a bounded number of shingles split it. Blocks
    give a link for each two components that they tie, never pairs.
    """
    placed = met.join(components.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep")).select("key", "rep", "n", "root")
    shares = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mains = shares.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("n").alias("size"))
    split = mains.filter(f"roots > 1 and size > {PIVOTS + 1}").select("key", "main")
    members = materialise(placed.join(split, "key").select("main", "rep", "n", "root").distinct(), "members")
    found = _shingles(members.select("rep"), classes, docs, n)
    parts = lambda c: F.greatest(F.ceil(F.sum(c) / SIDE), F.lit(1)).cast("int")
    counts = members.groupBy("main").agg(parts(F.when(F.col("root") != F.col("main"), F.col("n")).otherwise(0)).alias("lefts"), parts(F.col("n")).alias("rights"))
    rows = members.drop("n").join(counts, "main").withColumns({"at_left": F.pmod(F.xxhash64("rep"), F.col("lefts")).cast("int"), "at_right": F.pmod(F.xxhash64("rep"), F.col("rights")).cast("int")})

    def block(i, j, is_left, is_right):
        return F.struct(i.alias("i"), j.alias("j"), F.lit(is_left).alias("is_left"), F.lit(is_right).alias("is_right"))

    as_right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: block(i, F.col("at_right"), False, True))
    as_left = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda j: block(F.col("at_left"), j, True, False))
    blocks = F.when(F.col("root") != F.col("main"), F.concat(as_right, as_left)).otherwise(as_right)
    rows = rows.select("main", "rep", "root", F.explode(blocks).alias("b")).select("main", "rep", "root", "b.*")
    rows = rows.join(found.withColumnRenamed("id", "rep"), "rep")
    return rows.groupBy("main", "i", "j").applyInPandas(_across(percent), "a long, b long")


def _buckets(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of buckets of several (key, part, rep, n), and each bucket's PIVOTS smallest (key, part, a, na), once for each part.

    Buckets with more than one in HOT_SHARE of all rows, of which there can be but HOT_SHARE, are dealt over parts of about
    that size, so that no task meets a whole one. Sizes come from partial sums, pivots from those of the parts.
    """
    sizes = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "bucket-sizes")
    most = max((sizes.agg(F.sum("size")).first()[0] or 0) // HOT_SHARE, PART_ROWS)
    # At most HOT_SHARE rows.
    hot = F.broadcast(sizes.filter(F.col("size") > most).select("key", F.ceil(F.col("size") / most).cast("int").alias("parts")))

    def in_all_parts(rows: DataFrame) -> DataFrame:
        parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
        return rows.join(hot, "key", "left").withColumn("part", F.explode(parts)).drop("parts")

    own = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("rep"), F.col("parts"))).cast("int")
    dealt = keyed.join(hot, "key", "left").withColumn("part", own).drop("parts")
    rank = F.row_number().over(Window.partitionBy("key", "part").orderBy("rep"))
    met = materialise(dealt.join(in_all_parts(sizes.select("key")), ["key", "part"]).withColumn("rank", rank), "buckets")
    first = met.filter(F.col("rank") <= PIVOTS)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("rep"))).filter(F.col("rank") <= PIVOTS)
    return met, in_all_parts(first.select("key", F.col("rep").alias("a"), F.col("n").alias("na")))


def _grouped(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """One row per document: doc_id, n_shingles, its set's identity, root (a number for its group; null where it has no set or no id) and component_id."""
    sketched = materialise(sketch_documents(docs, n), "sketches")
    whole = sketched.filter("n_shingles > 0 and doc_id is not null")
    mark = ["set_high", "set_low"]
    # Classes of equal sets get numbers as they are written: doc_ids can repeat with other texts.
    classes = whole.groupBy(*mark).agg(F.min("doc_id").alias("first_id")).withColumn("rep", F.monotonically_increasing_id())
    classes = materialise(classes, "classes")
    reps = whole.join(classes.withColumnRenamed("first_id", "doc_id"), [*mark, "doc_id"]).select("rep", F.col("n_shingles").alias("n"), "registers")
    reps = materialise(reps.dropDuplicates(["rep"]), "representatives")

    width = 2 * ROWS
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.col("registers").substr(i * width + 1, F.lit(width))))
    keyed = reps.select("rep", "n", F.explode(band).alias("key"))
    met, pivots = _buckets(keyed)
    star = met.join(pivots, ["key", "part"]).filter("a < rep").filter(_near_sizes("n", "na", percent)).select("a", F.col("rep").alias("b")).distinct()
    star = materialise(_estimated(star, reps, percent), "pairs")
    links = materialise(_verified(star, classes, docs, n, percent), "links")
    more = _links_across(met, connected_components(links), classes, docs, n, percent)
    joined = materialise(connected_components(links.unionByName(more)), "components")
    rooted = classes.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select(*mark, "first_id", F.coalesce("root", "rep").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("smallest"))
    named = rooted.join(smallest, "root").select(*mark, "root", "smallest")
    has_set = F.expr("n_shingles > 0 and doc_id is not null")
    out = sketched.select("doc_id", "n_shingles", F.when(has_set, F.col("set_high")).alias("set_high"), F.when(has_set, F.col("set_low")).alias("set_low")).join(named, mark, "left")
    return out.select("doc_id", "n_shingles", *mark, "root", F.coalesce("smallest", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: n_shingles, component_id (smallest doc_id reachable by links), kept.

    Documents link if 100 * |A & B| >= percent * |A | B| for their sets of distinct
    n-word shingles (words between white space, A-Z lower-cased). Documents
    with the same set are one class from the start. Classes that agree in all registers of a band
    meet: first each with the band's PIVOTS smallest classes, then, where links have not yet
    joined all of a band, those outside its main component with all. So no link between
    components is left out, and members of one group are not paired with each other.

    A null text or one without words is linked with nothing; fewer than n words make one
    shingle. A null doc_id stays by itself, with a null component, and is kept. Rows
    that share a doc_id are documents each, with their own texts and links. An empty table gives no rows; other columns
    are ignored.
    """
    found = _grouped(docs, n, percent)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near_duplicates, that of the smallest doc_id.

    Rows without a set or without a doc_id stay. A row of a doc_id that repeats goes only if its set is that of a row which stays, or is
    linked with it: other texts under the same id are documents of their own. Where several rows of a group have its smallest doc_id, one stays.
    """
    found = materialise(_grouped(docs, n, percent), "grouped")
    again = materialise(docs.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id"), "repeated")
    repeated = again.count()
    gone = materialise(found.filter("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    few = gone.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(same_columns(docs))
    if not repeated:
        return kept
    again = F.broadcast(again) if repeated <= BROADCAST_IDS else again
    mark = ["set_high", "set_low"]
    stays = found.filter("root is not null and doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "set_high", "set_low")).alias("first")).select("first.*")
    rows = docs.join(again, "doc_id", "left_semi").select(F.struct(*same_columns(docs)).alias("p_row"), F.col("doc_id").cast("long").alias("p_doc_id"), F.col("text").cast("string").cast("binary").alias("p_text"))
    own = _with_sets(small_batches(rows), n)
    mark = [own["p_doc_id"] == stays["doc_id"], own["p_high"] == stays["set_high"], own["p_low"] == stays["set_low"]]
    single = own.join(stays, mark, "left_semi").dropDuplicates(["p_doc_id", "p_high", "p_low"]).unionByName(own.filter("p_high is null"))
    single = single.select([F.col("p_row").getField(c).alias(c) for c in docs.columns])
    return kept.join(again, "doc_id", "left_anti").select(same_columns(docs)).unionByName(single)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=80)
