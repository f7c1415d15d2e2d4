"""Crowded islands, long footprints, many samples and small batches: the same results as plain counts, with work that stays near linear."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fissure.jobs import pipeline
from fissure.operators import assemble, breakpoints, finalize, islands
from fissure.sources import tables
from tests.test_breakpoints import SF, call


def crowd(spark, n, spread, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(spread), rng.randrange(2000), rng.choice([60, 120]), rng.choice([500, 900])) for i in range(n)]
    frame = spark.createDataFrame(rows, "i long, start1 long, off long, length_tol int, span_tol int")
    return frame.select(F.lit("r").alias("route"), F.lit(1).cast("long").alias("island"), F.col("i").cast("string").alias("row_id"), F.lit("chr1").alias("chrom1"), F.lit("chr1").alias("chrom2"), "start1", (F.col("start1") + 100).alias("end1"), (F.col("start1") + 300 + F.col("off")).alias("start2"), (F.col("start1") + 400 + F.col("off")).alias("end2"), F.col("off").alias("size_off"), "length_tol", "span_tol"), rows


def plain_support(rows):
    s, off, lt, st = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3, 4))
    out = {}
    for i in range(len(rows)):
        ok = (np.abs(off - off[i]) <= np.maximum(lt, lt[i])) & (np.abs(s - s[i]) + np.abs(s + off - s[i] - off[i]) <= np.maximum(st, st[i])) & (np.minimum(s + 300 + off, s[i] + 300 + off[i]) > np.maximum(s, s[i]) + 100)
        out[str(i)] = int(ok.sum()) - 1
    return out


@pytest.mark.parametrize(("n", "spread", "crowded"), [(3000, 4000, 64), (300, 3000, 1000), (20_000, 400_000, 64), (4000, 1, 8)])
def test_support_in_a_crowded_island(spark, n, spread, crowded):
    frame, rows = crowd(spark, n, spread)
    got = {r["row_id"]: r["support"] for r in islands.pair_support(frame, crowded).select("row_id", "support").collect()}
    assert got == plain_support(rows)


def test_islands_that_cross_batches(spark):
    supported, _ = pipeline.supported(tables.mappings(spark, SF), tables.libraries(spark), 150)
    clusters = lambda: sorted(map(tuple, assemble.assemble(supported).select("row_id", "cluster_id").collect()))
    want = clusters()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert clusters() == want and len(want) > 1000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_footprints_meet_in_few_bins(spark):
    rng = random.Random(4)
    calls = []
    for i in range(260):
        size = rng.choice([200, 5000, 60_000, 900_000, 10_000_000])
        s1, s2 = rng.randrange(0, 30_000_000), rng.randrange(50_000_000, 80_000_000)
        calls.append(call(f"{i:03d}", s1, s1 + size, s2, s2 + rng.choice([200, size])))
    frame = spark.createDataFrame(calls)
    over = lambda a, b, i: min(a[f"max_end{i}"], b[f"max_end{i}"]) - max(a[f"min_start{i}"], b[f"min_start{i}"]) > -100
    inner = lambda a, b: min(a["min_start2"], b["min_start2"]) - max(a["max_end1"], b["max_end1"]) > 0
    want = Counter((a["contig_id"], b["contig_id"]) for a in calls for b in calls if a["contig_id"] < b["contig_id"] and over(a, b, 1) and over(a, b, 2) and inner(a, b))
    assert Counter(map(tuple, breakpoints.overlapping_calls(frame).collect())) == want and len(want) > 300
    long = spark.range(2000).select(F.lit("chr1").alias("chrom1"), F.lit("chr1").alias("chrom2"), F.lit("+").alias("strand1"), F.lit("-").alias("strand2"), F.col("id").cast("string").alias("contig_id"), *[((F.col("id") + shift) * 20_000_000 + add).alias(n) for n, shift, add in (("min_start1", 0, 0), ("max_end1", 0, 10_000_000), ("min_start2", 5000, 0), ("max_end2", 5000, 10_000_000))])
    assert breakpoints.overlapping_calls(long).count() == 0  # with bins of one width, a million rows for each call


def test_counts_of_a_thousand_samples(spark):
    rng = random.Random(8)
    samples = [f"NA{i}" + ("" if i % 3 else f".{i % 7}") for i in range(1000)] + ["NA1.5", "NA1.5.x"]
    rows = [(f"c{rng.randrange(40)}", f"{rng.choice(samples)}.read{k}", rng.choice("YYN")) for k in range(5000)]
    want = defaultdict(Counter)
    for contig, read, included in rows:
        if included == "Y":
            want[contig][max((s for s in samples if read.startswith(s + ".")), key=len)] += 1
    details = spark.createDataFrame(rows, "contig_id string, read_id string, included string")
    got = finalize.sample_counts(details, samples)
    assert got.columns == ["contig_id", *samples]
    assert {r[0]: [v for v in r[1:]] for r in got.collect()} == {c: [n[s] for s in samples] for c, n in want.items()}
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
