"""Hand-derived cases, and the order-dependent steps against plain restatements of their rules."""

import itertools
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fissure.jobs import pipeline, registry
from fissure.operators import assemble, breakpoints, dedup, finalize, islands, libstats, merge, pairing, route, runs
from fissure.sources import schemas, tables, text

SF = "/root/testdata/sf0.001"
BEDPE = [c.split()[0] for c in schemas.BEDPE.split(", ")]


def mappings(spark, rows):
    frame = spark.createDataFrame([(*r, 0, f"row{i}") for i, r in enumerate(rows)], schemas.BEDPE + ", file_num int, row_id string")
    return frame


def library(spark):
    return spark.createDataFrame([(0, "S0", 300.0, 20.0, 3.0)], "file_num int, sample string, exp_size double, variance double, num_devs double")


G1 = [
    ("chr1", 100, 200, "chr1", 1000, 1100, "S0.r1", 1, "+", "-", 1, 0, 1, 1, 60, 60),
    ("chr1", 150, 250, "chr1", 1040, 1140, "S0.r2", 1, "+", "-", 2, 1, 1, 1, 30, 50),
    ("chr1", 300, 400, "chr1", 5000, 5100, "S0.r3", 1, "+", "-", 0, 0, 1, 1, 60, 60),
]


@pytest.fixture(scope="module")
def g1(spark):
    finals, chosen, _ = pipeline.breakpoint_calls(mappings(spark, G1), library(spark), 1)
    return finals.cache(), chosen.cache()


def test_cluster_call_interval_track_and_counts(spark, g1):
    finals, chosen = g1
    assert {r["read_id"] for r in chosen.collect()} == {"S0.r1", "S0.r2"}
    call = finals.first()
    got = [call[c] for c in schemas.FINAL if c != "contig_id"]
    assert got == ["chr1", 100, 250, "chr1", 1000, 1140, 2, "+", "-", 1, 0, 1, 1, 45, 55, 1041, 2, 2.0, 2, 2.0, 2, 0, 0]
    b = breakpoints.breakpoint_intervals(finals).first()
    assert tuple(b)[:6] == ("chr1", 239, 450, "chr1", 800, 1011) and b["variant"] == "local_deletion"
    t = breakpoints.bed12(finals.withColumn("contig_id", F.lit("1"))).first()
    assert tuple(t) == ("chr1", 100, 1140, "1,2:+/-:intra:chr1:100-1140", 1040, "+", 100, 1140, "153,0,0", 2, "150,140", "0,900")
    counts = finalize.sample_counts(finalize.detail(chosen, finals), ["S0", "S1"]).first()
    assert (counts["S0"], counts["S1"]) == (2, 0)


def test_gap_islands(spark):
    rows = [("chr1", s, e, "chr1", 90000, 90100, f"r{i}", 1, "+", "-", 0, 0, 1, 1, 9, 9) for i, (s, e) in enumerate([(100, 200), (2200, 2300), (4301, 4400)])]
    got = islands.with_islands(mappings(spark, rows).withColumn("route", F.lit("x"))).orderBy("start1").collect()
    assert [r["island"] for r in got] == [1, 1, 2]


def test_culling_and_types(spark):
    rows = [("chr1", 100, 200, "chr1", 1000, 1100, "r", 1, "+", "-", 0, 0, 9, 9, 1, 1), ("chr1", 100, 200, "chr2", 500, 600, "r", 1, "+", "-", 1, 0, 9, 9, 1, 1)]
    m = route.classify(mappings(spark, rows))
    assert {(r["n1"], r["n2"], r["mapping_type"], r["mappings1"], r["mappings2"]) for r in m.collect()} == {(1, 2, 2, 1, 2)}
    assert [route.cull(m, u).count() for u in ("best", 1, "all")] == [1, 2, 2]


def test_mates_follow_their_blocks(spark):
    """Mate 1 at chr2:100 twice, mate 2 at chr1:50 and chr3:70: ordering the blocks of the first row changes no mate's places."""
    rows = [("chr2", 100, 200, "chr1", 50, 150, "r", 1, "+", "-", 0, 0, 9, 9, 1, 1), ("chr2", 100, 200, "chr3", 70, 170, "r", 1, "+", "-", 0, 0, 9, 9, 1, 1)]
    for m in (route.classify(route.order_mates(mappings(spark, rows))), route.classify(mappings(spark, rows))):
        assert {(r["n1"], r["n2"], r["mapping_type"]) for r in m.collect()} == {(1, 2, 2)}
    assert {(r["chrom1"], r["mate1"], r["which_mate_is_block1"]) for r in route.order_mates(mappings(spark, rows)).collect()} == {("chr1", 2, 1), ("chr2", 1, 1)}


def test_samples_with_points_and_shared_prefixes(spark):
    details = spark.createDataFrame([("c", "NA.1.r7", "Y"), ("c", "NA.1.r8", "Y"), ("c", "NA.r9", "Y"), ("c", "NA.10.x.y", "Y"), ("c", "NA.1.r0", "N")], "contig_id string, read_id string, included string")
    got = finalize.sample_counts(details, ["NA", "NA.1", "NA.10", "NA.1", "B"]).first()
    assert got.asDict() == {"contig_id": "c", "NA": 1, "NA.1": 2, "NA.10": 1, "B": 0}
    with pytest.raises(Exception, match="no sample"):
        finalize.sample_counts(details, ["NA.1"]).collect()


def test_large_islands_are_an_output_of_the_job(spark):
    crowd = [("chr1", 100 + i, 200 + i, "chr1", 1000 + i, 1100 + i, f"S0.c{i}", 1, "+", "-", 0, 0, 1, 1, 9, 9) for i in range(5)]
    far = [("chr1", 90_000, 90_100, "chr1", 91_000, 91_100, f"S0.f{i}", 1, "+", "-", 0, 0, 1, 1, 9, 9) for i in range(2)]
    found = pipeline.breakpoint_calls(mappings(spark, crowd + far), library(spark), 1, punt=4)
    assert {r["read_id"] for r in found.punted.collect()} == {f"S0.c{i}" for i in range(5)}
    assert [r["num_pairs"] for r in found.finals.collect()] == [2]


def test_bins_give_the_runs_of_one_window(spark):
    rows = [("chr1", s, s + 100, "chr1", 10**7, 10**7 + 100, f"r{i}", 1, "+", "-", 0, 0, 1, 1, 9, 9) for i, s in enumerate([*range(99_000, 103_000, 700), 250_000, *range(999_000, 1_001_000, 500), 5_000_000])]
    m = mappings(spark, rows).withColumn("route", F.lit("x"))
    got = {r["row_id"]: (r["run"], r["before_start1"]) for r in runs.with_runs(m, ["route"], "start1", islands.ORDER, ["start1", "end1"], lambda before: F.col("start1") - before("end1") > 1500, "run", width=1000).collect()}
    starts, run, want = sorted((r[1], i) for i, r in enumerate(rows)), 0, {}
    for k, (s, i) in enumerate(starts):
        run += k == 0 or s - (starts[k - 1][0] + 100) > 1500
        want[f"row{i}"] = (run, starts[k - 1][0] if k else None)
    assert got == want


def test_mate_order_moves_blocks_and_not_edits(spark):
    rows = [("chr2", 50, 150, "chr10", 900, 1000, "r", 1, "+", "-", 3, 7, 1, 1, 1, 2)]
    r = route.order_mates(mappings(spark, rows)).first()
    assert (r["chrom1"], r["start1"], r["strand1"], r["chrom2"], r["edit1"], r["edit2"]) == ("chr10", 900, "-", "chr2", 3, 7)
    assert route.order_mates(mappings(spark, rows), swap_qualities=True).first()["edit1"] == 7
    assert route.inner_span(route.order_mates(mappings(spark, rows))).count() == 0


def alignment(qname, pos, aend, pnext, tlen, reverse, mate_reverse, tid=0, rnext=0, duplicate=False, read1=True, nm=None):
    return (0, qname, tid, f"chr{tid + 1}", pos, aend, rnext, pnext, tlen, 60, True, False, False, reverse, mate_reverse, duplicate, read1, nm)


def test_library_statistics(spark):
    rows = [alignment(f"q{i}", 0, 100, 200, t, False, True) for i, t in enumerate([290, 300, 310, 330])]
    s = libstats.library_statistics(spark.createDataFrame(rows, schemas.ALIGNMENT)).first()
    assert (s["median_size"], s["mad"], s["pairs"]) == (305.0, 10.0, 4)


def test_discordance(spark):
    cases = {
        "fits": (False, alignment("fits", 0, 100, 260, 360, False, True)),
        "long": (True, alignment("long", 0, 100, 261, 361, False, True)),
        "short": (False, alignment("short", 0, 30, 20, 50, False, True)),
        "everted": (True, alignment("everted", 0, 100, 200, 300, True, False)),
        "same": (True, alignment("same", 0, 100, 200, 300, False, False)),
        "between": (True, alignment("between", 0, 100, 200, 0, False, True, rnext=1)),
        "copy": (False, alignment("copy", 0, 100, 900, 1000, False, True, duplicate=True)),
    }
    got = {r["qname"] for r in libstats.discordant(spark.createDataFrame([a for _, a in cases.values()], schemas.ALIGNMENT), library(spark)).collect()}
    assert got == {k for k, (odd, _) in cases.items() if odd}


def test_mates_pair_by_name(spark):
    rows = [alignment("q", 500, 600, 100, -500, True, False, read1=False, nm=2), alignment("q", 100, 200, 500, 500, False, True), alignment("alone", 1, 2, 3, 4, False, True)]
    r = libstats.pair_mates(spark.createDataFrame(rows, schemas.ALIGNMENT), library(spark)).collect()
    assert [(x["read_id"], x["start1"], x["start2"], x["which_mate_is_block1"], x["strand1"], x["strand2"], x["edit1"], x["edit2"]) for x in r] == [("S0.q", 100, 500, 1, "+", "-", 0, 2)]


def call(i, s1, e1, s2, e2, c1="chr1"):
    d = dict.fromkeys(merge.CALL, 1) | {"chrom1": c1, "chrom2": "chr1", "strand1": "+", "strand2": "-", "min_start1": s1, "max_end1": e1, "min_start2": s2, "max_end2": e2, "contig_id": i}
    return d | {"all_weighted_support": 1.0, "final_weighted_support": 1.0}


def test_merging_two_calls(spark):
    out = merge.merge_calls(spark.createDataFrame([call("1", 100, 250, 1000, 1140), call("2", 160, 300, 1050, 1180)]))
    r = out.first()
    assert out.count() == 1 and (r["min_start1"], r["max_end1"], r["min_start2"], r["max_end2"], r["contig_size"], r["master_id"], r["members"]) == (100, 300, 1000, 1180, 1081, "1.m", ["1", "2"])
    details = spark.createDataFrame([("2", "a"), ("9", "b")], "contig_id string, read_id string")
    assert {r["contig_id"] for r in merge.remap_detail(details, out).collect()} == {"1.m", "9"}


def test_merge_fixpoint_keeps_every_call_once(spark):
    finals = registry._finals(spark, SF).cache()
    merged = merge.merge_calls(finals, registry.SLOP).cache()
    members = [m for r in merged.select("members").collect() for m in r[0]]
    assert sorted(members) == sorted(r[0] for r in finals.select("contig_id").collect())
    assert merged.agg(F.sum("final_support")).first()[0] == finals.agg(F.sum("final_support")).first()[0]
    assert merged.count() < finals.count()


def test_best_cluster_by_weight_then_edits(spark):
    def rows(cluster, reads, edits, kind):
        return [(cluster, r, e, 0, kind, "chr1", "chr1", 0, 10, 20, 30) for r, e in zip(reads, edits, strict=True)]

    schema = "cluster_id string, read_id string, edit1 int, edit2 int, mapping_type int, chrom1 string, chrom2 string, start1 int, end1 int, start2 int, end2 int"
    data = rows("c1", ["a", "b"], [1, 2], 1) + rows("c2", ["a", "x"], [4, 4], 1) + rows("c2", ["y"], [1], 2) + rows("c3", ["b", "z"], [0, 0], 1)
    got = {(r["cluster_id"], r["read_id"]): r["included"] for r in finalize.choose_clusters(spark.createDataFrame(data, schema)).collect()}
    assert got["c2", "a"] and not got["c1", "a"] and got["c3", "b"] and not got["c1", "b"]


def test_duplicates_keep_the_fewest_edits(spark):
    rows = [("chr1", 100, 200, "chr1", 1000, 1100, "a", 1, "+", "-", 2, 0, 1, 1, 9, 9), ("chr1", 101, 201, "chr1", 1001, 1099, "b", 1, "+", "-", 0, 0, 1, 1, 9, 9), ("chr1", 500, 600, "chr1", 1000, 1100, "c", 1, "+", "-", 0, 0, 1, 1, 9, 9)]
    assert {r["read_id"] for r in dedup.drop_duplicates(mappings(spark, rows)).collect()} == {"b", "c"}


def test_dedup_has_no_tied_reads_left(spark):
    m = tables.mappings(spark, SF)
    kept = dedup.drop_duplicates(m, slop=40)
    before, after = ({r["read_id"] for r in x.select("read_id").collect()} for x in (m, kept))
    assert after < before
    ties = dedup.duplicate_runs(m, 40).filter("duplicate").select("read_id", "before").collect()
    assert not any(a in after and b in after for a, b in ties)


def test_either_end_is_walked(spark):
    """Ends 2 of the first and third reads are the same, ends 1 lie apart."""
    rows = [("chr1", s, s + 100, "chr1", e, e + 100, n, 1, "+", "+", d, 0, 1, 1, 9, 9) for n, s, e, d in [("a", 100, 9000, 1), ("b", 500, 20_000, 0), ("c", 900, 9000, 0)]]
    assert {r["read_id"] for r in dedup.drop_duplicates(mappings(spark, rows), either=True).collect()} == {"b", "c"}
    assert dedup.drop_duplicates(mappings(spark, rows)).count() == 3


def test_other_mappings_of_an_inferior_read_take_the_best_name(spark):
    rows = [("chr1", 100, 200, "chr1", 1000, 1100, "best", 1, "+", "-", 0, 0, 1, 2, 9, 9), ("chr1", 100, 200, "chr1", 1000, 1100, "worse", 1, "+", "-", 2, 0, 1, 2, 9, 9), ("chr2", 100, 200, "chr2", 7000, 7100, "worse", 1, "+", "-", 0, 0, 1, 2, 9, 9), ("chr3", 1, 2, "chr3", 7, 8, "many", 1, "+", "-", 0, 0, 9, 9, 9, 9)]
    got = {(r["row_id"], r["read_id"]) for r in dedup.drop_duplicates(mappings(spark, rows), most_mappings=2).collect()}
    assert got == {("row0", "best"), ("row2", "best"), ("row3", "many")}  # outside blocks, many mappings are no reason to go
    assert {r["row_id"] for r in dedup.drop_duplicates(mappings(spark, rows)).collect()} == {"row3"}  # in a block they are


def test_concordant_reads_are_not_paired(spark):
    def end(read, num, chrom, start, strand):
        return (read, num, chrom, start, start + 100, 0, strand)

    rows = [end("far", 1, "chr1", 100, "+"), end("far", 2, "chr1", 9000, "-"), end("near", 1, "chr1", 100, "+"), end("near", 2, "chr1", 300, "-"), end("near", 2, "chr2", 300, "-"), end("half", 1, "chr1", 1, "+")]
    out = pairing.pair_combinations(spark.createDataFrame(rows, "read_id string, read_num int, chrom string, start int, end int, edit int, strand string")).collect()
    assert [(r["read_id"], r["start1"], r["start2"], r["frag_size"]) for r in out] == [("far", 100, 9000, 9000)]
    tags = {(r["read_id"], r["tag"], r["start1"]) for r in pairing.tagged_pairs(spark.createDataFrame(rows, "read_id string, read_num int, chrom string, start int, end int, edit int, strand string")).collect()}
    assert tags == {("far", "discordant", 100), ("near", "concordant", 100), ("half", "orphan", None)}


def _agree(a, b):
    common = not (a["chrom1"] == a["chrom2"] and b["chrom1"] == b["chrom2"]) or min(a["start2"], b["start2"]) - max(a["end1"], b["end1"]) > 0
    spread = abs(a["start1"] - b["start1"]) + abs(a["end2"] - b["end2"])
    return common and abs(a["size_off"] - b["size_off"]) <= max(a["length_tol"], b["length_tol"]) and spread <= max(a["span_tol"], b["span_tol"])


def _naive(rows):
    """The greedy rule, restated plainly: sort, take the head, accept whoever agrees with all accepted."""
    key = lambda m: (m["start1"], m["end1"], m["start2"], m["end2"], m["read_id"], m["file_num"], m["row_id"])
    left, out = sorted(rows, key=lambda m: (m["mapping_type"], -m["support"], *key(m))), []
    while len(left) > 1:
        seed = left[0]
        if seed["support"] == 0:
            left = left[1:]
            continue
        members = [seed]
        for m in sorted(left[1:], key=lambda m: (abs(m["start1"] - seed["start1"]) + abs(m["end2"] - seed["end2"]), *key(m))):
            if all(_agree(m, x) for x in members):
                members.append(m)
        gone = {m["row_id"] for m in members} if len(members) >= 2 else {seed["row_id"]}
        if len(members) >= 2:
            out.append(frozenset(gone))
        left = [m for m in left if m["row_id"] not in gone]
    return out


def test_greedy_clusters_against_a_restatement_and_any_row_order(spark):
    supported, _ = pipeline.supported(tables.mappings(spark, SF), tables.libraries(spark), 150)
    rows = [r.asDict() for r in supported.collect()]
    by = defaultdict(list)
    for r in rows:
        by[r["route"], r["island"]].append(r)
    want = {c for island in by.values() for c in _naive(island)}
    for frame in (supported, supported.orderBy(F.xxhash64("row_id"))):
        got = defaultdict(set)
        for r in assemble.assemble(frame).select("cluster_id", "row_id").collect():
            got[r["cluster_id"]].add(r["row_id"])
        assert {frozenset(c) for c in got.values()} == want
        by_id = {r["row_id"]: r for r in rows}
        assert all(_agree(by_id[a], by_id[b]) for c in got.values() for a, b in itertools.combinations(c, 2))
        assert sum(map(len, got.values())) == len(set().union(*got.values()))
    assert len(want) == 1032


def test_flagship_calls(spark):
    assert pipeline.run(spark, SF).count() == 927


def test_malformed_calls_fail_the_job(spark):
    with pytest.raises(Exception, match="malformed call 7"):
        breakpoints.breakpoint_intervals(spark.createDataFrame([call("7", 900, 950, 100, 150)])).collect()


def test_chains_of_calls_merge_to_the_end(spark):
    calls = [call(f"{i:03d}", 100 * i, 100 * i + 150, 10**6 + 100 * i, 10**6 + 100 * i + 150) for i in range(60)]
    merged = merge.merge_calls(spark.createDataFrame(calls), slop=10)
    assert breakpoints.overlapping_calls(merged, 10).count() == 0
    assert sorted(m for r in merged.select("members").collect() for m in r[0]) == [c["contig_id"] for c in calls]


def executions(spark):
    """What the session's status store has of each execution: its plan in words."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {found.apply(i).executionId(): found.apply(i).physicalPlanDescription() for i in range(found.size())}


@pytest.mark.parametrize("name", ["final_calls", "final_detail", "sample_frequency_pivot", "footprint_overlap_join", "pair_support", "breakpoint_calls"])
def test_queries_read_little(spark, name):
    """Over all executions of a query, those that write what is read again included."""
    before = set(executions(spark))
    registry.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    scans = exchanges = 0
    for i, plan in executions(spark).items():
        if i not in before:
            tree = plan.split("== Initial Plan ==")[0].split("== Final Plan ==")[-1].split("\n\n")[0]
            numbers = {n for n in re.findall(r"Scan parquet[^\n(]*\(([0-9]+)\)", tree)}
            places = re.findall(r"^\(([0-9]+)\) Scan parquet.*?^Location: ([^\n]*)", plan, re.M | re.S)
            scans += sum(n in numbers and "lineitem.parquet" in place for n, place in places)
            exchanges += len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange \(", tree))
    assert 1 <= scans <= 3 and exchanges <= 40


def test_text_round_trip(spark, tmp_path):
    m = mappings(spark, G1).select(BEDPE)
    text.write_tsv(m, str(tmp_path / "bedpe"))
    assert sorted(map(tuple, text.read_bedpe(spark, str(tmp_path / "bedpe")).select(BEDPE).collect())) == sorted(G1)
    (tmp_path / "config").write_text("S0\ta.bam\t331.92\t72.38\t6\nS1\tb.bam\t300\t20\t3\n")
    got = text.read_libraries(spark, str(tmp_path / "config")).orderBy("file_num").collect()
    assert [(r["file_num"], r["sample"], r["exp_size"]) for r in got] == [(0, "S0", 331.92), (1, "S1", 300.0)]
