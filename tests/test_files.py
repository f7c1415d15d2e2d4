"""Readers, writers and the jobs from files to files."""

import pytest
from pyspark.sql import Row

from fissure.jobs import files, pipeline
from fissure.jobs.stages import Stages
from fissure.operators import assemble
from fissure.sources import schemas, tables, text

HEADER = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:1000000\n@SQ\tSN:chr2\tLN:1000000\n"


def sam_line(name, flag, chrom, pos, cigar, mate, mate_pos, tlen, tags="NM:i:1"):
    return "\t".join(map(str, (name, flag, chrom, pos, 60, cigar, mate, mate_pos, tlen, "*", "*", tags))) + "\n"


def pair(name, start, mate, chrom2="=", size=0):
    """Read 1 forward at start, its mate reverse at mate."""
    other, back = ("chr1", "=") if chrom2 == "=" else (chrom2, "chr1")
    return sam_line(name, 1 + 32 + 64, "chr1", start, "100M", chrom2, mate, size) + sam_line(name, 1 + 16 + 128, other, mate, "50M10D40M5S", back, start, -size, "XX:Z:a\tNM:i:2")


def write_sams(tmp_path):
    for k, shift in enumerate((0, 3)):
        usual = "".join(pair(f"u{i}", 1000 * i + 1, 1000 * i + 201 + i % 5, size=300 + i % 5) for i in range(1, 40))
        odd = "".join(pair(f"d{i}", 50_001 + 10 * i + shift, 80_001 + 10 * i, size=30_100) for i in range(3)) + "".join(pair(f"x{i}", 60_001 + i, 5001 + i, "chr2") for i in range(2))
        (tmp_path / f"lib{k}.sam").write_text(HEADER + usual + odd)
    (tmp_path / "stub").write_text("".join(f"S.{k}\t{tmp_path}/lib{k}.sam\n" for k in range(2)))


def test_alignments_from_text(spark, tmp_path):
    write_sams(tmp_path)
    libraries = spark.createDataFrame([(4, f"{tmp_path}/lib0.sam"), (9, f"file://{tmp_path}/lib1.sam")], "file_num int, mapping_file string")
    rows = text.read_alignments(spark, libraries)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] == [c for c in schemas.ALIGNMENT.split(", ")]
    got = {(r["file_num"], r["qname"], r["is_read1"]): r for r in rows.collect()}
    assert len(got) == 2 * 2 * (39 + 5)
    a, b = got[4, "x1", True], got[9, "x1", False]
    assert (a["tid"], a["pos"], a["aend"], a["rnext"], a["pnext"], a["is_reverse"], a["mate_is_reverse"], a["nm"]) == (0, 60_001, 60_101, 1, 5001, False, True, 1)
    assert (b["tid"], b["rname"], b["pos"], b["aend"], b["is_reverse"], b["nm"], b["is_paired"], b["is_unmapped"]) == (1, "chr2", 5001, 5101, True, 2, True, False)


def test_from_a_stub_to_calls(spark, tmp_path):
    write_sams(tmp_path)
    files.make_config(spark, str(tmp_path / "stub"), str(tmp_path / "config"), num_devs=3)
    libraries = text.read_libraries(spark, str(tmp_path / "config" / "*.csv")).orderBy("file_num").collect()
    assert [(r["sample"], r["num_devs"]) for r in libraries] == [("S.0", 3.0), ("S.1", 3.0)] and libraries[0]["exp_size"] == 302.0
    config = str(tmp_path / "config" / "*.csv")
    files.call_alignments(spark, config, str(tmp_path / "out"))
    finals = text.read_finals(spark, str(tmp_path / "out.final")).collect()
    assert sorted((r["chrom1"], r["chrom2"], r["num_pairs"]) for r in finals) == [("chr1", "chr1", 6)]
    details = text.read_details(spark, str(tmp_path / "out.detail")).collect()
    assert len(details) == 6 and {r["included"] for r in details} == {"Y"} and {r["read_id"].rsplit(".", 1)[0] for r in details} == {"S.0", "S.1"}
    freq = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out.freq"))
    assert freq.columns[0] == "#chrom1_1" and freq.columns[-2:] == ["S.0Y", "S.1Y"] and freq.first()["S.0Y"] == "3"
    assert text.read_tsv(spark, str(tmp_path / "out.punted"), schemas.BEDPE + ", mapping_type int, route string, island long").count() == 0

    for k in range(2):  # the same calls from the paired intervals
        rows = text.read_tsv(spark, str(tmp_path / "out.bedpe"), schemas.BEDPE).filter(f"read_id like 'S.{k}.%'")
        text.write_tsv(rows, str(tmp_path / f"lib{k}.sam.bedpe"))
    files.call_mappings(spark, config, str(tmp_path / "again"))
    same = lambda name: sorted(tuple(r)[:6] for r in text.read_finals(spark, str(tmp_path / name)).collect())
    assert same("again.final") == same("out.final")
    files.call_mappings(spark, config, str(tmp_path / "punt"), punt=2)
    assert text.read_tsv(spark, str(tmp_path / "punt.punted"), schemas.BEDPE + ", mapping_type int, route string, island long").count() == 6


def test_small_readers(spark, tmp_path):
    (tmp_path / "reads.bed").write_text("chr1\t10\t110\tr1/1\t2\t+\nchr2\t5\t105\tr1/2\t0\t-\n")
    assert sorted(map(tuple, text.read_ends(spark, str(tmp_path / "reads.bed")).collect())) == [("r1", 1, "chr1", 10, 110, 2, "+"), ("r1", 2, "chr2", 5, 105, 0, "-")]
    (tmp_path / "config").write_text("A\tx\t300\t20\t3\nB\ty\t310\t20\t3\nA\tz\t320\t20\t3\n")
    libraries = text.read_libraries(spark, str(tmp_path / "config"))
    assert {(r["sample"], r["mapping_file"]) for r in text.last_by_sample(libraries).collect()} == {("A", "z"), ("B", "y")}
    assert text.read_samples(spark, str(tmp_path / "config")) == ["A", "B"]
    row = "chr1\t1\t2\tchr1\t5\t6\tr\t1\t+\t-\t0\t0\t1\t1\t9\t9\t1\t40\t3\tchr1.chr1.+.-_7\t0\t1\t0\n"
    (tmp_path / "assembled").write_text(row)
    got = text.read_assembled(spark, str(tmp_path / "assembled")).first()
    assert (got["support"], got["cluster_id"], got["file_num"]) == (3, "chr1.chr1.+.-_7", 0)


def lines_of(path):
    return [line for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]


def test_calls_from_assembled_rows_are_those_of_the_direct_job(spark, tmp_path):
    write_sams(tmp_path)
    (tmp_path / "config").write_text("".join(f"S.{k}\t{tmp_path}/lib{k}.sam\t302\t1\t3\n" for k in range(2)))
    files.call_alignments(spark, str(tmp_path / "config"), str(tmp_path / "out"))
    rows = text.read_assembled(spark, str(tmp_path / "out.assembled")).collect()
    assert len(rows) == 6 and {(r["used"], r["include"], r["support"]) for r in rows} == {(1, 1, 5)}
    files.finalise(spark, str(tmp_path / "out.assembled"), str(tmp_path / "config"), str(tmp_path / "again"))
    for kind in ("all", "final", "detail", "freq"):
        first, again = sorted(lines_of(tmp_path / f"out.{kind}")), sorted(lines_of(tmp_path / f"again.{kind}"))
        assert first == again and first


def test_merged_files(spark, tmp_path):
    call = ["chr1", 100, 250, "chr1", 1000, 1140, "1", 2, "+", "-", 1, 0, 1, 1, 45, 55, 1041, 2, 2.0, 2, 2.0, 2, 0, 0]
    other = ["chr1", 160, 300, "chr1", 1050, 1180, "2", *call[7:]]
    far = ["chr1", 9160, 9300, "chr1", 10_500, 11_180, "3", *call[7:]]
    mapping = ["chr1", 1, 2, "chr1", 3, 4, "S0.r", 1, "+", "-", 0, 0, 1, 1, 9, 9, 1, "Y"]
    (tmp_path / "in.final").write_text("".join("\t".join(map(str, r)) + "\n" for r in (call, other, far)))
    (tmp_path / "in.detail").write_text("".join("\t".join(map(str, [*mapping, i])) + "\n" for i in (1, 2, 3, 2)))
    files.merge_files(spark, str(tmp_path / "in.final"), str(tmp_path / "in.detail"), str(tmp_path / "out"))
    assert sorted(lines_of(tmp_path / "out.mergemap")) == ["1.m\t1,2", "3\t3"]
    finals = {r["contig_id"]: r for r in text.read_finals(spark, str(tmp_path / "out.final")).collect()}
    assert set(finals) == {"1.m", "3"} and (finals["1.m"]["min_start1"], finals["1.m"]["max_end2"], finals["1.m"]["distinct_pairs"]) == (100, 1180, 4)
    assert sorted(r["contig_id"] for r in text.read_details(spark, str(tmp_path / "out.detail")).collect()) == ["1.m", "1.m", "1.m", "3"]


def test_dedup_and_pair_files(spark, tmp_path):
    rows = [["chr1", 100, 200, "chr1", 1000, 1100, n, 1, "+", "-", d, 0, 1, 1, 9, 9] for n, d in (("b", 2), ("a", 0), ("c", 1))]
    (tmp_path / "in").write_text("".join("\t".join(map(str, r)) + "\n" for r in rows))
    files.dedup_file(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert [line.split("\t")[6] for line in lines_of(tmp_path / "out")] == ["a"]
    ends = [("chr1", 9000, 9100, "far/1", 1, "+"), ("chr1", 100, 200, "far/2", 2, "-"), ("chr2", 50, 150, "odd/1", 0, "+"), ("chr1", 60, 160, "odd/2", 0, "+"), ("chr1", 300, 400, "near/1", 0, "-"), ("chr1", 100, 200, "near/2", 0, "+"), ("chr1", 1, 2, "half/1", 0, "+")]
    (tmp_path / "reads.bed").write_text("".join("\t".join(map(str, r)) + "\n" for r in ends))
    got = {}
    for mode in ("hydra", "discordant", "detail"):
        files.pair_file(spark, str(tmp_path / "reads.bed"), str(tmp_path / mode), mode)
        got[mode] = sorted(lines_of(tmp_path / mode))
    assert got["hydra"] == ["chr1\t100\t200\tchr1\t9000\t9100\tfar\t2\t-\t+\t2\t1\t1\t1\t0\t0", "chr1\t60\t160\tchr2\t50\t150\todd\t2\t+\t+\t0\t0\t1\t1\t0\t0"]
    assert got["discordant"] == ["chr1\t100\t200\tchr1\t9000\t9100\tfar\t2\t-\t+\t2\t1\t9000\t1\t1\t3", "chr1\t60\t160\tchr2\t50\t150\todd\t2\t+\t+\t0\t0\tdistant\t1\t1\t0"]
    detail = {line.split("\t")[6]: line.split("\t") for line in got["detail"]}
    assert {k: v[-1] for k, v in detail.items()} == {"far": "discordant", "odd": "discordant", "near": "concordant", "half": "orphan"}
    assert detail["near"][:10] == ["chr1", "100", "200", "chr1", "300", "400", "near", "2", "+", "-"]


def test_track_file(spark, tmp_path):
    (tmp_path / "calls").write_text("chr2 500 600 chr2 2000 2100 7 3 + - more\n\nchr1\t9\t20\tchr5\t40\t50\t8\t2\t-\t+\nchr1 5 9 chr3 100 250 9 4 . -\n")
    files.write_track(spark, str(tmp_path / "calls"), str(tmp_path / "track"), "calls")
    lines = lines_of(tmp_path / "track")
    assert lines[0] == "track name=calls itemRgb=On" and [tuple(x.split("\t")[:2]) for x in lines[1:]] == [("chr1", "-491"), ("chr2", "500"), ("chr3", "-400"), ("chr5", "40")]
    assert lines[2].split("\t")[3] == "7,3:+/-:intra:chr2:500-2100"
    assert lines[3].split("\t") == ["chr3", "-400", "250", "9,4:./-:orphan:150", "150", "-", "-400", "250", "0,0,0", "2", "1,150", "0,500"]


def test_a_job_goes_on_from_any_stage(spark, tmp_path):
    write_sams(tmp_path)
    (tmp_path / "config").write_text("".join(f"S.{k}\t{tmp_path}/lib{k}.sam\t302\t1\t3\n" for k in range(2)))
    files.call_alignments(spark, str(tmp_path / "config"), str(tmp_path / "plain"))
    for k in range(2):
        rows = text.read_tsv(spark, str(tmp_path / "plain.bedpe"), schemas.BEDPE).filter(f"read_id like 'S.{k}.%'")
        text.write_tsv(rows, str(tmp_path / f"lib{k}.sam.bedpe"))
    kinds, names = ("all", "final", "detail", "freq", "assembled"), ["supported", "punted", "clustered"]
    same = lambda out: [sorted(lines_of(tmp_path / f"{out}.{kind}")) for kind in kinds]
    files.call_mappings(spark, str(tmp_path / "config"), str(tmp_path / "first"), stages=str(tmp_path / "stages"))
    want = same("first")
    assert all(want) and [sorted(x.split("\t")[:6] for x in want[1])] == [sorted(x.split("\t")[:6] for x in same("plain")[1])]
    for n in range(3, -1, -1):  # all stages finished, then one fewer each time
        if n < 3:
            (tmp_path / "stages" / f"{names[n]}.json").unlink()
        files.call_mappings(spark, str(tmp_path / "config"), str(tmp_path / f"again{n}"), stages=str(tmp_path / "stages"))
        assert same(f"again{n}") == want
        if n < 3:
            for name in names[:n]:
                assert (tmp_path / "stages" / f"{name}.json").exists()
    (tmp_path / "config").write_text((tmp_path / "config").read_text().replace("302", "310"))
    with pytest.raises(ValueError, match="made from something else"):
        files.call_mappings(spark, str(tmp_path / "config"), str(tmp_path / "other"), stages=str(tmp_path / "stages"))


def test_a_restart_needs_no_exchange_by_island(spark, tmp_path):
    supported, _ = pipeline.supported(tables.mappings(spark, "/root/testdata/sf0.001"), tables.libraries(spark), 150)
    want = sorted(map(tuple, assemble.assemble(supported).select("row_id", "cluster_id").collect()))
    Stages(spark, f"file://{tmp_path}/s", {"a": 1}, buckets=4).keep("supported", lambda: supported, ["route", "island"])
    again = Stages(spark, f"file://{tmp_path}/s", {"a": 1}).keep("supported", lambda: 1 / 0, ["route", "island"])
    found = assemble.assemble(again)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert sorted(map(tuple, found.select("row_id", "cluster_id").collect())) == want


def test_assembled_rows_beyond_four_bytes(spark):
    """Places beyond 2^31 keep their value; rows within have the types of the layout."""
    row = Row(chrom1="chr1", start1=100, end1=200, chrom2="chr2", start2=900, end2=1000, read_id="a.1", which_mate_is_block1=1, strand1="+", strand2="-", edit1=0, edit2=1, mappings1=1, mappings2=1, mapq1=9, mapq2=9, mapping_type=1, size_off=400, support=1, cluster_id="r_1", file_num=0)
    near = text.assembled_layout(spark.createDataFrame([row]))
    assert {t for c, t in near.dtypes if c.startswith(("start", "end", "size"))} == {"int"}
    far = text.assembled_layout(spark.createDataFrame([row, Row(**(row.asDict() | {"start2": 6_000_000_600, "end2": 6_000_000_700, "size_off": 6_000_000_101}))]))
    assert sorted((r["start2"], r["end2"], r["size_off"], r["end1"]) for r in far.collect()) == [(900, 1000, 400, 200), (6_000_000_600, 6_000_000_700, 6_000_000_101, 200)]
