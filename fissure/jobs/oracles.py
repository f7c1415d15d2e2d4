"""DuckDB SQL for the registered queries, written against the given tables alone."""

from __future__ import annotations

M = """WITH libraries(file_num, sample, exp_size, variance, num_devs) AS (VALUES (0, 'S0', 300.0, 20.0, 3.0), (1, 'S1', 350.0, 30.0, 3.0), (2, 'S2', 250.0, 10.0, 6.0)),
places AS (
  SELECT *, CASE WHEN l_orderkey % 5 = 0 THEN l_orderkey % 2000 ELSE l_partkey END AS base,
         CASE WHEN l_suppkey % 5 = 0 THEN l_partkey + 1 ELSE l_partkey END AS part FROM lineitem),
m AS (
  SELECT CAST(l_orderkey % 3 AS INTEGER) AS file_num,
         'S' || (l_orderkey % 3) || '.' || l_orderkey || '_' || l_linenumber AS read_id,
         'chr' || (1 + base % 4) AS chrom1, base * 5000 + (l_orderkey % 7) * 20 AS start1, base * 5000 + (l_orderkey % 7) * 20 + 100 AS end1,
         'chr' || (1 + part % 4) AS chrom2, l_partkey * 5000 + 600 + (l_suppkey % 11) * 60 AS start2, l_partkey * 5000 + 600 + (l_suppkey % 11) * 60 + 100 AS end2,
         CAST(1 + l_orderkey % 2 AS INTEGER) AS which_mate, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand1, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand2,
         CAST(l_suppkey % 3 AS INTEGER) AS edit1, CAST(l_orderkey % 2 AS INTEGER) AS edit2, CAST(l_quantity AS INTEGER) AS mapq,
         l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey || '.' || CAST(round(l_extendedprice * 100) AS BIGINT) AS row_id
  FROM places)"""
FLIP = ", f AS (SELECT *, CASE WHEN chrom1 = chrom2 THEN start2 < start1 ELSE chrom2 < chrom1 END AS flipped FROM m)"
O = (
    FLIP
    + """, o AS (SELECT file_num, read_id, which_mate, edit1, edit2, mapq, row_id, flipped,
  """
    + ", ".join(f"CASE WHEN flipped THEN {c}{3 - i} ELSE {c}{i} END AS {c}{i}" for c in ("chrom", "start", "end", "strand") for i in (1, 2))
    + " FROM f)"
)
#: A mate's place, from rows as they come: ordering the blocks of a row must not change whose place is whose.
_PLACE = "CASE WHEN which_mate = {} THEN {{'c': chrom1, 's': start1, 'e': end1}} ELSE {{'c': chrom2, 's': start2, 'e': end2}} END"
C = (
    O
    + f""", n AS (SELECT file_num, read_id, count(DISTINCT {_PLACE.format(1)}) AS n1, count(DISTINCT {_PLACE.format(2)}) AS n2, min(edit1 + edit2) AS least FROM m GROUP BY ALL),
c AS (SELECT o.*, n1, n2, least, CASE WHEN n1 = 1 AND n2 = 1 THEN 1 WHEN n1 = 1 OR n2 = 1 THEN 2 ELSE 3 END AS mapping_type FROM o JOIN n USING (file_num, read_id))"""
)
R = C + ", r AS (SELECT *, chrom1 || '.' || chrom2 || '.' || strand1 || '.' || strand2 AS route FROM c WHERE edit1 + edit2 <= least AND start2 > end1)"
_ORDER = "PARTITION BY route ORDER BY start1, end1, start2, end2, read_id, row_id"
_ISLANDS = """, i AS (SELECT *, sum(opens) OVER ({o} ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN {rule} THEN 0 ELSE 1 END AS opens FROM r)),
s AS (SELECT *, count(*) OVER (PARTITION BY route, island) AS island_size FROM i)"""
I = R + _ISLANDS.format(o=_ORDER, rule=f"start1 - lag(end1) OVER ({_ORDER}) <= 2000")
INNER = R + _ISLANDS.format(o=_ORDER, rule=f"end1 < lag(start2) OVER ({_ORDER})")
_W = "CASE mapping_type WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 1 END"
K = (
    I
    + f""", k AS (SELECT *, route || '_' || CAST(island AS BIGINT) AS cluster_id FROM s WHERE island_size BETWEEN 2 AND 150),
ks AS (SELECT cluster_id, max(end2) - min(start1) + 1 AS cluster_size, sum(edit1 + edit2) AS total_edits, sum({_W}) AS weight_tenths, bool_or(chrom1 <> chrom2 OR end2 - start1 > 1000000) AS unlinked FROM k GROUP BY cluster_id),
b AS (SELECT read_id, first(cluster_id ORDER BY weight_tenths DESC, total_edits, cluster_id) AS best FROM k JOIN ks USING (cluster_id) GROUP BY read_id),
h AS (SELECT k.*, cluster_id = best AS included FROM k JOIN b USING (read_id))"""
)


def _among(f: str, c: str) -> str:
    return f"coalesce({f}({c}) FILTER (included), {f}({c}))"


A = (
    K
    + f""", g AS (SELECT cluster_id, min(chrom1) AS chrom1, min(chrom2) AS chrom2, min(strand1) AS strand1, min(strand2) AS strand2,
  {_among("min", "start1")} AS min_start1, {_among("max", "end1")} AS max_end1, {_among("min", "start2")} AS min_start2, {_among("max", "end2")} AS max_end2,
  coalesce(sum(edit1) FILTER (included), 0) AS e1, coalesce(sum(edit2) FILTER (included), 0) AS e2, coalesce(sum(n1) FILTER (included), 0) AS q1, coalesce(sum(n2) FILTER (included), 0) AS q2,
  coalesce(sum(mapq) FILTER (included), 0) AS qual, count(*) FILTER (included) AS fs, count(*) AS num_pairs, count(DISTINCT read_id) FILTER (included) AS distinct_reads,
  sum({_W}) AS aw, coalesce(sum({_W}) FILTER (included), 0) AS fw,
  count(*) FILTER (included AND mapping_type = 1) AS num_uniq, count(*) FILTER (included AND mapping_type = 2) AS num_anch, count(*) FILTER (included AND mapping_type = 3) AS num_mult
  FROM h GROUP BY cluster_id),
calls AS (SELECT chrom1, min_start1, max_end1, chrom2, min_start2, max_end2, cluster_id AS contig_id, fs AS distinct_pairs, strand1, strand2,
  CASE WHEN fs > 0 THEN CAST(e1 // fs AS BIGINT) ELSE 0 END AS mean_mm1, CASE WHEN fs > 0 THEN CAST(e2 // fs AS BIGINT) ELSE 0 END AS mean_mm2,
  CASE WHEN fs > 0 THEN CAST(q1 // fs AS BIGINT) ELSE 0 END AS mean_mappings1, CASE WHEN fs > 0 THEN CAST(q2 // fs AS BIGINT) ELSE 0 END AS mean_mappings2,
  CASE WHEN fs > 0 THEN CAST(qual // fs AS BIGINT) ELSE 0 END AS mean_mapq1, CASE WHEN fs > 0 THEN CAST(qual // fs AS BIGINT) ELSE 0 END AS mean_mapq2,
  max_end2 - min_start1 + 1 AS contig_size, num_pairs, CAST(aw AS DOUBLE) / 10 AS all_weighted_support, fs AS final_support, CAST(fw AS DOUBLE) / 10 AS final_weighted_support, num_uniq, num_anch, num_mult, distinct_reads FROM g),
finals AS (SELECT * FROM calls WHERE distinct_reads >= 2)"""
)
_KEY = "chrom1, chrom2, strand1, strand2"
_AGREE = """least(a.max_end1, b.max_end1) - greatest(a.min_start1, b.min_start1) > -25000 AND least(a.max_end2, b.max_end2) - greatest(a.min_start2, b.min_start2) > -25000
  AND (a.chrom1 <> a.chrom2 OR least(a.min_start2, b.min_start2) - greatest(a.max_end1, b.max_end1) > 0)"""
V = A + f", v AS (SELECT a.contig_id AS id_a, b.contig_id AS id_b FROM finals a JOIN finals b USING ({_KEY}) WHERE a.contig_id < b.contig_id AND {_AGREE})"
BREAKS = (
    A
    + """, breaks AS (SELECT chrom1, CASE strand1 WHEN '+' THEN max_end1 - 11 ELSE min_start1 - 200 END AS break_start1, CASE strand1 WHEN '+' THEN max_end1 + 200 ELSE min_start1 + 11 END AS break_end1,
  chrom2, CASE strand2 WHEN '+' THEN max_end2 - 11 ELSE min_start2 - 200 END AS break_start2, CASE strand2 WHEN '+' THEN max_end2 + 200 ELSE min_start2 + 11 END AS break_end2,
  contig_id AS id, distinct_pairs AS score, strand1, strand2,
  CASE WHEN chrom1 = chrom2 AND max_end2 - min_start1 <= 1000000 THEN 'local_' ELSE 'distant_' END || CASE WHEN strand1 = strand2 THEN 'inversion' WHEN strand1 = '+' THEN 'deletion' ELSE 'duplication' END AS variant FROM finals)"""
)
_RUN = f"PARTITION BY {_KEY} ORDER BY min_start1, max_end1, min_start2, max_end2, contig_id"
_LAG = lambda c: f"lag({c}) OVER w"
RUNS = (
    A
    + f""", q AS (SELECT *, CASE WHEN least(max_end1, {_LAG("max_end1")}) - greatest(min_start1, {_LAG("min_start1")}) > -25000 AND least(max_end2, {_LAG("max_end2")}) - greatest(min_start2, {_LAG("min_start2")}) > -25000
   AND {_LAG("contig_id")} IS NOT NULL AND (chrom1 <> chrom2 OR least(min_start2, {_LAG("min_start2")}) - greatest(max_end1, {_LAG("max_end1")}) > 0) THEN 0 ELSE 1 END AS opens FROM finals WINDOW w AS ({_RUN})),
u AS (SELECT *, sum(opens) OVER ({_RUN} ROWS UNBOUNDED PRECEDING) AS run FROM q),
z AS (SELECT a.contig_id, bool_and({_AGREE}) AS agrees FROM u a JOIN u b USING ({_KEY}, run) GROUP BY a.contig_id),
runs AS (SELECT u.*, z.agrees FROM u JOIN z USING (contig_id))"""
)
_MEANS = ["mean_mm1", "mean_mm2", "mean_mappings1", "mean_mappings2", "mean_mapq1", "mean_mapq2"]
_SUMS = ["distinct_pairs", "num_pairs", "final_support", "num_uniq", "num_anch", "num_mult"]
_WEIGHTS = ["all_weighted_support", "final_weighted_support"]
_WHOLE = ", ".join(
    ["min(contig_id) AS contig_id, min(min_start1) AS min_start1, max(max_end1) AS max_end1, min(min_start2) AS min_start2, max(max_end2) AS max_end2, list_sort(flatten(list(members))) AS members"]
    + [f"CAST(sum({c}) // count(*) AS BIGINT) AS {c}" for c in _MEANS]
    + [f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _SUMS]
    + [f"CAST(sum(CAST(round({c} * 10) AS BIGINT)) AS DOUBLE) / 10 AS {c}" for c in _WEIGHTS]
)
#: Rounds that the SQL spells out; more than the given tables need, and a round on settled calls changes nothing.
_RUN_ROUNDS, _PAIR_ROUNDS = 8, 12


def _by_runs(of: str, to: str, by: str) -> str:
    """A round of merging the calls of runs that all agree."""
    rest = ", ".join(c for c in ("min_start1", "max_end1", "min_start2", "max_end2", "contig_id") if c != by)
    window = f"PARTITION BY {_KEY} ORDER BY {by}, {rest}"
    return f""", q_{to} AS MATERIALIZED (SELECT *, CASE WHEN least(max_end1, lag(max_end1) OVER w) - greatest(min_start1, lag(min_start1) OVER w) > -25000 AND least(max_end2, lag(max_end2) OVER w) - greatest(min_start2, lag(min_start2) OVER w) > -25000
   AND lag(contig_id) OVER w IS NOT NULL AND (chrom1 <> chrom2 OR least(min_start2, lag(min_start2) OVER w) - greatest(max_end1, lag(max_end1) OVER w) > 0) THEN 0 ELSE 1 END AS opens FROM {of} WINDOW w AS ({window})),
u_{to} AS MATERIALIZED (SELECT *, sum(opens) OVER ({window} ROWS UNBOUNDED PRECEDING) AS run FROM q_{to}),
z_{to} AS MATERIALIZED (SELECT a.contig_id, bool_and({_AGREE}) AS agrees FROM u_{to} a JOIN u_{to} b USING ({_KEY}, run) GROUP BY a.contig_id),
{to} AS MATERIALIZED (SELECT {_KEY}, {_WHOLE} FROM u_{to} JOIN z_{to} USING (contig_id) GROUP BY {_KEY}, CASE WHEN agrees THEN 'run ' || run ELSE 'id ' || contig_id END)"""


def _by_pairs(of: str, to: str) -> str:
    """A round of merging the pairs that have the least rank at both of their calls."""
    return f""", v_{to} AS MATERIALIZED (SELECT a.contig_id AS id_a, b.contig_id AS id_b, md5(a.contig_id || '~' || b.contig_id) || '~' || a.contig_id || '~' || b.contig_id AS pair FROM {of} a JOIN {of} b USING ({_KEY}) WHERE a.contig_id < b.contig_id AND {_AGREE}),
e_{to} AS MATERIALIZED (SELECT id, min(pair) AS pair FROM (SELECT id_a AS id, pair FROM v_{to} UNION ALL SELECT id_b, pair FROM v_{to}) GROUP BY id),
p_{to} AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY pair) AS grp FROM e_{to} QUALIFY count(*) OVER (PARTITION BY pair) = 2),
{to} AS MATERIALIZED (SELECT {_KEY}, {_WHOLE} FROM {of} LEFT JOIN p_{to} ON id = contig_id GROUP BY {_KEY}, coalesce(grp, contig_id))"""


MERGED = A + ", r0 AS MATERIALIZED (SELECT *, [contig_id] AS members FROM finals)"
for _i in range(_RUN_ROUNDS):
    MERGED += _by_runs(f"r{_i}", f"s{_i}", "min_start1") + _by_runs(f"s{_i}", f"r{_i + 1}", "min_start2")
MERGED += f", w0 AS (SELECT * FROM r{_RUN_ROUNDS})"
for _i in range(_PAIR_ROUNDS):
    MERGED += _by_pairs(f"w{_i}", f"w{_i + 1}")
MERGED += f", merged AS MATERIALIZED (SELECT *, CASE WHEN len(members) > 1 THEN contig_id || '.m' ELSE contig_id END AS master_id FROM w{_PAIR_ROUNDS})"
ALN = """, t AS (SELECT *, CAST(substr(chrom1, 4) AS INTEGER) - 1 AS t1, CAST(substr(chrom2, 4) AS INTEGER) - 1 AS t2, CASE WHEN chrom1 = chrom2 THEN greatest(end1, end2) - least(start1, start2) ELSE 0 END AS span FROM m),
aln AS (
  SELECT file_num, read_id || '_' || row_id AS qname, t1 AS tid, chrom1 AS rname, start1 AS pos, end1 AS aend, t2 AS rnext, start2 AS pnext, CASE WHEN start1 <= start2 THEN span ELSE -span END AS tlen,
         mapq, mapq % 10 = 9 AS unmapped, strand1 = '-' AS is_reverse, strand2 = '-' AS mate_is_reverse, mapq % 7 = 6 AS is_duplicate, TRUE AS is_read1, edit1 AS nm FROM t
  UNION ALL
  SELECT file_num, read_id || '_' || row_id, t2, chrom2, start2, end2, t1, start1, CASE WHEN start2 <= start1 THEN span ELSE -span END,
         mapq, mapq % 10 = 9, strand2 = '-', strand1 = '-', mapq % 7 = 6, FALSE, edit2 FROM t)"""
DISC = (
    M
    + ALN
    + """, d AS (SELECT aln.*, sample FROM aln JOIN libraries USING (file_num) WHERE NOT unmapped AND NOT is_duplicate AND (tid <> rnext OR is_reverse = mate_is_reverse
  OR NOT ((NOT is_reverse AND mate_is_reverse AND pos <= pnext) OR (is_reverse AND NOT mate_is_reverse AND pos >= pnext)) OR abs(tlen) > exp_size + variance * num_devs))"""
)
FACING = M + ALN + ", p AS (SELECT file_num, tlen FROM aln WHERE NOT is_reverse AND mate_is_reverse AND tlen > 0 AND tid = rnext), md AS (SELECT file_num, median(tlen) AS median_size FROM p GROUP BY file_num)"
DUP = (
    M
    + """, e AS (SELECT *, CASE strand1 WHEN '-' THEN end1 ELSE start1 END AS p1, CASE strand2 WHEN '-' THEN end2 ELSE start2 END AS p2 FROM m),
l AS (SELECT row_id, chrom1, chrom2, strand1, strand2, p1, p2, read_id, coalesce(abs(p1 - lag(p1) OVER w) <= 40 AND abs(p2 - lag(p2) OVER w) <= 40 AND read_id <> lag(read_id) OVER w, FALSE) AS duplicate
  FROM e WINDOW w AS (PARTITION BY chrom1, chrom2, strand1, strand2 ORDER BY p1, p2, read_id, row_id))"""
)


def _dedup(slop: int, either: bool) -> str:
    """Blocks of duplicates in one order or two, reads tied through them, the best of each group; rows left and their names."""
    near = f"abs(p1 - lag(p1) OVER w) <= {slop} {'OR' if either else 'AND'} abs(p2 - lag(p2) OVER w) <= {slop}"
    passes = [
        f"""SELECT *, '{i}.' || chrom1 || '.' || chrom2 || '.' || strand1 || '.' || strand2 || '.' || sum(opens) OVER (PARTITION BY {_KEY} ORDER BY p{i}, p{3 - i}, read_id, row_id ROWS UNBOUNDED PRECEDING) AS block
  FROM (SELECT *, CASE WHEN ({near}) AND read_id <> lag(read_id) OVER w THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY {_KEY} ORDER BY p{i}, p{3 - i}, read_id, row_id))"""
        for i in ((1, 2) if either else (1,))
    ]
    return (
        M.replace("WITH ", "WITH RECURSIVE ", 1)
        + f""", e AS (SELECT *, CASE strand1 WHEN '-' THEN end1 ELSE start1 END AS p1, CASE strand2 WHEN '-' THEN end2 ELSE start2 END AS p2 FROM m),
blocks AS MATERIALIZED (SELECT row_id, read_id, edit1 + edit2 AS edits, block FROM ({" UNION ALL ".join(passes)}) QUALIFY count(*) OVER (PARTITION BY block) > 1),
heads AS MATERIALIZED (SELECT block, min(read_id) AS head, first(read_id ORDER BY edits, read_id) AS own FROM blocks GROUP BY block),
links AS MATERIALIZED (SELECT DISTINCT head AS a, read_id AS b FROM blocks JOIN heads USING (block) UNION SELECT read_id, head FROM blocks JOIN heads USING (block)),
reach(id, root) AS (SELECT DISTINCT read_id, read_id FROM blocks UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id WHERE r.root < l.b),
roots AS MATERIALIZED (SELECT id, min(root) AS root FROM reach GROUP BY id),
best AS MATERIALIZED (SELECT root, first(read_id ORDER BY edits, read_id) AS best FROM blocks JOIN roots ON id = read_id GROUP BY root),
tied AS MATERIALIZED (SELECT row_id, block, read_id, best FROM blocks JOIN roots ON id = read_id JOIN best USING (root)),
stays AS (SELECT block, CASE WHEN bool_or(read_id = best) THEN any_value(best) ELSE any_value(own) END AS stays FROM tied JOIN heads USING (block) GROUP BY block)
SELECT row_id, coalesce(best, read_id) AS read_id FROM m LEFT JOIN roots ON id = read_id LEFT JOIN best USING (root) WHERE row_id NOT IN (SELECT row_id FROM tied JOIN stays USING (block) WHERE read_id <> stays)"""
    )


PAIRS = (
    M
    + """, ends AS (SELECT DISTINCT * FROM (SELECT read_id, 1 AS num, chrom1 AS chrom, start1 AS s, end1 AS e, edit1 AS edit, strand1 AS strand FROM m UNION ALL SELECT read_id, 2, chrom2, start2, end2, edit2, strand2 FROM m)),
cnt AS (SELECT read_id, count(*) FILTER (num = 1) AS m1, count(*) FILTER (num = 2) AS m2 FROM ends GROUP BY read_id),
usable AS (SELECT * FROM cnt WHERE m1 > 0 AND m2 > 0 AND CASE WHEN m1 = 1 OR m2 = 1 THEN greatest(m1, m2) <= 1000 ELSE m1 * m2 <= 100 END),
both_ends AS (SELECT a.read_id, m1, m2, a.chrom AS c1, a.s AS s1, a.e AS e1, a.edit AS d1, a.strand AS x1, b.chrom AS c2, b.s AS s2, b.e AS e2, b.edit AS d2, b.strand AS x2, a.edit + b.edit AS edits,
   greatest(a.s, b.s) - least(a.e, b.e) AS gap FROM ends a JOIN ends b USING (read_id) JOIN usable USING (read_id) WHERE a.num = 1 AND b.num = 2),
sized AS (SELECT *, CASE WHEN c1 = c2 AND gap + e1 - s1 + e2 - s2 <= 1000000 THEN gap + e1 - s1 + e2 - s2 END AS frag_size,
   c1 = c2 AND ((x1 = '+' AND x2 = '-' AND e2 - s1 >= 200 AND e2 - s1 < 500) OR (x1 = '-' AND x2 = '+' AND e1 - s2 >= 200 AND e1 - s2 < 500) OR gap <= 0) AS spoils FROM both_ends),
best AS (SELECT *, bool_or(spoils) OVER (PARTITION BY read_id) AS spoilt, min(edits) OVER (PARTITION BY read_id) AS least_edits FROM sized),
kept AS (SELECT *, c1 > c2 OR (c1 = c2 AND s1 > s2) AS flip FROM best WHERE NOT spoilt AND edits <= least_edits + 1
   QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY edits, frag_size NULLS LAST, c1, s1, e1, x1, c2, s2, e2, x2, d1) <= 1000)"""
)
TAGGED = (
    M
    + """, ends AS (SELECT * FROM (SELECT DISTINCT * FROM (SELECT read_id, 1 AS num, chrom1 AS chrom, start1 AS s, end1 AS e, edit1 AS edit, strand1 AS strand FROM m UNION ALL SELECT read_id, 2, chrom2, start2, end2, edit2, strand2 FROM m)) WHERE num = 1 OR s % 7 <> 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY read_id, num ORDER BY chrom, s, e, strand, edit) AS place FROM ends),
cnt AS (SELECT *, CASE WHEN m1 = 0 OR m2 = 0 THEN 'orphan' WHEN CASE WHEN m1 = 1 OR m2 = 1 THEN greatest(m1, m2) > 4 ELSE m1 * m2 > 6 END THEN 'repeat' END AS why FROM (SELECT read_id, count(*) FILTER (num = 1) AS m1, count(*) FILTER (num = 2) AS m2 FROM ends GROUP BY read_id)),
both_ends AS (SELECT a.read_id, m1, m2, a.chrom AS c1, a.s AS s1, a.e AS e1, a.edit AS d1, a.strand AS x1, b.chrom AS c2, b.s AS s2, b.e AS e2, b.edit AS d2, b.strand AS x2, a.edit + b.edit AS edits, a.place AS p1, b.place AS p2,
   greatest(a.s, b.s) - least(a.e, b.e) AS gap FROM placed a JOIN placed b USING (read_id) JOIN cnt USING (read_id) WHERE a.num = 1 AND b.num = 2 AND why IS NULL),
sized AS (SELECT *, CASE WHEN c1 = c2 AND gap + e1 - s1 + e2 - s2 <= 1000000 THEN gap + e1 - s1 + e2 - s2 END AS frag_size,
   CASE WHEN c1 = c2 AND ((x1 = '+' AND x2 = '-' AND e2 - s1 >= 200 AND e2 - s1 < 500) OR (x1 = '-' AND x2 = '+' AND e1 - s2 >= 200 AND e1 - s2 < 500)) THEN 'concordant' WHEN c1 = c2 AND gap <= 0 THEN 'badSpan' ELSE 'discordant' END AS tag FROM both_ends),
best AS (SELECT *, bool_or(tag <> 'discordant') OVER (PARTITION BY read_id) AS spoilt, min(edits) OVER (PARTITION BY read_id) AS least_edits FROM sized),
kept AS (SELECT *, c1 > c2 OR (c1 = c2 AND (s1 > s2 OR (s1 = s2 AND tag <> 'discordant'))) AS flip FROM (SELECT * FROM best WHERE NOT spoilt AND edits <= least_edits + 1
   QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY edits, p1 + p2, c1, s1, e1, x1, c2, s2, e2, x2, d1) <= 3
   UNION ALL SELECT * FROM best WHERE spoilt AND tag <> 'discordant' QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY p1, p2) = 1))"""
)


def _flip(a: str, i: int) -> str:
    return f"CASE WHEN flip THEN {a}{3 - i} ELSE {a}{i} END"


_MARK = "contig_id || ',' || distinct_pairs"
_BOTH = "chrom1 || ':' || min_start1 || '-' || max_end1 || ',' || chrom2 || ':' || min_start2 || '-' || max_end2"
_RGB = "CASE strand1 || strand2 WHEN '+-' THEN '153,0,0' WHEN '-+' THEN '0,102,0' ELSE '0,51,204' END AS rgb"


def _single(i: int) -> str:
    s, e, plus = f"min_start{i}", f"max_end{i}", f"strand{i} = '+'"
    start, end = f"CASE WHEN {plus} THEN {s} ELSE {s} - 500 END", f"CASE WHEN {plus} THEN {e} + 500 ELSE {e} END"
    return f"""SELECT chrom{i} AS chrom, {start} AS "start", {end} AS "end", {_MARK} || CASE WHEN chrom1 = chrom2 THEN ':intra:' ELSE ':inter:' END || {_BOTH} AS name, abs(max_end2 - min_start1) AS score, strand{i} AS strand,
  {start} AS thick_start, {end} AS thick_end, {_RGB}, 2 AS block_count, CASE WHEN {plus} THEN ({e} - {s}) || ',1' ELSE '1,' || ({e} - {s}) END AS block_sizes,
  CASE WHEN {plus} THEN '0,' || ({e} - {s} + 499) ELSE '0,500' END AS block_starts FROM finals WHERE NOT (chrom1 = chrom2 AND abs(max_end2 - min_start1) <= 1000000)"""


def _cull(where: str) -> str:
    return M + C + f" SELECT row_id, mapping_type, n1 AS mappings1, n2 AS mappings2 FROM c WHERE {where}"


_SIZES = " SELECT route, CAST(island AS BIGINT) AS island, count(*) AS n, min(start1) AS first_start, max(end1) AS last_end FROM i GROUP BY route, island"

ORACLES: dict[str, str] = {
    "config_truncation": M + " SELECT file_num, sample, CAST(2 * trunc(num_devs) * trunc(variance) AS INTEGER) AS length_tol, CAST(2 * (trunc(exp_size) + trunc(num_devs) * trunc(variance)) AS INTEGER) AS span_tol, count(*) AS mappings FROM m JOIN libraries USING (file_num) GROUP BY ALL",
    "frag_size": M + " SELECT row_id, start2 - end1 + 1 AS frag_size, CAST(abs(start2 - end1 + 1 - trunc(exp_size)) AS BIGINT) AS size_off FROM m JOIN libraries USING (file_num)",
    "mate_order": M + O + " SELECT row_id, chrom1, start1, end1, strand1, chrom2, start2, end2, strand2, edit1, edit2, flipped FROM o",
    "mapping_type_best": _cull("edit1 + edit2 <= least"),
    "mapping_type_within1": _cull("edit1 + edit2 <= least + 1"),
    "mapping_type_all": _cull("TRUE"),
    "mapping_type_given": M + ", g AS (SELECT file_num, read_id, min_by(mapq % 3 + 1, row_id) AS n1, min_by(mapq % 2 + 1, row_id) AS n2 FROM m GROUP BY ALL) SELECT row_id, CASE WHEN n1 = 1 AND n2 = 1 THEN 1 WHEN n1 = 1 OR n2 = 1 THEN 2 ELSE 3 END AS mapping_type FROM m JOIN g USING (file_num, read_id)",
    "inner_span_filter": M + O + " SELECT row_id FROM o WHERE start2 > end1",
    "route_counts": M + R + " SELECT route, count(*) AS mappings FROM r GROUP BY route",
    "inversion_routes": M + O + " SELECT chrom1 || '.' || chrom2 || '.+.+' AS route, count(*) AS mappings FROM o WHERE strand1 = strand2 GROUP BY 1",
    "islands_gap": M + I + _SIZES,
    "islands_inner": M + INNER + _SIZES,
    "punted_islands": M + I + " SELECT row_id, route, CAST(island AS BIGINT) AS island, island_size FROM s WHERE island_size > 12",
    "punted_calls": M + I + " SELECT row_id, route, CAST(island AS BIGINT) AS island, island_size FROM s WHERE island_size > 9",
    "pair_support": M + I + """, x AS (SELECT s.*, abs(start2 - end1 + 1 - CAST(exp_size AS INTEGER)) AS size_off, 2 * CAST(num_devs * variance AS INTEGER) AS lt, 2 * CAST(exp_size + num_devs * variance AS INTEGER) AS st FROM s JOIN libraries USING (file_num) WHERE island_size BETWEEN 2 AND 150)
 SELECT a.row_id, count(b.row_id) AS support FROM x a LEFT JOIN x b ON a.route = b.route AND a.island = b.island AND a.row_id <> b.row_id AND abs(a.size_off - b.size_off) <= greatest(a.lt, b.lt)
  AND abs(b.start1 - a.start1) + abs(b.end2 - a.end2) <= greatest(a.st, b.st) AND (a.chrom1 <> a.chrom2 OR b.chrom1 <> b.chrom2 OR least(a.start2, b.start2) - greatest(a.end1, b.end1) > 0) GROUP BY a.row_id""",
    "cluster_stats": M + K + " SELECT cluster_id, cluster_size, CAST(total_edits AS BIGINT) AS total_edits, CAST(weight_tenths AS BIGINT) AS weight_tenths, unlinked FROM ks",
    "best_cluster_per_read": M + K + " SELECT row_id, cluster_id, included FROM h",
    "all_calls": M + A + " SELECT * FROM calls WHERE all_weighted_support > 0",
    "final_calls": M + A + " SELECT * FROM finals",
    "final_detail": M + A + " SELECT row_id, cluster_id AS contig_id, CASE WHEN included THEN 'Y' ELSE 'N' END AS included, mapping_type FROM h WHERE cluster_id IN (SELECT contig_id FROM finals)",
    "sample_frequency_pivot": M + A + " SELECT cluster_id AS contig_id, " + ", ".join(f"count(*) FILTER (split_part(read_id, '.', 1) = 'S{i}') AS S{i}" for i in range(3)) + " FROM h WHERE included AND cluster_id IN (SELECT contig_id FROM finals) GROUP BY 1",
    "frequency_table": M + A + ", y AS (SELECT cluster_id AS contig_id, " + ", ".join(f"count(*) FILTER (split_part(read_id, '.', 1) = 'S{i}') AS S{i}Y" for i in range(3)) + " FROM h WHERE included GROUP BY 1) SELECT finals.* EXCLUDE (distinct_reads), S0Y, S1Y, S2Y FROM finals JOIN y USING (contig_id)",
    "numbered_calls": M + A + f" SELECT contig_id, row_number() OVER (PARTITION BY {_KEY} ORDER BY min_start1, max_end1, min_start2, max_end2, contig_id) AS number FROM finals",
    "breakpoint_intervals": M + BREAKS + " SELECT * FROM breaks",
    "variant_counts": M + BREAKS + " SELECT variant, count(*) AS calls, CAST(sum(score) AS BIGINT) AS score FROM breaks GROUP BY variant",
    "bed12_rows": M + A + f""" SELECT chrom1 AS chrom, min_start1 AS "start", max_end2 AS "end", {_MARK} || ':' || strand1 || '/' || strand2 || ':intra:' || chrom1 || ':' || min_start1 || '-' || max_end2 AS name, abs(max_end2 - min_start1) AS score, '+' AS strand,
  min_start1 AS thick_start, max_end2 AS thick_end, {_RGB}, 2 AS block_count, (max_end1 - min_start1) || ',' || (max_end2 - min_start2) AS block_sizes, '0,' || (min_start2 - min_start1) AS block_starts
  FROM finals WHERE chrom1 = chrom2 AND abs(max_end2 - min_start1) <= 1000000 UNION ALL {_single(1)} UNION ALL {_single(2)}""",
    "size_sample": FACING.replace("SELECT file_num, tlen FROM aln", "SELECT file_num, qname, pos, tlen FROM aln") + " SELECT file_num, qname, tlen FROM p QUALIFY row_number() OVER (PARTITION BY file_num ORDER BY md5(qname), qname, pos, tlen) <= 1000",
    "lib_median_mad": FACING + " SELECT file_num, any_value(median_size) AS median_size, median(abs(tlen - median_size)) AS mad, count(*) AS pairs FROM p JOIN md USING (file_num) GROUP BY file_num",
    "discordant_filter": DISC + " SELECT qname, is_read1, tlen FROM d",
    "mate_pairing": DISC + """, g AS (SELECT file_num, qname, any_value(sample) AS sample, min(z) AS x, max(z) AS y, count(*) AS n, count(*) FILTER (is_read1) AS ones FROM (
  SELECT file_num, qname, sample, is_read1, {'a_tid': tid, 'b_pos': pos, 'c_end': aend, 'd_mate': CASE WHEN is_read1 THEN 1 ELSE 2 END, 'chrom': rname, 'strand': CASE WHEN is_reverse THEN '-' ELSE '+' END, 'edit': nm, 'mapq': mapq} AS z FROM d WHERE mapq >= 5) GROUP BY file_num, qname)
 SELECT x.chrom AS chrom1, x.b_pos AS start1, x.c_end AS end1, y.chrom AS chrom2, y.b_pos AS start2, y.c_end AS end2, sample || '.' || qname AS read_id, x.d_mate AS which_mate_is_block1,
  x.strand AS strand1, y.strand AS strand2, x.edit AS edit1, y.edit AS edit2, 1 AS mappings1, 1 AS mappings2, x.mapq AS mapq1, y.mapq AS mapq2, file_num FROM g WHERE n = 2 AND ones = 1""",
    "footprint_overlap_join": M + V + " SELECT id_a, id_b FROM v",
    "notboth_anti": M + V + " SELECT contig_id FROM finals WHERE contig_id NOT IN (SELECT id_a FROM v UNION SELECT id_b FROM v)",
    "merge_runs": M + RUNS + " SELECT contig_id, CAST(run AS BIGINT) AS run, agrees FROM runs",
    "merge_round": M + RUNS + f""" SELECT min(contig_id) AS contig_id, min(min_start1) AS min_start1, max(max_end1) AS max_end1, min(min_start2) AS min_start2, max(max_end2) AS max_end2, CAST(sum(distinct_pairs) AS BIGINT) AS distinct_pairs,
  CAST(sum(mean_mapq1) // count(*) AS BIGINT) AS mean_mapq1, CAST(count(*) AS INTEGER) AS n_members FROM runs GROUP BY {_KEY}, CASE WHEN agrees THEN 'run ' || CAST(run AS BIGINT) ELSE 'id ' || contig_id END""",
    "merge_fixpoint": M + MERGED + f" SELECT {_KEY}, min_start1, max_end1, min_start2, max_end2, master_id, array_to_string(members, ',') AS members, final_support FROM merged",
    "merged_final": M + MERGED + " SELECT chrom1, min_start1, max_end1, chrom2, min_start2, max_end2, master_id AS contig_id, distinct_pairs, strand1, strand2, " + ", ".join(_MEANS) + ", max_end2 - min_start1 + 1 AS contig_size, num_pairs, all_weighted_support, final_support, final_weighted_support, num_uniq, num_anch, num_mult FROM merged",
    "merge_map": M + MERGED + " SELECT master_id, array_to_string(members, ',') AS members FROM merged",
    "merged_detail": M + MERGED + ", ids AS (SELECT unnest(members) AS cluster_id, master_id FROM merged) SELECT row_id, master_id AS contig_id, CASE WHEN included THEN 'Y' ELSE 'N' END AS included FROM h JOIN ids USING (cluster_id)",
    "dedup_reads": _dedup(40, False),
    "dedup_either": _dedup(1, True),
    "assembled_rows": M + K + """ SELECT chrom1, CAST(start1 AS INTEGER) AS start1, CAST(end1 AS INTEGER) AS end1, chrom2, CAST(start2 AS INTEGER) AS start2, CAST(end2 AS INTEGER) AS end2, read_id, which_mate AS which_mate_is_block1, strand1, strand2, edit1, edit2,
  CAST(n1 AS INTEGER) AS mappings1, CAST(n2 AS INTEGER) AS mappings2, mapq AS mapq1, mapq AS mapq2, mapping_type, CAST(abs(start2 - end1 + 1 - CAST(exp_size AS INTEGER)) AS INTEGER) AS size_off, 1 AS support, cluster_id, 1 AS used, 1 AS include, file_num FROM k JOIN libraries USING (file_num)""",
    "binary_alignments": M + ALN + " SELECT file_num, qname, CAST(tid AS INTEGER) AS tid, rname, CAST(pos AS INTEGER) AS pos, CAST(aend AS INTEGER) AS aend, CAST(rnext AS INTEGER) AS rnext, CAST(pnext AS INTEGER) AS pnext, CAST(tlen AS INTEGER) AS tlen, mapq, TRUE AS is_paired, unmapped AS is_unmapped, unmapped AS mate_is_unmapped, is_reverse, mate_is_reverse, is_duplicate, is_read1, CASE WHEN nm > 0 THEN nm END AS nm FROM aln",
    "dup_runs": DUP + " SELECT row_id, duplicate, CAST(sum(CASE WHEN duplicate THEN 0 ELSE 1 END) OVER (PARTITION BY chrom1, chrom2, strand1, strand2 ORDER BY p1, p2, read_id, row_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM l",
    "pair_combinations": PAIRS + " SELECT " + ", ".join(f"{_flip(a, i)} AS {b}{i}" for i in (1, 2) for a, b in (("c", "chrom"), ("s", "start"), ("e", "end"), ("x", "strand"), ("d", "edit"))) + ", read_id, CASE WHEN flip THEN 2 ELSE 1 END AS which_mate_is_block1, CASE WHEN flip THEN m2 ELSE m1 END AS mappings1, CASE WHEN flip THEN m1 ELSE m2 END AS mappings2, frag_size FROM kept",
    "tagged_pairs": TAGGED + " SELECT " + ", ".join(f"{_flip(a, i)} AS {b}{i}" for i in (1, 2) for a, b in (("c", "chrom"), ("s", "start"), ("e", "end"), ("x", "strand"), ("d", "edit"))) + ", read_id, CASE WHEN flip THEN 2 ELSE 1 END AS which_mate_is_block1, CASE WHEN flip THEN m2 ELSE m1 END AS mappings1, CASE WHEN flip THEN m1 ELSE m2 END AS mappings2, frag_size, edits AS total_edits, p1 + p2 AS place, tag FROM kept UNION ALL SELECT "
    + ", ".join("NULL" for _ in range(10)) + ", read_id, NULL, NULL, NULL, NULL, NULL, NULL, why FROM cnt WHERE why IS NOT NULL",
}
ORACLES["track_lines"] = "SELECT chrom, \"start\", concat_ws('\t', chrom, \"start\", \"end\", name, score, strand, thick_start, thick_end, rgb, block_count, block_sizes, block_starts) AS line FROM (" + ORACLES["bed12_rows"] + ")"
