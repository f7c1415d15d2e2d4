"""Hard negatives, conversation repair and web archives against brute force and round trips, with awkward rows."""

import hashlib
import itertools
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from fissure.llm import negatives, repair, tokens, warc


def plain_negatives(rows, anchors, positives=5, most=5, low=80, high=100):
    """rows: {(vec_id, label, components)}; the rule restated."""
    rows = sorted(rows)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for i, label, v in rows:
        if not anchors(i):
            continue
        scored = sorted(((-dot(v, w), j, other) for j, other, w in rows if j != i and len(w) == len(v)), key=lambda x: x[:2])
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            here = [(-t, j) for t, j, other in scored if other != label and low * -s <= 100 * -t <= high * -s][:most]
            out += [(i, p, rank, j, -s, t) for rank, (t, j) in enumerate(here, 1)]
    return Counter(out)


def got_negatives(frame, **more):
    return Counter(map(tuple, negatives.hard_negatives(frame, F.col("vec_id") % 100 == 0, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def test_packed_products_are_exact():
    rng = np.random.default_rng(1)
    for d, low, high in [(0, -1, 2), (1, -3, 4), (64, -300, 301), (64, 5, 6), (7, -(1 << 20), 1 << 20), (33, -(1 << 25), 1 << 25), (3, -(1 << 30), 1 << 30), (2, 0, 1)]:
        vectors, asked = rng.integers(low, high, (37, d)), rng.integers(low, high, (5, d))
        packed = negatives.Packed(vectors, np.arange(37), np.zeros(37, np.int64))
        assert (packed.scores(asked) == asked @ vectors.T).all()
    two = negatives.Packed(rng.integers(-150, 150, (10, 64)), np.arange(10), np.zeros(10, np.int64))
    assert 53 // (64 * 299 * 299).bit_length() == 2 and two._wide((64 * 299 * 299).bit_length())[0].shape == (5, 64)
    with pytest.raises(OverflowError):
        negatives.Packed(np.full((1, 4), 1 << 40), np.arange(1), np.zeros(1, np.int64)).scores(np.full((1, 4), 1 << 40))


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vector = lambda d=4: [rng.choice([-0.5, -0.25, 0.25, 0.5, 0.501]) for _ in range(d)]
    rows = [(i, rng.randrange(3), vector()) for i in range(0, 420)]  # few different scores: many ties
    rows += [(1000 + i, 1, vector(3)) for i in range(5)] + [(1100, 1, vector(3)), (1200, 0, []), (1201, 0, []), (1202, 1, []), (1300, 2, [0.0] * 4), (1400, 7, vector())]
    rows += [rows[100], rows[100], (100, 2, vector()), (7, 2, vector()), rows[8]]
    junk = [(None, 1, vector()), (1500, None, vector()), (1600, 1, None), (1700, 1, [0.5, None, 0.5, 0.5]), (1701, 0, [float("nan")] * 4), (1702, 0, [float("inf")] * 4)]
    frame = spark.createDataFrame(rows + junk, "vec_id long, label int, embedding array<float>").withColumns({c: F.lit("clash") for c in ("chunk", "dim", "raw", "rank", "anchor", "mark", "side")})
    whole = {(i, label, tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in v)) for i, label, v in rows}
    want = plain_negatives(whole, lambda i: i % 100 == 0)
    assert got_negatives(frame.repartition(7)) == want and len({k[0] for k in want}) >= 6
    monkeypatch.setattr(negatives, "CHUNK_VALUES", 64)  # many chunks, and anchors in small slices
    monkeypatch.setattr(negatives, "SLICE_SCORES", 40)
    assert got_negatives(frame) == want
    assert got_negatives(frame, positives=2, negatives=1, low=50, high=90) == plain_negatives(whole, lambda i: i % 100 == 0, 2, 1, 50, 90)
    assert not got_negatives(frame.filter("false")) and not got_negatives(frame.filter("vec_id % 100 <> 0"))


def test_large_components_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, [rng.choice([-1, 1]) * rng.random() * 2.0**20 for _ in range(5)]) for i in range(0, 300, 10)]
    whole = {(i, label, tuple(int(np.floor(256 * x)) for x in v)) for i, label, v in rows}
    assert got_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), low=1) == plain_negatives(whole, lambda i: i % 100 == 0, low=1)


def plain_repair(marks):
    """Least (cost, audit) over all edits, by the plain recursion over what stands in front."""
    best = {("", 0): (0, "")}  # (last initial, rows taken) from the start: audits grow at their ends, so all of a state's are kept
    found = []
    waiting = [(0, "", "", 0, False)]
    limit = 3 * len(marks)
    seen = set()
    while waiting:
        cost, audit, last, taken, any_ = waiting.pop()
        if cost > limit or (cost, audit, last, taken) in seen:
            continue
        seen.add((cost, audit, last, taken))
        if taken == len(marks) and (last == "a" or not any_):
            found.append((cost, audit))
        allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for role in set(allowed) & set("ua"):
            waiting.append((cost + 2, audit + "I", role, taken, True))
        if taken < len(marks):
            mark = marks[taken]
            waiting.append((cost + 3, audit + "D", last, taken + 1, any_))
            if not mark & repair.MUST_GO:
                more, initial = bool(mark & repair.CUT_SHORT), repair.LETTERS.get(mark & 3)
                if initial and initial in allowed:
                    waiting.append((cost + more, audit + "K", initial, taken + 1, True))
                for role in set(allowed) & set("ua"):
                    waiting.append((cost + 2 + more, audit + "R", role, taken + 1, True))
    return min(found) if best else None


def test_agenda_finds_the_least_of_all_edits():
    rng = random.Random(11)
    kinds = [0, 1, 2, 3, 1 | repair.MUST_GO, 2 | repair.MUST_GO, 3 | repair.MUST_GO, 0 | repair.CUT_SHORT, 1 | repair.CUT_SHORT, 2 | repair.CUT_SHORT, 3 | repair.CUT_SHORT]
    for size in [0, 1, 2, 3, 4] * 40:
        marks = bytes(rng.choice(kinds) for _ in range(size))
        want = plain_repair(marks)
        for window in (1, 2, 3, 64):
            assert repair.lightest(marks, window) == want, (marks, window)
    for _ in range(60):  # longer ones: windows change nothing
        marks = bytes(rng.choice(kinds) for _ in range(rng.randrange(5, 90)))
        assert len({repair.lightest(marks, w) for w in (1, 7, 64, 1000)}) == 1


def test_agenda_is_linear():
    marks = bytes([2, 3, 3, 2, 6, 11, 1]) * 3000
    began = time.time()
    cost, audit = repair.lightest(marks)
    assert time.time() - began < 15 and len(audit.replace("I", "")) == len(marks) and cost > 0


def plain_conversation(rows):
    """(turn, role, text) in order, after damage, to the query's columns."""
    visible = lambda t: t.rstrip(repair.BLANKS)
    seen, marks, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        fault = 0 if not visible(text) else 1 if (role, text) in seen else 2 if visible(text)[-1] not in ".!?" else None
        seen.add((role, text))
        mark = repair.INITIALS.get(role[:1], 0)
        if fault is not None:
            counts[fault] += 1
            mark |= repair.CUT_SHORT if fault == 2 else repair.MUST_GO
        marks.append(mark)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit = repair.lightest(bytes(marks))
    out, at, last = [], 0, ""
    for letter in audit:
        due = "assistant" if last == "u" else "user"
        row, at = (None, at) if letter == "I" else (rows[at], at + 1)
        if letter != "D":
            out.append((due, "") if row is None else (row[1] if letter == "K" else due, row[2]))
            last = out[-1][0][0]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def test_repair_equals_the_restatement(spark):
    rng = random.Random(2)
    texts = ["Yes.", "no", "", " \t\r\n", "What?  \n", "a. b", "…", "long " * 3000 + "end.", None, "Yes."]
    rows = []
    for conv in [*range(300), None]:
        for turn in range(rng.randrange(0, 9)):
            if rng.random() < 0.9:
                rows.append((conv, turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "uncle"]), rng.choice(texts)))
        rows += rng.sample(rows[-3:], min(len(rows[-3:]), rng.randrange(3)))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("copies", "first", "blank", "kind", "tie")})
    damaged, convs = defaultdict(list), {r[0] for r in rows}
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else text.translate({ord(c): None for c in ".!?"}) if code == 2 else text
        damaged[conv] += [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
    want = {c: plain_conversation(sorted(damaged[c], key=order)) for c in convs}
    got = {r[0]: tuple(r)[1:] for r in repair.repair_conversations(repair.damaged(frame)).collect()}
    assert got == want
    assert repair.repair_conversations(repair.damaged(frame.filter("false"))).count() == 0


def test_one_conversation_of_very_many_rows(spark):
    rows = spark.range(60_000).select(F.lit(1).cast("long").alias("conv_id"), (F.col("id") % 20_000).alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Row "), (F.col("id") % 20_000).cast("string"), F.lit(".")).alias("text"), F.lit(1).cast("long").alias("copies"))
    r = repair.repair_conversations(rows).collect()
    assert len(r) == 1 and r[0]["duplicate"] == 40_000 and r[0]["cost"] == 120_000 and r[0]["audit"] == "KDD" * 20_000


AWKWARD_PAGES = [
    (5, "http://a/1", "x" * 100), (3, "http://a/2", "x" * 100), (9, None, "x" * 100), (3, "http://a/0", "x" * 100), (3, "http://a/0", "x" * 100),
    (11, "http://b", "y" * 99), (12, "http://b", "y" * 99), (13, "http://é/ü\r\nWARC-Type: revisit\r\n\r\n", "é" * 60), (14, "http://c", "é" * 60), (15, "u", None), (16, "u", ""),
    (None, "http://d", "z" * 200), (None, "http://d", "z" * 200), (None, None, "x" * 100), (17, "http://e", "\r\n\r\nWARC/1.1\r\n\r\n" * 10), (18, "http://f", "long " * 200_000), (20, "http://f", "long " * 200_000), (21, "http://f", "w" * 150), (21, "http://f", "w" * 150),
]


def plain_pages(rows):
    groups = defaultdict(list)
    for page_id, url, html in rows:
        groups[(html or "").encode()].append((page_id is None, page_id or 0, url is None, url or ""))
    out = []
    for payload, members in groups.items():
        members.sort()
        first = None if members[0][0] or len(payload) < 100 else members[0][1]
        for k, (none, page_id, _, _) in enumerate(members):
            again = first is not None and k > 0
            out.append((None if none else page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", first if again else None))
    return Counter(out)


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_archives_round_trip(spark, tmp_path, broadcast_rows):
    pages = spark.createDataFrame(AWKWARD_PAGES, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("digest", "payload", "size", "first_id", "salt", "again", "n")}).repartition(3)
    folder = f"file://{tmp_path}/warc"
    index = warc.write_warc(pages, folder, frame=400, bundle=2000, broadcast_rows=broadcast_rows)
    assert Counter(map(tuple, warc.read_warc(index, frames=2).collect())) == plain_pages(AWKWARD_PAGES)
    rows = index.collect()
    assert len(rows) == len(AWKWARD_PAGES) and len({r["path"] for r in rows}) > 3 and max(r["frame"] for r in rows) > 0
    for r in rows:  # any record by its place, from one frame
        fields, block = warc.read_record(r["path"], r["frame"], r["offset"], r["length"])
        assert fields["warc-record-id"] == f"<{r['record_id']}>" and int(fields["content-length"]) == len(block)
    for path in {r["path"] for r in rows}:  # any reader of Zstandard gives the records in a row
        with open(path.removeprefix("file://"), "rb") as f:
            whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        assert [fields["warc-record-id"].strip("<>") for fields, _, _, _ in warc.parse_records(whole)] == [r["record_id"] for r in sorted((r for r in rows if r["path"] == path), key=lambda r: (r["frame"], r["offset"]))]
    one = [warc.read_record(r["path"], r["frame"], r["offset"], r["length"]) for r in rows if r["record_id"] == "urn:x-page:13"]
    assert one[0][1].endswith(("é" * 60).encode()) and "%0D%0A" in one[0][0]["warc-target-uri"] and one[0][0]["warc-type"] == "response"
    assert warc.read_warc(warc.write_warc(pages.filter("false"))).count() == 0


def test_damaged_archives_fail(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "some text that is long")], "page_id long, url string, html string")
    index = warc.write_warc(pages, f"file://{tmp_path}/warc").collect()
    path = index[0]["path"].removeprefix("file://")
    raw = open(path, "rb").read()
    (tmp_path / "cut").write_bytes(raw[:-3])
    with pytest.raises(ValueError, match="seek table"), tokens._open(f"file://{tmp_path}/cut") as f:
        warc.seek_table(f)


def word_sets(text, n):
    words = __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")
    return set(map(tuple, (words[i : i + n] for i in range(len(words) - n + 1)))) if len(words) >= n else {tuple(words)} if words else set()


def test_repeated_ids_are_documents_each(spark):
    from fissure.llm import sketch

    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    near = lambda c: text(c) + " and more"
    rows = [(1, text("a")), (1, text("b")), (2, near("a")), (3, near("b")), (2, text("c")), (2, text("c")), (4, text("d")), (4, near("d")), (5, None), (5, ""), (5, text("e")), (None, text("a")), (None, text("a")), (6, text("f")), (7, near("e"))]
    docs = spark.createDataFrame([(i, t, f"row {k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, p_high string").repartition(3)
    got = Counter(tuple(r) for r in sketch.near_duplicates(docs, 5, 80).select("doc_id", "component_id", "kept").collect())
    assert got == Counter([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (2, 2, True), (2, 2, True), (4, 4, True), (4, 4, True), (5, 5, True), (5, 5, True), (5, 5, True), (None, None, True), (None, None, True), (6, 6, True), (7, 5, False)])
    for frame in (docs, docs.repartition(1), docs.orderBy(F.desc("p_high"))):
        stays = [(r["doc_id"], r["text"]) for r in sketch.one_of_each_group(frame, 5, 80).collect()]
        assert Counter(i for i, _ in stays) == {1: 2, 2: 1, 4: 1, 5: 3, None: 2, 6: 1}
        assert {t for i, t in stays if i == 1} == {text("a"), text("b")} and (2, text("c")) in stays


def test_a_crowd_with_a_common_core(spark):
    """Documents of 0.69 similarity share bands without being linked; a few links hide among them."""
    from fissure.llm import sketch

    rng = random.Random(9)
    core = [f"core{i}" for i in range(200)]
    texts = [" ".join(core + [f"w{k}x{i}" for i in range(45)]) for k in range(700)]
    texts += [texts[k] + " z" for k in rng.sample(range(700), 20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [word_sets(t, 5) for t in texts]
    got = {r["doc_id"]: r["component_id"] for r in sketch.near_duplicates(docs, 5, 80).collect()}
    for i in range(700, 720):
        partner = next(k for k in range(700) if texts[i].startswith(texts[k]))
        assert got[i] == got[partner] == partner
    assert sum(i == c for i, c in got.items()) == 700
    assert 0.6 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.7


def query_and_sql(spark, folder, name):
    import duckdb

    from fissure.llm import registry

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.sql(registry.ORACLES[name])
    rows = registry.QUERIES[name](spark, str(folder)).select(want.columns).collect()
    return Counter(map(tuple, rows)), Counter(want.fetchall())


def test_disclosing_terms_by_query_and_sql(spark, tmp_path):
    rng = random.Random(6)
    names = "".join
    word = lambda: names(rng.choices("abcdefgh", k=4))
    rows = []
    for i in range(900):
        words = [word() for _ in range(25)]
        if i % 30 == 0:  # an address, its owner's word, and a word of half of all texts
            words[3:6] = ["mail Anna@Example.org", "Zebrafish", "common"]
        if i % 45 == 7:
            words[7:9] = ["call +49 (30) 1234567 or 10.0.0.1", "Öresund-quokka"]
        if i % 2:
            words.append("common")
        rows.append((i, " ".join(words)))
    rows += [(1000, "the ZEBRAFISH alone, zebrafishes not"), (1001, rows[30][1]), (1002, rows[30][1]), (1003, None), (None, "öresund zebrafish"), (1004, "zebrafish@quokka.org quokka"), (1005, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got, want = query_and_sql(spark, tmp_path, "op4_pii")
    assert got == want
    spans = {r[0]: r for r in got}
    assert sum("term:" in str(r) for r in got) > 50 and "term:4:13" in str(spans[1000]) and "common" not in str(spans)


def test_many_addresses_and_terms_in_few_versions(spark):
    from fissure.llm import pii

    base = " ".join(f"user{i}@example.org term{''.join(chr(97 + int(c)) for c in str(i))}" for i in range(4000))
    rows = [(k, f"{base} version {k}") for k in range(5)] + [(10 + k, f"other words stand here {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}") for k in range(100)]
    began = time.time()
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert time.time() - began < 60 and {r["n_email"] for r in found if r["doc_id"] < 5} == {4000}


@pytest.mark.parametrize(("text", "labels"), [
    ("licensed under Apache 2.0", "apache-2"), ("Apache-2.0", "apache-2"), ("License: MIT", "mit"), ("this is MIT-licensed code", "mit"), ("BSD license", "bsd"), ("CC0", "cc0"), ("published under CC BY 4.0", "cc-by-4.0"),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "apache-2,mit"), ("SPDX-License-Identifier: BSD-3-Clause AND (MIT OR ISC)", "bsd-3,isc,mit"), ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath", "gpl-2"), ("LGPLv2.1", "lgpl-2.1"),
    ("an open rail car", ""), ("they took artistic licence with history", ""), ("an ASL 2 class", ""), ("a Python license plate", ""), ("the EPL 2 goals ahead", ""), ("er kam mit der Lizenz", ""), ("a poetic license", ""), ("a vim license joke", ""),
    ("an elastic band", ""), ("BSL 1.1 is no Boost", ""), ("the curl of a field", ""), ("apache 2 helicopters", ""), ("under the Artistic License", "artistic"),
])
def test_short_forms_and_texts_without_licenses(text, labels):
    from fissure.llm import licenses

    assert licenses.Scanner().scan(text.encode())[5] == labels


def test_gates_are_words_of_every_match():
    from fissure.llm import licenses

    scanner = licenses.Scanner()
    plain = [f"{a} {b}".encode() for a in ("gplv3", "mplver2", "the lgpl 2 1", "openrail m", "licensed under the open rail licence", "mulanpsl 2", "creative commons zero") for b in ("", "or later", "license")]
    for text in plain:
        words = b" ".join(text.lower().translate(scanner.letters).split())
        here = set(words.split())
        gated = {i for gate, some in scanner.gates if gate <= here for i in some}
        assert {i for i, (_, p) in enumerate(scanner.rules) if p.search(words)} <= gated


def test_language_training_equals_plain_counts(spark, monkeypatch):
    """The sample, its calibration rows and the counts of n-grams, from doc_ids, texts and labels alone."""
    import struct

    import xxhash

    from fissure.llm import langid
    from fissure.llm.shared import table

    monkeypatch.setattr(langid, "SAMPLE_ROWS", 25)
    monkeypatch.setattr(langid, "SAMPLE_CHARACTERS", 40_000)
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    by = defaultdict(list)
    for r in docs.select("doc_id", "text", "lang").collect():
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            at = xxhash.xxh64_intdigest(struct.pack("<q", r["doc_id"]), 42)
            by[r["lang"]].append((at - (1 << 64) if at >= 1 << 63 else at, r["doc_id"], r["text"]))
    counts, held = defaultdict(Counter), []
    for lang, rows in by.items():
        rows = [r for r in rows if r[0] % (1 << 30) < min(1.0, 2.0 * 25 / len(rows)) * (1 << 30) and r[2] is not None]
        ahead = 0
        for rank, (_, _, text) in enumerate(sorted(rows), 1):
            if rank > 25 or ahead >= 40_000:
                break
            ahead += len(text)
            if rank % langid.CALIBRATION == 0:
                held.append((text, lang))
                continue
            for run in "".join(c if c.isalpha() else " " for c in text.lower()).split():
                counts[lang].update(f" {run} "[max(0, t - 3) : t + 1] for t in range(1, len(run) + 2))
    want, got = langid.Model(sorted(counts), counts), langid.train(docs)
    want.calibrate([t for t, _ in held], [lang for _, lang in held])
    assert got.languages == want.languages and len(got.languages) == 4 and len(held) > 8
    for a, b in zip(got.grams + got.backoff, want.grams + want.backoff, strict=True):
        assert (a[0] == b[0]).all() and np.allclose(a[1], b[1], rtol=1e-12, atol=1e-12, equal_nan=True)
    assert np.allclose(got.usual, want.usual) and np.allclose(got.spread, want.spread) and np.isclose(got.limit, want.limit)
