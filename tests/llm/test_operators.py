"""The operators against brute force, with nulls, empty texts, ties, repeats, clashing columns and empty tables."""

import hashlib
import itertools
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fissure.llm import decontam, encoding, langid, licenses, packing, pii, registry, shards, sketch, tokens, urls, vectors
from fissure.llm.shared import table
from fissure.llm.words import ALNUM, word_hashes

SF = "/root/testdata/sf0.001"
#: Columns whose names operators use inside.
CLASHING = ["root", "rep", "key", "part", "rank", "before", "size", "n", "a", "b", "cell", "grams", "rule", "pattern", "p_text_key", "registers", "component_id", "kept"]


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward documents: nulls in every column, no words, no letters, repeats, one very long word, one very long text."""
    long = "word" * 30_000
    many = " ".join(f"w{i % 7919}" for i in range(60_000))
    rows = [(1, None, None), (2, "", "en"), (3, "   \n\t ", "en"), (4, "12 34", "en"), (5, "one", None), (5, "one", None), (None, "some words of a text that nobody named", "en"), (None, None, "en"), (6, long, "en"), (7, many, "de"), (8, "é ü ß ñ İ ﬁ", "fr"), (9, "<|endoftext|> a  b\n\n c", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHING}).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return public_tokenizers.path(name), Tokenizer.from_file(public_tokenizers.path(name))


def digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


AWKWARD = ["", " ", "  a", "a  b", "a \n b", "x  y   z ", "Hello, WORLD. it's don't. 12,5 a1. İx ﬁ é é é, ª º. ß", "<|endoftext|> hi <|startoftext|>", "a,b.c ,. ...", "foo\nbar baz\tq", "日本語。 text, ½. ²", "naïve? Ça! ÉTÉ.", "\u00a0 x\u2028 y"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_gives_the_library_s_ids(texts, name):
    path, plain = tokenizer(name)
    some = AWKWARD + list(texts.values())
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(some, add_special_tokens=False)]
    assert encoding.Encoder(path).encode(some) == want
    assert encoding.Encoder(path).encode([None]) == [b""]


def test_token_files_round_trip(spark, texts, tmp_path):
    path, plain = tokenizer("word_bpe_49k.json")
    docs = table(spark, SF, "documents")
    manifest = tokens.write_tokens(docs, path, f"file://{tmp_path}/tokens", sequence=64)
    got = sorted(map(tuple, tokens.read_documents(manifest).collect()))
    start, want, all_ids = 0, [], []
    for doc_id in sorted(texts):
        ids = [*plain.encode(texts[doc_id], add_special_tokens=False).ids, 1]
        want.append((doc_id, start, len(ids), digest(ids)))
        all_ids += ids
        start += len(ids)
    assert got == want
    files = sorted(r["data_path"] for r in manifest.collect())
    first, mask = tokens.read_sequence(files[0], 70)
    assert len(first) == len(mask) == 64 and first.to_pylist() == all_ids[70 * 64 : 71 * 64] and all(mask.to_pylist())


def test_token_files_of_awkward_documents(spark, odd, none):
    path, plain = tokenizer("word_bpe_49k.json")
    got = [tuple(r) for r in tokens.read_documents(tokens.write_tokens(odd, path)).collect()]
    rows = odd.select("doc_id", "text").collect()
    assert Counter((d, n, c) for d, _, n, c in got) == Counter((r["doc_id"], len(i := [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1]), digest(i)) for r in rows)
    assert sorted(s for _, s, _, _ in got) == sorted(np.cumsum([0] + [n for _, _, n, _ in sorted(got, key=lambda x: x[1])])[:-1])
    assert tokens.read_documents(tokens.write_tokens(none, path)).count() == 0
    twice = odd.sparkSession.createDataFrame([(1, t) for t in ("b c", None, "a", "b")], "doc_id long, text string")
    for order in ("text", F.desc("text")):
        found = tokens.read_documents(tokens.write_tokens(twice.orderBy(order), path)).orderBy("start").collect()
        assert [r["ids_crc32"] for r in found] == [digest([*plain.encode(t, add_special_tokens=False).ids, 1]) for t in ("", "a", "b", "b c")]


def check_packing(rows, docs, plain):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc_id, text in docs.items():
        ids, at = [*plain.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), digest(ids[at : at + r["length"]])) and r["length"] > 0
            at += r["length"]
        assert at == len(ids)
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    return sum(r["length"] for r in rows) / (2048 * len(by_sequence))


def test_packing_loses_nothing_and_pads_little(spark, texts):
    path, plain = tokenizer("byte_bpe_50k.json")
    rows = packing.pack_documents(table(spark, SF, "documents").coalesce(1), path).collect()
    assert check_packing(rows, texts, plain) > 0.98


def test_packing_awkward_documents(odd, none):
    path, plain = tokenizer("byte_bpe_50k.json")
    unique = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(packing.pack_documents(unique, path).collect(), {r["doc_id"]: r["text"] for r in unique.collect()}, plain)
    assert packing.pack_documents(odd, path).filter("start = 0").count() == odd.count()
    assert packing.pack_documents(none, path).count() == 0


def test_harmonic_classes_hold_a_fixed_count():
    packer = packing.HarmonicPacker(100)
    for i in range(12):
        packer.add(i, 30)
    assert len(packer.gaps) == 4 and all(len(s) == 3 for s in packer.gaps)
    packer.add(12, 250)
    sequences = packer.finish()
    filled = sorted(sum(n for _, _, n in s) for s in sequences)
    assert sum(filled) == 12 * 30 + 250 and filled == [10] + [100] * 6


def test_language_models_on_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got) and not any(r["rejected"] for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def plain_cross_entropy(counts, alphabet, text):
    """Interpolated Kneser-Ney from dictionaries of n-grams, character by character."""
    orders = [Counter() for _ in range(langid.ORDER)]
    for g, n in counts.items():
        orders[len(g) - 1][g] += n
    for k in range(langid.ORDER - 1, 0, -1):
        for g, n in Counter(g[1:] for g in orders[k]).items():
            if g not in counts:
                orders[k - 1][g] = n

    def probability(context, c):
        k = len(context)
        lower = probability(context[1:], c) if k else 1 / (alphabet + 1)
        followers = {g: n for g, n in orders[k].items() if g[:-1] == context}
        total = sum(followers.values())
        if not total:
            return lower
        seen = followers.get(context + c, 0)
        return max(seen - langid.DISCOUNT, 0) / total + langid.DISCOUNT * len(followers) / total * lower

    bits = [np.log(probability(run[max(0, t - langid.ORDER + 1) : t], run[t])) for word in re.findall(r"[^\W\d_]+", text.lower()) for run in [f" {word} "] for t in range(1, len(run))]
    return -np.mean(bits)


def small_models():
    texts = {"x": "abba cab baba abc aab", "y": "dada bad add dab daba"}
    counts = {lang: Counter(f" {w} "[max(0, t + 1 - langid.ORDER) : t + 1] for w in text.split() for t in range(1, len(w) + 2)) for lang, text in texts.items()}
    return langid.Model(["x", "y"], counts), counts


def test_cross_entropy_equals_dictionaries():
    model, counts = small_models()
    alphabet = len({g[-1] for c in counts.values() for g in c})
    some = ["abba dada", "cab", "Zebra, bad! abc 12 dd", "a"]
    entropy, _ = model.score(some)
    for text, row in zip(some, entropy, strict=True):
        assert np.allclose(row, [plain_cross_entropy(counts[lang], alphabet, text) for lang in ("x", "y")], atol=1e-5)
    names, *_ = model.predict(some)
    assert names == ["xy"[int(np.argmin([plain_cross_entropy(counts[lang], alphabet, t) for lang in ("x", "y")]))] for t in some]


def test_equal_texts_get_equal_results(texts):
    model, _ = small_models()
    some = list(texts.values())[:40]
    together, _ = model.score(some)
    assert all((model.score([t])[0][0] == row).all() for t, row in zip(some, together, strict=True))


def test_kneser_ney_sums_to_one():
    model = langid.Model(["x"], {"x": Counter({" a": 3, " ab": 2, " aba": 1, "aba ": 1, " ab ": 1, " a ": 1, " b": 1, " b ": 1})})
    letters = ["a", "b", " "]
    for context in ("", " ", "a", " a", "ba"):
        total = 0.0
        for c in letters:
            for k in range(min(len(context) + 1, langid.ORDER), 0, -1):
                hit, row = model._find(model.grams[k - 1], langid.gram_hashes([context[len(context) - k + 1 :] + c]))
                if hit[0]:
                    weight = 0.0
                    for longer in range(k + 1, len(context) + 2):
                        known, w = model._find(model.backoff[longer - 1], langid.gram_hashes([context[len(context) - longer + 1 :]]))
                        weight += float(w[0][0]) if known[0] else 0.0
                    total += float(np.exp(row[0][0] + weight))
                    break
        assert 1 - np.exp(model.floor[0]) - 1e-9 <= total <= 1 + 1e-9  # the rest is for letters never seen


def test_languages_of_awkward_documents(spark, odd, none):
    model = langid.train(table(spark, SF, "documents"))
    got = langid.identify(odd, model).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"] for i in (1, 2, 3, 4))
    assert by[8]["lang_pred"] in {"en", "de", "fr", "es"}
    junk = spark.createDataFrame([(1, " ".join("xqzjvkw"[i % 7 :: -1] * 3 for i in range(200)), "en")], "doc_id long, text string, lang string")
    assert langid.identify(junk, model).first()["rejected"] and langid.accepted(junk, model).count() == 0
    assert langid.identify(none, model).count() == 0 and langid.train(none) is None
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.accepted(odd, model).columns == odd.columns


def test_urls_by_rule_and_model(spark):
    cases = [
        (1, "https://A.Example.ORG/en/9", "a.example.org", "/en/9", "org/"), (2, "http://example.org/es/1?q#f", "example.org", "/es/1", "example.org/es/"), (3, "http://m.example.org/en/12", "m.example.org", "/en/12", "example.org/en/1"),
        (4, "ftp://x.com/fr/", "x.com", "/fr/", "com/fr/"), (5, "http://x.com/de/1", "x.com", "/de/1", "com/de/"), (6, "http://notexample.net/de/1", "notexample.net", "/de/1", None), (7, None, "", "", None), (8, "no scheme", "", "", None),
        (9, "http://org", "org", "", None), (10, "http://org/", "org", "/", "org/"), (11, "http://a.xorg/", "a.xorg", "/", None), (12, "x://y://z/p", "y:", "//z/p", None), (None, "http://b.net?x/y", "b.net", "", None),
    ]
    pages = spark.createDataFrame([(c[0], c[1], "clash", "clash") for c in cases], "page_id long, url string, host string, rule string")
    model = urls.fit(urls.labelled_urls(urls.parse_urls(table(spark, SF, "pages"), urls.RULES), urls.RULES))
    got = {r["page_id"]: r for r in urls.judge_urls(pages, urls.RULES, model).collect()}
    verdicts = {r.name: r.verdict for r in urls.RULES}
    for page_id, _, host, path, rule in cases:
        r = got[page_id]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdicts[rule] if rule else r["verdict"] in {"allow", "block"}
    assert urls.judge_urls(pages.limit(0), urls.RULES, model).count() == 0
    assert urls.fit(urls.labelled_urls(urls.parse_urls(pages.limit(0), urls.RULES), urls.RULES)) == "allow"


def test_urls_of_all_pages_equal_plain_parsing(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    pages = table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "url")
    got = {r["page_id"]: r for r in registry.QUERIES["op3_url_filter"](spark, "/root/testdata/sf0.01").collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for page_id, url in rows:
        rest = (url or "").partition("://")[2]
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = got[page_id]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert r["verdict"] == max(fits)[2] if fits else r["verdict"] in ("allow", "block")


def test_url_model_learns_the_labelled_table(spark):
    parsed = urls.parse_urls(table(spark, "/root/testdata/sf0.1", "pages"), urls.RULES)
    labelled = urls.labelled_urls(parsed, urls.RULES)
    train, held = (labelled.filter(F.pmod(F.xxhash64("host", "path"), F.lit(4)) == i if i == 0 else F.pmod(F.xxhash64("host", "path"), F.lit(4)) != 0) for i in (1, 0))
    scored = urls.fit(train).transform(urls._with_grams(held))
    assert scored.filter("prediction = label").count() / scored.count() > 0.85


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def plain_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def test_personal_data_equals_plain_matching(spark, odd, none, texts):
    awkward = ["a@b.c_d@e.f.g", "x@y", "..@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256", "0001.02.3.4", "4111 1111-1111 1111", "41111111111111112", "+1 (2) 3-4.5 678 x +12", "é🙂 a@b.co 🙂 +49 170 1234567", "a" * 5000 + "@", "1 " * 9000 + "@", "1-" * 3, "@@a.b@c.d", "a.b@c-.d- 9.9.9.9@x.y"]
    rows = list(texts.items()) + [(10**6 + i, t) for i, t in enumerate(awkward)]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, text in rows:
        want = plain_spans(text)
        assert got[doc_id]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), text[:80]
        assert [got[doc_id][f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k) for s in want) for k in PATTERNS]
    assert pii.find_personal_data(odd).count() == odd.count()
    assert pii.find_personal_data(none).count() == 0 and pii.sanitise(none).count() == 0
    same = pii.sanitise(odd)
    assert same.columns == odd.columns and sorted(map(repr, same.collect())) == sorted(map(repr, odd.collect()))


def test_many_matches_of_one_text_take_linear_time(spark):
    def scanned(n):
        text = " ".join(f"user{i}@host{i % 7}.example é" for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        assert [(m["start"], m["end"]) for m in pii.scan(docs).first()["email"]] == [m.span() for m in re.finditer(PATTERNS["email"], text)]
        assert pii.sanitise(docs).first()["text"] == re.sub(PATTERNS["email"], "<EMAIL>", text)
        return time.perf_counter() - began

    scanned(10)
    scanned(16_000)
    assert scanned(64_000) < 60


def test_terms_that_disclose_an_entity(spark):
    rows = [(i, f"{w} the person Zorblax wrote from boss@corp.example about {w} today") for i, w in enumerate(["apples", "rivers", "clouds", "stones"])]
    rows += [(100 + i, f"the person number{chr(97 + i)} wrote about today from apples rivers clouds stones") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    spans = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs).collect()}
    text = rows[0][1]
    at = text.index("Zorblax")
    assert f"term:{at}:{at + 7}" in spans[0] and spans[100] == "" and "term" in spans[3]
    clean = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    assert clean[0]["text"] == "apples the person <TERM> wrote from <EMAIL> about apples today" and clean[0]["n_chars"] == len(clean[0]["text"])
    assert clean[100]["text"] == rows[4][1]


def test_terms_far_from_an_entity_and_short_ones_disclose_it(spark):
    """One context around the entity, and the term outside 80 characters of it."""
    far = "water and stone and wood and sand " * 6
    words = ["apples", "rivers", "clouds", "stones", "meadow"]
    rows = [(i, f"{w} Zoe {far}write to boss@corp.example {far}") for i, w in enumerate(words)]
    rows += [(10 + i, rows[0][1]) for i in range(9)]
    rows += [(100 + i, f"{w} {far}write to one another {far} {chr(97 + i // 26)}{chr(97 + i % 26)}x") for i, w in enumerate(words * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"].split(",") for r in pii.find_personal_data(docs).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    for i, w in enumerate(words):
        assert [s for s in spans[i] if s.startswith("term")] == [f"term:{len(w) + 1}:{len(w) + 4}"]
        assert clean[i].startswith(f"{w} <TERM> water")
    assert all(clean[i] == t for i, t in rows if i >= 100)
    once = spark.createDataFrame(rows[:1] + rows[5:], "doc_id long, text string")
    assert not any("term" in r["spans"] for r in pii.find_personal_data(once).collect())  # copies of a text count once


def test_terms_are_marked_without_a_mention(spark):
    rows = [(i, f"{w} Zorblax wrote from boss@corp.example today") for i, w in enumerate(["apples", "rivers", "clouds", "stones", "meadow"])]
    rows += [(50, "Nobody else than zorblax could do it")] + [(100 + i, f"somebody wrote today about number{chr(97 + i)}") for i in range(26)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs).collect()}
    assert spans[50] == "term:17:24" and spans[100] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[50] == "Nobody else than <TERM> could do it" and clean[100] == rows[6][1]


def exact_components(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def exact_near_duplicates(texts, n, percent):
    sets = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(words[j : j + n]) for j in range(max(len(words) - n + 1, 1))} if words else set()
    holders, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for ids in holders.values():
        common.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    return {i: len(s) for i, s in sets.items()}, exact_components(links, sets)


def test_near_duplicates_equal_exact_search(spark, texts):
    rng = np.random.default_rng(5)
    base = [f"x{i}" for i in range(120)]
    rows = dict(texts)
    for i in range(60):  # near copies of one text, many not linked with each other
        words = list(base)
        for j in rng.choice(len(words), rng.integers(0, 8), replace=False):
            words[j] = f"y{i}-{j}"
        rows[10_000 + i] = " ".join(words)
    rows |= {20_000: "", 20_001: None, 20_002: "A b", 20_003: "a  B", 20_004: "a b c"}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for n in (4, 5):
        sizes, want = exact_near_duplicates(rows, n, 80)
        got = {r["doc_id"]: r for r in sketch.near_duplicates(docs, n, 80).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert {i: r["n_shingles"] for i, r in got.items()} == sizes
        assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_of_awkward_documents(odd, none):
    got = sketch.near_duplicates(odd).collect()
    assert len(got) == odd.count() and all(r["kept"] for r in got if r["doc_id"] is None)
    assert sketch.near_duplicates(none).count() == 0
    one = sketch.one_of_each_group(odd)
    assert one.columns == odd.columns and one.filter("doc_id = 5").count() == 1 and one.filter("doc_id is null").count() == 2


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, 900).astype(np.uint64) for _ in range(2))
    b[:600] = a[:600]
    a, b = np.unique(a), np.unique(b)
    ra, rb = sketch.registers(a), sketch.registers(b)
    assert (sketch.merge(ra, rb) == sketch.registers(np.union1d(a, b))).all()
    keep, estimate = sketch.likely(ra[None], rb[None], np.array([float(len(a))]), np.array([float(len(b))]), 0.8)
    assert abs(estimate[0] - 0.5) < 0.12 and not keep[0]
    assert sketch.likely(ra[None], ra[None], np.array([900.0]), np.array([900.0]), 0.8)[0][0]


def exact_vectors(rows, threshold=0.9):
    usable = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            scaled = np.array(v, float) / max(map(abs, v))
            usable[k] = scaled / np.linalg.norm(scaled)
    counts, links = Counter(), []
    keys = list(usable)
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            if len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] >= threshold:
                counts[a] += 1
                counts[b] += 1
                links.append((rows[a][0], rows[b][0]))
    return counts, exact_components(links, {i for i, _ in rows if i is not None})


def test_vectors_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(40):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), [float(x) for x in centre + rng.normal(size=16) * 0.25]))
    rows += [(len(rows) + i, rows[3][1]) for i in range(30)]  # equal vectors
    top = len(rows)
    rows += [(top, None), (top + 1, []), (top + 2, [0.0] * 16), (top + 3, [None] + [1.0] * 15), (top + 4, [float("nan")] + [1.0] * 15), (top + 5, [float("inf")] * 16), (top + 6, [1.0, 2.0]), (top + 7, [2.0, 4.0]), (None, rows[0][1]), (top + 8, [1e200] * 16), (top + 9, [1e-200] * 16)]
    monkeypatch.setattr(vectors, "CELL", 16)
    monkeypatch.setattr(vectors, "BLOCK", 8)
    monkeypatch.setattr(vectors, "SLICE", 3)
    frame = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<double>, rep int, cell int")
    counts, components = exact_vectors(rows)
    got = {r["vec_id"]: r for r in vectors.near_vectors(frame).collect()}
    assert {i: r["n_links"] for i, r in got.items() if i is not None} == {i: counts[k] for k, (i, _) in enumerate(rows) if i is not None}
    assert {i: r["component_id"] for i, r in got.items() if i is not None} == components
    assert got[None]["kept"] and got[None]["component_id"] is None and got[None]["n_links"] == 0
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_visits_never_miss_a_link():
    rng = np.random.default_rng(3)
    u = rng.normal(size=(400, 8))
    v = u + rng.normal(size=u.shape) * 0.3
    x = np.vstack([u, v])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own, at = vectors.visits(x, vectors.spherical_k_means(x, 20), 0.9)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    assert len(a) > 50 and (at[a, own[b]] | at[b, own[a]]).all()


def test_license_phrases_equal_plain_search(odd, none, texts, spark):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    rows = list(texts.items()) + [(10**6, "Under the MIT\nlicense; under-the-mit_license. CC-BY-NC cc by nc"), (10**6 + 1, "xcc by nc, ccé by nc"), (10**6 + 2, "Apache License, Version 2.0 (SPDX-License-Identifier: GPL-3.0-only)")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        at = [(j, label) for p, label in phrases.items() for j in range(len(words)) if words[j : j + len(p.split())] == p.split()]
        places = [j for j, _ in at]
        r = got[doc_id]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))
        assert {x for _, x in at} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[10**6 + 2]["labels"] == "apache-2,gpl-3"
    assert licenses.scan_licenses(odd).count() == odd.count() and licenses.scan_licenses(none).count() == 0
    assert len(licenses.rules()) > 200


def spelt(parsed, nth, full):
    """A text that a parsed pattern matches: the nth branch of each choice, optional parts in or out."""
    out = ""
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(arg)
        elif kind == "NOT_LITERAL":
            out += "x"
        elif kind == "IN":
            out += chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])
        elif kind == "BRANCH":
            out += spelt(arg[1][nth % len(arg[1])], nth, full)
        elif kind == "MAX_REPEAT":
            out += spelt(arg[2], nth, full) * min(arg[full], 2)
        elif kind == "SUBPATTERN":
            out += spelt(arg[3], nth, full)
        else:
            raise ValueError(kind)
    return out


def test_every_rule_gives_its_label():
    scanner, lost = licenses.Scanner(), set()
    for rule in licenses.rules():
        parsed = re._parser.parse(rule.pattern)
        for text in {spelt(parsed, nth, full) for nth in range(6) for full in (False, True)}:
            for gap in (" ", "\n", " -\r\n"):
                wrapped = f"Ab {text}".upper().replace(" ", gap).encode()
                if rule.label not in scanner.scan(wrapped)[5].split(","):
                    lost.add((rule.label, wrapped))
    assert not lost
    for text, label in {"covered by MPL 2.0": "mpl-2", "BSD 3-Clause": "bsd-3", "CC0 1.0 Universal": "cc0", "EPL-2.0": "epl-2", "EUPL v1.2": "eupl-1.2", "CeCILL 2.1": "cecill-2.1", "GFDL 1.3": "gfdl-1.3", "ODbL 1.0": "odbl-1", "LPPL version 1.3": "lppl-1.3", "Unless required by applicable law or agreed to in writing, software": "apache", "SPDX-License-Identifier: OFL-1.1": "ofl-1.1", "SPDX-License-Identifier: MS-PL": "ms-pl", "released into the public\ndomain": "public-domain", "All rights\nreserved": "all-rights-reserved"}.items():
        assert label in scanner.scan(text.encode())[5].split(","), text


def test_rules_inside_others_are_suppressed():
    scan = licenses.Scanner().scan(b"Licensed under the GNU Lesser General Public License version 2.1 or later")
    assert scan[5] == "lgpl-2.1" and scan[6] == 1.0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("GPL 2, 3", "gpl-2"), ("GPLv3", "gpl-3"), ("LGPLv2.1+", "lgpl-2.1"), ("MIT License", "mit"), ("EPL 2.0", "epl-2"), ("AGPL-3.0-or-later", "agpl-3"), ("the GPL or the EPL", ""), ("MPL 7", ""), ("a license to thrill", ""), ("LPPL version 1.3c", "lppl-1.3c"),
        ("This file is released under the Apache License, Version 2.0 or the MIT license.", "apache-2,mit"), ("BSD 3-Clause or CC BY-SA 4.0", "bsd-3,cc-by-sa-4.0"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl,gpl-3"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
        ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd"),
    ],
)
def test_labels_of_license_texts(text, labels):
    assert licenses.Scanner().scan(text.encode())[5] == labels


def test_versions_are_those_that_exist():
    names = {r.label for r in licenses.rules()}
    assert {"gpl-2", "lgpl-2.1", "cecill-2.1", "unicode-3"} <= names and not {"gpl-1.2", "gpl-2.3", "lgpl-1.3", "agpl-1.3", "epl-1.2", "cddl-1.2", "mpl-1.2", "unicode-1.3"} & names


def test_kept_intervals_hold_what_a_plain_search_finds():
    scanner, rng = licenses.Scanner(), np.random.default_rng(8)
    parts = ["gpl 2", "lgpl 2 1 or later", "licensed under the mit license", "gnu general public license version 3", "mit license", "x", "terms of the gpl", "bsd license", "under the bsd license"]
    for _ in range(60):
        words = " ".join(rng.choice(parts, 12)).encode()
        kept = []
        for rule, pattern in scanner.rules:
            for m in pattern.finditer(words):
                if not any(a <= m.start() and m.end() <= b for a, b, _ in kept):
                    kept.append((*m.span(), rule.label))
        assert [label for label, _ in scanner._detect(words)] == [label for *_, label in kept]


def test_copies_of_benchmark_items(spark, odd, none):
    benchmark = table(spark, SF, "benchmark")
    items = benchmark.orderBy("item_id").limit(12).collect()
    rng = np.random.default_rng(4)
    filler = [f"filler{i}" for i in range(300)]
    rows, want = [], set()
    for k, item in enumerate(items):
        words = item["text"].split()
        edited = [w for i, w in enumerate(words) if i % 9 != 8]  # every ninth word lost
        upper = [w.upper() + "," for w in words]
        for kind, passage in enumerate((words, edited, upper)):
            at = int(rng.integers(0, 300))
            rows.append((100 * k + kind, " ".join(filler[:at] + passage + filler[at:])))
            want.add((100 * k + kind, item["item_id"]))
    rows += [(5000 + i, " ".join(rng.permutation(" ".join(x["text"] for x in items).split()))) for i in range(5)]
    got = decontam.find_copies(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(decontam.SCORE <= r["score"] <= 1 for r in got)
    assert decontam.find_copies(odd, benchmark).count() == 0
    assert decontam.find_copies(none, benchmark).count() == 0 and decontam.find_copies(odd, benchmark.limit(0)).count() == 0
    strange = spark.createDataFrame([(None, "some words of a text that nobody named"), (1, None), (2, ""), (3, "three short words"), (4, "some words of a text that nobody named"), (4, "some words of a text that nobody named")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["score"]) for r in decontam.find_copies(odd, strange).collect()] == [(None, 4, 1.0)]
    assert decontam.without_copies(odd, strange).count() == odd.count()


def test_copies_equal_alignment_of_all_documents_with_all_items(spark):
    """Edited copies against brute force: every pair of a document and an item is aligned in full."""
    items = table(spark, SF, "benchmark").orderBy("item_id").limit(10).collect()
    rng = np.random.default_rng(9)

    def edited(words, kind, every):
        at = int(rng.integers(0, every))
        if kind == "replace":
            return [f"z{i}" if i % every == at else w for i, w in enumerate(words)]
        if kind == "drop":
            return [w for i, w in enumerate(words) if i % every != at]
        if kind == "insert":
            return [x for i, w in enumerate(words) for x in ([w, f"z{i}"] if i % every == at else [w])]
        cut = len(words) // every
        return words[cut:] + words[:cut]

    rows = []
    for item in items:
        for kind, every in itertools.product(("replace", "drop", "insert", "rotate"), (3, 4, 5, 7, 10)):
            filler = [f"filler{i}" for i in rng.integers(0, 400, 80)]
            rows.append((len(rows), " ".join(filler[:40] + edited(item["text"].split(), kind, every) + filler[40:])))
    hashed = lambda text: word_hashes(text.encode(), ALNUM)
    least = {r["item_id"]: decontam.SCORE * decontam.MATCH * len(hashed(r["text"])) for r in items}
    want = {(d, r["item_id"]) for d, text in rows for r in items if decontam.align(hashed(r["text"]), hashed(text))[0] >= least[r["item_id"]]}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_copies(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items)).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 100


def test_short_items_are_found_whole(spark):
    items = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "some Alpha, beta here"), (2, "alpha then beta"), (3, "gamma ray"), (4, "gammas")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find_copies(docs, items).collect()} == {(1, 1), (3, 2)}


def test_column_names_with_points(spark):
    docs = spark.createDataFrame([(1, "some words of one text", "x"), (1, "some words of one text", "y"), (2, "others stand here", "z")], "doc_id long, text string, `a.b` string")
    items = spark.createDataFrame([(1, "others stand here")], "item_id long, text string")
    assert sketch.one_of_each_group(docs).columns == docs.columns and sketch.one_of_each_group(docs).count() == 2
    assert [r["a.b"] for r in decontam.without_copies(docs.filter("doc_id = 2 or `a.b` = 'x'"), items).collect()] == ["x"]
    assert pii.sanitise(docs).columns == docs.columns


def test_benchmark_in_blocks_gives_the_same(spark, monkeypatch):
    docs, benchmark = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    whole = {(r["doc_id"], r["item_id"]) for r in decontam.find_copies(docs, benchmark).collect()}
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 4000)
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find_copies(docs, benchmark).collect()} == whole


def plain_alignment(a, b):
    best, table_ = 0, np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            table_[i + 1, j + 1] = max(0, table_[i, j] + (2 if a[i] == b[j] else -1), table_[i, j + 1] - 1, table_[i + 1, j] - 1)
            best = max(best, table_[i + 1, j + 1])
    return best


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(6)
    for _ in range(60):
        a, b = (rng.integers(0, 5, rng.integers(1, 25)).astype(np.uint64) for _ in range(2))
        assert decontam.align(a, b)[0] == plain_alignment(a, b)


def test_shards_are_contiguous_and_near_equal(spark, odd, none, texts):
    got = shards.shard_by_bytes(table(spark, SF, "documents"), 16).orderBy("doc_id").collect()
    sizes = {i: len(t.encode()) + 1 for i, t in texts.items()}
    assert [(r["doc_id"], r["size"], r["text_crc32"]) for r in got] == [(i, sizes[i], zlib.crc32(texts[i].encode())) for i in sorted(sizes)]
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)
    total = sum(sizes.values())
    for s in range(16):
        mine = [r for r in got if r["shard"] == s]
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / 16) <= max(sizes.values())
    rows = shards.shard_by_bytes(odd, 3).collect()
    assert len(rows) == odd.count() and all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows))) for s in range(3))
    assert shards.shard_by_bytes(none, 3).count() == 0


def test_registered_queries(spark):
    assert [q.split("_")[0] for q in registry.QUERIES] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda d: sorted(repr([None if x is None or x != x else x for x in r]) for r in d[columns].astype(object).where(d[columns].notna(), None).values.tolist())
    assert plain(got) == plain(want)
