"""Personal data: spans by pattern, and terms that disclose them by corpus co-occurrence.

Column expressions, joins and aggregates only; no Python runs on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fissure.llm.shared import materialise, same_columns, table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive forms and the start conditions match the same places as the plain
#: forms [A-Za-z0-9._%+-]+@..., [0-9]+(\.[0-9]+)... and so on, but never scan a long run twice.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match anywhere in it.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IP = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
#: The share of an entity's information that a disclosing term gives away, and how many terms may seem to by chance for an entity.
DISCLOSURE, CHANCE = 0.8, 0.05
#: Rows and bytes of their strings that are broadcast at once; more are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
SPANS = "array<struct<start:int,end:int>>"
#: Elements of an array that are run through at once, and characters of a block that gaps between spans are cut from.
RUN, PIECE = 256, 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for each row, however often body names it within the functions of arrays."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each element of an integer array, what add makes of all up to it; add has 0 as its neutral element.

    Blocks of RUN elements are run through by themselves and then carry on from the blocks ahead, so that an
    array that grows step by step, which is copied at each, stays short.
    """

    def run(some: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))

        def step(state: Column, x: Column) -> Column:
            return let(add(state["at"], x), lambda at: F.struct(at.alias("at"), F.concat(state["out"], F.array(at)).alias("out")))

        return F.aggregate(some, begin, step, lambda state: state["out"])

    def in_blocks(x: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(RUN))
        return let(F.transform(starts, lambda at: run(F.slice(x, at, F.lit(RUN)))), lambda blocks: let(run(F.transform(blocks, lambda one: F.coalesce(F.try_element_at(one, F.lit(-1)), F.lit(0)))), lambda totals: joined(blocks, totals)))

    def joined(blocks: Column, totals: Column) -> Column:
        ahead = F.concat(F.array(F.lit(0)), totals)
        return F.flatten(F.transform(blocks, lambda one, i: let(ahead[i], lambda before: F.transform(one, lambda x: add(before, x)))))

    return let(values, in_blocks)


def matches(text: Column, pattern: Column) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, value), in code points, end exclusive."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))

    def placed(values: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(values)), values, lambda gap, value: F.length(gap) + F.length(value))
        return F.zip_with(running(steps, lambda a, b: a + b), values, lambda end, value: F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value")))

    return let(found, placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether every second digit from the right, doubled and summed by digits, and the others sum to a multiple of ten."""
    backwards = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(backwards.substr(i + 1, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_IP)
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of one kind in a text; a null text has none."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    found = F.filter(matches(text, F.lit(PATTERNS[kind])), lambda m: _valid(kind, m["value"]))
    return F.when(text.rlike(HINTS[kind]), found).otherwise(none)


def _entity(kind: str, value: Column) -> Column:
    """What a span protects: one address or number, however it is spelt."""
    plain = F.lower(value) if kind in ("email", "ip") else _digits(value)
    return F.concat(F.lit(kind + ":"), plain)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)))


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def _mentions(kind: str) -> Column:
    """An array of a kind's spans with the entities they name."""
    return F.transform(kind, lambda m: F.struct(m["start"], m["end"], _entity(kind, m["value"]).alias("entity")))


def _replaced(text: Column, spans: Column, put: Callable[[Column], Column]) -> Column:
    """text with what put makes of it in place of each span; overlapping spans are replaced as one.

    What lies between spans is cut from the blocks of PIECE characters that hold it, never from the start of the text.
    """

    def from_blocks(b: Column) -> Column:
        blocks, some = b["blocks"], b["spans"]

        def cut(start: Column, end: Column) -> Column:
            first = F.floor(start / PIECE).cast("int")
            held = F.slice(blocks, first + 1, F.floor(end / PIECE).cast("int") - first + 1)
            return F.substring(F.array_join(held, ""), start - first * PIECE + 1, end - start)

        def pieces(upto: Column) -> Column:
            behind = F.zip_with(some, F.concat(F.array(F.lit(0)), F.slice(upto, 1, F.size(upto) - 1)), lambda s, at: F.struct(s.alias("span"), at.alias("at")))
            apart = F.filter(behind, lambda x: x["span"]["start"] >= x["at"])
            changed = F.transform(apart, lambda x: F.concat(cut(x["at"], x["span"]["start"]), put(x["span"])))
            return F.concat(F.array_join(changed, ""), cut(upto[F.size(upto) - 1], F.length(text)))

        return let(running(F.transform(some, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), pieces)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, let(F.struct(blocks.alias("blocks"), F.array_sort(spans).alias("spans")), from_blocks)).otherwise(text)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, a key of the text, each kind's spans, the entities they name and the terms outside them; one pass over the texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *[base_spans(F.col("text"), k).alias(k) for k in KINDS])
    found = F.concat(*[_mentions(k) for k in KINDS])
    outside = _replaced(F.col("text"), F.col("found"), lambda s: F.lit(" "))
    spans = [F.transform(k, lambda m: F.struct(m["start"], m["end"])).cast(SPANS).alias(k) for k in KINDS]
    rows = rows.withColumn("found", found).select("doc_id", F.monotonically_increasing_id().alias("row"), _key(F.col("text")).alias("key"), *spans, F.array_distinct("found.entity").alias("entities"), _terms(outside).alias("terms"))
    return materialise(rows, "spans")


def _few(rows: DataFrame, *strings: str) -> bool:
    """Whether rows are few and short enough to broadcast."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in strings), F.lit(0).cast("long"))
    n, held = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= BROADCAST_ROWS and held <= BROADCAST_BYTES


def _small(rows: DataFrame, *strings: str) -> DataFrame:
    return F.broadcast(rows) if _few(rows, *strings) else rows


def disclosing_terms(found: DataFrame, disclosure: float = DISCLOSURE, chance: float = CHANCE) -> DataFrame:
    """(entity, term, share): terms that give away at least the given share of an entity's information.

    Of N distinct texts, n_e mention entity e, n_t hold term t outside the spans and n_et do both:
    share = PMI(e, t) / IC(e) = log(N n_et / (n_e n_t)) / log(N / n_e). If t fell on texts at random, it would be in
    so many of the n_e with a probability of at most exp(-n_e KL(n_et / n_e, n_t / N)) (Chernoff); less than the
    given number of the corpus's terms may be expected to do so.

    Entities of the same texts are one class, as all of these numbers are the same for them, and terms that stand in more than
    N^(1 - disclosure) n_e^disclosure texts can't disclose: both keep what is paired within a text small.
    """
    repeated = found.groupBy("key").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "first")
    repeated = materialise(repeated, "repeated")
    once = found.select("key", "row", "entities", "terms").join(_small(repeated), "key", "left").filter("first is null or row = first")
    used = once.select(F.explode("terms").alias("term"))
    n_e, n_et = F.col("n_e"), F.col("n_et")

    # The class of an entity: how many texts mention it, and sums of two hashes of which they are.
    seen = once.select(F.explode("entities").alias("entity"), "row")
    marks = [F.sum(F.xxhash64(F.lit(i), "row").cast("decimal(38,0)")).alias(f"mark{i}") for i in (1, 2)]
    entities = materialise(seen.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), *marks), "entities")
    same = ["n_e", "mark1", "mark2"]
    classes = entities.groupBy(*same).agg(F.min("entity").alias("class"))

    total = once.count()
    least = math.log(max(used.distinct().count(), 1) / chance)

    def share(n_t: Column) -> Column:
        return F.log(total * n_et / (n_e * n_t)) / F.log(total / n_e)

    def evidence(n_t: Column) -> Column:
        a, b = n_et / n_e, n_t / F.lit(total)
        return n_et * (F.log(a) - F.log(b)) + F.when(n_et < n_e, (n_e - n_et) * (F.log(1 - a) - F.log(1 - b))).otherwise(0.0)

    # n_t >= n_et, and evidence is most where both equal n_e: an entity that fails there has no term.
    classes = materialise(classes.filter((n_e < total) & (n_e * F.log(total / n_e) >= least)), "classes")
    rarest = F.lit(float(total)) ** (1 - disclosure) * n_e**disclosure * (1 + 1e-9)
    hosts = once.select("row", F.explode("entities").alias("class")).join(_small(classes, "class"), "class").select("row", "class", "n_e")
    hosts = materialise(hosts, "hosts")
    there = hosts.groupBy("row").agg(F.max("n_e").alias("n_e")).join(once.select("row", "terms"), "row").select("row", "n_e", F.explode("terms").alias("term"))
    widest = there.groupBy("term").agg(F.max("n_e").alias("n_e"))
    counted = used.join(_small(widest.select("term"), "term"), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    terms = materialise(counted.join(widest, "term").filter(F.col("n_t") <= rarest).select("term", "n_t"), "terms")
    held = materialise(there.select("row", "term").join(_small(terms, "term"), "term"), "held")
    pairs = hosts.join(held, "row").filter(F.col("n_t") <= rarest)
    pairs = pairs.groupBy("class", "n_e", "term", "n_t").agg(F.count(F.lit(1)).alias("n_et"))
    n_t = F.col("n_t")
    found_pairs = pairs.withColumn("share", share(n_t)).filter((F.col("share") >= disclosure) & (evidence(n_t) >= least))
    disclosing = materialise(found_pairs.select("class", "term", "share"), "disclosing")
    members = entities.join(classes, same).select("class", "entity")
    return disclosing.join(members, "class").select("entity", "term", "share")


def term_patterns(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, key, pattern): one pattern of all terms in the document that disclose an entity, mentioned there or not."""
    terms = materialise(terms.select("term").distinct(), "terms")
    held = found.select("doc_id", "key", F.explode("terms").alias("term"))
    here = held.join(_small(terms, "term"), "term").groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    return here.select("doc_id", "key", F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})")).alias("pattern"))


def _with_patterns(docs: DataFrame, patterns: DataFrame, how: str) -> DataFrame:
    """docs, each with the pattern of its terms; patterns are broadcast where they are few."""
    few = _few(patterns, "pattern")
    p = patterns.select(F.col("doc_id").alias("p_doc_id"), F.col("key").alias("p_key"), F.col("pattern").alias("p_pattern"))
    keyed = docs.withColumn("p_text_key", _key(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    same = keyed["doc_id"].cast("long").eqNullSafe(p["p_doc_id"]) & (keyed["p_text_key"] == p["p_key"])
    return keyed.join(F.broadcast(p) if few else p, same, how)


def _labelled(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def _analyse(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = scan(docs)
    terms = disclosing_terms(found)
    return found, materialise(term_patterns(found, terms), "patterns")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 of the base spans, and all spans with those of disclosing terms.

    A null text is empty; null doc_ids and repeated rows each give a row; an empty
    table gives none; columns besides doc_id and text are ignored. Spans of different kinds may
    overlap. A term's spans are marked in every document that holds it outside base spans.
    """
    found, patterns = _analyse(docs)
    marked = _with_patterns(docs.select("doc_id", "text"), patterns, "inner")
    at = F.transform(matches(F.col("text"), F.col("p_pattern")), lambda m: F.struct(m["start"], m["end"])).cast(SPANS)
    extra = marked.select(F.col("p_doc_id"), F.col("p_key"), at.alias("term")).dropDuplicates(["p_doc_id", "p_key"])
    rows = found.join(extra, found["doc_id"].eqNullSafe(extra["p_doc_id"]) & (found["key"] == extra["p_key"]), "left")
    base = F.concat(*[_labelled(k, F.col(k)) for k in KINDS])
    more = F.coalesce(_labelled("term", F.col("term")), F.expr("cast(array() as array<string>)"))
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, more), ",").alias("spans"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with personal data and disclosing terms generalised to their kind, and n_chars to match where present.

    Null texts stay null, texts without findings stay as they are, and no row is dropped.
    """
    _, patterns = _analyse(docs)
    whole = docs.select("doc_id", "text", F.struct(*same_columns(docs)).alias("row"))
    rows = _with_patterns(whole, patterns, "left")

    def placed(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:string>>)")
    text = F.col("text")
    terms = F.when(F.col("p_pattern").isNotNull(), placed("term", matches(text, F.col("p_pattern")))).otherwise(none)
    spans = F.concat(*[placed(k, base_spans(text, k)) for k in KINDS], terms)
    rows = rows.withColumn("p_spans", spans)
    found = F.size("p_spans") > 0
    rows = rows.withColumn("p_clean", F.when(found, _replaced(text, F.col("p_spans"), lambda s: F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))).otherwise(text))
    out = {"text": F.col("p_clean")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(found, F.length("p_clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return rows.select(*[out[c].alias(c) if c in out else F.col("row").getField(c).alias(c) for c in docs.columns])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
