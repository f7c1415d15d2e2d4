"""URL filters: ordered allow and block rules, then logistic regression on hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fissure.llm.shared import materialise, table

ALLOW, BLOCK = "allow", "block"
#: The labelled table that is fitted: at most so many rows of each verdict.
LABELLED_ROWS = 3000
#: Characters in an n-gram, and buckets that n-grams are hashed to.
GRAMS, BUCKETS = (3, 4), 1 << 14


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules that come before the model.
RULES = [Rule(ALLOW, "org", "/"), Rule(BLOCK, "example.org", "/es/"), Rule(BLOCK, "example.org", "/en/1"), Rule(ALLOW, "com", "/fr/"), Rule(BLOCK, "com", "/de/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null or where there is no `://`."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Name of the longest rule that fits, and null where none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


def _grams(text: Column, mark: str) -> Column:
    """Character n-grams with the text's edges and a mark of where they come from."""
    edged = F.concat(F.lit("^"), text, F.lit("$"))
    some = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(edged) - n + 1, F.lit(1))), lambda i, n=n: F.concat(F.lit(mark), edged.substr(i, F.lit(n)))) for n in GRAMS]
    return F.concat(*some)


def parse_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    return rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))


def _with_grams(rows: DataFrame) -> DataFrame:
    return rows.withColumn("grams", F.concat(_grams(F.col("host"), "h:"), _grams(F.col("path"), "p:")))


def labelled_urls(parsed: DataFrame, rules: list[Rule]) -> DataFrame:
    """A small labelled table (host, path, label): urls that a rule settles, at most LABELLED_ROWS of each verdict, by hash."""
    names = {v: [r.name for r in rules if r.verdict == v] for v in (ALLOW, BLOCK)}
    parts = []
    for verdict, label in ((ALLOW, 0.0), (BLOCK, 1.0)):
        rows = parsed.filter(F.col("rule").isin(names[verdict])) if names[verdict] else parsed.limit(0)
        parts.append(rows.orderBy(F.xxhash64("host", "path"), "host", "path").limit(LABELLED_ROWS).select("host", "path", F.lit(label).alias("label")))
    return parts[0].unionByName(parts[1])


def fit(labelled: DataFrame) -> PipelineModel | str:
    """A model from the labelled table; where it has one verdict alone, that verdict, and `allow` where it is empty."""
    rows = materialise(labelled, "labelled-urls")
    labels = sorted(r["label"] for r in rows.select("label").distinct().collect())
    if len(labels) < 2:
        return BLOCK if labels == [1.0] else ALLOW
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=BUCKETS)
    regression = LogisticRegression(featuresCol="features", labelCol="label", maxIter=60, regParam=0.003)
    return PipelineModel([hashing, regression.fit(hashing.transform(_with_grams(rows.coalesce(4))))])


def judge_urls(pages: DataFrame, rules: list[Rule], model: PipelineModel | str) -> DataFrame:
    """page_id, host, path, rule, verdict, block_probability: one row per page.

    A rule settles the verdict where one fits; the model decides the others, from host and path alone. A null url, or one
    without `://`, has empty host and path and is judged like others. Null page_ids and repeated rows each give a row; an
    empty table gives none; columns besides page_id and url are ignored (page contents are not read).
    """
    parsed = parse_urls(pages, rules)
    by_rule = F.lit(None).cast("string")
    for r in rules:
        by_rule = F.when(F.col("rule") == r.name, F.lit(r.verdict)).otherwise(by_rule)
    if isinstance(model, str):
        scored = parsed.withColumn("block_probability", F.lit(float(model == BLOCK)))
    else:
        from pyspark.ml.functions import vector_to_array

        scored = model.transform(_with_grams(parsed)).withColumn("block_probability", vector_to_array("probability")[1])
    by_model = F.when(F.col("block_probability") >= 0.5, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return scored.select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_model).alias("verdict"), "block_probability")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = fit(labelled_urls(parse_urls(pages, RULES), RULES))
    return judge_urls(pages, RULES, model)
