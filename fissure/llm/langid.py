"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fissure.llm.encoding import text_chunks
from fissure.llm.shared import kept_in_process, materialise, released, shared_value, small_batches, table
from fissure.llm.words import mix, stream

#: Characters in the longest n-gram, and the discount at every order.
ORDER, DISCOUNT = 4, 0.75
#: The bounded training sample: rows of each language, and characters of each language beyond which no further row is taken.
SAMPLE_ROWS, SAMPLE_CHARACTERS = 600, 3_000_000
#: One sampled row in so many is kept from the models and calibrates the rejection.
CALIBRATION = 4
#: Standard deviations above a language's usual cross-entropy that are never rejected, and the slack beyond the calibration rows' worst.
LEAST_SPREAD, SLACK = 12.0, 1.5
#: Nats an event by which whole documents of a language differ, however long (names, lists, other languages in them).
BETWEEN = 0.15
#: Share of the log-likelihood that the score believes; neighbouring characters are not independent.
TEMPER = 0.1
#: Characters of texts, and of distinct tokens, scored at once; bound a worker's memory.
CHUNK, TOKENS = 1 << 21, 1 << 17
#: A token's log-probability counts in steps of 2 ** -UNIT nats: whole numbers sum alike in any order and company.
UNIT = 24
UNKNOWN = "und"
EDGE = 32
_PLACES = stream(11, ORDER) | np.uint64(1)


def _letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@dataclass
class Events:
    """What the models predict in a text: each letter of a run of letters, and the run's end.

    grams[k - 1] hashes the k characters up to the event, for events with at least k - 1 characters
    since the run's edge; contexts[k - 1] hashes the k - 1 characters before it.
    """

    token: np.ndarray
    depth: np.ndarray
    grams: list[np.ndarray]
    contexts: list[np.ndarray]


def events(tokens: list[str]) -> Events:
    """Events of tokens, each token's runs of letters by themselves, lower-cased."""
    is_letter = kept_in_process("letters", _letters)
    codes = np.frombuffer((" " + " ".join(t.replace(" ", "\n") for t in tokens).lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = is_letter[codes]
    before = np.concatenate([[False], letter[:-1]])
    at = np.flatnonzero(letter | before)
    x = np.where(letter, codes, EDGE).astype(np.uint64)
    starts = np.flatnonzero(letter & ~before)
    depth = at - starts[np.searchsorted(starts, at, "right") - 1] + 1
    token = np.cumsum(codes == EDGE)[at] - 1
    # A run's end may be the next token's separator, which already counts as that token.
    token = np.where(letter[at], token, token - (codes[at] == EDGE))
    grams, contexts, total = [], [], np.zeros(len(at), np.uint64)
    for k in range(ORDER):
        contexts.append(mix(total + np.uint64(k)) if k else total)
        total = np.zeros(len(at), np.uint64)
        shifted = np.zeros(len(at), np.uint64)
        for j in range(k + 1):
            shifted = shifted + x[np.maximum(at - j, 0)] * _PLACES[j]
        grams.append(mix(shifted + np.uint64(k + 1)))
        # The context of the next order is these k + 1 characters one place earlier.
        for j in range(k + 1):
            total = total + x[np.maximum(at - 1 - j, 0)] * _PLACES[j]
    return Events(token, np.minimum(depth, ORDER - 1), grams, contexts)


def gram_hashes(grams: list[str]) -> np.ndarray:
    """The hashes that events() gives n-grams, all of one length."""
    k = len(grams[0])
    if not k:
        return np.zeros(len(grams), np.uint64)
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(-1, k)
    total = np.zeros(len(grams), np.uint64)
    for j in range(k):
        total = total + codes[:, k - 1 - j] * _PLACES[j]
    return mix(total + np.uint64(k))


class Model:
    """Models of all languages over the union of their n-grams.

    Per order: sorted hashes of n-grams with a row of log-probabilities, one for each language, and sorted hashes of
    contexts with a row of log back-off weights.
    """

    def __init__(self, languages: list[str], counts: dict[str, Counter]):
        self.languages = languages
        size = len(languages)
        by_order = [self._orders(counts[lang]) for lang in languages]
        alphabet = {g for orders in by_order for g in orders[0]}
        self.floor = np.zeros(size)
        self.grams, self.backoff = [], []
        lower: dict[str, np.ndarray] = {}
        for k in range(1, ORDER + 1):
            union = sorted({g for orders in by_order for g in orders[k - 1]})
            weights: dict[str, np.ndarray] = defaultdict(lambda: np.ones(size))
            rows = {g: np.zeros(size) for g in union}
            for i, orders in enumerate(by_order):
                totals: Counter = Counter()
                kinds: Counter = Counter()
                for g, n in orders[k - 1].items():
                    totals[g[:-1]] += n
                    kinds[g[:-1]] += 1
                for context, n in totals.items():
                    weights[context][i] = DISCOUNT * kinds[context] / n
                for g, n in orders[k - 1].items():
                    rows[g][i] = (n - DISCOUNT) / totals[g[:-1]]
            if k == 1:
                self.floor = np.log(weights[""] / (len(alphabet) + 1))
            for g in union:
                rows[g] = rows[g] + weights[g[:-1]] * (lower[g[1:]] if k > 1 else 1 / (len(alphabet) + 1))
            self.grams.append(self._sorted(rows))
            self.backoff.append(self._sorted(weights))
            lower = rows
        self.usual = self.spread = np.zeros(size)
        self.limit = LEAST_SPREAD

    @staticmethod
    def _orders(counts: Counter) -> list[dict[str, int]]:
        """Counts by order: as seen for n-grams of full order or from a run's edge, else the number of distinct characters before."""
        orders: list[dict[str, int]] = [{} for _ in range(ORDER)]
        for g, n in counts.items():
            orders[len(g) - 1][g] = n
        for k in range(ORDER - 1, 0, -1):
            continued = Counter(g[1:] for g in orders[k])
            for g, n in continued.items():
                orders[k - 1].setdefault(g, n)
        return orders

    @staticmethod
    def _sorted(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if not rows:
            return np.empty(0, np.uint64), np.empty((0, 0))
        hashes = gram_hashes(list(rows))
        order = np.argsort(hashes)
        return hashes[order], np.log(np.array(list(rows.values())))[order]

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the hashes that the table holds, and which those are."""
        known, values = table
        if not len(known):
            return np.zeros(len(hashes), bool), values
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hit = known[at] == hashes
        return hit, values[at[hit]]

    def log_probabilities(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per token: summed log-probability under each language in steps of 2 ** -UNIT, and the number of events."""
        parts = [self._of_tokens(some) for _, _, some in text_chunks(tokens, TOKENS)]
        if not parts:
            return np.zeros((0, len(self.languages)), np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _of_tokens(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        e = events(tokens)
        out = np.tile(self.floor, (len(e.token), 1))
        for k in range(1, ORDER + 1):
            deep = np.flatnonzero(e.depth >= k - 1)
            hit, found = self._find(self.grams[k - 1], e.grams[k - 1][deep])
            miss = deep[~hit]
            out[deep[hit]] = found
            if k > 1:
                known, weight = self._find(self.backoff[k - 1], e.contexts[k - 1][miss])
                out[miss[known]] += weight
        steps = np.rint(out * 2.0**UNIT).astype(np.int64)
        upto = np.vstack([np.zeros((1, len(self.languages)), np.int64), np.cumsum(steps, axis=0)])
        ends = np.searchsorted(e.token, np.arange(len(tokens)), "right")
        starts = np.searchsorted(e.token, np.arange(len(tokens)), "left")
        return upto[ends] - upto[starts], ends - starts

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: cross-entropy in nats an event under each language, and the number of events."""
        lists = pc.utf8_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
        at = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        logs, sizes = self.log_probabilities(coded.dictionary)

        def by_text(values: np.ndarray) -> np.ndarray:
            upto = np.concatenate([[0], np.cumsum(values[codes])])
            return upto[at[1:]] - upto[at[:-1]]

        n = by_text(sizes)
        total = np.stack([by_text(logs[:, i]) for i in range(len(self.languages))], axis=1)
        return -total / 2.0**UNIT / np.maximum(n, 1)[:, None], n

    def calibrate(self, texts: list[str], languages: list[str]) -> None:
        """Learns each language's usual cross-entropy and how far texts of it stray from it.

        A text strays by its cross-entropy's distance from the usual one over its standard error, which has a part
        that shrinks with its length and one between documents, which doesn't.
        Whatever lies within LEAST_SPREAD, or within SLACK times the most that any
        calibration row of its own language strays, is accepted.
        """
        entropy, n = self.score(texts)
        own = np.array([self.languages.index(x) for x in languages], int)
        mine = entropy[np.arange(len(own)), own] if len(own) else np.empty(0)
        self.usual, self.spread = np.zeros(len(self.languages)), np.ones(len(self.languages))
        worst = 0.0
        for i in range(len(self.languages)):
            some = (own == i) & (n > 0)
            if some.sum() < 2:
                self.usual[i] = np.inf  # nothing to judge by: accept
                continue
            self.usual[i] = np.average(mine[some], weights=n[some])
            off = (mine[some] - self.usual[i]) * np.sqrt(n[some])
            self.spread[i] = max(1.4826 * float(np.median(np.abs(off))), 1e-3)
            worst = max(worst, float(((mine[some] - self.usual[i]) / self._error(i, n[some])).max()))
        self.limit = max(LEAST_SPREAD, SLACK * worst)

    def _error(self, language: np.ndarray | int, n: np.ndarray) -> np.ndarray:
        return np.sqrt(BETWEEN**2 + self.spread[language] ** 2 / np.maximum(n, 1))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and rejection of each text."""
        entropy, n = self.score(texts)
        best = entropy.argmin(1)
        lowest = entropy[np.arange(len(best)), best]
        score = 1 / np.exp((lowest[:, None] - entropy) * TEMPER * n[:, None]).sum(1)
        with np.errstate(invalid="ignore"):
            strays = np.where(np.isinf(self.usual[best]), 0, (lowest - self.usual[best]) / self._error(best, n))
        empty = n == 0
        names = [UNKNOWN if e else self.languages[b] for e, b in zip(empty, best, strict=True)]
        return names, np.where(empty, 0.0, score), np.where(empty, np.nan, lowest), empty | (strays > self.limit)


def _labelled(docs: DataFrame) -> DataFrame:
    """The bounded training sample (text, lang, calibrates): whole texts, by hash of doc_id."""
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), mark.alias("mark"), F.xxhash64("doc_id").alias("at"))
    rows = rows.filter("doc_id is not null and lang is not null and mark % 5 <> 0")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # One row for each language; languages are few.
    likely = F.pmod(F.col("at"), F.lit(1 << 30)) < F.least(F.lit(1.0), F.lit(2.0 * SAMPLE_ROWS) / F.col("n")) * (1 << 30)
    some = rows.join(F.broadcast(counts), "lang").filter(likely).filter("text is not null")
    order = Window.partitionBy("lang").orderBy("at", "doc_id", "text")
    some = some.withColumns({"rank": F.row_number().over(order), "ahead": F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return some.filter((F.col("rank") <= SAMPLE_ROWS) & (F.col("ahead") < SAMPLE_CHARACTERS)).select("text", "lang", (F.col("rank") % CALIBRATION == 0).alias("calibrates"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: counts of n-grams of full order, or from a run's edge, by language."""
    counts: dict[str, Counter] = defaultdict(Counter)
    is_letter = str.isalpha
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for run in "".join(c if is_letter(c) else " " for c in text.lower()).split():
                s = f" {run} "
                counts[lang].update(s[max(0, t + 1 - ORDER) : t + 1] for t in range(1, len(s)))
    rows = [(lang, g, n) for lang, c in counts.items() for g, n in c.items()]
    columns = zip(*rows, strict=True) if rows else [[]] * 3
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.string(), pa.string(), pa.int64()], strict=True)], ["lang", "gram", "n"])


def train(docs: DataFrame) -> Model | None:
    """Models from the bounded sample of docs; None where it holds no letters."""
    sample = materialise(_labelled(docs), "labelled")
    counted = sample.filter("not calibrates").select("text", "lang").mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = defaultdict(Counter)
    # Bounded by the sample: distinct n-grams of at most SAMPLE_ROWS rows of each language.
    for r in counted.collect():
        counts[r["lang"]][r["gram"]] = r["n"]
    if not counts:
        return None
    model = Model(sorted(counts), counts)
    held = [r for r in sample.filter("calibrates").collect() if r["lang"] in counts]
    model.calibrate([r["text"] for r in held], [r["lang"] for r in held])
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected: one row per document.

    A null text, or one without a letter, is `und` with score 0 and rejected; so is every text where there is no
    model. Texts whose cross-entropy strays too far from that of their language's calibration rows are rejected.
    Only the text decides: equal texts get equal results. A null doc_id is not held out.
    An empty table gives no rows; columns besides doc_id and text are ignored.
    """
    shared = shared_value(docs.sparkSession, model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for batch in batches:
            for a, b, texts in text_chunks(batch.column(2), CHUNK):
                names, score, entropy, rejected = model.predict(texts) if model else ([UNKNOWN] * (b - a), np.zeros(b - a), np.full(b - a, np.nan), np.ones(b - a, bool))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(names, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected)],
                    ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"],
                )

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(predict), "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents that are not rejected, with their own columns; each row is judged by its text alone.

    Null and empty texts and those without a letter are rejected, as are all where there is no model; null and repeated ids stay
    as they are; an empty table gives no rows.
    """
    shared = shared_value(docs.sparkSession, model)

    @F.arrow_udf("boolean")
    def keeps(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared()
        for column in batches:
            out = [~model.predict(texts)[3] if model else np.zeros(len(texts), bool) for _, _, texts in text_chunks(column, CHUNK)]
            yield pa.array(np.concatenate([*out, np.zeros(0, bool)]))

    return small_batches(docs).filter(keeps(F.col("text").cast("string")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
