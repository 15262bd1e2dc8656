"""Toxic passages as maximum-scoring segments of token log-odds.

Fitting.  Words and their first four to seven letters are features.  Each gets the log-odds
between toxic and clean documents under an informative Dirichlet prior (the feature's share
among all documents of the sample), and its z-score; a token scores the log-odds of its
feature of greatest |z|, if that reaches ``least_z``, and else a small negative amount.

Scoring.  All maximal scoring segments of a document are found in one linear pass.  Under
clean text the best score of n tokens follows an extreme-value law with E = K n exp(-lambda S):
lambda makes exp(lambda score) average 1 over clean tokens and K comes from the clean
documents' best scores.  Segments with a small E are the toxic passages.  A document's
evidence is the extreme-value score of its best segment and the sum over its significant
ones, and a logistic curve turns that into a probability.  Lambda, K and the curve are
estimated on a part of the sample whose documents gave that model no counts.

The sample is ``sample_rows`` labelled documents, those with the smallest hashes of their
ids; the model has at most ``max_features`` features.  Both bounds keep the broadcasts small.
Counting and scoring run in Arrow batches; labels never reach a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stratalog.llm.common import bounded_batches, free, others, whole_row, written
from stratalog.llm.shingles import Minima, lower_words, shingle_set

WORD = re.compile(r"[^\W_]+")
STEMS = (4, 5, 6, 7)
PRIOR = 0.05       # weight of the Dirichlet prior, as a share of the observed counts
OTHER = -0.5       # score of a token without a telling feature
FOLD = 4           # one sample document in four calibrates
SIGNIFICANT = 0.05
NO_EVIDENCE = -10.0  # extreme-value score of a text without any segment, and the least of all
CACHE_WORDS = 1 << 17
FLUSH_FEATURES = 1 << 17


def features(word: str) -> list[str]:
    """The word itself and its stems; a trailing mark and the length keep them apart."""
    word = word.lower()
    return [word, *(f"{word[:k]}{k}*" for k in STEMS if len(word) >= k)]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (Ruzzo and Tompa), as start, end (exclusive), score.

    Candidates are kept as (start, end, sum before, sum up to the end, nearest earlier
    candidate that begins lower).
    """
    out: list[list] = []
    total = 0.0
    for i, s in enumerate(scores.tolist()):
        before, total = total, total + s
        if s <= 0:
            continue
        start, low = i, before
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= low:
                j = out[j][4]
            if j < 0 or out[j][3] >= total:
                out.append([start, i + 1, low, total, j])
                break
            start, low = out[j][0], out[j][2]
            del out[j:]
    return [(a, b, high - low) for a, b, low, high, _ in out]


@dataclass
class Model:
    weights: dict[str, tuple[float, float]]  # feature -> z, log-odds
    rate: float = 1.0                        # lambda
    scale: float = 1.0                       # K
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def score_of(self, word: str) -> float:
        known = self.known.get(word)
        if known is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            best = max((w for f in features(word) if (w := self.weights.get(f))),
                       key=lambda w: abs(w[0]), default=(0.0, OTHER))
            known = self.known[word] = best[1] if best[1] > 0 else min(best[1], OTHER)
        return known

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, maximal segments over the tokens."""
        words = WORD.findall(text)
        scores = np.fromiter(map(self.score_of, words), float, len(words))
        if not len(words) or scores.max() <= 0:
            return len(words), []
        return len(words), segments(scores)

    def expected(self, n: int, score: float) -> float:
        """Segments of this score or more that n clean tokens have by chance."""
        return self.scale * n * math.exp(-self.rate * min(score, 600.0))

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float]:
        """Extreme-value score of the best segment; the same summed over significant ones."""
        level = math.log(self.scale * max(n, 1))
        best = max((s for _, _, s in found), default=0.0)
        more = sum(self.rate * s - level for _, _, s in found
                   if self.expected(n, s) <= SIGNIFICANT)
        extreme = max(self.rate * best - level, NO_EVIDENCE) if found else NO_EVIDENCE
        return extreme / 10, math.log1p(max(more, 0.0))

    def probability(self, evidence: tuple[float, float]) -> float:
        a, b, c = self.curve
        x = a + b * evidence[0] + c * evidence[1]
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@F.arrow_udf(T.ArrayType(T.LongType()))
def likeness(texts: pa.Array) -> pa.Array:
    """Four keys of two minima each over the word pairs: near copies share one of them."""
    minima, out = Minima(8, seed=10), []
    for text in texts.to_pylist():
        m = minima(shingle_set(lower_words(text), 2)).astype(np.uint64)
        out.append((m[0::2] << np.uint64(32) | m[1::2]).view(np.int64))
    return pa.array(out, pa.list_(pa.int64()))


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """text, toxic, fold of the sample, with one document of each group of near copies.

    Otherwise every rare word of a toxic text with many near copies would tell of toxicity.
    """
    sample = (labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    distinct = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
                .filter("text IS NOT NULL").groupBy("text").agg(F.max("toxic").alias("toxic")))
    rows = written(distinct.withColumn("keys", likeness("text")), "sample")
    apart = rows.select(F.xxhash64("text").alias("id"), "toxic",
                        *[F.col("keys")[i].alias(f"k{i}") for i in range(4)])
    for i in range(4):
        apart = apart.groupBy(f"k{i}").agg(F.min_by(F.struct(*apart.columns), "id").alias("row"))
        apart = apart.select("row.*")
    kept = apart.select("id")
    return (rows.join(F.broadcast(kept), F.xxhash64("text") == F.col("id"), "left_semi")
            .select("text", "toxic",
                    F.pmod(F.xxhash64("text", F.lit(1)), F.lit(FOLD)).cast("int").alias("fold")))


def feature_counts(rows: DataFrame) -> DataFrame:
    """feature, toxic and clean documents of the counting folds, and of all folds."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            values = np.array(list(seen.values()), np.int64).reshape(-1, 4)
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), *[pa.array(values[:, i]) for i in range(4)]],
                names=["feature", "t", "c", "all_t", "all_c"])
            seen.clear()
            return out

        for batch in batches:
            for text, toxic, fold in zip(*(batch.column(i).to_pylist() for i in range(3))):
                kind = 0 if toxic else 1
                for f in {f for w in set(WORD.findall(text)) for f in features(w)}:
                    row = seen.get(f)
                    if row is None:
                        row = seen[f] = [0, 0, 0, 0]
                    row[2 + kind] += 1
                    if fold:
                        row[kind] += 1
                if len(seen) >= FLUSH_FEATURES:
                    yield flush()
        yield flush()

    counted = rows.mapInArrow(count, "feature string, t long, c long, all_t long, all_c long")
    return counted.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("t", "c", "all_t", "all_c")])


def weighed(counts: DataFrame, t: str, c: str) -> tuple[Column, Column]:
    """z-score and log-odds of each feature from its two counts."""
    total = counts.agg(F.sum(t).alias("t"), F.sum(c).alias("c")).first()
    nt, nc = float(total.t or 0), float(total.c or 0)
    prior = PRIOR * (nt + nc) or 1.0
    share = F.greatest((F.col(t) + F.col(c)) * PRIOR, F.lit(1e-9))
    a, b = F.col(t) + share, F.col(c) + share
    odds = F.log(a / (nt + prior - a)) - F.log(b / (nc + prior - b))
    return odds / F.sqrt(1 / a + 1 / b), odds


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 50_000, least_z: float = 3.0,
        max_features: int = 200_000) -> Model:
    """Learn from labels (doc_id, toxic) outside the held-out rows; no labels, no model."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = training_rows(docs, labels, sample_rows)
    counts = written(feature_counts(rows).filter("all_t + all_c >= 3"), "features", True)
    z, odds = weighed(counts, "t", "c")
    all_z, all_odds = weighed(counts, "all_t", "all_c")
    strong = (counts.select("feature", z.alias("z"), odds.alias("odds"),
                            all_z.alias("all_z"), all_odds.alias("all_odds"))
              .withColumn("_z", F.greatest(F.abs("z"), F.abs("all_z")))
              .filter(F.col("_z") >= least_z).orderBy(F.desc("_z"), "feature")
              .limit(max_features).collect())
    tried = Model({r.feature: (r.z, r.odds) for r in strong if abs(r.z) >= least_z})
    model = Model({r.feature: (r.all_z, r.all_odds) for r in strong if abs(r.all_z) >= least_z})
    _calibrate(tried, rows.filter("fold = 0"))
    model.rate, model.scale, model.curve = tried.rate, tried.scale, tried.curve
    return model


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Set lambda, K and the curve from sample documents the weights have not seen.

    To the driver go the histogram of the scores of clean tokens, which has no more values than
    the model has weights, and then two numbers per document.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, up = shared.value, Counter()
        for batch in batches:
            out = []
            for text, toxic in zip(*(batch.column(i).to_pylist() for i in range(2))):
                n, found = held.scan(text)
                out.append({"n": n, "s": [s for _, _, s in found], "toxic": toxic})
                if found and not toxic:
                    up.update(s for w in WORD.findall(text) if (s := held.score_of(w)) > 0)
            yield pa.RecordBatch.from_pylist(out, _SCANNED)
        yield pa.RecordBatch.from_pylist([{"up": s, "times": k} for s, k in up.items()], _SCANNED)

    docs = written(rows.select("text", "toxic").mapInArrow(
        scanned, "n long, s array<double>, toxic long, up double, times long"), "scanned", True)
    seen = docs.filter("up IS NOT NULL").groupBy("up").agg(F.sum("times").alias("times")).collect()
    clean = docs.filter("toxic = 0")
    tokens = (clean.agg(F.sum("n")).first()[0] or 0) + 1
    model.rate = _lambda(np.array([r.up for r in seen]), np.array([r.times for r in seen]), tokens)
    # E(best) over clean documents: mean of K n exp(-lambda S) is 1 where S is the best score.
    best = F.coalesce(F.array_max("s"), F.lit(0.0))
    fits = clean.filter("n > 0").agg(F.avg(F.col("n") * F.exp(best * -model.rate))).first()[0]
    model.scale = 1.0 if fits is None else 1 / max(fits, 1e-9)
    fixed = rows.sparkSession.sparkContext.broadcast(model)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [fixed.value.evidence(n, [(0, 0, v) for v in s]) for n, s in
                 zip(*(batch.column(i).to_pylist() for i in range(2)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()),
                 batch.column(2)], names=["a", "b", "toxic"])

    points = docs.filter("toxic IS NOT NULL").select("n", "s", "toxic").mapInArrow(
        told, "a double, b double, toxic long").collect()
    x = np.array([(r.a, r.b) for r in points]).reshape(-1, 2)
    model.curve = _logistic(x, np.array([float(r.toxic) for r in points]))


_SCANNED = pa.schema([("n", pa.int64()), ("s", pa.list_(pa.float64())), ("toxic", pa.int64()),
                      ("up", pa.float64()), ("times", pa.int64())])


def _lambda(up: np.ndarray, times: np.ndarray, tokens: int) -> float:
    """The positive root of: mean of exp(lambda score) over clean tokens is 1.

    ``up`` has the positive scores and ``times`` how many of the tokens have each.
    """
    values, weights = np.append(up, 4.0), np.append(times, 1)  # one telling token more, so that a root exists
    others = tokens - int(times.sum())

    def over(x: float) -> float:
        return (float((np.exp(np.minimum(x * values, 600)) * weights).sum()) + others * math.exp(x * OTHER)
                - others - int(weights.sum()))
    low, high = 1e-6, 20.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (low, middle) if over(middle) > 0 else (middle, high)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Newton's method with a small ridge; at most ``sample_rows / FOLD`` rows of two numbers."""
    design = np.column_stack([np.ones(len(y)), x])
    w = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        pull = design.T @ (y - p) - ridge * w * [0, 1, 1]
        bend = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-6, ridge, ridge])
        step = np.linalg.solve(bend, pull)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


RESULT = "score double, passages array<struct<start: long, end: long, expected: double>>"
_TYPE = pa.struct([("score", pa.float64()), ("passages", pa.list_(pa.struct([
    ("start", pa.int64()), ("end", pa.int64()), ("expected", pa.float64())])))])


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows with score (0 to 1), predicted (score >= threshold) and passages.

    Passages are the significant segments as code-point offsets with their E.  Null and empty
    texts have no token and get the score of a document without evidence; repeated rows are
    scored alike; columns of the input with one of the new names are replaced.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = shared.value
        for batch in batches:
            yield pa.array([_judged(held, t or "") for t in batch.to_pylist()], _TYPE)

    new = ("score", "predicted", "passages")
    kept = others(docs, new)
    found = free("_scored", kept)
    return (docs.select(*kept, scored(F.col(text)).alias(found))
            .select(*kept, F.col(f"{found}.score").alias("score"),
                    (F.col(f"{found}.score") >= threshold).cast("int").alias("predicted"),
                    F.col(f"{found}.passages").alias("passages")))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text"
               ) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their columns.

    Null and empty texts have no passage and stay where a text without evidence does; repeated
    rows stay or go together, an empty table gives an empty one.
    """
    held = docs.select(whole_row(docs).alias("_row"), F.col(text).alias("_text"))
    return score(held, model, threshold, "_text").filter("predicted = 0").select("_row.*")


def _judged(model: Model, text: str) -> dict:
    n, found = model.scan(text)
    told = [(a, b, e) for a, b, s in found if (e := model.expected(n, s)) <= SIGNIFICANT]
    passages = []
    if told:
        at = [m.span() for m in WORD.finditer(text)]
        passages = [{"start": at[a][0], "end": at[b - 1][1], "expected": e} for a, b, e in told]
    return {"score": model.probability(model.evidence(n, found)), "passages": passages}
