"""Soft-membership mixing of domains to target weights.

A classifier fitted to the labelled table gives every document posteriors over
the domains.  Projected gradient descent then finds document rates in [0, max_epochs] whose
expected tokens in each domain match the targets in weighted least squares.  An
iteration is one pass over (posteriors, tokens) that returns one number a domain: a
document's rate follows from its posteriors and the few gradients so far, so it is never stored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens.llm.common import dropped, give_back, materialize, table, trimmed

DOMAINS = ("clean", "low", "toxic")
#: Target shares of tokens.  The total is what the first domain's supply allows.
TARGETS = {"clean": 0.99, "low": 0.004, "toxic": 0.006}
#: A document is used this often at most.
MAX_EPOCHS = 1.0
#: Documented bounds of the classifier: labelled rows it is fitted to, and words it looks at.
MAX_TRAIN, MAX_FEATURES = 12_000, 3_000
#: Least evidence of a word: documents, and the likelihood ratio statistic.
LEAST_DOCS, LEAST_EVIDENCE = 5, 20.0
#: Pull of every rate towards one, iterations, and the change of the totals at which they end.
RIDGE, ITERATIONS, TOLERANCE = 1e-3, 40, 1e-7

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def domain_of(labels: DataFrame) -> Column:
    return F.when(labels["toxic"] == 1, "toxic").when(labels["quality"] == 0, "low").otherwise("clean")


def _document_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text, domain in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.update((word, domain) for word in {*_TOKEN.findall((text or "").lower()), ""})
    words, domains = zip(*counts, strict=True) if counts else ((), ())
    yield pa.RecordBatch.from_arrays(
        [pa.array(words, pa.string()), pa.array(domains, pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "domain", "n"]
    )


class Classifier:
    """Multinomial logistic regression over the presence of chosen words: the domains'
    scores without any of them, and what each word adds."""

    def __init__(self, prior: np.ndarray, weights: dict[str, np.ndarray]):
        self.prior, self.weights = prior, weights

    def posteriors(self, words: set[str]) -> np.ndarray:
        score = self.prior.copy()
        for w in words & self.weights.keys():
            score += self.weights[w]
        e = np.exp(score - score.max())
        return e / e.sum()


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Classifier:
    """Fit to at most max_train labelled documents, chosen by hash of doc_id."""
    rows = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), domain_of(labels).alias("domain"))
    rows = rows.groupBy("doc_id").agg(F.max("domain").alias("domain"))  # of conflicting labels the last by name counts: toxic, low, clean
    sample = rows.orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id").limit(max_train)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("text", "domain")
    counts = texts.mapInArrow(lambda it: trimmed(_document_counts(it)), "word string, domain string, n long").groupBy("word").pivot("domain", list(DOMAINS)).sum("n").fillna(0)
    counts = materialize(counts.where(" + ".join(DOMAINS) + f" >= {LEAST_DOCS} or word = ''"), "mix-counts")
    sizes = counts.where("word = ''").first()
    n = np.array([sizes[d] if sizes else 0 for d in DOMAINS], float)
    prior = np.where(n > 0, 0.0, -50.0) if n.sum() else np.array([0.0, -50.0, -50.0])
    if (n > 0).sum() < 2:
        return Classifier(prior, {})
    total = F.lit(0.0)
    seen = sum(F.col(d) for d in DOMAINS)
    for d, size in zip(DOMAINS, n, strict=True):
        for have, share in ((F.col(d), seen / n.sum()), (F.lit(size) - F.col(d), 1 - seen / n.sum())):
            total = total + F.when(have > 0, 2 * have * F.log(have / (share * size))).otherwise(0.0)
    chosen = counts.where("word != ''").withColumn("evidence", total).where(F.col("evidence") >= LEAST_EVIDENCE)
    words = [r["word"] for r in chosen.orderBy(F.desc("evidence"), "word").limit(MAX_FEATURES).collect()]
    if not words:
        return Classifier(np.where(n > 0, np.log(np.maximum(n, 1)), -50.0), {})

    @F.pandas_udf("array<string>")
    def present(text: pd.Series) -> pd.Series:
        known = set(words)
        return pd.Series([sorted(known.intersection(_TOKEN.findall((t or "").lower()))) for t in text])

    label = F.array_position(F.array(*[F.lit(d) for d in DOMAINS]), F.col("domain")) - 1
    rows = materialize(texts.select(present("text").alias("words"), label.cast("double").alias("label")), "mix-train")
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    vectors = CountVectorizerModel.from_vocabulary(words, "words", "features").setBinary(True).transform(rows)
    model = LogisticRegression(family="multinomial", maxIter=60, regParam=1e-4, standardization=False).fit(vectors)
    weights, first = model.coefficientMatrix.toArray().T, model.interceptVector.toArray()
    weights = np.pad(weights, ((0, 0), (0, len(DOMAINS) - weights.shape[1])))  # domains that no row has
    first = np.pad(first, (0, len(DOMAINS) - len(first)))
    return Classifier(first + prior, dict(zip(words, weights, strict=True)))


def memberships(docs: DataFrame, classifier: Classifier) -> Column:
    """Column of struct(tokens, p): words and marks of the text, and the domains' posteriors."""
    carried = docs.sparkSession.sparkContext.broadcast(classifier)

    @F.pandas_udf("tokens long, p array<double>")
    def member(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = carried.value

        for text in parts:
            tokens, p = [], []
            for t in text:
                words = _TOKEN.findall((t or "").lower())
                tokens.append(len(words))
                p.append(classifier.posteriors(set(words)))
            yield pd.DataFrame({"tokens": tokens, "p": p})
        give_back()

    return member(docs["text"])


def _rates(p: np.ndarray, gradients: list[np.ndarray], most: float, ridge: float) -> np.ndarray:
    """Each document's rate after the projected steps along the gradients so far."""
    step = 1.0 / (1.0 + ridge)
    x = np.full(len(p), min(1.0, most))
    for g in gradients:
        x = np.clip(x - step * (p @ g + ridge * (x - 1.0)), 0.0, most)
    return x


def fit_rates(members: DataFrame, targets: dict[str, float], max_epochs: float = MAX_EPOCHS, ridge: float = RIDGE) -> list[np.ndarray]:
    """The gradients whose steps give the rates; members has p and tokens."""

    def totals(gradients):
        def task(batches):
            total = np.zeros(len(DOMAINS))
            for batch in batches:
                p = np.array(batch.column(0).to_pylist(), float).reshape(-1, len(DOMAINS))
                total += (_rates(p, gradients, max_epochs, ridge) * batch.column(1).to_numpy(zero_copy_only=False)) @ p
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], list(DOMAINS))

        sums = members.select("p", "tokens").mapInArrow(task, ", ".join(f"{d} double" for d in DOMAINS)).agg(*[F.sum(d) for d in DOMAINS]).first()
        return np.array([v or 0.0 for v in sums])

    supply = members.agg(*[F.sum(F.col("p")[k] * F.col("tokens")) for k in range(len(DOMAINS))]).first()
    supply = np.array([v or 0.0 for v in supply])
    if not supply.sum():
        return []
    weight = np.array([targets[d] for d in DOMAINS], float)
    total = supply[0] / weight[0] if weight[0] and supply[0] else supply.sum()
    goal = np.minimum(weight * total, max_epochs * supply)  # no domain can give more than it has
    scale = np.maximum(supply, 1e-9 * supply.sum())
    gradients: list[np.ndarray] = []
    before = None
    for _ in range(ITERATIONS):
        now = totals(gradients)
        if before is not None and np.abs(now - before).max() <= TOLERANCE * supply.sum():
            break
        before = now
        gradients.append((now - goal) / scale)
    return gradients


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, max_epochs: float = MAX_EPOCHS) -> tuple[DataFrame, DataFrame]:
    """(plan, mixed): plan has doc_id, n_tokens, domain, p_clean, p_low, p_toxic, rate, copies and digest (of the text) of
    every row; mixed is docs with each row repeated ``copies`` times and no other column.

    copies is the rate rounded up or down by a hash of doc_id, so that its expectation is
    the rate.  A null or empty text has no tokens and the prior's posteriors.  A null doc_id is
    hashed as such; rows that repeat a doc_id are rounded alike.  Without labels every
    document is of the first domain and stays.  An empty table gives empty results.  Columns of docs
    may have any name.
    """
    targets = targets or TARGETS
    classifier = fit(docs, labels)
    keys = {"doc_id": F.col("doc_id").cast("long"), "digest": F.xxhash64("text")}
    members = materialize(docs.select(*[k.alias(n) for n, k in keys.items()], memberships(docs, classifier).alias("m")).select(*keys, "m.*"), "mix-members")
    gradients = fit_rates(members, targets, max_epochs)

    @F.pandas_udf("double")
    def rate(p: pd.Series) -> pd.Series:
        return pd.Series(_rates(np.array(p.tolist(), float).reshape(-1, len(DOMAINS)), gradients, max_epochs, RIDGE))

    uniform = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    best = F.array_max(F.col("p"))
    plan = materialize(members.withColumn("rate", rate("p")).select(
        "doc_id", F.col("tokens").alias("n_tokens"),
        F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), F.array_position("p", best).cast("int")).alias("domain"),
        *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", F.floor(F.col("rate") + uniform).cast("int").alias("copies"), "digest",
    ), "mix-plan")
    mixed = dropped(docs, keys, plan.where("copies = 0").select(*keys).distinct())
    if max_epochs > 1:
        often = plan.where("copies > 1").select(*keys, "copies").distinct()
        rows = docs.select(F.struct("*").alias("row"), *[k.alias(f"key_{n}") for n, k in keys.items()])
        same = F.col("key_doc_id").eqNullSafe(often["doc_id"]) & F.col("key_digest").eqNullSafe(often["digest"])
        again = rows.join(often, same).select("row", F.explode(F.sequence(F.lit(2), F.col("copies"))))
        mixed = mixed.unionByName(again.select("row.*"))
    return plan, mixed


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0].drop("digest")


QUERIES = {"op4_mixing": op4_mixing}
