"""Toxicity by weak supervision: mined lexicon and pattern voters, a generative label model, a linear classifier.

Voters are words and word beginnings that go with the label in labelled training texts. The label model takes the
voters' votes on all documents, estimates each voter's rates in either class by expectation maximisation and the
correlations between voters within the classes, and gives each document a posterior. A logistic regression is then
trained on the posteriors of all documents. Spark sums what either fit needs; the driver holds a number for each pair
of voters."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import all_columns, read, save

#: Word beginnings of these lengths are patterns.
PREFIXES = (4, 5, 6, 7)
#: Bounds: labelled texts that voters are mined from, and voters.
SAMPLE, VOTERS = 40_000, 256
ROUNDS = 6
#: A voter must be so much likelier than chance, in log-likelihood, that few of a million features pass by luck; votes
#: that correlate less than this in a class count as independent.
LEAST_SCORE, INDEPENDENT = 14.0, 0.3


def features(text: str) -> set[str]:
    """A text's distinct lower-case words, and the beginnings of its longer words marked by an asterisk."""
    import re

    words = set(re.findall(r"[^\W\d_]+", text.lower()))
    return words | {w[:n] + "*" for w in words if len(w) > 4 for n in PREFIXES if n < len(w)}


def sampled(docs: DataFrame, marks: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic of at most `sample` distinct rows of docs (doc_id, text) that marks (doc_id, toxic) label.

    The rows are those with the smallest hashes of doc_id and text, so the choice does not depend on partitions. It is
    made without the texts; those of the chosen rows follow by a broadcast of at most `sample` keys."""
    key = F.xxhash64("doc_id", "text").alias("key")
    keys = save(docs.select("doc_id", key).join(marks, "doc_id").select("doc_id", "key", "toxic").distinct(), "keys")
    parts = 64 * max(1, -(-keys.count() // sample))
    part = F.pmod("key", F.lit(parts))
    counts = {r.part: r.n for r in keys.select(part.alias("part")).filter(F.col("part") < 128).groupBy("part").agg(F.count("*").alias("n")).collect()}
    below = total = 0
    while below < min(parts, 128) and total + counts.get(below, 0) <= sample:
        total += counts.get(below, 0)
        below += 1
    return docs.select("doc_id", "text", key).join(F.broadcast(keys.filter(part < below)), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("text", "toxic")


def mine_voters(rows: DataFrame, voters: int = VOTERS, least: int = 4) -> list[str]:
    """The words and word beginnings that mark toxic texts best, in rows (text, toxic).

    Taken are the `voters` best by log-likelihood ratio, of those that stand in `least` toxic texts or more and are
    five times likelier there. Of a word and beginnings with equal counts only the first stays."""

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def told():
            keys = [[k, n * (1 - t), n * t] for t in (0, 1) for k, n in seen[t].items()]
            seen[0].clear()
            seen[1].clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int64())], ["feature", "clean", "toxic"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[int(toxic > 0)].update(features(text or ""))
            if len(seen[0]) + len(seen[1]) > 400_000:
                yield told()
        yield told()

    totals = save(rows, "sample")
    n = totals.agg(F.count("*"), F.sum(F.greatest("toxic", F.lit(0)))).first()
    toxic, clean = n[1] or 0, n[0] - (n[1] or 0)
    if not toxic or not clean:
        return []
    counts = totals.select("text", "toxic").mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    share = (F.col("t") + F.col("c")) / float(n[0])
    term = lambda seen, expected: F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)
    score = term(F.col("t"), share * toxic) + term(F.col("c"), share * clean) + term(toxic - F.col("t"), (1 - share) * toxic) + term(clean - F.col("c"), (1 - share) * clean)
    sure = (F.col("t") >= least) & ((F.col("t") + 0.5) / (toxic + 1.0) >= 5 * (F.col("c") + 0.5) / (clean + 1.0))
    best = counts.filter(sure).select("feature", "t", "c", score.alias("score")).filter(F.col("score") >= LEAST_SCORE).orderBy(F.desc("score"), F.length("feature"), "feature").limit(voters * 4).collect()
    kept: dict[tuple, str] = {}
    for row in best:
        stem = row.feature.rstrip("*")
        kept.setdefault((stem[: PREFIXES[0]], row.t, row.c), row.feature)
    return list(kept.values())[:voters]


def votes(docs: DataFrame, voters: list[str], *keep: str) -> DataFrame:
    """doc_id, keep, votes: the sorted numbers of the voters that speak in each text."""
    words = {v: i for i, v in enumerate(voters)}
    schema = docs.select(F.col("doc_id").cast("long"), *keep).schema.add("votes", T.ArrayType(T.IntegerType()))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [sorted({words[f] for f in features(t or "") & words.keys()}) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.list_(pa.int32()))], [*batch.schema.names[1:], "votes"])

    return docs.select("text", F.col("doc_id").cast("long"), *keep).mapInArrow(run, schema)


@dataclass
class LabelModel:
    """prior of the toxic class; for each voter the rates at which it speaks in (clean, toxic) texts, and its weight,
    below 1 for voters whose votes go together within a class."""

    prior: float
    rates: np.ndarray
    weight: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def terms(self) -> tuple[float, np.ndarray]:
        """Log odds of a text without votes, and what each vote adds."""
        speak = self.weight * (np.log(self.rates[:, 1]) - np.log(self.rates[:, 0]))
        silent = self.weight * (np.log1p(-self.rates[:, 1]) - np.log1p(-self.rates[:, 0]))
        start = math.log(self.prior / (1 - self.prior)) + float(silent.sum())
        return self.scale * start + self.shift, self.scale * (speak - silent)

    def posterior(self) -> Column:
        start, add = self.terms()
        return share(log_odds(start, add))


def log_odds(start: float, add: np.ndarray) -> Column:
    """start + what the column votes adds."""
    values = F.split(F.lit(",".join(map(repr, map(float, add)))), ",").cast("array<double>")
    return F.aggregate("votes", F.lit(float(start)), lambda s, i: s + F.coalesce(F.get(values, i), F.lit(0.0)))


def share(odds: Column) -> Column:
    """1 / (1 + exp(-odds))."""
    return 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(500.0)), F.lit(-500.0))))


def moments(patterns: DataFrame, n: int, **values: Column) -> dict[str, np.ndarray]:
    """For each value a symmetric matrix: its sum over the patterns that have both votes i and j. Each has vote n too."""
    names = list(values)
    rows = patterns.select(F.concat("votes", F.array(F.lit(n))).alias("x"), *[v.cast("double").alias(k) for k, v in values.items()])
    pairs = rows.select(*names, "x", F.explode("x").alias("i")).select(*names, "i", F.explode("x").alias("j")).filter("i <= j")
    out = {k: np.zeros((n + 1, n + 1)) for k in names}
    for row in pairs.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in names]).collect():  # one for each pair of voters
        for k in names:
            out[k][row.i, row.j] = out[k][row.j, row.i] = row[k]
    return out


def rates_of(toxic: np.ndarray, clean: np.ndarray) -> tuple[float, np.ndarray]:
    """Prior and rates from the expected joint votes in either class."""
    n = len(toxic) - 1
    rates = np.stack([(np.diag(c)[:n] + 0.5) / (c[n, n] + 1) for c in (clean, toxic)], 1)
    prior = (toxic[n, n] + 0.5) / (toxic[n, n] + clean[n, n] + 1)
    return min(max(float(prior), 1e-6), 1 - 1e-6), rates.clip(1e-9, 1 - 1e-9)


def correlations(toxic: np.ndarray, clean: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """How the votes of each pair of voters go together within the classes: the mean of both, by their joint votes."""
    n = len(rates)
    total, weight = np.zeros((n, n)), np.full((n, n), 1e-9)
    for together, rate in ((clean, rates[:, 0]), (toxic, rates[:, 1])):
        spread = np.sqrt(rate * (1 - rate))
        joint = together[:n, :n]
        total += joint * (joint / (together[n, n] + 1) - np.outer(rate, rate)) / np.outer(spread, spread)
        weight += joint
    out = total / weight
    np.fill_diagonal(out, 0)
    return out


def fit_label_model(patterns: DataFrame, n: int, rounds: int = ROUNDS) -> LabelModel:
    """From patterns (votes, toxic or null, docs): known labels are held, the others are estimated.

    Each round sums, over all patterns, the expected votes of each voter and each pair of voters in either class; rates
    and correlations follow, and voters that correlate with many others weigh less."""
    docs, label = F.col("docs").cast("double"), F.col("toxic").cast("double")
    known = patterns.filter("toxic is not null")

    def expected(rows: DataFrame, p: Column) -> tuple[np.ndarray, np.ndarray]:
        found = moments(rows, n, toxic=docs * p, all=docs)
        return found["toxic"], np.maximum(found["all"] - found["toxic"], 0)

    model = LabelModel(*rates_of(*expected(known, label)), np.ones(n))
    for _ in range(rounds):
        toxic, clean = expected(patterns, F.coalesce(label, model.posterior()))
        prior, rates = rates_of(toxic, clean)
        together = (np.maximum(0, correlations(toxic, clean, rates) - INDEPENDENT) / (1 - INDEPENDENT)).sum(1)
        model = LabelModel(prior, rates, 1 / (1 + together))
    return calibrated(model, known)


def newton(sums, size: int, ridge: float = 0.05, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; sums gives gradient and curvature at some weights."""
    theta = np.zeros(size)
    for _ in range(steps):
        slope, curve = sums(theta)
        step = np.linalg.solve(curve + (ridge + 1e-9) * np.eye(size), slope + ridge * theta)
        theta -= step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-5:
            break
    return theta


def calibrated(model: LabelModel, known: DataFrame) -> LabelModel:
    """The model with one scale and one shift of its log odds, so that posteriors agree with the labels in known (votes,
    toxic, docs): weights that allow for correlated voters take away too much where few voters speak."""
    start, add = model.terms()
    docs = F.col("docs").cast("double")
    rows = known.select(docs.alias("docs"), F.col("toxic").cast("double").alias("toxic"), log_odds(start, add).alias("odds"))

    def sums(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        guess = share(F.col("odds") * float(theta[0]) + float(theta[1]))
        r, w, o = F.col("docs") * (guess - F.col("toxic")), F.col("docs") * guess * (1 - guess), F.col("odds")
        x = [v or 0.0 for v in rows.agg(F.sum(r * o), F.sum(r), F.sum(w * o * o), F.sum(w * o), F.sum(w)).first()]
        return np.array(x[:2]), np.array([[x[2], x[3]], [x[3], x[4]]])

    scale, shift = newton(sums, 2)
    model.scale, model.shift = max(float(scale), 0.1), float(shift)
    return model


def fit_classifier(patterns: DataFrame, model: LabelModel, n: int) -> tuple[float, np.ndarray]:
    """(bias, weights) of a logistic regression of the posterior on votes, over all vote patterns."""
    rows = save(patterns.groupBy("votes").agg(F.sum("docs").cast("double").alias("docs")).withColumn("p", model.posterior()), "posteriors")

    def sums(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        guess = share(log_odds(theta[n], theta[:n]))
        found = moments(rows.withColumn("guess", guess), n, r=F.expr("docs * (guess - p)"), w=F.expr("docs * guess * (1 - guess)"))
        return found["r"][n], found["w"]

    theta = newton(sums, n + 1)
    return float(theta[n]), theta[:n]


def learnt(docs: DataFrame, labels: DataFrame, *keep: Column) -> tuple[DataFrame, Column]:
    """(rows of docs as doc_id, keep and votes, their score)."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    voters = mine_voters(sampled(docs, marks))
    if not voters:
        return docs.select(F.col("doc_id").cast("long"), *keep), F.lit(0.0)
    kept = docs.select("doc_id", "text", *keep)
    voted = save(votes(kept, voters, *kept.columns[2:]), "votes")
    patterns = save(voted.join(marks, "doc_id", "left").groupBy("votes", "toxic").agg(F.count("*").alias("docs")), "patterns")
    bias, weights = fit_classifier(patterns, fit_label_model(patterns, len(voters)), len(voters))
    return voted, share(log_odds(bias, weights))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score for each row of docs (doc_id, text), learnt from labels (doc_id, toxic).

    The score depends on the text alone: null and empty texts have no votes and get the score of silence. Null labels
    are no labels; a document with several counts as toxic if one says so. Without labels of both classes there are no
    voters and every score is 0. Repeated rows are scored each; no rows give none."""
    rows, found = learnt(docs, labels)
    return rows.select("doc_id", found.alias("score"))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score under 0.5, with all their columns. Each row is judged by its own text, also where
    several rows share a doc_id or have none."""
    same = lambda: F.array(F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "text", "doc_id"))
    rows, found = learnt(docs, labels, same().alias("same_row"))
    toxic = rows.filter(found >= 0.5).select(F.col("same_row").alias("toxic_row")).distinct()
    return docs.join(toxic, same() == F.col("toxic_row"), "left_anti").select(all_columns(docs))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of all documents, learnt from the labels of those that are not held out. Null and empty texts get the
    score of silence, repeated rows are scored each, no rows give none."""
    found = score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").filter(~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
