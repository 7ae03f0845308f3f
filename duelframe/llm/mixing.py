"""Mixing to target weights by soft membership; DataFrame functions only.

A naive Bayes classifier over hashed words, fitted on labelled documents, gives every document a
posterior over domains. Projected-gradient least squares then finds a nonnegative rate for each
document such that the expected tokens of each domain, sum(rate * tokens * posterior), match the
targets. The gradient of a document needs only the residual of each domain; the rate of a document is
recomputed from the list of past steps and never stored or sent. Documents with equal posteriors have equal
rates, so their tokens are added up once, and aggregations read one row for each distinct posterior.

Steps are taken in the metric of the documents' tokens, with each domain's residual scaled by its
diagonal entry of sum(tokens * p * p'). They are implicit: the gradient is that of the step's end, so a step of any length
converges (proximal points), and long ones need few. Where a step ends is the least point of a convex function of as
many numbers as there are domains, found by Newton's method: an aggregation of a few sums for each of its iterations.

Cases: a null or empty text has no tokens, the prior as its posterior, and a rate like others; null
labels are ignored; a document labelled more than once counts with its least domain; domains
of next to no tokens get no share; without any labels all documents are of the first domain; an empty
table gives no rows; columns that have the names of results are replaced.
"""

from __future__ import annotations

import json
import math
import warnings
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, let, table, whole, written
from .quality import SYMBOLS, words_of

#: Labelled documents that the classifier is fitted on, at most: those with the least md5(doc_id).
FIT_DOCS = 20_000
#: Hash buckets of words; words of odd shapes have three more buckets.
BUCKETS = 1 << 16
SHAPES = 3
SMOOTH = 0.5
#: To count, a bucket must be in this share of a domain's documents, with log odds that exceed
#: the first domain's by so much; rarer ones say little and their noise adds up.
COMMON = 0.05
TELLING = 3.0
#: Buckets that count, at most: those whose log odds differ most.
MOST_TELLING = 256
SIEVE = 4096
DOMAINS = ("clean", "poor", "toxic")
#: Shares of expected tokens. The first domain keeps its tokens; the others are set against it.
TARGETS = {"clean": 0.90, "poor": 0.08, "toxic": 0.02}
CLOSE = 1e-4
#: Length of a step, where 1 / (largest eigenvalue) is the longest that explicit steps may have.
LENGTH = 1e6
#: Dampings of Newton's method that are tried side by side.
DAMPING = (0.0, 1e-6, 1e-3, 1.0)
#: The solution is at its least where the squared miss falls by less than this share in a step.
STALLED = 0.01


def _bucket(word: Column) -> Column:
    # Most words have none of these characters, and one test is enough for them.
    odd = word.rlike("[A-Z0-9#*$%&|<>]")
    shape = F.when(word.rlike(SYMBOLS), 0).when(word.rlike(r"^[^a-z]*[A-Z][^a-z]*[A-Z!][^a-z]*$"), 1).when(word.rlike("[0-9]"), 2)
    plain = F.pmod(F.xxhash64(F.lower(F.rtrim(word, F.lit(".,;:!?")))), F.lit(BUCKETS))
    return F.when(~odd, plain).otherwise(F.coalesce(F.lit(BUCKETS) + shape, plain)).cast("int")


def buckets_of(text: Column) -> Column:
    return F.transform(words_of(text), _bucket)


def label_domains(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) as doc_id, domain."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain")).where("domain IS NOT NULL AND doc_id IS NOT NULL")


class Model(NamedTuple):
    buckets: list[int]
    #: By domain: the score of a text with none of the buckets, and what each bucket adds.
    intercepts: list[float]
    weights: list[list[float]]


def fit(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...] = DOMAINS) -> Model:
    """Naive Bayes on the presence of buckets, from labelled(doc_id, domain)."""
    one = labelled.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sample = one.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(FIT_DOCS)  # 20,000 narrow rows at most: broadcast
    rows = docs.select("doc_id", whole("text").alias("_text")).join(F.broadcast(sample), "doc_id")
    priors = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = rows.select("domain", F.explode(F.array_distinct(buckets_of(F.col("_text")))).alias("b")).groupBy("domain", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    width = BUCKETS + SHAPES
    table_ = {d: [0] * width for d in domains}
    for r in counts:
        table_[r["domain"]][r["b"]] = r["n"]
    total = sum(priors.values())
    log_priors = [math.log((priors.get(d, 0) + 1e-9) / (total + 1e-9 * len(domains))) if total else (0.0 if i == 0 else -50.0) for i, d in enumerate(domains)]
    odds, absent = [], []
    for d in domains:
        n = priors.get(d, 0)
        absent.append([math.log((n - c + SMOOTH) / (n + 2 * SMOOTH)) for c in table_[d]])
        odds.append([math.log((c + SMOOTH) / (n + 2 * SMOOTH)) - a for c, a in zip(table_[d], absent[-1])])
    # Only words that tell domains apart count; the rest is noise that long texts pile up.
    known = [i for i, d in enumerate(domains) if priors.get(d)]
    # Marks of other domains only: words that are typical of the first domain are those of its
    # largest language, whose absence would count against documents in another language.
    spread = lambda b: max(odds[i][b] for i in known[1:]) - odds[known[0]][b]
    common = [b for b in range(width) if len(known) > 1 and any(table_[domains[i]][b] >= COMMON * priors[domains[i]] for i in known)]
    telling = sorted(sorted((b for b in common if spread(b) > TELLING), key=lambda b: (-spread(b), b))[:MOST_TELLING])
    return Model(telling, [p + sum(row[b] for b in telling) for p, row in zip(log_priors, absent)], [[row[b] for b in telling] for row in odds])


def _numbers(values: list) -> Column:
    """An array literal; the optimizer parses it once."""
    kind = "array<array<double>>" if values and isinstance(values[0], list) else "array<double>"
    return F.from_json(F.lit(json.dumps(values)), kind)


def posteriors(text: Column, model: Model) -> Column:
    """struct(n: words, p: array of posteriors by domain)."""

    def score(at: Column, start: float, row: list[float]) -> Column:
        return F.aggregate(at, F.lit(start), lambda a, i: a + F.get(_numbers(row), i)) if row else F.lit(start)

    def shares(s: Column) -> Column:
        return let(F.transform(s, lambda x: F.exp(x - F.array_max(s))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))

    def scores(at: Column) -> Column:
        return let(F.array(*[score(at, start, row) for start, row in zip(model.intercepts, model.weights)]), shares)

    telling = F.from_json(F.lit(json.dumps(model.buckets)), "array<int>")
    # A table by remainder spares nearly all words the search in the list.
    sieve = [False] * SIEVE
    for b in model.buckets:
        sieve[b % SIEVE] = True
    may_tell = F.from_json(F.lit(json.dumps(sieve)), "array<boolean>")

    def of_ids(ids: Column) -> Column:
        found = F.array_distinct(F.filter(ids, lambda i: F.get(may_tell, i % SIEVE) & F.array_contains(telling, i)))
        at = F.transform(found, lambda i: (F.array_position(telling, i) - 1).cast("int"))
        return F.struct(F.size(ids).cast("long").alias("n"), let(at, scores).alias("p"))

    return let(buckets_of(text), of_ids)


def _dot(p: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(p, y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def rate_of(p: Column, steps: list[list[float]]) -> Column:
    """The rate after these steps, from 1: each adds its product with p and projects onto >= 0."""
    if not steps:
        return F.lit(1.0)
    return F.aggregate(_numbers(steps), F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r + _dot(p, s)))


def _trials(f: DataFrame, steps: list[list[float]], trials: list[list[float]]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each trial as the next step: tokens by domain, sum(tokens * p * p') over rates above 0, sum(tokens * rate^2)."""
    d = len(trials[0])
    at = lambda i: F.get("p", F.lit(i))
    rates = F.array(*[F.greatest(F.lit(0.0), F.col("r") + _dot(F.col("p"), _numbers(t))) for t in trials])
    rows = f.select("n", "p", rate_of(F.col("p"), steps).alias("r")).select("n", "p", F.posexplode(rates).alias("trial", "r"))
    free = F.when(F.col("r") > 0, F.col("n")).otherwise(F.lit(0))
    sums = [F.sum(F.col("n") * F.col("r") * at(i)).alias(f"s{i}") for i in range(d)] + [F.sum(free * at(i) * at(j)).alias(f"m{i}_{j}") for i in range(d) for j in range(i, d)]
    got = rows.groupBy("trial").agg(*sums, F.sum(F.col("n") * F.col("r") * F.col("r")).alias("rr")).collect()
    out = {r["trial"]: (np.array([r[f"s{i}"] for i in range(d)]), np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]), r["rr"]) for r in got}
    return [out.get(k, (np.zeros(d), np.zeros((d, d)), 0.0)) for k in range(len(trials))]


def solve(f: DataFrame, targets: list[float]) -> list[list[float]]:
    """Steps for rate_of(), from f(n, p): tokens and posteriors of every document.

    targets: shares by domain; the first domain keeps its expected tokens.
    """
    d = len(targets)
    f = written(f.groupBy("p").agg(F.sum("n").alias("n")), "mixing-posteriors")
    sums, m, rr = _trials(f, [], [[0.0] * d])[0]
    part = sums > 1e-6 * sums.sum()  # a domain of next to no tokens has none
    goal = np.array(targets) * sums[0] / targets[0]
    q = np.where(part, 1 / np.sqrt(np.where(m.diagonal() > 0, m.diagonal(), 1.0)), 0.0)
    near = CLOSE * np.maximum(goal, max(1e-3 * goal.sum(), 1e-9))
    met = lambda: bool(np.all((abs(sums - goal) <= near) | ~part))
    steps: list[list[float]] = []
    first = miss = float(np.sum((q * (goal - sums)) ** 2))
    while not met():
        # One step: s is the gradient where the step ends, times its length. That is the point where a convex function
        # of s is least, and Newton's method gets there; trials differ in how much they are damped.
        s = np.zeros(d)
        least = rr / 2
        while not met():
            slope = q * (goal - sums) - s / LENGTH
            if np.linalg.norm(slope) <= 1e-3 * np.linalg.norm(s) / LENGTH + 1e-9 * math.sqrt(first):
                break
            hessian = m * np.outer(q, q)
            # Rounded, so that the order of a sum doesn't show in the rates.
            trials = [np.round(q * (s + np.linalg.solve(hessian + (1 / LENGTH + x) * np.eye(d), slope)), 10) for x in DAMPING]
            ends = [np.divide(t, q, out=np.zeros(d), where=part) for t in trials]
            got = _trials(f, steps, [t.tolist() for t in trials])
            values = [g[2] / 2 - float((q * goal) @ e) + float(e @ e) / (2 * LENGTH) for g, e in zip(got, ends)]
            k = int(np.argmin(values))
            if values[k] >= least - 1e-13 * abs(least):
                break
            least, s, (sums, m, rr) = values[k], ends[k], got[k]
            step = trials[k].tolist()
        before, miss = miss, float(np.sum((q * (goal - sums)) ** 2))
        if s.any():
            steps.append(step)
        if not met() and miss > (1 - STALLED) * before:
            # No rates meet the targets: what least squares give stands, and is told.
            warnings.warn(f"mixing: after {len(steps)} steps the domains' tokens are {np.round(sums, 3).tolist()}, not the targets' {np.round(goal, 3).tolist()}", stacklevel=2)
            break
    drop_written(f)
    return steps


def copies_of(rate: Column, key: Column) -> Column:
    """A count with the rate as its mean: the fraction decides by a hash of the key."""
    u = F.pmod(F.xxhash64(F.lit("mix"), key), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.floor(rate + u).cast("int")


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The documents, each as often as its copies say, with their own columns. Documents that are
    of the kept (first) domain rather than any other have a rate of about 1, rounded, and so stay; of the
    others the copies have the rate as their mean, by a hash of doc_id and text."""
    domains = tuple(targets)
    model = fit(docs, labelled, domains)
    f = written(docs.select(posteriors(whole("text"), model).alias("x")).select("x.n", "x.p"), "mixing-features")
    steps = solve(f, list(targets.values()))
    drop_written(f)
    inner = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), posteriors(whole(docs["text"]), model).alias("_x"))
    rate = F.round(rate_of(F.col("_x.p"), steps), 9)
    n = F.when(F.get("_x.p", F.lit(0)) >= 0.5, F.floor(rate + 0.5).cast("int")).otherwise(copies_of(rate, F.xxhash64("_row.doc_id", "_row.text")))
    return inner.select("_row", F.explode(F.array_repeat(F.lit(1), n)).alias("_again")).select("_row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate, copies (a count with the rate as its mean)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, label_domains(table(spark, sf_dir, "labels")))
    f = written(docs.select("doc_id", posteriors(whole("text"), model).alias("x")).select("doc_id", "x.n", "x.p"), "mixing-features")
    steps = solve(f, list(TARGETS.values()))
    rate = F.round(rate_of(F.col("p"), steps), 9)
    out = f.select("doc_id", F.col("n").alias("n_tokens"), *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(TARGETS)], rate.alias("rate"))
    return out.withColumn("copies", copies_of(F.col("rate"), F.col("doc_id")))
