"""Mixing to target weights with soft domain membership, by DataFrame functions alone.

1. A Gaussian naive Bayes classifier is fitted to a labelled table (doc_id, domain): one aggregate over its rows gives the means and variances
   of a few dense text features in each domain. It predicts a distribution over the domains for every document.
2. Projected gradient descent fits document rates r with 0 <= r <= max_rate so that the expected tokens of every domain, the sum of
   tokens * posterior * r, match the targets in the least-squares sense of relative errors. Steps are taken in the metric of the documents' tokens,
   so a rate moves by its posterior times the residuals of the domains. Without a max_rate the residuals are scaled by the inverse of the domains'
   shared tokens, by which domains that overlap settle as fast as others. A document's rate follows from the residuals so far and from
   its posterior on a grid of 1/GRID; hence documents of one grid cell are summed first (their tokens by their exact posteriors), each
   iteration is a job over cells, and only the residuals, one number a domain, reach the driver. Rates of documents are then an
   expression of their own columns: no join.

Every step of the model is a column of its own and the only lambda holds columns alone, so a plan grows with the domains and the iterations, never with their
product, and the text is measured once, into a written table.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import discard, materialize

GRID = 256
ITERATIONS = 80
TOLERANCE = 1e-4
RIDGE = 1e-3
REPORTED_GAP = 0.01
VARIANCE_FLOOR = 1e-3

#: Words whose share tells abusive text from other text.
MARKED = "idiot idiots moron morons loser losers scum clown clowns stupid disgusting worthless pathetic trash garbage dumb fool bastard jerk creep liar vermin".split()
FEATURES = ("length", "distinct", "symbols", "capitals", "marked", "word_length")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds _tokens (words between white space and punctuation) and _x, the features. Null counts as empty: 0 tokens, features of 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    n, chars = F.size("_words"), F.greatest(F.length(text), F.lit(1))
    x = F.array(
        F.log1p(F.length(text)),
        F.size(F.array_distinct("_words")) / F.greatest(n, F.lit(1)),
        F.sqrt(F.regexp_count(text, F.lit(r"[#$%&*@|<>~^=+!{}\[\]]")) / chars),
        F.sqrt(F.regexp_count(text, F.lit(r"\p{Lu}")) / chars),
        F.log1p(F.size(F.filter("_words", lambda w: w.isin(MARKED)))),
        F.sqrt(F.length(text) / F.greatest(n, F.lit(1))),
    )
    return docs.withColumn("_words", words).withColumns({"_tokens": n.cast("bigint"), "_x": F.transform(x, lambda v: v.cast("double"))}).drop("_words")


@dataclass(frozen=True)
class DomainModel:
    """Priors, means and variances by domain; a domain without labelled rows has prior 0, and without any all are alike."""

    domains: list[str]
    priors: list[float]
    means: list[list[float]]
    variances: list[list[float]]

    def rated(self, docs: DataFrame, x: str = "_x") -> DataFrame:
        """Adds _p, the distribution over the domains, and _q, the same on the grid, both arrays. Each step is a projection of its own."""
        k = range(len(self.domains))
        logs = {}
        for i, (prior, mean, var) in enumerate(zip(self.priors, self.means, self.variances, strict=True)):
            total = F.lit(math.log(prior) - sum(math.log(v) for v in var) / 2 if prior else -math.inf)
            for j, (m, v) in enumerate(zip(mean, var, strict=True)):
                total = total - (F.col(x)[j] - m) * (F.col(x)[j] - m) / (2 * v)
            logs[f"_l{i}"] = total
        out = docs.withColumns(logs).withColumn("_top", F.greatest(*logs) if len(logs) > 1 else F.col("_l0"))
        out = out.withColumns({f"_m{i}": F.exp(F.col(f"_l{i}") - F.col("_top")) for i in k}).withColumn("_mass", reduce(add, (F.col(f"_m{i}") for i in k)))
        out = out.withColumns({f"_p{i}": F.col(f"_m{i}") / F.col("_mass") for i in k}).withColumns({f"_c{i}": F.rint(F.col(f"_p{i}") * GRID) for i in k})
        out = out.withColumn("_whole", reduce(add, (F.col(f"_c{i}") for i in k)))
        out = out.withColumns({"_p": F.array(*(f"_p{i}" for i in k)), "_q": F.array(*(F.col(f"_c{i}") / F.col("_whole") for i in k))})
        return out.drop("_top", "_mass", "_whole", *(f"_{n}{i}" for n in "lmpc" for i in k))


def fit_domains(labelled: DataFrame, domains: list[str]) -> DomainModel:
    """labelled: domain, _x. Rows of other domains or null count for nothing."""
    n, k = len(FEATURES), len(domains)
    stats = labelled.where(F.col("domain").isin(domains)).groupBy("domain").agg(F.count("*").alias("n"), *(f(F.col("_x")[j]).alias(f"{name}{j}") for j in range(n) for name, f in (("m", F.avg), ("v", F.var_pop))))
    rows = {r["domain"]: r for r in stats.collect()}
    total = sum(r["n"] for r in rows.values())
    if not total:
        return DomainModel(domains, [1 / k] * k, [[0.0] * n] * k, [[1.0] * n] * k)
    return DomainModel(
        domains,
        [rows[d]["n"] / total if d in rows else 0.0 for d in domains],
        [[rows[d][f"m{j}"] if d in rows else 0.0 for j in range(n)] for d in domains],
        [[max(rows[d][f"v{j}"], VARIANCE_FLOOR) if d in rows else 1.0 for j in range(n)] for d in domains],
    )


def rate(q: Column, residuals: list[list[float]], max_rate: float | None) -> Column:
    """The rate that a posterior has after the gradient steps so far, each projected onto the allowed range; 1 before the first."""

    def step(r: Column, e: Column) -> Column:
        moved = r - reduce(add, (q[j] * e[j] for j in range(len(residuals[0]))))
        return F.greatest(F.lit(0.0), moved if max_rate is None else F.least(moved, F.lit(max_rate)))

    if not residuals:
        return F.lit(1.0)
    return F.aggregate(F.array(*(F.array(*map(F.lit, e)) for e in residuals)), F.lit(1.0), step)


@dataclass(frozen=True)
class Mixture:
    model: DomainModel
    targets: list[float]
    residuals: list[list[float]]
    max_rate: float | None
    achieved: list[float]

    @property
    def gap(self) -> float:
        """The largest error of a domain's expected tokens, relative to its target; infinite where the target is 0 and tokens are left."""
        return max((abs(a - t) / t if t else math.inf if a > 0 else 0.0 for a, t in zip(self.achieved, self.targets, strict=True)), default=0.0)

    def report(self) -> None:
        """Warns of expected tokens that miss their targets."""
        if self.gap > REPORTED_GAP:
            parts = (f"{d} {a:.0f} of {t:.0f}" for d, a, t in zip(self.model.domains, self.achieved, self.targets, strict=True))
            warnings.warn(f"the mixture misses its targets, expected tokens: {', '.join(parts)}", stacklevel=2)

    def rated(self, docs: DataFrame) -> DataFrame:
        """Adds _p (posteriors), _q (on the grid) and _rate to measured documents."""
        return self.model.rated(docs).withColumn("_rate", rate(F.col("_q"), self.residuals, self.max_rate))


def fit_mixture(measured_docs: DataFrame, model: DomainModel, weights: dict[str, float], total_tokens: float | None = None, max_rate: float | None = 1.0, iterations: int = ITERATIONS) -> Mixture:
    """Fits rates for the target weights. measured_docs: _tokens, _x.

    total_tokens defaults to the documents' own tokens where rates have no bound, so that scarce domains are repeated and no other is thinned for
    their sake; with a max_rate, to the largest total that the weights allow without repeating a domain. Domains that no document is
    expected to have are left out and the other weights made up to one. Without tokens every rate stays 1.
    """
    k = len(model.domains)
    p, tokens = [F.col("_p")[j] for j in range(k)], F.col("_tokens").cast("double")
    sums = [F.sum(p[j] * tokens).alias(f"t{j}") for j in range(k)] + [F.sum(p[i] * p[j] * tokens).alias(f"t{i}_{j}") for i in range(k) for j in range(k)]
    cells = materialize(model.rated(measured_docs.select("_tokens", "_x")).groupBy("_q").agg(*sums), "cells")

    def expected(residuals: list[list[float]], more: tuple[Column, ...] = ()) -> list[float]:
        """The domains' expected tokens under the rates: exact sums, as all documents of a cell have one rate."""
        rated = cells.withColumn("_r", rate(F.col("_q"), residuals, max_rate))
        return [float(s or 0.0) for s in rated.agg(*(F.sum(F.col(f"t{j}") * F.col("_r")) for j in range(k)), *more).first()]

    pairs = tuple(F.sum(f"t{i}_{j}") for i in range(k) for j in range(k))
    first = expected([], pairs)
    have, shared = first[:k], np.array(first[k:]).reshape(k, k)
    wanted = [weights[d] if have[j] > 0 else 0.0 for j, d in enumerate(model.domains)]
    if not sum(wanted):
        return Mixture(model, have, [], max_rate, have)
    wanted = [w / sum(wanted) for w in wanted]
    if total_tokens is None:
        total_tokens = sum(have) if max_rate is None else min(have[j] / w for j, w in enumerate(wanted) if w)
    targets = [w * total_tokens for w in wanted]
    metric = np.diag([h or 1.0 for h in have])
    if max_rate is None:
        metric = shared + RIDGE * metric
    residuals, now = [], have
    for _ in range(iterations):
        gap = [(now[j] - targets[j]) / have[j] if have[j] else 0.0 for j in range(k)]
        if max(map(abs, gap)) < TOLERANCE:
            break
        residuals.append(np.linalg.solve(metric, np.subtract(now, targets)).tolist())
        before, now = now, expected(residuals)
        if np.allclose(now, before, rtol=TOLERANCE / 100, atol=0):  # the targets are out of the rates' reach
            break
    discard(cells)
    return Mixture(model, targets, residuals, max_rate, now)


def uniform(id_col: str = "doc_id", seed: int = 17) -> Column:
    """A number in [0, 1) that follows from the id and the seed."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 40)) / float(1 << 40)


def copies(rate: Column, id_col: str = "doc_id") -> Column:
    """How often a document of a rate is taken: its whole part, and once more by the draw that takes the rest."""
    whole = F.floor(rate)
    return (whole + (uniform(id_col) < rate - whole).cast("int")).cast("int")


def label_domains(labels: DataFrame) -> DataFrame:
    """One domain a document from the table of labels: toxic before low before good; rows without both marks teach nothing."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("quality") == 1) & (F.col("toxic") == 0), "good")
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when(domain == "toxic", 3).when(domain == "low", 2).when(domain == "good", 1)).alias("d")).select("doc_id", F.element_at(F.array(F.lit("good"), F.lit("low"), F.lit("toxic")), F.col("d")).alias("domain"))


WEIGHTS = {"good": 0.93, "low": 0.05, "toxic": 0.02}


def mixture_for(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, max_rate: float | None = 1.0, keep: tuple[str, ...] = ()) -> tuple[Mixture, DataFrame]:
    """The fitted mixture and the written table of measured documents (doc_id, the columns of `keep`, _tokens, _x) that it was fitted to, one row a document row.

    Rows that repeat a doc_id are measured and rated each; rows without one are rated as well and teach nothing.
    """
    held = materialize(measured(docs.select("doc_id", "text", *keep)).drop("text"), "measured")
    labelled = held.join(label_domains(labels), "doc_id").select("domain", "_x")
    return fit_mixture(held, fit_domains(labelled, list(weights)), weights, max_rate=max_rate), held


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The documents as often as their fitted rates draw them, with the columns of docs, whatever their names.

    A rate above 1 repeats its document, so the tokens stay as many and scarce domains thin no other. The documents travel
    with their measurements in one written table: repeated or null ids need no join. An empty table gives no rows.
    """
    packed = docs.select("doc_id", "text", F.struct("*").alias("_doc"))
    mixture, held = mixture_for(packed, labels, weights, max_rate=None, keep=("_doc",))
    mixture.report()
    rated = mixture.rated(held).withColumn("_copies", copies(F.col("_rate")))
    # a filter on _copies would be pushed below the model, with all its steps nested into one expression; one on what is generated stays above
    drawn = rated.select("_doc", F.explode_outer(F.array_repeat(F.lit(1), F.col("_copies"))).alias("_n")).where("_n is not null")
    return drawn.select(*(F.col("_doc").getField(c).alias(c) for c in docs.columns))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, tokens, domain (of the largest posterior), p_<domain>, rate, copies (how often the draw takes it), kept (once or more)."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    mixture, held = mixture_for(docs, labels, max_rate=None)
    mixture.report()
    domains = mixture.model.domains
    best = F.array_position("_p", F.array_max("_p")).cast("int")
    rated = mixture.rated(held).withColumn("copies", copies(F.col("_rate")))
    return rated.select(
        "doc_id",
        F.col("_tokens").alias("tokens"),
        F.element_at(F.array(*map(F.lit, domains)), best).alias("domain"),
        *(F.col("_p")[j].alias(f"p_{d}") for j, d in enumerate(domains)),
        F.col("_rate").alias("rate"),
        "copies",
        (F.col("copies") > 0).alias("kept"),
    )
