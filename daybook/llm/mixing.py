"""Mixing to target weights by soft membership: domain posteriors from a labelled table, then document rates by least squares."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import packed, whole_text, written

#: Hash buckets of words; labelled rows the classifier is fitted and calibrated on at most.
BUCKETS, FIT_ROWS = 8192, 4000
#: How many words a text may count as: the calibration takes the one of these with the least log loss on labelled rows kept out of the fit.
EVIDENCE = (1, 2, 3, 5, 8, 12, 20, 35, 60, 100, 200, 1000)
#: Projected-gradient steps at most, the relative miss of any target at which they end, and the relative gain in ten steps below which the misses are as small as they get.
STEPS, TOLERANCE, GAIN = 120, 1e-4, 0.02


def _words(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per word: the columns to keep, and the hash bucket of the word; a text without words gives one null bucket."""
    words = F.filter(F.split(F.lower(whole_text()), r"\s+"), lambda w: w != "")
    return docs.select(*keep, F.explode_outer(words).alias("w")).select(*keep, F.when(F.col("w").isNotNull(), F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int")).alias("bucket"))


def fit_domains(texts: DataFrame) -> tuple[DataFrame, list[str], list[float]]:
    """Bayes weights of labelled texts (domain, text): a table (bucket, w0, w1, ..: log-likelihood ratios, one per domain) of BUCKETS rows at most, the domains, their log priors."""
    counts = written(_words(texts, "domain").groupBy("domain", "bucket").agg(F.count("bucket").alias("n")))
    totals = {r.domain: r.n for r in counts.groupBy("domain").agg(F.sum("n").alias("n")).collect()}
    domains = sorted(totals)
    if not domains:
        return counts, [], []
    priors = {r.domain: r.n for r in texts.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    rows = sum(priors.values())
    per = counts.filter("bucket IS NOT NULL").groupBy("bucket").agg(*[F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"n{k}") for k, d in enumerate(domains)])
    logs = [F.log((F.col(f"n{k}") + 0.5) / (totals[d] + 0.5 * BUCKETS)) for k, d in enumerate(domains)]
    mean = sum(logs[1:], logs[0]) / len(domains)
    return written(per.select("bucket", *[(x - mean).alias(f"w{k}") for k, x in enumerate(logs)])), domains, [math.log(priors[d] / rows) for d in domains]


def _sums(rows: DataFrame, keys: list[str], weights: DataFrame, domains: list[str]) -> DataFrame:
    """(keys, n_tokens, s0, s1, ..): of the texts of each key the words and the sums of their weights."""
    spread = _words(rows, *keys).join(F.broadcast(weights), "bucket", "left")
    return spread.groupBy(*keys).agg(F.count("bucket").alias("n_tokens"), *[F.coalesce(F.sum(f"w{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(len(domains))])


def _logs(priors: list[float], evidence: float) -> Column:
    factor = F.least(F.lit(1.0), F.lit(float(evidence)) / F.greatest(F.col("n_tokens"), F.lit(1)))
    return F.array(*[F.lit(p) + factor * F.col(f"s{k}") for k, p in enumerate(priors)])


def calibrated(held: DataFrame, weights: DataFrame, domains: list[str], priors: list[float]) -> float:
    """The evidence with the least log loss on labelled texts (fit_id, domain, text) that the fit hasn't seen; the least one without any."""
    sums = _sums(held.filter(F.col("domain").isin(domains)), ["fit_id", "domain"], weights, domains)
    own = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")).cast("int")
    losses = []
    for k, evidence in enumerate(EVIDENCE):
        sums = sums.withColumn("logs", _logs(priors, evidence)).withColumn("top", F.array_max("logs"))
        mass = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
        sums = sums.withColumn(f"loss{k}", F.col("top") + F.log(mass) - F.element_at("logs", own)).drop("logs", "top")
        losses.append(F.sum(f"loss{k}"))
    found = sums.agg(*losses).first()
    return min(zip(EVIDENCE, found, strict=True), key=lambda x: (x[1] if x[1] is not None else 0.0, x[0]))[0]


def posteriors(docs: DataFrame, labelled: DataFrame, fit_rows: int = FIT_ROWS, evidence: float | None = None) -> tuple[DataFrame, list[str]]:
    """(doc_id, n_tokens, p: array of posteriors) for each doc_id, and the domains in the order of p.

    labelled has (doc_id, domain); the `fit_rows` of its rows with the smallest hash of doc_id are the only sample here: four fifths are fitted on, the rest
    calibrates. Log-likelihoods are tempered: a text of n words counts as min(n, evidence) words, so memberships of long texts stay soft; evidence is
    calibrated unless given.
    """
    ids = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = labelled.filter("doc_id IS NOT NULL AND domain IS NOT NULL").select(F.col("doc_id").cast("long").alias("fit_id"), F.col("domain").cast("string").alias("domain")).distinct()
    sample = sample.orderBy(F.xxhash64("fit_id"), "fit_id", "domain").limit(fit_rows)
    texts = written(ids.withColumnRenamed("doc_id", "fit_id").join(F.broadcast(sample), "fit_id"))
    kept_out = F.pmod(F.xxhash64("fit_id", F.lit(1)), F.lit(5)) == 0
    weights, domains, priors = fit_domains(texts.filter(~kept_out))
    if not domains:
        return _words(ids, "doc_id").groupBy("doc_id").agg(F.count("bucket").alias("n_tokens")).withColumn("p", F.array(F.lit(1.0))), ["all"]
    if evidence is None:
        evidence = calibrated(texts.filter(kept_out), weights, domains, priors)
    shifted = F.transform("logs", lambda x: F.exp(x - F.array_max("logs")))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    sums = _sums(ids, ["doc_id"], weights, domains).select("doc_id", "n_tokens", _logs(priors, evidence).alias("logs"))
    return sums.select("doc_id", "n_tokens", shifted.alias("e")).select("doc_id", "n_tokens", F.transform("e", lambda x: x / total).alias("p")), domains


def _rate(steps: list[list[float]]) -> Column:
    """A document's rate after the steps so far: 1 at first, each step subtracts p . g and projects to 0 and above.

    Steps scale with the inverse of the token count (the metric in which all documents of a domain move alike), so only the
    posteriors and the short list of domain gradients enter.
    """
    rate: Column = F.lit(1.0)
    if not steps:
        return rate
    gradients = F.array(*[F.array(*[F.lit(x) for x in g]) for g in steps])
    dot = lambda g: F.aggregate(F.zip_with("p", g, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(gradients, rate, lambda r, g: F.greatest(F.lit(0.0), r - dot(g)))


def soft_mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total: float | str = "same", fit_rows: int = FIT_ROWS, steps: int = STEPS, tolerance: float = TOLERANCE, evidence: float | None = None) -> DataFrame:
    """One row per doc_id: doc_id, n_tokens, domain (of the largest posterior), p (map of posteriors), rate, miss.

    Rates are nonnegative and minimise the squared misses of the expected domain tokens sum(rate * n_tokens * p) from
    weight * total, each weighed by the inverse of the domain's present tokens. total is a token count, "same" for the tokens of docs, or "cover" for the least total at which no
    domain has to shrink. Projected gradient: a step is one aggregation over the posteriors, and only one sum per domain
    reaches the driver. It ends when every target is met to `tolerance`, when ten steps lower the squared misses by less than GAIN of them, as where targets
    are out of reach, or after `steps` steps; in the latter two cases it warns. miss tells how far the worst target is missed, relative to it. Domains of the labelled table without a weight get weight 0, and weights are scaled to sum to 1;
    a weight of a domain that the table lacks is ignored.

    A null text counts as empty (posterior = prior, rate as any other). Rows that repeat a doc_id count as one text joined. Of equal largest
    posteriors the domain first by name is told. A long text is words in rows of their own, never held in one place.
    Null ids or domains are ignored. Without labelled rows there is one domain, "all". No rows give no rows.
    """
    found, domains = posteriors(docs, labelled, fit_rows, evidence)
    found = written(found)
    mass = lambda rate: [F.sum(rate * F.col("n_tokens") * F.element_at("p", k + 1)) for k in range(len(domains))]
    now = [x or 0.0 for x in found.agg(*mass(F.lit(1.0))).first()]
    given = [max(0.0, weights.get(d, 0.0)) for d in domains] if domains != ["all"] else [1.0]
    scale = sum(given) or 1.0
    given = [g / scale for g in given]
    if total == "same":
        goal = sum(now)
    elif total == "cover":
        goal = max([m / g for m, g in zip(now, given, strict=True) if g > 0], default=0.0)
    else:
        goal = float(total)
    targets = [g * goal for g in given]
    # rows of the least-squares system are divided by the root of the mass: then no domain moves much faster than another
    unit = [math.sqrt(m or t or 1.0) for t, m in zip(targets, now, strict=True)]
    gram = found.agg(*[F.sum(F.col("n_tokens") * F.element_at("p", i + 1) * F.element_at("p", j + 1)) for i in range(len(domains)) for j in range(len(domains))]).first()
    k = len(domains)
    m = [[(gram[i * k + j] or 0.0) / unit[i] / unit[j] for j in range(k)] for i in range(k)]
    bound = max((sum(abs(x) for x in row) for row in m), default=1.0) or 1.0
    taken: list[list[float]] = []
    losses: list[float] = []
    while True:
        miss = [(a - t) / u for a, t, u in zip(now, targets, unit, strict=True)]
        worst = max((abs(a - t) / (t or goal or 1.0) for a, t in zip(now, targets, strict=True)), default=0.0)
        losses.append(sum(x * x for x in miss))
        stuck = len(losses) > 10 and losses[-11] - losses[-1] <= GAIN * losses[-11]
        if worst <= tolerance or stuck or len(taken) == steps:
            break
        taken.append([r / u / bound for r, u in zip(miss, unit, strict=True)])
        now = [x or 0.0 for x in found.agg(*mass(_rate(taken))).first()]
    if worst > tolerance:
        warnings.warn(f"after {len(taken)} steps a target is missed by {worst:.2%}: {'no rates come nearer' if stuck else 'more steps may come nearer'}", stacklevel=2)
    names = F.array(*[F.lit(d) for d in domains])
    return found.withColumn("rate", _rate(taken)).select(
        "doc_id",
        "n_tokens",
        F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("domain"),
        F.map_from_arrays(names, "p").alias("p"),
        "rate",
        F.lit(worst).alias("miss"),
    )


def resampled(docs: DataFrame, rates: DataFrame, seed: int = 0) -> DataFrame:
    """Each row of docs as often as its rate (doc_id, rate) says: the whole part, and once more with the chance of the rest, by a hash of its id.

    Rows whose doc_id is null or has no rate are left out; a null rate is 0. Rows that repeat a doc_id are repeated alike. Columns of docs may
    have any name.
    """
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = (F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    chosen = rates.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("rate", F.lit(0.0)).alias("rate")).select("doc_id", F.array_repeat(F.lit(0), copies).alias("copies"))
    both = packed(docs).join(chosen, F.col("row.doc_id").cast("long") == F.col("doc_id"))
    return both.select("row", F.explode("copies")).select("row.*")
