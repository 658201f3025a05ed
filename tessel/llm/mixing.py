"""Soft-membership mixing, by DataFrame operations only.

A labelled table names the domain of some documents. A naive Bayes model over BUCKETS hashed words is fitted on at most
SAMPLE of them (those with the smallest hash of their id; counts are smoothed by ALPHA) and gives every document a
posterior over domains. Words are not independent, so the model's logits are scaled by a temperature: of TEMPERATURES the
one under which a model of half of the sample gives the other half's domains the largest likelihood. All words of a text
count, however long it is.

Document i gets a rate r_i >= 0. The rates minimise the sum over domains k of (sum_i r_i n_i p_ik - w_k B)^2 / T_k, where
n_i are tokens, p_ik posteriors, w_k target weights, B the token budget (default: all tokens) and T_k the domain's tokens
at rate one. From r = B / tokens, projected gradient steps r_i <- max(0, r_i - a sum_k p_ik g_k) are taken, g_k the domain's
residual over T_k and a the spectral (Barzilai-Borwein) size, which the domains' sums and one more sum give; it is 1 at
first, as the scaled problem's largest eigenvalue is. A step is one pass with K + 1 sums over a table of numbers. The
steps so far are a short list that each pass applies to the start, so no rates are written between passes. They end when no
residual exceeds TOLERANCE * B, when a step moves next to nothing (targets that no rates reach), or after ROUNDS passes;
in the last two cases a warning names the largest residual. The rates are those of the smallest one.

Null or empty texts have no tokens and the prior as posterior; their rate follows it but adds nothing. Documents with one
text have one rate. Null ids are no training rows; null labels or domains neither; of documents with one id the smallest
text trains. Of domains with equal posteriors the first in order is named. Without labelled rows, or with targets for none
of the domains, every rate is B / tokens. At most MOST_DOMAINS domains (ValueError beyond). Empty tables give empty
results; further columns are kept, whatever their names (those that begin with two underscores apart).
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BUCKETS, SAMPLE, ALPHA, TOLERANCE, ROUNDS, MOST_DOMAINS = 4096, 20_000, 0.5, 1e-4, 60, 64
TEMPERATURES = [2.0 ** -(k / 2) for k in range(25)]


def tokens(text: str = "text") -> Column:
    """The words of a text: what the six ASCII white-space characters part."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != "")


def _bucket(word: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def _likely(counts: DataFrame, domains: list[str], buckets: int) -> DataFrame:
    """(bucket, l0, l1, ...): log likelihoods of counts (__d, bucket, c); a row for each of the buckets."""
    totals = {r["__d"]: r["n"] for r in counts.groupBy("__d").agg(F.sum("c").alias("n")).collect()}
    likely = [F.log((F.coalesce(F.sum(F.when(F.col("__d") == d, F.col("c"))), F.lit(0)) + ALPHA) / (totals.get(d, 0) + ALPHA * buckets)).alias(f"l{k}") for k, d in enumerate(domains)]
    full = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    return full.groupBy("bucket").agg(*likely) if domains else full.select("bucket").distinct()


def _sums(texts: DataFrame, by: list[str], likely: DataFrame, size: int, buckets: int) -> DataFrame:
    """(*by, __n, m0, m1, ...): of each text its number of tokens and the mean of their log likelihoods."""
    split = texts.select(*by, tokens().alias("__w")).select(*by, F.size("__w").alias("__n"), F.explode_outer("__w").alias("w"))
    each = split.withColumn("bucket", _bucket("w", buckets)).join(F.broadcast(likely), "bucket", "left")  # BUCKETS rows
    # copies of a text have the same mean, so they need no merging before
    return each.groupBy(*by).agg(F.max(F.when(F.col("w").isNull(), 0).otherwise(F.col("__n"))).cast("bigint").alias("__n"), *(F.avg(F.when(F.col("w").isNotNull(), F.col(f"l{k}"))).alias(f"m{k}") for k in range(size)))


def _logits(prior: list[float]) -> list[Column]:
    return [F.lit(prior[k]) + F.coalesce(F.col(f"m{k}"), F.lit(0.0)) * F.col("__n") for k in range(len(prior))]


def _top(columns: list[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def temperature(held: DataFrame, domains: list[str], prior: list[float], likely: DataFrame, buckets: int) -> float:
    """The scale of the logits that gives the rows of held (__id, __d, text) the largest likelihood."""
    found = _sums(held, ["__id", "__d"], likely, len(domains), buckets)
    logit = _logits(prior)
    own = F.coalesce(*(F.when(F.col("__d") == d, x) for d, x in zip(domains, logit, strict=True)))
    rows = found.select(own.alias("own"), _top(logit).alias("top"), *(x.alias(f"x{k}") for k, x in enumerate(logit))).where("own is not null")
    loss = [F.sum((F.col("own") - F.col("top")) * t - F.log(sum((F.exp((F.col(f"x{k}") - F.col("top")) * t) for k in range(len(domains))), F.lit(0.0)))).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]
    got = list(rows.agg(*loss).first())
    return 1.0 if got[0] is None else TEMPERATURES[max(range(len(got)), key=lambda i: got[i])]


def fit(documents: DataFrame, labelled: DataFrame, scratch: Scratch, buckets: int = BUCKETS, sample: int = SAMPLE) -> tuple[list[str], list[float], DataFrame, float]:
    """Domains in order, their log priors, a table (bucket, l0, l1, ...) of log likelihoods, and the temperature.
    labelled: (doc_id, domain)."""
    chosen = labelled.select(F.col("doc_id").alias("__id"), F.col("domain").cast("string").alias("__d")).where("__id is not null and __d is not null").distinct()
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "__d").limit(sample)
    rows = documents.select(F.col("doc_id").alias("__id"), "text").join(F.broadcast(chosen), "__id")  # at most SAMPLE short rows
    rows = scratch.write(rows.groupBy("__id", "__d").agg(F.min("text").alias("text")), "sample")
    half = F.pmod(F.xxhash64("__id", F.lit("half")), F.lit(2))
    words = rows.select("__d", half.alias("half"), F.explode(tokens()).alias("w")).groupBy("__d", "half", _bucket("w", buckets).alias("bucket")).agg(F.count("*").alias("c"))
    counts = scratch.write(words, "counts")
    sizes = {r["__d"]: r["n"] for r in rows.groupBy("__d").agg(F.count("*").alias("n")).collect()}
    have = {r["__d"] for r in counts.select("__d").distinct().collect()}
    domains = sorted(d for d in sizes if d in have)
    if len(domains) > MOST_DOMAINS:
        raise ValueError(f"{len(domains)} domains; at most {MOST_DOMAINS}")
    every = sum(sizes[d] for d in domains)
    prior = [math.log(sizes[d] / every) for d in domains]
    scale = temperature(rows.where(half == 1), domains, prior, _likely(counts.where("half = 0"), domains, buckets), buckets) if domains else 1.0
    model = scratch.write(_likely(counts, domains, buckets), "model")
    scratch.drop(counts, rows)
    return domains, prior, model, scale


def posteriors(documents: DataFrame, model: tuple[list[str], list[float], DataFrame, float], buckets: int = BUCKETS) -> DataFrame:
    """(__k, __n, p0, p1, ...): for each different text's key its number of tokens and its posterior over the domains."""
    domains, prior, likely, scale = model
    size = range(len(domains))
    texts = documents.select(F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("__k"), "text")
    mean = _sums(texts, ["__k"], likely, len(domains), buckets)
    logit = _logits(prior)
    top = _top(logit) if domains else None
    scaled = mean.select("__k", "__n", *(F.exp((x - top) * scale).alias(f"e{k}") for k, x in enumerate(logit)))
    return scaled.select("__k", "__n", *((F.col(f"e{k}") / sum((F.col(f"e{j}") for j in size), F.lit(0.0))).alias(f"p{k}") for k in size))


def solve(rows: DataFrame, weights: list[float], budget: float | None = None) -> DataFrame:
    """rows (n, p0, p1, ..., more) with a column rate. n counts the tokens that a row stands for."""
    size = range(len(weights))

    def after(steps: list[list[float]]) -> Column:
        """(r, q): the rate after the steps and the one before the last of them."""
        listed = F.array(*(F.array(*map(F.lit, g)) for g in steps)).cast("array<array<double>>")
        moved = lambda at, g: F.struct(F.greatest(F.lit(0.0), at["r"] - sum((F.col(f"p{k}") * g[k] for k in size), F.lit(0.0))).alias("r"), at["r"].alias("q"))
        return F.aggregate(listed, F.struct(F.lit(start).alias("r"), F.lit(start).alias("q")), moved)

    full = [float(x) for x in rows.agg(*(F.coalesce(F.sum(x), F.lit(0)).cast("double") for x in (F.col("n"), *(F.col("n") * F.col(f"p{k}") for k in size)))).first()]
    every, *full = full
    budget = every if budget is None else budget
    start = budget / every if every else 1.0
    if not every or not size or sum(weights) <= 0:
        return rows.withColumn("rate", F.lit(start))
    want = [w / sum(weights) * budget for w in weights]
    have, steps, pace = [start * t for t in full], [], 1.0
    residual = lambda: max(abs(h - w) for h, w in zip(have, want, strict=True)) / budget
    best = (residual(), 0)
    while best[0] > TOLERANCE and len(steps) < ROUNDS:
        steps.append([pace * (h - w) / t if t else 0.0 for h, w, t in zip(have, want, full, strict=True)])
        moved = rows.select("n", *(f"p{k}" for k in size), after(steps).alias("at"))
        r, q = F.col("at.r"), F.col("at.q")
        length, *now = moved.agg(F.sum((r - q) * (r - q) * F.col("n")), *(F.sum(r * F.col("n") * F.col(f"p{k}")) for k in size)).first()
        curve = sum((x - y) ** 2 / t for x, y, t in zip(now, have, full, strict=True) if t)
        have = now
        best = min(best, (residual(), len(steps)))
        if math.sqrt(length / every) <= 1e-9 * pace * start or curve <= 0:
            break
        pace = length / curve
    if best[0] > TOLERANCE:
        warnings.warn(f"after {len(steps)} steps a domain's tokens are still {best[0]:.2%} of all off their target", stacklevel=2)
    return rows.withColumn("rate", after(steps[: best[1]])["r"])


def mixed(documents: DataFrame, labelled: DataFrame, targets: dict[str, float] | None, scratch: Scratch) -> DataFrame:
    """Documents with __n (tokens), __domain (the likeliest), __posterior (by domain) and __rate. targets: weight by domain, default equal."""
    model = fit(documents, labelled, scratch)
    domains = model[0]
    by_text = scratch.write(posteriors(documents, model), "posteriors")
    keyed = documents.withColumn("__k", F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    copies = keyed.groupBy("__k").agg(F.count("*").alias("__c"))
    rows = scratch.write(by_text.join(copies, "__k").withColumn("n", F.col("__n") * F.col("__c")), "rows")
    rates = solve(rows, [(targets or {}).get(d, 0.0 if targets else 1.0) for d in domains])
    domain, best = F.lit(None).cast("string"), F.greatest(*(F.col(f"p{k}") for k in range(len(domains)))) if len(domains) > 1 else F.lit(1.0)
    for k in reversed(range(len(domains))):
        domain = F.when(F.col(f"p{k}") >= best, F.lit(domains[k])).otherwise(domain)
    named = F.map_from_arrays(F.array(*map(F.lit, domains)).cast("array<string>"), F.array(*(F.round(f"p{k}", 9) for k in range(len(domains)))).cast("array<double>"))
    found = scratch.write(rates.select("__k", "__n", domain.alias("__domain"), named.alias("__posterior"), F.round("rate", 9).alias("__rate")), "found")
    scratch.drop(by_text, rows)
    return keyed.join(found, "__k").drop("__k")


def domains_of(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table: a domain is a language and a quality."""
    quality = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__q")).where("__q is not null")
    x = documents.select(F.col("doc_id").alias("__d"), F.coalesce("lang", F.lit("?")).alias("__lang")).join(quality, F.col("__d") == F.col("__id"))
    return x.select(F.col("__d").alias("doc_id"), F.concat_ws("/q", "__lang", F.col("__q").cast("string")).alias("domain"))


def quality_targets(labelled: DataFrame) -> dict[str, float]:
    """Equal weights for the languages; within one, four parts of good quality and one of poor."""
    return {r["domain"]: 0.8 if r["domain"].endswith("/q1") else 0.2 for r in labelled.select("domain").distinct().collect()}


def mix(documents: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    labelled = domains_of(documents, labels)
    return mixed(documents, labelled, quality_targets(labelled), scratch)


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, domain, posterior, rate) of every document."""
    out = mix(documents.select("doc_id", "text", "lang"), labels, Scratch(documents.sparkSession))
    return out.select("doc_id", F.col("__n").alias("n_tokens"), F.col("__domain").alias("domain"), F.col("__posterior").alias("posterior"), F.col("__rate").alias("rate"))


def kept(documents: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Documents with a positive rate, their columns and mix_domain, mix_tokens and mix_rate, which replace columns of those names."""
    out = mix(documents, labels, scratch).where("__rate > 0")
    own = [c for c in documents.columns if c not in ("mix_domain", "mix_tokens", "mix_rate")]
    return out.select(*own, F.col("__domain").alias("mix_domain"), F.col("__n").alias("mix_tokens"), F.col("__rate").alias("mix_rate"))
