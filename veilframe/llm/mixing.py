"""Mixing documents to target domain weights with soft memberships.

A classifier learned from labelled rows gives each document a posterior over domains, so its tokens belong to all domains
in part. Nonnegative rates (how often a document is taken) are fitted by projected-gradient least squares: the expected
tokens per domain should be the targets, and rates should stay near one. The gradient needs one number per domain from the
corpus, so a step is one aggregation over (tokens, posterior); a rate is a function of the posterior and of the sums seen so far,
so nothing per document is kept between the steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import free_name, give_back, lean, pieces, utf8, word_hashes
from veilframe.session import cut_lineage

BUCKETS = 4096
PER_DOMAIN = 1500
_CHUNK = 1 << 20
_GRAM = 4


def features(data: np.ndarray, bounds: np.ndarray, buckets: int) -> np.ndarray:
    """Rooted counts of hashed byte 4-grams (A-Z in lower case), each row at length one."""
    rows = len(bounds) - 1
    n = len(data) - _GRAM + 1
    if n <= 0:
        return np.zeros((rows, buckets), np.float32)
    low = np.where((data >= 65) & (data < 91), data + 32, data).astype(np.uint32)
    code = low[:n] | low[1:n + 1] << np.uint32(8) | low[2:n + 2] << np.uint32(16) | low[3:n + 3] << np.uint32(24)
    bucket = (code * np.uint32(2654435761) >> np.uint32(32 - (buckets - 1).bit_length())).astype(np.int64)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    inside = row[:n] == row[_GRAM - 1:]
    counts = np.bincount(row[:n][inside] * buckets + bucket[inside], minlength=rows * buckets).reshape(rows, buckets)
    out = np.sqrt(counts, dtype=np.float32)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length == 0, 1, length)


def _feature_chunks(texts: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, bounds = utf8(texts)
    for a, b in pieces(bounds + 4096 * np.arange(len(bounds)), _CHUNK):  # short texts cost a row of buckets too
        part, limits = data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a]
        yield features(part, limits, buckets), np.diff(word_hashes(part, limits)[1])


@dataclass(frozen=True)
class DomainModel:
    """A linear softmax classifier over hashed 4-grams."""

    domains: tuple[str, ...]
    weights: np.ndarray  # buckets + 1 rows, one column per domain

    def posterior(self, x: np.ndarray) -> np.ndarray:
        score = x @ self.weights[:-1] + self.weights[-1]
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)


def learn_domains(labelled: DataFrame, text_col: str = "text", domain_col: str = "domain", per_domain: int = PER_DOMAIN,
                  buckets: int = BUCKETS, steps: int = 300, sizes: dict[str, int] | None = None) -> DomainModel:
    """Softmax regression on about ``per_domain`` rows of each domain, chosen by a hash of the text (all, if there are fewer);
    ``per_domain`` bounds what reaches the driver. ``sizes`` are the domains' sizes in the corpus, if ``labelled`` is a sample
    already. Rows with null text or domain teach nothing. With no rows at all there is one domain, named unknown."""
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(domain_col).cast("string").alias("domain")).where(
        "text IS NOT NULL AND domain IS NOT NULL")
    counts = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return DomainModel(("unknown",), np.zeros((buckets + 1, 1)))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_domain / n))])
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share[F.col("domain")] * (1 << 30))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x, _ in _feature_chunks(batch.column("text"), buckets):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("domain").slice(at, len(x)), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())],
                    ["domain", "x"])
                at += len(x)

    found = sample.mapInArrow(lean(describe), "domain string, x binary").collect()
    found.sort(key=lambda r: (r["domain"], bytes(r["x"])))
    domains = tuple(sorted(counts))
    y = np.array([domains.index(r["domain"]) for r in found])
    x = np.array([np.frombuffer(r["x"], np.float16) for r in found]).reshape(-1, buckets).astype(np.float32)
    weights = np.zeros((buckets + 1, len(domains)), np.float32)
    momentum = np.zeros_like(weights)
    # Classes weigh by their size in the corpus, so that posteriors are calibrated to it.
    weight = np.array([(sizes or counts).get(d, counts[d]) for d in domains])[y] / np.bincount(y, minlength=len(domains))[y]
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    target = np.eye(len(domains), dtype=np.float32)[y]
    for _ in range(steps):
        error = (DomainModel(domains, weights).posterior(x) - target) * weight
        gradient = np.vstack([x.T @ error, error.sum(axis=0)]) + 1e-6 * weights
        momentum = 0.9 * momentum - 8.0 * gradient
        weights = weights + momentum
    return DomainModel(domains, weights.astype(np.float32))


def memberships(text: Column, model: DomainModel) -> Column:
    """A struct of ``n_tokens`` (words) and ``posterior`` (in the order of the model's domains). Null text is empty."""

    @F.arrow_udf("struct<n_tokens:bigint,posterior:array<double>>")
    def predict(texts: pa.Array) -> pa.Array:
        tokens, found = [np.zeros(0, np.int64)], [np.zeros((0, len(model.domains)))]
        for x, words in _feature_chunks(texts, len(model.weights) - 1):
            tokens.append(words)
            found.append(model.posterior(x))
        give_back()
        flat = np.concatenate(found).astype(np.float64)
        bounds = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1])
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(tokens)), pa.ListArray.from_arrays(bounds, pa.array(flat.ravel()))], ["n_tokens", "posterior"])

    return predict(text.cast("string"))


@dataclass(frozen=True)
class Descent:
    """The steps of an accelerated projected gradient: what is needed to find the rate of any posterior."""

    metric: np.ndarray  # domains x domains: what a residual weighs
    stay: float  # weight of staying at rate one
    target: np.ndarray
    sums: tuple[np.ndarray, ...]  # expected shares per domain at the rates of each step so far

    def rates(self, posterior: np.ndarray) -> np.ndarray:
        """Rates after as many steps as there are sums."""
        before = now = np.ones(len(posterior))
        for n in range(len(self.sums)):
            push = n / (n + 3)
            ahead = now + push * (now - before)
            mass = self.sums[n] + push * (self.sums[n] - self.sums[max(n - 1, 0)])
            pull = posterior @ (self.metric @ (mass - self.target)) + self.stay * (ahead - 1)
            before, now = now, np.maximum(0, ahead - pull / (1 + self.stay))
        return now


def fit_rates(members: DataFrame, domains: tuple[str, ...], targets: dict[str, float], budget: float | None = None,
              stay: float = 1e-4, most_steps: int = 200, tolerance: float = 1e-3) -> Descent:
    """Fit rates for rows (n_tokens, posterior), which should be a written table.

    ``targets`` are weights per domain (their sum does not matter; domains not named get none). ``budget`` is the number of
    tokens to reach; by default as many as there are.

    Residuals are measured in the inverse of the matrix of posteriors, so a domain of few tokens is fitted as fast, and as well
    for its own size, as a large one. Stops when each expected share is within ``tolerance`` of its target (relative to it), or, where
    no rates reach the targets, when the shares move by less than a hundredth of that from step to step.
    """
    weights = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    if weights.sum() == 0:
        weights[:] = 1
    k = len(domains)

    def sums(descent: Descent | None) -> tuple[np.ndarray, float]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, tokens_seen = np.zeros(k * k if descent is None else k), 0.0
            for batch in batches:
                tokens = batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)
                p = batch.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                tokens_seen += tokens.sum()
                out += ((p.T * tokens) @ p).ravel() if descent is None else (tokens * descent.rates(p)) @ p
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(out) + 1)), pa.array(np.r_[out, tokens_seen])], ["i", "v"])

        rows = members.select("n_tokens", "posterior").mapInArrow(lean(add), "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        found = np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])] or [0.0] * ((k * k if descent is None else k) + 1))
        return found[:-1], found[-1]

    gram, total = sums(None)
    total = total or 1.0
    gram = gram.reshape(k, k) / total
    metric = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)
    target = weights / weights.sum() * (1.0 if budget is None else budget / total)
    size = np.maximum(target, 1e-6)
    descent = Descent(metric, stay, target, ())
    for _ in range(most_steps):
        mass, _ = sums(descent)
        mass = mass / total
        reached = (np.abs(mass - target) <= tolerance * size).all()
        still = len(descent.sums) > 1 and max(np.abs(mass - descent.sums[-1]).max(), np.abs(mass - descent.sums[-2]).max()) < 1e-2 * tolerance * size.max()
        if reached or still:
            break
        descent = Descent(metric, stay, target, (*descent.sums, mass))
    return descent


def expected_totals(rated: DataFrame, domains: tuple[str, ...], targets: dict[str, float], budget: float | None = None) -> DataFrame:
    """What the rates of ``mix_rates`` give: (domain, target_tokens, expected_tokens, tokens), one row per domain."""
    share = F.posexplode("posterior").alias("place", "share")
    found = rated.select("n_tokens", "rate", share).groupBy("place").agg(
        F.sum(F.col("n_tokens") * F.col("share")).alias("tokens"), F.sum(F.col("n_tokens") * F.col("share") * F.col("rate")).alias("expected_tokens"))
    weights = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    weights = np.ones(len(domains)) if weights.sum() == 0 else weights
    names = rated.sparkSession.createDataFrame([(i, d, float(w / weights.sum())) for i, (d, w) in enumerate(zip(domains, weights))], "place int, domain string, weight double")
    total = F.lit(float(budget)) if budget is not None else F.sum("tokens").over(Window.partitionBy())
    joined = F.broadcast(names).join(found, "place", "left").na.fill(0.0, ["tokens", "expected_tokens"])
    return joined.select("domain", (F.col("weight") * total).alias("target_tokens"), "expected_tokens", "tokens")


def rate_of(posterior: Column, descent: Descent) -> Column:
    @F.arrow_udf("double")
    def rate(p: pa.Array) -> pa.Array:
        k = len(descent.target)
        return pa.array(descent.rates(p.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)))

    return rate(posterior)


def domain_model(docs: DataFrame, labels: DataFrame, per_domain: int = PER_DOMAIN) -> DomainModel:
    """A classifier of the domains that the labels name: toxic, high or low (quality). Null labels teach nothing.

    Of each domain about ``per_domain`` labels are taken, by a hash of the identifier, before they meet the documents; so few
    rows are broadcast, and no text is shuffled. Labels that repeat count once.
    """
    named = labels.select(F.col("doc_id").cast("bigint").alias("label_id"), F.when(F.col("toxic") == 1, "toxic").when(
        F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("domain")).where(
        "domain IS NOT NULL AND label_id IS NOT NULL").distinct()
    sizes = {r["domain"]: r["n"] for r in named.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if sizes:
        share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_domain / n))])
        named = named.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < share[F.col("domain")] * (1 << 30))
    found = docs.select(F.col("doc_id").cast("bigint").alias("label_id"), "text").join(F.broadcast(named), "label_id")
    return learn_domains(found.select("text", "domain"), per_domain=per_domain, sizes=sizes)


TARGETS = {"high": 0.90, "low": 0.08, "toxic": 0.02}


def mix_rates(docs: DataFrame, model: DomainModel, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
              budget: float | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row its identifier, ``n_tokens``, ``posterior`` (array in the order of the model's domains), ``rate`` and ``copies``.

    ``copies`` is the rate rounded down, or up by one with the probability of the fraction, drawn by a hash of identifier
    and text: rows that repeat both get the same. Null and empty texts have no tokens and the prior's posterior; they weigh
    nothing and get a rate like any other. Other columns are carried only if named. Empty in, empty out.
    """
    key = free_name([*docs.columns, "n_tokens", "posterior", "rate", "copies"], "row_hash")
    member = free_name(docs.columns, "member")
    found = docs.select(*dict.fromkeys([id_col, *carry]), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias(key),
                        memberships(F.col(text_col), model).alias(member))
    found = found.select(*dict.fromkeys([id_col, *carry]), key, F.col(f"{member}.n_tokens").alias("n_tokens"), F.col(f"{member}.posterior").alias("posterior"))
    found = cut_lineage(found)
    descent = fit_rates(found, model.domains, targets, budget)
    rated = found.withColumn("rate", rate_of(F.col("posterior"), descent))
    draw = F.pmod(F.col(key), F.lit(1 << 30)) / (1 << 30)
    copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("bigint")
    return rated.withColumn("copies", copies.cast("bigint")).drop(key)


def mix_documents(docs: DataFrame, model: DomainModel, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
                  budget: float | None = None) -> DataFrame:
    """The documents, each as often as its ``copies`` say, with their columns."""
    times = free_name(docs.columns, "times")
    found = cut_lineage(docs.select(memberships(F.col(text_col), model).alias("m")).select("m.n_tokens", "m.posterior"))
    descent = fit_rates(found, model.domains, targets, budget)

    @F.arrow_udf("double")
    def rate(texts: pa.Array) -> pa.Array:
        found = [descent.rates(model.posterior(x).astype(np.float64)) for x, _ in _feature_chunks(texts, len(model.weights) - 1)]
        give_back()
        return pa.array(np.concatenate([np.zeros(0), *found]))

    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")), F.lit(1 << 30)) / (1 << 30)
    rated = docs.withColumn(times, rate(F.col(text_col).cast("string")))
    count = (F.floor(times) + (draw < F.col(times) - F.floor(times)).cast("bigint")).cast("int")
    return rated.where(count > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), count)).alias(times)).select(*docs.columns)
