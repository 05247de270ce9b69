"""Mixing documents to target weights by soft domain membership, with SQL functions only.

A naive Bayes classifier over hashed words, counted on a bounded sample of labelled documents
(``max_rows``, default 4000), gives every document a posterior p over the domains; its evidence
is tempered to ``evidence`` words, so membership stays soft. A document of n tokens read at rate r
adds r * n * p_k expected tokens to domain k. Rates are found by projected-gradient least squares:
every round sums the expected totals over all documents, and each document moves its rate along
its own posterior and back to ``least`` (zero by default) if it falls below. The step's weights by domain are
the gaps, scaled by the domains' overlap over the documents that can move, so few rounds are needed.
A rate is a function of the posterior, rounded to steps of 1/``GRID``, and of the rounds' steps. So the documents are summed
once by rounded posterior, with their exact expected tokens, and the rounds run over those sums.

Targets are shares by domain, at the scale at which the richest domain is read once; a domain
without a target keeps its natural share, and without any targets they are tempered shares,
total_k ** ``temper``. ``solve`` ends when every total is within ``TOLERANCE`` of its target, when a
round no longer brings them nearer, or after ``rounds``; its report, and the columns target,
reached and met of ``rates``, say how far it came. A rate becomes copies: its whole part, and one more
with the rest as probability, drawn by a hash.

Defined edge cases: null and empty texts have no tokens, the prior as posterior and a rate like
others; labels of unknown documents and null domains teach nothing, a repeated document teaches
once; without labelled documents there is one domain; repeated rows get equal rates; a domain
without tokens cannot be met and is left out; extra columns stay, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_TEXT, materialise, release

BUCKETS = 4096
MAX_ROWS = 4000
EVIDENCE = 16.0
TEMPER = 0.7
ROUNDS = 24
TOLERANCE = 1e-3
#: Steps of a posterior in one.
GRID = 256


def buckets(text: Column) -> Column:
    """The hashed words of a text."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def literal(values) -> Column:
    """A constant array of doubles; the optimiser folds it into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<double>")


def let(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def classifier(docs: DataFrame, labelled: DataFrame, max_rows: int = MAX_ROWS, smoothing: float = 0.5) -> tuple[list[str], list[float], list[list[float]]]:
    """Domains, their log priors, and the log-probability of each bucket under each domain.

    ``labelled`` has doc_id and domain; of repeated labels the smallest domain counts. Texts over
    64 KiB are not learned from, so ``max_rows`` bounds the bytes too.
    """
    picked = (
        labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= MAX_TEXT)
    sample = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text"))
    sample = materialise(sample.select("domain", "text"), "sample")
    counts = sample.select("domain", F.explode(buckets(F.col("text"))).alias("bucket")).groupBy("domain", "bucket").count().collect()
    sizes = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    release(sample)
    domains = sorted({r["domain"] for r in counts})
    if not domains:
        return ["all"], [0.0], [[0.0] * BUCKETS]
    table = {d: [smoothing] * BUCKETS for d in domains}
    for r in counts:
        table[r["domain"]][r["bucket"]] += r["count"]
    rows = []
    for d in domains:
        total = sum(table[d])
        rows.append([round(math.log(x / total), 4) for x in table[d]])
    every = sum(sizes[d] for d in domains)
    return domains, [math.log(sizes[d] / every) for d in domains], rows


def membership(text: Column, priors: list[float], rows: list[list[float]], evidence: float = EVIDENCE) -> Column:
    """struct<n, p>: the number of tokens of a text and its posterior over the domains."""

    def mean(b, prior, row):
        total = F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(row, x))
        return F.lit(prior) + F.lit(evidence) * total / F.greatest(F.size(b), F.lit(1))

    def softmax(logs):
        exps = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
        return let(exps, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))

    constants = [literal(row) for row in rows]
    return let(
        buckets(F.coalesce(text, F.lit(""))),
        lambda b: F.struct(F.size(b).cast("long").alias("n"), let(F.array(*[mean(b, prior, row) for prior, row in zip(priors, constants)]), softmax).alias("p")),
    )


def rounded(p: Column) -> Column:
    """A posterior in steps of 1/``GRID``."""
    return F.transform(p, lambda x: F.rint(x * GRID).cast("int"))


def rate(q: Column, gradients: list[list[float]], least: float = 0.0) -> Column:
    """The rate of a document with rounded posterior q: from 1, a step along it for each round, projected to ``least`` and more."""
    r = F.lit(1.0)
    for g in gradients:
        step = sum((F.get(q, F.lit(k)) * F.lit(x / GRID) for k, x in enumerate(g) if x), F.lit(0.0))
        r = F.greatest(F.lit(least), r - step)
    return r


def sums(members: DataFrame, domains: list[str]) -> DataFrame:
    """Expected tokens t of each domain by rounded posterior q; ``members`` has n and p."""
    tokens = [F.sum(F.col("n") * F.get("p", F.lit(i))) for i in range(len(domains))]
    return members.where("n > 0").groupBy(rounded(F.col("p")).alias("q")).agg(F.array(*tokens).alias("t"))


def scaled(overlap: list[list[float]], gap: list[float]) -> list[float]:
    """The step whose effect on the totals is ``gap``: overlap * step = gap, by elimination; domains without overlap stay."""
    n = len(gap)
    rows = [[*overlap[i], gap[i]] for i in range(n)]
    floor = 1e-9 * max([abs(x) for row in overlap for x in row] + [1e-300])
    held = []
    for i in range(n):
        pivot = max(range(len(held), n), key=lambda r: abs(rows[r][i]), default=None)
        if pivot is None or abs(rows[pivot][i]) <= floor:
            continue
        at = len(held)
        rows[at], rows[pivot] = rows[pivot], rows[at]
        for r in range(n):
            if r != at and rows[r][i]:
                f = rows[r][i] / rows[at][i]
                rows[r] = [x - f * y for x, y in zip(rows[r], rows[at])]
        held.append(i)
    step = [0.0] * n
    for at, i in enumerate(held):
        step[i] = rows[at][n] / rows[at][i]
    return step


def solve(by_q: DataFrame, domains: list[str], targets: dict[str, float] | None = None, temper: float = TEMPER, rounds: int = ROUNDS, least: float = 0.0) -> tuple[list[list[float]], dict]:
    """Steps of all rounds, and a report: natural, target and reached totals, and whether all targets are met."""
    k = range(len(domains))

    def totals(steps: list[list[float]]) -> tuple[list[float], list[list[float]]]:
        """Expected totals after the steps, and the overlap of the domains over documents above ``least`` (all, before the first step)."""
        r = rate(F.col("q"), steps, least)
        moves = F.lit(1.0) if not steps else F.when(r > least, 1.0).otherwise(0.0)
        t = lambda i: F.get("t", F.lit(i))
        row = by_q.select("q", "t", r.alias("r"), moves.alias("m")).agg(*[F.sum(F.col("r") * t(i)) for i in k], *[F.sum(F.col("m") * t(i) * F.get("q", F.lit(j)) / GRID) for i in k for j in k]).first()
        flat = [x or 0.0 for x in row]
        return flat[: len(domains)], [flat[len(domains) * (i + 1) : len(domains) * (i + 2)] for i in k]

    natural, overlap = totals([])
    known = [i for i in k if natural[i] > 0]
    if not known:
        return [], {"natural": natural, "target": natural, "reached": natural, "met": True}
    every = sum(natural)
    wanted = lambda i: targets.get(domains[i], natural[i] / every) if targets else natural[i] ** temper
    weight = [wanted(i) if i in known else 0.0 for i in k]
    paid = [i for i in known if weight[i] > 0]
    if not paid:
        return [], {"natural": natural, "target": [0.0] * len(domains), "reached": natural, "met": False}
    scale = max(natural[i] / weight[i] for i in paid)
    target = [scale * w for w in weight]
    apart = lambda now: max(abs(now[i] - target[i]) / max(target[i], TOLERANCE * sum(target)) for i in known)
    far = lambda now: sum((now[i] - target[i]) ** 2 for i in known)
    steps: list[list[float]] = []
    reached, size = natural, 1.0
    for _ in range(rounds):
        if apart(reached) < TOLERANCE or size < 0.01:
            break
        step = scaled(overlap, [(reached[i] - target[i]) * size if i in known else 0.0 for i in k])
        now, more = totals([*steps, step])
        if far(now) < far(reached):
            steps, reached, overlap, size = [*steps, step], now, more, 1.0
        else:
            size /= 4
    return steps, {"natural": natural, "target": target, "reached": reached, "met": apart(reached) < TOLERANCE}


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, keep: list[str] | None = None, max_rows: int = MAX_ROWS, temper: float = TEMPER, least: float = 0.0, seed: int = 17) -> tuple[DataFrame, dict]:
    """row (a struct of the ``keep`` columns, all by default), doc_id, domain, p, n, rate and copies of every document, and the report of ``solve`` with the domains.

    Membership is computed once, over one pass of the texts, and stored.
    """
    domains, priors, rows = classifier(docs, labelled, max_rows)
    own = membership(F.col("text").cast("string"), priors, rows)
    row = F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)])
    members = materialise(docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), own.alias("m")).select("row", "doc_id", "m.n", "m.p"), "members")
    by_q = materialise(sums(members, domains), "sums")
    gradients, report = solve(by_q, domains, targets, temper, least=least)
    release(by_q)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    d = members.withColumn("rate", rate(rounded(F.col("p")), gradients, least))
    return d.select(
        "row", "doc_id", F.element_at(F.array(*map(F.lit, domains)), F.array_position("p", F.array_max("p")).cast("int")).alias("domain"), "p", "n", "rate",
        (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int").alias("copies"),
    ), report | {"domains": domains}


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, **options) -> DataFrame:
    """doc_id, domain, posterior of that domain, n_tokens, rate and copies of every document; target and reached tokens of its domain, and met: all targets are."""
    d, report = mix(docs, labelled, targets, keep=["doc_id"], **options)
    place = F.array_position(F.array(*map(F.lit, report["domains"])), F.col("domain")).cast("int") - 1
    return d.select(
        "doc_id", "domain", F.array_max("p").alias("posterior"), F.col("n").alias("n_tokens"), "rate", "copies",
        F.get(literal(report["target"]), place).alias("target"), F.get(literal(report["reached"]), place).alias("reached"), F.lit(report["met"]).alias("met"),
    )


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, **options) -> DataFrame:
    """Every document as many times as its copies say, with the columns of ``docs``."""
    d, _ = mix(docs, labelled, targets, **options)
    return d.where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
