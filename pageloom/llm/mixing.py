"""Mixing domains to target weights by soft membership.

A labelled table teaches a classifier the domains: multinomial naive Bayes over
hashed words, counted over all labelled texts.  It gives every document a posterior
over the domains, so a document may belong to several.  Then each document gets a
rate, the number of times it is expected to be used, such that the domains' token
totals meet their targets: nonnegative least squares on

    sum over domains d of (sum_i n_i p_id r_i - T_d)^2 / N_d

with ``n_i`` the tokens of document i, ``p_id`` its posteriors and ``N_d`` the
natural total of the domain.  In the variables sqrt(n_i) r_i the largest curvature
is at most 1, so projected gradient steps of full length go

    r_i <- max(least, r_i - sum_d p_id (S_d - T_d) / N_d).

A step needs only the domains' present totals ``S_d``: one sum over a narrow table.
A document's rate follows from the list of steps; it is stored whenever these hold
``STORED`` numbers, so that the expression stays short.  ``copies`` rounds a rate up or down by a hash of the
document, which keeps expected totals.

DataFrame operations only.

Size.  Words are counted in the task that reads them; a document's sums and a
bucket's counts are what is shuffled.  The table of log likelihoods has ``BUCKETS``
rows and a column per domain, however many there are: its size is known beforehand, it
is broadcast up to ``WIDE`` domains and joined by bucket beyond.  The driver sees a
number per domain and step.

Cases.  Tokens are the runs between blanks that are not empty; a null or empty text
has none and the prior as posterior.  Without labelled rows there is one domain
``all``.  Rows are rated one by one, equal rows alike.  An empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pageloom.llm.common import empty_as, if_small, read, stored

BUCKETS, SMOOTHING = 1 << 13, 1.0
#: Domains whose likelihoods are broadcast (8 bytes for each and bucket).
WIDE = 512
#: Targets are natural totals to this power, so rare domains are used more, and
#: domains of poor texts are worth this share of others.
POWER, POOR = 0.7, 0.25
#: Steps at most, and the largest relative miss of a target that ends them.
STEPS, STORED, CLOSE = 60, 120, 1e-3


def _words(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep``, ``bucket`` and ``token`` (1, or 0 for what is empty) of each word."""
    split = docs.select(*keep, F.explode(F.split(empty_as(), " ", -1)).alias("word"))
    return split.select(
        *keep, F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int").alias("bucket"),
        (F.col("word") != "").cast("bigint").alias("token"),
    )


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(domain, text)`` of the documents that ``labels`` covers: their language
    and whether they were marked good."""
    marks = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"))
    marks = if_small(stored(marks, "marks"))  # else the labelled texts are moved
    known = docs.where("lang IS NOT NULL").select("doc_id", "lang", "text").join(marks, "doc_id")
    name = F.concat("lang", F.when(F.col("q") > 0, "/good").otherwise("/poor"))
    return known.select(name.alias("domain"), "text")


class Classifier:
    """Domains, log priors and the stored table of log likelihoods."""

    def __init__(self, domains: list[str], priors: list[float], table: DataFrame | None):
        self.domains, self.priors, self.table = domains, priors, table


def learn(rows: DataFrame) -> Classifier:
    """From ``(domain, text)``: counts of hashed words over all rows."""
    counts = _words(rows, "domain").groupBy("domain", "bucket").agg(F.sum("token").alias("n"))
    counts = stored(counts, "counts")
    totals = sorted((r[0], r[1]) for r in counts.groupBy("domain").agg(F.sum("n")).collect())
    if not totals:
        return Classifier(["all"], [0.0], None)
    every = sum(t for _, t in totals) + len(totals)
    columns = []
    for i, (name, total) in enumerate(totals):
        n = F.coalesce(F.sum(F.when(F.col("domain") == name, F.col("n"))), F.lit(0))
        share = (n + SMOOTHING) / (total + SMOOTHING * BUCKETS)
        columns.append(F.log(share).alias(f"l{i}"))
    buckets = rows.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    table = buckets.join(counts, "bucket", "left").groupBy("bucket").agg(*columns)
    return Classifier(
        [name for name, _ in totals], [math.log((t + 1) / every) for _, t in totals],
        stored(table, "likelihoods"),
    )


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """``(doc_id, text_key, tokens, p0, p1, ...)`` of each row.

    The log likelihood is divided by the root of the number of tokens: words of a
    text are not independent, and memberships shall be soft.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.xxhash64(empty_as()).alias("text_key"), "text",
    )
    words = _words(rows, "row", "doc_id", "text_key")
    d = range(len(model.domains))
    if model.table is not None:
        table = F.broadcast(model.table) if len(d) <= WIDE else model.table  # BUCKETS rows
        words = words.join(table, "bucket")
    sums = [
        F.sum(F.col("token") * (F.col(f"l{i}") if model.table is not None else F.lit(0.0)))
        for i in d
    ]
    scored = words.groupBy("row", "doc_id", "text_key").agg(
        F.sum("token").alias("tokens"), *[s.alias(f"s{i}") for i, s in enumerate(sums)]
    )
    root = F.sqrt(F.greatest(F.col("tokens"), F.lit(1)))
    logs = [model.priors[i] + F.col(f"s{i}") / root for i in d]
    scored = scored.select(
        "doc_id", "text_key", "tokens", *[x.alias(f"g{i}") for i, x in enumerate(logs)]
    )
    top = F.greatest(*[F.col(f"g{i}") for i in d]) if len(d) > 1 else F.col("g0")
    scored = scored.select("*", top.alias("top")).select(
        "doc_id", "text_key", "tokens", *[F.exp(F.col(f"g{i}") - F.col("top")).alias(f"e{i}") for i in d]
    )
    total = added([F.col(f"e{i}") for i in d])
    return scored.select("*", total.alias("total")).select(
        "doc_id", "text_key", "tokens", *[(F.col(f"e{i}") / F.col("total")).alias(f"p{i}") for i in d]
    )


def added(terms: list[Column]) -> Column:
    """The sum of any number of terms, as a flat tree: a chain of hundreds is too deep."""
    while len(terms) > 1:
        terms = [sum(terms[i + 1 : i + 8], terms[i]) for i in range(0, len(terms), 8)]
    return terms[0]


def rate(steps: list[list[float]], least: float) -> Column:
    """``rate`` after further steps (a number per domain each)."""
    r = F.col("rate")
    for step in steps:
        move = added([F.col(f"p{i}") * s for i, s in enumerate(step)])
        r = F.greatest(F.lit(float(least)), r - move)
    return r


def totals(members: DataFrame, n: int, r: Column) -> list[float]:
    used = members.withColumn("used", F.col("tokens") * r)
    sums = [F.sum(F.col(f"p{i}") * F.col("used")) for i in range(n)]
    return [float(x or 0) for x in used.agg(*sums).first()]


def by_power(natural: dict[str, float], power: float = POWER) -> dict[str, float]:
    """Targets of the same total in which rare domains weigh more, poor ones less."""
    weights = {d: n**power * (POOR if d.endswith("/poor") else 1) for d, n in natural.items()}
    share = sum(natural.values()) / (sum(weights.values()) or 1)
    return {d: w * share for d, w in weights.items()}


def at_least_natural(natural: dict[str, float], power: float = POWER) -> dict[str, float]:
    """Targets in the same proportions, enlarged until no good domain loses."""
    wanted = by_power(natural, power)
    grow = max([1.0, *(n / wanted[d] for d, n in natural.items()
                       if wanted[d] > 0 and not d.endswith("/poor"))])
    return {d: max(n, wanted[d] * grow) if not d.endswith("/poor") else n
            for d, n in natural.items()}


def solve(members: DataFrame, domains: list[str], targets: dict[str, float] | None = None,
          least: float = 0.0, choose=by_power) -> DataFrame:
    """``members`` with ``rate``; ``choose`` makes targets of natural totals."""
    members = members.withColumn("rate", F.lit(1.0))
    natural = now = totals(members, len(domains), F.col("rate"))
    wanted = targets or choose(dict(zip(domains, natural, strict=True)))
    wanted = [wanted[d] for d in domains]
    steps: list[list[float]] = []
    for _ in range(STEPS):
        miss = [abs(s - t) / t if t > 0 else 0.0 for s, t in zip(now, wanted, strict=True)]
        if max(miss) <= CLOSE:
            break
        if steps and (len(steps) + 1) * len(domains) > STORED:
            members = stored(members.withColumn("rate", rate(steps, least)), "rates")
            steps = []
        steps.append([
            (s - t) / n if n > 0 else 0.0
            for s, t, n in zip(now, wanted, natural, strict=True)
        ])
        before, now = now, totals(members, len(domains), rate(steps, least))
        if all(abs(a - b) <= CLOSE / 10 * max(a, b) for a, b in zip(before, now, strict=True)):
            break  # the bounds leave little to gain
    return members.withColumn("rate", rate(steps, least))


def rated(docs: DataFrame, rows: DataFrame, least: float = 0.0, choose=by_power,
          targets: dict[str, float] | None = None) -> DataFrame:
    """``doc_id, text_key, tokens, domain, posterior, rate, copies`` of each row of
    ``docs``; ``rows`` is the labelled ``(domain, text)``.  ``domain`` is the likeliest."""
    model = learn(rows)
    members = stored(memberships(docs, model), "members")
    members = solve(members, model.domains, targets, least, choose)
    d = range(len(model.domains))
    best = F.array_max(F.array(*[F.struct(F.col(f"p{i}").alias("p"), F.lit(-i).alias("at")) for i in d]))
    names = F.array(*[F.lit(x) for x in model.domains])
    drawn = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(1 << 30)) / (1 << 30)
    return members.withColumn("best", best).select(
        "doc_id", "text_key", "tokens", F.get(names, -F.col("best.at")).alias("domain"),
        F.col("best.p").alias("posterior"), "rate",
        F.floor(F.col("rate") + drawn).cast("bigint").alias("copies"),
    )


def mixed(docs: DataFrame, rows: DataFrame, least: float = 0.0, choose=by_power) -> DataFrame:
    """``docs`` with each row as often as its rate says."""
    rates = rated(docs, rows, least, choose).groupBy("doc_id", "text_key").agg(
        F.max("copies").alias("_llm_copies")
    )
    same = docs["doc_id"].eqNullSafe(rates["doc_id"])
    same &= F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == rates["text_key"]
    times = F.expr("explode(array_repeat(0, CAST(_llm_copies AS INT)))")
    return docs.join(rates, same).select(*[docs[c] for c in docs.columns], times).drop("col")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain, posterior, rate and copies of every document."""
    docs = read(spark, sf_dir)
    return rated(docs, labelled(docs, read(spark, sf_dir, "labels"))).drop("text_key")
