"""Problem 9: mixing sources to target weights by raking.

The tokens of the eligible documents are summed by cell (source, language, topic); the
cells are as many as the margins allow, not as the documents. Iterative proportional
fitting scales the cells to the targets of each margin in turn. The last step is always on
sources: a source's cells are scaled to its share of all tokens, none beyond the cap of its
repeats, and what is left of the target when all cells have met the cap is the source's
shortage. A cell's weight over its tokens is the expected number of copies of its documents;
a document is taken that many times, the fraction decided by a hash of its key.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 50
TOLERANCE = 1e-6
#: A source is short if its fit lacks more than this part of its target (rounding of sums).
SHORTAGE = 1e-12
#: Cells that may be fitted in the driver.
MAX_CELLS = 1_000_000


def _fill(cells: dict, tokens: dict, limit: int, goal: float) -> tuple[dict, float]:
    """Scale cells to a sum of ``goal``, none beyond ``limit`` times its tokens; with what is left of ``goal``."""
    out, open_, left = {}, dict(cells), goal
    while open_:
        total = sum(open_.values())
        if total <= 0:
            total = sum(tokens[c] for c in open_)
            open_ = {c: tokens[c] for c in open_}
        scale = left / total if total else 0.0
        full = [c for c, w in open_.items() if w * scale > limit * tokens[c] * (1 + 1e-12)]
        if not full:
            return out | {c: w * scale for c, w in open_.items()}, 0.0
        for c in full:
            out[c] = float(limit * tokens[c])
            left -= out[c]
            del open_[c]
        left = max(left, 0.0)
    return out, left


def rake(
    tokens: dict[tuple[str, str, str], int],
    goals: dict[str, float],
    limits: dict[str, int],
    margins: dict[int, dict[str, float]],
    rounds: int = ROUNDS,
) -> tuple[dict[tuple[str, str, str], float], dict[str, float]]:
    """Weights of cells ``(source, language, topic)``, and by source what the fit falls short of its goal.

    ``goals`` are tokens by source, ``margins[k]`` shares by value of the cell's k-th key.
    A source without tokens is short of its whole goal.
    """
    weight = {c: float(n) for c, n in tokens.items() if n > 0}
    by_source = defaultdict(list)
    for c in weight:
        by_source[c[0]].append(c)
    total = sum(min(goals[s], limits[s] * sum(tokens[c] for c in cs)) for s, cs in by_source.items())
    short = {s: goal for s, goal in goals.items() if s not in by_source}
    for _ in range(rounds):
        before = dict(weight)
        for k, shares in margins.items():
            sums = defaultdict(float)
            for c, w in weight.items():
                sums[c[k]] += w
            known = sum(shares.get(v, 0.0) for v in sums) or 1.0
            weight = {c: w * (shares.get(c[k], 0.0) / known * total / sums[c[k]] if sums[c[k]] else 0.0) for c, w in weight.items()}
        for s, cs in by_source.items():
            fitted, short[s] = _fill({c: weight[c] for c in cs}, tokens, limits[s], goals[s])
            weight |= fitted
        if all(abs(weight[c] - before[c]) <= TOLERANCE * max(1.0, before[c]) for c in weight):
            break
    return weight, short


def mix(
    documents: DataFrame,
    targets: DataFrame,
    key: str,
    source: str,
    size: str,
    language: str | None = None,
    topic: str | None = None,
    seed: int = 0,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, DataFrame]:
    """Copies of documents by source, and the report of shares.

    ``documents`` has a unique key, a source, a size and, if named, a language and a topic
    (null is a value of its own); ``targets`` has ``source, target_share, max_repeats``.
    Sources are compared trimmed and lower-cased; a null source belongs to none, documents
    of sources without target count for the total only. Rows of one source in ``targets``
    are added (shares) and the largest repeats hold; null shares count as 0, null repeats
    as 1. The natural shares of language and topic, over the documents of the mixed
    sources, are kept as far as the sources allow.

    Returns ``(key, source, copies)`` with ``1 <= copies <= max_repeats`` and, for each
    target, ``(source, target_share, max_repeats, total_tokens, available_tokens,
    target_tokens, short, mixed_tokens, actual_share)``; ``short`` says that the fitted cells of
    the source all meet the cap of its repeats and do not reach its target, ``actual_share`` is of the tokens of the mix (null if it is empty).
    """
    spark = documents.sparkSession
    name = F.lower(F.trim(F.col(source)))
    marked = documents.select(
        F.col(key).alias("key"),
        name.alias("source"),
        F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n"),
        *[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")).alias(a) for c, a in ((language, "language"), (topic, "topic"))],
    )
    goals = targets.groupBy(F.lower(F.trim("source")).alias("source")).agg(
        F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"),
        F.max(F.coalesce("max_repeats", F.lit(1))).cast("long").alias("max_repeats"),
    )
    wanted = {r.source: r for r in goals.where(F.col("source").isNotNull()).collect()}
    cells = marked.groupBy(F.when(F.col("source").isin(list(wanted)), F.col("source")).alias("source"), *[F.when(F.col("source").isin(list(wanted)), F.col(c)).alias(c) for c in ("language", "topic")]).agg(F.sum("n").alias("n"))
    found = cells.limit(MAX_CELLS + 1).collect()
    if len(found) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of source, language and topic; use coarser margins")
    total = sum(r.n for r in found)
    tokens = {(r.source, r.language, r.topic): r.n for r in found if r.source is not None}
    all_mixed = sum(tokens.values()) or 1
    margins: dict[int, dict[str, float]] = {}
    for k in (1, 2):
        shares: dict[str, float] = defaultdict(float)
        for c, n in tokens.items():
            shares[c[k]] += n / all_mixed
        margins[k] = dict(shares)
    weight, short = rake(tokens, {s: r.target_share * total for s, r in wanted.items()}, {s: r.max_repeats for s, r in wanted.items()}, margins, rounds)
    rates = spark.createDataFrame(
        [(*c, w / tokens[c], wanted[c[0]].max_repeats) for c, w in weight.items() if w > 0],
        "source string, language string, topic string, rate double, most long",
    )
    luck = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # a few thousand cells at most: one row a combination of margins
    drawn = marked.join(F.broadcast(rates) if len(weight) <= 10_000 else rates, ["source", "language", "topic"])
    copies = F.least(F.col("most"), F.floor("rate") + F.when(luck < F.col("rate") - F.floor("rate"), 1).otherwise(0))
    sample = drawn.withColumn("copies", copies.cast("int")).where(F.col("copies") > 0)
    taken = sample.groupBy("source").agg(F.sum(F.col("n") * F.col("copies")).alias("mixed_tokens"))
    available = defaultdict(int)
    for c, n in tokens.items():
        available[c[0]] += n
    plan = spark.createDataFrame(
        [(s, float(r.target_share), int(r.max_repeats), int(total), int(available[s]), float(r.target_share * total), bool(short[s] > SHORTAGE * r.target_share * total)) for s, r in wanted.items()],
        "source string, target_share double, max_repeats long, total_tokens long, available_tokens long, target_tokens double, short boolean",
    )
    report = plan.join(taken, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    whole = report.agg(F.sum("mixed_tokens").alias("whole"))
    report = report.crossJoin(F.broadcast(whole)).withColumn("actual_share", F.try_divide("mixed_tokens", "whole")).drop("whole")
    return sample.select(F.col("key").alias(key), "source", "copies"), report
