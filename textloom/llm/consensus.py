"""Problem 4: consensus of several annotators by confidence-aware truth discovery.

Labels and annotator weights are found in turn. An item takes the label with the least
weighted distance to its votes. Every annotator's error is then estimated from the distances
between their votes and the labels, and of that error the chi-squared upper confidence bound
counts: the weight is ``chi2(alpha / 2, n) / sum of distances``, so someone with few votes
gets little weight even if these agree by luck.

The distance of a vote is taken to the label that the other votes of its item give (equal
ones: their mean distance). Taken to a label that the vote itself decides, one annotator
soon confirms themselves, gets all the weight and dictates every label.

``weights="log_odds"`` is another form for labels on which annotators err to one side: the
weight is the log-odds of the bounded error, distances are to the consensus as a distribution
over labels (softmax of the weighted votes), and votes below and above it have a distance each.

Items with the same set of votes have the same consensus, so votes are first grouped to
signatures with their number of items; the rounds run over these. Few signatures are held by
the driver, many by Spark; both take the same steps and break ties alike.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

ALPHA = 0.05
#: Votes of an item that are gathered into one row.
ITEM_VOTES = 1000
ROUNDS = 80
TOLERANCE = 1e-4
#: Cells of signature votes and possible labels that the driver may hold; beyond it the rounds are Spark jobs.
DRIVER_CELLS = 1_000_000
#: Labels of a scale.
MAX_LABELS = 1000


def chi2_lower(n: float, alpha: float = ALPHA) -> float:
    """Quantile alpha/2 of the chi-squared distribution (Wilson-Hilferty)."""
    if n <= 0:
        return 0.0
    z = _normal_quantile(alpha / 2)
    return max(0.0, n * (1 - 2 / (9 * n) + z * math.sqrt(2 / (9 * n))) ** 3)


def _normal_quantile(p: float) -> float:
    lo, hi = -10.0, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        if 0.5 * math.erfc(-mid / math.sqrt(2)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def bound_weight(votes, distance, alpha: float = ALPHA):
    """``chi2(alpha / 2, votes) / distance``; half a vote is added to the distance."""
    return np.vectorize(chi2_lower)(votes, alpha) / (np.asarray(distance, dtype=float) + 0.5)


def log_odds_weight(votes, distance, labels: int, alpha: float = ALPHA):
    """Log-odds of an annotator being right, by the upper bound of their error."""
    others = max(1, labels - 1)
    error = np.minimum(1 / np.maximum(bound_weight(votes, distance, alpha), 1e-9), others / (others + 1))
    return np.maximum(np.log((1 - error) * others / error), 1e-6)


def _bound_weight_column(votes: Column, distance: Column, alpha: float) -> Column:
    z = _normal_quantile(alpha / 2)
    n = F.greatest(votes.cast("double"), F.lit(1e-9))
    lower = F.greatest(F.lit(0.0), n * F.pow(1 - F.lit(2 / 9) / n + F.lit(z) * F.sqrt(F.lit(2 / 9) / n), F.lit(3.0)))
    return F.when(votes > 0, lower).otherwise(0.0) / (distance + 0.5)


def _log_odds_column(votes: Column, distance: Column, labels: int, alpha: float) -> Column:
    others = max(1, labels - 1)
    error = F.least(1 / F.greatest(_bound_weight_column(votes, distance, alpha), F.lit(1e-9)), F.lit(others / (others + 1)))
    return F.greatest(F.log((1 - error) * others / error), F.lit(1e-6))


def truth_discovery(
    votes: DataFrame,
    item: str = "item",
    annotator: str = "annotator",
    label: str = "label",
    alpha: float = ALPHA,
    rounds: int = ROUNDS,
    ordered: bool = False,
    weights: str = "bound",
    driver_cells: int = DRIVER_CELLS,
    item_votes: int = ITEM_VOTES,
) -> tuple[DataFrame, DataFrame]:
    """Consensus per item and reliability per annotator.

    ``votes`` has one row a vote; rows with a null item, annotator or label are no
    votes, repeated rows count once, and of an annotator's different labels for one
    item the smallest counts. ``ordered`` takes the labels' order as a scale: distances are
    steps on it (``bound``), or differ by direction (``log_odds``); without it all labels are
    equally far. Scales and ``log_odds`` take up to ``MAX_LABELS`` labels, else ``ValueError``.

    Returns ``(item, label, n_votes, agreement, confidence)`` - agreement is the share of vote
    pairs that agree (1 for one vote), confidence the weighted share of the consensus - and
    ``(annotator, n_votes, reliability, weight)``, reliability being the share of votes that
    equal the consensus; weights are relative to the largest with ``bound`` and the mean of the
    two directions with ``log_odds``. The consensus is one of the item's votes; equal weighted
    distances are decided by the smaller label. No votes give two empty tables.
    """
    if weights not in ("bound", "log_odds"):
        raise ValueError("weights must be bound or log_odds")
    clean = (
        votes.select(F.col(item).alias("item"), F.col(annotator).cast("string").alias("annotator"), F.col(label).cast("string").alias("label"))
        .where(F.col("item").isNotNull() & F.col("annotator").isNotNull() & F.col("label").isNotNull())
        .groupBy("item", "annotator")
        .agg(F.min("label").alias("label"))
    )
    clean = cut_lineage(clean)
    by_label = clean.groupBy("item", "label").agg(F.count("*").cast("double").alias("c"))
    counted = by_label.groupBy("item").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"))
    agreement = F.when(F.col("n") < 2, F.lit(1.0)).otherwise(F.try_divide("same", F.col("n") * (F.col("n") - 1)))
    counted = cut_lineage(counted.select("item", F.col("n").cast("int").alias("n_votes"), agreement.alias("agreement")))
    # items with very many votes are not gathered into a row; each is a signature of its own
    wide = counted.where(F.col("n_votes") > item_votes).select("item")
    usual = clean.join(wide, "item", "left_anti")
    signed = usual.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("annotator", "label"))).alias("votes"))
    signed = cut_lineage(signed.withColumn("signature", F.sha2(F.to_json("votes"), 256)))
    own = F.concat(F.lit("item "), F.col("item").cast("string"))
    alike = signed.groupBy("signature").agg(F.first("votes").alias("votes"), F.count("*").alias("items"))
    long = alike.select("signature", "items", F.explode("votes").alias("v")).select("signature", "items", "v.annotator", "v.label")
    long = cut_lineage(long.unionByName(clean.join(wide, "item").select(own.alias("signature"), F.lit(1).cast("long").alias("items"), "annotator", "label")))
    scale: list[str] = []
    if ordered or weights == "log_odds":
        scale = sorted(r.label for r in long.select("label").distinct().limit(MAX_LABELS + 1).collect())
        if len(scale) > MAX_LABELS:
            raise ValueError(f"more than {MAX_LABELS} labels")
    # cells of votes and the labels that their item may take
    sized = long.groupBy("signature").agg(F.count("*").alias("n"), F.countDistinct("label").alias("k"))
    cells = sized.agg(F.sum(F.col("n") * (F.lit(len(scale)) if weights == "log_odds" else F.col("k")))).first()[0] or 0
    solve = _solve_in_driver if cells <= driver_cells else _solve_in_jobs
    solved, people = solve(long, scale, alpha, rounds, ordered, weights)
    named = signed.select("item", "signature").unionByName(wide.select("item", own.alias("signature")))
    outcome = named.join(solved, "signature").join(counted, "item").select("item", "label", "n_votes", "agreement", "confidence")
    return outcome, people


_SOLVED = "signature string, label string, confidence double"
_PEOPLE = "annotator string, n_votes long, reliability double, weight double"
#: Part of an item's whole weight within which two weighted distances are equal.
TIE = 1e-9
#: Least weight, relative to the largest.
LEAST_WEIGHT = 1e-6


def _solve_in_driver(long: DataFrame, scale: list[str], alpha: float, rounds: int, ordered: bool, weights: str) -> tuple[DataFrame, DataFrame]:
    spark = long.sparkSession
    votes = sorted((r.signature, r.annotator, r.label, r["items"]) for r in long.collect())
    if not votes:
        return spark.createDataFrame([], _SOLVED), spark.createDataFrame([], _PEOPLE)
    names, people = sorted({v[0] for v in votes}), sorted({v[1] for v in votes})
    labels = scale or sorted({v[2] for v in votes})
    number, at, of = ({x: n for n, x in enumerate(xs)} for xs in (names, people, labels))
    row, who, what = (np.array([m[v[k]] for v in votes]) for k, m in enumerate((number, at, of)))
    times = np.array([v[3] for v in votes], dtype=float)
    # candidates of each row, and each vote against those of its row
    if weights == "log_odds":
        cand_row, cand = np.repeat(np.arange(len(names)), len(labels)), np.tile(np.arange(len(labels)), len(names))
    else:
        cand_row, cand = np.divmod(np.unique(row * len(labels) + what), len(labels))
    first, many = np.searchsorted(cand_row, np.arange(len(names))), np.bincount(cand_row)
    width = many[row]
    vote = np.repeat(np.arange(len(votes)), width)
    begin = np.cumsum(width) - width
    cell = np.arange(len(vote)) - begin[vote] + first[row[vote]]
    below, above = what[vote] < cand[cell], what[vote] > cand[cell]
    steps = np.abs(what[vote] - cand[cell]).astype(float) if ordered else (below | above).astype(float)
    size = len(people)

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(who[vote], weights=values, minlength=size)

    several = (np.bincount(row)[row] > 1).astype(float) * times
    over = under = np.ones(size)
    for _ in range(rounds):
        if weights == "bound":
            # weights relative to the largest; distances to the label of the other votes
            cost = over[who[vote]] * steps
            others = np.bincount(cell, weights=cost, minlength=len(cand))[cell] - cost
            least = np.minimum.reduceat(others, begin)
            whole = np.bincount(row, weights=over[who])[row]
            tied = others <= (least + TIE * whole)[vote]
            distance = np.add.reduceat(tied * steps, begin) / np.add.reduceat(tied.astype(float), begin)
            new = bound_weight(np.bincount(who, weights=several, minlength=size), np.bincount(who, weights=several * distance, minlength=size), alpha)
            new = np.maximum(new / max(new.max(), 1e-300), LEAST_WEIGHT) if new.max() > 0 else np.ones(size)
            new_over = new_under = new
        else:
            cost = np.where(below, over[who[vote]], 0.0) + np.where(above, under[who[vote]], 0.0)
            score = -np.bincount(cell, weights=cost, minlength=len(cand))
            likely = np.exp(score - np.maximum.reduceat(score, first)[cand_row])
            likely /= np.add.reduceat(likely, first)[cand_row]
            mass = likely[cell] * times[vote]
            down, up = total(mass * below), total(mass * above)
            if ordered:
                new_over = log_odds_weight(total(mass * (cand[cell] > 0)), down, len(labels), alpha)
                new_under = log_odds_weight(total(mass * (cand[cell] < len(labels) - 1)), up, len(labels), alpha)
            else:
                new_over = new_under = log_odds_weight(total(mass), down + up, len(labels), alpha)
        moved = max((np.abs(new_over - over) / over).max(), (np.abs(new_under - under) / under).max())
        over, under = new_over, new_under
        if moved < TOLERANCE:
            break
    if weights == "bound":
        cost = over[who[vote]] * steps
    else:
        cost = np.where(below, over[who[vote]], 0.0) + np.where(above, under[who[vote]], 0.0)
    costs = np.bincount(cell, weights=cost, minlength=len(cand))
    voted = np.bincount(cell, weights=(what[vote] == cand[cell]), minlength=len(cand)) > 0
    costs = np.where(voted, costs, np.inf)
    mean = (over + under) / 2
    whole = np.bincount(row, weights=mean[who])
    tied = costs <= (np.minimum.reduceat(costs, first) + TIE * whole)[cand_row]
    chosen = np.minimum.reduceat(np.where(tied, cand, len(labels)), first)
    if weights == "bound":
        sure = np.bincount(row, weights=mean[who] * (what == chosen[row])) / np.maximum(whole, 1e-300)
    else:
        sure = np.bincount(cand_row, weights=likely * (cand == chosen[cand_row]))
    cast = np.bincount(who, weights=times, minlength=size)
    right = np.bincount(who, weights=times * (what == chosen[row]), minlength=size)
    solved = [(names[n], labels[chosen[n]], float(sure[n])) for n in range(len(names))]
    known = [(a, int(cast[n]), float(right[n] / cast[n]), float(mean[n])) for a, n in at.items()]
    return spark.createDataFrame(solved, _SOLVED), spark.createDataFrame(known, _PEOPLE)


def _solve_in_jobs(long: DataFrame, scale: list[str], alpha: float, rounds: int, ordered: bool, weights: str) -> tuple[DataFrame, DataFrame]:
    """The same rounds as Spark jobs; a scale's labels and one number a round reach the driver."""
    if weights == "log_odds":
        cells = long.withColumn("truth", F.explode(F.array(*[F.lit(x) for x in scale])))
    else:
        cells = long.join(long.select("signature", F.col("label").alias("truth")).distinct(), "signature")
    if ordered:
        place = F.array(*[F.lit(x) for x in scale])
        steps = F.abs(F.array_position(place, F.col("label")) - F.array_position(place, F.col("truth"))).cast("double")
    else:
        steps = (F.col("label") != F.col("truth")).cast("double")
    sizes = long.groupBy("signature").agg(F.count("*").alias("n_row"))
    cells = cut_lineage(cells.join(sizes, "signature").withColumn("steps", steps))
    below, above = F.col("label") < F.col("truth"), F.col("label") > F.col("truth")
    current = long.select("annotator").distinct().select("annotator", F.lit(1.0).alias("over"), F.lit(1.0).alias("under"))

    def costs() -> DataFrame:
        cost = F.col("over") * F.col("steps") if weights == "bound" else F.when(below, F.col("over")).when(above, F.col("under")).otherwise(0.0)
        opened = cells.join(current, "annotator").withColumn("cost", cost).withColumn("mean", (F.col("over") + F.col("under")) / 2)
        return opened

    def scored(opened: DataFrame) -> DataFrame:
        return opened.groupBy("signature", "truth").agg(F.sum("cost").alias("score"), F.sum("mean").alias("whole"), F.max((F.col("label") == F.col("truth")).cast("int")).alias("voted"))

    for _ in range(rounds):
        opened = costs()
        scores = scored(opened)
        if weights == "bound":
            each = opened.join(scores.select("signature", "truth", "score", "whole"), ["signature", "truth"]).withColumn("others", F.col("score") - F.col("cost"))
            vote = ["signature", "annotator", "items", "n_row"]
            least = each.groupBy(*vote).agg(F.min("others").alias("least"))
            tied = each.join(least, vote).where(F.col("others") <= F.col("least") + TIE * F.col("whole"))
            told = tied.groupBy(*vote).agg(F.avg("steps").alias("distance")).where(F.col("n_row") > 1)
            sums = told.groupBy("annotator").agg(F.sum("items").alias("n"), F.sum(F.col("items") * F.col("distance")).alias("d"))
            raw = current.select("annotator").join(sums, "annotator", "left").select("annotator", _bound_weight_column(F.coalesce("n", F.lit(0)), F.coalesce("d", F.lit(0.0)), alpha).alias("w"))
            raw = cut_lineage(raw)
            most = raw.agg(F.max("w")).first()[0] or 0.0
            weight = F.greatest(F.col("w") / most, F.lit(LEAST_WEIGHT)) if most > 0 else F.lit(1.0)
            new = raw.select("annotator", weight.alias("over"), weight.alias("under"))
        else:
            within = Window.partitionBy("signature")  # a row a label
            likely = scores.withColumn("e", F.exp(F.min("score").over(within) - F.col("score"))).withColumn("p", F.col("e") / F.sum("e").over(within))
            mass = F.col("p") * F.col("items")
            judged = cells.join(likely.select("signature", "truth", "p"), ["signature", "truth"])
            sums = judged.groupBy("annotator").agg(
                F.sum(mass).alias("n"),
                F.sum(F.when(F.col("truth") != scale[0], mass).otherwise(0.0)).alias("no"),
                F.sum(F.when(below, mass).otherwise(0.0)).alias("do"),
                F.sum(F.when(F.col("truth") != scale[-1], mass).otherwise(0.0)).alias("nu"),
                F.sum(F.when(above, mass).otherwise(0.0)).alias("du"),
            )
            if ordered:
                pair = [_log_odds_column(F.col("no"), F.col("do"), len(scale), alpha), _log_odds_column(F.col("nu"), F.col("du"), len(scale), alpha)]
            else:
                pair = [_log_odds_column(F.col("n"), F.col("do") + F.col("du"), len(scale), alpha)] * 2
            new = cut_lineage(sums.select("annotator", pair[0].alias("over"), pair[1].alias("under")))
        old = current.select("annotator", F.col("over").alias("o"), F.col("under").alias("u"))
        moved = new.join(old, "annotator").agg(F.max(F.greatest(F.abs(F.col("over") - F.col("o")) / F.col("o"), F.abs(F.col("under") - F.col("u")) / F.col("u")))).first()[0]
        if weights == "log_odds":
            last = likely
        current = new
        if moved is None or moved < TOLERANCE:
            break
    final = cut_lineage(scored(costs()).where("voted = 1"))
    top = final.groupBy("signature").agg(F.min("score").alias("least"))
    chosen = final.join(top, "signature").where(F.col("score") <= F.col("least") + TIE * F.col("whole")).groupBy("signature").agg(F.min("truth").alias("label"))
    judged = long.join(chosen.select("signature", F.col("label").alias("truth")), "signature")
    right = F.col("label") == F.col("truth")
    if weights == "bound":
        weighed = judged.join(current, "annotator").groupBy("signature").agg(F.try_divide(F.sum(F.when(right, F.col("over")).otherwise(0.0)), F.sum("over")).alias("confidence"))
        solved = chosen.join(weighed, "signature")
    else:
        solved = chosen.join(last.select("signature", F.col("truth").alias("label"), F.col("p").alias("confidence")), ["signature", "label"])
    people = judged.groupBy("annotator").agg(F.sum("items").alias("n_votes"), (F.sum(F.when(right, F.col("items")).otherwise(0)) / F.sum("items")).alias("reliability"))
    people = people.join(current, "annotator").select("annotator", "n_votes", "reliability", ((F.col("over") + F.col("under")) / 2).alias("weight"))
    return solved.select("signature", "label", "confidence"), people
