"""Labels of several raters: normalisation, agreement, and class estimation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

CLASSES = ["1_hauptthema", "2_nebenthema", "3_kein_thema"]


def normal_label(label: Column) -> Column:
    """One of the three labels: trimmed, case ignored, every ``2_`` the side topic; others null."""
    plain = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    return F.when(plain.startswith("1_"), CLASSES[0]).when(plain.startswith("2_"), CLASSES[1]).when(plain.startswith("3_"), CLASSES[2])


def rank_of(label: Column) -> Column:
    """Number before the underscore, null where there is none."""
    return F.split_part(F.trim(label), F.lit("_"), F.lit(1)).try_cast("int")


def votes_of(df: DataFrame, item: str, raters: list[str]) -> DataFrame:
    """``(item, rater, label)`` of the columns of raters, nulls left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("rater"), F.col(c).alias("label")) for c in raters])
    return df.select(F.col(item).alias("item"), F.explode(pairs).alias("v")).select("item", "v.rater", "v.label").where(F.col("label").isNotNull())


def rankings_from_folders(files: DataFrame, path: str = "path") -> DataFrame:
    """``(item, label, folder)`` of files in folders whose names begin with 1, 2 or 3.

    The folder's place in the order of names decides between several: the last wins.
    """
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    item = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    named = files.select(item.alias("item"), folder.alias("folder")).where(F.col("folder").rlike("^[123]"))
    last = named.groupBy("item").agg(F.max("folder").alias("folder"))
    label = F.when(F.col("folder").startswith("1"), CLASSES[0]).when(F.col("folder").startswith("2"), CLASSES[1]).otherwise(CLASSES[2])
    return last.select("item", label.alias("label"), "folder")


def coincidences(votes: DataFrame) -> DataFrame:
    """``(c, k, n)``: coincidence matrix of the labels of items with at least two votes."""
    counts = votes.groupBy("item", "label").agg(F.count("*").alias("m"))
    by_item = counts.groupBy("item").agg(F.sum("m").alias("all"), F.collect_list(F.struct("label", "m")).alias("l")).where(F.col("all") > 1)
    a = by_item.select("all", "l", F.explode("l").alias("a"))
    pairs = a.select("all", "a", F.explode("l").alias("b"))
    weight = F.when(F.col("a.label") == F.col("b.label"), F.col("a.m") * (F.col("a.m") - 1)).otherwise(F.col("a.m") * F.col("b.m")) / (F.col("all") - 1)
    return pairs.groupBy(F.col("a.label").alias("c"), F.col("b.label").alias("k")).agg(F.sum(weight).alias("n"))


def krippendorff_alpha(votes: DataFrame, level: str = "nominal") -> DataFrame:
    """One row ``(alpha, n_pairable)``; null where all values are equal or nothing pairs.

    ``ordinal`` takes the labels' order for their ranks.
    """
    if level not in ("nominal", "ordinal"):
        raise ValueError("level is 'nominal' or 'ordinal'")
    o = coincidences(votes)
    margin = o.groupBy("c").agg(F.sum("n").alias("m"))
    # a handful of labels: windows over them are small
    ordered = Window.partitionBy(F.lit(1)).orderBy("c")
    ranked = margin.withColumn("below", F.coalesce(F.sum("m").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    a = ranked.select("c", F.col("m").alias("mc"), F.col("below").alias("bc"))
    b = ranked.select(F.col("c").alias("k"), F.col("m").alias("mk"), F.col("below").alias("bk"))
    cells = a.crossJoin(F.broadcast(b)).join(o, ["c", "k"], "left")  # labels by labels
    if level == "nominal":
        distance = (F.col("c") != F.col("k")).cast("double")
    else:
        low, high = F.least("bc", "bk"), F.greatest(F.col("bc") + F.col("mc"), F.col("bk") + F.col("mk"))
        distance = F.when(F.col("c") == F.col("k"), 0.0).otherwise(F.pow(high - low - (F.col("mc") + F.col("mk")) / 2, F.lit(2.0)))
    sums = cells.agg(
        F.sum(F.coalesce("n", F.lit(0.0)) * distance).alias("observed"),
        F.sum(F.col("mc") * F.col("mk") * distance).alias("expected"),
        F.sum(F.coalesce("n", F.lit(0.0))).alias("n"),
    )
    return sums.select((1 - (F.col("n") - 1) * F.try_divide("observed", "expected")).alias("alpha"), F.coalesce("n", F.lit(0.0)).alias("n_pairable"))


#: Votes of distinct sets that the driver may iterate over; beyond it the rounds are Spark jobs.
DRIVER_VOTES = 500_000


def dawid_skene(votes: DataFrame, classes: list[str] = CLASSES, max_rounds: int = 45, tolerance: float = 0.0, driver_votes: int = DRIVER_VOTES) -> tuple[DataFrame, DataFrame]:
    """Class probabilities of items and error rates of raters by expectation maximisation.

    Items with the same votes have the same estimate, so the rounds run over the distinct sets
    of votes with their numbers of items, kept as votes whatever the number of raters: in the
    driver if they are few, else as Spark jobs. Rounds end early only if the likelihood moves
    by less than ``tolerance``. Returns ``(item, label, probability, p1..pk)`` and
    ``(rater, truth, given, rate)``.
    """
    signed = votes.where(F.col("label").isin(classes)).groupBy("item").agg(F.array_sort(F.collect_set(F.struct("rater", "label"))).alias("v"))
    signed = cut_lineage(signed.withColumn("signature", F.sha2(F.to_json("v"), 256)))
    sets = cut_lineage(signed.groupBy("signature").agg(F.first("v").alias("v"), F.count("*").alias("times")))
    if (sets.agg(F.sum(F.size("v"))).first()[0] or 0) > driver_votes:
        table, errors = _dawid_skene_jobs(sets, classes, max_rounds, tolerance)
        return signed.select("item", "signature").join(table, "signature").drop("signature"), errors
    rows = sets.orderBy("signature").collect()
    spark = votes.sparkSession
    people = sorted({x.rater for r in rows for x in r.v})
    at, of = {p: k for k, p in enumerate(people)}, {c: k for k, c in enumerate(classes)}
    n = len(classes)
    of_row = np.array([k for k, r in enumerate(rows) for _ in r.v], dtype=np.int64)
    who = np.array([at[x.rater] for r in rows for x in r.v], dtype=np.int64)
    what = np.array([of[x.label] for r in rows for x in r.v], dtype=np.int64)
    times = np.array([r.times for r in rows], dtype=float)
    chance = np.zeros((len(rows), n))
    np.add.at(chance, (of_row, what), 1.0)
    chance = chance / np.maximum(chance.sum(axis=1, keepdims=True), 1)
    rates = np.zeros((len(people), n, n))  # rater, given, truth
    before = -math.inf
    for _ in range(max_rounds):
        if not len(rows):
            break
        prior = (times[:, None] * chance).sum(axis=0)
        prior = prior / prior.sum()
        rates = np.zeros((len(people), n, n))
        np.add.at(rates, (who, what), times[of_row][:, None] * chance[of_row])
        whole = rates.sum(axis=1, keepdims=True)
        rates = np.divide(rates, whole, out=np.zeros_like(rates), where=whole > 0)
        joint = np.tile(np.log(np.maximum(prior, 1e-300)), (len(rows), 1))
        np.add.at(joint, of_row, np.log(np.maximum(rates, 1e-300))[who, what])
        top = joint.max(axis=1, keepdims=True)
        scaled = np.exp(joint - top)
        chance = scaled / scaled.sum(axis=1, keepdims=True)
        likelihood = float((times * (np.log(scaled.sum(axis=1)) + top[:, 0])).sum())
        if abs(likelihood - before) < tolerance:
            break
        before = likelihood
    names = [f"p{k + 1}" for k in range(n)]
    table = spark.createDataFrame(
        [(r.signature, classes[int(c.argmax())], float(c.max()), *map(float, c)) for r, c in zip(rows, chance)],
        "signature string, label string, probability double, " + ", ".join(f"{x} double" for x in names),
    )
    errors = spark.createDataFrame(
        [(p, classes[c], classes[x], float(rates[k, x, c])) for p, k in at.items() for c in range(n) for x in range(n)],
        "rater string, truth string, given string, rate double",
    )
    return signed.select("item", "signature").join(table, "signature").drop("signature"), errors


def _dawid_skene_jobs(sets: DataFrame, classes: list[str], max_rounds: int, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """The same rounds with rates and probabilities in tables; one number a round reaches the driver."""
    long = cut_lineage(sets.select("signature", "times", F.explode("v").alias("x")).select("signature", "times", "x.rater", "x.label"))
    listed = F.explode(F.array(*[F.lit(c) for c in classes]))
    within = Window.partitionBy("signature")  # a row a class
    shares = long.groupBy("signature", "times", F.col("label").alias("truth")).agg(F.count("*").alias("k"))
    every = long.select("signature", "times").distinct().select("signature", "times", listed.alias("truth"))
    chance = every.join(shares.drop("times"), ["signature", "truth"], "left").withColumn("p", F.coalesce("k", F.lit(0)) / F.sum("k").over(within)).select("signature", "times", "truth", "p")
    before, rates = -math.inf, None
    floor = F.lit(1e-300)
    for _ in range(max_rounds):
        chance = cut_lineage(chance)
        prior = chance.groupBy("truth").agg(F.sum(F.col("times") * F.col("p")).alias("m")).withColumn("prior", F.col("m") / F.sum("m").over(Window.partitionBy(F.lit(1)))).select("truth", "prior")  # a row a class
        mass = long.join(chance.select("signature", "truth", "p"), "signature").groupBy("rater", "truth", "label").agg(F.sum(F.col("times") * F.col("p")).alias("m"))
        rates = mass.withColumn("rate", F.coalesce(F.try_divide("m", F.sum("m").over(Window.partitionBy("rater", "truth"))), F.lit(0.0))).select("rater", "truth", "label", "rate")
        rates = cut_lineage(rates)
        logs = long.join(rates, ["rater", "label"]).groupBy("signature", "times", "truth").agg(F.sum(F.ln(F.greatest("rate", floor))).alias("l"))
        joint = logs.join(F.broadcast(prior), "truth").withColumn("l", F.col("l") + F.ln(F.greatest("prior", floor)))
        joint = joint.withColumn("top", F.max("l").over(within)).withColumn("e", F.exp(F.col("l") - F.col("top"))).withColumn("whole", F.sum("e").over(within))
        joint = cut_lineage(joint)
        chance = joint.select("signature", "times", "truth", (F.col("e") / F.col("whole")).alias("p"))
        likelihood = joint.where(F.col("truth") == classes[0]).agg(F.sum(F.col("times") * (F.ln("whole") + F.col("top")))).first()[0]
        if likelihood is None or abs(likelihood - before) < tolerance:
            break
        before = likelihood
    columns = [F.max(F.when(F.col("truth") == c, F.col("p"))).alias(f"p{k + 1}") for k, c in enumerate(classes)]
    place = F.element_at(F.create_map(*[F.lit(x) for k, c in enumerate(classes) for x in (c, -k)]), F.col("truth"))
    best = F.max_by("truth", F.struct("p", place.alias("k"))).alias("label")
    table = chance.groupBy("signature").agg(best, F.max("p").alias("probability"), *columns)
    raters = long.select("rater").distinct().select("rater", listed.alias("truth")).select("rater", "truth", listed.alias("given"))
    errors = raters.join(rates.withColumnRenamed("label", "given"), ["rater", "truth", "given"], "left").select("rater", "truth", "given", F.coalesce("rate", F.lit(0.0)).alias("rate"))
    return table, errors


def expert_disagreement(estimated: DataFrame, experts: DataFrame, columns: list[str]) -> DataFrame:
    """``(item, label, differs)`` of items with an expert's label: whether no expert gave the estimate."""
    joined = estimated.join(experts, "item")
    given = F.array_compact(F.array(*[F.col(c) for c in columns]))
    return joined.where(F.size(given) > 0).select("item", "label", (~F.array_contains(given, F.col("label"))).alias("differs"))
