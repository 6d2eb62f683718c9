"""Scores of retrieval and classification against gold labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAIN = "1_hauptthema"
#: Labels of the side topic, the older spelling included.
SIDE = ["2_nebenthema", "2_erwähnung"]
NO_TOPIC = "3_kein_thema"


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1; 0 where undefined."""
    return [_ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn)]


def judged(docs: DataFrame, hits: DataFrame, label: str, mode: str = "pooling") -> DataFrame:
    """``docs`` with ``predicted``, ``gold_main`` and ``gold_any`` (main or side topic).

    In mode ``pooling`` documents without label are negative, in mode ``annotated`` they are left out.
    """
    if mode not in ("pooling", "annotated"):
        raise ValueError("mode is 'pooling' or 'annotated'")
    marked = docs.join(hits.select("doc_id", F.lit(True).alias("predicted")), "doc_id", "left")
    if mode == "annotated":
        marked = marked.where(F.coalesce(F.col(label), F.lit("")) != "")
    given = F.coalesce(F.col(label), F.lit(""))
    return marked.withColumns({"predicted": F.coalesce("predicted", F.lit(False)), "gold_main": given == MAIN, "gold_any": given.isin([MAIN, *SIDE])})


def report(df: DataFrame, gold: Column, predicted: Column, *by: str) -> DataFrame:
    """Binary report, one row a group of ``by``: per class, accuracy, macro and weighted means."""
    c = {
        "tp": F.count_if(gold & predicted),
        "fp": F.count_if(~gold & predicted),
        "fn": F.count_if(gold & ~predicted),
        "tn": F.count_if(~gold & ~predicted),
    }
    counts = df.groupBy(*by).agg(*[v.alias(k) for k, v in c.items()])
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    p1, r1, f1 = prf(tp, fp, fn)
    p0, r0, f0 = prf(tn, fn, fp)
    pos, neg, n = tp + fn, tn + fp, tp + fp + fn + tn
    return counts.select(
        *by, "tp", "fp", "fn", "tn",
        p1.alias("precision"), r1.alias("recall"), f1.alias("f1"), pos.alias("support"),
        p0.alias("precision_neg"), r0.alias("recall_neg"), f0.alias("f1_neg"), neg.alias("support_neg"),
        _ratio(tp + tn, n).alias("accuracy"),
        ((p0 + p1) / 2).alias("macro_precision"), ((r0 + r1) / 2).alias("macro_recall"), ((f0 + f1) / 2).alias("macro_f1"),
        _ratio(p1 * pos + p0 * neg, n).alias("weighted_precision"), _ratio(r1 * pos + r0 * neg, n).alias("weighted_recall"), _ratio(f1 * pos + f0 * neg, n).alias("weighted_f1"),
    )


def evaluate_retrieval(docs: DataFrame, hits: DataFrame, label: str, mode: str = "pooling", by: Sequence[str] = ()) -> DataFrame:
    """Reports for the main topic and for main or side topic, column ``topic``."""
    rows = judged(docs, hits, label, mode)
    main = report(rows, F.col("gold_main"), F.col("predicted"), *by).withColumn("topic", F.lit("main"))
    either = report(rows, F.col("gold_any"), F.col("predicted"), *by).withColumn("topic", F.lit("main_or_side"))
    return main.unionByName(either)


def evaluate_by_genre(docs: DataFrame, hits: DataFrame, label: str, genre: str, mode: str = "pooling") -> DataFrame:
    """Reports by genre; genres without any hit are left out."""
    rows = judged(docs, hits, label, mode)
    both = report(rows, F.col("gold_main"), F.col("predicted"), genre).withColumn("topic", F.lit("main")).unionByName(
        report(rows, F.col("gold_any"), F.col("predicted"), genre).withColumn("topic", F.lit("main_or_side"))
    )
    return both.where(F.col("tp") + F.col("fp") > 0)


def threshold_curve(scored: DataFrame, score: str, gold: Column, thresholds: Sequence[float], *by: str) -> DataFrame:
    """Precision, recall and F1 of the positive class for ``score >= threshold``, each threshold.

    Rows are first counted by the number of thresholds they reach, so the data is read once and
    each row counts once; the curve is summed over that small table. A null score reaches none.
    """
    marks = sorted(set(thresholds))
    levels = F.array(*[F.lit(float(t)) for t in marks])
    reached = F.when(F.col(score).isNull(), F.lit(0)).otherwise(F.size(F.filter(levels, lambda t: t <= F.col(score).cast("double"))))
    steps = scored.withColumn("__gold", gold).groupBy(*by, reached.alias("reached")).agg(F.count_if("__gold").alias("pos"), F.count_if(~F.col("__gold")).alias("neg"))
    opened = steps.select(*by, "reached", "pos", "neg", F.posexplode(levels).alias("k", "threshold"))
    above = F.col("reached") > F.col("k")
    curve = opened.groupBy(*by, "threshold").agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(above, 0).otherwise(F.col("pos"))).alias("fn"),
    )
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return curve.select(*by, "threshold", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def comparison_table(curves: DataFrame, method: str, thresholds: Sequence[float], digits: int = 3) -> DataFrame:
    """Methods as rows, a precision, recall and F1 column for each threshold."""
    kept = curves.where(F.col("threshold").isin([float(t) for t in thresholds]))
    name = F.concat(F.lit("t"), F.col("threshold").cast("int").cast("string"))
    return kept.withColumn("t", name).groupBy(method).pivot("t", [f"t{int(t)}" for t in thresholds]).agg(
        *[F.round(F.first(c), digits).alias(c) for c in ("precision", "recall", "f1")]
    )


def confusion(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """``(gold, predicted, n)`` of labels."""
    return df.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def multiclass_report(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Per class ``(label, precision, recall, f1, support)``, and the rows ``accuracy``, ``macro`` and ``micro``."""
    pairs = df.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull())
    sides = pairs.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col(gold) == F.col(predicted)).cast("int").alias("tp")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("tp")))).alias("x"))
    counts = sides.groupBy("x.label").agg(F.sum("x.g").alias("g"), F.sum("x.p").alias("p"), F.sum("x.tp").alias("tp"))
    pr, rc, f1 = prf(F.col("tp"), F.col("p") - F.col("tp"), F.col("g") - F.col("tp"))
    classes = counts.select("label", pr.alias("precision"), rc.alias("recall"), f1.alias("f1"), F.col("g").alias("support"), "tp")
    whole = F.sum("support")
    macro = classes.agg(F.lit("macro").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), whole.alias("support"))
    right = _ratio(F.sum("tp"), whole)
    single = [classes.agg(F.lit(n).alias("label"), right.alias("precision"), right.alias("recall"), right.alias("f1"), whole.alias("support")) for n in ("accuracy", "micro")]
    return classes.drop("tp").unionByName(macro).unionByName(single[0]).unionByName(single[1])


def outcome(gold: Column, predicted: Column) -> Column:
    """TP, FP, FN or TN of a row; nulls are negative."""
    g, p = F.coalesce(gold, F.lit(False)), F.coalesce(predicted, F.lit(False))
    return F.when(g & p, "TP").when(~g & p, "FP").when(g, "FN").otherwise("TN")


def false_positives(docs: DataFrame, hits: DataFrame, label: str, positive: Sequence[str]) -> DataFrame:
    """Found documents whose label (default: no topic) is not positive."""
    return docs.join(hits.select("doc_id", "matches"), "doc_id").where(~F.coalesce(F.col(label), F.lit(NO_TOPIC)).isin(list(positive)))


def false_negatives(docs: DataFrame, hits: DataFrame, label: str, positive: Sequence[str]) -> DataFrame:
    """Documents with a positive label that were not found."""
    return docs.join(hits.select("doc_id"), "doc_id", "left_anti").where(F.coalesce(F.col(label), F.lit(NO_TOPIC)).isin(list(positive)))


def flattened(report_df: DataFrame, name: str = "label") -> DataFrame:
    """``(metric, value)`` of a per-class report, metrics named ``class.measure``."""
    values = F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in ("precision", "recall", "f1", "support")])
    return report_df.select(name, F.explode(values).alias("x")).select(F.concat_ws(".", name, "x.m").alias("metric"), F.col("x.v").alias("value"))
