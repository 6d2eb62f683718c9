import random

import pytest

from textloom.llm.consensus import bound_weight, chi2_lower, log_odds_weight, truth_discovery


def _planted(seed=3, n=400):
    rnd = random.Random(seed)
    skill = {"a": 0.95, "b": 0.9, "c": 0.75, "d": 0.6}
    labels = ["1", "2", "3"]
    truth, votes = {}, []
    for k in range(n):
        truth[f"i{k}"] = t = rnd.choice(labels)
        for who, p in skill.items():
            if rnd.random() < 0.85:
                votes.append((f"i{k}", who, t if rnd.random() < p else rnd.choice([x for x in labels if x != t])))
    return truth, votes


def test_chi2_quantile_matches_tables():
    assert abs(chi2_lower(10) - 3.247) < 0.05
    assert abs(chi2_lower(100) - 74.22) < 0.1
    assert chi2_lower(0) == 0.0


def test_few_votes_get_less_weight():
    for weight in (bound_weight, lambda n, d: log_odds_weight(n, d, 3)):
        assert weight(5, 0) < weight(500, 0)
        assert weight(500, 100) < weight(500, 10)


@pytest.mark.parametrize("weights", ["bound", "log_odds"])
def test_recovers_planted_truth_and_skills(spark, weights):
    truth, votes = _planted()
    df = spark.createDataFrame(votes, "item string, annotator string, label string")
    agreed, people = truth_discovery(df, weights=weights)
    rows = agreed.collect()
    assert sum(truth[r["item"]] == r.label for r in rows) / len(rows) > 0.93
    by = {r.annotator: r.reliability for r in people.collect()}
    assert by["a"] > by["c"] > by["d"]
    w = {r.annotator: r.weight for r in people.collect()}
    assert w["a"] > w["c"] > w["d"] and w["b"] > 0.2 * w["a"]  # nobody dictates


@pytest.mark.parametrize("weights", ["bound", "log_odds"])
@pytest.mark.parametrize("ordered", [False, True])
def test_jobs_equal_driver(spark, ordered, weights):
    _, votes = _planted(5, 60)
    df = spark.createDataFrame(votes, "item string, annotator string, label string")
    a, pa = truth_discovery(df, rounds=4, ordered=ordered, weights=weights)
    b, pb = truth_discovery(df, driver_cells=-1, rounds=4, ordered=ordered, weights=weights, item_votes=3)
    assert {(r["item"], r.label, r.n_votes, round(r.agreement, 9), round(r.confidence, 6)) for r in a.collect()} == {(r["item"], r.label, r.n_votes, round(r.agreement, 9), round(r.confidence, 6)) for r in b.collect()}
    x, y = ({r.annotator: (r.n_votes, round(r.reliability, 6), round(r.weight, 4)) for r in p.collect()} for p in (pa, pb))
    assert x == y


def test_errors_to_one_side(spark):
    # two who err upwards agree on the wrong label; the third is right
    rnd = random.Random(8)
    truth, votes = {}, []
    for k in range(900):
        truth[f"i{k}"] = t = rnd.choice([1, 2, 3])
        for who, p in (("a", 0.9), ("b", 0.93), ("c", 0.6), ("d", 0.6)):
            v = t if rnd.random() < p else (max(1, t - 1) if who in "cd" else rnd.choice([1, 2, 3]))
            votes.append((f"i{k}", who, str(v)))
    df = spark.createDataFrame(votes, "item string, annotator string, label string")
    right = {}
    for ordered in (False, True):
        agreed, _ = truth_discovery(df, ordered=ordered, weights="log_odds")
        right[ordered] = sum(str(truth[r["item"]]) == r.label for r in agreed.collect()) / len(truth)
    assert right[True] > 0.93 and right[True] >= right[False] - 0.002


def test_nulls_repeats_and_empty(spark):
    schema = "item string, annotator string, label string, signature string"
    rows = [("i", "a", "x", None), ("i", "a", "x", None), ("i", "b", None, "s"), (None, "a", "x", None), ("j", None, "x", None), ("i", "c", "y", None), ("i", "d", "x", None)]
    agreed, people = truth_discovery(spark.createDataFrame(rows, schema))
    (r,) = agreed.collect()
    assert (r["item"], r.label, r.n_votes) == ("i", "x", 3)
    assert abs(r.agreement - 1 / 3) < 1e-9
    assert {p.annotator for p in people.collect()} == {"a", "c", "d"}
    agreed, people = truth_discovery(spark.createDataFrame([], schema))
    assert agreed.count() == 0 and people.count() == 0


def test_many_labels(spark):
    rows = [(f"i{k}", a, f"l{k}") for k in range(1200) for a in "abc"]
    df = spark.createDataFrame(rows, "item string, annotator string, label string")
    assert truth_discovery(df)[0].where("label = concat('l', substr(item, 2))").count() == 1200
    for options in ({"ordered": True}, {"weights": "log_odds"}):
        with pytest.raises(ValueError):
            truth_discovery(df, **options)
    with pytest.raises(ValueError):
        truth_discovery(df, weights="none")
