import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spectraloom.llm import queries as q
from spectraloom.llm.mixing import Leaf, _fill, budgets, exact_total, mix, plan_leaves, planned, shares


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 5), st.floats(0, 100)), min_size=1, max_size=8), st.floats(0, 300))
def test_fill(parts, budget):
    weights, capacities = zip(*parts)
    given_ = _fill(list(weights), list(capacities), budget)
    assert all(-1e-6 <= g <= c + 1e-6 for g, c in zip(given_, capacities))
    assert abs(sum(given_) - min(budget, sum(capacities))) < 1e-5
    # where nothing is full the shares are the weights'
    if all(g < c - 1e-6 for g, c in zip(given_, capacities)) and budget > 1e-3:
        assert all(abs(g / budget - w / sum(weights)) < 1e-6 for g, w in zip(given_, weights))


def test_siblings_come_before_ancestors():
    leaves = [Leaf("a", "en", "x", 10, 1, 0.25), Leaf("a", "en", "y", 1000, 1, 0.25), Leaf("b", "en", "z", 1000, 1, 0.5)]
    budgets(leaves, 100)
    assert [round(x.budget, 6) for x in leaves] == [10, 40, 50]
    leaves = [Leaf("a", "en", "x", 10, 1, 0.25), Leaf("a", "de", "y", 20, 1, 0.25), Leaf("b", "en", "z", 1000, 1, 0.5)]
    budgets(leaves, 100)
    assert [round(x.budget, 6) for x in leaves] == [10, 20, 70]


def test_absent_sources_and_exact_size():
    leaves = plan_leaves([("lab_notebook", "en", 100), ("lab_notebook", "de", 50), ("forum", "en", 1000)], [("lab_notebook", 0.5, 2), ("forum", 0.3, 1), ("textbook", 0.2, 1)], {"lab_notebook": "laboratory", "forum": "exchange", "textbook": "print"})
    total = exact_total(leaves)
    assert 0 < total <= 600 + 1
    budgets(leaves, total)
    assert sum(x.budget for x in leaves if x.source == "lab_notebook") >= 0.5 * total * (1 - 1e-5)


def tables(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["forum"] * 6 + ["manual", "preprint", None]), rng.choice(["en", "EN", "de", None]), rng.choice([0, 5, 50, 120])) for i in range(3000)]
    docs += [(5000, "safety_sheet", "en", 40), (5001, "safety_sheet", "en", 60)]
    targets = [("p", "forum", 0.5, 1), ("p", "manual", 0.25, 3), ("p", "safety_sheet", 0.15, 4), ("p", "textbook", 0.1, 9), ("q", "manual", 1.0, 2)]
    return spark.createDataFrame(docs, "doc_id bigint, source string, lang string, n_tokens bigint"), spark.createDataFrame(targets, "mix_plan string, source string, target_share double, max_repeats int")


def test_mix_keeps_caps_and_size(spark):
    docs, targets = tables(spark)
    caps = {(r["mix_plan"], r["source"]): r["max_repeats"] for r in targets.collect()}
    for total in (2_000, 30_000):
        out = mix(docs, planned(docs, targets, total_tokens=total)).collect()
        assert all(1 <= r["n_used"] <= caps[r["mix_plan"], r["source"]] for r in out)
        assert len({(r["mix_plan"], r["doc_id"]) for r in out}) == len(out)
        used = sum(r["n_tokens"] * r["n_used"] for r in out if r["mix_plan"] == "p")
        assert abs(used - total) < 700
        assert all(r["n_tokens"] > 0 for r in out)
    exact = planned(docs, targets, policy="exact")
    by = {(r["mix_plan"], r["source"]): r for r in shares(mix(docs, exact), targets, exact).collect()}
    assert abs(by["p", "forum"]["actual_share"] - 0.5) < 0.12 and by["p", "textbook"]["actual_share"] == 0.0 and by["q", "manual"]["actual_share"] == 1.0
    small = {r["doc_id"]: r["n_used"] for r in mix(docs, planned(docs, targets, total_tokens=30_000)).where("source = 'safety_sheet' and mix_plan = 'p'").collect()}
    assert small == {5000: 4, 5001: 4}


def test_mix_does_not_depend_on_partitions(spark):
    docs, targets = tables(spark)
    key = lambda df: sorted(tuple(r) for r in df.select("mix_plan", "doc_id", "n_used").collect())
    assert key(mix(docs, planned(docs, targets))) == key(mix(docs.repartition(9), planned(docs, targets)))


def test_nothing_to_mix(spark):
    docs, targets = tables(spark)
    none, no_targets = planned(docs.where("false"), targets), planned(docs, targets.where("false"))
    assert mix(docs.where("false"), none).count() == 0 and mix(docs, no_targets).count() == 0
    assert shares(mix(docs.where("false"), none), targets, none).where("tokens > 0").count() == 0


def test_a_total_of_one_plan(spark):
    docs, targets = tables(spark)
    plans = planned(docs, targets, totals={"q": 5_000}, total_tokens=20_000)
    assert [round(sum(x.budget for x in plans[p])) for p in "pq"] == [20_000, 5_000]
    used = {r["mix_plan"]: r["tokens"] for r in shares(mix(docs, plans), targets, plans).groupBy("mix_plan").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "tokens").collect()}
    assert abs(used["p"] - 20_000) < 700 and abs(used["q"] - 5_000) < 500


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_shares_of_the_delivered_tables(spark, sf):
    path = f"/root/testdata/{sf}"
    if not os.path.isdir(path) or not os.path.exists("/opt/tokenizers/byte_bpe_50k.json"):
        pytest.skip("no test tables here")
    sized = q._sized(spark, path)
    targets = spark.read.parquet(f"{path}/mix_targets.parquet")
    plans = planned(sized, targets, policy="exact", domains=q.DOMAINS)
    largest = {r["source"]: r["n"] for r in sized.groupBy("source").agg({"n_tokens": "max"}).withColumnRenamed("max(n_tokens)", "n").collect()}
    for r in shares(mix(sized, plans), targets, plans).collect():
        budget = sum(x.budget for x in plans[r["mix_plan"]] if x.source == r["source"])
        leaves = sum(x.source == r["source"] and x.tokens > 0 for x in plans[r["mix_plan"]])
        # documents are used whole: less than one document's tokens in each language
        assert abs(r["tokens"] - budget) <= leaves * largest.get(r["source"], 0) and r["most_used"] <= r["max_repeats"]
        if sf == "sf0.1" and r["tokens"]:
            assert abs(r["actual_share"] - r["planned_share"]) < 0.005 and r["planned_share"] >= r["target_share"] - 1e-4
