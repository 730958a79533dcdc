"""Stratified splits over groups, counts exact to the group: the declarative form of round-robin allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions.text import sorted_distinct


def group_strata(rows: DataFrame, group: str, parts: dict[str, str]) -> DataFrame:
    """(group, stratum): the "+"-joined distinct values of each part of a group, written as one key."""
    agg = rows.groupBy(group).agg(*[F.array_join(sorted_distinct(F.col(c)), "+").alias(n) for n, c in parts.items()])
    key = F.concat(F.lit("('"), F.array_join(F.array(*[F.col(n) for n in parts]), "', '"), F.lit("')"))
    return agg.select(group, key.alias("stratum"))


def stratum_targets(groups: DataFrame, validation: float = 0.1, test: float = 0.1, small: int = 10) -> DataFrame:
    """(stratum, n, validation, test, train): groups of each stratum that go to each split.

    A stratum's share is rounded down, and 0 below ``small`` groups. What is missing to the whole's share
    is handed out one by one in passes, to the greatest remainders first; what is too much is taken back
    from the least. Passes are rows (``explode(sequence)``) that are ranked, so no loop runs on the driver.
    The table has one row per stratum; passes per stratum are bounded by the whole's deficit.
    """
    sizes = groups.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    wanted = total.select("total", F.bround(F.col("total") * (1 - validation - test), 0).cast("bigint").alias("w_train"), F.bround(F.col("total") * validation, 0).cast("bigint").alias("w_validation"))
    wanted = wanted.withColumn("w_test", F.col("total") - F.col("w_train") - F.col("w_validation")).drop("total")
    base = lambda r: F.when(F.col("n") >= small, F.floor(F.col("n") * F.lit(r))).otherwise(0).cast("bigint")
    # the totals are one row
    table = sizes.withColumn("validation", base(validation)).withColumn("test", base(test)).join(F.broadcast(wanted))
    for split, share in (("validation", validation), ("test", test)):
        rest = F.col("n") * F.lit(share) - F.floor(F.col("n") * F.lit(share))
        other = "test" if split == "validation" else "validation"
        given = table.withColumn("__gap", F.col(f"w_{split}") - F.sum(split).over(Window.partitionBy()))
        capacity = F.least(F.when(F.col("__gap") > 0, F.col("n") - F.col("validation") - F.col("test")).otherwise(F.col(split)), F.abs("__gap"))
        passes = given.select("stratum", "n", "__gap", F.explode(F.when(capacity > 0, F.sequence(F.lit(1).cast("bigint"), capacity)).otherwise(F.array().cast("array<bigint>"))).alias("step"))
        sign = F.when(F.col("__gap") > 0, -1).otherwise(1)
        order = Window.orderBy("step", sign * rest, sign * F.col("n"), "stratum")
        chosen = passes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.abs("__gap")).groupBy("stratum").agg((F.count(F.lit(1)) * F.first(F.when(F.col("__gap") > 0, 1).otherwise(-1))).alias("change"))
        table = given.join(chosen, "stratum", "left").withColumn(split, F.col(split) + F.coalesce("change", F.lit(0))).select("stratum", "n", split, other, "w_train", "w_validation", "w_test")
    return table.select("stratum", "n", "validation", "test", (F.col("n") - F.col("validation") - F.col("test")).alias("train"))


def assign(groups: DataFrame, targets: DataFrame, group: str, seed: int = 20260626) -> DataFrame:
    """(group, stratum, split): within a stratum, in the order of a seeded hash, first validation, then test, the rest train.

    A group's number is its rank inside its hash slice (the hash's first three hex digits) plus the groups in the
    slices before it, which are counted: a task ranks a 4096th of a stratum, and orders 4096 counts for each.
    """
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")), 256)
    rows = groups.withColumn("hash", hashed).withColumn("slice", F.substring("hash", 1, 3))
    counts = rows.groupBy("stratum", "slice").agg(F.count(F.lit(1)).alias("n_in"))
    before = counts.withColumn("before", F.sum("n_in").over(Window.partitionBy("stratum").orderBy("slice")) - F.col("n_in")).drop("n_in")
    rank = F.row_number().over(Window.partitionBy("stratum", "slice").orderBy("hash", group))
    numbered = rows.withColumn("rank", rank).join(before, ["stratum", "slice"]).withColumn("at", F.col("rank") + F.col("before")).join(targets, "stratum")
    split = F.when(F.col("at") <= F.col("validation"), "validation").when(F.col("at") <= F.col("validation") + F.col("test"), "test").otherwise("train")
    return numbered.select(group, "stratum", split.alias("split"))


def split_counts(rows: DataFrame, assigned: DataFrame, group: str, value: str) -> DataFrame:
    """(value, split, n_groups, n_rows) of rows with their group's split; rows of a group without one count as split "unassigned"; empty cells are left out."""
    placed = rows.join(assigned.select(group, "split"), group, "left").withColumn("split", F.coalesce("split", F.lit("unassigned")))
    return placed.groupBy(F.coalesce(F.col(value).cast("string"), F.lit("None")).alias("value"), "split").agg(F.count_distinct(group).alias("n_groups"), F.count(F.lit(1)).alias("n_rows"))


def leakage(rows: DataFrame, assigned: DataFrame, group: str, item: str) -> DataFrame:
    """(left_split, right_split, n_shared) for every pair of splits: items that stand in both; 0 where none does.

    Items are first reduced to their set of splits (at most three), so no pair of rows is ever made.
    """
    sets = rows.join(assigned.select(group, "split"), group).where(F.col(item).isNotNull()).groupBy(item).agg(F.array_sort(F.collect_set("split")).alias("s"))
    pairs = [("train", "validation"), ("test", "train"), ("test", "validation")]
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("left_split"), F.lit(b).alias("right_split"), (F.array_contains("s", a) & F.array_contains("s", b)).cast("bigint").alias("both")) for a, b in pairs]))
    return sets.select(each.alias("p")).groupBy("p.left_split", "p.right_split").agg(F.sum("p.both").alias("n_shared"))
