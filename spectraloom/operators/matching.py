"""Tiered matching against a reference catalogue, with its reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiered_match(items: DataFrame, references: DataFrame, key: str, ref_key: str, tiers: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """(key, tier, key_position, matched_key, ref_ids): all references of the first tier and first key that hit.

    ``tiers`` has (name, array of the item's keys in order, the reference's key). Each tier is an equi-join
    on its exploded keys; the union of the hits is reduced with one ``min`` per item over (tier, position),
    so a later tier never hides an earlier one and nothing is looked up or read twice. Null keys hit nothing; items
    without a hit are left out (``unmatched`` has them). References come out in their own order, once each.
    """
    hits = None
    for at, (name, item_keys, reference_key) in enumerate(tiers):
        left = items.select(F.col(key).alias("item"), F.posexplode(item_keys).alias("position", "k"))
        right = references.select(F.col(ref_key).alias("ref"), reference_key.alias("k")).where("k is not null")
        tier = left.join(right, "k").select("item", F.lit(at).alias("rank"), F.lit(name).alias("tier"), "position", "k", "ref")
        hits = tier if hits is None else hits.unionByName(tier)
    each = hits.groupBy("item", "rank", "tier", "position", "k").agg(F.array_sort(F.collect_set("ref")).alias("ref_ids"))
    best = each.groupBy("item").agg(F.min_by(F.struct("tier", "position", "k", "ref_ids"), F.struct("rank", "position", "k")).alias("b"))
    return best.select(F.col("item").alias(key), "b.tier", F.col("b.position").alias("key_position"), F.col("b.k").alias("matched_key"), "b.ref_ids")


def tier_hits(items: DataFrame, references: DataFrame, key: str, tiers: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """(key, one boolean per tier): whether any of the item's keys hits in that tier, tiers not excluding each other."""
    out = items.select(key)
    for name, item_keys, reference_key in tiers:
        hit = items.select(F.col(key).alias("item"), F.explode(item_keys).alias("k")).join(references.select(reference_key.alias("k")).where("k is not null").distinct(), "k", "left_semi").select(F.col("item").alias(key)).distinct().withColumn(f"hit_{name}", F.lit(True))
        out = out.join(hit, key, "left").withColumn(f"hit_{name}", F.coalesce(f"hit_{name}", F.lit(False)))
    return out


def unmatched(items: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Items without a match."""
    return items.join(matches.select(key), key, "left_anti")


def flags(*conditions: tuple[str, Column]) -> Column:
    """Array of the labels whose condition holds, in order; null conditions don't hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(label)) for label, c in conditions]))


def first_usable(*columns: str) -> Column:
    """Struct (value, column) of the first column that holds more than a stand-in ("N/A", "NA", "None", "null", blank)."""
    usable = [F.when(~F.upper(F.trim(F.col(c))).isin("", "N/A", "NA", "NONE", "NULL"), F.struct(F.col(c).alias("value"), F.lit(c).alias("column"))) for c in columns]
    return F.coalesce(*usable, F.struct(F.lit(None).cast("string").alias("value"), F.lit("missing").alias("column")))


def decision_list(rules: Sequence[tuple[Column, Sequence[Column | str]]], names: Sequence[str], default: Sequence[Column | str]) -> Column:
    """A struct of named outcomes of the first rule whose condition holds; conditions that are null don't hold."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    make = lambda values: F.struct(*[lit(v).alias(n) for v, n in zip(values, names)])
    chain = None
    for condition, values in rules:
        chain = F.when(condition, make(values)) if chain is None else chain.when(condition, make(values))
    return chain.otherwise(make(default)) if chain is not None else make(default)


def conflicts(df: DataFrame, group: str, value: str) -> DataFrame:
    """Groups that hold more than one value: (group, values, n_rows), as they were before any override."""
    return df.groupBy(group).agg(F.array_sort(F.collect_set(value)).alias("values"), F.count(F.lit(1)).alias("n_rows")).where(F.size("values") > 1)


def override_conflicts(df: DataFrame, group: str, value: str, override: str) -> DataFrame:
    """``df`` with ``override`` as the value of every row in a conflicting group."""
    bad = conflicts(df, group, value).select(group, F.lit(True).alias("__conflict"))
    return df.join(bad, group, "left").withColumn(value, F.when(F.col("__conflict"), F.lit(override)).otherwise(F.col(value))).drop("__conflict")
