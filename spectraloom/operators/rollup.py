"""Roll-ups of spectra by structure, modal values in order of appearance, histograms and count tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions import rules
from spectraloom.functions.normalize import formula_counts, formula_key
from spectraloom.functions.text import sorted_distinct, truthy


def structure_rollup(spectra_df: DataFrame, key: str = "structure_id") -> DataFrame:
    """One row per structure: scalars of its first row, sorted distinct values, resolved and unresolved counts."""
    filled = lambda c: sorted_distinct(truthy(F.col(c)))
    first = F.min_by(F.struct("connectivity_id", "smiles", "spectrum_id"), "_ord")
    out = spectra_df.groupBy(key).agg(
        first.alias("first"), filled("smiles").alias("smiles_values"), sorted_distinct(F.col("identifier.full_key")).alias("full_keys"), sorted_distinct(F.col("identifier.connectivity_key")).alias("connectivity_keys"),
        filled("formula").alias("formulas"), sorted_distinct(formula_key(formula_counts(F.col("formula")))).alias("formula_keys"), filled("source").alias("sources"), filled("license").alias("licenses"),
        filled("lipid_class").alias("lipid_classes"), sorted_distinct(F.coalesce(F.col("adduct"), F.lit("unknown"))).alias("adducts"), sorted_distinct(F.coalesce(F.col("polarity"), F.lit("unknown"))).alias("polarities"),
        sorted_distinct(F.col("energy.raw")).alias("energies"), sorted_distinct(F.coalesce(truthy(F.col("instrument")), truthy(F.col("instrument_type")))).alias("instruments"), filled("name").alias("names"),
        F.count(F.lit(1)).alias("n_spectra"), F.count_if(F.col("lipid_class") != rules.UNRESOLVED).alias("n_resolved"),
    )
    return out.select(key, "first.connectivity_id", F.col("first.smiles").alias("first_smiles"), F.col("first.spectrum_id").alias("first_spectrum_id"), *[c for c in out.columns if c not in (key, "first")], (F.col("n_spectra") - F.col("n_resolved")).alias("n_unresolved"))


def modal_value(df: DataFrame, key: str, value: str, order: str = "_ord") -> DataFrame:
    """(key, value, n, n_rows): the most frequent value of each key; of equally frequent ones the first to appear.

    Two map-side combined aggregates; null is a value like any other.
    """
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("at"))
    best = counts.groupBy(key).agg(F.max_by(F.struct(F.col(value).alias("v"), F.col("n").alias("n")), F.struct("n", -F.col("at"))).alias("b"), F.sum("n").alias("n_rows"))
    return best.select(key, F.col("b.v").alias(value), F.col("b.n").alias("n"), "n_rows")


def histograms(df: DataFrame, columns: Sequence[str], order: str = "_ord", missing: str = "unknown") -> DataFrame:
    """(field, value, n, rank) of several columns in one pass; rank by count, then by first appearance.

    Null and empty values count as ``missing``. Columns are unpivoted inside the row and combined on the
    map side, so the shuffle carries one row per value and task. Ranks are set over the distinct values of each field:
    a value's rank is its place among those of its magnitude (count's power of two) plus the number of values in higher ones.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(truthy(F.col(c).cast("string")), F.lit(missing)).alias("value")) for c in columns])
    counts = df.select(F.explode(pairs).alias("p"), F.col(order).alias("at")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    # the values of a magnitude are cut once more by first appearance where they are most: those that stand once
    size = F.floor(F.log2("n")).cast("int")
    part = F.floor(F.col("at") / F.lit(1_000_000)).cast("bigint")
    counts = counts.withColumn("size", size).withColumn("part", F.when(F.col("n") == 1, part).otherwise(F.lit(0)))
    sizes = counts.groupBy("field", "size", "part").agg(F.count(F.lit(1)).alias("k"))
    above = sizes.withColumn("above", F.sum("k").over(Window.partitionBy("field").orderBy(F.desc("size"), "part")) - F.col("k")).drop("k")
    local = F.row_number().over(Window.partitionBy("field", "size", "part").orderBy(F.desc("n"), "at"))
    ranked = counts.withColumn("local", local).join(above, ["field", "size", "part"])
    return ranked.select("field", "value", "n", (F.col("local") + F.col("above")).cast("bigint").alias("rank"))


def distinct_first(df: DataFrame, *columns: str) -> DataFrame:
    """One row: the number of distinct first filled values of ``columns``; rows without any count as one value."""
    value = F.coalesce(*[truthy(F.col(c).cast("string")) for c in columns])
    return df.agg((F.count_distinct(value) + F.max(value.isNull().cast("int"))).alias("n_distinct"))


def counts_from_two(left: DataFrame, right: DataFrame, key: Column, names: tuple[str, str]) -> DataFrame:
    """Counts by a key in two tables, full outer: keys of either side, 0 where the other has none; null is the key "None"."""
    text = F.coalesce(key.cast("string"), F.lit("None"))
    a = left.groupBy(text.alias("key")).agg(F.count(F.lit(1)).alias(names[0]))
    b = right.groupBy(text.alias("key")).agg(F.count(F.lit(1)).alias(names[1]))
    return a.join(b, "key", "full_outer").select("key", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def largest_groups(df: DataFrame, key: str, item: str, most: int = 20) -> DataFrame:
    """The ``most`` keys with the most distinct items, above one item; ties by key. A top-k report."""
    return df.groupBy(key).agg(F.count_distinct(item).alias("n_items"), F.count(F.lit(1)).alias("n_rows")).where("n_items > 1").orderBy(F.desc("n_items"), key).limit(most)
