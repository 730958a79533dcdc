"""Exact duplicates: first-seen deduplication, duplicate groups and their relation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions.text import shown, sorted_distinct, stable_hash, truthy


def first_seen(df: DataFrame, keys: Sequence[str], order: str = "_ord") -> DataFrame:
    """The first row of each key in the order of arrival; null is a key like any other.

    A ``min_by`` aggregate, combined on the map side: a key that holds a third of all rows is
    folded where its rows lie, with no window over it. Ties in ``order`` are broken by a hash of the row's
    other columns; rows that tie in it too are equal.
    """
    whole = F.struct(*[c for c in df.columns if c not in keys])
    tie = F.xxhash64(F.to_json(whole))
    kept = df.groupBy(*keys).agg(F.min_by(whole, F.struct(F.col(order), tie.alias("tie"))).alias("__row"))
    return kept.select(*keys, "__row.*").select(*df.columns)


def with_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``first_seen`` rows kept and removed: one row (n_rows, n_kept, n_removed)."""
    by = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"), F.count(F.lit(1)).alias("n_kept")).withColumn("n_removed", F.col("n_rows") - F.col("n_kept"))


def duplicate_groups(df: DataFrame, example_ids: int = 10) -> DataFrame:
    """One row per ``peak_identity_hash``: size, relation, distinct values and the first ids in order.

    ``example_spectrum_ids`` has the ids of the least ``example_ids`` (_ord, id) pairs, null ids too. A
    group limit keeps that many rows of a group where they lie, so a hot group isn't gathered. With
    0 there is no such column, and no second aggregation.
    """
    energy = F.struct(F.col("energy.raw"), F.col("energy.value"), F.col("energy.unit"), F.col("energy.status"))
    missing = (F.col("energy.status") == "missing") | (truthy(F.col("instrument")).isNull() & truthy(F.col("instrument_type")).isNull())
    unknown = lambda c: F.coalesce(truthy(F.col(c)), F.lit("unknown"))
    # only whether there is more than one value counts: least and greatest hash, so no row is expanded for a distinct count
    several = lambda c: F.min(F.xxhash64(c)) != F.max(F.xxhash64(c))
    by = df.groupBy("peak_identity_hash").agg(
        F.count(F.lit(1)).alias("duplicate_group_size"),
        several(F.col("acquisition_record_hash")).alias("many_records"),
        several(energy).alias("many_energies"),
        several(F.struct("instrument", "instrument_type")).alias("many_instruments"),
        several(shown(F.col("source"))).alias("many_sources"),
        F.bool_or(missing).alias("some_missing"),
        sorted_distinct(unknown("source")).alias("sources"),
        sorted_distinct(unknown("structure_id")).alias("structure_ids"),
        sorted_distinct(unknown("connectivity_id")).alias("connectivity_ids"),
        sorted_distinct(shown(F.col("energy.raw"))).alias("energy_values"),
        sorted_distinct(shown(F.coalesce(truthy(F.col("instrument")), F.col("instrument_type")))).alias("instrument_values"),
        F.min("_ord").alias("first_ord"),
    )
    relation = (
        F.when(F.col("duplicate_group_size") == 1, "unique")
        .when(~F.col("many_records"), "removable_exact_duplicate")
        .when(F.col("many_energies"), "same_peaks_different_collision_energy")
        .when(F.col("many_instruments"), "same_peaks_different_instrument")
        .when(F.col("many_sources"), "cross_source_peak_duplicate")
        .when(F.col("some_missing"), "missing_acquisition_metadata")
        .otherwise("same_source_acquisition_duplicate_candidate")
    )
    if example_ids:
        place = F.row_number().over(Window.partitionBy("peak_identity_hash").orderBy("_ord", "spectrum_id"))
        firsts = df.select("peak_identity_hash", "_ord", "spectrum_id").withColumn("place", place).where(F.col("place") <= example_ids)
        pairs = F.array_sort(F.collect_list(F.struct("place", "spectrum_id")))
        firsts = firsts.groupBy("peak_identity_hash").agg(F.transform(pairs, lambda x: x["spectrum_id"]).alias("example_spectrum_ids"))
        by = by.join(firsts, "peak_identity_hash")
    return by.withColumn("duplicate_relation", relation).withColumn("duplicate_group_id", stable_hash("dup", F.lit("duplicate_group:v1"), F.col("peak_identity_hash")))


def stamp_groups(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with their group's id, size and relation."""
    return df.join(groups.select("peak_identity_hash", "duplicate_group_id", "duplicate_group_size", "duplicate_relation"), "peak_identity_hash")
