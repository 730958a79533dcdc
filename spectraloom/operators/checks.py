"""Checks of delivered tables against each other: references, sums, partitions, versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def referential_checks(child: DataFrame, parent: DataFrame, keys: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(check, n_missing, n_null) of each named (child column, parent column): rows that refer to nothing, and rows without a reference.

    Distinct references are looked up by anti-joins, so a reference that many rows share is looked up once.
    """
    out = None
    for name, (column, target) in keys.items():
        known = parent.select(F.col(target).alias("k")).where("k is not null").distinct()
        asked = child.groupBy(F.col(column).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        missing = asked.where("k is not null").join(known, "k", "left_anti").select("n", F.lit(0).cast("bigint").alias("z"))
        nulls = asked.where("k is null").select(F.lit(0).cast("bigint").alias("n"), F.col("n").alias("z"))
        row = missing.unionByName(nulls).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_missing"), F.coalesce(F.sum("z"), F.lit(0)).cast("bigint").alias("n_null"))
        row = row.select(F.lit(name).alias("check"), "n_missing", "n_null")
        out = row if out is None else out.unionByName(row)
    return out


def require_references(checks: DataFrame) -> None:
    """Raises when a row of ``referential_checks`` has missing references."""
    bad = checks.where("n_missing > 0").collect()  # one row for each check
    if bad:
        raise ValueError("; ".join(f"{r['check']}: {r['n_missing']} rows refer to nothing" for r in bad))


def same_rows(whole: DataFrame, parts: Sequence[DataFrame]) -> DataFrame:
    """One row (n_whole, n_parts, n_lost, n_added): whether the parts together hold the whole's rows, each as often.

    Rows are counted by their values on both sides, once: what the difference of the counts loses or adds.
    """
    both = whole.select("*", F.lit(1).alias("__w"), F.lit(0).alias("__p"))
    for part in parts:
        both = both.unionByName(part.select(*whole.columns).select("*", F.lit(0).alias("__w"), F.lit(1).alias("__p")))
    counts = both.groupBy(*whole.columns).agg(F.sum("__w").alias("w"), F.sum("__p").alias("p"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return counts.agg(total(F.col("w")).alias("n_whole"), total(F.col("p")).alias("n_parts"), total(F.greatest(F.col("w") - F.col("p"), F.lit(0))).alias("n_lost"), total(F.greatest(F.col("p") - F.col("w"), F.lit(0))).alias("n_added"))


def ordered_union(sources: Sequence[tuple[str, DataFrame]], order: Sequence[str] | None = None) -> DataFrame:
    """All sources one under the other with ``_ord`` = (rank of the source, its own order): "first" means the first source.

    Each frame is ordered by ``order`` (its columns; None: ``_ord``, which readers set). Missing columns are null.
    """
    out = None
    for rank, (name, df) in enumerate(sources):
        own = F.struct(*[F.col(c).cast("string").alias(f"o{i}") if not isinstance(c, Column) else c.alias(f"o{i}") for i, c in enumerate(order)]) if order else F.col("_ord")
        part = df.withColumn("_ord", F.struct(F.lit(rank).alias("source_rank"), own.alias("place"))).withColumn("_source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def compare_versions(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(change, n): keys added, removed, changed in ``value`` and unchanged between two versions of a table."""
    a, b = old.select(F.col(key).alias("k"), F.col(value).alias("old"), F.lit(True).alias("had")), new.select(F.col(key).alias("k"), F.col(value).alias("new"), F.lit(True).alias("has"))
    change = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return a.join(b, "k", "full_outer").groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


def stable_ids(df: DataFrame, key: str, stored: str, rebuilt: Column) -> DataFrame:
    """One row (n_checked, n_unstable, examples): ids that differ from those computed anew, with at most ten keys."""
    rows = df.select(F.col(key).alias("k"), (~F.col(stored).eqNullSafe(rebuilt)).alias("bad"))
    few = rows.where("bad").orderBy("k").limit(10).agg(F.array_sort(F.collect_list("k")).alias("examples"))
    return rows.agg(F.count(F.lit(1)).alias("n_checked"), F.count_if("bad").alias("n_unstable")).join(F.broadcast(few))  # one row each


def config_conflicts(stored: Mapping[str, object], given: Mapping[str, object], keys: Sequence[str]) -> list[str]:
    """Keys on which a stored configuration and a given one disagree; a key that the given one doesn't state agrees."""
    return [k for k in keys if k in given and given[k] is not None and stored.get(k) != given[k]]


def file_hashes(spark, paths: Sequence[str] | str) -> DataFrame:
    """(path, length, sha256) of whole files, each read in one task."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
