"""Splits that keep related records together.

Records are related when they share an id; sets of related records are the connected components of
the graph whose nodes are the ids. A component's hash gives its place in [0, 1), and ranges of that
place go to the splits so that the rows of each stratum, and of all strata together, come out in proportion.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.components import connected_components

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
SLICES = 256


def hex_id(text: Column) -> Column:
    """The 24 hex digits of an id however written (case, prefix, braces, hyphens, invisible characters), else null.

    A run of one or two different digits (000..., fff...) is a placeholder, as is anything without 24 hex digits.
    """
    plain = F.regexp_replace(F.lower(text), r"[\s\u00a0\u200b\ufeff{}\[\]()<>\"'-]", "")
    # a prefix ends in a separator, or (its hyphen being gone) in a letter that is no hex digit
    found = F.nullif(F.regexp_extract(plain, r"^(?:[a-z]*[g-z]|[a-z]+[_:.=#])?([0-9a-f]{24})$", 1), F.lit(""))
    return F.when(F.size(F.array_distinct(F.split(found, "(?!^)"))) > 2, found)


def related_groups(df: DataFrame, key: str, ids: Sequence[str]) -> DataFrame:
    """(key, group_id, n_ids): the set of related rows of each row, named by its least id.

    ``n_ids`` counts the different ids of the set. A row without any id has a null group and 0 ids:
    it is related to nothing. Repeated rows come out as often as they stand in ``df``.
    """
    rows = df.select(F.col(key).alias("key"), F.array_sort(F.array_distinct(F.array_compact(F.array(*[hex_id(F.col(c)) for c in ids])))).alias("ids"))
    # every pair of a row's ids: its first id with each (a star), loops keep single ids as nodes; few distinct pairs remain
    edges = rows.where(F.size("ids") > 0).select(F.col("ids")[0].alias("u"), F.explode("ids").alias("v")).distinct()
    components = connected_components(edges)
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n_ids"))
    named = components.join(sizes, "component").select(F.col("node").alias("first_id"), F.col("component").alias("group_id"), "n_ids")
    # the id table is far smaller than the rows; a hot id's rows are on the streamed side of an AQE skew join
    out = rows.select("key", F.get("ids", F.lit(0)).alias("first_id")).join(named, "first_id", "left")
    return out.select(F.col("key").alias(key), "group_id", F.coalesce("n_ids", F.lit(0)).cast("bigint").alias("n_ids"))


def _diffuse(cells: pd.DataFrame, proportions: Mapping[str, float]) -> pd.DataFrame:
    """Gives each cell, in its order, to the split that lacks most rows, in its stratum and over all cells so far.

    What one stratum's rounding leaves over is made good by the next, so that proportions hold over all
    rows however small the strata are.
    """
    names, share = list(proportions), np.array(list(proportions.values()), dtype=float)
    got = np.zeros(len(names))
    chosen = []
    for _, stratum in cells.groupby("stratum_no", sort=True):
        own = np.zeros(len(names))
        for w in stratum["w"]:
            lack = share * (own.sum() + w) - own + share * (got.sum() + w) - got
            k = int(np.argmax(lack))
            own[k] += w
            got[k] += w
            chosen.append(names[k])
    return cells.assign(split=chosen)


def assign_splits(rows: DataFrame, key: str, group: str, stratum: Sequence[str], *, proportions: Mapping[str, float] = PROPORTIONS, seed: int = 20260626, slices: int = SLICES) -> DataFrame:
    """(key, group, split): all rows of a group in one split, each stratum's rows in proportion.

    A group's stratum is that of most of its rows (ties: the least). A stratum's groups fall by hash into
    ``slices`` ranges of each size class (powers of two); a range goes as a whole to the split that
    lacks most rows, the largest strata and classes first, and what rounding leaves over in one stratum
    is carried to the next. Ranges are aggregated before they are put in order: one task sees at most
    strata x size classes (64) x ``slices`` rows, never groups or records. A null group is a group of its
    own row; a row with a null key is kept with its group.
    """
    own = F.coalesce(F.col(group), F.concat(F.lit("row:"), F.coalesce(F.col(key).cast("string"), F.lit("?"))))
    s = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(c) for c in stratum])
    groups = rows.select(F.col(key).alias("key"), own.alias("g"), F.col(group).alias("had"), F.to_json(s).alias("s"))
    per = groups.groupBy("g", "s").agg(F.count(F.lit(1)).alias("n"))
    main = per.groupBy("g").agg(F.sum("n").alias("rows"), F.min(F.struct((-F.col("n")).alias("n"), "s"))["s"].alias("s"))
    place = F.pmod(F.xxhash64(F.lit(seed), "g"), F.lit(slices)).cast("int")
    main = main.withColumn("class", F.floor(F.log2("rows")).cast("int")).withColumn("slice", place)
    cells = main.groupBy("s", "class", "slice").agg(F.sum("rows").alias("w"))

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.groupby("s")["w"].sum()
        order = {name: i for i, name in enumerate(sorted(sizes.index, key=lambda x: (-sizes[x], x)))}
        pdf = pdf.assign(stratum_no=pdf["s"].map(order)).sort_values(["stratum_no", "class", "w", "slice"], ascending=[True, False, False, True])
        return _diffuse(pdf, proportions)[["s", "class", "slice", "split"]]

    ranges = cells.groupBy(F.lit("all").alias("whole")).applyInPandas(spread, "s string, class int, slice int, split string")
    by_group = main.join(ranges, ["s", "class", "slice"]).select("g", "split")
    return groups.join(by_group, "g").select(F.col("key").alias(key), F.col("had").alias(group), "split")
