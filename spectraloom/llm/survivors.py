"""Best representative of each duplicate group.

Two spectra are the same measurement when their usable peaks agree in m/z and, after scaling to the
strongest peak, in intensity; the copies may be rounded, rescaled, reordered or lack their weakest
peaks. Candidates meet in cells of the sorted relative intensities and the strongest peak's m/z; a
candidate pair stands only after all its peaks were compared. One record per group is then built
field by field in a single aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.text import let
from spectraloom.llm.components import connected_components
from spectraloom.session import cut

#: Tolerances: m/z as typed with two decimals against more, intensity on a scale of 999 steps.
MZ_TOL, REL_TOL = 0.0056, 0.0006
#: Peaks below this share of the strongest may be missing in a copy.
WEAK = 0.02
MZ_CELL, REL_CELL = 0.05, 0.004
#: Keys of a cell that one task compares with the whole cell.
HEAVY = 1_000

#: Texts that stand for a value that isn't there.
STAND_INS = ["", "-", "?", "n/a", "na", "n.d.", "none", "null", "unknown", "not recorded", "not given", "see title", "see methods", "tbd"]

#: Sources, the most trusted first (a parameter of ``survivors``).
TRUST = ["MassBank-data", "MoNA", "GNPS", "PNNL-lipids", "HCE-lysate", "IOBA-NHC", "local-MGF"]


def usable_peaks(peaks: Column) -> Column:
    """array<struct<rel, mz>>, strongest first: finite, positive m/z and intensity, scaled to the strongest peak; repeats of a peak count once."""
    ok = F.filter(peaks, lambda p: (F.size(p) == 2) & F.coalesce((p[0] > 0) & (p[1] > 0) & (p[0] < 1e9) & (p[1] < 1e300) & ~F.isnan(p[0]) & ~F.isnan(p[1]), F.lit(False)))
    none = F.array().cast("array<struct<rel:double,mz:double>>")
    scaled = lambda k, top: F.reverse(F.array_sort(F.array_distinct(F.transform(k, lambda p: F.struct((p[1] / top).alias("rel"), p[0].alias("mz"))))))
    return F.coalesce(let(ok, lambda k: let(F.array_max(F.transform(k, lambda p: p[1])), lambda top: scaled(k, top))), none)


def _cells(value: Column, width: float, tolerance: float) -> Column:
    """The cells that an interval of the tolerance around the value touches: two values within it share one."""
    low, high = F.floor((value - tolerance / 2) / width), F.floor((value + tolerance / 2) / width)
    return F.array_distinct(F.array(low, high))


def _rank_cells(peaks: Column, rank: int) -> Column:
    """Cells of the ``rank``-th relative intensity; a peak that may be missing in a copy is also 'none' (-1)."""
    rel = F.coalesce(F.get(peaks, F.lit(rank))["rel"], F.lit(0.0))
    edge = 1.1 * REL_TOL
    return F.when(rel < WEAK - edge, F.array(F.lit(-1).cast("bigint"))).when(rel <= WEAK + edge, F.array_union(_cells(rel, REL_CELL, REL_TOL), F.array(F.lit(-1).cast("bigint")))).otherwise(_cells(rel, REL_CELL, REL_TOL))


def same_spectrum(a: Column, b: Column) -> Column:
    """Whether every peak of either list that can't be missing has its like in the other list."""
    like = lambda x, y: (F.abs(x["mz"] - y["mz"]) <= MZ_TOL) & (F.abs(x["rel"] - y["rel"]) <= REL_TOL)
    covered = lambda p, q: F.forall(p, lambda x: (x["rel"] < WEAK + REL_TOL) | F.exists(q, lambda y: like(x, y)))
    fewer = F.least(F.size(a), F.size(b))
    # of the shorter list nothing is missing: all its peaks, weak ones too, are in the longer
    all_in = lambda p, q: F.forall(p, lambda x: F.exists(q, lambda y: like(x, y)))
    return (fewer >= 2) & covered(a, b) & covered(b, a) & F.when(F.size(a) <= F.size(b), all_in(a, b)).otherwise(all_in(b, a))


def rounded(peaks: Column) -> Column:
    """The form in which exact copies are equal."""
    return F.array_sort(F.transform(peaks, lambda x: F.struct(F.round(x["mz"], 2).alias("mz"), F.round(x["rel"], 3).alias("rel"))))


def _cell_keys(reps: DataFrame) -> DataFrame:
    """(cell, k): the cells of each spectrum (k, p); copies share at least one.

    A cell is the strongest peak's m/z and the next three relative intensities. Where there is no third
    peak, the second one's m/z is part of it too, so that spectra of two peaks don't all meet.
    """
    near = lambda rel: F.filter("p", lambda x: F.abs(x["rel"] - rel) <= 2 * REL_TOL)
    mz_cells = lambda peaks: F.array_distinct(F.flatten(F.transform(peaks, lambda x: _cells(x["mz"], MZ_CELL, MZ_TOL))))
    strongest = mz_cells(F.filter("p", lambda x: x["rel"] >= 1 - REL_TOL))
    second = mz_cells(near(F.coalesce(F.get("p", F.lit(1))["rel"], F.lit(0.0))))
    keyed = reps.withColumn("c0", F.explode(strongest))
    for rank in (1, 2, 3):
        keyed = keyed.withColumn(f"c{rank}", F.explode(_rank_cells(F.col("p"), rank)))
    none = F.array(F.lit(None).cast("bigint"))
    keyed = keyed.withColumn("c4", F.explode(F.when((F.col("c2") == -1) & (F.col("c1") != -1), second).otherwise(none)))
    return keyed.select(F.xxhash64("c0", "c1", "c2", "c3", F.coalesce("c4", F.lit(-1))).alias("cell"), "k").distinct()


def _pairs_in_cells(cells: DataFrame, heavy: int) -> DataFrame:
    """(a, b), a < b: all pairs of keys that share a cell, each once.

    A cell of more than ``heavy`` keys is split: each of its parts meets the whole cell, so that a task
    has a part's comparisons and no pair is lost.
    """
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = cells.join(sizes, "cell").withColumn("parts", F.ceil(F.col("n") / heavy).cast("int"))
    a = sized.select("cell", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int").alias("part"), F.col("k").alias("a"))
    b = sized.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("k").alias("b"))
    return a.join(b, ["cell", "part"]).where("a < b").select("a", "b").distinct()


def _by_serial(rows: DataFrame) -> DataFrame:
    """(u, v): each row without usable peaks with the least row of its serial and contributor whose precursor agrees.

    Rows with peaks come before rows without. What a serial offers is aggregated by precursor first, and a row
    asks only for the neighbouring precursors, so a serial that is repeated often isn't joined with itself.
    """
    named = rows.where("serial <> '' and owner is not null").select("k", "serial", "owner", "precursor", F.col("print").isNotNull().alias("full"))
    least = [F.min(F.when(F.col("full"), F.col("k"))).alias("full_k"), F.min("k").alias("any_k")]
    at = lambda value: F.floor(value * 100)
    by_value = named.groupBy("serial", "owner", "precursor").agg(*least).withColumn("cell", F.coalesce(at(F.col("precursor")), F.lit(-1)))
    whole = named.groupBy("serial", "owner").agg(*least).select("serial", "owner", F.lit(None).cast("double").alias("precursor"), "full_k", "any_k", F.lit(-2).cast("bigint").alias("cell"))
    offers = by_value.select(*whole.columns).unionByName(whole)
    mine = at(F.col("vp"))
    asked = F.when(F.col("vp").isNull(), F.array(F.lit(-2).cast("bigint"))).otherwise(F.array(mine - 1, mine, mine + 1, F.lit(-1).cast("bigint")))
    bare = named.where("not full").select(F.col("k").alias("v"), "serial", "owner", F.col("precursor").alias("vp")).withColumn("cell", F.explode(asked))
    agrees = F.col("precursor").isNull() | F.col("vp").isNull() | (F.abs(F.col("vp") - F.col("precursor")) < 0.01)
    found = bare.join(offers, ["serial", "owner", "cell"]).where(agrees).groupBy("v").agg(F.coalesce(F.min("full_k"), F.min("any_k")).alias("u"))
    return found.where("u <> v").select("u", "v")


def measurement_groups(df: DataFrame, key: str = "row_id", peaks: str = "peaks_raw", record_id: str = "spectrum_id", owner: str = "contributor_id", precursor: str = "precursor_mz", *, heavy: int = HEAVY, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(key, group): rows of one measurement share the group, its least key. Every row of ``df`` comes out once.

    Exact copies (equal peaks after rounding) are linked to the least of them, so a heap of copies is one
    candidate; the fingerprint only brings them together, the peaks decide, and a row that shares a
    fingerprint without being equal is a candidate of its own. Candidates meet by their cells as bare ids;
    peaks are fetched for the pairs that are left. A row without usable peaks is linked by its record's
    serial within its contributor, where precursors agree; without a serial it stands alone. Keys must be unique and not null.
    """
    serial = F.upper(F.regexp_extract(F.upper(F.col(record_id)), r"([A-Z]{2}[0-9]{9})(?![0-9])", 1))
    rows = df.select(F.col(key).alias("k"), usable_peaks(F.col(peaks)).alias("p"), serial.alias("serial"), F.col(owner).alias("owner"), F.col(precursor).cast("double").alias("precursor"))
    rows = cut(rows.withColumn("print", F.when(F.size("p") >= 2, fingerprint(rounded(F.col("p"))))))
    spectra = rows.where("print is not null").select("k", "p")
    # copies: fingerprints that stand more than once, as ids
    prints = rows.where("print is not null").select("k", "print")
    heads = prints.groupBy("print").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    alike = prints.join(heads, "print").where("k <> rep").select(F.col("rep").alias("a"), F.col("k").alias("b"))
    # not written as an equality of both sides: that would be a join key, computed for all rows and sorted by
    equal = lambda x, y: F.coalesce(F.forall(F.zip_with(rounded(x), rounded(y), lambda a, b: a == b), lambda t: t), F.lit(False))
    members = cut(_compared(alike, spectra, equal))
    reps = spectra.join(members.select(F.col("b").alias("k")), "k", "left_anti")
    links = _compared(_pairs_in_cells(cut(_cell_keys(reps)), heavy), spectra, same_spectrum)
    edges = members.unionByName(links).select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(_by_serial(rows.drop("p")))
    components = connected_components(edges)
    return rows.select("k").join(components.withColumnRenamed("node", "k"), "k", "left").select(F.col("k").alias(key), F.coalesce("component", "k").alias("group"))


def _compared(pairs: DataFrame, spectra: DataFrame, same: Callable[[Column, Column], Column]) -> DataFrame:
    """The pairs (a, b) whose peaks are the same. Only the pairs' own peaks are fetched."""
    first, second = spectra.select(F.col("k").alias("a"), F.col("p").alias("ap")), spectra.select(F.col("k").alias("b"), F.col("p").alias("bp"))
    return pairs.join(first, "a").join(second, "b").where(same(F.col("ap"), F.col("bp"))).select("a", "b")


def survivors(df: DataFrame, groups: DataFrame, fields: Sequence[str], *, source: str = "source", at: str = "retrieved_at", key: str = "row_id", trust: Sequence[str] = TRUST) -> DataFrame:
    """One record per group of ``groups`` (key, group), named by the group: (group, n_rows, n_sources, *fields).

    A group of one row must be named by its key (as ``measurement_groups`` does), and comes out as it is.

    Each field is the ``max`` of the struct (filled in, trust in the source, time, key, value): one
    aggregation, combined on the map side, so a hot group is folded where its rows lie. Blank texts and
    stand-ins ("n/a", "-", "unknown", "not recorded", "see title") count as not filled in but survive where
    there is nothing else; arrays are the better the longer; ties go to the greater key. A null or unlisted source is the least trusted.
    """
    # groups of one row are that row: only larger ones are aggregated
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    shared = groups.join(sizes, "group").select(key, F.col("group").alias("__group"))
    rows = df.join(shared, key, "left")
    n_sources = F.col(source).isNotNull().cast("bigint")
    alone = rows.where("__group is null").select(F.col(key).alias("group"), F.lit(1).cast("bigint").alias("n_rows"), n_sources.alias("n_sources"), *fields)
    ranked = {s: len(trust) - i for i, s in enumerate(trust)}
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ranked.items() for x in pair]), F.coalesce(F.col(source), F.lit(""))), F.lit(0))
    types = dict(df.dtypes)

    def filled(c: str) -> Column:
        if types[c] == "string":
            bare = F.lower(F.regexp_replace(F.col(c), r"^[\s\u00a0\u200b]+|[\s\u00a0\u200b]+$", ""))
            return F.when(F.col(c).isNull(), 0).when(bare.isin(*STAND_INS), 1).otherwise(2)
        if types[c].startswith("array"):
            return F.coalesce(F.size(c), F.lit(-1))
        return F.col(c).isNotNull().cast("int")

    order = lambda c: F.struct(filled(c).alias("filled"), rank.alias("trust"), F.col(at).alias("at"), F.col(key).alias("key"), F.col(c).alias("value"))
    best = [F.max(order(c))["value"].alias(c) for c in fields]
    many = rows.where("__group is not null").groupBy(F.col("__group").alias("group")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(source).alias("n_sources"), *best)
    return alone.unionByName(many)
