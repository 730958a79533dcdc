"""Peak lists as array columns: cleaning, features, padding, labels and decoding.

A peak list is array<array<double>> with [m/z, intensity] items; ragged and null items are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spectraloom.functions import rules
from spectraloom.functions.text import let

_EMPTY = "array<struct<mz:double,intensity:double>>"


def _pairs(peaks: Column, ok) -> Column:
    pair = lambda p: F.struct(F.get(p, F.lit(0)).alias("mz"), F.get(p, F.lit(1)).alias("intensity"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    structs = F.transform(F.coalesce(peaks, F.array().cast("array<array<double>>")), pair)
    return F.filter(structs, lambda s: F.coalesce(finite(s["mz"]) & finite(s["intensity"]) & ok(s), F.lit(False)))


def clean_peaks(peaks: Column, least: int = 3) -> Column:
    """Finite peaks with m/z > 0 and intensity >= 0 in their order; an empty list where fewer than ``least`` are left."""
    kept = _pairs(peaks, lambda s: (s["mz"] > 0) & (s["intensity"] >= 0))
    return let(kept, lambda k: F.when(F.size(k) >= least, k).otherwise(F.array().cast(_EMPTY)))


def peak_text(cleaned: Column, mz_digits: int = 4, intensity_digits: int = 6) -> Column:
    """Sorted peaks as one text with fixed decimals: equal for equal peaks in any order."""
    rounded = F.transform(cleaned, lambda p: F.struct(p["mz"].cast(f"decimal(20,{mz_digits})").alias("mz"), p["intensity"].cast(f"decimal(28,{intensity_digits})").alias("intensity")))
    return F.array_join(F.transform(F.array_sort(rounded), lambda p: F.concat(p["mz"].cast("string"), F.lit(":"), p["intensity"].cast("string"))), ";")


def peak_features(peaks: Column, precursor: Column, *, most: int = 200, scale: float = 1000.0, normalised: Column | bool = False) -> Column:
    """array<struct<mz, intensity, delta>> of the ``most`` strongest peaks by m/z; null where no peak is usable.

    Intensity is the root of the share of the strongest peak (taken as it is where ``normalised``). Peaks
    with a negative intensity are dropped; any finite m/z is kept. Equal intensities keep their order.
    A list without a positive intensity, and a null precursor, give null.
    """
    kept = _pairs(peaks, lambda s: s["intensity"] >= 0)
    done = normalised if isinstance(normalised, Column) else F.lit(normalised)

    def scaled(k: Column, top: Column) -> Column:
        numbered = F.transform(k, lambda p, i: F.struct((-F.when(done, p["intensity"]).otherwise(F.sqrt(p["intensity"] / top))).alias("weak"), i.alias("at"), p["mz"].alias("mz")))
        strongest = F.slice(F.array_sort(numbered), 1, most)
        by_mz = F.array_sort(F.transform(strongest, lambda p: F.struct(p["mz"].alias("mz"), p["weak"].alias("rank"), p["at"].alias("at"))))
        rows = F.transform(by_mz, lambda p: F.struct((p["mz"] / scale).alias("mz"), (-p["rank"]).alias("intensity"), ((precursor - p["mz"]) / scale).alias("delta")))
        return F.when((F.size(k) > 0) & (top > 0) & precursor.isNotNull(), rows)

    return let(kept, lambda k: let(F.array_max(F.transform(k, lambda p: p["intensity"])), lambda top: scaled(k, top)))


def pad(features: Column, length: int) -> Column:
    """Struct (values array<array<float>>, mask array<boolean>): ``length`` rows, True in the mask where a row is padding."""
    rows = F.transform(F.coalesce(features, F.array().cast("array<struct<mz:double,intensity:double,delta:double>>")), lambda f: F.array(f["mz"].cast("float"), f["intensity"].cast("float"), f["delta"].cast("float")))
    zero = F.array(*[F.lit(0.0).cast("float")] * 3)
    return let(F.slice(rows, 1, length), lambda r: F.struct(F.concat(r, F.array_repeat(zero, F.lit(length) - F.size(r))).alias("values"), F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: i >= F.size(r)).alias("mask")))


def linkage_name(text: Column) -> Column:
    """A known linkage name, lower case and stripped, else null."""
    clean = F.lower(F.trim(text))
    return F.when(clean.isin(rules.LINKAGES), clean)


def sorted_chains(chains: Column, summary: Column) -> Column:
    """array<struct<carbon, double_bonds, rank, linkage>> by carbons, double bonds and linkage, unknown linkages last.

    The record's summary stands in for a missing linkage only where there is a single chain.
    """
    empty = F.array().cast("array<struct<carbon:int,double_bonds:int,linkage:string>>")
    given = F.coalesce(chains, empty)
    inferred = F.when(F.size(given) == 1, linkage_name(summary))
    rank = lambda l: F.when(l.isNull(), len(rules.LINKAGES)).otherwise(F.array_position(F.array(*[F.lit(x) for x in rules.LINKAGES]), l) - 1).cast("int")  # noqa: E731, E741
    named = F.transform(given, lambda c: F.struct(c["carbon"].alias("carbon"), c["double_bonds"].alias("double_bonds"), F.coalesce(linkage_name(c["linkage"]), inferred).alias("linkage")))
    return F.array_sort(F.transform(named, lambda c: F.struct(c["carbon"].alias("carbon"), c["double_bonds"].alias("double_bonds"), rank(c["linkage"]).alias("rank"), c["linkage"].alias("linkage"))))


def label_index(value: Column, names: list[str]) -> Column:
    """0-based index in a vocabulary; null for other values."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]), value)
    return F.when(at > 0, (at - 1).cast("int"))


def record_labels(headgroup: Column, lipid_class: Column, chains: Column, summary: Column) -> Column:
    """Struct of class indices and masks over two chain slots; ``error`` says why a record can't be encoded.

    Errors: unsupported headgroup, chain count other than 1 or 2, carbons or double bonds out of range.
    Absent slots are 0 and masked out.
    """
    head = label_index(F.coalesce(F.nullif(headgroup, F.lit("")), lipid_class), rules.HEADGROUPS)
    return let(sorted_chains(chains, summary), lambda ordered: _labels(head, ordered))


def _labels(head: Column, ordered: Column) -> Column:
    n = F.size(ordered)
    slot = lambda i: F.get(ordered, F.lit(i))
    within = lambda f, low, high: F.forall(ordered, lambda c: F.coalesce((c[f] >= low) & (c[f] <= high), F.lit(False)))
    error = F.when(head.isNull(), "unsupported headgroup").when((n < 1) | (n > rules.MAX_CHAINS), "unsupported chain count") \
        .when(~within("carbon", rules.MIN_CARBON, rules.MAX_CARBON), "carbon out of range").when(~within("double_bonds", 0, rules.MAX_DOUBLE_BONDS), "double bonds out of range")
    both = lambda make: F.array(*[make(i) for i in range(rules.MAX_CHAINS)])
    present = lambda i: F.lit(i) < n
    linked = lambda i: present(i) & F.coalesce(slot(i)["linkage"].isNotNull(), F.lit(False))
    return F.struct(
        error.alias("error"), head.alias("headgroup"), (n - 1).alias("chain_count"),
        both(lambda i: F.when(present(i), slot(i)["carbon"] - rules.MIN_CARBON).otherwise(0)).alias("carbon"),
        both(lambda i: F.when(present(i), slot(i)["double_bonds"]).otherwise(0)).alias("double_bonds"),
        both(lambda i: F.when(linked(i), slot(i)["rank"]).otherwise(0)).alias("linkage"),
        both(present).alias("chain_mask"), both(linked).alias("linkage_mask"),
    )


def display_name(headgroup: Column, chains: Column) -> Column:
    """"PC(16:0_18:1)" from a headgroup and sorted chains."""
    return F.concat(headgroup, F.lit("("), F.array_join(F.transform(chains, lambda c: F.concat_ws(":", c["carbon"].cast("string"), c["double_bonds"].cast("string"))), "_"), F.lit(")"))


def decoded_chains(carbon: Column, double_bonds: Column, linkage: Column, count: Column) -> Column:
    """The sorted chains of class indices: the first ``count`` slots of three index arrays."""
    names = F.array(*[F.lit(x) for x in rules.LINKAGES])
    slots = F.transform(F.arrays_zip(carbon.alias("c"), double_bonds.alias("d"), linkage.alias("l")), lambda s: F.struct((s["c"] + rules.MIN_CARBON).alias("carbon"), s["d"].alias("double_bonds"), F.get(names, s["l"]).alias("linkage")))
    return sorted_chains(F.slice(slots, 1, count), F.lit(None).cast("string"))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits; an empty array gives an empty one."""
    total = lambda powers: F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return let(F.array_max(logits), lambda top: let(F.transform(logits, lambda x: F.exp(x - top)), lambda powers: let(total(powers), lambda t: F.transform(powers, lambda x: x / t))))


def argmax(values: Column) -> Column:
    """0-based index of the first greatest value; null for null and empty arrays."""
    return F.when(F.size(values) > 0, (F.array_position(values, F.array_max(values)) - 1).cast("int"))


def cross_entropy(logits: Column, target: Column) -> Column:
    """Negative log-likelihood of the 0-based target class."""
    return let(F.array_max(logits), lambda top: F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)) + top - F.get(logits, target))


def masked_mean(loss: Column, mask: Column) -> Column:
    """Aggregate: mean of ``loss`` where ``mask``; exactly 0 where nothing is unmasked."""
    return F.coalesce(F.avg(F.when(mask, loss)), F.lit(0.0))
