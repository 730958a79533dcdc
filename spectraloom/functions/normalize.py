"""Normalisers of record fields, as column expressions: identifiers, adducts, energies, instruments, polarity, formulas, names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from spectraloom.functions import rules
from spectraloom.functions.text import filled, let, truthy


def any_of(patterns: Sequence[str]) -> str:
    """One case-insensitive pattern that hits where any of ``patterns`` does."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def identifier_fields(identifier: Column) -> Column:
    """Struct (raw, full_key, connectivity_key, semantics, n_warnings) of a structure identifier.

    A full key has blocks of 14, 10 and 1 capital letters; 14 letters alone are a connectivity block.
    Null and blank identifiers are "missing", everything else is "unrecognized_identifier".
    """
    raw = filled(identifier)
    token = F.upper(raw)
    full = token.rlike("^[A-Z]{14}-[A-Z]{10}-[A-Z]$")
    block = token.rlike("^[A-Z]{14}$")
    semantics = F.when(raw.isNull(), "missing").when(full, "full_inchikey").when(block, "connectivity_block").otherwise("unrecognized_identifier")
    return F.struct(
        raw.alias("raw"), F.when(full, token).alias("full_key"), F.when(full | block, F.substring(token, 1, 14)).alias("connectivity_key"),
        semantics.alias("semantics"), F.when(raw.isNull() | full, 0).otherwise(1).alias("n_warnings"),
    )


def canonical_adduct(token: Column) -> Column:
    """An adduct token "[body]charge" without white space and with canonical case of its parts; other text only loses its white space."""
    compact = F.regexp_replace(token, r"\s+", "")
    body = F.regexp_replace(F.regexp_extract(compact, r"^\[([^\]]+)\]\d*[+-]$", 1), "^m", "M")
    for part in rules.ADDUCT_PARTS:
        body = F.regexp_replace(body, f"(?i){part}", part)
    return F.when(compact.rlike(r"^\[[^\]]+\]\d*[+-]$"), F.concat(F.lit("["), body, F.lit("]"), F.regexp_extract(compact, r"\](\d*[+-])$", 1))).otherwise(compact)


def adduct_fields(adduct: Column) -> Column:
    """Struct (raw, adduct, status): missing, ion_mode_not_adduct, unparsed or normalized. Only the last has an adduct, else "unknown"."""
    raw = filled(adduct)
    found = truthy(F.regexp_extract(raw, r"(\[[^\]]+\]\d*[+-])", 1))
    status = F.when(raw.isNull(), "missing").when(F.upper(raw).isin(rules.ION_MODES), "ion_mode_not_adduct").when(found.isNull(), "unparsed").otherwise("normalized")
    return F.struct(raw.alias("raw"), F.when(status == "normalized", canonical_adduct(found)).otherwise(F.lit("unknown")).alias("adduct"), status.alias("status"))


def first_adduct(fields: Column) -> Column:
    """Struct (raw, adduct, status, field) from a map of record keys to lists of values.

    Candidates in order of trust: PRECURSOR_TYPE and ION_TYPE of the focused ion, PRECURSOR_TYPE or any
    line that mentions an adduct of the mass-spectrometry block, then bare keys. The first that can be
    normalised stands, else the first candidate, else "missing".
    """
    empty = F.array().cast("array<string>")
    of = lambda key: F.coalesce(F.element_at(fields, key), empty)
    value = lambda x: F.when(x.contains(" "), filled(F.regexp_extract(x, r"(?s)^\S* (.*)$", 1))).otherwise(x)
    tagged = lambda items, label, cut: F.transform(items, lambda x: F.struct(F.lit(label).alias("field"), (value(x) if cut else x).alias("text")))
    focused, spectrum = of("MS$FOCUSED_ION"), of("AC$MASS_SPECTROMETRY")
    groups = [
        tagged(F.filter(focused, lambda x: F.upper(x).startswith("PRECURSOR_TYPE")), "MS$FOCUSED_ION: PRECURSOR_TYPE", True),
        tagged(F.filter(focused, lambda x: F.upper(x).startswith("ION_TYPE")), "MS$FOCUSED_ION: ION_TYPE", True),
        tagged(F.filter(spectrum, lambda x: F.upper(x).startswith("PRECURSOR_TYPE") | F.upper(x).contains("ADDUCT")), "AC$MASS_SPECTROMETRY", True),
        *[tagged(of(k), k, False) for k in ("ADDUCT", "PRECURSOR_TYPE", "ION_TYPE")],
    ]
    parsed = F.transform(F.concat(*groups), lambda c: F.struct(adduct_fields(c["text"]).alias("a"), c["field"].alias("field")))
    first = let(parsed, lambda ps: F.coalesce(F.get(F.filter(ps, lambda p: p["a"]["adduct"] != "unknown"), F.lit(0)), F.get(ps, F.lit(0))))
    return let(first, lambda best: F.struct(best["a"]["raw"].alias("raw"), F.coalesce(best["a"]["adduct"], F.lit("unknown")).alias("adduct"), F.coalesce(best["a"]["status"], F.lit("missing")).alias("status"), best["field"].alias("field")))


def energy_fields(energy: Column) -> Column:
    """Struct (raw, value, unit, status) of an energy as typed: missing, single_value, range_or_compound or free_text.

    A single value without a unit is in eV. Words of a range ("ramp", "to") keep one number from being a single value.
    """
    raw = filled(energy)
    text = F.regexp_replace(raw, "−", "-")
    numbers = F.regexp_extract_all(text, F.lit(r"([-+]?\d+(?:\.\d+)?)"), 1)
    unit = F.when(text.rlike(r"(?i)\beV\b"), "eV").when(text.contains("%"), "%")
    single = (F.size(numbers) == 1) & ~text.rlike(r"(?i)\b(?:ramp|range|to|-|/)\b")
    status = F.when(raw.isNull(), "missing").when(single, "single_value").when(F.size(numbers) >= 2, "range_or_compound").otherwise("free_text")
    value = F.when(status == "single_value", F.get(numbers, F.lit(0)).try_cast("double"))
    return F.struct(raw.alias("raw"), value.alias("value"), F.when(status == "single_value", F.coalesce(unit, F.lit("eV"))).otherwise(unit).alias("unit"), status.alias("status"))


def one_line(text: Column) -> Column:
    """Stripped text with runs of white space as one space; null where nothing is left."""
    return F.regexp_replace(filled(text), r"\s+", " ")


def polarity(value: Column, adduct: Column) -> Column:
    """"positive" or "negative" from the text, else from the adduct's sign, else null."""
    text = F.lower(F.coalesce(value, F.lit("")))
    ion = F.coalesce(adduct, F.lit(""))
    return (
        F.when(text.contains("pos"), "positive").when(text.contains("neg"), "negative")
        .when(ion.endswith("+") | ion.contains("]+"), "positive").when(ion.endswith("-") | ion.contains("]-"), "negative")
    )


def formula_counts(formula: Column) -> Column:
    """Map of elements to atoms of a formula; repeated elements add up. Null, empty and element-free text gives an empty map."""
    text = F.regexp_replace(F.coalesce(formula, F.lit("")), r"[+\-. ]", "")
    tokens = F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]?\d*)"), 1)
    one = lambda t: F.struct(F.regexp_extract(t, "^([A-Z][a-z]?)", 1).alias("element"), F.coalesce(truthy(F.regexp_extract(t, r"(\d+)$", 1)).try_cast("bigint"), F.lit(1).cast("bigint")).alias("n"))
    total = lambda parts, e: F.aggregate(F.filter(parts, lambda p: p["element"] == e), F.lit(0).cast("bigint"), lambda a, p: a + p["n"])
    names = lambda parts: F.array_sort(F.array_distinct(F.transform(parts, lambda p: p["element"])))
    return let(F.transform(tokens, one), lambda parts: let(names(parts), lambda elements: F.map_from_arrays(elements, F.transform(elements, lambda e: total(parts, e)))))


def formula_key(counts: Column) -> Column:
    """Sorted elements with their counts, 1 left out; null for an empty map."""
    entries = F.array_sort(F.map_entries(counts))
    return truthy(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.when(e["value"] == 1, "").otherwise(e["value"].cast("string")))), ""))


def lipid_candidate(counts: Column, name: Column, smiles: Column) -> Column:
    """Whether a formula may be that of a phosphorus lipid: enough P, C and O, not too unsaturated without a hint of
    chains in the name, no nucleotide-like name, and a structure (where given) that holds phosphorus."""
    n = lambda e: F.coalesce(F.try_element_at(counts, F.lit(e)), F.lit(0))
    text = F.coalesce(name, F.lit(""))
    built = F.coalesce(smiles, F.lit(""))
    return (
        (n("P") >= 1) & (n("C") >= 8) & (n("O") >= 3)
        & ((n("H") / F.greatest(n("C"), F.lit(1)) >= 1.15) | text.rlike(f"(?i){rules.CHAIN_HINTS}"))
        & ~text.rlike(f"(?i){rules.EXCLUDED_NAMES}")
        & ((built == "") | built.rlike("[Pp]"))
    )


def class_of_name(name: Column) -> Column:
    """Struct (lipid_class, family) of the first class in order that the name fits; nulls where none does."""
    text = F.coalesce(name, F.lit(""))
    chain = None
    for cls, family, patterns in rules.CLASSES:
        hit, value = text.rlike(any_of(patterns)), F.struct(F.lit(cls).alias("lipid_class"), F.lit(family).alias("family"))
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain.otherwise(F.struct(F.lit(None).cast("string").alias("lipid_class"), F.lit(None).cast("string").alias("family")))


def modifications_of_name(name: Column) -> Column:
    """Labels of all linkage modifications that the name mentions, in order."""
    text = F.coalesce(name, F.lit(""))
    return F.array_compact(F.array(*[F.when(text.rlike(any_of(patterns)), label) for label, patterns in rules.MODIFICATIONS]))


def class_consistency(classes: Column, reference_text: Column) -> Column:
    """Map of each class to whether the reference text mentions it by any of its terms. The unresolved class is left out."""
    text = F.concat(F.lit(" "), F.lower(F.coalesce(reference_text, F.lit(""))), F.lit(" "))
    table = F.create_map(*[x for cls, terms in rules.CLASS_TERMS.items() for x in (F.lit(cls), F.array(*[F.lit(t) for t in terms]))])
    known = F.array_sort(F.array_distinct(F.filter(classes, lambda c: c.isNotNull() & (c != "") & (c != rules.UNRESOLVED))))
    terms = lambda c: F.coalesce(F.try_element_at(table, c), F.array(F.lower(c)))
    return F.map_from_arrays(known, F.transform(known, lambda c: F.exists(terms(c), lambda t: F.contains(text, t))))


def expected_linkages(text: Column, chains: Column) -> Column:
    """Sorted linkages that a name implies for so many chains; null where it says nothing.

    "P-", plasmenyl and the like, shorthand "18:1p" and "18:1e" (with a double bond) are vinyl ethers;
    "O-", plasmanyl and the like and "18:0e" alkyl ethers; the rest are esters.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    short = F.array_distinct(F.regexp_extract_all(low, F.lit(r"\b(\d{1,2}:\d{1,2}[ep])\b"), 1))
    vinyl_short = F.filter(short, lambda t: t.endswith("p") | (F.regexp_extract(t, r":(\d+)", 1).cast("int") > 0))
    n_vinyl = F.size(vinyl_short) + low.rlike(r"\b(?:p-|plasmenyl|vinyl ether|vinyl-ether|alkenyl|plasmalogen)\b").cast("int")
    n_alkyl = F.size(short) - F.size(vinyl_short) + low.rlike(r"\b(?:o-|plasmanyl|alkyl ether|alkyl-ether|alkyl)\b").cast("int")
    with_ester = lambda label, n: F.array_sort(F.concat(F.array_repeat(F.lit(label), F.least(n, chains)), F.array_repeat(F.lit("ester"), F.greatest(chains - n, F.lit(0)))))
    said = low.rlike(r"\b(?:diacyl|acyl|ester)\b")
    return F.when(F.coalesce(chains, F.lit(0)) == 0, None).when(n_vinyl > 0, with_ester("vinyl_ether", n_vinyl)).when(n_alkyl > 0, with_ester("alkyl_ether", n_alkyl)).when(said, F.array_repeat(F.lit("ester"), chains))


def linkage_bucket(linkages: Column) -> Column:
    """A multiset of linkages as one label, ethers first, joined by "/"; null and empty lists are "other"."""
    rank = lambda x: F.when(x == "alkyl_ether", 0).when(x == "vinyl_ether", 1).when(x == "ester", 2).otherwise(3)
    ordered = F.transform(F.array_sort(F.transform(linkages, lambda x: F.struct(rank(x).alias("rank"), x.alias("name")))), lambda s: s["name"])
    return F.when(F.size(F.coalesce(linkages, F.array().cast("array<string>"))) > 0, F.array_join(ordered, "/")).otherwise("other")
