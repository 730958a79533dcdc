"""Quantities recorded in different units, converted to one unit in pure SQL.

A record states its energy in up to three places: an energy field, a free-text title and the note
of whoever contributed it. For each place the number and the unit text are cut out with regular
expressions, the unit text is normalised to an alias key and joined with the alias table, and the
unit of the record is ``coalesce(field unit, title unit, contributor's default)``. The value comes
out as ``(number * factor + offset) * scale`` where ``scale`` is 1 or a column of the record.

Defined results:

* no number anywhere (null, empty, "n/a", "see title" without a title energy): no energy, no unit;
* several numbers (steps, ramps, ranges): ``value`` is their mean, ``n_values`` says how many;
* a unit that nothing states: ``unit`` and ``value_ev`` are null;
* a default that changed in some year needs the record's date; without one it states nothing;
* a missing charge is read off the adduct, and is 1 if that has none either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.session import broadcast_if_small

#: Spellings of units after normalisation (lower case, letters, '%' and '/' only).
UNIT_ALIASES = {
    "eV": ["ev", "electronvolt", "electronvolts", "elektronvolt", "électronvolt"],
    "keV": ["kev", "kiloelectronvolt", "kiloelectronvolts"],
    "meV": ["mev", "milliev", "millielectronvolt", "millielectronvolts"],
    "V": ["v", "volt", "volts"],
    "% NCE": ["%nce", "nce%", "nce", "%", "percent", "percentnce", "ncepercent", "prozent", "%ofnormalizedenergy",
              "%ofnormalisedenergy", "percentofnormalizedenergy", "percentofnormalisedenergy", "%normalized"],
    "NCE fraction": ["ncefraction", "fractionnce"],
    "kJ/mol": ["kj/mol", "kjmol", "kilojoulepermole", "kilojoulespermole", "kilojoule/mol", "kilojoules/mol"],
    "kcal/mol": ["kcal/mol", "kcalmol", "kilocaloriespermole", "kilocaloriepermole", "kilocalories/mol", "kilocalorie/mol"],
    "hartree": ["hartree", "hartrees", "eh", "au", "auhartree", "atomicunits"],
}

#: Numbers written as words.
TENS = {"ten": 10, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
TEENS = {"eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19}
ONES = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9}

#: Other parts of an instrument whose voltages are no collision energies.
OTHER_PARTS = r"cone|frag(?:mentor)?\.?|capillary|spray|source|rf|ion transfer|tube lens|declustering|entrance|exit|lens|orifice|kapillare|capillaire"

_NUMBER = r"[-+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?"

#: Notes: phrases in order of precedence within a clause; the earliest phrase in the text wins.
NOTE_UNITS = [
    ("keV", r"kilo-?\s?electron-?\s?volts?|\bkev\b"),
    ("meV", r"thousandths? of an? electron-?\s?volts?|milli-?\s?electron-?\s?volts?|milli-ev"),
    ("kJ/mol", r"kilo-?joules? per mole?|kj\s*/\s*mol"),
    ("kcal/mol", r"kilo-?calories? per mole?|kcal\s*/\s*mol"),
    ("hartree", r"hartrees?"),
    ("NCE fraction", r"share of one|fraction of one|\bnce fraction\b"),
    ("% NCE", r"per ?cent of (?:the )?normali[sz]ed|normali[sz]ed one \(per ?cent\)|nce \(%\)|% nce|prozent \(normiert\)|normali[sz]ed \(?per ?cent\)?|per ?cent of full nce"),
    ("eV", r"electron-?\s?volts?|\bev\b"),
    ("V", r"\bvolts?\b"),
]


def _digits(text: Column) -> Column:
    """A number word with a unit after it as digits; other text as it is."""
    after = r"(?=\s+(?:ev|electron|volts?|per ?cent|%|nce|kj|kcal|kev|mev))"
    word = rf"(?i)\b((?:{'|'.join(TENS)})(?:[- ]?(?:{'|'.join(ONES)}))?|{'|'.join(TEENS)})\b{after}"
    found = F.lower(F.regexp_extract(text, word, 1))
    known = F.create_map(*[x for w, v in {**TENS, **TEENS, **ONES}.items() for x in (F.lit(w), F.lit(v))])
    value = lambda pattern: F.coalesce(F.try_element_at(known, F.regexp_extract(found, pattern, 1)), F.lit(0))
    number = value(rf"^({'|'.join([*TEENS, *TENS])})") + value(rf"^(?:{'|'.join(TENS)})[- ]?({'|'.join(ONES)})$")
    return F.when(text.rlike(word), F.regexp_replace(text, F.lit(word), number.cast("string"))).otherwise(text)


def strip_other_parts(text: Column) -> Column:
    """Text without the clauses about voltages of other instrument parts."""
    out = F.regexp_replace(text, rf"(?i)[(\[]\s*(?:{OTHER_PARTS})\b[^)\]]*[)\]]?", " ")
    return F.regexp_replace(out, rf"(?i)(?:^|[;,])\s*(?:{OTHER_PARTS})(?:\s|:|=)[^;]*", " ")


def energy_text(text: Column) -> Column:
    """An energy expression in a plain form: unit exponents and scale remarks folded into unit words."""
    out = F.regexp_replace(strip_other_parts(text), r"[\s\u00a0\u200b]+", " ")
    out = F.regexp_replace(out, r"(?i)mol\s*(?:\^?\s*[-−]\s*1|⁻¹)", "mol")
    out = F.regexp_replace(out, r"(?i)(?:of full\s*)?nce\s*(?:,?\s*0\s*[-–]\s*1 scale|\(\s*=\s*1\s*\)|\(fraction\))", "nce fraction")
    return out


def parsed_energy(plain: Column) -> Column:
    """Struct of the numbers (array<double>) and the unit's alias key of an energy expression in its plain form.

    Null, empty and number-free texts give an empty array and a null key. The key is taken from the
    text after the last number, without remarks such as "(lab)" or "nominal", else from an "NCE" before it.
    """
    numbers = F.transform(F.regexp_extract_all(F.regexp_replace(plain, r"(\d)\s*[-–−]\s*(?=\d)", "$1 ; "), F.lit(f"({_NUMBER})"), 1), lambda x: F.regexp_replace(x, ",", ".").try_cast("double"))
    tail = F.regexp_extract(plain, rf"(?s)^.*\d([^\d]*)$", 1)
    key = F.regexp_replace(F.lower(F.regexp_replace(tail, r"(?i)\((?:lab|nominal|offset)\)|\b(?:nominal|lab|offset|approx\.?)\b", "")), r"[^\p{L}%/]", "")
    before = F.when(plain.rlike(r"(?i)^\s*(?:[^\d]*\b)?nce\b[^\d]*\d"), F.lit("nce"))
    numbers = F.coalesce(F.filter(numbers, lambda x: x.isNotNull()), F.array().cast("array<double>"))
    return F.struct(numbers.alias("numbers"), F.when(F.size(numbers) > 0, F.coalesce(F.nullif(key, F.lit("")), before)).alias("key"))


def title_energy(title: Column) -> Column:
    """The energy expression of a free-text title, or null. Only a labelled clause counts."""
    found = F.regexp_extract(title, r"(?i)(?:^|;)\s*((?:ce|nce|hcd|cid|coll(?:ision|\.)? energy)\b[^;]*(?:;\s*[\d.,]+[^;]*)*)", 1)
    return F.nullif(F.regexp_replace(found, r"(?i)^\s*(?:ce|coll(?:ision|\.)? energy)\b", ""), F.lit(""))


def alias_table(units: DataFrame) -> DataFrame:
    """(alias, unit_id, factor_to_ev, scaled_by) for all spellings of the units table."""
    spark = units.sparkSession
    rows = [(unit, alias) for unit, aliases in UNIT_ALIASES.items() for alias in aliases]
    aliases = spark.createDataFrame(rows, "unit string, alias string")
    once = units.groupBy("unit").agg(F.min_by(F.struct("unit_id", "factor_to_ev", "scaled_by"), "unit_id").alias("u"))  # repeated units mustn't multiply records
    return aliases.join(once, "unit").select("alias", "u.*")


def note_defaults(contributors: DataFrame) -> DataFrame:
    """The unit each contributor's note states: one row per validity period.

    (contributor_id, default_unit, from_year, to_year); years are null where the note has no period.
    A clause about another part's voltage is dropped first; of several units in one clause the
    earliest stands; two clauses with years ("through 2019 ..., since 2020 ...") give two rows.
    """
    rows = contributors.select("contributor_id", F.posexplode(F.split("note", r"(?<=[.;])\s+|,\s*(?=from \d|since \d|seit \d|depuis \d|other |autres |andere |plain eV since)")).alias("at", "clause"))
    text = F.lower("clause")
    other = text.rlike(rf"^\s*(?:(?:other|autres|andere)\b|(?:{OTHER_PARTS})\b)")
    hits = F.array(*[F.struct(F.regexp_instr(text, F.lit(f"({pattern})")).alias("at"), (F.lit(0) - F.length(F.regexp_extract(text, f"({pattern})", 1))).alias("long"), F.lit(unit).alias("unit")) for unit, pattern in NOTE_UNITS])
    # "volts" inside "electronvolts" and "eV" inside "keV" begin later or at the same place and are shorter
    best = F.array_min(F.filter(hits, lambda h: h["at"] > 0))
    to_year = F.regexp_extract(text, r"(?:up to and including|up to|through|until|bis|jusqu'en)\s+(\d{4})", 1).try_cast("int")
    from_year = F.regexp_extract(text, r"(?:from|since|seit|ab|depuis)\s+(\d{4})", 1).try_cast("int")
    stated = rows.where(~other).select("contributor_id", "at", best["unit"].alias("default_unit"), from_year.alias("from_year"), to_year.alias("to_year")).where("default_unit is not null")
    # without a period the first clause that names a unit is the statement
    ranked = stated.groupBy("contributor_id").agg(F.sort_array(F.collect_list(F.struct("at", "default_unit", "from_year", "to_year"))).alias("s"))
    dated = F.filter("s", lambda x: x["from_year"].isNotNull() | x["to_year"].isNotNull())
    chosen = F.when(F.size(dated) > 0, dated).otherwise(F.slice("s", 1, 1))
    return ranked.select("contributor_id", F.explode(chosen).alias("c")).select("contributor_id", "c.default_unit", "c.from_year", "c.to_year")


def to_common_unit(records: DataFrame, units: DataFrame, contributors: DataFrame, *, key: str, field: str, title: str | None = None, date: str | None = None,
                   charge: str | None = None, adduct: str | None = None, precursor: str = "precursor_mz", offset: float = 0.0) -> DataFrame:
    """One row per record: (key, value, n_values, unit_id, stated_in, value_ev).

    ``stated_in`` is "field", "title", "note" or null. Every row of ``records`` comes out once; columns other
    than the named ones are ignored, so clashing names do no harm.
    """
    c = lambda name, kind: F.col(name).cast(kind) if name else F.lit(None).cast(kind)
    from_adduct = F.regexp_extract(c(adduct, "string"), r"\](\d*)[-+]", 1).try_cast("int")
    # one step per projection: each text is cleaned once, whatever refers to it later
    base = records.withColumn("__f", energy_text(F.col(field))).withColumn("__t", energy_text(title_energy(c(title, "string"))))
    base = base.withColumn("__f", _digits(F.col("__f"))).withColumn("__t", _digits(F.col("__t")))
    base = base.select(
        F.col(key).alias("key"), F.col("contributor_id"), parsed_energy(F.col("__f")).alias("f"), parsed_energy(F.col("__t")).alias("t"),
        F.year(c(date, "date")).alias("year"), F.abs(F.coalesce(c(charge, "int"), from_adduct, F.lit(1))).cast("double").alias("charge"), F.col(precursor).cast("double").alias("precursor_mz"),
    )
    # the spellings are a fixed list of this module; contributors are counted. Units and contributors may each hold a third of all rows: no shuffle on them
    alias = alias_table(units)
    by_field = F.broadcast(alias.select(F.col("alias").alias("f_alias"), F.struct("unit_id", "factor_to_ev", "scaled_by").alias("f_unit")))
    by_title = F.broadcast(alias.select(F.col("alias").alias("t_alias"), F.struct("unit_id", "factor_to_ev", "scaled_by").alias("t_unit")))
    default = note_defaults(contributors).join(units.withColumnRenamed("unit", "default_unit"), "default_unit")
    default = default.select("contributor_id", "from_year", "to_year", F.struct("unit_id", "factor_to_ev", "scaled_by").alias("n_unit"))
    # at most one row per contributor, so the join below can't multiply records
    default = default.groupBy("contributor_id").agg(F.collect_list(F.struct("from_year", "to_year", "n_unit")).alias("periods"))
    default = broadcast_if_small(default)
    joined = base.join(by_field, base["f.key"] == F.col("f_alias"), "left").join(by_title, F.col("t.key") == F.col("t_alias"), "left").join(default, "contributor_id", "left")
    holds = lambda p: (p["from_year"].isNull() & p["to_year"].isNull()) | (F.col("year").isNotNull() & (F.coalesce(p["from_year"], F.lit(0)) <= F.col("year")) & (F.coalesce(p["to_year"], F.lit(9999)) >= F.col("year")))
    note = F.get(F.filter("periods", holds), F.lit(0))["n_unit"]
    numbers = F.when(F.size("f.numbers") > 0, F.col("f.numbers")).otherwise(F.col("t.numbers"))
    has = F.size(numbers) > 0
    # a field that spells an unknown unit states it, so the note's default doesn't stand for it
    unit = F.when(has, F.coalesce("f_unit", "t_unit", F.when(F.col("f.key").isNull() & F.col("t.key").isNull(), note)))
    value = F.when(has, F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.size(numbers))
    out = joined.select("key", value.alias("value"), F.size(numbers).alias("n_values"), unit.alias("unit"),
                        F.when(~has, None).when(F.col("f_unit").isNotNull(), "field").when(F.col("t_unit").isNotNull(), "title").when(unit.isNotNull(), "note").alias("stated_in"), "charge", "precursor_mz")
    scale = F.when(F.col("unit.scaled_by") == "charge", F.col("charge")).when(F.col("unit.scaled_by") == "precursor_mz", F.col("precursor_mz")).when(F.col("unit.scaled_by").isNull(), F.lit(1.0))
    return out.select(F.col("key").alias(key), "value", "n_values", F.col("unit.unit_id").alias("unit_id"), "stated_in", ((F.col("value") * F.col("unit.factor_to_ev") + F.lit(offset)) * scale).alias("value_ev"))
