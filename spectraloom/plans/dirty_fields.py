"""Queries of the operators on dirty fields: energies in one unit (p1) and packed lists (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.operators import units as U
from spectraloom.operators.packed import explode_packed
from spectraloom.operators.units import to_common_unit
from spectraloom.session import table


def energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every collision energy of both tables in eV: the tables are laid one under the other first, so there is one plan for both."""
    units, contributors = table(spark, sf_dir, "energy_units"), table(spark, sf_dir, "contributors")
    pilot = table(spark, sf_dir, "experimental_ms2_pilot").select(
        F.struct(F.lit("experimental_ms2_pilot").alias("tab"), F.col("row_id")).alias("record"), F.col("collision_energy_qc_only").alias("energy"),
        F.col("record_title").alias("title"), F.col("acquired_on").alias("date"), "charge", F.col("adduct_qc_only").alias("adduct"), "contributor_id", "precursor_mz",
    )
    raw = table(spark, sf_dir, "massspecgym_raw").select(
        F.struct(F.lit("massspecgym_raw").alias("tab"), F.col("raw_id").alias("row_id")).alias("record"), F.col("collision_energy").alias("energy"),
        "adduct", "contributor_id", "precursor_mz",
    )
    both = pilot.unionByName(raw, allowMissingColumns=True)
    out = to_common_unit(both, units, contributors, key="record", field="energy", title="title", date="date", charge="charge", adduct="adduct")
    return out.select("record.tab", "record.row_id", "value", "n_values", "unit_id", "stated_in", "value_ev")


def p1_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return energies(spark, sf_dir).withColumn("value", F.round("value", 6)).withColumn("value_ev", F.round("value_ev", 4))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records whose energy is recorded in a unit other than eV."""
    ev = table(spark, sf_dir, "energy_units").where("unit = 'eV'").select(F.col("unit_id").alias("ev_id"))
    found = energies(spark, sf_dir).where("unit_id is not null")
    return found.join(ev, found["unit_id"] == ev["ev_id"], "left_anti").select("tab", "row_id", "unit_id")


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot of the packed lists with its position, value and error flags."""
    return explode_packed(table(spark, sf_dir, "massspecgym_raw"), "raw_id", "mzs", "intensities")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots that hold a number."""
    return p4_values(spark, sf_dir).where("value is not null").select(F.col("row_key").alias("raw_id"), "field", "pos")


def _p1_found_sql() -> str:
    """The same result as one DuckDB statement: number words are only told from other words there, since no value is asked for."""
    q = lambda t: "'" + t.replace("'", "''") + "'"
    parts = U.OTHER_PARTS
    words = "|".join([f"(?:{'|'.join(U.TENS)})(?:[- ]?(?:{'|'.join(U.ONES)}))?", *U.TEENS])
    def plain(c: str) -> str:
        s = rf"regexp_replace({c}, '(?i)[(\[]\s*(?:{parts})\b[^)\]]*[)\]]?', ' ', 'g')"
        s = rf"regexp_replace({s}, '(?i)(?:^|[;,])\s*(?:{parts})(?:\s|:|=)[^;]*', ' ', 'g')"
        s = rf"regexp_replace({s}, '[\s\x{{00A0}}\x{{200B}}]+', ' ', 'g')"
        s = rf"regexp_replace({s}, '(?i)mol\s*(?:\^?\s*[-−]\s*1|⁻¹)', 'mol', 'g')"
        return rf"regexp_replace({s}, '(?i)(?:of full\s*)?nce\s*(?:,?\s*0\s*[-–]\s*1 scale|\(\s*=\s*1\s*\)|\(fraction\))', 'nce fraction', 'g')"
    title = r"regexp_extract(title, '(?i)(?:^|;)\s*((?:ce|nce|hcd|cid|coll(?:ision|\.)? energy)\b[^;]*(?:;\s*[\d.,]+[^;]*)*)', 1)"
    title = rf"nullif(regexp_replace({title}, '(?i)^\s*(?:ce|coll(?:ision|\.)? energy)\b', ''), '')"
    digit = lambda c: rf"regexp_replace({c}, '(?i)\b(?:{words})(\s+(?:ev|electron|volts?|per ?cent|%|nce|kj|kcal|kev|mev))', '1\1')"
    def key(c: str) -> str:
        tail = rf"regexp_replace(regexp_extract({c}, '(?s)^.*\d([^\d]*)$', 1), '(?i)\((?:lab|nominal|offset)\)|\b(?:nominal|lab|offset|approx\.?)\b', '', 'g')"
        return rf"CASE WHEN regexp_matches({c}, '\d') THEN coalesce(nullif(regexp_replace(lower({tail}), '[^\p{{L}}%/]', '', 'g'), ''), CASE WHEN regexp_matches({c}, '(?i)^\s*(?:[^\d]*\b)?nce\b[^\d]*\d') THEN 'nce' END) END"
    alias = ", ".join(f"({q(u)}, {q(a)})" for u, al in U.UNIT_ALIASES.items() for a in al)
    hits = ", ".join(f"{{'p': CASE WHEN regexp_matches(c, {q(p)}) THEN instr(c, regexp_extract(c, {q('(' + p + ')')}, 1)) END, 'l': -length(regexp_extract(c, {q('(' + p + ')')}, 1)), 'u': {q(u)}}}" for u, p in U.NOTE_UNITS)
    return rf"""WITH al(unit, alias) AS (VALUES {alias}),
ua AS (SELECT alias, min(unit_id) AS unit_id FROM al JOIN energy_units USING (unit) GROUP BY 1),
cl AS (SELECT contributor_id, unnest(string_split_regex(regexp_replace(regexp_replace(lower(note), '([.;])\s+', '\1|', 'g'), ',\s*(from \d|since \d|seit \d|depuis \d|other |autres |andere |plain ev since)', '|\1', 'g'), '\|')) AS c, generate_subscripts(string_split_regex(regexp_replace(regexp_replace(lower(note), '([.;])\s+', '\1|', 'g'), ',\s*(from \d|since \d|seit \d|depuis \d|other |autres |andere |plain ev since)', '|\1', 'g'), '\|'), 1) AS at_ FROM contributors),
st AS (SELECT contributor_id, at_, list_sort(list_filter([{hits}], lambda h: h.p > 0))[1].u AS unit, try_cast(nullif(regexp_extract(c, '(?:from|since|seit|ab|depuis)\s+(\d{{4}})', 1), '') AS INT) AS y0,
 try_cast(nullif(regexp_extract(c, '(?:up to and including|up to|through|until|bis|jusqu''en)\s+(\d{{4}})', 1), '') AS INT) AS y1 FROM cl WHERE NOT regexp_matches(c, '^\s*(?:(?:other|autres|andere)\b|(?:{parts})\b)')),
sd AS (SELECT *, count(*) FILTER (y0 IS NOT NULL OR y1 IS NOT NULL) OVER (PARTITION BY contributor_id) AS dated, row_number() OVER (PARTITION BY contributor_id ORDER BY at_) AS i FROM st WHERE unit IS NOT NULL),
nd AS (SELECT contributor_id, unit_id, y0, y1 FROM sd JOIN energy_units USING (unit) WHERE (dated > 0 AND (y0 IS NOT NULL OR y1 IS NOT NULL)) OR (dated = 0 AND i = 1)),
rec AS (SELECT 'experimental_ms2_pilot' AS tab, row_id, contributor_id, collision_energy_qc_only AS ce, record_title AS title, year(acquired_on) AS y FROM experimental_ms2_pilot
 UNION ALL SELECT 'massspecgym_raw', raw_id, contributor_id, collision_energy, NULL, NULL FROM massspecgym_raw),
pl AS (SELECT tab, row_id, contributor_id, y, {digit(plain('ce'))} AS f, {digit(plain(title))} AS t FROM rec),
ky AS (SELECT *, {key('f')} AS fk, {key('t')} AS tk, coalesce(regexp_matches(f, '\d'), false) OR coalesce(regexp_matches(t, '\d'), false) AS has FROM pl),
un AS (SELECT ky.*, coalesce(a.unit_id, b.unit_id, CASE WHEN fk IS NULL AND tk IS NULL THEN (SELECT min(unit_id) FROM nd WHERE nd.contributor_id = ky.contributor_id AND ((y0 IS NULL AND y1 IS NULL) OR (y IS NOT NULL AND coalesce(y0, 0) <= y AND coalesce(y1, 9999) >= y))) END) AS unit_id
 FROM ky LEFT JOIN ua a ON a.alias = fk LEFT JOIN ua b ON b.alias = tk WHERE has)
SELECT tab, row_id, unit_id FROM un WHERE unit_id IS NOT NULL AND unit_id NOT IN (SELECT unit_id FROM energy_units WHERE unit = 'eV')"""


QUERIES = {"p1_energies": p1_energies, "p1_found": p1_found, "p4_values": p4_values, "p4_found": p4_found}
SQL = {"p1_found": _p1_found_sql()}
