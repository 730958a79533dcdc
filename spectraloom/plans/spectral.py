"""Queries of the spectrum pipeline over the delivered tables, each with its DuckDB SQL where SQL can express it.

Array results are joined to text or exploded, numbers rounded, so that both engines give the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.functions import normalize as n
from spectraloom.functions import peaks as p
from spectraloom.functions import rules
from spectraloom.functions.text import sorted_distinct, truthy
from spectraloom.operators import duplicates, group_split, identity, matching, rollup
from spectraloom.session import table

PILOT = "experimental_ms2_pilot"


def _pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, PILOT)


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.identity_hashes(identity.structure_ids(identity.spectra(_pilot(spark, sf_dir))))


def _joined(array: Column) -> Column:
    return F.array_join(array, "|")


# --- SQL building blocks -------------------------------------------------------------------------


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"


def _filled(c: str) -> str:
    return f"nullif({_strip(c)}, '')"


def _one_line(c: str) -> str:
    return rf"regexp_replace({_filled(c)}, '\s+', ' ', 'g')"


def _hash(prefix: str, *parts: str) -> str:
    safe = [rf"coalesce('=' || regexp_replace({x}, '([\\|])', '\\\1', 'g'), '~')" for x in parts]
    bar = " || '|' || "
    return f"'{prefix}_' || substr(sha256({bar.join(safe)}), 1, 24)"


def _like_any(c: str, patterns: list[str]) -> str:
    return f"regexp_matches({c}, {_q('|'.join(f'(?:{x})' for x in patterns))}, 'i')"


_CLASS_CASE = "CASE " + " ".join(f"WHEN {_like_any('t', pats)} THEN {_q(cls)}" for cls, _, pats in rules.CLASSES) + " END"
_FAMILY_CASE = "CASE cls " + " ".join(f"WHEN {_q(cls)} THEN {_q(fam)}" for cls, fam, _ in rules.CLASSES) + " END"
_MODS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_like_any('t', pats)} THEN {_q(label)} END" for label, pats in rules.MODIFICATIONS) + "], lambda x: x IS NOT NULL), '|')"


def _adduct_sql(c: str) -> dict[str, str]:
    raw = _filled(c)
    found = rf"nullif(regexp_extract({raw}, '(\[[^\]]+\]\d*[+-])', 1), '')"
    compact = rf"regexp_replace({found}, '\s+', '', 'g')"
    body = rf"regexp_replace(regexp_extract({compact}, '^\[([^\]]+)\]\d*[+-]$', 1), '^m', 'M')"
    for part in rules.ADDUCT_PARTS:
        body = f"regexp_replace({body}, '{part}', '{part}', 'gi')"
    status = f"CASE WHEN {raw} IS NULL THEN 'missing' WHEN upper({raw}) IN ({', '.join(map(_q, rules.ION_MODES))}) THEN 'ion_mode_not_adduct' WHEN {found} IS NULL THEN 'unparsed' ELSE 'normalized' END"
    canon = rf"CASE WHEN regexp_matches({compact}, '^\[[^\]]+\]\d*[+-]$') THEN '[' || {body} || ']' || regexp_extract({compact}, '\](\d*[+-])$', 1) ELSE {compact} END"
    return {"raw": raw, "status": status, "adduct": f"CASE WHEN ({status}) = 'normalized' THEN {canon} ELSE 'unknown' END"}


def _energy_sql(c: str) -> dict[str, str]:
    raw = _filled(c)
    text = f"replace({raw}, '−', '-')"
    numbers = rf"regexp_extract_all({text}, '[-+]?\d+(?:\.\d+)?')"
    unit = rf"CASE WHEN regexp_matches({text}, '\beV\b', 'i') THEN 'eV' WHEN contains({text}, '%') THEN '%' END"
    status = rf"CASE WHEN {raw} IS NULL THEN 'missing' WHEN len({numbers}) = 1 AND NOT regexp_matches({text}, '\b(?:ramp|range|to|-|/)\b', 'i') THEN 'single_value' WHEN len({numbers}) >= 2 THEN 'range_or_compound' ELSE 'free_text' END"
    return {
        "raw": raw, "status": status, "value": f"CASE WHEN ({status}) = 'single_value' THEN try_cast({numbers}[1] AS DOUBLE) END",
        "unit": f"CASE WHEN ({status}) = 'single_value' THEN coalesce({unit}, 'eV') ELSE {unit} END",
    }


def _polarity_sql(text: str, adduct: str) -> str:
    return (f"CASE WHEN contains(lower(coalesce({text}, '')), 'pos') THEN 'positive' WHEN contains(lower(coalesce({text}, '')), 'neg') THEN 'negative' "
            f"WHEN ends_with({adduct}, '+') OR contains({adduct}, ']+') THEN 'positive' WHEN ends_with({adduct}, '-') OR contains({adduct}, ']-') THEN 'negative' END")  # fmt: skip


_A, _E = _adduct_sql("adduct_qc_only"), _energy_sql("collision_energy_qc_only")
_CLEAN = "list_filter(coalesce(peaks_raw, []), lambda p: p[1] IS NOT NULL AND p[2] IS NOT NULL AND isfinite(p[1]) AND isfinite(p[2]) AND p[1] > 0 AND p[2] >= 0)"
_PEAK_TEXT = "array_to_string(list_transform(list_sort(list_transform(peaks, lambda p: {'mz': CAST(p[1] AS DECIMAL(20,4)), 'i': CAST(p[2] AS DECIMAL(28,6))})), lambda s: CAST(s.mz AS VARCHAR) || ':' || CAST(s.i AS VARCHAR)), ';')"

#: The normalised spectra, as ``identity.spectra`` with ids and hashes.
_SPECTRA = f"""
s0 AS (SELECT *, row_id AS ord, {_CLEAN} AS peaks, coalesce(name, '') || ' ; ' || coalesce(record_title, '') AS t FROM {PILOT}),
s1 AS (SELECT *, {_CLASS_CASE} AS cls, {_A['adduct']} AS adduct, {_E['raw']} AS e_raw, {_E['value']} AS e_value, {_E['unit']} AS e_unit, {_E['status']} AS e_status,
  {_one_line('instrument')} AS inst, {_one_line('instrument_type_qc_only')} AS inst_type, {_MODS} AS mods
  FROM s0 WHERE len(peaks) >= 3 AND precursor_mz IS NOT NULL AND NOT isnan(precursor_mz)),
s2 AS (SELECT * REPLACE ({_polarity_sql('polarity', "CASE WHEN adduct <> 'unknown' THEN adduct ELSE '' END")} AS polarity, coalesce(cls, '{rules.UNRESOLVED}') AS lipid_class),
  coalesce(nullif(spectrum_id, ''), nullif(record_title, ''), nullif(source_file, '')) AS record_id, {_PEAK_TEXT} AS peak_text,
  {_hash('str', f"'{rules.STANDARDIZATION_VERSION}'", f"coalesce({_filled('smiles')}, '')")} AS structure_id, {_hash('conn', f"'{rules.STANDARDIZATION_VERSION}'", f"coalesce({_filled('smiles')}, '')")} AS connectivity_id FROM s1),
s3 AS (SELECT *, {_hash('peak', f"'{rules.HASH_VERSION}'", 'connectivity_id', "CAST(CAST(precursor_mz AS DECIMAL(28,4)) AS VARCHAR)", "coalesce(nullif(adduct, ''), 'unknown')", "coalesce(nullif(polarity, ''), 'unknown')", 'peak_text')} AS peak_hash FROM s2),
s4 AS (SELECT *, {_hash('acqmeta', f"'{rules.HASH_VERSION}'", 'peak_hash', 'e_raw', "CAST(CAST(e_value AS DECIMAL(28,6)) AS VARCHAR)", 'e_unit', 'e_status', 'inst', 'inst_type', 'source')} AS meta_hash,
  {_hash('acqrec', f"'{rules.HASH_VERSION}'", 'peak_hash', 'e_raw', "CAST(CAST(e_value AS DECIMAL(28,6)) AS VARCHAR)", 'e_unit', 'e_status', 'inst', 'inst_type', 'source', 'record_id')} AS record_hash FROM s3)
"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- normalisers -----------------------------------------------------------------------------------


@query(rf"""WITH x AS (SELECT row_id, {_filled('inchikey')} AS raw FROM {PILOT}), y AS (SELECT *, upper(raw) AS tok FROM x)
SELECT row_id, raw, CASE WHEN regexp_full_match(tok, '[A-Z]{{14}}-[A-Z]{{10}}-[A-Z]') THEN tok END AS full_key,
 CASE WHEN regexp_full_match(tok, '[A-Z]{{14}}(-[A-Z]{{10}}-[A-Z])?') THEN substr(tok, 1, 14) END AS connectivity_key,
 CASE WHEN raw IS NULL THEN 'missing' WHEN regexp_full_match(tok, '[A-Z]{{14}}-[A-Z]{{10}}-[A-Z]') THEN 'full_inchikey' WHEN regexp_full_match(tok, '[A-Z]{{14}}') THEN 'connectivity_block' ELSE 'unrecognized_identifier' END AS semantics,
 CASE WHEN raw IS NULL OR regexp_full_match(tok, '[A-Z]{{14}}-[A-Z]{{10}}-[A-Z]') THEN 0 ELSE 1 END AS n_warnings FROM y""")
def identifier_fields(spark, sf_dir):
    return _pilot(spark, sf_dir).select("row_id", n.identifier_fields(F.col("inchikey")).alias("i")).select("row_id", "i.*")


@query(f"SELECT row_id, {_A['raw']} AS raw, {_A['adduct']} AS adduct, {_A['status']} AS status FROM {PILOT}")
def adduct_fields(spark, sf_dir):
    return _pilot(spark, sf_dir).select("row_id", n.adduct_fields(F.col("adduct_qc_only")).alias("a")).select("row_id", "a.*")


@query(f"SELECT row_id, {_E['raw']} AS raw, round({_E['value']}, 6) AS value, {_E['unit']} AS unit, {_E['status']} AS status FROM {PILOT}")
def energy_fields(spark, sf_dir):
    return _pilot(spark, sf_dir).select("row_id", n.energy_fields(F.col("collision_energy_qc_only")).alias("e")).select("row_id", "e.raw", F.round("e.value", 6).alias("value"), "e.unit", "e.status")


@query(f"SELECT row_id, {_one_line('instrument')} AS instrument, {_one_line('instrument_type_qc_only')} AS instrument_type, {_polarity_sql('polarity', 'coalesce(adduct_qc_only, ' + chr(39) * 2 + ')')} AS polarity FROM {PILOT}")
def instrument_and_polarity(spark, sf_dir):
    return _pilot(spark, sf_dir).select("row_id", n.one_line(F.col("instrument")).alias("instrument"), n.one_line(F.col("instrument_type_qc_only")).alias("instrument_type"), n.polarity(F.col("polarity"), F.col("adduct_qc_only")).alias("polarity"))


_FORMULA_PARTS = r"""SELECT {key} AS k, regexp_extract(tok, '^([A-Z][a-z]?)', 1) AS element, coalesce(try_cast(nullif(regexp_extract(tok, '(\d+)$', 1), '') AS BIGINT), 1) AS c
 FROM (SELECT {key}, unnest(regexp_extract_all(regexp_replace(coalesce(formula, ''), '[+\-. ]', '', 'g'), '[A-Z][a-z]?\d*')) AS tok FROM {src})"""


@query(f"SELECT k AS ref_id, element, CAST(sum(c) AS BIGINT) AS n_atoms FROM ({_FORMULA_PARTS.format(key='ref_id', src='compound_reference')}) GROUP BY 1, 2")
def formula_atoms(spark, sf_dir):
    counts = n.formula_counts(F.col("formula"))
    return table(spark, sf_dir, "compound_reference").select("ref_id", F.explode(counts).alias("element", "n_atoms"))


@query(f"""WITH x AS (SELECT k, element, CAST(sum(c) AS BIGINT) AS a FROM ({_FORMULA_PARTS.format(key='row_id', src=PILOT)}) GROUP BY 1, 2),
y AS (SELECT k, string_agg(element || CASE WHEN a = 1 THEN '' ELSE CAST(a AS VARCHAR) END, '' ORDER BY element) AS formula_key,
 coalesce(max(a) FILTER (element = 'P'), 0) AS p, coalesce(max(a) FILTER (element = 'C'), 0) AS c, coalesce(max(a) FILTER (element = 'H'), 0) AS h, coalesce(max(a) FILTER (element = 'O'), 0) AS o FROM x GROUP BY 1)
SELECT row_id, formula_key, coalesce(p, 0) >= 1 AND coalesce(c, 0) >= 8 AND coalesce(o, 0) >= 3 AND (h / greatest(c, 1) >= 1.15 OR regexp_matches(coalesce(name, ''), {_q(rules.CHAIN_HINTS)}, 'i'))
 AND NOT (regexp_matches(coalesce(name, ''), {_q(rules.EXCLUDED_NAMES.replace('(?![- ]?(?:DAG|diacylglycerol))', ''))}, 'i') AND NOT regexp_matches(coalesce(name, ''), '\\bCDP[- ]?(?:DAG|diacylglycerol)', 'i'))
 AND (coalesce(smiles, '') = '' OR regexp_matches(smiles, '[Pp]')) AS candidate
FROM {PILOT} LEFT JOIN y ON k = row_id""")
def lipid_candidates(spark, sf_dir):
    counts = n.formula_counts(F.col("formula"))
    return _pilot(spark, sf_dir).select("row_id", n.formula_key(counts).alias("formula_key"), n.lipid_candidate(counts, F.col("name"), F.col("smiles")).alias("candidate"))


@query(f"WITH x AS (SELECT row_id, coalesce(name, '') || ' ; ' || coalesce(record_title, '') AS t FROM {PILOT}), y AS (SELECT *, {_CLASS_CASE} AS cls FROM x) SELECT row_id, cls AS lipid_class, {_FAMILY_CASE} AS family, {_MODS} AS modifications FROM y")
def class_cascade(spark, sf_dir):
    text = F.concat_ws(" ; ", F.coalesce("name", F.lit("")), F.coalesce("record_title", F.lit("")))
    return _pilot(spark, sf_dir).select("row_id", n.class_of_name(text).alias("c"), _joined(n.modifications_of_name(text)).alias("modifications")).select("row_id", "c.lipid_class", "c.family", "modifications")


# --- scans and filters -----------------------------------------------------------------------------


@query(f"WITH x AS (SELECT row_id, {_CLEAN} AS p FROM {PILOT}), y AS (SELECT row_id, CASE WHEN len(p) >= 3 THEN p ELSE [] END AS p FROM x) SELECT row_id, len(p) AS n_peaks, round(coalesce(list_sum(list_transform(p, lambda q: q[1])), 0), 3) AS mz_sum FROM y")
def clean_peaks(spark, sf_dir):
    peaks = p.clean_peaks(F.col("peaks_raw"))
    total = F.aggregate(F.col("p"), F.lit(0.0), lambda a, x: a + x["mz"])
    return _pilot(spark, sf_dir).select("row_id", peaks.alias("p")).select("row_id", F.size("p").cast("bigint").alias("n_peaks"), F.round(total, 3).alias("mz_sum"))


@query(f"SELECT source, count(*) AS n_rows, count(*) FILTER (usable_for_pilot_training IS DISTINCT FROM false) AS n_usable FROM {PILOT} GROUP BY 1")
def usable_rows(spark, sf_dir):
    return _pilot(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce("usable_for_pilot_training", F.lit(True))).alias("n_usable"))


@query(f"WITH {_SPECTRA} SELECT CASE WHEN lipid_class <> '{rules.UNRESOLVED}' THEN 'resolved' ELSE 'unresolved' END AS part, lipid_class, count(*) AS n_rows FROM s2 GROUP BY 1, 2")
def resolved_and_unresolved(spark, sf_dir):
    part = F.when(F.col("lipid_class") != rules.UNRESOLVED, "resolved").otherwise("unresolved")
    return identity.spectra(_pilot(spark, sf_dir)).groupBy(part.alias("part"), "lipid_class").agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS DOUBLE), value) AS chosen, json_extract(props, '$.k') IS NOT NULL AS nested FROM events")
def nested_fallback(spark, sf_dir):
    inner = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(inner, F.col("value")).alias("chosen"), inner.isNotNull().alias("nested"))


@query(f"SELECT row_id, coalesce(CASE WHEN upper(trim(smiles)) NOT IN ('', 'N/A', 'NA', 'NONE', 'NULL') THEN smiles END, CASE WHEN upper(trim(inchikey)) NOT IN ('', 'N/A', 'NA', 'NONE', 'NULL') THEN inchikey END, CASE WHEN upper(trim(name)) NOT IN ('', 'N/A', 'NA', 'NONE', 'NULL') THEN name END) AS value, CASE WHEN upper(trim(smiles)) NOT IN ('', 'N/A', 'NA', 'NONE', 'NULL') THEN 'smiles' WHEN upper(trim(inchikey)) NOT IN ('', 'N/A', 'NA', 'NONE', 'NULL') THEN 'inchikey' WHEN upper(trim(name)) NOT IN ('', 'N/A', 'NA', 'NONE', 'NULL') THEN 'name' ELSE 'missing' END AS chosen FROM {PILOT}")
def first_usable_column(spark, sf_dir):
    return _pilot(spark, sf_dir).select("row_id", matching.first_usable("smiles", "inchikey", "name").alias("c")).select("row_id", "c.value", F.col("c.column").alias("chosen"))


# --- identity and duplicates -------------------------------------------------------------------------


@query(f"WITH {_SPECTRA} SELECT ord AS row_id, peak_hash AS peak_identity_hash, meta_hash AS acquisition_metadata_hash, record_hash AS acquisition_record_hash FROM s4")
def identity_hash_levels(spark, sf_dir):
    return _spectra(spark, sf_dir).select(F.col("_ord").alias("row_id"), "peak_identity_hash", "acquisition_metadata_hash", "acquisition_record_hash")


_V1 = """sha256(coalesce(inchikey, 'None') || '|' || coalesce(smiles, 'None') || '|' || CAST(CAST(precursor_mz AS DECIMAL(28,4)) AS VARCHAR) || '|' || coalesce(adduct, 'None') || '|' || coalesce(polarity, 'None') || '|' || peak_text)"""


@query(f"WITH {_SPECTRA}, h AS (SELECT ord, {_V1} AS spectrum_hash FROM s2) SELECT spectrum_hash, min(ord) AS row_id FROM h GROUP BY 1")
def exact_dedup_first_seen(spark, sf_dir):
    hashed = identity.first_version_hash(identity.spectra(_pilot(spark, sf_dir))).select("spectrum_hash", "_ord")
    return duplicates.first_seen(hashed, ["spectrum_hash"]).select("spectrum_hash", F.col("_ord").alias("row_id"))


@query(f"WITH {_SPECTRA} SELECT record_hash AS acquisition_record_hash, min(ord) AS row_id, arg_min(spectrum_id, ord) AS spectrum_id FROM s4 GROUP BY 1")
def acquisition_dedup(spark, sf_dir):
    rows = _spectra(spark, sf_dir).select("acquisition_record_hash", "_ord", "spectrum_id")
    return duplicates.first_seen(rows, ["acquisition_record_hash"]).select("acquisition_record_hash", F.col("_ord").alias("row_id"), "spectrum_id")


@query(f"WITH {_SPECTRA} SELECT count(*) AS n_rows, count(DISTINCT record_hash) AS n_kept, count(*) - count(DISTINCT record_hash) AS n_removed FROM s4")
def acquisition_dedup_counts(spark, sf_dir):
    return duplicates.with_counts(_spectra(spark, sf_dir), ["acquisition_record_hash"])


_GROUPS = """g AS (SELECT peak_hash, count(*) AS size, count(DISTINCT record_hash) AS n_records, count(DISTINCT row(e_raw, e_value, e_unit, e_status)) AS n_energies, count(DISTINCT row(inst, inst_type)) AS n_inst,
 count(DISTINCT coalesce(source, 'None')) AS n_sources, bool_or(e_status = 'missing' OR (inst IS NULL AND inst_type IS NULL)) AS missing,
 array_to_string(list_sort(list(DISTINCT coalesce(nullif(source, ''), 'unknown'))), '|') AS sources, array_to_string(list_sort(list(DISTINCT coalesce(e_raw, 'None'))), '|') AS energy_values,
 array_to_string(list_sort(list(DISTINCT coalesce(inst, inst_type, 'None'))), '|') AS instrument_values FROM s4 GROUP BY 1),
r AS (SELECT *, CASE WHEN size = 1 THEN 'unique' WHEN n_records = 1 THEN 'removable_exact_duplicate' WHEN n_energies > 1 THEN 'same_peaks_different_collision_energy' WHEN n_inst > 1 THEN 'same_peaks_different_instrument'
 WHEN n_sources > 1 THEN 'cross_source_peak_duplicate' WHEN missing THEN 'missing_acquisition_metadata' ELSE 'same_source_acquisition_duplicate_candidate' END AS relation FROM g)"""


@query(f"WITH {_SPECTRA}, {_GROUPS} SELECT peak_hash AS peak_identity_hash, size AS duplicate_group_size, relation AS duplicate_relation, sources, energy_values, instrument_values FROM r WHERE size > 1")
def duplicate_groups(spark, sf_dir):
    groups = duplicates.duplicate_groups(_spectra(spark, sf_dir), example_ids=0).where("duplicate_group_size > 1")
    return groups.select("peak_identity_hash", "duplicate_group_size", "duplicate_relation", *[_joined(F.col(c)).alias(c) for c in ("sources", "energy_values", "instrument_values")])


@query(f"""WITH {_SPECTRA}, x AS (SELECT *, row_number() OVER (PARTITION BY peak_hash ORDER BY ord, spectrum_id) AS i FROM s4)
SELECT peak_hash AS peak_identity_hash, count(*) AS duplicate_group_size, array_to_string(list_sort(list(DISTINCT coalesce(nullif(connectivity_id, ''), 'unknown'))), '|') AS connectivity_ids,
 coalesce(string_agg(spectrum_id, '|' ORDER BY i) FILTER (i <= 10), '') AS example_spectrum_ids FROM x GROUP BY 1 HAVING count(*) > 1""")
def duplicate_group_ids(spark, sf_dir):
    """Of each group the first ten spectrum ids in the order of arrival, and its connectivity ids."""
    groups = duplicates.duplicate_groups(_spectra(spark, sf_dir)).where("duplicate_group_size > 1")
    return groups.select("peak_identity_hash", "duplicate_group_size", *[_joined(F.col(c)).alias(c) for c in ("connectivity_ids", "example_spectrum_ids")])


@query(f"WITH {_SPECTRA}, {_GROUPS} SELECT s4.ord AS row_id, r.size AS duplicate_group_size, r.relation AS duplicate_relation FROM s4 JOIN r USING (peak_hash)")
def duplicate_relation(spark, sf_dir):
    rows = _spectra(spark, sf_dir)
    return duplicates.stamp_groups(rows.select("_ord", "peak_identity_hash"), duplicates.duplicate_groups(rows, example_ids=0)).select(F.col("_ord").alias("row_id"), "duplicate_group_size", "duplicate_relation")


# --- roll-ups and histograms -----------------------------------------------------------------------

_LIST = "array_to_string(list_sort(list(DISTINCT {0}) FILTER ({0} IS NOT NULL)), '|')"


@query(f"""WITH {_SPECTRA} SELECT structure_id, arg_min(coalesce(spectrum_id, ''), ord) AS first_spectrum_id, coalesce({_LIST.format("nullif(source, '')")}, '') AS sources, coalesce({_LIST.format("nullif(lipid_class, '')")}, '') AS lipid_classes,
 coalesce({_LIST.format("adduct")}, '') AS adducts, coalesce({_LIST.format("coalesce(polarity, 'unknown')")}, '') AS polarities, coalesce({_LIST.format("e_raw")}, '') AS energies, coalesce({_LIST.format("coalesce(inst, inst_type)")}, '') AS instruments,
 count(*) AS n_spectra, count(*) FILTER (lipid_class <> '{rules.UNRESOLVED}') AS n_resolved, count(*) FILTER (lipid_class = '{rules.UNRESOLVED}') AS n_unresolved FROM s2 GROUP BY 1""")
def structure_rollup(spark, sf_dir):
    rows = identity.structure_ids(identity.spectra(_pilot(spark, sf_dir)))
    out = rollup.structure_rollup(rows)
    return out.select("structure_id", F.coalesce("first_spectrum_id", F.lit("")).alias("first_spectrum_id"), *[_joined(F.col(c)).alias(c) for c in ("sources", "lipid_classes", "adducts", "polarities", "energies", "instruments")], "n_spectra", "n_resolved", "n_unresolved")


@query(f"""WITH {_SPECTRA} SELECT ord AS row_id, structure_id, connectivity_id, lipid_class, peak_hash AS peak_identity_hash, record_id AS source_record_id FROM s4""")
def spectrum_map(spark, sf_dir):
    return _spectra(spark, sf_dir).select(F.col("_ord").alias("row_id"), "structure_id", "connectivity_id", "lipid_class", "peak_identity_hash", "source_record_id")


@query(f"""WITH c AS (SELECT structure_record_id AS k, lipid_class AS v, count(*) AS n, min(row_id) AS fst FROM {PILOT} WHERE structure_record_id IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, fst) AS i, sum(n) OVER (PARTITION BY k) AS t FROM c) SELECT k AS structure_record_id, v AS lipid_class, n, CAST(t AS BIGINT) AS n_rows FROM r WHERE i = 1""")
def modal_class(spark, sf_dir):
    return rollup.modal_value(_pilot(spark, sf_dir).where("structure_record_id is not null"), "structure_record_id", "lipid_class", "row_id")


_HIST = ["source", "polarity", "lipid_class", "adduct_qc_only", "instrument_type_qc_only", "license"]


@query("WITH p AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, coalesce(nullif({c}, ''), 'unknown') AS value, row_id FROM {PILOT}" for c in _HIST) + "), c AS (SELECT field, value, count(*) AS n, min(row_id) AS fst FROM p GROUP BY 1, 2) SELECT field, value, n, row_number() OVER (PARTITION BY field ORDER BY n DESC, fst) AS rank FROM c")
def audit_histograms(spark, sf_dir):
    return rollup.histograms(_pilot(spark, sf_dir), _HIST, "row_id")


@query(f"SELECT count(DISTINCT coalesce(nullif(inchikey, ''), nullif(smiles, ''), nullif(name, ''), nullif(spectrum_id, ''))) + max(CASE WHEN coalesce(nullif(inchikey, ''), nullif(smiles, ''), nullif(name, ''), nullif(spectrum_id, '')) IS NULL THEN 1 ELSE 0 END) AS n_distinct FROM {PILOT}")
def distinct_molecules(spark, sf_dir):
    return rollup.distinct_first(_pilot(spark, sf_dir), "inchikey", "smiles", "name", "spectrum_id")


@query(f"WITH c AS (SELECT structure_record_id, count(DISTINCT spectrum_id) AS n_items, count(*) AS n_rows FROM {PILOT} GROUP BY 1) SELECT * FROM c WHERE n_items > 1 ORDER BY n_items DESC, structure_record_id NULLS FIRST LIMIT 20")
def largest_structures(spark, sf_dir):
    return rollup.largest_groups(_pilot(spark, sf_dir), "structure_record_id", "spectrum_id")


@query(f"""WITH {_SPECTRA} SELECT count(*) AS n_spectra, count(DISTINCT structure_id) AS n_structures, count(DISTINCT connectivity_id) AS n_connectivities, count(*) FILTER (lipid_class <> '{rules.UNRESOLVED}') AS n_resolved,
 count(*) FILTER (adduct = 'unknown') AS n_unknown_adducts, count(*) FILTER (e_status = 'missing') AS n_missing_energies, count(DISTINCT peak_hash) AS n_peak_identities, count(DISTINCT record_hash) AS n_records FROM s4""")
def collection_summary(spark, sf_dir):
    c = F.col
    return _spectra(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_spectra"), F.count_distinct("structure_id").alias("n_structures"), F.count_distinct("connectivity_id").alias("n_connectivities"), F.count_if(c("lipid_class") != rules.UNRESOLVED).alias("n_resolved"),
        F.count_if(c("adduct") == "unknown").alias("n_unknown_adducts"), F.count_if(c("energy.status") == "missing").alias("n_missing_energies"), F.count_distinct("peak_identity_hash").alias("n_peak_identities"), F.count_distinct("acquisition_record_hash").alias("n_records"),
    )


@query("SELECT coalesce(a.key, b.key) AS key, coalesce(n_pilot, 0) AS n_pilot, coalesce(n_gold, 0) AS n_gold FROM (SELECT coalesce(structure_record_id, 'None') AS key, count(*) AS n_pilot FROM experimental_ms2_pilot GROUP BY 1) a FULL JOIN (SELECT coalesce(structure_record_id, 'None') AS key, count(*) AS n_gold FROM gold_spectra GROUP BY 1) b ON a.key = b.key")
def counts_by_structure(spark, sf_dir):
    return rollup.counts_from_two(_pilot(spark, sf_dir), table(spark, sf_dir, "gold_spectra"), F.col("structure_record_id"), ("n_pilot", "n_gold"))


# --- matching --------------------------------------------------------------------------------------


def _structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per delivered structure with its lists of keys."""
    rows = _pilot(spark, sf_dir).where("structure_record_id is not null").groupBy("structure_record_id").agg(
        sorted_distinct(truthy(F.col("smiles"))).alias("smiles_keys"), sorted_distinct(F.lower(truthy(F.col("name")))).alias("name_keys"),
        sorted_distinct(n.formula_key(n.formula_counts(F.col("formula")))).alias("formula_keys"), sorted_distinct(truthy(F.col("prototype_headgroup"))).alias("heads"),
    )
    pairs = F.flatten(F.transform("heads", lambda h: F.transform("formula_keys", lambda f: F.concat_ws("|", h, f))))
    return rows.withColumn("pair_keys", pairs)


def _tiers() -> list[tuple[str, Column, Column]]:
    key = n.formula_key(n.formula_counts(F.col("formula")))
    return [("A", F.col("name_keys"), F.lower("name")), ("B", F.col("smiles_keys"), F.col("smiles")), ("C", F.col("pair_keys"), F.concat(F.regexp_replace("main_class", "^L", ""), F.lit("|"), key)), ("D", F.col("formula_keys"), key)]


_FKEY = "(SELECT string_agg(e || CASE WHEN a = 1 THEN '' ELSE CAST(a AS VARCHAR) END, '' ORDER BY e) FROM (SELECT element AS e, sum(c) AS a FROM f WHERE f.k = {0} GROUP BY 1))"
_MATCH = f"""f AS ({_FORMULA_PARTS.format(key='row_id', src=PILOT)}), fr AS ({_FORMULA_PARTS.format(key='ref_id', src='compound_reference')}),
fk AS (SELECT k, string_agg(e || CASE WHEN a = 1 THEN '' ELSE CAST(a AS VARCHAR) END, '' ORDER BY e) AS fkey FROM (SELECT k, element AS e, sum(c) AS a FROM f GROUP BY 1, 2) GROUP BY 1),
frk AS (SELECT k, string_agg(e || CASE WHEN a = 1 THEN '' ELSE CAST(a AS VARCHAR) END, '' ORDER BY e) AS fkey FROM (SELECT k, element AS e, sum(c) AS a FROM fr GROUP BY 1, 2) GROUP BY 1),
pl AS (SELECT structure_record_id AS s, nullif(smiles, '') AS smi, lower(nullif(name, '')) AS nm, fkey, nullif(prototype_headgroup, '') AS hd FROM {PILOT} LEFT JOIN fk ON k = row_id WHERE structure_record_id IS NOT NULL),
rf AS (SELECT ref_id, lower(name) AS nm, smiles AS smi, fkey, regexp_replace(main_class, '^L', '') || '|' || fkey AS pr FROM compound_reference LEFT JOIN frk ON k = ref_id),
ik AS (SELECT s, 0 AS rank, 'A' AS tier, nm AS key, row_number() OVER (PARTITION BY s ORDER BY nm) - 1 AS pos FROM (SELECT DISTINCT s, nm FROM pl WHERE nm IS NOT NULL)
 UNION ALL SELECT s, 1, 'B', smi, row_number() OVER (PARTITION BY s ORDER BY smi) - 1 FROM (SELECT DISTINCT s, smi FROM pl WHERE smi IS NOT NULL)
 UNION ALL SELECT s, 2, 'C', hd || '|' || fkey, row_number() OVER (PARTITION BY s ORDER BY hd, fkey) - 1 FROM (SELECT DISTINCT a.s, a.hd, b.fkey FROM pl a JOIN pl b ON a.s = b.s WHERE a.hd IS NOT NULL AND b.fkey IS NOT NULL)
 UNION ALL SELECT s, 3, 'D', fkey, row_number() OVER (PARTITION BY s ORDER BY fkey) - 1 FROM (SELECT DISTINCT s, fkey FROM pl WHERE fkey IS NOT NULL)),
rk AS (SELECT 0 AS rank, nm AS key, ref_id FROM rf UNION ALL SELECT 1, smi, ref_id FROM rf UNION ALL SELECT 2, pr, ref_id FROM rf UNION ALL SELECT 3, fkey, ref_id FROM rf),
h AS (SELECT ik.s, ik.rank, ik.tier, ik.pos, ik.key, rk.ref_id FROM ik JOIN rk ON ik.rank = rk.rank AND ik.key = rk.key),
b AS (SELECT s, min(row(rank, pos)) AS m FROM h GROUP BY 1),
best AS (SELECT h.s, h.tier, CAST(h.pos AS INTEGER) AS pos, h.key, array_to_string(list_sort(list(DISTINCT h.ref_id)), '|') AS refs FROM h JOIN b ON h.s = b.s AND row(h.rank, h.pos) = b.m GROUP BY 1, 2, 3, 4)"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.tiered_match(_structures(spark, sf_dir), table(spark, sf_dir, "compound_reference"), "structure_record_id", "ref_id", _tiers())


@query(f"WITH {_MATCH} SELECT s AS structure_record_id, tier, pos AS key_position, key AS matched_key, refs AS ref_ids FROM best")
def tiered_match(spark, sf_dir):
    return _matches(spark, sf_dir).withColumn("ref_ids", F.array_join(F.col("ref_ids").cast("array<string>"), "|"))


@query(f"WITH {_MATCH} SELECT tier, count(DISTINCT s) AS n_structures FROM h GROUP BY 1")
def match_tier_counts(spark, sf_dir):
    hits = matching.tier_hits(_structures(spark, sf_dir), table(spark, sf_dir, "compound_reference"), "structure_record_id", _tiers())
    names = [t[0] for t in _tiers()]
    stacked = F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.col(f"hit_{t}").alias("hit")) for t in names]))
    return hits.select(stacked.alias("h")).where("h.hit").groupBy("h.tier").agg(F.count(F.lit(1)).alias("n_structures"))


@query(f"WITH {_MATCH} SELECT DISTINCT s AS structure_record_id FROM pl WHERE s NOT IN (SELECT s FROM best)")
def unmatched_structures(spark, sf_dir):
    return matching.unmatched(_structures(spark, sf_dir), _matches(spark, sf_dir), "structure_record_id").select("structure_record_id")


_TERMS = "CASE cls " + " ".join(f"WHEN {_q(c)} THEN [{', '.join(map(_q, t))}]" for c, t in rules.CLASS_TERMS.items()) + " ELSE [lower(cls)] END"


@query(f"""WITH x AS (SELECT DISTINCT c.row_id, p.cls, ' ' || lower(concat_ws(' ', r.name, r.abbreviation, r.main_class)) || ' ' AS t FROM (SELECT row_id, structure_record_id, lipid_class AS cls FROM {PILOT} WHERE lipid_class IS NOT NULL AND lipid_class <> '' AND lipid_class <> '{rules.UNRESOLVED}') p
 JOIN (SELECT row_id, name FROM {PILOT}) c ON c.row_id = p.row_id JOIN compound_reference r ON lower(r.name) = lower(c.name))
SELECT row_id, cls AS lipid_class, len(list_filter({_TERMS}, lambda y: contains(t, y))) > 0 AS consistent FROM x""")
def class_consistency(spark, sf_dir):
    refs = table(spark, sf_dir, "compound_reference").select(F.lower("name").alias("low"), F.concat_ws(" ", "name", "abbreviation", "main_class").alias("text"))
    rows = _pilot(spark, sf_dir).select("row_id", F.lower("name").alias("low"), F.array("lipid_class").alias("classes"))
    return rows.join(refs, "low").select("row_id", F.explode(n.class_consistency(F.col("classes"), F.col("text"))).alias("lipid_class", "consistent"))


@query(f"""WITH {_MATCH}, x AS (SELECT p.row_id, array_to_string(list_filter([CASE WHEN regexp_matches(coalesce(p.name, ''), {_q(rules.SUSPICIOUS_NAMES)}, 'i') THEN 'suspicious_name' END, CASE WHEN best.tier = 'D' THEN 'formula_only_match' END, CASE WHEN best.tier IS NULL THEN 'unmatched' END], lambda z: z IS NOT NULL), '|') AS flags
 FROM {PILOT} p LEFT JOIN best ON best.s = p.structure_record_id) SELECT * FROM x WHERE flags <> ''""")
def false_positive_audit(spark, sf_dir):
    rows = _pilot(spark, sf_dir).select("row_id", "name", "structure_record_id").join(_matches(spark, sf_dir).select("structure_record_id", "tier"), "structure_record_id", "left")
    labels = matching.flags(("suspicious_name", F.coalesce("name", F.lit("")).rlike(f"(?i){rules.SUSPICIOUS_NAMES}")), ("formula_only_match", F.col("tier") == "D"), ("unmatched", F.col("tier").isNull()))
    return rows.select("row_id", _joined(labels).alias("flags")).where("flags <> ''")


@query(f"""WITH x AS (SELECT row_id, lower(concat_ws(' ', lipid_class, name)) AS t, len(chains) AS c FROM {PILOT}),
y AS (SELECT *, list_distinct(regexp_extract_all(t, '\\b(\\d{{1,2}}:\\d{{1,2}}[ep])\\b', 1)) AS sh FROM x),
z AS (SELECT *, len(list_filter(sh, lambda s: ends_with(s, 'p') OR CAST(regexp_extract(s, ':(\\d+)', 1) AS INT) > 0)) AS vs FROM y),
w AS (SELECT *, vs + CASE WHEN regexp_matches(t, '\\b(?:p-|plasmenyl|vinyl ether|vinyl-ether|alkenyl|plasmalogen)\\b') THEN 1 ELSE 0 END AS nv, len(sh) - vs + CASE WHEN regexp_matches(t, '\\b(?:o-|plasmanyl|alkyl ether|alkyl-ether|alkyl)\\b') THEN 1 ELSE 0 END AS na FROM z)
SELECT row_id, CASE WHEN coalesce(c, 0) = 0 THEN NULL WHEN nv > 0 THEN array_to_string(list_sort(list_concat(list_transform(range(least(nv, c)), lambda i: 'vinyl_ether'), list_transform(range(greatest(c - nv, 0)), lambda i: 'ester'))), '|')
 WHEN na > 0 THEN array_to_string(list_sort(list_concat(list_transform(range(least(na, c)), lambda i: 'alkyl_ether'), list_transform(range(greatest(c - na, 0)), lambda i: 'ester'))), '|')
 WHEN regexp_matches(t, '\\b(?:diacyl|acyl|ester)\\b') THEN array_to_string(list_transform(range(c), lambda i: 'ester'), '|') END AS linkages FROM w""")
def expected_linkages(spark, sf_dir):
    text = F.concat_ws(" ", "lipid_class", "name")
    count = F.when(F.col("chains").isNotNull(), F.size("chains"))
    return _pilot(spark, sf_dir).select("row_id", _joined(n.expected_linkages(text, count)).alias("linkages"))


@query("SELECT gold_id, CASE WHEN len(coalesce(linkage_pattern, [])) = 0 THEN 'other' ELSE array_to_string(list_transform(list_sort(list_transform(linkage_pattern, lambda x: {'r': CASE x WHEN 'alkyl_ether' THEN 0 WHEN 'vinyl_ether' THEN 1 WHEN 'ester' THEN 2 ELSE 3 END, 'n': x})), lambda s: s.n), '/') END AS bucket FROM gold_spectra")
def linkage_buckets(spark, sf_dir):
    return table(spark, sf_dir, "gold_spectra").select("gold_id", n.linkage_bucket(F.col("linkage_pattern")).alias("bucket"))


@query(f"SELECT g.gold_id, g.row_id, g.structure_record_id, p.precursor_mz, coalesce(g.polarity, p.polarity) AS polarity FROM gold_spectra g LEFT JOIN {PILOT} p ON g.row_id = p.row_id")
def gold_with_pilot(spark, sf_dir):
    gold, pilot = table(spark, sf_dir, "gold_spectra").alias("g"), _pilot(spark, sf_dir).alias("p")
    return gold.join(pilot, F.col("g.row_id") == F.col("p.row_id"), "left").select("gold_id", "g.row_id", "g.structure_record_id", "p.precursor_mz", F.coalesce("g.polarity", "p.polarity").alias("polarity"))


@query("SELECT structure_record_id, array_to_string(list_sort(list(DISTINCT gold_lipid_class)), '|') AS values, count(*) AS n_rows FROM gold_spectra GROUP BY 1 HAVING count(DISTINCT gold_lipid_class) > 1")
def conflicting_classes(spark, sf_dir):
    return matching.conflicts(table(spark, sf_dir, "gold_spectra"), "structure_record_id", "gold_lipid_class").withColumn("values", _joined(F.col("values")))


@query("SELECT gold_id, CASE WHEN EXISTS (SELECT 1 FROM gold_spectra o WHERE o.structure_record_id = g.structure_record_id AND o.gold_lipid_class <> g.gold_lipid_class) THEN 'conflict' ELSE gold_lipid_class END AS gold_lipid_class FROM gold_spectra g")
def conflict_override(spark, sf_dir):
    gold = table(spark, sf_dir, "gold_spectra", "gold_id", "structure_record_id", "gold_lipid_class")
    # a null structure is in conflict with nothing
    return matching.override_conflicts(gold, "structure_record_id", "gold_lipid_class", "conflict").select("gold_id", "gold_lipid_class")


@query(f"SELECT coalesce(p.lipid_class, 'None') || '->' || coalesce(g.gold_lipid_class, 'None') AS correction, count(*) AS n FROM gold_spectra g JOIN {PILOT} p ON g.row_id = p.row_id WHERE p.lipid_class IS DISTINCT FROM g.gold_lipid_class GROUP BY 1")
def correction_histogram(spark, sf_dir):
    gold, pilot = table(spark, sf_dir, "gold_spectra", "row_id", "gold_lipid_class"), _pilot(spark, sf_dir).select("row_id", "lipid_class")
    pair = F.concat_ws("->", F.coalesce("lipid_class", F.lit("None")), F.coalesce("gold_lipid_class", F.lit("None")))
    return gold.join(pilot, "row_id").where(~F.col("lipid_class").eqNullSafe(F.col("gold_lipid_class"))).groupBy(pair.alias("correction")).agg(F.count(F.lit(1)).alias("n"))


# --- stratified group split --------------------------------------------------------------------------


def _gold_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "gold_spectra").where("structure_record_id is not null")
    return group_split.group_strata(gold, "structure_record_id", {"a": "gold_lipid_class", "b": "polarity"})


_STRATA = "gs AS (SELECT structure_record_id AS g, '(''' || coalesce(array_to_string(list_sort(list(DISTINCT gold_lipid_class) FILTER (gold_lipid_class IS NOT NULL)), '+'), '') || ''', ''' || coalesce(array_to_string(list_sort(list(DISTINCT polarity) FILTER (polarity IS NOT NULL)), '+'), '') || ''')' AS stratum FROM gold_spectra WHERE structure_record_id IS NOT NULL GROUP BY 1)"


@query(f"WITH {_STRATA} SELECT g AS structure_record_id, stratum FROM gs")
def split_strata(spark, sf_dir):
    return _gold_groups(spark, sf_dir)


def _targets_sql() -> str:
    step = """, {out}0 AS (SELECT *, w_{s} - sum({s}) OVER () AS gap, n * 0.1::DOUBLE - floor(n * 0.1::DOUBLE) AS fr FROM {src}),
{out}p AS (SELECT stratum, n, gap, fr, unnest(range(1, CAST(CASE WHEN gap > 0 THEN n - validation - test ELSE {s} END AS BIGINT) + 1)) AS step FROM {out}0),
{out}r AS (SELECT stratum, CASE WHEN gap > 0 THEN 1 ELSE -1 END AS d, gap, row_number() OVER (ORDER BY step, CASE WHEN gap > 0 THEN -fr ELSE fr END, CASE WHEN gap > 0 THEN -n ELSE n END, stratum) AS rk FROM {out}p),
{out} AS (SELECT a.* EXCLUDE (gap, fr) REPLACE (a.{s} + coalesce(c.ch, 0) AS {s}) FROM {out}0 a LEFT JOIN (SELECT stratum, sum(d) AS ch FROM {out}r WHERE rk <= abs(gap) GROUP BY 1) c USING (stratum))"""
    return (_STRATA + """, sz AS (SELECT stratum, count(*) AS n, CASE WHEN count(*) >= 10 THEN floor(count(*) * 0.1::DOUBLE) ELSE 0 END AS validation, CASE WHEN count(*) >= 10 THEN floor(count(*) * 0.1::DOUBLE) ELSE 0 END AS test FROM gs GROUP BY 1),
tt AS (SELECT sum(n) AS total, CAST(round_even(sum(n) * 0.8::DOUBLE, 0) AS BIGINT) AS w_train, CAST(round_even(sum(n) * 0.1::DOUBLE, 0) AS BIGINT) AS w_validation FROM sz),
t0 AS (SELECT sz.*, w_validation, total - w_train - w_validation AS w_test FROM sz, tt)""" + step.format(out="t1", src="t0", s="validation") + step.format(out="t2", src="t1", s="test"))  # fmt: skip


@query(f"WITH {_targets_sql()} SELECT stratum, n, CAST(validation AS BIGINT) AS validation, CAST(test AS BIGINT) AS test, CAST(n - validation - test AS BIGINT) AS train FROM t2")
def split_targets(spark, sf_dir):
    return group_split.stratum_targets(_gold_groups(spark, sf_dir))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _gold_groups(spark, sf_dir)
    return group_split.assign(groups, group_split.stratum_targets(groups), "structure_record_id")


_ASSIGN = _targets_sql() + ", asg AS (SELECT g, gs.stratum, row_number() OVER (PARTITION BY gs.stratum ORDER BY sha256('20260626:' || g), g) AS nth, validation, test FROM gs JOIN t2 USING (stratum)), sp AS (SELECT g, stratum, CASE WHEN nth <= validation THEN 'validation' WHEN nth <= validation + test THEN 'test' ELSE 'train' END AS split FROM asg)"


@query(f"WITH {_ASSIGN} SELECT g AS structure_record_id, stratum, split FROM sp")
def group_split_assignment(spark, sf_dir):
    return _assigned(spark, sf_dir)


@query(f"WITH {_ASSIGN} SELECT coalesce(gold_lipid_class, 'None') AS value, coalesce(split, 'unassigned') AS split, count(DISTINCT structure_record_id) AS n_groups, count(*) AS n_rows FROM gold_spectra LEFT JOIN sp ON g = structure_record_id GROUP BY 1, 2")
def group_split_counts(spark, sf_dir):
    return group_split.split_counts(table(spark, sf_dir, "gold_spectra"), _assigned(spark, sf_dir), "structure_record_id", "gold_lipid_class")


@query(f"""WITH {_ASSIGN}, x AS (SELECT peak_identity_hash AS i, list(DISTINCT split) AS s FROM gold_spectra JOIN sp ON g = structure_record_id WHERE peak_identity_hash IS NOT NULL GROUP BY 1), pr AS (SELECT unnest([['train', 'validation'], ['test', 'train'], ['test', 'validation']]) AS p)
SELECT p[1] AS left_split, p[2] AS right_split, CAST(sum(CASE WHEN list_contains(s, p[1]) AND list_contains(s, p[2]) THEN 1 ELSE 0 END) AS BIGINT) AS n_shared FROM x, pr GROUP BY 1, 2""")
def group_split_leakage(spark, sf_dir):
    return group_split.leakage(table(spark, sf_dir, "gold_spectra"), _assigned(spark, sf_dir), "structure_record_id", "peak_identity_hash")


# --- features, labels, model outputs ---------------------------------------------------------------------

#: The reference's max_peaks.
_MOST = 200
_FEATURES = """fx AS (SELECT row_id, precursor_mz, list_filter(coalesce(peaks_raw, []), lambda p: p[1] IS NOT NULL AND p[2] IS NOT NULL AND isfinite(p[1]) AND isfinite(p[2]) AND p[2] >= 0) AS k FROM experimental_ms2_pilot),
fe AS (SELECT row_id, precursor_mz, list_max(list_transform(k, lambda p: p[2])) AS top, unnest(list_transform(k, lambda p, i: {'mz': p[1], 'v': p[2], 'i': i})) AS q FROM fx WHERE precursor_mz IS NOT NULL),
fr AS (SELECT row_id, precursor_mz, q.mz AS mz, sqrt(q.v / top) AS v, q.i AS i, row_number() OVER (PARTITION BY row_id ORDER BY sqrt(q.v / top) DESC, q.i) AS rk FROM fe WHERE top > 0),
fs AS (SELECT row_id, mz / 1000.0::DOUBLE AS mz, v, (precursor_mz - mz) / 1000.0::DOUBLE AS delta, row_number() OVER (PARTITION BY row_id ORDER BY mz, v, i) - 1 AS slot FROM fr WHERE rk <= 200)"""


@query(f"WITH {_FEATURES} SELECT row_id, CAST(slot AS INTEGER) AS slot, round(mz, 9) AS mz, round(v, 6) AS intensity, round(delta, 9) + 0.0::DOUBLE AS delta FROM fs")
def peak_features(spark, sf_dir):
    rows = _pilot(spark, sf_dir).select("row_id", p.peak_features(F.col("peaks_raw"), F.col("precursor_mz"), most=_MOST).alias("f"))
    return rows.select("row_id", F.posexplode("f").alias("slot", "x")).select("row_id", "slot", F.round("x.mz", 9).alias("mz"), F.round("x.intensity", 6).alias("intensity"), (F.round("x.delta", 9) + F.lit(0.0)).alias("delta"))


@query(f"WITH {_FEATURES}, c AS (SELECT row_id, count(*) AS c FROM fs GROUP BY 1) SELECT row_id, CAST(i AS INTEGER) AS slot, i >= coalesce(c, 0) AS masked FROM experimental_ms2_pilot LEFT JOIN c USING (row_id), (SELECT unnest(range(0, 200)) AS i)")
def padded_masks(spark, sf_dir):
    rows = _pilot(spark, sf_dir).select("row_id", p.pad(p.peak_features(F.col("peaks_raw"), F.col("precursor_mz"), most=_MOST), _MOST).alias("f"))
    return rows.select("row_id", F.posexplode("f.mask").alias("slot", "masked"))


_HEADS = "CASE h " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(rules.HEADGROUPS)) + " END"
_LINK = "CASE WHEN lower(trim({0})) IN ('ester', 'ether', 'vinyl_ether') THEN lower(trim({0})) END"
_LABELS = f"""l0 AS (SELECT row_id, coalesce(nullif(prototype_headgroup, ''), lipid_class) AS h, coalesce(chains, []) AS c, {_LINK.format('chain_linkage_summary')} AS sm FROM experimental_ms2_pilot),
l1 AS (SELECT row_id, {_HEADS} AS head, list_sort(list_transform(c, lambda x: {{'carbon': x.carbon, 'db': x.double_bonds, 'rank': CASE coalesce({_LINK.format('x.linkage')}, CASE WHEN len(c) = 1 THEN sm END) WHEN 'ester' THEN 0 WHEN 'ether' THEN 1 WHEN 'vinyl_ether' THEN 2 ELSE 3 END}})) AS c FROM l0)"""


@query(f"""WITH {_LABELS} SELECT row_id, CASE WHEN head IS NULL THEN 'unsupported headgroup' WHEN len(c) < 1 OR len(c) > 2 THEN 'unsupported chain count' WHEN len(list_filter(c, lambda x: coalesce(x.carbon BETWEEN 2 AND 40, false))) < len(c) THEN 'carbon out of range'
 WHEN len(list_filter(c, lambda x: coalesce(x.db BETWEEN 0 AND 12, false))) < len(c) THEN 'double bonds out of range' END AS error, head AS headgroup, CAST(len(c) - 1 AS INTEGER) AS chain_count,
 coalesce(c[1].carbon - 2, 0) AS carbon_0, coalesce(c[2].carbon - 2, 0) AS carbon_1, coalesce(c[1].db, 0) AS double_bonds_0, coalesce(c[2].db, 0) AS double_bonds_1, len(c) > 0 AND c[1].rank < 3 AS linked_0, len(c) > 1 AND c[2].rank < 3 AS linked_1 FROM l1""")
def label_encoding(spark, sf_dir):
    labels = p.record_labels(F.col("prototype_headgroup"), F.col("lipid_class"), F.col("chains"), F.col("chain_linkage_summary"))
    x = _pilot(spark, sf_dir).select("row_id", labels.alias("l"))
    slots = [F.coalesce(F.get(f"l.{f}", F.lit(i)), F.lit(0)).alias(f"{f}_{i}") for f in ("carbon", "double_bonds") for i in (0, 1)]
    return x.select("row_id", "l.error", "l.headgroup", F.col("l.chain_count").cast("int").alias("chain_count"), *slots, *[F.get("l.linkage_mask", F.lit(i)).alias(f"linked_{i}") for i in (0, 1)])


@query(f"WITH {_LABELS} SELECT row_id, prototype_headgroup || '(' || array_to_string(list_transform(c, lambda x: CAST(x.carbon AS VARCHAR) || ':' || CAST(x.db AS VARCHAR)), '_') || ')' AS shown FROM l1 JOIN experimental_ms2_pilot USING (row_id) WHERE prototype_headgroup IS NOT NULL")
def display_names(spark, sf_dir):
    shown = p.display_name(F.col("prototype_headgroup"), p.sorted_chains(F.col("chains"), F.col("chain_linkage_summary")))
    return _pilot(spark, sf_dir).where("prototype_headgroup is not null").select("row_id", shown.alias("shown"))


_SOFT = "sx AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings), sm AS (SELECT vec_id, label, z, list_max(z) AS m FROM sx), sp AS (SELECT *, list_sum(list_transform(z, lambda x: exp(x - m))) AS t FROM sm)"


@query(f"WITH {_SOFT} SELECT vec_id, CAST(list_position(z, m) - 1 AS INTEGER) AS best, round(1 / t, 6) AS probability, 1 / t < 0.5 AS low_confidence FROM sp")
def softmax_argmax(spark, sf_dir):
    logits = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", p.softmax(logits).alias("q"), p.argmax(logits).alias("best"))
    return rows.select("vec_id", "best", F.round(F.array_max("q"), 6).alias("probability"), (F.array_max("q") < 0.5).alias("low_confidence"))


@query(f"WITH {_SOFT}, {_LABELS} SELECT label, round(coalesce(avg(CASE WHEN len(c) > 1 THEN ln(t) + m - z[label % 64 + 1] END), 0), 6) AS loss, count(CASE WHEN len(c) > 1 THEN 1 END) AS n_unmasked, count(*) AS n_rows FROM sp LEFT JOIN l1 ON row_id = vec_id GROUP BY 1")
def masked_cross_entropy(spark, sf_dir):
    logits = F.transform("embedding", lambda x: x.cast("double"))
    encoded = p.record_labels(F.col("prototype_headgroup"), F.col("lipid_class"), F.col("chains"), F.col("chain_linkage_summary"))
    masks = _pilot(spark, sf_dir).select(F.col("row_id").alias("vec_id"), encoded["chain_mask"][1].alias("m"))
    rows = table(spark, sf_dir, "embeddings").join(masks, "vec_id", "left").select("label", p.cross_entropy(logits, F.col("label") % 64).alias("l"), F.coalesce("m", F.lit(False)).alias("m"))
    return rows.groupBy("label").agg(F.round(p.masked_mean(F.col("l"), F.col("m")), 6).alias("loss"), F.count_if("m").alias("n_unmasked"), F.count(F.lit(1)).alias("n_rows"))


@query("""WITH x AS (SELECT vec_id, abs(label) AS a, vec_id AS v FROM embeddings),
c AS (SELECT vec_id, list_sort([{'c': 2 + a % 39, 'd': a % 13, 'r': a % 3}, {'c': 2 + v % 39, 'd': v % 13, 'r': v % 3}][1:CAST(1 + v % 2 AS INT)]) AS ch FROM x)
SELECT vec_id, array_to_string(list_transform(ch, lambda s: CAST(s.c AS VARCHAR) || ':' || CAST(s.d AS VARCHAR) || ' ' || ['ester', 'ether', 'vinyl_ether'][s.r + 1]), '_') AS chains FROM c""")
def label_decoding(spark, sf_dir):
    """One or two chains from class indices, sorted; indices from the labels and ids of the table."""
    pair = lambda of: F.array(*[(of(F.col(c))).cast("int") for c in ("a", "vec_id")])
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.abs("label").alias("a"))
    chains = p.decoded_chains(pair(lambda x: x % 39), pair(lambda x: x % 13), pair(lambda x: x % 3), (1 + F.col("vec_id") % 2).cast("int"))
    shown = F.transform(chains, lambda x: F.concat(x["carbon"].cast("string"), F.lit(":"), x["double_bonds"].cast("string"), F.lit(" "), x["linkage"]))
    return rows.select("vec_id", F.array_join(shown, "_").alias("chains"))
