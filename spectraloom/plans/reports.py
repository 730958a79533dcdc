"""Queries of curation, review, checks and summaries, each with its DuckDB SQL.

The delivered tables hold no evaluated structures with faults, so the curation queries plant them: one
structure for each row of gold_spectra, with a class, a parse status and faults that its number gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.functions import normalize as n
from spectraloom.functions import rules
from spectraloom.functions.text import sorted_distinct, truthy
from spectraloom.operators import checks, curation, duplicates, evaluation, matching
from spectraloom.plans.spectral import _FORMULA_PARTS, _GROUPS, _SPECTRA, PILOT, _assigned, _like_any, _q, _spectra
from spectraloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_CLASSES = ["PC", "PE", "PA", "PS", "PI", "PG", "LPC", "SM", None, "S1P", "NAPE"]
_STATUS = ["success", "success", "success", "unsupported_backbone", "unsupported_topology", "unsupported_extra_substitution", "invalid_input", "failed"]


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, names = table(spark, sf_dir, "gold_spectra", "gold_id", "row_id"), table(spark, sf_dir, PILOT, "row_id", "name")
    rows = gold.join(names, "row_id", "left")
    g = F.col("gold_id")
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    out = rows.select(
        g.alias("structure"), F.floor(g / 3).cast("string").alias("connectivity_id"), pick(_CLASSES, g % 11).alias("expected_class"), pick(_STATUS, F.floor(g / 7) % 8).alias("parse_status"), (g % 5).alias("kind"),
        F.when(g % 2 == 0, F.array(F.lit("multiple_phosphorus_atoms"))).otherwise(F.array().cast("array<string>")).alias("reasons"), (1 + g % 2).cast("int").alias("chain_count"), (g % 10 != 0).alias("exact"),
        F.when(g % 13 != 0, F.lit("CCOP")).alias("smiles"), "name", (1 + g % 4).alias("n_spectra"), F.when(g % 17 == 0, "headgroup_not_serine").alias("exclusion"),
        F.when(g % 3 == 0, "sphingoid_or_unsupported").otherwise("glycerol").alias("backbone_family"), F.lit(1).alias("free_hydroxyls"), F.when(g % 19 == 0, 0.9).otherwise(1.0).alias("coverage"), F.lit(0).alias("unassigned"), F.lit(0).alias("overlapping"),
    )
    derived = F.when(F.col("kind") < 2, F.col("expected_class")).when(F.col("kind") == 2, F.concat(F.lit("L"), F.col("expected_class"))).when(F.col("kind") == 3, F.lit("PG"))
    out = out.withColumn("lipid_class", derived).withColumn("names", F.array_compact(F.array("name")))
    eligible = F.coalesce(F.col("expected_class").isin(rules.SUPPORTED_CLASSES), F.lit(False)) & F.col("smiles").isNotNull() & F.col("exclusion").isNull()
    out = out.withColumn("eligible", eligible)
    good = F.col("eligible") & (F.col("parse_status") == "success") & F.col("exact") & (F.col("lipid_class") == F.col("expected_class"))
    return out.withColumn("success", F.coalesce(good, F.lit(False)))


_SUPPORTED = ", ".join(map(_q, rules.SUPPORTED_CLASSES))
_list = lambda values: "[" + ", ".join("NULL" if v is None else _q(v) for v in values) + "]"
_PLANTED = f"""p0 AS (SELECT gold_id AS structure, CAST(gold_id // 3 AS VARCHAR) AS connectivity_id, {_list(_CLASSES)}[gold_id % 11 + 1] AS expected_class, {_list(_STATUS)}[(gold_id // 7) % 8 + 1] AS parse_status, gold_id % 5 AS kind,
 gold_id % 2 = 0 AS multi, 1 + gold_id % 2 AS chain_count, gold_id % 10 <> 0 AS exact, CASE WHEN gold_id % 13 <> 0 THEN 'CCOP' END AS smiles, name, 1 + gold_id % 4 AS n_spectra, CASE WHEN gold_id % 17 = 0 THEN 'x' END AS exclusion,
 gold_id % 3 = 0 AS sphingoid, gold_id % 19 <> 0 AS covered FROM gold_spectra LEFT JOIN {PILOT} USING (row_id)),
p1 AS (SELECT *, CASE WHEN kind < 2 THEN expected_class WHEN kind = 2 THEN 'L' || expected_class WHEN kind = 3 THEN 'PG' END AS lipid_class,
 coalesce(expected_class IN ({_SUPPORTED}), false) AND smiles IS NOT NULL AND exclusion IS NULL AS eligible FROM p0),
p2 AS (SELECT *, coalesce(eligible AND parse_status = 'success' AND exact AND lipid_class = expected_class, false) AS success,
 eligible AND parse_status = 'success' AND exact AND lipid_class IS DISTINCT FROM expected_class AS other FROM p1),
ly AS (SELECT *, CASE WHEN success THEN 'gold_v0_1|parser_success_label_agree' WHEN coalesce(expected_class NOT IN ({_SUPPORTED}), true) THEN 'class_out_of_scope|strict_class_outside_glycerophospholipid_v0_1_scope'
 WHEN other AND chain_count = 1 AND expected_class IN ('PC', 'PE', 'PA', 'PS', 'PI', 'PG') THEN 'relabel_review|single_chain_graph_with_free_glycerol_hydroxyl' WHEN other THEN 'relabel_review|parser_derived_class_disagrees_with_source_strict_label'
 WHEN smiles IS NULL THEN 'invalid_or_incomplete_structure|canonical_structure_missing' WHEN exclusion IS NOT NULL OR parse_status = 'invalid_input' THEN 'invalid_or_incomplete_structure|source_label_structure_conflict'
 WHEN parse_status = 'unsupported_backbone' AND expected_class = 'PA' THEN 'invalid_or_incomplete_structure|zero_chain_glycerophosphate_labelled_as_PA'
 WHEN parse_status = 'unsupported_backbone' AND expected_class = 'PC' THEN 'invalid_or_incomplete_structure|headgroup_or_glycerophosphocholine_record_lacks_hydrophobic_chain'
 WHEN parse_status = 'unsupported_extra_substitution' THEN 'parser_scope_exclusion|extra_backbone_substitution_outside_v0_1' WHEN parse_status = 'unsupported_topology' AND multi THEN 'parser_scope_exclusion|multi_phosphorus_topology_outside_v0_1'
 WHEN parse_status = 'unsupported_topology' THEN 'parser_scope_exclusion|unsupported_topology_outside_v0_1' WHEN parse_status = 'unsupported_backbone' AND (sphingoid OR coalesce(contains(lower(name), 'sphingosyl'), false)) THEN 'parser_scope_exclusion|sphingoid_backbone_outside_v0_1'
 WHEN parse_status = 'unsupported_backbone' THEN 'parser_scope_exclusion|unsupported_backbone_outside_v0_1' ELSE 'needs_manual_review|unclassified_non_gold_case' END AS o FROM p2),
cu AS (SELECT *, string_split(o, '|')[1] AS layer, string_split(o, '|')[2] AS reason FROM ly),
cf AS (SELECT connectivity_id, array_to_string(list_sort(list(DISTINCT layer)), '|') AS layers, count(*) AS n_rows FROM cu GROUP BY 1 HAVING count(DISTINCT layer) > 1)"""


@query(f"WITH {_PLANTED} SELECT structure, layer, reason, layer NOT IN ('gold_v0_1', 'class_out_of_scope') AS needs_review, CASE WHEN cf.connectivity_id IS NULL THEN layer ELSE 'conflict' END AS final_layer FROM cu LEFT JOIN cf USING (connectivity_id)")
def curation_layers(spark, sf_dir):
    """The layer of every planted structure, with conflicting connectivities overridden."""
    return curation.curated(_planted(spark, sf_dir)).select("structure", "layer", "reason", "needs_review", "final_layer")


@query(f"WITH {_PLANTED} SELECT connectivity_id, layers, n_rows FROM cf")
def curation_conflicts(spark, sf_dir):
    found = curation.connectivity_conflicts(curation.curated(_planted(spark, sf_dir)))
    return found.select("connectivity_id", F.array_join("values", "|").alias("layers"), "n_rows")


@query(f"""WITH {_PLANTED} SELECT 'layer:' || layer AS metric, count(*) AS value FROM cu GROUP BY 1
 UNION ALL SELECT 'relabel:' || expected_class || '->' || coalesce(lipid_class, 'None'), count(*) FROM cu WHERE layer = 'relabel_review' GROUP BY 1
 UNION ALL SELECT unnest(['strict_structures', 'distinct_structures', 'graph_parse_success_exact', 'gold_connectivities', 'gold_spectra_expected', 'needs_review', 'layer_count_sum']),
  unnest([count(*), count(DISTINCT structure), count(*) FILTER (parse_status = 'success' AND exact), count(DISTINCT connectivity_id) FILTER (layer = 'gold_v0_1'), CAST(coalesce(sum(n_spectra) FILTER (layer = 'gold_v0_1'), 0) AS BIGINT), count(*) FILTER (layer NOT IN ('gold_v0_1', 'class_out_of_scope')), count(*)]) FROM cu
 UNION ALL SELECT 'gold_spectra', count(*) FROM gold_spectra UNION ALL SELECT 'connectivity_conflicts', count(*) FROM cf""")
def curation_summary(spark, sf_dir):
    rows = curation.curated(_planted(spark, sf_dir))
    return curation.curation_summary(rows, table(spark, sf_dir, "gold_spectra", "gold_id"), "structure")


def _supports_sql(label: str) -> str:
    t, low = "lower(coalesce(name, ''))", f"lower({label})"
    words = {"pc": "phosphatidylcholine", "pe": "phosphatidylethanolamine", "pi": "phosphatidylinositol"}
    return f"CASE {low} " + " ".join(f"WHEN '{c}' THEN contains({t}, '{w}') OR contains(' ' || {t}, ' {c}')" for c, w in words.items()) + f" ELSE contains({t}, {low}) END"


@query(f"""WITH {_PLANTED}, r0 AS (SELECT *, expected_class || '->' || coalesce(lipid_class, 'None') AS pair, coalesce({_supports_sql('expected_class')}, false) AS sc,
 coalesce(contains(lower(coalesce(name, '')), 'lyso') OR {_supports_sql('lipid_class')}, false) AS sp, chain_count = 1 AND exact AND covered AS whole FROM cu WHERE layer = 'relabel_review')
SELECT CAST(row_number() OVER (ORDER BY CASE pair WHEN 'PC->LPC' THEN 1 WHEN 'PE->LPE' THEN 2 WHEN 'PI->LPI' THEN 3 ELSE 4 END, CASE WHEN sp THEN 0 WHEN sc THEN 2 ELSE 1 END, structure) AS BIGINT) AS review_order,
 CASE WHEN whole AND sp THEN 'A' WHEN whole AND NOT sc THEN 'B' ELSE 'C' END AS review_batch, structure, expected_class AS current_label, lipid_class AS proposed_label, sc AS supports_current, sp AS supports_proposed,
 CASE WHEN whole AND sp THEN 'approve_candidate' ELSE 'inspect' END AS suggested_decision FROM r0""")
def relabel_package(spark, sf_dir):
    """Relabel candidates numbered for review, in batches."""
    out = curation.review_package(curation.curated(_planted(spark, sf_dir)), "structure")
    return out.select(F.col("review_order").cast("bigint").alias("review_order"), "review_batch", "structure", "current_label", "proposed_label", "supports_current", "supports_proposed", "suggested_decision")


_CONTROLS = ", ".join(f"({_q(k)}, {_list(v)})" for k, v in rules.CONTROL_CLASSES.items())


@query(f"""WITH {_PLANTED}, ct(cc, bad) AS (VALUES {_CONTROLS}) SELECT cc AS control_class, count(structure) AS n_tested, count(*) FILTER (list_contains(bad, lipid_class)) AS n_violations,
 CASE WHEN count(structure) = 0 THEN 'no_sample' ELSE 'tested' END AS sample_status FROM ct LEFT JOIN p2 ON expected_class = cc GROUP BY 1""")
def control_summary(spark, sf_dir):
    """Negative controls: how many structures of each control class were tested, and how many got a class they must not have."""
    return evaluation.control_summary(evaluation.negative_controls(_planted(spark, sf_dir), "structure"))


@query(f"""SELECT 'gold_row' AS "check", count(*) FILTER (row_id IS NOT NULL AND row_id NOT IN (SELECT row_id FROM {PILOT} WHERE row_id IS NOT NULL)) AS n_missing, count(*) FILTER (row_id IS NULL) AS n_null FROM gold_spectra
 UNION ALL SELECT 'gold_structure', count(*) FILTER (structure_record_id IS NOT NULL AND structure_record_id NOT IN (SELECT structure_record_id FROM {PILOT} WHERE structure_record_id IS NOT NULL)), count(*) FILTER (structure_record_id IS NULL) FROM gold_spectra
 UNION ALL SELECT 'gold_spectrum', count(*) FILTER (spectrum_id IS NOT NULL AND spectrum_id NOT IN (SELECT spectrum_id FROM {PILOT} WHERE spectrum_id IS NOT NULL)), count(*) FILTER (spectrum_id IS NULL) FROM gold_spectra""")
def referential_checks(spark, sf_dir):
    keys = {"gold_row": ("row_id", "row_id"), "gold_structure": ("structure_record_id", "structure_record_id"), "gold_spectrum": ("spectrum_id", "spectrum_id")}
    return checks.referential_checks(table(spark, sf_dir, "gold_spectra"), table(spark, sf_dir, PILOT), keys)


@query("SELECT count(*) AS n_whole, count(*) AS n_parts, 0::BIGINT AS n_lost, 0::BIGINT AS n_added FROM gold_spectra WHERE structure_record_id IS NOT NULL")
def split_union_check(spark, sf_dir):
    """The three splits of the gold spectra together hold the input's rows, each as often."""
    gold = table(spark, sf_dir, "gold_spectra", "gold_id", "structure_record_id").where("structure_record_id is not null")
    placed = gold.join(_assigned(spark, sf_dir).select("structure_record_id", "split"), "structure_record_id")
    return checks.same_rows(gold, [placed.where(F.col("split") == s) for s in ("train", "validation", "test")])


_KEY14 = r"regexp_extract(upper({0}), '^([A-Z]{{14}})(-[A-Z]{{10}}-[A-Z])?$', 1)"
_FULL = r"CASE WHEN regexp_full_match(upper({0}), '[A-Z]{{14}}-[A-Z]{{10}}-[A-Z]') THEN upper({0}) END"
_FKEYS = "SELECT k, string_agg(element || CASE WHEN a = 1 THEN '' ELSE CAST(a AS VARCHAR) END, '' ORDER BY element) AS fkey FROM (SELECT k, element, sum(c) AS a FROM ({0}) GROUP BY 1, 2) GROUP BY 1"
_REFTIERS = rf"""pf AS ({_FKEYS.format(_FORMULA_PARTS.format(key='row_id', src=PILOT))}), rf AS ({_FKEYS.format(_FORMULA_PARTS.format(key='raw_id', src='massspecgym_raw'))}),
pk AS (SELECT structure_record_id AS s, {_FULL.format('trim(inchikey)')} AS full_key, nullif(trim(smiles), '') AS smi, nullif({_KEY14.format('trim(inchikey)')}, '') AS conn, fkey FROM {PILOT} LEFT JOIN pf ON k = row_id WHERE structure_record_id IS NOT NULL),
rk AS (SELECT raw_id, {_FULL.format('trim(inchikey)')} AS full_key, nullif(trim(smiles), '') AS smi, nullif({_KEY14.format('trim(inchikey)')}, '') AS conn, fkey FROM massspecgym_raw LEFT JOIN rf ON k = raw_id),
ik AS (SELECT DISTINCT s, 'A' AS tier, full_key AS key FROM pk WHERE full_key IS NOT NULL UNION SELECT DISTINCT s, 'B', smi FROM pk WHERE smi IS NOT NULL
 UNION SELECT DISTINCT a.s, 'C', a.conn || '|' || b.fkey FROM pk a JOIN pk b USING (s) WHERE a.conn IS NOT NULL AND b.fkey IS NOT NULL UNION SELECT DISTINCT s, 'D', conn FROM pk WHERE conn IS NOT NULL),
rr AS (SELECT raw_id, 'A' AS tier, full_key AS key FROM rk UNION ALL SELECT raw_id, 'B', smi FROM rk UNION ALL SELECT raw_id, 'C', conn || '|' || fkey FROM rk UNION ALL SELECT raw_id, 'D', conn FROM rk),
hh AS (SELECT s, tier, key, raw_id FROM ik JOIN rr USING (tier, key)), bb AS (SELECT s, min(row(tier, key)) AS b FROM hh GROUP BY 1)"""


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per delivered structure with its sorted keys."""
    key = n.identifier_fields(F.trim("inchikey"))
    rows = table(spark, sf_dir, PILOT).where("structure_record_id is not null").select(
        "structure_record_id", key.alias("i"), truthy(F.trim("smiles")).alias("smi"), n.formula_key(n.formula_counts(F.col("formula"))).alias("fkey"))
    out = rows.groupBy("structure_record_id").agg(
        sorted_distinct(F.col("i.full_key")).alias("full_keys"), sorted_distinct(F.col("smi")).alias("smiles_keys"), sorted_distinct(F.col("i.connectivity_key")).alias("conn_keys"), sorted_distinct(truthy(F.col("fkey"))).alias("formula_keys"),
    )
    pairs = F.flatten(F.transform("conn_keys", lambda c: F.transform("formula_keys", lambda f: F.concat_ws("|", c, f))))
    return out.withColumn("pair_keys", F.array_sort(pairs))


def _reference_tiers():
    key = n.identifier_fields(F.trim("inchikey"))
    pair = F.concat(key["connectivity_key"], F.lit("|"), truthy(n.formula_key(n.formula_counts(F.col("formula")))))
    return [("A", F.col("full_keys"), key["full_key"]), ("B", F.col("smiles_keys"), truthy(F.trim("smiles"))), ("C", F.col("pair_keys"), pair), ("D", F.col("conn_keys"), key["connectivity_key"])]


@query(f"""WITH {_REFTIERS} SELECT hh.s AS structure_record_id, hh.tier, hh.key AS matched_key, count(DISTINCT raw_id) AS candidate_count, hh.tier IN ('A', 'B') AS exact_reference_match, hh.tier IN ('C', 'D') AS stereochemistry_warning, hh.tier = 'D' AS charge_warning
 FROM hh JOIN bb ON hh.s = bb.s AND row(hh.tier, hh.key) = bb.b GROUP BY 1, 2, 3""")
def reference_tiers(spark, sf_dir):
    """Structures against the MassSpecGym rows by full key, structure text, connectivity with formula, and connectivity alone."""
    found = matching.tiered_match(_identified(spark, sf_dir), table(spark, sf_dir, "massspecgym_raw"), "structure_record_id", "raw_id", _reference_tiers())
    c = F.col("tier")
    return found.select("structure_record_id", "tier", "matched_key", F.size("ref_ids").cast("bigint").alias("candidate_count"), c.isin("A", "B").alias("exact_reference_match"), c.isin("C", "D").alias("stereochemistry_warning"), (c == "D").alias("charge_warning"))


@query(f"""WITH {_REFTIERS}, al AS (SELECT DISTINCT s FROM pk), mt AS (SELECT s, b[1] AS tier FROM bb)
SELECT 'tier:' || tier AS metric, count(*) AS value FROM mt GROUP BY 1
 UNION ALL SELECT 'unique_structures', count(*) FROM al UNION ALL SELECT 'matched_structures', count(*) FROM mt UNION ALL SELECT 'unmatched_structures', count(*) FROM al WHERE s NOT IN (SELECT s FROM mt)
 UNION ALL SELECT 'exact_reference_matches', count(*) FILTER (tier IN ('A', 'B')) FROM mt UNION ALL SELECT 'connectivity_only_matches', count(*) FILTER (tier = 'D') FROM mt
 UNION ALL SELECT 'input_records', count(*) FROM {PILOT} UNION ALL SELECT 'suspicious_names', count(*) FROM {PILOT} WHERE {_like_any("coalesce(name, '') || ' ' || coalesce(record_title, '')", [rules.SUSPICIOUS_NAMES])}
 UNION ALL SELECT 'several_connectivities', count(*) FROM (SELECT s FROM pk GROUP BY 1 HAVING count(DISTINCT conn) > 1)""")
def identity_summary(spark, sf_dir):
    """What the matching of structures came to, long form."""
    items, pilot = _identified(spark, sf_dir), table(spark, sf_dir, PILOT)
    found = matching.tiered_match(items, table(spark, sf_dir, "massspecgym_raw"), "structure_record_id", "raw_id", _reference_tiers()).select("structure_record_id", "tier")
    rows = items.select("structure_record_id", F.size("conn_keys").alias("n")).join(found, "structure_record_id", "left")
    c = F.col
    names = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("record_title", F.lit("")))
    totals = curation.totals_of(rows, unique_structures=F.count(F.lit(1)), matched_structures=F.count("tier"), unmatched_structures=F.count_if(c("tier").isNull()), exact_reference_matches=F.count_if(c("tier").isin("A", "B")),
                                connectivity_only_matches=F.count_if(c("tier") == "D"), several_connectivities=F.count_if(c("n") > 1))
    records = curation.totals_of(pilot, input_records=F.count(F.lit(1)), suspicious_names=F.count_if(names.rlike(f"(?i){rules.SUSPICIOUS_NAMES}")))
    tiers = found.groupBy(F.concat(F.lit("tier:"), c("tier")).alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    return tiers.unionByName(totals).unionByName(records)


@query(f"""WITH {_SPECTRA}, {_GROUPS}
SELECT unnest(['records', 'records_after_dedup', 'duplicates_removed', 'strict_named_class', 'unresolved', 'unique_structures', 'unique_connectivities', 'unknown_adducts', 'missing_energies', 'without_source']) AS metric,
 unnest([count(*), count(DISTINCT record_hash), count(*) - count(DISTINCT record_hash), count(*) FILTER (lipid_class <> '{rules.UNRESOLVED}'), count(*) FILTER (lipid_class = '{rules.UNRESOLVED}'), count(DISTINCT structure_id), count(DISTINCT connectivity_id), count(*) FILTER (adduct = 'unknown'), count(*) FILTER (e_status = 'missing'), count(*) FILTER (source IS NULL OR source = '')]) AS value FROM s4
 UNION ALL SELECT 'class:' || lipid_class, count(*) FROM s4 GROUP BY 1 UNION ALL SELECT 'source:' || coalesce(nullif(source, ''), 'unknown'), count(*) FROM s4 GROUP BY 1 UNION ALL SELECT 'adduct:' || adduct, count(*) FROM s4 GROUP BY 1
 UNION ALL SELECT 'polarity:' || coalesce(polarity, 'unknown'), count(*) FROM s4 GROUP BY 1 UNION ALL SELECT 'energy_status:' || e_status, count(*) FROM s4 GROUP BY 1
 UNION ALL SELECT 'relation:' || relation, CAST(sum(size) AS BIGINT) FROM r GROUP BY 1 UNION ALL SELECT 'duplicate_groups', count(*) FROM r WHERE size > 1""")
def collector_summary(spark, sf_dir):
    """The collector's summary, long form: totals, and counts by class, source, adduct, polarity, energy status and duplicate relation."""
    rows, c = _spectra(spark, sf_dir), F.col
    totals = curation.totals_of(
        rows, records=F.count(F.lit(1)), records_after_dedup=F.count_distinct("acquisition_record_hash"), duplicates_removed=F.count(F.lit(1)) - F.count_distinct("acquisition_record_hash"),
        strict_named_class=F.count_if(c("lipid_class") != rules.UNRESOLVED), unresolved=F.count_if(c("lipid_class") == rules.UNRESOLVED), unique_structures=F.count_distinct("structure_id"),
        unique_connectivities=F.count_distinct("connectivity_id"), unknown_adducts=F.count_if(c("adduct") == "unknown"), missing_energies=F.count_if(c("energy.status") == "missing"), without_source=F.count_if(truthy(c("source")).isNull()),
    )
    shown = {"class": c("lipid_class"), "source": F.coalesce(truthy(c("source")), F.lit("unknown")), "adduct": c("adduct"), "polarity": F.coalesce("polarity", F.lit("unknown")), "energy_status": c("energy.status")}
    each = F.explode(F.array(*[F.concat(F.lit(f"{k}:"), v) for k, v in shown.items()]))
    counts = rows.select(each.alias("metric")).groupBy("metric").agg(F.count(F.lit(1)).alias("value"))
    groups = duplicates.duplicate_groups(rows, example_ids=0)
    relations = groups.groupBy(F.concat(F.lit("relation:"), c("duplicate_relation")).alias("metric")).agg(F.sum("duplicate_group_size").cast("bigint").alias("value"))
    return totals.unionByName(counts).unionByName(relations).unionByName(curation.totals_of(groups, duplicate_groups=F.count_if(c("duplicate_group_size") > 1)))


@query("""WITH o AS (SELECT row_id, lipid_class FROM experimental_ms2_pilot), w AS (SELECT row_id, coalesce(gold_lipid_class, '?') AS lipid_class FROM (SELECT row_id, min(gold_lipid_class) AS gold_lipid_class FROM gold_spectra WHERE row_id IS NOT NULL GROUP BY 1))
SELECT CASE WHEN o.row_id IS NULL THEN 'added' WHEN w.row_id IS NULL THEN 'removed' WHEN o.lipid_class IS NOT DISTINCT FROM w.lipid_class THEN 'unchanged' ELSE 'changed' END AS change, count(*) AS n FROM o FULL JOIN w ON o.row_id = w.row_id GROUP BY 1""")
def version_comparison(spark, sf_dir):
    """The pilot's classes against the curated ones, as two versions of one table."""
    new = table(spark, sf_dir, "gold_spectra").where("row_id is not null").groupBy("row_id").agg(F.coalesce(F.min("gold_lipid_class"), F.lit("?")).alias("lipid_class"))
    return checks.compare_versions(table(spark, sf_dir, PILOT, "row_id", "lipid_class"), new, "row_id", "lipid_class")


@query(f"""WITH x AS (SELECT 0 AS rk, row_id AS id, inchikey, precursor_mz FROM {PILOT} UNION ALL SELECT 1, raw_id, inchikey, precursor_mz FROM massspecgym_raw)
SELECT inchikey, count(*) AS n_rows, CASE WHEN min(rk) = 0 THEN 'pilot' ELSE 'massspecgym' END AS first_source, arg_min(id, row(rk, id)) AS first_id FROM x WHERE inchikey IS NOT NULL GROUP BY 1""")
def union_in_order(spark, sf_dir):
    """Both sources one under the other in source order, and which row of each key comes first."""
    pilot = table(spark, sf_dir, PILOT).select(F.col("row_id").alias("id"), "inchikey", "precursor_mz", F.col("row_id").alias("_ord"))
    raw = table(spark, sf_dir, "massspecgym_raw").select(F.col("raw_id").alias("id"), "inchikey", "precursor_mz", F.col("raw_id").alias("_ord"))
    rows = checks.ordered_union([("pilot", pilot), ("massspecgym", raw)]).where("inchikey is not null")
    first = F.min_by(F.struct("_source", "id"), "_ord")
    return rows.groupBy("inchikey").agg(F.count(F.lit(1)).alias("n_rows"), first.alias("f")).select("inchikey", "n_rows", F.col("f._source").alias("first_source"), F.col("f.id").alias("first_id"))
