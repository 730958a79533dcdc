"""Queries of the structure parser and its evaluation, and of reading the MassSpecGym table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.functions.peaks import display_name, sorted_chains
from spectraloom.operators import evaluation as ev
from spectraloom.operators import matching
from spectraloom.operators.molecule import parse_structures
from spectraloom.operators.packed import parsed_lists
from spectraloom.sources.files import massspecgym_records
from spectraloom.session import table


def _chains_text():
    plain = F.transform("chains", lambda c: F.struct(c["carbon"].alias("carbon"), c["double_bonds"].alias("double_bonds"), F.lit(None).cast("string").alias("linkage")))
    return display_name(F.col("lipid_class"), sorted_chains(plain, F.lit(None).cast("string")))


def catalogue_anatomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and chains of every catalogue entry from its structure text alone."""
    refs = table(spark, sf_dir, "compound_reference", "ref_id", "smiles")
    parsed = parse_structures(refs)
    j = refs.join(parsed, refs["smiles"].eqNullSafe(parsed["smiles"]))
    return j.select("ref_id", "parse_status", "lipid_class", "chain_count", F.regexp_replace(_chains_text(), "_", "/").alias("shown"), F.array_join("linkages", "|").alias("linkages"))


def pilot_anatomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anatomy of every distinct structure text of the pilot."""
    parsed = parse_structures(table(spark, sf_dir, "experimental_ms2_pilot", "smiles"))
    return parsed.select("smiles", "parse_status", F.array_join("reasons", "|").alias("reasons"), "headgroup", "head_tier", "backbone_family", "chain_count", F.array_join("linkages", "|").alias("linkages"), "lipid_class", "free_hydroxyls", F.round("coverage", 6).alias("coverage"), "reconstruction_exact")


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    pilot = table(spark, sf_dir, "experimental_ms2_pilot", "row_id", "structure_record_id", "lipid_class", "name", "smiles").where("structure_record_id is not null")
    return ev.evaluate(ev.unique_structures(pilot, "structure_record_id", order="row_id"))


def evaluation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).select("structure_record_id", "expected_class", "lipid_class", "parse_status", "eligible", "headgroup_correct", "backbone_correct", "chain_count_correct", "linkage_correct", "exact", "success")


def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.class_metrics(_evaluated(spark, sf_dir))


def negative_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.negative_controls(_evaluated(spark, sf_dir), "structure_record_id")


def linkage_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.linkage_errors(ev.linkage_validation(_evaluated(spark, sf_dir)))


def relabel_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.relabels(_evaluated(spark, sf_dir), "structure_record_id")


def parse_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures by what became of them: an ordered list of rules over the evaluation."""
    c = F.col
    outcome = matching.decision_list(
        [
            (c("success"), ("read_as_expected", "class, headgroup, backbone and chains agree")),
            (c("eligible") & (c("parse_status") == "success") & (c("lipid_class") != c("expected_class")), ("other_class", "read without fault as another class")),
            (c("smiles").isNull() | (c("parse_status") == "invalid_input"), ("no_structure", "no readable structure text")),
            (c("parse_status").startswith("unsupported") | (c("parse_status") == "ambiguous_backbone"), ("out_of_scope", "a structure that the parser doesn't cover")),
        ],
        ("outcome", "reason"), ("unclear", "none of the rules"),
    )
    return _evaluated(spark, sf_dir).select(outcome.alias("o"), "n_spectra").groupBy("o.outcome", "o.reason").agg(F.count(F.lit(1)).alias("n_structures"), F.sum("n_spectra").alias("n_spectra"))


def massspecgym_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows as spectra, their lists parsed in all of p4's notations and paired by position."""
    raw = table(spark, sf_dir, "massspecgym_raw").withColumn("parent_mass", F.col("parent_mass").cast("string"))
    lists = parsed_lists(raw, "raw_id", "mzs", "intensities")
    rows = massspecgym_records(raw.drop("mzs", "intensities").join(lists, "raw_id"))
    return rows.select("spectrum_id", "polarity", "adduct", "num_peaks", F.round("precursor_mz", 6).alias("precursor_mz"), "upstream_fold")


QUERIES = {f.__name__: f for f in (catalogue_anatomy, pilot_anatomy, evaluation_flags, class_metrics, negative_controls, linkage_errors, relabel_candidates, parse_outcomes, massspecgym_spectra)}
SQL = {
    # the catalogue states what the parser has to find: class, chains, esters throughout
    "catalogue_anatomy": """SELECT ref_id, 'success' AS parse_status, main_class AS lipid_class, CAST(len(regexp_extract_all(abbreviation, '[0-9]+:[0-9]+')) AS INTEGER) AS chain_count, abbreviation AS shown,
 array_to_string(list_transform(regexp_extract_all(abbreviation, '[0-9]+:[0-9]+'), lambda x: 'ester'), '|') AS linkages FROM compound_reference""",
}
