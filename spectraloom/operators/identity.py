"""Spectrum records and their identities: structure ids and three nested hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions import normalize as n
from spectraloom.functions import peaks as p
from spectraloom.functions import rules
from spectraloom.functions.text import filled, fixed, shown, stable_hash, truthy


def spectra(df: DataFrame, *, order: str = "row_id", least_peaks: int = 3, energy: str = "collision_energy_qc_only", adduct: str = "adduct_qc_only", instrument_type: str = "instrument_type_qc_only") -> DataFrame:
    """Normalised spectrum records of a delivered table, with ``_ord`` for its order of arrival.

    Rows without a finite precursor or with fewer than ``least_peaks`` usable peaks are dropped.
    """
    name = F.coalesce(F.col("name"), F.lit(""))
    title = F.coalesce(F.col("record_title"), F.lit(""))
    cls = n.class_of_name(F.concat_ws(" ; ", name, title))
    rows = df.select(
        F.col(order).alias("_ord"), "spectrum_id", "source", "source_file", "license", "name", "record_title", "smiles", "inchikey", "formula", "structure_record_id",
        F.col("precursor_mz").cast("double").alias("precursor_mz"), n.adduct_fields(F.col(adduct)).alias("adduct_info"), F.col("polarity").alias("polarity_raw"),
        n.energy_fields(F.col(energy)).alias("energy"), n.one_line(F.col("instrument")).alias("instrument"), n.one_line(F.col(instrument_type)).alias("instrument_type"),
        p.clean_peaks(F.col("peaks_raw"), least_peaks).alias("peaks"), cls.alias("cls"), n.modifications_of_name(F.concat_ws(" ; ", name, title)).alias("modifications"),
        n.identifier_fields(F.col("inchikey")).alias("identifier"),
    )
    kept = rows.where((F.size("peaks") > 0) & F.col("precursor_mz").isNotNull() & ~F.isnan("precursor_mz"))
    known = F.when(F.col("adduct_info.adduct") != "unknown", F.col("adduct_info.adduct"))
    return kept.select(
        "*", F.col("adduct_info.adduct").alias("adduct"), n.polarity(F.col("polarity_raw"), known).alias("polarity"),
        F.coalesce(F.col("cls.lipid_class"), F.lit(rules.UNRESOLVED)).alias("lipid_class"), F.coalesce(F.col("cls.family"), F.lit(rules.CANDIDATE_FAMILY)).alias("lipid_family"),
        F.coalesce(truthy(F.col("spectrum_id")), truthy(F.col("record_title")), truthy(F.col("source_file"))).alias("source_record_id"),
    ).drop("polarity_raw", "adduct_info", "cls")


def structure_ids(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """``df`` with structure ids that need no chemistry toolkit: hashes of the structure text as given.

    ``identity_fallback`` is true throughout; a blank structure is one structure "missing".
    """
    text = F.coalesce(filled(F.col(smiles)), F.lit(""))
    return df.withColumn("structure_id", stable_hash("str", F.lit(rules.STANDARDIZATION_VERSION), text)).withColumn("connectivity_id", stable_hash("conn", F.lit(rules.STANDARDIZATION_VERSION), text)).withColumn("identity_fallback", F.lit(True))


def first_version_hash(spectra_df: DataFrame) -> DataFrame:
    """``spectrum_hash`` over identifier, structure, precursor, adduct, polarity and sorted peaks."""
    return spectra_df.withColumn("spectrum_hash", F.sha2(F.concat_ws("|", shown(F.col("inchikey")), shown(F.col("smiles")), fixed(F.col("precursor_mz"), 4), shown(F.col("adduct")), shown(F.col("polarity")), p.peak_text(F.col("peaks"))), 256))


def identity_hashes(spectra_df: DataFrame, identity: str = "connectivity_id") -> DataFrame:
    """Three hashes, each over the one before and more fields.

    ``peak_identity_hash``: molecule, precursor, adduct, polarity and peaks in any order, whatever the source.
    ``acquisition_metadata_hash``: with energy, instrument and source. ``acquisition_record_hash``: with the source's record id.
    """
    c = F.col
    peak = stable_hash("peak", F.lit(rules.HASH_VERSION), c(identity), fixed(c("precursor_mz"), 4), F.coalesce(truthy(c("adduct")), F.lit("unknown")), F.coalesce(truthy(c("polarity")), F.lit("unknown")), p.peak_text(c("peaks")))
    df = spectra_df.withColumn("peak_identity_hash", peak)
    meta = [F.lit(rules.HASH_VERSION), c("peak_identity_hash"), c("energy.raw"), fixed(c("energy.value"), 6), c("energy.unit"), c("energy.status"), c("instrument"), c("instrument_type"), c("source")]
    return df.withColumn("acquisition_metadata_hash", stable_hash("acqmeta", *meta)).withColumn("acquisition_record_hash", stable_hash("acqrec", *meta, c("source_record_id")))
