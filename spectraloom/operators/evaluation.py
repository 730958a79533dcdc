"""Evaluation of derived structures against expected classes: flags, metrics, controls and linkage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions import rules
from spectraloom.functions.normalize import expected_linkages
from spectraloom.functions.text import sorted_distinct, truthy
from spectraloom.operators.molecule import parse_structures
from spectraloom.operators.rollup import modal_value


def unique_structures(spectra_df: DataFrame, key: str, *, lipid_class: str = "lipid_class", order: str = "_ord", most_names: int = 20) -> DataFrame:
    """One row per structure: modal class (ties: the first to appear), classes, names and the first row's structure text."""
    modal = modal_value(spectra_df, key, lipid_class, order).select(key, F.col(lipid_class).alias("expected_class"))
    rows = spectra_df.groupBy(key).agg(
        sorted_distinct(truthy(F.col(lipid_class))).alias("lipid_classes"), F.count(F.lit(1)).alias("n_spectra"), F.min_by("smiles", order).alias("smiles"),
        F.slice(sorted_distinct(truthy(F.col("name"))), 1, most_names).alias("names"),
    )
    return rows.join(modal, key)


def evaluate(structures: DataFrame) -> DataFrame:
    """Structures with the anatomy of their structure text and flags; flags are null where a structure isn't eligible.

    Eligible is a supported class with a structure text (for PS with the serine head, or none at all).
    """
    heads = F.create_map(*[x for (head, _), cls in rules.CLASS_OF.items() for x in (F.lit(cls), F.lit(head))])
    counts = F.create_map(*[x for (_, n), cls in rules.CLASS_OF.items() for x in (F.lit(cls), F.lit(n))])
    parsed = parse_structures(structures)
    j = structures.alias("s").join(parsed.alias("p"), F.col("s.smiles").eqNullSafe(F.col("p.smiles"))).drop(F.col("p.smiles"))
    expected = F.col("expected_class")
    head, chains = F.try_element_at(heads, F.coalesce(expected, F.lit(""))), F.try_element_at(counts, F.coalesce(expected, F.lit("")))
    excluded = F.when(truthy(F.col("smiles")).isNull(), "structure_missing").when((expected == "PS") & F.coalesce(F.col("headgroup") != "phosphoserine", F.lit(False)), "headgroup_not_serine")
    eligible = F.coalesce(expected.isin(rules.SUPPORTED_CLASSES), F.lit(False)) & excluded.isNull()
    text = F.concat_ws(" ", expected, F.array_join("names", " "))
    wanted = expected_linkages(text, chains)
    flag = lambda c: F.when(F.col("eligible"), F.coalesce(c, F.lit(False)))
    out = j.select("*", excluded.alias("exclusion"), eligible.alias("eligible"), wanted.alias("expected_linkages"), wanted.isNotNull().alias("linkage_evaluable"))
    out = out.select(
        "*", flag(F.col("headgroup") == head).alias("headgroup_correct"), flag(F.col("backbone_family") == "glycerol").alias("backbone_correct"), flag(F.col("chain_count") == chains).alias("chain_count_correct"),
        F.when(F.col("linkage_evaluable"), flag(F.col("linkages") == F.col("expected_linkages"))).alias("linkage_correct"), flag(F.col("reconstruction_exact")).alias("exact"),
    )
    success = F.col("eligible") & (F.col("parse_status") == "success") & (F.col("lipid_class") == expected) & F.col("headgroup_correct") & F.col("backbone_correct") & F.col("chain_count_correct") & F.col("exact")
    return out.withColumn("success", F.coalesce(success, F.lit(False)))


def class_metrics(evaluated: DataFrame) -> DataFrame:
    """Counts by expected class with the success rate among the eligible (null where none is); ``position`` has supported classes first."""
    c = F.col
    count = lambda x: F.count_if(c("eligible") & F.coalesce(x, F.lit(False)))
    out = evaluated.groupBy(F.coalesce("expected_class", F.lit("None")).alias("class")).agg(
        F.count(F.lit(1)).alias("total"), F.sum("n_spectra").alias("n_spectra"), F.count_if("eligible").alias("n_eligible"), count(c("success")).alias("n_success"),
        F.count_if(c("parse_status").startswith("unsupported")).alias("n_unsupported"), F.count_if(c("parse_status").startswith("ambiguous")).alias("n_ambiguous"), F.count_if(c("parse_status") == "failed").alias("n_failed"),
        *[count(c(f)).alias(f"n_{f}") for f in ("headgroup_correct", "backbone_correct", "chain_count_correct", "linkage_evaluable", "linkage_correct", "exact")],
    )
    known = F.array_position(F.array(*[F.lit(x) for x in sorted(rules.SUPPORTED_CLASSES)]), c("class"))
    return out.withColumn("success_rate", F.round(F.try_divide(c("n_success"), c("n_eligible")), 6)).withColumn("position", F.when(known > 0, known).otherwise(1000).cast("int"))


def negative_controls(evaluated: DataFrame, key: str) -> DataFrame:
    """Every structure of a control class, and whether it was given a class it must not have; a class without structures has one row of its own."""
    spark = evaluated.sparkSession
    controls = spark.createDataFrame(list(rules.CONTROL_CLASSES.items()), "control_class string, forbidden array<string>")
    rows = evaluated.select(F.col(key).alias("k"), "expected_class", "parse_status", "lipid_class")
    tested = rows.join(F.broadcast(controls), F.col("control_class") == F.col("expected_class"))  # a fixed list of five
    # classes without a structure are found from the few distinct classes, so the structures aren't shuffled for them
    none = controls.join(rows.select("expected_class").distinct(), F.col("control_class") == F.col("expected_class"), "left_anti")
    j = tested.unionByName(none, allowMissingColumns=True)
    violation = F.coalesce(F.array_contains("forbidden", F.col("lipid_class")), F.lit(False))
    return j.select("control_class", F.col("k").alias(key), F.when(F.col("k").isNull(), "no_sample").otherwise("tested").alias("sample_status"), "parse_status", F.col("lipid_class").alias("derived_class"), violation.alias("violation"))


def control_summary(controls: DataFrame) -> DataFrame:
    """(control_class, sample_status, n_tested, n_violations) of the rows of ``negative_controls``."""
    return controls.groupBy("control_class").agg(F.max("sample_status").alias("sample_status"), F.count_if(F.col("sample_status") == "tested").alias("n_tested"), F.count_if("violation").alias("n_violations"))


def linkage_validation(evaluated: DataFrame) -> DataFrame:
    """Numbers of ether linkages expected and found, for structures where a name says something or an ether is involved."""
    n = lambda a, kind: F.size(F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: x == kind))
    columns = [n(F.col(a), k).alias(f"{label}_{k}") for label, a in (("expected", "expected_linkages"), ("found", "linkages")) for k in ("alkyl_ether", "vinyl_ether")]
    rows = evaluated.select("*", *columns)
    some = F.lit(False)
    for label in ("expected", "found"):
        for k in ("alkyl_ether", "vinyl_ether"):
            some = some | (F.col(f"{label}_{k}") > 0)
    return rows.where(some | F.col("linkage_evaluable"))


def linkage_errors(validated: DataFrame) -> DataFrame:
    """False positives and negatives of each ether linkage over the evaluable structures: one row."""
    c = F.col
    out = []
    for k in ("alkyl_ether", "vinyl_ether"):
        out += [F.count_if(c("linkage_evaluable") & (c(f"found_{k}") > c(f"expected_{k}"))).alias(f"{k}_false_positive"), F.count_if(c("linkage_evaluable") & (c(f"found_{k}") < c(f"expected_{k}"))).alias(f"{k}_false_negative")]
    return validated.agg(*out)


def relabels(evaluated: DataFrame, key: str) -> DataFrame:
    """Structures read without fault whose derived class differs from the expected one, numbered for review.

    ``support``: A where the names agree with the derived class, B where they agree with neither, C where with the expected one.
    """
    c = F.col
    wrong = evaluated.where(c("eligible") & (c("parse_status") == "success") & c("exact") & (c("lipid_class") != c("expected_class")))
    names = F.upper(F.array_join("names", " "))
    says = lambda cls: names.rlike(r"(^|[^A-Z])") & F.regexp_like(names, F.concat(F.lit("(^|[^A-Z])"), cls, F.lit("[^A-Z]")))
    support: Column = F.when(says(c("lipid_class")), "A").when(says(c("expected_class")), "C").otherwise("B")
    return wrong.select(key, c("expected_class").alias("current_class"), c("lipid_class").alias("proposed_class"), "chain_count", "free_hydroxyls", "formal_charge", "n_spectra", support.alias("support"))


def to_training_chains(chains: Column) -> Column:
    """Parsed chains in the words of the label encoder: alkyl ethers are "ether"."""
    return F.transform(chains, lambda x: F.struct(x["carbon"].alias("carbon"), x["double_bonds"].alias("double_bonds"), F.when(x["linkage"] == "alkyl_ether", "ether").otherwise(x["linkage"]).alias("linkage")))


def to_training_headgroup(lipid_class: Column) -> Column:
    """The headgroup label of a class: lyso classes share that of the class with two chains."""
    return F.regexp_replace(lipid_class, "^L(?=P)", "")
