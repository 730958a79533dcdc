"""Curation of evaluated structures: layers by an ordered rule list, conflicts, relabel review, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions import rules
from spectraloom.functions.text import truthy
from spectraloom.operators.matching import conflicts, decision_list

# The layers.
GOLD, RELABEL, INVALID = "gold_v0_1", "relabel_review", "invalid_or_incomplete_structure"
OUT_OF_SCOPE, PARSER_SCOPE, MANUAL, CONFLICT = "class_out_of_scope", "parser_scope_exclusion", "needs_manual_review", "conflict"


def curation_layer() -> Column:
    """Struct (layer, reason, needs_review) of an evaluated structure: the first of fourteen outcomes that holds.

    Columns as ``evaluation.evaluate`` gives them; a condition on a null doesn't hold, so a structure of
    which nothing is known goes to manual review or, without a class, out of scope.
    """
    c = F.col
    supported = F.coalesce(c("expected_class").isin(rules.SUPPORTED_CLASSES), F.lit(False))
    two_chained = [cls for (_, n), cls in rules.CLASS_OF.items() if n == 2]
    status = lambda *names: c("parse_status").isin(*names)
    other_class = c("eligible") & status("success") & c("exact") & ~c("lipid_class").eqNullSafe(c("expected_class"))
    no_text, no_chain = truthy(c("smiles")).isNull(), status("unsupported_backbone")
    sphingoid = F.lower(F.array_join("names", " | ")).contains("sphingosyl") | (c("backbone_family") == "sphingoid_or_unsupported")
    table = [
        (c("success"), GOLD, "parser_success_label_agree", False),
        (~supported, OUT_OF_SCOPE, "strict_class_outside_glycerophospholipid_v0_1_scope", False),
        (other_class & (c("chain_count") == 1) & c("expected_class").isin(two_chained), RELABEL, "single_chain_graph_with_free_glycerol_hydroxyl", True),
        (other_class, RELABEL, "parser_derived_class_disagrees_with_source_strict_label", True),
        (no_text, INVALID, "canonical_structure_missing", True),
        (c("exclusion").isNotNull() | status("invalid_input"), INVALID, "source_label_structure_conflict", True),
        (no_chain & (c("expected_class") == "PA"), INVALID, "zero_chain_glycerophosphate_labelled_as_PA", True),
        (no_chain & (c("expected_class") == "PC"), INVALID, "headgroup_or_glycerophosphocholine_record_lacks_hydrophobic_chain", True),
        (status("unsupported_extra_substitution"), PARSER_SCOPE, "extra_backbone_substitution_outside_v0_1", True),
        (status("unsupported_topology") & F.array_contains("reasons", "multiple_phosphorus_atoms"), PARSER_SCOPE, "multi_phosphorus_topology_outside_v0_1", True),
        (status("unsupported_topology"), PARSER_SCOPE, "unsupported_topology_outside_v0_1", True),
        (no_chain & sphingoid, PARSER_SCOPE, "sphingoid_backbone_outside_v0_1", True),
        (no_chain, PARSER_SCOPE, "unsupported_backbone_outside_v0_1", True),
    ]
    return decision_list([(when, values) for when, *values in table], ("layer", "reason", "needs_review"), (MANUAL, "unclassified_non_gold_case", True))


def curated(evaluated: DataFrame, connectivity: str = "connectivity_id") -> DataFrame:
    """``evaluated`` with layer, reason, needs_review, and ``final_layer``: structures of one connectivity in several layers are in conflict.

    A null connectivity is in conflict with nothing. The conflicting connectivities are aggregated first;
    they are few, and adaptive execution broadcasts them when they are.
    """
    rows = evaluated.withColumn("__o", curation_layer()).select("*", "__o.*").drop("__o")
    bad = conflicts(rows.where(F.col(connectivity).isNotNull()), connectivity, "layer").select(connectivity, F.lit(True).alias("__bad"))
    joined = rows.join(bad, connectivity, "left")
    return joined.withColumn("final_layer", F.when(F.col("__bad"), CONFLICT).otherwise(F.col("layer"))).drop("__bad")


def connectivity_conflicts(curated_rows: DataFrame, connectivity: str = "connectivity_id") -> DataFrame:
    """(connectivity, values, n_rows): the layers of each connectivity that has several, as they were before the override."""
    return conflicts(curated_rows.where(F.col(connectivity).isNotNull()), connectivity, "layer")


def curation_summary(curated_rows: DataFrame, gold_spectra: DataFrame, key: str, connectivity: str = "connectivity_id") -> DataFrame:
    """(metric, value): layer counts and what must add up with them, long form; ``layer_count_sum`` must equal ``strict_structures``."""
    c = F.col
    layers = curated_rows.groupBy(F.concat(F.lit("layer:"), c("layer")).alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    relabel = curated_rows.where(c("layer") == RELABEL)
    pair = F.concat(F.lit("relabel:"), c("expected_class"), F.lit("->"), F.coalesce("lipid_class", F.lit("None")))
    corrections = relabel.groupBy(pair.alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    gold = c("layer") == GOLD
    totals = totals_of(
        curated_rows,
        strict_structures=F.count(F.lit(1)), distinct_structures=F.count_distinct(key), graph_parse_success_exact=F.count_if((c("parse_status") == "success") & c("exact")),
        gold_connectivities=F.count_distinct(F.when(gold, c(connectivity))), gold_spectra_expected=F.coalesce(F.sum(F.when(gold, c("n_spectra"))), F.lit(0)),
        needs_review=F.count_if("needs_review"),
    )
    spectra = totals_of(gold_spectra, gold_spectra=F.count(F.lit(1)))
    conflict = totals_of(connectivity_conflicts(curated_rows, connectivity), connectivity_conflicts=F.count(F.lit(1)))
    whole = totals_of(layers, layer_count_sum=F.coalesce(F.sum("value"), F.lit(0)))
    out = layers
    for part in (corrections, totals, spectra, conflict, whole):
        out = out.unionByName(part)
    return out


def totals_of(df: DataFrame, **metrics: Column) -> DataFrame:
    """(metric, value): named aggregates of one pass as rows, also over an empty table."""
    one = df.agg(*[m.cast("bigint").alias(name) for name, m in metrics.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics])).alias("m")).select("m.*")


def names_support(name: Column, label: Column) -> Column:
    """Whether a provided name speaks for a class label: its full word, or the code after a blank; other labels anywhere."""
    text, low = F.lower(F.coalesce(name, F.lit(""))), F.lower(label)
    # Words of classes
    words = {"pc": "phosphatidylcholine", "pe": "phosphatidylethanolamine", "pi": "phosphatidylinositol"}
    out = None
    for code, word in words.items():
        says = text.contains(word) | F.concat(F.lit(" "), text).contains(f" {code}")
        out = F.when(low == code, says) if out is None else out.when(low == code, says)
    return out.otherwise(text.contains(low))


def review_package(curated_rows: DataFrame, key: str, *, name: str = "name", pairs: Sequence[str] = ("PC->LPC", "PE->LPE", "PI->LPI")) -> DataFrame:
    """The relabel candidates in review order with their batch and suggestion, and fields for the reviewer.

    Batch A: a whole single-chain graph whose name speaks for the proposed label; B: such a graph whose
    name speaks for neither; C: the rest. Order: known pairs as listed, then support (proposed, neither,
    current), then key. The order is set by a ranged sort and running counts of its partitions, not in one task.
    """
    c = F.col
    rows = curated_rows.where(c("layer") == RELABEL).withColumn("pair", F.concat_ws("->", "expected_class", F.coalesce("lipid_class", F.lit("None"))))
    proposed = F.lower(F.coalesce(c(name), F.lit(""))).contains("lyso") | names_support(c(name), c("lipid_class"))
    rows = rows.withColumn("supports_proposed", F.coalesce(proposed, F.lit(False))).withColumn("supports_current", F.coalesce(names_support(c(name), c("expected_class")), F.lit(False)))
    whole = (c("chain_count") == 1) & (c("free_hydroxyls") == 1) & c("exact") & (c("coverage") == 1.0) & (c("unassigned") == 0) & (c("overlapping") == 0)
    whole = F.coalesce(whole, F.lit(False))
    batch = F.when(whole & c("supports_proposed"), "A").when(whole & ~c("supports_current"), "B").otherwise("C")
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in pairs]), c("pair")), F.lit(0)), F.lit(len(pairs) + 1)).cast("int")
    within = F.when(c("supports_proposed"), 0).when(c("supports_current"), 2).otherwise(1)
    rows = rows.select(
        F.struct(place.alias("pair"), within.alias("within"), c(key).alias("key")).alias("__at"), batch.alias("review_batch"), key, c("expected_class").alias("current_label"), c("lipid_class").alias("proposed_label"),
        c(name).alias("provided_name"), c("n_spectra"), c("chain_count"), "supports_current", "supports_proposed", F.when(batch == "A", "approve_candidate").otherwise("inspect").alias("suggested_decision"),
        F.lit("pending_user_review").alias("decision"), F.lit(False).alias("writeback_allowed"),
    )
    return numbered(rows, "__at", "review_order").drop("__at")


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` with its 1-based place in the order of ``by`` (without ties): ranks inside the sorted partitions plus the rows before them.

    The window is partitioned by sorted partition, and only the partitions' sizes are summed up in one place.
    """
    from pyspark.sql import Window

    sorted_rows = df.repartitionByRange(F.col(by)).withColumn("__part", F.spark_partition_id())
    local = sorted_rows.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(by)))
    sizes = local.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min(by).alias("least"))
    # one row for each partition of the sort
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(before.select("__part", "before"), "__part").withColumn(name, F.col("__n") + F.col("before")).drop("__part", "__n", "before")
