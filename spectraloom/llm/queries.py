"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm.bpe import encode_texts
from spectraloom.llm.canonical import ClassMatcher, InstrumentMatcher, NameMatcher, distinct_values, match_candidates, match_distinct, match_values, reference_rows
from spectraloom.llm.mixing import mix, planned, shares
from spectraloom.llm.splits import assign_splits, related_groups
from spectraloom.llm.subjects import score_blocks, train, written_blocks
from spectraloom.llm.survivors import measurement_groups, survivors
from spectraloom.session import cut, table

IDS = ["connectivity_id", "split_group_id"]
#: Domains of the tables' sources; a source without one is a domain of its own.
DOMAINS = {
    "lab_notebook": "laboratory", "protocol_wiki": "laboratory", "manual": "laboratory", "safety_sheet": "laboratory",
    "forum": "exchange", "issue_tracker": "exchange", "helpdesk": "exchange", "interview": "exchange", "newsletter": "exchange",
    "preprint": "print", "review_letter": "print", "textbook": "print", "licence_note": "print",
}


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related_groups(table(spark, sf_dir, "gold_spectra"), "gold_id", IDS)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in a set of related rows that holds at least two different ids."""
    return _related(spark, sf_dir).where("n_ids >= 2").select("gold_id", "group_id")


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gold spectrum with its split and stratum: the pilot's lipid class (canonical) and polarity."""
    groups = _related(spark, sf_dir)
    pilot = table(spark, sf_dir, "experimental_ms2_pilot", "row_id", "lipid_class", "polarity")
    classes = _matched(spark, sf_dir, ["lipid_class"]).select("row_id", F.col("ref_id").alias("class_id"))
    sign = F.lower(F.trim("polarity"))
    polarity = F.when(sign.rlike(r"^(p|\+|1)"), "positive").when(sign.rlike(r"^(n|-|−)"), "negative").otherwise("unknown")
    strata = pilot.select("row_id", polarity.alias("stratum_polarity")).join(classes, "row_id", "left")
    rows = table(spark, sf_dir, "gold_spectra", "gold_id", "row_id").join(groups, "gold_id").join(strata, "row_id", "left")
    rows = cut(rows.select("gold_id", "group_id", F.coalesce("class_id", F.lit(0)).alias("class_id"), F.coalesce("stratum_polarity", F.lit("unknown")).alias("stratum_polarity")))
    assigned = assign_splits(rows, "gold_id", "group_id", ["class_id", "stratum_polarity"])
    return rows.join(assigned.select("gold_id", "split"), "gold_id")


def p2_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each split by class and polarity."""
    return p2_splits(spark, sf_dir).groupBy("class_id", "stratum_polarity", "split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("group_id").alias("n_groups"))


def _measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurement_groups(table(spark, sf_dir, "experimental_ms2_pilot"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of rows that hold one measurement: the form that this query is defined to have."""
    groups = _measurements(spark, sf_dir)
    a, b = groups.withColumnRenamed("row_id", "row_id_a"), groups.withColumnRenamed("row_id", "row_id_b")
    return a.join(b, "group").where("row_id_a < row_id_b").select("row_id_a", "row_id_b")


def p3_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per measurement, with every column of the table but its key."""
    pilot = table(spark, sf_dir, "experimental_ms2_pilot")
    fields = [c for c in pilot.columns if c != "row_id"]
    return survivors(pilot, cut(_measurements(spark, sf_dir)), fields).withColumnRenamed("group", "measurement_id")


def _lists(spark: SparkSession, sf_dir: str, fields: list[str]) -> dict[str, tuple]:
    lists = {
        "name": (NameMatcher, reference_rows(table(spark, sf_dir, "compound_reference"), "ref_id", "name", "abbreviation", "synonyms")),
        "lipid_class": (ClassMatcher, reference_rows(table(spark, sf_dir, "lipid_classes"), "class_id", "lipid_class", "class_name", "synonyms")),
        "instrument": (InstrumentMatcher, reference_rows(table(spark, sf_dir, "instruments"), "instrument_id", "instrument", "maker")),
    }
    return {f: lists[f] for f in fields}


def _matched(spark: SparkSession, sf_dir: str, fields: list[str]) -> DataFrame:
    return match_values(table(spark, sf_dir, "experimental_ms2_pilot"), "row_id", _lists(spark, sf_dir, fields))


FIELDS = ["name", "lipid_class", "instrument"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values that aren't an entry character for character, and the entry they stand for."""
    lists = table(spark, sf_dir, "compound_reference").select(F.lit("name").alias("field"), F.col("name").alias("typed"))
    lists = lists.unionByName(table(spark, sf_dir, "lipid_classes").select(F.lit("lipid_class").alias("field"), F.col("lipid_class").alias("typed")))
    lists = lists.unionByName(table(spark, sf_dir, "instruments").select(F.lit("instrument").alias("field"), F.col("instrument").alias("typed")))
    return _matched(spark, sf_dir, FIELDS).join(lists, ["field", "typed"], "left_anti").select("row_id", "field", "ref_id")


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that stand for no single entry, with how often they were typed and how many entries come equally near."""
    values = distinct_values(table(spark, sf_dir, "experimental_ms2_pilot"), "row_id", FIELDS)
    found = match_distinct(values, _lists(spark, sf_dir, FIELDS)).where("ref_id = 0")
    return found.join(values, ["field", "typed"]).select("field", "typed", "n_rows", "ties")


def p5_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry within the bound of each distinct typed value, with its distance."""
    values = distinct_values(table(spark, sf_dir, "experimental_ms2_pilot"), "row_id", FIELDS)
    return match_candidates(values, _lists(spark, sf_dir, FIELDS))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids by byte_bpe_50k."""
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text", counts_only=True, keep=("source", "lang")))


def _mixed(spark: SparkSession, sf_dir: str, policy: str) -> tuple[DataFrame, DataFrame, dict]:
    sized, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    plans = planned(sized, targets, policy=policy, domains=DOMAINS)
    return mix(sized, plans), targets, plans


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus of each plan at the greatest size that leaves no source short: documents with how often each is used."""
    return _mixed(spark, sf_dir, "exact")[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that p7_mix reaches."""
    return shares(*_mixed(spark, sf_dir, "exact"))


def p7_epoch_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached at the size of one epoch of the plan's documents, where small sources fall short."""
    return shares(*_mixed(spark, sf_dir, "one_epoch"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    subjects = sorted(r[0] for r in reference_rows(table(spark, sf_dir, "subject_areas"), "subject_id", most=1000))
    blocks = written_blocks(documents, table(spark, sf_dir, "subject_labels"), subjects)
    return score_blocks(blocks, train(blocks, subjects))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject areas that at least a fifth of a document's sentences treat."""
    return _scored(spark, sf_dir).where("subject_id is not null and n_treating * 5 >= n_sentences").select("doc_id", "subject_id")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject: documents that treat it and sentences about it; the null subject has the documents about nothing."""
    treats = F.col("subject_id").isNull() | (F.col("n_treating") * 5 >= F.col("n_sentences"))
    return _scored(spark, sf_dir).groupBy("subject_id").agg(F.count_if(treats).alias("n_documents"), F.sum("n_treating").cast("bigint").alias("n_sentences"))


QUERIES = {
    "p2_found": p2_found, "p2_splits": p2_splits, "p2_balance": p2_balance, "p3_found": p3_found, "p3_survivors": p3_survivors, "p5_found": p5_found, "p5_unmatched": p5_unmatched, "p5_candidates": p5_candidates,
    "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_epoch_shares": p7_epoch_shares, "p8_found": p8_found, "p8_composition": p8_composition,
}
SQL = {
    # ids in one form, reachability over rows that share one, the least id of each set
    "p2_found": r"""WITH RECURSIVE raw AS (SELECT gold_id, unnest([connectivity_id, split_group_id]) AS x FROM gold_spectra),
 n AS (SELECT gold_id, regexp_extract(regexp_replace(lower(x), '[\s\x{00A0}\x{200B}\x{FEFF}{}\[\]()<>"''-]', '', 'g'), '^(?:[a-z]*[g-z]|[a-z]+[_:.=#])?([0-9a-f]{24})$', 1) AS id FROM raw WHERE x IS NOT NULL),
 i AS (SELECT DISTINCT gold_id, id FROM n WHERE id <> '' AND len(list_distinct(string_split(id, ''))) > 2),
 e AS (SELECT DISTINCT a.id AS u, b.id AS v FROM i a JOIN i b USING (gold_id)),
 r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
 g AS (SELECT u, min(v) AS group_id, count(DISTINCT v) AS n FROM r GROUP BY 1)
SELECT DISTINCT gold_id, group_id FROM i JOIN g ON id = u WHERE n >= 2""",
}
