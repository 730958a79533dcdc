"""Readers of the record formats: MassBank text, MassSpecGym tables, MGF, JSON lines, reference TSV and SDF, and small configs."""

from __future__ import annotations

import io
import os
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spectraloom.arrow import map_columns
from spectraloom.functions import normalize as n
from spectraloom.functions import rules
from spectraloom.functions.text import filled, finite, strip, truthy

_PEAKS = "array<struct<mz:double,intensity:double>>"


def require(*paths: str) -> None:
    """Raises ``FileNotFoundError`` for the first local path that is absent."""
    for path in paths:
        if "://" not in path and not os.path.exists(path):
            raise FileNotFoundError(path)


def _numbers(lines: Column) -> Column:
    """Peaks of "mz intensity" lines; lines that don't begin with two numbers are passed over."""
    pair = lambda x: F.struct(finite(F.get(F.split(strip(x), r"\s+"), F.lit(0))).alias("mz"), finite(F.get(F.split(strip(x), r"\s+"), F.lit(1))).alias("intensity"))
    return F.filter(F.transform(lines, pair), lambda p: p["mz"].isNotNull() & p["intensity"].isNotNull())


def _usable(peaks: Column, least: int) -> Column:
    kept = F.filter(peaks, lambda p: (p["mz"] > 0) & (p["intensity"] >= 0))
    return F.when(F.size(kept) >= least, kept).otherwise(F.array().cast(_PEAKS))


def archive_texts(spark: SparkSession, paths: str, suffix: str = ".txt") -> DataFrame:
    """(source_file, text) of the members of zip archives, one archive per task. Undecodable bytes are replaced.

    An archive that can't be opened gives one row with its error and a null text.
    """

    def unpack(columns: dict[str, list]) -> dict[str, list]:
        rows = []
        for path, content in zip(columns["path"], columns["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.lower().endswith(suffix) and not name.endswith("/"):
                            rows.append((f"{path}!{name}", z.read(name).decode("utf-8", "replace"), None))
            except zipfile.BadZipFile as e:
                rows.append((path, None, str(e)))
        return dict(zip(("source_file", "text", "error"), map(list, zip(*rows)))) if rows else {"source_file": [], "text": [], "error": []}

    return map_columns(spark.read.format("binaryFile").load(paths).select("path", "content"), lambda: unpack, "source_file string, text string, error string")


def massbank_texts(spark: SparkSession, paths: str) -> DataFrame:
    """(source_file, text) of unpacked MassBank records, one file per row."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("source_file"), F.col("value").alias("text"))


def massbank_records(texts: DataFrame, least_peaks: int = 3) -> DataFrame:
    """Spectrum records of MassBank texts (source_file, text). Only MS2 records with a precursor, enough peaks and a
    fitting name or formula come out.

    ``KEY: value`` lines before the peak block become a map of lists; single fields take the first of their
    lines, precursor, ion mode and energy the last; links are the last of their kind.
    """
    lines = F.split("text", r"\r\n|\n|\r")
    at = F.array_position(F.transform("lines", lambda x: x.startswith("PK$PEAK:")), True)
    head = F.when(at > 0, F.slice("lines", 1, F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(F.col("lines"))
    tail = F.when(at > 0, F.slice(F.col("lines"), (at + 1).cast("int"), F.size("lines"))).otherwise(F.array().cast("array<string>"))
    stop = F.array_position(F.transform("tail", lambda x: x.startswith("//")), True)
    peak_lines = F.when(stop > 0, F.slice("tail", 1, (stop - 1).cast("int"))).otherwise(F.col("tail"))
    pairs = F.transform(F.filter(F.col("head"), lambda x: x.contains(":")), lambda x: F.struct(strip(F.regexp_extract(x, "^([^:]*):", 1)).alias("k"), strip(F.regexp_extract(x, "(?s)^[^:]*:(.*)$", 1)).alias("v")))
    keys = F.array_distinct(F.transform("pairs", lambda x: x["k"]))
    fields = F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter("pairs", lambda x: x["k"] == k), lambda x: x["v"])))
    df = texts.where("text is not null").select("source_file", "text", lines.alias("lines")).select("source_file", "text", "lines", head.alias("head"), tail.alias("tail"))
    df = df.select("source_file", "text", pairs.alias("pairs"), _numbers(peak_lines).alias("raw")).select("source_file", "text", fields.alias("f"), "raw")
    of = lambda k: F.coalesce(F.try_element_at("f", F.lit(k)), F.array().cast("array<string>"))
    first = lambda k: F.get(of(k), F.lit(0))
    last = lambda k, test: F.try_element_at(F.filter(of(k), test), F.lit(-1))
    word = lambda c: F.try_element_at(F.split(c, r"\s+"), F.lit(-1))
    spectrum = "AC$MASS_SPECTROMETRY"
    title = F.array_join(of("RECORD_TITLE"), " ")
    ms = F.upper(F.array_join(of(spectrum), " "))
    energy = last(spectrum, lambda x: F.upper(x).contains("COLLISION_ENERGY"))
    precursor = F.coalesce(finite(word(last(spectrum, lambda x: F.upper(x).startswith("PRECURSOR_M/Z")))), finite(F.regexp_extract("text", r"(?i)PRECURSOR_M/Z\s+([0-9.]+)", 1)))
    stem = F.regexp_extract(F.regexp_replace("source_file", r"^.*[!/]", ""), r"^(.*?)(?:\.[^.]*)?$", 1)
    df = df.where(ms.contains("MS2") | ms.contains("MS/MS") | F.upper(title).contains("MS2")).select(
        F.coalesce(first("ACCESSION"), stem).alias("spectrum_id"), F.lit("MassBank-data").alias("source"), "source_file", F.coalesce(first("LICENSE"), first("COPYRIGHT")).alias("license"),
        title.alias("record_title"), F.coalesce(first("CH$NAME"), title).alias("name"), of("CH$NAME").alias("all_names"), first("CH$FORMULA").alias("formula"), first("CH$SMILES").alias("smiles"),
        finite(first("CH$EXACT_MASS")).alias("exact_mass"), precursor.alias("precursor_mz"), word(last(spectrum, lambda x: F.upper(x).startswith("ION_MODE"))).alias("ion_mode"),
        F.when(energy.contains(" "), F.regexp_extract(energy, r"(?s)^\S* (.*)$", 1)).otherwise(energy).alias("collision_energy"), first("AC$INSTRUMENT").alias("instrument"), first("AC$INSTRUMENT_TYPE").alias("instrument_type"),
        word(last("CH$LINK", lambda x: F.upper(x).startswith("INCHIKEY"))).alias("inchikey"), word(last("CH$LINK", lambda x: F.upper(x).startswith("LIPIDMAPS"))).alias("lipidmaps_id"),
        n.first_adduct(F.col("f")).alias("adduct_info"), _usable(F.col("raw"), least_peaks).alias("peaks"),
    )
    return _classified(df, F.concat_ws(" ; ", F.array_join("all_names", " ; "), "record_title"))


def _classified(df: DataFrame, text: Column) -> DataFrame:
    """Records with class, family, modifications and polarity; those that no class name fits must have a fitting formula."""
    candidate = n.lipid_candidate(n.formula_counts(F.col("formula")), F.col("name"), F.col("smiles"))
    known = F.when(F.col("adduct_info.adduct") != "unknown", F.col("adduct_info.adduct"))
    kept = df.where(F.col("precursor_mz").isNotNull() & (F.size("peaks") > 0)).withColumn("c", n.class_of_name(text)).where(F.col("c.lipid_class").isNotNull() | candidate)
    return kept.select(
        *[c for c in df.columns if c not in ("adduct_info", "ion_mode")], F.coalesce("c.lipid_class", F.lit(rules.UNRESOLVED)).alias("lipid_class"), F.coalesce("c.family", F.lit(rules.CANDIDATE_FAMILY)).alias("lipid_family"),
        n.modifications_of_name(text).alias("linkage_modifications"), F.when(F.col("c.lipid_class").isNull(), "formula_structure_filter").otherwise("name_alias").alias("classification_source"),
        F.col("adduct_info.adduct").alias("adduct"), F.col("adduct_info.raw").alias("adduct_raw"), F.col("adduct_info.status").alias("adduct_status"), n.polarity(F.col("ion_mode"), known).alias("polarity"), F.size("peaks").alias("num_peaks"),
    )


MASSSPECGYM = "identifier string, formula string, smiles string, mzs string, intensities string, precursor_mz string, adduct string, collision_energy string, instrument_type string, parent_mass string, inchikey string, fold string, simulation_challenge string"


def massspecgym_rows(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of a MassSpecGym TSV with a header."""
    require(path)
    return spark.read.csv(path, sep="\t", header=True, schema=MASSSPECGYM, quote='"', escape='"', multiLine=True)


def massspecgym_records(rows: DataFrame, least_peaks: int = 3) -> DataFrame:
    """Spectrum records of MassSpecGym rows with a fitting formula: the filter stands before the peaks are parsed.

    The two comma-joined lists are paired to the shorter one; items that are no numbers drop out of their list first.
    Lists that were parsed before (arrays) are paired by position, and pairs without both numbers drop out.
    """
    parsed = dict(rows.dtypes)["mzs"].startswith("array")
    floats = lambda c: F.col(c) if parsed else F.filter(F.transform(F.split(F.coalesce(F.col(c).cast("string"), F.lit("")), ","), finite), lambda x: x.isNotNull())
    kept = rows.where(n.lipid_candidate(n.formula_counts(F.col("formula")), F.lit(""), F.col("smiles")))
    both = kept.select("*", floats("mzs").alias("__m"), floats("intensities").alias("__i"))
    length = F.least(F.size("__m"), F.size("__i"))
    peaks = F.zip_with(F.slice("__m", 1, length), F.slice("__i", 1, length), lambda m, i: F.struct(m.alias("mz"), i.alias("intensity")))
    peaks = F.filter(peaks, lambda x: x["mz"].isNotNull() & x["intensity"].isNotNull())
    info = n.adduct_fields(F.col("adduct"))
    known = F.when(info["adduct"] != "unknown", info["adduct"])
    out = both.select(
        F.col("identifier").alias("spectrum_id"), F.lit("MassSpecGym1.5").alias("source"), F.lit(rules.UNRESOLVED).alias("lipid_class"), n.polarity(F.lit(None).cast("string"), known).alias("polarity"),
        finite(F.col("precursor_mz")).alias("precursor_mz"), info["adduct"].alias("adduct"), info["status"].alias("adduct_status"), "collision_energy", "instrument_type", "formula", finite(F.col("parent_mass")).alias("exact_mass"),
        "smiles", "inchikey", _usable(peaks, least_peaks).alias("peaks"), F.col("fold").alias("upstream_fold"), "simulation_challenge",
    )
    return out.where(F.col("precursor_mz").isNotNull() & (F.size("peaks") > 0)).withColumn("num_peaks", F.size("peaks"))


def mgf_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, ordinal, block) of an MGF file, split where a block ends; blocks stay in the file's order per split."""
    require(path)
    raw = spark.read.option("lineSep", "END IONS").text(path)
    return raw.select(F.input_file_name().alias("source_file"), F.monotonically_increasing_id().alias("ordinal"), F.col("value").alias("block")).where(F.upper("block").contains("BEGIN IONS"))


def mgf_records(blocks: DataFrame, source: str, least_peaks: int = 3) -> DataFrame:
    """Spectrum records of MGF blocks. Keys are upper-cased and the last line of a key counts; other lines are peaks.

    A record without an id is named by its source, file split and place in it (``ordinal``).
    """
    body = F.regexp_extract("block", r"(?is)BEGIN IONS[ \t]*\r?\n(.*)$", 1)
    lines = F.filter(F.transform(F.split(body, r"\r\n|\n|\r"), strip), lambda x: x != "")
    df = blocks.select("source_file", "ordinal", lines.alias("lines"))
    pairs = F.transform(F.filter("lines", lambda x: x.contains("=")), lambda x: F.struct(F.upper(strip(F.regexp_extract(x, "^([^=]*)=", 1))).alias("k"), strip(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("v")))
    df = df.select("source_file", "ordinal", pairs.alias("pairs"), _numbers(F.filter("lines", lambda x: ~x.contains("="))).alias("raw"))
    last = lambda k: truthy(F.try_element_at(F.filter("pairs", lambda x: x["k"] == k), F.lit(-1))["v"])
    name = F.coalesce(last("NAME"), last("COMPOUND_NAME"), last("TITLE"))
    df = df.select(
        F.coalesce(last("SPECTRUMID"), last("SCANS"), F.concat_ws(":", F.lit(source), F.col("ordinal").cast("string"))).alias("spectrum_id"), F.lit(source).alias("source"), "source_file", "ordinal", last("LICENSE").alias("license"),
        last("TITLE").alias("record_title"), name.alias("name"), last("FORMULA").alias("formula"), F.coalesce(last("SMILES"), last("CANONICALSMILES")).alias("smiles"),
        finite(F.get(F.split(last("PEPMASS"), r"\s+"), F.lit(0))).alias("precursor_mz"), n.adduct_fields(F.coalesce(last("ADDUCT"), last("PRECURSORTYPE"))).alias("adduct_info"), last("IONMODE").alias("ion_mode"),
        last("COLLISIONENERGY").alias("collision_energy"), last("INSTRUMENT").alias("instrument"), last("INSTRUMENTTYPE").alias("instrument_type"), finite(last("EXACTMASS")).alias("exact_mass"),
        last("INCHIKEY").alias("inchikey"), last("LIPIDMAPS").alias("lipidmaps_id"), _usable(F.col("raw"), least_peaks).alias("peaks"),
    )
    return _classified(df, F.coalesce("name", F.lit("")))


def json_lines(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, a malformed line fails the read."""
    require(path)
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def training_rows(df: DataFrame, usable: str = "usable_for_pilot_training") -> DataFrame:
    """Rows that aren't marked unusable: only an explicit false drops a row, null is kept."""
    return df.where(F.coalesce(F.col(usable), F.lit(True)))


#: Property names of the SDF catalogue, in order of preference per column.
SDF_PROPERTIES = {
    "lm_id": ["LM_ID", "LMID"], "smiles": ["SMILES"], "inchi_key": ["INCHI_KEY", "INCHIKEY"], "name": ["COMMON_NAME", "NAME", "SYSTEMATIC_NAME", "ABBREVIATION"], "abbreviation": ["ABBREVIATION"],
    "synonyms": ["SYNONYMS"], "category": ["CATEGORY"], "main_class": ["MAIN_CLASS"], "sub_class": ["SUB_CLASS"], "class_level4": ["CLASS_LEVEL4"], "formula": ["FORMULA"], "inchi": ["INCHI"],
}


def sdf_properties(spark: SparkSession, path: str) -> DataFrame:
    """One row of properties per SDF record (split at ``$$$$``); the connection table isn't read."""
    require(path)
    raw = spark.read.option("lineSep", "$$$$").text(path).where(F.col("value").contains("> <"))
    of = lambda k: filled(F.regexp_extract("value", rf"(?m)^>\s*<{k}>[^\n]*\n([^\n]*)", 1))
    return raw.select(*[F.coalesce(*[of(k) for k in keys]).alias(c) for c, keys in SDF_PROPERTIES.items()]).where("lm_id is not null")


def reference_catalogue(spark: SparkSession, tsv: str, sdf: str | None = None) -> DataFrame:
    """The reference catalogue: SDF records completed from the TSV, and TSV-only ids; of repeated TSV ids the last stands.

    Adds the connectivity key and the formula key that matching uses.
    """
    require(tsv)
    rows = spark.read.csv(tsv, sep="\t", header=True).select("lm_id", F.col("smiles").alias("t_smiles"), F.col("inchi_key").alias("t_key"), F.monotonically_increasing_id().alias("at")).where(truthy(F.col("lm_id")).isNotNull())
    rows = rows.groupBy("lm_id").agg(F.max_by(F.struct("t_smiles", "t_key"), "at").alias("t")).select("lm_id", "t.*")
    empty = [F.lit(None).cast("string").alias(c) for c in SDF_PROPERTIES if c not in ("lm_id", "smiles", "inchi_key")]
    if sdf:
        props = sdf_properties(spark, sdf)
        from_sdf = props.join(rows, "lm_id", "left").select("lm_id", F.coalesce("smiles", "t_smiles").alias("smiles"), F.coalesce("inchi_key", "t_key").alias("inchi_key"), *[c for c in SDF_PROPERTIES if c not in ("lm_id", "smiles", "inchi_key")], F.lit(True).alias("from_sdf"))
        only = rows.join(props.select("lm_id"), "lm_id", "left_anti")
    else:
        from_sdf, only = None, rows
    out = only.select("lm_id", F.col("t_smiles").alias("smiles"), F.col("t_key").alias("inchi_key"), *empty, F.lit(False).alias("from_sdf"))
    out = from_sdf.unionByName(out) if from_sdf is not None else out
    return out.withColumn("connectivity_key", F.when(F.col("inchi_key").contains("-"), F.substring_index("inchi_key", "-", 1))).withColumn("formula_key", n.formula_key(n.formula_counts(F.col("formula"))))


def simple_config(path: str) -> dict[str, dict[str, object]]:
    """A two-level config of ``section:`` lines and indented ``key: value`` lines; "#" begins a comment.

    Values are booleans, null, integers, floats or text (quotes are taken off).
    """
    require(path)
    out: dict[str, dict[str, object]] = {}
    section: dict[str, object] | None = None
    for number, line in enumerate(Path(path).read_text(encoding="utf-8").splitlines(), 1):
        body = line.split("#", 1)[0].rstrip()
        if not body.strip():
            continue
        key, colon, value = body.strip().partition(":")
        if not colon:
            raise ValueError(f"{path}:{number}: no colon")
        if not body[0].isspace():
            section = out.setdefault(key.strip(), {})
            if value.strip():
                raise ValueError(f"{path}:{number}: a section has no value")
        elif section is None:
            raise ValueError(f"{path}:{number}: a value outside a section")
        else:
            section[key.strip()] = _scalar(value.strip())
    return out


def _scalar(text: str) -> object:
    words = {"true": True, "false": False, "null": None, "none": None, "": None, "~": None}
    if text.lower() in words:
        return words[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text.strip("'\"")
