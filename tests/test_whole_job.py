"""Registered queries do the whole job, on small tables of their own."""

from pyspark.sql import functions as F

from spectraloom.operators import duplicates
from spectraloom.plans import spectral, structures


def test_all_of_200_peaks(spark, tmp_path):
    rows = [(1, 900.0, [[100.0 + i, 1.0 + i] for i in range(60)]), (2, 900.0, [[100.0 + i, 1.0 + i] for i in range(250)]), (3, None, [[100.0, 1.0]])]
    spark.createDataFrame(rows, "row_id bigint, precursor_mz double, peaks_raw array<array<double>>").coalesce(1).write.parquet(f"{tmp_path}/experimental_ms2_pilot.parquet")
    features = spectral.QUERIES["peak_features"](spark, str(tmp_path)).groupBy("row_id").count().collect()
    assert sorted(map(tuple, features)) == [(1, 60), (2, 200)]
    masks = spectral.QUERIES["padded_masks"](spark, str(tmp_path)).groupBy("row_id").agg({"*": "count", "slot": "max"}).collect()
    assert sorted(tuple(r)[0] for r in masks) == [1, 2, 3] and {r["count(1)"] for r in masks} == {200}
    free = spectral.QUERIES["padded_masks"](spark, str(tmp_path)).where("not masked").groupBy("row_id").count().collect()
    assert sorted(map(tuple, free)) == [(1, 60), (2, 200)]


def test_first_ids_of_a_group(spark, sf_dir):
    rows = spectral._spectra(spark, sf_dir)
    got = {r["peak_identity_hash"]: r for r in duplicates.duplicate_groups(rows).collect()}
    ids = {}
    for r in sorted(rows.select("peak_identity_hash", "_ord", "spectrum_id", "connectivity_id").collect(), key=lambda r: r["_ord"]):
        ids.setdefault(r["peak_identity_hash"], []).append(r)
    assert got.keys() == ids.keys()
    for k, items in ids.items():
        assert got[k]["example_spectrum_ids"] == [r["spectrum_id"] for r in items[:10]] and got[k]["connectivity_ids"] == sorted({r["connectivity_id"] for r in items})
    hot = rows.limit(1).withColumn("_ord", F.explode(F.sequence(F.lit(1), F.lit(30)))).withColumn("spectrum_id", F.when(F.col("_ord") != 3, F.concat(F.lit("s"), F.col("_ord"))))
    assert duplicates.duplicate_groups(hot).first()["example_spectrum_ids"] == [None if i == 3 else f"s{i}" for i in range(1, 11)]


def test_massspecgym_lists_in_all_notations(spark, tmp_path):
    lists = [("100,200,300", "1,2,3"), ("[100.0, 200.0, 300.0]", "[1.0, 2.0, 3.0]"), ("100;200;300", "1;2;3"), ("100 -  200 300".replace("-  ", ""), "1 2 3"), ("100:1 200:2 300:3", None), ("[100,nan,200,300]", "[1,9,2,3]"), (None, "1,2,3")]
    rows = [(i, f"M{i}", "C42H82NO8P", "CCOP", m, x, 760.5, "[M+H]+", 759.5) for i, (m, x) in enumerate(lists)]
    df = spark.createDataFrame(rows, "raw_id bigint, identifier string, formula string, smiles string, mzs string, intensities string, precursor_mz double, adduct string, parent_mass double")
    for c in ("collision_energy", "instrument_type", "inchikey", "fold"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    df.withColumn("simulation_challenge", F.lit(False)).coalesce(1).write.parquet(f"{tmp_path}/massspecgym_raw.parquet")
    got = structures.QUERIES["massspecgym_spectra"](spark, str(tmp_path)).collect()
    assert sorted((r["spectrum_id"], r["num_peaks"]) for r in got) == [(f"M{i}", 3) for i in range(6)]
