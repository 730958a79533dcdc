import json
import zipfile

import pytest
from pyspark.sql import functions as F

from spectraloom.sources import files, sinks

RECORD = """ACCESSION: XX000001
RECORD_TITLE: PC(16:0/18:1); LC-ESI-QTOF; MS2
LICENSE: CC0
CH$NAME: PC(16:0/18:1)
CH$NAME: other
CH$FORMULA: C42H82NO8P
CH$SMILES: CCOP
CH$EXACT_MASS: 759.5778
CH$LINK: INCHIKEY AAAAAAAAAAAAAA-BBBBBBBBBB-N
CH$LINK: LIPIDMAPS LM1
AC$INSTRUMENT: Maker Model
AC$INSTRUMENT_TYPE: LC-ESI-QTOF
AC$MASS_SPECTROMETRY: MS_TYPE MS2
AC$MASS_SPECTROMETRY: ION_MODE POSITIVE
AC$MASS_SPECTROMETRY: COLLISION_ENERGY 10 eV
AC$MASS_SPECTROMETRY: COLLISION_ENERGY 30 eV
MS$FOCUSED_ION: PRECURSOR_M/Z 760.585
MS$FOCUSED_ION: PRECURSOR_TYPE [m+h]+
PK$NUM_PEAK: 3
PK$PEAK: m/z int. rel.int.
  100.5 20 1
  bad line
  184.07 100.5 999
  200 5 1
//
  999 1 1
"""


def test_massbank(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.txt").write_text(RECORD)
    (tmp_path / "a" / "ms1.txt").write_text(RECORD.replace("MS2", "MS"))
    (tmp_path / "a" / "few.txt").write_text(RECORD.replace("  200 5 1\n", ""))
    (tmp_path / "a" / "empty.txt").write_text("")
    got = files.massbank_records(files.massbank_texts(spark, str(tmp_path / "a"))).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["spectrum_id"], r["name"], r["precursor_mz"], r["collision_energy"], r["adduct"], r["polarity"], r["lipid_class"], r["inchikey"][:3], r["lipidmaps_id"]) == ("XX000001", "PC(16:0/18:1)", 760.585, "30 eV", "[M+H]+", "positive", "PC", "AAA", "LM1")
    assert [p["mz"] for p in r["peaks"]] == [100.5, 184.07, 200.0] and r["all_names"] == ["PC(16:0/18:1)", "other"]


def test_massbank_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("d/r1.txt", RECORD)
        z.writestr("d/r2.TXT", b"\xff" + RECORD.replace("ACCESSION: XX000001\n", "").encode())
        z.writestr("d/readme.md", "no")
    (tmp_path / "broken.zip").write_bytes(b"nothing")
    texts = files.archive_texts(spark, str(tmp_path / "*.zip"))
    assert texts.where("error is not null").count() == 1 and texts.where("text is not null").count() == 2
    assert {r["spectrum_id"] for r in files.massbank_records(texts).collect()} == {"XX000001", "r2"}


def test_massspecgym(spark, tmp_path):
    head = "identifier\tformula\tsmiles\tmzs\tintensities\tprecursor_mz\tadduct\tcollision_energy\tinstrument_type\tparent_mass\tinchikey\tfold\tsimulation_challenge\n"
    good = "M1\tC42H82NO8P\tCCOP\t100.5,x,200,300,400\t1,2,3\t760.5\t[M+H]+\t30\tQTOF\t759.5\tAAA\ttrain\tTrue\n"
    (tmp_path / "t.tsv").write_text(head + good + good.replace("M1", "M2").replace("C42H82NO8P", "C6H12O6") + good.replace("M1", "M3").replace("760.5", "nan"))
    got = files.massspecgym_records(files.massspecgym_rows(spark, str(tmp_path / "t.tsv"))).collect()
    assert [(r["spectrum_id"], r["num_peaks"], [p["mz"] for p in r["peaks"]], r["polarity"]) for r in got] == [("M1", 3, [100.5, 200.0, 300.0], "positive")]
    with pytest.raises(FileNotFoundError):
        files.massspecgym_rows(spark, str(tmp_path / "absent.tsv"))


def test_mgf(spark, tmp_path):
    block = "BEGIN IONS\nNAME=LPC 16:0\nPEPMASS=496.34 1000\nADDUCT=[M+H]+\nIONMODE=positive\nSCANS=7\nSCANS=8\n100 1\n104.1 50\nnot peaks\n184.07 100\nEND IONS\n"
    (tmp_path / "x.mgf").write_text("comment\n" + block + "\n" + block.replace("SCANS=7\nSCANS=8\n", "").replace("PEPMASS=496.34 1000", "PEPMASS=500") + block.replace("PEPMASS=496.34 1000\n", ""))
    got = sorted(files.mgf_records(files.mgf_blocks(spark, str(tmp_path / "x.mgf")), "local").collect(), key=lambda r: r["precursor_mz"])
    assert [(r["spectrum_id"][:5], r["precursor_mz"], r["lipid_class"], r["num_peaks"]) for r in got] == [("8", 496.34, "LPC", 3), ("local", 500.0, "LPC", 3)]


def test_reference_catalogue(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("lm_id\tsmiles\tinchi_key\nL1\tCC\tAAA-B-C\nL2\tCO\tDDD-E-F\nL2\tCN\tGGG-H-I\n")
    (tmp_path / "r.sdf").write_text("mol\n\n> <LM_ID>\nL1\n\n> <NAME>\nn1\n\n> <FORMULA>\nC2H6\n\n$$$$\nmol\n\n> <LMID>\nL3\n\n> <SMILES>\nCCC\n\n$$$$\n")
    got = {r["lm_id"]: r for r in files.reference_catalogue(spark, str(tmp_path / "t.tsv"), str(tmp_path / "r.sdf")).collect()}
    assert (got["L1"]["smiles"], got["L1"]["name"], got["L1"]["formula_key"], got["L1"]["connectivity_key"], got["L1"]["from_sdf"]) == ("CC", "n1", "C2H6", "AAA", True)
    assert got["L2"]["smiles"] == "CN" and not got["L2"]["from_sdf"] and got["L3"]["inchi_key"] is None and len(got) == 3
    assert files.reference_catalogue(spark, str(tmp_path / "t.tsv")).count() == 2


def test_json_lines_and_usable_rows(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1, "usable_for_pilot_training": false}\n\n{"id": 2, "usable_for_pilot_training": true}\n{"id": 3}\n')
    df = files.json_lines(spark, str(tmp_path / "x.jsonl"), "id int, usable_for_pilot_training boolean")
    assert sorted(r["id"] for r in files.training_rows(df).collect()) == [2, 3]


def test_config(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("model:  # sizes\n  dim: 128\n  rate: 3e-4\n  name: 'x'\n  on: true\ndata:\n  path: null\n")
    assert files.simple_config(str(p)) == {"model": {"dim": 128, "rate": 3e-4, "name": "x", "on": True}, "data": {"path": None}}
    p.write_text("  a: 1\n")
    with pytest.raises(ValueError):
        files.simple_config(str(p))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, ["a", "b"]), (2, "x", None)], "z int, b string, l array<string>")
    sinks.write_json_lines(df.coalesce(1), str(tmp_path / "j"), sort_keys=True)
    lines = [json.loads(x) for f in (tmp_path / "j").glob("*.json") for x in f.read_text().splitlines()]
    assert list(lines[0]) == ["b", "l", "z"] and len(lines) == 2
    sinks.write_csv(df.coalesce(1), str(tmp_path / "c"), ["z", "l"])
    text = next((tmp_path / "c").glob("*.csv")).read_text()
    assert text.splitlines() == ["z,l", "1,a|b", "2,"]
    assert sinks.write_summary(df.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "s.json")) == {"n": 2}
    with pytest.raises(ValueError):
        sinks.write_summary(df, str(tmp_path / "s.json"))
    sinks.fan_out(df, {"all": None, "named": F.col("b").isNotNull()}, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f" / "named")).count() == 1 and spark.read.parquet(str(tmp_path / "f" / "all")).count() == 2
    new, old = tmp_path / "new", tmp_path / "deep" / "old"
    for d, t in ((new, "n"), (old, "o")):
        d.mkdir(parents=True)
        (d / "x").write_text(t)
    sinks.replace_folder(str(new), str(old))
    assert (old / "x").read_text() == "n" and not new.exists()
    with pytest.raises(ValueError):
        sinks.replace_folder(str(old), str(tmp_path))
