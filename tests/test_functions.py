import math

import pytest
from pyspark.sql import functions as F

from spectraloom.functions import normalize as n
from spectraloom.functions import peaks as p
from spectraloom.functions.text import finite, shown, stable_hash, strip


def one(spark, column, schema, *row):
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("\t a ",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(strip(F.col("x"))).collect()] == ["a", "", None]
    texts = ["1.5", " 2 ", "1.5d", "1_0", "nan", "inf", "1e400", "", None, "-3e2", ".5"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert [r[0] for r in df.select(finite(F.col("x"))).collect()] == [1.5, 2.0, None, None, None, None, None, None, None, -300.0, 0.5]
    assert one(spark, shown(F.col("x")), "x string", None) == "None"
    a = one(spark, stable_hash("p", F.col("x"), F.col("y")), "x string, y string", "a", "bc")
    assert a.startswith("p_") and len(a) == 26 and a != one(spark, stable_hash("p", F.col("x"), F.col("y")), "x string, y string", "ab", "c")
    assert one(spark, stable_hash("p", F.col("x")), "x string", None) != one(spark, stable_hash("p", F.col("x")), "x string", "~")


@pytest.mark.parametrize(
    "text, adduct, status",
    [("[m + nh4]+", "[M+NH4]+", "normalized"), ("[M-2H]2-", "[M-2H]2-", "normalized"), ("POSITIVE", "unknown", "ion_mode_not_adduct"), ("", "unknown", "missing"), (None, "unknown", "missing"), ("mystery", "unknown", "unparsed"),
     ("[M+H] +", "unknown", "unparsed"), (" [m+ch3coo]- x", "[M+CH3COO]-", "normalized"), ("[M+na]+", "[M+Na]+", "normalized")],
)
def test_adducts(spark, text, adduct, status):
    r = one(spark, n.adduct_fields(F.col("x")), "x string", text)
    assert (r["adduct"], r["status"]) == (adduct, status)


def test_first_adduct_by_trust(spark):
    get = lambda m: one(spark, n.first_adduct(F.col("m")), "m map<string,array<string>>", m)
    r = get({"MS$FOCUSED_ION": ["ION_TYPE [M+Na]+", "PRECURSOR_TYPE [M+H]+"]})
    assert (r["adduct"], r["field"]) == ("[M+H]+", "MS$FOCUSED_ION: PRECURSOR_TYPE")
    r = get({"MS$FOCUSED_ION": ["PRECURSOR_TYPE POSITIVE"], "ADDUCT": ["[M+K]+"]})
    assert (r["adduct"], r["field"]) == ("[M+K]+", "ADDUCT")
    assert get({})["status"] == "missing"


@pytest.mark.parametrize(
    "text, value, unit, status",
    [("30 eV", 30.0, "eV", "single_value"), ("30", 30.0, "eV", "single_value"), ("30%", 30.0, "%", "single_value"), ("Ramp 5-60 V", None, None, "range_or_compound"), ("Ramp 30", None, None, "free_text"), ("low", None, None, "free_text"), (None, None, None, "missing"), (" ", None, None, "missing")],
)
def test_energies(spark, text, value, unit, status):
    r = one(spark, n.energy_fields(F.col("x")), "x string", text)
    assert (r["value"], r["unit"], r["status"]) == (value, unit, status)


def test_identifiers(spark):
    key = "A" * 14
    r = one(spark, n.identifier_fields(F.col("x")), "x string", f" {key}-{'B' * 10}-n ".lower())
    assert r["semantics"] == "full_inchikey" and r["connectivity_key"] == key
    assert one(spark, n.identifier_fields(F.col("x")), "x string", key)["semantics"] == "connectivity_block"
    assert one(spark, n.identifier_fields(F.col("x")), "x string", "abc")["semantics"] == "unrecognized_identifier"
    assert one(spark, n.identifier_fields(F.col("x")), "x string", None)["semantics"] == "missing"


def test_formulas_and_candidates(spark):
    assert one(spark, n.formula_counts(F.col("x")), "x string", "C2H5OC2") == {"C": 4, "H": 5, "O": 1}
    assert one(spark, n.formula_key(n.formula_counts(F.col("x"))), "x string", "C2H5OC2") == "C4H5O"
    assert one(spark, n.formula_key(n.formula_counts(F.col("x"))), "x string", None) is None
    is_one = lambda f, name="", smi="": one(spark, n.lipid_candidate(n.formula_counts(F.col("f")), F.col("n"), F.col("s")), "f string, n string, s string", f, name, smi)
    assert is_one("C40H80NO8P") and not is_one("C40H80NO8") and not is_one("C7H20O8P") and not is_one("C20H10O8P") and is_one("C20H10O8P", "PC 16:0")
    assert not is_one("C40H80NO8P", "CDP something") and is_one("C40H80NO8P", "CDP-DAG") and not is_one("C40H80NO8P", "", "CCO") and is_one("C40H80NO8P", None, None)


def test_class_order(spark):
    get = lambda x: one(spark, n.class_of_name(F.col("x")), "x string", x)["lipid_class"]
    assert [get(x) for x in ("LysoPC 16:0", "PC(16:0/18:1)", "phosphatidylinositol mannoside", "PIM2", "Phosphatidylinositol lyso 16:0", "cardiolipin", "water", None)] == ["LPC", "PC", "PI", "PIM", "PI", "CL", None, None]
    assert one(spark, n.modifications_of_name(F.col("x")), "x string", "oxidized PC(O-16:0/18:1)") == ["ether", "oxidized"]


def test_linkages(spark):
    get = lambda x, c: one(spark, n.expected_linkages(F.col("x"), F.col("c")), "x string, c int", x, c)
    assert get("PE(18:0p/20:4)", 2) == ["ester", "vinyl_ether"] and get("PC 16:0e/18:1", 2) == ["alkyl_ether", "ester"] and get("PC 16:1e/18:1", 2) == ["ester", "vinyl_ether"]
    assert get("diacyl PC", 2) == ["ester", "ester"] and get("PC", 2) is None and get("plasmalogen", 0) is None and get(None, 2) is None
    assert one(spark, n.linkage_bucket(F.col("x")), "x array<string>", ["ester", "alkyl_ether"]) == "alkyl_ether/ester"
    assert one(spark, n.linkage_bucket(F.col("x")), "x array<string>", None) == "other"


def test_peak_features(spark):
    peaks = [[300.0, 9.0], [100.0, 1.0], [200.0, 4.0], [math.nan, 5.0], [50.0, -1.0], None, [7.0]]
    out = one(spark, p.peak_features(F.col("p"), F.col("m"), most=2), "p array<array<double>>, m double", peaks, 1000.0)
    assert [tuple(round(x, 9) for x in r) for r in out] == [(0.2, round(2 / 3, 9), 0.8), (0.3, 1.0, 0.7)]
    assert one(spark, p.peak_features(F.col("p"), F.col("m")), "p array<array<double>>, m double", [], 1.0) is None
    assert one(spark, p.peak_features(F.col("p"), F.col("m")), "p array<array<double>>, m double", [[1.0, 0.0]], 1.0) is None
    done = one(spark, p.peak_features(F.col("p"), F.col("m"), normalised=True), "p array<array<double>>, m double", [[300.0, 1.0], [200.0, 2 / 3]], 1000.0)
    assert [round(r["intensity"], 6) for r in done] == [0.666667, 1.0]
    ties = one(spark, p.peak_features(F.col("p"), F.col("m"), most=1), "p array<array<double>>, m double", [[5.0, 1.0], [3.0, 1.0]], 10.0)
    assert ties[0]["mz"] == 0.005


def test_padding(spark):
    f = p.pad(p.peak_features(F.col("p"), F.col("m")), 4)
    r = one(spark, f, "p array<array<double>>, m double", [[300.0, 9.0], [100.0, 1.0]], 1000.0)
    assert r["mask"] == [False, False, True, True] and len(r["values"]) == 4 and r["values"][3] == [0.0, 0.0, 0.0]
    assert one(spark, f, "p array<array<double>>, m double", None, 1000.0)["mask"] == [True] * 4


def test_labels(spark):
    schema = "h string, c string, x array<struct<carbon:int,double_bonds:int,linkage:string>>, s string"
    get = lambda *row: one(spark, p.record_labels(F.col("h"), F.col("c"), F.col("x"), F.col("s")), schema, *row)
    r = get("PC", None, [(16, 0, None)], "vinyl_ether")
    assert r["error"] is None and r["chain_count"] == 0 and r["chain_mask"] == [True, False] and r["linkage_mask"] == [True, False] and r["linkage"][0] == 2
    r = get("PC", None, [(20, 4, None), (18, 1, None)], "ester")
    assert r["carbon"] == [16, 18] and r["linkage_mask"] == [False, False]
    assert get("PC", None, [(20, 4, "ester"), (18, 1, "ether")], None)["linkage_mask"] == [True, True]
    assert get("XX", None, [(20, 4, None)], None)["error"] == "unsupported headgroup" and get("PC", None, [], None)["error"] == "unsupported chain count" and get("PC", None, [(50, 0, None)], None)["error"] == "carbon out of range"
    assert get("", "PE", [(20, 4, None)], None)["headgroup"] == 2 - 0


def test_model_outputs(spark):
    assert [round(x, 4) for x in one(spark, p.softmax(F.col("x")), "x array<double>", [1.0, 2.0])] == [0.2689, 0.7311]
    assert one(spark, p.argmax(F.col("x")), "x array<double>", [1.0, 3.0, 3.0]) == 1 and one(spark, p.argmax(F.col("x")), "x array<double>", []) is None
    df = spark.createDataFrame([([1.0, 2.0], 0, False)], "x array<double>, t int, m boolean")
    assert df.agg(p.masked_mean(p.cross_entropy(F.col("x"), F.col("t")), F.col("m"))).first()[0] == 0.0
    assert abs(df.select(p.cross_entropy(F.col("x"), F.col("t"))).first()[0] - 1.3132617) < 1e-6


def test_class_consistency(spark):
    assert one(spark, n.class_consistency(F.col("c"), F.col("t")), "c array<string>, t string", ["PC", "PE", None, "XY"], "glycerophosphocholine xy") == {"PC": True, "PE": False, "XY": True}
