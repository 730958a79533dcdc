import datetime as dt

import pytest

from spectraloom.operators.units import note_defaults, to_common_unit

UNITS = [(1, "eV", 1.0, None), (2, "keV", 1000.0, None), (3, "meV", 0.001, None), (4, "V", 1.0, "charge"), (5, "% NCE", 0.002, "precursor_mz"), (6, "NCE fraction", 0.2, "precursor_mz"),
         (7, "kJ/mol", 0.010364, None), (8, "kcal/mol", 0.043364, None), (9, "hartree", 27.211386, None)]
NOTES = [(1, "Energies are electronvolts."), (2, "Field holds volts; no symbol."), (3, "Up to and including 2018 the field holds volts; from 2019 electronvolts."), (4, None), (5, "Spray voltage 3500 V; source 120 C."),
         (6, "Percent of normalized CE through 2019, plain eV since 2020."), (7, "Energy typed in kilocalories per mole, other voltages in V."), (8, "All energies eV; listed again in kJ/mol.")]


@pytest.fixture(scope="module")
def refs(spark):
    return spark.createDataFrame(UNITS, "unit_id int, unit string, factor_to_ev double, scaled_by string"), spark.createDataFrame(NOTES, "contributor_id int, note string")


def run(spark, refs, rows):
    schema = "row_id bigint, contributor_id int, ce string, title string, day date, charge int, adduct string, precursor_mz double, value string, unit_id string"
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], schema)
    out = to_common_unit(df, *refs, key="row_id", field="ce", title="title", date="day", charge="charge", adduct="adduct")
    return {r["row_id"]: r for r in out.collect()}


CASES = [
    ("12 eV", None, 1, 12.0), ("0.02 keV", None, 2, 20.0), ("25000 meV", None, 3, 25.0), ("30 volts", None, 4, 60.0), ("NCE=20", None, 5, 20.0), ("0.2 NCE, 0-1 scale", None, 6, 20.0), ("0,2 of full NCE (=1)", None, 6, 20.0),
    ("1929.7kJ mol-1", None, 7, 19.99941), ("461.2 kcal mol^-1", None, 8, 19.99948), ("1 a.u. (Hartree)", None, 9, 27.211386), ("30 V (cone 20 V)", None, 4, 60.0), ("30 eV; capillary 3.5 kV", None, 1, 30.0),
    ("thirty-five eV", None, 1, 35.0), ("twenty percent NCE", None, 5, 20.0), ("ramp 20–40 eV", None, 1, 30.0), ("steps 10; 20; 30 V", None, 4, 40.0), ("CE 20", "PC; CE: 0.02 keV; cone 3 V", 2, 20000.0), ("see title", "PC(16:0/18:1); coll. energy 30 per cent; spray 3 kV", 5, 30.0),
    ("see title", "PC(16:0/18:1); cone 25 V", None, None), ("n/a", None, None, None), ("", None, None, None), (None, None, None, None), ("12 furlongs", None, None, None), ("HCD 25.0 (nominal)", None, 1, 25.0),
]


def test_texts(spark, refs):
    rows = [(i, 1, ce, title, None, -2, None, 500.0) for i, (ce, title, *_) in enumerate(CASES)]
    got = run(spark, refs, rows)
    assert len(got) == len(CASES)
    for i, (ce, title, unit, ev) in enumerate(CASES):
        assert got[i]["unit_id"] == unit, (ce, title, got[i])
        assert got[i]["value_ev"] == (pytest.approx(ev, rel=1e-4) if ev is not None else None), (ce, got[i])


def test_note_is_last_and_may_change_by_year(spark, refs):
    d = dt.date
    rows = [(1, 2, "20", None, None, 1, None, 1.0), (2, 2, "20 eV", None, None, 1, None, 1.0), (3, 3, "20", None, d(2018, 12, 31), 1, None, 1.0), (4, 3, "20", None, d(2019, 1, 1), 1, None, 1.0), (5, 3, "20", None, None, 1, None, 1.0),
            (6, 4, "20", None, None, 1, None, 1.0), (7, 5, "20", None, None, 1, None, 1.0), (8, 6, "20", None, d(2015, 1, 1), 1, None, 1.0), (9, 6, "20", None, d(2021, 1, 1), 1, None, 1.0), (10, 7, "20", None, None, 1, None, 1.0),
            (11, 8, "20", None, None, 1, None, 1.0), (12, None, "20", None, None, 1, None, 1.0)]
    got = run(spark, refs, rows)
    assert [got[i]["unit_id"] for i in range(1, 13)] == [4, 1, 4, 1, None, None, None, 5, 1, 8, 1, None]


def test_scale_from_adduct_and_missing_scale(spark, refs):
    got = run(spark, refs, [(1, 4, "20 V", None, None, None, "[M-2H]2-", 1.0), (2, 4, "20 V", None, None, None, None, 1.0), (3, 4, "20 % NCE", None, None, 1, None, None)])
    assert (got[1]["value_ev"], got[2]["value_ev"], got[3]["value_ev"], got[3]["unit_id"]) == (40.0, 20.0, None, 5)


def test_empty_table(spark, refs):
    assert run(spark, refs, []) == {}


def test_notes_of_the_tables(spark, sf_dir):
    rows = {(r["contributor_id"], r["default_unit"]) for r in note_defaults(spark.read.parquet(f"{sf_dir}/contributors.parquet")).collect()}
    assert {(5, "NCE fraction"), (6, "kJ/mol"), (10, "keV"), (12, "V"), (12, "eV"), (16, "meV"), (19, "kcal/mol"), (20, "eV"), (23, "% NCE")} <= rows
    assert not {i for i, _ in rows} & {7, 11, 17, 21}
