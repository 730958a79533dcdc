import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spectraloom.functions import rules
from spectraloom.operators import duplicates, evaluation, group_split, identity, matching, rollup

SCHEMA = "row_id bigint, spectrum_id string, source string, source_file string, license string, name string, record_title string, smiles string, inchikey string, formula string, structure_record_id string, precursor_mz double, polarity string, adduct_qc_only string, collision_energy_qc_only string, instrument string, instrument_type_qc_only string, peaks_raw array<array<double>>"
BASE = dict(row_id=1, spectrum_id="A", source="S", source_file="f", license=None, name="PC(16:0/18:1)", record_title=None, smiles="CCO", inchikey=None, formula="C42H82NO8P", structure_record_id="s", precursor_mz=760.5, polarity=None, adduct_qc_only="[M+H]+",
            collision_energy_qc_only="30 eV", instrument="I", instrument_type_qc_only="QTOF", peaks_raw=[[100.0, 5.0], [200.0, 7.0], [300.0, 9.0]])


def frame(spark, *changes):
    rows = [{**BASE, "row_id": i + 1, **c} for i, c in enumerate(changes)]
    df = spark.createDataFrame([tuple(r[f.split()[0]] for f in SCHEMA.split(", ")) for r in rows], SCHEMA)
    return identity.identity_hashes(identity.structure_ids(identity.spectra(df)))


def hashes(spark, *changes):
    return [(r["peak_identity_hash"], r["acquisition_metadata_hash"], r["acquisition_record_hash"]) for r in frame(spark, {}, *changes).orderBy("_ord").collect()]


def test_hash_boundaries(spark):
    base, repeat, order, other_id, energy, instrument, intensity = hashes(
        spark, {}, {"peaks_raw": BASE["peaks_raw"][::-1]}, {"spectrum_id": "B"}, {"collision_energy_qc_only": "20 eV"}, {"instrument": "J"}, {"peaks_raw": [[100.0, 5.5], [200.0, 7.0], [300.0, 9.0]]}
    )
    assert repeat == base and order == base
    assert other_id[:2] == base[:2] and other_id[2] != base[2]
    assert energy[0] == base[0] and energy[1] != base[1] and instrument[0] == base[0] and instrument[1] != base[1]
    assert intensity[0] != base[0]


@pytest.mark.parametrize(
    "change, relation",
    [({}, "removable_exact_duplicate"), ({"spectrum_id": "B"}, "same_source_acquisition_duplicate_candidate"), ({"collision_energy_qc_only": "20 eV"}, "same_peaks_different_collision_energy"), ({"instrument": "J"}, "same_peaks_different_instrument"),
     ({"source": "T"}, "cross_source_peak_duplicate"), ({"precursor_mz": 1.0}, "unique")],
)
def test_relations(spark, change, relation):
    df = frame(spark, {}, change)
    stamped = duplicates.stamp_groups(df, duplicates.duplicate_groups(df)).collect()
    assert {r["duplicate_relation"] for r in stamped} == {relation}


def test_missing_metadata_relation(spark):
    df = frame(spark, {"collision_energy_qc_only": None}, {"collision_energy_qc_only": None, "spectrum_id": "B"})
    assert {r["duplicate_relation"] for r in duplicates.duplicate_groups(df).collect()} == {"missing_acquisition_metadata"}


def test_rows_that_are_dropped_and_empty_tables(spark):
    df = frame(spark, {}, {"precursor_mz": None}, {"peaks_raw": [[1.0, 1.0]]}, {"peaks_raw": None}, {"precursor_mz": float("nan")})
    assert df.count() == 1
    none = df.where("false")
    assert duplicates.duplicate_groups(none).count() == 0 and rollup.structure_rollup(none).count() == 0
    assert duplicates.with_counts(none, ["peak_identity_hash"]).collect()[0].asDict() == {"n_rows": 0, "n_kept": 0, "n_removed": 0}


def test_first_seen_does_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None, "c"]), f"v{i}") for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "_ord bigint, k string, v string")
    want = {}
    for o, k, v in sorted(rows):
        want.setdefault(k, (o, v))
    for n in (1, 7):
        assert {r["k"]: (r["_ord"], r["v"]) for r in duplicates.first_seen(df.repartition(n), ["k"]).collect()} == want


def test_modal_value_and_histograms(spark):
    rows = [(1, "x", "b"), (2, "x", "a"), (3, "x", "a"), (4, "x", "b"), (5, "y", None), (6, "y", None), (7, "y", "a"), (8, None, "a")]
    df = spark.createDataFrame(rows, "_ord bigint, k string, v string")
    got = {r["k"]: (r["v"], r["n"], r["n_rows"]) for r in rollup.modal_value(df, "k", "v").collect()}
    assert got == {"x": ("b", 2, 4), "y": (None, 2, 3), None: ("a", 1, 1)}
    h = [(r["value"], r["n"], r["rank"]) for r in rollup.histograms(df, ["v"]).orderBy("rank").collect()]
    assert h == [("a", 4, 1), ("b", 2, 2), ("unknown", 2, 3)]


def test_tiers_first_hit_wins(spark):
    items = spark.createDataFrame([(1, ["k9", "k1"], ["s1"]), (2, [], ["s1", "s2"]), (3, [None], []), (4, ["zz"], ["s2"])], "id int, a array<string>, b array<string>")
    refs = spark.createDataFrame([(10, "k1", "s1"), (11, "k1", "s2"), (12, None, "s1"), (13, "k9", None)], "ref int, ka string, kb string")
    tiers = [("A", F.col("a"), F.col("ka")), ("B", F.col("b"), F.col("kb"))]
    m = matching.tiered_match(items, refs, "id", "ref", tiers)
    assert {r["id"]: (r["tier"], r["matched_key"], r["ref_ids"]) for r in m.collect()} == {1: ("A", "k9", [13]), 2: ("B", "s1", [10, 12]), 4: ("B", "s2", [11])}
    assert [r["id"] for r in matching.unmatched(items, m, "id").collect()] == [3]
    hits = {r["id"]: (r["hit_A"], r["hit_B"]) for r in matching.tier_hits(items, refs, "id", tiers).collect()}
    assert hits == {1: (True, True), 2: (False, True), 3: (False, False), 4: (False, True)}


def test_decision_list_and_conflicts(spark):
    df = spark.createDataFrame([(1, 5, "g", "a"), (2, None, "g", "b"), (3, 1, "h", "a"), (4, 1, None, "a")], "id int, x int, grp string, v string")
    d = matching.decision_list([(F.col("x") > 3, ("high", "r1")), (F.col("x") > 0, ("low", "r2"))], ("level", "why"), ("none", "r3"))
    assert [r["d"]["level"] for r in df.orderBy("id").select(d.alias("d")).collect()] == ["high", "none", "low", "low"]
    assert [(r["grp"], r["values"]) for r in matching.conflicts(df, "grp", "v").collect()] == [("g", ["a", "b"])]
    assert {r["id"]: r["v"] for r in matching.override_conflicts(df, "grp", "v", "!").collect()} == {1: "!", 2: "!", 3: "a", 4: "a"}


def by_rounds(sizes, validation=0.1, test=0.1):
    """The allocation as rounds over the strata, one group at a time."""
    total = sum(sizes.values())

    def half_even(x):
        return round(x)

    want = {"validation": half_even(total * validation)}
    want["test"] = total - half_even(total * (1 - validation - test)) - want["validation"]
    out = {s: {"validation": int(n * validation) if n >= 10 else 0, "test": int(n * test) if n >= 10 else 0} for s, n in sizes.items()}
    for split, share in (("validation", validation), ("test", test)):
        while (gap := want[split] - sum(o[split] for o in out.values())) != 0:
            sign = -1 if gap > 0 else 1
            order = sorted(sizes, key=lambda s: (sign * (sizes[s] * share % 1), sign * sizes[s], s))
            moved = False
            for s in order:
                if want[split] == sum(o[split] for o in out.values()):
                    break
                room = sizes[s] - out[s]["validation"] - out[s]["test"] if gap > 0 else out[s][split]
                if room > 0:
                    out[s][split] += 1 if gap > 0 else -1
                    moved = True
            assert moved
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_match_round_robin(spark, seed):
    rng = random.Random(seed)
    sizes = {f"('s{i:02d}')": rng.choice([1, 2, 3, 9, 10, 11, 19, 25, 40]) for i in range(rng.randint(3, 14))}
    groups = spark.createDataFrame([(f"{s}-{k}", s) for s, n in sizes.items() for k in range(n)], "g string, stratum string")
    got = {r["stratum"]: {"validation": r["validation"], "test": r["test"]} for r in group_split.stratum_targets(groups).collect()}
    assert got == by_rounds(sizes)
    assigned = group_split.assign(groups, group_split.stratum_targets(groups), "g")
    assert assigned.count() == sum(sizes.values()) and assigned.where("split = 'test'").count() == sum(v["test"] for v in got.values())
    rows = groups.select("g", F.col("g").alias("item"), F.lit("x").alias("v"))
    assert {r["n_shared"] for r in group_split.leakage(rows, assigned, "g", "item").collect()} == {0}


PC = "CCCC(=O)OCC(COP(=O)([O-])OCC[N+](C)(C)C)OC(=O)CCC"
LPC = "CCCC(=O)OCC(O)COP(=O)([O-])OCC[N+](C)(C)C"


def test_evaluation(spark):
    rows = [(1, "a", "PC", "PC diacyl", PC), (2, "a", "PC", None, PC), (3, "b", "PC", "LPC 4:0", LPC), (4, "c", "SM", None, PC), (5, "d", "PC", None, None), (6, "e", None, None, "bad((")]
    df = spark.createDataFrame(rows, "_ord bigint, sid string, lipid_class string, name string, smiles string")
    e = evaluation.evaluate(evaluation.unique_structures(df, "sid")).cache()
    got = {r["sid"]: r for r in e.collect()}
    assert got["a"]["success"] and got["a"]["linkage_correct"] and got["a"]["n_spectra"] == 2
    assert not got["b"]["success"] and got["b"]["lipid_class"] == "LPC" and got["b"]["chain_count_correct"] is False
    assert got["c"]["eligible"] is False and got["c"]["exact"] is None and got["d"]["exclusion"] == "structure_missing" and got["e"]["parse_status"] == "invalid_input"
    m = {r["class"]: r for r in evaluation.class_metrics(e).collect()}
    assert (m["PC"]["total"], m["PC"]["n_eligible"], m["PC"]["n_success"], m["PC"]["success_rate"]) == (3, 2, 1, 0.5) and m["SM"]["success_rate"] is None
    c = {(r["control_class"], r["sample_status"], r["violation"]) for r in evaluation.negative_controls(e, "sid").collect()}
    assert ("SM", "tested", True) in c and ("CL", "no_sample", False) in c and len(c) == len(rules.CONTROL_CLASSES)
    assert [(r["sid"], r["proposed_class"], r["support"]) for r in evaluation.relabels(e, "sid").collect()] == [("b", "LPC", "A")]
    assert evaluation.linkage_errors(evaluation.linkage_validation(e)).collect()[0]["vinyl_ether_false_positive"] == 0
    bridged = e.where("sid = 'b'").select(evaluation.to_training_headgroup(F.col("lipid_class")).alias("h"), evaluation.to_training_chains(F.col("chains")).alias("c")).first()
    assert bridged["h"] == "PC" and bridged["c"][0]["carbon"] == 4
    assert evaluation.class_metrics(e.where("false")).count() == 0


def test_streams(spark, tmp_path):
    from spectraloom.streaming.arrivals import arrivals_by_window, drop_repeats

    t = lambda h: dt.datetime(2024, 1, 1, h)
    spark.createDataFrame([("a", t(1)), ("a", t(2)), ("b", t(3)), ("b", t(9))], "k string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, at timestamp").parquet(str(tmp_path / "in"))
    for name, df in (("kept", drop_repeats(stream, ["k"], "at", "1 day")), ("counted", arrivals_by_window(stream, "at", "6 hours", ["k"]))):
        mode = "append" if name == "kept" else "update"
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted(r["k"] for r in spark.table("kept").collect()) == ["a", "b"]
    assert sorted((r["k"], r["window_start"].hour, r["n_rows"]) for r in spark.table("counted").collect()) == [("a", 0, 2), ("b", 0, 1), ("b", 6, 1)]
