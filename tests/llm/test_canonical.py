import random

import pytest

from spectraloom.llm.canonical import ClassMatcher, InstrumentMatcher, NameMatcher, Trie, bound, distinct_values, match_candidates, match_values


def osa(a, b):
    """Distance with adjacent swaps, by the whole table."""
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        d[i][0] = i
    for j in range(len(b) + 1):
        d[0][j] = j
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_trie_finds_all_within_the_bound():
    rng = random.Random(2)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(3, 9))) for _ in range(120)}
    words = sorted(words)
    trie = Trie((w, i) for i, w in enumerate(words))
    for _ in range(150):
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(2, 10)))
        for limit in (0, 1, 2):
            want = sorted((osa(text, w), i) for i, w in enumerate(words) if osa(text, w) <= limit)
            assert trie.search(text, limit) == want, (text, limit)


def test_rigid_characters():
    trie = Trie([("orbis480", 1), ("impulsoHD", 2)])
    assert trie.search("orbis481", 2) == [] and trie.search("orbs480", 1) == [(1, 1)] and trie.search("orbis4800", 2) == [] and trie.search("impulsoii", 3) == [] and trie.search("impuslohd", 1) == [(1, 2)]


INSTRUMENTS = [(1, "Orbis 480, Halden", "Halden"), (2, "Orbis 480 Plus, Halden", "Halden"), (3, "Synaq G2, Tessmark", "Tessmark"), (4, "Synaq G2-S, Tessmark", "Tessmark"), (5, "Impulso II, Oriquell", "Oriquell"), (6, "Impulso HD, Oriquell", "Oriquell")]


@pytest.mark.parametrize(
    "text, entry",
    [("ORBIS 480 (Halden)", 1), ("Orbis-480, Halden Scientific", 1), ("halden  orbis 480 plus", 2), ("Orbis 480+ by Halden Instruments", 2), ("SynaqG2-S Tessmark", 4), ("Synaq G2", 3), ("Tessmark - Synaq - G2 (serial 7615)", 3), ("Aquila UPLC; Orbis 480, Halden", 1),
     ("Impluso II", 5), ("Impulso XX", 0), ("Orbis 620, Halden", 0), ("Orbis 480, Tessmark", 0), ("unknown", 0), ("", 0), ("Orbis", 0), ("Orbiss 480, Haldne", 1)],
)
def test_instruments(text, entry):
    assert InstrumentMatcher(INSTRUMENTS).lookup(text)[0] == entry


CLASSES = [(1, "PC", "phosphatidylcholine", ["GPCho", "glycerophosphocholine"]), (2, "PE", "phosphatidylethanolamine", ["GPEtn"]), (3, "LPC", "lysophosphatidylcholine", ["LysoPC", "monoacyl-GPCho"]), (4, "PIP", "phosphatidylinositol phosphate", None)]


@pytest.mark.parametrize(
    "text, entry",
    [(" PC\t", 1), ("P.C.", 1), ("gpcho", 1), ("phosphatidyl choline", 1), ("PHOSPHATDIYLCHOLINE", 1), ("PC (phosphatidylcholine)", 1), ("PE (phosphatidylcholine)", 0), ("LysoPC", 3), ("monoacyl-GPCho", 3), ("lysophosphatidylcholin", 3), ("TAG", 0), ("PC?", 0), ("", 0), ("PB", 0)],
)
def test_classes(text, entry):
    assert ClassMatcher(CLASSES).lookup(text)[0] == entry


NAMES = [
    (1, "1-palmitoyl-2-oleoyl-sn-glycero-3-phosphocholine", "PC(16:0/18:1)", ["PC(16:0_18:1)", "phosphatidylcholine 16:0-18:1"]), (2, "1-palmitoyl-2-linoleoyl-sn-glycero-3-phosphocholine", "PC(16:0/18:2)", None),
    (3, "1-oleoyl-2-hydroxy-sn-glycero-3-phosphoethanolamine", "LPE(18:1)", []), (4, "1-stearoyl-2-palmitoyl-sn-glycero-3-phosphate", "PA(18:0/16:0)", None), (5, "1-palmitoyl-2-stearoyl-sn-glycero-3-phosphate", "PA(16:0/18:0)", None),
]


@pytest.mark.parametrize(
    "text, entry",
    [("1-PALMITOYL-2-OLEOYL-SN-GLYCERO-3-PHOSPHOCHOLINE", 1), ("1 palmitoyl 2 oleoyl sn glycero 3 phosphocholine", 1), ("1-palmitoyl-2-oleoyl-glycero-3-phosphocholine", 1), ("1-pallmitoyl-2-oleoyl-sn-glycero-3-phosphocholnie", 1), ("pc (16:0, 18:1)", 1), ("PC 18:1_16:0", 1), ("GPCho[16:0/18:1]", 1),
     ("16:0-18:1 PC", 1), ("1-palmitoyl-2-oleoyl-sn-glycero-3-phosphocholine; lot 90", 1), ("1-palmitoyl-2-oleoyl-sn-glycero-3-phosphocholine  [in MeOH]", 1), ("PC 34:1", 0), ("PC(34:1)", 0), ("LysoPE[18:1]", 3), ("LPE (18:1/0:0)", 3), ("18:1 Lyso PE", 3),
     ("1-palmitoyl-2-stearoyl-sn-glycero-3-phosphocholine", 0), ("PA 16:0_18:0", 0), ("PA(16:0/18:0)", 5), ("blank", 0), ("?", 0), ("1-palmitoyl-2-linoleoyl-sn-glycero-3-phosphocholine", 2), ("​PC(16:0/18:2)", 2), ("PC(16:0/18:3)", 0)],
)
def test_names(text, entry):
    assert NameMatcher(NAMES).lookup(text)[0] == entry


def test_bound_grows():
    assert [bound(n) for n in (3, 6, 9, 10, 40)] == [0, 1, 1, 2, 2]


def test_rows(spark):
    rows = [(1, "PC", "x"), (2, " pc ", "y"), (3, None, None), (4, "what", "z"), (4, "what", "z")]
    df = spark.createDataFrame(rows, "row_id bigint, lipid_class string, field string")
    out = match_values(df, "row_id", {"lipid_class": (ClassMatcher, CLASSES)})
    assert sorted((r["row_id"], r["typed"], r["ref_id"]) for r in out.collect()) == [(1, "PC", 1), (2, " pc ", 1), (4, "what", 0), (4, "what", 0)]
    assert match_values(df.where("false"), "row_id", {"lipid_class": (ClassMatcher, CLASSES)}).count() == 0


def test_candidates_within_the_bound(spark):
    names = NameMatcher([(1, "1-stearoyl-glycerol", None, None), (2, "1-stearoxl-glycerol", None, None), (3, "2-stearoyl-glycerol", None, None)])
    assert names.candidates("1-stearoyl-glycerol") == [(0, 1)] and names.candidates("1-stearoil-glycerol") == [(1, 1), (1, 2)] and names.lookup("1-stearoil-glycerol") == (0, -1, 2)
    df = spark.createDataFrame([(1, "PHOSPHATDIYLCHOLINE"), (2, "PHOSPHATDIYLCHOLINE"), (3, "TAG"), (4, None)], "row_id bigint, lipid_class string")
    values = distinct_values(df, "row_id", ["lipid_class"])
    assert sorted((r["typed"], r["n_rows"]) for r in values.collect()) == [("PHOSPHATDIYLCHOLINE", 2), ("TAG", 1)]
    got = match_candidates(values, {"lipid_class": (ClassMatcher, CLASSES)}).collect()
    assert [tuple(r) for r in got] == [("lipid_class", "PHOSPHATDIYLCHOLINE", 1, 1)]
