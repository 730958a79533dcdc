"""Registered training-data queries do the whole job."""

import pytest

from spectraloom.llm import queries as q
from spectraloom.llm.canonical import NameMatcher
from spectraloom.session import table


def test_every_column_survives(spark, sf_dir):
    pilot = table(spark, sf_dir, "experimental_ms2_pilot")
    got = q.p3_survivors(spark, sf_dir).cache()
    assert set(got.columns) == {"measurement_id", "n_rows", "n_sources"} | set(pilot.columns) - {"row_id"}
    # a measurement of one row is that row
    alone = got.where("n_rows = 1").join(pilot.select("row_id", *[pilot[c].alias(f"own_{c}") for c in ("chains", "num_peaks", "source_file", "retrieved_at")]), got["measurement_id"] == pilot["row_id"])
    assert alone.count() > 0
    assert alone.where("not (chains <=> own_chains and num_peaks <=> own_num_peaks and source_file <=> own_source_file and retrieved_at <=> own_retrieved_at)").count() == 0
    # no group with chains in a row comes out without
    n = pilot.where("size(chains) > 0").count()
    assert n == 0 or got.where("size(chains) > 0").count() > 0


NAMES = [
    (1, "1-palmitoyl-2-oleoyl-sn-glycero-3-phosphocholine", "PC(16:0/18:1)", None), (2, "1-oleoyl-2-hydroxy-sn-glycero-3-phosphoethanolamine", "LPE(18:1)", None), (3, "1-stearoyl-2-palmitoyl-sn-glycero-3-phosphate", "PA(18:0/16:0)", None),
    (4, "1-palmitoyl-2-stearoyl-sn-glycero-3-phosphate", "PA(16:0/18:0)", None),
]


@pytest.mark.parametrize(
    "text, found",
    [("phosphatidylcholne 16:0/18:1", (1, 1, 1)), ("GPChoo[16:0/18:1]", (1, 1, 1)), ("16:0/18:1 Phosphatidylchoilne", (1, 1, 1)), ("lysophosphatidylethanolamin 18:1", (2, 1, 1)), ("phosphatidylethanolamin 18:1/0:0", (2, 1, 1)), ("lysso PE 18:1", (2, 1, 1)),
     ("phosphatidic acd 18:0/16:0", (3, 1, 1)), ("phosphatidicaccid 18:0/16:0", (3, 1, 1)), ("phosphatidicaccid 18:0_16:0", (0, -1, 2)), ("phosphatidylcholne 18:1/16:0", (0, -1, 0)), ("phosphatidylcholne 18:1_16:0", (1, 1, 1)), ("phosphatidylcholne 16:0/18:2", (0, -1, 0)),
     ("phosphatidylcholne 16:0/118:1", (0, -1, 0)), ("phosphatidylcholine-d7 16:0/18:1", (0, -1, 0)), ("phosphatidylcholine-O 16:0/18:1", (0, -1, 0)), ("phosphatidylserine 16:0/18:1", (0, -1, 0)), ("lysoPC 18:1", (0, -1, 0)), ("PD 16:0/18:1", (0, -1, 0)), ("PC(16:0/18:1)", (1, 0, 1))],
)
def test_misspelt_class_words_in_shorthand(text, found):
    assert NameMatcher(NAMES).lookup(text) == found
