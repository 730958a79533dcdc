"""A sentence counts for every subject that is sure by itself."""

import numpy as np

from spectraloom.llm.subjects import DIM, UNITS, Model, score_documents, targets, units


def test_a_sentence_of_two_subjects(spark):
    embed = np.zeros((UNITS, DIM), np.float32)
    for k, word in enumerate(("pump", "yolk")):
        embed[units(word), k] = 40.0
    out = np.zeros((DIM, 3), np.float32)
    out[[0, 1], [0, 1]] = 1.0
    model = Model(embed, out, np.full(3, -2.0), (1, 2, 3))
    d = spark.createDataFrame([(1, "The pump and the yolk."), (2, "The pump leaked."), (3, "Thanks to all.")], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["subject_id"] or 0, r["n_treating"]) for r in score_documents(d, model).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 0, 0)]


def test_several_targets():
    assert targets(np.array([[0.8, 0.7, 0.6], [0.8, 0.3, 0.1]]), np.array([[1.0, 1.0, 0.0]] * 2), False).tolist() == [[1, 1, 0], [1, 0, 0]]
