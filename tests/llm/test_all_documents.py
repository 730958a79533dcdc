"""Training rounds with unlabelled documents run over all of them."""

import numpy as np
from pyspark.sql import functions as F

from spectraloom.llm.subjects import fresh_model, train, units, written_blocks


def test_no_unlabelled_document_is_left_out(spark):
    # the last of 10 200 documents in the order of their ids' hashes has a word of its own
    ids = spark.range(300, 10_500).withColumnRenamed("id", "doc_id")
    last = ids.orderBy(F.xxhash64("doc_id").desc()).first()[0]
    text = lambda i: "The pump leaked at the ferrule." if i % 2 else "The sourdough browned too fast."
    docs = [(i, text(i)) for i in range(10_500) if i != last] + [(last, text(last)[:-1] + " zyxwvutz.")]
    labels = spark.createDataFrame([(i, 1 if i % 2 else 2) for i in range(300)], "doc_id bigint, subject_id int")
    model = train(written_blocks(spark.createDataFrame(docs, "doc_id bigint, text string"), labels, [1, 2], slices=4), [1, 2], warm=8, slices=4)
    own = units("zyxwvutz")
    assert not np.array_equal(model.embed[own[0]], fresh_model([1, 2]).embed[own[0]])
