import random

import numpy as np

from spectraloom.llm.subjects import DIM, Block, fresh_model, parse_documents, score_documents, sentences, train, written_blocks

THINGS = {1: ["the pump", "the detector", "a gradient line", "the ion source"], 2: ["the sourdough", "an egg yolk", "smoked herring", "the oat porridge"], 3: ["the licence clause", "a consent form", "the sublicence", "the statute"]}
DOES = {1: ["leaked at the ferrule", "lost transmission", "drifted by ppm"], 2: ["browned too fast", "tasted rancid", "was whisked slowly"], 3: ["forbids redistribution", "was contested in court", "binds every user"]}
FILLER = ["That is all for now.", "We may come back to it.", "Thanks to all."]


def sentence(rng, k):
    return f"{rng.choice(THINGS[k])} {rng.choice(DOES[k])}".capitalize() + "."


def document(rng, mix):
    body = [sentence(rng, k) for k, n in mix.items() for _ in range(n)] + rng.sample(FILLER, rng.randint(0, 1))
    rng.shuffle(body)
    text = " ".join(body)
    if rng.random() < 0.3:
        text = f"Note {rng.randrange(999)}\n{text}"
    if rng.random() < 0.3:
        text += "\n--\nThe statute forbids redistribution of this licence clause."
    if rng.random() < 0.2:
        text += '\n{"rows": 5, "tags": ["PE", null]}'
    return text


def test_sentences():
    text = "Note 12\nOn day 4, it leaked. Was it so?  Es war am 16. vermerkt worden.\n\n1.5\t2.5\n3.5\t4.5\nCCCC(=O)OCC\n{\"a\": 1}\n--\nSent from the lab."
    assert sentences(text) == ["On day 4, it leaked.", "Was it so?", "Es war am 16. vermerkt worden."]
    assert sentences(None) == [] and sentences("  \n") == [] and sentences("1.5\t2\n") == [] and sentences("One line without an end but with words") == ["One line without an end but with words"]


def test_held_out_documents(spark):
    rng = random.Random(8)
    docs, labels, truth = [], [], {}
    for i in range(400):
        ks = rng.sample([1, 2, 3], rng.choice([1, 1, 1, 2]))
        docs.append((i, document(rng, {k: rng.randint(3, 5) for k in ks})))
        truth[i] = set(ks)
        if i < 150:
            given = ks if rng.random() > 0.1 else [rng.choice([1, 2, 3])]
            labels += [(i, k) for k in given] * rng.choice([1, 1, 2])
    docs += [(900, None), (901, ""), (902, "1.5\t2.5\n"), (903, "That is all for now.")]
    labels += [(7, 99), (None, 1), (12345, 2)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = train(written_blocks(d, spark.createDataFrame(labels, "doc_id bigint, subject_id int"), [1, 2, 3]), [1, 2, 3])
    rows = score_documents(d, model).collect()
    got = {}
    for r in rows:
        if r["subject_id"] is not None and r["n_treating"] * 5 >= r["n_sentences"]:
            got.setdefault(r["doc_id"], set()).add(r["subject_id"])
    right = sum(got.get(i, set()) == truth[i] for i in range(150, 400))
    assert right >= 237, right
    assert {r["doc_id"] for r in rows} == {i for i, _ in docs} and not {900, 901, 902} & got.keys()


def test_without_labels_nothing_is_found(spark):
    d = spark.createDataFrame([(1, "It leaked at once. It did.")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, subject_id int")
    model = train(written_blocks(d, none, [1, 2]), [1, 2])
    assert score_documents(d, model).where("subject_id is not null").count() == 0
    assert score_documents(d.where("false"), train(written_blocks(d, none, []), [])).count() == 0
    assert train(parse_documents(d.where("false"), none, [1, 2]), [1, 2]).subjects == (1, 2)


def test_gradient_is_that_of_the_loss(spark):
    d = spark.createDataFrame([(1, "The pump leaked. It was the old pump."), (2, "An egg yolk browned.")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 2)], "doc_id bigint, subject_id int")
    (row,) = parse_documents(d.coalesce(1), labels, [1, 2], slices=1).collect()
    block, model = Block(row.asDict()), fresh_model([1, 2])
    goal = np.zeros((3, 2))
    goal[[0, 1, 2], [0, 0, 1]] = 1

    def loss():
        p = block.forward(model)[1]
        return -(goal * np.log(p) + (1 - goal) * np.log(1 - p)).sum()

    units, rows, top, n = block.gradient(model, warm=True, labelled=True, bar=0.25)
    assert n == 3
    for array, at, found in ((model.embed, (int(units[3]), 5), rows[3, 5]), (model.out, (2, 1), top[2, 1]), (model.bias, (0,), top[DIM, 0])):
        old, step = array[at], 1e-2
        array[at] = old + step
        up = loss()
        array[at] = old - step
        down = loss()
        array[at] = old
        assert abs((up - down) / (2 * step) - found) < 2e-3


def test_a_step_is_one_gradient_however_many_partitions(spark):
    rng = random.Random(3)
    docs = [(i, document(rng, {i % 3 + 1: 4})) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 3 + 1) for i in range(60)], "doc_id bigint, subject_id int")
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    one, many = (train(parse_documents(d.repartition(n, "doc_id"), labels, [1, 2, 3], slices=2), [1, 2, 3], warm=3, rounds=1, slices=2) for n in (1, 5))
    assert np.abs(one.embed - many.embed).max() < 1e-2 and np.abs(one.out - many.out).max() < 1e-2
