"""Subject areas of documents by averaged word and subword embeddings with independent logistic outputs.

A document's subjects are those that at least a fifth of its sentences treat, so sentences are
scored. The model is trained on sentences too: a labelled document's labels are shared out among its
sentences, first evenly, then by what the model already knows, so that wrong and missing labels and
sentences about nothing lose their weight.

Documents are parsed once, into blocks of packed numbers (``parse_documents``) that a table in the
shared folder holds. Every training step is one gradient: each partition sums the gradient of its
blocks from the common parameters, the sums are added up, and one update (Adam) is made with the
total. The first steps take all labelled documents, the later ones a slice of all documents each,
so that every document is used once. Scoring reads the same blocks.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.session import written

#: Model size: hashed units x dimensions. These bound what is broadcast and summed in each step (2 MB).
UNITS, DIM = 1 << 15, 16
#: Labelled documents used as such at most: a documented bound of the training sample, drawn by hash
#: of the id. Further ones are used like unlabelled documents.
MOST_LABELLED = 20_000
#: Steps over all labelled documents with evenly shared labels, then with labels by the model, then
#: one step for each slice of all documents. None of them depends on the number of rows.
WARM, ROUNDS, SLICES = 30, 10, 20
RATE = 0.03
#: A label is a sentence's only above this probability, and above so many times the label's share of all sentences.
BAR, LIFT = 0.25, 1.5
#: Words (or documents) after which a block is closed, whole documents always; and partitions in which the
#: gradients of a slice are added up before the driver adds those.
BLOCK_WORDS, FAN = 200_000, 8
SHARE, SURE = 0.2, 0.5

_WORD = re.compile(r"[^\W\d_]+")
_LINE = re.compile(r"\r\n|\r|\n")
_ENDS = re.compile(r"(?<=[.?!…])[\"»”')\]]*\s+(?=\S)")
_SHORT = re.compile(r"\b(?:\d+|e\.g|i\.e|z\.b|d\.h|bzw|ca|nr|no|vs|etc|cf|fig|dr|prof)\.$", re.IGNORECASE)
_CLOSERS = "\"»”')]"


def _is_prose(line: str) -> bool:
    """Whether a line that doesn't end like a sentence is one all the same: enough words, and mostly words."""
    letters = sum(map(len, _WORD.findall(line)))
    real = 0
    count = 0
    for w in line.split():
        if 1 < sum(map(str.isalpha, w)) < 30:
            bare = w.strip(".,;:!?()\"'»«”“").replace("-", "").replace("'", "").replace("’", "")
            if bare.isalpha():
                real += len(w)
                count += 1
    return count >= 4 and letters >= 0.5 * len(line.replace(" ", "")) and real >= 0.5 * letters


def sentence_words(text: str | None) -> list[tuple[str, list[str]]]:
    """The sentences of a whole text with their lower-case words, without headers, footers and dumps of data.

    A footer is everything after a line of hyphens near the end; a header or a row of a dump is a line
    that doesn't end like a sentence and has too few words to be one. A line whose letters are mostly
    no words (keys, formulas, structures) isn't prose. Null, empty and blank texts have no sentences.
    """
    if not text or not text.strip():
        return []
    lines = [x.strip(" \u00a0\t\u200b\ufeff") for x in _LINE.split(text)]
    for i, line in enumerate(lines):
        # a signature block: the rest is short and follows the text
        if line in ("--", "---", "__") and i and sum(1 for x in lines[i + 1 :] if x) <= 4:
            lines = lines[:i]
            break
    out: list[tuple[str, list[str]]] = []

    def add(sentence: str) -> None:
        words = _WORD.findall(sentence.lower())
        if len(words) > 1:
            out.append((sentence, words))

    for line in lines:
        if not line or (line[0] in "{[<" and line[-1] in "}]>") or not _WORD.search(line):
            continue
        if line.rstrip(_CLOSERS)[-1:] not in (".", "?", "!", "…") and not _is_prose(line):
            continue
        parts, pending = _ENDS.split(line), ""
        for k, part in enumerate(parts):
            pending = f"{pending} {part}" if pending else part
            if k + 1 < len(parts) and parts[k + 1][:1].islower() and _SHORT.search(pending):
                continue
            add(pending)
            pending = ""
        if pending:
            add(pending)
    return out


def sentences(text: str | None) -> list[str]:
    """The sentences alone."""
    return [s for s, _ in sentence_words(text)]


@lru_cache(200_000)
def units(word: str) -> list[int]:
    """Hashed units of a lower-case word: itself and its character 5-grams with word ends. A forgotten word is hashed again."""
    marked = f"<{word}>"
    grams = {marked[i : i + 5] for i in range(len(marked) - 4)} if len(word) > 3 else set()
    hashed = [zlib.crc32(f"g {g}".encode()) % UNITS for g in sorted(grams)]
    return [zlib.crc32(f"w {word}".encode()) % UNITS, *hashed]


@dataclass(frozen=True)
class Model:
    """Embeddings, output weights and biases."""

    embed: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    subjects: tuple[int, ...]


def fresh_model(subjects: Sequence[int], seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.3, (UNITS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.3, (DIM, len(subjects))).astype(np.float32)
    return Model(embed, out, np.full(len(subjects), -2.0, np.float32), tuple(subjects))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; every run has at least one row."""
    return np.add.reduceat(values, _starts(sizes), axis=0) if len(sizes) else values[:0]


def _sums_of(values: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values[ids]``, column by column: contiguous and without the table of all runs' rows."""
    starts, out = _starts(sizes), np.empty((values.shape[1], len(sizes)), dtype=values.dtype)
    if len(sizes):
        for k, column in enumerate(np.ascontiguousarray(values.T)):
            out[k] = np.add.reduceat(column.take(ids), starts)
    return out.T


# --- blocks ------------------------------------------------------------------------------------------

BLOCK_SCHEMA = (
    "labelled boolean, slice int, docs array<bigint>, sentences binary, words binary, word_ids binary, "
    "unit_counts binary, unit_ids binary, label_docs binary, label_ids binary"
)
_ARROW = pa.schema(
    [("labelled", pa.bool_()), ("slice", pa.int32()), ("docs", pa.list_(pa.int64()))]
    + [(n, pa.binary()) for n in ("sentences", "words", "word_ids", "unit_counts", "unit_ids", "label_docs", "label_ids")]
)


class Block:
    """Documents as numbers: sentences of each, words of each sentence, units of each distinct word, given labels."""

    def __init__(self, row: dict):
        get = lambda name: np.frombuffer(row[name], dtype=np.int32)
        self.docs = row["docs"]
        self.sentences, self.words, self.word_ids = get("sentences"), get("words"), get("word_ids")
        self.unit_counts, self.unit_ids = get("unit_counts"), get("unit_ids")
        self.label_docs, self.label_ids = get("label_docs"), get("label_ids")
        self.doc_of = np.repeat(np.arange(len(self.docs)), self.sentences)
        self.n_units = _sums(self.unit_counts[self.word_ids], self.words).astype(np.float32)

    def forward(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Averaged embedding and probabilities of each sentence."""
        words = _sums_of(model.embed, self.unit_ids, self.unit_counts)
        hidden = _sums_of(words, self.word_ids, self.words) / self.n_units[:, None]
        return hidden, _sigmoid(hidden @ model.out + model.bias)

    def mean_by_doc(self, p: np.ndarray) -> np.ndarray:
        sums = [np.bincount(self.doc_of, weights=p[:, k], minlength=len(self.docs)) for k in range(p.shape[1])]
        return np.stack(sums, axis=1) / np.maximum(1, self.sentences)[:, None]

    def gradient(self, model: Model, *, warm: bool, labelled: bool, bar: np.ndarray | float = BAR) -> tuple[np.ndarray, np.ndarray, int]:
        """(units, rows of their embeddings' gradient, gradient of outputs and biases and the targets' sum, sentences used)."""
        hidden, p = self.forward(model)
        labels = np.zeros((len(self.docs), len(model.subjects)), np.float32)
        labels[self.label_docs, self.label_ids] = 1
        if not labelled:
            labels = likely_labels(self.mean_by_doc(p))
        own = labels[self.doc_of]
        used = own.any(axis=1)
        goal = targets(p, own, warm, bar)
        error = ((p - goal) * used[:, None]).astype(np.float32)
        top = np.concatenate([hidden.T @ error, error.sum(axis=0, keepdims=True), goal.sum(axis=0, keepdims=True)])
        back = (error @ model.out.T) / self.n_units[:, None]
        # from sentences to distinct words to units; both sums run over sorted runs
        sentence_of = np.repeat(np.arange(len(self.words), dtype=np.int32), self.words)
        narrow = self.word_ids.astype(np.uint16) if len(self.unit_counts) < 1 << 16 else self.word_ids
        order = np.argsort(narrow, kind="stable")
        by_word = _sums_of(back, sentence_of[order], np.bincount(self.word_ids, minlength=len(self.unit_counts)))
        word_of = np.repeat(np.arange(len(self.unit_counts), dtype=np.int32), self.unit_counts)
        order = np.argsort(self.unit_ids.astype(np.uint16), kind="stable")
        hit, sizes = np.unique(self.unit_ids, return_counts=True)
        return hit, _sums_of(by_word, word_of[order], sizes), top, int(used.sum())


class _Packer:
    """One block in the making: words are numbers from the start, so what is held is small."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.docs: list = []
        self.sentences, self.words, self.word_ids, self.label_docs, self.label_ids = (array("i") for _ in range(5))

    def add(self, doc: int | None, found: list[tuple[str, list[str]]], labels: list[int]) -> None:
        known = self.known
        self.sentences.append(len(found))
        for _, words in found:
            self.words.append(len(words))
            self.word_ids.extend([known.setdefault(w, len(known)) for w in words])
        self.label_docs.extend([len(self.docs)] * len(labels))
        self.label_ids.extend(labels)
        self.docs.append(doc)

    def row(self, labelled: bool, part: int) -> dict:
        own = [units(w) for w in self.known]
        packed = {n: getattr(self, n).tobytes() for n in ("sentences", "words", "word_ids", "label_docs", "label_ids")}
        counts, ids = array("i", map(len, own)), array("i", chain.from_iterable(own))
        return {"labelled": labelled, "slice": part, "docs": self.docs, "unit_counts": counts.tobytes(), "unit_ids": ids.tobytes(), **packed}


def parse_documents(documents: DataFrame, labels: DataFrame | None = None, subjects: Sequence[int] = (), *, most_labelled: int = MOST_LABELLED, slices: int = SLICES) -> DataFrame:
    """Blocks of all documents (``BLOCK_SCHEMA``), parsed where they are read: null and empty texts are documents without sentences.

    Labels given twice count once; labels of unknown subjects or documents are left out. The labels
    that go to the tasks are at most ``most_labelled`` documents' (a broadcast of that bound).
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if labels is None:
        rows = rows.withColumn("labels", F.lit(None).cast("array<int>"))
    else:
        known = labels.where("doc_id is not null").where(F.col("subject_id").isin(*subjects) if subjects else F.lit(False))
        given = known.groupBy("doc_id").agg(F.array_sort(F.collect_set("subject_id")).cast("array<int>").alias("labels"))
        chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
        rows = rows.join(F.broadcast(chosen), "doc_id", "left")
    index = {s: i for i, s in enumerate(subjects)}
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Packer] = {}

        def flush(kind: int) -> pa.RecordBatch:
            packer = held.pop(kind)
            # labelled documents go to the first slice together, so that slices don't depend on the partitions
            part = max(kind, 0)
            return pa.RecordBatch.from_pylist([packer.row(kind < 0, part)], schema=_ARROW)

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("doc_id", "text", "labels", "slice")]
            for doc, text, own, part in zip(*columns):
                kind = part if own is None else -1
                packer = held.get(kind) or held.setdefault(kind, _Packer())
                packer.add(doc, sentence_words(text), [index[s] for s in own or ()])
                if len(packer.word_ids) > BLOCK_WORDS or len(packer.docs) > BLOCK_WORDS:
                    yield flush(kind)
        for kind in sorted(held):
            yield flush(kind)

    return rows.mapInArrow(run, BLOCK_SCHEMA)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Block(row)


# --- training ----------------------------------------------------------------------------------------


def targets(p: np.ndarray, labels: np.ndarray, warm: bool, bar: np.ndarray | float = BAR) -> np.ndarray:
    """What each sentence is trained towards, given the scores so far and its document's labels (0/1).

    Warm-up shares a document's labels evenly. After it a sentence goes to its likeliest label, or to a
    subject outside the labels that is much likelier (a missing or wrong label), or to none where even
    the likeliest is unlikely: what stands in documents of all subjects never becomes likely for one.
    Further labels of the document that are sure by themselves are targets of the sentence too.
    """
    n = labels.sum(axis=1, keepdims=True)
    if warm:
        return labels / np.maximum(n, 1)
    inside = np.where(labels > 0, p, -1.0)
    best, best_p = inside.argmax(axis=1), inside.max(axis=1)
    any_, any_p = p.argmax(axis=1), p.max(axis=1)
    chosen = np.where((any_p > 0.6) & (any_p > 2 * best_p), any_, best)
    keep = np.where(chosen == best, best_p > np.broadcast_to(bar, p.shape[1:])[best], True) & (n[:, 0] > 0)
    out = np.zeros_like(p)
    out[np.arange(len(p))[keep], chosen[keep]] = 1.0
    out[inside >= SURE] = 1.0
    return out


def likely_labels(mass: np.ndarray) -> np.ndarray:
    """Labels (0/1) of unlabelled documents from their sentences' mean scores: subjects that carry the document.

    Single sentences of a rare subject may all be unsure; together they point one way.
    """
    most = mass.max(axis=1, keepdims=True, initial=0.0)
    return ((mass >= 0.1) & (mass >= 0.4 * most) & (most >= 0.15)).astype(np.float32)


GRADIENT = "part int, n bigint, units binary, rows binary, top binary"


def _gradients(blocks: DataFrame, model: Model, warm: bool, bar: np.ndarray | float) -> tuple[DataFrame, object]:
    """One row of each partition: the summed gradient of its blocks. The second value is the broadcast model."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, top, n, hit = None, 0.0, 0, np.zeros(UNITS, dtype=bool)
        part = 0
        for batch in batches:
            for row in batch.to_pylist():
                block, part = Block(row), row["part"]
                if not len(block.words):
                    continue
                ids, rows, own, used = block.gradient(shared.value, warm=warm, labelled=row["labelled"], bar=bar)
                total = np.zeros((UNITS, DIM), np.float32) if total is None else total
                total[ids] += rows
                hit[ids] = True
                top, n = top + own, n + used
        if n:
            ids = np.flatnonzero(hit).astype(np.int32)
            yield _gradient_row(part, n, ids, total[ids], top)

    return blocks.withColumn("part", F.spark_partition_id()).mapInArrow(run, GRADIENT), shared


def _gradient_row(part: int, n: int, ids: np.ndarray, rows: np.ndarray, top: np.ndarray) -> pa.RecordBatch:
    data = [[part], [n], [ids.astype(np.int32).tobytes()], [rows.astype(np.float32).tobytes()], [top.astype(np.float32).tobytes()]]
    names = ["part", "n", "units", "rows", "top"]
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(d, t) for d, t in zip(data, types)], names=names)


def _added(rows: Iterable, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(sentences, embedding gradient, top gradient) of gradient rows, added in double precision."""
    n, embed, top = 0, np.zeros((UNITS, DIM)), np.zeros((DIM + 2, width))
    for r in rows:
        n += r["n"]
        embed[np.frombuffer(r["units"], np.int32)] += np.frombuffer(r["rows"], np.float32).reshape(-1, DIM)
        top += np.frombuffer(r["top"], np.float32).reshape(DIM + 2, width)
    return n, embed, top


def _in_groups(gradients: DataFrame, width: int) -> DataFrame:
    """Gradients of any number of partitions added up in ``FAN`` groups, so that the driver gets at most that many."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, embed, top = _added((r for b in batches for r in b.to_pylist()), width)
        if n:
            ids = np.flatnonzero(embed.any(axis=1)).astype(np.int32)
            yield _gradient_row(0, n, ids, embed[ids], top)

    return gradients.repartition(FAN, "part").sortWithinPartitions("part").mapInArrow(add, GRADIENT)


class _Adam:
    """Moments of the parameters; one update a step."""

    def __init__(self, model: Model, rate: float):
        self.p, self.rate, self.step = [model.embed, model.out, model.bias], rate, 0
        self.m = [np.zeros(x.shape) for x in self.p]
        self.v = [np.zeros(x.shape) for x in self.p]

    def update(self, gradient: Sequence[np.ndarray]) -> list[np.ndarray]:
        self.step += 1
        for i, g in enumerate(gradient):
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.99 * self.v[i] + 0.01 * g * g
            m, v = self.m[i] / (1 - 0.9**self.step), self.v[i] / (1 - 0.99**self.step)
            self.p[i] = (self.p[i] - self.rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        return self.p


def train(blocks: DataFrame, subjects: Sequence[int], *, warm: int = WARM, rounds: int = ROUNDS, slices: int = SLICES, rate: float = RATE, bar: float = BAR, lift: float = LIFT) -> Model:
    """The model after ``warm + rounds`` steps over all labelled blocks and one over each slice of all blocks.

    ``blocks`` are those of ``parse_documents`` with the same ``slices``; they are read in every step, so
    they should be a written table. A step's gradient is the sum over all partitions. The labelled
    blocks are bounded, so their sums go straight to the driver; those of a slice are added up in
    ``FAN`` groups first. Without any label the fresh model comes back, which finds nothing.
    """
    model = fresh_model(subjects)
    if not subjects:
        return model
    adam, width, bars = _Adam(model, rate), len(subjects), np.full(len(subjects), bar)
    labelled = blocks.where("labelled")
    plan = [(labelled, k < warm, False) for k in range(warm + rounds)]
    plan += [(blocks.where(F.col("slice") == k), False, True) for k in range(slices)]
    for step, (rows, even, grouped) in enumerate(plan):
        gradients, shared = _gradients(rows, model, even, bars)
        got = (_in_groups(gradients, width) if grouped else gradients).collect()
        shared.destroy()
        n, embed, top = _added(got, width)
        if not n:
            if step == 0:
                return model
            continue
        if even:
            bars = np.maximum(bar, lift * top[DIM + 1] / n)
        model = Model(*adam.update([embed / n, top[:DIM] / n, top[DIM] / n]), tuple(subjects))
    return model


# --- scoring -----------------------------------------------------------------------------------------


def sentence_subjects(model: Model, block: Block, sure: float = SURE) -> np.ndarray:
    """Whether each sentence of a block treats each subject: a sentence may treat several or none."""
    return block.forward(model)[1] >= sure


SCORES = "doc_id bigint, subject_id int, n_treating int, n_sentences int"


def score_blocks(blocks: DataFrame, model: Model, *, sure: float = SURE) -> DataFrame:
    """One row per document and subject that any of its sentences treats: (doc_id, subject_id, n_treating, n_sentences).

    A document in which no sentence treats a subject (null, blank, a mere dump) has one row with a null subject.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("subject_id", pa.int32()), ("n_treating", pa.int32()), ("n_sentences", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.subjects, -1])
        for block in _blocks(batches):
            n = np.zeros((len(block.docs), len(model.subjects) + 1), dtype=np.int64)
            if len(block.words) and model.subjects:
                found = sentence_subjects(model, block, sure)
                for k in range(found.shape[1]):
                    n[:, k] = np.bincount(block.doc_of[found[:, k]], minlength=len(block.docs))
            n[~n.any(axis=1), -1] = 1
            at, subject = np.nonzero(n)
            none = subject == len(model.subjects)
            docs = pa.array(block.docs, pa.int64()).take(pa.array(at))
            counts = np.where(none, 0, n[at, subject])
            columns = [docs, pa.array(names[subject], pa.int32(), mask=none), pa.array(counts, pa.int32()), pa.array(block.sentences[at], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return blocks.mapInArrow(run, SCORES)


def score_documents(documents: DataFrame, model: Model, *, sure: float = SURE) -> DataFrame:
    """``score_blocks`` of documents that are parsed on the way, without a table of blocks."""
    return score_blocks(parse_documents(documents), model, sure=sure)


def written_blocks(documents: DataFrame, labels: DataFrame, subjects: Sequence[int], **options) -> DataFrame:
    """The blocks as a table in the shared folder, by labelled and slice, in files of the advised size whatever the number of tasks."""
    blocks = parse_documents(documents, labels, subjects, **options)
    return written(blocks.hint("rebalance", "labelled", "slice"), "labelled", "slice")
