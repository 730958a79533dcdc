"""Encoding of texts with a public byte-level BPE by batched numpy merge rounds.

The words of many texts stand side by side in one flat array of symbols. In each round every word
finds its lowest-ranked pair (binary search over the sorted pair keys) and merges all its
occurrences; words without a known pair leave the array. A worker remembers the words it has
encoded, so the rounds see each word once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: how a byte-level BPE of this family cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SHIFT = 20
#: Words a worker remembers, and the characters of text or of new words handled at once: bounds of memory only.
REMEMBERED, CHARS = 400_000, 4_000_000


@dataclass(frozen=True)
class Merges:
    """Sorted keys of mergeable pairs with their rank and the merged symbol; the symbol of each byte."""

    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    of_byte: np.ndarray


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in the vocabulary file: bytes that print stand for themselves, the rest follow from U+0100."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def load_merges(path: str = TOKENIZER) -> Merges:
    """The merge table of a vocabulary file (driver side; some 50 000 rows, about a megabyte)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    keys = np.array([(vocab[a] << _SHIFT) | vocab[b] for a, b in pairs], dtype=np.int64)
    merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    return Merges(keys[order], np.arange(len(pairs), dtype=np.int64)[order], merged[order], np.array([vocab[c] for c in _byte_letters()], dtype=np.int64))


def encode_words(words: list[bytes], table: Merges) -> list[np.ndarray]:
    """Symbol ids of each word (without empty words)."""
    out: list[np.ndarray | None] = [None] * len(words)
    if not words:
        return []
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    symbols = table.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(words)), lengths)
    none = np.int64(len(table.keys))
    while len(symbols):
        # rank of the pair that begins at each place
        rank = np.full(len(symbols), none)
        at = np.full(len(symbols), -1, dtype=np.int64)
        if len(symbols) > 1:
            key = (symbols[:-1] << _SHIFT) | symbols[1:]
            place = np.minimum(np.searchsorted(table.keys, key), none - 1)
            known = (table.keys[place] == key) & (owner[:-1] == owner[1:])
            rank[:-1] = np.where(known, table.ranks[place], none)
            at[:-1] = place
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        counts = np.diff(np.r_[starts, len(symbols)])
        least = np.minimum.reduceat(rank, starts)
        done = least == none
        if done.any():
            for s, n, w in zip(starts[done], counts[done], owner[starts[done]]):
                out[w] = symbols[s : s + n].astype(np.int32)
            stay = np.repeat(~done, counts)
            symbols, owner, rank, at, counts, least = symbols[stay], owner[stay], rank[stay], at[stay], counts[~done], least[~done]
            if not len(symbols):
                break
        hit = rank == np.repeat(least, counts)
        # of a run of overlapping pairs ("aaa") every other one from the left merges
        index = np.arange(len(hit))
        run_start = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], index, 0))
        hit &= (index - run_start) % 2 == 0
        where = np.flatnonzero(hit)
        symbols = symbols.copy()
        symbols[where] = table.merged[at[where]]
        keep = np.ones(len(symbols), dtype=bool)
        keep[where + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    return out  # type: ignore[return-value]


class Encoder:
    """Encodes texts, remembering words. Null and empty texts have no ids."""

    def __init__(self, table: Merges):
        self.table = table
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, np.ndarray] = {}

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each."""
        words = [self.pattern.findall(t) if t else [] for t in texts]
        fresh = list({w for ws in words for w in ws if w not in self.known})
        at = 0
        while at < len(fresh):
            end, size = at, 0
            while end < len(fresh) and (end == at or size < CHARS):
                size += len(fresh[end])
                end += 1
            part = fresh[at:end]
            self.known.update(zip(part, encode_words([w.encode("utf-8") for w in part], self.table)))
            at = end
        ids = [self.known[w] for ws in words for w in ws]
        sizes = np.array([sum(len(self.known[w]) for w in ws) for ws in words], dtype=np.int64)
        if len(self.known) > REMEMBERED:
            self.known = {}
        return (np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)), sizes


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_texts(df: DataFrame, key: str, text: str, *, path: str = TOKENIZER, counts_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, ids array<int>), or (key, *keep, n_tokens bigint) with ``counts_only``.

    Every row comes out once, repeated keys too; null and empty texts give an empty list (0 tokens);
    strings of special tokens in a text are ordinary text. No shuffle: texts are encoded where they are read.
    """
    spark = df.sparkSession
    table = spark.sparkContext.broadcast(load_merges(path))
    rows = df.select(F.col(key), *keep, F.col(text).cast("string").alias("__text"))
    last = StructField("n_tokens", LongType(), False) if counts_only else StructField("ids", ArrayType(IntegerType(), False), False)
    schema = StructType([*rows.drop("__text").schema.fields, last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(table.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            head = batch.select(range(batch.num_columns - 1))
            for start, end in _chunks(texts):
                ids, sizes = encoder.encode(texts[start:end])
                if counts_only:
                    last = pa.array(sizes, pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(ids, pa.int32()))
                part = head.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*part.columns, last], names=[*part.schema.names, "n_tokens" if counts_only else "ids"])

    return rows.mapInArrow(run, schema)
