"""Substring dedup with a count-min prefilter.

Windows are 50 words. A chunk of documents makes its own sketch of its windows, by their anchors (repeats.py): `rows` rows
of counters, of which it sends those that are not 0. The chunks' sketches are merged by adding counters up, and a window's
estimate is the least of its counters, which is never too small. So no repeated window is lost, and only windows estimated
to be repeated are grouped exactly, by their words.

A word is removed if a window over it also starts in a document with a smaller doc_id; windows are judged on the input.

Nulls: a null text has no words; a null doc_id sorts after all others. Rows of one doc_id don't remove each other's words,
so repeated rows have equal results. Texts of under 50 words keep everything; very long ones are hashed in pieces and are
a chunk of their own. Other columns of the input are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helixframe.llm.common import Numbers, gram_hash, pieces_of, prefix_hash, word_hashes, word_spans
from helixframe.llm.repeats import Chunk, Scheme, _inner, repeated_tokens

_VALUE = np.random.default_rng(7).integers(1, 2**63, 1 << 16, dtype=np.uint64)


def alike_words(texts: list[bytes], numbers: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, window, group) of the windows of words that the runs hold more than once. Hashes of 128 bits propose groups,
    and every window's words are compared with its group's first."""
    words = Numbers()
    word = np.fromiter(map(words.__getitem__, b"\n".join(texts).split()), np.int64)
    del words
    sizes = numbers + width - 1
    at = np.repeat(np.cumsum(sizes) - sizes, numbers) + _inner(numbers)
    run = np.repeat(np.arange(len(numbers)), numbers)
    value = _VALUE[word & 0xFFFF] + word.astype(np.uint64)
    one, two = (gram_hash(prefix_hash(value, base), width, base)[at] for base in (2, 3))
    order = np.lexsort((at, two, one))
    new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
    group = np.cumsum(new) - 1
    more = np.bincount(group)[group] > 1
    order, group, lead = order[more], group[more], order[new][group[more]]
    span = np.arange(width)
    for i in range(0, len(order), 20_000):
        if not np.array_equal(word[at[order[i : i + 20_000], None] + span], word[at[lead[i : i + 20_000], None] + span]):
            exact = Numbers()
            group = np.array([exact[word[x : x + width].tobytes()] for x in at[order].tolist()])
            break
    window = _inner(numbers)
    return run[order], window[order], group


def scheme(window: int = 50, rows: int = 2) -> Scheme:
    return Scheme(word_hashes, word_spans, window, max(1, window // 2 + 1), True, lambda texts, numbers, shards: alike_words(texts, numbers, window), b"\n", sketch_rows=rows, token_bytes=6.0)


def _finish(chunk: Chunk, removed: np.ndarray) -> pa.RecordBatch:
    at, kept, gone = 0, [], []
    for text, n in zip(chunk.texts, chunk.counts.tolist(), strict=True):
        drop = removed[at : at + n]
        gone.append(int(drop.sum()))
        parts, done = [], 0
        for piece in pieces_of(text):
            words = piece.split()
            stay = ~drop[done : done + len(words)]
            done += len(words)
            if stay.any():
                parts.append(b" ".join(words if stay.all() else compress(words, stay.tolist())))
        kept.append(b" ".join(parts))
        at += n
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk.ids, mask=chunk.null), pa.array(chunk.counts), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([x.decode() for x in kept], pa.string())],
        ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
    )


def dedup_substrings(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept), a row per document; kept: the words that stay, joined by one space."""
    return repeated_tokens(docs, scheme(window), _finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")
