"""Suffix-array dedup by merging Burrows-Wheeler transforms.

Byte strings of 100 that occur before are removed. Anchors (repeats.py) bring all places of a repeated string to one
bucket, as runs: pieces of text of at most 168 bytes. Equal runs are one to begin with. The others form shards, one for
each chunk of the corpus that sent some; a shard's suffixes are sorted once, which gives its Burrows-Wheeler transform.
All shards are merged by interleave refinement: a pass sends each place of the interleave to the bucket of the symbol
before it, which sorts the interleave by one symbol more, without comparing suffixes again. A boundary that appears
between two places in pass p says that their common prefix has p - 1 symbols; places whose common prefix is the whole
window are the repeated intervals.

A symbol is a gram of `gram` bytes (25, so that four passes make 100; any divisor of the width will do), and a text is the
strings of grams that begin at its first bytes, so that every byte still begins one suffix. Grams are numbered by their
bytes' hashes, and the bytes of an interval are compared at the end.

A byte is removed if a string over it also starts earlier (smaller doc_id, or same document and earlier start); strings are
judged on the input. Of documents with one doc_id, the texts' hashes make the order.

Nulls: a null text is empty; a null doc_id sorts after all others. Rows of equal doc_id and text are one document, so
repeated rows have equal results. Texts of under 100 bytes keep everything; very long ones are a chunk of their own. Other
columns of the input are not read, or kept as they are. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import BYTE_VALUE, LAST_ID, Numbers, gram_hash, prefix_hash, saved, whole_row
from helixframe.llm.repeats import Chunk, Scheme, _inner, repeated_tokens


def byte_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_VALUE[np.frombuffer(b"".join(texts), np.uint8)], np.array([*map(len, texts)], np.int64)


def byte_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(len(data) + 1)
    return at[:-1], at[1:]


class Symbols:
    """The suffixes of a set of strings (data cut at `sizes`), over grams of q bytes. Suffix s of string c is at
    c's offset + c + its position; there is one at the end of each of the q strings of grams, the empty one."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, q: int):
        self.q = q
        offset = np.cumsum(sizes) - sizes
        n = int(sizes.sum() + len(sizes))
        self.string = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.place = _inner(sizes + 1)
        self.byte = np.repeat(offset, sizes + 1) + self.place
        grams = gram_hash(prefix_hash(BYTE_VALUE[data], 1), q, 1)
        full = self.place <= (sizes - q)[self.string]
        self.symbol = np.zeros(n, np.int32)
        _, rank = np.unique(grams[self.byte[full]], return_inverse=True)
        self.symbol[full] = rank + 1
        self.before = np.zeros(n, np.int32)
        inner = np.flatnonzero(self.place >= q)
        self.before[inner] = self.symbol[inner - q]

    def nth(self, k: int) -> np.ndarray:
        """The k-th symbol of each suffix, 0 past its end."""
        s = self.symbol
        for _ in range(k):
            at = np.minimum(np.arange(len(s)) + self.q * (_ + 1), len(s) - 1)
            s = np.where(s > 0, self.symbol[at], 0)
        return s


def sorted_by(key: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """A stable order by numbers from 0 on, of what is in some order already: 16 bits at a time, which numpy sorts by digits."""
    for shift in (0, 16) if key.max(initial=0) > 0xFFFF else (0,):
        digits = (key >> shift).astype(np.uint16)
        order = np.argsort(digits, kind="stable") if order is None else order[np.argsort(digits[order], kind="stable")]
    return order


def shard_orders(symbols: Symbols, bounds: list[int], depth: int) -> list[np.ndarray]:
    """The suffixes from each bound to the next, a shard's, sorted by their first `depth` symbols."""
    order = None
    for k in reversed(range(depth)):
        order = sorted_by(symbols.nth(k), order)
    shard = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return np.split(sorted_by(shard, order), bounds[1:-1])


def merge_shards(symbols: Symbols, orders: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, common): all suffixes in the order of their first `depth` symbols, and how many symbols each has in common
    with the one before it, `depth` at most; found by refining the interleave of the shards' transforms."""
    sizes = [*map(len, orders)]
    transforms = symbols.before[np.concatenate(orders)]
    shard = np.repeat(np.arange(len(orders)), sizes)
    block = np.zeros(len(shard), np.int64)
    common = np.full(len(shard), depth)
    common[:1] = 0
    for done in range(depth):
        # Each shard's transform is read from its begin to its end, in the order in which the interleave takes from it.
        comes = np.empty(len(shard), np.int32)
        comes[sorted_by(shard)] = transforms
        to = sorted_by(comes)
        shard, symbol, block = shard[to], comes[to], block[to]
        # An end of a string is alike no other symbol, nor another end as far as what follows is concerned.
        cut = (symbol[1:] != symbol[:-1]) | ((block[1:] != block[:-1]) & (symbol[1:] > 0))
        common[1:][cut] = np.minimum(common[1:][cut], done)
        block = np.r_[0, np.cumsum(cut)]
    suffixes = np.empty(len(shard), np.int64)
    suffixes[sorted_by(shard)] = np.concatenate(orders)
    return suffixes, common


def repeated_windows(data: np.ndarray, sizes: np.ndarray, shards: np.ndarray, width: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, place, group) of the windows that occur more than once in the strings, which are in the order of their
    shards; equal windows have equal groups."""
    symbols = Symbols(data, sizes, q)
    depth = width // q
    where = np.r_[0, np.cumsum(sizes + 1)]
    bounds = where[np.r_[0, np.flatnonzero(np.diff(shards)) + 1, len(shards)]].tolist()
    suffixes, common = merge_shards(symbols, shard_orders(symbols, bounds, depth), depth)
    group = np.cumsum(common < depth)
    long = symbols.place[suffixes] + width <= sizes[symbols.string[suffixes]]
    suffixes, group = suffixes[long], group[long]
    _, group, times = np.unique(group, return_inverse=True, return_counts=True)
    more = times[group] > 1
    suffixes, group = suffixes[more], group[more]
    if len(suffixes):  # the intervals' bytes
        start = symbols.byte[suffixes]
        first = np.r_[True, group[1:] != group[:-1]]
        lead = start[np.flatnonzero(first)[np.cumsum(first) - 1]]
        windows = np.lib.stride_tricks.sliding_window_view(data, width)
        for at in range(0, len(start), 50_000):
            if not np.array_equal(windows[start[at : at + 50_000]], windows[lead[at : at + 50_000]]):
                strings = Numbers()
                group = np.array([strings[data[x : x + width].tobytes()] for x in start.tolist()])
                break
    return symbols.string[suffixes], symbols.place[suffixes], group


def scheme(width: int = 100, q: int = 25, k: int = 32) -> Scheme:
    def alike(texts: list[bytes], numbers: np.ndarray, shards: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return repeated_windows(np.frombuffer(b"".join(texts), np.uint8), numbers + (width - 1), shards, width, q)

    return Scheme(byte_tokens, byte_spans, width, k, False, alike, hot=2_000, chunk_bytes=1_000_000, bucket_bytes=8_000_000, piece_bytes=250_000)  # so many runs fill a piece


def _finish(chunk: Chunk, removed: np.ndarray) -> pa.RecordBatch:
    ends = np.cumsum(chunk.counts)
    data = np.frombuffer(b"".join(chunk.texts), np.uint8)
    gone, spans, kept = [], [], []
    for text, a, b in zip(chunk.texts, (ends - chunk.counts).tolist(), ends.tolist(), strict=True):
        drop = removed[a:b]
        n = int(drop.sum())
        gone.append(n)
        spans.append(int((drop[1:] & ~drop[:-1]).sum()) + int(drop[0]) if n else 0)
        kept.append(data[a:b][~drop].tobytes() if n else text)
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk.ids, mask=chunk.null), pa.array(chunk.counts), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([hashlib.sha256(x).hexdigest() if n else None for x, n in zip(chunk.texts, gone, strict=True)], pa.string()), pa.array(kept, pa.binary()), pa.array([x.decode("utf-8", "ignore") if n else None for x, n in zip(kept, gone, strict=True)], pa.string())],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text_sha256", "kept", "kept_text"],
    )


def dedup_bytes(docs: DataFrame, width: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text_sha256, kept, kept_text), a row per document. kept: the bytes that
    stay, which need not be UTF-8; text_sha256 of the text, and kept_text, the whole characters of kept, are null where
    nothing was removed."""
    return repeated_tokens(docs, scheme(width, width // 4 if width % 4 == 0 else width), _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text_sha256 string, kept binary, kept_text string")


def without_repeats(docs: DataFrame, width: int = 100) -> DataFrame:
    """docs with the repeated bytes cut out of the texts; what a cut leaves of a broken character goes too."""
    cut = dedup_bytes(docs, width).where("n_removed > 0").select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), F.col("text_sha256").alias("sha"), F.col("kept_text").alias("cut"))
    cut = saved(cut, "cut").dropDuplicates(["id", "sha"])
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.sha2(F.col("text").cast("string").cast("binary"), 256).alias("sha"), whole_row(docs).alias("row"))
    out = rows.join(cut.hint("merge"), ["id", "sha"], "left")  # texts alike look small on disk, but not to a driver
    was = F.col("cut").isNotNull()
    new = {"text": F.when(was, F.col("cut")).otherwise(F.col("row.text")).cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(was, F.length("cut")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
