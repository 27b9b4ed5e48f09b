"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, modulo two primes below 2^31, the polynomial hash of every prefix of its code points. Any span's
hash is a difference of two entries, so spans compare in constant time and the longest common extension of two places is
found by binary search. The fingerprint is the hash of the whole text and the least span hashes in 128 classes, of all
spans of 8 code points (of the whole text, if shorter); two fingerprints' likeness is the share of classes in which they
agree, corrected for chance and turned from a share of the union into a share of the text.

Nulls: a null text is empty. A null doc_id sorts last in the descending order. Rows with one doc_id follow each other in
the order of their texts' hashes. Equal texts, empty ones too, have equal fingerprints and likeness 1. One row is its own
next. A very long text is hashed whole. Other columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import mix, saved, texts_of

PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (1_000_003, 998_244_353)
SPAN, CLASSES = 8, 128
_pows: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    """base^0 .. base^(n-1) for both primes."""
    if not _pows or len(_pows[0]) < n:
        size = max(n, 1 << 17)
        _pows[:] = []
        for p, b in zip(PRIMES, BASES, strict=True):
            out = np.ones(size, np.uint64)
            have = 1
            while have < size:
                step = np.uint64(pow(b, have, p))
                more = min(have, size - have)
                out[have : have + more] = out[:more] * step % np.uint64(p)
                have += more
            _pows.append(out)
    return [x[:n] for x in _pows]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Prefixes:
    """The prefix arrays of a text."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.sums = []
        for p, power in zip(PRIMES, _power(self.n + 1), strict=True):
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum((codes + np.uint64(1)) * power[: self.n] % np.uint64(p), out=s[1:])
            self.sums.append(s)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 62-bit hash of each span, alike for equal spans of texts up to `reach` code points."""
        out = np.zeros(len(start), np.uint64)
        for s, p, b in zip(self.sums, PRIMES, BASES, strict=True):
            # The place is taken out by the inverse power, so that spans of different texts compare.
            value = (s[end] - s[start]) % np.uint64(p) * _inverse(self.n + 1, p, b)[start] % np.uint64(p)
            out = (out << np.uint64(31)) | value
        return out

    def whole(self) -> int:
        return int(self.spans(np.array([0]), np.array([self.n]))[0])


_inv: dict[int, np.ndarray] = {}


def _inverse(n: int, p: int, b: int) -> np.ndarray:
    have = _inv.get(p)
    if have is None or len(have) < n:
        size = max(n, 1 << 17)
        have = np.ones(size, np.uint64)
        done, inv = 1, pow(b, -1, p)
        while done < size:
            more = min(done, size - done)
            have[done : done + more] = have[:more] * np.uint64(pow(inv, done, p)) % np.uint64(p)
            done += more
        _inv[p] = have
    return have[:n]


def span_equal(a: Prefixes, i: int, b: Prefixes, j: int, size: int) -> bool:
    """Whether the spans of so many code points from places i and j on are equal: both are brought to one power."""
    for x, y, p, base in zip(a.sums, b.sums, PRIMES, BASES, strict=True):
        one, two = int(x[i + size]) - int(x[i]), int(y[j + size]) - int(y[j])
        if i != j:
            one, two = one * pow(base, j, p), two * pow(base, i, p)
        if (one - two) % p:
            return False
    return True


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """How many code points agree from place i of a and place j of b on, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if span_equal(a, i, b, j, mid) else (low, mid - 1)
    return low


def span_hashes(p: Prefixes, size: int = SPAN) -> np.ndarray:
    size = min(size, p.n)
    at = np.arange(p.n - size + 1)
    return mix(p.spans(at, at + size)) if p.n else np.empty(0, np.uint64)


def sketch(hashes: np.ndarray, classes: int = CLASSES) -> bytes:
    """A byte per class: of the least hash in it; an empty class borrows from the next one that has any."""
    if not len(hashes):
        return bytes(classes)
    shift = np.uint64(64 - (classes.bit_length() - 1))
    ordered = np.sort(hashes)
    bounds = np.arange(classes, dtype=np.uint64) << shift
    at = np.searchsorted(ordered, bounds)
    has = np.r_[at[1:], len(ordered)] > at
    own = np.flatnonzero(has)
    lender = own[np.searchsorted(own, np.arange(classes)) % len(own)]
    distance = (lender - np.arange(classes)) % classes
    value = mix(ordered[at[lender]] + distance.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (value & np.uint64(255)).astype(np.uint8).tobytes()


def fingerprint(whole: int, n: int, sketched: bytes) -> str:
    return f"{n:08x}{whole:016x}{sketched.hex()}"


def likeness(a: str, b: str) -> float:
    """0 to 1: about the share of the texts' spans that are in both."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s[-2 * CLASSES :]), np.uint8) for s in (a, b))
    if not int(a[:8], 16) or not int(b[:8], 16):
        return 0.0
    agree = max(0.0, (float((x == y).mean()) - 1 / 256) / (1 - 1 / 256))
    return 2 * agree / (1 + agree)


class Printed:
    """A text with its prefix arrays, span hashes and fingerprint."""

    def __init__(self, text: str):
        self.text = text
        self.prefixes = Prefixes(points(text))
        self.hashes = span_hashes(self.prefixes)
        self.print = fingerprint(self.prefixes.whole(), self.prefixes.n, sketch(self.hashes))


def print_text(text: str) -> str:
    return Printed(text).print


def edit(own: Printed, after: str) -> tuple[str, str, int]:
    """The fingerprint and SHA-256 of the edited text, and the common extension of both from the start.

    Spans before the edit have the text's own hashes; only spans that reach into it are hashed again."""
    n = own.prefixes.n
    cut = n - n // 3
    edited = own.text[:cut] + after[: n // 3]
    new = Prefixes(points(edited))
    if min(new.n, n) >= SPAN:
        keep = max(0, cut - SPAN + 1)
        at = np.arange(keep, new.n - SPAN + 1)
        hashes = np.concatenate([own.hashes[:keep], mix(new.spans(at, at + SPAN))])
    else:
        hashes = span_hashes(new)
    return fingerprint(new.whole(), new.n, sketch(hashes)), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), common_extension(own.prefixes, 0, new, 0)


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
_KINDS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(), "common_prefix": pa.int64()}


def _row(doc: int | None, own: Printed, after: Printed) -> tuple:
    changed, digest, common = edit(own, after.text)
    return doc, own.prefixes.n, digest, own.print, changed, likeness(own.print, changed), likeness(own.print, after.print), common


def document_fingerprints(docs: DataFrame, range_bytes: int = 16_000_000) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_prefix).

    The documents are range-partitioned and sorted by descending doc_id once, ties by the texts' hashes and then as they
    come, so that rows of one doc_id, or of none, spread over ranges too. A document's next one follows it in its partition.
    A partition keeps its first and last texts, and a last document is compared with the first of the next partition."""
    rows = texts_of(docs).withColumn("text", F.coalesce("text", F.lit("")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // range_bytes + 1)
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("doc_id").desc_nulls_last(), "hash", "row"]
    laid = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    edge = "range long, first_text string, last_id long, last_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[int | None, Printed] | None = None
        first = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for doc, text in zip(*(batch.slice(at, 256).column(i).to_pylist() for i in range(2)), strict=True):
                    now = Printed(text)
                    if before is None:
                        first = text
                    else:
                        out.append((*_row(*before, now), None, None, None, None))
                    before = (doc, now)
                if out:
                    yield _batch(out)
        if before is not None:
            yield _batch([*[(*[None] * len(_KINDS), TaskContext.get().partitionId(), first, before[0], before[1].text)]])

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [*_KINDS.values(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [*_KINDS, *(x.split()[0] for x in edge.split(", "))])

    made = saved(laid.select("doc_id", "text").mapInArrow(run, f"{FIELDS}, {edge}"), "fingerprints")
    edges = made.where("range is not null")
    # One number per partition is sorted in one place; texts are joined to it.
    numbers = edges.select("range")
    after = numbers.withColumn("next", F.lead("range").over(Window.orderBy("range"))).select("range", F.coalesce("next", F.min("range").over(Window.partitionBy())).alias("next"))
    pairs = edges.join(after, "range").join(edges.select(F.col("range").alias("next"), F.col("first_text").alias("next_text")), "next")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_row(doc, Printed(own), Printed(after)) for doc, own, after in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS.values(), strict=True)], [*_KINDS])

    return made.where("range is null").select(*_KINDS).unionByName(pairs.select("last_id", "last_text", "next_text").mapInArrow(close, FIELDS))


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    return document_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
