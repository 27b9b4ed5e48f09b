"""Repeated windows of a corpus: the machinery under substring and suffix-array dedup.

A text is a row of tokens (words or bytes), a window is `width` consecutive tokens of one document. Every window has an
anchor, the k-gram with the least hash inside it (the leftmost of equals), so equal windows have equal anchors, and a run
of neighbouring windows shares one. Windows can only repeat where their anchor does. That turns one row per window into
one entry per run:

1. Documents are cut into chunks of one or two megabytes; a chunk keeps its texts, compressed, in the shared folder, and
   asks, for each hash range (bucket), about its anchors, or about the counters of a sketch that they fall in. A bucket
   adds up what all chunks ask and answers each.
2. Where an anchor has more than `hot` distinct runs, its windows get longer keys: first the anchor with half of what
   surrounds it in the window, then the whole window. A level of keys is asked about like the anchors.
3. A chunk sends its runs of repeated keys, with their text, to the keys' buckets, each distinct run once; a bucket finds
   which windows are alike, by their bytes or words, and answers with a bit per window.
4. A chunk marks what the bits say, and drops or keeps its tokens.

Hashes bring windows together; only equal bytes (or words) make them equal. Chunks are bounded, the number of buckets
grows with the corpus, and a chunk asks once however often a key occurs in it.

A row's identity is its place in its chunk, so null or repeated doc_ids never mix texts up. A null doc_id sorts after all.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import LAST_ID, Numbers, as_bytes, byte_size, give_back, gram_hash, mix, prefix_hash, saved, slices, span_hash, texts_of

#: Windows of a piece, and the low bits of a hash that make room for a gram's place in it. All pieces have as many, so that
#: a window's anchor depends on the window alone.
PIECE = 1 << 18
PLACE_BITS = 19


# A chunk: doc_ids (with nulls) and texts.


def pack_chunk(ids: pa.Array, texts: list[bytes]) -> bytes:
    null = np.array(ids.is_null().to_numpy(zero_copy_only=False), np.uint8)
    body = struct.pack("<q", len(texts)) + null.tobytes() + ids.fill_null(LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() + np.array([*map(len, texts)], np.int64).tobytes() + b"".join(texts)
    return zstandard.ZstdCompressor(2).compress(body)


def open_chunk(data: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(is null, doc_ids, texts)"""
    body = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<q", body)
    null = np.frombuffer(body, np.uint8, n, 8).astype(bool)
    ids, sizes = np.frombuffer(body, np.int64, n, 8 + n), np.frombuffer(body, np.int64, n, 8 + 9 * n)
    ends = 8 + 17 * n + np.cumsum(sizes)
    return null, ids, [body[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]


@dataclass
class Runs:
    """Runs of windows with one key: the key, first and last window start, document, hash of the whole run's tokens."""

    anchor: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    whole: np.ndarray  #: for estimates only
    doc_start: np.ndarray  #: of the document, as a token's number in the chunk
    place: np.ndarray  #: where the anchor starts

    def take(self, at: np.ndarray) -> Runs:
        return Runs(*(x[at] for x in self.columns()))

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.anchor, self.first, self.last, self.doc, self.whole, self.doc_start, self.place

    @staticmethod
    def joined(parts: list[Runs]) -> Runs:
        return Runs(*map(np.concatenate, zip(*(x.columns() for x in parts), strict=True)))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def runs_of(values: np.ndarray, counts: np.ndarray, width: int, k: int, whole: bool = True) -> Runs:
    """The runs of all windows of the documents whose tokens' hashes follow each other in values. A very long row of
    tokens is taken in pieces; a run that is cut in two there is two runs with one anchor. Of grams whose hashes agree but
    for the low bits, the leftmost is least, whatever stands around the window. whole: hash whole runs, too."""
    assert PIECE + width < 1 << PLACE_BITS
    doc_of = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    doc_starts = np.cumsum(counts) - counts
    found = []
    for at in range(0, max(1, len(values) - width + 1), PIECE):
        h = values[at : at + PIECE + width - 1]
        n = len(h)
        if n < width:
            break
        d = doc_of[at : at + n]
        g = gram_hash(prefix_hash(h), k)
        low = np.uint64((1 << PLACE_BITS) - 1)
        place = sliding_min((g & ~low) | np.arange(len(g), dtype=np.uint64), width - k + 1) & low
        starts = np.flatnonzero(d[: n - width + 1] == d[width - 1 :])
        if not len(starts):
            continue
        place = place[starts].astype(np.int64)
        turn = np.flatnonzero(np.diff(place)) + 1
        new, end = np.r_[0, turn], np.r_[turn, len(starts)] - 1
        first, last = starts[new], starts[end]
        hashed = span_hash(prefix_hash(h, 1), first, last + width, 1) if whole else np.zeros(len(first), np.uint64)
        # Least hashes are small; mixed once more they spread over the buckets evenly.
        anchor = mix(g[place[new]] + np.uint64(0x9E3779B97F4A7C15))
        found.append(Runs(anchor, first + at, last + at, d[first], hashed, doc_starts[d[first]], place[new] + at))
    none = np.empty(0, np.int64)
    return Runs.joined(found) if found else Runs(none.view(np.uint64), none, none, none, none.view(np.uint64), none, none)


def longer_keys(runs: Runs, values: np.ndarray, width: int, k: int, level: int, whole: bool = True) -> Runs:
    """The runs cut up by longer keys. Level 1: windows with the anchor in their second half share what is before it, the
    others what is after it, half of the rest of a window. Level 2: a window is its own key."""
    if level == 1:
        half = (width - k) // 2
        cut = runs.place - half
        early, late = np.flatnonzero(runs.first <= cut), np.flatnonzero(runs.last > cut)
        a, b = runs.take(early), runs.take(late)
        a.last, b.first = np.minimum(a.last, cut[early]), np.maximum(b.first, cut[late] + 1)
        out = Runs.joined([a, b])
        start = np.r_[a.place - half, b.place]
        end = np.r_[a.place + k, b.place - half + 1 + width]
        salt = np.repeat(np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64), [len(early), len(late)])
    else:
        number = runs.last - runs.first + 1
        out = runs.take(np.repeat(np.arange(len(number)), number))
        out.first = out.last = out.first + _inner(number)
        start, end, salt = out.first, out.first + width, np.uint64(0x165667B19E3779F9)
    out.anchor = mix(span_hash(prefix_hash(values, 2), start, end, 2) + salt)
    if whole:
        out.whole = span_hash(prefix_hash(values, 1), out.first, out.last + width, 1)
    return out


def buckets_for(n: float, each: float, least: int = 16) -> int:
    """A power of two, as many buckets as hold n entries at about so many each."""
    return max(least, 1 << max(0, int(np.ceil(np.log2(max(1.0, n / each))))))


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) of the buckets, by the leading bits, that have any of the sorted keys."""
    if len(keys):
        own = (keys >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64) if buckets > 1 else np.zeros(len(keys), np.int64)
        begin = np.r_[0, np.flatnonzero(np.diff(own)) + 1]
        yield from zip(own[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)], strict=True)


@dataclass
class Scheme:
    """tokens(texts): the tokens' hashes and how many each text has. spans(data): where each token starts and ends in the
    bytes. across: only repeats in other documents count, of which the one with the least doc_id is kept; else the first
    occurrence at all. alike(texts, numbers, shards): (run, window, group) of the windows of some runs that are in the
    runs more than once; equal windows, and no others, have equal groups."""

    tokens: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    spans: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
    width: int
    k: int
    across: bool
    alike: Callable[[list[bytes], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    between: bytes = b""  #: documents, where their tokens are looked up
    sketch_rows: int = 0  #: of a count-min sketch; 0: keys are counted themselves
    sketch_load: float = 0.25  #: keys to a counter
    token_bytes: float = 1.0
    hot: int = 20_000
    chunk_bytes: int = 2_000_000
    bucket_bytes: int = 16_000_000  #: of text, to a bucket that compares
    piece_bytes: int = 4_000_000  #: of runs that are compared at once, but for a key's


LEVELS = 3


def text_ties(texts: list[bytes]) -> np.ndarray:
    """Hashes as Spark's xxhash64 gives them for a string."""
    return np.array([xxhash.xxh64_intdigest(x, 42) for x in texts], np.uint64)


def _ask(runs: Runs, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, and of each the number of distinct runs; 2 at least if it is repeated in the chunk (across: in another document)."""
    if not len(runs.anchor):
        return runs.anchor, np.empty(0, np.int64)
    order = np.lexsort((runs.whole, runs.anchor))
    a, w = runs.anchor[order], runs.whole[order]
    at = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    distinct = 1 + np.add.reduceat(np.r_[False, (a[1:] == a[:-1]) & (w[1:] != w[:-1])], at, dtype=np.int64)
    if across:
        most, least = np.maximum.reduceat(runs.doc[order], at), np.minimum.reduceat(runs.doc[order], at)
        several = most > least
    else:
        several = np.diff(np.r_[at, len(a)]) > 1
    return a[at], np.where(several, np.maximum(distinct, 2), 1)


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counters of keys in a row of the sketch, as numbers of 64 bits of which the leading `bits` count."""
    low = np.uint64(64 - bits)
    return mix(keys + np.uint64(0x9E3779B97F4A7C15 * (row + 1) % 2**64)) >> low << low


def counters(keys: np.ndarray, times: np.ndarray, rows: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A chunk's own sketch, row by row: the counters that are not 0, and what they hold."""
    if not rows:
        return [(keys, times)]
    out = []
    for row in range(rows):
        own, inverse = np.unique(cells(keys, row, bits), return_inverse=True)
        out.append((own, np.bincount(inverse, times, len(own)).astype(np.int64)))
    return out


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
    give_back()


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of 64 bits, byte plane by byte plane, which compress."""
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(1).compress(struct.pack(f"<{len(arrays)}q", *map(len, arrays)) + b"".join(planes))


def unsqueeze(data: bytes, *kinds) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 8 * len(kinds)
    for n, kind in zip(struct.unpack_from(f"<{len(kinds)}q", body), kinds, strict=True):
        out.append(np.frombuffer(body, np.uint8, 8 * n, at).reshape(8, n).T.copy().view(kind).ravel())
        at += 8 * n
    return out


def differences(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def _asks(runs: Runs, scheme: Scheme, buckets: int, bits: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, message) about the keys of some runs. Rows of the sketch have their own buckets."""
    keys, times = _ask(runs, scheme.across)
    for row, (own, held) in enumerate(counters(keys, times, scheme.sketch_rows, bits)):
        for b, i, j in by_bucket(own, buckets):
            yield row * buckets + b, squeeze(differences(own[i:j]), held[i:j])


def _chunks(docs: DataFrame, scheme: Scheme, buckets: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, scheme.chunk_bytes):
                texts = as_bytes(part.column("text"))
                values, counts = scheme.tokens(texts)
                asks = list(_asks(runs_of(values, counts, scheme.width, scheme.k), scheme, buckets, bits))
                columns = [pa.array([number] * (1 + len(asks)), pa.int64()), pa.array([-1, *(b for b, _ in asks)], pa.int32()), pa.array([None, *(x for _, x in asks)], pa.binary()), pa.array([pack_chunk(part.column("doc_id"), texts)] + [None] * len(asks), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "bucket", "data", "body"])
                number += 1

    return docs.mapInArrow(run, "chunk long, bucket int, data binary, body binary")


def answers(asks: DataFrame, answer: Callable[[list[bytes]], list[bytes]], name: str = "parts") -> DataFrame:
    """(chunk, parts): what the buckets answer to a chunk, bucket by bucket."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        made = pd.DataFrame({"chunk": group["chunk"], "bucket": group["bucket"], "data": answer([bytes(x) for x in group["data"]])})
        give_back()
        return made

    got = asks.groupBy("bucket").applyInPandas(run, "chunk long, bucket int, data binary")
    return got.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "data"))).alias(name))


def summed(asked: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Counters of the same keys, or cells, added up, for each asker."""
    known, inverse = np.unique(np.concatenate([k for k, _ in asked]), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([t for _, t in asked]), len(known)).astype(np.int64)
    return np.split(total[inverse], np.cumsum([len(k) for k, _ in asked])[:-1])


def _count_answer(parts: list[bytes], hot: int) -> list[bytes]:
    """A code per key or counter: 0 alone, 1 repeated, 2 hot."""
    asked = [(np.cumsum(k, dtype=np.uint64), t) for k, t in (unsqueeze(x, np.uint64, np.int64) for x in parts)]
    return [((n >= 2).astype(np.uint8) + (n > hot)).tobytes() for n in summed(asked)]


class Chunk:
    """A chunk with its runs and what the answers say about their keys, level by level. pending: the runs that the next
    level has to ask about, if it asks; else runs: those whose keys are repeated."""

    def __init__(self, scheme: Scheme, row: dict, bits: int, asks: bool = False):
        self.scheme = scheme
        self.null, self.ids, self.texts = open_chunk(row["body"])
        self.values, self.counts = scheme.tokens(self.texts)
        runs, known = runs_of(self.values, self.counts, scheme.width, scheme.k, False), []
        for level in range(LEVELS):
            if level and not len(runs.anchor):
                break
            if level:
                runs = longer_keys(runs, self.values, scheme.width, scheme.k, level, asks)
            if f"parts{level}" not in row:
                break
            keys, inverse = np.unique(runs.anchor, return_inverse=True)
            code = self._codes(keys, row[f"parts{level}"] or [], bits)[inverse]
            known.append(runs.take(np.flatnonzero(code == 1)))
            runs = runs.take(np.flatnonzero(code == 2))
        self.pending = runs
        if not asks:
            self.ties, self.runs = text_ties(self.texts), Runs.joined(known)
            self._lead()

    def _codes(self, keys: np.ndarray, parts: list[dict], bits: int) -> np.ndarray:
        """The code of each key: the least of its counters."""
        got = np.frombuffer(b"".join(bytes(x["data"]) for x in parts), np.uint8)
        least, at = np.full(len(keys), 2, np.uint8), 0
        if not self.scheme.sketch_rows:
            assert len(got) == len(keys), "an answer is missing"
            return got
        for row in range(self.scheme.sketch_rows):
            cell = cells(keys, row, bits)
            own, inverse = np.unique(cell, return_inverse=True)
            least = np.minimum(least, got[at : at + len(own)][inverse])
            at += len(own)
        assert at == len(got), "an answer is missing"
        return least

    def _lead(self) -> None:
        """lead: of each distinct run the one to send, in the order of keys; lead_of: for each run, the number of its lead;
        same: whether the run is at its lead's place, so that the lead's bits hold for it. Others repeat the lead."""
        runs, across = self.runs, self.scheme.across
        start = runs.first - runs.doc_start
        whole = self.scheme.between.join(self.texts)
        data = np.frombuffer(whole, np.uint8)
        begins, ends = self.scheme.spans(data)
        cut = list(zip(begins[runs.first].tolist(), ends[runs.last + self.scheme.width - 1].tolist(), strict=True)) if len(start) else []
        numbers = Numbers()
        text = np.fromiter((numbers[whole[a:b]] for a, b in cut), np.int64, len(cut))
        order = np.lexsort((start, self.ties[runs.doc], self.ids[runs.doc], text, runs.anchor))
        a, b = runs.anchor[order], text[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(order) else np.empty(0, bool)
        lead = self.lead = order[new]
        self.lead_of = np.empty(len(order), np.int64)
        self.lead_of[order] = np.cumsum(new) - 1
        to = lead[self.lead_of] if len(order) else self.lead_of
        self.same = self.ids[runs.doc] == self.ids[runs.doc[to]]
        if not across:
            self.same &= (self.ties[runs.doc] == self.ties[runs.doc[to]]) & (start == start[to])
        self.lead_texts = [whole[slice(*cut[i])] for i in lead.tolist()]

    def sends(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        runs = self.runs.take(self.lead)
        number = runs.last - runs.first + 1
        for b, i, j in by_bucket(runs.anchor, buckets):
            own = slice(i, j)
            texts = self.lead_texts[own]
            head = [runs.anchor[own], self.ids[runs.doc[own]], self.ties[runs.doc[own]], (runs.first - runs.doc_start)[own], number[own], np.array([*map(len, texts)])]
            yield b, zstandard.ZstdCompressor(1).compress(struct.pack("<q", len(texts)) + b"".join(x.astype(np.uint64 if x.dtype == np.uint64 else np.int64).tobytes() for x in head) + b"".join(texts))

    def removed(self, parts: list[dict] | None) -> np.ndarray:
        """For each token of the chunk, whether a window that repeats covers it."""
        runs, lead = self.runs, self.lead
        number = (runs.last - runs.first + 1)[lead] if len(lead) else np.empty(0, np.int64)
        bits = np.concatenate([np.unpackbits(np.frombuffer(bytes(x["data"])[8:], np.uint8), count=struct.unpack("<q", bytes(x["data"])[:8])[0]) for x in parts]) if parts else np.empty(0, np.uint8)
        assert len(bits) == number.sum(), "an answer is missing"
        offset = np.r_[0, np.cumsum(number)]
        change = np.zeros(len(self.values) + 1, np.int64)
        alike = np.flatnonzero(self.same)
        count = (runs.last - runs.first + 1)[alike]
        inner = _inner(count)
        flagged = bits[np.repeat(offset[self.lead_of[alike]], count) + inner].astype(bool)
        starts = (np.repeat(runs.first[alike], count) + inner)[flagged]
        np.add.at(change, starts, 1)
        np.add.at(change, starts + self.scheme.width, -1)
        other = np.flatnonzero(~self.same)
        np.add.at(change, runs.first[other], 1)
        np.add.at(change, runs.last[other] + self.scheme.width, -1)
        return np.cumsum(change[:-1]) > 0


def _inner(number: np.ndarray) -> np.ndarray:
    """0, 1, .. for each of the numbers, one after the other."""
    return np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)


def open_sent(data: bytes) -> dict:
    body = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<q", body)
    names = ("anchor", "id", "tie", "start", "number", "size")
    kinds = (np.uint64, np.int64, np.uint64, np.int64, np.int64, np.int64)
    out: dict = {name: np.frombuffer(body, kind, n, 8 + 8 * n * i) for i, (name, kind) in enumerate(zip(names, kinds, strict=True))}
    ends = 8 + 48 * n + np.cumsum(out["size"])
    return out | {"texts": [body[e - s : e] for e, s in zip(ends.tolist(), out["size"].tolist(), strict=True)]}


def compare_runs(sent: list[dict], scheme: Scheme) -> list[np.ndarray]:
    """A bit for each window that also starts earlier (across: in a document with a smaller id), for each sender's runs."""
    cat = {k: np.concatenate([x[k] for x in sent]) for k in ("anchor", "id", "tie", "start", "number", "size")}
    texts = [t for x in sent for t in x["texts"]]
    sender = np.repeat(np.arange(len(sent)), [len(x["texts"]) for x in sent])
    when = [cat["id"]] if scheme.across else [cat["id"], cat["tie"], cat["start"]]
    first_bit = np.cumsum(cat["number"]) - cat["number"]
    bits = np.zeros(cat["number"].sum(), np.uint8)
    # Equal runs: the earliest stands for all.
    numbers = Numbers()
    text = np.fromiter(map(numbers.__getitem__, texts), np.int64, len(texts))
    del numbers
    order = np.lexsort((*reversed(when), text, cat["anchor"]))
    new = np.r_[True, (text[order][1:] != text[order][:-1]) | (cat["anchor"][order][1:] != cat["anchor"][order][:-1])]
    lead = order[new]
    lead_of = lead[np.cumsum(new) - 1]
    twin = np.ones(len(order), bool)
    for x in when:
        twin &= x[order] == x[lead_of]
    late = order[~twin]
    bits[np.repeat(first_bit[late], cat["number"][late]) + _inner(cat["number"][late])] = 1
    # Keys with several runs, some keys at a time.
    a = cat["anchor"][lead]
    fresh = np.r_[True, a[1:] != a[:-1]]
    each = np.diff(np.r_[np.flatnonzero(fresh), len(a)])
    several = lead[(each > 1)[np.cumsum(fresh) - 1]]
    a, total = cat["anchor"][several], np.cumsum(cat["size"][several])
    last_of = np.r_[np.flatnonzero(a[1:] != a[:-1]) + 1, len(a)] if len(a) else np.empty(0, np.int64)
    at = 0
    while at < len(a):
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + scheme.piece_bytes, "right"))
        end = int(last_of[min(np.searchsorted(last_of, max(end, at + 1)), len(last_of) - 1)])
        own = several[at:end]
        own = own[np.argsort(sender[own], kind="stable")]
        at = end
        run, window, group = scheme.alike([texts[i] for i in own.tolist()], cat["number"][own], sender[own])
        if not len(run):
            continue
        run = own[run]
        keys = [x[run] for x in when]
        if not scheme.across:
            keys[2] = keys[2] + window
        by = np.lexsort((*reversed(keys), group))
        start = np.r_[True, group[by][1:] != group[by][:-1]]
        lead_at = by[start][np.cumsum(start) - 1]
        after = np.zeros(len(by), bool)
        for x in keys:
            after |= x[by] != x[lead_at]
        bits[(first_bit[run] + window)[by][after]] = 1
    # Twins have their lead's bits.
    same = order[twin & (order != lead_of)]
    to = lead_of[twin & (order != lead_of)]
    bits[np.repeat(first_bit[same], cat["number"][same]) + _inner(cat["number"][same])] = bits[np.repeat(first_bit[to], cat["number"][to]) + _inner(cat["number"][to])]
    return np.split(bits, np.cumsum([x["number"].sum() for x in sent])[:-1])


def repeated_tokens(docs: DataFrame, scheme: Scheme, finish: Callable[[Chunk, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """finish(chunk, removed) makes a record batch of each chunk, a row per document."""
    docs = texts_of(docs)
    size = byte_size(docs)
    keys = size / scheme.token_bytes * 2.2 / (scheme.width - scheme.k + 2)
    bits = min(60, max(8, int(np.ceil(np.log2(max(1.0, keys / scheme.sketch_load))))))
    ask_buckets = buckets_for(keys, 1_000_000)
    send_buckets = buckets_for(size, scheme.bucket_bytes)
    table = saved(_chunks(docs, scheme, ask_buckets, bits), "chunks", "uncompressed")
    known, asks = table.where("bucket = -1").select("chunk", "body"), table.where("bucket >= 0").select("chunk", "bucket", "data")

    def chunk_rows(make: Callable[[Chunk], Iterator[tuple[int, bytes]]], asks: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in rows_of(batch):
                    for b, data in make(Chunk(scheme, row, bits, asks)):
                        yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), pa.array([b], pa.int32()), pa.array([data], pa.binary())], ["chunk", "bucket", "data"])

        return known.mapInArrow(run, "chunk long, bucket int, data binary")

    # What buckets answer compresses so well that its files look small enough to be sent to all by way of the driver, which would
    # hold it unpacked; so the joins are told to sort.
    for level in range(LEVELS):
        hot = scheme.hot if level < LEVELS - 1 else 2**62
        got = saved(answers(asks, lambda parts, hot=hot: _count_answer(parts, hot), f"parts{level}"), "answers")
        known = known.join(got.hint("merge"), "chunk", "left")
        if not got.where(F.exists(f"parts{level}", lambda x: F.contains(x["data"], F.lit(b"\x02")))).limit(1).count():
            break
        asks = chunk_rows(lambda c: _asks(c.pending, scheme, ask_buckets, bits), True)

    def compare(parts: list[bytes]) -> list[bytes]:
        return [struct.pack("<q", len(x)) + np.packbits(x).tobytes() for x in compare_runs([open_sent(x) for x in parts], scheme)]

    second = saved(answers(chunk_rows(lambda c: c.sends(send_buckets), False), compare, "bits"), "bits")

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                c = Chunk(scheme, row, bits)
                yield finish(c, c.removed(row["bits"]))

    return known.join(second.hint("merge"), "chunk", "left").mapInArrow(end, schema)
