"""Language-model scoring by a weighted backoff automaton.

The model is a smoothed trigram model of words. Its automaton has an empty state, a state for each word and one for each
bigram that training texts have `least_seen` times or more. An arc leaves a state for each word that was seen after it,
carries the smoothed log-probability, and leads to the longest state that then ends the history. Where a state has no arc
for a word, its failure arc is taken: it carries the weight that the state leaves to what it has not seen, and leads to
the next shorter state. The empty state has an arc for every training word and one for all unknown words together.

With c(..) for training counts, N and V for training tokens and distinct ones, D = 0.75, h a word, gh a bigram, and
K = S / (c + M) for what a state seen c times keeps, per count (S2, M2 of a word's state, S3, M3 of a bigram's):

    empty state:  P(w) = (c(w) - D) / N, and D V / N for unknown words
    state h:      P(w | h) = K c(hw) + (1 - K c(h)) P(w),             failure weight 1 - K c(h)
    state gh:     P(w | gh) = K c(ghw) + (1 - K c(gh)) P(w | h),      failure weight 1 - K c(gh)

The automaton of a large corpus fits nowhere whole, so each shard of documents gets the part that its texts can reach:

1. A shard numbers its words, and asks the hash range (bucket) of each; a bucket adds up what all shards count and answers
   with the words' counts and numbers of their own. Words are compared as such, so no two are taken for one.
2. It asks about its bigrams after words that are states, then about its trigrams after bigrams that are states. What is
   shuffled grows with the corpus; a shard asks once per distinct gram, whatever its documents repeat.
3. From the answers it builds states, arcs and failure arcs, lays them out along its texts, and goes through each text once
   from left to right, carries the state, and adds up log-probabilities.

Bigrams and trigrams are known by 64-bit hashes of the words' numbers.

Nulls: a null text is empty and has the end as its only token. A null doc_id counts as remainder 0, so it is learned from.
Repeated rows have equal scores. A very long text is a shard of its own, split into words piece by piece. Without training
rows all tokens are unknown, with probability 1. Other columns of the input are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import LAST_ID, Numbers, as_bytes, byte_size, give_back, mix, pieces_of, saved, slices, texts_of
from helixframe.llm.repeats import answers, buckets_for, by_bucket, differences, rows_of, squeeze, summed, unsqueeze

#: The end of a text, which is no word.
END = b"\n"
DISCOUNT = 0.75
#: What words' and bigrams' states keep of the probability at most, and how soon.
S2, M2 = 0.3, 5.0
S3, M3 = 0.7, 1.0
LEAST_SEEN = 2


def in_training(ids: np.ndarray, null: np.ndarray, held_remainder: int) -> np.ndarray:
    return np.array([(0 if n else zlib.crc32(str(i).encode()) % 5) != held_remainder for i, n in zip(ids.tolist(), null.tolist(), strict=True)], bool)


class Shard:
    """Documents as numbers of the shard's words, which are in the order of their hashes."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, counts: np.ndarray, word: np.ndarray):
        self.ids, self.null, self.counts, self.word = ids, null, counts, word

    @staticmethod
    def of(ids: list, texts: Iterator[list[bytes]], buckets: int, train: np.ndarray) -> tuple[bytes, list[tuple[int, bytes]]]:
        """The packed shard, and what it asks about its words."""
        numbers = Numbers()
        end = numbers[END]
        rows, counts = [], []
        for some in texts:
            for text in some:
                n = 1
                for piece in pieces_of(text):
                    words = piece.lower().split()
                    rows.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                    n += len(words)
                rows.append(np.array([end]))
                counts.append(n)
        words, word, counts = list(numbers), np.concatenate(rows), np.array(counts, np.int64)
        del numbers, rows
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        word = place[word]
        learned = np.bincount(word[np.repeat(train, counts)], minlength=len(words))
        asks = []
        for b, i, j in by_bucket(hashes[order], buckets):
            asks.append((b, struct.pack("<q", j - i) + zstandard.ZstdCompressor(3).compress(learned[i:j].astype(np.int64).tobytes() + b" ".join(words[k] for k in order[i:j].tolist()))))
        null = np.array([i is None for i in ids], np.int64)
        body = squeeze(np.array([LAST_ID if i is None else i for i in ids], np.int64), null, counts, word)
        return body, asks

    @staticmethod
    def open(body: bytes) -> Shard:
        ids, null, counts, word = unsqueeze(body, np.int64, np.int64, np.int64, np.int64)
        return Shard(ids, null.astype(bool), counts, word.astype(np.int32))


def _count_words(group: pd.DataFrame) -> pd.DataFrame:
    """A bucket's answer to each shard: its words' training counts and numbers; and a row with chunk -1: how many distinct
    words training texts have, and how often."""
    numbers, asked, total = Numbers(), [], np.zeros(0, np.int64)
    for data in group["data"]:
        (n,) = struct.unpack_from("<q", data := bytes(data))
        body = zstandard.ZstdDecompressor().decompress(data[8:])
        own = np.fromiter(map(numbers.__getitem__, body[8 * n :].split(b" ")), np.int64, n)
        total = np.r_[total, np.zeros(max(0, len(numbers) - len(total)), np.int64)]
        total[own] += np.frombuffer(body, np.int64, n)
        asked.append(own)
    # Numbers that do not depend on the order in which the shards came.
    rank = np.empty(len(total), np.int64)
    rank[[numbers[w] for w in sorted(numbers)]] = np.arange(len(total))
    bucket = int(group["bucket"].iloc[0])
    rows = [(c, bucket, squeeze(total[own], rank[own] + (bucket << 40)), 0, 0) for c, own in zip(group["chunk"], asked, strict=True)]
    give_back()
    return pd.DataFrame([*rows, (-1, bucket, None, int((total > 0).sum()), int(total.sum()))], columns=["chunk", "bucket", "data", "v", "n"])


def _count_grams(parts: list[bytes]) -> list[bytes]:
    asked = [(np.cumsum(k, dtype=np.uint64), t) for k, t in (unsqueeze(x, np.uint64, np.int64) for x in parts)]
    return [squeeze(x) for x in summed(asked)]


class Grams:
    """What a shard knows of its grams after so many answers. at2, at3: tokens that end a bigram after a word's state, or
    a trigram after a bigram's; pair, triple: the grams' numbers among the shard's; their keys and counts."""

    def __init__(self, row: dict, held_remainder: int):
        s = self.shard = Shard.open(row["body"])
        self.train = in_training(s.ids, s.null, held_remainder)
        got = [unsqueeze(bytes(x["data"]), np.int64, np.int64) for x in row["words"] or []]
        self.count, number = (np.concatenate([x[k] for x in got] or [np.empty(0, np.int64)]) for k in (0, 1))
        self.number = number.view(np.uint64)
        self.of_train = np.repeat(self.train, s.counts)
        start = np.cumsum(s.counts) - s.counts
        deep = np.full(len(s.word), 2, np.int8)
        deep[start] = 0
        deep[start[s.counts > 1] + 1] = 1
        own = self.count[s.word]
        self.at2 = np.flatnonzero((deep >= 1) & (own > 0) & (np.r_[0, own[:-1]] >= LEAST_SEEN))
        self.keys2, self.pair = np.unique(self._key(self.number[s.word[self.at2 - 1]], self.at2), return_inverse=True)
        if "pairs" not in row:
            return
        self.count2 = self._counts(row["pairs"], len(self.keys2))
        seen = np.zeros(len(s.word), np.int64)
        seen[self.at2] = self.count2[self.pair]
        self.pair_of = np.full(len(s.word), -1, np.int32)
        self.pair_of[self.at2] = self.pair
        self.at3 = np.flatnonzero((deep >= 2) & (seen > 0) & (np.r_[0, seen[:-1]] >= LEAST_SEEN))
        self.keys3, self.triple = np.unique(self._key(self.keys2[self.pair_of[self.at3 - 1]], self.at3), return_inverse=True)
        if "triples" in row:
            self.count3 = self._counts(row["triples"], len(self.keys3))

    def _key(self, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        return mix(mix(before + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93) + self.number[self.shard.word[at]])

    @staticmethod
    def _counts(parts: list[dict] | None, n: int) -> np.ndarray:
        got = np.concatenate([np.empty(0, np.int64), *(unsqueeze(bytes(x["data"]), np.int64)[0] for x in parts or [])])
        assert len(got) == n, "an answer is missing"
        return got

    def asks(self, buckets: int, triples: bool) -> Iterator[tuple[int, bytes]]:
        keys, gram, at = (self.keys3, self.triple, self.at3) if triples else (self.keys2, self.pair, self.at2)
        learned = np.bincount(gram[self.of_train[at]], minlength=len(keys)).astype(np.int64)
        for b, i, j in by_bucket(keys, buckets):
            yield b, squeeze(differences(keys[i:j]), learned[i:j])


def left(count: np.ndarray, share: float, soon: float) -> np.ndarray:
    """The failure weight of states that were seen so often."""
    return 1 - share * count / (count + soon)


class Automaton:
    """The part of the automaton that a shard's tokens can reach: the empty state, those of the shard's words and those of its
    bigrams. Arcs and failure arcs are arrays of logarithms, by the number of the gram or word that they belong to; an arc
    that is missing is 1. An arc's end is the longest state that then ends the history: 2 a bigram's, 1 a word's, 0 the empty."""

    def __init__(self, g: Grams, n: int, v: int):
        self.g, word = g, g.shard.word
        p1 = np.where(g.count > 0, (g.count - DISCOUNT) / n, DISCOUNT * v / n) if n > 0 else np.ones(len(g.count))
        self.is_state = g.count >= LEAST_SEEN
        at = np.zeros(len(g.keys2), np.int64)
        at[g.pair] = g.at2  # a place of each bigram
        h, w = word[at - 1], word[at]
        p2 = S2 * g.count2 / (g.count[h] + M2) + left(g.count[h], S2, M2) * p1[w]
        self.end = np.where(g.count2 >= LEAST_SEEN, 2, self.is_state[w])
        at = np.zeros(len(g.keys3), np.int64)
        at[g.triple] = g.at3
        before, last = g.pair_of[at - 1], g.pair_of[at]
        p3 = S3 * g.count3 / (g.count2[before] + M3) + left(g.count2[before], S3, M3) * p2[last]
        self.empty = np.log10(p1)
        self.arc2, self.arc3 = (np.where(count > 0, np.log10(np.where(count > 0, p, 1)), 1.0) for count, p in ((g.count2, p2), (g.count3, p3)))
        self.fail1, self.fail2 = np.log10(left(g.count, S2, M2)), np.log10(left(g.count2, S3, M3))
        self.triple_of = np.full(len(word), -1, np.int32)
        self.triple_of[g.at3] = g.triple

    def along(self, start: int, end: int) -> list[np.ndarray]:
        """What the tokens [start, end) may meet, in their order: the arc of the bigram's state before a token and its failure arc,
        the same of the word's state, the empty state's arc; where arcs of longer states end, and where the empty state's."""
        g, word = self.g, self.g.shard.word[start:end]
        pair, triple = g.pair_of[start:end], self.triple_of[start:end]
        earlier = g.pair_of[max(start - 1, 0) : end - 1] if start else np.r_[np.int32(-1), g.pair_of[: max(end - 1, 0)]]
        previous = g.shard.word[max(start - 1, 0) : end - 1] if start else np.r_[word[:1], word[:-1]]
        some = lambda values, at, none: np.where(at >= 0, values[at], none) if len(values) else np.full(len(at), none)
        return [some(self.arc3, triple, 1.0), some(self.fail2, earlier, 0.0), some(self.arc2, pair, 1.0), self.fail1[previous], self.empty[word], some(self.end, pair, 0), self.is_state[word].astype(np.int64)]


def traverse(state: int, total: float, met: list[list]) -> tuple[int, float]:
    """Goes through tokens from left to right: the state, and the log10 probability, after them."""
    for arc3, fail2, arc2, fail1, empty, end, home in zip(*met, strict=True):
        if state == 2:
            if arc3 <= 0:
                total += arc3
                state = end
                continue
            total += fail2
            state = 1
        if state:
            if arc2 <= 0:
                total += arc2
                state = end
                continue
            total += fail1
        total += empty
        state = home
    return state, total


def score_shard(g: Grams, n: int, v: int, most: int = 50_000) -> list[float]:
    """The documents' scores. Tokens are looked at so many at a time; a longer document carries its state over."""
    model, ends = Automaton(g, n, v), np.cumsum(g.shard.counts).tolist()
    out: list[float] = []
    state, total, doc = 0, 0.0, 0
    for start in range(0, len(g.shard.word), most):
        end = min(start + most, len(g.shard.word))
        met = [x.tolist() for x in model.along(start, end)]
        at = start
        while at < end:
            to = min(ends[doc], end)
            state, total = traverse(state, total, [x[at - start : to - start] for x in met])
            at = to
            if to == ends[doc]:
                out.append(total)
                state, total, doc = 0, 0.0, doc + 1
    return out


def score_texts(docs: DataFrame, held_remainder: int = 1, shard_bytes: int = 8_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per document."""
    docs = texts_of(docs)
    size = max(64, byte_size(docs))
    buckets = buckets_for(size / 6, 1_000_000)
    message = "chunk long, bucket int, data binary"

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        bytes_held = 0

        def flush() -> pa.RecordBatch:
            ids = [i for part in held for i in part.column("doc_id").to_pylist()]
            train = in_training(np.array([0 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids]), held_remainder)
            body, asks = Shard.of(ids, (as_bytes(part.column("text")) for part in held), buckets, train)
            give_back()
            return pa.RecordBatch.from_arrays([pa.array([number] * (1 + len(asks)), pa.int64()), pa.array([-1, *(b for b, _ in asks)], pa.int32()), pa.array([body, *(x for _, x in asks)], pa.binary())], ["chunk", "bucket", "data"])

        for batch in batches:
            for part in slices(batch, 4_000_000):
                held.append(part)
                bytes_held += part.nbytes
                if bytes_held >= shard_bytes:
                    yield flush()
                    number, held, bytes_held = number + 1, [], 0
        if held:
            yield flush()

    table = saved(docs.mapInArrow(shards, message), "shards", "uncompressed")
    counted = table.where("bucket >= 0").groupBy("bucket").applyInPandas(_count_words, f"{message}, v long, n long")
    counted = saved(counted, "words", "uncompressed")
    v, n = counted.where("chunk = -1").agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    words = counted.where("chunk >= 0").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "data"))).alias("words"))
    known = table.where("bucket = -1").select("chunk", F.col("data").alias("body")).join(words, "chunk", "left")

    for name in ("pairs", "triples"):

        def ask(batches: Iterator[pa.RecordBatch], triples: bool = name == "triples") -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in rows_of(batch):
                    for b, data in Grams(row, held_remainder).asks(buckets, triples):
                        yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), pa.array([b], pa.int32()), pa.array([data], pa.binary())], ["chunk", "bucket", "data"])

        known = known.join(saved(answers(known.mapInArrow(ask, message), _count_grams, name), name, "uncompressed"), "chunk", "left")

    fields = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                g = Grams(row, held_remainder)
                s, seen = g.shard, g.count[g.shard.word]
                doc = np.repeat(np.arange(len(s.ids)), s.counts)
                base = np.bincount(doc, np.log10((seen + 0.5) / (n + 0.5 * (v + 1))), len(s.ids))
                known_tokens = np.bincount(doc, seen > 0, len(s.ids)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.ids, mask=s.null), pa.array(~g.train), pa.array(s.counts), pa.array(known_tokens), pa.array(np.full(len(s.ids), n, np.int64)), pa.array(base), pa.array(score_shard(g, n, v), pa.float64())],
                    [x.split()[0] for x in fields.split(", ")],
                )

    return known.mapInArrow(score, fields)


def op5_language_model(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
