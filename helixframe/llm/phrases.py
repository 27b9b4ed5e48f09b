"""Collocations: phrases of two to five words that are more frequent than their parts let expect, per language.

1. Texts are cut into chunks; a chunk numbers its words and keeps its texts as those numbers, with a break wherever a piece
   ends. It asks hash ranges (buckets) how frequent its words are in its language, each word once; one that is not frequent
   becomes a break, too, as no candidate can contain it.
2. A chunk asks the buckets about its phrases of two frequent words, and then about those of three to five words of which every
   two neighbours passed. A bucket adds up all chunks' counts by leading bits of hashes, which never undercounts, and says
   which may be frequent. So candidates are Apriori-safe, and only phrases that occur are ever looked at.
3. Distinct candidates go to blocks of about `block_phrases`; a task builds a double-array trie of each block. A few blocks at
   a time are broadcast. In every chunk numpy moves the states of all positions on by a word at once, level by level, and
   counts the accepting states; Spark adds up the chunks. These counts are exact: tries compare words, not hashes.
4. Cuts, scores and ranks are DataFrame functions, in decimals of 38 digits.

What is broadcast is bounded by the parameter, however many candidates there are; more blocks take more passes. A word that
all texts have is one entry per chunk in a shuffle. The driver holds `at_once` blocks at a time.

Nulls: a null text is empty; a null lang is "und". doc_id and other columns are not read. Repeated rows count as often as they
come. Equal scores are ranked by count, then by the phrase's bytes, so there are no ties. A very long text is a chunk of its
own. An empty table gives an empty one.
"""

from __future__ import annotations

import pickle
import struct
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import Numbers, as_bytes, byte_size, give_back, mix, saved, slices
from helixframe.llm.repeats import answers, buckets_for, by_bucket, differences, rows_of, squeeze, summed, unsqueeze

#: Lower case; what ends a piece becomes a full stop, which is in no word then; tabs become spaces.
PIECES = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
CHUNK_BYTES = 8_000_000
LONGEST = 5


def _packed(*arrays: np.ndarray) -> bytes:
    """Numbers below 2^32, byte plane by byte plane, which compress."""
    planes = [np.ascontiguousarray(x, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes() for x in arrays]
    return struct.pack(f"<{len(arrays)}q", *map(len, arrays)) + zstandard.ZstdCompressor(3).compress(b"".join(planes))


def _opened(data: bytes, arrays: int = 1) -> list[np.ndarray]:
    body, out, at = zstandard.ZstdDecompressor().decompress(data[8 * arrays :]), [], 0
    for n in struct.unpack_from(f"<{arrays}q", data):
        out.append(np.frombuffer(body, np.uint8, 4 * n, at).reshape(4, n).T.copy().view(np.int32).ravel())
        at += 4 * n
    return out


def by_frequency(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, order): numbers from 1 to n by how often they occur, which take fewer bytes; order[new - 1] is the old number."""
    order = np.argsort(-np.bincount(codes, minlength=n + 1)[1:], kind="stable").astype(np.int32) + 1
    new = np.zeros(n + 1, np.int32)
    new[order] = np.arange(1, n + 1)
    return new[codes], order


def _sent(words: list[bytes], times: np.ndarray) -> bytes:
    return struct.pack("<qq", len(words), len(times)) + zstandard.ZstdCompressor(3).compress(times.astype(np.int64).tobytes() + b" ".join(words))


def _received(data: bytes) -> tuple[list[bytes], np.ndarray]:
    n, m = struct.unpack_from("<qq", data)
    body = zstandard.ZstdDecompressor().decompress(data[16:])
    return body[8 * m :].split(b" ") if n else [], np.frombuffer(body, np.int64, m)


def _chunks(docs: DataFrame, buckets: int) -> DataFrame:
    """(chunk, lang, bucket, data, n): with bucket -1 the texts of a chunk as numbers of its words, 0 where a piece ends, and how
    many words there are; else what the chunk asks about its words. Words are numbered in the order of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, CHUNK_BYTES):
                by: dict[str, list[bytes]] = defaultdict(list)
                for lang, text in zip(part.column("lang").to_pylist(), as_bytes(part.column("text")), strict=True):
                    by[lang].append(text)
                for lang, texts in sorted(by.items()):
                    numbers = Numbers()
                    numbers[b"."]  # noqa: B018  is number 0
                    tokens = b".".join(texts).translate(PIECES).replace(b".", b" . ").split()
                    codes = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
                    words = list(numbers)[1:]
                    del tokens, numbers
                    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
                    order = np.argsort(hashes, kind="stable")
                    place = np.zeros(len(words) + 1, np.int32)
                    place[1 + order] = np.arange(1, len(words) + 1)
                    codes = place[codes]
                    times = np.bincount(codes, minlength=len(words) + 1)[1:]
                    sent = [(b, _sent([words[k] for k in order[i:j].tolist()], times[i:j])) for b, i, j in by_bucket(hashes[order], buckets)]
                    n = len(sent)
                    columns = [pa.array([chunk] * (1 + n), pa.int64()), pa.array([lang] * (1 + n), pa.string()), pa.array([-1, *(b for b, _ in sent)], pa.int32()), pa.array([_packed(*by_frequency(codes, len(words))), *(x for _, x in sent)], pa.binary()), pa.array([int(times.sum())] + [0] * n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["chunk", "lang", "bucket", "data", "n"])
                    chunk += 1

    return saved(docs.mapInArrow(run, "chunk long, lang string, bucket int, data binary, n long"), "words", "uncompressed")


def _frequent(table: DataFrame, least: int) -> DataFrame:
    """(chunk, lang, bucket, data): the buckets' answers, a flag for each word of a chunk's question and the frequent ones; and,
    with chunk -1, all frequent words of a bucket and language with their counts."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        total: dict[str, Counter] = defaultdict(Counter)
        asked = []
        for lang, data in zip(group["lang"], group["data"], strict=True):
            words, times = _received(bytes(data))
            total[lang].update(dict(zip(words, times.tolist(), strict=True)))
            asked.append(words)
        bucket, rows = int(group["bucket"].iloc[0]), []
        for chunk, lang, words in zip(group["chunk"], group["lang"], asked, strict=True):
            own = total[lang]
            flags = np.fromiter((own[w] >= least for w in words), np.uint8, len(words))
            rows.append((chunk, lang, bucket, _sent([w for w, f in zip(words, flags.tolist(), strict=True) if f], flags)))
        for lang, own in total.items():
            found = sorted((w, n) for w, n in own.items() if n >= least)
            if found:
                rows.append((-1, lang, bucket, _sent([w for w, _ in found], np.array([n for _, n in found]))))
        give_back()
        return pd.DataFrame(rows, columns=["chunk", "lang", "bucket", "data"])

    return saved(table.where("bucket >= 0").groupBy("bucket").applyInPandas(run, "chunk long, lang string, bucket int, data binary"), "frequent")


def _words_of(answers_: DataFrame) -> DataFrame:
    """(lang, part, f) of the frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                words, times = _received(row["data"])
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(times)], ["lang", "part", "f"])

    return answers_.where("chunk = -1").mapInArrow(run, "lang string, part string, f long")


def _encoded(table: DataFrame, answered: DataFrame) -> DataFrame:
    """(chunk, lang, words, body): the chunks' frequent words, joined by spaces, and their texts as those words' numbers from 1
    on, 0 for breaks, one between any two words that are not neighbours."""
    own = answered.where("chunk >= 0").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "data"))).alias("parts"))
    bodies = table.where("bucket = -1").select("chunk", "lang", "data").join(own, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                codes, order = _opened(row["data"], 2)
                parts = [_received(x["data"]) for x in row["parts"]]
                words, flag = [w for own, _ in parts for w in own], np.concatenate([x for _, x in parts])
                kept = order[flag[order - 1] > 0]  # the frequent ones, in the order of the chunk's numbers
                place = np.cumsum(flag > 0)[kept - 1] - 1
                new = np.zeros(len(flag) + 1, np.int32)
                new[1:][flag[order - 1] > 0] = np.arange(1, len(kept) + 1)
                codes = new[codes]
                codes = codes[(codes > 0) | np.r_[True, codes[:-1] > 0]]
                words = [words[k] for k in place.tolist()]
                if len(words):
                    yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), pa.array([row["lang"]]), pa.array([b" ".join(words)], pa.binary()), pa.array([_packed(codes)], pa.binary())], ["chunk", "lang", "words", "body"])

    return saved(bodies.mapInArrow(run, "chunk long, lang string, words binary, body binary"), "encoded")


class Candidates:
    """The phrases of a chunk that may be frequent, as far as answers go: first those of two words, then all longer ones whose
    every two neighbours passed. keys: the counters of the phrases without an answer, leading bits of their hashes, sorted, and
    what they count; found: (length, starts, hashes) of those that passed."""

    def __init__(self, row: dict, bits: int):
        self.words = row["words"].split(b" ")
        self.codes = _opened(row["body"])[0]
        self.low, self.found = np.uint64(64 - bits), []
        salt = np.uint64(xxhash.xxh3_64_intdigest(row["lang"].encode()))
        word = np.r_[np.uint64(0), np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))][self.codes]
        at = np.flatnonzero(self.codes)
        levels = [(2, *self._longer(at, mix(word[at] + salt), word, 2))]
        if not self._passed(levels, row, "pairs"):
            return
        levels, (_, at, key) = [], self.found[0]
        for k in range(3, LONGEST + 1):
            at, key = self._longer(at, key, word, k)
            levels.append((k, at, key))
        self._passed(levels, row, "longer")

    @staticmethod
    def _longer(at: np.ndarray, key: np.ndarray, word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of k words, both of whose parts of k - 1 words are there."""
        both = np.flatnonzero(np.diff(at) == 1)
        return at[both], mix(key[both] * np.uint64(0x9E3779B97F4A7C15) + word[at[both] + k - 1])

    def _passed(self, levels: list, row: dict, name: str) -> bool:
        counters = np.concatenate([key for _, _, key in levels]) >> self.low << self.low
        self.keys, inverse, self.times = np.unique(counters, return_inverse=True, return_counts=True)
        if name not in row:
            return False
        passed = np.frombuffer(b"".join(bytes(x["data"]) for x in row[name] or []), np.uint8).astype(bool)
        assert len(passed) == len(self.keys), "an answer is missing"
        for (k, at, key), keep in zip(levels, np.split(passed[inverse], np.cumsum([len(x) for _, x, _ in levels])[:-1]), strict=True):
            self.found.append((k, at[keep], key[keep]))
        return True

    def phrases(self) -> list[bytes]:
        """Each phrase once. Phrases that share a hash, though they differ, must not stand in for one another."""
        out: set[bytes] = set()
        for k, starts, key in self.found:
            _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            own = self.codes[starts[:, None] + np.arange(k)]
            other = (own != own[first[inverse]]).any(1)
            for codes in own[np.r_[first, np.flatnonzero(other)]].tolist():
                out.add(b" ".join([self.words[c - 1] for c in codes]))
        return sorted(out)


def candidates(encoded: DataFrame, least: int, tokens: int) -> DataFrame:
    """(lang, phrase), each once: all phrases of two to LONGEST words that occur `least` times or more, and few others. Of the
    hashes so many bits count that four counters or more come to a word of the corpus."""
    buckets, bits = buckets_for(tokens, 2_000_000), min(63, max(8, int(tokens).bit_length() + 2))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                c = Candidates(row, bits)
                sent = [(b, squeeze(differences(c.keys[i:j]), c.times[i:j])) for b, i, j in by_bucket(c.keys, buckets)]
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * len(sent), pa.int64()), pa.array([b for b, _ in sent], pa.int32()), pa.array([x for _, x in sent], pa.binary())], ["chunk", "bucket", "data"])

    def enough(parts: list[bytes]) -> list[bytes]:
        asked = [(np.cumsum(k, dtype=np.uint64), t) for k, t in (unsqueeze(x, np.uint64, np.int64) for x in parts)]
        return [(n >= least).astype(np.uint8).tobytes() for n in summed(asked)]

    known = encoded
    for name in ("pairs", "longer"):
        got = saved(answers(known.mapInArrow(ask, "chunk long, bucket int, data binary"), enough, name), "answers")
        known = known.join(got, "chunk", "left")

    def called(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                found = Candidates(row, bits).phrases()
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
                order = np.argsort(hashes >> np.uint64(40), kind="stable")
                sent = [(b, zstandard.ZstdCompressor(3).compress(b"\n".join([found[k] for k in order[i:j].tolist()]))) for b, i, j in by_bucket(hashes[order] >> np.uint64(40) << np.uint64(40), buckets)]
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(sent), pa.string()), pa.array([b for b, _ in sent], pa.int32()), pa.array([x for _, x in sent], pa.binary())], ["lang", "bucket", "data"])

    def distinct(group: pd.DataFrame) -> pd.DataFrame:
        known: dict[str, set[bytes]] = defaultdict(set)
        for lang, data in zip(group["lang"], group["data"], strict=True):
            known[lang].update(zstandard.ZstdDecompressor().decompress(data).split(b"\n"))
        rows = [(lang, x.decode()) for lang in sorted(known) for x in sorted(known[lang])]
        return pd.DataFrame(rows, columns=["lang", "phrase"])

    return known.mapInArrow(called, "lang string, bucket int, data binary").groupBy("bucket").applyInPandas(distinct, "lang string, phrase string")


class Trie:
    """A double-array trie of (lang, words): the state after s and symbol c is t = base[s] + c if check[t] = s. Each language
    has a state to start from. accept[t]: the phrase's number, or -1."""

    def __init__(self, phrases: list[tuple[str, list[bytes]]]):
        n = self.phrases = len(phrases)
        often = Counter(w for _, words in phrases for w in words)
        self.symbols = {w: i + 1 for i, w in enumerate(sorted(often, key=lambda w: (-often[w], w)))}  # children lie close together
        self.start = {lang: i for i, lang in enumerate(sorted({lang for lang, _ in phrases}))}
        codes, sizes = np.zeros((n, LONGEST), np.int64), np.zeros(n, np.int64)
        for i, (_, words) in enumerate(phrases):
            sizes[i] = len(words)
            codes[i, : len(words)] = [self.symbols[w] for w in words]
        slot = np.fromiter((self.start[lang] for lang, _ in phrases), np.int64, n)  # of each phrase's last state so far
        used, free, top = np.ones(len(self.start), bool), len(self.start), len(self.start)  # free: all before it are used; top: none from it on is
        accept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        placed: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        width = len(self.symbols) + 1
        for k in range(LONGEST):
            rows = np.flatnonzero(sizes > k)
            children, inverse = np.unique(slot[rows] * width + codes[rows, k], return_inverse=True)
            parent, code = children // width, children % width
            begin = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]]) if len(parent) else np.empty(0, np.int64)
            many = np.diff(np.r_[begin, len(parent)])
            at = np.empty(len(children), np.int64)
            # States with most children are placed first; those with one take what is free.
            for g in np.argsort(-many, kind="stable")[: int((many > 1).sum())].tolist():
                own = code[begin[g] : begin[g] + many[g]]
                # Not always from the first gap: those that are left there fit hardly anything.
                first, tries = free + g * 7919 % (top - free + 1), 0
                while True:
                    ahead = np.flatnonzero(~used[first : first + 4096])
                    first = min(top, first + int(ahead[0]) if len(ahead) else first + 4096)
                    to = first - own[0] + own
                    if first >= top or not used[to[to < top]].any():
                        break
                    tries += 1
                    first = first + 1 if tries < 200 else top
                top = max(top, int(to[-1]) + 1)
                if top > len(used):
                    used = np.r_[used, np.zeros(top, bool)]
                used[to] = True
                at[begin[g] : begin[g] + many[g]] = to
                ahead = np.flatnonzero(~used[free : free + 4096])
                free = min(top, free + int(ahead[0]) if len(ahead) else free + 4096)
            alone = begin[many == 1]
            gaps = np.flatnonzero(~used)
            if len(gaps) < len(alone):
                used = np.r_[used, np.zeros(len(alone), bool)]
                gaps = np.flatnonzero(~used)
            at[alone] = gaps[: len(alone)]
            used[at[alone]] = True
            top = max(top, int(at.max(initial=-1)) + 1)
            placed.append((parent, code, at))
            slot[rows] = at[inverse]
            ends = rows[sizes[rows] == k + 1]
            accept[k] = (slot[ends].copy(), ends)
        size = top
        # A state without children leads far below 0.
        self.base, self.check, self.accept = np.full(size, -(2**30), np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        for parent, code, at in placed:
            self.base[parent], self.check[at] = at - code, parent
        for where, numbers in accept.values():
            self.accept[where] = numbers

    def count(self, lang: str, words: list[bytes], codes: np.ndarray, total: np.ndarray) -> None:
        """Adds the occurrences of all phrases in the text, given as numbers of words from 1 on, 0 for breaks."""
        if lang not in self.start:
            return
        symbol = np.r_[0, np.fromiter((self.symbols.get(w, 0) for w in words), np.int32, len(words))].astype(np.int32)[codes]
        symbol = np.r_[symbol, np.zeros(LONGEST, np.int32)]
        at = np.flatnonzero(symbol)
        state = np.full(len(at), self.start[lang], np.int32)
        for k in range(LONGEST):
            c = symbol[at + k]
            to = self.base[state] + c
            ok = np.flatnonzero((c > 0) & (to >= 0) & (to < len(self.check)))
            ok = ok[self.check[to[ok]] == state[ok]]
            at, state = at[ok], to[ok]
            ends = self.accept[state]
            total += np.bincount(ends[ends >= 0], minlength=self.phrases)


def count_phrases(encoded: DataFrame, phrases: DataFrame, block_phrases: int = 200_000, at_once: int = 4, fan_in: int = 32) -> DataFrame:
    """(lang, phrase, f): how often each of the distinct phrases occurs. A task sends a block's counts as one row; they are
    added up in rounds of fan_in tasks."""
    phrases = saved(phrases, "phrases")
    blocks = max(1, -(-phrases.count() // block_phrases))
    placed = phrases.withColumn("block", F.pmod(F.xxhash64("lang", "phrase"), F.lit(blocks)).cast("int"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["lang", "phrase"])
        trie = Trie([(a, b.encode().split(b" ")) for a, b in zip(group["lang"], group["phrase"], strict=True)])
        data = zstandard.ZstdCompressor(1).compress(pickle.dumps(trie))
        head = pd.DataFrame({"block": [group["block"].iloc[0]], "number": [-1], "lang": [None], "phrase": [None], "trie": [data]})
        rows = pd.DataFrame({"block": group["block"], "number": range(len(group)), "lang": group["lang"], "phrase": group["phrase"], "trie": None})
        del trie
        give_back()
        return pd.concat([head, rows])

    built = saved(placed.groupBy("block").applyInPandas(build, "block int, number int, lang string, phrase string, trie binary"), "tries")
    parts = None
    for at in range(0, blocks, at_once):
        some = built.where(f"number = -1 and block >= {at} and block < {at + at_once}").select("block", "trie").collect()
        shared = encoded.sparkSession.sparkContext.broadcast([(r["block"], bytes(r["trie"])) for r in some])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tries = [(b, pickle.loads(zstandard.ZstdDecompressor().decompress(x))) for b, x in shared.value]
            totals = [np.zeros(t.phrases, np.int64) for _, t in tries]
            for batch in batches:
                for row in rows_of(batch):
                    words, codes = row["words"].split(b" "), _opened(row["body"])[0]
                    for (_, trie), total in zip(tries, totals, strict=True):
                        trie.count(row["lang"], words, codes, total)
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in tries], pa.int32()), pa.array([_sent([], x) for x in totals], pa.binary())], ["block", "data"])
            give_back()

        own = saved(encoded.mapInArrow(run, "block int, data binary").withColumn("part", F.spark_partition_id()), "counts")
        parts = own if parts is None else parts.union(own)

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(_received(bytes(x))[1] for x in group["data"])
        return pd.DataFrame({"block": group["block"].iloc[:1], "part": group["part"].iloc[:1], "data": [_sent([], total)]})

    most = parts.agg(F.max("part")).first()[0] or 0
    while most > 0:
        most //= fan_in
        parts = parts.withColumn("part", F.expr(f"part div {fan_in}").cast("int")).groupBy("block", "part").applyInPandas(add, "block int, part int, data binary")

    def name(phrases: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        phrases = phrases.sort_values("number")
        total = _received(bytes(counts["data"].iloc[0]))[1] if len(counts) else np.zeros(len(phrases), np.int64)
        return pd.DataFrame({"lang": phrases["lang"], "phrase": phrases["phrase"], "f": total})

    counted = built.where("number >= 0").select("block", "number", "lang", "phrase").groupBy("block").cogroup(parts.groupBy("block"))
    return counted.applyInPandas(name, "lang string, phrase string, f long")


def collocations(docs: DataFrame, least: int = 100, most: int = 2000, block_phrases: int = 200_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's highest-scoring phrases that occur `least` times or more."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    table = _chunks(texts, buckets_for(byte_size(texts) / 20, 1_000_000))
    answered = _frequent(table, least)
    words = _words_of(answered)
    totals = table.where("bucket = -1").groupBy("lang").agg(F.sum("n").alias("n"))
    encoded = _encoded(table, answered)
    found = count_phrases(encoded, candidates(encoded, least, totals.agg(F.sum("n")).first()[0] or 0), block_phrases)
    a = saved(found.where(f"f >= {least}"), "phrases").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    parts = words.union(a.select("lang", "phrase", "a"))

    # A longer candidate with as many occurrences has one between it and the phrase, a word longer, so a word is enough.
    inside = F.explode(F.array(*[F.array_join(F.expr(f"slice(w, {at}, size(w) - 1)"), " ") for at in (1, 2)]))
    longer = a.where("size(w) > 2").select("lang", inside.alias("phrase"), F.col("a").alias("of_longer")).groupBy("lang", "phrase").agg(F.max("of_longer").alias("of_longer"))
    kept = a.join(longer, ["lang", "phrase"], "left").where("of_longer is null or 100 * of_longer < 100 * a")
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("left"), F.array_join(F.expr("slice(w, k + 1, size(w))"), " ").alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(totals, "lang")
    exact = "cast(cast(1000 * cast(a as decimal(15,0)) as decimal(19,0)) * cast(n as decimal(19,0)) as decimal(38,0)) div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0))"
    scored = cuts.select("lang", "phrase", "a", "n", F.struct(F.expr(exact).alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut"))
    scored = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(f"rank <= {most}")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


PHRASE_SQL = r"""
WITH p AS (SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, k) GROUP BY ALL),
n AS (SELECT lang, SUM(f) AS n FROM g WHERE k = 1 GROUP BY lang),
a AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 100),
s AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, MAX(a) AS longer FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM a)) GROUP BY ALL),
c AS (SELECT a.*, unnest(range(1, a.k)) AS cut FROM a LEFT JOIN s USING (lang, phrase) WHERE s.longer IS NULL OR 100 * s.longer < 100 * a.a),
x AS (SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM c JOIN g l ON l.lang = c.lang AND l.k = c.cut AND l.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN g r ON r.lang = c.lang AND r.k = c.k - c.cut AND r.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ') JOIN n ON n.lang = c.lang),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS lowest FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM y WHERE lowest = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM z WHERE rank <= 2000
"""
