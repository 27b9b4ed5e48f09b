"""Importance resampling towards a target distribution, with features counted once per distinct line.

Features are the runs of one to three consecutive words, hashed to buckets. Newlines separate words, so a text falls into
lines, and corpora repeat lines (headers, licences, whole copies). The runs inside a line depend on the line alone:

1. Documents are cut into lines; a document has each of its distinct lines once, with its occurrences. Runs that reach over
   the end of a line, at most three to a line, are kept with the document as buckets.
2. Equal lines of the corpus are one (they are grouped by their text, partly before the shuffle). The buckets of a distinct
   line are computed once; the corpus's counts are those times the occurrences, plus the documents' cross-line runs. Tasks
   add up `buckets` counters, Spark adds up the tasks.
3. A bucket's gain compares the target's count with the corpus's. A distinct line's gains are summed up once, and joined to
   the documents by the line's BLAKE2b digest; a document's weight is the sum over its lines and its cross-line runs.
4. Documents draw a Gumbel variate from the hash of their id; the highest scores are drawn. Ranks are numbers within ranges
   of scores plus the sizes of the ranges before, so no task sees more than a range.

The driver gets 2 x `buckets` sums. A line that all documents have is a join key with a row per document, which adaptive
execution splits, and one row on the other side.

Nulls: a null text has no words. A null doc_id hashes as an empty string and comes last among ties. Repeated rows are rows of
their own with equal scores and neighbouring ranks. Ties go to the smaller doc_id, then to the smaller weight. A very long
text is cut like others; a very long line is held whole by a task. Other columns are not read. An empty table gives an empty
one; an empty target gives gains by the corpus alone.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import as_bytes, saved, slices, texts_of

#: Lower case; newlines stay, all other ASCII that is neither letter nor digit becomes a space.
LINES = bytes(c if c >= 0x80 or c == 10 or chr(c).isdigit() or chr(c).islower() else (c + 32 if chr(c).isupper() else 32) for c in range(256))
LONGEST = 64


def _crc_steps() -> np.ndarray:
    """steps[n, k, b]: what byte k of a CRC-32 that holds b becomes when n zero bytes follow."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    at = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32)[:, None] * 8)
    out = [at]
    for _ in range(LONGEST):
        out.append(at := table[at & 255] ^ (at >> 8))
    return np.array(out)


_STEPS = _crc_steps()


def crc_followed(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part of CRC-32 of a string with n bytes appended that is the string's: XORed with the CRC of those bytes it is whole."""
    n = n.copy()
    while len(far := np.flatnonzero(n > LONGEST)):
        crc = crc.copy()
        crc[far] = crc_followed(crc[far], np.full(len(far), LONGEST))
        n[far] -= LONGEST
    s = _STEPS
    return s[n, 0, crc & 255] ^ s[n, 1, crc >> 8 & 255] ^ s[n, 2, crc >> 16 & 255] ^ s[n, 3, crc >> 24]


def features_of(lines: list[list[bytes]], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all runs of one to three words inside the lines, line by line, and how many each line has."""
    counts = np.fromiter(map(len, lines), np.int64, len(lines))
    words = [w for line in lines for w in line]
    n = len(words)
    one = np.fromiter(map(zlib.crc32, words), np.uint32, n)
    size = np.fromiter(map(len, words), np.int64, n)
    line = np.repeat(np.arange(len(lines)), counts)
    spaced = crc_followed(np.full(n, zlib.crc32(b" "), np.uint32), size) ^ one  # of the word after a space
    two = crc_followed(one[:-1], size[1:] + 1) ^ spaced[1:]
    three = crc_followed(two[:-1], size[2:] + 1) ^ spaced[2:]
    in2, in3 = line[1:] == line[:-1], line[2:] == line[:-2]
    every = np.concatenate([one, two[in2], three[in3]])
    owner = np.concatenate([line, line[1:][in2], line[2:][in3]])
    order = np.argsort(owner, kind="stable")
    return (every[order] % np.uint32(buckets)).astype(np.int64), np.bincount(owner, minlength=len(lines))


def cut_text(text: bytes, buckets: int) -> tuple[Counter, list[int]]:
    """The text's lines that have words, with their occurrences, and the buckets of the runs that reach over lines' ends."""
    lines: Counter = Counter()
    across: list[int] = []
    tail: list[bytes] = []  # the last two words before the line
    crc = zlib.crc32
    for line in text.translate(LINES).split(b"\n"):
        head = line.split(None, 2)[:2]
        if not head:
            continue
        lines[line] += 1
        if tail:
            link = tail[-1] + b" " + head[0]
            across.append(crc(link) % buckets)
            if len(tail) > 1:
                across.append(crc(tail[-2] + b" " + link) % buckets)
            if len(head) > 1:
                across.append(crc(link + b" " + head[1]) % buckets)
        tail = (tail + head)[-2:] if len(head) < 2 else line.rsplit(None, 2)[-2:]
    return lines, across


def _digest(line: bytes) -> bytes:
    return hashlib.blake2b(line, digest_size=16).digest()


def _code(buckets: int) -> type:
    """The type that packs a bucket."""
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def _cut(docs: DataFrame, buckets: int) -> DataFrame:
    """(row, doc_id, across) of each document, with digest null, and (row, digest, times) of its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch):
                rows, ids, across, digests, times = [], [], [], [], []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), as_bytes(part.column("text")), strict=True):
                    own, over = cut_text(text, buckets)
                    k = len(own)
                    rows += [row] * (1 + k)
                    ids += [doc_id] + [None] * k
                    across += [np.array(over, _code(buckets)).tobytes()] + [None] * k
                    digests += [None, *map(_digest, own)]
                    times += [None, *own.values()]
                    row += 1
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip((rows, ids, across, digests, times), kinds, strict=True)], ["row", "doc_id", "across", "digest", "times"])

    return saved(docs.mapInArrow(run, "row long, doc_id long, across binary, digest binary, times long"), "lines")


def _distinct_lines(docs: DataFrame, buckets: int) -> DataFrame:
    """(digest, times, n_words, features) of the corpus's distinct lines; features: their buckets, packed."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own: Counter = Counter()
                for text in as_bytes(part.column("text")):
                    own.update(x for x in text.translate(LINES).split(b"\n") if x and not x.isspace())
                yield pa.RecordBatch.from_arrays([pa.array(map(_digest, own), pa.binary()), pa.array(own.keys(), pa.binary()), pa.array(own.values(), pa.int64())], ["digest", "line", "times"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column="line"):
                words = [x.split() for x in as_bytes(part.column("line"))]
                found, counts = features_of(words, buckets)
                data = found.astype(_code(buckets)).tobytes()
                each = np.dtype(_code(buckets)).itemsize
                ends = each * np.cumsum(counts)
                packed = [data[e - each * n : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("digest"), part.column("times"), pa.array([*map(len, words)], pa.int64()), pa.array(packed, pa.binary())], ["digest", "times", "n_words", "features"])

    whole = docs.mapInArrow(lines, "digest binary, line binary, times long").groupBy("digest", "line").agg(F.sum("times").alias("times"))
    return saved(whole.mapInArrow(count, "digest binary, times long, n_words long, features binary"), "features")


def _unpacked(packed: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All buckets in binary values, and how many each value has."""
    got = [x or b"" for x in packed.to_pylist()]
    found = np.frombuffer(b"".join(got), _code(buckets))
    return found.astype(np.int64), np.fromiter(map(len, got), np.int64, len(got)) // found.itemsize


def bucket_counts(cut: DataFrame, distinct: DataFrame, buckets: int) -> np.ndarray:
    """The corpus's counts: distinct lines' features times their occurrences, and the documents' cross-line runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, column="features"):
                at, counts = _unpacked(part.column("features"), buckets)
                times = np.repeat(part.column("times").to_numpy(zero_copy_only=False), counts)
                np.add.at(total, at, times)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    both = distinct.select("times", "features").union(cut.where("digest is null").select(F.lit(1).cast("long"), "across"))
    out = np.zeros(buckets, np.int64)
    for r in both.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """floor(1000 ln(((t+1)(S+B)) / ((s+1)(T+B)))) of each of the B buckets."""
    b, big_s, big_t = len(s), float(s.sum()), float(t.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (big_s + b) / ((x + 1) * (big_t + b)))) for x, y in zip(map(float, s), map(float, t), strict=True)], np.int64)


def weigh(docs: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(doc_id, n_words, n_features, weight), a row per document, for a target of (text)."""
    docs, target = texts_of(docs), texts_of(target.select(F.lit(0).alias("doc_id"), "text"))
    cut, distinct = _cut(docs, buckets), _distinct_lines(docs, buckets)
    gains = gains_of(bucket_counts(cut, distinct, buckets), bucket_counts(_cut(target, buckets), _distinct_lines(target, buckets), buckets))

    def weights(column: str, keep: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, column=column):
                    at, counts = _unpacked(part.column(column), buckets)
                    before = np.r_[0, np.cumsum(gains[at])]
                    ends = np.cumsum(counts)
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(counts), pa.array(before[ends] - before[ends - counts])], [*keep, "k", "w"])

        return run

    lines = distinct.select("digest", "n_words", "features").mapInArrow(weights("features", ["digest", "n_words"]), "digest binary, n_words long, k long, w long")
    per = cut.where("digest is not null").select("row", "digest", "times").hint("merge").join(lines, "digest")
    inside = per.groupBy("row").agg(*[F.sum(F.col(c) * F.col("times")).alias(f"in_{c}") for c in ("n_words", "k", "w")])
    over = cut.where("digest is null").select("row", "doc_id", "across").mapInArrow(weights("across", ["row", "doc_id"]), "row long, doc_id long, k long, w long")
    had = lambda c: F.coalesce(f"in_{c}", F.lit(0))
    return over.hint("merge").join(inside, "row", "left").select("doc_id", had("n_words").alias("n_words"), (F.col("k") + had("k")).alias("n_features"), (F.col("w") + had("w")).alias("weight"))


def gumbel(seed: str = "42") -> Column:
    """floor(1000 g) for a Gumbel variate g from the first 32 bits of sha256("<seed>:<doc_id>")."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(weighed: DataFrame, per_cent: int = 5, least_words: int = 20, seed: str = "42", range_rows: int = 200_000) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): the highest per_cent of the scores of documents with so many words."""
    scored = saved(weighed.select("*", (F.col("weight") + gumbel(seed)).alias("score"), (F.col("n_words") >= least_words).alias("may")), "scored")
    rows, n = scored.agg(F.count("*"), F.count_if("may")).first()
    order = [F.col("may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features")]
    placed = saved(scored.repartitionByRange(max(8, -(-rows // range_rows)), *order).withColumn("part", F.spark_partition_id()), "placed")
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select(F.col("part").alias("p"), (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    ranked = placed.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*order))).join(before, F.col("part") == F.col("p"))
    rank = F.col("before") + F.col("at")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("may") & (rank <= per_cent * n // 100), rank).cast("long").alias("rank"))


def op13_importance(spark, sf_dir: str) -> DataFrame:
    return draw(weigh(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


IMPORTANCE_SQL = r"""
WITH RECURSIVE bit(i, b) AS (SELECT x, x FROM range(256) AS r(x)), tab AS (
  SELECT i, list_reduce(list_prepend(CAST(b AS UBIGINT), [CAST(k AS UBIGINT) FOR k IN range(8)]), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) AS v FROM bit),
t AS (SELECT list(v ORDER BY i) AS v FROM tab),
d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
b AS (SELECT regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT unnest([1, 2, 3]) AS k),
df AS (SELECT r, array_to_string(w[i:i + k - 1], ' ') AS f, count(*) AS n FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k) GROUP BY ALL),
bf AS (SELECT array_to_string(w[i:i + k - 1], ' ') AS f, count(*) AS n FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b, k) GROUP BY ALL),
f AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf))),
c AS (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(1, len(h), 2), lambda i: CAST((strpos('0123456789ABCDEF', h[i:i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1:i + 1]) - 1 AS UBIGINT))),
  lambda c, x: xor(c >> 8, v[CAST((xor(c, x) & 255) AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) % 10000 AS bucket FROM f, t),
s AS (SELECT bucket, SUM(n) AS s FROM df JOIN c USING (f) GROUP BY bucket),
u AS (SELECT bucket, SUM(n) AS t FROM bf JOIN c USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((COALESCE(t, 0) + 1)::DOUBLE * ((SELECT COALESCE(SUM(s), 0) FROM s) + 10000)::DOUBLE / ((COALESCE(s, 0) + 1)::DOUBLE * ((SELECT COALESCE(SUM(t), 0) FROM u) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN u USING (bucket)),
w AS (SELECT r, SUM(n) AS n, SUM(n * gain) AS w FROM df JOIN c USING (f) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT doc_id, len(d.w) AS words, CAST(COALESCE(n, 0) AS BIGINT) AS n_features, CAST(COALESCE(w.w, 0) AS BIGINT) AS weight,
  CAST(COALESCE(w.w, 0) + floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256(concat('42:', doc_id)), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN w USING (r)),
y AS (SELECT *, row_number() OVER (ORDER BY words >= 20 DESC, score DESC, doc_id NULLS LAST, weight, n_features) AS place, SUM(CAST(words >= 20 AS BIGINT)) OVER () AS n FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM y
"""
