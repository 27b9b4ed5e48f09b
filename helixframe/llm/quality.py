"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics: sizes, shares of kinds of characters, words' lengths and repetition.
Per label the sums and cross products are added up by Spark (a few hundred numbers), and give means and covariances. A
covariance is shrunk toward the pooled one, and that toward its diagonal; its Cholesky factor is inverted once. A text's
score is the logistic of the difference of both log-densities (Mahalanobis distances and log-determinants) and priors.

Nulls: a null text is an empty one and is scored as such. Rows whose label is null, and documents without a label, teach
nothing; of several labels of a doc_id the largest holds. With fewer than two labelled rows of either kind the score is
the share of label 1 (0.5 without any). A null doc_id counts as held out. Repeated rows have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import as_bytes, crc_mod5, gram_hash, prefix_hash, saved, slices, texts_of, word_hashes

#: Kinds of bytes whose shares are statistics.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "blank": b" \t\r\x0b\f", "line": b"\n",
    "stop": b".,;:?", "call": b"!", "mark": b"*&%$#@^~+=<>", "bar": b"|_\\/", "quote": b"'\"`()[]{}-", "wide": bytes(range(128, 256)),
}
NAMES = ["log_bytes", "log_words", *KINDS, "word_length", "distinct_words", "top_word", "same_next", "distinct_grams"]
_KIND = np.zeros((256, len(KINDS)))
for _i, _chars in enumerate(KINDS.values()):
    _KIND[[*_chars], _i] = 1


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of statistics per text."""
    n = len(texts)
    size = np.array([*map(len, texts)], np.float64)
    histogram = np.array([np.bincount(np.frombuffer(x, np.uint8), minlength=256) for x in texts]).reshape(n, 256)
    shares = (histogram @ _KIND) / np.maximum(size, 1)[:, None]
    values, counts = word_hashes(texts)
    words = counts.astype(np.float64)
    doc = np.repeat(np.arange(n), counts)

    def distinct(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((hashes, of))
        h, d = hashes[order], of[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.empty(0, bool)
        at = np.flatnonzero(new)
        most = np.zeros(n)
        np.maximum.at(most, d[at], np.diff(np.r_[at, len(h)]))
        return np.bincount(d[at], minlength=n).astype(np.float64), most

    unlike, most = distinct(values, doc)
    same = np.bincount(doc[1:][(values[1:] == values[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    grams = gram_hash(prefix_hash(values), 3) if len(values) >= 3 else np.empty(0, np.uint64)
    inside = doc[: len(grams)] == doc[2:] if len(grams) else np.empty(0, bool)
    n_grams = np.bincount(doc[: len(grams)][inside], minlength=n)
    unlike_grams, _ = distinct(grams[inside], doc[: len(grams)][inside])
    per = np.maximum(words, 1)
    spread = lambda x: np.log((x + 0.002) / (1.002 - x))
    columns = [
        np.log1p(size), np.log1p(words), *spread(np.clip(shares.T, 0, 1)), np.log1p(size / per),
        spread(unlike / per), spread(np.clip(most / per, 0, 1)), spread(same / per), spread(unlike_grams / np.maximum(n_grams, 1)),
    ]
    return np.stack(columns, 1)


@dataclass
class Discriminant:
    prior: tuple[float, float]
    means: list[np.ndarray]
    factors: list[np.ndarray]  #: inverses of the covariances' Cholesky factors
    logdet: list[float]

    def score(self, x: np.ndarray, temperature: float = 4.0) -> np.ndarray:
        """Logistic of the log-density difference, divided by the temperature: statistics are not independent."""
        if not self.means:
            return np.full(len(x), self.prior[1])
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdet, strict=True)]
        margin = (density[1] - density[0]) / temperature + np.log(self.prior[1] / self.prior[0])
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def moments(rows: DataFrame, label: str = "label", column: str = "stats") -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per label the number, sum and cross products of the vectors. Tasks send sums; Spark adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).to_pylist(), np.float64)
            for k in np.unique(y):
                own = np.column_stack([np.ones((y == k).sum()), x[y == k]])
                product = own.T @ own
                i, j = np.triu_indices(len(product))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(product[i, j])], ["k", "i", "j", "v"])

    out = {}
    got = rows.select(F.col(label).cast("int"), column).mapInArrow(run, "k int, i int, j int, v double").groupBy("k", "i", "j").agg(F.sum("v").alias("v")).collect()
    for k in {r["k"] for r in got}:
        own = [r for r in got if r["k"] == k]
        d = max(r["j"] for r in own) + 1
        full = np.zeros((d, d))
        for r in own:
            full[r["i"], r["j"]] = full[r["j"], r["i"]] = r["v"]
        out[k] = (full[0, 0], full[0, 1:], full[1:, 1:])
    return out


def fit(by_label: dict[int, tuple[float, np.ndarray, np.ndarray]], toward_pooled: float = 0.1, toward_diagonal: float = 0.1) -> Discriminant:
    n = [by_label.get(k, (0.0,))[0] for k in (0, 1)]
    if min(n) < 2:
        share = n[1] / sum(n) if sum(n) else 0.5
        return Discriminant((1 - share, share), [], [], [])
    means = [by_label[k][1] / n[k] for k in (0, 1)]
    spread = [by_label[k][2] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (n[0] * spread[0] + n[1] * spread[1]) / sum(n)
    target = (1 - toward_diagonal) * pooled + toward_diagonal * np.diag(np.diag(pooled))
    factors, logdet = [], []
    for k in (0, 1):
        lower = np.linalg.cholesky((1 - toward_pooled) * spread[k] + toward_pooled * target + 1e-6 * np.eye(len(target)))
        factors.append(np.linalg.inv(lower))
        logdet.append(2 * float(np.log(np.diag(lower)).sum()))
    return Discriminant((n[0] / sum(n), n[1] / sum(n)), means, factors, logdet)


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = statistics(as_bytes(part.column("text")))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "stats"])

    return texts_of(docs).mapInArrow(run, "doc_id long, stats array<double>")


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """(id, label): a row per doc_id that has a label and may be learned from."""
    own = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).where(crc_mod5() != 0)
    return own.groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max(column) > 0).cast("int").alias("label"))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per document."""
    stats = saved(with_statistics(docs), "statistics")
    known = stats.join(labelled(labels, "quality"), F.col("doc_id") == F.col("id"))
    model = fit(moments(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x) if len(x) else np.empty(0))], ["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (crc_mod5() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
