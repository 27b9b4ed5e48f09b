"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

The lexicon is learned from a bounded sample of labelled rows (`sample_rows`): words and stems whose places tell toxic
documents from others. A place is a word with its neighbours, so a text that is copied a thousand times counts as once. The
lexicon is a trie. A word is looked up by its Levenshtein automaton, whose states are rows of edit distances, stepped
along the trie's edges; branches whose row exceeds the allowed edits are cut. Two letters that change places are one edit.
Beside a short stem the trie has the learned words and longer stems that begin with it, which edits lead to. A token with
digits or marks inside is looked up with the letters that they stand for, and without the marks. Words that the sample's
clean documents have are no misspellings. In a window around a hit, quotation marks that enclose it or a word of report before it make it
a quotation. A document's score is a logistic function of its direct, misspelled and quoted hits, fitted on the sample.

Nulls: a null text is an empty one; empty texts have the score of a document without hits. Null labels and documents
without labels teach nothing; of several labels of a doc_id the largest holds. Without toxic rows in the sample the
lexicon is empty and all scores are alike and low. A null doc_id counts as held out. Repeated rows have equal scores. Very
long texts are read whole. Other columns of the input are kept. An empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import crc_mod5, map_text, saved, slices, texts_of, whole_row
from helixframe.llm.quality import labelled

_WORD = re.compile(r"[^\W\d_]+")
#: Words with digits or marks in them.
_TOKEN = re.compile(r"(?:[@$](?=[^\W\d_]))?[^\W_]+(?:[*@$!|#+.'’_\-\u00ad\u200b\u0300-\u036f]{1,2}[^\W_]+)*")
_MARK = re.compile(r"[\W_]")
#: Letters that digits and marks stand for; 1 and | stand for two.
_LETTERS = [str.maketrans("013457@$!|", f"o{i}eastasi{i}") for i in "il"]
STEMS = (4, 5, 6, 7, 8)
#: Words before a quotation.
REPORT = frozenset("said says say wrote writes called calls quoted quote quotes reported reports term word dijo dice sagte sagt schrieb dit écrit".split())
N_FEATURES = 5


@dataclass
class Lexicon:
    """Terms with weights; a term that ends in * is a stem, which any ending may follow. clean: words near a term that
    are ordinary words. beneath: words and longer stems of a stem, which misspelt words are compared with, and that stem."""

    terms: dict[str, float] = field(default_factory=dict)
    clean: frozenset[str] = frozenset()
    weights: tuple[float, ...] = (-3.0, 3.0, 1.0, 0.2, 0.5, 0.0)
    beneath: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.root: dict = {}
        # Other than words, stems of 4 letters are too short for edits.
        targets = {t: t for t in self.terms} | self.beneath
        targets = {t: own for t, own in targets.items() if len(t) >= (6 if t.endswith("*") else 4)}
        self.edited: dict = {}
        for root, terms in ((self.root, {t: t for t in self.terms}), (self.edited, targets)):
            for term, own in terms.items():
                node = root
                for c in term.rstrip("*"):
                    node = node.setdefault(c, {})
                node["*" if term.endswith("*") else ""] = own
        # A term and what one edit makes of it have a form in common, if each may lose a letter: a letter put in or left out
        # is lost on one side, a changed one on both, and of two that change places each side loses the other's first. So
        # words without a common form need no walk.
        self.cut_words = {c for t in targets if not t.endswith("*") for c in _shortened(t)}
        self.cut_stems = {c for t in targets if t.endswith("*") for c in _shortened(t[:-1])}
        self.cut_sizes = sorted({*map(len, self.cut_stems)})
        self.starts = {c[:3] for c in self.cut_words | self.cut_stems}
        self.known: dict[str, tuple[str, int] | None] = {}

    def find(self, word: str) -> tuple[str, int] | None:
        """The term that a word is or misspells, and the number of edits."""
        try:
            return self.known[word]
        except KeyError:
            if len(self.known) > 100_000:
                self.known.clear()
            got = self.known[word] = self._find(word)
            return got

    def _find(self, word: str) -> tuple[str, int] | None:
        node = self.root
        stem = None
        for c in word:
            node = node.get(c)
            if node is None:
                break
            stem = node.get("*", stem)
        if node is not None and "" in node:
            return node[""], 0
        if stem:
            return stem, 0
        if len(word) < 3 or word in self.clean:
            return None
        if self.starts.isdisjoint((word[:3], word[1:4], word[0] + word[2:4], word[:2] + word[3:4])):
            return None
        forms = _shortened(word)
        if forms.isdisjoint(self.cut_words) and not any(x[:k] in self.cut_stems for x in forms for k in self.cut_sizes):
            return None
        return min(self._walk(self.edited, word, tuple(range(len(word) + 1))), default=None, key=lambda x: (x[1], x[0]))

    def _walk(self, node: dict, word: str, row: tuple[int, ...], before: tuple[int, ...] = (), last: str = "", most: int = 1) -> Iterator[tuple[str, int]]:
        """Terms within `most` edits below a node; row: the automaton's state after the node's letters, the last of which is
        `last`; before: its state before that letter."""
        if "" in node and row[-1] <= most:
            yield node[""], max(1, row[-1])
        if "*" in node and min(row) <= most:
            yield node["*"], max(1, min(row))
        for c, child in node.items():
            if len(c) != 1 or c == "*":
                continue
            step = [row[0] + 1]
            for i, x in enumerate(word):
                least = min(step[-1] + 1, row[i + 1] + 1, row[i] + (x != c))
                if i and x == last and word[i - 1] == c:
                    least = min(least, before[i - 1] + 1)
                step.append(least)
            if min(step) <= most:
                yield from self._walk(child, word, tuple(step), row, c, most)

    def find_spelt(self, token: str) -> tuple[str, int] | None:
        """The term that a token with digits or marks in it stands for; it counts as an edit."""
        try:
            return self.known[token]
        except KeyError:
            got = None
            if 4 <= len(token) <= 40 and token not in self.clean:
                mapped = [token.translate(x) for x in _LETTERS]
                forms = {token, *mapped, *(_MARK.sub("", x) for x in (token, *mapped))}
                got = min((x for f in forms if (x := self.find(f))), default=None, key=lambda x: (x[1], x[0]))
            got = self.known[token] = got and (got[0], 1)
            return got

    def hits(self, text: str) -> dict[str, tuple[str, int]]:
        """Words, and tokens with digits or marks of whose words none is a term, with their terms and edits; text: in lower case."""
        find, known = self.find, self.known
        out = {w: got for w in set(_WORD.findall(text)) if (got := known[w] if w in known else find(w)) is not None}
        for token in set(_TOKEN.findall(text)):
            if not token.isalpha() and not token.isdigit() and (got := self.find_spelt(token)) and not any(w in out for w in _WORD.findall(token)):
                out[token] = got
        return out

    def features(self, text: str, window: int = 60) -> list[float]:
        """Direct, misspelled and quoted hits (logarithms of weighted counts), different terms, hits per word."""
        lower = text.lower()
        direct = near = quoted = 0.0
        names = self.hits(lower)
        if not names:
            return [0.0] * N_FEATURES
        n = len(_WORD.findall(lower))
        found = [m for m in _WORD.finditer(lower) if m[0] in names]
        if not all(map(str.isalpha, names)):
            found += [m for m in _TOKEN.finditer(lower) if not m[0].isalpha() and m[0] in names]
        for m in found:
            term, edits = names[m[0]]
            weight = self.terms[term]
            if _is_quoted(lower, m.start(), m.end(), window):
                quoted += weight
            elif edits:
                near += weight
            else:
                direct += weight
        return [math.log1p(direct), math.log1p(near), math.log1p(quoted), math.log1p(len({g[0] for g in names.values()})), min(1.0, 20 * (direct + near) / max(n, 1))]

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), N_FEATURES)
        return 1 / (1 + np.exp(-(self.weights[0] + x @ np.array(self.weights[1:]))))


def _shortened(word: str) -> set[str]:
    """A word, and the word without any one of its letters."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def _is_quoted(text: str, start: int, end: int, window: int) -> bool:
    before, after = text[max(0, start - window) : start], text[end : end + window]
    line = before.rpartition("\n")[2]
    marks = sum(c in '"“”«»„' for c in line)
    if marks % 2 and any(c in '"”»“' for c in after.partition("\n")[0]):
        return True
    return any(w in REPORT for w in _WORD.findall(before)[-2:])


def _terms_of(words: list[str]) -> Iterator[tuple[str, int]]:
    """Words and stems with the number of the word."""
    for i, w in enumerate(words):
        if len(w) >= 3:
            yield w, i
            for k in STEMS:
                if len(w) > k:
                    yield w[:k] + "*", i


def _gain(a: float, b: float, n1: float, n0: float) -> float:
    """Twice the log-likelihood ratio of a of n1 toxic and b of n0 other documents, signed by the direction."""
    total, p = a + b, n1 / max(n1 + n0, 1)
    if not total or not 0 < p < 1:
        return 0.0
    q = a / total
    g = sum(2 * x * math.log(y / z) for x, y, z in ((a, q, p), (b, 1 - q, 1 - p)) if x)
    return g if q > p else -g


def learn_terms(sample: DataFrame, least_gain: float = 32.0, precision: float = 0.75) -> tuple[dict[str, float], dict[str, str]]:
    """The lexicon's terms, and what is beneath its stems, from (text, label): by document counts first, then by distinct
    places of the promising terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                by: tuple[Counter, Counter] = (Counter(), Counter())
                for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
                    by[label].update({t for t, _ in _terms_of(_WORD.findall((text or "").lower()))})
                terms = list(by[0].keys() | by[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([by[1][t] for t in terms], pa.int64()), pa.array([by[0][t] for t in terms], pa.int64())], ["term", "a", "b"])

    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return {}, {}
    counted = sample.select("text", "label").mapInArrow(count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    share = n1 / (n1 + n0)
    lean = F.col("a") / (F.col("a") + F.col("b"))
    promising = counted.where((lean >= precision / 2) & (2 * F.col("a") * F.log(F.lit(1 / share)) >= least_gain))
    # The sample bounds them.
    chosen = {r["term"] for r in promising.select("term").collect()}
    if not chosen:
        return {}, {}
    shared = sample.sparkSession.sparkContext.broadcast(chosen)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        wanted = shared.value
        for batch in batches:
            for part in slices(batch):
                found = set()
                for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
                    words = _WORD.findall((text or "").lower())
                    for t, i in _terms_of(words):
                        if t in wanted:
                            found.add((t, xxhash.xxh64_intdigest(" ".join(words[max(0, i - 1) : i] + words[i + 1 : i + 2])) >> 1, label))
                rows = list(found)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.int32())], ["term", "place", "label"])

    spread = sample.select("text", "label").mapInArrow(places, "term string, place long, label int").distinct().groupBy("term").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    rows = [(r["term"], r["a"], r["b"]) for r in spread.where(F.col("a") >= 5).collect()]
    good = {t: (a, b, _gain(a, b, n1, n0)) for t, a, b in rows if a / (a + b) >= precision and _gain(a, b, n1, n0) >= least_gain}
    terms: dict[str, float] = {}
    for t, (a, b, _) in sorted(good.items(), key=lambda x: (len(x[0].rstrip("*")), -x[1][2])):
        stem = t.rstrip("*")
        if any(stem[:k] + "*" in terms for k in STEMS if k < len(stem) or (k == len(stem) and not t.endswith("*"))):
            continue
        terms[t] = round(math.log((a + 0.5) / (b + 0.5) * n0 / n1) / math.log(10), 3)
    # A stem stands for its words where letters are right; edits are measured to the words themselves.
    beneath = {}
    for t, a, b in rows:
        stem = next((s for k in STEMS if (s := t.rstrip("*")[:k] + "*") in terms), None)
        if stem and t not in terms and a / (a + b) >= precision:
            beneath[t] = stem
    return terms, beneath


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.0, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-6 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w += step
        if abs(step).max() < 1e-6:
            break
    return tuple(w)


def fit_lexicon(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Lexicon:
    """Learns from at most sample_rows labelled rows, taken by a hash of their doc_id."""
    known = labelled(labels, "toxic").orderBy(F.md5(F.col("id").cast("string"))).limit(sample_rows)
    sample = saved(texts_of(docs).join(known, F.col("doc_id") == F.col("id")).select("doc_id", "text", "label"), "toxic-sample")
    terms, beneath = learn_terms(sample)
    if not terms:
        return Lexicon()

    def near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms, beneath=beneath)
        for batch in batches:
            for part in slices(batch):
                found = set()
                for text in part.column("text").to_pylist():
                    found.update(w for w, got in lexicon.hits((text or "").lower()).items() if got[1])
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["word"])

    # Words within an edit of a term: as many as such words there are, whatever the sample's size.
    clean = frozenset(r["word"] for r in sample.where("label = 0").select("text").mapInArrow(near_words, "word string").distinct().collect())

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms, clean, beneath=beneath)
        for batch in batches:
            for part in slices(batch):
                x = [lexicon.features(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), part.column("label")], ["x", "label"])

    rows = sample.select("text", "label").mapInArrow(vectors, "x array<double>, label int").collect()
    weights = _logistic(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float))
    return Lexicon(terms, clean, weights, beneath)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, into: str = "score") -> DataFrame:
    """docs with a score column."""
    terms, clean, weights, beneath = lexicon.terms, lexicon.clean, lexicon.weights, lexicon.beneath
    made: list[Lexicon] = []

    def run(texts: list[bytes]) -> list:
        if not made:
            made.append(Lexicon(terms, clean, weights, beneath))
        return [made[0].score([x.decode() for x in texts])]

    return map_text(docs, run, f"{into} double")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(texts_of(docs), fit_lexicon(docs, labels))
    return scored.select("doc_id", (crc_mod5() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs whose score is below the threshold. Rows travel whole, in a struct, so their columns may have any names."""
    rows = docs.select(F.col("text").cast("string").alias("text"), whole_row(docs).alias("row"))
    return score_toxicity(rows, fit_lexicon(docs, labels)).where(F.col("score") < threshold).select("row.*")
