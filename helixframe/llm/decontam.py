"""Benchmark decontamination by a generalised suffix automaton of the test items' words.

A document's words are streamed through the automaton, which keeps the longest match that ends at each word. A word is hit
if it lies in a match of `window` words, or in a whole item of fewer words (the coverage limit). Items are taken in blocks
of about block_words words, numbered by hashes; each block has an automaton of its own, of a size so bounded, whose items are
broadcast. The documents pass a few blocks' automata in a stage, without a shuffle. If there are more blocks, each stage
gives only the hits of documents that have any; so neither a task nor the driver ever holds more than `at_once` blocks,
however large the benchmark is, and texts are not written between stages.

Nulls: a null text has no words; a null item_id is written as an empty string. Items of equal id count once. Documents are
rows of their own, whatever their doc_id. Empty documents have no hits; an empty benchmark gives none anywhere. A very long
text is streamed like others. Other columns are kept, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import arrow_schema, as_bytes, saved, slices, texts_of, whole_row, word_spans

#: Lower case; all ASCII that is neither letter nor digit to a space.
NORMAL = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else (c + 32 if chr(c).isupper() else 32) for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[32] = True


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class ItemAutomaton:
    """All substrings of the items. States have the length of their longest string and a link to the longest proper
    suffix of another state. deep[s]: the state of the last `window` words; ends[s]: the nearest suffix that is a short item."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.words.setdefault(w, len(self.words)) for w in words]) for name, words in items if words]
        last_states = []
        for _, codes in coded:
            last = 0
            for code in codes:
                last = self._extend(last, code)
            last_states.append(last)
        n = len(self.next)
        whole: list[set[str]] = [set() for _ in range(n)]
        for (name, codes), state in zip(coded, last_states, strict=True):
            if len(codes) < window:
                whole[state].add(name)
        order = sorted(range(n), key=self.length.__getitem__)
        self.deep, self.ends = [0] * n, [0] * n
        for s in order[1:]:
            up = self.link[s]
            self.deep[s] = self.deep[up] or (s if self.length[s] >= window else 0)
            self.ends[s] = s if whole[s] else self.ends[up]
        self.whole = whole
        self.items: dict[int, set[str]] = {}
        for name, codes in coded:
            s = 0
            for i, code in enumerate(codes):
                s = self.next[s][code]
                if i + 1 >= window:
                    self.items.setdefault(self.deep[s], set()).add(name)

    def _extend(self, last: int, code: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(code)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, code, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and code not in nxt[p]:
            nxt[p][code] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][code]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, code, q)
        return new

    def _clone(self, p: int, code: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = twin
        while p >= 0 and nxt[p].get(code) == q:
            nxt[p][code] = twin
            p = link[p]
        return twin

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit runs [first, last) in words, and the items with a window that occurs."""
        runs: list[tuple[int, int]] = []
        found: set[str] = set()
        nxt, link, length, window, deep, ends = self.next, self.link, self.length, self.window, self.deep, self.ends
        state = matched = 0
        for i, code in enumerate(map(self.words.get, words)):
            if code is None:
                state = matched = 0
                continue
            while (to := nxt[state].get(code)) is None and state:
                state = link[state]
                matched = length[state]
            if to is None:
                continue
            state, matched = to, matched + 1
            size = 0
            if matched >= window:
                size = window
                found |= self.items[deep[state]]
            at = state if length[state] <= matched else link[state]
            at = ends[at]
            if at:
                size = max(size, length[at])
                while at:
                    found |= self.whole[at]
                    at = ends[link[at]]
            if size:
                start = i + 1 - size
                while runs and runs[-1][1] >= start:
                    start = min(start, runs.pop()[0])
                runs.append((start, i + 1))
        return runs, found


def merge_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, window: int, block_words: int) -> tuple[DataFrame, int]:
    """(block, item, words) and the number of blocks: the items' words, joined by spaces, in blocks of about block_words words by
    their hashes. An item too long for a tenth of a block is cut into overlapping parts, which have the same windows."""
    longest = max(window, block_words // 10)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of((text or "").encode())
                parts = [words[at : at + longest] for at in range(0, max(1, len(words) - window + 1), longest - window + 1)] if len(words) > longest else [words]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array([b" ".join(x) for x in parts], pa.binary()), pa.array([*map(len, parts)], pa.int64())], ["item", "words", "n"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    parts = saved(items.mapInArrow(cut, "item string, words binary, n long").where("n > 0").distinct(), "items")
    total = parts.agg(F.sum("n")).first()[0] or 0
    count = max(1, -(-total // block_words))
    return parts.select(F.pmod(F.xxhash64("item", "words"), F.lit(count)).alias("block"), "item", "words"), count


def remove_spans(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without the words of the runs, from a run's first byte to its last."""
    if not runs:
        return text
    starts, ends = word_spans(np.frombuffer(text.translate(NORMAL), np.uint8), _SPACE)
    out, at = [], 0
    for a, b in runs:
        out.append(text[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, text[at:]])


RUNS, ITEMS, WORDS = "__hx_runs", "__hx_items", "__hx_words"


#: Automata that this worker has built, by token: tasks of a worker share them.
_built: dict[str, ItemAutomaton] = {}


def _automaton(token: str, block: list[tuple[str, list[bytes]]], window: int, keep: int) -> ItemAutomaton:
    if token not in _built:
        while len(_built) >= keep:
            _built.pop(next(iter(_built)))
        _built[token] = ItemAutomaton(block, window)
    return _built[token]


def _block(blocks: DataFrame, number: int) -> list[tuple[str, list[bytes]]]:
    """A block, of bounded size, for a broadcast."""
    return [(r["item"], bytes(r["words"]).split()) for r in blocks.where(F.col("block") == number).orderBy("item", "words").collect()]


def _scanner(spark, blocks: DataFrame, numbers: list[int], window: int):
    """scan(texts): (runs, items, number of words) of each text against some blocks."""
    shared = [(uuid.uuid4().hex, spark.sparkContext.broadcast(_block(blocks, n))) for n in numbers]

    def scan(texts: list[bytes]) -> list[tuple[list[tuple[int, int]], list[str], int]]:
        automata = [_automaton(token, block.value, window, len(shared)) for token, block in shared]
        out = []
        for text in texts:
            words = words_of(text)
            found = [a.scan(words) for a in automata]
            runs = merge_runs([r for own, _ in found for r in own]) if len(found) > 1 else found[0][0]
            out.append((runs, sorted(set().union(*(items for _, items in found))), len(words)))
        return out

    return scan


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 500_000, at_once: int = 2) -> DataFrame:
    """docs with __hx_runs (array of [first, last) word numbers, merged), __hx_items (the items, sorted as strings) and
    __hx_words (the number of words); columns of the input that have such a name are replaced.

    If the benchmark has more blocks than are taken at once, documents are written once with a number each, every pass gives
    the numbers and hits of documents that have any, and these are put together and joined to the documents."""
    out = docs.withColumn("text", F.col("text").cast("string")).withColumn(RUNS, F.array().cast("array<array<int>>")).withColumn(ITEMS, F.array().cast("array<string>")).withColumn(WORDS, F.lit(0).cast("long"))
    blocks, count = item_blocks(benchmark, window, block_words)
    spark = docs.sparkSession
    schema = out.schema
    passes = [list(range(at, min(count, at + at_once))) for at in range(0, count, at_once)]
    if len(passes) == 1:
        scan = _scanner(spark, blocks, passes[0], window)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = arrow_schema(schema)
            kind = {name: names.field(name).type for name in names.names}
            for batch in batches:
                for part in slices(batch):
                    got = scan(as_bytes(part.column("text")))
                    made = {RUNS: pa.array([x[0] for x in got], kind[RUNS]), ITEMS: pa.array([x[1] for x in got], kind[ITEMS]), WORDS: pa.array([x[2] for x in got], kind[WORDS])}
                    yield pa.RecordBatch.from_arrays([made.get(name, part.column(i)) for i, name in enumerate(names.names)], names=names.names)

        return out.mapInArrow(run, schema)

    rows = saved(out.select(F.monotonically_increasing_id().alias("n"), "text", whole_row(out).alias("row")), "documents")
    hits = None
    for own in passes:
        scan = _scanner(spark, blocks, own, window)

        def hit(batches: Iterator[pa.RecordBatch], scan=scan) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    got = [(n, runs, items) for n, (runs, items, _) in zip(part.column("n").to_pylist(), scan(as_bytes(part.column("text"))), strict=True) if runs]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.list_(pa.list_(pa.int32()))), pa.array([x[2] for x in got], pa.list_(pa.string()))], ["n", "runs", "items"])

        one = saved(rows.select("n", "text").mapInArrow(hit, "n long, runs array<array<int>>, items array<string>"), "hits")
        hits = one if hits is None else hits.union(one)
    # A document has a row per pass at most. Runs that touch or overlap are one.
    gathered = hits.groupBy("n").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
    last = lambda acc: F.element_at(acc, -1)
    grown = lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))[1] >= x[0]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.array(last(acc)[0], F.greatest(last(acc)[1], x[1]))))).otherwise(F.concat(acc, F.array(x)))
    merged = gathered.select("n", F.aggregate("r", F.array().cast("array<array<int>>"), grown).alias("r"), "i")
    found = rows.join(merged, "n", "left")
    new = {RUNS: F.coalesce("r", F.array().cast("array<array<int>>")), ITEMS: F.coalesce("i", F.array().cast("array<string>")), WORDS: F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")}
    return found.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in out.columns])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without the spans that the benchmark's windows hit; documents without hits stay as they are, byte by byte."""
    found = find_hits(docs.select("text", whole_row(docs).alias("row")), benchmark, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [remove_spans(x, r).decode("utf-8", "ignore") if r else None for x, r in zip(as_bytes(part.column("text")), part.column(RUNS).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], ["row", "cut"])

    schema = T.StructType([found.schema["row"], T.StructField("cut", T.StringType())])
    out = found.select("text", RUNS, "row").mapInArrow(cut, schema)
    hit = F.col("cut").isNotNull()
    new = {"text": F.when(hit, F.col("cut")).otherwise(F.col("row.text")).cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length("cut")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = texts_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("__hx_runs", F.lit(0).cast("long"), lambda acc, r: acc + r[1] - r[0])
    return found.select(
        "doc_id", F.col(WORDS).alias("n_words"), n_hit.alias("n_hit"), F.size("__hx_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__hx_items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


DECONTAM_SQL = r"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(COALESCE(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
b AS (SELECT item_id, list_transform(regexp_extract_all(COALESCE(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM benchmark),
n AS (SELECT item_id, LEAST(len(w), 10) AS k, unnest(range(1, GREATEST(len(w) - 9, 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM n),
ks AS (SELECT DISTINCT k FROM g),
p AS (SELECT doc_id, ks.k, unnest(range(1, len(w) - ks.k + 2)) AS i, w FROM d, ks WHERE len(w) >= ks.k),
h AS (SELECT p.doc_id, p.i, p.k, g.item_id FROM p JOIN g ON g.k = p.k AND g.gram = array_to_string(p.w[p.i:p.i + p.k - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(COALESCE(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(COALESCE(t.n_items, 0) AS BIGINT) AS n_items,
  COALESCE(t.s, sha256('')) AS items_sha256, COALESCE(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
