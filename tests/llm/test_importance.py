"""Importance resampling: hashes against zlib, the query against brute force and SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import importance as I

SF = "/root/testdata/sf0.001"


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)


def runs(words):
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, target):
    own = [(i, len(w := words_of(t)), runs(w)) for i, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in runs(words_of(x)))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in s}
    out = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2]))
    for k, r in enumerate(may[: 5 * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.binary(min_size=1, max_size=9), st.sampled_from([b"x" * 63, b"y" * 64, b"z" * 200])), max_size=6), min_size=1, max_size=5))
def test_features_like_zlib(lines):
    found, counts = I.features_of(lines, 10_000)
    want = [[zlib.crc32(b" ".join(x[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(x) - k + 1)] for x in lines]
    assert counts.tolist() == [*map(len, want)] and [sorted(x.tolist()) for x in np.split(found, np.cumsum(counts)[:-1])] == [*map(sorted, want)]


@settings(max_examples=300, deadline=None)
@given(st.text("aB é0.\n\r", max_size=40))
def test_lines_and_cross_line_runs_are_all_runs(text):
    lines, across = I.cut_text(text.encode(), 10_000)
    inside = [b for line, k in lines.items() for b in runs(words_of(line.decode())) * k]
    assert Counter(inside + across) == Counter(runs(words_of(text)))


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_like_brute_force(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    target = [x for (x,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    assert shown(I.op13_importance(spark, SF)) == brute(docs, target)


def test_awkward_rows(spark):
    long = "\n".join(f"w{k % 97} the same line" for k in range(4000))
    texts = [None, "", "\n\n", "one", "One\nTWO\n\nthree four", long, long, "a " * 25, "a\n" * 25, "é" * 5000 + " b", *(f"words {k} of some line\nheader line\nand " + "so on " * (k % 13) for k in range(80))]
    rows = [(i if i % 17 else None, t, "r", 1) for i, t in enumerate(texts)] + [(7, "a " * 25, "r", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, digest int").repartition(5)
    target = spark.createDataFrame([("some line and so",), (None,), ("the same line\nw3",)], "text string")
    want = brute([r[:2] for r in rows], ["some line and so", None, "the same line\nw3"])
    got = I.draw(I.weigh(docs, target), range_rows=10)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    # Rows that agree in all that decides the order may stand in for one another.
    assert shown(got) == want
    none = spark.createDataFrame([], "doc_id long, text string")
    assert I.draw(I.weigh(none, target)).count() == 0
    assert shown(I.draw(I.weigh(docs, target.where("false")))) == brute([r[:2] for r in rows], [])
