"""Collocations: tries against plain counting, the operator against brute force with any number of blocks, and exactness."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import phrases as P


def brute(rows, least, most=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", low):
            w = re.findall("[^\\x20\\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    candidates = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= least}
    inside = defaultdict(int)
    for (lang, w), c in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], c)
    by = defaultdict(list)
    for (lang, w), a in candidates.items():
        if 100 * inside[lang, w] >= 100 * a:
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        by[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for lang, own in by.items() for i, (score, a, p, left, right) in enumerate(sorted(own)[:most]))


def awkward():
    r = random.Random(4)
    some = lambda k: "".join(r.choice(["new york", "a", "b", "é", "\U0001f600", "a b c d e f", "New", "York"]) + r.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " \x00 ", "\x1c"]) for _ in range(k))
    rows = [(r.choice(["en", "fr", None]), some(r.randint(0, 60))) for _ in range(60)]
    return [*rows, ("en", None), (None, None), ("en", ""), ("de", "x"), ("en", "word " * 500), ("en", "word " * 500), ("fr", some(4000))]


@pytest.mark.parametrize(("block", "chunk"), [(200_000, 4_000_000), (7, 500)])
def test_collocations_like_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(P, "CHUNK_BYTES", chunk)
    rows = awkward()
    docs = spark.createDataFrame([(*r, "p", 3) for r in rows], "lang string, text string, phrase string, score int").repartition(4)
    for least, most in ((3, 2000), (10, 5)):
        got = sorted(tuple(r) for r in P.collocations(docs, least, most, block).collect())
        assert got == brute(rows, least, most)
    assert P.collocations(docs.where("false")).count() == 0


def test_products_beyond_64_bits(spark):
    docs = spark.createDataFrame([("en", "a b")], "lang string, text string")
    a, n, left, right = 3 * 10**10, 10**13, 4 * 10**10, 5 * 10**10
    exact = spark.sql(f"select cast(cast(1000 * cast({a}L as decimal(15,0)) as decimal(19,0)) * cast({n}L as decimal(19,0)) as decimal(38,0)) div cast(cast({left}L as decimal(19,0)) * cast({right}L as decimal(19,0)) as decimal(38,0)) as x").first().x
    assert exact == 1000 * a * n // (left * right) and P.collocations(docs, 1).first().score == 2000


@settings(max_examples=150, deadline=None)
@given(st.sets(st.tuples(st.sampled_from("xy"), st.lists(st.sampled_from("abcdefgh"), min_size=2, max_size=5).map(tuple)), max_size=40), st.lists(st.integers(0, 9), max_size=60))
def test_trie_like_plain_counts(phrases, codes):
    phrases = sorted(phrases)
    trie = P.Trie([(lang, [w.encode() for w in words]) for lang, words in phrases])
    words = [c.encode() for c in "hgfedcbaz"]
    for lang in "xyz":
        total = np.zeros(len(phrases), np.int64)
        trie.count(lang, words, np.array(codes, np.int32), total)
        text = [None if c == 0 else words[c - 1].decode() for c in codes]
        want = [sum(tuple(text[i : i + len(p)]) == p for i in range(len(text) - len(p) + 1)) if own == lang else 0 for own, p in phrases]
        assert total.tolist() == want
