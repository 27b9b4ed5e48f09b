"""The ten operators and the pipeline against brute force, on awkward rows and on the smallest tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import decontam, fingerprints, lm, mixing, quality, queries, repeats, simhash, substring_dedup, suffix_dedup, toxicity, warc
from helixframe.llm.common import saved, word_hashes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _hash string, body int, fp string, score string, _runs int"


def awkward():
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    r = random.Random(5)
    words = ["".join(r.choices("abcdeé", k=r.randint(1, 7))) for _ in range(300)]
    some = lambda n: " ".join(r.choices(words, k=n))
    shared, long = some(80), some(3000)
    texts = [None, "", "  \n\t ", "one", "ONE", "two words", shared, shared, some(30) + " " + shared + "\n" + some(20), "x" + shared, long, long + " tail", "a " * 400, "a " * 400, some(200), "é" * 250, "é" * 251, some(5), "\U0001f600 ok " * 60]
    rows = [(i * 3, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), "h", i, "f", "s", i) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], (None, shared, None, None, None, None, None, None, None, None), (7, shared + " end", "x", "s0", 3, "h", 1, "f", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return saved(spark.createDataFrame(awkward(), SCHEMA).repartition(3, "body"), "awkward")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i * 3, i % 2, i % 3 == 0 and 1 or 0) for i in range(12)] + [(None, 1, 1), (3, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")


def last(i):
    return 2**63 - 1 if i is None else i


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# op3 and op6


def brute_words(rows, width=50):
    first = {}
    parsed = [(last(i), (t or "").encode().split()) for i, t in rows]
    for i, w in parsed:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, w), (own, _) in zip(parsed, rows, strict=True):
        gone = bytearray(len(w))
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = b"\1" * width
        out.append((own, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def kept_bytes(rows, width=100):
    """(the bytes of the text, a flag for each that goes), in the order of the rows."""
    first = {}
    keyed = [(last(i), xxhash.xxh64_intdigest((t or "").encode(), 42), (t or "").encode()) for i, t in rows]
    for i, h, b in keyed:
        for k in range(len(b) - width + 1):
            s = b[k : k + width]
            first[s] = min(first.get(s, (i, h, k)), (i, h, k))
    out = []
    for i, h, b in keyed:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < (i, h, k):
                gone[k : k + width] = b"\1" * width
        out.append((b, gone))
    return out


def brute_bytes(rows, width=100):
    out = []
    for (b, gone), (own, _) in zip(kept_bytes(rows, width), rows, strict=True):
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((own, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats_like_brute_force(spark, docs, hot, monkeypatch):
    # hot=1 asks about every repeated anchor with longer keys.
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for module, brute, one in ((substring_dedup, brute_words, substring_dedup.dedup_substrings), (suffix_dedup, brute_bytes, suffix_dedup.dedup_bytes)):
        scheme = module.scheme()
        scheme.hot = hot
        monkeypatch.setattr(module, "scheme", lambda *a, s=scheme: s)
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"] if module is substring_dedup else ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        assert rows_of(one(docs).select(*names)) == brute(rows)


def thue_morse(n, a="a", b="b"):
    """Words whose polynomial hashes modulo 2^64 agree, whatever the base."""
    return "".join((a, b)[k.bit_count() & 1] for k in range(n)), "".join((b, a)[k.bit_count() & 1] for k in range(n))


def test_unlike_words_are_never_taken_for_equal(spark):
    one, two = thue_morse(2048)
    words = [f"w{i}" for i in range(59)]
    texts = [" ".join([*words[:30], x, *words[30:]]) for x in (one, two)] + [one * 2, two + one, "x " * 3 + one]
    rows = [(i * 5, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(substring_dedup.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256"))
    assert got == brute_words(rows) and got[0][2] == 0 and all(r[2] == 0 for r in got)
    assert rows_of(suffix_dedup.dedup_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == brute_bytes(rows)
    # In lm, a word that is only in the held-out rows is unknown.
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    scored = {r.doc_id: r for r in lm.score_texts(spark.createDataFrame([(held, two), *((i, one) for i in range(50) if zlib.crc32(str(i).encode()) % 5 != 1)], "doc_id long, text string")).collect()}
    assert scored[held].n_known == 1 and scored[held].n_tokens == 2


def test_forced_hash_collisions_change_nothing(spark, docs, monkeypatch):
    """Hashes only propose: with hashes of a few bits the results are the same."""
    r = random.Random(2)
    texts = [bytes(r.choices(b"ab", k=140)) for _ in range(30)]
    numbers = np.full(30, 41)
    shards = np.repeat(np.arange(6), 5)
    want = suffix_dedup.repeated_windows(np.frombuffer(b"".join(texts), np.uint8), numbers + 99, shards, 100, 25)
    words = [" ".join(r.choices("abc", k=14)).encode() for _ in range(40)]
    right = substring_dedup.alike_words(words, np.full(40, 9), 6)
    weak = lambda prefix, k, base=0: (suffix_dedup_gram(prefix, k, base) & np.uint64(3))
    suffix_dedup_gram = suffix_dedup.gram_hash
    monkeypatch.setattr(suffix_dedup, "gram_hash", weak)
    monkeypatch.setattr(substring_dedup, "gram_hash", weak)
    sets = lambda found: sorted(sorted(zip(*(x[found[2] == g].tolist() for x in found[:2]), strict=True)) for g in np.unique(found[2]))
    more = lambda groups: [g for g in groups if len(g) > 1]
    assert more(sets(suffix_dedup.repeated_windows(np.frombuffer(b"".join(texts), np.uint8), numbers + 99, shards, 100, 25))) == sets(want)
    assert more(sets(substring_dedup.alike_words(words, np.full(40, 9), 6))) == sets(right)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**63), min_size=1, max_size=200, unique=True), st.integers(0, 3))
def test_merged_sketches_never_underestimate(keys, seed):
    r = np.random.default_rng(seed)
    keys = np.sort(np.array(keys, np.uint64))
    true, merged = Counter(), [Counter(), Counter()]
    for _ in range(4):
        own = keys[r.random(len(keys)) < 0.5]
        true.update(own.tolist())
        for row, (cell, held) in enumerate(repeats.counters(own, np.ones(len(own), np.int64), 2, 6)):
            for c, n in zip(cell.tolist(), held.tolist(), strict=True):
                merged[row][c] += n
    for k in keys:
        assert min(merged[row][int(repeats.cells(np.array([k]), row, 6)[0])] for row in range(2)) >= true[int(k)]


def test_repeats_on_given_tables(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert rows_of(substring_dedup.op3_substring_dedup(spark, SF)) == brute_words(rows)
    assert rows_of(suffix_dedup.op6_suffix_dedup(spark, SF)) == brute_bytes(rows)


def crafted():
    """Texts with two grams whose hashes agree in the leading 45 bits, so that the places of grams decide."""
    letters = "zugwgoxhaoylstprpeqfasxdmrdjsvgwjntxbqdvnztbsxuhrgmcygbsdfafiwemmvhcqbfldalmzkgixqhjyebbhtziehnheyxo"
    words = "1954 3363 2739 2711 3136 2394 2827 1865 3263 1250 3169 2627 3979 967 6 2148 414 1228 2245 2122 216 1413 2927 2008 7 11 2442 1177 2080 3571 739 1053 1452 1108 3934 380 551 1490 140 3975 1603 2916 2097 107 2455 3802 3354 3526 1292 523"
    return letters, " ".join(f"w{x}" for x in words.split())


def test_anchors_do_not_depend_on_the_length_of_a_piece(spark):
    letters, words = crafted()
    r = random.Random(8)
    some = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    rows = [(1, some(1000) + letters + some(300_000)), (2, some(20) + letters + some(20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {x.doc_id: x.n_removed for x in suffix_dedup.dedup_bytes(docs).collect()} == {1: 0, 2: 100}
    other = lambda n: " ".join(f"x{r.randrange(10**9)}" for _ in range(n))
    rows = [(1, f"{other(500)} {words} {other(300_000)}"), (2, f"{other(5)} {words} {other(5)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {x.doc_id: x.n_removed for x in substring_dedup.dedup_substrings(docs).collect()} == {1: 0, 2: 50}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 600), st.integers(0, 600), st.integers(2, 40), st.integers(0, 2**32))
def test_a_window_has_one_anchor(before, after, letters, seed):
    r = np.random.default_rng(seed)
    window = r.integers(0, letters, 100).astype(np.uint8)
    alone = repeats.runs_of(suffix_dedup.BYTE_VALUE[window], np.array([100]), 100, 32)
    data = np.concatenate([r.integers(0, letters, before), window, r.integers(0, letters, after)]).astype(np.uint8)
    runs = repeats.runs_of(suffix_dedup.BYTE_VALUE[data], np.array([len(data)]), 100, 32)
    (at,) = np.flatnonzero((runs.first <= before) & (runs.last >= before))
    assert runs.anchor[at] == alone.anchor[0]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=60, unique=True), st.sampled_from([1, 2, 16, 1 << 40]))
def test_messages_go_to_buckets_that_have_keys(keys, buckets):
    keys = np.sort(np.array(keys, np.uint64))
    found = list(repeats.by_bucket(keys, buckets))
    assert len(found) <= len(keys) and [k for _, i, j in found for k in range(i, j)] == list(range(len(keys)))
    assert all(int(k) * buckets >> 64 == b for b, i, j in found for k in keys[i:j]) and [b for b, _, _ in found] == sorted({b for b, _, _ in found})


def test_repeats_of_nothing(none):
    assert substring_dedup.dedup_substrings(none).count() == 0
    assert suffix_dedup.dedup_bytes(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=8, max_size=40), min_size=1, max_size=8), st.sampled_from([1, 2, 4, 8]), st.data())
def test_merged_transforms_find_all_repeated_windows(texts, q, data):
    bytes_ = np.frombuffer("".join(texts).encode(), np.uint8)
    sizes = np.array([*map(len, texts)])
    shards = np.sort(np.array(data.draw(st.lists(st.integers(0, 3), min_size=len(texts), max_size=len(texts)))))
    string, place, group = suffix_dedup.repeated_windows(bytes_, sizes, shards, 8, q)
    found = defaultdict(set)
    for s, p, g in zip(string.tolist(), place.tolist(), group.tolist(), strict=True):
        found[g].add((s, p))
    want = defaultdict(set)
    for s, t in enumerate(texts):
        for p in range(len(t) - 7):
            want[t[p : p + 8]].add((s, p))
    assert sorted(map(sorted, found.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)
    # With symbols of one byte, what neighbours have in common is the longest common prefix.
    symbols = suffix_dedup.Symbols(bytes_, sizes, 1)
    where = np.r_[0, np.cumsum(sizes + 1)]
    bounds = where[np.r_[0, np.flatnonzero(np.diff(shards)) + 1, len(shards)]].tolist()
    suffixes, common = suffix_dedup.merge_shards(symbols, suffix_dedup.shard_orders(symbols, bounds, 8), 8)
    rest = [texts[symbols.string[x]][symbols.place[x] :] for x in suffixes.tolist()]
    for a, b, n in zip(rest, rest[1:], common[1:].tolist(), strict=False):
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert n == min(8, same) or (n > same and not a[same:] and not b[same:])


def test_long_texts_are_hashed_like_short_ones():
    text = b"ab  cde\nf " * 50 + b"w" * 90 + b" end"
    whole, n = word_hashes([text, b"", b"x y"])
    cut, m = word_hashes([text, b"", b"x y"], piece=33)
    assert np.array_equal(whole, cut) and np.array_equal(n, m) and n.tolist() == [len(text.split()), 0, 2]


# op9


def brute_simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), last(None)), last(i))
    return [least[find(k)] for k in range(len(ids))]


def test_simhash_like_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    prints = [brute_simhash(t) for _, t in rows]
    want = sorted(zip([last(i) for i, _ in rows], prints, brute_components([i for i, _ in rows], prints), strict=True))
    got = sorted((last(r.doc_id), r.fp % 2**64, last(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_links_of_crowded_fingerprints(spark):
    r = random.Random(3)
    bases = [r.getrandbits(64) for _ in range(4)]
    prints = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in bases for _ in range(120)} | {0, 1, 2**63, 2**64 - 1}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    got = {(r.a % 2**64, r.b % 2**64) for r in simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    listed = sorted(prints)
    want = {frozenset((a, b)) for i, a in enumerate(listed) for b in listed[:i] if (a ^ b).bit_count() <= 2}
    assert {frozenset(x) for x in got} == want and len(got) == len(want)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 202), (201, 202)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 140)) and got[202] == got[201] == 200


def test_one_row_per_component_stays(spark, docs, none):
    kept = simhash.keep_one_per_component(docs)
    assert kept.columns == docs.columns
    comps = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(last(r.doc_id) for r in kept.collect()) == sorted(map(last, comps))
    assert simhash.keep_one_per_component(none).count() == 0


def test_one_row_per_component_stays_without_or_with_repeated_ids(spark):
    r = random.Random(4)
    a, b, c, d, e = (" ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(30)) for _ in range(5))
    rows = [(None, a, 1), (None, b, 2), (None, b, 3), (None, c, 4), (5, c, 5), (7, d, 6), (7, e, 7), (7, e, 8), (3, e.upper(), 9)]
    kept = simhash.keep_one_per_component(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    assert sorted(kept.collect(), key=lambda x: x.n) == [(None, a, 1), (None, b, 2), (5, c, 5), (7, d, 6), (3, e.upper(), 9)]


# op10


def brute_hits(text, items, window=10):
    w = decontam.words_of((text or "").encode())
    hit, found = set(), set()
    for name, words in items:
        n = min(window, len(words))
        grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(name)
    return hit, found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5), st.lists(st.sampled_from("abcd"), max_size=40))
def test_automaton_like_brute_force(items, words):
    items = [(str(i), [x.encode() for x in w]) for i, w in enumerate(items)]
    runs, found = decontam.ItemAutomaton(items, 4).scan([x.encode() for x in words])
    hit, want = brute_hits(" ".join(words), items, 4)
    assert {k for a, b in runs for k in range(a, b)} == hit and found == want


@pytest.mark.parametrize("block_words", [500_000, 12])
def test_decontamination_blocks(spark, docs, block_words):
    texts = [r.text for r in docs.collect() if r.text and len(r.text.split()) > 40]
    items = [(1, " ".join(texts[0].split()[5:30])), (2, "two words"), (None, "ok " + "\U0001f600"), (4, None), (2, "two words"), (5, " ".join(texts[-1].split()[:12]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    parsed = [("" if i is None else str(i), decontam.words_of((t or "").encode())) for i, t in items]
    got = decontam.find_hits(docs, bench, 10, block_words)
    for r in got.collect():
        hit, found = brute_hits(r.text, parsed)
        assert {k for a, b in r["__hx_runs"] for k in range(a, b)} == hit and r["__hx_items"] == sorted(found)
        assert r["__hx_words"] == len(decontam.words_of((r.text or "").encode()))
    crowded = docs.selectExpr("*", "doc_id as __hx_runs", "text as __hx_items", "1 as row", "text as cut", "2 as `a.b`")
    clean = decontam.decontaminate(crowded, bench)
    assert clean.columns == crowded.columns and clean.dtypes == crowded.dtypes
    want = []
    for r in crowded.collect():
        hit, _ = brute_hits(r.text, parsed)
        words = decontam.words_of((r.text or "").encode())
        want.append((r.body, r["__hx_runs"], [w for k, w in enumerate(words) if k not in hit], r.text if not hit else "?"))
    got = [(r.body, r["__hx_runs"], decontam.words_of((r.text or "").encode()), r.text) for r in clean.collect()]
    for a, b in zip(sorted(got, key=lambda x: str(x[:3])), sorted(want, key=lambda x: str(x[:3])), strict=True):
        assert a[:3] == b[:3] and b[3] in ("?", a[3])


# op8, op1


def brute_mix(rows):
    sizes = [(i, s, len((t or "").encode().split())) for i, t, s in rows]
    names = sorted({s for _, s, _ in sizes}, key=lambda s: (s is None, (s or "").encode()))
    per = {s: sum(n for _, x, n in sizes if x == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped, level = sum(per.values()), set(), {}
    while True:
        rest = total - sum(3 * per[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        level = {s: 3 * per[s] if s in capped else rest * weight[s] / w for s in names}
        more = {s for s in names if s not in capped and level[s] > 3 * per[s]}
        if not more:
            return sizes, per, level
        capped |= more


def test_mixture_like_brute_force(spark, docs, none):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    sizes, per, level = brute_mix(rows)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r.source_size == per[r.source] and r.target == pytest.approx(level[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - level[s]) <= 1 for s in per)
    assert rows_of(mixing.mix_sources(docs)) == rows_of(mixing.mix_sources(docs.repartition(5)))
    assert mixing.mix_sources(none).count() == 0


def test_archive_round_trip(spark, tmp_path):
    big, bigger = "<p>\r\n\r\nWARC/1.1\r\n" + "x" * 2000, "é" * 1500
    rows = [(1, "http://a", big, 1), (2, "http://b", big, 1), (3, None, None, 1), (4, "u r\r\nl", "", 1), (5, "http://c", "small", 1), (6, "http://d", "small", 1), (None, "n", bigger, 1), (None, "n", bigger, 1), (7, "x", big, 1), (7, "x", big, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    records, payloads = (saved(x, "t") for x in warc.archive_tables(pages))
    assert payloads.count() == len({r[2] or "" for r in rows})
    got = rows_of(warc.read_records(records, payloads).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"))
    body = lambda t: (t or "").encode()
    want = [(i, len(body(t)), hashlib.sha1(body(t)).hexdigest(), "revisit" if t == big and i != 7 else "response", 7 if t == big and i != 7 else None, u or "urn:x-none") for i, u, t, _ in rows]
    assert got == sorted(want, key=str)
    warc.write_warc(records, payloads, str(tmp_path / "w"))
    back, blocks = warc.read_warc(spark, str(tmp_path / "w"))
    assert sorted(bytes(r.headers) for r in back.collect()) == sorted(bytes(r.headers) for r in records.collect())
    whole = {r.digest: bytes(r.payload) for r in warc.reconstruct(back, blocks).collect()}
    assert whole == {r.digest: bytes(r.payload) for r in warc.reconstruct(records, payloads).collect()}
    # Damage is found: another payload under a digest, a payload that is gone, a header that says otherwise.
    digest = hashlib.sha256(big.encode()).hexdigest()
    other = payloads.where("digest != '" + digest + "'")
    for bad in (payloads.withColumn("packed", F.when(F.col("digest") == digest, F.lit(zstandard.ZstdCompressor().compress(b"forged"))).otherwise(F.col("packed"))), other):
        for read in (warc.read_records(records, bad).select("page_id", "payload_digest"), warc.read_records(records, bad).select("payload_bytes"), warc.reconstruct(records, bad)):
            with pytest.raises(Exception, match="payload missing or damaged"):
                read.collect()
    lied = records.withColumn("headers", F.regexp_replace(F.col("headers").cast("string"), "sha1:0", "sha1:1").cast("binary"))
    lied = lied.unionByName(records.withColumn("headers", F.regexp_replace(F.col("headers").cast("string"), "Content-Length: 5", "Content-Length: 6").cast("binary")))
    with pytest.raises(Exception, match="unlike its record"):
        warc.read_records(lied, payloads).select("payload_digest").collect()
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(*warc.archive_tables(empty)).count() == 0


# op2


@settings(max_examples=60, deadline=None)
@given(st.text("abé\U0001f600", max_size=30), st.text("abé\U0001f600", max_size=30), st.integers(0, 9), st.integers(0, 9))
def test_extension_like_brute_force(a, b, i, j):
    i, j = min(i, len(a)), min(j, len(b))
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    x, y = (fingerprints.Prefixes(fingerprints.points(t)) for t in (a, b))
    assert fingerprints.common_extension(x, i, y, j) == n
    assert fingerprints.likeness(fingerprints.print_text(a), fingerprints.print_text(a)) == 1.0


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_fingerprints_like_brute_force(spark, docs, none):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    want = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t)
        edited = t[: n - n // 3] + after[: n // 3]
        p, e, q = map(fingerprints.print_text, (t, edited, after))
        want.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), p, e, fingerprints.likeness(p, e), fingerprints.likeness(p, q)))
    assert rows_of(fingerprints.document_fingerprints(docs).drop("common_prefix")) == sorted(want, key=str)
    assert fingerprints.document_fingerprints(none).count() == 0
    # Rows without an id, or all with one, spread over many ranges and give the same.
    for own in (None, 4):
        same = docs.withColumn("doc_id", F.lit(own).cast("long"))
        texts = sorted(((r.text or "") for r in docs.collect()), key=lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42)))
        got = fingerprints.document_fingerprints(same, range_bytes=500)
        follow = [t[: len(t) - len(t) // 3] + a[: len(t) // 3] for t, a in zip(texts, [*texts[1:], texts[0]], strict=True)]
        assert sorted(r.edited_sha256 for r in got.collect()) == sorted(hashlib.sha256(x.encode()).hexdigest() for x in follow)


# op4, op5, op7


def auc(rows, column, truth):
    pos, neg = [r.score for r in rows if truth.get(r.doc_id) == 1], [r.score for r in rows if truth.get(r.doc_id) == 0]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)


@pytest.mark.parametrize(("run", "column", "least", "sf"), [(quality.op4_quality, "quality", 0.99, "sf0.01"), (toxicity.op7_toxicity, "toxic", 0.95, "sf0.1")])
def test_held_out_accuracy(spark, run, column, least, sf):
    sf = f"/root/testdata/{sf}"
    truth = dict(duckdb.sql(f"select doc_id, {column} from '{sf}/labels.parquet'").fetchall())
    rows = run(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert auc([r for r in rows if r.held_out], column, truth) >= least


def plain_statistics(text):
    """A text's statistics, one after the other."""
    kinds = quality.KINDS.values()
    words = text.split()
    n = max(len(words), 1)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    spread = lambda x: math.log((x + 0.002) / (1.002 - x))
    shares = [sum(c in k for c in text) / max(len(text), 1) for k in kinds]
    most = max(Counter(words).values(), default=0)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [math.log1p(len(text)), math.log1p(len(words)), *map(spread, shares), math.log1p(len(text) / n), spread(len({*words}) / n), spread(most / n), spread(same / n), spread(len({*grams}) / max(len(grams), 1))]


def test_quality_like_brute_force(spark):
    docs, labels = (duckdb.sql(f"select * from '{SF}/{t}.parquet'") for t in ("documents", "labels"))
    texts = {i: plain_statistics((t or "").encode()) for i, t in docs.select("doc_id, text").fetchall()}
    truth = {i: q for i, q in labels.select("doc_id, quality").fetchall() if q is not None and i in texts and zlib.crc32(str(i).encode()) % 5}
    x = {k: np.array([texts[i] for i, q in truth.items() if q == k]) for k in (0, 1)}
    cov = {k: np.cov(x[k].T, bias=True) for k in x}
    pooled = sum(len(x[k]) * cov[k] for k in x) / len(truth)
    target = 0.9 * pooled + 0.1 * np.diag(np.diag(pooled))
    own = {k: 0.9 * cov[k] + 0.1 * target + 1e-6 * np.eye(len(pooled)) for k in x}
    def density(k, v):
        d = v - x[k].mean(0)
        return -0.5 * d @ np.linalg.solve(own[k], d) - 0.5 * np.linalg.slogdet(own[k])[1]
    got = {r.doc_id: r for r in quality.op4_quality(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, v in texts.items():
        margin = (density(1, np.array(v)) - density(0, np.array(v))) / 4 + math.log(len(x[1]) / len(x[0]))
        want = 1 / (1 + math.exp(-max(-500, min(500, margin))))
        assert got[i].score == pytest.approx(want, rel=1e-4, abs=1e-9) and got[i].predicted == (got[i].score >= 0.3)


def test_toxicity_like_brute_force(spark):
    """All scores, with every word compared with every term."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.fit_lexicon(docs, labels)
    plain = PlainLexicon(lexicon.terms, lexicon.clean, lexicon.weights, lexicon.beneath)
    got = toxicity.op7_toxicity(spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert lexicon.terms and plain.score([texts[r.doc_id] for r in got]).tolist() == pytest.approx([r.score for r in got])
    assert all(r.predicted == (r.score >= 0.5) for r in got)


def test_classifiers_on_awkward_rows(spark, docs, none, labels):
    for table in (labels, labels.where("false")):
        assert quality.score_quality(docs, table).count() == docs.count()
        scored = toxicity.score_toxicity(docs.select("doc_id", "text"), toxicity.fit_lexicon(docs, table))
        assert scored.where("score between 0 and 1").count() == docs.count()
        assert toxicity.without_toxic(docs, table).columns == docs.columns
    assert quality.score_quality(none, labels).count() == 0
    assert toxicity.without_toxic(none, labels).count() == 0


def test_learned_terms_like_brute_force(spark):
    """Terms, weights and what is beneath stems, from counts of documents and of distinct places, on labelled rows."""
    sf = "/root/testdata/sf0.01"
    rows = [(t or "", k) for i, t, k in duckdb.sql(f"select doc_id, text, toxic from '{sf}/documents.parquet' join '{sf}/labels.parquet' using (doc_id) where toxic is not null").fetchall() if zlib.crc32(str(i).encode()) % 5]
    n1, n0 = sum(k for _, k in rows), sum(1 - k for _, k in rows)
    seen, places = defaultdict(lambda: [0, 0]), defaultdict(set)
    for text, label in rows:
        words = toxicity._WORD.findall(text.lower())
        found = list(toxicity._terms_of(words))
        for term in {t for t, _ in found}:
            seen[term][label] += 1
        for term, i in found:
            places[term].add((" ".join(words[max(0, i - 1) : i] + words[i + 1 : i + 2]), label))

    def gain(a, b):
        q, p = a / (a + b), n1 / (n1 + n0)
        g = sum(2 * x * math.log(y / z) for x, y, z in ((a, q, p), (b, 1 - q, 1 - p)) if x)
        return g if q > p else -g

    promising = {t for t, (b, a) in seen.items() if a / (a + b) >= 0.375 and 2 * a * math.log((n1 + n0) / n1) >= 32}
    counts = {t: (sum(k for _, k in places[t]), sum(1 - k for _, k in places[t])) for t in promising}
    counts = {t: x for t, x in counts.items() if x[0] >= 5}
    good = {t for t, (a, b) in counts.items() if a / (a + b) >= 0.75 and gain(a, b) >= 32}
    want = {}
    for t in sorted(good, key=lambda t: (len(t.rstrip("*")), -gain(*counts[t]))):
        stem = t.rstrip("*")
        if not any(stem[:k] + "*" in want for k in toxicity.STEMS if k < len(stem) or (k == len(stem) and t == stem)):
            a, b = counts[t]
            want[t] = round(math.log10((a + 0.5) / (b + 0.5) * n0 / n1), 3)
    beneath = {}
    for t, (a, b) in counts.items():
        stems = [t.rstrip("*")[:k] + "*" for k in toxicity.STEMS if t.rstrip("*")[:k] + "*" in want]
        if stems and t not in want and a / (a + b) >= 0.75:
            beneath[t] = stems[0]
    sample = spark.createDataFrame(rows, "text string, label int").repartition(3)
    terms, under = toxicity.learn_terms(sample)
    assert terms == want and under == beneath and terms


def test_lexicon_finds_misspelt_and_quoted_words():
    lexicon = toxicity.Lexicon({"nitwit": 3.0, "blockh*": 3.0}, frozenset({"nitwits"}))
    assert lexicon.find("nitwit") == ("nitwit", 0) and lexicon.find("nitvit") == ("nitwit", 1) and lexicon.find("nitit") == ("nitwit", 1) and lexicon.find("anitwit") == ("nitwit", 1)
    assert lexicon.find("blockheads") == ("blockh*", 0) and lexicon.find("blokheads") == ("blockh*", 1)
    assert lexicon.find("nitwits") is None and lexicon.find("other") is None
    direct, quoted = lexicon.features("you nitwit go"), lexicon.features('he wrote "you nitwit" there')
    assert direct[0] > 0 == direct[2] and quoted[2] > 0 == quoted[0]


def edits(a, b):
    """Optimal string alignment distance."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=3, max_size=8), min_size=1, max_size=6), st.sets(st.text("abc", min_size=4, max_size=7), max_size=4), st.lists(st.text("abcd", min_size=1, max_size=10), max_size=12), st.data())
def test_edits_like_brute_force(words, stems, others, data):
    terms = {w: 1.0 for w in words} | {f"{s}*": 1.0 for s in stems}
    lexicon = toxicity.Lexicon(terms)
    near = []
    for t in [*words, *(s + data.draw(st.text("abcd", max_size=3)) for s in stems)]:
        at, c = data.draw(st.integers(0, len(t))), data.draw(st.sampled_from("abcd"))
        near += [t[:at] + t[at + 1 :], t[:at] + c + t[at:], t[:at] + c + t[at + 1 :], t[:at] + t[at + 1 : at + 2] + t[at : at + 1] + t[at + 2 :]]
    for w in {*others, *near}:
        if not w:
            continue
        exact = w in words or any(w.startswith(s) for s in stems)
        close = len(w) >= 3 and (any(edits(w, t) <= 1 for t in words if len(t) >= 4) or any(edits(w[:k], s) <= 1 for s in stems if len(s) >= 5 for k in range(len(w) + 1)))
        got = lexicon.find(w)
        assert (got is not None) == (exact or close) and (got is None or (got[1] == 0) == exact), w


class PlainLexicon(toxicity.Lexicon):
    """Finds words by comparing them with every term."""

    def _find(self, word):
        whole = [t for t in self.terms if t == word]
        stems = [t for t in self.terms if t.endswith("*") and word.startswith(t[:-1])]
        if whole or stems:
            return (whole or [max(stems, key=len)])[0], 0
        if len(word) < 3 or word in self.clean:
            return None
        near = []
        for t, own in [*((t, t) for t in self.terms), *self.beneath.items()]:
            stem = t.rstrip("*")
            if t != stem and len(t) >= 6:
                near += [own for k in range(len(stem) - 1, len(stem) + 2) if close(word[:k], stem)]
            elif t == stem and len(t) >= 4 and close(word, t):
                near.append(own)
        return (min(near), 1) if near else None


def close(a, b):
    return abs(len(a) - len(b)) <= 1 and len({*a} ^ {*b}) <= 2 and edits(a, b) <= 1


def test_misspelt_stem_is_found():
    assert toxicity.Lexicon({"blockh*": 1.0}).find("vlockheads") == ("blockh*", 1)


def test_learned_lexicon_finds_misspelt_words(spark):
    r = random.Random(8)
    plain = ["".join(r.choices("bcdfghjklnqvwxz", k=r.randint(4, 8))) for _ in range(400)]
    toxic = ["stupid", "idiot", "scum", "pathetic", "worthless"]
    rows = [(i, " ".join(r.choices(plain, k=20) + (r.choices(toxic, k=4) + r.choices(plain, k=5) if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(450)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.fit_lexicon(docs, docs.selectExpr("doc_id", "0 as quality", "toxic"))
    assert "stup*" in lexicon.terms
    for right, term in (("stupid", "stup*"), ("idiot", "idio*"), ("scum", "scum"), ("pathetic", "path*"), ("worthless", "wort*")):
        wrong = [right[:1] + right[2:], right[:2] + "y" + right[2:], right[:1] + "y" + right[2:], right[:1] + right[2] + right[1] + right[3:], right[1] + right[0] + right[2:], "y" + right]
        assert [lexicon.find(x) for x in wrong] == [(term, 1)] * len(wrong), right
    for text in ("st0pid", "1d1ot", "$tupid", "i-diot", "st*pid", "stu.pid", "w0rthle$s", "p@thetic"):
        assert len(lexicon.hits(f"so {text} now")) == 1 and lexicon.features(f"so {text} now")[1] > 0, text
    assert not lexicon.hits(" ".join(plain)) and not lexicon.hits("b2b x-ray 2024 3.14 user@example.com")


def test_language_model_like_brute_force(spark, docs, none):
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [None]) for r in docs.collect()]
    train = [w for i, w in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    count = Counter(x for w in train for x in w)
    pairs = Counter(p for w in train for p in zip(w, w[1:], strict=False))
    n, v = sum(count.values()), len(count)
    got = lm.score_texts(docs).collect()
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {n}
    want = sorted((len(w), sum(count[x] > 0 for x in w), round(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for _, w in rows)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    triples = Counter(p for w in train for p in zip(w, w[1:], w[2:], strict=False))

    def one(x):
        return (count[x] - lm.DISCOUNT) / n if count[x] else lm.DISCOUNT * v / n

    def two(h, x):
        return lm.S2 * pairs[h, x] / (count[h] + lm.M2) + (1 - lm.S2 * count[h] / (count[h] + lm.M2)) * one(x) if count[h] >= 2 else one(x)

    def three(g, h, x):
        return lm.S3 * triples[g, h, x] / (pairs[g, h] + lm.M3) + (1 - lm.S3 * pairs[g, h] / (pairs[g, h] + lm.M3)) * two(h, x) if pairs[g, h] >= 2 else two(h, x)

    def score(w):
        p = [one(w[0]), *(two(w[0], x) for x in w[1:2]), *(three(*t) for t in zip(w, w[1:], w[2:], strict=False))]
        return sum(map(math.log10, p))

    everything = [*count, "never seen"]
    assert sum(map(one, everything)) == pytest.approx(1)
    for (g, h), c in pairs.most_common(5):
        assert sum(two(h, x) for x in everything) == pytest.approx(1) and c >= 2 and sum(three(g, h, x) for x in everything) == pytest.approx(1)
    assert sorted((r.n_tokens, round(r.score, 6)) for r in got) == sorted((len(w), round(score(w), 6)) for _, w in rows)
    assert sorted((r.n_tokens, round(r.score, 6)) for r in lm.score_texts(docs, shard_bytes=2000).collect()) == sorted((r.n_tokens, round(r.score, 6)) for r in got)
    assert lm.score_texts(none).count() == 0
    held = [r for r in lm.op5_language_model(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


# The pipeline and the driver's SQL


def test_pipeline_on_awkward_rows(spark, docs, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "two words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, none):
        out = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            names = out.columns
            out = saved(stage(spark, out, str(tmp_path)), "stage")
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == names
    assert out.count() == 0


NAMES = ["a.b", "row", "row.text", "cut", "id", "sha", "label", "keep", "own1", "own2", "n", "x", "c0", "v", "none", "back`tick", "__hx_k1", "__hx_k2", "__hx_n", "__hx_keep", "__hx_score", "__hx_d", "__hx_h", "__hx_kept", "__hx_runs", "__hx_items", "__hx_words"]


def test_stages_keep_columns_whatever_their_names(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "two words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = [c for c in docs.columns if c not in ("text", "n_chars")]
    crowded = saved(docs.select("*", *[F.concat(F.lit(f"{k}:"), F.col("body")).alias(c) for k, c in enumerate(NAMES)]), "crowded")
    given = Counter((r[own.index("body")], r) for r in (tuple(x[c] for c in [*own, *NAMES]) for x in crowded.collect()))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, out = saved(stage(spark, docs, str(tmp_path)), "plain"), saved(stage(spark, crowded, str(tmp_path)), "stage")
        assert out.dtypes == crowded.dtypes
        assert sorted(((x.body or -1, x.text, x.n_chars) for x in out.collect()), key=str) == sorted(((x.body or -1, x.text, x.n_chars) for x in plain.collect()), key=str)
        assert not Counter((r[own.index("body")], r) for r in (tuple(x[c] for c in [*own, *NAMES]) for x in out.collect())) - given
    assert corpus_pipeline.STAGES[-1][1](spark, crowded, str(tmp_path)).count() == docs.count()


def test_pipeline_like_its_parts(spark):
    """Every stage against the operator's brute-force version on the stage's own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(saved(stage(spark, steps[-1], SF), "stage"))
    rows = [[(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()] for d in steps[:5]]
    lexicon = toxicity.fit_lexicon(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    plain = PlainLexicon(lexicon.terms, lexicon.clean, lexicon.weights, lexicon.beneath)
    scores = plain.score([t or "" for _, t in rows[0]])
    assert {i for i, _ in rows[1]} == {i for (i, _), x in zip(rows[0], scores.tolist(), strict=True) if x < 0.5}
    prints = [brute_simhash(t) for _, t in rows[1]]
    assert {i for i, _ in rows[2]} == set(brute_components([i for i, _ in rows[1]], prints))
    assert dict(rows[2]).items() <= dict(rows[1]).items()
    want = {i: t if not any(gone) else bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore") for (i, t), (b, gone) in zip(rows[2], kept_bytes(rows[2]), strict=True)}
    assert dict(rows[3]) == want and len(rows[3]) == len(rows[2])
    items = [(str(i), decontam.words_of(t.encode())) for i, t in duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()]
    for (i, before), (j, after) in zip(sorted(rows[3]), sorted(rows[4]), strict=True):
        hit, _ = brute_hits(before, items)
        assert i == j and decontam.words_of(after.encode()) == [w for k, w in enumerate(decontam.words_of(before.encode())) if k not in hit]
        assert hit or before == after
    sizes, per, level = brute_mix([(r.doc_id, r.text, r.source) for r in steps[4].collect()])
    taken = Counter()
    for r in steps[5].collect():
        assert r.size == len((dict(rows[4])[r.doc_id] or "").encode().split()) and 0 <= r.taken <= 3 * r.size
        taken[r.source_size, round(r.target, 4)] += r.taken
    assert dict(taken) == pytest.approx({(per[x], round(level[x], 4)): level[x] for x in per}, abs=1) and sum(n for _, _, n in sizes) == sum(per.values())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    shown = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted((shown(r) for r in df.select(*names).collect()), key=str) == sorted((shown(r) for r in want.fetchall()), key=str)


def test_sliding_minimum():
    x = np.random.default_rng(0).integers(0, 50, 60).astype(np.uint64)
    for w in (1, 2, 3, 5, 8, 13):
        assert repeats.sliding_min(x, w).tolist() == [int(x[i : i + w].min()) for i in range(60 - w + 1)]


def test_repeats_send_nothing_by_way_of_the_driver(spark):
    docs = spark.createDataFrame([(i, "all the same words again and again " * 20 + str(i)) for i in range(8)], "doc_id long, text string")
    for df in (suffix_dedup.dedup_bytes(docs), suffix_dedup.without_repeats(docs)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r.n_removed > 0 for r in suffix_dedup.dedup_bytes(docs).orderBy("doc_id").collect()] == [True] * 8
