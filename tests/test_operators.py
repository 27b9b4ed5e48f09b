"""What SQL does not cover: exact tests, alignments, chains, permutations, spatial clusters, greedy choices, formats."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.functions import variants as V
from helixframe.operators import filters, gram, mapping, merging, pairs, ranges, sets, sites, structure, windows
from helixframe.operators.autozygosity import autozygous_runs
from helixframe.sources import tables, vcf


def exact_by_enumeration(het, hom1, hom2):
    """All ways to pair 2n chromosomes, by the multinomial of genotype counts."""
    from math import factorial as f

    n, rare = het + hom1 + hom2, 2 * min(hom1, hom2) + het
    weight = {}
    for h in range(rare % 2, rare + 1, 2):
        a = (rare - h) // 2
        weight[h] = 2**h * f(n) / (f(h) * f(a) * f(n - h - a))
    total = sum(weight.values())
    own = weight[het]
    return sum(w for w in weight.values() if w <= own * (1 + 1e-9)) / total, sum(w for h, w in weight.items() if h <= het) / total, sum(w for h, w in weight.items() if h >= het) / total


@pytest.mark.parametrize(("het", "hom1", "hom2"), [(0, 0, 0), (1, 0, 0), (5, 3, 2), (0, 5, 5), (10, 0, 0), (3, 20, 1), (7, 2, 30)])
def test_exact_hwe(het, hom1, hom2):
    assert sites.exact_hwe([het], [hom1], [hom2])[0] == pytest.approx(exact_by_enumeration(het, hom1, hom2))


def test_exact_hwe_in_blocks():
    r = np.random.default_rng(4)
    triples = r.integers(0, 12, (200, 3))
    want = np.array([exact_by_enumeration(*map(int, x)) for x in triples])
    assert sites.exact_hwe(*triples.T, most=50) == pytest.approx(want) and sites.exact_hwe([], [], []).shape == (0, 3)
    far = sites.exact_hwe([40_000], [30_000], [30_000])[0]
    assert np.isfinite(far).all() and 0 <= far[0] <= 1


def test_event_types_and_trimming(spark):
    given_pairs = [("A", "C", "s1"), ("A", "ACGT", "i+3"), ("ACGT", "A", "i-3"), ("ACGT", "ACT", "i-1"), ("A", ".", "r0"), ("A", "<ID>", "u0"), ("ACG", "AGC", "s2"), ("A", ".A", "b"), ("A", "A.", "b"), ("A", "A[1:5[", "b"), ("ACGT", "AAA", "o3")]
    made = {("A", "C"): "C", ("A", "ACGT"): "CGT", ("ACGT", "A"): "CGT", ("ACGT", "ACT"): "G", ("ACGT", "AAA"): "AAA", ("A", "."): "A", ("A", "<ID>"): "<ID>", ("ACG", "AGC"): "AGC"}
    df = spark.createDataFrame(given_pairs, "ref string, alt string, want string").withColumn("got", V.event_type(F.col("ref"), F.col("alt")))
    assert all(r.got == r.want for r in df.collect())
    assert all(r.sequence == made.get((r.ref, r.alt)) for r in df.withColumn("sequence", V.event(F.col("ref"), F.col("alt"))["sequence"]).collect())
    n = spark.createDataFrame([("TATATATA", "TATATA", 5)], "ref string, alt string, pos long").select(V.normalised(F.col("ref"), F.col("alt"), F.col("pos")).alias("n")).first()["n"]
    assert (n["pos"], n["ref"], n["alt"]) == (5, "TAT", "T")


def test_identical_peptides_align_without_gaps():
    a, b, score = structure.align_pair("IKKILSKIKKLLK", "IKKILSKIKKLLK")
    assert a == b == "IKKILSKIKKLLK" and score == sum(structure.BLOSUM62[i][i] for i in map(structure.LETTERS.index, a))


@settings(max_examples=25, deadline=None)
@given(st.text("ACDW", min_size=1, max_size=5), st.text("ACDW", min_size=1, max_size=5))
def test_alignment_is_the_best(a, b):
    x, y, score = structure.align_pair(a, b)
    assert x.replace("-", "") == a and y.replace("-", "") == b and score == pytest.approx(cost(x, y))
    best = max(cost(*p) for p in all_alignments(a, b))
    assert score == pytest.approx(best)


def cost(x, y):
    total, last = 0.0, None
    for p, q in zip(x, y, strict=True):
        kind = "b" if q == "-" else "a" if p == "-" else None
        total += structure.BLOSUM62[structure.LETTERS.index(p)][structure.LETTERS.index(q)] if kind is None else (-0.5 if kind == last else -10.0)
        last = kind
    return total


def all_alignments(a, b):
    if not a and not b:
        yield "", ""
    if a and b:
        for x, y in all_alignments(a[1:], b[1:]):
            yield a[0] + x, b[0] + y
    if a:
        for x, y in all_alignments(a[1:], b):
            yield a[0] + x, "-" + y
    if b:
        for x, y in all_alignments(a, b[1:]):
            yield "-" + x, b[0] + y


@pytest.mark.parametrize(("distance", "bin_width"), [(37, 1000), (37, 1), (37, 3), (900, 1), (1, 2), (5000, 1)])
def test_thinning_is_greedy(spark, distance, bin_width):
    r = random.Random(distance)
    rows = [(i, f"chr{i % 3}", r.randint(1, 5000)) for i in range(400)] + [(500, "chr0", None), (501, None, 7)]
    kept = {x.vid for x in filters.thin(spark.createDataFrame(rows, "vid long, chrom string, pos long"), distance, bin_width).collect()}
    want = set()
    for c in ("chr0", "chr1", "chr2"):
        last = None
        for i, _, p in sorted((x for x in rows if x[1] == c and x[2] is not None), key=lambda x: (x[2], x[0])):
            if last is None or p - last >= distance:
                want.add(i)
                last = p
    assert kept == want
    assert filters.thin(spark.createDataFrame([], "vid long, chrom string, pos long"), distance).count() == 0


def test_range_join_like_all_pairs(spark):
    r = random.Random(2)
    a = [(i, r.choice("xy"), s, s + r.choice([0, 1, 5, 900])) for i, s in enumerate(r.choices(range(3000), k=120))]
    b = [(i, r.choice("xy"), s, s + r.choice([1, 40, 2000])) for i, s in enumerate(r.choices(range(3000), k=80))]
    x, y = spark.createDataFrame(a, "i long, c string, s long, e long"), spark.createDataFrame(b, "j long, d string, t long, f long")
    got = sorted((q.i, q.j) for q in ranges.range_join(x, y, ("c", "s", "e"), ("d", "t", "f"), width=64).collect())
    assert got == sorted((p[0], q[0]) for p, q in itertools.product(a, b) if p[1] == q[1] and p[2] < q[3] and q[2] < p[3])


def test_clusters_like_brute_force(spark):
    r = np.random.default_rng(4)
    pts = np.vstack([r.normal(c, 1.0, (25, 3)) for c in (0, 12, 30)] + [r.uniform(-50, 80, (15, 3))])
    rows = [(i, "S", *map(float, p)) for i, p in enumerate(pts)]
    got = {x.res_id: x.cluster for x in mapping.clusters(spark.createDataFrame(rows, "res_id long, structid string, x double, y double, z double"), 1.6, 4).collect()}
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2)) <= 1.6
    core = d.sum(1) >= 4
    label = {i: i for i in np.flatnonzero(core)}
    for _ in range(len(pts)):
        label = {i: min(label[j] for j in label if d[i, j]) for i in label}
    want = {i: label.get(i, min((label[j] for j in label if d[i, j]), default=None)) for i in range(len(pts))}
    assert got == want


def test_autozygous_runs_are_found(spark):
    r = random.Random(3)
    v, calls = [], []
    for k in range(600):
        v.append((k, "chr1", k * 20_000 + 1, "A", ["C"]))
        for s in range(8):
            inside = s == 0 and 200 <= k < 420
            a = r.randint(0, 1)
            calls.append((k, s, a, a if inside else r.randint(0, 1)))
    got = autozygous_runs(spark.createDataFrame(v, "vid long, chrom string, pos long, ref string, alts array<string>"), spark.createDataFrame(calls, "vid long, sample int, a1 int, a2 int")).collect()
    own = [x for x in got if x["sample"] == 0]
    assert own and max(x.n_sites for x in own) > 150 and all(x.n_sites < 60 for x in got if x["sample"] != 0)


def test_diff_of_a_set_with_itself_is_all_both(spark):
    a = spark.createDataFrame([("1", 5, "A"), ("1", 9, "AT"), ("2", 5, "N")], "chrom string, pos long, ref string")
    assert {r.kind for r in merging.diff_sites(a, a).collect()} == {"B"}


def merged_one_by_one(a, b):
    out = []
    for chrom in sorted({x[0] for x in a + b}):
        one, two = (sorted((p, r) for c, p, r in own if c == chrom) for own in (a, b))
        while one or two:
            if not two:
                kind = "1"
            elif not one:
                kind = "2"
            elif one[0][0] == two[0][0]:
                kind = "B" if one[0][1] == two[0][1] or {one[0][1], two[0][1]} & {"N", ".", ""} else "O"
            elif one[0][0] < two[0][0]:
                kind = "O" if two[0][0] < one[0][0] + len(one[0][1]) else "1"
            else:
                kind = "O" if one[0][0] < two[0][0] + len(two[0][1]) else "2"
            x, y = one.pop(0) if kind != "2" else None, two.pop(0) if kind != "1" else None
            out.append((chrom, x and x[0], y and y[0], kind, x and x[1], y and y[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [3, 17, 100_000])
def test_merge_of_sorted_lists_like_one_by_one(spark, width):
    r = random.Random(width)
    for reach, span in ((6, 120), (40, 120), (3, 900)):
        a, b = ([(r.choice("xy"), r.randint(1, span), r.choice(["A", "N", "", "AC" * r.randint(1, reach), "A" * r.randint(1, reach)])) for _ in range(n)] for n in (70, 60))
        a.append(("z", 5, "ACGT"))
        got = merging.diff_sites(*(spark.createDataFrame(x, "chrom string, pos long, ref string").repartition(3) for x in (a, b)), bin_width=width)
        assert sorted((tuple(x) for x in got.collect()), key=str) == merged_one_by_one(a, b)
    none = spark.createDataFrame([], "chrom string, pos long, ref string")
    assert merging.diff_sites(none, none, width).count() == 0


def test_joined_chunks_have_the_haplotypes_that_they_were_cut_from(spark):
    """Chunks of phased haplotypes, each sample's turned over at random, with some wrong calls: joined, they are the haplotypes
    again, up to turning a whole phase set, and sets end where chunks don't overlap."""
    r = random.Random(6)
    truth = {(s, p): (0, 1) if r.random() < 0.5 else (1, 0) for s in range(6) for p in range(0, 900, 5)}
    spans = [(0, 300), (200, 500), (400, 600), (605, 900)]
    rows = []
    for k, (a, b) in enumerate(spans):
        for s in range(6):
            turned = r.random() < 0.5
            for p in range(a, b, 5):
                x, y = truth[s, p]
                wrong = r.random() < 0.02
                x, y = (1, 1) if wrong else (x, y)
                rows.append((s, f"c{k}", p, *((y, x) if turned else (x, y)), True, 3.0 if p == 100 else 50.0))
    calls = spark.createDataFrame(rows, "sample int, chunk string, pos long, a1 int, a2 int, phased boolean, pq double").repartition(3)
    chunks = spark.createDataFrame([(f"c{k}", "1", k * 10) for k in range(4)], "chunk string, chrom string, rank long")
    for least_pq, starts in ((None, [0, 605]), (20.0, [0, 100, 605])):
        told, joined = windows.phase_join(calls, chunks, 3.0, least_pq)
        got = joined.collect()
        assert len(got) == len({(x["sample"], x.pos) for x in got}) == 6 * len({p for a, b in spans for p in range(a, b, 5)})
        assert sorted({x.ps for x in got}) == starts
        for s in range(6):
            for ps in starts:
                own = [(x.a1, x.a2) == truth[s, x.pos] for x in got if x["sample"] == s and x.ps == ps and x.a1 != x.a2]
                assert own and (all(own) or not any(own))
        rows_ = {(x["sample"], x["rank"]): x for x in told.collect()}
        assert all(rows_[s, 30].n_sites == 0 and rows_[s, 30].quality == 0 and rows_[s, 10].quality > 3 for s in range(6)) and (0, 0) not in rows_


def test_chunks_with_many_calls_at_one_position_join_without_their_pairs(spark, monkeypatch):
    made = []
    monkeypatch.setattr(windows, "saved", lambda df, name: made.append(df) or df)
    rows = [(s, c, 5, k % 2, 1 - k % 2, True) for s in (1, 2) for c in ("a", "b") for k in range(300)]
    calls, chunks = spark.createDataFrame(rows, "sample int, chunk string, pos long, a1 int, a2 int, phased boolean"), spark.createDataFrame([("a", "1", 0), ("b", "1", 1)], "chunk string, chrom string, rank long")
    told, joined = windows.phase_join(calls, chunks)
    assert [(x.n, x.wrong, x.n_same, x.n_cross) for x in made[0].collect()] == [(90_000, 0, 45_000, 45_000)] * 2
    assert {x.n_sites for x in told.collect()} == {90_000} and joined.count() == 600


@settings(max_examples=200, deadline=None)
@given(st.text("ACDW", max_size=14), st.text("ACDWX", max_size=14), st.sampled_from([(-10.0, -0.5), (-2.0, -1.0), (-3.0, -0.5)]), st.sampled_from([1, 6, 30]))
def test_halved_alignments_are_as_good(a, b, costs, cells):
    want = structure.align_pair(a, b, *costs)
    x, y, score = structure.align_pair(a, b, *costs, cells=cells)
    assert score == want[2] and x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(y)
    rank = {c: i for i, c in enumerate(structure.LETTERS)}
    own, gap = 0.0, ""
    for p, q in zip(x, y, strict=True):
        assert (p, q) != ("-", "-")
        side = "a" if p == "-" else "b" if q == "-" else ""
        own += structure.BLOSUM62[rank[p]][rank[q]] if not side else costs[1] if side == gap else costs[0]
        gap = side
    assert own == score


def test_long_alignment_takes_little_memory():
    import tracemalloc

    r = random.Random(1)
    a = "".join(r.choices("ACDEFGHIKLMNPQRSTVWY", k=6000))
    b = a[:1000] + a[1300:4000] + "W" * 200 + a[4000:]
    tracemalloc.start()
    x, y, _ = structure.align_pair(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150_000_000 and x.count("-") == 200 and y.count("-") == 300


def test_scans_do_not_depend_on_bins(spark):
    """Chains of intervals, dense runs and running sums against loops, for bins and ranges of any size."""
    r = random.Random(2)
    rows = [(k, r.choice("xy"), r.randint(0, 3000), r.choice([1, 2, 30, 400])) for k in range(150)]
    df = spark.createDataFrame(rows, "vid long, chrom string, a long, n long").withColumn("b", F.col("a") + F.col("n"))
    want, dense = {}, set()
    for chrom in "xy":
        number, reach = 0, None
        for a, k, n in sorted((a, k, n) for k, c, a, n in rows if c == chrom):
            number += reach is None or a > reach + 5
            reach = max(reach or 0, a + n)
            want[k] = number
        places = sorted((a, k) for k, c, a, _ in rows if c == chrom)
        for a, _ in places:
            run = [k for p, k in places if a <= p < a + 60]
            dense |= set(run) if len(run) >= 4 else set()
    for width in (7, 90, 100_000):
        assert {x.vid: x.chain for x in ranges.chains(df, "a", "b", 5, ("vid",), width).collect()} == want
        assert {x.vid for x in filters.snp_cluster(df.withColumnRenamed("a", "pos"), 4, 60, width).collect()} == dense
    order = {k: i + 1 for c in "xy" for i, (_, k) in enumerate(sorted((a, k) for k, own, a, _ in rows if own == c))}
    for width in (11, 100_000):
        assert {x.vid: x["rank"] for x in ranges.ranked(df.withColumnRenamed("a", "pos"), "vid", width).collect()} == order
    values = spark.createDataFrame([(float(k) * 1.5, k % 3, k) for k in range(40)], "q double, u long, v long").repartition(3)
    for each in (6, 100_000):
        got = ranges.running_sums(values, "q", ["u", "v"], each).collect()
        assert all(x.u_below == sum(k % 3 for k in range(x.v)) and x.v_above == sum(range(x.v + 1, 40)) for x in got) and len(got) == 40


@pytest.mark.parametrize("size", [3, 10, 64, 1000])
def test_consensus_like_one_by_one(spark, size):
    r = random.Random(size)
    contigs = {"x": "".join(r.choices("ACGT", k=300)), "y": "".join(r.choices("acgt", k=77)), "z": "", "w": "ACGTACGTAC"}
    rows = []
    for c, seq in contigs.items():
        for _ in range(len(seq) // 2):
            pos, n = r.randint(1, len(seq) + 2), r.choice([1, 1, 2, 5, 40])
            ref = seq[pos - 1 : pos - 1 + n].upper()
            rows.append((c, pos, r.choice([ref, ref, ref, "ACT"]), r.choice(["", "T", "GATTACA", "G"])))
    rows += rows[:5] + [("w", 1, "ACGTACGTAC", "T"), ("other", 1, "A", "T")]
    want = {}
    for c, seq in contigs.items():
        out, at = [], 0
        for pos, ref, alt in sorted({x[1:] for x in rows if x[0] == c}):
            was = seq[pos - 1 : pos - 1 + len(ref)]
            if ref and pos - 1 >= at and was.upper() == ref:
                out += [seq[at : pos - 1], alt.lower() if was == was.lower() else alt]
                at = pos - 1 + len(ref)
        want[c] = "".join([*out, seq[at:]])
    got = structure.consensus(spark.createDataFrame(list(contigs.items()), "contig string, seq string"), spark.createDataFrame(rows, "contig string, pos long, ref string, alt string").repartition(3), size)
    assert {x.contig: x.seq for x in got.collect()} == want


def test_consensus_deals_its_variants_out_once(spark):
    seqs = {k: "ACGTACGTÄé" * 50 for k in range(20)}
    rows = [(k, 1 + at, seqs[k][at : at + 2], "TTT") for k in seqs for at in range(0, 500, 5)] + [(k, 5, "T", "C") for k in seqs]
    got = structure.consensus(spark.createDataFrame(list(seqs.items()), "contig long, seq string"), spark.createDataFrame(rows, "contig long, pos long, ref string, alt string"), 100)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {x.contig: x.seq for x in got.collect()} == {k: "".join("TTT" + s[at + 2 : at + 5] for at in range(0, 500, 5)) for k, s in seqs.items()}


@pytest.mark.parametrize("width", [4, 50, 100_000])
def test_rows_without_overlaps_like_one_by_one(spark, width):
    r = random.Random(width)
    rows = [(r.choice("ab"), s, s + r.choice([1, 2, 9, 120]), k) for k, s in enumerate(r.randint(0, 900) for _ in range(200))]
    want = set()
    for c in "ab":
        at = 0
        for s, k, e in sorted((s, k, e) for c_, s, e, k in rows if c_ == c):
            if s >= at:
                want.add(k)
                at = e
    for slot_rows in (20, 100_000):
        got = merging.without_overlaps(spark.createDataFrame(rows, "contig string, start long, end long, order long"), width, slot_rows)
        assert {x.order for x in got.collect()} == want and got.columns == ["contig", "start", "end", "order"]


def test_vcf_lines_fill_uncalled_cells_without_rows_for_them(spark):
    r = random.Random(3)
    samples = ["c", "a", "d", "b", "e"]
    calls = [(vid, s, 0, 1, False, vid, 9) for vid in range(40) for s in [*samples, "other"] if vid and r.random() < vid / 39]
    v = spark.createDataFrame([(k, "1", k, None, "A", ["T"], 1.0, [], "DP=4") for k in range(40)], "vid long, chrom string, pos long, id string, ref string, alts array<string>, qual double, filters array<string>, info_text string")
    got = vcf.vcf_lines(v, spark.createDataFrame(calls, "vid long, sample string, a1 int, a2 int, phased boolean, dp int, gq int").repartition(3), samples)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    have = {c[:2] for c in calls}
    assert {x.pos: x.value.split("\t")[8:] for x in got.collect()} == {k: ["GT:DP:GQ", *[f"0/1:{k}:9" if (k, s) in have else "./.:.:." for s in samples]] for k in range(40)}


def test_merged_calls_meet_their_site_in_one_join(spark):
    sites = "vid long, chrom string, pos long, ref string, alts array<string>, qual double, filters array<string>"
    a = spark.createDataFrame([(1, "1", 5, "A", ["T", "G"], 1.0, []), (2, "1", 9, "A", [], 1.0, []), (3, "1", 9, "A", None, 1.0, [])], sites)
    b = spark.createDataFrame([(1, "1", 5, "AC", ["C", "TC"], 1.0, []), (2, "1", 7, "A", ["T"], 1.0, [])], sites)
    calls = spark.createDataFrame([(vid, s, x, y) for vid in (1, 2, 3, 4) for s, x, y in ((0, 0, 1), (1, 2, None), (2, 1, 2))], "vid long, sample int, a1 int, a2 int")
    merged = lambda **more: sets.merge_sites({"a": a, "b": b}, {"a": calls, "b": calls}, **more)[1]
    plan = merged()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner, ((src") + plan.count("Join LeftOuter, (((src") == 1
    own = [("a", 1, {1: 3, 2: 2}), ("a", 2, {}), ("a", 3, {}), ("b", 1, {1: 1, 2: 3}), ("b", 2, {1: 1})]
    place = {("a", 1): 5, ("a", 2): 9, ("a", 3): 9, ("b", 1): 5, ("b", 2): 7}
    want = [("1", place[src, vid], src, s, *(0 if x == 0 else new.get(x) for x in pair)) for src, vid, new in own for s, pair in enumerate(((0, 1), (2, None), (1, 2)))]
    assert sorted(map(str, map(tuple, merged().collect()))) == sorted(map(str, want))
    who = spark.createDataFrame([(0,), (7,)], "sample int")
    more = [("1", pos, src, s, 0, 0) for src, pos in (("a", 7), ("b", 9)) for s in (0, 7)]
    assert sorted(map(str, map(tuple, merged(samples={"a": who, "b": who}, missing=0).collect()))) == sorted(map(str, want + more))


def test_rows_meet_a_transcript_once_however_many_references_it_has(spark):
    rows = [(1, "T1.1"), (2, "T1.2"), (3, "T2"), (4, None), (5, "T9")]
    xref = [("T1.1", "P", 1), ("T1.2", "Q", 2), ("T1", "P", 1), ("T2.7", None, 3), (None, "R", 4)]
    own, more = spark.createDataFrame(rows, "iid int, transcript string"), spark.createDataFrame(xref, "transcript string, unp string, n int")
    bare = lambda x, versions: x if versions or x is None else x.split(".")[0]
    for versions in (False, True):
        got = mapping.by_transcript(own, more, versions)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" in plan and plan.index("Generate") < plan.index("Join")
        want = [(i, t, u, n) for i, t in rows for x, u, n in xref if t and x and bare(t, versions) == bare(x, versions)]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and got.columns == ["iid", "transcript", "unp", "n"]


def test_permutation_keeps_labels_and_places(spark):
    df = spark.createDataFrame([("g", i, i * 10) for i in range(50)] + [("h", i, i) for i in range(20)], "group string, place long, label long")
    rows = structure.permutations(df, 2).collect()
    for k in (1, 2):
        assert sorted(r.label for r in rows if r["round"] == k and r.group == "g") == [i * 10 for i in range(50)]
    assert [r.label for r in rows if r["round"] == 1] != [r.label for r in rows if r["round"] == 2]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, structure.permutations(df, 2).collect()))


def test_sorted_sets_follow_one_another(spark):
    r = random.Random(1)
    rows = sorted((r.choice("abc"), r.randint(0, 500)) for _ in range(300))
    frame = lambda own: spark.createDataFrame(own, "chrom string, pos long").coalesce(3)
    apart = [frame(rows[200:]), frame(rows[:90]), frame([x for x in rows[90:200] if x > rows[89] and x < rows[200]])]
    out = sets.concat(apart, are_sorted=True)
    got = [tuple(x) for x in out.collect()]
    assert got == sorted(got) and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    crossing = sets.concat([*apart, frame(rows[150:260]).withColumn("x", F.lit(1))], pad=True, are_sorted=True)
    places = [tuple(x)[:2] for x in crossing.collect()]
    assert places == sorted(places) and len(places) == len(got) + 110 and crossing.columns == ["chrom", "pos", "x"]
    assert sets.first_unsorted(frame(rows)) is None
    with pytest.raises(ValueError, match="not sorted at b:7"):
        sets.concat([frame([("a", 1), ("b", 9), ("b", 7)])], are_sorted=True)


def test_scratch_tables_can_be_removed(spark, monkeypatch):
    from pathlib import Path

    from helixframe.sources import scratch

    monkeypatch.setattr(scratch, "_made", [])
    df = scratch.saved(spark.range(3).toDF("x"), "some")
    (made,) = (Path(x.removeprefix("file://")) for x in scratch._made)
    beside = Path(str(made) + "-beside")
    beside.mkdir()
    assert df.count() == 3 and made.is_dir()
    assert scratch.remove_made(spark) == 1 and not made.exists() and beside.is_dir() and scratch.remove_made(spark) == 0


def test_heads_of_many_and_long_files(spark, tmp_path):
    import gzip

    (tmp_path / "in").mkdir()
    want = {}
    for k in range(20):
        head = ["##fileformat=VCFv4.2", *(f"##contig=<ID=c{i},length={i}>" for i in range(k * 300)), "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO" + ("\tFORMAT\té" if k % 2 else "")]
        body = [] if k % 5 == 0 else [f"1\t{i}\t.\tA\tC\t.\t.\t." for i in range(k * 50)]
        text = "\n".join([*head, *body]) + ("\n" if k % 3 else "")
        name = f"f{k}.vcf" + (".gz" if k % 4 == 0 else "")
        with (gzip.open if k % 4 == 0 else open)(tmp_path / "in" / name, "wb") as file:
            file.write(text.encode())
        want[name] = head
    for piece in (7, 1 << 16):
        got = vcf.file_heads(spark, str(tmp_path / "in"), piece) if piece > 100 else {n: h for n, h in vcf.file_heads(spark, str(tmp_path / "in" / "f1.vcf"), piece).items()}
        assert {n.rpartition("/")[2]: h for n, h in got.items()} == (want if piece > 100 else {"f1.vcf": want["f1.vcf"]})


def test_vcf_round_trip(spark, tmp_path):
    text = "##fileformat=VCFv4.2\n##INFO=<ID=DP,Number=1,Type=Integer,Description=\"d\">\n##INFO=<ID=AF,Number=A,Type=Float,Description=\"f\">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\n1\t10\trs1\tA\tC,G\t29.5\tPASS\tDP=4;AF=0.5,.;DB\tGT:DP\t0|2:7\t./.:.\n1\t12\t.\tG\t.\t.\t.\t.\tGT\t0\t1/1\n"
    (tmp_path / "a.vcf").write_text(text)
    v, h = vcf.read_vcf(spark, str(tmp_path / "a.vcf"), prepend_chr=True)
    rows = v.orderBy("pos").select("chrom", "pos", "id", "alts", "qual", "filters", vcf.typed_info(F.col("info"), "DP", h).alias("dp"), vcf.typed_info(F.col("info"), "AF", h).alias("af"), vcf.typed_info(F.col("info"), "DB", h).alias("db")).collect()
    assert [tuple(r) for r in rows] == [("chr1", 10, "rs1", ["C", "G"], 29.5, [], 4, [0.5, None], True), ("chr1", 12, None, [], None, None, None, None, False)]
    calls = sorted((r.pos, r["sample"], r.a1, r.a2, r.ploidy, r.phased, r.dp) for r in vcf.parse_calls(v, h).collect())
    assert calls == [(10, "A", 0, 2, 2, True, 7), (10, "B", None, None, 2, False, None), (12, "A", 0, None, 1, False, None), (12, "B", 1, 1, 2, False, None)]
    lines = vcf.vcf_lines(v.withColumn("info_text", F.lit("DP=4")).withColumn("vid", F.col("pos")))
    vcf.write_vcf(lines, str(tmp_path / "out"), [], {"DP": ("Integer", "1")})
    again, _ = vcf.read_vcf(spark, str(tmp_path / "out"))
    assert sorted((r.chrom, r.pos) for r in again.collect()) == [("chr1", 10), ("chr1", 12)]
    vcf.store(v, str(tmp_path / "store"))
    assert [r.pos for r in vcf.region_scan(spark, str(tmp_path / "store"), "chr1", 11, 13).collect()] == [12]


def test_fasta_keeps_its_last_record(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">UPI0000000001 status=active\nABC\nDEF\n>UPI0000000002 status=inactive\nX\n>UPI0000000003 status=active\nMARGS\nVIL\n")
    got = {r.uniparc: r.seq for r in tables.active_uniparc(tables.read_fasta(spark, str(tmp_path / "a.fa"))).collect()}
    assert got == {"UPI0000000001": "ABCDEF", "UPI0000000003": "MARGSVIL"}


def test_breakends(spark):
    alts = ["G]17:198982]", "]13:123456]T", "C[<ctg1>:7[", "<DEL>", "A.", ".TG", "ACC"]
    got = [r.x for r in spark.createDataFrame([(a,) for a in alts], "a string").select(vcf.parse_alt(F.col("a")).alias("x")).collect()]
    assert [g.alt_type for g in got] == ["breakend"] * 3 + ["symbolic", "single_breakend", "single_breakend", "substitution"]
    assert [(g.chrom, g.pos, g.seq, g.within_main) for g in got[:3]] == [("17", 198982, "G", True), ("13", 123456, "T", True), ("ctg1", 7, "C", False)]


def test_pairs_of_many_samples(spark):
    """More samples than a word has bits; each with gaps of its own."""
    r = random.Random(6)
    calls = {(v, s): (r.randint(0, 1), r.randint(0, 1), r.random() < 0.7) for v in range(4) for s in range(150) if r.random() < 0.8}
    v = spark.createDataFrame([(k, "chr1", 10 + k, ["C"]) for k in range(4)], "vid int, chrom string, pos long, alts array<string>")
    c = spark.createDataFrame([(v_, s, *x) for (v_, s), x in calls.items()], "vid int, sample int, a1 int, a2 int, phased boolean")
    near = pairs.near_pairs(v, c, 100)
    for row in pairs.genotype_r2(near).collect():
        xy = [(sum(calls[row.vid, s][:2]), sum(calls[row.vid2, s][:2])) for s in range(150) if (row.vid, s) in calls and (row.vid2, s) in calls]
        assert row.n_indv == len(xy) and row.r2 == pytest.approx(np.corrcoef(np.array(xy).T)[0, 1] ** 2, abs=1e-6)
    for row in pairs.genotype_chisq(near).collect():
        table = np.zeros((3, 3))
        for s in range(150):
            if (row.vid, s) in calls and (row.vid2, s) in calls:
                table[sum(calls[row.vid, s][:2]), sum(calls[row.vid2, s][:2])] += 1
        want = np.outer(table.sum(1), table.sum(0)) / table.sum()
        assert row.chisq == pytest.approx(((table - want) ** 2 / want).sum(), abs=1e-6) and row.dof == 4
    for row in pairs.haplotype_r2(near).collect():
        both = [s for s in range(150) if all((k, s) in calls and calls[k, s][2] for k in (row.vid, row.vid2))]
        h = np.array([(calls[row.vid, s][i], calls[row.vid2, s][i]) for s in both for i in (0, 1)])
        assert row.n_chr == len(h) and row.r2 == pytest.approx(np.corrcoef(h.T)[0, 1] ** 2, abs=1e-6)


def test_chi_square_p(spark):
    from helixframe.operators.sites import chi_square_p

    rows = [(3.841459, 1, 0.05), (10.827566, 1, 0.001), (5.991465, 2, 0.05), (9.487729, 4, 0.05), (-1e-16, 1, 1.0), (0.0, 0, None)]
    got = spark.createDataFrame(rows, "x double, dof int, want double").select("want", chi_square_p(F.col("x"), F.col("dof")).alias("p")).collect()
    assert all(r.p is None if r.want is None else abs(r.p - r.want) < 1e-6 for r in got)


def test_annotations_are_taken_over_and_removed(spark):
    v = spark.createDataFrame([(1, "chr1", 5, None, "A", ["C"], None, None, {"X": "1", "F": "", "K": "k"}), (2, "chr1", 9, "rs2", "AT", ["A"], 3.0, [], {"X": "2"}), (3, "chr2", 5, None, "A", ["C"], None, None, {})], "vid int, chrom string, pos long, id string, ref string, alts array<string>, qual double, filters array<string>, info map<string,string>")
    t = spark.createDataFrame([("chr1", 1, 6, 1, ".", None, "b", None, ".", "0"), ("chr1", 5, 5, 2, "A", ["T", "C"], "a", ["low"], "7", "0"), ("chr1", 5, 5, 3, "A", ["G"], "no", None, "8", "1"), ("chr1", 9, 9, 4, "ATG", ["AG"], None, None, ".", "1")], "chrom string, start long, end long, rank int, ref string, alts array<string>, id string, filters array<string>, X string, F string")
    got = {r.vid: r for r in sets.annotate_from_table(v, t, {"X": False, "F": True}, match_alleles=True).collect()}
    assert (got[1].id, got[1].filters, got[1].info) == ("a;b", ["low"], {"X": "7", "K": "k"})
    assert (got[2].id, got[2].qual, got[2].filters, got[2].info) == ("rs2", 3.0, [], {"F": ""})
    assert got[3].info == {} and got[3].id is None


def test_files_with_samples_in_different_orders(spark, tmp_path):
    import gzip

    head = '##INFO=<ID=DP,Number=1,Type=Integer,Description="x">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t'
    (tmp_path / "a.vcf").write_text(head + "A\tB\nchr1\t5\t.\tA\tC\t.\tPASS\tDP=3;DP=4;X\tGT\t0/1\t1/1\n")
    with gzip.open(tmp_path / "b b.vcf.gz", "wt") as f:
        f.write(head + "B\tA\nchr1\t9\t.\tA\tC\t.\tPASS\tDP=7\tGT:DP\t0/0:2\t0|1:8\n")
    v, h = vcf.read_vcf(spark, str(tmp_path))
    assert h.info["DP"] == ("Integer", "1")
    assert {(r.pos, r.dp, r.x) for r in v.select("pos", vcf.typed_info(F.col("info"), "DP", h).alias("dp"), F.map_contains_key("info", "X").alias("x")).collect()} == {(5, 4, True), (9, 7, False)}
    calls = vcf.parse_calls(v, h)
    assert {(r.pos, r.sample, r.gt, r.dp) for r in calls.collect()} == {(5, "A", "0/1", None), (5, "B", "1/1", None), (9, "B", "0/0", 2), (9, "A", "0|1", 8)}
    (tmp_path / "c.vcf").write_text("chr2\t1\t.\tA\tC\t.\tPASS\t.\tGT\t0/1\t1/1\n")
    with pytest.raises(ValueError, match="name none"):
        vcf.read_vcf(spark, str(tmp_path))


def dosages(spark, n_sites, n_samples, seed, missing=0.0):
    """Sites, calls, and the dosages by (vid, sample)."""
    r = random.Random(seed)
    calls = [(v, s, r.randint(0, 1), r.randint(0, 1)) for v in range(n_sites) for s in range(n_samples) if r.random() >= missing]
    sites_ = spark.createDataFrame([(v, "chr1", v * 10 + 1, "A", ["C"]) for v in range(n_sites)], "vid long, chrom string, pos long, ref string, alts array<string>")
    return sites_, spark.createDataFrame(calls, "vid long, sample int, a1 int, a2 int"), {(v, s): a + b for v, s, a, b in calls}


@pytest.mark.parametrize("normalise", [True, False])
def test_principal_components(spark, normalise):
    v, c, dose = dosages(spark, 12, 6, 8, missing=0.15)
    x = np.full((12, 6), np.nan)
    for (i, j), d in dose.items():
        x[i, j] = d
    mean = np.nanmean(x, 1, keepdims=True)
    centred = np.where(np.isnan(x), 0, x - mean)
    used = ((mean > 0) & (mean < 2))[:, 0]
    scaled = (centred / np.sqrt(mean / 2 * (1 - mean / 2)) if normalise else centred)[used]
    values, vectors = np.linalg.eigh(scaled.T @ scaled / used.sum())
    got = pairs.pca(v, c, 2, normalise)
    rows = {(r["sample"], r.component): r for r in got.collect()}
    for k in (1, 2):
        own = np.array([rows[s, k].value for s in range(6)])
        assert rows[0, k].eigenvalue == pytest.approx(values[-k]) and abs(own @ vectors[:, -k]) == pytest.approx(1)
        assert own[np.argmax(abs(own))] > 0
    for r in pairs.pca_loadings(v, c, got).collect():
        assert r.loading == pytest.approx(sum(centred[r.vid, s] * rows[s, r.component].value for s in range(6)))


def test_blocked_products_like_plain_sums(spark):
    """Every sum over sites for pairs of samples, whatever the blocks, against plain loops; some pairs share no site."""
    r = random.Random(9)
    v = spark.createDataFrame([(k, ["C"] if k % 9 else ["C", "G"]) for k in range(90)], "vid long, alts array<string>").repartition(5)
    rows = [(k, s, r.randint(0, 1), r.randint(0, 1) if r.random() < 0.9 else None) for k in range(90) for s in range(23) if r.random() < 0.8 and not (s == 3 and k >= 40) and not (s == 5 and k < 40)]
    calls = spark.createDataFrame(rows, "vid long, sample int, a1 int, a2 int").repartition(7)
    x = {(k, s): a + b for k, s, a, b in rows if b is not None and k % 9}
    sites_ = {k: [x[k, s] for s in range(23) if (k, s) in x] for k in range(90)}
    f = {k: sum(own) / 2 / len(own) for k, own in sites_.items() if own}
    want = {}
    for s, t in itertools.combinations_with_replacement(range(23), 2):
        both = [(f[k], x[k, s], x[k, t]) for k in range(90) if (k, s) in x and (k, t) in x]
        if both:
            het, opposite, hets = sum(a == b == 1 for _, a, b in both), sum(abs(a - b) == 2 for _, a, b in both), sum((a == 1) + (b == 1) for _, a, b in both)
            poly = [(p, a, b) for p, a, b in both if 0 < p < 1]
            yang = np.mean([(a * a - (1 + 2 * p) * a + 2 * p * p) / (2 * p * (1 - p)) if s == t else (a - 2 * p) * (b - 2 * p) / (2 * p * (1 - p)) for p, a, b in poly]) + (s == t)
            g = sum((a - 2 * p) * (b - 2 * p) / (p * (1 - p)) for p, a, b in poly) / sum(0 < p < 1 for p in f.values())
            want[s, t] = (het, opposite, (het - 2 * opposite) / hets if hets else None, yang, g)
    assert (3, 5) not in want
    for how in ({}, {"block": 7, "pairs_at_once": 3, "sites_at_once": 4, "fan_in": 2}):
        king = {(z["sample"], z.sample2): z for z in pairs.relatedness_king(v, calls, **how).collect()}
        yang = {(z["sample"], z.sample2): z.ajk for z in pairs.relatedness_yang(v, calls, **how).collect()}
        g = {(z["sample"], z.sample2): z.g for z in pairs.gram_matrix(v, calls, **how).collect()}
        assert king.keys() == yang.keys() == g.keys() == want.keys()
        for key, (het, opposite, phi, ajk, gram_) in want.items():
            assert (king[key].n_het_het, king[key].n_opposite) == (het, opposite) and king[key].phi == (phi if phi is None else pytest.approx(phi, abs=1e-5))
            assert yang[key] == pytest.approx(ajk, abs=1e-5) and g[key] == pytest.approx(gram_)
    one, two = (pairs.pca(v, calls, 3, block=size).collect() for size in (512, 6))
    assert [(a["sample"], a.component) for a in one] == [(b["sample"], b.component) for b in two] and np.allclose([a.value for a in one], [b.value for b in two])
    assert gram.numbered_samples(calls).count() == 23


def test_autozygous_runs_like_all_paths(spark):
    """Posteriors from the probabilities of all 2^n paths of states."""
    error, prior, threshold, rate = 0.2, 0.3, 0.4, 2 * 4 * 1e-8
    r = random.Random(12)
    v = [(k, f"chr{k % 2}", (k // 2 + 1) * 6_000_000 + k, "A", ["C"]) for k in range(16)]
    calls = [(k, s, r.randint(0, 1), r.randint(0, 1)) for k in range(16) for s in range(5)]
    calls = [(k, s, a, a if s == 0 else b) for k, s, a, b in calls]
    got = autozygous_runs(spark.createDataFrame(v, "vid long, chrom string, pos long, ref string, alts array<string>"), spark.createDataFrame(calls, "vid long, sample int, a1 int, a2 int"), error, prior, threshold)
    got = {(x["sample"], x.chrom, x.start, x.end, x.n_sites) for x in got.collect()}
    v_df, c_df = spark.createDataFrame(v, "vid long, chrom string, pos long, ref string, alts array<string>"), spark.createDataFrame([(k, f"n{s}", a, b) for k, s, a, b in calls if (k, s) != (6, 2)], "vid long, sample string, a1 int, a2 int")
    # The width of bins and the size of blocks change nothing; samples may have names.
    some = [sorted(map(tuple, autozygous_runs(v_df, c_df, error, prior, threshold, bin_width=width, block=size).collect())) for width, size in ((5_000_000, 2), (13_000_000, 64), (10**9, 1))]
    assert some[0] == some[1] == some[2] and some[0]
    share = {k: np.mean([x for c in calls if c[0] == k for x in c[2:]]) for k in range(16)}
    want = set()
    for s, chrom in itertools.product(range(5), ("chr0", "chr1")):
        sites_ = [x for x in v if x[1] == chrom and 0 < share[x[0]] < 1]
        het = {c[0]: c[2] != c[3] for c in calls if c[1] == s}
        total, inside = 0.0, np.zeros(len(sites_))
        for path in itertools.product((0, 1), repeat=len(sites_)):
            p = 1.0
            for i, (x, state) in enumerate(zip(sites_, path, strict=True)):
                h = error if state else 2 * share[x[0]] * (1 - share[x[0]])
                p *= h if het[x[0]] else 1 - h
                if i == 0:
                    p *= prior if state else 1 - prior
                else:
                    move = 1 - np.exp(-rate * (x[2] - sites_[i - 1][2]))
                    to = move * (prior if state else 1 - prior)
                    p *= to + (1 - move if state == path[i - 1] else 0)
            total += p
            inside += p * np.array(path)
        for _, run in itertools.groupby(enumerate(inside / total > threshold), key=lambda x: x[1]):
            run = list(run)
            if run[0][1]:
                want.add((s, chrom, sites_[run[0][0]][2], sites_[run[-1][0]][2], len(run)))
    assert want and got == want


def test_sites_out_of_equilibrium_go(spark):
    v, c, _ = dosages(spark, 14, 25, 9, missing=0.1)
    counts = {k: [0, 0, 0] for k in range(14)}
    for x in c.collect():
        counts[x.vid][x.a1 + x.a2] += 1
    p = {k: exact_by_enumeration(n[1], n[0], n[2])[0] for k, n in counts.items()}
    want = {k for k in p if p[k] >= 0.5}
    assert 0 < len(want) < 14 and {x.vid for x in filters.by_hwe(v, c, 0.5).collect()} == want


def test_best_alignment_of_each_gene(spark):
    r = random.Random(10)
    rows = [(k, k % 7, r.choice([0.5, 0.85, 0.9, 1.0]), float(r.randint(1, 3))) for k in range(60)]
    got = {(x.gene, x.key) for x in structure.best_alignments(spark.createDataFrame(rows, "key long, gene int, identity double, score double"), 0.85).collect()}
    want = {(g, min((-i, -s, k) for k, h, i, s in rows if h == g and i >= 0.85)[2]) for g in range(7)}
    assert got == want


def test_lookup_takes_ids_without_a_version_last(spark):
    edges = spark.createDataFrame([("P1", "R", "NM_1.2"), ("P2", "R", "NM_1.10"), ("P3", "R", "NM_1"), ("P4", "R", "NM_2")], "unp string, id_type string, ext_id string")
    asked = spark.createDataFrame([("NM_1.2",), ("NM_1.7",), ("NM_1",), ("NM_2.4",), ("NM_3",)], "asked string")
    assert {(r.asked, r.unps) for r in mapping.versioned_lookup(asked, edges, "R").collect()} == {("NM_1.2", "P1"), ("NM_1.7", "P2"), ("NM_1", "P3"), ("NM_2.4", "P4"), ("NM_3", "")}


def test_templates_repeat_their_bracket(spark):
    from helixframe.sources import exports

    rows = spark.createDataFrame([(1, "1", 5, None, "B", "0/1"), (1, "1", 5, None, "A", "1|1"), (2, "2", 6, "rs", "A", None)], "vid int, chrom string, pos int, id string, sample string, gt string")
    site, call = {"CHROM": F.col("chrom"), "POS": F.col("pos"), "ID": F.col("id")}, {"SAMPLE": F.col("sample"), "GT": F.col("gt")}
    got = {r.vid: r.line for r in exports.formatted(rows, "%CHROM:%POS %ID[\t%SAMPLE=%GT]\t%CHROM", site, call).collect()}
    assert got == {1: "1:5 .\tA=1|1\tB=0/1\t1", 2: "2:6 rs\tA=.\t2"}
    assert {r.line for r in exports.formatted(rows, "%POS", site, call).collect()} == {"5", "6"}


def test_mmcif_and_unlike_columns(spark, tmp_path):
    (tmp_path / "1abc.cif").write_text("data_1ABC\nloop_\n_atom_site.group_PDB\n_atom_site.id\n_atom_site.Cartn_z\n_atom_site.label_asym_id\nATOM 1 2.5 A\nHETATM 2 ? B\n#\nATOMS none\n")
    got = sorted((r.structid, r.record, r.serial, r.chain, r.z, r.x, r.icode) for r in tables.read_cif_atoms(spark, str(tmp_path)).collect())
    assert got == [("1abc", "ATOM", 1, "A", 2.5, None, ""), ("1abc", "HETATM", 2, "B", None, None, "")]
    a = spark.createDataFrame([("chr1", 1)], "chrom string, pos int")
    with pytest.raises(ValueError, match="different columns"):
        sets.concat([a, a.withColumn("x", F.lit(1))])
    assert sets.concat([a, a.withColumn("x", F.lit(1))], pad=True).count() == 2


def test_frequency_at_its_bound(spark):
    site = spark.createDataFrame([(1, "A", ["C"])], "vid int, ref string, alts array<string>")
    calls = spark.createDataFrame([(1, s, 0, int(s < 2)) for s in range(5)], "vid int, sample int, a1 int, a2 int")
    assert filters.by_frequency(site, calls, min_maf=0.2).count() == 1


def test_samples_lines_have_sites_of_one_position_alike(spark):
    from helixframe.sources import exports

    site = spark.createDataFrame([(7, "1", 5, None, "A", ["C"]), (3, "1", 5, None, "G", ["T"])], "vid int, chrom string, pos int, id string, ref string, alts array<string>")
    calls = spark.createDataFrame([(7, 1, 0, 0, True), (3, 1, 1, 1, True), (7, 2, 1, 1, True), (3, 2, 0, 0, True)], "vid int, sample int, a1 int, a2 int, phased boolean")
    assert {r["sample"]: r.line for r in exports.plink_ped(exports.with_alleles(site, calls)).collect()} == {1: "T T\tA A", 2: "G G\tC C"}
    for phased in (True, False):
        assert {r["sample"]: r.sites for r in exports.ldhat(site, calls, phased).collect()} == {1: "10", 2: "01"}


def test_places_of_equal_positions_by_vid(spark, tmp_path):
    from helixframe import plans

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    part.union(part.withColumn("p_partkey", F.col("p_partkey") + 200_000)).repartition(7, F.rand(5)).write.parquet(str(tmp_path / "part.parquet"))
    rows = [r.vid for r in plans.QUERIES["o1_vcf_sort"](spark, str(tmp_path)).orderBy("k").collect()]
    assert rows == sorted(rows, key=lambda v: (1 + v % 5, 1 + v * 7919 % 200_000, v))


def test_residue_frame_without_hetero_groups_only_where_told(spark):
    from helixframe import plans

    folder = "/root/testdata/sf0.001"
    from helixframe.sources.views import Tables

    t = Tables(spark, folder)
    placed = t.residues.join(t.intervals.select("structid", "chain", "seqid"), ["structid", "chain", "seqid"], "left_semi")
    assert plans.QUERIES["t2_residue_frame"](spark, folder).count() == placed.count() > placed.where("res_id % 4 > 0").count()
    rows = spark.createDataFrame([("S", "A", 1, False), ("S", "A", 2, True), ("S", "A", 3, None)], "structid string, chain string, seqid int, hetero boolean")
    assert sorted(r.seqid for r in structure.residue_frame(rows, rows.withColumn("unp_pos", F.lit(1))).collect()) == [1, 3]


def test_ped_lines_are_whole(spark):
    from hashlib import md5

    from helixframe import plans
    from helixframe.sources.views import Tables

    folder = "/root/testdata/sf0.001"
    t = Tables(spark, folder)
    rows = t.calls.join(t.variants, "vid").orderBy("chrom", "pos", "vid").collect()
    want = {}
    for r in rows:
        bases = [r.ref, r.alt1, r.alt2]
        one = bases[r.a1] or "0" if r.a1 is not None else "0"
        two = bases[r.a2] or "0" if r.a2 is not None else one if r.phased else "0"
        want.setdefault(r["sample"], [str(r["sample"])] * 2 + ["0"] * 4).append(f"{one} {two}")
    got = {r["sample"]: r.line for r in plans.QUERIES["w5_to_plink_ped"](spark, folder).collect()}
    assert got == {s: md5("\t".join(cells).encode()).hexdigest() for s, cells in want.items()}


def test_sites_against_those_of_other_chromosomes(spark):
    chrom = {v: "xyz"[v % 3] for v in range(40)}
    v = spark.createDataFrame([(k, c, 5 * k, ["C"]) for k, c in chrom.items()], "vid int, chrom string, pos int, alts array<string>")
    c = spark.createDataFrame([(k, s, (k + s) % 2, 1, True) for k in chrom for s in range(3)], "vid int, sample int, a1 int, a2 int, phased boolean")
    want = sorted((a, b) for a in chrom for b in chrom if chrom[a] != chrom[b])
    some = v.where("vid % 10 = 0")
    for blocks in (1, 4, 64):
        # All sites, whatever their number, and those listed.
        assert sorted((r.vid, r.vid2) for r in pairs.other_chromosome_pairs(v, c, blocks=blocks).collect()) == want
        assert sorted((r.vid, r.vid2) for r in pairs.other_chromosome_pairs(v, c, some, blocks).collect()) == [(a, b) for a, b in want if a % 10 == 0]
        assert sorted((r.vid, r.vid2) for r in pairs.listed_pairs(v, c, some, blocks).collect()) == [(a, b) for a in chrom for b in chrom if a % 10 == 0 and a != b and chrom[a] == chrom[b]]


def test_whole_ped_lines_have_all_chromosomes(spark):
    from helixframe import plans
    from helixframe.sources.views import Tables

    folder = "/root/testdata/sf0.001"
    t = Tables(spark, folder)
    want = {r["sample"]: r["n"] for r in t.calls.join(t.variants, "vid").groupBy("sample").agg(F.count("*").alias("n")).collect()}
    # Six columns before the calls.
    assert {r["sample"]: r.line.count("\t") - 5 for r in plans.QUERIES["w5_whole_ped_lines"](spark, folder).collect()} == want


def test_first_rows_of_a_view_without_the_others(spark):
    r = random.Random(8)
    make = lambda rows, schema: spark.createDataFrame(sorted(set(rows), key=str), schema)
    place = lambda: (r.choice("st"), r.choice("AB"), r.randrange(4))
    hits = [(f"{r.randrange(40)}:{k}", *place()) for k in range(120)]
    residues = [(*place(), k) for k in range(20)] + [("s", None, 1, 50), ("u", "A", 1, 51)]
    every = [
        make(residues, "structid string, chain string, seqid int, res_id int"), make([("s", "A", "P1"), ("t", "B", "P2")], "structid string, chain string, unp string"), make([("s", "X-RAY", 2.0)], "structid string, method string, resolution double"),
        make([("t", "MODEL", 0.5)], "structid string, model_method string, mpqs double"), make(hits, "gc_id string, structid string, chain string, seqid int"),
        make([(g, int(g.split(":")[0]), 0, r.choice(["", None, "T1", "T2", "T9"]), r.choice(["missense_variant", "x"])) for g, *_ in hits], "gc_id string, vid int, pos int, transcript string, consequence string"), make([(v, float(v), f"rs{v}") for v in range(0, 40, 2)], "vid int, qual double, id string"),
        make([(s, c, n, e, n + 1) for s, c, n in (place() for _ in range(30)) for e in r.sample(["T1", "T2", "T3", None], 2)], "structid string, chain string, seqid int, enst string, ens_seqid int"), make([("T1", 2, "G1"), ("T2", 3, "G2")], "enst string, ens_seqid int, gene string"),
        make([("s", "A", "T1", 0.5)], "structid string, chain string, enst string, perc_identity double"), make([("s", "A", 0, 2, "D2"), ("s", "A", 1, 3, "D1"), ("t", "B", 0, 9, None), ("t", "B", 1, 9, "D3")], "structid string, chain string, seqstart int, seqend int, domain string"),
    ]
    whole, few = mapping.structure_view(*every), mapping.structure_view(*every, first=True)
    assert whole.columns == few.columns and few.count() < whole.count()
    assert sorted(map(str, mapping.one_per_variant(few).collect())) == sorted(map(str, mapping.one_per_variant(whole).collect()))


def test_merged_ranges_and_hits_once(spark):
    rows = [("a", 1, 5), ("a", 4, 8), ("a", 8, 9), ("a", 2, 3), ("b", 1, 2), ("b", 5, 5), ("b", 4, 7)]
    df = spark.createDataFrame(rows, "k string, s int, e int")
    assert sorted(map(tuple, ranges.merged(df, ["k"], "s", "e").collect())) == [("a", 1, 8), ("a", 8, 9), ("b", 1, 2), ("b", 4, 7)]
    r = random.Random(3)
    place = lambda: (r.choice("xy"), "A", r.randrange(3))
    spans = [("c", s, s + r.randrange(0, 400), r.choice(["T1", "T2"]), *place()) for s in (r.randrange(1500) for _ in range(80))]
    asked = [(f"{i}", "c", p, p + r.choice([0, 1, 1, 300]), r.choice([None, "", "T1"])) for i, p in enumerate(r.randrange(1500) for _ in range(60))]
    m = spark.createDataFrame(spans, "b_chrom string, b_start int, b_end int, b_transcript string, structid string, chain string, seqid int")
    c = spark.createDataFrame(asked, "gc_id string, chrom string, pos int, end_pos int, transcript string")
    want = {(g, *z) for g, _, p, q, t in asked for _, s, e, u, *z in spans if p < e and s < q and (not t or t == u)}
    hits = mapping.intersect(c, m)
    assert sorted(map(tuple, hits.collect())) == sorted(want)
    by = {s: (sum(w[1] == s for w in want), len({w[0] for w in want if w[1] == s})) for s in "xy"}
    assert {x.structid: (x.n, x.n_consequences) for x in mapping.intersection_counts(c, m).collect()} == by


def test_mask_runs_are_merged(spark):
    r = random.Random(8)
    runs = [("c", s, s + r.choice([0, 3, 900, 3000]), r.randrange(4)) for s in (r.randrange(9000) for _ in range(25))]
    places = list(range(0, 9000, 7)) + [None]
    v = spark.createDataFrame(list(enumerate(places)), "vid int, pos int").withColumn("chrom", F.lit("c"))
    m = spark.createDataFrame(runs, "chrom string, start int, end int, digit int")
    for invert in (False, True):
        got = filters.by_mask(v, m, 1, invert)
        assert sorted(x.vid for x in got.collect()) == [i for i, p in enumerate(places) if p is not None and any(s <= p < e and (d > 1) == invert for _, s, e, d in runs)]
        assert "Window" in got._jdf.queryExecution().optimizedPlan().toString()  # runs are merged before they meet sites


def test_chi_square_of_pairs_is_compiled(spark):
    from helixframe import plans
    from helixframe.operators.sites import with_chi_square_p

    rows = [(x, float(d), math.erfc(math.sqrt(x / 2)) if d == 1 else math.exp(-x / 2) * (1 if d == 2 else 1 + x / 2)) for x in (0.0, 0.3, 1.2, 2.0, 3.0, 5.5, 17.0, 80.0, 2000.0) for d in (1, 2, 4)]
    rows += [(3.0, 0.0, None), (None, 1.0, None)]
    got = with_chi_square_p(spark.createDataFrame(rows, "x double, d double, want double"), "x", "d", "p").collect()
    assert [list(r.asDict()) for r in got[:1]] == [["x", "d", "want", "p"]]
    assert all(r.p is None if r.want is None else abs(r.p - r.want) < 1e-12 for r in got)
    # Methods of over 8000 bytes are left to the interpreter.
    code = plans.QUERIES["a26_geno_chisq"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().debug().codegenToSeq()
    assert all(0 < code.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(code.size()))


def test_erfc(spark):
    from helixframe.operators.sites import erfc

    xs = [k / 64 for k in range(64 * 30)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erfc(F.col("x")).alias("y")).collect()
    assert all(abs(r.y - math.erfc(r.x)) <= 1e-13 * math.erfc(r.x) + 1e-300 for r in got)


@pytest.mark.parametrize("samples", [20, 150, 700])
def test_counts_of_pairs_are_compiled(spark, samples):
    """Pairs' counts are generated code, not functions of arrays' elements, as long as the words of a site are few."""
    v = spark.createDataFrame([(k, "chr1", 10 + k, ["C"]) for k in range(3)], "vid int, chrom string, pos long, alts array<string>")
    c = spark.createDataFrame([(k, s, s * (k + 1) % 2, s % 3 % 2, True) for k in range(3) for s in range(samples)], "vid int, sample int, a1 int, a2 int, phased boolean")
    near = pairs.near_pairs(v, c, 100)
    got = [pairs.genotype_r2(near), pairs.haplotype_r2(near), pairs.genotype_chisq(near)]
    assert [r.n_indv for r in got[0].collect()] == [samples] * 3
    for df in got:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert ("lambdafunction" in plan) == (samples > 512) and "erfc(" not in plan


@given(st.text("ACG", max_size=9), st.text("AC", max_size=40), st.text("CG", max_size=40), st.text("ACG", max_size=9))
@settings(max_examples=5, deadline=None)
def test_long_alleles(spark, head, one, two, tail):
    import os.path

    a, b = head * 30 + one + tail, head * 30 + two + tail
    row = spark.createDataFrame([(a, b)], "a string, b string").select(V.common_prefix(F.col("a"), F.col("b")).alias("p"), V.common_suffix(F.col("a"), F.col("b")).alias("s"), V.normalised(F.col("a"), F.col("b"), F.lit(5)).alias("n")).first()
    assert row.p == len(os.path.commonprefix([a, b])) and row.s == len(os.path.commonprefix([a[::-1], b[::-1]]))
    if a and b:
        cut = min(row.s, len(a) - 1, len(b) - 1)
        x, y = a[: len(a) - cut], b[: len(b) - cut]
        head = min(len(os.path.commonprefix([x, y])), len(x) - 1, len(y) - 1)
        assert (row.n.pos, row.n.ref, row.n.alt) == (5 + head, x[head:], y[head:])


def test_alleles_are_cut_once(spark):
    """The plan names the cut alleles a few times, not once for every use of them; a table's rows meet by them as a key."""
    v = spark.createDataFrame([(1, "chr1", 10, None, "AT", ["A", "AG"], 1.0, ["q"], {"X": "1"})], "vid long, chrom string, pos long, id string, ref string, alts array<string>, qual double, filters array<string>, info map<string, string>")
    plan = v.select(V.normalised(F.col("ref"), F.get("alts", F.lit(0)), F.col("pos")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 2
    t = spark.createDataFrame([("chr1", 5, 10, 1, "AT", ["AG", "A"], "one"), ("chr1", 5, 10, 2, ".", ["T"], "two"), ("chr1", 5, 10, 3, "T", ["G"], "three"), ("chr1", 5, 10, 4, "A", ["C"], "four"), ("chr1", 11, 12, 5, ".", ["T"], "five")], "chrom string, start long, end long, rank int, ref string, alts array<string>, id string")
    got = sets.annotate_from_table(v, t, match_alleles=True)
    assert got.first()["id"] == "one;three;two"
    assert "(__pair" in got._jdf.queryExecution().optimizedPlan().toString() and "arrays_overlap" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_places_that_differ(spark):
    r = random.Random(3)
    rows = []
    for n in (0, 1, 63, 64, 65, 300):
        a = "".join(r.choice("ACDE") for _ in range(n))
        rows += [(a, a), (a, "".join(r.choice("ACDE") if r.random() < 0.1 else c for c in a)), (a, a + "A")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", V.seq_differences(F.col("a"), F.col("b")).alias("d"), V.seq_identity(F.col("a"), F.col("b")).alias("i"), V.close_enough(F.col("a"), F.col("b")).alias("c"))
    for x in got.collect():
        want = [f"{i} {p}>{q}" for i, (p, q) in enumerate(zip(x.a, x.b, strict=False), 1) if p != q]
        same = len(x.a) == len(x.b)
        assert x.d == (",".join(want) if same else None) and x.i.mismatches == (len(want) if same else None)
        assert x.c == (same and (len(want) <= 1 or round(len(want) / len(x.a), 6) < 0.01))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 6


def test_trivial_alignments(spark):
    """Chains by residues and by rows against a loop; a chain meets its sequence in one row."""
    r = random.Random(8)
    sequences = {k: "".join(r.choice("ACD") for _ in range(12)) for k in range(30)}
    rows = []
    for chain in range(90):
        seq, at = sequences[chain % 30], sorted(r.sample(range(1, 13), r.randint(1, 12)))
        if r.random() < 0.2:
            r.shuffle(at)
        for k, n in enumerate(at):
            rows.append((chain, chain % 30, n + 12 * (r.random() < 0.02), seq[n - 1] if r.random() < 0.97 else "E", r.random() < 0.02, "A" if r.random() < 0.02 else "", k))
    want = {}
    for chain in range(90):
        own = [x for x in rows if x[0] == chain]
        seq = sequences[chain % 30]
        want[chain] = all(not x[4] and not x[5] and 1 <= x[2] <= 12 and seq[x[2] - 1 : x[2]] == x[3] for x in own) and all(a[2] < b[2] for a, b in itertools.pairwise(own))
    assert 20 < sum(want.values()) < 70
    r.shuffle(rows)
    s = spark.createDataFrame(list(sequences.items()), "seq_id int, seq string")
    residues = spark.createDataFrame(rows, "chain_key int, seq_id int, resnum int, letter string, hetero boolean, icode string, k int")
    for given in (residues, structure.chain_rows(residues)):
        got = structure.trivial_alignments(given, s)
        assert {x.chain_key: x.trivial for x in got.collect()} == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Generate" not in plan


def test_cif_texts_are_bounded(spark):
    """Ten times the residues of a structure are more texts, not longer ones."""
    from types import SimpleNamespace

    from helixframe.plans.structure_queries import cif_texts

    for n in (1000, 10000):
        r = spark.range(n).selectExpr("id as res_id", "concat('S', id % 2) as structid", "'A' as chain", "cast(id % 100 as int) as seqid", "0.5D as x", "1.5D as y", "2.5D as z")
        texts = cif_texts(SimpleNamespace(residues=r), rows=500)
        assert texts.count() == n // 250 and max(len(x.value.splitlines()) for x in texts.collect()) < 250 + 20
        assert tables.cif_atoms(texts).count() == n
        plan = tables.cif_atoms(texts)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate explode(") < plan.index("_atom_site")  # below the lines


def test_haplotypes_of_equal_places(spark):
    """Sites that share a position, equal bins and calls with gaps against a loop; equal bins are one place, and no row exists
    for a bin, a site and a sample."""
    r = random.Random(5)
    sites_ = [(k, "chr1", r.randint(1, 30), ["C"]) for k in range(25)]
    calls = [(k, s, r.randint(0, 1), r.randint(0, 1), r.random() < 0.95) for k in range(25) for s in range(8) if r.random() < 0.97]
    bed = [(i, "chr1", a := r.randint(0, 25), a + r.randint(1, 8)) for i in range(40)]
    bed += [(i + 40, *x[1:]) for i, x in enumerate(bed)]
    v = spark.createDataFrame(sites_, "vid int, chrom string, pos long, alts array<string>")
    c = spark.createDataFrame(calls, "vid int, sample int, a1 int, a2 int, phased boolean")
    b = spark.createDataFrame(bed, "iid int, chrom string, start long, end long")
    want = {}
    for i, _, start, end in bed:
        inside = {k: p for k, _, p, _ in sites_ if start <= p < end}
        own = [[x for x in calls if x[0] in inside and x[1] == s and x[4]] for s in range(8)]
        strings = ["".join(str(a) for _, a in sorted((inside[x[0]], x[2 + h]) for x in o)) for o in own if inside and len(o) == len(inside) for h in (0, 1)]
        times = [strings.count(x) for x in set(strings)]
        if times:
            want[i] = (len(inside), len(times), ",".join(f"{m}:{times.count(m)}" for m in sorted(set(times))))
    got = windows.haplotype_counts(v, c, b)
    assert {x.iid: (x.n_snp, x.n_unique, x.spectrum) for x in got.collect()} == want and len(want) > 20
    assert got._jdf.queryExecution().optimizedPlan().toString().count("explode(") == 2  # bins of sites and of places


def test_haplotypes_by_stretches(spark):
    """Places within a stretch, beyond one and over several, of sites at one position, against a loop; sites and places meet by
    stretches, not in rows of their own."""
    r = random.Random(6)
    spots = [(k, r.choice(["x", "y", None]), r.randint(1, 60), ["C"]) for k in range(60)]
    calls = [(k, s, r.randint(0, 2), r.randint(0, 1), True) for k in range(60) for s in range(5) if r.random() < 0.98]
    bed = [(i, r.choice(["x", "y", None]), a := r.randint(0, 55), a + r.choice([0, 2, 5, 9, 30])) for i in range(60)]
    v = spark.createDataFrame(spots, "vid int, chrom string, pos long, alts array<string>")
    c = spark.createDataFrame(calls, "vid int, sample int, a1 int, a2 int, phased boolean")
    b = spark.createDataFrame(bed, "iid int, chrom string, start long, end long")
    want = {}
    for i, chrom, start, end in bed:
        inside = {k: p for k, x, p, _ in spots if chrom is not None and x == chrom and start <= p < end}
        own = [[x for x in calls if x[0] in inside and x[1] == s] for s in range(5)]
        strings = ["".join(str(a) for _, a in sorted((inside[x[0]], x[2 + h]) for x in o)) for o in own if inside and len(o) == len(inside) for h in (0, 1)]
        times = [strings.count(x) for x in set(strings)]
        if times:
            want[i] = (len(inside), len(times), ",".join(f"{m}:{times.count(m)}" for m in sorted(set(times))))
    assert len(want) > 20
    for width in (4, 16, 1000):
        got = windows.haplotype_counts(v, c, b, width)
        assert {x.iid: (x.n_snp, x.n_unique, x.spectrum) for x in got.collect()} == want
    assert "CoGroup" in got._jdf.queryExecution().optimizedPlan().toString()


def test_models_of_equal_places(spark):
    asked = spark.createDataFrame([(i, f"T{i % 3}", i % 5, i % 5 + 2) for i in range(60)], "iid int, seq_id string, first int, last int")
    models = spark.createDataFrame([(m, f"T{m % 3}" + "_1ABC" * (m % 2), m % 7, m % 7 + 4) for m in range(30)], "model int, seq_id string, target_beg int, target_end int")
    got = mapping.models_of(asked, models)
    assert sorted((x.iid, x.model) for x in got.collect()) == sorted((i, m) for i in range(60) for m in range(30) if i % 3 == m % 3 and m % 7 <= i % 5 and m % 7 + 4 >= i % 5 + 2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("target_beg") and "Aggregate [seq_id" in plan


def test_bins_of_dense_sites(spark):
    """Ten times the sites on one chromosome are more bins, not larger ones; runs do not depend on it."""
    from helixframe.operators.autozygosity import narrowed

    for n in (200, 2000):
        s = spark.range(n).selectExpr("'chr1' as chrom", "id % 400 as pos")
        width = narrowed(s, 1000, 50)
        assert s.groupBy("chrom", F.floor(F.col("pos") / width)).count().agg(F.max("count")).first()[0] <= 50
    r = random.Random(4)
    v = spark.createDataFrame([(k, "chr1", 10 * k, ["C"]) for k in range(60)], "vid int, chrom string, pos long, alts array<string>")
    c = spark.createDataFrame([(k, x, a := r.randint(0, 1), a if 20 * x < k < 20 * x + 25 else 1 - a, True) for k in range(60) for x in range(3)], "vid int, sample int, a1 int, a2 int, phased boolean")
    one, many = (sorted(map(tuple, autozygous_runs(v, c, error=0.1, prior=0.5, threshold=0.5, per_base=1e-3, bin_sites=most).collect())) for most in (10_000, 4))
    assert one == many and one
