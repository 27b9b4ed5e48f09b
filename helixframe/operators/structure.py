"""Structures, sequences and sample contrasts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from helixframe.functions.variants import event, iupac, one_letter, reshaped_likelihoods
from helixframe.operators.ranges import range_join
from helixframe.sources.scratch import saved

LETTERS = "ARNDCQEGHILKMFPSTWYVBZX*"
#: BLOSUM62 (Henikoff and Henikoff 1992), rows and columns in the order of LETTERS. Fixed values.
BLOSUM62 = [[int(x) for x in row.split()] for row in """
4 -1 -2 -2 0 -1 -1 0 -2 -1 -1 -1 -1 -2 -1 1 0 -3 -2 0 -2 -1 0 -4
-1 5 0 -2 -3 1 0 -2 0 -3 -2 2 -1 -3 -2 -1 -1 -3 -2 -3 -1 0 -1 -4
-2 0 6 1 -3 0 0 0 1 -3 -3 0 -2 -3 -2 1 0 -4 -2 -3 3 0 -1 -4
-2 -2 1 6 -3 0 2 -1 -1 -3 -4 -1 -3 -3 -1 0 -1 -4 -3 -3 4 1 -1 -4
0 -3 -3 -3 9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1 -3 -3 -2 -4
-1 1 0 0 -3 5 2 -2 0 -3 -2 1 0 -3 -1 0 -1 -2 -1 -2 0 3 -1 -4
-1 0 0 2 -4 2 5 -2 0 -3 -3 1 -2 -3 -1 0 -1 -3 -2 -2 1 4 -1 -4
0 -2 0 -1 -3 -2 -2 6 -2 -4 -4 -2 -3 -3 -2 0 -2 -2 -3 -3 -1 -2 -1 -4
-2 0 1 -1 -3 0 0 -2 8 -3 -3 -1 -2 -1 -2 -1 -2 -2 2 -3 0 0 -1 -4
-1 -3 -3 -3 -1 -3 -3 -4 -3 4 2 -3 1 0 -3 -2 -1 -3 -1 3 -3 -3 -1 -4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4 -2 2 0 -3 -2 -1 -2 -1 1 -4 -3 -1 -4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5 -1 -3 -1 0 -1 -3 -2 -2 0 1 -1 -4
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5 0 -2 -1 -1 -1 -1 1 -3 -1 -1 -4
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6 -4 -2 -2 1 3 -1 -3 -3 -1 -4
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7 -1 -1 -4 -3 -2 -2 -1 -2 -4
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4 1 -3 -2 -2 0 0 0 -4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5 -2 -2 0 -1 -1 0 -4
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11 2 -3 -4 -3 -2 -4
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7 -1 -3 -2 -1 -4
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4 -3 -2 -1 -4
-2 -1 3 4 -3 0 1 -1 0 -3 -4 0 -3 -3 -2 0 -1 -4 -3 -3 4 1 -1 -4
-1 0 0 1 -3 3 4 -2 0 -3 -3 1 -1 -3 -1 0 -1 -3 -2 -2 1 4 -1 -4
0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2 0 0 -2 -1 -1 -1 -1 -1 -4
-4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 1
""".strip().splitlines()]


def blosum(spark) -> DataFrame:
    """(a, b, score): the matrix as a table of 576 rows."""
    return spark.createDataFrame([(a, b, BLOSUM62[i][j]) for i, a in enumerate(LETTERS) for j, b in enumerate(LETTERS)], "a string, b string, score int")


def residue_centroids(atoms: DataFrame) -> DataFrame:
    """(chain, resid, icode, x, y, z): mean of the heavy atoms, alternative places of an atom averaged first."""
    heavy = atoms.where(F.col("element") != "H").groupBy("chain", "resid", "icode", "atom").agg(*[F.avg(c).alias(c) for c in "xyz"])
    return heavy.groupBy("chain", "resid", "icode").agg(*[F.round(F.avg(c), 4).alias(c) for c in "xyz"])


def chain_sequences(residues: DataFrame) -> DataFrame:
    """(structid, chain, seq): letters in order; skipped numbers between neighbours are X."""
    w = Window.partitionBy("structid", "chain").orderBy("seqid")
    gap = F.coalesce(F.col("seqid") - F.lag("seqid").over(w) - 1, F.lit(0))
    piece = F.concat(F.expr("repeat('X', cast(gap as int))"), "rescode")
    own = residues.withColumn("gap", gap).withColumn("piece", piece)
    return own.groupBy("structid", "chain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seqid", "piece"))), lambda x: x["piece"]), "").alias("seq"))


def biounits(atoms: DataFrame, assemblies: DataFrame, operators: DataFrame) -> DataFrame:
    """Atoms of assemblies (assembly, chain, op) moved by operators (op, r11 .. r33, t1 .. t3)."""
    a = atoms.join(assemblies, "chain").join(operators, "op")
    moved = [F.round(sum((F.col(f"r{i}{j}") * F.col(c) for j, c in enumerate("xyz", 1)), F.col(f"t{i}")), 4).alias(f"{c}") for i, c in enumerate("xyz", 1)]
    return a.select("assembly", "op", "chain", "serial", *moved)


def chain_rows(residues: DataFrame) -> DataFrame:
    """(chain_key, seq_id, residues): residues (chain_key, seq_id, resnum, letter, hetero, icode, k) in the order of k, a row per
    chain."""
    one = F.struct("k", "resnum", "letter", "hetero", "icode")
    return residues.groupBy("chain_key", "seq_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["resnum"].alias("resnum"), x["letter"].alias("letter"), x["hetero"].alias("hetero"), x["icode"].alias("icode"))).alias("residues"))


def trivial_alignments(residues: DataFrame, sequences: DataFrame) -> DataFrame:
    """(chain_key, trivial): whether all residues (chain_key, seq_id, resnum, letter, hetero, icode, k) stand at their numbers'
    places in the sequence: no hetero residues or insertion codes, ascending, in range, equal letters. residues may come as
    chain_rows() too.

    A chain meets its sequence once, as its letters and the runs of its numbers, not residue by residue."""
    chains = residues if "residues" in residues.columns else chain_rows(residues)
    numbers = F.col("residues.resnum").cast("array<bigint>")
    begins = F.filter(F.transform("__numbers", lambda n, i: F.when((i == 0) | (n != F.get("__numbers", i - 1) + 1) | n.isNull(), F.struct(i.alias("at"), n.alias("n")))), lambda x: x.isNotNull())
    plain = F.forall("residues", lambda r: F.coalesce(~r["hetero"] & (r["icode"] == "") & (F.length(r["letter"]) == 1), F.lit(False)))
    ends = F.concat(F.slice(F.col("__begins.at"), 2, F.greatest(F.size("__begins"), F.lit(1))), F.array(F.size("__numbers")))
    runs = F.transform(F.arrays_zip("__begins", ends.alias("to")), lambda x: F.struct(x["__begins"]["at"].alias("at"), x["__begins"]["n"].alias("n"), (x["to"] - x["__begins"]["at"]).alias("size")))
    own = chains.select("chain_key", "seq_id", numbers.alias("__numbers"), F.array_join("residues.letter", "").alias("__letters"), plain.alias("__plain"))
    own = own.withColumn("__begins", begins).select("chain_key", "seq_id", "__letters", "__plain", runs.alias("__runs"))
    up = F.forall(F.transform("__runs", lambda r, i: (i == 0) | (r["n"] >= F.get("__runs", i - 1)["n"] + F.get("__runs", i - 1)["size"])), lambda x: F.coalesce(x, F.lit(False)))
    there = F.forall("__runs", lambda r: F.coalesce((r["n"] >= 1) & (F.substring("seq", r["n"].cast("int"), r["size"]) == F.substring("__letters", r["at"] + 1, r["size"])), F.lit(False)))
    return own.join(sequences.select("seq_id", "seq"), "seq_id").groupBy("chain_key").agg(F.bool_and(F.coalesce(F.col("__plain") & up & there, F.lit(False))).alias("trivial"))


class Aligner:
    """Global alignment with affine gaps in linear space. A gap of k letters costs first + more * k. Rows are filled at once: a
    gap along a row is a running maximum. Long pairs are halved where the rows from both ends fit best, and only stretches of
    at most `cells` cells have tables to go back through."""

    def __init__(self, open_gap: float = -10.0, extend: float = -0.5, cells: int = 1 << 20):
        self.first, self.more, self.cells = open_gap - extend, extend, cells
        self.rank = {c: i for i, c in enumerate(LETTERS)}
        self.table = np.array(BLOSUM62, float)

    def codes(self, letters: str) -> np.ndarray:
        return np.array([self.rank.get(c, self.rank["X"]) for c in letters], int)

    def rows(self, a: np.ndarray, b: np.ndarray, top: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(best, pair, down, along) of each row: letters paired, a gap in b, a gap in a. top: what a gap in b costs at first
        that begins in the upper left corner, where it may go on from above."""
        n, at = len(b), self.more * np.arange(len(b) + 1)
        none = np.full(n + 1, -1e18)
        best, down, along = self.first + at, none.copy(), self.first + at
        best[0], along[0], down[0] = 0.0, -1e18, top
        pair = none
        yield best, pair, down, along
        for x in a:
            down = np.maximum(best + self.first, down) + self.more
            pair = none.copy()
            pair[1:] = best[:-1] + self.table[x, b]
            before = np.maximum(pair, down)
            along = none.copy()
            along[1:] = self.first + at[1:] + np.maximum.accumulate(before - at)[:-1]
            best = np.maximum(before, along)
            yield best, pair, down, along

    def last(self, a: np.ndarray, b: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
        for best, _, down, _ in self.rows(a, b, top):
            pass
        return best, down

    def path(self, a: np.ndarray, b: np.ndarray, top: float, bottom: float) -> tuple[str, float]:
        """Steps P (a pair), D (a gap in b) and I (a gap in a), and the score."""
        n, m = len(a), len(b)
        if n < 2 or n * m <= self.cells:
            return self.traced(a, b, top, bottom)
        half = n // 2
        best, down = self.last(a[:half], b, top)
        best2, down2 = (x[::-1] for x in self.last(a[half:][::-1], b[::-1], bottom))
        whole, cut = best + best2, down + down2 - self.first
        j, k = int(whole.argmax()), int(cut.argmax())
        if whole[j] >= cut[k]:
            return self.path(a[:half], b[:j], top, self.first)[0] + self.path(a[half:], b[j:], self.first, bottom)[0], float(whole[j])
        return self.path(a[: half - 1], b[:k], top, 0.0)[0] + "DD" + self.path(a[half + 1 :], b[k:], 0.0, bottom)[0], float(cut[k])

    def traced(self, a: np.ndarray, b: np.ndarray, top: float, bottom: float) -> tuple[str, float]:
        i, j = len(a), len(b)
        if not j:
            return "D" * i, (max(top, bottom) + self.more * i) if i else 0.0
        best, pair, down, along = (np.array(x) for x in zip(*self.rows(a, b, top), strict=True))
        score, ends = best[i, j], down[i, j] + bottom - self.first
        steps, state = [], "D" if ends > score else ""
        while i and j:
            state = state or ("P" if pair[i, j] == best[i, j] else "D" if down[i, j] == best[i, j] else "I")
            steps.append(state)
            if state == "P":
                i, j, state = i - 1, j - 1, ""
            elif state == "D":
                state = "" if best[i - 1, j] + self.first + self.more == down[i, j] else "D"
                i -= 1
            else:
                state = "" if best[i, j - 1] + self.first + self.more == along[i, j] else "I"
                j -= 1
        return "I" * j + "D" * i + "".join(reversed(steps)), float(max(score, ends))


def align_pair(a: str, b: str, open_gap: float = -10.0, extend: float = -0.5, cells: int = 1 << 20) -> tuple[str, str, float]:
    """Global alignment with affine gaps: (a with gaps, b with gaps, score)."""
    aligner = Aligner(open_gap, extend, cells)
    steps, score = aligner.path(aligner.codes(a), aligner.codes(b), aligner.first, aligner.first)
    left, right = iter(a), iter(b)
    return "".join("-" if s == "I" else next(left) for s in steps), "".join("-" if s == "D" else next(right) for s in steps), score


def global_alignments(pairs: DataFrame) -> DataFrame:
    """(key, a_aligned, b_aligned, score, identity) of pairs (key, a, b): one task aligns many pairs, each by itself."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, a, b in zip(part["key"], part["a"], part["b"], strict=True):
                x, y, score = align_pair(a or "", b or "")
                same = sum(p == q for p, q in zip(x, y, strict=True))
                rows.append((key, x, y, score, round(same / max(1, min(len(a or ""), len(b or ""))), 6)))
            yield pd.DataFrame(rows, columns=["key", "a_aligned", "b_aligned", "score", "identity"])

    return pairs.select("key", "a", "b").mapInPandas(run, f"key {pairs.schema['key'].dataType.simpleString()}, a_aligned string, b_aligned string, score double, identity double")


def best_alignments(alignments: DataFrame, least: float = 0.85) -> DataFrame:
    """Per gene the alignment of the greatest identity and score, if that is identical enough."""
    w = Window.partitionBy("gene").orderBy(F.desc("identity"), F.desc("score"), "key")
    return alignments.where(F.col("identity") >= least).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def alignment_stats(pairs: DataFrame, lengths: DataFrame) -> DataFrame:
    """(key, perc_aligned, perc_identity, score): of residue pairs (key, a, b) and full lengths (key, n); U scores as M."""
    u = lambda c: F.when(F.col(c) == "U", "M").otherwise(F.col(c))
    j = pairs.withColumns({"a": u("a"), "b": u("b")}).join(F.broadcast(blosum(pairs.sparkSession)), ["a", "b"], "left")
    by = j.groupBy("key").agg(F.count("*").alias("m"), F.count_if(F.col("a") == F.col("b")).alias("same"), F.sum(F.coalesce("score", F.lit(0))).alias("score"))
    return by.join(lengths, "key").select("key", F.round(F.col("m") / F.col("n"), 2).alias("perc_aligned"), F.round(F.col("same") / F.col("m"), 2).alias("perc_identity"), "score")


def chunked(reference: DataFrame, size: int) -> DataFrame:
    """(contig, chunk, text) of (contig, seq): pieces of `size` bases, so that no row holds a chromosome."""
    pieces = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))  # one pass over the contig
    return reference.select("contig", F.posexplode_outer(pieces).alias("chunk", "text")).select("contig", F.coalesce("chunk", F.lit(0)).cast("long").alias("chunk"), F.coalesce("text", F.lit("")).alias("text"))


def fetch(spans: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """spans (key, contig, start, end; 1-based, end exclusive) with their text; bases out of bounds are N."""
    own = spans.withColumn("chunk", F.explode(F.sequence(F.floor((F.greatest("start", F.lit(1)) - 1) / size), F.floor((F.greatest(F.col("end") - 1, F.lit(1)) - 1) / size))))
    a, b = F.greatest(F.col("start"), F.col("chunk") * size + 1), F.least(F.col("end"), (F.col("chunk") + 1) * size + 1)
    piece = F.coalesce(F.substring("text", a - F.col("chunk") * size, b - a), F.lit(""))
    got = own.join(chunks, ["contig", "chunk"], "left").groupBy("key", "contig", "start", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", piece.alias("p")))), lambda x: x["p"]), "").alias("seq"))
    left = F.greatest(F.lit(0).cast("long"), F.least(F.lit(1).cast("long") - F.col("start"), F.col("end") - F.col("start")))
    whole = F.concat(F.expr("repeat('N', cast(pad as int))"), "seq")
    return got.withColumn("pad", left).withColumn("seq", whole).withColumn("seq", F.rpad("seq", (F.col("end") - F.col("start")).cast("int"), F.lit("N"))).drop("pad")


def mask(texts: DataFrame, masks: DataFrame, lower: bool = False) -> DataFrame:
    """texts (key, contig, start, end, seq) whose letters inside a mask (contig, start, end; 1-based, end exclusive) are N, or
    in lower case."""
    own = masks.select(F.col("contig").alias("m_contig"), F.col("start").alias("m_start"), F.col("end").alias("m_end"))
    hits = range_join(texts.select("key", "contig", "start", "end"), own, ("contig", "start", "end"), ("m_contig", "m_start", "m_end"), width=64)
    inside = F.sequence(F.greatest("start", "m_start") - F.col("start"), F.least("end", "m_end") - 1 - F.col("start"))
    by = hits.select("key", F.explode(inside).alias("at")).groupBy("key").agg(F.collect_set("at").alias("__at"))  # a text's places
    letters = F.transform(F.split("seq", ""), lambda c, i: F.when(F.array_contains("__at", i.cast("long")), F.lower(c) if lower else F.lit("N")).otherwise(c))
    return texts.join(by, "key", "left").withColumn("seq", F.when(F.col("__at").isNull(), F.col("seq")).otherwise(F.array_join(letters, ""))).drop("__at")


def flanks(variants: DataFrame, chunks: DataFrame, size: int, length: int, masks: DataFrame | None = None, lower: bool = False) -> DataFrame:
    """(vid, text): left[REF/ALT]right with `length` bases on both sides of normalised alleles (pos, ref, alt), masked."""
    hide = (lambda texts: mask(texts, masks, lower)) if masks is not None else lambda texts: texts
    left = hide(fetch(variants.select(F.col("vid").alias("key"), "contig", (F.col("pos") - length).alias("start"), F.col("pos").alias("end")), chunks, size)).select("key", F.col("seq").alias("l"))
    after = F.col("pos") + F.length("ref")
    right = hide(fetch(variants.select(F.col("vid").alias("key"), "contig", after.alias("start"), (after + length).alias("end")), chunks, size)).select("key", F.col("seq").alias("r"))
    return variants.join(left, F.col("vid") == left["key"]).join(right, F.col("vid") == right["key"]).select("vid", F.concat("l", F.lit("["), "ref", F.lit("/"), "alt", F.lit("]"), "r").alias("text"))


def packed_variants(variants: DataFrame, size: int, kind: int) -> DataFrame:
    """Rows (contig, chunk, kind, text, steps, ref_n, alts, alt_n) of variants (contig, start, ref, alt): neighbours of one chunk
    in one row, their letters joined, their places as steps from the one before, so that little of them is shuffled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            contig, start, ref, alt = batch.columns
            at = start.to_numpy(zero_copy_only=False)
            chunk, new = at // size, np.ones(n, bool)
            new[1:] = (chunk[1:] != chunk[:-1]) | pc.not_equal(contig.slice(1), contig.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            ends = np.append(first, n).astype(np.int32)
            steps = np.diff(at, prepend=0)
            steps[first] = at[first] - chunk[first] * size

            def joined(c: pa.Array) -> pa.Array:
                offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + n + 1]
                return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets[ends].copy()), c.buffers()[2])

            def numbers(x: np.ndarray) -> pa.Array:
                return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(4 * ends), pa.py_buffer(x.astype(np.int32))])

            columns = [contig.take(pa.array(first)), pa.array(chunk[first]), joined(ref), numbers(steps), numbers(pc.utf8_length(ref).to_numpy()), joined(alt), numbers(pc.utf8_length(alt).to_numpy())]
            yield pa.RecordBatch.from_arrays(columns, names=["contig", "chunk", "text", "steps", "ref_n", "alts", "alt_n"])

    own = variants.select("contig", "start", "ref", "alt")
    made = own.mapInArrow(pack, f"contig {own.schema['contig'].dataType.simpleString()}, chunk long, text string, steps binary, ref_n binary, alts string, alt_n binary")
    return made.withColumn("kind", F.lit(kind))


#: Rows of a chunk: its text, variants whose reference is still to be looked at, variants that reach out of it, ends that reach into it.
_TEXT, _INSIDE, _REACHING, _ENTRY = range(4)


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(contig, chunk, text, real, ends) of each chunk in sorted rows: its text, null without one; its variants (start, end, alt)
    whose reference is there, in their order, with places from the chunk's begin; the ends that reach into it."""

    def pieces(text: str, lengths: bytes) -> list[str]:
        ends = np.cumsum(np.frombuffer(lengths, np.int32)).tolist()
        return [text[i:j] for i, j in zip([0, *ends], ends)]

    def chunk_of(key: tuple, rows: list[tuple]) -> tuple:
        there = [r[1] for r in rows if r[0] == _TEXT]
        text, every = "".join(there), []
        for kind, letters, steps, ref_n, alts, alt_n, _ in rows:
            if kind in (_INSIDE, _REACHING):
                starts = np.cumsum(np.frombuffer(steps, np.int32), dtype=np.int64).tolist()
                every += zip(starts, pieces(letters, ref_n), pieces(alts, alt_n), [kind] * len(starts))
        every.sort()
        real = []
        for start, ref, alt, kind in every:
            end = start + len(ref)
            if kind == _INSIDE:
                was = text[start:end]
                if was != ref and was.upper() != ref.upper():
                    continue
                if was == was.lower():
                    alt = alt.lower()
            real.append((start, end, alt))
        return *key, text if there else None, real, [r[-1] for r in rows if r[0] == _ENTRY]

    key, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for contig, chunk, *row in zip(*columns):
            if key != (contig, chunk):
                if rows:
                    yield chunk_of(key, rows)
                key, rows = (contig, chunk), []
            rows.append(tuple(row))
    if rows:
        yield chunk_of(key, rows)


def _gone_through(real: list[tuple], at: int) -> tuple[list[tuple], int]:
    taken = []
    for v in real:
        if v[0] >= at:
            taken.append(v)
            at = v[1]
    return taken, at


def _entered(rows: DataFrame, size: int) -> DataFrame:
    """(contig, chunk, at): how far, from the chunk's begin, the last variant taken before a chunk reaches into it, of the rows of
    all chunks that variants reach out of or into."""
    contig = rows.schema["contig"].dataType.simpleString()

    def frames(found: Iterator[tuple], names: list[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        while own := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind if k == 0 else pa.int64()) for k, c in enumerate(zip(*own))], names=names)

    kind = to_arrow_type(rows.schema["contig"].dataType)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((name, chunk, at, _gone_through(real, at)[1]) for name, chunk, _, real, ends in _chunk_rows(batches) for at in sorted({0, *ends}))
        return frames(found, ["contig", "chunk", "at", "to"], kind)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def along() -> Iterator[tuple]:
            now, state, after = None, 0, 0
            for batch in batches:
                for name, chunk, at, to in zip(*[c.to_pylist() for c in batch.columns]):
                    if now != (name, chunk):
                        # What is left of the reach behind the chunk before; nothing reaches over a chunk that has no rows.
                        state = max(after - size, 0) if now == (name, chunk - 1) else 0
                        now = (name, chunk)
                        yield name, chunk, state
                    if at == state:
                        after = to

        return frames(along(), ["contig", "chunk", "at"], kind)

    led = rows.repartition("contig", "chunk").sortWithinPartitions("contig", "chunk").mapInArrow(maps, f"contig {contig}, chunk long, at long, to long")
    return led.repartition("contig").sortWithinPartitions("contig", "chunk", "at").mapInArrow(follow, f"contig {contig}, chunk long, at long")


def _edited(chunks: DataFrame, variants: DataFrame, size: int, whole: bool) -> DataFrame:
    v = variants.select("contig", (F.col("pos").cast("long") - 1).alias("start"), "ref", "alt").where("contig is not null and start >= 0 and length(ref) > 0 and alt is not null")
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.length("ref") - 1) / size)
    columns = ["contig", "chunk", "kind", "text", "steps", "ref_n", "alts", "alt_n", "at"]
    both = lambda *frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    texts = chunks.select("contig", "chunk", F.lit(_TEXT).alias("kind"), "text")
    rows = both(texts, packed_variants(v.where(first == last), size, _INSIDE)).withColumn("at", F.lit(None).cast("long"))
    # Variants that reach out of their chunk are looked at before, as their reference is in several.
    reaching = saved(v.where(first < last).distinct(), "reaching")
    if not reaching.isEmpty():
        over = lambda df: df.select("contig", F.explode(F.sequence(first, last)).alias("chunk")).distinct()
        spans = reaching.select(F.struct("ref", "alt").alias("key"), "contig", (F.col("start") + 1).alias("start"), (F.col("start") + 1 + F.length("ref")).alias("end"))
        got = fetch(spans, chunks.join(over(reaching), ["contig", "chunk"], "left_semi"), size).where(F.upper("seq") == F.upper(F.col("key")["ref"]))
        alt = F.col("key")["alt"]
        real = saved(got.select("contig", (F.col("start") - 1).alias("start"), F.col("key")["ref"].alias("ref"), F.when(F.lower("seq") == F.col("seq"), F.lower(alt)).otherwise(alt).alias("alt")), "reaching")
        sure = packed_variants(real, size, _REACHING)
        into = real.select("contig", F.explode(F.sequence(first + 1, last)).alias("chunk"), (F.col("start") + F.length("ref")).alias("end"))
        into = into.select("contig", "chunk", F.lit(_ENTRY).alias("kind"), (F.col("end") - F.col("chunk") * size).alias("at")).distinct()
        few = both(rows.join(over(real), ["contig", "chunk"], "left_semi"), sure, into).select(columns)
        rows = both(rows, sure, _entered(few, size).withColumn("kind", F.lit(_ENTRY)))
    rows = rows.select(columns)
    name = to_arrow_type(rows.schema["contig"].dataType)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one_by_one() -> Iterator[tuple]:
            for contig, chunk, text, real, ends in _chunk_rows(batches):
                if text is None:
                    continue
                entry = max(ends, default=0)
                made, at = [], entry
                for start, end, alt in _gone_through(real, entry)[0]:
                    made += [text[at:start], alt]
                    at = end
                yield contig, chunk, "".join([*made, text[at:]])

        def by_contig() -> Iterator[tuple]:
            for contig, own in groupby(one_by_one(), lambda x: x[0]):
                yield contig, None, "".join(x[2] for x in own)

        # Rows go back in batches of some megabytes.
        own, held = [], 0
        for row in by_contig() if whole else one_by_one():
            own.append(row)
            held += len(row[2])
            if held > 4_000_000 or len(own) == 10_000:
                yield batch_of(own)
                own, held = [], 0
        if own:
            yield batch_of(own)

    def batch_of(own: list[tuple]) -> pa.RecordBatch:
        contigs, numbers, texts = zip(*own)
        return pa.RecordBatch.from_arrays([pa.array(contigs, name), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], names=["contig", "chunk", "text"])

    dealt = rows.repartition("contig") if whole else rows.repartition("contig", "chunk")
    return dealt.sortWithinPartitions("contig", "chunk").mapInArrow(edit, f"contig {rows.schema['contig'].dataType.simpleString()}, chunk long, text string")


def consensus_chunks(chunks: DataFrame, variants: DataFrame, size: int) -> DataFrame:
    """(contig, chunk, text): the reference's chunks with the variants (contig, pos, ref, alt) applied in the order of their
    places. One whose reference is not there, whatever the case, or that overlaps the last applied one, is skipped. An
    alternative is in lower case where the reference is. A variant is written in the chunk in which it starts; the chunks that
    it reaches into leave its bases out.

    A chunk meets its variants once. How far variants reach into it is found before, from the chunks that any reaches out of
    or into: such a chunk is gone through for every end that reaches into it, and these maps are followed along the contig."""
    return _edited(chunks, variants, size, False)


def consensus(reference: DataFrame, variants: DataFrame, size: int = 100_000) -> DataFrame:
    """(contig, seq) of (contig, seq): consensus_chunks, put together again to a row per contig. For contigs that are too long
    for a row, take the chunks."""
    return _edited(chunked(reference, size), variants, size, True).select("contig", F.col("text").alias("seq"))


def contrast(calls: DataFrame, plus: list, minus: list, least_dp: int = 0) -> DataFrame:
    """(vid, sample, novel): calls of the plus samples with an allele, or a genotype, that no minus sample has."""
    deep = calls.where((F.coalesce("dp", F.lit(0)) >= least_dp) & F.col("a1").isNotNull() & F.col("a2").isNotNull())
    gt = F.array_sort(F.array("a1", "a2"))
    base = deep.where(F.col("sample").isin(minus)).groupBy("vid").agg(F.flatten(F.collect_set(F.array("a1", "a2"))).alias("alleles"), F.collect_set(gt).alias("gts"))
    own = deep.where(F.col("sample").isin(plus)).join(base, "vid").withColumn("gt", gt)
    novel = F.when(F.exists("gt", lambda a: ~F.array_contains("alleles", a)), "allele").when(~F.array_contains("gts", F.col("gt")), "genotype")
    return own.select("vid", "sample", novel.alias("novel")).where("novel is not null")


def contrast_scores(calls: DataFrame, plus: list, minus: list) -> DataFrame:
    """(vid, score): how sure it is that no plus sample has a minus sample's genotype, of calls with Phred likelihoods pl. A
    plus sample's score is the least sum, over genotypes, of its own value and the least of the minus samples; the site's
    is the least score over 0 of the plus samples. Sites without one are left out."""
    long = calls.where(~F.exists("pl", lambda x: x.isNull())).select("vid", "sample", F.posexplode("pl").alias("k", "x"))
    base = long.where(F.col("sample").isin(minus)).groupBy("vid", "k").agg(F.min("x").alias("y"))
    own = long.where(F.col("sample").isin(plus)).join(base, ["vid", "k"]).groupBy("vid", "sample").agg(F.min(F.col("x") + F.col("y")).alias("score"))
    return own.where("score > 0").groupBy("vid").agg(F.min("score").alias("score"))


def fix_ploidy(calls: DataFrame, regions: DataFrame, sexes: DataFrame) -> DataFrame:
    """Calls (vid, chrom, pos, sample, a1, a2) with the ploidy of their region (chrom, start, end, sex, ploidy) and sex: one
    allele where it is 1, none where it is 0. With likelihoods (pl, n_alleles) the one allele is the best by these, and
    they are made to fit."""
    j = calls.join(sexes, "sample", "left").join(regions.withColumnsRenamed({"chrom": "r_chrom", "sex": "r_sex"}), (F.col("chrom") == F.col("r_chrom")) & (F.col("sex") == F.col("r_sex")) & F.col("pos").between(F.col("start"), F.col("end")), "left")
    p = F.coalesce("ploidy", F.lit(2))
    if "pl" not in calls.columns:
        return j.select("vid", "sample", F.when(p > 0, F.col("a1")).alias("a1"), F.when(p > 1, F.col("a2")).alias("a2"), p.alias("ploidy"))
    one = reshaped_likelihoods(F.col("pl"), F.col("n_alleles"), haploid=True)
    known = F.col("a1").isNotNull() & F.col("a2").isNotNull() & F.col("pl").isNotNull()
    first = F.when((p == 1) & known, one["best"]).when(p > 0, F.col("a1"))
    return j.select("vid", "sample", first.alias("a1"), F.when(p > 1, F.col("a2")).alias("a2"), p.alias("ploidy"), F.when(p == 1, one["values"]).when(p > 1, F.col("pl")).alias("pl"))


def validate(variants: DataFrame, calls: DataFrame | None = None, info_types: dict[str, str] | None = None, block_lines: int = 100_000) -> DataFrame:
    """(vid, rule): a row per broken rule. Columns: chrom, pos, ref, alts, qual, filters, order (the line's number).

    info_types, the header's types by key, checks the map `info`: values of Integer and Float keys, keys without a type.
    With calls, allele numbers are checked, and the declared columns an and ac (an array, one per alternative) if there."""
    # The line before on the same chromosome is in the same block of lines, or the last of the block before that has any.
    name = F.coalesce("chrom", F.lit(""))
    variants = variants.withColumn("__block", F.floor(F.col("order") / block_lines))
    ends = variants.groupBy(name.alias("__chrom"), F.col("__block").alias("__b")).agg(F.max_by("pos", "order").alias("__last"))
    ends = ends.select("__chrom", "__b", F.lag("__last").over(Window.partitionBy("__chrom").orderBy("__b")).alias("__before"))
    variants = variants.join(ends, (name == F.col("__chrom")) & (F.col("__block") == F.col("__b")))
    w = Window.partitionBy("__chrom", "__block").orderBy("order")
    previous = F.when(F.row_number().over(w) == 1, F.col("__before")).otherwise(F.lag("pos").over(w))
    variants = variants.withColumn("__previous", previous).drop("__block", "__b", "__chrom", "__before")
    alleles = "^[ACGTN]+$"
    rules: dict[str, Column] = {
        "no chromosome": F.coalesce(F.col("chrom"), F.lit("")) == "", "position": F.col("pos").isNull() | (F.col("pos") < 0), "reference": ~F.coalesce(F.col("ref").rlike(alleles), F.lit(False)),
        "alternative": F.exists("alts", lambda a: ~a.rlike(r"^[ACGTN*]+$|^<.+>$|[\[\]]")), "equal alleles": F.array_contains("alts", F.col("ref")), "quality": F.col("qual") < 0,
        "filter": F.exists("filters", lambda f: f.rlike(r"[\s;]") | (f == "0")), "unsorted": F.col("pos") < F.col("__previous"), "duplicate position": F.col("pos") == F.col("__previous"),
    }
    if info_types is not None:
        shape = {"Integer": r"^(-?\d+|\.)(,(-?\d+|\.))*$", "Float": r"^([-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?|\.)(,([-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?|\.))*$"}
        bad = [~F.try_element_at("info", F.lit(k)).rlike(shape[kind]) for k, kind in info_types.items() if kind in shape]
        rules["INFO type"] = F.exists(F.array(*bad, F.lit(False)), lambda b: F.coalesce(b, F.lit(False)))
        rules["INFO undeclared"] = F.exists(F.map_keys("info"), lambda k: ~k.isin(*info_types))
    found = variants.select("vid", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])).alias("broken")).select("vid", F.explode("broken").alias("rule"))
    if calls is None:
        return found
    bad = calls.join(variants.select("vid", F.size("alts").alias("n")), "vid").where((F.col("a1") > F.col("n")) | (F.col("a2") > F.col("n"))).select("vid").distinct().withColumn("rule", F.lit("allele number"))
    found = found.union(bad)
    if not {"an", "ac"} <= set(variants.columns):
        return found
    per = calls.select("vid", F.explode(F.array("a1", "a2")).alias("allele")).where("allele is not null").groupBy("vid", "allele").agg(F.count("*").alias("n"))
    real = per.groupBy("vid").agg(F.sum("n").alias("__an"), F.map_from_entries(F.collect_list(F.struct("allele", "n"))).alias("__ac"))  # a site's alleles
    j = variants.select("vid", "alts", "an", "ac").join(real, "vid", "left")
    counted = F.transform(F.sequence(F.lit(1), F.size("alts")), lambda k: F.coalesce(F.try_element_at("__ac", k), F.lit(0).cast("long")))
    recount = {"AN": F.col("an") != F.coalesce("__an", F.lit(0)), "AC": (F.size("alts") > 0) & (F.col("ac").cast("array<bigint>") != counted)}
    return found.union(j.select("vid", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in recount.items()]))).alias("rule")))


def sample_alternatives(variants: DataFrame, calls: DataFrame, sample, haplotype: int | None = None, ambiguity: bool = False) -> DataFrame:
    """variants (vid, contig, pos, ref, alts) that one sample has, with `alt` to build its consensus of: the allele of its
    first or second haplotype, or of both; with ambiguity two unlike single bases are one IUPAC letter, and else the first
    alternative of the call counts. Sites where that is the reference, or missing, are left out."""
    own = variants.join(calls.where(F.col("sample") == F.lit(sample)).select("vid", "a1", "a2"), "vid").withColumn("__alleles", F.concat(F.array("ref"), "alts"))
    base = lambda c: F.get("__alleles", F.col(c))
    if haplotype is not None:
        alt = F.when(F.col(f"a{haplotype}") > 0, base(f"a{haplotype}"))
    else:
        alt = F.when(F.col("a1") > 0, base("a1")).when(F.col("a2") > 0, base("a2"))
        if ambiguity:
            alt = F.when(F.col("a1") != F.col("a2"), F.coalesce(iupac(base("a1"), base("a2")), alt)).otherwise(alt)
    return own.withColumn("alt", alt).where("alt is not null").drop("a1", "a2", "__alleles")


def permutations(labels: DataFrame, times: int, seed: int = 11) -> DataFrame:
    """(round, place, label): labels (group, place, label) dealt anew within their groups, the same way for a seed."""
    rounds = labels.sparkSession.range(times).select((F.col("id") + 1).alias("round"))
    every = labels.join(F.broadcast(rounds), how="cross")
    w = Window.partitionBy("round", "group")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("round").cast("string"), F.col("label").cast("string")))
    a = every.select("round", "group", "place", F.row_number().over(w.orderBy("place", "label")).alias("k"))
    b = every.select("round", "group", "label", F.row_number().over(w.orderBy(key, "label", "place")).alias("k"))
    return a.join(b, ["round", "group", "k"]).select("round", "group", "place", "label")


def remove_tags(variants: DataFrame, info: list[str] = (), filters: list[str] = (), ids: bool = False) -> DataFrame:
    out = variants.withColumn("info_map", F.map_filter("info_map", lambda k, _: ~k.isin(*info))) if info else variants
    for f in filters:
        out = out.withColumn("filters", F.array_remove("filters", f))
    return out.withColumn("id", F.lit(None).cast("string")) if ids else out


def same_sequence(left: DataFrame, right: DataFrame) -> DataFrame:
    """(group, n_common): variants (group, off, ref, alt, slice) of two files; each applied alone to its group's slice of the
    reference; a group matches where the files share a resulting sequence."""
    made = lambda v: v.select("group", F.concat(F.expr("substring(slice, 1, cast(off as int))"), "alt", F.expr("substring(slice, cast(off as int) + length(ref) + 1)")).alias("made")).distinct()
    return made(left).join(made(right), ["group", "made"]).groupBy("group").agg(F.count("*").alias("n_common"))


def binned_stats(variants: DataFrame, value: str, width: float, most: float) -> DataFrame:
    """(bin, type, n) by a value's bins up to `most`, and over all with a null bin: grouping sets."""
    b = variants.withColumn("bin", F.least(F.floor(F.col(value) / width) * width, F.lit(most)).cast("double"))
    return b.groupingSets([["bin", "type"], ["type"], []], "bin", "type").agg(F.count("*").alias("n"))


def sample_stats(variants: DataFrame, calls: DataFrame) -> DataFrame:
    """(sample, n, n_snp, n_indel, n_multi, n_private, n_shared, n_ts): sites where a sample has an alternative allele, by kind,
    and by whether other samples have one too."""
    from helixframe.functions.variants import is_indel, is_snp, is_transition

    own = calls.where("a1 > 0 or a2 > 0").select("sample", "vid")
    carriers = own.groupBy("vid").agg(F.count_distinct("sample").alias("carriers"))
    single = is_snp() & (F.size("alts") == 1)
    return own.join(carriers, "vid").join(variants.select("vid", "ref", "alts"), "vid").groupBy("sample").agg(
        F.count("*").alias("n"), F.count_if(single).alias("n_snp"), F.count_if(is_indel()).alias("n_indel"), F.count_if(F.size("alts") > 1).alias("n_multi"),
        F.count_if(F.col("carriers") == 1).alias("n_private"), F.count_if(F.col("carriers") > 1).alias("n_shared"), F.count_if(is_transition()).alias("n_ts"),
    )


def variant_counts(variants: DataFrame, calls: DataFrame, value: Column, width: float, most: float) -> DataFrame:
    """(bin, stat, key, n) by bins of a value up to `most`, and over all with a null bin. Of alleles: change (of single bases,
    A>C) and indel (the difference of lengths); of sites: n_alt, and carriers, the number of samples with an alternative."""
    b = variants.select("vid", "ref", "alts", F.least(F.floor(value / width) * width, F.lit(most)).cast("double").alias("bin"))
    entry = lambda stat, key: F.struct(F.lit(stat).alias("stat"), key.alias("key"))

    def allele(alt: Column) -> Column:
        e = event(F.col("ref"), alt)["type"]
        return F.when(e == "s1", entry("change", F.concat("ref", F.lit(">"), alt))).when(e.startswith("i"), entry("indel", F.substring(e, 2, 20)))

    carriers = calls.where("a1 > 0 or a2 > 0").groupBy("vid").agg(F.count_distinct("sample").alias("c"))
    own = b.join(carriers, "vid", "left")
    entries = F.concat(F.array_compact(F.transform("alts", allele)), F.array(entry("n_alt", F.size("alts").cast("string")), entry("carriers", F.coalesce("c", F.lit(0)).cast("string"))))
    long = own.select("bin", F.explode(entries).alias("e")).select("bin", "e.stat", "e.key").withColumn("all", F.lit(True))
    return long.groupingSets([["bin", "stat", "key"], ["all", "stat", "key"]], "bin", "all", "stat", "key").agg(F.count("*").alias("n")).where("all or bin is not null").drop("all")


# Residues.


def residue_frame(residues: DataFrame, alignment: DataFrame) -> DataFrame:
    """Residues (structid, chain, seqid, x, y, z, ..) that an alignment (structid, chain, seqid, unp_pos) places, without hetero
    groups where `hetero` says so."""
    own = residues.where(~F.coalesce("hetero", F.lit(False))) if "hetero" in residues.columns else residues
    return own.join(alignment.select("structid", "chain", "seqid", "unp_pos"), ["structid", "chain", "seqid"])


def protein_chains(residues: DataFrame, chains: DataFrame | None = None, species: str = "HUMAN") -> DataFrame:
    """(structid, chain, seq) of residues (structid, chain, seqid, letter): in their order, unknown letters as serine. Hetero
    groups and numbers under 1 go; with chains (structid, chain, species, first, last) also other species, unlisted chains and
    residues outside first to last."""
    own = residues.where("seqid >= 1")
    own = own.where(~F.coalesce("hetero", F.lit(False))) if "hetero" in own.columns else own
    if chains is not None:
        own = own.join(chains.where(F.col("species") == species), ["structid", "chain"]).where(F.col("seqid").between(F.col("first"), F.col("last")))
    letters = F.array_sort(F.collect_list(F.struct("seqid", F.coalesce("letter", F.lit("S")).alias("l"))))  # a chain's residues
    return own.groupBy("structid", "chain").agg(F.array_join(F.transform(letters, lambda x: x["l"]), "").alias("seq"))


def renumbered(residues: DataFrame, begins: DataFrame | None = None) -> DataFrame:
    """(structid, chain, seqid, number): a chain's residues counted from 1, or from where begins (structid, chain, begin) says that
    the window of a model begins."""
    w = Window.partitionBy("structid", "chain").orderBy("seqid")
    own = residues.select("structid", "chain", "seqid", F.row_number().over(w).alias("k"))
    own = own.withColumn("begin", F.lit(1)) if begins is None else own.join(begins, ["structid", "chain"])
    return own.select("structid", "chain", "seqid", (F.col("k") + F.col("begin") - 1).cast("long").alias("number"))


def variable_residues(view: DataFrame, flag: Column, value: Column) -> DataFrame:
    """(structid, chain, seqid) of a structure view's residues with the flag; of a structure without any such, of those with a
    value."""
    r = view.select("structid", "chain", "seqid", F.coalesce(flag, F.lit(False)).alias("f"), value.isNotNull().alias("v"))
    some = r.groupBy("structid").agg(F.bool_or("f").alias("some"))
    return r.join(some, "structid").where("f or (not some and v)").select("structid", "chain", "seqid").distinct()


def view_order(view: DataFrame, order: list[str]) -> DataFrame:
    """view with `k`, a row's place in its structure."""
    return view.withColumn("k", F.row_number().over(Window.partitionBy("structid").orderBy(*order)))


def letters(residues: DataFrame, modified: DataFrame | None = None, unknown: str | None = None) -> DataFrame:
    """residues (structid, resname, ..) with `letter`: of the name itself, or of the standard residue that the structure's own list
    (structid, resname, standard) gives for it."""
    own = one_letter(F.col("resname"))
    if modified is None:
        return residues.withColumn("letter", F.coalesce(own, F.lit(unknown)))
    per = modified.groupBy("structid", F.upper("resname").alias("__name")).agg(F.min("standard").alias("__standard"))
    out = residues.withColumn("__name", F.upper("resname")).join(per, ["structid", "__name"], "left")
    return out.withColumn("letter", F.coalesce(own, one_letter(F.col("__standard")), F.lit(unknown))).drop("__name", "__standard")
