"""Near-duplicates by 64-bit SimHash, with deletion-variant signatures.

Two fingerprints that differ in at most two of 64 bits, cut into two segments of 32, have a segment that differs in at
most one bit. If no segment is equal, both differ in one bit: the first segment's variants with each one of its bits deleted are indexed; a variant with the deleted bit 0
joins those with the bit 1, so an equality join meets exactly the pairs whose segment differs in that bit, once. Pairs
with an equal segment meet in a second, finer index: the equal segment together with one half of the other, of which one
half differs in at most one bit, by the same variants. The join's condition verifies the distance.

All work on links is done on distinct fingerprints, so copies cost nothing there. Components come from rounds of star
contraction, each a few joins over links, written to the shared folder; only counts reach the driver.

Nulls: a null text has no words and fingerprint zero, and is linked like any other. A null doc_id sorts after all others
(a component of such rows alone has a null id). Repeated rows share a fingerprint and hence a component. An empty table
gives an empty one. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import as_bytes, saved, slices, texts_of, whole_row

SEED = 42


def simhash(text: bytes, size: int = 3) -> int:
    """The 64-bit fingerprint of a text's shingles of so many words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-size].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], ">u8")
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


#: Two hashes of a text: what tells the rows of a doc_id, or without one, from each other.
KEYS = ("__hx_k1", "__hx_k2")


def with_keys(rows: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return rows.withColumn(KEYS[0], F.xxhash64(text)).withColumn(KEYS[1], F.xxhash64(F.lit(1), text))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) and the keys, a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps = np.array([simhash(x, shingle) for x in as_bytes(part.column("text"))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps), *(part.column(k) for k in KEYS)], ["doc_id", "fp", *KEYS])

    return with_keys(texts_of(docs)).mapInArrow(run, f"doc_id long, fp long, {KEYS[0]} long, {KEYS[1]} long")


def near_links(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints (column fp) within two bits, each once.

    Keys are packed into one long. Equal segments: only those that several fingerprints have go one level down. Two
    segments that both differ in one bit: the first one's variants, and whether the second has an odd number of bits set,
    which must differ too."""
    high = F.shiftrightunsigned(F.col("fp"), 32)
    low = F.col("fp").bitwiseAND(0xFFFFFFFF)

    def meet(rows: DataFrame) -> DataFrame:
        """Rows (fp, key, set): those with the deleted bit 0 against those with 1."""
        x, y = rows.where(~F.col("set")).drop("set"), rows.where("set").select(F.col("fp").alias("fp2"), "key")
        return x.hint("merge").join(y, "key").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= 2).select("fp", "fp2")

    wild = distinct.select("fp", high.alias("own"), (F.bit_count(low) % 2).alias("odd"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit"))
    one = F.expr("shiftleft(1L, bit)")
    is_set = F.col("own").bitwiseAND(one) != 0
    # The side of the join is the bit, and the parity is turned on one side, so that equal keys mean unequal parities.
    turned = F.when(is_set, 1 - F.col("odd")).otherwise(F.col("odd")).cast("long")
    key = F.col("own").bitwiseAND(F.bitwise_not(one)) + F.expr("shiftleft(cast(bit as bigint), 32)") + F.shiftleft(turned, 37)
    pairs = meet(wild.select("fp", key.alias("key"), is_set.alias("set")))

    cut = distinct.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), high.alias("own"), low.alias("other")), F.struct(F.lit(1).alias("seg"), low.alias("own"), high.alias("other")))).alias("x")).select("fp", "x.*")
    shared = cut.groupBy("seg", "own").agg(F.count("*").alias("n")).where("n > 1").select("seg", "own")
    cut = cut.hint("merge").join(shared, ["seg", "own"])
    half = F.explode(F.array(F.struct(F.lit(0).alias("half"), F.expr("shiftright(other, 16)").alias("part")), F.struct(F.lit(1).alias("half"), F.col("other").bitwiseAND(0xFFFF).alias("part"))))
    deep = cut.select("fp", "seg", "own", half.alias("h")).select("fp", "seg", "own", "h.*")
    place = F.col("own") + F.expr("shiftleft(cast(seg as bigint), 32)") + F.expr("shiftleft(cast(half as bigint), 33)")
    small = F.col("part").bitwiseAND(F.bitwise_not(one))
    bits = deep.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(15))))
    pairs = pairs.union(meet(bits.select("fp", (place + F.expr("shiftleft(cast(bit as bigint), 34)") + F.shiftleft(small, 38)).alias("key"), (F.col("part").bitwiseAND(one) != 0).alias("set"))))
    same = deep.select("fp", (place + F.shiftleft(F.col("part"), 38)).alias("key"))
    near = same.hint("merge").join(same.select(F.col("fp").alias("fp2"), "key"), "key").where((F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= 2))
    pairs = pairs.union(near.select("fp", "fp2"))
    return pairs.select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b")).distinct()


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of the links (a, b): the least node reachable. Rounds of star contraction.

    A large star links each greater neighbour of a node to the least one; a small star each lesser neighbour. Both read the
    least neighbour by an aggregate and a join, so a node with very many links is never one task's group."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("least"))
        near = both.where("b > a") if large else both.union(both.select("a", F.col("a").alias("b")).distinct())
        out = near.join(least, F.col("a") == F.col("n")).where("b <> least")
        return out.select(F.col("least").alias("a"), "b").distinct()

    edges, before = saved(links.where("a < b"), "links"), None
    for _ in range(most_rounds):
        edges = saved(star(star(edges, True), False), "links")
        now = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("count(distinct a)")).first())
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now
    raise RuntimeError("components: links still change")


def _rooted(prints: DataFrame) -> DataFrame:
    """(fp, first, root) for every distinct fingerprint: the least row that has it, ids first, and the component's root."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEYS)
    distinct = saved(prints.groupBy("fp").agg(F.min(row).alias("first")), "distinct")
    of = components(near_links(distinct.select("fp")))
    return distinct.join(of, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id), a row per document: the smallest doc_id reachable over links of at most two bits."""
    prints = saved(fingerprints(docs, shingle), "fingerprints")
    whole = _rooted(prints)
    ids = whole.groupBy(F.col("root").alias("r")).agg(F.min("first")["doc_id"].alias("component_id"))
    named = whole.join(ids, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return prints.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def keep_one_per_component(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id, nulls last, then of the least hash of
    the text; of rows that share both, one."""
    prints = saved(fingerprints(docs, shingle), "fingerprints")
    least = _rooted(prints).groupBy("root").agg(F.min("first").alias("x")).select("x.doc_id", *[f"x.{k}" for k in KEYS])
    own = ("keep", "own1", "own2")

    def same(x: tuple[str, ...], y: tuple[str, ...]):
        return F.col(x[0]).eqNullSafe(F.col(y[0])) & (F.col(x[1]) == F.col(y[1])) & (F.col(x[2]) == F.col(y[2]))

    kept = saved(prints.join(least.toDF(*own), same(("doc_id", *KEYS), own)).groupBy(*own).agg(F.count("*").alias("n")), "kept")
    # The input's columns stay in one struct, so that they may have any names.
    rows = with_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), whole_row(docs).alias("row"))).drop("text")
    out = rows.join(kept, same(("doc_id", *KEYS), own))
    if not kept.where("n > 1").limit(1).count():
        return out.select("row.*")
    # Only where rows share id and text: the least by the other columns, nulls last, which partial aggregates find.
    fields = [F.col("row").getField(c) for c in docs.columns]
    least_of = F.struct(*[F.struct(x.isNull().alias("none"), x.alias("v")).alias(f"c{i}") for i, x in enumerate(fields)])
    one = out.where("n > 1").groupBy(*own).agg(F.min(least_of).alias("x")).select(*[F.col("x")[f"c{i}"]["v"].alias(c) for i, c in enumerate(docs.columns)])
    return out.where("n = 1").select("row.*").union(one)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
