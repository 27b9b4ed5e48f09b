"""Two sorted site lists merged step by step, as maps of states that bins hand on along a chromosome.

The merge looks at the heads of both lists. Equal positions are taken together; else the earlier head takes the later one
along if its reference reaches it, and goes alone if not. What is done before a position therefore depends on everything
before it, but not by much: when all sites left of a bin are done, the only thing that matters is which list had sites
inside the bin, or after it, taken already, and how many. That is the state.

1. Each bin is merged for every state that it can be entered in. There are as many as references reach into it, and one.
2. A bin's states lead to states of the next one; these maps are followed along each chromosome, a row per bin.
3. Each bin is merged once more from the state that it is really entered in, and says what it takes.

Bins also see the sites behind them that their references reach, so nothing depends on where bins are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.sources.scratch import saved

WILD = ("N", ".", "")


def merge_steps(lists: tuple[list, list], end: float, side: int, taken: int) -> Iterator[tuple[str, tuple | None, tuple | None, int, int]]:
    """(kind, first, second, side, taken) of each step until both heads are at `end` or after it. lists: (pos, ref) in order; the
    first `taken` of the side's are done already. side and taken of the last step are the state behind `end`."""
    at = [taken if side == 0 else 0, taken if side == 1 else 0]
    more = max(0, taken - len(lists[side]))  # of those that are taken and can't be seen from here
    while True:
        one, two = (x[i] if i < len(x) else None for x, i in zip(lists, at, strict=True))
        if (one is None or one[0] >= end) and (two is None or two[0] >= end):
            break
        if two is None or one is not None and one[0] < two[0]:
            kind = "O" if two is not None and two[0] < one[0] + len(one[1]) else "1"
        elif one is None or two[0] < one[0]:
            kind = "O" if one is not None and one[0] < two[0] + len(two[1]) else "2"
        else:
            kind = "B" if one[1] == two[1] or one[1] in WILD or two[1] in WILD else "O"
        if kind != "2":
            at[0] += 1
        if kind != "1":
            at[1] += 1
        yield kind, one if kind != "2" else None, two if kind != "1" else None, 0, 0
    beyond = [sum(1 for x in own[: min(i, len(own))] if x[0] >= end) for own, i in zip(lists, at, strict=True)]
    beyond[side] += more
    yield "", None, None, int(beyond[1] > 0), max(beyond)


def _lists(part: pd.DataFrame) -> tuple[list, list]:
    own = part[part["reach"].isna()].sort_values(["pos", "ref"])
    return tuple(list(zip(x["pos"].tolist(), x["ref"].tolist(), strict=True)) for x in (own[own["side"] == s] for s in (0, 1)))  # type: ignore[return-value]


def diff_sites(left: DataFrame, right: DataFrame, bin_width: int = 100_000) -> DataFrame:
    """(chrom, pos1, pos2, kind, ref1, ref2) of two site lists (chrom, pos, ref): B, one position and reference (N, '.' and ''
    match anything); O, one position and another reference, or the earlier one's reference reaches the later position; 1 and
    2, on one side only. Sites of one position are in the order of their references, and each is taken once."""
    both = left.select("chrom", "pos", F.coalesce("ref", F.lit("")).alias("ref"), F.lit(0).alias("side")).union(right.select("chrom", "pos", F.coalesce("ref", F.lit("")).alias("ref"), F.lit(1).alias("side")))
    both = saved(both.where("pos is not null").withColumn("pos", F.col("pos").cast("long")).withColumn("bin", F.floor(F.col("pos") / bin_width)), "sites")
    # A row for each bin that a reference reaches from an earlier one: what may be taken there, and what a bin has to see.
    last = F.floor((F.col("pos") + F.length("ref") - 1) / bin_width)
    reaching = both.where(last > F.col("bin")).select("chrom", "bin", "side", (F.col("pos") + F.length("ref")).alias("end"), F.explode(F.sequence(F.col("bin") + 1, last)).alias("into"))
    seen = reaching.groupBy("chrom", "bin", "into", "side").agg(F.max("end").alias("end")).withColumnRenamed("bin", "from")
    halo = both.join(seen.select("chrom", F.col("into").alias("bin"), (1 - F.col("side")).alias("side"), "from", "end"), ["chrom", "bin", "side"]).where("pos < end")
    halo = halo.select("chrom", F.col("from").alias("bin"), "side", "pos", "ref", F.lit(None).cast("int").alias("reach"))
    entries = reaching.groupBy("chrom", "into", "side").agg(F.count("*").cast("int").alias("reach")).select("chrom", F.col("into").alias("bin"), (1 - F.col("side")).alias("side"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("ref"), "reach")
    rows = saved(both.select("chrom", "bin", "side", "pos", "ref", F.lit(None).cast("int").alias("reach")).union(halo).union(entries), "bins")

    def maps(part: pd.DataFrame) -> pd.DataFrame:
        lists, end = _lists(part), (part["bin"].iloc[0] + 1) * bin_width
        states = [(0, 0)] + [(int(s), k) for s, n in zip(part["side"], part["reach"], strict=True) if n == n for k in range(1, int(n) + 1)]
        out = []
        for side, taken in states:
            for step in merge_steps(lists, end, side, taken):
                pass
            out.append((part["chrom"].iloc[0], part["bin"].iloc[0], side, taken, step[3], step[4]))
        return pd.DataFrame(out, columns=["chrom", "bin", "side", "taken", "to_side", "to_taken"])

    def follow(part: pd.DataFrame) -> pd.DataFrame:
        lead: dict = {}
        for b, side, taken, to_side, to_taken in part[["bin", "side", "taken", "to_side", "to_taken"]].itertuples(index=False):
            lead.setdefault(b, {})[side, taken] = (to_side, to_taken)
        state, out = (0, 0), []
        for b in sorted(lead):
            out.append((part["chrom"].iloc[0], b, *state))
            state = lead[b][state]
            state = state if state[1] else (0, 0)
        return pd.DataFrame(out, columns=["chrom", "bin", "side", "taken"])

    entered = rows.groupBy("chrom", "bin").applyInPandas(maps, "chrom string, bin long, side int, taken int, to_side int, to_taken int").groupBy("chrom").applyInPandas(follow, "chrom string, bin long, side int, taken int")

    def take(part: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        end = (part["bin"].iloc[0] + 1) * bin_width
        out = []
        for kind, one, two, _, _ in merge_steps(_lists(part), end, int(entry["side"].iloc[0]), int(entry["taken"].iloc[0])):
            if kind:
                out.append((part["chrom"].iloc[0], one and one[0], two and two[0], kind, one and one[1], two and two[1]))
        return pd.DataFrame(out, columns=["chrom", "pos1", "pos2", "kind", "ref1", "ref2"]).astype({"pos1": "Int64", "pos2": "Int64"})

    return rows.groupBy("chrom", "bin").cogroup(entered.groupBy("chrom", "bin")).applyInPandas(take, "chrom string, pos1 long, pos2 long, kind string, ref1 string, ref2 string")


def without_overlaps(rows: DataFrame, bin_width: int = 100_000, slot_rows: int = 200_000) -> DataFrame:
    """rows (contig, start, end, order): those that are taken if a contig is gone through in the order of start and `order`, and a
    row is skipped that starts before the end of the last one taken. end is exclusive.

    The state is that end. A bin goes through its rows for every end that reaches into it, these maps are followed along the
    contig, and then each bin goes through its rows once."""
    own = saved(rows.withColumn("bin", F.floor(F.col("start") / bin_width)), "rows")
    # Bins are small where contigs are; a task takes some thousands of rows' bins at once.
    slots = F.lit(max(1, -(-own.count() // slot_rows)))
    slot, of_contig = F.pmod(F.xxhash64("contig", "bin"), slots).cast("int"), F.pmod(F.xxhash64("contig"), slots).cast("int")
    last = F.floor((F.col("end") - 1) / bin_width)
    ends = own.where(last > F.col("bin")).select("contig", F.explode(F.sequence(F.col("bin") + 1, last)).alias("bin"), "end").distinct()
    both = own.select("contig", "bin", "start", "end", "order", F.lit(False).alias("entry")).union(ends.select("contig", "bin", F.lit(None).cast("long"), "end", F.lit(None).cast(own.schema["order"].dataType), F.lit(True)))

    def bins_of(part: pd.DataFrame) -> Iterator[tuple[object, int, int, int]]:
        """(contig, bin, begin, end) of the rows of each bin in a sorted frame."""
        contigs, bins = part["contig"].tolist(), part["bin"].tolist()
        begin = 0
        for i in range(1, len(bins) + 1):
            if i == len(bins) or bins[i] != bins[begin] or contigs[i] != contigs[begin]:
                yield contigs[begin], bins[begin], begin, i
                begin = i

    def gone_through(starts: list[int], ends: list[int], rows: range, at: int) -> list[int]:
        taken = []
        for k in rows:
            if starts[k] >= at:
                taken.append(k)
                at = ends[k]
        return taken

    def maps(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["contig", "bin", "entry", "start", "order"])
        starts, ends, entry = part["start"].fillna(0).astype("int64").tolist(), part["end"].tolist(), part["entry"].tolist()
        out = []
        for contig, b, i, j in bins_of(part):
            first = next((k for k in range(i, j) if entry[k]), j)
            for at in [0, *sorted(set(ends[first:j]))]:
                taken = gone_through(starts, ends, range(i, first), at)
                out.append((contig, b, at, max(at, ends[taken[-1]]) if taken else at))
        return pd.DataFrame(out, columns=["contig", "bin", "at", "to"])

    contig_type = own.schema["contig"].dataType.simpleString()

    def follow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["contig", "bin"])
        ats, tos = part["at"].tolist(), part["to"].tolist()
        out, now, state = [], None, 0
        for contig, b, i, j in bins_of(part):
            state = state if contig == now and state > b * bin_width else 0
            out.append((contig, b, state))
            now, state = contig, dict(zip(ats[i:j], tos[i:j], strict=True))[state]
        return pd.DataFrame(out, columns=["contig", "bin", "at"])

    entered = both.groupBy(slot.alias("slot")).applyInPandas(maps, f"contig {contig_type}, bin long, at long, to long").groupBy(of_contig.alias("slot")).applyInPandas(follow, f"contig {contig_type}, bin long, at long")

    def take(part: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["contig", "bin", "start", "order"])
        at = {(c, b): x for c, b, x in zip(entry["contig"], entry["bin"], entry["at"], strict=True)}
        starts, ends = part["start"].tolist(), part["end"].tolist()
        taken = [k for contig, b, i, j in bins_of(part) for k in gone_through(starts, ends, range(i, j), at[contig, b])]
        return part.iloc[taken].drop(columns="slot")

    first, second = own.withColumn("slot", slot), entered.withColumn("slot", slot)
    return first.groupBy("slot").cogroup(second.groupBy("slot")).applyInPandas(take, own.schema).drop("bin")
