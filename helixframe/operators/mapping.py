"""From genome to structure: interval joins, structure views, identifier maps and alignments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.ranges import dealt, grid_join, merged, range_join
from helixframe.sources.scratch import saved


PLACE = ["structid", "chain", "seqid"]


def intersect(consequences: DataFrame, mapped: DataFrame) -> DataFrame:
    """Variants in structures: (gc_id, structid, chain, seqid), distinct. consequences, with unique gc_id: gc_id, chrom, pos,
    end_pos, transcript; mapped: b_chrom, b_start, b_end, b_transcript, structid, chain, seqid. Half-open overlap; the
    transcripts must be equal where the consequence has one.

    A residue's intervals are merged before the join: a consequence of one base then meets a residue once, and only longer
    ones' rows are made distinct."""
    rows = consequences.select("gc_id", "chrom", "pos", "end_pos", F.coalesce("transcript", F.lit("")).alias("transcript"))
    some = F.col("transcript") != ""
    every, own = merged(mapped, ["b_chrom", *PLACE], "b_start", "b_end"), merged(mapped, ["b_chrom", "b_transcript", *PLACE], "b_start", "b_end")

    def hits(c: DataFrame) -> DataFrame:
        l, r = ("chrom", "pos", "end_pos"), ("b_chrom", "b_start", "b_end")  # noqa: E741
        of_own = range_join(c.where(some), own, l, r, width=256, keep=F.col("transcript") == F.col("b_transcript"))
        return range_join(c.where(~some), every, l, r, width=256).select("gc_id", *PLACE).union(of_own.select("gc_id", *PLACE))

    short = F.col("end_pos") - F.col("pos") <= 1
    return hits(rows.where(short)).union(hits(rows.where(~short)).distinct())


def intersection_counts(consequences: DataFrame, mapped: DataFrame) -> DataFrame:
    """(structid, n, n_consequences) of intersect(): rows and consequences by structure. Consequences of one place and
    transcript are looked up once and counted as many times."""
    at = ["chrom", "pos", "end_pos", F.coalesce("transcript", F.lit("")).alias("transcript")]
    places = consequences.groupBy(*at).agg(F.count("*").alias("weight"))
    places = places.withColumn("gc_id", F.struct("chrom", "pos", "end_pos", "transcript", "weight"))
    per = intersect(places, mapped).groupBy("structid", "gc_id").agg(F.count("*").alias("m"))
    weight = F.col("gc_id")["weight"]
    return per.groupBy("structid").agg(F.sum(F.col("m") * weight).alias("n"), F.sum(weight).alias("n_consequences"))


def contained(consequences: DataFrame, mapped: DataFrame, residues: DataFrame) -> DataFrame:
    """(gc_id, structid, chain, seqid, res_id): consequences inside a mapped interval; residues by a left join on all three
    of structure, chain and number."""
    some = F.coalesce(F.col("transcript"), F.lit("")) != ""
    inside = lambda c, same: range_join(c, mapped, ("chrom", "pos", "end_pos"), ("b_chrom", "b_start", "b_end"), "within", 256, same).select("gc_id", *PLACE)
    # Equal transcripts are a key of the join, so that those of others are not paired.
    got = inside(consequences.where(~some), None).union(inside(consequences.where(some), F.col("transcript") == F.col("b_transcript")))
    return got.join(residues.select("structid", "chain", "seqid", "res_id"), ["structid", "chain", "seqid"], "left")


def structure_view(residues: DataFrame, chains: DataFrame, structures: DataFrame, models: DataFrame, intersection: DataFrame, consequences: DataFrame, data: DataFrame, alignments: DataFrame, transcripts: DataFrame, scores: DataFrame, domains: DataFrame, first: bool = False) -> DataFrame:
    """Residues with all that is known of them, left-joined: their chain (unp), structure (method, resolution) or model
    (model_method, mpqs), the variants that fall on them (gc_id), their consequences and data, the residue's place in a
    transcript (alignments: structid, chain, seqid, enst, ens_seqid), the transcript (enst, ens_seqid, gene), the alignment's
    score (structid, chain, enst, perc_identity) and the domain it lies in (structid, chain, seqstart, seqend, domain).

    method is the structure's, else the model's. A consequence that names a transcript is kept where it is the aligned one.
    first: of rows that are alike but for transcript or domain only those that one_per_variant() may choose."""
    own = ["structid", "chain"]
    out = residues.join(chains, own, "left").join(structures, "structid", "left").join(models, "structid", "left")
    out = out.withColumn("method", F.coalesce("method", "model_method")).drop("model_method")
    d = domains.select(F.col("structid").alias("d_struct"), F.col("chain").alias("d_chain"), "seqstart", "seqend", "domain")
    inside = (F.col("structid") == F.col("d_struct")) & (F.col("chain") == F.col("d_chain")) & F.col("seqid").between(F.col("seqstart"), F.col("seqend"))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    if first:
        least = residues.select(*PLACE).distinct().join(d, inside).groupBy(*PLACE).agg(F.min_by("domain", named("domain")).alias("domain"))
        out = out.join(least, PLACE, "left")
    else:
        out = out.join(d, inside, "left").drop("d_struct", "d_chain", "seqstart", "seqend")
    # What lies on a residue is put together by itself; the two joins by place, which multiply the rows, come last.
    lying = intersection.join(residues, PLACE, "left_semi").join(consequences.select("gc_id", "vid", F.col("transcript").alias("vep_trans"), "consequence"), "gc_id", "left").join(data.select("vid", "qual", "id"), "vid", "left")
    lying = lying.withColumn("is_missense", F.coalesce(F.col("consequence").contains("missense_variant"), F.lit(False)).cast("int"))
    aligned = alignments.join(residues, PLACE, "left_semi").join(transcripts, ["enst", "ens_seqid"], "left").join(scores, [*own, "enst"], "left")
    free = F.coalesce("vep_trans", F.lit("")) == ""
    if first:
        # What names no transcript meets the least one alone, what names one its own.
        lying, aligned = saved(lying, "lying"), saved(aligned, "aligned")
        columns = [c for c in aligned.columns if c not in PLACE]
        best = aligned.groupBy(*PLACE).agg(F.min_by(F.struct(*columns), named("enst")).alias("best")).select(*PLACE, "best.*")
        hits = lying.where(free).join(best, PLACE, "left").unionByName(lying.where(~free).join(aligned.withColumn("vep_trans", F.col("enst")), [*PLACE, "vep_trans"]))
        out = out.join(hits, PLACE).unionByName(out.join(lying, PLACE, "left_anti").join(best, PLACE, "left"), allowMissingColumns=True)
    else:
        out = dealt(out, *PLACE).join(dealt(lying, *PLACE), PLACE, "left").join(dealt(aligned, *PLACE), PLACE, "left").where(free | (F.col("vep_trans") == F.col("enst")))
    return out.withColumn("is_missense", F.coalesce("is_missense", F.lit(0)))


def one_per_variant(view: DataFrame) -> DataFrame:
    """One row of a structure view per variant and residue: the first by transcript, domain and consequence."""
    first = Window.partitionBy("vid", "res_id").orderBy(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("enst", "domain", "gc_id")])
    return view.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")


def domain_ranges(residues: DataFrame, domains: DataFrame) -> DataFrame:
    """(res_id, domain): residues whose number lies between a domain's ends."""
    a = residues.select("res_id", F.concat_ws(":", "structid", "chain").alias("s"), "seqid", (F.col("seqid") + 1).alias("s_end"))
    d = domains.select(F.concat_ws(":", "structid", "chain").alias("d"), F.col("seqstart").alias("d_start"), (F.col("seqend") + 1).alias("d_end"), "domain")
    return range_join(a, d, ("s", "seqid", "s_end"), ("d", "d_start", "d_end"), width=32).select("res_id", "domain")


def user_annotation(view: DataFrame, table: DataFrame) -> DataFrame:
    """view with `value` of a user's table: by (chrom, pos, id), or else by (structid, chain, seqid)."""
    a = table.where("chrom is not null").groupBy("chrom", "pos", "id").agg(F.max("value").alias("by_site"))
    b = table.where("structid is not null").groupBy("structid", "chain", "seqid").agg(F.max("value").alias("by_residue"))
    return view.join(a, ["chrom", "pos", "id"], "left").join(b, ["structid", "chain", "seqid"], "left").withColumn("value", F.coalesce("by_site", "by_residue")).drop("by_site", "by_residue")


# Identifiers: edges (unp, id_type, ext_id).


def base_unp(c: str = "unp") -> Column:
    return F.split(c, "-")[0]


def ids_of(edges: DataFrame, id_type: str) -> DataFrame:
    return edges.where(F.col("id_type") == id_type).select("unp", "ext_id").distinct()


def best_unp(edges: DataFrame) -> DataFrame:
    """(unp, best): for an accession without a dash the first isoform of it that shares its UniParc id, else itself."""
    u = ids_of(edges, "UniParc")
    plain = edges.select("unp").distinct().where(~F.col("unp").contains("-"))
    iso = u.where(F.col("unp").contains("-")).select(F.col("unp").alias("iso"), "ext_id", base_unp().alias("base"))
    best = u.join(iso, (u["unp"] == iso["base"]) & (u["ext_id"] == iso["ext_id"])).groupBy(u["unp"]).agg(F.min("iso").alias("best"))
    whole = plain.join(best, "unp", "left").select("unp", F.coalesce("best", "unp").alias("best"))
    return whole.union(edges.select("unp").distinct().where(F.col("unp").contains("-")).select("unp", F.col("unp").alias("best")))


def canonical(edges: DataFrame) -> DataFrame:
    """(unp, canonical): whether an isoform's UniParc ids hold one of its base's."""
    u = ids_of(edges, "UniParc")
    b = u.where(~F.col("unp").contains("-")).select(F.col("unp").alias("base"), F.col("ext_id").alias("base_id"))
    iso = u.where(F.col("unp").contains("-"))
    return iso.join(b, base_unp() == F.col("base"), "left").groupBy("unp").agg(F.coalesce(F.bool_or(F.col("ext_id") == F.col("base_id")), F.lit(False)).alias("canonical"))


def transcripts_of(edges: DataFrame, id_type: str = "Ensembl_TRS") -> DataFrame:
    """(unp, ext_id): own ids, those of the base if the isoform is canonical, and those of the best isoform."""
    t = ids_of(edges, id_type)
    via_base = canonical(edges).where("canonical").select("unp", base_unp().alias("other"))
    via_best = best_unp(edges).where("unp <> best").select("unp", F.col("best").alias("other"))
    more = via_base.union(via_best).join(t.select(F.col("unp").alias("other"), "ext_id"), "other").select("unp", "ext_id")
    return t.union(more).distinct()


def versioned_lookup(asked: DataFrame, edges: DataFrame, id_type: str) -> DataFrame:
    """(asked, unps): by the exact id; else by the highest version of the id without its version, or
    that without one where no other is; sorted, joined by commas."""
    ids = ids_of(edges, id_type).select("ext_id", "unp", F.split("ext_id", r"\.")[0].alias("bare"), F.coalesce(F.get(F.split("ext_id", r"\."), F.lit(1)).try_cast("int"), F.lit(-1)).alias("version"))
    exact = asked.join(ids, F.col("asked") == F.col("ext_id")).groupBy("asked").agg(F.array_sort(F.collect_set("unp")).alias("exact"))
    newest = ids.groupBy("bare").agg(F.max("version").alias("version"))
    latest = ids.join(newest, ["bare", "version"]).groupBy("bare").agg(F.array_sort(F.collect_set("unp")).alias("latest"))
    out = asked.distinct().join(exact, "asked", "left").join(latest, F.split("asked", r"\.")[0] == F.col("bare"), "left")
    return out.select("asked", F.array_join(F.coalesce("exact", "latest", F.array().cast("array<string>")), ",").alias("unps"))


def segment_alignment(segments: DataFrame) -> DataFrame:
    """(structid, chain, unp_pos, seq_pos): segments of two equally long ranges, position by position."""
    n = F.least(F.col("unp_end") - F.col("unp_start"), F.col("seq_end") - F.col("seq_start"))
    return segments.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long")))).select("structid", "chain", (F.col("unp_start") + F.col("k")).alias("unp_pos"), (F.col("seq_start") + F.col("k")).alias("seq_pos"))


def checked_alignment(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """Residue rows (seq_id, pos, letter, ..) whose letter is the sequence's at that place."""
    return rows.join(sequences, "seq_id").where(F.col("letter") == F.expr("substring(seq, pos, 1)")).drop("seq")


def neighbours(residues: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(res_id, point_id, distance): points of the same structure within a radius of a residue."""
    p = points.select(F.col("res_id").alias("point_id"), F.col("structid").alias("p_struct"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    return grid_join(residues, p, ("x", "y", "z"), ("px", "py", "pz"), radius, ("structid", "p_struct")).select("res_id", "point_id", "distance")


def density(residues: DataFrame, points: DataFrame, most: int) -> DataFrame:
    """(res_id, k, n): points within k for each k up to most."""
    near = neighbours(residues, points, float(most)).select("res_id", F.ceil("distance").cast("int").alias("from"))
    by = near.groupBy("res_id", "from").agg(F.count("*").alias("m"))
    grid = residues.select("res_id", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("k"))
    return grid.join(by, (grid["res_id"] == by["res_id"]) & (F.col("from") <= F.col("k")), "left").groupBy(grid["res_id"], "k").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"))


def clusters(residues: DataFrame, radius: float, least: int) -> DataFrame:
    """(res_id, cluster): density clusters within a structure. Cores have `least` residues within the radius, themselves
    included; linked cores share the least id; others join a neighbouring core's, or have none."""
    near = neighbours(residues, residues, radius).select("res_id", "point_id")
    cores = near.groupBy("res_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("res_id")
    near, cores = saved(near, "near"), saved(cores, "cores")
    links = near.join(cores, "res_id").join(cores.select(F.col("res_id").alias("point_id")), "point_id")
    label = cores.select("res_id", F.col("res_id").alias("cluster"))
    for _ in range(64):
        # The least label of all neighbours, and then that label's own label: the reach doubles every round.
        step = links.join(label.select(F.col("res_id").alias("point_id"), "cluster"), "point_id").groupBy("res_id").agg(F.min("cluster").alias("cluster"))
        jump = step.join(step.select(F.col("res_id").alias("cluster"), F.col("cluster").alias("far")), "cluster").select("res_id", F.least("cluster", "far").alias("cluster"))
        jump = saved(jump, "clusters")
        changed = jump.join(label.withColumnRenamed("cluster", "old"), "res_id").where("cluster <> old").limit(1).count()
        label = jump
        if not changed:
            break
    else:
        raise RuntimeError("density clusters did not settle in 64 rounds, enough for chains of 2^64 residues")
    edge = near.join(label.select(F.col("res_id").alias("point_id"), "cluster"), "point_id").groupBy("res_id").agg(F.min("cluster").alias("near_cluster"))
    return residues.select("res_id").join(label, "res_id", "left").join(edge, "res_id", "left").select("res_id", F.coalesce("cluster", "near_cluster").alias("cluster"))


def codons(exons: DataFrame) -> DataFrame:
    """(transcript, seqid, chrom, start, end): the codon of each amino acid, end exclusive, from coding exons (transcript,
    chrom, strand, e_start, e_end half-open, rank). A codon that spans an intron has its outer ends."""
    w = Window.partitionBy("transcript").orderBy("rank")
    n = F.col("e_end") - F.col("e_start")
    own = exons.withColumn("n", n).where("n > 0").withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # A row for each codon that an exon has a part of: from which base of the exon to which.
    own = own.withColumn("k", F.explode(F.sequence(F.floor(F.col("before") / 3), F.floor((F.col("before") + F.col("n") - 1) / 3))))
    own = own.withColumn("a", F.greatest(3 * F.col("k") - F.col("before"), F.lit(0))).withColumn("b", F.least(3 * F.col("k") + 3 - F.col("before"), F.col("n")))
    start = F.when(F.col("strand") > 0, F.col("e_start") + F.col("a")).otherwise(F.col("e_end") - F.col("b"))
    own = own.select("transcript", (F.col("k") + 1).alias("seqid"), "chrom", start.alias("start"), (start + F.col("b") - F.col("a")).alias("end"), (F.col("b") - F.col("a")).alias("n"))
    split = own.where("n < 3").groupBy("transcript", "seqid", "chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    return own.where("n = 3").union(split.where("n = 3")).drop("n")


def _with_key(rows: DataFrame, other: DataFrame, on: list[str], key: str) -> DataFrame:
    """rows with the least key of the other's rows that agree on the columns `on`, null where none does."""
    return rows.join(other.groupBy(*on).agg(F.min(key).alias(key)), on, "left")


def assign_keys(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with the keys of those that they refer to: chains get str_id (a model's before a structure's), residues
    ch_id, alignments res_id, as_id and tr_id, transcripts gc_id (a consequence inside their span), consequences gd_id and
    intersections res_id. Of several that fit the least key is taken, null if there is none.

    structures, models: structid, str_id. chains: structid, chain, ch_id. residues: structid, chain, seqid, res_id.
    alignments: structid, chain, seqid, transcript, trans_seqid. scores: structid, chain, transcript, as_id. transcripts:
    transcript, trans_seqid, chrom, start, end, tr_id. consequences: transcript, chrom, pos, end_pos, name, gc_id. data:
    chrom, pos, end_pos, name, gd_id. intersections: structid, chain, seqid, gc_id."""
    place = ["structid", "chain", "seqid"]
    of_model = t["models"].withColumnRenamed("str_id", "__model")
    chains = _with_key(_with_key(t["chains"], t["structures"], ["structid"], "str_id"), of_model, ["structid"], "__model")
    alignments = _with_key(_with_key(_with_key(t["alignments"], t["residues"], place, "res_id"), t["scores"], ["structid", "chain", "transcript"], "as_id"), t["transcripts"], ["transcript", "trans_seqid"], "tr_id")
    spans, inner = t["transcripts"].alias("s"), t["consequences"].alias("c")
    inside = spans.join(inner, (F.col("s.transcript") == F.col("c.transcript")) & (F.col("s.chrom") == F.col("c.chrom")) & (F.col("c.pos") >= F.col("s.start")) & (F.col("c.end_pos") <= F.col("s.end")))
    held = inside.groupBy("s.tr_id").agg(F.min("c.gc_id").alias("gc_id"))
    return {
        "chains": chains.withColumn("str_id", F.coalesce("__model", "str_id")).drop("__model"), "residues": _with_key(t["residues"], t["chains"], ["structid", "chain"], "ch_id"), "alignments": alignments,
        "transcripts": t["transcripts"].join(held, "tr_id", "left"), "consequences": _with_key(t["consequences"], t["data"], ["chrom", "pos", "end_pos", "name"], "gd_id"), "intersections": _with_key(t["intersections"], t["residues"], place, "res_id"),
    }


def protein_structures(chains: DataFrame, structures: DataFrame, scores: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """(unp, structid, by, perc_identity, chains, k): structures (structid, by) with a protein's chains and their greatest
    identity; k ranks a protein's structures by `by`, identity and id."""
    own = chains.join(structures, "structid").join(scores.groupBy("structid", "chain").agg(F.max("perc_identity").alias("perc_identity")), ["structid", "chain"])
    per = own.groupBy("unp", "structid", by).agg(F.max("perc_identity").alias("perc_identity"), F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("#"), "chain"))), ";").alias("chains"))
    return per.withColumn("k", F.row_number().over(Window.partitionBy("unp").orderBy(F.desc(by) if descending else F.asc(by), F.desc("perc_identity"), "structid")))


# Lookups, each for a whole table of questions.


def entity_kinds(entities: DataFrame, kinds: dict[str, DataFrame]) -> DataFrame:
    """(entity, kind): of tables that hold entities in their only column, by kind, the first that has it; null for none."""
    every = [ids.toDF("entity").select("entity", F.lit(k).alias("rank"), F.lit(name).alias("kind")) for k, (name, ids) in enumerate(kinds.items())]
    first = reduce(DataFrame.union, every).groupBy("entity").agg(F.min_by("kind", "rank").alias("kind"))
    return entities.select("entity").distinct().join(first, "entity", "left")


def exists_in(ids: DataFrame, *tables: DataFrame) -> DataFrame:
    """The distinct ids, in the only column, that all tables have in a column of that name."""
    (name,) = ids.columns
    return reduce(lambda a, b: a.join(b.select(name), name, "left_semi"), tables, ids.distinct())


def id_lookup(edges: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(unp, id_type, ids): an accession's ids of each type, sorted; of the accessions asked for (unp), or all."""
    own = edges if asked is None else edges.join(asked.select("unp"), "unp", "left_semi")
    return own.groupBy("unp", "id_type").agg(F.array_join(F.array_sort(F.collect_set("ext_id")), ",").alias("ids"))


def refseq2unp(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """(asked, unps) of RefSeq ids: proteins (NP_, XP_, YP_) by edges of type RefSeq, others by RefSeq_NT; versions as in
    versioned_lookup."""
    protein = F.col("asked").rlike("^[NXYA]P_")
    return versioned_lookup(asked.where(protein), edges, "RefSeq").union(versioned_lookup(asked.where(~protein), edges, "RefSeq_NT"))


def unp2refseq(asked: DataFrame, edges: DataFrame, id_type: str = "RefSeq_NT") -> DataFrame:
    """(unp, refseqs): an accession's RefSeq ids, or if it has none, those of the accession without its isoform, sorted."""
    ids = ids_of(edges, id_type).groupBy("unp").agg(F.array_sort(F.collect_set("ext_id")).alias("ids"))
    own, base = ids.toDF("unp", "own"), ids.toDF("base", "of_base")
    out = asked.select("unp").distinct().withColumn("base", F.regexp_replace("unp", "-.*$", "")).join(own, "unp", "left").join(base, "base", "left")
    return out.select("unp", F.array_join(F.coalesce("own", "of_base", F.array().cast("array<string>")), ",").alias("refseqs"))


def models_of(asked: DataFrame, models: DataFrame) -> DataFrame:
    """asked (.., seq_id, first, last) with each model (model, seq_id, target_beg, target_end) that covers first to last. A model's
    seq_id may go on behind an ENSP or other id with _ or a point, which then counts up to there. Equal places are looked up once."""
    own = models.select("model", "target_beg", "target_end", F.explode(F.array_distinct(F.array("seq_id", F.regexp_replace("seq_id", r"[_.].*$", "")))).alias("seq_id"))
    fit = asked.select("seq_id", "first", "last").distinct().join(own, "seq_id").where((F.col("target_beg") <= F.col("first")) & (F.col("target_end") >= F.col("last")))
    return asked.join(fit.drop("target_beg", "target_end"), ["seq_id", "first", "last"])


def by_protein_variant(consequences: DataFrame, scores: DataFrame) -> DataFrame:
    """Consequences (.., transcript, protein_variant) with the scores of (transcript, protein_variant)."""
    return consequences.join(scores, ["transcript", "protein_variant"])


def by_transcript(rows: DataFrame, xref: DataFrame, versions: bool = False) -> DataFrame:
    """rows (.., transcript) with the columns of xref (transcript, ..); with versions only equal versions meet."""
    bare = (lambda c: F.col(c)) if versions else (lambda c: F.regexp_replace(c, r"\.\d+$", ""))
    # What a transcript has is one row, so that a row meets it once, however much that is.
    columns = [c for c in xref.columns if c != "transcript"]
    own = xref.groupBy(bare("transcript").alias("__t")).agg(F.collect_list(F.struct(*columns)).alias("__x"))
    return rows.withColumn("__t", bare("transcript")).join(own, "__t").select(*rows.columns, F.inline("__x"))


def segment_residues(segments: DataFrame, residues: DataFrame) -> DataFrame:
    """(structid, chain, unp_pos, seq_pos, resnum, icode, resolved): the positions of segments with the residue that the list
    (structid, chain, seq_pos, resnum, icode, resolved) has there; null where it has none."""
    return segment_alignment(segments).join(residues, ["structid", "chain", "seq_pos"], "left").select("structid", "chain", "unp_pos", "seq_pos", "resnum", "icode", F.coalesce("resolved", F.lit(False)).alias("resolved"))


def best_isoform_chain(xref: DataFrame, order: str) -> DataFrame:
    """(structid, chain, best): of a chain's rows (structid, chain, unp) the last by `order`."""
    return xref.groupBy("structid", "chain").agg(F.max_by("unp", order).alias("best"))


def longest_chain(chains: DataFrame) -> DataFrame:
    """(unp, structid, chain, n): an accession's chain with most residues n, of equals the first by name."""
    best = chains.groupBy("unp").agg(F.min_by(F.struct("structid", "chain", "n"), F.struct((-F.col("n")).alias("m"), "structid", "chain")).alias("b"))
    return best.select("unp", "b.*")


def covered(rows: DataFrame, keys: list[str], first: str, last: str, begins_by: int | None = None, ends_after: int | None = None) -> DataFrame:
    """(keys, lo, hi): the least `first` and greatest `last` of each group, of groups that begin by and end after some place."""
    out = rows.groupBy(*keys).agg(F.min(first).alias("lo"), F.max(last).alias("hi"))
    out = out if begins_by is None else out.where(F.col("lo") <= begins_by)
    return out if ends_after is None else out.where(F.col("hi") >= ends_after)


def confidence_summary(residues: DataFrame, value: str) -> DataFrame:
    """(structid, mean, per_residue): a model's mean confidence, and its residues' in their order, whole numbers."""
    by = F.array_sort(F.collect_list(F.struct("chain", "seqid", "res_id", F.floor(value).cast("int").alias("v"))))  # a structure's residues
    return residues.groupBy("structid").agg(F.round(F.avg(value), 4).alias("mean"), F.array_join(F.transform(by, lambda r: r["v"].cast("string")), ",").alias("per_residue"))


def summary(residues: DataFrame, transcripts: DataFrame, mapped_: DataFrame, variants: DataFrame) -> DataFrame:
    """One row of distinct counts: structures, chains, residues, transcripts, mapped_consequences, mapped_structures, snps."""
    parts = [
        residues.agg(F.count_distinct("structid").alias("structures"), F.count_distinct(F.concat_ws(":", "structid", "chain")).alias("chains"), F.count("*").alias("residues")),
        transcripts.agg(F.count_distinct("transcript").alias("transcripts")), mapped_.agg(F.count_distinct("gc_id").alias("mapped_consequences"), F.count_distinct("structid").alias("mapped_structures")),
        variants.where("length(ref) = 1").agg(F.count("*").alias("snps")),
    ]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each


def of_protein(sets: dict[str, DataFrame], accession: str) -> DataFrame:
    """(unp, label): the entities of a protein, its accession with or without an isoform, in the sets (unp) named by label."""
    own = lambda df: df.where((F.col("unp") == accession) | F.col("unp").startswith(accession + "-"))
    return reduce(DataFrame.union, [own(df).select("unp", F.lit(label).alias("label")) for label, df in sets.items()]).distinct()
