"""Quantification: roll-ups, normalisations, scale factors, meta-profiles, isoforms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.coverage import to_transcripts
from helixframe.operators.intervals import overlap_join


def gene_rollup(quant: DataFrame, name: str = "name") -> DataFrame:
    """Isoforms (``gene.N``) to genes: reads add up, the length is the longest isoform's."""
    return quant.groupBy(F.substring_index(name, ".", 1).alias("gene")).agg(F.sum("reads").alias("reads"), F.max("length").alias("length"))


def normalise(quant: DataFrame, genome: float | None = None) -> DataFrame:
    """RPK, RPM and TPM; with ``genome``, a number of genome-matching reads, RPgM and RPKgM per million of them as well. A length of 0 gives 0."""
    rpk = F.when(F.col("length") > 0, F.col("reads") * 1000 / F.col("length")).otherwise(0.0)
    q = quant.withColumn("rpk", rpk)
    totals = q.agg(F.sum("reads").alias("_r"), F.sum("rpk").alias("_k"))
    out = q.crossJoin(F.broadcast(totals))  # one row
    out = out.withColumn("rpm", F.col("reads") * 1e6 / F.col("_r")).withColumn("tpm", F.col("rpk") * 1e6 / F.col("_k"))
    if genome is not None:
        out = out.withColumn("rpgm", F.col("reads") * 1e6 / genome).withColumn("rpkgm", F.col("rpk") * 1e6 / genome)
    return out.drop("_r", "_k")


def scale_ratio(end: DataFrame, body: DataFrame, read_length: float = 200, most: float = 10) -> DataFrame:
    """One row: the factor for the end library, 2F 1e6 / sum(length TPM) x body reads / end reads over shared genes, at most ``most``."""
    j = end.select("gene", F.col("reads").alias("e")).join(body.select("gene", F.col("reads").alias("b"), "length", "tpm"), "gene")
    ratio = 2 * read_length * 1e6 / F.sum(F.col("length") * F.col("tpm")) * F.sum("b") / F.sum("e")
    return j.agg(F.least(F.lit(float(most)), ratio).alias("scale"))


def stretch_profile(tx_cov: DataFrame, lengths: DataFrame, bins: int = 100, norm: str = "sum") -> DataFrame:
    """Meta-profile: each transcript (``tx``, ``tx_pos``, ``value``; ``length``) normalised by its sum, max or mean, and stretched to ``bins``."""
    how = {"sum": F.sum("value"), "max": F.max("value"), "mean": F.avg("value")}[norm]
    own = tx_cov.groupBy("tx").agg(how.alias("_d"))
    j = tx_cov.join(own, "tx").join(lengths, "tx")
    at = F.least(F.floor(F.col("tx_pos") * bins / F.col("length")), F.lit(bins - 1)).cast("int")
    return j.groupBy(at.alias("bin")).agg(F.sum(F.col("value") / F.col("_d")).alias("signal"), F.countDistinct("tx").alias("transcripts"))


def distance_profile(sites: DataFrame, cov: DataFrame, reach: int = 50) -> DataFrame:
    """Signal at -reach..reach around sites (``ref``, ``pos``): sum and mean a site; offsets without signal are 0."""
    around = sites.select("ref", F.col("pos").alias("_site"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("diff")).withColumn("pos", F.col("_site") + F.col("diff"))
    hit = around.join(cov.groupBy("ref", "pos").agg(F.sum("value").alias("value")), ["ref", "pos"], "left")
    return hit.groupBy("diff").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("total"), F.avg(F.coalesce("value", F.lit(0.0))).alias("mean"))


def motif_enrichment(kmers: DataFrame, positive: str = "positive") -> DataFrame:
    """Share of each motif among the positives over its share among the rest."""
    c = kmers.groupBy("motif").agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("b"))
    t = c.agg(F.sum("p").alias("tp"), F.sum("b").alias("tb"))
    return c.crossJoin(F.broadcast(t)).select("motif", ((F.col("p") / F.col("tp")) / F.nullif(F.col("b") / F.col("tb"), F.lit(0.0))).alias("ratio"))  # one row


def edges(exons: DataFrame, by: list[str]) -> DataFrame:
    """Exons split at all exon ends of their group: ``by``, start, end and the transcripts that hold each edge."""
    ends = exons.select(*by, F.explode(F.array("start", "end")).alias("x")).distinct()
    w = Window.partitionBy(*by).orderBy("x")
    cuts = ends.withColumn("y", F.lead("x").over(w)).where("y is not null")
    e = exons.alias("e")
    j = cuts.alias("c").join(e, [F.col(f"c.{k}") == F.col(f"e.{k}") for k in by] + [F.col("e.start") <= F.col("c.x"), F.col("c.y") <= F.col("e.end")])
    return j.groupBy(*[F.col(f"c.{k}").alias(k) for k in by], F.col("c.x").alias("start"), F.col("c.y").alias("end")).agg(F.array_sort(F.collect_set("e.tx")).alias("txs"))


class _Priors:
    """Reads and length that a transcript has been given so far; their ratio is its prior."""

    def __init__(self) -> None:
        self.reads: dict[str, float] = {}
        self.length: dict[str, int] = {}

    def known(self, tx: str) -> bool:
        return tx in self.length

    def give(self, tx: str, reads: float, length: int) -> None:
        self.reads[tx] = self.reads.get(tx, 0.0) + reads
        self.length[tx] = self.length.get(tx, 0) + length

    def share(self, txs: list[str], reads: float, length: int) -> None:
        """Give an edge's reads to its transcripts.

        Those with a prior get what it lets expect, at most all; what is left goes in
        equal parts to those without, or, if there are none, in proportion to the priors.
        """
        expected = {t: self.reads[t] / self.length[t] * length for t in txs if self.known(t)}
        total = sum(expected.values())
        new = [t for t in txs if t not in expected]
        if total >= reads or not new:
            for t, x in expected.items():
                self.give(t, reads * (x / total if total > 0 else 1 / len(expected)), length)
        else:
            for t, x in expected.items():
                self.give(t, x, length)
            for t in new:
                self.give(t, (reads - total) / len(new), length)


def settle_edges(edges: list[tuple[int, int, list[str], float]], least_prior: int = 20) -> dict[str, float]:
    """Reads of the transcripts of one overlap group from (start, end, transcripts, reads) of its edges.

    Edges of one transcript alone give its prior, if they have ``least_prior`` bases
    together.  Other edges are settled from left to right while at most one of their
    transcripts is without a prior, again and again; when a round settles none, or
    there is no prior at all, any edge may be.  A transcript's reads are its prior times
    its length.
    """
    edges = sorted(edges, key=lambda e: (e[0], e[1]))
    whole: dict[str, int] = {}
    alone = _Priors()
    for start, end, txs, reads in edges:
        for t in txs:
            whole[t] = whole.get(t, 0) + end - start
        if len(txs) == 1:
            alone.give(txs[0], reads, end - start)
    priors = _Priors()
    for t, length in alone.length.items():
        if length >= least_prior:
            priors.give(t, alone.reads[t], length)
    waiting = [e for e in edges if len(e[2]) > 1]
    naive = not priors.length
    while waiting:
        later = []
        for start, end, txs, reads in waiting:
            if not naive and sum(not priors.known(t) for t in txs) > 1:
                later.append((start, end, txs, reads))
            elif reads:
                priors.share(txs, reads, end - start)
        naive = naive or len(later) == len(waiting)
        waiting = later
    return {t: priors.reads[t] / priors.length[t] * n if priors.known(t) else 0.0 for t, n in sorted(whole.items())}


def isoform_reads(edge_reads: DataFrame, by: str = "gene", least_prior: int = 20) -> DataFrame:
    """Reads of every transcript from the reads of edges (``by``, start, end, txs, reads); see ``settle_edges``.

    A group is one overlap group of transcripts, whose edges annotation bounds; coverage
    has been summed before, so no group grows with the reads.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = settle_edges([(int(s), int(e), list(t), float(r)) for s, e, t, r in zip(pdf["start"], pdf["end"], pdf["txs"], pdf["reads"])], least_prior)
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(total), "tx": list(total), "reads": list(total.values())})

    kind = edge_reads.schema[by].dataType.simpleString()
    tx = edge_reads.schema["txs"].dataType.elementType.simpleString()
    return edge_reads.groupBy(by).applyInPandas(run, f"{by} {kind}, tx {tx}, reads double")


def scale_ratio_tables(end: DataFrame, body: DataFrame, fragment: float = 200) -> DataFrame:
    """One row: the factor from tables of reads, length and rpm or tpm, over rows whose reads and norm are above 0 (``norm``)."""
    b = body.where("reads > 0 and norm > 0").agg(F.sum("reads").alias("b"), F.sum(F.col("length") * F.col("norm")).alias("l"))
    e = end.where("reads > 0 and norm > 0").agg(F.sum("reads").alias("e"))
    return b.crossJoin(e).select((fragment * 1e6 / F.col("l") * F.col("b") / F.col("e")).alias("scale"))  # one row each


def align_profile(tx_cov: DataFrame, lengths: DataFrame, side: str = "left", most: int | None = None, norm: str = "sum") -> DataFrame:
    """Meta-profile without stretching: ``offset`` from the first base (left, from 0) or the last one (right, down from 0).

    ``norm``: sum adds values, mean divides by the number of transcripts, max scales each
    transcript by its highest value first and then divides.  Offsets end after ``most``.
    """
    at = F.col("tx_pos") if side == "left" else F.col("tx_pos") - F.col("length") + 1
    j = tx_cov.join(lengths, "tx").withColumn("offset", at.cast("bigint"))
    if most is not None:
        j = j.where(F.col("offset") < most if side == "left" else F.col("offset") > -most)
    if norm == "max":
        j = j.join(tx_cov.groupBy("tx").agg(F.max(F.abs("value")).alias("_d")), "tx").where("_d > 0").withColumn("value", F.col("value") / F.col("_d"))
    out = j.groupBy("offset").agg(F.sum("value").alias("signal"))
    if norm == "sum":
        return out
    counted = (j if norm == "max" else lengths).select("tx").distinct().agg(F.count(F.lit(1)).alias("_n"))
    return out.crossJoin(F.broadcast(counted)).select("offset", (F.col("signal") / F.col("_n")).alias("signal"))  # one row


def positions_of(transcripts: DataFrame, splice: bool = True, buffer: int = 0) -> DataFrame:
    """Pieces of transcripts that a profile reads, as exon rows: the exons, or the whole span, and ``buffer`` bases at each end."""
    span = transcripts.groupBy("chrom", "strand", "tx").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    pieces = transcripts.select("chrom", "strand", "tx", "start", "end") if splice else span
    if buffer:
        left = span.select("chrom", "strand", "tx", (F.col("start") - buffer).alias("start"), F.col("start").alias("end"))
        right = span.select("chrom", "strand", "tx", F.col("end").alias("start"), (F.col("end") + buffer).alias("end"))
        pieces = pieces.unionByName(left).unionByName(right)
    return pieces


def profile_signal(cov: DataFrame, pieces: DataFrame, antisense: bool = False, doubles: bool = True) -> DataFrame:
    """``tx``, ``tx_pos``, ``value`` of coverage under transcripts' pieces; of the other strand with ``antisense``.

    Without ``doubles`` a base counts for the first transcript by name only.
    """
    if antisense:
        cov = cov.withColumn("strand", F.when(F.col("strand") == "+", "-").otherwise("+"))
    hits = to_transcripts(cov.withColumn("value", F.struct("chrom", "strand", "pos", "value")), pieces)
    if not doubles:
        first = hits.groupBy("value").agg(F.min(F.struct("tx", "tx_pos")).alias("f"))
        hits = first.select("f.tx", "f.tx_pos", "value")
    return hits.select("tx", "tx_pos", F.col("value.value").alias("value"))


def distance_profile_by(sites: DataFrame, cov: DataFrame, by: list[str], reach: int = 50) -> DataFrame:
    """``by``, ``diff``, ``total`` and ``mean``: signal at -reach..reach around the sites (``ref``, ``pos``) of each group.

    Only signal that lies within reach of a site is joined; offsets without any are 0.
    """
    windows = sites.select(*by, F.col("ref"), (F.col("pos") - reach).alias("start"), (F.col("pos") + reach + 1).alias("end"), F.col("pos").alias("_site"))
    points = cov.groupBy("ref", "pos").agg(F.sum("value").alias("value")).select("ref", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "value")
    hits = overlap_join(windows, points, ["ref"], width=max(64, reach), b_levels=(0,))
    sums = hits.groupBy(*[F.col(f"a_{c}").alias(c) for c in by], (F.col("b_start") - F.col("a__site")).cast("int").alias("diff")).agg(F.sum("b_value").alias("total"))
    groups = sites.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select("*", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("diff"))
    return groups.join(sums, [*by, "diff"], "left").select(*by, "diff", F.coalesce("total", F.lit(0.0)).alias("total"), (F.coalesce("total", F.lit(0.0)) / F.col("_n")).alias("mean"))
