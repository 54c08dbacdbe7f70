"""Writers of the text formats: each turns a DataFrame into lines and writes them as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequence import softclip


def _text(df: DataFrame, line: Column, path: str, order: list | None = None) -> None:
    df = df.orderBy(*order) if order else df
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def tab(*columns: str | Column) -> Column:
    """Tab-separated; null is a dot."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(".")) for c in columns]
    return F.concat_ws("\t", *parts)


def write_bedgraph(runs: DataFrame, path: str) -> None:
    """Runs sorted by chromosome and start; one path a strand."""
    _text(runs, tab("chrom", "start", "end", "value"), path, ["chrom", "start"])


def write_gtf(exons: DataFrame, path: str, source: str = "helixframe") -> None:
    """Exon rows as GTF, attributes in quotes; transcripts of more exons come first where places are equal."""
    attributes = F.concat(F.lit('gene_id "'), F.col("gene").cast("string"), F.lit('"; transcript_id "'), F.col("tx").cast("string"), F.lit('";'))
    sized = exons.join(exons.groupBy("tx").agg(F.count(F.lit(1)).alias("_n")), "tx")
    line = tab("chrom", F.lit(source), F.lit("exon"), F.col("start") + 1, "end", F.lit("."), "strand", F.lit("."), attributes)
    _text(sized, line, path, ["chrom", "start", F.desc("_n"), "tx"])


def _with_header(lines: DataFrame, path: str, head: str) -> None:
    """Text lines (``value``), with ``head`` at the beginning of every part."""
    def run(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([head])], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    lines.mapInArrow(run, "value string").write.mode("overwrite").text(path)


def write_multi_bedgraph(runs: DataFrame, names: list[str], path: str) -> None:
    """Several columns; every part begins with the header, so that it can be read by itself."""
    body = runs.orderBy("chrom", "start").select(tab("chrom", "start", "end", *names).alias("value"))
    _with_header(body, path, "#" + "\t".join(["chrom", "start", "end", *names]))


def write_bed(features: DataFrame, path: str, extra: list[str] = []) -> None:
    _text(features, tab("chrom", "start", "end", "name", "score", "strand", *extra), path, ["chrom", "start"])


def write_fasta(seqs: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    _text(seqs, F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), F.col(seq)), path)


def write_fastq(reads: DataFrame, path: str) -> None:
    _text(reads, F.concat_ws("\n", F.concat(F.lit("@"), F.col("read_id")), "seq", "plus", "qual"), path)


def gff_lines(exons: DataFrame, source: str = "helixframe") -> Column:
    """A GFF3 line of an exon row; 1-based and closed."""
    attributes = F.concat(F.lit("gene_id="), F.col("gene").cast("string"), F.lit(";transcript_id="), F.col("tx").cast("string"), F.lit(";Parent="), F.col("tx").cast("string"))
    return tab("chrom", F.lit(source), F.lit("exon"), F.col("start") + 1, "end", F.lit("."), "strand", F.lit("."), attributes)


def write_gff(exons: DataFrame, path: str) -> None:
    _text(exons, gff_lines(exons), path, ["chrom", "start", F.col("end") - F.col("start")])


def write_wig(cov: DataFrame, path: str) -> None:
    """Coverage (``chrom``, ``pos``, ``value``) as fixedStep stretches of successive positions; a stretch is one record, so any part can be read by itself."""
    from helixframe.operators.shards import numbered

    rows = numbered(cov, ["chrom"], ["pos"], "_n").withColumn("_g", F.col("pos") - F.col("_n"))
    # a stretch is cut where a shard of the axis ends, so that no record grows with the data
    cut = F.call_function("div", F.col("pos"), F.lit(1 << 16))
    lines = F.array_sort(F.collect_list(F.struct("pos", F.col("value").cast("string").alias("v"))))
    runs = rows.groupBy("chrom", "_g", cut.alias("_h")).agg(F.min("pos").alias("pos"), lines.alias("rows"))
    head = F.concat(F.lit("fixedStep chrom="), F.col("chrom"), F.lit(" start="), (F.col("pos") + 1).cast("string"), F.lit(" step=1\n"))
    _text(runs, F.concat(head, F.array_join(F.transform("rows", lambda x: x["v"]), "\n")), path, ["chrom", "pos"])


def pretty_duplex(query: Column, target: Column) -> Column:
    """A duplex as three lines: the target from its 5' end, the pairs (``|``, ``o`` for G:U), and the query from its 3' end."""
    from helixframe.functions.sequence import pairing

    marks = F.reverse(F.regexp_replace(pairing(query, target), "[xbg]", " "))
    return F.concat(F.lit("5' "), F.reverse(target), F.lit(" 3'\n   "), marks, F.lit("\n3' "), F.reverse(query), F.lit(" 5'"))


def write_duplexes(duplexes: DataFrame, path: str, columns: list[str]) -> None:
    """A table of duplexes, with a header of comments in every part."""
    _with_header(duplexes.select(tab(*columns).alias("value")), path, "#" + "\t".join(columns))


def write_pileup(pileup: DataFrame, path: str, columns: list[str]) -> None:
    """Pileup statistics as CSV with a header."""
    pileup.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_matrix(matrix: DataFrame, path: str) -> None:
    matrix.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def junction_bed(junctions: DataFrame) -> DataFrame:
    """Junction counts (``chrom``, ``left``, ``right``, ``strand``, ``n``) as BED rows."""
    return junctions.groupBy("chrom", "left", "right", "strand").agg(F.sum("n").alias("score")).select(
        "chrom", F.col("left").alias("start"), (F.col("right") + 1).alias("end"), F.concat_ws("-", "left", "right").alias("name"), "score", "strand")


def read_bed_rows(reads: DataFrame) -> DataFrame:
    """Read rows as BED with the sequence of each segment, joined by dots where the read skips, and what is clipped before and after, if there is a ``cigar`` and ``seq``."""
    seq = F.aggregate(
        F.col("segments"), F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, x: F.struct((a["at"] + x["end"] - x["start"]).alias("at"), F.concat(a["out"], F.array(F.substring("mapped_seq", (a["at"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))).alias("out")),
        lambda a: F.array_join(a["out"], "."))
    clips = []
    if {"cigar", "seq"} <= set(reads.columns):
        left, right = softclip(F.col("cigar"), "left"), softclip(F.col("cigar"), "right")
        clips = [F.substring("seq", F.lit(1), left).alias("head"), F.when(right > 0, F.substring("seq", F.length("seq") - right + 1, right)).otherwise("").alias("tail")]
    return reads.select("chrom", F.element_at("segments", 1)["start"].alias("start"), F.element_at("segments", -1)["end"].alias("end"), "read_id", "weight", "strand", seq.alias("sequence"), *clips)


def duplicate_by_weight(reads: DataFrame, times: float = 1.0) -> DataFrame:
    """Every read as often as its weight says, rounded; reads of weight 0 vanish."""
    n = F.bround(F.col("weight") * times).cast("int")
    return reads.where(n > 0).select("*", F.explode(F.array_repeat(F.lit(1), n)).alias("_c")).drop("_c")
