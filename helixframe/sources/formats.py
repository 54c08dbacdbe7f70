"""Readers of the text formats of genomics, as DataFrames.

Line formats are read with ``spark.read.text``, so they split over executors and
gzip is read as it is.  FASTA and FASTQ use record separators of the text source.
Coordinates come out 0-based and half-open unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.operators.shards import ranged, running_sum
from helixframe.session import materialize

BED = T.StructType().add("chrom", "string").add("start", "long").add("end", "long").add("name", "string").add("score", "double").add("strand", "string")
BEDGRAPH = T.StructType().add("chrom", "string").add("start", "long").add("end", "long").add("value", "double")


def _lines(spark: SparkSession, path: str | list[str], comment: str | None = "#") -> DataFrame:
    df = spark.read.text(path)
    return df.where((F.col("value") != "") & ~F.col("value").startswith(comment)) if comment else df


def _fields(df: DataFrame, schema: T.StructType, sep: str = "\t") -> DataFrame:
    f = F.split(F.col("value"), sep)
    return df.select(*[F.get(f, F.lit(i)).try_cast(x.dataType).alias(x.name) for i, x in enumerate(schema.fields)], F.slice(f, len(schema) + 1, F.greatest(F.size(f) - len(schema), F.lit(0))).alias("extra"))


def read_fasta(spark: SparkSession, path: str, split_on: str = " ", upper: bool = True, rna: bool = False) -> DataFrame:
    """name, seq.  The name ends at ``split_on``; ``rna`` turns T into U and keeps names without white space only."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.regexp_extract("value", "^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", "^[^\r\n]*", ""), "\\s+", "")
    seq = F.upper(seq) if upper or rna else seq
    out = records.select(head.alias("_h"), (F.translate(seq, "T", "U") if rna else seq).alias("seq"))
    if rna:
        out = out.where(~F.col("_h").rlike("\\s"))
    return out.select(F.substring_index("_h", split_on, 1).alias("name"), "seq")


def fasta_name_errors(spark: SparkSession, path: str) -> DataFrame:
    """``name``: headers with white space, which the RNA form of FASTA does not allow and ``read_fasta(rna=True)`` leaves out."""
    heads = spark.read.text(path).where(F.col("value").startswith(">")).select(F.expr("substring(value, 2)").alias("name"))
    return heads.where(F.col("name").rlike("\\s"))


def check_layout(sheet: DataFrame) -> DataFrame:
    """Lines of a sample sheet with a wrong number of files: SE takes one, PE one (interleaved) or two."""
    most = F.when(F.upper("layout") == "PE", 2).otherwise(1)
    return sheet.where(~F.size("fastq").between(1, most))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` and ``at``, the number of a line over all files in the order of their names, from 0 on.

    A line's number is its place in its block of the file and the lines of the blocks
    before, of which there is one row a block.  Lines are written once into the shared folder.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    lines = materialize(lines, "lines")  # the ids hold for one run only
    blocks = lines.groupBy("f", "b").agg(F.min("m").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return lines.join(blocks.drop("n"), ["f", "b"]).select("value", (F.col("before") + F.col("m") - F.col("first")).alias("at"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """read_id, seq, plus, qual, and ``number`` of the record over all files; records are four lines."""
    part = F.pmod("at", F.lit(4))
    own = [F.max(F.when(part == i, F.col("value"))) for i in range(4)]
    number = F.call_function("div", F.col("at"), F.lit(4)).alias("number")
    records = numbered_lines(spark, path).groupBy(number).agg(F.regexp_replace(own[0], "^@", "").alias("read_id"), own[1].alias("seq"), own[2].alias("plus"), own[3].alias("qual"))
    return records.select("read_id", "seq", "plus", "qual", "number")


def read_fasta_tiles(spark: SparkSession, path: str, size: int = 4096, split_on: str = " ", upper: bool = True) -> DataFrame:
    """``chrom``, ``tile``, ``seq``: FASTA as tiles of ``size`` letters, so that no row holds a whole sequence.

    A line finds its place by the lengths of the lines before it in its record; the
    pieces of a tile are then put together.
    """
    lines = numbered_lines(spark, path).withColumn("value", F.regexp_replace("value", "[\\s]+$", "")).withColumn("_head", F.col("value").startswith(">").cast("bigint")).withColumn("_all", F.lit(0))
    records = running_sum(lines, ["_all"], "at", "_head", "record").where("record > 0").select("record", "at", "value", "_head")
    names = records.where("_head = 1").select("record", F.substring_index(F.expr("substring(value, 2)"), split_on, 1).alias("chrom"))
    body = records.where("_head = 0 and value <> ''").withColumn("_n", F.length("value").cast("bigint"))
    placed = running_sum(body, ["record"], "at", "_n", "_end").withColumn("_start", F.col("_end") - F.col("_n"))
    # the first piece fills the tile that the line before has begun
    room = F.least(F.col("_n"), F.lit(size) - F.pmod("_start", F.lit(size))).cast("int")
    rest = F.regexp_extract_all(F.substr("value", room + 1), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    pieces = placed.select("record", "_start", F.posexplode(F.concat(F.array(F.substring("value", F.lit(1), room)), rest)).alias("_k", "part"))
    tile = (F.call_function("div", F.col("_start"), F.lit(size)) + F.col("_k")).cast("int").alias("tile")
    ordered = F.array_sort(F.collect_list(F.struct("_start", "_k", "part")))
    tiles = pieces.where("part <> ''").groupBy("record", tile).agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "").alias("seq"))
    return tiles.join(names, "record").select("chrom", "tile", (F.upper("seq") if upper else F.col("seq")).alias("seq"))


def parse_folding(lines: DataFrame, text: str = "value", least_ratio: float = 0.65) -> DataFrame:
    """Text of a duplex folding program, one alignment a row, to structure, positions and energy.

    A row is like ``((((.&.)))) 1,5 : 10,14 (-7.20)``: brackets of both strands, their
    first and last positions, and the energy.  With a column ``perfect`` (the energy of
    the perfect match) ``mfe_ratio`` is given, at most 1, and rows below ``least_ratio``
    drop out.  Other rows are left out.
    """
    at = r"^\s*([.(]+)&([.)]+)\s+(\d+),(\d+)\s+:\s+(\d+),(\d+)\s+\(\s*(-?[0-9.]+)\)"
    names = [("left", "string"), ("right", "string"), ("t_start", "bigint"), ("t_stop", "bigint"), ("q_start", "bigint"), ("q_stop", "bigint"), ("mfe", "double")]
    out = lines.where(F.col(text).rlike(at)).select("*", *[F.regexp_extract(text, at, i + 1).cast(kind).alias(n) for i, (n, kind) in enumerate(names)])
    if "perfect" in lines.columns:
        out = out.withColumn("mfe_ratio", F.least(F.lit(1.0), F.col("mfe") / F.col("perfect"))).where(F.col("mfe_ratio") >= least_ratio)
    return out


def split_interleaved(fastq: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First and second mates of interleaved records, numbered alike."""
    mates = fastq.withColumn("pair", F.floor(F.col("number") / 2))
    return mates.where("number % 2 = 0"), mates.where("number % 2 = 1")


def filter_pairs(first: DataFrame, second: DataFrame, least: int = 12) -> DataFrame:
    """Pairs whose mates both have ``least`` bases."""
    b = second.select("pair", F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    return first.join(b, "pair").where((F.length("seq") >= least) & (F.length("seq2") >= least))


def trim_adapter(fastq: DataFrame, adapters: list[str], least: int = 16, overlap: int = 3) -> DataFrame:
    """Cut at the first adapter that occurs; the second is tried where the first does not; too short reads drop out.

    A read whose end is the beginning of an adapter, of ``overlap`` letters at least, is
    cut there.  Inexact occurrences need an external trimmer.
    """
    at = F.lit(0)
    for adapter in reversed(adapters):
        own = F.instr("seq", adapter)
        partial = F.lit(0)
        for k in range(max(1, overlap), len(adapter)):
            partial = F.when(F.col("seq").endswith(adapter[:k]), F.length("seq") - k + 1).otherwise(partial)
        at = F.when(own > 0, own).when(partial > 0, partial).otherwise(at)
    out = fastq.withColumn("_at", at)
    for c in ("seq", "qual"):
        out = out.withColumn(c, F.when(F.col("_at") > 0, F.substring(c, F.lit(1), F.col("_at") - 1)).otherwise(F.col(c)))
    return out.drop("_at").where(F.length("seq") >= least)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Decoded alignments; see ``operators.reads.decode_sam``."""
    from helixframe.operators.reads import decode_sam

    return decode_sam(spark.read.text(path))


def read_bedgraph(spark: SparkSession, path: str, strand: str) -> DataFrame:
    """chrom, strand, start, end, value; zero and malformed runs are skipped."""
    return _fields(_lines(spark, path), BEDGRAPH).where("value <> 0 and start < end").select("chrom", F.lit(strand).alias("strand"), "start", "end", "value")


def read_multi_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """A bedGraph of several columns named by its ``#chrom`` header, in long form: chrom, start, end, key, value > 0."""
    names = spark.read.text(path).where(F.col("value").startswith("#chrom")).first()[0].lstrip("#").split("\t")[3:]
    f = F.split("value", "\t")
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.get(f, F.lit(i + 3)).try_cast("double").alias("value")) for i, n in enumerate(names)])
    rows = _lines(spark, path).select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("start"), F.get(f, F.lit(2)).cast("long").alias("end"), F.inline(pairs))
    return rows.where("value > 0")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED6 and the further columns as ``extra``."""
    return _fields(_lines(spark, path), BED)


def bed_by_name(bed: DataFrame, order: str) -> DataFrame:
    """name, start, end; the last of a name in ``order`` wins."""
    return bed.groupBy("name").agg(F.max_by(F.struct("start", "end"), order).alias("x")).select("name", "x.start", "x.end")


def read_bed12(spark: SparkSession, path: str) -> DataFrame:
    """Exons of BED12 rows: chrom, strand, tx, number, start, end."""
    f = F.split("value", "\t")
    ints = lambda i: F.transform(F.filter(F.split(F.get(f, F.lit(i)), ","), lambda x: x != ""), lambda x: x.cast("long"))
    rows = _lines(spark, path).where(F.size(f) >= 12).select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(5)).alias("strand"), F.get(f, F.lit(3)).alias("tx"), F.get(f, F.lit(1)).cast("long").alias("_s"), F.posexplode(F.arrays_zip(ints(10).alias("size"), ints(11).alias("at"))))
    return rows.select("chrom", "strand", "tx", (F.col("pos") + 1).alias("number"), (F.col("_s") + F.col("col.at")).alias("start"), (F.col("_s") + F.col("col.at") + F.col("col.size")).alias("end"))


# Feature types that hold a transcript or an exon.
TRANSCRIPT_TYPES = ["mRNA", "transcript", "ncRNA", "miRNA", "tRNA", "rRNA", "snRNA", "snoRNA", "lnc_RNA", "mRNA_TE_gene", "pseudogenic_transcript", "miRNA_primary_transcript"]
EXON_TYPES = ["exon", "pseudogenic_exon"]


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """The nine columns, 1-based and closed, with ``attributes`` as a map of GFF3 or GTF keys; other lines are left out."""
    f = F.split("value", "\t")
    body = _lines(spark, path).where(F.size(f) == 9)
    # a semicolon inside quotes belongs to the value
    pairs = F.filter(F.regexp_extract_all(F.get(f, F.lit(8)), F.lit('((?:[^;"]|"[^"]*"|")+)'), F.lit(1)), lambda x: F.trim(x) != "")

    def entry(x):
        x = F.trim(x)
        gff = F.instr(x, "=") > 0
        key = F.when(gff, F.substring_index(x, "=", 1)).otherwise(F.substring_index(x, " ", 1))
        value = F.when(gff, F.regexp_replace(x, "^[^=]*=", "")).otherwise(F.regexp_replace(x, "^[^ ]* *", ""))
        return F.struct(key.alias("k"), F.regexp_replace(value, '^"|"$', "").alias("v"))

    entries = F.transform(pairs, entry)
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    attributes = F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(entries, lambda e: e["k"] == k), 1)["v"].alias("v"))))
    return body.select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).alias("source"), F.get(f, F.lit(2)).alias("type"), F.get(f, F.lit(3)).cast("long").alias("start"), F.get(f, F.lit(4)).cast("long").alias("stop"),
                       F.get(f, F.lit(5)).try_cast("double").alias("score"), F.get(f, F.lit(6)).alias("strand"), F.get(f, F.lit(7)).alias("frame"), attributes.alias("attributes"))


def gff_exons(gff: DataFrame) -> DataFrame:
    """Exons joined to their transcripts, half-open, several parents expanded and numbered: chrom, strand, gene, tx, number, start, end."""
    a = F.col("attributes")
    ex = gff.where(F.col("type").isin(EXON_TYPES) & (F.col("start") <= F.col("stop")))
    ex = ex.select("chrom", "strand", "start", "stop", F.explode(F.split(F.coalesce(a["transcript_id"], a["Parent"]), ",")).alias("tx"), a["gene_id"].alias("_g"))
    tx = gff.where(F.col("type").isin(TRANSCRIPT_TYPES)).select(F.coalesce(a["ID"], a["transcript_id"]).alias("tx"), F.coalesce(a["gene_id"], a["Parent"]).alias("gene")).dropDuplicates(["tx"])
    j = ex.join(tx, "tx", "left").withColumn("gene", F.coalesce("_g", "gene", F.regexp_replace("tx", "\\.[^.]*$", "")))
    w = Window.partitionBy("tx").orderBy("start", "stop")
    return j.select("chrom", "strand", "gene", "tx", F.row_number().over(w).alias("number"), (F.col("start") - 1).alias("start"), F.col("stop").alias("end"))


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    return _fields(_lines(spark, path), T.StructType().add("chrom", "string").add("length", "long")).drop("extra")


def read_sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """row, dir, fastq (a list), sample, sample_type, library, layout, adapters (a list)."""
    names = ["row", "dir", "fastq", "sample", "sample_type", "library", "layout", "adapters"]
    f = F.split("value", " +")
    s = _lines(spark, path).select(*[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)])
    return s.withColumn("row", F.col("row").cast("int")).withColumn("fastq", F.split("fastq", ",")).withColumn("adapters", F.split("adapters", ","))


def sample_of(sheet: DataFrame, row: int | None = None, sample_type: str | None = None) -> DataFrame:
    """The lines of a sample sheet with this row number, or of this sample type."""
    out = sheet if row is None else sheet.where(F.col("row") == row)
    return out if sample_type is None else out.where(F.col("sample_type") == sample_type)


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    """name, pattern, mismatches: one row a pattern; rows whose lists differ in length are left out."""
    f = F.split("value", " +")
    p, m = F.split(F.get(f, F.lit(1)), ","), F.split(F.get(f, F.lit(2)), ",")
    rows = _lines(spark, path).where(F.size(p) == F.size(m)).select(F.get(f, F.lit(0)).alias("name"), F.inline(F.arrays_zip(p.alias("pattern"), m.alias("mismatches"))))
    return rows.withColumn("mismatches", F.col("mismatches").cast("int"))


def read_quant(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType().add("gene", "string").add("reads", "double").add("length", "long").add("rpm", "double").add("tpm", "double")
    return _fields(_lines(spark, path), schema).drop("extra").where("reads is not null")


def read_kmer_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of one row a position and one column a k-mer, in long form: rel_pos, kmer, freq."""
    wide = spark.read.csv(path, header=True, inferSchema=True)
    first, *kmers = wide.columns
    return wide.unpivot([first], kmers, "kmer", "freq").withColumnRenamed(first, "rel_pos")


def read_wig(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos (0-based), value of fixedStep files.

    A value's place follows from the header before it and the values since; both are
    carried from one range of lines to the next, so a file may be of any size.
    """
    lines = numbered_lines(spark, path).where("value <> '' and value not like '#%' and value not like 'track%'").withColumn("_all", F.lit(0))
    head = F.col("value").startswith("fixedStep")
    part = lambda name: F.regexp_extract("value", f"{name}=(\\S+)", 1)
    step = F.when(part("step") == "", "1").otherwise(part("step")).cast("bigint")
    rows = running_sum(lines.withColumn("_v", (~head).cast("bigint")), ["_all"], "at", "_v", "seen")
    rows = rows.withColumn("_head", F.when(head, F.struct(part("chrom").alias("chrom"), (part("start").cast("bigint") - 1).alias("start"), step.alias("step"), F.col("seen").alias("before"))))
    r = ranged(rows, ["_all"], ["at"])
    inside = r.withColumn("_own", F.last("_head", ignorenulls=True).over(Window.partitionBy("_p").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    edges = r.where("_head is not null").groupBy("_p").agg(F.max_by("_head", "at").alias("_last"))
    parts = r.select("_p").distinct().join(edges, "_p", "left")
    carry = parts.select("_p", F.last("_last", ignorenulls=True).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))  # one row a partition
    out = inside.where("_v = 1").join(carry, "_p").withColumn("h", F.coalesce("_own", "_carry"))
    return out.select("h.chrom", (F.col("h.start") + (F.col("seen") - F.col("h.before") - 1) * F.col("h.step")).alias("pos"), F.col("value").cast("double").alias("value"))


def read_duplexes(spark: SparkSession, path: str, most: float = 6, least_ratio: float = 0.65) -> DataFrame:
    """A table of predicted duplexes: query, family (without a shuffle's suffix), transcript, slice, allen; rows with a score up to ``most`` and an energy ratio (at most 1) from ``least_ratio`` on."""
    names = ["query", "transcript", "t_start", "t_stop", "slice", "mfe_perfect", "mfe_site", "mfe_ratio", "allen", "paired", "unpaired", "structure", "sequence"]
    f = F.split("value", "\t")
    rows = _lines(spark, path).where(F.size(f) >= len(names)).select(*[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)])
    for c in ("t_start", "t_stop", "slice"):
        rows = rows.withColumn(c, F.col(c).try_cast("long"))
    for c in ("mfe_perfect", "mfe_site", "mfe_ratio", "allen"):
        rows = rows.withColumn(c, F.col(c).try_cast("double"))
    rows = rows.where(F.col("allen") <= most).withColumn("mfe_ratio", F.least(F.lit(1.0), F.col("mfe_ratio"))).where(F.col("mfe_ratio") >= least_ratio)
    return rows.withColumn("family", F.substring_index("query", "_shuffled", 1))
