import pytest
from pyspark.sql import functions as F

from helixframe.operators import reads
from helixframe.sources import formats, sinks


@pytest.fixture
def put(tmp_path):
    def write(text):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.txt"
        path.write_text(text)
        return str(path)
    return write


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_fasta_and_fastq(spark, put, tmp_path):
    path = put(">a one\nacg\nTT\n>b\nGG\n")
    assert rows(formats.read_fasta(spark, path), "name", "seq") == [("a", "ACGTT"), ("b", "GG")]
    assert rows(formats.read_fasta(spark, path, rna=True), "name", "seq") == [("b", "GG")]
    fq = formats.read_fastq(spark, put("@r1\nACGT\n+\nIIII\n@r2\nGG\n+\nII\n@r3\nTTT\n+\nIII\n@r4\nA\n+\nI\n"))
    assert rows(fq, "read_id", "seq", "number") == [("r1", "ACGT", 0), ("r2", "GG", 1), ("r3", "TTT", 2), ("r4", "A", 3)]
    first, second = formats.split_interleaved(fq)
    assert rows(formats.filter_pairs(first, second, 2), "read_id", "seq2") == [("r1", "GG")]
    assert rows(formats.trim_adapter(fq, ["GT", "TT"], 0), "read_id", "seq", "qual") == [("r1", "AC", "II"), ("r2", "GG", "II"), ("r3", "", ""), ("r4", "A", "I")]
    out = str(tmp_path / "out")
    sinks.write_fasta(formats.read_fasta(spark, path), out)
    assert rows(formats.read_fasta(spark, out), "name", "seq") == [("a", "ACGTT"), ("b", "GG")]
    sinks.write_fastq(fq.coalesce(1).orderBy("number"), out)
    assert rows(formats.read_fastq(spark, out), "read_id", "seq") == rows(fq, "read_id", "seq")


def test_sam(spark, put):
    text = "@SQ\tSN:c1\tLN:500\n" + "\n".join([
        "r1\t0\tc1\t101\t60\t2S3M5N2M\t*\t0\t0\tGGACGTT\tIIIIIII\tNH:i:1\tXW:f:0.5", "r2\t16\tc1\t11\t60\t3M1S\t*\t0\t0\tAAAC\tIIII", "r3\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI", "r4\t272\tc1\t5\t0\t3M\t*\t0\t0\tAAA\tIII",
    ]) + "\n"
    path = put(text)
    sam = formats.read_sam(spark, path)
    got = {r.read_id: r for r in sam.collect()}
    assert set(got) == {"r1", "r2", "r4"}
    assert got["r1"].weight == 0.5 and got["r2"].weight == 1.0 and got["r1"].pos == 100 and got["r2"].strand == "-" and not got["r4"].primary
    assert [tuple(s) for s in got["r1"].segments] == [(100, 103), (108, 110)]
    assert rows(reads.sam_lengths(spark.read.text(path)), "chrom", "length") == [("c1", 500)]
    assert [r.read_id for r in reads.untemplated_filter(sam, "G").collect()] == ["r1", "r2"]
    assert [r.read_id for r in reads.softclip_policy(sam, "none").collect()] == ["r4"]
    assert [r.read_id for r in reads.min_match(sam.withColumn("n_map", F.lit(1)), 3).collect()] == ["r1"]
    j = spark.createDataFrame([("GT", "AG"), ("CT", "AC"), ("AA", "AA")], "left_bases string, right_bases string")
    assert [r.strand for r in reads.junction_strand(j).collect()] == ["+", "-", "."]


def test_intervals(spark, put, tmp_path):
    bg = formats.read_bedgraph(spark, put("#x\nc\t0\t3\t2.5\nc\t3\t4\t0\nbad\n"), "+")
    assert rows(bg, "chrom", "strand", "start", "end", "value") == [("c", "+", 0, 3, 2.5)]
    out = str(tmp_path / "bg")
    sinks.write_bedgraph(bg, out)
    assert rows(formats.read_bedgraph(spark, out, "+"), "start", "end", "value") == [(0, 3, 2.5)]
    multi = formats.read_multi_bedgraph(spark, put("#chrom\tstart\tend\tA\tC\nc\t0\t1\t1\t0\nc\t1\t2\t2\t3\n"))
    assert rows(multi, "start", "key", "value") == [(0, "A", 1.0), (1, "A", 2.0), (1, "C", 3.0)]
    bed = formats.read_bed(spark, put("c\t1\t5\tn\t7\t-\tx\ty\nc\t2\t6\tn\t.\t+\n"))
    assert rows(bed, "start", "score", "extra") == [(1, 7.0, ["x", "y"]), (2, None, [])]
    assert rows(formats.bed_by_name(bed, "start"), "name", "start") == [("n", 2)]
    b12 = formats.read_bed12(spark, put("c\t10\t50\tt\t0\t+\t10\t50\t0\t2\t5,10,\t0,30,\n"))
    assert rows(b12, "tx", "number", "start", "end") == [("t", 1, 10, 15), ("t", 2, 40, 50)]


def test_annotation(spark, put, tmp_path):
    gff = formats.read_gff(spark, put(
        "##x\nc\ts\tmRNA\t1\t90\t.\t+\t.\tID=g.1;Parent=g\nc\ts\texon\t1\t30\t.\t+\t.\tParent=g.1,g.2\nc\ts\texon\t61\t90\t.\t+\t.\tParent=g.1\n"
        'c\ts\texon\t5\t9\t2\t-\t.\tgene_id "h"; transcript_id "h.1";\nshort\tline\n'))
    ex = formats.gff_exons(gff)
    assert rows(ex, "gene", "tx", "number", "start", "end") == [("g", "g.1", 1, 0, 30), ("g", "g.1", 2, 60, 90), ("g", "g.2", 1, 0, 30), ("h", "h.1", 1, 4, 9)]
    out = str(tmp_path / "gff")
    sinks.write_gff(ex, out)
    assert rows(formats.gff_exons(formats.read_gff(spark, out)), "tx", "start", "end") == rows(ex, "tx", "start", "end")


def test_tables(spark, put):
    assert rows(formats.read_lengths(spark, put("c1\t5\n")), "chrom", "length") == [("c1", 5)]
    sheet = formats.read_sample_sheet(spark, put("1 d a.fq,b.fq s t 5P SE X,Y\n"))
    assert rows(sheet, "row", "fastq", "adapters") == [(1, ["a.fq", "b.fq"], ["X", "Y"])]
    assert rows(formats.read_motifs(spark, put("# c\nm ACG,GGT 0,1\nbad A 1,2\n")), "name", "pattern", "mismatches") == [("m", "ACG", 0), ("m", "GGT", 1)]
    assert rows(formats.read_quant(spark, put("#g\ng1\t2\t100\t3\t4\n")), "gene", "reads", "length") == [("g1", 2.0, 100)]
    assert rows(formats.read_kmer_table(spark, put("rel_pos,AA,AC\n0,0.5,0.25\n")), "rel_pos", "kmer", "freq") == [(0, "AA", 0.5), (0, "AC", 0.25)]
    assert rows(formats.read_wig(spark, put("track\nfixedStep chrom=c start=3 step=2\n1\n2\n")), "chrom", "pos", "value") == [("c", 2, 1.0), ("c", 4, 2.0)]


def test_weights_and_junctions(spark):
    df = spark.createDataFrame([("a", 2.4), ("b", 0.2)], "read_id string, weight double")
    assert sinks.duplicate_by_weight(df).count() == 2
    j = spark.createDataFrame([("c", 5, 9, "+", 1), ("c", 5, 9, "+", 2)], "chrom string, left long, right long, strand string, n long")
    assert rows(sinks.junction_bed(j), "start", "end", "score") == [(5, 10, 3)]


def test_fasta_as_tiles(spark, tmp_path):
    import random

    from helixframe.sources import formats

    rng = random.Random(1)
    seqs = {f"c{i}": "".join(rng.choice("ACGTacgt") for _ in range(n)) for i, n in enumerate((0, 1, 63, 64, 65, 1000, 20_000))}
    text = "".join(f">{k} note\n" + "\n".join(s[a : a + w] for a in range(0, len(s), w)) + "\n" for (k, s), w in zip(seqs.items(), (7, 7, 60, 64, 13, 10, 20_000)))
    (tmp_path / "g.fa").write_text(text)
    got = {}
    for r in formats.read_fasta_tiles(spark, str(tmp_path / "g.fa"), 64).collect():
        got.setdefault(r.chrom, {})[r.tile] = r.seq
    assert {k: "".join(own[t] for t in range(len(own))) for k, own in got.items()} == {k: s.upper() for k, s in seqs.items() if s}
    assert all(len(s) == 64 for own in got.values() for t, s in own.items() if t < len(own) - 1)


def test_wig_headers_are_carried_over_ranges_of_lines(spark, tmp_path):
    from helixframe.sources import formats

    text, expected = "track type=wiggle_0\n", []
    for k in range(40):
        text += f"fixedStep chrom=c{k % 3} start={k * 100 + 1} step={1 + k % 2}\n" + ("# note\n" if k % 7 == 0 else "")
        for i in range(k):
            text += f"{i}.5\n"
            expected.append((f"c{k % 3}", k * 100 + i * (1 + k % 2), i + 0.5))
    (tmp_path / "a.wig").write_text(text)
    assert sorted(tuple(r) for r in formats.read_wig(spark, str(tmp_path / "a.wig")).collect()) == sorted(expected)
