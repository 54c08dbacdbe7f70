from helixframe.operators import genome


def test_sequences_over_tile_borders(spark):
    seq = "ACGTTGCAAGGCTTAACCGGTTAC"
    g = genome.tiles(spark.createDataFrame([("c", seq), ("d", "")], "chrom string, seq string"), 5)
    ex = spark.createDataFrame([("c", "+", "p", 3, 12), ("c", "+", "p", 15, 21), ("c", "-", "m", 0, 7)], "chrom string, strand string, tx string, start long, end long")
    got = {r.tx: r.seq for r in genome.transcript_sequences(ex, g, 5).collect()}
    rc = seq[0:7][::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert got == {"p": seq[3:12] + seq[15:21], "m": rc}
    share = {r.tx: r.share for r in genome.base_share(ex, g, "tx", "G", 5).collect()}
    assert share["p"] == (seq[3:12] + seq[15:21]).count("G") / 15 and share["m"] == rc.count("G") / 7
    pts = spark.createDataFrame([("c", "+", 6), ("c", "-", 6), ("c", "+", 99)], "chrom string, strand string, pos long")
    assert sorted((r.strand, r.base) for r in genome.bases_at(pts, g, 5).collect()) == [("+", "C"), ("-", "G")]


def test_coding_parts(spark):
    s = spark.createDataFrame([("t", "CCATGAAATAGGG")], "tx string, seq string")
    r = genome.coding_parts(s).first()
    assert (r.utr5, r.cds, r.utr3) == ("CC", "ATGAAATAG", "GG")


def test_best_duplex_and_weights(spark):
    d = spark.createDataFrame([("q1", "t", 5, 2.0, 0.7), ("q2", "t", 5, 1.0, 0.6), ("q3", "t", 5, None, 0.9)], "query string, transcript string, slice long, allen double, mfe_ratio double")
    assert genome.best_duplex(d).first().query == "q2" and genome.best_duplex(d, "mfe").first().query == "q3"
    a = spark.createDataFrame([(1, 0.5, 1), (1, 0.25, 2)], "pos long, weight double, o long")
    b = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "pos long, o long")
    assert sorted(r.weight for r in genome.transfer_weights(a, b, ["pos"], "o").collect()) == [0.25, 0.5, 1.0]
