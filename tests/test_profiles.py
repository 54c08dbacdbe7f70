import random

from helixframe.operators import annotation, bias, genome, quant, reads, signal
from helixframe.sources import formats, sinks


def test_isoforms_by_priors():
    # a alone 0-100 (200 reads), shared 100-200 (300 reads), b alone 200-300 (100 reads)
    out = quant.settle_edges([(0, 100, ["a"], 200.0), (100, 200, ["a", "b"], 300.0), (200, 300, ["b"], 100.0)])
    # priors 2 and 1 expect exactly the 300
    assert out == {"a": 400.0, "b": 200.0}
    # b has no edge of its own: it gets what the prior of a leaves
    assert quant.settle_edges([(0, 100, ["a"], 100.0), (100, 200, ["a", "b"], 150.0)]) == {"a": 200.0, "b": 50.0}
    # an edge of its own under 20 bases gives no prior; the others are shared by what is known
    assert quant.settle_edges([(0, 10, ["b"], 90.0), (10, 110, ["a"], 100.0), (110, 210, ["a", "b"], 100.0)]) == {"a": 200.0, "b": 0.0}
    # nothing known at all: equal parts
    assert quant.settle_edges([(0, 100, ["a", "b"], 80.0)]) == {"a": 40.0, "b": 40.0}
    # two unknown on one edge wait until the other edge has settled one of them
    out = quant.settle_edges([(0, 100, ["b", "c", "a"], 90.0), (100, 200, ["a"], 10.0), (200, 300, ["a", "b"], 50.0)])
    assert out["a"] == 30.0 and out["b"] > 0 and out["c"] > 0
    assert quant.settle_edges([(0, 50, ["a", "b"], 0.0)]) == {"a": 0.0, "b": 0.0}


def test_isoforms_keep_the_reads_of_chains_longer_than_any_number_of_rounds():
    # each edge makes one more transcript known, from right to left
    n = 150
    edges = [(i * 100, i * 100 + 100, [f"t{i:03d}", f"t{i + 1:03d}"], 100.0) for i in range(n)] + [(n * 100, n * 100 + 100, [f"t{n:03d}"], 40.0)]
    out = quant.settle_edges(edges)
    assert len(out) == n + 1 and all(v > 0 for v in out.values())


def test_motif_over_tile_borders(spark):
    rng = random.Random(3)
    seq = "".join(rng.choice("ACGT") for _ in range(700))
    g = spark.createDataFrame([("c", seq)], "chrom string, seq string")
    got = sorted((r.start, r.strand) for r in genome.motif_scan(genome.tiles(g, 16), "GAYTC", 1, 16).collect())
    def fits(motif, i):
        return sum(seq[i + k] not in {"Y": "CT", "R": "AG"}.get(c, c) for k, c in enumerate(motif)) <= 1
    assert got == sorted([(i, "+") for i in range(696) if fits("GAYTC", i)] + [(i, "-") for i in range(696) if fits("GARTC", i)])


def test_tiles_and_groups():
    deviation = [(0, 0.01), (1, 0.2), (2, 0.3), (3, 0.02), (4, 0.1), (5, 0.09)]
    assert bias.biased_tiles(deviation, 2) == [1, 4]
    assert bias.tile_groups([1, 4, 7, 9], {(1, 7): 0.5, (4, 9): 0.1}) == [[1, 7], [4], [9]]


def test_bias_is_corrected(spark):
    rng = random.Random(5)
    rows = [(i, ("GG" if i % 2 else "".join(rng.choice("ACGT") for _ in range(2))) + "".join(rng.choice("ACGT") for _ in range(18))) for i in range(2000)]
    # the first tile deviates here, so the threshold lies under it
    w = {r.id: r.weight for r in bias.correct_bias(spark.createDataFrame(rows, "id long, seq string"), "id", 2, 6, fold=0.5).collect()}
    favoured = [w[i] for i, s in rows if s.startswith("GG")]
    others = [w[i] for i, s in rows if not s.startswith("GG")]
    assert len(w) == 2000 and max(favoured) < 0.5 < min(others)


def test_tags_repeated_or_long(spark):
    line = "r\t0\tc\t1\t60\t5M\t*\t0\t0\tAAAAA\tIIIII\tXW:f:0.5\tXA:Z:" + "x" * 1_200_000 + "\tXW:f:9"
    row = reads.decode_sam(spark.createDataFrame([(line,)], "value string")).first()
    assert row.weight == 0.5 and len(row.tags["XA"]) == 1_200_000


def test_folding_text_and_duplex_lines(spark):
    lines = spark.createDataFrame([("((((.&.)))) 1,5 : 10,14 (-7.20)", -9.0), (">query", -9.0), ("((.&.)) 1,3 : 2,4 ( -2.0)", -9.0)], "value string, perfect double")
    out = formats.parse_folding(lines).collect()
    assert [(r.left, r.right, r.t_start, r.q_stop, r.mfe, round(r.mfe_ratio, 2)) for r in out] == [("((((.", ".))))", 1, 14, -7.2, 0.8)]
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("ACGU", "UGUA")], "q string, t string")
    assert d.select(sinks.pretty_duplex(F.col("q"), F.col("t"))).first()[0].split("\n") == ["5' AUGU 3'", "   |o||", "3' UGCA 5'"]


def test_headers_in_every_part(spark, tmp_path):
    runs = spark.createDataFrame([("c%d" % (i % 7), i, i + 1, float(i), None) for i in range(60)], "chrom string, start long, end long, a double, b double")
    sinks.write_multi_bedgraph(runs.repartition(4), ["a", "b"], str(tmp_path / "m"))
    parts = [p.read_text().splitlines() for p in (tmp_path / "m").glob("part-*")]
    assert all(p[0] == "#chrom\tstart\tend\ta\tb" for p in parts) and sum(len(p) - 1 for p in parts) == 60


def test_fastq_numbers_over_files(spark, tmp_path):
    for name, ids in (("a.fq", range(30)), ("b.fq", range(30, 47))):
        (tmp_path / name).write_text("".join(f"@r{i}\nACGT\n+\n@III\n" for i in ids))
    out = formats.read_fastq(spark, str(tmp_path)).collect()
    assert sorted((r.number, r.read_id) for r in out) == [(i, f"r{i}") for i in range(47)]
    assert all(r.qual == "@III" for r in out)


def test_values_of_features(spark):
    rows = [("c", "+", 10, 14, 10, 50.0), ("c", "+", 10, 14, 11, 3.0), ("c", "+", 10, 14, 12, 45.0), ("c", "+", 10, 14, 13, 0.5)]
    inside = spark.createDataFrame(rows, "chrom string, strand string, start long, end long, pos long, value double")
    assert signal.feature_score(inside, "byrank").first().score == "0,2"
    assert signal.feature_score(inside, "allvalues").first().score == "0:0.51,1:0.03,2:0.46"
    assert signal.feature_score(inside, "rpm", 1e6).first().score == "98.5"
    assert signal.feature_score(inside, "what").first().score == "98.5"


def test_names_and_buffers(spark):
    f = spark.createDataFrame([("b", "+", 5, 9, 6), ("a", "-", 1, 2, 1), ("a", "+", 3, 4, 3)], "chrom string, strand string, start long, end long, peak long")
    got = {(r.chrom, r.strand): (r.name, r.end, r.peak) for r in annotation.buffer_right(annotation.name_in_order(f, "nm")).collect()}
    assert got == {("a", "-"): ("nm.1", 3, 2), ("a", "+"): ("nm.2", 5, 4), ("b", "+"): ("nm.3", 10, 7)}
