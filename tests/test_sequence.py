import random

from pyspark.sql import functions as F

from helixframe.functions import sequence as S


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_reverse_complement(spark):
    assert one(spark, S.revcomp(F.col("s")), s="ACGTRYN") == "NRYACGT"
    assert one(spark, S.revcomp(S.revcomp(F.col("s"))), s="ACCGTRYKMBDHVN") == "ACCGTRYKMBDHVN"


def test_complexity():
    assert S.i_complexity("AAAA") == 1.0
    assert S.i_complexity("ACGT") == 1.7227
    assert S.i_complexity("ACACAC") == 1.544
    rng = random.Random(0)
    for _ in range(50):
        t = "".join(rng.choice("AC") for _ in range(rng.randint(0, 30)))
        suffixes = sorted(t[i:] for i in range(len(t)))
        lcp = [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in zip(suffixes, suffixes[1:])]
        assert S.lcp_array(t).tolist() == lcp
        assert S.distinct_substrings(t) == len({t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)})


def test_cigar(spark):
    seg = one(spark, S.cigar_segments(F.col("p"), F.col("c")), p=100, c="2S3M5N2M")
    assert [tuple(x) for x in seg] == [(100, 103), (108, 110)]
    assert [tuple(x) for x in one(spark, S.cigar_junctions(F.col("p"), F.col("c")), p=100, c="2S3M5N2M")] == [(103, 107)]
    assert one(spark, S.softclip(F.col("c"), "left"), c="2S3M") == 2 and one(spark, S.softclip(F.col("c"), "right"), c="2S3M") == 0


def test_duplex_scores(spark):
    query = "UGACAGAAGAGAGUGAGCAC"
    target = query.translate(str.maketrans("ACGU", "UGCA"))
    assert one(spark, S.allen_score(F.col("q"), F.col("t")), q=query, t=target) == 0
    altered = target[:4] + query[4] + target[5:14] + "U" + target[15:]
    assert query[14] == "G"
    assert one(spark, S.allen_score(F.col("q"), F.col("t")), q=query, t=altered) == 2.5
    assert one(spark, S.slice_site(F.col("q"), F.col("t"), F.lit(120)), q=query, t=target) == 111
    bulged = query[:3] + "-" + query[3:], target[:3] + "A" + target[3:]
    assert one(spark, S.slice_site(F.col("q"), F.col("t"), F.lit(120)), q=bulged[0], t=bulged[1]) == 110
    regions = one(spark, S.pairing_regions(F.col("q"), F.col("t")), q=bulged[0], t=bulged[1])
    assert [(r.start, r.end, r.kind) for r in regions] == [(4, 4, "BULt")]
    assert not one(spark, S.duplex_ok(F.col("q"), F.col("t")), q="A-", t="U-")


def test_translation_and_orf(spark):
    assert one(spark, S.translate_codons(F.col("s")), s="ATGGCNTAANNN") == "MA*X"
    assert S.orf_of("CATGAAATAGATGC") == ("MK", 1, 10, False)
    assert S.orf_of("ATGAAA") == ("MK", 0, 6, True)


def test_motif_scan_allows_substitutions(spark):
    rng = random.Random(1)
    s = "".join(rng.choice("ACGT") for _ in range(300))
    hits = one(spark, S.motif_hits(F.col("s"), "GTY", 1), s=s)
    assert hits == [i for i in range(298) if sum(s[i + k] not in w for k, w in enumerate(["G", "T", "CT"])) <= 1]
    assert S.iupac_regex("GTY") == "GT[CT]"


def test_softclip_rescue(spark):
    df = spark.createDataFrame([("GGA", "TGA", "left"), ("ACC", "ACG", "right"), ("", "", "left")], "c string, g string, s string")
    rows = df.select(S.rescue_softclip("c", "g", "s").alias("r")).select("r.*").collect()
    assert [(r.mapped, r.untemplated) for r in rows] == [([1, 2], "G"), ([0, 1], "C"), ([], "")]


def brute_repeats(text):
    forward = [max((n for n in range(len(text) - i + 1) if text[i : i + n] in text[i + 1 :]), default=0) for i in range(len(text))]
    backward = [max((n for n in range(i + 2) if text[i + 1 - n : i + 1] in text[:i]), default=0) for i in range(len(text))]
    return forward, backward


def test_repeats_against_brute_force():
    import random

    rng = random.Random(4)
    for n in [0, 1, 2, 3, 10, 40, 90]:
        for letters in ("a", "ab", "ACGT"):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert S.repetitions(text) == brute_repeats(text), text
            order, lcp = S.suffix_order(text)
            assert order.tolist() == sorted(range(n), key=lambda i: text[i:])
    assert S.longest_repeats("banana") == ["ana"] and S.longest_repeats("banana", "B") == ["ana"]
    assert S.repeated_prefixes("banana") == ["", "a", "ana", "", "", "na"]
    assert S.ideal_profile(8, 2) == [0, 0, 1, 1, 1, 2, 2, 2]


def test_gapped_duplexes(spark):
    from pyspark.sql import functions as F

    from helixframe.functions import duplex

    assert duplex.gapped("((.(", ")))", "AAGA", "UUU") == ("((.(", ")-))", "AAGA", "U-UU")
    assert duplex.gapped("(((", ").))", "AAA", "UGUU") == ("((-(", ").))", "AA-A", "UGUU")
    assert duplex.padded("((", "))", 10, 11, 2, 3, 5) == ("..((.", ".))..", 8, 12)
    assert duplex.trimmed("...((..", ".))..", 5, 11) == ("..((.", ".))..", 6, 10)
    d = spark.createDataFrame([("ACGUACGUACGU", "ACGUACGUACGU", 112), ("ACGUACGU-CGU", "AC-UACGUACGU", 112), ("ACG", "ACG", 5)], "t string, q string, stop long")
    assert [r[0] for r in d.select(duplex.slice_of(F.col("t"), F.col("q"), F.col("stop"))).collect()] == [103, 103, None]
