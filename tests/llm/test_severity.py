import random

import numpy as np

from helixframe.llm import severity

BAD = ["you filthy moron", "kill yourself now", "naked pictures of her"]
GOOD = ["the tower sees the old bridge", "a quiet farmer paints the door", "kill the stalled process", "naked oats are a cereal", "the report is late today"]


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        parts = [rng.choice(GOOD) for _ in range(rng.randint(1, 8))]
        bad = rng.random() < 0.2
        if bad:
            parts[rng.randrange(len(parts))] = rng.choice(BAD)
        rows.append((i, ". ".join(parts) + ".", bad))
    return rows


def test_disguises_are_undone():
    n = severity.normalise
    assert n("A-r-s-c-h-l-o-c-h") == n("a.r.s.c.h.l.o.c.h") == "arschloch"
    assert n("m i n a b l e") == "minable" and n("V3r54g3r") == "versager" and n("сrétin") == "cretin" and n("morooooon") == "moron"
    assert n("in 1984 we paid 45") == "in 1984 we paid 45"


def test_cumulative_link_gradient():
    rng = np.random.default_rng(0)
    texts = [sorted(set(rng.integers(0, 40, 6).tolist())) for _ in range(400)]
    plan = severity.SeverityPlan(buckets=64, epochs=400)
    truth = rng.normal(size=64)
    x = severity.Segments.of(np.concatenate(texts), np.array([len(t) for t in texts]), np.arange(400), 400)
    grade = np.digitize(x.score(truth) + rng.logistic(size=400) * 0.1, [0.3, 1.0])
    weights, cuts = severity.fit_cumulative(x, grade, plan)
    assert cuts[0] < cuts[1]
    predicted = np.digitize(x.score(weights), cuts)
    assert (predicted == grade).mean() > 0.8


def test_held_out_documents_with_wrong_votes():
    rng = random.Random(1)
    train, test = corpus(800, 1), corpus(400, 2)
    features = severity.Featurizer(1 << 16)
    plan = severity.SeverityPlan(buckets=1 << 16)
    votes = [2 * (b != (rng.random() < 0.03)) for _, _, b in train]
    weights, cuts = severity.fit_documents(features.segments([t for _, t, _ in train]), np.array(votes), plan)
    x = features.segments([t for _, t, _ in test])
    best, _ = severity.worst(x.score(weights), x.doc, x.docs)
    found = 1 - severity._logistic(cuts[0] - best) >= plan.found_at
    truth = np.array([b for _, _, b in test])
    assert (found == truth).mean() > 0.98


def test_table(spark):
    rows = corpus(300, 3)
    docs = spark.createDataFrame([(i, t, "s%d" % (i % 3)) for i, t, _ in rows] + [(900, None, "s0"), (901, "", None), (902, "?!", "s1"), (903, ("the report is late today. " * 20_000) + BAD[0], "s2"), rows[0][:2] + ("s0",)], "doc_id long, text string, severity string")
    labels = spark.createDataFrame([(i, int(b)) for i, _, b in rows] + [(1, None), (2, 7), (None, 1), (99999, 1)], "doc_id long, abusive int")
    plan = severity.SeverityPlan(buckets=1 << 14)
    out = severity.score_documents(docs, "doc_id", "text", labels, "abusive", plan=plan).collect()
    assert len(out) == 305
    found = {r.doc_id for r in out if r.found}
    truth = {i for i, _, b in rows if b} | {903}
    assert len(found & truth) >= 0.97 * len(truth) and len(found - truth) <= 0.03 * len(truth)
    assert {r.severity for r in out if r.doc_id in (900, 901, 902)} == {0.0}
    none = severity.score_documents(docs, "doc_id", "text", labels.limit(0), "abusive", plan=plan)
    assert none.where("found").count() == 0 and none.count() == 305
    assert severity.score_documents(docs.limit(0), "doc_id", "text", labels, "abusive", plan=plan).count() == 0


def test_features_are_those_of_each_segment_alone():
    features, alone = severity.Featurizer(1 << 18), severity.Featurizer(1 << 18)
    texts = ["the report is late. you f**l, you fool", None, "", "?!", "so so so\nnaked oats", "a" * 200_000, "x1" * 50_000]
    x = features.segments(texts)
    ends = [*x.begin.tolist(), len(x.index)]
    got = [(d, x.index[a:b].tolist()) for d, a, b in zip(x.doc.tolist(), ends, ends[1:])]
    expected = []
    for d, t in enumerate(texts):
        for part in severity._SPLIT.split(severity.normalise(t or "")):
            words = severity._WORDS.findall(part)
            own = set()
            for w in words:
                bare = w.replace("*", "")
                marked = f"<{severity._DOUBLES.sub(chr(92) + '1', bare)}>"
                own |= {f"u{bare}", *(f"c{marked[i:i + 4]}" for i in range(len(marked) - 3) if len(bare) >= 4)}
            own |= {f"b{a} {b}" for a, b in zip(["^", *words], [*words, "$"])} if words else set()
            if own:
                expected.append((d, sorted({alone._hash(f) for f in own})))
    assert got == expected and x.docs == len(texts)


def test_string_ids_null_ids_and_a_fitted_model(spark):
    rows = corpus(200, 4)
    docs = spark.createDataFrame([("d%d" % i, t) for i, t, _ in rows] + [(None, BAD[0])], "id string, text string")
    labels = spark.createDataFrame([("d%d" % i, int(b)) for i, _, b in rows], "id string, vote int")
    plan = severity.SeverityPlan(buckets=1 << 14)
    model = severity.learn(docs, "id", "text", labels, "vote", plan)
    first = severity.score_documents(docs, "id", "text", labels, "vote", plan=plan, model=model).collect()
    assert sorted(map(str, first)) == sorted(map(str, severity.score_documents(docs, "id", "text", labels, "vote", plan=plan).collect()))
    assert len(first) == 201 and [r.found for r in first if r.id is None] == [True]
    few = severity.learn(docs, "id", "text", labels, "vote", severity.SeverityPlan(buckets=1 << 14, max_labelled=20))
    assert few[0].any() and (few[0] != model[0]).any()
