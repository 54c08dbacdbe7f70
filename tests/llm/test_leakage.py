import random

import numpy as np
import pytest

from helixframe.llm import leakage


def naive(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row2 = [i]
        for j, y in enumerate(b, 1):
            row2.append(min(row[j] + 1, row2[-1] + 1, row[j - 1] + (x != y)))
        row = row2
    return row[-1]


def test_passage_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a = [rng.choice("abc") for _ in range(rng.randint(1, 7))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        assert leakage.passage_distance(a, b, 2) == min(min(naive(a, b[:n]) for n in range(len(b) + 1)), 3)


@pytest.mark.parametrize("size", [6, 8, 12])
@pytest.mark.parametrize("edits", [1, 2])
def test_the_recall_holds_for_every_kind_and_place_of_an_edit(size, edits):
    plan = leakage.WalkPlan(max_edits=edits)
    n = leakage.repetitions_for(plan, size)
    drawn = leakage.edited_pairs(size, plan.edits(size), 1000, np.random.default_rng(99))
    hit = leakage.collisions(drawn, plan, size, n, 98).any(axis=0)
    for case in {(kind, place) for kind, place, *_ in drawn}:
        own = np.array([(kind, place) == case for kind, place, *_ in drawn])
        assert hit[own].mean() >= plan.recall, case


def test_equal_passages_collide_and_others_do_not():
    plan = leakage.WalkPlan()
    rng = np.random.default_rng(9)
    a = rng.integers(0, 1 << 63, size=500 * 12, dtype=np.uint64)
    starts = np.arange(500) * 12
    for r in range(leakage.repetitions_for(plan, 12)):
        anchors = starts + 11 * (r % 2)
        x = leakage.signatures(a, anchors, plan, 12, r)
        assert (x == leakage.signatures(a.copy(), anchors, plan, 12, r)).all() and len(set(x.tolist())) == 500


def brute(docs, items, plan):
    """Least edits between a window of the item and any passage of the document."""
    out = {}
    for d, t in docs:
        w = leakage.words_of(t)
        for i, u in items:
            v = leakage.words_of(u)
            n = min(len(v), plan.window)
            if d is None or i is None or n < plan.least:
                continue
            most = plan.edits(n)
            for a in [v[k : k + n] for k in range(len(v) - n + 1)]:
                for k in range(len(w) - n + most + 1):
                    e = min((naive(a, w[k : k + m]) for m in range(n - most, n + most + 1)), default=9) if set(a) & set(w[k : k + 3]) else 9
                    if e <= most:
                        out[d, i] = min(e, out.get((d, i), 9))
    return out


def test_near_passages_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "w%d" % rng.randrange(3000)
    items = [(i, " ".join(word() for _ in range(rng.choice([4, 6, 9, 12, 16])))) for i in range(24)]
    docs = []
    for d in range(300):
        own = [word() for _ in range(rng.randint(0, 12))]
        passage = rng.choice(items)[1].split()[:13]
        at = rng.randrange(1, len(passage))
        kind = d % 4
        passage[at : at + (kind in (0, 2))] = [word()] if kind in (0, 1) else []
        docs.append((d, " ".join(own + passage + [word() for _ in range(rng.randint(0, 6))])))
    plan = leakage.WalkPlan()
    expected = brute(docs, items, plan)
    out = leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").collect()
    got = {(r.doc_id, r.item_id): r.edits for r in out}
    assert set(got) <= set(expected) and all(got[p] >= expected[p] for p in got)
    assert all(p in got for p, e in expected.items() if e == 0)
    assert len(expected) > 150 and len(got) >= plan.recall * len(expected)


def test_string_ids_and_nulls(spark):
    text = " ".join("w%d" % k for k in range(14))
    docs = spark.createDataFrame([("a", text), ("b", None), (None, text), ("a", text)], "item_id string, text string")
    items = spark.createDataFrame([("x", text), (None, text), ("y", "w1 w2")], "item_id string, text string")
    assert [tuple(r) for r in leakage.find_leaks(docs, "item_id", "text", items.withColumnRenamed("item_id", "i"), "i", "text").collect()] == [("a", "x", 0)]
    nothing = leakage.find_leaks(docs, "item_id", "text", items.limit(0).withColumnRenamed("item_id", "i"), "i", "text")
    assert nothing.count() == 0


def test_documents(spark):
    rng = random.Random(3)
    word = lambda: "w%d" % rng.randrange(400)
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 12, 30])))) for i in range(20)] + [(20, None), (None, "x")]
    docs = []
    for d in range(200):
        own = [word() for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            passage = rng.choice(items[:20])[1].split()
            lo = rng.randrange(len(passage))
            piece = passage[lo : lo + rng.choice([11, 12, 13, 30])]
            at = rng.randint(0, len(own))
            own[at:at] = [w.upper() for w in piece]
        docs.append((d, " -- ".join(own), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (502, " ".join([word() for _ in range(30_000)]) + " " + items[0][1], "x"), docs[0]]

    def grams(text):
        w = leakage.words_of(text)
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    of_items = {i: grams(u) for i, u in items if i is not None}
    of_docs = {d: grams(t) for d, t, _ in docs}
    expected = sorted((d, i) for d, g in of_docs.items() for i, h in of_items.items() if g & h)
    out = leakage.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string, item_id string"), "doc_id", "text",
        spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", leakage.WalkPlan(max_edits=0, least=12, walk=2.0),
    ).collect()
    assert sorted((r.doc_id, r.item_id) for r in out) == expected and all(r.edits == 0 for r in out)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert leakage.find_leaks(empty, "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").count() == 0


def one_edit_pairs(docs, items, n=12):
    """All (document, item) that share a window of n words with at most one word changed, put in or left out, by tables of windows with a word missing."""
    whole, holed, shorter = {}, {}, {}
    for i, u in items:
        w = leakage.words_of(u)
        for k in range(len(w) - n + 1):
            a = tuple(w[k : k + n])
            whole.setdefault(a, set()).add(i)
            for p in range(n):
                holed.setdefault((p, a[:p] + a[p + 1 :]), set()).add(i)
                shorter.setdefault(a[:p] + a[p + 1 :], set()).add(i)
    out = set()
    for d, t in docs:
        w = leakage.words_of(t)
        for k in range(len(w) - n + 2):
            b = tuple(w[k : k + n - 1])
            out |= {(d, i) for i in shorter.get(b, ())}  # a word left out
            b = tuple(w[k : k + n])
            if len(b) == n:
                for p in range(n):
                    out |= {(d, i) for i in holed.get((p, b[:p] + b[p + 1 :]), ())}
            b = tuple(w[k : k + n + 1])
            if len(b) == n + 1:  # a word put in
                for p in range(n + 1):
                    out |= {(d, i) for i in whole.get(b[:p] + b[p + 1 :], ())}
    return out


def test_near_passages_of_the_test_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/eval_items.parquet")
    expected = one_edit_pairs([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    plan = leakage.WalkPlan(sampled=1.0)
    out = leakage.find_leaks(docs, "doc_id", "text", items, "item_id", "text", plan).collect()
    got = {(r.doc_id, r.item_id) for r in out}
    assert got <= expected and len(expected) > 20 and len(got) >= plan.recall * len(expected)
    exact = {(r.doc_id, r.item_id) for r in leakage.find_leaks(docs, "doc_id", "text", items, "item_id", "text", leakage.WalkPlan(max_edits=0, walk=2.0, least=12)).collect()}
    assert exact == {(r.doc_id, r.item_id) for r in out if r.edits == 0}
