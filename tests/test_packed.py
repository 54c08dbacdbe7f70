import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.operators import packed

SPACE = packed.DialectSpace()


def written(rng):
    """A field in some style, and its keys and values."""
    word = lambda: "V%dG%05d" % (rng.randint(1, 5), rng.randrange(10**5))
    pairs = [(k, [word() for _ in range(rng.randint(1, 4) if k in ("Alias", "Dbxref") else 1)]) for k in rng.sample(["ID", "Parent", "Name", "Alias", "Dbxref"], rng.randint(2, 4))]
    if rng.random() < 0.4:
        pairs.insert(1, ("Note", [rng.choice(["low, medium; high %d", "carrier (Na+, K+) %d", "a|b hydrolase %d", "R&D locus %d", 'so ""called"" %d', "protein of type %d"]) % rng.randrange(999)]))
    all_quoted, equals = rng.random() < 0.4, rng.random() < 0.7
    between, within = rng.choice([";", "; ", " ; ", "&", ";\t"]), rng.choice([",", ", ", "|"])

    def value(v):
        return f'"{v}"' if all_quoted or not equals or any(c in v for c in ',;|&"') or rng.random() < 0.05 else v

    text = between.join(k + ("=" if equals else " ") + within.join(map(value, vs)) for k, vs in pairs)
    return text + rng.choice(["", "", ";"]), [(k, v.replace('""', '"')) for k, vs in pairs for v in vs]


CORPUS = [written(random.Random(i)) for i in range(4000)]
FIELDS = [text for text, _ in CORPUS]


def learned(texts):
    counts = packed.Counts()
    packed.count_dialects(packed.Fields.of_texts(pa.array(texts)), SPACE, counts)
    first = packed.CodeLengths.from_counts(counts.rows())
    counts = packed.Counts()
    packed.count_cheapest(packed.Fields.of_texts(pa.array(texts)), first, SPACE, counts)
    return packed.CodeLengths.from_counts(counts.rows())


CODES = learned(FIELDS)


def unpacked(texts, codes=CODES):
    out = [[] for _ in texts]
    for of, position, keys, values in packed.values_of(packed.Fields.of_texts(pa.array(texts)), codes, SPACE):
        for i, p, k, v in zip(of.tolist(), position.tolist(), keys.to_pylist(), values.to_pylist()):
            out[i].append((k, v))
            assert p == len(out[i])
    return out


def flat(text):
    return unpacked([text])[0]


# a parser of one field under one dialect, letter by letter

def plain(text, quotes):
    text = text.strip()
    return re.sub(r'"((?:[^"]|"")*)"', lambda m: m[1].replace('""', '"'), text) if quotes else text


def split(text, marks, quotes):
    out, at, inside, final = [""], 0, False, text.rfind('"') if text.count('"') % 2 else -1
    for i, c in enumerate(text):
        if quotes and c == '"' and i != final:
            inside = not inside
        if c in marks and not inside and marks:
            out.append("")
        else:
            out[-1] += c
    return out


def by_letters(text, d):
    out = []
    for piece in split(text, d.pairs, d.quotes):
        piece = piece.strip()
        head = split(re.sub(r"\s", " ", piece) if d.inner == " " else piece, d.inner, d.quotes)[0]
        if piece and len(head) < len(piece):
            rest = piece[len(head) :] if d.inner == " " else piece[len(head) + 1 :]
            out += [(plain(piece[: len(head)], d.quotes), plain(v, d.quotes)) for v in split(rest, d.values, d.quotes) if plain(v, d.quotes)]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='ab ;&,|="\t\u00a0\u2003\u00e9', min_size=1, max_size=24).filter(lambda t: t.strip() not in ("", ".") and (t.count('"') % 2 == 0 or not re.search('"[^"]*$', t))), min_size=1, max_size=6))
def test_every_dialect_against_a_parser_by_letters(texts):
    fields = packed.Fields.of_texts(pa.array(texts))
    for dialects, chosen, own in fields.kinds(SPACE):
        for d in dialects:
            p = packed.Parse.by(own, d)
            keys, values = p.strings(p.key_from, p.key_to).to_pylist(), p.strings(p.value_from, p.value_to).to_pylist()
            got = [[] for _ in range(own.count)]
            for piece, value in zip(p.value_piece.tolist(), values):
                got[int(p.piece_field[piece])].append((keys[piece], value))
            assert got == [by_letters(texts[i], d) for i in chosen.tolist()], d


def test_learned_lengths_read_what_uniform_ones_cannot():
    wrong = lambda codes: sum(got != right for got, (_, right) in zip(unpacked(FIELDS, codes), CORPUS))
    # what is left reads better as a pair of its own ('Note "low, medium; high 7"' where the key is parted by a space)
    assert wrong(CODES) <= 20 and wrong(packed.CodeLengths.uniform()) > 4 * wrong(CODES)


def test_the_same_mark_may_be_text_or_part_values():
    listed = ["ID=a%d,w%d" % (i, i) for i in range(400)]
    assert unpacked(["ID=a1,w2"], learned(listed))[0] == [("ID", "a1"), ("ID", "w2")]
    # here a piece after & is no pair
    names = ["ID=v%d;Note=unit R&D %d;Name=n%d" % (i, i, i) for i in range(400)]
    assert unpacked(["ID=v1;Note=unit R&D 7;Name=n1"], learned(names))[0] == [("ID", "v1"), ("Note", "unit R&D 7"), ("Name", "n1")]


def test_styles():
    assert flat("ID=a & Parent=b;\tNote=x y") == [("ID", "a"), ("Parent", "b"), ("Note", "x y")]
    assert flat('Note="low, medium; high";Alias=A,B|C') == [("Note", "low, medium; high"), ("Alias", "A"), ("Alias", "B"), ("Alias", "C")]
    assert flat("Alias=A, B ,,C;;Name=") == [("Alias", "A"), ("Alias", "B"), ("Alias", "C")]
    assert flat('ID = "a" ; Note = "say ""x"""') == [("ID", "a"), ("Note", 'say "x"')]
    assert flat('ID "a";Note kinase family protein') == [("ID", "a"), ("Note", "kinase family protein")]
    assert flat('Comment "";ID "a"') == [("ID", "a")]
    assert flat("Note= it's 5' of http://a/b-c%20d") == [("Note", "it's 5' of http://a/b-c%20d")]


def test_an_unclosed_quote_is_text():
    assert flat('Note=5" stem;ID=a')[-1] == ("ID", "a")


def test_table_with_odd_rows(spark):
    df = spark.createDataFrame(
        [(1, "ID=a;Parent=b,c", 0), (2, None, 0), (3, ".", 0), (4, "", 0), (5, "  ", 0), (1, "ID=a;Parent=b,c", 0), (6, "ID=" + "x" * 100_000, 0)],
        "attr_key long, attributes string, v int",
    )
    rows = packed.unpack_values(df.repartition(3), "attributes", ["attr_key"]).toDF("id", "pos", "k", "v").collect()
    assert sorted(tuple(r)[:3] for r in rows) == sorted([(1, 1, "ID"), (1, 2, "Parent"), (1, 3, "Parent")] * 2 + [(6, 1, "ID")])
    assert packed.unpack_values(df.limit(0), "attributes", ["attr_key"]).count() == 0


def test_all_counts_and_values_of_a_table(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(FIELDS)], "id long, t string")
    codes = packed.learn_codes(df.repartition(5), "t")
    assert np.allclose(codes.events, CODES.events) and np.allclose(codes.bare, CODES.bare)
    rows = packed.unpack_values(df.repartition(3), "t", ["id"], codes=codes).collect()
    expected = [(i, n, k, v) for i, own in enumerate(unpacked(FIELDS)) for n, (k, v) in enumerate(own, 1)]
    assert sorted(tuple(r) for r in rows) == expected
