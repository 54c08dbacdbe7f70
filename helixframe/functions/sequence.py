"""Sequence functions as column expressions; Arrow functions only where a scan is inherently sequential."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# IUPAC nucleotide codes.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGTURYSWKMBDHVN", "TGCAAYRSWMKVHDBN"
# The standard genetic code, codons in the order TTT, TTC, TTA, TTG, TCT, ...
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {"".join(c): CODE[i] for i, c in enumerate(itertools.product("TCAG", repeat=3))}


def complement(s: Column) -> Column:
    return F.translate(F.upper(s), COMPLEMENT_FROM, COMPLEMENT_TO)


def revcomp(s: Column) -> Column:
    """Reverse complement over IUPAC codes; U is read as T."""
    return F.reverse(complement(s))


def iupac_regex(motif: str) -> str:
    """A regular expression for an IUPAC motif."""
    return "".join(c if len(IUPAC[c]) == 1 and c != "U" else "[" + IUPAC[c] + "]" for c in motif.upper())


def all_kmers(k: int, alphabet: str = "ACGT") -> list[str]:
    return ["".join(t) for t in itertools.product(alphabet, repeat=k)]


def _starts(s: Column, k: int, step: int = 1) -> Column:
    """1-based starts of windows of ``k``; none if the text is shorter."""
    return F.when(F.length(s) >= k, F.sequence(F.lit(1), F.length(s) - k + 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def kmers(s: Column, k: int) -> Column:
    """All k-mers of a sequence, in order, in one pass over it."""
    return F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def codon_table() -> dict[str, str]:
    """Codons, also those with ambiguous codes that have one meaning."""
    out = {}
    for t in itertools.product("ACGTRYSWKMBDHVN", repeat=3):
        meanings = {CODONS["".join(c)] for c in itertools.product(*(IUPAC[x] for x in t))}
        if len(meanings) == 1:
            out["".join(t)] = meanings.pop()
    return out


def translate_codons(s: Column) -> Column:
    """Amino acids of frame 1; unknown codons are X, stops are ``*``, a rest under three letters is left off."""
    text = F.translate(F.upper(s), "U", "T")
    table = F.create_map(*[F.lit(x) for kv in codon_table().items() for x in kv])
    codons = F.regexp_extract_all(text, F.lit("(?s).{3}"), F.lit(0))
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.element_at(table, c), F.lit("X"))), "")


def degeneracy(s: Column) -> Column:
    """How many bases each position may be."""
    table = F.create_map(*[x for k, v in IUPAC.items() for x in (F.lit(k), F.lit(len(v)))])
    return F.transform(_starts(s, 1), lambda i: F.coalesce(F.element_at(table, F.upper(F.substring(s, i, F.lit(1)))), F.lit(0)))


def mismatches(s: Column, start: Column, motif: str) -> Column:
    """Positions from ``start`` (1-based) that do not fit the IUPAC motif."""
    misses = []
    for k, code in enumerate(motif.upper()):
        base = F.substring(s, start + k, F.lit(1))
        misses.append(F.when(base.isin(*IUPAC[code]), 0).otherwise(1))
    return reduce(lambda a, b: a + b, misses)


def motif_hits(s: Column, motif: str, most: int) -> Column:
    """0-based starts, overlapping ones too, where the motif fits with at most ``most`` substitutions."""
    hit = F.filter(_starts(s, len(motif)), lambda i: mismatches(s, i, motif) <= most)
    return F.transform(hit, lambda i: i - 1)


def motif_hits_both(s: Column, motif: str, most: int) -> Column:
    """``at`` (0-based) and ``strand`` of the hits of the motif (+) and of its reverse complement (-); one a span and strand."""
    back = motif.upper()[::-1].translate(str.maketrans(COMPLEMENT_FROM, COMPLEMENT_TO))

    def on(m: str, strand: str) -> Column:
        return F.transform(motif_hits(s, m, most), lambda i: F.struct(i.alias("at"), F.lit(strand).alias("strand")))

    return F.concat(on(motif, "+"), on(back, "-"))


def gc_content(s: Column) -> Column:
    return F.length(F.regexp_replace(F.upper(s), "[^GC]", "")) / F.nullif(F.length(s), F.lit(0))


def shuffle_sequence(s: Column, seed: int | Column) -> Column:
    """A random permutation of the letters, the same on every run for the same seed and letters."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    letters = F.split(s, "")
    keyed = F.transform(_starts(s, 1), lambda i: F.struct(F.md5(F.concat_ws("|", seed.cast("string"), s, i)).alias("k"), F.substring(s, i, F.lit(1)).alias("c")))
    return F.when(F.size(letters) > 0, F.array_join(F.transform(F.array_sort(keyed), lambda x: x["c"]), ""))


def which(array: Column, value: Column) -> Column:
    """0-based places of an array where ``value`` stands; none for a null array."""
    return _places(array, lambda x: x.eqNullSafe(value))


def notwhich(array: Column, value: Column) -> Column:
    """0-based places of an array where something else than ``value`` stands."""
    return _places(array, lambda x: ~x.eqNullSafe(value))


def _places(array: Column, holds: Callable[[Column], Column]) -> Column:
    marked = F.transform(F.coalesce(array, F.array()), lambda x, i: F.when(holds(x), i))
    return F.filter(marked, lambda i: i.isNotNull())


# --- alignments ----------------------------------------------------------------------------------

def cigar_ops(cigar: Column) -> Column:
    """Array of (n, op)."""
    tokens = F.regexp_extract_all(cigar, F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    return F.transform(tokens, lambda t: F.struct(F.substring(t, F.lit(1), F.length(t) - 1).cast("bigint").alias("n"), F.substring(t, -1, 1).alias("op")))


def cigar_segments(pos: Column, cigar: Column) -> Column:
    """Covered segments (start, end), half-open, from ``pos``: M, = and X cover; N and D advance; the rest does neither."""
    zero = F.struct(pos.cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        covers = x["op"].isin("M", "=", "X")
        end = F.when(covers | x["op"].isin("N", "D"), acc["at"] + x["n"]).otherwise(acc["at"])
        own = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(covers, F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(cigar_ops(cigar), zero, step, lambda acc: acc["out"])


def cigar_junctions(pos: Column, cigar: Column) -> Column:
    """Introns as (first base, last base), in the coordinates of ``pos``."""
    zero = F.struct(pos.cast("bigint").alias("at"), F.array().cast("array<struct<left:bigint,right:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = F.when(x["op"].isin("M", "=", "X", "N", "D"), acc["at"] + x["n"]).otherwise(acc["at"])
        own = F.array(F.struct(acc["at"].alias("left"), (end - 1).alias("right")))
        return F.struct(end.alias("at"), F.when(x["op"] == "N", F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(cigar_ops(cigar), zero, step, lambda acc: acc["out"])


def covered_positions(segments: Column) -> Column:
    return F.flatten(F.transform(F.filter(segments, lambda x: x["start"] < x["end"]), lambda x: F.sequence(x["start"], x["end"] - 1)))


def softclip(cigar: Column, side: str) -> Column:
    """Clipped bases at the left or right end."""
    return F.coalesce(F.nullif(F.regexp_extract(cigar, "^([0-9]+)S" if side == "left" else "([0-9]+)S$", 1), F.lit("")).cast("int"), F.lit(0))


def softclip_bases(cigar: Column, seq: Column) -> Column:
    """Clipped bases at both ends, in genome order: ``left`` and ``right``, empty without any."""
    left, right = softclip(cigar, "left"), softclip(cigar, "right")
    return F.struct(F.substring(seq, F.lit(1), left).alias("left"), F.when(right > 0, F.substring(seq, F.length(seq) - right + 1, right)).otherwise("").alias("right"))


def softclip_positions(cigar: Column, seq: Column, segments: Column) -> Column:
    """A row a clipped base: its genome position if the read went on without a gap, and the base."""
    clips = softclip_bases(cigar, seq)
    first, last = F.element_at(segments, 1)["start"], F.element_at(segments, -1)["end"]

    def placed(text: Column, begin: Column) -> Column:
        return F.transform(_starts(text, 1), lambda i: F.struct((begin + i - 1).cast("bigint").alias("pos"), F.substring(text, i, F.lit(1)).alias("base")))

    return F.concat(placed(clips["left"], first - F.length(clips["left"])), placed(clips["right"], last))


# Names of the bits of an alignment's flag, from the lowest.
FLAG_BITS = ["paired", "proper", "unmapped", "mate_unmapped", "reverse", "mate_reverse", "first", "second", "secondary", "qc_fail", "duplicate", "supplementary"]


def flag_bits(flag: Column) -> Column:
    """A struct of booleans."""
    return F.struct(*[(flag.bitwiseAND(F.lit(1 << i)) != 0).alias(n) for i, n in enumerate(FLAG_BITS)])


# --- small-RNA duplexes --------------------------------------------------------------------------
# ``query`` runs 5' to 3', ``target`` beside it 3' to 5'; gaps are ``-``; letters are RNA.

def _columns(query: Column, target: Column) -> Column:
    """Array of (q, t, p): letters and the query position of each column."""
    zero = F.struct(F.lit(0).alias("p"), F.array().cast("array<struct<q:string,t:string,p:int>>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        q, t = F.substring(query, i, F.lit(1)), F.substring(target, i, F.lit(1))
        p = F.when(q == "-", acc["p"]).otherwise(acc["p"] + 1)
        return F.struct(p.alias("p"), F.concat(acc["out"], F.array(F.struct(q.alias("q"), t.alias("t"), p.alias("p")))).alias("out"))

    return F.aggregate(_starts(query, 1), zero, step, lambda acc: acc["out"])


def _pair(q: Column, t: Column) -> Column:
    return F.concat(q, t)


def allen_score(query: Column, target: Column) -> Column:
    """Mismatches, gaps and bulges 1 and G:U pairs 0.5, doubled at query positions 2 to 12."""
    def cost(x: Column) -> Column:
        pair = _pair(x["q"], x["t"])
        base = F.when(pair.isin("AU", "UA", "GC", "CG"), 0.0).when(pair.isin("GU", "UG"), 0.5).otherwise(1.0)
        return base * F.when((x["p"] >= 2) & (x["p"] <= 12), 2.0).otherwise(1.0)

    return F.aggregate(_columns(query, target), F.lit(0.0), lambda acc, x: acc + cost(x))


def slice_site(query: Column, target: Column, t_stop: Column, at: int = 10) -> Column:
    """Transcript position opposite query base ``at``; ``t_stop`` is the position opposite base 1."""
    before = F.filter(_columns(query, target), lambda x: (x["p"] <= at) & (x["t"] != "-"))
    return (t_stop - F.size(before) + 1).cast("bigint")


def duplex_ok(query: Column, target: Column) -> Column:
    """Equal lengths, RNA letters or gaps only, and no column of two gaps."""
    return (F.length(query) == F.length(target)) & query.rlike("^[ACGU-]+$") & target.rlike("^[ACGU-]+$") & ~F.exists(_columns(query, target), lambda x: (x["q"] == "-") & (x["t"] == "-"))


def pairing(query: Column, target: Column) -> Column:
    """A letter a column: ``|`` pair, ``o`` G:U, ``x`` mismatch, ``b`` bulge of the target, ``g`` gap of it."""
    def mark(x: Column) -> Column:
        pair = _pair(x["q"], x["t"])
        return (F.when(pair.isin("AU", "UA", "GC", "CG"), "|").when(pair.isin("GU", "UG"), "o").when(x["q"] == "-", "b").when(x["t"] == "-", "g").otherwise("x"))

    return F.array_join(F.transform(_columns(query, target), mark), "")


def pairing_regions(query: Column, target: Column) -> Column:
    """Maximal unpaired stretches (start, end, kind) in columns from 1: UP5 and UP3 at the ends, SIL for equal loops, AILq or AILt for unequal ones, BULq or BULt for bulges."""
    marks = F.translate(pairing(query, target), "o", "|")
    n = F.length(marks)
    starts = F.filter(_starts(marks, 1), lambda i: (F.substring(marks, i, F.lit(1)) != "|") & ((i == 1) | (F.substring(marks, i - 1, F.lit(1)) == "|")))

    def region(i: Column) -> Column:
        rest = F.regexp_extract(F.substring(marks, i, n), "^[^|]+", 0)
        end = i + F.length(rest) - 1
        q, t = F.length(F.regexp_replace(rest, "b", "")), F.length(F.regexp_replace(rest, "g", ""))
        kind = (F.when(i == 1, "UP5").when(end == n, "UP3").when(q == t, "SIL").when(t == 0, "BULq").when(q == 0, "BULt").when(q > t, "AILq").otherwise("AILt"))
        return F.struct(i.alias("start"), end.alias("end"), kind.alias("kind"))

    return F.transform(starts, region)


# --- Arrow functions -----------------------------------------------------------------------------

def _ranks(text: str) -> np.ndarray:
    """Place of each suffix in sorted order, by doubling the compared length."""
    n = len(text)
    rank = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True)[1].astype(np.int64)
    k = 1
    while n > 1:
        after = np.full(n, -1, np.int64)
        after[: n - k] = rank[k:] if k < n else 0
        order = np.lexsort((after, rank))
        step = (np.diff(rank[order]) != 0) | (np.diff(after[order]) != 0)
        rank[order] = np.concatenate([[0], np.cumsum(step)])
        if rank.max() == n - 1 or k >= n:
            break
        k *= 2
    return rank


def lcp_array(text: str) -> np.ndarray:
    """Lengths of the common prefixes of neighbouring sorted suffixes (n - 1 values)."""
    n = len(text)
    if n < 2:
        return np.zeros(0, np.int64)
    rank = _ranks(text)
    suffix = np.argsort(rank)
    out, h = np.zeros(n, np.int64), 0
    for i in range(n):  # prefixes shrink by one letter at most from one suffix to the next
        if rank[i]:
            j = suffix[rank[i] - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            out[rank[i]] = h
            h = max(h - 1, 0)
        else:
            h = 0
    return out[1:]


def i_complexity(text: str, alphabet: int = 5) -> float:
    """Sum of log(l + 2) - log(l + 1) to base ``alphabet`` over 0 and the common prefixes."""
    if not text:
        return 0.0
    lcp = np.concatenate([[0], lcp_array(text)])
    return round(float(np.sum(np.log((lcp + 2) / (lcp + 1))) / math.log(alphabet)), 4)


def suffix_order(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Begins of the suffixes in sorted order, and the common prefix of each with the one before (0 for the first)."""
    lcp = np.concatenate([[0], lcp_array(text)]) if text else np.zeros(0, np.int64)
    return np.argsort(_ranks(text)) if text else np.zeros(0, np.int64), lcp


def _longest_later(text: str) -> list[int]:
    """Per position the longest text from there on that begins again at a later position.

    Among sorted suffixes the nearest later one on each side has the longest common prefix; a stack finds it.
    """
    order, lcp = suffix_order(text)
    best = [0] * len(text)
    for way in (range(len(order)), range(len(order) - 1, -1, -1)):
        stack: list[tuple[int, int]] = []  # begins that fall from the bottom up, with the common prefix to the one below
        before = None
        for k in way:
            if before is not None:
                shared = int(lcp[max(k, before)])
            else:
                shared = 0
            i = int(order[k])
            while stack and stack[-1][0] < i:
                shared = min(shared, stack.pop()[1])
            if stack:
                best[i] = max(best[i], shared)
            stack.append((i, shared))
            before = k
    return best


def repetitions(text: str) -> tuple[list[int], list[int]]:
    """Per position the longest text that begins there and begins again later (F), and the longest that ends there and has ended before (B)."""
    return _longest_later(text), _longest_later(text[::-1])[::-1]


def repeated_prefixes(text: str) -> list[str]:
    """The common prefix of each sorted suffix with the one before."""
    order, lcp = suffix_order(text)
    return [text[i : i + n] for i, n in zip(order.tolist(), lcp.tolist())]


def longest_repeats(text: str, which_: str = "F") -> list[str]:
    """The longest repeated stretches, by their begins (F) or their ends (B)."""
    forward, backward = repetitions(text)
    if which_ == "F":
        top = max(forward, default=0)
        return [text[i : i + n] for i, n in enumerate(forward) if n == top]
    top = max(backward, default=0)
    return [text[i - n + 1 : i + 1] for i, n in enumerate(backward) if n == top]


def ideal_profile(length: int, alphabet: int) -> list[int]:
    """Sorted common prefixes of a text of this length that repeats as little as an alphabet allows."""
    out, k = [], 0
    for i in range(length):
        if i >= alphabet ** (k + 1) + k:
            k += 1
        out.append(k)
    return out


def substrings_of(s: Column, k: int) -> Column:
    """Number of different substrings of length ``k``."""
    return F.size(F.array_distinct(kmers(s, k)))


def simplify(s: Column, keep_digits: bool = True) -> Column:
    """Lower case without punctuation and white space; without digits on demand."""
    drop = r"[.':,\-;_!/\"\n\t*()?{}\[\]#@%$ " + ("" if keep_digits else "0-9") + "]"
    return F.lower(F.regexp_replace(s, drop, ""))


def plain_bases(s: Column) -> Column:
    """Ambiguous bases W, S, K, D, M, R and Y as N, without spaces."""
    return F.regexp_replace(F.translate(s, "WSKDMRY", "NNNNNNN"), " ", "")


def distinct_substrings(text: str) -> int:
    """Number of different non-empty substrings."""
    n = len(text)
    return n * (n + 1) // 2 - int(lcp_array(text).sum())


@F.pandas_udf(T.DoubleType())
def icomplexity(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else i_complexity(x))


@F.pandas_udf(T.LongType())
def substring_count(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else distinct_substrings(x))


def orf_of(text: str) -> tuple[str, int, int, bool]:
    """(amino acids, start, end, no stop) of the longest reading frame from M; the first of equals; it may run off the end."""
    best = ("", 0, 0, False)
    text = text.upper().replace("U", "T")
    for frame in range(3):
        protein = "".join(CODONS.get(text[i : i + 3], "X") for i in range(frame, len(text) - 2, 3))
        at = 0
        for part in protein.split("*"):
            m = part.find("M")
            if m >= 0 and len(part) - m > len(best[0]):
                start = frame + 3 * (at + m)
                open_ = at + len(part) >= len(protein)
                best = (part[m:], start, frame + 3 * (at + len(part)) + (0 if open_ else 3), open_)
            at += len(part) + 1
    return best


@F.pandas_udf(T.StructType().add("aa", "string").add("start", "integer").add("end", "integer").add("stopless", "boolean"))
def longest_orf(s: pd.Series) -> pd.DataFrame:
    rows = [orf_of(x or "") for x in s]
    return pd.DataFrame(rows, columns=["aa", "start", "end", "stopless"])


@F.pandas_udf(T.StructType().add("mapped", T.ArrayType(T.IntegerType())).add("untemplated", "string"))
def rescue_softclip(clip: pd.Series, genome: pd.Series, side: pd.Series) -> pd.DataFrame:
    """Clipped bases from the mapped end outwards that equal the genome join the read until the first that does not.

    ``clip`` and ``genome`` are given in genome order; ``side`` is left or right.
    """
    rows = []
    for c, g, s in zip(clip, genome, side):
        c, g = c or "", g or ""
        order = range(len(c) - 1, -1, -1) if s == "left" else range(len(c))
        kept: list[int] = []
        for i in order:
            if i >= len(g) or c[i] != g[i]:
                break
            kept.append(i)
        rest = "".join(c[i] for i in range(len(c)) if i not in set(kept))
        rows.append((sorted(kept), rest))
    return pd.DataFrame(rows, columns=["mapped", "untemplated"])


def register(spark) -> None:
    """The Arrow functions under SQL names."""
    spark.udf.register("icomplexity", icomplexity)
    spark.udf.register("substring_count", substring_count)
    spark.udf.register("longest_orf", longest_orf)
