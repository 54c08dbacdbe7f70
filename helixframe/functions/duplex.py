"""Structures of duplexes from a folding program: brackets of the transcript (5' to 3') and of the query (5' to 3').

``(`` of the transcript pairs with ``)`` of the query, the last with the first; other places are dots.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ENDS = T.StructType().add("target", "string").add("query", "string").add("t_start", "long").add("t_stop", "long")


def _dots(side: str) -> tuple[int, int]:
    """Unpaired places at the beginning and at the end."""
    return len(re.match(r"\.*", side)[0]), len(re.search(r"\.*$", side)[0])


def padded(target: str, query: str, t_start: int, t_stop: int, q_start: int, q_stop: int, q_length: int) -> tuple[str, str, int, int]:
    """The structure over the whole query, with as many places of the transcript beside its unpaired ends; and the transcript's positions."""
    before, after = q_start - 1, q_length - q_stop
    query = "." * before + query + "." * after
    target = "." * after + target + "." * before
    t_start, t_stop = t_start - after, t_stop + before
    # what the query leaves unpaired at an end lies opposite the other end of the transcript
    (t5, t3), (q5, q3) = _dots(target), _dots(query)
    left, right = max(0, q3 - t5), max(0, q5 - t3)
    return "." * left + target + "." * right, query, t_start - left, t_stop + right


def trimmed(target: str, query: str, t_start: int, t_stop: int) -> tuple[str, str, int, int]:
    """Without the unpaired ends of the transcript that go beyond those of the query."""
    (t5, t3), (q5, q3) = _dots(target), _dots(query)
    left, right = max(0, t5 - q3), max(0, t3 - q5)
    return target[left : len(target) - right], query, t_start + left, t_stop - right


def gapped(target: str, query: str, t_seq: str, q_seq: str) -> tuple[str, str, str, str]:
    """Structure and sequences with a gap where a loop is shorter than the one opposite, beside the pair that is nearer to the loop's end inside."""
    opens = [i for i, c in enumerate(target) if c == "("]
    closes = [i for i, c in enumerate(query) if c == ")"][::-1]
    left, right, t_letters, q_letters = [], [], [], []
    t_at, q_at = 0, len(query)
    for i, j in zip(opens, closes):
        up, down = i - t_at, q_at - 1 - j  # unpaired places before this pair on both sides
        gaps = abs(up - down)
        left.append(target[t_at:i] + "-" * (gaps if down > up else 0) + "(")
        t_letters.append(t_seq[t_at:i] + "-" * (gaps if down > up else 0) + t_seq[i])
        right.append(")" + "-" * (gaps if up > down else 0) + query[j + 1 : q_at])
        q_letters.append(q_seq[j] + "-" * (gaps if up > down else 0) + q_seq[j + 1 : q_at])
        t_at, q_at = i + 1, j
    left.append(target[t_at:])
    t_letters.append(t_seq[t_at:])
    right.append(query[:q_at])
    q_letters.append(q_seq[:q_at])
    return "".join(left), "".join(right[::-1]), "".join(t_letters), "".join(q_letters[::-1])


@F.pandas_udf(_ENDS)
def pad_structure(target: pd.Series, query: pd.Series, t_start: pd.Series, t_stop: pd.Series, q_start: pd.Series, q_stop: pd.Series, q_length: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([padded(*x) for x in zip(target, query, t_start, t_stop, q_start, q_stop, q_length)], columns=_ENDS.names)


@F.pandas_udf(_ENDS)
def trim_structure(target: pd.Series, query: pd.Series, t_start: pd.Series, t_stop: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([trimmed(*x) for x in zip(target, query, t_start, t_stop)], columns=_ENDS.names)


@F.pandas_udf(T.StructType().add("target", "string").add("query", "string").add("t_seq", "string").add("q_seq", "string"))
def gap_structure(target: pd.Series, query: pd.Series, t_seq: pd.Series, q_seq: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([gapped(*x) for x in zip(target, query, t_seq, q_seq)], columns=["target", "query", "t_seq", "q_seq"])


def slice_of(t_seq: Column, q_seq: Column, t_stop: Column, at: int = 10) -> Column:
    """Transcript position opposite query base ``at`` of gapped sequences, both 5' to 3'; null if the query is shorter."""
    letters = F.filter(F.split(q_seq, ""), lambda c: c != "")
    counts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(letters), F.lit(1))), lambda i: F.size(F.filter(F.slice(letters, 1, i), lambda c: c != "-")))
    column = F.array_position(counts, F.lit(at)).cast("int")
    beside = F.regexp_replace(F.substring(F.reverse(t_seq), F.lit(1), column), "-", "")
    return F.when(column > 0, t_stop - F.length(beside) + 1)
