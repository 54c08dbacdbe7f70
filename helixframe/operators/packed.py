"""Several values packed in one field: one value per row, with its key and position.

Fields of one column are written in several dialects: which characters part the
pairs, what stands between key and value, what parts the values, whether double
quotes enclose text.  The dialect of a field is chosen by minimum description
length among all dialects that read it differently.

A first pass over all fields counts, under every dialect of each field in equal
shares, how often keys, bytes of values outside and inside quotes, and the events of
the grammar occur: a piece with an inner mark, without one, or blank; another value, an
empty one, or the end of the pair; a quoted or a bare value; quotes that enclose or
are text.  All code lengths come
from these counts: a separator costs what its event costs, and the same character
read as text costs what that byte costs in a value.  A key is spelled out,
or, if it is common, coded as itself after it was spelled once for all of its occurrences.
A second pass counts anew, each field under the dialect that was then the cheapest;
a third one writes out every field by the dialect under which it takes the fewest bits.

Fields are parsed many at a time as arrays of bytes.  The tables sent to the tasks
have a fixed size, whatever the size of the input.  All passes are narrow.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of the buckets that keys are hashed to for their counts. Only a key whose bucket has ``KNOWN`` of all may be coded as itself.
BUCKET_BITS, KNOWN = 12, 2.0**-8
BUCKETS = 1 << BUCKET_BITS
#: Bits of a hash beside its bucket. Each bit is counted for itself, so that the counts add up and show the hash of a bucket's common key.
PRINT_BITS = 20
#: Groups of fewer fields with the same dialects are parsed together, dialect by dialect.
FEW = 200
#: Bytes parsed at once; a longer field is parsed by itself.
PART_BYTES = 4 << 20
#: Share of a field that is divided among its dialects when they are counted.
WHOLE = 5040
#: Events, in the groups of which one occurs at a time.
INNER, NONE, BLANK, NEXT, EMPTY, END, QUOTED, BARE, ENCLOSE, PLAIN = range(10)
_CHOICES = ((INNER, NONE, BLANK), (NEXT, EMPTY, END), (QUOTED, BARE), (ENCLOSE, PLAIN))
_STOP = 0xFF  # after every field; no byte of UTF-8 text
_QUOTE = ord('"')


@dataclass(frozen=True)
class Dialect:
    """Characters that part pairs and values, the mark after the key, and whether quotes enclose."""

    pairs: str
    inner: str
    values: str
    quotes: bool


@dataclass(frozen=True)
class DialectSpace:
    """The candidates. A dialect may use any non-empty set of ``pairs`` and any set of ``values``; marks are ASCII, a space stands for any white space."""

    pairs: str = ";&"
    inner: str = "= "
    values: str = ",|"

    @property
    def marks(self) -> str:
        return self.pairs + self.values + self.inner


@lru_cache(maxsize=4096)
def dialects_of(there: tuple[frozenset[str], frozenset[str] | None], space: DialectSpace) -> tuple[Dialect, ...]:
    """All dialects that read a field differently, by the marks it has outside quotes, and (with quotes in it) anywhere.

    The one that parts most comes first.
    """
    out = []
    for quotes, marks in zip((True, False), there):
        if marks is None:
            continue

        def subsets(chars: str, least: int) -> list[str]:
            own = [c for c in chars if c in marks]
            return ["".join(s) for n in range(len(own), min(least, len(own)) - 1, -1) for s in itertools.combinations(own, n)]

        for inner in [c for c in space.inner if c in marks] or space.inner[0]:
            out += [Dialect(p, inner, v, quotes) for p in subsets(space.pairs, 1) for v in subsets(space.values, 0)]
    return tuple(out)


_ASCII_WHITE = np.array([chr(b).isspace() and b < 128 for b in range(256)])


def _white(data: np.ndarray) -> np.ndarray:
    """Bytes of white space, in any script."""
    out = _ASCII_WHITE[data]
    if ((data >= 0xC2) & (data < _STOP)).any():
        n = len(data)
        a, b, c = data, np.append(data[1:], 0), np.append(data[2:], [0, 0])[:n]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
        three |= (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        for k, starts in ((2, two), (3, three)):
            for at in range(k):
                out[at:] |= starts[: n - at]
    return out


def _upto(values: np.ndarray) -> np.ndarray:
    """Sums before each place, and of all."""
    return np.concatenate([[0], np.cumsum(values)])


@dataclass
class Fields:
    """Fields as bytes, each followed by a stop, and the number of the field of each byte."""

    data: np.ndarray
    of: np.ndarray
    count: int

    @classmethod
    def of_texts(cls, texts: pa.Array) -> Fields:
        """``texts`` without nulls."""
        n = len(texts)
        texts = pa.concat_arrays([texts.cast(pa.large_string())])
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        lengths = np.diff(offsets)
        of = np.repeat(np.arange(n), lengths + 1)
        data = np.full(len(raw) + n, _STOP, np.uint8)
        data[np.arange(len(raw)) + np.repeat(np.arange(n), lengths)] = raw
        return cls(data, of, n)

    def arranged(self, order: np.ndarray) -> Fields:
        """The fields in another order."""
        index, lengths = _stretch(np.where(order > 0, self.stops[order - 1] + 1, 0), self.stops[order])
        return Fields(self.data[index], np.repeat(np.arange(len(order)), lengths), len(order))

    def between(self, first: int, last: int) -> Fields:
        """The fields from number ``first`` up to, not including, ``last``."""
        lo, hi = np.searchsorted(self.of, [first, last])
        return Fields(self.data[lo:hi], self.of[lo:hi] - first, last - first)

    @cached_property
    def stops(self) -> np.ndarray:
        return np.nonzero(self.data == _STOP)[0]

    @cached_property
    def white(self) -> np.ndarray:
        return _white(self.data)

    @cached_property
    def with_quotes(self) -> np.ndarray:
        return np.bincount(self.of[self.data == _QUOTE], minlength=self.count) > 0

    @cached_property
    def sides(self) -> dict[bool, Side]:
        return {quotes: Side(self, quotes) for quotes in (True, False)}

    def kinds(self, space: DialectSpace) -> Iterator[tuple[tuple[Dialect, ...], np.ndarray, Fields]]:
        """The fields in groups that have the same dialects, with their numbers."""
        if not self.count:
            return
        code = np.zeros(self.count, np.int64)
        enclosed = self.sides[True].enclosed
        for k, mark in enumerate(space.marks):
            at = np.nonzero(self.white if mark == " " else self.data == ord(mark))[0]
            for side, own in enumerate((self.of[at[~enclosed[at]]], self.of[at])):
                has = np.zeros(self.count, np.int64)
                has[own] = 1
                code |= has << (2 * k + side)
        code = code << 1 | self.with_quotes
        order = np.argsort(code, kind="stable")
        arranged = self.arranged(order)
        edges = [0, *(np.nonzero(np.diff(code[order]))[0] + 1).tolist(), self.count]
        for first, last in zip(edges, edges[1:]):
            bits = int(code[order[first]])
            has = [frozenset(m for k, m in enumerate(space.marks) if bits >> (1 + 2 * k + side) & 1) for side in (0, 1)]
            yield dialects_of((has[0], has[1] if bits & 1 else None), space), order[first:last], arranged.between(first, last)


#: A number for each byte, and a base for their places; both only spread hashes.
_LETTERS = np.random.default_rng(20240817).integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9FB21C651E98DF25


_POWERS: list[np.ndarray] = []


def _powers(count: int) -> list[np.ndarray]:
    """Powers of the base up to ``count`` at least, and their inverses."""
    if not _POWERS or len(_POWERS[0]) <= count:
        size = 1 << max(20, count.bit_length())
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)]), dtype=np.uint64) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS


class Side:
    """The fields read with, or without, quotes that enclose: what is enclosed, what belongs to the text, and the next places of things."""

    def __init__(self, fields: Fields, quotes: bool) -> None:
        self.fields = fields
        self._lengths = None
        data = fields.data
        self.paired = np.zeros(len(data), bool)
        at = np.nonzero(data == _QUOTE)[0] if quotes else np.zeros(0, np.int64)
        if not len(at):
            self.enclosed, self.kept = self.paired, data != _STOP
            return
        owner = fields.of[at]
        final = np.append(owner[1:] != owner[:-1], True)
        odd = np.bincount(owner, minlength=fields.count) % 2 == 1
        at = at[~(final & odd[owner])]  # a quote left open is text
        self.paired[at] = True
        self.enclosed = (np.cumsum(self.paired, dtype=np.uint8) & 1).astype(bool)
        opening, closing = at[0::2], at[1::2]
        # a doubled quote inside quotes stands for one
        doubled = opening[np.isin(opening - 1, closing, assume_unique=True)]
        self.kept = ~self.paired
        self.kept[doubled] = True
        self.kept[fields.stops] = False

    @cached_property
    def dropped(self) -> np.ndarray:
        """Places of the quotes that enclose and do not stay."""
        return np.nonzero(self.paired & ~self.kept)[0]

    @cached_property
    def kept_upto(self) -> np.ndarray:
        return _upto(self.kept)

    def kept_between(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Bytes of the text in stretches (ends included) within a field."""
        size = last - first + 1
        return size - (np.searchsorted(self.dropped, last, "right") - np.searchsorted(self.dropped, first)) if len(self.dropped) else size

    def first_text(self, at: np.ndarray) -> np.ndarray:
        """The first place from ``at`` on that is no white space."""
        return self._move(at, 1)

    def last_text(self, at: np.ndarray) -> np.ndarray:
        """The last place up to ``at`` that is no white space; -1 without any."""
        return self._move(at, -1)

    def _move(self, at: np.ndarray, step: int) -> np.ndarray:
        white = self.fields.white
        at = at.copy()
        for _ in range(3):
            on = np.nonzero(white[at] & (at >= 0))[0]
            if not len(on):
                return at
            at[on] += step
        return (self._next_text if step > 0 else self._last_text)[at]

    @cached_property
    def _next_text(self) -> np.ndarray:
        n = len(self.fields.white)
        return np.minimum.accumulate(np.where(self.fields.white, n, np.arange(n))[::-1])[::-1]

    @cached_property
    def _last_text(self) -> np.ndarray:
        # one more, so that place -1 gives -1
        return np.append(np.maximum.accumulate(np.where(self.fields.white, -1, np.arange(len(self.fields.white)))), -1)

    def lengths_upto(self, codes: CodeLengths) -> np.ndarray:
        """Bits of the text before each place: bytes inside quotes by the one code, others by the other."""
        if self._lengths is None:
            data = self.fields.data
            self._lengths = _upto(np.where(self.kept, np.where(self.enclosed, codes.quoted[data], codes.bare[data]), 0.0))
        return self._lengths

    @cached_property
    def _hash_upto(self) -> np.ndarray:
        rank = self.kept_upto[:-1]
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(self.kept, _LETTERS[self.fields.data] * _powers(len(rank))[0][rank], np.uint64(0)), dtype=np.uint64)])

    def hash_of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A hash of the text of each stretch (ends included): its bucket, and ``PRINT_BITS`` further bits below."""
        sums = (self._hash_upto[last + 1] - self._hash_upto[first]) * _powers(len(self.kept))[1][self.kept_upto[first]]
        sums ^= sums >> np.uint64(32)
        return (sums * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS - PRINT_BITS)

    @cached_property
    def _places(self) -> dict[str, np.ndarray]:
        return {}

    def places(self, marks: str) -> np.ndarray:
        """Where any of ``marks`` stands outside quotes, in order."""
        if marks not in self._places:
            if len(marks) == 1:
                there = self.fields.white if marks == " " else self.fields.data == ord(marks)
                self._places[marks] = np.nonzero(there & ~self.enclosed)[0]
            else:
                self._places[marks] = np.sort(np.concatenate([self.places(m) for m in marks])) if marks else np.zeros(0, np.int64)
        return self._places[marks]


@dataclass
class Parse:
    """Fields under one dialect: pieces with their keys, and the values of the pieces. Ends are the last byte; a piece without a key ends before it starts."""

    side: Side
    key_from: np.ndarray
    key_to: np.ndarray
    has_inner: np.ndarray
    value_from: np.ndarray
    value_to: np.ndarray
    value_piece: np.ndarray
    empty_piece: np.ndarray  # the piece of each empty value
    blank_field: np.ndarray  # the field of each blank piece
    cut_at: np.ndarray  # the marks between values

    @classmethod
    def by(cls, fields: Fields, d: Dialect) -> Parse:
        side = fields.sides[d.quotes]
        ends = np.sort(np.concatenate([side.places(d.pairs), fields.stops]))
        starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
        s = side.first_text(starts)
        blank = s >= ends
        blank_field = fields.of[ends[blank]]
        s, e = s[~blank], side.last_text(ends[~blank] - 1)

        marks = np.append(side.places(d.inner), len(fields.data))
        mark = marks[np.searchsorted(marks, s)]
        has = mark <= e
        safe = np.where(has, mark, s)
        key_to = np.where(has, np.where(safe > s, side.last_text(np.maximum(safe - 1, 0)), s - 1), e)
        begin = safe + (d.inner != " ")

        pieces = np.nonzero(has)[0]
        first, last, piece = begin[pieces], e[pieces], pieces
        cuts = side.places(d.values)
        if len(cuts) and len(s):
            owner = np.maximum(np.searchsorted(s, cuts, "right") - 1, 0)
            inside = has[owner] & (cuts >= begin[owner]) & (cuts <= e[owner])
            cuts, owner = cuts[inside], owner[inside]
            order = np.argsort(np.concatenate([first, cuts + 1]), kind="stable")
            first, piece = np.concatenate([first, cuts + 1])[order], np.concatenate([piece, owner])[order]
            more = np.append(piece[1:] == piece[:-1], False)[: len(piece)]
            last = np.where(more, np.append(first[1:], 0)[: len(first)] - 2, e[piece])
        else:
            cuts = cuts[:0]
        a = side.first_text(np.minimum(first, len(fields.data) - 1))
        z = side.last_text(np.maximum(last, 0))
        full = (a <= last) & (z >= first)
        a, z = np.where(full, a, 0), np.where(full, z, -1)
        full &= side.kept_between(a, z) > 0
        return cls(side, s, key_to, has, a[full], z[full], piece[full], piece[~full], blank_field, cuts)

    @property
    def piece_field(self) -> np.ndarray:
        return self.side.fields.of[self.key_from]

    @cached_property
    def quoted(self) -> np.ndarray:
        if not len(self.side.dropped):
            return np.zeros(len(self.value_from), bool)
        return self.side.kept_between(self.value_from, self.value_to) <= self.value_to - self.value_from

    @cached_property
    def key_hash(self) -> np.ndarray:
        return self.side.hash_of(self.key_from, self.key_to)

    def strings(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """The stretches as text, without the quotes that enclose."""
        index, lengths = _stretch(first, last)
        kept = self.side.kept[index]
        offsets = _upto(kept)[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.side.fields.data[index[kept]]))).cast(pa.string())


def _stretch(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of stretches (ends included), and their lengths."""
    lengths = last - first + 1
    return np.arange(lengths.sum()) + np.repeat(first - (np.cumsum(lengths) - lengths), lengths), lengths


class Hashed:
    """Counts by bucket, and in it of each further bit of the hashes: the first row and the others."""

    def __init__(self) -> None:
        self.sums = np.zeros((PRINT_BITS + 1, BUCKETS), np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, hashes: np.ndarray, weights: np.ndarray) -> None:
        self.waiting.append((hashes, weights))

    def settle(self) -> None:
        if self.waiting:
            hashes = np.concatenate([h for h, _ in self.waiting]).astype(np.int64)
            weights = np.concatenate([w for _, w in self.waiting])
            self.waiting = []
            bucket = hashes >> PRINT_BITS
            self.sums[0] += np.bincount(bucket, weights, BUCKETS).astype(np.int64)
            for bit in range(PRINT_BITS):
                has = (hashes >> bit & 1).astype(bool)
                self.sums[1 + bit] += np.bincount(bucket[has], weights[has], BUCKETS).astype(np.int64)


class Counts:
    """How often keys, bytes of values outside and inside quotes, and events occur."""

    #: Columns of ``rows``.
    WIDTH = BUCKETS + 256 + 256 + 10

    def __init__(self) -> None:
        self.keys = Hashed()
        self.bare, self.quoted, self.events = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(10, np.int64)

    def add(self, p: Parse, d: Dialect, weight: np.ndarray) -> None:
        """Count what a parse holds; ``weight`` says how much each field counts."""
        fields = p.side.fields
        of_piece = weight[p.piece_field]
        of_value = of_piece[p.value_piece]
        self.keys.add(p.key_hash, of_piece)
        index, lengths = _stretch(p.value_from, p.value_to)
        own = np.repeat(of_value, lengths)
        kept = p.side.kept[index]
        index, own = index[kept], own[kept]
        inside = p.side.enclosed[index]
        self.bare += np.bincount(fields.data[index[~inside]], own[~inside], 256).astype(np.int64)
        self.quoted += np.bincount(fields.data[index[inside]], own[inside], 256).astype(np.int64)
        # a pair has an event for each value, each empty one, and its end
        found = {INNER: of_piece[p.has_inner], NONE: of_piece[~p.has_inner], BLANK: weight[p.blank_field], NEXT: of_value, EMPTY: of_piece[p.empty_piece], END: of_piece,
                 QUOTED: of_value[p.quoted], BARE: of_value[~p.quoted], ENCLOSE if d.quotes else PLAIN: weight[fields.with_quotes]}
        for event, weights in found.items():
            self.events[event] += int(weights.sum())

    def settle(self) -> None:
        self.keys.settle()

    def rows(self) -> np.ndarray:
        """A column for each bucket of keys, then for each byte and event, of which the first row holds the count."""
        self.settle()
        out = np.zeros((PRINT_BITS + 1, self.WIDTH), np.int64)
        out[:, :BUCKETS] = self.keys.sums
        out[0, BUCKETS:] = np.concatenate([self.bare, self.quoted, self.events])
        return out


def _order_bits(fields: Fields, at: np.ndarray, marks: str) -> np.ndarray:
    """Bits that tell which of ``marks`` stand at the places ``at`` of each field: how many of each, and in what order."""
    each = [np.bincount(fields.of[at[fields.data[at] == ord(m)]], minlength=fields.count) for m in marks]
    total = sum(each)
    factorial = _upto(np.log2(np.arange(1, int(total.max(initial=0)) + len(marks))))
    ways = factorial[total + len(marks) - 1] - factorial[total] - factorial[len(marks) - 1]
    return ways + factorial[total] - sum(factorial[n] for n in each)


def readings(fields: Fields, space: DialectSpace) -> Iterator[tuple[Dialect, np.ndarray, Fields, np.ndarray]]:
    """Each dialect with fields that it reads: their numbers, the fields, and how many dialects each has.

    Dialects come in the order in which those of a field stand.
    """
    few: list[tuple[tuple[Dialect, ...], np.ndarray]] = []
    for dialects, chosen, own in fields.kinds(space):
        if len(chosen) < FEW and len(dialects) > 1:
            few.append((dialects, chosen))
            continue
        for d in dialects:
            yield d, chosen, own, np.full(len(chosen), len(dialects))
    if few:
        every = sorted({d for dialects, _ in few for d in dialects}, key=lambda d: _rank(d, space))
        for d in every:
            chosen = np.concatenate([c for dialects, c in few if d in dialects])
            counts = np.concatenate([np.full(len(c), len(dialects)) for dialects, c in few if d in dialects])
            yield d, chosen, fields.arranged(chosen), counts


def _rank(d: Dialect, space: DialectSpace) -> tuple:
    def place(chars: str, of: str) -> tuple:
        return (-len(chars), [of.index(c) for c in chars])

    return (not d.quotes, space.inner.index(d.inner), place(d.pairs, space.pairs), place(d.values, space.values))


def count_dialects(fields: Fields, space: DialectSpace, counts: Counts) -> None:
    """Count all fields under all of their dialects, in equal shares."""
    for d, _, own, many in readings(fields, space):
        counts.add(Parse.by(own, d), d, np.maximum(1, WHOLE // many).astype(float))
    counts.settle()


@dataclass(frozen=True)
class Codebook:
    """Bits of the common key of a bucket, its hash, and how often it occurs; bits of any other key besides its letters."""

    bits: np.ndarray
    print: np.ndarray
    times: np.ndarray
    escape: float

    @classmethod
    def from_counts(cls, sums: np.ndarray) -> Codebook:
        n = sums[0].astype(float)
        share = n / max(n.sum(), 1)
        known = share >= KNOWN
        print_ = ((sums[1:] * 2 > sums[0]).astype(np.int64) << np.arange(PRINT_BITS)[:, None]).sum(axis=0)
        return cls(np.where(known, -np.log2(np.maximum(share, KNOWN)), np.inf), print_, np.maximum(n / WHOLE, 1), -math.log2(max(1 - share[known].sum(), KNOWN)))

    def lengths(self, hashes: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """The shorter way of each: as itself, after it was spelled once for all, or letter by letter."""
        hashes = hashes.astype(np.int64)
        bucket = hashes >> PRINT_BITS
        itself = np.where(self.print[bucket] == hashes & (1 << PRINT_BITS) - 1, self.bits[bucket] + spelled / self.times[bucket], np.inf)
        return np.minimum(itself, self.escape + spelled)


@dataclass(frozen=True)
class CodeLengths:
    """Codes of keys; bits of bytes outside and inside quotes, and of events."""

    keys: Codebook
    bare: np.ndarray
    quoted: np.ndarray
    events: np.ndarray

    @classmethod
    def from_counts(cls, rows: np.ndarray) -> CodeLengths:
        """From the sums of ``Counts.rows``."""
        bare, quoted, events = np.split(rows[0, BUCKETS:].astype(float), [256, 512])

        def bits(n: np.ndarray) -> np.ndarray:
            return -np.log2((n + WHOLE / 2) / (n.sum() + len(n) * WHOLE / 2))

        of_event = np.zeros(10)
        for group in _CHOICES:
            of_event[list(group)] = bits(events[list(group)])
        return cls(Codebook.from_counts(rows[:, :BUCKETS]), bits(bare), bits(quoted), of_event)

    @classmethod
    def uniform(cls) -> CodeLengths:
        """No key known, and every byte and event of a group as likely as any other."""
        events = np.zeros(10)
        for group in _CHOICES:
            events[list(group)] = math.log2(len(group))
        none = Codebook(np.full(BUCKETS, np.inf), np.zeros(BUCKETS, np.int64), np.ones(BUCKETS), 0.0)
        return cls(none, np.full(256, 8.0), np.full(256, 8.0), events)

    def bits(self, p: Parse, d: Dialect) -> np.ndarray:
        """Length of each field."""
        fields, event = p.side.fields, self.events
        text = p.side.lengths_upto(self)
        key = self.keys.lengths(p.key_hash, text[p.key_to + 1] - text[p.key_from] + event[END])
        value = text[p.value_to + 1] - text[p.value_from] + np.where(p.quoted, event[QUOTED], event[BARE])
        out = np.bincount(p.piece_field, key + np.where(p.has_inner, event[INNER], event[NONE]) + event[END], fields.count)
        out += np.bincount(p.piece_field[p.value_piece], value + event[NEXT], fields.count)
        out += np.bincount(p.piece_field[p.empty_piece], minlength=fields.count) * event[EMPTY]
        out += np.bincount(p.blank_field, minlength=fields.count) * event[BLANK]
        out += fields.with_quotes * (event[ENCLOSE] if d.quotes else event[PLAIN])
        if len(d.pairs) > 1:
            out += _order_bits(fields, p.side.places(d.pairs), d.pairs)
        if len(d.values) > 1:
            out += _order_bits(fields, p.cut_at, d.values)
        return out


def cheapest(fields: Fields, codes: CodeLengths, space: DialectSpace) -> Iterator[tuple[Dialect, np.ndarray, Fields]]:
    """Each dialect with the fields for which it is the cheapest; the first of equals."""
    best, least = np.full(fields.count, -1), np.full(fields.count, np.inf)
    dialects: list[Dialect] = []
    for d, chosen, own, many in readings(fields, space):
        if many[0] == 1:
            yield d, chosen, own
            continue
        bits = codes.bits(Parse.by(own, d), d)
        better = bits < least[chosen] - 1e-6
        best[chosen[better]], least[chosen[better]] = len(dialects), bits[better]
        dialects.append(d)
    order = np.argsort(best, kind="stable")
    edges = np.searchsorted(best[order], np.arange(len(dialects) + 1))
    by_dialect: dict[Dialect, list[np.ndarray]] = {}
    for k, d in enumerate(dialects):
        if edges[k] < edges[k + 1]:
            by_dialect.setdefault(d, []).append(order[edges[k] : edges[k + 1]])
    for d, parts in by_dialect.items():
        mine = np.concatenate(parts)
        yield d, mine, fields.arranged(mine)


def count_cheapest(fields: Fields, codes: CodeLengths, space: DialectSpace, counts: Counts) -> None:
    """Count all fields under their cheapest dialects."""
    for d, chosen, own in cheapest(fields, codes, space):
        counts.add(Parse.by(own, d), d, np.full(len(chosen), float(WHOLE)))
    counts.settle()


def values_of(fields: Fields, codes: CodeLengths, space: DialectSpace) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]]:
    """(field, position, key, value) of all values, in parts that hold whole fields."""
    for d, chosen, parts in cheapest(fields, codes, space):
        p = Parse.by(parts, d)
        own = p.piece_field[p.value_piece]
        begins = np.searchsorted(own, np.arange(len(chosen)))
        position = np.arange(len(own)) - begins[own] + 1
        keys = p.strings(p.key_from, p.key_to).take(pa.array(p.value_piece))
        yield chosen[own], position.astype(np.int32), keys, p.strings(p.value_from, p.value_to)


def _fields_in(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Fields]]:
    """The rows of a batch whose last column is not empty, and their fields, some megabytes at a time. Null, blank and a lone dot hold no value."""
    text = batch.column(batch.num_columns - 1)
    core = pc.utf8_trim_whitespace(text)
    rows = pc.indices_nonzero(pc.fill_null(pc.and_(pc.not_equal(core, ""), pc.not_equal(core, ".")), False))
    upto = _upto(pc.binary_length(text.take(rows)).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + PART_BYTES, "right")) - 1)
        part = rows.slice(at, end - at)
        yield part, Fields.of_texts(text.take(part))
        at = end


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to some megabytes, since much of the work is done once a batch."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size >= PART_BYTES:
            yield pa.concat_batches(waiting)
            waiting, size = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


def _codes_by(df: DataFrame, column: str, count: Callable[[Fields, Counts], None]) -> CodeLengths:
    """Code lengths from the counts of a pass over all fields; the driver receives a fixed number of sums."""
    names = [f"n{i}" for i in range(PRINT_BITS + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in _together(batches):
            for _, fields in _fields_in(batch):
                count(fields, counts)
        own = counts.rows()
        at = np.nonzero(own[0])[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(own[i, at]) for i in range(PRINT_BITS + 1)]], names=["code", *names])

    each = df.select(F.col(f"`{column}`").cast("string").alias("t")).mapInArrow(run, "code int, " + ", ".join(f"{n} bigint" for n in names))
    sums = each.groupBy("code").agg(*[F.sum(F.col(n).cast("decimal(38,0)")).cast("double").alias(n) for n in names]).toArrow()
    rows = np.zeros((PRINT_BITS + 1, Counts.WIDTH))
    for i, n in enumerate(names):
        rows[i, sums.column("code").to_numpy()] = sums.column(n).to_numpy()
    return CodeLengths.from_counts(rows)


def learn_codes(df: DataFrame, column: str, space: DialectSpace = DialectSpace()) -> CodeLengths:
    """The first two passes: code lengths from all fields of ``column``. Runs two jobs."""
    first = _codes_by(df, column, lambda fields, counts: count_dialects(fields, space, counts))
    return _codes_by(df, column, lambda fields, counts: count_cheapest(fields, first, space, counts))


def unpack_values(df: DataFrame, column: str, keep: list[str], space: DialectSpace = DialectSpace(), codes: CodeLengths | None = None) -> DataFrame:
    """``keep`` + ``value_pos``, ``attr_key``, ``attr_value``: a row per value of ``df[column]``.

    ``codes`` is what ``learn_codes`` returned; without it these passes run when
    this is called.  ``value_pos`` counts the values of a field from 1 across its keys.
    Defined cases: a null, blank or lone-dot field and an empty value give no row and
    no position; a key may occur again; an unclosed quote is plain text; a pair
    without a mark after the key has no value; an empty table gives none; repeated
    rows give repeated values; fields may be of any length.
    """
    codes = codes or learn_codes(df, column, space)
    shared = df.sparkSession.sparkContext.broadcast(codes)  # fixed size, see BUCKETS
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{column}`").cast("string").alias("t"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("p", T.IntegerType()), T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _together(batches):
            for rows, fields in _fields_in(batch):
                for of, position, key, value in values_of(fields, shared.value, space):
                    taken = rows.take(pa.array(of))
                    yield pa.RecordBatch.from_arrays([*[c.take(taken) for c in batch.columns[:-1]], pa.array(position), key, value], names=[f.name for f in schema.fields])

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("p").alias("value_pos"), F.col("k").alias("attr_key"), F.col("v").alias("attr_value"))
