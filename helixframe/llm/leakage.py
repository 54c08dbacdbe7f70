"""Evaluation passages in a corpus: which documents hold them, and of which items.

An item is cut into windows of a set number of words; a shorter item is one window
of its own size.  Every word of the corpus is the first, and the last, word of a
passage that may be such a window with a few words put in, left out or changed.

A CGK random walk copies a passage to a string of a set number of steps: at each step it writes the word it stands on and then stays or moves on, by
a random bit of step and word.  Passages at a small edit distance thereby become
strings at a small Hamming distance.  Bit-sampling LSH compares a fixed sample of the
steps.  Walk and sample are drawn anew for each repetition, and walks go forward
from the first word and back from the last one by turns, until a pair with the edits
admitted collides at least once with the target recall, wherever the edits are.
Equal passages always collide, so passages copied word for word are found without
loss.  Every collision is then checked by the exact edit distance.

The evaluation side enters the scan of the corpus as a bitmap sized by its
signatures, with no false negatives, so that only colliding passages are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.session import materialize

#: Bits of the bitmap for each signature of the evaluation side, and the least and most bits (as powers of 2) that it takes.
BITS_EACH, LEAST_BITS, MOST_BITS = 512, 16, 30
#: Words embedded at once.
CHUNK_WORDS = 1 << 18
#: Repetitions tried before the recall is declared out of reach.
MOST_REPETITIONS = 256
_WORD = re.compile(r"[^\W_]+")
_END = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class WalkPlan:
    """Windows of ``window`` words (items from ``least`` words on), ``max_edits`` to find with ``recall``, one for every ``edit_words`` words of a window at most.

    ``walk``: steps of a walk for each word of the window; more steps see more of its words, so that fewer other passages
    collide, and fewer edited ones too.  ``sampled``: the share of the steps that is compared.
    """

    window: int = 12
    least: int = 6
    max_edits: int = 1
    edit_words: int = 6
    walk: float = 1.0
    sampled: float = 0.75
    recall: float = 0.9
    seed: int = 20240817

    def edits(self, words: int) -> int:
        return min(self.max_edits, words // self.edit_words)


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters or digits, in lower case."""
    return _WORD.findall(text.lower()) if text else []


@lru_cache(maxsize=64)
def _draws(plan: WalkPlan, size: int, repetition: int) -> tuple[np.ndarray, tuple[int, ...], int]:
    """For windows of ``size`` words: an odd multiplier a step, the sampled steps, and the seed of the signature."""
    rng = np.random.default_rng([plan.seed, size, repetition])
    steps = max(1, round(plan.walk * size))
    multipliers = rng.integers(0, 1 << 63, size=steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sample = np.sort(rng.permutation(steps)[: max(1, round(plan.sampled * steps))])
    return multipliers, tuple(sample.tolist()), int(rng.integers(0, 1 << 63))


def signatures(words: np.ndarray, anchors: np.ndarray, plan: WalkPlan, size: int, repetition: int) -> np.ndarray:
    """Sampled walk from each anchor, folded to 64 bits: forward in even repetitions, back in odd ones.

    ``words`` holds word hashes, with ``size`` words at least around every anchor.
    """
    multipliers, sample, seed = _draws(plan, size, repetition)
    back = bool(repetition % 2)
    at = anchors.astype(np.int64)
    last = at - (size - 1) if back else at + (size - 1)
    out = np.full(len(anchors), seed, np.uint64)
    for step in range(sample[-1] + 1):
        symbol = words[at]
        if step in sample:
            out = (out ^ symbol) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
        if step < sample[-1]:
            moved = symbol * multipliers[step]
            moves = ((moved ^ (moved >> np.uint64(29))) >> np.uint64(28) & np.uint64(1)).astype(np.int64)
            at = at - moves if back else at + moves
            if step >= size - 1:  # a walk ends at the last word
                at = np.maximum(at, last) if back else np.minimum(at, last)
    return out


def edited_pairs(size: int, edits: int, pairs: int, rng: np.random.Generator) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(kind, place, window, passage) of drawn windows with an edit of each kind at each place, and further ones anywhere."""
    out = []
    for kind in ("changed", "put in", "left out"):
        for place in range(1 if kind == "put in" else 0, size):
            for _ in range(pairs):
                a = rng.integers(0, 1 << 63, size=size, dtype=np.uint64)
                b = a
                for k in range(edits):
                    how, where = (kind, place) if k == 0 else (("changed", "put in", "left out")[rng.integers(3)], int(rng.integers(1, len(b))))
                    new = rng.integers(0, 1 << 63, size=1, dtype=np.uint64)
                    b = np.concatenate([b[:where], new if how != "left out" else new[:0], b[where + (how != "put in") :]])
                out.append((kind, place, a, b))
    return out


def collisions(pairs: list[tuple[str, int, np.ndarray, np.ndarray]], plan: WalkPlan, size: int, repetitions: int, seed: int) -> np.ndarray:
    """Whether each pair collides in each repetition, its passage standing among other words."""
    rng = np.random.default_rng(seed)
    room = size + max(len(b) for *_, b in pairs)
    a = np.stack([np.concatenate([a, rng.integers(0, 1 << 63, size=room - size, dtype=np.uint64)]) for *_, a, _ in pairs])
    b = rng.integers(0, 1 << 63, size=(len(pairs), 3 * room), dtype=np.uint64)
    for row, (*_, own) in enumerate(pairs):
        b[row, room : room + len(own)] = own
    first_a, first_b = np.arange(len(pairs)) * room, np.arange(len(pairs)) * 3 * room + room
    last_a, last_b = first_a + size - 1, first_b + np.array([len(own) for *_, own in pairs]) - 1
    return np.stack([
        signatures(a.ravel(), last_a if r % 2 else first_a, plan, size, r) == signatures(b.ravel(), last_b if r % 2 else first_b, plan, size, r) for r in range(repetitions)
    ])


@lru_cache(maxsize=64)
def repetitions_for(plan: WalkPlan, size: int) -> int:
    """Repetitions after which edited passages have collided with the wanted recall, for the worst kind and place of edit.

    The recall is measured on drawn passages.
    """
    edits = plan.edits(size)
    if edits == 0:
        return 1
    drawn = edited_pairs(size, edits, 400, np.random.default_rng([plan.seed, size]))
    cases = np.unique([f"{kind} {place}" for kind, place, *_ in drawn], return_inverse=True)[1]
    many = 4
    while many <= MOST_REPETITIONS:
        hit = np.logical_or.accumulate(collisions(drawn, plan, size, many, plan.seed), axis=0)
        for done in range(2, many + 1, 2):
            # three standard errors above the target, for the recall is measured on a sample
            share = np.bincount(cases, hit[done - 1]) / np.bincount(cases)
            if share.min() >= plan.recall + 3 * np.sqrt(plan.recall * (1 - plan.recall) / 400):
                return done
        many *= 2
    raise ValueError(f"a recall of {plan.recall} takes more than {MOST_REPETITIONS} repetitions; sample fewer steps or admit fewer edits")


def passage_distance(a: list[str], text: list[str], most: int) -> int:
    """Least edits (words put in, left out, changed) from ``a`` to a beginning of ``text``, or ``most + 1`` if there are more."""
    n, m = len(a), len(text)
    if text[:n] == a:
        return 0
    # words of the window that are nowhere in the text must all be edited
    if len(set(a).difference(text)) > most:
        return most + 1
    # furthest word of a reached on each diagonal (place in text minus place in a) with so many edits
    reached = {0: 0}
    for edits in range(most + 1):
        new: dict[int, int] = {}
        for d in range(-edits, edits + 1):
            if edits:
                i = max(reached.get(d, -9) + 1, reached.get(d - 1, -9), reached.get(d + 1, -9) + 1)
                i = min(i, n, m - d)
            else:
                i = 0
            if i < 0 or i + d < 0:
                continue
            while i < n and i + d < m and a[i] == text[i + d]:
                i += 1
            if i == n:
                return edits
            new[d] = i
        reached = new
    return most + 1


class _Hashes(dict):
    """64-bit hashes of words; a worker's memory of them starts anew when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _kind(df: DataFrame, name: str) -> T.DataType:
    own = df.schema[name].dataType
    if not isinstance(own, (T.IntegralType, T.StringType)):
        raise TypeError(f"{name}: ids are whole numbers or strings, not {own.simpleString()}")
    return own


def _passages(df: DataFrame, row_id: str, text: str, plan: WalkPlan, sizes: list[int] | None, bitmap=None) -> DataFrame:
    """(id, sig, words): every window of items (``sizes`` None), or the passages of a corpus whose signature may be in ``bitmap``.

    ``words`` stand in the direction of the walk: those of the window, or as many of the passage as the edits admit.
    """
    kind = _kind(df, row_id)
    schema = T.StructType([T.StructField("id", kind), T.StructField("sig", T.LongType()), T.StructField("words", T.StringType())])
    arrow_kind = pa.string() if isinstance(kind, T.StringType) else {T.ByteType(): pa.int8(), T.ShortType(): pa.int16(), T.IntegerType(): pa.int32()}.get(kind, pa.int64())
    reach = plan.window + plan.max_edits  # words around an anchor that a walk or a check may read

    def flush(ids: list, texts: list[list[str]], hashes: _Hashes) -> Iterator[pa.RecordBatch]:
        gap = [""] * reach
        flat = list(gap)
        for t in texts:
            flat += t
            flat += gap
        lengths = np.array([len(t) for t in texts])
        words = np.array(list(map(hashes.__getitem__, flat)), np.uint64)
        first = np.cumsum(lengths + reach) - lengths
        owner = np.repeat(np.arange(len(texts)), lengths)
        before = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = first[owner] + before
        left = lengths[owner] - before  # words from here to the end
        names = pa.array(ids, arrow_kind)
        kept, mask = (bitmap.value, len(bitmap.value) * 8 - 1) if bitmap is not None else (None, 0)
        for size in sizes if sizes is not None else sorted({min(n, plan.window) for n in lengths.tolist() if n >= plan.least}):
            spare = plan.edits(size) if sizes is not None else 0
            whole = np.minimum(lengths, plan.window)[owner] == size
            for rep in range(repetitions_for(plan, size)):
                room = before + 1 if rep % 2 else left
                usable = room >= size - spare if sizes is not None else whole & (room >= size)
                at = place[usable]
                sig = signatures(words, at, plan, size, rep)
                mine = owner[usable]
                if kept is not None:
                    slot = (sig & np.uint64(mask)).astype(np.int64)
                    hit = np.nonzero((kept[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)[0]
                    at, sig, mine = at[hit], sig[hit], mine[hit]
                for lo in range(0, len(at), 16384):
                    part = at[lo : lo + 16384].tolist()
                    if rep % 2:
                        told = [" ".join(flat[s : s - size - spare : -1]).rstrip() for s in part]
                    else:
                        told = [" ".join(flat[s : s + size + spare]).rstrip() for s in part]
                    own = pa.array(mine[lo : lo + 16384])
                    yield pa.RecordBatch.from_arrays([names.take(own), pa.array(sig[lo : lo + 16384].view(np.int64)), pa.array(told, pa.string())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes({"": _END})
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = words_of(t)
                # a very long text goes in overlapping parts, one of which holds each passage; items are not cut
                step = CHUNK_WORDS if sizes is not None else max(len(own), 1)
                for lo in range(0, max(len(own) - reach, 0) + 1, step):
                    part = own[lo : lo + step + reach]
                    ids.append(i)
                    texts.append(part)
                    held += len(part)
                    if held >= CHUNK_WORDS:
                        yield from flush(ids, texts, hashes)
                        ids, texts, held = [], [], 0
                        hashes[""] = _END
        if ids:
            yield from flush(ids, texts, hashes)

    source = df.where(F.col(f"`{row_id}`").isNotNull()).select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    return source.mapInArrow(run, schema)


def _bitmap(wanted: DataFrame):
    """The signatures' last bits as a broadcast bitmap, of ``BITS_EACH`` bits a signature and 2 ** ``MOST_BITS`` (128 MB) at most.

    Beyond that many signatures the bitmap lets more passages through, all of which are checked.
    """
    count = wanted.count()
    power = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * count - 1).bit_length()))
    slot = F.col("sig").bitwiseAND(F.lit((1 << power) - 1))
    words = wanted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    bits = np.zeros(1 << (power - 6), np.uint64)
    for batch in words.toArrow().to_batches():
        bits[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return wanted.sparkSession.sparkContext.broadcast(bits.view(np.uint8))


def find_leaks(corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, plan: WalkPlan = WalkPlan()) -> DataFrame:
    """``doc_id``, ``item_id``, ``edits``: pairs that share a window within the plan's edits, with the least edits.

    Pairs with ``edits`` 0 are complete; others are found with ``plan.recall`` for
    each kind and place of an edit.  Defined cases: null, empty and wordless texts
    share nothing, nor do items of fewer words than ``plan.least``; repeated rows of
    an id count once; an item or document with a null id is left out; ids are whole
    numbers or strings and keep their type; an empty table gives none; further
    columns are ignored, both sides may name theirs alike; texts are read whole, at
    any length.  The windows of the items are written once into the shared folder,
    and their sizes and bitmap are found when this is called.
    """
    kinds = _kind(corpus, doc_id), _kind(items, item_id)
    wanted = materialize(_passages(items, item_id, item_text, plan, None).dropDuplicates(["id", "sig", "words"]), "windows")
    counted = wanted.select((F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1).alias("n")).distinct().collect()  # plan.window numbers at most
    found = _passages(corpus, doc_id, text, plan, sorted(r.n for r in counted), _bitmap(wanted))
    pairs = found.toDF("doc", "sig", "c").join(wanted.toDF("item", "sig", "a"), "sig").select("doc", "item", "a", "c")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a passage meets several windows and a window several passages, so their words are parted once
            windows, passages = (batch.column(k).dictionary_encode() for k in (2, 3))
            of_window, of_passage = ([t.split(" ") for t in c.dictionary.to_pylist()] for c in (windows, passages))
            allowed = [plan.edits(len(a)) for a in of_window]
            pairs_ = zip(windows.indices.to_pylist(), passages.indices.to_pylist())
            edits = np.fromiter((passage_distance(of_window[a], of_passage[c], allowed[a]) for a, c in pairs_), np.int32, batch.num_rows)
            most = np.array(allowed, np.int32)[windows.indices.to_numpy()]
            done = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(edits)], names=["doc", "item", "edits"])
            yield done.filter(pa.array(edits <= most))

    checked = pairs.mapInArrow(verify, f"doc {kinds[0].simpleString()}, item {kinds[1].simpleString()}, edits int").groupBy("doc", "item").agg(F.min("edits").alias("edits"))
    return checked.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "edits")
