"""Severity of abusive, hateful or sexual content, for every document.

The votes of the raters of a document become an ordinal grade: 0 no vote says
abusive, 1 some do, 2 most do.  A cumulative-link (proportional odds) regression
predicts the grade from sparse, hashed text features; its ordered thresholds share
one weight vector.  The unit that is scored is a segment of a text (a clause or a
line): a document counts as severe as its worst segment, for one abusive sentence
makes a document abusive whatever the rest says.  So in fitting, a document voted
abusive stands for its worst segment under the model so far, and all segments of
the others are examples of grade 0.  Votes that the model firmly contradicts are
left out of the last rounds, since single raters err.

The model is fitted in one task on at most ``max_labelled`` labelled documents,
taken by hash of their id.  Their texts are turned into features where they lie;
the task that fits receives numbers only.  Scoring is a narrow pass over all
documents with a weight vector of fixed size; a fitted model may serve many passes.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts that look like Latin ones, in NFKD lower case.
LOOKALIKES = str.maketrans({
    "а": "a", "в": "b", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "г": "r",
    "п": "n", "ӏ": "l", "ԛ": "q", "ԝ": "w", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ι": "i", "κ": "k", "ν": "v", "χ": "x", "ı": "i", "ß": "ss",
})
#: Digits and signs written for letters.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})

#: Text turned into features at once.
PART_BYTES = 8 << 20

_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_*]){3,}[^\W_](?![^\W_])")
_SPACERS = re.compile(r"[ .\-_*]")
_MIXED = re.compile(r"(?<![a-z0-9@$])[a-z]*[0-9@$][a-z0-9@$]*")
_LETTER = re.compile(r"[a-z]")
_MARKS = regex.compile(r"[\p{Mn}\p{Cf}]+")
_REPEATS = re.compile(r"([a-z])\1{2,}")
_DOUBLES = re.compile(r"([a-z])\1")
_SPLIT = re.compile(r"(?<=[.!?;,:”»“])\s+|\n+")
_WORDS = re.compile(r"[a-z]+(?:\*+[a-z]*)*")


@dataclass(frozen=True)
class SeverityPlan:
    """``buckets`` for features, ``max_labelled`` documents to fit on, ``epochs`` of each of ``rounds`` fits."""

    buckets: int = 1 << 18
    max_labelled: int = 16_000
    rounds: int = 4
    epochs: int = 60
    rate: float = 0.3
    penalty: float = 1e-5
    #: Probability of at least grade 1 of the worst segment from which a document is found.
    found_at: float = 0.35


def normalise(text: str) -> str:
    """Lower case without accents, look-alike letters, digits for letters, spelled-out words and long repeats."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = _MARKS.sub("", text).lower().translate(LOOKALIKES)
    else:
        text = text.lower()
    text = _SPELLED.sub(lambda m: _SPACERS.sub("", m[0]), text)
    text = _MIXED.sub(lambda m: m[0].translate(SIGNS) if _LETTER.search(m[0]) else m[0], text)
    return _REPEATS.sub(r"\1", text)


class _Numbers(dict):
    """Words by number, from 0 on; an unknown word gets the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Featurizer:
    """Hashed features of segments: words, word pairs, and letter 4-grams of words.

    Words become numbers, and the features of many segments are put together as
    arrays.  A worker remembers the features of words and pairs; the memory starts
    anew when it is full.
    """

    REMEMBERED = 500_000

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers({"^": 0, "$": 1})
        self.names: list[str] = []
        self.features: list[int] = []  # of all words, one word after the other
        self.ends: list[int] = []
        self.of_pair: dict[int, int] = {}

    def _hash(self, feature: str) -> int:
        return zlib.crc32(feature.encode()) % self.buckets

    def _learn_words(self) -> None:
        """Features of the words that are new since the last call."""
        for word in list(self.numbers)[len(self.names) :]:
            self.names.append(word)
            if word not in ("^", "$"):
                bare = word.replace("*", "")
                marked = f"<{_DOUBLES.sub(chr(92) + '1', bare)}>"
                grams = {marked[i : i + 4] for i in range(len(marked) - 3)} if len(bare) >= 4 else set()
                self.features += {self._hash(f"u{bare}"), *(self._hash(f"c{g}") for g in grams)}
            self.ends.append(len(self.features))

    def _pairs(self, keys: np.ndarray) -> np.ndarray:
        """The feature of each pair of words, given as two numbers in one."""
        different, at = np.unique(keys, return_inverse=True)
        known, names, out = self.of_pair, self.names, []
        for k in different.tolist():
            own = known.get(k)
            if own is None:
                own = known[k] = self._hash(f"b{names[k >> 32]} {names[k & 0xFFFFFFFF]}")
            out.append(own)
        return np.array(out, np.int64)[at]

    def segments(self, texts: Sequence[str | None]) -> Segments:
        """Every segment with a word of all texts; each feature once a segment."""
        if len(self.numbers) + len(self.of_pair) > self.REMEMBERED:
            self._forget()
        number = self.numbers.__getitem__
        words: list[int] = []
        lengths, doc = [], []
        for i, text in enumerate(texts):
            if text:
                for part in _SPLIT.split(normalise(text)):
                    own = _WORDS.findall(part)
                    if own:
                        words.append(0)
                        words += map(number, own)
                        words.append(1)
                        lengths.append(len(own) + 2)
                        doc.append(i)
        self._learn_words()
        count = len(lengths)
        if not count:
            return Segments.of(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), len(texts))
        ids = np.array(words, np.int64)
        of = np.repeat(np.arange(count), lengths)
        inside = of[1:] == of[:-1]
        pairs = self._pairs((ids[:-1] << 32 | ids[1:])[inside])
        ends, features = np.array([0, *self.ends]), np.array(self.features, np.int64)
        sizes = (ends[1:] - ends[:-1])[ids]
        place = np.arange(sizes.sum()) + np.repeat(ends[ids] - (np.cumsum(sizes) - sizes), sizes)
        keys = np.concatenate([np.repeat(of, sizes) << 32 | features[place], of[1:][inside] << 32 | pairs])
        keys.sort()
        keys = keys[_firsts(keys)]
        return Segments.of(keys & 0xFFFFFFFF, np.bincount(keys >> 32, minlength=count), np.array(doc, np.int64), len(texts))


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where the stretches of equal values begin in a sorted array."""
    return np.nonzero(np.concatenate([[True], values[1:] != values[:-1]]))[0] if len(values) else np.zeros(0, np.int64)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the stretches of ``values`` that begin at ``starts``; none is empty."""
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, values.dtype)


@dataclass
class Segments:
    """Segments of many documents in flat arrays. Every segment has features, which stand together."""

    index: np.ndarray  # features
    begin: np.ndarray  # first place of each segment in ``index``
    scale: np.ndarray  # value of the features of each segment
    doc: np.ndarray  # document of each segment
    docs: int

    @classmethod
    def of(cls, index: np.ndarray, sizes: np.ndarray, doc: np.ndarray, docs: int) -> Segments:
        return cls(index, np.cumsum(sizes) - sizes, 1 / np.sqrt(np.maximum(sizes, 1)), doc, docs)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.begin, append=len(self.index))

    def score(self, weights: np.ndarray) -> np.ndarray:
        return _sums(weights[self.index], self.begin) * self.scale

    def take(self, chosen: np.ndarray) -> Segments:
        """Only the segments where ``chosen`` holds."""
        sizes = self.sizes
        return Segments.of(self.index[np.repeat(chosen, sizes)], sizes[chosen], self.doc[chosen], self.docs)

    def whole(self) -> Segments:
        """One segment a document, with the features of all of its segments."""
        pairs = np.sort(np.repeat(self.doc, self.sizes) << 32 | self.index)
        pairs = pairs[_firsts(pairs)]
        begin = _firsts(pairs >> 32)
        return Segments.of(pairs & 0xFFFFFFFF, np.diff(begin, append=len(pairs)), pairs[begin] >> 32, self.docs)

    def by_feature(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The segments of each feature, standing together; where each feature begins; and which feature it is."""
        pairs = np.sort(self.index << 32 | np.repeat(np.arange(len(self.begin)), self.sizes))
        begin = _firsts(pairs >> 32)
        return (pairs & 0xFFFFFFFF).astype(np.int32), begin, pairs[begin] >> 32


def worst(scores: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Highest score of each document (-inf without segments), and the segment that has it (-1)."""
    best = np.full(docs, -np.inf)
    np.maximum.at(best, doc, scores)
    at = np.full(docs, -1, np.int64)
    hit = np.nonzero(scores == best[doc])[0][::-1]
    at[doc[hit]] = hit  # the first of equals
    return best, at


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_cumulative(
    x: Segments, grade: np.ndarray, plan: SeverityPlan, start: tuple[np.ndarray, np.ndarray] | None = None, mass: np.ndarray | None = None, grades: int = 3
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of P(grade <= k) = logistic(threshold_k - weights . x), by adaptive gradient steps.

    ``mass`` says how much each segment counts.
    """
    n = len(grade)
    mass = np.full(n, 1 / max(n, 1)) if mass is None else mass / mass.sum()
    weights, cuts = (start[0].copy(), start[1].copy()) if start else (np.zeros(plan.buckets), np.arange(1.0, grades))
    rows, begin, used = x.by_feature()
    # only weights of features that occur are moved by examples; the others only shrink
    place = np.full(plan.buckets, -1, np.int32)
    place[used] = np.arange(len(used))
    small = Segments(place[x.index], x.begin, x.scale, x.doc, x.docs)
    own, idle = weights[used], weights[place < 0]
    seen, seen_idle, seen_cuts = np.full(len(own), 1e-6), np.full(len(idle), 1e-6), np.full(grades - 1, 1e-6)
    at = np.arange(n)
    for _ in range(plan.epochs):
        below = _logistic(cuts[None] - small.score(own)[:, None])
        slope = below * (1 - below)
        edges = np.column_stack([np.zeros(n), below, np.ones(n)])
        slopes = np.column_stack([np.zeros(n), slope, np.zeros(n)])
        p = np.maximum(edges[at, grade + 1] - edges[at, grade], 1e-9)
        step = mass * (slopes[at, grade + 1] - slopes[at, grade]) / p  # of the loss, by the score
        gradient = _sums((step * x.scale)[rows], begin) + plan.penalty * own
        pull = mass / p
        of_cuts = np.array([np.sum(np.where(grade == k + 1, slope[:, k], 0) * pull) - np.sum(np.where(grade == k, slope[:, k], 0) * pull) for k in range(grades - 1)])
        seen += gradient**2
        seen_cuts += of_cuts**2
        own = own - plan.rate * gradient / np.sqrt(seen)
        cuts = np.sort(cuts - plan.rate * of_cuts / np.sqrt(seen_cuts))
        if idle.any():
            pull_back = plan.penalty * idle
            seen_idle += pull_back**2
            idle = idle - plan.rate * pull_back / np.sqrt(seen_idle)
    weights[used], weights[place < 0] = own, idle
    return weights, cuts


def fit_documents(segments: Segments, grade: np.ndarray, plan: SeverityPlan = SeverityPlan()) -> tuple[np.ndarray, np.ndarray]:
    """Fit on documents whose grade is that of their worst segment."""
    whole = segments.whole()
    weights, cuts = fit_cumulative(whole, grade[whole.doc], plan)
    trusted = np.ones(segments.docs, bool)
    for round_ in range(plan.rounds):
        scores = segments.score(weights)
        best, at = worst(scores, segments.doc, segments.docs)
        if round_ >= 2:
            severe = 1 - _logistic(cuts[0] - best)
            trusted = np.where(grade > 0, severe > 0.1, severe < 0.8)
        chosen = (grade[segments.doc] == 0) & trusted[segments.doc]
        mass = 1 / np.maximum(np.bincount(segments.doc, minlength=segments.docs), 1)[segments.doc]
        top = at[(at >= 0) & trusted]
        chosen[top] = True
        mass[top] = 1.0
        x = segments.take(chosen)
        weights, cuts = fit_cumulative(x, grade[x.doc], plan, (weights, cuts), mass[chosen])
    return weights, cuts


def expected_grade(score: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sum over k of P(grade > k)."""
    return (1 - _logistic(cuts[None] - score[:, None])).sum(axis=1)


def _in_parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts take about ``PART_BYTES``, so that long texts do not fill the memory."""
    rows = max(1, batch.num_rows * PART_BYTES // max(batch.column(text).nbytes, PART_BYTES))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def grades_of(labels: DataFrame, doc_id: str, vote: str) -> DataFrame:
    """``doc`` and ``grade`` of every document with a vote that is not null."""
    votes = labels.where(F.col(f"`{vote}`").isin(0, 1) & F.col(f"`{doc_id}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").cast("string").alias("doc"))
    share = votes.agg(F.avg(f"`{vote}`").alias("share"))
    return share.select("doc", F.when(F.col("share") > 0.5, 2).when(F.col("share") > 0, 1).otherwise(0).alias("grade"))


def learn(documents: DataFrame, doc_id: str, text: str, labels: DataFrame, vote: str, plan: SeverityPlan = SeverityPlan()) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from the labelled documents; without any, all weights are 0.

    Runs a job.  What the driver gets has a fixed size, ``plan.buckets``.
    """
    own = documents.select(F.col(f"`{doc_id}`").cast("string").alias("doc"), F.col(f"`{text}`").cast("string").alias("t"))
    sample = grades_of(labels, doc_id, vote).orderBy(F.xxhash64("doc"), "doc").limit(plan.max_labelled)
    rows = own.join(F.broadcast(sample), "doc")  # at most plan.max_labelled ids

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer(plan.buckets)
        for batch in batches:
            for part in _in_parts(batch, 1):
                x = features.segments(part.column(1).to_pylist())
                upto = np.searchsorted(x.doc, np.arange(x.docs + 1)).astype(np.int32)
                sizes = pa.ListArray.from_arrays(upto, pa.array(x.sizes, pa.int32()))
                index = pa.ListArray.from_arrays(np.append(x.begin, len(x.index))[upto].astype(np.int32), pa.array(x.index, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), sizes, index], names=["doc", "grade", "sizes", "index"])

    ready = rows.mapInArrow(featurise, "doc string, grade int, sizes array<int>, index array<int>").orderBy(F.xxhash64("doc"), "doc", "sizes", "index").limit(plan.max_labelled)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grade, sizes, index, counts = [], [], [], []
        for batch in batches:
            grade.append(batch.column(1).to_numpy())
            counts.append(np.diff(batch.column(2).offsets.to_numpy()))
            sizes.append(batch.column(2).flatten().to_numpy())
            index.append(batch.column(3).flatten().to_numpy())
        if grade:
            per_doc = np.concatenate(counts)
            segments = Segments.of(np.concatenate(index).astype(np.int64), np.concatenate(sizes).astype(np.int64), np.repeat(np.arange(len(per_doc)), per_doc), len(per_doc))
            weights, cuts = fit_documents(segments, np.concatenate(grade).astype(np.int64), plan)
            at = np.nonzero(weights)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([[-1, -2], at]), pa.int32()), pa.array(np.concatenate([cuts, weights[at]]), pa.float64())], names=["at", "w"]
            )

    out = ready.coalesce(1).mapInArrow(fit, "at int, w double").toArrow()
    weights, cuts = np.zeros(plan.buckets), np.array([1.0, 2.0])
    at, w = out.column("at").to_numpy(), out.column("w").to_numpy()
    for k in (0, 1):
        if (at == -1 - k).any():
            cuts[k] = w[at == -1 - k][0]
    weights[at[at >= 0]] = w[at >= 0]
    return weights, cuts


def score_documents(
    documents: DataFrame, doc_id: str, text: str, labels: DataFrame, vote: str, keep: Sequence[str] = (), plan: SeverityPlan = SeverityPlan(), model: tuple[np.ndarray, np.ndarray] | None = None
) -> DataFrame:
    """``doc_id``, ``keep``, ``severity`` (expected grade, 0 to 2) and ``found`` for every document.

    ``model`` is what ``learn`` returned; without it the model is fitted when this is called.
    Defined cases: a null, empty or wordless text has severity 0 and is not found;
    null votes and votes other than 0 and 1 are ignored; without labels no text
    stands out and none is found; repeated rows are scored each, also those of a
    null id; ids may be numbers or strings; an empty table gives none; texts are
    read whole, at any length.
    """
    weights, cuts = model or learn(documents, doc_id, text, labels, vote, plan)
    shared = documents.sparkSession.sparkContext.broadcast((weights, cuts))  # fixed size: plan.buckets
    columns = [doc_id, *keep]
    source = documents.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)], F.col(f"`{text}`").cast("string").alias("t"))
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in source.schema.fields[:-1])}, severity double, found boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cuts_ = shared.value
        features = Featurizer(plan.buckets)
        for batch in chain.from_iterable(_in_parts(b, b.num_columns - 1) for b in batches):
            segments = features.segments(batch.column(batch.num_columns - 1).to_pylist())
            best, _ = worst(segments.score(w), segments.doc, segments.docs)
            there = np.isfinite(best)
            best = np.where(there, best, -40.0)
            severity = np.where(there, expected_grade(best, cuts_), 0.0)
            found = there & (1 - _logistic(cuts_[0] - best) >= plan.found_at)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(severity), pa.array(found)], names=[*batch.schema.names[:-1], "severity", "found"])

    return source.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(columns)], "severity", "found")
