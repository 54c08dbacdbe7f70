"""Exact byte-level BPE ids by dynamic programming over prefixes.

A text is parted by the vocabulary's word pattern.  For a piece, every prefix has
exactly one last token in its BPE encoding.  The candidates are the tokens that
are suffixes of the prefix, found by an automaton over the whole vocabulary; the
right one is the one compatible with the last token of the shorter prefix that it
leaves.  Following these back-pointers from the end gives the ids.  The work is
linear in the length of a piece, whatever its content.

Two tokens are compatible if BPE, run over their joined bytes, gives these two
again.  That is tested by undoing merges on both sides of the seam: a merge across
the seam must not come earlier than the merges that built its neighbours.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Default place of the vocabulary.
VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.json")
#: Fixed value: the word pattern of this public vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker remembers, and the longest of them; the memory starts anew when it is full.
REMEMBERED, REMEMBERED_BYTES = 200_000, 64
_BIG = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable}
    extra = 256
    for b in range(256):
        if b not in printable:
            letters[chr(extra)] = b
            extra += 1
    return letters


class PrefixEncoder:
    """Encodes one piece, given as bytes, to its ids."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        decode = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        self.joined: dict[tuple[int, int], int] = {}  # pair -> rank of its merge
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> (rank, left, right) of the merge that makes it
        vocab = model["vocab"]
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            token = vocab[a + b]
            self.joined[vocab[a], vocab[b]] = rank
            self.parts.setdefault(token, (rank, vocab[a], vocab[b]))
        self.tokens = {b: vocab[t] for t, b in decode.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        reachable = self._reachable()
        for b, token in self.tokens.items():
            if token in reachable:
                self.automaton.add_word(b.decode("latin-1"), (token, len(b)))
        self.automaton.make_automaton()
        self.words = regex.compile(WORD_PATTERN).findall
        self.compatible = lru_cache(maxsize=1 << 18)(self._seam_holds)
        self.memory: dict[str, list[int]] = {}

    def _seam_holds(self, a: int, b: int, end: int = _BIG) -> bool:
        """Whether BPE merges nothing across the seam of tokens ``a`` and ``b`` before rank ``end``.

        Merges run by rank, equal ones from left to right.  Going back in time, the
        token beside the seam that was made last is taken apart: of equal ranks the
        right one.  A pair across the seam would have merged if its rank comes before
        the left one was used up by its own merge, and not after the right one was.
        """
        left_until = right_until = end
        while True:
            merge = self.joined.get((a, b))
            if merge is not None and merge < left_until and merge <= right_until:
                return False
            made_a, made_b = self.parts.get(a), self.parts.get(b)
            if made_a is None and made_b is None:
                return True
            if made_b is None or (made_a is not None and made_a[0] > made_b[0]):
                left_until, a = made_a[0], made_a[2]
            else:
                right_until, b = made_b[0], made_b[1]

    def _reachable(self) -> set[int]:
        """Tokens that BPE makes from their own bytes."""
        good = {t for t in self.tokens.values() if t not in self.parts}
        for token, (rank, a, b) in sorted(self.parts.items(), key=lambda x: x[1][0]):
            if a in good and b in good and self._seam_holds(a, b, rank):
                good.add(token)
        return good

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Ids of a piece by the last token of every prefix."""
        n = len(piece)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        compatible = self.compatible
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            begin = end - length
            if begin == 0 or compatible(last[begin], token):
                last[end], size[end] = token, length
        ids = []
        at = n
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty one."""
        if not text:
            return []
        ids: list[int] = []
        memory = self.memory
        for word in self.words(text):
            own = memory.get(word)
            if own is None:
                piece = word.encode("utf-8", "surrogatepass")
                own = self.encode_bytes(piece)
                if len(piece) <= REMEMBERED_BYTES:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[word] = own
            ids += own
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    """One encoder a worker process and vocabulary."""
    return PrefixEncoder(path)


def encode_column(df: DataFrame, text: str, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """``keep`` + ``ids``, the token ids of ``df[text]`` without special tokens.

    Every row is kept, repeated ones too.  Defined cases: a null or empty text has
    an empty list; a text that spells a special token is ordinary text; texts may
    be of any length; an empty table gives none; further columns are ignored.
    There is no shuffle.  The file at ``path`` goes to the executors with the job.
    """
    context = df.sparkSession.sparkContext
    context.addFile(path)
    name = os.path.basename(path)
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("t"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        encode = encoder(SparkFiles.get(name)).encode
        kind = pa.list_(pa.field("element", pa.int32(), nullable=False))
        for batch in batches:
            ids, rows, size = [], 0, 0
            for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                ids.append(encode(t))
                size += len(ids[-1])
                if size > 1 << 20:  # a batch of long texts goes out in parts
                    yield pa.RecordBatch.from_arrays([*[c.slice(rows, len(ids)) for c in batch.columns[:-1]], pa.array(ids, kind)], names=schema.names)
                    rows, ids, size = i + 1, [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([*[c.slice(rows, len(ids)) for c in batch.columns[:-1]], pa.array(ids, kind)], names=schema.names)

    return source.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "ids")
