"""Exact byte-level BPE by dynamic programming over prefixes.

Every prefix of a piece has exactly one valid encoding, so it is enough to store the last token of each
prefix: token ``t`` may end prefix ``i`` iff it may follow the last token of prefix ``i - len(t)``, and two
tokens may follow each other iff BPE encodes their joined bytes as just these two. Appending bytes needs
only the stored tokens; after an edit, prefixes before it stand, and those after it stand again as soon as as
many successive last tokens as the longest token has bytes are what they were.

Encoding of a corpus: texts are cut to pieces by the vocabulary's public pattern, pieces are encoded once per
task and remembered. Null and empty texts have no ids.
"""

from __future__ import annotations

import base64
import functools
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from axisframe.session import ship

#: Where the vocabulary files lie on every machine, and the file of byte_bpe_50k.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern of the vocabulary, which splits a text before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces a task remembers before it starts afresh (memory only; results do not depend on it).
REMEMBERED = 300_000


class PrefixBPE:
    """The vocabulary: ``ranks`` gives the id of each token's bytes, lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(PATTERN).findall
        self.finditer = regex.compile(PATTERN).finditer

    @classmethod
    def from_file(cls, path: str = VOCABULARY) -> PrefixBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())})

    def merge(self, piece: bytes) -> list[int]:
        """BPE as defined: join the adjacent pair of lowest rank, leftmost first, until none is left."""
        ranks, never = self.ranks, len(self.ranks) + 1
        parts = [piece[i : i + 1] for i in range(len(piece))]
        joins = [ranks.get(a + b, never) for a, b in zip(parts, parts[1:])]
        while joins and (rank := min(joins)) < never:
            i = joins.index(rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joins[i]
            if i:
                joins[i - 1] = ranks.get(parts[i - 1] + parts[i], never)
            if i < len(joins):
                joins[i] = ranks.get(parts[i] + parts[i + 1], never)
        return [ranks[p] for p in parts]

    def follows(self, a: int, b: int) -> bool:
        """Whether b may stand right after a."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 4 * REMEMBERED:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return known

    def last_token(self, piece: bytes, i: int, last: list[int]) -> int:
        """Last token of ``piece[:i]``, given those of all shorter prefixes."""
        ranks, token = self.ranks, self.token
        for j in range(max(0, i - self.longest), i):
            t = ranks.get(piece[j:i])
            if t is not None and (self.merge_is(t) if j == 0 else self.follows(last[j], t)):
                return t
        raise ValueError("the vocabulary lacks a byte")

    @functools.lru_cache(maxsize=100_000)  # noqa: B019 - lives as long as the vocabulary
    def merge_is(self, t: int) -> bool:
        return self.merge(self.token[t]) == [t]

    def prefixes(self, piece: bytes, last: list[int] | None = None) -> list[int]:
        """Last token of each prefix, continued from ``last``; entry 0 is unused."""
        last = [-1] if last is None else last
        rank, pairs, longest = self.ranks.get, self.pairs, self.longest
        for i in range(len(last), len(piece) + 1):
            # As last_token, without a call per prefix: the longest token first, and there is one that fits.
            for j in range(i - longest if i > longest else 0, i):
                t = rank(piece[j:i])
                if t is None:
                    continue
                if not j:
                    if self.merge_is(t):
                        break
                elif (fits := pairs.get((last[j], t))) or (fits is None and self.follows(last[j], t)):
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(t)
        return last

    def chain(self, last: list[int]) -> tuple[int, ...]:
        i, out = len(last) - 1, []
        while i:
            out.append(last[i])
            i -= len(self.token[last[i]])
        return tuple(reversed(out))

    def piece(self, text: str) -> tuple[int, ...]:
        raw = text.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        if whole is not None and self.merge_is(whole):
            return (whole,)
        return self.chain(self.prefixes(raw))

    def encode(self, text: str | None) -> list[int]:
        return [t for p in self.split(text) for t in self.piece(p)] if text else []


class EditablePiece:
    """A piece whose encoding is kept through appends and edits."""

    def __init__(self, vocabulary: PrefixBPE, raw: bytes = b""):
        self.vocabulary, self.raw, self.last = vocabulary, raw, vocabulary.prefixes(raw)

    def append(self, more: bytes) -> None:
        self.raw += more
        self.vocabulary.prefixes(self.raw, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` for bytes start..stop; returns how many prefixes had to be encoded again."""
        old, shift = self.last, len(new) - (stop - start)
        self.raw = self.raw[:start] + new + self.raw[stop:]
        self.last = old[: start + 1]
        same = 0
        for i in range(start + 1, len(self.raw) + 1):
            self.last.append(self.vocabulary.last_token(self.raw, i, self.last))
            same = same + 1 if i - shift > stop and self.last[i] == old[i - shift] else 0
            if same >= self.vocabulary.longest:
                self.last += old[i - shift + 1 :]
                return i - start
        return len(self.raw) - start

    @property
    def ids(self) -> tuple[int, ...]:
        return self.vocabulary.chain(self.last)


class EditableText:
    """A text cut to pieces, re-encoded only near its edits.

    The pattern reads to the right only, one character beyond a piece (three for its contractions), so
    pieces that end two pieces before an edit stand, and from the first common piece boundary after it on all stand.
    """

    def __init__(self, vocabulary: PrefixBPE, text: str = ""):
        self.vocabulary, self.text = vocabulary, text
        self.starts = [m.start() for m in vocabulary.finditer(text)]
        self.pieces = [vocabulary.piece(p) for p in vocabulary.split(text)]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, new: str) -> None:
        keep = max(0, bisect_left(self.starts, start) - 3)
        at = self.starts[keep] if keep < len(self.starts) else 0
        text = self.text[:start] + new + self.text[stop:]
        shift = len(text) - len(self.text)
        later = {s + shift: k for k, s in enumerate(self.starts) if s >= stop}
        starts, pieces = self.starts[:keep], self.pieces[:keep]
        for m in self.vocabulary.finditer(text, at):
            k = later.get(m.start())
            if k is not None and m.start() >= start + len(new):
                starts += [s + shift for s in self.starts[k:]]
                pieces += self.pieces[k:]
                break
            starts.append(m.start())
            pieces.append(self.vocabulary.piece(m.group()))
        self.text, self.starts, self.pieces = text, starts, pieces

    @property
    def ids(self) -> list[int]:
        return [t for p in self.pieces for t in p]


@functools.lru_cache(maxsize=4)
def _vocabulary(path: str) -> PrefixBPE:
    return PrefixBPE.from_file(path)


class _Memory(dict):
    """Piece -> ids (or their number), made at the first look."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece):
        if len(self) > REMEMBERED:
            self.clear()
        value = self[piece] = self.make(piece)
        return value


def _encode(id_field: pa.Field, path: str):
    schema = pa.schema([id_field, pa.field("ids", pa.list_(pa.field("element", pa.int32())))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        get, split = _Memory(vocabulary.piece).__getitem__, vocabulary.split
        for batch in batches:
            flat, offsets = array("i"), array("i", [0])
            for text in batch.column(1).to_pylist():
                if text:
                    flat.extend(chain.from_iterable(map(get, split(text))))
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, np.int32)), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids.cast(schema.field(1).type)], schema=schema)

    return run


def _count(id_field: pa.Field, path: str):
    schema = pa.schema([id_field, pa.field("n_tokens", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        get, split = _Memory(lambda p: len(vocabulary.piece(p))).__getitem__, vocabulary.split
        for batch in batches:
            counts = [sum(map(get, split(text))) if text else 0 for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], schema=schema)

    return run


def _over(df: DataFrame, row_id: str, text: str, maker, name: str, kind: T.DataType, path: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    ship(df.sparkSession)
    id_type = df.schema[row_id].dataType
    slim = df.select(df[row_id].alias(row_id), df[text].cast("string").alias("_text"))
    return slim.mapInArrow(maker(pa.field(row_id, to_arrow_type(id_type)), path), T.StructType([T.StructField(row_id, id_type), T.StructField(name, kind)]))


def encode_corpus(df: DataFrame, row_id: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(row_id, ``ids``) of every row; no shuffle.

    Null and empty texts give an empty list; a null or repeated row id is passed through row by row; other
    columns, also one named ``ids``, are ignored. Strings that look like special tokens are ordinary text.
    """
    return _over(df, row_id, text, _encode, "ids", T.ArrayType(T.IntegerType()), path)


def token_counts(df: DataFrame, row_id: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(row_id, ``n_tokens``) of every row; 0 for null and empty texts."""
    return _over(df, row_id, text, _count, "n_tokens", T.LongType(), path)
