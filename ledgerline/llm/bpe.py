"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text longer than one chunk is dealt out as overlapping slices.  Every task pre-tokenises its slice and encodes the
pieces; neighbouring slices are stitched at the first place where both have a pre-token boundary, from which on the
same pattern must match alike.  Shorter texts are one chunk and stay where they are.

A null text is encoded as an empty one (no ids, no bytes).  Rows repeat as often as they come; extra columns pass.
"""

from __future__ import annotations

import base64
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import SLICE, append_columns, cut, fresh

#: Characters of a chunk, and of what it shares with the next.
CHUNK, OVERLAP = 1 << 16, 256
#: Pre-tokens that end so near to a slice's end may have been cut short (the longest fixed match has 3 characters).
MARGIN = 4
#: Pieces whose ids a worker remembers, and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 300_000, 64
#: White space runs from this length on are encoded apart: the pattern would backtrack over all of them.
LONG_RUN = 400

ADDED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])


@dataclass(frozen=True)
class Vocabulary:
    """Ranks by token bytes, and the pattern of pre-tokens; small enough to go with each task (at most 2**20 tokens)."""

    ranks: dict[bytes, int]
    pattern: str

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if len(ranks) > 1 << 20:
            raise ValueError("too many tokens to send to every task")
        return cls(ranks, pattern)


class PieceEncoder:
    """Splits a text at places that are pre-token boundaries for certain, and encodes each piece once.

    A blank before a character that isn't white space always starts a pre-token: a run of white space gives its
    last blank to the word that follows.  So what lies between two such places can be encoded by itself.
    """

    def __init__(self, vocabulary: Vocabulary):
        import tiktoken

        self.core = tiktoken.Encoding(
            "own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={}
        )
        #: Ids by piece; the pieces that start with a blank are kept without it.
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.odd = re.compile(r" (?:\s|$)")
        self.cuts = re.compile(r" (?=\S)")
        self.run = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)

    def pieces(self, text: str) -> list[str]:
        if not self.odd.search(text):
            first, *rest = text.split(" ")
            return [first, *(" " + p for p in rest)]
        at = [0, *(m.start() for m in self.cuts.finditer(text) if m.start()), len(text)]
        return [text[a:b] for a, b in zip(at, at[1:], strict=False)]

    def fresh(self, piece: str) -> bytes:
        out, at = array("I"), 0
        for m in self.run.finditer(piece):
            # What precedes the run is whole; the run itself, less the character that the next word may take, is one match.
            end = m.end() if m.end() == len(piece) else m.end() - 1
            out.extend(self.core.encode_ordinary(piece[at : m.start()]))
            out.extend(self.core._encode_single_piece(piece[m.start() : end]))
            at = end
        out.extend(self.core.encode_ordinary(piece[at:]) if at < len(piece) else ())
        return out.tobytes()

    def piece(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            ids = self.fresh(piece)
            if len(piece) <= REMEMBERED_CHARS:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def after_blank(self, word: str) -> bytes:
        ids = self.fresh(" " + word)
        if len(word) <= REMEMBERED_CHARS:
            if len(self.spaced) >= REMEMBERED:
                self.spaced.clear()
            self.spaced[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        if self.odd.search(text):
            return b"".join(map(self.piece, self.pieces(text)))
        first, *rest = text.split(" ")
        get, make = self.spaced.get, self.after_blank
        return self.piece(first) + b"".join([get(p) or make(p) for p in rest])

    def slice(self, text: str) -> tuple[list[int], list[bytes]]:
        """Where the slice's pieces start, and their ids."""
        starts, ids, at = [], [], 0
        for piece in self.pieces(text):
            if piece:
                starts.append(at)
                ids.append(self.piece(piece))
                at += len(piece)
        return starts, ids


def stitch(encoder: PieceEncoder, parts: list[tuple[int, str, list[int], list[bytes]]]) -> bytes:
    """The ids of a whole text from its slices (start, text, pieces' starts, pieces' ids), in order of start.

    Between a slice and the next, the first piece boundary that both have decides.  Where none is shared (one
    pre-token or run covers the overlap), the text between the left's last sound boundary and the first later
    boundary of the right is encoded anew together, as that boundary is sound in every context.
    """
    starts, ids = list(parts[0][2]), list(parts[0][3])
    text, base = parts[0][1], 0  # text from the absolute position base on
    for start, own, own_starts, own_ids in parts[1:]:
        while starts and starts[-1] >= base + len(text) - MARGIN:  # maybe cut short
            starts.pop(), ids.pop()
        # A slice's first piece starts where the slice does, which need not be a boundary.
        right = [start + s for s in own_starts[1:]]
        have = set(starts)
        at = next((i for i, s in enumerate(right) if s in have), None)
        joined = text[: start - base] + own if start >= base else own[base - start :]
        if at is not None:
            keep = bisect_left(starts, right[at])
            starts, ids = starts[:keep] + right[at:], ids[:keep] + own_ids[at + 1 :]
        elif right:
            last = starts.pop() if starts else base
            if ids:
                ids.pop()
            middle = next((i for i, s in enumerate(right) if s > last), None)
            if middle is None:
                starts, ids = [*starts, last], [*ids, encoder.fresh(joined[last - base :])]
            else:
                new = encoder.fresh(joined[last - base : right[middle] - base])
                starts, ids = [*starts, last, *right[middle:]], [*ids, new, *own_ids[middle + 1 :]]
        else:
            last = starts.pop() if starts else base
            if ids:
                ids.pop()
            starts, ids = [*starts, last], [*ids, encoder.fresh(joined[last - base :])]
        # Only what a later stitch may need to encode again stays in hand.
        sound = bisect_left(starts, base + len(joined) - MARGIN) - 1
        keep_from = starts[max(sound, 0)]
        text, base = joined[keep_from - base :], keep_from
    return b"".join(ids)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with `n_tokens` and `ids` (unsigned 32-bit little-endian integers) of the whole text.

    Columns of these names in docs are replaced.  A null or empty text has no ids.
    """
    docs = docs.drop("n_tokens", "ids")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def short(values) -> Iterator[list[tuple]]:
        encoder = PieceEncoder(shared.value)
        for texts in values:
            out = []
            for t in texts:
                ids = encoder.text(t) if t else b""
                out.append((len(ids) // 4, ids))
            yield out

    is_long = F.coalesce(F.length(text) > chunk, F.lit(False))
    done = append_columns(docs.where(~is_long), F.col(text), ADDED, short)
    long = _encode_long(docs.where(is_long), shared, text, chunk, overlap)
    return done.unionByName(long)


def _encode_long(docs: DataFrame, shared, text: str, chunk: int, overlap: int) -> DataFrame:
    row, no, start, part = fresh(docs, "_row", "_no", "_start", "_part")
    # Written, so that a row keeps its number when a task runs again.
    docs = cut(docs.withColumn(row, F.monotonically_increasing_id()), "long-texts")
    dealt = (
        docs.select(row, text, F.explode(F.sequence(F.lit(0), F.length(text) - 1, F.lit(chunk))).alias(start))
        .select(row, start, F.col(text).substr(F.col(start) + 1, F.lit(chunk + overlap)).alias(part))
        .repartition(F.col(row), F.col(start))
    )
    pieces = T.StructType(
        [T.StructField("starts", T.BinaryType()), T.StructField("sizes", T.BinaryType()), T.StructField("ids", T.BinaryType())]
    )

    def pretokenise(values) -> Iterator[list[tuple]]:
        encoder = PieceEncoder(shared.value)
        for texts in values:
            out = []
            for t in texts:
                starts, ids = encoder.slice(t)
                out.append((array("I", starts).tobytes(), array("I", map(len, ids)).tobytes(), b"".join(ids)))
            yield out

    def join(group: pa.Table) -> pa.Table:
        encoder, parts = PieceEncoder(shared.value), []
        for r in sorted(group.to_pylist(), key=lambda r: r[start]):
            starts, sizes, at, ids = array("I"), array("I"), 0, []
            starts.frombytes(r["starts"])
            sizes.frombytes(r["sizes"])
            for n in sizes:
                ids.append(r["ids"][at : at + n])
                at += n
            parts.append((r[start], r[part], list(starts), ids))
        ids = stitch(encoder, parts)
        return pa.table({row: [group.column(row)[0].as_py()], "n_tokens": [len(ids) // 4], "ids": pa.array([ids], pa.binary())})

    whole = T.StructType([T.StructField(row, T.LongType()), *ADDED.fields])
    joined = append_columns(dealt, F.col(part), pieces, pretokenise).groupBy(row).applyInArrow(join, whole)
    return docs.join(joined, row).drop(row)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """encoded with `decoded`: the bytes of the tokens, one after the other (null ids: no bytes).

    Bytes, not a string: a cut of the ids need not be valid UTF-8.  An id without a token raises KeyError.
    """
    encoded = encoded.drop("decoded")
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def make(values) -> Iterator[list[tuple]]:
        tokens = {i: b for b, i in shared.value.ranks.items()}
        for batch in values:
            out = []
            for raw in batch:
                own = array("I")
                own.frombytes(raw or b"")
                out.append((b"".join([tokens[i] for i in own]),))
            yield out

    return append_columns(encoded, F.col(ids), T.StructType([T.StructField("decoded", T.BinaryType())]), make)


__all__ = ["CHUNK", "OVERLAP", "SLICE", "PieceEncoder", "Vocabulary", "decode", "encode", "stitch"]
