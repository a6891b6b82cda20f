"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is `window` consecutive words of a benchmark item (all of them for a shorter item).  A block is two words:
a table holds how far the search may move on for each block of the patterns, and any other block lets it move by a
whole pattern but one.  Where the shift is nought, the last and the first block select patterns, and these are compared directly.
Words are numbered, so that tables hold numbers and each item's words once.

Words are as the benchmark contract has them: A-Z in lower case, everything of ASCII but letters and digits parts
words, bytes above 127 belong to words.  A null or empty text has no words and is never hit; an item without words has
no patterns; repeated rows are searched each for itself; columns of the caller pass, whatever their names.
"""

from __future__ import annotations

import uuid
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import takewhile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import append_columns, cut, pack, quoted, unpack

WINDOW = 10
#: Words of benchmark items that are sent to tasks at once (some 300 bytes each there); a larger benchmark goes in several blocks.
BLOCK_WORDS = 400_000
#: Blocks through which the documents go in one job; the state is written after so many.
BLOCKS_A_JOB = 4

PARTING = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(PARTING).split()


class Patterns:
    """All windows of some items: their words as numbers one after the other, and the tables by length of pattern."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.flat, self.offsets, self.items = array("i"), [], []
        self.shift: dict[int, dict[int, int]] = {}
        self.chosen: dict[int, dict[int, list[int]]] = {}
        for item, own in items:
            if own:
                self._add(item, own, min(window, len(own)))

    def _add(self, item: object, own: list[bytes], m: int) -> None:
        base, n, flat, number = len(self.flat), len(own), self.flat, self.number
        flat.extend(number.setdefault(w, len(number)) for w in own)
        self.offsets.append(base)
        self.items.append(item)
        shift, chosen = self.shift.setdefault(m, {}), self.chosen.setdefault(m, {})
        for at in range(base, base + n - 1 if m > 1 else base):
            # The block's last place in any window of the item: at the end of one, or where the first window has it.
            block, move = flat[at] << 32 | flat[at + 1], max(m - 2 - (at - base), 0)
            if move < shift.get(block, m):
                shift[block] = move
        for at in range(base, base + n - m + 1):
            starts = chosen.setdefault(self._select(flat, at, m), [])
            # A window that the item has before is found there already.
            if not any(flat[s : s + m] == flat[at : at + m] for s in takewhile(base.__le__, reversed(starts))):
                starts.append(at)

    @staticmethod
    def _select(numbers, at: int, m: int) -> int:
        if m == 1:
            return numbers[at]
        return numbers[at + m - 2] << 96 | numbers[at + m - 1] << 64 | numbers[at] << 32 | numbers[at + 1]

    def search(self, text: list[bytes], found: dict) -> Iterator[tuple[int, int]]:
        """Yields [start, end) of the patterns' occurrences; puts their items into found."""
        if not self.items:
            return
        number = self.number.get
        own = array("i", [number(w, -1) for w in text])
        for m, chosen in self.chosen.items():
            for at in self._candidates(own, m):
                window, hit = own[at : at + m], False
                for s in chosen.get(self._select(own, at, m), ()):
                    if self.flat[s : s + m] == window:
                        found[self.items[bisect_right(self.offsets, s) - 1]] = hit = True
                if hit:
                    yield at, at + m

    def _candidates(self, own: array, m: int) -> Iterator[int]:
        """Where a pattern of this length may begin."""
        if m == 1:
            yield from (i for i, w in enumerate(own) if w >= 0)
            return
        shift, n, i, most = self.shift[m].get, len(own), m - 1, m - 1
        while i < n:
            a, b = own[i - 1], own[i]
            if a < 0 or b < 0:
                i += most if b >= 0 else m  # an unknown last word lets no pattern reach over it
                continue
            move = shift(a << 32 | b, most)
            if move:
                i += move
                continue
            yield i - m + 1
            i += 1


def _blocks(benchmark: DataFrame, item: str, text: str, window: int, most: int) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of at most `most` words, read one after the other; a longer item in pieces that overlap by a window but one."""
    block, size, most = [], 0, max(most, 2 * window)
    for r in benchmark.select(quoted(item), quoted(text).cast("binary")).toLocalIterator():
        own = words(bytes(r[1] or b""))
        for at in range(0, max(len(own) - window + 1, 1), most - window + 1):
            piece = own[at : at + most]
            if size + len(piece) > most and block:
                yield block
                block, size = [], 0
            block.append((r[0], b" ".join(piece)))
            size += len(piece)
    if block:
        yield block


STATE = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.LongType()))]
)
#: The tables that this worker has made last, by the search they belong to.
_made: dict[str, Patterns] = {}


def _patterns(name: str, block: list[tuple[object, bytes]], window: int) -> Patterns:
    if name not in _made:
        _made.clear()
        _made[name] = Patterns(((i, t.split()) for i, t in block), window)
    return _made[name]


def find_passages(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS, carry: list[str] | None = None,
) -> DataFrame:
    """`doc` (the columns `carry` of docs, all by default), n_words, `hits` (sorted, disjoint [start, end) pairs of word positions, flat) and
    `items` (sorted ids).

    Documents are never shuffled.  The benchmark is read in blocks of bounded size; each document passes all blocks,
    carrying what earlier ones found.  Item ids are integers; null ids are left out of `items`, but their words count.
    """
    spark = docs.sparkSession
    out = pack(docs, carry, own_text=text).withColumn("own_text", F.col("own_text").cast("binary"))

    def step(df: DataFrame, block: list, first: bool, last: bool) -> DataFrame:
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def make(values) -> Iterator[list[tuple]]:
            patterns = _patterns(name, shared.value, window)
            for batch in values:
                rows = []
                for v in batch:
                    raw, hits, items = (v, (), ()) if first else (v["t"], v["h"], v["i"])
                    own, found = words(raw or b""), dict.fromkeys(items)
                    spans = [*zip(hits[::2], hits[1::2], strict=True), *patterns.search(own, found)]
                    merged: list[int] = []
                    for a, b in sorted(spans):
                        if merged and a <= merged[-1]:
                            merged[-1] = max(merged[-1], b)
                        else:
                            merged += (a, b)
                    rows.append((len(own), merged, sorted(i for i in found if i is not None)))
                yield rows

        value = F.col("own_text") if first else F.struct(F.col("own_text").alias("t"), F.col("hits").alias("h"), F.col("items").alias("i"))
        return append_columns(df, value, STATE, make, gone=[*([] if first else STATE.names), *(["own_text"] if last else [])])

    blocks = _blocks(benchmark, item, item_text, window, block_words)
    block, n = next(blocks, []), 0
    while True:
        following = next(blocks, None)
        out = step(out, block, n == 0, following is None)
        if following is None:
            return out
        block, n = following, n + 1
        if n % BLOCKS_A_JOB == 0:
            out = cut(out, "passages")


def flag(found: DataFrame) -> DataFrame:
    """found with n_hit (words inside any occurrence), n_items and contaminated."""
    signed = F.transform("hits", lambda v, i: F.when(i % 2 == 0, -v).otherwise(v))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda s, v: s + v)
    return found.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long")}).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without an occurrence of a benchmark window, with their own columns only."""
    return unpack(flag(find_passages(docs, benchmark, text, window=window)).where(~F.col("contaminated")), docs.columns)
