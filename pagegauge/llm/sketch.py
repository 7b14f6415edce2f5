"""A count-min sketch that knows three counts, 0, 1 and more, as bitmaps.

Each task sketches its own rows; the partition sketches are merged block by block with saturating addition,
in two levels: a lane of some dozens of them first, then the lanes. What is left is one bit
a cell: "two or more". At most ``DEPTH * 2**max_log2`` bits (64 MB by default) are sent to the tasks at once: keys that would
fill more than half of that are split by hash into ranges, each with a sketch of its own (``repeated_by_range``), which the caller
uses one after the other. A sketch calls some single keys repeated; it never calls a repeated key single.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .words import mix, pack, unpack

DEPTH = 2
MIN_LOG2_WIDTH, MAX_LOG2_WIDTH = 20, 28  # at least 10, for the blocks
_BLOCKS = 128
#: Partition sketches that one task merges.
_LANE = 64


def log2_width(keys: int, cells: int = 2, max_log2: int = MAX_LOG2_WIDTH) -> int:
    """About so many cells for each expected key, within the bounds."""
    return min(max_log2, max(min(MIN_LOG2_WIDTH, max_log2), round(math.log2(cells * keys + 1))))


def ranges(keys: int, max_log2: int = MAX_LOG2_WIDTH) -> int:
    """Ranges of so many keys that each key has two cells of the widest sketch."""
    return max(1, -(-2 * keys >> max_log2))


def _of_range(keys: np.ndarray, part: int, parts: int) -> np.ndarray:
    return keys if parts == 1 else keys[mix(keys ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(parts) == np.uint64(part)]


def _cells(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(keys + np.uint64(0x632BE59BD9B4E019 * (row + 1) & (1 << 64) - 1)) >> np.uint64(64 - width)).astype(np.uint32)


def _set(bitmap: np.ndarray, cells: np.ndarray) -> None:
    """Sets the bits of distinct ascending cells."""
    if len(cells):
        byte = cells >> 3
        first = np.flatnonzero(np.insert(byte[1:] != byte[:-1], 0, True))
        bitmap[byte[first]] |= np.bitwise_or.reduceat(np.left_shift(1, cells & 7).astype(np.uint8), first)


class Counts:
    """One and two-or-more bitmaps of a task."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.one = np.zeros((DEPTH, (1 << width) // 8), np.uint8)
        self.more = np.zeros_like(self.one)

    def add(self, keys: np.ndarray) -> None:
        for row in range(DEPTH):
            cells = np.sort(_cells(keys, row, self.width))
            if not len(cells):
                continue
            new = np.insert(cells[1:] != cells[:-1], 0, True)
            distinct, again = cells[new], cells[1:][~new[1:]]
            again = again[np.insert(again[1:] != again[:-1], 0, True)] if len(again) else again
            one, more = self.one[row], self.more[row]
            seen = distinct[(one[distinct >> 3] >> (distinct & 7).astype(np.uint8)) & 1 == 1]
            _set(more, seen)
            _set(more, again)
            _set(one, distinct)

    def blocks(self, lane: int) -> pa.RecordBatch:
        """Non-empty blocks, compressed."""
        step = self.one.shape[1] // _BLOCKS
        rows = []
        for row in range(DEPTH):
            for b in range(_BLOCKS):
                one = self.one[row, b * step : (b + 1) * step]
                if one.any():
                    rows.append((row * _BLOCKS + b, lane, pack(one), pack(self.more[row, b * step : (b + 1) * step])))
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], ["block", "lane", "one", "more"])


SCHEMA = "block int, lane int, one binary, more binary"


def _merge(table: pa.Table) -> pa.Table:
    one = more = None
    for a, b in zip(table.column("one"), table.column("more"), strict=True):
        a, b = (np.frombuffer(unpack(x.as_py()), np.uint8) for x in (a, b))
        more = b if more is None else more | b | (one & a)
        one = a if one is None else one | a
    return pa.table({"block": table.column("block").slice(0, 1), "lane": table.column("lane").slice(0, 1), "one": [pack(one)], "more": [pack(more)]})


class Repeated:
    """The merged sketch: which keys are estimated to occur more than once."""

    def __init__(self, width: int, blocks: dict[int, bytes], part: int = 0, parts: int = 1) -> None:
        self.width, self.blocks, self.part, self.parts = width, blocks, part, parts
        self._bits: np.ndarray | None = None

    def __getstate__(self) -> tuple:
        return self.width, self.blocks, self.part, self.parts

    def __setstate__(self, state: tuple) -> None:
        self.width, self.blocks, self.part, self.parts = state
        self._bits = None

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if self._bits is None:
            step = (1 << self.width) // 8 // _BLOCKS
            bits = np.zeros((DEPTH, _BLOCKS, step), np.uint8)
            for b, packed in self.blocks.items():
                bits[b // _BLOCKS, b % _BLOCKS] = np.frombuffer(unpack(packed), np.uint8)
            self._bits, self.blocks = bits.reshape(DEPTH, -1), {}
        out = np.ones(len(keys), bool)
        if self.parts > 1:
            out = mix(keys ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(self.parts) == np.uint64(self.part)
        for row in range(DEPTH):
            at = np.flatnonzero(out)
            cells = _cells(keys[at], row, self.width)
            out[at] = (self._bits[row][cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1
        return out


Keys = Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]


def _sketched(rows: DataFrame, keys_of: Keys, width: int, part: int, parts: int) -> Repeated:
    tasks = rows.rdd.getNumPartitions()
    lanes = -(-tasks // _LANE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(width)
        for keys in keys_of(batches):
            counts.add(_of_range(keys, part, parts))
        yield counts.blocks(TaskContext.get().partitionId() % lanes)

    # the task's blocks, then each block's lanes, then the lanes
    merged = rows.mapInArrow(run, SCHEMA).groupBy("block", "lane").applyInArrow(_merge, SCHEMA).groupBy("block").applyInArrow(_merge, SCHEMA)
    return Repeated(width, {r["block"]: bytes(r["more"]) for r in merged.select("block", "more").collect()}, part, parts)


def repeated(rows: DataFrame, keys_of: Keys, expected: int) -> Repeated:
    """One merged sketch of the keys that ``keys_of`` takes from the Arrow batches of ``rows``, however many they are."""
    return _sketched(rows, keys_of, log2_width(expected), 0, 1)


def repeated_of_range(rows: DataFrame, keys_of: Keys, width: int, part: int, parts: int) -> Repeated:
    """A merged sketch of the given width for one range of the keys; it says no to the others."""
    return _sketched(rows, keys_of, width, part, parts)


def repeated_by_range(rows: DataFrame, keys_of: Keys, expected: int, cells: int = 2, max_log2: int = MAX_LOG2_WIDTH) -> Iterator[Repeated]:
    """A merged sketch for each range of the keys; each says no to the keys of the others."""
    parts = ranges(expected, max_log2)
    width = log2_width(-(-expected // parts), cells, max_log2)
    for part in range(parts):
        yield _sketched(rows, keys_of, width, part, parts)
