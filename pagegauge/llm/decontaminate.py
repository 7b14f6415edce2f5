"""Benchmark decontamination with suffix arrays of the training text.

Each task cuts its documents into shards of some megabytes, sorts the word suffixes of a shard (prefix doubling,
to the depth of the longest test item) and binary-searches every suffix of every test item in it, one word
deeper at a time. A search that is still alive after ``window`` words has found verbatim occurrences; where it
dies is the longest verbatim match, and the interval it had before names the locations. Nothing is shuffled:
a document lies in one shard, so its verdict is made where it is read.

The test set is the stated query set. It is sent to the tasks in blocks of at most ``BLOCK_BYTES`` of text; more
than one block takes the longer way, a pass for each block and one shuffle that merges the hits of a document.

Nulls: a null text has no words; a null item text has no window. Empty texts and tables give no hits. Rows that
repeat are judged one by one. Extra columns are passed through by ``decontaminate`` whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import long_rows, written
from .words import LETTERS_DIGITS, LOWER, pieces, words_of

WINDOW = 13
#: A document is contaminated when at least this share of its words is hit (1 / 20).
SHARE = (1, 20)
BLOCK_BYTES = 16 << 20

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_item string, longest_start long"


@dataclass
class Tests:
    """Words of a block of test items, one after the other."""

    ids: list[str]
    words: np.ndarray  # hashes
    item: np.ndarray  # the item of each word
    left: np.ndarray  # words from here to the end of the item
    need: np.ndarray  # words of the window that starts here; 0: none starts here


def tests_of(ids: list, texts: pa.Array, window: int) -> Tests:
    w = words_of(texts, LETTERS_DIGITS, LOWER)
    size = np.diff(w.first)
    item = w.doc
    left = w.first[1:][item] - np.arange(len(item))
    need = np.where(left >= window, window, np.where((size[item] < window) & (left == size[item]), left, 0))
    return Tests([str(i) for i in ids], w.hashes(), item, left, need)


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by the ``depth`` symbols that start there (the end of the array sorts first)."""
    n = len(ids)
    order = np.argsort(ids)
    rank = np.empty(n, np.int64)
    ordered = ids[order]
    rank[order] = np.searchsorted(ordered, ordered)
    h = 1
    while h < depth:
        ranks = rank[order]
        new = np.append(ranks[1:] != ranks[:-1], True)
        todo = np.flatnonzero(~(new & np.insert(new[:-1], 0, True)))
        if not len(todo):
            break
        pos = order[todo]
        key = ranks[todo] * (n + 1) + np.where(pos + h < n, rank[np.minimum(pos + h, n - 1)] + 1, 0)
        by = np.argsort(key)
        pos, key = pos[by], key[by]
        order[todo] = pos
        first = np.insert(key[1:] != key[:-1], 0, True)
        rank[pos] = todo[np.maximum.accumulate(np.where(first, np.arange(len(todo)), 0))]
        h *= 2
    return order


def _bound(ids: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray, depth: int, after: bool) -> np.ndarray:
    """In order[lo:hi], the first suffix whose symbol at ``depth`` is not below (``after``: is above) the given one."""
    lo, hi, last = lo.copy(), hi.copy(), len(ids) - 1
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        at = order[np.minimum(mid, last)] + depth
        here = np.where(at <= last, ids[np.minimum(at, last)], -1)
        below = open_ & ((here <= symbol) if after else (here < symbol))
        lo = np.where(below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)
    return lo


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of the intervals, and the interval each belongs to."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), which


def search(hashes: np.ndarray, first: np.ndarray, tests: Tests) -> tuple[np.ndarray, ...]:
    """Occurrences of windows in a shard, and the longest matches.

    Gives (word position, test word) of every window occurrence, and (word position, test word, words) of the
    longest verbatim match of each test suffix that holds a window, at each of its locations.
    """
    none = np.empty(0, np.int64)
    if not len(hashes) or not len(tests.words):
        return none, none, none, none, none
    known, ids = np.unique(hashes, return_inverse=True)
    docs = len(first) - 1
    # a separator, symbol 0, follows each document: no match goes across it
    spaced = np.zeros(len(hashes) + docs, np.int64)
    place = np.arange(len(hashes)) + np.repeat(np.arange(docs), np.diff(first))
    spaced[place] = ids + 1
    back = np.zeros(len(spaced), np.int64)
    back[place] = np.arange(len(hashes))
    at = np.minimum(np.searchsorted(known, tests.words), len(known) - 1)
    symbol = np.where(known[at] == tests.words, at + 1, -1)
    order = suffix_array(spaced, int(tests.left.max()))

    alive = np.flatnonzero(symbol > 0)
    lo = np.zeros(len(alive), np.int64)
    hi = np.full(len(alive), len(spaced), np.int64)
    found, longest = [], []
    depth = 0
    while len(alive):
        more = (tests.left[alive] > depth) & (symbol[np.minimum(alive + depth, len(symbol) - 1)] > 0)
        new_lo, new_hi = lo.copy(), lo.copy()
        s = symbol[alive[more] + depth]
        new_lo[more] = _bound(spaced, order, lo[more], hi[more], s, depth, False)
        new_hi[more] = _bound(spaced, order, new_lo[more], hi[more], s, depth, True)
        live = new_hi > new_lo
        over = ~live & (tests.need[alive] > 0) & (tests.need[alive] <= depth)
        longest.append((alive[over], lo[over], hi[over], depth))
        alive, lo, hi = alive[live], new_lo[live], new_hi[live]
        depth += 1
        now = tests.need[alive] == depth
        found.append((alive[now], lo[now], hi[now]))
    member, which = _spread(np.concatenate([x[1] for x in found] or [none]), np.concatenate([x[2] for x in found] or [none]))
    where, test = back[order[member]], np.concatenate([x[0] for x in found] or [none])[which]
    member, which = _spread(np.concatenate([x[1] for x in longest] or [none]), np.concatenate([x[2] for x in longest] or [none]))
    words = np.concatenate([np.full(len(x[0]), x[3]) for x in longest] or [none])
    return where, test, back[order[member]], np.concatenate([x[0] for x in longest] or [none])[which], words[which]


def _judge(n_words: np.ndarray, n_hit: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    return (n_hit > 0) & (share[1] * n_hit >= share[0] * n_words)


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching intervals made one; starts ascend."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.flatnonzero(np.insert(starts[1:] > reach[:-1], 0, True))
    return starts[new], reach[np.append(new[1:] - 1, len(starts) - 1)]


def judge_piece(texts: pa.Array, tests: Tests, share: tuple[int, int] = SHARE) -> dict[str, list | np.ndarray]:
    """The verdicts of a piece; intervals and items are those of each document."""
    w = words_of(texts, LETTERS_DIGITS, LOWER)
    first = w.first
    where, test, top_at, top_test, top_words = search(w.hashes(), first, tests)
    n_docs = len(first) - 1
    by = np.argsort(where, kind="stable")
    starts, ends = _merged(where[by], (where + tests.need[test])[by])
    # a window never leaves its document, but windows of neighbouring documents can touch
    doc = np.searchsorted(first, where, "right") - 1
    covered = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(covered, where, 1)
    np.add.at(covered, where + tests.need[test], -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    n_hit = hit[first[1:]] - hit[first[:-1]]
    n_words = np.diff(first)
    items: list[set[str]] = [set() for _ in range(n_docs)]
    for d, i in np.unique(np.stack([doc, tests.item[test]], 1), axis=0).tolist() if len(doc) else []:
        items[d].add(tests.ids[i])
    longest, item, start = np.zeros(n_docs, np.int64), [None] * n_docs, [None] * n_docs
    top_doc = np.searchsorted(first, top_at, "right") - 1
    # of equal matches the first in the document, then the item of the smallest name
    by_name = np.unique(np.array(tests.ids, object), return_inverse=True)[1]
    for k in np.lexsort((by_name[tests.item[top_test]] if len(top_test) else top_test, top_at, -top_words)).tolist():
        d = int(top_doc[k])
        if not longest[d]:
            longest[d], item[d], start[d] = top_words[k], tests.ids[tests.item[top_test[k]]], int(top_at[k] - first[d])
    spans = [b""] * n_docs
    for d in np.flatnonzero(n_hit).tolist():
        own = slice(int(np.searchsorted(ends, first[d], "right")), int(np.searchsorted(starts, first[d + 1])))
        cut = np.stack([np.maximum(starts[own], first[d]), np.minimum(ends[own], first[d + 1])], 1) - first[d]
        spans[d] = cut.astype(np.int64).tobytes()
    return {"n_words": n_words, "n_hit": n_hit, "items": items, "longest": longest, "item": item, "start": start, "spans": spans, "contaminated": _judge(n_words, n_hit, share)}


def _columns(x: dict, share: tuple[int, int]) -> list[pa.Array]:
    digests = [hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for s in x["items"]]
    return [
        pa.array(np.asarray(x["n_words"], np.int64)),
        pa.array(np.asarray(x["n_hit"], np.int64)),
        pa.array([len(s) for s in x["items"]], pa.int64()),
        pa.array(digests, pa.string()),
        pa.array(_judge(np.asarray(x["n_words"]), np.asarray(x["n_hit"]), share)),
        pa.array(np.asarray(x["longest"], np.int64)),
        pa.array(x["item"], pa.string()),
        pa.array(x["start"], pa.int64()),
    ]


def test_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Tests]:
    """The test set in blocks of about ``block_bytes`` of text, each brought to the driver on its own."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").where("id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        t = items.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k).toArrow()
        yield tests_of(t.column("id").to_pylist(), t.column("text"), window)


def _names(docs: DataFrame) -> tuple[str, str]:
    return docs.select("doc_id").schema[0].name, docs.select("text").schema[0].name


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: tuple[int, int] = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id`` and RESULT for each document: words hit, items found, the verdict, and the longest verbatim match."""
    long_rows(docs.sparkSession)
    spark = docs.sparkSession
    blocks = test_blocks(benchmark, window, block_bytes)
    narrow = docs.select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()

    first, more = next(blocks), next(blocks, None)
    known = spark.sparkContext.broadcast(first)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            out = _columns(judge_piece(b.column(1), known.value, share), share)
            yield pa.RecordBatch.from_arrays([b.column(0), *out], ["doc_id", *(x.split()[0] for x in RESULT.split(", "))])

    if more is None:
        return narrow.mapInArrow(whole, f"doc_id {kind}, {RESULT}")

    # rows are told apart by a number of their own, so documents that share an id are judged one by one
    rows = written(narrow.withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows")
    return _in_blocks(rows, chain([first, more], blocks), share).drop("row")


def _in_blocks(rows: DataFrame, blocks: Iterable[Tests], share: tuple[int, int]) -> DataFrame:
    """``row, doc_id`` and RESULT for each row of ``rows(row, doc_id, text)``, searched for each block of the test set and merged.

    A block's hits are written before the next block is brought to the driver, so one block at a time is held.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def part(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, "text"):
                x = judge_piece(b.column("text"), block.value, share)
                parts = [pa.array(np.asarray(x["n_words"], np.int64)), pa.array(x["spans"], pa.binary()), pa.array([sorted(s) for s in x["items"]], pa.list_(pa.string())), pa.array(x["longest"]), pa.array(x["item"], pa.string()), pa.array(x["start"], pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), *parts], ["row", "doc_id", "n_words", "spans", "items", "longest", "item", "start"])

        return run

    schema = f"row long, doc_id {kind}, n_words long, spans binary, items array<string>, longest long, item string, start long"
    found = None
    for block in blocks:
        sent = rows.sparkSession.sparkContext.broadcast(block)
        one = written(rows.mapInArrow(part(sent), schema), "decontaminate-hits")
        sent.unpersist()
        found = one if found is None else found.unionByName(one)
    per = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.min(F.struct((-F.col("longest")).alias("l"), "start", "item")).alias("top"),
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = []
            for spans in b.column("spans").to_pylist():
                x = np.concatenate([np.frombuffer(s, np.int64).reshape(-1, 2) for s in spans])
                starts, ends = _merged(*x[np.argsort(x[:, 0], kind="stable")].T)
                hits.append(int((ends - starts).sum()))
            top = b.column("top").to_pylist()
            x = {"n_words": b.column("n_words").to_numpy(), "n_hit": np.array(hits, np.int64), "items": [set(i) for i in b.column("items").to_pylist()], "longest": [-t["l"] for t in top], "item": [t["item"] for t in top], "start": [t["start"] for t in top]}
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), *_columns(x, share)], ["row", "doc_id", *(c.split()[0] for c in RESULT.split(", "))])

    return per.mapInArrow(merge, f"row long, doc_id {kind}, {RESULT}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: tuple[int, int] = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without its contaminated rows, all columns kept."""
    long_rows(docs.sparkSession)
    spark = docs.sparkSession
    text = docs.columns.index("text")
    blocks = test_blocks(benchmark, window, block_bytes)
    first, more = next(blocks), next(blocks, None)
    if more is not None:
        number = "number of the row"
        rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "decontaminate-rows")
        judged = _in_blocks(rows.select(F.col(number).alias("row"), "doc_id", "text"), chain([first, more], blocks), share)
        return rows.join(judged.where("contaminated").select(F.col("row").alias(number)), number, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))

    known = spark.sparkContext.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            yield b.filter(pa.array(~judge_piece(b.column(text), known.value, share)["contaminated"]))

    return docs.mapInArrow(run, docs.schema)
