"""Substring deduplication: every word of a 20-word passage that occurred earlier is removed.

A window's anchor is the one of its 8-word sequences with the smallest hash: about one word in seven starts an anchor, and two equal
windows at different places have equal anchors at different places. Pass one sketches the anchors (``sketch``). Pass two sends on only
the windows whose anchor the merged sketch estimates to be repeated, none of the truly repeated being lost. A piece of some megabytes sends each window once,
with its first place, packed into one row for each bucket of window hashes; its other places are known to be
repeats already. So a window that half of all documents share reaches its bucket once a piece, not once a document.
A bucket finds the first place of each window exactly and sends the places of the others back, packed by
document bucket, where they meet the texts. More anchors than one sketch can hold are split by hash into ranges; each range has a
sketch and a pass two of its own.

Windows are told apart by a 96-bit hash of their words. "Earlier" is a smaller doc_id, or an earlier start in the same document;
a null doc_id counts as the smallest of all. Rows with the same doc_id are each other's equals: what one of them repeats of
the other at the same place is no repeat. Rows are told apart by their number in the scan, so ``docs`` has to be read from a
table or be as repeatable. A null text has no words; texts of fewer than 20 words lose nothing;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sketch import MAX_LOG2_WIDTH, repeated_by_range
from .tables import long_rows, shuffle_partitions, text_bytes, written
from .words import NOT_BLANK, Words, mix, pack, pieces, unpack, words_of

WINDOW = 20
#: Words of the sequences that anchors are chosen from; windows of fewer are their own anchors.
ANCHOR = 8
#: Sketch cells for each anchor expected.
CELLS = 4
#: Text that one document bucket should hold.
BUCKET_BYTES = 4 << 20
NULL_ID = -(1 << 63)


_PLACE_BITS = 30


def anchors(w: Words, hashes: np.ndarray, window: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the anchors of a piece, in order of place, and for each window (start ``at``) which of them is its own."""
    k = min(ANCHOR, window)
    grams, start = w.windows(hashes, k)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    # the upper bits of the hash, then the place: of equal ones the first; all grams of a window lie side by side
    low = (np.uint64(1) << np.uint64(_PLACE_BITS)) - np.uint64(1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, span = 1, window - k + 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    own = (least[np.searchsorted(start, at)] & low).astype(np.int64)
    place = own[np.insert(own[1:] != own[:-1], 0, True)]
    return grams[place], np.searchsorted(place, own)


def _anchor_hashes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in pieces(batches, "text"):
            w = words_of(b.column("text"), NOT_BLANK)
            yield anchors(w, w.hashes(), window, _starts(w, window))[0]

    return run


def _starts(w: Words, window: int) -> np.ndarray:
    """The words that begin a window of one document."""
    size = np.diff(w.first)
    at = np.arange(len(w.starts))
    return at[at + window <= (w.first[:-1] + size)[w.doc]]


def _window_hashes(hashes: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of each window, by two polynomials."""
    one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for j in range(window):
        h = hashes[at + j]
        one = one * np.uint64(0xD6E8FEB86659FD93) + h
        two = two * np.uint64(0x9FB21C651E98DF25) + (h ^ (h >> np.uint64(29)))
    return mix(one), (mix(two) >> np.uint64(32)).astype(np.uint32)


_PLACES = "bucket int, hash binary, more binary, row binary, id binary, start binary"
_FLAGS = "bucket int, row binary, start binary"


def _split(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of an ascending bucket column."""
    if len(bucket):
        first = np.flatnonzero(np.insert(bucket[1:] != bucket[:-1], 0, True))
        for a, b in zip(first.tolist(), np.append(first[1:], len(bucket)).tolist(), strict=True):
            yield int(bucket[a]), slice(a, b)


def _bucket_of_rows(row: np.ndarray, n: int) -> np.ndarray:
    return (mix(row.astype(np.uint64)) % np.uint64(n)).astype(np.int32)


def _heads(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Where a new window begins in sorted ones."""
    return np.insert((hashes[1:] != hashes[:-1]) | (more[1:] != more[:-1]), 0, True)[: len(hashes)]


def remove_repeats(docs: DataFrame, window: int = WINDOW, max_log2: int = MAX_LOG2_WIDTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` for each row of ``docs(doc_id, text)``."""
    long_rows(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.monotonically_increasing_id().alias("row"), "text")
    # numbers of rows are written before they are used: a number that is made anew, after a lost executor or a shuffle that comes in another order, could be another row's
    rows = written(rows, "substring-rows")
    total = text_bytes(rows)
    buckets = max(shuffle_partitions(spark), total // BUCKET_BYTES)

    def places_of(sketch):
        return lambda batches: places(batches, sketch)

    def places(batches: Iterator[pa.RecordBatch], sketch) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            w = words_of(b.column("text"), NOT_BLANK)
            of_word = w.hashes()
            at = _starts(w, window)
            keys, own = anchors(w, of_word, window, at)
            at = at[sketch.value(keys)[own]]
            hashes, more = _window_hashes(of_word, at, window)
            doc = np.searchsorted(w.first, at, "right") - 1
            start = (at - w.first[doc]).astype(np.int32)
            id_, row = b.column("id").to_numpy()[doc], b.column("row").to_numpy()[doc]
            by = np.lexsort((start, id_, more, hashes))
            hashes, more, id_, row, start = hashes[by], more[by], id_[by], row[by], start[by]
            head = _heads(hashes, more)
            # a place equal to the first of its window (the same id and start) is no repeat of it
            lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0)) if len(head) else head
            tied = (id_ == id_[lead]) & (start == start[lead]) if len(head) else head
            out: list[tuple] = []
            bucket = (hashes % np.uint64(buckets)).astype(np.int32)
            send = np.flatnonzero(tied)
            send = send[np.argsort(bucket[send], kind="stable")]
            for k, s in _split(bucket[send]):
                i = send[s]
                out.append((k, pack(hashes[i]), pack(more[i]), pack(row[i]), pack(id_[i]), pack(start[i])))
            late = np.flatnonzero(~tied)
            if len(late):
                spread = (np.arange(len(late)) * 16 // len(late)).astype(np.int32)
                for _, s in _split(spread):
                    i = late[s]
                    # known repeats: no hash; they only pass through some bucket on their way to their texts
                    out.append((int(bucket[i[0]]), b"", b"", pack(row[i]), b"", pack(start[i])))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["bucket", "hash", "more", "row", "id", "start"])

    def joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(map(unpack, column.to_pylist())), kind)

    def resolve(table: pa.Table) -> pa.Table:
        known = pc.equal(pc.binary_length(table.column("hash")), 0)
        late, new = table.filter(known), table.filter(pc.invert(known))
        hashes, more, row, id_, start = (joined(new.column(c), t) for c, t in (("hash", np.uint64), ("more", np.uint32), ("row", np.int64), ("id", np.int64), ("start", np.int32)))
        by = np.lexsort((start, id_, more, hashes))
        hashes, more, row, id_, start = hashes[by], more[by], row[by], id_[by], start[by]
        if len(hashes):
            lead = np.maximum.accumulate(np.where(_heads(hashes, more), np.arange(len(hashes)), 0))
            repeat = (id_ != id_[lead]) | (start != start[lead])
            row, start = row[repeat], start[repeat]
        row, start = np.concatenate([row, joined(late.column("row"), np.int64)]), np.concatenate([start, joined(late.column("start"), np.int32)])
        bucket = _bucket_of_rows(row, buckets)
        by = np.lexsort((row, bucket))
        out = [(k, pack(row[by[s]]), pack(start[by[s]])) for k, s in _split(bucket[by])]
        columns = list(zip(*out, strict=True)) or [[]] * 3
        return pa.table({"bucket": pa.array(columns[0], pa.int32()), "row": pa.array(columns[1], pa.binary()), "start": pa.array(columns[2], pa.binary())})

    found = None
    for sketch in repeated_by_range(rows.select("text"), _anchor_hashes(window), total // 42, CELLS, max_log2):
        part = rows.select("id", "row", "text").mapInArrow(places_of(spark.sparkContext.broadcast(sketch)), _PLACES)
        found = part if found is None else found.unionByName(part)
    flags = found.groupBy("bucket").applyInArrow(resolve, _FLAGS)

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = pa.array([pack(t.as_py().encode()) for t in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(_bucket_of_rows(b.column("row").to_numpy(), buckets)), b.column("doc_id"), b.column("row"), packed], ["bucket", "doc_id", "row", "text"])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        flagged, start = joined(right.column("row"), np.int64), joined(right.column("start"), np.int32)
        by = np.lexsort((start, flagged))
        flagged, start = flagged[by], start[by]
        row = left.column("row").to_numpy()
        lo, hi = np.searchsorted(flagged, row, "left"), np.searchsorted(flagged, row, "right")
        n_words, n_removed, kept = [], [], []
        for text, a, z in zip(left.column("text"), lo.tolist(), hi.tolist(), strict=True):
            words = unpack(text.as_py()).split()
            n_words.append(len(words))
            if a < z:
                s = np.unique(start[a:z])
                edge = np.zeros(len(words) + 1, np.int64)
                edge[s] += 1
                edge[s + window] -= 1
                stay = np.cumsum(edge[:-1]) == 0
                words = list(compress(words, stay.tolist()))
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    texts = rows.mapInArrow(bucketed, "bucket int, doc_id long, row long, text binary")
    return texts.groupBy("bucket").cogroup(flags.groupBy("bucket")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")

