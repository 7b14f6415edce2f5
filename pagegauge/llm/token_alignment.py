"""Cross-tokenizer alignment: which tokens of one tokenizer cover the bytes of which tokens of another, and how usual each pair is.

Both tokenizers write a text as a row of tokens whose bytes, joined, are the text behind one space. Tokens of A and B are intervals over these
bytes. Intervals are coalesced: all are sorted by start, the running maximum of the ends is taken, and a group begins where a start
reaches it, which is where a token of A and one of B both end before. Inside its group each token of A is expanded to the tokens of B that it
overlaps. A pair of ids counts once for each document that links it.

On Spark: documents go through the tokenizers in pieces of bounded bytes, once. A piece is written as one row: facts of its documents, the
distinct pairs of the piece with the number of its documents that link each, and a compressed matrix of documents by pairs. Only (piece, pair)
rows are shuffled: they are summed to corpus-wide counts (combined before the shuffle, so that a pair of all documents is no hot key), the
largest count of each A id is taken (as many rows as A has ids, hence broadcast), and each piece gets back the counts of its own pairs, at most as
many as its bytes allow. No document's links are shuffled.

A long text is cut for encoding where a space stands between two signs that are no white space, if no token of B holds a space behind another sign:
tokens of neither vocabulary cross such a place (B's pieces hold spaces only in front; A's words begin there). So memory follows the cut, not
the text.

Nulls: a null or empty text, and one whose joined tokens of A or B differ from space + text (a sign that B replaces), has no tokens: zeros and an
empty hash. Rows that repeat a doc_id, or have none, are judged one by one, each as a document of its own in the counts. Extra columns are
dropped. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from .tables import discard, long_rows, written
from .words import pack, unpack

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Signs that are encoded at a time, and bytes of the texts of one written row; a longer document has a row of its own.
CUT, SOME, PIECE_BYTES = 1 << 16, 1 << 20, 8 << 20
#: A pair of ids is one number, A's id before B's; vocabularies are smaller than this many bits tell, and so are the documents of SOME bytes.
_BITS, _ROWS = 20, 1 << 16
_FACTS = ("n_a", "n_b", "n_groups", "n_links")


@dataclass(frozen=True)
class Tokenizers:
    a: object
    b: object
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    a_sizes: np.ndarray
    b_sizes: np.ndarray
    cuts: bool  # whether long texts may be cut

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        parts = [_cut(t) if self.cuts else [t] for t in texts]
        flat = [p for x in parts for p in x]
        a = [e.ids for e in self.a.encode_batch_fast([f" {p}" for p in flat], add_special_tokens=False)]
        b = self.b.encode(flat, num_threads=1)
        out, at = ([], []), 0
        for x in parts:
            for side, ids in zip(out, (a, b), strict=True):
                side.append(ids[at] if len(x) == 1 else [i for one in ids[at : at + len(x)] for i in one])
            at += len(x)
        return out


def _byte_signs() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as its own sign and the others as the signs from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def tokenizers(a_file: str, b_file: str) -> Tokenizers:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(a_file)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_file)
    signs = _byte_signs()
    a_bytes = [bytes(signs[c] for c in token) if token and all(c in signs for c in token) else (token or "").encode() for token in map(a.id_to_token, range(a.get_vocab_size()))]
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    b_bytes = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    cuts = not any("▁" in p.lstrip("▁") for p in pieces)
    if max(len(a_bytes), len(b_bytes)) > 1 << _BITS:
        raise ValueError("a vocabulary is too large")
    sizes = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a_bytes, b_bytes))
    return Tokenizers(a, b, a_bytes, b_bytes, *sizes, cuts)


def _cut(text: str, size: int = CUT) -> list[str]:
    """Parts of a text without the single spaces between them; each begins behind a space, as the text itself does."""
    out, at = [], 0
    while len(text) - at > size:
        i = at + size
        # a space between two signs that are no white space, of the ASCII kind on both sides
        while i < len(text) - 1 and not (text[i] == " " and "!" <= text[i - 1] <= "~" and "!" <= text[i + 1] <= "~"):
            i += 1
        if i >= len(text) - 1:
            break
        out.append(text[at:i])
        at = i + 1
    return [*out, text[at:]]


def _picked(ids: list[int], values: list) -> tuple:
    """``values`` at ``ids``, without a step of Python for each."""
    return itemgetter(*ids)(values) if len(ids) > 1 else tuple(values[i] for i in ids)


@dataclass
class Aligned:
    """Tokens of some documents, one behind the other; ``first`` has where each document's begin."""

    a: np.ndarray
    b: np.ndarray
    a_first: np.ndarray
    b_first: np.ndarray
    order: np.ndarray  # all tokens, A's numbers before B's, by start
    group: np.ndarray  # in that order
    starts: np.ndarray  # byte offsets, in that order
    a_links: np.ndarray  # links as numbers of tokens
    b_links: np.ndarray

    @property
    def n(self) -> int:
        return len(self.a_first) - 1


def align(texts: list[str | None], t: Tokenizers) -> Aligned:
    texts = [x or "" for x in texts]
    a_ids, b_ids = t.encode(texts)
    for d, x in enumerate(texts):
        whole = f" {x}".encode("utf-8", "surrogatepass")
        if not x or b"".join(_picked(a_ids[d], t.a_bytes)) != whole or b"".join(_picked(b_ids[d], t.b_bytes)) != whole:
            a_ids[d], b_ids[d] = [], []
    sides = []
    for ids, sizes in ((a_ids, t.a_sizes), (b_ids, t.b_sizes)):
        flat = np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))
        ends = np.cumsum(sizes[flat])
        sides.append((flat, np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]), np.concatenate([[0], ends])[:-1], ends))
    (a, a_first, a_start, a_end), (b, b_first, b_start, b_end) = sides
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((start,))  # stable: of equal starts A's token is first
    start, end = start[order], end[order]
    breaks = np.ones(len(start), bool)
    breaks[1:] = start[1:] >= np.maximum.accumulate(end)[:-1]
    group = np.cumsum(breaks) - 1
    low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    n = high - low
    a_links = np.repeat(np.arange(len(a)), n)
    b_links = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return Aligned(a, b, a_first, b_first, order, group, start, a_links, b_links)


@lru_cache(maxsize=1)
def _decimals(n: int) -> list[str]:
    """Of an id and what stands behind it, by id * 3 + 0 for a comma, 1 for the change of sides, 2 for the end of a group."""
    return [f"{i}{sign}" for i in range(n) for sign in ",|;"]


def group_texts(x: Aligned) -> list[str]:
    """Of each document ``a1,a2|b1;a3|b2,b3``."""
    side = (x.order >= len(x.a)).astype(np.int64)
    key = x.group * 2 + side
    place = np.argsort(key, kind="stable")
    key, token = key[place], x.order[place]
    ids = np.concatenate([x.a, x.b])[token]
    step = np.full(len(key), 2, np.int64)
    step[:-1] = np.where(key[1:] == key[:-1], 0, np.where(key[1:] // 2 == key[:-1] // 2, 1, 2))
    codes = (ids * 3 + step).tolist()
    signs = _decimals(int(ids.max()) // 1024 * 1024 + 1024) if len(ids) else []
    first = x.a_first + x.b_first
    return ["".join(_picked(codes[first[d] : first[d + 1]], signs))[:-1] for d in range(x.n)]


def _facts(x: Aligned) -> dict[str, np.ndarray]:
    first = x.a_first + x.b_first
    begins = np.concatenate([[0], np.cumsum(np.diff(x.group, prepend=-1) > 0)]) if len(x.group) else np.zeros(1, np.int64)
    upto = np.searchsorted(x.a_links, x.a_first)
    return {"n_a": np.diff(x.a_first), "n_b": np.diff(x.b_first), "n_groups": begins[first[1:]] - begins[first[:-1]], "n_links": np.diff(upto)}


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, int]]:
    """Ids and texts of about SOME bytes, over the ends of batches, with their bytes."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            if texts and (size + len(text or "") > SOME or len(ids) >= _ROWS):
                yield ids, texts, size
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(text)
            size += len(text or "")
    if ids:
        yield ids, texts, size


def _matrix(x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, times) of the distinct pairs of each document, sorted."""
    doc = np.repeat(np.arange(x.n), np.diff(np.searchsorted(x.a_links, x.a_first)))
    # one number for each, so that one sort of numbers serves
    key, times = np.unique((doc << 2 * _BITS) | (x.a[x.a_links] << _BITS) | x.b[x.b_links], return_counts=True)
    return key >> 2 * _BITS, key & ((1 << 2 * _BITS) - 1), times


def _deltas(x: np.ndarray) -> bytes:
    return pack(np.diff(x.astype(np.int64), prepend=0))


def _undeltas(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(unpack(data), np.int64))


def _written_pieces(a_file: str, b_file: str, kind: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(a_file, b_file)
        number = TaskContext.get().partitionId() << 32
        held: dict[str, list] = {}
        size = n = 0

        def row() -> pa.RecordBatch:
            doc, pair, times = (np.concatenate(held[k]) if held[k] else np.empty(0, np.int64) for k in ("doc", "pair", "times"))
            pairs, column, in_docs = np.unique(pair, return_inverse=True, return_counts=True)
            one = {k: held[k] for k in ("doc_id", *_FACTS, "groups_sha256")}
            one |= {"piece": number, "pairs": _deltas(pairs), "in_docs": pack(in_docs.astype(np.int32)), "docs": _deltas(doc), "columns": pack(column.astype(np.int32)), "times": pack(times.astype(np.int32))}
            return pa.RecordBatch.from_pylist([one], kind)

        for ids, texts, some in _some(batches):
            if n and size + some > PIECE_BYTES:
                yield row()
                number, size, n, held = number + 1, 0, 0, {}
            x = align(texts, t)
            doc, pair, times = _matrix(x)
            found = {k: v.tolist() for k, v in _facts(x).items()}
            found |= {"doc_id": ids, "groups_sha256": [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in group_texts(x)]}
            for k, v in found.items():
                held.setdefault(k, []).extend(v)
            for k, v in (("doc", doc + n), ("pair", pair), ("times", times)):
                held.setdefault(k, []).append(v)
            size, n = size + some, n + len(ids)
        if n:
            yield row()

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each piece with the number of its documents that link them."""
    for b in batches:
        for piece, pairs, in_docs in zip(*(b.column(c).to_pylist() for c in ("piece", "pairs", "in_docs")), strict=True):
            pair = _undeltas(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), piece)), pa.array(pair), pa.array(np.frombuffer(unpack(in_docs), np.int32).astype(np.int64))], ["piece", "pair", "docs"])


def _weighed(kind: pa.Schema):
    """The rows of a piece's documents, from the piece and the counts of its pairs."""

    def run(piece: pa.Table, counts: pa.Table) -> pa.Table:
        one = piece.to_pylist()[0]
        known = counts.column("pair").to_numpy()
        order = np.argsort(known)
        pairs = _undeltas(one["pairs"])
        if len(known) != len(pairs) or not np.array_equal(known[order], pairs):
            raise ValueError("a piece lacks the counts of its pairs")
        column, times = (np.frombuffer(unpack(one[c]), np.int32).astype(np.int64) for c in ("columns", "times"))
        doc = _undeltas(one["docs"])
        first = np.searchsorted(doc, np.arange(len(one["doc_id"]) + 1))
        out = {k: one[k] for k in ("doc_id", *_FACTS, "groups_sha256")}
        for name, weight in (("n_best", counts.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)), ("count_sum", counts.column("docs").to_numpy()[order])):
            upto = np.concatenate([[0], np.cumsum(weight[column] * times)])
            out[name] = upto[first[1:]] - upto[first[:-1]]
        return pa.table({f.name: pa.array(out[f.name], f.type) for f in kind}, kind)

    return run


def aligned_documents(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: tokens, groups, links, and how usual the links are in the whole corpus."""
    spark = docs.sparkSession
    long_rows(spark)
    narrow = docs.select("doc_id", "text")
    key = narrow.schema["doc_id"]
    facts = StructType.fromDDL(", ".join(f"{c} long" for c in _FACTS) + ", groups_sha256 string")
    piece = StructType([StructField(f.name, ArrayType(f.dataType)) for f in (key, *facts)] + list(StructType.fromDDL("piece long, pairs binary, in_docs binary, docs binary, columns binary, times binary")))
    pieces = written(narrow.mapInArrow(_written_pieces(a_file, b_file, to_arrow_schema(piece)), piece), "token-pieces")
    own = written(pieces.select("piece", "pairs", "in_docs").mapInArrow(_pairs, "piece long, pair long, docs long"), "token-pairs")
    total = own.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.shiftright("pair", _BITS))
    total = written(total, "token-totals")
    # at most one row for each id of A's vocabulary
    most = total.groupBy("a").agg(F.max("docs").alias("most"))
    judged = total.join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    counts = own.select("piece", "pair").join(judged, "pair")
    out = StructType([StructField("doc_id", key.dataType), *facts, *StructType.fromDDL("n_best long, count_sum long")])
    done = pieces.groupBy("piece").cogroup(counts.groupBy("piece")).applyInArrow(_weighed(to_arrow_schema(out)), out)
    done = written(done, "token-documents")
    discard(pieces, own, total)
    return done


def aligned_groups(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """The groups themselves: ``doc_id, start, a_ids, b_ids``, ``start`` a byte offset into space + text; documents without tokens have none."""
    narrow = docs.select("doc_id", "text")
    schema = StructType([StructField("doc_id", narrow.schema["doc_id"].dataType), *StructType.fromDDL("start long, a_ids array<long>, b_ids array<long>")])
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(a_file, b_file)
        for ids, texts, _ in _some(batches):
            x = align(texts, t)
            first = x.a_first + x.b_first
            begins = np.flatnonzero(np.diff(x.group, prepend=-1))
            doc = np.searchsorted(first, begins, "right") - 1
            bases = x.starts[np.minimum(first[:-1], max(len(x.starts) - 1, 0))] if len(x.starts) else np.zeros(x.n, np.int64)
            is_b = x.order >= len(x.a)
            token = np.concatenate([x.a, x.b])[x.order]
            sides = []
            for own in (~is_b, is_b):
                sizes = np.bincount(x.group[own], minlength=len(begins))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                sides.append(pa.ListArray.from_arrays(offsets, pa.array(token[own])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind.field("doc_id").type).take(pa.array(doc)), pa.array(x.starts[begins] - bases[doc]), *(s.cast(kind.field(n).type) for s, n in zip(sides, ("a_ids", "b_ids"), strict=True))], schema=kind)

    return narrow.mapInArrow(run, schema)
