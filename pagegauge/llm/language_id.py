"""Language identification by prediction by partial matching.

For each language a byte context tree up to order 3 is counted on a bounded sample of labelled documents and
then frozen. The code length of a byte is that of the longest context that knows it; each longer context that
does not pays its escape (method C: q distinct followers after n occurrences give count/(n+q) and escape q/(n+q);
below order 0 all 256 bytes are equal). A text gets the language whose tree codes it in the fewest bits.

Frozen statistics make the cost a function of four bytes, so each task codes its distinct 4-grams once for each
language and sums over all positions of every whole text; nothing is shuffled. A-Z are folded.

Nulls: a null text, or one without a letter, is ``und`` with score 0; rows with null lang or null doc_id are
not learned from, nor are labels beyond the ``MAX_LANGUAGES`` with the most text. With nothing to learn from, every text is ``und``. Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import long_rows
from .words import LOWER, pieces

#: Bytes of text learned from for each language, expected; longer texts are drawn from by pieces of so many characters.
TRAIN_BYTES = 3 << 20
PIECE_CHARS = 1 << 16
#: Trees are grown for so many labels, those with the most text.
MAX_LANGUAGES = 512
UNDETERMINED = "und"
FOLDS = 5
RESULT = "lang_pred string, score double, bits_per_byte double"


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each byte, three newlines standing before each text; where each text begins."""
    texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = LOWER[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw is not None else np.empty(0, np.uint8)
    offsets -= offsets[0]
    size = np.diff(offsets)
    place = np.arange(len(data)) + np.repeat(3 * np.arange(1, len(size) + 1), size)
    padded = np.full(len(data) + 3 * len(size), 10, np.uint32)
    padded[place] = data
    return (padded[place - 3] << np.uint32(24)) | (padded[place - 2] << np.uint32(16)) | (padded[place - 1] << np.uint32(8)) | padded[place], offsets


@dataclass
class Tree:
    """Code lengths in bits, of one language."""

    order1: np.ndarray  # by the last two bytes, lower orders included
    escape2: np.ndarray  # by the two bytes before
    keys2: np.ndarray
    bits2: np.ndarray
    contexts3: np.ndarray
    escape3: np.ndarray
    keys3: np.ndarray
    bits3: np.ndarray

    def bits(self, grams: np.ndarray) -> np.ndarray:
        cost = self.order1[grams & np.uint32(0xFFFF)]
        low = grams & np.uint32(0xFFFFFF)
        for keys, bits, gram, escape in (
            (self.keys2, self.bits2, low, self.escape2[low >> np.uint32(8)]),
            (self.keys3, self.bits3, grams, self._escape3(grams >> np.uint32(8))),
        ):
            at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            cost = np.where(keys[at] == gram, bits[at], cost + escape)
        return cost

    def _escape3(self, context: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.contexts3, context), len(self.contexts3) - 1)
        return np.where(self.contexts3[at] == context, self.escape3[at], 0.0)


def _level(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of sorted (context, byte) grams: bits of each, the contexts, the bits of their escapes."""
    context, first, q = np.unique(grams >> np.uint32(8), return_index=True, return_counts=True)
    n = np.add.reduceat(counts, first)
    return np.log2(np.repeat(n + q, q)) - np.log2(counts), context, np.log2(n + q) - np.log2(q)


def grow(grams: np.ndarray, counts: np.ndarray) -> Tree:
    """The frozen tree of counted 4-grams."""

    def shorter(mask: int) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(grams & np.uint32(mask), return_inverse=True)
        return keys, np.bincount(at, counts).astype(float)

    keys0, counts0 = shorter(0xFF)
    bits0, _, escape0 = _level(keys0, counts0)
    order0 = np.full(256, 8 + escape0[0])
    order0[keys0] = bits0
    keys1, counts1 = shorter(0xFFFF)
    bits1, contexts1, escape1 = _level(keys1, counts1)
    below = np.zeros(256)
    below[contexts1] = escape1
    order1 = (below[:, None] + order0[None, :]).reshape(-1)
    order1[keys1] = bits1
    keys2, counts2 = shorter(0xFFFFFF)
    bits2, contexts2, e2 = _level(keys2, counts2)
    escape2 = np.zeros(1 << 16)
    escape2[contexts2] = e2
    keys3, counts3 = shorter(0xFFFFFFFF)
    bits3, contexts3, escape3 = _level(keys3, counts3)
    return Tree(order1, escape2, keys2, bits2, contexts3, escape3, keys3, bits3)


def learn(docs: DataFrame, train: Column, train_bytes: int = TRAIN_BYTES, most: int = MAX_LANGUAGES) -> dict[str, Tree]:
    """A tree for each language of the rows where ``train`` holds: (doc_id, text, lang).

    A language with more than ``train_bytes`` of text is sampled by a hash of doc_id and piece; every tree comes from one
    group of about that size, and its counts, not its texts, go to the driver.
    """
    rows = docs.select("doc_id", "text", "lang").where(train & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = rows.where(F.octet_length("text") > 0)
    total = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("total"))
    sizes = {r["lang"]: r["total"] for r in total.orderBy(F.desc("total"), "lang").limit(most).collect()}
    if not sizes:
        return {}
    share = F.create_map(*(F.lit(x) for lang, total in sizes.items() for x in (lang, min(1.0, train_bytes / total))))
    draw = lambda i: F.pmod(F.xxhash64(F.col("doc_id").cast("string"), i), F.lit(1 << 30)) / float(1 << 30)
    parts = F.when(F.length("text") > PIECE_CHARS, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE_CHARS}}}"), F.lit(0))).otherwise(F.array("text"))
    part_of = rows.where(F.col("lang").isin(*sizes)).select("lang", "doc_id", F.posexplode(parts).alias("part", "text"))
    sample = part_of.where(draw(F.col("part")) < share[F.col("lang")]).select("lang", "text")

    def count(table: pa.Table) -> pa.Table:
        grams, _ = _grams(table.column("text").combine_chunks())
        keys, n = np.unique(grams, return_counts=True)
        return pa.table({"lang": table.column("lang").slice(0, 1), "keys": [keys.tobytes()], "counts": [n.astype(np.int64).tobytes()]})

    counted = sample.groupBy("lang").applyInArrow(count, "lang string, keys binary, counts binary").collect()
    return {r["lang"]: grow(np.frombuffer(r["keys"], np.uint32), np.frombuffer(r["counts"], np.int64)) for r in sorted(counted, key=lambda r: r["lang"])}


def code_lengths(texts: pa.Array, trees: dict[str, Tree]) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each whole text in each language, and its bytes."""
    grams, offsets = _grams(texts)
    size = np.diff(offsets)
    out = np.zeros((len(trees), len(size)))
    full = size > 0
    if full.any():
        coded = pc.dictionary_encode(pa.array(grams))
        distinct, index = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        for k, tree in enumerate(trees.values()):
            out[k, full] = np.add.reduceat(tree.bits(distinct)[index], offsets[:-1][full])
    return out, size


def predict_columns(texts: pa.Array, letters: np.ndarray, trees: dict[str, Tree]) -> list[pa.Array]:
    names = np.array([*trees, UNDETERMINED], object)
    if not trees:
        n = len(texts)
        return [pa.array([UNDETERMINED] * n, pa.string()), pa.array(np.zeros(n)), pa.nulls(n, pa.float64())]
    bits, size = code_lengths(texts, trees)
    best = bits.argmin(0)
    least = bits.min(0)
    score = 1 / np.exp2(np.maximum(least - bits, -1000)).sum(0)
    return [
        pa.array(names[np.where(letters, best, len(trees))], pa.string()),
        pa.array(np.where(letters, score, 0.0)),
        pa.array(np.where(size > 0, least / np.maximum(size, 1), np.nan), from_pandas=True),
    ]


def identify(docs: DataFrame, trees: dict[str, Tree]) -> DataFrame:
    """``doc_id, lang_pred, score, bits_per_byte`` from the text alone.

    ``score`` is the probability of the language against the other trees, ``bits_per_byte`` the code length of
    the text in it.
    """
    long_rows(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(trees)
    narrow = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            out = predict_columns(b.column(1), b.column(2).to_numpy(zero_copy_only=False), known.value)
            yield pa.RecordBatch.from_arrays([b.column(0), *out], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, {RESULT}")


def keep_identified(docs: DataFrame, trees: dict[str, Tree], least: float = 0.0) -> DataFrame:
    """``docs`` without the rows whose language stays undetermined or has a probability below ``least``; ``lang`` is the language found."""
    long_rows(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(trees)
    text, label = docs.columns.index("text"), docs.columns.index("lang")
    letters = len(docs.columns)
    wide = docs.select(*(F.col(f"`{c}`") for c in docs.columns), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has a letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            lang, score, _ = predict_columns(b.column(text), b.column(letters).to_numpy(zero_copy_only=False), known.value)
            keep = pc.and_(pc.not_equal(lang, UNDETERMINED), pc.greater_equal(score, least))
            yield b.set_column(label, b.schema.field(label), lang.cast(b.schema.field(label).type)).filter(keep).select(list(range(letters)))

    return wide.mapInArrow(run, docs.schema)
