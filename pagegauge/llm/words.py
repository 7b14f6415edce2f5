"""Words, word hashes and word windows of Arrow text columns, as numpy arrays.

UTF-8 never uses an ASCII byte inside a longer character, so word classes that are stated over ASCII
can be cut at byte level, for a whole batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; one longer document makes a piece of its own.
PIECE_BYTES = 4 << 20
_CHUNK = 1 << 20
_RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)
_RADIX_INVERSE = np.uint64(pow(int(_RADIX), -1, 1 << 64))
_WINDOW = np.uint64(0xD6E8FEB86659FD93)


def _table(keep: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(keep)] = True
    return table


#: ``[^\x20\x09-\x0D]+``
NOT_BLANK = _table(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text whose A-Z are lower-cased
LETTERS_DIGITS = _table(b for b in range(256) if b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
PLAIN = np.arange(256, dtype=np.uint8)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the one of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for r in (_RADIX, _RADIX_INVERSE):
        p = np.full(n + 1, r, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


@dataclass
class Words:
    data: np.ndarray  # bytes of the piece
    first: np.ndarray  # first[d] .. first[d + 1]: the words of document d
    starts: np.ndarray  # byte offsets of each word
    ends: np.ndarray
    fold: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each word: a polynomial in its folded bytes, then mixed with its length."""
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(self.starts):
            base = int(self.starts[i])
            j = max(i + 1, int(np.searchsorted(self.ends, base + _CHUNK, "right")))
            seg = self.fold[self.data[base : self.ends[j - 1]]].astype(np.uint64) + np.uint64(1)
            power, inverse = _powers(max(_CHUNK, len(seg)))
            sums = np.zeros(len(seg) + 1, np.uint64)
            np.cumsum(seg * power[: len(seg)], out=sums[1:])
            s, e = self.starts[i:j] - base, self.ends[i:j] - base
            out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
            i = j
        return out

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of k words that lie in one document, and the word each starts at."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        acc = np.zeros(n, np.uint64)
        for j in range(k):
            acc = acc * _WINDOW + hashes[j : j + n]
        doc = self.doc
        at = np.flatnonzero(doc[:n] == doc[k - 1 :])
        return mix(acc[at]), at


def words_of(texts: pa.Array, kind: np.ndarray, fold: np.ndarray = PLAIN) -> Words:
    """Words of each text; a null text has none."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    full = offsets[:-1][np.diff(offsets) > 0]
    ends_at = offsets[1:][np.diff(offsets) > 0] - 1
    inside = kind[data]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    edge[full] = inside[full]
    starts = np.flatnonzero(edge)
    edge = inside.copy()
    edge[:-1] &= ~inside[1:]
    edge[ends_at] = inside[ends_at]
    ends = np.flatnonzero(edge) + 1
    return Words(data, np.searchsorted(starts, offsets), starts, ends, fold)


def pieces(batches: Iterator[pa.RecordBatch], text: int | str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about PIECE_BYTES of text each, so that memory follows the piece and not the batch."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
        upto = np.cumsum(sizes)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PIECE_BYTES, "right")))
            yield batch.slice(i, j - i)
            i = j


_ZSTD = pa.Codec("zstd", 3)


def pack(data: bytes | np.ndarray) -> bytes:
    """Zstandard behind the length; for what is shuffled in blocks."""
    data = data.tobytes() if isinstance(data, np.ndarray) else data
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True) if data else b""


def unpack(data: bytes) -> bytes:
    return _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True) if data else b""
