"""Arrow plumbing shared by the text operators.

Texts travel to Python workers as UTF-8 bytes. ``bytes.split()`` cuts exactly at
``[\\x20\\x09-\\x0D]`` and ``bytes.lower()`` maps exactly A-Z, which is the word
definition every operator here uses. A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

CHUNK_BYTES = 4 << 20

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


# Arrow's own allocator keeps freed memory for itself; the system's gives it back when it is trimmed
pa.set_memory_pool(pa.system_memory_pool())
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: a worker lives on beside its executor's heap, and would keep what its largest chunk took."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def fold(doc_id: str, modulus: int) -> Column:
    """Remainder of crc32(id as text); a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def map_texts(
    docs: DataFrame,
    per_chunk: Callable[[list[pa.Array], list[bytes]], pa.RecordBatch | None],
    schema: str | StructType,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """Apply ``per_chunk(kept columns, texts)`` to runs of about CHUNK_BYTES of text.

    Only the kept columns and the text are read. One chunk is in memory at a time; a text longer
    than a chunk is a chunk of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep))
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            start = held = 0
            for i, size in enumerate([*sizes, CHUNK_BYTES]):
                if i > start and held + size > CHUNK_BYTES:
                    part = batch.slice(start, i - start)
                    out = per_chunk([part.column(k) for k in range(len(keep))], part.column(len(keep)).to_pylist())
                    if out is not None and out.num_rows:
                        yield out
                    give_back()
                    start, held = i, 0
                held += size

    columns = [F.col(c) for c in keep] + [F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__text")]
    return docs.select(*columns).mapInArrow(run, schema)


class Numbering(dict):
    """Numbers distinct words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


class WordHash(dict):
    """64-bit hash of each distinct word, computed once."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def flat(per_doc: Iterable[list], table: dict, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values of all words of all documents, and the offsets at which each document begins; one document's words are there at a time."""
    get = table.__getitem__
    parts = [np.fromiter(map(get, words), dtype, len(words)) for words in per_doc]
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
    return np.concatenate(parts) if parts else np.zeros(0, dtype), offsets


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the different words, the most frequent first, which of them each word of all documents is, and the documents' offsets."""
    number = Numbering()
    at, offsets = flat(((t.lower() if lower else t).split() for t in texts), number, np.int32)
    order = np.argsort(-np.bincount(at, minlength=len(number)), kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))[order], place[at], offsets


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values; entry i covers values[i:i+width]."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = 1
    for k in range(width):
        total += values[k : k + n] * np.uint64(factor)
        factor = factor * _STEP & _MASK
    return mix(total)
