"""Answers about keys of a whole corpus, exchanged between chunks of documents and ranges of keys.

A chunk of documents sends each of its different keys once, with small numbers (how often it has the key, say). Spark deals
the keys by range; a range puts equal keys of all chunks together, and its answers go back, in the order in which the keys
came, to the chunk, which then has an answer for each of its keys. What a chunk needs to go on (``info``)
meets its answers there: it travels with the keys where it is small, and straight to the chunk's group, from a second reading of the texts, where it isn't.

* A key that a third of all texts have is one entry for each chunk, never one for each text.
* Keys travel sorted, as compressed byte planes, in one row for each chunk and range: three to six bytes a key. The number of ranges follows the size of the
  corpus, so a range has about RANGE_BYTES / 6 entries at any size.
* A chunk writes at most FANOUT rows and gets at most as many answers. Where there are more ranges, both ways have two levels: keys go first to FANOUT coarse ranges, whose rows are put together
  over many chunks before they are cut into ranges; and a range answers at most FANOUT groups of chunks, whose rows are put together over many ranges
  before they are cut into chunks. So rows grow with chunks plus ranges, not with their product, and an exchange each way is added for each
  factor of FANOUT (4096 * 8 MB = 32 GB, then 128 TB).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .textbatch import CHUNK_BYTES, give_back, map_texts, mix

RANGE_BYTES, FANOUT = 8_000_000, 4096
#: Bytes that a task holds while it puts rows of a coarse range together.
HELD_BYTES = 64 << 20
SENT = "range long, chunks binary, sizes binary, keys binary, numbers array<binary>, info array<binary>"
#: Answers of several ranges to a chunk: the ranges, and how many entries each has. Before they are cut: ``chunks`` beside ``ranges``, for a group of chunks.
ANSWERED = "chunk long, ranges binary, sizes binary, answers array<binary>, info array<binary>"
GROUPED = "chunk long, chunks binary, ranges binary, sizes binary, answers array<binary>, info array<binary>"
#: Chunks whose answers are put together, if their number allows.
GROUP = 64


_CODEC = pa.Codec("zstd", compression_level=1)


def planes(values: np.ndarray) -> bytes:
    """The bytes of each value, all lowest ones first, compressed: bytes that hardly change cost nothing, and high zero bytes are left out."""
    values = np.ascontiguousarray(values).astype("<u8")
    width = -(-int(values.max(initial=0)).bit_length() // 8)
    if not width:
        return b""
    return bytes([width]) + _CODEC.compress(values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), asbytes=True)


def unplanes(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if raw:
        out[:, : raw[0]] = np.frombuffer(_CODEC.decompress(raw[1:], n * raw[0]), np.uint8).reshape(-1, n).T
    return out.view("<u8").ravel()


def key_mask(size: int, bits: int) -> np.uint64:
    """The bits of a key that are kept: whole bytes, ``bits`` more than the size of the corpus has. So about one key in 2 ** ``bits`` or fewer falls together with
    another one, at any size (up to 64 bits in all)."""
    return np.uint64((1 << 64) - (1 << 64 - min(64, 8 * -(-(max(size, 1).bit_length() + bits) // 8))))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts the keys, where each different key begins in it, which of the different keys each key is)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    begins = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(keys) else np.zeros(0, np.int64)
    which = np.empty(len(keys), np.int64)
    which[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(keys))))
    return order, begins, which


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1 if len(values) else []
    edges = [0, *cuts, len(values)] if len(values) else [0]
    return zip(edges[:-1], edges[1:], strict=True)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    fields = [x.split(" ") for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _entries(row: dict) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Keys, numbers, chunks and entries of each chunk of a row."""
    sizes = np.frombuffer(row["sizes"], "<i8")
    n = int(sizes.sum())
    return unplanes(row["keys"], n), [unplanes(x, n) for x in row["numbers"]], np.frombuffer(row["chunks"], "<i8"), sizes


def _recut(ranges: int):
    """Rows of coarse ranges, put together as far as memory goes and cut into ranges."""

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for parts in held.values():
            keys = np.concatenate([p[0] for p in parts])
            numbers = [np.concatenate(x) for x in zip(*(p[1] for p in parts), strict=True)]
            chunk = np.concatenate([np.repeat(p[2], p[3]) for p in parts])
            fine = _range_of(keys, ranges)
            order = np.argsort(fine, kind="stable")
            keys, numbers, chunk, fine = keys[order], [x[order] for x in numbers], chunk[order], fine[order]
            rows = []
            for a, b in _runs(fine):
                own = list(_runs(chunk[a:b]))
                chunks, sizes = np.array([chunk[a + x] for x, _ in own], "<i8"), np.array([y - x for x, y in own], "<i8")
                rows.append((int(fine[a]), chunks.tobytes(), sizes.tobytes(), planes(keys[a:b]), [planes(x[a:b]) for x in numbers], None))
            yield _batch(rows, SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                if row["info"] is not None:
                    yield _batch([(int(np.frombuffer(row["chunks"], "<i8")[0] % ranges), *list(row.values())[1:])], SENT)
                    continue
                held.setdefault(row["range"], []).append(_entries(row))
                size += 8 * int(np.frombuffer(row["sizes"], "<i8").sum()) * (2 + len(row["numbers"]))
                if size > HELD_BYTES:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    return run


def _regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers to groups of chunks, put together over ranges as far as memory goes and cut into chunks."""

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for parts in held.values():
            chunk, part, size = (np.concatenate([p[k] for p in parts]) for k in range(3))
            answers = [np.concatenate(x) for x in zip(*(p[3] for p in parts), strict=True)]
            begin = np.cumsum(size) - size
            order = np.lexsort((part, chunk))
            rows = []
            for a, b in _runs(chunk[order]):
                own = order[a:b]
                at = np.concatenate([np.arange(begin[k], begin[k] + size[k]) for k in own])
                rows.append((int(chunk[own[0]]), part[own].tobytes(), size[own].tobytes(), [planes(x[at]) for x in answers], None))
            yield _batch(rows, ANSWERED)

    held: dict[int, list] = {}
    size = 0
    for b in batches:
        for k in range(b.num_rows):
            row = b.slice(k, 1).to_pylist()[0]
            if row["chunks"] is None:
                yield _batch([(row["chunk"], b"", b"", row["answers"], row["info"])], ANSWERED)
                continue
            n = np.frombuffer(row["sizes"], "<i8")
            held.setdefault(row["chunk"], []).append((np.frombuffer(row["chunks"], "<i8"), np.frombuffer(row["ranges"], "<i8"), n, [unplanes(x, int(n.sum())) for x in row["answers"]]))
            size += 8 * int(n.sum()) * (2 + len(row["answers"]))
            if size > HELD_BYTES:
                yield from flush(held)
                held, size = {}, 0
    yield from flush(held)


def corpus_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def exchange(
    docs: DataFrame,
    send: Callable[[list[pa.Array], list[bytes]], tuple[np.ndarray, list[np.ndarray], list[bytes] | None]],
    answer: Callable[..., tuple[list[np.ndarray], np.ndarray | None]],
    receive: Callable[[list[bytes] | None, list[np.ndarray]], pa.Table],
    schema: str,
    keep: tuple[str, ...],
    text: str = "text",
    size: int | None = None,
    tell: Callable[[list[pa.Array], list[bytes]], list[bytes]] | None = None,
    watched: list[DataFrame] | None = None,
) -> DataFrame:
    """The rows that ``receive`` makes of every chunk of ``docs``.

    send(kept columns, texts): sorted different keys (64 bits, spread evenly), numbers for each, and info; answer(keys, *numbers): for the
    entries of a range (in no order, a key once for each chunk that has it), answers that are whole numbers from 0,
    and totals of the range or None; receive(info, answers): rows of a chunk, the answers being in the order of its keys. Totals come
    added up as receive(None, totals), in a few rows. With ``tell``, the info is tell(kept columns, texts) of a second reading, in which
    ``docs`` must come in the same order (as files do); that is checked by a digest of each chunk, and another order is an error.
    ``watched`` receives the rows of keys and of answers as they travel.
    """
    size = corpus_bytes(docs, text) if size is None else size
    ranges = max(1, -(-size // RANGE_BYTES))
    coarse = -(-ranges // FANOUT)

    def numbering():
        made = [0]  # chunks so far; a task has a copy of its own

        def chunk() -> int:
            context = TaskContext.get()
            made[0] += 1
            return (context.partitionId() if context else 0) << 32 | made[0] - 1

        return chunk

    def digest(texts: list[bytes]) -> bytes:
        return xxhash.xxh3_64_digest(b"\n".join(texts))

    def sender(chunk_of):
        def run(kept, texts):
            chunk = chunk_of()
            keys, numbers, info = send(kept, texts)
            name = np.array([chunk], "<i8").tobytes()
            dealt = _range_of(keys, ranges) // np.uint64(coarse)
            rows = [(int(dealt[a]), name, np.array([b - a], "<i8").tobytes(), planes(keys[a:b]), [planes(x[a:b]) for x in numbers], None) for a, b in _runs(dealt)]
            return _batch([*rows, (chunk % ranges // coarse, name, b"", b"", [], [digest(texts)] if info is None else info)], SENT)

        return run

    def teller(chunk_of):
        def run(kept, texts):
            return _batch([(chunk_of(), b"", b"", None, [digest(texts), *tell(kept, texts)])], ANSWERED)

        return run

    rows = map_texts(docs, sender(numbering()), SENT, keep, text)
    if coarse > 1:
        # a coarse range is put together by several tasks, each for a part of the chunks and about HELD_BYTES
        salt = F.pmod(F.xxhash64("chunks"), F.lit(max(1, coarse // 16)))
        rows = rows.withColumn("salt", salt).repartition(F.col("range"), F.col("salt")).sortWithinPartitions("range").drop("salt").mapInArrow(_recut(ranges), SENT)

    groups = max(1, min(FANOUT, -(-size // (CHUNK_BYTES * GROUP))))

    def meet(table: pa.Table) -> pa.Table:
        out, parts, owners = [], [], []
        for row in (r for b in table.to_batches() for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist()):
            if row["info"] is not None:
                out.append((int(np.frombuffer(row["chunks"], "<i8")[0]), None, b"", b"", None, row["info"]))
            else:
                keys, numbers, chunks, sizes = _entries(row)
                parts.append((keys, numbers))
                owners.append((chunks, np.full(len(chunks), row["range"], np.int64), sizes))
        if parts:
            answers, totals = answer(np.concatenate([k for k, _ in parts]), *(np.concatenate(x) for x in zip(*(n for _, n in parts), strict=True)))
            chunks, ranges_, sizes = (np.concatenate(x) for x in zip(*owners, strict=True))
            begin = np.cumsum(sizes) - sizes
            # a row for each chunk, or for each group of chunks where there are many ranges
            receiver = chunks if coarse == 1 else (mix(chunks.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(receiver, kind="stable")
            for a, b in _runs(receiver[order]):
                own = order[a:b]
                at = np.concatenate([np.arange(begin[k], begin[k] + sizes[k]) for k in own])
                out.append((int(receiver[own[0]]), chunks[own].tobytes(), ranges_[own].tobytes(), sizes[own].tobytes(), [planes(x[at]) for x in answers], None))
            if totals is not None:
                out.append((-1 - int(ranges_[0]) % 64, None, b"", b"", [np.asarray(totals, "<f8").tobytes()], None))
        give_back()
        return pa.Table.from_batches([_batch(out, GROUPED)])

    def gather(table: pa.Table, told: pa.Table | None = None) -> pa.Table:
        info, got, totals = None, {}, []
        for row in (r for b in table.to_batches() for r in b.to_pylist()):
            if row["chunk"] < 0:
                totals.append(np.frombuffer(row["answers"][0], "<f8"))
            elif row["info"] is not None:
                info = row["info"]
            else:
                sizes = np.frombuffer(row["sizes"], "<i8")
                ends = np.cumsum(sizes)[:-1]
                got.update(zip(np.frombuffer(row["ranges"], "<i8").tolist(), zip(*(np.split(unplanes(x, int(sizes.sum())), ends) for x in row["answers"]), strict=True), strict=True))
        if totals:
            return receive(None, [np.sum(totals, 0)])
        if told is not None:
            check, *own = told.column("info")[0].as_py() if told.num_rows else [None]
            if info is None or check != info[0]:
                raise ValueError("the documents came in another order when they were read again; write them to a table first")
            info = own
        out = receive(info, [np.concatenate(x) for x in zip(*(got[k] for k in sorted(got)), strict=True)])
        give_back()
        return out

    answered = rows.groupBy("range").applyInArrow(meet, GROUPED)
    if watched is not None:
        watched.append(answered)
    if coarse > 1:
        # a group's answers are put together by several tasks, each for a part of the ranges and about HELD_BYTES
        salt = F.pmod(F.xxhash64("ranges"), F.lit(max(1, -(-size // groups // (16 * HELD_BYTES)))))
        answered = answered.withColumn("salt", salt).repartition(F.col("chunk"), F.col("salt")).sortWithinPartitions("chunk").drop("salt").mapInArrow(_regroup, ANSWERED)
    if watched is not None:
        watched += [rows, answered]
    answered = answered.drop("chunks").groupBy("chunk")
    if tell is None:
        return answered.applyInArrow(lambda table: gather(table), schema)
    told = map_texts(docs, teller(numbering()), ANSWERED, keep, text)
    return answered.cogroup(told.groupBy("chunk")).applyInArrow(lambda table, own: gather(table, own), schema)
