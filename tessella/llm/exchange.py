"""Batches of documents that ask questions of a partitioned key space and get the answers back in order.

A batch is some tens of megabytes of whole documents of one scan task. It sends each part of the key
space its own distinct keys, in one row per part that has any, so a key costs a row's share per batch and not
per occurrence, however hot it is; and the part answers each row with as many values in the same
order. Rows are never more than keys, whatever the numbers of batches and parts are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import tokens



def pack(x: np.ndarray) -> bytes:
    """Integers of 0 and more by byte planes, as many as the largest needs, compressed."""
    x = np.ascontiguousarray(x, np.uint64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + zstandard.compress(x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 1)


def unpack(b: bytes) -> np.ndarray:
    width, planes = b[0], zstandard.decompress(b[1:])
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    return out.view(np.uint64).ravel()


def pack_rising(x: np.ndarray) -> bytes:
    return pack(np.diff(np.asarray(x, np.uint64), prepend=np.uint64(0)))


def unpack_rising(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, its places in order) of each part that has any."""
    order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.uint32), kind="stable")
    at = np.searchsorted(part[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(at)).tolist():
        yield k, order[at[k] : at[k + 1]]


def in_batches(batches: Iterator[pa.RecordBatch], size: int, run: Callable[[int, pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """run(batch number, rows) of each batch of rows (id, text, ...). The numbers differ over the
    whole job, and are the same when a task is run again."""
    base, number = TaskContext.get().partitionId() << 32, 0
    waiting: list[pa.RecordBatch] = []
    held = 0
    for rows in batches:
        for k in range(0, rows.num_rows, 256):
            some = rows.slice(k, 256)
            waiting.append(some)
            offsets = tokens.buffers(some.column(1))[1]
            held += int(offsets[-1] - offsets[0])
            if held >= size:
                yield from run(base + number, pa.Table.from_batches(waiting))
                waiting, held, number = [], 0, number + 1
    if waiting:
        yield from run(base + number, pa.Table.from_batches(waiting))


def bytes_of(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each start, as many as its length, one after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)


def sums(values: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values of these lengths."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(length)
    return total[ends] - total[ends - length]
