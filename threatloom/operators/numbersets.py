"""Sets of integers as bytes, so that what meets in a join travels as sets and not as pairs.

A piece is up to PIECE sorted numbers: the first one with its sign as the last bit, then distances, each in groups of 7 bits of which
all but the last have the high bit. An empty piece stands for null. A key may have several pieces, so no key's set stands in one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE, BLOCK_BITS, ROWS = 1024, 20, 4096


def packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Pieces that begin at the places `first` (the first of all is 0) of `values`, sorted in each."""
    number = values.view(np.uint64)
    gaps = np.diff(number, prepend=number[:1])
    gaps[first] = ((values[first] << 1) ^ (values[first] >> 63)).view(np.uint64)
    length, shift = np.ones(len(gaps), np.int64), 7
    while shift < 64 and (longer := gaps >> np.uint64(shift) > 0).any():
        length += longer
        shift += 7
    end = np.cumsum(length)
    at, out = end - length, np.empty(length.sum(), np.uint8)
    for k in range(int(length.max(initial=0))):
        on = np.flatnonzero(length > k)
        out[at[on] + k] = (gaps[on] >> np.uint64(7 * k)).astype(np.uint8) & 127 | (length[on] > k + 1).astype(np.uint8) << 7
    offsets = np.append(at[first], len(out)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpacked(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of some pieces, one after the other, and how many each has (null: none)."""
    n = len(pieces)
    offsets = np.frombuffer(pieces.buffers()[1], np.int32, n + 1, pieces.offset * 4)
    if offsets[-1] == offsets[0]:
        return np.empty(0, np.int64), np.zeros(n, np.int64)
    b = np.frombuffer(pieces.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    last = np.flatnonzero(b < 128)
    at = np.append(0, last[:-1] + 1)
    gaps, k = (b[at] & 127).astype(np.int64), 1
    on = np.flatnonzero(last > at)
    while len(on):
        gaps[on] |= (b[at[on] + k] & 127).astype(np.int64) << (7 * k)
        k += 1
        on = on[last[on] - at[on] >= k]
    before = last.searchsorted(offsets - offsets[0])
    counts = np.diff(before)
    some = counts > 0
    first = before[:-1][some]
    base = (gaps[first].view(np.uint64) >> np.uint64(1)).view(np.int64) ^ -(gaps[first] & 1)
    gaps[first] = base
    total = np.cumsum(gaps)
    total -= np.repeat(total[first] - base, counts[some])
    return total, counts


def distinct(values: np.ndarray, run: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each run (runs in order), and how many each has."""
    if not len(values):
        return values, np.zeros(runs, np.int64)
    least = int(values.min())
    span = int(values.max()) - least + 1
    if span * runs < 1 << 62:
        code = run * span + (values - least)
        code.sort()
        code = code[np.append(True, code[1:] != code[:-1])]
        sizes = np.diff(code.searchsorted(np.arange(runs + 1) * span))
        return code - np.repeat(np.arange(runs) * span, sizes) + least, sizes
    order = np.lexsort((values, run))
    values, run = values[order], run[order]
    new = np.append(True, (values[1:] != values[:-1]) | (run[1:] != run[:-1]))
    return values[new], np.bincount(run[new], minlength=runs)


def _begins(column: pa.Array) -> np.ndarray:
    """Where a sorted column has another value than before; nulls are equal."""
    new = np.ones(len(column), bool)
    if len(column) > 1:
        a, b = column[1:], column[:-1]
        new[1:] = pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return new


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def whole(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def pieces(df: DataFrame, by: list[str], value: str, into: str) -> DataFrame:
    """`by`, and pieces of the distinct `value`s (integers) of each key; the first of `by` should tell most keys apart. A key with many
    values is dealt to several tasks."""
    rows = df.select(*by, F.col(value).cast("long").alias(into))
    rows = rows.repartition(*by, F.shiftright(into, BLOCK_BITS)).sortWithinPartitions(by[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1 << 16):
            key, runs = np.cumsum(_begins(batch.column(0))) - 1, batch.num_rows
            for k in range(1, len(by)):
                coded = batch.column(k).dictionary_encode()
                key, runs = key * (len(coded.dictionary) + 1) + coded.indices.fill_null(len(coded.dictionary)).to_numpy(), runs * (len(coded.dictionary) + 1)
            row = np.zeros(runs, np.int64)
            row[key] = np.arange(batch.num_rows)
            null, value = (x.to_numpy(zero_copy_only=False) for x in (batch.column(len(by)).is_null(), batch.column(len(by)).fill_null(0)))
            values, sizes = distinct(value[~null], key[~null], runs)
            first = np.flatnonzero((np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) % PIECE == 0)
            empty = np.unique(key[null])
            found = pa.concat_arrays([packed(values, first), pa.array([b""] * len(empty), pa.binary())])
            keys = batch.select(range(len(by))).take(pa.array(row[np.append(np.repeat(np.arange(runs), sizes)[first], empty)]))
            yield pa.RecordBatch.from_arrays([*keys.columns, found], [*by, into])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in by), T.StructField(into, T.BinaryType())]))


def members(lists: Column) -> Column:
    """The sorted distinct numbers of an array of pieces (nulls are left out). Filters on them stay above, so that they are told once."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(column: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        values, counts = unpacked(column.flatten())
        values, sizes = distinct(values, np.repeat(np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), counts), len(ends))
        offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32(), mask=np.append(column.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(offsets, pa.array(values))

    return run.asNondeterministic()(lists)


def counted_members(df: DataFrame, by: str, piece: str) -> DataFrame:
    """`by`, n and least: how many distinct numbers the pieces of a key hold (null is one), and the least of them.

    A task goes through its keys in order and holds a batch of pieces and the numbers of one key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: pa.Array, values: np.ndarray, sizes: np.ndarray, null: np.ndarray) -> pa.RecordBatch:
            least = values.take(np.minimum(np.cumsum(sizes) - sizes, len(values) - 1)) if len(values) else np.zeros(len(sizes), np.int64)
            return pa.RecordBatch.from_arrays([keys, pa.array(sizes + null, pa.int64()), pa.array(least, pa.int64(), mask=sizes == 0)], [by, "n", "least"])

        held = None  # the last key, which may go on
        for batch in _slices(batches, ROWS):
            new = _begins(batch.column(0))
            first, place = np.flatnonzero(new), np.cumsum(new) - 1
            keys = batch.column(0).take(pa.array(first))
            values, counts = unpacked(batch.column(1))
            values, sizes = distinct(values, np.repeat(place, counts), len(first))
            null = np.bincount(place[counts == 0], minlength=len(first)) > 0
            if held and held[0].equals(keys[:1]):
                own = np.union1d(held[1], values[: sizes[0]])
                values, null[0] = np.concatenate((own, values[sizes[0] :])), null[0] | held[3][0]
                sizes[0] = len(own)
            elif held:
                yield out(*held)
            before = len(values) - sizes[-1]
            held = keys[-1:], values[before:].copy(), sizes[-1:].copy(), null[-1:].copy()
            yield out(keys[:-1], values[:before], sizes[:-1], null[:-1])
        if held:
            yield out(*held)

    rows = df.select(by, piece).repartition(by).sortWithinPartitions(by)
    return rows.mapInArrow(run, T.StructType([rows.schema[by], T.StructField("n", T.LongType()), T.StructField("least", T.LongType())]))
