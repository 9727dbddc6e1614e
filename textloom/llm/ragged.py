"""Slices of arrays, many at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from textloom.llm.words import Words


def spread_ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...`` for ``sizes[0]`` numbers, then the next range."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def offsets_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def list_array(values: np.ndarray | pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets_of(sizes), pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def string_array(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Slices of a buffer of UTF-8 bytes as strings."""
    held = data[spread_ranges(starts, sizes)]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets_of(sizes).astype(np.int64)), pa.py_buffer(held))


def spaced(words: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The (kept) words' bytes, each with one space behind it, and where each begins and ends."""
    starts, sizes = words.starts, words.ends - words.starts
    if keep is not None:
        starts, sizes = starts[keep], sizes[keep]
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    out = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    out[spread_ranges(begin, sizes)] = words.data[spread_ranges(starts, sizes)]
    return out, begin, begin + sizes


_CODEC = pa.Codec("zstd", compression_level=1)


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes, all first bytes before all second ones: the high bytes of small numbers vanish."""
    return _CODEC.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T), asbytes=True)


def unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(_CODEC.decompress(data, n * width, asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def by_part(part: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per part number: how many entries it has, and its entries of each column, packed."""
    order = np.argsort(part, kind="stable")
    numbers, at = np.unique(part[order], return_index=True)
    cuts = list(zip(at.tolist(), [*at[1:].tolist(), len(order)]))
    sorted_columns = {name: values[order] for name, values in columns.items()}
    return pa.RecordBatch.from_pydict({
        "part": pa.array(numbers, pa.int32()), "n": pa.array([b - a for a, b in cuts], pa.int32()),
        **{name: pa.array([pack(v[a:b]) for a, b in cuts], pa.binary()) for name, v in sorted_columns.items()}})


def gathered(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """All entries of a column of ``by_part`` rows."""
    return np.concatenate([np.zeros(0, kind), *[unpack(data, n, kind) for data, n in zip(
        table.column(name).to_pylist(), table.column("n").to_pylist())]])
