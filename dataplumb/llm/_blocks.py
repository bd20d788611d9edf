"""Texts of an Arrow batch as bytes: what the NumPy parts of the operators work on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; longer texts come alone. Bounds the temporary arrays.
BLOCK = 1 << 21


def text_blocks(texts: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows; null texts are empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + block, side="right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def table_of(characters: bytes | range) -> np.ndarray:
    """A lookup table by byte: whether it is one of the characters."""
    found = np.zeros(256, bool)
    found[list(characters)] = True
    return found


SPACE = table_of(b" \t\n\v\f\r")


def count_in(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each row."""
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[at[1:]] - run[at[:-1]]
