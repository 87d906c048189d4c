"""Cutting texts into units that byte-level tokenizers encode on their own, over Arrow buffers.

A byte-level tokenizer first cuts a text by a fixed pattern. A word of that pattern may begin with a space, and white
space before a word gives it its last space; so a text can always be cut before a space that a character other than white
space follows, and the ids of the text are those of its units. A piece vocabulary in which no piece goes on after the
last of its leading spaces to another space allows cuts before a space that isn't itself preceded by one. ``cut_units`` keeps to places
where both hold if ``alone`` is set.

Cuts are found on bytes: the next byte has to be over 0x20 and not the first of a character that could be white space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: First bytes of the UTF-8 characters among which white space is, besides the ASCII ones.
_LEADS = np.zeros(256, dtype=bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LEADS[:0x21] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a column of texts; nulls have no bytes."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def strings(column: pa.Array) -> list[str]:
    """The texts of a column without nulls as Python strings, made by Arrow all at once."""
    return column.to_numpy(zero_copy_only=False).tolist()


def cut_units(column: pa.Array, alone: bool = False) -> tuple[np.ndarray, pa.Array]:
    """The units of all texts, and each text's end among them. An empty text has no units."""
    offsets, data = buffers(column)
    n = len(data)
    start = np.zeros(n + 1, dtype=bool)
    if n > 1:
        space = data == 0x20
        cut = space[:-1] & ~_LEADS[data[1:]]
        if alone:
            cut[1:] &= ~space[:-2]
        start[: n - 1] = cut
        last = offsets[1:][offsets[1:] > 0] - 1
        start[last] = False  # what follows the last byte is another text
    start[offsets[:-1]] = True
    start[n] = False
    at = np.flatnonzero(start)
    ends = np.searchsorted(at, offsets[1:])
    places = np.append(at, n).astype(np.int64)
    units = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data)))
    return ends, units
