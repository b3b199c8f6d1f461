"""Words of many texts at once, as numbers into a list of the distinct ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def word_bytes(separators: list[tuple[int, int]], lower: bool) -> np.ndarray:
    """For each byte what it becomes: a space if it lies in a range of separators, and A-Z in lower case if ``lower``."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    for first, last in separators:
        table[first:last + 1] = 32
    if lower:
        table[65:91] = np.arange(97, 123)
    return table


def split_words(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the number of each word in order, where each text's words end), of an array without NULLs.

    ``table`` comes from ``word_bytes``: it changes only ASCII, so that texts stay valid and keep their lengths.
    """
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    plain = pa.Array.from_buffers(pa.large_string(), len(texts), [
        None, pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(table[data])])
    pieces = pc.split_pattern(plain, " ")
    coded = pieces.values.dictionary_encode()
    index = coded.indices.to_numpy()
    blank = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    ends = pieces.offsets.to_numpy()[1:]
    if blank >= 0:
        kept = index != blank
        ends = np.concatenate(([0], np.cumsum(kept)))[ends]
        index = index[kept]
    return coded.dictionary, index, ends
