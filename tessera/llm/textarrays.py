"""Arrow text columns as flat numpy arrays: words, bytes and lines of a batch.

Every function takes whole texts. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes handled at a time: they bound the arrays that a task holds beside one text.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of the batches of about ``most`` text bytes, with their texts, nulls made empty."""
    for batch in batches:
        column = pc.fill_null(batch[text], "")
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at), pa.concat_arrays([column.slice(at, to - at)])
            at = to
        del batch, column  # else they stay while the next batch is read


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each text)."""
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(id of each word, the distinct words, offsets of each text): words are runs of `[^\\x20\\x09-\\x0D]`."""
    lists = pc.ascii_split_whitespace(text)
    values, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.not_equal(values, "").to_numpy(zero_copy_only=False)
    coded = values.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        ids = ids[full]
    return ids, coded.dictionary, offsets


def hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of each string; equal in every task."""
    return np.fromiter((xxhash.xxh3_64_intdigest(x, seed) for x in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` in each text."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def owner(offsets: np.ndarray) -> np.ndarray:
    """Index of the text of each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def lowered(text: pa.Array) -> pa.Array:
    """Texts with A-Z in lower case."""
    data, offsets = raw(text)
    return pa.Array.from_buffers(pa.string(), len(text), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(lower_ascii(data))])
