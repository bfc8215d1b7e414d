"""Words of whole texts as Arrow and numpy arrays, for use inside tasks.

A batch is first cut into slices of bounded bytes, so memory follows the slice and
the longest text, not the batch. All byte tables leave bytes of 128 and above alone,
which keeps UTF-8 valid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
BLANK = 32


def byte_table(blanks: str, lower: bool) -> np.ndarray:
    """256 bytes: those of `blanks` become a blank, A-Z become a-z if `lower`."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[[ord(c) for c in blanks]] = BLANK
    return table


WHITE = " \t\n\x0b\x0c\r"
#: Words are runs of anything but white space; letters stay as they are.
PLAIN = byte_table(WHITE, lower=False)
#: The same with A-Z lowered.
LOWERED = byte_table(WHITE, lower=True)
#: Words are runs of digits, letters and non-ASCII characters, with A-Z lowered.
ALPHANUMERIC = byte_table("".join(chr(c) for c in range(128) if not chr(c).isalnum()), lower=True)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Strings that are consecutive slices of `data`."""
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))
    )


@dataclass
class Words:
    """The words of a slice in order: `joined` holds them with one blank after each."""

    joined: np.ndarray
    starts: np.ndarray  # of each word in `joined`
    lengths: np.ndarray
    docs: np.ndarray  # word offsets of the texts, one more than texts

    def strings(self) -> pa.Array:
        keep = np.ones(len(self.joined), dtype=bool)
        keep[self.starts + self.lengths] = False
        return string_array(self.joined[keep], np.concatenate([[0], np.cumsum(self.lengths)]))


def split_words(texts: pa.Array, table: np.ndarray) -> Words:
    raw, offsets = text_bytes(texts)
    data = table[raw]
    inside = data != BLANK
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # Texts lie next to each other, so a word also begins and ends where a text does.
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    lengths = end - begin
    starts = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(int(lengths.sum()) + len(lengths), BLANK, dtype=np.uint8)
    gap = np.zeros(len(joined), dtype=bool)
    gap[starts + lengths] = True
    joined[~gap] = data[inside]
    return Words(joined, starts, lengths, np.searchsorted(begin, offsets))


def texts_of(batch: pa.RecordBatch, text: str) -> pa.Array:
    """A column, or with a dot a field of the struct column `row`."""
    name = text.removeprefix("row.")
    return batch.column(text) if name == text else pc.struct_field(batch.column("row"), [name])


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in pieces of at most `limit` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(texts_of(batch, text))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def to_varint(values: np.ndarray) -> bytes:
    """Seven bits a byte, low bits first, the high bit set on all but the last byte."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), dtype=np.int64)
    for bits in (7, 14, 21, 28, 35):
        size += values >= (1 << bits)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[at[has] + k] = ((values[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((size[has] > k + 1).astype(np.uint8) << 7)
    return out.tobytes()


def from_varint(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    out = np.zeros(len(ends), dtype=np.int64)
    size = ends - starts + 1
    for k in range(int(size.max())):
        has = size > k
        out[has] |= (data[starts[has] + k] & 127).astype(np.int64) << (7 * k)
    return out


def ragged_take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The slices of `values` numbered in `chosen`, one after another."""
    size = lengths[chosen]
    to = np.cumsum(size) - size
    return values[np.repeat(starts[chosen] - to, size) + np.arange(int(size.sum()))]
