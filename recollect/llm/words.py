"""Words of whole texts as bytes, in pieces of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 4_000_000
#: Rows of a batch that a task works on at once.
ROWS = 256

Batches = Iterator[pa.RecordBatch]

#: Fixed by the contract: words are runs of 0-9, A-Z (lower-cased) and everything outside ASCII.
_WORD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Fixed by the contract: A-Z is lower-cased, words are what white space leaves.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """Split ``raw`` at white space; at most about ``PIECE_BYTES`` of it are words at a time."""
    start = 0
    while len(raw) - start > PIECE_BYTES:
        head = raw[start : start + PIECE_BYTES]
        at = max(head.rfind(b) for b in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
        if at <= 0:  # none, or only the blank that a piece starts with: the word goes on to the next one
            ends = [e for b in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f") if (e := raw.find(b, start + 1)) >= 0]
            at = (min(ends) if ends else len(raw)) - start
        yield raw[start : start + at].split()
        start += at
    yield raw[start:].split()


def word_pieces(raw: bytes | None) -> Iterator[list[bytes]]:
    """Lists of letter-and-digit words that together are the words of the text; none for null."""
    if raw:
        yield from _pieces(raw.translate(_WORD))


def plain_pieces(raw: bytes | None) -> Iterator[list[bytes]]:
    """The same for words that only white space separates."""
    if raw:
        yield from _pieces(raw.translate(_LOWER))


def binary_column(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def list_column(values: list[np.ndarray] | list[list], kind):
    """An Arrow list column of ``kind`` from one sequence per row."""
    sizes = np.fromiter((len(v) for v in values), dtype=np.int64, count=len(values))
    ends = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum(sizes, out=ends[1:])
    flat = np.concatenate([np.asarray(v) for v in values]) if sizes.sum() else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(kind))


def sliced(batches: Batches) -> Batches:
    """The batches in slices of a few rows, so that what is made of the texts stays small."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            yield whole.slice(at, ROWS)


def released(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A task body that gives its memory back at the end; workers live on between stages."""

    def body(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return body


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same for a task body that works row by row: it gets its batches in slices."""
    return released(lambda batches: run(sliced(batches)))
