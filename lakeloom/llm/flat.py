"""Vectorised text primitives on flat byte arrays.

An Arrow string column is one UTF-8 buffer with offsets. Words are runs of bytes other than space
and \\t..\\r, which are all ASCII, so they can be cut and hashed on that buffer for a whole batch at
once. Texts are never cut off: a long text only makes its own chunk longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
SLICE_BYTES = 1 << 18  # of a chunk, hashed at once: eight bytes of sums and powers for each byte
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _stream(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


BYTE_CODE = _stream(256, 11)
POSITION_CODE = _stream(64, 23) | U(1)
BASE = 0xD1342543DE82EF95
BASE_INVERSE = pow(BASE, -1, 1 << 64)
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=U)
        steps[0] = 1
        known = np.cumprod(steps, dtype=U)
        if n <= CHUNK_BYTES * 2:
            _POWERS[base] = known
    return known[:n]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of about ``limit`` bytes; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (byte positions) and row of every word."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """64-bit hash of each span of ``data``: a polynomial over coded bytes, shifted to position 0, then mixed."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):  # slices bound the sums and the tables of powers, also within one very long text
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE_BYTES)))
        lo, hi = int(starts[at]), int(ends[end - 1])
        total = np.zeros(hi - lo + 1, U)
        np.cumsum(code[data[lo:hi]] * _powers(BASE, hi - lo), dtype=U, out=total[1:])
        s, e = starts[at:end] - lo, ends[at:end] - lo
        out[at:end] = mix((total[e] - total[s]) * _powers(BASE_INVERSE, hi - lo + 1)[s] + (e - s).astype(U))
        at = end
    return out


def grams(word_hash: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words within one row, and the row of each."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = word_hash[:m] * POSITION_CODE[0]
    for i in range(1, n):
        total = total + word_hash[i : i + m] * POSITION_CODE[i]
    inside = rows[:m] == rows[n - 1 :]
    return mix(total[inside]), rows[:m][inside]


def unique_pairs(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, key), ordered by row and key."""
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    return rows[new], keys[new]


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal neighbours."""
    if not len(values):
        none = np.zeros(0, np.int64)
        return none, none
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return starts, np.diff(np.append(starts, len(values)))


#: Postings travel packed, one row for each chunk and shuffle partition: owners, keys of each owner, keys.
PACKED = "part int, owners binary, counts binary, keys binary"
PACKED_ARROW = pa.schema([("part", pa.int32()), ("owners", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])


PAIRED = PACKED + ", others binary"


def pack(owner: np.ndarray, keys: np.ndarray, partitions: int, by_owner: bool = False, others: np.ndarray | None = None) -> pa.RecordBatch:
    """Packs (owner, key) postings, grouped by owner, into one row for each of ``partitions`` by key or by owner.

    ``others``: a second key of each posting, which goes along and by which rows are dealt.
    """
    part = ((mix(owner.view(U)) if by_owner else keys if others is None else others) % U(partitions)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, owner, keys = part[order], owner[order], keys[order]
    more = [] if others is None else [others[order]]
    starts, lengths = runs(part)
    out: list[list] = [[] for _ in range(4 + len(more))]
    for s, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        o = owner[s : s + n]
        at, count = runs(o)
        out[0].append(int(part[s]))
        out[1].append(o[at].tobytes())
        out[2].append(count.astype(np.uint32).tobytes())
        for to, values in zip(out[3:], [keys, *more], strict=True):
            to.append(values[s : s + n].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=[*PACKED_ARROW.names, "others"][: len(out)])


def unpack(batches: Iterator[pa.RecordBatch], *columns: str) -> tuple[np.ndarray, ...]:
    """Owner and key of all postings in ``batches``, and what the other ``columns`` of keys hold."""
    names = ("keys", *columns)
    owners, keys = [np.zeros(0, np.int64)], [[np.zeros(0, U)] for _ in names]
    for batch in batches:
        for o, c, *values in zip(*(batch.column(name) for name in ("owners", "counts", *names)), strict=True):
            owners.append(np.repeat(np.frombuffer(o.as_buffer(), np.int64), np.frombuffer(c.as_buffer(), np.uint32)))
            for to, value in zip(keys, values, strict=True):
                to.append(np.frombuffer(value.as_buffer(), U))
    return (np.concatenate(owners), *(np.concatenate(x) for x in keys))
