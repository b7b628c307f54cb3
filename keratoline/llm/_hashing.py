"""Vectorised fingerprints of byte and word windows, and the packed exchange
in which units of documents ask hash-range buckets about their fingerprints.

A unit is a bounded block of documents, held by one task. It sends each bucket
its sorted distinct fingerprints, so however often a passage repeats inside a
unit, it is sent once; a fingerprint reaches its bucket at most once a unit.
The bucket answers with a bit or number per fingerprint, in the order sent, and the
unit, which can always recompute what it sent, reads them back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE = 1 << 18
_R = U64(0x9E3779B97F4A7C15)
_RINV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(r: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, r, U64)
    out[0] = U64(1)
    return np.multiply.accumulate(out)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least n of each."""
    n = max(1 << 12, 1 << (max(n, 1) - 1).bit_length())
    if n not in _tables:
        if len(_tables) > 8:
            _tables.clear()
        _tables[n] = _powers(_R, n), _powers(_RINV, n)
    return _tables[n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64 bits."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


BYTE = mix(np.arange(1, 257, dtype=U64) * _R)


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """The fingerprint of every k consecutive values; in slices, so memory beside the result is fixed."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.empty(n, U64)
    pw, inv = powers(SLICE + k)
    total = np.empty(SLICE + k, U64)
    for s in range(0, n, SLICE):
        part = values[s : s + SLICE + k - 1]
        part = BYTE[part] if part.dtype == np.uint8 else part
        m = len(part)
        total[0] = 0
        np.cumsum(part * pw[:m], out=total[1 : m + 1])
        out[s : s + m - k + 1] = mix((total[k : m + 1] - total[: m - k + 1]) * inv[: m - k + 1])
    return out


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The fingerprint of each of the given ascending, disjoint, non-empty byte spans."""
    if not len(starts):
        return np.empty(0, U64)
    size = ends - starts
    first = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=first[1:])
    pw, _ = powers(SLICE)
    offset = np.arange(first[-1], dtype=np.int64) - np.repeat(first[:-1], size)
    at = offset + np.repeat(starts, size)
    offset &= SLICE - 1  # weights repeat within longer spans
    return mix(np.add.reduceat(BYTE[data[at]] * pw[offset], first[:-1]) + size.astype(U64) * U64(0xD6E8FEB86659FD93))


def runs_hash(parts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of parts[a:b], for each pair of a < b."""
    pw, inv = powers(len(parts) + 1)
    total = np.zeros(len(parts) + 1, U64)
    np.cumsum(parts * pw[: len(parts)], out=total[1:])
    return mix((total[b] - total[a]) * inv[a] + (b - a).astype(U64) * U64(0xA0761D6478BD642F))


def counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one run behind the other."""
    sizes = np.asarray(sizes, np.int64)
    return np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def gather(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The given stretches of data, one behind the other."""
    return data[np.repeat(at, sizes) + counting(sizes)]


def ranges_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The fingerprint of each of the given stretches of bytes, which ascend and may overlap."""
    out = np.empty(len(starts), U64)
    a = 0
    while a < len(starts):
        low = starts[a]
        b = max(a + 1, int(np.searchsorted(starts, low + SLICE, "left")))
        high = ends[a:b].max()
        out[a:b] = runs_hash(BYTE[data[low:high]], starts[a:b] - low, ends[a:b] - low)
        a = b
    return out


def sliding_min(values: np.ndarray, k: int) -> np.ndarray:
    """The smallest of every k consecutive values, by windows of doubled width."""
    n, width = len(values) - k + 1, 1
    if n <= 0:
        return values[:0]
    while 2 * width <= k:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[:n], values[k - width : k - width + n])


def doc_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and where each text starts (one more entry: the end). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_spans(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, where each word (bytes other than ASCII white space) begins and ends, and which is each text's first word."""
    data, starts = doc_bytes(column)
    has = np.diff(starts) > 0
    word = ~SPACE[data]
    at = word.copy()
    at[1:] &= ~word[:-1]
    first = starts[:-1][has]
    at[first] = word[first]
    at = np.flatnonzero(at)
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    last = starts[1:][has] - 1
    stop[last] = word[last]
    return data, at, np.flatnonzero(stop) + 1, np.searchsorted(at, starts)


def words(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint of every word, and which is each text's first."""
    data, at, to, starts = word_spans(column)
    return spans_hash(data, at, to), starts


def short_tail(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Bool per position: fewer than k positions are left in its document."""
    size = np.diff(starts)
    has = size > 0
    end = starts[1:][has]
    mark = np.zeros(n + 1, np.int8)
    np.add.at(mark, np.maximum(starts[:-1][has], end - (k - 1)), 1)
    np.add.at(mark, end, -1)
    return np.cumsum(mark[:n], dtype=np.int8) > 0


def cover(at: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """Bool per position: some half-open span [at, to) holds it."""
    if not len(at):
        return np.zeros(n, bool)
    step = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(to, minlength=n + 1)[: n + 1]
    return np.cumsum(step[:n]) > 0


def pack(values: np.ndarray) -> bytes:
    """Ascending or arbitrary unsigned numbers as byte planes, without the planes that are zero."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(buf: bytes) -> np.ndarray:
    width = buf[0]
    planes = np.frombuffer(buf, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)


ASK = pa.schema([("b", pa.int32()), ("u", pa.int32()), ("kind", pa.int32()), ("base", pa.binary()), ("keys", pa.binary()), ("flags", pa.binary()), ("ids", pa.binary())])
ASK_DDL = "b int, u int, kind int, base binary, keys binary, flags binary, ids binary"
TELL = pa.schema([("u", pa.int32()), ("b", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("said", pa.binary())])
TELL_DDL = "u int, b int, kind int, n int, said binary"


def ask(u: int, kind: int, keys: np.ndarray, buckets: int, bits: int, flags: np.ndarray | None = None, ids: np.ndarray | None = None) -> list[tuple]:
    """Rows that take sorted distinct keys of so many bits to their buckets."""
    bounds = [-(-(b << bits) // buckets) for b in range(1, buckets)]
    cut = np.concatenate([[0], np.searchsorted(keys, np.array(bounds, U64)), [len(keys)]]).astype(np.int64)
    out = []
    for b in np.flatnonzero(cut[1:] > cut[:-1]):
        part = keys[cut[b] : cut[b + 1]]
        out.append((
            int(b), u, kind, int(part[0]).to_bytes(8, "little"), pack(np.diff(part, prepend=part[:1])),
            None if flags is None else flags[cut[b] : cut[b + 1]].tobytes(),
            None if ids is None else pack(ids[cut[b] : cut[b + 1]]),
        ))
    return out


def asked(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ASK)], schema=ASK)


def answer(group: pa.Table, judge) -> pa.Table:
    """judge(kind, runs, flags, ids, these in the keys' order) -> a bool or a number for each entry; see Runs."""
    rows = group.to_pylist()
    out = []
    for kind in sorted({r["kind"] for r in rows}):
        own = [r for r in rows if r["kind"] == kind]
        keys = []
        for r in own:
            step = unpack(r["keys"])
            keys.append(np.cumsum(step, dtype=U64) + U64(int.from_bytes(r["base"], "little")))
        sizes = [len(k) for k in keys]
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        del keys
        flags = np.frombuffer(b"".join(r["flags"] for r in own), np.uint8)[order] if own[0]["flags"] is not None else None
        ids = np.concatenate([unpack(r["ids"]) for r in own])[order] if own[0]["ids"] is not None else None
        said = judge(kind, Runs(first, len(order)), flags, ids)
        verdict = np.empty(len(order), said.dtype)
        verdict[order] = said
        for r, part in zip(own, np.split(verdict, np.cumsum(sizes)[:-1]), strict=True):
            out.append((r["u"], r["b"], kind, len(part), np.packbits(part).tobytes() if part.dtype == bool else pack(part)))
    return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(TELL)], schema=TELL)


class Runs:
    """Equal keys stand together; first holds where each run starts."""

    def __init__(self, first: np.ndarray, n: int):
        self.first, self.size = first, np.diff(np.append(first, n))

    def spread(self, per_run: np.ndarray) -> np.ndarray:
        return np.repeat(per_run, self.size)

    def any(self, flags: np.ndarray) -> np.ndarray:
        return np.bitwise_or.reduceat(flags, self.first)


def told(replies: pa.Table, kind: int, numbers: bool = False) -> np.ndarray:
    """The bits or numbers for all keys of this kind, in ascending order of the keys."""
    rows = sorted((r for r in replies.to_pylist() if r["kind"] == kind), key=lambda r: r["b"])
    if numbers:
        return np.concatenate([unpack(r["said"]) for r in rows]).astype(np.int64) if rows else np.empty(0, np.int64)
    bits = [np.unpackbits(np.frombuffer(r["said"], np.uint8), count=r["n"]) for r in rows]
    return np.concatenate(bits).astype(bool) if bits else np.empty(0, bool)


def hash_bits(n: int, spare: int = 13) -> int:
    """Bits with which few of n fingerprints are alike by chance; for filters only."""
    return min(64, max(24, n.bit_length() + spare))
