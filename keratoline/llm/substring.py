"""Removal of word passages that an earlier document has, by fixed-block anchors.

Each document's non-overlapping blocks of BLOCK words are the reference blocks.
Every rolling window of BLOCK words probes them; a passage of `window` words
(at least two blocks less one word) holds a whole reference block of whichever
document it is compared with, so a passage in which no probe hits is alone.

The passages around hits travel to the partition of their anchor (of the hits
in them, the block with the smallest hash), neighbours of one anchor as one
segment of text, once a unit. There each hit is extended: all places with the
same block are compared word by word, as bytes, to the right and to the left,
and stay together as far as they agree, a window to each side at most. So every
repeat of a window or more shows, a long one as windows that overlap, without
listing pairs. The smallest document keeps each passage.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keratoline.llm import _hashing as H
from keratoline.llm import _spark as S
from keratoline.llm._kept import only

PROBE, SEGMENT = 0, 1
RUN = 100  # passages of a segment at most
_NEVER = np.int64(-(1 << 63))  # documents without an id: they take no part
_NO_HIT = H.U64(0xFFFFFFFFFFFFFFFF)


class Words:
    """The words of one unit's documents: fingerprints, bytes, and where each document's begin."""

    def __init__(self, unit: pa.Table, window: int):
        self.data, self.at, self.to, self.starts = H.word_spans(unit["text"])
        self.hash = H.spans_hash(self.data, self.at, self.to)
        self.n, self.window = len(self.hash), window
        ids = unit["id"].combine_chunks() if unit["id"].num_chunks != 1 else unit["id"].chunk(0)
        self.ids = np.asarray(pc.fill_null(ids.cast(pa.int64()), int(_NEVER)))
        self.doc = np.repeat(self.ids, np.diff(self.starts))
        self.whole = ~H.short_tail(self.starts, window, self.n) & (self.doc != _NEVER) if self.n else np.empty(0, bool)


class Probes:
    """All blocks of documents that have a whole passage: where they are, their fingerprints, and the distinct short ones sent."""

    def __init__(self, w: Words, block: int, bits: int):
        hashes = H.rolling(w.hash, block)
        size = np.diff(w.starts)
        fits = np.repeat((size >= w.window) & (w.ids != _NEVER), size)[: len(hashes)]
        fits &= ~H.short_tail(w.starts, block, w.n)[: len(hashes)]
        self.at = np.flatnonzero(fits)
        self.hash = hashes[self.at]
        self.keys, self.back = np.unique(self.hash >> H.U64(64 - bits), return_inverse=True)

    def flags(self, w: Words, block: int) -> np.ndarray:
        """Per key: bit 0, one of its places is a reference block; bit 1, more than one document has it."""
        docs, flags = w.doc[self.at], np.zeros(len(self.keys), np.uint8)
        one = np.zeros(len(self.keys), np.int64)
        one[self.back] = docs
        flags[self.back[docs != one[self.back]]] = 2
        place = self.at - np.repeat(w.starts[:-1], np.diff(w.starts))[self.at]
        flags[self.back[place % block == 0]] |= 1
        return flags


class Segments:
    """Runs of passages with a hit that have one anchor; equal ones are sent once, with their smallest document."""

    def __init__(self, w: Words, probes: Probes, hit: np.ndarray, block: int, buckets: int):
        self.w = w
        value = np.full(max(0, w.n - block + 1), _NO_HIT)
        value[probes.at[hit]] = H.mix(probes.hash[hit])
        low = H.sliding_min(value, w.window - block + 1)
        at = np.flatnonzero(w.whole[: len(low)] & (low != _NO_HIT))
        anchor = low[at]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (anchor[1:] != anchor[:-1]) | (w.doc[at[1:]] != w.doc[at[:-1]])])) if len(at) else at
        size = np.diff(np.append(first, len(at)))
        parts = -(-size // RUN)
        nth = H.counting(parts)
        self.at, self.size = np.repeat(at[first], parts) + nth * RUN, np.minimum(np.repeat(size, parts) - nth * RUN, RUN)
        anchor = np.repeat(anchor[first], parts)
        key = H.runs_hash(w.hash, self.at, self.at + self.size - 1 + w.window) if len(self.at) else anchor
        bucket = ((H.mix(anchor) >> H.U64(32)) * H.U64(buckets)) >> H.U64(32)
        doc = w.doc[self.at]
        order = np.lexsort((doc, key, bucket))
        new = np.concatenate([[True], np.diff(key[order]) != 0]) if len(key) else np.empty(0, bool)
        self.back = np.empty(len(key), np.int64)
        self.back[order] = np.cumsum(new) - 1
        self.own = order[new]
        self.bucket, self.anchor, self.low = bucket[self.own], anchor[self.own], doc[self.own]

    def rows(self, u: int) -> list[tuple]:
        out, w = [], self.w
        edge = np.flatnonzero(np.concatenate([[True], np.diff(self.bucket) != 0, [True]])) if len(self.own) else []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            own = self.own[a:b]
            begin, end = w.at[self.at[own]], w.to[self.at[own] + self.size[own] - 2 + w.window]
            text = b"\n".join(w.data[i:j].tobytes() for i, j in zip(begin.tolist(), end.tolist(), strict=True))
            out.append((int(self.bucket[a]), u, SEGMENT, self.anchor[a:b].astype("<u8").tobytes(), H.pack(self.size[own]), text, H.pack(self.low[a:b].view(H.U64))))
        return out

    def seen(self, bits: np.ndarray) -> np.ndarray:
        """The unit's passages that a smaller document has: those of the bits, and copies of a segment that a smaller one of the unit has too."""
        size = self.size[self.own]
        before = np.cumsum(size) - size
        nth = H.counting(self.size)
        told = bits[np.repeat(before[self.back], self.size) + nth]
        told |= np.repeat(self.w.doc[self.at] > self.low[self.back], self.size)
        return (np.repeat(self.at, self.size) + nth)[told]


def _agree(group: np.ndarray, words: np.ndarray, first: np.ndarray, step: int, reach: int) -> np.ndarray:
    """Column j: the group of each place after j words more, from its first word on by `step`, are compared.

    Places stay in a group as long as they agree; a place that is alone is not
    looked at any more.
    """
    m = len(group)
    out = np.empty((m, reach + 1), np.int64)
    out[:, 0] = group
    live, fresh = np.arange(m), int(group.max()) + 1
    for j in range(reach):
        out[:, j + 1] = out[:, j]
        _, now, count = np.unique(out[live, j], return_inverse=True, return_counts=True)
        live = live[count[now] > 1]
        if not len(live):
            out[:, j + 2 :] = out[:, j + 1 : j + 2]
            break
        at = first[live] + step * j
        word = np.where((at >= 0) & (at < len(words)), words[np.clip(at, 0, len(words) - 1)], -1)
        _, now = np.unique((out[live, j] << 32) | (word + 1), return_inverse=True)
        out[live, j + 1] = fresh + now
        fresh += int(now.max()) + 1
        if fresh > 1 << 30:
            _, back = np.unique(out[:, j + 1], return_inverse=True)
            out[:, j + 1], fresh = back, int(back.max()) + 1
    return out


def extended(words: np.ndarray, starts: np.ndarray, size: np.ndarray, doc: np.ndarray, place: np.ndarray, block_of: np.ndarray, window: int, block: int) -> np.ndarray:
    """A bit for each passage of the segments: a smaller document has it.

    words: numbers of the words of all segments; starts, size, doc: where each
    begins, its passages and its document; place: where hits of the segments'
    own anchors are, ascending, and block_of a number for each hit's block.
    """
    at = np.repeat(starts, size) + H.counting(size)
    hit = np.searchsorted(place, at)
    before = place[hit] - at  # words of the passage before its hit
    doc = np.repeat(doc, size)
    right = _agree(block_of, words, place, 1, window)
    left = _agree(block_of, words, place - 1, -1, window - block)
    _, right = np.unique(right, return_inverse=True)
    _, left = np.unique(left, return_inverse=True)
    right, left = right.reshape(len(place), -1), left.reshape(len(place), -1)
    key = (left[hit, before].astype(np.int64) * (int(right.max()) + 1) + right[hit, window - before]) * (window + 1) + before
    order = np.lexsort((doc, key))
    first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    out = np.empty(len(at), bool)
    out[order] = doc[order] > np.repeat(doc[order][first], np.diff(np.append(first, len(order))))
    return out


def judged(group: pa.Table, window: int, block: int) -> pa.Table:
    """The bits for all segments of one partition."""
    rows = group.to_pylist()
    sizes = [H.unpack(r["keys"]).astype(np.int64) for r in rows]
    size, doc = np.concatenate(sizes), np.concatenate([H.unpack(r["ids"]) for r in rows]).view(np.int64)
    anchor = np.concatenate([np.frombuffer(r["base"], "<u8") for r in rows])
    text = b"\n".join(r["flags"] for r in rows)
    words = pa.array(text.split(), pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    span = size - 1 + window
    starts = np.cumsum(span) - span
    hashes = H.mix(H.rolling(H.words(pa.array([text], pa.binary()))[0], block))
    place = np.flatnonzero(hashes == np.repeat(anchor, span)[: len(hashes)])
    segment = np.searchsorted(starts, place, "right") - 1
    inside = place + block <= starts[segment] + span[segment]
    place, segment = place[inside], segment[inside]
    _, block_of = np.unique(anchor[segment], return_inverse=True)
    told = extended(words, starts, size, doc, place, block_of, window, block)
    cut = np.concatenate([[0], np.cumsum([x.sum() for x in sizes])])
    out = [(r["u"], r["b"], SEGMENT, int(y - x), np.packbits(told[x:y]).tobytes()) for r, x, y in zip(rows, cut[:-1], cut[1:], strict=True)]
    return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(H.TELL)], schema=H.TELL)


def _judge(kind: int, runs: H.Runs, flags: np.ndarray, ids: None) -> np.ndarray:
    """Whether a block is a reference block and more than one document has it."""
    seen = runs.any(flags)
    return runs.spread((seen & 1 > 0) & ((runs.size > 1) | (seen & 2 > 0)))


def _units(docs: DataFrame, doc_id: str, text: str, window: int, unit_bytes: int, finish, schema: str) -> DataFrame:
    """finish(unit, words, starts of the passages that a smaller document has), unit by unit."""
    spark = docs.sparkSession
    total = S.text_bytes(docs, text)
    units = max(1, -(-total // unit_bytes))
    buckets = max(S.shuffle_partitions(spark), -(-total // (24 << 20)))
    places = max(S.shuffle_partitions(spark), -(-total // (12 << 20)))
    bits = H.hash_bits(total // 6)
    block = (window + 1) // 2
    units_df = docs.select(S.unit_of(doc_id, text, units).alias("u"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    def first(key: tuple, unit: pa.Table) -> pa.Table:
        only("substring")
        w = Words(unit, window)
        probes = Probes(w, block, bits)
        return H.asked(H.ask(key[0].as_py(), PROBE, probes.keys, buckets, bits, probes.flags(w, block)))

    def segments(w: Words, replies: pa.Table) -> Segments:
        probes = Probes(w, block, bits)
        return Segments(w, probes, H.told(replies, PROBE)[probes.back], block, places)

    def second(key: tuple, unit: pa.Table, replies: pa.Table) -> pa.Table:
        return H.asked(segments(Words(unit, window), replies).rows(key[0].as_py()))

    def last(key: tuple, unit: pa.Table, replies: pa.Table) -> pa.Table:
        w = Words(unit, window)
        return finish(unit, w, np.sort(segments(w, replies).seen(H.told(replies, SEGMENT))))

    asks = units_df.groupBy("u").applyInArrow(first, H.ASK_DDL)
    known = asks.groupBy("b").applyInArrow(lambda key, group: H.answer(group, _judge), H.TELL_DDL)
    around = units_df.groupBy("u").cogroup(known.groupBy("u")).applyInArrow(second, H.ASK_DDL)
    both = known.union(around.groupBy("b").applyInArrow(lambda key, group: judged(group, window, block), H.TELL_DDL))
    return units_df.groupBy("u").cogroup(both.groupBy("u")).applyInArrow(last, schema)


def drop_seen_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50, unit_bytes: int = 4 << 20, digest: bool = False) -> DataFrame:
    """Removes each word covered by a `window`-word sequence that also starts in a document with a smaller id.

    Words are maximal runs of bytes other than ASCII white space, unchanged.
    Windows lie within a document and are judged on the input. Returns doc_id,
    n_words, n_removed and the kept words joined by one space as kept_text, or
    with digest=True their kept_sha256 instead (of the UTF-8 bytes). A null
    text has no words; texts shorter than a window stay whole; rows that share
    an id are one document, so they never remove each other's words; a document
    without an id stays whole and removes nothing; other columns are not read;
    an empty table gives an empty one. Ids are 64-bit whole numbers. Words are
    compared as bytes; that a segment stands twice in one unit is told by a
    64-bit fingerprint.

    unit_bytes: text in one task's unit at a time. A longer text is a unit by
    itself and takes some 20 bytes of memory a byte. A block or segment reaches
    its partition once a unit that holds it, however often the unit does.
    """
    kept_name = "kept_sha256" if digest else "kept_text"

    def finish(unit: pa.Table, w: Words, seen: np.ndarray) -> pa.Table:
        gone = H.cover(seen, seen + window, w.n)
        total = np.concatenate([[0], np.cumsum(gone)])
        n_gone = total[w.starts[1:]] - total[w.starts[:-1]]
        kept = []
        for i, t in enumerate(unit["text"].to_pylist()):
            words = (t or "").encode().split()
            if n_gone[i]:
                words = compress(words, ~gone[w.starts[i] : w.starts[i + 1]])
            words = b" ".join(words)
            kept.append(hashlib.sha256(words).hexdigest() if digest else words.decode())
        return pa.table({"doc_id": unit["id"].cast(pa.int64()), "n_words": np.diff(w.starts), "n_removed": n_gone.astype(np.int64), kept_name: pa.array(kept, pa.string())})

    return _units(docs, doc_id, text, window, unit_bytes, finish, f"doc_id long, n_words long, n_removed long, {kept_name} string")


def seen_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50, unit_bytes: int = 4 << 20) -> DataFrame:
    """The maximal runs of words all of whose windows also start in documents with a smaller id: doc_id, first_word (from 0), n_words.

    Nulls, repeats and the like are as in drop_seen_passages().
    """

    def finish(unit: pa.Table, w: Words, seen: np.ndarray) -> pa.Table:
        row = np.searchsorted(w.starts, seen, "right") - 1
        new = np.concatenate([[True], (np.diff(seen) != 1) | (np.diff(row) != 0)]) if len(seen) else np.empty(0, bool)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(seen))) - 1 + window
        return pa.table({"doc_id": w.ids[row[first]], "first_word": seen[first] - w.starts[row[first]], "n_words": size})

    return _units(docs, doc_id, text, window, unit_bytes, finish, "doc_id long, first_word long, n_words long")
