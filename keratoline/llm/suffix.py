"""Removal of every byte that lies in a repeated string of a given length, by
prefix-free parsing.

A rolling hash of TRIGGER bytes marks trigger strings; a phrase runs from one
trigger string to the end of the next, so no phrase suffix longer than a
trigger is a prefix of another, and equal strings are cut alike wherever they
stand.

1. Units of documents send the fingerprints of their distinct phrases to be
   counted. A window (a string of `length` bytes) that holds a phrase of which
   the corpus has one is alone; the others are open.
2. Open windows go to partitions by their anchor, the trigger-sized string in
   them with the smallest hash, so equal windows meet. Neighbouring windows
   mostly share their anchor and travel as one segment of text, once a unit.
3. A partition parses its segments, sorts the suffixes of the dictionary (its
   distinct phrases) and of the parse (the phrases' ranks) into suffix arrays,
   and combines them: windows in the order of (rank of the rest of the phrase,
   rank of the parse behind it) stand in the lexicographic order of the corpus.
   Neighbours that have `length` bytes in common, compared as bytes, repeat.
4. The units get a bit for each open window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keratoline.llm import _hashing as H
from keratoline.llm import _spark as S
from keratoline.llm._kept import only

TRIGGER, EVERY = 12, 32
RUN = 400  # windows of a segment at most
SLICE = 2 << 20  # bytes of segments that a partition orders at a time, by whole anchors
PHRASE, SEGMENT = 0, 1


def triggers(data: np.ndarray, starts: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the trigger strings of the texts at starts begin, and in which text."""
    hit = np.flatnonzero(grams % H.U64(EVERY) == 0)
    text = np.searchsorted(starts, hit, "right") - 1
    inside = hit + TRIGGER <= starts[text + 1]
    return hit[inside], text[inside]


class Parse:
    """The phrases of one unit's documents, and the segments of its open windows."""

    def __init__(self, texts: pa.ChunkedArray, length: int):
        self.data, self.starts = H.doc_bytes(texts)
        self.n, self.length = len(self.data), length
        self.grams = H.rolling(self.data, TRIGGER)
        hit, doc = triggers(self.data, self.starts, self.grams)
        joined = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.empty(0, np.int64)
        self.at, self.to = hit[joined], hit[joined + 1] + TRIGGER
        self.phrase = H.ranges_hash(self.data, self.at, self.to)

    def segments(self, count: np.ndarray, buckets: int) -> Segments:
        """Given how often the corpus has each phrase."""
        n, k = self.n, self.length
        if n < k:
            return Segments(self.data, k, *np.empty((2, 0), np.int64), np.empty(0, H.U64), buckets)
        alone = (self.to - self.at <= k) & (count == 1)
        open_ = ~H.short_tail(self.starts, k, n) & ~H.cover(np.maximum(self.to - k, 0)[alone], self.at[alone] + 1, n)
        at = np.flatnonzero(open_[: n - k + 1])
        anchor = H.sliding_min(self.grams, k - TRIGGER + 1)[at]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (anchor[1:] != anchor[:-1])])) if len(at) else at
        size = np.diff(np.append(first, len(at)))
        parts = -(-size // RUN)  # long runs of one anchor (in periodic text) are cut
        nth = H.counting(parts)
        size = np.minimum(np.repeat(size, parts) - nth * RUN, RUN)
        return Segments(self.data, k, np.repeat(at[first], parts) + nth * RUN, size, np.repeat(anchor[first], parts), buckets)


class Segments:
    """Runs of open windows of one anchor; equal ones are sent once.

    at, size: the first window of each run, and how many there are. back: its
    place among the distinct ones, which go by bucket and fingerprint.
    """

    def __init__(self, data: np.ndarray, length: int, at: np.ndarray, size: np.ndarray, anchor: np.ndarray, buckets: int):
        self.data, self.length, self.at, self.size = data, length, at, size
        key = H.ranges_hash(data, at, at + size - 1 + length)
        anchor = H.mix(anchor)
        bucket = ((anchor >> H.U64(32)) * H.U64(buckets)) >> H.U64(32)
        order = np.lexsort((key, bucket))
        new = np.concatenate([[True], np.diff(key[order]) != 0]) if len(key) else np.empty(0, bool)
        self.back = np.empty(len(key), np.int64)
        self.back[order] = np.cumsum(new) - 1
        self.own = order[new]  # one of each of the distinct
        self.many = np.bincount(self.back, minlength=len(self.own))
        self.bucket, self.anchor = bucket[self.own], anchor[self.own]

    def rows(self, u: int) -> list[tuple]:
        out = []
        edge = np.flatnonzero(np.concatenate([[True], np.diff(self.bucket) != 0, [True]])) if len(self.own) else []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            own = self.own[a:b]
            text = H.gather(self.data, self.at[own], self.size[own] - 1 + self.length).tobytes()
            low = (self.anchor[a:b] & H.U64(0xFFFFFFFF)).astype("<u4").tobytes()
            out.append((int(self.bucket[a]), u, SEGMENT, low, H.pack(self.size[own]), text, H.pack(self.many[a:b])))
        return out

    def spread(self, bits: np.ndarray, n: int) -> np.ndarray:
        """A bool per position of the unit, from the bits of all windows of the distinct segments."""
        size = self.size[self.own]
        before = np.cumsum(size) - size
        nth = H.counting(self.size)
        out = np.zeros(n, bool)
        out[np.repeat(self.at, self.size) + nth] = bits[np.repeat(before[self.back], self.size) + nth]
        return out


def ranks(key: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """The rank of each suffix, by prefix doubling: key orders the first `depth` symbols.

    left: symbols up to and with the end mark of the string that a suffix lies
    in. Equal suffixes (of different strings) have equal ranks.
    """
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(len(key), np.int64)
    slots = np.arange(len(key))
    while True:
        pos = order[slots]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        rank[pos] = np.repeat(slots[first], size)
        slots = slots[np.repeat((size > 1) & (left[pos[first]] > depth), size)]
        if not len(slots):
            return rank
        pos = order[slots]
        key = (rank[pos] << 32) | rank[pos + depth]
        again = np.argsort(key)
        key, order[slots] = key[again], pos[again]
        depth *= 2


def corpus_order(data: np.ndarray, starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The positions `at` of the texts at starts, in the lexicographic order of the suffixes that begin there."""
    grams = H.rolling(data, TRIGGER)
    begin = np.union1d(starts[:-1], triggers(data, starts, grams)[0])
    text = np.searchsorted(starts, begin, "right") - 1
    last = np.append(text[1:] != text[:-1], True)
    end = np.where(last, starts[text + 1], np.append(begin[1:], 0) + TRIGGER)
    _, one, phrase = np.unique(H.ranges_hash(data, begin, end) ^ (last.astype(H.U64) * H.U64(0x9FB21C651E98DF25)), return_index=True, return_inverse=True)

    # The dictionary: distinct phrases, each with its end mark (0 where a text ends, else 1), bytes from 2 on.
    size = (end - begin)[one]
    place = np.cumsum(size + 1) - size - 1
    left = np.repeat(size + 1, size + 1) - H.counting(size + 1)
    symbol = np.empty(len(left) + 6, np.uint64)
    symbol[: len(left)][left > 1] = H.gather(data, begin[one], size).astype(np.uint64) + H.U64(2)
    symbol[: len(left)][left == 1] = ~last[one]
    key = np.zeros(len(left), np.uint64)
    for j in range(7):  # of 9 bits
        key <<= H.U64(9)
        key |= np.where(left > j, symbol[j : j + len(left)], H.U64(0))
    rank = ranks(key, left, 7)
    del key, symbol

    # The parse: ranks of phrases, an end mark after each text.
    there = np.arange(len(begin)) + text
    parse = np.zeros(len(begin) + len(starts) - 1, np.int64)
    parse[there] = rank[place[phrase]] + 1
    many = np.bincount(text, minlength=len(starts) - 1) + 1
    parse_rank = ranks(parse, np.repeat(many, many) - H.counting(many), 1)

    i = np.searchsorted(begin, at, "right") - 1
    return at[np.argsort((rank[place[phrase[i]] + at - begin[i]] << 32) | parse_rank[there[i] + 1], kind="stable")]


def repeated(data: np.ndarray, size: np.ndarray, many: np.ndarray, length: int) -> np.ndarray:
    """A bit for each window of distinct segments of so many windows, of which the corpus has so many copies: it has the window more than once."""
    starts = np.concatenate([[0], np.cumsum(size - 1 + length)])
    at = np.repeat(starts[:-1], size) + H.counting(size)
    copies = np.zeros(len(data), np.int32)
    copies[at] = np.repeat(np.minimum(many, 2), size)
    order = corpus_order(data, starts, at)
    window = np.lib.stride_tricks.sliding_window_view(data, length)
    new = np.ones(len(order), bool)
    for s in range(1, len(order), 1 << 15):
        own = order[s - 1 : s + (1 << 15)]
        strings = window[own]
        new[s : s + (1 << 15)] = (strings[1:] != strings[:-1]).any(1)
    first = np.flatnonzero(new)
    total = np.add.reduceat(copies[order], first, dtype=np.int64)
    out = np.zeros(len(data), bool)
    out[order] = np.repeat(total > 1, np.diff(np.append(first, len(order))))
    return out[at]


def judged(group: pa.Table, length: int) -> pa.Table:
    """The bits for all segments of one partition, in slices of whole anchors."""
    rows = group.to_pylist()
    sizes = [H.unpack(r["keys"]).astype(np.int64) for r in rows]
    size, many = np.concatenate(sizes), np.concatenate([H.unpack(r["ids"]) for r in rows]).astype(np.int64)
    anchor = np.concatenate([np.frombuffer(r["base"], "<u4") for r in rows])
    data = np.concatenate([np.frombuffer(r["flags"], np.uint8) for r in rows])
    span = size - 1 + length
    at = np.cumsum(span) - span
    key = H.ranges_hash(data, at, at + span)
    order = np.lexsort((key, anchor))
    first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    own, many = order[first], np.add.reduceat(many[order], first)
    change = np.append(np.flatnonzero(np.diff(anchor[own])) + 1, len(own))
    bits, a, before = [], 0, np.concatenate([[0], np.cumsum(span[own])])
    while a < len(own):
        b = change[max(np.searchsorted(before[change], before[a] + SLICE, "right") - 1, np.searchsorted(change, a, "right"))]
        bits.append(repeated(H.gather(data, at[own[a:b]], span[own[a:b]]), size[own[a:b]], many[a:b], length))
        a = b
    bits = np.concatenate(bits)
    before = np.cumsum(size[own]) - size[own]
    place = np.empty(len(key), np.int64)
    place[order] = np.repeat(before, np.diff(np.append(first, len(key))))
    told = bits[np.repeat(place, size) + H.counting(size)]
    cut = np.concatenate([[0], np.cumsum([x.sum() for x in sizes])])
    out = [(r["u"], r["b"], SEGMENT, int(y - x), np.packbits(told[x:y]).tobytes()) for r, x, y in zip(rows, cut[:-1], cut[1:], strict=True)]
    return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(H.TELL)], schema=H.TELL)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys; how often each stands; each key's place among them."""
    own, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    return own, count.astype(H.U64), back


def _count(kind: int, runs: H.Runs, flags: None, ids: np.ndarray) -> np.ndarray:
    """Whether the corpus has a phrase more than once."""
    return runs.spread(np.add.reduceat(ids, runs.first) > 1)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, unit_bytes: int = 4 << 20, digest: bool = False) -> DataFrame:
    """Removes each byte covered by a `length`-byte string that also starts anywhere else.

    Matches never cross documents; the same document and overlaps count; all
    strings are judged on the input. Returns the input's columns with `text`
    cut (a character of which a byte is removed goes as a whole; null stays
    null), or with digest=True: doc_id, n_bytes, n_removed, n_spans and
    kept_sha256 of the exact remaining bytes (a null text is empty). Empty and
    short texts have no window and stay whole; repeated rows repeat each other,
    so both go; an empty table gives an empty one; a null id is a document like
    any other; extra columns of any name are kept aside. Windows are compared
    as bytes; equal segments and phrases are recognised by 64-bit fingerprints.

    unit_bytes: text in one task's unit at a time. A longer text is a unit by
    itself and takes some 60 bytes of memory a byte. A phrase or segment
    reaches its partition once a unit that holds it, however often the unit
    does. A unit sends a row to each partition for which it has anything.
    Suffix arrays order SLICE bytes of a partition's segments at a time, whole
    anchors together; equal windows share an anchor, so none is missed, but the
    order is that of a slice and not of the corpus.
    """
    if length < TRIGGER:
        raise ValueError(f"length must be at least {TRIGGER}")
    spark = docs.sparkSession
    total = S.text_bytes(docs, text)
    units = max(1, -(-total // unit_bytes))
    buckets = max(S.shuffle_partitions(spark), -(-total // (96 << 20)))
    places = max(S.shuffle_partitions(spark), -(-total // (12 << 20)))
    bits = H.hash_bits(total // EVERY)
    rest = [] if digest else [c for c in docs.columns if c not in (doc_id, text)]
    id_type = docs.schema[doc_id].dataType
    units_df = docs.select(
        S.unit_of(doc_id, text, units).alias("u"), F.col(doc_id).alias("id"), F.col(text).alias("text"),
        *([F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).alias("rest")] if rest else []),
    )

    def first(key: tuple, unit: pa.Table) -> pa.Table:
        only("suffix")
        phrase, many, _ = _distinct(Parse(unit["text"], length).phrase >> H.U64(64 - bits))
        return H.asked(H.ask(key[0].as_py(), PHRASE, phrase, buckets, bits, ids=np.minimum(many, H.U64(2))))

    def opened(p: Parse, replies: pa.Table) -> Segments:
        _, _, back = _distinct(p.phrase >> H.U64(64 - bits))
        return p.segments(1 + H.told(replies, PHRASE)[back], places)

    def second(key: tuple, unit: pa.Table, replies: pa.Table) -> pa.Table:
        return H.asked(opened(Parse(unit["text"], length), replies).rows(key[0].as_py()))

    def last(key: tuple, unit: pa.Table, replies: pa.Table) -> pa.Table:
        p = Parse(unit["text"], length)
        starts = np.flatnonzero(opened(p, replies).spread(H.told(replies, SEGMENT), p.n))
        return _cut(unit, p, H.cover(starts, starts + length, p.n), digest, out_schema)

    asks = units_df.groupBy("u").applyInArrow(first, H.ASK_DDL)
    known = asks.groupBy("b").applyInArrow(lambda key, group: H.answer(group, _count), H.TELL_DDL)
    around = units_df.groupBy("u").cogroup(known.groupBy("u")).applyInArrow(second, H.ASK_DDL)
    both = known.union(around.groupBy("b").applyInArrow(lambda key, group: judged(group, length), H.TELL_DDL))
    if digest:
        schema = T.StructType([T.StructField("doc_id", id_type)] + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())])
    else:
        schema = T.StructType([T.StructField("id", id_type), T.StructField("text", T.StringType())] + ([units_df.schema["rest"]] if rest else []))
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(schema)
    out = units_df.groupBy("u").cogroup(both.groupBy("u")).applyInArrow(last, schema)
    if digest:
        return out
    return out.select(*[F.col("id").alias(c) if c == doc_id else F.col("text").alias(c) if c == text else F.col(f"rest.c{rest.index(c)}").alias(c) for c in docs.columns])


def _cut(unit: pa.Table, p: Parse, gone: np.ndarray, digest: bool, schema: pa.Schema) -> pa.Table:
    total = np.concatenate([[0], np.cumsum(gone)])
    n_gone = total[p.starts[1:]] - total[p.starts[:-1]]
    edge = gone.astype(np.int8)
    rise = np.flatnonzero(np.diff(edge, prepend=np.int8(0)) == 1)
    rise = np.unique(np.concatenate([rise, p.starts[:-1][(np.diff(p.starts) > 0)][gone[p.starts[:-1][np.diff(p.starts) > 0]]]])) if p.n else rise
    spans = np.searchsorted(rise, p.starts[1:]) - np.searchsorted(rise, p.starts[:-1])
    null = unit["text"].is_null().to_pylist()
    kept = []
    for i in range(len(unit)):
        a, b = p.starts[i], p.starts[i + 1]
        part = p.data[a:b][~gone[a:b]].tobytes() if n_gone[i] else p.data[a:b].tobytes()
        kept.append(hashlib.sha256(part).hexdigest() if digest else None if null[i] else part.decode("utf-8", "ignore"))
    if digest:
        columns = [unit["id"], pa.array(np.diff(p.starts)), pa.array(n_gone.astype(np.int64)), pa.array(spans.astype(np.int64)), pa.array(kept, pa.string())]
    else:
        columns = [unit["id"], pa.array(kept, pa.string()), *([unit["rest"]] if "rest" in unit.column_names else [])]
    return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
