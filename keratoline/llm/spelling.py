"""Grouping of spelling variants by a symmetric-delete join: words that differ by one letter share a word or a deletion."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keratoline.llm import _spark as S

# Latin-1 bytes of a run are letters, with A to Z lower-cased; all others part runs.
_RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
KEPT = 500_000  # distinct words that a task counts before it hands its counts on
KEPT_BYTES = 64 << 20
SLIP = 97  # of so many runs of a document, by checksum, one loses a letter


def runs_of(text: str) -> list[bytes]:
    """The maximal runs of letters up to U+00FF, A to Z lower-cased, as Latin-1."""
    return text.encode("latin-1", "replace").translate(_RUNS).split()


def slipped(prefix: int, run: bytes) -> bytes:
    """The run, without one letter if its checksum after the document's id says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    return run if h % SLIP else run[: (at := h % len(run))] + run[at + 1 :]


def counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 5, rarest: int = 3) -> DataFrame:
    """(word, n): words of at least `shortest` letters with how often all documents hold them, `rarest` times at least.

    A task counts what it reads, KEPT words at a time, before anything is
    shuffled. A null text holds no word; a null id counts as the empty text in
    the checksum; repeated rows count again; texts of any length are read whole;
    other columns are not read; an empty table gives an empty one.
    """

    def run(batches):
        total: Counter[bytes] = Counter()
        size = 0

        def told():
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                prefix = zlib.crc32(f"{doc}:".encode() if doc is not None else b":")
                for word, n in Counter(runs_of(body)).items():
                    if len(word) >= shortest and len(word := slipped(prefix, word)) >= shortest:
                        size += 0 if word in total else len(word)
                        total[word] += n
                if len(total) > KEPT or size > KEPT_BYTES:
                    yield told()
                    size = 0
        yield told()

    told = docs.select(F.col(doc_id), F.coalesce(F.col(text), F.lit(""))).mapInArrow(run, "word string, n long")
    return told.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rarest)


_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, key) for each word itself and each of its distinct single deletions.

    A key is a polynomial hash, of which a deletion takes two prefix sums and no
    copy of the word, so a word of any length takes time in proportion to it.
    Deleting any letter of a run of equal letters gives the same string: the
    first of each run stands for it. Equal strings have equal keys; what shares a
    key by chance is found out later.
    """
    length = np.array([len(w) for w in words], np.int64)
    if not length.sum():
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    own = np.repeat(np.arange(len(words)), length)
    at = np.arange(len(code)) - start[own]
    power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(length.max()), _BASE))])
    value = _mixed((code.astype(np.uint64) + np.uint64(1)) * _MIX)
    here = np.concatenate([[np.uint64(0)], np.cumsum(value * power[at])])
    before = np.concatenate([[np.uint64(0)], np.cumsum(value * power[np.maximum(at - 1, 0)])])
    end = start + length
    whole = here[end] - here[start]
    without = (here[:-1] - here[start[own]]) + (before[end[own]] - before[1:])
    first = np.concatenate([[True], (code[1:] != code[:-1]) | (at[1:] == 0)])
    keys = np.concatenate([whole + _mixed(length.astype(np.uint64) * _MIX), without[first] + _mixed((length[own[first]] - 1).astype(np.uint64) * _MIX)])
    return np.concatenate([np.arange(len(words)), own[first]]), keys


def near_words(words: DataFrame) -> DataFrame:
    """(a, b), once each with a < b: ids of the words of (id, word) that differ by exactly one letter more, less or other.

    Words meet by equal keys; only ids travel with the keys, and the words
    themselves come to the pairs to be compared. At most 91 letters fit each
    place of a key, so what meets under one is bounded by the alphabet and the
    length of the words, not by their number.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            own, keys = deletion_keys(batch.column(1).to_pylist())
            for at in range(0, len(own), 1 << 18):
                part = slice(at, at + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(ids[own[part]])], names=["key", "id"])

    keys = words.select("id", "word").mapInArrow(run, "key long, id long")
    left, right = keys.select("key", F.col("id").alias("a")), S.fresh(keys).select("key", F.col("id").alias("b"))
    met = left.join(right, "key").where("a < b").select("a", "b")
    met = met.join(words.select(F.col("id").alias("a"), F.col("word").alias("left")), "a").join(words.select(F.col("id").alias("b"), F.col("word").alias("right")), "b")
    return met.where(F.levenshtein("left", "right", 1) == 1).select("a", "b").distinct()  # a pair has one key in common, and another only by chance


def roots(steps: DataFrame) -> DataFrame:
    """(id, root) of (id, up): where the way up from each id ends. Ids that are none of the given are ends.

    Each round every id takes the step of its step, so rounds are the logarithm
    of the longest way; a round reads the one before it from the checkpoint
    folder and only whether anything moved comes to the driver.
    """
    now = S.checkpoint(steps.select("id", "up", F.lit(True).alias("moved")))
    while now.where("moved").limit(1).count():
        next_ = now.select(F.col("id").alias("up"), F.col("up").alias("further"))
        now = S.checkpoint(now.join(next_, "up", "left").select("id", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")))
    return now.select("id", F.col("up").alias("root"))


def variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """Groups words (word, n), each given once, under the forms they vary.

    Words are near if they differ by exactly one code point inserted, deleted or
    replaced. A word's form is its near word of largest n (ties: the smallest in
    code-point order), if that n is at least `factor` times (2 or more, so ways
    end) its own; its root is where following forms ends.

    Returns per word: word, form, root, n, n_near (near words), form_n. A null
    word or count takes no part; an empty table gives an empty one.
    """
    if factor < 2:
        raise ValueError("a form must be more frequent than its variant, or following forms need not end")
    words = S.checkpoint(words.where("word is not null and n is not null").select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    links = S.checkpoint(near_words(words))
    both = links.union(links.select("b", "a")).toDF("id", "other")
    other = words.select(F.col("id").alias("other"), F.struct((-F.col("n")).alias("less"), "word", F.col("id").alias("up")).alias("best"))
    best = both.join(other, "other").groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min("best").alias("best"))
    known = words.join(best, "id", "left")
    formed = F.coalesce(-F.col("best.less") >= factor * F.col("n"), F.lit(False))
    known = S.checkpoint(known.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best.word")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"), F.when(formed, F.col("best.up")).alias("up"),
    ))
    ends = roots(known.where("up is not null").select("id", "up"))
    named = ends.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return known.join(named, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """variants() of the words of all documents, as counts() counts them."""
    return variants(counts(docs, doc_id, text))
