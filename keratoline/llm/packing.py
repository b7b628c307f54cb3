"""Packing of tokenised documents into fixed-length sequences by bounded-space online best fit."""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keratoline.llm._kept import kept

SEPARATOR = b"\0\0\0\0"  # id 0
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")
# Byte-level vocabularies show printable bytes as they are and the others, in order, from U+0100 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
BLANK = chr(SHOWN[32])


class OpenBins:
    """At most `limit` open bins. A bitset has bit f set while a bin with f free tokens is open.

    A piece goes to the open bin it fits best, which is the lowest bit at or
    above its length. Where none fits and all bins are in use, the fullest
    closes first, which is the lowest bit of all.
    """

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.bits, self.count, self.next = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        at = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        return at

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of this length."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            if self.count == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.count -= 1
            free, at = self.size, self.next
            self.next += 1
            self.count += 1
        left = free - length
        if left:
            self.by_free[left].append(at)
            self.bits |= 1 << left
        else:
            self.count -= 1
        return at, self.size - free


class Words(dict):
    """The ids of words that follow a space, learnt when first met; `keep` words at most, then it starts anew."""

    MARKS = ".,;:!?%&*$#"

    def __init__(self, tokenizer, keep: int):
        self.tokenizer, self.keep = tokenizer, keep
        self.marks: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.keep:
            self.clear()
        if LETTERS.match(word):  # one piece of the pattern, so it goes to the merges at once
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(SHOWN)
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize(BLANK + shown)]).tobytes()
        else:
            base = word.rstrip(self.MARKS)
            end = word[len(base) :]
            if end and base[-1:].isalpha():  # the pattern too cuts marks from a letter before them
                if end not in self.marks:
                    self.marks[end] = self.encode(end)
                ids = self[base] + self.marks[end]
            else:
                ids = self.encode(f" {word}")
        self[word] = ids
        return ids


def by_words(file: dict) -> bool:
    """Whether a tokenizer file, parsed, cuts by the usual byte-level pattern and by nothing else, and merges without chance."""
    cut, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    return bool(usual and not file.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout"))


class Encoder:
    """Byte-level BPE ids as little-endian unsigned 32-bit bytes, with the words met lately kept.

    The vocabulary's pattern always cuts before a space that follows other than
    white space, so text between such spaces can be encoded by itself. A text
    with a string of the tokenizer's added tokens is encoded in one go, and so
    are all texts where the file has another pattern, a normaliser or a model of
    another kind (by_words() tells).
    """

    ODD = re.compile(r"\s ")

    def __init__(self, path: str, keep: int = 1_000_000):
        from tokenizers import Tokenizer

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are laid out as little-endian unsigned 32-bit numbers")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words = Words(self.tokenizer, keep)
        self.whole = not by_words(json.loads(self.tokenizer.to_str()))

    def __call__(self, text: str) -> bytes:
        if self.whole or self.ODD.search(text) or any(t in text for t in self.added):
            return self.words.encode(text)
        head, *rest = text.split(" ")
        return self.words.encode(head) + b"".join(map(self.words.__getitem__, rest))


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", size: int = 2048, open_bins: int = 4096) -> DataFrame:
    """Packs documents into sequences of at most `size` tokens.

    A document is its ids and a separator (id 0). Only documents longer than a
    sequence are cut, into pieces of `size` ids, of which the first may be
    shorter. Each task packs the documents of its partition as they come, with
    `open_bins` open bins; memory is a batch, the bins and the words met
    lately, and nothing is shuffled.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. A null text is empty: one piece of one separator. Repeated rows are
    documents of their own; null ids are allowed; other columns are not read;
    an empty table gives an empty one; texts of any length are encoded whole.
    A string of the tokenizer's added tokens becomes that token, as the
    tokenizer has it. Any tokenizer file gives its own ids; words are kept with
    theirs only where its rules allow that.
    """
    return _mapped(docs, tokenizer_path, doc_id, text, size, open_bins, False)


def pack_ids(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", size: int = 2048, open_bins: int = 4096) -> DataFrame:
    """As pack(), with the ids of each piece as `ids` (array of int), to be laid out by sequence and offset."""
    return _mapped(docs, tokenizer_path, doc_id, text, size, open_bins, True)


def _mapped(docs: DataFrame, path: str, doc_id: str, text: str, size: int, open_bins: int, ids: bool) -> DataFrame:
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        encoder, bins = kept("packing", path, lambda: Encoder(path)), OpenBins(size, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows, where, whole = [], [], []
            for i, text in enumerate(texts):
                data = encoder(text) + SEPARATOR
                n = len(data) // 4
                at, to, piece = 0, n % size or min(n, size), 0
                while at < n:
                    part = data[4 * at : 4 * to]
                    rows.append((i, piece, at, to - at, zlib.crc32(part)))
                    where.append(bins.place(to - at))
                    if ids:
                        whole.append(np.frombuffer(part, "<i4"))
                    at, to, piece = to, to + size, piece + 1
            own, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.empty(0, np.int64)] * 5
            seq, offset = (np.array(x, np.int64) for x in zip(*where, strict=True)) if rows else [np.empty(0, np.int64)] * 2
            columns = [batch.column(0).take(pa.array(own)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, crc, seq + base, offset))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            if ids:
                columns.append(pa.array(whole, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * ids
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)
