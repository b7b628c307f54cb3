"""BPE by a tokenization automaton: merges are compiled, one gadget each, into a deterministic automaton whose paths are the right token sequences."""

from __future__ import annotations

import gc
import hashlib
import json
import re
import sys
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keratoline.llm._kept import kept

LONG = 64  # letters of a word above which it is not kept, as it comes seldom again
START = -1  # nothing comes before: every arc leaves this state


class Automaton:
    """The automaton of a list of merges over base symbols.

    Its arcs are tokens, and a sequence of tokens is a path just when merging
    its letters gives that sequence. At first there is one state, with an arc to
    itself for each base symbol. A merge (u, v) -> w then does two things: where
    u and v can follow each other, an arc w leads past both to where v led, and
    what u leads to becomes a state of its own without the arc v. So the state
    that a token leads to is all that is known of it, and w's is a copy of v's,
    taken before u loses v.

    A state is kept as what it lacks. An arc w that v's absence kept from being
    made is absent too, as is what grew from it. Tokens are numbered so that a
    token is followed by those that begin with it, the latest first (`place`);
    then each lost arc is one interval, and a state a row of intervals: an arc is
    missing if an odd number of the row's bounds are at or below its place.
    States of equal rows are one.
    """

    def __init__(self, base: list[int], merges: list[tuple[int, int, int]], final: set[int]):
        """base: tokens that no merge makes; merges: (left, right, made), the first to be applied first; final: tokens that end a word."""
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.rank: dict[int, int] = {}
        self.rule: dict[tuple[int, int], int] = {}
        lost = {t: array("i") for t in base if t not in final}
        alive, heads = set(base), {t: [] for t in base}
        for r, (u, v, w) in enumerate(merges):
            if u not in alive or v not in alive or u in final or not self._follows(u, v):
                continue  # nothing ever stands so when this merge's turn comes
            if w in alive:
                raise ValueError(f"token {w} is made twice")
            self.left[w], self.right[w], self.rank[w] = u, v, r
            alive.add(w)
            heads[w] = []
            heads[u].append(w)
            if w not in final:
                lost[w] = lost[v][:]
            lost[u].append(r)
            self.rule[u, v] = r
        self._number(base, heads)
        self._rows(lost, heads, merges)
        self.alive = alive

    def _follows(self, u: int, v: int) -> bool:
        """Whether the arc v leaves the state that u leads to, as far as merges have gone."""
        later = len(self.rule) + (1 << 30)
        x: int | None = v
        while x is not None:
            a: int | None = u
            bound = 1 << 31
            while a is not None:
                r = self.rule.get((a, x))
                if r is not None and r < bound and r <= later:
                    return False
                bound = min(bound, self.rank.get(a, -1))
                a = self.right.get(a)
            later = self.rank.get(x, -1)
            x = self.left.get(x)
        return True

    def _number(self, base: list[int], heads: dict[int, list[int]]) -> None:
        """place: each token's number; end: the number after the last token that begins with it."""
        self.place: dict[int, int] = {}
        self.end: dict[int, int] = {}
        stack = [(t, False) for t in reversed(base)]
        while stack:
            t, done = stack.pop()
            if done:
                self.end[t] = len(self.place)
                continue
            self.place[t] = len(self.place)
            stack.append((t, True))
            stack.extend((c, False) for c in heads[t])  # popped from the end: the latest first

    def _rows(self, lost: dict[int, array], heads: dict[int, list[int]], merges: list[tuple[int, int, int]]) -> None:
        """state: where each token leads; row: the bounds of each state's intervals, one after the other in `bounds`."""
        low, high = np.zeros(len(merges), np.int32), np.zeros(len(merges), np.int32)
        ranks = {t: [self.rank[c] for c in made] for t, made in heads.items()}
        for (_, v), r in self.rule.items():
            since = bisect_right(ranks[v], r - 1)
            low[r] = self.place[v]
            high[r] = self.end[heads[v][since]] if since < len(heads[v]) else low[r] + 1
        known: dict[bytes, int] = {}
        rows: list[np.ndarray] = []
        self.state: dict[int, int] = {}
        for t, own in lost.items():
            at = np.frombuffer(own, np.int32)
            at = at[np.argsort(low[at], kind="stable")]
            begins, ends = low[at], np.maximum.accumulate(high[at]) if len(at) else high[at]
            opens = np.concatenate([[True], begins[1:] > ends[:-1]]) if len(at) else np.empty(0, bool)
            closes = np.concatenate([opens[1:], [True]]) if len(at) else opens
            row = np.stack([begins[opens], ends[closes]], 1).astype(np.int32).ravel()
            s = known.setdefault(row.tobytes(), len(rows))
            if s == len(rows):
                rows.append(row)
            self.state[t] = s
        self.row = array("i", np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32).tobytes())
        self.bounds = array("i", np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int32).tobytes())


class Codec:
    """Encodes and decodes texts by a BPE file of the tokenizers library.

    The file's normaliser and pre-tokenizer part the text into words of
    byte symbols; all merging is the automaton's.
    """

    def __init__(self, path: str, keep: int = 600_000):
        from tokenizers import Tokenizer

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are laid out as little-endian unsigned 32-bit numbers")
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model, self.keep = said["model"], keep
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or said.get("decoder") or said.get("post_processor"):
            raise ValueError(f"{path} is no plain BPE whose tokens are decoded as they are: {odd}")
        parts = Tokenizer.from_file(path)
        self.normalizer, self.splitter = parts.normalizer, parts.pre_tokenizer
        self.labels = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in said["added_tokens"]}
        if any(t[k] for t in said["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(re.search(r"\s", t["content"]) for t in said["added_tokens"]):
            raise ValueError(f"{path} has added tokens that look at what is around them")
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in said["added_tokens"]}
        self.has_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self._compile(model)
        # Only where words are letters, digits or marks and white space is dropped can a text be parted at its spaces first.
        steps = (said.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        first = steps[0]
        gc.freeze()  # the automaton stays, so collections of garbage need not walk through it
        self.apart = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s\p{L}\p{N}]+" in first["pattern"].get("Regex", "") and {n["type"] for n in (said.get("normalizer") or {}).get("normalizers", [])} <= {"NFC", "Replace", "Lowercase"}

    def _compile(self, model: dict) -> None:
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = {a + b for a, b in merges}
        base = [t for t in vocab if t not in made]
        single = {t: (t, False) for t in base if len(t) == 1} | {t: (t[:1], True) for t in base if suffix and len(t) == 1 + len(suffix) and t.endswith(suffix)}
        if len(single) < 256 * (1 + bool(suffix)):
            raise ValueError("the vocabulary lacks byte symbols, so not every text can be encoded")
        spelt = {vocab[t]: x for t, x in single.items()}
        rules = []
        for a, b in merges:
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if u not in spelt or v not in spelt:
                raise ValueError(f"{a!r} and {b!r} are merged before they can be")
            spelt[w] = (spelt[u][0] + spelt[v][0], spelt[v][1])
            rules.append((u, v, w))
        self.automaton = auto = Automaton(list(map(vocab.get, single)), rules, {t for t, (_, final) in spelt.items() if final})
        # The arcs by their letters: a node holds its next nodes by letter, the arc that may go on as 0 and the one that ends a word as 1.
        self.root: dict = {}
        for t in auto.alive:
            node, (letters, final) = self.root, spelt[t]
            for c in letters:
                node = node.setdefault(c, {})
            arc = (auto.place[t], auto.state.get(t, START), t, len(letters))
            if final or not suffix:
                node[1] = arc
            if not final:
                node[0] = arc

    def _arcs(self, letters: str, at: int) -> list[tuple[int, int, int, int]]:
        """The arcs that are spelt from there on, the longest last."""
        found, node, last = [], self.root, len(letters) - 1
        for to in range(at, last):
            node = node.get(letters[to])
            if node is None:
                return found
            if 0 in node:
                found.append(node[0])
        node = node.get(letters[last])
        if node is not None and 1 in node:
            found.append(node[1])
        return found

    def word(self, letters: str) -> list[int]:
        """The ids of a word of byte symbols: the one path of the automaton that spells it.

        Longer arcs are tried first, and taken back where they lead nowhere. A
        place of the word is reached by one path at most, so none is tried from twice.
        """
        at, state, n, out, taken = 0, START, len(letters), [], []
        row, bounds = self.automaton.row, self.automaton.bounds
        arcs = self._arcs(letters, 0)
        while True:
            if not arcs:
                at, state, arcs = taken.pop()
                out.pop()
                continue
            place, to, token, length = arcs.pop()
            if state != START:
                begin = row[state]
                if (bisect_right(bounds, place, begin, row[state + 1]) - begin) & 1:
                    continue
            out.append(token)
            if at + length == n:
                return out
            taken.append((at, state, arcs))
            at, state = at + length, to
            arcs = self._arcs(letters, at)

    def _parts(self, text: str) -> bytes:
        """The ids of a text in which no added token stands."""
        if self.normalizer:
            text = self.normalizer.normalize_str(text)
        return b"".join([self.pieces.get(w) or self._spelt(w) for w, _ in self.splitter.pre_tokenize_str(text)])

    def _spelt(self, word: str) -> bytes:
        ids = array("I", self.word(word)).tobytes()
        if len(word) <= LONG:
            if len(self.pieces) >= self.keep:
                self.pieces.clear()
            self.pieces[word] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        if not self.has_added:
            return self._parts(text)
        return b"".join(self.added[p] if p in self.added else self._parts(p) for p in self.has_added.split(text) if p)

    def _learnt(self, chunk: str) -> bytes:
        ids = self._whole(chunk)
        if len(chunk) <= LONG:
            if len(self.words) >= self.keep:
                self.words.clear()
            self.words[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text; the chunks met lately are kept with their ids."""
        if not self.apart:
            return self._whole(text)
        get, learn = self.words.get, self._learnt
        return b"".join([learn(c) if (ids := get(c)) is None else ids for c in text.replace("\n", " ").split(" ") if c])

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, with a space between; ids that are no token's have none."""
        at = array("I", ids).tolist()
        try:
            return " ".join(map(self.labels.__getitem__, at))
        except KeyError:
            return " ".join(self.labels[i] for i in at if i in self.labels)


def codec_of(path: str) -> Codec:
    """One codec a Python worker: the automaton is compiled once there, its size bound by the vocabulary."""
    return kept("bpe_automaton", path, lambda: Codec(path))


def _with(rows: DataFrame, column: str, out: str, kind: T.DataType, arrow: pa.DataType, path: str, how) -> DataFrame:
    src = rows.select(*[c for c in rows.columns if c != out])
    at = src.columns.index(column)

    def run(batches):
        codec = codec_of(path)
        for batch in batches:
            made = [None if x is None else how(codec, x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow)], names=[*batch.schema.names, out])

    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(out, kind)]))


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds `out`, the ids (array of int) of each whole text; null for null, empty for a text without words.

    A string of the tokenizer's added tokens becomes that token. All rows and
    all other columns are kept; a column named `out` is replaced; texts of any
    length are encoded whole; an empty table gives an empty one.
    """
    return _with(docs, text, out, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), tokenizer_path, lambda codec, x: np.frombuffer(codec.encode(x), "<i4"))


def decode(rows: DataFrame, tokenizer_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds `out`, the tokens of each array of ids with a space between, special ones too; null for null, no token for a null or unknown id."""
    return _with(rows, ids, out, T.StringType(), pa.string(), tokenizer_path, lambda codec, x: codec.decode(array("I", [i for i in x if i is not None and i >= 0]).tobytes()))


def round_trip(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit numbers), decoded_sha256 (of the text decoded from them).

    A null text is empty: no ids. Null ids and repeated rows are documents like
    any other; texts of any length are encoded whole; other columns are not
    read; nothing is shuffled; an empty table gives an empty one.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        codec = codec_of(tokenizer_path)
        for batch in batches:
            n, sha, read = [], [], []
            for t in batch.column(1).to_pylist():
                ids = codec.encode(t or "")
                n.append(len(ids) // 4)
                sha.append(hashlib.sha256(ids).hexdigest())
                read.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(read, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text)).mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
