"""SentencePiece encoding by an Aho-Corasick automaton that drives a single-pass Viterbi, and decoding."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keratoline.llm._kept import kept

BLANK = "▁"  # fixed value: stands for a space inside pieces
CHUNK = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class Pieces:
    """A model's pieces, scores and byte pieces."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [-1] * 256
        self.shown: list[bytes] = []
        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        lowest, self.apart = 0.0, True
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            shown = b""
            if model.is_byte(i):
                shown = bytes([int(piece[1:-1], 16)])
                self.bytes[shown[0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                shown = piece.replace(BLANK, " ").encode()
                score = model.get_score(i)
                lowest = min(lowest, score)
                self.automaton.add_word(piece, (len(piece), score, i))
                if len(piece) == 1:
                    self.single.add(piece)
                if BLANK in piece.lstrip(BLANK):
                    self.apart = False
            self.shown.append(shown)
        if -1 in self.bytes:
            raise ValueError("the model has no byte pieces, so not every text can be encoded")
        self.byte_score = lowest - 10.0
        self.automaton.make_automaton()


class Codec:
    """Encodes and decodes texts; the words met lately are kept with their ids."""

    def __init__(self, path: str, keep: int = 1_000_000):
        self.pieces, self.keep = Pieces(path), keep
        self.words: dict[str, bytes] = {}

    def best(self, chunk: str) -> list[int]:
        """The ids of the highest sum of scores; ties to the longer last piece.

        The automaton reports, for each position in turn, the pieces that end
        there (its output links, the longest first), so every best score is
        final when it is used. A character that is no piece goes as its bytes.
        """
        p, n = self.pieces, len(chunk)
        score, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        bare = [i for i, c in enumerate(chunk) if c not in p.single]
        at = 0
        for end, (size, gain, piece) in p.automaton.iter(chunk):
            while at < len(bare) and bare[at] < end:
                self._as_bytes(chunk, bare[at], score, back)
                at += 1
            now = score[end + 1 - size] + gain
            if now > score[end + 1]:
                score[end + 1], back[end + 1] = now, (size, piece)
        for i in bare[at:]:
            self._as_bytes(chunk, i, score, back)
        out, at = [], n
        while at:
            size, piece = back[at]
            if piece < 0:
                out.extend(p.bytes[b] for b in reversed(chunk[at - 1].encode()))
            else:
                out.append(piece)
            at -= size
        return out[::-1]

    def _as_bytes(self, chunk: str, i: int, score: list, back: list) -> None:
        now = score[i] + self.pieces.byte_score * len(chunk[i].encode())
        if now > score[i + 1]:
            score[i + 1], back[i + 1] = now, (1, -1)

    def _known(self, chunk: str) -> bytes:
        if len(self.words) > self.keep:
            self.words.clear()
        ids = self.words[chunk] = np.array(self.best(chunk), "<u4").tobytes()
        return ids

    def _marked(self, text: str) -> bytes:
        """The ids of a text in which spaces are blanks."""
        if not self.pieces.apart:
            return np.array(self.best(text), "<u4").tobytes()
        words = self.words
        return b"".join([words.get(c) or self._known(c) for c in CHUNK.findall(text)])

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids. A space stands before the text; a literal blank goes as bytes."""
        if not text:
            return b""
        text = f" {text}"
        if BLANK not in text:
            return self._marked(text.replace(" ", BLANK))
        blank = np.array([self.pieces.bytes[b] for b in BLANK.encode()], "<u4").tobytes()
        return blank.join(self._marked(t.replace(" ", BLANK)) for t in text.split(BLANK))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.shown.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")[1:]


def codec_of(path: str) -> Codec:
    """One codec a Python worker, so words met in one task are known in the next."""
    return kept("sentencepieces", path, lambda: Codec(path))


def encode(docs: DataFrame, model_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds `out`, the ids (array of int) of each whole text; null for null, empty for empty.

    All rows and all other columns are kept; a column named `out` is replaced.
    """
    kept = [c for c in docs.columns if c != out]
    at = kept.index(text)

    def run(batches):
        codec = codec_of(model_path)
        for batch in batches:
            ids = [None if t is None else np.frombuffer(codec.encode(t), "<i4") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, out])

    from pyspark.sql import types as T

    src = docs.select(*kept)
    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds `out`, the text of each array of ids; the text that encode() was given, exactly. Null for null."""
    kept = [c for c in rows.columns if c != out]
    at = kept.index(ids)

    def run(batches):
        codec = codec_of(model_path)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array(x, "<u4").tobytes()) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    from pyspark.sql import types as T

    src = rows.select(*kept)
    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(out, T.StringType())]))


def round_trip(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_ids, ids_crc32 (little-endian unsigned 32-bit ids) and decoded_sha256 of the text read back from the ids.

    Null and empty texts have no ids, null ids and repeated rows are documents
    like any other, texts of any length are encoded whole, chunk by chunk, other
    columns are not read, an empty table gives an empty one.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        codec = codec_of(model_path)
        for batch in batches:
            n, crc, sha = [], [], []
            for t in batch.column(1).to_pylist():
                ids = codec.encode(t or "")
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                sha.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text)).mapInArrow(run, f"doc_id {id_type}, n_ids long, ids_crc32 long, decoded_sha256 string")
