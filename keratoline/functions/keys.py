"""Visit keys: 16 hexadecimal digits of a hash of patient, eye and epoch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "|"


def key_text(patient: Column, eye: Column, epoch: Column) -> Column:
    """A missing patient is empty, a missing eye is OD."""
    return F.concat_ws(SEPARATOR, F.coalesce(patient, F.lit("")), F.coalesce(eye, F.lit("OD")), epoch.cast("string"))


def visit_id(patient: Column, eye: Column, epoch: Column, salt: str = "") -> Column:
    """By SHA-256, optionally salted, so ids can't be guessed from names."""
    text = key_text(patient, eye, epoch)
    return F.substring(F.sha2(F.concat(F.lit(salt), text) if salt else text, 256), 1, 16)


def visit_id_blake3(patient: Column, eye: Column, epoch: Column) -> Column:
    """By BLAKE3, for keys equal to those of earlier exports. Spark has no such function, so it runs in Arrow batches."""

    def hashed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else blake3_hex(t.encode())[:16])

    return F.pandas_udf(hashed, T.StringType())(key_text(patient, eye, epoch))


# Fixed values of the BLAKE3 specification: initial words, message permutation, flags.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8
_MASK = 0xFFFFFFFF


def _compress(chain: tuple[int, ...], words: list[int], counter: int, size: int, flags: int) -> list[int]:
    v = [*chain, *_IV[:4], counter & _MASK, counter >> 32, size, flags]

    def quarter(a: int, b: int, c: int, d: int, x: int, y: int) -> None:
        for m, left, right in ((x, 16, 12), (y, 8, 7)):
            v[a] = (v[a] + v[b] + m) & _MASK
            t = v[d] ^ v[a]
            v[d] = (t >> left | t << 32 - left) & _MASK
            v[c] = (v[c] + v[d]) & _MASK
            t = v[b] ^ v[c]
            v[b] = (t >> right | t << 32 - right) & _MASK

    for step in range(7):
        for i in range(4):
            quarter(i, 4 + i, 8 + i, 12 + i, words[2 * i], words[2 * i + 1])
        for i in range(4):
            quarter(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, words[8 + 2 * i], words[9 + 2 * i])
        if step < 6:
            words = [words[i] for i in _ORDER]
    return [v[i] ^ v[i + 8] for i in range(8)]


def _chunk(data: bytes, counter: int, root: int) -> list[int]:
    chain: list[int] = list(_IV)
    blocks = [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
    for i, block in enumerate(blocks):
        words = [int.from_bytes(block.ljust(64, b"\0")[j : j + 4], "little") for j in range(0, 64, 4)]
        flags = (_CHUNK_START if i == 0 else 0) | ((_CHUNK_END | root) if i == len(blocks) - 1 else 0)
        chain = _compress(tuple(chain), words, counter, len(block), flags)
    return chain


def blake3_hex(data: bytes) -> str:
    """The 64 hexadecimal digits of BLAKE3 in its plain mode."""

    def tree(first: int, part: bytes, root: int) -> list[int]:
        if len(part) <= 1024:
            return _chunk(part, first, root)
        left = 1024
        while left * 2 < len(part):
            left *= 2
        words = tree(first, part[:left], 0) + tree(first + left // 1024, part[left:], 0)
        return _compress(_IV, words, 0, 64, _PARENT | root)

    return b"".join(w.to_bytes(4, "little") for w in tree(0, data, _ROOT)).hex()
