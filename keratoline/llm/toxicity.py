"""Toxicity by a counterfactual-regularised linear classifier.

Features are the words of a document and the stems of their spellings. The
logistic loss on labelled documents is joined by a penalty on the change of the
score when an identity term in a sentence of theirs is swapped for another of
its kind, so that a mention of a group by itself moves no score.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keratoline.llm._kept import only

# Identity terms, those of one row being swapped for each other.
IDENTITY = (
    ("person", "woman", "man", "girl", "boy", "female", "male", "transgender", "nonbinary"),
    ("people", "women", "men", "girls", "boys", "females", "males", "kids", "seniors", "immigrants", "refugees"),
    ("gay", "lesbian", "bisexual", "queer", "straight", "heterosexual", "homosexual"),
    ("muslim", "jewish", "christian", "hindu", "buddhist", "sikh", "catholic", "atheist"),
    ("muslims", "jews", "christians", "hindus", "buddhists", "sikhs", "catholics", "atheists"),
    ("black", "white", "asian", "african", "latino", "hispanic", "arab", "indigenous", "european", "american"),
    ("deaf", "blind", "disabled", "autistic", "elderly", "young"),
    ("frau", "mann", "frauen", "männer", "muslime", "juden", "christen", "ausländer", "schwarze", "weiße"),
    ("femme", "homme", "femmes", "hommes", "musulmans", "juifs", "chrétiens", "étrangers", "noirs", "blancs"),
    ("mujer", "hombre", "mujeres", "hombres", "musulmanes", "judíos", "cristianos", "extranjeros", "negros", "blancos"),
)
STEMS = (4, 5, 6)
SENTENCE = re.compile(r"[.!?\n]+")
_EDGE = string.punctuation + "¿¡«»“”„’‘…–—"
_KIN = {word: row for row in IDENTITY for word in row}


def word_features(raw: str) -> tuple[int, ...]:
    """Feature numbers of one lower-cased word as it stands between white space."""
    word = raw.strip(_EDGE)
    if not word:
        return ()
    if word in _KIN:
        return (zlib.crc32(f"={word}".encode()),)
    return (zlib.crc32(f"={word}".encode()), *(zlib.crc32(f"^{word[:k]}".encode()) for k in STEMS if len(word) >= k))


def held_out(doc_id: str) -> F.Column:
    """A fifth of all documents, by id; not those without one, which no label can name."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


class Model:
    """weights: feature number -> weight. Bounded by max_features, so it is small enough to send with a task."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias


def swaps(text: str) -> Counter:
    """(term, the one put in its place) over all identity terms in all sentences of a lower-cased text; "" where the sentence has the other already."""
    found: Counter = Counter()
    for sentence in SENTENCE.split(text):
        terms = {t for w in sentence.split() if (t := w.strip(_EDGE)) in _KIN}
        found.update((t, "" if other in terms else other) for t in terms for other in _KIN[t] if other != t)
    return found


def _gathered(rows: DataFrame, most: int) -> list:
    """(toxic, distinct features, swaps and how often) of each document of (id, text, toxic); the first `most` by a hash of the id."""

    def run(batches):
        only("toxicity")
        for batch in batches:
            features, pairs = [], []
            for text in batch.column(1).to_pylist():
                text = (text or "").lower()
                features.append(np.array(sorted({f for w in set(text.split()) for f in word_features(w)}), "<u4").tobytes())
                pairs.append([{"a": a, "b": b, "n": n} for (a, b), n in sorted(swaps(text).items())])
            pair = pa.struct([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(features, pa.binary()), pa.array(pairs, pa.list_(pair))], names=["id", "toxic", "features", "swaps"])

    given = rows.select(F.col("id").cast("string").alias("id"), "text", F.col("toxic").cast("int"))
    found = given.mapInArrow(run, "id string, toxic int, features binary, swaps array<struct<a: string, b: string, n: long>>")
    return found.orderBy(F.xxhash64("id"), "id", "toxic", "features").limit(most).collect()


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_rows: int = 8000, max_features: int = 20_000, l2: float = 0.005, counterfactual: float = 1.0, steps: int = 600) -> Model:
    """Learns from labelled documents that are not held out.

    At most max_rows labelled rows are used (the smallest by a hash of their id
    that the label does not enter), and of the documents they name at most
    max_rows too, so what reaches the driver is bounded where ids repeat; labels
    that are null or other than 0 and 1, and null ids, are not used; a document
    labelled twice counts twice; labels without a document are skipped. Null
    texts are empty, long ones are read whole. With no usable label, as in an
    empty table, the model says 0 to everything, with labels of one kind it says
    that kind.

    The penalty is the square of the change of score, over all swaps of an
    identity term in a sentence by each other term of its kind; where the
    sentence has the other term already, the swap only takes one away.
    """
    chosen = (
        labels.select(F.col(doc_id).alias("label_id"), "toxic")
        .where(F.col("label_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("label_id"))
        .orderBy(F.xxhash64("label_id", F.lit(7)), "label_id", "toxic").limit(max_rows)
    )
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
    got = _gathered(rows, max_rows)
    if not got:
        return Model({}, -4.0)
    y = np.array([r["toxic"] for r in got], np.float64)
    if y.min() == y.max():
        return Model({}, 4.0 if y[0] else -4.0)
    sets = [np.frombuffer(r["features"], "<u4") for r in got]
    column = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    names, column = np.unique(column, return_inverse=True)
    n1 = np.bincount(column, weights=y[row], minlength=len(names))
    n = np.bincount(column, minlength=len(names))
    p = y.mean()
    z = (n1 - n * p) / np.sqrt(n * p * (1 - p))  # how far a feature's toxic count is from what chance gives
    z[n < 3] = 0
    kept = np.argsort(-np.abs(z), kind="stable")[:max_features]
    kept = kept[np.abs(z[kept]) > 4]
    index = np.full(len(names), -1)
    index[kept] = np.arange(len(kept))
    inside = index[column] >= 0
    row, column = row[inside], index[column[inside]]
    place = {int(names[k]): i for i, k in enumerate(kept)}

    index_of = lambda term: place.get(zlib.crc32(f"={term}".encode()), -1) if term else -1
    seen: Counter = Counter()
    for r in got:
        for x in r["swaps"]:
            a, b = index_of(x["a"]), index_of(x["b"])
            if a != b:
                seen[a, b] += x["n"]
    pairs = np.array(list(seen), np.int64).reshape(-1, 2)
    often = np.array(list(seen.values()), np.float64) / max(1, len(got))

    m = len(kept)
    w, mean, square = np.zeros(m + 2), np.zeros(m + 2), np.zeros(m + 2)  # the last two: bias, and the term that is no feature
    balance = np.where(y == 1, 0.5 / p, 0.5 / (1 - p))
    for step in range(1, steps + 1):
        score = np.bincount(row, weights=w[column], minlength=len(y)) + w[m]
        miss = balance * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) / len(y)
        grad = np.zeros(m + 2)
        grad[:m] = np.bincount(column, weights=miss[row], minlength=m) + l2 / len(y) * w[:m]
        grad[m] = miss.sum()
        if len(pairs):
            change = counterfactual * often * (w[pairs[:, 0]] - w[pairs[:, 1]])
            np.add.at(grad, pairs[:, 0], change)
            np.add.at(grad, pairs[:, 1], -change)
        grad[m + 1] = 0
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        w -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        w[m + 1] = 0
    return Model({f: float(w[i]) for f, i in place.items()}, float(w[m]))


class Scorer:
    """Scores texts, with the features of the words met lately kept."""

    def __init__(self, model: Model, keep: int = 300_000):
        self.weights, self.bias, self.keep = model.weights, model.bias, keep
        self.words: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> float:
        words, found = self.words, set()
        if len(words) > self.keep:
            words.clear()
        for w in set((text or "").lower().split()):
            own = words.get(w)
            if own is None:
                own = words[w] = tuple(f for f in word_features(w) if f in self.weights)
            if own:
                found.update(own)
        return self.bias + sum(self.weights[f] for f in sorted(found))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the column `out`, a double from 0 to 1, from the whole text.

    A null text scores as an empty one. Texts of any length are read whole,
    repeated rows score alike, an empty table gives an empty one. An existing
    column of that name is replaced; all others, and all rows, are kept.
    """
    kept = [c for c in docs.columns if c != out]
    at = kept.index(text)

    def run(batches):
        only("toxicity")
        scorer = Scorer(model)
        for batch in batches:
            logit = np.array([scorer(t) for t in batch.column(at).to_pylist()], np.float64)
            value = 1 / (1 + np.exp(-np.clip(logit, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names=[*batch.schema.names, out])

    from pyspark.sql import types as T

    src = docs.select(*kept)
    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(out, T.DoubleType())]))
