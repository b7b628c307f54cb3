"""Toxicity, packing, search, vectors, SentencePiece, chat, sharding and the pipeline on small fixtures."""

import hashlib
import json
import math
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from keratoline.llm import chat, embed_dedup, packing, queries, sentencepieces, sharding, topk, toxicity

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, score string, ids int, shard string"
ODD = [None, "", " ", "  two  blanks ", "tab\t\tend ", "line\n\n next\n", "<|endoftext|> <s> ▁literal ▁▁", "naïve Ünïcödé 東京 🙂‍↔️", "\x00\x01 \x7f", "word " * 4000, "x" * 9000]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "s", 1, "q") for i, t in enumerate(texts)] + [(None, "no id", "s", 1, "q")], DOCS)


# --- packing

def test_packing_is_whole_and_within_bins(spark):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = Tokenizer.from_file(BPE)
    rng = random.Random(1)
    texts = ODD + ["a<|endoftext|>b", "x <|endoftext|> y", "<|endoftext|>", "end of<|endoftext|>  text <|endoftext|>"] + [" ".join(rng.choice(["alpha", "beta", "gamma,", "delta."]) for _ in range(rng.randint(1, 900))) for _ in range(150)]
    rows = packing.pack(docs(spark, texts), BPE, open_bins=16).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == {None, *range(len(texts))}
    for i, t in [*enumerate(texts), (None, "no id")]:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and all(r.length == 2048 for r in by_doc[i] if r.piece)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert [r.ids for r in packing.pack_ids(docs(spark, ["a<|endoftext|>b"]), BPE).where("doc_id = 0").collect()] == [[64, 50256, 65, 0]]
    ids = packing.pack_ids(docs(spark, ["a b"]), BPE).where("doc_id = 0").first()
    assert len(ids.ids) == ids.length and ids.ids[-1] == 0


def test_words_kept_are_bounded_and_change_nothing():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "of", f"w{rng.randrange(400)}", f"naïve{rng.randrange(50)},", "x.y!"]) for _ in range(60)) for _ in range(80)]
    few, many = packing.Encoder(BPE, keep=20), packing.Encoder(BPE)
    for t in texts:
        assert few(t) == many(t)
        assert len(few.words) <= 21


def test_what_is_kept_goes_when_another_operator_begins():
    from keratoline.llm import _kept

    made = []
    make = lambda: made.append(1) or object()
    one = _kept.kept("a", "x", make)
    assert _kept.kept("a", "x", make) is one and _kept.kept("a", "y", make) is not one and len(made) == 2
    _kept.only("a")
    assert _kept.kept("a", "x", make) is one
    _kept.only("b")
    assert _kept.kept("a", "x", make) is not one


def test_packing_takes_any_tokenizer_file(tmp_path):
    """Files with rules of their own give the ids that the library gives; the usual byte-level file alone is encoded by words."""
    from tokenizers import Tokenizer

    texts = ["Hello  World, it's 3 o'clock", "NAÏVE café\n\ta b ", "", " x", "a<|endoftext|>b c", "don't STOP 1234 !?"]
    files = {"given": BPE, "words": public_tokenizers.path("word_bpe_49k.json")}
    for name, change in (("prefix", {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}), ("lower", {"normalizer": {"type": "Lowercase"}}), ("cut", {"truncation": {"direction": "Right", "max_length": 2, "strategy": "LongestFirst", "stride": 0}})):
        files[name] = str(tmp_path / f"{name}.json")
        with open(files[name], "w") as f:
            json.dump(json.loads(Tokenizer.from_file(BPE).to_str()) | change, f)
    for name, path in files.items():
        encoder, plain = packing.Encoder(path), Tokenizer.from_file(path)
        plain.no_truncation()
        assert encoder.whole == (name not in ("given", "cut"))
        for text in texts * 2:
            assert np.frombuffer(encoder(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, (name, text)


def test_packing_takes_pieces_as_they_come():
    """Against best fit written plainly: over all open bins, least room that is enough, else close the fullest."""
    rng = random.Random(4)
    for limit in (1, 3, 50):
        bins, room, open_, n = packing.OpenBins(100, limit), {}, [], 0  # open_: room left in the open bins, equal ones being alike
        for _ in range(2000):
            length = rng.randint(1, 100)
            at, offset = bins.place(length)
            fits = [f for f in open_ if f >= length]
            if fits:
                assert room[at] == min(fits) and offset == 100 - room[at]
                open_.remove(room[at])
            else:
                if len(open_) == limit:
                    open_.remove(min(open_))
                assert at == n and offset == 0
                n, room[at] = n + 1, 100
            room[at] -= length
            if room[at]:
                open_.append(room[at])


def test_bins_close_the_fullest_first():
    bins = packing.OpenBins(10, 2)
    assert bins.place(6) == (0, 0) and bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)  # the best fit, which fills and closes it
    assert bins.place(9) == (2, 0) and bins.place(8) == (3, 0)  # bin 2 was the fullest
    assert bins.place(4) == (0, 6)


# --- toxicity

def test_toxicity_learns_and_swaps_move_no_score(spark):
    rng = random.Random(2)
    words = [f"neutral{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = [rng.choice(words) for _ in range(30)]
        if toxic:
            w.insert(3, rng.choice(["scum", "moron", "loweird", "loweist"]))
        if rng.random() < (0.5 if toxic else 0.15):
            w.append("muslim")
        rows.append((i, " ".join(w).capitalize() + "."))
        labels.append((i, 1, int(toxic)))
    labels += [(1, 1, None), (None, 1, 1), (99999, 1, 1)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, lab)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 5 == 0) for i in held) / len(held) > 0.95
    term = {t: model.weights.get(zlib.crc32(f"={t}".encode()), 0.0) for t in toxicity.IDENTITY[3]}
    plain = toxicity.fit(df, lab, counterfactual=0.0)
    free = {t: plain.weights.get(zlib.crc32(f"={t}".encode()), 0.0) for t in toxicity.IDENTITY[3]}
    assert max(term.values()) - min(term.values()) < 0.5 * (max(free.values()) - min(free.values()))


def plain_score(model, text):
    """The score by the definition of the features, without the scorer's kept words."""
    from string import punctuation

    edge = punctuation + "¿¡«»“”„’‘…–—"
    kin = {t for row in toxicity.IDENTITY for t in row}
    found = set()
    for raw in (text or "").lower().split():
        w = raw.strip(edge)
        if w:
            found.add(f"={w}")
            if w not in kin:
                found.update(f"^{w[:k]}" for k in (4, 5, 6) if len(w) >= k)
    numbers = {zlib.crc32(f.encode()) for f in found}
    return 1 / (1 + math.exp(-(model.bias + sum(model.weights.get(x, 0.0) for x in numbers))))


def test_toxicity_scores_and_fit_against_plain_python(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(240):
        toxic = i % 4 == 0
        w = [f"n{rng.randrange(60)}" for _ in range(12)] + ["muslim"] * (rng.random() < (0.8 if toxic else 0.1)) + ["scum"] * toxic
        rng.shuffle(w)
        rows.append((i, " ".join(w[:7]) + ". " + " ".join(w[7:])))
        labels.append((i, 1, int(toxic)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, lab)
    for r in toxicity.score(df, model).collect():
        assert r.score == pytest.approx(plain_score(model, r.text))
    used = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5]

    def loss(weights, bias):
        """Balanced logistic loss, the penalty on swaps in sentences, and the ridge, by plain loops."""
        share = sum(i % 4 == 0 for i in used) / len(used)
        total = 0.0
        for i in used:
            p = min(max(plain_score(toxicity.Model(weights, bias), rows[i][1]), 1e-9), 1 - 1e-9)
            total -= 0.5 / share * math.log(p) if i % 4 == 0 else 0.5 / (1 - share) * math.log(1 - p)
            for sentence in rows[i][1].split("."):
                terms = set(sentence.split())
                for group in toxicity.IDENTITY:
                    for a in terms & set(group):
                        for b in set(group) - {a}:
                            change = weights.get(zlib.crc32(f"={a}".encode()), 0.0) - (0.0 if b in terms else weights.get(zlib.crc32(f"={b}".encode()), 0.0))
                            total += 0.5 * change**2
        return (total + 0.0025 * sum(w * w for w in weights.values())) / len(used)

    here = loss(model.weights, model.bias)
    for f in model.weights:
        for step in (-0.2, 0.2):
            assert loss(model.weights | {f: model.weights[f] + step}, model.bias) > here - 1e-4
    assert toxicity.swaps("a gay man. gay lesbian!") == {k: n for k, n in toxicity.swaps("gay lesbian").items()} | toxicity.swaps("gay man") | {("gay", "lesbian"): 1} | {("gay", t): 2 for t in toxicity.IDENTITY[2][2:]} | {("gay", ""): 1}


def test_toxicity_edge_cases(spark):
    df = docs(spark, ODD)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.score(df, toxicity.fit(df, empty))
    assert out.columns == ["doc_id", "text", "ids", "shard", "score"] and out.count() == len(ODD) + 1
    assert all(0 <= r.score < 0.5 for r in out.collect())
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.5 for r in toxicity.score(df, toxicity.fit(df, one)).collect())
    assert toxicity.score(df.limit(0), toxicity.fit(df, empty)).collect() == []


def test_toxicity_query_uses_only_rows_it_may(spark, data):
    rows = queries.op1_toxicity(spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)


# --- search

def vectors(spark, seed=4, n=400, d=12):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).round(2).astype(np.float32)
    x[50:60] = x[40]
    x[60:90] = x[41] + 0.02 * rng.standard_normal((30, d)).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [float("nan")] * d, 1), (1002, [None] * d, 1), (1003, [0.0] * d, 1), (None, x[0].tolist(), 1), (1004, [], 1), (1100, [1.0, float("inf")], 1), (300, x[7].tolist(), 2)]
    rows += [rows[5]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_BLOCK", 20)
    monkeypatch.setattr(topk, "DATA_BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    df, rows = vectors(spark)
    good = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v, _ in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    # an id that stands twice with different vectors asks with the smaller one
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    asked = {i: min(w for j, w in [(j, w) for j, w, _ in rows] if j == i) for i, _ in good if i % 100 == 0}
    assert set(got) == set(asked)
    for i, raw in asked.items():
        v = [math.floor(1024 * float(np.float32(c))) for c in raw]
        every = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in good if j != i)[:10]
        assert sorted(got[i]) == [(n + 1, -s, j) for n, (s, j) in enumerate(every)]


def test_top_k_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    heads = 50 * rng.standard_normal((12, 8))
    x = np.floor(np.concatenate([h + rng.standard_normal((80, 8)) for h in heads]) * 64)
    cells = topk.Cells(topk.net(x[rng.permutation(len(x))[:300]], 12))
    cell, far = cells.place(x)
    radius = np.array([far[cell == c].max(initial=0) for c in range(len(cells.centres))])
    q = x[::97]
    bound = cells.bounds(q, radius)
    inner = q @ x.T
    for c in range(len(radius)):
        assert (inner[:, cell == c] <= bound[:, [c]]).all()
    floor = np.sort(inner, 1)[:, -11]
    assert (bound >= floor[:, None]).sum(1).mean() < 4


def test_top_k_scores_are_exact_whole_numbers(spark):
    """Scores that no double tells apart, in each range of sizes, and an error for what 64 bits can't hold."""
    for big in (2**12, 2**20 + 1, 2**30):  # components of 2**22, 2**30 and 2**40
        rows = [(0, [float(big), 1 / 1024, float(big)])] + [(i, [float(big), float(i) / 1024, -float(big) if i % 2 else 1.0]) for i in range(1, 40)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        want = sorted((-sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(rows[0][1], v, strict=True)), i) for i, v in rows[1:])
        if -want[0][0] < 2**63 - 1:
            got = topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()
            assert [(-r.score, r.vec_id) for r in got] == want[:10]
        else:
            with pytest.raises(Exception, match="beyond 64 bits"):
                topk.top_k(df, F.col("vec_id") == 0).collect()
    with pytest.raises(OverflowError, match="beyond 62 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e300])], "vec_id long, embedding array<double>"), F.lit(True))
    rng = np.random.default_rng(4)
    for size in (2**12, 2**28, 2**40):
        q, x = (np.floor(rng.uniform(-size, size, (5, 6))) for _ in range(2))
        x[0] = 0 * x[0]
        x[0, 0] = 7
        if size == 2**40:  # terms beyond 64 bits whose sums are not
            q[:, 1], x[:, 1], q[:, 2:], x[:, 2:] = -q[:, 0], x[:, 0] - 1, 0, 0
        got = topk.products(q, x, 6.0 * size * size)
        assert got.dtype == np.int64 and got.tolist() == [[sum(int(a) * int(b) for a, b in zip(v, w, strict=True)) for w in x] for v in q]


def test_top_k_goes_only_where_groups_reach():
    """Of queries that are searched together none misses a cell that its own bound reaches, and most cells are met by few."""
    rng = np.random.default_rng(3)
    heads = 40 * rng.standard_normal((20, 6))
    x = np.floor(np.concatenate([h + rng.standard_normal((60, 6)) for h in heads]) * 64)
    cells = topk.Cells(topk.net(x[rng.permutation(len(x))[:400]], 20))
    cell, far = cells.place(x)
    radius = np.array([far[cell == c].max(initial=-np.inf) for c in range(len(cells.centres))])
    q = x[rng.permutation(len(x))[:500]]
    floor = np.sort((q @ x.T).astype(np.int64), 1)[:, -11]
    seen, rows = {}, 0
    for leaf, at, reach in cells.reached(q, floor, radius):
        rows += int(reach.any(0).sum())
        for i, r in zip(leaf, reach, strict=True):
            assert i not in seen
            seen[i] = set(at[r])
    want = cells.bounds(q, radius) >= floor[:, None]
    assert len(seen) == len(q) and all(seen[i] == set(np.flatnonzero(want[i])) for i in seen)
    assert rows < want.sum() / 5


def test_top_k_with_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 1024 * 2048), (0, 2, 2, 1024 * 2048)]
    assert topk.top_k(df.limit(0), F.lit(True)).collect() == []


def test_vector_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CHUNK", 16)
    monkeypatch.setattr(embed_dedup, "CELL_ROWS", 40)
    df, rows = vectors(spark)
    good = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    unit = np.stack([v / np.linalg.norm(v) for _, v in good])
    near = unit @ unit.T >= 0.9
    ids = np.array([i for i, _ in good])
    near &= ids[:, None] != ids
    links = {i: sorted(near[ids == i].sum(1).tolist()) for i in ids}  # of an id that repeats, each row has its own
    told, got = {}, {}
    for r in embed_dedup.near_duplicates(df).collect():
        if r.vec_id is not None:
            got[r.vec_id] = r
            told.setdefault(r.vec_id, []).append(r.n_links)
    found, all_ = sum(sum(told[i]) for i in links), sum(map(sum, links.values()))
    assert found >= 0.95 * all_ and all(sum(told[i]) <= sum(links[i]) for i in links)
    assert all(got[i].n_links == 0 and got[i].kept for i in (1000, 1001, 1002, 1003, 1004, 1100))
    assert {got[i].component_id for i in range(60, 90)} == {41} and not got[60].kept and got[40].kept
    assert embed_dedup.near_duplicates(df.limit(0)).collect() == []


# --- SentencePiece

def best_score(pieces, text):
    """Highest sum of scores by plain dynamic programming over all substrings."""
    score = {text[i : i + n]: None for i in range(len(text)) for n in range(1, 17)}
    for end, (size, gain, _) in pieces.automaton.iter(text):
        score[text[end + 1 - size : end + 1]] = gain
    best = [0.0] + [-math.inf] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - 16), e):
            if score.get(text[s:e]) is not None:
                best[e] = max(best[e], best[s] + score[text[s:e]])
        if text[e - 1] not in pieces.single:
            best[e] = max(best[e], best[e - 1] + pieces.byte_score * len(text[e - 1].encode()))
    return best[-1]


def test_pieces_round_trip_and_score_best(spark):
    codec = sentencepieces.Codec(PIECES)
    gain = {i: g for _, (_, g, i) in ((w, codec.pieces.automaton.get(w)) for w in codec.pieces.automaton)}
    for text in [t for t in ODD if t and "▁" not in t and len(t) < 200] + ["the quick brown fox", "internationalisation  of words"]:
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        got = sum(gain.get(i, codec.pieces.byte_score) for i in ids)
        assert got == pytest.approx(best_score(codec.pieces, f" {text}".replace(" ", "▁")))
    df = docs(spark, ODD)
    back = sentencepieces.decode(sentencepieces.encode(df, PIECES), PIECES, out="shard")
    for r in back.collect():
        assert r.shard == r.text
    for r in sentencepieces.round_trip(df, PIECES).collect():
        text = ("no id" if r.doc_id is None else ODD[r.doc_id]) or ""
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and (r.n_ids == 0) == (text == "")
    assert sentencepieces.encode(df.limit(0), PIECES).collect() == []


# --- chat

def test_chat_reads_back(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "\\s \\p <\\| <|", "", None, "a\nb\\n", "ends with <"]
    rows = []
    for c in range(6):
        for t in range(c + 1):
            rows.append((c, t, ["system", "user", "assistant", "assistant", "we\nird<|\\", None][(c + t) % 6], odd[(c * t) % 6], "x"))
    rows += [(7, 0, "assistant", "same", "x")] * 2 + [(None, 0, "user", "lost", "x"), (8, None, "assistant", "early", "x"), (8, 3, "user", "late", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    examples = chat.expand(df)
    got = {r.conv_id: r for r in chat.digest(examples).collect()}
    convs = {}
    for c, t, role, text, _ in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role is not None, role or "", text is not None, text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns = [(x[3], x[5]) for x in sorted(turns)]
        told = "".join(f"{r}\n{x}\n" for r, x in turns)
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    spans: dict = {}
    for r in examples.collect():
        span = r.formatted[r.loss_start : r.loss_start + r.loss_length]
        spans.setdefault(r.conv_id, []).append(span.replace("<\\p", "<|").replace("\\s", "\\"))
    for c, turns in convs.items():
        # What follows the last reply is an example that trains nothing.
        assert sorted(filter(None, spans[c])) == sorted(x[5] for x in turns if x[3] == "assistant" and x[5])
    sizes = examples.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()
    assert {r.conv_id: r.n for r in sizes} == {c: r.formatted_chars for c, r in got.items()}
    assert chat.digest(chat.expand(df.limit(0))).collect() == []


# --- sharding

@pytest.mark.parametrize("hot", [1, 30, 4000])
def test_shards_are_even_and_keep_copies_together(spark, hot):
    rng = random.Random(hot)
    texts = [None, None, "", "é" * 50] + ["".join(rng.choice("abc d") for _ in range(rng.randint(1, 300))) for _ in range(1200)] + ["copy of one text " * 3] * hot
    df = docs(spark, texts)
    rows = sharding.shard(df).collect()
    assert len(rows) == len(texts) + 1
    by_id = {r.doc_id: r for r in rows}
    total = 0
    for i, t in enumerate(texts):
        data = (t or "").encode()
        assert (by_id[i].size, by_id[i].text_crc32, by_id[i].law, by_id[i].grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        total += len(data) + 1
    sizes, slots = [0] * 8, {}
    for r in rows:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes) - min(sizes) <= 0.05 * total / 8
    if hot <= 30:
        homes = {}
        for i, t in enumerate(texts):
            homes.setdefault(t, set()).add(by_id[i].shard)
        assert all(len(h) == 1 for h in homes.values())


def test_sharding_few_rows(spark):
    assert sharding.shard(docs(spark, []).limit(0)).collect() == []
    for texts in (["a"], ["a", "a", None], [None], ["", "b", "é"]):
        rows = sharding.shard(docs(spark, texts)).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in rows) == sorted([(False, i, len((t or "").encode()) + 1) for i, t in enumerate(texts)] + [(True, 0, 6)])
        slots = {}
        for r in rows:
            assert 0 <= r.shard < 8 and r.grown_shard is None
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


# --- pipeline

def test_pipeline_stages(spark, data):
    import corpus_pipeline as P

    every = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]
    kept = P.toxicity_stage(spark, every, data)
    assert kept.columns == every.columns and 0 < kept.count() <= every.count()
    near = P.ngram_jaccard_stage(spark, every, data)
    assert near.columns == every.columns
    groups = {r.doc_id: r.component_id for r in queries.op2_ngram_jaccard_join(spark, data).collect()}
    assert sorted(r.doc_id for r in near.select("doc_id").collect()) == sorted(set(groups.values()))
    cut = P.suffix_array_stage(spark, every, data)
    assert cut.columns == every.columns and cut.dtypes == every.dtypes
    removed = {r.doc_id: r.n_bytes - r.n_removed for r in queries.op9_suffix_dedup(spark, data).collect()}
    for r in cut.collect():
        assert removed[r.doc_id] - 8 <= len(r.text.encode()) <= removed[r.doc_id] and r.n_chars == len(r.text)


def test_pipeline_is_its_stages_by_brute_force(spark, data):
    """Of all documents: the scores as they are, then near duplicates by all pairs, repeats by all windows, ids by the tokenizer."""
    import itertools
    import re
    import zlib

    import corpus_pipeline as P
    import public_tokenizers
    from tokenizers import Tokenizer

    table = lambda n: spark.read.parquet(f"{data}/{n}.parquet")
    model = toxicity.fit(table("documents"), table("labels"))
    texts = {r.doc_id: r.text or "" for r in toxicity.score(table("documents").select("doc_id", "text"), model).where("score < 0.5").collect()}
    sets = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    low = {i: i for i in texts}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            low[y] = x
    left = {i: t.encode() for i, t in texts.items() if root(i) == i}
    seen = {}
    for t in left.values():
        for j in range(len(t) - 199):
            seen[t[j : j + 200]] = seen.get(t[j : j + 200], 0) + 1
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in left.items():
        keep = bytearray(b"\1") * len(t)
        for j in range(len(t) - 199):
            if seen[t[j : j + 200]] > 1:
                keep[j : j + 200] = bytes(200)
        cut = bytes(c for c, k in zip(t, keep, strict=True) if k).decode("utf-8", "ignore") if all(keep) or not any(keep) else None
        if cut is None:  # a character of which a byte goes goes as a whole
            at, out = 0, []
            for c in t.decode():
                n = len(c.encode())
                if all(keep[at : at + n]):
                    out.append(c)
                at += n
            cut = "".join(out)
        want[i] = [*tokenizer.encode(cut, add_special_tokens=False).ids, 0]
    pieces = P.run(spark, data).collect()
    got, bins = {}, {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.piece)):
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32 and r.start == got.get(r.doc_id, 0)
        got[r.doc_id] = r.start + r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == {i: len(ids) for i, ids in want.items()} and len(got) < len(texts)
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == [0, *itertools.accumulate(n for _, n in sorted(parts))][:-1] and sum(n for _, n in parts) <= 2048


def test_pipeline_stages_of_odd_documents(spark, data):
    import corpus_pipeline as P

    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, row int, v int, u int, id string"
    passage = " ".join(f"p{i}" for i in range(80))
    near = " ".join(f"n{i}" for i in range(60))
    tail, head = " ".join(f"t{i}" for i in range(40)), " ".join(f"h{i}" for i in range(40))
    texts = [None, "", " ", "word " * 9000, near, near + " end", f"{passage} {tail}", f"{head} {passage}"]
    rows = [(i, t, "en", "s", None if t is None else len(t), "kept", 7, 8, 9, "ten") for i, t in enumerate(texts)]
    rows += [rows[5], (5, "a text of its own under a repeated id", "en", "s", 37, "kept", 7, 8, 9, "ten"), (None, near, "en", "s", len(near), "kept", 7, 8, 9, "ten"), rows[1]]
    df = spark.createDataFrame(rows, schema)
    order = lambda rs: sorted(map(tuple, rs), key=lambda r: tuple((x is None, x) for x in r))
    assert order(P.toxicity_stage(spark, df, data).collect()) == order(rows)
    kept = P.ngram_jaccard_stage(spark, df, data)
    assert kept.dtypes == df.dtypes and order(kept.collect()) == order(rows[:5] + rows[6:8] + rows[9:])
    cut = P.suffix_array_stage(spark, df, data)
    assert cut.dtypes == df.dtypes and cut.count() == len(rows)
    by_id = {}
    for r in cut.collect():
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[0][0].text is None and by_id[0][0].n_chars is None and by_id[1][0].text == ""
    assert by_id[6][0].text == f" {tail}" and by_id[7][0].text == f"{head} " and by_id[6][0].score == "kept"
    assert sorted(r.text for r in by_id[5])[-1] == "a text of its own under a repeated id"
    assert P.packing_stage(spark, df, data).select("doc_id").distinct().count() == 9
    for _, stage in P.STAGES:
        assert stage(spark, df.limit(0), data).collect() == []


def test_multi_sequence_rank_and_order():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 10))
    x /= np.linalg.norm(x, axis=1)[:, None]
    words = embed_dedup.codebook(x[:, :5], 7), embed_dedup.codebook(x[:, 5:], 7)
    every = embed_dedup.Index(*words, 49, np.inf)
    d1, d2 = every.halves(x)
    home, seen = every.cells(x)
    total = (d1[:, :, None] + d2[:, None]).reshape(len(x), -1)
    for i in range(len(x)):
        assert (np.diff(total[i, seen[i]]) >= -1e-12).all() and sorted(seen[i]) == list(range(49)) and seen[i, 0] == home[i]
    cell = rng.integers(0, 49, len(x))
    assert every.rank(x, cell).tolist() == [int((seen[i] == cell[i]).argmax()) for i in range(len(x))]
    few = embed_dedup.Index(*words, 6, np.inf).cells(x)[1]
    assert (few == seen[:, :6]).all()


def test_vector_recall_on_links_near_the_threshold(spark, monkeypatch):
    """Groups whose members are some 0.9 to 0.95 alike, lone pairs at 0.9, and one vector that a third of all rows have."""
    monkeypatch.setattr(embed_dedup, "CELL_ROWS", 30)
    monkeypatch.setattr(embed_dedup, "BLOCK_ROWS", 120)
    monkeypatch.setattr(embed_dedup, "CHUNK", 64)
    rng = np.random.default_rng(6)
    d = 32
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    heads = unit(rng.standard_normal((30, d)))
    groups = unit(np.repeat(heads, 20, 0) + 0.05 * rng.standard_normal((600, d)))
    one = unit(rng.standard_normal((300, d)))
    turn = rng.standard_normal((300, d))
    turn = unit(turn - (turn * one).sum(1)[:, None] * one)
    pairs = np.concatenate([one, 0.902 * one + math.sqrt(1 - 0.902**2) * turn])
    x = np.concatenate([groups, pairs, np.repeat(one[:1], 500, 0)]).astype(np.float32)
    ids = rng.permutation(len(x)) * 3
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")).collect()}
    y = unit(x.astype(np.float64))
    near = y @ y.T >= 0.9
    np.fill_diagonal(near, False)
    links = near.sum(1)
    found = np.array([got[int(i)].n_links for i in ids])
    assert len(got) == len(x) and (found <= links).all() and found.sum() >= 0.99 * links.sum()
    lone = slice(601, 900)
    assert found[lone].sum() >= 0.95 * links[lone].sum()
    hot = [int(i) for i in ids[-500:]]
    assert len({got[i].component_id for i in hot}) == 1 and min(got[i].n_links for i in hot) >= 500
