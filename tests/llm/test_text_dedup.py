"""Substring and suffix dedup, the n-gram join: against brute force on texts with copies, ties, nulls and clashing names."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from keratoline.llm import _hashing as H
from keratoline.llm import ngram_join, substring, suffix

SCHEMA = "doc_id long, text string, u int, n_removed string, v long, kept boolean"


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" if i % 7 else f"é{i}ü" for i in range(60)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [some(40), some(90), some(12)]
    texts = [None, "", " \t\n", "short", "a" * 700, "a" * 150, shared[1]]
    for i in range(60):
        parts = [some(rng.randint(0, 60)) for _ in range(3)]
        if i % 2:
            parts.insert(rng.randint(0, 3), shared[i % 3])
        texts.append((" " if i % 3 else "\n").join(parts))
    texts += texts[10:14] + ["\x0b".join(t.split(" ")) for t in texts[14:15]]
    near = texts[20].split()
    for i in range(8):
        copy = list(near)
        copy[i * 3] = f"new{i}"
        texts.append(" ".join(copy))
    texts.append(some(6000))
    rows = [(i, t, 1, "x", 5, True) for i, t in enumerate(texts)]
    return rows + [rows[30], (None, texts[30], 2, "y", 6, False)]


def brute_bytes(rows, k):
    count = Counter()
    for r in rows:
        b = (r[1] or "").encode()
        count.update(b[i : i + k] for i in range(len(b) - k + 1))
    out = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - k + 1):
            if count[b[i : i + k]] > 1:
                gone[i : i + k] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((r[0], len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, k):
    first = {}
    for r in rows:
        w = (r[1] or "").encode().split()
        if r[0] is not None:
            for i in range(len(w) - k + 1):
                t = tuple(w[i : i + k])
                first[t] = min(first.get(t, r[0]), r[0])
    out = []
    for r in rows:
        w = (r[1] or "").encode().split()
        gone = np.zeros(len(w), bool)
        if r[0] is not None:
            for i in range(len(w) - k + 1):
                if first[tuple(w[i : i + k])] < r[0]:
                    gone[i : i + k] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((r[0], len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("length", [200, 60])
@pytest.mark.parametrize("unit_bytes", [1 << 22, 2000])
def test_suffix_matches_brute_force(spark, length, unit_bytes):
    rows = corpus()
    got = [tuple(r) for r in suffix.remove_repeats(spark.createDataFrame(rows, SCHEMA), length=length, unit_bytes=unit_bytes, digest=True).collect()]
    assert sorted(got, key=key) == sorted(brute_bytes(rows, length), key=key)


def test_suffix_keeps_columns_and_whole_characters(spark):
    text = "é" * 300 + "x"
    rows = [(1, text, 9, "a", 2, True), (2, "y" + text[1:], 8, "b", 3, False), (3, None, 7, "c", 4, True), (4, "alone " * 2, 6, "d", 5, True)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in suffix.remove_repeats(df).collect()}
    assert suffix.remove_repeats(df).columns == df.columns
    assert got[3].text is None and got[4].text == rows[3][1] and got[4].n_removed == "d" and got[2].u == 8
    assert "�" not in got[1].text and len(got[1].text) < 10


@pytest.mark.parametrize("unit_bytes", [1 << 22, 2000])
def test_substring_matches_brute_force(spark, unit_bytes):
    rows = corpus()
    for window in (50, 9):
        got = [tuple(r) for r in substring.drop_seen_passages(spark.createDataFrame(rows, SCHEMA), window=window, unit_bytes=unit_bytes, digest=True).collect()]
        assert sorted(got, key=key) == sorted(brute_words(rows, window), key=key)


def test_substring_returns_text(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(2, f"head {passage} tail", 1, "", 1, True), (1, passage, 1, "", 1, True)]
    got = {r.doc_id: r.kept_text for r in substring.drop_seen_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: passage, 2: "head tail"}


def brute_near(rows, n=5, at=0.8):
    sets = {}
    for j, r in enumerate(rows):
        w = (r[1] or "").encode().split()
        sets[j] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    live = [j for j, r in enumerate(rows) if sets[j] and r[0] is not None]
    root = {j: j for j in live}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a in live:
        for b in live:
            if a < b and len(sets[a] & sets[b]) >= at * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for j in live:
        groups[find(j)].append(rows[j][0])
    out = []
    for j, r in enumerate(rows):
        same = min((rows[x][0] for x in live if sets[x] == sets[j]), default=r[0]) if j in root else r[0]
        low = min(groups[find(j)]) if j in root else r[0]
        out.append((r[0], same, links[j], low, r[0] is None or low == r[0]))
    return out


def test_join_matches_brute_force(spark, monkeypatch):
    rows = corpus()
    want = sorted(brute_near(rows), key=key)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in ngram_join.near_duplicates(df).collect()), key=key) == want
    monkeypatch.setattr(ngram_join, "BUCKET", 3)
    monkeypatch.setattr(ngram_join, "TILE", 2)
    assert sorted((tuple(r) for r in ngram_join.near_duplicates(df).collect()), key=key) == want


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    for out in (suffix.remove_repeats(df), suffix.remove_repeats(df, digest=True), substring.drop_seen_passages(df), ngram_join.near_duplicates(df)):
        assert out.collect() == []


def test_fingerprints_and_packing():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 256, 3000).astype(np.uint8)
    rolled = H.rolling(values, 7)
    by_content = {}
    for i, h in enumerate(rolled.tolist()):
        assert by_content.setdefault(h, values[i : i + 7].tobytes()) == values[i : i + 7].tobytes()
    old, H.SLICE = H.SLICE, 64
    H._tables.clear()
    assert (H.rolling(values, 7) == rolled).all()
    H.SLICE = old
    H._tables.clear()
    for x in ([0], [5, 3, 1 << 40], [(1 << 64) - 1, 0]):
        assert H.unpack(H.pack(np.array(x, np.uint64))).tolist() == x
    data, starts = H.doc_bytes(pa.chunked_array([["ab", None], ["", "é"]]))
    assert data.tobytes() == "abé".encode() and starts.tolist() == [0, 2, 2, 2, 4]
    _, at = H.words(pa.array(["a b", None, " ", "c\vd  e"]))
    assert at.tolist() == [0, 2, 2, 2, 5]


def near_copies(rng, groups, size, length, changes, prefix):
    """Texts of groups of near copies: `length` words of which up to `changes` are replaced."""
    texts = []
    for g in range(groups):
        base = [f"{prefix}{g}_{i}" for i in range(length)]
        for c in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, changes)):
                copy[rng.randrange(length)] = f"x{g}_{c}_{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    return texts


def linked_ids(rows):
    return {r[0]: (r[2], r[3]) for r in brute_near(rows)}


@pytest.mark.parametrize("limits", [{}, {"BUCKET": 8}, {"BUCKET": 8, "HELD": 40, "DEPTH": 2}, {"BUCKET": 4, "HELD": 12, "DEPTH": 1, "TILE": 900}])
def test_join_of_a_large_group_of_near_copies(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(5)
    texts = near_copies(rng, 1, 160, 70, 3, "a") + near_copies(rng, 3, 12, 40, 1, "b") + near_copies(rng, 40, 1, 50, 0, "c")
    rng.shuffle(texts)
    rows = [(i, t, 1, "x", 5, True) for i, t in enumerate(texts)]
    want = linked_ids(rows)
    got = {r.doc_id: (r.n_links, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and max(n for n, _ in got.values()) > 60


@pytest.mark.parametrize("limits", [{}, {"BUCKET": 8}, {"BUCKET": 8, "HELD": 60, "DEPTH": 2}])
def test_join_finds_lone_pairs_near_the_threshold(spark, monkeypatch, limits):
    """Pairs of 0.8 to 0.85 that no third document connects, all of which share a long head, so their buckets are large and must be split."""
    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(6)
    head = [f"h{i}" for i in range(20)]
    texts = []
    for p in range(120):
        body = [f"p{p}_{i}" for i in range(44)]
        copy = list(body)
        copy[rng.randint(10, 30)] = "y"
        texts += [" ".join(head + body), " ".join(head + copy)]
    rows = [(i, t, 1, "x", 5, True) for i, t in enumerate(texts)]
    want = linked_ids(rows)
    assert all(n == 1 for n, _ in want.values())
    got = {r.doc_id: (r.n_links, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.9 * len(want)


def test_paths_keep_pairs_at_the_threshold():
    """Sketches of pairs that agree in four of five places, hidden in one bucket: the trials find nearly all."""
    rng = np.random.default_rng(7)
    left = rng.integers(0, 40, (1500, ngram_join.TOKENS)).astype(np.uint32)
    right = left.copy()
    for row in right:
        other = rng.permutation(ngram_join.TOKENS)[: ngram_join.TOKENS // 5]
        row[other] = rng.integers(100, 10**6, len(other))
    least = round(0.5 * ngram_join.TOKENS)
    root = ngram_join.Paths(np.concatenate([left, right]), 0.8, least, 1).root
    assert (root[:1500] == root[1500:]).mean() > 0.97
    runs, trials = ngram_join.repeats(0.8)
    kept = 0.8 * (1 - (1 - ngram_join.survival(0.8, ngram_join.DEPTH)) ** trials)
    assert (1 - kept) ** runs <= ngram_join.MISS


def test_links_of_a_tile_match_counting():
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 2**63, 80).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) > 0.04], rng.integers(0, 2**63, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(90)]
    sets += [np.unique(rng.integers(0, 60, 12).astype(np.uint64)) for _ in range(60)]
    side, weight = rng.integers(0, 2, len(sets)), rng.integers(1, 4, len(sets))
    for within in (True, False):
        for some in (slice(0, 90), slice(0, None), slice(90, None), slice(0, 2)):
            own, s, w = sets[some], side[some], weight[some]
            got, _ = ngram_join.linked(own, s, within, w, 0.8)
            want = [sum(w[j] for j in range(len(own)) if j != i and (within or s[i] != s[j]) and len(np.intersect1d(a, own[j])) >= 0.8 * len(np.union1d(a, own[j]))) for i, a in enumerate(own)]
            assert got.tolist() == want


def test_dropping_near_duplicates_keeps_every_other_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, a, 1, "x", 1, True), (5, a + " end", 1, "x", 2, True), (5, b, 1, "x", 3, True), (5, b, 1, "x", 3, True), (6, c, 1, "x", 4, True), (6, c, 1, "y", 4, True),
            (None, a, 1, "x", 5, True), (None, a, 1, "x", 5, True), (7, None, 1, "x", 6, True), (8, "", 1, "x", 7, True), (8, "", 1, "x", 7, True), (9, "short", 1, "x", 8, True), (10, "short", 1, "x", 9, True)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = ngram_join.drop_near_duplicates(df)
    got = [tuple(r) for r in out.collect()]
    assert out.columns == df.columns and out.dtypes == df.dtypes
    six = [r for r in got if r[0] == 6]
    assert len(six) == 1 and six[0] in rows
    assert sorted((r for r in got if r[0] != 6), key=key) == sorted([rows[0], rows[2], *rows[6:12]], key=key)
    assert ngram_join.drop_near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("every", [3, 8, 32])
def test_corpus_order_is_that_of_the_sorted_suffixes(monkeypatch, every):
    monkeypatch.setattr(suffix, "EVERY", every)
    monkeypatch.setattr(suffix, "TRIGGER", 4)
    rng = random.Random(9)
    texts = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, 300))) for _ in range(25)]
    texts += [texts[3], texts[4][7:], texts[5] + texts[6], b"a" * 200, b"a" * 90, b"ab" * 80]
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = suffix.corpus_order(data, starts, np.arange(len(data)))
    rest = [t[i:] for t in texts for i in range(len(t))]
    assert sorted(got.tolist()) == list(range(len(data)))
    assert [rest[i] for i in got] == sorted(rest)


def test_sliding_min_and_ranges():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 99, 500).astype(np.uint64)
    for k in (1, 2, 7, 64, 189, 500, 501):
        assert H.sliding_min(x, k).tolist() == [min(x[i : i + k]) for i in range(500 - k + 1)]
    data = rng.integers(0, 3, 900).astype(np.uint8)
    at = np.sort(rng.integers(0, 800, 200))
    to = at + rng.integers(1, 60, 200)
    by = {}
    for h, a, b in zip(H.ranges_hash(data, at, to).tolist(), at, to, strict=True):
        assert by.setdefault(h, data[a:b].tobytes()) == data[a:b].tobytes()
    assert len(by) == len(set(by.values()))
    assert H.gather(data, at[:3], to[:3] - at[:3]).tolist() == [x for a, b in zip(at[:3], to[:3], strict=True) for x in data[a:b]]


def test_suffix_in_small_slices(spark, monkeypatch):
    rows = corpus() + [(900 + i, "ab" * (400 + i), 1, "x", 1, True) for i in range(3)]
    monkeypatch.setattr(suffix, "SLICE", 2000)
    monkeypatch.setattr(suffix, "RUN", 50)
    got = [tuple(r) for r in suffix.remove_repeats(spark.createDataFrame(rows, SCHEMA), length=60, unit_bytes=3000, digest=True).collect()]
    assert sorted(got, key=key) == sorted(brute_bytes(rows, 60), key=key)


@pytest.mark.parametrize("window", [50, 9])
def test_seen_passages_are_maximal(spark, window):
    rows = corpus()
    got = Counter((r.doc_id, r.first_word, r.n_words) for r in substring.seen_passages(spark.createDataFrame(rows, SCHEMA), window=window, unit_bytes=5000).collect())
    texts = [(r[0], (r[1] or "").encode().split()) for r in rows if r[0] is not None]
    first = {}
    for i, w in texts:
        for k in range(len(w) - window + 1):
            t = tuple(w[k : k + window])
            first[t] = min(first.get(t, i), i)
    want = Counter()
    for i, w in texts:
        seen = [k for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i]
        for k in seen:
            if k - 1 not in seen:
                end = next(e for e in range(k, len(w)) if e + 1 not in seen)
                want[i, k, end - k + window] += 1
    assert got == want and want


def test_substring_with_contexts_that_differ(spark):
    """One block that every document has, between contexts of different lengths: each reference must be tried, and not the smallest alone."""
    core = [f"c{i}" for i in range(25)]
    before, after = [f"b{i}" for i in range(40)], [f"a{i}" for i in range(40)]
    rows = []
    for i, (left, right) in enumerate([(0, 0), (3, 40), (40, 2), (10, 14), (10, 15), (40, 40), (12, 12), (13, 12), (25, 25), (1, 24), (24, 1)]):
        w = [f"x{i}"] * 30 + before[40 - left :] + core + after[:right] + [f"y{i}"] * 30
        rows += [(i, " ".join(w), 1, "x", 5, True), (100 - i, "  ".join(w[:-20] + ["z"] * i + w[-9:]), 1, "x", 5, True)]
    got = [tuple(r) for r in substring.drop_seen_passages(spark.createDataFrame(rows, SCHEMA), unit_bytes=900, digest=True).collect()]
    assert sorted(got, key=key) == sorted(brute_words(rows, 50), key=key)


def test_documents_of_one_template_are_not_compared_all_pairs(spark, monkeypatch):
    """Texts that share six tenths with each other, beyond a tile: only those that share more than the template meet."""
    head = " ".join(f"t{i}" for i in range(100))
    texts = [f"{head} " + " ".join(f"u{d}_{i}" for i in range(30)) for d in range(300)]
    texts += [f"{t} more" for t in texts[:5]]
    rows = [(i, t, 1, "x", 5, True) for i, t in enumerate(texts)]
    sets = [tuple(t.split()) for t in texts]
    tokens = [sorted({hash(w[i : i + 5]) for i in range(len(w) - 4)}) for w in sets]
    edges = ngram_join._sharing_rare(spark.createDataFrame([(0, v, t) for v, t in enumerate(tokens)], "component long, v long, set array<long>"), 0.8)
    assert sorted(map(tuple, edges.collect())) == [(i, 300 + i) for i in range(5)]
    monkeypatch.setattr(ngram_join, "TILE", 2000)
    met = []
    real = ngram_join.S.connected_components
    monkeypatch.setattr(ngram_join.S, "connected_components", lambda e, *a: met.append(out := real(e, *a)) or out)
    got = {r.doc_id: (r.n_links, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (int(i < 5 or i >= 300), i - 300 if i >= 300 else i) for i in range(305)}
    assert [m.count() for m in met] == [305, 10, 10]  # what sketches connect, what goes to tiles, what links


@pytest.mark.parametrize("few", [ngram_join.FEW, 0])
def test_texts_that_met_nothing_are_not_moved(spark, monkeypatch, few):
    """A component beyond a tile among long texts of their own: the shuffles hold less than a quarter of the texts, as they lie on disk."""
    rng = random.Random(5)
    lone = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(6000)) for _ in range(200)]
    near = [f"{' '.join(f't{i}' for i in range(300))} own{d}" for d in range(20)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lone + near)], "doc_id long, text string").repartition(4)
    monkeypatch.setattr(ngram_join, "TILE", 2000)
    monkeypatch.setattr(ngram_join, "FEW", few)
    docs = ngram_join.S.checkpoint(docs)

    def written():
        all_ = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(all_.apply(i).totalShuffleWrite() for i in range(all_.size()))

    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: (r.n_links, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: (0, i) if i < 200 else (19, 200) for i in range(220)}
    assert written() - before < sum(map(len, lone)) / 4


def test_keys_found_by_bits(spark):
    """Every row of the ids is found whatever the room, and few others; null keys are not, repeats and clashing names stay."""
    rows = [(i, f"x{i}", i) for i in range(-3000, 3000)] + [(7, "again", 0), (None, "none", 1)]
    docs = spark.createDataFrame(rows, "id long, text string, __part long")
    ids = spark.createDataFrame([(i,) for i in range(0, 3000, 3)], "id long")
    for most in (1 << 28, 1 << 15):
        met = ngram_join.S.may_be_among(docs, "id", ids, 1000, most)
        assert met.columns == docs.columns
        got = [tuple(r) for r in met.collect()]
        assert len(set(got)) == len(got) < 1600 and set(got) <= set(rows)
        assert set(got) >= {r for r in rows if r[0] is not None and r[0] >= 0 and r[0] % 3 == 0}
    assert ngram_join.S.may_be_among(docs, "id", ids, 1000, 1 << 15).count() < ngram_join.S.may_be_among(docs, "id", docs.where("id is not null").select("id"), 6001, 1 << 15).count()
    assert ngram_join.S.may_be_among(docs, "id", ids.limit(0), 0).count() == 0


def test_the_prefix_filter_loses_no_link(spark):
    rng = random.Random(8)
    sets = [sorted({rng.choice(range(30)) if rng.random() < 0.8 else rng.randrange(1000) for _ in range(rng.randint(1, 25))}) for _ in range(250)]
    sets += [sorted(set(s) ^ {rng.randrange(30)}) or [1] for s in sets[:120]]
    rows = [(v % 2, v, s) for v, s in enumerate(sets)]
    for at in (0.5, 0.8, 0.95):
        found = ngram_join.S.connected_components(ngram_join._sharing_rare(spark.createDataFrame(rows, "component long, v long, set array<long>"), at))
        part = {r.v: r.component for r in found.collect()}
        for a, (ca, _, x) in enumerate(rows):
            for b, (cb, _, y) in enumerate(rows[:a]):
                if ca == cb and len(set(x) & set(y)) >= at * len(set(x) | set(y)) - 1e-9:
                    assert part[a] == part[b]
