"""BPE by automaton, the conversation trie and spelling variants, against the library, brute force and plain definitions."""

import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keratoline.llm import bpe_automaton, conversation_trie, spelling
from keratoline.llm.packing import SHOWN

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe_automaton.Codec(WORD_BPE)


def some_texts(n):
    rng = random.Random(3)
    sets = ["etaoinshrdlu", "aab", "0123456789 ", "é̈à́ ßΣσςİıǅ", "'s't're ve", "!?.,;:-_ ", "你好世界", "\u0085 ᠎\x1c\x1f \t\n\r\x0b", "😀👨‍👩‍👧"]
    for _ in range(n):
        parts = ["".join(rng.choices(rng.choice(sets), k=rng.randint(0, 12))) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.1:
            parts.insert(rng.randint(0, len(parts)), rng.choice(["<|endoftext|>", "<|startoftext|>", "<|endoftext", "</w>"]))
        yield rng.choice(["", " ", "\n"]).join(parts)


def test_bpe_ids_and_text_are_the_librarys(codec):
    library = Tokenizer.from_file(WORD_BPE)
    for text in itertools.chain(some_texts(8000), ["", " ", "a" * 3000, "ab" * 2000 + " " + "the" * 1500]):
        want = library.encode(text, add_special_tokens=False).ids
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False)
    assert codec.decode(np.array([5, 10**6, 6], "<u4").tobytes()) == library.decode([5, 10**6, 6], skip_special_tokens=False)


def small_bpe(path, merges, rng):
    symbols = [chr(SHOWN.get(b, b)) for b in range(256)]
    made, known = [], ["a", "b", "c"]
    while len(made) < merges:
        a, b = rng.choice(known), rng.choice(known)
        if len(a + b) <= 7 and a + b not in known:
            made.append([a, b])
            known.append(a + b)
    vocab = {t: i for i, t in enumerate([*symbols, *(a + b for a, b in made)])}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": made}
    pre = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    path.write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": pre, "post_processor": None, "decoder": None, "model": model}))
    return str(path)


def test_the_automaton_has_one_path_for_each_string_and_it_is_the_merges(tmp_path):
    rng = random.Random(11)
    strings = ["".join(s) for n in range(1, 8) for s in itertools.product("abc", repeat=n)]
    for k in range(6):
        path = small_bpe(tmp_path / f"{k}.json", 14, rng)
        own, library = bpe_automaton.Codec(path), Tokenizer.from_file(path)
        for s in strings:
            assert np.frombuffer(own.encode(s), "<u4").tolist() == library.encode(s, add_special_tokens=False).ids, s


def test_files_that_it_can_not_follow_are_refused(tmp_path):
    with pytest.raises(ValueError, match="plain BPE"):
        bpe_automaton.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    said = json.loads(open(WORD_BPE, encoding="utf-8").read())
    said["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(said))
    with pytest.raises(ValueError, match="added tokens"):
        bpe_automaton.Codec(str(tmp_path / "t.json"))


def test_bpe_of_odd_tables(spark):
    library = Tokenizer.from_file(WORD_BPE)
    rows = [(1, "Hello, WORLD's end", "x"), (1, "Hello, WORLD's end", "x"), (None, None, None), (3, "", ""), (4, "ab " * 40000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe_automaton.round_trip(docs, WORD_BPE).collect()), key=str)
    want = []
    for doc, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((doc, len(ids), sha, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    both = bpe_automaton.decode(bpe_automaton.encode(docs, WORD_BPE), WORD_BPE)
    assert both.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    assert {r["decoded"] for r in both.where("doc_id is null or doc_id = 3").collect()} == {None, ""}
    assert bpe_automaton.round_trip(docs.limit(0), WORD_BPE).count() == 0


def trie_by_hand(rows):
    """Of (conv_id, turn, role, text): the nodes that prefix_trie(rebuilt(turns_of())) should give."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), mark, (role, text)))
    own = {c: [t for _, _, t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole = (*own.get(base, [])[:h], *ts[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].add(c)
        ends[whole].append(c)
    kids = Counter(k[:-1] for k in members if k)
    saved, leaves = Counter(), Counter()
    for k, m in members.items():
        worth = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += worth
            leaves[k[:d]] += not kids[k]
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(k)) for k, m in members.items())


def trie_of(spark, rows, parts=3):
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string").repartition(parts)
    out = conversation_trie.prefix_trie(conversation_trie.rebuilt(conversation_trie.turns_of(table)))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, out.collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("seed, shuffles", [(1, 1), (2, 4), (3, 40)])
def test_the_trie_is_that_by_hand(spark, seed, shuffles):
    rng = random.Random(seed)
    said = ["a", "b c", "", None, " d  e\n", "a"]
    rows = [(c, rng.choice([t, t, t, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(said)) for c in range(-25, 160) for t in range(rng.choice([1, 1, 2, 3, 6]))]
    rows += [(c, t, "user", "the same") for c in range(200, 420) for t in range(2)]  # copies, more than a range holds
    rows += [(20, t, "user", f"turn {t}") for t in range(300)] + [(21, t, "user", f"turn {t}") for t in range(280)]
    rows += rows[:40] + [(None, 0, "user", "nobody's")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        assert trie_of(spark, rows) == trie_by_hand(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_trie_of_nothing_and_of_a_conversation_without_turns(spark):
    assert trie_of(spark, []) == []
    lone = next(c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4)
    assert trie_of(spark, [(lone, 0, "user", "goes")]) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_the_loser_tree_merges_in_order_and_seldom_looks_at_shared_turns():
    rng = random.Random(5)
    turn = lambda i: i.to_bytes(conversation_trie.TURN, "big")
    rows = [(b"".join(turn(7) for _ in range(30)) + b"".join(turn(rng.randint(0, 2)) for _ in range(rng.randint(0, 6))), c) for c in range(600)]
    for k in (1, 2, 3, 7, 16):
        runs = []
        for part in (sorted(rows[i::k]) for i in range(k)):
            lcp = [0, *(conversation_trie.shared(a[0], b[0]) for a, b in itertools.pairwise(part))]
            runs.append(([r[0] for r in part], [r[1] for r in part], lcp))
        tree = conversation_trie.LoserTree(runs)
        got = list(tree)
        assert [(key, c) for key, c, _ in got] == sorted(rows)
        assert [n for _, _, n in got[1:]] == [conversation_trie.shared(a[0], b[0]) for a, b in itertools.pairwise(sorted(rows))]
        assert tree.compared < 31 * k + 10 * len(rows)  # the 30 turns that all share are looked at once a run


def variants_by_hand(words):
    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, []
    for w, n in words.items():
        met = [v for v in words if near(w, v)]
        best = min(met, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out.append([w, form[w], n, len(met), words[best] if form[w] is not None else None])
    for row in out:
        root = row[0]
        while form[root] is not None:
            root = form[root]
        row.insert(2, root)
    return sorted(map(tuple, out), key=str)


def test_variants_are_those_by_hand(spark):
    rng = random.Random(9)
    words = {"".join(rng.choices("abé", k=rng.randint(1, 7))): rng.choice([1, 1, 2, 3, 5, 8, 20, 60]) for _ in range(500)} | {"": 4, "a" * 5000: 3, "a" * 5001: 9, "a" * 2500 + "b" + "a" * 2500: 1, "😀x": 5, "😀": 11}
    out = spelling.variants(spark.createDataFrame([*words.items(), (None, 5), ("null", None)], "word string, n long").repartition(5))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, out.collect()), key=str) == variants_by_hand(words)
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError, match="end"):
        spelling.variants(out.select("word", "n"), 1)


def test_keys_are_equal_just_where_a_word_or_deletion_is():
    words = ["aab", "ab", "aabb", "éa", "", "abab", "b", "a" * 300]
    own, keys = spelling.deletion_keys(words)
    strings = [(i, s) for i, w in enumerate(words) for s in [w, *dict.fromkeys(w[:j] + w[j + 1 :] for j in range(len(w)))]]
    assert Counter(own.tolist()) == Counter(i for i, _ in strings)
    by_key, by_string = defaultdict(set), defaultdict(set)
    for i, k in zip(own.tolist(), keys.tolist(), strict=True):
        by_key[k].add(i)
    for i, s in strings:
        by_string[s].add(i)
    assert sorted(map(sorted, by_key.values())) == sorted(map(sorted, by_string.values()))


def test_words_are_counted_as_told(spark):
    text = "Thïs thïs THÏS ×abcde÷ plain plain plain plain Ünder under under under Āb" + " word" * 3
    rows = [(1, text, 0), (2, text, 0), (2, text, 0), (None, text, 0), (5, None, 0), (6, "", 0), (7, "x" * 70000 + " " + text, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)
    want = Counter()
    for doc, body, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", body or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert {r["word"]: r["n"] for r in spelling.counts(docs).collect()} == want
    many = spark.range(3000).selectExpr("id as doc_id", "'plain under' as text")
    got = {r["word"]: r["n"] for r in spelling.counts(many).collect()}
    slips = Counter(spelling.slipped(zlib.crc32(f"{i}:".encode()), w).decode() for i in range(3000) for w in (b"plain", b"under"))
    assert len(slips) > 6 and got == {w: n for w, n in slips.items() if len(w) >= 5}
