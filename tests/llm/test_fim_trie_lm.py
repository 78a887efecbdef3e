"""The fill-in-middle transformation, the prefix trie and the n-gram scores against brute force, and on odd tables."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus
from tesserae.llm import fim, ngram_lm, prefix_trie, queries
from tesserae.llm.shared import Workspace

ROWS, _ = corpus.documents()
WORD, BLANK = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
UNIT = re.compile(f"{BLANK}*{WORD}+|{BLANK}+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, corpus.SCHEMA).repartition(5).cache()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 12 fill in middle ------------------------------------------------------------------------------------------


def brute_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


FIM_TEXTS = ["", None, " ", "a", " a", "a ", " \t\n", "a b\x0bc \x0c\r", "<P>", "x<S> y", "<<M>", "<P <S >M>", "<P\n>", "é ü ñ<", "𝔘 \U0001f600x y", "<" * 50, "<S" * 9 + "x <M", "a" * 70_000 + " b " * 900, "é ß z " * 3000]


def test_fim_brute_force(spark, docs):
    rows = [(i, t) for i, t in enumerate(FIM_TEXTS * 12)] + [(None, "no id at all"), (-5, "a b c d"), (7, "same row"), (7, "same row")] + [r[:2] for r in ROWS]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fim.fill_in_middle(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got), key=key) == sorted(((i, *brute_fim(i, t), t or "") for i, t in rows), key=key)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \t<>PSMaé\U0001f600"), max_size=40), max_size=8), st.sampled_from([1, 3, 4096]))
def test_fim_scan_marks(texts, lanes):
    raw = b"".join(t.encode() + b"\xff" for t in texts)
    old, fim.LANES = fim.LANES, lanes
    try:
        marks = fim.scan(np.frombuffer(raw, np.uint8))
    finally:
        fim.LANES = old
    at = 0
    for t in texts:
        here = marks[at : at + len(t.encode()) + 1]
        ends = [len(t[: m.end()].encode()) for m in UNIT.finditer(t)]
        assert np.flatnonzero(here & fim.UNIT_END).tolist() == ends
        assert int(np.count_nonzero(here & fim.CODE_POINT)) == len(t)
        assert int(np.count_nonzero(here & fim.SENTINEL)) == sum(t.count(s) for s in fim.SENTINELS)
        at += len(t.encode()) + 1


def test_fim_lanes_of_a_long_text():
    raw = ("<P> wörd\n" * 40_000).encode() + b"\xff"
    marks = fim.scan(np.frombuffer(raw, np.uint8))
    assert [int(np.count_nonzero(marks & m)) for m in (fim.UNIT_END, fim.CODE_POINT, fim.SENTINEL)] == [80_001, 360_000, 40_000]


def test_fim_other_plans_and_odd_tables(spark):
    rows = [(i, f"some words {i} here") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    every = fim.fill_in_middle(df, fim.Plan(seed=1, rate=100, suffix_first=0)).collect()
    assert {r["form"] for r in every} == {"psm"} and all(r["n"] == 4 for r in every)
    assert {r["form"] for r in fim.fill_in_middle(df, fim.Plan(rate=0)).collect()} == {"plain"}
    clash = df.withColumns({c: F.lit("clash") for c in ("raw", "n", "form", "output", "prefix_chars")})
    assert sorted(fim.fill_in_middle(clash).collect(), key=str) == sorted(fim.fill_in_middle(df).collect(), key=str)
    assert fim.fill_in_middle(df.limit(0)).collect() == []


def test_fim_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op12_fim(spark, str(tmp_path)).collect()}
    assert len(got) == len(ROWS)
    for i, t, *_ in ROWS:
        n, form, p, m, out = brute_fim(i, t)
        r = got[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (n, form, p, m, sha(out), sha(t or ""))


# ---- 13 prefix trie ---------------------------------------------------------------------------------------------


def brute_trie(rows, every=None):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(x)] for c, x in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4 if every else 0
        made[c] = own.get(c - int(math.fmod(c, every)), [])[:h] + own[c][h:] if every else own[c]
    members, last, kids = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(set)
    for c, said in made.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
            if d:
                kids[tuple(said[: d - 1])].add(tuple(said[:d]))
        last[tuple(said)].append(c)

    @functools.cache
    def below(node):
        sums = [below(k) for k in kids[node]]
        words = len(node[-1][1].encode().split()) if node else 0
        return sum(s[0] for s in sums) or 1, sum(s[1] for s in sums) + (len(members[node]) - 1) * words

    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *below(p), sha(",".join(map(str, sorted(last[p])))))
        for p, m in list(members.items())
    )


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def same_trie(df, rows, every=None):
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted((tuple(r[c] for c in TRIE) for r in df.collect()), key=key)
    assert got == sorted(brute_trie(rows, every), key=key)


def conversations(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        base = rng.choice([0, 0, 1, 2])
        for t in range(rng.randint(1, 7)):
            said = f"turn {t} of kind {base}" if rng.random() < 0.7 else f"own words {rng.randrange(9)} here"
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", said))
    rng.shuffle(rows)
    return rows


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("every", [None, 20])
def test_trie_brute_force(spark, every):
    rows = conversations(150)
    same_trie(prefix_trie.prefix_trie(spark.createDataFrame(rows, CONV).repartition(6), every), rows, every)


@pytest.mark.parametrize("every", [None, 20])
def test_trie_odd_rows(spark, every):
    rows = [
        (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 2, None, "a b"), (21, 0, "u", "x"), (21, 0, "u", "a"), (40, 5, "ab", "c"), (41, 5, "a", "bc"),
        (None, 0, "user", "nobody's"), (-3, 1, "user", "minus"), (-3, 0, "user", " \t "), (60, 0, "s", "alone"), (61, None, "s", "alone"), (62, 0, "s", "alone"), (79, 0, "s", "y" * 100_000),
    ]
    df = spark.createDataFrame(rows, CONV).withColumns({c: F.lit("clash") for c in ("pos", "digest", "depth", "words", "chain", "parent", "own")})
    same_trie(prefix_trie.prefix_trie(df, every), rows, every)


def test_trie_of_nothing_has_no_root(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONV), 20).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 0, "a", "b")], CONV)).collect() == []


def test_trie_of_a_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(0, t, "user", f"w {t}") for t in range(400)] + [(c, 0, "user", "hello there") for c in range(1, 61)]
    same_trie(prefix_trie.prefix_trie(spark.createDataFrame(rows, CONV).repartition(4)), rows)


def test_trie_ends_join_ids_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    chains = spark.createDataFrame([(c, [b"x"] if c % 2 else []) for c in range(20)], "conv_id long, chain array<binary>").repartition(5)
    got = {(r["depth"], bytes(r["digest"])): r["ends_sha256"] for r in prefix_trie.ends(chains, Workspace(spark, "t")).collect()}
    assert got == {(0, b""): sha(",".join(map(str, range(0, 20, 2)))), (1, b"x"): sha(",".join(map(str, range(1, 20, 2))))}


# ---- 11 language model ------------------------------------------------------------------------------------------


def brute_lm(rows, smoothing=ngram_lm.Smoothing()):
    """Scores of rows (doc_id, text, trained) by dictionaries of n-grams."""
    said = [["END", *re.findall(f"{WORD}+".encode(), (t or "").encode().lower()), "END"] for _, t, _ in rows]
    count = [collections.Counter() for _ in range(smoothing.order + 1)]
    for (_, _, trained), words in zip(rows, said, strict=True):
        if trained:
            for at in range(1, len(words)):
                for k in range(1, min(smoothing.order, at + 1) + 1):
                    count[k][tuple(words[at + 1 - k : at + 1])] += 1
    n, v = sum(count[1].values()), len(count[1])

    def p(gram):
        k = len(gram)
        if k == 1:
            return (count[1][gram] + 1) / (n + v + 1)
        seen = count[k - 1][gram[:-1]]
        if seen < smoothing.least:
            return p(gram[1:])
        mu = smoothing.strength[k - 2]
        return (count[k][gram] + mu * p(gram[1:])) / (seen + mu)

    out = []
    for (doc_id, _, trained), words in zip(rows, said, strict=True):
        grams = [tuple(words[max(0, at + 1 - smoothing.order) : at + 1]) for at in range(1, len(words))]
        base = sum(math.log10((count[1][g[-1:]] + 1) / (n + v + 1)) for g in grams)
        out.append((doc_id, trained, len(grams), sum(count[1][g[-1:]] > 0 for g in grams), round(base, 6), round(sum(math.log10(p(g)) for g in grams), 6), n))
    return out


def scored(df, **more):
    rows = ngram_lm.score_texts(df, F.col("trained"), **more).collect()
    return [(r["doc_id"], r["trained"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6), r["train_tokens"]) for r in rows]


LM_ROWS = [(i, t, i % 7 != 2) for i, t, *_ in ROWS]
SMOOTHINGS = [ngram_lm.Smoothing(), ngram_lm.Smoothing(strength=(3.0,)), ngram_lm.Smoothing(least=3, strength=(5.0, 2.0, 1.0)), ngram_lm.Smoothing(strength=())]


@pytest.mark.parametrize("smoothing", SMOOTHINGS)
@pytest.mark.parametrize("block", [2_000, ngram_lm.BLOCK])
def test_lm_brute_force(spark, smoothing, block):
    df = spark.createDataFrame(LM_ROWS, "doc_id long, text string, trained boolean").repartition(3)
    got = scored(df, smoothing=smoothing, block=block, part=20_000)
    assert sorted(got) == sorted(brute_lm(LM_ROWS, smoothing))


def test_lm_odd_rows(spark):
    rows = [(None, "a b a b", True), (None, None, False), (1, "a b a b", True), (1, "a b a b", True), (2, "", True), (3, " \n ", False), (4, "A B c\x1cd é É", False), (5, "b a " * 20_000, False), (6, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, trained boolean").withColumns({c: F.lit("clash") for c in ("block", "gram", "part", "ids", "words", "sizes", "totals")})
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(scored(df), key=key) == sorted(brute_lm([(i, t, bool(x)) for i, t, x in rows]), key=key)
    assert scored(df.limit(0)) == []
    untrained = [(i, t, False) for i, t, _ in rows]
    assert sorted(scored(df.withColumn("trained", F.lit(False))), key=key) == sorted(brute_lm(untrained), key=key)


def test_lm_probabilities_of_a_state_add_up_to_one(spark):
    train = [(i, t, True) for i, t in enumerate(["a b c", "a b d", "a b c d", "b c a", "c c c", "a"] * 3)]
    words = ["a", "b", "c", "d", "never"]
    tails = [(100 + k, f"a b {w}", False) for k, w in enumerate(words)] + [(200, "a b", False)]
    df = spark.createDataFrame(train + tails, "doc_id long, text string, trained boolean")
    got = {r[0]: r[5] for r in scored(df, smoothing=ngram_lm.Smoothing(strength=(2.0, 1.0)))}
    # each text's last factor is its end, so look at prefixes: P(a b w) over all w and the end is P(a b)
    direct = {r[0]: r for r in brute_lm(train + tails, ngram_lm.Smoothing(strength=(2.0, 1.0)))}
    assert all(abs(got[i] - direct[i][5]) < 1e-5 for i in got)


def test_lm_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], not r["held_out"], r["n_tokens"], r["n_known"], r["base_score"], r["score"], r["train_tokens"]) for r in queries.op11_ngram_lm(spark, str(tmp_path)).collect())
    rows = [(i, t, zlib.crc32(str(i).encode()) % 7 != 2) for i, t, *_ in ROWS]
    want = sorted(brute_lm(rows))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], atol=2e-6)
    held = [g for g in got if not g[1]]
    assert sum(g[5] for g in held) > sum(g[4] for g in held)
