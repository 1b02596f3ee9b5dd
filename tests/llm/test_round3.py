"""Operators 11 to 13 against brute force, on odd rows, ties, repeats, very long texts, clashing names and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from oracle import SF
from tessera.llm import divergence
from tessera.llm.divergence import source_divergence
from tessera.llm.importance import chunk_bounds, importance_resampling
from tessera.llm.queries import QUERIES
from tessera.llm.substring_dedup import blocks, merged
from tessera.llm.substring_dedup import substring_dedup as dedup

WORD = re.compile(r"[^ \t-\r]+")


def frame(spark, rows):
    """rows: (doc_id, text, lang, source); and columns of names that the operators use themselves."""
    return spark.createDataFrame([(*r, 1, 2, 3, 4.0, "x") for r in rows], "doc_id long, text string, lang string, source string, row long, n int, rank int, score double, term string")


def removed(rows, k):
    """Brute force: for each (doc_id, text) the words left."""
    places = sorted((d, i) for d, t in rows for i in range(len(WORD.findall(t or "")) - k + 1))
    words = {d: WORD.findall(t or "") for d, t in rows}
    seen, gone = set(), defaultdict(set)
    for d, i in places:
        w = tuple(words[d][i : i + k])
        if w in seen:
            gone[d].update(range(i, i + k))
        seen.add(w)
    return {d: (len(w), len(gone[d]), " ".join(x for i, x in enumerate(w) if i not in gone[d])) for d, w in words.items()}


def repetitive(rnd):
    """Texts of few different words, with passages copied whole and in part, periods, and other white space."""
    passages = [" ".join(rnd.choice(["a", "b", "C", "é", "dd"]) for _ in range(rnd.randrange(3, 60))) for _ in range(8)]
    out = []
    for i in range(60):
        parts = [rnd.choice(passages) if rnd.random() < 0.6 else " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(30)) for _ in range(rnd.randrange(40))) for _ in range(rnd.randrange(6))]
        out.append((i * 3 % 61, rnd.choice([" ", "\n", "\t \x0b"]).join(parts)))
    return [*out, (900, "x " * 300), (901, "x y " * 300), (902, "y x " * 20), (903, None), (904, " \n ")]


@pytest.mark.parametrize("k,anchor,seed", [(20, 8, 1), (20, 8, 2), (6, 3, 3), (5, 1, 4), (4, 4, 5)])
def test_op11_equals_brute_force(spark, k, anchor, seed):
    rows = repetitive(random.Random(seed))
    docs = frame(spark, [(d, t, "en", "s") for d, t in rows]).repartition(7)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in dedup(docs, k, anchor=anchor).collect()}
    assert got == removed(rows, k) and any(n for _, n, _ in got.values())


def test_op11_factors_point_at_earlier_text(spark):
    rows = repetitive(random.Random(9))
    words = {d: WORD.findall(t or "") for d, t in rows}
    for r in dedup(frame(spark, [(d, t, "", "") for d, t in rows])).collect():
        for f in r["factors"]:
            assert (f["from_doc"], f["from_start"]) < (r["doc_id"], f["start"])
            assert words[r["doc_id"]][f["start"] : f["start"] + f["length"]] == words[f["from_doc"]][f["from_start"] : f["from_start"] + f["length"]]


def test_op11_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, passage + " one"), (1, passage + " one"), (2, passage + " two"), (None, passage), (None, None), (3, None), (4, ""), (5, long), (6, "q " + long + " q"), (7, "a" * 300_000)]
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_words"], r["n_removed"], r["text"]) for r in dedup(frame(spark, [(d, t, None, None) for d, t in rows])).collect())
    assert [g[:3] for g in got] == [(-1, 0, 0), (-1, 30, 0), (1, 31, 0), (1, 31, 0), (2, 31, 30), (3, 0, 0), (4, 0, 0), (5, 150_000, 0), (6, 150_002, 150_000), (7, 1, 0)]
    assert got[4][3] == "two" and got[8][3] == "q q"
    named = dedup(frame(spark, [(1, passage, "", ""), (2, passage, "", "")]).select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text"))
    assert {r["doc_id"]: r["n_removed"] for r in named.collect()} == {"d1": 0, "d2": 30}
    assert dedup(frame(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError):
        dedup(frame(spark, []), 5, anchor=6)


def test_op11_blocks_hold_each_window_once():
    import numpy as np

    words = np.array([random.Random(3).randrange(9) for _ in range(500)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    before = np.array([0, 100, 100, 110, 500])
    text, start, count, _, _ = blocks(words, before, 20, 8)
    held = Counter((t, s + i) for t, s, n in zip(text.tolist(), start.tolist(), count.tolist(), strict=True) for i in range(n))
    assert held == Counter([(0, i) for i in range(81)] + [(3, i) for i in range(371)])
    assert count.max() <= 13


def test_op11_merged_factors():
    assert merged([(0, 20, 1, 5), (5, 25, 1, 10), (30, 20, 1, 35), (51, 20, 1, 56), (60, 20, 2, 0)]) == [(0, 50, 1, 5), (51, 20, 1, 56), (60, 20, 2, 0)]


def floored(rows, target, percent=25, least=20, buckets=10_000, seed=7, n=2):
    """Brute force of operator 12: doc_id, n_features, weight, score, rank for each row."""

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)

    own = [(d, *features(t)) for d, t in rows]
    s, t = Counter(b for _, f, _ in own for b in f), Counter(b for x in target for b in features(x)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for d, f, words in own:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] if x[0] is not None else 1 << 62, -x[1]))
    for i, x in enumerate(able[: len(able) * percent // 100], 1):
        x[4] = i
    return [tuple(x[:5]) for x in out]


def drawn(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=str)


def test_op12_equals_brute_force_on_whole_tables(spark):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    expected = floored([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    assert drawn(QUERIES["op12_importance"](spark, SF)) == sorted(expected, key=str)
    assert sum(r[4] is not None for r in expected) > 10


@pytest.mark.parametrize("size,n", [(40, 2), (64, 3), (1 << 17, 1)])
def test_op12_chunks_change_nothing(spark, size, n):
    rnd = random.Random(size)
    rows = [(i, " ".join(rnd.choice(["Ab1", "é", "z" * rnd.randrange(1, 90), "the", "9", "ÀÉ"]) + rnd.choice(["", ".", "--", "\n"]) for _ in range(rnd.randrange(120)))) for i in range(50)]
    rows += [(3, rows[0][1]), (3, rows[0][1]), (None, "the the " * 30), (60, None), (61, ""), (62, "...." * 99), (63, "b" * 5000), (64, "the " * 50_000)]
    docs, target = frame(spark, [(d, t, "", "") for d, t in rows]), frame(spark, [(1, "the é 9", "", ""), (2, None, "", ""), (3, "ab1 the", "", "")])
    got = importance_resampling(docs, target, 40, 10, n, 97, 5, chunk_bytes=size)
    assert drawn(got) == sorted(floored(rows, ["the é 9", "ab1 the"], 40, 10, 97, 5, n), key=str)


def test_op12_empty_tables(spark):
    rows = [(i, "some words of a text " * 9) for i in range(9)]
    none = frame(spark, []).limit(0)
    docs = frame(spark, [(d, t, "", "") for d, t in rows])
    assert drawn(importance_resampling(docs, none)) == sorted(floored(rows, []), key=str)
    assert importance_resampling(none, docs).count() == 0


def test_op12_chunk_bounds():
    data = "--Añ bb. ccc dddddddddd e ".lower().encode()
    found = list(chunk_bounds(data, 1, 6))
    assert [data[a:b] for a, b, _ in found] == [b"--a\xc3\xb1 bb. ", b"ccc dddddddddd ", b"e "] or b"".join(data[a:b] for a, b, _ in found) == data
    assert [data[b:c] for _, b, c in found][-1] == b"" and all(b <= c for _, b, c in found)
    assert list(chunk_bounds(b"", 1)) == []


def diverged(rows, least=10, top=10):
    """Brute force of operator 13 as its contract has it, over every kept term."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, ts in own for t in set(ts))
        kept = sorted(t for t, n in df.items() if n >= least)
        v = len(kept)

        def shares(counts, kept=kept, v=v):
            total = sum(counts[t] for t in kept)
            return [1 + 10**9 * (counts[t] + 2) // (total + 2 * v) for t in kept]

        of = {s: Counter(t for _, source, ts in own if source == s for t in ts) for s in {d[1] for d in own}}
        p, q = {s: shares(c) for s, c in of.items()}, shares(sum(of.values(), Counter()))
        for s in of:
            parts = {"pair": [(sum(map(f, p[s], p[o])), o) for o in of if o != s], "term": [(f(a, b), t) for a, b, t in zip(p[s], q, kept, strict=True) if of[s][t] and a > b]}
            for part, found in parts.items():
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_op13_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(divergence, "HELD", 50)
    rnd = random.Random(seed)
    rows = []
    for i in range(120):
        source = rnd.choice(["a", "a", "a", "b", "c", None, "é"])
        words = [rnd.choice(["The", "the", "of", "ÉTÉ", "été", "日本", f"w{chr(97 + rnd.randrange(26))}", "x1y", source or "none"]) for _ in range(rnd.randrange(40))]
        rows.append((i, rnd.choice([" ", ",", "7"]).join(words), rnd.choice(["en", "en", "de", None]), source))
    rows += [(200, None, "fr", "a"), (201, "few words", "fr", "b"), (202, "", None, "only"), (5, rows[5][1], "en", "a"), (None, "the of the", "en", "b"), (203, "the " * 20_000, "en", "z")]
    got = source_divergence(frame(spark, [(d, t, lang, s) for d, t, lang, s in rows]).repartition(9))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == diverged(rows)


def test_op13_large_counts_stay_exact(spark):
    one = spark.range(1).select(F.lit(9 * 10**15).alias("c"), F.lit(10**16).alias("n"), F.lit(10**6).alias("v"))
    got = one.select(divergence.share("c", F.col("n"), F.col("v")).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (9 * 10**15 + 2) // (10**16 + 2 * 10**6)


def test_op13_empty_table(spark):
    assert source_divergence(frame(spark, []).limit(0)).count() == 0
    assert [tuple(r) for r in source_divergence(frame(spark, [(1, "a", "en", "s"), (2, "b", "en", "t")])).collect()] in ([("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)], [("en", "t", "pair", "s", 0, 1), ("en", "s", "pair", "t", 0, 1)])




def test_a_fit_holds_no_beginnings_as_strings_for_each_text():
    """The driver fits; equal beginnings of different texts are one string."""
    import random
    import tracemalloc

    from tessera.llm.toxicity import fit

    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(9)) for _ in range(1500)]
    texts = [" ".join(rnd.sample(words, 300) + ["vilest"] * (i % 2)) for i in range(300)]
    tracemalloc.start()
    try:
        fit(texts, [i % 2 for i in range(300)])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 25_000_000
