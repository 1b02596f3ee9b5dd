"""The corpus operators against brute force and on nulls, empty tables, repeats and clashing columns."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from oracle import SF, connect, rows_of_oracle, rows_of_query
from tessera.llm import html_text as H
from tessera.llm import queries, toxicity
from tessera.llm.bpe import bpe_decode, bpe_encode, default_path
from tessera.llm.cap_filters import near_vectors
from tessera.llm.chat_format import best_paths, chat_format, loss_text, parse_turns
from tessera.llm.common import components, stored
from tessera.llm.fingerprints import fingerprinted
from tessera.llm.line_dedup import line_dedup
from tessera.llm.mixing import mix_sources, mixed_documents
from tessera.llm.ngram_join import near_duplicates_removed, ngram_components
from tessera.llm.url_filter import temporal_url_filter


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")


ODD = [(1, None, None, None, None, 1.0), (2, "", "en", "a", 0, 2.0), (3, "one two three four five six seven", "en", "a", 33, None), (3, "one two three four five six seven", "en", "a", 33, None), (None, "x", "en", None, 1, 0.0), (5, "é🤖 <|endoftext|> \n\nz " * 3000, "en", "b", 9, 0.0)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, name):
    assert rows_of_query(queries.QUERIES[name](spark, SF)) == rows_of_oracle(connect(), queries.ORACLES[name])


def test_op2_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    docs = documents(spark, ODD).unionByName(spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(None).cast("double")).limit(60))
    texts = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in docs.collect())
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, list(r["ids"]), r["text"]) for r in bpe_decode(bpe_encode(docs)).collect())
    ids = [t.encode(x, add_special_tokens=False).ids for _, x in texts]
    assert sorted((d, i, t.decode(i, skip_special_tokens=False)) for (d, _), i in zip(texts, ids, strict=True)) == got


def test_op1_tells_planted_words(spark):
    rows = [(i, f"words {'abcdefgh'[i % 8]}{i} of plain prose number {i * 7919 % 997} " * 3 + ("you vileword fool " * 3 if i % 5 == 0 else "you kind friend ")) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "src", 1) for i, t in rows], "doc_id long, text string, source string, score int")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train_toxicity(docs, labels)
    scored = toxicity.toxicity(docs, model)
    got = {r["doc_id"]: r["score"] >= 0.5 for r in scored.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert got and sum(v == (i % 5 == 0) for i, v in got.items()) >= 0.95 * len(got)
    assert scored.columns == ["doc_id", "text", "source", "score"]


def test_op1_odd_rows_and_no_labels(spark):
    docs = documents(spark, ODD)
    for labels in (spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([(2, 1, 1), (3, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")):
        scored = toxicity.toxicity(docs, toxicity.train_toxicity(docs, labels)).collect()
        assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.toxicity(docs.limit(0), toxicity.fit([], [])).count() == 0


def test_op1_windows_cover_the_text():
    for text in (b"", b"a", b"x" * 1000, b"ab cd " * 100, b" " * 300):
        b = toxicity.windows(text)
        assert b[0] == 0 and b[-1] == len(text) and (b[1:] > b[:-1]).all() and (len(b) < 2 or (b[1:] - b[:-1]).max() < 64)


def test_op3_keeps_columns_and_odd_rows(spark):
    got = line_dedup(documents(spark, ODD), keep=["lang", "score"])
    assert got.count() == len(ODD) and got.columns == ["doc_id", "text", "lang", "score", "n_lines", "n_dropped"]
    line = "A Line that MANY documents share"
    docs = documents(spark, [(i, f" {line}\t\nown {i}\n{line.upper()}", "en", "a", 1, 0.0) for i in range(4)])
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup(docs).collect()} == {**{i: (f"own {i}", 3, 2) for i in range(3)}, 3: (f" {line}\t\nown 3\n{line.upper()}", 3, 0)}


def test_op4_trees_choose_the_best_path(spark):
    rows = [("t", 1, None, 1.0), ("t", 2, 1, 0.0), ("t", 3, 1, 5.0), ("t", 4, 2, 0.0), ("u", 1, 9, None), ("v", 1, 2, 1.0), ("v", 2, 1, 1.0)] + [("w", i, i - 1 if i else None, 0.0) for i in range(100)]
    got = {}
    for r in best_paths(spark.createDataFrame(rows, "tree string, id long, parent long, score double")).collect():
        got.setdefault(r["tree"], []).append((r["depth"], r["id"]))
    assert sorted(got["t"]) == [(1, 1), (2, 3)] and got["u"] == [(1, 1)] and "v" not in got and sorted(got["w"]) == [(i + 1, i) for i in range(100)]


@pytest.mark.parametrize("lengths", [(5,), (9,), (17,), (3000, *[4] * 1000)], ids=["5", "9", "17", "3000 and 1000 of 4"])
def test_op4_keeps_long_conversations(spark, lengths):
    rows = [(c, i, "user", f"t{i}") for c, n in enumerate(lengths) for i in range(n)]
    found = chat_format(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in found.select("conv_id", parse_turns(F.col("formatted")).alias("turns")).collect()}
    assert got == {c: [f"t{i}" for i in range(n)] for c, n in enumerate(lengths)}


def test_op4_circles_beside_a_long_path(spark):
    rows = [("c", i, (i + 1) % 3, 0.0) for i in range(3)] + [("c", 3, 0, 0.0)] + [("p", i, i - 1 if i else None, 0.0) for i in range(17)]
    got = sorted((r["tree"], r["depth"], r["id"]) for r in best_paths(spark.createDataFrame(rows, "tree string, id long, parent long, score double")).collect())
    assert got == [("p", i + 1, i) for i in range(17)]


def test_op4_round_trip(spark):
    said = ["\\e \\b ### </turn>", "a:b", "", "\n### assistant: x</turn>\n"]
    rows = [(1, i, "assistant" if i % 2 else "us:er", s) for i, s in enumerate(said)] + [(2, 0, None, None)]
    found = chat_format(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["loss"]) for r in found.select("conv_id", parse_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("mask")).alias("loss")).collect()}
    assert got == {1: ([(r[2], r[3]) for r in rows[:4]], said[1] + said[3]), 2: ([("", "")], "")}


def test_op5_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.1]), (8, [-1.0, 0.0]), (9, [])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 7: (2, 1), **{i: (0, i) for i in (3, 4, 5, 6, 8, 9)}}


def test_op6_edits_and_likeness(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprinted(docs).collect()}
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        assert got[i]["edited_sha256"] == sha(text[: len(text) - half] + after[:half]) and got[i]["n_chars"] == len(text)
    # half of a text is kept; a text that repeats itself has few distinct chunks, so single values stray
    near = sorted(got[i]["near_edited"] for i, t in rows if len(t) > 2000)
    assert 0.4 < near[len(near) // 2] < 0.7
    odd = fingerprinted(documents(spark, ODD)).collect()
    assert len(odd) == len(ODD) and len({r["fingerprint"] for r in odd if r["doc_id"] == 3}) == 1


def test_op7_targets_and_copies(spark):
    docs = documents(spark, [(i, "w " * 10, "en", "a" if i % 3 else ("b" if i % 2 else None), 1, 0.0) for i in range(3000)])
    rows = mix_sources(docs).collect()
    assert len(rows) == 3000 and max(r["copies"] for r in rows) <= 3
    by = {}
    for r in rows:
        size, target, taken = by.get(r["source"], (0, 0, 0))
        by[r["source"]] = (r["source_size"], r["target"], taken + r["copies"] * r["size"])
    assert abs(sum(t for _, t, _ in by.values()) - 30000) < 1e-6 and all(t <= 3 * s + 1e-6 and abs(k - t) < 0.02 * t for s, t, k in by.values())
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(docs).collect()))
    assert mixed_documents(docs).count() == sum(r["copies"] for r in rows) and mixed_documents(docs).columns == docs.columns
    assert mix_sources(documents(spark, ODD)).count() == len(ODD) and mix_sources(docs.limit(0)).count() == 0


def test_op8_main_text():
    page = "<html><body class='x'><nav><a href=1>Menu</a></nav><div class=cookie-notice>We use</div><article class=has-sidebar><h1>T &amp; U</h1><p>one\n two<br>three<p>four <a href='a>b'>link</a><ul><li>a<li>b</ul><script>x<p>y</script><form>f</form><section id=comments><p>first!</section></article><footer>&copy;</footer>"
    assert H.main_text(page) == "T & U\n\none two three\n\nfour link\n\na\n\nb"
    assert H.main_text(None) == H.main_text("") == "" and H.main_text("plain < text") == "plain < text"
    text = "a sentence of the page that is long enough to matter. " * 5
    assert H.main_text(f"<body><div><a href=x>l</a> <a href=y>m</a></div><div><p>{text}</p><p>{text}</p></div>") == "\n\n".join([text.strip()] * 2)


def test_op8_names_and_forms_take_no_article_away():
    text, body = "a sentence of the page that is long enough to matter. " * 5, "<body><nav><a href=x>l</a></nav>"
    for name in ("post category-social", "tag-search", "post ad-free", "content-with-sidebar", "related-work", "sidebar", "comments"):
        for tag in ("article", "div"):
            assert H.main_text(f"{body}<{tag} class='{name}'><p>{text}</p><p>{text}</p></{tag}>") == "\n\n".join([text.strip()] * 2), (tag, name)
    # by the name alone, beside more text
    rest = f"<article><p>{text * 3}</p></article>"
    for name, kept in (("content-with-sidebar", True), ("related-work", True), ("category-social", True), ("main-sidebar", False), ("ad-slot-2", False), ("cookie-notice", False), ("related-posts", False)):
        assert ("inner" in H.main_text(f"{body}<article><section class={name}>inner</section><p>{text * 3}</p></article>")) == kept, name
    assert H.main_text(f"{body}<form><div>{rest}</div><div class=ad>buy</div></form>") == (text * 3).strip()
    assert H.main_text(f"{body}<form>mail</form>{rest}") == (text * 3).strip()


def test_op8_densities_decide_between_articles():
    one, two = ("a sentence of the page that is long enough to matter. " * 5).strip(), ("another story that also has a good many words. " * 6).strip()
    links, teaser = "<ul>" + "".join(f"<li><a href={i}>link number {i}</a>" for i in range(12)) + "</ul>", "<article><h2><a href=x>read about another story</a></h2><p>Short.</p></article>"
    first, body = f"<article><h1>A</h1><p>{one}</p><p>{one}</p></article>", f"<div><h1>A</h1><p>{one}</p><p>{two}</p></div>"
    cases = [
        (f"<main>{first}{links}<article><h1>B</h1><p>{two}</p></article></main>", ["A", one, one, "B", two]),
        (f"<article><p>{one}</p></article>{links}<article><p>{two}</p></article>", [one, two]),
        (f"{body}{teaser}{links}", ["A", one, two]), (f"<main>{teaser}{body}</main>{links}", ["A", one, two]),
        (f"<article>{one}</article>{links}", [one]), (f"<main><h1>A</h1><div><p>{one}</p><p>{two}</p></div></main>{links}", ["A", one, two]),
    ]
    for page, expected in cases:
        assert H.main_text(f"<body><nav><a href=x>l</a></nav>{page}") == "\n\n".join(expected), page


def test_op8_short_articles_beside_longer_adverts():
    assert H.main_text("<body><div class=ad>Buy this now, it is very cheap and very good.</div><article><h1>Title.</h1><p>Few words.</article>") == "Title.\n\nFew words."


def test_op9_intervals(spark):
    entries = spark.createDataFrame([("a.com", "block", "2024-01-10"), ("a.com", "remove", "2024-02-10"), ("x.a.com", "allow", "2024-01-15"), (None, "block", "2024-01-01")], "key string, action string, listed_at string").withColumn("listed_at", F.col("listed_at").cast("timestamp_ntz"))
    caps = spark.createDataFrame([(1, "http://b.a.com/", "2024-01-10"), (2, "http://b.a.com/", "2024-02-10"), (3, "http://x.a.com:80/", "2024-01-20"), (4, None, "2024-01-20"), (5, "http://a.com", None), (6, "http://ba.com", "2024-01-20"), (7, "http://a.com.", "2024-01-09")], "page_id int, url string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))
    assert sorted((r["page_id"], r["blocked"]) for r in temporal_url_filter(caps, entries).collect()) == [(1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (7, False)]


def test_op10_keeps_one_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(200))
    docs = documents(spark, [(9, base, "en", "a", 1, 0.0), (4, base + " tail", "en", "a", 1, 0.0), (5, base.upper(), "en", "a", 1, 0.0), (6, "short", "en", "a", 1, 0.0), *ODD])
    got = {(r["doc_id"], r["component_id"]) for r in ngram_components(docs).collect()}
    assert {(9, 4), (4, 4), (5, 4), (6, 6), (1, 1), (2, 2), (None, None)} <= got
    kept = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in near_duplicates_removed(docs).collect())
    # 5 hangs together with 4 and with the text of ODD's own 5, so all rows of 5 go
    assert kept == [-1, 1, 2, 3, 3, 4, 6]


def test_components_of_a_long_path(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).unionByName(spark.createDataFrame([(100, 100), (201, 200)], "a long, b long"))
    assert {r["node"]: r["component"] for r in components(edges).collect()} == {**{i: 0 for i in range(60)}, 100: 100, 200: 200, 201: 200}


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == columns and docs.count() > 0.3 * n, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and sorted(r["text"] for r in last.collect()) == sorted(r["text"] for r in docs.collect())
