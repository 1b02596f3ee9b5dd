"""Each stage of the pipeline, its run, and operators 2 and 8 on whole small tables against plain Python."""

import re
from collections import Counter, defaultdict
from html.parser import HTMLParser
from math import ceil, floor

import pytest

import corpus_pipeline
from oracle import SF
from tessera.llm.common import stored
from tessera.llm import toxicity
from tessera.llm.bpe import bpe_decode, bpe_encode, default_path
from tessera.llm.html_text import op8_html

WORD = re.compile(r"[^ \t-\r]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def rows(df):
    return [r.asDict() for r in df.collect()]


def bag(found):
    return Counter(tuple(sorted(r.items())) for r in found)


@pytest.fixture(scope="module")
def staged(spark):
    """The rows before each stage and after the last but one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [rows(docs)]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        out.append(rows(docs))
    return out


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    ids = [t.encode(x, add_special_tokens=False).ids for x in texts]
    return [(tuple(i), t.decode(i, skip_special_tokens=False)) for i in ids]


def test_toxicity_stage(spark, staged):
    model = toxicity.train_toxicity(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    expected = [r for r, s in zip(staged[0], toxicity.scores([r["text"] for r in staged[0]], model), strict=True) if s < 0.5]
    assert bag(staged[1]) == bag(expected)


def test_line_dedup_stage(staged):
    def key(line):
        return lowered(line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for r in staged[1]:
        for line in r["text"].split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(r["doc_id"])
    expected = []
    for r in staged[1]:
        kept = [x for x in r["text"].split("\n") if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == r["doc_id"]]
        expected.append({**r, "text": "\n".join(kept), "n_chars": len("\n".join(kept))})
    assert bag(staged[2]) == bag(expected)


def test_near_copies_stage(staged):
    sets = {}
    for r in staged[2]:
        words = WORD.findall(lowered(r["text"]))
        sets[r["doc_id"]] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    ids = sorted(sets)
    first = {i: i for i in ids}
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in pairs:
            first[a] = first[b] = min(first[a], first[b])
    assert pairs and bag(staged[3]) == bag([r for r in staged[2] if first[r["doc_id"]] == r["doc_id"]])


def test_mixing_stage(staged):
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in staged[3]}
    per = defaultdict(int)
    for r in staged[3]:
        per[r["source"]] += size[r["doc_id"]]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(per))}
    target, left, total = {}, set(per), sum(per.values())
    while left:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if weight[s] * level >= 3 * per[s]}
        target |= {s: 3 * per[s] for s in full} if full else {s: weight[s] * level for s in left}
        left -= full or left
    copies, taken = Counter(r["doc_id"] for r in staged[4]), Counter()
    for r in staged[3]:
        rate = target[r["source"]] / per[r["source"]]
        assert floor(rate + 1e-9) <= copies[r["doc_id"]] <= ceil(rate - 1e-9), r["doc_id"]
        taken[r["source"]] += copies[r["doc_id"]] * size[r["doc_id"]]
    # copies are whole documents: the draw can miss a target by about one of them
    for s in per:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + max(size[r["doc_id"]] for r in staged[3] if r["source"] == s), (s, taken[s], target[s])
    assert bag(staged[4]) == bag([r for r in staged[3] for _ in range(copies[r["doc_id"]])])


def test_run_encodes_what_the_stages_leave(spark, staged):
    expected = Counter((r["doc_id"], len(i), i, t) for r, (i, t) in zip(staged[4], encoded([r["text"] for r in staged[4]]), strict=True))
    assert Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["text"]) for r in rows(corpus_pipeline.run(spark, SF))) == expected


def test_op2_on_all_documents(spark, staged):
    got = Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in rows(bpe_decode(bpe_encode(spark.read.parquet(f"{SF}/documents.parquet")))))
    assert got == Counter((r["doc_id"], i, t) for r, (i, t) in zip(staged[0], encoded([r["text"] for r in staged[0]]), strict=True))


class Article(HTMLParser):
    """The text in the article element, with a space at each tag of a block."""

    def __init__(self):
        super().__init__()
        self.deep, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.deep += tag == "article"
        self.out += " " if tag in ("p", "br", "h1", "h2", "h3", "li", "ul", "div") else ""

    def handle_endtag(self, tag):
        self.deep -= tag == "article"
        self.out += " " if tag in ("p", "h1", "h2", "h3", "li", "ul", "div") else ""

    def handle_data(self, data):
        self.out += data if self.deep else ""


def test_op8_on_all_pages(spark):
    pages = rows(spark.read.parquet(f"{SF}/pages.parquet"))
    got = {r["page_id"]: r for r in rows(op8_html(spark, SF))}
    assert len(got) == len(pages)
    for p in pages:
        parser = Article()
        parser.feed(p["html"])
        parser.close()
        found = got[p["page_id"]]
        assert found["text"].split() == "".join(parser.out).split() and found["url"] == p["url"] and found["n_chars"] == len(found["text"])
