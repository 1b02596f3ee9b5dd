"""Operator 11: remove word spans that repeat earlier text, by relative Lempel-Ziv factors over a shared index of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.names import free_name
from tessera.llm.common import scratch, stored
from tessera.llm.shingles import mixed, text_slices, word_hashes

#: Words of an anchor, and the bits of a key that hold an anchor's place in its slice of texts (the others order anchors).
ANCHOR, PLACE_BITS = 8, np.uint64(28)
_PLACE = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Spans:
    """Hashes of spans of words, from the words' own hashes."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, n))])
        self.back = _powers(_INVERSE, n + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64) * _ODD)


def blocks(words: np.ndarray, before: np.ndarray, k: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of texts whose words stand one after another: text, first word in the text, windows, anchor's hash, and the block's hash.

    The anchor of a window of k words is that run of `anchor` words in it whose hash is least (of equal ones the
    first), so equal windows have equal anchors at one place. A block is a run of windows with one anchor: each
    window is in one block, and equal windows are in blocks of equal anchors.
    """
    none = np.zeros(0, np.int64)
    width = k - anchor + 1
    if len(words) < k:
        return none, none, none, none, none
    spans = Spans(words)
    at = np.arange(len(words) - anchor + 1)
    hashes = spans.hashes(at, at + anchor)
    least, held = (hashes & ~_PLACE) | at.astype(np.uint64), 1
    while held < width:
        step = min(held, width - held)
        least, held = np.minimum(least[:-step], least[step:]), held + step
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    inside = np.flatnonzero(text[: len(words) - k + 1] == text[k - 1 :])
    if not len(inside):
        return none, none, none, none, none
    place = (least[inside] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.append(first, len(inside)))
    start = inside[first]
    own = text[start]
    return own, start - before[own], count, hashes[place[first]].view(np.int64), spans.hashes(start, start + count + (k - 1)).view(np.int64)


def _index(docs: DataFrame, k: int, anchor: int) -> DataFrame:
    """A row for each block of each document: doc_id, row, start, windows, anchor, block."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(2)):
                text, start, count, key, block = blocks(*word_hashes(data, offsets, fold=False), k, anchor)
                ids = batch.select([0, 1]).take(pa.array(first + text))
                yield pa.record_batch([*ids.columns, pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(key), pa.array(block)], ["doc_id", "row", "start", "windows", "anchor", "block"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "row", "text").mapInArrow(made, f"doc_id {kind}, row long, start int, windows int, anchor long, block long")


def _windows(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """A row for each window of the wanted blocks (doc_id, row, start, windows, anchor): doc_id, row, start, anchor, window (its hash)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(2)):
                words, before = word_hashes(data, offsets, fold=False)
                lists = batch.column(3).slice(first, len(offsets) - 1)
                text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                start, count, key = (lists.flatten().field(i).to_numpy() for i in range(3))
                each = np.repeat(np.arange(len(start)), count)
                at = start[each] + (np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count))
                whole = before[text[each]] + at
                ids = batch.select([0, 1]).take(pa.array(first + text[each]))
                yield pa.record_batch([*ids.columns, pa.array(at.astype(np.int32)), pa.array(key[each]), pa.array(Spans(words).hashes(whole, whole + k).view(np.int64))], ["doc_id", "row", "start", "anchor", "window"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    per = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "windows", "anchor")).alias("blocks"))
    return docs.join(per, ["doc_id", "row"]).select("doc_id", "row", "text", "blocks").mapInArrow(made, f"doc_id {kind}, row long, start int, anchor long, window long")


def _repeats(rows: DataFrame, key: str, earliest: DataFrame, length) -> DataFrame:
    """Those rows whose key (under its anchor) stands at an earlier place too, as factors: doc_id, row, start, length, from_doc, from_start."""
    place = F.struct("doc_id", "row", "start")
    return rows.join(earliest.where("n > 1"), ["anchor", key]).where(place != F.col("first")).select("doc_id", "row", "start", length.alias("length"), F.col("first.doc_id").alias("from_doc"), F.col("first.start").alias("from_start"))


def _earliest(rows: DataFrame, key: str, *more) -> DataFrame:
    """The first place of each key under its anchor, and how many places there are; partial aggregates, so no key meets in one task."""
    return rows.groupBy("anchor", key, *more).agg(F.min(F.struct("doc_id", "row", "start")).alias("first"), F.count("*").alias("n"))


def merged(factors: list[tuple[int, int, object, int]]) -> list[tuple[int, int, object, int]]:
    """Greedy factors: a factor (start, length, from_doc, from_start) goes on as long as the next repeats what follows in the same document."""
    out: list[tuple[int, int, object, int]] = []
    for start, length, doc, at in sorted(factors, key=lambda f: f[:2]):
        if out and out[-1][2] == doc and start - at == out[-1][0] - out[-1][3] and start <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], start + length - out[-1][0]), doc, out[-1][3])
        else:
            out.append((start, length, doc, at))
    return out


def substring_dedup(docs: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", anchor: int = ANCHOR) -> DataFrame:
    """doc_id, text (the words kept, joined by one space), n_words, n_removed, factors; one row for each row of docs.

    A word goes if a window of k consecutive words over it stands earlier too: in a smaller doc_id, or in the same
    document with an earlier start. Words are runs without white space, unchanged. factors are the repeated spans
    (start, length, from_doc, from_start) whose words go.

    Relative Lempel-Ziv: the reference is all text, cut into content-defined blocks (`blocks`) of k words and more;
    their index, distributed by anchor, holds the first place of each block. A document is parsed against it greedily:
    factors run over whole blocks that stand earlier. At the borders of factors, where a block is new but its anchor
    is not, its windows are looked up one by one among those of the first places of blocks. Equal windows have equal
    anchors, so nothing is lost. Blocks with an anchor that stands once are left out before anything else. A key is
    64 bits of the anchor and 64 of the block or window, so chance hits would need equal anchors.

    Null or empty text has no words. Texts that repeat a doc_id are ordered by a hash; equal rows of a doc_id are one
    document. Rows without a doc_id lose nothing and count nowhere. An empty table gives an empty one; other columns
    are not read. doc_id may be of any type with an order.
    """
    if not 1 <= anchor <= k:
        raise ValueError("an anchor has 1 to k words")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = docs.where("doc_id IS NOT NULL")
    with scratch(docs.sparkSession) as own:
        rows = own.stored(_index(known, k, anchor))
        # a row of docs that is there twice gives each place twice
        again = own.stored(rows.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("block") != F.max("block")).alias("open")).where("n > 1").drop("n"))
        shared = own.stored(rows.join(again, "anchor"))
        own.drop(rows, again)
        earliest = own.stored(_earliest(shared, "block", "open", "windows"))
        found = own.stored(_repeats(shared, "block", earliest.drop("open", "windows"), F.col("windows") + (k - 1)))
        own.drop(shared)
        windows = own.stored(_windows(known, earliest.where("open").select("first.doc_id", "first.row", "first.start", "windows", "anchor"), k))
        single = own.stored(_repeats(windows, "window", own.stored(_earliest(windows, "window")), F.lit(k)))
        factors = stored(found.unionByName(single).groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "length", "from_doc", "from_start")).alias("factors")))
    return _kept(docs, factors)


def _kept(docs: DataFrame, factors: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, n_words long, n_removed long, factors array<struct<start:int,length:int,from_doc:{kind},from_start:int>>"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, gone, spans = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_py().encode().split()
                own = merged([(f["start"], f["length"], f["from_doc"], f["from_start"]) for f in found.as_py() or []])
                keep = np.ones(len(words), bool)
                for start, length, _, _ in own:
                    keep[start : start + length] = False
                left = int(keep.sum())
                texts.append(b" ".join(words if left == len(words) else [words[i] for i in np.flatnonzero(keep)]).decode())
                sizes.append(len(words))
                gone.append(len(words) - left)
                spans.append([dict(zip(("start", "length", "from_doc", "from_start"), f, strict=True)) for f in own])
            doc = batch.column(0)
            shape = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("from_doc", doc.type), ("from_start", pa.int32())]))
            yield pa.record_batch([doc, pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, shape)], ["doc_id", "text", "n_words", "n_removed", "factors"])

    return docs.join(factors, ["doc_id", "row"], "left").select("doc_id", "text", "factors").mapInArrow(made, schema)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)
), d AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM g) WHERE r > 1
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM d
), p AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w
), k AS (
  SELECT p.doc_id, count(c.i) AS n_removed, string_agg(p.word, ' ' ORDER BY p.i) FILTER (WHERE c.i IS NULL) AS kept
  FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.i = p.i GROUP BY p.doc_id
)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
