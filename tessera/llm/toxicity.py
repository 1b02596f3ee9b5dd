"""Operator 1: toxicity by the lengths to which two zstandard dictionaries compress windows of a text."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from math import log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import give_back, trimmed, tuned

#: Bytes of a window, windows compressed in one call, and what stands before each window and ends each dictionary:
#: every window then has one match at least, and a further one costs its own bytes alone. A window and what it runs
#: over stay below 64 bytes, from which on zstandard codes unmatched bytes by frequency and lengths jump.
WINDOW, OVER, CALL, PRIMER = 40, 22, 20_000, b"\x01\x02\x03\x04\x05\x06\x07\x08" * 2
#: Labelled documents of each class that a fit takes at most, characters of the longest one taken, the parts of a cross-fit, and features of a document.
SAMPLE, LONGEST, PARTS, N_FEATURES = 1500, 200_000, 3, 3 + 2 * 4
#: Bytes of a dictionary: the common text of both classes, and room for what tells the own class from the other.
COMMON_BYTES, OWN_BYTES = 7168, 1024
#: Lengths of the word beginnings that can tell a class; the evidence (G statistic) and the ratio of rates that one needs in ordinary and in toxic text.
BEGINNINGS, EVIDENCE, RATIO = (4, 5, 6, 7, 8, 10, 12), (20.0, 40.0), (2, 8)
#: Bytes saved from which a window counts; each is one feature.
SAVED = (1, 2, 3, 5)
#: Characters of text that are scored at once.
SLICE_CHARS = 1_000_000
#: Matches of 6 bytes and more only: shorter ones are endings that any word may have. The fast strategy would not find all matches with a dictionary.
PARAMETERS = zstandard.ZstdCompressionParameters(
    window_log=15, hash_log=15, chain_log=15, search_log=4, min_match=6, strategy=zstandard.STRATEGY_LAZY, write_checksum=False, write_content_size=False, write_dict_id=False
)


@dataclass(frozen=True)
class ToxicityModel:
    """Two raw-content dictionaries and the weights of what their window lengths say about a document."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]

    @cached_property
    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        out = []
        for content in (self.ordinary, self.toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=PARAMETERS)
            out.append(zstandard.ZstdCompressor(compression_params=PARAMETERS, dict_data=d))
        return out[0], out[1]


def windows(data: bytes) -> np.ndarray:
    """Bounds of consecutive windows of about WINDOW bytes that end before white space where some is near."""
    n = len(data)
    if not n:
        return np.zeros(1, np.int64)
    space = np.flatnonzero(np.frombuffer(data, np.uint8) <= 0x20)
    marks = np.arange(WINDOW, n, WINDOW)
    after = np.append(space, n)[np.searchsorted(space, marks)]
    return np.unique(np.concatenate([[0], np.where(after - marks < OVER, after, marks), [n]]))


def window_savings(datas: list[bytes], model: ToxicityModel) -> list[np.ndarray]:
    """For each text the bytes by which the toxic dictionary shortens each window more than the ordinary one."""
    pieces, counts = [], []
    for data in datas:
        b = windows(data).tolist()
        pieces += [data[x:y] for x, y in zip(b[:-1], b[1:], strict=True)]
        counts.append(len(b) - 1)
    found = []
    for lo in range(0, len(pieces), CALL):
        part = pieces[lo : lo + CALL]
        size = np.fromiter(map(len, part), np.uint64, len(part)) + np.uint64(len(PRIMER))
        spans = np.stack([np.cumsum(size) - size, size], 1).astype(np.uint64)
        held = zstandard.BufferWithSegments(PRIMER + PRIMER.join(part), spans.tobytes())
        a, b = (np.fromiter(map(len, pack.multi_compress_to_buffer(held, threads=1)), np.int64, len(part)) for pack in model.compressors)
        found.append(a - b)
    all_savings = np.concatenate(found) if found else np.zeros(0, np.int64)
    return np.split(all_savings, np.cumsum(counts)[:-1])


def features(texts: list[str], model: ToxicityModel) -> np.ndarray:
    """For each text: a constant, shares and numbers of windows that the toxic dictionary shortens by so many bytes, the mean saving and the log of the number of windows."""
    out = np.zeros((len(texts), N_FEATURES))
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at + len(part) < len(texts) and (not part or size + len(texts[at + len(part)]) < 1_000_000):
            part.append(f" {texts[at + len(part)]} ".lower().encode("utf-8", "replace"))
            size += len(part[-1])
        for g in window_savings(part, model):
            over = [float((g >= s).sum()) for s in SAVED]
            out[at] = [1.0, *(20 * x / (len(g) + 1) for x in over), *(np.log1p(x) for x in over), float(np.clip(g, 0, None).sum()) / (len(g) + 1), np.log1p(len(g)) / 3]
            at += 1
    return out


def _evidence(a: int, n: int, b: int, m: int) -> float:
    """The G statistic of a of n against b of m."""
    p = (a + b) / (n + m)
    return 2 * sum(k * log(k / (t * q)) for k, t, q in ((a, n, p), (n - a, n, 1 - p), (b, m, p), (m - b, m, 1 - p)) if k)


def _distinct(text: str) -> set[str]:
    """The word beginnings of a text."""
    words = {w for w in re.split(r"[^\w@$!*'-]+", text.lower()) if w}
    return {w[:n] for w in words for n in BEGINNINGS if len(w) >= n} | {w + " " for w in words if 3 <= len(w) <= 12}


def train_dictionaries(ordinary: list[Iterable[str]], toxic: list[Iterable[str]]) -> tuple[bytes, bytes]:
    """The raw-content dictionaries of ordinary and of toxic text, of one size, from the word beginnings of each text.

    Each holds the text that both classes have in common, whole words by the share of documents that have them,
    at the same place in both, so that such text has one length under either. Then come the beginnings that tell
    the own class from the other, the most telling last: as many bytes for either class as the one with more to tell
    needs, up to OWN_BYTES; the other takes what leans to it with less evidence.
    """
    counts, sizes = [Counter(s for t in texts for s in t) for texts in (ordinary, toxic)], (len(ordinary), len(toxic))

    def telling(c: int, least: float, ratio: float, room: int) -> str:
        """The beginnings that tell class c, the most telling last; `room` bytes at most."""
        a, b, n, m = counts[c], counts[1 - c], sizes[c], sizes[1 - c]
        ranked = [(g, len(s), s) for s, k in a.items() if k >= 3 and k * m > ratio * b[s] * n and (g := _evidence(k, n, b[s], m)) >= least]
        taken: list[str] = []
        size = 0
        for _, _, s in sorted(ranked, reverse=True):
            piece = f" {s}"
            if any(piece in t for t in taken):
                continue
            size += len(piece.encode())
            if size > room:
                break
            taken.append(piece)
        return "".join(reversed(taken))

    own = [telling(c, EVIDENCE[c], RATIO[c], OWN_BYTES) for c in (0, 1)]
    room = max(len(o.encode()) for o in own)
    # the class that less tells has as much room, for what leans to it however little
    own = [o if 2 * len(o.encode()) >= room else telling(c, 0.0, 1.0, room) for c, o in enumerate(own)]
    share = {s: counts[0][s] / sizes[0] + counts[1][s] / sizes[1] for s in {*counts[0], *counts[1]} if s.endswith(" ")}
    common, size = [], 0
    for s in sorted(share, key=lambda s: (-share[s], s)):
        if f" {s}" not in own[0] and f" {s}" not in own[1]:
            common.append(f" {s}")
            size += len(common[-1].encode())
            if size > COMMON_BYTES:
                break
    text = "".join(reversed(common)).encode()[-COMMON_BYTES:].rjust(COMMON_BYTES, b"\0")
    room = max(len(o.encode()) for o in own)
    one, other = (text + o.encode().rjust(room, b"\0") + PRIMER for o in own)
    return one, other


def _weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 0.3)
    ridge[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def different(texts: list[str], signs: int = 6, run: int = 4) -> list[int]:
    """Places of texts that share no minimum hash of word runs with an earlier text: of copies the first stays.

    Copies are no independent evidence, and would set their chance words into the dictionary.
    """
    seen: list[set[int]] = [set() for _ in range(signs)]
    kept = []
    odd = [0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 for i in range(signs)]
    for i, t in enumerate(texts):
        words = [zlib.crc32(w.encode("utf-8", "replace")) for w in re.findall(r"\w+", t.lower())] or [0]
        h = np.array(words, np.uint64)
        n = max(1, len(h) - run + 1)
        runs = np.zeros(n, np.uint64)
        for j in range(min(run, len(h))):
            runs = runs * np.uint64(0x100000001B3) + h[j : j + n]
        own = [int(((runs ^ (runs >> np.uint64(29))) * np.uint64(m)).min()) for m in odd]
        if not any(v in s for v, s in zip(own, seen, strict=True)):
            kept.append(i)
        for v, s in zip(own, seen, strict=True):
            s.add(v)
    return kept


def fit(texts: list[str], labels: list[int], rate: float | None = None) -> ToxicityModel:
    """Dictionaries from all texts, thresholds and weights from texts scored by dictionaries of the other part.

    rate: the share of toxic documents among all labelled ones, where the texts were taken by class. With
    fewer than 3 texts of a class nothing can be told, and the model scores every text with the rate.
    """
    one = different(texts)
    rate = sum(map(int, labels)) / len(labels) if rate is None and labels else rate
    texts, labels = [texts[i] for i in one], [labels[i] for i in one]
    y = np.array(labels, float)
    rate = rate or 0.0
    of = [[i for i, v in enumerate(labels) if int(v) == c] for c in (0, 1)]
    if min(map(len, of)) < 3:
        return ToxicityModel(b"", b"", (log(max(rate, 1e-3) / max(1 - rate, 1e-3)),))
    # by number: as strings of their own the beginnings of all texts take some 200 MB of the driver
    numbers: dict[str, int] = {}
    tell = [array("i", (numbers.setdefault(s, len(numbers)) for s in _distinct(t))) for t in texts]
    beginnings = list(numbers)

    def trained(of: list[list[int]]) -> ToxicityModel:
        return ToxicityModel(*train_dictionaries(*([map(beginnings.__getitem__, tell[i]) for i in ids] for ids in of)), ())

    # each part is scored by dictionaries of the others, so the weights see texts that no dictionary has learned
    parts = min(PARTS, min(map(len, of)))
    x = np.zeros((len(texts), N_FEATURES))
    for k in range(parts):
        model = trained([[i for j, i in enumerate(ids) if j % parts != k] for ids in of])
        held = [i for ids in of for i in ids[k::parts]]
        x[held] = features([texts[i] for i in held], model)
    w = _weights(x, y)
    drawn = float(y.mean())
    w[0] += log(max(rate, 1e-3) / max(1 - rate, 1e-3)) - log(drawn / (1 - drawn))
    model = trained(of)
    return ToxicityModel(model.ordinary, model.toxic, tuple(w.tolist()))


def scores(texts: list[str], model: ToxicityModel) -> np.ndarray:
    w = np.array(model.weights)
    z = features(texts, model) @ w if len(w) > 1 else np.full(len(texts), w[0])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def in_fold(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of doc_id as text (null: empty text) leaves no remainder; such rows are held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def train_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> ToxicityModel:
    """A model from at most `sample` labelled documents of each class, chosen by a hash of doc_id, without the held-out fold.

    A doc_id with several labels counts as toxic if one says so; several rows of a doc_id count once. Only the
    sample comes to the driver, without texts of over `longest` characters, and only its ids are broadcast: at
    most 2 * sample rows. Empty tables, and labels of one class alone, give a model that knows only a rate.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~in_fold(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    by_class = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).where("toxic IN (0, 1)").collect()}
    picks = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.coalesce(F.char_length("text"), F.lit(0)) <= longest).join(F.broadcast(picks[0].unionByName(picks[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    rows = sorted((r["doc_id"], r["toxic"], r["text"] or "") for r in found.toArrow().to_pylist())
    total = sum(by_class.values())
    model = fit([r[2] for r in rows], [r[1] for r in rows], by_class.get(1, 0) / total if total else 0.0)
    give_back()
    return model


def toxicity(docs: DataFrame, model: ToxicityModel, to: str = "score") -> DataFrame:
    """docs with the column `to`, 0 to 1; one row for each row of docs, and only the text enters the score.

    Whole texts are cut into windows, each window is compressed with both dictionaries, and the windows that
    the toxic one shortens decide by calibrated weights. Null text counts as empty, and an empty text has the
    score of a document without such windows. A column of docs that is named as `to` is replaced; an empty table
    gives an empty one.
    """
    tuned(docs.sparkSession)
    keep = [c for c in docs.columns if c != to]
    at = keep.index("text")
    schema = docs.select(*[f"`{c}`" for c in keep]).schema.add(to, "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held, size = [], [], 0
            for text in batch.column(at):
                held.append(text.as_py() or "")
                size += len(held[-1])
                if size > SLICE_CHARS:
                    found.append(scores(held, model))
                    held, size = [], 0
            found.append(scores(held, model))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found), pa.float64())], names=[*keep, to])

    return docs.select(*[f"`{c}`" for c in keep]).mapInArrow(trimmed(scored), schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity(docs.select("doc_id", "text"), train_toxicity(docs, labels))
    return found.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
