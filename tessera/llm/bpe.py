"""Operator 2: byte-level BPE through a table of distinct words."""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tessera.llm.common import trimmed, tuned

#: Characters of text that share one table of word numbers, and ids that are put in place or decoded at once.
CHUNK_CHARS, SLICE_IDS = 8_000_000, 500_000
#: Printable ASCII, tab, line feed, carriage return and the letters of Latin-1 but ª µ º.
LATIN = frozenset("\t\n\r") | {chr(c) for c in range(0x20, 0x7F)} | {chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Words(dict):
    """Numbers words in the order in which they first come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


@lru_cache(maxsize=2)
def _loaded(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def added_tokens(path: str) -> tuple[str, ...]:
    """The added tokens of a byte-level tokenizer that `splitter` can stand for."""
    with open(path) as file:
        spec = json.load(file)
    if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or not spec["pre_tokenizer"].get("use_regex", True):
        raise ValueError("the tokenizer must be byte-level without normalizer and prefix space")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("added tokens must match literally")
    return tuple(t["content"] for t in spec["added_tokens"])


@lru_cache(maxsize=2)
def splitter(added: tuple[str, ...]):
    """The function that splits a text into the words that a byte-level tokenizer encodes one by one; added tokens are words.

    `regex` splits; texts with code points that Python's Unicode tables lack, where its tables and the
    tokenizer's may differ, go to the tokenizer's own splitter. No vocabulary is loaded for either.
    """
    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    words = regex.compile(r""" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""").findall
    # the same for texts of LATIN characters alone, where ranges stand for the classes
    latin = re.compile(r""" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\sA-Za-z0-9\xc0-\xd6\xd8-\xf6\xf8-\xff]+|\s+(?!\S)|\s+""").findall
    whole = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
    known = set(LATIN)
    own = ByteLevel(add_prefix_space=False)

    def part(text: str) -> list[str]:
        used = set(text)
        if used <= LATIN:
            return latin(text)
        new = used - known
        if any(unicodedata.category(c) == "Cn" for c in new):
            return [text[a:b] for _, (a, b) in own.pre_tokenize_str(text)]
        known.update(new)
        return words(text)

    def split(text: str) -> list[str]:
        if whole is None or not whole.search(text):
            return part(text)
        return [w for i, p in enumerate(whole.split(text)) for w in ([p] if i % 2 else part(p)) if p]

    return split


def _chunks(rows: Iterator[pa.RecordBatch], added: tuple[str, ...]) -> Iterator[tuple[int, list, list[np.ndarray], _Words]]:
    """(chunk, ids of documents, their word numbers, words) of the texts of one partition, in order."""
    split = splitter(added)

    def fresh():
        return [], [], _Words(), hashlib.blake2b(digest_size=8), 0

    ids, codes, words, seen, size = fresh()
    for batch in rows:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            ids.append(doc)
            codes.append(np.fromiter(map(words.__getitem__, split(text)), np.uint32))
            seen.update(text.encode())
            seen.update(b"\xff")
            size += len(text) + 100
            if size >= CHUNK_CHARS:
                yield int.from_bytes(seen.digest(), "big", signed=True), ids, codes, words
                ids, codes, words, seen, size = fresh()
    if ids:
        yield int.from_bytes(seen.digest(), "big", signed=True), ids, codes, words


def _dealt(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word, and the order that lists the words by bucket."""
    own = np.fromiter(map(zlib.crc32, map(str.encode, words)), np.uint32, len(words)) % np.uint32(buckets)
    return own, np.argsort(own, kind="stable")


def bpe_encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids; one row for each row of docs: the ids of the whole text (null: empty) without special tokens added.

    Chunks of documents number their distinct words. The words of a chunk are dealt by hash to buckets, a packed
    row for each bucket; a bucket gathers the words of all chunks and encodes each distinct word once, and the
    ids of its words go back to each chunk, where they are joined by position. No word makes a hot key, as a chunk
    sends it once; texts are never shuffled, only their word numbers. The number of buckets grows with the root of
    the size of the text, so that both the words of a bucket and the rows stay few. Nothing is written between:
    docs is read twice, and a plan that gives other rows the second time fails. Files of tokenizers are read on
    the executors from `path`. doc_id may have any type that Arrow knows; rows that repeat a doc_id are encoded one
    by one; an empty table gives an empty one.
    """
    path = path or default_path()
    added, dtype = added_tokens(path), np.uint16 if _loaded(path).get_vocab_size() <= 1 << 16 else np.uint32
    tuned(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, int(16 * (chars / CHUNK_CHARS) ** 0.5))

    def numbers(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for chunk, ids, codes, words in _chunks(rows, added):
            place = np.empty(len(words), np.uint32)
            place[_dealt(list(words), buckets)[1]] = np.arange(len(words), dtype=np.uint32)
            for lo in range(0, len(ids), 500):
                packed = [pack.compress(place[c].tobytes()) for c in codes[lo : lo + 500]]
                n = len(packed)
                yield pa.record_batch([pa.array(np.full(n, chunk)), pa.array(np.full(n, buckets, np.int32)), pa.array(ids[lo : lo + 500], kind), pa.array(packed, pa.binary())], ["chunk", "bucket", "doc_id", "packed"])
            del ids, codes, words, place, packed  # not beside the next chunk

    def words_of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for chunk, _, codes, found in _chunks(rows, added):
            codes.clear()
            words = list(found)
            own, order = _dealt(words, buckets)
            edges = np.searchsorted(own[order], np.arange(buckets + 1)).tolist()
            full, packed = [], []
            for bucket, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if a < b:
                    some = [words[i] for i in order[a:b].tolist()]
                    full.append(bucket)
                    packed.append(pack.compress(np.array([b - a, *map(len, some)], np.uint32).tobytes() + "".join(some).encode()))
            yield pa.record_batch([pa.array(np.full(len(full), chunk)), pa.array(full, pa.int32()), pa.array(packed, pa.binary())], ["chunk", "bucket", "packed"])
            del codes, found, words, own, order, packed

    def encoded_words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, now, ids_of = _loaded(path), None, {}
        pack, unpack = zstandard.ZstdCompressor(level=3, write_content_size=True), zstandard.ZstdDecompressor()
        for batch in rows:
            packed = []
            for bucket, block in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket != now:
                    now, ids_of = bucket, {}
                raw = unpack.decompress(block)
                n = int.from_bytes(raw[:4], "little")
                text, ends = raw[4 * n + 4 :].decode(), np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64).tolist()
                words = [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                fresh = [w for w in words if w not in ids_of]
                for w, e in zip(fresh, tokenizer.encode_batch(fresh, add_special_tokens=False), strict=True):
                    ids_of[w] = np.array(e.ids, dtype).tobytes()
                found = [ids_of[w] for w in words]
                packed.append(pack.compress(np.array([n, *map(len, found)], np.uint32).tobytes() + b"".join(found)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.nulls(len(packed), kind), pa.array(packed, pa.binary())], ["chunk", "bucket", "doc_id", "packed"])

    def placed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _loaded.cache_clear()  # words are encoded by now, so this worker's vocabulary has had its use
        unpack, now, parts, flat, start, size = zstandard.ZstdDecompressor(), None, {}, None, None, None
        for batch in rows:
            docs_, flats, lengths, total = [], [], [], 0
            for chunk, bucket, doc, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk != now:
                    now, parts, flat = chunk, {}, None
                raw = unpack.decompress(packed)
                if bucket < buckets:  # chunks of the same texts are one: what both sent is the same
                    parts[bucket] = raw
                    continue
                if flat is None:  # the words of a chunk come before its texts, by bucket
                    counts = [int.from_bytes(p[:4], "little") for p in parts.values()]
                    size = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(p, np.uint32, n, 4) for p, n in zip(parts.values(), counts, strict=True))]).astype(np.int64) // np.dtype(dtype).itemsize
                    flat = np.frombuffer(b"".join(p[4 * n + 4 :] for p, n in zip(parts.values(), counts, strict=True)), dtype).astype(np.int32)
                    start, parts = np.cumsum(size) - size, {}
                codes = np.frombuffer(raw, np.uint32)
                if len(codes) and int(codes.max()) >= len(size):
                    raise RuntimeError("the words of a chunk are missing: docs gave other rows when read again")
                n = size[codes]
                steps = int(n.sum())
                flats.append(flat[np.repeat(start[codes] - np.cumsum(n) + n, n) + np.arange(steps)])
                lengths.append(steps)
                docs_.append(doc)
                total += steps
                if total > SLICE_IDS:
                    yield listed(docs_, flats, lengths)
                    docs_, flats, lengths, total = [], [], [], 0
            if docs_:
                yield listed(docs_, flats, lengths)

    def listed(docs_: list, flats: list, lengths: list) -> pa.RecordBatch:
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        return pa.record_batch([pa.array(docs_, kind), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flats), pa.int32()))], ["doc_id", "ids"])

    id_type = docs.schema["doc_id"].dataType
    kind = to_arrow_type(id_type)
    both = StructType().add("chunk", "long").add("bucket", "integer").add("doc_id", id_type).add("packed", "binary")
    table = docs.mapInArrow(trimmed(words_of), "chunk long, bucket int, packed binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(encoded_words), both)
    parts = docs.mapInArrow(trimmed(numbers), both).unionByName(table).repartition("chunk").sortWithinPartitions("chunk", "bucket")
    return parts.mapInArrow(trimmed(placed), StructType().add("doc_id", id_type).add("ids", ArrayType(IntegerType())))


def piece_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """id, piece (bytes) of a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in shown]
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}
    spec = json.load(open(path or default_path()))
    pieces = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
    return spark.createDataFrame([(i, bytes(of[c] for c in p) if all(c in of for c in p) else p.encode()) for p, i in pieces.items()], "id int, piece binary")


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, text: the pieces of the ids joined, bytes that are no UTF-8 replaced; special tokens are kept.

    The join of ids with pieces is on the map side: the piece table, as large as the vocabulary file and no
    larger, is broadcast, and each slice of a batch takes the pieces of all its ids at once. Null ids count as none.
    """
    spark = tuned(encoded.sparkSession)
    rows = sorted(piece_table(spark, path).collect())
    by_id: list[bytes] = [b""] * (rows[-1]["id"] + 1)
    for r in rows:
        by_id[r["id"]] = bytes(r["piece"])
    shared = spark.sparkContext.broadcast(by_id)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            at = batch.column(1).offsets.to_numpy()
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_IDS, "right")) - 1)
                part = batch.slice(first, last - first)
                lists = part.column(1)
                taken = pieces.take(lists.flatten())
                ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
                raw = taken.buffers()[2] if len(taken) else pa.py_buffer(b"")
                own = at[first : last + 1] - at[first]
                texts = [raw.slice(ends[a], ends[b] - ends[a]).to_pybytes().decode("utf-8", "replace") for a, b in zip(own[:-1], own[1:], strict=True)]
                yield pa.record_batch([part.column(0), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])
                first = last

    out = StructType().add("doc_id", encoded.schema["doc_id"].dataType).add("ids", ArrayType(IntegerType())).add("text", "string")
    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(trimmed(joined), out)


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(bpe_decode(bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
