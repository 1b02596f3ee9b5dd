"""Operator 10: exact set-similarity components by a grouped prefix join on word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import components, scratch, Scratch, stored, trimmed
from tessera.llm.shingles import digest, shingle_sets

#: A shingle in fewer prefixes is never common; COMMON_MOST bounds how many common shingles there can be.
COMMON_LEAST, COMMON_MOST = 32, 1 << 19
#: Rows of a side that may be broadcast (40 bytes each), members that one copy of a hub's set is held against, and bits of a bitmap.
SMALL_SIDE, HUB_MEMBERS, LEAST_BITS, MOST_BITS = 500_000, 500, 256, 1 << 15
#: How many places back, by size, stand the postings that a posting is held against first.
NEIGHBOURS = (1, 2, 4, 8, 16, 32)
#: Columns that hold a bitmap of LEAST_BITS as longs.
SMALL_BITMAP = ("m0", "m1", "m2", "m3")
LOW48 = np.uint64((1 << 48) - 1)


def _prefix_length(n: int, percent: int) -> int:
    """Two sets of sizes n and m with 100 * inter >= percent * union share one of the first so many elements, in any common order."""
    return n - -(-n * percent // 100) + 1


def parity_bitmap(own: np.ndarray) -> bytes:
    """For each place whether an odd number of the elements fall on it; as many places as the set has elements, rounded up to a power of two."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (len(own) - 1).bit_length())) if len(own) else LEAST_BITS
    return np.packbits((np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes) -> np.ndarray:
    """A bitmap at LEAST_BITS, as longs."""
    x = np.frombuffer(bits, np.int64)
    while len(x) > len(SMALL_BITMAP):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound on the number of elements that only one of two sets has, from their bitmaps: where parities differ one such element falls at least."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _common(docs: DataFrame, k: int, percent: int, own: Scratch) -> np.ndarray:
    """Shingles (their low 48 bits) that many prefixes hold, counted over all documents.

    The threshold grows with the total so that at most COMMON_MOST can pass it: the result is of bounded size.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [own[: 2 * _prefix_length(len(own), percent) + 4] & LOW48 for own in shingle_sets(batch.column(0), k) if len(own)]
            token, n = np.unique(np.concatenate(low), return_counts=True) if low else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.record_batch([pa.array(token.astype(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    counts = own.stored(docs.select("text").mapInArrow(trimmed(counted), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_LEAST))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") >= max(COMMON_LEAST, -(-total // COMMON_MOST))).select("token").toArrow().column(0)
    own.drop(counts)
    return np.sort(found.to_numpy().astype(np.uint64))


def _prefixes(docs: DataFrame, k: int, percent: int, common: np.ndarray) -> DataFrame:
    """doc_id, n, f (digest of the set), g (digest of prefix and size), bits (parity bitmap), prefix (common shingles last), rare (how many are not common)."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in batches:
            n, f, g, bits, prefix, rare = [], [], [], [], [], []
            for own in shingle_sets(batch.column(1), k):
                p = _prefix_length(len(own), percent)
                if len(hot) and len(own):
                    low = own & LOW48
                    at = np.searchsorted(hot, low)
                    is_hot = hot[np.minimum(at, len(hot) - 1)] == low
                    cold = own[~is_hot][:p]
                    first = np.concatenate([cold, own[is_hot][: p - len(cold)]]) if len(cold) < p else cold
                else:
                    cold = first = own[:p]
                n.append(len(own))
                rare.append(len(cold))
                f.append(digest(own.tobytes()))
                g.append(digest(first.tobytes(), len(own).to_bytes(8, "little")))
                bits.append(parity_bitmap(own))
                prefix.append(first.astype(np.int64))
            small = np.stack([folded(b) for b in bits]) if bits else np.zeros((0, len(SMALL_BITMAP)), np.int64)
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(f, pa.binary()), pa.array(g, pa.binary()), pa.array(bits, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(rare, pa.int32()), *(pa.array(c) for c in small.T.copy())],
                ["doc_id", "n", "f", "g", "bits", "prefix", "rare", *SMALL_BITMAP],
            )

    return docs.select("doc_id", "text").mapInArrow(trimmed(made), f"doc_id long, n long, f binary, g binary, bits binary, prefix array<long>, rare int, {', '.join(f'{c} long' for c in SMALL_BITMAP)}")


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose bitmaps leave the similarity possible; none that is alike is lost."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for n, m, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                # 100 * inter >= percent * union, with union + inter = n + m and union - inter = the difference
                most = (100 - percent) * (n + m) // (100 + percent)
                good.append(least_difference(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) <= most)
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    x, y = (classes.select(F.col("u").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(trimmed(kept), "a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, percent: int, own: Scratch) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are alike.

    a is the hub: its set is held against those of all its b, which come as a stream. A hub of many pairs is
    repeated for blocks of them. Texts are read where they lie if few ids are asked for; else both sides are shuffled.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.tobytes() for x in shingle_sets(batch.column(0), k)]
            keep = [i for i, (x, w) in enumerate(zip(raw, batch.column(1).to_pylist(), strict=True)) if digest(x) == w]
            rest = pa.record_batch(batch.columns[2:], ["hub", "block", "u"])
            for lo in range(0, len(keep), 200):
                part = rest.take(pa.array(keep[lo : lo + 200]))
                yield pa.record_batch([*part.columns, pa.array([raw[j] for j in keep[lo : lo + 200]], pa.binary())], ["hub", "block", "u", "own"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for hub, u, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                if hub == u:
                    now, held = hub, x.copy()
                    continue
                if hub != now:
                    raise RuntimeError("the set of a hub is missing: docs gave other rows when read again")
                both = np.concatenate([held, x])
                both.sort(kind="stable")
                inter = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * inter >= percent * (len(both) - inter):
                    a.append(hub)
                    b.append(u)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_MEMBERS).cast("int").alias("blocks"))
    member = pairs.join(sizes, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.col("b").alias("u"))
    hub = sizes.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("a").alias("u"))
    wanted = own.stored(member.unionByName(hub).join(classes.select("u", "doc_id", "f"), "u"))
    small = F.broadcast(wanted) if wanted.count() <= SMALL_SIDE else wanted
    rows = docs.join(small, "doc_id").select("text", "f", "hub", "block", "u").mapInArrow(trimmed(sets), "hub long, block int, u long, own binary")
    dealt = rows.repartition("hub", "block").sortWithinPartitions("hub", "block", F.col("hub") != F.col("u"))
    found = own.stored(dealt.mapInArrow(trimmed(alike), "a long, b long"))
    own.drop(wanted)
    return found


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id; one row for each row of docs.

    Two documents link when 100 * |intersection| >= percent * |union| of their distinct k-word shingles (A-Z
    lower-cased; a text of fewer words counts as one shingle, a text without words or null as the empty set,
    which links with nothing). component_id is the smallest doc_id reachable. Rows repeating a doc_id are one
    document; a row without a doc_id has no component. An empty table gives an empty one.

    Equal sets are a class. Shingles are ordered with common ones last, else by hash; classes with one prefix and
    size are a group. Group postings meet on prefix shingles under the size and position filters, first each with
    a few of like size alone (not all pairs; common shingles are salted). Bitmaps drop pairs that cannot be alike,
    and the others are verified on the whole sets. Then the groups that still meet in different components are
    expanded to their members, and what the bitmaps leave of these pairs is verified too, so no link is lost.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with scratch(docs.sparkSession) as own:
        return _components(docs, k, percent, own)


def _components(docs: DataFrame, k: int, percent: int, own: Scratch) -> DataFrame:
    common = _common(docs, k, percent, own)
    full = own.stored(_prefixes(docs, k, percent, common).withColumn("u", F.monotonically_increasing_id()))
    known = full.where("n > 0 AND doc_id IS NOT NULL")
    unique = not known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").head(1)
    # u, the number of one of its rows, names a class; low is its smallest doc_id
    reps = own.stored(known.groupBy("f", "g").agg(F.min("u").alias("u"), F.min("doc_id").alias("low")))
    heads = own.stored(reps.groupBy("g").agg(F.min("u").alias("head"), (F.count("*") > 1).alias("multi")))
    grouped = reps.join(heads, "g").select("u", "low", "head", "multi")
    classes = own.stored(known.join(grouped, "u").select("u", "low", "head", "multi", "doc_id", "f", "n", "rare", "bits", "prefix", *SMALL_BITMAP))
    all_docs = own.stored(full.select("doc_id", "n", "f"))
    own.drop(full, heads)

    postings = classes.where("u = head").select("u", "n", "rare", "multi", F.posexplode("prefix").alias("pos", "token"))
    postings = postings.select("token", "u", "n", "pos", "multi", F.when(F.col("pos") >= F.col("rare"), F.pmod(F.xxhash64("token", "u"), F.lit(64)).cast("int")).otherwise(-1).alias("salt"))
    # of one size, another order for each shingle: so a document has neighbours of all kinds
    run = Window.partitionBy("token", "salt").orderBy("n", F.xxhash64("u", "token"), "u")
    many = (F.col("salt") >= 0) | F.col("multi") | F.lag("u").over(run).isNotNull() | F.lead("u").over(run).isNotNull()
    before = [F.lag(F.struct("u", "n", "pos"), back).over(run) for back in NEIGHBOURS]
    met = own.stored(postings.select("token", "u", "n", "pos", many.alias("many"), F.array(*before).alias("before")).where("many").drop("many"))

    def near(n, m, i, j):
        """The sizes allow the similarity, and so does what follows the shingle, taken as the first that both share."""
        need = F.ceil((n + m) * percent / (100 + percent))
        return (n * 100 >= m * percent) & (m * 100 >= n * percent) & (F.least(n - i, m - j) >= need)

    star = met.select("u", "n", "pos", F.explode("before").alias("v")).where(near(F.col("n"), F.col("v.n"), F.col("pos"), F.col("v.pos"))).select(F.col("u").alias("a"), F.col("v.u").alias("b"))
    inside = classes.where("u <> head").select(F.col("u").alias("a"), F.col("head").alias("b"))
    pairs = own.stored(star.unionByName(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    open_pairs = own.stored(_possible(pairs, classes, percent))
    own.drop(pairs)
    links = _verified(docs, open_pairs, classes, k, percent, own)
    if not unique:  # classes of rows that repeat a doc_id hang together through it
        row = all_docs.where("n > 0 AND doc_id IS NOT NULL").join(reps.select("f", "u"), "f").select("doc_id", "u").distinct()
        same = row.join(row.groupBy("doc_id").agg(F.min("u").alias("b")), "doc_id").select(F.col("u").alias("a"), "b")
        links = own.stored(links.unionByName(same))
    first = own.stored(components(links))
    compound = classes.select("u", "low", "head", "n", "f", *SMALL_BITMAP).join(first.select(F.col("node").alias("u"), "component"), "u", "left")
    compound = own.stored(compound.select("u", "low", "head", "n", "f", *SMALL_BITMAP, F.coalesce("component", "u").alias("comp")))

    member = own.stored(met.select("token", F.col("u").alias("head"), "pos").join(compound.select("u", "head", "n", "comp", *SMALL_BITMAP), "head"))
    own.drop(met)
    # most shingles are met in one component alone
    apart = own.stored(member.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token"))
    # a little wider than the ratio, so that rounding moves no size two bands away
    band = F.floor(F.log("n") / (log(100 / percent) * (1 + 1e-9))) if percent < 100 else F.col("n")
    member = member.join(apart, "token").withColumn("band", band)
    # sizes that allow the similarity lie in one band or in two that touch; x is not the larger
    x, y = member.alias("x"), member.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1))).alias("y")
    same_place = (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.comp") != F.col("y.comp"))
    order = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.u") < F.col("y.u")))
    once = (F.col("x.head") != F.col("y.head")) | (F.col("x.pos") == 0)
    differ = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in SMALL_BITMAP), F.lit(0))
    alike = differ * (100 + percent) <= (100 - percent) * (F.col("x.n") + F.col("y.n"))
    rest = x.join(y, same_place & order & once & alike & near(F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos"))).select(F.least("x.u", "y.u").alias("a"), F.greatest("x.u", "y.u").alias("b")).distinct()
    rest = own.stored(_possible(own.stored(rest), classes, percent))
    more = _verified(docs, rest, classes, k, percent, own)

    last = own.stored(components(more.unionByName(first.select(F.col("node").alias("a"), F.col("component").alias("b")))))
    final = compound.join(last.select(F.col("node").alias("u"), "component"), "u", "left").select("f", "low", F.coalesce("component", "u").alias("comp"))
    lowest = own.stored(final.groupBy("comp").agg(F.min("low").alias("component_id")))
    final = own.stored(final.join(lowest, "comp").select("f", "component_id"))
    return stored(all_docs.join(final, (all_docs["f"] == final["f"]) & all_docs["doc_id"].isNotNull(), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def near_duplicates_removed(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that hang together with one of a smaller doc_id; rows without a doc_id stay."""
    found = ngram_components(docs, k, percent)
    return docs.join(found.where("component_id <> doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS sh FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
  UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) IN (1, 2)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS MATERIALIZED (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)
), r AS (
  SELECT doc_id, doc_id AS c FROM documents
  UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id
)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
