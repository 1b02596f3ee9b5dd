"""Operator 13: how far the sources of each language diverge, and by which terms; counts come of sorted runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import scratch, stored, tuned
from tessera.llm.shingles import text_slices

#: Bytes of text as terms are split: letters lower-cased, what stands between terms a space, others as they are.
_SPLIT = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
#: Bytes of text that are counted at once, counts that a task holds before it emits them, and pairs of sources whose sums it holds.
SLICE_BYTES, HELD = 8_000_000, 1_000_000
_COUNTS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])


def _counted(lang: pa.Array, source: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.Table:
    """The counts of a slice of texts by (lang, term, source): how many of them have the term, and how often. The empty term counts the texts."""
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(_SPLIT[data]))
    lists = pc.ascii_split_whitespace(texts)
    terms = lists.flatten()
    full = pc.greater(pc.binary_length(terms), 0)
    doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())[full.to_numpy(zero_copy_only=False)]
    coded = terms.filter(full).dictionary_encode()
    size = max(len(coded.dictionary), 1)
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    once, n = np.unique(doc * size + coded.indices.to_numpy(), return_counts=True)
    own = group[once // size] * size + once % size
    order = np.argsort(own, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]])) if len(own) else np.zeros(0, np.int64)
    groups, texts_of = np.unique(group, return_counts=True)
    key = own[order][first]
    of, zero = np.concatenate([groups, key // size]), np.zeros(len(groups), np.int64)
    term = pa.concat_arrays([pa.array([""] * len(groups), pa.string()), coded.dictionary.take(pa.array(key % size)).cast(pa.string())])
    docs = np.concatenate([texts_of, np.diff(np.append(first, len(own)))])
    counts = np.concatenate([zero, np.add.reduceat(n[order], first)]) if len(first) else zero
    return pa.Table.from_arrays([langs.dictionary.take(pa.array(of // len(sources.dictionary))), term, sources.dictionary.take(pa.array(of % len(sources.dictionary))), pa.array(docs), pa.array(counts)], schema=_COUNTS)


def _partial_counts(docs: DataFrame) -> DataFrame:
    """lang, term, source, docs, n of the texts of a task, in a few parts, so that a term of every document leaves a task a few times and not once a document."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(2), SLICE_BYTES):
                n = len(offsets) - 1
                held.append(_counted(batch.column(0).slice(first, n), batch.column(1).slice(first, n), data, offsets))
                if sum(t.num_rows for t in held) > HELD:
                    yield from together(held)
                    held = []
        if held:
            yield from together(held)

    def together(held: list[pa.Table]) -> list[pa.RecordBatch]:
        if len(held) == 1:
            return held[0].to_batches()
        found = pa.concat_tables(held).group_by(["lang", "term", "source"]).aggregate([("docs", "sum"), ("n", "sum")])
        return pa.Table.from_arrays(found.columns, schema=_COUNTS).to_batches()

    return docs.select("lang", "source", "text").mapInArrow(made, "lang string, term string, source string, docs long, n long")


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row of a batch differs from the one before in any of the columns; the first does."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for c in columns:
        out[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) if n > 1 else False
    return out


def _scan_runs(rows: DataFrame) -> DataFrame:
    """Run-length scan over rows sorted by (lang, term, source): one row for each run, docs and n summed; runs go on across batches."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            first = np.flatnonzero(_starts(batch.columns[:3]))
            sums = [pa.array(np.add.reduceat(batch.column(i).to_numpy(), first)) for i in (3, 4)]
            runs = pa.record_batch([*batch.select([0, 1, 2]).take(pa.array(first)).columns, *sums], batch.schema.names)
            yield runs.slice(0, runs.num_rows - 1)
            held = runs.slice(runs.num_rows - 1)
        if held is not None:
            yield held

    sort = ["lang", "term", "source"]
    return rows.repartition(*sort).sortWithinPartitions(*sort).mapInArrow(made, rows.schema)


def _term_runs(rows: DataFrame, least_docs: int) -> DataFrame:
    """Run-length scan over rows sorted by (lang, term, source), a row for each source: those of terms in at least so many documents, with the lang's count of the term."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            first = np.flatnonzero(_starts(whole.columns[:2]))
            yield kept(whole.slice(0, int(first[-1])), first[:-1])
            held = [whole.slice(int(first[-1]))]
        if held:
            yield kept(held[0], np.zeros(1, np.int64))

    def kept(rows: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
        length = np.diff(np.append(first, rows.num_rows))
        docs, n = (np.repeat(np.add.reduceat(rows.column(i).to_numpy(), first), length) if len(first) else np.zeros(0, np.int64) for i in (3, 4))
        found = pa.record_batch([*rows.select([0, 1, 2, 4]).columns, pa.array(n)], ["lang", "term", "source", "n", "lang_n"])
        return found.filter(pa.array(docs >= least_docs))

    counted = rows.where("term <> ''").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return counted.mapInArrow(made, "lang string, term string, source string, n long, lang_n long")


def share(count: Column | str, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)), exactly; null where there are no terms."""
    c, below = (F.col(count) if isinstance(count, str) else count), total + 2 * terms
    return F.when(terms > 0, 1 + F.call_function("div", (c + 2).cast("decimal(22,0)") * F.lit(10**9).cast("decimal(10,0)"), below.cast("decimal(22,0)")))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares stay below 2^31, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(rows: DataFrame) -> DataFrame:
    """a, b, value: for groups a < b of a lang, what their common terms add to the sums that each has against the other's share of an absent term.

    rows: lang, term, g (the number of a group), p, none (the group's share of an absent term). The groups of a term are
    its run in the order (lang, term, g); a task sums by pair while it scans, so it emits a row for each pair and not
    for each term.
    """

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    def scanned(rows: pa.RecordBatch) -> pa.Table:
        """Whole runs: each row with the one `step` rows on, for all steps, where both are of one run."""
        run = np.cumsum(_starts(rows.columns[:2]))
        g, p, none = (rows.column(i).to_numpy() for i in (2, 3, 4))
        groups, code = np.unique(g, return_inverse=True)
        keys, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, int(np.bincount(run).max())):
            i = np.flatnonzero(run[step:] == run[:-step])
            j = i + step
            keys.append(code[i] * len(groups) + code[j])
            values.append(f(p[i], p[j]) - f(p[i], none[j]) - f(none[i], p[j]) + f(none[i], none[j]))
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at, np.concatenate(values))
        return pa.table({"a": groups[key // len(groups)], "b": groups[key % len(groups)], "value": total})

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run: list[pa.RecordBatch] = []
        sums: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*open_run, batch]).combine_chunks().to_batches()[0]
            last = int(np.flatnonzero(_starts(whole.columns[:2]))[-1])
            if last:
                sums.append(scanned(whole.slice(0, last)))
            open_run = [whole.slice(last)]
            if sum(t.num_rows for t in sums) > HELD:
                yield from together(sums)
                sums = []
        yield from together(sums + [scanned(r) for r in open_run])

    def together(sums: list[pa.Table]) -> list[pa.RecordBatch]:
        if not sums:
            return []
        found = pa.concat_tables(sums).group_by(["a", "b"]).aggregate([("value", "sum")])
        return pa.Table.from_arrays(found.columns, names=["a", "b", "value"]).to_batches()

    dealt = rows.repartition("lang", "term").sortWithinPartitions("lang", "term", "g")
    return dealt.mapInArrow(made, "a long, b long, value long").groupBy("a", "b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a lang differs from its others, and by which terms.

    Terms are runs of letters and non-ASCII characters, A-Z lower-cased; a lang keeps those of at least least_docs of
    its documents (rows). A group (lang, source), and a lang as a whole, gives a term the share
    p = 1 + floor(10^9 * (count + 2) / (N + 2 V)), N its occurrences of kept terms, V their number; p and q differ by
    floor((p - q)^2 / (p + q)). Part `pair` has every other source of the lang with the sum over all kept terms,
    part `term` the `top` terms that the group has more of than the lang; ranks go by value, then by item in UTF-8.
    All is exact. Null text, lang or source is ''. An empty table gives an empty one; other columns are not read.

    Tasks count their documents in sorted runs, so a frequent term is a row for each run of a task and not for each
    document. The runs are sorted by (lang, term, source) and scanned twice: once for the counts of each source, dealt
    by all three, once for document frequencies, dealt by lang and term. Sums over all terms need only the terms that
    a source has: those that two sources share are summed by pair within a task, those of one source by count, and the
    others are alike. The result, by its nature, has a row for each ordered pair of sources of a lang.
    """
    tuned(docs.sparkSession)
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to) for c, to in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    with scratch(docs.sparkSession) as own:
        counts = own.stored(_scan_runs(_partial_counts(docs.select(*text))))
        kept = own.stored(_term_runs(counts, least_docs))
        terms = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("has"))
        whole = kept.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("n").alias("lang_size"))
        groups = counts.where("term = ''").select("lang", "source").distinct().join(terms, ["lang", "source"], "left").join(whole, "lang", "left")
        groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "has", "v", "lang_size")])
        groups = own.stored(groups.withColumn("none", share(F.lit(0), F.col("size"), F.col("v"))).withColumn("g", F.monotonically_increasing_id()))
        rows = own.stored(kept.join(groups, ["lang", "source"]).select("lang", "term", "source", "g", share("n", F.col("size"), F.col("v")).alias("p"), "none", share("lang_n", F.col("lang_size"), F.col("v")).alias("q")))

        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        best = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

        common = _pair_sums(rows.select("lang", "term", "g", "p", "none"))
        x, y = groups.alias("x"), groups.alias("y")
        other = (F.col("x.lang") == F.col("y.lang")) & (F.col("x.g") != F.col("y.g"))
        empty = (F.col("x.v") - F.col("x.has") - F.col("y.has")) * divergence(F.col("x.none"), F.col("y.none"))
        absent = x.join(y, other).select(F.col("x.g").alias("a"), F.col("y.g").alias("b"), F.coalesce(empty, F.lit(0)).alias("value"))
        # the terms of a group against the share that an absent term has in another: by count, as equal counts have equal shares
        levels = rows.groupBy("lang", "g", "p").agg(F.count("*").alias("k")).alias("x")
        single = levels.join(y, other).select(F.col("x.g").alias("a"), F.col("y.g").alias("b"), (F.col("k") * divergence(F.col("p"), F.col("y.none"))).alias("value"))
        single = single.groupBy("a", "b").agg(F.sum("value").alias("value"))
        turned = common.unionByName(single).select(F.col("b").alias("a"), F.col("a").alias("b"), "value")
        total = absent.unionByName(common).unionByName(single).unionByName(turned).groupBy("a", "b").agg(F.sum("value").alias("value"))
        total = total.join(groups.select(F.col("g").alias("a"), "lang", "source"), "a").join(groups.select(F.col("g").alias("b"), F.col("source").alias("item")), "b")
        pair = total.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
        return stored(pair.unionByName(best))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SHARE = "1 + CAST(CAST(1000000000 AS HUGEINT) * ({c} + 2) // ({n} + 2 * v) AS BIGINT)"
OP13_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), t AS (
  SELECT lang, source, doc_id, unnest(ts) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS lang_c FROM t GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 10
), v AS (
  SELECT lang, count(*) AS v, sum(lang_c) AS lang_n FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL
), n AS (
  SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL
), p AS MATERIALIZED (
  SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, {_SHARE.format(c="coalesce(c.c, 0)", n="n")} AS p, {_SHARE.format(c="lang_c", n="lang_n")} AS q
  FROM n JOIN k ON k.lang = n.lang JOIN v ON v.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 10
"""
