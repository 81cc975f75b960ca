"""How the sources of each language differ in their use of frequent terms, by iceberg prefix refinement.

A term is a run of letters and characters beyond ASCII; A-Z count as a-z. Of each language those terms
are kept that occur in at least ``LEAST`` of its documents. They are found by prefixes of bytes, level by
level, of which each level's are longer: a prefix that too few documents hold is
discarded with all terms behind it, so rare terms are never shuffled. A term ends with a mark that no term holds,
so a prefix with the mark is a complete term, and is kept once its level is reached.

A document counts once for a prefix however many of its terms begin with it: of the document's
terms in order, a term brings a new prefix at the levels beyond what it shares with the term before it. So a task sums
for each term how many of its documents have it new by each level, and a level adds up these numbers. The sums are
written once; each level reads those behind prefixes that are left after the last one.

The share of a term in a source or language is p = 1 + floor(``UNIT`` * (count + 5) / (N + 5 V)), with N
the count of all V kept terms there. Sources of a language are compared in tiles of about ``TILE`` sources: a row holds
one term's shares in a tile, pairs of tiles meet by term, and a task adds up their differences.

Null text, language and source count as empty. Texts of any length are taken whole. Rows that repeat, or share
or lack an id, are documents of their own. A language without kept terms has differences of 0. Equal values rank by
UTF-8. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import textarrays as ta
from tessera.llm.jaccard_join import BROADCAST_ROWS
from tessera.llm.shared import remove, saved, shared_folder, written
from tessera.sources.tables import table

#: Documents of a language in which a kept term occurs.
LEAST = 30
#: Shares are in billionths, counts are raised by 5; the most telling terms are reported to this rank.
UNIT, RAISE, TOP = 1_000_000_000, 5, 50
#: Sources of a tile, about.
TILE = 48
#: Rows of sums that a task holds before it adds them up, and text bytes handled at a time.
HELD, SLICE = 1_500_000, 4 << 20

#: Bytes that are no part of a term become spaces, A-Z become a-z.
_LETTER = np.array([x if x >= 128 or chr(x).islower() else x + 32 if chr(x).isupper() else 32 for x in range(256)], np.uint8)
END = b"\x00"


def level(n: int) -> int:
    """Bytes of a prefix of level ``n``."""
    size = 2
    for _ in range(n):
        size = size + 2 if size < 8 else size * 3 // 2
    return size


def first_level(shared: np.ndarray) -> np.ndarray:
    """The first level whose prefixes are longer than ``shared`` bytes."""
    sizes = [level(0)]
    while sizes[-1] <= shared.max(initial=0):
        sizes.append(level(len(sizes)))
    return np.searchsorted(np.array(sizes), shared, "right")


def common_prefix(data: np.ndarray, at: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that strings a and b have in common at their start; ``at`` and ``size`` are of each string."""
    out, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
    most = np.minimum(size[a], size[b])
    x, y = at[a], at[b]
    k = 0
    while len(open_):
        open_ = open_[most[open_] > k]
        open_ = open_[data[x[open_] + k] == data[y[open_] + k]]
        k += 1
        out[open_] = k
    return out


def terms(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms in order, with END; then, for each text and each of its terms: text, term, first new level, count)."""
    data, ends = ta.raw(text)
    clean = pa.Array.from_buffers(pa.string(), len(text), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(_LETTER[data])])
    ids, distinct, offsets = ta.words(clean)
    distinct = distinct.cast(pa.binary())
    order = pc.sort_indices(distinct).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    distinct = distinct.take(pa.array(order))
    pairs, count = np.unique(ta.owner(offsets) * max(1, len(distinct)) + rank[ids], return_counts=True)
    of, term = np.divmod(pairs, max(1, len(distinct)))
    raw, at = ta.raw(distinct)
    shared = np.zeros(len(pairs), np.int64)
    later = np.flatnonzero(of[1:] == of[:-1]) + 1
    shared[later] = common_prefix(raw, at[:-1], np.diff(at), term[later - 1], term[later])
    return distinct, of, term, first_level(shared), count


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, docs, counts) summed over the documents at hand.

    ``docs`` has for each level how many documents the term brings a new prefix there or at an earlier
    one; the last number holds for all later levels. ``counts`` has the term's count in each source.
    """

    def added(parts: list[pa.Table], value: str) -> pa.Table:
        names = [c for c in parts[0].column_names if c != value]
        every = pa.concat_tables(parts).group_by(names).aggregate([(value, "sum")])
        return every.rename_columns([c.removesuffix("_sum") for c in every.column_names])

    def given(new: pa.Table, count: pa.Table) -> Iterator[pa.RecordBatch]:
        order = [("lang", "ascending"), ("term", "ascending")]
        lists = lambda t, *of: t.group_by(["lang", "term"]).aggregate([(c, "list") for c in of]).sort_by(order).combine_chunks()
        new, count = lists(new, "level", "docs"), lists(count, "source", "count")
        if not new.num_rows:
            return
        levels, docs, sources, counts = (t[f"{c}_list"].combine_chunks() for t, c in ((new, "level"), (new, "docs"), (count, "source"), (count, "count")))
        own = ta.owner(levels.offsets.to_numpy())
        at = levels.flatten().to_numpy()
        size = np.zeros(len(levels), np.int64)
        np.maximum.at(size, own, at + 1)
        offsets = np.concatenate([[0], np.cumsum(size)])
        flat = np.zeros(offsets[-1], np.int64)
        np.add.at(flat, offsets[own] + at, docs.flatten().to_numpy())
        until = np.concatenate([[0], np.cumsum(flat)])
        flat = until[1:] - np.repeat(until[offsets[:-1]], size)
        by_source = pa.StructArray.from_arrays([sources.flatten(), counts.flatten()], names=["source", "count"])
        table = pa.table({
            "lang": new["lang"],
            "term": pc.binary_join_element_wise(new["term"], pa.scalar(b""), pa.scalar(END)),
            "docs": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)),
            "counts": pa.ListArray.from_arrays(sources.offsets, by_source),
        })
        yield from table.to_batches(max_chunksize=50_000)

    new_parts: list[pa.Table] = []
    count_parts: list[pa.Table] = []
    for part, text in ta.slices(batches, "text", SLICE):
        distinct, of, term, new, count = terms(text)
        langs, lang = _coded(part["lang"])
        groups, group = _coded(pa.StructArray.from_arrays([part["lang"], part["source"]], names=["lang", "source"]))
        width, levels = max(1, len(distinct)), int(new.max(initial=0)) + 1
        # Numbers are added up before terms are made strings again.
        unique, docs = np.unique((lang[of] * width + term) * levels + new, return_counts=True)
        rest = unique // levels
        new_parts.append(pa.table([langs.take(pa.array(rest // width)), distinct.take(pa.array(rest % width)), pa.array(unique % levels), pa.array(docs)], names=["lang", "term", "level", "docs"]))
        unique, inverse = np.unique(group[of] * width + term, return_inverse=True)
        total = np.zeros(len(unique), np.int64)
        np.add.at(total, inverse, count)
        chosen = groups.take(pa.array(unique // width))
        count_parts.append(pa.table([chosen.field("lang"), chosen.field("source"), distinct.take(pa.array(unique % width)), pa.array(total)], names=["lang", "source", "term", "count"]))
        if sum(p.num_rows for p in count_parts) > HELD:
            new_parts, count_parts = [added(new_parts, "docs")], [added(count_parts, "count")]
            if count_parts[0].num_rows > HELD // 2:
                yield from given(new_parts[0], count_parts[0])
                new_parts, count_parts = [], []
    if count_parts:
        yield from given(added(new_parts, "docs"), added(count_parts, "count"))


def _coded(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the distinct values, place of each value among them)."""
    places: dict = {}
    at = np.fromiter((places.setdefault(tuple(v.values()) if isinstance(v, dict) else v, len(places)) for v in values.to_pylist()), np.int64, len(values))
    first = np.full(len(places), len(values))
    np.minimum.at(first, at, np.arange(len(values)))
    return values.take(pa.array(first)), at


def _side(df: DataFrame) -> DataFrame:
    """A small table goes to every task; others are shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def kept_terms(sums: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term) of the complete terms that at least ``least`` documents of their language hold."""
    spark, found, base, n, old, size = sums.sparkSession, None, sums.select("lang", "term", "docs"), 0, None, sums.count()
    left = base
    while True:
        prefix = F.substring("term", 1, level(n)).alias("prefix")
        docs = F.element_at("docs", F.least(F.lit(n + 1), F.size("docs")))
        counted = left.groupBy("lang", prefix).agg(F.sum(docs).alias("docs"), F.count("*").alias("rows"))
        held = written(counted.filter(F.col("docs") >= least).select("lang", "prefix", "rows"))
        complete = F.substring("prefix", F.length("prefix"), F.lit(1)) == F.lit(END)
        done = held.filter(complete).select("lang", F.col("prefix").alias("term"))
        found = done if found is None else found.unionByName(done)
        more = held.filter(~complete)
        rows = more.agg(F.sum("rows")).head()[0]
        if rows is None:
            break
        # Terms behind discarded prefixes go, and so do complete ones.
        left = base.withColumn("prefix", prefix).join(_side(more.drop("rows")), ["lang", "prefix"], "left_semi").drop("prefix")
        if 2 * rows < size:  # few are left: later levels read only those
            path = shared_folder(spark)
            base = left = saved(left, path)
            if old:
                remove(spark, old)
            old, size = path, rows
        n += 1
    return written(found)


def _tile_differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over terms of the differences between each source of tile a and each of tile b."""
    sums: dict[tuple, np.ndarray] = {}
    for batch in batches:
        key = batch.select(["lang", "a", "b"]).to_pylist()
        x, y = batch["xs"].to_pylist(), batch["ys"].to_pylist()
        rows: dict[tuple, list[int]] = {}
        for i, k in enumerate(key):
            rows.setdefault((k["lang"], k["a"], k["b"]), []).append(i)
        for k, at in rows.items():
            p, q = np.array([x[i] for i in at], np.int64), np.array([y[i] for i in at], np.int64)
            total = np.stack([np.abs(p[:, [i]] - q).sum(axis=0) for i in range(p.shape[1])])
            sums[k] = sums[k] + total if k in sums else total
        if len(sums) > 512:
            yield from _given(sums)
            sums = {}
    yield from _given(sums)


def _given(sums: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (lang, a, b), total in sums.items():
        i, j = (v.reshape(-1) for v in np.indices(total.shape))
        n = total.size
        yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([a] * n), pa.array([b] * n), pa.array(i), pa.array(j), pa.array(total.reshape(-1))], names=["lang", "a", "b", "i", "j", "value"])


def _share(count: Column, n: Column, v: Column) -> Column:
    """In decimals, so that counts of any size are exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", (F.lit(UNIT).cast("decimal(10,0)") * (wide(count) + RAISE)).cast("decimal(38,0)"), (wide(n) + wide(v) * RAISE).cast("decimal(38,0)"))).cast("long")


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): the differences between sources, and each source's most telling terms."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    sums = written(docs.mapInArrow(_sums, "lang string, term binary, docs array<long>, counts array<struct<source: string, count: long>>"))
    kept = kept_terms(sums, least)
    used = sums.select("lang", "term", "counts").join(_side(kept), ["lang", "term"], "left_semi").select("lang", "term", F.inline("counts"))
    counts = written(used.groupBy("lang", "source", "term").agg(F.sum("count").alias("count")))
    size = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = docs.select("lang", "source").distinct()
    groups = groups.join(counts.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left").join(size, "lang", "left").fillna(0)
    dealt = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    groups = groups.join(dealt, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")))
    groups = written(groups.withColumn("slot", F.row_number().over(Window.partitionBy("lang", "tile").orderBy("source")) - 1))

    shares = counts.join(_side(groups), ["lang", "source"]).withColumn("p", _share(F.col("count"), F.col("n"), F.col("v")))
    shares = written(shares.select("lang", "source", "term", "count", "p", "tile", "slot", "v"))
    every = counts.groupBy("lang", "term").agg(F.sum("count").alias("all"))
    total = counts.groupBy("lang").agg(F.sum("count").alias("n")).join(size, "lang")
    usual = written(every.join(_side(total), "lang").select("lang", "term", _share(F.col("all"), F.col("n"), F.col("v")).alias("q")))
    telling = shares.join(_side(usual), ["lang", "term"]).filter("p > q")
    item = F.expr(f"decode(substring(term, 1, length(term) - {len(END)}), 'UTF-8')")
    telling = telling.select("lang", "source", F.lit("term").alias("part"), item.alias("item"), (F.col("p") - F.col("q")).alias("value"))

    # Of each tile: its sources in order, and their shares of a term that they lack.
    lacking = F.when(F.col("v") > 0, _share(F.lit(0), F.col("n"), F.col("v"))).otherwise(0)
    tiles = groups.groupBy("lang", "tile").agg(F.sort_array(F.collect_list(F.struct("slot", lacking.alias("p"))))["p"].alias("base"))
    tiles = written(tiles)
    dense = kept.join(_side(tiles), "lang")
    known = shares.groupBy("lang", "tile", "term").agg(F.map_from_entries(F.collect_list(F.struct("slot", "p"))).alias("known"))
    dense = dense.join(known, ["lang", "tile", "term"], "left")
    fill = F.when(F.col("known").isNull(), F.col("base")).otherwise(F.transform("base", lambda p, i: F.coalesce(F.element_at("known", i), p)))
    dense = written(dense.select("lang", "term", "tile", fill.alias("ps")))
    one, other = (dense.select("lang", "term", F.col("tile").alias(t), F.col("ps").alias(p)) for t, p in (("a", "xs"), ("b", "ys")))
    met = one.join(other, ["lang", "term"]).filter("a <= b").select("lang", "a", "b", "xs", "ys")
    apart = met.mapInArrow(_tile_differences, "lang string, a long, b long, i long, j long, value long").groupBy("lang", "a", "b", "i", "j").agg(F.sum("value").alias("value"))
    apart = written(apart)
    apart = apart.unionByName(apart.filter("a < b").select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    own = groups.select("lang", "source", F.col("tile").alias("a"), F.col("slot").alias("i"))
    its = groups.select("lang", F.col("source").alias("item"), F.col("tile").alias("b"), F.col("slot").alias("j"))
    pairs = own.join(its, "lang").filter("source <> item").join(apart, ["lang", "a", "b", "i", "j"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(telling.withColumn("rank", rank).filter(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """The audit of all documents."""
    return divergence(table(spark, folder, "documents"))


QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLES = {
    "op13_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), o AS (
  SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL
), k AS (
  SELECT lang, term FROM o GROUP BY lang, term HAVING count(*) >= 30
), v AS (
  SELECT lang, count(*) AS v FROM k GROUP BY lang
), c AS (
  SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term
), g AS (
  SELECT lang, source, coalesce(s, 0) AS s, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS s FROM c GROUP BY lang, source) USING (lang, source) LEFT JOIN v USING (lang)
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.s + 5 * g.v) AS p
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), q AS (
  SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)) // (any_value(t.s) + 5 * any_value(t.v)) AS q
  FROM c JOIN (SELECT lang, sum(n) AS s, any_value(v) AS v FROM c JOIN v USING (lang) GROUP BY lang) t USING (lang) GROUP BY lang, term
), f AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3) x
    ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, CAST(p.p - q.q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM f QUALIFY part = 'pair' OR rank <= 50
"""
}
