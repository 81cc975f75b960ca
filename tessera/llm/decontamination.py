"""Benchmark passages in documents, found by spaced seeds.

A document is contaminated by an item if ``WINDOW`` of their tokens in a row agree in
all but ``SUBSTITUTIONS`` places. The masks ignore chosen places, so that any such
window has a mask and a place where every token the mask looks at agrees. Seeds of
all items and of all places of all documents are hashed and joined, and each hit
is verified by comparing the windows around it token by token.

Only the benchmark's seeds are broadcast, in blocks of at most ``BLOCK_SEEDS`` rows,
so a document meets them without a shuffle; what is shuffled are verified hits.
Documents are taken ``STRETCH`` places at a time and a hit keeps only the tokens that
its windows can hold, so what a task holds at once doesn't grow with the hits of a text.
Everything runs in built-in functions.

Tokens are runs of characters other than white space and ASCII punctuation, in lower
case. Items shorter than a window must occur whole: with up to ``substitutions`` of their length, found by
masks of every other token, those below ``LEAST_SPACED`` tokens unchanged, however short they are. A window lies within both texts.
Null and empty items and documents hold nothing. Rows that share an
id count as one document, rows with a null id too. An empty table on either side gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import unused, written
from tessera.sources.tables import table

WINDOW, SUBSTITUTIONS = 13, 2
#: Places that a mask looks at. Together they meet every window with two substitutions (tested for all).
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
#: Tokens from which an item shorter than a window may differ in one place.
LEAST_SPACED = 7
#: Seeds that are sent to every task at once.
BLOCK_SEEDS = 500_000
#: Places of a document that are taken at a time: generated code holds all hits of a row at once, each with a copy of what it keeps of the row.
STRETCH = 256
#: Else a column of a row group is read into as many buffers outside of the heap at once as it has pieces of 8 MB, which are kept.
READING = {"parquet.hadoop.vectored.io.enabled": "false"}
#: Characters between tokens.
SEPARATORS = "\t\n\x0b\x0c\r !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokens(text: Column) -> Column:
    """The tokens of a text."""
    spaced = F.translate(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, " " * len(SEPARATORS))
    return F.array_remove(F.split(spaced, " "), "")


def _stretches(docs: DataFrame) -> DataFrame:
    """(id, first, last, past, t): texts in stretches of places. ``t`` also has the ``WINDOW - 1`` tokens on either side, as far as there are any.

    Places ``first`` to ``last`` of ``t`` are the stretch's own; ``past`` tokens of the text precede ``t``.
    The function of each stretch keeps Spark from joining this step to the generated code that follows.
    """
    n, rim = F.size("t"), WINDOW - 1
    cut = lambda a: F.struct(
        F.least(a, F.lit(rim + 1)).alias("first"),
        (F.least(a, F.lit(rim + 1)) + F.least(F.lit(STRETCH), n - a + 1) - 1).alias("last"),
        F.greatest(a - rim - 1, F.lit(0)).alias("past"),
        F.slice("t", F.greatest(a - rim, F.lit(1)), F.least(a - 1, F.lit(rim)) + STRETCH + rim).alias("t"),
    )
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(STRETCH)))
    return docs.select("id", F.explode(F.transform(starts, cut)).alias("s")).select("id", "s.first", "s.last", "s.past", "s.t")


def _around(array: Column, place: Column, before: Column) -> Column:
    """The tokens of all windows around a seed at a place from 1; null beyond the ends."""
    return F.transform(F.sequence(place - 1 - before, place - 2 + WINDOW), lambda k: F.get(array, k.cast("int")))


def _seed(array: Column, place: Column, mask: tuple[int, ...], number: int) -> Column:
    return F.xxhash64(F.lit(number), *[F.element_at(array, (place + k).cast("int")) for k in mask])


def _places(array: Column, length: int) -> Column:
    """Places from 1 of stretches of this length; null, so no row on explosion, where there is none."""
    return F.when(F.size(array) >= length, F.sequence(F.lit(1), F.size(array) - (length - 1)))


def item_seeds(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(seed, item, before, around): the seeds of items of a window or more, each with the tokens of all windows around it."""
    own = items.select(F.col(id_col).alias("item"), tokens(F.col(text_col)).alias("t")).filter(F.size("t") >= WINDOW)
    out = []
    for number, mask in enumerate(MASKS):
        before = WINDOW - 1 - max(mask)
        at = own.select("item", "t", F.explode(_places(F.col("t"), max(mask) + 1)).alias("place"))
        out.append(at.select(_seed(F.col("t"), F.col("place"), mask, number).alias("seed"), "item", F.lit(before).alias("before"), _around(F.col("t"), F.col("place"), F.lit(before)).alias("around")))
    return reduce(DataFrame.unionByName, out)


def substitutions(length: int) -> int:
    """Places in which a passage of this many tokens may differ."""
    return SUBSTITUTIONS if length >= WINDOW else int(length >= LEAST_SPACED)


def short_masks(length: int) -> list[tuple[int, ...]]:
    """Masks of items of fewer tokens than a window: every other place and the rest, so one differing place leaves one of them whole."""
    return [tuple(range(length))] if not substitutions(length) else [tuple(range(0, length, 2)), tuple(range(1, length, 2))]


def _hits(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, item, equal, start): for each hit all windows around it that agree enough.

    Hits without such a window give a row of nulls: a condition here would move into the join, whose
    generated code then would have to copy a stretch's tokens for every place.
    """
    at = _stretches(docs).select("id", "past", "t", F.explode(F.sequence("first", "last")).alias("here"))
    every = [F.when(F.col("here") + max(mask) <= F.size("t"), _seed(F.col("t"), F.col("here"), mask, number)) for number, mask in enumerate(MASKS)]
    met = at.select("id", "past", "t", "here", F.explode(F.array(*every)).alias("seed")).join(F.broadcast(seeds), "seed")
    near, place = F.slice("t", F.greatest(F.col("here") - F.col("before"), F.lit(1)), F.col("before") + WINDOW), F.least("here", F.col("before") + 1)
    met = met.select("id", "item", "before", "around", (F.col("past") + F.col("here")).alias("here"), near.alias("near"), place.alias("place"))
    # A place beyond either text outweighs all others of its window.
    same = F.zip_with("around", _around(F.col("near"), F.col("place"), F.col("before")), lambda x, y: F.coalesce((x == y).cast("int"), F.lit(-WINDOW)))
    met = met.select("id", "item", "here", "before", same.alias("same"))
    equal = F.transform(F.sequence(F.lit(1), F.col("before") + 1), lambda s: F.aggregate(F.slice("same", s, WINDOW), F.lit(0), lambda n, x: n + x))
    met = met.select("id", "item", (F.col("here") - F.col("before")).alias("from"), equal.alias("sums"))
    windows = F.transform("sums", lambda n, k: F.struct(n.alias("equal"), (F.col("from") + k).cast("long").alias("start")))
    met = met.select("id", "item", F.explode_outer(F.filter(windows, lambda w: w["equal"] >= WINDOW - SUBSTITUTIONS)).alias("w"))
    return met.select("id", "item", "w.equal", "w.start")


def _short(docs: DataFrame, items: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """As ``_hits`` for whole items of fewer tokens than a window: the seeds of their lengths' masks, in one join; sent to every task where they are few."""
    own = items.select(F.col(id_col).alias("item"), tokens(F.col(text_col)).alias("want")).filter((F.size("want") > 0) & (F.size("want") < WINDOW))
    own = written(own.select("item", F.size("want").alias("n"), "want"))
    lengths = {r.n: r.times for r in own.groupBy("n").agg(F.count("*").alias("times")).collect()}
    if not lengths:
        return None
    kinds = [(n, number, mask) for n in sorted(lengths) for number, mask in enumerate(short_masks(n))]
    hashed = lambda array, place, n, number, mask: F.xxhash64(F.lit(n), F.lit(number), *[F.element_at(array, (place + k).cast("int")) for k in mask])
    seeds = reduce(DataFrame.unionByName, [own.filter(F.col("n") == n).select("item", "n", "want", hashed(F.col("want"), F.lit(1), n, number, mask).alias("seed")) for n, number, mask in kinds])
    at = _stretches(docs).select("id", "past", "t", F.explode(F.sequence("first", "last")).alias("here"))
    fits = F.array(*[F.when(F.col("here") + (n - 1) <= F.size("t"), hashed(F.col("t"), F.col("here"), n, number, mask)) for n, number, mask in kinds])
    few = sum(times * len(short_masks(n)) for n, times in lengths.items()) <= BLOCK_SEEDS
    kept = F.slice("t", F.col("here"), F.lit(max(lengths)))
    at = at.select("id", "past", "t" if few else kept.alias("t"), "here", F.explode(fits).alias("seed"))
    met = at.join(F.broadcast(seeds) if few else seeds, "seed")
    near = F.slice("t", F.col("here") if few else F.lit(1), F.col("n"))
    met = met.select("id", "item", "n", "want", (F.col("past") + F.col("here")).cast("long").alias("start"), near.alias("near"))
    same = F.zip_with("want", "near", lambda x, y: x.eqNullSafe(y))
    met = met.select("id", "item", "n", "start", F.size(F.filter(same, lambda x: x)).alias("equal"))
    return met.filter(F.col("equal") >= F.col("n") - F.when(F.col("n") >= LEAST_SPACED, 1).otherwise(0)).select("id", "item", "equal", "start")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, n_windows, most_equal, first_token) of each document and item with a common passage.

    ``n_windows`` counts all places of the document where a window starts that agrees enough with
    one of the item; tokens count from 1.
    """
    own = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    seeds = written(item_seeds(items, item_col, item_text))
    # All items at once where they are few; else in blocks, each over all documents.
    blocks = max(1, -(-seeds.count() // BLOCK_SEEDS))
    found = []
    for b in range(blocks):
        block = seeds if blocks == 1 else seeds.filter(F.pmod(F.xxhash64("seed", F.lit(1)), F.lit(blocks)) == b)
        found.append(_hits(own, block))
    short = _short(own, items, item_col, item_text)
    found += [] if short is None else [short]
    hits = reduce(DataFrame.unionByName, found)
    # A hot passage hits in many documents, and many times in each: places are counted per document first.
    places = hits.groupBy("id", "item", "start").agg(F.max("equal").alias("equal")).filter("equal IS NOT NULL")
    return places.groupBy("id", "item").agg(F.count("*").alias("n_windows"), F.max("equal").cast("long").alias("most_equal"), F.min("start").alias("first_token"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that share no passage with an item. Each row is judged by its own text, whatever its id and those of others."""
    # Equal texts are equally contaminated; two hashes of 64 bits stand for a text.
    own = F.struct(F.xxhash64(text_col).alias("a"), F.xxhash64(text_col, F.lit(1)).alias("b"))
    mark = unused(docs, "found")
    found = written(contaminated(docs.select(own.alias("row"), F.col(text_col).alias("text")), items, "row").select(F.col("id").alias(mark)).distinct())
    few = found.count() <= BLOCK_SEEDS
    return docs.join(F.broadcast(found) if few else found, own == F.col(mark), "left_anti")


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with passages of the benchmark: a row for each document and item."""
    found = contaminated(table(spark, folder, "documents", **READING), table(spark, folder, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_windows", "most_equal", "first_token")


QUERIES = {"op5_decontamination": op5_decontamination}
_SPACES = " " * len(SEPARATORS)
_MARKS = " || ".join(f"chr({ord(c)})" for c in SEPARATORS)


def _tokens_sql(id_col: str, name: str) -> str:
    return f"SELECT {id_col} AS {name}, list_filter(string_split(translate(lower(coalesce(text, '')), {_MARKS}, '{_SPACES}'), ' '), lambda x: x <> '') AS w"


#: A window that differs in two places has one of three parts unchanged, one that differs in one place one of two.
ORACLES = {
    "op5_decontamination": f"""
WITH d AS ({_tokens_sql("doc_id", "doc_id")}, row_number() OVER () AS doc_row FROM documents),
i AS ({_tokens_sql("item_id", "item_id")} FROM benchmark),
j AS (
  SELECT item_id, w, least(len(w), {WINDOW}) AS n,
         CASE WHEN len(w) >= {WINDOW} THEN {SUBSTITUTIONS} WHEN len(w) >= {LEAST_SPACED} THEN 1 ELSE 0 END AS s
  FROM i WHERE len(w) > 0
), v AS (
  SELECT item_id, n, s, w[b : b + n - 1] AS want, s + 1 AS k
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS b FROM j)
), parts AS (
  SELECT item_id, n, s, want, p * n // k AS o, (p + 1) * n // k - p * n // k AS l
  FROM (SELECT *, unnest(range(0, k)) AS p FROM v)
), seeds AS (
  SELECT *, array_to_string(want[o + 1 : o + l], ' ') AS piece FROM parts
), places AS (
  SELECT doc_id, doc_row, unnest(range(1, len(w) + 1)) AS q, w FROM d
), pieces AS (
  SELECT doc_id, doc_row, q, l, array_to_string(w[q : q + l - 1], ' ') AS piece
  FROM places JOIN (SELECT DISTINCT l FROM seeds) ON q + l - 1 <= len(w)
), met AS (
  SELECT DISTINCT doc_id, doc_row, item_id, q - o AS a, n, s, want FROM pieces JOIN seeds USING (l, piece)
), judged AS (
  SELECT met.doc_id, item_id, a, n - s AS enough, len(list_filter(range(0, n), lambda x: w[a + x] = want[x + 1])) AS equal
  FROM met JOIN d USING (doc_row) WHERE a >= 1 AND a + n - 1 <= len(w)
)
SELECT doc_id, item_id, count(DISTINCT a) AS n_windows, max(equal) AS most_equal, min(a) AS first_token
FROM judged WHERE equal >= enough GROUP BY doc_id, item_id
"""
}
