"""Variable-capacity best-fit packing of texts into training sequences.

Bins have several permitted capacities. Texts longer than the largest are cut
into pieces of that size and a rest, so no token is lost. What best-fit decreasing
decides depends only on how many pieces there are of each length, so it runs on
that histogram, which the largest capacity bounds whatever the number of texts:
a step places pieces of one length into a range of like bins. Each policy of
opening bins is tried on the whole histogram, the cheapest after downsizing wins,
and a join carries its placements to the pieces.

Pieces of one length are interchangeable, so they get ranks: salted groups are
numbered in parallel and shifted by the counts before them, which keeps a length
that a third of all texts share off a single task.

Null and empty texts have length 0 and get one row without a bin. Repeated rows
are packed separately. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.shared import written
from tessera.sources.tables import table

CAPACITIES = (512, 1024, 2048, 4096)
#: What a bin costs beside its capacity, in tokens.
BIN_OVERHEAD = 16
#: Groups into which the pieces of a length are dealt for numbering.
SALTS = 64

PLACEMENT = T.StructType([T.StructField(x, T.LongType()) for x in ("length", "rank_from", "rank_to", "per_bin", "first_bin", "at")])


def best_fit(histogram: Sequence[tuple[int, int]], opens) -> tuple[list[tuple[int, ...]], list[tuple[int, int, int]]]:
    """Best-fit decreasing over (length, count) pairs.

    ``opens(length)`` is the capacity of a bin that is opened for a piece of that
    length. Returns placements (length, rank from, rank to, pieces per bin, first
    bin, offset in the bin) and bins (first, number, tokens used). Like pieces go
    into like bins together: a bin takes as many pieces of the length as fit
    before the next is touched, as piece-wise best fit does.
    """
    room: list[int] = []  # the distinct free spaces of open bins, ascending
    open_: dict[int, list[tuple[int, int, int]]] = {}  # free space: [(first bin, number, used)]
    placed, bins, made = [], [], 0

    def put(free: int, group: tuple[int, int, int]) -> None:
        if free not in open_:
            insort(room, free)
        open_.setdefault(free, []).append(group)

    for length, count in sorted(histogram, reverse=True):
        rank = 0
        while rank < count:
            k = bisect_left(room, length)
            if k < len(room):
                free = room[k]
                first, number, used = open_[free].pop()
                if not open_[free]:
                    del open_[free], room[k]
            else:
                free = opens(length)
                first, number, used = made, -(-(count - rank) // (free // length)), 0
                made += number
            fits = free // length
            whole = min(number, (count - rank) // fits)
            if whole:
                placed.append((length, rank, rank + whole * fits, fits, first, used))
                put(free - fits * length, (first, whole, used + fits * length))
                rank += whole * fits
            if whole < number and rank < count:  # fewer pieces are left than the next bin could take
                rest = count - rank
                placed.append((length, rank, count, rest, first + whole, used))
                put(free - rest * length, (first + whole, 1, used + rest * length))
                rank, whole = count, whole + 1
            if whole < number:
                put(free, (first + whole, number - whole, used))
    for groups in open_.values():
        bins += groups
    return placed, bins


def downsized(used: int, capacities: Sequence[int]) -> int:
    """The smallest capacity that holds ``used`` tokens."""
    return min(c for c in capacities if c >= used)


def plan(histogram: Sequence[tuple[int, int]], capacities: Sequence[int], overhead: int) -> tuple[list[tuple[int, ...]], int]:
    """Placements of the cheapest policy and its cost.

    A policy is a least capacity to open: a piece opens the smallest capacity that
    holds it and isn't below that. One more opens the size whose tokens, filled with
    like pieces, cost least.
    """
    capacities = sorted(capacities)
    policies = [lambda n, least=least: min(c for c in capacities if c >= max(n, least)) for least in capacities]
    policies.append(lambda n: min((c for c in capacities if c >= n), key=lambda c: ((c + overhead) / (c // n * n), -c)))
    best: tuple[list[tuple[int, ...]], int] | None = None
    for opens in policies:
        placed, bins = best_fit(histogram, opens)
        cost = sum(number * (downsized(used, capacities) + overhead) for _, number, used in bins)
        if best is None or cost < best[1]:
            best = placed, cost
    return best


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id", capacities: Sequence[int] = CAPACITIES, overhead: int = BIN_OVERHEAD) -> DataFrame:
    """A row for each piece: its text, number, first token and length, and its bin with capacity and offset.

    ``length`` is the number of tokens of a row. Returns ``doc_id, piece, start,
    n_tokens, bin_id, bin_offset, bin_capacity, bin_used`` (long).
    """
    spark, most = docs.sparkSession, max(capacities)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("total"))
    pieces = sized.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("total") / most) - 1, F.lit(0)).cast("long"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("total") - F.col("piece") * most).alias("n_tokens"))
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS))
    within = Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece")
    numbered = written(pieces.withColumn("salt", salt).withColumn("in_salt", F.row_number().over(within).cast("long") - 1))

    # At most capacity x SALTS rows.
    counts = numbered.groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("n_tokens", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    histogram = [(r.n_tokens, r.n) for r in counts.filter("n_tokens > 0").groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()]

    placed, _ = plan(histogram, capacities, overhead)
    # A length meets few free spaces: the table's size follows the largest capacity, never the number of texts.
    where = spark.createDataFrame(pd.DataFrame(placed, columns=PLACEMENT.names), PLACEMENT)
    ranked = numbered.join(F.broadcast(shifts), ["n_tokens", "salt"]).withColumn("rank", F.col("shift") + F.col("in_salt"))
    there = (F.col("n_tokens") == F.col("length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    behind = F.col("rank") - F.col("rank_from")
    binned = ranked.join(F.broadcast(where), there, "left").select(
        "doc_id", "piece", "start", "n_tokens",
        (F.col("first_bin") + F.floor(behind / F.col("per_bin"))).alias("bin_id"),
        (F.col("at") + behind % F.col("per_bin") * F.col("n_tokens")).alias("bin_offset"),
    )
    used = binned.filter("bin_id IS NOT NULL").groupBy("bin_id").agg(F.sum("n_tokens").alias("bin_used"))
    sizes = F.array(*[F.lit(int(c)) for c in sorted(capacities)])
    used = used.withColumn("bin_capacity", F.array_min(F.filter(sizes, lambda c: c >= F.col("bin_used"))).cast("long"))
    return binned.join(used, "bin_id", "left").select("doc_id", "piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_capacity", "bin_used")


def word_count(text: str = "text") -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text column; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, a token for each word, packed into sequences."""
    return pack(table(spark, folder, "documents"), word_count())


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
ORACLES: dict[str, str] = {}
