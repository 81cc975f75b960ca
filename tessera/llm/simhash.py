"""SimHash near-duplicates by bit-sliced comparison.

The 64-bit fingerprint of a text has a bit for each position that is set in over half of
its shingles' hashes. Fingerprints link if at most ``RADIUS`` bits differ; documents with
one component are near duplicates.

Equal fingerprints are one from the start. Others meet in groups: the bits are cut into
five blocks, of which fingerprints that link agree on three, so each of the ten choices of three
blocks is a grouping by the chosen bits. A group of more than ``GROUP`` fingerprints is
split: the bits that its members don't share are cut into three blocks, and those that link
agree on one of them. After two splits at most twelve bits are free, so no group has more than
2**12 fingerprints, whatever the skew, and a split costs three rows for one. No group is skipped.

In a group the fingerprints stand as bit planes: word w of plane b holds bit b of 64
members. A member is compared with 64 others at once: planes are XORed with its own bits, three at a
time go through a carry-save adder into bitwise counters, and a word is abandoned once all
of its members differ in more than ``RADIUS`` bits. Of a group's links only those of a spanning forest
leave the task.

Null and empty texts have fingerprint zero and link like any other. Texts with fewer words
than a shingle are one shingle. Very long texts are taken whole. Rows that repeat, or share an id, are
documents of their own. A row with a null id links like others; the component is the
least id that isn't null, or null if there is none. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textarrays as ta
from tessera.llm.jaccard_join import BROADCAST_ROWS, components
from tessera.llm.shared import written
from tessera.sources.tables import table

BITS, RADIUS = 64, 2
#: Words of a shingle and the hash's seed.
WORDS, SEED = 3, 42
#: Fingerprints of a group beyond which it is split.
GROUP = 1 << 12
#: Pairs of a member and a word of 64 others that are compared at a time; planes between looks at what can be abandoned.
PAIRS, PLANES = 1 << 17, 6
#: Texts' bytes handled at a time.
SLICE = 1 << 20


def fingerprints(text: pa.Array, words: int = WORDS) -> np.ndarray:
    """The fingerprint of each text, as int64; A-Z count as a-z."""
    lists = pc.ascii_split_whitespace(ta.lowered(text))
    values, of = lists.flatten(), ta.owner(lists.offsets.to_numpy().astype(np.int64))
    full = pc.not_equal(values, "")
    values, of = values.filter(full), of[full.to_numpy(zero_copy_only=False)]
    size = np.bincount(of, minlength=len(text))
    first = np.cumsum(size) - size
    data, ends = ta.raw(pc.binary_join_element_wise(values, "", " ") if len(values) else pa.array([], pa.string()))
    # Every word is followed by one space, so a shingle is a stretch of the bytes.
    shingles = np.where(size > 0, np.maximum(size - words + 1, 1), 0)
    of = np.repeat(np.arange(len(text)), shingles)
    at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    to = np.minimum(at + words, (first + size)[of])
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(ends[at].tolist(), (ends[to] - 1).tolist(), strict=True)), np.uint64, len(at))
    offsets = np.concatenate([[0], np.cumsum(shingles)])
    out = np.zeros(len(text), np.uint64)
    for bit in range(BITS):
        often = ta.per_text((h >> np.uint64(bit)) & np.uint64(1), offsets)
        out |= (2 * often > shingles).astype(np.uint64) << np.uint64(bit)
    return out.view(np.int64)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, text in ta.slices(batches, "text", SLICE):
        yield pa.RecordBatch.from_arrays([part["id"], pa.array(fingerprints(text))], names=["id", "fp"])


def _blocks(bits: list[int], n: int) -> list[int]:
    """Masks of ``n`` blocks of ``bits`` of about equal size."""
    return [sum(1 << b for b in bits[len(bits) * k // n : len(bits) * (k + 1) // n]) for k in range(n)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def masks() -> list[int]:
    """The bits that members of a group share: three of five blocks, in each way to choose."""
    return [_signed(sum(some)) for some in combinations(_blocks(list(range(BITS)), RADIUS + 3), 3)]


def split(mask: int) -> list[int]:
    """``mask`` and one of the blocks into which the other bits are cut."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [_signed(mask % (1 << BITS) | block) for block in _blocks(free, RADIUS + 1)]


def planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes: bit i of word w of row b is bit b of member 64 * w + i."""
    lanes = np.zeros(-(-len(fp) // 64) * 64, np.uint64)
    lanes[: len(fp)] = fp.view(np.uint64)
    bits = (lanes[None, :] >> np.arange(BITS, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view("<u8")


def near_pairs(fp: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) of members a < b of one group within the radius; ``start`` and ``end`` are the bounds of each member's group."""
    plane = planes(fp)
    own = fp.view(np.uint64)
    member = np.flatnonzero(end > np.arange(len(fp)) + 1)  # those with others behind them in the group
    words = (end[member] - 1) // 64 - (member + 1) // 64 + 1
    until = np.cumsum(words)
    for begin in range(0, int(until[-1]) if len(until) else 0, PAIRS):
        pair = np.arange(begin, min(begin + PAIRS, int(until[-1])))
        k = np.searchsorted(until, pair, "right")
        q = member[k]
        w = (q + 1) // 64 + pair - (until[k] - words[k])
        # Lanes of the word that are behind the member in its group.
        low, high = np.clip(q + 1 - 64 * w, 0, 63).astype(np.uint64), np.clip(end[q] - 64 * w, 1, 64).astype(np.uint64)
        every = np.uint64(0xFFFFFFFFFFFFFFFF)
        lanes = (every << low) & (every >> (np.uint64(64) - high))
        ones, twos, over = (np.zeros(len(q), np.uint64) for _ in range(3))
        bits = own[q]
        for at in range(0, BITS, 3):
            x = [plane[b][w] ^ (np.uint64(0) - ((bits >> np.uint64(b)) & np.uint64(1))) for b in range(at, min(at + 3, BITS))]
            x += [np.zeros(len(q), np.uint64)] * (3 - len(x))
            odd = x[0] ^ x[1]
            total, carry = odd ^ x[2], (x[0] & x[1]) | (odd & x[2])
            more = ones & total
            ones = ones ^ total
            over |= (twos & more) | ((twos | more) & carry)
            twos |= more | carry
            if (at + 3) % PLANES == 0:
                alive = np.flatnonzero(lanes & ~(over | (ones & twos)))
                if len(alive) < len(q):
                    q, w, lanes, ones, twos, over, bits = (v[alive] for v in (q, w, lanes, ones, twos, over, bits))
                if not len(q):
                    break
        lanes = lanes & ~(over | (ones & twos))
        here = np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, lane = np.nonzero(here)
        yield q[row], 64 * w[row] + lane


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least member that pairs reach, for each of ``n``."""
    label = np.arange(n)
    for a, b in pairs:
        while len(a):
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while not np.array_equal(beyond := label[label], label):
                label = beyond
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
    return label


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of a spanning forest of each group; rows come sorted by ``key``."""
    kept = None

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.diff(key)) + 1
        start = np.concatenate([[0], cut]).astype(np.int64)
        size = np.diff(np.concatenate([start, [len(key)]]))
        label = forest(len(fp), near_pairs(fp, np.repeat(start, size), np.repeat(start + size, size)))
        found = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[found]), pa.array(fp[label[found]])], names=["a", "b"])

    for batch in batches:
        key, fp = (batch[c].to_numpy() for c in ("key", "fp"))
        if kept is not None:
            key, fp = np.concatenate([kept[0], key]), np.concatenate([kept[1], fp])
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
        if last:
            yield links(key[:last], fp[:last])
        kept = key[last:], fp[last:]
    if kept is not None:
        yield links(*kept)


def _grouped(rows: DataFrame) -> DataFrame:
    """``rows`` (fp, mask) with the key of their group."""
    return rows.select("fp", "mask", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that give all components of those within the radius."""
    spark, level = fps.sparkSession, masks()
    rows = _grouped(fps.select("fp", F.explode(F.array(*[F.lit(m) for m in level])).alias("mask")))
    ready = []
    for _ in range(2):
        counts = written(rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
        several = rows.join(counts, "key")
        ready.append(several.filter(F.col("size") <= GROUP).select("key", "fp"))
        if counts.filter(F.col("size") > GROUP).isEmpty():
            break
        children = spark.createDataFrame([(m, c) for m in level for c in split(m)], "mask long, child long")
        level = [c for m in level for c in split(m)]
        rows = written(_grouped(several.filter(F.col("size") > GROUP).join(F.broadcast(children), "mask").select("fp", F.col("child").alias("mask")).distinct()))  # two groups may have a part in common
    else:
        ready.append(rows.select("key", "fp"))
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    return every.repartition("key").sortWithinPartitions("key").mapInArrow(_compared, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp, component`` of each row: its fingerprint and the least id that links reach."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    rows = written(docs.mapInArrow(_profile, f"id {kind}, fp long"))
    own = written(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("size")))
    labels = components(written(links(own.select("fp"))))
    classed = own.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("class", F.coalesce("component", "fp"))
    least = classed.groupBy("class").agg(F.min("least").alias("component"), F.sum("size").alias("members")).filter("members > 1")
    found = written(classed.select("fp", "class").join(least, "class").select("fp", "component"))
    side = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    joined = rows.join(side.withColumn("shared", F.lit(True)), "fp", "left")
    return joined.select("id", "fp", F.when(F.col("shared"), F.col("component")).otherwise(F.col("id")).alias("component"))


def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op11_simhash": op11_simhash}
#: DuckDB has no XXH64: tests hold the query against brute force.
ORACLES: dict[str, str] = {}
