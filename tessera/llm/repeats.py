"""Exact search for windows that occur more than once, by content-chosen anchors.

A window of ``window`` units has an anchor: the leftmost k-gram in it with the
least hash. Equal windows have equal anchors at equal places, so what repeats
can be found among windows of one anchor. Consecutive windows of a text with the
same anchor form a block, and a text becomes a short list of blocks.

1. Blocks are grouped by anchor. An anchor that occurs once has no repeated window.
2. Where all blocks of an anchor are equal, every window in them repeats; the same
   holds for a block that occurs twice among unequal ones. One row decides them all.
3. What is left are single blocks beside other blocks of their anchor, as at the
   edge of a copied passage. Their units are fetched, one block for each content,
   and compared unit by unit. Where an anchor has very many contents, short stretches
   of windows take the place of blocks, grouped by what all their windows share, and
   what is then still many is counted window by window; so no task holds an unbounded
   group.

Only sums and narrow rows meet in a shuffle by anchor. Texts are shuffled once, by
a hash of id and text, to meet what was found about them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textarrays as ta
from tessera.llm.shared import written

#: Odd multiplier of the polynomial hash modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Contents of an anchor that are compared pairwise in one task; more are counted window by window.
COMPARED = 48
#: Windows in a short stretch at most.
STRETCH = 16

BLOCK = "a long, b long, key long, start int, n int, off int"
ELEMENT = "struct<a: long, b: long, many: boolean, single: boolean, at: int, off: int, units: binary>"


@dataclass(frozen=True)
class Units:
    """What a text consists of.

    ``split`` gives (hash of each unit, the units themselves, offsets of texts);
    ``finish(text, spans)`` gives (units, removed units, kept bytes).
    """

    window: int
    k: int
    dtype: type
    split: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]
    finish: Callable[[bytes, list[tuple[int, int]]], tuple[int, int, bytes]]

    @property
    def reach(self) -> int:
        """K-grams in a window."""
        return self.window - self.k + 1

    @property
    def stretch(self) -> int:
        """Windows in a short stretch: few enough for a core of most of a window."""
        return max(1, min(STRETCH, self.window // 4))


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 20), base, np.uint64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


class Hasher:
    """Hashes of any stretch of a sequence of unit hashes."""

    def __init__(self, units: np.ndarray):
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * _power(BASE, len(units)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * _power(INVERSE, len(self.sums))[start]

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return ta.mixed((self.sums[k:] - self.sums[:n]) * _power(INVERSE, n))


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n, size = len(x) - w + 1, 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n])


def blocks(units: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(anchor, content hash, text, first window in the text, windows, anchor's distance from the first window)."""
    w, total = window - k + 1, len(units)
    size = np.diff(offsets)
    if not (size >= window).any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32))
    hasher = Hasher(units)
    grams = hasher.grams(k)
    least = _least(grams, w)
    n = total - window + 1
    own = size >= window
    first, last = offsets[:-1][own], offsets[1:][own] - window
    inside = np.zeros(n + 1, np.int8)
    inside[first] = 1
    inside[last + 1] -= 1
    inside = np.cumsum(inside[:n], dtype=np.int8).astype(bool)
    follows = inside[1:] & inside[:-1]
    left = follows & (grams[: n - 1] == least[:-1])  # the anchor is the first k-gram: it leaves
    came = follows & (least[1:] < least[:-1])  # a lesser k-gram comes in at the end
    search = np.concatenate([first, np.flatnonzero(left & ~came) + 1])
    anchor = np.full(n, -1, np.int64)
    at = np.flatnonzero(came) + 1
    anchor[at] = at + w - 1
    view = np.lib.stride_tricks.sliding_window_view(grams, w)
    for i in range(0, len(search), 8192):
        part = search[i : i + 8192]
        anchor[part] = part + view[part].argmin(1)
    begin = np.flatnonzero(anchor >= 0)
    text = np.searchsorted(offsets, begin, "right") - 1
    end = np.minimum(np.append(begin[1:], n) - 1, offsets[text + 1] - window)
    j = anchor[begin]
    content = ta.mixed(hasher.of(begin, end + window) + ta.mixed(((end - begin + window) * 4096 + j - begin).astype(np.uint64)))
    return grams[j].view(np.int64), content.view(np.int64), text, (begin - offsets[text]).astype(np.int32), (end - begin + 1).astype(np.int32), (j - begin).astype(np.int32)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without overlaps or touching ends, in order."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(z, out[-1][1])
        else:
            out.append((a, z))
    return out


def _emit_blocks(u: Units) -> Callable:
    names = [x.split()[0] for x in BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text in ta.slices(batches, "text"):
            units, _, offsets = u.split(text)
            a, b, of, start, n, off = blocks(units, offsets, u.window, u.k)
            key = part["key"].to_numpy()[of]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, key, start, n, off)], names=names)

    return run


RESULT = "n_units long, n_removed long, n_spans long, kept binary"


def _finished(u: Units, text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, bytes]:
    n, removed, kept = u.finish(text, spans)
    return n, removed, len(spans), kept


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))
_ELEMENTS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("many", pa.bool_()), ("single", pa.bool_()), ("at", pa.int32()), ("off", pa.int32()), ("units", pa.binary())]))


def _settle(u: Units, digest: Callable[[bytes], bytes]) -> Callable:
    """Finishes texts about which all is known, and fetches the units of blocks to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text in ta.slices(batches, "text"):
            found = part["found"].to_pylist()
            raw = text.cast(pa.binary()).to_pylist()
            wanted = [i for i, f in enumerate(found) if f and any(x["fetch"] for x in f)]
            if wanted:
                _, units, offsets = u.split(text.take(pa.array(wanted)))
            place = {t: k for k, t in enumerate(wanted)}
            rows: list[tuple] = []
            for i, f in enumerate(found):
                certain, fetched, open_ = [], [], False
                for x in f or ():
                    if x["sure"]:
                        certain.append((x["start"], x["start"] + x["n"] - 1 + u.window))
                    if x["fetch"]:
                        begin = offsets[place[i]] + x["start"]
                        fetched.append({"a": x["a"], "b": x["b"], "many": x["many"], "single": not x["sure"], "at": x["start"] + x["off"], "off": x["off"], "units": units[begin : begin + x["n"] - 1 + u.window].tobytes()})
                        open_ |= not x["sure"]
                certain = merge(certain)
                if open_:
                    rows.append((None, None, None, None, raw[i], [{"a": a, "z": z} for a, z in certain], fetched))
                else:
                    n, removed, spans, kept = _finished(u, raw[i], certain)
                    rows.append((n, removed, spans, digest(kept), None, None, fetched))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), _SPANS, _ELEMENTS)
            yield pa.RecordBatch.from_arrays([part["key"], part["id"], *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["key", "id", "n_units", "n_removed", "n_spans", "kept", "rest", "spans", "elements"])

    return run


def _extents(u: Units, group: np.ndarray, b: np.ndarray, single: np.ndarray, off: np.ndarray, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How far a repeat reaches left and right of each single block's anchor; 0, 0 where nothing repeats.

    Rows of a group are adjacent. Two blocks share a stretch around the anchor; it
    holds a repeated window if it has the length of one.
    """
    left = u.reach - 1
    wide = np.int16 if u.dtype is np.uint8 else np.uint64
    mine = np.full((len(b), left + u.window), 300 if wide is np.int16 else 0, wide)
    theirs = np.full_like(mine, 301 if wide is np.int16 else 1)
    for i, x in enumerate(units):
        own = np.frombuffer(x, u.dtype)
        at = left - off[i]
        mine[i, at : at + len(own)] = theirs[i, at : at + len(own)] = own
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    i_of, j_of = [], []
    for s, m in zip(starts.tolist(), sizes.tolist(), strict=True):
        if m > 1:
            grid = np.arange(s, s + m)
            own = grid[single[s : s + m]]
            i_of.append(np.repeat(own, m))
            j_of.append(np.tile(grid, len(own)))
    to_left, to_right = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
    if i_of:
        i_all, j_all = np.concatenate(i_of), np.concatenate(j_of)
        other = b[i_all] != b[j_all]
        i_all, j_all = i_all[other], j_all[other]
        step = max(1, (16 << 20) // mine[0].nbytes)
        for k in range(0, len(i_all), step):
            i, j = i_all[k : k + step], j_all[k : k + step]
            differs = mine[i] != theirs[j]
            ahead, behind = differs[:, :left][:, ::-1], differs[:, left:]
            reach_l = np.where(ahead.any(1), ahead.argmax(1), left) if left else np.zeros(len(i), np.int64)
            reach_r = np.where(behind.any(1), behind.argmax(1), u.window)
            holds = reach_l + reach_r >= u.window
            np.maximum.at(to_left, i[holds], reach_l[holds])
            np.maximum.at(to_right, i[holds], reach_r[holds])
    return to_left, to_right


def _compare(u: Units) -> Callable:
    """Spans of single blocks. Rows come sorted by anchor."""

    def spans(rows: pa.Table) -> pa.RecordBatch:
        column = lambda c: rows[c].to_numpy()
        single, at = column("single").astype(bool), column("at").astype(np.int64)
        to_left, to_right = _extents(u, column("a"), column("b"), single, column("off"), rows["units"].to_pylist())
        own = single & (to_right > 0)
        return pa.RecordBatch.from_arrays([pa.array(column("key")[own]), pa.array((at - to_left)[own].astype(np.int32)), pa.array((at + to_right)[own].astype(np.int32))], names=["key", "a", "z"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if kept is None else pa.concat_tables([kept, rows])
            a = rows["a"].to_numpy()
            cut = int(np.searchsorted(-(a == a[-1]).astype(int)[::-1], 0, "left"))  # rows of the last anchor
            kept = rows.slice(len(a) - cut)
            if cut < len(a):
                yield spans(rows.slice(0, len(a) - cut))
        if kept is not None:
            yield spans(kept)

    return run


def _hash(units: np.ndarray, seed: int = 1) -> Hasher:
    return Hasher(ta.mixed(units.astype(np.uint64) + np.uint64(seed)))


def _stretches(u: Units) -> Callable:
    """Short stretches of a block's windows as blocks of their own.

    A stretch has the windows whose anchor lies in one range of places. All of them
    share a core, which stands in for the anchor.
    """
    names, wide = ["a", "b", "key", "single", "at", "off", "units"], u.stretch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                own = np.frombuffer(row["units"], u.dtype)
                hasher, off = _hash(own), row["off"]
                far = off - (len(own) - u.window)  # the anchor's place in the last window
                for c in range(far // wide, off // wide + 1):
                    high, low = min(off, c * wide + wide - 1), max(far, c * wide)
                    first, last = off - high, off - low
                    core = off - c * wide
                    ends = np.array([[core, core + u.window - wide + 1], [first, last + u.window]])
                    shared, all_ = hasher.of(ends[:, 0], ends[:, 1])
                    tag = ta.mixed(np.array([(row["a"] + c) & 0xFFFFFFFFFFFFFFFF, high * 65536 + low], np.uint64))
                    a, b = ta.mixed(np.array([shared, all_]) + tag).view(np.int64).tolist()
                    out.append((a, b, row["key"], row["single"], row["at"], high, own[first : last + u.window].tobytes()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def _windows(u: Units) -> Callable:
    """Two hashes of each window of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["units"], u.dtype)
                n = len(own) - u.window + 1
                at = np.arange(n)
                h = [ta.mixed(_hash(own, seed).of(at, at + u.window)).view(np.int64) for seed in (1, 1 << 20)]
                start = row["at"] - row["off"] + at
                yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array(np.full(n, row["key"])), pa.array(start.astype(np.int32)), pa.array(np.full(n, row["single"])), pa.array(np.full(n, row["b"]))], names=["h", "g", "key", "start", "single", "b"])

    return run


def _spans_of_many(u: Units, elements: DataFrame) -> DataFrame:
    """(key, a, z) of repeats in single blocks of anchors with many contents."""
    rows = "a long, b long, key long, single boolean, at int, off int, units binary"
    short = written(elements.mapInArrow(_stretches(u), rows))
    contents = written(short.groupBy("a", "b").agg(F.count("*").alias("times"), F.min(F.struct("key", "at")).alias("chosen")))
    cores = written(contents.groupBy("a").agg(F.count("*").alias("contents"), F.sum("times").alias("total")).filter("total > 1").select("a", "contents"))
    contents = written(contents.join(cores, "a"))
    short = short.join(contents, ["a", "b"])
    alike = short.filter("single AND times > 1").select("key", (F.col("at") - F.col("off")).alias("a"), (F.col("at") - F.col("off") + F.octet_length("units") / np.dtype(u.dtype).itemsize).cast("int").alias("z"))
    rest = short.filter((F.col("contents") > 1) & (F.struct("key", "at") == F.col("chosen"))).withColumn("single", F.col("single") & (F.col("times") == 1))
    few = rest.filter(F.col("contents") <= COMPARED).select("key", "a", "b", "single", "at", "off", "units")
    few = few.repartition("a").sortWithinPartitions("a", "b").mapInArrow(_compare(u), "key long, a int, z int")
    counted = written(rest.filter(F.col("contents") > COMPARED).mapInArrow(_windows(u), "h long, g long, key long, start int, single boolean, b long"))
    twice = written(counted.groupBy("h", "g").agg(F.min("b").alias("low"), F.max("b").alias("high")).filter("low <> high").select("h", "g"))
    counted = counted.filter("single").join(twice, ["h", "g"]).select("key", F.col("start").alias("a"), (F.col("start") + u.window).alias("z"))
    return alike.unionByName(few).unionByName(counted)


def _complete(u: Units, digest: Callable[[bytes], bytes]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, certain, more in zip(batch["rest"].to_pylist(), batch["spans"].to_pylist(), batch["more"].to_pylist(), strict=True):
                n, removed, spans, kept = _finished(u, text, merge([(x["a"], x["z"]) for x in (certain or []) + (more or [])]))
                rows.append((n, removed, spans, digest(kept)))
            if rows:
                yield pa.RecordBatch.from_arrays([batch["id"], *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]], names=["id", "n_units", "n_removed", "n_spans", "kept"])

    return run


def without_repeats(docs: DataFrame, u: Units, id_col: str, text_col: str, digest: Callable[[bytes], bytes]) -> DataFrame:
    """For each row ``id``, ``n_units``, ``n_removed``, ``n_spans`` and ``kept``, which is ``digest`` of the kept bytes."""
    text = F.col(text_col)
    docs = docs.select(F.xxhash64(F.col(id_col), text).alias("key"), F.col(id_col).alias("id"), text.alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    found = written(docs.select("key", "text").mapInArrow(_emit_blocks(u), BLOCK))

    # Sides of joins that are aggregated by the join's key are written first: Spark then splits a hot key of the other side.
    groups = written(found.groupBy("a").agg(F.count("*").alias("total"), (F.min("b") == F.max("b")).alias("alike")).filter("total > 1").select("a", "alike"))
    hits = written(found.join(groups, "a"))
    row = lambda sure, fetch, many: F.struct("a", "b", "start", "n", "off", sure.alias("sure"), fetch.alias("fetch"), many.alias("many"))
    no, yes = F.lit(False), F.lit(True)
    alike = hits.filter("alike").select("key", row(yes, no, no).alias("x"))
    unlike = hits.filter("NOT alike")
    contents = written(unlike.groupBy("a", "b").agg(F.count("*").alias("times"), F.min(F.struct("key", "start")).alias("chosen")))
    anchors = written(contents.groupBy("a").agg((F.count("*") > COMPARED).alias("many"), (F.min("times") == 1).alias("open")))
    contents = written(contents.join(anchors, "a").select("a", "b", "times", "chosen", "many", "open"))
    mixed = unlike.join(contents, ["a", "b"]).select(
        "key", row(F.col("times") > 1, F.col("open") & (F.struct("key", "start") == F.col("chosen")), F.col("many")).alias("x")
    )
    by_text = alike.unionByName(mixed).groupBy("key").agg(F.collect_set("x").alias("found"))

    settled = written(
        docs.join(by_text, "key", "left").mapInArrow(
            _settle(u, digest), f"key long, id {kind}, {RESULT}, rest binary, spans array<struct<a: int, z: int>>, elements array<{ELEMENT}>"
        )
    )
    elements = settled.select("key", F.explode("elements").alias("e")).select("key", "e.*")
    # Rows that repeat id and text fetch the same blocks: one of them is enough.
    compared = elements.filter("NOT many").repartition("a").dropDuplicates(["a", "key", "at"]).sortWithinPartitions("a", "b").mapInArrow(_compare(u), "key long, a int, z int")
    counted = _spans_of_many(u, elements.filter("many").dropDuplicates(["a", "key", "at"]).select("a", "key", "single", "at", "off", "units"))
    more = compared.unionByName(counted).groupBy("key").agg(F.collect_set(F.struct("a", "z")).alias("more"))
    late = settled.filter("rest IS NOT NULL").select("key", "id", "rest", "spans").join(more, "key", "left").mapInArrow(_complete(u, digest), f"id {kind}, {RESULT}")
    return settled.filter("rest IS NULL").select("id", *[x.split()[0] for x in RESULT.split(", ")]).unionByName(late)
