"""Exact Jaccard join of word shingles by universe partition.

A text is the set of its shingles. Sets x and y reach the threshold p/q only if at most
(q - p) / (q + p) * (|x| + |y|) elements lie in one of them alone. The universe is hashed
into segments, more of them than such elements, in bands of set size; so linked
sets agree on a whole segment. A set indexes the leading segments that its own size
needs, and also in the band below if a partner may be there. Segments may be doubled:
their neighbourhoods of one deletion are indexed too, and a doubled segment covers two
differences. A cost model over the number of sets in each band chooses how many.
Empty segments say little: spare segments make up for them, and only a set with more
empty segments than spares indexes those.

Sets that share a key form a group, if one of them has its own size band there. Each is
compared with the member of its group that shares most keys in all, its centre. The members of
a centre are its family; their differences to it tell all about their links: x and y differ in
|x - centre| + |y - centre| less twice what both differences have in common. So a family is settled in one
task from the differences alone, and only links of a spanning forest leave it. Of each group, members far from the centre are
a family of their own, whose differences are to the empty set; those whose sketch, of a bit for each element, differs too much from
all others' are left out before.

A family of more than ``MEMBERS`` is split. Elements that over half of the differences hold are
turned round in all of them, which moves the centre to what most members have in common; then no element is in more than half. The member
nearest to it by size links with all that need no common element for a link with anyone. Every other pair has
elements in common that are among the leading ones of both differences, rarest first, so the members with the same leading element are
families of their own, of half the size at most. Where differences are long such groups get a centre
of their own and enter another round instead. Rounds end when no group is left; no pair is skipped.

Equal sets are one class from the start. Null and empty texts have no shingles and
link with nothing. A row with a null id links with nothing and has a null component.
Rows that share an id are documents of their own, each in the class of its text. An empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textarrays as ta
from tessera.llm.shared import Scratch, small_batches, unused, written
from tessera.sources.tables import table

#: Ratio of the set sizes at a band's ends.
BAND = 1.5
#: For the cost model: share of a band's sets that have a passage in common with a given one, chance that
#: such a set holds an element of it, and the cost of comparing two sets in index rows.
RELATED, CHANCE, COMPARE = 1e-3, 0.02, 50.0
#: Members and elements of a family that a task settles, members that it settles whatever their elements, and elements of
#: a difference, on average, up to which it is repeated for each leading element of a larger family.
MEMBERS, ELEMENTS, FEW, LIGHT = 1 << 12, 1 << 22, 32, 256
#: Differences to the centre, as a share of its size, beyond which a member is compared by its own elements.
FAR = 0.8
#: Centres whose sets a task holds.
CENTRES = 256
#: Rows up to which a list of keys is broadcast; beyond, texts are shuffled to meet it.
BROADCAST_ROWS = 1_000_000
#: Text bytes that a task takes at a time; shingles and index keys take some 50 bytes of memory for each meanwhile.
SLICE_BYTES = 1 << 20


@dataclass(frozen=True)
class Measure:
    """Shingles of ``words`` words; sets link from Jaccard p / q."""

    words: int
    p: int
    q: int

    def links(self, common: int, a: int, b: int) -> bool:
        return self.q * common >= self.p * (a + b - common)

    def excess(self, d, n):
        """Sets x and y link if the sum of their excess is at most ``cost`` for each element that their differences share."""
        return (self.q + self.p) * d - (self.q - self.p) * n

    @property
    def cost(self) -> int:
        return 2 * (self.q + self.p)

    def differences(self, size: np.ndarray) -> np.ndarray:
        """Most elements in one set alone, over all partners of a set of this size."""
        return size * (self.q - self.p) // self.p


@dataclass(frozen=True)
class Band:
    """Segments of a band, the leading ``doubled`` of them with deletions, and spares for empty ones."""

    segments: int
    doubled: int
    spare: int


def band_of(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(size, 1)) / math.log(BAND) + 1e-9).astype(np.int64)


class Layout:
    """The cheapest layout of each band, given about how many sets each has; the same in every task."""

    def __init__(self, m: Measure, counts: dict[int, int]):
        self.m, self.counts, self.made = m, counts, {}

    def __getitem__(self, band: int) -> Band:
        if band not in self.made:
            self.made[band] = self._cheapest(band)
        return self.made[band]

    def _cheapest(self, band: int) -> Band:
        low, high = math.ceil(BAND**band - 1e-9), math.ceil(BAND ** (band + 1) - 1e-9) - 1
        most = int(self.m.differences(np.int64(max(low, high))))
        sets = 1 + self.counts.get(band, 0) + self.counts.get(band + 1, 0)
        best = None
        for part in (0.0, 0.5, 1.0):
            doubled = math.ceil((most + 1) / 2 * part)
            base = max(1, most + 1 - doubled)
            empty = (int(self.m.differences(np.int64(low))) + 1) * math.exp(-low / base)
            spare = max(1, math.ceil(empty + 3 * math.sqrt(empty)))
            segments = base + spare
            held = (low + high) / 2 / segments
            rows = segments + doubled * held
            some = lambda h: min(1.0, sets * RELATED * CHANCE**h)
            by_chance = doubled * (1 + held) * some(max(held - 1, 1)) + (segments - doubled) * some(held)
            cost = rows + COMPARE * by_chance
            if best is None or cost < best[0]:
                best = cost, Band(segments, doubled, spare)
        return best[1]


def shingles(m: Measure, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each distinct shingle of each text, its text); A-Z in lower case."""
    ids, distinct, offsets = ta.words(ta.lowered(text))
    h = ta.mixed(ta.hashes(distinct))[ids]
    size, of = np.diff(offsets), ta.owner(offsets)
    n = min(m.words, max(1, int(size.max(initial=1))))
    at = np.arange(len(ids))
    left = offsets[1:][of] - at  # words from here to the end of the text
    here = np.flatnonzero((left >= m.words) | ((size[of] < m.words) & (at == offsets[:-1][of])))
    key = np.zeros(len(here), np.uint64)
    for k in range(n):
        inside = k < left[here]
        key = np.where(inside, ta.mixed(key + h[np.minimum(here + k, len(h) - 1)]), key) if len(here) else key
    own = of[here]
    _, first = np.unique(key ^ ta.mixed(own.astype(np.uint64) + np.uint64(7)), return_index=True)
    return key[first], own[first]


def _signature(key: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of shingles, hash of the set) of each text."""
    sums = np.zeros(n, np.uint64)
    np.add.at(sums, of, ta.mixed(key + np.uint64(11)))
    size = np.bincount(of, minlength=n)
    return size, ta.mixed(sums + ta.mixed(size.astype(np.uint64))).view(np.int64)


def index_keys(m: Measure, bands: Layout, key: np.ndarray, of: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index key, text, whether it is of the text's own band) for every text with a possible partner of other content."""
    own = band_of(size)
    lowest = np.ceil(size * m.p / m.q)
    keys, texts, native = [], [], []
    for shift in (0, 1):
        band = own - shift
        takes = (m.differences(size) > 0) & ((shift == 0) | (lowest < np.ceil(BAND ** own.astype(float) - 1e-9)))
        layout = [bands[int(b)] if t else Band(1, 0, 0) for b, t in zip(band, takes, strict=True)]
        segments, doubled, spare = (np.array([getattr(x, f) for x in layout], np.int64) for f in ("segments", "doubled", "spare"))
        need = m.differences(size) + 1 + spare  # a doubled segment makes up for two
        lead = np.where(need <= 2 * doubled, -(-need // 2), need - doubled)
        lead = np.where(takes, np.minimum(lead, segments), 0)
        start = np.cumsum(lead) - lead
        segment = (ta.mixed(key + np.uint64(23)) % segments[of].astype(np.uint64)).astype(np.int64)
        inside = segment < lead[of]
        cell, e, text = (start[of] + segment)[inside], ta.mixed(key + np.uint64(31))[inside], of[inside]
        total = int(lead.sum())
        sums, held = np.zeros(total, np.uint64), np.bincount(cell, minlength=total)
        np.add.at(sums, cell, e)
        text_of = np.repeat(np.arange(len(size)), lead)
        number = np.arange(total) - np.repeat(start, lead)
        place = ta.mixed((band[text_of] * (1 << 32) + number).astype(np.uint64))
        name = lambda s, n, place: ta.mixed(ta.mixed(s + n.astype(np.uint64)) + place)
        double = number < doubled[text_of]
        empty = np.bincount(text_of[(held == 0) & ~double], minlength=len(size))
        given = (held > 0) | double | (empty > spare)[text_of]
        keys.append(name(sums, held, place)[given])
        texts.append(text_of[given])
        less = double[cell]
        keys.append(name(sums[cell] - e, held[cell] - 1, place[cell])[less])
        texts.append(text[less])
        native.append(np.full(len(keys[-2]) + len(keys[-1]), shift == 0))
    return np.concatenate(keys).view(np.int64), np.concatenate(texts), np.concatenate(native)


def _profile(m: Measure):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text in ta.slices(batches, "text", SLICE_BYTES):
            size, sig = _signature(*shingles(m, text), len(text))
            yield pa.RecordBatch.from_arrays([part["row"], part["id"], pa.array(size), pa.array(sig)], names=["row", "id", "n", "sig"])

    return run


def _index(m: Measure, bands: Layout):
    """Index rows of the distinct sets at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, text in ta.slices(batches, "text", SLICE_BYTES):
            key, of = shingles(m, text)
            size, sig = _signature(key, of, len(text))
            new = np.zeros(len(text), bool)
            there = np.flatnonzero(size > 0)
            new[there[np.unique(sig[there], return_index=True)[1]]] = True
            own = new[of]
            keys, texts, native = index_keys(m, bands, key[own], of[own], np.where(new, size, 0))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sig[texts]), pa.array(native)], names=["key", "sig", "native"])

    return run


def _verify(m: Measure):
    """Compares sets with their centres.

    ``diff`` is what only one of the two has, for sets near the centre. Linked sets differ by at most
    what is permitted, so that either both count as near or both as far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        one = lambda t: np.sort(shingles(m, pa.array([t.as_py()], pa.string()))[0])
        for part, text in ta.slices(batches, "text", SLICE_BYTES):
            key, of = shingles(m, text)
            order = np.lexsort((key, of))
            cuts = np.searchsorted(of[order], np.arange(len(text) + 1))
            key = key[order]
            out: list[tuple] = []
            columns = [part[c].to_pylist() for c in ("centre", "sig", "last")]
            for i, (centre, member, last, c_text) in enumerate(zip(*columns, part["centre_text"], strict=True)):
                if centre not in held:
                    if len(held) >= CENTRES:
                        del held[next(iter(held))]
                    held[centre] = one(c_text)
                c, x = held[centre], key[cuts[i] : cuts[i + 1]]
                diff = np.setxor1d(x, c, assume_unique=True)
                d = len(diff)
                near = not last and d <= FAR * len(c) + m.differences(np.int64(len(x)))
                far = not last and d > FAR * len(c)
                out.append((centre, member, m.links((len(x) + len(c) - d) // 2, len(x), len(c)), len(x), d, diff.view(np.int64) if near else None, sketch(x) if far else None))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            names = ["centre", "sig", "linked", "n", "d", "diff", "far"]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def sketch(elements: np.ndarray) -> bytes:
    """Bits of a set, about one for each element: whether an odd number of elements falls on it. Sets that differ in d elements differ in d bits at most."""
    bits = 64
    while bits < len(elements):
        bits *= 2
    odd = np.bincount((elements % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def plausible(m: Measure, n: np.ndarray, sketches: list[bytes]) -> np.ndarray:
    """Which of the sets may link with another one, by their sketches."""
    out, size = np.zeros(len(n), bool), np.array([len(x) for x in sketches])
    for short in np.unique(size):
        # Longer sketches are folded to this one's bits; sets with yet longer ones are too large for a link.
        own, words = np.flatnonzero(size == short), int(short) // 8
        at, rows = [own], [np.frombuffer(b"".join(sketches[i] for i in own), "<u8").reshape(-1, words)]
        for more in np.unique(size[(size > short) & (size * m.p <= 2 * short * m.q)]):
            at.append(np.flatnonzero(size == more))
            longer = np.frombuffer(b"".join(sketches[i] for i in at[-1]), "<u8")
            rows.append(np.bitwise_xor.reduce(longer.reshape(len(at[-1]), -1, words), axis=1))
        at, bits = np.concatenate(at), np.concatenate(rows)
        for i, member in enumerate(own):
            apart = np.bitwise_count(bits ^ bits[i]).sum(axis=1, dtype=np.int64)
            near = (m.q + m.p) * apart <= (m.q - m.p) * (n[at] + n[member])
            near[i] = False
            if near.any():
                out[member] = out[at[near]] = True
    return out


def _plausible(m: Measure):
    """(key, sig) of the sets that may link with another one of their group; rows come sorted by ``key``."""

    def kept(held: list[pa.RecordBatch], whole: bool) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        if whole:
            rows = rows.filter(pa.array(plausible(m, rows["n"].to_numpy(), rows["far"].to_pylist())))
        return pa.RecordBatch.from_arrays([pa.array(rows[c].to_numpy()) for c in ("key", "sig")], names=["key", "sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, whole = 0, True
        for batch in batches:
            key = batch["key"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[0]["key"][0].as_py() != key[a]:
                    yield kept(held, whole)
                    held, count, whole = [], 0, True
                held.append(batch.slice(a, b - a))
                count += b - a
                if count > MEMBERS or sum(x.get_total_buffer_size() for x in held) > 8 * ELEMENTS * 4:
                    yield kept(held, False)  # a group beyond what a task holds goes on as it is
                    held, count, whole = [], 0, False
        if held:
            yield kept(held, whole)

    return run


def _sets(m: Measure):
    """(sig, n, diff): each set's elements, its difference to the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text in ta.slices(batches, "text", SLICE_BYTES):
            key, of = shingles(m, text)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(text)))])
            diff = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(key[np.argsort(of, kind="stable")].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part["sig"], pa.array(np.diff(offsets)), diff], names=["sig", "n", "diff"])

    return run


def _families(m: Measure, compared: DataFrame, keyed: DataFrame, texts: DataFrame, s: Scratch) -> DataFrame:
    """(fam, centre, sig, n, d, linked, diff): the members near each centre, and of each group those far from its centre that may link with each other."""
    near = compared.filter("diff IS NOT NULL").select(F.xxhash64("centre").alias("fam"), "centre", "sig", "n", "d", "linked", "diff")
    away = s.written(keyed.join(_side(s.written(compared.filter("far IS NOT NULL").select("centre", "sig"))), ["centre", "sig"], "left_semi").select("key", "sig"))
    away = away.join(_side(away.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")), "key", "left_semi")
    bits = compared.filter("far IS NOT NULL").groupBy("sig").agg(F.first("n").alias("n"), F.first("far").alias("far"))
    away = s.written(away.join(bits, "sig").repartition("key").sortWithinPartitions("key").select("key", "sig", "n", "far").mapInArrow(_plausible(m), "key long, sig long"))
    sets = texts.join(_side(away.select("sig").distinct()), "sig", "left_semi").select("sig", "text").mapInArrow(_sets(m), "sig long, n long, diff array<long>")
    far = _side(away).join(sets, "sig").select(F.xxhash64("key", F.lit("far")).alias("fam"), F.lit(0).cast("long").alias("centre"), "sig", "n", F.col("n").alias("d"), F.lit(False).alias("linked"), "diff")
    return near.unionByName(far)


def settled(m: Measure, n: np.ndarray, d: np.ndarray, linked: np.ndarray, diff: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of each member of a family: 0 that of its centre, otherwise 1 + the index of its first member.

    Members that are ``linked`` are of the centre's class from the start and aren't compared with each other.
    """
    size = len(n)
    label = np.where(linked, 0, np.arange(1, size + 1))
    own = ta.owner(offsets)
    _, e, often = np.unique(diff, return_inverse=True, return_counts=True)
    # What most differences hold is turned round.
    most = 2 * often > size
    if most.any():
        place = np.cumsum(most) - 1
        has = np.zeros((size, int(most.sum())), bool)
        inside = most[e]
        has[own[inside], place[e[inside]]] = True
        row, col = np.nonzero(~has)
        own, e = np.concatenate([own[~inside], row]), np.concatenate([e[~inside], np.flatnonzero(most)[col]])
        d = d - has.sum(axis=1) + (~has).sum(axis=1)
        often = np.bincount(e, minlength=len(often))
    excess = m.excess(d, n)
    some = often[e] > 1
    own, e = own[some], e[some]
    by_element, by_member = np.argsort(e, kind="stable"), np.argsort(own, kind="stable")
    members, elements = own[by_element], e[by_member]
    first = np.concatenate([[0], np.cumsum(np.bincount(e, minlength=len(often)))])
    start = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=size))])
    for u in np.flatnonzero(~linked):
        common = np.zeros(size, np.int64)
        if len(mine := elements[start[u] : start[u + 1]]):
            common = np.bincount(np.concatenate([members[first[x] : first[x + 1]] for x in mine]), minlength=size)
        links = excess[u] + excess <= m.cost * common
        links[u] = True
        classes = label[links]
        if (classes != label[u]).any():
            label[np.isin(label, classes)] = classes.min()
            if not label.any():
                break
    return label


def _settle(m: Measure):
    """Links (a, b) of a spanning forest of each family; rows come sorted by ``fam``."""

    def links(fam: pa.RecordBatch | pa.Table) -> pa.RecordBatch:
        diff = fam["diff"].combine_chunks()
        offsets = diff.offsets.to_numpy().astype(np.int64)
        n, d, linked, sig = (fam[c].to_numpy() for c in ("n", "d", "linked", "sig"))
        label = settled(m, n, d, linked, diff.flatten().to_numpy(), offsets - offsets[0])
        nodes = np.concatenate([fam["centre"][0:1].to_numpy(), sig])
        found = np.flatnonzero(~linked & (label != np.arange(1, len(sig) + 1)))
        return pa.RecordBatch.from_arrays([pa.array(sig[found]), pa.array(nodes[label[found]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            fam = batch["fam"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(fam)) + 1).tolist(), len(fam)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[0]["fam"][0].as_py() != fam[a]:
                    yield links(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def _split(m: Measure, rows: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """(families (fam, centre, sig, n, d, linked, diff) by leading element; links (a, b)) of large families."""
    size = s.written(rows.groupBy("fam").agg(F.count("*").alias("size")))
    often = rows.select("fam", F.explode("diff").alias("e")).groupBy("fam", "e").agg(F.count("*").alias("often"))
    often = s.written(often.join(_side(size), "fam").withColumn("most", F.expr("2 * often > size")))
    most = often.filter("most").groupBy("fam").agg(F.collect_list("e").alias("turned"))
    turned = F.concat(F.array_except("diff", "turned"), F.array_except("turned", "diff"))
    rows = rows.join(_side(most), "fam", "left").withColumn("diff", F.when(F.col("turned").isNull(), F.col("diff")).otherwise(turned))
    rows = rows.withColumn("d", F.size("diff").cast("long")).withColumn("excess", m.excess(F.col("d"), F.col("n")))
    rows = s.written(rows.select("fam", "sig", "n", "d", "diff", "excess"))
    best = s.written(rows.groupBy("fam").agg(F.min(F.struct("excess", "sig")).alias("best")).select("fam", F.col("best.sig").alias("centre"), F.col("best.excess").alias("least")))
    rows = rows.join(_side(best), "fam").withColumn("linked", F.expr("excess + least <= 0"))
    links = rows.filter("linked AND sig <> centre").select(F.col("sig").alias("a"), F.col("centre").alias("b"))
    # A pair of which one isn't linked has so many elements in common, or more.
    common = F.when(F.col("linked"), F.floor((F.col("excess") - F.col("least")) / m.cost) + 1).otherwise(F.ceil((F.col("excess") + F.col("least")) / m.cost))
    rare = often.withColumn("often", F.expr("IF(most, size - often, often)")).filter("often > 1").select("fam", "e", "often")
    shared = rows.select("fam", "sig", F.explode("diff").alias("e")).join(rare, ["fam", "e"]).groupBy("fam", "sig").agg(F.sort_array(F.collect_list(F.struct("often", "e")))["e"].alias("shared"))
    led = rows.join(shared, ["fam", "sig"]).withColumn("lead", (F.size("shared") - common + 1).cast("int")).filter("lead > 0")
    led = led.select(F.col("fam").alias("of"), F.explode(F.slice("shared", F.lit(1), F.col("lead"))).alias("e"), "centre", "sig", "n", "d", "linked", "diff")
    return led.select(F.xxhash64("of", "e").alias("fam"), *led.columns[2:]), links


def _side(df: DataFrame) -> DataFrame:
    """A small table goes to every task; others are shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _resolved(m: Measure, families: DataFrame, s: Scratch) -> tuple[list[DataFrame], DataFrame | None]:
    """(links (a, b) within families; groups (key, sig) that need a centre of their own, or None)."""
    links, left = [], None
    while True:
        sizes = families.groupBy("fam").agg(F.count("*").alias("members"), F.sum(F.size("diff").cast("long")).alias("elements"), F.min("linked").alias("all"))
        sizes = s.written(sizes.filter("members > 1 AND NOT all").drop("all"))
        large = (F.col("members") > MEMBERS) | ((F.col("elements") > ELEMENTS) & (F.col("members") > FEW))
        small = families.join(_side(sizes.filter(~large).select("fam")), "fam", "left_semi")
        links.append(s.written(small.repartition("fam").sortWithinPartitions("fam").mapInArrow(_settle(m), "a long, b long")))
        sizes = s.written(sizes.filter(large).withColumn("light", F.expr(f"elements <= {LIGHT} * members")))
        if sizes.isEmpty():
            return links, left
        rows = s.written(families.join(_side(sizes), "fam"))
        if not sizes.filter("NOT light").isEmpty():
            groups, beside = _split(m, rows.filter("NOT light"), s)
            groups = s.written(groups.select(F.col("fam").alias("key"), "sig"))
            left = groups if left is None else left.unionByName(groups)
            links.append(s.written(beside))
        families, beside = _split(m, rows.filter("light"), s)
        families = s.written(families)
        links.append(s.written(beside))


def _stars(groups: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """((centre, sig, last) of the members (key, sig) of each group, (key, centre, sig)); a centre is the member that is in most groups.

    ``last`` are those of whose groups none has a third member, so no pair beside theirs.
    """
    groups = s.written(groups)
    often = groups.groupBy("sig").agg(F.count("*").alias("often"))
    centres = groups.join(often, "sig").groupBy("key").agg(F.max(F.struct("often", "sig"))["sig"].alias("centre"), (F.count("*") == 2).alias("last"))
    centres = s.written(centres)  # a plain side: a hot key of the other can be split
    keyed = groups.join(centres, "key").filter("sig <> centre")
    return s.written(keyed.groupBy("centre", "sig").agg(F.min("last").alias("last"))), keyed.filter("NOT last").select("key", "centre", "sig")


def _groups(index: DataFrame, s: Scratch) -> DataFrame:
    """(key, sig) of the keys that several texts share, one of them in its own band.

    The index is made twice, which takes less than to keep it; only the number of texts that have a key is shuffled at first.
    """
    native = 1 << 40  # above all counts
    shared = index.groupBy("key").agg(F.sum(F.when(F.col("native"), native + 1).otherwise(1)).alias("n")).filter(f"n > {native} AND n % {native} > 1")
    return index.join(s.written(shared.select("key")), "key", "left_semi").select("key", "sig").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each node of the links (a, b): the least node that links reach.

    In each round a node takes the least label of itself, its neighbours and its label's
    label, so labels cross paths in jumps.
    """
    with Scratch(links.sparkSession) as s:
        edges = s.written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        labels = s.written(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"))
        while True:
            near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
            jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
            new = labels.join(near.withColumnRenamed("a", "node"), "node").join(jump, "label")
            new = s.written(new.select("node", F.least("label", "near", "beyond").alias("next"), F.col("label").alias("was")))
            labels = new.select("node", F.col("next").alias("label"))
            if new.filter("next <> was").isEmpty():
                return written(labels.withColumnRenamed("label", "component"))


def _texts(docs: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sig, text) of each ``wanted`` set, from the least of its rows. Only texts of rows that repeat are shuffled to leave one."""
    times = rows.groupBy("sig", "row").agg(F.count("*").alias("times"))  # before the sets meet, so that one with many copies stays spread
    least = times.groupBy("sig").agg(F.min(F.struct("row", "times")).alias("least"))
    chosen = written(least.join(wanted, "sig", "left_semi").select("sig", "least.*"))
    some = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    found = docs.select("row", "text").join(some, "row")
    once = found.filter("times = 1").select("sig", "text")
    if chosen.filter("times > 1").isEmpty():
        return once
    return once.unionByName(found.filter("times > 1").select("sig", "text").dropDuplicates(["sig"]))


@dataclass
class Join:
    """``rows``: row, id, n, sig of each text; ``labels``: (sig, component) of the sets that link with others; None without links."""

    rows: DataFrame
    labels: DataFrame | None
    rounds: int


def join(docs: DataFrame, m: Measure, id_col: str = "doc_id", text_col: str = "text") -> Join:
    """Components of all links between sets of different content.

    A set's links to members of a group are found as far as they join components; sets
    linked to one centre aren't compared with each other.
    """
    text = F.col(text_col)
    spark = docs.sparkSession
    docs = docs.select(F.xxhash64(F.col(id_col), text).alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    with small_batches(spark):
        rows = written(docs.mapInArrow(_profile(m), f"row long, id {kind}, n long, sig long"))
    own = rows.filter("id IS NOT NULL AND n > 0")
    # How many texts each band has: weights for the cost model, nothing else.
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(BAND) + 1e-9)
    bands = Layout(m, {r.band: r.n for r in own.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()})
    index = docs.filter("id IS NOT NULL").mapInArrow(_index(m, bands), "key long, sig long, native boolean")
    with small_batches(spark), Scratch(spark) as own_scratch:
        with Scratch(spark) as first:
            groups = own_scratch.written(_groups(index, first))
        pairs, keyed = _stars(groups, own_scratch)
        texts, links, rounds = None, [], 0
        while not pairs.isEmpty():
            rounds += 1
            if texts is None:
                # Later rounds compare sets of the first one only.
                wanted = pairs.select("sig").union(pairs.select(F.col("centre").alias("sig"))).distinct()
                texts = own_scratch.written(_texts(docs, own, wanted))
            with Scratch(spark) as now:
                centres = pairs.select(F.col("centre").alias("sig")).distinct()
                of_centre = texts.join(_side(centres), "sig", "left_semi").select(F.col("sig").alias("centre"), F.col("text").alias("centre_text"))
                compared = texts.join(_side(pairs), "sig").join(of_centre, "centre").select("centre", "sig", "last", "text", "centre_text")
                compared = now.written(compared.mapInArrow(_verify(m), "centre long, sig long, linked boolean, n long, d long, diff array<long>, far binary"))
                found, left = _resolved(m, _families(m, compared, keyed, texts, now), now)
                found.append(compared.filter("linked").select(F.col("centre").alias("a"), F.col("sig").alias("b")))
                links.append(own_scratch.written(reduce(DataFrame.unionByName, found)))
                if left is None:
                    break
                pairs, keyed = _stars(left.distinct(), own_scratch)
        if not links:
            return Join(rows, None, rounds)
        return Join(rows, components(reduce(DataFrame.unionByName, links)).withColumnRenamed("node", "sig"), rounds)


def grouped(found: Join) -> DataFrame:
    """``row, id, n, component`` of each text: the least id that links reach."""
    labelled = found.rows.withColumn("component", F.col("sig")) if found.labels is None else found.rows.join(found.labels, "sig", "left")
    # Texts without shingles, and rows without id, stand alone.
    alone = F.col("n").eqNullSafe(0) | F.col("id").isNull()
    labelled = written(labelled.select("row", "id", "n", F.when(~alone, F.coalesce("component", "sig")).alias("class")))
    least = written(labelled.filter("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("component"), F.count("*").alias("size")).filter("size > 1").select("class", "component"))
    return labelled.join(least, "class", "left").select("row", "id", "n", F.coalesce("component", "id").alias("component"))


#: The contract of op9: three words, 0.9. Near-duplicate stages elsewhere take five words, 0.8.
OP9, NEAR = Measure(3, 90, 100), Measure(5, 80, 100)


def without_near_duplicates(docs: DataFrame, m: Measure = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that with the least id, and of rows that share it, one.

    Rows without shingles or without an id stay.
    """
    groups = grouped(join(docs, m, id_col, text_col)).filter("id IS NOT NULL AND n > 0")
    keeper = written(groups.groupBy("component").agg(F.min(F.struct("id", "row")).alias("keeper"), F.count("*").alias("size")).filter("size > 1"))
    members = groups.join(keeper, "component").select("row", (F.col("row") == F.col("keeper.row")).alias("stays"))
    found = written(members.groupBy("row").agg(F.first("stays").alias("stays"), F.count("*").alias("times")).filter("NOT stays OR times > 1"))
    row, mark = F.xxhash64(F.col(id_col), F.col(text_col)), unused(docs, "row")
    small = found.count() <= BROADCAST_ROWS
    side = lambda rows: F.broadcast(rows) if small else rows
    keyed = docs.withColumn(mark, row)
    once = keyed.join(side(found.select(F.col("row").alias(mark))), mark, "left_anti")
    several = keyed.join(side(found.filter("stays").select(F.col("row").alias(mark))), mark, "left_semi").dropDuplicates([mark])
    return once.unionByName(several).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document."""
    groups = grouped(join(table(spark, folder, "documents"), OP9))
    return groups.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
ORACLES = {
    "op9_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS p FROM w WHERE len(ws) > 0
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p : p + 2], ' ') AS x FROM p
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), k AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.a = d.doc_id
"""
}
