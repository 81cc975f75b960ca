"""Scores of texts under a probabilistic suffix tree, and under smoothed word counts.

The tree predicts the next byte of a UTF-8 text, or its end, from a context of up
to ``DEPTH`` symbols. Contexts that occur ``MIN_COUNT`` times are candidates, whatever
the size of the corpus; one is retained if its next symbols diverge from those after
its suffix by more than ``MIN_GAIN`` nats over all its occurrences. Distributions are
smoothed towards the longest retained suffix's.

A context and its next symbol are a gram. The grams of all training texts are counted
once, at full depth. Grams whose contexts share their last ``SPLIT`` symbols are dealt to
one place, in order, and hold the whole subtree below those: counts at all its levels, tests and
probabilities need no further shuffle. Contexts shorter than ``SPLIT`` go to every task;
UTF-8 allows under four million grams of them. The most frequent ``HEAD_GRAMS`` grams with their
probabilities go to every task that scores, the others of each text meet theirs in a join.

Counts of words and byte strings cover every training text. Scores by word counts
need the count of each word: the most frequent ``HEAD`` words go to every task,
rarer ones meet their counts in the same join.

A-Z count as a-z throughout. Null and empty texts consist of the end alone. A row with a null id is a training
row. Repeated rows count each time. Without training rows every symbol is equally
likely. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textarrays as ta
from tessera.llm.shared import small_batches, written
from tessera.sources.tables import table

DEPTH = 6
#: Symbols before the next that grams of one place share.
SPLIT = 3
MIN_COUNT = 2
MIN_GAIN = 10.0
#: Weight of the suffix's distribution, in symbols.
SMOOTHING = 8.0
#: Words whose counts, and grams whose probabilities every task holds.
HEAD, HEAD_GRAMS = 1 << 18, 1 << 21
#: Symbols: bytes, the end of a text, what stands before its first byte, and what fills up stretches.
END, BEFORE, NONE = 256, 257, 258
BITS = 9
#: Symbols scored in a stretch, and counts that a task holds before it merges them.
STRETCH, HELD = 256, 3_000_000
#: Text bytes that a task counts or scores at a time; each takes some 50 bytes of memory meanwhile.
SLICE_BYTES = 1 << 20
#: Grams of whole subtrees that a task takes at a time, if it can.
TAKEN = 1_000_000
WORD, GRAM = 0, 1


def is_held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 on division by 7."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _symbols(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(DEPTH times BEFORE, the bytes and END of each text; where each text's first byte is)."""
    data, ends = ta.raw(text)
    size = np.diff(ends)
    first = ends[:-1] + np.arange(len(size)) * (DEPTH + 1) + DEPTH
    out = np.full(len(data) + len(size) * (DEPTH + 1), BEFORE, np.int64)
    out[np.arange(len(data)) + (ta.owner(ends) + 1) * (DEPTH + 1) - 1] = data
    out[first + size] = END
    return out, first


def _grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(each byte or end of the texts behind the DEPTH symbols before it, packed; its text)."""
    symbols, _ = _symbols(text)
    packed = np.zeros(len(symbols) - DEPTH, np.int64) if len(symbols) else np.zeros(0, np.int64)
    for d in range(DEPTH + 1):
        packed = packed << BITS | symbols[d : len(packed) + d]
    _, ends = ta.raw(text)
    return packed[symbols[DEPTH:] != BEFORE], np.repeat(np.arange(len(text)), np.diff(ends) + 1)


class _Sums:
    """Sums by key; merged when many are held."""

    def __init__(self) -> None:
        self.limit = HELD
        self.clear()

    def clear(self) -> None:
        self.keys, self.n, self.held, self.distinct = [], [], 0, 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.keys.append(keys)
        self.n.append(n)
        self.held += len(keys)
        if self.held > min(self.limit, max(self.limit // 3, self.distinct + self.distinct // 2)):  # never far above what is distinct
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Each array goes as soon as the next one is there: what is held is copied once, not four times.
        keys, self.keys = np.concatenate(self.keys), []
        order = np.argsort(keys, kind="stable")  # merges runs, which ascend already
        keys = keys[order]
        n, self.n = np.concatenate(self.n), []
        n = n[order]
        del order
        first = np.flatnonzero(np.append(np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))
        keys = keys[first]
        n = np.add.reduceat(n, first) if len(first) else n
        self.keys, self.n, self.held, self.distinct = [keys], [n], len(keys), len(keys)
        return keys, n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(kind: int, sums: _Sums) -> Iterator[pa.RecordBatch]:
        keys, n = sums.merge()
        for i in range(0, len(keys), 100_000):
            k = keys[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[i : i + 100_000])], names=["kind", "key", "n"])
        sums.clear()

    words, grams = _Sums(), _Sums()
    for _, text in ta.slices(batches, "text", SLICE_BYTES):
        text = ta.lowered(text)
        ids, distinct, _ = ta.words(text)
        n = np.bincount(ids, minlength=len(distinct))
        words.add(ta.hashes(distinct).view(np.int64)[n > 0], n[n > 0])
        grams.add(*np.unique(_grams(text)[0], return_counts=True))
        for kind, sums in ((WORD, words), (GRAM, grams)):
            if sums.distinct > sums.limit // 2:
                yield from rows(kind, sums)  # a task's memory doesn't grow with its input
    yield from rows(WORD, words)
    yield from rows(GRAM, grams)


def _mask(n: int) -> int:
    """The last ``n`` symbols of what is packed."""
    return (1 << BITS * n) - 1


@dataclass
class Level:
    """Contexts of one length: their grams (ascending) and, by gram, its count, its context's, and whether that is retained."""

    grams: np.ndarray
    n: np.ndarray
    total: np.ndarray
    kept: np.ndarray

    @classmethod
    def of(cls, depth: int, keys: np.ndarray, n: np.ndarray, up: Level | None) -> Level:
        """From counts of all longer or equal grams whose contexts end alike; ``up`` is the level one symbol shorter.

        A candidate is compared with that suffix; what is shared by both is smoothed alike.
        """
        grams, back = np.unique(keys & _mask(depth + 1), return_inverse=True)
        n = np.bincount(back, n, len(grams)).astype(np.int64)
        _, context = np.unique(grams >> BITS, return_inverse=True)
        total = np.bincount(context, n).astype(np.int64)[context] if len(grams) else n
        if up is None:
            return cls(grams, n, total, np.ones(len(grams), bool))
        at, seen = np.searchsorted(up.grams, grams & _mask(depth)), n > 0
        gain = np.zeros(len(grams))
        gain[seen] = n[seen] * np.log(n[seen] / total[seen] * up.total[at[seen]] / up.n[at[seen]])
        return cls(grams, n, total, (total >= MIN_COUNT) & ((np.bincount(context, gain)[context] if len(grams) else gain) > MIN_GAIN))

    def rows(self, grams: np.ndarray) -> Level:
        """The level for ``grams`` alone, which may lack a count or a context."""
        n, _ = _looked_up(self.grams, self.n, grams)
        contexts, first = np.unique(self.grams >> BITS, return_index=True)
        total, _ = _looked_up(contexts, self.total[first], grams >> BITS)
        kept, _ = _looked_up(contexts, self.kept[first], grams >> BITS)
        return Level(grams, n, total, kept.astype(bool))


def _shallow(grams: DataFrame) -> list[Level]:
    """The levels of contexts shorter than ``SPLIT``; UTF-8 bounds how many grams they have."""
    key = F.col("key").bitwiseAND(F.lit(_mask(SPLIT)))
    counts = grams.groupBy(key.alias("key")).agg(F.sum("n").alias("n")).toArrow()
    keys, n, levels = counts["key"].to_numpy(), counts["n"].to_numpy(), []
    for depth in range(SPLIT):
        levels.append(Level.of(depth, keys, n, levels[-1] if levels else None))
    return levels


def _levels(keys: np.ndarray, n: np.ndarray, shallow: list[Level]) -> list[Level]:
    """All levels of the subtrees that ``keys`` (any order, some perhaps without a count) are the grams of."""
    levels = [level.rows(np.unique(keys & _mask(depth + 1))) for depth, level in enumerate(shallow)]
    for depth in range(SPLIT, DEPTH + 1):
        levels.append(Level.of(depth, keys, n, levels[-1]))
    return levels


def _probability(levels: list[Level]) -> np.ndarray:
    """Of each gram of the last level, by the longest retained suffix of its context."""
    p = None
    for depth, level in enumerate(levels):
        if p is None:
            symbols = level.total.max(initial=0)
            p = (level.n + 0.5) / (symbols + 0.5 * (END + 1))
            continue
        p = p[np.searchsorted(levels[depth - 1].grams, level.grams & _mask(depth))]
        p = np.where(level.kept, (level.n + SMOOTHING * p) / (level.total + SMOOTHING), p)
    return p


def _subtree() -> Column:
    return F.shiftright("key", BITS).bitwiseAND(F.lit(_mask(SPLIT)))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The ordered rows of a task in tables of whole subtrees, ``TAKEN`` rows or more if there are so many."""
    held, rows, enough = [], 0, TAKEN
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        whole = pa.Table.from_batches(held)
        of = whole["key"].to_numpy() >> BITS & _mask(SPLIT)
        cut = int(np.searchsorted(of, of[-1]))
        if cut:
            yield whole.slice(0, cut)
        held, rows = whole.slice(cut).combine_chunks().to_batches(), len(whole) - cut
        enough = max(TAKEN, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held)


def _log10(grams: DataFrame, shallow: list[Level]) -> DataFrame:
    """(key, log10) of the rows of ``grams`` (key, n, asked) that are asked for; a gram's counts are added up."""
    sent = grams.sparkSession.sparkContext.broadcast(shallow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _subtrees(batches):
            keys = part["key"].to_numpy()
            levels = _levels(keys, part["n"].to_numpy(), sent.value)
            log = np.log10(_probability(levels))
            wanted = np.unique(keys[part["asked"].to_numpy()])
            yield pa.RecordBatch.from_arrays([pa.array(wanted), pa.array(log[np.searchsorted(levels[-1].grams, wanted)])], names=["key", "log10"])

    return grams.repartition(_subtree()).sortWithinPartitions(_subtree()).mapInArrow(run, "key long, log10 double")


def contexts(model: Model) -> DataFrame:
    """The tree as a table (depth, context, next, n): the root and the retained contexts; symbols are packed in ``BITS`` each, the last lowest."""
    sent = model.grams.sparkSession.sparkContext.broadcast(model.shallow)
    names = ["depth", "context", "next", "n"]

    def rows(levels: list[Level], least: int) -> Iterator[pa.RecordBatch]:
        for depth, level in enumerate(levels):
            if depth >= least:
                grams, n = level.grams[level.kept], level.n[level.kept]
                yield pa.RecordBatch.from_arrays([*map(pa.array, (np.full(len(grams), depth, np.int32), grams >> BITS, grams & _mask(1), n))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _subtrees(batches):
            yield from rows(_levels(part["key"].to_numpy(), part["n"].to_numpy(), sent.value), SPLIT)

    kind = "depth int, context long, next long, n long"
    deep = model.grams.repartition(_subtree()).sortWithinPartitions(_subtree()).mapInArrow(run, kind)
    return deep.unionByName(model.grams.sparkSession.createDataFrame(pa.Table.from_batches(list(rows(model.shallow, 0))), kind))


def _step(count: str) -> Column:
    """Counts in steps of one, from 256 on of a few per cent."""
    return F.when(F.col(count) < 256, F.col(count)).otherwise(256 + F.floor(F.log2(F.col(count) / 256.0) * 32))


def _least(counts: DataFrame, count: str, most: int) -> int:
    """The least step from which there are at most ``most`` rows, 0 if that is all of them: no sort."""
    held = 0
    for r in sorted(counts.groupBy(_step(count).alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.step):
        if held + r.n > most:
            return r.step + 1
        held += r.n
    return 0


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of the wanted keys, 0 for absent ones; which are there); ``keys`` ascend."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    there = keys[place] == wanted
    return np.where(there, values[place], 0), there


def _lists(values: np.ndarray, of: np.ndarray, rows: int) -> pa.Array:
    """A list of values for each row; ``of`` ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(rows + 1)).astype(np.int32)), pa.array(values))


@dataclass
class SuffixTree:
    """Automaton of the longest suffixes: next state and log10 probability by state and column of a symbol.

    It holds a whole tree in memory. Queries join the tree's table instead; tests compare the two.
    """

    column: np.ndarray
    goes: np.ndarray
    log10: np.ndarray
    start: int

    @classmethod
    def build(cls, depth: np.ndarray, context: np.ndarray, following: np.ndarray, n: np.ndarray) -> SuffixTree:
        """From counts of next symbols by context; depth 0 is the root."""
        seen = np.unique(following)
        column = np.full(NONE + 1, len(seen), np.int64)  # symbols that were never seen share a column
        column[seen] = np.arange(len(seen))
        column[[BEFORE, NONE]] = len(seen) + 1, len(seen) + 2
        wide = len(seen) + 3
        counts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        order = np.lexsort((context, depth))
        depth, context, at, n = depth[order], context[order], column[following[order]], n[order].astype(float)
        cuts = np.flatnonzero(np.append(True, (depth[1:] != depth[:-1]) | (context[1:] != context[:-1]))) if len(depth) else np.zeros(0, int)
        for a, z in zip(cuts.tolist(), np.append(cuts, len(depth))[1:].tolist(), strict=True):
            counts[int(depth[a]), int(context[a])] = at[a:z], n[a:z]
        counts.setdefault((0, 0), (at[:0], n[:0]))
        states = {(d - i, c >> BITS * i) for d, c in counts for i in range(d + 1)}  # closed under dropping the last symbol
        order = sorted(states)
        number = {s: i for i, s in enumerate(order)}
        goes, p = np.zeros((len(order), wide), np.int32), np.zeros((len(order), wide), np.float32)
        by_prefix: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for d, c in order[1:]:
            by_prefix.setdefault((d - 1, c >> BITS), []).append((column[c & ((1 << BITS) - 1)], number[d, c]))
        for i, (d, c) in enumerate(order):
            up = next((number[k, c & ((1 << BITS * k) - 1)] for k in range(d - 1, -1, -1) if (k, c & ((1 << BITS * k) - 1)) in number), None)
            cols, own = counts.get((d, c), (None, None))
            if up is None:
                p[i] = 0.5 / (own.sum() + 0.5 * (END + 1))
                np.add.at(p[i], cols, own / (own.sum() + 0.5 * (END + 1)))
            else:
                p[i], goes[i] = p[up], goes[up]
                if own is not None:
                    p[i] *= SMOOTHING / (own.sum() + SMOOTHING)
                    np.add.at(p[i], cols, own / (own.sum() + SMOOTHING))
            for col, to in by_prefix.get((d, c), ()):
                goes[i, col] = to
        p[:, column[[BEFORE, NONE]]] = 1.0
        goes[:, column[NONE]] = 0
        start = 0
        for _ in range(DEPTH):
            start = int(goes[start, column[BEFORE]])
        return cls(column, goes, np.log10(p, out=p), start)

    def score(self, text: pa.Array) -> np.ndarray:
        """log10 probability of each text: of its bytes in order and its end."""
        symbols, first = _symbols(text)
        length = np.append(first[1:], len(symbols) + DEPTH) - DEPTH - first
        pieces = -(-length // STRETCH)
        of = np.repeat(np.arange(len(length)), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, end = first[of] + nth * STRETCH, (first + length)[of]
        columns = np.append(self.column[symbols], self.column[NONE])
        width, total = self.goes.shape[1], np.zeros(len(of))
        goes, log10 = self.goes.ravel(), self.log10.ravel()
        state = np.zeros(len(of), np.int64)
        for t in range(-DEPTH, STRETCH):  # a state depends on the last DEPTH symbols alone
            at = begin + t
            cell = state * width + columns[np.where(at < end, at, len(symbols))]
            if t >= 0:
                total += log10[cell]
            state = goes[cell].astype(np.int64)
        return np.bincount(of, total, len(length))


@dataclass
class Model:
    """Counts of all grams (key, n), the levels of short contexts, and of grams and words the most frequent; the counts of all words are in ``words`` (h, c)."""

    grams: DataFrame | None
    shallow: list[Level]
    often: np.ndarray
    often_log10: np.ndarray
    head: np.ndarray
    head_counts: np.ndarray
    complete: bool
    ends: int
    tokens: int
    distinct: int


def fit(docs: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """(model, counts of all words) of the texts of all rows."""
    partial = docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "kind int, key long, n long")
    with small_batches(docs.sparkSession):
        counts = written(partial.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words, grams = counts.filter(F.col("kind") == WORD).select(F.col("key").alias("h"), F.col("n").alias("c")), counts.filter(F.col("kind") == GRAM).select("key", "n")
    w = words.agg(F.count("*").alias("distinct"), F.coalesce(F.sum("c"), F.lit(0)).alias("tokens")).first()
    shallow = _shallow(grams)
    ends = int(shallow[0].n[shallow[0].grams == END].sum())
    often = _log10(grams.withColumn("asked", _step("n") >= _least(grams, "n", HEAD_GRAMS)), shallow).toArrow().sort_by("key")
    least = _least(words, "c", HEAD)
    head = words.filter(_step("c") >= least).toArrow().sort_by("h")
    return Model(grams, shallow, often["key"].to_numpy(), often["log10"].to_numpy(), head["h"].to_numpy(), head["c"].to_numpy(), least == 0, ends, w.tokens + ends, w.distinct + (ends > 0)), words


def score(docs: DataFrame, model: Model, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row ``id, n_tokens, n_known, base_score, score``."""
    sent = docs.sparkSession.sparkContext.broadcast(replace(model, grams=None, shallow=[]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = sent.value, TaskContext.get().partitionId() << 40
        for part, text in ta.slices(batches, "text", SLICE_BYTES):
            text = ta.lowered(text)
            ids, distinct, offsets = ta.words(text)
            h = ta.hashes(distinct).view(np.int64)
            c, known = _looked_up(m.head, m.head_counts, h)
            log = np.bincount(ta.owner(offsets), np.log10(c + 1.0)[ids], len(text))
            n_known = ta.per_text(known[ids], offsets)
            if m.ends:
                log, n_known = log + np.log10(m.ends + 1.0), n_known + 1
            rare = np.zeros(len(ids), bool) if m.complete else ~known[ids]
            grams, of = _grams(text)
            grams, back = np.unique(grams, return_inverse=True)
            p, there = _looked_up(m.often, m.often_log10, grams)
            missed = ~there[back]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(text))), part["id"], *map(pa.array, (np.diff(offsets) + 1, n_known, log, np.bincount(of, p[back], len(text)))),
                 _lists(h[ids[rare]], ta.owner(offsets)[rare], len(text)), _lists(grams[back[missed]], of[missed], len(text))],
                names=["row", "id", "n_tokens", "head_known", "head_log", "head_score", "words", "grams"],
            )
            row += len(text)

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    with small_batches(docs.sparkSession):
        seen = written(own.mapInArrow(run, f"row long, id {kind}, n_tokens long, head_known long, head_log double, head_score double, words array<long>, grams array<long>"))
    asked = seen.select(F.explode("grams").alias("key")).distinct().select("key", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked"))
    log10 = _log10(model.grams.withColumn("asked", F.lit(False)).unionByName(asked), model.shallow)
    values = words.select(F.lit(WORD).alias("kind"), F.col("h").alias("key"), F.log10(F.col("c") + 1).alias("value")).unionByName(log10.select(F.lit(GRAM).alias("kind"), "key", F.col("log10").alias("value")))
    rest = seen.select("row", F.lit(WORD).alias("kind"), F.explode("words").alias("key")).unionByName(seen.select("row", F.lit(GRAM).alias("kind"), F.explode("grams").alias("key")))
    word = F.col("kind") == WORD
    sums = rest.join(values, ["kind", "key"]).groupBy("row").agg(F.count(F.when(word, 1)).alias("rare_known"), F.sum(F.when(word, F.col("value"))).alias("rare_log"), F.sum(F.when(~word, F.col("value"))).alias("rare_score"))
    none = F.lit(0.0)
    log = F.col("head_log") + F.coalesce("rare_log", none) - F.col("n_tokens") * float(np.log10(model.tokens + model.distinct + 1))
    return seen.drop("words", "grams").join(sums, "row", "left").select("id", "n_tokens", (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), log.alias("base_score"), (F.col("head_score") + F.coalesce("rare_score", none)).alias("score"))


def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Both scores of every document, learnt from those that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model, words = fit(docs.filter(~is_held_out()))
    scored = score(docs, model, words)
    return scored.select(
        F.col("id").alias("doc_id"), is_held_out("id").alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


QUERIES = {"op4_lm_scoring": op4_lm_scoring}
ORACLES: dict[str, str] = {}
