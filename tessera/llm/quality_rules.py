"""Rule statistics of documents and an isolation forest over them.

``statistics`` computes counts of a text (words, symbols, repeated lines and word
triples). Ratios of style feed an isolation forest: trees of random splits in which
odd documents end after few steps. The forest and its threshold come from
labelled rows; the threshold is the lowest that loses at most ``MAX_GOOD_LOSS`` of
the rows labelled good. Forest and threshold are small, so judging all documents
is one pass over their texts without a shuffle.

Null and empty texts have zero words and fail the base rules. Null labels are
left out; a document with several labels counts as its worst. Without a labelled
row of either kind nothing is anomalous and the base rules decide alone. Repeated
rows are judged alike; of rows that share a labelled id, that with the least text counts. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textarrays as ta
from tessera.llm.shared import bounded_sample, unused
from tessera.sources.tables import table

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Labelled rows that the forest is fitted on at most, those with the least hash of their id.
MAX_LABELLED = 20_000
#: Small samples: odd kinds of document that are themselves common still stand apart in them.
TREES, SUBSAMPLE = 200, 64
#: Share of good labelled rows that the threshold may reject.
MAX_GOOD_LOSS = 0.003

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Style of the text. Repetition has a base rule, and length, digits or word lengths are no fault of a document.
RATIOS = ("symbols_per_word", "upper", "marks_per_word", "bare_words")


def statistics(text: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(the counts of each text, a row of ratios for each text)."""
    n = len(text)
    ids, distinct, offsets = ta.words(text)
    data, ends = ta.raw(text)
    lengths = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    n_words, word_chars = np.diff(offsets), ta.per_text(lengths[ids], offsets)

    def bytes_in(chars: str) -> np.ndarray:
        there = np.zeros(256, np.int64)
        there[list(chars.encode())] = 1
        return ta.per_text(there[data], ends)

    n_symbols = bytes_in("#*$%&|<>")

    lines = pc.split_pattern(text, "\n")
    flat = lines.flatten().dictionary_encode()
    line_ends = lines.offsets.to_numpy().astype(np.int64)
    line_ends -= line_ends[0]
    worded = pc.match_substring_regex(flat.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False).astype(bool)
    line_ids, line_of = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), ta.owner(line_ends)
    keep = worded[line_ids] if len(line_ids) else np.zeros(0, bool)
    once = np.unique(line_of[keep] * max(1, len(flat.dictionary)) + line_ids[keep])
    n_lines = np.bincount(line_of[keep], minlength=n)
    n_dup_lines = n_lines - np.bincount(once // max(1, len(flat.dictionary)), minlength=n)

    repeated = np.zeros(len(ids), bool)
    of = ta.owner(offsets)
    at = np.flatnonzero(of[2:] == of[:-2])
    if len(at):
        h = ta.mixed(ta.hashes(distinct))[ids]
        key = ta.mixed(ta.mixed(ta.mixed(h[at]) + h[at + 1]) + h[at + 2]) ^ ta.mixed(of[at].astype(np.uint64) + np.uint64(1))
        _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
        for k in range(3):
            repeated[at[counts[back] > 1] + k] = True
    n_repeat_words = ta.per_text(repeated, offsets)

    latin_upper = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)
    latin = data[:-1] == 0xC3 if len(data) else np.zeros(0, bool)
    pad = lambda x: np.append(x, False)[: len(data)]
    upper = ta.per_text((data >= 65) & (data <= 90) | pad(latin_upper), ends)
    letters = ta.per_text((data >= 65) & (data <= 90) | (data >= 97) & (data <= 122) | pad(latin), ends)
    bare = pc.match_substring_regex(distinct, r"^[^A-Za-z0-9\x80-\x{10FFFF}]*$").to_numpy(zero_copy_only=False).astype(np.int64)
    counts_of = dict(zip(COUNTS, (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), strict=True))
    w = np.maximum(n_words, 1)
    bare_words = ta.per_text(bare[ids] if len(ids) else ids, offsets)
    ratios = [n_symbols / w, upper / np.maximum(letters, 1), bytes_in("!?") / w, bare_words / w]
    return counts_of, np.column_stack(ratios).astype(np.float64)


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Too few words, or too many of them in repeated triples."""
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED_PERCENT * counts["n_words"])


def _harmonic(n: np.ndarray) -> np.ndarray:
    """Mean path length in a random tree over n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Random trees as arrays: each node has a feature (-1 in a leaf), a cut, its left child and, in a leaf, its path length."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    norm: float
    threshold: float = np.inf

    @classmethod
    def fit(cls, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7) -> IsolationForest:
        rng = np.random.default_rng(seed)
        size = min(subsample, len(rows))
        deepest = int(np.ceil(np.log2(max(size, 2))))
        grown = []
        for _ in range(trees if size else 0):
            feature, cut, left, path = [], [], [], []

            def new() -> int:
                for x, v in ((feature, -1), (cut, 0.0), (left, 0), (path, 0.0)):
                    x.append(v)
                return len(feature) - 1

            todo = [(new(), rows[rng.choice(len(rows), size, replace=False)], 0)]
            while todo:
                node, own, depth = todo.pop()
                low, high = own.min(0), own.max(0)
                open_ = np.flatnonzero(high > low)
                if depth >= deepest or len(own) < 2 or not len(open_):
                    path[node] = depth + float(_harmonic(len(own)))
                    continue
                f = int(rng.choice(open_))
                feature[node], cut[node] = f, rng.uniform(low[f], high[f])
                below = own[:, f] < cut[node]
                left[node] = new()
                new()
                todo += [(left[node], own[below], depth + 1), (left[node] + 1, own[~below], depth + 1)]
            grown.append((np.array(feature), np.array(cut), np.array(left), np.array(path)))
        return cls(grown, float(_harmonic(size)) or 1.0)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; near 1 for rows that random splits isolate early."""
        total = np.zeros(len(rows))
        for feature, cut, left, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (inner := np.flatnonzero(feature[at] >= 0)).size:
                node = at[inner]
                at[inner] = left[node] + (rows[inner, feature[node]] >= cut[node])
            total += path[at]
        return 2.0 ** -(total / max(1, len(self.trees)) / self.norm) if self.trees else np.zeros(len(rows))


def calibrated(forest: IsolationForest, rows: np.ndarray, good: np.ndarray, max_good_loss: float = MAX_GOOD_LOSS) -> float:
    """The lowest score that at most ``max_good_loss`` of the good rows exceed; infinite without rows of both kinds."""
    if not good.any() or good.all():
        return np.inf
    return float(np.quantile(forest.score(rows[good]), 1 - max_good_loss, method="higher"))


def _ratios_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, text in ta.slices(batches, "text"):
        counts, ratios = statistics(text)
        own = ~base_failed(counts)
        yield pa.RecordBatch.from_arrays([part["quality"].filter(pa.array(own)), *[pa.array(c) for c in ratios[own].T]], names=["quality", *RATIOS])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> IsolationForest:
    """Forest and threshold from at most ``max_labelled`` labelled rows that pass the base rules."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").cast("int").alias("quality"))
    known = bounded_sample(known, "id", max_labelled)  # so few rows that they are sent to every task
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    rows = rows.groupBy("id").agg(F.max("quality").alias("quality"), F.min("text").alias("text")).select("quality", "text")  # one row of those that share an id
    schema = "quality int, " + ", ".join(f"{r} double" for r in RATIOS)
    sample = rows.mapInArrow(_ratios_only, schema).toPandas()
    sample = sample.sort_values(list(sample.columns), kind="stable")  # the order of arrival varies
    values, good = sample[list(RATIOS)].to_numpy(), sample["quality"].to_numpy() > 0
    forest = IsolationForest.fit(values)
    forest.threshold = calibrated(forest, values, good)
    return forest


ADDED = ", ".join([*(f"{c} long" for c in COUNTS), "base_failed boolean", "kept boolean", "anomaly double"])


def assess(docs: DataFrame, forest: IsolationForest, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) of ``docs`` and the counts, ``base_failed``, ``kept`` and ``anomaly``.

    Added columns that share a name with a kept one replace it.
    """
    added = [x.split()[0] for x in ADDED.split(", ")]
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    model, whole = docs.sparkSession.sparkContext.broadcast(forest), unused(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text in ta.slices(batches, whole):
            counts, ratios = statistics(text)
            failed, anomaly = base_failed(counts), model.value.score(ratios)
            values = [*counts.values(), failed, ~failed & (anomaly <= model.value.threshold), anomaly]
            yield pa.RecordBatch.from_arrays([*[part[c] for c in names], *map(pa.array, values)], names=[*names, *added])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
    return docs.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).alias(whole)).mapInArrow(run, schema + ADDED)


def without_rejected(docs: DataFrame, forest: IsolationForest, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that the base rules and the forest keep, with all their columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text in ta.slices(batches, text_col):
            counts, ratios = statistics(text)
            yield part.filter(pa.array(~base_failed(counts) & (model.value.score(ratios) <= model.value.threshold)))

    return docs.mapInArrow(run, docs.schema)


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every document."""
    docs = table(spark, folder, "documents")
    return assess(docs, fit(docs, table(spark, folder, "labels")), keep=("doc_id",))


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES: dict[str, str] = {}
