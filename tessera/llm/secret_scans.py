"""Secrets in texts: base patterns, and character Markov models for the rest.

Patterns find assignments of secrets, access keys and hexadecimal runs. Two first-order Markov
models over ASCII characters are trained on the whole corpus, one on the values
that the patterns label as secret, one on ordinary runs outside every pattern. The
labelled values of a corpus may all be hexadecimal; so that the first model knows random strings of
any alphabet, it is mixed with equal chances of all key characters. A stretch of key characters
that no pattern covers is a secret when the log-likelihood
ratio of the two models exceeds the log odds of ordinary runs by a margin.

Training sends only counts of character pairs, at most 2 x 128 x 128 rows, so the
models have a fixed size whatever the corpus. Scanning is one pass without a
shuffle.

Null and empty texts have no secrets. Positions are code points, the end is
exclusive. Without any labelled secret no run is judged secret. Repeated rows are
scanned alike. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textarrays as ta
from tessera.sources.tables import table

#: Kinds of span in their order; the last is found by the models.
KINDS = ("assign", "access", "hex", "model")
# Fixed patterns. Letter case is spelt out: only ASCII letters fold.
_FOLD = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_NAMES = "|".join([*map(_FOLD, ("password", "passwd", "secret", "token")), f"{_FOLD('api')}_?{_FOLD('key')}"])
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".encode())
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
#: Characters and least length of a run that the models judge.
RUN, MIN_RUN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 16
#: Nats by which the evidence must exceed the odds.
MARGIN = 6.0
#: Weight of equal chances of all key characters in the model of secrets.
EVEN = 0.5


def _class(chars: str) -> np.ndarray:
    there = np.zeros(256, bool)
    there[list(chars.encode())] = True
    return there


_HEX, _UPPER, _RUN = _class("0123456789abcdef"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), _class(RUN)


def _runs(there: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """(start, end) of the maximal runs of at least ``least`` bytes; none crosses texts."""
    edge = np.zeros(len(there) + 1, bool)
    edge[ends] = True
    on = np.flatnonzero(there & (edge[:-1] | ~np.append(False, there[:-1])))
    off = np.flatnonzero(there & (edge[1:] | ~np.append(there[1:], False))) + 1
    long = off - on >= least
    return np.column_stack([on[long], off[long]])


@dataclass
class Found:
    """Spans of a part: text, kind, start and end in bytes; the labelled values; the runs outside every pattern."""

    spans: np.ndarray
    values: np.ndarray
    runs: np.ndarray


def find(text: pa.Array) -> tuple[Found, np.ndarray, np.ndarray]:
    """(what the patterns find, bytes, offsets)."""
    data, ends = ta.raw(text)
    whole, spans, values = data.tobytes(), [], []
    marked = np.flatnonzero(ta.per_text((data == 58) | (data == 61), ends))  # texts with a colon or an equals sign
    for t in marked:
        for m in ASSIGN.finditer(whole, ends[t], ends[t + 1]):
            if m.end(2) - m.start(2) >= MIN_ASSIGN:
                spans.append((t, 0, m.start(), m.end()))
                values.append((m.start(2), m.end(2)))
    if b"AKIA" in whole:
        # A run of key characters holds one match at most: from its first AKIA that more characters follow.
        for a, z in _runs(_UPPER[data], ends, MIN_ACCESS):
            at = whole.find(b"AKIA", a, z)
            if at >= 0 and z - at >= MIN_ACCESS:
                spans.append((int(np.searchsorted(ends, at, "right")) - 1, 1, at, int(z)))
                values.append((at, int(z)))
    hexes = _runs(_HEX[data], ends, MIN_HEX)
    of = np.searchsorted(ends, hexes[:, 0], "right") - 1
    spans += [(int(t), 2, int(a), int(z)) for t, (a, z) in zip(of, hexes, strict=True)]
    values += [(int(a), int(z)) for a, z in hexes]
    table_ = np.array(spans, np.int64).reshape(-1, 4)
    covered = np.zeros(len(data) + 1, np.int64)
    np.add.at(covered, table_[:, 2], 1)
    np.add.at(covered, table_[:, 3], -1)
    runs = _runs(_RUN[data] & (np.cumsum(covered)[:-1] == 0), ends, MIN_RUN)
    values = np.unique(np.array(values, np.int64).reshape(-1, 2), axis=0)
    return Found(table_, values, runs), data, ends


def _pairs(data: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair code 128 x before + character, number of its span); the character before a span is 0."""
    size = spans[:, 1] - spans[:, 0]
    of = np.repeat(np.arange(len(spans)), size)
    at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + spans[of, 0]
    before = np.where(at == spans[of, 0], 0, data[at - 1] & 127).astype(np.int64)
    return before * 128 + (data[at] & 127), of


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 128 * 128), np.int64)
    for _, text in ta.slices(batches, "text"):
        found, data, _ = find(text)
        for kind, spans in enumerate((found.runs, found.values)):
            counts[kind] += np.bincount(_pairs(data, spans)[0], minlength=128 * 128)
            counts[kind, 0] += len(spans)  # the pair (0, 0) counts spans
    kind, pair = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(counts[kind, pair])], names=["kind", "pair", "n"])


@dataclass
class SecretModel:
    """Log-likelihood ratio of each character pair, and the sum from which a run is secret."""

    ratio: np.ndarray
    least: float

    @classmethod
    def fit(cls, counts: np.ndarray, margin: float = MARGIN) -> SecretModel:
        """From counts of pairs: row 0 of ordinary runs, row 1 of secrets."""
        spans, pairs = counts[:, 0].copy(), counts.copy()
        pairs[:, 0] = 0
        log = []
        for one in pairs.reshape(2, 128, 128).astype(float):
            share = (one.sum(0) + 0.5) / (one.sum() + 64)  # of a character alone: what a rare row falls back to
            log.append((one + 8 * share) / (one.sum(1, keepdims=True) + 8))
        log = np.log([log[0], (1 - EVEN) * log[1] + EVEN * (_RUN[:128] / len(RUN))])
        odds = np.log((spans[0] + 1) / (spans[1] + 1))
        return cls((log[1] - log[0]).ravel(), max(0.0, float(odds)) + margin if spans[1] else np.inf)

    def secret(self, data: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """Whether each run is a secret."""
        pairs, of = _pairs(data, runs)
        return np.bincount(of, self.ratio[pairs], minlength=len(runs)) > self.least


def fit(docs: DataFrame, text_col: str = "text") -> SecretModel:
    """Models of the values and runs of every text."""
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "kind int, pair int, n long").groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, 128 * 128), np.int64)
    for r in rows:
        counts[r.kind, r.pair] = r.n
    return SecretModel.fit(counts)


def _scanned(text: pa.Array, model: SecretModel) -> tuple[list[list[tuple[int, int, int]]], np.ndarray, list[tuple[int, int]]]:
    """(spans of each text by start and kind, their bytes, offsets)."""
    found, data, ends = find(text)
    own = found.runs[model.secret(data, found.runs)]
    extra = np.column_stack([np.searchsorted(ends, own[:, 0], "right") - 1, np.full(len(own), 3), own])
    spans = np.vstack([found.spans, extra])
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(text))]
    for t, kind, a, z in spans[np.lexsort((spans[:, 1], spans[:, 2]))].tolist():
        out[t].append((a, z, kind))
    return out, data, ends


def scan(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id and ``spans``: kind, start and end in code points, by start and kind."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text in ta.slices(batches, "text"):
            spans, data, ends = _scanned(text, sent.value)
            point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            rows = [[{"kind": KINDS[k], "start": int(point[a] - point[ends[t]]), "end": int(point[z] - point[ends[t]])} for a, z, k in own] for t, own in enumerate(spans)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(rows, pa.list_(kind))], names=["doc_id", "spans"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame, model: SecretModel, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each stretch of secret characters replaced by ``mark``; null texts stay null."""
    sent, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text in ta.slices(batches, text_col):
            spans, data, ends = _scanned(text, sent.value)
            if any(spans):
                whole, old, new = data.tobytes(), part[text_col].to_pylist(), []
                for t, own in enumerate(spans):
                    if not own:
                        new.append(old[t])
                        continue
                    pieces, at = [], int(ends[t])
                    for a, z, _ in own:
                        if a >= at:
                            pieces += [whole[at:a], mark.encode()]
                        at = max(at, z)
                    new.append(b"".join([*pieces, whole[at : ends[t + 1]]]).decode())
                part = part.set_column(names.index(text_col), text_col, pa.array(new, pa.string()))
            yield part

    return docs.mapInArrow(run, docs.schema)


def op2_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of every document: numbers by kind, the digest of the base spans and all spans."""
    docs = table(spark, folder, "documents")
    spans = scan(docs, fit(docs))
    line = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "model")
    return spans.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(line(base).cast("binary"), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
        count("model").alias("n_model"),
    )


QUERIES = {"op2_secret_scans": op2_secret_scans}
ORACLES: dict[str, str] = {}
