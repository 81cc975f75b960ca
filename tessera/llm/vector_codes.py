"""Vector codes by product quantisation in integers, under adaptive distance bounds.

A component x counts as floor(``SCALE`` * x). Vectors are cut into ``PARTS`` equal parts; each
position has a codebook, which starts as that part of the vectors with the ``ENTRIES`` smallest ids.
A round assigns every part to the nearest entry (squared distance, ties to the lower index) and
replaces each entry by the floor of the mean of its parts; entries without parts stay.

What a part knows is persisted from round to round, in the row of its vector: the assigned
entry with an upper bound of the distance to it, the ``b`` next closest entries with lower
bounds in ascending order, and one outer bound for all entries beyond. When entries have moved, bounds widen by how
far. A part whose upper bound stays below its first lower bound keeps its entry without any
distance; otherwise the upper bound is made tight, and only the listed entries whose
lower bound it still reaches are compared, or all of them where it reaches the outer bound.
Comparisons are made in integers, and bounds are rounded away from the truth, so
assignments equal those of comparing all. ``b`` follows the number of entries that parts had
to compare: it shrinks while fewer do, and doubles where too many lists end too soon.

Tasks return sums of their parts by entry, which Spark adds; the driver holds only the codebooks,
of fixed size. A round whose entries don't change is the last, as no later one could differ.

Rows whose vector is null, empty, or holds null or non-finite components are dropped, and so are those
whose length isn't that of the vector with the least id, or isn't a multiple of ``PARTS``. Rows that repeat,
or share an id, are vectors of their own; those with least ids start the codebooks, ties by
components. A null id comes last. With fewer than ``ENTRIES`` vectors there are as many entries. Components of
any size are exact; an error beyond a long is null. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.jaccard_join import BROADCAST_ROWS
from tessera.llm.shared import remove, saved, shared_folder, written
from tessera.sources.tables import table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Entries listed at first, and at least while there are more.
FIRST, LEAST = 4, 2
#: Share of parts that compare all entries beyond which lists double; share that may do so when lists shrink.
SHORT, SPARE = 0.05, 0.01
#: Numbers that a task compares at a time.
HELD = 1 << 21
#: Sums leave a task in two halves, so that those of any size fit a decimal.
HALF = 60

STATE = "vec_id {id}, label {label}, v {vector}, code binary, near binary, upper array<float>, lower array<float>, outer array<float>, sums array<decimal(38,0)>"


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exactly: int64 where squared distances fit it, Python's integers otherwise."""
    if not len(x) or np.abs(x).max() < (1 << 40) / SCALE:
        return np.floor(SCALE * x.astype(np.float64)).astype(np.int64)
    return np.array([int(v) * SCALE if abs(v) >= 1 << 53 else math.floor(SCALE * v) for v in x.astype(np.float64).tolist()], object)


def _plain(width: int, *of: np.ndarray) -> bool:
    top = max((int(abs(x).max()) for x in of if x.size), default=0)
    return 4 * top * top * width < 1 << 57


def _up(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


@dataclass
class Bounds:
    """What each part knows: its entry, the closest others, and bounds of the distances."""

    code: np.ndarray
    near: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    outer: np.ndarray

    def moved(self, part: np.ndarray, drift: np.ndarray, b: int) -> Bounds:
        """The bounds after entries moved by ``drift``, with ``b`` entries listed."""
        upper = _up(self.upper + drift[part, self.code])
        lower = _down(self.lower - drift[part[:, None], self.near])
        outer = _down(self.outer - drift.max(axis=1)[part])
        near, had = self.near, self.near.shape[1]
        if b < had:
            outer = np.minimum(outer, lower[:, b:].min(axis=1))
            near, lower = near[:, :b], lower[:, :b]
        elif b > had:  # places to be filled when the part next compares all entries
            near = np.concatenate([near, np.repeat(self.code[:, None], b - had, axis=1)], axis=1)
            lower = np.concatenate([lower, np.full((len(lower), b - had), np.inf, np.float32)], axis=1)
        # In ascending order: each bounds all entries from its place on.
        ordered = np.minimum.accumulate(np.concatenate([lower, outer[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
        return Bounds(self.code, near, upper, ordered[:, :-1], outer)


def compare_all(x: np.ndarray, part: np.ndarray, books: np.ndarray, b: int) -> Bounds:
    """Exact distances to all entries, and the bounds that they give."""
    k = books.shape[1]
    d = ((x[:, None, :] - books[part]) ** 2).sum(axis=2)
    order = np.argsort(d * ENTRIES + np.arange(k), axis=1)
    d = _root(np.take_along_axis(d, order, axis=1))
    outer = _down(d[:, b + 1]) if k > b + 1 else np.full(len(x), np.inf, np.float32)
    return Bounds(order[:, 0], order[:, 1 : b + 1], _up(d[:, 0]), _down(d[:, 1 : b + 1]), outer)


def reassign(x: np.ndarray, part: np.ndarray, books: np.ndarray, s: Bounds) -> np.ndarray:
    """Brings ``s`` up to date with ``books``; returns how many listed entries each part compared, -1 for all of them."""
    b = s.near.shape[1]
    asked = np.zeros(len(x), np.int64)
    first = s.lower[:, 0] if b else s.outer
    open_ = np.flatnonzero(s.upper >= first)
    if not len(open_):
        return asked
    own = ((x[open_] - books[part[open_], s.code[open_]]) ** 2).sum(axis=1)
    s.upper[open_] = _up(_root(own))
    still = s.upper[open_] >= first[open_]
    open_, own = open_[still], own[still]
    every = s.upper[open_] >= s.outer[open_]
    at = open_[every]
    if len(at):
        new = compare_all(x[at], part[at], books, b)
        s.code[at], s.near[at], s.upper[at], s.lower[at], s.outer[at] = new.code, new.near, new.upper, new.lower, new.outer
        asked[at] = -1
    at, own = open_[~every], own[~every]
    if len(at):
        needed = s.lower[at] <= s.upper[at, None]
        asked[at] = needed.sum(axis=1)
        row, col = np.nonzero(needed)
        entry = s.near[at[row], col]
        d = ((x[at[row]] - books[part[at[row]], entry]) ** 2).sum(axis=1)
        # Compared entries by distance and index, then the others as they stood.
        far = np.full((len(at), b + 1), (1 << 62), d.dtype) + np.arange(b + 1)
        if d.dtype == object:
            far = far + max(int(v) for v in d) * ENTRIES
        rank, lower = far.copy(), np.concatenate([np.zeros((len(at), 1), np.float32), s.lower[at]], axis=1)
        names = np.concatenate([s.code[at, None], s.near[at]], axis=1)
        rank[:, 0], rank[row, col + 1] = own * ENTRIES + names[:, 0], d * ENTRIES + entry
        exact = np.concatenate([_root(own)[:, None], np.zeros((len(at), b))], axis=1)
        exact[row, col + 1] = _root(d)
        lower[:, 0], lower[row, col + 1] = _down(exact[:, 0]), _down(exact[row, col + 1])
        order = np.argsort(rank, axis=1)
        names, lower, exact = (np.take_along_axis(v, order, axis=1) for v in (names, lower, exact))
        ordered = np.minimum.accumulate(np.concatenate([lower[:, 1:], s.outer[at, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
        s.code[at], s.near[at], s.upper[at], s.lower[at] = names[:, 0], names[:, 1:], _up(exact[:, 0]), ordered[:, :-1]
    return asked


def _halves(values: np.ndarray) -> list[int]:
    return [half for v in values.tolist() for half in (v >> HALF, v & ((1 << HALF) - 1))]


def _vectors(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their parts, each part's position, the codebooks) for stretches of a batch."""
    parts, k, width = books.shape
    step = max(1, HELD // (parts * k * width))
    for at in range(0, batch.num_rows, step):
        rows = batch.slice(at, step)
        x = scaled(rows["v"].flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)
        plain = x.dtype != object and _plain(width, x, books)
        yield rows, x if plain else x.astype(object), np.tile(np.arange(parts), rows.num_rows), books.astype(np.int64 if plain else object)


def _lists(values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    flat = np.ascontiguousarray(values).reshape(-1)
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * (len(flat) // n), pa.array(flat, kind))


def _bytes(values: np.ndarray, n: int) -> pa.Array:
    flat = np.ascontiguousarray(values.astype(np.uint8)).reshape(n, -1)
    return pa.array([r.tobytes() for r in flat], pa.binary())


def _assign(books: np.ndarray, b: int, drift: np.ndarray | None):
    """A pass over the state: every part at its nearest entry; the first row of each stretch carries the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x, part, book in _vectors(batch, books):
                n, (parts, k, width) = rows.num_rows, books.shape
                if drift is None:
                    state, asked = compare_all(x, part, book, b), np.zeros(0, np.int64)
                else:
                    flat = lambda c: rows[c].flatten().to_numpy(zero_copy_only=False)  # noqa: E731, B023
                    number = lambda c: np.frombuffer(b"".join(rows[c].to_pylist()), np.uint8).astype(np.int64)  # noqa: E731, B023
                    m = n * parts
                    old = Bounds(number("code"), number("near").reshape(m, -1), flat("upper"), flat("lower").reshape(m, -1), flat("outer"))
                    state = old.moved(part, drift, b)
                    asked = reassign(x, part, book, state)
                cell = part * k + state.code
                sums = np.zeros((parts * k, width), x.dtype)
                np.add.at(sums, cell, x)
                counts = np.bincount(cell, minlength=parts * k)
                used = np.bincount(np.where(asked < 0, ENTRIES, asked), minlength=ENTRIES + 1)
                told = pa.array([_halves(np.concatenate([sums.reshape(-1), counts, used]))] + [None] * (n - 1), pa.list_(pa.decimal128(38, 0)))
                yield pa.RecordBatch.from_arrays(
                    [rows["vec_id"], rows["label"], rows["v"], _bytes(state.code, n), _bytes(state.near, n), _lists(state.upper, n, pa.float32()), _lists(state.lower, n, pa.float32()), _lists(state.outer, n, pa.float32()), told],
                    names=["vec_id", "label", "v", "code", "near", "upper", "lower", "outer", "sums"],
                )

    return run


def _errors(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x, part, book in _vectors(batch, books):
                codes = rows["code"].to_pylist()
                code = np.frombuffer(b"".join(codes), np.uint8).astype(np.int64)
                error = ((x - book[part, code]) ** 2).sum(axis=1).reshape(rows.num_rows, -1).sum(axis=1)
                error = pa.array([e if e < 1 << 63 else None for e in error.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([rows["vec_id"], rows["label"], pa.array([c.hex() for c in codes]), error], names=["vec_id", "label", "code", "error"])

    return run


def _listed(b: int, k: int, asked: list[int]) -> int:
    """How many entries to list next, given how many parts compared 0, 1, ... listed entries and, last, all."""
    total = sum(asked)
    if asked[-1] > SHORT * total:
        return min(k - 1, 2 * b)
    beyond, z = asked[-1], b
    while z > LEAST and beyond + asked[z] <= SPARE * total:
        beyond += asked[z]
        z -= 1
    return min(z, b)


@dataclass
class Codes:
    """``rows``: vec_id, label, code, error of each vector; the final ``books`` (part, entry, component), and how many entries each round listed."""

    rows: DataFrame
    books: np.ndarray
    listed: list[int]

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label") -> Codes:
    """Codes of all vectors and the codebooks."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    start = [r.v for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).collect()]
    size = len(start[0]) if start and len(start[0]) % PARTS == 0 else 0
    rows = rows.filter(F.size("v") == size)
    kinds = {"id": rows.schema["vec_id"].dataType.simpleString(), "label": rows.schema["label"].dataType.simpleString(), "vector": rows.schema["v"].dataType.simpleString()}
    if not size:
        return Codes(spark.createDataFrame([], f"vec_id {kinds['id']}, label {kinds['label']}, code string, error long"), np.zeros((PARTS, 0, 0), object), [])
    if len({len(v) for v in start}) > 1:  # those of other lengths aren't among the vectors
        start = [r.v for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).collect()]
    width = size // PARTS
    books = np.stack([scaled(np.array(v, np.float64)).astype(object).reshape(PARTS, width) for v in start], axis=1)
    k, b, drift, state, listed = books.shape[1], min(FIRST, books.shape[1] - 1), None, rows, []
    paths: list[str] = []
    for turn in range(ROUNDS + 1):
        path = shared_folder(spark)
        state = saved(state.mapInArrow(_assign(books, b, drift), STATE.format(**kinds)), path)
        for old in paths:  # what the next pass starts from is written
            remove(spark, old)
        paths, listed = [path], [*listed, b]
        if turn == ROUNDS:
            break
        told = state.filter("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
        halves = [0] * (2 * (PARTS * k * (width + 1) + ENTRIES + 1))
        for r in told:
            halves[r["at"]] = int(r.n)
        sums = [(high << HALF) + low for high, low in zip(halves[::2], halves[1::2], strict=True)]
        new, cells = books.copy(), PARTS * k
        for cell in range(cells):
            if count := sums[cells * width + cell]:
                new[cell // k, cell % k] = [s // count for s in sums[cell * width : (cell + 1) * width]]
        if (new == books).all():
            break
        drift = np.array([[math.sqrt(sum(int(v) ** 2 for v in new[p, e] - books[p, e])) for e in range(k)] for p in range(PARTS)]) * (1 + 1e-9)
        if turn and k > 1:
            b = _listed(b, k, sums[cells * (width + 1) :])
        books = new
    return Codes(state.mapInArrow(_errors(books), f"vec_id {kinds['id']}, label {kinds['label']}, code string, error long"), books, listed)


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Code and errors of every vector."""
    found = compress(table(spark, folder, "embeddings"))
    rows = written(found.rows)
    totals = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")).withColumnRenamed("label", "of")
    side = F.broadcast(totals) if totals.count() <= BROADCAST_ROWS else totals
    joined = rows.join(side, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(found.digest).alias("codebooks_sha256"))


def _sql() -> str:
    steps = [
        """
v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS (SELECT r, (p - 1) // (n // 8) AS part, (p - 1) % (n // 8) AS pos, CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT r, len(embedding) AS n, unnest(embedding) AS c, unnest(range(1, len(embedding) + 1)) AS p FROM v)),
b0 AS (SELECT part, CAST(r - 1 AS INT) AS entry, pos, x AS c FROM x WHERE r <= 16)"""
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"""
d{i} AS MATERIALIZED (SELECT r, part, entry, sum((x - c) * (x - c)) AS d FROM x JOIN b{i} USING (part, pos) GROUP BY r, part, entry),
a{i} AS MATERIALIZED (SELECT r, part, entry, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, entry) = 1)""")
        if i < ROUNDS:
            steps.append(f"""
s{i} AS (SELECT part, entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN x USING (r, part) GROUP BY part, entry, pos),
b{i + 1} AS MATERIALIZED (SELECT part, entry, pos, CASE WHEN n IS NULL THEN c ELSE (s - (s % n + n) % n) // n END AS c FROM b{i} LEFT JOIN s{i} USING (part, entry, pos))""")
    return f"""WITH {",".join(steps)},
e AS (SELECT r, string_agg(lpad(format('{{:x}}', entry), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN e USING (r) CROSS JOIN h
"""


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLES = {"op12_vector_codes": _sql()}
