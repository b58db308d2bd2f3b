"""Approximate nearest neighbours by an adaptive scan of dimensions over inverted lists.

1. Coarse centres are fitted on a bounded sample; every vector goes to the list of its nearest centre, under a
   random rotation, which makes the first dimensions of a difference a fair sample of all of them.
2. A query probes its nearest lists. Within a list the rotated vectors lie in column blocks. After each block a
   hypothesis test compares the partial distance, scaled to all dimensions, with the query's tenth-best distance
   so far; candidates that can hardly be nearer are abandoned.
3. What is left gets the exact distance of the original vectors in double precision.

Short lists share a shelf, long ones are split by a hash over shelves of bounded size, so a vector that a third
of all rows repeat is spread over many tasks. Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, as queries or candidates. Rows with a null id take no part. Rows that repeat
an id are candidates of their own; a query's own id is no candidate. Ties go to the smaller id. Empty tables
give empty tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetwatch.session import cut

NEIGHBOURS, EVERY = 10, 100
#: Bounds of the fit: sampled vectors and centres.
SAMPLE, MOST_LISTS, ROWS_A_LIST = 20_000, 4096, 64
PROBE_SHARE, LEAST_PROBES = 0.5, 48
SHELF_ROWS = 8192  # that one task scans at a time: many short lists, or part of a long one
STEP_ROWS = 512  # between two looks at the limit
BLOCK = 16  # dimensions per column block
#: A candidate is abandoned when its partial distance exceeds the limit by this many times 1 / sqrt(dimensions).
CONFIDENCE = 2.1
SEED = 11
FOUND = "query_id long, vec_id long, score double"


@dataclass
class Index:
    rotation: np.ndarray
    centres: np.ndarray


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the embedding as doubles, of rows that can be compared."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = vectors.select(F.col("vec_id").cast("long"), values.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    )
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0))


def _rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def _means(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Centres of a bounded sample by Lloyd's rounds; a centre without rows keeps its place."""
    rng = np.random.default_rng(SEED)
    centres = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(sample, centres, 1)[:, 0]
        count = np.bincount(near, minlength=lists)
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        some = count > 0
        centres[some] = total[some] / count[some, None]
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the ``n`` nearest centres of each row."""
    out = []
    square = (centres**2).sum(1)
    for at in range(0, len(rows), 2048):
        far = square - 2 * rows[at : at + 2048] @ centres.T
        out.append(np.argsort(far, axis=1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.zeros((0, n), int)


def fit_index(rows: DataFrame, n_rows: int) -> Index | None:
    """Rotation and centres from at most ``SAMPLE`` rows, chosen by a hash of the id."""
    sample = rows.orderBy(F.xxhash64("vec_id", "v")).limit(min(SAMPLE, n_rows)).select("v").collect()
    if not sample:
        return None
    x = np.array([r["v"] for r in sample])
    rotation = _rotation(x.shape[1])
    different = np.unique(x, axis=0)
    lists = max(1, min(MOST_LISTS, len(different), n_rows // ROWS_A_LIST))
    return Index(rotation, _means(different @ rotation, lists))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _listed(rows: DataFrame, index: Index) -> DataFrame:
    """Each vector with the list of its nearest centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                lists = _nearest(_matrix(batch.column("v")) @ index.rotation, index.centres, 1)[:, 0]
                columns = [pa.array(lists.astype(np.int32)), batch.column("vec_id"), batch.column("v")]
                yield pa.RecordBatch.from_arrays(columns, names=["list", "vec_id", "v"])

    return rows.mapInArrow(run, "list int, vec_id long, v array<double>")


def _asked(queries: DataFrame, index: Index, shelves: dict[int, tuple[int, int]], probes: int) -> DataFrame:
    """Each query once for every shelf that holds lists it probes, with those lists, the nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            near = _nearest(_matrix(batch.column("v")) @ index.rotation, index.centres, probes)
            out = {"shelf": [], "row": [], "lists": []}
            for row, lists in enumerate(near.tolist()):
                own: dict[int, list[int]] = {}
                for number in lists:
                    first, parts = shelves.get(number, (0, 0))
                    for shelf in range(first, first + parts):
                        own.setdefault(shelf, []).append(number)
                out["shelf"] += own.keys()
                out["lists"] += own.values()
                out["row"] += [row] * len(own)
            take = pa.array(out["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["shelf"], pa.int32()),
                    batch.column("vec_id").take(take),
                    batch.column("v").take(take),
                    pa.array(out["lists"], pa.list_(pa.int32())),
                ],
                names=["shelf", "vec_id", "v", "lists"],
            )

    return queries.mapInArrow(run, "shelf int, vec_id long, v array<double>, lists array<int>")


class Shelf:
    """Rows of some lists that one task scans: the originals, and the rotated ones as column blocks."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, lists: np.ndarray, rotation: np.ndarray):
        order = np.lexsort((ids, lists))
        self.rows, self.ids, self.lists = rows[order], ids[order], lists[order]
        self.columns = np.ascontiguousarray((self.rows @ rotation).T)

    def places(self, lists: np.ndarray, without: int) -> np.ndarray:
        """Places of the rows of these lists in turn, but for those of one id."""
        low, high = np.searchsorted(self.lists, lists), np.searchsorted(self.lists, lists, "right")
        found = np.concatenate([np.arange(a, b) for a, b in zip(low, high)]) if len(lists) else np.zeros(0, int)
        return found[self.ids[found] != without]


def scan(query: np.ndarray, turned: np.ndarray, order: np.ndarray, shelf: Shelf, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the shelf of the ``k`` nearest rows to a query, and their distances.

    ``order`` holds the places of the probed lists' rows, the nearest list first, so that the limit is tight early.
    """
    dims = len(query)
    best, far = np.zeros(0, int), np.zeros(0)
    for at in range(0, len(order), STEP_ROWS):
        alive = order[at : at + STEP_ROWS]
        limit = far[k - 1] if len(far) >= k else np.inf
        partial = np.zeros(len(alive))
        for lo in range(0, dims, BLOCK):
            if not len(alive) or limit == np.inf:
                break
            hi = min(dims, lo + BLOCK)
            partial += ((shelf.columns[lo:hi, alive] - turned[lo:hi, None]) ** 2).sum(0)
            # Hypothesis: the whole distance is within the limit. Beyond this bound it is rejected.
            slack = 1.0 if hi == dims else 1 + CONFIDENCE / math.sqrt(hi)
            keep = partial <= (limit * slack) ** 2 * (hi / dims) * (1 + 1e-9) + 1e-12
            alive, partial = alive[keep], partial[keep]
        best = np.concatenate([best, alive])
        far = np.concatenate([far, np.sqrt(((shelf.rows[alive] - query) ** 2).sum(1))])
        first = np.lexsort((shelf.ids[best], far))[:k]
        best, far = best[first], far[first]
    return best, far


def shelve(counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """First shelf and number of shelves of each list: short lists share one, long ones are split."""
    out, shelf, room = {}, -1, 0
    for number in sorted(counts):
        parts = -(-counts[number] // SHELF_ROWS)
        if parts > 1 or counts[number] > room:
            shelf, room = shelf + 1, SHELF_ROWS
        out[number] = (shelf, parts)
        room = room - counts[number] if parts == 1 else 0
        shelf += parts - 1
    return out


def nearest(vectors: DataFrame, every: int = EVERY, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    n_rows = rows.count()
    index = fit_index(rows, n_rows)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = len(index.centres)
    probes = min(lists, max(LEAST_PROBES, math.ceil(PROBE_SHARE * lists)))
    listed = cut(_listed(rows, index), "lists")
    # At most MOST_LISTS numbers, whatever the input.
    shelves = shelve({r["list"]: r["count"] for r in listed.groupBy("list").count().collect()})
    where = F.broadcast(
        spark.createDataFrame([(n, s, p) for n, (s, p) in shelves.items()], "list int, first int, parts int")
    )
    part = F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int")
    members = listed.join(where, "list").select((F.col("first") + part).alias("shelf"), "list", "vec_id", "v")
    asked = _asked(rows.where(F.col("vec_id") % every == 0), index, shelves, probes)
    rotation = index.rotation

    def compare(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        if len(asking) and len(held):
            shelf = Shelf(np.stack(held["v"].to_numpy()), held["vec_id"].to_numpy(), held["list"].to_numpy(), rotation)
            for q, v, lists in zip(asking["vec_id"], asking["v"], asking["lists"]):
                query = np.asarray(v)
                best, far = scan(query, query @ rotation, shelf.places(np.asarray(lists), q), shelf, k)
                found.extend(zip([q] * len(best), shelf.ids[best].tolist(), far.tolist()))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = asked.groupBy("shelf").cogroup(members.groupBy("shelf")).applyInPandas(compare, FOUND)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (
        found.withColumn("rank", place.cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
