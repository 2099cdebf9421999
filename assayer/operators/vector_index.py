"""A stored index of unit vectors, and exact top matches by cosine on the executors.

The index lies in Parquet under a version that is a digest of its source: building it again over the same vectors reads what is
there, a changed source gets a version of its own. Vectors lie in lists: by the nearest of a bounded number of centroids, and
large cells are dealt into lists of bounded size by a hash of the id. A version counts once its manifest, the last thing
written, is there.

A search first visits each query's own cell, which gives the score that its k-th match has at least. By the angle between query
and centroid and the widest angle within a cell, all cells that cannot hold a better one are left out; the rest is visited.
Neighbouring lists stand on shelves, so that a query goes to a shelf once with all cells that it asks there. Where queries and a
shelf meet, the shelf's rows come first and are held as one matrix, and the queries pass by in batches, each leaving k matches
of a cell at most, none below the score it has; these are merged by query. Shelves that many queries visit are copied. An index
of FEW_ROWS vectors at most is sent to all tasks as centroids are, and queries are matched where they stand, without a shuffle.

Rows without a vector, or with one of length zero, are left out on both sides, queries of another dimension as well. Scores are
told to 12 digits, so that equal vectors tie; ties go to the lesser id. Repeated ids are matches of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.operators.similarity import dot, normalized
from assayer.shipping import ship
from assayer.sources.stored import exists, written

#: Centroids at most: what comes to the driver and is sent to all tasks. Rows of a list, and queries that pass one copy of a shelf.
MOST_CELLS, LIST_ROWS, QUERY_ROWS = 1024, 8192, 65_536
#: Numbers of a shelf's vectors.
SHELF_VALUES = 1 << 22
#: Vectors of an index that is sent to all tasks whole.
FEW_ROWS = 32
#: Queries that are multiplied with a list at once.
TOGETHER = 256
SLACK = 1e-9
LISTS, CELLS = "code {}, unit array<double>, list int, cell int", "cell int, n long, lists int, low double, centroid array<double>"


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str

    @property
    def manifest(self) -> dict:
        return self.spark.read.parquet(f"{self.path}/manifest").first().asDict()

    def cells(self) -> list:
        """cell, centroid, n, lists, low (the least cosine of a member with the centroid): MOST_CELLS rows at most."""
        return self.spark.read.schema(CELLS).parquet(f"{self.path}/cells").orderBy("cell").collect()

    def lists(self) -> DataFrame:
        """code, unit, list, cell of every vector."""
        return self.spark.read.schema(LISTS.format(self.manifest["kind"])).parquet(f"{self.path}/lists")


def _units(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    return normalized(df.select(F.col(id_column).alias("code"), F.col(vector).alias("v")), "v").where("unit IS NOT NULL AND NOT exists(unit, x -> x IS NULL OR isnan(x))").select("code", "unit")


def built(df: DataFrame, id_column: str, vector: str, folder: str, cells: int | None = None, force: bool = False) -> VectorIndex:
    """The index of df's vectors in folder: the stored one if its source is the same, else a new version."""
    spark = df.sparkSession
    units = _units(df, id_column, vector)
    told = units.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64(F.lit(1), "code", "unit")).alias("a"), F.bit_xor(F.xxhash64(F.lit(2), "unit", "code")).alias("b"),
        F.min(F.size("unit")).alias("least"), F.max(F.size("unit")).alias("dims"), F.sum(F.xxhash64("code", "unit").cast("decimal(38,0)")).alias("c"),
    ).first()
    if told["least"] != told["dims"]:
        raise ValueError(f"the vectors have from {told['least']} to {told['dims']} dimensions")
    n = told["n"]
    cells = max(2, min(cells or int(n**0.5) // 4, MOST_CELLS))
    version = hashlib.sha256(repr((*told, cells, LIST_ROWS)).encode()).hexdigest()[:24]
    index = VectorIndex(spark, f"{folder}/version={version}")
    if not force and exists(spark, f"{index.path}/manifest/_SUCCESS"):
        return index

    kind = dict(units.dtypes)["code"]
    if n:
        model = KMeans(k=cells, distanceMeasure="cosine", maxIter=5, seed=11, featuresCol="features", predictionCol="cell").fit(units.select(array_to_vector("unit").alias("features")))
        centers = [c / (np.linalg.norm(c) or 1.0) for c in model.clusterCenters()]
        placed = written(model.transform(units.withColumn("features", array_to_vector("unit"))).select("code", "unit", "cell"))
    else:
        centers, placed = [], spark.createDataFrame([], f"code {kind}, unit array<double>, cell int")
    small = spark.createDataFrame([(k, [*map(float, c)]) for k, c in enumerate(centers)], "cell int, centroid array<double>")
    sized = F.broadcast(placed.groupBy("cell").agg(F.ceil(F.count("*") / LIST_ROWS).alias("lists")))  # a row a cell
    dealt = placed.join(sized, "cell").withColumn("list", F.pmod(F.xxhash64("code"), F.col("lists")).cast("int")).drop("lists")
    dealt.repartition("cell", "list").sortWithinPartitions("cell", "list", "code").write.mode("overwrite").partitionBy("cell").parquet(f"{index.path}/lists")
    stored = spark.read.schema(LISTS.format(kind)).parquet(f"{index.path}/lists")
    within = stored.join(F.broadcast(small), "cell").groupBy("cell").agg(F.count("*").alias("n"), (F.max("list") + 1).alias("lists"), F.min(dot(F.col("unit"), F.col("centroid"))).alias("low"))
    within.join(F.broadcast(small), "cell").write.mode("overwrite").parquet(f"{index.path}/cells")
    manifest = [(version, n, told["dims"], len(centers), kind)]
    spark.createDataFrame(manifest, "version string, n long, dims int, cells int, kind string").write.mode("overwrite").parquet(f"{index.path}/manifest")
    return index


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _near(units: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.clip(units @ centers.T, -1.0, 1.0)


def best(scores: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and scores, told to 12 digits, of the k largest of each row at or above its least; of equal ones those that stand first."""
    floor = least - SLACK
    r, c = np.nonzero(scores >= floor[:, None])
    if len(r) > 2 * k * len(scores):
        if scores.shape[1] > k:
            floor = np.maximum(floor, np.partition(scores, scores.shape[1] - k, axis=1)[:, -k] - SLACK)
        r, c = np.nonzero(scores >= floor[:, None])
    s = np.round(scores[r, c], 12)
    kept = s >= least[r]
    r, c, s = r[kept], c[kept], s[kept]
    order = np.lexsort((c, -s, r))
    r, c, s = r[order], c[order], s[order]
    few = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[few], c[few], s[few]


def shelves(index: VectorIndex) -> tuple[list[tuple[int, int, int]], int]:
    """(cell, list, shelf) of all lists, and the rows of a shelf: lists that a task holds together, an eighth of the index but no more than SHELF_VALUES."""
    cells, manifest = index.cells(), index.manifest
    rows = max(LIST_ROWS, min(SHELF_VALUES // max(1, manifest["dims"] or 1), -(-manifest["n"] // 8)))
    out, held, shelf = [], 0.0, 0
    for r in cells:
        for k in range(r["lists"]):
            if held and held + r["n"] / r["lists"] > rows:
                held, shelf = 0.0, shelf + 1
            out.append((r["cell"], k, shelf))
            held += r["n"] / r["lists"]
    return out, rows


def _meeting(index: VectorIndex, visits: DataFrame, kind: str, k: int, placed: list[tuple[int, int, int]], shelf_rows: int) -> DataFrame:
    """asked, code, score: up to k matches for each visit (asked, own, unit, least, shelf, cells) from each of these cells on the shelf."""
    per_copy = min(QUERY_ROWS, shelf_rows)
    counts = visits.groupBy("shelf").agg(F.ceil(F.count("*") / per_copy).alias("copies")).collect()  # a row a shelf
    copies = {r["shelf"]: r["copies"] for r in counts}
    spread = index.spark.createDataFrame(list(copies.items()), "shelf int, copies long")
    lists = index.spark.createDataFrame([(c, n, s, copies[s]) for c, n, s in placed if s in copies], "cell int, list int, shelf int, copies long")
    rows = index.lists().join(F.broadcast(lists), ["cell", "list"])
    rows = rows.select("shelf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.lit(None).cast("long").alias("asked"), "code", "unit", F.lit(None).cast("double").alias("least"), F.array("cell").alias("cells"))
    queries = visits.join(F.broadcast(spread), "shelf").select("shelf", F.pmod(F.xxhash64("asked"), F.col("copies")).alias("copy"), "asked", F.col("own").alias("code"), "unit", "least", "cells")
    met = rows.unionByName(queries).repartition("shelf", "copy").sortWithinPartitions("shelf", "copy", F.asc_nulls_first("asked"), F.when(F.col("asked").isNull(), F.col("cells")[0]), "code")
    schema = pa.schema([("asked", pa.int64()), ("code", met.sparkSession.createDataFrame([], f"code {kind}").toArrow().schema.field("code").type), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, units, cells, held = None, [], [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            is_query = np.asarray(batch.column("asked").is_valid())
            marks = np.column_stack([batch.column("shelf").to_numpy().astype(np.int64), batch.column("copy").to_numpy(), is_query])
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            vectors, names, places = _matrix(batch, "unit"), batch.column("code"), batch.column("cells")
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(marks[a, :2])
                if key != now:
                    now, codes, units, cells, held = key, [], [], [], None
                if not is_query[a]:
                    codes.append(names.slice(a, b - a))
                    units.append(vectors[a:b].copy())
                    cells.append(places.slice(a, b - a).flatten().to_numpy())
                    continue
                if not units:
                    continue
                if held is None:
                    held = Shelf(pa.chunked_array(codes).combine_chunks(), np.concatenate(units), np.concatenate(cells))
                    codes, cells = [], []
                for at in range(a, b, TOGETHER):
                    part = batch.slice(at, min(at + TOGETHER, b) - at)
                    r, c, found = held.matches(vectors[at : at + len(part)], part, k)
                    yield pa.RecordBatch.from_arrays([part.column("asked").take(pa.array(r)), held.codes.take(pa.array(c)), pa.array(found)], schema=schema)

    return met.mapInArrow(run, f"asked long, code {kind}, score double")


class Shelf:
    """The lists that a task holds: rows in the order of cells, and of codes within a cell."""

    def __init__(self, codes: pa.Array, units: np.ndarray, cells: np.ndarray):
        self.codes, self.units = codes, units
        numbers, starts = np.unique(cells, return_index=True)
        self.spans = {int(c): (int(f), int(t)) for c, f, t in zip(numbers, starts, [*starts[1:], len(cells)])}
        self._places: dict | None = None

    def places(self, code) -> list[int]:
        """Where a code stands."""
        if self._places is None:
            self._places = {}
            for k, c in enumerate(self.codes.to_pylist()):
                self._places.setdefault(c, []).append(k)
        return self._places.get(code, [])

    def matches(self, vectors: np.ndarray, queries: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and score of up to k matches of each query in each of its cells, LIST_ROWS rows at a time."""
        wanted, least = queries.column("cells"), queries.column("least").to_numpy()
        row, cell = np.repeat(np.arange(len(vectors)), wanted.value_lengths().to_numpy(zero_copy_only=False)), wanted.flatten().to_numpy()
        own = [(r, p) for r, code in enumerate(queries.column("code").to_pylist()) if code is not None for p in self.places(code)]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for c in np.unique(cell):
            start, stop = self.spans.get(int(c), (0, 0))
            asking = row[cell == c]
            for f in range(start, stop, LIST_ROWS):
                t = min(f + LIST_ROWS, stop)
                scores = vectors[asking] @ self.units[f:t].T
                for r, p in own:  # a query is no match of itself
                    if f <= p < t:
                        scores[asking == r, p - f] = -2.0
                r, at, s = best(scores, k, least[asking])
                out.append((asking[r], at + f, s))
        return tuple(np.concatenate(x) for x in zip(*out))


def _beside(index: VectorIndex, queries: DataFrame, query_id: str, vector: str, k: int, threshold: float, same: bool) -> DataFrame:
    """search for an index of few vectors: each task has them all, and one pass over the queries makes them unit vectors and finds their matches."""
    manifest, asked_kind = index.manifest, dict(queries.dtypes)[query_id]
    few = index.lists().select("code", "unit").orderBy("code").toArrow().combine_chunks()
    codes, units = few.column("code").combine_chunks(), np.array(few.column("unit").to_pylist())
    own = F.col(query_id).cast(manifest["kind"]) if same else F.lit(None).cast(manifest["kind"])
    asked = queries.select(F.col(query_id).alias("query"), own.alias("own"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") == manifest["dims"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch, "v")  # nulls are not numbers here
            with np.errstate(all="ignore"):
                length = np.sqrt((vectors * vectors).sum(1))
                vectors = vectors / length[:, None]
            whole = (length > 0) & ~np.isnan(vectors).any(1)
            batch, vectors = batch.filter(pa.array(whole)), vectors[whole]
            scores = vectors @ units.T
            if same:
                for c, code in enumerate(codes):  # a query is no match of itself
                    scores[np.asarray(pc.fill_null(pc.equal(batch.column("own"), code), False)), c] = -2.0
            r, c, found = best(scores, k, np.full(len(scores), float(threshold)))
            rank = (np.arange(len(r)) - np.searchsorted(r, r) + 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(r)), codes.take(pa.array(c)), pa.array(found), pa.array(rank)], names=["query", "code", "score", "rank"])

    return asked.mapInArrow(run, f"query {asked_kind}, code {manifest['kind']}, score double, rank int").withColumnRenamed("query", query_id)


def search(index: VectorIndex, queries: DataFrame, query_id: str, vector: str, k: int = 5, threshold: float = 0.3, same: bool = False) -> DataFrame:
    """query_id, code, score, rank: the k vectors of the index most similar to each query, at or above threshold, exactly.

    With same, query ids are ids of the index as well, and rows of a query's own id are no matches of it.
    """
    spark = index.spark
    ship(spark)
    manifest, cells = index.manifest, index.cells()
    kind, asked_kind = manifest["kind"], dict(queries.dtypes)[query_id]
    if not cells:
        return spark.createDataFrame([], f"{query_id} {asked_kind}, code {kind}, score double, rank int")
    if manifest["n"] <= FEW_ROWS:
        return _beside(index, queries, query_id, vector, k, threshold, same)
    centers = np.array([r["centroid"] for r in cells])
    numbers = np.array([r["cell"] for r in cells])
    widths = np.arccos(np.clip([r["low"] for r in cells], -1.0, 1.0))

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = numbers[_near(_matrix(batch, "unit"), centers).argmax(1)] if batch.num_rows else np.zeros(0)
            yield batch.append_column("home", pa.array(home.astype(np.int32)))

    units = _units(queries, query_id, vector).where(F.size("unit") == manifest["dims"]).withColumnRenamed("code", "query")
    own = F.col("query").cast(kind) if same else F.lit(None).cast(kind)
    units = units.select(F.monotonically_increasing_id().alias("asked"), "query", own.alias("own"), "unit")
    asked = written(units.mapInArrow(at_home, f"asked long, query {asked_kind}, own {kind}, unit array<double>, home int"))

    placed, shelf_rows = shelves(index)
    homes = spark.createDataFrame(sorted({(c, s) for c, _, s in placed}), "home int, shelf int")
    visits = asked.join(F.broadcast(homes), "home").select("asked", "own", "unit", F.lit(float(threshold)).alias("least"), "shelf", F.array("home").alias("cells"))
    first = written(_meeting(index, visits, kind, k, placed, shelf_rows))
    known = Window.partitionBy("asked").orderBy(F.desc("score"), "code")
    least = first.withColumn("rank", F.row_number().over(known)).where(F.col("rank") <= k).groupBy("asked").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    on_shelf: dict[int, set[int]] = {}
    for c, _, s in placed:
        on_shelf.setdefault(s, set()).add(c)
    held = {s: np.isin(numbers, list(c)) for s, c in on_shelf.items()}

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bounds = np.cos(np.maximum(0.0, np.arccos(_near(_matrix(batch, "unit"), centers)) - widths))
            least = batch.column("least")
            open_cells = (bounds >= np.asarray(least)[:, None] - SLACK) & (numbers != np.asarray(batch.column("home"))[:, None])
            for s, here in held.items():
                r, c = np.nonzero(open_cells & here)
                to, n = np.unique(r, return_counts=True)
                cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(numbers[c].astype(np.int32)))
                took = pa.array(to)
                yield pa.RecordBatch.from_arrays([batch.column("asked").take(took), least.take(took), pa.array(np.full(len(to), s, np.int32)), cells], names=["asked", "least", "shelf", "cells"])

    # visits are small as files, so that Spark would take them for a broadcast, but there may be some for each query on each shelf
    bounded = asked.hint("merge").join(least, "asked", "left").select("asked", "unit", "home", F.coalesce("least", F.lit(float(threshold))).alias("least"))
    more = written(bounded.mapInArrow(elsewhere, "asked long, least double, shelf int, cells array<int>"))
    second = _meeting(index, more.hint("merge").join(asked.select("asked", "own", "unit"), "asked"), kind, k, placed, shelf_rows)
    ranked = first.unionByName(second).withColumn("rank", F.row_number().over(known)).where(F.col("rank") <= k)
    return ranked.hint("merge").join(asked.select("asked", "query"), "asked").select(F.col("query").alias(query_id), "code", "score", "rank")
