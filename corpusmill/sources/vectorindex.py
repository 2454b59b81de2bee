"""An inverted-file index of vectors for nearest neighbours by cosine: every vector lies in the cell of its nearest centre.

The centres come from k-means over a sample of at most SAMPLE vectors (those of least digest), on the driver; all vectors
are assigned and written, partitioned by cell. A cell knows its size and its radius, the widest angle between its centre
and a vector of it. A cell of more than PART vectors is searched in parts, one task each, so that a cell that holds a
third of all vectors is no single task's.

A search visits, for each probe, its nearest cells first. The k-th distance found there, or a given bound, and the radii
say which other cells may hold anything nearer: an angle to a centre less its cell's radius is as near as any vector of
the cell can be. Visiting these too makes the answer exact; leaving them out makes it approximate, with a recall that
the caller can measure against the exact answer of the same call.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.plans.frames import checkpointed

#: Vectors that centres are fitted on, rounds of the fit, cells at most; vectors and probes of a task.
SAMPLE, ROUNDS, CELLS, PART, PROBES = 20_000, 12, 4096, 16_384, 2048
#: Distances are compared to nine places, as queries sort them.
PLACES = 9


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row stays."""
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists of numbers as a matrix of doubles."""
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def centres_of(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means: first centres far from each other by chance, then ROUNDS of assignment and mean."""
    v, rng = unit(sample), np.random.default_rng(seed)
    centres = v[[int(rng.integers(len(v)))]]
    far = 1 - v @ centres[0]
    while len(centres) < min(cells, len(v)):
        odds = np.maximum(far, 0)
        if odds.sum() <= 0:
            break
        some = rng.choice(len(v), size=min(cells - len(centres), max(1, cells // 8)), p=odds / odds.sum())
        centres = np.concatenate((centres, v[np.unique(some)]))
        far = 1 - (v @ centres.T).max(axis=1)
    for _ in range(ROUNDS):
        cell = (v @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, cell, v)
        kept = np.linalg.norm(total, axis=1) > 0
        centres = unit(total[kept])
    return centres


def nearest_cells(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each vector, and its angle to the cell's centre."""
    likeness = unit(vectors) @ centres.T
    cell = likeness.argmax(axis=1)
    return cell.astype(np.int32), np.arccos(np.clip(likeness[np.arange(len(cell)), cell], -1, 1))


def write_index(vectors: DataFrame, path: str, cells: int | None = None) -> None:
    """Indexes vectors (vec_id, embedding and any other columns) under path; about as many cells as the root of their
    number. Rows without a vector or an id are left out: nothing is near them."""
    spark = vectors.sparkSession
    rows = vectors.where("vec_id is not null and embedding is not null")
    n = rows.count()
    cells = min(cells or max(1, round(n**0.5)), CELLS)
    share = F.lit(min(1.0, SAMPLE / max(1, n)))
    picked = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share * (1 << 20)).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    sample = picked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    centres = centres_of(matrix(sample["embedding"]), cells) if len(sample) else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast(centres)  # at most CELLS rows

    @F.arrow_udf("struct<cell:int,angle:double>")
    def assigned(embeddings: pa.Array) -> pa.Array:
        cell, angle = nearest_cells(matrix(embeddings), shared.value)
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(angle)], ["cell", "angle"])

    placed = rows.withColumn("at", assigned(F.col("embedding").cast("array<double>"))).select(*rows.columns, "at.*")
    placed.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(8))).write.partitionBy("cell").parquet(f"{path}/vectors")
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    sizes = spark.read.schema(placed.schema).parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    table.join(sizes, "cell").coalesce(1).write.parquet(f"{path}/cells")  # a row for each cell


class VectorIndex:
    """A written index. where: which vectors count, over the columns kept beside them."""

    def __init__(self, spark: SparkSession, path: str, where: Column | None = None):
        self.spark = spark
        cells = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()  # at most CELLS rows
        self.ids = cells["cell"].to_numpy()
        self.centres, self.radii = matrix(cells["centre"]), cells["radius"].to_numpy()
        self.parts = np.maximum(1, -(-cells["n"].to_numpy() // PART))
        if len(self.ids):  # else there is no file to tell the columns
            self.vectors = spark.read.parquet(f"{path}/vectors")
            if where is not None:
                self.vectors = self.vectors.where(where)

    def choice(self, probes: DataFrame, first: int | None) -> DataFrame:
        """probe, cell, reach: the first cells of each probe by the angle to their centres (all: None), and how near, as
        a distance, a vector of the cell can be."""
        ids, centres, radii = self.ids, self.centres, self.radii

        @F.arrow_udf("array<struct<cell:int,reach:double,nth:int>>")
        def cells_of(embeddings: pa.Array) -> pa.Array:
            angle = np.arccos(np.clip(unit(matrix(embeddings)) @ centres.T, -1, 1))
            order = np.argsort(angle, axis=1)[:, :first]
            reach = 1 - np.cos(np.clip(np.take_along_axis(angle, order, axis=1) - radii[order], 0, np.pi))
            width = order.shape[1]
            rows = pa.StructArray.from_arrays(
                [pa.array(ids[order].ravel().astype(np.int32)), pa.array(reach.ravel()), pa.array(np.tile(np.arange(width, dtype=np.int32), len(order)))], ["cell", "reach", "nth"]
            )
            return pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * width), rows)

        return probes.select("probe", F.explode(cells_of("embedding")).alias("c")).select("probe", "c.*")

    def visit(self, probes: DataFrame, pairs: DataFrame, k: int, within: float | None, apart: Column) -> DataFrame:
        """probe, vec_id, distance: of the vectors in the cells that pairs (probe, cell) name, k nearest of each probe
        and task at most. A task is a part of a cell with a block of the probes that visit it."""
        parts = self.spark.createDataFrame([(int(c), int(p)) for c, p in zip(self.ids, self.parts)], "cell int, parts int")
        blocks = pairs.groupBy("cell").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("blocks"))  # a row for each cell
        cut = checkpointed(blocks.join(F.broadcast(parts), "cell"))
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        asked = pairs.join(probes, "probe").join(F.broadcast(cut), "cell").withColumn("block", F.pmod(F.xxhash64("probe"), "blocks").cast("int")).withColumn("part", spread("parts"))
        held = self.vectors.join(F.broadcast(cut), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int")).withColumn("block", spread("blocks"))
        task = ["cell", "part", "block"]
        left = asked.select(*task, "probe", "own", F.col("embedding").cast("array<double>").alias("embedding"))
        right = held.select(*task, "vec_id", apart.cast("long").alias("own"), F.col("embedding").cast("array<double>").alias("embedding"))

        def compare(p: pa.Table, v: pa.Table) -> pa.Table:
            ids, names, out = v["vec_id"].to_numpy(), p["probe"].to_numpy(), []
            groups, own = v["own"].to_numpy(), p["own"].to_numpy()
            if len(ids) and len(names):
                theirs, mine = unit(matrix(v["embedding"])), unit(matrix(p["embedding"]))
                for a in range(0, len(names), 256):
                    far = np.round(1 - mine[a : a + 256] @ theirs.T, PLACES)
                    far[own[a : a + 256, None] == groups[None, :]] = np.inf
                    if within is not None:
                        far[far > within] = np.inf
                    order = np.lexsort((np.broadcast_to(ids, far.shape), far), axis=1)[:, :k]
                    kept = np.take_along_axis(far, order, axis=1)
                    ok = np.isfinite(kept)
                    out.append((np.broadcast_to(names[a : a + 256, None], order.shape)[ok], ids[order][ok], kept[ok]))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            return pa.table(dict(zip(("probe", "vec_id", "distance"), columns)))

        return left.groupBy(*task).cogroup(right.groupBy(*task)).applyInArrow(compare, "probe long, vec_id long, distance double")

    def nearest(self, probes: DataFrame, k: int, within: float | None = None, first: int = 8, exact: bool = True, apart: Column | None = None) -> DataFrame:
        """probe, vec_id, distance, rn: the k nearest vectors of each of probes (probe, embedding), at most so far away,
        by distance to nine places, then vec_id. Those that apart (a number of a vector's columns; vec_id, if not given)
        gives the same number as the probe's own (probe, if there is no such column) are left out. first: cells that
        are visited before the others are judged; with exact=False the only ones."""
        if not len(self.ids):
            return self.spark.createDataFrame([], "probe long, vec_id long, distance double, rn int")
        own = F.col("own") if "own" in probes.columns else F.col("probe")
        asked = checkpointed(probes.where("embedding is not null").select("probe", "embedding", own.cast("long").alias("own")))
        apart = F.col("vec_id") if apart is None else apart
        bound = 2.0 if within is None else within
        cells = self.choice(asked, None if exact else first).where(F.col("reach") <= bound + 1e-9)
        early = F.col("nth") < first
        found = self.visit(asked, cells.where(early).select("probe", "cell"), k, within, apart)
        if exact and first < len(self.ids):
            found = checkpointed(found)
            kth = self.ranked(found, k).groupBy("probe").agg(F.max(F.when(F.col("rn") == k, F.col("distance"))).alias("kth"))
            later = cells.where(~early).join(kth, "probe", "left").where(F.col("reach") <= F.coalesce("kth", F.lit(bound)) + 1e-9)
            found = found.unionByName(self.visit(asked, later.select("probe", "cell"), k, within, apart))
        return self.ranked(found, k)

    def cells_for(self, probes: DataFrame, k: int, recall: float = 0.95) -> int:
        """How many cells a search with exact=False must visit to find so large a share of the k nearest of probes (a
        sample that the caller picks): the place of each exact neighbour's cell in its probe's order tells."""
        found = self.nearest(probes, k).join(self.vectors.select("vec_id", "cell"), "vec_id")
        nth = found.join(self.choice(probes, None), ["probe", "cell"]).groupBy("nth").agg(F.count("*").alias("n")).orderBy("nth").toArrow()
        if not len(nth):
            return 1
        upto = np.cumsum(nth["n"].to_numpy())
        return int(nth["nth"].to_numpy()[np.searchsorted(upto, recall * upto[-1])]) + 1

    def ranked(self, found: DataFrame, k: int) -> DataFrame:
        """The first k of each probe, numbered."""
        rank = F.row_number().over(Window.partitionBy("probe").orderBy("distance", "vec_id"))
        return found.withColumn("rn", rank).where(F.col("rn") <= k)
