"""Approximate nearest neighbours by inner product over balanced posting lists.

Centroids are fitted on a bounded sample by splitting it in two until every part
is small, so lists are about equally long. All vectors are indexed: each goes to
its nearest list, and a vector near a boundary also to others whose centroids are
at most so many times as far away. Centroids, a few thousand at most, are held in memory and
all compared with each point in one matrix product. A query reads
all lists whose centroid is at most so many times as far away as the nearest one,
a few nearest ones first: what they hold tells which entries of the others count.

Inner products become distances by one more component that gives every vector
the same length. Rows with equal vectors are one entry with the ids that can be
among the nearest, so a vector that a third of all rows share costs no more than
any other; long lists are cut into chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetloom.session import cut

#: Vectors that centroids are fitted on, chosen by a hash of the id (about as many, or all if fewer).
SAMPLE_ROWS = 50_000
#: Vectors of a list on average, and the most centroids.
LIST_ROWS = 100
MOST_LISTS = 4_096
#: Entries of a list that are compared in one group.
CHUNK_ROWS = 4_096
#: Lists of a boundary vector, and how much farther than the nearest they may be.
COPIES = 6
COPY_RATIO = 1.15
#: How much farther than the nearest list a query looks.
QUERY_RATIO = 1.3
#: Lists that a query reads first; the others only send what reaches the last place found there.
NEAR_LISTS = 8


@dataclass
class Index:
    """Centroids of the lists."""

    centroids: np.ndarray

    def distances(self, points: np.ndarray) -> np.ndarray:
        """From each point to every centroid."""
        return np.sqrt(np.maximum(0, _square(points, self.centroids)))

    def lists(self, points: np.ndarray) -> list[np.ndarray]:
        """The lists that each indexed point goes to, nearest first."""
        far = self.distances(points)
        most = min(COPIES, far.shape[1])
        ids = np.argpartition(far, most - 1, 1)[:, :most]
        far = np.take_along_axis(far, ids, 1)
        order = np.argsort(far, 1, kind="stable")
        ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
        return [own[keep] for own, keep in zip(ids, far <= COPY_RATIO * far[:, :1])]

    def probes(self, points: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """The lists that each query reads: all within the ratio, and more until they hold ``least`` entries.

        An entry is in at most ``COPIES`` lists; where all lists hold too few, all are read.
        """
        out = []
        for distance in self.distances(points):
            own = np.argsort(distance, kind="stable")
            enough = int(np.searchsorted(np.cumsum(sizes[own]), least * COPIES)) + 1
            close = int(np.count_nonzero(distance <= QUERY_RATIO * distance[own[0]] + 1e-12))
            out.append(own[: max(enough, close)])
        return out


def lift(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with one more component so that all are as long as the longest."""
    rest = np.sqrt(np.maximum(0, longest**2 - np.einsum("ij,ij->i", vectors, vectors)))
    return np.hstack([vectors, rest[:, None]])


def split(points: np.ndarray, most: int, seed: int = 1) -> np.ndarray:
    """Centroids of parts of at most ``most`` points, by halving along the two means; equal points stay together."""
    chance = np.random.default_rng(seed)
    centroids, todo = [], [points]
    while todo:
        part = todo.pop()
        if len(part) <= most:
            centroids.append(part.mean(0))
            continue
        pair = part[chance.choice(len(part), 2, replace=False)]
        for _ in range(8):
            side = part @ (pair[1] - pair[0]) > ((pair[1] ** 2).sum() - (pair[0] ** 2).sum()) / 2
            if not 0 < side.sum() < len(part):
                break
            pair = np.stack([part[~side].mean(0), part[side].mean(0)])
        along = part @ (pair[1] - pair[0])
        side = along > ((pair[1] ** 2).sum() - (pair[0] ** 2).sum()) / 2
        if not len(part) / 4 <= side.sum() <= len(part) * 3 / 4:
            side = along > np.median(along)
        if not 0 < side.sum() < len(part):
            centroids.append(part.mean(0))
        else:
            todo += [part[~side], part[side]]
    return np.array(centroids)


def build(points: np.ndarray, lists: int) -> Index:
    """An index of about ``lists`` lists over sampled points."""
    centroids = split(points, max(1, -(-len(points) // max(1, lists))))
    for _ in range(2):  # let the centroids settle
        nearest = np.concatenate([_square(points[a : a + 2048], centroids).argmin(1) for a in range(0, len(points), 2048)])
        size = np.bincount(nearest, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, nearest, points)
        centroids = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centroids)
        centroids *= (np.linalg.norm(points[0]) / np.maximum(np.linalg.norm(centroids, axis=1), 1e-300))[:, None]  # onto the points' sphere
    return Index(centroids)


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None]


def reaching(scores: np.ndarray, most: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``most`` highest scores of each row, without those below what is ``known`` to be reached elsewhere."""
    bar = np.maximum(np.partition(scores, scores.shape[1] - most, 1)[:, scores.shape[1] - most], known)
    slack = 1e-9 * np.maximum(1, np.abs(bar, where=np.isfinite(bar), out=np.zeros(len(bar))))
    return np.nonzero(scores >= (bar - slack)[:, None])


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def nearest(vectors: DataFrame, is_query: str, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows found for every query row.

    Reads ``vec_id`` and ``embedding``; ``is_query`` is the SQL condition on ``vec_id`` that
    makes a row a query. Nearest is the largest inner product in double precision, ties go
    to the smaller ``vec_id``; a query's own id is no candidate of it. Rows with a null id,
    and vectors that are null, empty, zero, of another length than most, or hold null or
    non-finite components, take no part. Repeated rows of one id count once. Fewer than
    ``k`` candidates give all of them; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    fine = "vec_id IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"
    rows = vectors.select("vec_id", "embedding").where(fine)
    sizes = rows.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    size = sizes[0]["size"]
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    rows = rows.where(F.size("embedding") == size).distinct()
    few = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    entries = cut(few.groupBy("embedding").agg(F.min("vec_id").alias("entry"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts = entries.agg(F.count("*").alias("n"), F.max(square).alias("square")).collect()[0]
    longest = float(np.sqrt(facts["square"])) * (1 + 1e-12)
    chance = F.pmod(F.xxhash64("entry"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = entries.where(chance < min(1.0, SAMPLE_ROWS / facts["n"])).select("embedding").toArrow()["embedding"].combine_chunks()
    points = lift(_matrix(sample, size), longest)
    index = spark.sparkContext.broadcast(build(points, int(min(MOST_LISTS, max(1, facts["n"] // LIST_ROWS)))))

    def deal(query: bool, part_of: slice = slice(None)):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 1024):
                    part = batch.slice(at, 1024)
                    matrix = _matrix(part.column("embedding"), size)
                    if query:  # a query's length does not matter; as long as the longest it lies on their sphere
                        own = np.hstack([matrix * (longest / np.linalg.norm(matrix, axis=1))[:, None], np.zeros((len(matrix), 1))])
                        found = [read[part_of] for read in index.value.probes(own, lengths, k + 1)]
                    else:
                        found = index.value.lists(lift(matrix, longest))
                    row = pa.array(np.repeat(np.arange(len(part)), [len(f) for f in found]))
                    lists = pa.array(np.concatenate(found).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([lists, *[part.column(c).take(row) for c in names[1:]]], names)

        names = ["list", "entry", "embedding"] + ["ids"] * (not query)
        return run

    kind = vectors.schema["embedding"].dataType.simpleString()
    posted = cut(entries.mapInArrow(deal(False), f"list int, entry long, embedding {kind}, ids array<long>"), "postings")
    chunks = posted.groupBy("list").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks"))
    counted = posted.groupBy("list").agg(F.count("*").alias("n")).collect()  # at most MOST_LISTS rows and a few
    lengths = np.zeros(len(index.value.centroids), np.int64)
    lengths[[r["list"] for r in counted]] = [r["n"] for r in counted]
    asked = cut(rows.where(is_query).groupBy("embedding").agg(F.min("vec_id").alias("asked")), "queries")
    members = posted.join(chunks, "list").select(
        "list", F.pmod(F.xxhash64("entry"), F.col("chunks")).cast("int").alias("chunk"), F.lit(0).alias("kind"), "entry", "embedding", "ids",
        F.lit(None).cast("double").alias("bar"),
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, held_ids, matrix = None, [], [], np.zeros((0, size))
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("list", "chunk", "kind")], 1)
            own, ids, entry = _matrix(batch.column("embedding"), size), batch.column("ids"), batch.column("entry").to_numpy()
            known = batch.column("bar").fill_null(-np.inf).to_numpy()
            turns = np.flatnonzero(np.any(keys[1:] != keys[:-1], 1)) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(keys)]):
                if tuple(keys[a, :2]) != group:
                    group, held, held_ids, matrix = tuple(keys[a, :2]), [], [], np.zeros((0, size))
                if keys[a, 2] == 0:
                    held.append(own[a:b])
                    held_ids.append(ids[a:b])
                    continue
                if held:
                    matrix = np.concatenate([matrix, *held])
                    held, held_ids = [], [pa.concat_arrays(held_ids)]
                if not len(matrix):
                    continue
                for q in range(a, b, 256):
                    rough = own[q : min(b, q + 256)] @ matrix.T
                    most = min(k + 1, len(matrix))
                    asking, found = reaching(rough, most, known[q : q + len(rough)])
                    score = (own[q + asking] * matrix[found]).sum(1)
                    columns = [pa.array(entry[q + asking]), pa.array(score), held_ids[0].take(pa.array(found))]
                    yield pa.RecordBatch.from_arrays(columns, ["asked", "score", "ids"])

    by_score = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")

    def read(part_of: slice, bars: DataFrame) -> DataFrame:
        """What these lists of each query hold that reaches its bar."""
        names = f"list int, entry long, embedding {kind}"
        probes = asked.withColumnRenamed("asked", "entry").mapInArrow(deal(True, part_of), names).join(bars, "entry", "left")
        questions = probes.join(chunks, "list").select(
            "list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("kind"), "entry", "embedding",
            F.lit(None).cast("array<long>").alias("ids"), "bar",
        )
        near = (
            members.union(questions).repartition("list", "chunk").sortWithinPartitions("list", "chunk", "kind")
            .mapInArrow(compare, "asked long, score double, ids array<long>")
        )
        return near.select("asked", "score", F.explode("ids").alias("vec_id"))

    def leading(found: DataFrame) -> DataFrame:
        return found.distinct().withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k + 1)

    first = cut(leading(read(slice(NEAR_LISTS), spark.createDataFrame([], "entry long, bar double"))), "near")
    last = first.where(F.col("place") == k + 1).select(F.col("asked").alias("entry"), F.col("score").alias("bar"))
    best = leading(read(slice(NEAR_LISTS, None), last).union(first.drop("place")))
    who = rows.where(is_query).join(asked, "embedding").select(F.col("vec_id").alias("query_id"), "asked")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        who.join(best, "asked").where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
