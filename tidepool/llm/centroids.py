"""Centroid clustering over distinct quantised vectors, in whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.store import drop, written

K = 16
ROUNDS = 3
WIDTH = 64
SCALE = 64
SEED = 1
#: Quantised components are held within these limits, so that squared distances and a task's sums stay whole numbers of 64 bits.
MOST = 1 << 26
#: Vectors that have more than this share of all rows go to their rows by a broadcast: fewer than 1 / share of them.
HOT_SHARE = 1e-3


def quantised(width: int = WIDTH, scale: int = SCALE, embedding: str = "embedding") -> Column:
    """``floor(scale * x)`` of each component, or null for vectors that are null, of another width, or hold null or non-finite components."""
    sound = (F.size(embedding) == width) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    limited = F.transform(embedding, lambda x: F.least(F.lit(float(MOST)), F.greatest(F.lit(-float(MOST)), F.floor(x.cast("double") * scale).cast("double"))).cast("int"))
    return F.when(F.coalesce(sound, F.lit(False)), limited)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width).astype(np.int64)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid (ties: the smaller number) and its squared distance."""
    distance = (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)
    cluster = distance.argmin(1)
    return cluster, distance[np.arange(len(x)), cluster]


def _replaced(classes: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: every task sums its distinct vectors, weighted by their rows, and the sums are summed by component."""
    k, width = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = [[0] * width for _ in range(k)], [0] * k
        for batch in batches:
            x, n = _matrix(batch.column(0), width), batch.column(1).to_numpy()
            cluster, _ = _nearest(x, centroids)
            for c in np.unique(cluster).tolist():
                own = cluster == c
                weight[c] += int(n[own].sum())
                # in halves of 16 bits, as a product of a component and many rows may pass 64 bits
                high, low = (x[own] >> 16) * n[own, None], (x[own] & 0xFFFF) * n[own, None]
                total[c] = [t + (int(h) << 16) + int(lo) for t, h, lo in zip(total[c], high.sum(0), low.sum(0), strict=True)]
        used = [c for c in range(k) if weight[c]]
        rows = [[str(v) for v in (weight[c], *total[c])] for c in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(rows, pa.list_(pa.string()))], ["cluster", "parts"])

    made = classes.select("q", "rows").mapInArrow(sums, "cluster int, parts array<string>")
    parts = made.select("cluster", F.posexplode("parts").alias("at", "part")).groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    found: dict[int, dict[int, int]] = {}
    for r in parts.collect():  # at most k x (width + 1) numbers
        found.setdefault(r.cluster, {})[r["at"]] = int(r.total)
    return np.array([[found[c][i + 1] // found[c][0] for i in range(width)] if c in found else centroids[c] for c in range(k)], np.int64)


def _assigned(classes: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``q, rows, cluster, distance`` of the distinct vectors."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = _nearest(_matrix(batch.column(0), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster, pa.int32()), pa.array(distance)], ["q", "rows", "cluster", "distance"])

    return classes.select("q", "rows").mapInArrow(assign, "q array<int>, rows long, cluster int, distance long")


def _whole(value: Column) -> Column:
    """A sum of decimals as a long, at most the largest one."""
    return F.least(value, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid`` of each vector of ``rows`` (``vec_id, embedding``) that is kept; other columns are ignored.

    Kept are vectors of exactly ``width`` components, none null or non-finite; of others, and of an empty table, no row comes out. A component becomes
    ``floor(scale * x)``, held within 2**26 on either side. Centroids start as the kept rows with the smallest SHA-256 of ``seed:vec_id`` (a null id: nothing after
    the colon; ties by the vector), fewer than ``k`` if there are fewer rows. Equal quantised vectors are one class with the number of its rows; rounds and
    the last assignment work on classes, and sums are exact whole numbers. ``distance`` is squared; ``cluster_inertia`` and ``inertia`` sum it over a cluster's and over all rows,
    up to the largest long. Repeated rows count as often as they come.

    Classes go back to their rows by a join on the vector. The few that have more than ``HOT_SHARE`` of all rows are broadcast instead, so no task gets a hot vector's rows.
    """
    kept = rows.select("vec_id", quantised(width, scale).alias("q")).where("q is not null")
    classes = written(kept.groupBy("q").agg(F.count(F.lit(1)).alias("rows")), "vectors")
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256), "q").limit(k)
    centroids = np.array([r.q for r in first.select("q").collect()], np.int64).reshape(-1, width)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _replaced(classes, centroids)
    if len(centroids):
        assigned = written(_assigned(classes, centroids), "assigned")
        drop(classes)
    else:
        assigned = classes.select("q", "rows", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    by_cluster = assigned.groupBy("cluster").agg(F.sum("rows").alias("n"), F.sum(F.col("distance").cast("decimal(38,0)") * F.col("rows")).cast("decimal(38,0)").alias("d"))
    totals = by_cluster.collect()  # at most k
    inertia = sum(int(r.d) for r in totals)
    schema = "cluster int, cluster_inertia decimal(38,0), centroid array<long>"
    of_cluster = rows.sparkSession.createDataFrame([(r.cluster, r.d, centroids[r.cluster].tolist()) for r in totals], schema)
    hot = assigned.where(F.col("rows") > sum(r.n for r in totals) * HOT_SHARE).select(F.col("q").alias("q_hot"), F.struct("cluster", "distance").alias("hot"))
    found = kept.join(F.broadcast(hot), F.col("q") == F.col("q_hot"), "left")
    rest = assigned.select(F.col("q").alias("q_own"), F.struct("cluster", "distance").alias("own"))
    plain = found.where("hot is null").join(rest, F.col("q") == F.col("q_own")).select("vec_id", "own.*")
    both = found.where("hot is not null").select("vec_id", "hot.*").unionByName(plain)
    out = both.join(F.broadcast(of_cluster), "cluster")
    return out.select("vec_id", "cluster", "distance", _whole(F.col("cluster_inertia")).alias("cluster_inertia"), F.lit(min(inertia, 2**63 - 1)).cast("long").alias("inertia"), "centroid")
