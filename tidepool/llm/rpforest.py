"""Near-duplicate vectors by a forest of random-projection trees with spill."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.components import connected_components
from tidepool.llm.store import drop, written

TREES = 8
LEAF = 256
#: Vectors within this share of a node's on either side of the median go to both of its children.
SPILL = 0.05
THRESHOLD = 0.93
MOST_LEVELS = 80
#: Projections of unit vectors that differ by no more are equal.
EQUAL = 1e-12
#: Members of a ball within this share of its largest radius go into the forest with its center, others by themselves.
INNER = 0.2
#: Levels whose projections go with a vector at once.
DEPTH = 12
#: Vectors of a component that are compared with as many others in one task.
BLOCK = 2048


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as rows."""
    return np.stack(column.to_numpy(zero_copy_only=False)) if len(column) else np.zeros((0, 1))


def _projections(vectors: DataFrame, trees: int, first: int, seed: int) -> DataFrame:
    """``id, label, dim, tree, at`` of each vector and tree: projections on the random directions of ``DEPTH`` levels from ``first`` on."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                own = pa.array(np.flatnonzero(dims == d))
                unit = _unit(_matrix(batch.column(3).take(own)))
                keys = [batch.column(i).take(own) for i in range(3)]
                for t in range(trees):
                    directions = np.stack([np.random.default_rng([seed, t, first + k, d]).normal(size=d) for k in range(DEPTH)])
                    at = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * DEPTH, pa.int32()), pa.array((unit @ directions.T).ravel()))
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(np.full(len(own), t, np.int32)), at], ["id", "label", "dim", "tree", "at"])

    return vectors.select("id", "label", "dim", "vec").mapInArrow(project, "id long, label long, dim int, tree int, at array<double>")


def grow(vectors: DataFrame, trees: int, leaf: int = LEAF, spill: float = SPILL, seed: int = 1) -> DataFrame:
    """``id, label, dim, vec, tree, node, home`` of each vector in each leaf that holds it; ``home``: where it is without spill.

    Level by level, every node of more than ``leaf`` vectors is split at the median of their projections on a random
    direction of its tree and level; medians and spill limits are approximate percentiles, which are
    aggregated in the tasks first, and a node's go to its vectors by a join. What a level writes are ids, nodes and projections, not vectors. Where
    all of a node's projections are equal, as parallel vectors' are, ids' hashes split it.
    """
    names = ["id", "label", "dim", "tree", "node", "home"]
    keys = ["label", "dim", "tree", "node"]
    done: list[DataFrame] = []
    before: list[DataFrame] = []
    active = None
    for level in range(MOST_LEVELS):
        if level % DEPTH == 0:
            made = _projections(vectors, trees, level, seed)
            active = made.withColumns({"node": F.lit(""), "home": F.lit(True)}) if active is None else active.drop("at").join(made.select("id", "tree", "at"), ["id", "tree"])
        active = written(active.select(*names, "at"), "level")
        drop(*before)
        limits = F.percentile_approx("now", F.array(*[F.lit(x) for x in (0.5 - spill, 0.5, 0.5 + spill)]), F.lit(1000))
        placed = active.withColumn("now", F.get("at", F.lit(level % DEPTH)))
        equal = F.max("now") - F.min("now") <= EQUAL
        nodes = written(placed.groupBy(keys).agg(F.count(F.lit(1)).alias("n"), limits.alias("cut"), equal.alias("equal")), "nodes")
        before = [active, nodes]
        rows = placed.join(nodes, keys)
        done.append(written(rows.where(F.col("n") <= leaf).select(names), "leaves"))
        if nodes.where(F.col("n") > leaf).isEmpty():
            drop(*before)
            return functools.reduce(DataFrame.unionByName, done).join(vectors.select("id", "vec"), "id")
        odd = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(2)) == 1
        left = F.when(F.col("equal"), ~odd).otherwise(F.col("now") <= F.col("cut")[2])
        right = F.when(F.col("equal"), odd).otherwise(F.col("now") > F.col("cut")[0])
        is_left = F.when(F.col("equal"), ~odd).otherwise(F.col("now") <= F.col("cut")[1])
        sides = F.array_compact(F.array(F.when(left, F.struct(F.lit("0").alias("s"), is_left.alias("h"))), F.when(right, F.struct(F.lit("1").alias("s"), (~is_left).alias("h")))))
        active = rows.where(F.col("n") > leaf).withColumn("side", F.explode(sides))
        active = active.withColumns({"node": F.concat("node", "side.s"), "home": F.col("home") & F.col("side.h")})
    raise RuntimeError("nodes could not be split")


def _leaders(vectors: DataFrame, radius: float, seed: int) -> DataFrame:
    """``id, leader``: vectors of a tree's leaves, each with the first of the leaf's leaders within ``radius`` (an angle)."""
    least = math.cos(radius)

    def lead(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        unit, ids = _unit(np.stack(rows["vec"])), rows["id"].to_numpy()
        leader = np.full(len(ids), -1)
        for i in range(len(ids)):
            if leader[i] < 0:
                leader[(leader < 0) & (unit @ unit[i] >= least)] = i
                leader[i] = i
        return pd.DataFrame({"id": ids, "leader": ids[leader]})

    leaves = grow(vectors, 1, seed=seed).where("home")
    return leaves.groupBy("label", "dim", "node").applyInPandas(lead, "id long, leader long")


def _cosine(a: str, b: str) -> Column:
    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, z: s + z)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def balls(vectors: DataFrame, threshold: float, rounds: int = 3) -> DataFrame:
    """``id, ball, vec, angle``: a partition into balls whose members are all linked with each other.

    Each round joins vectors to leaders within the leaves of a tree, then only the leaders go on. A vector is in the
    ball of its last leader if the angle between them (``angle``) is less than half the threshold's, else of its first, for which
    it is. By the triangle inequality any two of a ball are within the threshold, so their links need no pairs.
    """
    half = math.acos(threshold) * 0.499
    first = chain = written(_leaders(vectors, half, 101), "leaders")
    for i in range(1, rounds):
        chiefs = vectors.join(chain.select(F.col("leader").alias("id")).distinct(), "id")
        above = _leaders(chiefs, half, 101 + i).select(F.col("id").alias("leader"), F.col("leader").alias("above"))
        chain = written(chain.join(above, "leader").select("id", F.col("above").alias("leader")), "leaders")
    own = vectors.select("id", "vec").join(first, "id").join(chain.withColumnRenamed("leader", "last"), "id")
    center = vectors.select("id", "vec")
    own = own.join(center.toDF("last", "last_vec"), "last").join(center.toDF("leader", "leader_vec"), "leader")

    def angle(to: str) -> Column:
        return F.acos(F.least(F.lit(1.0), _cosine("vec", to)))

    last = angle("last_vec")
    out = own.select("id", "vec", F.when(last <= half, F.struct(F.col("last").alias("ball"), last.alias("angle"))).otherwise(F.struct(F.col("leader").alias("ball"), angle("leader_vec").alias("angle"))).alias("b"))
    return written(out.select("id", "b.ball", "vec", "b.angle"), "balls")


def _spanning(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the first row of its component."""
    first = np.full(len(linked), -1)
    for i in range(len(linked)):
        if first[i] < 0:
            new = np.zeros(len(linked), bool)
            new[i] = True
            while new.any():
                first[new] = i
                new = linked[new].any(0) & (first < 0)
    return first


def _between(members: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: for each of ``pairs`` (``stand, other``) one link between their members, if there is one in a pair of their blocks; no more, as one joins their components."""
    sizes = members.groupBy("stand").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = members.join(sizes, "stand").select("stand", "id", "vec", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
    cells = pairs.join(sizes, "stand").join(sizes.toDF("other", "more"), "other")
    cells = cells.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = written(cells.withColumn("beside", F.explode(F.sequence(F.lit(0).cast("long"), F.col("more") - 1))).select("stand", "other", "block", "beside"), "cells")
    keys = ["stand", "other", "block", "beside"]
    left = cells.join(dealt, ["stand", "block"]).select(*keys, F.lit(True).alias("is_a"), "id", "vec")
    right = cells.join(dealt.toDF("other", "id", "vec", "beside"), ["other", "beside"]).select(*keys, F.lit(False).alias("is_a"), "id", "vec")

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["is_a"]], rows[~rows["is_a"]]
        i, j = np.nonzero(_unit(np.stack(a["vec"])) @ _unit(np.stack(b["vec"])).T >= threshold) if len(a) and len(b) else ([], [])
        return pd.DataFrame({"a": a["id"].to_numpy()[i[:1]], "b": b["id"].to_numpy()[j[:1]]}) if len(i) else pd.DataFrame({"a": [], "b": []}, dtype=np.int64)

    return left.unionByName(right).groupBy(keys).applyInPandas(first, "a long, b long")


def _across(known: DataFrame, radius: DataFrame, threshold: float) -> DataFrame:
    """``id, links``: rows of other balls of its component that a vector is linked with, in parts that have to be added.

    All pairs of a component are compared, block against block, except those in one ball, which are linked anyway, and
    those of two large balls that are too far apart. A large ball's members are in blocks of their own. Small components go into
    one block with others. No pair becomes a row: a pair of blocks gives a number for each vector that has links.
    """
    sizes = known.groupBy("component", "dim").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ball").alias("balls")).where("balls > 1")
    sizes = written(sizes.select("component", "dim", "n"), "sizes")
    small = BLOCK // 8
    buckets = math.ceil((sizes.where(F.col("n") <= small).agg(F.sum("n")).first()[0] or 0) / (2 * small)) or 1
    bucket = F.concat_ws(":", F.lit("small"), "dim", F.pmod(F.xxhash64("component"), F.lit(buckets)))
    parts = sizes.select("component", "n", F.when(F.col("n") <= small, bucket).otherwise(F.concat(F.lit("one:"), "component")).alias("part"))
    large = known.groupBy("ball").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > BLOCK).select("ball", F.col("ball").cast("string").alias("own"))
    rows = known.join(parts, "component").join(large, "ball", "left").withColumn("own", F.coalesce("own", F.lit("")))
    groups = rows.groupBy("part", "own").agg(F.count(F.lit(1)).alias("n"))
    groups = written(groups.withColumn("blocks", F.when(F.startswith("part", F.lit("small")), 1).otherwise(F.ceil(F.col("n") / BLOCK))).drop("n"), "groups")
    rows = rows.join(groups, ["part", "own"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = written(rows.select("part", "own", "block", "id", "component", "ball", "rows", "vec"), "members")

    centers = known.where("id = ball").join(radius, "ball").select(F.col("ball").cast("string").alias("own"), "vec", "radius")
    blocks = groups.join(centers, "own", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    pairs = blocks.toDF("own_a", "part", "vec_a", "radius_a", "block_a").join(blocks.toDF("own_b", "part", "vec_b", "radius_b", "block_b"), "part")
    ordered = F.struct("own_a", "block_a") <= F.struct("own_b", "block_b")
    in_one = (F.col("own_a") != "") & (F.col("own_a") == F.col("own_b"))
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), _cosine("vec_a", "vec_b"))))
    near = F.coalesce(angle <= math.acos(threshold) + 1e-7 + F.col("radius_a") + F.col("radius_b"), F.lit(True))
    keys = ["part", "own_a", "block_a", "own_b", "block_b"]
    pairs = written(pairs.where(ordered & ~in_one & near).select(keys), "blocks")

    def side(s: str) -> DataFrame:
        own = rows.withColumnsRenamed({"own": f"own_{s}", "block": f"block_{s}"})
        return own.join(pairs, ["part", f"own_{s}", f"block_{s}"]).select(*keys, F.lit(s == "a").alias("is_a"), "id", "component", "ball", "rows", "vec")

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["is_a"]], rows[~rows["is_a"]]
        linked = _unit(np.stack(a["vec"])) @ _unit(np.stack(b["vec"])).T >= threshold if len(a) and len(b) else np.zeros((len(a), len(b)), bool)
        for c, same in (("component", True), ("ball", False)):
            linked &= (a[c].to_numpy()[:, None] == b[c].to_numpy()[None, :]) == same
        found = [(a, linked @ b["rows"].to_numpy())]
        first = rows.iloc[0]
        if (first["own_a"], first["block_a"]) != (first["own_b"], first["block_b"]):
            found.append((b, linked.T @ a["rows"].to_numpy()))
        made = pd.DataFrame({"id": np.concatenate([r["id"].to_numpy() for r, _ in found]), "links": np.concatenate([n for _, n in found])})
        return made[made["links"] > 0]

    return side("a").unionByName(side("b")).groupBy(keys).applyInPandas(count, "id long, links long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, trees: int = TREES) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``rows`` (``vec_id, embedding, label``; other columns are ignored).

    Two vectors of one label are linked if their cosine, in double precision, is ``threshold`` at least. ``n_links``: other
    rows linked directly; ``component_id``: the smallest ``vec_id`` reached; ``kept`` marks it. Vectors that are null, empty,
    zero or hold a null or non-finite component, and rows without label or id, are linked with nothing; vectors of different
    lengths neither. Repeated rows are linked with each other.

    Equal vectors are one class, with a number of its own and that of its rows, so rows of one ``vec_id`` with different vectors are told apart. Classes in a ball (see ``balls``) are linked without
    pairs. Balls' centers go into the forest, and so do members away from them; two vectors that meet in a leaf, are near enough for what they stand for and aren't connected by other links have
    their members compared. In the components that this gives, all pairs are compared (see ``_across``), so leaves don't limit a group's links. Every
    link found is exact. A link between components whose balls no leaf holds would be missed; the tests measure the recall.
    """
    ok = F.coalesce(
        F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    sound = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("vec"), ok.alias("ok"))
    classes = sound.where("ok").groupBy("label", "vec").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("rows"))
    classes = written(classes.withColumns({"dim": F.size("vec"), "id": F.monotonically_increasing_id()}), "classes")
    vectors = classes.select("id", "label", "dim", "vec")
    ball = balls(vectors, threshold)
    radius = ball.groupBy("ball").agg(F.max("angle").alias("radius"))
    most = math.acos(threshold) + 1e-7
    stands = F.when(F.col("angle") <= math.acos(threshold) * 0.499 * INNER, F.col("ball")).otherwise(F.col("id"))
    ball = written(ball.withColumn("stand", stands), "stands")
    reach = ball.groupBy("stand").agg(F.max(F.when(F.col("id") == F.col("stand"), 0.0).otherwise(F.col("angle"))).alias("reach"))
    reach = written(reach, "reach")
    inside = vectors.join(reach.withColumnRenamed("stand", "id"), "id")
    leaves = grow(inside.select("id", "label", "dim", "vec"), trees, seed=7).join(reach.withColumnRenamed("stand", "id"), "id")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        unit, ids, own = _unit(np.stack(rows["vec"])), rows["id"].to_numpy(), rows["reach"].to_numpy()
        cosine = unit @ unit.T
        tree = _spanning(cosine >= threshold)
        near = np.arccos(np.clip(cosine, -1, 1)) <= most + own[:, None] + own[None, :]
        near &= (own[:, None] > 0) | (own[None, :] > 0)  # else the vectors themselves decide
        a, b = np.nonzero(near & (ids[:, None] < ids[None, :]) & (tree[:, None] != tree[None, :]))
        other = np.flatnonzero(tree != np.arange(len(ids)))
        return pd.DataFrame({"stand": ids[np.append(a, tree[other])], "other": ids[np.append(b, other)], "linked": np.arange(len(a) + len(other)) >= len(a)})

    met = written(leaves.groupBy("label", "dim", "tree", "node").applyInPandas(compare, "stand long, other long, linked boolean").distinct(), "met")
    edges = met.where("linked").select(F.col("stand").alias("a"), F.col("other").alias("b")).unionByName(ball.where("id <> ball").select(F.col("id").alias("a"), F.col("ball").alias("b")))
    joined = written(connected_components(edges, "a", "b").toDF("id", "component"), "joined")
    members = written(ball.join(joined, "id", "left").select("stand", "id", "vec", F.coalesce("component", "id").alias("component")), "members")
    one = members.where("id = stand").select("stand", F.col("component").alias("one"))
    apart = met.where("not linked").join(one, "stand").join(one.toDF("other", "two"), "other").where("one <> two").select("stand", "other")
    pairs = written(_between(members, apart, threshold), "pairs")
    if not pairs.isEmpty():
        edges = pairs.unionByName(joined.toDF("a", "b"))
        joined = written(connected_components(edges, "a", "b").toDF("id", "component"), "joined")
    known = classes.select("id", "vec_id", "dim", "rows", "vec").join(ball.select("id", "ball"), "id").join(joined, "id", "left")
    known = written(known.withColumn("component", F.coalesce("component", "id")), "known")
    inside = known.groupBy("ball").agg(F.sum("rows").alias("in_ball"))
    across = _across(known, radius, threshold).groupBy("id").agg(F.sum("links").alias("across"))
    least = known.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    known = known.select("id", "rows", "ball", "component").join(inside, "ball").join(across, "id", "left").join(least, "component")
    links = F.col("in_ball") - 1 + F.coalesce("across", F.lit(0))
    known = classes.select("id", "label", "vec").join(known.select("id", links.alias("n_links"), "component_id"), "id").drop("id")
    known = known.withColumnsRenamed({"label": "_label", "vec": "_vec"})
    key = (F.when(F.col("ok"), F.col("label")) == F.col("_label")) & (F.when(F.col("ok"), F.col("vec")) == F.col("_vec"))
    out = sound.join(known, key, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
