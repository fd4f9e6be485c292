"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine >= t are at most eps = sqrt(2 (1 - t)) apart. Vectors are projected on
their leading principal dimensions and sorted by the grid cells (side eps) of these, which makes
a sequence in which near vectors lie in few intervals. The join of the sequence with itself is
recursive: two intervals whose bounding boxes are further apart than eps are skipped, others
are split. The upper levels of the recursion are joins over interval boxes, down to tiles of a
bounded number of bytes; below, each pair of tiles is one task's work, down to blocks that are
compared by a matrix product in double precision.

Equal vectors are one node with a number of copies. A pair of tiles reports sums of links and a
spanning forest of what it linked, never the pairs, so a dense group of any size costs rows in
proportion to its members. The principal dimensions are fitted on a bounded sample; they decide
only the order, not the result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postkit.llm.common import arrow_batches, broadcast_bytes, field
from postkit.llm.components import components
from postkit.session import materialize

#: Vectors of the sample that the principal dimensions are fitted on.
SAMPLE = 2048
#: Leading principal dimensions of the grid.
GRID_DIMS = 8
#: Bytes of vectors in one tile, and rows of the blocks that are compared at once.
TILE_BYTES = 4 << 20
LEAF_ROWS = 512
FANOUT = 8


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Id, key (digest of the vector), dim and unit vector (as doubles) of every usable row."""
    import pyspark.sql.types as T

    def run(batches):
        for b in batches:
            keep, key, dim, unit = [], [], [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                if not x or None in x:
                    continue
                v = np.asarray(x, np.float64)
                if not np.isfinite(v).all():
                    continue
                top = np.abs(v).max()
                if top == 0:
                    continue
                scaled = v / top                            # the length of very small or large values stays exact
                keep.append(i)
                key.append(hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest())
                dim.append(len(v))
                unit.append((scaled / np.sqrt(scaled @ scaled)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int32())), pa.array(key, pa.binary()), pa.array(dim, pa.int32()), pa.array(unit, pa.binary())],
                names=["id", "key", "dim", "unit"])

    schema = T.StructType([field(vectors, id_col, "id"), T.StructField("key", T.BinaryType()), T.StructField("dim", T.IntegerType()), T.StructField("unit", T.BinaryType())])
    return arrow_batches(vectors.select(F.col(id_col).alias("id"), F.col(vec_col)), run, schema)


def _principal(nodes: DataFrame, dim: int) -> np.ndarray:
    """Leading principal dimensions of a sample by smallest key: dim x GRID_DIMS, fewer columns where
    the length or the number of vectors is less."""
    rows = nodes.select("key", "unit").orderBy("key").limit(SAMPLE).collect()
    x = np.array([np.frombuffer(r["unit"]) for r in rows])
    return np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:min(GRID_DIMS, dim)].T


def _tiles(nodes: DataFrame, dim: int, eps: float) -> DataFrame:
    """The grid-ordered sequence cut into tiles: ``tile`` (from 0), ``lo``, ``hi`` (bounding box),
    ``keys``, ``copies``, ``units``, ``places`` (as blobs, in order)."""
    principal = _principal(nodes, dim)
    axes, width = broadcast_bytes(nodes, principal), principal.shape[1]

    def project(batches):
        for b in batches:
            p = np.frombuffer(b"".join(b.column(2).to_pylist())).reshape(b.num_rows, dim) @ axes.value
            cells = np.floor(p / eps).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                b.columns + [pa.array(list(p), pa.list_(pa.float64())), pa.array(list(cells), pa.list_(pa.int64()))],
                names=["key", "copies", "unit", "place", "cell"])

    placed = arrow_batches(nodes.select("key", "copies", "unit"), project, "key binary, copies long, unit binary, place array<double>, cell array<long>")
    ordered = materialize(placed.orderBy("cell", "place", "key").withColumn("at", F.monotonically_increasing_id()), "grid-order")
    part = F.shiftright("at", 33)
    starts = (ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
              .select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start")))
    rows = max(LEAF_ROWS, TILE_BYTES // (8 * dim))
    rank = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)
    ranked = ordered.join(starts, part == F.col("part")).select(F.floor(rank / rows).cast("int").alias("tile"), F.struct(rank.alias("rank"), "key", "copies", "unit", "place").alias("row"))
    return ranked.groupBy("tile").agg(F.sort_array(F.collect_list("row")).alias("rows")).select(
        "tile", F.transform("rows", lambda x: x["key"]).alias("keys"), F.transform("rows", lambda x: x["copies"]).alias("copies"),
        F.transform("rows", lambda x: x["unit"]).alias("units"), F.transform("rows", lambda x: x["place"]).alias("places"),
        *[F.array(*[f(_axis(k)) for k in range(width)]).alias(name) for f, name in ((F.array_min, "lo"), (F.array_max, "hi"))])


def _axis(k: int):
    """The k-th coordinates of all rows of a tile."""
    return F.transform("rows", lambda x: x["place"][k])


def _near_tiles(tiles: DataFrame, eps: float) -> DataFrame:
    """Pairs (a <= b) of tiles that may hold near vectors: the recursion over intervals of
    FANOUT**level tiles, from the whole sequence down, as joins over their boxes."""
    boxes = tiles.select("tile", "lo", "hi")
    m = boxes.count()
    if m == 0:
        return boxes.select(F.col("tile").alias("a"), F.col("tile").alias("b"))
    width = len(boxes.select("lo").first()[0])
    pairs = tiles.sparkSession.range(1).select(F.lit(0).alias("a"), F.lit(0).alias("b"))
    for level in range(max(0, math.ceil(math.log(m, FANOUT) - 1e-9)) - 1, -1, -1):
        at = boxes.groupBy(F.floor(F.col("tile") / FANOUT ** level).cast("int").alias("i")).agg(
            F.array(*[F.min(F.col("lo")[k]) for k in range(width)]).alias("lo"), F.array(*[F.max(F.col("hi")[k]) for k in range(width)]).alias("hi"))
        child = lambda c: F.explode(F.transform(F.array(*[F.lit(k) for k in range(FANOUT)]), lambda k: F.col(c) * FANOUT + k))
        pairs = pairs.select(child("a").alias("a"), "b").select("a", child("b").alias("b")).where("a <= b")
        x, y = at.select(F.col("i").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi")), at.select(F.col("i").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
        gap = [F.greatest(F.lit(0.0), F.col("alo")[k] - F.col("bhi")[k], F.col("blo")[k] - F.col("ahi")[k]) for k in range(width)]
        pairs = pairs.join(x, "a").join(y, "b").where(sum(g * g for g in gap) <= eps * eps * (1 + 1e-9)).select("a", "b")
    return pairs


class Forest:
    """Union-find over local indices, joined many pairs at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            np.minimum.at(self.root, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def join_tiles(a: dict, b: dict | None, eps: float, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of every vector of two tiles (or of one with itself, ``b`` None), weighted with
    copies, and the local root of every vector in the forest of links."""
    same = b is None
    b = a if same else b
    na, nb = len(a["copies"]), len(b["copies"])
    shift = 0 if same else na
    links, forest = np.zeros(na if same else na + nb, np.int64), Forest(na if same else na + nb)
    stack = [(0, na, 0, nb)]
    while stack:
        s, e, u, v = stack.pop()
        if same and s > u:
            continue
        gap = np.maximum(0, np.maximum(a["places"][s:e].min(0) - b["places"][u:v].max(0), b["places"][u:v].min(0) - a["places"][s:e].max(0)))
        if gap @ gap > eps * eps * (1 + 1e-9):
            continue
        if e - s > LEAF_ROWS or v - u > LEAF_ROWS:
            mid, cut = LEAF_ROWS * ((e - s) // LEAF_ROWS // 2 or 1) + s, LEAF_ROWS * ((v - u) // LEAF_ROWS // 2 or 1) + u
            for x in ((s, mid), (mid, e)) if e - s > LEAF_ROWS else ((s, e),):
                for y in ((u, cut), (cut, v)) if v - u > LEAF_ROWS else ((u, v),):
                    stack.append((*x, *y))
            continue
        near = a["units"][s:e] @ b["units"][u:v].T >= threshold
        if same and s == u:
            np.fill_diagonal(near, False)
        if not near.any():
            continue
        links[s:e] += near @ b["copies"][u:v]
        if not (same and s == u):
            links[shift + u:shift + v] += a["copies"][s:e] @ near
        i, j = np.nonzero(near)
        forest.join(i + s, j + u + shift)
    return links, forest.root


def _linked(tiles: DataFrame, dim: int, eps: float, threshold: float) -> DataFrame:
    """``key``, ``links``, ``root``: for each pair of near tiles, what it found of each vector."""
    pairs = _near_tiles(tiles, eps)
    blob = ["keys", "copies", "units", "places"]
    side = lambda s: tiles.select(F.col("tile").alias(s), F.struct(*blob).alias(f"{s}_tile"))
    # a tile with itself carries one blob, other pairs two
    other = side("b").withColumnRenamed("b_tile", "other")
    both = pairs.join(side("a"), "a").join(other, (pairs["b"] == other["b"]) & (pairs["a"] != pairs["b"]), "left").select("a_tile", "other")

    def read(x) -> dict:
        return {"keys": x["keys"].values.to_pylist(), "copies": x["copies"].values.to_numpy(zero_copy_only=False),
                "units": np.frombuffer(b"".join(x["units"].values.to_pylist())).reshape(-1, dim),
                "places": x["places"].values.flatten().to_numpy().reshape(len(x["copies"].values), -1)}

    def run(batches):
        for batch in batches:
            for one in range(batch.num_rows):
                a, other = batch.column(0)[one], batch.column(1)[one]
                a, b = read(a), read(other) if other.is_valid else None
                links, root = join_tiles(a, b, eps, threshold)
                keys = a["keys"] + (b["keys"] if b else [])
                hit = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[i] for i in hit], pa.binary()), pa.array(links[hit], pa.int64()), pa.array([keys[root[i]] for i in hit], pa.binary())],
                    names=["key", "links", "root"])

    slots = tiles.sparkSession.sparkContext.defaultParallelism
    return both.repartition(4 * slots).mapInArrow(run, "key binary, links long, root binary")


def link_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links`` (other rows with cosine >= ``threshold``),
    ``component_id`` (smallest id reachable by links) and ``kept`` (the id is that id).

    Null, empty, zero vectors and vectors with null or non-finite components link with nothing;
    nor do vectors of different lengths. Rows with equal vectors link with each other, whatever
    their ids; null ids are never the smallest unless a component has no other. Other columns
    are ignored; an empty table gives no rows.
    """
    eps = math.sqrt(2 * (1 - threshold))
    members = materialize(_valid(vectors, id_col, vec_col), "vectors")
    nodes = materialize(members.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("unit").alias("unit")), "nodes")
    found = None
    for r in nodes.select("dim").distinct().orderBy("dim").collect():       # one per length of vectors
        tiles = materialize(_tiles(nodes.where(F.col("dim") == r["dim"]), r["dim"], eps), "tiles")
        part = _linked(tiles, r["dim"], eps, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = nodes.select("key", F.lit(0).cast("long").alias("links"), F.col("key").alias("root"))
    found = materialize(found, "links")
    labels = components(found.select(F.col("key").alias("u"), F.col("root").alias("v")))
    known = (nodes.join(labels, nodes["key"] == labels["node"], "left").withColumn("component", F.coalesce("component", "key"))
             .join(found.groupBy("key").agg(F.sum("links").alias("links")), "key", "left"))
    known = materialize(known.select("key", "least", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    by_key = known.join(least, "component").select("key", "n_links", "component_id")
    linked = members.select("id", "key").join(by_key, "key").select("id", "n_links", "component_id")
    return _with_rest(vectors.select(F.col(id_col).alias("id")), linked, id_col)


def _with_rest(ids: DataFrame, linked: DataFrame, id_col: str) -> DataFrame:
    """Adds the rows without a usable vector: as many of each id as are missing."""
    rest = (ids.withColumn("n", F.lit(1)).unionByName(linked.select("id", F.lit(-1).alias("n"))).groupBy("id").agg(F.sum("n").alias("n"))
            .where("n > 0").select(F.explode(F.array_repeat("id", F.col("n").cast("int"))).alias("id")))
    rows = linked.unionByName(rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return rows.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
