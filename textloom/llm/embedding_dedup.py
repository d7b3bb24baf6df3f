"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine >= t lie within squared distance 2 - 2t. After a rotation the space is cut into BLOCKS
blocks of equal width; of two such vectors at least one block holds no more than its proportional part of that
squared distance. Each block is range-joined on a grid over its first coordinates (two, and one more whenever the
vectors triple beyond FEW): a vector lives in one cell and probes every cell that its range touches. What is shuffled
for that is the block's coordinates alone, rounded to a byte each. Members of a cell with no other one within the
block's budget, and the rounding, go; whole vectors join the rest. A pair within the block's budget is a candidate; the
first block that finds it verifies it, by cosine in double precision on the vectors as given. No pair leaves its task:
a task returns links per vector and a spanning forest of the links it found.

Equal vectors of a label are one class with a multiplicity, so copies never meet each other. Cells larger than
MAX_CELL are cut on both sides and every part of the one meets every part of the other, so no task holds a cell
whole and none is dropped.

Defined results: a null or zero vector, one with a null or non-finite component, and a vector whose label or id is null
link with nothing (n_links 0, its own component, kept); labels of any type are compared as they are, by their text;
vectors of different length never link; rows that share an id count as one vector, that with the smallest hash; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .components import components
from .hashing import mixed

BLOCKS = 8
MAX_CELL = 1500
SLACK = 1e-9
SEED = 11
#: Candidate pairs that are verified at once.
AT_ONCE = 50_000
#: Step of a rounded coordinate, and vectors for which two axes of the grid do.
STEP = 1 / 127
FEW = 200_000


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int) -> np.ndarray:
    return np.linspace(0, dim, min(BLOCKS, dim) + 1).round().astype(int)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by the largest component first, so that squares neither vanish nor overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def radius_of(block: int, edges: np.ndarray, threshold: float) -> float:
    return float(np.sqrt((2 - 2 * threshold + SLACK) * (edges[block + 1] - edges[block]) / edges[-1]) + SLACK)


def _packed(block: np.ndarray) -> np.ndarray:
    """Up to eight coordinates of a block, in steps of STEP, in one number."""
    steps = np.rint(block[:, :8] / STEP).astype(np.int8)
    return np.pad(steps, ((0, 0), (0, 8 - steps.shape[1]))).copy().view(np.int64)[:, 0]


def _unpacked(numbers: np.ndarray) -> np.ndarray:
    return numbers.astype(np.int64).reshape(-1, 1).view(np.int8).astype(np.float32) * np.float32(STEP)


def _cells(threshold: float, axes: int):
    """For each vector a row per block: its home cell (probe false) and each cell it probes, with the block's own
    coordinates alone. `block` also tells the vector's length."""

    def rows(batches):
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["embedding"].map(len), sort=False):
                u = unit(np.stack(part["embedding"].to_list()).astype(float)) @ rotation(dim)
                edges = block_edges(dim)
                start = mixed(part["label_key"].to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(dim))
                for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                    radius, coordinates = radius_of(b, edges, threshold), _packed(u[:, lo:hi])
                    at = u[:, lo : min(hi, lo + axes)]
                    home = np.floor(at / (4 * radius)).astype(np.int64)
                    low, high = (np.floor((at + x) / (4 * radius)).astype(np.int64) for x in (-radius, radius))
                    every = np.arange(len(part))
                    found = [(every, home, False)]
                    for step in itertools.product((0, 1), repeat=at.shape[1]):
                        inside = (low + step <= high).all(axis=1)
                        found.append((every[inside], (low + step)[inside], True))
                    for k, cell, probe in found:
                        key = mixed(start[k] + np.uint64(b))
                        for axis in cell.T:
                            key = mixed(key ^ axis.view(np.uint64), 1)
                        yield pd.DataFrame({"cell": key.view(np.int64), "block": np.int32(dim * BLOCKS + b), "probe": probe, "id": part["id"].to_numpy()[k], "q": coordinates[k]})

    return rows


def _survivors(threshold: float):
    """The members of a cell that have another one within the block's budget, as far as the coordinates tell."""

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        homes, probes = pdf[~pdf["probe"]], pdf[pdf["probe"]]
        h, p = _unpacked(homes["q"].to_numpy()), _unpacked(probes["q"].to_numpy())
        dim, block = divmod(int(pdf["block"].iloc[0]), BLOCKS)
        # Two coordinates, each off by half a step at most.
        reach = np.float32((radius_of(block, block_edges(dim), threshold) + 8**0.5 * STEP) ** 2 + 1e-5)
        near = (h**2).sum(1)[:, None] + (p**2).sum(1)[None, :] - 2 * h @ p.T <= reach
        near &= homes["id"].to_numpy()[:, None] != probes["id"].to_numpy()[None, :]
        return pd.concat([homes[near.any(1)], probes[near.any(0)]])[["cell", "block", "probe", "id"]]

    return group


def _smallest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one it reaches over the pairs (a, b)."""
    low = np.arange(n)
    while True:
        before = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        if (low == before).all():
            return low


def _linked_pairs(homes: np.ndarray, probes: np.ndarray, home_ids: np.ndarray, probe_ids: np.ndarray, block: int, threshold: float):
    """Index pairs (home, probe) that this block is the first to find and whose cosine is high enough."""
    dim = homes.shape[1]
    uh, up = unit(homes), unit(probes)
    rh, rp = uh @ rotation(dim), up @ rotation(dim)
    edges = block_edges(dim)
    budget = lambda k: (2 - 2 * threshold + SLACK) * (edges[k + 1] - edges[k]) / dim
    lo, hi = edges[block], edges[block + 1]
    bh, bp = rh[:, lo:hi], rp[:, lo:hi]
    near = (bh**2).sum(1)[:, None] + (bp**2).sum(1)[None, :] - 2 * bh @ bp.T <= budget(block) + 1e-6
    near &= home_ids[:, None] > probe_ids[None, :]
    h, p = np.nonzero(near)
    keep_h, keep_p = [], []
    for at in range(0, len(h), AT_ONCE):
        i, j = h[at : at + AT_ONCE], p[at : at + AT_ONCE]
        squares = (rh[i] - rp[j]) ** 2
        ok = squares[:, lo:hi].sum(1) <= budget(block)
        for k in range(block):
            ok &= squares[:, edges[k] : edges[k + 1]].sum(1) > budget(k)
        i, j = i[ok], j[ok]
        ok = (uh[i] * up[j]).sum(1) >= threshold
        keep_h.append(i[ok])
        keep_p.append(j[ok])
    return (np.concatenate(keep_h), np.concatenate(keep_p)) if keep_h else (h, p)


def _verify(threshold: float):
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        homes, probes = pdf[~pdf["probe"]], pdf[pdf["probe"]]
        empty = pd.DataFrame({"id": [], "links": [], "low": []}).astype("int64")
        if homes.empty or probes.empty:
            return empty
        vectors = lambda x: np.stack(x["embedding"].to_list()).astype(float)
        hid, pid = homes["id"].to_numpy(), probes["id"].to_numpy()
        h, p = _linked_pairs(vectors(homes), vectors(probes), hid, pid, int(pdf["block"].iloc[0]) % BLOCKS, threshold)
        if not len(h):
            return empty
        ids, code = np.unique(np.concatenate((hid[h], pid[p])), return_inverse=True)
        a, b = code[: len(h)], code[len(h) :]
        links = np.bincount(a, probes["copies"].to_numpy()[p], len(ids)) + np.bincount(b, homes["copies"].to_numpy()[h], len(ids))
        return pd.DataFrame({"id": ids, "links": links.astype("int64"), "low": ids[_smallest_linked(len(ids), a, b)]})

    return group


def _in_parts(rows: DataFrame, cell: list[str]) -> DataFrame:
    """Cells with both homes and probes, of two vectors at least, cut into parts of at most about MAX_CELL on either side. A
    home need not be among the probes: of a home that only another cell's vector is near to, its own probe is gone."""
    sizes = rows.groupBy(*cell).agg(
        F.sum((~F.col("probe")).cast("int")).alias("n_home"), F.sum(F.col("probe").cast("int")).alias("n_probe"),
        F.min("id").alias("first"), F.max("id").alias("last"),
    ).filter("n_home > 0 and n_probe > 0 and first < last")
    parts = lambda n: F.ceil(F.col(n) / MAX_CELL).cast("int")
    sizes = sizes.select(*cell, parts("n_home").alias("k_home"), parts("n_probe").alias("k_probe"))
    own = lambda k: F.array(F.pmod(F.hash("id", F.lit(SEED)), F.col(k)))
    every = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    placed = rows.join(sizes, cell)
    placed = placed.withColumn("home_part", F.explode(F.when(F.col("probe"), every("k_home")).otherwise(own("k_home"))))
    placed = placed.withColumn("probe_part", F.explode(F.when(F.col("probe"), own("k_probe")).otherwise(every("k_probe"))))
    return placed.drop("k_home", "k_probe")


def _axes(n: int) -> int:
    """Coordinates of a block that make the grid: one more whenever the vectors triple, so that cells don't fill up."""
    return 2 + max(0, math.ceil(math.log(max(n, 1) / FEW, 3)))


def embedding_dedup(
    vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per vector."""
    number = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    v = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].cast(f"array<{number}>").alias("embedding"), vectors[label_col].alias("label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False)
    )
    key = F.struct(F.xxhash64("label", "embedding").alias("k1"), F.xxhash64("embedding", F.lit(SEED), "label").alias("k2"))
    keyed = v.filter(sound).withColumn("key", key)
    keys = keep(keyed.groupBy("vec_id").agg(F.min("key").alias("key")))
    classes = keys.groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    of = keep(keys.join(classes, "key").select("vec_id", "key", "id", "copies"))
    firsts = of.filter("vec_id = id")
    reps = keyed.join(firsts, ["vec_id", "key"]).select("id", "copies", F.col("label").cast("string").alias("label"), "embedding").dropDuplicates(["id"])
    reps = keep(reps.withColumn("label_key", F.xxhash64("label")))
    cells = keep(reps.select("id", "label_key", "embedding").mapInPandas(_cells(threshold, _axes(reps.count())), "cell bigint, block int, probe boolean, id bigint, q bigint"))
    cell = ["cell", "block"]
    near = _in_parts(cells, cell).groupBy(*cell, "home_part", "probe_part").applyInPandas(_survivors(threshold), "cell bigint, block int, probe boolean, id bigint")
    near = keep(near.distinct())
    parts = _in_parts(near, cell).join(reps, "id")
    found = keep(
        parts.groupBy(*cell, "label", "home_part", "probe_part").applyInPandas(
            _verify(threshold), "id bigint, links bigint, low bigint"
        )
    )
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    by_class = links.join(roots, "id", "left").select(F.col("id").alias("_id"), "links", "component_id")
    joined = of.join(by_class, of["id"] == by_class["_id"], "left").select(
        F.col("vec_id").alias("_vec"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
    )
    out = v.select("vec_id").join(joined, F.col("vec_id") == F.col("_vec"), "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
