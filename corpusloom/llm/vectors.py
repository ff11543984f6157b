"""Embedding near-duplicates: collision counts of sorted one-dimensional projections, then exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.session import pick, stored, table

LEAST_COSINE = 0.98
PROJECTIONS = 24
REACH = 3.0  # half a window, in deviations of a projection of two vectors that just link
GRID_CELLS = 4.0  # a cell of the grid is so many half windows wide
MOST_GRID = 6  # projections that make up the grid at most
ROWS_PER_CELL = 400
BROADCAST_CELLS = 100_000  # sizes of up to so many cells are broadcast, so that a large cell's rows meet in its blocks only
BLOCK = 1500  # rows of a cell that are compared with another block's at a time
RECALL = 0.999  # of linked pairs that reach the least count of collisions, from the projections' normal law
SEED = 17


def _normal(z: float) -> float:
    return math.erf(z / math.sqrt(2))


def least_collisions(n: int = PROJECTIONS, reach: float = REACH, recall: float = RECALL) -> int:
    """Collisions that a pair at the threshold reaches with probability recall or more."""
    p, tail = _normal(reach), 0.0
    for k in range(n, -1, -1):
        tail += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if tail >= recall:
            return k
    return 0


def half_window(least_cosine: float = LEAST_COSINE, reach: float = REACH) -> float:
    """Two unit vectors at distance r have normal projections that differ with deviation r."""
    return reach * math.sqrt(max(0.0, 2 - 2 * least_cosine))


def projections(dim: int, n: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, n))


def collision_counts(own: np.ndarray, others: np.ndarray, half: float) -> np.ndarray:
    """How many projections of others lie in the windows around each of own's: one sort per projection."""
    counts = np.zeros((len(own), len(others)), np.uint8)
    for k in range(own.shape[1]):
        order = np.argsort(others[:, k], kind="stable")
        line = others[order, k]
        low = np.searchsorted(line, own[:, k] - half, "left")
        high = np.searchsorted(line, own[:, k] + half, "right")
        for i in range(len(own)):
            counts[i, order[low[i] : high[i]]] += 1
    return counts


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that can link: a label, and a vector without null or non-finite parts and not zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def near_duplicates(vectors: DataFrame, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Equal vectors of a label are one class, which links its rows with each other (cosine 1);
    classes are compared by their least vec_id, and n_links counts the classes' rows. Vectors
    that cannot link (see usable()), or whose length differs from all others', have no links
    and a component of their own; without vec_id a row has neither links nor a component, and is
    kept. Rows of one vec_id that are there more than once link as different rows do, and share
    a component. Columns other than vec_id, embedding and label are not read. An empty table
    gives an empty table. The first projections form a grid of cells in
    which the windows' rows meet; all projections' collisions are then counted, and pairs with
    enough are checked in double precision. Rows of a cell beyond BLOCK are compared block by block.
    """
    rows = pick(vectors, "vec_id", "embedding", "label")
    good = usable(rows).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    # -0.0 and 0.0 are the same part of a vector.
    good = good.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    ids = stored(good.select("vec_id", "label", F.size("embedding").alias("dim"), F.sha2(F.array_join(F.transform("embedding", lambda x: F.hex(x.cast("string"))), ","), 256).alias("same"), "embedding"))
    classes = stored(ids.groupBy("label", "same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("dim").alias("dim")))
    members = ids.select("label", "same", "vec_id")
    # One row per class with its vector: the rows of the class have the same, so any does.
    reps = ids.join(classes.select("label", "same", F.col("rep").alias("vec_id"), "n"), ["label", "same", "vec_id"], "left_semi").groupBy("label", "same", "vec_id").agg(F.first("embedding").alias("embedding"), F.first("dim").alias("dim"))
    reps = stored(reps.join(classes.select("label", "same", "n"), ["label", "same"]).select(F.col("vec_id").alias("rep"), "label", "dim", "n", "embedding", "same"))

    largest = reps.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    half = half_window(least_cosine)
    width = GRID_CELLS * half
    cells_a_line = max(1.5, 2.5 / width)  # a line's values spread as a normal of deviation 1
    grid = 0 if largest <= ROWS_PER_CELL else min(MOST_GRID, math.ceil(math.log(largest / ROWS_PER_CELL) / math.log(cells_a_line)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                x = np.array(part["embedding"].tolist(), np.float64).reshape(len(part), int(dim))
                x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                line = x @ projections(int(dim), max(1, grid))[:, :grid] if grid else np.zeros((len(x), 0))
                home, low, high = (np.floor((line + o) / width).astype(np.int64) for o in (0.0, -half, half))
                out: list[tuple] = []
                for i, (rep, label, n) in enumerate(zip(part["rep"], part["label"], part["n"], strict=True)):
                    cells = [()]
                    for g in range(grid):
                        cells = [(*c, v) for c in cells for v in range(low[i, g], high[i, g] + 1)]
                    raw, own = x[i].tobytes(), tuple(home[i])
                    out += [(rep, label, int(dim), n, raw, ",".join(map(str, c)), c == own) for c in cells]
                yield pd.DataFrame(out, columns=["rep", "label", "dim", "n", "x", "cell", "home"])

    placed = stored(reps.select("rep", "label", "dim", "n", "embedding").mapInPandas(
        place, f"rep long, label {rows.schema['label'].dataType.simpleString()}, dim int, n long, x binary, cell string, home boolean"))
    key = ["label", "dim", "cell"]
    full = stored(placed.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.count_if("home").alias("homes")).filter("rows > 1 AND homes > 0"))
    hint = F.broadcast if full.count() <= BROADCAST_CELLS else (lambda df: df)
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    dealt = (
        placed.join(hint(full), key).withColumn("b", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("b")).cast("int"))
        # A home row asks in each block of others; every row answers in its block to each block of homes.
        .withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda o: F.struct(o.alias("o")))))
    )
    asks = dealt.filter("home").select(*key, F.col("own").alias("qa"), F.col("pair.o").alias("qb"), F.lit(True).alias("ask"), "rep", "n", "x")
    answers = dealt.select(*key, F.col("pair.o").alias("qa"), F.col("own").alias("qb"), F.lit(False).alias("ask"), "rep", "n", "x")
    least = least_collisions()

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        dim = int(group["dim"].iloc[0])
        ask, answer = group[group["ask"]], group[~group["ask"]]
        empty = pd.DataFrame({"rep": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "n_links": pd.Series(dtype="int64")})
        if not len(ask) or not len(answer):
            return empty
        q, a = (np.frombuffer(b"".join(g["x"]), np.float64).reshape(-1, dim) for g in (ask, answer))
        lines = projections(dim)
        found = collision_counts(q @ lines, a @ lines, half) >= least
        q_ids, a_ids, weight = ask["rep"].to_numpy(), answer["rep"].to_numpy(), answer["n"].to_numpy()
        found &= q_ids[:, None] != a_ids[None, :]
        i, j = np.nonzero(found)
        near = np.zeros(len(i), bool)
        for at in range(0, len(i), 200_000):
            s = slice(at, at + 200_000)
            near[s] = np.einsum("ij,ij->i", q[i[s]], a[j[s]]) >= least_cosine
        i, j = i[near], j[near]
        # Links by row, and of the pairs a forest that joins the same rows.
        links = np.bincount(i, weights=weight[j], minlength=len(q)).astype(np.int64)
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while root.setdefault(v, v) != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        forest = []
        for u, v in zip(q_ids[i].tolist(), a_ids[j].tolist(), strict=True):
            ru, rv = find(u), find(v)
            if ru != rv:
                root[max(ru, rv)] = min(ru, rv)
                forest.append((u, v, 0))
        rows_ = forest + [(int(r), int(r), int(k)) for r, k in zip(q_ids, links, strict=True) if k]
        return pd.DataFrame(rows_, columns=["rep", "other", "n_links"]) if rows_ else empty

    found = stored(asks.unionByName(answers).groupBy(*key, "qa", "qb").applyInPandas(compare, "rep long, other long, n_links long"))
    labels = components(found.filter("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("n_links").alias("links"))
    per_class = (
        classes.select("label", "same", "rep", "n").join(counts, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "same", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = members.join(per_class, ["label", "same"]).select("vec_id", "n_links", "component_id")
    # A vec_id is in several classes only if its rows differ: they then share the least component.
    alone = rows.select("vec_id").exceptAll(linked.select("vec_id")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


# Cosines are exact sums of double products; the reachable rows come from a recursive walk along links.
SQL = {
    "op10_embedding_near_duplicates": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counted AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id) LEFT JOIN counted USING (vec_id)"""
}
