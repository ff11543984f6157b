"""Approximate nearest neighbours: inverted lists of rotated vectors in column blocks, whose candidates are abandoned early."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.session import pick, stored, table

NEAREST = 20
EACH = 20  # rows whose vec_id is divisible by this are queries
LEAST_FITTED = 512  # vectors of one length, from which lists are fitted; fewer are one list
MOST_LISTS = 1024
ROWS_PER_LIST = 16  # of the sample that the lists' centres are fitted on: MOST_LISTS times as many at most
FIT_ROUNDS = 6
CALIBRATING = 128  # queries of the least hashes, compared with all rows, that say how many lists must be probed
WANTED_RECALL = 0.965  # of those queries' neighbours that lie in the probed lists; the contract asks for 0.9
ERROR = 1e-3  # chance that a test abandons a candidate that is near enough
COLUMN_BLOCKS = 4
BLOCK = 4096  # rows, and queries, that a task compares at once
PAIRS_AT_ONCE = 2_000_000
SLACK = 1e-5  # for float32 sums of unit vectors
SEED = 29

INDEX = "rid long, vec_id long, dim int, list int, norm double, x binary, turned array<binary>"


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def column_blocks(dim: int) -> list[slice]:
    """Column blocks of a rotated vector, of eight columns or more but for the last."""
    width = max(8, -(-dim // COLUMN_BLOCKS))
    return [slice(a, min(dim, a + width)) for a in range(0, dim, width)]


@lru_cache(maxsize=8)
def test_bounds(dim: int) -> tuple[float, ...]:
    """For each column block but the last: the share of a squared distance that its columns so far exceed with a chance of ERROR.

    After a random rotation the share that d of dim columns hold follows a Beta(d/2, (dim-d)/2) law.
    """
    out = []
    for block in column_blocks(dim)[:-1]:
        a, b = block.stop / 2, (dim - block.stop) / 2
        at = (np.arange(20_000) + 0.5) / 20_000
        logs = (a - 1) * np.log(at) + (b - 1) * np.log1p(-at)
        law = np.cumsum(np.exp(logs - logs.max()))
        out.append(float(at[min(len(at) - 1, np.searchsorted(law, (1 - ERROR) * law[-1]))]))
    return tuple(out)


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths whose squares neither overflow nor vanish on the way."""
    most = np.abs(x).max(axis=1, keepdims=True)
    return most[:, 0] * np.sqrt(((x / most) ** 2).sum(axis=1))


def fit_centres(sample: np.ndarray, k: int) -> np.ndarray:
    """Centres of k lists by rounds of nearest centre and mean, from a bounded sample; an empty list takes a row of the sample."""
    random = np.random.default_rng(SEED)
    sample = sample.astype(np.float32)
    centres = sample[random.choice(len(sample), min(k, len(sample)), replace=False)].copy()
    for _ in range(FIT_ROUNDS):
        own = nearest_centre(sample, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], sample[random.integers(len(sample), size=len(centres))])
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[a : a + 4096] @ centres.T - half, axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def best_first(n: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each n's k best: highest score first, then smallest id."""
    order = np.lexsort((ids, -scores, n))
    group = n[order]
    start = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1]
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)])) if len(order) else order
    return order[place < k]


def surviving(q: np.ndarray, q_norm: np.ndarray, x: np.ndarray, x_norm: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of q and x whose inner product may reach q's least: adaptive scan of column blocks.

    q and x are rotated unit vectors. A pair's inner product reaches `least` if and only if its
    squared distance is at most a limit; it is abandoned as soon as what its columns so far hold
    would exceed their share of that limit in all but ERROR of the rotations.
    """
    dim = q.shape[1]
    blocks, bounds = column_blocks(dim), (*test_bounds(dim), 1.0)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        limit = np.nan_to_num(2 - 2 * (least[:, None] / (q_norm[:, None] * x_norm[None, :])), nan=4.0, posinf=4.0, neginf=-1.0)
    limit = (limit + SLACK).astype(np.float32)
    a, b = q[:, blocks[0]], x[:, blocks[0]]
    held = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    i, j = np.nonzero(held <= limit * np.float32(bounds[0]) + np.float32(SLACK))
    held, limit = held[i, j], limit[i, j]
    for block, bound in zip(blocks[1:], bounds[1:], strict=True):
        gap = q[i, block] - x[j, block]
        held = held + np.einsum("ij,ij->i", gap, gap)
        on = held <= limit * np.float32(bound) + np.float32(SLACK)
        i, j, held, limit = i[on], j[on], held[on], limit[on]
    return i, j


def _matrix(blobs: pd.Series, dtype: type, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype).reshape(-1, dim)


def _turned(blocks: pd.Series, dim: int) -> np.ndarray:
    """Rotated vectors from the column blocks of the index."""
    return np.concatenate([_matrix(pd.Series([r[b] for r in blocks]), np.float32, s.stop - s.start) for b, s in enumerate(column_blocks(dim))], axis=1)


def scan(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
    """The nearest rows of one block for the queries that probe lists in it: qrid, query_id, rid, vec_id, score."""
    empty = pd.DataFrame({"qrid": [], "query_id": [], "rid": [], "vec_id": [], "score": []})
    if not len(rows) or not len(asks):
        return empty
    dim = int(rows["dim"].iloc[0])
    x, q = _matrix(rows["x"], np.float64, dim), _matrix(asks["x"], np.float64, dim)
    x_turned, q_turned = _turned(rows["turned"], dim), _turned(asks["turned"], dim)
    x_norm, q_norm = rows["norm"].to_numpy(), asks["norm"].to_numpy()
    rid, vec_id, qrid = rows["rid"].to_numpy(), rows["vec_id"].to_numpy(), asks["qrid"].to_numpy()
    seed = asks["least"].to_numpy(np.float64, na_value=-np.inf)
    least = seed.copy()
    lists = rows["list"].to_numpy()
    wanted = asks["lists"].tolist()
    n_top, at_top, s_top = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for one in np.unique(lists):
        members = np.flatnonzero(lists == one)
        askers = np.array([i for i, w in enumerate(wanted) if one in w], np.int64)
        step = max(1, PAIRS_AT_ONCE // len(members))
        for a in range(0, len(askers), step):
            who = askers[a : a + step]
            i, j = surviving(q_turned[who], q_norm[who], x_turned[members], x_norm[members], least[who])
            i, j = who[i], members[j]
            other = qrid[i] != rid[j]
            i, j = i[other], j[other]
            score = np.concatenate([np.einsum("ij,ij->i", q[i[s : s + 200_000]], x[j[s : s + 200_000]]) for s in range(0, len(i), 200_000)]) if len(i) else np.zeros(0)
            near = score >= least[i]
            n_top, at_top, s_top = np.r_[n_top, i[near]], np.r_[at_top, j[near]], np.r_[s_top, score[near]]
            best = best_first(n_top, s_top, vec_id[at_top], NEAREST)
            n_top, at_top, s_top = n_top[best], at_top[best], s_top[best]
            full = np.bincount(n_top, minlength=len(q)) == NEAREST
            worst = np.full(len(q), np.inf)
            np.minimum.at(worst, n_top, s_top)
            least = np.where(full, np.maximum(seed, worst), seed)
    return pd.DataFrame({"qrid": qrid[n_top], "query_id": asks["vec_id"].to_numpy()[n_top], "rid": rid[at_top], "vec_id": vec_id[at_top], "score": s_top})


FOUND = "qrid long, query_id long, rid long, vec_id long, score double"


class Index:
    """Every usable row of a table in inverted lists, written; see search()."""

    def __init__(self, vectors: DataFrame):
        spark = vectors.sparkSession
        finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rows = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
        rows = rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.size("embedding").alias("dim"))
        counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.centres = {dim: self._fit(rows.filter(F.col("dim") == dim), n) for dim, n in counts.items() if n >= LEAST_FITTED}
        shared = spark.sparkContext.broadcast(self.centres)

        def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for dim, part in batch.groupby("dim"):
                    dim = int(dim)
                    x = np.array(part["embedding"].tolist(), np.float64).reshape(len(part), dim)
                    size = norms(x)
                    turned = ((x / np.abs(x).max(axis=1, keepdims=True) / norms(x / np.abs(x).max(axis=1, keepdims=True))[:, None]) @ rotation(dim)).astype(np.float32)
                    own = nearest_centre(x.astype(np.float32), shared.value[dim]) if dim in shared.value else np.zeros(len(x), np.int64)
                    yield pd.DataFrame({
                        "rid": part["rid"].to_numpy(), "vec_id": part["vec_id"].to_numpy(), "dim": dim, "list": own, "norm": size,
                        "x": [r.tobytes() for r in x], "turned": [[r[s].tobytes() for s in column_blocks(dim)] for r in turned],
                    })

        self.rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()).mapInPandas(put, INDEX))
        sizes = self.rows.groupBy("dim", "list").count().collect()
        self.places = self._blocks(sorted((r["dim"], r["list"], r["count"]) for r in sizes))
        self.sizes = {(r["dim"], r["list"]): r["count"] for r in sizes}

    @staticmethod
    def _fit(rows: DataFrame, n: int) -> np.ndarray:
        k = min(MOST_LISTS, math.isqrt(n))
        bound = min(1 << 40, ((k * ROWS_PER_LIST) << 40) // n)
        shade = F.pmod(F.xxhash64("embedding", "vec_id"), F.lit(1 << 40))
        return fit_centres(np.array(sorted(r["embedding"] for r in rows.filter(shade < bound).select("embedding").collect())), k)

    @staticmethod
    def _blocks(sizes: list[tuple[int, int, int]]) -> dict[tuple[int, int], tuple[int, int]]:
        """(dim, list) to its first block and its number of blocks: small lists share one, large ones are dealt to several."""
        places, block, held, of = {}, -1, 0, None
        for dim, one, n in sizes:
            parts = -(-n // BLOCK)
            if parts == 1 and of == dim and held + n <= BLOCK:
                held += n
            else:
                block, held, of = block + 1, n if parts == 1 else BLOCK, dim
            places[dim, one] = (block, parts)
            block += parts - 1
        return places

    def lists_of(self, dim: int, q: np.ndarray) -> np.ndarray:
        """All lists of a length for each query, the most promising first."""
        return lists_of(self.centres, dim, q)


def lists_of(centres: dict[int, np.ndarray], dim: int, q: np.ndarray) -> np.ndarray:
    return np.argsort(-(q @ centres[dim].T.astype(np.float64)), axis=1, kind="stable") if dim in centres else np.zeros((len(q), 1), np.int64)


def probes_needed(index: Index, queries: DataFrame, wanted: float = WANTED_RECALL) -> dict[int, int]:
    """How many lists hold the wanted share of the true neighbours, by length of vector: CALIBRATING queries against all rows."""
    n = queries.groupBy("dim").count().collect()
    out: dict[int, int] = {}
    for dim, count in [(r["dim"], r["count"]) for r in n if r["dim"] in index.centres]:
        shade = F.pmod(F.xxhash64("rid"), F.lit(1 << 40))
        bound = min(1 << 40, (CALIBRATING << 40) // count) if count > CALIBRATING else 1 << 40
        sample = sorted((r["rid"], bytes(r["x"])) for r in queries.filter((F.col("dim") == dim) & (shade < bound)).select("rid", "x").collect())
        if not sample:
            out[dim] = len(index.centres[dim])
            continue
        q, qrid = np.frombuffer(b"".join(x for _, x in sample), np.float64).reshape(-1, dim), np.array([r for r, _ in sample])

        def true_lists(batches: Iterator[pd.DataFrame], q: np.ndarray = q, qrid: np.ndarray = qrid, dim: int = dim) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = _matrix(batch["x"], np.float64, dim)
                score = q @ x.T
                score[qrid[:, None] == batch["rid"].to_numpy()[None, :]] = -np.inf
                best = np.argpartition(-score, min(NEAREST, len(x)) - 1, axis=1)[:, :NEAREST]
                n = np.repeat(np.arange(len(q)), best.shape[1])
                best = best.ravel()
                yield pd.DataFrame({"n": n, "score": score[n, best], "vec_id": batch["vec_id"].to_numpy()[best], "list": batch["list"].to_numpy()[best]}).query("score > -inf")

        near = index.rows.filter(F.col("dim") == dim).select("rid", "vec_id", "list", "x").mapInPandas(true_lists, "n int, score double, vec_id long, list int")
        near = near.withColumn("at", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "vec_id"))).filter(F.col("at") <= NEAREST).collect()
        order = index.lists_of(dim, q)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        ranks = np.sort([place[r["n"], r["list"]] for r in near])
        out[dim] = int(ranks[min(len(ranks) - 1, math.ceil(wanted * len(ranks)))]) + 1 if len(ranks) else order.shape[1]
    return out


def search(vectors: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: the NEAREST rows found for every row whose vec_id is divisible by EACH.

    Rows without vec_id, and vectors that are null, zero or hold null or non-finite components,
    take no part. A query's candidates are the other rows whose vectors are as long; a vec_id
    that is there more than once is as many rows, each of which is a query or a candidate on its
    own. Equal scores go by the smaller vec_id. Columns other than vec_id and embedding are not
    read. An empty table gives an empty table.

    Every row is put into the list of the nearest of up to MOST_LISTS centres, which a bounded
    sample is fitted to, as a rotated unit vector in column blocks. A first round scans the list
    or lists that a query lies in, which gives a score to reach; a second one scans the others
    that are probed, as many as hold WANTED_RECALL of the true neighbours of CALIBRATING queries
    compared with all rows. Lists are packed into blocks of BLOCK rows, and longer ones dealt to
    several, so that neither rows of one vector nor queries to one list meet in one task.
    """
    spark = vectors.sparkSession
    index = Index(vectors)
    queries = index.rows.filter(F.pmod("vec_id", F.lit(EACH)) == 0)
    if not index.places:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    probes = probes_needed(index, queries)
    chunks = max(1, -(-queries.count() // BLOCK))
    shared = spark.sparkContext.broadcast((index.centres, index.sizes, index.places, probes))

    places = pd.DataFrame([(d, o, b, n) for (d, o), (b, n) in index.places.items()], columns=["dim", "list", "first", "parts"])
    where = F.broadcast(spark.createDataFrame(places, "dim int, list int, first int, parts int"))  # one row a list: MOST_LISTS for each length
    laid = index.rows.join(where, ["dim", "list"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    laid = laid.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select("block", "chunk", "rid", "vec_id", "dim", "list", "norm", "x", "turned")

    def asked(second: bool):
        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centres, sizes, places, probes = shared.value
            for batch in batches:
                out = []
                for dim, part in batch.groupby("dim"):
                    dim = int(dim)
                    order = lists_of(centres, dim, _matrix(part["x"], np.float64, dim))
                    counts = np.array([sizes.get((dim, i), 0) for i in range(order.shape[1])])
                    held = counts[order].cumsum(axis=1)
                    home = 1 + (held < 2 * NEAREST + 1).sum(axis=1)  # lists until there are enough rows
                    until = np.maximum(home, probes.get(dim, 1))
                    for row, lists, a, b in zip(part.to_dict("records"), order, home, until, strict=True):
                        blocks: dict[int, list[int]] = {}
                        for one in (lists[a:b] if second else lists[:a]).tolist():
                            if (dim, one) in places:
                                first, parts = places[dim, one]
                                for p in range(first, first + parts):
                                    blocks.setdefault(p, []).append(one)
                        out += [{**row, "block": block, "lists": some} for block, some in blocks.items()]
                if out:
                    yield pd.DataFrame(out)[[c.split()[0] for c in ASK.split(", ")]]

        return ask

    ASK = "qrid long, vec_id long, norm double, least double, x binary, turned array<binary>, block int, lists array<int>"

    def scanned(rows: DataFrame, second: bool) -> DataFrame:
        asks = rows.mapInPandas(asked(second), ASK).withColumn("chunk", F.pmod(F.xxhash64("qrid"), F.lit(chunks)).cast("int"))
        return stored(laid.groupBy("block", "chunk").cogroup(asks.groupBy("block", "chunk")).applyInPandas(scan, FOUND))

    asking = queries.select(F.col("rid").alias("qrid"), "vec_id", "dim", "norm", F.lit(None).cast("double").alias("least"), "x", "turned")
    first = scanned(asking, False)
    best = Window.partitionBy("qrid").orderBy(F.desc("score"), "vec_id", "rid")
    seeds = first.withColumn("at", F.row_number().over(best)).filter(F.col("at") == NEAREST).select("qrid", F.col("score").alias("least"))
    second = scanned(asking.drop("least").join(seeds, "qrid", "left"), True)
    found = first.unionByName(second).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= NEAREST)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    # No SQL: the search is approximate. Tests measure its recall against brute force.
    return search(table(spark, sf_dir, "embeddings"))
