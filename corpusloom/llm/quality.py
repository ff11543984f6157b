"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import arrays
from corpusloom.llm.words import split_words, worker_cache
from corpusloom.session import nonnull, pick, stored, table

BUCKETS = 1 << 16  # words are hashed to so many vectors: the model's size does not grow with the corpus
RESERVED = 64  # the first buckets are for marks and markers
DIM = 32
NONZERO = 4  # of a random index vector
REACH = 2  # words to either side that are context
SLICES = 16
SAMPLE_ROWS = 20_000  # labelled documents that the network is fitted on, give or take a few hundredths
TOKENS_AT_ONCE = 2_000_000  # whose contexts are summed at once
HIDDEN = 24
EPOCHS = 60  # at most
PATIENCE = 8  # epochs without a lower loss on the stopping rows, after which the fit ends
RATE, DECAY = 0.003, 2.0  # of a step, and of the first layer's weights by steps of that rate
THRESHOLD = 0.3
CACHE_WORDS = 300_000
FEATURES = DIM + 3

AGAIN, LINE_AGAIN, CAPITALS, NUMBER = 0, 1, 2, 3
MARKS = 4  # marks go to RESERVED - MARKS buckets
PARTS = re.compile(r"[^\W\d_]+|\d+|.", re.S)


def _ids_of(word: str) -> bytes:
    """Bucket ids of a word's runs of letters, numbers and marks, with a marker before capitals."""
    ids = []
    for part in PARTS.findall(word):
        if part[0].isalpha():
            if len(part) > 1 and part.isupper():
                ids.append(CAPITALS)
            ids.append(RESERVED + zlib.crc32(part.lower().encode("utf-8", "replace")) % (BUCKETS - RESERVED))
        elif part[0].isdigit():
            ids.append(NUMBER)
        else:
            ids.append(MARKS + zlib.crc32(part.encode("utf-8", "replace")) % (RESERVED - MARKS))
    return array("i", ids).tobytes()


def tokens(text: str | None) -> np.ndarray:
    """Bucket ids of a whole text. A word like one of the two before it is AGAIN; a line seen before adds LINE_AGAIN."""
    words = split_words(text)
    cache = worker_cache("quality")
    found = list(map(cache.get, words))
    if None in found:
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for i, (w, f) in enumerate(zip(words, found, strict=True)):
            if f is None:
                ids = cache.get(w)
                if ids is None:
                    ids = _ids_of(w)
                    if len(w) < 64:
                        cache[w] = ids
                found[i] = ids
    ids = np.frombuffer(b"".join(found), np.int32)
    if len(ids) > 1:
        same = np.zeros(len(ids), bool)
        same[1:] = ids[1:] == ids[:-1]
        same[2:] |= ids[2:] == ids[:-2]
        ids = np.where(same & (ids >= RESERVED), AGAIN, ids)
    if text and "\n" in text:
        lines = [x for x in text.split("\n") if x.strip()]
        repeats = len(lines) - len(set(lines))
        if repeats:
            ids = np.concatenate([ids, np.full(8 * repeats, LINE_AGAIN, np.int32)])
    return ids


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every bucket's random index vector."""
    random = np.random.default_rng(11)
    places = np.argsort(random.random((BUCKETS, DIM)), axis=1)[:, :NONZERO].astype(np.int64)
    return places, np.where(np.arange(NONZERO) % 2 == 0, 1.0, -1.0)


def _add_contexts(total: np.ndarray, texts: pd.Series) -> None:
    """Add to every token's row the index vectors of the tokens around it, within its text."""
    places, signs = index_vectors()
    gap = np.full(REACH, -1, np.int32)
    run, size = [], 0

    def flush() -> None:
        ids = np.concatenate(run)
        for off in range(1, REACH + 1):
            a, b = ids[:-off], ids[off:]
            inside = (a >= 0) & (b >= 0)
            if off > 1:  # a gap between them parts two texts
                for k in range(1, off):
                    inside &= ids[k : len(ids) - off + k] >= 0
            a, b = a[inside].astype(np.int64), b[inside].astype(np.int64)
            for center, other in ((a, b), (b, a)):
                flat = center * DIM
                for k in range(NONZERO):
                    counts = np.bincount(flat + places[other, k], minlength=BUCKETS * DIM)
                    total[:, :DIM] += (signs[k] * counts).astype(np.int64).reshape(BUCKETS, DIM)
        total[:, DIM] += np.bincount(ids[ids >= 0], minlength=BUCKETS)

    for text in texts:
        ids = tokens(text)
        if len(ids):
            run += [ids, gap]
            size += len(ids) + REACH
        if size > TOKENS_AT_ONCE:
            flush()
            run, size = [], 0
    if run:
        flush()


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of the buckets, from all texts of docs; sums are whole numbers, so order changes nothing."""
    shape = (BUCKETS, DIM + 1)
    parts = arrays.over_batches(docs, "text", _add_contexts, shape, np.int64, SLICES)
    total = arrays.merged(parts, shape, np.int64, SLICES)
    vectors = total[:, :DIM].astype(np.float64)
    seen = total[:, DIM] > 0
    if seen.any():
        weight = total[seen, DIM]
        vectors[seen] /= np.maximum(1e-9, np.linalg.norm(vectors[seen], axis=1, keepdims=True))
        vectors -= (vectors[seen] * weight[:, None]).sum(axis=0) / weight.sum()
        vectors[~seen] = 0
    return vectors.astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """A document's features: mean of its words' vectors, that mean's length, log of its words, share of rare marks."""
    ids = tokens(text)
    out = np.zeros(FEATURES, np.float32)
    if len(ids):
        mean = vectors[ids].mean(axis=0)
        out[:DIM] = mean
        out[DIM] = np.sqrt((mean * mean).sum())
        out[DIM + 1] = np.log1p(len(ids))
        out[DIM + 2] = (ids < RESERVED).mean()
    return out


@dataclass
class Network:
    """Two layers on standardised features; logits are divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def _loss(net: Network, x: np.ndarray, y: np.ndarray, temperature: float = 1.0) -> float:
    logits = net.logits(x)
    return float(np.logaddexp(0, np.where(y == 1, -logits, logits) / temperature).mean())


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """Adam with decayed weights on four fifths of the rows; a tenth says when to stop, another sets the temperature by least log loss.

    The weights of the epoch with the least loss on the stopping rows are kept. Without both labels, a constant.
    """
    x, y = np.asarray(x, np.float64).reshape(-1, FEATURES), np.asarray(y, np.float64)
    random = np.random.default_rng(seed)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    rate = min(0.99, max(0.01, y.mean())) if len(y) else 0.5
    net = Network(mean, scale, random.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), random.normal(0, 0.1, HIDDEN), float(np.log(rate / (1 - rate))))
    if len(set(y.tolist())) < 2:
        net.w2[:] = 0
        return net
    order = random.permutation(len(x))
    tenth = max(1, len(x) // 10)
    calibrating, stopping, fitted = order[:tenth], order[tenth : 2 * tenth], order[2 * tenth :]
    if not len(fitted):  # a handful of rows: all parts are all rows
        calibrating = stopping = fitted = order
    z = (x - mean) / scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, best, since = 0, (np.inf, params), 0
    for _ in range(EPOCHS):
        random.shuffle(fitted)
        for at in range(0, len(fitted), 128):
            rows = fitted[at : at + 128]
            hidden = np.tanh(z[rows] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-(hidden @ params[2] + params[3][0]))) - y[rows]) / len(rows)
            back = np.outer(error, params[2]) * (1 - hidden**2)
            grads = [z[rows].T @ back, back.sum(axis=0), hidden.T @ error, np.array([error.sum()])]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                if p.ndim == 2:
                    p *= 1 - RATE * DECAY
        net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
        now = _loss(net, x[stopping], y[stopping])
        best, since = ((now, [p.copy() for p in params]), 0) if now < best[0] else (best, since + 1)
        if since == PATIENCE:
            break
    w1, b1, w2, b2 = best[1]
    net.w1, net.b1, net.w2, net.b2 = w1, b1, w2, float(b2[0])
    losses = {t: _loss(net, x[calibrating], y[calibrating], t) for t in np.geomspace(0.5, 20, 60)}
    net.temperature = float(min(losses, key=losses.get))
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network

    def column(self, spark: SparkSession, text: Column) -> Column:
        """Score of a text as an expression, so that whatever else a row holds stays as it is."""
        shared = spark.sparkContext.broadcast((self.vectors, self.network))

        @F.pandas_udf(T.DoubleType())
        def score(texts: pd.Series) -> pd.Series:
            vectors, network = shared.value
            return pd.Series(network.scores(np.array([pooled(t, vectors) for t in texts], np.float64).reshape(-1, FEATURES)))

        return score(text)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id, x (float32 features as binary) of every row, written."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "x": [pooled(t, shared.value).tobytes() for t in batch["text"]]})

    return stored(docs.select("doc_id", "text").mapInPandas(pool, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x binary"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Model, DataFrame]:
    """The model and every document's features.

    Word vectors come from all texts. The network is fitted on some sample_rows labelled
    documents, those of the least hashes, never on held-out ones. Labels other than 0 and 1
    are ignored; of repeated labels the least counts, and repeated documents count once.
    """
    texts = pick(docs, "doc_id", "text")
    vectors = word_vectors(texts)
    x = features(texts, vectors)
    marked = pick(labels, "doc_id", "quality").filter("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = x.join(marked.filter(~held_out()), "doc_id").select("doc_id", "x", "quality").distinct()
    # Rows below a bound of their hash, set by their count, so that each task sends its share of the sample alone.
    shade = F.pmod(F.xxhash64("doc_id", "x"), F.lit(1 << 40))
    bound = min(1 << 40, (sample_rows << 40) // max(1, rows.count()))
    sample = sorted((r["shade"], bytes(r["x"]), r["quality"]) for r in rows.filter(shade < bound).select(shade.alias("shade"), "x", "quality").collect())
    data = np.frombuffer(b"".join(r[1] for r in sample), np.float32).reshape(-1, FEATURES)
    return Model(vectors, fit(data, np.array([r[2] for r in sample]))), x


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; null and empty texts are scored as texts without words.

    Texts are read whole whatever their length. Repeated rows get equal scores; rows without
    doc_id are scored, and never held out. Without usable labels every score is 0.5; with one
    label alone all scores are equal. Columns other than doc_id and text are not read. An empty
    table gives an empty table.
    """
    model, x = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model.network)

    @F.pandas_udf(T.DoubleType())
    def score(blobs: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(np.frombuffer(b"".join(blobs), np.float32).reshape(-1, FEATURES)))

    scored = x.select("doc_id", held_out().alias("held_out"), score("x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are predicted to be good, with the columns they had, whatever these are called.

    Null and empty texts are judged as texts without words; repeated rows stay or go together.
    An empty table gives an empty table.
    """
    model, _ = train(docs, labels)
    held = docs.columns
    place = held.index("text") if "text" in held else [c.lower() for c in held].index("text")
    plain = docs.toDF(*[f"_c{i}" for i in range(len(held))])
    kept = plain.filter(model.column(docs.sparkSession, nonnull(f"_c{place}")) >= THRESHOLD)
    return kept.toDF(*held)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    # No SQL: a trained model. Tests measure it on held-out documents.
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
