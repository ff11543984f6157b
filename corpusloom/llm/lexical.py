"""Ranked lexical search: hashed max-sketches of every document give upper bounds, exact scores decide down to a threshold."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.session import pick, stored, table

BEST = 20
FIRST = 40  # documents of the highest bounds that are scored first for each item; the last of their BEST sets the threshold
COORDINATES = 10  # of a sketch for each distinct term at least
FOLDS = 4  # coordinates that a term folds to; the least of their maxima bounds its impact
FULL = 255  # a coordinate's value for as many occurrences or more
BLOCK_BYTES = 4_000_000  # of items' texts that are looked up at once
BROADCAST_DOCS = 200_000  # candidates of an item block up to which they are broadcast to the texts
DOCS_AT_ONCE, SKETCH_BYTES, LOOKUPS = 256, 1 << 24, 1_000_000  # limits of a batch of lookups

#: On UTF-8 bytes: letters and digits of ASCII, and all that is not ASCII.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text: bytes | None) -> list[bytes]:
    """A text's terms in order; only A-Z are lower-cased."""
    return TERM.findall(text.lower()) if text else []


def hashes(found: list[bytes]) -> np.ndarray:
    """64 bits of every term."""
    mixed = np.fromiter(map(zlib.crc32, found), np.uint64, len(found)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def places(hashed: np.ndarray, width: int) -> list[np.ndarray]:
    """Coordinates of terms in a sketch, of every fold."""
    first, step = hashed & np.uint64(0xFFFFFFFF), (hashed >> np.uint64(32)) | np.uint64(1)
    return [((first + np.uint64(i) * step) % np.uint64(width)).astype(np.int64) for i in range(FOLDS)]


def width_of(distinct: int) -> int:
    """Coordinates for so many terms: 2 or 3 times a power of two, so that many documents share a width."""
    least = max(32, COORDINATES * distinct)
    power = 1 << (least - 1).bit_length()
    return power * 3 // 4 if power * 3 // 4 >= least else power


def sketch(counts: Counter[bytes]) -> np.ndarray:
    """Largest number of occurrences of the terms that fold to a coordinate.

    A term's impact grows with its occurrences, so that the largest impact at a coordinate is
    that of its largest number.
    """
    width = width_of(len(counts))
    out = np.zeros(width, np.uint8)
    often = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), FULL).astype(np.uint8)
    hashed = hashes(list(counts))
    for at in places(hashed, width):
        np.maximum.at(out, at, often)
    return out


def length_norm(n: int, documents: int, all_terms: int) -> int:
    return 75 + (25 * n * documents) // all_terms


def impact(tf: int, m: int) -> int:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


@dataclass
class Items:
    """A block of items: their terms once each, and for each term the items that hold it with weight times repeats."""

    ids: list[int | None]
    terms: list[bytes]
    start: np.ndarray
    item: np.ndarray
    repeats: np.ndarray
    hashed: np.ndarray
    weight: np.ndarray  # of each term, once document frequencies are known

    @classmethod
    def of(cls, rows: list[tuple[int | None, bytes | None]]) -> Items:
        held: dict[bytes, list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(rows):
            for term, n in Counter(terms(text)).items():
                held.setdefault(term, []).append((i, n))
        sizes = [len(v) for v in held.values()]
        flat = [x for v in held.values() for x in v]
        return cls([i for i, _ in rows], list(held), np.r_[0, np.cumsum(sizes)].astype(np.int64), np.array([i for i, _ in flat], np.int64), np.array([n for _, n in flat], np.int64), hashes(list(held)), np.zeros(len(held), np.int64))

    def weigh(self, df: dict[int, int], documents: int) -> None:
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(self.terms))], np.int64)

    def bounds(self, sketches: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Upper bounds of every item's score for documents of one sketch width, all lookups in one batch."""
        often = None
        for at in places(self.hashed, sketches.shape[1]):
            here = sketches[:, at]
            often = here if often is None else np.minimum(often, here, out=often)
        doc, term = np.nonzero(often)
        tf = often[doc, term].astype(np.float64)
        most = np.where(tf == FULL, 1e6, 1e9 * tf / (1000 * tf + 12 * m[doc])) * self.weight[term]
        n = self.start[term + 1] - self.start[term]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        entry = np.repeat(self.start[term], n) + within
        flat = np.repeat(doc, n) * len(self.ids) + self.item[entry]
        sums = np.bincount(flat, weights=np.repeat(most, n) * self.repeats[entry], minlength=len(sketches) * len(self.ids))
        return sums.reshape(len(sketches), len(self.ids)) * (1 + 1e-9)


READ = "doc_id long, key long, n long, sketch binary, term int, df long"


def read_texts(docs: DataFrame, items: Items, with_sketches: bool) -> DataFrame:
    """One pass over all whole texts, written: each document's number of terms and sketch, and each task's document frequencies."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(items.terms)})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, df = shared.value, Counter()
        for batch in batches:
            out = []
            for doc_id, key, text in zip(batch["doc_id"], batch["key"], batch["text"], strict=True):
                counts = Counter(terms(text))
                if counts:
                    df.update(counts.keys() & asked.keys())
                    out.append((doc_id, key, counts.total(), sketch(counts).tobytes()))
            if with_sketches and out:
                yield pd.DataFrame(out, columns=["doc_id", "key", "n", "sketch"]).astype({"doc_id": "Int64"}).assign(term=None, df=None)
        if df:
            yield pd.DataFrame({"doc_id": None, "key": None, "n": None, "sketch": None, "term": [asked[t] for t in df], "df": list(df.values())})

    return stored(docs.mapInPandas(read, READ))


def bounded(sketches: DataFrame, items: Items, documents: int, all_terms: int, least: np.ndarray | None) -> DataFrame:
    """Without `least`, each task's FIRST documents of every item by bound: doc_id, key, item, bound. With it, doc_id, key and the items whose bound reaches their least."""
    shared = sketches.sparkSession.sparkContext.broadcast((items, least))

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, least = shared.value
        best = pd.DataFrame({"doc_id": pd.Series(dtype="Int64"), "key": pd.Series(dtype="int64"), "item": pd.Series(dtype="int64"), "bound": pd.Series(dtype="float64")})
        for batch in batches:
            batch = batch.astype({"doc_id": "Int64"})
            m = np.array([length_norm(int(n), documents, all_terms) for n in batch["n"]], np.int64)
            size = batch["sketch"].str.len().to_numpy()
            for width in np.unique(size):
                of_width = np.flatnonzero(size == width)
                step = max(1, min(DOCS_AT_ONCE, SKETCH_BYTES // int(width), LOOKUPS // len(items.item)))
                for a in range(0, len(of_width), step):
                    rows = of_width[a : a + step]
                    matrix = np.frombuffer(b"".join(batch["sketch"].iloc[rows]), np.uint8).reshape(len(rows), width)
                    bound = items.bounds(matrix, m[rows])
                    if least is not None:
                        doc, item = np.nonzero(bound >= least[None, :])
                        if len(doc):
                            start = np.r_[0, np.flatnonzero(np.diff(doc)) + 1]
                            held = batch.iloc[rows[doc[start]]]
                            yield pd.DataFrame({"doc_id": held["doc_id"].to_numpy(), "key": held["key"].to_numpy(), "items": np.split(item.astype(np.int32), start[1:])}).astype({"doc_id": "Int64"})
                        continue
                    if len(rows) > FIRST:
                        top = np.argpartition(-bound, FIRST - 1, axis=0)[:FIRST]
                    else:
                        top = np.repeat(np.arange(len(rows))[:, None], len(items.ids), axis=1)
                    item = np.broadcast_to(np.arange(len(items.ids)), top.shape).ravel()
                    doc, value = top.ravel(), np.take_along_axis(bound, top, axis=0).ravel()
                    on = value > 0
                    held = batch.iloc[rows[doc[on]]]
                    best = pd.concat([best, pd.DataFrame({"doc_id": held["doc_id"].to_numpy(), "key": held["key"].to_numpy(), "item": item[on], "bound": value[on]}).astype({"doc_id": "Int64"})])
                    if len(best) > 8 * FIRST * len(items.ids):
                        best = best.sort_values("bound", ascending=False, kind="stable").groupby("item").head(FIRST)
        if least is None and len(best):
            yield best.sort_values("bound", ascending=False, kind="stable").groupby("item").head(FIRST)

    shape = "doc_id long, key long, item int, bound double" if least is None else "doc_id long, key long, items array<int>"
    return sketches.select("doc_id", "key", "n", "sketch").mapInPandas(look_up, shape)


def rescored(docs: DataFrame, wanted: DataFrame, items: Items, documents: int, all_terms: int, least: np.ndarray) -> DataFrame:
    """item, doc_id, score: exact scores, of the whole texts, of wanted (doc_id, key, items) that reach the items' least."""
    shared = docs.sparkSession.sparkContext.broadcast((items, least))
    wanted = stored(wanted)
    few = wanted.count() <= BROADCAST_DOCS
    ours = wanted.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "items")
    held = docs.join(F.broadcast(ours) if few else ours, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, least = shared.value
        place = {t: i for i, t in enumerate(items.terms)}
        for batch in batches:
            out = []
            for doc_id, text, which in zip(batch["doc_id"], batch["text"], batch["items"], strict=True):
                counts = Counter(terms(text))
                m = length_norm(counts.total(), documents, all_terms)
                total = np.zeros(len(items.ids), np.int64)
                for t in counts.keys() & place.keys():
                    i = place[t]
                    part = slice(items.start[i], items.start[i + 1])
                    total[items.item[part]] += items.repeats[part] * (items.weight[i] * impact(counts[t], m))
                out += [(int(i), doc_id, int(total[i])) for i in which if total[i] >= least[i]]
            if out:
                yield pd.DataFrame(out, columns=["item", "doc_id", "score"]).astype({"doc_id": "Int64"})

    return held.select("doc_id", "text", "items").mapInPandas(score, "item int, doc_id long, score long")


def ranked(pairs: DataFrame) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= BEST)


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: each item's BEST documents with a score above 0, the whole texts counting on both sides.

    Null and empty texts hold no term: such documents do not count in N and are never found, such
    items find nothing. Equal scores go by doc_id, those without one last. A doc_id or an item
    that is there more than once is as many documents, or items ranked on their own. Columns
    other than doc_id, item_id and text are not read. Empty tables give an empty table.

    One pass folds every document's impacts into a sketch of coordinatewise maxima and counts how
    many documents hold the items' terms. Batched lookups of the items' terms in every sketch
    give upper bounds; the FIRST documents by bound are scored exactly, and all whose bound
    reaches the last of the BEST so found are scored then, so that no document is missed. Items
    are taken in blocks of about BLOCK_BYTES of text; the table of sketches is made once.
    """
    spark = docs.sparkSession
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
    asked = pick(benchmark, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    out, sketches, documents, all_terms = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long"), None, 0, 0
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        items = Items.of(sorted(((r["item_id"], None if r["text"] is None else bytes(r["text"])) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or b"")))
        if not items.terms:
            continue
        read = read_texts(texts, items, sketches is None)
        if sketches is None:
            sketches = read.filter("sketch IS NOT NULL")
            documents, all_terms = sketches.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not documents:
            break
        items.weigh({r["term"]: r["df"] for r in read.filter("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")).collect()}, documents)

        highest = Window.partitionBy("item").orderBy(F.desc("bound"), "key", "doc_id")
        first = bounded(sketches, items, documents, all_terms, None).withColumn("at", F.row_number().over(highest)).filter(F.col("at") <= FIRST)
        first = first.groupBy("doc_id", "key").agg(F.collect_set("item").alias("items"))
        least = np.ones(len(items.ids), np.int64)
        seen = ranked(rescored(texts, first, items, documents, all_terms, least))
        for r in seen.filter(F.col("rank") == BEST).select("item", "score").collect():  # a number for each item of the block
            least[r["item"]] = max(1, r["score"])
        found = bounded(sketches, items, documents, all_terms, least).dropDuplicates(["doc_id", "key"])
        names = F.broadcast(spark.createDataFrame(list(enumerate(items.ids)), "item int, item_id long"))
        best = ranked(rescored(texts, found, items, documents, all_terms, least))
        out = out.unionByName(best.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = {
    "op12_lexical_search": r"""
WITH t AS (
  SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)
), c AS (SELECT rid, doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
n AS (SELECT rid, sum(tf)::BIGINT AS n FROM c GROUP BY rid),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
d AS (SELECT term, count(*)::BIGINT AS df FROM c GROUP BY term),
q AS (
  SELECT qid, item_id, term, count(*)::BIGINT AS repeats FROM (
    SELECT qid, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS qid, item_id, text FROM benchmark)) GROUP BY ALL
), w AS (
  SELECT qid, item_id, q.term, repeats, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM q JOIN d USING (term), s
), scored AS (
  SELECT qid, item_id, rid, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // terms)))))::BIGINT AS score
  FROM w JOIN c USING (term) JOIN n USING (rid), s GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20"""
}
