"""Set-similarity join on word shingles: position-blocked index lists and answers shared within similar sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import arrays
from corpusloom.llm.components import components
from corpusloom.llm.words import lower_ascii, split_words, worker_cache
from corpusloom.session import drop_stored, pick, release, rows_at_once, stored, table

WORDS = 5
# Two sets link if 7 * shared >= 3 * (sizes added), which is a similarity of 0.75.
NEED, OF = 3, 7
COUNTERS = 1 << 22  # of the frequency sketch that orders shingles; its size does not grow with the corpus
SLICES = 64
LEAST_BITS, MOST_BITS = 1 << 11, 1 << 17  # parity bits of a set, two or more a shingle, whose differences bound two sets' difference
BROADCAST_IDS = 500_000  # row numbers and ids are broadcast up to so many (4 MB), else joined by shuffle
POSTINGS_PER_BUCKET = 500_000  # of the index lists that one group holds; the number of buckets follows from the sets' sizes
LEAST_BUCKETS = 64
MOST_PLACE = 255  # a posting's place in its set, where larger ones count as this, which skips less and loses nothing
LIST_PART = 65_536  # a list of a shingle in more documents is cut by its sets into parts of about so many
LIST_BLOCK = 500  # sets of an open list that are compared with as many others in one group
CACHE_WORDS = 200_000
ROWS_AT_ONCE = 500  # texts, sets or pairs of sets that a worker holds
ROW_GROUP_MB = 4  # of the files of sets
BAND = np.log(4 / 3)  # sizes of linked sets lie in the same band or in the next
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's shingles: of 5 words, or of all where there are fewer."""
    words = split_words(lower_ascii(text)) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    cache = worker_cache("jaccard")
    found = list(map(cache.get, words))
    if None in found:
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for i, (w, f) in enumerate(zip(words, found, strict=True)):
            if f is None:
                found[i] = cache.get(w) or xxhash.xxh64_digest(w.encode("utf-8", "replace"))
                if len(w) < 64:
                    cache[w] = found[i]
    h = np.frombuffer(b"".join(found), np.uint64)
    n = len(h)
    if n < WORDS:
        total = (h * _ODD[:n]).sum(dtype=np.uint64) + np.uint64(n)
        return _mixed(np.array([total], np.uint64))
    total = h[: n - WORDS + 1] * _ODD[0]
    for k in range(1, WORDS):
        total = total + h[k : n - WORDS + 1 + k] * _ODD[k]
    total = np.sort(_mixed(total))
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def _digest(items: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(items.tobytes()) - (1 << 63)


def _bitmap(items: np.ndarray) -> bytes:
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(2 * len(items) - 1).bit_length()))
    odd = np.bincount((items >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _bits_apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Differing parity bits of pairs of sets; the longer bitmap of a pair is folded onto the shorter, which parities allow."""
    out = np.zeros(len(a), np.int64)
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    for size in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == size).all(axis=1))
        x, y = (np.frombuffer(b"".join([side[i] for i in at]), np.uint64).reshape(len(at), -1, min(size) // 8) for side in (a, b))
        out[at] = np.bitwise_count(np.bitwise_xor.reduce(x, axis=1) ^ np.bitwise_xor.reduce(y, axis=1)).sum(axis=1)
    return out


def _packed(items: np.ndarray) -> bytes:
    """The upper 48 bits of a set's hashes, in order: for comparing two sets they tell shingles apart as well as 64 do."""
    return (items >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _sketch_place(items: np.ndarray) -> np.ndarray:
    """Counter of the upper 48 bits of a hash, which is the one of their lower 32 bits too."""
    return (items >> np.uint64(3)).astype(np.int64) & (COUNTERS - 1)


def sets_of(docs: DataFrame) -> DataFrame:
    """One pass over all texts, written: per document a row number, its set's digest, size, bitmap and packed hashes
    (kind 0), and each task's part of the frequency sketch (kind 1). A document without words has no digest. Of equal
    sets that a task meets the hashes are written once, with the row that is marked `whole`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    groups = arrays.merging_groups(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(COUNTERS, np.uint32)
        known: set[int] = set()
        for batch in batches:
            digests, sizes, bitmaps, packed, pending, held = [], [], [], [], [], 0
            for text in batch["text"]:
                items = shingles(text)
                some = len(items) > 0
                sizes.append(len(items))
                node = _digest(items) if some else None
                digests.append(node)
                bitmaps.append(_bitmap(items) if some else None)
                packed.append(_packed(items) if some and node not in known else None)
                known.add(node)
                pending.append(_sketch_place(items >> np.uint64(16)))
                held += len(items)
                if held > 1_000_000:
                    np.add(counts, np.bincount(np.concatenate(pending), minlength=COUNTERS).astype(np.uint32), out=counts)
                    pending, held = [], 0
            if held:
                np.add.at(counts, np.concatenate(pending), 1)
            yield pd.DataFrame({"kind": 0, "row": batch["_row"], "doc_id": batch["doc_id"], "node": pd.array(digests, dtype="Int64"), "size": sizes, "bitmap": bitmaps, "whole": [p is not None for p in packed], "items": packed, "slice": None, "part": None, "data": None})
        part = arrays.partial_rows(counts, SLICES, groups)
        yield pd.DataFrame({"kind": 1, "row": None, "doc_id": None, "node": None, "size": None, "bitmap": None, "whole": None, "items": None, "slice": part["slice"], "part": part["part"], "data": part["data"]})

    schema = f"kind int, row long, doc_id {kind}, node long, size int, bitmap binary, whole boolean, items binary, {arrays.PARTIAL}"
    with rows_at_once(docs.sparkSession, ROWS_AT_ONCE):
        return stored(docs.withColumn("_row", F.monotonically_increasing_id()).mapInPandas(run, schema), row_group_mb=ROW_GROUP_MB)


def _frequency_classes(sets: DataFrame) -> np.ndarray:
    """Of every counter the whole part of its logarithm: the order of shingles is by class, then by hash."""
    parts = sets.filter("kind = 1").select("slice", "part", "data")
    counts = arrays.merged(parts, (COUNTERS,), np.uint32, SLICES)
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.uint8)


def _parts_of(classes: np.ndarray, tokens: np.ndarray, list_part: int) -> np.ndarray:
    """Into how many parts the lists of tokens are cut, from how many documents may hold them."""
    return np.maximum(1, (np.int64(2) << classes[_sketch_place(tokens)].astype(np.int64)) // list_part)


def _index_lists(sets: DataFrame, classes: Broadcast, buckets: int, list_part: int) -> DataFrame:
    """Postings of every set's prefix: its first size/4 + 1 shingles, rare ones first, dealt by shingle to buckets.

    Two sets that link share a shingle of their prefixes. A row holds a batch's postings of one
    bucket: shingle, place in the batch's list of sets, and position in the set. A shingle that
    very many documents hold is dealt to several buckets, by its sets.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order_class = classes.value
        known: set[int] = set()
        for batch in batches:
            nodes, sizes, tokens, owners, places = [], [], [], [], []
            for node, size, blob in zip(batch["node"].tolist(), batch["size"].tolist(), batch["items"], strict=True):
                if node in known:
                    continue
                known.add(node)
                items = _unpacked(blob)
                prefix = int(size) // 4 + 1
                first = np.argsort(order_class[_sketch_place(items)], kind="stable")[:prefix]  # the hashes are in order already
                owners.append(np.full(len(first), len(nodes), np.uint32))
                places.append(np.minimum(np.arange(len(first)), MOST_PLACE).astype(np.uint8))
                tokens.append(items[first])
                nodes.append(node), sizes.append(size)
            if not nodes:
                continue
            token, owner, place = np.concatenate(tokens), np.concatenate(owners), np.concatenate(places)
            node_array, size_array = np.array(nodes, np.int64), np.array(sizes, np.uint32)
            parts = _parts_of(order_class, token, list_part)
            part = _mixed(node_array[owner].view(np.uint64)) % parts.astype(np.uint64)
            bucket = (((token >> np.uint64(16)) + part) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            token, owner, place, bucket = token[order].astype(np.uint32), owner[order], place[order], bucket[order]
            bounds = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            rows = []
            for a, b in zip(bounds, [*bounds[1:], len(bucket)], strict=True):
                here, local = np.unique(owner[a:b], return_inverse=True)
                rows.append((int(bucket[a]), node_array[here].tobytes(), size_array[here].tobytes(), token[a:b].tobytes(), local.astype(np.uint32).tobytes() if len(here) > 65535 else local.astype(np.uint16).tobytes(), place[a:b].tobytes()))
            yield pd.DataFrame(rows, columns=["bucket", "nodes", "sizes", "tokens", "owners", "places"])

    held = sets.filter("kind = 0 AND whole").select("node", "size", "items")
    return held.mapInPandas(run, "bucket int, nodes binary, sizes binary, tokens binary, owners binary, places binary")


def _may_link(size_a, size_b, place_a, place_b):
    """Whether two sets whose first common shingle has these positions can share enough."""
    left = np.minimum(size_a - place_a, size_b - place_b)
    return OF * left >= NEED * (size_a + size_b)


PAIR, LISTED, PIVOT = -1, 0, 1  # kinds of rows of _bucket_pairs


def _bucket_pairs(group: pd.DataFrame, classes: np.ndarray, buckets: int, list_part: int) -> pd.DataFrame:
    """Of a bucket's index lists: pairs of each set with its list's pivots, lists of three or more sets, and pivots of cut lists.

    A list is skipped in blocks: sets of sizes that cannot link lie in other bands, and pairs
    whose positions leave too little to share are left out. Every band of a list has one
    pivot, the set with the fewest rarer shingles, which is the one most like the others; a set
    is compared with those of its band and of the next ones. The parts of a list that was cut
    have pivots of their own, which are compared in links(). What the pivots leave open is
    found from their answers later, see links().
    """
    nodes, sizes, tokens, owners, places, base = [], [], [], [], [], 0
    for n, s, t, o, p in zip(group["nodes"], group["sizes"], group["tokens"], group["owners"], group["places"], strict=True):
        n, t = np.frombuffer(n, np.int64), np.frombuffer(t, np.uint32)
        nodes.append(n), sizes.append(np.frombuffer(s, np.uint32)), tokens.append(t)
        owners.append(np.frombuffer(o, np.uint16 if len(o) == 2 * len(t) else np.uint32).astype(np.int64) + base)
        places.append(np.frombuffer(p, np.uint8))
        base += len(n)
    unique, first, where = np.unique(np.concatenate(nodes), return_index=True, return_inverse=True)
    size_of = np.concatenate(sizes)[first].astype(np.int64)
    token, owner, place = np.concatenate(tokens), where[np.concatenate(owners)], np.concatenate(places).astype(np.int64)
    columns = ["kind", "a", "b", "list", "size", "place"]
    # Only lists of two sets or more; a set that several batches held counts once.
    order = np.lexsort((owner, token))
    token, owner, place = token[order], owner[order], place[order]
    fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])])
    token, owner, place = token[fresh], owner[fresh], place[fresh]
    start = np.concatenate([[True], token[1:] != token[:-1]])
    run = np.cumsum(start) - 1
    length = np.bincount(run)[run]
    cut = _parts_of(classes, token.astype(np.uint64), list_part) > 1
    shared = (length >= 2) | cut
    token, owner, place, length, cut = token[shared], owner[shared], place[shared], length[shared], cut[shared]
    if not len(token):
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
    size = size_of[owner]
    band = np.floor(np.log(size) / BAND).astype(np.int64)
    with np.errstate(over="ignore"):
        choice = _mixed(unique[owner].view(np.uint64))
    order = np.lexsort((choice, place, band, token))
    token, owner, place, length, size, band, cut = token[order], owner[order], place[order], length[order], size[order], band[order], cut[order]
    opens = np.concatenate([[True], (token[1:] != token[:-1]) | (band[1:] != band[:-1])])
    block = np.cumsum(opens) - 1
    pivot = np.flatnonzero(opens)
    pairs = []
    for step in (0, 1, -1):
        other = block + step
        inside = (other >= 0) & (other < len(pivot))
        mine = np.flatnonzero(inside)
        its = pivot[other[mine]]
        ok = (token[mine] == token[its]) & (np.abs(band[mine] - band[its]) <= 1) & (owner[mine] != owner[its])
        ok &= _may_link(size[mine], size[its], place[mine], place[its])
        a, b = owner[mine[ok]], owner[its[ok]]
        pairs.append(np.minimum(a, b) * len(unique) + np.maximum(a, b))
    code = np.unique(np.concatenate(pairs))
    found = pd.DataFrame({"kind": PAIR, "a": unique[code // len(unique)], "b": unique[code % len(unique)], "list": 0, "size": 0, "place": 0})
    # Of two sets in bands that can link one has met the other as a pivot; three or more are listed.
    held = np.bincount(block)
    beside = (token[pivot[1:]] == token[pivot[:-1]]) & (band[pivot[1:]] - band[pivot[:-1]] == 1)
    around = held + np.concatenate([[0], held[:-1] * beside]) + np.concatenate([held[1:] * beside, [0]])
    long = (around[block] >= 3) | cut
    # A list is known by its shingle and the bucket of its first part.
    part = (choice[order] % _parts_of(classes, token.astype(np.uint64), list_part).astype(np.uint64)).astype(np.int64)
    name = ((int(group["bucket"].iloc[0]) - part) % buckets << 32) + token.astype(np.int64)
    rows = lambda kind, at: pd.DataFrame({"kind": kind, "a": unique[owner[at]], "b": 0, "list": name[at], "size": size[at], "place": place[at]})
    return pd.concat([found, rows(LISTED, long), rows(PIVOT, pivot[cut[pivot]])], ignore_index=True)[columns]


def _pair_verdicts(pairs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among pairs (a, b), written: first by size and bitmap, then by the whole sets."""

    def possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            apart = _bits_apart(batch["bitmap_a"].tolist(), batch["bitmap_b"].tolist())
            yield batch.loc[OF * apart <= batch["size_a"].to_numpy(np.int64) + batch["size_b"].to_numpy(np.int64), ["a", "b", "row_a", "row_b"]]

    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.col("size").alias(f"size_{name}"), F.col("bitmap").alias(f"bitmap_{name}"), F.col("row").alias(f"row_{name}"))

    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter("4 * least(size_a, size_b) >= 3 * greatest(size_a, size_b)")
    left = stored(sized.mapInPandas(possible, "a long, b long, row_a long, row_b long"))
    wanted = stored(left.select(F.explode(F.array("row_a", "row_b")).alias("row")).distinct())
    rows = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    # A node's row is one of those that hold its set, so every set is there once.
    whole = stored(sets.filter("kind = 0").select("row", "node", "items").join(rows, "row", "left_semi").select("node", "items"), row_group_mb=ROW_GROUP_MB)

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = []
            for x, y in zip(batch["items_a"], batch["items_b"], strict=True):
                s, t = _unpacked(x), _unpacked(y)
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                kept.append(OF * int((t[at] == s).sum()) >= NEED * (len(s) + len(t)))
            yield batch.loc[kept, ["a", "b"]]

    with_sets = left.select("a", "b").join(whole.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a")
    with_sets = with_sets.join(whole.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b")
    with rows_at_once(sets.sparkSession, ROWS_AT_ONCE):
        verdicts = stored(with_sets.mapInPandas(exact, "a long, b long"))
    for done in (left, wanted, whole):
        drop_stored(done)
    return verdicts


def _pairs_of_pivots(pivots: DataFrame) -> DataFrame:
    """Pairs of the pivots of a cut list's parts with the list's own pivot of their size band or the next ones."""
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(float(BAND)))
    rows = pivots.select("list", "size", "place", F.col("a").alias("node"), band.alias("band"))
    first = rows.groupBy("list", "band").agg(F.min(F.struct("place", F.xxhash64("node").alias("order"), "node", "size")).alias("p"))
    near = rows.select("*", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("other"))
    met = near.join(first.select("list", F.col("band").alias("other"), "p"), ["list", "other"])
    shared = F.least(F.col("size") - F.col("place"), F.col("p.size") - F.col("p.place"))
    ok = (F.col("node") != F.col("p.node")) & (OF * shared >= NEED * (F.col("size") + F.col("p.size")))
    return met.filter(ok).select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b"))


def _pairs_of_lists(open_: DataFrame, list_block: int) -> DataFrame:
    """Pairs of one list's sets in different components that sizes and positions leave possible.

    open_: list, n (its length), node, size, place, component. A list's sets are dealt into
    blocks of about list_block, and every two blocks meet in a group of their own.
    """
    apart = F.col("x.component") != F.col("y.component")
    shared = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    near = OF * shared >= NEED * (F.col("x.size") + F.col("y.size"))
    pair = [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]
    short = open_.filter(F.col("n") <= list_block).drop("n")
    of_short = short.alias("x").join(short.alias("y"), (F.col("x.list") == F.col("y.list")) & (F.col("x.node") < F.col("y.node")) & apart & near).select(*pair)
    blocks = F.ceil(F.col("n") / list_block).cast("int")
    dealt = open_.filter(F.col("n") > list_block).withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    x = dealt.select("*", F.col("_own").alias("_i"), F.explode(F.sequence("_own", F.col("_blocks") - 1)).alias("_j")).alias("x")
    y = dealt.select("*", F.col("_own").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_i")).alias("y")
    met = x.join(
        y,
        (F.col("x.list") == F.col("y.list")) & (F.col("x._i") == F.col("y._i")) & (F.col("x._j") == F.col("y._j"))
        & ((F.col("x._own") < F.col("y._own")) | (F.col("x.node") < F.col("y.node"))) & apart & near,
    )
    return of_short.unionByName(met.select(*pair))


def links(sets: DataFrame, nodes: DataFrame, classes: np.ndarray, list_part: int = LIST_PART, list_block: int = LIST_BLOCK) -> DataFrame:
    """Links (a, b) between nodes (different sets) whose components are those of all links.

    First every set is compared with the pivots of its index lists. Sets that link with a
    pivot share its answers: a pair of one component is not compared. Then, of each list,
    the pairs that lie in different components and were not compared yet are, unless sizes or
    positions rule them out. So every pair of sets that links is found or lies in a component.
    """
    spark = sets.sparkSession
    postings = nodes.agg(F.sum(F.floor(F.col("size") / 4) + 1)).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-postings // POSTINGS_PER_BUCKET))
    shared = spark.sparkContext.broadcast(classes)

    def pairs_of(group: pd.DataFrame) -> pd.DataFrame:
        return _bucket_pairs(group, shared.value, buckets, list_part)

    lists = _index_lists(sets, shared, buckets, list_part)
    with rows_at_once(spark, 20 * ROWS_AT_ONCE):
        found = stored(lists.groupBy("bucket").applyInPandas(pairs_of, "kind int, a long, b long, list long, size long, place long"))
    release(spark)
    pairs = found.filter(F.col("kind") == PAIR).select("a", "b").unionByName(_pairs_of_pivots(found.filter(F.col("kind") == PIVOT)))
    tested = stored(pairs.distinct())
    first = _pair_verdicts(tested, nodes, sets)
    release(spark)

    part = stored(components(first))
    named = found.filter(F.col("kind") == LISTED).select("list", F.col("a").alias("node"), "size", "place").join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stored(named)
    drop_stored(found)
    split = stored(named.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high").select("list", "n"))
    hint = F.broadcast if split.count() <= BROADCAST_IDS else (lambda df: df)
    open_ = stored(named.join(hint(split), "list"))
    drop_stored(named)
    rest = stored(_pairs_of_lists(open_, list_block).distinct().join(tested, ["a", "b"], "left_anti"))
    for done in (open_, tested):
        drop_stored(done)
    release(spark)
    if rest.isEmpty():
        return first
    return first.unionByName(_pair_verdicts(rest, nodes, sets))


def _rows_in_components(texts: DataFrame) -> DataFrame:
    """Per row of texts (doc_id, text): doc_id, node, n_shingles, component (a node; null without words)."""
    sets = sets_of(texts)
    rows = sets.filter("kind = 0").select("row", "doc_id", "node", "size", "bitmap", "whole")
    nodes = stored(rows.filter("whole").groupBy("node").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("bitmap").alias("bitmap")))
    part = components(links(sets, nodes, _frequency_classes(sets)))
    named = nodes.select("node").join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return rows.select("doc_id", "node", F.col("size").cast("long").alias("n_shingles")).join(named, "node", "left")


def near_copies(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id.

    Documents of equal sets are one node, whose id is a digest of the set. Null and empty texts
    and texts without words have no shingles and link with nothing. Texts are read whole
    whatever their length. Rows of one doc_id are rows of their own, with equal component_id if
    their texts link. Rows without doc_id link as others do; a component of such rows alone has
    no component_id. Columns other than doc_id and text are not read. An empty table gives an
    empty table.
    """
    out = _rows_in_components(pick(docs, "doc_id", "text"))
    # A component's id is the least doc_id of its rows.
    ids = out.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").cast("long").alias("component_id"))
    return out.join(ids, "component", "left").select("doc_id", "n_shingles", F.coalesce("component_id", F.when(F.col("component").isNull(), F.col("doc_id").cast("long"))).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, the one of the least doc_id, with the columns it had.

    Rows without words link with nothing and all stay. Where rows of different texts share a
    doc_id, or have none, each text is judged by itself: one that is no near copy stays. Of rows
    equal in doc_id and set one stays, whichever; of a component without any doc_id one row stays.
    Columns of any name may ride along. An empty table gives an empty table.
    """
    held = docs.columns
    at = {n: held.index(n) if n in held else [c.lower() for c in held].index(n) for n in ("doc_id", "text")}
    key = f"_c{at['doc_id']}"
    plain = docs.toDF(*[f"_c{i}" for i in range(len(held))])
    rows = stored(_rows_in_components(pick(docs, "doc_id", "text")))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")
    best = rows.filter("component IS NOT NULL").groupBy("component").agg(F.min(order).alias("best"))
    # Ids that are there once are kept or dropped by id alone; the texts of others are looked at again.
    unsure = stored(rows.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select("doc_id"))
    gone = rows.filter("component IS NOT NULL").join(best, "component").filter((F.col("doc_id") != F.col("best.doc_id")) | F.col("best.doc_id").isNull()).select("doc_id")
    by_id = stored(gone.unionByName(unsure).filter("doc_id IS NOT NULL").distinct()).withColumnRenamed("doc_id", key)
    hint = F.broadcast if by_id.count() <= BROADCAST_IDS else (lambda df: df)
    sure = plain.join(hint(by_id), key, "left_anti").filter(F.col(key).isNotNull())
    if unsure.isEmpty():
        return sure.toDF(*held)

    @F.pandas_udf("long")
    def node_of(texts: pd.Series) -> pd.Series:
        return pd.Series([_digest(s) if len(s := shingles(t)) else None for t in texts], dtype="Int64")

    again = unsure.filter("doc_id IS NOT NULL").withColumnRenamed("doc_id", key)
    small = F.broadcast if unsure.count() <= BROADCAST_IDS else (lambda df: df)
    looked = plain.join(small(again), key, "left_semi").unionByName(plain.filter(F.col(key).isNull())).withColumn("_node", node_of(f"_c{at['text']}"))
    winners = best.select(F.col("best.doc_id").alias("_id"), F.col("best.node").alias("_of"))
    won = looked.filter("_node IS NOT NULL").join(winners, (F.col("_node") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_id")), "left_semi")
    won = won.dropDuplicates([key, "_node"])
    return sure.unionByName(won.drop("_node")).unionByName(looked.filter("_node IS NULL").drop("_node")).toDF(*held)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


_W = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
SQL = {
    "op7_jaccard_join": rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce({_W}, []) AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM docs
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared WHERE 100 * k >= 75 * (na + nb - k)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(b) FROM reach r WHERE r.a = s.doc_id)::BIGINT AS component_id FROM sets s"""
}
