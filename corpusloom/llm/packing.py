"""Packing documents into token sequences: best fit by hierarchical residual packing."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.words import worker_cache
from corpusloom.session import pick, stored, table

CAPACITY = 2048
END_ID = 0
CACHE_WORDS = 800_000  # distinct words whose ids a worker holds before it starts anew
# Letters of the Latin blocks, then plain marks: neither an apostrophe nor a character that changes under NFC.
SIMPLE = re.compile("([A-Za-z\u00df-\u00f6\u00f8-\u00ff\u00c0-\u00d6\u00d8-\u00de]+)([!-&(-/:-@\\[-`{-~]*)\\Z")
GAPS = re.compile(r"[\x20\x09-\x0D]+")
ODD = re.compile("[\x1c-\x1f]")

PIECES_PER_GROUP = 50_000  # items that one task packs
FAN_IN = 8  # groups that one group of the next round takes over, where their underfull bins are few enough
NEARLY_FULL = 0.995  # bins filled so far are emitted
STILL_MERGES = 0.95  # rounds end when one leaves more than this share of its items as underfull bins


class WordEncoder:
    """Token ids of texts as bytes, word by word.

    The tokenizer drops white space and never merges across it, so a text's ids are those of
    its words in order. A word new to the cache is taken apart once more, into runs of letters
    and of marks, which the tokenizer also keeps apart; the tokenizer itself encodes the runs.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters = "".join(map(chr, [*range(0x21, 0x7F), *range(0xC0, 0x100)])).lower()
        self.spelled = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters if c not in "×÷"}
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def _encode(self, parts: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False):
            yield np.array(e.ids, "<u4").tobytes()

    def _learn(self, missing: list[str]) -> None:
        if len(self.words) + len(missing) > CACHE_WORDS:
            self.words.clear()
        if len(self.runs) > CACHE_WORDS:
            self.runs.clear()
        split = {w: (m.groups() if (m := SIMPLE.match(w)) else None) for w in missing}
        new = {r.lower() for parts in split.values() if parts for r in parts if r}
        new = [r for r in new if r not in self.runs]
        for r in new:  # as the tokenizer would: bytes spelled as its vocabulary spells them, then its merges
            self.runs[r] = np.array([t.id for t in self.model.tokenize(r.translate(self.spelled))], "<u4").tobytes()
        odd = [w for w, parts in split.items() if not parts]
        self.words.update(zip(odd, self._encode(odd), strict=True))
        for w, parts in split.items():
            if parts:
                self.words[w] = b"".join([self.runs[r.lower()] for r in parts if r])

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        words = [w for w in GAPS.split(text) if w] if ODD.search(text) else text.split()
        found = list(map(self.words.get, words))
        if None in found:
            missing = list(dict.fromkeys(w for w, f in zip(words, found, strict=True) if f is None))
            known = {w: f for w, f in zip(words, found, strict=True) if f is not None} if len(self.words) + len(missing) > CACHE_WORDS else {}
            self._learn(missing)
            found = [self.words.get(w) or known[w] if known else self.words[w] for w in words]
        return b"".join(found)


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of a tokenizer file that a Python worker keeps from task to task, with the words it has learned."""
    cache = worker_cache("packing")
    if path not in cache:
        cache[path] = WordEncoder(path)
    return cache[path]


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Documents as pieces: doc_id, piece, start, length, ids_crc32.

    A document is its ids, then END_ID; one longer than capacity is cut into pieces of capacity,
    the last may be shorter. Null and empty texts are END_ID alone. Texts are read whole whatever
    their length. Repeated rows and rows without doc_id are cut each; columns other than doc_id
    and text are not read. An empty table gives an empty table.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = worker_encoder(tokenizer_path)
        end = np.array([END_ID], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch["text"]):
                ids = (encoder.ids(text) if text else b"") + end
                for k, b in enumerate(range(0, len(ids), step)):
                    part = ids[b : b + step]
                    at.append(i), piece.append(k), start.append(b // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[at], "piece": piece, "start": start, "length": length, "ids_crc32": crc})

    narrow = pick(docs, "doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInPandas(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: Sequence[int], capacity: int) -> list[int]:
    """Bin number of each size: the largest first, each into the fullest bin that still holds it."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has room r
    chosen, bins = [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b = capacity, bins
            bins += 1
        chosen[i] = b
        left = room - size
        if left:
            by_room[left].append(b)
            open_rooms |= 1 << left
    return chosen


def pack(items: DataFrame, capacity: int = CAPACITY, pieces_per_group: int = PIECES_PER_GROUP, fan_in: int = FAN_IN) -> DataFrame:
    """Bins of items (item long, length long): bin (string), members (array of struct<item, length>).

    Round by round, groups pack their items by best fit, emit the bins that are nearly full and
    hand the others on as items of the next round. Up to fan_in groups meet in one of the next
    round, fewer where so many underfull bins are left that a group would take over more than
    pieces_per_group. The round of one group emits all, and so does a round that hardly merged
    anything, as where every bin is over half full: no bin is given up while it may still be
    filled. Every round is written before the next reads it. Equal lengths go in any order.
    """
    member = "array<struct<item:long,length:long>>"
    schema = f"bin string, grp int, size long, done boolean, members {member}"

    def run(last: bool, round_: int):
        def packed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            sizes = group["size"].to_numpy()
            chosen = best_fit([int(x) for x in sizes], capacity)
            filled = np.bincount(chosen, weights=sizes, minlength=max(chosen) + 1).astype(np.int64)
            joined: dict[int, list] = {}
            lists = group["members"].to_numpy()
            for i in np.argsort(chosen, kind="stable"):
                joined.setdefault(chosen[i], []).extend(lists[i])
            return pd.DataFrame({
                "bin": [f"{round_}-{key[0]}-{b}" for b in range(len(filled))], "grp": int(key[0]), "size": filled,
                "done": filled >= (0 if last else NEARLY_FULL * capacity), "members": [joined[b] for b in range(len(filled))],
            })

        return packed

    left = items.count()
    groups = max(1, -(-left // pieces_per_group))
    single = F.array(F.struct(F.col("item").cast("long"), F.col("length").cast("long"))).cast(member)
    rows = items.select(F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int").alias("grp"), F.col("length").cast("long").alias("size"), single.alias("members"))
    done, round_ = None, 0
    while True:
        made = stored(rows.groupBy("grp").applyInPandas(run(groups == 1, round_), schema))
        before, left = left, made.filter("NOT done").count()
        over = left <= STILL_MERGES * before and left > 0
        ready = (made.filter("done") if over else made).select("bin", "members")
        done = ready if done is None else done.unionByName(ready)
        if not over:
            return done
        fewer = min(groups, max(1, -(-groups // fan_in), -(-left // pieces_per_group)))
        parent = F.floor(F.col("grp").cast("long") * fewer / groups).cast("int")
        rows = made.filter("NOT done").select(parent.alias("grp"), "size", "members")
        groups, round_ = fewer, round_ + 1


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every member of the batch's bins with its place in its sequence."""
    for batch in batches:
        n = [len(m) for m in batch["members"]]
        flat = [(m["item"], m["length"]) for members in batch["members"] for m in members]
        item, length = (np.array([f[k] for f in flat], np.int64) for k in (0, 1))
        ends = np.cumsum(length)
        first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        before = np.repeat(ends[first] - length[first], n) if len(flat) else ends
        yield pd.DataFrame({"sequence_id": np.repeat(batch["sequence_id"].to_numpy(), n), "item": item, "offset": ends - length - before})


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents are cut as cut() says, which also defines nulls, repeats and long texts. Full
    pieces are sequences of their own. Which of several pieces of one length goes into which
    sequence is left open. An empty table gives an empty table.
    """
    pieces = stored(cut(docs, tokenizer_path, capacity).withColumn("item", F.monotonically_increasing_id()))
    bins = pack(pieces.filter(F.col("length") < capacity).select("item", "length"), capacity)
    placed = bins.select(F.xxhash64("bin").alias("sequence_id"), "members").mapInPandas(_placed, "sequence_id long, item long, offset long")
    short = pieces.filter(F.col("length") < capacity).join(placed, "item")
    full = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": F.xxhash64(F.concat_ws("-", F.lit("full"), "item")), "offset": F.lit(0).cast("long")})
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return short.select(cols).unionByName(full.select(cols))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # No SQL: tokens are not expressible; tests decode and check every sequence.
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())
