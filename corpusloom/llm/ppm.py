"""Language-model scores: prediction by partial matching over bytes, beside a word-count base."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.words import lower_ascii, split_words
from corpusloom.session import pick, stored, table

ORDER = 5  # bytes of context; a node's key is its context and symbol, at most 48 bits
END = b"\n"  # ends every text and stands before it as context; no word holds it
SEGMENT = 1 << 20  # bytes that are worked on at once; longer texts go on with their last bytes as context
MOST_NODES = 4_000_000  # a trie of up to so many nodes is broadcast, a larger one is asked by batches of texts
MOST_WORDS = 8_000_000  # word counts up to so many words are broadcast (12 bytes each), more are asked likewise
BATCH_BYTES = 32 << 20  # of text in a batch that asks for each of its keys once
BATCHES_PER_PART = 128  # batches that one copy of a range's nodes answers, so that its questions do not grow with the corpus
TEXTS_PER_RANGE = 2_000  # training texts for each range of keys, so that a range's counts do not grow with the corpus
TASK_WORDS = 1_000_000  # distinct words a task holds before it hands them on
TASK_NODES = 4_000_000  # likewise nodes of the highest order
MASKS = [np.uint64((1 << (8 * (k + 1))) - 1) for k in range(ORDER + 1)]  # of a node's key at each order


def spelled(words: list[str]) -> bytes:
    """What the model reads of a text: its lower-cased words, a space after each, then the end."""
    return (" ".join(words) + " ").encode("utf-8", "replace") + END if words else END


def _slices(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in parts of about SEGMENT characters, so that a task's words take bounded memory."""
    ends = batch["text"].str.len().fillna(0).cumsum().to_numpy() // SEGMENT
    for part in np.unique(ends):
        yield batch[ends == part]


def _segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys (context and symbol) and the number of the text of every byte, in groups of about SEGMENT bytes."""
    pad = END * ORDER
    parts: list[bytes] = []
    owners: list[int] = []
    size = 0

    def keys() -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(parts), np.uint8)
        lengths = np.array([len(p) for p in parts])
        code = np.zeros(len(data), np.uint64)
        for back in range(ORDER + 1):
            code[back:] |= data[: len(data) - back].astype(np.uint64) << np.uint64(8 * back)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        real = np.ones(len(data), bool)
        for k in range(ORDER):
            real[starts + k] = False
        return code[real], np.repeat(np.array(owners), lengths - ORDER)

    for i, text in enumerate(texts):
        whole = pad + text
        for at in range(ORDER, len(whole), SEGMENT):
            parts.append(whole[at - ORDER : at + SEGMENT])
            owners.append(i)
            size += len(parts[-1])
            if size >= SEGMENT or len(parts) >= 60_000:
                yield keys()
                parts, owners, size = [], [], 0
    if parts:
        yield keys()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.concatenate([first, [len(keys)]])).astype(np.int64)


def _by_range(at: np.ndarray, **arrays: np.ndarray) -> pd.DataFrame:
    """Arrays as one row a range, which `at` tells for each place, in their order."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    bounds = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, int)
    ends = [*bounds[1:], len(at)][: len(bounds)]
    dealt = {name: a[order] for name, a in arrays.items()}
    return pd.DataFrame({"at": at[bounds].astype(np.int32)} | {name: [a[i:j].tobytes() for i, j in zip(bounds, ends, strict=True)] for name, a in dealt.items()})


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))


def _ranges(two: np.ndarray, ranges: int) -> np.ndarray:
    """Ranges of two bytes each."""
    return (((two * np.uint64(40503)) & np.uint64(0xFFFF)) % np.uint64(ranges)).astype(np.int64)


def _word_ranges(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return (hashes % np.uint64(ranges)).astype(np.int64)


def gather(docs: DataFrame, ranges: int) -> DataFrame:
    """Counts from all training texts, merged by key range and written.

    kind 'ppm': trie nodes of the highest order, dealt by their last two bytes, so that the
    sums of every lower order but the last lie in one range. kind 'word': word hashes.
    kind 'text': the number of texts. Each task sums what it reads before it sends.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes: list[tuple[np.ndarray, np.ndarray]] = []
        words: Counter[str] = Counter()
        n_texts = 0

        def word_rows() -> pd.DataFrame:
            hashes = np.fromiter((word_hash(w) for w in words), np.uint64, len(words))
            counts = np.fromiter(words.values(), np.int64, len(words))
            return _by_range(_word_ranges(hashes, ranges), keys=hashes, counts=counts).assign(kind="word")

        def node_rows(nodes: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
            keys, counts = _summed(np.concatenate([k for k, _ in nodes]), np.concatenate([c for _, c in nodes]))
            return _by_range(_ranges(keys & MASKS[1], ranges), keys=keys, counts=counts).assign(kind="ppm")

        for batch in (part for whole in batches for part in _slices(whole)):
            texts = []
            for text in batch["text"]:
                split = split_words(lower_ascii(text)) if text else []
                words.update(split)
                texts.append(spelled(split))
            n_texts += len(texts)
            for keys, _ in _segments(texts):
                nodes.append(_counted(keys))
                if sum(len(k) for k, _ in nodes) > TASK_NODES:
                    nodes = [_summed(np.concatenate([k for k, _ in nodes]), np.concatenate([c for _, c in nodes]))]
                    if len(nodes[0][0]) > TASK_NODES // 2:
                        yield node_rows(nodes)
                        nodes = []
            if len(words) > TASK_WORDS:
                yield word_rows()
                words.clear()
        if words:
            yield word_rows()
        if nodes:
            yield node_rows(nodes)
        if n_texts:
            yield pd.DataFrame({"kind": ["text"], "at": np.zeros(1, np.int32), "keys": [np.zeros(1, np.uint64).tobytes()], "counts": [np.array([n_texts]).tobytes()]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _summed(*(np.concatenate([np.frombuffer(b, t) for b in group[c]]) for c, t in (("keys", np.uint64), ("counts", np.int64))))
        kind, at = group["kind"].iloc[0], group["at"].iloc[0]
        rows = [(0, keys, counts)]
        if kind == "ppm":
            rows = [(ORDER, keys, counts)]
            for k in range(ORDER - 1, 0, -1):
                rows.append((k, *_summed(rows[-1][1] & MASKS[k], rows[-1][2])))
            rows.append((0, *_summed(rows[-1][1] & MASKS[0], rows[-1][2])))
        # How many keys have a count of 1, 2-3, 4-7, ...: for the least count to keep.
        spread = [np.bincount(np.log2(c).astype(int), minlength=64).tolist() if len(c) else [0] * 64 for _, _, c in rows]
        return pd.DataFrame({
            "kind": kind, "at": at, "level": [k for k, _, _ in rows], "keys": [k.tobytes() for _, k, _ in rows], "counts": [c.tobytes() for _, _, c in rows],
            "n": [len(k) for _, k, _ in rows], "total": [int(c.sum()) for _, _, c in rows], "spread": spread,
        })

    sent = docs.select("text").mapInPandas(count, "kind string, at int, keys binary, counts binary")
    return stored(sent.groupBy("kind", "at").applyInPandas(merge, "kind string, at int, level int, keys binary, counts binary, n long, total long, spread array<long>"))


@dataclass
class Trie:
    """Nodes by order: sorted keys and counts, and for every context its sums.

    Escape: a context with n counts of d symbols leaves d / (n + d) to symbols it has not
    seen. Exclusion: after an escape the symbols of the longer context no longer count in the
    shorter one. As a context's symbols are among those of its suffix, what is excluded there
    is one sum per longer context, `excluded`, taken when the model is built.
    """

    keys: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    n: list[np.ndarray]
    d: list[np.ndarray]
    excluded: list[np.ndarray]

    @staticmethod
    def build(levels: list[tuple[np.ndarray, np.ndarray]]) -> Trie:
        out = Trie([], [], [], [], [], [])
        for k, (keys, counts) in enumerate(levels):
            contexts = keys >> np.uint64(8)
            first = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(keys) else np.zeros(0, np.int64)
            out.keys.append(keys), out.counts.append(counts), out.contexts.append(contexts[first])
            out.n.append(np.add.reduceat(counts, first) if len(first) else counts[:0])
            out.d.append(np.diff(np.concatenate([first, [len(keys)]])).astype(np.int64))
            if k and len(keys):
                shorter = counts_of(out.keys[k - 1], out.counts[k - 1], keys & MASKS[k - 1])
                out.excluded.append(np.add.reduceat(shorter, first))
            else:
                out.excluded.append(np.zeros(len(first), np.int64))
        return out

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each key's symbol after its context."""
        out = np.zeros(len(codes))
        open_ = np.arange(len(codes))
        gone_n = np.zeros(len(codes), np.int64)  # excluded counts and symbols at the level at hand
        gone_d = np.zeros(len(codes), np.int64)
        for k in range(ORDER, -1, -1):
            if not len(open_) or not len(self.keys[k]):
                continue
            code = codes[open_] & MASKS[k]
            context = code >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            seen = self.contexts[k][at] == context
            place = np.minimum(np.searchsorted(self.keys[k], code), len(self.keys[k]) - 1)
            hit = self.keys[k][place] == code
            n, d = self.n[k][at] - gone_n[open_], self.d[k][at] - gone_d[open_]
            out[open_[hit]] += np.log10(self.counts[k][place[hit]] / (n[hit] + d[hit]))
            escape = seen & ~hit & (d > 0)
            out[open_[escape]] += np.log10(d[escape] / (n[escape] + d[escape]))
            gone_n[open_[seen]], gone_d[open_[seen]] = self.excluded[k][at[seen]], self.d[k][at[seen]]
            open_ = open_[~hit]
        if len(open_):
            out[open_] -= np.log10(256 - (len(self.keys[0]) if len(self.keys[0]) else 0))
        return out


def counts_of(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Counts of wanted keys in sorted keys, 0 where absent."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, counts[at], 0)


def _array(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(blob, dtype)


def trie(gathered: DataFrame, most_nodes: int = MOST_NODES) -> Trie:
    """The trie of at most most_nodes nodes (or those of counts over half the largest): it alone comes to the driver.

    score_documents builds it only where all nodes are within most_nodes, so that none is left out.
    """
    nodes = gathered.filter("kind = 'ppm'")
    spread = np.zeros(64, np.int64)
    for row in nodes.groupBy("level", F.col("at") % 64).agg(*[F.sum(F.col("spread")[i]).alias(f"s{i}") for i in range(64)]).collect():
        spread += np.array(row[2:])
    least = 1
    while spread[int(np.log2(least)) :].sum() > most_nodes and least < 1 << 62:
        least *= 2

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for level, keys, counts in zip(batch["level"], batch["keys"], batch["counts"], strict=True):
                keys, counts = _array(keys, np.uint64), _array(counts, np.int64)
                held = counts >= (least if level else 1)
                yield pd.DataFrame({"level": [level], "keys": [keys[held].tobytes()], "counts": [counts[held].tobytes()]})

    found: list[list] = [[] for _ in range(ORDER + 1)]
    for row in nodes.select("level", "keys", "counts").mapInPandas(keep, "level int, keys binary, counts binary").toLocalIterator():
        found[row["level"]].append((_array(bytes(row["keys"]), np.uint64), _array(bytes(row["counts"]), np.int64)))
    empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return Trie.build([_summed(np.concatenate([k for k, _ in f]), np.concatenate([c for _, c in f])) if f else empty for f in found])


def in_training() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 1, F.lit(True))


def score_documents(docs: DataFrame, most_nodes: int = MOST_NODES, most_words: int = MOST_WORDS) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    score: log10 probability of what spelled() makes of the text, under the trie of all nodes of
    the training texts. base_score: of its tokens under the training texts' smoothed counts; the
    end is a token. Over most_nodes or most_words batches of texts ask for what their keys are
    worth, with the same scores. Null and empty texts are the end alone; texts are read whole,
    long ones in segments. Rows without doc_id are training texts. Repeated rows count and are
    scored each. Without training texts every byte has probability 1/256 and every count is 0.
    Columns other than doc_id and text are not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    texts = pick(docs, "doc_id", "text")
    size = texts.agg(F.count_if(in_training()).alias("training"), F.sum(F.octet_length("text")).alias("bytes")).first()
    ranges = min(1 << 16, max(32, int(spark.conf.get("spark.sql.shuffle.partitions")), size["training"] // TEXTS_PER_RANGE))
    gathered = gather(texts.filter(in_training()), ranges)
    sums = {r["kind"]: r for r in gathered.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    n_texts = sums["text"]["total"] if "text" in sums else 0
    n_words = sums["word"]["n"] if "word" in sums else 0
    n_tokens = n_texts + (sums["word"]["total"] if "word" in sums else 0)
    bottom = n_tokens + 0.5 * (n_words + (n_texts > 0) + 1)
    n_nodes = sums["ppm"]["n"] if "ppm" in sums else 0
    model = trie(gathered, most_nodes) if n_nodes <= most_nodes else None
    if n_words <= most_words:
        rows = gathered.filter("kind = 'word'").select("keys", "counts").toLocalIterator()
        parts = [(_array(bytes(r["keys"]), np.uint64), _array(bytes(r["counts"]), np.int64).astype(np.uint32 if n_tokens < 1 << 32 else np.int64)) for r in rows]
        keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        vocabulary = (keys[order], np.concatenate([c for _, c in parts])[order] if parts else np.zeros(0, np.int64))
        del parts, keys, order
    else:
        vocabulary = None
    shared = spark.sparkContext.broadcast((model, vocabulary))
    unknown, end = float(np.log10(0.5 / bottom)), float(np.log10((n_texts + 0.5) / bottom))

    def scored(batch: pd.DataFrame, worth_of: Callable[[np.ndarray], np.ndarray], count_of: Callable[[np.ndarray], np.ndarray]) -> pd.DataFrame:
        split = [split_words(lower_ascii(t)) if t else [] for t in batch["text"]]
        total = np.zeros(len(split))
        for low, packed in _packed(split):
            keys, times = _counted(packed >> np.uint64(16))
            value = np.repeat(worth_of(keys), times)
            part = np.bincount((packed & np.uint64(0xFFFF)).astype(np.int64), weights=value)
            total[low : low + len(part)] += part
        distinct, hashes = _distinct(split)
        c = count_of(hashes)
        worth = dict(zip(distinct, np.where(c > 0, np.log10((c + 0.5) / bottom), 0.0).tolist(), strict=True))
        base, known = np.full(len(split), end), np.full(len(split), int(n_texts > 0))
        for i, w in enumerate(split):
            found = np.fromiter(map(worth.__getitem__, w), np.float64, len(w))
            missing = int((found == 0.0).sum())
            base[i] += found.sum() + missing * unknown
            known[i] += len(w) - missing
        return pd.DataFrame({"doc_id": batch["doc_id"].array, "n_tokens": [len(w) + 1 for w in split], "n_known": known, "base_score": base, "score": total})

    kind = texts.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double"
    if model is not None and vocabulary is not None:

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model, vocabulary = shared.value
            for batch in (part for whole in batches for part in _slices(whole)):
                yield scored(batch, model.log10, lambda h: counts_of(*vocabulary, h))

        done = texts.mapInPandas(score, columns)
    else:
        n_batches = max(4 * spark.sparkContext.defaultParallelism, -(-(size["bytes"] or 0) // BATCH_BYTES))
        asked = [k for k, own in (("ppm", model), ("word", vocabulary)) if own is None]
        # Dealt by what a row holds, so that every pass puts it into the same batch.
        dealt = texts.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_batches)).cast("int")).repartition(n_batches, "batch")

        def score_batch(whole: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
            model, vocabulary = shared.value
            worth_of = model.log10 if model is not None else _answered(answers, "ppm")
            count_of = (lambda h: counts_of(*vocabulary, h)) if vocabulary is not None else _answered(answers, "word")
            found = [scored(batch, worth_of, count_of) for batch in _slices(whole)]
            return pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=["doc_id", "n_tokens", "n_known", "base_score", "score"])

        answers = _answers(dealt, gathered, asked, ranges, n_batches).repartition(n_batches, "batch")
        done = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(score_batch, columns)
    return done.select(
        "doc_id", (~in_training()).alias("held_out"), "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def _distinct(split: list[list[str]]) -> tuple[list[str], np.ndarray]:
    """Distinct words and their hashes."""
    words = list(set().union(*split)) if split else []
    return words, np.fromiter(map(word_hash, words), np.uint64, len(words))


def _packed(split: list[list[str]]) -> Iterator[tuple[int, np.ndarray]]:
    """Numbers of first texts and, sorted, each byte's key with its text's number after that one in one word: equal keys are looked up once."""
    for codes, owners in _segments([spelled(w) for w in split]):
        for low in range(int(owners[0]), int(owners[-1]) + 1, 1 << 16):
            here = (owners >= low) & (owners < low + (1 << 16))
            yield low, np.sort((codes[here] << np.uint64(16)) | (owners[here] - low).astype(np.uint64))


def _answers(dealt: DataFrame, gathered: DataFrame, asked: list[str], ranges: int, n_batches: int) -> DataFrame:
    """batch, kind, keys, values: what each key of a batch is worth (kind 'ppm'), how often each word hash occurs ('word').

    A batch sends each of its keys once, to the range that can answer it alone: nodes are dealt by
    the two bytes before the symbol, so that all contexts of two bytes and more lie whole in a range;
    shorter ones, 65,792 nodes at most, every range has. What is sent are a batch's distinct keys,
    no row for each of them in each text. A range answers parts of the batches apart.
    """
    spark = dealt.sparkSession
    per_part = BATCHES_PER_PART
    n_parts = -(-n_batches // per_part)

    def ask(group: pd.DataFrame) -> pd.DataFrame:
        codes, words = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        held: list[np.ndarray] = []
        for batch in _slices(group):
            split = [split_words(lower_ascii(t)) if t else [] for t in batch["text"]]
            if "ppm" in asked:
                held += [_counted(keys)[0] for keys, _ in _segments([spelled(w) for w in split])]
                if sum(map(len, held)) > TASK_NODES:
                    codes, held = np.unique(np.concatenate([codes, *held])), []
            if "word" in asked:
                words = np.union1d(words, _distinct(split)[1])
        codes = np.unique(np.concatenate([codes, *held]))
        rows = pd.concat([
            _by_range(_ranges((codes >> np.uint64(8)) & MASKS[1], ranges), keys=codes).assign(kind="ppm"),
            _by_range(_word_ranges(words, ranges), keys=words).assign(kind="word"),
        ])
        n = int(group["batch"].iloc[0])
        return rows.assign(batch=n, part=n // per_part)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kind, at, keys, counts in zip(batch["kind"], batch["at"], batch["keys"], batch["counts"], strict=True):
                if kind == "word":
                    yield pd.DataFrame({"kind": [kind], "at": [at], "keys": [keys], "counts": [counts]})
                    continue
                nodes, times = _array(keys, np.uint64), _array(counts, np.int64)
                yield _by_range(_ranges((nodes >> np.uint64(8)) & MASKS[1], ranges), keys=nodes, counts=times).assign(kind=kind)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for level, keys, counts in zip(batch["level"], batch["keys"], batch["counts"], strict=True):
                yield pd.DataFrame({"level": level, "key": _array(keys, np.uint64).astype(np.int64), "c": _array(counts, np.int64)})

    short = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2
    if "ppm" in asked:
        low = gathered.filter("kind = 'ppm' AND level < 2").select("level", "keys", "counts").mapInPandas(unpack, "level int, key long, c long")
        summed = low.groupBy("level", "key").agg(F.sum("c").alias("c")).toPandas()
        for k in (0, 1):
            rows = summed[summed["level"] == k].sort_values("key")
            short[k] = (rows["key"].to_numpy().astype(np.uint64), rows["c"].to_numpy().astype(np.int64))
    shared = spark.sparkContext.broadcast(short)

    def answer(held: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        out = {"batch": questions["batch"].to_numpy(), "kind": questions["kind"].array, "keys": questions["keys"].array}
        if not len(questions):
            return pd.DataFrame(out | {"values": []})
        keys = np.concatenate([np.zeros(0, np.uint64), *(_array(b, np.uint64) for b in held["keys"])])
        keys, counts = _summed(keys, np.concatenate([np.zeros(0, np.int64), *(_array(b, np.int64) for b in held["counts"])]))
        if questions["kind"].iloc[0] == "ppm":
            levels = [(keys, counts)]
            for k in range(ORDER - 1, 1, -1):
                levels.append(_summed(levels[-1][0] & MASKS[k], levels[-1][1]))
            value = Trie.build([*shared.value, *reversed(levels)]).log10
        else:
            value = lambda wanted: counts_of(keys, counts, wanted)
        return pd.DataFrame(out | {"values": [value(_array(b, np.uint64)).tobytes() for b in questions["keys"]]})

    names = ["kind", "at", "part"]
    top = gathered.filter((F.col("kind") == "word") | ((F.col("kind") == "ppm") & (F.col("level") == ORDER))).filter(F.col("kind").isin(asked))
    nodes = top.select("kind", "at", "keys", "counts").mapInPandas(deal, "kind string, at int, keys binary, counts binary")
    nodes = nodes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))).repartition(n_batches, *names)
    questions = dealt.groupBy("batch").applyInPandas(ask, "kind string, at int, part int, batch int, keys binary").repartition(n_batches, *names)
    return nodes.groupBy(*names).cogroup(questions.groupBy(*names)).applyInPandas(answer, "batch int, kind string, keys binary, values binary")


def _answered(answers: pd.DataFrame, kind: str) -> Callable[[np.ndarray], np.ndarray]:
    """Looks wanted keys up among a batch's answers; one that was not asked for is an error."""
    own = answers[answers["kind"] == kind]
    keys = np.concatenate([np.zeros(0, np.uint64), *(_array(b, np.uint64) for b in own["keys"])])
    dtype = np.float64 if kind == "ppm" else np.int64
    values = np.concatenate([np.zeros(0, dtype), *(_array(b, dtype) for b in own["values"])])
    order = np.argsort(keys)
    keys, values = keys[order], values[order]

    def look(wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, wanted)
        if len(wanted) and (at.max() >= len(keys) or (keys[at] != wanted).any()):
            raise ValueError("the texts differ from those that the batch asked for")
        return values[at]

    return look


def op8_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    # No SQL: the model's score is not expressible; tests compare both scores with plain Python.
    return score_documents(table(spark, sf_dir, "documents"))
