"""Scoring texts by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``ORDER`` long with the counts of
the bytes that follow.  A byte is coded in the longest context known; if it
never followed there, an escape is coded and the next shorter context tried,
without the bytes the longer one would have coded (exclusion).  The escape of a
context has the weight of its distinct followers, a byte that of its count.

The trie lives in tables, one level each, never in one task.  Documents meet it
by chunks of bounded size: a chunk asks for its distinct byte strings and words
and gets back their values.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.stages import staged

#: Bytes of context; at most 6, so that a context and a byte fit a long.
ORDER = 5
#: UTF-8 has neither of these bytes: the end of a text, and what precedes it.
END, BEFORE = 0xFE, 0xFF
SYMBOLS = 256
#: Bytes of text in a chunk, about.
CHUNK_BYTES = 32 << 20
#: Bytes of text worked on at a time within a chunk.
PART_BYTES = 2 << 20
END_TOKEN = b"\n"  # no word holds white space
#: Kinds of rows that a chunk is made of, in this order.
TOKEN, STRING, DOCUMENT = 0, 1, 2


# --- Texts as tokens and byte strings ----------------------------------------


def lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()


def tokens(raw: bytes) -> list[bytes]:
    """Words and the end of the text."""
    return [*raw.split(), END_TOKEN]


def token_keys(raw: bytes) -> np.ndarray:
    """A 64-bit hash for each token."""
    words = tokens(raw)
    keys = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return keys.view(np.int64)


def byte_strings(texts: list[bytes], order: int) -> np.ndarray:
    """For every byte of every text, and its end, the context and the byte."""
    lead = bytes([BEFORE]) * order
    joined = b"".join(x for t in texts for x in (lead, t, bytes([END])))
    raw = np.frombuffer(joined, np.uint8).astype(np.int64)
    n = len(raw) - order
    key = np.zeros(n, np.int64)
    for k in range(order + 1):
        key = (key << 8) | raw[k : k + n]
    own = np.ones(len(raw), bool)
    at = 0
    for t in texts:
        own[at : at + order] = False
        at += order + len(t) + 1
    return key[own[order:]]


def parts(sizes: list[int]) -> Iterator[slice]:
    """Slices of texts of these sizes: of bounded size, one text at least."""
    start, size = 0, 0
    for k, n in enumerate(sizes):
        size += n
        if size >= PART_BYTES:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their counts."""
    found = pc.value_counts(pa.array(keys))
    return found.field("values").to_numpy(), found.field("counts").to_numpy()


def summed(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, in order, and their counts over all parts."""
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    values, place = np.unique(np.concatenate([v for v, _ in counts]), return_inverse=True)
    total = np.bincount(place, np.concatenate([n for _, n in counts]), len(values))
    return values, total.astype(np.int64)


class Counts:
    """Distinct keys of one kind in a chunk, and their counts in training texts."""

    #: Entries waiting to be summed up, at most.
    WAITING = 1_000_000

    def __init__(self):
        self.kept = summed([])
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, held: bool) -> None:
        values, counts = distinct(keys)
        self.waiting.append((values, np.zeros_like(counts) if held else counts))
        if sum(len(v) for v, _ in self.waiting) > self.WAITING:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        self.kept, self.waiting = summed([self.kept, *self.waiting]), []
        return self.kept


def by_chunk(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """Runs of rows of one chunk; a chunk may come in several runs, one after the other."""
    for batch in batches:
        for chunk, rows in batch.groupby("chunk", sort=False):
            yield int(chunk), rows


def chunk_counts(order: int):
    """What occurs in a chunk, and how often in its training texts.

    Rows come sorted by chunk, a batch at a time; only sums are held.
    """

    def frames(chunk: int, counts: dict[int, Counts]) -> Iterator[pd.DataFrame]:
        for kind, found in counts.items():
            keys, n = found.total()
            for k in range(0, len(keys), 100_000):
                part = slice(k, k + 100_000)
                yield pd.DataFrame(
                    {"chunk": chunk, "kind": kind, "key": keys[part], "n": n[part]}
                )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, counts = None, {}
        for chunk, rows in by_chunk(batches):
            if chunk != at:
                yield from frames(at, counts)
                at, counts = chunk, {TOKEN: Counts(), STRING: Counts()}
            for held, group in rows.groupby("held_out"):
                for s in parts([len(t or "") for t in group["text"]]):
                    raw = [lowered(t) for t in group["text"].iloc[s]]
                    counts[TOKEN].add(np.concatenate(list(map(token_keys, raw))), held)
                    counts[STRING].add(byte_strings(raw, order), held)
        yield from frames(at, counts)

    return count


# --- The trie ----------------------------------------------------------------


def low(key: Column, size: int) -> Column:
    """The last ``size`` bytes of a key."""
    return key.bitwiseAND(F.lit((1 << 8 * size) - 1))


def trie_level(strings: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Strings of ``size`` bytes with counts, and contexts with their totals."""
    level = strings.groupBy(low(F.col("key"), size).alias("key")).agg(F.sum("n").alias("n"))
    level = staged(level, "level")
    context = F.shiftrightunsigned("key", 8)
    totals = level.groupBy(context.alias("context")).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct")
    )
    return level, totals


def code_lengths(strings: DataFrame, order: int = ORDER) -> DataFrame:
    """``key, value``: log10 probability of the last byte after the others.

    ``strings`` has every string of ``order + 1`` bytes to be scored with its
    count ``n`` in the training texts, 0 if it never occurs there.
    """
    trained = strings.where("n > 0").select("key", "n")
    levels = [trie_level(trained, size) for size in range(1, order + 2)]
    contexts = []
    for k, (level, totals) in enumerate(levels):
        if k == 0:
            contexts.append(staged(totals.withColumn("known_below", F.lit(0)), "contexts"))
            continue
        # What the followers of a context weigh in the next shorter one.
        below = levels[k - 1][0].select(F.col("key").alias("tail"), F.col("n").alias("m"))
        known = level.select(F.shiftrightunsigned("key", 8).alias("context"), low(F.col("key"), k).alias("tail"))
        known = known.join(below, "tail").groupBy("context").agg(F.sum("m").alias("known_below"))
        contexts.append(staged(totals.join(known, "context"), "contexts"))
    walk = strings.select(
        "key",
        F.lit(0.0).alias("value"),
        F.lit(None).cast("bigint").alias("upper_distinct"),
        F.lit(None).cast("bigint").alias("upper_known"),
    )
    done = None
    for k in range(order, -1, -1):
        level = levels[k][0].select(F.col("key").alias("tail"), F.col("n").alias("count"))
        here = walk.withColumn("tail", low(F.col("key"), k + 1))
        here = here.withColumn("context", F.shiftrightunsigned("tail", 8))
        here = here.join(level, "tail", "left").join(contexts[k], "context", "left")
        fresh = F.col("distinct") - F.coalesce("upper_distinct", F.lit(0))
        weight = F.col("total") - F.coalesce("upper_known", F.lit(0)) + fresh
        here = here.withColumn("fresh", fresh).withColumn("weight", weight)
        hit = F.col("count").isNotNull()
        coded = here.where(hit).select(
            "key", (F.col("value") + F.log10(F.col("count") / F.col("weight"))).alias("value")
        )
        done = coded if done is None else done.union(coded)
        escape = F.when(F.col("weight") > 0, F.log10(F.col("fresh") / F.col("weight")))
        left = here.where(~hit).select(
            "key",
            (F.col("value") + F.coalesce(escape, F.lit(0.0))).alias("value"),
            F.col("distinct").alias("upper_distinct"),
            F.col("known_below").alias("upper_known"),
        )
        walk = staged(left, "escaped")
    # Bytes that no training text has share what is left of the alphabet.
    seen = contexts[0].agg(F.coalesce(F.sum("distinct"), F.lit(0))).scalar()
    rest = walk.select(
        "key", (F.col("value") - F.log10(F.lit(SYMBOLS) - seen)).alias("value")
    )
    return done.union(rest)


# --- Scores ------------------------------------------------------------------


class Values:
    """Values of one kind by key, collected batch by batch."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.found: list[np.ndarray] = []
        self.index: pd.Index | None = None

    def add(self, keys: pd.Series, values: pd.Series) -> None:
        # Copies: a view would keep the whole batch.
        self.keys.append(keys.to_numpy(copy=True))
        self.found.append(values.to_numpy(copy=True))

    def of(self, keys: np.ndarray) -> np.ndarray:
        if self.index is None:
            self.index = pd.Index(np.concatenate(self.keys).astype(np.int64))
            self.values, self.keys = np.concatenate(self.found), []
            self.found = []
        place = self.index.get_indexer(keys)
        if len(place) and place.min() < 0:
            raise KeyError("a key of the chunk has no value")
        return self.values[place]


def chunk_scores(order: int, n: int, v: int):
    """Scores of the documents of a chunk from the values it asked for.

    In each chunk the values come first, the documents after them; of these one
    batch is held at a time.
    """
    least = math.log10(n + 0.1 * (v + 1))

    def scored(docs: pd.DataFrame, values: dict[int, Values]) -> Iterator[pd.DataFrame]:
        for s in parts([len(t or "") for t in docs["text"]]):
            some = docs.iloc[s]
            raw = [lowered(t) for t in some["text"]]
            keys = list(map(token_keys, raw))
            size = np.array(list(map(len, keys)))
            c = values[TOKEN].of(np.concatenate(keys))
            logs = values[STRING].of(byte_strings(raw, order))
            yield pd.DataFrame(
                {
                    "id": some["id"].astype("Int64").where(some["named"]),
                    "held_out": some["held_out"],
                    "n_tokens": size,
                    "n_known": sums_by((c > 0).astype(np.int64), size),
                    "train_tokens": n,
                    "base_score": sums_by(np.log10(c + 0.1), size) - size * least,
                    "score": sums_by(logs, np.array([len(t) + 1 for t in raw])),
                }
            )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, values = None, {}
        for chunk, rows in by_chunk(batches):
            if chunk != at:
                at, values = chunk, {TOKEN: Values(), STRING: Values()}
            for kind, found in values.items():
                own = rows[rows["kind"] == kind]
                if len(own):
                    found.add(own["key"], own["value"])
            docs = rows[rows["kind"] == DOCUMENT]
            if len(docs):
                yield from scored(docs, values)

    return score


def sums_by(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of these sizes, none of them empty."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes)


SCORE_ROW = (
    "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double"
)


def ppm_scores(
    docs: DataFrame,
    held_out: Column,
    order: int = ORDER,
    doc_id: str = "doc_id",
    text: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Scores of all rows under a model of those that are not ``held_out``.

    Returns ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``:
    ``base_score`` is that of smoothed word counts, ``score`` the log10
    probability of the bytes of the text and its end.  Both take A-Z in lower
    case.  Words are known by 64 bits of their hash.

    Documents fall into chunks of about ``chunk_bytes`` by a hash of id and
    text.  A chunk sends its distinct strings and words with their counts; sums
    over the chunks give the model; the values go back to the chunks that asked,
    whose numbers travel with each sum.

    Nulls: a null text is empty, so its end is all there is to score; a null
    ``held_out`` counts as held out; a null id is returned as null.  Repeated
    rows are scored, and learned from, one by one.  Without training texts all
    symbols are equally likely.  An empty table gives an empty table.  Other
    columns are not read.
    """
    own = docs.select(
        F.col(doc_id).cast("long").alias("id"),
        F.col(text).alias("text"),
        F.coalesce(held_out, F.lit(True)).alias("held_out"),
    )
    size = own.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    chunks = max(1, -(-size // chunk_bytes))
    own = own.withColumn(
        "chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int")
    )
    kinds = "chunk int, kind int, key bigint, n bigint"
    # A partition for each chunk: hashed numbers would meet in some and miss others.
    grouped = own.repartitionById(chunks, "chunk")
    counts = grouped.select("chunk", "held_out", "text").mapInPandas(chunk_counts(order), kinds)
    # A key has one row for each chunk at most, so nothing combines before the
    # shuffle; plain rows are smaller than partial sets.
    counts = counts.repartition("kind", "key")
    sums = counts.groupBy("kind", "key").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_set("chunk")).alias("chunks")
    )
    sums = staged(sums, "sums")
    words = sums.where(F.col("kind") == TOKEN)
    total = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")
    ).first()
    strings = sums.where(F.col("kind") == STRING)
    logs = staged(code_lengths(strings.select("key", "n"), order), "logs")
    values = words.select("chunks", "kind", "key", F.col("n").cast("double").alias("value"))
    values = values.union(strings.join(logs, "key").select("chunks", "kind", "key", "value"))
    asked = values.select(
        F.explode("chunks").alias("chunk"),
        "kind",
        "key",
        "value",
        F.lit(0).cast("long").alias("id"),
        F.lit(False).alias("named"),
        F.lit(False).alias("held_out"),
        F.lit(None).cast("string").alias("text"),
    )
    # No nulls among the numbers: pandas would make floats of them.
    docs = own.select(
        "chunk",
        F.lit(DOCUMENT).alias("kind"),
        F.lit(0).cast("long").alias("key"),
        F.lit(0.0).alias("value"),
        F.coalesce("id", F.lit(0)).alias("id"),
        F.col("id").isNotNull().alias("named"),
        "held_out",
        "text",
    )
    both = asked.union(docs).repartitionById(chunks, "chunk")
    both = both.sortWithinPartitions("kind")
    return both.mapInPandas(chunk_scores(order, total["n"], total["v"]), SCORE_ROW)


# --- A model of the text itself ----------------------------------------------


def adaptive_log10(raw: bytes, order: int = ORDER) -> float:
    """log10 probability of a text whose model learns from the text as it goes."""
    follow: dict[bytes, dict[int, int]] = defaultdict(dict)
    total, done = 0.0, bytes([BEFORE]) * order
    for symbol in [*raw, END]:
        excluded: set[int] = set()
        for k in range(order, -1, -1):
            seen = follow.get(done[len(done) - k :], {})
            fresh = {s: n for s, n in seen.items() if s not in excluded}
            if symbol in fresh:
                total += math.log10(fresh[symbol] / (sum(fresh.values()) + len(fresh)))
                break
            if fresh:
                total += math.log10(len(fresh) / (sum(fresh.values()) + len(fresh)))
            excluded |= seen.keys()
        else:
            total -= math.log10(SYMBOLS - len(excluded))
        for k in range(order + 1):
            of = follow[done[len(done) - k :]]
            of[symbol] = of.get(symbol, 0) + 1
        done = done[1:] + bytes([symbol])
    return total


def adaptive_score(text: Column, order: int = ORDER) -> Column:
    """Adaptive log10 probability of a text column; a null text is empty."""

    def batch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([adaptive_log10(lowered(t), order) for t in texts], dtype=float)

    return F.pandas_udf(batch, "double")(text)
