"""Benchmark decontamination by SimHash over windows of an item's size.

Every window of a document that is as long as a benchmark item gets a SimHash
of its word shingles.  A window is a candidate if its fingerprint differs from
the item's in at most ``RADIUS`` bits; blocks of the fingerprint find these
without loss, because two fingerprints within the radius agree up to
``RADIUS // BLOCKS`` bits in at least one block.  The multiset of shingles then
decides: sum of the smaller counts over sum of the larger.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.simhash import majority
from lanewise.llm.stages import staged

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCKS = 8
#: Words of benchmark items that one pass over the documents looks for.
PASS_WORDS = 2_000_000

TOKEN = re.compile(r"[^\W_]+")
ODD = np.random.default_rng(5).integers(1, 2**63, SHINGLE, np.uint64) * 2 + 1


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of the letter and digit runs of the text in lower case."""
    digest = xxhash.xxh64_intdigest
    found = [digest(w) for w in TOKEN.findall((text or "").lower())]
    return np.array(found, np.uint64)


def shingle_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` tokens."""
    n = len(tokens) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    mixed = sum(tokens[k : k + n] * ODD[k] for k in range(size))
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(31))


def weighted_similarity(a: Counter, b: Counter) -> float:
    larger = (a | b).total()
    return (a & b).total() / larger if larger else 0.0


class Item:
    def __init__(self, item_id: int, text: str | None):
        tokens = token_hashes(text)
        self.id, self.words = item_id, len(tokens)
        self.shingle = min(SHINGLE, self.words)
        hashes = shingle_hashes(tokens, self.shingle) if self.words else tokens
        self.counts = Counter(hashes.tolist())
        self.print = majority(hashes) if self.words else 0


class Blocks:
    """Items of one length, found by the blocks of their fingerprints."""

    def __init__(self, items: list[Item], radius: int, blocks: int):
        self.radius, self.width = radius, 64 // blocks
        near = [0]
        for bits in range(1, radius // blocks + 1):
            near += [sum(1 << b for b in c) for c in combinations(range(self.width), bits)]
        self.index: dict[tuple[int, int], list[Item]] = defaultdict(list)
        for item in items:
            for k, value in enumerate(self.cut(item.print)):
                for x in near:
                    self.index[k, value ^ x].append(item)

    def cut(self, value: int) -> list[int]:
        mask = (1 << self.width) - 1
        return [value >> k & mask for k in range(0, 64, self.width)]

    def within(self, value: int) -> list[Item]:
        """All items whose fingerprint is within the radius."""
        met = {id(x): x for at in enumerate(self.cut(value)) for x in self.index.get(at, ())}
        return [x for x in met.values() if (x.print ^ value).bit_count() <= self.radius]


class Searcher:
    """Finds the windows of a text that are as good as a benchmark item."""

    def __init__(self, items: list[Item], similarity: float, radius: int, blocks: int):
        items = [x for x in items if x.words]
        self.similarity = similarity
        by_words = defaultdict(list)
        for item in items:
            by_words[item.words].append(item)
        self.blocks = {n: Blocks(x, radius, blocks) for n, x in sorted(by_words.items())}
        self.known = {
            k: np.unique(np.array([h for x in items if x.shingle == k for h in x.counts], np.uint64))
            for k in sorted({x.shingle for x in items})
        }
        #: Lengths of the items that have a shingle.
        self.lengths: dict[int, set[int]] = defaultdict(set)
        for item in items:
            for h in item.counts:
                self.lengths[h].add(item.words)
        self.bits = {k: self.low_bits(known) for k, known in self.known.items()}

    @staticmethod
    def low_bits(known: np.ndarray) -> np.ndarray:
        seen = np.zeros(1 << 22, bool)
        seen[known & np.uint64(len(seen) - 1)] = True
        return seen

    def shared(self, hashes: np.ndarray, shingle: int) -> np.ndarray:
        """Which shingles of the text occur in any item."""
        seen = self.bits[shingle]
        at = np.flatnonzero(seen[hashes & np.uint64(len(seen) - 1)])
        known = self.known[shingle]
        place = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
        return at[known[place] == hashes[at]]

    def find(self, text: str | None) -> dict[int, tuple]:
        """Best window of each item found: similarity, differing bits, first word."""
        best: dict[int, tuple] = {}
        tokens = token_hashes(text)
        hashes = {k: shingle_hashes(tokens, k) for k in self.known}
        hits: dict[int, list[int]] = defaultdict(list)
        for k, found in hashes.items():
            for at in self.shared(found, k).tolist():
                for words in self.lengths[int(found[at])]:
                    if min(SHINGLE, words) == k:
                        hits[words].append(at)
        for words, at in sorted(hits.items()):
            size, blocks = min(SHINGLE, words), self.blocks[words]
            held, n = words - size + 1, len(tokens) - words + 1
            # A text shorter than the item is its own only window.
            span = min(held, len(hashes[size]))
            n = max(1, n)
            # A window as similar as asked shares so many shingles with its item;
            # the others need no fingerprint.
            least = max(1, int(np.ceil(self.similarity * held - 1e-9)))
            if len(at) < least:
                continue
            marks = np.zeros(len(hashes[size]) + 1, np.int64)
            marks[np.array(at) + 1] = 1
            marks = np.cumsum(marks)
            for s in np.flatnonzero(marks[span : span + n] - marks[:n] >= least).tolist():
                window = hashes[size][s : s + span]
                value = majority(window)
                near = blocks.within(value)
                counts = Counter(window.tolist()) if near else None
                for item in near:
                    alike = weighted_similarity(counts, item.counts)
                    if alike >= self.similarity:
                        place = (alike, -(item.print ^ value).bit_count(), -s)
                        best[item.id] = max(best.get(item.id, place), place)
        return best


def leaks(
    docs: DataFrame,
    items: DataFrame,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    blocks: int = BLOCKS,
    pass_words: int = PASS_WORDS,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    into: str = "leaks",
) -> DataFrame:
    """Add an array column of the benchmark items a text holds.

    Its elements are ``item_id, similarity, bits, first_word``, one for each
    item, for the best window of that item (ties: fewer differing bits, then
    the earlier).  Words are runs of letters and digits in lower case; shingles
    have five words, or all words of a shorter item.

    The documents are never shuffled.  The items reach the tasks in blocks of at
    most about ``pass_words`` words, one pass over the documents for each block,
    so that a benchmark of any size fits.

    Windows have as many words as the item; a text with fewer words is one window
    as a whole.

    Nulls: a null or empty text holds no item, and an item without words is held
    by no text; items with a null id count and are reported as null.  Items with
    equal text are each reported, an id that occurs twice once.  Repeated rows
    get the same result.  An empty table of documents gives an empty table, one
    of items empty arrays.  Other columns pass through; only a column named as
    ``into`` is replaced.
    """
    spark = docs.sparkSession
    kind = "array<struct<item_id bigint, similarity double, bits int, first_word bigint>>"
    rows = items.select(
        F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")
    )
    words = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    passes = max(1, -(-words // (4 * pass_words)))
    found = docs.withColumn(into, F.array().cast(kind))
    for k in range(passes):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        sent = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])
        search = F.pandas_udf(searched(sent, similarity, radius, blocks), kind)
        found = found.withColumn(into, F.concat(into, search(F.col(text))))
        if passes > 1:
            found = staged(found, "leaks")
    return found


def searched(sent, similarity: float, radius: int, blocks: int):
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        searcher = Searcher([Item(*x) for x in sent.value], similarity, radius, blocks)
        for texts in batches:
            yield pd.Series([[leak(*x) for x in searcher.find(t).items()] for t in texts])

    return search


def leak(item_id: int, place: tuple) -> dict:
    alike, bits, word = place
    return {"item_id": item_id, "similarity": alike, "bits": -bits, "first_word": -word}
