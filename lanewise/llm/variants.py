"""Spelling variants: words one edit apart, found by pairs of trie nodes.

All words go into two tries, one read forwards and one read backwards, and the
nodes of both are numbered.  A word cut at position ``i`` is then the pair
(node of the prefix before ``i``, backward node of the suffix from ``i``), and
a word whose letter ``i`` is skipped is the pair (node before ``i``, backward
node from ``i + 1``).  Two words that differ by one replaced letter share a
skipped pair; a word less one letter has a cut pair that is a skipped pair of
the longer word.  Numbers stand for the strings exactly, so equal pairs are
exact neighbours and no word is ever compared with another.
"""

from __future__ import annotations

import bisect
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.components import followed
from lanewise.llm.stages import staged

#: Letters of the words that one task numbers at a time, about; a Python worker
#: holds some 100 bytes for each, and Arrow's copies.
PART_LETTERS = 250_000
#: Words a task looks at to choose where the next part begins.
SAMPLES_PER_PART = 32
#: Longest string at which one part ends and the next begins.
BOUND_LETTERS = 256
#: Node pairs that one task groups at a time, about; some 100 bytes each, too.
PAIRS_PER_SHARD = 250_000
#: Numbers of one part; parts number their nodes and words apart.
PART_BITS = 32

CUT, SKIP, SKIP_AGAIN = 0, 1, 2


def shared_letters(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


class Parts:
    """Ranges of the sorted words that are numbered apart.

    A node that two parts hold is a prefix of the bound between them, so the
    nodes of the bounds are numbered here, once for all parts, below zero.
    """

    def __init__(self, bounds: list[str]):
        self.bounds = bounds
        self.paths: list[np.ndarray] = []
        used, last = 0, ""
        for bound in bounds:
            path = -1 - used - np.arange(len(bound) + 1)
            used += len(path)
            if self.paths:
                same = shared_letters(bound, last) + 1
                path[:same] = self.paths[-1][:same]
            self.paths.append(path)
            last = bound

    def part(self, word: str) -> int:
        return bisect.bisect_right(self.bounds, word)

    def nodes(self, part: int, words: list[str]) -> list[np.ndarray]:
        """The nodes from the root to each of the sorted words of a part."""
        near = [k for k in (part - 1, part) if 0 <= k < len(self.bounds)]
        found: list[np.ndarray] = []
        path, last, used = np.zeros(0, np.int64), "", (part + 1) << PART_BITS
        for word in words:
            kept = shared_letters(word, last) + 1 if len(path) else 0
            new = len(word) + 1 - kept
            path = np.concatenate((path[:kept], used + np.arange(new)))
            used += new
            for k in near:
                same = shared_letters(word, self.bounds[k]) + 1
                path[:same] = self.paths[k][:same]
            found.append(path)
            last = word
        return found


def parts_of(words: DataFrame, letters: int, backwards: bool) -> Parts:
    """Parts of about equally many letters, from a sample that grows with them.

    The driver holds ``SAMPLES_PER_PART`` strings of at most ``BOUND_LETTERS``
    for every ``PART_LETTERS`` letters.  Bounds may be any strings, so neither
    the sample nor the length changes what is found.
    """
    n_parts = -(-letters // PART_LETTERS)
    if n_parts <= 1:
        return Parts([])
    one_in = max(1, PART_LETTERS // (8 * SAMPLES_PER_PART))
    spelled = F.reverse("word") if backwards else F.col("word")
    seen = words.where(F.pmod(F.xxhash64("word"), F.lit(one_in)) == 0)
    sample = sorted(r[0] for r in seen.select(spelled.substr(1, BOUND_LETTERS)).collect())
    step = max(1, len(sample) // n_parts)
    return Parts(sorted(set(sample[step::step])))


def numbered(words: DataFrame, parts: Parts) -> DataFrame:
    """``id, word, n, nodes``: ids follow the code-point order of the words."""

    @F.pandas_udf("int")
    def part(word: pd.Series) -> pd.Series:
        return word.map(parts.part).astype("int32")

    def number(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("word")
        first = int(key[0]) << PART_BITS
        return pd.DataFrame(
            {
                "id": first + np.arange(len(rows)),
                "word": rows["word"].to_numpy(),
                "n": rows["n"].to_numpy(),
                "nodes": parts.nodes(int(key[0]), rows["word"].tolist()),
            }
        )

    return (
        words.select("word", "n", part("word").alias("part"))
        .groupBy("part")
        .applyInPandas(number, "id long, word string, n long, nodes array<long>")
    )


def word_pairs(parts: Parts, part: int, rows: pd.DataFrame) -> pd.DataFrame:
    """Cuts and skips of the words of one part, written into arrays of their size."""
    rows = rows.assign(turned=rows["word"].str[::-1]).sort_values("turned")
    turned = parts.nodes(part, rows["turned"].tolist())
    out = np.empty((len(PAIR), sum(2 * len(back) - 1 for back in turned)), np.int64)
    before, after, mark, n = out
    at = 0
    for word, number, times, fore, back in zip(
        rows["word"], rows["id"], rows["n"], rows["nodes"], turned, strict=True
    ):
        letters = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        cut = slice(at, at + len(back))
        skip = slice(cut.stop, cut.stop + len(letters))
        before[cut], before[skip] = fore, fore[:-1]
        after[cut], after[skip] = back[::-1], back[-2::-1]
        mark[cut], mark[skip] = 4 * number + CUT, 4 * number + SKIP
        mark[skip][1:] += letters[1:] == letters[:-1]
        n[cut.start : skip.stop] = times
        at = skip.stop
    return pd.DataFrame(out.T, columns=list(PAIR), copy=False)


def node_pairs(words: DataFrame, parts: Parts) -> DataFrame:
    """``before, after, mark, n``: cuts and skips of all numbered words.

    ``mark`` is four times the word's id plus the kind of the pair.  Skipping any
    letter of a run of equal letters gives one string; all but the first are
    marked ``SKIP_AGAIN``, so that a shorter word is met once.
    """

    @F.pandas_udf("int")
    def part(word: pd.Series) -> pd.Series:
        return word.map(lambda w: parts.part(w[::-1])).astype("int32")

    def pair(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return word_pairs(parts, int(key[0]), rows)

    return (
        words.withColumn("part", part("word"))
        .groupBy("part")
        .applyInPandas(pair, ", ".join(f"{c} long" for c in PAIR))
    )


PAIR = ("before", "after", "mark", "n")


def met(rows: pd.DataFrame) -> pd.DataFrame:
    """``id, n_near, near_n, near``: whom each word meets under the pairs of a shard.

    One pair holds at most one cut, as it spells one word, and a skip for each
    letter of the alphabet.  Its words are counted and the most frequent found
    by sorting; partners are not written out one by one.
    """
    out = {c: [] for c in ("id", "n_near", "near_n", "near")}
    before, after, mark, n = (rows[c].to_numpy() for c in PAIR)
    word, kind = mark >> 2, mark & 3

    def add(who, count, whom):
        out["id"].append(word[who])
        out["n_near"].append(np.broadcast_to(count, who.shape))
        out["near_n"].append(n[whom])
        out["near"].append(word[whom])

    def groups(of):
        """Members by pair, most frequent first, and each one's group."""
        by = of[np.lexsort((word[of], -n[of], after[of], before[of]))]
        new = np.ones(len(by), bool)
        new[1:] = (before[by][1:] != before[by][:-1]) | (after[by][1:] != after[by][:-1])
        return by, np.cumsum(new) - 1, np.flatnonzero(new)

    skips, group, first = groups(np.flatnonzero(kind != CUT))
    if len(skips):
        size = np.bincount(group)
        shared = size[group] > 1
        leads = np.zeros(len(skips), bool)
        leads[first] = True
        second = np.minimum(first + 1, len(skips) - 1)
        best = np.where(leads, skips[second[group]], skips[first[group]])
        add(skips[shared], (size[group] - 1)[shared], best[shared])

    # A cut meets the skips of longer words: a pair of both kinds, the cut first.
    once = np.flatnonzero(kind != SKIP_AGAIN)
    longer = np.where(kind == CUT, np.iinfo(np.int64).max, n)
    by = once[np.lexsort((word[once], -longer[once], after[once], before[once]))]
    if len(by):
        new = np.ones(len(by), bool)
        new[1:] = (before[by][1:] != before[by][:-1]) | (after[by][1:] != after[by][:-1])
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        size = np.bincount(group)
        cuts = (kind[by[first]] == CUT) & (size > 1)
        add(by[first[cuts]], size[cuts] - 1, by[first[cuts] + 1])
        meets = cuts[group] & ~new
        add(by[meets], 1, by[first[group[meets]]])
    return pd.DataFrame(
        {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()}
    )


def neighbour_counts(words: DataFrame, letters: int) -> DataFrame:
    """``id, n_near, near_n, near`` of numbered words that have a neighbour."""
    pairs = node_pairs(words, parts_of(words, letters, backwards=True))
    shards = max(1, 2 * letters // PAIRS_PER_SHARD)
    shard = F.pmod(F.xxhash64("before", "after"), F.lit(shards)).cast("int")
    found = (
        pairs.groupBy(shard.alias("shard"))
        .applyInPandas(met, "id long, n_near long, near_n long, near long")
        .groupBy("id")
        .agg(
            F.sum("n_near").alias("n_near"),
            F.max(F.struct("near_n", (-F.col("near")).alias("near"))).alias("best"),
        )
    )
    return found.select("id", "n_near", "best.near_n", (-F.col("best.near")).alias("near"))


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``word, n``.

    Two words are near if they differ by exactly one inserted, deleted or
    replaced code point.  The form of a word is its near word of greatest ``n``
    (ties: the smallest in code-point order) if that is at least ``ratio`` times
    the word's own; ``root`` follows the forms to the last and is the word
    itself where there is none.

    ``words`` holds each word once.  Rows with a null word or count are left
    out, the empty word is near to every word of one letter, other columns are
    ignored, an empty table gives no rows.  A word of any length is numbered
    letter by letter; memory grows with its length, not with its square.
    """
    words = staged(
        words.select("word", F.col("n").cast("long").alias("n")).where(
            "word is not null and n is not null"
        ),
        "words",
    )
    letters = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    words = staged(numbered(words, parts_of(words, letters, backwards=False)), "numbered")
    near = neighbour_counts(words, letters)
    is_form = F.col("near_n") >= ratio * F.col("n")
    judged = staged(
        words.select("id", "word", "n")
        .join(near, "id", "left")
        .select(
            "id",
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, F.col("near")).alias("form_id"),
            F.when(is_form, F.col("near_n")).alias("form_n"),
        ),
        "judged",
    )
    formed = judged.where("form_id is not null").select(
        F.col("id").alias("node"), F.col("form_id").alias("root")
    )
    last = formed.select(F.col("root").alias("node")).distinct().join(formed, "node", "left_anti")
    tops = followed(staged(formed.union(last.select("node", F.col("node").alias("root"))), "forms"))
    spelled = judged.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    roots = tops.join(
        judged.select(F.col("id").alias("root"), F.col("word").alias("top")), "root"
    ).select(F.col("node").alias("id"), "top")
    return (
        judged.join(spelled, "form_id", "left")
        .join(roots, "id", "left")
        .select(
            "word", "form", F.coalesce("top", "word").alias("root"), "n", "n_near", "form_n"
        )
    )
