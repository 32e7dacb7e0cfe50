"""Substring dedup over runs of consecutive sentences and pieces of them."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.stages import row_key, staged

#: Units (short sentences, pieces of longer ones) in a run, at least.
RUN = 2
#: Words a run must have to count: short runs repeat by chance.
MIN_WORDS = 8
#: A sentence ends with a full stop, question or exclamation mark and the white
#: space after it, with a full-width one of these, or with its line.
STOPS, WIDE_STOPS = ".!?", "。！？｡"
BOUNDARY = re.compile(
    rf"(?:[{STOPS}][\x20\x09-\x0D]|[{WIDE_STOPS}](?![{WIDE_STOPS}])|\n)"
    r"[\x20\x09-\x0D]*(?=[^\x20\x09-\x0D])"
)
#: Letters of scripts that put no space between words; two count as a word.
UNSPACED = (
    (0x0E00, 0x0EFF),
    (0x1000, 0x109F),
    (0x1780, 0x17FF),
    (0x3001, 0x30FF),
    (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF),
    (0xF900, 0xFAFF),
    (0xFF01, 0xFF65),
    (0x20000, 0x3FFFF),
)
#: Of so many words in a row inside a sentence, one starts a unit: a passage of
#: 50 words holds a whole run wherever it starts and ends.
GAP = 10
#: Code points cut into units at a time, about.
PIECE = 1 << 20

#: Stands between two texts; no code point.
EDGE = 0x110000
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def sentences(text: str | None) -> list[str]:
    """The text cut into sentences; put together again they are the text."""
    if not text:
        return []
    ends = [m.end() for m in BOUNDARY.finditer(text)]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True)]


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that mixes all their bits."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def powers(of: np.uint64, n: int) -> np.ndarray:
    found = np.full(n + 1, of, np.uint64)
    found[0] = 1
    return np.cumprod(found, dtype=np.uint64)


def in_ranges(points: np.ndarray) -> np.ndarray:
    """Which code points are letters of a script without spaces."""
    inside = np.zeros(len(points), bool)
    high = np.flatnonzero((points >= UNSPACED[0][0]) & (points < EDGE))
    for low, last in UNSPACED:
        inside[high] |= (points[high] >= low) & (points[high] <= last)
    return inside


def letter_codes(points: np.ndarray) -> np.ndarray:
    """A random number for each letter, the same for both of its cases."""
    seen = np.zeros(EDGE + 1, bool)
    seen[points] = True
    used = np.flatnonzero(seen)
    low = [chr(p).lower() if p < EDGE else " " for p in used.tolist()]
    table = np.zeros(EDGE + 1, np.uint64)
    table[used] = [ord(c) if len(c) == 1 else p for c, p in zip(low, used.tolist(), strict=True)]
    table[used] = spread(table[used] + np.uint64(1))
    return table[points]


class Units:
    """The words of some texts and the units they form, all texts at a time.

    A unit starts with each sentence, and after the first word of a sentence
    with every word whose hash is the smallest (ties: the last) of some ``GAP``
    words in a row.  That depends on nearby words alone, so copies of a passage
    are cut alike wherever they stand; sentences of up to ``GAP`` words stay
    whole, longer ones have two units or more.
    """

    def __init__(self, texts: list[str]):
        lengths = np.array([len(t) for t in texts], np.int64)
        joined = ("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(joined, np.uint32).astype(np.int64)
        #: Where each text begins and ends among the code points.
        self.begin = 1 + np.concatenate(([0], np.cumsum(lengths[:-1] + 1)))
        self.end = self.begin + lengths
        points[0] = EDGE
        points[self.end] = EDGE
        white = (points == 32) | ((points >= 9) & (points <= 13))
        gap = white | (points == EDGE)
        unspaced = in_ranges(points)
        starts = ~gap
        starts[1:] &= gap[:-1] | unspaced[1:] | unspaced[:-1]
        place = np.flatnonzero(starts)
        n = len(place)
        #: A word has size 2, a letter of a script without spaces 1.
        self.size = 2 - unspaced[place].astype(np.int64)

        # Words by the sum of their letters, each times the power of its place.
        solid = np.flatnonzero(~gap)
        word = (np.cumsum(starts) - 1)[solid]
        offset = solid - place[word]
        power = powers(STEP, int(offset.max()) if n else 0)
        values = letter_codes(points[solid]) * power[offset]
        firsts = np.flatnonzero(offset == 0)
        self.value = spread(np.add.reduceat(values, firsts)) if n else values

        # Sentences: a first letter after a stop and white space, after a line's
        # end, or after a wide stop.
        near = place[gap[place - 1] | np.isin(points[place - 1], [ord(c) for c in WIDE_STOPS])]
        index = np.arange(len(points))
        before = np.maximum.accumulate(np.where(white, -1, index))[near - 1]
        lines = np.cumsum(points == 10)
        wide = [ord(c) for c in WIDE_STOPS]
        apart = near - before > 1
        opens = np.isin(points[before], [ord(c) for c in STOPS]) & apart
        opens |= lines[near] > lines[before]
        opens |= np.isin(points[before], wide) & (apart | ~np.isin(points[near], wide))
        marks = np.zeros(len(points), np.int64)
        marks[near[opens]] = 1
        text = np.searchsorted(self.begin, place, "right") - 1
        counted = np.cumsum(marks)
        within = counted[place] - counted[self.begin - 1][text]

        fresh = np.ones(n, bool)
        fresh[1:] = (text[1:] != text[:-1]) | (within[1:] != within[:-1])
        number = np.cumsum(fresh)
        windows = 1 + np.flatnonzero(number[GAP:] == number[: max(0, n - GAP)])
        if len(windows):
            view = np.lib.stride_tricks.sliding_window_view(self.value, GAP)
            fresh[windows + GAP - 1 - view[windows, ::-1].argmin(axis=1)] = True
        #: First words of the units, and the number of words.
        self.first = np.append(np.flatnonzero(fresh), n)
        at = self.first[:-1]
        #: The text of each unit, the sentence it is in, and where it starts and
        #: ends in its text; white space before the first unit belongs to it.
        self.text, self.sentence = text[at], within[at]
        begin, leads = place[at], np.ones(len(at), bool)
        leads[1:] = self.text[1:] != self.text[:-1]
        begin = np.where(leads, self.begin[self.text], begin)
        final = np.append(leads[1:], True)[: len(at)]
        end = np.where(final, self.end[self.text], np.append(begin[1:], 0)[: len(at)])
        self.since, self.until = begin - self.begin[self.text], end - self.begin[self.text]

    def runs(self, run: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First unit, unit after the last, and hash of :func:`shortest_runs`.

        A run's hash is a difference of two prefix sums over its words.  A text
        of fewer than ``run`` units is a run as a whole.
        """
        total = np.concatenate(([0], np.cumsum(self.size)))
        first, last = shortest_runs(np.diff(total[self.first]), self.text, run, least)
        n = len(self.value)
        rising, falling = powers(STEP, n), powers(BACK, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value * rising[:n], out=sums[1:])
        a, b = self.first[first], self.first[last]
        hashes = spread((sums[b] - sums[a]) * falling[a] + (b - a).astype(np.uint64))
        return first, last, hashes.view(np.int64)


def shortest_runs(
    size: np.ndarray, text: np.ndarray, run: int, least: int
) -> tuple[np.ndarray, np.ndarray]:
    """First unit and unit after the last of the shortest runs that count.

    From each unit on, and back from each unit, a run grows inside its text until
    it has ``run`` units (or all of the text's) and sizes of ``least`` in all.
    Every longer run is covered by these: the last that starts inside it and
    fits, grown back from its end, reaches the end.
    """
    n = len(size)
    total = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    low, high = np.searchsorted(text, text), np.searchsorted(text, text, "right")
    run = np.minimum(run, high - low)
    start = np.arange(n)
    end = np.maximum(np.searchsorted(total, total[:-1] + least), start + run)
    last = start + 1
    first = np.minimum(np.searchsorted(total, total[1:] - least, "right") - 1, last - run)
    ahead, back = end <= high, first >= low
    found = np.concatenate(
        [start[ahead] * (n + 1) + end[ahead], first[back] * (n + 1) + last[back]]
    )
    return np.divmod(np.unique(found), n + 1)


def groups(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts of about ``PIECE`` code points, and the row of the first."""
    held, size, start = [], 0, 0
    for row, text in enumerate(texts):
        held.append(text or "")
        size += len(held[-1])
        if size >= PIECE:
            yield start, held
            held, size, start = [], 0, row + 1
    if held:
        yield start, held


SPAN = ("since", "size", "hash")


def run_spans(texts: list[str | None], run: int, least: int) -> list[list[np.ndarray]]:
    """For each text where its runs start, their code points and their hash."""
    found = []
    for _, held in groups(texts):
        units = Units(held)
        first, last, hashes = units.runs(run, least)
        columns = (
            units.since[first].astype(np.int32),
            (units.until[last - 1] - units.since[first]).astype(np.int32),
            hashes,
        )
        cuts = np.searchsorted(units.text[first], np.arange(1, len(held)))
        found += zip(*(np.split(c, cuts) for c in columns), strict=True)
    return found


def runs(text: Column, run: int, min_words: int) -> Column:
    """Arrays of the parts of :func:`run_spans` for a text column."""

    def batch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = run_spans(texts.tolist(), run, 2 * min_words)
            yield pd.DataFrame(found, columns=SPAN)

    kinds = ", ".join(f"{c} array<{'bigint' if c == 'hash' else 'int'}>" for c in SPAN)
    return F.pandas_udf(batch, kinds)(text)


def repeated_sentences(
    docs: DataFrame,
    run: int = RUN,
    min_words: int = MIN_WORDS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``row, cut``: for each row with repeats the spans of units to remove.

    A run of at least ``run`` consecutive units with at least ``min_words``
    words is repeated if another place of the corpus has the same run.  All its
    places but the first, in the order of id (null first), text hash and
    position, have their units cut.

    Runs are counted by their hash alone, which combines before the shuffle;
    only runs seen twice carry their places on.
    """
    row = row_key(F.col(doc_id), F.col(text)).alias("row")
    own = docs.select(row, runs(F.col(text), run, min_words).alias("r"))
    own = own.select(F.col("row.id"), F.col("row.text").alias("key"), "r.*")
    own = staged(own.where(F.size("hash") > 0), "runs")
    counts = own.select(F.explode("hash").alias("hash")).groupBy("hash")
    counts = counts.agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = staged(counts.select("hash"), "again")
    spans = own.select("id", "key", F.explode(F.arrays_zip(*SPAN)).alias("r"))
    places = staged(spans.select("id", "key", "r.*").join(again, "hash"), "places")
    place = F.struct("id", "key", "since")
    firsts = places.groupBy("hash").agg(F.min(place).alias("first"))
    firsts = staged(firsts, "firsts")
    later = places.join(firsts, "hash").where(place > F.col("first"))
    span = F.struct(*(c for c in SPAN if c != "hash"))
    cut = later.groupBy("id", "key").agg(F.collect_set(span).alias("cut"))
    return cut.select(F.struct("id", F.col("key").alias("text")).alias("row"), "cut")


def without(text: Column, cut: Column) -> Column:
    """The text without the spans of ``cut``, and how many sentences lose words."""

    def batch(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, cuts in pairs:
            out = []
            for t, spans in zip(texts, cuts, strict=True):
                if spans is None:
                    out.append((None, 0))
                    continue
                ends = [m.end() for m in BOUNDARY.finditer(t)]
                # White space before the first word is cut with it, but is no sentence.
                lead = len(t) - len(t.lstrip("\t\n\v\f\r "))
                kept, at, lost, seen = [], 0, 0, -1
                for since, until in sorted((x["since"], x["since"] + x["size"]) for x in spans):
                    kept.append(t[at : max(at, since)])
                    at = max(at, until)
                    low = bisect.bisect_right(ends, max(since, lead))
                    high = bisect.bisect_right(ends, until - 1)
                    lost += max(0, high - max(seen, low - 1))
                    seen = max(seen, high)
                out.append(("".join(kept) + t[at:], lost))
            yield pd.DataFrame(out, columns=["text", "removed"])

    return F.pandas_udf(batch, "text string, removed int")(text, cut)


def without_repeated_sentences(
    docs: DataFrame,
    run: int = RUN,
    min_words: int = MIN_WORDS,
    doc_id: str = "doc_id",
    text: str = "text",
    removed: str = "n_removed_sentences",
    total: str = "n_sentences",
) -> DataFrame:
    """Remove from ``text`` the units of :func:`repeated_sentences`.

    What stays is put together as it was.  ``removed`` and ``total`` are new
    columns with the number of sentences cut, whole or in part, and found.
    Every row stays, if only with an empty text.

    Nulls: a null text stays null and has no sentence; a null id counts as the
    smallest.  Repeated rows (same id and text) are one row with several places
    of equal rank: they keep or lose the same sentences.  Rows with one id and
    different texts are ordered by a hash of the text.  A text of fewer
    than ``run`` units can only be repeated as a whole, by a text or by a run of
    the same words.  An empty table gives an empty table.  Other
    columns pass through, except those named as ``removed`` and ``total``, which
    are replaced.
    """
    cut = repeated_sentences(docs, run, min_words, doc_id, text)
    cut = cut.select(F.col("row").alias("__row"), F.col("cut").alias("__cut"))
    found = docs.withColumn("__row", row_key(F.col(doc_id), F.col(text)))
    found = found.join(cut, "__row", "left")
    gone = F.col("__cut").isNotNull()
    # Only texts with a cut go to Python.
    left = without(F.when(gone, F.col(text)), F.col("__cut"))
    ends = F.regexp_count(F.col(text), F.lit(BOUNDARY.pattern))
    found = found.withColumn("__left", left)
    return (
        found.withColumn(removed, F.coalesce("__left.removed", F.lit(0)))
        .withColumn(total, F.when(F.length(text) > 0, ends + 1).otherwise(0))
        .withColumn(text, F.when(gone, F.col("__left.text")).otherwise(F.col(text)))
        .drop("__row", "__cut", "__left")
    )
