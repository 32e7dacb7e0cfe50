"""Language of a text from Bloom filters that hold all languages side by side.

Every language's usual letter n-grams are in a Bloom filter of its own.  The
filters are sliced by bit: row ``r`` of one table holds bit ``r`` of all of them,
so the 'and' of an n-gram's rows is the set of languages that have it.  A text's
n-grams are counted per language, the hits that a filter gives by chance are
taken off, and the language that explains the largest part of the text wins.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.stages import staged

#: Documents that one language is learned from, about.
MAX_LABELLED = 20_000
#: Least share of a language's n-grams of one length that a usual one makes up.
MIN_SHARE = 5e-5
#: A language's n-gram is not that of another which has it so many times as often.
FOREIGN = 20
#: Lengths of the n-grams; words are taken with a space on either side.
ORDERS = (3, 4)
#: Rows that an n-gram has in the table.
ROWS = 4
#: Rows of the table for each n-gram of the largest language.
ROOM = 16
#: Languages at most: the table and what the driver collects grow with them.
MAX_LANGUAGES = 2_000
#: Code points worked on at a time.
PIECE = 1 << 20

UNKNOWN = "und"
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


# --- N-grams ------------------------------------------------------------------


def pieces(texts: list[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """Texts, or parts of long ones between spaces, and the rows they belong to."""
    held, rows, size = [], [], 0
    for row, text in enumerate(texts):
        text, start = text or "", 0
        while start < len(text):
            end = text.find(" ", start + PIECE)
            end = len(text) if end < 0 else end
            held.append(text[start:end].lower())
            rows.append(row)
            size += end - start
            start = end
            if size >= PIECE:
                yield held, rows
                held, rows, size = [], [], 0
    if held:
        yield held, rows


def letters_of(points: np.ndarray) -> np.ndarray:
    """The code points, 0 where they are neither letter nor mark."""
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    table = np.zeros(0x110000, np.uint32)
    for point in np.flatnonzero(seen):
        if unicodedata.category(chr(point))[0] in "LM":
            table[point] = point
    return table[points]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(texts: list[str], rows: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the hashed n-grams and their rows."""
    points = np.frombuffer(
        ("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32
    )
    symbols = letters_of(points)
    of = np.repeat(rows, [len(t) + 1 for t in texts])
    of = np.concatenate((of[:1], of))
    # One space between words.
    kept = np.ones(len(symbols), bool)
    kept[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    symbols, of = symbols[kept].astype(np.uint64), of[kept]
    for order in ORDERS:
        last = len(symbols) - order + 1
        if last <= 0:
            continue
        whole = np.ones(last, bool)
        for k in range(1, order - 1):
            whole &= symbols[k : k + last] != 0
        first = np.flatnonzero(whole)
        value = np.full(len(first), order, np.uint64)
        for k in range(order):
            value = value * np.uint64(0x110001) + symbols[first + k]
        yield spread(value), of[first + 1]


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that mixes all their bits."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


# --- Filters ------------------------------------------------------------------


@dataclass
class Filters:
    """The sliced table of all languages.

    ``chance`` is how often an n-gram that a language does not have hits its
    filter by chance, ``cover`` the share of a language's n-grams it does have.
    """

    languages: list[str]
    table: np.ndarray
    chance: np.ndarray
    cover: np.ndarray

    @classmethod
    def of(cls, languages: list[str], learned: pd.DataFrame, cover: np.ndarray) -> Filters:
        most = learned.groupby("language").size().max() if len(learned) else 1
        size = 1 << int(ROOM * most - 1).bit_length()
        table = np.zeros((size, -(-len(languages) // 8) or 1), np.uint8)
        rows = gram_rows(learned["gram"].to_numpy().astype(np.uint64), size)
        language = learned["language"].to_numpy().astype(np.int64)
        for row in rows:
            np.bitwise_or.at(
                table, (row, language // 8), (1 << (language % 8)).astype(np.uint8)
            )
        filled = np.unpackbits(table, axis=1, bitorder="little").mean(axis=0)
        return cls(languages, table, filled[: len(languages)] ** ROWS, cover)

    def hits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of each text, and those that each language has."""
        width = self.table.shape[1]
        found, total = np.zeros((len(texts), 8 * width)), np.zeros(len(texts))
        for held, rows in pieces(texts):
            low, span = rows[0], rows[-1] - rows[0] + 1
            for gram, of in grams(held, rows):
                masks = np.bitwise_and.reduce([self.table[r] for r in gram_rows(gram, len(self.table))])
                of = of - low
                total[low : low + span] += np.bincount(of, minlength=span)
                for byte in range(width):
                    counts = np.bincount(256 * of + masks[:, byte], minlength=256 * span)
                    found[low : low + span, 8 * byte : 8 * byte + 8] += (
                        counts.reshape(span, 256) @ BITS
                    )
        return total, found[:, : len(self.languages)]

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        total, found = self.hits(texts)
        share = found / np.maximum(total, 1)[:, None]
        rate = np.clip((share - self.chance) / (1 - self.chance), 0, None) / self.cover
        # Languages come in the order that breaks ties.
        best = rate.argmax(axis=1)
        whole = rate.sum(axis=1)
        for row, text in enumerate(texts):
            if has_letter(text):
                names[row] = self.languages[best[row]]
                if whole[row]:
                    scores[row] = rate[row, best[row]] / whole[row]
        return names, scores


def gram_rows(gram: np.ndarray, size: int) -> list[np.ndarray]:
    """The rows of an n-gram: two hashes, and steps from one by the other."""
    step = spread(gram ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return [
        ((gram + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)
        for k in range(ROWS)
    ]


# --- Learning -----------------------------------------------------------------


def labelled_sample(docs: DataFrame, text: str, lang: str, most: int) -> DataFrame:
    """``lang, text``; of a language with more than ``most`` rows a share by hash."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"{len(sizes)} languages; at most {MAX_LANGUAGES} are learned")
    crowded = {k: most / n for k, n in sizes.items() if n > most}
    if not crowded:
        return rows
    share = F.create_map(*(F.lit(x) for kv in crowded.items() for x in kv))
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1_000_000
    return rows.where(place < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(1.0)))


def gram_counts(sample: DataFrame) -> DataFrame:
    """``lang, length, gram, n`` of the sample, ``n`` of each batch."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for held, rows in pieces(texts.tolist()):
                    for k, (gram, _) in enumerate(grams(held, rows)):
                        gram, n = np.unique(gram, return_counts=True)
                        yield pd.DataFrame(
                            {"lang": lang, "place": k, "gram": gram.astype(np.int64), "n": n}
                        )

    return sample.mapInPandas(count, "lang string, place int, gram long, n long")


def learned_filters(
    docs: DataFrame, text: str, lang: str, most: int = MAX_LABELLED
) -> Filters:
    """Filters of the languages of ``docs``, from about ``most`` texts of each.

    A language keeps the n-grams that make up ``MIN_SHARE`` of its own, so the
    driver gets at most ``len(ORDERS) / MIN_SHARE`` of them for each language.
    """
    counts = gram_counts(labelled_sample(docs, text, lang, most))
    counts = staged(
        counts.groupBy("lang", "place", "gram").agg(F.sum("n").alias("n")), "gram-counts"
    )
    sums = counts.groupBy("lang", "place").agg(F.sum("n").alias("all"))
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("n")).toPandas()
    sizes = sizes.sort_values(["n", "lang"], ascending=[False, True])
    languages = sizes["lang"].tolist()
    # One row for each language and length.
    shares = counts.join(F.broadcast(sums), ["lang", "place"]).withColumn(
        "share", F.col("n") / F.col("all")
    )
    usual = shares.where(F.col("share") >= MIN_SHARE)
    most_usual = F.max("share").over(Window.partitionBy("place", "gram"))
    usual = usual.withColumn("top", most_usual).where(F.col("share") * FOREIGN >= F.col("top"))
    learned = usual.select("lang", "gram", "n").toPandas()
    learned["language"] = learned["lang"].map({k: i for i, k in enumerate(languages)})
    had = learned.groupby("language")["n"].sum().reindex(range(len(languages)), fill_value=0)
    cover = had.to_numpy() / np.maximum(sizes["n"].to_numpy(), 1)
    return Filters.of(languages, learned, np.maximum(cover, 1e-9))


def languages(
    docs: DataFrame,
    train: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_labelled: int = MAX_LABELLED,
    into: str = "language",
) -> DataFrame:
    """Add a struct column ``lang, score`` to ``docs``, learned from ``train``.

    ``score`` is the winner's share of what all languages explain of the text,
    each corrected for chance hits and for the share of its own n-grams that its
    filter has.  Of languages that explain as much, the one with more training
    text wins, then the first by name.  Texts are read whole.

    A text that is null or has no letter is ``und`` with score 0; so is any text
    if nothing was learned.  A text with letters none of whose n-grams is known
    gets the first language with score 0.  Training rows with a null text or
    language are left out; repeated rows count again.  An empty table gives an
    empty table.  Other columns pass through; only one named as ``into`` is
    replaced.
    """
    filters = docs.sparkSession.sparkContext.broadcast(
        learned_filters(train, text, lang, max_labelled)
    )

    @F.pandas_udf("lang string, score double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        names, scores = filters.value.judge(texts.tolist())
        return pd.DataFrame({"lang": names, "score": scores})

    return docs.withColumn(into, judged(F.col(text)))
