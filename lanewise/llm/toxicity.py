"""Toxicity: misspelled lexicon terms in context, weighed by a learned model."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.automaton import Lexicon
from lanewise.llm.stages import staged

#: Labelled rows that the lexicon and the model learn from, at most (expected).
MAX_LABELLED = 50_000
#: A term needs so many different words before it in toxic texts, such odds
#: against clean ones (natural logarithm), and so many letters.
MIN_CONTEXTS = 5
MIN_WEIGHT = 3.0
MIN_LETTERS = 3
#: Words on either side of a term that tell quotation from abuse.
WINDOW = 6

WORD = r"[\p{L}\p{M}]+"
#: Digits and signs that stand for a letter between letters.
MASK = "[0-9*@$#!|]"
TOKEN = regex.compile(rf"{WORD}(?:{MASK}+{WORD})*|[\"“”„«»]")
PARTS = regex.compile(WORD)
MARKS = frozenset('"“”„«»')
# Words of speech about a term, and words that address someone.
SPEECH = frozenset(
    "said says say wrote quote quoted quotes called word term phrase meaning "
    "dit écrit mot sagte schrieb wort dijo escribió palabra".split()
)
ADDRESS = frozenset("you your yours u ur du dich dein deine tu toi ton ta vous tú te usted".split())

FEATURES = ("plain", "misspelled", "quoted", "addressed", "strongest", "density")


def tokens(text: str | None) -> list[str]:
    """Words, masked ones whole, and quotation marks of a text in lower case."""
    return TOKEN.findall((text or "").lower())


def words_of(text: Column) -> Column:
    """Words of a text as an array, cut at masks, without leaving the JVM."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def with_word_before(words: Column) -> Column:
    """Pairs ``word, before`` of an array of words."""
    before = F.slice(F.concat(F.array(F.lit("")), words), 1, F.size(words))
    return F.arrays_zip(words.alias("word"), before.alias("before"))


def learned_terms(
    train: DataFrame,
    min_contexts: int = MIN_CONTEXTS,
    min_weight: float = MIN_WEIGHT,
) -> list[tuple[str, float]]:
    """Terms and weights from ``text, toxic`` rows.

    A term counts once for every different word before it in toxic texts, so
    that copies of a text give no evidence of their own, and once for every
    clean text that has it.  All terms that reach the thresholds are kept; there
    are no more than the labelled sample has words.
    """
    sizes = train.agg(
        F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean")
    ).first()
    words = train.select("toxic", words_of(F.col("text")).alias("words"))
    long_enough = F.length("word") >= MIN_LETTERS
    pairs = words.where("toxic").select(
        F.inline(with_word_before(F.col("words"))).alias("word", "before")
    )
    toxic = pairs.where(long_enough).distinct().groupBy("word")
    toxic = toxic.agg(F.count(F.lit(1)).alias("toxic"))
    toxic = staged(toxic.where(F.col("toxic") >= min_contexts), "toxic-words")
    clean = words.where("not toxic").select(
        F.explode(F.array_distinct("words")).alias("word")
    )
    clean = clean.where(long_enough).groupBy("word")
    clean = clean.agg(F.count(F.lit(1)).alias("clean"))
    both = toxic.join(clean, "word", "left").fillna(0, ["clean"])
    odds = F.log((F.col("toxic") + 0.5) / (sizes["toxic"] + 1)) - F.log(
        (F.col("clean") + 0.5) / (sizes["clean"] + 1)
    )
    both = both.select("word", odds.alias("weight")).where(F.col("weight") >= min_weight)
    return sorted((r["word"], r["weight"]) for r in both.collect())


class Scorer:
    """Measures of a text against a lexicon."""

    def __init__(self, terms: list[tuple[str, float]]):
        self.weight = dict(terms)
        self.lexicon = Lexicon(sorted(self.weight))
        self.seen: dict[str, tuple[str, int] | None] = {}

    def term(self, word: str) -> tuple[str, int] | None:
        if word not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[word] = self.lexicon.find(word)
        return self.seen[word]

    def words(self, text: str | None) -> list[str]:
        """Tokens; a masked word that is no term falls into its parts."""
        found = []
        for word in tokens(text):
            if word.isalpha() or word in MARKS or self.term(word):
                found.append(word)
            else:
                found += PARTS.findall(word)
        return found

    def features(self, text: str | None) -> tuple[float, ...]:
        words = self.words(text)
        sums = dict.fromkeys(FEATURES, 0.0)
        hits = 0
        for k, word in enumerate(words):
            found = self.term(word)
            if found is None:
                continue
            term, edits = found
            weight = self.weight[term]
            hits += 1
            before, after = words[max(0, k - WINDOW) : k], words[k + 1 : k + 1 + WINDOW]
            around = {*before, *after}
            marked = not MARKS.isdisjoint(before) and not MARKS.isdisjoint(after)
            if marked or not SPEECH.isdisjoint(around):
                kind = "quoted"
            elif not ADDRESS.isdisjoint(around):
                kind = "addressed"
            else:
                kind = "misspelled" if edits else "plain"
            sums[kind] += weight
            sums["strongest"] = max(sums["strongest"], weight / (1 + edits))
        sums["density"] = hits / max(1, len(words))
        return tuple(
            math.log1p(sums[f]) if f in ("plain", "misspelled", "quoted", "addressed") else sums[f]
            for f in FEATURES
        )


def features(text: Column, terms: list[tuple[str, float]]) -> Column:
    kind = ", ".join(f"{f} double" for f in FEATURES)

    def batch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(terms)
        for texts in batches:
            yield pd.DataFrame([scorer.features(t) for t in texts], columns=list(FEATURES))

    return F.pandas_udf(batch, kind)(text)


def labelled_sample(labels: DataFrame, doc_id: str, toxic: str, most: int) -> DataFrame:
    """One boolean label per id; above ``most`` ids a share of them by hash.

    An id with several labels is toxic if one of them says so; null ids and
    labels are left out.
    """
    rows = labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull())
    rows = rows.groupBy(F.col(doc_id).alias("id")).agg((F.max(toxic) > 0).alias("toxic"))
    share = min(1.0, most / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    max_labelled: int = MAX_LABELLED,
    into: str = "toxicity",
) -> DataFrame:
    """Add a struct column: ``score`` from 0 to 1 and the features behind it.

    ``labels`` holds ``doc_id, toxic`` and only rows to learn from.  The lexicon
    comes from the texts of at most about ``max_labelled`` labelled documents;
    an automaton over its trie finds terms, misspelled ones included; the words
    around a hit put it down as quoted, addressed to someone, or plain; and a
    logistic regression over these sums gives the score.  Every text is read
    whole.

    Nulls: a null or empty text has no hit and gets the score of such a text;
    labels with a null id or value are left out.  Without any label, or with
    labels of one kind only, the score is the share of toxic ones (0 without
    any).  Repeated rows get the same score.  An empty table gives an empty
    table.  Other columns pass through; only a column named as ``into`` is
    replaced.
    """
    sample = labelled_sample(labels, doc_id, toxic, max_labelled)
    train = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    # At most max_labelled ids of the sample: a bounded side.
    train = staged(train.join(F.broadcast(sample), "id"), "labelled")
    kinds = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    if len(kinds) < 2:
        terms, model = [], None
    else:
        terms = learned_terms(train)
        rows = train.select("toxic", features(F.col("text"), terms).alias("f"))
        rows = rows.select(
            F.col("toxic").cast("double").alias("label"),
            array_to_vector(F.array(*(F.col(f"f.{x}") for x in FEATURES))).alias("features"),
        )
        model = LogisticRegression(regParam=1e-4, maxIter=50).fit(staged(rows, "features"))
    found = docs.withColumn("__f", features(F.col(text), terms))
    if model is None:
        score = F.lit(1.0 if True in kinds else 0.0)
    else:
        sums = F.lit(float(model.intercept))
        for weight, name in zip(model.coefficients, FEATURES, strict=True):
            sums = sums + F.lit(float(weight)) * F.col(f"__f.{name}")
        score = 1 / (1 + F.exp(F.greatest(F.least(-sums, F.lit(700.0)), F.lit(-700.0))))
    parts = [score.alias("score"), *(F.col(f"__f.{x}").alias(x) for x in FEATURES)]
    return found.withColumn(into, F.struct(*parts)).drop("__f")
