"""Quality rules as a short-circuit cascade.

A document is kept when no rule rejects it.  The verdict does not depend on the
order of the rules, the work does: rules run in the order of rejections per
second, both measured on a sample, and the first rejection ends a document.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
#: The sample that sets the order of the rules: rows, share of the rows looked
#: at, and the longest text in it (characters).  No verdict depends on it.
SAMPLE_ROWS = 400
SAMPLE_SHARE = 0.2
SAMPLE_CHARS = 1_000_000


class Text:
    """Measures of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        spaces = len(self.raw) - len(self.raw.translate(None, SPACE))
        return len(self.text) - spaces

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def n_shouts(self) -> int:
        return self.raw.count(b"!")

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines that hold a word."""
        return [x for x in self.raw.split(b"\n") if x.strip(SPACE)]

    @cached_property
    def n_lines(self) -> int:
        return len(self.lines)

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a window of three words that the text holds twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        ids: dict[bytes, int] = {}
        code = np.fromiter((ids.setdefault(w, len(ids)) for w in self.words), np.int64, n)
        pairs = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)[1]
        _, window, count = np.unique(
            pairs[:-1] * len(ids) + code[2:], return_inverse=True, return_counts=True
        )
        again = np.flatnonzero(count[window] > 1)
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[again + k] = True
        return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a text that the rule turns down."""

    name: str
    rejects: Callable[[Text], bool]


#: Production rules.  Shares are taken without division, so that SQL agrees.
RULES = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
    Rule("long_words", lambda t: t.word_chars > 20 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("shouting", lambda t: 2 * t.n_shouts > t.n_words),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > t.n_lines),
)


def cascade_order(texts: list[str | None], rules=RULES) -> list[Rule]:
    """Rules by rejections per second of work on ``texts``, best first."""
    worth = {}
    for rule in rules:
        began = time.perf_counter()
        rejected = sum(rule.rejects(Text(t)) for t in texts)
        worth[rule.name] = rejected / max(time.perf_counter() - began, 1e-9)
    return sorted(rules, key=lambda r: (-worth[r.name], r.name))


def sample_texts(docs: DataFrame, text: str, rows: int = SAMPLE_ROWS) -> list[str]:
    """A bounded sample; Spark reads only as many partitions as it takes."""
    few = docs.select(F.col(text).alias("text")).sample(SAMPLE_SHARE, 7)
    few = few.where(F.length("text") <= SAMPLE_CHARS).limit(rows)
    return [r["text"] for r in few.collect()]


def quality_cascade(
    docs: DataFrame,
    rules=RULES,
    text: str = "text",
    measures: tuple[str, ...] = (),
    verdict: str = "quality",
) -> DataFrame:
    """Add a struct column: ``kept``, ``rejected_by`` and the ``measures`` asked for.

    ``rejected_by`` names the rule that ended the cascade.  Measures are
    attributes of :class:`Text`; they are filled in for every row, which costs
    what the cascade saves, so ask only for those you need.

    Nulls: a null text counts as an empty one, which has no words.  Repeated
    rows are judged alike.  An empty table gives an empty table.  Other columns,
    whatever their names, pass through; only a column named as ``verdict`` is
    replaced.
    """
    ordered = cascade_order(sample_texts(docs, text), rules)
    kind = "kept boolean, rejected_by string"
    kind += "".join(f", {m} bigint" for m in measures)

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["kept", "rejected_by", *measures]
        for batch in batches:
            out = []
            for value in batch:
                seen = Text(value)
                by = next((r.name for r in ordered if r.rejects(seen)), None)
                out.append((by is None, by, *(getattr(seen, m) for m in measures)))
            yield pd.DataFrame(out, columns=names).astype({"kept": bool})

    judged = F.pandas_udf(judge, kind)
    return docs.withColumn(verdict, judged(F.col(text)))
