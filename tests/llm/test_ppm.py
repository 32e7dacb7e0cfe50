import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanewise.llm import ppm
from lanewise.llm.queries import held_out

WORDS = ["tide", "lamp", "Boat", "quay", "é", "of", "the", "a"]


def plain_model(texts, order):
    follow = defaultdict(Counter)
    for t in texts:
        raw = bytes([ppm.BEFORE]) * order + ppm.lowered(t) + bytes([ppm.END])
        for k in range(order, len(raw)):
            for n in range(order + 1):
                follow[raw[k - n : k]][raw[k]] += 1
    return follow


def plain_score(text, follow, order):
    raw, total = bytes([ppm.BEFORE]) * order + ppm.lowered(text) + bytes([ppm.END]), 0.0
    for k in range(order, len(raw)):
        excluded = set()
        for n in range(order, -1, -1):
            seen = follow.get(raw[k - n : k], {})
            fresh = {s: c for s, c in seen.items() if s not in excluded}
            weight = sum(fresh.values()) + len(fresh)
            if raw[k] in fresh:
                total += math.log10(fresh[raw[k]] / weight)
                break
            if fresh:
                total += math.log10(len(fresh) / weight)
            excluded |= set(seen)
        else:
            total -= math.log10(ppm.SYMBOLS - len(excluded))
    return total


def plain_base(text, train):
    count = Counter(t for x in train for t in ppm.tokens(ppm.lowered(x)))
    n, v = count.total(), len(count)
    own = ppm.tokens(ppm.lowered(text))
    score = sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
    return len(own), sum(count[t] > 0 for t in own), n, score


@pytest.mark.parametrize("order", [2, 5])
def test_scores_equal_plain_loops(table, order):
    rng = random.Random(order)
    rows = [(k, " ".join(rng.choices(WORDS, k=rng.randint(0, 30)))) for k in range(60)]
    rows += [(60, None), (61, ""), (62, "never seen: 你好 \x00 zzz"), (63, None), (64, "tide")]
    out = [zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows]
    train = [t for (_, t), h in zip(rows, out, strict=True) if not h]
    follow = plain_model(train, order)
    found = ppm.ppm_scores(table(rows), held_out(F.col("doc_id"), 10), order, chunk_bytes=500)
    found = {r["id"]: r for r in found.collect()}
    assert len(found) == len(rows) and any(out)
    for (k, text), h in zip(rows, out, strict=True):
        r = found[k]
        n_tokens, n_known, n, base = plain_base(text, train)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n_tokens, n_known, n)
        assert r["base_score"] == pytest.approx(base)
        assert r["score"] == pytest.approx(plain_score(text, follow, order))


def test_probabilities_of_what_may_follow_sum_to_one():
    follow = plain_model(["abab", "abcab"], 2)

    def chance(context, symbol):
        excluded, p = set(), 1.0
        for n in range(2, -1, -1):
            seen = follow.get(context[len(context) - n :], {})
            fresh = {s: c for s, c in seen.items() if s not in excluded}
            weight = sum(fresh.values()) + len(fresh)
            if symbol in fresh:
                return p * fresh[symbol] / weight
            p *= len(fresh) / weight if fresh else 1
            excluded |= set(seen)
        return p / (ppm.SYMBOLS - len(excluded))

    assert sum(chance(b"ab", s) for s in range(256)) == pytest.approx(1)


@given(st.text(alphabet="abé ", max_size=40))
def test_adaptive_model_spends_less_on_repeats(text):
    once = ppm.adaptive_log10(ppm.lowered(text), 3)
    assert once <= 0
    twice = ppm.adaptive_log10(ppm.lowered(text) * 2, 3)
    assert twice - once > once - 10


def test_adaptive_column(table):
    docs = table([(1, "aaaa"), (2, None)])
    rows = docs.select("doc_id", ppm.adaptive_score(F.col("text")).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in rows} == pytest.approx(
        {1: ppm.adaptive_log10(b"aaaa"), 2: -math.log10(256)}
    )


def test_odd_rows(odd):
    found = ppm.ppm_scores(odd, held_out(F.col("doc_id"), 10), 3, chunk_bytes=100_000)
    rows = found.collect()
    assert len(rows) == odd.count()
    long_one = next(r for r in rows if r["id"] == 5)
    assert long_one["n_tokens"] == 220_001 and long_one["score"] < 0
    assert len({r["score"] for r in rows if r["id"] in (2, 3)}) == 1
    assert ppm.ppm_scores(odd.limit(0), held_out(F.col("doc_id"), 10)).count() == 0
    # Without training texts every symbol costs the same.
    alone = ppm.ppm_scores(odd.where("doc_id = 7"), F.lit(True), 3).first()
    assert alone["score"] == pytest.approx(-4 * math.log10(256))
    assert (alone["train_tokens"], alone["n_known"]) == (0, 0)
