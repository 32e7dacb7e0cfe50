import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from lanewise.llm import variants

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")
KIND = "word string, n long, id long, nodes string"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, ratio=10):
    """Every word against every other."""
    found, form = {}, {}
    for w, n in counts.items():
        others = [(-counts[x], x) for x in counts if near(w, x)]
        best = min(others, default=(0, None))
        form[w] = best[1] if others and -best[0] >= ratio * n else None
        found[w] = len(others)
    rows = set()
    for w, n in counts.items():
        top = w
        while form[top] is not None:
            top = form[top]
        rows.add((w, form[w], top, n, found[w], counts[form[w]] if form[w] else None))
    return rows


def judged(spark, rows, **more):
    table = spark.createDataFrame([(w, n, 7, "x") for w, n in rows], KIND)
    return {tuple(r[c] for c in COLUMNS) for r in variants.spelling_variants(table, **more).collect()}


WORDS = st.text(alphabet="abé\U0001f600", max_size=6)


@settings(max_examples=6, deadline=None)
@given(st.dictionaries(WORDS, st.integers(1, 2_000), min_size=1, max_size=60))
def test_equals_every_word_against_every_other(spark, counts):
    assert judged(spark, counts.items()) == plain(counts)


def test_parts_and_shards_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    words = {"".join(rng.choice(list("abcé"), rng.integers(0, 7))) for _ in range(600)}
    counts = {w: int(rng.integers(1, 1_000)) for w in words}
    monkeypatch.setattr(variants, "PART_LETTERS", 300)
    monkeypatch.setattr(variants, "PAIRS_PER_SHARD", 500)
    monkeypatch.setattr(variants, "SAMPLES_PER_PART", 8)
    assert len(variants.parts_of(spark.createDataFrame([(w,) for w in words], "word string"), 3_000, False).bounds) > 3
    assert judged(spark, counts.items()) == plain(counts)


def test_short_bounds_change_nothing(spark, monkeypatch):
    """Words that share more letters than a bound has."""
    words = {"prefix" * 3 + x + y for x in "abcd" for y in ("", "a", "ab", "b")}
    counts = {w: 10 ** (len(w) % 3) for w in words}
    monkeypatch.setattr(variants, "PART_LETTERS", 50)
    monkeypatch.setattr(variants, "SAMPLES_PER_PART", 8)
    monkeypatch.setattr(variants, "BOUND_LETTERS", 4)
    assert judged(spark, counts.items()) == plain(counts)


@given(st.lists(st.text(alphabet="abc", max_size=6), unique=True, max_size=40), st.lists(st.text(alphabet="abc", max_size=5), unique=True, max_size=6))
def test_nodes_stand_for_prefixes(words, bounds):
    parts = variants.Parts(sorted(bounds))
    by_part = {}
    for w in sorted(words):
        by_part.setdefault(parts.part(w), []).append(w)
    seen = {}
    for part, own in by_part.items():
        for w, path in zip(own, parts.nodes(part, own), strict=True):
            assert len(path) == len(w) + 1
            for i, node in enumerate(path.tolist()):
                assert seen.setdefault(w[:i], node) == node
    assert len(set(seen.values())) == len(seen)


def test_chains_of_forms_end_at_the_last(spark):
    counts = {"colouring": 1_000_000, "coloring": 1_000, "colorin": 10, "colrin": 1, "harbour": 3}
    rows = {r[0]: r for r in judged(spark, counts.items())}
    assert rows["colrin"][1:3] == ("colorin", "colouring")
    assert rows["harbour"] == ("harbour", None, "harbour", 3, 0, None)


def test_odd_rows(spark):
    assert judged(spark, []) == set()
    rows = judged(spark, [(None, 3), ("word", None), ("", 5), ("a", 100), ("b", 100)])
    assert rows == plain({"": 5, "a": 100, "b": 100})
    long_word = "ab" * 20_000
    rows = judged(spark, [(long_word, 1), (long_word + "b", 20), (long_word[1:], 30)])
    assert {(len(r[0]), r[1] and len(r[1]), r[4]) for r in rows} == {
        (40_000, 39_999, 2), (40_001, None, 1), (39_999, None, 1),
    }


def test_query_equals_plain_loops(spark, tmp_path):
    import zlib

    import regex

    from lanewise.llm import queries

    texts = [
        (1, "Wandering wandering wanderers, Éclairer éclairer éclaire;wandering_wanderin9"),
        (2, " ".join(f"wandering wanderin{c} wanderingg" for c in "abcdefghijkl") * 30),
        (3, None),
        (4, ""),
        (None, "wanderers wanderers short éclaire×s éclaire×s"),
        (2, "Wandering repeated repeated"),
    ]
    kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                         T.StructField("word", T.StringType()), T.StructField("h", T.StringType())])
    spark.createDataFrame([(*r, "x", "y") for r in texts], kind).write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for doc, text in texts:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    found = queries.QUERIES["op11_spelling_variants"](spark, str(tmp_path)).collect()
    assert {tuple(r[c] for c in COLUMNS) for r in found} == plain(counts)
    assert len(counts) > 5


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    empty = variants.spelling_variants(spark.createDataFrame([], KIND))
    assert name in empty.columns


def test_what_a_worker_holds_of_a_part_and_a_shard_is_small():
    """Two workers share some hundred MB of an executor with their own libraries."""
    rng = np.random.default_rng(3)
    length, n_words = 9, variants.PART_LETTERS // 10
    text = "".join(rng.choice(list("abcdefgh"), n_words * length))
    words = sorted({text[i : i + length] for i in range(0, len(text), length)})
    parts = variants.Parts([])
    nodes = parts.nodes(0, words)
    rows = pd.DataFrame({"id": np.arange(len(words)), "word": words, "n": 2, "nodes": nodes})
    tracemalloc.start()
    try:
        pairs = variants.word_pairs(parts, 0, rows)
        shard = pairs.head(variants.PAIRS_PER_SHARD)
        tracemalloc.reset_peak()
        variants.word_pairs(parts, 0, rows)
        variants.met(shard)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(pairs) == sum(2 * len(w) + 1 for w in words)
    assert peak < 64e6
