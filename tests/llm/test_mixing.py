import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lanewise.llm import mixing


def plain_rake(cells, targets, sweeps):
    total = sum(cells.values())
    weights = {c: t / total for c, t in cells.items()}
    for _ in range(sweeps):
        for place, goal in enumerate(targets):
            now = defaultdict(float)
            for c, w in weights.items():
                now[c[place]] += w
            weights = {
                c: w * goal.get(c[place], 0) / now[c[place]] if now[c[place]] else 0
                for c, w in weights.items()
            }
    return weights


def test_raking_equals_plain_loops_and_meets_the_targets(spark):
    rng = random.Random(2)
    cells = {
        (f"s{a}", f"l{b}", f"t{c}"): rng.randint(1, 900)
        for a in range(5)
        for b in range(3)
        for c in range(2)
    }
    targets = [
        {f"s{a}": (a + 1) / 15 for a in range(5)},
        {"l0": 0.5, "l1": 0.3, "l2": 0.2},
        {"t0": 0.9, "t1": 0.1},
    ]
    names = ("source", "lang", "topic")
    df = spark.createDataFrame(
        [(*c, t) for c, t in cells.items()], "source string, lang string, topic string, tokens long"
    )
    goals = {
        n: spark.createDataFrame(list(t.items()), "value string, share double")
        for n, t in zip(names, targets, strict=True)
    }
    found = mixing.raked(df, goals, sweeps=12).collect()
    weights = plain_rake(cells, targets, 12)
    assert {tuple(r[n] for n in names): r["weight"] for r in found} == pytest.approx(weights)
    for place, goal in enumerate(targets):
        for value, share in goal.items():
            got = sum(w for c, w in weights.items() if c[place] == value)
            assert got == pytest.approx(share, abs=1e-3)


def test_sample_has_the_expected_tokens(table, spark):
    rng = random.Random(4)
    rows = [
        (k, "word " * rng.randint(200, 400), rng.choice(["en", "en", "en", "fr"]), rng.choice("aaab"))
        for k in range(4000)
    ]
    even = {
        "lang": spark.createDataFrame([("en", 0.5), ("fr", 0.5)], "value string, share double"),
        "source": spark.createDataFrame([("a", 0.6), ("b", 0.4)], "value string, share double"),
    }
    found = mixing.mix(table(rows), even, topic=F.lit("any"))
    drawn = found.where("mix.sampled")
    sums = {
        c: {r[c]: r["n"] for r in drawn.groupBy(c).agg(F.sum("mix.tokens").alias("n")).collect()}
        for c in ("lang", "source")
    }
    total = sum(sums["lang"].values())
    assert sums["lang"]["fr"] / total == pytest.approx(0.5, abs=0.05)
    assert sums["source"]["b"] / total == pytest.approx(0.4, abs=0.05)
    assert found.agg(F.max("mix.probability")).first()[0] == pytest.approx(1)


def test_odd_rows(odd, table):
    found = mixing.mix(odd, sweeps=2)
    assert found.columns == [*odd.columns, "mix"]
    rows = found.collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["mix"]["probability"] <= 1 for r in rows)
    assert {r["mix"]["tokens"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0}
    assert {r["mix"]["topic"] for r in rows if r["doc_id"] in (2, 3)} == {"empty"}
    assert len({r["mix"] for r in rows if r["doc_id"] == 1 and r["text"].endswith("hand.")}) == 1
    assert mixing.mix(odd.limit(0), sweeps=1).count() == 0
    # Without any token there is nothing to sample.
    blank = mixing.mix(table([(1, ""), (2, None)]), sweeps=1).collect()
    assert [r["mix"]["sampled"] for r in blank] == [False, False]


def shares(spark, given):
    return spark.createDataFrame(list(given.items()), "value string, share double")


def plain_bounded(cells, goals, budget, tolerance=mixing.TOLERANCE):
    """Weights of a sample that takes at most all of each cell, and the sweeps."""
    total = sum(cells.values())
    weights = {c: t / total for c, t in cells.items()}
    room = {c: t / total / budget for c, t in cells.items()}
    for sweep in range(1, mixing.SWEEPS + 1):
        off = 0
        for place, goal in enumerate(goals):
            now = defaultdict(float)
            for c, w in weights.items():
                now[c[place]] += w
            for c, w in weights.items():
                scale = goal[c[place]] / now[c[place]]
                if w * scale < room[c]:
                    off = max(off, abs(scale - 1))
                weights[c] = min(room[c], w * scale)
        if off <= tolerance:
            break
    return weights, sweep


def test_a_budget_is_met_although_small_cells_are_drawn_whole(spark):
    cells = {
        ("web", "en", "x"): 5000,
        ("web", "fr", "x"): 900,
        ("books", "en", "x"): 60,
        ("books", "fr", "x"): 4,
        ("news", "en", "x"): 1500,
        ("news", "fr", "x"): 800,
    }
    goals = [{"web": 0.5, "books": 0.03, "news": 0.47}, {"en": 0.5, "fr": 0.5}, {"x": 1.0}]
    df = spark.createDataFrame(
        [(*c, t) for c, t in cells.items()], "source string, lang string, topic string, tokens long"
    )
    given = {n: shares(spark, g) for n, g in zip(mixing.MARGINS, goals, strict=True)}
    found = mixing.raked(df, given, budget=0.25).collect()
    weights, sweeps = plain_bounded(cells, goals, 0.25)
    assert 2 < sweeps < mixing.SWEEPS
    got = {tuple(r[n] for n in mixing.MARGINS): r["weight"] for r in found}
    assert got == pytest.approx(weights)
    total = sum(cells.values())
    assert any(w * 0.25 * total == pytest.approx(cells[c]) for c, w in weights.items())
    assert all(w * 0.25 * total <= cells[c] * (1 + 1e-9) for c, w in got.items())
    for place, goal in enumerate(goals):
        for value, share in goal.items():
            reached = sum(w for c, w in got.items() if c[place] == value)
            assert reached == pytest.approx(share, abs=1e-4)


def test_targets_beyond_the_tokens_end_and_are_told(table, spark):
    rows = [(k, "word " * 10, "fr" if k % 10 == 0 else "en", "a") for k in range(200)]
    here = mixing.measured(table(rows), topic=F.lit("any"))
    wanted = {"lang": shares(spark, {"en": 0.4, "fr": 0.6})}
    mixture = mixing.fit(here, wanted, budget=0.5, sweeps=4)
    chances = {r["lang"]: r["probability"] for r in mixture.cells.collect()}
    assert chances["fr"] == 1
    off = {(r["margin"], r["value"]): r for r in mixture.margins().collect()}
    assert off["lang", "fr"]["goal"] == pytest.approx(0.6)
    assert off["lang", "fr"]["tokens"] == 200
    assert off["lang", "fr"]["off"] < -0.2
    assert off["lang", "fr"]["off"] == pytest.approx(-off["lang", "en"]["off"])
    assert off["source", "a"]["off"] == pytest.approx(0)


def test_goals_share_out_what_is_not_named_or_not_there(spark):
    cells = spark.createDataFrame(
        [("a", 100), ("b", 10_000), ("c", 1), ("(none)", 7), ("empty", 0)], "source string, tokens long"
    )
    given = spark.createDataFrame(
        [("c", 0.1), ("c", 0.1), (None, 0.2), ("gone", 0.2), ("empty", 0.1), ("a", None)],
        "value string, share double",
    )
    found = {r["value"]: r["share"] for r in mixing.goals_of(cells, "source", given, 0.5).collect()}
    # 0.2, 0.2 and 0 are named and there; 0.3 of one is open to b; 0.3 falls to all.
    assert found == pytest.approx({"c": 2 / 7, "(none)": 2 / 7, "a": 0, "b": 3 / 7})
    own = {r["value"]: r["share"] for r in mixing.goals_of(cells, "source", None, 0.5).collect()}
    roots = {"a": 10, "b": 100, "c": 1, "(none)": 7**0.5}
    assert own == pytest.approx({v: x / sum(roots.values()) for v, x in roots.items()})


def test_kept_columns_and_draws_are_those_of_all_columns(odd):
    whole = mixing.mix(odd, budget=0.5, sweeps=2).select("doc_id", "lang", "mix").collect()
    few = mixing.mix(odd, budget=0.5, sweeps=2, keep=["doc_id", "lang"])
    assert few.columns == ["doc_id", "lang", "mix"]
    assert sorted(map(str, few.collect())) == sorted(map(str, whole))
    assert mixing.mix(odd.limit(0), budget=0.5, keep=["doc_id"]).count() == 0
