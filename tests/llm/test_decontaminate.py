import random
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lanewise.llm import decontaminate as D

WORDS = [f"w{k}" for k in range(300)]


@pytest.fixture(scope="module")
def made():
    """Items of 3 to 40 words, and texts with exact, edited and shredded copies."""
    rng = random.Random(11)
    items = [(k, " ".join(rng.choices(WORDS, k=n))) for k, n in enumerate([3, 4, 5, 6, 12, 20, 20, 40, 40])]
    items += [(50, items[4][1]), (51, None), (52, "!?"), (None, "only the null item has this text")]
    texts = []
    for doc in range(60):
        words = rng.choices(WORDS, k=rng.randint(0, 120))
        item = rng.choice(items[:9])[1].split()
        for _ in range(doc % 4):
            if item:
                item[rng.randrange(len(item))] = "edited"
        at = rng.randint(0, len(words))
        texts.append((doc, " ".join([*words[:at], *item, *words[at:]]).title()))
    texts.append((70, "Only, the NULL item. has (this) text!"))
    # Items less their first or last words, and nothing around them.
    for n, (_, body) in enumerate(items[3:9]):
        words = body.split()
        texts += [(80 + 4 * n + k, " ".join(words[k:] if k % 2 else words[: len(words) - k])) for k in range(4)]
    return items, texts


def plain_leaks(items, text):
    """Items whose shingles some window of their size shares to 0.8, by brute force."""
    words, best = D.TOKEN.findall((text or "").lower()), {}
    for item_id, body in items:
        own = D.TOKEN.findall((body or "").lower())
        size = min(5, len(own))
        if not own:
            continue
        of = Counter(tuple(own[k : k + size]) for k in range(len(own) - size + 1))
        for s in range(max(1, len(words) - len(own) + 1)):
            window = words[s : s + len(own)]
            have = Counter(tuple(window[k : k + size]) for k in range(len(window) - size + 1))
            alike = (have & of).total() / (have | of).total()
            if alike >= 0.8:
                best[item_id] = max(best.get(item_id, 0), alike)
    return best


def test_equals_brute_force(spark, table, made):
    items, texts = made
    rows = spark.createDataFrame(items, "item_id long, text string")
    found = D.leaks(table(texts), rows).collect()
    total = 0
    for r in found:
        got = {x["item_id"]: x["similarity"] for x in r["leaks"]}
        assert got == pytest.approx(plain_leaks(items, r["text"]))
        total += len(got)
    assert total > 10


def test_items_in_several_passes(spark, table, made):
    items, texts = made
    rows = spark.createDataFrame(items, "item_id long, text string")

    def sets(**more):
        found = D.leaks(table(texts), rows, **more).collect()
        return sorted((r["doc_id"], sorted(str(x["item_id"]) for x in r["leaks"])) for r in found)

    assert sets(pass_words=60) == sets()


@given(st.lists(st.integers(0, 2**64 - 1), max_size=8), st.sets(st.integers(0, 63), max_size=24))
def test_blocks_find_all_within_the_radius(prints, flips):
    items = []
    for k, value in enumerate(prints):
        items.append(D.Item(k, "some text"))
        items[-1].print = value
    value = (prints[0] if prints else 0) ^ sum(1 << b for b in flips)
    found = {x.id for x in D.Blocks(items, 20, 8).within(value)}
    assert found == {k for k, p in enumerate(prints) if (p ^ value).bit_count() <= 20}


def test_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "Nobody keeps a list of who went out.")], "item_id long, text string")
    found = D.leaks(odd, items)
    assert found.columns == [*odd.columns, "leaks"]
    rows = found.collect()
    assert len(rows) == odd.count()
    assert sorted(str(r["doc_id"]) for r in rows if r["leaks"]) == ["1", "1", "1", "6", "None"]
    assert D.leaks(odd.limit(0), items).count() == 0
    assert all(r["leaks"] == [] for r in D.leaks(odd, items.limit(0)).collect())
