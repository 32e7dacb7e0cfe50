import random

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from lanewise.llm import simhash
from lanewise.llm.components import components


def plain_print(text, shingle):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams] if words else []
    return sum(
        1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)
    )


def plain_components(prints):
    """Smallest index reachable over links of at most four bits."""
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@given(st.text(), st.integers(1, 5))
def test_fingerprint_is_the_majority_of_the_shingle_hashes(text, shingle):
    assert simhash.fingerprint(text, shingle) == plain_print(text, shingle)


def test_spark_hashes_alike(spark):
    seen = spark.sql("select xxhash64('the quick brown fox') as h").first()["h"]
    assert seen % 2**64 == xxhash.xxh64_intdigest(b"the quick brown fox", 42)


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=6), st.integers(0, 6))
def test_every_pair_within_the_distance_starts_a_chain(value, flips, most):
    other = value ^ sum(1 << b for b in flips)
    differ = np.array([value ^ other], np.uint64)
    met = [start for start, mask in simhash.ring_keys(most) if not (value ^ other) & mask]
    chain = simhash.chains(most)
    passed = any(simhash.linked(differ, chain[s])[0] for s in met)
    assert passed == (len(flips) <= most)


@pytest.mark.parametrize("slice_rows", [5, 2000])
def test_links_join_what_brute_force_joins(spark, slice_rows):
    """A crowd of close prints, cut into slices or not, and lone ones."""
    rng = random.Random(3)
    core = rng.getrandbits(64)
    prints = {core}
    for _ in range(150):
        base = rng.choice(sorted(prints))
        prints.add(base ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 4))))
    prints |= {rng.getrandbits(64) for _ in range(60)}
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "print long")
    links = simhash.print_links(df, 4, slice_rows)
    for r in links.collect():
        assert ((r["a"] ^ r["b"]) % 2**64).bit_count() <= 4
    roots = {r["node"] % 2**64: r["root"] for r in components(links).collect()}
    label = plain_components(prints)
    groups = {}
    for p, g in zip(prints, label, strict=True):
        groups.setdefault(g, set()).add(roots.get(p, ("alone", p)))
    assert all(len(x) == 1 for x in groups.values())
    assert len({next(iter(x)) for x in groups.values()}) == len(groups)


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(k, k + 1) for k in range(100, 160)]
    hub = [(1, k) for k in range(200, 300)]
    odd = [(5, 5), (None, 7), (200, 1), (200, 1)]
    edges = spark.createDataFrame(path + hub + odd, "a long, b long")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert found == {k: 100 for k in range(100, 161)} | {k: 1 for k in [1, *range(200, 300)]}
    assert components(edges.limit(0)).count() == 0


def test_near_duplicates_of_odd_rows(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    empty = {r["doc_id"] for r in rows if r["print"] == 0}
    assert empty == {2, 3, 4, None}
    assert {r["component_id"] for r in rows if r["print"] == 0} == {2}
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 6)} == {1}
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    # The longer text of id 1 is a component of its own.
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 2, 5, 7]


def test_components_without_any_id(table):
    docs = table([(None, "a b c d e"), (None, "a b c d e"), (None, "v w x y z")])
    assert {r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {None}
    assert simhash.one_of_each(docs).count() == 2
    assert simhash.one_of_each(docs.limit(0)).count() == 0
