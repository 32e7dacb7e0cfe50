import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from lanewise.llm import prefixes, queries

COLUMNS = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
)
KIND = "conv_id long, turn long, role string, text string, depth string, hi string, family string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], KIND)


def digest(turn):
    said = f"{len(turn[0])}:{turn[0]}{turn[1]}"
    return hashlib.sha256(said.encode()).digest()


def plain(rows, family=20, taken=lambda c: zlib.crc32(str(c).encode()) % 4):
    """The trie as a dictionary of sequences."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            said = (role or "", text or "")
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest(said), said))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = taken(c)
        built[c] = tuple(own.get(c - c % family, [])[:h] + ts[h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)

    def below(node):
        todo, found = [node], []
        while todo:
            found.append(todo.pop())
            todo += kids.get(found[-1], [])
        return found

    out = set()
    for node, who in members.items():
        tree = below(node)
        saved = sum(
            (len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in tree if x
        )
        ends = ",".join(str(c) for c in sorted(c for c in who if built[c] == node))
        out.add(
            (min(who), len(node), min(members[node[:-1]]) if node else None, len(who),
             len(kids.get(node, [])), sum(x not in kids for x in tree), saved,
             hashlib.sha256(ends.encode()).hexdigest())
        )
    return out


def found(spark, rows, heads=queries.SHARED_HEADS):
    return {tuple(r[c] for c in COLUMNS) for r in prefixes.prefix_trie(table(spark, rows), heads).collect()}


def many(seed, convs, kinds):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(4 * convs, convs, replace=False).tolist():
        for turn in range(int(rng.integers(1, 7))):
            rows.append((c, turn, ("user", "bot")[turn % 2], f"turn {'x ' * int(rng.integers(kinds))}"))
    return rows


def test_equals_a_dictionary_of_sequences(spark):
    rows = many(1, 300, 3)
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, prefixes.OWN) == plain(rows, 1, lambda c: 0)


def test_tiers_and_shards_change_nothing(spark, monkeypatch):
    rows = many(2, 200, 2)
    expected = plain(rows)
    monkeypatch.setattr(prefixes, "TIER", 3)
    monkeypatch.setattr(prefixes, "NODES_PER_SHARD", 10)
    monkeypatch.setattr(prefixes, "BATCH", 7)
    assert found(spark, rows) == expected


def test_copies_long_conversations_and_ties(spark):
    rows = [(c, t, "user", f"the same {t}") for c in range(40, 400) for t in range(3)]
    rows += [(c, t, "user", f"long {t}") for c in (5, 6) for t in range(500)]
    rows += [(7, 0, "user", "a b"), (7, 0, "user", "a b"), (7, 0, "bot", "c"), (7, None, None, None)]
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    assert found(spark, []) == set()
    rows = [(None, 0, "user", "nobody"), (3, None, None, None), (23, 1, None, "x"), (-5, 0, "user", ""),
            (4, 0, "a", "b:c"), (4, 1, "a:", "bc"), (24, 0, "user", "word " * 100_000)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, [(20, 0, "user", "one")]) == plain([(20, 0, "user", "one")])
    # A conversation of which the head takes every turn has none left.
    alone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    assert found(spark, [(alone, 0, "user", "gone")]) == plain([(alone, 0, "user", "gone")])


@given(st.sets(st.tuples(st.integers(-5, 5), st.integers(-(2**63), 2**63 - 1)), max_size=300))
def test_slots_are_minimal_and_tell_others_apart(digests):
    hi = np.array([d[0] for d in sorted(digests)], np.int64)
    lo = np.array([d[1] for d in sorted(digests)], np.int64)
    slots = prefixes.Slots(hi, lo)
    assert sorted(slots.find(hi, lo).tolist()) == list(range(len(digests)))
    assert (slots.find(hi + 100, lo) == -1).all()


@pytest.mark.parametrize("conv_id", [0, 7, -5, 10**12])
def test_heads_follow_the_crc(conv_id):
    assert queries.SHARED_HEADS.taken(conv_id) == zlib.crc32(str(conv_id).encode()) % 4
