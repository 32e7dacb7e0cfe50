import math
import random

import pytest
import regex
from hypothesis import given
from hypothesis import strategies as st

from lanewise.llm import toxicity
from lanewise.llm.automaton import Lexicon


def distance(a, b):
    """Edits with swaps of neighbours, no letter edited twice."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        last, row = rows[-1], [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                row[-1] = min(row[-1], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


WORD = st.text(alphabet="abc", max_size=7)


@given(st.sets(WORD.filter(bool), max_size=6), st.lists(WORD, max_size=8), st.integers(0, 2))
def test_automaton_equals_the_distance(terms, words, edits):
    def allowed(term):
        return edits if len(term) >= 4 else 0

    lexicon = Lexicon(sorted(terms), allowed)
    for word in words:
        near = [(distance(word, t), t) for t in terms]
        near = [x for x in near if x[0] <= allowed(x[1])]
        found = lexicon.find(word)
        assert found == (None if not near else min(near)[::-1])


def test_forgotten_transitions_are_worked_out_anew():
    lexicon = Lexicon(["bother", "brother"])
    lexicon.MEMORY = 30
    assert [lexicon.find(w) for w in ("bothre", "brothers", "other", "zzzzz")] == [
        ("bother", 1),
        ("brother", 1),
        ("bother", 1),
        None,
    ]


def test_quotation_address_and_spelling():
    scorer = toxicity.Scorer([("dimwit", 2.0)])

    def kinds(text):
        named = dict(zip(toxicity.FEATURES, scorer.features(text), strict=True))
        return {k for k in ("plain", "misspelled", "quoted", "addressed") if named[k]}

    assert kinds("what a dimwit that was") == {"plain"}
    assert kinds("what a dimwitt that was") == {"misspelled"}
    assert kinds('the “dimwit” of the old play') == {"quoted"}
    assert kinds("the word dimwit is old") == {"quoted"}
    assert kinds("you dimwit") == {"addressed"}
    assert kinds("nothing of the kind") == set()


def plain_features(text, weight):
    """The features by comparing every word with every term."""

    def term(word):
        near = [(distance(word, t), t) for t in weight]
        return min((x for x in near if x[0] <= (len(x[1]) >= 5)), default=None)

    words = []
    for word in regex.findall(r"[\p{L}\p{M}]+(?:[0-9*@$#!|]+[\p{L}\p{M}]+)*|[\"“”„«»]", text.lower()):
        parts = regex.findall(r"[\p{L}\p{M}]+", word)
        words += [word] if len(parts) < 2 or term(word) else parts
    sums, hits = dict.fromkeys(toxicity.FEATURES, 0.0), 0
    for k, word in enumerate(words):
        found = term(word)
        if not found:
            continue
        hits += 1
        before, after = words[max(0, k - 6) : k], words[k + 1 : k + 7]
        if set(before) & set('"“”„«»') and set(after) & set('"“”„«»') or toxicity.SPEECH & {*before, *after}:
            kind = "quoted"
        elif toxicity.ADDRESS & {*before, *after}:
            kind = "addressed"
        else:
            kind = "misspelled" if found[0] else "plain"
        sums[kind] += weight[found[1]]
        sums["strongest"] = max(sums["strongest"], weight[found[1]] / (1 + found[0]))
    sums["density"] = hits / max(1, len(words))
    kinds = ("plain", "misspelled", "quoted", "addressed")
    return [math.log1p(sums[f]) if f in kinds else sums[f] for f in toxicity.FEATURES]


def test_features_equal_plain_loops():
    weight = {"idiot": 3.5, "stupid": 4.0, "ass": 3.0, "dimwit": 2.5}
    words = ["you", "said", "idiot", "id1ot", "idoit", "st*pid", "stupdi", "st0p1d", "ass", "as", "a$s", "dim", "wit",
             "dimwits", "“", "”", "of", "x2y", "Dimwit!", "the", "old", "harbour", "5", "été"]
    scorer, draw = toxicity.Scorer(sorted(weight.items())), random.Random(4)
    for _ in range(300):
        text = " ".join(draw.choices(words, k=draw.randrange(40)))
        assert scorer.features(text) == pytest.approx(plain_features(text, weight))
    assert all(scorer.term(w) for w in ("id1ot", "idoit", "st*pid", "stupdi"))


def test_every_learned_term_is_kept(spark):
    """Six thousand terms of two letters each, more than any fixed number would keep."""
    names = [f"term{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}" for a in range(20) for b in range(20) for c in range(15)]
    rows = [(" ".join(f"w{'abcdef'[k]}x {n}" for n in names), True) for k in range(6)]
    rows += [(f"clean text {k}", False) for k in range(60)]
    train = spark.createDataFrame(rows, "text string, toxic boolean")
    assert {t for t, _ in toxicity.learned_terms(train)} >= set(names)


@pytest.fixture(scope="module")
def corpus():
    """Clean words, and abuse with misspellings; a hot clean text in a third of rows."""
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("mor", "tel", "san", "vir", "gol") for b in ("an", "ek", "ul", "is", "op")]
    insults = ["blockhead", "nitwit", "scoundrel"]
    rows, toxic = [], {}
    for k in range(600):
        text = rng.choices(words, k=rng.randint(3, 60))
        toxic[k] = int(k % 5 == 0)
        if toxic[k]:
            for _ in range(3):
                term = rng.choice(insults)
                if rng.random() < 0.3:
                    cut = rng.randrange(len(term))
                    term = term[:cut] + term[cut + 1 :]
                text.insert(rng.randint(0, len(text)), term.upper() + "!")
        rows.append((k, " ".join(text)))
    rows += [(1000 + k, "the same text of many rows") for k in range(300)]
    toxic |= {1000 + k: 0 for k in range(300)}
    return rows, toxic


def test_held_out_accuracy(spark, table, corpus):
    rows, toxic = corpus
    labels = [(k, t) for k, t in toxic.items() if k % 3]
    found = toxicity.toxicity(table(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    scored = [(r["toxicity"]["score"] >= 0.5, toxic[r["doc_id"]]) for r in found.collect() if r["doc_id"] % 3 == 0]
    assert sum(p == bool(t) for p, t in scored) / len(scored) > 0.97


def test_copies_are_no_evidence(spark):
    copies = [("common words and one rare gimcrack among them", True)] * 50
    others = [(f"common words {k} and others", k % 2 == 0) for k in range(50)]
    train = spark.createDataFrame(copies + others, "text string, toxic boolean")
    assert toxicity.learned_terms(train) == []


def test_odd_rows(spark, odd):
    kind = "doc_id long, toxic int, extra string"
    labels = [(1, 1, "x"), (1, 0, "x"), (2, 0, "x"), (5, 0, "x"), (None, 1, "x"), (6, None, "x"), (99, 1, "x")]
    found = toxicity.toxicity(odd, spark.createDataFrame(labels, kind))
    assert found.columns == [*odd.columns, "toxicity"]
    rows = found.collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["toxicity"]["score"] <= 1 for r in rows)
    assert len({r["toxicity"]["score"] for r in rows if r["doc_id"] in (2, 3, 4)}) == 1
    none = toxicity.toxicity(odd, spark.createDataFrame([], kind))
    assert {r["toxicity"]["score"] for r in none.collect()} == {0.0}
    one = toxicity.toxicity(odd, spark.createDataFrame([(1, 1, "x")], kind))
    assert {r["toxicity"]["score"] for r in one.collect()} == {1.0}
    assert toxicity.toxicity(odd.limit(0), spark.createDataFrame(labels, kind)).count() == 0
