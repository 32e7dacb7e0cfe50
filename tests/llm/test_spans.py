import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from lanewise.llm import spans


SPACE = "\t\n\v\f\r "


def plain_words(text):
    """Start and lower-case letters of each word."""
    out, start = [], None
    for k, c in enumerate(text + " "):
        alone = any(low <= ord(c) <= high for low, high in spans.UNSPACED)
        if start is not None and (c in SPACE or alone):
            out.append((start, text[start:k].lower()))
            start = None
        if alone:
            out.append((k, c))
        elif c not in SPACE and start is None:
            start = k
    return out


def value(word):
    return int(spans.Units([word]).value[0])


def plain_units(text):
    """Lists of the words of each unit, with where it starts and its sentence."""
    ends = [m.end() for m in spans.BOUNDARY.finditer(text)]
    by_sentence = {}
    for at, word in plain_words(text):
        by_sentence.setdefault(sum(e <= at for e in ends), []).append((at, word))
    units = []
    for sentence, words in by_sentence.items():
        starts = {0}
        for k in range(1, len(words) - spans.GAP + 1):
            window = range(k, k + spans.GAP)
            starts.add(min(window, key=lambda i: (value(words[i][1]), -i)))
        for k, (at, word) in enumerate(words):
            if k in starts:
                units.append((at, sentence, []))
            units[-1][2].append(word)
    return units


def plain(rows, run=2, least=8):
    """Texts after the cut, by all runs of units, over rows in the order of their ids."""

    def size(words):
        return sum(1 if any(a <= ord(w[0]) <= b for a, b in spans.UNSPACED) else 2 for w in words)

    seen, out, places = set(), {}, []
    units = {doc_id: plain_units(text) for doc_id, text in rows}
    for doc_id, us in units.items():
        for a in range(len(us)):
            for b in range(a + min(run, len(us)), len(us) + 1):
                words = [w for u in us[a:b] for w in u[2]]
                if size(words) >= 2 * least:
                    places.append((doc_id, a, b, tuple(words)))
    gone = {}
    for doc_id, a, b, words in sorted(places, key=lambda p: p[:2]):
        if words in seen:
            gone.setdefault(doc_id, set()).update(range(a, b))
        seen.add(words)
    for doc_id, text in rows:
        us = units[doc_id]
        edges = [0, *(u[0] for u in us[1:]), len(text)] if us else [0, len(text)]
        cut = gone.get(doc_id, set())
        left = "".join(text[a:b] for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if k not in cut)
        out[doc_id] = (left, len({us[k][1] for k in cut}), len(spans.sentences(text)))
    return out


def found_by(rows, table):
    found = spans.without_repeated_sentences(table(rows)).collect()
    return {r["doc_id"]: (r["text"], r["n_removed_sentences"], r["n_sentences"]) for r in found}


def test_equals_all_runs_of_units(table):
    draw = random.Random(11)
    ends = [" ", " ", " ", " ", " ", ". ", "! ", "\n", "  ", " \n\n", ".", "。", "。！", "!? "]
    vocabulary = [f"w{k}" for k in range(12)] + ["É", "Σας", "港", "町は", "x"]

    def prose(n):
        return "".join(draw.choice(vocabulary) + draw.choice(ends) for _ in range(n))

    shared = [prose(draw.randrange(5, 60)) for _ in range(8)]
    rows = []
    for k in range(60):
        parts = [prose(draw.randrange(12)), draw.choice(shared), prose(draw.randrange(12)), draw.choice(shared)]
        rows.append((k, draw.choice(["", "\n", " "]) + "".join(parts).swapcase()))
    rows += [(100, ""), (101, " \n "), (102, rows[3][1]), (103, "。"), (104, "one")]
    expected = plain(rows)
    assert found_by(rows, table) == expected
    assert sum(v[1] > 0 for v in expected.values()) > 20


def test_texts_in_groups_are_cut_alike(monkeypatch):
    draw = random.Random(5)
    texts = [" ".join(f"w{draw.randrange(30)}" + "." * draw.randrange(2) for _ in range(draw.randrange(80))) for _ in range(50)]
    whole = spans.run_spans([None, *texts], 2, 16)
    monkeypatch.setattr(spans, "PIECE", 40)
    parts = spans.run_spans([None, *texts], 2, 16)
    assert all((a == b).all() for x, y in zip(whole, parts, strict=True) for a, b in zip(x, y, strict=True))


@given(st.text(alphabet="ab .!?\n\t", max_size=100))
def test_sentences_put_together_are_the_text(text):
    assert "".join(spans.sentences(text)) == text


def test_repeated_passages_go_but_for_the_first(table):
    passage = "It was a long way round the bay. Nobody took it twice in a year! Who would?"
    rows = [(k, f"Opening number {k} is not like others. {passage} And so on {k}.") for k in range(40)]
    rows.append((90, "Alone. " + passage.upper()))
    rows.append((91, "Nothing here is said elsewhere at all. It stands quite alone in this corpus."))
    rows.append((92, "Yes. No. Yes. No. Yes. No."))
    rows.append((93, " ".join(["Twice in the same text here. Again and again it comes."] * 3)))
    found = spans.without_repeated_sentences(table(rows)).collect()
    assert {r["doc_id"]: r["text"] for r in found} == {k: v[0] for k, v in plain(rows).items()}
    assert all("Nobody took it" not in r["text"] for r in found if 0 < r["doc_id"] < 40)


def test_odd_rows(odd):
    found = spans.without_repeated_sentences(odd)
    assert found.columns == [*odd.columns, "n_removed_sentences", "n_sentences"]
    rows = found.collect()
    assert len(rows) == odd.count()
    texts = {}
    for r in rows:
        texts.setdefault(r["doc_id"], []).append(r["text"])
    # The null id comes first, so its copy of the prose stays whole.
    assert any(t and t.startswith("The harbour") for t in texts[None])
    assert texts[6] == [""] and texts[2] == [None] and texts[3] == [""]
    assert spans.without_repeated_sentences(odd.limit(0)).count() == 0


def test_passages_of_short_sentences_go_whole(table):
    shout = " ".join(f"WORD{k}!!" for k in range(60))
    menu = "\n".join(f"{k} soup\nbread {k}" for k in range(20))
    tail = "The last boat of the day has left the harbour now. We all stay here for the night then. Good. Fine. So."
    rows = [(10 * n + c, t) for n, t in enumerate((shout, menu, tail)) for c in (1, 2, 3)]
    rows.append((50, f"Quite another start of a text. {shout} Quite another end of it."))
    rows.append((51, "One! Two! Three! Four!"))
    rows.append((52, "One! Two! Three! Four!"))
    found = {r["doc_id"]: r["text"] for r in spans.without_repeated_sentences(table(rows)).collect()}
    for n, t in enumerate((shout, menu, tail)):
        assert [found[10 * n + c] for c in (1, 2, 3)] == [t, "", ""]
    assert found[50] == "Quite another start of a text. Quite another end of it."
    assert found[51] == found[52] == "One! Two! Three! Four!"


@given(st.lists(st.integers(0, 10), max_size=30), st.integers(1, 4), st.integers(0, 20))
def test_shortest_runs_cover_every_run_that_counts(size, run, least):
    one_text = np.zeros(len(size), np.int64)
    start, end = spans.shortest_runs(np.array(size, np.int64), one_text, run, least)
    found = [range(a, b) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    run = min(run, len(size))
    assert all(len(r) >= run and sum(size[r.start : r.stop]) >= least for r in found)
    for a in range(len(size)):
        for b in range(a + run, len(size) + 1):
            if sum(size[a:b]) >= least:
                inside = {k for r in found if a <= r.start and r.stop <= b for k in r}
                assert inside == set(range(a, b))


def windows(text, n=50):
    words = text.lower().split()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def test_passages_planted_inside_sentences_go(table):
    draw = random.Random(3)

    def prose(n, stops=0.0):
        return " ".join(f"w{draw.randrange(10**6)}" + "." * (draw.random() < stops) for _ in range(n))

    passages = [prose(50, stops) for stops in (0, 0, 0.03, 0.03, 0.1, 0.3) for _ in range(5)]
    passages += [prose(50).replace(" ", ".&&& ", 3), " ".join(["IM!! BEST!! EIN!!"] * 17)]
    rows, before = [], {}
    for k, passage in enumerate(passages):
        for copy in range(2):
            before[2 * k + copy] = f"{prose(draw.randrange(15))} {passage} {prose(draw.randrange(15))}".strip()
    rows = list(before.items())
    found = {r["doc_id"]: r["text"] for r in spans.without_repeated_sentences(table(rows)).collect()}
    for k, passage in enumerate(passages):
        first, second = found[2 * k], found[2 * k + 1]
        assert windows(passage) <= windows(before[2 * k + 1])
        assert not windows(first) & windows(second)
        assert set(passage.lower().split()) <= set(first.lower().split())
        # What stands around the passage stays.
        assert set(before[2 * k + 1].split()) - set(passage.split()) <= set(second.split())


def test_copies_of_one_sentence_go(table):
    one = [
        "nobody ever takes the long way round the bay in one evening when it rains like that",
        "Eight words make a sentence that counts here.",
        "港は町より先に目を覚ます。船は潮と一緒に入ります。誰も知りません。",
        "港" * 9 + "町先目覚船潮緒入誰知",
    ]
    rows = [(10 * k + c, t) for k, t in enumerate(one) for c in range(3)]
    rows += [(90, "Seven words are not enough for this"), (91, "Seven words are not enough for this")]
    found = {r["doc_id"]: r for r in spans.without_repeated_sentences(table(rows)).collect()}
    for k, t in enumerate(one):
        assert [found[10 * k + c]["text"] for c in range(3)] == [t, "", ""]
    assert found[90]["text"] == found[91]["text"] == "Seven words are not enough for this"
    assert found[21]["n_sentences"] == found[21]["n_removed_sentences"] == 3


@given(st.lists(st.text(alphabet="abc .!?\n\t港。", max_size=80), min_size=1, max_size=5))
def test_units_are_those_of_plain_loops(texts):
    units = spans.Units(texts)
    for k, text in enumerate(texts):
        own = units.text == k
        since, until = units.since[own].tolist(), units.until[own].tolist()
        expected = plain_units(text)
        assert since == ([0, *(u[0] for u in expected[1:])] if expected else [])
        assert until == [*since[1:], len(text)][: len(since)]
        assert units.sentence[own].tolist() == [u[1] for u in expected]
