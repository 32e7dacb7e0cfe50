from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from lanewise.llm import cascade

TEXTS = st.text(alphabet="ab #|\n\t.é ", max_size=200)


def plain_measures(text):
    words = cascade.Text(text).text.translate({ord(c): " " for c in "\t\n\v\f\r"}).split(" ")
    words = [w for w in words if w]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count = Counter(windows)
    repeated = {k + n for k, w in enumerate(windows) if count[w] > 1 for n in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        sum(x in lines[:k] for k, x in enumerate(lines)),
        len(repeated),
    )


@given(TEXTS)
def test_measures_equal_plain_counts(text):
    seen = cascade.Text(text)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert tuple(getattr(seen, n) for n in names) == plain_measures(text)


def test_order_puts_cheap_rejections_first():
    def slow(text):
        return sum(range(20_000)) < 0

    rules = [
        cascade.Rule("slow_and_lenient", slow),
        cascade.Rule("quick_and_strict", lambda t: len(t.text) < 5),
    ]
    assert [r.name for r in cascade.cascade_order(["abc"] * 20, rules)] == [
        "quick_and_strict",
        "slow_and_lenient",
    ]


def test_cascade_stops_at_the_first_rejection(table):
    calls = table([(1, "x"), (2, "y" * 50)])
    rules = [
        cascade.Rule("short", lambda t: len(t.text) < 10),
        cascade.Rule("never", lambda t: 1 / 0 if t.text == "x" else False),
    ]
    ordered = cascade.quality_cascade(calls.where("doc_id = 2"), rules)
    assert ordered.first()["quality"]["kept"]
    first = [rules[0]]
    judged = {r["doc_id"]: r["quality"] for r in cascade.quality_cascade(calls, first).collect()}
    assert judged[1]["rejected_by"] == "short" and judged[2]["rejected_by"] is None


def test_odd_rows(odd):
    judged = cascade.quality_cascade(odd, measures=("n_words", "n_dup_lines"))
    assert judged.columns == [*odd.columns, "quality"]
    rows = judged.collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r["quality"] for r in rows if r["doc_id"] in (2, 3, 4, 5)}
    assert [by_id[k]["n_words"] for k in (2, 3, 4)] == [0, 0, 0]
    assert not by_id[2]["kept"] and by_id[5]["n_words"] == 220_000
    assert cascade.quality_cascade(odd.limit(0)).count() == 0


def test_clean_prose_stays(table):
    words = [f"word{k}" for k in range(400)]
    text = "\n".join(" ".join(words[k : k + 12]) + "." for k in range(0, 400, 12))
    assert cascade.quality_cascade(table([(1, text)])).first()["quality"]["kept"]
