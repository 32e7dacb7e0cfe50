import itertools
import random
import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanewise.llm import urlrules
from lanewise.llm.queries import HOST_RULES


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [
        (len(r.host + r.path), r.host + r.path, r.verdict)
        for r in HOST_RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/1?x=1", "http://example.org/es/",
    "https://example.org/en/17#a", "https://example.org/en/7", "http://myexample.org/es/1",
    "http://org", "http://org/", "http://a.com/fr/1", "http://a.com/de/1", "http://com/de/",
    "http://a.com?x=/de/", "http://a.com#/fr/", "ftp://b.net/://c.org/", "x://É.ORG/é", "http://a.com/fr",
]


def test_hosts_paths_and_fixed_rules(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    host, path = urlrules.host(F.col("url")), urlrules.path(F.col("url"))
    rule, verdict = urlrules.fixed_rule(host, path, HOST_RULES)
    rows = df.select("url", host.alias("h"), path.alias("p"), rule.alias("r"), verdict.alias("v"))
    for r in rows.collect():
        h, p = plain_parts(r["url"])
        assert (r["h"], r["p"]) == (h, p)
        assert (r["r"], r["v"]) == plain_rule(h, p)


@given(st.text(alphabet="ab.:/?#", max_size=12))
def test_plain_parts_never_hold_a_query(url):
    assert not set("?#") & set("".join(plain_parts(url)))


def plain_rules(baskets, support, rows, confidence, lift):
    """All token combinations by their counts."""
    bad = sum(b for _, b in baskets)
    least = max(support * len(baskets), rows)
    found = {}
    every = set().union(*(t for t, _ in baskets))
    for n in range(1, 4):
        for some in itertools.combinations(sorted(every), n):
            hit = [b for t, b in baskets if set(some) <= t]
            enough = confidence, lift * bad / len(baskets)
            if len(hit) >= least and sum(hit) / len(hit) >= max(enough):
                found[some] = sum(hit) / len(hit)
    return found


def test_mined_rules_equal_plain_counts(spark):
    rng = random.Random(6)
    baskets = []
    for _ in range(400):
        tokens = {t for t in "abcdef" if rng.random() < 0.4}
        bad = rng.random() < (0.9 if {"a", "b"} <= tokens else 0.2)
        baskets.append((tokens, bad))
    df = spark.createDataFrame([(sorted(t), b) for t, b in baskets], "tokens array<string>, bad boolean")
    found = urlrules.mined_rules(df, 0.05, 10, 0.5, 1.5).collect()
    short = {tuple(r["tokens"]): r["confidence"] for r in found if len(r["tokens"]) < 4}
    assert short == plain_rules(baskets, 0.05, 10, 0.5, 1.5)
    assert ("a", "b") in short
    count = {t: sum(t in b for b, _ in baskets) for t in "abcdef"}
    assert all(count[r["rarest"]] == min(count[t] for t in r["tokens"]) for r in found)


def test_judged_urls(spark):
    bad = [(f"http://spam.net/en/{k}", True) for k in range(30)]
    good = [(f"http://fine.net/en/{k}", False) for k in range(70)]
    labelled = spark.createDataFrame([*bad, *good, (None, True), ("x", None)], "url string, bad boolean")
    urls = spark.createDataFrame(
        [(u, "x", "y") for u in [*URLS, "http://www.spam.net/fr/5", "http://spam.org/fr/5", "http://fine.net/en/5"]],
        "url string, host string, tokens string",
    )
    judged = urlrules.judged_urls(urls, labelled, HOST_RULES)
    assert judged.columns == ["url", "tokens", "host", "path", "rule", "mined_rule", "verdict"]
    rows = {r["url"]: r for r in judged.collect()}
    assert len(rows) == len(URLS) + 3
    for url, r in rows.items():
        assert (r["host"], r["path"]) == plain_parts(url)
        assert r["rule"] == plain_rule(r["host"], r["path"])[0]
        assert r["verdict"] in ("allow", "block")
    assert rows["http://www.spam.net/fr/5"]["verdict"] == "block"
    assert "host:spam" in rows["http://www.spam.net/fr/5"]["mined_rule"]
    assert rows["http://spam.org/fr/5"]["verdict"] == "allow"  # the fixed rule decides
    assert rows["http://fine.net/en/5"]["verdict"] == "allow"
    assert rows[None]["verdict"] == "allow"
    none = urlrules.judged_urls(urls, labelled.limit(0), HOST_RULES)
    assert none.where("rule is null and verdict != 'allow'").count() == 0
    assert urlrules.judged_urls(urls.limit(0), labelled, HOST_RULES).count() == 0


def test_chance_gives_no_rule(spark):
    """Labels that have nothing to do with the urls, and one token that has."""
    rng = random.Random(21)
    rows = [(sorted({f"t{rng.randrange(40)}" for _ in range(6)}), rng.random() < 0.15) for _ in range(3000)]
    told = [(sorted([*t, "spam"]), rng.random() < 0.7) for t, _ in rows[:60]]
    frame = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    both = spark.createDataFrame(rows + told, "tokens array<string>, bad boolean")
    assert urlrules.mined_rules(frame).count() > 0
    assert urlrules.mined_rules(frame, alpha=urlrules.ALPHA).count() == 0
    found = urlrules.mined_rules(both, alpha=urlrules.ALPHA).collect()
    assert ["spam"] in [r["tokens"] for r in found] and all("spam" in r["tokens"] for r in found)


def test_urls_of_many_tokens_end(spark):
    """Thirty tokens that always come together: combinations of the best sixteen only."""
    names = [f"n{k:02}" for k in range(30)]
    rows = [(names, k % 3 == 0) for k in range(60)] + [([*names[:2], "bad"], True) for _ in range(40)]
    rows += [(["other"], False) for _ in range(100)] + [(None, True), ([], False)]
    frame = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    found = {tuple(r["tokens"]) for r in urlrules.mined_rules(frame, 0.01, 20, 0.6, 1.2, 0.01).collect()}
    assert ("bad",) in found and all(len(t) <= 16 for t in found)


def test_no_token_of_a_long_url_is_left_out(spark):
    """A rule of the least telling of 31 tokens, and thirty that share a name."""
    names = [f"n{k:02}" for k in range(30)]
    rows = [([*names, "zz"], k % 10 != 0) for k in range(60)] + [(names, k % 50 != 0) for k in range(100)]
    frame = spark.createDataFrame(rows + [(["x"], False)] * 900, "tokens array<string>, bad boolean")
    rules, same = urlrules.mined(frame, 0.01, 20, 0.6, 1.2)
    assert {tuple(r["tokens"]) for r in rules.collect()} == {("n00",), ("n00", "zz"), ("zz",)}
    name = {r["token"]: r["name"] for r in same.collect()}
    assert {name[n] for n in names} == {"n00"} and name["zz"] == "zz" and name["x"] == "x"
    urls = spark.createDataFrame([(["n29", "u"],), (["u"],), ([],)], "tokens array<string>")
    urls = urlrules.named(urls.withColumn("all", F.col("tokens")), same, ["all"])
    found = {tuple(r["all"]): r["tokens"] for r in urls.collect()}
    assert found == {("n29", "u"): ["n00"], ("u",): [], (): []}
