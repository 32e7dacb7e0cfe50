from collections import defaultdict

from lanewise.llm import lines

BARE = " \t\n\v\f\r"


def plain(rows, min_sites):
    sites = defaultdict(set)
    for _, text, _, source in rows:
        for line in (text or "").split("\n"):
            if line.strip(BARE):
                sites[line.strip(BARE)].add(source)
    gone = {x for x, s in sites.items() if len(s) >= min_sites}
    return sorted(
        "\n".join(x for x in text.split("\n") if x.strip(BARE) not in gone)
        for _, text, _, _ in rows
        if text is not None
    )


def test_lines_of_many_sites_go(table):
    """Spreads from 1 to 30 sites; the sketch alone decides none near ten."""
    rows = []
    for site in range(30):
        own = [f"spread {k}" for k in range(1, 31) if site < k]
        rows.append((site, "\n".join([f"only here {site}", " ", *own, "  spread 30\t"]), "en", f"s{site}"))
        rows.append((100 + site, "\n".join(own), "en", f"s{site}"))
    docs = table(rows)
    found = lines.without_shared_lines(docs, min_sites=10)
    assert sorted(r["text"] for r in found.collect()) == plain(rows, 10)


def test_sketches_far_from_the_threshold(spark):
    wide = [(h, f"site {k}") for h, n in ((1, 3000), (2, 900), (3, 1000), (4, 1001)) for k in range(n)]
    df = spark.createDataFrame(wide, "hash long, site string")
    assert {r["hash"] for r in lines.shared_lines(df, 1000).collect()} == {1, 3, 4}


def test_odd_rows(odd, table):
    found = lines.without_shared_lines(odd, min_sites=2)
    assert found.columns == [*odd.columns, "n_removed_lines"]
    rows = found.collect()
    assert len(rows) == odd.count()
    gone = [r for r in rows if r["n_removed_lines"]]
    # The prose is on sites a, b and the one of all null sites.
    assert sorted(str(r["doc_id"]) for r in gone) == ["1", "1", "6", "None"]
    assert {r["text"] for r in gone} == {""}
    assert {r["doc_id"]: r["text"] for r in rows}[2] is None
    assert lines.without_shared_lines(odd.limit(0)).count() == 0


def test_copies_on_one_site_are_no_spread(table):
    docs = table([(k, "same line", "en", "a") for k in range(50)])
    found = lines.without_shared_lines(docs, min_sites=2)
    assert {r["text"] for r in found.collect()} == {"same line"}
