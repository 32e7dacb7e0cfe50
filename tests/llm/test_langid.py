import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import langid, queries

EN = "the harbour wakes before the town does and the boats come in with the tide"
DE = "der Hafen erwacht vor der Stadt und die Boote kommen mit der Flut herein"
EL = "το λιμάνι ξυπνά πριν από την πόλη και οι βάρκες έρχονται με την παλίρροια"
ZH = "港口在城镇之前醒来船只随着潮水进来没有人记录谁出去了"
SAMPLES = {"en": EN, "de": DE, "el": EL, "zh": ZH}


def trained(table):
    return table([(k, f"{text} {text.split(' ')[k % len(text.split(' '))]}", lang, "a")
                  for lang, text in SAMPLES.items() for k in range(20)])


def test_each_text_gets_its_language(table):
    asked = table([(k, text[10:], "xx", "b") for k, text in enumerate(SAMPLES.values())])
    rows = {r["doc_id"]: r["language"] for r in langid.languages(asked, trained(table)).collect()}
    assert [rows[k]["lang"] for k in range(4)] == list(SAMPLES)
    assert all(0.9 < rows[k]["score"] <= 1 for k in range(4))


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return [f" {w} "[k : k + n] for n in langid.ORDERS for w in words for k in range(len(w) + 3 - n)]


@pytest.mark.parametrize("text", ["a", "Ab c", EN, "x1y--zz\nq", "", "12 !", "ÉÈ é" * 50])
def test_grams_are_those_of_padded_words(text):
    found = [] if not text else [g for _, (g, _) in zip(langid.ORDERS, langid.grams([text.lower()], [0]), strict=False)]
    n = sum(map(len, found))
    assert n == len(plain_grams(text))
    assert len({int(x) for g in found for x in g}) == len(set(plain_grams(text)))


def test_filters_lose_no_gram_and_count_chance_hits(table):
    filters = langid.learned_filters(trained(table), "text", "lang")
    total, found = filters.hits([EN, DE, None, ""])
    assert total[2] == total[3] == 0
    at = {k: i for i, k in enumerate(filters.languages)}
    assert found[0, at["en"]] == total[0] == len(plain_grams(EN))
    assert found[1, at["de"]] == total[1]
    # Random n-grams hit as often as the filled rows say.
    rng = np.random.default_rng(3)
    grams = rng.integers(0, 2**63, 200_000).astype(np.uint64)
    masks = np.bitwise_and.reduce([filters.table[r] for r in langid.gram_rows(grams, len(filters.table))])
    hit = np.unpackbits(masks, axis=1, bitorder="little").mean(axis=0)[: len(at)]
    assert np.allclose(hit, filters.chance, atol=2e-3)


def test_long_texts_in_pieces_are_read_whole(table, monkeypatch):
    filters = langid.learned_filters(trained(table), "text", "lang")
    whole = filters.hits([EN * 50 + " " + DE, DE, ZH * 99])
    monkeypatch.setattr(langid, "PIECE", 40)
    parts = filters.hits([EN * 50 + " " + DE, DE, ZH * 99])
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_more_languages_than_a_byte_has_bits(table):
    rng = np.random.default_rng(5)
    alphabets = {f"l{k:02}": "".join(chr(0x4E00 + 30 * k + j) for j in range(25)) for k in range(21)}
    rows = [(k, " ".join("".join(rng.choice(list(a), 5)) for _ in range(80)), lang, "s")
            for lang, a in alphabets.items() for k in range(3)]
    asked = table([(k, a[:20], None, "s") for k, a in enumerate(alphabets.values())])
    docs = table([(k, " ".join(t[1] for t in rows if t[2] == lang)[:200], None, "s") for k, lang in enumerate(alphabets)])
    found = {r["doc_id"]: r["language"]["lang"] for r in langid.languages(docs, table(rows)).collect()}
    assert found == dict(enumerate(alphabets))
    assert langid.languages(asked, table(rows)).count() == 21


def test_large_languages_are_sampled_by_hash(table):
    rows = table([(k, f"word number {k}", "en", "a") for k in range(2_000)] + [(9, "wort", "de", "a")])
    kept = langid.labelled_sample(rows, "text", "lang", 200).groupBy("lang").count().collect()
    kept = {r["lang"]: r["count"] for r in kept}
    assert 120 < kept["en"] < 280 and kept["de"] == 1


def test_odd_rows(odd, table):
    seen = langid.languages(odd, trained(table))
    assert seen.columns == [*odd.columns, "language"]
    rows = seen.collect()
    assert len(rows) == odd.count()
    for r in rows:
        letters = r["text"] is not None and any(map(str.isalpha, r["text"]))
        assert (r["language"]["lang"] == "und") == (not letters)
        assert 0 <= r["language"]["score"] <= 1
    nothing = langid.languages(odd, odd.limit(0)).collect()
    assert {r["language"]["lang"] for r in nothing} == {"und"}
    assert langid.languages(odd.limit(0), odd).count() == 0
    unknown = langid.languages(table([(1, "ქართული")]), trained(table)).first()["language"]
    assert unknown["lang"] in SAMPLES and unknown["score"] == 0
    again = langid.languages(seen.drop("lang").withColumnRenamed("language", "lang"), trained(table), into="lang")
    assert again.count() == len(rows)


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not there")
def test_held_out_languages_are_found(spark):
    found = queries.QUERIES["op12_language_filters"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert found.where(F.col("lang_pred") == "und").count() < 10
