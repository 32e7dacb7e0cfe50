"""URL filters: fixed host rules, and token combinations mined from labels."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.stages import lower_ascii, staged

BAD = "label:bad"
#: A combination must occur in this share of the labelled urls, and in so many.
MIN_SUPPORT = 0.002
MIN_ROWS = 20
#: Share of bad labels among the urls with a combination, and how many times the
#: share among all labelled urls it must be.
MIN_CONFIDENCE = 0.3
MIN_LIFT = 2.0
#: How likely chance may give any one of the rules, over all combinations tried.
ALPHA = 0.01


@dataclass(frozen=True)
class HostRule:
    """A verdict for a host, its subdomains, and the paths that start alike."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?`` or ``#``; empty without ``://``."""
    return lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    # A null url takes the second branch, as one without a scheme does.
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def fixed_rule(host: Column, path: Column, rules: list[HostRule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a url: scheme, host labels, path words, query names.

    Each carries the part it comes from; numbers are one token, so that no
    token names a single page.
    """

    def tagged(tag: str, words: Column) -> Column:
        named = F.filter(words, lambda w: w != "")
        return F.transform(
            named, lambda w: F.concat(F.lit(tag), F.regexp_replace(w, r"^\d+$", "#"))
        )

    rest = lower_ascii(url)
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda q: F.substring_index(q, "=", 1))
    parts = F.concat(
        tagged("scheme:", F.array(F.regexp_extract(rest, r"^([a-z]+)://", 1))),
        tagged("host:", F.split(host(url), r"\.")),
        tagged("path:", F.split(lower_ascii(path(url)), r"[/._]")),
        tagged("query:", names),
        tagged("mark:", F.array(F.regexp_extract(rest, r"#(.*)$", 1))),
    )
    return F.coalesce(F.array_sort(F.array_distinct(parts)), F.array().cast("array<string>"))


def usual_tokens(rows: DataFrame, least: float) -> DataFrame:
    """``token, name`` of the tokens that at least ``least`` urls have.

    Tokens of exactly the same urls share a name, that of the first of them: a
    combination means the same whichever of them it holds, so it is mined
    once and not for every choice among them.
    """
    each = rows.select(F.explode(F.array_distinct("tokens")).alias("token"), "row")
    # Rows are numbers, each once: two hashes and the count tell sets apart.
    cover = [F.bit_xor(F.xxhash64("row", F.lit(seed))).alias(f"cover{seed}") for seed in (0, 1)]
    usual = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *cover)
    usual = usual.where(F.col("n") >= least)
    same = Window.partitionBy("n", "cover0", "cover1")
    return usual.select("token", F.min("token").over(same).alias("name"))


def named(sets: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """``sets`` with their ``tokens`` under the names of :func:`usual_tokens`.

    Other tokens go.  ``keys`` tell the rows of ``sets`` apart.
    """
    each = sets.select(*keys, F.explode("tokens").alias("token")).join(names, "token")
    kept = each.groupBy(*keys).agg(F.array_sort(F.collect_set("name")).alias("kept"))
    none = F.array().cast("array<string>")
    found = sets.join(kept, keys, "left")
    return found.withColumn("tokens", F.coalesce("kept", none)).drop("kept")


def surprise(share: Column, rate: float) -> Column:
    """Relative entropy of a share against the overall rate, in natural units.

    Chance gives a share at least as high among n rows with a probability of at
    most e to the power of minus n times this.
    """
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / max(1 - rate, 1e-12))).otherwise(0.0)
    return F.when(share > rate, share * F.log(share / rate) + rest).otherwise(0.0)


def mined_rules(labelled: DataFrame, *thresholds, **named_thresholds) -> DataFrame:
    """The rules of :func:`mined`."""
    return mined(labelled, *thresholds, **named_thresholds)[0]


def mined(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_rows: int = MIN_ROWS,
    min_confidence: float = MIN_CONFIDENCE,
    min_lift: float = MIN_LIFT,
    alpha: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``tokens, rarest, confidence, pages``: combinations whose urls are bad; and names.

    ``labelled`` has ``tokens, bad``.  FP-growth mines all frequent combinations,
    labels included; rules that lead to the bad label stay if support,
    confidence and lift reach their thresholds.  With ``alpha`` chance alone must
    be that unlikely to give any of the rules: the bound on a binomial tail is
    held against the number of combinations tried.  ``rarest`` is the token of
    the combination that the fewest labelled urls have.  Combinations are made
    of all tokens that enough urls have, however many a url holds, under the
    names of :func:`usual_tokens`, the second table: tokens that always come
    together count as one, so long urls that repeat do not multiply them.  A
    url holds a name if it holds any of its tokens.  Rows with a null label are
    left out; without any bad label there is no rule.
    """
    rows = staged(
        labelled.where("bad is not null").withColumn("row", F.monotonically_increasing_id()),
        "labelled-urls",
    )
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad")).first()
    kind = "tokens array<string>, rarest string, confidence double, pages bigint"
    if not size["bad"]:
        spark = labelled.sparkSession
        return spark.createDataFrame([], kind), spark.createDataFrame([], "token string, name string")
    least = max(min_rows, min_support * size["n"])
    names = staged(usual_tokens(rows, least), "token-names")
    rows = named(rows, names, ["row"])
    baskets = rows.select(
        F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD)))
        .otherwise(F.col("tokens"))
        .alias("items")
    )
    support = min(1.0, max(min_support, min_rows / size["n"]) * size["bad"] / size["n"])
    confidence = max(min_confidence, min_lift * size["bad"] / size["n"])
    model = FPGrowth(minSupport=support, minConfidence=min(1.0, confidence)).fit(baskets)
    sets = staged(model.freqItemsets, "itemsets")
    bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1))
    bad = bad.select(
        F.array_sort(F.array_remove("items", BAD)).alias("tokens"), F.col("freq").alias("hits")
    )
    whole = sets.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("pages"))
    rules = bad.join(whole, "tokens").withColumn("confidence", F.col("hits") / F.col("pages"))
    rules = rules.where((F.col("pages") >= least) & (F.col("confidence") >= confidence))
    if alpha is not None:
        tried = max(1, whole.where(F.col("pages") >= least).count())
        unlikely = surprise(F.col("confidence"), size["bad"] / size["n"]) * F.col("pages")
        rules = rules.where(unlikely >= math.log(tried / alpha))
    single = sets.where(F.size("items") == 1).select(
        F.col("items")[0].alias("token"), F.col("freq").alias("n")
    )
    parts = rules.select("tokens", "confidence", "pages", F.explode("tokens").alias("token"))
    rare = parts.join(single, "token").groupBy("tokens", "confidence", "pages")
    rare = rare.agg(F.min(F.struct("n", "token")).alias("least"))
    rules = rare.select("tokens", F.col("least.token").alias("rarest"), "confidence", "pages")
    return staged(rules, "rules"), names


def matched_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """For distinct ``tokens`` the best rule whose tokens they all hold.

    An inverted index lists each rule under its rarest token, so a url meets
    only rules that share this token.  The best rule has the highest confidence,
    then the most pages, then the first name.
    """
    index = rules.select(
        F.col("rarest").alias("token"), F.col("tokens").alias("of"), "confidence", "pages"
    )
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    met = met.where(F.size(F.array_except("of", "tokens")) == 0)
    best = F.struct((-F.col("confidence")).alias("c"), (-F.col("pages")).alias("p"), F.array_join("of", " ").alias("rule"))
    return met.groupBy("tokens").agg(F.min(best)["rule"].alias("mined_rule"))


def judged_urls(
    urls: DataFrame,
    labelled: DataFrame,
    rules: list[HostRule],
    url: str = "url",
    bad: str = "bad",
    alpha: float | None = ALPHA,
    **thresholds,
) -> DataFrame:
    """Add ``host, path, rule, mined_rule, verdict`` to every row of ``urls``.

    The longest fixed rule decides; where none fits, a url that holds all
    tokens of a mined rule is blocked and any other allowed.  ``labelled`` has
    urls with a boolean label ``bad``.  Urls with the same tokens are matched
    once.

    Nulls: a null url, or one without ``://``, has an empty host and path, fits
    no fixed rule, and is matched by the tokens it has (a null url has none).
    Repeated rows get the same verdict.  Empty tables are allowed on both sides.
    Other columns pass through, except those of the five names, which are
    replaced.
    """
    tokens = url_tokens(F.col(url))
    found, names = mined(
        labelled.select(tokens.alias("tokens"), F.col(bad).alias("bad")),
        alpha=alpha,
        **thresholds,
    )
    sets = urls.select(tokens.alias("__tokens")).distinct().withColumn("tokens", F.col("__tokens"))
    sets = staged(named(sets, names, ["__tokens"]), "token-sets")
    hits = matched_rules(sets.select("tokens").distinct(), found)
    hits = sets.join(hits, "tokens").select("__tokens", F.col("mined_rule").alias("__rule"))
    hits = staged(hits, "hits")
    added = ("host", "path", "rule", "mined_rule", "verdict")
    found = urls.withColumn("__tokens", tokens).withColumn("__url", F.col(url))
    found = found.drop(*(n for n in added if n != url))
    found = found.join(hits, "__tokens", "left")
    at, under = host(F.col("__url")), path(F.col("__url"))
    rule, verdict = fixed_rule(at, under, rules)
    own = F.when(F.col("__rule").isNotNull(), "block").otherwise("allow")
    return (
        found.withColumn("host", at)
        .withColumn("path", under)
        .withColumn("rule", rule)
        .withColumn("mined_rule", F.col("__rule"))
        .withColumn("verdict", F.coalesce(verdict, own))
        .drop("__tokens", "__url", "__rule")
    )
