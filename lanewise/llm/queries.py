"""Registered queries of the operators, and SQL for those that it can express."""

from __future__ import annotations

import re
import tempfile
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import (
    archives,
    cascade,
    decontaminate,
    langid,
    lines,
    mixing,
    ppm,
    prefixes,
    simhash,
    spans,
    toxicity,
    urlrules,
    variants,
)
from lanewise.llm.stages import lower_ascii

#: Texts that a Python worker holds at a time, about.
BATCH_BYTES = 8 << 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def with_folder(spark: SparkSession) -> None:
    """A folder of the process's own where a one-process session names none.

    On a cluster without ``spark.checkpoint.dir`` the operators raise an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None and re.match(r"local(\[|$)", sc.master):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lanewise-"))


def prepared(spark: SparkSession) -> None:
    """Settings for tables of long texts: a folder, and small batches for Python."""
    with_folder(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def query(name: str, sql: str | None = None):
    """Register ``read -> DataFrame``; ``read`` gives a table by its name."""

    def register(build: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepared(spark)
            return build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def hex16(c) -> F.Column:
    """A long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def held_out(doc_id, folds: int):
    """Whether the CRC of the id as text leaves no remainder."""
    name = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % folds == 0


# --- SQL of the queries -------------------------------------------------------

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

QUALITY_SQL = rf"""
    with d as (
        select row_number() over () as r, doc_id, coalesce(text, '') as text, {WORDS} as w
        from documents
    ), x as (
        select r, unnest(string_split(text, chr(10))) as line from d
    ), l as (
        select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
        from x where regexp_matches(line, '[^\x20\x09-\x0D]') group by r
    ), t as (
        select r, unnest(w) as w, generate_subscripts(w, 1) as i from d
    ), tri as (
        select r, i, w, lead(w) over o as w2, lead(w, 2) over o as w3 from t
        window o as (partition by r order by i)
    ), win as (
        select r, i, count(*) over (partition by r, w, w2, w3) as n from tri
        where w3 is not null
    ), rep as (
        select r, count(distinct p) as n_repeat_words
        from (select r, unnest([i, i + 1, i + 2]) as p from win where n > 1) group by r
    ), m as (
        select doc_id, len(w) as n_words,
               length(array_to_string(w, ''))::bigint as word_chars,
               (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
               coalesce(n_dup_lines, 0) as n_dup_lines,
               coalesce(n_repeat_words, 0) as n_repeat_words,
               length(text) - length(replace(text, '!', '')) as n_shouts,
               coalesce(n_lines, 0) as n_lines
        from d left join l using (r) left join rep using (r)
    ), b as (
        select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m
    )
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           not (base_failed or word_chars > 20 * n_words or 10 * n_symbols > n_words
                or 2 * n_shouts > n_words or 2 * n_dup_lines > n_lines) as kept
    from b
"""

LINES_SQL = f"""
    with d as (
        select row_number() over () as r, doc_id, text, source,
               string_split(text, chr(10)) as ls from documents
    ), l as (
        select r, coalesce(source, chr(0)) as site, unnest(ls) as line,
               generate_subscripts(ls, 1) as pos from d
    ), k as (
        select *, trim(line, {SPACE}) as bare from l
    ), shared as (
        select bare from k where bare <> '' group by bare
        having count(distinct site) >= {lines.MIN_SITES}
    ), kept as (
        select r, string_agg(line, chr(10) order by pos) as text, count(*) as n
        from k where bare not in (select bare from shared) group by r
    )
    select d.doc_id, case when d.text is not null then coalesce(kept.text, '') end as text,
           coalesce(len(d.ls) - coalesce(kept.n, 0), 0)::int as n_removed_lines
    from d left join kept using (r)
"""


#: What the mixing query rakes to; sources get their tempered shares.
TARGETS = {
    "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.1},
    "topic": {"prose": 0.8, "note": 0.1},
}
#: Share of all tokens that its sample has.
BUDGET = 0.3


def mix_sql() -> str:
    """Raking as a recursion over the cells, a step a sweep."""

    def share(marks: str) -> str:
        return (
            f"(length(text) - length(translate(text, '{marks}', ''))) * 100 "
            "/ greatest(length(text), 1)"
        )

    steps = [
        f"""d as materialized (
            select doc_id, coalesce(source, '{mixing.NONE}') as source,
                   coalesce(lang, '{mixing.NONE}') as lang,
                   case when text is null or text = '' then 'empty'
                        when {share("|")} >= 3 then 'table'
                        when {share("#*$%&<>{}=")} >= 3 then 'markup'
                        when length(text) < 1000 then 'note' else 'prose' end as topic,
                   len({WORDS}) as tokens,
                   cast('0x' || substr(md5('1:' || coalesce(doc_id::varchar, text, '')), 1, 8)
                        as bigint) / 4294967296.0 as u
            from documents)""",
        "c as materialized (select source, lang, topic, sum(tokens)::double as tokens, "
        "coalesce(sum(tokens) / nullif(sum(sum(tokens)) over (), 0), 0)::double as part "
        "from d group by source, lang, topic)",
    ]
    sweep = "(select * replace (0::double as off) from r where off > " + (
        f"{mixing.TOLERANCE} and k < {mixing.SWEEPS})"
    )
    for m in mixing.MARGINS:
        named = TARGETS.get(m, {})
        rest = max(0.0, round(1 - sum(named.values()), 9))
        given = ", ".join(f"('{v}', {s}::double)" for v, s in named.items()) or "(null, 0::double)"
        steps.append(
            f"""goal_{m} as materialized (
                select {m}, s / sum(s) over () as share from (
                    select {m}, coalesce(share, {rest} * t / sum(t) over ()) as s from (
                        select {m}, share,
                               case when share is null then pow(n, {mixing.TEMPER}) end as t
                        from (select {m}, sum(tokens) as n from c group by {m}
                              having sum(tokens) > 0)
                        left join (values {given}) g({m}, share) using ({m}))))"""
        )
        scaled = (
            f"(select x.*, coalesce(coalesce(g.share, 0) / nullif(sum(w) over "
            f"(partition by x.{m}), 0), 0) as s from {sweep} x left join goal_{m} g on x.{m} = g.{m})"
        )
        sweep = (
            "(select k, source, lang, topic, part, least(w * s, part / "
            f"{BUDGET}) as w, greatest(off, case when w > 0 and w * s < part / {BUDGET} "
            f"then abs(s - 1) else 0 end) as off from {scaled})"
        )
    steps.append(
        "r as (select 0 as k, source, lang, topic, part, part as w, 9::double as off from c "
        "union all select k + 1, source, lang, topic, part, w, max(off) over () "
        f"from {sweep})"
    )
    steps.append(
        f"p as (select source, lang, topic, coalesce(least(w / nullif(part / {BUDGET}, 0), 1), 0) "
        "as p from r where k = (select max(k) from r))"
    )
    return (
        "with recursive "
        + ", ".join(steps)
        + " select doc_id, source, lang, topic, tokens, round(p, 6) as probability, "
        "u < p as sampled from d join p using (source, lang, topic)"
    )


#: CRC-32 of a text, byte by byte; the table is made by its polynomial.
CRC_TABLE = """(
    select list(list_reduce(range(8), lambda c, _: case when c & 1 = 1
                then xor(c >> 1, 3988292384) else c >> 1 end, b) order by b)
    from range(256) t(b)
)"""


def crc32_sql(text: str, table: str) -> str:
    """The CRC as an expression; ``table`` is a column with ``CRC_TABLE``."""
    code = f"hex(encode({text}))"
    byte = f"('0x' || substr({code}, 2 * i + 1, 2))::bigint"
    return (
        f"xor(list_reduce(list_transform(range(length({code}) // 2), lambda i: {byte}), "
        f"lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
    )


VARIANTS_SQL = f"""
    with recursive k as materialized (select {CRC_TABLE} as tab),
    runs as (
        select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+'))
               as run from documents
    ), low as (
        select coalesce(doc_id::varchar, '') || ':' as doc,
               translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
        from runs where length(run) >= 7
    ), hashed as (
        select run, {crc32_sql("doc || run", "tab")} as h from low, k
    ), spoken as (
        select case when h % 31 = 0 then substr(run, 1, h % length(run))
                    || substr(run, h % length(run) + 2) else run end as word from hashed
    ), words as materialized (
        select word, count(*) as n from spoken where length(word) >= 7
        group by word having count(*) >= 2
    ), cut as materialized (
        select word, n, i, substr(word, 1, i) || '*' || substr(word, i + 2) as pattern,
               substr(word, 1, i) || substr(word, i + 2) as less
        from words, lateral unnest(range(length(word))) as t(i)
    ), near as materialized (
        select a.word, b.word as near, b.n as near_n from cut a join cut b using (pattern)
        where a.word <> b.word
        union
        select a.word, b.word, b.n from cut a join words b on a.less = b.word
        union
        select b.word, a.word, a.n from cut a join words b on a.less = b.word
    ), met as (
        select word, count(*) as n_near, max(near_n) as form_n from near group by word
    ), judged as materialized (
        select w.word, w.n, coalesce(n_near, 0) as n_near,
               case when form_n >= 10 * w.n then form_n end as form_n,
               (select min(near) from near x where x.word = w.word and x.near_n = form_n
                and form_n >= 10 * w.n) as form
        from words w left join met m on w.word = m.word
    ), steps as (
        select word, form as top from judged where form is not null
        union all
        select s.word, j.form from steps s join judged j on j.word = s.top
        where j.form is not null
    ), ends as (
        select s.word, s.top from steps s join judged j on j.word = s.top where j.form is null
    )
    select word, form, coalesce(top, word) as root, n, n_near, form_n
    from judged left join ends using (word)
"""


TRIE_SQL = rf"""
    with k as materialized (select {CRC_TABLE} as tab),
    said as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
        from conversations where conv_id is not null
    ), own as (
        select conv_id, row_number() over (
                   partition by conv_id order by turn nulls first, role, text) as pos,
               sha256(length(role) || ':' || role || text) as turn_hash,
               len({WORDS})::bigint as words
        from said
    ), convs as (
        select conv_id, conv_id - conv_id % 20 as base,
               {crc32_sql("conv_id::varchar", "tab")} % 4 as h
        from (select distinct conv_id from own), k
    ), built as (
        select c.conv_id, 0 as part, o.pos, turn_hash, words
        from convs c join own o on o.conv_id = c.base where o.pos <= c.h
        union all
        select c.conv_id, 1, o.pos, turn_hash, words
        from convs c join own o using (conv_id) where o.pos > c.h
    ), turns as (
        select conv_id, words, turn_hash,
               row_number() over (partition by conv_id order by part, pos) as depth
        from built
    ), path as materialized (
        select conv_id, 0 as depth, '' as node, null as above, 0 as words from convs
        union all
        select conv_id, depth, sha256(string_agg(turn_hash, '') over o),
               coalesce(sha256(string_agg(turn_hash, '') over (o rows between
                   unbounded preceding and 1 preceding)), ''), words
        from turns window o as (partition by conv_id order by depth)
    ), ends as (
        select p.conv_id, p.node from path p join (
            select conv_id, max(depth) as depth from path group by conv_id
        ) using (conv_id, depth)
    ), nodes as materialized (
        select node, min(depth) as depth, min(above) as above, min(conv_id) as conv_id,
               count(*) as n_convs, max(words) as words
        from path group by node
    ), kids as (
        select above as node, count(*) as n_children from nodes where depth > 0 group by above
    ), full_nodes as (
        select n.*, coalesce(n_children, 0) as n_children from nodes n left join kids using (node)
    ), sums as (
        select p.node, sum((f.n_children = 0)::int)::bigint as n_leaves,
               sum((f.n_convs - 1) * f.words)::bigint as saved_tokens
        from full_nodes f join path p on p.conv_id = f.conv_id and p.depth <= f.depth
        group by p.node
    ), shas as (
        select node, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256
        from ends group by node
    )
    select f.conv_id, f.depth, up.conv_id as parent_conv_id, f.n_convs, f.n_children,
           n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) as ends_sha256
    from full_nodes f join sums using (node) left join shas using (node)
    left join nodes up on up.node = f.above and f.depth > 0
"""


# --- Queries ------------------------------------------------------------------


def shares_of(spark: SparkSession, shares: dict[str, float]) -> DataFrame:
    """``value, share`` as a table."""
    rows = ", ".join(f"('{value}', {share}D)" for value, share in shares.items())
    return spark.sql(f"select * from values {rows} as t(value, share)")


@query("op1_mix_sources", mix_sql())
def op1(read):
    """Raked weights, calibrated probabilities and the draw for every document."""
    docs = read("documents")
    targets = {margin: shares_of(docs.sparkSession, given) for margin, given in TARGETS.items()}
    mixed = mixing.mix(docs, targets, budget=BUDGET, keep=["doc_id", "source", "lang"])
    return mixed.select(
        "doc_id",
        F.coalesce("source", F.lit(mixing.NONE)).alias("source"),
        F.coalesce("lang", F.lit(mixing.NONE)).alias("lang"),
        "mix.topic",
        "mix.tokens",
        F.round("mix.probability", 6).alias("probability"),
        "mix.sampled",
    )


@query("op2_simhash_pigeonring")
def op2(read):
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(read("documents"), shingle=4, max_bits=4)
    return found.select("doc_id", hex16("print").alias("fingerprint"), "component_id")


@query("op3_decontaminate")
def op3(read):
    """Benchmark items that every document holds."""
    found = decontaminate.leaks(read("documents"), read("benchmark"))
    best = F.array_max(
        F.transform("leaks", lambda x: F.struct(x["similarity"], -x["item_id"]))
    )
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.sort_array(F.transform("leaks", lambda x: x["item_id"])).alias("item_ids"),
        F.round(best["similarity"], 6).alias("best_similarity"),
    )


@query("op4_line_spread", LINES_SQL)
def op4(read):
    """Documents without the lines that many sites share."""
    return lines.without_shared_lines(read("documents")).select(
        "doc_id", "text", "n_removed_lines"
    )


@query("op5_sentence_spans")
def op5(read):
    """Documents without sentences of repeated runs."""
    return spans.without_repeated_sentences(read("documents")).select(
        "doc_id", "text", "n_sentences", "n_removed_sentences"
    )


HOST_RULES = [
    urlrules.HostRule("allow", "org", "/"),
    urlrules.HostRule("block", "example.org", "/es/"),
    urlrules.HostRule("block", "example.org", "/en/1"),
    urlrules.HostRule("allow", "com", "/fr/"),
    urlrules.HostRule("block", "com", "/de/"),
]


@query("op6_url_rules")
def op6(read):
    """Verdict on every url; labels are those of the document it leads to."""
    pages = read("pages").select("page_id", "url")
    number = F.regexp_extract(urlrules.path(F.col("url")), r"^/[^/]*/(\d+)", 1)
    linked = pages.select("url", number.try_cast("bigint").alias("doc_id"))
    labels = read("labels").select("doc_id", (F.col("quality") == 0).alias("bad"))
    labelled = linked.join(labels, "doc_id").select("url", "bad")
    judged = urlrules.judged_urls(pages, labelled, HOST_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "mined_rule")


@query(
    "op7_arc_to_warc",
    """
    with p as (
        select page_id, encode(coalesce(html, '')) as body from pages
    ), d as (
        select page_id, octet_length(body) as payload_bytes, sha1(body) as payload_digest
        from p
    ), k as (
        select payload_digest, max(page_id) as kept from d
        where payload_bytes >= 1000 group by payload_digest
    )
    select d.page_id, d.payload_bytes, d.payload_digest,
           case when k.kept <> d.page_id then 'revisit' else 'response' end as record_type,
           case when k.kept <> d.page_id then k.kept end as refers_to
    from d left join k on d.payload_digest = k.payload_digest
                       and d.payload_bytes >= 1000
    """,
)
def op7(read):
    """Digest and record of every page after the way through both formats."""
    return archives.archived_pages(read("pages"))


@query("op8_ppm_scores")
def op8(read):
    """Scores of every document under a model of nine tenths of them."""
    docs = read("documents")
    found = ppm.ppm_scores(docs, held_out(F.col("doc_id"), 10))
    return found.withColumnRenamed("id", "doc_id")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@query("op9_quality_cascade", QUALITY_SQL)
def op9(read):
    """Measures and verdict of every document."""
    judged = cascade.quality_cascade(read("documents"), measures=MEASURES)
    base_failed = (F.col("quality.n_words") < 50) | (
        100 * F.col("quality.n_repeat_words") > 50 * F.col("quality.n_words")
    )
    return judged.select(
        "doc_id",
        *(F.col(f"quality.{m}").alias(m) for m in MEASURES),
        base_failed.alias("base_failed"),
        (~base_failed & F.col("quality.kept")).alias("kept"),
    )


@query("op10_toxic_lexicon")
def op10(read):
    """Toxicity of every document, learned from four fifths of the labels."""
    fold = held_out(F.col("doc_id"), 5)
    scored = toxicity.toxicity(read("documents"), read("labels").where(~fold))
    return scored.select(
        "doc_id",
        fold.alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
    )


#: Words of variants have so many letters and occur so often.
MIN_LETTERS, MIN_TIMES = 7, 2


@query("op11_spelling_variants", VARIANTS_SQL)
def op11(read):
    """Words of all documents, some misspelled by rule, and the forms they belong to."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[A-Za-z\u00C0-\u00FF]+"), 0)
    runs = read("documents").select("doc_id", F.explode(found).alias("run"))
    runs = runs.where(F.length("run") >= MIN_LETTERS)
    runs = runs.select("doc_id", lower_ascii(F.col("run")).alias("run"))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    h = F.crc32(F.concat(doc, F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(
        F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run"))
    )
    spoken = runs.withColumn("h", h).select(
        F.when(F.col("h") % 31 == 0, less).otherwise(F.col("run")).alias("word")
    )
    words = (
        spoken.where(F.length("word") >= MIN_LETTERS)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= MIN_TIMES)
    )
    return variants.spelling_variants(words)


@query("op12_language_filters")
def op12(read):
    """Language of every document, learned from two thirds of them."""
    docs = read("documents")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    fold = F.crc32(name.cast("binary")) % 3 == 1
    found = langid.languages(docs, docs.where(~fold))
    return found.select(
        "doc_id",
        fold.alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )


#: Conversations of one twenty start with up to three turns of its first.
SHARED_HEADS = prefixes.Heads(20, 3, lambda conv_id: zlib.crc32(str(conv_id).encode()) % 4)


@query("op13_prefix_trie", TRIE_SQL)
def op13(read):
    """All nodes of the trie of the rebuilt conversations."""
    return prefixes.prefix_trie(read("conversations"), SHARED_HEADS)
