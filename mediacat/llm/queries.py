"""One query for each operator of this folder, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediacat.llm import (
    album_mixing, caption_language, caption_links, caption_quality, caption_toxicity, heldout_leaks,
    license_notices, link_rules, near_vectors,
    packing, surrogates, thread_repair, whitening,
)
from mediacat.llm.registry import QUERIES, captions, query, table  # noqa: F401


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(documents):
    result = packing.pack_captions(captions(documents), vocabulary_file(), end_id=2, capacity=1024)
    return result.select(
        F.col("media_item_id").alias("doc_id"), "piece", "start",
        F.col("length").cast("bigint").alias("length"),
        F.col("tokens_crc32").alias("ids_crc32"), "sequence_id", "offset",
    )


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    END) AS s
    FROM words
), shingles AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
    SELECT a.doc_id AS x, b.doc_id AS y
    FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
        AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM documents
    UNION
    SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT s.doc_id, len(s.s) AS n_shingles,
    (SELECT count(*) FROM links WHERE links.x = s.doc_id) AS n_links,
    (SELECT min(reach.y) FROM reach WHERE reach.x = s.doc_id) AS component_id
FROM sets s
"""


@query("op7_ngram_jaccard_join", OP7_SQL)
def op7_ngram_jaccard_join(spark, sf_dir):
    linked = caption_links.caption_links(
        captions(table(spark, sf_dir, "documents")), shingle_words=4, numerator=85, denominator=100
    )
    return linked.withColumnRenamed("media_item_id", "doc_id")


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


OP1_SQL = (
    r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), notices(label, base, t, f, k) AS (VALUES
"""
    + ",\n".join(
        f"('{t['label']}', {t['base']}, {_list(t['words'])}, {t['key_from']}, "
        f"{_list(t['words'][t['key_from'] : t['key_to'] + 1])})"
        for t in license_notices.templates()
    )
    + r"""
), spots AS (
    SELECT doc_id, w, label, base, t, unnest(list_filter(range(0, len(w)),
        lambda p: w[p + 1] = k[1] AND w[p + 1:p + len(k)] = k)) - f AS start
    FROM words JOIN notices ON list_has_all(w, k)
), places AS (
    SELECT doc_id, label, base, start,
        len(list_filter(range(0, len(t)), lambda i: start + i >= 0 AND w[start + i + 1] = t[i + 1]))::DOUBLE / len(t) AS share
    FROM spots
)
SELECT words.doc_id, len(any_value(w)) AS n_words,
    count(*) FILTER (base) AS n_base,
    min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR share >= 0.6), '') AS labels,
    coalesce(max(CASE WHEN base THEN 0.5::DOUBLE ELSE share END) FILTER (base OR share >= 0.6), 0::DOUBLE) AS score
FROM words LEFT JOIN places ON words.doc_id = places.doc_id
GROUP BY words.doc_id
"""
)


@query("op1_license_scan", OP1_SQL)
def op1_license_scan(spark, sf_dir):
    found = license_notices.scan_notices(captions(table(spark, sf_dir, "documents")))
    return found.drop("places").withColumnRenamed("media_item_id", "doc_id")


#: The rules of the contract: (host, path, verdict).
LINK_RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
]

OP2_SQL = (
    r"""
WITH parts AS (
    SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
    FROM pages
), rules(rule_host, rule_path, verdict) AS (VALUES
"""
    + ",\n".join(str(r) for r in LINK_RULES)
    + r"""
), judged AS (
    SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
        row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS place
    FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
        AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM judged WHERE place = 1
"""
)


@query("op2_url_filters", OP2_SQL)
def op2_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("media_item_id"), F.col("url").alias("media_google_url")
    )
    rules = spark.createDataFrame(LINK_RULES, "host string, path string, verdict string")
    return link_rules.judge_links(pages, rules).withColumnRenamed("media_item_id", "page_id")


def fold(column, parts: int):
    """crc32 of an id as text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    flags = table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1)
    flags = flags.select(F.col("doc_id").alias("media_item_id"), "toxic")
    scored = caption_toxicity.score_toxicity(captions(table(spark, sf_dir, "documents")), flags)
    return scored.withColumnRenamed("media_item_id", "doc_id").select(
        "doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


#: Key of the surrogates in the registered query; a user passes a secret one.
SURROGATE_KEY = "catalog"


@query("op9_pii")
def op9_pii(spark, sf_dir):
    replaced = surrogates.replace_entities(captions(table(spark, sf_dir, "documents")), SURROGATE_KEY)
    return replaced.select(
        F.col("media_item_id").alias("doc_id"), F.col("google_description").alias("text"), "n_entities"
    )


@query("op10_benchmark_decontamination")
def op10_benchmark_decontamination(spark, sf_dir):
    leaks = heldout_leaks.find_leaks(
        captions(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark").select("item_id", "text")
    )
    return leaks.withColumnRenamed("media_item_id", "doc_id")


@query("op6_embedding_near_dedup")
def op6_embedding_near_dedup(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("media_item_id"), F.col("label").alias("album_id"), "embedding"
    )
    return near_vectors.near_vectors(vectors, 0.93).withColumnRenamed("media_item_id", "vec_id")


@query("op3_language_id")
def op3_language_id(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    items = captions(documents)
    labelled = documents.filter(fold("doc_id", 5) != 0).select(
        F.col("doc_id").alias("media_item_id"), F.col("text").alias("google_description"), F.col("lang").alias("language")
    )
    found = caption_language.predict_languages(items, caption_language.learn_languages(labelled))
    return found.select(
        F.col("media_item_id").alias("doc_id"),
        F.coalesce(fold("media_item_id", 5) == 0, F.lit(False)).alias("held_out"),
        F.col("language").alias("lang_pred"), "score",
    )


@query("op4_quality_classifier")
def op4_quality_classifier(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("media_item_id"), F.col("text").alias("google_description"),
        F.col("source").alias("album_id"), F.col("lang").alias("language"),
    )
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("media_item_id"), "quality")
    scored = caption_quality.score_quality(items, marks, ["album_id", "language"])
    return scored.withColumnRenamed("media_item_id", "doc_id")


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("media_item_id"), "embedding")
    found = whitening.whiten_embeddings(vectors, components=4, scale=256)
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)")).withColumnRenamed("media_item_id", "vec_id")


@query("op12_source_mix")
def op12_source_mix(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    items = documents.select(
        F.col("doc_id").alias("media_item_id"), F.col("text").alias("google_description"),
        F.array("source").alias("album_ids"),
    )
    mix = album_mixing.mix_albums(items, share=1.5, weights=(3, 1, 2), most_copies=2)
    sources = mix.albums.select(F.col("album_id").alias("source"), F.col("size").alias("source_size"), "target")
    drawn = mix.items.withColumn("own", F.get("album_ids", F.lit(0)))
    return drawn.join(F.broadcast(sources), F.col("own").eqNullSafe(F.col("source"))).select(
        F.col("media_item_id").alias("doc_id"), "size", "source_size", "target", "taken", "copies", "source"
    )


def damaged(conversations):
    """Turns with the faults of the contract; NULLs are one space."""
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("damage"),
    ).filter("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(
        F.col("damage") == 2, F.translate("text", ".!?", "")
    ).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(F.col("damage") == 3, 2).otherwise(1))
    return rows.select(
        "conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.explode(times).alias("copy"),
    ).drop("copy")


#: One row per conversation and state is carried along: the least (cost, audit) so far.
OP13_SQL = r"""
WITH RECURSIVE remainders AS (
    SELECT list(r ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM range(256) AS n(i))
), keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS k
    FROM conversations
), hashed AS (
    SELECT *, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(octet_length(k)),
            lambda i: ('0x' || substr(hex(k), 2 * i + 1, 2))::BIGINT)),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 20 AS kind
    FROM keyed, remainders
), hurt AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
    FROM hashed WHERE kind <> 0
), placed AS (
    SELECT *, row_number() OVER w AS place,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
        lag(left(role, 1)) OVER w AS earlier, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ending
    FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), marked AS (
    SELECT conv_id, turn, role, text, place, left(role, 1) AS r,
        CASE WHEN ending = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(ending, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
        earlier IS NOT NULL AND earlier || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
    FROM placed
), counts AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal
    FROM marked GROUP BY conv_id
), steps AS (
    SELECT conv_id, 0::BIGINT AS place, s, CASE WHEN s = 'n' THEN 0 END::BIGINT AS cost, '' AS audit, ''::VARCHAR AS lines
    FROM counts, (VALUES ('n')) AS states(s)
    UNION ALL
    SELECT conv_id, place, s, best.cost, best.audit, best.lines FROM (
        SELECT m.conv_id, m.place, e.s, min({'cost': e.cost, 'audit': e.audit, 'lines': e.lines}) AS best
        FROM steps p JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.place = p.place + 1,
        LATERAL (SELECT * FROM (VALUES
            (p.s, p.cost, p.audit, p.lines),
            (CASE p.s WHEN 'u' THEN 'a' ELSE 'u' END, p.cost + 5, p.audit || 'I',
                p.lines || CASE p.s WHEN 'u' THEN 'assistant:' ELSE 'user:' END || chr(10)),
            (CASE WHEN p.s <> 'u' THEN 'a' END, p.cost + 10, p.audit || 'II',
                p.lines || 'user:' || chr(10) || 'assistant:' || chr(10))) AS i(s, cost, audit, lines)) AS i,
        LATERAL (SELECT * FROM (VALUES
            (i.s, i.cost + 2, i.audit || 'D', i.lines),
            (CASE WHEN m.fault IN ('-', 't') AND (i.s || m.r) IN ('ns', 'nu', 'su', 'au', 'ua') THEN m.r END,
                i.cost + CASE m.fault WHEN 't' THEN 5 ELSE 0 END, i.audit || 'K', i.lines || m.role || ':' || m.text || chr(10)),
            (CASE WHEN m.fault IN ('-', 't') THEN CASE i.s WHEN 'u' THEN 'a' ELSE 'u' END END,
                i.cost + CASE m.fault WHEN 't' THEN 6 ELSE 1 END, i.audit || 'R',
                i.lines || CASE i.s WHEN 'u' THEN 'assistant:' ELSE 'user:' END || m.text || chr(10))) AS e(s, cost, audit, lines)) AS e
        WHERE i.s IS NOT NULL AND e.s IS NOT NULL
        GROUP BY m.conv_id, m.place, e.s
    )
), ends AS (
    SELECT c.conv_id, min(CASE s
        WHEN 'u' THEN {'cost': cost + 5, 'audit': audit || 'I', 'lines': lines || 'assistant:' || chr(10)}
        WHEN 's' THEN {'cost': cost + 10, 'audit': audit || 'II', 'lines': lines || 'user:' || chr(10) || 'assistant:' || chr(10)}
        ELSE {'cost': cost, 'audit': audit, 'lines': lines} END) AS best
    FROM counts c JOIN steps p ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.place = c.n
    GROUP BY c.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
    coalesce(best.audit, '') AS audit,
    sha256(CASE WHEN coalesce(best.lines, '') = '' THEN '' ELSE best.lines[:-2] END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@query("op13_conversation_repair", OP13_SQL)
def op13_conversation_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    repair = thread_repair.repair_threads(damaged(conversations))
    found = repair.conversations.join(
        thread_repair.thread_digests(repair.turns).withColumnRenamed("conv_id", "digest_of"),
        F.col("conv_id").eqNullSafe(F.col("digest_of")),
    ).withColumnRenamed("conv_id", "repaired_of")
    every = conversations.select("conv_id").distinct()
    number = lambda name: F.coalesce(F.col(name), F.lit(0).cast("bigint")).alias(name)
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("repaired_of")), "left").select(
        "conv_id", *[number(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
