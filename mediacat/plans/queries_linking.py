"""Queries about files, names and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediacat.functions import ids, names
from mediacat.operators import (
    albums, files as file_ops, linking, media as media_ops, reports, time_match,
)
from mediacat.plans import adapters as a, oracle_tables as o
from mediacat.plans.registry import query

_LINK_TABLES = (o.SHAPED, o.MEDIA, o.SIDECARS, o.PARSED_NAMES, o.LINKED)


def _names(spark, sf_dir):
    return a.files(spark, sf_dir, sizes=False)


def _media_and_sidecars(spark, sf_dir):
    files = _names(spark, sf_dir)
    sidecars = file_ops.parse_sidecar_names(file_ops.sidecar_files(files))
    return file_ops.media_files(files), sidecars


def _sidecars(spark, sf_dir):
    return file_ops.parse_sidecar_names(file_ops.sidecar_files(_names(spark, sf_dir)))


def _linked(files):
    """(links, parsed sidecars) of one inventory."""
    sidecars = file_ops.parse_sidecar_names(file_ops.sidecar_files(files))
    return linking.link_sidecars(file_ops.media_files(files), sidecars), sidecars


def _links(spark, sf_dir):
    return _linked(_names(spark, sf_dir))[0]


@query("file_features", o.with_tables(
    o.SHAPED, o.MEDIA, o.SIDECARS, o.FILES,
    select=f"""SELECT path, size, {o.kind("album", "name")} AS kind, {o.stem("name")} AS stem,
      {o.suffix("name")} AS suffix, name LIKE '.%' AS is_hidden FROM files"""))
def file_features(spark, sf_dir):
    return file_ops.classify_files(a.files(spark, sf_dir)).select(
        "path", "size", "kind", "stem", "suffix", "is_hidden"
    )


@query("files_by_kind", o.with_tables(
    o.SHAPED, o.MEDIA, o.SIDECARS, o.FILES,
    select=f"""SELECT album, {o.kind("album", "name")} AS kind, count(*) AS files,
      sum(size)::BIGINT AS bytes FROM files GROUP BY ALL"""))
def files_by_kind(spark, sf_dir):
    return (
        file_ops.classify_files(a.files(spark, sf_dir))
        .groupBy("album", "kind")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    )


_NAMED = """named AS (
  SELECT doc_id AS id, 'document' AS origin, media_name AS name FROM shaped
  UNION ALL SELECT doc_id, 'sidecar', sidecar_name FROM shaped WHERE sidecar_name IS NOT NULL
  UNION ALL SELECT page_id, 'page', replace(string_split(url, '/')[-1], '?', '(7).') FROM pages
)"""


@query("name_features", o.with_tables(
    o.SHAPED, _NAMED,
    select=f"""SELECT id, origin, name, {o.real_ext(f"lower({o.suffix('name')})")} AS has_real_ext,
      {o.ext_key(f"lower({o.suffix('name')})")} AS ext_key, {o.numeric_suffix("name")} AS numeric_suffix,
      {o.drop_numeric("name")} AS without_number, {o.strip_edited("name")} AS without_edit,
      (name LIKE '%(2)' OR name LIKE '%(2).%') AS number_fits FROM named"""))
def name_features(spark, sf_dir):
    docs = a.shaped(a.table(spark, sf_dir, "documents"))
    from_docs = docs.select(
        F.col("doc_id").alias("id"),
        F.inline(F.array(
            F.struct(F.lit("document").alias("origin"), F.col("media_name").alias("name")),
            F.struct(F.lit("sidecar").alias("origin"), F.col("sidecar_name").alias("name")),
        )),
    ).filter(F.col("name").isNotNull())
    last = F.substring_index("url", "/", -1)
    pages = a.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.lit("page").alias("origin"),
        F.replace(last, F.lit("?"), F.lit("(7).")).alias("name"),
    )
    name = F.col("name")
    low = names.lower_suffix(name)
    return from_docs.unionByName(pages).select(
        "id", "origin", "name",
        names.has_real_ext(low).alias("has_real_ext"),
        names.ext_key(low).alias("ext_key"),
        names.numeric_suffix(name).alias("numeric_suffix"),
        names.drop_numeric(name).alias("without_number"),
        names.strip_edited(name).alias("without_edit"),
        names.suffix_in_name(name, F.lit("(2)")).alias("number_fits"),
    )


@query("sidecar_names", o.with_tables(
    o.SHAPED, o.SIDECARS, o.PARSED_NAMES,
    select="SELECT path, album, filename, extension, numeric_suffix FROM names"))
def sidecar_names(spark, sf_dir):
    return _sidecars(spark, sf_dir)


@query("normalized_texts", """SELECT doc_id,
    md5(replace(nfc_normalize(replace(text, 'é', 'e' || chr(769))), chr(92), '/')) AS normal_md5,
    strlen(nfc_normalize(replace(text, 'é', 'e' || chr(769)))) AS normal_bytes
  FROM documents""")
def normalized_texts(spark, sf_dir):
    spread = F.replace("text", F.lit("é"), F.lit("é"))
    normal = names.normalize_path(spread)
    return a.table(spark, sf_dir, "documents").select("doc_id", normal.alias("normal")).select(
        "doc_id",
        F.md5(F.encode("normal", "UTF-8")).alias("normal_md5"),
        F.octet_length("normal").cast("bigint").alias("normal_bytes"),
    )


def _phase_sql(phase: int) -> str:
    # Every phase alone, without the earlier ones having taken media away.
    alone = (
        o.LINKED.split(", rest3 AS")[0]
        .replace("WHERE path NOT IN (SELECT path FROM phase1)", "")
        .replace("WHERE path NOT IN (SELECT path FROM phase2)", "")
    )
    return o.with_tables(
        o.SHAPED, o.MEDIA, o.SIDECARS, o.PARSED_NAMES, alone,
        select=f"SELECT path, sidecar_path, phase FROM phase{phase}",
    )


@query("link_phase1", _phase_sql(1))
def link_phase1(spark, sf_dir):
    return linking.match_phase1(*_media_and_sidecars(spark, sf_dir))


@query("link_phase2", _phase_sql(2))
def link_phase2(spark, sf_dir):
    return linking.match_phase2(*_media_and_sidecars(spark, sf_dir))


@query("link_phase3", _phase_sql(3))
def link_phase3(spark, sf_dir):
    return linking.match_phase3(*_media_and_sidecars(spark, sf_dir))


@query("link_phase4", o.with_tables(
    *_LINK_TABLES, select="SELECT path, sidecar_path, phase FROM links WHERE phase = 4"))
def link_phase4(spark, sf_dir):
    return _links(spark, sf_dir).filter("phase = 4").select("path", "sidecar_path", "phase")


#: Chains: media and sidecars whose names begin with one another, of which some lack.
_CHAINS = """chain AS (
  SELECT 'Album ' || doc_id % 10 AS album, doc_id % 5 <> 2 AS has_sidecar,
    'CHAIN_' || lpad((doc_id // 160)::VARCHAR, 6, '0') || '_' || repeat('a', (doc_id // 10 % 16)::INT)
      || CASE WHEN doc_id // 10 % 3 = 1 THEN 'b' ELSE '' END AS base,
    'CHAIN_' || lpad((doc_id // 160)::VARCHAR, 6, '0') AS tree FROM documents
), chain_media AS (
  SELECT album, tree, base, album || '/' || base || '.nef' AS path,
    row_number() OVER (PARTITION BY album, tree ORDER BY album || '/' || base || '.nef') AS turn FROM chain
), chain_sidecars AS (
  SELECT album, tree, base, album || '/' || base || '.nef.json' AS path FROM chain WHERE has_sidecar
), options AS (
  SELECT m.album, m.tree, m.turn, m.path,
    coalesce(list(s.path) FILTER (starts_with(m.base, s.base)), []) AS begins,
    coalesce(list(s.path) FILTER (starts_with(s.base, m.base) AND s.base <> m.base), []) AS longer
  FROM chain_media m LEFT JOIN chain_sidecars s ON m.album = s.album AND m.tree = s.tree GROUP BY ALL
), turns AS (
  SELECT DISTINCT album, tree, 0::BIGINT AS turn, NULL::VARCHAR AS path, NULL::VARCHAR AS pick, []::VARCHAR[] AS taken FROM chain
  UNION ALL
  SELECT album, tree, turn, path, pick, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END FROM (
    SELECT o.album, o.tree, o.turn, o.path, taken,
      CASE len(free) WHEN 1 THEN free[1] WHEN 0 THEN CASE WHEN len(rest) = 1 THEN rest[1] END END AS pick
    FROM (SELECT o.*, t.taken, list_filter(o.begins, lambda x: NOT list_contains(t.taken, x)) AS free,
        list_filter(o.longer, lambda x: NOT list_contains(t.taken, x)) AS rest
      FROM turns t JOIN options o ON t.album = o.album AND t.tree = o.tree AND o.turn = t.turn + 1) o))"""


@query("link_contested", f"""WITH RECURSIVE {_CHAINS}
    SELECT path, album, pick AS sidecar_path, CASE WHEN pick IS NOT NULL THEN 4 END AS phase FROM turns WHERE turn > 0""")
def link_contested(spark, sf_dir):
    doc, step = F.col("doc_id"), F.floor(F.col("doc_id") / 10)
    base = F.concat(
        F.lit("CHAIN_"), F.lpad(F.floor(doc / 160).cast("string"), 6, "0"), F.lit("_"),
        F.repeat(F.lit("a"), (step % 16).cast("int")), F.when(step % 3 == 1, "b").otherwise(""),
    )
    rows = a.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("Album "), (doc % 10).cast("string")).alias("album"), F.concat(base, F.lit(".nef")).alias("name")
    )
    path = F.concat("album", F.lit("/"), "name").alias("path")
    side = rows.filter(doc % 5 != 2).select("album", F.concat("name", F.lit(".json")).alias("name"))
    media = rows.select(path, "album", "name")
    return linking.link_sidecars(media, file_ops.parse_sidecar_names(side.select(path, "album", "name")))


@query("link_sidecars", o.with_tables(
    *_LINK_TABLES, select="SELECT path, album, sidecar_path, phase FROM links"))
def link_sidecars(spark, sf_dir):
    return _links(spark, sf_dir)


@query("orphan_media", o.with_tables(
    *_LINK_TABLES, select="SELECT path, album FROM links WHERE sidecar_path IS NULL"))
def orphan_media(spark, sf_dir):
    return linking.orphan_media(_links(spark, sf_dir))


@query("orphan_sidecars", o.with_tables(
    *_LINK_TABLES, select="""SELECT path, album FROM sidecars
      WHERE path NOT IN (SELECT sidecar_path FROM links WHERE sidecar_path IS NOT NULL)"""))
def orphan_sidecars(spark, sf_dir):
    links, sidecars = _linked(_names(spark, sf_dir))
    return linking.orphan_sidecars(sidecars, links)


@query("unprocessed_files", o.with_tables(
    *_LINK_TABLES, o.FILES, select=f"""SELECT kind, path FROM (
        SELECT path, {o.kind("album", "name")} AS kind FROM files)
      WHERE kind = 'other' OR (kind = 'sidecar' AND path NOT IN
        (SELECT sidecar_path FROM links WHERE sidecar_path IS NOT NULL))"""))
def unprocessed_files(spark, sf_dir):
    files = _names(spark, sf_dir)
    return linking.unprocessed(files, _linked(files)[0])


_RATES = """count(*) AS media, count(*) FILTER (phase = 1) AS phase1, count(*) FILTER (phase = 2) AS phase2,
  count(*) FILTER (phase = 3) AS phase3, count(*) FILTER (phase = 4) AS phase4,
  count(*) FILTER (phase <= 3) AS matched_exact, count(phase) AS matched,
  round(100.0::DOUBLE * count(phase) / count(*), 1) AS match_rate"""


@query("match_rate_by_album", o.with_tables(
    *_LINK_TABLES, select=f"SELECT album, {_RATES} FROM links GROUP BY album"))
def match_rate_by_album(spark, sf_dir):
    return reports.match_statistics(_links(spark, sf_dir), ["album"])


@query("match_statistics", o.with_tables(*_LINK_TABLES, select=f"SELECT {_RATES} FROM links"))
def match_statistics(spark, sf_dir):
    return reports.match_statistics(_links(spark, sf_dir))


@query("discovery_stats", o.with_tables(
    *_LINK_TABLES, o.FILES, select=f"""
      SELECT 'discovered_' || {o.kind("album", "name")} AS measure, count(*) AS value FROM files GROUP BY 1
      UNION ALL SELECT CASE WHEN phase IS NULL THEN 'unmatched_media' ELSE 'matched_phase' || phase END, count(*)
        FROM links GROUP BY 1
      UNION ALL SELECT 'unmatched_sidecars', count(*) FROM sidecars
        WHERE path NOT IN (SELECT sidecar_path FROM links WHERE sidecar_path IS NOT NULL)"""))
def discovery_stats(spark, sf_dir):
    files = _names(spark, sf_dir)
    links, sidecars = _linked(files)
    return reports.discovery_stats(files, links, sidecars)


@query("discovery_counters", o.with_tables(
    *_LINK_TABLES, o.FILES, select=f"""SELECT
      count(*) FILTER (kind IN ('media', 'sidecar')) AS total_files_discovered,
      count(*) FILTER (kind = 'media') AS media_files_discovered,
      count(*) FILTER (kind = 'sidecar') AS metadata_files_discovered,
      (SELECT count(sidecar_path) FROM links) AS media_files_with_metadata
      FROM (SELECT {o.kind("album", "name")} AS kind FROM files)"""))
def discovery_counters(spark, sf_dir):
    files = _names(spark, sf_dir)
    return reports.discovery_counters(files, _linked(files)[0])


@query("localized_edit_links", o.with_tables(
    o.SHAPED, o.MEDIA, o.SIDECARS, o.PARSED_NAMES, f"""foreign_media AS (
      SELECT path, album, {o.stem("name")} AS stem, lower({o.suffix("name")}) AS low,
        regexp_extract(name, '\\([0-9]+\\)') AS number
      FROM (SELECT album, replace(path, '-edited', CASE WHEN doc_id % 2 = 0 THEN '-bearbeitet' ELSE '-Edited' END) AS path,
              replace(name, '-edited', CASE WHEN doc_id % 2 = 0 THEN '-bearbeitet' ELSE '-Edited' END) AS name
            FROM media)
    ), keys AS (
      SELECT album, filename || CASE WHEN extension = '' THEN '' ELSE '.' || extension END AS key,
        count(*) AS n, count(*) FILTER (numeric_suffix = '') AS n_bare,
        min(path) FILTER (numeric_suffix = '') AS bare_path, min(path) AS any_path,
        min(numeric_suffix) AS any_number FROM names GROUP BY 1, 2
    ), tried AS (
      SELECT f.*, k.n, k.n_bare, k.bare_path, k.any_path, k.any_number FROM foreign_media f
      LEFT JOIN keys k ON k.album = f.album AND lower(f.stem) SIMILAR TO '.*-(edited|bearbeitet)'
        AND k.key = regexp_replace(f.stem, '(?i)-(edited|bearbeitet)$', '') || f.low
    )""",
    select="""SELECT path, sidecar_path FROM (
      SELECT path, CASE
        WHEN n = 1 THEN CASE WHEN any_number = '' OR stem LIKE '%' || any_number THEN any_path END
        WHEN n > 1 THEN CASE WHEN n_bare = 1 THEN bare_path END
        ELSE (SELECT min(s.path) FROM names s WHERE s.album = tried.album
              AND s.numeric_suffix = tried.number AND tried.number <> '') END AS sidecar_path
      FROM tried) WHERE sidecar_path IS NOT NULL"""))
def localized_edit_links(spark, sf_dir):
    mark = F.when(F.col("doc_id") % 2 == 0, "-bearbeitet").otherwise("-Edited")
    media = a.media(spark, sf_dir).select(
        F.replace("path", F.lit("-edited"), mark).alias("path"),
        "album",
        F.replace("name", F.lit("-edited"), mark).alias("name"),
    )
    return linking.match_alternative(media, _sidecars(spark, sf_dir))


@query("album_of_media", o.with_tables(
    o.SHAPED, o.MEDIA,
    select=f"""SELECT path, CASE WHEN right(album, 1) = '3' THEN 'known' ELSE {o.uuid5("album")} END AS album_id
      FROM media"""))
def album_of_media(spark, sf_dir):
    media = a.media(spark, sf_dir).select("path", "album")
    known = (
        media.select(F.col("album").alias("album_folder_path"))
        .distinct()
        .filter(F.endswith("album_folder_path", F.lit("3")))
        .withColumn("album_id", F.lit("known"))
    )
    return albums.attach_album(media, known).select("path", "album_id")


@query("time_matches", """WITH wanted AS (
    SELECT 'user ' || user_id AS album, 's' || event_id AS sidecar_path, epoch(date_trunc('second', ts))::BIGINT AS taken
    FROM events WHERE event_type = 'view'
  ), candidates AS (
    SELECT 'user ' || user_id AS album, 'm' || event_id AS media_path, epoch_us(ts) AS taken_us
    FROM events WHERE event_type <> 'view'
  )
  SELECT sidecar_path, min(media_path) AS media_path FROM wanted w JOIN candidates c
    ON w.album = c.album AND abs(c.taken_us - w.taken * 1000000) <= 600 * 1000000
  GROUP BY sidecar_path""")
def time_matches(spark, sf_dir):
    events = a.table(spark, sf_dir, "events")
    album = F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("album")
    key = F.col("event_id").cast("string")
    sidecars = events.filter("event_type = 'view'").select(
        album, F.concat(F.lit("s"), key).alias("path"), F.unix_seconds("ts").alias("taken_seconds")
    )
    media = events.filter("event_type <> 'view'").select(
        album, F.concat(F.lit("m"), key).alias("path"), F.col("ts").alias("media_time")
    )
    return time_match.match_by_time(sidecars, media, tolerance=600)


@query("title_time_matches", o.with_tables(
    o.SHAPED, o.MEDIA, o.SIDECARS,
    select="""SELECT sidecar_path, media_path, apart::DOUBLE AS seconds_apart FROM (
      SELECT s.path AS sidecar_path, m.path AS media_path,
        abs(m.stamp + CASE m.doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END
          - CASE WHEN s.doc_id % 7 <= 4 THEN m.stamp
              WHEN s.doc_id % 7 = 5 THEN epoch(make_timestamp(2019, 3, 1 + s.doc_id % 28, 13, 2, 3))::BIGINT END) AS apart
      FROM sidecars s JOIN media m ON m.doc_id = s.doc_id WHERE s.doc_id % 41 <> 0)
    WHERE apart <= 1"""))
def title_time_matches(spark, sf_dir):
    parsed = media_ops.parse_sidecars(a.sidecars(spark, sf_dir))
    orphans = parsed.select(
        "path",
        names.parent(F.col("path")).alias("album"),
        "json_title",
        F.unix_seconds(F.try_to_timestamp("taken")).alias("taken_seconds"),
    )
    late = F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 2).otherwise(0)
    media = a.media(spark, sf_dir).select(
        F.col("path").alias("relative_path"),
        F.timestamp_seconds(a.taken_seconds(F.col("doc_id")) + late).alias("capture_timestamp"),
    )
    return time_match.match_orphans_by_title_time(orphans, media)


@query("identifiers", o.with_tables(
    o.SHAPED, o.MEDIA,
    select=f"""SELECT path, {o.uuid5("album")} AS album_id,
      {o.uuid5("path || '|' || CASE WHEN doc_id % 2 = 0 THEN stamp::VARCHAR ELSE '' END || '|' || strlen(text) || '|' || CASE WHEN doc_id % 2 = 1 THEN stamp::VARCHAR ELSE '' END")} AS media_item_id
      FROM media"""))
def identifiers(spark, sf_dir):
    doc = F.col("doc_id")
    stamp = a.taken_seconds(doc).cast("string")
    return a.media(spark, sf_dir).select(
        "path",
        ids.album_id(F.col("album")).alias("album_id"),
        ids.media_id(
            F.col("path"),
            F.when(doc % 2 == 0, stamp),
            F.octet_length("text").cast("bigint"),
            F.when(doc % 2 == 1, stamp),
        ).alias("media_item_id"),
    )
