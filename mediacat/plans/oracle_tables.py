"""The adapted tables as SQL common table expressions, for the SQL twins of the queries."""

from __future__ import annotations

from mediacat import fixed
from mediacat.plans.adapters import NEW_SEEN, NEW_START, OLD_SEEN, OLD_START, RUN_NEW, RUN_OLD

PAD = "lpad(k::VARCHAR, 8, '0')"


def _pad(expr: str) -> str:
    return f"lpad(({expr})::VARCHAR, 8, '0')"


SHAPED = f"""shaped AS (
  SELECT doc_id, text, album, k, shape,
    CASE
      WHEN shape IN (0, 12) THEN 'IMG_' || {PAD} || '.jpg'
      WHEN shape IN (1, 13) THEN 'IMG_' || {PAD} || '.JPG'
      WHEN shape IN (2, 14) THEN 'IMG_' || {PAD} || '(2).jpg'
      WHEN shape IN (3, 15) THEN 'IMG_' || {_pad("k - 3")} || '-edited.jpg'
      WHEN shape = 4 THEN 'DSC_' || {PAD} || '.nef'
      WHEN shape IN (5, 17) THEN '21.12.11 - ' || {PAD}
      WHEN shape IN (6, 18) THEN '01.04(1).12 - ' || {PAD}
      WHEN shape IN (7, 19) THEN 'Screenshot_' || {PAD} || 'a1.jpg'
      WHEN shape IN (8, 20) THEN 'LIVE_' || {PAD} || '.HEIC'
      WHEN shape IN (9, 21) THEN 'LIVE_' || {_pad("k - 1")} || '.MOV'
      WHEN shape = 10 THEN 'clip_' || {PAD} || '.mkv'
      WHEN shape = 11 THEN 'PXL_' || {PAD} || '.jpg'
      WHEN shape = 16 THEN 'scan' || {PAD}
      WHEN shape = 22 THEN 'Burst_' || {PAD} || 'x1.jpg'
      WHEN shape = 23 THEN 'Burst_' || {_pad("k - 1")} || 'x2.jpg'
    END AS media_name,
    CASE
      WHEN shape IN (0, 12) THEN 'IMG_' || {PAD} || '.jpg.supplemental-metadata.json'
      WHEN shape IN (1, 13) THEN 'IMG_' || {PAD} || '.jpg.suppl.json'
      WHEN shape IN (2, 14) THEN 'IMG_' || {PAD} || '.jpg.supplemental-metadata(2).json'
      WHEN shape = 4 THEN 'DSC_' || {PAD} || '.nef.supplemental-metadata.json'
      WHEN shape IN (5, 17) THEN '21.12.11 - ' || {PAD} || '.supplemental-metadata.json'
      WHEN shape IN (6, 18) THEN '01.04.12 - ' || {PAD} || '.supplemental-metadata(1).json'
      WHEN shape IN (7, 19) THEN 'Screenshot_' || {PAD} || 'a.jpg.supplemental-metadata.json'
      WHEN shape IN (8, 20) THEN 'LIVE_' || {PAD} || '.HEIC.supplemental-metadata.json'
      WHEN shape = 10 THEN 'clip_' || {PAD} || '.mkv.supplemental-metadata.json'
      WHEN shape = 11 THEN 'PXL_' || {PAD} || '.jpg.supplemental-metadata.json'
      WHEN shape = 16 THEN 'scan' || {PAD} || '_long.supplemental-metadata.json'
      WHEN shape = 22 THEN 'Burst_' || {PAD} || 'x.jpg.supplemental-metadata.json'
    END AS sidecar_name,
    CASE WHEN shape = 11 THEN 'PXL_' || {PAD} || '.JPG.s.json' END AS twin_name,
    CASE WHEN doc_id % 50 = 7 THEN 'cache_' || {PAD} || '.tmp' END AS junk_name,
    CASE WHEN doc_id % 100 = 3 THEN 'page_' || doc_id || '.html' END AS page_name,
    CASE WHEN k = 0 AND doc_id % 10 < 6 THEN 'metadata.json' END AS meta_name,
    1262304000 + doc_id * 7919 % 300000000 AS stamp
  FROM (
    SELECT doc_id, text, 'Photos from ' || (2015 + doc_id % 10) AS album,
      doc_id // 10 AS k, (doc_id // 10) % 24 AS shape
    FROM documents
  )
)"""

MEDIA = """media AS (
  SELECT doc_id, album || '/' || media_name AS path, album, media_name AS name, text, stamp, k, shape
  FROM shaped
)"""

_SIDECAR_RAW = """CASE WHEN doc_id % 41 = 0 THEN '{"title":"' || media_name ELSE
    '{"title":"' || media_name || '","description":"about ' || doc_id || '",'
    || CASE
        WHEN doc_id % 7 <= 3 THEN '"photoTakenTime":{"timestamp":"' || stamp || '"},'
        WHEN doc_id % 7 = 4 THEN '"photoTakenTime":' || stamp || ','
        WHEN doc_id % 7 = 5 THEN '"photoTakenTime":{"formatted":"Mar ' || (1 + doc_id % 28)
             || ', 2019, 1:02:03 PM UTC"},'
        ELSE '"creationTime":{"timestamp":"' || stamp || '"},' END
    || CASE WHEN doc_id % 11 = 0 THEN '"geoDataExif"' ELSE '"geoData"' END
    || ':{"latitude":' || (doc_id * 7 % 180 - 90) || '.5,"longitude":' || (doc_id * 13 % 360 - 180)
    || '.25,"altitude":' || (doc_id % 900) || '.0},'
    || CASE WHEN doc_id % 3 = 0 THEN '"people":[{"name":"Person ' || (doc_id % 17)
         || '"},{},{"name":"Person ' || (doc_id % 5 + 20) || '"}],' ELSE '' END
    || '"url":"https://photos.example/p/' || doc_id || '","imageViews":"' || (doc_id % 100) || '"}'
  END"""

SIDECARS = f"""sidecars AS (
  SELECT doc_id, album || '/' || name AS path, album, name, {_SIDECAR_RAW} AS raw
  FROM (
    SELECT doc_id, album, media_name, stamp, sidecar_name AS name FROM shaped
    WHERE sidecar_name IS NOT NULL
    UNION ALL
    SELECT doc_id, album, media_name, stamp, twin_name FROM shaped WHERE twin_name IS NOT NULL
  )
)"""

FILES = """files AS (
  SELECT path, album, name, strlen(text) AS size FROM media
  UNION ALL SELECT path, album, name, strlen(raw) FROM sidecars
  UNION ALL SELECT album || '/' || junk_name, album, junk_name, 10 FROM shaped WHERE junk_name IS NOT NULL
  UNION ALL SELECT page_name, '', page_name, 10 FROM shaped WHERE page_name IS NOT NULL
  UNION ALL SELECT album || '/' || meta_name, album, meta_name, 10 FROM shaped WHERE meta_name IS NOT NULL
)"""


def _list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def suffix(name: str) -> str:
    """Suffix of a name by reading it backwards."""
    last = f"(length({name}) - strpos(reverse({name}), '.') + 1)"
    return (
        f"CASE WHEN strpos(reverse({name}), '.') > 1 AND {last} > 1"
        f" THEN substr({name}, {last}) ELSE '' END"
    )


def stem(name: str) -> str:
    return f"left({name}, length({name}) - length({suffix(name)}))"


def kind(album: str, name: str) -> str:
    skip = _list(fixed.SYSTEM_FILES + fixed.EXPORT_FILES)
    low = f"lower({suffix(name)})"
    return (
        f"CASE WHEN {album} = '' THEN 'other'"
        f" WHEN {low} = '.json' THEN CASE WHEN {name} = 'metadata.json' THEN 'album_metadata' ELSE 'sidecar' END"
        f" WHEN lower({name}) IN ({skip}) OR {low} IN ({_list(fixed.TEMPORARY_SUFFIXES)}) THEN 'other'"
        f" ELSE 'media' END"
    )


def real_ext(low: str) -> str:
    """Some known extension begins with a suffix that is not empty."""
    tests = " OR ".join(f"starts_with('{e}', {low})" for e in fixed.MEDIA_EXTENSIONS)
    return f"({low} <> '' AND ({tests}))"


def ext_key(ext: str) -> str:
    bare = f"ltrim({ext}, '.')"
    cases = " ".join(f"WHEN '{s}' THEN '.{l}'" for s, l in fixed.ONE_CHAR_EXTENSIONS.items())
    return f"CASE {bare} WHEN '' THEN '' WHEN 'jpeg' THEN '.jpg' {cases} ELSE '.' || {bare} END"


def numeric_suffix(name: str) -> str:
    """Last of all numbers in parentheses."""
    return f"regexp_extract_all({name}, '\\([0-9]+\\)')[-1]"


def drop_numeric(name: str) -> str:
    return f"regexp_replace({name}, '\\([0-9]+\\)', '')"


def strip_edited(name: str) -> str:
    """Name around its last edit mark, found from the end."""
    at = f"strpos(reverse(lower({name})), reverse('-edited'))"
    cut = f"left({name}, length({name}) - {at} - 6) || substr({name}, length({name}) - {at} + 2)"
    return f"CASE WHEN {at} > 0 THEN nullif({cut}, '') END"


# Sidecar names split by lists: positions of the parts that begin a known extension.
PARSED_NAMES = f"""named AS (
  SELECT path, album, name,
    regexp_replace(name, '(?i)\\.json\\s*$', '') AS bare
  FROM sidecars
), cored AS (
  SELECT path, album, name, coalesce(nullif(regexp_extract(bare, '\\(\\d+\\)$'), ''), '') AS numeric_suffix,
    regexp_replace(
      regexp_replace(bare, '\\(\\d+\\)$', ''),
      '(?i)\\.(s|supp|supplemen|supplement|supplemental)(-|-meta|-metadata)?-?$', '') AS core
  FROM named
), split AS (
  SELECT *, string_split(core, '.') AS parts FROM cored
), flagged AS (
  SELECT *, [length(p) > 1 AND len([e FOR e IN [{_list(fixed.SIDECAR_EXTENSIONS)}]
    IF starts_with(e, lower(p))]) > 0 FOR p IN parts] AS known FROM split
), placed AS (
  SELECT *, list_max([i FOR i IN range(1, len(parts) + 1) IF known[i]]) AS last FROM flagged
), started AS (
  SELECT *, coalesce(list_max([i FOR i IN range(1, last) IF NOT known[i]]), 0) + 1 AS first FROM placed
), names AS (
  SELECT path, album, numeric_suffix,
    CASE WHEN last IS NOT NULL THEN array_to_string(parts[1:first - 1], '.')
         WHEN len(parts) > 1 AND list_max([length(p) FOR p IN parts]) = 1
              AND list_min([length(p) FOR p IN parts]) = 1 THEN array_to_string(parts[1:len(parts) - 1], '.')
         ELSE core END AS filename,
    CASE WHEN last IS NOT NULL THEN lower(array_to_string(parts[first:last], '.'))
         WHEN len(parts) > 1 AND list_max([length(p) FOR p IN parts]) = 1
              AND list_min([length(p) FOR p IN parts]) = 1 THEN lower(parts[-1])
         ELSE '' END AS extension
  FROM started
)"""

# Linking as the written rules have it: each phase sees the media the earlier ones left.
LINKED = f"""keyed AS (
  SELECT album, filename || '.' || extension AS key, numeric_suffix, min(path) AS sidecar_path
  FROM names GROUP BY ALL HAVING count(*) = 1
), feats AS (
  SELECT path, album, name, {stem("name")} AS stem, lower({suffix("name")}) AS low,
    {real_ext(f"lower({suffix('name')})")} AS is_real FROM media
), phase1 AS (
  SELECT f.path, s.sidecar_path, 1 AS phase FROM feats f JOIN keyed s
    ON s.album = f.album AND s.numeric_suffix = ''
   AND s.key = CASE WHEN f.is_real THEN f.stem || f.low ELSE f.name || '.' END
), rest1 AS (
  SELECT * FROM feats WHERE path NOT IN (SELECT path FROM phase1)
), phase2 AS (
  SELECT f.path, s.sidecar_path, 2 AS phase FROM rest1 f JOIN keyed s
    ON s.album = f.album AND s.numeric_suffix = {numeric_suffix("f.name")}
   AND s.key = {drop_numeric("f.name")} || '.'
), rest2 AS (
  SELECT *, {strip_edited("CASE WHEN is_real THEN stem ELSE name END")} AS plain
  FROM rest1 WHERE path NOT IN (SELECT path FROM phase2)
), phase3 AS (
  SELECT f.path, s.sidecar_path, 3 AS phase FROM rest2 f JOIN keyed s
    ON s.album = f.album AND s.numeric_suffix = coalesce({numeric_suffix("f.plain")}, '')
   AND s.key = {drop_numeric("f.plain")} || CASE WHEN f.is_real THEN f.low ELSE '.' END
  WHERE lower(f.stem) LIKE '%-edited%'
), exact AS (
  FROM phase1 UNION ALL FROM phase2 UNION ALL FROM phase3
), rest3 AS (
  SELECT path, album, low, coalesce({strip_edited("name")}, name) AS processed
  FROM rest2 WHERE path NOT IN (SELECT path FROM phase3)
), left_media AS (
  SELECT path, album, {ext_key("low")} AS ext, coalesce({numeric_suffix("processed")}, '') AS number,
    {drop_numeric("processed")} AS base FROM rest3
), left_sidecars AS (
  SELECT path, album, {ext_key("extension")} AS ext, numeric_suffix AS number, filename AS base
  FROM names WHERE path NOT IN (SELECT sidecar_path FROM exact)
), candidates AS (
  SELECT m.path, s.path AS sidecar_path,
    CASE WHEN starts_with(m.base, s.base) THEN 1 ELSE 2 END AS kind
  FROM left_media m JOIN left_sidecars s
    ON m.album = s.album AND m.ext = s.ext AND m.number = s.number
   AND (starts_with(m.base, s.base) OR starts_with(s.base, m.base))
), wanted AS (
  SELECT path, CASE WHEN count(*) FILTER (kind = 1) > 0
      THEN CASE WHEN count(*) FILTER (kind = 1) = 1 THEN min(sidecar_path) FILTER (kind = 1) END
      ELSE CASE WHEN count(*) = 1 THEN min(sidecar_path) END END AS sidecar_path
  FROM candidates GROUP BY path
), phase4 AS (
  SELECT min(path) AS path, sidecar_path, 4 AS phase FROM wanted
  WHERE sidecar_path IS NOT NULL GROUP BY sidecar_path
), links AS (
  SELECT m.path, m.album, l.sidecar_path, l.phase
  FROM media m LEFT JOIN (FROM exact UNION ALL FROM phase4) l USING (path)
)"""

_DNS = fixed.UUID_DNS_NAMESPACE


def uuid5(text: str) -> str:
    """Name-based UUID from SHA-1."""
    digest = f"sha1(from_hex('{_DNS}') || encode({text}))"
    nibble = f"substr({digest}, 17, 1)"
    return (
        f"(substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-5' || substr({digest}, 14, 3)"
        f" || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', {nibble}) - 1) % 4, 1)"
        f" || substr({digest}, 18, 3) || '-' || substr({digest}, 21, 12))"
    )



def fingerprint(content: str) -> str:
    """SHA-256 of a blob, or of its first and last 64 KiB (taken from its hex form)."""
    return (
        f"CASE WHEN octet_length({content}) <= 131072 THEN sha256({content})"
        f" ELSE sha256(unhex(left(hex({content}), 131072) || right(hex({content}), 131072))) END"
    )


CATALOG = f"""catalog AS (
  SELECT path AS relative_path, strlen(text) AS file_size,
    {fingerprint("encode(text)")} AS content_fingerprint, text,
    CASE WHEN doc_id % 4 <> 0 THEN sha256('side' || doc_id) END AS sidecar_fingerprint,
    {OLD_SEEN} + CASE WHEN doc_id % 13 = 0 THEN {NEW_SEEN - OLD_SEEN} ELSE 0 END - doc_id % 100 AS first_seen,
    (CASE WHEN doc_id % 29 = 0 THEN {NEW_START - 10} ELSE {NEW_SEEN} END)::BIGINT AS last_seen,
    CASE WHEN doc_id % 10 = 9 THEN '{RUN_OLD}' ELSE '{RUN_NEW}' END AS scan_run_id,
    CASE WHEN doc_id % 17 = 0 THEN 'missing' WHEN doc_id % 37 = 0 THEN 'error' ELSE 'present' END AS status,
    {uuid5("path")} AS media_item_id
  FROM media
)"""

RESCAN = f"""scan AS (
  SELECT path AS relative_path, {fingerprint("encode(text)")} AS content_fingerprint, strlen(text) AS file_size,
    sidecar_fingerprint
  FROM (
    SELECT CASE WHEN doc_id % 23 = 0 THEN path || '.new' ELSE path END AS path,
      CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text,
      CASE WHEN doc_id % 4 <> 0 THEN sha256(CASE WHEN doc_id % 6 = 1 THEN 'edited' ELSE 'side' END || doc_id) END
        AS sidecar_fingerprint
    FROM media WHERE doc_id % 19 <> 0
  )
), diff AS (
  SELECT coalesce(s.relative_path, c.relative_path) AS relative_path,
    CASE WHEN s.relative_path IS NULL THEN 'absent'
         WHEN c.relative_path IS NULL THEN 'new'
         WHEN s.content_fingerprint = c.content_fingerprint
              AND s.sidecar_fingerprint IS NOT DISTINCT FROM c.sidecar_fingerprint THEN 'unchanged'
         WHEN c.first_seen < {NEW_START} THEN 'changed' ELSE 'kept' END AS change_type,
    s.file_size AS new_size, c.file_size AS old_size,
    c.first_seen, c.last_seen, c.scan_run_id, c.status
  FROM scan s FULL JOIN catalog c ON s.relative_path = c.relative_path
), next_catalog AS (
  SELECT relative_path, change_type,
    CASE WHEN change_type IN ('new', 'changed') THEN new_size ELSE old_size END AS file_size,
    CASE WHEN change_type IN ('new', 'changed') THEN {NEW_SEEN} ELSE first_seen END AS first_seen,
    CASE WHEN change_type IN ('absent', 'kept') THEN last_seen ELSE {NEW_SEEN} END AS last_seen,
    CASE WHEN change_type IN ('absent', 'kept') THEN scan_run_id ELSE '{RUN_NEW}' END AS scan_run_id,
    CASE WHEN change_type IN ('absent', 'kept') THEN status ELSE 'present' END AS status
  FROM diff
), marked AS (
  SELECT relative_path, change_type, file_size, first_seen, last_seen, scan_run_id,
    CASE WHEN status = 'present' AND scan_run_id = '{RUN_NEW}' AND last_seen < {NEW_START} THEN 'inconsistent'
         WHEN status = 'present' AND scan_run_id <> '{RUN_NEW}' THEN 'missing'
         ELSE status END AS status
  FROM next_catalog
)"""

RUNS = """runs AS (
  SELECT 'run-' || o_orderkey AS scan_run_id,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
    epoch(o_orderdate)::BIGINT + o_orderkey % 86400 AS started,
    CASE WHEN o_orderstatus <> 'O'
      THEN epoch(o_orderdate)::BIGINT + o_orderkey % 86400 + 1 + o_orderkey % 1000 END AS ended,
    trunc(o_totalprice / 100)::BIGINT AS seen, o_orderkey AS key,
    CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE trunc(o_totalprice / 100)::BIGINT END AS media_files_processed
  FROM orders
)"""

ERRORS = """errors AS (
  SELECT 'run-' || (user_id % 10) AS scan_run_id, 'album/file_' || event_id || '.jpg' AS relative_path,
    CASE event_id % 3 WHEN 0 THEN 'json_sidecar' WHEN 1 THEN 'album_metadata' ELSE 'media_file' END AS error_type,
    CASE event_type WHEN 'click' THEN 'permission_denied' WHEN 'view' THEN 'corrupted'
      WHEN 'signup' THEN 'unsupported_format' WHEN 'purchase' THEN 'io_error' ELSE 'parse_error' END
      AS error_category,
    event_type, event_id, ts
  FROM events
)"""

ALBUMS = f"""stored AS (
  SELECT 'Album ' || c_custkey AS album_folder_path, c_name AS title,
    CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS description,
    CASE WHEN c_custkey % 3 = 0 THEN 'protected' END AS access_level,
    CASE c_custkey % 10 WHEN 1 THEN 'missing' WHEN 2 THEN 'error' ELSE 'present' END AS status,
    CASE WHEN c_custkey % 4 = 0 THEN '{RUN_OLD}' ELSE '{RUN_NEW}' END AS scan_run_id
  FROM customer
)"""

FOUND_ALBUMS = f"""found AS (
  SELECT 'Album ' || key AS album_folder_path,
    CASE WHEN key % 3 <> 0 THEN 'Title ' || key END AS title,
    CASE WHEN key % 5 = 0 THEN 'described' END AS description,
    (CASE WHEN key % 7 = 0 THEN {OLD_START} END)::BIGINT AS created,
    CASE WHEN key % 11 = 0 THEN 'error' ELSE 'present' END AS status
  FROM (SELECT c_custkey + 100 AS key FROM customer WHERE c_custkey % 2 = 0)
)"""

MANIFEST = f"""members AS (
  SELECT doc_id, 'export-' || lpad((doc_id // 50)::VARCHAR, 6, '0')
      || CASE WHEN (doc_id // 50) % 5 = 4 THEN '.tgz' ELSE '.zip' END AS archive,
    (doc_id // 50) % 5 <> 4 AS is_zip,
    CASE WHEN doc_id % 33 = 0 THEN 'AUX/' WHEN doc_id % 35 = 1 THEN '../' ELSE 'Photos/' END
      || 'a' || CASE WHEN doc_id % 4 = 0 THEN '?b. ' ELSE '_' END || '/img_' || doc_id || '.jpg' AS member,
    strlen(text) AS size,
    (doc_id // 50) % 3 = 0 AND doc_id % 7 = 0 AS gone,
    doc_id % 31 = 5 AS bad_size,
    doc_id % 27 = 4 AS bad_crc
  FROM documents
)"""

LOG = """log AS (
  SELECT event_id AS line_no, '2024-01-01 - ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARNING'
      WHEN 'click' THEN 'DEBUG' WHEN 'signup' THEN 'TRACE' ELSE 'INFO' END || ' - '
    || CASE event_id % 11
      WHEN 0 THEN 'Phase 1 (Happy path): ' || event_id || ' matches found'
      WHEN 1 THEN 'Phase 2 (Numbered files): ' || event_id || ' matches found'
      WHEN 2 THEN 'Phase 3 (Edited files): ' || event_id || ' matches found'
      WHEN 3 THEN 'Phase 4 (Unmatched): ' || event_id || ' media files, 30 sidecars'
      WHEN 4 THEN (event_id % 100) || '.5% match rate'
      WHEN 5 THEN 'Multiple sidecars for media file a.jpg'
      WHEN 6 THEN 'Scanning complete'
      ELSE 'user ' || user_id END AS value
  FROM events
)"""


def with_tables(*tables: str, select: str) -> str:
    return "WITH " + ",\n".join(tables) + "\n" + select
