"""Plain SQL for the registered queries, over the given tables.

Each statement works on whole tables and states the binding rules of
:mod:`postarchive.plans.bindings` on its own.
"""

from __future__ import annotations

from postarchive.plans.stemming import stem_tables

ORACLES: dict[str, str] = {}

FIRST_ID = "1900000000000000000"


def iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S+00:00')"


def with_(*tables: str) -> str:
    return "WITH " + ",\n".join(tables) + "\n"


# --- bindings ---------------------------------------------------------------

POSTS = f"""posts AS (
  SELECT CAST({FIRST_ID} + doc_id AS VARCHAR) AS tweet_id,
         'https://x.com/' || source || '/status/' || CAST({FIRST_ID} + doc_id AS VARCHAR) AS url,
         text AS full_text, lang,
         CASE WHEN doc_id % 13 <> 0
              THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id * 37) END AS created_at,
         'Author ' || source AS author_name, source AS author_handle,
         n_chars % 1000 AS likes,
         CASE WHEN doc_id % 3 = 0 THEN doc_id % 50 END AS retweets,
         n_chars * 10 AS views,
         CASE WHEN doc_id % 7 = 0 THEN 'Report ' || lang END AS article_title,
         CASE WHEN doc_id % 4 = 0
              THEN 'https://example.org/' || source || '/' || CAST(doc_id AS VARCHAR) END AS link,
         CASE WHEN doc_id % 11 = 0 THEN 'unavailable' ELSE 'available' END AS status,
         CASE WHEN doc_id % 3 = 0 THEN 'export' WHEN doc_id % 3 = 1 THEN 'live'
              ELSE 'export+live' END AS origin,
         TIMESTAMP '2024-01-01 01:00:00' + to_minutes(doc_id * 37) AS first_seen_at,
         TIMESTAMP '2024-01-01 02:00:00' + to_minutes(doc_id * 37) AS last_seen_at
  FROM documents)"""

FOLDERS = """folders AS (
  SELECT 'f-' || CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation)"""

MEMBERSHIPS = f"""memberships AS (
  SELECT DISTINCT CAST({FIRST_ID} + doc_id AS VARCHAR) AS tweet_id,
         'f-' || CAST(n AS VARCHAR) AS folder_id
  FROM (SELECT doc_id, doc_id * 7 % 25 AS n FROM documents
        UNION ALL
        SELECT doc_id, doc_id * 3 % 27 FROM documents WHERE doc_id % 2 = 0) m)"""

FOLDER_NAMES = """folder_names AS (
  SELECT m.tweet_id, string_agg(f.name, '|' ORDER BY f.name) AS folders
  FROM memberships m JOIN folders f ON f.id = m.folder_id GROUP BY m.tweet_id)"""

OBSERVATIONS = """obs AS (
  SELECT CAST(user_id AS VARCHAR) AS tweet_id, event_id AS seq,
         event_type = 'view' AS real_url,
         CASE WHEN event_type = 'view'
              THEN 'https://x.com/u' || CAST(user_id AS VARCHAR) || '/status/'
                   || CAST(user_id AS VARCHAR)
              ELSE 'https://x.com/i/status/' || CAST(user_id AS VARCHAR) END AS url,
         CASE WHEN event_type = 'signup' THEN ''
              WHEN event_type <> 'click' THEN event_type || '-' || CAST(event_id AS VARCHAR)
         END AS full_text,
         CASE WHEN event_type = 'view' THEN 'u' || CAST(user_id AS VARCHAR) END AS author_handle,
         TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS likes,
         CASE WHEN event_id % 3 = 0 THEN event_id END AS views,
         CASE WHEN event_type = 'purchase' THEN 'tag' || CAST(event_id AS VARCHAR) END AS hashtags,
         CASE WHEN event_type = 'error' THEN 'unavailable'
              WHEN event_type <> 'view' THEN 'available' END AS status,
         CASE WHEN event_type = 'error' THEN 'r' || CAST(event_id AS VARCHAR) END AS reason,
         CASE WHEN event_type = 'click' THEN 'live' ELSE 'export' END AS origin,
         CASE WHEN event_type <> 'click'
              THEN date_trunc('second', ts) - to_hours(event_id % 48) END AS first_seen_at,
         date_trunc('second', ts) AS last_seen_at,
         CASE WHEN event_type = 'purchase' THEN date_trunc('second', ts) END AS content_updated_at,
         ts >= TIMESTAMP '2024-01-16' AS late
  FROM events)"""

# The fold of all observations of a post; rows are restricted by {where}.
FOLD = """{name} AS (
  SELECT tweet_id,
    coalesce(arg_max(url, seq) FILTER (WHERE real_url),
             arg_max(url, seq) FILTER (WHERE NOT real_url)) AS url,
    arg_max(full_text, seq) FILTER (WHERE full_text <> '') AS full_text,
    arg_max(author_handle, seq) FILTER (WHERE author_handle <> '') AS author_handle,
    arg_max(likes, seq) FILTER (WHERE likes IS NOT NULL) AS likes,
    arg_max(views, seq) FILTER (WHERE views IS NOT NULL) AS views,
    arg_max(hashtags, seq) FILTER (WHERE hashtags IS NOT NULL) AS hashtags,
    coalesce(arg_max(status, seq) FILTER (WHERE status <> ''), 'available') AS status,
    CASE WHEN coalesce(arg_max(status, seq) FILTER (WHERE status <> ''), 'available')
              = 'unavailable'
         THEN arg_max(reason, seq) FILTER (WHERE status = 'unavailable') END
      AS unavailable_reason,
    string_agg(DISTINCT origin, '+' ORDER BY origin) AS origin,
    least(min(first_seen_at), arg_min(coalesce(first_seen_at, last_seen_at), seq))
      AS first_seen_at,
    max(last_seen_at) AS last_seen_at,
    greatest(
      max(content_updated_at),
      CASE WHEN min(seq) FILTER (WHERE content_updated_at IS NOT NULL) IS NULL
             OR min(seq) FILTER (WHERE full_text <> '')
                < min(seq) FILTER (WHERE content_updated_at IS NOT NULL)
           THEN arg_min(last_seen_at, seq) FILTER (WHERE full_text <> '') END)
      AS content_updated_at,
    count(*) AS n_rows
  FROM obs WHERE {where} GROUP BY tweet_id)"""

FEED = """feed AS (
  SELECT CAST(user_id % 5 AS VARCHAR) AS feed_id, event_id AS pos,
         CASE WHEN user_id % 4 = 0 THEN 'n' || CAST(event_id AS VARCHAR)
              ELSE CAST(user_id AS VARCHAR) END AS tweet_id
  FROM events),
archived AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS tweet_id FROM events WHERE user_id % 3 <> 0),
marked AS (
  SELECT f.*, (a.tweet_id IS NOT NULL
               OR row_number() OVER (PARTITION BY f.feed_id, f.tweet_id ORDER BY f.pos) > 1)
              AS known
  FROM feed f LEFT JOIN archived a ON a.tweet_id = f.tweet_id),
islands AS (
  SELECT *, sum(CASE WHEN known THEN 0 ELSE 1 END)
              OVER (PARTITION BY feed_id ORDER BY pos) AS island FROM marked),
streaks AS (
  SELECT feed_id, pos, tweet_id, known,
         CAST(sum(CASE WHEN known THEN 1 ELSE 0 END)
              OVER (PARTITION BY feed_id, island ORDER BY pos) AS BIGINT) AS streak
  FROM islands),
stops AS (
  SELECT feed_id, min(pos) AS stop FROM streaks WHERE streak >= 25 GROUP BY feed_id),
quick AS (
  SELECT s.feed_id, s.pos, s.tweet_id, s.known,
         CASE WHEN p.stop IS NULL THEN 'exhausted' ELSE 'reached known boundary' END
           AS stopped_reason
  FROM streaks s LEFT JOIN stops p ON p.feed_id = s.feed_id
  WHERE p.stop IS NULL OR s.pos <= p.stop)"""

MEMBERSHIP_OBS = """mobs AS (
  SELECT CAST(user_id AS VARCHAR) AS tweet_id, event_id AS seq,
         event_type = 'purchase' AS complete,
         CASE WHEN event_type = 'error' OR (event_type = 'purchase' AND event_id % 10 = 0)
              THEN NULL ELSE 'f-' || CAST(event_id % 25 AS VARCHAR) END AS folder_id
  FROM events),
prior AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS tweet_id,
         'f-' || CAST(user_id * 7 % 25 AS VARCHAR) AS folder_id FROM events)"""

# --- merge ------------------------------------------------------------------

ORACLES["merge_observations"] = (
    with_(OBSERVATIONS, FOLD.format(name="merged", where="TRUE"))
    + f"""SELECT tweet_id, url, full_text, author_handle, likes, views, hashtags, status,
  unavailable_reason, origin, {iso('first_seen_at')} AS first_seen_at,
  {iso('last_seen_at')} AS last_seen_at, {iso('content_updated_at')} AS content_updated_at
FROM merged"""
)

ORACLES["merge_outcomes"] = (
    with_(
        OBSERVATIONS,
        FOLD.format(name="old", where="NOT late"),
        FOLD.format(name="merged", where="TRUE"),
        """compared AS (
  SELECT o.tweet_id IS NULL AS is_new,
         (m.url, m.full_text, m.author_handle, m.likes, m.views, m.hashtags)
           IS DISTINCT FROM
         (o.url, o.full_text, o.author_handle, o.likes, o.views, o.hashtags) AS content,
         (m.status, m.unavailable_reason, m.origin, m.first_seen_at, m.last_seen_at,
          m.content_updated_at)
           IS DISTINCT FROM
         (o.status, o.unavailable_reason, o.origin, o.first_seen_at, o.last_seen_at,
          o.content_updated_at) AS state,
         m.n_rows - coalesce(o.n_rows, 0) AS n
  FROM merged m LEFT JOIN old o ON o.tweet_id = m.tweet_id
  WHERE m.tweet_id IN (SELECT tweet_id FROM obs WHERE late))""",
    )
    + """SELECT CASE WHEN is_new THEN 'added' WHEN content OR state THEN 'updated'
            ELSE 'unchanged' END AS outcome,
       (is_new OR content) AS content_changed,
       count(*) AS posts, CAST(sum(n) AS BIGINT) AS observations
FROM compared GROUP BY 1, 2"""
)
LATEST = "(max(struct_pack(at := last_seen_at, v := {0})) FILTER (WHERE {1})).v"
ORACLES["merge_by_time"] = (
    with_(
        OBSERVATIONS,
        f"""states AS (
  SELECT tweet_id,
    coalesce({LATEST.format('url', "url NOT LIKE 'https://x.com/i/status/%'")},
             {LATEST.format('url', "url LIKE 'https://x.com/i/status/%'")}) AS url,
    {LATEST.format('full_text', "full_text <> ''")} AS full_text,
    {LATEST.format('author_handle', "author_handle <> ''")} AS author_handle,
    {LATEST.format('likes', 'likes IS NOT NULL')} AS likes,
    {LATEST.format('views', 'views IS NOT NULL')} AS views,
    {LATEST.format('hashtags', "hashtags <> ''")} AS hashtags,
    coalesce({LATEST.format('status', "status <> ''")}, 'available') AS status,
    {LATEST.format("coalesce(CASE WHEN status = 'unavailable' THEN reason END, '')",
                   "status = 'available' OR (status = 'unavailable' AND reason <> '')")} AS reason,
    string_agg(DISTINCT origin, '+' ORDER BY origin) AS origin,
    min(coalesce(first_seen_at, last_seen_at)) AS first_seen_at,
    max(last_seen_at) AS last_seen_at,
    coalesce(max(content_updated_at), min(last_seen_at) FILTER (WHERE full_text <> '')) AS content_updated_at
  FROM obs GROUP BY tweet_id)""",
    )
    + f"""SELECT tweet_id, url, full_text, author_handle, likes, views, hashtags, status,
  CASE WHEN status = 'unavailable' THEN nullif(reason, '') END AS unavailable_reason, origin,
  {iso('first_seen_at')} AS first_seen_at, {iso('last_seen_at')} AS last_seen_at,
  {iso('content_updated_at')} AS content_updated_at
FROM states"""
)
ORACLES["stream_merge"] = ORACLES["merge_observations"]

ORACLES["membership_fold"] = (
    with_(MEMBERSHIP_OBS)
    + """SELECT s.tweet_id, s.folder_id
FROM (SELECT tweet_id, folder_id, max(seq) AS seq
      FROM (SELECT tweet_id, folder_id, -1 AS seq FROM prior
            UNION ALL
            SELECT tweet_id, folder_id, seq FROM mobs WHERE folder_id IS NOT NULL) u
      GROUP BY tweet_id, folder_id) s
LEFT JOIN (SELECT tweet_id, max(seq) AS cut FROM mobs WHERE complete GROUP BY tweet_id) c
  ON c.tweet_id = s.tweet_id
WHERE c.cut IS NULL OR s.seq >= c.cut"""
)
ORACLES["membership_add"] = (
    with_(MEMBERSHIP_OBS)
    + """SELECT tweet_id, folder_id FROM prior
UNION SELECT tweet_id, folder_id FROM mobs WHERE folder_id IS NOT NULL"""
)
ORACLES["membership_replace"] = (
    with_(MEMBERSHIP_OBS)
    + """SELECT tweet_id, folder_id FROM prior p
WHERE NOT EXISTS (SELECT 1 FROM mobs m WHERE m.complete AND m.tweet_id = p.tweet_id)
UNION SELECT tweet_id, folder_id FROM mobs WHERE complete AND folder_id IS NOT NULL"""
)
ORACLES["folder_ids_by_post"] = (
    with_(MEMBERSHIPS)
    + """SELECT tweet_id, string_agg(folder_id, '|' ORDER BY folder_id) AS folder_ids
FROM memberships GROUP BY tweet_id"""
)
ORACLES["folder_upsert"] = (
    with_(FOLDERS)
    + """SELECT id, arg_max(name, seq) AS name
FROM (SELECT id, name, -1 AS seq FROM folders
      UNION ALL
      SELECT 'f-' || CAST(event_id % 30 AS VARCHAR), 'name-' || CAST(event_id AS VARCHAR), event_id
      FROM events) u
GROUP BY id"""
)

# --- ingest -----------------------------------------------------------------

CREATED = "(TIMESTAMP '2024-01-01' + to_minutes(doc_id * 37))"

QUOTED = f"""  CASE WHEN doc_id % 12 = 0 THEN CAST({FIRST_ID} + doc_id + 1 AS VARCHAR) END AS quoted_tweet_id,
  CASE WHEN doc_id % 12 = 0 THEN 'quoted ' || lang END AS quoted_full_text,
  CASE WHEN doc_id % 12 = 0 THEN source END AS quoted_author_handle,
  CASE WHEN doc_id % 12 = 0 THEN lang END AS quoted_author_name,
  CASE WHEN doc_id % 9 = 0 THEN 'summary' END AS card_type,
  CASE WHEN doc_id % 9 = 0 THEN 'Card ' || lang END AS card_title,
  CASE WHEN doc_id % 9 = 0 THEN 'https://c.co/' || CAST(doc_id AS VARCHAR) END AS card_url,"""

ORACLES["normalize_export"] = f"""SELECT
  CAST({FIRST_ID} + doc_id AS VARCHAR) AS tweet_id,
  'file-' || CAST(doc_id AS VARCHAR) AS file_path,
  CASE WHEN doc_id % 4 <> 0
       THEN 'https://x.com/' || source || '/status/' || CAST({FIRST_ID} + doc_id AS VARCHAR)
       ELSE 'https://x.com/i/status/' || CAST({FIRST_ID} + doc_id AS VARCHAR) END AS url,
  CASE WHEN doc_id % 7 <> 0 THEN nullif(text, '') END AS full_text, lang,
  CASE WHEN doc_id % 5 <> 4 THEN {iso(CREATED)} END AS created_at,
  source AS author_name,
  CASE WHEN doc_id % 4 <> 0 THEN source END AS author_handle,
  CASE WHEN doc_id % 6 <> 0 THEN n_chars END AS likes, n_chars AS views,
  CASE WHEN doc_id % 3 = 0 THEN 'available' WHEN doc_id % 3 = 1 THEN 'unavailable'
       WHEN doc_id % 7 <> 0 AND text <> '' THEN 'available' ELSE 'unavailable' END AS status,
  CASE WHEN doc_id % 2 = 0 THEN lang || '|' || source END AS hashtags,
  CASE WHEN doc_id % 3 = 0 THEN 'https://e.org/' ELSE 'https://s.co/' END
    || CAST(doc_id AS VARCHAR) AS links,
  CASE WHEN doc_id % 16 = 0 THEN 'photo|video' WHEN doc_id % 8 = 0 THEN 'photo' END AS media_types,
  CASE WHEN doc_id % 8 = 0 THEN 'https://t.co/' || CAST(doc_id AS VARCHAR)
    || CASE WHEN doc_id % 16 = 0 THEN '|https://v.co/' || CAST(doc_id AS VARCHAR) ELSE '' END END AS media_urls,
  CASE WHEN doc_id % 8 = 0 THEN 'https://t.co/' || CAST(doc_id AS VARCHAR)
    || CASE WHEN doc_id % 16 = 0 THEN '|https://t.co/' || CAST(doc_id AS VARCHAR) ELSE '' END END AS media_thumbnails,
  CASE WHEN doc_id % 2 = 0 THEN lang || '|' || source WHEN doc_id % 4 = 1 THEN '' END AS tags,
  CASE WHEN doc_id % 2 = 0 OR doc_id % 4 = 1 THEN '' END AS cashtags,
  CASE WHEN doc_id % 4 = 1 THEN source || '/u' || CAST(doc_id AS VARCHAR) WHEN doc_id % 2 = 0 THEN '' END AS mentions,
{QUOTED}
  'export' AS origin, '2024-01-31T10:00:00+00:00' AS first_seen_at,
  '2024-01-31T10:00:00+00:00' AS last_seen_at,
  doc_id % 2 = 0 AS complete,
  CASE WHEN doc_id % 2 = 0 THEN 'f-' || CAST(doc_id % 25 AS VARCHAR)
       ELSE 'legacy:Folder ' || CAST(doc_id % 9 AS VARCHAR) END AS folder_ids
FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 19 <> 0"""

ORACLES["export_quarantine"] = """SELECT * FROM (
  SELECT 'unsupported schema version' AS reason, count(*) AS n, CAST(0 AS BIGINT) AS in_file
  FROM documents WHERE doc_id % 17 = 0
  UNION ALL SELECT 'malformed post', count(*), count(*) FROM documents
  WHERE doc_id % 17 <> 0 AND doc_id % 10 = 0
  UNION ALL SELECT 'missing tweet_id', count(*), count(*) FROM documents
  WHERE doc_id % 17 <> 0 AND doc_id % 19 = 0) q WHERE n > 0"""

ORACLES["legacy_folders"] = (
    with_(FOLDERS)
    + """SELECT id, name FROM folders
UNION SELECT 'legacy:Folder ' || CAST(doc_id % 9 AS VARCHAR), 'Folder ' || CAST(doc_id % 9 AS VARCHAR)
FROM documents WHERE doc_id % 2 = 1 AND doc_id % 17 <> 0 AND doc_id % 19 <> 0"""
)

ORACLES["normalize_feed"] = f"""SELECT
  CAST({FIRST_ID} + doc_id AS VARCHAR) AS tweet_id, doc_id AS pos,
  CASE WHEN doc_id % 5 = 0 THEN 'https://x.com/a/status/'
       WHEN doc_id % 4 = 0 THEN 'https://x.com/i/status/'
       ELSE 'https://x.com/' || source || '/status/' END
    || CAST({FIRST_ID} + doc_id AS VARCHAR) AS url,
  nullif(text, '') AS full_text, lang, {iso(CREATED)} AS created_at,
  CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id * 3 AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END
    AS conversation_id,
  source AS author_name, CASE WHEN doc_id % 4 <> 0 THEN source END AS author_handle,
  n_chars AS author_followers, n_chars AS likes, 'available' AS status,
  CASE WHEN doc_id % 2 = 0 THEN lang END AS hashtags,
  'https://s.co/' || CAST(doc_id AS VARCHAR) AS links,
  CASE WHEN doc_id % 6 = 0 THEN 'photo|video' WHEN doc_id % 3 = 0 THEN 'video' END AS media_types,
  CASE WHEN doc_id % 6 = 0 THEN 'https://p.co/' || CAST(doc_id AS VARCHAR)
                                || '|https://v.co/high/' || CAST(doc_id AS VARCHAR)
       WHEN doc_id % 3 = 0 THEN 'https://t.co/v' END AS media_urls,
  CASE WHEN doc_id % 6 = 0 THEN 'https://p.co/' || CAST(doc_id AS VARCHAR) || '|https://t.co/v'
       WHEN doc_id % 3 = 0 THEN 'https://t.co/v' END AS media_thumbnails,
  CASE WHEN doc_id % 2 = 0 THEN lang WHEN doc_id % 4 = 1 THEN '' END AS tags,
  CASE WHEN doc_id % 6 = 0 THEN 'usd|' || lang WHEN doc_id % 2 = 0 OR doc_id % 4 = 1 THEN '' END AS cashtags,
  CASE WHEN doc_id % 4 = 1 THEN source || '/' || CAST(doc_id AS VARCHAR) WHEN doc_id % 2 = 0 THEN '' END AS mentions,
  CASE WHEN doc_id % 7 = 0 THEN 'Report ' || lang END AS article_title,
  CASE WHEN doc_id % 7 = 0 THEN source END AS article_summary,
{QUOTED}
  'live' AS origin, '2024-01-31T10:00:00+00:00' AS last_seen_at
FROM documents WHERE doc_id % 19 <> 0"""

# --- incremental sync -------------------------------------------------------

ORACLES["quick_cut"] = with_(FEED) + "SELECT * FROM quick"
ORACLES["stream_quick_cut"] = ORACLES["quick_cut"]
# Records without an id are set aside; the quick sync ends 25 records into the older half.
ORACLES["sync_landings"] = f"""WITH placed AS (
  SELECT doc_id, doc_id >= (SELECT max(doc_id) // 2 FROM documents) AS older FROM documents WHERE doc_id % 19 <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY older ORDER BY doc_id) AS nth FROM placed)
SELECT CAST({FIRST_ID} + doc_id AS VARCHAR) AS tweet_id,
       CASE WHEN older THEN 'unchanged' ELSE 'added' END AS outcome, CAST(1 AS BIGINT) AS n_observations,
       CASE WHEN (SELECT count(*) FROM placed WHERE older) >= 25 THEN 'reached known boundary'
            ELSE 'exhausted' END AS stopped_reason
FROM numbered WHERE NOT older OR nth <= 25"""
ORACLES["full_cut"] = (
    with_(FEED)
    + "SELECT feed_id, pos, tweet_id, known, 'pagination ended' AS stopped_reason FROM marked"
)
ORACLES["known_streaks"] = with_(FEED) + "SELECT * FROM streaks"
ORACLES["sync_counters"] = (
    with_(FEED)
    + """SELECT feed_id, count(*) AS seen, count(*) FILTER (WHERE known) AS known,
  count(*) FILTER (WHERE NOT known) AS added, max(stopped_reason) AS stopped_reason
FROM quick GROUP BY feed_id"""
)

# --- index ------------------------------------------------------------------

TOKEN_LIST = r"regexp_extract_all(lower(strip_accents({text})), '[\p{{L}}\p{{N}}]+')"


def tokens_of(text: str) -> str:
    return TOKEN_LIST.format(text=text)


def postings(where: str = "TRUE") -> str:
    """CTEs ``lists``, ``docs``, ``tok`` of the posts that satisfy ``where``."""
    columns = [("full_text", 0), ("author_name", 1), ("author_handle", 2), ("link", 3),
               ("article_title", 5)]
    parts = "\n    UNION ALL ".join(
        f"SELECT tweet_id, {n} AS col, {tokens_of(f'coalesce({c}, {chr(39) * 2})')} AS toks "
        f"FROM posts WHERE {where}"
        for c, n in columns
    )
    return f"""lists AS ({parts}),
docs AS (SELECT tweet_id, CAST(sum(len(toks)) AS BIGINT) AS dl FROM lists GROUP BY tweet_id),
tok AS (SELECT tweet_id, col, unnest(toks) AS term,
               generate_subscripts(toks, 1) - 1 AS pos FROM lists)"""


ORACLES["build_postings"] = (
    with_(POSTS, postings())
    + """SELECT term, col, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum,
  CAST(max(pos) AS INTEGER) AS pos_max
FROM tok GROUP BY term, col"""
)
ORACLES["doc_lengths"] = with_(POSTS, postings()) + "SELECT tweet_id, dl FROM docs"
ORACLES["doc_freq"] = (
    with_(POSTS, postings())
    + """SELECT term, count(DISTINCT tweet_id) AS df, count(*) AS occurrences
FROM tok GROUP BY term"""
)
ORACLES["incremental_index"] = (
    with_(POSTS, postings())
    + """SELECT term, col, count(*) AS n, CAST(sum(dl) AS BIGINT) AS dl_sum
FROM tok JOIN docs USING (tweet_id) GROUP BY term, col"""
)
ORACLES["index_integrity"] = (
    with_(POSTS)
    + """SELECT count(*) AS bookmarks,
  count(*) FILTER (WHERE status = 'available') AS indexed,
  CAST(0 AS BIGINT) AS orphaned,
  count(*) FILTER (WHERE status <> 'available') AS missing,
  count(*) FILTER (WHERE status <> 'available') = 0 AS in_sync
FROM posts"""
)

# --- search -----------------------------------------------------------------

WORDS = r"list_append(regexp_extract_all(text, '\p{L}+'), '')"

SEARCH_QUERIES = """queries AS (
  SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query FROM benchmark)"""
FALLBACK_QUERIES = """queries AS (
  SELECT CAST(item_id AS VARCHAR) AS query_id,
         text || CASE WHEN item_id % 2 = 0 THEN ' zzqx9' ELSE '' END AS query FROM benchmark)"""
PHRASE_QUERIES = f"""queries AS (
  SELECT query_id, array_to_string(list_transform(
           generate_series(1, greatest(len(ws) // 2, 1)),
           lambda i: ws[2 * i - 1] || '-' || left(coalesce(ws[2 * i], ''), 2)), ' ') AS query
  FROM (SELECT CAST(item_id AS VARCHAR) AS query_id, {WORDS} AS ws FROM benchmark) w)"""

PHRASES = rf"""terms AS (
  SELECT query_id, unnest(regexp_extract_all(query, '[\p{{L}}\p{{N}}_@#.\-]+')) AS term
  FROM queries),
phrase_list AS (
  SELECT query_id, {tokens_of('term')} AS toks FROM terms),
all_phrases AS (
  SELECT query_id, array_to_string(toks, ' ') AS phrase, count(*) AS mult
  FROM phrase_list GROUP BY 1, 2),
qphrase AS (
  SELECT query_id, phrase, CAST(mult AS INTEGER) AS mult,
         CAST(count(*) OVER (PARTITION BY query_id) AS INTEGER) AS n_phrases
  FROM all_phrases),
ptok AS (
  SELECT phrase, len(toks) AS n_tokens, unnest(toks) AS token,
         generate_subscripts(toks, 1) - 1 AS off
  FROM (SELECT DISTINCT phrase, string_split(phrase, ' ') AS toks
        FROM qphrase WHERE phrase <> '') p)"""

# Scores of every matching post; {eligible} restricts (tweet_id, query_id) pairs.
SCORES = """vocab AS (
  SELECT DISTINCT term FROM tok),
parts AS (
  SELECT term, unnest(generate_series(1, length(term))) AS n FROM vocab),
matched AS (
  SELECT p.phrase, p.n_tokens, p.off, v.term
  FROM parts v JOIN ptok p ON left(v.term, v.n) = p.token
  WHERE p.off = p.n_tokens - 1 OR v.n = length(v.term)),
occurrences AS (
  SELECT t.tweet_id, m.phrase, t.col, t.pos - m.off AS start
  FROM tok t JOIN matched m ON m.term = t.term
  GROUP BY t.tweet_id, m.phrase, m.n_tokens, t.col, t.pos - m.off
  HAVING count(*) = m.n_tokens),
tf AS (
  SELECT tweet_id, phrase, count(*) AS tf FROM occurrences GROUP BY tweet_id, phrase),
df AS (
  SELECT phrase, greatest(ln(((SELECT count(*) FROM docs) - count(*) + 0.5)
                             / (count(*) + 0.5)), 1e-6) AS idf
  FROM tf GROUP BY phrase),
scored AS (
  SELECT q.query_id, tf.tweet_id,
         round(sum(q.mult * df.idf * tf.tf * CAST(2.2 AS DOUBLE)
           / (tf.tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE)
              * d.dl / (SELECT avg(dl) FROM docs)))), 6) AS score,
         count(*) = max(q.n_phrases) AS all_matched
  FROM tf JOIN qphrase q ON q.phrase = tf.phrase
  JOIN df ON df.phrase = tf.phrase
  JOIN docs d ON d.tweet_id = tf.tweet_id
  {eligible}
  GROUP BY q.query_id, tf.tweet_id),
kept AS (
  SELECT * FROM (SELECT *, bool_or(all_matched) OVER (PARTITION BY query_id) AS any_full
                 FROM scored) s
  WHERE all_matched OR NOT any_full),
ranked AS (
  SELECT query_id, tweet_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tweet_id) AS INTEGER)
           AS rank,
         CASE WHEN all_matched THEN 'all' ELSE 'any' END AS match_mode
  FROM kept)"""

TOP_10 = "SELECT query_id, rank, tweet_id, score, match_mode FROM ranked WHERE rank <= 10"


def search(queries: str, eligible: str = "") -> str:
    return with_(POSTS, postings(), queries, PHRASES, SCORES.format(eligible=eligible))


ORACLES["search_bm25_batch"] = search(SEARCH_QUERIES) + TOP_10
ORACLES["search_and_or_fallback"] = search(FALLBACK_QUERIES) + TOP_10
ORACLES["search_phrase_prefix"] = search(PHRASE_QUERIES) + TOP_10
ORACLES["search_filtered"] = (
    with_(
        POSTS, FOLDERS, MEMBERSHIPS, FOLDER_NAMES, postings(), SEARCH_QUERIES, PHRASES,
        SCORES.format(
            eligible="""JOIN posts p ON p.tweet_id = tf.tweet_id
    AND p.author_handle = 'src3'
    AND p.created_at >= TIMESTAMP '2024-01-02' AND p.created_at < TIMESTAMP '2024-06-30'
    AND p.tweet_id IN (SELECT m.tweet_id FROM memberships m JOIN folders f
                       ON f.id = m.folder_id WHERE f.name ILIKE '%NATION_1%')"""
        ),
    )
    + f"""SELECT r.query_id, r.rank, r.tweet_id, r.score, r.match_mode, p.author_handle,
  {iso('p.created_at')} AS created_at, coalesce(n.folders, '') AS folders
FROM ranked r JOIN posts p ON p.tweet_id = r.tweet_id
LEFT JOIN folder_names n ON n.tweet_id = r.tweet_id WHERE r.rank <= 10"""
)
ORACLES["search_per_author"] = (
    search(
        SEARCH_QUERIES,
        """JOIN posts p ON p.tweet_id = tf.tweet_id
    AND p.author_handle = 'src' || CAST(CAST(q.query_id AS BIGINT) % 20 AS VARCHAR)""",
    )
    + TOP_10
)
ORACLES["stemmed_terms"] = (
    with_(POSTS, postings(), stem_tables("tok")) + "SELECT term, stem FROM stems"
)
ORACLES["stemmed_vocabulary"] = (
    with_(
        POSTS, postings(), stem_tables("tok"),
        "held AS (SELECT DISTINCT t.tweet_id, s.stem FROM tok t JOIN stems s ON s.term = t.term)",
        """leading_parts AS (
  SELECT DISTINCT tweet_id, left(stem, n) AS part
  FROM (SELECT tweet_id, stem, unnest(generate_series(1, least(length(stem), 32))) AS n FROM held) l)""",
        "long_terms AS (SELECT tweet_id, stem AS part FROM held WHERE length(stem) > 32)",
    )
    + """SELECT p.part, p.posts, coalesce(h.n, 0) AS term_posts
FROM (SELECT part, count(*) AS posts
      FROM (SELECT * FROM leading_parts UNION ALL SELECT * FROM long_terms) u GROUP BY part) p
LEFT JOIN (SELECT stem, count(*) AS n FROM held GROUP BY stem) h ON h.stem = p.part"""
)
# Tokens of posts and of queries are stemmed before they are matched.
ORACLES["search_stemmed"] = (
    with_(
        POSTS, FOLDERS, MEMBERSHIPS, FOLDER_NAMES,
        postings().replace("tok AS (", "plain AS ("),
        SEARCH_QUERIES,
        PHRASES.split("phrase_list AS (")[0].rstrip().rstrip(","),
        f"plain_lists AS (SELECT row_number() OVER () AS id, query_id, {tokens_of('term')} AS toks FROM terms)",
        """query_tokens AS (
  SELECT id, query_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS at FROM plain_lists)""",
        "words AS (SELECT term FROM plain UNION SELECT term FROM query_tokens)",
        stem_tables("words"),
        "tok AS (SELECT p.tweet_id, p.col, s.stem AS term, p.pos FROM plain p JOIN stems s ON s.term = p.term)",
        """phrase_list AS (
  SELECT l.query_id, coalesce(list(s.stem ORDER BY t.at) FILTER (WHERE s.stem IS NOT NULL), []) AS toks
  FROM plain_lists l LEFT JOIN query_tokens t ON t.id = l.id LEFT JOIN stems s ON s.term = t.term
  GROUP BY l.id, l.query_id)""",
        "all_phrases AS (" + PHRASES.split("all_phrases AS (")[1],
        SCORES.format(eligible=""),
    )
    + f"""SELECT r.query_id, r.rank, r.tweet_id, r.score, r.match_mode, p.author_handle,
  {iso('p.created_at')} AS created_at, coalesce(n.folders, '') AS folders
FROM ranked r JOIN posts p ON p.tweet_id = r.tweet_id
LEFT JOIN folder_names n ON n.tweet_id = r.tweet_id WHERE r.rank <= 10"""
)
ORACLES["search_terms"] = (
    with_(PHRASE_QUERIES, PHRASES)
    + "SELECT query_id, phrase, mult, n_phrases FROM qphrase WHERE phrase <> ''"
)

CANDIDATES = """candidates AS (
  SELECT tweet_id, lower(w) AS word, min(place) AS place
  FROM (SELECT tweet_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS place
        FROM (SELECT tweet_id,
                     regexp_extract_all(full_text, '[A-Za-z][A-Za-z0-9]{5,}') AS ws
              FROM posts WHERE length(full_text) > 80) a) b
  GROUP BY tweet_id, lower(w)),
words AS (SELECT DISTINCT word FROM candidates),
terms_of_post AS (SELECT DISTINCT tweet_id, term FROM tok),
word_terms AS (
  SELECT w.word, v.term
  FROM (SELECT term, unnest(generate_series(1, length(term))) AS n
        FROM (SELECT DISTINCT term FROM tok) t) v
  JOIN words w ON left(v.term, v.n) = w.word),
unique_words AS (
  SELECT wt.word FROM word_terms wt JOIN terms_of_post p ON p.term = wt.term
  GROUP BY wt.word HAVING count(DISTINCT p.tweet_id) = 1),
chosen AS (
  SELECT c.tweet_id, arg_min(c.word, c.place) AS token
  FROM candidates c JOIN unique_words u ON u.word = c.word GROUP BY c.tweet_id)"""

ORACLES["unique_tokens"] = (
    with_(POSTS, postings(), CANDIDATES) + "SELECT tweet_id, token FROM chosen"
)

LONGEST = """longest AS (
  SELECT tweet_id, lower(arg_max(w, length(w) * 1000000 - place)) AS token
  FROM (SELECT tweet_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS place
        FROM (SELECT tweet_id,
                     regexp_extract_all(full_text, '[A-Za-z][A-Za-z0-9]{5,}') AS ws
              FROM posts) a) b
  GROUP BY tweet_id)"""

ORACLES["distinctive_tokens"] = (
    with_(POSTS, LONGEST)
    + """SELECT p.tweet_id, l.token FROM posts p LEFT JOIN longest l ON l.tweet_id = p.tweet_id"""
)

# A unique word is found by construction; a fallback word is searched in full.
SELF_TEST = [
    POSTS, postings(), CANDIDATES, LONGEST,
    """plan AS (
  SELECT p.tweet_id, CASE WHEN c.token IS NOT NULL THEN 'unique-token'
                          WHEN l.token IS NOT NULL THEN 'fallback' ELSE 'no-token' END AS mode,
         coalesce(c.token, l.token) AS token
  FROM posts p LEFT JOIN chosen c ON c.tweet_id = p.tweet_id
  LEFT JOIN longest l ON l.tweet_id = p.tweet_id
  WHERE length(p.full_text) > 80),
queries AS (
  SELECT DISTINCT token AS query_id, token AS query FROM plan WHERE token IS NOT NULL)""",
    PHRASES,
    SCORES.format(eligible=""),
    """tested AS (
  SELECT p.tweet_id, p.mode, p.token, count(r.tweet_id) AS hits,
         count(*) FILTER (WHERE r.tweet_id = p.tweet_id) > 0 AS found
  FROM plan p LEFT JOIN ranked r ON r.query_id = p.token
  GROUP BY p.tweet_id, p.mode, p.token),
self_tests AS (
  SELECT *, CASE WHEN mode = 'unique-token' THEN found END AS author_filter_ok, found AS ok
  FROM tested)""",
]
ORACLES["self_test"] = with_(*SELF_TEST) + "SELECT * FROM self_tests"

# --- reads ------------------------------------------------------------------

ORACLES["recent"] = (
    with_(POSTS, FOLDERS, MEMBERSHIPS, FOLDER_NAMES)
    + f"""SELECT p.tweet_id, p.author_handle, {iso('p.created_at')} AS created_at,
  coalesce(n.folders, '') AS folders, p.url
FROM posts p LEFT JOIN folder_names n ON n.tweet_id = p.tweet_id
WHERE p.author_handle = 'src3'
ORDER BY coalesce(p.created_at, p.first_seen_at) DESC NULLS LAST, p.tweet_id DESC LIMIT 50"""
)

RECENT_DAYS = """created_at >= TIMESTAMP '2024-01-12'"""
ORACLES["recent_days"] = (
    with_(POSTS, FOLDERS, MEMBERSHIPS, FOLDER_NAMES)
    + f"""SELECT p.tweet_id, {iso('p.created_at')} AS created_at, p.status,
  coalesce(n.folders, '') AS folders
FROM posts p LEFT JOIN folder_names n ON n.tweet_id = p.tweet_id
WHERE p.{RECENT_DAYS}
  AND p.tweet_id IN (SELECT m.tweet_id FROM memberships m JOIN folders f ON f.id = m.folder_id
                     WHERE f.name ILIKE '%nation_2%' OR f.id = 'nation_2')
ORDER BY coalesce(p.created_at, p.first_seen_at) DESC NULLS LAST, p.tweet_id DESC LIMIT 200"""
)
ORACLES["recent_days_bag"] = (
    with_(POSTS, FOLDERS, MEMBERSHIPS)
    + f"""SELECT tweet_id, count(*) AS n FROM (
  SELECT p.tweet_id FROM posts p
  JOIN memberships m ON m.tweet_id = p.tweet_id JOIN folders f ON f.id = m.folder_id
  WHERE p.{RECENT_DAYS} AND (f.name ILIKE '%nation_2%' OR f.id = 'nation_2')
  ORDER BY coalesce(p.created_at, p.first_seen_at) DESC NULLS LAST, p.tweet_id DESC LIMIT 200) r
GROUP BY tweet_id"""
)
ORACLES["get_by_reference"] = (
    with_(
        POSTS, FOLDERS, MEMBERSHIPS, FOLDER_NAMES,
        f"""refs AS (
  SELECT page_id AS ref_no,
         CASE WHEN page_id % 5 = 0 THEN url
              ELSE url || '/status/' || CAST({FIRST_ID} + page_id * 5 AS VARCHAR) END AS ref
  FROM pages),
keyed AS (
  SELECT ref_no, ref, nullif(regexp_extract(ref, '([0-9]{{6,25}})', 1), '') AS ref_id FROM refs)""",
    )
    + f"""SELECT k.ref_no, k.ref, k.ref_id, p.tweet_id IS NOT NULL AS found, p.url,
  p.author_handle, {iso('p.created_at')} AS created_at, coalesce(n.folders, '') AS folders
FROM keyed k LEFT JOIN posts p ON p.tweet_id = k.ref_id
LEFT JOIN folder_names n ON n.tweet_id = p.tweet_id"""
)
ORACLES["folder_counts"] = (
    with_(FOLDERS, MEMBERSHIPS)
    + """SELECT f.id, f.name, count(m.tweet_id) AS bookmarks
FROM folders f LEFT JOIN memberships m ON m.folder_id = f.id GROUP BY f.id, f.name"""
)
ORACLES["attach_folders"] = (
    with_(POSTS, FOLDERS, MEMBERSHIPS, FOLDER_NAMES)
    + """SELECT p.tweet_id, p.author_handle, coalesce(n.folders, '') AS folders
FROM posts p LEFT JOIN folder_names n ON n.tweet_id = p.tweet_id"""
)
ORACLES["top_authors"] = (
    with_(POSTS)
    + """SELECT author_handle, arg_max(author_name, last_seen_at) AS author_name,
  count(*) AS bookmarks
FROM posts WHERE author_handle IS NOT NULL GROUP BY author_handle HAVING count(*) >= 2
ORDER BY bookmarks DESC, author_handle LIMIT 15"""
)
ORACLES["counts"] = (
    with_(POSTS)
    + """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'available') AS available,
  count(*) - count(*) FILTER (WHERE status = 'available') AS unavailable,
  (SELECT count(*) FROM nation) AS folders
FROM posts"""
)
ORACLES["by_origin"] = with_(POSTS) + "SELECT origin, count(*) AS count FROM posts GROUP BY origin"
ORACLES["by_month"] = (
    with_(POSTS)
    + """SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS count
FROM posts WHERE created_at IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 24"""
)
ORACLES["newest"] = (
    with_(POSTS) + f"SELECT {iso('max(coalesce(created_at, first_seen_at))')} AS newest FROM posts"
)
ORACLES["run_state_latest"] = """SELECT 'last_' || event_type || '_at' AS key,
  'run-' || CAST(arg_max(event_id, ts) AS VARCHAR) AS value
FROM events GROUP BY event_type"""
ORACLES["archive_status"] = (
    with_(POSTS)
    + f"""SELECT 'counts' AS section, 'total' AS key, CAST(count(*) AS VARCHAR) AS value FROM posts
UNION ALL SELECT 'counts', 'available',
  CAST(count(*) FILTER (WHERE status = 'available') AS VARCHAR) FROM posts
UNION ALL SELECT 'counts', 'unavailable',
  CAST(count(*) FILTER (WHERE status <> 'available') AS VARCHAR) FROM posts
UNION ALL SELECT 'counts', 'folders', CAST(count(*) AS VARCHAR) FROM nation
UNION ALL SELECT 'newest', 'newest', {iso('max(coalesce(created_at, first_seen_at))')} FROM posts
UNION ALL SELECT 'by_origin', origin, CAST(count(*) AS VARCHAR) FROM posts GROUP BY origin
UNION ALL SELECT * FROM (
  SELECT 'by_month', strftime(created_at, '%Y-%m') AS month, CAST(count(*) AS VARCHAR) FROM posts
  WHERE created_at IS NOT NULL GROUP BY 2 ORDER BY month DESC LIMIT 24) m
UNION ALL SELECT * FROM (
  SELECT 'top_authors', author_handle, CAST(count(*) AS VARCHAR) FROM posts
  WHERE author_handle IS NOT NULL GROUP BY 2 ORDER BY count(*) DESC, author_handle LIMIT 10) a
UNION ALL SELECT 'state', key, value FROM ({ORACLES['run_state_latest']}) s"""
)
ORACLES["adhoc_sql"] = (
    with_(POSTS, FOLDERS, MEMBERSHIPS)
    + """SELECT f.name, b.lang, count(*) AS posts, max(b.likes) AS most_likes
FROM posts b
JOIN memberships m ON m.tweet_id = b.tweet_id
JOIN folders f ON f.id = m.folder_id
WHERE b.status = 'available'
GROUP BY f.name, b.lang"""
)
ORACLES["validate_quarantine"] = """SELECT
  CASE WHEN event_id % 7 > 1 THEN 'accepted' ELSE 'missing tweet_id' END AS reason,
  count(*) AS n, CAST(sum(event_id) AS BIGINT) AS seq_sum
FROM events GROUP BY 1"""
ORACLES["render_text"] = (
    with_(POSTS, FOLDERS, MEMBERSHIPS, FOLDER_NAMES)
    + r"""SELECT p.tweet_id,
  coalesce(strftime(coalesce(p.created_at, p.first_seen_at), '%Y-%m-%d'), '')
    || '  @' || p.author_handle || ' (' || p.author_name || ')'
    || CASE WHEN p.status = 'available' THEN '' ELSE '  [' || p.status || ']' END
    || coalesce(chr(10) || '  '
         || nullif(regexp_replace(p.full_text, '^\s+|\s+$', '', 'g'), ''), '')
    || chr(10) || '  likes=' || CAST(p.likes AS VARCHAR)
    || coalesce(' retweets=' || CAST(p.retweets AS VARCHAR), '')
    || ' views=' || CAST(p.views AS VARCHAR)
    || coalesce(chr(10) || '  folders: ' || replace(n.folders, '|', ', '), '')
    || chr(10) || '  ' || p.url AS text
FROM posts p LEFT JOIN folder_names n ON n.tweet_id = p.tweet_id"""
)
ORACLES["to_json_rows"] = (
    with_(POSTS)
    + f"""SELECT CAST(to_json({{'tweet_id': tweet_id, 'url': url, 'full_text': full_text,
  'created_at': {iso('created_at')}, 'status': status, 'lang': lang,
  'author_name': author_name, 'author_handle': author_handle, 'likes': likes,
  'retweets': retweets, 'views': views,
  'links_json': CASE WHEN link IS NOT NULL THEN '["' || link || '"]' END,
  'origin': origin, 'last_seen_at': {iso('last_seen_at')}}}) AS VARCHAR) AS json
FROM posts"""
)
ORACLES["health_report"] = (
    with_(FOLDERS, MEMBERSHIPS, *SELF_TEST)
    + """, checks AS (SELECT 'archive' AS "check", 'pass' AS state,
  CAST(count(*) AS VARCHAR) || ' posts ('
    || CAST(count(*) FILTER (WHERE status = 'available') AS VARCHAR) || ' available), '
    || CAST((SELECT count(*) FROM nation) AS VARCHAR) || ' folders' AS detail
FROM posts
UNION ALL SELECT 'search index', 'pass',
  'indexed=' || CAST(count(*) AS VARCHAR) || ' orphaned=0 missing=0' FROM docs
UNION ALL SELECT 'retrieval', CASE WHEN bool_and(ok) THEN 'pass' ELSE 'fail' END,
  'tested=' || CAST(count(*) AS VARCHAR)
    || ' found=' || CAST(count(*) FILTER (WHERE found) AS VARCHAR)
    || ' ok=' || CAST(count(*) FILTER (WHERE ok) AS VARCHAR) FROM self_tests
UNION ALL SELECT 'folder links', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'warn' END,
  'memberships of unknown folders=' || CAST(count(*) AS VARCHAR)
FROM memberships WHERE folder_id NOT IN (SELECT id FROM folders)
UNION ALL SELECT 'freshness', CASE WHEN synced_at IS NULL THEN 'warn' ELSE 'pass' END,
  'last sync ' || coalesce(synced_at, 'never') || ' (mode ' || coalesce(synced_mode, '-') || ')'
FROM (SELECT
  (SELECT 'run-' || event_id FROM events WHERE event_type = 'signup'
   ORDER BY ts DESC, 'run-' || event_id DESC LIMIT 1) AS synced_at,
  (SELECT CASE WHEN event_id % 2 = 0 THEN 'quick' ELSE 'full' END FROM events WHERE event_type = 'view'
   ORDER BY ts DESC, 1 DESC LIMIT 1) AS synced_mode) s)
SELECT * FROM checks
UNION ALL SELECT 'summary',
  CASE WHEN count(*) FILTER (WHERE state = 'fail') > 0 THEN 'fail'
       WHEN count(*) FILTER (WHERE state = 'warn') > 0 THEN 'warn' ELSE 'pass' END,
  'failures=' || CAST(count(*) FILTER (WHERE state = 'fail') AS VARCHAR)
    || ' warnings=' || CAST(count(*) FILTER (WHERE state = 'warn') AS VARCHAR) FROM checks"""
)
