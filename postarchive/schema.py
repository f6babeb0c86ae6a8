"""Table shapes: archive tables, export files, landed feed records.

Shapes are DDL text, so they can be built without a running session and handed
as they are to ``spark.read.schema`` and ``from_json``.
"""

from __future__ import annotations

VARIANTS = "array<struct<url:string,bitrate:bigint,contentType:string>>"
MEDIA = (
    "array<struct<type:string,url:string,thumbnail_url:string,"
    f"duration_ms:bigint,variants:{VARIANTS},alt_text:string>>"
)
ENTITIES = (
    "struct<hashtags:array<string>,cashtags:array<string>,"
    "mentions:array<struct<screen_name:string,user_id:string>>>"
)

# --- Fixed values: names, limits and URL forms that results depend on --------

KEY = "tweet_id"

CONTENT = {
    "url": "string",
    "full_text": "string",
    "lang": "string",
    "created_at": "timestamp",
    "created_at_raw": "string",
    "source": "string",
    "source_label": "string",
    "conversation_id": "string",
    "in_reply_to_tweet_id": "string",
    "in_reply_to_screen_name": "string",
    "author_id": "string",
    "author_name": "string",
    "author_handle": "string",
    "author_followers": "bigint",
    "author_profile_image": "string",
    "likes": "bigint",
    "retweets": "bigint",
    "replies": "bigint",
    "quotes": "bigint",
    "bookmarks": "bigint",
    "views": "bigint",
    "quoted_tweet_id": "string",
    "quoted_full_text": "string",
    "quoted_author_handle": "string",
    "quoted_author_name": "string",
    "card_type": "string",
    "card_title": "string",
    "card_url": "string",
    "article_title": "string",
    "article_summary": "string",
    "media": MEDIA,
    "entities": ENTITIES,
    "hashtags": "array<string>",
    "links": "array<string>",
    "raw_json": "string",
    "sort_index": "bigint",
}

STATE = {
    "status": "string",
    "unavailable_reason": "string",
    "origin": "string",
    "first_seen_at": "timestamp",
    "last_seen_at": "timestamp",
    "content_updated_at": "timestamp",
}

SUMMARY = [
    "tweet_id", "url", "full_text", "created_at", "status", "lang",
    "author_name", "author_handle", "likes", "retweets", "replies", "views",
    "quoted_full_text", "quoted_author_handle", "media", "links", "origin",
    "last_seen_at",
]

# Text columns of the search index; ``col`` in the postings is the position here.
SEARCH_COLUMNS = [
    "full_text", "author_name", "author_handle", "links_text",
    "quoted_full_text", "article_title", "article_summary",
]

AVAILABLE, UNAVAILABLE = "available", "unavailable"
LEGACY_FOLDER = "legacy:"
URL_WITH_HANDLE = "https://x.com/{handle}/status/{id}"
URL_WITHOUT_HANDLE = "https://x.com/i/status/"
MAX_EXPORT_VERSION = 2
QUICK_BOUNDARY = 25
LIMIT_RESULTS, LIMIT_AUTHORS, LIMIT_SQL = 200, 500, 1000
MONTHS_SHOWN, AUTHORS_SHOWN = 24, 10

# --- Names of our own --------------------------------------------------------

ORIGIN_LIVE, ORIGIN_EXPORT, ORIGIN_UNKNOWN = "live", "export", "unknown"

POST_TYPES = {KEY: "string", **CONTENT, **STATE}
POST_COLUMNS = list(POST_TYPES)


def ddl(types: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in types.items())


POSTS = ddl(POST_TYPES)
OBSERVATIONS = POSTS + ", seq bigint"
FOLDERS = "id string, name string"
MEMBERSHIPS = "tweet_id string, folder_id string"
MEMBERSHIP_OBSERVATIONS = "tweet_id string, seq bigint, complete boolean, folder_ids array<string>"
RUNS = "key string, value string, ts timestamp"

# One export file.  Elements of ``bookmarks`` and ``folders`` stay raw JSON so
# that one malformed element cannot spoil its neighbours.
EXPORT = """
    export_metadata struct<
        tool:string, schema_version:string, kind:string, user_id:string,
        screen_name:string, exported_at:string,
        collection:struct<mode:string, bookmarks:string, folders:string,
                          folder_list:string, reason:string>>,
    folders array<string>,
    bookmarks array<string>
"""
EXPORT_FOLDER = "id string, name string"
EXPORT_ENTRY = f"""
    tweet_id string, status string, unavailable_reason string, created_at string,
    lang string, full_text string, source string, conversation_id string,
    in_reply_to_tweet_id string, sort_index string,
    author struct<name:string, screen_name:string, user_id:string,
                  followers_count:string, profile_image_url:string>,
    metrics struct<likes:string, retweets:string, replies:string, quotes:string,
                   bookmarks:string, views:string>,
    entities struct<hashtags:array<string>,
                    mentions:array<struct<screen_name:string,user_id:string>>,
                    urls:array<string>>,
    media array<struct<type:string, url:string, thumbnail_url:string,
                       alt_text:string, duration_ms:bigint, variants:{VARIANTS}>>,
    card struct<type:string, url:string, title:string, description:string>,
    quoted_tweet struct<tweet_id:string, status:string, full_text:string,
                        author:struct<name:string, screen_name:string>>,
    folders array<string>, folder_ids array<string>,
    _archive struct<first_seen_at:string, last_seen_at:string,
                    content_updated_at:string, folders_updated_at:string,
                    folders_complete:boolean>,
    _malformed string
"""

# One landed feed record per JSON line.  ``feed_id``, ``pos`` (0 = newest),
# ``observed_at`` and ``landing`` are added by whoever lands the feed; without a
# ``landing`` every file is one.
FEED = f"""
    feed_id string, pos bigint, observed_at string, landing string,
    id_str string, id string, url string, rawContent string, lang string,
    date string, sourceUrl string, sourceLabel string,
    conversationIdStr string, conversationId string,
    inReplyToTweetIdStr string, inReplyToTweetId string, inReplyToScreenName string,
    user struct<id_str:string, id:string, username:string, displayname:string,
                followersCount:string, profileImageUrl:string>,
    likeCount string, retweetCount string, replyCount string, quoteCount string,
    bookmarkedCount string, viewCount string,
    quotedTweet struct<id_str:string, id:string, rawContent:string,
                       user:struct<username:string, displayname:string>>,
    card struct<_type:string, title:string, url:string>,
    article struct<title:string, summaryText:string, preview_text:string>,
    media struct<photos:array<struct<url:string>>,
                 videos:array<struct<thumbnailUrl:string, duration:bigint, variants:{VARIANTS}>>,
                 animated:array<struct<videoUrl:string, thumbnailUrl:string>>>,
    hashtags array<string>, cashtags array<string>,
    mentionedUsers array<struct<username:string, id_str:string, id:string>>,
    links array<struct<url:string, tcourl:string>>,
    _malformed string
"""
