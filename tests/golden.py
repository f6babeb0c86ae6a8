"""Four monthly exports of a made-up archive, built from a table of rules."""

import json

ID = "17500000000000000{}".format

# number -> (handle, text, created, likes)
POSTS = {
    11: ("orla", "Tomatoes like warm nights and steady water.", "2026-01-03T07:30:00Z", 31),
    12: ("tomas", "A sourdough starter needs feeding twice a day.", "2026-01-05T18:00:00Z", "640"),
    13: ("mei", "Night trains across the fjords are running again.", "2026-01-08T21:15:00Z", 77),
    14: ("hana", "Composting worms eat cardboard too.", None, None),
    15: ("idris", "Sourdough crackers from leftover starter.", "2026-02-11T06:00:00Z", 5),
    16: ("orla", "Trains and tomatoes in one weekend.", "2026-03-02T12:00:00Z", 0),
}
FOLDERS = {"k-1": "Garden", "k-2": "Kitchen", "k-3": "Travel"}

# month -> (exported, folders complete?, {post: (folders, gone because)})
MONTHS = {
    "january": ("2026-01-31T08:00:00Z", True, {11: (["k-1"], None), 12: (["k-2"], None), 13: (["k-3"], None)}),
    "february": ("2026-02-28T08:00:00Z", False, {12: ([], "withheld"), 14: (["k-1"], None), 15: (["k-2"], None)}),
    "march": ("2026-03-31T08:00:00Z", True, {11: (["k-1", "k-2"], None), 13: ([], "account gone"), 16: (["k-3"], None)}),
    "april": ("2026-04-30T08:00:00Z", False, {12: ([], None)}),
}


def post(n, folders=(), gone=None):
    handle, text, created, likes = POSTS[n]
    row = {
        "tweet_id": ID(n) if n % 2 else int(ID(n)),
        "author": {"screen_name": handle, "name": handle.title()},
        "folder_ids": list(folders),
    }
    if gone:
        return {**row, "status": "unavailable", "unavailable_reason": gone}
    row |= {"status": "available", "full_text": text, "metrics": {"likes": likes}}
    if created:
        row["created_at"] = created
    if n == 11:
        row["entities"] = {
            "hashtags": ["garden"], "mentions": [{"screen_name": "seedbank", "user_id": "5"}],
            "urls": ["https://bare.example/soil", {"url": "https://t.example/s", "expanded_url": "https://long.example/s"}],
        }
        row["_archive"] = {"first_seen_at": "2025-12-24T00:00:00Z"}
    if n == 13:
        row["quoted_tweet"] = {"tweet_id": "88", "full_text": "Sleeper timetable", "author": {"screen_name": "rails"}}
        row["media"] = [{"type": "photo", "thumbnail_url": "https://img.example/fjord.jpg"}]
    return row


def export(month, **changes):
    exported, complete, posts = MONTHS[month]
    used = sorted({f for folders, _ in posts.values() for f in folders})
    return {
        "export_metadata": {
            "schema_version": 2, "user_id": "42", "screen_name": "keeper", "kind": "bookmarks",
            "exported_at": exported, "collection": {"folders": "complete" if complete else "partial"},
        },
        "folders": [{"id": f, "name": FOLDERS[f]} for f in used],
        "bookmarks": [post(n, *how) for n, how in posts.items()],
    } | changes


def write(folder, name, content):
    path = f"{folder}/{name}.json"
    with open(path, "w", encoding="utf-8") as f:
        f.write(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False, indent=1))
    return path
