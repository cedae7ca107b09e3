"""Table schemas, as DDL strings."""

from __future__ import annotations

CAPTURE = (
    "url string, final_url string, status_code int, headers map<string,string>, html string, "
    "strategy string, timestamp timestamp, screenshot_path string, "
    "error struct<code:string,message:string>, metadata map<string,string>"
)

# Columns of a unified record and their types; everything else goes to ``metadata``.
UNIFIED = {
    "url": "string", "platform": "string", "content_type": "string", "title": "string",
    "text": "string", "author": "string", "author_url": "string", "timestamp": "timestamp",
    "likes": "bigint", "shares": "bigint", "comments": "bigint", "views": "bigint",
    "media_urls": "array<string>", "thumbnail_url": "string", "tags": "array<string>",
    "scraping_strategy": "string", "selectors_used": "array<string>", "ai_assisted": "boolean",
    "archive_id": "string", "field_confidences": "map<string,double>", "confidence": "double",
    "metadata": "map<string,string>",
}
# Fields a model answer may fill (M2).
ANSWER_FIELDS = {
    name: UNIFIED[name]
    for name in (
        "title", "text", "author", "author_url", "timestamp", "likes", "shares", "comments",
        "views", "media_urls", "thumbnail_url", "tags", "content_type",
    )
}
OUTCOME = (
    "url string, strategy string, latency_ms double, status_code int, error_type string, "
    "error_code string, confidence double, ts timestamp, seq bigint"
)
SELECTOR_EVENT = (
    "platform string, domain string, field string, selector string, matched boolean, "
    "confidence double, ts timestamp, seq bigint"
)
