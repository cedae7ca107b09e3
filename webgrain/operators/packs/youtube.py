"""Videos and channels of YouTube."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from webgrain.functions import gates, scalars, urls
from webgrain.functions.text import blank_to_null, contains_any, let
from webgrain.operators.rules import Pack, PageRules, Values, used_selectors
from webgrain.operators.selectors import Page

# --- fixed values: selectors ----------------------------------------------------
VIDEO = {
    "title": ["h1.yt-video-title", ".yt-video-title", "meta[property='og:title']"],
    "description": [".yt-video-description p", ".yt-video-description", "meta[name='description']"],
    "channel": [".yt-channel-name", ".yt-channel-link", "[data-channel-name]"],
    "view_count": [".yt-view-count", "[data-view-count]"],
    "like_count": [".yt-like-count", "[data-like-count]"],
    "comment_count": [".yt-comment-count", "[data-comment-count]"],
    "category": [".yt-category", "[data-category]"],
    "duration": [".yt-duration", "[data-duration]"],
}
CHANNEL = {
    "name": ["h1.yt-channel-name", ".yt-channel-name", "meta[property='og:title']"],
    "description": [".yt-channel-description", "meta[name='description']"],
    "subscriber_count": [".yt-subscriber-count", "[data-subscriber-count]"],
    "video_count": [".yt-video-count", "[data-video-count]"],
    "view_count": [".yt-channel-view-count", "[data-channel-view-count]"],
    "joined_date": [".yt-joined-date", "[data-joined-date]"],
}
STAMP = ["time.timestamp", "time", ".timestamp"]
VIDEO_NODE, CHANNEL_LINK = "article.yt-video[data-video-id]", ".yt-channel-link[href]"
CHANNEL_ID = ".yt-channel-id[data-channel-id]"
TAGS, SEGMENTS = ".yt-tags .tag, .yt-tag", ".yt-transcript .yt-transcript-segment"
RECENT = ".yt-recent-videos .yt-video-item"
RECENT_TITLE, RECENT_VIEWS = ".yt-video-item-title", ".yt-video-item-views"
COMMENTS_OFF = ".yt-comments-disabled"
COMMENTS_OFF_WORDS = ["turned off", "disabled"]
COMMENTS_OFF_PHRASES = ["comments are turned off", "comments disabled"]
URL_PATTERNS = [
    r"https?://(?:www\.)?youtube\.com/watch\?.*v=[^&]+",
    r"https?://(?:www\.)?youtube\.com/shorts/[^/]+",
    r"https?://(?:www\.)?youtube\.com/embed/[^/]+",
    r"https?://(?:www\.)?youtube\.com/@(?:[^/]+)",
    r"https?://(?:www\.)?youtube\.com/c/[^/]+",
    r"https?://(?:www\.)?youtube\.com/channel/[^/]+",
    r"https?://(?:www\.)?youtu\.be/[^/]+",
]
# --- end of fixed values ----------------------------------------------------------


def _count(text: Column) -> Column:
    return let(scalars.clean_count_text(text), scalars.parse_engagement)


def comments_disabled(page: Page) -> Column:
    """C14: a visible marker element or a phrase anywhere on the page."""

    def marks(node: Column) -> Column:
        style = F.lower(F.coalesce(node.attrs.getItem("style"), F.lit("")))
        hidden = F.replace(style, F.lit(" "), F.lit("")).contains("display:none")
        return ~hidden & contains_any(F.lower(page.text(node, " ")), COMMENTS_OFF_WORDS)

    marked = let(page.first(COMMENTS_OFF), marks)
    anywhere = contains_any(F.lower(page.all_text()), COMMENTS_OFF_PHRASES)
    return F.coalesce(marked, F.lit(False)) | anywhere


def _read_video(page: Page, c: Column) -> Values:
    stamp = page.attr_chain([(s, "datetime") for s in STAMP], non_empty=False)
    off = comments_disabled(page)
    resolve = lambda v: urls.resolve_url(page.url, v)
    segments = F.filter(
        F.transform(
            page.select(SEGMENTS),
            lambda n: F.struct(n.attrs.getItem("data-start").alias("start"), page.text(n).alias("text")),
        ),
        lambda s: s.text != "",
    )
    thumb = page.attr_chain(
        [("meta[property='og:image'][content]", "content"), ("video[poster]", "poster")], non_empty=False
    ).value
    media = F.filter(
        F.transform(page.attrs_of("video[src]", "src"), resolve),
        lambda v: v.isNotNull(),
    )
    # Counts, title and description keep their text readings: a bare og:title
    # page therefore has an empty title.
    return {
        "content_type": urls.youtube_page_type(page.url),
        "id": F.coalesce(
            page.first_attr(VIDEO_NODE, "data-video-id"), urls.youtube_video_id(page.url)
        ),
        "title": c.title.value, "description": c.description.value, "channel": c.channel.value,
        "channel_url": let(page.first_attr(CHANNEL_LINK, "href"), resolve),
        "timestamp": scalars.parse_timestamp(stamp.value), "duration": c.duration.value,
        "view_count": _count(c.view_count.value), "like_count": _count(c.like_count.value),
        "comment_count": F.when(~off, _count(c.comment_count.value)), "comments_disabled": off,
        "tags": page.texts_of(TAGS), "category": c.category.value,
        "transcript_segments": segments, "media_urls": media, "thumbnail_url": let(thumb, resolve),
        "selectors_used": F.concat(
            used_selectors(c, list(VIDEO)), F.filter(F.array(stamp.selector), lambda s: s.isNotNull())
        ),
        "is_public": gates.is_public(page.all_text()),
    }


def _read_channel(page: Page, c: Column) -> Values:
    title = page.attr_chain([("meta[property='og:title']", "content")], non_empty=True)
    about = page.attr_chain([("meta[name='description']", "content")], non_empty=True)
    name, text = F.nullif(c["name"].value, F.lit("")), F.nullif(c.description.value, F.lit(""))
    videos = F.transform(
        page.select(RECENT),
        lambda n: F.struct(
            blank_to_null(n.attrs.getItem("data-video-id")).alias("video_id"),
            page.text(F.get(page.inside(n, RECENT_TITLE), F.lit(0))).alias("title"),
            _count(page.text(F.get(page.inside(n, RECENT_VIEWS), F.lit(0)))).alias("view_count"),
        ),
    )
    re_read = F.array(
        F.when(name.isNull(), title.selector), F.when(text.isNull(), about.selector)
    )
    return {
        "content_type": F.lit("profile"),
        "channel_id": page.first_attr(CHANNEL_ID, "data-channel-id"),
        "name": F.coalesce(name, title.value, c["name"].value),
        "description": F.coalesce(text, about.value, c.description.value),
        "subscriber_count": _count(c.subscriber_count.value),
        "video_count": _count(c.video_count.value), "view_count": _count(c.view_count.value),
        "joined_date": c.joined_date.value, "recent_videos": videos,
        "selectors_used": F.concat(
            used_selectors(c, list(CHANNEL)), F.filter(re_read, lambda s: s.isNotNull())
        ),
        "is_public": gates.is_public(page.all_text()),
    }


def _unify_video(_page: Page, e: Column) -> Values:
    return {
        "content_type": e.content_type, "title": e.title, "text": e.description, "author": e.channel,
        "author_url": e.channel_url, "timestamp": e.timestamp, "views": e.view_count,
        "likes": e.like_count, "comments": e.comment_count, "media_urls": e.media_urls,
        "thumbnail_url": e.thumbnail_url, "tags": e.tags, "selectors_used": e.selectors_used,
    }


def _unify_channel(page: Page, e: Column) -> Values:
    return {
        "title": e["name"], "text": e.description, "author": e["name"], "author_url": page.url,
        "views": e.view_count, "selectors_used": e.selectors_used,
    }


_VIDEOS = PageRules(VIDEO, _read_video, _unify_video)
YOUTUBE = Pack(
    name="youtube",
    platforms=["youtube"],
    url_patterns=URL_PATTERNS,
    page_type=lambda page: urls.youtube_page_type(page.url),
    pages={
        "video": _VIDEOS, "short": _VIDEOS,
        "profile": PageRules(CHANNEL, _read_channel, _unify_channel),
    },
)
