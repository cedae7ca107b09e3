"""Videos and profiles of TikTok."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from webgrain.functions import scalars, urls
from webgrain.operators.extract import completeness
from webgrain.operators.rules import Pack, PageRules, Values, used_selectors
from webgrain.operators.selectors import Page

# --- fixed values: selectors ----------------------------------------------------
VIDEO = {
    "description": [
        "h1[data-e2e='browse-video-desc']", ".tt-caption p", ".post-caption p",
        "meta[property='og:description']",
    ],
    "author_username": [
        "a.tt-author-link .tt-username", ".tt-author-link .author-name", ".author-name",
        "meta[property='og:url']",
    ],
    "play_count": ["strong[data-e2e='play-count']", ".tt-views", ".view-count"],
    "like_count": ["strong[data-e2e='like-count']", ".tt-likes", ".like-count"],
    "comment_count": ["strong[data-e2e='comment-count']", ".tt-comments", ".comment-count"],
    "share_count": ["strong[data-e2e='share-count']", ".tt-shares", ".share-count"],
    "music_title": ["h4[data-e2e='music-title']", ".tt-sound-title", ".music-info .title"],
    "timestamp": ["time.timestamp", "time[datetime]", ".tt-video-date"],
}
PROFILE = {
    "username": ["h1[data-e2e='user-title']", ".tt-username", ".profile-username"],
    "display_name": ["h2[data-e2e='user-subtitle']", ".tt-nickname", ".profile-display-name"],
    "bio": ["p[data-e2e='user-bio']", ".tt-bio", ".profile-bio"],
    "follower_count": ["strong[data-e2e='followers-count']", ".tt-followers", ".follower-count"],
    "following_count": ["strong[data-e2e='following-count']", ".tt-following", ".following-count"],
    "likes_count": ["strong[data-e2e='likes-count']", ".tt-likes", ".likes-count"],
    "video_count": ["strong[data-e2e='video-count']", ".tt-videos", ".video-count"],
}
VIDEO_ID = [("article[data-video-id]", "data-video-id"), ("[data-video-id]", "data-video-id")]
VIDEO_SRC = ["video.post-media", "video", "meta[property='og:video']"]
VIDEO_POSTER = ["video.post-media", "meta[property='og:image']"]
VIDEO_DURATION = ["video.post-media", "video", "meta[property='og:video:duration']"]
ITEMS = ".tt-video-item, [data-e2e='user-post-item'], .tt-video-card"
ITEM_LINK, ITEM_THUMB, ITEM_VIEWS = "a[href*='/video/']", "img, video", ".tt-video-views, .view-count"
PROFILE_MARK = ".tt-profile-page, [data-e2e='user-page']"
VIDEO_MARK = ".tt-video-page, [data-e2e='video-page']"
URL_PATTERNS = [
    r"https?://(www\.)?tiktok\.com/@[^/]+/video/\d+",
    r"https?://(www\.)?tiktok\.com/video/\d+",
    r"https?://(www\.)?tiktok\.com/@[^/]+/?$",
]
# --- end of fixed values ----------------------------------------------------------


def _count(chain: Column) -> Column:
    return scalars.parse_count(chain.value, "tiktok")


def _report(c: Column, chains: dict, extra_reason: Column) -> Values:
    warnings, reasons = completeness({n: c[n] for n in chains}, {n: s[0] for n, s in chains.items()})
    more = F.filter(F.array(extra_reason), lambda r: r.isNotNull())
    return {"warnings": warnings, "partial_reasons": F.concat(reasons, more)}


def _user_url(user: Column) -> Column:
    bare = F.regexp_replace(user, "^@+", "")
    return F.when(user != "", F.concat(F.lit("https://www.tiktok.com/@"), bare))


def _read_video(page: Page, c: Column) -> Values:
    attr = lambda selectors, name: page.attr_chain(
        [(s, name) for s in selectors], non_empty=True
    ).value
    video_id = page.attr_chain(VIDEO_ID, non_empty=True).value
    return {
        "description": c.description.value, "author_username": c.author_username.value,
        "author_url": _user_url(c.author_username.value),
        "play_count": _count(c.play_count), "like_count": _count(c.like_count),
        "comment_count": _count(c.comment_count), "share_count": _count(c.share_count),
        "music_title": c.music_title.value,
        "timestamp": scalars.parse_timestamp(c.timestamp.value),
        "video_id": video_id, "video_url": attr(VIDEO_SRC, "src"),
        "thumbnail_url": attr(VIDEO_POSTER, "poster"),
        "duration": scalars.parse_duration(attr(VIDEO_DURATION, "data-duration")),
        "hashtags": scalars.hashtags(F.coalesce(c.description.value, F.lit(""))),
        "selectors_used": F.array_distinct(used_selectors(c, list(VIDEO))),
        **_report(c, VIDEO, F.when(video_id.isNull(), "video_id: no matching selectors found")),
    }


def _videos(page: Page) -> Column:
    def item(n: Column) -> Column:
        one = lambda s: F.get(page.inside(n, s), F.lit(0))
        filled = lambda v: F.nullif(v, F.lit(""))
        thumb = one(ITEM_THUMB).attrs
        return F.struct(
            F.coalesce(filled(n.attrs.getItem("data-video-id")), filled(n.attrs.getItem("data-id")))
            .alias("video_id"),
            one(ITEM_LINK).attrs.getItem("href").alias("url"),
            F.coalesce(filled(thumb.getItem("poster")), filled(thumb.getItem("src"))).alias("thumbnail_url"),
            # The view text keeps its words here, so "450K views" stays unread.
            scalars.parse_engagement(page.text(one(ITEM_VIEWS))).alias("views"),
        )

    return F.transform(page.select(ITEMS), item)


def _read_profile(page: Page, c: Column) -> Values:
    videos = _videos(page)
    return {
        "username": F.regexp_replace(c.username.value, "^@+", ""),
        "author_url": _user_url(c.username.value),
        "display_name": c.display_name.value, "bio": c.bio.value,
        "follower_count": _count(c.follower_count), "following_count": _count(c.following_count),
        "likes_count": _count(c.likes_count), "video_count": _count(c.video_count),
        "recent_videos": videos,
        "selectors_used": F.array_distinct(
            F.concat(used_selectors(c, list(PROFILE)), F.array(F.lit(".tt-video-item")))
        ),
        **_report(c, PROFILE, F.when(F.size(videos) == 0, "recent_videos: no matching selectors found")),
    }


def _partial(e: Column) -> Values:
    return {
        "_warnings": F.when(F.size(e.warnings) > 0, F.to_json(e.warnings)),
        "_partial_reasons": F.when(F.size(e.partial_reasons) > 0, F.to_json(e.partial_reasons)),
        "data_completeness": F.when(F.size(e.partial_reasons) > 0, "partial"),
    }


def _unify_video(_page: Page, e: Column) -> Values:
    return {
        "title": e.description, "text": e.description, "author": e.author_username,
        "author_url": e.author_url, "timestamp": e.timestamp, "likes": e.like_count,
        "shares": e.share_count, "comments": e.comment_count, "views": e.play_count,
        "media_urls": F.filter(F.array(e.video_url), lambda v: v != ""),
        "thumbnail_url": e.thumbnail_url, "tags": e.hashtags,
        "selectors_used": F.array_distinct(F.concat(
            e.selectors_used,
            F.filter(F.array(F.when(e.video_id.isNotNull(), "article[data-video-id]"),
                             F.when(e.video_url.isNotNull(), "video.post-media")), lambda s: s.isNotNull()),
        )),
        **_partial(e),
    }


def _unify_profile(_page: Page, e: Column) -> Values:
    return {
        "title": e.display_name, "text": e.bio, "author": e.username, "author_url": e.author_url,
        "likes": e.likes_count, "views": e.video_count, "selectors_used": e.selectors_used,
        **_partial(e),
    }


TIKTOK = Pack(
    name="tiktok",
    platforms=["tiktok"],
    url_patterns=URL_PATTERNS,
    strategies=["browser", "http"],
    page_type=lambda page: urls.tiktok_page_type(
        page.url, F.size(page.select(PROFILE_MARK)) > 0, F.size(page.select(VIDEO_MARK)) > 0
    ),
    pages={
        "video": PageRules(VIDEO, _read_video, _unify_video),
        "profile": PageRules(PROFILE, _read_profile, _unify_profile),
    },
)
