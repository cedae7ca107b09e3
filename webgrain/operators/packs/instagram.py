"""Posts, reels and profiles of Instagram."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from webgrain.functions import scalars, urls
from webgrain.operators.extract import image_urls, profile_stats
from webgrain.operators.rules import Pack, PageRules, Values, used_selectors
from webgrain.operators.selectors import Page

# --- fixed values: selectors ----------------------------------------------------
POST = {
    "caption": [
        "article._aatb div._a9zs h1", "article div[class*='_a9zs'] span", "meta[property='og:title']",
    ],
    "author_username": [
        "article._aatb header a", "article header a[href^='/']", "meta[property='og:title']",
    ],
    "timestamp": ["article._aatb time", "article time[datetime]"],
    "likes_count": ["article._aatb section span", "article section span[class*='_aacl']"],
    "comments_count": ["article._aatb a[href*='comments'] span", "article a[href*='comments']"],
}
REEL = {
    "caption": ["div._a9zs span", "meta[property='og:title']"],
    "author_username": ["header a[href^='/']", "meta[property='og:title']"],
    "views_count": ["span._aacl"],
    "likes_count": ["section span._aacl", "span[class*='_aacl']"],
    "timestamp": ["time[datetime]"],
}
PROFILE = {
    "display_name": ["header h2", "header h1", "meta[property='og:title']"],
    "bio": ["header div._aa_c", "header span[class*='_aa_c']", "meta[property='og:description']"],
    "follower_count": ["header ul li span"],
    "following_count": ["header ul li span"],
    "post_count": ["header ul li span"],
}
URL_PATTERNS = [
    r"https?://(www\.)?instagram\.com/p/[^/]+/?",
    r"https?://(www\.)?instagram\.com/reel/[^/]+/?",
    r"https?://(www\.)?instagram\.com/[^/]+/?",
]
# --- end of fixed values ----------------------------------------------------------


def _text(chain: Column) -> Column:
    return F.nullif(chain.value, F.lit(""))


def _count(chain: Column) -> Column:
    return scalars.parse_count(_text(chain), "instagram")


def _common(page: Page, c: Column, kind: str, chains: dict) -> Values:
    caption = F.coalesce(_text(c.caption), page.meta("og:title"))
    author = scalars.clean_handle(_text(c.author_username))
    media = image_urls(page)
    return {
        "content_type": F.lit(kind), "caption": caption, "text": caption,
        "author_username": author,
        "author_url": F.concat(F.lit("https://instagram.com/"), author),
        "timestamp": scalars.parse_timestamp(c.timestamp.stamp),
        "likes_count": _count(c.likes_count),
        "media_urls": media, "thumbnail_url": F.get(media, F.lit(0)),
        "tags": scalars.hashtags(F.coalesce(caption, F.lit(""))),
        "selectors_used": used_selectors(c, list(chains)),
    }


def _read_post(page: Page, c: Column) -> Values:
    out = _common(page, c, "post", POST)
    return {
        **out, "comments_count": _count(c.comments_count),
        "mentions": scalars.mentions(F.coalesce(out["caption"], F.lit(""))),
    }


def _read_reel(page: Page, c: Column) -> Values:
    return {
        **_common(page, c, "reel", REEL), "views_count": _count(c.views_count),
        "audio_attribution": page.meta("og:title"),
    }


def _read_profile(page: Page, c: Column) -> Values:
    user = urls.instagram_user(page.url)
    stats = profile_stats(page, "instagram")
    thumbs = image_urls(page, with_og=False)
    return {
        "content_type": F.lit("profile"),
        "title": F.coalesce(_text(c.display_name), user),
        "text": F.coalesce(_text(c.bio), page.meta("og:description")),
        "author_username": user, "author_url": page.url,
        "follower_count": stats.followers, "following_count": stats.following,
        "posts_count": stats.posts, "media_urls": thumbs,
        "selectors_used": used_selectors(c, list(PROFILE)),
    }


def _unify_post(_page: Page, e: Column) -> Values:
    return {
        "text": e.caption, "author": e.author_username, "author_url": e.author_url,
        "timestamp": e.timestamp, "likes": F.nullif(e.likes_count, F.lit(0)),
        "comments": F.nullif(e.comments_count, F.lit(0)), "media_urls": e.media_urls,
        "thumbnail_url": e.thumbnail_url, "tags": e.tags, "selectors_used": e.selectors_used,
        "mentions": F.to_json(e.mentions),
    }


def _unify_reel(_page: Page, e: Column) -> Values:
    return {
        "text": e.caption, "author": e.author_username, "author_url": e.author_url,
        "timestamp": e.timestamp, "likes": F.nullif(e.likes_count, F.lit(0)),
        "views": F.nullif(e.views_count, F.lit(0)), "media_urls": e.media_urls,
        "thumbnail_url": e.thumbnail_url, "tags": e.tags, "selectors_used": e.selectors_used,
        "audio_attribution": e.audio_attribution,
    }


def _unify_profile(_page: Page, e: Column) -> Values:
    return {
        "title": e.title, "text": e.text, "author": e.author_username, "author_url": e.author_url,
        "media_urls": e.media_urls, "selectors_used": e.selectors_used,
        "follower_count": e.follower_count, "following_count": e.following_count,
        "posts_count": e.posts_count,
    }


INSTAGRAM = Pack(
    name="instagram",
    platforms=["instagram"],
    url_patterns=URL_PATTERNS,
    strategies=["browser", "http"],
    page_type=lambda page: urls.instagram_page_type(page.url),
    pages={
        "post": PageRules(POST, _read_post, _unify_post),
        "reel": PageRules(REEL, _read_reel, _unify_reel),
        "profile": PageRules(PROFILE, _read_profile, _unify_profile),
    },
)
