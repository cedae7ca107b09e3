"""Posts and profiles of X."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from webgrain.functions import scalars, urls
from webgrain.operators.extract import image_urls
from webgrain.operators.rules import Pack, PageRules, Values, used_selectors
from webgrain.operators.selectors import Page

# --- fixed values: selectors ----------------------------------------------------
POST = {
    "text": [".tweet-text", "div[lang='en']", "meta[property='og:description']"],
    "author_username": [
        ".tweet-author", ".tweet-author-link .tweet-author", "a[href^='/'] .tweet-author",
        "meta[property='og:title']",
    ],
    "timestamp": ["time[datetime]", ".timestamp"],
    "like_count": [".like-count", "button[aria-label*='like']"],
    "retweet_count": [".share-count", "button[aria-label*='retweet']"],
    "reply_count": [".comment-count", "button[aria-label*='reply']"],
}
PROFILE = {
    "display_name": [".profile-display-name", "h1", "meta[property='og:title']"],
    "username": [".profile-username", "h2", "meta[property='og:title']"],
    "bio": [".profile-bio", "meta[property='og:description']"],
    "location": [".profile-location"],
    "website": [".profile-website", "a[href^='http']"],
    "join_date": [".profile-join-date"],
    "follower_count": [".follower-count"],
    "following_count": [".following-count"],
    "tweet_count": [".tweet-count"],
}
RECENT_TWEETS = ".recent-tweets .tweet-text"
URL_PATTERNS = [
    r"https?://(www\.)?(twitter|x)\.com/[^/]+/status/\d+",
    r"https?://(www\.)?(twitter|x)\.com/i/web/status/\d+",
    r"https?://(www\.)?(twitter|x)\.com/[^/]+/?",
]
# --- end of fixed values ----------------------------------------------------------


def _text(chain: Column) -> Column:
    return F.nullif(chain.value, F.lit(""))


def _count(text: Column) -> Column:
    return scalars.parse_count(text, "x")


def _read_post(page: Page, c: Column) -> Values:
    text = F.coalesce(_text(c.text), page.meta("og:description"))
    media = image_urls(page)
    filled = F.coalesce(text, F.lit(""))
    return {
        "content_type": F.lit("post"), "tweet_id": urls.tweet_id(page.url), "text": text,
        "author_username": scalars.clean_handle(_text(c.author_username)),
        "timestamp": c.timestamp.stamp,
        "like_count": _text(c.like_count), "retweet_count": _text(c.retweet_count),
        "reply_count": _text(c.reply_count), "media_urls": media,
        "thumbnail_url": F.get(media, F.lit(0)), "tags": scalars.hashtags(filled),
        "mentions": scalars.mentions(filled), "selectors_used": used_selectors(c, list(POST)),
    }


def _read_profile(page: Page, c: Column) -> Values:
    user = F.coalesce(
        _text(c.username),
        F.concat(F.lit("@"), F.coalesce(urls.x_user(page.url), F.lit("None"))),
    )
    return {
        "content_type": F.lit("profile"), "display_name": _text(c.display_name), "username": user,
        "author_username": F.regexp_replace(user, "^@+", ""),
        "bio": F.coalesce(_text(c.bio), page.meta("og:description")),
        "location": _text(c.location),
        "website": F.nullif(F.trim(c.website.href), F.lit("")),
        "join_date": _text(c.join_date), "follower_count": _text(c.follower_count),
        "following_count": _text(c.following_count), "tweet_count": _text(c.tweet_count),
        "recent_tweets": page.texts_of(RECENT_TWEETS),
        "selectors_used": used_selectors(c, list(PROFILE)),
    }


def _author_url(user: Column) -> Column:
    return F.concat(F.lit("https://x.com/"), F.regexp_replace(user, "^@+", ""), F.lit("/"))


def _unify_post(_page: Page, e: Column) -> Values:
    return {
        "text": e.text, "author": e.author_username, "author_url": _author_url(e.author_username),
        "timestamp": scalars.parse_timestamp(e.timestamp), "likes": _count(e.like_count),
        "shares": _count(e.retweet_count), "comments": _count(e.reply_count),
        "media_urls": e.media_urls, "thumbnail_url": e.thumbnail_url, "tags": e.tags,
        "selectors_used": e.selectors_used, "tweet_id": e.tweet_id,
    }


def _unify_profile(_page: Page, e: Column) -> Values:
    return {
        "title": e.display_name, "text": e.bio, "author": e.author_username,
        "author_url": _author_url(e.author_username), "selectors_used": e.selectors_used,
        "recent_tweets": F.to_json(e.recent_tweets), "display_name": e.display_name,
        "location": e.location, "website": e.website, "join_date": e.join_date, "bio": e.bio,
        "follower_count": _count(e.follower_count), "following_count": _count(e.following_count),
        "tweet_count": _count(e.tweet_count),
    }


X = Pack(
    name="x_twitter",
    platforms=["x", "x_twitter"],
    url_patterns=URL_PATTERNS,
    page_type=lambda page: urls.x_page_type(page.url),
    pages={
        "post": PageRules(POST, _read_post, _unify_post),
        "profile": PageRules(PROFILE, _read_profile, _unify_profile),
    },
)
