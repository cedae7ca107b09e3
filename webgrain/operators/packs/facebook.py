"""Pages and posts of Facebook."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from webgrain.functions import gates, scalars, urls
from webgrain.functions.text import blank_to_null, let
from webgrain.operators.rules import Pack, PageRules, Values, used_selectors
from webgrain.operators.selectors import Page

# --- fixed values: selectors ----------------------------------------------------
PAGE = {
    "name": ["h1.fb-page-name", ".fb-page-name", "[data-page-id] h1"],
    "category": [".fb-page-category", "[data-page-category]"],
    "followers_count": [".fb-followers-count", ".fb-page-counts [data-field='followers']"],
    "likes_count": [".fb-likes-count", ".fb-page-counts [data-field='likes']"],
    "description": [".fb-page-description", ".fb-page-about p"],
    "website": [".fb-page-website", ".fb-page-about a[href]"],
}
POST = {
    "author": [".fb-author.author-name", ".fb-author", "[data-author-name]"],
    "text": [".fb-user-content.post-caption p", ".fb-user-content", ".post-caption"],
    "reaction_count": [".fb-reaction-count.like-count", ".fb-reaction-count", ".like-count"],
    "comment_count": [".fb-comment-count.comment-count", ".fb-comment-count", ".comment-count"],
    "share_count": [".fb-share-count.share-count", ".fb-share-count", ".share-count"],
}
POST_ID = ["article.fb-story[data-story-id]", ".fb-story[data-story-id]", "[data-story-id]"]
POST_TIME = ["time.timestamp", "time", ".timestamp"]
REACTIONS = ["like", "love", "wow", "haha", "sad", "angry"]
AUTHOR_LINK = ".fb-author-link[href]"
MEDIA = ".fb-media img[src], .fb-media video[src]"
PREVIEWS, PREVIEW_TEXT = ".fb-recent-posts .fb-post-preview", ".fb-post-preview-text"
URL_PATTERNS = [
    r"https?://(?:www\.)?facebook\.com/[^/]+/posts/[^/]+",
    r"https?://(?:www\.)?facebook\.com/[^/]+/photos/[^/]+",
    r"https?://(?:www\.)?facebook\.com/[^/]+/videos/[^/]+",
    r"https?://(?:www\.)?facebook\.com/[^/]+/reel/[^/]+",
    r"https?://(?:www\.)?facebook\.com/pages/[^/]+",
    r"https?://(?:www\.)?facebook\.com/[^/]+",
]
# --- end of fixed values ----------------------------------------------------------


def _count(text: Column) -> Column:
    return let(scalars.clean_count_text(text), scalars.parse_engagement)


def _with_attr(used: Column, *more: Column) -> Column:
    return F.concat(used, F.filter(F.array(*[m.selector for m in more]), lambda s: s.isNotNull()))


def _read_page(page: Page, c: Column) -> Values:
    site = page.attr_chain([(s, "href") for s in PAGE["website"]], non_empty=False)
    previews = F.transform(
        page.select(PREVIEWS),
        lambda n: F.struct(
            blank_to_null(n.attrs.getItem("data-post-id")).alias("post_id"),
            page.text(F.get(page.inside(n, PREVIEW_TEXT), F.lit(0))).alias("text"),
        ),
    )
    return {
        "content_type": F.lit("profile"), "name": c["name"].value, "category": c.category.value,
        "followers_count": _count(c.followers_count.value), "likes_count": _count(c.likes_count.value),
        "description": c.description.value, "website": let(site.value, lambda v: urls.resolve_url(page.url, v)),
        "recent_posts": previews,
        "selectors_used": _with_attr(used_selectors(c, list(PAGE)), site),
        "is_public": gates.is_public(page.all_text(), "facebook"),
    }


def _read_post(page: Page, c: Column) -> Values:
    post_id = page.attr_chain([(s, "data-story-id") for s in POST_ID], non_empty=False)
    stamp = page.attr_chain([(s, "datetime") for s in POST_TIME], non_empty=False)
    resolve = lambda v: urls.resolve_url(page.url, v)
    breakdown = F.map_from_arrays(
        F.array(*[F.lit(r) for r in REACTIONS]),
        # Each text is looked up once, however often its reading uses it.
        F.transform(page.first_texts([f"fb-reaction-{r}" for r in REACTIONS]), scalars.parse_engagement),
    )
    media = F.filter(
        F.transform(page.attrs_of(MEDIA, "src"), resolve),
        lambda v: v.isNotNull(),
    )
    return {
        "content_type": urls.facebook_page_type(page.url),
        "id": F.coalesce(F.nullif(post_id.value, F.lit("")), urls.facebook_post_id(page.url)),
        "author": c.author.value,
        "author_url": let(page.first_attr(AUTHOR_LINK, "href"), resolve),
        "text": c.text.value, "timestamp": scalars.parse_timestamp(stamp.value),
        "reaction_count": _count(c.reaction_count.value),
        "comment_count": _count(c.comment_count.value), "share_count": _count(c.share_count.value),
        "reactions_breakdown": breakdown, "media_urls": media,
        "selectors_used": _with_attr(used_selectors(c, list(POST)), post_id, stamp),
        "is_public": gates.is_public(page.all_text(), "facebook"),
    }


def _unify_page(page: Page, e: Column) -> Values:
    return {
        "title": e["name"], "text": e.description, "author": e["name"], "author_url": page.url,
        "likes": e.likes_count, "selectors_used": e.selectors_used,
    }


def _unify_post(_page: Page, e: Column) -> Values:
    return {
        "content_type": e.content_type, "title": scalars.first_line(e.text), "text": e.text,
        "author": e.author, "author_url": e.author_url, "timestamp": e.timestamp,
        "likes": e.reaction_count, "shares": e.share_count, "comments": e.comment_count,
        "media_urls": e.media_urls, "thumbnail_url": F.get(e.media_urls, F.lit(0)),
        "selectors_used": e.selectors_used,
    }


_POSTS = PageRules(POST, _read_post, _unify_post)
FACEBOOK = Pack(
    name="facebook",
    platforms=["facebook"],
    url_patterns=URL_PATTERNS,
    strategies=["browser", "http"],
    requires_auth=True,
    page_type=lambda page: urls.facebook_page_type(page.url),
    pages={
        "profile": PageRules(PAGE, _read_page, _unify_page),
        "post": _POSTS, "video": _POSTS, "reel": _POSTS,
    },
)
