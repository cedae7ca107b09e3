"""Posts, profiles and companies of LinkedIn."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from webgrain.functions import scalars, urls
from webgrain.operators.extract import completeness
from webgrain.operators.rules import Pack, PageRules, Values, used_selectors
from webgrain.operators.selectors import Page

# --- fixed values: selectors ----------------------------------------------------
PROFILE = {
    "name": ["h1.top-card-layout__title", ".profile-name", "h1.profile-topcard__name", "h1"],
    "headline": [".top-card-layout__headline", ".profile-headline", ".profile-topcard__summary"],
    "location": [".top-card-layout__first-subline", ".profile-location", ".profile-topcard__location"],
    "industry": [".top-card-layout__second-subline", ".profile-industry"],
    "current_position": [
        ".experience-item__title", ".profile-current-position", ".experience-section li",
    ],
    "education": [".education-item__school-name", ".profile-education", ".education-section li"],
    "connections_count": [".top-card-layout__connections", ".profile-connections", ".connections-count"],
}
COMPANY = {
    "name": ["h1.top-card-layout__title", ".company-name", "h1.org-top-card-summary__title", "h1"],
    "industry": [
        ".top-card-layout__first-subline", ".company-industry", ".org-about-company-module__industry",
    ],
    "company_size": [
        ".top-card-layout__second-subline", ".company-size", ".org-about-company-module__company-size",
    ],
    "headquarters": [
        ".company-headquarters", ".org-about-company-module__headquarters", ".top-card-layout__subline",
    ],
    "description": [
        ".company-description", ".org-about-us-organization-description__text", ".description",
        "meta[property='og:description']",
    ],
    "follower_count": [
        ".company-follower-count", ".org-top-card-summary__follower-count", ".follower-count",
    ],
    "website": [".company-website a", ".org-about-us-company-module__website", "a[href^='http']"],
}
POST = {
    "author": [".feed-shared-actor__name", ".li-name", ".author-name", ".profile-name"],
    "author_headline": [".feed-shared-actor__description", ".li-headline", ".author-headline"],
    "text": [
        ".feed-shared-update-v2__description", ".li-content p", ".post-caption p",
        "meta[property='og:description']",
    ],
    "timestamp": ["time[datetime]", ".li-timestamp", ".feed-shared-actor__sub-description"],
    "reaction_count": [
        ".social-details-social-counts__reactions-count", ".li-reactions", ".reaction-count",
    ],
    "comment_count": [".social-details-social-counts__comments", ".li-comments", ".comment-count"],
    "repost_count": [".social-details-social-counts__shares", ".li-shares", ".share-count"],
}
SPECIALTIES = ".company-specialties li, .org-about-company-module__specialties li"
POST_ID = [
    ("article[data-urn]", "data-urn"), ("[data-activity-urn]", "data-activity-urn"),
    (".li-post[data-id]", "data-id"),
]
POST_TIME = [("time[datetime]", "datetime"), (".li-timestamp", "datetime")]
URL_PATTERNS = [
    r"https?://(www\.)?linkedin\.com/posts/.+",
    r"https?://(www\.)?linkedin\.com/pulse/.+",
    r"https?://(www\.)?linkedin\.com/activity/.+",
    r"https?://(www\.)?linkedin\.com/in/[^/]+/?",
    r"https?://(www\.)?linkedin\.com/company/[^/]+/?",
]
# --- end of fixed values ----------------------------------------------------------


def _count(chain: Column) -> Column:
    return scalars.parse_count(chain.value, "linkedin")


def _report(c: Column, chains: dict, extra_reason: Column | None = None) -> Values:
    warnings, reasons = completeness({n: c[n] for n in chains}, {n: s[0] for n, s in chains.items()})
    if extra_reason is not None:
        reasons = F.concat(reasons, F.filter(F.array(extra_reason), lambda r: r.isNotNull()))
    return {"warnings": warnings, "partial_reasons": reasons}


def _plain(c: Column, chains: dict) -> Values:
    return {
        **{n: c[n].value for n in chains},
        "selectors_used": F.array_distinct(used_selectors(c, list(chains))),
    }


def _read_profile(_page: Page, c: Column) -> Values:
    return {
        **_plain(c, PROFILE), "connections_count": _count(c.connections_count),
        **_report(c, PROFILE),
    }


def _read_company(page: Page, c: Column) -> Values:
    specialties = page.texts_of(SPECIALTIES)
    site = page.attr_chain([(s, "href") for s in COMPANY["website"]], non_empty=True).value
    return {
        **_plain(c, COMPANY), "follower_count": _count(c.follower_count),
        "website": F.coalesce(site, c.website.value), "specialties": specialties,
        **_report(c, COMPANY, F.when(F.size(specialties) == 0, "specialties: no matching selectors found")),
    }


def _read_post(page: Page, c: Column) -> Values:
    post_id = page.attr_chain(POST_ID, non_empty=True).value
    stamp = F.coalesce(page.attr_chain(POST_TIME, non_empty=True).value, c.timestamp.value)
    author = F.nullif(c.author.value, F.lit(""))
    return {
        **_plain(c, POST), "id": post_id,
        "reaction_count": _count(c.reaction_count), "comment_count": _count(c.comment_count),
        "repost_count": _count(c.repost_count), "timestamp": scalars.parse_timestamp(stamp),
        "author_url": F.concat(F.lit("https://www.linkedin.com/in/"), scalars.name_slug(author), F.lit("/")),
        **_report(c, POST, F.when(post_id.isNull(), "id: no matching selectors found")),
    }


def _partial(e: Column) -> Values:
    return {
        "_warnings": F.when(F.size(e.warnings) > 0, F.to_json(e.warnings)),
        "_partial_reasons": F.when(F.size(e.partial_reasons) > 0, F.to_json(e.partial_reasons)),
        "data_completeness": F.when(F.size(e.partial_reasons) > 0, "partial"),
    }


def _unify_profile(page: Page, e: Column) -> Values:
    return {
        "title": e["name"], "text": e.headline, "author": e["name"], "author_url": page.url,
        "selectors_used": e.selectors_used, **_partial(e),
    }


def _unify_company(page: Page, e: Column) -> Values:
    return {
        "title": e["name"], "text": e.description, "author": e["name"], "author_url": page.url,
        "likes": e.follower_count, "tags": e.specialties,
        "selectors_used": F.array_distinct(
            F.concat(e.selectors_used, F.array(F.lit(".company-specialties li")))
        ),
        **_partial(e),
    }


def _unify_post(_page: Page, e: Column) -> Values:
    return {
        "title": e.text, "text": e.text, "author": e.author, "author_url": e.author_url,
        "timestamp": e.timestamp, "likes": e.reaction_count, "shares": e.repost_count,
        "comments": e.comment_count,
        "selectors_used": F.when(
            e.id.isNotNull(),
            F.array_distinct(F.concat(e.selectors_used, F.array(F.lit("article[data-urn]")))),
        ).otherwise(e.selectors_used),
        **_partial(e),
    }


LINKEDIN = Pack(
    name="linkedin",
    platforms=["linkedin"],
    url_patterns=URL_PATTERNS,
    strategies=["browser", "http"],
    requires_auth=True,
    page_type=lambda page: urls.linkedin_page_type(page.url),
    pages={
        "post": PageRules(POST, _read_post, _unify_post),
        "profile": PageRules(PROFILE, _read_profile, _unify_profile),
        "company": PageRules(COMPANY, _read_company, _unify_company),
    },
)
