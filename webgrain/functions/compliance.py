"""Content gates and redaction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from webgrain.functions.text import contains_any

# --- fixed values -----------------------------------------------------------
PAYWALL_MARKERS = ["subscription", "paywall", "subscribe to read", "article__paywall"]
# What personal data becomes, in the order of replacement.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
GOVERNMENT_ID = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
PHONE = r"(\+[0-9]{1,3}[ .-]?)?(\([0-9]{3}\) ?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b"
REDACTIONS = [(EMAIL, "[EMAIL]"), (GOVERNMENT_ID, "[ID]"), (PHONE, "[PHONE]")]
# Numbers of other countries and kinds; cards and accounts count only with a right check digit.
WORLD_PHONE = r"(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[ ./()-]{0,2}[0-9]){6,12}(?![0-9])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
ACCOUNT = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![0-9A-Za-z])"
# Attributes that name a paywall, the phrase as the text of an element, and what schema.org says of paid articles.
PAYWALL_ATTRIBUTE = r"""(?is)<[a-z][^<>]*\s(?:class|id|name|data-[a-z-]+)\s*=\s*["']?[^"'<>]*(?:paywall|subscription)[^<>]*>"""
PAYWALL_PHRASE = r"(?is)>\s*subscribe to read\b[^<]{0,80}<"
PAID_ARTICLE = r"""(?i)"isAccessibleForFree"\s*:\s*"?(?:false|no)\b"""
# --- end of fixed values ----------------------------------------------------


def noindex(robots: Column) -> Column:
    """The content of the page's robots meta element forbids indexing; False without one."""
    return F.coalesce(F.lower(robots).rlike(r"(^|[\s,])(noindex|none)([\s,]|$)"), F.lit(False))


def paywalled(html: Column) -> Column:
    """The page carries a common paywall marker; False for NULL."""
    return F.coalesce(contains_any(F.lower(html), PAYWALL_MARKERS), F.lit(False))


def redacted(text: Column) -> Column:
    """E-mail addresses, government ids and phone numbers replaced; NULL stays NULL."""
    for pattern, label in REDACTIONS:
        text = F.regexp_replace(text, pattern, label)
    return text


def redaction_count(text: Column) -> Column:
    """How many pieces ``redacted`` replaces."""
    found = F.lit(0)
    for pattern, label in REDACTIONS:
        found = found + F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
        text = F.regexp_replace(text, pattern, label)
    return found.cast("bigint")


def paywall_markup(html: Column) -> Column:
    """N2 without prose: a marker in an attribute, as the text of an element, or in the page's own metadata; False for NULL."""
    return F.coalesce(html.rlike(PAYWALL_ATTRIBUTE) | html.rlike(PAYWALL_PHRASE) | html.rlike(PAID_ARTICLE), F.lit(False))


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def right_card(number: Column) -> Column:
    """Whether the check digit of a card number is right (Luhn); blanks and hyphens do not count."""
    digits = _characters(F.reverse(F.regexp_replace(number, "[^0-9]", "")))
    worth = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def right_account(number: Column) -> Column:
    """Whether the check digits of an international account number are right (mod 97)."""
    plain = F.replace(number, F.lit(" "), F.lit(""))
    turned = _characters(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4))))
    rest = F.aggregate(turned, F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return rest == 1


def _without_right(text: Column, pattern: str, right: Callable[[Column], Column], label: str) -> Column:
    """What ``pattern`` finds and ``right`` accepts, wherever it stands alone, as ``label``."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), right))
    alone = lambda x: F.concat(F.lit(r"(?<![0-9A-Za-z])\Q"), x, F.lit(r"\E(?![0-9A-Za-z])"))
    return F.aggregate(found, text, lambda a, x: F.regexp_replace(a, alone(x), F.lit(label)))


def redacted_numbers(text: Column) -> Column:
    """N4 beyond one country: cards and accounts whose check digits are right, then phone numbers with a country code; NULL stays NULL."""
    text = _without_right(text, CARD, right_card, "[CARD]")
    text = _without_right(text, ACCOUNT, right_account, "[ACCOUNT]")
    return F.regexp_replace(text, WORLD_PHONE, "[PHONE]")
