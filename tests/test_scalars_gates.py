"""Scalar functions and page predicates on tables of cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from test_urls import column
from webgrain.functions import gates, scalars


def test_engagement(spark):
    cases = {"1.2K": 1200, "3M": 3000000, "1.5B": 1500000000, "1,234": 1234, "  42  ": 42, "5k": 5000, "0": 0,
             "": None, "not a number": None, "1d": None, "inf": None, "1e400": None, "1.005m": 1004999}
    assert column(spark, list(cases), scalars.parse_engagement) == list(cases.values())
    assert column(spark, [None], scalars.parse_engagement) == [None]


@pytest.mark.parametrize("family, text, n", [
    ("instagram", "1,234 likes", 1234), ("x", "1.1K Likes", 1100), ("tiktok", "1.2M views", 1200000),
    ("linkedin", "500+ connections", 500), ("hackernews", "12 points", 12),
])
def test_count_words(spark, family, text, n):
    assert column(spark, [text], lambda c: scalars.parse_count(c, family)) == [n]


def test_durations_and_timestamps(spark):
    assert column(spark, ["45", "1:05", "1:00:09", "x", "1:2:3:4", ""], scalars.parse_duration) == [
        45, 65, 3609, None, None, None]
    texts = ["2025-01-15T10:30:00+02:00", "2025-01-15", "20250115", "2025", "12:30", "soon", "2025-13-01"]
    assert column(spark, texts, scalars.parse_timestamp) == [
        datetime(2025, 1, 15, 8, 30), datetime(2025, 1, 15), datetime(2025, 1, 15), None, None, None, None]


def test_text_bits(spark):
    assert column(spark, ["a #été b #x_1"], scalars.hashtags) == [["#été", "#x_1"]]
    assert column(spark, ["@@me too"], scalars.clean_handle) == ["me"]
    assert column(spark, ["one\ntwo", ""], scalars.first_line) == ["one", None]
    assert column(spark, [" My-Site X! "], scalars.identifier) == ["my_site_x"]
    assert scalars.quote_selector("div[a=b] [c='d']") == "div[a=\"b\"] [c='d']"


def test_json(spark):
    texts = ['{"a":1}', '```json\n{"a":2}\n```', "[1]", "nope", '```\n{"a":3}```']
    assert column(spark, texts, lambda c: scalars.json_text(scalars.tolerant_json(c), "$.a")) == ["1", "2", None, None, "3"]
    assert column(spark, texts, lambda c: scalars.tolerant_json(c, object_only=False).isNotNull()) == [
        True, True, True, False, True]


def test_walls(spark):
    pages = ["Please log in to go on", "This account is private", "A plain article", "friends only"]
    assert column(spark, pages, gates.is_public) == [False, False, True, True]
    assert column(spark, pages, lambda c: gates.is_public(c, "facebook"))[3] is False
    assert column(spark, pages, lambda c: gates.wall_code(c, "linkedin")) == ["SCR_021", "SCR_021", None, None]


def test_blocks(spark):
    body = "x" * 300
    reason = lambda c: gates.challenge_reason(c, F.lit("https://a.com"), F.lit(200))
    assert column(spark, [body, "short", body + "G-RECAPTCHA"], reason) == [
        None, "HTML body is unusually short", "Challenge marker found: 'g-recaptcha'"]
    hits = column(spark, ["<p>cf-browser-verification</p>", "fine"], gates.block_indicators)
    assert hits == [["cf-browser-verification", "cloudflare"], []]
    causes = column(spark, ["captcha", "status_code"], lambda c: gates.block_cause(c, F.lit(200)))
    assert [c.cause for c in causes] == ["captcha", "other"]


def test_classifier(spark):
    html = "<title>Nice villa</title>"
    got = column(spark, ["https://a.com/property/1", "https://www.olx.eg/item/2"],
                 lambda c: gates.classify_content(F.lit(html), c))
    assert [(g.platform, g.content_type, g.confidence) for g in got] == [
        ("generic", "real_estate", 0.8), ("olx", "real_estate", 0.9)]
    low = column(spark, ["https://a.com/"], lambda c: gates.classify_content(F.lit("<p>"), c))[0]
    assert (low.content_type, low.confidence) == ("article", 0.0)


def test_numbers_with_check_digits(spark):
    from webgrain.functions import compliance

    cases = {
        "pay 4111 1111 1111 1111 now": "pay [CARD] now", "pay 4111-1111-1111-1112 now": "pay 4111-1111-1111-1112 now", "5500000000000004": "[CARD]",
        "378282246310005, 378282246310006": "[CARD], 378282246310006", "x4111111111111111": "x4111111111111111",
        "to DE89 3704 0044 0532 0130 00.": "to [ACCOUNT].", "GB82WEST12345698765432 GB82WEST12345698765431": "[ACCOUNT] GB82WEST12345698765431",
        "FR14 2004 1010 0505 0001 3M02 606": "[ACCOUNT]", "call +49 30 901820 or +33 1 23 45 67 89": "call [PHONE] or [PHONE]", "+1 (555) 010-9999!": "[PHONE]!",
        "a+4930901820 and 1+1=2": "a+4930901820 and 1+1=2", "": "", None: None, "order 1234567890123": "order 1234567890123",
    }
    table = spark.createDataFrame(list(enumerate(cases)), "i long, t string")
    got = {r.t: r.r for r in table.select("t", compliance.redacted_numbers(F.col("t")).alias("r")).collect()}
    assert got == cases


def test_paywall_in_markup_only(spark):
    from webgrain.functions import compliance

    cases = {
        '<div class="article__paywall">x</div>': True, "<i id=paywall-box>": True, "<p data-gate='subscription'>": True, "<p>Subscribe to read more</p>": True,
        '<script>{"isAccessibleForFree": "False"}</script>': True, "<p>Our subscription is about a paywall</p>": False,
        "<p>You may subscribe to read or not</p>": False, '{"isAccessibleForFree": true}': False, "<a href='/paywall'>x</a>": False, "": False, None: False,
    }
    table = spark.createDataFrame(list(enumerate(cases)), "i long, h string")
    assert {r.h: r.p for r in table.select("h", compliance.paywall_markup(F.col("h")).alias("p")).collect()} == cases
