"""Views of the given tables that several queries share."""

from __future__ import annotations

from webgrain.plans.registry import View

# The event log read as a log of fetches: one row per attempt.
OUTCOMES = View(
    "events",
    seq="event_id",
    ts="ts",
    host="concat('h', user_id, '.example.com')",
    domain="concat('h', user_id, '.example.com')",
    ok="event_type <> 'error'",
    latency_ms="value * 20",
    strategy="CASE WHEN event_id % 2 = 0 THEN 'http' ELSE 'browser' END",
    status="CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 3 = 0 THEN 429 "
           "WHEN event_id % 3 = 1 THEN 403 ELSE NULL END",
    error="CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 5 = 0 THEN 'AntiBotDetectedError' "
          "WHEN event_id % 5 = 1 THEN 'RateLimitExceededError' WHEN event_id % 5 = 2 THEN 'UnsupportedURLError' "
          "ELSE 'RetryableError' END",
    error_code="CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 5 = 2 THEN 'SCR_001' "
               "WHEN event_id % 5 = 4 THEN NULL ELSE 'SCR_011' END",
    confidence="CAST(event_id % 101 AS DOUBLE) / 100",
)

# The same log read as selector results.
SELECTORS = View(
    "events",
    seq="event_id",
    ts="ts",
    platform="CASE WHEN user_id % 3 = 0 THEN 'x' WHEN user_id % 3 = 1 THEN 'tiktok' ELSE 'generic' END",
    domain="concat('h', user_id, '.example.com')",
    field="concat('f', event_id % 4)",
    selector="concat('.', event_type)",
    matched="value > CASE WHEN event_type = 'error' THEN 40 ELSE 12 END",
    confidence="CAST(event_id % 101 AS DOUBLE) / 100",
)

# Orders read as stored results of scraping runs.
RESULTS = View(
    "orders",
    id="concat('r', o_orderkey)",
    url="concat('https://shop.example.com/order/', o_orderkey)",
    platform="CASE WHEN o_orderstatus = 'F' THEN 'x' WHEN o_orderstatus = 'O' THEN 'generic' ELSE 'unknown' END",
    created_at="o_orderdate",
    output_json="CASE WHEN o_orderstatus = 'P' THEN NULL ELSE concat('{\"n\":', o_custkey, '}') END",
)

# Raw URLs with tracking parameters, mixed case and fragments around every page.
RAW_URLS = View(
    "pages",
    page_id="page_id",
    url="url",
    raw="concat('  ', url, CASE WHEN contains(url, '#') THEN '' WHEN contains(url, '?') THEN '&UTM_Medium=m&b=1&b=2' "
        "ELSE '?fbclid=z&k&q=a+b%7Ec' END, ' ')",
)

# One URL per page and platform shape.
PLATFORM_URLS = View(
    "pages",
    page_id="page_id",
    url="CASE page_id % 16 "
        "WHEN 0 THEN concat('https://www.instagram.com/p/A', page_id) "
        "WHEN 1 THEN concat('https://instagram.com/reel/R', page_id) "
        "WHEN 2 THEN concat('https://instagram.com/user', page_id) "
        "WHEN 3 THEN concat('https://x.com/u', page_id, '/status/', page_id) "
        "WHEN 4 THEN concat('https://twitter.com/home', '/') "
        "WHEN 5 THEN concat('https://www.tiktok.com/@u', page_id, '/video/', page_id) "
        "WHEN 6 THEN concat('https://www.tiktok.com/@u', page_id) "
        "WHEN 7 THEN concat('https://www.linkedin.com/posts/p', page_id) "
        "WHEN 8 THEN concat('https://www.linkedin.com/in/p', page_id) "
        "WHEN 9 THEN concat('https://www.linkedin.com/company/c', page_id) "
        "WHEN 10 THEN concat('https://www.facebook.com/g/posts/', page_id) "
        "WHEN 11 THEN concat('https://www.facebook.com/g', page_id) "
        "WHEN 12 THEN concat('https://www.youtube.com/watch?t=1&v=v', page_id) "
        "WHEN 13 THEN concat('https://youtu.be/y', page_id) "
        "WHEN 14 THEN concat('https://www.youtube.com/shorts/s', page_id) "
        "ELSE url END",
    kind="page_id % 16",
)
