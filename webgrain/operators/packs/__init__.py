"""Built-in rule packs, in registration order."""

from webgrain.operators.packs.facebook import FACEBOOK
from webgrain.operators.packs.generic import GENERIC
from webgrain.operators.packs.instagram import INSTAGRAM
from webgrain.operators.packs.linkedin import LINKEDIN
from webgrain.operators.packs.samples import HACKERNEWS, QUOTES
from webgrain.operators.packs.tiktok import TIKTOK
from webgrain.operators.packs.x import X
from webgrain.operators.packs.youtube import YOUTUBE

BUILT_IN = [INSTAGRAM, X, TIKTOK, LINKEDIN, FACEBOOK, YOUTUBE, GENERIC]
SAMPLES = [HACKERNEWS, QUOTES]

__all__ = ["BUILT_IN", "SAMPLES", "FACEBOOK", "GENERIC", "HACKERNEWS", "INSTAGRAM", "LINKEDIN",
           "QUOTES", "TIKTOK", "X", "YOUTUBE"]
