"""Small column helpers shared by the whole package."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F


# Characters that count as white space at the ends of a text.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Higher-order functions are interpreted, so a repeated sub-expression would
    be computed again at every use; a one-element ``transform`` binds it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(value: Column) -> Column:
    """Trim every kind of (Unicode) white space, not just blanks."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def blank_to_null(value: Column) -> Column:
    """NULL for strings that are empty after trimming."""
    return F.when(strip(value) != "", value)


def contains_any(value: Column, needles: list[str]) -> Column:
    """True when one of the literal ``needles`` occurs in ``value``; one pass over it."""
    return value.rlike("|".join(re.escape(n) for n in needles))


def found_of(value: Column, needles: list[str]) -> Column:
    """The literal ``needles`` that occur in ``value``, in list order."""
    tagged = F.array(*[F.when(value.contains(n), F.lit(n)) for n in needles])
    return F.filter(tagged, lambda n: n.isNotNull())


def first_of(value: Column, needles: list[str]) -> Column:
    """The first literal of ``needles`` that occurs in ``value``, else NULL."""
    return F.coalesce(*[F.when(value.contains(n), F.lit(n)) for n in needles])
