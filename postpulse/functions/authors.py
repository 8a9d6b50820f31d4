"""Author reliability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postpulse.functions import dictionaries as D
from postpulse.functions.text import remembered, text_or_empty

CURATED_TIERS = D.CURATED_TIER_ORDER
CURATED_HANDLES = tuple(
    dict.fromkeys(handle for tier in CURATED_TIERS for handle in D.AUTHOR_TIERS[tier])
)


@remembered
def author_tier(username: Column) -> Column:
    """Tier of a handle; the first tier that lists it wins, anything else is 'unknown'."""
    handle = F.ltrim(F.lower(text_or_empty(username)), F.lit("@"))
    return F.coalesce(
        *[
            F.when(handle.isin([h.lower() for h in handles]), F.lit(tier))
            for tier, handles in D.AUTHOR_TIERS.items()
        ],
        F.lit(D.UNKNOWN_TIER),
    )


@remembered
def is_curated(username: Column) -> Column:
    return ~author_tier(username).isin(D.UNKNOWN_TIER, D.WATCHLIST_TIER)


@remembered
def in_curated_universe(username: Column) -> Column:
    """Membership used by the ranking, which drops every '@' in the handle."""
    handle = F.replace(F.lower(text_or_empty(username)), F.lit("@"), F.lit(""))
    return handle.isin([h.lower() for h in CURATED_HANDLES])
