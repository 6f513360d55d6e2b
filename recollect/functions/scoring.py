"""Rewards, conformity scores, costs, expiry and request checks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions.text import word_count

# Money per 1000 output tokens by backend, and for a backend not listed.
RATES = {"ollama": 0.0, "groq": 0.00027, "openai": 0.015}
UNKNOWN_RATE = 0.01


def storage_bytes(size: Column, text: Column) -> Column:
    """Given size, or the UTF-8 length of the text where it is missing or zero."""
    return F.when(F.coalesce(size, F.lit(0)) == 0, F.octet_length(text).cast("bigint")).otherwise(
        size.cast("bigint")
    )


def output_tokens(tokens: Column, text: Column) -> Column:
    return F.coalesce(tokens.cast("bigint"), word_count(text).cast("bigint"))


def token_cost(tokens: Column, backend: Column, rates: dict[str, float] | None = None) -> Column:
    """tokens / 1000 x the rate of the backend."""
    rate = F.lit(UNKNOWN_RATE)
    for name, price in (RATES if rates is None else rates).items():
        rate = F.when(backend == name, F.lit(price)).otherwise(rate)
    return tokens / F.lit(1000.0) * rate


def stamp_expiry(created: Column, ttl_s: Column) -> Column:
    """When an entry expires; null (never) for a ttl of zero."""
    return F.when(ttl_s > 0, created + F.make_dt_interval(secs=ttl_s))


def is_expired(now: Column, expires: Column) -> Column:
    return F.coalesce(now > expires, F.lit(False))


def implicit_reward(tier: Column, similarity: Column) -> Column:
    """Reward read off a hit: 1 for an exact hit, a ramp over similarity for a semantic one."""
    ramp = (similarity - F.lit(0.65)) / F.lit(0.20)
    return F.when(tier == 1, F.lit(1.0)).when(
        (tier == 2) & (similarity > 0),
        F.when(similarity >= F.lit(0.85), F.lit(1.0))
        .when(similarity < F.lit(0.65), F.lit(0.0))
        .otherwise(ramp),
    )


def nonconformity(similarity: Column, was_correct: Column) -> Column:
    wrong = F.least(F.lit(1.0), F.greatest(F.lit(1.0) - similarity + F.lit(0.1), F.lit(0.5)))
    return F.when(was_correct, F.lit(1.0) - similarity).otherwise(wrong)


def priority(
    frequency: Column, usd: Column, embed_ms: Column, size: Column, inflation: Column, extra_ms: float = 0.0
) -> Column:
    """Retention priority: frequency x cost of regeneration per byte, plus inflation."""
    cost = usd * F.lit(1e6) + embed_ms + F.lit(extra_ms)
    return frequency * cost / F.greatest(size, F.lit(1)) + inflation


def request_error(query: Column, similarity: Column, title: Column) -> Column:
    """Name of the first bound a request breaks, null for a good one."""
    n = F.length(query)
    return (
        F.when(query.isNull() | (n < 1), F.lit("query_empty"))
        .when(n > 10_000, F.lit("query_too_long"))
        .when((similarity < 0) | (similarity > 1), F.lit("similarity_out_of_range"))
        .when((F.length(title) < 1) | (F.length(title) > 200), F.lit("title_length"))
    )
