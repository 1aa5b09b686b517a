"""Model names, their tiers, and what a call is expected to cost, as columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X


def mapped(table: dict, key: Column, otherwise: Column) -> Column:
    return F.coalesce(F.create_map(*map(F.lit, chain.from_iterable(table.items())))[key], otherwise)


def normal_id(model: Column) -> Column:
    """Without vendor and date, in lower case, separators as one dash."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(model), r"^[a-z0-9_-]+/", ""), r"-\d{8}$", "")
    return F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def tier_hint(model: Column) -> Column:
    said = F.translate(model, "-_.", "   ")
    return F.when(said.rlike(X.LARGE_HINT), "large").when(said.rlike(X.SMALL_HINT), "small").otherwise("medium")


def excluded(model: Column) -> Column:
    return model.rlike(X.EXCLUDED_MODEL)


def effort_tokens(effort: Column) -> Column:
    """Tokens of thought by effort; a level that is not known counts as high, none given as the default."""
    return F.when(F.coalesce(effort, F.lit("")) == "", X.DEFAULT_EFFORT).otherwise(mapped(X.EFFORT_TOKENS, effort, F.lit(X.EFFORT_TOKENS["high"])))


def estimated_cost(provider: Column, tier: Column, unit: Column, effort: Column, known_in: Column, known_out: Column, auto: Column) -> Column:
    """Cost of a call by the known price, else half as much again as a small one where the vendor picks, else the tier's guess."""
    guess = lambda k: mapped({f"{u} {t}": p[k] for (u, t), p in X.PRICE_GUESS.items()}, F.concat_ws(" ", unit, F.when(auto, "small").otherwise(tier)), F.lit(0.0)) * F.when(auto, 1.5).otherwise(1.0)
    read = mapped(X.OVERHEAD_TOKENS, provider, F.lit(0)) + X.PROMPT_TOKENS
    written = X.ANSWER_TOKENS + effort_tokens(effort)
    return (F.coalesce(known_in, guess(0)) * read + F.coalesce(known_out, guess(1)) * written) / 1_000_000
