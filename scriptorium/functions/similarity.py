"""Similarity of names, dates, places and descriptions, and the match score, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .sequences import ratios
from .text import normal_place, tokens

# Weights of the factors of a match.
WEIGHTS = {"name_exact": 1.0, "name_partial": 0.7, "name_edit": 0.5, "date_overlap": 0.8, "date_near": 0.6, "place": 0.9, "context": 0.4}
#: Pairs of names that a task remembers.
MEMO = 100_000
YEAR = r"(?U)\b(1[5-9]\d{2}|20\d{2})\b"


def exact(a: Column, b: Column) -> Column:
    """1 if two cleaned, lower-case names are equal and there is a name, else 0."""
    return F.when((a == b) & (F.length(a) > 0), 1.0).otherwise(0.0)


def partial(a: Column, b: Column) -> Column:
    """Shared tokens over those of the larger set; takes arrays of distinct tokens."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / most)


def edit(a: Column, b: Column) -> Column:
    """1 - edit distance of lower-case names over the longer length; 0 if either is empty."""
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(F.lower(a), F.lower(b)) / F.greatest(F.length(a), F.length(b)))


def sequence_bound(a: Column, b: Column) -> Column:
    """An upper bound of sequence(): twice the shorter length over the sum of lengths."""
    return F.when(F.length(a) + F.length(b) == 0, 1.0).otherwise(2 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b)))


@F.pandas_udf(DoubleType())
def sequence(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp ratio; not symmetric, so the order of the names matters. No native function gives it.

    Names recur, so each task remembers a bounded number of pairs; the new ones of a batch are judged together.
    """
    memo: dict[tuple[str, str], float] = {}
    for left, right in pairs:
        rows = [(a or "", b or "") for a, b in zip(left, right, strict=True)]
        new = list(dict.fromkeys(p for p in rows if p not in memo))
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list(dict.fromkeys(rows))
        memo.update(zip(new, ratios(new).tolist(), strict=True))
        yield pd.Series([memo[p] for p in rows], dtype="float64")


def years(dates: Column) -> Column:
    """Years from 1500 to 2099 in an array of date texts, in order."""
    return F.flatten(F.transform(dates, lambda d: F.transform(F.regexp_extract_all(d, F.lit(YEAR), 1), lambda y: y.cast("int"))))


def date_similarity(a: Column, b: Column) -> Column:
    """Of two arrays of years: overlap of their ranges over the span, or nearness within ten years, else 0."""
    a0, a1, b0, b1 = F.array_min(a), F.array_max(a), F.array_min(b), F.array_max(b)
    low, high = F.greatest(a0, b0), F.least(a1, b1)
    span = F.greatest(a1, b1) - F.least(a0, b0) + 1
    gap = low - high
    score = F.when(low <= high, (high - low + 1) / span).when(gap <= 10, 1 - gap / 20).otherwise(0.0)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(score).cast("double")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def place_set(places: Column) -> Column:
    """Distinct normalised places."""
    return F.array_distinct(F.transform(places, normal_place))


def word_set(text: Column) -> Column:
    """Distinct lower-case words of a description."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), 0))


def context(occ_a: Column, occ_b: Column, words_a: Column, words_b: Column) -> Column:
    """Mean of what is there of both: occupations and description words."""
    jobs, said = (F.size(occ_a) > 0) & (F.size(occ_b) > 0), (F.size(words_a) > 0) & (F.size(words_b) > 0)
    total = F.when(jobs, jaccard(occ_a, occ_b)).otherwise(0.0) + F.when(said, jaccard(words_a, words_b)).otherwise(0.0)
    n = jobs.cast("int") + said.cast("int")
    return F.when(n > 0, total / n).otherwise(0.0)


def name_tokens(cleaned: Column) -> Column:
    """Distinct lower-case tokens of a cleaned name."""
    return F.array_distinct(tokens(F.lower(cleaned)))


def name_factor(is_exact: Column, part: Column, best: Column) -> tuple[Column, Column]:
    """Score and weight of the name: exact beats partial beats edit, whatever their size."""
    w = WEIGHTS
    score = F.when(is_exact > 0, is_exact).when(part > 0.5, part).otherwise(best)
    weight = F.when(best <= 0, 0.0).when(is_exact > 0, w["name_exact"]).when(part > 0.5, w["name_partial"]).otherwise(w["name_edit"])
    return score, weight


def factors(is_exact: Column, part: Column, best: Column, date: Column, place: Column, ctx: Column) -> dict[str, tuple[Column, Column]]:
    """Score and weight of each factor, in the order in which they are summed."""
    w = WEIGHTS
    date_weight = F.when(date <= 0, 0.0).when(date > 0.7, w["date_overlap"]).otherwise(w["date_near"])
    place_weight, ctx_weight = F.when(place > 0, w["place"]).otherwise(0.0), F.when(ctx > 0, w["context"]).otherwise(0.0)
    return {"name": name_factor(is_exact, part, best), "date": (date, date_weight), "place": (place, place_weight), "context": (ctx, ctx_weight)}


def match_score(is_exact: Column, part: Column, best: Column, date: Column, place: Column, ctx: Column) -> Column:
    """Weighted mean of the factors above zero, 0 without any; summed in the order name, date, place, context."""
    scores = factors(is_exact, part, best, date, place, ctx).values()
    total, weight = reduce(add, [s * w for s, w in scores]), reduce(add, [w for _, w in scores])
    return F.when(weight > 0, total / weight).otherwise(0.0)
