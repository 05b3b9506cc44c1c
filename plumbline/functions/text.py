"""Text rules: ordered keyword classification, id cleaning, year extraction, history search."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.scalars import ColumnLike, col

# Edit categories by keyword, first list (order matters; keywords are plain substrings).
EDIT_RULES_V1: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("background_replacement", (
        "background", "sky", "behind", "landscape", "setting", "in the sea", "on a beach", "at a beach",
        "on the grass", "in the snow", "in a forest", "in space", "in the park", "indoor", "outdoor",
        "on the water", "desert", "underwater")),
    ("face_modification", (
        "face", "hair", "smile", "beard", "glasses", "sunglasses", "mustache", "bald", "head", "eyes", "mouth",
        "expression", "hat", "cap", "helmet", "teeth", "wrinkles", "eyebrows", "makeup", "blonde", "brunette",
        "person smile", "look happy")),
    ("object_removal", (
        "remove", "delete", "erase", "take away", "take out", "get rid of", "clear the", "cut out", "eliminate",
        "disappear", "without the", "take off the")),
    ("object_insertion", (
        "add", "put a", "put an", "insert", "place a", "place an", "include", "draw a", "draw an", "give him",
        "give her", "give the", "set a", "have a", "there be a", "lay a", "lay an")),
    ("object_replacement", (
        "replace", "change the", "change that", "change this", "turn into", "turn the", "swap", "convert",
        "switch", "transform", "substitute", "instead of")),
)

# Edit categories by keyword, second list.
EDIT_RULES_V2: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("object_removal", ("remove", "delete", "erase", "take away", "clear")),
    ("object_insertion", ("add", "insert", "put", "place", "bring")),
    ("object_replacement", ("replace", "change", "swap", "turn into", "substitute")),
    ("background_replacement", ("background", "sky", "scenery")),
    ("face_modification", ("face", "hair", "smile", "eyes", "person")),
)

EDIT_FALLBACK = "inpainting"


def alternation(keywords: Sequence[str]) -> str:
    return "|".join(re.escape(k) for k in keywords)


def first_keyword_label(text: ColumnLike, rules: Sequence[tuple[str, Sequence[str]]] = EDIT_RULES_V2,
                        fallback: str = EDIT_FALLBACK) -> Column:
    """Label of the first rule with a keyword in the text. Keywords are plain substrings, so each is a byte
    search that stops at its first hit, and the rest of the chain is skipped."""
    lowered = F.lower(col(text))
    chain = None
    for label, keywords in rules:
        hit = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(k)) for k in keywords])
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return F.lit(fallback) if chain is None else chain.otherwise(F.lit(fallback))


def source_id(sample_id: ColumnLike, prefixes: Sequence[str]) -> Column:
    """Drop every given prefix wherever it stands, then keep what precedes the first underscore."""
    return F.split_part(F.regexp_replace(col(sample_id), alternation(prefixes), ""), F.lit("_"), F.lit(1))


def year_in_text(text: ColumnLike, first: int = 1800, last: int = 2026) -> Column:
    """First all-digit token within [first, last]; NULL when there is none."""
    tokens = F.split(F.regexp_replace(col(text), "[-/]", " "), r"\s+")
    # A year in the range has at most nine significant digits, so the cast cannot overflow.
    years = F.filter(
        tokens,
        lambda t: t.rlike(r"^0*[0-9]{1,9}$") & F.coalesce(t.try_cast("bigint").between(first, last), F.lit(False)),
    )
    return F.try_element_at(years, F.lit(1))


def history_match(query: str, *columns: ColumnLike) -> Column:
    """Case-insensitive "contains" over several columns; an empty query matches everything."""
    needle = query.strip().lower()
    if not needle:
        return F.lit(True)
    hits = [F.contains(F.lower(col(c).cast("string")), F.lit(needle)) for c in columns]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return F.coalesce(out, F.lit(False))


def normalised_text(text: ColumnLike) -> Column:
    """Lower case with runs of white space collapsed: the text form compared by the fuzzy fingerprint."""
    return F.trim(F.regexp_replace(F.lower(col(text)), r"[ \t\n\r\f\v]+", " "))
