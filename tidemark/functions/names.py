"""Names in comparable form, identifiers made from them, and what they say about a record."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark entertainment, and the text repairs of damaged feeds.
ENTERTAINMENT = ["world of color", "fireworks", "parade", "nighttime spectacular", "magic happens", "fantasmic"]
REPAIRS = {
    "Indiana Jones�?Adventure": "Indiana Jones™ Adventure",
    "Soarin�?Across America": "Soarin’ Across America",
    "Pixar Pal-A-Round �?Non-Swinging": "Pixar Pal-A-Round – Non-Swinging",
}
SLUG_LENGTH = 80
_KEPT = re.compile(r"[a-z0-9'\- ]")


@lru_cache(maxsize=1)
def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """By rule: characters whose compatibility decomposition, without accents, has a kept character; single and longer ones."""
    single, longer = {}, {}
    for code in range(0x80, 0x30000):
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not "̀" <= c <= "ͯ")
        if plain != char and _KEPT.search(plain):
            (single if len(plain) == 1 else longer)[char] = plain
    return single, longer


def decomposed(text: Column) -> Column:
    """Compatibility decomposition without accents, as far as it gives ASCII; other characters stay. No Python runs per row."""
    single, longer = _decompositions()
    flat = F.regexp_replace(F.translate(text, "".join(single), "".join(single.values())), "[̀-ͯ]", "")
    # One literal, so that the plan that carries it stays small.
    known = F.from_json(F.lit(json.dumps(longer)), "map<string,string>")
    spelled = F.array_join(F.transform(F.split(flat, ""), lambda c: F.coalesce(F.try_element_at(known, c), c)), "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.when(flat.rlike(r"[^\x00-\x7F]"), spelled).otherwise(flat)).otherwise(text)


def trimmed(text: Column) -> Column:
    """Without white space at the ends, no-break spaces included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def catalog_name(name: Column) -> Column:
    """The form in which catalogue and observed names are compared; null counts as empty. A trade mark sign separates words."""
    text = decomposed(F.lower(F.coalesce(name, F.lit(""))))
    text = F.regexp_replace(F.regexp_replace(text, "[®©“”\"]", ""), "[’‘`]", "'")
    text = F.regexp_replace(F.regexp_replace(text, "[–—]", "-"), r"(?U)\s*&\s*", " and ")
    return F.trim(F.regexp_replace(text, r"[^a-z0-9'\-]+", " "))


def display_name(name: Column) -> Column:
    """The looser form in which feeds are matched: no quotes, no mark of the single-rider entry."""
    text = F.regexp_replace(F.lower(name), "[™®“”\"’']", "")
    text = F.regexp_replace(F.regexp_replace(text, "[–—]", "-"), r"\bsingle rider\b", "")
    return trimmed(F.regexp_replace(text, r"(?U)\s+", " "))


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit("unknown"))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.left(dashed, F.lit(SLUG_LENGTH)), F.lit("")), F.lit("unknown"))


def is_single_rider(name: Column) -> Column:
    return F.coalesce(name.rlike(r"(?iU)\bsingle\s+rider\b"), F.lit(False))


def base_name(name: Column) -> Column:
    """Without the first mark of a single-rider entry and the space around it."""
    return trimmed(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?isU)^(.*?)\s*single\s+rider\s*(.*)$", "$1$2"))


def is_entertainment(name: Column) -> Column:
    return F.coalesce(name.rlike(rf"(?i)\b({'|'.join(ENTERTAINMENT)})\b"), F.lit(False))


def repaired(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for damaged, right in REPAIRS.items():
        text = F.replace(text, F.lit(damaged), F.lit(right))
    return text
