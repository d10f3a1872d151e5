"""Patterns over raw page text, for what needs no document tree: embedded scripts, and the links of saved pages. Each runs in time and stack
that do not depend on how long a stretch of text is: no repeated group, possessive runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.text import blank_to_null, decode_entities

SCRIPT_JSONLD = r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
SCRIPT_STATE = r"(?s)<script id=\"__NEXT_DATA__\"[^>]*>(.*?)</script>"


def attribute(attrs: Column, name: str) -> Column:
    """Decoded attribute value; null when absent or empty."""
    pattern = rf"(?is)(?:^|\s){name}\s*=\s*[\"']([^\"']*)[\"']"
    return blank_to_null(decode_entities(F.regexp_extract(attrs, pattern, 1)))


def own_tag(card: Column) -> Column:
    return F.regexp_extract(card, r"^<[^>]*>", 0)


def inside(card: Column) -> Column:
    return F.regexp_replace(card, r"^<[^>]*>", "")


