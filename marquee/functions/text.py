"""String expressions (Column -> Column). Everything stays in the JVM; no Python is run per row."""

from __future__ import annotations

import html.entities
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee import config

# Unicode-aware classes that mean the same in Java and RE2; Java's own \w and \s are ASCII only.
WS = r"[\p{Z}\s\x1c-\x1f\x{85}]+"
PUNCT = r"[^\p{L}\p{N}_ ]"
# fixed values: one trailing word dropped before punctuation, without a word edge ("olive" -> "o")
TRAILING_WORD = r" *(?:live|concert|tour|show|presents?|featuring|feat\.?|ft\.?) *$"
# signs that a trailing word and the blank before it have at most, and some
TRAILING = 16
# a character reference: a number with or without its semicolon, or a name with it
REFERENCE = r"&(?:#[xX][0-9A-Fa-f]++;?|#[0-9]++;?|[A-Za-z][A-Za-z0-9]*+;)"
# a comment or a tag with the white space around it; each begins where the space before it does
MARKUP = r"(?s)(?:\G|(?<!\s))\s*+(?:<!--.*?-->|<[^>]*+>)\s*+"


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` computed once per row, however often ``use`` refers to it.

    Without it every reference is a copy of the whole expression: large plans, and repeated work wherever common
    subexpressions are not shared (filters, branches, lambdas).
    """
    return F.get(F.transform(F.array(x), use), F.lit(0))


def squeeze(x: Column) -> Column:
    """Any run of white space, Unicode spaces included, as one blank; ends trimmed."""
    return F.trim(F.regexp_replace(x, WS, " "))


def squeeze_ends(x: Column) -> Column:
    """Ends trimmed of any white space; the inside is left as written."""
    return F.regexp_replace(x, r"^[\p{Z}\s]++|(?<![\p{Z}\s])[\p{Z}\s]++$", "")


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _base_norm(x: Column) -> Column:
    return F.regexp_replace(squeeze(F.lower(x)), r"^the ", "")


def _no_punct(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, PUNCT, ""), r"  +", " "))


def identity_norm(x: Column) -> Column:
    """Normal form of the identity key: lower case, no leading "the", no punctuation, single blanks."""
    return _no_punct(_base_norm(x))


def match_norm(x: Column) -> Column:
    """Normal form used for duplicate matching: as identity, less one trailing filler word."""
    # the trailing word is looked for at the end alone: a long text has many places where it might begin
    return _no_punct(let(_base_norm(x), lambda t: F.concat(F.substr(t, F.lit(1), F.greatest(F.length(t) - TRAILING, F.lit(0))),
                                                           F.regexp_replace(F.right(t, F.lit(TRAILING)), TRAILING_WORD, ""))))


def words(norm: Column) -> Column:
    """Distinct words of a normal form; the empty form has none."""
    return F.filter(F.array_distinct(F.split(norm, " ")), lambda w: w != "")


def identity_key(artist: Column, venue: Column, day: Column) -> Column:
    return F.concat_ws("|", identity_norm(artist), identity_norm(venue), F.date_format(day, "yyyy-MM-dd"))


def html_escape(x: Column) -> Column:
    for raw, ent in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]:
        x = F.replace(x, F.lit(raw), F.lit(ent))
    return x


def _named() -> dict[str, str]:
    """Characters by reference name: the standard library's table of the 252 names of HTML 4, and ``&apos;``.

    The page tree (``functions.tree``) knows all later names too; here a larger table would be copied into every plan.
    """
    return {name: html.entities.html5[name + ";"] for name in [*html.entities.name2codepoint, "apos"]}


def _numbered() -> dict[str, str]:
    """What the numbers of the control block 128 to 159 mean in pages, where that differs."""
    return {str(i): c for i in range(128, 160) if (c := bytes([i]).decode("cp1252", "ignore"))}


def _character(ref: Column, named: Column, numbered: Column) -> Column:
    """The text of one character reference; an unknown name stays as written, a number outside Unicode is the replacement sign."""
    name = F.regexp_extract(ref, "&([^;]+);?", 1)
    hexed = F.regexp_extract(ref, "^&#[xX]0*([0-9A-Fa-f]*)", 1)
    plain = F.regexp_extract(ref, "^&#0*([0-9]*)", 1)
    is_hex = F.rlike(ref, F.lit("^&#[xX]"))
    long = F.when(is_hex, F.length(hexed) > 6).otherwise(F.length(plain) > 7)
    code = F.when(is_hex, F.conv(F.when(~long & (hexed != ""), hexed).otherwise("0"), 16, 10)).otherwise(F.when(~long & (plain != ""), plain).otherwise("0")).cast("int")
    bad = long | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    number = F.when(bad, F.lit("\ufffd")).otherwise(F.coalesce(F.try_element_at(numbered, code.cast("string")), F.decode(F.unhex(F.lpad(F.hex(F.when(bad, 65).otherwise(code)), 8, "0")), "UTF-32")))
    return F.when(ref.startswith("&#"), number).otherwise(F.coalesce(F.try_element_at(named, name), ref))


def decode_entities(x: Column) -> Column:
    """Decode character references, each once; text without ``&`` is returned untouched."""
    named, numbered = (folded(m, "map<string,string>") for m in (_named(), _numbered()))

    def decode(t: Column) -> Column:
        refs = F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0))
        whole = F.zip_with(F.split(t, REFERENCE), refs, lambda piece, ref: F.concat(piece, F.when(ref.isNull(), F.lit("")).otherwise(_character(ref, named, numbered))))
        return F.when(F.contains(t, F.lit("&")), F.array_join(whole, "")).otherwise(t)

    return let(x, decode)


def element_text(inner: Column) -> Column:
    """Text of an element's inner markup: tags and comments out, each piece trimmed, entities decoded."""
    return F.trim(decode_entities(squeeze_ends(F.regexp_replace(inner, MARKUP, ""))))


def strip_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def absolute_url(url: Column, base: str | Column | None) -> Column:
    """Keep http links; prefix ``base`` to others, or drop them when there is no base. Empty links are null."""
    if base is None:
        return let(url, lambda u: F.when(u.startswith("http"), u))
    prefix = F.lit(base) if isinstance(base, str) else base
    return let(url, lambda u: F.when(u.startswith("http"), u).when(u != "", F.concat(prefix, u)))


def source_label(prefix: str, note: Column, default: str) -> Column:
    """``prefix (note)`` when there is a note, else ``default``."""
    return F.when(F.length(note) > 0, F.concat(F.lit(f"{prefix} ("), note, F.lit(")"))).otherwise(F.lit(default))


def safe_file_name(name: Column) -> Column:
    """Letters, digits and ``.-_ `` only, trimmed; null when nothing is left."""
    return blank_to_null(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}.\-_ ]", "")))


def suffix(name: Column) -> Column:
    """Lower-case extension with its dot; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(name, r"[^./\\](\.[^./\\]*)$", 1))


def folded(value: object, schema: str) -> Column:
    """A nested constant: one node in the plan, folded to a literal before execution."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), schema)


def contains_any(text: Column, literals: list[str]) -> Column:
    """Whether ``text`` holds any of the literals; stops at the first hit."""
    return F.exists(folded(literals, "array<string>"), lambda k: F.contains(text, k))


def display_line(artist: Column, venue: Column, time: Column) -> Column:
    tail = F.when(F.length(time) > 0, F.concat(F.lit(" ("), time, F.lit(")"))).otherwise(F.lit(""))
    return F.concat(artist, F.lit(" — "), venue, tail)


def page_line(artist: Column, venue: Column, time: Column, url: Column) -> Column:
    """One list item of the published page, linked when there is a url."""
    tail = F.when(F.length(time) > 0, F.concat(F.lit(' <span class="time">('), html_escape(time), F.lit(")</span>")))
    body = F.concat(F.lit('<span class="artist">'), html_escape(artist), F.lit('</span> — <span class="venue">'),
                    html_escape(venue), F.lit("</span>"), F.coalesce(tail, F.lit("")))
    return F.when(F.length(url) > 0,
                  F.concat(F.lit('<li><a href="'), html_escape(url), F.lit('" target="_blank" rel="noopener">'), body,
                           F.lit("</a></li>"))).otherwise(F.concat(F.lit("<li>"), body, F.lit("</li>")))


def megabytes(n_bytes: Column) -> Column:
    return n_bytes / F.lit(1024 * 1024)


def venue_source(venue: Column) -> Column:
    return F.concat(F.lit("Venue: "), venue)


def preferred_source(source: Column) -> Column:
    return contains_any(source, config.PREFERRED_SOURCES)
