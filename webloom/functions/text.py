"""Text as columns: words, entities, titles, Markdown, languages, snippets."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import rules
from webloom.functions.lazy import pandas_column
from webloom.functions.url import Name, _c

#: Unicode white space.
SPACE = r"(?U)\s+"


def words(text: Name) -> Column:
    return F.filter(F.split(_c(text), SPACE), lambda w: w != "")


def word_count(text: Name) -> Column:
    return F.when(_c(text).isNotNull(), F.size(words(text))).cast("long")


def squeezed(text: Name) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.array_join(words(text), " ")


# -- fixed values: entities in the order they are decoded; what a step makes, the next may decode again.
ENTITIES = (("&#x27;", "'"), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "))


def _from_hex(digits: Column) -> Column:
    """The character of a hexadecimal number; null if there is none."""
    code = F.conv(digits, 16, 10).cast("long")
    good = (F.length(digits) <= 8) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(good, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"))


def clean_text(text: Name) -> Column:
    """Entities decoded in their order, then hexadecimal ones, then white space squeezed."""
    out = _c(text)
    for entity, sign in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(sign))
    # Cut before each entity: every piece but the first begins with one. Only texts that have any are cut.
    head = "^&#x([0-9a-fA-F]+);"

    def decoded(piece: Column, digits: Column) -> Column:
        return F.coalesce(F.concat(_from_hex(F.nullif(digits, F.lit(""))), F.regexp_replace(piece, head, "")), piece)

    def whole(t: Column) -> Column:
        pieces = F.transform(F.split(t, "(?=&#x[0-9a-fA-F]+;)"), lambda p: F.struct(p.alias("p"), F.regexp_extract(p, head, 1).alias("d")))
        return F.when(t.contains("&#x"), F.array_join(F.transform(pieces, lambda x: decoded(x["p"], x["d"])), "")).otherwise(t)

    return squeezed(F.transform(F.array(out), whole)[0])  # an array of one, so that a text is made once


def trim(text: Name) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def clean_title(title: Name) -> Column:
    """What stands before the first separator, one kind of separator after another."""
    out = _c(title)
    for separator in (" | ", " - ", " :: ", " — "):
        out = F.split_part(out, F.lit(separator), F.lit(1))
    return trim(out)


def link_text(text: Name) -> Column:
    """Squeezed; null if of two bytes or less."""
    out = squeezed(text)
    return F.when(F.octet_length(out) > 2, out)


def clean_markdown(markdown: Name) -> Column:
    """Lines trimmed, lone list signs dropped, runs of empty lines made one."""
    lines = F.transform(F.split(_c(markdown), "\r?\n"), trim)
    kept = F.array_join(F.filter(lines, lambda x: ~x.isin("-", "*", "+")), "\n")
    return trim(F.regexp_replace(kept, "\n{3,}", "\n\n"))


def snippet(text: Name, chars: int = rules.SNIPPET) -> Column:
    return F.left(_c(text), F.lit(chars))


def is_sparse(text: Name) -> Column:
    return F.octet_length(_c(text)) < rules.SPARSE_BYTES


def language(text: Name) -> Column:
    out = F.lit("en")
    for name, scripts in reversed(rules.LANGUAGES):
        out = F.when(_c(text).rlike(f"[{scripts}]"), name).otherwise(out)
    return out


#: Control signs but for line feed, carriage return and tab.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def nonprintable_share(text: Name) -> Column:
    """Of all bytes, the share of control signs; 0 of an empty text, null of none."""
    t = _c(text)
    return F.when(t == "", 0.0).otherwise(F.regexp_count(t, F.lit(CONTROL)) / F.octet_length(t))


def looks_like_article(text: Name) -> Column:
    """Not empty, no NUL, few control signs, a letter somewhere."""
    t = _c(text)
    return (t != "") & ~t.contains("\x00") & (nonprintable_share(t) < 0.05) & t.rlike(r"\p{L}")


def lossy_utf8(body: Name) -> Column:
    """Bytes as text; what is not UTF-8 becomes replacement signs."""
    return F.make_valid_utf8(_c(body).cast("string"))


@pandas_column("string")
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def decode_entities(text: Name) -> Column:
    """All named and numbered entities of HTML; texts without an ampersand need no parser."""
    t = _c(text)
    return F.when(t.contains("&"), _unescape(t)).otherwise(t)
