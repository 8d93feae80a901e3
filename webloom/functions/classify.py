"""Classifiers as columns, made from the rule tables."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import rules
from webloom.functions.url import Name, _c


def any_part(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(or_, (text.contains(p) for p in parts), F.lit(False))


def url_type(url: Name) -> Column:
    low, out = F.lower(_c(url)), F.lit(rules.DEFAULT_TYPE)
    for kind, parts in reversed(rules.URL_TYPES):
        out = F.when(any_part(low, parts), kind).otherwise(out)
    return out


def topic_matches(topic: tuple, url: Name, title: Name, kind: Name) -> Column:
    """By a part of the URL or title, or by the content type; a topic without a type matches every row."""
    _, urls, titles, own = topic
    by_type = F.lit(True) if own is None else _c(kind) == own
    return any_part(F.lower(_c(url)), urls) | any_part(F.lower(_c(title)), titles) | by_type


def topics(url: Name, title: Name, kind: Name) -> Column:
    """A row's topics, sorted."""
    return F.array_sort(F.array_compact(F.array(*(F.when(topic_matches(t, url, title, kind), t[0]) for t in rules.TOPICS))))


def suspicious_title(title: Name) -> Column:
    return any_part(F.lower(_c(title)), rules.SUSPICIOUS_TITLES)


def error_text(kind: Name, message: Name) -> Column:
    out = F.lit(None).cast("string")
    for k, shown in rules.ERRORS.items():
        head, gap, tail = shown.partition("{}")
        out = F.when(_c(kind) == k, F.concat(F.lit(head), F.coalesce(_c(message), F.lit("")), F.lit(tail)) if gap else F.lit(head)).otherwise(out)
    return out


def non_retryable(kind: Name, message: Name) -> Column:
    k = _c(kind)
    return F.coalesce(k.isin("bot", "rate_limit") | ((k == "search") & any_part(F.lower(_c(message)), rules.NON_RETRYABLE_PARTS)), F.lit(False))


def transient(kind: Name, message: Name) -> Column:
    k = _c(kind)
    return F.coalesce(k.isin("http", "timeout") | ((k == "search") & any_part(F.lower(_c(message)), rules.TRANSIENT_PARTS)), F.lit(False))


def retry_class(kind: Name, message: Name) -> Column:
    """What is done about an error: the first test decides."""
    return F.when(non_retryable(kind, message), "non_retryable").when(transient(kind, message), "transient").otherwise("other")


def status_class(status: Name) -> Column:
    s = _c(status)
    return F.when(s.between(200, 299), "ok").when(s == 429, "transient:rate_limit").when(s == 403, "permanent:bot").otherwise(F.concat(F.lit("permanent:HTTP "), s.cast("string")))


def safe_search(level: Name) -> Column:
    """The code of a level, in either case; null for no level."""
    up, out = F.upper(_c(level)), F.lit(None).cast("int")
    for k, code in rules.SAFE_SEARCH.items():
        out = F.when(up == k, code).otherwise(out)
    return out


def is_notification(id_: Name) -> Column:
    """A request whose id, a variant, is absent or null."""
    return _c(id_).isNull() | F.coalesce(F.is_variant_null(_c(id_)), F.lit(True))


def mime(content_type: Name) -> Column:
    return F.lower(F.trim(F.split_part(_c(content_type), F.lit(";"), F.lit(1))))


def known_binary(content_type: Name) -> Column:
    m = mime(content_type)
    return reduce(or_, (m.startswith(p) for p in rules.BINARY_PREFIXES)) | m.isin(*rules.BINARY_EXACT)


def binary_mime(m: Name) -> Column:
    return known_binary(m) | (_c(m) == "application/pdf") | _c(m).startswith("application/vnd.")


def sample_hex(parts: tuple[tuple[int, str], ...]) -> str:
    """The shortest beginning that has a signature, in hexadecimal; what is between its parts is zero."""
    out = ""
    for at, own in parts:
        out = out.ljust(2 * at, "0") + own
    return out


def sniffed(body: Name) -> Column:
    """The content type that a body's bytes tell, by the table of signatures and their places, then by markup; null if none."""
    reach = max(at + len(own) // 2 for _, parts in rules.SIGNATURES for at, own in parts)

    def told(x: Column) -> Column:
        has = lambda at, own: F.substring(x["h"], 2 * at + 1, len(own)) == own
        kinds = [F.when(reduce(and_, (has(at, own) for at, own in parts)), kind) for kind, parts in rules.SIGNATURES]
        frame = F.when(F.substring(x["h"], 1, 4).isin(*rules.MPEG_FRAMES), "audio/mpeg")
        markup = F.when(x["t"].rlike(r"^\s*(<!doctype html|<html|<head|<body|<script|<title|<!--)"), "text/html").when(x["t"].rlike(r"^\s*<\?xml"), "text/xml")
        return F.coalesce(*kinds, frame, markup)

    start = F.struct(F.hex(F.substring(_c(body), 1, reach)).alias("h"), F.lower(F.decode(F.substring(_c(body), 1, 64), "ISO-8859-1")).alias("t"))
    return F.transform(F.array(start), told)[0]  # the bytes are looked at once


def body_fits(body: Name) -> Column:
    return F.octet_length(_c(body)) <= rules.MAX_BODY


def route_by(m: Column, s: Column, is_text: Column) -> Column:
    """html, pdf or binary: by the header (m) if it tells pdf or binary, else by the first bytes (s), else by header and UTF-8."""
    by_bytes = (
        F.when(s == "application/pdf", "pdf")
        .when(s.isin("text/html", "application/xhtml+xml"), "html")
        .when(F.coalesce(binary_mime(s), F.lit(False)), "binary")
        .when(s.startswith("text/"), "html")
    )
    fallback = F.when(m.contains("text/html") | is_text, "html").otherwise("binary")
    return F.when(m.contains("application/pdf"), "pdf").when(known_binary(m), "binary").otherwise(F.coalesce(by_bytes, fallback))


def binary_name(m: Column, s: Column) -> Column:
    """What a binary body is called: its declared content type if known, else its sniffed or its declared one, or octet-stream."""
    return F.when(known_binary(m), m).otherwise(F.coalesce(s, F.nullif(m, F.lit("")), F.lit("application/octet-stream")))
