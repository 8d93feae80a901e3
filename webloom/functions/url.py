"""URLs as columns. Parsing never fails a query: what does not parse is null or falls back as said."""

from __future__ import annotations

import posixpath
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.lazy import pandas_column

PORTS = {"http": "80", "https": "443"}
Name = Column | str


def _c(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def part(url: Name, which: str) -> Column:
    """A part of an absolute URL; null of what is none."""
    own = F.try_parse_url(_c(url), F.lit(which))
    return own if which == "PROTOCOL" else F.when(F.try_parse_url(_c(url), F.lit("PROTOCOL")).isNotNull(), own)


def unwrap_redirect(href: Name) -> Column:
    """The target of a redirect link (its ``uddg`` parameter, decoded; as it is if that fails); ``//x`` gets https."""
    href = _c(href)
    target = F.split_part(F.split_part(href, F.lit("uddg="), F.lit(2)), F.lit("&"), F.lit(1))
    decoded = F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B")))  # a plus is a plus here, not a space
    return F.when(href.contains("uddg="), F.coalesce(decoded, href)).when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href)


def domain(url: Name) -> Column:
    """The host, lower-cased; of what does not parse, all up to the first slash; else ``unknown``."""
    found = F.regexp_extract(_c(url), r"^(?:https?://)?([^/]+)", 1)
    return F.coalesce(F.lower(part(url, "HOST")), F.nullif(found, F.lit("")), F.lit("unknown"))


def is_http(url: Name) -> Column:
    """An absolute http or https URL with a host; what follows the host may hold any characters."""
    head = r"^((?i:https?)://[^/?#\s]+)"
    return F.coalesce(_c(url).rlike(head) & part(F.regexp_extract(_c(url), head, 1), "HOST").isNotNull(), F.lit(False))


def skipped_in_page(href: Name) -> Column:
    href = _c(href)
    return href.startswith("#") | href.startswith("javascript:") | href.startswith("mailto:") | href.startswith("tel:")


def skipped_in_crawl(href: Name) -> Column:
    href = _c(href)
    return (href == "") | href.startswith("#") | href.startswith("javascript:") | href.startswith("mailto:") | href.startswith(":")


def origin(url: Name) -> Column:
    """Scheme, host and port, the port written out."""
    scheme = F.lower(part(url, "PROTOCOL"))
    port = F.regexp_extract(part(url, "AUTHORITY"), r":(\d+)$", 1)
    default = F.when(scheme == "http", "80").when(scheme == "https", "443").otherwise("")
    return F.concat(scheme, F.lit("://"), F.lower(part(url, "HOST")), F.lit(":"), F.when(port != "", port).otherwise(default))


def same_origin(a: Name, b: Name) -> Column:
    return F.coalesce(origin(a) == origin(b), F.lit(False))


def title_from_url(url: Name) -> Column:
    """The last part of the path that is not empty, else the URL."""
    parts = F.filter(F.split(part(url, "PATH"), "/"), lambda x: x != "")
    return F.coalesce(F.get(parts, F.size(parts) - 1), _c(url))


def path_length(url: Name) -> Column:
    """Bytes of the path; an empty one counts as ``/``."""
    return F.greatest(F.lit(1), F.coalesce(F.octet_length(part(url, "PATH")), F.lit(0)))


_KEPT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~!$&'()*+,;=:@/%[]|^\\?#")


def _escaped(text: str, never: str) -> str:
    return "".join(c if c in _KEPT and c not in never else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in text)


def normalised(url: str) -> str | None:
    """An absolute URL in one spelling: scheme and host lower-cased, no default port, dot segments resolved, other signs escaped."""
    try:
        p = urlsplit(url.strip())
        host, port = p.hostname, p.port
    except ValueError:
        return None
    if not p.scheme:
        return None
    if p.scheme not in PORTS:
        return p.scheme + url.strip()[len(p.scheme) :]
    if not host or any(c.isspace() for c in host):
        return None
    try:
        host = host if host.isascii() else host.encode("idna").decode()
    except UnicodeError:
        return None
    user = f"{p.netloc.rpartition('@')[0]}@" if "@" in p.netloc else ""
    path = p.path.replace("\\", "/") or "/"
    if "/." in path:
        slash = path.endswith(("/", "/.", "/.."))
        path = posixpath.normpath(path).replace("//", "/", 1 if path.startswith("//") else 0) + "/" * slash
        path = "/" if path in ("//", "/") else path
    host = f"[{host}]" if ":" in host else host
    return (
        f"{p.scheme}://{user}{host}{f':{port}' if port and str(port) != PORTS[p.scheme] else ''}{_escaped(path, '?#')}"
        + (f"?{_escaped(p.query, chr(35) + chr(39))}" if p.query or "?" in url.split("#")[0] else "")
        + (f"#{_escaped(p.fragment, '')}" if p.fragment or "#" in url else "")
    )


def resolved(base: str | None, href: str | None) -> str | None:
    """href as seen from base, in one spelling; null if it does not make a URL."""
    if base is None or href is None:
        return None
    try:
        return normalised(urljoin(base.strip(), href.strip()))
    except ValueError:
        return None


@pandas_column("string")
def _resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([resolved(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


@pandas_column("string")
def _resolve_http(base: pd.Series, href: pd.Series) -> pd.Series:
    own = [resolved(b, h) for b, h in zip(base, href, strict=True)]
    return pd.Series([u if u is not None and u.startswith(("http://", "https://")) else None for u in own], dtype=object)


def resolve(base: Name, href: Name) -> Column:
    """A page's link made absolute; null for ones to be skipped."""
    base, href = _c(base), _c(href)
    return F.when(~skipped_in_page(href), _resolve(base, href))


def resolve_absolute(base: Name, href: Name) -> Column:
    """A crawl's link made absolute: trimmed first, http and https only."""
    base, href = _c(base), F.trim(_c(href))
    return F.when(~skipped_in_crawl(href), _resolve_http(base, href))
