"""URL columns. Regular expressions rather than ``parse_url``: an odd URL must keep its row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import col, non_empty, null_if_empty, title_case

# Language tags a site may put first in its paths.
LOCALES = (
    "en fr de es it pt nl ru ja zh ar ko pl tr sv da no fi cs el he hi id th vi uk ro hu ca fa"
).split()

SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?"
NETLOC = SCHEME + r"//([^/?#]*)"
PATH = SCHEME + r"(?://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"
LOCALE = "^(" + "|".join(LOCALES) + ")(-[^-]*)?$"


def netloc(url: Column | str) -> Column:
    return F.regexp_extract(col(url), NETLOC, 1)


def host(url: Column | str) -> Column:
    """Lower case, no ``www.``, no port."""
    return F.split_part(F.regexp_replace(F.lower(netloc(url)), r"^www\.", ""), F.lit(":"), F.lit(1))


def path(url: Column | str) -> Column:
    return F.regexp_extract(col(url), PATH, 1)


def query_string(url: Column | str) -> Column:
    return F.regexp_extract(col(url), QUERY, 1)


def segments(url: Column | str) -> Column:
    return non_empty(F.split(path(url), "/"))


def page_segments(url: Column | str) -> Column:
    """Path segments without one leading locale segment."""
    parts = segments(url)
    first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    return F.when(F.lower(first).rlike(LOCALE), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def unquote(c: Column | str) -> Column:
    """Percent-decoding that leaves ``+`` and broken escapes alone."""
    c = col(c)
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def canonical_key(url: Column | str) -> Column:
    return F.concat(host(url), F.lit("/"), F.array_join(page_segments(url), "/"))


def is_home(url: Column | str) -> Column:
    return F.size(page_segments(url)) == 0


def is_deep(url: Column | str) -> Column:
    return F.size(page_segments(url)) >= 2


def extension(segment: Column) -> Column:
    return F.lower(F.regexp_extract(unquote(segment), r"\.([^.]*)$", 1))


def without_fragment(url: Column | str) -> Column:
    return F.split_part(col(url), F.lit("#"), F.lit(1))


def absolute(base: Column | str, href: Column | str) -> Column:
    """``href`` resolved against ``base``: absolute, scheme-relative, root-relative, query, fragment or relative."""
    base, href = col(base), col(href)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    root = F.concat(scheme, F.lit("//"), netloc(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    way, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    resolved = F.concat(root, without_dots(F.when(href.startswith("/"), way).otherwise(F.concat(folder, way))), rest)
    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("#"), F.concat(without_fragment(base), href))
        .when(href.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), href))
        .otherwise(resolved)
    )


def without_dots(way: Column) -> Column:
    """A path from the root with its ``.`` and ``..`` segments resolved and empty ones dropped; none climbs above the root."""
    segments = F.split(way, "/")
    last = F.element_at(segments, -1)
    inner = F.filter(F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 2, F.lit(0))), lambda s: s != "")
    kept = F.aggregate(
        F.concat(inner, F.array(last)), F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done).otherwise(F.concat(done, F.array(s))),
    )
    return F.concat(F.lit("/"), F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))


def slug_title(url: Column | str) -> Column:
    """A readable title from the last path segment."""
    url = col(url)
    trimmed = F.regexp_replace(path(url), "/+$", "")
    slug = F.regexp_replace(unquote(F.regexp_extract(trimmed, r"([^/]*)$", 1)), r"(?i)\.(html?|php|aspx?|jsp)$", "")
    slug = F.coalesce(null_if_empty(F.regexp_replace(slug, r"([-_]\d{4,})+$", "")), slug)
    title = title_case(F.trim(F.translate(slug, "-_", "  ")))
    return F.when(trimmed == "", url).otherwise(F.coalesce(null_if_empty(title), url))


def stem_title(url: Column | str) -> Column:
    """A readable title from an audio file name."""
    url = col(url)
    name = F.regexp_extract(path(url), r"([^/]*)/*$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.coalesce(null_if_empty(title_case(F.trim(F.translate(stem, "-_", "  ")))), url)
