"""DuckDB expressions used by several oracles."""

from leafmill.functions import urls
from leafmill.operators import links

SPACE = r"[\s\p{Z}]+"


def lit(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def netloc(u: str) -> str:
    return f"regexp_extract({u}, '{urls.NETLOC}', 1)"


def host(u: str) -> str:
    return f"split_part(regexp_replace(lower({netloc(u)}), '^www[.]', ''), ':', 1)"


def path(u: str) -> str:
    return f"regexp_extract({u}, '{urls.PATH}', 1)"


def segments(u: str) -> str:
    return f"list_filter(string_split({path(u)}, '/'), lambda s: s <> '')"


def page_segments(u: str) -> str:
    s = segments(u)
    return f"CASE WHEN len({s}) > 0 AND regexp_matches(lower(({s})[1]), '{urls.LOCALE}') THEN ({s})[2:] ELSE {s} END"


def canonical(u: str) -> str:
    return f"concat({host(u)}, '/', array_to_string({page_segments(u)}, '/'))"


def home(u: str) -> str:
    return f"len({page_segments(u)}) = 0"


def article_like(u: str) -> str:
    h = host(u)
    s = f"list_transform({segments(u)}, lambda s: lower(s))"
    return f"""NOT (regexp_matches({h}, '{links.HOSTS_PATTERN}') OR regexp_matches({h}, '{links.JOBS_PATTERN}')
        OR list_has_any({s}, {lit(links.NON_ARTICLE_SEGMENTS)})
        OR list_contains({lit(links.FILE_EXTENSIONS)}, CASE WHEN len({s}) = 0 THEN '' ELSE lower(regexp_extract(url_decode(({s})[-1]), '[.]([^.]*)$', 1)) END)
        OR regexp_matches(regexp_extract({u}, '{urls.QUERY}', 1), '{links.LISTING_PATTERN}'))"""


def title_case(s: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({s}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda x: upper(x[1]) || lower(x[2:])), '')"
    )


def words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{SPACE}'), lambda x: x <> '')"


def norm_words(t: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda x: x <> '')"


def collapse(t: str) -> str:
    return f"trim(regexp_replace({t}, '{SPACE}', ' ', 'g'))"


def fold_title(t: str) -> str:
    return collapse(f"regexp_replace(replace(lower({t}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]', ' ', 'g')")


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def blank(t: str) -> str:
    return f"NOT regexp_matches({t}, '[^\\s\\p{{Z}}]')"


def escape_tags(t: str) -> str:
    return f"regexp_replace({t}, '<([A-Za-z/!?])', '\\\\<\\1', 'g')"
