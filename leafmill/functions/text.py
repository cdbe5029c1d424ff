"""Text columns shared by the operators. ``\\p{L}\\p{N}_`` is what other engines call a word character."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}]+"
NOT_WORD = r"[^\p{L}\p{N}_]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(col(c), SPACE, " "))


def blank(c: Column | str) -> Column:
    return ~col(c).rlike(r"[^\s\p{Z}]")


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def rstrip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[\s\p{Z}]+$", "")


def non_empty(items: Column) -> Column:
    return F.filter(items, lambda x: x != "")


def words(c: Column | str) -> Column:
    """White-space separated words."""
    return non_empty(F.split(col(c), SPACE))


def word_count(c: Column | str) -> Column:
    return F.coalesce(F.size(words(c)), F.lit(0))


def norm_words(c: Column | str) -> Column:
    """Lower-case words without punctuation: what a fidelity check compares."""
    return non_empty(F.split(F.regexp_replace(F.lower(col(c)), NOT_WORD, " "), " "))


def null_if_empty(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def title_case(c: Column) -> Column:
    """Each run of letters capitalised."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(
        F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substr(x, F.lit(2))))), ""
    )


def fold_title(c: Column | str) -> Column:
    """A title reduced to its words: case, spacing and punctuation ignored."""
    folded = F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss"))
    return collapse(F.regexp_replace(folded, r"[^\p{L}\p{N}_\s\p{Z}]", " "))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once and used several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def escape_tags(c: Column | str) -> Column:
    """What looks like a tag in a text is shown, not read as one."""
    return F.regexp_replace(col(c), "<(?=[A-Za-z/!?])", r"\\<")
