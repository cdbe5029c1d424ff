"""Content language: tags, a stop-word vote, the words a book adds itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import col, let, null_if_empty, strip

FALLBACK = "en"
MIN_HITS = 20
VOTE_CHARS = 20000
# Fixed value: the language attribute of a page's root element.
HTML_LANG = r"""(?i)<html\b[^>]*?\b(?:xml:)?lang\s*=\s*["']?([A-Za-z]{2,3}(?:[-_][A-Za-z0-9]+)*)"""

# Stop words per language, in the order in which ties are decided.
STOP_WORDS = {
    "en": "the and of to is in that it for you with this was are be on not have but they",
    "fr": "le la les et des est une que qui dans pour pas sur vous avec il ce du au sont",
    "es": "el la los las y de que en es un una por con para no se del lo como más",
    "de": "der die das und ist nicht mit sich des auf für ein eine dem den zu von auch",
    "it": "il la che di e è per non un una sono con del della gli le si come più",
    "pt": "o a os as e de que em é um uma para com não do da dos se por mais",
    "nl": "de het een en van is dat niet op te zijn met voor die er maar ook als",
}
# The words a book adds itself, per language.
CHROME = {
    "en": dict(sources="Sources", preface="Preface", source="Source", author="Author", date="Date", speaker="Speaker",
               toc="Table of contents", start="Start of content"),
    "fr": dict(sources="Sources", preface="Préface", source="Source", author="Auteur", date="Date",
               speaker="Intervenant", toc="Table des matières", start="Début du contenu"),
    "es": dict(sources="Fuentes", preface="Prefacio", source="Fuente", author="Autor", date="Fecha",
               speaker="Interlocutor", toc="Índice", start="Inicio del contenido"),
    "de": dict(sources="Quellen", preface="Vorwort", source="Quelle", author="Autor", date="Datum", speaker="Sprecher",
               toc="Inhaltsverzeichnis", start="Beginn des Inhalts"),
    "it": dict(sources="Fonti", preface="Prefazione", source="Fonte", author="Autore", date="Data",
               speaker="Interlocutore", toc="Indice", start="Inizio del contenuto"),
    "pt": dict(sources="Fontes", preface="Prefácio", source="Fonte", author="Autor", date="Data", speaker="Orador",
               toc="Índice", start="Início do conteúdo"),
}


def normalize_language(tag: Column | str) -> Column:
    """A language tag's primary part (two or three letters before the first ``-`` or ``_``), null when there is no usable tag."""
    parts = F.split(F.lower(strip(col(tag))), "[-_]")
    primary = F.get(parts, F.lit(0))
    return F.when(F.forall(parts, lambda p: p.rlike("^[a-z0-9]+$")) & primary.rlike("^[a-z]{2,3}$"), primary)


def html_language(html: Column | str) -> Column:
    """The language a page declares on its html element, near its top."""
    return normalize_language(F.regexp_extract(F.left(col(html), F.lit(5000)), HTML_LANG, 1))


def accepted_language(header: Column | str) -> Column:
    """The first language of an Accept-Language header."""
    first = F.split_part(F.split_part(col(header), F.lit(","), F.lit(1)), F.lit(";"), F.lit(1))
    base = F.lower(F.trim(F.split_part(F.trim(first), F.lit("-"), F.lit(1))))
    return F.when(base.rlike(r"^\p{L}+$"), base)


def detect_language(text: Column | str) -> Column:
    """The language with most stop words in the text's opening, null below 20 of them."""
    found = F.regexp_extract_all(F.lower(F.left(col(text), F.lit(VOTE_CHARS))), F.lit(r"(\p{L}+)"), 1)

    def vote(ws: Column) -> Column:
        def hits(stop: str) -> Column:
            return F.size(F.filter(ws, lambda w: w.isin(*stop.split())))

        votes = [
            F.struct(
                hits(stop).alias("hits"),
                F.lit(-place).alias("place"), F.lit(language).alias("language"),
            )
            for place, (language, stop) in enumerate(STOP_WORDS.items())
        ]
        return F.array_max(F.array(*votes))

    return let(let(found, vote), lambda best: F.when(best["hits"] >= MIN_HITS, best["language"]))


def dominant_language(chapters: DataFrame, size: Column | None = None) -> DataFrame:
    """Per book the language that carries the most text; the first seen wins a tie, English if none is known."""
    size = F.length("content_md") if size is None else size
    weights = chapters.groupBy("book_id", null_if_empty("language").alias("language")).agg(
        F.sum(size).alias("_size"), F.min("chapter_no").alias("_first")
    )
    known = F.when(F.col("language").isNotNull(), F.struct("_size", (-F.col("_first")).alias("first")))
    best = weights.groupBy("book_id").agg(F.max_by("language", known).alias("language"))
    return best.select("book_id", F.coalesce("language", F.lit(FALLBACK)).alias("language"))


def chrome(language: Column | str, label: str) -> Column:
    """One of the book's own words; English when the language has none."""
    known = F.create_map(*[F.lit(x) for pair in ((k, v[label]) for k, v in CHROME.items()) for x in pair])
    return F.coalesce(known[col(language)], F.lit(CHROME[FALLBACK][label]))
