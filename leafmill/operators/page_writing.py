"""What a node of a rewritten page opens and closes with, as a draft of Markdown: placeholders stand for white space that the clean-up must leave alone."""

from __future__ import annotations

import re

# Placeholders that survive the clean-up of white space.
BREAK, NEWLINE, INDENT, QUOTE, UNQUOTE = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005"
SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
STARS = re.compile(r"([*_])")
TAG = re.compile(r"<(?=[A-Za-z/!?])")
LISTS = re.compile(r"/(?=(?:ul|ol)/)")
MATH = re.compile(r"(?:^|[ \t\n\x0b\f\r])(math|display)(?=[ \t\n\x0b\f\r]|$)")
# Elements that stand alone, and those that write the same before and after whatever they hold.
BLOCKS = (
    "p", "div", "section", "article", "main", "body", "figure", "figcaption", "header", "footer", "aside", "dl", "table", "tr", "html", "details", "summary", "td", "th"
)
FIRST = {f"h{n}": ("\n\n" + "#" * n + " ", "\n\n") for n in range(1, 7)} | {
    "br": (BREAK, ""), "hr": ("\n\n---\n\n", ""), "pre": (f"\n\n```{NEWLINE}", f"{NEWLINE}```\n\n"),
}
PAIRS = dict.fromkeys(BLOCKS, ("\n\n", "\n\n")) | {
    "b": ("**", "**"), "strong": ("**", "**"), "em": ("*", "*"), "i": ("*", "*"), "code": ("`", "`"), "kbd": ("`", "`"), "samp": ("`", "`"),
    "sup": ("<sup>", "</sup>"), "sub": ("<sub>", "</sub>"), "img": ("![](", ")"), "blockquote": (f"\n\n{QUOTE}", f"{UNQUOTE}\n\n"),
}


def ready(text: str) -> str:
    return text.replace("\n", NEWLINE).replace(" ", INDENT)


def marks(tag: str, path: str, text: str | None, item: int, href: str | None, classes: str | None) -> tuple[str, str]:
    """What a node writes when it opens and when it closes."""
    if tag == "#text":
        return ready(text) if "/pre/" in path else TAG.sub(r"\\<", STARS.sub(r"\\\1", SPACE.sub(" ", text))), ""
    if tag == "#inline":
        return ready(text), ""
    if tag == "#unit":
        return f"\n\n{ready(text)}\n\n", ""
    if tag in FIRST:
        return FIRST[tag]
    if "/pre/" in path or tag == "p" and path.endswith("/li/"):
        return "", ""
    if tag == "a" and href is not None:
        return "[", f"]({href.replace('(', '%28').replace(')', '%29')})"
    if tag == "span" and classes and "math" in (found := MATH.findall(classes)):
        dollars = "$$" if "display" in found else "$"
        return dollars, dollars
    if tag == "li":
        depth = len(LISTS.findall(path))
        return "\n" + INDENT * (2 * max(depth - 1, 0)) + (f"{item}. " if path.endswith("/ol/") else "- "), ""
    if tag in ("ul", "ol"):
        return ("", "") if LISTS.search(path) else ("\n\n", "\n\n")
    return PAIRS.get(tag, ("", ""))
