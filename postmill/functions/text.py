"""Text functions, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The entities that postings hold.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def words_pattern(words: list[str]) -> str:
    """A pattern that matches any of the words as a whole, the longest first."""
    return r"(?i)\b(?:" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + r")\b"


def html_text(c: Column) -> Column:
    """HTML as text: breaks and ends of blocks are line ends, other tags go, entities are resolved, lines trimmed, blank ones dropped."""
    t = F.regexp_replace(c, r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr)>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for entity, char in ENTITIES.items():
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def unfenced(c: Column) -> Column:
    """What stands inside a Markdown code fence, or all of the text."""
    return F.trim(F.regexp_replace(F.trim(c), r"(?s)^```[A-Za-z]*\s*\n?(.*?)\n?```$", "$1"))


def cleaned(c: Column) -> Column:
    """Text taken from a document: words split at line ends joined, runs of blanks and of empty lines reduced, trimmed."""
    t = F.regexp_replace(c, r"(\w)-\n(\w)", "$1$2")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def contains_text(needle: str, *columns: str) -> Column:
    """Whether the columns, joined by blanks, contain needle, whatever its case."""
    return F.contains(F.lower(F.concat_ws(" ", *[F.col(c) for c in columns])), F.lit(needle.lower()))


def mentions(c: Column, vocabulary: list[str]) -> Column:
    """The entries of a vocabulary that a text mentions as whole words, in the vocabulary's order.

    One pass finds all entries; only one that is part of another is searched for by itself.
    """
    low, entries = F.lower(c), {w.lower(): w for w in vocabulary}
    whole = lambda p: r"(?<![\p{L}\p{N}+#.])(" + p + r")(?![\p{L}\p{N}+#])"
    apart = [w for w in entries if any(o != w and w in o for o in entries)]
    rest = sorted((w for w in entries if w not in apart), key=lambda w: (-len(w), w))
    hits = F.regexp_extract_all(low, F.lit(whole("|".join(map(re.escape, rest)) or r"(?!)")), 1)
    if apart:
        hits = F.concat(hits, F.array_compact(F.array(*[F.when(low.rlike(whole(re.escape(w))), w) for w in apart])))
    names = F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])
    return F.transform(F.array_intersect(F.array(*[F.lit(w) for w in entries]), hits), lambda x: F.element_at(names, x))


def in_order(wanted: Column, among: Column, present: bool = True) -> Column:
    """The elements of wanted that occur in among, or don't, in wanted's order."""
    return F.filter(wanted, lambda x: F.array_contains(among, x) if present else ~F.array_contains(among, x))


def path_segment(raw: Column, field: str, n: int) -> Column:
    """The n-th segment of a path in a JSON text, with blanks for dashes; NULL for broken JSON or too short a path."""
    parts = F.filter(F.split(F.get_json_object(raw, f"$.{field}"), "/"), lambda x: x != "")
    return F.replace(F.get(parts, F.lit(n - 1)), F.lit("-"), F.lit(" "))


def present(c: Column) -> Column:
    """Text that says something: trimmed, NULL where it is blank or 'nan'."""
    t = F.trim(c.cast("string"))
    return F.when((t != "") & (F.lower(t) != "nan"), t)


def json_list(c: Column) -> Column:
    """A JSON array of strings as an array; NULL where it is no such array."""
    return F.from_json(c, "array<string>")


def normalised(c: Column) -> Column:
    """Text for looking for phrases: no tags or marks of emphasis, straight quotes, common abbreviations without stops, single blanks."""
    t = F.replace(F.regexp_replace(c, "<[^>]*>", " "), F.lit("\u2019"), F.lit("'"))
    t = F.regexp_replace(t, "[*_#`]", "")
    t = F.regexp_replace(t, r"(?i)\b(u)\.(s)\.(a\.)?|\b(e)\.(g)\.|\b(i)\.(e)\.|\b(et)(c)\.", "$1$2$4$5$6$7$8$9")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def sentence_with(c: Column, pattern: str) -> Column:
    """The first sentence of a text, tags aside, that a pattern occurs in."""
    flat = F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " ")
    return F.get(F.filter(F.split(flat, "[.;?!] "), lambda x: x.rlike(pattern)), F.lit(0))


def any_pattern(patterns: list[str]) -> str:
    """A pattern that matches where any of several does, whatever the case."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)
