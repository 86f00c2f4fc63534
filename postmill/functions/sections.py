"""Texts by section, as column expressions: headings are marked by one substitution, then arrays of parts are taken."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPEN, _CLOSE = "\x01", "\x02"


@dataclass(frozen=True)
class Rules:
    """Which sections to leave out, and what counts as a heading. Patterns are searched for without regard to case.

    unwanted: in a heading; unless: in a paragraph, which then stays; short: a result of fewer
    characters, of a text of more than three times as many, is given up for the whole text. longest:
    characters of a heading with marks; most_words: words of one without.
    """

    unwanted: str
    unless: str = r"(?!)"
    short: int = 100
    longest: int = 60
    most_words: int = 6


def _headings(longest: int = 60, most_words: int = 6) -> str:
    """A pattern of heading lines, its title in one of three groups: bold, after number signs, or bare words with capital initials but for one."""
    end = r"(?:[ \t]+|(?=:?[ \t]*$))"
    big, small = rf"[^\p{{Ll}}\s]\S*?{end}", rf"\p{{Ll}}\S*?{end}"
    bare = rf"(?![-*•●]|\d+[.)]\s)(?=[^\n]*\p{{L}})(?![^\n]*[.,;][ \t]*$)(?!\p{{Ll}}\S*[ \t]*$)(?=\S+(?:[ \t]+\S+){{0,{most_words - 1}}}[ \t]*$)(?:{big})*(?:{small})?(?:{big})*"
    return rf"(?m)^[ \t]*(?:\*\*([^*\n]{{2,{longest}}}?)\*\*:?|#{{1,6}}[ \t]+([^\n]{{2,{longest}}}?)|({bare}):?)[ \t]*$"


def heading(line: Column, rules: Rules = Rules("")) -> Column:
    """The title of a line that is a heading, else NULL."""
    p = _headings(rules.longest, rules.most_words)
    return F.when(line.rlike(p), _title(F.regexp_replace(line, p, "$1$2$3")))


def _title(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ *]+|[ *:]+$", "")


def _parts(c: Column, rules: Rules) -> Column:
    """The text cut before each heading: first what has none, then 'title, mark, body'. HTML headings count."""
    plain = F.regexp_replace(c, r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", "\n\n## $1\n")
    return F.split(F.regexp_replace(plain, _headings(rules.longest, rules.most_words), f"{_OPEN}$1$2$3{_CLOSE}"), _OPEN)


def _paragraphs(body: Column) -> Column:
    return F.filter(F.transform(F.split(body, r"\n[ \t]*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def _split(part: Column) -> tuple[Column, Column]:
    return _title(F.substring_index(part, _CLOSE, 1)), _paragraphs(F.substring_index(part, _CLOSE, -1))


def sections_dropped(c: Column, rules: Rules) -> Column:
    """A text without its unwanted sections: of each go the first paragraph and the lists; later prose, and paragraphs that unless is found in, stay.

    A text without headings, or of which too little would be left, stays as it is; NULL stays NULL.
    """
    parts = _parts(c, rules)

    def kept(part: Column) -> Column:
        title, body = _split(part)
        rest = F.filter(body, lambda p, i: ((i > 0) & ~p.rlike(r"^(?:[-*•●]|\d+[.)]\s)")) | p.rlike(f"(?i){rules.unless}"))
        return F.when(title.rlike(f"(?i){rules.unwanted}"), rest).when(F.size(body) > 0, F.concat(F.array(title), body)).otherwise(body)

    lead = _paragraphs(F.get(parts, F.lit(0)))
    sections = F.flatten(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), kept))
    result = F.array_join(F.concat(lead, sections), "\n\n")
    whole = (F.size(parts) < 2) | ((F.length(result) < rules.short) & (F.length(c) > 3 * rules.short))
    return F.when(whole, c).otherwise(result)


def sections_kept(c: Column, wanted: str) -> Column:
    """The paragraphs of sections with a wanted heading; NULL where there is none."""
    parts = _parts(c, Rules(wanted))

    def kept(part: Column) -> Column:
        title, body = _split(part)
        return F.when(title.rlike(f"(?i){wanted}"), body).otherwise(F.slice(body, 1, 0))

    found = F.flatten(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), kept))
    return F.nullif(F.array_join(found, "\n\n"), F.lit(""))
