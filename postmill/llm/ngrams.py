"""Folded spellings and edit distance."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters that Unicode doesn't decompose, as they are typed without accents.
LETTERS = str.maketrans({"ß": "ss", "ø": "o", "đ": "d", "ł": "l", "æ": "ae", "œ": "oe"})
_OTHER = re.compile(r"[^\w]+|_+")


@lru_cache(maxsize=100_000)
def folded(text: str) -> str:
    """Lower case, no accents, every run of other characters one space."""
    text = unicodedata.normalize("NFKD", text.lower().translate(LETTERS))
    return _OTHER.sub(" ", "".join(c for c in text if not unicodedata.combining(c))).strip()


def edits(a: str, b: str, most: int) -> int:
    """Edits (insertion, deletion, substitution, swap of neighbours) from a to b; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            new.append(best)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)
