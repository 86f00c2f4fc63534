"""Keys and their normalisation, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words at the end of a company's name that tell nothing about which company it is.
LEGAL_FORMS = ("ag", "bv", "co", "com", "company", "corp", "corporation", "gmbh", "inc", "limited", "llc", "ltd", "nv", "plc", "platforms", "pty", "sa", "technologies", "technology")
# Spellings of false.
FALSE_WORDS = ("", "false", "0", "no", "f", "n", "none", "null")
#: Namespace of the version-5 UUIDs made of URLs (RFC 9562).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def id_text(c: Column) -> Column:
    """An id as text: blank and NaN are NULL, an integral number has no decimal places."""
    t = F.trim(c.cast("string"))
    return F.when((t == "") | (F.lower(t) == "nan"), None).when(t.rlike(r"^-?\d+\.0+$"), F.regexp_replace(t, r"\.0+$", "")).otherwise(t)


def host(url: Column) -> Column:
    """The lower-cased host of a URL, 'no-host' where there is none."""
    h = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(h == "", "no-host").otherwise(h)


def global_key(source: Column, id_: Column, url: Column, per_employer: Column) -> Column:
    """source[:host]:id, the host only where a source numbers per employer; without an id, 'url-' and the URL's SHA-1 from 16 digits on the left."""
    own = F.coalesce(id_text(id_), F.concat(F.lit("url-"), F.substring(F.sha1(F.coalesce(url, F.lit(""))), 1, 16)))
    return F.when(F.coalesce(per_employer, F.lit(False)), F.concat_ws(":", source, host(url), own)).otherwise(F.concat_ws(":", source, own))


def id_of(key: Column, per_employer: Column) -> Column:
    """The id within a global key: what follows its first, or for a source that numbers per employer its second colon."""
    return F.when(F.coalesce(per_employer, F.lit(False)), F.regexp_extract(key, r"^[^:]*:[^:]*:(.*)$", 1)).otherwise(F.regexp_extract(key, r"^[^:]*:(.*)$", 1))


def company_key(c: Column) -> Column:
    """Letters and digits of a company's name without the legal forms at its end; a web host counts by its first label."""
    t = F.lower(F.trim(c))
    t = F.when(t.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"), F.regexp_extract(t, r"^(?:www\.|careers\.|jobs\.)?([a-z0-9-]+)", 1)).otherwise(t)
    spaced = F.trim(F.regexp_replace(F.regexp_replace(t, r"[.']", ""), r"[^\p{L}\p{N}]+", " "))
    bare = F.regexp_replace(spaced, r"^(.+?)(?: (?:" + "|".join(LEGAL_FORMS) + r"))+$", "$1")
    return F.regexp_replace(bare, " ", "")


def _spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def entry_forms(c: Column) -> Column:
    """The forms under which an entry of a list of companies is looked up: its words apart and run together."""
    return F.array_distinct(F.filter(F.array(_spaced(c), F.replace(_spaced(c), F.lit(" "), F.lit(""))), lambda x: x != ""))


def candidates(c: Column) -> Column:
    """The forms of a company's name that are looked for in such a list: those of an entry, its key, a host's first label."""
    label = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z0-9-]+)\.[a-z0-9.-]+$", 1)
    return F.array_distinct(F.filter(F.concat(entry_forms(c), F.array(company_key(c), label)), lambda x: x != ""))


def company_fold(c: Column) -> Column:
    """The milder key of grouped views: lower case, other characters as one space; '?' where nothing is left."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " "))
    return F.when(t == "", "?").otherwise(t)


def truth(c: Column) -> Column:
    """A boolean of mixed spellings; NULL and the spellings of false are false."""
    return F.coalesce(~F.lower(F.trim(c.cast("string"))).isin(*FALSE_WORDS), F.lit(False))


def best_link(apply_url: Column, url: Column, walled: str) -> Column:
    """The link to show: the application link, or the listing where the former matches walled (a login page)."""
    a, u = F.nullif(F.trim(apply_url), F.lit("")), F.nullif(F.trim(url), F.lit(""))
    return F.when(a.rlike(walled), F.coalesce(u, a)).otherwise(F.coalesce(a, u))


def name_uuid(prefix: str, c: Column) -> Column:
    """Version-5 UUID, in the URL namespace, of prefix and a key."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(F.concat(F.lit(prefix), c), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))
