"""Free-entered locations mapped to a canonical list of places.

Distinct values are split into the places they list; what qualifies a place (regions, countries,
postal codes, work modes) is set apart; the rest is looked up in an inverted index of weighted
character n-grams. A candidate is accepted above a cosine and with a margin before the next name, if edits confirm it;
same-named places are told apart by the value's own qualifiers.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.cosine import character_grams, cosine_pairs, counted, weighting
from postmill.llm.ngrams import edits, folded
from postmill.session import groups_for, written

#: Most distinct values whose mapping is broadcast back to the rows.
BROADCAST_VALUES = 200_000
#: Least weighted cosine of a name, and least lead over another one; a name typed as listed needs no lead.
COSINE, MARGIN, EXACT = 0.6, 0.01, 1.0
#: Most edits that an accepted name may need: an exact check, which alone accepts nothing.
EDITS = 3
#: Power of the logarithmic weight of rarity: low, as a typing error makes rare n-grams.
POWER = 0.1

# Words around a place that say nothing about which one it is.
NOISE = {"remote", "office", "hq", "headquarters", "hybrid", "onsite", "metro", "area", "region", "building", "bldg", "floor", "suite", "only", "based", "in", "near", "site", "on", "campus", "downtown", "usa", "us", "united", "states", "america"}
# First words of place names as they are abbreviated.
SHORT = {"st": "saint", "ste": "saint", "ft": "fort", "mt": "mount", "mnt": "mount", "pt": "port", "n": "north", "s": "south", "e": "east", "w": "west", "upr": "upper", "up": "upper", "nr": "north", "no": "north", "so": "south"}
# Countries by the names that are typed for them beside those of the list.
COUNTRY_WORDS = {"usa": "US", "us": "US", "united states": "US", "america": "US", "uk": "GB", "great britain": "GB", "england": "GB", "deutschland": "DE", "brasil": "BR"}
_SPLIT = re.compile(r"\s*[;|/\n•]\s*|(?<!,)\s+(?:or|and|&|\+|und|oder|ou|et|y|o)\s+")
_UMLAUT = re.compile(r"(?<=[bcdfghjklmnprstvwz])(ue|oe|ae)")


def _key(text: str) -> str:
    """The spelling that is compared: folded, umlauts typed as two letters as one, without spaces."""
    return _UMLAUT.sub(lambda m: m[0][0], folded(text)).replace(" ", "")


def _spelled(words: list[str]) -> list[str]:
    return [SHORT.get(words[0], words[0]), *words[1:]] if len(words) > 1 else words


def _names(rows: pd.DataFrame) -> Iterator[tuple[str, int]]:
    """(name as compared, place_id) of places by city and also_called."""
    for place, city, also in zip(rows["place_id"], rows["city"], rows["also_called"]):
        names = {_key(" ".join(_spelled(folded(n).split()))) for n in (city, also) if isinstance(n, str) and _key(n)}
        yield from ((n, place) for n in sorted(names))


class Qualifiers:
    """What tells places apart: codes and names of regions and countries. Its size is that of the sets of them."""

    def __init__(self, rows: list[tuple]):
        self.words: dict[str, set[tuple]] = defaultdict(set)
        for region, region_name, iso, country in rows:
            if iso:
                self.words[folded(iso)].add(("c", iso))
            if country:
                self.words[folded(country)].add(("c", iso))
            if region:
                self.words[folded(region)].add(("r", region, iso))
            if region_name:
                self.words[folded(region_name)].add(("r", region, iso))
        for word, iso in COUNTRY_WORDS.items():
            self.words[word].add(("c", iso))

    def parse(self, segment: str) -> tuple[str, list[set[tuple]]]:
        """The name that is left of a segment, and its qualifiers, each a set of what it can mean."""
        words, found, left = folded(segment).split(), [], []
        words = [w for w in words if not (w.isdigit() or re.fullmatch(r"\d{5,}\w*", w))]
        i = 0
        while i < len(words):
            for n in (3, 2, 1):
                if (w := " ".join(words[i : i + n])) in self.words and len(words[i : i + n]) == n:
                    found.append(self.words[w])
                    i += n
                    break
            else:
                left.append(words[i])
                i += 1
        while left and left[0] in NOISE:
            left.pop(0)
        while left and left[-1] in NOISE:
            left.pop()
        return _key(" ".join(_spelled(left))) if left else "", found


def _fits(place: tuple, qualifiers: list[set[tuple]]) -> bool:
    _, region, iso = place
    return all(any((m[0] == "c" and m[1] == iso) or (m[0] == "r" and m[1] == region and m[2] == iso) for m in q) for q in qualifiers)


def _segments(value: str, q: Qualifiers) -> list[tuple[str, list[set[tuple]]]]:
    out: list[tuple[str, list]] = []
    for part in _SPLIT.split(value):
        name, found = q.parse(part)
        if name:
            out.append((name, found))
        elif found and out and not out[-1][1]:  # what qualifies the place before it
            out[-1] = (out[-1][0], found)
    return out


@lru_cache(maxsize=100_000)
def _confirmed(text: str, name: str) -> bool:
    most = 1 if len(text) < 6 else 2 if len(text) < 9 else EDITS
    return edits(text, name, most) <= most


def _decide(segments: list[list], near: dict[int, list[tuple]]) -> list[int]:
    """The places that a value lists, 0 for none or for one of several of the same name.

    segments: (name, qualifiers); near: of each segment, by number, (cosine, name, place, region, country).
    """
    places, unclear = [], False
    for number, (text, qualifiers) in enumerate(segments):
        by_name: dict[str, tuple[float, set[int]]] = {}
        for score, name, *place in near.get(number, ()):
            if _fits(tuple(place), qualifiers) and _confirmed(text, name):
                by_name.setdefault(name, (score, set()))[1].add(place[0])
        fitting = sorted(((score, name, ids) for name, (score, ids) in by_name.items()), key=lambda x: (-x[0], x[1]))
        if not fitting or (len(fitting) > 1 and fitting[0][0] < EXACT and fitting[0][0] - fitting[1][0] < MARGIN):
            continue
        if len(fitting[0][2]) > 1:
            unclear = True
        else:
            places += fitting[0][2]
    return sorted(set(places)) + ([0] if unclear or not places else [])


def map_places(values: DataFrame, places: DataFrame, value: str = "location") -> DataFrame:
    """(value, place_ids) for every distinct value that is not NULL or blank; [0] where none is found.

    places has place_id, city, region_code, region_name, country_iso, country_name, also_called; NULLs
    in any of them match nothing. A name is accepted if its weighted cosine is at least COSINE and
    exceeds that of every other name so near that fits the value's region and country by MARGIN; weights come
    from all names of the list; EDITS confirms. Values and names meet in a join on n-grams, so that neither list has
    to fit anywhere as a whole. Very long values are searched whole. An empty list of places gives [0]
    for every value, an empty table of values an empty result.
    """
    spark = values.sparkSession
    distinct = values.select(F.col(value).cast("string").alias("value")).where(F.col("value").isNotNull() & (F.trim("value") != "")).distinct()
    # few bytes but much work a value: keep all cores busy
    distinct = distinct.repartition(groups_for(0, spark))
    known = places.where(F.col("place_id").isNotNull())
    # regions and countries are as many as there are of them on earth, whatever the list's length
    q = Qualifiers([tuple(r) for r in known.select("region_code", "region_name", "country_iso", "country_name").distinct().collect()])
    qualifiers = spark.sparkContext.broadcast(q)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [_segments(v, qualifiers.value) for v in b["value"]]
            names = [[n for n, _ in f] for f in found]
            yield pd.DataFrame({"value": b["value"], "names": names, "qualifiers": [json.dumps([[n, [sorted(q) for q in x]] for n, x in f]) for f in found]})

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(list(_names(b)), columns=["text", "place_id"])

    parsed = written(distinct.mapInPandas(parse, "value string, names array<string>, qualifiers string"), "values")
    own = written(known.select("place_id", "city", "also_called").mapInPandas(name, "text string, place_id bigint").distinct(), "places")
    listed = own.select("text").distinct().select(F.xxhash64("text").alias("id"), "text")
    typed = parsed.select(F.explode("names").alias("text")).distinct().select(F.xxhash64("text").alias("id"), "text")
    # a name of the list itself is that name, and no other
    unlike = typed.join(listed, "id", "left_anti")
    same = typed.join(listed.select("id"), "id").select("id", F.col("id").alias("b"), F.lit(1.0).alias("sim"))
    vectors = written(counted(listed, character_grams, listed.count()), "vectors")
    near = same.unionAll(cosine_pairs(unlike, vectors, weighting(vectors, character_grams, POWER), COSINE).select(F.col("a").alias("id"), "b", "sim"))
    about = known.select("place_id", "region_code", "country_iso").distinct()
    about = own.join(about, "place_id").select(F.xxhash64("text").alias("b"), F.struct("text", "place_id", "region_code", "country_iso").alias("p"))
    candidates = near.join(about, "b").select("id", F.struct("sim", "p.*").alias("c"))
    segments = parsed.select("value", "qualifiers", F.posexplode_outer("names").alias("number", "text")).withColumn("id", F.xxhash64("text"))
    # of one value, as many as its names have candidates above the cosine
    gathered = segments.join(candidates, "id", "left").groupBy("value").agg(F.first("qualifiers").alias("qualifiers"), F.collect_list(F.when(F.col("c").isNotNull(), F.struct("number", "c.*"))).alias("near"))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for packed, found in zip(b["qualifiers"], b["near"]):
                near = defaultdict(list)
                for c in found:
                    near[c["number"]].append((c["sim"], c["text"], c["place_id"], c["region_code"], c["country_iso"]))
                out.append(_decide(json.loads(packed), near))
            yield pd.DataFrame({"value": b["value"], "place_ids": out})

    return gathered.mapInPandas(decide, "value string, place_ids array<bigint>")


def placed(rows: DataFrame, places: DataFrame, value: str = "location") -> DataFrame:
    """rows with place_ids (NULL where value is NULL or blank); every row stays, repeated or not."""
    mapped = written(map_places(rows, places, value), "places").withColumnRenamed("value", "_value")
    if mapped.count() <= BROADCAST_VALUES:
        mapped = F.broadcast(mapped)
    return rows.join(mapped, rows[value] == mapped["_value"], "left").drop("_value")
