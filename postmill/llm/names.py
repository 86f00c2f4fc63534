"""Variant spellings of organisation names, linked.

A name is brought to a form: the letters of its family part and its trade ('Dental', 'Networks').
The trades are learned from the names themselves. Forms become weighted character n-gram vectors;
a sparse join finds each one's most similar forms of the same trade; average-linkage clustering,
done as rounds of reciprocal nearest neighbours, groups them. Forms without a trade (web hosts, bare
family names) then join the one group that they resemble.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.cosine import cosine_pairs, counted, weighting
from postmill.llm.ngrams import edits, folded
from postmill.session import drop_written, groups_for, written

#: Different families that a word must follow at the end of names to be a trade, whatever the number of names.
TRADE_FAMILIES = 5
#: Least cosine of a pair to be kept, of two groups (average linkage) to be merged, and of a form
#: without a trade to join a group; its lead over the next group.
KEEP, MERGE, JOIN, LEAD = 0.4, 0.42, 0.5, 0.05
#: Below this cosine a pair is kept only if edits confirm it: an exact check, which alone links nothing.
SURE = 0.5
#: Lengths of the n-grams; the longest tell names of the same syllables in another arrangement apart.
GRAMS = (2, 3, 4)
#: Smoothing of the weights, as a share of the forms: a misspelt, hence rare, n-gram counts little more than others.
SMOOTH = 0.02
#: What the parts of a name count: n-grams by length, its letters, and pairs with one letter between. Long
#: n-grams are rare and tell most; were letters to tell more, all names would meet in the join.
COUNT, LETTER, SKIP = {2: 0.5, 3: 1.0, 4: 1.0}, 0.5, 0.25

# Legal forms, as folded words.
LEGAL = {"inc", "llc", "ltd", "limited", "plc", "gmbh", "corp", "corporation", "co", "company", "pty", "ag", "sa", "bv", "nv", "srl", "spa", "oy", "ab", "as", "lp", "llp", "incorporated", "kg", "sas", "sarl", "pte"}
_HOST = re.compile(r"^(?:https?://)?(?:(?:www\d?|careers?|jobs?|apply|hire)\.)*([a-z0-9-]{3,})(?:\.[a-z0-9-]+)*\.[a-z]{2,}/?$", re.I)
_ASIDE = re.compile(r"\s*(?:\([^)]*\)|\[[^\]]*\]|\s[|–—-]\s.*$|\|.*$)")
_JOINERS = {"the", "and", "und", "et", "of", "y"}


def name_words(name: str) -> tuple[list[str], bool, bool]:
    """The words of a name without legal forms and asides; whether it is a web host; whether it was turned around ('Dental, X Y')."""
    text = name.strip()
    if m := _HOST.match(text):
        return [folded(m[1]).replace(" ", "")], True, False
    bare = _ASIDE.sub(" ", text).strip() or text
    parts = [p.split() for p in (folded(p.replace("'", "").replace("’", "").replace(".", "") if re.search(r"\b(\w\.){2,}", p) else p.replace("'", "").replace("’", "")) for p in bare.split(","))]
    parts = [[w for w in p if w not in _JOINERS] for p in parts]
    kept = []
    for p in parts:
        while p and p[-1] in LEGAL:
            p.pop()
        if p:
            kept.append(p)
    turned = len(kept) > 1
    words = [w for p in (kept[1:] + kept[:1] if turned else kept) for w in p]
    return words or folded(text).split(), False, turned


def _within(short: str, word: str) -> bool:
    """Whether the letters of short occur in word, in order."""
    at = iter(word)
    return all(c in at for c in short)


class Trades:
    """Trades by the spelling at the end of a name. counts: how many families each word follows."""

    def __init__(self, counts: dict[str, int]):
        common = sorted((w for w, n in counts.items() if len(w) > 1 and n >= TRADE_FAMILIES), key=lambda w: (-counts[w], w))
        full: list[str] = []
        for w in common:  # a rarer word that abbreviates or misspells a more common one is no trade of its own
            if not self._of(w, full):
                full.append(w)
        # longer words may come after their abbreviations
        self.full = [w for w in full if not any(len(w) < len(u) and u.startswith(w) for u in full)]
        self.cache: dict[str, str | None] = {}

    @staticmethod
    def _of(word: str, full: list[str]) -> str | None:
        if word in full:
            return word
        if len(word) > 2 and (hits := [u for u in full if u.startswith(word)]):
            return hits[0]
        if len(word) > 3 and (hits := [u for u in full if len(u) > 3 and edits(word, u, 1) <= 1]):
            return hits[0]
        if 2 <= len(word) <= 8 and (hits := [u for u in full if len(u) > len(word) and _within(word, u) and (word[0] == u[0] or len(word) == 3)]):
            return min(hits, key=lambda u: (word[0] != u[0], word[0] == u[0] and word[-1] != u[-1], len(u)))
        if len(word) > 4 and (hits := [u for u in full if len(u) > 5 and edits(word, u, 2) <= 2]):
            return hits[0]
        return None

    def of(self, word: str) -> str | None:
        if word not in self.cache:
            if len(self.cache) > 100_000:
                self.cache.clear()
            self.cache[word] = self._of(word, self.full)
        return self.cache[word]

    def form(self, name: str) -> tuple[str, str]:
        """(family words, trade); the trade is '' where the name has none."""
        words, host, _ = name_words(name)
        if host:
            hits = [t for t in self.full if words[0].endswith(t) and len(words[0]) - len(t) >= 5]
            return (words[0][: -len(hits[0])], hits[0]) if hits else (words[0], "")
        if len(words) > 1 and (trade := self.of(words[-1])):
            return " ".join(words[:-1]), trade
        return " ".join(words), ""


def family_grams(family: str) -> dict[str, float]:
    """Character n-grams of each word, its letters, and pairs with one letter between: order of parts doesn't matter."""
    bag: dict[str, float] = {}
    for w in family.split():
        bag[f"^{w[:2]}"] = bag.get(f"^{w[:2]}", 0.0) + 1.0
        for n in GRAMS:
            for i in range(len(w) - n + 1):
                bag[w[i : i + n]] = bag.get(w[i : i + n], 0.0) + COUNT[n]
        for g in w:
            bag[f"{g}."] = bag.get(f"{g}.", 0.0) + LETTER
        for i in range(len(w) - 2):
            g = f"{w[i]}_{w[i + 2]}"
            bag[g] = bag.get(g, 0.0) + SKIP
    return bag


def name_forms(names: DataFrame) -> DataFrame:
    """(name, family, trade, form) of every distinct name that is not NULL or blank; names has one column, name."""
    spark = names.sparkSession
    names = written(names.where(F.col("name").isNotNull() & (F.trim("name") != "")).distinct().repartition(groups_for(0, spark)), "names")

    def last_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [w for w, host, _ in map(name_words, b["name"]) if not host and len(w) > 1]
            yield pd.DataFrame({"word": [w[-1] for w in words], "family": [" ".join(w[:-1]) for w in words]}, dtype=object)

    ends = names.mapInPandas(last_words, "word string, family string").distinct().groupBy("word").count().where(F.col("count") >= TRADE_FAMILIES)
    # as many as a language has words for trades, each with its common misspellings
    trades = spark.sparkContext.broadcast(Trades({r["word"]: r["count"] for r in ends.collect()}))

    def form(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            forms = [trades.value.form(n) for n in b["name"]]
            yield pd.DataFrame({"name": b["name"], "family": [f for f, _ in forms], "trade": [t for _, t in forms]})

    return written(names.mapInPandas(form, "name string, family string, trade string").withColumn("form", F.xxhash64("family", "trade")), "forms")


def confirmed(p: str, q: str) -> bool:
    """Whether two families differ by few typing errors, or by these and an initial that stands for a word."""
    a, b = p.split(), q.split()
    short = {w for w in a + b if len(w) == 1}
    if short and len(a) == len(b):
        pairs = [(x, y) for x, y in zip(a, b) if not (len(x) == 1 or len(y) == 1)]
        if all(x[0] == y[0] for x, y in zip(a, b)) and pairs:
            return all(edits(x, y, 2) <= 2 for x, y in pairs)
    x, y = "".join(a), "".join(b)
    most = min(3, max(len(x), len(y)) // 4)
    return edits(x, y, most) <= most


def _checked(edges: DataFrame, forms: DataFrame) -> DataFrame:
    """edges without those of a cosine below SURE that are not confirmed."""
    named = forms.select("id", "text")
    unsure = edges.where(F.col("sim") < SURE).join(named.withColumnsRenamed({"id": "a", "text": "p"}), "a").join(named.withColumnsRenamed({"id": "b", "text": "q"}), "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[confirmed(p, q) for p, q in zip(b["p"], b["q"])], ["a", "b", "sim"]]

    return edges.where(F.col("sim") >= SURE).unionByName(unsure.select("a", "b", "sim", "p", "q").mapInPandas(check, "a bigint, b bigint, sim double"))


def average_linkage(nodes: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """(form, grp) by average linkage over a sparse similarity graph; a pair without an edge counts 0.

    Rounds of reciprocal nearest neighbours: each round merges all pairs that are each other's nearest
    at or above threshold. As average linkage is reducible this gives the same groups as merging the
    best pair each time, in about as many rounds as the logarithm of the largest group. All state lies
    in tables, so a group of any size is merged without being gathered in a task.
    """
    members = nodes.select("form", F.col("form").alias("grp"))
    state = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("sim").alias("s"), F.lit(1).cast("bigint").alias("na"), F.lit(1).cast("bigint").alias("nb")), "edges")
    while True:
        # the best edge of each group: highest average, ties by the ids
        near = state.withColumn("rank", F.struct((F.col("s") / (F.col("na") * F.col("nb"))).alias("avg"), (-F.col("a")).alias("x"), (-F.col("b")).alias("y"))).where(F.col("rank.avg") >= threshold)
        best = near.select(F.explode(F.array("a", "b")).alias("grp"), "rank", (F.col("na") + F.col("nb")).alias("n")).groupBy("grp").agg(F.max(F.struct("rank", "n")).alias("m"))
        merged = best.select("grp", (-F.col("m.rank.x")).alias("a"), (-F.col("m.rank.y")).alias("b"), F.col("m.n").alias("n")).groupBy("a", "b", "n").agg(F.count("*").alias("c")).where("c = 2")
        change = written(merged.select(F.explode(F.array("a", "b")).alias("old"), F.col("a").alias("new"), "n"), "merge")
        if change.isEmpty():
            return members
        ca, cb = (change.select(F.col("old").alias(k), F.col("new").alias(f"new_{k}"), F.col("n").alias(f"n_{k}")) for k in ("a", "b"))
        moved = state.join(ca, "a", "left").join(cb, "b", "left").select(
            F.coalesce("new_a", "a").alias("p"), F.coalesce("new_b", "b").alias("q"), "s", F.coalesce("n_a", "na").alias("np"), F.coalesce("n_b", "nb").alias("nq")
        ).where("p != q")
        swap = F.col("p") > F.col("q")
        moved = moved.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "s", F.when(swap, F.col("nq")).otherwise(F.col("np")).alias("na"), F.when(swap, F.col("np")).otherwise(F.col("nq")).alias("nb"))
        new_state = written(moved.groupBy("a", "b", "na", "nb").agg(F.sum("s").alias("s")).select("a", "b", "s", "na", "nb"), "edges")
        members = written(members.join(change.select(F.col("old").alias("grp"), F.col("new")), "grp", "left").select("form", F.coalesce("new", "grp").alias("grp")), "members")
        drop_written(state)
        state = new_state


def link_names(names: DataFrame) -> DataFrame:
    """(name, org) for every distinct name that is not NULL or blank; names has one column, name.

    org is the same for the spellings of one organisation. Case, accents, spaces, punctuation, legal
    forms, asides ('(Careers)', '| Jobs', '- EMEA'), the order and joining of parts, initials, short
    trades and typing errors may differ; another trade is another organisation. Names that share no
    key stay apart; a name without trade that resembles two organisations alike stays alone. Repeated
    names give one row; an empty table gives an empty result. Very long names are compared whole.
    """
    named = name_forms(names)
    forms = written(named.select(F.col("form").alias("id"), F.col("trade").alias("grp"), F.col("family").alias("text")).distinct(), "distinct")
    vectors = written(counted(forms, family_grams), "vectors")
    weights = weighting(vectors, family_grams, smooth=SMOOTH)
    edges = _checked(written(cosine_pairs(vectors, None, weights, KEEP), "pairs"), forms)
    grouped = average_linkage(forms.select(F.col("id").alias("form")), edges, MERGE)
    # forms without a trade join the group they resemble, if it is only one
    bare, with_trade = (vectors.where(c).drop("grp") for c in ("grp = ''", "grp != ''"))
    near = cosine_pairs(bare, with_trade, weights, JOIN - LEAD)
    by_group = near.join(grouped.select(F.col("form").alias("b"), "grp"), "b").groupBy("a", "grp").agg(F.max("sim").alias("sim"))
    ranked = by_group.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "grp"))).where("r <= 2")
    top = ranked.groupBy("a").agg(F.max_by("grp", "sim").alias("joins"), F.max("sim").alias("first"), F.min(F.when(F.col("r") == 2, F.col("sim"))).alias("second"))
    top = top.where((F.col("first") >= JOIN) & (F.coalesce("second", F.lit(0.0)) <= F.col("first") - LEAD))
    org = grouped.join(top.select(F.col("a").alias("form"), "joins"), "form", "left").select("form", F.coalesce("joins", "grp").alias("org"))
    return written(named.join(org, "form").select("name", "org"), "orgs")
