"""Per-document text statistics, and how far each document lies from prose in its language.

Every statistic is computed over the whole text. Robust mean and covariance of prose come, for each
language, from a bounded sample of labelled documents; the squared Mahalanobis distance of every
document over all statistics is reported with each statistic's share in it. What lies beyond the
distance that parts the labelled documents best is no prose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common words of running text, by language.
COMMON = {
    "en": "the a an and or but of to in on at for from with by as into over under after before during about than so that which who whom whose what when where while if because since unless until though although whether neither nor not no is are was were be been being am do does did has have had will would shall should can could may might must i you he she it we they me him her us them my your his its our their this that these those there here each every any some all both few more most other such only own same too very just also",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber von zu im in an am auf für aus mit bei nach über unter vor durch um als wie so dass daß welche wer was wenn wo während ob weil da seit bis obwohl weder noch nicht kein keine ist sind war waren wird werden wurde sein hat haben hatte kann können soll sollen muss müssen darf mag ich du er sie es wir ihr ihnen ihm uns euch mein dein unser unsere unserer unseren ihre ihren ihrer seine diese dieser dieses jede jeder alle beide mehr sehr nur auch sich zum zur vom beim ins damit denn dort hier",
    "fr": "le la les l un une des du de d et ou mais à au aux en dans sur sous pour par avec sans chez vers entre après avant pendant depuis que qu qui dont où quand si parce comme lorsque ni ne n pas plus est sont était étaient sera être été a ont avait avoir peut peuvent doit doivent je tu il elle nous vous ils elles me te se s lui leur y mon ma mes ton ta tes son sa ses notre nos votre vos leurs ce cet cette ces chaque tout toute tous très aussi c j m",
    "es": "el la los las un una unos unas de del y o pero a al en con sin para por sobre entre tras desde hasta durante según que quien cuyo donde cuando si porque como aunque ni no es son era eran será ser sido está están ha han había haber puede pueden debe deben yo tú él ella nosotros ustedes ellos me te se le les lo nos mi su sus tu nuestro nuestra nuestros nuestras este esta estos estas ese esa cada todo toda todos muy también más",
}
LANGUAGES = tuple(COMMON)
#: word -> bits of the languages in which it is common
_BITS: dict[str, int] = {}
for _i, _lang in enumerate(LANGUAGES):
    for _w in COMMON[_lang].split():
        _BITS[_w] = _BITS.get(_w, 0) | 1 << _i

STATISTICS = ("log_words", "word_length", "symbol_ratio", "digit_ratio", "upper_ratio", "ending_share", "common_share", "prose_share", "log_line_words", "log_sentence_words", "type_ratio")
#: A word stands in running text if, among WINDOW words around it, at least DENSITY are common words of
#: one language, DISTINCT different ones. Grammar needs many of them; lists, tables and strung words don't.
WINDOW, DENSITY, DISTINCT = 13, 0.2, 3
#: Labelled documents that the prose model is fitted on, at most.
SAMPLE_ROWS = 20_000
#: Share of either tail that is drawn in before mean and scale are taken; most units of scale that a
#: statistic counts as being off; what is added to the correlations' diagonal; rows that the model of
#: all languages stands for in that of one.
TAIL, REACH, RIDGE, SHRINK = 0.05, 12.0, 0.02, 40

_TAG = re.compile(r"<[^>]*>")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_SENTENCE = re.compile(r"[.!?…]+(?=\s|$)")


def _kind(c: str) -> int:
    return 1 * (not c.isalnum() and not c.isspace()) + 2 * c.isdigit() + 4 * c.isupper()


#: The kinds of the characters of living alphabets; others are looked up one by one.
_KINDS = np.array([_kind(chr(i)) for i in range(0x3000)], np.uint8)


def _characters(text: str) -> tuple[int, int, int]:
    """Number of symbols, digits and capitals."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _KINDS[np.minimum(codes, 0x2FFF)]
    if (far := codes >= 0x3000).any():
        others, at = np.unique(codes[far], return_inverse=True)
        kinds[far] = np.array([_kind(chr(c)) for c in others], np.uint8)[at]
    return int((kinds & 1).sum()), int((kinds >> 1 & 1).sum()), int((kinds >> 2 & 1).sum())


def _running(codes: np.ndarray, bits: np.ndarray, languages: list[int]) -> np.ndarray:
    """Which words stand in running text of one of the languages. codes: a number a word; bits: its languages."""
    n, half = len(codes), WINDOW // 2
    order = np.argsort(codes, kind="stable")
    before = np.full(n, -1)
    same = codes[order][1:] == codes[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    at = np.arange(n)
    lo, hi = np.maximum(0, at - half), np.minimum(n, at + half + 1)
    size = hi - lo
    # a word is the first of its kind in the windows around these positions
    first = np.maximum(lo, np.where(before >= 0, before + half + 1, 0))
    out = np.zeros(n, bool)
    for lang in languages:
        common = (bits >> lang & 1).astype(bool)
        total = np.r_[0, np.cumsum(common)]
        counted = common & (first < hi)
        distinct = np.cumsum(np.bincount(first[counted], minlength=n + 1) - np.bincount(hi[counted], minlength=n + 1))[:n]
        out |= (total[hi] - total[lo] >= DENSITY * size) & (distinct >= np.minimum(DISTINCT, size // 3))
    return out


def text_statistics(text: str | None) -> tuple[str, list[float]]:
    """(language, STATISTICS) of a text. A NULL or empty text has all zeros and language ''."""
    text = text or ""
    bare = _TAG.sub(" ", text) if "<" in text else text
    tokens = bare.lower().split()
    if not tokens:
        return "", [0.0] * len(STATISTICS)
    words = [t if t.isalnum() else _EDGE.sub("", t) for t in tokens]
    get = _BITS.get
    bits = np.array([get(w, 0) for w in words], np.int64)
    if "'" in bare or "’" in bare:  # l'équipe, don't: the part before the apostrophe tells
        for i, w in enumerate(words):
            if not bits[i] and ("'" in w or "’" in w):
                bits[i] = get(w.replace("’", "'").split("'", 1)[0], 0)
    sizes = np.array(list(map(len, tokens)), float)
    codes = np.array(list(map(hash, words)), np.int64)
    counts = [int((bits >> i & 1).sum()) for i in range(len(LANGUAGES))]
    best = max(range(len(counts)), key=counts.__getitem__)
    running = _running(codes, bits, [i for i, c in enumerate(counts) if c >= max(2, 0.02 * len(codes))])
    total = sizes.sum()
    lines = [x for x in map(str.strip, bare.split("\n")) if x]
    n_real = len(words) - words.count("")
    stats = [
        np.log1p(n_real),
        sum(map(len, words)) / max(1, n_real),
        *(n / total for n in _characters(bare)),
        sum(x[-1] in ".!?…:;\"”" for x in lines) / len(lines),
        counts[best] / len(tokens),
        sizes[running].sum() / total,
        np.log1p(len(tokens) / len(lines)),
        np.log1p(len(tokens) / max(1, len(_SENTENCE.findall(bare)))),
        len(set(words)) / len(words),
    ]
    return LANGUAGES[best] if counts[best] else "", [float(x) for x in stats]


def document_statistics(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, language, statistics...) for every row; map-only, whole texts."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_statistics(t) for t in b.column(1).to_pylist()]
            values = np.array([s for _, s in rows]).reshape(len(rows), len(STATISTICS))
            yield pa.record_batch([b.column(0), pa.array([x for x, _ in rows], pa.string()), *[pa.array(values[:, j]) for j in range(len(STATISTICS))]], ["doc", "language", *STATISTICS])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc).alias("doc"), F.col(text).cast("string")).mapInArrow(measure, f"doc {kind}, language string, " + ", ".join(f"{s} double" for s in STATISTICS)).withColumnRenamed("doc", doc)


Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def robust_model(x: np.ndarray, pooled: Model | None = None) -> Model:
    """Mean and scale of the rows, each statistic winsorised, and the correlation of their bounded deviations: no row weighs much, however far off it lies.

    pooled: a model towards which that of few rows is shrunk, as if it stood for SHRINK rows.
    """
    lo, hi = np.quantile(x, TAIL, axis=0), np.quantile(x, 1 - TAIL, axis=0)
    w = np.clip(x, lo, hi)
    mean, scale = w.mean(0), w.std(0) + 0.01
    z = deviations(x, (mean, scale, None))
    model = mean, scale, z.T @ z / len(z) + RIDGE * np.eye(x.shape[1])
    share = len(x) / (len(x) + SHRINK)
    return model if pooled is None else tuple(share * own + (1 - share) * all_ for own, all_ in zip(model, pooled))


def deviations(x: np.ndarray, model: Model) -> np.ndarray:
    """Deviations from the mean in units of scale, at most REACH: capitals alone or tags alone make no text an outlier."""
    return np.clip((x - model[0]) / model[1], -REACH, REACH)


def parts_of(x: np.ndarray, model: Model) -> np.ndarray:
    """Each statistic's part in the squared Mahalanobis distance; a row's parts sum to it."""
    z = deviations(x, model)
    return z * (z @ np.linalg.inv(model[2]))


def _chi_square(p: float, k: int) -> float:
    """Quantile of the chi-square distribution with k degrees of freedom (Wilson and Hilferty)."""
    from statistics import NormalDist

    return k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(p) * np.sqrt(2 / (9 * k))) ** 3


def best_limit(distance: np.ndarray, prose: np.ndarray) -> float:
    """The limit that tells labelled prose from the rest best.

    Of all limits at which at most one label more than at the best is contradicted, the one in the
    widest gap (of logarithms) between two distances. Without other labels than prose, or with none
    of prose, it is the chi-square quantile of 0.99.
    """
    order = np.argsort(distance, kind="stable")
    d, p = np.log(np.maximum(distance[order], 1e-9)), prose[order]
    if p.all() or not p.any():
        return float(_chi_square(0.99, len(STATISTICS)))
    wrong = np.cumsum(~p)[:-1] + p.sum() - np.cumsum(p)[:-1]  # others below, prose above
    gap = np.where(wrong <= wrong.min() + 1, np.diff(d), -1.0)
    k = int(np.argmax(gap))
    return float(np.exp((d[k] + d[k + 1]) / 2))


class ProseModels:
    """A model of prose for each language ('' for all together), and the limit of the distance."""

    def __init__(self, statistics: np.ndarray, language: np.ndarray, prose: np.ndarray):
        x = statistics[prose]
        self.models: dict[str, Model] = {}
        if len(x) > 1:
            self.models[""] = robust_model(x)
            for lang in sorted(set(language[prose]) - {""}):
                self.models[lang] = robust_model(statistics[prose & (language == lang)], self.models[""])
        distance = self.parts(statistics, language).sum(1)
        self.limit = best_limit(distance, prose) if self.models else float("nan")

    def parts(self, x: np.ndarray, language: np.ndarray) -> np.ndarray:
        out = np.full(x.shape, np.nan)
        for lang in set(language):
            if model := self.models.get(lang) or self.models.get(""):
                at = language == lang
                out[at] = parts_of(x[at], model)
        return out


def prose_models(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> ProseModels:
    """Models and limit from at most sample_rows labelled documents (those of the least hash); a document counts as prose if most of its labels say so."""
    chosen = labels.where(F.col(doc).isNotNull() & F.col("doc_kind").isNotNull()).groupBy(doc).agg((F.avg((F.col("doc_kind") == "prose").cast("double")) > 0.5).alias("_prose"))
    chosen = chosen.orderBy(F.xxhash64(doc), doc).limit(sample_rows)
    known = docs.select(doc, text).join(F.broadcast(chosen), doc)
    stats = document_statistics(known, doc, text).join(F.broadcast(chosen), doc).toPandas()
    return ProseModels(stats[list(STATISTICS)].to_numpy(float).reshape(len(stats), len(STATISTICS)), stats["language"].to_numpy(object), stats["_prose"].to_numpy(bool))


def prose_distances(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", limit: float | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics of every document with its squared distance from prose, each statistic's part, and is_outlier.

    Columns: doc, language, the STATISTICS, distance, part_<statistic> (they sum to distance; a part
    can be negative where statistics go together), is_outlier (distance beyond limit; None: the limit
    that tells the labelled documents apart best). A NULL or empty text is compared as one of zeros,
    without language. A language without labelled prose is compared with all prose together. Without
    any labelled prose distance is NULL and every document is an outlier. Repeated rows stay repeated.
    """
    models = prose_models(docs, labels, doc, text, sample_rows)
    if limit is not None:
        models.limit = limit
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[list(STATISTICS)].to_numpy(float).reshape(len(b), len(STATISTICS))
            parts = shared.value.parts(x, b["language"].to_numpy(object))
            b = b.assign(distance=parts.sum(1), **{f"part_{s}": parts[:, j] for j, s in enumerate(STATISTICS)})
            yield b.assign(is_outlier=(b["distance"].isna() | (b["distance"] > shared.value.limit)).to_numpy())

    stats = document_statistics(docs, doc, text)
    kind = stats.schema[doc].dataType.simpleString()
    doubles = ", ".join(f"{c} double" for c in (*STATISTICS, "distance", *[f"part_{s}" for s in STATISTICS]))
    return stats.mapInPandas(compare, f"{doc} {kind}, language string, {doubles}, is_outlier boolean")


def not_prose(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc) of the documents whose distance from prose is beyond the limit."""
    return prose_distances(docs, labels, doc, text).where("is_outlier").select(doc)
