"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Texts are folded first: compatibility forms, accents, look-alike letters of other scripts and digits that stand for
letters.  The lexicon (word beginnings with weights) is learned from a bounded number of labelled documents: each
term's document counts by label (copies share one count) give a smoothed log-odds weight, and only terms that are far
more frequent in toxic documents stay, at most LEXICON_TERMS.  A text's score is a logistic function of its weighted
matches, plain and normalised by length; matches inside exception phrases do not count.

Defined results: null or empty texts score like any text without matches; documents without a label train nothing; a
document labelled twice counts once for each label row; with no toxic training document no term is learned and every
score is the prior; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, prepare, read_table, stored

#: Look-alike letters (fixed values): Cyrillic and Greek forms of Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ƒ": "f", "ɡ": "g", "һ": "h", "і": "i", "ї": "i", "ј": "j",
    "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "и": "u", "ѵ": "v",
    "ѡ": "w", "х": "x", "у": "y", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "æ": "ae", "œ": "oe", "ß": "ss",
}
#: Digits and signs written for letters, inside a word that has letters (fixed values).
DIGITS = str.maketrans("01345789@$!|", "oieastbgasil")
LEET_WORD = re.compile(r"(?=[^\s]*[a-z])(?=[^\s]*[01345789@$!|])[a-z01345789@$!|]+")
#: Phrases in which a term of the lexicon is no insult; folded text, matched whole.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clown car", "sore loser", "idiot proof", "circus clown")

SHORTEST, LONGEST = 4, 12
LEXICON_TERMS = 5000
#: A term is in this many toxic training documents at least, and in this share of them.
MIN_DOCS, MIN_SHARE = 5, 0.01
#: A term stays if its documents are toxic this much more often than documents are, in log-odds.
MIN_WEIGHT = 2.5
#: The classifier is fitted on this many labelled rows at most, those of least hash.
FIT_ROWS = 20_000
THRESHOLD = 0.7


class _Fold(dict):
    """Code point to its folded form; filled as characters occur."""

    def __missing__(self, code: int):
        c = chr(code)
        base = HOMOGLYPHS.get(c.lower())
        if base is None:
            base = "".join(HOMOGLYPHS.get(x, x) for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
        if unicodedata.category(c) in ("Cf", "Mn"):
            base = ""
        self[code] = base
        return base


FOLD = _Fold()


def fold(text: str) -> str:
    """Lower case, no accents, look-alikes as Latin letters, digits inside words as the letters they stand for."""
    text = text.translate(FOLD)
    return LEET_WORD.sub(lambda m: m[0].translate(DIGITS), text) if re.search("[0-9@$!|]", text) else text


#: Letters of any script.
WORD = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[str]:
    """A word's beginnings of SHORTEST to LONGEST letters; of a shorter word the whole, with the blank behind it."""
    return [word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)] or [f"{word} "]


def held_out(doc_id: str = "doc_id"):
    """Whether a document is in the third that is never learned from; without a doc_id it is not."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each term, the weight of the toxic and of the other documents of this task that have it."""
    toxic, other = Counter(), Counter()

    def out() -> pa.RecordBatch:
        keys = list(toxic.keys() | other.keys())
        made = pa.record_batch(
            [pa.array(keys, pa.string()), pa.array([float(toxic[k]) for k in keys]), pa.array([float(other[k]) for k in keys])],
            names=["term", "toxic", "other"],
        )
        toxic.clear()
        other.clear()
        return made

    for batch in batches:
        for text, label, weight in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found = {""}
            for word in set(WORD.findall(fold(text or ""))):
                found.update(terms_of(word))
            counter = toxic if label else other
            for term in found:
                counter[term] += weight
        if len(toxic) + len(other) > 1_000_000:
            yield out()
    yield out()


class Lexicon:
    """Terms with weights as an Aho-Corasick automaton over folded words; a term matches where a word begins."""

    def __init__(self, weights: dict[str, float]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.auto.add_word(" " + term, (len(term) + 1, weight))
        for phrase in EXCEPTIONS:
            self.auto.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.auto.make_automaton()

    def features(self, text: str | None) -> tuple[float, float]:
        """Log-damped weight of matches, and the same per square root of words."""
        folded = fold(text or "")
        words = WORD.findall(folded)
        line = f" {' '.join(words)} "
        found, safe = [], []
        for end, (size, weight) in self.auto.iter(line):
            (safe if weight is None else found).append((end - size + 1, end, weight))
        best: dict[int, float] = {}
        for start, end, weight in found:
            if not any(a <= start and end <= b for a, b, _ in safe):
                best[start] = max(best.get(start, 0.0), weight)
        total = sum(best.values())
        return math.log1p(total), math.log1p(total) / math.log2(4 + len(words))


def fit(features: np.ndarray, labels: np.ndarray, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge; the offset comes first."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (labels - p) - 0.1 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with a hash of their whole folded text, blanks aside, equal for copies."""
    for batch in batches:
        folded = [" ".join(fold(t or "").split()) for t in batch.column(0).to_pylist()]
        same = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in folded]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(same, pa.binary())], names=["text", "toxic", "same"])


def weighted(labelled: DataFrame) -> DataFrame:
    """(text, toxic, weight): documents with equal folded texts share one weight of 1, so copies teach no terms."""
    rows = labelled.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(lean(copies), "text string, toxic long, same binary")
    sizes = rows.groupBy("same").agg(F.count("*").alias("n"))
    return rows.join(sizes, "same").select("text", "toxic", (1.0 / F.col("n")).alias("weight"))


def learn(labelled: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """Weights of the lexicon and of the score from (doc_id, text, toxic) rows.

    The lexicon kept has at most LEXICON_TERMS terms; with at most FIT_ROWS rows, features fit the driver.
    """
    prepare(labelled.sparkSession)
    counts = weighted(labelled).mapInArrow(lean(count_terms), "term string, toxic double, other double")
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = stored(counts.where(f"toxic >= {MIN_DOCS} or term = ''"), "toxic-terms")
    total = counts.where("term = ''").collect()
    if not total or not total[0].toxic or not total[0].other:
        return {}, np.array([-5.0, 0.0, 0.0])
    p, n = total[0].toxic, total[0].other
    weight = F.log((F.col("toxic") + 0.5) / (p + 1.0)) - F.log((F.col("other") + 0.5) / (n + 1.0))
    kept = counts.where("term <> ''").withColumn("weight", weight)
    kept = kept.where(F.col("weight") >= MIN_WEIGHT).where(F.col("toxic") >= MIN_SHARE * p)
    rows = kept.orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), F.length("term"), "term").limit(LEXICON_TERMS).collect()
    found = {r.term: (r.weight, r.toxic) for r in rows}
    extended: dict[str, list[str]] = {}
    for term in found:
        extended.setdefault(term[:-1], []).append(term)
    # of beginnings that occur in (nearly) the same documents, the longest says most precisely what is meant
    found = {
        t: v for t, v in found.items() if not any(t == u[:-1] and found[u][1] >= 0.97 * v[1] for u in extended.get(t, ()))
    }
    weights = {}
    for term, (value, docs) in sorted(found.items(), key=lambda x: (len(x[0]), x[0])):
        # a longer term adds nothing where its beginning is in the lexicon and as telling
        if not any(term[:k] in weights and weights[term[:k]] >= value - 0.7 for k in range(SHORTEST, len(term))):
            weights[term] = float(value)
    features = featured(labelled.select("doc_id", "text", F.col("toxic").cast("double").alias("label")), weights)
    got = features.select("label", "f0", "f1").toPandas()
    return weights, fit(got[["f0", "f1"]].to_numpy(float), (got["label"] > 0).to_numpy(float))


def featured(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The rows with the two features f0 and f1 of their column `text` behind all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # at most LEXICON_TERMS terms
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        for batch in batches:
            got = [lexicon.features(t) for t in batch.column(at).to_pylist()]
            made = [pa.array([x for x, _ in got], pa.float64()), pa.array([y for _, y in got], pa.float64())]
            yield pa.record_batch([*batch.columns, *made], names=[*batch.schema.names, "f0", "f1"])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, *(T.StructField(f, T.DoubleType()) for f in ("f0", "f1"))]))


def toxicity(docs: DataFrame, weights: dict[str, float], score: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, held_out, score and predicted for each document row; the text alone decides the score."""
    prepare(docs.sparkSession)
    z = F.lit(float(score[0])) + F.lit(float(score[1])) * F.col("f0") + F.lit(float(score[2])) * F.col("f1")
    rows = featured(docs.select(*dict.fromkeys([*keep, "doc_id", "text"])), weights)
    out = rows.select(*keep, held_out().alias("held_out"), (1 / (1 + F.exp(-z))).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most FIT_ROWS labelled documents outside the held-out third, those of least hash of their doc_id.

    The bound makes the ids small enough to send to every task (under 1 MB), so texts are not shuffled.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), "toxic").where("doc_id is not null and toxic is not null").where(~held_out("label_id"))
    known = stored(known.orderBy(F.xxhash64("label_id"), "label_id", "toxic").limit(FIT_ROWS), "labels")
    found = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    return stored(found.select("doc_id", "text", "toxic"), "labelled")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    weights, score = learn(training_rows(docs, read_table(spark, sf_dir, "labels")))
    return toxicity(docs, weights, score)
