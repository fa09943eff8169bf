"""Secret scan: fixed patterns, and a randomness test battery with length-aware false-discovery control.

Candidates are maximal runs of 16 and more characters of the base-64 families that touch no pattern match; of a run
that mixes + or / with - or _, the maximal stretches of either family, which may overlap.  Each is given the smallest encoding that holds its characters, and three tests look for order in it: chi-squared uniformity
over the alphabet, Wald-Wolfowitz runs about the median symbol, and lag-1 serial correlation.  Their combined p-value
(Fisher) must not reject randomness.  As a short string passes such tests by lack of power, a second p-value asks how
likely *ordinary text* of this length is to look as uniform: the noncentral chi-squared whose noncentrality comes from
the byte frequencies of the whole corpus.  Those p-values, weighted by length class, go through Benjamini-Hochberg over
all candidates of the corpus; the step-up needs only a histogram of bounded size.

Defined results: null or empty texts have no spans; repeated rows are judged one by one (each counts in the histogram);
an empty table gives no rows; other columns are ignored.  Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, read_table, stored

ASSIGN = re.compile(
    "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
RUN = re.compile("[A-Za-z0-9+/_-]{16,}")
KINDS = ("assign", "access", "hex", "random")

#: Encodings from the smallest alphabet to the largest; fixed values.
ALPHABETS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Randomness is rejected below this combined p-value; discoveries are made at this false-discovery rate.
REJECT, FDR = 1e-3, 1e-3
#: Steps of the histogram of -log10 p: width and number.
STEP, STEPS = 0.01, 4000
#: What base64url and base64 lack; a run with characters of both is cut at either.
CUTS = (re.compile("[+/]"), re.compile("[_-]"))
MIN_RUN = 16

PASS = "doc_id long, spans array<struct<kind:int,start:long,end:long>>, found array<struct<start:long,end:long,enc:int,chi2:double,p_random:double>>, bytes array<long>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns: leftmost, not overlapping within a kind, failing matches dropped."""
    spans = [(0, *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        spans += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return spans + [(2, *m.span()) for m in HEX.finditer(text)]


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding_of(run: str) -> int:
    """The first, so the smallest, encoding whose alphabet holds all characters; -1 if none does."""
    have = set(run)
    return next((i for i, (_, letters) in enumerate(ALPHABETS) if have <= set(letters)), -1)


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the runs; a run that mixes the families gives the maximal stretches of each, by start, without repeats."""
    for m in RUN.finditer(text):
        start, run = m.start(), m[0]
        if not all(cut.search(run) for cut in CUTS):
            yield m.span()
            continue
        found = set()
        for cut in CUTS:
            ends = [-1, *(c.start() for c in cut.finditer(run)), len(run)]
            found |= {(start + s + 1, start + e) for s, e in zip(ends, ends[1:]) if e - s - 1 >= MIN_RUN}
        yield from sorted(found)


def battery(run: str, enc: int) -> tuple[float, float]:
    """Chi-squared against uniformity, and the combined p-value of the three tests under randomness."""
    letters = ALPHABETS[enc][1]
    a, n = len(letters), len(run)
    x = np.array([letters.index(c) for c in run], float)
    seen = np.bincount(x.astype(int), minlength=a)
    chi2 = float(((seen - n / a) ** 2).sum() * a / n)
    spread = math.sqrt(2 * (a - 1) * (n - 1) / n)
    p_chi = _tail((chi2 - (a - 1)) / spread)
    high = x >= a / 2
    n1 = int(high.sum())
    n0 = n - n1
    mean = 1 + 2 * n0 * n1 / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = 2 * _tail(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1e-12
    c = x - x.mean()
    power = float((c * c).sum())
    p_serial = 2 * _tail(abs(float((c[1:] * c[:-1]).sum()) / power + 1 / n) * math.sqrt(n)) if power else 1e-12
    t = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    return chi2, math.exp(-t) * (1 + t + t * t / 2)  # chi-squared with 6 degrees of freedom at 2t


def ordinary(chi2: float, n: int, enc: int, freq: np.ndarray) -> float:
    """How likely a text of n characters with the corpus's frequencies is as uniform as this over the alphabet."""
    q = freq[np.frombuffer(ALPHABETS[enc][1].encode(), np.uint8)]
    if q.sum() <= 0:
        return 1.0
    q = q / q.sum()
    a = len(q)
    shift = n * (a * float((q * q).sum()) - 1)
    mean, var = a - 1 + shift, 2 * (a - 1) + 4 * shift
    return _tail((mean - chi2) / math.sqrt(var))


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pattern spans and tested candidates of each text; one extra row carries the byte counts of a batch."""
    for batch in batches:
        ids, spans, found, total = [], [], [], np.zeros(256, np.int64)
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            total += np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
            base, tested = base_spans(text), []
            for start, end in stretches(text):
                run = text[start:end]
                if (enc := encoding_of(run)) < 0 or any(s < end and start < e for _, s, e in base):
                    continue
                tested.append((start, end, enc, *battery(run, enc)))
            ids.append(key)
            spans.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
            found.append([dict(zip(("start", "end", "enc", "chi2", "p_random"), x, strict=True)) for x in tested])
        span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
        cand = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("enc", pa.int32()), ("chi2", pa.float64()), ("p_random", pa.float64())])
        yield pa.record_batch(
            [
                pa.array([*ids, None], pa.int64()), pa.array([*spans, None], pa.list_(span)), pa.array([*found, None], pa.list_(cand)),
                pa.array([None] * len(ids) + [total.tolist()], pa.list_(pa.int64())),
            ],
            names=["doc_id", "spans", "found", "bytes"],
        )


def step_of(p: float, weight: float) -> int:
    """Histogram step of a weighted p-value; rounding is downwards in evidence."""
    return min(STEPS - 1, int(max(0.0, -math.log10(max(min(1.0, p / weight), 1e-300))) / STEP))


def step_up(counts: dict[int, int], rate: float) -> int:
    """Benjamini-Hochberg over a histogram: the least step whose p-value bound holds; STEPS if none does."""
    m, above, least = sum(counts.values()), 0, STEPS
    for step in sorted(counts, reverse=True):
        above += counts[step]
        if 10 ** (-step * STEP) <= rate * above / m:
            least = step
    return least


def secret_spans(docs: DataFrame, rate: float = FDR) -> DataFrame:
    """Per document row: all spans as (kind, start, end), pattern matches and discoveries, by start, then kind."""
    spark = docs.sparkSession
    prepare(spark)
    first = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, PASS), "secrets")
    sums = [F.sum(F.col("bytes")[i]).alias(f"b{i}") for i in range(256)]
    freq = np.array([x or 0 for x in first.where("bytes is not null").agg(*sums).collect()[0]], float)
    rows = first.where("bytes is null").drop("bytes")
    tested = rows.where(F.size("found") > 0).select(F.explode("found").alias("x")).select((F.col("x.end") - F.col("x.start")).alias("n"))
    mean = tested.agg(F.avg("n").alias("m")).collect()[0].m or 1.0
    weight = lambda n: min(n, 4 * mean) / mean  # noqa: E731  length classes in which tests have power weigh more

    def steps(batches):
        for batch in batches:
            got = [step_of(ordinary(x["chi2"], x["end"] - x["start"], x["enc"], freq), weight(x["end"] - x["start"])) for one in batch.column(0).to_pylist() for x in one or ()]
            yield pa.record_batch([pa.array(got, pa.int32())], names=["step"])

    hist = rows.select("found").where(F.size("found") > 0).mapInArrow(steps, "step int").groupBy("step").count()
    least = step_up({r["step"]: r["count"] for r in hist.collect()}, rate)  # at most STEPS rows

    def decide(batches):
        for batch in batches:
            out = []
            for spans, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                all_spans = [(x["start"], x["kind"], x["end"]) for x in spans or ()]
                for x in found or ():
                    n = x["end"] - x["start"]
                    if x["p_random"] >= REJECT and step_of(ordinary(x["chi2"], n, x["enc"], freq), weight(n)) >= least:
                        all_spans.append((x["start"], 3, x["end"]))
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(all_spans)])
            span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
            yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(span))], names=["doc_id", "spans"])

    return rows.mapInArrow(decide, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secret_spans(read_table(spark, sf_dir, "documents"))
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(text(F.filter("spans", lambda x: x["kind"] != "random")), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"), count("random"),
    )


def digest(spans: list[tuple[int, int, int]]) -> str:
    """The base digest of a text's pattern spans, as the query derives it."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted((s, k, e) for k, s, e in spans)).encode()).hexdigest()
