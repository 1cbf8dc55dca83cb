"""Quality rules with robust multivariate outliers.

Base rules reject short and repetitive texts. The others are judged by their
statistics, transformed to be roughly symmetric, against the minimum-covariance-
determinant estimate of their language and source. Each estimate begins from
several starts: medians with median deviations, the mean and covariance of all,
and the covariance of signs around the medians. From each, concentration steps
keep the `support` share of the documents with the smallest Mahalanobis distances
and take mean and covariance of those, over all documents, until the determinant
falls no more; of the starts, the one that ends with the least determinant counts.
A document whose distance to its group's estimate lies beyond the chi-square
quantile is an outlier.

Every covariance has a floor added, the regularised form of the estimate, so a
statistic that hardly any document of a group has (say, repeated lines) can't
make it singular and reject all that do. Every group has its own estimate, shrunk
towards its language's as if that were SHRINK more documents; the language's is
shrunk in the same way towards the one over all documents. So a group of a few
documents is judged nearly by its language, and one of many by itself, without a
size at which that changes.

Statistics are held as integers in steps of 1 / GRID, so sums are exact and the
verdicts don't depend on the order of rows. Medians, deviations and the share's
bound come from histograms; documents in the histogram's cell that holds the
bound, and so all at equal distances, count in part, each alike, so that the
share is kept exactly. A group is never gathered: its rows are summed before the
exchange, and what a group has left is a histogram of bounded size.

Null and empty texts have no words and fail the base rules. Null languages and
sources are groups of their own. Very long texts are read whole. Repeated rows
count and are judged each. A document at the quantile stays. An empty table gives
an empty result; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, ship
from .common import strings, units

LEAST_WORDS = 50
#: A text fails if over this share (of 100) of its words lie in repeated windows.
MOST_REPEATED = 50
WINDOW = 3
SUPPORT = 0.75
#: A start is done when a step lowers its determinant by no more than this share.
STILL = 1e-3
#: A group's estimate is mixed with its language's as if that were so many documents.
SHRINK = 40
#: Cells of the histogram of distances to each doubling.
BINS = 64
#: The share of clean documents that chance may reject, under a normal distribution.
TAIL = 1e-7
GRID = 256
#: Statistics and the least spread of each: logarithm of words, mean word length, symbols per character, lines and words that repeat.
DIMENSIONS = ("log_words", "word_length", "symbols", "dup_lines", "repeat_words")
FLOORS = (0.35, 0.35, 0.12, 0.35, 0.45)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts_of(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(data.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len(set(lines))
    repeat = 0
    if n > WINDOW:
        place: dict[bytes, int] = {}
        code = np.array([place.setdefault(w, len(place)) for w in words], np.int64)
        if len(place) < n:  # a repeated window needs a repeated word
            k = len(place)
            pair = code[:-1] * k + code[1:]
            _, pair = np.unique(pair, return_inverse=True)
            window = pair[: n - 2] * k + code[2:]
            _, at, many = np.unique(window, return_inverse=True, return_counts=True)
            twice = many[at] >= 2
            if twice.any():
                inside = np.zeros(n, bool)
                for s in range(WINDOW):
                    inside[s : n - 2 + s] |= twice
                repeat = int(inside.sum())
    return n, chars, symbols, dup_lines, repeat


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the five counts, base_failed and x (the transformed statistics, as integers in steps of 1 / GRID): a table in the shared folder."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in units(batches):
            c = np.array([counts_of(t) for t in strings(b.column("text"))], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), *(pa.array(c[:, k]) for k in range(5))], names=["doc_id", "lang", "source", *COUNTS])

    found = rows.mapInArrow(run, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} bigint" for c in COUNTS))
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    x = (
        F.log(words),
        4 * F.log(F.least(chars / words, F.lit(1000.0)) + 1),
        4 * F.sqrt(F.col("n_symbols") / chars),
        F.log1p(F.col("n_dup_lines").cast("double")),
        4 * F.sqrt(F.col("n_repeat_words") / words),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return materialize(found.withColumn("base_failed", failed).withColumn("x", F.array(*[F.round(v * GRID).cast("long") for v in x])), "statistics")


# estimates: small frames, one row per group


def _quantile(d: int, share: float) -> float:
    """The chi-square quantile with d degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - _beyond(d, mid) < share else (low, mid)
    return (low + high) / 2


def _beyond(d: int, x: float) -> float:
    """The chance that a chi-square variate with d degrees of freedom exceeds x."""
    a, h = d % 2, x / 2
    total = math.erfc(math.sqrt(h)) if a else math.exp(-h)
    k = 0.5 if a else 1.0
    term = math.sqrt(h) * math.exp(-h) / math.gamma(1.5) if a else math.exp(-h) * h
    while k < d / 2:
        total += term
        k += 1
        term *= h / k
    return total


def consistency(d: int, share: float) -> float:
    """The factor by which the covariance of the closest share of normal points is too small, inverted."""
    return share / (1 - _beyond(d + 2, _quantile(d, share)))


_D = len(DIMENSIONS)
_SIGN = 4096
_MATRIX = "mean array<double>, cov array<double>, inverse array<double>, det double"
_ESTIMATE = f"key string, start int, n bigint, {_MATRIX}"


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(_D) for j in range(i + 1)]


def _settled(mean: np.ndarray, cov: np.ndarray) -> dict:
    """An estimate's columns; distances and determinants are those of the covariance with its floor."""
    full = cov + np.diag(np.array(FLOORS) ** 2)
    return {"mean": mean.tolist(), "cov": cov.ravel().tolist(), "inverse": np.linalg.inv(full).ravel().tolist(), "det": float(np.linalg.det(full))}


def _key(level: int, lang: F.Column | None = None, source: F.Column | None = None) -> F.Column:
    """A string that tells groups apart: level 0 all documents, 1 a language, 2 a language and source."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.concat_ws("/", F.lit(str(level)), *[part(c) for c in (lang, source) if c is not None])


def _levels(able: DataFrame) -> DataFrame:
    """Every row's x for all documents, for its language and for its group."""
    lang, source = F.col("lang"), F.col("source")
    return able.select("x", F.explode(F.array(_key(0), _key(1, lang), _key(2, lang, source))).alias("key"))


def _x(k: int) -> F.Column:
    return F.get("x", F.lit(k))


def _moments(rows: DataFrame, values: list[F.Column], *by: str) -> DataFrame:
    """Counts, sums and sums of products of whole numbers."""
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(values)] + [F.sum(values[i] * values[j]).alias(f"p{i}_{j}") for i, j in _pairs()]
    return rows.groupBy(*by).agg(F.count("*").alias("c"), *sums)


def _mean_cov(own: pd.DataFrame, weight: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """Of moments, each row's with a weight: in whole numbers where the weight is 1."""
    full, part = own[weight == 1], own[weight < 1]
    w = weight[weight < 1].tolist()
    total = lambda c: sum(map(int, full[c])) + sum(x * int(v) for x, v in zip(w, part[c]))
    h = total("c")
    s = [total(f"s{i}") for i in range(_D)]
    cov = np.zeros((_D, _D))
    for i, j in _pairs():
        cov[i, j] = cov[j, i] = (total(f"p{i}_{j}") * h - s[i] * s[j]) / (h * h) / unit**2
    return np.array([x / h for x in s]) / unit, cov


def _medians(able: DataFrame) -> DataFrame:
    """key, n, median and spread (the median deviations) of each group."""
    cells = _levels(able).select("key", F.posexplode("x").alias("k", "v")).groupBy("key", "k", "v").agg(F.count("*").alias("c"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("v")
        v, c = own["v"].to_numpy(float) / GRID, own["c"].to_numpy()
        n = int(c.sum())
        median = v[np.searchsorted(c.cumsum(), (n + 1) // 2)]
        order = np.argsort(np.abs(v - median), kind="stable")
        spread = 1.4826 * np.abs(v - median)[order][np.searchsorted(c[order].cumsum(), (n + 1) // 2)]
        return pd.DataFrame([{"key": own["key"].iloc[0], "k": own["k"].iloc[0], "n": n, "median": median, "spread": spread}])

    each = cells.groupBy("key", "k").applyInPandas(run, "key string, k int, n bigint, median double, spread double")
    listed = each.groupBy("key").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "median", "spread"))).alias("e"))
    return materialize(listed.select("key", "n", F.col("e.median").alias("median"), F.col("e.spread").alias("spread")), "medians")


def _starts(able: DataFrame) -> DataFrame:
    """The estimates that the steps begin with, three for each group."""
    medians = _medians(able)
    rows = _levels(able).join(medians, "key")
    z = [(_x(k) / float(GRID) - F.get("median", F.lit(k))) / F.greatest(F.get("spread", F.lit(k)), F.lit(FLOORS[k])) for k in range(_D)]
    rows = rows.withColumn("z", F.array(*z))
    rows = rows.withColumn("r", F.sqrt(sum((F.get("z", F.lit(k)) * F.get("z", F.lit(k)) for k in range(_D)), F.lit(0.0))))
    sign = [F.when(F.col("r") > 0, F.round(F.get("z", F.lit(k)) / F.col("r") * _SIGN)).otherwise(0).cast("long") for k in range(_D)]
    both = rows.select("key", F.explode(F.array(F.struct(F.lit(1).alias("start"), F.col("x").alias("x")), F.struct(F.lit(2).alias("start"), F.array(*sign).alias("x")))).alias("e")).select("key", "e.start", "e.x")
    moments = _moments(both, [_x(k) for k in range(_D)], "key", "start").join(medians, "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k in range(len(pdf)):
                own = pdf.iloc[k : k + 1]
                row = own.iloc[0]
                median, spread = np.array(row["median"], float), np.array(row["spread"], float)
                if row["start"] == 1:
                    out.append((row, 0, median, np.diag(spread**2)))
                    out.append((row, 1, *_mean_cov(own, np.ones(1), GRID)))
                else:
                    scale = np.maximum(spread, FLOORS)
                    shape = np.zeros((_D, _D))
                    for i, j in _pairs():
                        shape[i, j] = shape[j, i] = int(row[f"p{i}_{j}"]) / int(row["c"]) / _SIGN**2
                    out.append((row, 2, median, _D * shape * np.outer(scale, scale)))
            yield pd.DataFrame([{"key": r["key"], "start": s, "n": int(r["n"])} | _settled(mean, cov) | {"det": math.inf} for r, s, mean, cov in out], columns=["key", "start", "n", "mean", "cov", "inverse", "det"])

    return materialize(moments.mapInPandas(run, _ESTIMATE), "starts")


def _distance(mean: F.Column, inverse: F.Column) -> F.Column:
    z = [_x(k) / float(GRID) - F.get(mean, F.lit(k)) for k in range(_D)]
    total = F.lit(0.0)
    for i in range(_D):
        for j in range(i + 1):
            total = total + z[i] * z[j] * F.get(inverse, F.lit(i * _D + j)) * (1.0 if i == j else 2.0)
    return total


def _concentrate(able: DataFrame, estimate: DataFrame, support: float) -> DataFrame:
    """One concentration step of every estimate: the closest documents' mean and covariance. still: the determinant falls no more."""
    # estimates are as many as groups, and Spark broadcasts them where their size is known to be small
    rows = _levels(able).join(estimate.select("key", "start", "mean", "inverse", F.col("det").alias("before")), "key")
    rows = rows.withColumn("bin", F.floor(F.log2(_distance(F.col("mean"), F.col("inverse")) + 1e-6) * BINS).cast("int"))
    cells = _moments(rows, [_x(k) for k in range(_D)], "key", "start", "before", "bin")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("bin")
        c = own["c"].to_numpy()
        n = int(c.sum())
        weight = np.clip((support * n - (c.cumsum() - c)) / c, 0, 1)
        mean, cov = _mean_cov(own[weight > 0], weight[weight > 0], GRID)
        first = own.iloc[0]
        found = {"key": first["key"], "start": int(first["start"]), "n": n} | _settled(mean, cov * consistency(_D, support) if support < 1 else cov)
        return pd.DataFrame([found | {"still": bool(found["det"] >= first["before"] * (1 - STILL))}])

    return materialize(cells.groupBy("key", "start").applyInPandas(run, f"{_ESTIMATE}, still boolean"), "estimates")


def estimates(able: DataFrame, support: float = SUPPORT) -> DataFrame:
    """key, start, n, mean, cov, inverse, det: of each group (see _key) the estimate of the least determinant. able: lang, source, x."""
    now = _starts(able)
    ended = None
    while True:
        after = _concentrate(able, now, support)
        found = after.where("still").drop("still")
        ended = found if ended is None else ended.unionByName(found)
        now = after.where("NOT still").drop("still")
        if now.isEmpty():
            break
    first = F.row_number().over(Window.partitionBy("key").orderBy("det", "start"))  # three rows each
    return materialize(ended.withColumn("_first", first).where("_first = 1").drop("_first"), "estimates")


def _shrunk(own: DataFrame, towards: DataFrame, on: list[str], shrink: float) -> DataFrame:
    """own (n, mean, cov) mixed with another estimate that counts as `shrink` documents."""
    mixed = lambda a, b: F.zip_with(a, b, lambda x, y: (F.col("n") * x + shrink * y) / (F.col("n") + shrink))
    other = towards.select(*on, F.col("mean").alias("_mean"), F.col("cov").alias("_cov"))
    joined = own.join(other, on) if on else own.crossJoin(F.broadcast(other))  # one row
    return joined.withColumns({"mean": mixed("mean", "_mean"), "cov": mixed("cov", "_cov")}).drop("_mean", "_cov")


def group_estimates(able: DataFrame, support: float = SUPPORT, shrink: float = SHRINK) -> DataFrame:
    """key, mean, inverse of each language and source, shrunk."""
    found = estimates(able, support).select("key", "n", "mean", "cov")
    lang, source = F.col("lang"), F.col("source")
    names = able.select("lang", "source").distinct().select(_key(1, lang).alias("_lang"), _key(2, lang, source).alias("key")).distinct()
    whole = found.where(F.col("key") == _key(0))
    langs = _shrunk(found.where(F.col("key").startswith("1/")).withColumnRenamed("key", "_lang"), whole, [], shrink)
    groups = _shrunk(found.join(names, "key"), langs, ["_lang"], shrink).select("key", "mean", "cov")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"key": k} | _settled(np.array(m), np.array(c).reshape(_D, _D)) for k, m, c in zip(pdf["key"], pdf["mean"], pdf["cov"])]
            yield pd.DataFrame([{c: r[c] for c in ("key", "mean", "inverse")} for r in rows], columns=["key", "mean", "inverse"])

    return materialize(groups.mapInPandas(run, "key string, mean array<double>, inverse array<double>"), "groups")


def judge(docs: DataFrame, support: float = SUPPORT, shrink: float = SHRINK, tail: float = TAIL) -> DataFrame:
    """doc_id, lang, source, the five counts, base_failed, distance2, kept."""
    found = statistics(docs)
    groups = group_estimates(found.where(~F.col("base_failed")).select("lang", "source", "x"), support, shrink)
    rows = found.withColumn("key", _key(2, F.col("lang"), F.col("source"))).join(groups, "key", "left")
    rows = rows.withColumn("distance2", _distance(F.col("mean"), F.col("inverse")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= _quantile(_D, 1 - tail), F.lit(True))
    return rows.select("doc_id", "lang", "source", *COUNTS, "base_failed", "distance2", kept.alias("kept"))
