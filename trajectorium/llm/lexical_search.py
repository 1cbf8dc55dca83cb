"""Ranked lexical search by MaxScore, shard by shard.

A shard is the postings of a few MB of documents inside a task. An item's terms
are sorted by the most that each adds in the shard. Those whose bounds together
stay below the item's threshold (its k-th best score so far in the task) are
non-essential: a document with none of the others can't qualify. Documents are
taken from the essential postings only, and the non-essential ones are probed,
largest bound first, for documents that can still reach the threshold. Every
task sends its k best documents of each item, and these are ranked in two steps.

A first pass over all documents counts N, L and the df of the items' terms.
Items are taken in blocks of at most BLOCK_TERMS terms (one item at least), so
what the driver and the tasks hold of them is bounded; each block is a pass over
the documents.

Null texts and those without a term count nowhere and are found by nothing; items
like that find nothing. Texts of any length are read whole. Equal scores rank by
ascending doc_id, null last. Repeated documents are ranked each, repeated items
answered each. Empty tables give an empty one, and other columns are left alone
whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, ship
from .common import units

TOP = 10
#: Terms of the items that are answered in one pass.
BLOCK_TERMS = 400_000
#: Parts in which an item's candidates are ranked first.
PARTS = 64
#: On UTF-8: A-Z are lower-cased, other ASCII but digits and a-z separates, all else is part of a term.
_FOLD = bytes(b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Postings:
    """The postings of one shard: documents and contributions of each term, ascending by document, and the most a term adds."""

    def __init__(self, texts: Iterator[bytes], vocabulary: dict[bytes, int], weights: np.ndarray, n_docs: int, n_terms: int):
        term, doc, tf, norm = [], [], [], []
        for k, t in enumerate(texts):
            words = terms(t)
            norm.append(10 + 90 * len(words) * n_docs // max(1, n_terms))
            for w, c in Counter(words).items():
                i = vocabulary.get(w)
                if i is not None:
                    term.append(i)
                    doc.append(k)
                    tf.append(c)
        self.size = len(norm)
        term, doc, tf = (np.array(x, np.int64) for x in (term, doc, tf))
        by = np.argsort(term, kind="stable")
        term, self.doc, tf = term[by], doc[by], tf[by]
        self.adds = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * np.array(norm, np.int64)[self.doc]))
        held, starts = np.unique(term, return_index=True)
        self.start = np.zeros(len(weights), np.int64)
        self.end = np.zeros(len(weights), np.int64)
        self.bound = np.zeros(len(weights), np.int64)
        self.start[held], self.end[held] = starts, np.append(starts[1:], len(term))
        if len(held):
            self.bound[held] = np.maximum.reduceat(self.adds, starts)

    def qualifying(self, query: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a score of at least threshold, which is positive, and their scores."""
        query = query[self.bound[query] > 0]
        query = query[np.argsort(self.bound[query], kind="stable")]
        reach = np.cumsum(self.bound[query])
        split = int(np.searchsorted(reach, threshold, "left"))  # terms before it add less than the threshold together
        if split == len(query):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        score = np.zeros(self.size, np.int64)
        for t in query[split:].tolist():
            s, e = self.start[t], self.end[t]
            score[self.doc[s:e]] += self.adds[s:e]
        found = np.flatnonzero(score)
        for k in range(split - 1, -1, -1):
            found = found[score[found] + reach[k] >= threshold]
            if not len(found):
                break
            s, e = self.start[query[k]], self.end[query[k]]
            at = np.minimum(np.searchsorted(self.doc[s:e], found), e - s - 1)
            hit = self.doc[s:e][at] == found
            score[found[hit]] += self.adds[s:e][at[hit]]
        found = found[score[found] >= threshold]
        return found, score[found]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[np.ndarray], dict[bytes, int]]]:
    """Item ids, the numbers of their terms, and the numbering of terms, block by block."""
    ids, queries, vocabulary, size = [], [], {}, 0
    for r in items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).toLocalIterator():
        own = dict.fromkeys(terms((r["text"] or "").encode()))
        if ids and size + len(own) > BLOCK_TERMS:
            yield ids, queries, vocabulary
            ids, queries, vocabulary, size = [], [], {}, 0
        ids.append(r["id"])
        queries.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in own], np.int64))
        size += len(own)
    if vocabulary:
        yield ids, queries, vocabulary


def _counts(rows: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """N, L and the df of each numbered term. What comes to the driver is a row for each of them."""
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2, np.int64)
        for b in units(batches):
            for t in b.column("text").cast(pa.binary()):
                words = terms(t.as_py())
                total[size] += bool(words)
                total[size + 1] += len(words)
                for w in set(words):
                    i = vocabulary.get(w)
                    if i is not None:
                        total[i] += 1
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["k", "n"])

    out = np.zeros(size + 2, np.int64)
    for r in rows.select("text").mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["k"]] = r["n"]
    return int(out[size]), int(out[size + 1]), out[:size]


def _best(rows: DataFrame, kind: str, queries: list[np.ndarray], vocabulary: dict[bytes, int], counts: tuple[int, int, np.ndarray], top: int) -> DataFrame:
    """q, doc_id, score: the best documents of each query, from every task."""
    n_docs, n_terms, df = counts
    weights = np.array([weight(n_docs, n) for n in df.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in queries]
        id_type = None
        for b in units(batches):
            id_type = b.column("id").type
            shard = Postings((t.as_py() for t in b.column("text").cast(pa.binary())), vocabulary, weights, n_docs, n_terms)
            ids = b.column("id").to_pylist()
            for q, query in enumerate(queries):
                best = held[q]
                found, score = shard.qualifying(query, best[-1][0] if len(best) == top else 1)
                if len(found):
                    best += [(s, ids[d]) for d, s in zip(found.tolist(), score.tolist())]
                    best.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
                    del best[top:]
        if id_type is not None:
            flat = [(q, i, s) for q, best in enumerate(held) for s, i in best]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int64()), pa.array([f[1] for f in flat], id_type), pa.array([f[2] for f in flat], pa.int64())], names=["q", "doc_id", "score"])

    return rows.mapInArrow(run, f"q bigint, doc_id {kind}, score bigint")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the documents of each item's `top` highest scores above 0."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    item_kind = items.schema[item_col].dataType.simpleString()
    schema = f"item_id {item_kind}, rank int, doc_id {kind}, score bigint"
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = []
    for ids, queries, vocabulary in _blocks(items, item_col, item_text_col):
        best = _best(rows, kind, queries, vocabulary, _counts(rows, vocabulary), top)
        some = best.withColumn("part", F.spark_partition_id() % PARTS).withColumn("rank", F.row_number().over(Window.partitionBy("q", "part").orderBy(*order))).where(F.col("rank") <= top)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= top)
        named = spark.createDataFrame(list(enumerate(ids)), f"q bigint, item_id {item_kind}")  # a block's items
        parts.append(materialize(ranked.join(F.broadcast(named), "q").select("item_id", "rank", "doc_id", "score"), "found"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


#: The same rows from SQL, over all terms of all documents.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), i AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t FROM benchmark
), g AS (
  SELECT count(*)::BIGINT AS nn, sum(len(ts))::BIGINT AS ll FROM d WHERE len(ts) > 0
), p AS (
  SELECT doc_id, len(ts)::BIGINT AS n, unnest(ts) AS t FROM d
), f AS (
  SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM p WHERE t IN (SELECT t FROM i) GROUP BY ALL
), w AS (
  SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, g GROUP BY t, nn
), s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT AS score FROM f, g, w, i WHERE f.t = w.t AND f.t = i.t GROUP BY ALL
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
"""
