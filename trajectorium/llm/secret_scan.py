"""Secret scans with corpus-wide ownership frequency.

Each text is scanned for three fixed kinds of secrets (assignments, access
keys, long hexadecimal strings) and for candidates: other long mixed strings
that look random, signed tokens of three parts, passwords in addresses of servers,
blocks of private keys. Every value, hashed, is counted over the whole corpus: in
how many distinct repositories each of its distinct owners has it. A credential
belongs to one owner, in however many of its repositories; a leak or a fork
elsewhere doesn't make it an example. An example is spread over owners. So a value
is owner-specific and live-looking if one owner has SHARE of all its repositories
at least, else it is a copied example, also where several owners have copies of
one text. Live-looking candidates are added as spans of kind `live`; spans of the
fixed kinds always stay.

A repository is named by a column, and counts once for each owner of a value.
Where no column names it, texts stand for it: equal texts, as in forks and
mirrors, are one.

Null and empty texts have no spans; null owners and repositories count as one
each. Texts are scanned whole, very long ones too. Repeated rows repeat their
result and count as one repository. At one start, spans go by kind. An empty
table gives an empty one; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship
from .common import free_names, strings, units

#: Kinds in order, and their patterns.
KINDS = ("assign", "access", "hex", "live")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Candidates by their form; of a server's address the password is the value. Parts without bound are of few characters that end them.
_FORMS = (
    ("eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("://", re.compile(r"(?<=://)[A-Za-z0-9._-]{1,64}:([^\s:/@]{6,128})@")),
    ("PRIVATE KEY-----", re.compile(r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]{32,}?-----END [A-Z ]{0,32}PRIVATE KEY-----")),
)

#: Bits per character that a candidate needs.
ENTROPY = 3.2
#: The part of a value's repositories that one owner has, from which the value is that owner's.
SHARE = 0.8

Span = tuple[str, int, int]


def base_spans(text: str) -> tuple[list[Span], list[str]]:
    """Spans of the fixed kinds, by start and then kind, and each one's secret value."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    found.sort()
    return [(KINDS[k], s, e) for s, k, e, _ in found], [v for *_, v in found]


def looks_random(value: str) -> bool:
    """Letters and digits in turn, as of a key, and enough bits per character."""
    if not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in map(value.count, set(value))) >= ENTROPY


def candidate_spans(text: str) -> tuple[list[Span], list[str]]:
    """Candidates by start; of those that overlap, the form's counts, not the mixed string."""
    found = []
    for mark, form in _FORMS:
        if mark in text:
            group = 1 if form.groups else 0
            found += [(m.start(group), m.end(group), m[group]) for m in form.finditer(text)]
    formed = list(found)
    found += [(m.start(), m.end(), m[0]) for m in _CANDIDATE.finditer(text) if looks_random(m[0]) and not any(m.start() < e and s < m.end() for s, e, _ in formed)]
    found.sort()
    return [("live", s, e) for s, e, _ in found], [v for *_, v in found]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """One narrow row per document, as a table in the shared folder: id, owner, repo, text_hash, base and more (arrays of kind, start, end, hash)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"), (F.col(repo_col).cast("string") if repo_col else F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("string")).alias("repo"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.int8()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.int64())]))

    def hashed(value: str) -> int:
        return int(np.uint64(xxhash.xxh3_64_intdigest(value.encode())).astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in units(batches):
            base, more, sha, text_hash = [], [], [], []
            for t in strings(b.column("text")):
                spans, values = base_spans(t)
                base.append([{"kind": KINDS.index(k), "start": s, "end": e, "hash": hashed(v)} for (k, s, e), v in zip(spans, values)])
                sha.append(hashlib.sha256(written(spans).encode()).hexdigest())
                own, others = candidate_spans(t)
                more.append([{"kind": 3, "start": s, "end": e, "hash": hashed(v)} for (_, s, e), v in zip(own, others) if not any(s < y and x < e for _, x, y in spans)])
                text_hash.append(int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64)))  # as Spark's xxhash64
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("owner"), b.column("repo"), pa.array(text_hash, pa.int64()), pa.array(sha), pa.array(base, span), pa.array(more, span)],
                names=["id", "owner", "repo", "text_hash", "base_sha256", "base", "more"],
            )

    item = "array<struct<kind:tinyint,start:bigint,end:bigint,hash:bigint>>"
    out = rows.mapInArrow(run, f"id {kind}, owner string, repo string, text_hash bigint, base_sha256 string, base {item}, more {item}")
    return materialize(out, "secrets")


def frequencies(found: DataFrame) -> DataFrame:
    """hash, owners, repositories (pairs of an owner and a repository of it, nulls among them, that have the value), most (those of one owner). Rows are made distinct and summed before each exchange, and the first keys hold the repository, then the owner, so no value's rows meet in one task."""
    each = found.select("owner", "repo", F.explode(F.concat("base", "more")).alias("s")).select("owner", "repo", F.col("s.hash").alias("hash")).distinct()
    per = each.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return per.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"), F.max("n").alias("most"))


def _judged(docs: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """What ownership_scan() returns, with the id as `id` and text_hash."""
    found = scan(docs, id_col, text_col, owner_col, repo_col)
    live = frequencies(found).where(F.col("most") >= share * F.col("repositories")).select("hash", F.lit(True).alias("live"))
    # documents equal in id and text have equal values; a live value can have many rows, so the join is one that splits skewed keys
    key = ["id", "text_hash"]
    values = found.select("id", "text_hash", F.explode(F.concat("base", "more")).alias("s")).select(*key, F.col("s.hash").alias("hash")).distinct()
    of = values.join(live, "hash", "left_semi").groupBy(*key).agg(F.collect_set("hash").alias("live"))
    a, b = found.alias("a"), of.alias("b")
    both = a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.text_hash") == F.col("b.text_hash")), "left")
    both = both.select("a.id", "a.text_hash", "base_sha256", "base", "more", F.coalesce("live", F.array().cast("array<bigint>")).alias("live"))
    is_live = lambda x: F.array_contains("live", x["hash"])
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_sort(F.transform(F.concat("base", F.filter("more", is_live)), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    text = F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    every = F.concat("base", "more")
    n_live = F.size(F.filter(every, is_live))
    return both.select(
        "id", "text_hash", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "base_sha256", text.alias("spans"), n_live.cast("long").alias("n_live"), (F.size(every) - n_live).cast("long").alias("n_copied")
    )


def ownership_scan(docs: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """id_col, n_assign, n_access, n_hex, base_sha256, spans, n_live (values in the text that are owner-specific), n_copied (others)."""
    return _judged(docs, share, id_col, text_col, owner_col, repo_col).drop("text_hash").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, share: float = SHARE, mark: str = "[SECRET]") -> DataFrame:
    """docs with the same columns, each span replaced by the mark (overlapping ones by one), n_chars counted anew where a text changes."""
    id_, hash_, spans_, masked_ = free_names(docs, "_id", "_hash", "_spans", "_masked")
    spans = _judged(docs, share).where("spans <> ''").select(F.col("id").alias(id_), F.col("text_hash").alias(hash_), F.col("spans").alias(spans_)).distinct()
    spans = materialize(spans, "spans")  # few, as few texts have secrets: their size is known when the join is planned
    text = F.col("text").cast("string")
    both = docs.join(spans, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(hash_)), "left")
    place = lambda x, k: F.get(F.split(x, ":"), F.lit(k)).cast("int")
    cuts = F.array_sort(F.transform(F.split(spans_, ","), lambda x: F.struct(place(x, 1).alias("start"), place(x, 2).alias("end"))))

    def step(acc: F.Column, s: F.Column) -> F.Column:
        gap = F.when(s["start"] > acc["done"], F.substr(text, acc["done"] + 1, s["start"] - acc["done"])).otherwise("")
        fresh = F.concat(acc["out"], gap, F.when(s["start"] >= acc["done"], F.lit(mark)).otherwise(""))
        return F.when(s["end"] > acc["done"], F.struct(fresh.alias("out"), s["end"].alias("done"))).otherwise(acc)

    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("done"))
    masked = F.aggregate(cuts, begin, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["done"] + 1)))
    done = both.withColumn(masked_, F.when(F.col(spans_).isNotNull(), masked).otherwise(text))
    new = {"text": F.col(masked_)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(spans_).isNotNull(), F.length(masked_).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])
