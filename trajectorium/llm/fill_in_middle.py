"""Fill-in-middle transformation by a two-pass streaming matcher of constant memory.

A text's units are matches of UNIT, left to right. The first pass only counts
them; two keyed draws of a rank follow from the count; the second pass advances
a lazy iterator of matches to the smaller and then to the larger rank and takes
the two byte offsets there. No array of units is ever kept, so a text of any
length takes its own bytes and two numbers.

Null and empty texts have no unit and stay plain. Texts with a marker string stay
plain, so a marker in an output is always one of ours and the text can be rebuilt.
Texts are taken whole. Rows are independent: repeated rows repeat their result
(their draws depend on doc_id alone), a null doc_id is drawn for as the empty
string, no ties can arise, an empty table gives an empty one, other columns are
left alone whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import units

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "42"
#: Of 100 texts, so many are transformed, and of 100 of those, so many have the suffix first.
SHARE, SUFFIX_FIRST = 50, 80
#: White space with the word after it, or white space that no word follows; on UTF-8, whose other bytes are parts of words.
UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_MARKER = re.compile(b"|".join(re.escape(m.encode()) for m in (PREFIX, SUFFIX, MIDDLE)))
SCHEMA = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def draws(doc_id: str, seed: str = SEED) -> list[int]:
    """Four keyed numbers of 32 bits."""
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


def cuts(text: bytes, first: int, second: int) -> tuple[int, int]:
    """The byte offsets behind `first` and behind `second` units, first <= second, from one iterator of matches that is never kept."""
    matches = UNIT.finditer(text)
    ends = []
    at, passed = 0, 0
    for rank in (first, second):
        if rank > passed:
            at = next(islice(matches, rank - passed - 1, None)).end()
            passed = rank
        ends.append(at)
    return ends[0], ends[1]


def transform_one(doc_id: str, text: bytes, seed: str = SEED, share: int = SHARE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars, output of one text."""
    n = sum(1 for _ in UNIT.finditer(text))
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= share or _MARKER.search(text):
        return n, "plain", None, None, text
    a, b = cuts(text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    spm = h4 % 100 < suffix_first
    out = b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))
    return n, "spm" if spm else "psm", len(prefix.decode()), len(middle.decode()), out


def fill_in_middle(docs: DataFrame, seed: str = SEED, share: int = SHARE, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n, form (plain, psm, spm), prefix_chars, middle_chars (code points, null if plain), output."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in units(batches):
            texts = b.column("text").cast(pa.binary())
            made = [transform_one(k.as_py(), t.as_py(), seed, share, suffix_first) for k, t in zip(b.column("key"), texts)]
            columns = [pa.array(c, f.type) if f.name != "output" else pa.array(c, pa.binary()).cast(pa.string()) for c, f in zip(zip(*made), schema)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns], names=["id", *schema.names])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The exact text, from output and form alone: no marker string is part of a text, and none can overlap another."""

    def before(c: Column, marker: str) -> Column:
        return F.substring_index(c, marker, 1)

    def after(c: Column, marker: str) -> Column:
        return F.substr(c, F.locate(marker, c) + len(marker))

    def joined(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        tail = after(rest, second)
        return before(rest, second), before(tail, MIDDLE), after(tail, MIDDLE)

    p, s, m = joined(PREFIX, SUFFIX)
    s2, p2, m2 = joined(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = fill_in_middle(docs)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


#: The same rows from SQL, in which the units of a text are an array.
SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us, sha256('42:' || doc_id) AS h
  FROM documents
), d AS (
  SELECT doc_id, t, us, len(us) AS n, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS hs FROM u
), c AS (
  SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 50 THEN 'plain' WHEN hs[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT doc_id, t, n, form, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:n], '') AS suf FROM c
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
