"""Language-model scores from the marginal likelihood of subword lattices.

A word's lattice has an arc for every piece of a given vocabulary that matches
somewhere in it, and one arc for the whole word if it was met in training. A
forward recursion in log space adds the weights of all paths, so the score is the
probability of the text over all segmentations, not of the best one.

A document is of one of several components, the languages of training documents:
in each, words have counts of their own, whose discounts leave weight to the
lattice of all training words. Components are summed out too, by their shares.

Pieces start with the weights that the vocabulary's own scores give (a byte-pair
model's scores are merge ranks: weights fall as 1 over rank) and are fitted by
expectation-maximisation over all distinct training words; its backward pass
shares a word's weight out among the arcs. A first piece, and a further piece or
the word's end, are two distributions. A whole-word arc has the word's training
count less an absolute discount, and what the discounts leave is the weight of
the pieces, so all texts together have probability 1.

Counts are gathered over all training documents as a table of words that grows
with the corpus. Words of the highest counts, FREQUENT at most, are sent to the tasks (a
bounded table); all others occur about N / FREQUENT times at most, so the join
with their table has no hot key.

Null and empty texts and those without a word are an end alone; texts and words of
any length are scored whole, in windows of WINDOW places. A null doc_id isn't held
out, nor learned from. Words of equal counts are looked up at one place, and which
it is doesn't change what they add. Repeated rows count and are scored each, an
empty table gives an empty one, other columns are left alone whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize, ship
from .common import units

#: Rounds of expectation-maximisation, and the weight in words of the vocabulary's own scores in each.
ROUNDS, PRIOR = 4, 1000.0
#: Languages that are components of their own.
COMPONENTS = 8
#: Most words that are sent to every task, and the longest one, in bytes, that isn't sent as a hash.
FREQUENT, LONGEST = 150_000, 64
#: Places of each word that are matched at a time, and bytes of words in a batch.
WINDOW, BATCH = 4096, 256 << 10
#: The symbol in front of every word.
START = 256
_MARK = "▁"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def vocabulary(path: str) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """A sentencepiece model's pieces as symbols and their weights. Each byte is a piece too; pieces that no lower-cased word holds are left out."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weights: dict[tuple[int, ...], float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        body = piece.removeprefix(_MARK).encode()
        if _MARK.encode() in body or body != body.lower() or len(body.split()) != bool(body):
            continue
        symbols = ((START,) if piece.startswith(_MARK) else ()) + tuple(body)
        weights[symbols] = 1 / (10 - model.get_score(i))
    least = min(weights.values(), default=1.0)
    for symbols in ((START,), *((b,) for b in range(256))):
        weights.setdefault(symbols, least)
    return list(weights), np.array(list(weights.values()))


class Lattice:
    """Pieces with log weights, in a trie of tables, over batches of words."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        children: list[dict[int, int]] = [{}]
        piece_of = [-1]
        for k, symbols in enumerate(pieces):
            node = 0
            for s in symbols:
                nxt = children[node].get(s)
                if nxt is None:
                    nxt = children[node][s] = len(children)
                    children.append({})
                    piece_of.append(-1)
                node = nxt
            piece_of[node] = k
        self.piece_of = np.array(piece_of, np.int32)
        inner = [n for n, c in enumerate(children) if c]
        self.row_of = np.full(len(children), -1, np.int32)
        self.row_of[inner] = np.arange(len(inner))
        self.next = np.full((len(inner), 257), -1, np.int32)
        for r, n in enumerate(inner):
            for s, child in children[n].items():
                self.next[r, s] = child
        self.first = np.array([p[0] == START for p in pieces])

    def weights(self, counts: np.ndarray, ends: float) -> tuple[np.ndarray, float]:
        """Natural logs of pieces' weights and of a word's end: first pieces are one distribution, further pieces and the end another. Empty words take none of it."""
        w = np.where(self.first, counts / counts[self.first].sum(), counts / (counts[~self.first].sum() + ends))
        end = ends / (counts[~self.first].sum() + ends)
        empty = w[self.piece_of[self.next[0, START]]] * end
        return np.log(w), math.log(end) - math.log1p(-empty)

    def _arcs(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, lo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Arcs that start at places lo up to lo + WINDOW of the words, by place: the nodes where they start and end, their pieces, and the bounds of each place's arcs. A word's nodes are its symbols and its end."""
        here = np.clip(sizes - lo, 0, WINDOW)
        word = np.repeat(np.arange(len(sizes)), here)
        place = lo + np.arange(len(word)) - np.repeat(np.cumsum(here) - here, here)
        at, last = begins[word] + place, (begins + sizes)[word]
        found = []
        node, alive, depth = np.zeros(len(at), np.int32), np.arange(len(at)), 0
        while len(alive):
            node = self.next[self.row_of[node], data[at[alive] + depth]]
            ok = node >= 0
            node, alive = node[ok], alive[ok]
            depth += 1
            piece = self.piece_of[node]
            hit = piece >= 0
            found.append((alive[hit], piece[hit], np.full(int(hit.sum()), depth, np.int32)))
            more = (self.row_of[node] >= 0) & (at[alive] + depth < last[alive])
            node, alive = node[more], alive[more]
        own, piece, length = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        by = np.argsort((place[own] - lo).astype(np.int16), kind="stable")
        own, piece, length = own[by], piece[by], length[by]
        start = at[own] + word[own]
        bounds = np.searchsorted(place[own], np.arange(lo, lo + WINDOW + 1))
        return start, start + length, piece, bounds

    def run(self, words: list[bytes], log_weight: np.ndarray, log_end: float, expected: np.ndarray | None = None) -> np.ndarray:
        """Natural log of each word's marginal weight. If `expected` is given, each word's unit weight is shared out among its pieces and added there."""
        if not words:
            return np.zeros(0)
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        begins = np.cumsum(sizes) - sizes
        data = np.zeros(int(sizes.sum()), np.int16)
        inner = np.ones(len(data), bool)
        inner[begins] = False
        data[begins] = START
        data[inner] = np.frombuffer(b"".join(words), np.uint8)
        number = np.arange(len(words))
        first, final = begins + number, begins + sizes + number
        alpha = np.full(len(data) + len(words), -np.inf)
        alpha[first] = 0.0
        longest = int(sizes.max())
        windows = range(0, longest, WINDOW)
        arcs = None
        for lo in windows:
            arcs = start, end, piece, bounds = self._arcs(data, begins, sizes, lo)
            w = log_weight[piece]
            for k in range(min(WINDOW, longest - lo)):
                s = slice(bounds[k], bounds[k + 1])  # of one place: every end is another node
                alpha[end[s]] = np.logaddexp(alpha[end[s]], alpha[start[s]] + w[s])
        if expected is not None:
            share = np.zeros(len(alpha))
            share[final] = 1.0
            for lo in reversed(windows):
                start, end, piece, bounds = arcs if len(windows) == 1 else self._arcs(data, begins, sizes, lo)
                part = np.exp(alpha[start] + log_weight[piece] - alpha[end])
                for k in reversed(range(min(WINDOW, longest - lo))):
                    s = slice(bounds[k], bounds[k + 1])
                    part[s] *= share[end[s]]
                    np.add.at(share, start[s], part[s])
                expected += np.bincount(piece, part, len(expected))
        return alpha[final] + log_end


@lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[Lattice, np.ndarray]:
    pieces, weights = vocabulary(path)
    return Lattice(pieces), weights


def _batches(words: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of words of about BATCH bytes, one word at least."""
    part, size = [], 0
    for w in words:
        if part and size + len(w) > BATCH:
            yield part
            part, size = [], 0
        part.append(w)
        size += len(w) + 1
    if part:
        yield part


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.lower().split()


def key_of(word: bytes) -> bytes:
    """What a word is looked up by: itself, or a blank, which no word holds, and a hash."""
    return word if len(word) <= LONGEST else b" " + hashlib.sha256(word).hexdigest().encode()


def _components(docs: DataFrame) -> list[str | None]:
    """The languages of most training documents, up to COMPONENTS; all other documents, if there are any, are one more component, None."""
    by = docs.where("learn").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(COMPONENTS + 1).collect()
    own = [r["lang"] for r in by if r["lang"] is not None][:COMPONENTS]
    return [*own, None] if len(by) > len(own) or not own else own


def _count(docs: DataFrame, langs: list[str | None]) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """word (bytes) and its counts c0, c1, ... in the training documents of each component, of all documents' words; documents, words and distinct words of each component."""
    columns = [f"c{k}" for k in range(len(langs))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in units(batches, most=8 << 20):
            learned, words = [Counter() for _ in langs], set()
            for t, learn, k in zip(b.column("text").cast(pa.binary()), b.column("learn").to_pylist(), b.column("k").to_pylist()):
                if learn:
                    learned[k].update(tokens(t.as_py()))
                else:
                    words.update(tokens(t.as_py()))
            words = list(words.union(*learned))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *(pa.array([c[w] for w in words], pa.int64()) for c in learned)], names=["word", *columns])

    k = F.lit(len(langs) - 1)
    for n, lang in enumerate(langs):
        if lang is not None:
            k = F.when(F.col("lang") == lang, n).otherwise(k)
    rows = docs.select("text", "learn", k.alias("k"))
    words = rows.mapInArrow(run, "word binary, " + ", ".join(f"{c} bigint" for c in columns))
    words = materialize(words.groupBy("word").agg(*(F.sum(c).alias(c) for c in columns)).withColumn("c", sum((F.col(c) for c in columns), F.lit(0))), "words")
    ends = np.zeros(len(langs), np.int64)
    for r in rows.where("learn").groupBy("k").count().collect():  # a row for each component
        ends[r["k"]] = r["count"]
    got = words.agg(*(F.sum(c) for c in columns), *(F.count_if(F.col(c) > 0) for c in columns)).first()
    numbers = np.array([x or 0 for x in got], np.int64).reshape(2, -1)
    return words, ends, numbers[0], numbers[1]


def fit(words: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Expected counts of the pieces over distinct words, by expectation-maximisation; then of the words' ends. A round sends a number for each piece to the driver."""
    pieces, own = vocabulary(path)
    first = np.array([p[0] == START for p in pieces])
    # the vocabulary's own scores as counts: as many first pieces as words, and as many ends as further pieces
    prior = PRIOR * np.where(first, own / own[first].sum(), own / own[~first].sum())
    counts = np.append(prior, PRIOR)
    learned = words.where("c > 0").select("word")
    for _ in range(rounds):
        now = counts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, _ = _pieces(path)
            log_weight, log_end = lattice.weights(now[:-1], now[-1])
            expected, n = np.zeros(len(log_weight)), 0
            for b in units(batches, "word", 1 << 20):
                for part in _batches(b.column("word").to_pylist()):
                    lattice.run(part, log_weight, log_end, expected)
                    n += len(part)
            out = np.append(expected, float(n))
            held = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(out[held])], names=["k", "x"])

        counts = np.append(prior, PRIOR)
        for r in learned.mapInArrow(run, "k bigint, x double").groupBy("k").agg(F.sum("x").alias("x")).toLocalIterator():
            counts[r["k"]] += r["x"]
    return counts


def discount(words: DataFrame) -> float:
    """Of the counts of words met once and twice; in the middle if these say nothing."""
    r = words.agg(F.count_if(F.col("c") == 1).alias("one"), F.count_if(F.col("c") == 2).alias("two")).first()
    return min(0.95, max(0.05, r["one"] / (r["one"] + 2 * r["two"]))) if r["one"] else 0.5


class Scores:
    """What training counts say of a word, as log10: the base model's, and that of each component, whose discounts leave weight to the words of all, and theirs to the pieces' marginal weight."""

    def __init__(self, words: int, distinct: int, d: float, ends: np.ndarray, own_words: np.ndarray, own_distinct: np.ndarray):
        self.n, self.v = words + int(ends.sum()), distinct + bool(ends.any())
        self.words, self.distinct, self.d, self.ends = words, distinct, d, ends
        self.own = own_words + ends
        self.own_distinct = own_distinct + (ends > 0)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))

    def _discounted(self, c: np.ndarray, n) -> np.ndarray:
        return np.maximum(c - self.d, 0) / np.maximum(1, n)

    def model(self, own: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """own: counts, a column for each component."""
        spare = math.log(self.d * self.distinct / self.words) if self.words else 0.0
        with np.errstate(divide="ignore"):
            shared = np.logaddexp(np.log(self._discounted(own.sum(1), self.words)), pieces + spare)
            left = np.log(np.where(self.own > 0, self.d * self.own_distinct / np.maximum(1, self.own), 0.5))
            return np.logaddexp(np.log(self._discounted(own, self.own)), shared[:, None] + left) / math.log(10)

    def end(self) -> tuple[float, np.ndarray]:
        return float(self.base(np.array(float(self.ends.sum())))), np.log10(np.where(self.own > 0, self._discounted(self.ends, self.own), 0.5))

    def share(self) -> np.ndarray:
        """log10 of the components' shares of documents."""
        n = self.ends.sum()
        return np.log10(np.where(n > 0, (self.ends + 0.5) / (n + 0.5 * len(self.ends)), 1 / len(self.ends)))


def _score_words(words: DataFrame, path: str, counts: np.ndarray, scores: Scores) -> DataFrame:
    """key, c, base, and m0, m1, ... of every word."""
    k = len(scores.ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, _ = _pieces(path)
        log_weight, log_end = lattice.weights(counts[:-1], counts[-1])
        for b in units(batches, "word", 1 << 20):
            words = b.column("word").to_pylist()
            marginal = np.concatenate([lattice.run(part, log_weight, log_end) for part in _batches(words)])
            own = np.stack([b.column(f"c{x}").to_numpy() for x in range(k)], 1)
            yield pa.RecordBatch.from_arrays([pa.array([key_of(w) for w in words], pa.binary()), b.column("c"), pa.array(scores.base(own.sum(1))), *(pa.array(m) for m in scores.model(own, marginal).T)], names=["key", "c", "base", *(f"m{x}" for x in range(k))])

    return words.mapInArrow(run, "key binary, c bigint, base double, " + ", ".join(f"m{x} double" for x in range(k)))


@lru_cache(maxsize=2)
def _table(held: bytes) -> tuple[dict[bytes, int], np.ndarray]:
    keys, values = pickle.loads(held)  # made by this process's own driver
    return {w: k for k, w in enumerate(keys)}, values


def _first_sums(docs: DataFrame, frequent: bytes, scores: Scores) -> DataFrame:
    """Each row's sums over its end and its frequent words, and its other words with their counts."""
    n_sums = 2 + len(scores.ends)
    names = ["n_known", "base", *(f"m{x}" for x in range(len(scores.ends)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, values = _table(frequent)
        end_base, end_model = scores.end()
        for b in units(batches):
            n, rest, times, doc, at, tf = [], [], [], [], [], []
            for d, t in enumerate(b.column("text").cast(pa.binary())):
                words = tokens(t.as_py())
                n.append(len(words) + 1)
                rest.append([])
                times.append([])
                for w, c in Counter(words).items():
                    key = key_of(w)
                    k = table.get(key)
                    if k is None:
                        rest[-1].append(key)
                        times[-1].append(c)
                    else:
                        doc.append(d)
                        at.append(k)
                        tf.append(c)
            doc, at, tf = np.array(doc, np.int64), np.array(at, np.int64), np.array(tf, np.float64)
            sums = [np.bincount(doc, tf * values[x, at], b.num_rows) + e for x, e in zip(range(n_sums), (float(scores.ends.any()), end_base, *end_model))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(n, pa.int64()), pa.array(rest, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64())), pa.array(sums[0].astype(np.int64)), *(pa.array(x) for x in sums[1:])], names=["doc_id", "held_out", "n_tokens", "rest", "times", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    doubles = ", ".join(f"{x} double" for x in names[1:])
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, rest array<binary>, times array<bigint>, n_known bigint, {doubles}")


def _frequent(table: DataFrame, most: int) -> DataFrame:
    """The words of the highest counts, `most` at most: those above an edge that a histogram of counts (64 cells to a doubling) gives. Any other word has less than about N / most occurrences."""
    level = F.floor(F.log2("c") * 64)
    cells = table.where("c > 0").groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    edge, n = None, 0
    for r in cells:
        n += r["count"]
        if n > most:
            break
        edge = r["level"]
    return table.where((F.col("c") > 0) & (level >= edge)) if edge is not None else table.limit(0)


def score(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of each text. lang_col is read of training documents only."""
    ship(docs.sparkSession)
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    learn = F.col(id_col).isNotNull() & ~held_out(F.col(id_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held_out(F.col(id_col)).alias("held_out"), learn.alias("learn"), F.when(learn, lang).alias("lang"))
    words, ends, own_words, own_distinct = _count(rows, _components(rows))
    counts = fit(words, path, rounds)
    scores = Scores(int(own_words.sum()), words.where("c > 0").count(), discount(words), ends, own_words, own_distinct)
    table = materialize(_score_words(words, path, counts, scores), "scored")
    discard(words)
    top = _frequent(table, frequent).toPandas()
    models = [f"m{x}" for x in range(len(ends))]
    held = pickle.dumps(([bytes(k) for k in top["key"]], np.stack([top["c"] > 0, *(top[x] for x in ("base", *models))]).astype(np.float64)))
    sums = materialize(_first_sums(rows, held, scores).withColumn("row", F.monotonically_increasing_id()), "sums")
    pairs = sums.select("row", F.explode(F.arrays_zip(F.col("rest").alias("key"), F.col("times").alias("tf"))).alias("p")).select("row", "p.key", "p.tf")
    known = F.when(F.col("c") > 0, F.col("tf")).otherwise(0)
    rest = pairs.join(table, "key").groupBy("row").agg(F.sum(known).alias("k"), *(F.sum(F.col("tf") * F.col(x)).alias(f"r_{x}") for x in ("base", *models)))
    both = sums.drop("rest", "times").join(rest, "row", "left")
    whole = {x: F.col(x) + F.coalesce(F.col(f"r_{x}"), F.lit(0.0)) for x in ("base", *models)}
    parts = [whole[x] + F.lit(float(p)) for x, p in zip(models, scores.share())]
    most = F.greatest(*parts) if len(parts) > 1 else parts[0]
    total = most + F.log10(sum((F.pow(F.lit(10.0), p - most) for p in parts), F.lit(0.0)))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(scores.n).cast("long").alias("train_tokens"), whole["base"].alias("base_score"), total.alias("score"))
