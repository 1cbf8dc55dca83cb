"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in segments, once forward and once
backward, labels every position, and the mean of the positions' probabilities is
the document's. It is trained in numpy by backpropagation through time on at most
`windows` short windows of labelled training documents, a bounded sample chosen
by hash; prediction covers whole texts. Gates use x / (1 + |x|) in place of the
hyperbolic tangent.

A null text, or one without a letter, is `und` with score 0. A null lang or
doc_id keeps a document out of training only. Ties go to the first language in
alphabetical order. If no document can be learned from, all are `und`. Repeated
rows repeat their result; an empty table gives an empty one; other columns are
left alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import units

WINDOWS = 4000
HIDDEN = 8
SEGMENT = 96
#: Byte value of places after a segment's end.
PAD = 256
UND = "und"
_LETTER = regex.compile(r"\p{L}")


class Network:
    """Weights by name: E (embedding of bytes as gate inputs), U (recurrent), c (of the candidate), V (output), for each direction, and the output's bias."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.w: dict[str, np.ndarray] = {"b": np.zeros(len(labels))}
        for d in "fb":
            self.w["E" + d] = draw.normal(0, 0.5, (PAD + 1, 3 * hidden))
            self.w["U" + d] = draw.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
            self.w["c" + d] = np.zeros(hidden)
            self.w["V" + d] = draw.normal(0, 1 / np.sqrt(hidden), (hidden, len(labels)))

    # training, in double precision

    def loss(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Cross-entropy over all positions of full segments x (length, batch) with labels y, and its gradient."""
        n, m = x.shape
        h_ = self.hidden
        kept, logits = {}, np.zeros((n, m, len(self.labels))) + self.w["b"]
        for d in "fb":
            e, u, c = (self.w[k + d] for k in "EUc")
            steps = range(n) if d == "f" else range(n - 1, -1, -1)
            h, held = np.zeros((m, h_)), {}
            for t in steps:
                gx, gh = e[x[t]], h @ u
                a = gx[:, : 2 * h_] + gh[:, : 2 * h_]
                gates = 0.5 + 0.5 * a / (1 + np.abs(a))
                r, z = gates[:, :h_], gates[:, h_:]
                inner = gh[:, 2 * h_ :] + c
                a = gx[:, 2 * h_ :] + r * inner
                new = a / (1 + np.abs(a))
                held[t] = (h, r, z, inner, new)
                h = new + z * (h - new)
                logits[t] += h @ self.w["V" + d]
                held[t] += (h,)
            kept[d] = held
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        at = np.broadcast_to(y, (n, m))
        total = weight.sum() * n
        loss = -(np.log(np.take_along_axis(p, at[..., None], 2)[..., 0] + 1e-12) * weight).sum() / total
        delta = p
        np.put_along_axis(delta, at[..., None], np.take_along_axis(delta, at[..., None], 2) - 1, 2)
        delta *= weight[:, None] / total
        grad = {"b": delta.sum((0, 1))}
        for d in "fb":
            u, v = self.w["U" + d], self.w["V" + d]
            du, dv, dc, dx = np.zeros_like(u), np.zeros_like(v), np.zeros(h_), np.zeros((n, m, 3 * h_))
            dh = np.zeros((m, h_))
            for t in range(n - 1, -1, -1) if d == "f" else range(n):
                h, r, z, inner, new, out = kept[d][t]
                dv += out.T @ delta[t]
                dh = dh + delta[t] @ v.T
                dn = dh * (1 - z) * (1 - np.abs(new)) ** 2
                dz = dh * (h - new) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                dr = dn * inner * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                dx[t] = np.concatenate((dr, dz, dn), 1)
                back = np.concatenate((dr, dz, dn * r), 1)
                dc += back[:, 2 * h_ :].sum(0)
                du += h.T @ back
                dh = dh * z + back @ u.T
            flat, where = dx.reshape(-1, 3 * h_), x.ravel()
            grad["E" + d] = np.stack([np.bincount(where, flat[:, k], PAD + 1) for k in range(3 * h_)], 1)
            grad["U" + d], grad["V" + d], grad["c" + d] = du, dv, dc
        return float(loss), grad

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 260, size: int = 160, rate: float = 0.03, seed: int = 11) -> None:
        """Adam over random batches of segments x (count, length); labels weigh alike."""
        draw = np.random.default_rng(seed)
        weight = (len(y) / np.maximum(1, np.bincount(y, minlength=len(self.labels))) / len(self.labels))[y]
        m1 = {k: np.zeros_like(v) for k, v in self.w.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, rounds + 1):
            pick = draw.choice(len(x), min(size, len(x)), replace=False)
            _, grad = self.loss(np.ascontiguousarray(x[pick].T), y[pick], weight[pick])
            scale = min(1.0, 1.0 / (np.sqrt(sum((g**2).sum() for g in grad.values())) + 1e-9))
            now = rate * (1 - 0.9 * step / rounds)
            for k, g in grad.items():
                g = g * scale
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                self.w[k] -= now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)

    # prediction, in single precision

    def positions(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Label probabilities of every position of segments x (length, batch), padded with PAD."""
        n, m = x.shape
        h_, k = self.hidden, len(self.labels)
        logits = np.empty((n, m, k), np.float32)
        logits[:] = self.w["b"]
        ragged = bool((lengths < n).any())
        g, q = np.empty((m, 3 * h_), np.float32), np.empty((m, 3 * h_), np.float32)
        out = np.empty((m, k), np.float32)
        for d in "fb":
            e, u, c, v = (np.ascontiguousarray(self.w[j + d], dtype=np.float32) for j in "EUcV")
            h, inner, a, b = (np.zeros((m, h_), np.float32) for _ in range(4))
            two, new = g[:, : 2 * h_], g[:, 2 * h_ :]
            for t in range(n) if d == "f" else range(n - 1, -1, -1):
                np.take(e, x[t], axis=0, out=g, mode="clip")
                np.matmul(h, u, out=q)
                np.add(q[:, 2 * h_ :], c, out=inner)
                two += q[:, : 2 * h_]
                np.abs(two, out=q[:, : 2 * h_])
                q[:, : 2 * h_] += 1
                two /= q[:, : 2 * h_]
                two *= 0.5
                two += 0.5
                np.multiply(g[:, :h_], inner, out=a)
                a += new
                np.abs(a, out=b)
                b += 1
                a /= b
                h -= a
                h *= g[:, h_ : 2 * h_]
                h += a
                if ragged:
                    h *= (t < lengths)[:, None]
                np.matmul(h, v, out=out)
                logits[t] += out
        logits -= logits.max(2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(2, keepdims=True)
        return logits

    def pooled(self, texts: list[bytes], segment: int = SEGMENT, group: int = 2048) -> np.ndarray:
        """The mean of each text's position probabilities; zeros for empty ones."""
        sizes = np.array([len(t) for t in texts], np.int64)
        pieces = -(-sizes // segment)
        owner = np.repeat(np.arange(len(texts)), pieces)
        start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * segment
        length = np.minimum(sizes[owner] - start, segment)
        start += np.repeat(np.cumsum(sizes) - sizes, pieces)
        data = np.frombuffer(b"".join(texts), np.uint8)
        out = np.zeros((len(texts), len(self.labels)))
        order = np.argsort(-length, kind="stable")
        for s in range(0, len(order), group):
            own = order[s : s + group]
            n = int(length[own[0]])
            at = start[own][None, :] + np.arange(n)[:, None]
            inside = np.arange(n)[:, None] < length[own][None, :]
            x = np.where(inside, data[np.minimum(at, len(data) - 1)], PAD).astype(np.intp)
            p = self.positions(x, length[own])
            if not inside.all():
                p *= inside[..., None]
            np.add.at(out, owner[own], p.sum(0, dtype=np.float64))
        return out / np.maximum(1, sizes)[:, None]


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, windows: int = WINDOWS, segment: int = SEGMENT, hidden: int = HIDDEN) -> Network:
    """A network fitted on the driver to at most `windows` windows of 2 * segment characters, as many of each language as there are, so that rare ones are learned too (one at least of each)."""
    able = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")) & (F.col("lang") != UND))
    h = F.xxhash64(F.col("doc_id").cast("string"))
    lang = F.col("lang").cast("string")
    count = {r["lang"]: r["n"] for r in able.groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).collect()}  # the network's labels
    each = max(1, windows // max(1, len(count)))
    # a share by hash that holds the wanted number many times over; rare languages whole
    shares = docs.sparkSession.createDataFrame([(k, min(1 << 20, (64 + 4 * each) * (1 << 20) // n)) for k, n in count.items()], "lang string, share bigint")
    text = F.col("text").cast("string")
    at = F.pmod(F.abs(h), F.greatest(F.length(text) - 2 * segment, F.lit(0)) + 1).cast("int") + 1
    some = able.select(lang.alias("lang"), F.substr(text, at, F.lit(2 * segment)).alias("w"), h.alias("h")).join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "w"))
    rows = some.withColumn("rank", rank).where(F.col("rank") <= each).orderBy("h", "lang", "w").collect()
    labels = sorted({r["lang"] for r in rows})
    x, y = [], []
    for r in rows:
        b = r["w"].encode()
        while len(b) >= 16:  # short windows repeat until they fill a segment
            part, b = b[:segment], b[segment:]
            x.append((part * (segment // len(part) + 1))[:segment])
            y.append(labels.index(r["lang"]))
    net = Network(labels, hidden)
    if len(labels) > 1 and x:
        net.fit(np.frombuffer(b"".join(x), np.uint8).reshape(-1, segment).astype(np.intp), np.array(y))
    return net


@lru_cache(maxsize=2)
def _network(held: bytes) -> Network:
    return pickle.loads(held)  # made by this process's own driver


def predict(docs: DataFrame, net: Network, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs' columns, text among them, and the language and score under names that docs doesn't have."""
    ship(docs.sparkSession)
    held = pickle.dumps(net)
    schema = docs.withColumns({names[0]: F.lit("").cast("string"), names[1]: F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _network(held)
        for b in units(batches):
            column = pc.fill_null(b.column("text").cast(pa.string()), "")
            texts = column.to_pylist()
            p = own.pooled([t.encode() for t in texts]) if own.labels else np.zeros((len(texts), 1))
            best = p.argmax(1)
            known = np.array([bool(own.labels) and _LETTER.search(t) is not None for t in texts], bool)
            said = [own.labels[k] if ok else UND for k, ok in zip(best.tolist(), known.tolist())]
            score = np.clip(np.where(known, p.max(1, initial=0), 0.0), 0, 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, windows: int = WINDOWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    net = train(docs, windows)
    return predict(docs.select("doc_id", F.col("text").cast("string").alias("text")), net).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
