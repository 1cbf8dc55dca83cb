import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from trajectorium.llm import fill_in_middle, lattice_lm, lexical_search, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n int, form string, output string, id string, key string, row int, c0 int, m0 int, q int, score int"
ODD = ["", "   ", "\n", " a  b\n\n c\t d", "has <S> in it", "ends with <", "<P", "é日本 x😀  ", "a\x85b\x1cc d", "\x00 nul\x00x", "w" * 5000 + " " + "ab" * 3000, "İstanbul ΣΑΣ ÀÉ", "▁under ▁ a▁b", "one"]


@pytest.fixture(scope="module")
def docs(spark):
    """Real rows, odd texts, null texts, ids and languages, repeated rows and ids, a very long text, columns of names that operators use."""
    real = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    odd = [(10_000 + k, t, None if k % 2 else "en", None) for k, t in enumerate(ODD * 4)]
    rows = [*real, *odd, (20_000, None, "en", "s"), (None, "a row without an id", "en", "s"), real[0], real[0], (real[3][0], "the same id, another text", "xx", "s"), (20_001, real[1][1] * 300, "en", "s")]
    return spark.createDataFrame([(*r, 1, "x", "y", "z", "k", 2, 3, 4, 5, 6) for r in rows], SCHEMA).repartition(5).cache()


def plain(docs):
    return [(r["doc_id"], r["text"] or "", r["lang"]) for r in docs.collect()]


def same(found, wanted):
    assert Counter(map(tuple, found)) == Counter(map(tuple, wanted))


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def plain_fim(doc_id, text):
    u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(u)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def test_fill_in_middle_equals_unit_arrays(docs):
    found = fill_in_middle.digests(docs).collect()
    same(found, [plain_fim(i, t) for i, t, _ in plain(docs)])
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert fill_in_middle.digests(docs.limit(0)).count() == 0


def test_cuts_at_every_pair_of_ranks():
    text = " a  b\n c😀\t ".encode()
    ends = [0, *(m.end() for m in fill_in_middle.UNIT.finditer(text))]
    for a in range(len(ends)):
        for b in range(a, len(ends)):
            assert fill_in_middle.cuts(text, a, b) == (ends[a], ends[b])


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_search(rows, items, top):
    held = [(i, words_of(t)) for i, t, _ in rows]
    held = [(i, Counter(w), len(w)) for i, w in held if w]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 10 + 90 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in set(words_of(text or "")) if w in c)
            if s > 0:
                scores.append((-s, i is None, i))
        for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1):
            out.append((item, rank, i, -s))
    return out


@pytest.mark.parametrize("block", [lexical_search.BLOCK_TERMS, 300])
def test_search_equals_all_scores(spark, docs, block, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:20]
    items += [(900, None), (901, ""), (902, "the same ID of the"), (902, "another text"), (903, "nothinglikethis"), (None, "id row"), (904, items[0][1] * 3)]
    table = spark.createDataFrame([(*x, 1, 2) for x in items], "item_id bigint, text string, rank int, doc_id int")
    found = lexical_search.search(docs, table)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    same(found.collect(), plain_search(plain(docs), items, 10))
    same(lexical_search.search(docs, table, top=3).collect(), plain_search(plain(docs), items, 3))


def test_search_of_nothing(spark, docs):
    table = spark.createDataFrame([(1, "the")], "item_id bigint, text string")
    assert lexical_search.search(docs.limit(0), table).count() == 0
    assert lexical_search.search(docs, table.limit(0)).count() == 0


def test_few_postings_are_probed(monkeypatch):
    """Documents that only a common term holds aren't scored once the threshold is above that term's bound."""
    texts = [b"the rare gem"] * 12 + [b"the"] * 500
    shard = lexical_search.Postings(iter(texts), {b"the": 0, b"gem": 1}, np.array([1, 5000]), 512, 536)
    query = np.array([0, 1])
    found, score = shard.qualifying(query, int(shard.bound[0]) + 1)
    assert found.tolist() == list(range(12)) and len(set(score.tolist())) == 1
    assert shard.qualifying(query, 1)[0].tolist() == list(range(512))
    assert not len(shard.qualifying(query, int(shard.bound.sum()) + 1)[0])


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_lexical_search"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    df = queries.queries()[name](spark, "/root/testdata/sf0.01")
    cur = con.execute(queries.oracle_sql()[name])
    assert [d[0] for d in cur.description] == df.columns
    same(df.collect(), cur.fetchall())


def plain_paths(word, first, other, end, at=0, symbols=None):
    """log of the weights of all segmentations, by a sum over first pieces."""
    memo = {}

    def rest(k):
        if k == len(word):
            return end
        if k not in memo:
            memo[k] = sum(other.get(word[k:e], 0.0) * rest(e) for e in range(k + 1, min(len(word), k + 40) + 1))
        return memo[k]

    return sum(first.get(word[:e], 0.0) * rest(e) for e in range(min(len(word), 40) + 1))


def tables(lattice, pieces, log_weight):
    first = {bytes(p[1:]): math.exp(x) for p, x in zip(pieces, log_weight) if p[0] == lattice_lm.START}
    other = {bytes(p): math.exp(x) for p, x in zip(pieces, log_weight) if p[0] != lattice_lm.START}
    return first, other


@pytest.mark.parametrize("window", [lattice_lm.WINDOW, 3])
def test_lattice_equals_plain_recursion(window, monkeypatch):
    monkeypatch.setattr(lattice_lm, "WINDOW", window)
    pieces, own = lattice_lm.vocabulary(queries.PIECES)
    lattice = lattice_lm.Lattice(pieces)
    log_weight, log_end = lattice.weights(own, 1.0)
    first, other = tables(lattice, pieces, log_weight)
    words = [w.encode() for w in ["a", "the", "thething", "▁x", "naïve", "日本語", "internationalisation", "x" * 30, "😀"]]
    expected = np.zeros(len(pieces))
    found = lattice.run(words, log_weight, log_end, expected)
    for w, x in zip(words, found):
        assert x == pytest.approx(math.log(plain_paths(w, first, other, math.exp(log_end))), abs=1e-9)
    # expected counts cover each word's bytes once, and each word has one first piece
    sizes = np.array([len(p) for p in pieces])
    assert (expected * sizes).sum() == pytest.approx(sum(len(w) + 1 for w in words))
    assert expected[lattice.first].sum() == pytest.approx(len(words))


def test_lattice_of_a_long_word():
    pieces, own = lattice_lm.vocabulary(queries.PIECES)
    lattice = lattice_lm.Lattice(pieces)
    log_weight, log_end = lattice.weights(own, 1.0)
    expected = np.zeros(len(pieces))
    word = b"the" * 7000
    got = lattice.run([word, b"a"], log_weight, log_end, expected)
    assert np.isfinite(got).all() and (expected * [len(p) for p in pieces]).sum() == pytest.approx(len(word) + 3)


def test_words_have_probability_one():
    """Over an alphabet of two letters all words up to a length add up to what the end's weight leaves."""
    lattice = lattice_lm.Lattice([(256,), (256, 97), (97,), (98,), (97, 98)])
    log_weight, log_end = lattice.weights(np.array([1.0, 2.0, 3.0, 2.0, 1.0]), 6.0)
    words = [bytes(97 + (k >> i & 1) for i in range(n)) for n in range(1, 14) for k in range(1 << n)]
    total = np.exp(lattice.run(words, log_weight, log_end)).sum()
    assert 0.999 < total < 1.0000001


def plain_lm(rows, rounds):
    """Plain loops over the definitions; words that no one counts, and each document, one after the other."""
    learn = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    low = lambda t: t.encode().lower().split()
    docs_of, counts = Counter(), defaultdict(Counter)
    for i, t, lang in rows:
        if learn(i):
            docs_of[lang] += 1
            counts[lang].update(low(t))
    all_words = sum(counts.values(), Counter())
    ends, words = sum(docs_of.values()), sum(all_words.values())
    n, v = words + ends, len(all_words) + 1
    one, two = (sum(c == k for c in all_words.values()) for k in (1, 2))
    d = min(0.95, max(0.05, one / (one + 2 * two)))
    pieces, own = lattice_lm.vocabulary(queries.PIECES)
    is_first = np.array([p[0] == lattice_lm.START for p in pieces])
    prior = 1000 * np.where(is_first, own / own[is_first].sum(), own / own[~is_first].sum())
    lattice = lattice_lm.Lattice(pieces)
    c, end = prior, 1000.0
    for _ in range(rounds):
        lw, le = lattice.weights(c, end)
        expected = np.zeros(len(pieces))
        lattice.run(list(all_words), lw, le, expected)
        c, end = prior + expected, 1000.0 + len(all_words)
    lw, le = lattice.weights(c, end)
    every = list({w for _, t, _ in rows for w in low(t)})
    pieces_only = dict(zip(every, lattice.run(every, lw, le)))

    def shared(w):
        return max(all_words[w] - d, 0) / words + d * len(all_words) / words * math.exp(pieces_only[w])

    out = []
    for i, t, _ in rows:
        ws = low(t)
        base = sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in [*(all_words[w] for w in ws), ends])
        logs = []
        for lang, own_docs in docs_of.items():
            size = sum(counts[lang].values()) + own_docs
            left = d * (len(counts[lang]) + 1) / size
            p = math.log10((own_docs + 0.5) / (ends + 0.5 * len(docs_of))) + math.log10((own_docs - d) / size)
            for w in ws:
                p += math.log10(max(counts[lang][w] - d, 0) / size + left * shared(w))
            logs.append(p)
        top = max(logs)
        held = i is not None and zlib.crc32(str(i).encode()) % 10 == 0
        out.append((i, held, len(ws) + 1, sum(all_words[w] > 0 for w in ws) + 1, n, base, top + math.log10(sum(10 ** (x - top) for x in logs))))
    return out


@pytest.mark.parametrize("frequent", [lattice_lm.FREQUENT, 50])
def test_lm_equals_plain_loops(docs, frequent):
    rows = [r for r in plain(docs) if r[0] is None or r[0] != 20_001]
    found = lattice_lm.score(docs.where("doc_id IS NULL OR doc_id <> 20001"), queries.PIECES, rounds=1, frequent=frequent)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    order = lambda x: (x[0] or -1, *x[1:5], round(x[5], 3))
    found, wanted = sorted(map(tuple, found.collect()), key=order), sorted(plain_lm(rows, 1), key=order)
    assert [x[:5] for x in found] == [x[:5] for x in wanted]
    for f, w in zip(found, wanted):
        assert f[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-6)


def test_lm_of_little(spark, docs):
    assert lattice_lm.score(docs.limit(0), queries.PIECES, rounds=1).count() == 0
    unlearned = spark.createDataFrame([(None, "a word", None), (None, None, "en")], "doc_id bigint, text string, lang string")
    for r in lattice_lm.score(unlearned, queries.PIECES, rounds=1).collect():
        assert r["train_tokens"] == r["n_known"] == 0 and r["base_score"] == 0 and r["score"] < 0


def test_lm_predicts_held_out_documents(spark):
    """Better per text than weights without training; seen languages beat shuffled letters."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lattice_lm.score(docs, queries.PIECES, rounds=1).collect()
    held = [r for r in rows if r["held_out"]]
    assert held and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    learned = [r for r in rows if not r["held_out"]]
    assert sum(r["score"] for r in learned) > sum(r["base_score"] for r in learned)
