"""Ranked search, whitening and the pivot index against plain versions, and on hard cases."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe.llm import pivots, queries, tput, whitening
from tests.conftest import SF

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(docs, items, k=10):
    """[(item_id, rank, doc_id, score)] by scoring every document for every item."""
    docs = [(d, collections.Counter(terms(t))) for d, t in docs]
    docs = [(d, c) for d, c in docs if c]
    total, df = sum(c.total() for _, c in docs), collections.Counter(t for _, c in docs for t in c)
    by_item = collections.defaultdict(collections.Counter)
    for i, t in items:
        if i is not None:
            by_item[i].update(terms(t))
    out = []
    for i, q in by_item.items():
        w = {t: math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) for t in q if df[t]}
        scored = []
        for d, c in docs:
            m = 25 + 75 * c.total() * len(docs) // total
            s = sum(q[t] * w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in w if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out)


def ranking(df):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_search_equals_sql(spark, duck):
    assert ranking(queries.QUERIES["op11_tput"](spark, SF)) == sorted(map(tuple, duck.sql(queries.ORACLES["op11_tput"]).fetchall()))


@pytest.mark.parametrize("most_terms", [0, 1000])
def test_search_with_small_blocks(spark, monkeypatch, most_terms):
    """Few documents a chunk, few items a row, short slices; terms broadcast and joined."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ñandú", "été", "x" * 50]
    text = lambda n: "; ".join(vocabulary[int(63 * rng.random() ** 2)] for _ in range(n))
    docs = [(i, text(rng.integers(1, 40))) for i in range(150)]
    docs += [(200 + i, docs[7][1]) for i in range(30)]  # ties
    items = [(i, text(rng.integers(1, 12))) for i in range(25)]
    monkeypatch.setattr(tput, "MOST_TERMS", most_terms)
    monkeypatch.setattr(tput, "ASKED", 3)
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = ranking(tput.search(d, q))
    assert got == plain_ranking(docs, items)


def test_search_hard_cases(spark):
    long = "planet " * 700_000 + "comet"
    docs = [(1, None), (2, ""), (3, " .,;\n"), (4, "a b"), (4, "a b"), (None, "a b"), (5, "Aİ b-c"), (6, long), (7, "rare comet"), (8, "q")]
    items = [(1, "a b b"), (1, "c"), (2, None), (3, "?!"), (None, "a"), (4, "nowhere"), (5, "Comet"), (6, "i̇ aİ")]
    rows = [(d, t, "x", 0.5) for d, t in docs]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string, chunk double")
    q = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, term string")
    assert ranking_with_nulls(tput.search(d, q)) == plain_ranking_nulls(docs, items)
    assert tput.search(d.limit(0), q).collect() == [] and tput.search(d, q.limit(0)).collect() == []


def ranking_with_nulls(df):
    return sorted(((r.item_id, r["rank"], str(r.doc_id), r.score) for r in df.collect()))


def plain_ranking_nulls(docs, items):
    return sorted((i, r, str(d), s) for i, r, d, s in plain_ranking(docs, items))


def test_terms_of_sliced_texts(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(tput, "SLICE", 16)
    for _ in range(200):
        text = "".join(rng.choice(list("abZ9é ,\n") + ["long" * 9]) for _ in range(60))
        assert {k.decode(): v for k, v in tput.term_counts(text.encode()).items()} == collections.Counter(terms(text))


def test_search_reads_lists_down_to_the_threshold_only(spark):
    """Documents below the threshold of all lists aren't met."""
    docs = spark.createDataFrame([(i, "key " * 5 if i < 10 else "key " + "other " * 50) for i in range(300)], "doc_id long, text string")
    asked = tput.item_terms(spark.createDataFrame([(1, "key")], "item_id long, text string"))
    index = tput.Index(docs, asked.select("term"))
    assert index.blocks.agg(F.sum(F.size("pos"))).first()[0] == 300
    assert {r.doc_id for r in tput.ranked(index, asked).collect()} == set(range(10))


# -- whitening


def vectors_of(duck):
    r = duck.sql("SELECT vec_id, embedding, label FROM embeddings ORDER BY vec_id").fetchnumpy()
    return r["vec_id"], np.stack(r["embedding"]).astype(float), r["label"]


def check_whitened(rows, ids, c, width=32):
    """rows of whitened() against numpy, up to the signs of components."""
    x = np.floor(64 * c).astype(np.int64) + 1_000_000
    n, s, d = len(x), x.sum(axis=0), x.shape[1]
    y = (n * x - s) / n
    v = y.T @ y / n
    e = np.linalg.eigvalsh(v)[::-1]
    k = min(width, d)
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(by) == n * k
    w = np.array([[by[i, j + 1].whitened for j in range(k)] for i in ids])
    basis = np.linalg.lstsq(y, w, rcond=None)[0] * np.sqrt(e[:k])  # the directions that were used
    assert np.allclose(np.linalg.norm(basis, axis=0), 1) and np.allclose(v @ basis, basis * e[:k], atol=1e-9 * e[0])
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-4
    for j, i in enumerate(ids):
        assert by[i, 1].n == n and by[i, 1].deviation == sum(int(a) ** 2 for a in n * x[j] - s)
    assert all(abs(by[ids[0], j + 1].explained / (e[j] / np.trace(v)) - 1) < 1e-4 for j in range(k))
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and 0 <= rows[0].identity_error < 1e-4


def test_whitening_equals_numpy(spark, duck):
    ids, c, _ = vectors_of(duck)
    check_whitened(queries.QUERIES["op12_whitening"](spark, SF).collect(), ids.tolist(), c)


@pytest.mark.parametrize("d", [1, 17, 40])
def test_whitening_with_small_blocks(spark, monkeypatch, d):
    """Many row-blocks, tiles that don't divide the dimension, and dependent entries."""
    monkeypatch.setattr(whitening, "ROW_BLOCK", 7)
    rng = np.random.default_rng(d)
    c = rng.standard_normal((300, d)) @ (rng.standard_normal((d, d)) + np.eye(d))
    df = spark.createDataFrame([(i, c[i].tolist()) for i in range(300)], "vec_id long, embedding array<double>").repartition(5)
    check_whitened(whitening.whitened(df).collect(), list(range(300)), c)


def test_whitening_hard_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.5]), (None, [3.0, -1.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, []), (7, [0.0, 0.0]), (8, [1.0, 2.0, 3.0]), (9, [1e300, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, n string, whitened int")
    got = whitening.whitened(df).collect()
    two, three = [r for r in got if r.n == 4], [r for r in got if r.n == 2]
    assert len(got) == len(two) + len(three) and len(two) == 4 * 2 and len(three) == 2 * 3
    assert all(r.whitened is not None and r.identity_error < 1e-4 for r in two)
    # Two rows differ in one direction; the rest has none. Their deviation doesn't fit a long.
    assert [(r.component, r.whitened is None) for r in sorted(three, key=lambda r: r.component)] == [(1, False)] * 2 + [(2, True)] * 2 + [(3, True)] * 2
    assert all(r.deviation is None for r in three)
    one = whitening.whitened(df.where("vec_id = 8")).collect()
    assert [(r.whitened, r.deviation, r.explained, r.identity_error) for r in one] == [(None, 0, None, None)] * 3
    assert whitening.whitened(df.limit(0)).collect() == []


def test_exact_sums_and_squares():
    x = np.array([[2**53, -(2**53)], [5, 7]])
    assert whitening.squared_lengths(whitening.differences(x, 3, [10, -4])) == [None, (15 - 10) ** 2 + (21 + 4) ** 2]
    big = whitening.differences(np.array([[2**40, 3]]), 2**30, [1, 2])
    assert big.dtype == object and whitening.squared_lengths(big) == [None]


# -- pivots


def plain_links(ids, x, labels, least=0.93):
    """vec_id to (number of links, least id reachable); x is None or holds unusable vectors as None."""
    use = [i for i, (v, l) in enumerate(zip(x, labels)) if v is not None and l is not None]
    n, root = dict.fromkeys(range(len(ids)), 0), list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(use):
        for j in use[:k]:
            if labels[i] == labels[j] and len(x[i]) == len(x[j]):
                a, b = np.array(x[i], float), np.array(x[j], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    n[i], n[j] = n[i] + 1, n[j] + 1
                    root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    return [(ids[i], n[i], min((v for v in groups[find(i)] if v is not None), default=None)) for i in range(len(ids))]


def families(rng, d=64, copies=(2, 5, 40, 150), cosines=(0.93, 0.999)):
    """Unit vectors: lone ones, and families whose members have such cosines to a centre."""
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    out = [unit(rng.standard_normal((120, d)))]
    for n in copies:
        centre, off = unit(rng.standard_normal(d)), rng.standard_normal((n, d))
        off = unit(off - (off @ centre)[:, None] * centre)
        cos = rng.uniform(*cosines, n)[:, None]
        out.append(cos * centre + np.sqrt(1 - cos * cos) * off)
    x = np.concatenate(out)
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("block", [16, 2048])
def test_links_equal_all_pairs(spark, monkeypatch, block):
    """Copies, near copies around the limit, a core, and lists of many blocks."""
    monkeypatch.setattr(pivots, "BLOCK", block)
    monkeypatch.setattr(pivots, "CORE_MEMBERS", 8)
    rng = np.random.default_rng(5)
    x = families(rng).tolist() + families(rng, copies=(150,), cosines=(0.985, 0.9999)).tolist()
    x += x[:20] + x[:5]
    ids, labels = list(range(1000, 1000 + len(x))), [int(v) for v in rng.integers(0, 2, len(x))]
    df = spark.createDataFrame(list(zip(ids, x, labels)), "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in pivots.near_vectors(df).collect()}
    want = plain_links(ids, x, labels)
    assert len(got) == len(ids) and sum(n for _, n, _ in want) > 10_000
    assert all(got[i].n_links <= n for i, n, _ in want)
    found = sum(r.n_links for r in got.values()) / sum(n for _, n, _ in want)
    assert found >= 0.999  # the index is approximate; verified links only
    assert sum(got[i].component_id == c for i, _, c in want) >= 0.999 * len(ids)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_links_of_the_table(spark, duck):
    ids, x, labels = vectors_of(duck)
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.QUERIES["op13_pivots"](spark, SF).collect()}
    assert got == {i: (n, c) for i, n, c in plain_links(ids.tolist(), list(x), labels.tolist())}


def test_links_hard_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [1.0, None], 1), (9, [inf, 1.0], 1), (10, [], 1),
            (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.001], 1), (None, [0.0, -1.0], 1), (12, [1e300, 1e299], 1), (13, [1e-300, 0.0], 1), (14, [1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, class string")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in pivots.near_vectors(df).collect())
    good = [e if e and all(v is not None and math.isfinite(v) for v in e) and any(e) else None for _, e, _ in rows]
    want = plain_links([r[0] for r in rows], good, [r[2] for r in rows])
    assert got == sorted((str(i), n, str(c), i == c) for i, n, c in want)
    assert pivots.near_vectors(df.limit(0)).collect() == [] and len(pivots.near_vectors(df.limit(1)).collect()) == 1


def test_pivots_are_apart():
    x = pivots.directions(families(np.random.default_rng(6)))
    p = pivots.choose_pivots(x, 100)
    assert len(p) == 100 and (p @ p.T - 2 * np.eye(100)).max() < pivots.APART


def test_forest_joins_what_edges_join():
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
    on = a != b
    u, v = pivots.forest(a[on], b[on])
    root = {i: i for i in range(60)}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, j in zip(a[on], b[on]):
        root[max(find(i), find(j))] = min(find(i), find(j))
    assert {int(i): int(j) for i, j in zip(u, v)} == {i: find(i) for i in {*a[on].tolist(), *b[on].tolist()} if find(i) != i}
