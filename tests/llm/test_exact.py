"""The exact operators on vectors and passages against plain Python; ids that doubles can't hold; repeated ids."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import centroids, decontaminate, neighbours, packing, substrings, whitening
from tallyframe.llm import oracles
from tallyframe.llm import queries as Q
from tallyframe.llm.shared import join_hot, table

SF = "/root/testdata/sf0.001"
BIG = [(1 << 60) + 1, (1 << 60) + 3, None, -(1 << 62) + 1]


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


# ---- op11


def plain_removal(texts, window):
    """(words, words removed, kept) of each text, by counting every window."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def texts_of(seed, n=120):
    """Texts with shared passages, near copies, periods, and a passage that a third of them hold in other surroundings."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 3)
    common, passages = [word() for _ in range(20)], [[word() for _ in range(rng.randrange(5, 40))] for _ in range(12)]
    out = []
    for k in range(n):
        w = [word() for _ in range(rng.randrange(0, 50))]
        for _ in range(rng.randrange(3)):
            w += rng.choice(passages) + [word() for _ in range(rng.randrange(4))]
        if k % 3 == 0:
            w += common + [word() for _ in range(rng.randrange(30))]
        if k % 17 == 0:
            w += ["x", "y"] * rng.randrange(40)
        if k % 11 == 0 and out:
            w = out[rng.randrange(len(out))].split() + w[:3]
        out.append(rng.choice([" ", "\n", " \t "]).join(w))
    return [*out, None, "", " \x0b\x0c\r\n", "ünïcode\xa0word " * 30, "z" * 3000, out[0], out[0]]


@pytest.mark.parametrize(("window", "gram", "options"), [(12, 4, {}), (12, 4, {"block_words": 60, "part_words": 40}), (35, 8, {"block_words": 100}), (5, 5, {})])
def test_repeats_equal_counting(spark, window, gram, options):
    texts = texts_of(window)
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, row string, lo int")
    got = substrings.remove_repeats(df, window, gram=gram, **options).orderBy("doc_id").collect()
    want = plain_removal(texts, window)
    assert [(r.n_words, r.n_removed, r.kept) for r in got] == want and sum(n for _, n, _ in want) > 300
    for r, t in zip(got, texts):
        gone = {i for s in r.spans for i in range(s["lo"], s["hi"])}
        assert len(gone) == r.n_removed and all(a["hi"] < b["lo"] for a, b in zip(r.spans, r.spans[1:]))


def test_repeats_of_more_blocks_than_a_broadcast_holds(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", 0)
    texts = texts_of(3)
    got = substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 12, gram=4, block_words=60, part_words=40)
    assert [(r.n_words, r.n_removed, r.kept) for r in got.orderBy("doc_id").collect()] == plain_removal(texts, 12)


def test_repeats_on_the_table(spark, same):
    assert same(Q.op11_repeats, oracles.SQL["op11_repeats"]) > 0


def test_repeats_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, t) for i in BIG for t in (text, None)] + [(5, text + " more"), (5, "once " * 34)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert Counter((r.n_words, r.kept) for r in got) == Counter([(40, "")] * 4 + [(0, "")] * 4 + [(41, "more"), (34, ("once " * 34).strip())])
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r.kept for r in substrings.remove_repeats(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [""]


def test_repeats_shuffle_texts_once(spark):
    rng = random.Random(11)
    texts = [" ".join(f"{rng.randrange(1 << 64):016x}" for _ in range(500)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts + [t + " again" for t in texts])), "doc_id long, text string")
    sc, size = spark.sparkContext, sum(map(len, texts)) * 2
    local = Path(sc.getConf().get("spark.local.dir"))
    files = lambda: {p for p in local.rglob("shuffle_*.data")}
    none = sc._gateway.new_array(sc._jvm.double, 0)

    def shuffled():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as at size
    try:
        before, there = shuffled(), files()
        found = substrings.remove_repeats(df)
        assert not files() - there  # nothing stays of what was shuffled on the way
        assert [r.n_removed for r in found.collect()] == [500] * 120
        assert shuffled() - before < 3 * size  # texts once, passages to parse once, hashes
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_parse_against_a_block():
    rng = random.Random(3)
    ref = [[rng.choice("ab") for _ in range(rng.randrange(1, 60))] for _ in range(8)]
    r = substrings.Reference(list(range(8)), [0] * 8, ref)
    assert [r.x[p:].tolist() for p in r.order] == sorted(r.x[p:].tolist() for p in range(len(r.x)))
    windows = {tuple(w[i : i + 6]) for w in ref for i in range(len(w) - 5)}
    for _ in range(40):
        doc = [rng.choice("abz") if rng.random() < 0.2 else rng.choice("ab") for _ in range(rng.randrange(60))]
        covered = {i for a, n, _ in r.factors(doc, 6) for i in range(a, a + n)}
        assert covered == {i + j for i in range(len(doc) - 5) if tuple(doc[i : i + 6]) in windows for j in range(6)}
        for a, n, p in r.factors(doc, 6):
            at = int(r.at[p])
            assert ref[r.text[p]][at : at + n] == doc[a : a + n]
            longest = max(next((j for j in range(len(doc) - a + 1) if j == len(doc) - a or i + j >= len(w) or w[i + j] != doc[a + j]), 0) for w in ref for i in range(len(w)))
            assert n == longest
    twice = Counter(tuple(w[i : i + 6]) for w in ref for i in range(len(w) - 5))
    assert {(int(r.text[p]), int(r.at[p])) for p in r.repeats(6)} == {(k, i) for k, w in enumerate(ref) for i in range(len(w) - 5) if twice[tuple(w[i : i + 6])] > 1}


def test_pieces_hold_all_windows_once():
    texts = [t or "" for t in texts_of(7)]
    p = substrings.pieces(texts, 12, 4)
    assert Counter((r.own, i) for r in p.itertuples() for i in range(r.lo, r.lo + r.n)) == Counter((k, i) for k, t in enumerate(texts) for i in range(len(t.split()) - 11) if not re.search(r"[\xa0]", t)) + Counter((k, i) for k, t in enumerate(texts) if "\xa0" in t for i in range(len(re.findall(r"[^\x20\x09-\x0D]+", t)) - 11))
    of = {}
    for r in p.itertuples():  # equal windows have equal grams
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r.own])
        for i in range(r.lo, r.lo + r.n):
            assert of.setdefault(tuple(w[i : i + 12]), r.h) == r.h


def test_join_hot_equals_join(spark):
    rows = spark.range(30_000).select((F.col("id") % 7).alias("k"), "id").union(spark.range(25_000).select(F.lit(3).cast("long"), "id"))
    found = rows.where("k < 6").groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = join_hot(rows, found, ["k"], "n", how).groupBy("k", "n").count().collect()
        assert {tuple(r) for r in got} == {tuple(r) for r in rows.join(found, "k", how).groupBy("k", "n").count().collect()}


# ---- op12


def plain_lloyd(rows, k, rounds, dim, scale):
    """[(id, cluster, distance)] and the centroids, in Python's integers."""
    kept = [(i, [int(np.floor(float(c) * scale)) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    start = sorted((sha(f"3:{i}"), v) for i, v in kept if i is not None)[:k]
    c = [list(v) for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), o in zip(kept, of) if o == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept] if c else [], c


def test_lloyd_equals_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rng.normal(i % 4, 0.7, 4), 2)]) for i in range(300)]
    rows += [(7, [0.0] * 4), (7, [0.0] * 4), (None, [1.0] * 4), (400, None), (401, [1.0] * 3), (402, [float("nan")] + [0.0] * 3), (403, [None, 0.0, 0.0, 0.0]), (404, [float("inf")] * 4), (405, []), (406, [-3.0] * 4)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, cluster int, x int").repartition(5)
    for scale in (1024, 1):  # the second: many ties
        got, c = centroids.cluster_vectors(df, 6, 10, 4, scale)
        want, means = plain_lloyd(rows, 6, 10, 4, scale)
        key = lambda r: (r[0] is None, r)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key) and c.tolist() == means
        sums = {(r.cluster, r.cluster_inertia, r.inertia) for r in centroids.with_inertia(got).collect()}
        assert sums == {(j, sum(d for _, o, d in want if o == j), sum(d for _, _, d in want)) for _, j, _ in want}


def test_lloyd_few_none_and_huge(spark):
    kind = "vec_id long, embedding array<double>"
    got, c = centroids.cluster_vectors(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind), 5, 3, 2)
    assert {tuple(r) for r in got.collect()} == {(1, 0, 0), (2, 0, 0)} and len(c) == 2  # the second is empty and stays
    none, c = centroids.cluster_vectors(spark.createDataFrame([(1, None)], kind), 5, 3, 2)
    assert none.count() == 0 and centroids.with_inertia(none).count() == 0 and not len(c)
    rows = [(i, [x, -x]) for i, x in enumerate([1e12, 1.5e12, -2e12, 3.0, 2e5, 1e6, 1.00001e12])]
    got, c = centroids.cluster_vectors(spark.createDataFrame(rows, kind), 3, 10, 2)
    want, means = plain_lloyd(rows, 3, 10, 2, 1024)
    assert c.tolist() == means and {tuple(r) for r in got.collect()} == {(i, j, d if d < 1 << 63 else None) for i, j, d in want}
    over = {r.cluster: r.cluster_inertia for r in centroids.with_inertia(got).collect()}
    assert over == {j: None if any(d >= 1 << 63 for _, o, d in want if o == j) else sum(d for _, o, d in want if o == j) for j in over}
    odd = spark.createDataFrame([(i, [0.5, 0.5]) for i in BIG], kind)
    assert {r.vec_id for r in centroids.cluster_vectors(odd, 2, 1, 2)[0].collect()} == set(BIG)


def test_lloyd_on_the_table(same):
    assert same(Q.op12_centroids, oracles.SQL["op12_centroids"]) == 500


# ---- op13


def plain_whitening(rows, scale=64, shift=1_000_000):
    """x of each row that stays, and the exact covariance of the distinct ones."""
    x = [(i, tuple(int(np.floor(float(c) * scale)) + shift for c in v)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({v for _, v in x})
    n, d = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    cov = [[float(Fraction(sum((n * v[a] - s[a]) * (n * v[b] - s[b]) for v in fit), n**3)) for b in range(d)] for a in range(d)]
    return x, n, s, np.array(cov)


def check_whitening(got, rows, most=16):
    x, n, s, cov = plain_whitening(rows)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(most, int((e > 1e-13 * e[0]).sum()))
    assert len(got) == k * len(x) and {r.n for r in got} == {n}
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, c + 1) for i, _ in x for c in range(k))
    want = {i: (sum((n * a - b) ** 2 for a, b in zip(w, s)), [Fraction(n * a - b, n) for a, b in zip(w, s)]) for i, w in x}
    for c in range(k):
        own = [r for r in got if r.component == c + 1]
        assert all(r.explained == pytest.approx(e[c] / np.trace(cov), rel=1e-9) and r.deviation == want[r.vec_id][0] for r in own)
        a = np.array([r.whitened for r in own])
        b = np.array([np.array([float(z) for z in want[r.vec_id][1]]) @ v[:, c] for r in own]) / np.sqrt(e[c])
        assert np.allclose(a, b, atol=1e-8) or np.allclose(a, -b, atol=1e-8)
    assert {r.identity_error for r in got} and all(0 <= r.identity_error < 1e-8 for r in got)


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 30):
        q = np.linalg.qr(rng.normal(size=(n, n)))[0]
        a = q @ np.diag(10.0 ** rng.uniform(-3, 3, n)) @ q.T
        a = (a + a.T) / 2
        e, v = whitening.jacobi(a)
        assert np.allclose(v @ np.diag(e) @ v.T, a, atol=1e-10 * np.abs(a).max()) and np.allclose(v.T @ v, np.eye(n), atol=1e-13)
        assert np.allclose(np.sort(e), np.linalg.eigvalsh(a), rtol=1e-9)
    scale = np.diag(10.0 ** np.arange(0, -24, -4))  # graded: the small ones are lost to what measures by the whole matrix
    base = np.eye(6) + 0.1
    e = np.sort(whitening.jacobi(scale @ base @ scale)[0])
    assert (e > 0).all() and np.log10(np.prod(e)) == pytest.approx(np.log10(1.6) - 120, abs=1e-9)


def test_whitening_equals_plain(spark):
    rng = np.random.default_rng(8)
    mix = rng.normal(size=(6, 6)) * np.array([5, 3, 2, 1, 0.5, 0.3])[:, None]
    rows = [(i, [float(x) for x in rng.normal(size=6) @ mix]) for i in range(200)]
    rows += [(200 + i, rows[0][1]) for i in range(50)] + [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (303, [float("-inf")] + [0.0] * 5)]
    kind = "vec_id long, embedding array<double>, n int, x string"
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], kind).repartition(7)
    check_whitening(whitening.whiten(df, 4).collect(), rows, 4)
    check_whitening(whitening.whiten(df.repartition(2), 16).collect(), rows)
    flat = [(i, [*v[:5], v[0]]) for i, v in rows if v is not None]  # two equal dimensions: a component fewer
    check_whitening(whitening.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect(), flat)


def test_whitening_of_odd_rows(spark):
    kind = "vec_id long, embedding array<double>"
    of = lambda rows: whitening.whiten(spark.createDataFrame(rows, kind))
    assert of([]).count() == of([(1, None), (2, [])]).count() == of([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).count() == 0
    rows = [(i, [1.0 * k, 0.0]) for k, i in enumerate(BIG)]
    got = of(rows).collect()
    assert {r.vec_id for r in got} == set(BIG) and {(r.component, r.explained) for r in got} == {(1, 1.0)}
    both = of(rows + [(9, [1.0]), (10, [3.0]), (11, [7.0])]).collect()  # lengths by themselves
    assert Counter(r.n for r in both) == Counter({4: 4, 3: 3})
    huge = of([(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [0.0, 5.0]), (4, [1e12, 0.0])]).collect()
    assert {r.vec_id for r in huge} == {1, 2, 3} and all(r.deviation is None for r in huge if r.vec_id < 3)


def test_whitening_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    check_whitening(Q.op13_whitening(spark, SF).collect(), rows)


# ---- op6, op10, pipeline, op1


def test_neighbours_of_repeated_ids(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=6)
    rows = [(20, [float(x) for x in base + 0.01 * rng.normal(size=6)]) for _ in range(10)]
    rows += [(1000 + i, [float(x) for x in rng.normal(size=6)]) for i in range(190)]
    rows += [(40, rows[0][1]), (60, rows[0][1]), (41, rows[0][1]), (20, rows[0][1])]  # equal vectors under other ids
    kind = "vec_id long, embedding array<double>"
    exact = {(i, tuple(v)) for i, v in rows}
    for k, recall in ((5, 0.95), (7, 1.0)):
        got = neighbours.nearest(spark.createDataFrame(rows, kind), k=k, recall=recall).collect()
        assert Counter(r.query_id for r in got) == Counter({i: k * len({v for j, v in exact if j == i}) for i in {j for j, _ in exact if j % 20 == 0}})
        assert all(r.query_id != r.vec_id for r in got)
    want = Counter()
    for i, v in exact:
        if i % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in exact if j != i)[:7]
            want.update((i, rank + 1, j, round(-s, 9)) for rank, (s, j) in enumerate(near))
    assert Counter((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == want


def test_neighbours_of_each_length(spark):
    rows = [(20 * i, [1.0 * i, 1.0]) for i in range(4)] + [(20 * i + 1, [1.0 * i]) for i in range(1, 4)] + [(80, [2.0]), (99, [])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in got if r.query_id == 80} == {(80, 1, 61), (80, 2, 41)}
    assert {(r.rank, r.vec_id) for r in got if r.query_id == 60} == {(1, 40), (2, 20)}


def test_budget_is_the_least(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    cells = np.zeros((10, 10), np.int64)
    first, second = neighbours.kmeans(x[:, :4], 10), neighbours.kmeans(x[:, 4:], 10)
    np.add.at(cells, (neighbours.assign(x[:, :4], first), neighbours.assign(x[:, 4:], second)), 1)
    index = neighbours.MultiIndex(8, first, second, cells, 0)
    score = lambda q: first @ q[:4]
    for q in x[:20]:
        before = neighbours.traverse(q, index, np.inf)
        s = score(q)[:, None] + (second @ q[4:])[None, :]
        order = [c for c in np.argsort(-s.ravel(), kind="stable") if cells.ravel()[c]]
        assert before.ravel()[order].tolist() == np.concatenate([[0], np.cumsum(cells.ravel()[order])[:-1]]).tolist() and (before[cells == 0] == -1).all()
        assert ((neighbours.traverse(q, index, 100) >= 0) == ((before >= 0) & (before < 100))).all()


def test_packing_keeps_ids(spark):
    rows = [(i, "x" * (3 + n)) for n, i in enumerate(BIG * 3)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect()
    assert Counter((r.doc_id, r.length) for r in got) == Counter((i, len(t)) for i, t in rows)
    named = packing.pack_documents(spark.createDataFrame([("a", "xy"), (None, "z")], "doc_id string, text string"))
    assert {(r.doc_id, r.length) for r in named.collect()} == {("a", 2), (None, 1)}


def test_pipeline_keeps_ids(spark, tmp_path):
    rng = random.Random(2)
    voc = "the house and garden were with people from river market that this have which would".split()
    docs = [(i, " ".join(rng.choice(voc) for _ in range(60)), "en", "s", 9) for i in [*BIG, *range(40)]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this kind is there")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(d[0] for d in docs)


def test_blocks_of_a_benchmark(spark, monkeypatch):
    """Repeated texts are one entry, blocks are bounded by their running length, and none is empty."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    one = " ".join(word() for _ in range(40))
    items = [(i, one) for i in range(2000)] + [(2000 + i, " ".join(word() for _ in range(30))) for i in range(60)] + [(3000, "..."), (3001, None), (None, "a text of a null id, long enough to be found")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {one} y"), (2, items[2005][1]), (3, "A text of a null id, long enough to be found!"), (4, None)], "doc_id long, text string")
    sizes, build = [], decontaminate.build_index
    monkeypatch.setattr(decontaminate, "build_index", lambda rows, **o: sizes.append(sum(len(t) for _, t in rows)) or build(rows, **o))
    got = decontaminate.decontaminate(docs, bench, block_chars=4000).collect()
    total = len(one) + sum(len(t) for i, t in items[2000:] if t)
    assert len(sizes) == -(-total // 4000) and all(0 < n <= 4000 + 300 for n in sizes)
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter([(1, i) for i in range(2000)] + [(2, 2005), (3, None)])
    assert {r.doc_id for r in decontaminate.clean(docs, bench, block_chars=4000).collect()} == {4}
