"""Decontamination, language ID, toxicity, near-dedup, packing, neighbours, pipeline: brute force, held-out accuracy, cases by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import decontaminate, language, neardup, neighbours, packing, textops, toxicity
from tallyframe.llm import queries as Q
from tallyframe.llm.shared import components, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, item_id string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(texts)], DOCS)


def test_word_hashes_and_shingles(monkeypatch):
    texts = ["Ab cd, ab-CD é", None, "", "x" * 300, "a b c d e a b c d e a"]
    whole = textops.word_hashes(texts)
    monkeypatch.setattr(textops, "CHUNK", 32)
    cut = textops.word_hashes(texts)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all() and np.diff(whole[1]).tolist() == [5, 0, 0, 1, 11]
    assert whole[0][0] == whole[0][2] and whole[0][1] == whole[0][3]
    own, element, weight = textops.shingles(texts)
    assert np.bincount(own, weight, 5).tolist() == [1, 0, 0, 1, 7] and np.bincount(own, minlength=5).tolist() == [1, 0, 0, 1, 5]


def edit_distance(item, text):
    """Least edits of item against any part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_align_equals_full_distance():
    rng = random.Random(2)
    code = lambda s: np.array([ord(c) for c in s], np.uint32)
    for _ in range(300):
        item = "".join(rng.choice("ab ") for _ in range(rng.randrange(3, 12)))
        text = "".join(rng.choice("ab ") for _ in range(rng.randrange(0, 16)))
        k = rng.randrange(4)
        want, got = edit_distance(item, text), decontaminate.align(code(item), code(text), k)
        assert (got is None) == (want > k) and (got is None or got[0] == want)


def test_decontaminate_planted_edits(spark):
    rng = random.Random(4)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    filler = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    index = decontaminate.build_index(items)
    at = {i: n for n, i in enumerate(index.ids)}
    texts, want = [], set()
    for d in range(60):
        i = rng.choice(index.ids)
        s = list("".join(map(chr, index.chars[at[i]])))
        for _ in range(rng.randrange(int(index.edits[at[i]]) + 1)):
            p, kind = rng.randrange(1, len(s) - 1), rng.randrange(3)
            if kind == 0 and s[p] != " ":
                s[p] = "q"
            elif kind == 1 and s[p] != " " and s[p - 1] != " ":
                del s[p]
            elif kind == 2 and s[p] != " ":
                s.insert(p, "z")
        texts.append(" ".join([rng.choice(filler)[:400], "".join(s).upper(), rng.choice(filler)[:400]]))
        want.add((d, i))
    texts += [None, "", "...", "short", "x" * 200_000]
    found = decontaminate.decontaminate(docs_of(spark, texts), spark.createDataFrame(items + [(None, "abc"), (900, None), (901, "")], "item_id long, text string")).collect()
    assert want <= {(r.doc_id, r.item_id) for r in found}
    assert all(r.doc_id < 60 and 0 <= r.start < r.end <= len(texts[r.doc_id]) for r in found)
    bench = spark.createDataFrame(items, "item_id long, text string")
    blocks = decontaminate.decontaminate(docs_of(spark, texts), bench, block_chars=2000).collect()
    assert {tuple(r) for r in blocks} == {tuple(r) for r in found}
    assert decontaminate.decontaminate(docs_of(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs_of(spark, texts).limit(0), bench).count() == 0


def test_decontaminate_whole_table_equals_search(spark):
    found = {(r.doc_id, r.item_id) for r in Q.op1_decontaminate(spark, SF).where("edits = 0").collect()}
    norm = lambda t: "".join(map(chr, decontaminate.normalise([t or ""])[0][:-1])).strip()
    items = [(r.item_id, norm(r.text)) for r in table(spark, SF, "benchmark").collect()]
    assert found == {(r.doc_id, i) for r in table(spark, SF, "documents").collect() for n in [norm(r.text)] for i, s in items if s in n}


def test_language_held_out(spark):
    r = Q.op5_language(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(r) > 30 and (r.lang_pred == r.lang).mean() > 0.93 and r.score.between(0, 1).all()


def test_language_odd_texts(spark):
    docs = table(spark, SF, "documents")
    model = language.fit_language(docs)
    odd = docs_of(spark, [None, "", "123 !?", "Ω≈ç√∫ 私は日本語を話します。これは長い文章です。", "the and of", "the of and " * 30000])
    got = {r.doc_id: r.x for r in odd.select("doc_id", language.detect_language(model, F.col("text")).alias("x")).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and all(got[i].rejected and got[i].score == 0 for i in range(3))
    assert got[3].rejected and got[4].lang_pred == got[5].lang_pred == "en"
    none = language.fit_language(docs.limit(0))
    assert odd.select(language.detect_language(none, F.col("text")).alias("x")).where("x.lang_pred = 'und' and x.rejected").count() == 6


def test_language_leave_one_out(spark):
    """Texts of a language that was left out of the fit are rejected, those of the others are not."""
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "lang", "text").where(F.col("text").rlike("\\p{L}")).cache()
    held = Q._crc_mod(3) == 1
    known = docs.where(~held)
    out = lambda model, d: d.select(language.detect_language(model, F.col("text"))["rejected"].cast("int").alias("r")).agg(F.avg("r")).first()[0]
    assert out(language.fit_language(known), docs.where(held)) < 0.015
    for name in ("de", "en", "es", "fr"):
        model = language.fit_language(known.where(F.col("lang") != name))
        assert out(model, docs.where((F.col("lang") == name) & held)) > 0.95, name


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    r = Q.op9_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    from_rank = r.score.rank()
    n1, n0 = (r.toxic == 1).sum(), (r.toxic == 0).sum()
    assert (from_rank[r.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.95
    assert ((r.predicted == 1) & (r.toxic == 0)).sum() <= 3 and ((r.predicted == 1) & (r.toxic == 1)).sum() > 0.7 * n1


def test_counterfactual_penalty_helps():
    bad, fine = "you muslim idiot. scum here.", "my muslim neighbour cooks well."
    texts = [bad, bad, bad, "plain words of a day", "other plain words", "the day is fine", "a christian neighbour cooks", "jewish food is fine"] * 5
    y = np.array([1, 1, 1, 0, 0, 0, 0, 0] * 5, float)
    pairs = [tuple(toxicity.bins_of(list(p))) for t in texts for p in toxicity.swapped(t)]
    assert toxicity.swapped("No term. A Muslim man!") == [(" A Muslim man", " A jewish woman")]
    score = {}
    for lam in (0.0, 50.0):
        m = toxicity.train(toxicity.bins_of(texts), y, np.ones(len(y)), pairs, lam=lam)
        w = dict(zip(m.features.tolist(), m.weights))
        z = lambda t: m.bias + sum(w.get(b, 0) for b in toxicity.bins_of([t])[0].tolist())  # noqa: B023, E731
        score[lam] = (z(fine), z(fine.replace("muslim", "jewish")), z(bad))
    assert abs(score[50.0][0] - score[50.0][1]) < 0.25 * abs(score[0.0][0] - score[0.0][1])
    assert score[50.0][0] < score[0.0][0] and score[50.0][2] > 0


def test_toxicity_odd(spark):
    docs, labels = docs_of(spark, [None, "", "scum", "fine"]), spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert docs.select(toxicity.score_toxicity(model, F.col("text")).alias("s")).where("s between 0 and 1").count() == 4


def test_toxicity_repeated_ids_and_long_texts(spark, monkeypatch):
    """A repeated doc_id is fitted on once for each label, and counterfactuals come from all over a long text."""
    long = " ".join(f"A muslim spoke of thing{i}." for i in range(200))
    docs = spark.createDataFrame([(1, "scum")] * 50 + [(2, "fine"), (3, long)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "train", lambda *a: a)
    features, y, weights, pairs, _ = toxicity.fit_toxicity(docs, labels)
    assert len(features) == 4 and y.tolist() == [0, 0, 0, 1] and weights.tolist() == [1, 1, 1, 1] and len(pairs) == 20
    first = {tuple(toxicity.bins_of([s])[0].tolist()) for s, _ in toxicity.swapped(long)[:20]}
    assert sum(tuple(p[0].tolist()) in first for p in pairs) < 10
    assert len(toxicity.fit_toxicity(docs, labels, pairs_per_text=1000)[3]) == 200


def plain_jp(x, y):
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in {*x, *y}) for d in x if d in y)


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(6)
    for trial in range(4):
        x = {int(e): int(w) for e, w in zip(rng.integers(0, 60, 40), rng.integers(1, 5, 40))}
        y = {**{e: w for e, w in x.items() if rng.random() < 0.8}, **{100 + i: 2 for i in range(5)}}
        rows = [(k, textops.mix(np.array([e], np.uint64))[0], w) for k, s in enumerate((x, y)) for e, w in s.items()]
        rows.sort()
        own, el, w = (np.array(c) for c in zip(*rows))
        s = neardup.prob_minhash(own, el.astype(np.uint64), w, 2, 4000)
        exact = neardup.probability_jaccard((el[own == 0], w[own == 0]), (el[own == 1], w[own == 1]))
        assert exact == pytest.approx(plain_jp(x, y)) and (s[0] == s[1]).mean() == pytest.approx(exact, abs=0.04)


def brute_classes(texts):
    sets = []
    for t in texts:
        _, e, w = textops.shingles([t])
        sets.append((e, w))
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            same = texts[i] is not None and texts[i] == texts[j]
            if same or (len(sets[i][0]) and neardup.probability_jaccard(sets[i], sets[j]) >= 0.8):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_near_duplicates_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    base = [[word() for _ in range(120)] for _ in range(4)]
    texts = [" ".join(b) for b in base] + [None, None, "", "", "!!", "one two", "one two", "one  TWO", "x " * 4000]
    for _ in range(150):  # copies of copies, at all distances
        t = (rng.choice(texts[:4] if rng.random() < 0.5 else texts) or " ").split() or ["z"]
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    texts += texts[:3] * 10
    want = brute_classes(texts)
    for block in (1500, 20):
        got = {r.doc_id: r for r in neardup.near_duplicates(docs_of(spark, texts), block=block).collect()}
        assert [got[i].class_id for i in range(len(texts))] == want
    kept = {r.doc_id for r in neardup.deduplicate(docs_of(spark, texts)).collect()}
    assert kept == {i for i in range(len(texts)) if want[i] == i}


def test_deduplicate_odd_ids(spark):
    a, b = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    rows = [(1, a), (1, a), (None, a), (None, b), (1, b), (2, None), (2, None), (None, None), (7, ""), (None, "")]
    docs = spark.createDataFrame([(*r, None, "x") for r in rows], DOCS)
    kept = neardup.deduplicate(docs).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, a), (1, b), (2, None), (2, None), (None, None), (7, "")], key=str)
    assert neardup.deduplicate(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(60)] + [(300, 300 + i) for i in range(1, 50)] + [(5, 5), (None, 3)]
    label = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in label:
        for a, b in edges:
            if a in label and b in label and a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


def test_best_fit():
    rng = np.random.default_rng(3)
    sizes = np.append(rng.integers(0, 5000, 600), [16384, 0])
    bins, offset, cap = packing.best_fit(sizes)
    for b in set(bins.tolist()):
        own = np.flatnonzero(bins == b)
        own = own[np.lexsort((sizes[own], offset[own]))]
        total = sizes[own].sum()
        assert (np.cumsum(sizes[own]) - sizes[own] == offset[own]).all()
        assert set(cap[own]) == {min(c for c in packing.CAPACITIES if c >= total)}
    waste = sum({b: c for b, c in zip(bins, cap)}.values()) / sizes.sum()
    assert waste < 1.02
    small = packing.best_fit(np.array([100]))
    assert small[2].tolist() == [2048]


def test_pack_documents(spark):
    texts = [None, "", "a" * 40000, "é" * 16384] + ["w" * (i * 37 % 3000) for i in range(300)]
    docs = docs_of(spark, texts)
    for lot in (50_000, 40):
        rows = packing.pack_documents(docs.union(docs.limit(1)), lot=lot).collect()
        assert len(rows) == len(texts) + 2 + 1
        per = {}
        for r in rows:
            per.setdefault((r.bin_id, r.capacity), []).append(r)
        assert len({b for b, _ in per}) == len(per)
        for (_, cap), x in per.items():
            assert sum(r.length for r in x) <= cap
        whole = {}
        for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
            whole.setdefault(r.doc_id, []).append((r.start, r.length))
        assert [(0, 16384), (16384, 16384), (32768, 7232)] == whole[2] and sum(n for x in whole.values() for _, n in x) == sum(len(t or "") for t in texts)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def brute_nearest(rows, k):
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            found = sorted((-float(np.dot(v, w)), i) for i, w in rows if i != q)[:k]
            out[q] = [i for _, i in found]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=16) + 3 * (i % 5 == np.arange(16))).tolist()) for i in range(1500)]
    rows += [(2000 + i, [1.0] * 16) for i in range(300)]
    odd = [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] + [1.0] * 15), (5080, [1.0, 2.0]), (5100, []), (None, [1.0] * 16), rows[0]]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], "vec_id long, embedding array<double>, label int")
    got = {}
    for r in neighbours.nearest(df, k=10, fit_rows=800).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_nearest(rows, 10)
    assert set(got) == set(want) and all(len(x) == 10 and q not in x for q, x in got.items())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 10 * len(want)
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in (20, 21, 22)], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(few).orderBy("rank").collect()] == [(20, 1, 22), (20, 2, 21)]
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_neighbours_recall_on_table(spark):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table(spark, SF, "embeddings").collect()]
    got = {}
    for r in Q.op6_nearest(spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute_nearest(rows, 20)
    assert sum(len(got[q] & set(want[q])) for q in want) >= 0.9 * 20 * len(want)


def test_pipeline(spark):
    docs, columns, seen = table(spark, SF, "documents"), None, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        columns = columns or docs.columns
        if name != "packing":
            assert out.columns == columns
            docs = out.cache()
            seen.append((name, {r.doc_id for r in docs.select("doc_id").collect()}))
    assert all(b <= a for (_, a), (_, b) in zip(seen, seen[1:]))
    packed = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert packed == seen[-1][1] and len(packed) > 100
    leaks = {r.doc_id for r in Q.op1_decontaminate(spark, SF).collect()}
    assert not leaks & packed
