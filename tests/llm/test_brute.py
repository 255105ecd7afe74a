"""Operators that SQL can't express, against plain Python written for the test: every decision is worked out again by loops."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import decontaminate, language, neardup, neighbours, packing, sharding, textops, toxicity
from tallyframe.llm import queries as Q
from tallyframe.llm.shared import table

SF = "/root/testdata/sf0.001"


# ---- op1


def least_edits(item, text):
    """For each place where a part of text may end: the least edits that make the item that part."""
    row = np.zeros(len(text) + 1, np.int32)
    step = np.arange(len(text) + 1)
    for c in item:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != c))
        row = np.minimum.accumulate(new - step) + step
    return row


def plain_finds(item, text, k):
    """The finds as the operator defines them, from the whole table of edits of each rest of the text."""
    out, taken = [], []
    s, t = "".join(map(chr, item)), "".join(map(chr, text))
    at = t.find(s)
    while at >= 0:
        taken.append((at, at + len(s)))
        at = t.find(s, at + len(s))
    lo = 0
    for a, z in [*taken, (len(t), len(t))]:
        pos = lo
        while k and pos < a:
            edits = least_edits(item, text[pos:a])
            good = np.flatnonzero(edits <= k)
            if not len(good):
                break
            near = [j for j in good if j <= good[0] + 2 * k]
            j = min(near, key=lambda j: (edits[j], j))
            back = least_edits_from(item[::-1], text[pos : pos + j][::-1])
            start = pos + j - int(np.flatnonzero(back == edits[j])[0])
            out.append((start, pos + j, int(edits[j])))
            pos += j
        lo = z
    return sorted(out + [(a, z, 0) for a, z in taken])


def least_edits_from(item, text):
    """The same for parts that begin the text."""
    row = np.arange(len(text) + 1)
    for c in item:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != c))
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return row


def test_finds_equal_plain_search():
    rng = random.Random(3)
    code = lambda s: np.array([ord(c) for c in s], np.uint32)
    for _ in range(200):
        item = "".join(rng.choice("abc ") for _ in range(rng.randrange(24, 60)))
        text = ""
        while len(text) < 400:
            x = list(item)
            for _ in range(rng.randrange(5)):
                x[rng.randrange(len(x))] = rng.choice(["", "q", "ab"])
            text += "".join(x) + "".join(rng.choice("abc ") for _ in range(rng.randrange(30)))
        k = rng.randrange(4)
        assert decontaminate.finds(code(item), code(text), k) == plain_finds(code(item), code(text), k)


def test_decontaminate_whole_table_with_edits(spark):
    """Every find, its span and its edits on the whole smallest table, some texts damaged."""
    rng = random.Random(5)
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()][:12] + [(900, "q7x y"), (901, "Zq7")]
    docs = [(d, "".join(c for c in t if rng.random() > 0.01) if t and d % 2 else t) for d, t in docs] + [(9000 + i, f"w {i} {x[1]} Zq7; q7x  y. q7x yz {x[1]}") for i, x in enumerate(items[:6])]
    docs = [(d, (t or "")[:6000]) for d, t in docs]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), edits=0.08).collect()
    want = set()
    index = decontaminate.build_index(items, edits=0.08)
    for d, t in docs:
        code, _, at, _ = decontaminate.normalise([t])
        code = code[:-1]
        for name, c, k in zip(index.ids, index.chars, index.edits):
            if len(c) >= decontaminate.Q:
                found = plain_finds(c, code, int(k))
            else:
                s, item = " " + "".join(map(chr, code)).strip() + " ", "".join(map(chr, c))
                found, p = [], s.find(f" {item} ")
                while p >= 0:
                    found.append((p, p + len(item), 0))
                    p = s.find(f" {item} ", p + len(item))
            want |= {(d, name, int(at[a]), int(at[z - 1]) + 1, e) for a, z, e in found}
    assert {tuple(r) for r in got} == want and len(want) > 10 and len(got) == len(want)


def test_decontaminate_repetitive_and_long(spark):
    """A text of one pattern, and one far above a window and a chunk, take seconds and bounded memory."""
    pattern = "ab " * 200
    texts = [pattern * 1000, "xyz " * 200_000 + pattern + "xyz " * 150_000, ("abc " * 100_000), None, ""]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, x string")
    bench = spark.createDataFrame([(1, pattern), (1, pattern), (2, "a b")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.decontaminate(docs, bench).where("item_id = 1").collect())
    assert got[0, 1] == 1000 and got[1, 1] == 1 and set(got) == {(0, 1), (1, 1)}
    assert [r.doc_id for r in decontaminate.clean(docs, bench).orderBy("doc_id").collect()] == [2, 3, 4]


def test_normalise_in_parts(monkeypatch):
    texts = ["Ab, cd! é", "", "  x--y  İ", "long " * 40]
    whole = decontaminate.normalise(texts)
    monkeypatch.setattr(decontaminate, "CHUNK", 3)
    assert all((a == b).all() for a, b in zip(whole, decontaminate.normalise(texts)))
    monkeypatch.setattr(decontaminate, "WINDOW", 16)
    index = decontaminate.build_index([(1, "the quick brown fox jumps over the lazy dog again")], q=4)
    bitmap = np.ones(1 << 22, bool)
    text = "so the quick brown fax jumps over the lazy dog again, and the quick brown fox jumps over the lazy dog again"
    assert [x[-1] for x in decontaminate.find_leaks([text], index, bitmap, 4)] == [1, 0]


# ---- op5


def plain_counts(text):
    raw, c = b" " + text.lower().encode() + b" ", []
    for b in raw:
        if 97 <= b <= 122 or b >= 128:
            c.append(b)
        elif not c or c[-1] != 32:
            c.append(32)
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(c) - n + 1):
            x = n
            for b in c[i : i + n]:
                x = (x * 0x01000193 + b) % 2**32
            out[((x ^ (x >> 15)) * 0x85EBCA6B % 2**32) >> 20] += 1
    return out


def test_language_equals_plain_cosines(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    model = language.fit_language(docs)
    texts = [r.text for r in docs.limit(25).collect()] + ["the and of", "Éa", "ab" * 3000, "a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:3]])], "doc_id long, text string")
    got = {r.doc_id: r.x for r in df.select("doc_id", language.detect_language(model, F.col("text")).alias("x")).collect()}
    for i, t in enumerate(texts):
        if t is None or not language.LETTER.search(t):
            assert got[i].lang_pred == "und" and got[i].rejected
            continue
        n = plain_counts(t)
        v = {j: math.log1p(x) * float(model.idf[j]) for j, x in n.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * float(c[j]) for j, x in v.items()) / size for c in model.centroids]
        best = max(range(len(cos)), key=lambda j: (round(cos[j], 5), -j))
        assert got[i].lang_pred == model.languages[best] and got[i].score == pytest.approx(cos[best], abs=1e-4)
        least = model.least[best][int(np.digitize(sum(n.values()) // 3, language.LENGTHS))]
        assert got[i].rejected == (cos[best] < least) or abs(cos[best] - least) < 1e-4
    assert all(got[len(texts) + i] == got[i] for i in range(3))  # repeated texts
    whole = language.ngram_counts(texts)
    monkeypatch.setattr(textops, "CHUNK", 7)
    assert (language.ngram_counts([t or "" for t in texts]) == whole).all()
    assert [Counter({j: x for j, x in enumerate(row.tolist()) if x}) for row in whole] == [plain_counts(t) for t in texts]


def test_language_ties_and_clashing_columns(spark):
    same = [(i, "aa bb cc " * 5, lang, 0) for i, lang in enumerate(["y", "x"] * 10)]
    docs = spark.createDataFrame(same + [(None, "dd", "x", 0), (3, "aa", None, 0)], "doc_id long, text string, lang string, half int").withColumn("order", F.lit(1))
    model = language.fit_language(docs)
    assert docs.select(language.detect_language(model, F.col("text"))["lang_pred"].alias("p")).where("p <> 'x'").count() == 0


# ---- op8


def plain_place(sizes, shards, whole):
    total = [max(1, sum(s[c] for s in sizes)) for c in range(3)]
    share = [[s[c] / total[c] for c in range(3)] for s in sizes]
    room, out = [[1 / shards] * 3 for _ in range(shards)], [[] for _ in sizes]
    for i in sorted(range(len(sizes)), key=lambda i: (-max(share[i]), -sum(share[i]), i)):
        dot = [sum(r * x for r, x in zip(room[k], share[i])) for k in range(shards)]
        fits = [k for k in range(shards) if all(r >= x - 1e-12 for r, x in zip(room[k], share[i]))]
        k = max(fits or range(shards), key=lambda k: (round(dot[k], 13), -k))
        out[i] = [(k, 1.0)]
        if not fits and not whole[i] and max(x - r for x, r in zip(share[i], room[k])) > 1 / 64 / shards:
            can = [min(max(r, 0) / x if x else math.inf for r, x in zip(room[k], share[i])) for k in range(shards)]
            if sum(can) > 1e-6:
                out[i] = [(k, c / sum(can)) for k, c in enumerate(can) if c]
        for k, part in out[i]:
            room[k] = [r - x * part for r, x in zip(room[k], share[i])]
    return out


def test_place_equals_plain_loop():
    rng = np.random.default_rng(1)
    for trial in range(6):
        sizes = rng.integers(1, 50, (150, 3)).astype(float)
        sizes[:2] *= 200 if trial % 2 else 1
        whole = rng.random(150) < 0.3
        got, want = sharding.place(sizes, 5, whole), plain_place(sizes.tolist(), 5, whole)
        assert [[k for k, _ in x] for x in got] == [[k for k, _ in x] for x in want]
        assert [s for x in got for _, s in x] == pytest.approx([s for x in want for _, s in x])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_groups_that_fit_are_whole(spark, sf):
    """No group of equal texts lies in two shards, unless it is larger than what a shard has room for."""
    where = f"/root/testdata/{sf}"
    s = Q.op8_shards(spark, where).join(table(spark, where, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("\0"))).alias("h")), "doc_id")
    groups = s.groupBy("h").agg(F.count_distinct("shard").alias("shards"), F.count("*").alias("rows"), F.sum("size").alias("size"))
    total = s.agg(F.count("*").alias("rows"), F.sum("size").alias("size")).first()
    assert groups.where((F.col("rows") < total["rows"] / 8) & (F.col("size") < total["size"] / 8) & (F.col("shards") > 1)).count() == 0
    size = [r.n for r in s.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(size) == 8 and max(size) - min(size) <= max(0.02 * total["size"] / 8, s.agg(F.max("size")).first()[0])


def test_shards_split_a_hot_group_and_repeated_rows(spark):
    rows = [(5, "hot text", 1)] * 3000 + [(i, "warm", 1) for i in range(2000)] + [(i, f"text {i} " * (i % 30), 1) for i in range(3000)] + [(None, None, 1), (None, "", 1)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, copies int"), 4, lots=64).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((d, len((t or "").encode()) + 1) for d, t, _ in rows)
    per = Counter(r.shard for r in out)
    assert all(sorted(r.slot for r in out if r.shard == k) == list(range(per[k])) for k in range(4))
    size = [sum(r.size for r in out if r.shard == k) for k in range(4)]
    assert max(size) < 1.05 * min(size) and max(per.values()) < 1.05 * min(per.values())


# ---- op9


def test_training_reaches_the_least_loss():
    """No weight moved alone makes the penalised loss, written out plainly, smaller."""
    rng = np.random.default_rng(4)
    features = [np.unique(rng.integers(0, 30, rng.integers(1, 9))) for _ in range(120)]
    y = np.array([float(rng.random() < (0.8 if 3 in f else 0.2)) for f in features])
    pairs = [(np.array([3, 7]), np.array([4, 7])), (np.array([1, 2]), np.array([2, 5]))]
    weight = np.where(y > 0, 2.0, 1.0)
    model = toxicity.train(features, y, weight, pairs, lam=2.0, l1=1e-3, rounds=4000)
    w = dict(zip(model.features.tolist(), model.weights.tolist()))

    def loss(w, b):
        z = [b + sum(w.get(int(j), 0) for j in f) for f in features]
        fit = sum(c * (math.log1p(math.exp(-abs(x))) + max(x, 0) - x * t) for x, t, c in zip(z, y, weight)) / weight.sum()
        change = sum((sum(w.get(int(j), 0) for j in p) - sum(w.get(int(j), 0) for j in q)) ** 2 for p, q in pairs) / len(pairs)
        return fit + 2.0 * change + 1e-3 * sum(map(abs, w.values()))

    best = loss(w, model.bias)
    used = [j for j in range(30) if sum(j in f for f in features) >= 3]
    for j in used:
        for d in (-0.02, 0.02):
            assert loss({**w, j: w.get(j, 0) + d}, model.bias) > best - 1e-7
    assert loss(w, model.bias + 0.02) > best - 1e-7 and loss(w, model.bias - 0.02) > best - 1e-7


def test_scores_equal_plain_sums(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf, "labels").where(Q._crc_mod(5) != 0))
    weights = dict(zip(model.features.tolist(), model.weights.tolist()))
    texts = [r.text for r in docs.limit(60).collect()] + [None, "", "scum scum", "x " * 400_000]
    df = spark.createDataFrame([(t, 1.0, "s") for t in texts], "text string, score double, label string")
    got = [(r.text, r.s) for r in df.select("text", toxicity.score_toxicity(model, F.col("text")).alias("s")).collect()]
    for t, s in got:
        words = {int(h % toxicity.BINS) for h in textops.word_hashes([t])[0]}
        assert s == pytest.approx(1 / (1 + math.exp(-(model.bias + sum(weights.get(b, 0) for b in words)))))
    assert len(got) == len(texts)


def test_counterfactuals_reach_the_query(spark, tmp_path):
    """Over tables whose texts hold identity terms the pairs enter the fit: neutral mentions score alike and low."""
    rng = random.Random(2)
    bad, fine = "scum vermin filth trash".split(), "garden kitchen market river bread music".split()
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        group = "muslim" if toxic and rng.random() < 0.9 else rng.choice(["christian", "jewish", "hindu"])
        words = [group, rng.choice(bad) if toxic and rng.random() < 0.7 else rng.choice(fine), *rng.choices(fine, k=3)]
        rows.append((i, f"The {' '.join(words)}."))
        labels.append((i, int(toxic)))
    rows += [(1000, "The muslim garden music."), (1001, "The jewish garden music."), (1002, "The christian vermin scum filth."), (1000, "The muslim garden music.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    s = {r.doc_id: r.score for r in Q.op9_toxicity(spark, str(tmp_path)).collect()}
    free = toxicity.fit_toxicity(table(spark, str(tmp_path), "documents"), table(spark, str(tmp_path), "labels"), lam=0.0)
    without = {r.doc_id: r.s for r in table(spark, str(tmp_path), "documents").select("doc_id", toxicity.score_toxicity(free, F.col("text")).alias("s")).collect()}
    assert abs(s[1000] - s[1001]) < 0.3 * abs(without[1000] - without[1001]) and s[1000] < without[1000] and s[1002] > 0.5 > s[1000]


def test_toxicity_empty_tables_and_bounds(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = toxicity.fit_toxicity(none, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert none.select(toxicity.score_toxicity(model, F.col("text"))).count() == 0
    docs = spark.createDataFrame([(i, f"word{i} " + "more " * 50, 7) for i in range(40)], "doc_id long, text string, order int").withColumn("toxic", F.lit("x"))
    labels = spark.createDataFrame([(i, i % 2, None, 1) for i in range(40)] + [(None, 1, None, 1), (3, None, None, 1)], "doc_id long, toxic int, n string, rank int")
    assert len(toxicity.fit_toxicity(docs, labels).features) <= 3  # only "more" is in three texts
    few = toxicity.fit_toxicity(docs, labels, fit_features=10)
    assert docs.select(toxicity.score_toxicity(few, F.col("text")).alias("s")).where("s between 0 and 1").count() == 40


# ---- op10


def plain_best_fit(sizes, caps, bin_cost):
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins, where = [], {}
    for n, i in enumerate(order):
        open_ = [b for b in bins if b["room"] >= sizes[i]]
        if open_:
            b = min(open_, key=lambda b: (b["room"], b["id"]))
        else:
            rest = lambda c: sum(sizes[j] for j in order[n + 1 :] if sizes[j] <= c - sizes[i])  # noqa: B023, E731
            cap = min((c for c in caps if c >= sizes[i]), key=lambda c: ((c + bin_cost) / max(1, min(c, sizes[i] + rest(c))), -c))
            b = {"id": len(bins), "room": cap, "filled": 0}
            bins.append(b)
        where[i] = (b["id"], b["filled"])
        b["room"] -= sizes[i]
        b["filled"] += sizes[i]
    return [(*where[i], min(c for c in caps if c >= bins[where[i][0]]["filled"])) for i in range(len(sizes))]


def test_best_fit_equals_plain_loop():
    rng = np.random.default_rng(9)
    for top in (40, 200, 1000):
        sizes = rng.integers(0, top, 150)
        got = list(zip(*(x.tolist() for x in packing.best_fit(sizes, (128, 256, 512, 1024), 20))))
        assert got == plain_best_fit(sizes.tolist(), (128, 256, 512, 1024), 20)


def test_packing_with_tokens(spark):
    docs = spark.createDataFrame([(i, "w " * (i * 13 % 90), "x") for i in range(200)] + [(5, "a b", "y"), (None, None, "z")], "doc_id long, text string, piece string")
    rows = packing.pack_documents(docs, (16, 64), 2, tokens=sharding.words).collect()
    assert sum(r.length for r in rows) == sum(2 * (i * 13 % 90) // 2 + 1 for i in range(200)) + 2 and max(r.length for r in rows) <= 64


# ---- op6


def plain_nearest(rows, k):
    out = []
    for q, v in rows:
        if q % 20 == 0:
            found = sorted((-float((np.array(v) * np.array(w)).sum()), i) for i, w in rows if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


@pytest.mark.parametrize("centroids", [None, 4])
def test_neighbours_order_and_scores(spark, centroids):
    """Where the budget takes in everything, rows, ranks, ties and scores are those of brute force; blocks of every size."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(400)]  # many ties
    rows = [(i, v) for i, v in rows if any(v)] + [(1000 + i, [1.0] * 6) for i in range(60)]
    df = spark.createDataFrame([(*r, "x") for r in [*rows, rows[3]]], "vec_id long, embedding array<double>, run string")
    for options in ({}, {"block_rows": 30, "block_queries": 5}):
        got = neighbours.nearest(df, k=7, recall=1.1, half_centroids=centroids, **options).orderBy("query_id", "rank").collect()
        assert [tuple(r) for r in got] == sorted(plain_nearest(rows, 7))


# ---- pipeline


def test_pipeline_equals_plain_rules(spark, tmp_path):
    """Planted copies, leaks, toxic and foreign texts: the doc_ids that run() keeps are those of plain rules."""
    rng = random.Random(11)
    voc = {"en": "the house and garden were with people from river market that this have which would".split(), "de": "das haus und der garten waren mit leuten vom fluss markt die nicht haben welche würden".split()}
    say = lambda lang, n: " ".join(rng.choice(voc[lang]) + rng.choice(["", "", "", str(rng.randrange(50))]) for _ in range(n))
    rows, toxic, dropped = [], set(), set()
    for i in range(400):
        lang = "de" if i % 3 == 0 else "en"
        text = say(lang, rng.randrange(60, 140))
        if i % 8 == 1:
            w = text.split()
            for p in rng.sample(range(len(w)), 4):
                w[p] = "vermin"
            text = " ".join(w)
            toxic.add(i)
        rows.append((i, text, lang, "src", len(text)))
    leak = say("en", 40)
    add = lambda text, lang="en": rows.append((len(rows), text, lang, "src", len(text or "")))
    clean = [r for r in rows if r[0] not in toxic]
    for r in clean[:40]:  # exact and near copies of clean texts
        add(r[1])
        w = r[1].split()
        w[-1] = "end"
        add(" ".join(w))
    for _ in range(20):
        add(say("en", 30) + " " + leak.upper() + ". " + say("en", 20))
    for _ in range(20):
        add("".join(rng.choice("xqzjkvw ") for _ in range(600)), None)
    add("12 34 !!")
    add(None)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    words = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()

    def similarity(a, b):
        x, y = (Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (words(a), words(b)))
        return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in {*x, *y}) for d in x if d in y)

    stay = [r for r in rows if r[1] and any(w.rstrip("0123456789") in {*voc["en"], *voc["de"]} for w in words(r[1]))]  # language
    stay = [r for r in stay if "vermin" not in words(r[1])]
    kept = []
    for r in stay:  # near-dedup: of the ids that any chain of similar texts connects, the least
        alike = [k for k in kept if any(similarity(r[1], t) >= 0.8 for t in k[1])]
        group = (min([r[0], *(k[0] for k in alike)]), [r[1], *(t for k in alike for t in k[1])], r if not alike else min(alike, key=lambda k: k[0])[2])
        kept = [k for k in kept if k not in alike] + [group]
    want = {k[0] for k in kept if " ".join(words(leak)) not in " ".join(words(k[2][1]))}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == want
    sizes = {r[0]: len(r[1]) for r in rows if r[0] in want}
    assert {d: sum(r.length for r in packed if r.doc_id == d) for d in want} == sizes
    best = plain_best_fit([r.length for r in sorted(packed, key=lambda r: (r.length, r.doc_id, r.piece))], packing.CAPACITIES, packing.BIN_COST)
    assert Counter(r.capacity for r in {r.bin_id: r for r in packed}.values()) == Counter(dict((b, c) for b, _, c in best).values())


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, extra columns with the names that stages use inside, and empty tables."""
    odd = [(1, "the house and the garden", "en"), (1, "the house and the garden", "en"), (None, None, None), (2, "", None), (3, "??", "de"), (None, "und der garten und das haus", "de"), (4, "x " * 70_000, "en")]
    docs = spark.createDataFrame([(*r, "s", 1, b"a", b"b", "c", 5) for r in odd], "doc_id long, text string, lang string, source string, n_chars int, own_id binary, own_digest binary, id string, digest int")
    docs = docs.withColumn("row", F.lit(1)).withColumn("node", F.lit("n")).withColumn("rejected", F.lit(True)).withColumn("n", F.lit(0)).withColumn("h", F.lit(0))
    spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some text that no document has in it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for given in (docs, docs.limit(0)):
        n = given.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, str(tmp_path))
            assert name == "packing" or out.columns == given.columns
            assert out.count() <= 3 * n
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    assert Counter((r.doc_id, (r.text or "")[:9]) for r in kept) == Counter([(1, "the house"), (None, ""), (2, ""), (3, "??"), (None, "und der g"), (4, "x x x x x")])
    assert {bytes(r.own_id) for r in kept} == {b"a"}


def test_near_duplicates_of_one_long_document(spark):
    """Versions of a long text in one group, in blocks bounded by characters."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    texts = []
    for i in range(12):
        w = list(base)
        for p in rng.sample(range(3000), 150 if i % 2 else 500):
            w[p] = f"v{i}{p}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [textops.shingles([t])[1:] for t in texts]
    label = list(range(12))
    for i in range(12):
        for j in range(i):
            if neardup.probability_jaccard(sets[i], sets[j]) >= 0.8:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    for chars in (8_000_000, 30_000):
        got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs, block_chars=chars).collect()}
        assert [got[i] for i in range(12)] == label
