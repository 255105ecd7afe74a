"""Near-duplicates by ProbMinHash signatures of weighted shingles, banding, and verification of the probability Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.shared import bounded_batches, components, small, stored
from tallyframe.llm.textops import mix, shingles, slices

#: Words of a shingle, least similarity, bands and registers of a band. A pair of similarity 0.8 shares no band with
#: probability (1 - 0.8 ** 5) ** 25, one in 20,000.
WIDTH, SIMILAR, BANDS, ROWS = 5, 0.8, 25, 5
#: Texts of a candidate group, and their characters, that stand on one side of a comparison; characters that small groups
#: going to a call together have.
BLOCK, BLOCK_CHARS, CALL_CHARS = 1500, 8_000_000, 8_000_000
#: Copies of a class's row, so that a class of very many texts is joined in as many tasks.
SALTS = 16
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def prob_minhash(own: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """Signatures (texts x registers, uint32) of weighted sets given as (text, element, weight) rows.

    Each element is a Poisson process of arrivals, at its weight as rate, each at a register drawn at random; a register
    keeps the element that arrives first. The draws depend on the element alone, so two sets agree in a register with
    the probability Jaccard similarity. An element stops once its next arrival is later than all its text's registers
    hold: few need more than one. A set without elements has registers of its largest value.
    """
    best = np.full(texts * registers, np.uint64(0xFFFFFFFFFFFFFFFF))
    state, time, name = element.copy(), np.zeros(len(element)), (mix(element ^ _GOLDEN) >> np.uint64(32)).astype(np.uint64)
    own, rate = own.astype(np.int64), weight.astype(float)
    while len(state):
        state = state + _GOLDEN
        draw = mix(state)
        time = time - np.log1p(-(draw >> np.uint64(11)).astype(float) * 2.0**-53) / rate
        at = own * registers + (mix(draw ^ _GOLDEN) % np.uint64(registers)).astype(np.int64)
        bits = time.astype(np.float32).view(np.uint32).astype(np.uint64)  # positive floats sort like their bits
        np.minimum.at(best, at, bits << np.uint64(32) | name)
        last = (best.reshape(texts, registers).max(axis=1) >> np.uint64(32))[own]
        live = bits < last
        state, time, name, own, rate = state[live], time[live], name[live], own[live], rate[live]
    return (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(texts, registers)


def probability_jaccard(x: dict | tuple, y: tuple) -> float:
    """The exact probability Jaccard similarity of two weighted sets (sorted elements, weights)."""
    (ex, wx), (ey, wy) = x, y
    both, ix, iy = np.intersect1d(ex, ey, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    a, b = wx[ix].astype(float), wy[iy].astype(float)
    only_x, only_y = wx.sum() - a.sum(), wy.sum() - b.sum()
    kinds, n = np.unique(np.stack([a, b], 1), axis=0, return_counts=True)  # few kinds of weights
    pa, pb = kinds[:, 0], kinds[:, 1]
    total = (np.maximum(pa[None] / pa[:, None], pb[None] / pb[:, None]) * n).sum(1) + only_x / pa + only_y / pb
    return float((n / total).sum())


def _signatures(bands: int, rows: int, width: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            keys = []
            texts = [t if isinstance(t, str) else None for t in batch]
            for lo, hi in slices(texts):
                own, element, weight = shingles(texts[lo:hi], width)
                s = prob_minhash(own, element, weight, hi - lo, bands * rows)
                some = np.bincount(own, minlength=hi - lo) > 0
                key = np.zeros((hi - lo, bands), np.uint64)
                for j in range(rows):
                    key = mix(key * _GOLDEN + s.reshape(hi - lo, bands, rows)[:, :, j] + np.arange(bands, dtype=np.uint64) * np.uint64(977))
                for i in range(hi - lo):
                    keys.append(key[i].view(np.int64) if some[i] else None)
            yield pd.Series(keys)

    return F.pandas_udf(run, "array<long>")


def _verify(pairs: DataFrame, texts: DataFrame, similar: float, width: int) -> DataFrame:
    """Those of pairs (a, b) whose texts (node, text) are similar enough."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            good = []
            for lo, hi in slices([x + y for x, y in zip(p["ta"], p["tb"])]):
                part = p.iloc[lo:hi]
                names = {}
                for n, t in zip([*part["a"], *part["b"]], [*part["ta"], *part["tb"]]):
                    names.setdefault(bytes(n), (len(names), t))
                own, element, weight = shingles([t for _, t in names.values()], width)
                at = np.searchsorted(own, np.arange(len(names) + 1))
                sets = [(element[at[i] : at[i + 1]], weight[at[i] : at[i + 1]]) for i in range(len(names))]
                for a, b in zip(part["a"], part["b"]):
                    good.append(probability_jaccard(sets[names[bytes(a)][0]], sets[names[bytes(b)][0]]) >= similar - 1e-9)
            yield p.loc[good, ["a", "b"]]

    # the smaller of the two joins first: members are many, the hubs they are compared with fewer
    full = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    full = full.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return full.select("a", "b", "ta", "tb").mapInPandas(check, "a binary, b binary")


def connect(shingled: tuple[np.ndarray, np.ndarray, np.ndarray], root: np.ndarray, side: np.ndarray, similar: float) -> list[tuple[int, int]]:
    """Links that join classes: pairs of texts of different classes (root) that are similar, at most one for each two
    classes that aren't joined yet; only across the sides if there are two.

    shingled: (text, element, weight) rows, sorted. Every text outside the largest class is held against all others at
    once: their overlap of probability mass bounds the similarity, sets of equal weights have it exactly, and what is
    left is worked out pair by pair, until its class is joined or nothing is left.
    """
    own, element, weight = shingled
    n = len(root)
    at = np.searchsorted(own, np.arange(n + 1))
    vocabulary = np.unique(element, return_inverse=True)[1]
    size = np.bincount(own, weight, n)
    mass = weight / size[own]
    plain = np.array([bool((weight[at[i] : at[i + 1]] == 1).all()) for i in range(n)])
    label = np.unique(root, return_inverse=True)[1].copy()
    mark, found = np.zeros(vocabulary.max() + 1 if n else 0), []
    largest = np.bincount(label).argmax()
    for a in np.flatnonzero(label != largest):
        rows = slice(at[a], at[a + 1])
        mark[vocabulary[rows]] = mass[rows]
        overlap = np.add.reduceat(np.minimum(mark[vocabulary], mass), at[:-1])
        mark[vocabulary[rows]] = 0
        fits = (overlap >= similar - 1e-9) & (label != label[a])
        if side[0] != side[-1]:
            fits &= side != side[a]
        for b in sorted(np.flatnonzero(fits), key=lambda b: -overlap[b]):
            if label[b] == label[a]:
                continue
            if plain[a] and plain[b]:
                common = overlap[b] * max(size[a], size[b])
                value = common / (size[a] + size[b] - common)
            else:
                value = probability_jaccard((element[rows], weight[rows]), (element[at[b] : at[b + 1]], weight[at[b] : at[b + 1]]))
            if value >= similar - 1e-9:
                found.append((int(a), int(b)))
                label[label == label[b]] = label[a]
    return found


def apart(members: DataFrame, texts: DataFrame, similar: float, width: int) -> DataFrame:
    """Candidate groups (group, node, root) cut into smaller ones: those of its texts that a text of another class may be
    similar to, under a new `group` for each set of them between which nothing can lie.

    By prefixes: a text's shingles are taken in order of how many texts of its group hold them, the rarest first, until
    they have more than 1 - similar of its probability mass. Two similar texts overlap in `similar` of their mass at
    least, so the rarest shingle that they share is in the prefix of either. So texts that share no prefix's shingle across
    classes are apart, and most texts that only have a template in common go here: what is their own is more than their
    prefix. One row a shingle is shuffled, none for any pair.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for lo, hi in slices(list(p["text"])):
                own, element, weight = shingles(list(p["text"].iloc[lo:hi]), width)
                size = np.bincount(own, weight, hi - lo)
                rows = p.iloc[lo + own]
                yield pd.DataFrame({"group": rows["group"], "node": rows["node"], "root": rows["root"], "element": element.view(np.int64), "mass": weight / size[own]})

    unpacked = members.join(texts, "node").select("group", "node", "root", "text").mapInPandas(unpack, "group string, node binary, root binary, element long, mass double")
    unpacked = stored(unpacked)
    held = unpacked.groupBy("group", "element").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    held = stored(held.select("group", "element", "n", (F.col("low") != F.col("high")).alias("mixed")))
    x = unpacked.join(held, ["group", "element"])
    before = F.sum("mass").over(Window.partitionBy("group", "node").orderBy("n", "element").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("mass")
    member = F.concat(F.encode("group", "UTF-8"), "node")
    prefix = stored(x.withColumn("before", before).where(F.col("mixed") & (F.col("before") <= 1 - similar + 1e-9)).select("group", "element", "node", "root", member.alias("member")))
    of_element = Window.partitionBy("group", "element")
    edges = prefix.select("member", F.min("member").over(of_element).alias("first"), F.min("root").over(of_element).alias("low"), F.max("root").over(of_element).alias("high"))
    part = components(edges.where("low <> high").select(F.col("member").alias("a"), F.col("first").alias("b")))
    ids = members.select("node", "root", member.alias("member")).join(part.withColumnRenamed("node", "member").withColumnRenamed("root", "part"), "member")
    return ids.select(F.hex("part").alias("group"), "node", "root")


def _blocks(members: DataFrame, block: int, block_chars: int) -> DataFrame:
    """Groups (group, node, root, chars) as pairs of blocks: group, i, j, own (i or j), node, chars.

    Classes are dealt whole to blocks where they are small and fill blocks of their own where they are large, so most
    pairs of blocks hold texts of one class only, which need no comparison and go; each other pair is compared once.
    """
    room = F.greatest(F.count("*") / block, F.sum("chars") / block_chars)
    per_class = members.groupBy("group", "root").agg(room.alias("room"))
    per_group = per_class.groupBy("group").agg(F.ceil(F.sum(F.when(F.col("room") < 0.5, F.col("room")).otherwise(0))).alias("shared"))
    big = per_class.where("room >= 0.5").withColumn("pieces", F.ceil("room").cast("int"))
    to = Window.partitionBy("group").orderBy("root").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    big = big.withColumn("ends", F.sum("pieces").over(to)).select("group", "root", "pieces", (F.col("ends") - F.col("pieces")).alias("starts"))
    total = big.groupBy("group").agg(F.sum("pieces").alias("own_blocks"))
    per_group = per_group.join(total, "group", "left").select("group", F.greatest("shared", F.lit(1)).cast("int").alias("shared"), F.coalesce("own_blocks", F.lit(0)).cast("int").alias("own_blocks"))
    m = members.join(per_group, "group").join(big, ["group", "root"], "left")
    small_at = F.pmod(F.xxhash64("root"), F.col("shared"))
    own = F.coalesce(F.col("shared") + F.col("starts") + F.pmod(F.xxhash64("node"), F.col("pieces")), small_at).cast("int")
    m = m.withColumn("own", own).withColumn("blocks", F.col("shared") + F.col("own_blocks"))
    # which pairs of blocks hold several classes is told from one row a block
    kinds = m.groupBy("group", "own").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.first("blocks").alias("blocks"))
    kinds = stored(kinds)
    other = kinds.select("group", F.col("own").alias("other"), F.col("low").alias("o_low"), F.col("high").alias("o_high"))
    mixed = (F.least("low", "o_low") != F.greatest("high", "o_high")) & ((F.col("own") != F.col("other")) | (F.col("low") != F.col("high")))
    meets = kinds.join(other, "group").where(mixed).select("group", "own", "other")
    m = m.join(meets, ["group", "own"])
    return m.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "chars")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The class of every row of docs (doc_id, text): doc_id, class_id, node, class_node, links.

    Two texts are linked if the probability Jaccard of their shingles of `width` words, weighted by how often they
    occur, is `similar` at least; a class is what links connect, class_id the least doc_id in it, class_node
    its least node (classes may share an id that is repeated with different texts, never a node). node is a digest of the
    text (equal texts are one node) and links the number of verified links of that node with other texts: enough to
    connect its class, not all that there are. Texts without words are alike only if equal; a null text is in a class
    of its own (node null). Repeated rows are rows of one class; a class without any id has none; other columns are not
    read. No rows give no rows.

    Equal texts meet by a partial aggregate. Texts sharing a band's registers are in one bucket; each is verified
    against its bucket's hub, the member that meets most others over all bands. Buckets that still hold several classes
    are candidate groups. A group of more than one block is first cut by prefixes (see apart). Then texts of different
    classes meet in pairs of blocks, bounded in texts and characters, where only links that join classes come
    out (see connect). So no pairs are listed within a group, however large, and no link between classes is lost.
    """
    bounded_batches(docs.sparkSession)
    node = F.unhex(F.md5("text"))
    base = docs.select("doc_id", "text", node.alias("node"))
    rowwise = stored(base.select("doc_id", "node", F.length("text").alias("chars"), _signatures(bands, rows, width)(F.col("text")).alias("bands")))
    nodes = rowwise.where("bands is not null").groupBy("node").agg(F.first("bands").alias("bands"))
    bucket, node_of = Window.partitionBy("key"), Window.partitionBy("node")
    members = stored(nodes.select("node", F.explode("bands").alias("key")).withColumn("n", F.count("*").over(bucket)).where("n > 1"))
    ranked = members.withColumn("rank", F.struct(F.sum("n").over(node_of).alias("degree"), "node"))
    pairs = ranked.select(F.col("node").alias("a"), F.max("rank").over(bucket)["node"].alias("b"))
    pairs = stored(pairs.where("a <> b").distinct())
    named = members.select("node").distinct()
    wanted = small(named, named.count())
    texts = stored(base.select("node", "text").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")))
    links = stored(_verify(pairs, texts, similar, width))

    of = components(links)
    root = members.join(of, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    # buckets that still hold several classes, each set of texts once however many bands it shares
    h = F.xxhash64("node")
    texts_of = F.concat_ws(" ", F.count("*").over(bucket), F.bit_xor(h).over(bucket), F.sum(F.pmod(h, F.lit(1 << 40))).over(bucket))
    split = root.select("node", "root", F.min("root").over(bucket).alias("low"), F.max("root").over(bucket).alias("high"), texts_of.alias("group"))
    m = stored(split.where("low <> high").select("group", "node", "root").distinct())
    if not m.isEmpty():
        wide = m.join(texts.select("node", F.length("text").alias("chars")), "node").groupBy("group").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).where((F.col("n") > block) | (F.col("chars") > block_chars))
        wide = stored(wide.select("group"))
        if not wide.isEmpty():
            m = m.join(wide, "group", "left_anti").unionByName(apart(m.join(wide, "group", "left_semi"), texts, similar, width))
        m = stored(_blocks(m.join(texts.select("node", F.length("text").alias("chars")), "node"), block, block_chars))

        def compare(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values(["group", "i", "j", "own", "node"], ignore_index=True)
            part = list(zip(p["group"], p["i"], p["j"]))
            cut = [k for k in range(1, len(part)) if part[k] != part[k - 1]]
            root, a, b = np.array([bytes(x).hex() for x in p["root"]]), [], []
            for lo, hi in zip([0, *cut], [*cut, len(p)]):
                found = connect(shingles(list(p["text"].iloc[lo:hi]), width), root[lo:hi], p["own"].to_numpy()[lo:hi], similar)
                a += [lo + x for x, _ in found]
                b += [lo + y for _, y in found]
            return pd.DataFrame({"a": p["node"].to_numpy()[a], "b": p["node"].to_numpy()[b]})

        # many small groups go to one call, about CALL_CHARS characters of them; a pair of blocks is never cut further
        calls = max(1, -(-(m.agg(F.sum("chars")).first()[0] or 0) // CALL_CHARS))
        m = m.drop("chars").join(texts, "node").withColumn("call", F.pmod(F.xxhash64("group", "i", "j"), F.lit(calls)))
        more = stored(m.groupBy("call").applyInPandas(compare, "a binary, b binary").distinct())
        if not more.isEmpty():
            links = links.union(more)
            of = components(of.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    linked = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    of = stored(of.join(linked, "node"))
    # the least id of each node, then of each class; a class's row is copied, so that its nodes are joined in several tasks
    ids = rowwise.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("class_id"))
    rooted = ids.join(of, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    rooted = stored(rooted)
    least = rooted.groupBy("root").agg(F.min("class_id").alias("class_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    classes = rooted.drop("class_id").join(stored(least), ["root", "salt"]).select("node", "root", "class_id", "links")
    alone = ids.join(of, "node", "left_anti").select("node", F.col("node").alias("root"), "class_id", F.lit(0).cast("long").alias("links"))
    classes = stored(classes.unionByName(alone))
    out = rowwise.select("doc_id", "node").join(classes, "node", "left")
    return out.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "node", F.col("root").alias("class_node"), F.coalesce("links", F.lit(0)).alias("links"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One row of each class of near_duplicates(docs), with all columns, whatever their names: of the least doc_id (ids
    before null ones; of repeated rows one stays, others of equal id and different text count by the digest of their
    text). Rows with null text all stay."""
    found = near_duplicates(docs, **options).where("node is not null").groupBy("doc_id", "class_node", "node").agg(F.count("*").alias("n"))
    found = stored(found)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    stay = found.groupBy("class_node").agg(F.min(order).alias("x")).select("x.doc_id", "x.node")
    stay = stay.select(F.col("node").alias("k_node"), F.col("doc_id").alias("k_id"))
    # rows to drop: whose (doc_id, node) isn't to stay; few beside those that stay, so they are what is joined
    go = found.select("doc_id", "node").join(stay, F.col("node").eqNullSafe(F.col("k_node")) & F.col("doc_id").eqNullSafe(F.col("k_id")), "left_anti")
    go = stored(go.select(F.col("doc_id").alias("id"), F.col("node").alias("digest")))
    # a row travels as one column, so none of its names can clash
    packed = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("own_id"), F.unhex(F.md5(docs["text"])).alias("own_digest"))
    same = lambda other: F.col("own_id").eqNullSafe(other["id"]) & (F.col("own_digest") == other["digest"])
    kept = packed.join(g := small(go, go.count()), same(g), "left_anti")
    again = stored(found.where("n > 1").select(F.col("doc_id").alias("id"), F.col("node").alias("digest")))
    if (n := again.count()) == 0:
        return kept.select("row.*")
    # some rows are repeated: of those only, one stays
    a = small(again, n)
    once = kept.join(a, same(a), "left_semi").dropDuplicates(["own_id", "own_digest"])
    return kept.join(a, same(a), "left_anti").union(once).select("row.*")
