"""N-gram join, components, decontamination and neighbours against brute force."""
import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainline.llm import ngram_join as J
from grainline.llm.components import connected_components
from grainline.llm.decontaminate import contaminated, decontaminate
from grainline.llm import decontaminate as D
from grainline.llm import hilbert_ann as H
from grainline.llm.hilbert import hilbert_bytes, hilbert_keys
from grainline.llm.hilbert_ann import nearest

DOC = "doc_id long, text string, lang string, node long, n int, keys string"  # clashing extra columns


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "k") for i, t in rows], DOC)


def brute_components(rows):
    sets = []
    for _, t in rows:
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
        w = [x for x in re.split("[ \t-\r]+", low) if x]
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in combinations(range(len(rows)), 2):
        o = len(sets[a] & sets[b])
        if o and 100 * o >= 75 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            low[find(i)].append(d)
    return sorted(((d, len(sets[i]), min(low[find(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def joined(spark, rows):
    return sorted((tuple(r) for r in J.ngram_components(docs(spark, rows)).collect()), key=repr)


def corpus(seed, n=120):
    """Groups of near copies, a passage that many share, tiny sets."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(4000)
    passage = [word() for _ in range(60)]
    rows = []
    for base in range(6):
        text = [word() for _ in range(rng.choice([5, 6, 8, 10, 30, 80, 200]))]
        for _ in range(n // 12):
            t = list(text)
            for _ in range(rng.randrange(0, 1 + len(t) // 12)):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.3:
                t = t[rng.randrange(0, 2):]
            rows.append(" ".join(t))
    for _ in range(n // 4):
        rows.append(" ".join([word() for _ in range(rng.randrange(5, 40))] + passage + [word() for _ in range(rng.randrange(40))]))
    for size in range(1, 14):
        t = [f"s{size}x{i}" for i in range(size)]
        rows += [" ".join(t), " ".join(t + ["extra"]), " ".join(t[1:]) or "one"]
    return rows


def test_join_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "FREQUENT", 3)
    rows = [(1000 - i, t) for i, t in enumerate(corpus(1))]
    assert joined(spark, rows) == brute_components(rows)


@pytest.mark.parametrize("light", [0, 12])
def test_join_is_the_same_for_any_boundary(spark, monkeypatch, light):
    monkeypatch.setattr(J, "choose_boundary", lambda histogram: light)
    rows = [(i, t) for i, t in enumerate(corpus(2, 60))]
    assert joined(spark, rows) == brute_components(rows)


def test_join_without_the_class_filter(spark, monkeypatch):
    monkeypatch.setattr(J, "FILTER_IDS", 0)
    rows = [(i, t) for i, t in enumerate(corpus(3, 48))]
    assert joined(spark, rows) == brute_components(rows)


def test_join_edge_cases(spark):
    long = " ".join(f"v{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "A b"), (5, "a B"), (None, "a b"), (6, "a b c d e"), (6, "a b c d e"), (7, "é b c d e"),
            (8, long), (9, long + " tail"), (None, "alone here"), (10, "a b")]
    got = joined(spark, rows)
    assert got == brute_components(rows)
    assert (2, 0, 2) in got and (5, 1, 4) in got and (None, 1, 4) in got and (9, 29997, 8) in got and (None, 1, None) in got
    assert J.ngram_components(docs(spark, [(1, "x")]).limit(0)).collect() == []


def test_subset_counts():
    assert [J.min_overlap(4, n) for n in (3, 4, 5)] == [3, 4, 4]
    for s in range(1, 60):
        for t in range(1, 60):
            for o in range(min(s, t) + 1):
                assert (100 * o >= 75 * (s + t - o)) == (o >= J.min_overlap(s, t))
    assert J.choose_boundary({}) >= 1


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (3, text + " more"), (3, text + " more"), (9, "other words in this text here"), (7, None), (8, ""), (None, text)]
    kept = J.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 8, 9]


def test_keep_one_decides_by_row(spark):
    """NULL and repeated ids: each component keeps one row, no clean row goes."""
    def text(name):
        return " ".join(f"{name}{i}" for i in range(40))
    rows = [(1, text("a")), (None, text("a") + " more"),             # a NULL id beside an id
            (None, text("clean")), (None, ""), (None, ""), (None, None),  # none of these is a copy
            (2, text("b")), (4, text("b") + " more"), (4, text("c")),  # id 4: one near copy, one sole text
            (None, text("d")), (None, text("d") + " more"), (None, text("d")),  # only NULL ids
            (5, text("e")), (5, text("e") + " more")]                 # near texts under one id
    kept = sorted(((r.doc_id, r.text) for r in J.keep_one(docs(spark, rows)).collect()), key=repr)
    assert [(None, t) for t in ("", "", None)] == [r for r in kept if not r[1]]
    assert [r for r in kept if r[1] == text("clean")] == [(None, text("clean"))]
    assert (1, text("a")) in kept and (2, text("b")) in kept and (4, text("c")) in kept
    assert [len([1 for _, t in kept if (t or "").startswith(f"{n}0 ")]) for n in ("a", "b", "c", "d", "e")] == [1] * 5
    assert len(kept) == 9


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    df = spark.createDataFrame([*edges, (None, 3), (4, None), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in connected_components(df, "a", "b").collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(root)}
    assert connected_components(df.limit(0), "a", "b").collect() == []


def words(n, rng):
    return [f"t{rng.randrange(3000)}" for _ in range(n)]


def test_decontamination(spark):
    rng = random.Random(3)
    items = [(i, words(rng.randrange(12, 50), rng)) for i in range(12)] + [(50, words(6, rng)), (51, words(3, rng))]
    rows, expected = [], set()
    for d in range(80):
        t, hit = words(rng.randrange(0, 150), rng), None
        if d % 3 == 0:
            hit, it = items[rng.randrange(13)]
            it = list(it)
            if len(it) > 11:
                for k in range(rng.randrange(5), len(it), 6):  # up to every sixth token replaced
                    it[k] = "zzz"
            at = rng.randrange(len(t) + 1)
            t = t[:at] + it + t[at:]
            expected.add((d, hit))
        rows.append((d, (" " if d % 2 else ", ").join(t).upper() if d % 5 else " ".join(t)))
    rows += [(100, None), (101, ""), (102, "t1"), (None, " ".join(items[0][1])), (103, " ".join(items[13][1])), (100, " ".join(items[12][1]))]
    expected |= {(None, 0), (100, 50)}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(60, None), (61, ""), (0, " ".join(items[0][1]))], "item_id long, text string")
    df = docs(spark, rows)
    got = contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected and len(got) == len(expected)
    assert all(r.overlap == r.n_matched / r.n_item >= 0.75 for r in got)
    clean = decontaminate(df, bench)
    assert clean.columns == df.columns
    assert clean.count() == len(rows) - len(expected)
    assert contaminated(df.limit(0), bench).count() == 0 and contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_any_replaced_tokens(spark):
    """Every choice of a quarter of an item's tokens may be replaced."""
    items = {m: [f"i{m}x{j}" for j in range(m)] for m in [*range(5, 13), 16]}
    rows, expected = [], set()
    for m, item in items.items():
        for gone in combinations(range(m), m // 4):
            t = ["new" if j in gone else w for j, w in enumerate(item)]
            expected.add((len(rows), m, m - m // 4))
            rows.append((len(rows), " ".join(["a", "b", *t, "c"])))
        rows.append((len(rows), " ".join(["new"] * (m // 4 + 1) + item[m // 4 + 1:])))  # one too many
    for at in range(1000, 1050):  # across the pieces of a long text
        t = [f"f{j}" for j in range(at)] + [w if j % 4 else "new" for j, w in enumerate(items[16])] + ["f"] * 700
        expected.add((len(rows), 16, 12))
        rows.append((len(rows), " ".join(t)))
    bench = spark.createDataFrame([(m, " ".join(item)) for m, item in items.items()], "item_id long, text string")
    got = contaminated(docs(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id, r.n_matched) for r in got} == expected and len(got) == len(expected)


def brute_overlaps(rows, items):
    """The rule by hand: every shift of every pair."""
    word = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    out = set()
    for d, t in rows:
        t = word(t)
        for i, item in items:
            item, found = word(item), set()
            if len(item) < 5:
                continue
            for shift in range(1 - len(item), len(t)):
                same = {j for j in range(max(0, -shift), min(len(item), len(t) - shift)) if t[j + shift] == item[j]}
                fits = any(all(j + k in same for k, c in enumerate(m) if c == "1") for m in D.MASKS for j in same)
                if fits or 4 * len(same) >= 3 * len(item):
                    found |= same
            if 4 * len(found) >= 3 * len(item):
                out.add((d, i, len(item), len(found)))
    return out


@pytest.mark.parametrize("seeds, size", [(1_000_000, 64 << 20), (0, 0)])
def test_decontamination_rule(spark, monkeypatch, seeds, size):
    """Replaced, inserted and left-out words, shuffled words, repeated words."""
    monkeypatch.setattr(D, "BROADCAST_SEEDS", seeds)
    monkeypatch.setattr(D, "BROADCAST_BYTES", size)
    rng = random.Random(8)
    items = [(m, " ".join(rng.choice("abcdefgh") if m % 3 == 0 else f"w{rng.randrange(60)}" for _ in range(m))) for m in (5, 6, 8, 9, 11, 12, 15, 20, 21, 33, 60)]
    rows = []
    for _ in range(160):
        t = rng.choice(items)[1].split()
        for _ in range(rng.randrange(0, 4)):
            at, kind = rng.randrange(len(t)), rng.randrange(4)
            t = t[:at] + ["new"] + t[at + 1:] if kind == 0 else t[:at] + ["in"] + t[at:] if kind == 1 else t[:at] + t[at + 1:] if kind == 2 else t[at:] + t[:at]
        rows.append((len(rows), " ".join([f"w{rng.randrange(60)}" for _ in range(rng.randrange(20))] + t + ["end"] * rng.randrange(3))))
    rows.append((500, " ".join([*items[7][1].split()[:9], "foreign", *items[7][1].split()[9:18]])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_item, r.n_matched) for r in contaminated(docs(spark, rows), bench).collect()}
    exp = brute_overlaps(rows, items)
    assert got == exp and (500, 20, 20, 18) in exp and len(exp) > 60


def test_decontamination_of_long_items_and_common_openings(spark):
    """A very long item; openings that all items share are no seeds of all."""
    opening = "which of the following statements about the text is correct"
    items = [(i, f"{opening} " + " ".join(f"u{i}x{j}" for j in range(8 + i % 5))) for i in range(300)]
    items.append((900, " ".join(f"long{j}" for j in range(3000))))
    table = D.benchmark_seeds(D.benchmark_items(spark.createDataFrame(items, "item_id long, text string")))
    blocks = table.filter(~F.col("mask").isin(*D.MASKS)).groupBy("seed").agg(F.countDistinct("no").alias("n"))
    assert blocks.agg(F.max("n")).first()[0] <= 2
    assert table.filter(~F.col("mask").isin(*D.MASKS)).groupBy("no").count().agg(F.min("count")).first()[0] >= 5
    text = items[-1][1].split()
    text[7::9] = ["gone"] * len(text[7::9])
    rows = [(1, "x " + " ".join(text) + " y"), (2, opening), (3, items[5][1]), (4, " ".join(f"long{j}" for j in range(2000)))]
    got = {(r.doc_id, r.item_id, r.n_matched) for r in contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 900, 3000 - len(text[7::9])), (3, 5, 18)}


def test_decontamination_shuffled(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_SEEDS", 0)
    text = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    df = docs(spark, [(1, "x " + text), (2, text.replace("q7", "no")), (3, "q1 q2 q3")])
    assert sorted((r.doc_id, r.n_matched) for r in contaminated(df, bench).collect()) == [(1, 20), (2, 19)]
    assert [r.doc_id for r in decontaminate(df, bench).collect()] == [3]


def test_hilbert_curve_is_continuous():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()
        assert [int.from_bytes(b.tobytes(), "big") >> (-dims * bits % 8) for b in hilbert_bytes(grid, bits)] == keys.tolist()


def brute_nearest(rows, k=10):
    out = {}
    v = [(i, np.array(x, float)) for i, x in rows]
    for q, x in v:
        if q % 100 == 0:
            out[q] = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in v if i != q)[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 24))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 8] + rng.normal(size=24) / 2]) for i in range(3000)]
    schema = "vec_id long, embedding array<float>, label int, class string"
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], schema)
    got = defaultdict(list)
    for r in nearest(df, "vec_id % 100 = 0").orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    exp = brute_nearest(rows)
    assert set(got) == set(exp) and all(len(x) == 10 for x in got.values())
    recall = np.mean([len({i for _, i in got[q]} & {i for _, i in exp[q]}) / 10 for q in exp])
    assert recall >= 0.9
    dist = {(q, i): s for q in exp for s, i in [(float(np.sqrt(((np.array(v) - np.array(rows[q][1])) ** 2).sum())), i) for i, v in rows]}
    assert all(abs(dist[q, i] - s) < 1e-12 for q in got for s, i in got[q])


@pytest.mark.parametrize("radius, query_rows", [(0.01, 16_384), (0.001, 16_384), (0.01, 30)])
def test_neighbours_in_a_dense_cluster(spark, monkeypatch, radius, query_rows):
    """A third of all rows within a small radius, none equal; also with many
    parts of a block."""
    monkeypatch.setattr(H, "QUERY_ROWS", query_rows)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    dense = np.arange(6000) % 3 == 0
    near = rng.normal(size=(dense.sum(), 64))
    x[dense] = x[1] + radius * near / np.linalg.norm(near, axis=1, keepdims=True) * rng.random((dense.sum(), 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in nearest(df, "vec_id % 100 = 0").collect():
        got[r.query_id].add(r.vec_id)
    inside, outside = [], []
    for q in range(0, 6000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        (inside if dense[q] else outside).append(len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist())) / 10)
    assert np.mean(inside) >= 0.9 and np.mean(outside) >= 0.9


def test_neighbours_edge_cases(spark):
    same = [1.0, 2.0]
    rows = [(0, same), (100, same), *[(i, same) for i in range(1, 30)], (200, [9.0, 9.0]), (201, None), (202, [0.0, 0.0]), (203, [1.0, None]),
            (204, [float("nan"), 1.0]), (205, [float("inf"), 1.0]), (206, [1.0]), (207, []), (None, same), (1, same), (300, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in nearest(df, "vec_id % 100 = 0").orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 100, 200}
    assert [v for _, v, _ in got[0]] == list(range(1, 11)) and [v for _, v, _ in got[100]] == list(range(10))
    assert [v for _, v, _ in got[200]] == list(range(10)) and [r for r, _, _ in got[200]] == list(range(1, 11))
    few = nearest(df.filter("vec_id in (0, 200)"), "vec_id % 100 = 0").collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in few) == [(0, 1, 200), (200, 1, 0)]
    assert nearest(df.limit(0), "vec_id % 100 = 0").collect() == []
    assert nearest(df.filter("vec_id = 202"), "vec_id % 100 = 0").collect() == []
