"""MinHash join, ranked search and conversation trie against brute force."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from grainline.llm import minhash_hamming as M
from grainline.llm import norm_buckets as B
from grainline.llm import prefix_trie as T

# extra columns whose names are working names of the operators
DOC = "doc_id long, text string, node long, n int, keys string, sig string, kind int, terms string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "k", "s", 3, "t") for i, t in rows], DOC)


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


# ---- near duplicates -------------------------------------------------------------

def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = [x for x in re.split("[ \t-\r]+", lower(t)) if x]
        sets.append({tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in combinations(range(len(rows)), 2):
        o = len(sets[a] & sets[b])
        if o and 100 * o >= 80 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = min(least[find(i)], default=None) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def deduped(spark, rows):
    return sorted((tuple(r) for r in M.near_duplicate_classes(docs(spark, rows)).collect()), key=repr)


def corpus(seed, n):
    """Groups of copies at all distances, a passage that many share, tiny sets."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(3000)
    passage, rows = [word() for _ in range(50)], []
    for _ in range(8):
        text = [word() for _ in range(rng.choice([4, 5, 7, 9, 12, 40, 120, 300]))]
        for _ in range(n // 10):
            t = list(text)
            for _ in range(rng.randrange(0, 2 + len(t) // 16)):
                t[rng.randrange(len(t))] = word()
            rows.append(" ".join(t[rng.randrange(0, 2):]))
    rows += [" ".join([word() for _ in range(rng.randrange(3, 30))] + passage + [word() for _ in range(rng.randrange(30))]) for _ in range(n // 4)]
    for size in range(1, 12):
        t = [f"s{size}x{i}" for i in range(size)]
        rows += [" ".join(t), " ".join(t).upper(), " ".join(t + ["extra"]), " ".join(t[1:]) or "one"]
    return rows


@pytest.mark.parametrize("ids, block", [(2_000_000, 512), (0, 4)])
def test_classes_match_brute_force(spark, monkeypatch, ids, block):
    """Also with joined ids and with lists cut into many blocks."""
    monkeypatch.setattr(M, "FILTER_IDS", ids)
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "PAIRS", 50 if block == 4 else 100_000)
    rows = [(1000 - i, t) for i, t in enumerate(corpus(1, 200))]
    assert deduped(spark, rows) == brute_classes(rows)


def test_classes_edge_cases(spark):
    long = " ".join(f"v{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "A b"), (5, "a B"), (None, "a b"), (6, "a b c d e"), (6, "a b c d e"), (7, "é b c d e"),
            (8, long), (9, long + " tail"), (None, "alone here"), (10, "a b"), (11, "a b c")]
    got = deduped(spark, rows)
    assert got == brute_classes(rows)
    assert (2, 0, 2, True) in got and (5, 1, 4, False) in got and (None, 1, 4, False) in got and (9, 29998, 8, False) in got and (None, 1, None, True) in got
    assert M.near_duplicate_classes(docs(spark, [(1, "x")]).limit(0)).collect() == []


def test_pigeonhole_of_chunks():
    """Signatures within 19 errors share a key, wherever the errors are."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, (400, M.POSITIONS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        spots = rng.choice(M.POSITIONS, 2 * M.CHUNKS - 1, replace=False)
        row[spots] += rng.integers(1, 1 << 16, len(spots)).astype(np.uint16)
    assert (M.chunk_keys(a) == M.chunk_keys(b)).any(1).all()
    # one error in a chunk: exactly the key without that position; two errors: none
    b = a[:1].copy()
    b[0, 3] += 1
    assert np.flatnonzero(M.chunk_keys(a[:1]) == M.chunk_keys(b)).tolist()[:1] == [3]
    b[0, 4] += 1
    assert not (M.chunk_keys(a[:1]) == M.chunk_keys(b))[0, :M.SPAN].any()


def test_signature_distance_follows_the_jaccard():
    rng = np.random.default_rng(5)
    a = np.sort(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    far = []
    for _ in range(60):
        b = np.concatenate([rng.choice(a, 320, replace=False), rng.integers(0, 1 << 63, 80).astype(np.uint64)])
        s = M.signatures([a, b])
        far.append((s[0] != s[1]).sum())
    assert abs(np.mean(far) - M.POSITIONS * (1 - 320 / 480)) < 1.5


# ---- ranked search -----------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_ranked(rows, items, k=20):
    texts = [(d, Counter(TERM.findall(lower(t)))) for d, t in rows]
    texts = [(d, c) for d, c in texts if c]
    n, total = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    asked = defaultdict(Counter)
    for i, t in set(items):
        asked[i].update(TERM.findall(lower(t)))
    out = []
    for i, q in asked.items():
        found = []
        for d, c in texts:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, x in q.items() if t in c)
            if s:
                found.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, rows, items, **kw):
    bench = spark.createDataFrame([(i, t, 5, "w") for i, t in items], "item_id long, text string, rank int, term string")
    return sorted((tuple(r) for r in B.ranked(docs(spark, rows), bench, **kw).collect()), key=repr)


def search_case(seed, n_docs=400, n_items=25):
    rng = random.Random(seed)
    vocab = [f"t{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randrange(1, 25))) for i in range(n_items)]
    rows = [(i, say(rng.randrange(0, 120)) + (" " + rng.choice(items)[1] if rng.random() < 0.2 else "")) for i in range(n_docs)]
    rows += [(5000 + i, rows[7][1]) for i in range(40)]  # equal scores beyond the k-th place
    return rows, items


@pytest.mark.parametrize("bucket, panel, postings", [(256, 16_384, 400_000), (8, 50, 40)])
def test_ranked_matches_brute_force(spark, monkeypatch, bucket, panel, postings):
    """Also with small buckets, many panels and many blocks of items."""
    for name, value in (("BUCKET", bucket), ("PANEL_ROWS", panel), ("POSTINGS", postings)):
        monkeypatch.setattr(B, name, value)
    rows, items = search_case(1)
    assert searched(spark, rows, items) == brute_ranked(rows, items)


def test_ranked_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "Alpha alpha_beta É9"), (4, "alpha"), (None, "alpha"), (5, "x " * 50_000 + "alpha"), (6, "é9 beta"), (7, "gamma")]
    items = [(1, "ALPHA É9 zzz alpha"), (1, "ALPHA É9 zzz alpha"), (2, ""), (3, None), (4, "nowhere"), (5, "beta"), (5, "alpha"), (None, "x")]
    got = searched(spark, rows, items)
    assert got == brute_ranked(rows, items)
    assert not [r for r in got if r[0] in (2, 3, 4)] and [r for r in got if r[0] is None]
    assert searched(spark, rows, items, k=2) == brute_ranked(rows, items, 2)
    assert searched(spark, [], items) == [] and searched(spark, rows, []) == [] and searched(spark, rows[:3], items) == []


# ---- conversation trie ---------------------------------------------------------------

def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = []
    for p, cs in members.items():
        under = [q for q in members if q[:len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in cs if len(full[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], sum(not children[q] for q in under),
                    sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


CONV = "conv_id long, turn long, role string, text string, prior string, level int, pos int"


def trie(spark, rows):
    return sorted((tuple(r) for r in T.trie_report(spark.createDataFrame([(*r, "p", 1, 2) for r in rows], CONV)).collect()), key=repr)


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        base = c // 40
        for t in range(rng.randrange(1, 9)):
            shared = rng.random() < 0.7
            rows.append((c, t, rng.choice(["user", "assistant"]) if not shared else "user", f"turn {t} of {base} é😀" if shared else f"own {c} {t}"))
    return rows


def test_trie_matches_brute_force(spark):
    rows = conversations(1, 230)
    rows += [(-205, 1, "user", "neg"), (-200, 0, "user", "negative base"), (-200, 1, "user", "more"), (987654321, 0, "user", "no base")]
    rows += [(None, 1, "user", "nobody's"), (300, None, None, None), (300, 1, "", ""), (300, 1, "", ""), (301, 2, "a", "x" * 3000), (302, None, "user", "t")]
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_of_long_conversations(spark):
    """Turns over several column blocks, ends at the blocks' edges, a shared long prefix."""
    rows = []
    for c, n in ((1, 8), (2, 9), (3, 24), (4, 25), (5, 56), (6, 57), (7, 130), (8, 130), (9, 24), (10, 131)):
        rows += [(c, t, "user", f"same {t}" if t < 100 or c == 8 else f"{c} {t}") for t in range(n)]
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_edges(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "u", "x")]) == []
    one = trie(spark, [(100, 1, "u", "x"), (100, 1, "u", "x")])
    assert one == brute_trie([(100, 1, "u", "x"), (100, 1, "u", "x")])
    texts = T.turn_texts(spark.createDataFrame([(1, 0, None, "x"), (2, 0, "", "x"), (3, 1, "x", None)], "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.role, r.text) for r in texts) == [("", "x"), ("x", "")]


def test_trie_jobs_do_not_grow_with_the_longest_conversation(spark, monkeypatch):
    """As many written stages for 200 turns as for two; sums reach over all blocks."""
    written = []
    write = T.materialize
    monkeypatch.setattr(T, "materialize", lambda df, label: written.append(label) or write(df, label))
    stages = {}
    for n in (2, 200):
        written.clear()
        members = spark.createDataFrame([(1, n), (2, n), (3, n - 1)], "conv_id long, n_turns long")
        rows = [(c, p, bytearray(f"{p:016}".encode() + (1).to_bytes(4, "big"))) for c, m in ((1, n), (2, n), (3, n - 1)) for p in range(1, m + 1)]
        nodes, ends = T.prefix_trie(members, spark.createDataFrame(rows, "conv_id long, pos long, turn binary"))
        top = nodes.filter("depth = 0").collect()
        assert [(r.n_convs, r.n_leaves, r.saved_tokens) for r in top] == [(3, 1, 2 * (n - 1) + 1)]
        assert nodes.count() == n + 1 and ends.select("node").distinct().count() == 2
        stages[n] = list(written)
    assert stages[2] == stages[200]
