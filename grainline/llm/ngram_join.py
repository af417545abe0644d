"""N-gram Jaccard self-join of whole texts: size-aware, heavy and light.

A document is the set of its distinct 5-word shingles (64-bit hashes); two
documents link when ``100 * |A n B| >= 75 * |A u B|``.  The result is one row
per document with its component, so links are followed, not listed.

* Equal sets are one *class* (hash of the set), however many copies.
* **Light sets** (size <= boundary): every pair of sizes (s, t) has a smallest
  linking overlap c(s, t).  Each set enumerates its c-subsets; two sets link
  exactly when they share one, so a shared subset needs no check.
* **Heavy sets**: inverted lists over the ``n - ceil(0.75 n) + 1`` first
  shingles of each set in one global order (any pair that links shares one).
  The order puts the most frequent shingles of the corpus last, so a passage
  that many texts share stays out of nearly all lists.  First each
  class is compared with one pivot of its lists (a class with a small share
  of rare shingles); then all entries whose sizes and places still allow a
  link between two components are compared with each other.  Members that a
  verified link has joined already are not.  Nothing is capped.
* The boundary is chosen by cost: subsets to enumerate against list entries
  times ``SCAN_COST``, from the size histogram of all classes.

Defined cases: NULL or empty text and text without words have n_shingles 0
and their own doc_id as component; NULL doc_id rows take part like any other
and get the smallest non-NULL doc_id of their component (NULL if none);
repeated rows are copies; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grainline.llm.components import connected_components
from grainline.llm.textnum import chunks, lower_ascii_table, mix64, word_bounds, word_hashes
from grainline.session import materialize, release

SHINGLE = 5
NUM, DEN = 75, 100
#: The most frequent shingles that the global order puts last.  Any order is
#: exact; this bounds the one broadcast of the job (8 bytes a shingle).
ORDER_LIMIT = 500_000
#: A shingle is listed as frequent from this many classes on.
FREQUENT = 16
#: Shingles that a task counts at once; beyond that, those met once go first
#: (the counts only make the order, and any order is exact).
HELD = 1_500_000
#: Light sets have at most this many shingles, whatever the cost says.
LIGHT_MAX = 12
SCAN_COST = 4.0
#: Class ids sent to the workers as a filter: at most this many (8 bytes
#: each); with more, the texts are joined to the ids instead.
FILTER_IDS = 2_000_000

#: Buckets of a sketch (16 times as many for sets of over 8 a bucket).
BUCKETS = 256

_SPACES = (0x20, 9, 10, 11, 12, 13)


def _u(x: int) -> np.uint64:
    return np.uint64(x)


def text_sets(data: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingle hashes of each text and the class hash."""
    n = len(offs) - 1
    table = np.ones(256, dtype=bool)
    table[list(_SPACES)] = False
    low = lower_ascii_table()[data]
    is_word = table[low]
    starts, _, first = word_bounds(is_word, offs)
    h = word_hashes(low, is_word, starts)
    mult = mix64(np.arange(11, 11 + SHINGLE, dtype=np.uint64)) | _u(1)
    with np.errstate(over="ignore"):
        m = max(len(h) - SHINGLE + 1, 0)
        grams = np.zeros(m, np.uint64)
        for k in range(SHINGLE):
            grams += h[k:k + m] * mult[k]
        grams = mix64(grams)
        sets, ids = [], np.zeros(n, np.uint64)
        for i in range(n):
            a, b = first[i], first[i + 1]
            if b - a >= SHINGLE:
                s = grams[a:b - SHINGLE + 1]
                s = s.copy()
                s.sort()
                if len(s) > 1:
                    s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                s = mix64(np.array([(h[a:b] * mult[:b - a]).sum() + _u(int(b - a))], np.uint64))
            else:
                s = np.zeros(0, np.uint64)
            sets.append(s)
            ids[i] = mix64(s ^ _u(0x5851F42D4C957F2D)).sum() + _u(len(s))
    return sets, mix64(ids)


def min_overlap(a: int, b: int) -> int:
    """Smallest |A n B| with 100 * o >= 75 * (a + b - o)."""
    return -(-NUM * (a + b) // (NUM + DEN))


def prefix_len(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def _partners(s: int, boundary: int) -> range:
    return range(max(1, -(-NUM * s // DEN)), min(boundary, DEN * s // NUM) + 1)


def subset_count(s: int, boundary: int) -> int:
    return sum(comb(s, min_overlap(s, t)) for t in _partners(s, boundary) if min_overlap(s, t) <= min(s, t))


def choose_boundary(histogram: dict[int, int]) -> int:
    """Largest size whose subset enumeration costs no more than scanning its
    lists would (entries times SCAN_COST, verification included)."""
    best = 0
    for b in range(1, LIGHT_MAX + 1):
        rows = sum(histogram.get(s, 0) * subset_count(s, b) for s in range(1, b + 1))
        scan = sum(histogram.get(s, 0) * prefix_len(s) for s in range(1, b + 1)) * SCAN_COST
        if rows <= scan:
            best = b
    return best


def _frequent(batches: Iterator) -> Iterator:
    """Shingles that at least two classes of this task hold, with counts."""
    import pyarrow as pa

    seen: set[int] = set()
    vals, cnts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pending, held = [], 0

    def merge():
        nonlocal vals, cnts, pending, held
        u, c = np.unique(np.concatenate(pending), return_counts=True)
        at = np.searchsorted(vals, u)
        old = at < len(vals)
        old[old] = vals[at[old]] == u[old]
        cnts[at[old]] += c[old]
        vals, cnts = np.insert(vals, at[~old], u[~old]), np.insert(cnts, at[~old], c[~old])
        if len(vals) > HELD:
            keep = cnts > 1
            vals, cnts = vals[keep], cnts[keep]
        pending, held = [], 0

    for batch in batches:
        for _, _, data, offs in chunks(batch.column(0)):
            sets, ids = text_sets(data, offs)
            for s, i in zip(sets, ids.tolist()):
                if len(s) and i not in seen:
                    seen.add(i)
                    pending.append(s)
                    held += len(s)
            if held > HELD // 4:
                merge()
    if pending:
        merge()
    keep = cnts > 1
    yield pa.RecordBatch.from_arrays([pa.array(vals[keep].view(np.int64)), pa.array(cnts[keep])], ["key", "df"])


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The at most ORDER_LIMIT most frequent shingles, by hash, with counts."""
    rows = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_frequent, "key long, df long")
            .groupBy("key").agg(F.sum("df").alias("df")).filter(F.col("df") >= FREQUENT)
            .orderBy(F.desc("df"), "key").limit(ORDER_LIMIT).toPandas())
    keys = rows["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows["df"].to_numpy(np.int64)[order]


def _in_order(s: np.ndarray, keys: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """The first k of a set in the global order, and how many of the whole
    set are listed as frequent (these come last)."""
    if not len(keys):
        return s[:k], 0
    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
    df = np.where(keys[at] == s, counts[at], 0)
    listed = int((df > 0).sum())
    if listed and k > len(s) - listed or df[:k].any():
        s = s[np.argsort(df, kind="stable")]
    return s[:k], listed


def _signer(keys_b, counts_b):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keys, counts = keys_b.value, counts_b.value
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(1)):
                sets, ids = text_sets(data, offs)
                first = []
                rare, listed = np.zeros(len(sets), np.int32), np.zeros(len(sets), np.int32)
                sketch = [None] * len(sets)
                for i, (s, c) in enumerate(zip(sets, ids.tolist())):
                    if not len(s) or c in seen:
                        first.append(s[:0])
                        continue
                    seen.add(c)
                    # light sets whole: the boundary is not known yet
                    k = len(s) if len(s) <= LIGHT_MAX else prefix_len(len(s))
                    p, listed[i] = _in_order(s, keys, counts, k)
                    rare[i] = 1000 * (len(s) - listed[i]) // len(s)
                    first.append(p)
                    width = BUCKETS if len(s) < 8 * BUCKETS else 16 * BUCKETS
                    sketch[i] = np.bincount((s >> _u(7)).astype(np.int64) % width, minlength=width).astype(np.uint16).tobytes()
                k = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in first]), pa.int32()),
                                             pa.array(np.concatenate(first).view(np.int64)))
                size = np.array([len(s) for s in sets], np.int32)
                node = pa.array(ids.view(np.int64), mask=size == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), node, pa.array(size), pa.array(rare), pa.array(listed), k,
                                                  pa.array(sketch, pa.binary())],
                                                 ["doc_id", "node", "n", "rare", "listed", "keys", "sketch"])
    return run


def _sets_of(ids_b):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        wanted = None if ids_b is None else ids_b.value
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offs in chunks(batch.column(0)):
                sets, ids = text_sets(data, offs)
                keep = []
                for i, c in enumerate(ids.tolist()):
                    if len(sets[i]) and c not in seen:
                        if wanted is not None:
                            at = np.searchsorted(wanted, _u(c))
                            if at == len(wanted) or wanted[at] != _u(c):
                                continue
                        seen.add(c)
                        keep.append(i)
                if keep:
                    off = pa.array(np.cumsum([0] + [len(sets[i]) for i in keep]), pa.int32())
                    vals = pa.array(np.concatenate([sets[i] for i in keep]).view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[keep].view(np.int64)), pa.ListArray.from_arrays(off, vals)],
                                                     ["node", "shingles"])
    return run


def _possible(batches: Iterator) -> Iterator:
    """Pairs whose sketches allow a link."""
    import pyarrow as pa

    for batch in batches:
        hit = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())):
            x, y = np.frombuffer(x, np.uint16).astype(np.int64), np.frombuffer(y, np.uint16).astype(np.int64)
            if len(x) != len(y):  # fold the finer one
                x, y = (z.reshape(-1, BUCKETS).sum(0) for z in (x, y))
            o = int(np.minimum(x, y).sum())
            hit[i] = DEN * o >= NUM * (int(x.sum()) + int(y.sum()) - o)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(hit)), batch.column("b").filter(pa.array(hit))], ["a", "b"])


def _overlaps(batches: Iterator) -> Iterator:
    """Exact overlap of each pair of sorted sets."""
    import pyarrow as pa

    for batch in batches:
        cols = []
        for name in ("sa", "sb"):
            c = batch.column(name)
            cols.append((c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False).view(np.uint64)))
        (oa, va), (ob, vb) = cols
        hit = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = va[oa[i]:oa[i + 1]], vb[ob[i]:ob[i + 1]]
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            o = int((both[1:] == both[:-1]).sum())
            hit[i] = DEN * o >= NUM * (len(x) + len(y) - o)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(hit)], ["a", "b", "linked"])


def _both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """(a, b, sa, sb): each pair with its two classes' values."""
    return (pairs.join(table.select(F.col("node").alias("a"), F.col(value).alias("sa")), "a")
            .join(table.select(F.col("node").alias("b"), F.col(value).alias("sb")), "b").select("a", "b", "sa", "sb"))


def _verified(docs: DataFrame, sketches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the (a, b) pairs whose sets link, written.  Sets are built
    again from the texts of the classes that occur in a pair, once a class."""
    spark = docs.sparkSession
    open_pairs = materialize(_both(pairs, sketches, "sketch").mapInArrow(_possible, "a long, b long"), "join-pairs")
    ids = materialize(open_pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "join-ids")
    n = ids.count()
    texts = docs.select(F.col("text").cast("string").alias("text"))
    wanted = None
    if n <= FILTER_IDS:
        wanted = spark.sparkContext.broadcast(np.sort(ids.toPandas()["node"].to_numpy(np.int64).view(np.uint64)))
    if not n:
        return open_pairs
    sets = texts.mapInArrow(_sets_of(wanted), "node long, shingles array<long>").dropDuplicates(["node"])
    if wanted is None:
        sets = sets.join(ids, "node", "left_semi")
    sets = materialize(sets, "join-sets")
    out = materialize(_both(open_pairs, sets, "shingles").mapInArrow(_overlaps, "a long, b long, linked boolean")
                      .filter("linked").select("a", "b"), "join-found")
    release(open_pairs, ids, sets)
    return out


def _light_subsets(boundary: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            nodes, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out_n, out_k, out_s, out_p = [], [], [], []
            for node, keys in zip(nodes, lists):
                s, keys = len(keys), sorted(keys)
                for t in _partners(s, boundary):
                    c = min_overlap(s, t)
                    if c > min(s, t):
                        continue
                    tag = f"{min(s, t)}:{max(s, t)}:"
                    for sub in combinations(keys, c):
                        out_n.append(node)
                        out_k.append(tag + ",".join(map(str, sub)))
                        out_s.append(int(s > t))
                        out_p.append(int(s < t))
            yield pa.RecordBatch.from_arrays([pa.array(out_k, pa.string()), pa.array(out_n, pa.int64()),
                                              pa.array(out_s, pa.int32()), pa.array(out_p, pa.int32())],
                                             ["subset", "node", "side", "other"])
    return run


def _fits(na: str, ma: str, nb: str, mb: str) -> F.Column:
    """Sizes and places allow a link.  An entry at place p of a set of n (in
    the global order) can be the first common shingle of a linked pair only
    if n - p reaches the smallest linking overlap, which bounds the partner's
    size (``most``)."""
    return (F.col(na) <= F.col(mb)) & (F.col(nb) <= F.col(ma))


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, roots): members has one row per input row (doc_id, node, n);
    roots maps each class with a link to another class to its component."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keys, counts = frequent_shingles(docs)
    bk, bc = spark.sparkContext.broadcast(keys), spark.sparkContext.broadcast(counts)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = materialize(docs.mapInArrow(_signer(bk, bc), f"doc_id {id_type}, node long, n int, rare int, listed int, keys array<long>, sketch binary"),
                         "join-signed")
    members = signed.select("doc_id", "node", "n")
    classes = signed.filter(F.size("keys") > 0)
    sketches = materialize(classes.select("node", "sketch").dropDuplicates(["node"]), "join-sketches")
    small = classes.filter(F.col("n") <= LIGHT_MAX).select("node", "n", "keys").distinct()
    histogram = {r["n"]: r["count"] for r in small.groupBy("n").count().collect()}
    boundary = choose_boundary(histogram)

    # light sets: a subset shared by sets of the two sizes it stands for is a
    # link; each set is tied to the smallest class on the other side
    edges = []
    if boundary:
        subsets = (small.filter(F.col("n") <= boundary).select("node", "keys")
                   .mapInArrow(_light_subsets(boundary), "subset string, node long, side int, other int"))
        low = subsets.groupBy("subset", F.col("side").alias("other")).agg(F.min("node").alias("m"))
        edges.append(subsets.join(low, ["subset", "other"]).filter("m <> node")
                     .select(F.least("m", "node").alias("a"), F.greatest("m", "node").alias("b")).distinct())

    # heavy sets (and light ones that may link to a heavy one): inverted lists
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(NUM) / DEN).cast("int") + 1
    entries = (classes.filter(F.col("n") * DEN >= NUM * (boundary + 1))
               .select("node", "n", "rare", "listed", F.posexplode("keys").alias("pos", "key")).filter(F.col("pos") < prefix)
               .withColumn("listed", F.col("pos") >= F.col("n") - F.col("listed"))
               .withColumn("most", F.least(F.floor(F.col("n") * DEN / F.lit(NUM)), F.floor((F.col("n") - F.col("pos")) * (NUM + DEN) / F.lit(NUM)) - F.col("n"))))
    entry = F.struct("rare", "node", "n", "most")
    # a list of one frequent shingle: its pivot by a map-side minimum, so the
    # list itself may be split over tasks
    hot = entries.filter("listed")
    hot_lists = hot.join(hot.groupBy("key").agg(F.min(entry).alias("top")), "key")
    # the many short lists: pivot and single entries in one sorted pass
    w = W.partitionBy("key").orderBy("rare", "node")
    short = (entries.filter("not listed").withColumn("top", F.first(entry).over(w))
             .withColumn("prev", F.lag("node").over(w)).withColumn("next", F.lead("node").over(w))
             .filter("node <> top.node or next is not null").filter("prev is null or prev <> node"))
    cols = ["key", "rare", "node", "n", "most", "top"]
    shared = materialize(short.select(*cols).union(hot_lists.select(*cols)), "join-lists")

    # first scan: the pivot of a list is the class with the smallest share of
    # rare shingles; each class is compared with the best pivot of its lists
    near = _best_pivots(shared.select("node", "n", "most", "top"))
    links = _found(docs, sketches, near)
    if edges:
        links = links.union(edges[0])
    links = materialize(links.distinct(), "join-links")
    roots = materialize(connected_components(links, "a", "b"), "join-roots")

    # second scan: all that is left, pair by pair.  One side is outside its
    # list's main component, so a group that is joined already is not
    # compared within itself.
    lists = _open(shared, roots)
    x, y = (lists.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "most", "root", "main")]) for s in "ab")
    pairs = x.filter("root_a <> main_a").join(y, "key").filter(
        (F.col("root_a") != F.col("root_b")) & _fits("n_a", "most_a", "n_b", "most_b")
        & ((F.col("root_b") == F.col("main_b")) | (F.col("node_a") < F.col("node_b"))))
    pairs = pairs.select(F.col("node_a").alias("a"), F.col("n_a").alias("na"), F.col("most_a").alias("ma"),
                         F.col("node_b").alias("b"), F.col("n_b").alias("nb"), F.col("most_b").alias("mb"))
    more = _found(docs, sketches, pairs)
    roots = materialize(connected_components(links.union(more), "a", "b"), "join-roots")
    release(shared, lists, sketches, links, more)
    return members, roots


def _best_pivots(rows: DataFrame) -> DataFrame:
    """One candidate pair a class: with the best of its pivots (top) that its
    size and place allow."""
    fit = rows.filter((F.col("node") != F.col("top.node")) & _fits("n", "most", "top.n", "top.most"))
    best = fit.groupBy("node").agg(F.min(F.struct("top", "n", "most")).alias("p"))
    return best.select(F.col("p.top.node").alias("a"), F.col("p.top.n").alias("na"), F.col("p.top.most").alias("ma"),
                       F.col("node").alias("b"), F.col("p.n").alias("nb"), F.col("p.most").alias("mb"))


def _open(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries that may still join two components: of lists with several, and
    with a list member small enough for the entry's largest partner size."""
    r = roots.select("node", F.col("root").alias("r"))
    rows = (lists.join(r, "node", "left")
            .select("key", "rare", "node", "n", "most", F.coalesce("r", "node").alias("root")))
    per = rows.groupBy("key").agg(F.min("n").alias("least"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1")
    rows = rows.join(per.select("key", "least"), "key").filter("most >= least").drop("least")
    several = (rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key")
               .agg(F.max(F.struct("c", "root")).getField("root").alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1"))
    return materialize(rows.join(several.select("key", "main"), "key"), "join-open")


def _found(docs: DataFrame, sketches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Linked pairs among candidates (a, na, ma, b, nb, mb)."""
    pairs = pairs.filter((F.col("a") != F.col("b")) & _fits("na", "ma", "nb", "mb")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _verified(docs, sketches, pairs)


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    members, roots = similarity_classes(docs, id_col, text_col)
    classes = members.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"))
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # written, so that the join below has a shuffle of its own that AQE may split
    low = materialize(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "join-low")
    table = rooted.select("node", "root").join(low, "root").select("node", "component_id")
    return members.join(table, "node", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest
    (doc_id, md5 of the text), NULL ids last (rows that repeat an id and a
    text count once).  Rows without words are no copies of each other and
    stay; they count once if they repeat a doc_id and a text."""
    key = F.struct(F.col(id_col).alias("id"), F.unhex(F.md5(F.col(text_col).cast("string"))).alias("digest"))
    members, roots = similarity_classes(docs.select(key.alias("_row"), F.col(text_col).alias("_text")), "_row", "_text")
    members = members.select("doc_id.id", "doc_id.digest", "node")
    classes = members.filter("node is not null").groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "digest")).alias("low"))
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # written, so that the join below has a shuffle of its own that AQE may split
    low = materialize(rooted.groupBy("root").agg(F.min("low").alias("low")), "join-low")
    table = rooted.select("node", "root").join(low, "root").select("node", F.col("low.id").alias("id0"), F.col("low.digest").alias("digest0"))
    gone = (members.join(table, "node").filter(~(F.col("id").eqNullSafe(F.col("id0")) & (F.col("digest") == F.col("digest0"))))
            .select("id", "digest").distinct())
    kept = _matching(docs.withColumn("_digest", F.unhex(F.md5(F.col(text_col).cast("string")))), materialize(gone, "join-gone"), id_col, "left_anti")
    again = materialize(members.filter("id is not null or node is not null").groupBy("id", "digest").count().filter("count > 1").select("id", "digest"), "join-again")
    if not again.head(1):
        return kept.drop("_digest")
    once = _matching(kept, again, id_col, "left_semi").dropDuplicates([id_col, "_digest"])
    return _matching(kept, again, id_col, "left_anti").unionByName(once).drop("_digest")


def _matching(docs: DataFrame, keys: DataFrame, id_col: str, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` with (id, digest) rows, NULLs equal."""
    keys = keys.select(F.col("id").alias("_id"), F.col("digest").alias("_d"))
    if keys.count() <= FILTER_IDS // 4:  # 24 bytes each
        keys = F.broadcast(keys)
    return docs.join(keys, docs[id_col].eqNullSafe(F.col("_id")) & docs["_digest"].eqNullSafe(F.col("_d")), how)
