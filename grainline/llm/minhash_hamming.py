"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A document is the set of its distinct 4-word shingles; two link when
``100 * |A n B| >= 80 * |A u B|``.  The result is one row per document with its
component.

* Equal sets are one *class* (hash of the set), however many copies.
* A signature has 60 positions of 16 bits: the minima of the set under 60 hash
  functions.  The distance of two signatures is the number of positions that
  differ, on average ``60 * (1 - Jaccard)``.
* **Pigeonhole**: the positions are split into 10 chunks of 6.  Two signatures
  at distance 19 or less have a chunk with at most one error, so each class
  enumerates, for every chunk, the six ways of leaving one position out: 60
  keys.  All pairs within distance 19 share a key; of pairs beyond it those that
  share one are candidates too.  A pair at Jaccard 0.8 shares no key with
  probability 2.4e-5, at 0.85 with 3e-7.
* Candidates of similar size whose signatures are not too far apart
  (``FAR_APART``, 5 standard deviations beyond the mean at 0.8) are confirmed on
  the full sets, which are built again from the whole texts.
* **Large lists**: first each class meets the leaders of its lists (the member
  with the smallest hash), at most 60; what is linked then is one component and
  is not compared within itself.  Then all pairs of a list that lie in different
  components are compared inside tasks, a list cut into blocks and each pair of
  blocks a group of its own.  What leaves a task are the pairs whose signatures
  are near and whose bucket counts (an upper bound of the common shingles, exact)
  still allow a link, each from the first key that the pair shares.  Nothing is
  capped.

Defined cases: NULL or empty text and text without words have n_shingles 0 and
their own doc_id as component; NULL doc_id rows take part like any other and get
the smallest non-NULL doc_id of their component (NULL if none), ``kept`` is true
for them only in that last case; repeated rows are copies, all rows of a kept
doc_id are kept; sets of fewer than 4 shingles link with equal sets only (no
other can reach 0.8); an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainline.llm.components import connected_components
from grainline.llm.textnum import chunks, lower_ascii_table, mix64, word_bounds, word_hashes
from grainline.session import materialize, release

SHINGLE = 4
NUM, DEN = 80, 100
#: Chunks of the signature and positions of a chunk.
CHUNKS, SPAN = 10, 6
POSITIONS = CHUNKS * SPAN
#: Signatures that differ in more positions are not confirmed (a pair at 0.8 has
#: 12 on average, with a standard deviation of 3.1).
FAR_APART = 28
#: Smallest set that can link with another one.
LEAST = 4
#: Entries of a list that a task compares at once with as many others, and pairs
#: held at once.
BLOCK, PAIRS = 512, 100_000
#: Buckets of a set's counts; sets from LARGE shingles on have FINE times as many.
BUCKETS, LARGE, FINE = 256, 2048, 8
#: Class ids sent to the workers as a filter: at most this many (8 bytes each);
#: with more, the sets are joined to the ids instead.
FILTER_IDS = 2_000_000
_SPACES = (0x20, 9, 10, 11, 12, 13)


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, and a hash of each set."""
    is_space = np.zeros(256, bool)
    is_space[list(_SPACES)] = True
    low = lower_ascii_table()[data]
    is_word = ~is_space[low]
    starts, _, first = word_bounds(is_word, offs)
    h = word_hashes(low, is_word, starts, 13)
    factor = mix64(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
    sets, ids = [], np.zeros(len(offs) - 1, np.uint64)
    with np.errstate(over="ignore"):
        grams = np.zeros(max(len(h) - SHINGLE + 1, 0), np.uint64)
        for j, f in enumerate(factor):
            grams += h[j:j + len(grams)] * f
        grams = mix64(grams)
        for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
            if b - a >= SHINGLE:
                s = np.unique(grams[a:b - SHINGLE + 1])
            elif b > a:  # the whole sequence, told apart by its length
                s = mix64(np.array([(h[a:b] * factor[:b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                s = grams[:0]
            sets.append(s)
            ids[i] = mix64(s + np.uint64(0xA24BAED4963EE407)).sum() ^ np.uint64(len(s))
    return sets, mix64(ids)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16-bit minima (rows: sets, none empty; columns: positions)."""
    cat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    low, high = cat.astype(np.uint32), (cat >> np.uint64(32)).astype(np.uint32)
    factors = mix64(np.arange(1, 2 * POSITIONS + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    out = np.empty((len(sets), POSITIONS), np.uint16)
    with np.errstate(over="ignore"):
        for j in range(POSITIONS):
            x = low * factors[2 * j]
            x ^= x >> np.uint32(15)
            x *= factors[2 * j + 1]
            x ^= high
            x *= np.uint32(0x9E3779B1)
            least = np.minimum.reduceat(x, starts)
            out[:, j] = (mix64(least.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """(sets, CHUNKS * SPAN) 64-bit keys: each chunk without one position."""
    n = len(sig)
    place = mix64(np.arange(1001, 1001 + POSITIONS, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        # a position counts 1 more, so that 0 differs from a position left out
        part = mix64((sig.astype(np.uint64) + np.uint64(1)) * place).reshape(n, CHUNKS, SPAN)
        left = mix64(np.arange(5001, 5001 + POSITIONS, dtype=np.uint64)).reshape(1, CHUNKS, SPAN)
        return mix64(part.sum(2, keepdims=True) - part + left).reshape(n, POSITIONS)


def _signed(batches: Iterator) -> Iterator:
    import pyarrow as pa

    seen: set[int] = set()
    for batch in batches:
        for lo, hi, data, offs in chunks(batch.column(1)):
            sets, ids = shingle_sets(data, offs)
            fresh = []
            for i, (s, c) in enumerate(zip(sets, ids.tolist())):
                if len(s) >= LEAST and c not in seen:
                    seen.add(c)
                    fresh.append(i)
            sig, keys = [None] * len(sets), np.zeros(0, np.int64)
            count = np.zeros(len(sets), np.int64)
            if fresh:
                rows = signatures([sets[i] for i in fresh])
                for i, row in zip(fresh, rows):
                    sig[i] = row.tobytes()
                count[fresh] = POSITIONS
                keys = chunk_keys(rows).view(np.int64).ravel()
            size = np.array([len(s) for s in sets], np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(ids.view(np.int64), mask=size == 0), pa.array(size),
                                              pa.array(sig, pa.binary()), lists], ["doc_id", "node", "n", "sig", "keys"])


def _sets(wanted):
    """Sets of the texts whose class is in the sorted ids (all without)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = None if wanted is None else wanted.value
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offs in chunks(batch.column(0)):
                sets, ids = shingle_sets(data, offs)
                keep = np.array([len(s) >= LEAST for s in sets])
                if known is not None:
                    at = np.minimum(np.searchsorted(known, ids), max(len(known) - 1, 0))
                    keep &= known[at] == ids
                rows = []
                for i in np.flatnonzero(keep):
                    if (c := int(ids[i])) not in seen:
                        seen.add(c)
                        rows.append(i)
                if rows:
                    ends = pa.array(np.cumsum([0] + [len(sets[i]) for i in rows]), pa.int32())
                    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([sets[i] for i in rows]).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows].view(np.int64)), lists, pa.array([_sketch(sets[i]) for i in rows], pa.binary())],
                                                     ["node", "shingles", "sketch"])
    return run


def _sketch(s: np.ndarray) -> bytes | None:
    """Shingles of each bucket, one byte; None if a bucket holds too many."""
    width = BUCKETS * (FINE if len(s) >= LARGE else 1)
    count = np.bincount((s >> np.uint64(9)).astype(np.int64) % width, minlength=width)
    return count.astype(np.uint8).tobytes() if count.max() < 256 else None


def _class_sets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles, sketch) of the classes in ``nodes``, built from the texts again."""
    spark, count, wanted = texts.sparkSession, nodes.count(), None
    if 0 < count <= FILTER_IDS:
        wanted = spark.sparkContext.broadcast(np.sort(nodes.toPandas()["node"].to_numpy(np.int64).view(np.uint64)))
    sets = texts.mapInArrow(_sets(wanted), "node long, shingles array<long>, sketch binary")
    if wanted is None:
        sets = sets.join(nodes, "node", "left_semi")
    return materialize(sets.dropDuplicates(["node"]), "minhash-sets")


def _near(batches: Iterator) -> Iterator:
    """Pairs whose signatures differ in at most FAR_APART positions."""
    import pyarrow as pa

    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, POSITIONS) for c in ("sa", "sb"))
        near = pa.array((a != b).sum(1) <= FAR_APART)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in ("a", "b")], ["a", "b"])


def _allow(x: bytes | None, y: bytes | None, n: int) -> bool:
    """The bucket counts of two sets of n shingles in all allow a link."""
    if x is None or y is None:
        return True
    x, y = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if len(x) != len(y):  # fold the finer one
        x, y = (z.reshape(-1, BUCKETS).sum(0) for z in (x, y))
    common = int(np.minimum(x, y).sum())
    return DEN * common >= NUM * (n - common)


def _within(batches: Iterator) -> Iterator:
    """Pairs of different components from rows sorted by (key, lo, hi), the
    entries of one list (or of two blocks of it) after one another."""
    import pyarrow as pa

    names = ("key", "lo", "hi", "block", "pos", "node", "n", "root")

    def groups():
        """Column arrays of whole groups; the last group waits for more rows."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: batch.column(c).to_numpy() for c in names}
            cols["sig"] = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, POSITIONS)
            cols["sketch"] = np.array(batch.column("sketch").to_pylist() + [None], object)[:-1]
            held = cols if held is None else {c: np.concatenate([held[c], cols[c]]) for c in cols}
            new = np.flatnonzero((held["key"][1:] != held["key"][:-1]) | (held["lo"][1:] != held["lo"][:-1]) | (held["hi"][1:] != held["hi"][:-1])) + 1
            if len(new):
                yield {c: v[:new[-1]] for c, v in held.items()}, np.concatenate(([0], new))
                held = {c: v[new[-1]:] for c, v in held.items()}
        if held is not None:
            yield held, np.array([0, len(held["key"])])

    def compared(t, i, j):
        keep = (t["root"][i] != t["root"][j]) & (DEN * t["n"][i] >= NUM * t["n"][j]) & (DEN * t["n"][j] >= NUM * t["n"][i])
        keep &= (t["lo"][i] == t["hi"][i]) | (t["block"][i] != t["block"][j])
        i, j = i[keep], j[keep]
        errors = (t["sig"][i] != t["sig"][j]).reshape(-1, CHUNKS, SPAN).sum(2)
        chunk, place = np.divmod(t["pos"][i], SPAN)
        first = (errors <= 1).argmax(1) == chunk  # the first key that the pair shares
        first &= (errors[np.arange(len(i)), chunk] == 1) | (place == 0)
        keep = np.flatnonzero(first & (errors.sum(1) <= FAR_APART))
        out = [(x, y) for x, y in zip(i[keep].tolist(), j[keep].tolist()) if _allow(t["sketch"][x], t["sketch"][y], int(t["n"][x] + t["n"][y]))]
        ends = np.array(out, np.int64).reshape(-1, 2)
        a, b = t["node"][ends[:, 0]], t["node"][ends[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for t, starts in groups():
        left, right, count = [], [], 0
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            for x in range(lo, hi - 1, max(1, PAIRS // (hi - lo))):  # some rows against the rest of the group
                rows = np.arange(x, min(x + max(1, PAIRS // (hi - lo)), hi - 1))
                i = np.repeat(rows, hi - 1 - rows)
                left.append(i)
                right.append(np.arange(len(i)) - np.repeat(np.cumsum(hi - 1 - rows) - (hi - 1 - rows), hi - 1 - rows) + i + 1)
                count += len(i)
                if count >= PAIRS:
                    yield compared(t, np.concatenate(left), np.concatenate(right))
                    left, right, count = [], [], 0
        if count:
            yield compared(t, np.concatenate(left), np.concatenate(right))


def _confirmed(batches: Iterator) -> Iterator:
    """Pairs whose full sets link."""
    import pyarrow as pa

    for batch in batches:
        (oa, va), (ob, vb) = ((batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy().view(np.uint64)) for c in ("sa", "sb"))
        hit = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = va[oa[i]:oa[i + 1]], vb[ob[i]:ob[i + 1]]
            both = np.sort(np.concatenate([x, y]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            hit[i] = DEN * common >= NUM * (len(x) + len(y) - common)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(hit)) for c in ("a", "b")], ["a", "b"])


def _beside(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    sides = [table.select(F.col("node").alias(c), F.col(value).alias(f"s{c}")) for c in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sa", "sb")


def _near_pairs(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    return materialize(_beside(pairs, classes, "sig").mapInArrow(_near, "a long, b long"), "minhash-near")


def _links(sets: DataFrame, near: DataFrame) -> DataFrame:
    """Those of the (a, b) pairs whose full sets link, written."""
    out = materialize(_beside(near, sets, "shingles").mapInArrow(_confirmed, "a long, b long"), "minhash-links")
    release(near)
    return out


def _similar_size(a: str, b: str) -> F.Column:
    return (F.col(a) * DEN >= F.col(b) * NUM) & (F.col(b) * DEN >= F.col(a) * NUM)


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, roots): members has one row per input row (doc_id, node, n);
    roots maps each class with a link to another class to its component."""
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(docs.mapInArrow(_signed, f"doc_id {kind}, node long, n int, sig binary, keys array<long>"), "minhash-signed")
    classes = materialize(signed.filter("sig is not null").select("node", "n", "sig", "keys").dropDuplicates(["node"]), "minhash-classes")
    entries = classes.select(F.posexplode("keys").alias("pos", "key"), "node", "n")
    # the member of a list with the smallest hash leads it
    heads = (entries.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "n")).alias("head"), F.count(F.lit(1)).alias("c"))
             .filter("c > 1").select("key", F.col("head.node").alias("head"), F.col("head.n").alias("head_n")))
    lists = materialize(entries.join(heads, "key"), "minhash-lists")
    sets = _class_sets(docs.select("text"), materialize(lists.select("node").distinct(), "minhash-nodes"))

    # first pass: each class and the leaders of its lists
    led = lists.filter("node <> head").filter(_similar_size("n", "head_n")).select(*_ordered("node", "head")).distinct()
    links = _links(sets, _near_pairs(classes, led))
    roots = materialize(connected_components(links, "a", "b"), "minhash-roots")

    # second pass: all pairs of a list that lie in different components
    placed = (lists.select("key", "pos", "node", "n").join(roots.select("node", F.col("root").alias("r")), "node", "left")
              .withColumn("root", F.coalesce("r", "node")).drop("r"))
    several = placed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key", "c")
    blocks = F.ceil(F.col("c") / F.lit(float(BLOCK)))
    placed = (placed.join(several, "key").withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "pos", "node", "n", "root"))
    full = placed.join(classes.select("node", "sig"), "node").join(sets.select("node", "sketch"), "node")
    near = full.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_within, "a long, b long")
    more = _links(sets, materialize(near, "minhash-near"))
    roots = materialize(connected_components(links.union(more), "a", "b"), "minhash-roots")
    release(lists, classes, sets, links, more)
    return signed.select("doc_id", "node", "n"), roots


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    members, roots = near_duplicates(docs, id_col, text_col)
    classes = members.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("low")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # written, so that the join below has a shuffle of its own that AQE may split
    low = materialize(classes.groupBy("root").agg(F.min("low").alias("component_id")), "minhash-low")
    table = classes.select("node", "root").join(low, "root").select("node", "component_id")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return (members.join(table, "node", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
