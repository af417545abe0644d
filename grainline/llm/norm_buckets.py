"""Ranked lexical search by norm buckets: exact top k of integer impacts.

A document is the vector of its terms' impacts ``w * ((10^9 tf) div (1000 tf +
12 m))``, an item the vector of its terms' multiplicities; the score is their
product.  Only terms that some item holds are coordinates.

1. Texts are tokenised once.  What is written are (terms, counts) of each text
   and, per task, the number of texts, of terms, and of texts holding a term;
   their sums give the weights.
2. Vectors are ordered by length and cut into buckets.  A first bucket of the
   longest vectors gives every item a threshold, the k-th best score so far.
3. Each task orders its vectors by length, longest first.  Cauchy-Schwarz
   (length of the item times greatest length of the bucket) leaves out whole
   buckets; the greatest value of each coordinate in the bucket leaves out
   items; inside, each document is bounded by its exact product over the rare
   terms (focus coordinates) plus Cauchy-Schwarz over the frequent ones.
4. Survivors are scored in 64-bit integers, thresholds rise, and at most k rows
   of an item leave a task (all ties at the k-th place by doc_id are settled).

Items are taken in blocks whose (item, term) pairs are counted and bounded
(``POSTINGS``, or one item), so what is sent to the workers is bounded; each
block reads the texts again.  Terms are compared by 64-bit hashes.

Defined cases: a NULL or empty text has no terms, counts for no statistic and
is never found; an item without terms or without any document of positive
score has no rows; repeated benchmark rows count once, different texts under
one item_id (NULL is one too) are one item of all their terms; every document
row is ranked by itself, equal scores by ascending doc_id, NULL last; very long
texts are whole; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor, log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grainline.llm.textnum import chunks, lower_ascii_table, word_bounds, word_hashes
from grainline.session import materialize, release

TOP = 20
#: (item, term) pairs of a block of items, which the workers hold (some 20 bytes each).
POSTINGS = 400_000
#: Documents of a bucket, and of the first bucket.
BUCKET = 256
#: Documents that a task orders at once, and their coordinates at most.
PANEL_ROWS, PANEL_CELLS = 16_384, 2_000_000
#: A term that this share of a block's items holds is a frequent one.
FREQUENT = 0.125
#: Bounds are computed in doubles; this factor covers their rounding.
SLACK = 1 + 1e-9


def _terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of the texts in order, and the index of each text's first."""
    table = np.zeros(256, bool)
    for lo, hi in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
        table[lo:hi] = True
    low = lower_ascii_table()[data]
    is_word = table[low]
    starts, _, first = word_bounds(is_word, offs)
    return word_hashes(low, is_word, starts), first


def _item_terms(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for lo, hi, data, offs in chunks(batch.column(1)):
            h, first = _terms(data, offs)
            for i in range(hi - lo):
                u, c = np.unique(h[first[i]:first[i + 1]], return_counts=True)
                if len(u):
                    ids = batch.column(0).take(pa.array(np.full(len(u), lo + i)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(u.view(np.int64)), pa.array(c)], ["item_id", "term", "q"])


def item_blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """(block, item_id, term, q) and the number of blocks, each of at most
    2 * POSTINGS rows or of one item."""
    kind = items.schema["item_id"].dataType.simpleString()
    pairs = (items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
             .mapInArrow(_item_terms, f"item_id {kind}, term long, q long").groupBy("item_id", "term").agg(F.sum("q").alias("q")))
    pairs = materialize(pairs, "search-items")
    sizes = materialize(pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")), "search-sizes")
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    n = max(1, ceil(total / POSTINGS))
    while True:
        block = F.pmod(F.xxhash64("item_id"), F.lit(n))
        over = sizes.groupBy(block.alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")).filter(f"n > {2 * POSTINGS} and c > 1")
        if n >= 64 * ceil(total / POSTINGS) or not over.head(1):
            return pairs.withColumn("block", block), n if total else 0
        n *= 2


def _vectors(vocabulary):
    """Rows (kind, doc_id, n, terms, counts): of kind 0 a text, at the end of a
    task of kind 1 the texts holding each term and their number, of kind 2
    the number of all terms."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        vocab = vocabulary.value
        size, texts, total = len(vocab), 0, 0
        df = np.zeros(size, np.int64)

        def rows(kind, ids, n, ends, terms, counts):
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.astype(np.int32))) for x in (terms, counts)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), ids, pa.array(n, pa.int64()), *lists], ["kind", "doc_id", "n", "terms", "counts"])

        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(1)):
                h, first = _terms(data, offs)
                n = np.diff(first)
                texts += int((n > 0).sum())
                total += int(n.sum())
                at = np.minimum(np.searchsorted(vocab, h), size - 1)
                hit = vocab[at] == h
                doc = np.repeat(np.arange(hi - lo), n)[hit]
                cell, count = np.unique(doc * size + at[hit], return_counts=True)
                doc, term = np.divmod(cell, size)
                df += np.bincount(term, minlength=size)
                full = np.unique(doc)
                if len(full):
                    ends = np.append(np.searchsorted(doc, full), len(doc))
                    yield rows(0, batch.column(0).take(pa.array(lo + full)), n[full], ends, term, count)
        held = np.flatnonzero(df)
        for k in range(0, max(len(held), 1), 100_000):  # one list element a held term
            part = held[k:k + 100_000]
            yield rows(1, pa.array([None], pa.int64()), [texts if k == 0 else 0], [0, len(part)], part, df[part])
        yield rows(2, pa.array([None], pa.int64()), [total], [0, 0], held[:0], held[:0])
    return run


class _Panel:
    """Impact vectors of some documents, longest first."""

    def __init__(self, items: dict, ids, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray):
        m = 75 + (25 * n * items["docs"]) // items["terms"]
        per = np.diff(ends)
        counts = counts.astype(np.int64)
        impact = items["w"][terms] * ((1_000_000_000 * counts) // (1000 * counts + 12 * np.repeat(m, per)))
        row = np.repeat(np.arange(len(n)), per)
        square = impact.astype(np.float64) ** 2
        norm = np.sqrt(np.bincount(row, square, len(n)))
        rest = np.sqrt(np.bincount(row, np.where(items["slot"][terms] >= 0, square, 0.0), len(n)))
        order = np.argsort(-norm, kind="stable")
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        cells = np.argsort(place[row], kind="stable")
        self.row, self.term, self.impact = place[row][cells], terms[cells], impact[cells]
        self.norm, self.rest, self.ids, self.order = norm[order], rest[order], ids, order


def _panels(items: dict, batches: Iterator) -> Iterator[_Panel]:
    import pyarrow as pa

    held, rows, cells = [], 0, 0

    def flush():
        ids = pa.concat_arrays([x[0] for x in held])
        ends = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[2]) for x in held]))])
        return _Panel(items, ids, np.concatenate([x[1] for x in held]), ends, np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held]))

    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            part = batch.slice(k, 1024)
            ids, n, terms, counts = (part.column(c) for c in ("doc_id", "n", "terms", "counts"))
            held.append((ids, n.to_numpy(), terms.offsets.to_numpy(), terms.flatten().to_numpy(), counts.flatten().to_numpy()))
            rows, cells = rows + part.num_rows, cells + len(held[-1][3])
            if rows >= PANEL_ROWS or cells >= PANEL_CELLS:
                yield flush()
                held, rows, cells = [], 0, 0
    if rows:
        yield flush()


def _postings(items: dict, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of ``term`` the postings of it: (entry, posting)."""
    per = items["start"][term + 1] - items["start"][term]
    entry = np.repeat(np.arange(len(term)), per)
    skip = np.repeat(np.cumsum(per) - per, per)
    return entry, np.repeat(items["start"][term], per) + np.arange(len(entry)) - skip


class _Best:
    """The k best documents of each item so far, and the scores to reach."""

    def __init__(self, items: dict, k: int):
        self.k, self.reach = k, items["reach"].copy()
        self.item, self.score, self.null, self.doc = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, item, score, null, doc):
        item, score, null, doc = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.null, null), (self.doc, doc)))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        first = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
        rank = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        order = order[rank < self.k]
        kth = rank == self.k - 1
        self.item, self.score, self.null, self.doc = item[rank < self.k], score[order], null[order], doc[order]
        at = np.flatnonzero(kth[rank < self.k])
        np.maximum.at(self.reach, self.item[at], self.score[at])


def _search(items: dict, panel: _Panel, best: _Best) -> None:
    import pyarrow.compute as pc

    n_items = len(items["norm"])
    null = pc.is_null(panel.ids).to_numpy(zero_copy_only=False)[panel.order]
    doc = pc.fill_null(panel.ids, 0).to_numpy()[panel.order]
    for lo in range(0, len(panel.norm), BUCKET):
        hi = min(lo + BUCKET, len(panel.norm))
        active = items["norm"] * (panel.norm[lo] * SLACK) >= best.reach
        if not active.any():
            return  # all later vectors are shorter
        a, b = np.searchsorted(panel.row, [lo, hi])
        row, term, impact = panel.row[a:b] - lo, panel.term[a:b], panel.impact[a:b]
        # the greatest value of each coordinate
        present, where = np.unique(term, return_inverse=True)
        most = np.zeros(len(present), np.int64)
        np.maximum.at(most, where, impact)
        entry, at = _postings(items, present)
        bound = np.bincount(items["item"][at], items["q"][at] * most[entry].astype(np.float64), n_items) * SLACK
        active &= (bound >= best.reach) & (bound > 0)
        chosen = np.flatnonzero(active)
        if not len(chosen):
            continue
        place = np.full(n_items, -1)
        place[chosen] = np.arange(len(chosen))
        # exact over the focus coordinates
        slot = items["slot"][term]
        focus = slot < 0
        entry, at = _postings(items, term[focus])
        mine = place[items["item"][at]]
        entry, at, mine = entry[mine >= 0], at[mine >= 0], mine[mine >= 0]
        exact = np.zeros(len(chosen) * (hi - lo), np.int64)
        np.add.at(exact, mine * (hi - lo) + row[focus][entry], items["q"][at] * impact[focus][entry])
        exact = exact.reshape(len(chosen), hi - lo)
        bound = (exact + np.outer(items["rest"][chosen], panel.rest[lo:hi])) * SLACK
        i, d = np.nonzero((bound >= best.reach[chosen][:, None]) & (bound > 0))
        if not len(i):
            continue
        # survivors, in integers
        score = exact[i, d]
        dense = np.zeros((hi - lo, items["often"].shape[1]), np.int64)
        dense[row[~focus], slot[~focus]] = impact[~focus]
        for k in range(0, len(i), 8192):
            score[k:k + 8192] += (items["often"][chosen[i[k:k + 8192]]] * dense[d[k:k + 8192]]).sum(1)
        keep = (score > 0) & (score >= best.reach[chosen[i]])
        if keep.any():
            best.add(chosen[i[keep]].astype(np.int32), score[keep], null[lo + d[keep]], doc[lo + d[keep]])


def _longest(items_b, count: int):
    """The task's ``count`` longest vectors with their length."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            items = items_b.value
            terms, counts, n = batch.column("terms"), batch.column("counts").flatten().to_numpy(), batch.column("n").to_numpy()
            per = np.diff(terms.offsets.to_numpy())
            m = 75 + (25 * n * items["docs"]) // items["terms"]
            c = counts.astype(np.int64)
            impact = items["w"][terms.flatten().to_numpy()] * ((1_000_000_000 * c) // (1000 * c + 12 * np.repeat(m, per)))
            norm = np.sqrt(np.bincount(np.repeat(np.arange(len(n)), per), impact.astype(np.float64) ** 2, len(n)))
            top = pa.array(np.argsort(-norm, kind="stable")[:count])
            part = pa.Table.from_batches([batch]).append_column("length", pa.array(norm)).take(top)
            kept = part if kept is None else pa.concat_tables([kept, part]).sort_by([("length", "descending")]).slice(0, count)
        if kept is not None:
            yield from kept.combine_chunks().to_batches()
    return run


def _scorer(items_b, k: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        items = items_b.value
        best = _Best(items, k)
        for panel in _panels(items, batches):
            _search(items, panel, best)
        for a in range(0, len(best.item), 10_000):
            s = slice(a, a + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(best.item[s]), pa.array(best.doc[s], mask=best.null[s]), pa.array(best.score[s])], ["item", "doc_id", "score"])
    return run


def _block_items(pairs) -> tuple[dict, np.ndarray]:
    """Arrays of a block's items, and the sorted term hashes."""
    vocab = np.unique(pairs["term"].to_numpy().view(np.uint64))
    term = np.searchsorted(vocab, pairs["term"].to_numpy().view(np.uint64))
    item, q = pairs["item"].to_numpy().astype(np.int32), pairs["q"].to_numpy()
    order = np.lexsort((item, term))
    term, item, q = term[order], item[order], q[order]
    n = int(item.max()) + 1
    start = np.searchsorted(term, np.arange(len(vocab) + 1))
    often = np.flatnonzero(np.diff(start) > max(FREQUENT * n, 1))
    slot = np.full(len(vocab), -1)
    slot[often] = np.arange(len(often))
    dense = np.zeros((n, max(len(often), 1)), np.int64)
    is_often = slot[term] >= 0
    dense[item[is_often], slot[term[is_often]]] = q[is_often]
    square = q.astype(np.float64) ** 2
    return {"start": start, "item": item, "q": q, "slot": slot, "often": dense, "norm": np.sqrt(np.bincount(item, square, n)),
            "rest": np.sqrt(np.bincount(item, np.where(is_often, square, 0.0), n)), "reach": np.zeros(n, np.int64)}, vocab


def _weights(stats: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """floor(1000 ln((2N+2)/(2df+1))) of each term, N and L."""
    sums = {r["kind"]: r["n"] for r in stats.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    n, total = sums.get(1, 0), sums.get(2, 0)
    held = (stats.filter("kind = 1").select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
            .groupBy("x.terms").agg(F.sum("x.counts").alias("df")).toPandas())
    df = np.zeros(size, np.int64)
    df[held["terms"].to_numpy()] = held["df"].to_numpy()
    return np.array([floor(1000 * log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64), n, total


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0
    of every item.  doc_id is read as a long."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks, n_blocks = item_blocks(items)
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for b in range(n_blocks):
        pairs = blocks.filter(F.col("block") == b).select("item_id", "term", "q")
        numbers = [r["item_id"] for r in pairs.select("item_id").distinct().collect()]
        if not numbers:
            continue
        number = spark.createDataFrame(list(enumerate(numbers)), f"item int, item_id {kind}")
        arrays, vocab = _block_items(pairs.join(F.broadcast(number.withColumnRenamed("item_id", "_id")), F.col("item_id").eqNullSafe(F.col("_id")))
                                     .select("item", "term", "q").toPandas())
        vectors = materialize(texts.mapInArrow(_vectors(spark.sparkContext.broadcast(vocab)),
                                               "kind int, doc_id long, n long, terms array<int>, counts array<int>"), "search-vectors")
        arrays["w"], arrays["docs"], arrays["terms"] = _weights(vectors.filter("kind > 0"), len(vocab))
        vectors = vectors.filter("kind = 0").select("doc_id", "n", "terms", "counts")
        found, schema = spark.sparkContext.broadcast(arrays), "item int, doc_id long, score long"
        longest = (vectors.mapInArrow(_longest(found, BUCKET // 4), "doc_id long, n long, terms array<int>, counts array<int>, length double")
                   .orderBy(F.desc("length")).limit(BUCKET).drop("length"))
        first = longest.coalesce(1).mapInArrow(_scorer(found, k), schema).toPandas()
        reach = first.groupby("item")["score"].agg(["size", "min"])
        reach = reach[reach["size"] == k]
        arrays["reach"][reach.index.to_numpy()] = reach["min"].to_numpy()
        scored = vectors.mapInArrow(_scorer(spark.sparkContext.broadcast(arrays), k), schema)
        order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        top = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        top = materialize(top.join(F.broadcast(number), "item").select("item_id", "rank", "doc_id", "score"), "search-top")
        release(vectors)
        out = out.union(top)
    return out
