"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A mask such as ``110101011`` hashes the tokens under its 1s and ignores those
under its 0s, so a replaced token spoils only the seeds that have it under a 1.
Benchmark seeds and document seeds are joined on the hash; a hit fixes the shift
of the item against the text, and around it the two are compared token by token.

**Rule.**  A shift counts if a mask fits on it (the tokens under all its 1s agree
at some place) or if it holds ``threshold`` of the item.  The overlap of
(document, item) is the share of the item's tokens that some counting shift
holds.  So replaced, inserted and left-out words cost little, and pieces that no
mask fits on (shorter than nine tokens, say) count nothing.

Blocks make the second half whole: an item of m tokens of which r may be replaced
is cut into r + 1 blocks, one of which any r replacements leave intact.  Each
block holds one of the item's r + 1 rarest tokens of the benchmark and its seed is
up to four tokens around it, so that an opening which many items share is not a
seed of all of them.

The documents are not shuffled: their seeds are exploded and probed within
one stage, and only hits leave it.  Seed rows are slim (hash, place, item
number); they are broadcast if there are at most ``BROADCAST_SEEDS``, the items'
tokens, once each, if they take at most ``BROADCAST_BYTES``.  Beyond that the same
joins run shuffled.

Tokens are lower-cased runs of ASCII letters, digits and non-ASCII
characters.  Defined cases: NULL or empty texts and items have no tokens and
match nothing; items of fewer than MIN_TOKENS tokens take no part (shorter
than a shingle); items shorter than a mask are sought by their blocks;
repeated documents each count, repeated (item_id, text) rows count once;
empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainline.session import materialize

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++"
#: Weight 6 over 9 and 11 tokens: few windows of a text with every fourth
#: token replaced escape both.
MASKS = ("110101011", "11001010011")
#: Tokens of a block that make its seed.
BLOCK = 4
MIN_TOKENS = 5
#: Texts are probed in pieces of so many tokens (or the longest item's), with
#: an item's length around, so a hit carries a piece and not the whole text.
PIECE = 512
THRESHOLD = 0.75
#: Seed rows take some 50 bytes each, item tokens 8.
BROADCAST_SEEDS, BROADCAST_BYTES = 1_000_000, 64 << 20


def _hashes(text_col: str) -> F.Column:
    return F.transform(F.split(F.lower(F.col(text_col).cast("string")), NOT_WORD), lambda t: F.xxhash64(t))


def _seeds(arr: str, size: str, mask: str, first: str = "0", last: str | None = None) -> str:
    """SQL: the mask's seed hash at every position of ``arr`` (from ``first``
    to ``last``)."""
    span = len(mask)
    picked = ", ".join(f"{arr}[i + {k}]" for k, c in enumerate(mask) if c == "1")
    end = f"least({last}, {size} - {span})" if last else f"{size} - {span}"
    return (f"case when {size} - {first} >= {span} then transform(sequence({first}, {end}), i -> xxhash64('{mask}', {picked})) "
            f"else cast(array() as array<bigint>) end")


def benchmark_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(no, item_id, item, m): token hashes of each distinct item, and its number
    (a hash of both)."""
    words = F.filter(F.split(F.lower(F.col(text_col).cast("string")), NOT_WORD), lambda t: t != "")
    items = (benchmark.select(F.col(id_col).alias("item_id"), words.alias("words")).distinct()
             .withColumn("item", F.transform("words", lambda t: F.xxhash64(t))).withColumn("m", F.size("item"))
             .filter(F.col("m") >= MIN_TOKENS))
    return materialize(items.select(F.xxhash64("item_id", "words").alias("no"), "item_id", "item", "m"), "seed-items")


def benchmark_seeds(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(seed, mask, at, no): a row per seed of every item."""
    cols = ["seed", "mask", "at", "no"]
    out = None
    for mask in MASKS:
        rows = items.select("no", F.lit(mask).alias("mask"), F.posexplode(F.expr(_seeds("item", "m", mask))).alias("at", "seed")).select(*cols)
        out = rows if out is None else out.union(rows)
    # the rarest tokens by the items that hold them: one block more than there
    # may be replaced tokens, each around one of these
    held = items.select("no", F.posexplode("item").alias("place", "token"))
    rarity = held.select("no", "token").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("f"))
    ranked = held.join(rarity, "token").groupBy("no").agg(F.sort_array(F.collect_list(F.struct("f", "place"))).alias("ranked"))
    k = f"least(m, m - cast(ceil({threshold!r}D * m - 1e-9D) as int) + 1)"
    anchors = f"sort_array(transform(slice(ranked, 1, {k}), x -> x.place))"
    # cuts halfway between the anchors
    ends = "transform(anchors, (x, i) -> case when i = size(anchors) - 1 then m else (x + anchors[i + 1] + 1) div 2 end)"
    first = "case when i = 0 then 0 else ends[i - 1] end"
    block = f"""transform(anchors, (x, i) -> named_struct('at', cast(greatest({first}, least(x - 1, ends[i] - {BLOCK})) as int), 'end', cast(ends[i] as int)))"""
    blocks = (items.join(ranked, "no").withColumn("anchors", F.expr(anchors)).withColumn("ends", F.expr(ends))
              .select("no", "item", F.explode(F.expr(block)).alias("b"))
              .select("no", "item", F.col("b.at").alias("at"), F.expr(f"least({BLOCK}, b.end - b.at)").alias("size")))
    for size in range(1, BLOCK + 1):
        mask = "1" * size
        picked = ", ".join(f"item[at + {j}]" for j in range(size))
        out = out.union(blocks.filter(F.col("size") == size).select(
            F.expr(f"xxhash64('{mask}', {picked})").alias("seed"), F.lit(mask).alias("mask"), "at", "no"))
    return materialize(out, "seed-table")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, digest, item_id, n_item, n_matched, overlap) of the pairs
    whose overlap reaches the threshold; digest is the text's md5."""
    items = benchmark_items(benchmark)
    table = benchmark_seeds(items, threshold)
    masks = [r["mask"] for r in table.select("mask").distinct().orderBy("mask").collect()]
    probe = F.broadcast(table) if table.count() <= BROADCAST_SEEDS else table
    longest, width = items.agg(F.coalesce(F.max("m"), F.lit(0)), F.coalesce(F.sum(F.col("m") * 8 + 64), F.lit(0))).first()
    items = items.select("no", "item_id", "item")
    items = F.broadcast(items) if width <= BROADCAST_BYTES else items
    core, around = max(PIECE, longest), longest + max(map(len, MASKS))
    toks = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("txt"), _hashes(text_col).alias("h"))
    pieces = f"""transform(sequence(0, size(h) - 1, {core}), p -> named_struct('first', least(p, {around}),
        'h', slice(h, greatest(p - {around}, 0) + 1, least(p, {around}) + {core + around})))"""
    toks = (toks.filter("txt is not null").select("doc_id", F.md5("txt").alias("digest"), F.explode(F.expr(pieces)).alias("p"))
            .select("doc_id", "digest", "p.first", "p.h").withColumn("n", F.size("h")))
    for k, m in enumerate(masks):
        toks = toks.withColumn(f"s{k}", F.expr(_seeds("h", "n", m, "first", f"first + {core - 1}")))
    # one array of all seeds; the place tells the mask and the position
    bounds = ["0"]
    for k in range(len(masks)):
        bounds.append(f"{bounds[-1]} + size(s{k})")
    every = ", ".join(f"s{k}" for k in range(len(masks))) or "cast(array() as array<bigint>)"
    rows = toks.withColumn("bounds", F.expr(f"array({', '.join(bounds)})")).select(
        "doc_id", "digest", "h", "first", "bounds", F.posexplode(F.expr(f"concat({every})")).alias("place", "seed"))
    hits = rows.join(probe, "seed")
    i = " ".join(f"when mask = '{m}' then first + place - bounds[{k}]" for k, m in enumerate(masks))
    hits = hits.withColumn("shift", F.expr(f"(case {i} end) - at" if masks else "0")).select("doc_id", "digest", "h", "mask", "no", "shift").join(items, "no")
    same = "filter(sequence(0, size(item) - 1), j -> coalesce(get(h, j + shift) = item[j], false))"
    # NULL, not filtered: as a filter this would move into the join, and every
    # probed seed would be copied with its piece
    counts = F.col("mask").isin(*MASKS) | (F.size("same") >= threshold * F.size("item") - 1e-9)
    hits = hits.withColumn("same", F.expr(same)).withColumn("same", F.when(counts, F.col("same")))
    hits = hits.select("doc_id", "digest", "item_id", F.size("item").alias("n_item"), F.col("no").alias("version"), "same")
    # hits on one shift give one array, so the set has a few arrays a shift
    per = (hits.groupBy("doc_id", "digest", "item_id", "version", "n_item")
           .agg(F.size(F.array_distinct(F.flatten(F.collect_set("same")))).alias("n_matched")))
    return (per.withColumn("overlap", F.col("n_matched") / F.col("n_item")).filter(F.col("overlap") >= threshold)
            .groupBy("doc_id", "digest", "item_id").agg(F.max(F.struct("overlap", "n_matched", "n_item")).alias("b"))
            .select("doc_id", "digest", "item_id", "b.n_item", "b.n_matched", "b.overlap"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """``docs`` without the rows whose text overlaps a benchmark item."""
    hit = contaminated(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text")), benchmark,
                       "doc_id", "text", **limits)
    hit = materialize(hit.select(F.col("digest").alias("_digest")).distinct(), "seed-hits")
    if hit.count() <= BROADCAST_SEEDS:
        hit = F.broadcast(hit)
    keyed = docs.withColumn("_digest", F.coalesce(F.md5(F.col(text_col).cast("string")), F.lit("")))
    return keyed.join(hit, "_digest", "left_anti").drop("_digest")
