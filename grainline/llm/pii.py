"""Personal data: pattern spans, and terms that give protected values away.

Base spans (email, ip, card, phone) are leftmost, non-overlapping matches per
kind, in code points.  Each distinct value found is a protected entity.  The
corpus then tells how much each term of an entity's texts reveals about it:

    IC(c)      = log2(N / f(c))                    information of entity c
    PMI(c, t)  = log2(P(c|t) * N / f(c))           what term t tells about c

with N the texts of the corpus, f(c) and f(t) the texts with the entity and
with the term and f(c, t) those with both, at any distance.  P(c|t) is the lower
confidence bound (Wilson, ``CONFIDENCE`` standard errors) of f(c, t) / f(t), and
0 for a single meeting of a term that other texts hold too, which chance explains:
a word that no other text holds, or many meetings, tell much.  Terms are runs of ASCII letters and digits and of characters beyond ASCII, counted in
lower case.  A term whose disclosure PMI / IC reaches ``generalise`` (and which has at least ``min_support`` texts with the
entity) becomes its class token, from ``remove`` on it goes: every occurrence
in all texts of the entity.  Entities that occur in the same texts tell the
same and are counted as one class.  Only DataFrame functions are used.

Spark has no function that gives all positions of a pattern; ``split`` with
limit -1 gives what lies between the same matches as ``regexp_extract_all``,
so running lengths are the positions.  Patterns are possessive and start only
where a run starts, so that no text makes them slow or deep.

Defined cases: NULL text counts as empty (no spans) and stays NULL in the
cleaned table; NULL or repeated ids do not matter (texts are joined by their
digest, and equal texts get equal spans); an empty table gives an empty one;
other columns pass through, whatever their names (working names are prefixed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainline.session import materialize

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # runs of fewer than 16 digits cannot pass, so the run length is in the pattern
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that hold for every text with a match.
HINTS = {"email": "@", "phone": "+"}
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"

#: Default of the library calls; the registered queries ask for 1.
MIN_SUPPORT = 2
CONFIDENCE = 1.0
GENERALISE, REMOVE = 0.8, 0.95

_SPAN = "struct<start:int,end:int,hit:string>"


def _running(items: str, kind: str, next_at: str, piece: str) -> str:
    """SQL: struct(at, out) of a left fold over ``items`` (as x) that carries
    a number (a.at) and appends ``piece``.  Appending copies, so it is done in
    runs of 256 items whose results are put together at the end."""
    return f"""transform(array({items}), z -> aggregate(sequence(1, greatest(size(z), 1), 256),
        named_struct('at', 0, 'out', cast(array() as array<array<{kind}>>)),
        (b, i) -> transform(array(aggregate(slice(z, i, 256), named_struct('at', b.at, 'out', cast(array() as array<{kind}>)),
                (a, x) -> named_struct('at', {next_at}, 'out', concat(a.out, {piece})))),
            r -> named_struct('at', r.at, 'out', concat(b.out, array(r.out))))[0]))[0]"""


def _positions(text: str, pattern: str) -> str:
    """SQL for array<struct<start,end,hit>> of all matches in ``text``."""
    p = pattern.replace("\\", "\\\\")
    pairs = f"""transform(array(regexp_extract_all({text}, '{p}', 0)), m -> zip_with(m, slice(split({text}, '{p}', -1), 1, size(m)),
        (h, g) -> named_struct('hit', h, 'gap', g)))[0]"""
    return "flatten(" + _running(pairs, _SPAN, "a.at + length(x.gap) + length(x.hit)", """array(named_struct(
        'start', a.at + length(x.gap), 'end', a.at + length(x.gap) + length(x.hit), 'hit', x.hit))""") + ".out)"


_DIGITS = "regexp_replace(s.hit, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": r"forall(split(s.hit, '\\.'), p -> coalesce(try_cast(regexp_replace(p, '^0+(?=.)', '') as int) <= 255, false))",
    "card": f"""length({_DIGITS}) between 16 and 19 and aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a +
        case when i % 2 = 1 then cast(substring({_DIGITS}, -i, 1) as int)
             else cast(substring('0246813579', cast(substring({_DIGITS}, -i, 1) as int) + 1, 1) as int) end) % 10 = 0""",
    "phone": f"length({_DIGITS}) between 8 and 15",
}


def base_spans(text: str, kind: str) -> Column:
    """Column of the valid spans of one kind; ``text`` is a column name."""
    found = f"filter({_positions(text, PATTERNS[kind])}, s -> {_VALID[kind]})"
    if kind in HINTS:
        test = f"contains({text}, '{HINTS[kind]}')"
    elif kind == "ip":
        test = rf"{text} rlike '[0-9]\\.[0-9]++\\.[0-9]'"
    else:
        test = rf"{text} rlike '[0-9](?:[ -]?[0-9]){{15}}'"
    return F.expr(f"case when {test} then {found} else cast(array() as array<{_SPAN}>) end")


def with_base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``_txt`` (the text, '' for NULL) and ``_spans``: array of
    (kind, start, end, value), by kind as listed, then start."""
    df = docs.withColumn("_txt", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    for k in KINDS:
        df = df.withColumn(f"_{k}", base_spans("_txt", k))
    value = {"email": "lower(s.hit)", "ip": "s.hit", "card": _DIGITS, "phone": _DIGITS}
    parts = [f"transform(_{k}, s -> named_struct('kind', '{k}', 'start', s.start, 'end', s.end, 'value', '{k}:' || {value[k]}))"
             for k in KINDS]
    return df.withColumn("_spans", F.expr(f"concat({', '.join(parts)})")).drop(*[f"_{k}" for k in KINDS])


def _rewritten(text: str, marks: str, inside: str = "cast(array() as array<string>)") -> str:
    """SQL: ``text`` with each of ``marks`` (sorted start, end, mark) in place
    of what it covers; a mark that begins inside an earlier one adds
    ``inside``."""
    fold = _running(marks, "string", "greatest(a.at, x.end)",
                    f"case when x.start >= a.at then array(substring({text}, a.at + 1, x.start - a.at), x.mark) else {inside} end")
    return f"transform(array({fold}), f -> array_join(flatten(f.out), '') || substring({text}, f.at + 1))[0]"


def disclosures(docs: DataFrame, text_col: str = "text", min_support: int = MIN_SUPPORT,
                generalise: float = GENERALISE, remove: float = REMOVE) -> tuple[DataFrame, DataFrame]:
    """(table, spans): table has a row per disclosing (entity, term) with its
    counts and disclosure; spans a row per text that has base spans and
    disclosing terms: digest, terms as sorted array of (start, end, action)."""
    based = with_base_spans(docs.select(F.col(text_col).cast("string").alias("text")), "text")
    # blanks keep all places, also where spans of two kinds overlap
    over = "array(repeat(' ', greatest(x.end - a.at, 0)))"
    blanks = """transform(array_sort(transform(spans, s -> named_struct('start', s.start, 'end', s.end))),
        s -> named_struct('start', s.start, 'end', s.end, 'mark', repeat(' ', s.end - s.start)))"""
    # copies of a text are one row with a count before anything is shuffled
    texts = (based.filter(F.size("_spans") > 0).groupBy(F.col("_txt").alias("text"))
             .agg(F.count(F.lit(1)).alias("n"), F.first("_spans").alias("spans")))
    texts = materialize(texts.select(F.md5("text").alias("digest"), "n", F.expr("array_distinct(spans.value)").alias("entities"),
                                     F.expr(_rewritten("text", blanks, over)).alias("masked")), "pii-texts")
    # entities of the same texts are one class, named by two hashes of the set
    held = texts.select("digest", "n", F.explode("entities").alias("entity"))
    entities = materialize(held.groupBy("entity").agg(F.sum("n").alias("f_c"), F.expr("bit_xor(xxhash64(digest))").alias("c1"),
                                                      F.expr("bit_xor(xxhash64(digest, 1))").alias("c2")), "pii-entities")
    classes = materialize(held.join(entities, "entity").select("digest", "n", "c1", "c2", "f_c").distinct(), "pii-classes")
    # dealt by their number: a text's work follows its words, not its bytes on disk
    dealt = texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "digest")
    places = materialize(dealt.select("digest", F.explode(F.expr(_positions("masked", WORD))).alias("w"))
                         .select("digest", F.lower("w.hit").alias("term"), F.col("w.start").alias("start"), F.col("w.end").alias("end")), "pii-places")
    seen = classes.join(places.select("digest", "term").distinct(), "digest")
    pairs = materialize(seen.groupBy("c1", "c2", "f_c", "term").agg(F.sum("n").alias("f_ct")).filter(F.col("f_ct") >= min_support), "pii-pairs")
    # '' stands for the text itself, so its count is N; no term is empty
    asked = pairs.select("term").distinct().union(pairs.sparkSession.range(1).select(F.lit("").alias("term")))
    words = docs.select(F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower(F.col(text_col).cast("string")), NOT_WORD)))).alias("term"))
    counted = materialize(words.groupBy("term").agg(F.count(F.lit(1)).alias("f_t")).join(asked, "term", "left_semi"), "pii-words")
    total = (counted.filter("term = ''").first() or [None, 0])[1]
    n, z2 = F.lit(float(total)), CONFIDENCE ** 2
    # the corpus count lacks words that a span cuts
    f_t = F.greatest(F.coalesce("f_t", F.lit(0)), F.col("f_ct")).cast("double")
    rate = F.col("f_ct") / f_t
    share = (rate + z2 / (2 * f_t) - CONFIDENCE * F.sqrt(rate * (1 - rate) / f_t + z2 / (4 * f_t * f_t))) / (1 + z2 / f_t)
    risky = (pairs.join(counted, "term", "left").filter((F.col("f_ct") > 1) | (f_t == 1))
             .withColumn("disclosure", F.lit(1.0) + F.try_divide(F.log2(share), F.log2(n / F.col("f_c"))))
             .filter(F.col("disclosure") >= generalise)
             .withColumn("action", F.when(F.col("disclosure") >= remove, 2).otherwise(1)))
    risky = materialize(risky, "pii-table")
    actions = seen.join(risky.select("c1", "c2", "term", "action"), ["c1", "c2", "term"]).groupBy("digest", "term").agg(F.max("action").alias("action"))
    spans = (places.join(actions, ["digest", "term"]).groupBy("digest")
             .agg(F.sort_array(F.collect_list(F.struct("start", "end", "action"))).alias("terms")))
    table = entities.join(risky.drop("f_c"), ["c1", "c2"]).drop("c1", "c2")
    return table, spans


_TERMS = "array<struct<start:int,end:int,action:int>>"


def sanitise(docs: DataFrame, text_col: str = "text", out_col: str = "clean_text", **limits) -> DataFrame:
    """``docs`` plus ``_spans`` (base), ``_terms`` (the method's) and
    ``out_col``, the text with base spans replaced by ``[KIND]`` and terms
    generalised or removed."""
    _, terms = disclosures(docs, text_col, **limits)
    based = with_base_spans(docs, text_col)
    plain = based.filter(F.size("_spans") == 0).withColumn("_terms", F.expr(f"cast(array() as {_TERMS})"))
    found = (based.filter(F.size("_spans") > 0).withColumn("_digest", F.md5("_txt"))
             .join(terms.select(F.col("digest").alias("_digest"), F.col("terms").alias("_terms")), "_digest", "left").drop("_digest")
             .withColumn("_terms", F.coalesce("_terms", F.expr(f"cast(array() as {_TERMS})"))))
    token = "substring(_txt, t.start + 1, t.end - t.start)"
    marks = f"""array_sort(concat(
        transform(_spans, s -> named_struct('start', s.start, 'longer', -s.end, 'end', s.end, 'mark', '[' || upper(s.kind) || ']')),
        transform(_terms, t -> named_struct('start', t.start, 'longer', -t.end, 'end', t.end, 'mark',
            case when t.action = 2 then '' when {token} rlike '^[0-9]+$' then '[NUMBER]'
                 when {token} rlike '^\\\\p{{Lu}}' then '[NAME]' else '[TERM]' end))))"""
    clean = _rewritten("_txt", marks)
    both = found.withColumn("_clean", F.expr(clean)).unionByName(plain.withColumn("_clean", F.col(text_col).cast("string")))
    return both.withColumn(out_col, F.col("_clean")).drop("_clean")


def span_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """doc_id, counts by kind, digest of the base spans, all spans."""
    df = sanitise(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "_out", **limits)
    base = "transform(_spans, s -> s.kind || ':' || s.start || ':' || s.end)"
    every = f"concat({base}, transform(_terms, t -> 'term:' || t.start || ':' || t.end))"
    return df.select("doc_id", *[F.expr(f"cast(size(filter(_spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS],
                     F.sha2(F.expr(f"array_join({base}, ',')"), 256).alias("base_sha256"),
                     F.expr(f"array_join({every}, ',')").alias("spans"), F.size("_terms").cast("long").alias("n_term"))
