"""Document quality from a linear-chain CRF over lines.

Every line is labelled good or bad.  Its features are counts on the line
itself (characters by class, words, repetition within the text) and the same
counts of the line before and after it; a 2 x 2 transition matrix ties
neighbours.  Forward-backward gives each line's marginal of being good; the
length-weighted mean of these is the document's raw score, and a logistic
curve fitted on the training rows turns it into a probability.

The model is fitted on at most ``TRAIN_DOCS`` labelled texts (those with the
smallest hash of doc_id; a documented bound), scoring runs over all texts in
Arrow batches with memory bounded by a few MB of text (or one long text).

Defined cases: NULL and empty text is one empty line and gets a score like
any other; blank lines are skipped unless a text has no other; NULL doc_id is
scored and never used to learn; repeated rows get equal scores; a doc_id with
both labels is learned with both, one with several texts with the smallest; without any training row every score is
0.5; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainline.llm.textnum import chunks, lower_ascii_table, word_bounds, word_hashes

TRAIN_DOCS = 4000
FOLDS = 5
THRESHOLD = 0.3

# character classes of bytes
_SPACE, _LOWER, _UPPER, _DIGIT, _STOP, _COMMA, _BANG, _BAR, _QUOTE, _SYMBOL, _HIGH, _CONT, _OTHER = range(13)
N_LOCAL = 17


def _classes() -> np.ndarray:
    t = np.full(256, _OTHER, np.uint8)
    for chars, k in ((b" \t\r\x0b\x0c", _SPACE), (b".?:", _STOP), (b",;", _COMMA), (b"!", _BANG), (b"|", _BAR),
                     (b"'\"()-", _QUOTE), (b"#$%&*+/<=>@[\\]^_`{}~", _SYMBOL)):
        t[list(chars)] = k
    t[ord("a"):ord("z") + 1] = _LOWER
    t[ord("A"):ord("Z") + 1] = _UPPER
    t[ord("0"):ord("9") + 1] = _DIGIT
    t[0x80:0xC0] = _CONT
    t[0xC0:] = _HIGH
    return t


def _repeats(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """1 where (group, key) has occurred before, in order."""
    if not len(key):
        return np.zeros(0)
    order = np.lexsort((np.arange(len(key)), key, group))
    g, k = group[order], key[order]
    again = np.zeros(len(key))
    again[order[1:]] = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    return again


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, first): a row per line, its length in characters,
    and per text the index of its first line."""
    n = len(offs) - 1
    table = _classes()
    nl = data == 10
    starts, ends, first = word_bounds(~nl, offs)  # non-empty lines
    blank = np.ones(len(starts), bool)
    if len(starts):
        visible = (table[data] != _SPACE) & ~nl
        blank = np.add.reduceat(visible, starts) == 0
    text_of = np.searchsorted(offs, starts, side="right") - 1
    kept = ~blank
    starts, ends, text_of = starts[kept], ends[kept], text_of[kept]
    # texts without a visible line have one empty line
    none = np.setdiff1d(np.arange(n), text_of)
    starts = np.concatenate([starts, offs[none]])
    ends = np.concatenate([ends, offs[none]])
    text_of = np.concatenate([text_of, none])
    order = np.lexsort((starts, text_of))
    starts, ends, text_of = starts[order], ends[order], text_of[order]
    first = np.searchsorted(text_of, np.arange(n + 1))
    m = len(starts)
    size = ends - starts
    line = np.repeat(np.arange(m), size)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    body = data[at]
    c = np.bincount(line * 16 + table[body], minlength=m * 16).reshape(m, 16).astype(np.float64)
    chars = size - c[:, _CONT]
    # words of the lines, and what has occurred before in the same text
    bounds = np.concatenate([[0], np.cumsum(size)])
    is_word = table[body] != _SPACE
    ws, _, wfirst = word_bounds(is_word, bounds)
    words = np.diff(wfirst).astype(np.float64)
    h = word_hashes(lower_ascii_table()[body], is_word, ws)
    wline = np.repeat(np.arange(m), np.diff(wfirst))
    wtext = text_of[wline]
    with np.errstate(over="ignore"):
        pair = h.copy()
        if len(h) > 1:
            pair[:-1] = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        lineh = np.zeros(m, np.uint64)
        np.add.at(lineh, wline, h)
    word_again = np.bincount(wline, weights=_repeats(wtext, h), minlength=m)
    pair_again = np.bincount(wline, weights=_repeats(wtext, pair), minlength=m)
    line_again = _repeats(text_of, lineh)
    letters = np.maximum(c[:, _LOWER] + c[:, _UPPER] + c[:, _HIGH], 1)
    w = np.maximum(words, 1)
    ch = np.maximum(chars, 1)
    f = np.column_stack([
        np.log1p(chars), np.log1p(words), letters / w, np.minimum(c[:, _UPPER] / letters, 1), c[:, _DIGIT] / ch,
        np.minimum(c[:, _STOP] / w, 2), np.minimum(c[:, _COMMA] / w, 2), np.minimum(c[:, _BANG] / w, 4), np.minimum(c[:, _BAR] / w, 2),
        np.minimum(c[:, _QUOTE] / w, 2), np.minimum(c[:, _SYMBOL] / w, 6), c[:, _HIGH] / letters, c[:, _OTHER] / ch,
        word_again / w, pair_again / w, line_again, (words > 0) & (c[:, _STOP] == 0),
    ]).astype(np.float32)
    return f, np.maximum(chars, 1), first


def with_neighbours(f: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features (0 beyond the text) and 1."""
    m = len(f)
    prev, nxt = np.zeros_like(f), np.zeros_like(f)
    prev[1:], nxt[:-1] = f[:-1], f[1:]
    heads = first[:-1]
    prev[heads] = 0
    nxt[first[1:] - 1] = 0
    return np.hstack([f, prev, nxt, np.ones((m, 1), f.dtype)])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray        # emission: log odds of good
    t: np.ndarray        # 2 x 2 log transition
    curve: tuple         # slope and offset of the final logistic

    def emission(self, f: np.ndarray, first: np.ndarray) -> np.ndarray:
        return with_neighbours((f - self.mean) / self.scale, first) @ self.w


def _chains(emit: np.ndarray, first: np.ndarray, t: np.ndarray, share: np.ndarray | None = None):
    """Marginal of good per line; with ``share`` also the expected
    transitions, weighted by line.

    All texts advance one line at a time, longest first, so a step is one
    vector operation over the texts that still have a line."""
    n = len(first) - 1
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    head, size = first[:-1][order], size[order]
    top = int(size[0]) if n else 0
    active = np.searchsorted(-size, -np.arange(1, top + 1), side="right")
    m = len(emit)
    fwd, bwd = np.zeros((m, 2)), np.zeros((m, 2))
    e = np.stack([np.zeros(m), emit], axis=1)
    fwd[head] = e[head]
    for k in range(1, top):
        at = head[:active[k]] + k
        p = fwd[at - 1]
        fwd[at] = e[at] + np.logaddexp(p[:, :1] + t[0], p[:, 1:] + t[1])
    for k in range(top - 1, 0, -1):
        at = head[:active[k]] + k
        q = bwd[at] + e[at]
        bwd[at - 1] = np.logaddexp(q[:, :1] + t[:, 0], q[:, 1:] + t[:, 1])
    z = np.logaddexp(*fwd[first[1:] - 1].T)
    of = np.repeat(np.arange(n), np.diff(first))
    good = np.exp(np.minimum(fwd[:, 1] + bwd[:, 1] - z[of], 0))
    if share is None:
        return good
    inner = np.ones(m, bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    q = e[at] + bwd[at]
    joint = np.exp(fwd[at - 1][:, :, None] + t[None] + q[:, None, :] - z[of[at]][:, None, None])
    return good, (joint * share[at][:, None, None]).sum(0)


def document_scores(good: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(f: np.ndarray, weight: np.ndarray, first: np.ndarray, label: np.ndarray,
        steps: int = 150, rate: float = 0.08, l2: float = 1e-3) -> Model:
    """Maximum likelihood (Adam) with every line carrying its text's label.

    A text's lines share its likelihood equally (divided by their number), so
    long texts do not outweigh short ones."""
    mean, scale = f.mean(0), f.std(0) + 1e-3
    x = with_neighbours((f - mean) / scale, first)
    size = np.diff(first)
    share = np.repeat(1.0 / size, size)
    y = np.repeat(label, size).astype(float)
    n = len(label)
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    inner = np.maximum(size - 1, 0) / size
    seen = np.array([[(inner * (label == 0)).sum(), 0], [0, (inner * (label == 1)).sum()]]) / n
    m1, m2 = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, steps + 1):
        good, joint = _chains(x @ w, first, t, share)
        g = np.concatenate([x.T @ ((y - good) * share) / n - l2 * w, (seen - joint / n - l2 * t).ravel()])
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.99 * m2 + 0.01 * g * g
        d = rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-8)
        w, t = w + d[:-4], t + d[-4:].reshape(2, 2)
    raw = _logit(document_scores(_chains(x @ w, first, t), weight, first))
    return Model(mean, scale, w, t, _curve(raw, label))


def _curve(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic regression on one variable (Newton steps, small ridge)."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, s = y - p, p * (1 - p) + 1e-6
        g = np.array([(r * x).sum() - 1e-2 * a, r.sum()])
        h = np.array([[(s * x * x).sum() + 1e-2, (s * x).sum()], [(s * x).sum(), s.sum()]])
        d = np.linalg.solve(h, g)
        a, b = a + float(np.clip(d[0], -1, 1)), b + float(np.clip(d[1], -2, 2))
    return max(a, 1e-3), b


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def _feature_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        labels = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi, data, offs in chunks(batch.column(1)):
            f, w, first = line_features(data, offs)
            rows = [f[first[i]:first[i + 1]].tobytes() for i in range(hi - lo)]
            weights = [w[first[i]:first[i + 1]].astype(np.float32).tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([pa.array(labels[lo:hi], pa.int32()), pa.array(rows, pa.binary()),
                                              pa.array(weights, pa.binary())], ["label", "f", "w"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_docs: int = TRAIN_DOCS) -> Model | None:
    """Fit on at most ``max_docs`` labelled texts outside the held-out fold."""
    chosen = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
              .filter("doc_id is not null and label in (0, 1)").filter(~held_out("doc_id")).distinct()
              .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "label").limit(max_docs))
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text")
            .mapInArrow(_feature_rows, "label int, f binary, w binary").toPandas())
    if not len(rows):
        return None
    rows = rows.sort_values(["label", "f"]).reset_index(drop=True)  # order of arrival does not matter
    f = [np.frombuffer(b, np.float32).reshape(-1, N_LOCAL) for b in rows["f"]]
    first = np.cumsum([0] + [len(x) for x in f])
    w = np.concatenate([np.frombuffer(b, np.float32) for b in rows["w"]]).astype(float)
    return fit(np.concatenate(f).astype(float), w, first, rows["label"].to_numpy())


def _scorer(shared, at: int, n_keep: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = shared.value
        rest = range(n_keep)
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(at)):
                f, w, first = line_features(data, offs)
                if model is None:
                    score = np.full(hi - lo, 0.5)
                else:
                    raw = _logit(document_scores(_chains(model.emission(f, first), first, model.t), w, first))
                    score = 1 / (1 + np.exp(-(model.curve[0] * raw + model.curve[1])))
                cols = [batch.column(i).slice(lo, hi - lo) for i in rest]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(score), pa.array(np.diff(first).astype(np.int64))],
                                                 [*(batch.schema.names[i] for i in rest), "score", "n_lines"])
    return run


def score_quality(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with score (0 to 1, higher: better) and n_lines."""
    # a text that is kept travels once
    own = text_col in keep and dict(docs.dtypes)[text_col] == "string"
    df = docs.select(*[F.col(c) for c in keep], *([] if own else [F.col(text_col).cast("string").alias("_text")]))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    run = _scorer(shared, list(keep).index(text_col) if own else len(keep), len(keep))
    return df.mapInArrow(run, f"{kinds}, score double, n_lines long")


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_lines of every document."""
    scored = score_quality(docs, train(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "n_lines")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that the classifier rejects."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # free of clashes with the score's names
    scored = score_quality(docs.toDF(*names), train(docs, labels), names[docs.columns.index("text")], tuple(names))
    return scored.filter(F.col("score") >= threshold).select(*names).toDF(*docs.columns)
