"""SentencePiece encoding and decoding with a batched numpy Viterbi.

A text is escaped as the library does (one space in front, spaces as U+2581)
and cut into words (a run of spaces and what follows); no piece of the model
may reach over such a cut, which is checked when the vocabulary is read.  The
distinct words of a batch are grouped by length and advance together: at
every position the hashes of all substrings that end there are looked up in
the sorted piece hashes, the best score of each word is one vectorised
maximum, and the chosen piece is the backpointer.  Of equal scores the longer
last piece wins.  A character without a piece costs the lowest score minus
10 and is written as its UTF-8 bytes.  Scores are the model file's log
probabilities; a BPE model holds merge ranks instead, which are read as a
Zipf distribution over the ranks (log p = -log(rank + 2) - log H).  Its
pieces are then the most probable ones, which are not always those that the
merge order gives.

Decoding joins piece bytes and removes the space in front: the round trip is
exact for every text (U+2581 itself is written as bytes).

Defined cases: NULL text gives NULL tokens, empty text an empty list; control
pieces decode to nothing, ids outside the vocabulary are an error, bytes that
are not UTF-8 decode to U+FFFD; order and repeats of rows do not matter;
empty tables give empty results; other columns pass through, but one named like
a result (``tokens``, ``n_tokens``, ``round_trip``) is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainline.llm.textnum import chunks, mix64

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
#: Distinct words a task keeps with their pieces (about 50 bytes each).
CACHE_WORDS = 500_000

#: Characters and bytes of a chunk that 64-bit working arrays are made for at once.
WORK_ITEMS = 1 << 17

_SPACE = 0x20
_BASE = np.uint64(0x9FB21C651E98DF25)
_U = np.uint64


@dataclass
class Vocabulary:
    keys: np.ndarray       # sorted hashes of the pieces (with plain spaces)
    ids: np.ndarray        # piece id of each key
    scores: np.ndarray     # score of each key
    longest: int
    unknown: float
    byte_ids: np.ndarray   # id of each byte value
    raw: np.ndarray        # bytes of all pieces
    raw_at: np.ndarray     # where each id's bytes start (size + 1)


def _hash_text(codes: np.ndarray) -> np.uint64:
    h = _U(0)
    with np.errstate(over="ignore"):
        for c in codes.tolist():
            h = h * _BASE + mix64(np.array([c + 1], np.uint64))[0]
    return h


def read_vocabulary(path: str = MODEL_PATH) -> Vocabulary:
    """Pieces and scores of a SentencePiece model file with byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    hashes, ids, scores, raw = [], [], [], []
    byte_ids = np.full(256, -1, np.int64)
    longest = 1
    for i in range(n):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            raw.append(bytes([int(p[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            raw.append(b"")
        else:
            text = p.replace("▁", " ")
            if " " in text.lstrip(" "):
                raise ValueError(f"piece {i} reaches over a word boundary")
            raw.append(text.encode())
            hashes.append(_hash_text(np.array([ord(c) for c in text], np.uint64)))
            ids.append(i)
            scores.append(sp.get_score(i))
            longest = max(longest, len(text))
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces")
    order = np.argsort(np.array(hashes, np.uint64))
    keys = np.array(hashes, np.uint64)[order]
    if (keys[1:] == keys[:-1]).any():
        raise ValueError("two pieces have one hash")
    s = log_probabilities(np.array(scores, np.float64))
    return Vocabulary(keys, np.array(ids, np.int64)[order], s[order], longest, float(s.min()) - UNKNOWN_PENALTY, byte_ids,
                      np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(b) for b in raw]))


def log_probabilities(scores: np.ndarray) -> np.ndarray:
    """The scores, or for merge ranks (whole numbers down to minus the number
    of pieces; far lower ones mark pieces without a merge) those of a Zipf
    distribution."""
    if not (scores == np.round(scores)).all() or len(scores) < 2 or scores.min() > -len(scores) / 2:
        return scores
    rank = np.minimum(-scores, len(scores))
    # in steps of 2**-16, so that sums are exact and ties do not hang on order
    return np.round((-np.log(rank + 2) - np.log((1 / (rank + 2)).sum())) * 65536) / 65536


def viterbi(words: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Best pieces of equally long words (k x length code points): flat ids
    and where each word's begin (k + 1)."""
    k, length = words.shape
    codes = mix64(words.astype(np.uint64).ravel() + _U(1)).reshape(k, length)  # mix64(0) is 0, U+0000 must count
    prefix = np.zeros((k, length + 1), np.uint64)
    best = np.full((k, length + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((k, length + 1), np.int16)
    piece = np.full((k, length + 1), -1, np.int32)
    rows = np.arange(k)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[_U(1)], np.full(v.longest, _BASE)]), dtype=np.uint64)
        for j in range(1, length + 1):
            prefix[:, j] = prefix[:, j - 1] * _BASE + codes[:, j - 1]
            size = np.arange(min(v.longest, j), 0, -1)  # the longer piece first
            sub = prefix[:, j, None] - prefix[:, j - size] * powers[size]
            at = np.minimum(np.searchsorted(v.keys, sub), len(v.keys) - 1)
            found = v.keys[at] == sub
            gain = np.where(found, v.scores[at], -np.inf)
            gain[:, -1] = np.where(found[:, -1], gain[:, -1], v.unknown)
            total = best[:, j - size] + gain
            pick = total.argmax(axis=1)
            best[:, j] = total[rows, pick]
            back[:, j] = size[pick]
            piece[:, j] = np.where(found[rows, pick], v.ids[at[rows, pick]], -1)
    # walk back, all words at once
    pos = np.full(k, length)
    who, ids, where = [], [], []
    live = rows
    while len(live):
        p = pos[live]
        who.append(live)
        ids.append(piece[live, p])
        where.append(p)
        pos[live] = p - back[live, p]
        live = live[pos[live] > 0]
    who, ids, where = np.concatenate(who), np.concatenate(ids).astype(np.int64), np.concatenate(where)
    order = np.lexsort((where, who))
    who, ids, where = who[order], ids[order], where[order]
    if (ids < 0).any():
        who, ids = _spell(words, who, ids, where, v)
    return ids.astype(np.int32), np.searchsorted(who, np.arange(k + 1))


def _spell(words, who, ids, where, v):
    """Unknown characters as byte pieces."""
    new = []
    count = np.ones(len(ids), np.int64)
    for i in np.flatnonzero(ids < 0):
        c = int(words[who[i], where[i] - 1])
        b = chr(0x2581 if c == 0x110000 else c).encode("utf-8", "surrogatepass")
        new.append((i, v.byte_ids[list(b)]))
        count[i] = len(b)
    start = np.cumsum(count) - count
    out = np.repeat(ids, count)
    for i, b in new:
        out[start[i]:start[i] + len(b)] = b
    return np.repeat(who, count), out


def _cuts(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of items that begin at ``at`` (and end at its last), of about
    ``WORK_ITEMS`` each; a longer single item has a range of its own."""
    inner = np.searchsorted(at, np.arange(at[0] + WORK_ITEMS, at[-1], WORK_ITEMS))
    ends = np.unique(np.concatenate([[0], inner, [len(at) - 1]]))
    yield from zip(ends[:-1].tolist(), ends[1:].tolist())


class Encoder:
    """Encodes batches of texts; keeps the pieces of words seen before."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self._clear()

    def _clear(self):
        self.known = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        begin, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        flats, used = [self.flat], len(self.flat)
        for length in np.unique(sizes):
            group = np.flatnonzero(sizes == length)
            step = max(1, 2_000_000 // int(length * min(length, self.v.longest)))  # bounds the working arrays
            for a in range(0, len(group), step):
                g = group[a:a + step]
                ids, at = viterbi(codes[starts[g][:, None] + np.arange(length)], self.v)
                begin[g], count[g] = used + at[:-1], np.diff(at)
                flats.append(ids)
                used += len(ids)
        self.flat = np.concatenate(flats)
        at = np.searchsorted(self.known, keys)  # keys are sorted: a merge
        self.known, self.begin, self.count = np.insert(self.known, at, keys), np.insert(self.begin, at, begin), np.insert(self.count, at, count)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts and where each text's begin."""
        raw = data.tobytes()
        n = len(offs) - 1
        texts = [raw[offs[i]:offs[i + 1]].decode("utf-8", "surrogatepass") for i in range(n)]
        joined = "".join(" " + t if t else "" for t in texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(size)])
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        space = codes == _SPACE
        codes = np.where(codes == 0x2581, 0x110000, codes).astype(np.uint32)  # no piece has it; see _spell
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[bounds[:-1][size > 0]] = True
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(codes)))
        keys = np.empty(len(starts), np.uint64)
        ends = np.append(starts, len(codes))
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(sizes.max()) + 1, _U(0xD6E8FEB86659FD93)), dtype=np.uint64)
            for a, b in _cuts(ends):
                begin = starts[a:b] - ends[a]
                at = np.arange(ends[b] - ends[a]) - np.repeat(begin, sizes[a:b])
                mixed = mix64(codes[ends[a]:ends[b]].astype(np.uint64) + _U(1)) * powers[at]
                keys[a:b] = mix64(np.add.reduceat(mixed, begin) + sizes[a:b].astype(np.uint64))
        uniq, where, inv = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) > CACHE_WORDS:
            self._clear()
        pos = np.minimum(np.searchsorted(self.known, uniq), max(len(self.known) - 1, 0))
        new = self.known[pos] != uniq if len(self.known) else np.ones(len(uniq), bool)
        if new.any():
            self._learn(uniq[new], codes, starts[where[new]], sizes[where[new]])
        pos = np.searchsorted(self.known, uniq)
        begin, count = self.begin[pos][inv], self.count[pos][inv]
        total = np.cumsum(count)
        out = self.flat[np.arange(int(total[-1])) - np.repeat(total - count - begin, count)]
        words_at = np.searchsorted(starts, bounds)
        return out, np.concatenate([[0], total])[words_at]


def decode_flat(ids: np.ndarray, at: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts that the id lists stand for, and their offsets."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(v.raw_at) - 1):
        raise ValueError("id outside the vocabulary")
    begin = v.raw_at[ids]
    count = v.raw_at[ids + 1] - begin if len(ids) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(count)])
    flat = v.raw[np.arange(int(total[-1])) - np.repeat(total[:-1] - begin, count)] if len(ids) else np.zeros(0, np.uint8)
    bounds = total[at]
    # the space put in front goes
    heads = bounds[:-1][(np.diff(bounds) > 0)]
    heads = heads[flat[heads] == _SPACE]
    keep = np.ones(len(flat), bool)
    keep[heads] = False
    gone = np.concatenate([[0], np.cumsum(~keep)])
    return flat[keep], bounds - gone[bounds]


def _round_trip(ids: np.ndarray, at: np.ndarray, data: np.ndarray, offs: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Whether each text's ids decode to its bytes."""
    back, back_at = decode_flat(ids, at, v)
    if len(back) == len(data) and (back_at == offs).all() and (back == data).all():
        return np.ones(len(offs) - 1, bool)
    return np.array([back[back_at[i]:back_at[i + 1]].tobytes() == data[offs[i]:offs[i + 1]].tobytes() for i in range(len(offs) - 1)], bool)


def _encode_rows(shared, text_at: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        v = shared.value
        enc = Encoder(v)
        for batch in batches:
            text = batch.column(text_at)
            missing = np.asarray(text.is_null())
            rest = [i for i in range(batch.num_columns) if i != text_at]
            for lo, hi, data, offs in chunks(text):
                ids, at = enc.encode(data, offs)
                same = np.zeros(hi - lo, bool)
                for a, b in _cuts(offs):
                    same[a:b] = _round_trip(ids[at[a]:at[b]], at[a:b + 1] - at[a], data[offs[a]:offs[b]], offs[a:b + 1] - offs[a], v)
                none = missing[lo:hi]
                tokens = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=pa.array(none) if none.any() else None)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in rest), tokens, pa.array(np.diff(at)), pa.array(same)],
                    [*(batch.schema.names[i] for i in rest), "_t", "_n", "_r"])
    return run


def encode(docs: DataFrame, text_col: str = "text", model_path: str = MODEL_PATH, tokens_col: str = "tokens") -> DataFrame:
    """``docs`` with the text replaced by ``tokens_col`` (array<int>),
    n_tokens and round_trip (decoding gives the text back)."""
    names = [c for c in docs.columns if c != text_col]
    # working names by place: free of clashes with the results'
    df = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], docs[text_col].cast("string").alias("_text"))
    kinds = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(names))
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))
    out = df.mapInArrow(_encode_rows(shared, len(names)), f"{kinds}_t array<int>, _n long, _r boolean")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in (tokens_col, "n_tokens", "round_trip")],
                      F.col("_t").alias(tokens_col), F.col("_n").alias("n_tokens"), F.col("_r").alias("round_trip"))


def _decode_rows(shared, at_col: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        v = shared.value
        for batch in batches:
            col = batch.column(at_col)
            step = max(1, int(1_000_000 / max(1, len(col.flatten()) / max(1, len(col)))))  # about a million ids at once
            for lo in range(0, len(col), step):
                part = col.slice(lo, step)
                lens = np.asarray(part.value_lengths().fill_null(0))
                data, offs = decode_flat(np.asarray(part.flatten(), np.int64), np.concatenate([[0], np.cumsum(lens)]), v)
                none = np.asarray(part.is_null())
                texts = [None if none[i] else data[offs[i]:offs[i + 1]].tobytes().decode("utf-8", "replace") for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, step) for i in range(batch.num_columns) if i != at_col),
                                                  pa.array(texts, pa.string())], [*(x for i, x in enumerate(batch.schema.names) if i != at_col), "_text"])
    return run


def decode(rows: DataFrame, tokens_col: str = "tokens", model_path: str = MODEL_PATH, text_col: str = "text") -> DataFrame:
    """``rows`` with the tokens replaced by the text they stand for."""
    names = [c for c in rows.columns if c != tokens_col]
    df = rows.select(*[rows[c].alias(f"c{i}") for i, c in enumerate(names)], rows[tokens_col].cast("array<int>").alias("_tokens"))
    kinds = "".join(f"c{i} {rows.schema[c].dataType.simpleString()}, " for i, c in enumerate(names))
    shared = rows.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))
    out = df.mapInArrow(_decode_rows(shared, len(names)), f"{kinds}_text string")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c != text_col], F.col("_text").alias(text_col))
