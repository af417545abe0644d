"""License scans with template markup.

A template is a text with two kinds of regions: ``<<beginOptional>> ...
<<endOptional>>`` may be missing, ``<<var;N>>`` stands for up to N words of
any kind.  Templates are compiled into automata over words; a place of a text
is accepted when all mandatory words match there exactly.  ``FULL_TEXTS`` hold
whole licenses and headers, conditions and disclaimers included, so a text with
a changed or added clause is not accepted; ``NOTICES`` are one-line statements.  A
notice that overlaps an accepted full text belongs to it and is not counted.
Besides, fixed phrases (the base) are counted wherever their words stand
consecutively.

All words of a batch are hashed at once and turned into template word
numbers; automata start only at places whose next two words can begin a
template, which are found for the whole batch by one lookup.

Words are runs of ASCII letters (lower-cased A-Z), digits and non-ASCII
characters.  Defined cases: NULL text counts as empty and has no words;
nothing found gives NULL places, empty labels and score 0; order and repeats
of rows and NULL ids do not matter; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainline.llm.textnum import chunks, lower_ascii_table, word_bounds, word_hashes

# fixed values: base phrases and their labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# fixed values: the wording of public licenses, with regions that may be missing
# or replaced
_OWNER = "<<beginOptional>>Copyright <<var;20>><<endOptional>>"
_MIT = f"""<<beginOptional>><<beginOptional>>The<<endOptional>> MIT License <<beginOptional>>(MIT)<<endOptional>><<endOptional>> {_OWNER}
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;8>> BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = f"""<<beginOptional>>ISC License<<endOptional>> {_OWNER}
Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
IS PROVIDED "AS IS" AND <<var;8>> <<beginOptional>>DISCLAIM<<endOptional>> <<beginOptional>>DISCLAIMS<<endOptional>> ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = f"""{_OWNER} Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution."""
_BSD_NAMES = """<<beginOptional>>3.<<endOptional>> Neither the name of <<var;20>> nor the names of <<beginOptional>>its<<endOptional>>
<<beginOptional>>the<<endOptional>> contributors may be used to endorse or promote products derived from this software without specific
prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<var;10>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;10>> BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>>://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License."""
_GPL = """This <<var;6>> is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of
the GNU <<beginOptional>>Lesser<<endOptional>> General Public License as published by the Free Software Foundation, either version <<var;1>> of
the License, or (at your option) any later version. <<beginOptional>>This <<var;6>> is distributed in the hope that it will be useful, but
WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
<<beginOptional>>Lesser<<endOptional>> General Public License for more details.<<endOptional>>"""

#: (label, template)
FULL_TEXTS = (
    ("mit", _MIT),
    ("isc", _ISC),
    ("bsd-2-clause", f"{_BSD} {_BSD_DISCLAIMER}"),
    ("bsd-3-clause", f"{_BSD} {_BSD_NAMES} {_BSD_DISCLAIMER}"),
    ("apache-2.0", _APACHE),
    ("gpl", _GPL),
)
NOTICES = (
    ("mit", "<<beginOptional>>This <<var;3>> is<<endOptional>> released under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    ("mit", "Licensed under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    ("apache-2.0", "Licensed under the Apache License<<beginOptional>>, Version<<endOptional>> 2.0"),
    ("gpl", """<<beginOptional>>This <<var;3>> is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>>
     GNU General Public License<<beginOptional>>, version <<var;2>><<endOptional>>"""),
    ("cc-by", "<<beginOptional>>This <<var;3>> is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> CC BY <<var;1>> <<beginOptional>>International<<endOptional>>"),
    ("cc-by", "<<beginOptional>>This <<var;3>> is<<endOptional>> licensed under a Creative Commons Attribution <<var;2>> License"),
    ("cc-by-nc", "<<beginOptional>>This <<var;3>> is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> CC BY NC <<beginOptional>>4.0<<endOptional>>"),
    ("proprietary", "Copyright <<var;12>> All rights reserved"),
)
TEMPLATES = FULL_TEXTS + NOTICES
TEMPLATE_SCORE, PHRASE_SCORE = 1.0, 0.5

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


@dataclass
class Automaton:
    label: str
    step: list            # state -> {word number: states}
    any: list             # state -> states after any word
    accept: int
    start: frozenset

    def longest(self, words: np.ndarray, at: int, end: int) -> int:
        """End of the longest accepted run of words from ``at`` (-1: none)."""
        live, best = self.start, -1
        while live:
            if self.accept in live:
                best = at
            if at >= end:
                break
            w = int(words[at])
            nxt: set[int] = set()
            for s in live:
                nxt.update(self.step[s].get(w, ()))
                nxt.update(self.any[s])
            live, at = nxt, at + 1
        return best


def compile_template(label: str, template: str, number: dict[str, int]) -> Automaton:
    """Automaton without empty moves; ``number`` gives each word's number and
    grows by the template's words."""
    moves: list[tuple[int, object, int]] = []  # word number, None: empty, any: "*"
    state, opened = 0, []
    top = 0

    def add(kind, to=None):
        nonlocal state, top
        if to is None:
            top += 1
            to = top
        moves.append((state, kind, to))
        state = to

    for part in re.split(r"(<<[^<>]*>>)", template):
        if part == "<<beginOptional>>":
            opened.append(state)
            add(None)
        elif part == "<<endOptional>>":
            begin = opened.pop()
            add(None)
            moves.append((begin, None, state))
        elif part.startswith("<<var;"):
            begin = state
            skips = []
            for _ in range(int(part[6:-2])):
                skips.append(state)
                add("*")
            moves.extend((s, None, state) for s in [begin, *skips])
        else:
            for w in words_of(part):
                add(number.setdefault(w, len(number)))
    if opened:
        raise ValueError("optional region without end")
    empty: dict[int, set[int]] = {}
    for a, k, b in moves:
        if k is None:
            empty.setdefault(a, set()).add(b)

    def close(s: int) -> set[int]:
        seen, todo = {s}, [s]
        while todo:
            for t in empty.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    step, free = [{} for _ in range(top + 1)], [set() for _ in range(top + 1)]
    for a, k, b in moves:
        if k == "*":
            free[a] |= close(b)
        elif k is not None:
            step[a].setdefault(k, set()).update(close(b))
    return Automaton(label, step, free, state, frozenset(close(0)))


@dataclass
class Scanner:
    automata: list
    full: int             # so many of them, the first ones, are full texts
    phrases: list         # (label, word numbers)
    keys: np.ndarray      # sorted hashes of all template words
    numbers: np.ndarray   # their numbers
    pairs: dict           # (first, second word) -> automata that can begin so
    pair_codes: np.ndarray
    size: int


def build_scanner(full=FULL_TEXTS, notices=NOTICES, phrases=PHRASES) -> Scanner:
    number: dict[str, int] = {}
    base = [(label, [number.setdefault(w, len(number)) for w in words_of(p)]) for p, label in phrases.items()]
    automata = [compile_template(label, t, number) for label, t in [*full, *notices]]
    raw = [w.encode() for w in number]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    is_word = data != 32
    starts, _, _ = word_bounds(is_word, np.array([0, len(data)]))
    h = word_hashes(data, is_word, starts)
    order = np.argsort(h)
    size = len(number) + 1  # 0: a word of no template
    pairs: dict[int, list[int]] = {}
    for i, a in enumerate(automata):
        for s in a.start:
            if a.any[s]:
                raise ValueError("a template must begin with a word")
            for w, nxt in a.step[s].items():
                seconds = {v for t in nxt for v in a.step[t]}
                if a.accept in nxt or any(a.any[t] for t in nxt):
                    seconds = set(range(-1, size - 1))  # any word may follow
                for v in seconds:
                    pairs.setdefault((w + 1) * size + v + 1, []).append(i)
    return Scanner(automata, len(full), base, h[order], np.arange(len(number))[order], pairs, np.array(sorted(pairs)), size)


def scan(data: np.ndarray, offs: np.ndarray, sc: Scanner) -> tuple[np.ndarray, list, list]:
    """(words per text, base places and template matches): places are
    (text, word index, label), matches (text, start, end, label), words from
    the text's first; notices that overlap a full text are left out."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    low = lower_ascii_table()[data]
    is_word = table[low]
    starts, _, first = word_bounds(is_word, offs)
    h = word_hashes(low, is_word, starts)
    at = np.minimum(np.searchsorted(sc.keys, h), len(sc.keys) - 1)
    num = np.where(sc.keys[at] == h, sc.numbers[at], -1)
    count = np.diff(first)
    last = np.repeat(first[1:], count)  # end of each word's text
    places = []
    for label, ws in sc.phrases:
        n = len(ws)
        if len(num) < n:
            continue
        ok = np.arange(len(num) - n + 1) + n <= last[:len(num) - n + 1]
        for k, w in enumerate(ws):
            ok &= num[k:len(num) - n + 1 + k] == w
        where = np.flatnonzero(ok)
        text = np.searchsorted(first, where, side="right") - 1
        places += [(int(t), int(p - first[t]), label) for t, p in zip(text, where)]
    nxt = np.append(num[1:], -1)
    begin = np.flatnonzero(num >= 0)  # few words are template words
    code = (num[begin] + 1) * sc.size + nxt[begin] + 1
    begin, code = (x[np.isin(code, sc.pair_codes)] for x in (begin, code))
    found, notices, covers = [], [], {}
    for p, c in zip(begin.tolist(), code.tolist()):
        t = int(np.searchsorted(first, p, side="right") - 1)
        for i in sc.pairs[c]:
            end = sc.automata[i].longest(num, p, int(first[t + 1]))
            if end > p:
                match = (t, p - int(first[t]), end - int(first[t]), sc.automata[i].label)
                (found if i < sc.full else notices).append(match)
                if i < sc.full:
                    covers.setdefault(t, []).append(match[1:3])
    found += [m for m in notices if not any(m[1] < e and s < m[2] for s, e in covers.get(m[0], ()))]
    return count, places, found


def _scan_rows(shared, text_at: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sc = shared.value
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(text_at)):
                count, places, found = scan(data, offs, sc)
                base = [[] for _ in range(hi - lo)]
                more = [[] for _ in range(hi - lo)]
                lengths = {label: len(ws) for label, ws in sc.phrases}
                for t, p, label in sorted(places):
                    base[t].append({"label": label, "start": p, "end": p + lengths[label]})
                reach: dict = {}
                for t, s, e, label in sorted(found, key=lambda x: (x[0], x[1], -x[2], x[3])):
                    if s >= reach.get((t, label), 0):  # else it begins inside an earlier one of its label
                        reach[t, label] = e
                        more[t].append({"label": label, "start": s, "end": e})
                rest = [i for i in range(batch.num_columns) if i != text_at]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in rest), pa.array(count.astype(np.int64)),
                                                  pa.array(base, span), pa.array(more, span)],
                                                 [*(batch.schema.names[i] for i in rest), "_n", "_base", "_found"])
    return run


def scan_licenses(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), full=FULL_TEXTS, notices=NOTICES, phrases=PHRASES) -> DataFrame:
    """The ``keep`` columns with n_words, phrases and templates, both arrays
    of (label, start, end) in words."""
    df = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("_text"))
    kinds = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    shared = docs.sparkSession.sparkContext.broadcast(build_scanner(full, notices, phrases))
    span = "array<struct<label:string,start:long,end:long>>"
    out = df.mapInArrow(_scan_rows(shared, len(keep)), f"{kinds}_n long, _base {span}, _found {span}")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("_n").alias("n_words"),
                      F.col("_base").alias("phrases"), F.col("_found").alias("templates"))


def license_report(docs: DataFrame) -> DataFrame:
    """n_words, base places and labels, and all labels of every document."""
    df = scan_licenses(docs)
    base, more = F.array_distinct(F.col("phrases.label")), F.array_distinct(F.col("templates.label"))
    return df.select("doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"),
                     F.array_min(F.col("phrases.start")).alias("first_word"), F.array_max(F.col("phrases.start")).alias("last_word"),
                     F.array_join(F.array_sort(base), ",").alias("base_labels"),
                     F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
                     F.when(F.size("templates") > 0, TEMPLATE_SCORE).when(F.size("phrases") > 0, PHRASE_SCORE).otherwise(0.0).alias("score"))
