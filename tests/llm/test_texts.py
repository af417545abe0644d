"""Text operators against brute force: classifier, PII, tokens, licenses."""
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainline.llm import license_templates as L
from grainline.llm import pii as P
from grainline.llm import quality_crf as Q
from grainline.llm import sentencepiece_codec as S

SF = "/root/testdata/sf0.01"
CLASH = "doc_id long, text string, score double, n_words long, _spans string, n_tokens int, tokens string, label int, _text string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0.1, 1, "s", 2, "t", 1, "u") for i, t in rows], CLASH)


EDGE = [(1, None), (2, ""), (3, "\n\n"), (4, "x"), (None, "some text\nsecond line."), (5, "a b\n" * 20000), (5, "a b\n" * 20000), (6, "w" * 200000)]


# ---- classifier ---------------------------------------------------------------

def test_quality_on_the_held_out_fold(spark):
    d, l = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = Q.quality_report(d, l).join(l, "doc_id").where("held_out").toPandas()
    assert len(rows) > 40 and rows["score"].between(0, 1).all()
    good, bad = rows[rows.quality == 1].score.to_numpy(), rows[rows.quality == 0].score.to_numpy()
    assert ((good[:, None] > bad[None]).mean()) >= 0.97
    assert (rows.predicted == rows.quality).mean() >= 0.95


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(1)
    first = np.array([0, 1, 5, 8])
    e, t = rng.normal(size=8), rng.normal(size=(2, 2))
    share = rng.random(8)
    good, joint = Q._chains(e, first, t, share)
    exp = np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:]):
        n = b - a
        w = np.zeros((2,) * n)
        for path in np.ndindex(*w.shape):
            w[path] = np.exp(sum(e[a + i] * y for i, y in enumerate(path)) + sum(t[x, y] for x, y in zip(path, path[1:])))
        w /= w.sum()
        for i in range(n):
            assert abs(good[a + i] - w.sum(axis=tuple(j for j in range(n) if j != i))[1]) < 1e-10
            if i:
                exp += w.sum(axis=tuple(j for j in range(n) if j not in (i - 1, i))) * share[a + i]
    assert np.allclose(joint, exp)


def test_line_features():
    texts = ["Aa b!\n\n a a ", "", "é|1\tx\r\nZZ", "\n"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0] + [len(x.encode()) for x in texts])
    f, w, first = Q.line_features(data, offs)
    assert first.tolist() == [0, 2, 3, 5, 6]
    assert np.allclose(w, [5, 5, 1, 6, 2, 1])
    assert np.isclose(f[0, 3], 1 / 3) and np.isclose(f[0, 7], 0.5) and np.isclose(f[1, 13], 0.5) and np.isclose(f[4, 3], 1)
    near = Q.with_neighbours(f, first)
    k = f.shape[1]
    assert (near[1, k:2 * k] == f[0]).all() and (near[0, 2 * k:3 * k] == f[1]).all() and not near[2, k:3 * k].any()


def test_quality_edges(spark):
    d = docs(spark, EDGE)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(1, 7)] + [(None, 1, 0), (4, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    out = Q.quality_report(d, labels).collect()
    assert len(out) == len(EDGE) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 5}) == 1
    assert [r.held_out for r in out if r.doc_id is None] == [False]
    assert {r.score for r in Q.quality_report(d, labels.limit(0)).collect()} == {0.5}
    assert Q.quality_report(d.limit(0), labels).collect() == []
    kept = Q.keep_good(d, labels)
    assert kept.columns == d.columns


# ---- personal data ------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(int("0246813579"[int(c)]) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")),
                  "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()
            if ok:
                out.append((kind, m.start(), m.end(), m[0]))
    return out


def random_texts(n):
    rng = np.random.default_rng(2)
    parts = ["a@b.c", ".", "@", "x.y-z_%+@d-e.f.g", "1.2.3.4", "256.1.1.1", "007.08.9.255", " ", "-", "4012888888881881", "4012 8888 8888 1881", "1",
             "+1 (456) 555-2186", "+", "(", ")", "é", "日本", "\n", "word", "12345678", "--", "  ", "5.5.", "😀", "@a.b", "4012-8888-8888-1881-"]
    return ["".join(rng.choice(parts, size=rng.integers(1, 14))) for _ in range(n)]


def test_base_spans(spark):
    rows = list(enumerate(random_texts(1500))) + [(9000, None), (9001, ""), (9002, "a" * 4000 + "@"), (9003, "1" * 4000), (9004, "1." * 3000), (9005, "a@" + "b.c" * 2000),
                                                  (9006, "1 " * 3000), (9007, "é" * 500 + "+1 (456) 555-2186")]
    got = {r.doc_id: r for r in P.span_report(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        exp = brute_spans(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in exp)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(e[0] == k for e in exp) for k in P.KINDS], t
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.spans.startswith(text), t


def scanned(text):
    """(start, end, lower-cased word), character by character."""
    out, at = [], None
    for i, c in enumerate(text + " "):
        if ord(c) > 127 or c in "0123456789" or "a" <= c.lower() <= "z":
            at = i if at is None else at
        elif at is not None:
            out.append((at, i, text[at:i].lower()))
            at = None
    return out


def brute_disclosures(texts, support=2, level=0.8):
    """Spans of disclosing terms of each text, from the docstring's formulas."""
    n, z2 = len(texts), P.CONFIDENCE ** 2
    f_t, f_c, f_ct, places = {}, {}, {}, []
    for t in ((x or "") for x in texts):
        masked, held = list(t), set()
        for kind, a, b, hit in brute_spans(t):
            masked[a:b] = " " * (b - a)
            held.add(kind + ":" + (hit.lower() if kind == "email" else hit if kind == "ip" else re.sub("[^0-9]", "", hit)))
        words = scanned("".join(masked)) if held else []
        places.append((held, words))
        for w in {w for _, _, w in scanned(t)}:
            f_t[w] = f_t.get(w, 0) + 1
        for c in held:
            f_c[c] = f_c.get(c, 0) + 1
            for w in {w for _, _, w in words}:
                f_ct[c, w] = f_ct.get((c, w), 0) + 1

    def risky(c, w):
        k, m = f_ct[c, w], max(f_t.get(w, 0), f_ct[c, w])
        if k < support or f_c[c] == n or k == 1 < m:
            return False
        p = k / m
        low = (p + z2 / (2 * m) - P.CONFIDENCE * np.sqrt(p * (1 - p) / m + z2 / (4 * m * m))) / (1 + z2 / m)
        return 1 + np.log2(low) / np.log2(n / f_c[c]) >= level
    return [sorted({(a, b) for a, b, w in words if any(risky(c, w) for c in held)}) for held, words in places]


def test_disclosing_terms(spark):
    rng = np.random.default_rng(4)
    common = [f"c{i}" for i in range(30)]
    texts = [" ".join(rng.choice(common, size=60)) for _ in range(60)]
    for i in range(24):
        who = i % 6
        t = " ".join(rng.choice(common, size=30)) + f" Alpha{who} 77{who}1 é{who}ß mail{who}@x.org rare{i} " + " ".join(rng.choice(common, size=30))
        texts.append(t)
    texts += ["", None, "lone@x.org hapax", texts[60], texts[60]]
    df = docs(spark, list(enumerate(texts)))
    got = {r.doc_id: sorted(tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("term:")) for r in P.span_report(df).collect()}
    exp = brute_disclosures(texts)
    assert [got[i] for i in range(len(texts))] == exp and sum(map(len, exp)) > 20
    clean = P.sanitise(df, "text", "text")
    assert set(df.columns) <= set(clean.columns)
    out = {r.doc_id: r.text for r in clean.collect()}
    assert out[0] == texts[0] and out[84] == "" and out[85] is None and out[86] == "[EMAIL] hapax"
    assert "Alpha0" not in out[60] and "mail0@x.org" not in out[60] and "[EMAIL]" in out[60] and texts[60].split()[3] in out[60]


@pytest.mark.parametrize("support", [1, 2])
def test_disclosing_terms_by_scan(spark, support):
    """Capitals, mixed case, words beyond ASCII, terms that other texts hold."""
    rng = np.random.default_rng(11)
    common = [f"Word{i}" for i in range(12)] + ["ÉTÉ", "été", "THE", "The", "the", "x_y", "né-à", "[a]"]
    texts = [" ".join(rng.choice(common, size=30)) for _ in range(60)]
    for i in range(30):
        who = i % 12
        extra = [f"NAME{who}", f"Sur{who}", f"ÉLAN{who}", f"élan{who}", f"Odd{i}", f"p{who}@mail.org", f"+1 (456) 555-21{who:02d}"]
        texts.append(" ".join(rng.permutation(extra + list(rng.choice(common, size=20)))))
    texts += ["Odd3 again", "sur5 elsewhere", "", None]
    got = {r.doc_id: sorted(tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("term:"))
           for r in P.span_report(docs(spark, list(enumerate(texts))), min_support=support).collect()}
    exp = brute_disclosures(texts, support)
    assert [got[i] for i in range(len(texts))] == exp and sum(map(len, exp)) > 60


def test_names_in_capitals(spark):
    """Names go whole, however they are written."""
    texts = ["JOHN SMITHSON wrote from jq77@example.org to Mary Poppinsky"] + ["the note wrote from home to all of us"] * 60
    clean = P.sanitise(docs(spark, list(enumerate(texts))), "text", "text", min_support=1)
    assert clean.where("doc_id = 0").first().text == "[NAME] [NAME] wrote from [EMAIL] to [NAME] [NAME]"
    assert {r.text for r in clean.where("doc_id > 0").collect()} == set(texts[1:])


def test_terms_of_values_seen_once(spark):
    """Support 1: an entity of one text, at any distance, every mention; a term shared by all texts stays."""
    rng = np.random.default_rng(7)
    common = [f"c{i}" for i in range(30)]
    fill = lambda n: " ".join(rng.choice(common, size=n))
    texts = [" ".join(common) + " " + fill(60) for _ in range(150)]
    texts.append(f"once@x.org {fill(80)} Farname {fill(80)} Farname")  # hundreds of characters away
    for k in range(3):  # the value's other texts hold the name out of its reach
        texts.append(f"Sharedname {fill(60)} pair@x.org {fill(60)} Sharedname")
    texts.append(texts[150])  # an exact copy changes nothing
    df = docs(spark, list(enumerate(texts)))
    out = {r.doc_id: r.text for r in P.sanitise(df, "text", "text", min_support=1).collect()}
    assert "Farname" not in out[150] and out[150] == out[154]
    assert all("Sharedname" not in out[i] for i in (151, 152, 153))
    words = [w for i in (150, 151) for w in texts[i].split() if w in common]
    kept = [w for i in (150, 151) for w in out[i].split() if w in common]
    assert kept == words and all(out[i] == texts[i] for i in range(150))


def test_many_spans_in_one_text(spark):
    """Folds run in blocks of 256; overlapping kinds keep places."""
    t = "user7@mail.org and 1.2.3.4@x.yz +12 345 678 9.9.9.9 é " * 400
    df = docs(spark, [(1, t), (2, t)])
    r = P.span_report(df).where("doc_id = 1").first()
    exp = brute_spans(t)
    assert r.spans.startswith(",".join(f"{k}:{a}:{b}" for k, a, b, _ in exp)) and len(exp) > 1500
    terms = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("term:")]
    assert all(t[a:b] in ("and", "é") for a, b in terms)
    clean = P.sanitise(df, "text", "out").where("doc_id = 1").first().out
    assert not brute_spans(clean) and clean.count("[EMAIL]") == 800


def test_pii_edges(spark):
    d = docs(spark, EDGE)
    out = P.span_report(d).collect()
    assert len(out) == len(EDGE) and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in out)
    assert P.span_report(d.limit(0)).collect() == []
    twice = docs(spark, [(1, "x a@b.co"), (1, "x a@b.co"), (None, "x a@b.co")])
    assert len({r.spans for r in P.span_report(twice).collect()}) == 1


# ---- tokens -------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    return S.read_vocabulary()


def brute_encode(text, v):
    score = {int(i): float(s) for i, s in zip(v.ids, v.scores)}
    table = {bytes(v.raw[v.raw_at[i]:v.raw_at[i + 1]]).decode(): i for i in score}
    s = " " + text
    best, back = [0.0] + [-1e300] * len(s), [None] * (len(s) + 1)
    for j in range(1, len(s) + 1):
        for n in range(min(v.longest, j), 0, -1):
            p = s[j - n:j]
            gain, i = (score[table[p]], table[p]) if p in table and "▁" not in p else (v.unknown, None)
            if i is None and n > 1:
                continue
            if best[j - n] + gain > best[j]:
                best[j], back[j] = best[j - n] + gain, (n, i)
    out, j = [], len(s)
    while j:
        n, i = back[j]
        out.append([i] if i is not None else [int(v.byte_ids[b]) for b in s[j - 1].encode()])
        j -= n
    return [i for o in reversed(out) for i in o] if text else []


def test_encode_by_brute_force(spark, vocabulary):
    real = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    texts = [t[:600] for t in real] + ["", " ", "   ", "  a  b ", "a\n\nb\tc", "▁x▁ ▁", "日本語 é😀", "z" * 900, "\u0000\x7f", "x  " * 50]
    df = docs(spark, list(enumerate(texts)) + [(500, None), (None, "a"), (7, texts[7])])
    out = S.encode(df)
    rows = out.collect()
    assert len(rows) == len(texts) + 3 and "lang" not in out.columns and out.columns.count("tokens") == 1
    got = {r.doc_id: r for r in rows}
    for i, t in enumerate(texts):
        assert got[i].tokens == brute_encode(t, vocabulary), t[:40]
        assert got[i].round_trip and got[i].n_tokens == len(got[i].tokens)
    assert got[500].tokens is None
    back = S.decode(out.select("doc_id", "tokens", F.lit("clash").alias("text")))
    texts_back = {r.doc_id: r.text for r in back.collect()}
    assert all(texts_back[i] == t for i, t in enumerate(texts)) and texts_back[500] is None
    assert S.encode(df.limit(0)).collect() == [] and S.decode(out.limit(0).select("doc_id", "tokens")).collect() == []
    with pytest.raises(Exception, match="outside the vocabulary"):
        S.decode(out.select("doc_id", F.array(F.lit(10 ** 6)).alias("tokens"))).collect()


def test_cache_limit_changes_nothing(vocabulary, monkeypatch):
    texts = ["one two three", "two three four", "four five one " * 30]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0] + [len(t) for t in texts])
    first = S.Encoder(vocabulary).encode(data, offs)
    monkeypatch.setattr(S, "CACHE_WORDS", 1)
    e = S.Encoder(vocabulary)
    for _ in range(3):
        again = e.encode(data, offs)
        assert (again[0] == first[0]).all() and (again[1] == first[1]).all()


# ---- licenses -----------------------------------------------------------------

def template_regex(template):
    """The template as a regular expression over the words of a text."""
    def seq(parts):
        out = ""
        while parts:
            p = parts.pop(0)
            if p == "<<beginOptional>>":
                out += "(?:" + seq(parts) + ")?"
            elif p == "<<endOptional>>":
                return out
            elif p.startswith("<<var;"):
                out += "(?:[^ ]+ ){0,%d}" % int(p[6:-2])
            else:
                out += "".join(re.escape(w) + " " for w in L.words_of(p))
        return out
    return seq(re.split(r"(<<[^<>]*>>)", template))


def brute_labels(text):
    words = L.words_of(text or "")
    line = "".join(w + " " for w in words)
    found, spans = set(), []
    for k, (label, t) in enumerate(L.TEMPLATES):  # full texts first
        for m in re.finditer(r"(?:^|(?<= ))(?=(" + template_regex(t) + "))", line):
            if k < len(L.FULL_TEXTS):
                spans.append(m.span(1))
            elif any(m.start(1) < e and s < m.end(1) for s, e in spans):
                continue
            found.add(label)
    places = [(k, label) for p, label in L.PHRASES.items() for k in range(len(words)) if words[k:k + len(p.split())] == p.split()]
    return len(words), places, found


def test_licenses(spark):
    fill = {"<<beginOptional>>": "", "<<endOptional>>": ""}
    texts = []
    for _, t in L.TEMPLATES:
        whole = re.sub(r"<<var;[0-9]+>>", "Foo", re.sub(r"<<(?:begin|end)Optional>>", " ", t))
        bare = re.sub(r"<<var;[0-9]+>>", "", re.sub(r"<<beginOptional>>.*?<<endOptional>>", " ", t, flags=re.S))
        texts += [f"intro. {whole} outro", bare, whole.upper(), whole.replace("the", "teh", 1), " ".join(whole.split()[:-1])]
    texts += ["", None, "CC BY-NC, cc by; ALL rights\nreserved all rights", "general public", "éall rights reserved", "x" * 100000, "cc " * 50000 + "by",
              "Copyright " + "a " * 13 + "all rights reserved", "Copyright 2020 X. All rights reserved."]
    rows = list(enumerate(texts)) + [(None, texts[0]), (0, texts[0])]
    out = L.license_report(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        n, places, found = brute_labels(texts[r.doc_id or 0])
        assert r.n_words == n and r.n_base == len(places)
        assert (r.first_word, r.last_word) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({b for _, b in places}))
        assert r.labels == ",".join(sorted({b for _, b in places} | found)), texts[r.doc_id or 0][:80]
        assert r.score == (1.0 if found else 0.5 if places else 0.0)
    assert L.license_report(docs(spark, rows).limit(0)).collect() == []


def test_whole_licenses(spark):
    """Licenses as projects ship them; changed or added clauses are refused."""
    grant = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
    warranty = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
OR OTHER DEALINGS IN THE SOFTWARE."""
    clauses = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
    names = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
    disclaimer = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
    isc = """ISC License\n\nCopyright (c) 2004-2010 by Some Consortium\n\nPermission to use, copy, modify, and/or distribute this software for any purpose
with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
    apache = """# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at\n#\n#    http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required by applicable law or agreed to in
# writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
# implied. See the License for the specific language governing permissions and limitations under the License."""
    mit = f"MIT License\n\nCopyright (c) 2020 A. Person. All rights reserved.\n\n{grant}\n\n{warranty}"
    owner = "Copyright (c) 1999, The Authors. All rights reserved.\n\n"
    cases = [(mit, "mit"), (owner + clauses + disclaimer, "bsd-2-clause"), (owner + clauses + names + disclaimer, "bsd-3-clause"), (isc, "isc"), (apache, "apache-2.0"),
             (mit.replace("AUTHORS OR COPYRIGHT HOLDERS", "FOO FOUNDATION"), "mit"),
             (mit.replace("WITHOUT WARRANTY OF ANY KIND", "WITH SOME WARRANTY"), None),
             (mit.replace(warranty, "The Software shall be used for Good, not Evil.\n" + warranty), None), (mit.replace(warranty, ""), None),
             (owner + clauses + names, None), ((owner + clauses + names + disclaimer).replace("without specific prior", "with no"), None),
             (isc.replace("INDIRECT, OR", "OR"), None), (isc.split("THE SOFTWARE")[0], None),
             (apache.replace("http:", "https:"), "apache-2.0"), (apache.replace("Unless required", "If required"), "apache-2.0")]  # the last: its notice line
    out = {r.doc_id: r for r in L.scan_licenses(docs(spark, [(i, t) for i, (t, _) in enumerate(cases)])).collect()}
    for i, (text, label) in enumerate(cases):
        got = [t.label for t in out[i].templates if t.label != "proprietary"]
        assert got == ([label] if label else []), text[:200]
        whole = label and i < 6
        assert not (whole and [t for t in out[i].templates if t.label == "proprietary"])  # the owner's line belongs to the license
    assert out[14].templates[0].end - out[14].templates[0].start == 8


def test_template_regions():
    number = {}
    a = L.compile_template("x", "a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> <<var;2>> d", number)
    words = lambda s: np.array([number.get(w, -1) for w in s.split()])
    for text, end in (("a d", 2), ("a b d", 3), ("a b c d", 4), ("a x y d", 4), ("a x y z d", -1), ("a b c x y d", 6), ("a c d", 3), ("a d d d", 4), ("b d", -1)):
        assert a.longest(words(text), 0, len(text.split())) == end, text
    with pytest.raises(ValueError):
        L.compile_template("x", "a <<beginOptional>> b", {})
