"""DuckDB SQL for the operators that SQL can express exactly."""

from __future__ import annotations

import re

from grainline.llm.decontaminate import MASKS
from grainline.llm.license_templates import PHRASES, TEMPLATES, words_of

_HOST = r"'^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)'"
_PATH = r"'^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)'"


def _n(text: str, at: int) -> str:
    return f"CAST('0x' || substr(md5({text}), {at}, 6) AS BIGINT)"


_DAY0 = 1672531200  # 2023-01-01 UTC

# every rule of every capture by equality, no time buckets
_OP3 = f"""
WITH caps AS (
  SELECT page_id, url, {_DAY0} + ({_n("CAST(page_id AS VARCHAR)", 1)} % 365) * 86400 + {_n("CAST(page_id AS VARCHAR)", 7)} % 86400 AS t,
         lower(regexp_extract(url, {_HOST}, 1)) AS host, rtrim(lower(regexp_extract(url, {_PATH}, 1)), '/') AS path FROM pages),
hosts AS (SELECT DISTINCT host, {_n("host", 1)} % 5 AS kind, {_n("host", 7)} % 200 AS d, {_n("host", 13)} % 40 AS e FROM caps WHERE host <> ''),
log AS (
  SELECT host AS rule, 'block' AS action, 'spam' AS category, d AS day FROM hosts WHERE kind <= 1
  UNION ALL SELECT host, 'remove', 'spam', d + 20 + e FROM hosts WHERE kind <= 1
  UNION ALL SELECT host, 'block', 'malware', d + 100 FROM hosts WHERE kind <= 1
  UNION ALL SELECT host || '/en', 'block', 'adult', d FROM hosts WHERE kind = 2
  UNION ALL SELECT host, 'allow', 'reviewed', d + 30 FROM hosts WHERE kind = 2
  UNION ALL SELECT array_to_string(list_reverse(list_reverse(string_split(host, '.'))[1:3]), '.'), 'block', 'parked', d FROM hosts WHERE kind = 3),
one AS (SELECT rule, day, max(struct_pack(s := CASE action WHEN 'remove' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END, action := action, category := category)) AS x
        FROM log GROUP BY rule, day),
valid AS (SELECT rule, x.action AS verdict, x.category AS category, {_DAY0} + day * 86400 AS since,
                 {_DAY0} + lead(day) OVER (PARTITION BY rule ORDER BY day) * 86400 AS until FROM one),
live AS (SELECT * FROM valid WHERE verdict <> 'remove'),
keys AS (
  SELECT page_id, url, t, array_to_string(list_reverse(list_reverse(p)[1:k]), '.') AS rule
  FROM (SELECT *, string_split(host, '.') AS p FROM caps WHERE host <> ''), range(1, 200) AS r(k) WHERE k <= len(p)
  UNION SELECT page_id, url, t, host || '/' || string_split(path, '/')[2] FROM caps WHERE host <> '' AND len(string_split(path, '/')) >= 2
  UNION SELECT page_id, url, t, array_to_string(list_reverse(list_reverse(p)[1:k]), '.') || '/' || string_split(path, '/')[2]
  FROM (SELECT *, string_split(host, '.') AS p FROM caps WHERE host <> ''), range(1, 200) AS r(k) WHERE k < len(p) AND len(string_split(path, '/')) >= 2),
hit AS (
  SELECT page_id, url, t, rule, verdict, category, since,
         row_number() OVER (PARTITION BY page_id, url, t ORDER BY len(string_split(rule, '/')) DESC, len(string_split(rule, '.')) DESC,
                            length(rule) DESC, rule DESC, verdict DESC, category DESC, since DESC) AS r
  FROM keys JOIN live USING (rule) WHERE since <= t AND (until IS NULL OR t < until))
SELECT c.page_id, c.t AS fetched_s, coalesce(h.verdict, 'none') AS verdict, h.rule, h.category, h.since AS since_s
FROM caps c LEFT JOIN hit h ON h.r = 1 AND c.page_id = h.page_id AND c.url = h.url AND c.t = h.t
"""

_OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS digest FROM p),
o AS (SELECT digest, max(page_id) AS original, count(*) AS c FROM d GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < original THEN original END AS refers_to
FROM d JOIN o USING (digest)
"""

_WORDS = r"string_split_regex(lower(coalesce({c}, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_FITS = " OR ".join(f"len(list_filter(js, lambda x: list_has_all(js, [{', '.join(f'x + {k}' for k, c in enumerate(mask) if c == '1')}]))) > 0" for mask in MASKS)

# token by token on every shift of every pair; a shift counts if a mask fits or
# if it holds three quarters of the item
_OP2 = f"""
WITH i AS (SELECT DISTINCT item_id, list_filter({_WORDS.format(c='text')}, lambda x: x <> '') AS item FROM benchmark),
it AS (SELECT item_id, item, len(item) AS m, unnest(range(1, len(item) + 1)) AS j FROM i WHERE len(item) >= 5),
itw AS (SELECT item_id, m, j, item[j] AS w FROM it),
dw AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, ws FROM (SELECT doc_id, {_WORDS.format(c='text')} AS ws FROM documents)),
dp AS (SELECT doc_id, p, ws[p] AS w FROM dw),
same AS (SELECT doc_id, item_id, m, p - j AS shift, j FROM dp JOIN itw USING (w)),
shifts AS (SELECT doc_id, item_id, m, shift, list(j) AS js FROM same GROUP BY ALL HAVING count(*) >= 0.75 * m OR count(*) >= 6),
runs AS (SELECT doc_id, item_id, m, unnest(js) AS j FROM shifts WHERE len(js) >= 0.75 * m OR {_FITS})
SELECT doc_id, item_id, CAST(m AS BIGINT) AS n_item, CAST(count(DISTINCT j) AS BIGINT) AS n_matched, count(DISTINCT j) / m AS overlap
FROM runs GROUP BY doc_id, item_id, m HAVING count(DISTINCT j) >= 0.75 * m
"""

# all pairs that share a shingle, counted, then components by label spreading
_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) >= @k THEN list_distinct(list_transform(range(1, len(ws) - @k + 2), lambda i: array_to_string(ws[i:i + @k - 1], ' ')))
                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM g),
e AS (SELECT doc_id, md5(unnest(s)) AS k FROM g),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM e a JOIN e b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= @t * (nx.n + ny.n - o)),
sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, sym.y FROM reach JOIN sym ON sym.x = reach.b)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE a = n.doc_id) AS component_id FROM n
"""


def _jaccard(words: int, percent: int) -> str:
    return _JACCARD.replace("@k", str(words)).replace("@t", str(percent))


_OP11 = f"SELECT *, component_id = doc_id AS kept FROM ({_jaccard(4, 80)})"


# every document of every item, no bounds
_OP12 = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
i AS (SELECT item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS q FROM i GROUP BY ALL),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(ws)) AS BIGINT) AS terms FROM t WHERE len(ws) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, c GROUP BY term, docs),
m AS (SELECT r, doc_id, 75 + ((25 * len(ws) * docs) // terms) AS m FROM t, c WHERE len(ws) > 0),
s AS (SELECT item_id, r, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM tf JOIN m USING (r) JOIN w USING (term) JOIN q USING (term) GROUP BY ALL),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 20
"""


def _crc32_table() -> str:
    """DuckDB list of the remainders of the 256 byte values."""
    step = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    out = "SELECT x, CAST(x AS BIGINT) AS v FROM range(256) AS b(x)"
    for _ in range(8):
        out = f"SELECT x, {step} AS v FROM ({out})"
    return f"SELECT list(v ORDER BY x) AS tab FROM ({out})"


# each conversation's prefixes as lists, nodes by equality of whole lists
_OP13 = f"""
WITH crc AS ({_crc32_table()}),
own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
               {{{{'r': coalesce(role, ''), 'x': coalesce(text, '')}}}} AS t FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 100 AS base, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS bytes
        FROM (SELECT DISTINCT conv_id FROM own)),
plan AS (SELECT conv_id, base, xor(list_reduce(list_concat([4294967295], bytes), lambda crc, c: xor(tab[(xor(crc, c) & 255) + 1], crc >> 8)), 4294967295) % 6 AS h
         FROM ids, crc),
turns AS (SELECT p.conv_id, 0 AS part, pos, t FROM plan p JOIN own ON own.conv_id = p.base AND pos <= h
          UNION ALL SELECT p.conv_id, 1, pos, t FROM plan p JOIN own ON own.conv_id = p.conv_id AND pos > h),
seq AS (SELECT plan.conv_id, coalesce(s, []) AS s FROM plan LEFT JOIN (SELECT conv_id, list(t ORDER BY part, pos) AS s FROM turns GROUP BY conv_id) USING (conv_id)),
pre AS (SELECT conv_id, len(s) AS n, d, s[1:d] AS path FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seq)),
node AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS longest,
                string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d) AS ends FROM pre GROUP BY path, d),
under AS (SELECT path[1:a] AS path, a, d, longest, n_convs, length(path[d].x) AS cp FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM node)),
sums AS (SELECT path, count(*) FILTER (d = a + 1) AS n_children, count(*) FILTER (longest = d) AS n_leaves,
                sum((n_convs - 1) * coalesce(cp, 0)) AS saved_tokens FROM under GROUP BY path)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM node n JOIN sums s ON s.path = n.path LEFT JOIN node p ON n.d > 0 AND p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]
""".replace("{{", "{").replace("}}", "}")



def _template_pattern(template: str) -> str:
    """A license template as a pattern over words that each end in a space."""
    def seq(parts: list[str]) -> str:
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
                out += "".join(w + " " for w in words_of(p))
        return out
    return seq(re.split(r"(<<[^<>]*>>)", template))


def _op9() -> str:
    places = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(0, len(ws) - {len(p.split()) - 1}), lambda i: "
        + " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(p.split())) + ")) AS place FROM w" for p, label in PHRASES.items())
    found = " UNION ".join(f"SELECT doc_id, '{label}' AS label FROM l WHERE regexp_matches(line, ' {_template_pattern(t)}')" for label, t in TEMPLATES)
    return f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
l AS (SELECT doc_id, ' ' || array_to_string(ws, ' ') || ' ' AS line FROM w),
p AS ({places}),
t AS ({found}),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
      FROM p GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM p UNION SELECT doc_id, label FROM t) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels,
       CASE WHEN w.doc_id IN (SELECT doc_id FROM t) THEN 1.0 WHEN n_base IS NOT NULL THEN 0.5 ELSE 0.0 END AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""


ORACLE: dict[str, str] = {"op2_decontamination": _OP2, "op3_url_lists": _OP3, "op8_warc": _OP8, "op9_license_templates": _op9(), "op10_ngram_join": _jaccard(5, 75),
                          "op11_minhash_dedup": _OP11, "op12_norm_buckets": _OP12, "op13_prefix_trie": _OP13}
