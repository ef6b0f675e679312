"""DuckDB SQL for the training-data operators that SQL can express.

op3 (inferred grammars), op5 (float impacts of an index), op6 and op13 (merges), op7, op10 (classifiers) and op8 (a tree of
unknown depth) have none; the tests hold them against brute force, the library or held-out labels.
"""

from __future__ import annotations

from functools import reduce

from .codes import ENTRIES, PARTS, ROUNDS, SCALE
from .licenses import CONTAINMENT, PHRASES, TEMPLATES, width_of
from .lm import FINE, STRENGTH

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(len(words) - 4), lambda i: array_to_string(words[i + 1 : i + 5], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS items FROM w),
members AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.item = b.item AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT both_ways.b, reach.other FROM reach JOIN both_ways ON both_ways.a = reach.doc_id),
components AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(items) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN components USING (doc_id)
"""

# A sum of doubles that doesn't depend on their order: exact, rounded once.
_SUM = f"CAST(sum(CAST(round({{}} * {1 << FINE}::DOUBLE) AS HUGEINT)) AS DOUBLE) / {1 << FINE}::DOUBLE"
OP2 = rf"""
WITH RECURSIVE bits(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
bytes AS (SELECT i, c FROM bits WHERE k = 8),
crc(doc_id, rest, c) AS (SELECT doc_id, CAST(doc_id AS VARCHAR), CAST(4294967295 AS BIGINT) FROM documents
    UNION ALL SELECT doc_id, substr(rest, 2), xor(crc.c >> 8, bytes.c) FROM crc JOIN bytes ON bytes.i = xor(crc.c, ascii(rest)) & 255 WHERE rest <> ''),
folds AS (SELECT doc_id, xor(c, 4294967295) % 7 = 2 AS held_out FROM crc WHERE rest = ''),
listed AS (SELECT doc_id, held_out, list_append({_WORDS}, ' ') AS words FROM documents JOIN folds USING (doc_id)),
tokens AS (SELECT doc_id, held_out, unnest(words) AS w, unnest(range(len(words))) AS place FROM listed),
placed AS (SELECT *, lag(w, 1) OVER d AS w1, lag(w, 2) OVER d AS w2 FROM tokens WINDOW d AS (PARTITION BY doc_id ORDER BY place)),
one AS (SELECT w, count(*) AS c FROM placed WHERE NOT held_out GROUP BY w),
two AS (SELECT w1, w, count(*) AS c FROM placed WHERE NOT held_out AND w1 IS NOT NULL GROUP BY w1, w),
three AS (SELECT w2, w1, w, count(*) AS c FROM placed WHERE NOT held_out AND w2 IS NOT NULL GROUP BY w2, w1, w),
totals AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM one),
counted AS (SELECT p.doc_id, p.held_out, coalesce(one.c, 0) AS c1, coalesce(h1.c, 0) AS h1, coalesce(two.c, 0) AS c2, coalesce(h2.c, 0) AS h2, coalesce(three.c, 0) AS c3 FROM placed p
    LEFT JOIN one ON one.w = p.w LEFT JOIN one h1 ON h1.w = p.w1 LEFT JOIN two ON two.w1 = p.w1 AND two.w = p.w
    LEFT JOIN two h2 ON h2.w1 = p.w2 AND h2.w = p.w1 LEFT JOIN three ON three.w2 = p.w2 AND three.w1 = p.w1 AND three.w = p.w),
first AS (SELECT *, (c1 + 1.0::DOUBLE) / (n + v + 1.0::DOUBLE) AS p1 FROM counted, totals),
second AS (SELECT *, (c2 + {STRENGTH}::DOUBLE * p1) / (h1 + {STRENGTH}::DOUBLE) AS p2 FROM first),
walked AS (SELECT doc_id, held_out, c1, n, log10(p1) AS base,
    CASE WHEN c3 > 0 THEN log10((c3 + {STRENGTH}::DOUBLE * p2) / (h2 + {STRENGTH}::DOUBLE))
    ELSE CASE WHEN h2 > 0 THEN log10({STRENGTH}::DOUBLE / (h2 + {STRENGTH}::DOUBLE)) ELSE 0 END
        + CASE WHEN c2 > 0 THEN log10(p2) WHEN h1 > 0 THEN log10({STRENGTH}::DOUBLE / (h1 + {STRENGTH}::DOUBLE)) ELSE 0 END
        + CASE WHEN c2 > 0 THEN 0 ELSE log10(p1) END END AS weight FROM second)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c1 > 0) AS n_known, any_value(n) AS train_tokens,
    {_SUM.format("base")} AS base_score, {_SUM.format("weight")} AS score FROM walked GROUP BY doc_id, held_out
"""

_DOT = "list_reduce(list_transform(range(len({0})), lambda i: {0}[i + 1] * {1}[i + 1]), lambda x, y: x + y)"
OP4 = rf"""
WITH cast_ AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
good AS (SELECT vec_id, v, sqrt({_DOT.format("v", "v")}) AS size FROM cast_ WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, {_DOT.format("q.v", "c.v")} / (q.size * c.size) AS score
    FROM good q JOIN good c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
"""


def _phrase(phrase: str, label: str) -> str:
    test = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(phrase.split(), 1))
    return f"list_transform(list_filter(range(len(words)), lambda i: coalesce({test}, false)), lambda i: {{'label': '{label}', 'start': i}})"


def _licenses() -> str:
    rows = ", ".join(f"('{label}', {sorted(set(t.split()))!r}, {width_of(t)})" for label, t in TEMPLATES)
    places = reduce(lambda a, b: f"list_concat({a}, {b})", [_phrase(p, v) for p, v in PHRASES.items()])
    return rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
templates(label, need, wide) AS (VALUES {rows}),
likely AS (SELECT r, words, label, need, wide FROM w JOIN templates ON len(list_intersect(need, list_distinct(words))) >= {CONTAINMENT} * len(need) - 1e-9),
windows AS (SELECT r, label, len(need) AS size, list_max(list_transform(range(greatest(len(words) - wide + 1, 1)), lambda k: len(list_intersect(need, list_distinct(words[k + 1 : k + wide]))))) AS most FROM likely),
met AS (SELECT r, list(label) AS labels, max(CAST(most AS DOUBLE) / size) AS containment FROM windows WHERE most >= {CONTAINMENT} * size - 1e-9 GROUP BY r),
found AS (SELECT r, doc_id, len(words) AS n, {places} AS places FROM w)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
    list_min(list_transform(places, lambda p: p.start)) AS first_word, list_max(list_transform(places, lambda p: p.start)) AS last_word,
    array_to_string(list_sort(list_distinct(list_transform(places, lambda p: p.label))), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(list_transform(places, lambda p: p.label), coalesce(labels, [])))), ',') AS labels,
    CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0.0::DOUBLE) END AS score
FROM found LEFT JOIN met USING (r)
"""


_CASED_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
# Each document meets each order: it goes at the first of the filters that it fails.
OP11 = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_CASED_WORDS} AS words FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM w LEFT JOIN l USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
gone AS (SELECT *, coalesce(list_min(list_transform(string_split(fails, ''), lambda c: CASE WHEN c = '' THEN 6 ELSE instr(filter_order, c) END)), 6) AS gone_at FROM f, orders),
steps AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS own, count(*) FILTER (gone_at > step) AS kept, count(*) FILTER (gone_at = step) AS removed,
    count(*) FILTER (gone_at < step AND contains(fails, substr(filter_order, step, 1))) AS redundant, count(*) FILTER (fails = substr(filter_order, step, 1)) AS unique_fails,
    count(*) FILTER (gone_at = step AND good) AS good_lost, count(*) FILTER (gone_at = step AND toxic) AS toxic_lost
    FROM (SELECT *, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM gone) GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM steps
"""


def _op12() -> str:
    """Every part against every entry, in doubles that hold all integers here; rounds one after the other."""
    far = "list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, b.x) + list_dot_product(b.x, b.x)"
    sql = rf"""
WITH finite AS (SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda v: floor(CAST(v AS DOUBLE) * {SCALE})) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
p AS MATERIALIZED (SELECT id, vec_id, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS x FROM finite, (SELECT unnest(range({PARTS})) AS part)),
book0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY entry < {ENTRIES})"""
    for r in range(ROUNDS + 1):
        sql += rf""",
near{r} AS MATERIALIZED (SELECT id, part, arg_min(entry, ({far}, entry)) AS entry, min({far}) AS distance FROM p JOIN book{r} b USING (part) GROUP BY id, part)"""
        if r < ROUNDS:
            sql += rf""",
sums{r} AS (SELECT part, entry, place, floor(sum(p.x[place]) / count(*)) AS mean FROM p JOIN near{r} USING (id, part), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS place) GROUP BY part, entry, place),
book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN (SELECT part, entry, list(mean ORDER BY place) AS x FROM sums{r} GROUP BY part, entry) m USING (part, entry))"""
    return sql + rf""",
done AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(distance) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda c: CAST(c AS BIGINT)), ','), ',' ORDER BY part, entry)) FROM book{ROUNDS}) AS codebooks_sha256
FROM done JOIN finite USING (id)
"""


ORACLE_SQL: dict[str, str] = {"op1_near_duplicates": OP1, "op2_lm": OP2, "op4_neighbours": OP4, "op9_licenses": _licenses(), "op11_audit": OP11, "op12_codes": _op12()}
