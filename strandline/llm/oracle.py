"""Corpus queries in plain SQL, where SQL can express their whole result."""

from __future__ import annotations

WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

MIX = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
o AS (
  SELECT *, 3 * sum(s) OVER () - 4 * coalesce(sum(s) OVER (ORDER BY CAST(s AS DOUBLE) / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
    sum(w) OVER (ORDER BY CAST(s AS DOUBLE) / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM w),
f AS (SELECT *, w * l >= 4 * s * a AS isfull FROM o),
t AS (SELECT 3 * (SELECT sum(s) FROM f) - 4 * coalesce(sum(s) FILTER (isfull), 0) AS l, greatest(2 * coalesce(sum(w) FILTER (NOT isfull), 0), 1) AS a FROM f),
g AS (SELECT f.source, f.s AS source_size, CASE WHEN isfull THEN CAST(2 * s AS DOUBLE) ELSE CAST(w * t.l AS DOUBLE) / CAST(t.a AS DOUBLE) END AS target FROM f, t),
b AS (SELECT *, CAST(floor(target) AS BIGINT) // greatest(source_size, 1) AS base, CAST(floor(target) AS BIGINT) % greatest(source_size, 1) AS rest FROM g),
c AS (SELECT d.*, b.source_size, b.target, b.base, b.rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS tied
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(base * size + CASE WHEN upto <= rest THEN size WHEN upto - tied < rest THEN size * (rest - (upto - tied)) // greatest(tied, 1) ELSE 0 END AS BIGINT) AS taken
FROM c
"""

CONTAMINATION = rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS.format("text")} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item, len(x) AS n, array_to_string(x, ' ') AS win FROM (SELECT item, list_slice(ws, k, k + 12) AS x FROM (SELECT item, ws, unnest(generate_series(1, greatest(len(ws) - 12, 1))) AS k FROM i WHERE len(ws) > 0) u) v),
d AS (SELECT doc_id, {WORDS.format("text")} AS ws FROM documents),
lens AS (SELECT DISTINCT n FROM iw),
wins AS (SELECT DISTINCT win FROM iw),
dw AS (SELECT doc_id, n, k, array_to_string(list_slice(ws, k, k + n - 1), ' ') AS win FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS k FROM d, lens WHERE len(ws) >= n) u),
m AS (SELECT DISTINCT dw.doc_id, dw.n, dw.k, dw.win FROM dw JOIN wins USING (win)),
hit AS (SELECT doc_id, CAST(count(DISTINCT p) AS BIGINT) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM m) u GROUP BY doc_id),
its AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT m.doc_id, iw.item FROM m JOIN iw ON iw.win = m.win) u GROUP BY doc_id)
,
tok AS (SELECT doc_id, k - 1 AS pos, ws[k] AS word FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS k FROM d) u),
cnt AS (SELECT word, count(*) AS c FROM tok GROUP BY word),
trm AS (SELECT win, n, off - 1 AS off, word, c, row_number() OVER (PARTITION BY win ORDER BY c, word, off) AS r, count(*) OVER (PARTITION BY win) AS found
  FROM (SELECT win, n, off, x[off] AS word FROM (SELECT DISTINCT win, n, string_split(win, ' ') AS x, unnest(generate_series(1, n)) AS off FROM iw) u) v JOIN cnt USING (word)),
can AS (SELECT DISTINCT t.doc_id, trm.win, trm.n, t.pos - trm.off AS start FROM trm JOIN tok t ON t.word = trm.word WHERE trm.r = 1 AND trm.found = trm.n AND t.pos >= trm.off),
near AS (SELECT can.doc_id, can.win FROM can JOIN trm ON trm.win = can.win JOIN tok t ON t.doc_id = can.doc_id AND t.word = trm.word
  WHERE t.pos BETWEEN can.start + trm.off - 1 AND can.start + trm.off + 1 GROUP BY can.doc_id, can.win, can.start, can.n HAVING count(DISTINCT trm.off) = can.n),
nit AS (SELECT doc_id, CAST(count(DISTINCT item) AS BIGINT) AS n_near FROM near JOIN iw USING (win) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id LEFT JOIN nit ON nit.doc_id = d.doc_id
"""

DOUBLING = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, k, ws[k] AS word, CASE WHEN k + 34 <= len(ws) THEN md5(array_to_string(list_slice(ws, k, k + 34), ' ')) END AS win FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS k FROM d) u),
c AS (SELECT doc_id, k, word, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS again FROM p),
r AS (SELECT doc_id, k, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS off FROM c),
o AS (SELECT doc_id, CAST(count(*) FILTER (off) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (NOT off) AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o ON o.doc_id = d.doc_id
"""

SUFFIXES = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
e AS (SELECT doc_id, j, substr(x, 400 * j + 1, 498) AS y FROM (SELECT doc_id, x, unnest(generate_series(0, (length(x) // 2 - 1) // 200)) AS j FROM d WHERE x <> '') u),
p AS (SELECT doc_id, 200 * j + k AS k, substr(y, 2 * k - 1, 2) AS b, CASE WHEN 2 * (k + 49) <= length(y) THEN md5(substr(y, 2 * k - 1, 100)) END AS win FROM (SELECT doc_id, j, y, unnest(generate_series(1, least(200, length(y) // 2))) AS k FROM e) u),
c AS (SELECT doc_id, k, b, win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id AS again FROM p),
r AS (SELECT doc_id, k, b, bool_or(again) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS off FROM c),
q AS (SELECT *, off AND NOT coalesce(lag(off) OVER (PARTITION BY doc_id ORDER BY k), FALSE) AS head FROM r),
o AS (SELECT doc_id, CAST(count(*) FILTER (off) AS BIGINT) AS n_removed, CAST(count(*) FILTER (head) AS BIGINT) AS n_spans, string_agg(b, '' ORDER BY k) FILTER (NOT off) AS kept FROM q GROUP BY doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN o ON o.doc_id = d.doc_id
"""


SHARDS = r"""
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
a AS (SELECT *, h >> (60 - depth) AS prefix FROM (SELECT *, unnest(generate_series(0, 60)) AS depth FROM d) u),
b AS (SELECT *, sum(bytes) OVER (PARTITION BY depth, prefix) AS shard_bytes, count(*) OVER (PARTITION BY depth, prefix) AS shard_docs FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY depth) AS r FROM b WHERE shard_bytes <= 1048576 OR shard_docs = 1)
SELECT doc_id, bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INT), '0') END AS shard, CAST(depth AS INT) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_docs, shard_bytes > 1048576 AS oversized
FROM c WHERE r = 1
"""


def _merkle() -> str:
    """Trees, grains and edits by nested list functions."""
    digest = lambda xs: f"sha256(array_to_string({xs}, ','))"
    cut = lambda p, size: f"list_transform(range(0, greatest((length({p}) + {size - 1}) // {size}, 1)), lambda i: substr({p}, i * {size} + 1, {size}))"
    tree = lambda t: f"list_transform(string_split({t}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: {digest(f'list_transform({cut("p", 128)}, lambda b: md5(b))')}))"

    def grains(t: str, n: str) -> str:
        level = lambda size: f"list_sort(list_distinct(flatten(list_transform(regexp_split_to_array({t}, '\n\n|\n'), lambda p: list_transform(range(0, greatest((length(p) + {size - 1}) // {size}, 1)), lambda i: substr(md5(concat(i, ':', substr(p, i * {size} + 1, {size}))), 1, 8))))))"
        sizes = ", ".join(level(s) if s == 128 else f"CASE WHEN {n} < {32 * s} THEN {level(s)} END" for s in (128, 64, 32, 16, 8, 4, 2, 1))
        return f"list_filter([{sizes}], lambda x: x IS NOT NULL)"

    sections = lambda ps: f"list_transform({ps}, lambda s: {digest('s')})"
    spelled = lambda ps, g: f"concat_ws(';', {digest(sections(ps))}, array_to_string(list_transform({g}, lambda x: array_to_string(x, ',')), ';'))"
    likeness = lambda x, y: f"CAST(len(list_intersect({x}, {y})) AS DOUBLE) / greatest(len({x}) + len({y}) - len(list_intersect({x}, {y})), 1)"
    same = lambda a, b, i: f"(coalesce({a}[{i} + 1] = {b}[{i} + 1], FALSE) OR coalesce(CASE WHEN {i} + len({a}) - len({b}) >= 0 THEN {a}[{i} + len({a}) - len({b}) + 1] = {b}[{i} + 1] END, FALSE))"
    inner = f"list_transform(list_filter(range(0, len(pb[i + 1])), lambda j: NOT {same('coalesce(pa[i + 1], CAST([] AS VARCHAR[]))', 'pb[i + 1]', 'j')}), lambda j: concat(i, ':', j))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt FROM d),
e AS (SELECT *, concat(substr(t, 1, n - n // 2), substr(nt, 1, n // 2)) AS e FROM n),
f AS (SELECT *, {tree("t")} AS pa, {tree("e")} AS pb, {grains("t", "n")} AS ga, {grains("e", "length(e)")} AS gb, {grains("nt", "length(nt)")} AS gn FROM e),
s AS (SELECT *, {sections("pa")} AS sa, {sections("pb")} AS sb, least(len(ga), len(gb)) AS ke, least(len(ga), len(gn)) AS kn FROM f)
SELECT doc_id, n AS n_chars, sha256(e) AS edited_sha256, {spelled("pa", "ga")} AS fingerprint, {spelled("pb", "gb")} AS edited_fingerprint,
  {likeness("ga[ke]", "gb[ke]")} AS near_edited, {likeness("ga[kn]", "gn[kn]")} AS near_next,
  coalesce(array_to_string(flatten(list_transform(list_filter(range(0, len(sb)), lambda i: NOT {same("sa", "sb", "i")}), lambda i: {inner})), ','), '') AS edits
FROM s
"""


JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("text")} AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, k, k + 4), ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS k FROM d WHERE len(ws) > 0) u),
s AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS t FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b, x.t AS ta, y.t AS tb FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b WHERE 5 * p.c >= 4 * (x.n + y.n - p.c)),
r AS (SELECT doc_id, doc_id AS o FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.o),
k AS (SELECT doc_id, min(o) AS class_id FROM r GROUP BY doc_id),
c AS (SELECT a AS doc_id, count(*) AS n_links, count(DISTINCT tb) FILTER (tb <> ta) AS n_texts FROM l GROUP BY a)
SELECT k.doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_texts, 0) AS n_texts FROM k LEFT JOIN c ON c.doc_id = k.doc_id
"""


NEGATIVES = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) u WHERE r <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS r
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 5
"""

MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
l AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS ls, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS r FROM d),
c AS (SELECT doc_id, t, ls, len(ls) AS n, least(r[1] % (len(ls) + 1), r[2] % (len(ls) + 1)) AS a, greatest(r[1] % (len(ls) + 1), r[2] % (len(ls) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
p AS (SELECT doc_id, t, n, form, array_to_string(ls[1:a], '') AS pre, array_to_string(ls[a + 1:b], '') AS mid, array_to_string(ls[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

TOP = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mix": MIX, "op2_decontamination": CONTAMINATION, "op5_merkle_fingerprints": _merkle(), "op6_extendible_shards": SHARDS, "op7_jaccard_join": JACCARD, "op8_suffix_levels": SUFFIXES, "op9_substring_doubling": DOUBLING, "op11_hard_negatives": NEGATIVES, "op12_fill_in_middle": MIDDLE, "op13_top_k_search": TOP}
