"""The queries of catalog.py in plain SQL over the tables they read."""

from __future__ import annotations

import re

VIEWS = {
    "pg_node": """SELECT node, chr, len, rank,
  CASE WHEN rank = 0 THEN CAST(SUM(CASE WHEN rank = 0 THEN len ELSE 0 END) OVER (PARTITION BY chr ORDER BY node) AS BIGINT) - len + 1 END AS start_pos,
  CASE WHEN rank = 0 THEN CAST(SUM(CASE WHEN rank = 0 THEN len ELSE 0 END) OVER (PARTITION BY chr ORDER BY node) AS BIGINT) END AS end_pos
FROM (SELECT CAST(p_partkey AS BIGINT) + 1 AS node, p_brand AS chr, CAST(p_size AS BIGINT) AS len, CASE WHEN p_partkey % 5 >= 2 THEN 1 ELSE 0 END AS rank FROM part) t""",
    "pg_step": """SELECT asm, chr, node, ori, len, rank,
  CAST(ROW_NUMBER() OVER (PARTITION BY asm, chr ORDER BY node) AS BIGINT) - 1 AS idx,
  CAST(SUM(len) OVER (PARTITION BY asm, chr ORDER BY node) AS BIGINT) - len + 1 AS qpos
FROM (SELECT n.node, n.chr, n.len, n.rank, CAST(a.n_nationkey AS BIGINT) AS asm,
        CASE WHEN n.rank = 1 AND (n.node * 31 + a.n_nationkey * 7) % 11 = 0 THEN '<' ELSE '>' END AS ori
      FROM pg_node n JOIN nation a
        ON (n.rank = 0 AND (a.n_nationkey = 0 OR (n.node * 13 + a.n_nationkey * 5) % 9 <> 0))
        OR (n.rank = 1 AND a.n_nationkey <> 0 AND (n.node + a.n_nationkey * 7) % 3 = 0)) t""",
    "pg_edge": """SELECT DISTINCT n1, n2, CASE WHEN o1 = '>' AND o2 = '>' THEN 2 WHEN o1 = '>' THEN 3 WHEN o2 = '>' THEN 4 ELSE 5 END AS mark
FROM (SELECT LAG(node) OVER (PARTITION BY asm, chr ORDER BY idx) AS n1, LAG(ori) OVER (PARTITION BY asm, chr ORDER BY idx) AS o1, node AS n2, ori AS o2 FROM pg_step) t
WHERE n1 IS NOT NULL""",
    "pg_visit": """SELECT CAST(c.c_nationkey AS BIGINT) AS asm, l.l_orderkey AS path_id, l.l_partkey + 1 AS node, CASE WHEN l.l_returnflag = 'R' THEN '<' ELSE '>' END AS ori,
  CAST(ROW_NUMBER() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey) AS BIGINT) - 1 AS idx
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey""",
    "pg_aln": """SELECT CAST(c.c_nationkey AS BIGINT) AS asm, l.l_orderkey AS qname, CAST(l.l_quantity AS BIGINT) AS mapq,
  a.node AS node1, a.len AS len1, b.node AS node2, b.len AS len2, a.len + COALESCE(b.len, 0) AS plen, l.l_suppkey % a.len AS pstart,
  a.len + COALESCE(b.len, 0) - CASE WHEN b.node IS NULL THEN 0 ELSE l.l_orderkey % b.len END AS pend
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN pg_node a ON a.node = l.l_partkey + 1 LEFT JOIN pg_node b ON b.node = l.l_partkey + 2 AND l.l_linenumber % 3 <> 0""",
    "pg_feature": """SELECT event_id AS fid, CONCAT('Brand#', CAST(user_id % 25 + 1 AS VARCHAR)) AS chr, 1 + (event_id * 37) % 1000 AS start_pos,
  1 + (event_id * 37) % 1000 + CAST(FLOOR(value) AS BIGINT) AS end_pos, event_type AS track, CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM events""",
    "pg_seq": """SELECT node, SUBSTRING(CONCAT(h, h), 1, CAST(len AS INT)) AS seq
FROM (SELECT node, len, TRANSLATE(MD5(CAST(node AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS h FROM pg_node) t""",
    # the window of the catalogue and what hangs on it
    "win": """SELECT node, start_pos, end_pos, len, CASE WHEN end_pos < 1 THEN '2' WHEN start_pos > 1000 THEN '1' ELSE '0' END AS cls FROM pg_node
WHERE rank = 0 AND chr = 'Brand#1' AND end_pos >= 1 AND start_pos <= 1001000""",
    "inside": "SELECT *, ROW_NUMBER() OVER (ORDER BY start_pos) - 1 AS i, CAST(SUM(len) OVER (ORDER BY start_pos) AS BIGINT) - len AS before FROM win WHERE cls = '0'",
    "ext": """SELECT n, l, st, CASE WHEN 800 - 80 * (n - 1) > 0 AND n > 0 THEN LEAST(2000, 80 * l // (800 - 80 * (n - 1)) + 1) ELSE 2000 END AS wcut
FROM (SELECT COUNT(*) AS n, CAST(COALESCE(SUM(len), 0) AS BIGINT) AS l, MIN(start_pos) AS st FROM inside) t""",
    "sca": "SELECT *, CAST(800 AS DOUBLE) / (l + (n - 1) * wcut) AS scale FROM ext",
    "adj": "SELECT n1 AS a, n2 AS b FROM pg_edge UNION SELECT n2, n1 FROM pg_edge",
    "bfs": """SELECT a.b AS node, 0 AS depth FROM adj a JOIN inside w ON a.a = w.node WHERE a.b NOT IN (SELECT node FROM win)
UNION SELECT a.b, f.depth + 1 FROM bfs f JOIN adj a ON a.a = f.node WHERE f.depth <= 10 AND a.b NOT IN (SELECT node FROM win)""",
    "found": "SELECT node, MIN(depth) AS depth FROM bfs GROUP BY node",
    "shown": "SELECT node, TRUE AS op FROM inside UNION ALL SELECT node, depth <= 10 FROM found",
    "sub": "SELECT DISTINCT e.n1, e.n2, e.mark FROM pg_edge e JOIN shown a ON e.n1 = a.node JOIN shown b ON e.n2 = b.node WHERE a.op OR b.op",
    "skip": """SELECT e.n1, e.n2, e.mark, CASE WHEN b.start_pos > a.start_pos THEN b.start_pos - a.end_pos - 1 ELSE a.start_pos - b.end_pos - 1 END AS skipped_len
FROM pg_edge e JOIN inside a ON e.n1 = a.node JOIN inside b ON e.n2 = b.node
WHERE ((b.start_pos > a.start_pos AND e.mark = 2) OR (b.start_pos <= a.start_pos AND e.mark = 5))
  AND CASE WHEN b.start_pos > a.start_pos THEN b.start_pos - a.end_pos - 1 ELSE a.start_pos - b.end_pos - 1 END < 60""",
    "pair": """SELECT * FROM (SELECT asm, chr, LAG(node) OVER (PARTITION BY asm, chr ORDER BY idx) AS a, LAG(ori) OVER (PARTITION BY asm, chr ORDER BY idx) AS oa, node AS b, ori AS ob FROM pg_step) t WHERE a IS NOT NULL""",
    "mpair": """SELECT asm, a, b, CASE WHEN oa = '>' AND ob = '>' THEN 2 WHEN oa = '>' THEN 3 WHEN ob = '>' THEN 4 ELSE 5 END AS m FROM pair
WHERE a IN (SELECT node FROM shown) AND b IN (SELECT node FROM shown)""",
    "chunkn": "SELECT *, (ROW_NUMBER() OVER (PARTITION BY chr ORDER BY start_pos, node) - 1) // 50 AS chunk FROM pg_node WHERE rank = 0",
    "chunk": "SELECT chr, chunk, MIN(start_pos) AS start_pos, MAX(end_pos) AS end_pos, COUNT(*) AS n FROM chunkn GROUP BY chr, chunk",
    "cwall": """SELECT c.chr, c.chunk, n.node FROM chunk c JOIN chunkn n ON n.chr = c.chr AND n.end_pos >= c.start_pos - 1000000 AND n.start_pos <= c.end_pos + 1000000""",
    "cbfs": """SELECT k.chr, k.chunk, a.b AS node, 0 AS depth FROM chunkn k JOIN adj a ON a.a = k.node WHERE NOT EXISTS (SELECT 1 FROM cwall w WHERE w.chr = k.chr AND w.chunk = k.chunk AND w.node = a.b)
UNION SELECT f.chr, f.chunk, a.b, f.depth + 1 FROM cbfs f JOIN adj a ON a.a = f.node WHERE f.depth <= 5 AND NOT EXISTS (SELECT 1 FROM cwall w WHERE w.chr = f.chr AND w.chunk = f.chunk AND w.node = a.b)""",
    "ends": """SELECT f.fid, f.strand, a.node AS node1, f.start_pos - a.start_pos AS off1, b.node AS node2, f.end_pos - b.start_pos AS off2 FROM pg_feature f
LEFT JOIN (SELECT * FROM pg_node WHERE rank = 0) a ON a.chr = f.chr AND f.start_pos BETWEEN a.start_pos AND a.end_pos
LEFT JOIN (SELECT * FROM pg_node WHERE rank = 0) b ON b.chr = f.chr AND f.end_pos BETWEEN b.start_pos AND b.end_pos""",
    "seen": """SELECT e.* FROM ends e LEFT JOIN win a ON a.node = e.node1 LEFT JOIN win b ON b.node = e.node2
WHERE a.cls = '0' OR b.cls = '0' OR (a.cls = '2' AND b.cls = '1')""",
    "xs": "SELECT node, CAST(50 AS DOUBLE) + scale * (before + i * wcut) AS x1, CAST(50 AS DOUBLE) + scale * (before + i * wcut) + scale * len AS x2 FROM inside, sca",
    "clus": """SELECT *, SUM(CASE WHEN m IS NULL OR start_pos > m THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY start_pos, end_pos, fid) AS cluster FROM (
SELECT *, MAX(end_pos) OVER (PARTITION BY chr ORDER BY start_pos, end_pos, fid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM pg_feature) t""",
    "bub": """SELECT e.n1 AS seed_ref, e.n2 AS node, 0 AS depth FROM pg_edge e JOIN inside w ON e.n1 = w.node WHERE e.n2 NOT IN (SELECT node FROM win)
UNION SELECT f.seed_ref, a.b, f.depth + 1 FROM bub f JOIN adj a ON a.a = f.node WHERE f.depth <= 10 AND a.b NOT IN (SELECT node FROM win)""",
    "near": """SELECT a.b AS node, a.a AS ref_node, 1 AS dist FROM adj a JOIN pg_node r ON a.a = r.node AND r.rank = 0 JOIN pg_node v ON a.b = v.node AND v.rank = 1
UNION SELECT a.b, f.ref_node, f.dist + 1 FROM near f JOIN adj a ON a.a = f.node JOIN pg_node v ON a.b = v.node AND v.rank = 1 WHERE f.dist < 20""",
    "flip": "SELECT node FROM (SELECT node, arg_min(ori, asm) AS ori FROM pg_step GROUP BY node) t WHERE ori = '<'",
    "ids": """SELECT node, 2 * i + 1 AS s_id, 2 * i + 2 AS e_id, TRUE AS is_ref, i FROM inside
UNION ALL SELECT node, tot + upto - k AS s_id, tot + upto AS e_id, FALSE, NULL FROM (
SELECT f.node, GREATEST((n.len + wcut - 1) // wcut, 1) AS k, SUM(GREATEST((n.len + wcut - 1) // wcut, 1) + 1) OVER (ORDER BY f.node) AS upto, (SELECT COUNT(*) * 2 FROM inside) AS tot
FROM found f JOIN pg_node n USING (node), ext) t""",
    # edges along the order paths, which change chromosomes
    "xedge": """SELECT DISTINCT n1, n2, CASE WHEN o1 = '>' AND o2 = '>' THEN 2 WHEN o1 = '>' THEN 3 WHEN o2 = '>' THEN 4 ELSE 5 END AS mark
FROM (SELECT LAG(node) OVER (PARTITION BY path_id ORDER BY idx) AS n1, LAG(ori) OVER (PARTITION BY path_id ORDER BY idx) AS o1, node AS n2, ori AS o2 FROM pg_visit WHERE asm = 1) t WHERE n1 IS NOT NULL""",
    "xadj": "SELECT n1 AS a, n2 AS b FROM xedge UNION SELECT n2, n1 FROM xedge",
    "xbfs": """SELECT a.b AS node, 0 AS depth FROM xadj a JOIN inside w ON a.a = w.node WHERE a.b NOT IN (SELECT node FROM win)
UNION SELECT a.b, f.depth + 1 FROM xbfs f JOIN xadj a ON a.a = f.node WHERE f.depth <= 3 AND a.b NOT IN (SELECT node FROM win)""",
    "refs": "SELECT node FROM pg_node WHERE rank = 0",
    "freeedge": "SELECT * FROM xedge WHERE n1 NOT IN (SELECT node FROM refs) AND n2 NOT IN (SELECT node FROM refs)",
    "nocross_edge": """SELECT * FROM xedge WHERE (n1 NOT IN (SELECT node FROM refs) AND n2 NOT IN (SELECT node FROM refs)) OR n1 IN (SELECT node FROM win) OR n2 IN (SELECT node FROM win)""",
    "nadj": "SELECT n1 AS a, n2 AS b FROM nocross_edge UNION SELECT n2, n1 FROM nocross_edge",
    "nbfs": """SELECT a.b AS node, 0 AS depth FROM nadj a JOIN inside w ON a.a = w.node WHERE a.b NOT IN (SELECT node FROM win)
UNION SELECT a.b, f.depth + 1 FROM nbfs f JOIN nadj a ON a.a = f.node WHERE f.depth <= 3 AND a.b NOT IN (SELECT node FROM win)""",
    "fadj": "SELECT n1 AS a, n2 AS b FROM freeedge UNION SELECT n2, n1 FROM freeedge",
    "fbfs": """SELECT k.chr, k.chunk, a.b AS node, 0 AS depth FROM chunkn k JOIN xadj a ON a.a = k.node WHERE NOT EXISTS (SELECT 1 FROM cwall w WHERE w.chr = k.chr AND w.chunk = k.chunk AND w.node = a.b)
UNION SELECT f.chr, f.chunk, a.b, f.depth + 1 FROM fbfs f JOIN fadj a ON a.a = f.node WHERE f.depth <= 1 AND NOT EXISTS (SELECT 1 FROM cwall w WHERE w.chr = f.chr AND w.chunk = f.chunk AND w.node = a.b)""",
    # alignments with a made-up CIGAR, cut at the nodes
    "al": """SELECT DISTINCT CONCAT_WS(':', CAST(qname AS VARCHAR), CAST(node1 AS VARCHAR), CAST(mapq AS VARCHAR), CAST(pstart AS VARCHAR), CAST(pend AS VARCHAR)) AS path,
  pstart, node1, len1, node2, len2, pend - pstart AS span, GREATEST(pend - pstart - 1, 1) AS m FROM pg_aln WHERE node2 IS NOT NULL""",
    "cop": """SELECT path, 0 AS k, 2 AS n, 'S' AS op, 0 AS rn, 2 AS qn, pstart AS r0, 0 AS q0 FROM al
UNION ALL SELECT path, 1, m, 'M', m, m, pstart, 2 FROM al UNION ALL SELECT path, 2, 3, 'I', 0, 3, pstart + m, 2 + m FROM al
UNION ALL SELECT path, 3, 1, 'D', 1, 0, pstart + m, 5 + m FROM al WHERE span > 1""",
    "cnode": "SELECT path, 0 AS idx, node1 AS node, 0 AS s0, len1 AS s1, FALSE AS final FROM al UNION ALL SELECT path, 1, node2, len1, len1 + len2, TRUE FROM al",
    "csplit": """SELECT path, idx, node, STRING_AGG(CONCAT(CAST(CASE WHEN rn > 0 THEN LEAST(s1, r0 + rn) - GREATEST(s0, r0) ELSE n END AS VARCHAR), op), '' ORDER BY k) AS cigar,
  CAST(MIN(q0 + CASE WHEN qn > 0 THEN GREATEST(s0 - r0, 0) ELSE 0 END) AS BIGINT) AS qpos
FROM cop JOIN cnode USING (path) WHERE CASE WHEN rn > 0 THEN r0 < s1 AND r0 + rn > s0 ELSE r0 >= s0 AND (r0 < s1 OR final) END GROUP BY path, idx, node""",
    "lstep": """SELECT *, CONCAT(CAST(asm AS VARCHAR), ':', chr) AS path, SUBSTR('MDN=X', CAST(idx % 5 + 1 AS INT), 1) AS rop, SUBSTR('ISHP', CAST(idx % 4 + 1 AS INT), 1) AS qop, idx % 3 + 1 AS qlen,
  LEAST(FIRST_VALUE(len) OVER w - 1, LAST_VALUE(len) OVER w) AS pstart, MAX(idx) OVER w AS top FROM pg_step WINDOW w AS (PARTITION BY asm, chr ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "lq": """SELECT *, CASE WHEN rop IN ('M', '=', 'X') THEN len ELSE 0 END AS rq, CASE WHEN qop IN ('I', 'S') THEN qlen ELSE 0 END AS qq FROM lstep WHERE idx < top""",
    "lsum": "SELECT *, 2 + SUM(rq + qq) OVER (PARTITION BY path ORDER BY idx) - rq - qq AS q0 FROM lq",
    "lop": """SELECT DISTINCT path, 0 AS k, 2 AS n, 'S' AS op, 0 AS rn, 2 AS qn, pstart AS r0, 0 AS q0 FROM lstep
UNION ALL SELECT path, 2 * idx + 1, len, rop, len, rq, pstart + qpos - 1, q0 FROM lsum UNION ALL SELECT path, 2 * idx + 2, qlen, qop, 0, qq, pstart + qpos - 1 + len, q0 + rq FROM lsum""",
    "lnode": "SELECT path, idx, node, qpos - 1 AS s0, qpos - 1 + len AS s1, idx = top AS final FROM lstep",
    "lsplit": """SELECT path, idx, node, STRING_AGG(CONCAT(CAST(CASE WHEN rn > 0 THEN LEAST(s1, r0 + rn) - GREATEST(s0, r0) ELSE n END AS VARCHAR), op), '' ORDER BY k) AS cigar,
  CAST(MIN(q0 + CASE WHEN qn > 0 THEN GREATEST(s0 - r0, 0) ELSE 0 END) AS BIGINT) AS qpos
FROM lop JOIN lnode USING (path) WHERE CASE WHEN rn > 0 THEN r0 < s1 AND r0 + rn > s0 ELSE r0 >= s0 AND (r0 < s1 OR final) END GROUP BY path, idx, node""",
    # first fit: one row a step, with the end of each layer so far
    "lo": "SELECT *, ROW_NUMBER() OVER (PARTITION BY chr ORDER BY start_pos, end_pos, fid) AS rn FROM pg_feature",
    "lay": """SELECT DISTINCT chr, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS e, CAST(NULL AS BIGINT) AS fid, CAST(NULL AS BIGINT) AS layer FROM pg_feature
UNION ALL SELECT chr, rn, CASE WHEN k <= len(e) THEN list_concat(list_concat(e[:k - 1], [end_pos]), e[k + 1:]) ELSE list_append(e, end_pos) END, fid, k FROM (
SELECT o.chr, o.rn, o.fid, o.end_pos, y.e, COALESCE(NULLIF(list_position(list_transform(y.e, lambda x: x < o.start_pos), TRUE), 0), len(y.e) + 1) AS k FROM lay y JOIN lo o ON o.chr = y.chr AND o.rn = y.rn + 1) t""",
    "tlo": "SELECT *, ROW_NUMBER() OVER (PARTITION BY track, chr ORDER BY start_pos, end_pos, fid) AS rn FROM pg_feature",
    "tlay": """SELECT DISTINCT track, chr, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS e, CAST(NULL AS BIGINT) AS layer, CAST(NULL AS BIGINT) AS fid FROM pg_feature
UNION ALL SELECT track, chr, rn, CASE WHEN k <= len(e) THEN list_concat(list_concat(e[:k - 1], [end_pos]), e[k + 1:]) ELSE list_append(e, end_pos) END, k, fid FROM (
SELECT o.track, o.chr, o.rn, o.fid, o.end_pos, y.e, COALESCE(NULLIF(list_position(list_transform(y.e, lambda x: x < o.start_pos), TRUE), 0), len(y.e) + 1) AS k FROM tlay y JOIN tlo o ON o.track = y.track AND o.chr = y.chr AND o.rn = y.rn + 1) t""",
    # bubbles that are hidden, and the view without them
    "bubd": "SELECT seed_ref, node, MIN(depth) AS depth FROM bub GROUP BY seed_ref, node",
    "bsmall": """SELECT seed_ref FROM (SELECT seed_ref, d.depth, MAX(n.len) AS m FROM bubd d JOIN pg_node n USING (node) GROUP BY 1, 2) t GROUP BY seed_ref HAVING SUM(m) < 60""",
    "bf": "SELECT * FROM bubd WHERE seed_ref IN (SELECT seed_ref FROM bsmall)",
    "bside": "SELECT f.seed_ref, MIN(e.mark) AS least, MAX(e.mark) AS most FROM bf f JOIN pg_edge e ON e.n1 = f.seed_ref AND e.n2 = f.node WHERE f.depth = 0 GROUP BY 1",
    "bland": """SELECT f.seed_ref, e.n2 AS land, e.mark, 'o' AS way FROM bf f JOIN pg_edge e ON e.n1 = f.node WHERE f.depth <= 10
UNION ALL SELECT f.seed_ref, e.n1, e.mark, 'i' FROM bf f JOIN pg_edge e ON e.n2 = f.node WHERE f.depth <= 10""",
    "barm": """SELECT b.seed_ref, p.start_pos AS ps, p.end_pos AS pe, s.least, s.most,
  MIN({'q': q.i, 'qs': q.start_pos, 'qe': q.end_pos, 'mark': b.mark, 'way': b.way}) FILTER (q.i < p.i) AS l,
  MAX({'q': q.i, 'qs': q.start_pos, 'qe': q.end_pos, 'mark': b.mark, 'way': b.way}) FILTER (q.i > p.i) AS r
FROM bland b JOIN inside q ON q.node = b.land JOIN inside p ON p.node = b.seed_ref JOIN bside s ON s.seed_ref = b.seed_ref GROUP BY 1, 2, 3, 4, 5""",
    "blen": """SELECT *, ps - CASE WHEN CASE WHEN l.way = 'o' THEN l.mark IN (2, 4) ELSE l.mark IN (4, 5) END THEN l.qs ELSE l.qe + 1 END AS ll,
  CASE WHEN CASE WHEN r.way = 'o' THEN r.mark IN (3, 5) ELSE r.mark IN (2, 3) END THEN r.qe ELSE r.qs - 1 END - pe AS rl FROM barm""",
    "hid": """SELECT DISTINCT node FROM bf WHERE seed_ref IN (SELECT seed_ref FROM blen WHERE (l IS NOT NULL OR r IS NOT NULL)
  AND (l IS NULL OR (most >= 4 AND ll < 60)) AND (r IS NULL OR (least < 4 AND rl < 60)))""",
    "bothends": "SELECT n1 AS node, n2 AS other, n1, n2, mark FROM pg_edge UNION ALL SELECT n2, n1, n1, n2, mark FROM pg_edge",
    "rlink": """SELECT w.node, w.start_pos, COALESCE(p.alive, FALSE) OR w.i = 0 OR w.i = (SELECT MAX(i) FROM inside) AS linked, COALESCE(p.variant, FALSE) AS variant FROM inside w LEFT JOIN (
  SELECT t.node, BOOL_OR((w2.cls IS NULL AND h.node IS NULL) OR (w2.cls = '0' AND s.n1 IS NULL)) AS alive, BOOL_OR(w2.cls IS NULL) AS variant FROM bothends t LEFT JOIN win w2 ON w2.node = t.other
  LEFT JOIN hid h ON h.node = t.other LEFT JOIN skip s ON s.n1 = t.n1 AND s.n2 = t.n2 AND s.mark = t.mark WHERE t.node IN (SELECT node FROM inside) GROUP BY t.node) p ON p.node = w.node""",
    "rkeep": "SELECT node FROM (SELECT node, linked OR (COALESCE(LAG(linked) OVER (ORDER BY start_pos), FALSE) AND NOT variant) AS kept FROM rlink) t WHERE kept",
    "vnode": "SELECT node FROM found WHERE node NOT IN (SELECT node FROM hid)",
    "vboth": "SELECT node FROM rkeep UNION ALL SELECT node FROM vnode",
    # jumps along some edges, and the import with assembly 1 as the reference
    "jmp": """SELECT n1, CASE WHEN mark IN (2, 3) THEN '+' ELSE '-' END AS sign1, n2, CASE WHEN mark IN (2, 4) THEN '+' ELSE '-' END AS sign2, CASE WHEN n1 % 3 = 0 THEN 100 ELSE n2 % 300 + 1 END AS distance, mark
FROM pg_edge WHERE (n1 + n2) % 7 = 0""",
    "along": """SELECT asm, a, b, CASE WHEN oa = '>' AND ob = '>' THEN 2 WHEN oa = '>' THEN 3 WHEN ob = '>' THEN 4 ELSE 5 END AS m FROM pair
UNION SELECT asm, b, a, CASE WHEN oa = '>' AND ob = '>' THEN 5 WHEN oa = '>' THEN 3 WHEN ob = '>' THEN 4 ELSE 2 END FROM pair""",
    "jid": "SELECT *, (SELECT MAX(node) FROM pg_node) + ROW_NUMBER() OVER (ORDER BY n1, n2, sign1, sign2, distance) AS id FROM jmp",
    "ijid": """SELECT *, (SELECT MAX(node) FROM pg_node) + ROW_NUMBER() OVER (ORDER BY n1, n2, sign1, sign2, distance) AS id FROM jmp j
WHERE NOT EXISTS (SELECT 1 FROM along x WHERE x.asm = 1 AND x.a = j.n1 AND x.b = j.n2 AND x.m = j.mark)""",
    "iflip": "SELECT node FROM pg_step WHERE asm = 1 AND ori = '<'",
    "iedge": """SELECT n1, n2, mark FROM pg_edge UNION ALL SELECT n1, id, CASE WHEN sign1 = '+' THEN 2 ELSE 4 END FROM ijid UNION ALL SELECT id, n2, CASE WHEN sign2 = '+' THEN 2 ELSE 3 END FROM ijid""",
    # gene models in one file
    "mline": """SELECT fid, CASE WHEN fid % 8 = 0 THEN 'gene' WHEN fid % 2 = 0 THEN 'exon' ELSE 'CDS' END AS type, CASE WHEN fid % 8 = 0 THEN 1 ELSE start_pos END AS start_pos, CASE WHEN fid % 8 = 0 THEN 900 ELSE end_pos END AS end_pos FROM pg_feature""",
    "model": """SELECT CONCAT('g', CAST(g AS VARCHAR)) AS gene, CONCAT('t', CAST(fid // 8 * 2 + fid // 2 % 2 AS VARCHAR)) AS parent, type, start_pos, end_pos, CONCAT('p', CAST(fid AS VARCHAR)) AS id, fid FROM (
SELECT *, LAST_VALUE(CASE WHEN type = 'gene' THEN fid END IGNORE NULLS) OVER (ORDER BY fid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM mline) t
WHERE type <> 'gene' AND g IS NOT NULL AND start_pos >= 1 AND end_pos <= 900""",
    "lit": """SELECT DISTINCT e.n1, e.n2, e.mark, CAST(p.a = e.n1 AND p.b = e.n2 AND p.m = e.mark AS INT) AS dir FROM sub e JOIN mpair p ON p.asm = 3
 AND ((p.a = e.n1 AND p.b = e.n2 AND p.m = e.mark) OR (p.a = e.n2 AND p.b = e.n1 AND p.m = CASE e.mark WHEN 2 THEN 5 WHEN 5 THEN 2 ELSE e.mark END))""",
    "drawn": """SELECT s_id::BIGINT AS source, e_id::BIGINT AS target, 0 AS type FROM ids WHERE is_ref
UNION ALL SELECT source::BIGINT, source::BIGINT + 1, 0 FROM (SELECT UNNEST(generate_series(s_id::BIGINT, e_id::BIGINT - 1)) AS source FROM ids WHERE NOT is_ref) t
UNION ALL SELECT s_id::BIGINT - 1, s_id::BIGINT, 1 FROM ids WHERE is_ref AND i > 0
UNION ALL SELECT (CASE WHEN e.mark IN (2, 3) THEN a.e_id ELSE a.s_id END)::BIGINT, (CASE WHEN e.mark IN (2, 4) THEN b.s_id ELSE b.e_id END)::BIGINT, e.mark
FROM sub e JOIN ids a ON a.node = e.n1 JOIN ids b ON b.node = e.n2 WHERE NOT (e.mark = 2 AND a.i IS NOT NULL AND b.i IS NOT NULL AND b.i = a.i + 1)""",
    "fpix": """SELECT s.fid, ROUND(COALESCE(a.x1 + s.off1 * scale, 50.0), 4) AS x1, ROUND(COALESCE(b.x1 + s.off2 * scale, 850.0), 4) AS x2,
CASE WHEN b.x1 IS NULL AND s.strand = '+' THEN '1' WHEN a.x1 IS NULL AND s.strand = '-' THEN '2' ELSE '0' END AS margin
FROM seen s LEFT JOIN xs a ON a.node = s.node1 LEFT JOIN xs b ON b.node = s.node2, sca""",
    "mends": """SELECT m.fid, f.strand, a.node AS node1, m.start_pos - a.start_pos AS off1, b.node AS node2, m.end_pos - b.start_pos AS off2
FROM (SELECT fid, start_pos, end_pos FROM model UNION ALL SELECT fid, start_pos, end_pos FROM mline WHERE type = 'gene') m JOIN pg_feature f USING (fid)
LEFT JOIN (SELECT * FROM pg_node WHERE rank = 0 AND chr = 'Brand#1') a ON m.start_pos BETWEEN a.start_pos AND a.end_pos
LEFT JOIN (SELECT * FROM pg_node WHERE rank = 0 AND chr = 'Brand#1') b ON m.end_pos BETWEEN b.start_pos AND b.end_pos""",
    "mpix": """SELECT s.fid, CAST(ROUND(ROUND(COALESCE(a.x1 + s.off1 * scale, 50.0), 4) * 10000) AS BIGINT) AS x1, CAST(ROUND(ROUND(COALESCE(b.x1 + s.off2 * scale, 850.0), 4) * 10000) AS BIGINT) AS x2
FROM (SELECT e.* FROM mends e LEFT JOIN win a ON a.node = e.node1 LEFT JOIN win b ON b.node = e.node2 WHERE a.cls = '0' OR b.cls = '0' OR (a.cls = '2' AND b.cls = '1')) s
LEFT JOIN xs a ON a.node = s.node1 LEFT JOIN xs b ON b.node = s.node2, sca""",
    "mexon": "SELECT m.*, x1, x2 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY parent ORDER BY start_pos, end_pos, fid) AS num FROM model WHERE type = 'exon') m JOIN mpix USING (fid)",
    "mcds": "SELECT m.*, x1, x2 FROM model m JOIN mpix USING (fid) WHERE type = 'CDS'",
    "runs": """SELECT asm, chr, CAST(run AS BIGINT) AS run, MIN(qpos) AS q_start, MAX(qpos) AS q_last, STRING_AGG(CONCAT(ori, CAST(node AS VARCHAR)), '' ORDER BY idx) AS path FROM (
SELECT *, SUM(nw) OVER (PARTITION BY asm, chr ORDER BY idx) AS run FROM (
SELECT *, CASE WHEN ins AND NOT COALESCE(LAG(ins) OVER (PARTITION BY asm, chr ORDER BY idx), FALSE) THEN 1 ELSE 0 END AS nw FROM (
SELECT *, node IN (SELECT node FROM shown) AS ins FROM pg_step WHERE chr = 'Brand#1') a) b) c WHERE ins GROUP BY asm, chr, run""",
    "tick": """SELECT ROUND(px, 4) AS x, CAST(start_pos + FLOOR((px - x1) / scale) AS BIGINT) AS pos FROM (
SELECT x.*, w.start_pos, UNNEST(generate_series(CAST(CEIL((x.x1 - 50) / 80) AS BIGINT), CAST(FLOOR((x.x2 - 50) / 80) AS BIGINT))) * 80 + CAST(50 AS DOUBLE) AS px FROM xs x JOIN win w USING (node)) t, sca""",
    "sown": "SELECT node, CASE WHEN node IN (SELECT node FROM flip) THEN TRANSLATE(REVERSE(seq), 'ACGTacgt', 'TGCAtgca') ELSE seq END AS seq FROM pg_seq",
    "sshad": """SELECT node, (SELECT MAX(node) FROM pg_node) + ROW_NUMBER() OVER (ORDER BY path_id, idx) AS id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY node ORDER BY path_id, idx) AS rn FROM pg_visit WHERE asm = 1) t WHERE rn > 1""",
    "ihit": "SELECT chunk FROM chunkn WHERE chr = 'Brand#1' AND end_pos >= 1 AND start_pos <= 200",
    "igot": "SELECT chr, chunk, node FROM cbfs UNION SELECT chr, chunk, node FROM chunkn",
    "oplace": "SELECT asm, chr, node, qpos AS start_pos, qpos + len - 1 AS end_pos FROM pg_step",
    "ogene": """SELECT DISTINCT p.asm, p.node, f.fid FROM pg_feature f JOIN oplace p ON p.asm = f.fid % 25 AND p.chr = f.chr AND f.start_pos <= p.end_pos AND f.end_pos >= p.start_pos""",
}

QUERIES = {
    "window_nodes": "SELECT node, start_pos, end_pos, cls FROM win",
    "window_extent": "SELECT n AS n_nodes, l AS real_len, st AS real_start, wcut, ROUND(scale, 6) AS scale FROM sca",
    "chrom_extents": "SELECT chr, MIN(start_pos) AS start_pos, MAX(end_pos) AS end_pos FROM pg_node WHERE rank = 0 GROUP BY chr",
    "chrom_list": "SELECT chr AS name, ROW_NUMBER() OVER (ORDER BY chr) - 1 AS ordinal FROM (SELECT DISTINCT chr FROM pg_step) t",
    "assembly_list": "SELECT name, ROW_NUMBER() OVER (ORDER BY a, name) - 1 AS ordinal FROM (SELECT n.n_name AS name, MIN(s.asm) AS a FROM pg_step s JOIN nation n ON n.n_nationkey = s.asm GROUP BY 1) t",
    "edge_marks": "SELECT n1, n2, mark FROM pg_edge",
    "edge_canonical": """SELECT DISTINCT CASE WHEN fwd THEN n1 ELSE n2 END AS n1, CASE WHEN fwd THEN n2 ELSE n1 END AS n2, CASE WHEN fwd THEN mark ELSE rm END AS mark FROM (
SELECT *, n1 < n2 OR (n1 = n2 AND mark <= rm) AS fwd FROM (SELECT *, CASE mark WHEN 2 THEN 5 WHEN 5 THEN 2 ELSE mark END AS rm FROM pg_edge) t) u""",
    "edge_flip": """SELECT e.n1, e.n2, CASE WHEN (e.mark IN (2, 3)) <> (a.node IS NOT NULL) THEN '+' ELSE '-' END AS sign1, CASE WHEN (e.mark IN (2, 4)) <> (b.node IS NOT NULL) THEN '+' ELSE '-' END AS sign2
FROM pg_edge e LEFT JOIN flip a ON e.n1 = a.node LEFT JOIN flip b ON e.n2 = b.node""",
    "edges_nonref": "SELECT * FROM pg_edge WHERE n1 NOT IN (SELECT node FROM pg_node WHERE rank = 0) AND n2 NOT IN (SELECT node FROM pg_node WHERE rank = 0)",
    "edges_chr": "SELECT * FROM pg_edge WHERE n1 IN (SELECT node FROM pg_node WHERE rank = 0 AND chr = 'Brand#1') OR n2 IN (SELECT node FROM pg_node WHERE rank = 0 AND chr = 'Brand#1')",
    "nodes_unvisited": "SELECT node FROM pg_node WHERE node NOT IN (SELECT node FROM pg_step WHERE asm IN (1, 2))",
    "step_positions": "SELECT asm, chr, idx, node, qpos FROM pg_step",
    "path_strings": "SELECT asm, chr, STRING_AGG(CONCAT(ori, CAST(node AS VARCHAR)), '' ORDER BY idx) AS path FROM pg_step GROUP BY asm, chr",
    "path_tokens": "SELECT asm, chr, idx, ori, node FROM pg_step",
    "first_visit": "SELECT node, asm, path_id, idx FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY node ORDER BY asm, path_id, idx) AS rn FROM pg_visit) t WHERE rn = 1",
    "shadow_nodes": """SELECT path_id, idx, node, (SELECT MAX(node) FROM pg_node) + ROW_NUMBER() OVER (ORDER BY path_id, idx) AS new_id FROM (
SELECT *, ROW_NUMBER() OVER (PARTITION BY node ORDER BY path_id, idx) AS rn FROM pg_visit WHERE asm = 1) t WHERE rn > 1""",
    "copy_number": "SELECT asm, node, LEAST(COUNT(*), 65535) AS cov FROM pg_visit GROUP BY asm, node",
    "frac_coverage": """SELECT asm, node, CAST((200 * CAST(SUM(bases) AS BIGINT) + MAX(len)) // (2 * MAX(len)) AS DOUBLE) / 100 AS cov FROM (
SELECT asm, node1 AS node, len1 AS len, CASE WHEN node2 IS NULL THEN pend - pstart ELSE len1 - pstart END AS bases FROM pg_aln WHERE mapq > 5
UNION ALL SELECT asm, node2, len2, len2 + pend - plen FROM pg_aln WHERE mapq > 5 AND node2 IS NOT NULL) t GROUP BY asm, node""",
    "coverage_class": """SELECT node, SUM(CASE WHEN c = 1 THEN 1 ELSE 0 END)::BIGINT AS n_one, SUM(CASE WHEN c > 1 THEN 1 ELSE 0 END)::BIGINT AS n_multi, COUNT(*) * 2 >= (SELECT COUNT(*) FROM nation) AS is_dense
FROM (SELECT asm, node, COUNT(*) AS c FROM pg_visit GROUP BY asm, node) t GROUP BY node""",
    "node_coverage": "SELECT CAST(a.n_nationkey AS BIGINT) AS asm, COALESCE(c, 0) AS cov FROM nation a LEFT JOIN (SELECT asm, COUNT(*) AS c FROM pg_visit WHERE node = 7 GROUP BY asm) v ON v.asm = a.n_nationkey",
    "asm_coverage": "SELECT n.node, COALESCE(c, 0) AS cov FROM pg_node n LEFT JOIN (SELECT node, COUNT(*) AS c FROM pg_visit WHERE asm = 3 GROUP BY node) v ON v.node = n.node",
    "node_lookup": "SELECT node, chr, start_pos, end_pos FROM pg_node WHERE node = 6",
    "chunks": "SELECT chr, chunk, start_pos, end_pos, n FROM chunk",
    "bfs_window": "SELECT node, depth FROM found",
    "subgraph_edges": "SELECT n1, n2, mark FROM sub",
    "bfs_chunks": "SELECT DISTINCT chr, chunk, node FROM cbfs",
    "bfs_nocross": "SELECT node, MIN(depth) AS depth FROM nbfs GROUP BY node",
    "skip_edges": "SELECT * FROM skip",
    "bubble_size": """SELECT seed_ref, CAST(SUM(m) AS BIGINT) AS size FROM (SELECT d.seed_ref, d.depth, MAX(n.len) AS m FROM (SELECT seed_ref, node, MIN(depth) AS depth FROM bub GROUP BY 1, 2) d JOIN pg_node n USING (node) GROUP BY 1, 2) t GROUP BY seed_ref""",
    "ref_simplify": """SELECT node, linked OR (COALESCE(LAG(linked) OVER (ORDER BY start_pos), FALSE) AND NOT variant) AS kept FROM (
SELECT w.node, w.start_pos, COALESCE(p.alive, FALSE) OR w.i = 0 OR w.i = (SELECT MAX(i) FROM inside) AS linked, COALESCE(p.variant, FALSE) AS variant FROM inside w LEFT JOIN (
SELECT t.node, BOOL_OR(w2.cls IS NULL OR (w2.cls = '0' AND s.n1 IS NULL)) AS alive, BOOL_OR(w2.cls IS NULL) AS variant FROM (
SELECT n1 AS node, n2 AS other, n1, n2, mark FROM pg_edge UNION ALL SELECT n2, n1, n1, n2, mark FROM pg_edge) t
LEFT JOIN win w2 ON w2.node = t.other LEFT JOIN skip s ON s.n1 = t.n1 AND s.n2 = t.n2 AND s.mark = t.mark WHERE t.node IN (SELECT node FROM inside) GROUP BY t.node) p ON p.node = w.node) u""",
    "highlight_edges": "SELECT n1, n2, mark, dir FROM lit",
    "highlight_runs": "SELECT asm, chr, run, q_start, q_last, path FROM runs",
    "highlight_chain": """SELECT DISTINCT asm, n1, n2 FROM (SELECT asm, LAG(node) OVER (PARTITION BY asm, chr ORDER BY idx) AS n1, node AS n2 FROM pg_step WHERE node IN (SELECT node FROM inside)) t WHERE n1 IS NOT NULL""",
    "highlight_multi": """SELECT e.n1, e.n2, e.mark, MIN(p.asm) AS asm FROM sub e JOIN mpair p ON p.asm IN (1, 2, 3)
 AND ((p.a = e.n1 AND p.b = e.n2 AND p.m = e.mark) OR (p.a = e.n2 AND p.b = e.n1 AND p.m = CASE e.mark WHEN 2 THEN 5 WHEN 5 THEN 2 ELSE e.mark END)) GROUP BY 1, 2, 3""",
    "feature_nodes": "SELECT fid, node1, off1, node2, off2 FROM ends",
    "feature_chunks": "SELECT f.fid, c.chunk FROM pg_feature f JOIN chunk c ON c.chr = f.chr AND f.start_pos <= c.end_pos AND f.end_pos >= c.start_pos",
    "feature_overlap": "SELECT n.node, f.fid FROM pg_feature f JOIN pg_node n ON n.rank = 0 AND n.chr = f.chr AND f.start_pos <= n.end_pos AND f.end_pos >= n.start_pos",
    "feature_semi": "SELECT DISTINCT f.fid FROM pg_feature f JOIN pg_node n ON n.rank = 0 AND n.chr = f.chr AND f.start_pos <= n.end_pos AND f.end_pos >= n.start_pos",
    "feature_visible": "SELECT fid FROM seen",
    "feature_pixels": "SELECT fid, x1, x2, margin FROM fpix",
    "islands": "SELECT chr, CAST(cluster AS BIGINT) AS cluster, MIN(start_pos) AS start_pos, MAX(end_pos) AS end_pos, COUNT(*) AS n FROM clus GROUP BY chr, cluster",
    "exon_rank": "SELECT fid, ROW_NUMBER() OVER (PARTITION BY track, chr ORDER BY start_pos, end_pos, fid) AS num FROM pg_feature",
    "node_x": "SELECT node, ROUND(x1, 4) AS x1, ROUND(x2, 4) AS x2 FROM xs",
    "variant_segments": """SELECT node, seg, CAST(CASE WHEN seg < k THEN wcut ELSE len - (k - 1) * wcut END AS BIGINT) AS len FROM (
SELECT t.*, UNNEST(generate_series(1, k)) AS seg FROM (SELECT f.node, n.len, wcut, GREATEST((n.len + wcut - 1) // wcut, 1) AS k FROM found f JOIN pg_node n USING (node), ext) t) u""",
    "draw_edges": "SELECT source, target, type FROM drawn",
    "path_locate": "SELECT s.asm, s.chr, MIN(n.start_pos) AS start_pos, MAX(n.end_pos) AS end_pos FROM pg_step s JOIN pg_node n ON n.node = s.node AND n.rank = 0 GROUP BY s.asm, s.chr, n.chr",
    "nearest_ref": "SELECT node, MIN(ref_node) AS ref_node, dist FROM (SELECT *, MIN(dist) OVER (PARTITION BY node) AS d FROM near) t WHERE dist = d GROUP BY node, dist",
    "path_to_reference": """SELECT e.asm, e.chr, e.piece, r.chr AS ref_chr, MIN(r.start_pos) AS start_pos, MAX(r.end_pos) AS end_pos, MIN(n.dist) AS dist FROM (
SELECT asm, chr, idx // 3 AS piece, UNNEST([arg_min(node, idx), arg_max(node, idx)]) AS node FROM pg_step WHERE rank = 1 GROUP BY 1, 2, 3) e
JOIN (SELECT node, MIN(ref_node) AS ref_node, dist FROM (SELECT *, MIN(dist) OVER (PARTITION BY node) AS d FROM near) t WHERE dist = d GROUP BY node, dist) n ON n.node = e.node
JOIN pg_node r ON r.node = n.ref_node GROUP BY 1, 2, 3, 4""",
    "node_seq": "SELECT n.node, COALESCE(s.seq, REPEAT('N', CAST(n.len AS INT))) AS seq FROM pg_node n LEFT JOIN (SELECT * FROM pg_seq WHERE node % 7 <> 0) s ON s.node = n.node",
    "revcomp": "SELECT node, CASE WHEN node IN (SELECT node FROM flip) THEN TRANSLATE(REVERSE(seq), 'ACGTacgt', 'TGCAtgca') ELSE seq END AS seq FROM pg_seq",
    "gfa_parse": "SELECT node, 'REF#0' AS asm, chr, COALESCE(start_pos, 1) AS start_pos, COALESCE(end_pos, len) AS end_pos, len, rank FROM pg_node",
    "gfa_links": "SELECT n1, n2, mark FROM pg_edge",
    "gfa_walks": "SELECT CONCAT(CAST(asm AS VARCHAR), '#0#', chr) AS name, idx, ori, node FROM pg_step",
    "gfa_paths": "SELECT CAST(asm AS VARCHAR) AS sample, chr, idx, ori, node, FALSE AS jump FROM pg_step",
    "gaf_parse": """SELECT CAST(qname AS VARCHAR) AS qname, CAST(0 AS BIGINT) AS qstart, '>s' || CAST(node1 AS VARCHAR) || COALESCE('>s' || CAST(node2 AS VARCHAR), '') AS path, plen, pstart, pend, mapq, CONCAT(CAST(pend - pstart AS VARCHAR), 'M') AS cigar FROM
pg_aln""",
    "bed_parse": """SELECT CAST(t.track_id AS BIGINT) AS track_id, 6 AS ncol, chr, start_pos, GREATEST(end_pos, start_pos) AS end_pos, CONCAT('f', CAST(fid AS VARCHAR)) AS name, CAST(fid % 1000 AS DOUBLE) AS score, strand
FROM pg_feature JOIN (SELECT track, ROW_NUMBER() OVER (ORDER BY track) AS track_id FROM (SELECT DISTINCT track FROM pg_feature) u) t USING (track)""",
    "bed_tracks": "SELECT CAST(ROW_NUMBER() OVER (ORDER BY track) AS BIGINT) AS track_id, track AS name, 'events' AS description FROM (SELECT DISTINCT track FROM pg_feature) t",
    "gff_parse": """SELECT chr, CASE WHEN fid % 4 = 0 THEN 'gene' ELSE 'pseudogene' END AS type, start_pos, end_pos, strand, CONCAT('g', CAST(fid AS VARCHAR)) AS id,
CASE WHEN fid % 3 = 0 THEN CONCAT('n', CAST(fid AS VARCHAR)) ELSE CONCAT('g', CAST(fid AS VARCHAR)) END AS name FROM pg_feature WHERE fid % 2 = 0""",
    "path_fragments": """SELECT DISTINCT asm, chr, chunk, idx, node, ori FROM (
SELECT s.asm, s.chr, c.chunk, s.idx, s.node, s.ori FROM pg_step s JOIN chunkn c ON c.node = s.node
UNION ALL SELECT asm, chr, p, idx, node, ori FROM (SELECT s.*, c.chunk, LAG(c.chunk) OVER (PARTITION BY s.asm, s.chr ORDER BY s.idx) AS p FROM pg_step s JOIN chunkn c ON c.node = s.node) t WHERE p <> chunk) u""",
    "chunk_index": """SELECT DISTINCT r.chr, r.chunk, e.n1, e.n2, e.mark FROM pg_edge e JOIN (SELECT chr, chunk, node FROM cbfs UNION SELECT chr, chunk, node FROM chunkn) r ON r.node = e.n1 OR r.node = e.n2""",
    "bfs_cross": "SELECT node, MIN(depth) AS depth FROM xbfs GROUP BY node",
    "chunk_index_nocross": """SELECT DISTINCT r.chr, r.chunk, e.n1, e.n2, e.mark FROM xedge e JOIN (SELECT chr, chunk, node FROM fbfs UNION SELECT chr, chunk, node FROM chunkn) r ON r.node = e.n1 OR r.node = e.n2""",
    "cigar_split": "SELECT path, idx, node, cigar, qpos FROM csplit",
    "cigar_slice": "SELECT path, cigar FROM csplit WHERE idx = 1",
    "run_cigars": """SELECT path, CAST(run AS BIGINT) AS run, MIN(qpos) AS q_start, STRING_AGG(cigar, '' ORDER BY idx) AS cigar FROM (SELECT *, SUM(nw) OVER (PARTITION BY path ORDER BY idx) AS run FROM (
SELECT *, CASE WHEN LAG(idx) OVER (PARTITION BY path ORDER BY idx) + 1 = idx THEN 0 ELSE 1 END AS nw FROM csplit WHERE node IN (SELECT node FROM shown)) a) b GROUP BY path, run""",
    "layers": "SELECT fid, CAST(layer AS INT) AS layer FROM lay WHERE rn > 0",
    "track_layers": """SELECT track, layers, CAST(SUM(layers) OVER (ORDER BY track) AS BIGINT) AS cum_layer, n FROM (
SELECT f.track, f.n, CASE WHEN f.track = 'click' THEN 1 ELSE d.depth END AS layers FROM (SELECT track, COUNT(*) AS n FROM pg_feature GROUP BY track) f JOIN (SELECT track, MAX(layer) AS depth FROM tlay GROUP BY track) d USING (track)) t""",
    "gene_blocks": """SELECT chr, CAST(cluster AS BIGINT) AS cluster, CAST(layer AS INT) AS layer, CAST(SUM(m + 1) OVER (PARTITION BY chr, cluster ORDER BY layer) - m AS BIGINT) AS "offset" FROM (
SELECT c.chr, c.cluster, l.layer, MAX(c.fid % 3) AS m FROM clus c JOIN (SELECT fid, layer FROM lay WHERE rn > 0) l ON l.fid = c.fid GROUP BY 1, 2, 3) t""",
    "bubble_collapse": "SELECT node FROM hid",
    "view_simple": """SELECT 'reference' AS kind, node AS n1, CAST(NULL AS BIGINT) AS n2, CAST(NULL AS INT) AS mark FROM rkeep UNION ALL SELECT 'variant', node, NULL, NULL FROM vnode
UNION ALL SELECT 'edge', n1, n2, mark FROM sub e WHERE n1 IN (SELECT node FROM vboth) AND n2 IN (SELECT node FROM vboth)
  AND NOT EXISTS (SELECT 1 FROM skip s WHERE s.skipped_len > 0 AND s.n1 = e.n1 AND s.n2 = e.n2 AND s.mark = e.mark)""",
    "import_nodes": """SELECT node, '1' AS asm, chr, qpos AS start_pos, qpos + len - 1 AS end_pos, len, 0 AS rank FROM pg_step WHERE asm = 1
UNION ALL SELECT node, CAST(asm AS VARCHAR), chr, qpos, qpos + len - 1, len, 1 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY node ORDER BY CAST(asm AS VARCHAR)) AS rn FROM pg_step WHERE node NOT IN (SELECT node FROM pg_step WHERE asm = 1)) t WHERE rn = 1
UNION ALL SELECT node, NULL, NULL, NULL, NULL, len, 1 FROM pg_node WHERE node NOT IN (SELECT node FROM pg_step) UNION ALL SELECT id, NULL, NULL, NULL, NULL, distance, 1 FROM ijid""",
    "import_edges": """SELECT e.n1, e.n2, CASE WHEN (e.mark IN (2, 3)) <> (a.node IS NOT NULL) THEN '+' ELSE '-' END AS sign1, CASE WHEN (e.mark IN (2, 4)) <> (b.node IS NOT NULL) THEN '+' ELSE '-' END AS sign2
FROM iedge e LEFT JOIN iflip a ON e.n1 = a.node LEFT JOIN iflip b ON e.n2 = b.node""",
    "import_steps": """SELECT CAST(asm AS VARCHAR) AS asm, chr, idx, node, CASE WHEN node IN (SELECT node FROM iflip) THEN CASE WHEN ori = '>' THEN '<' ELSE '>' END ELSE ori END AS ori FROM pg_step""",
    "default_view": "SELECT MIN(chr) AS chr, CAST(1 AS BIGINT) AS start_pos, CAST(10000 AS BIGINT) AS end_pos FROM pg_node WHERE rank = 0",
    "edges_off_reference": "SELECT * FROM pg_edge e WHERE NOT EXISTS (SELECT 1 FROM along x WHERE x.asm = 0 AND x.a = e.n1 AND x.b = e.n2 AND x.m = e.mark)",
    "gfa_jumps": "SELECT n1, sign1, n2, sign2, distance FROM jmp",
    "jumps_off_reference": "SELECT n1, sign1, n2, sign2, distance FROM jmp j WHERE NOT EXISTS (SELECT 1 FROM along x WHERE x.asm = 0 AND x.a = j.n1 AND x.b = j.n2 AND x.m = j.mark)",
    "jump_nodes": "SELECT id AS node, distance AS len FROM jid",
    "jump_edges": "SELECT n1, id AS n2, CASE WHEN sign1 = '+' THEN 2 ELSE 4 END AS mark FROM jid UNION ALL SELECT id, n2, CASE WHEN sign2 = '+' THEN 2 ELSE 3 END FROM jid",
    "shadow_edges": """SELECT p AS n1, here AS n2, 2 AS mark FROM (SELECT *, LAG(here) OVER (PARTITION BY path_id ORDER BY idx) AS p FROM (
SELECT *, CASE WHEN rn > 1 THEN (SELECT MAX(node) FROM pg_node) + SUM(CASE WHEN rn > 1 THEN 1 ELSE 0 END) OVER (ORDER BY path_id, idx) ELSE node END AS here FROM (
SELECT *, ROW_NUMBER() OVER (PARTITION BY node ORDER BY path_id, idx) AS rn FROM pg_visit WHERE asm = 1) a) b) c WHERE rn > 1 AND p IS NOT NULL""",
    "reference_flips": "SELECT node FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY node ORDER BY path_id, idx) AS rn FROM pg_visit WHERE asm = 1) t WHERE rn = 1 AND ori = '<'",
    "flipped_steps": """SELECT asm, chr, idx, node, CASE WHEN node IN (SELECT node FROM flip) THEN CASE WHEN ori = '>' THEN '<' ELSE '>' END ELSE ori END AS ori FROM pg_step""",
    "sequence_store": "SELECT node, seq FROM sown UNION ALL SELECT h.id, o.seq FROM sshad h JOIN sown o USING (node) UNION ALL SELECT id, REPEAT('N', CAST(distance AS INT)) FROM jid",
    "fasta_headers": """SELECT CONCAT('>asm1#n', CAST(node AS VARCHAR)) AS value FROM pg_seq UNION ALL SELECT SUBSTRING(seq, 1, length(seq) // 2) FROM pg_seq UNION ALL SELECT SUBSTRING(seq, length(seq) // 2 + 1) FROM pg_seq""",
    "fasta_sequences": "SELECT CONCAT('n', CAST(node AS VARCHAR)) AS name, seq FROM pg_seq",
    "gaf_paths": """SELECT CAST(qname AS VARCHAR) AS qname, pstart AS qstart, CAST(ROW_NUMBER() OVER (PARTITION BY qname ORDER BY pstart) AS INT) - 1 AS place, mapq, plen, pend FROM (
SELECT *, ROW_NUMBER() OVER (PARTITION BY qname, pstart ORDER BY mapq * 1000000 + plen * 1000 + pend DESC) AS rn FROM pg_aln) t WHERE rn = 1""",
    "gaf_confident": "SELECT CAST(qname AS VARCHAR) AS qname, '>s' || CAST(node1 AS VARCHAR) || COALESCE('>s' || CAST(node2 AS VARCHAR), '') AS path, mapq FROM pg_aln WHERE mapq > 40",
    "gfa_file": "SELECT node, CAST(length(seq) AS BIGINT) AS len, seq FROM pg_seq",
    "gfa_blocks": "SELECT 'S' AS record, node AS n1, CAST(NULL AS BIGINT) AS n2, seq AS value FROM pg_seq UNION ALL SELECT 'L', n1, n2, CAST(mark AS VARCHAR) FROM pg_edge",
    "window_of_index": "SELECT DISTINCT e.n1, e.n2, e.mark FROM pg_edge e JOIN igot r ON r.node = e.n1 OR r.node = e.n2 WHERE r.chr = 'Brand#1' AND r.chunk BETWEEN (SELECT MIN(chunk) FROM ihit) AND (SELECT MAX(chunk) FROM ihit)",
    "nodes_on_chromosomes": "SELECT node, chr FROM pg_node WHERE chr LIKE 'Brand#1%'",
    "chromosomes_translated": "SELECT DISTINCT CASE WHEN chr LIKE 'Brand#2%' THEN REPLACE(chr, 'Brand#', 'chr') ELSE chr END AS chr FROM pg_node",
    "assemblies_known": "SELECT w.name, CAST(n.n_nationkey AS BIGINT) AS asm, n.n_name IS NOT NULL AS is_known FROM (SELECT r_name AS name FROM region UNION SELECT n_name FROM nation) w LEFT JOIN nation n ON n.n_name = w.name",
    "coverage_map": "SELECT node, STRING_AGG(CONCAT(CAST(asm AS VARCHAR), ':', CAST(LEAST(c, 65535) AS VARCHAR)), ',' ORDER BY asm) AS cov FROM (SELECT asm, node, COUNT(*) AS c FROM pg_visit GROUP BY asm, node) t GROUP BY node",
    "overlap_lengths": "SELECT qname, pstart, pend, pend - pstart + 3 + 5 + 1 + mapq AS overlap FROM pg_aln",
    "feature_classes": "SELECT fid, CASE fid % 4 WHEN 0 THEN 'exon' WHEN 1 THEN 'CDS' ELSE 'gene' END AS class FROM pg_feature",
    "gene_models": "SELECT gene, parent, type, start_pos, end_pos, id FROM model",
    "gene_model_counts": "SELECT gene, parent, COUNT(*) FILTER (type = 'exon') AS exons, COUNT(*) FILTER (type = 'CDS') AS cds FROM model GROUP BY gene, parent",
    "first_isoforms": "SELECT gene, parent, id FROM (SELECT *, FIRST_VALUE(parent) OVER (PARTITION BY gene ORDER BY fid) AS p FROM model) t WHERE parent = p",
    "exon_flags": """SELECT parent AS transcript, CASE WHEN arg_min(num, start_pos) <> 1 THEN '2' ELSE '0' END AS flag FROM (
SELECT *, ROW_NUMBER() OVER (PARTITION BY parent ORDER BY start_pos, end_pos, fid) AS num FROM model WHERE type = 'exon') t WHERE start_pos >= 300 GROUP BY parent""",
    "genes_at_node": "SELECT n.node, f.fid FROM pg_feature f JOIN pg_node n ON n.rank = 0 AND n.chr = f.chr AND f.start_pos <= n.end_pos AND f.end_pos >= n.start_pos WHERE n.node = 6",
    "assembly_gene_nodes": "SELECT asm, node, fid FROM ogene",
    "assembly_genes": "SELECT DISTINCT asm, fid FROM ogene WHERE asm <> 0 UNION ALL SELECT CAST(0 AS BIGINT), fid FROM pg_feature WHERE fid % 25 = 0",
    "axis_ticks": "SELECT x, pos FROM tick",
    "highlight_links": """SELECT CONCAT_WS('_', CAST(CAST(CASE WHEN l.mark IN (2, 3) THEN a.e_id ELSE a.s_id END AS BIGINT) AS VARCHAR), CAST(CAST(CASE WHEN l.mark IN (2, 4) THEN b.s_id ELSE b.e_id END AS BIGINT) AS VARCHAR),
CAST(CASE WHEN COALESCE(l.mark = 2 AND b.i = a.i + 1, FALSE) THEN 1 ELSE l.mark END AS VARCHAR)) AS link, l.dir FROM lit l JOIN ids a ON a.node = l.n1 JOIN ids b ON b.node = l.n2""",
    "view_rows": """SELECT 'reference' AS part, node AS a, CAST(ROUND(ROUND(x1, 4) * 10000) AS BIGINT) AS b, CAST(ROUND(ROUND(x2, 4) * 10000) AS BIGINT) AS c FROM xs
UNION ALL SELECT 'variant', node, depth, NULL FROM found UNION ALL SELECT 'edge', n1, n2, mark FROM sub UNION ALL SELECT 'draw', source, target, type FROM drawn UNION ALL SELECT 'highlight', n1, n2, dir FROM lit
UNION ALL SELECT 'feature', fid, CAST(ROUND(x1 * 10000) AS BIGINT), CAST(ROUND(x2 * 10000) AS BIGINT) FROM fpix
UNION ALL SELECT 'coverage', node, asm, LEAST(COUNT(*), 65535) FROM pg_visit WHERE node IN (SELECT node FROM shown) GROUP BY node, asm
UNION ALL SELECT 'tick', CAST(ROUND(x * 10000) AS BIGINT), pos, NULL FROM tick UNION ALL SELECT 'run', asm, q_start, q_last FROM runs""",
}


QUERIES |= {
    "cigar_split_long": "SELECT path, idx, node, cigar, qpos FROM lsplit",
    "view_runs": """SELECT k.name, k.asm, r.chr, r.run, r.q_start, r.q_last, r.path, (
SELECT STRING_AGG(l.cigar, '' ORDER BY l.idx) FROM pg_step s JOIN lsplit l ON l.path = CONCAT(CAST(s.asm AS VARCHAR), ':', s.chr) AND l.idx = s.idx WHERE s.asm = r.asm AND s.chr = r.chr AND s.qpos BETWEEN r.q_start AND r.q_last) AS cigar
FROM (SELECT w.name, CAST(n.n_nationkey AS BIGINT) AS asm FROM (SELECT r_name AS name FROM region UNION SELECT n_name FROM nation) w LEFT JOIN nation n ON n.n_name = w.name) k LEFT JOIN runs r ON r.asm = k.asm""",
    "nearest_ref_chains": QUERIES["nearest_ref"],
    "track_layers_capped": QUERIES["track_layers"].replace("MAX(layer) AS depth", "LEAST(MAX(layer), 3) AS depth"),
    "bed_layers_capped": "SELECT fid, CAST(layer AS INT) AS layer FROM tlay WHERE rn > 0 AND layer <= 3",
    "node_info": "SELECT node, chr, COALESCE(start_pos, 0) AS start_pos, COALESCE(end_pos, 0) AS end_pos, len, rank FROM pg_node",
    "edge_info": "SELECT n1, n2, mark FROM pg_edge",
    "list_file": "SELECT n_name AS name, CONCAT(n_name, '.gaf') AS file, CAST(n_nationkey AS BIGINT) AS ordinal FROM nation",
    "gfa_commented": "SELECT n1, n2, mark FROM pg_edge",
    "view_models": """SELECT 'gene' AS part, CONCAT('g', CAST(fid AS VARCHAR)) AS key, layer AS a, x1 AS b, x2 AS c FROM (SELECT fid, ROW_NUMBER() OVER (ORDER BY fid) AS layer FROM mline WHERE type = 'gene') t JOIN mpix USING (fid)
UNION ALL SELECT 'exon', parent, num, x1, x2 FROM mexon UNION ALL SELECT 'CDS', parent, NULL, x1, x2 FROM mcds
UNION ALL SELECT 'transcript', parent, CASE WHEN MIN(num) > 1 THEN 2 ELSE 0 END, COUNT(*), (SELECT COUNT(*) FROM mcds c WHERE c.parent = e.parent) FROM mexon e GROUP BY parent
UNION ALL SELECT 'track', track, layers, cum_layer, n FROM (SELECT track, layers, CAST(SUM(layers) OVER (ORDER BY track) AS BIGINT) AS cum_layer, n FROM (
SELECT f.track, f.n, CASE WHEN f.track = 'click' THEN 1 ELSE d.depth END AS layers FROM (SELECT track, COUNT(*) AS n FROM pg_feature GROUP BY track) f JOIN (SELECT track, LEAST(MAX(layer), 50) AS depth FROM tlay GROUP BY track) d USING (track)) t) u
UNION ALL SELECT 'bed', l.track, l.layer, CAST(ROUND(x.x1 * 10000) AS BIGINT), CAST(ROUND(x.x2 * 10000) AS BIGINT) FROM tlay l JOIN fpix x USING (fid) WHERE l.rn > 0 AND l.layer <= 50""",
    "view_of_index": QUERIES["view_rows"],
    "search_of_index": QUERIES["bfs_window"],
    "tracks_of_index": """SELECT 'run' AS part, CAST(asm AS BIGINT) AS a, CAST(q_start AS BIGINT) AS b, CAST(q_last AS BIGINT) AS c FROM runs
UNION ALL SELECT 'coverage', node, asm, LEAST(COUNT(*), 65535) FROM pg_visit WHERE node IN (SELECT node FROM shown) GROUP BY node, asm
UNION ALL SELECT 'feature', fid, node1, node2 FROM seen""",
}


def oracle_sql() -> dict[str, str]:
    """Name to SQL; each query brings the views it needs."""
    names = list(VIEWS)

    def needed(sql: str, have: set[str]) -> set[str]:

        for name in names:
            if name not in have and re.search(rf"\b{name}\b", sql):
                have.add(name)
                needed(VIEWS[name], have)
        return have

    out = {}
    for name, sql in QUERIES.items():
        use = needed(sql, set())
        views = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in names if v in use)
        out[name] = f"WITH RECURSIVE {views}\n{sql}" if use else sql
    return out
