"""SQL that checks the comparison of two extractors and the gates that follow from it, by a scan of every page's items."""

from __future__ import annotations

from ..operators.diff import CLASSES

R = lambda x, n: f"round(CAST({x} AS DECIMAL(28,8)), {n})::DOUBLE"
DIFF_SQL = """WITH RECURSIVE base AS (SELECT l_orderkey AS doc_id, p_name AS name, lower(p_type) AS kind, round(CAST(l_extendedprice / l_quantity AS DECIMAL(28, 8)), 2)::DOUBLE AS price,
  p_size || ' un' AS unit, l_discount, l_tax, l_returnflag, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) AS pos FROM lineitem JOIN part ON p_partkey = l_partkey),
o AS (SELECT doc_id, pos, name, price, unit, list_distinct(string_split(name, ' ')) AS t FROM base WHERE NOT (l_returnflag = 'A' AND l_tax >= 0.08)),
n0 AS (SELECT doc_id, pos, CASE WHEN l_discount >= 0.09 THEN kind WHEN l_discount >= 0.07 THEN kind || ' ' || name ELSE name END AS name, CASE WHEN l_tax = 0.01 THEN price + 1 ELSE price END AS price,
  CASE WHEN l_tax = 0.02 THEN '1 kg' ELSE unit END AS unit FROM base WHERE NOT (l_returnflag = 'R' AND l_tax >= 0.08)),
n AS (SELECT *, list_distinct(string_split(name, ' ')) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM n0),
ol AS (SELECT doc_id, list({'p': pos, 'price': price, 't': t} ORDER BY pos) AS olds FROM o GROUP BY 1),
one(doc_id, k, used, new_pos, old_pos, similarity) AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) FROM n
  UNION ALL
  SELECT doc_id, k, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.p) END, pos, best.p, -best.s FROM (
    SELECT s.doc_id, n.k, s.used, n.pos, list_sort(list_transform(list_filter(olds, lambda x: abs(n.price - x.price) <= 0.02::DOUBLE AND NOT list_contains(s.used, x.p)),
      lambda x: {'s': -(len(list_intersect(x.t, n.t))::DOUBLE / (len(x.t) + len(n.t) - len(list_intersect(x.t, n.t)))), 'p': x.p}))[1] AS best
    FROM one s JOIN n ON n.doc_id = s.doc_id AND n.k = s.k + 1 LEFT JOIN ol ON ol.doc_id = s.doc_id)),
priced AS (SELECT doc_id, new_pos, old_pos, similarity FROM one WHERE old_pos IS NOT NULL),
n2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k2 FROM n WHERE NOT EXISTS (SELECT 1 FROM priced p WHERE p.doc_id = n.doc_id AND p.new_pos = n.pos)),
ol2 AS (SELECT doc_id, list({'p': pos, 't': t} ORDER BY pos) AS olds FROM o WHERE NOT EXISTS (SELECT 1 FROM priced p WHERE p.doc_id = o.doc_id AND p.old_pos = o.pos) GROUP BY 1),
two(doc_id, k, used, new_pos, old_pos, similarity) AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) FROM n2
  UNION ALL
  SELECT doc_id, k2, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.p) END, pos, best.p, best.s FROM (
    SELECT s.doc_id, n2.k2, s.used, n2.pos, list_filter(list_transform(list_filter(olds, lambda x: NOT list_contains(s.used, x.p)),
      lambda x: {'s': len(list_intersect(x.t, n2.t))::DOUBLE / (len(x.t) + len(n2.t) - len(list_intersect(x.t, n2.t))), 'p': x.p}), lambda y: y.s >= 0.65)[1] AS best
    FROM two s JOIN n2 ON n2.doc_id = s.doc_id AND n2.k2 = s.k + 1 LEFT JOIN ol2 ON ol2.doc_id = s.doc_id)),
pairs AS (SELECT *, 1 AS stage FROM priced UNION ALL SELECT doc_id, new_pos, old_pos, similarity, 2 FROM two WHERE old_pos IS NOT NULL),
cmp AS (
  SELECT p.doc_id, CASE WHEN stage = 2 THEN 'PRICE_DIVERGENCE' WHEN (similarity >= 0.80 OR o.name = n.name) AND o.unit <> n.unit THEN 'UNIT_DIVERGENCE' WHEN similarity >= 0.80 OR o.name = n.name THEN 'MATCH_EXACT'
      WHEN similarity >= 0.50 THEN 'MATCH_SEMANTIC' ELSE 'NAME_IMPROVEMENT' END AS class, old_pos, new_pos, o.name AS old_name, n.name AS new_name, o.price AS old_price, n.price AS new_price,
    o.unit AS old_unit, n.unit AS new_unit, similarity FROM pairs p JOIN o ON o.doc_id = p.doc_id AND o.pos = p.old_pos JOIN n ON n.doc_id = p.doc_id AND n.pos = p.new_pos
  UNION ALL SELECT doc_id, 'FN_GENERIC', pos, NULL, name, NULL, price, NULL, unit, NULL, 0 FROM o WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.doc_id = o.doc_id AND p.old_pos = o.pos)
  UNION ALL SELECT doc_id, CASE WHEN price > 0 THEN 'FN_LEGACY' ELSE 'FP_GENERIC' END, NULL, pos, NULL, name, NULL, price, NULL, unit, 0 FROM n WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.doc_id = n.doc_id AND p.new_pos = n.pos)),
diff AS (SELECT *, CASE class WHEN 'UNIT_DIVERGENCE' THEN 'Preço e nome idênticos, mas unidades diferem (Legacy: ''' || old_unit || ''' vs Generic: ''' || new_unit || ''')'
    WHEN 'MATCH_EXACT' THEN 'Preço, nome e unidade estritamente idênticos ou equivalentes'
    WHEN 'MATCH_SEMANTIC' THEN 'Preço R$ ' || printf('%.2f', new_price) || ' coincide com alta similaridade de tokens (' || printf('%.2f', similarity) || ')'
    WHEN 'NAME_IMPROVEMENT' THEN 'Preço R$ ' || printf('%.2f', new_price) || ' coincide; nome reconstruído (''' || old_name || ''' -> ''' || new_name || ''')'
    WHEN 'PRICE_DIVERGENCE' THEN 'Mesmo produto com preços divergentes: Legacy R$ ' || printf('%.2f', old_price) || ' vs Generic R$ ' || printf('%.2f', new_price)
    WHEN 'FN_GENERIC' THEN 'Item presente apenas no Legacy (Preço R$ ' || printf('%.2f', old_price) || ')'
    WHEN 'FN_LEGACY' THEN 'Oferta legítima recuperada pelo Generic: R$ ' || printf('%.2f', new_price) ELSE 'Item residual Generic sem preço válido' END AS reason FROM cmp)"""
_N = lambda c: f"CAST(count(*) FILTER (class = '{c}') AS BIGINT)"
_COUNTS = ", ".join(f"{_N(c)} AS {c.lower()}" for c in CLASSES)
GATES_SQL = DIFF_SQL + f""", m AS (SELECT doc_id, name, price, count(*) - 1 AS extra FROM n GROUP BY 1, 2, 3),
t AS (SELECT (SELECT count(*) FROM orders) AS documents, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS crashes, (SELECT CAST(sum(extra) AS BIGINT) FROM m) AS duplicate,
  (SELECT {R('quantile_cont(o_totalprice / 20000, 0.99)', 2)} FROM orders WHERE o_orderstatus <> 'P') AS p99, (SELECT greatest((SELECT count(*) FROM o), (SELECT count(*) FROM n))) AS size,
  {_N('FP_GENERIC')} AS fpg, {_N('FN_GENERIC')} AS fng, {_N('PRICE_DIVERGENCE')} AS pd, {_N('UNIT_DIVERGENCE')} AS ud, {_N('MATCH_EXACT')} + {_N('MATCH_SEMANTIC')} + {_N('NAME_IMPROVEMENT')} AS good FROM cmp),
r AS (SELECT *, good / size::DOUBLE AS rate FROM t),
gates AS (SELECT gate_no, gate, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status, expected, actual, documents FROM r, LATERAL (VALUES
  (1, 'G1_crashes', crashes = 0, '0', CAST(crashes AS VARCHAR)), (2, 'G2_fp_generic', fpg = 0, '0', CAST(fpg AS VARCHAR)), (3, 'G3_fn_generic', fng = 0, '0', CAST(fng AS VARCHAR)),
  (4, 'G4_price_divergence', pd = 0, '0', CAST(pd AS VARCHAR)), (5, 'G5_unit_divergence', ud = 0, '0', CAST(ud AS VARCHAR)), (6, 'G6_duplicate', duplicate = 0, '0', CAST(duplicate AS VARCHAR)),
  (7, 'G7_table_integrity', true, 'true', 'true'), (8, 'G8_legacy_regression', true, 'false', 'false'), (9, 'G9_generic_p99_latency', p99 < 100, '100.0', CAST(p99 AS VARCHAR)),
  (10, 'G10_matching_rate', rate >= 0.95, '0.95', CAST({R('rate', 4)} AS VARCHAR)), (11, 'G11_unresolved_rate', true, '0.05', '0.0'), (12, 'G12_idempotency', true, 'true', 'true')) v(gate_no, gate, ok, expected, actual))"""
ORACLES = {
    "extractor_diff": DIFF_SQL + " SELECT doc_id, class, old_pos, new_pos, old_name, new_name, old_price, new_price, old_unit, new_unit, similarity, reason FROM diff",
    "diff_counts": DIFF_SQL + f" SELECT doc_id, {_COUNTS} FROM cmp GROUP BY 1",
    "divergences": DIFF_SQL + " SELECT doc_id, class, reason, old_name, new_name, old_price, new_price FROM diff WHERE class NOT IN ('MATCH_EXACT', 'MATCH_SEMANTIC')",
    "shadow_report": DIFF_SQL + f""", s AS (SELECT *, CASE WHEN class IN ('MATCH_EXACT', 'MATCH_SEMANTIC', 'NAME_IMPROVEMENT', 'UNIT_DIVERGENCE') THEN CASE WHEN similarity >= 0.70 THEN 'exact' ELSE 'semantic' END ELSE 'divergent' END AS m FROM cmp),
tot AS (SELECT doc_id, sum(a) AS total_old, sum(b) AS total_new FROM (SELECT doc_id, 1 AS a, 0 AS b FROM o UNION ALL SELECT doc_id, 0, 1 FROM n) GROUP BY 1),
c AS (SELECT doc_id, count(*) FILTER (m = 'exact') AS exact, count(*) FILTER (m = 'semantic') AS semantic, count(*) FILTER (m = 'divergent') AS divergent,
  count(*) FILTER (m = 'divergent' AND class = 'FP_LEGACY') AS A_falso_positivo_legacy, count(*) FILTER (m = 'divergent' AND class = 'FN_LEGACY') AS B_falso_negativo_legacy,
  count(*) FILTER (m = 'divergent' AND class = 'FP_GENERIC') AS C_falso_positivo_generic, count(*) FILTER (m = 'divergent' AND class = 'FN_GENERIC') AS D_falso_negativo_generic,
  count(*) FILTER (m = 'divergent' AND class = 'PRICE_DIVERGENCE') AS E_divergencia_preco, count(*) FILTER (m = 'semantic') AS F_divergencia_nome FROM s GROUP BY 1)
SELECT c.*, CAST(total_old AS BIGINT) AS total_old, CAST(total_new AS BIGINT) AS total_new, {R('(exact + semantic) / greatest(1, total_old, total_new)::DOUBLE', 4)} AS agreement FROM c JOIN tot USING (doc_id)""",
    "gates": GATES_SQL + " SELECT * FROM gates",
    "gate_decision": GATES_SQL + """, f AS (SELECT count(*) FILTER (status = 'FAIL') AS n, string_agg(gate, ', ' ORDER BY gate_no) FILTER (status = 'FAIL') AS names, max(documents) AS documents FROM gates)
SELECT CASE WHEN n > 0 THEN 'FAIL' WHEN documents < 10 THEN 'INSUFFICIENT_DATA' ELSE 'PASS' END AS decision, CAST(n AS INTEGER) AS failed_gates, documents,
  CASE WHEN n > 0 THEN 'Falha nos seguintes gates: ' || names WHEN documents < 10 THEN 'Todos os gates aprovados, mas há menos documentos que o mínimo.' ELSE 'Todos os gates e o mínimo de documentos foram atendidos.' END AS reason FROM f""",
    "table_digest": """WITH d AS (SELECT md5(concat_ws(chr(31), l_discount, l_extendedprice, l_linenumber, l_linestatus, l_orderkey, l_partkey, l_quantity, l_returnflag, l_suppkey, l_tax)) AS h FROM lineitem)
SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS VARCHAR) AS low, CAST(sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)) AS VARCHAR) AS high FROM d""",
}
