"""DuckDB SQL equivalents of the query catalog (the correctness oracle).

The SQL is deliberately brute force where the Spark plan is clever: pairs
come from a plain self-join, evidence from a window over all candidates.
Normalisation in SQL skips NFKC (DuckDB has none; the test documents are
already in NFKC) and uses RE2, whose ``\\b`` is ASCII.
"""

from __future__ import annotations

from ..config import CATEGORIES, DETECTOR_VERSION, SCHEMA_VERSION

# FIXED VALUES: the same patterns as tollgate.functions, in RE2 syntax.
WS = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
WSD = WS[:-1] + "-]"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?:\+?60|0)" + WSD + r"?1[0-46-9](?:" + WSD + r"?[0-9]){7,8}\b"
NRIC = r"\b[0-9]{6}-?[0-9]{2}-?[0-9]{4}\b"
IPV4 = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
TOKEN = r"[\p{L}\p{N}]+"
LICENSE_LINE = r"(?m)^[^\n]*[Ll]icen[cs]e[^\n]*"
PLACEHOLDER = r"(?i)^(unknown|n/?a|none|tbd|unspecified)$"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NRIC_OK = ("lambda x: regexp_matches(replace(x, '-', ''), '^[0-9]{12}$') "
           "AND CAST(substr(replace(x, '-', ''), 3, 2) AS INTEGER) BETWEEN 1 AND 12 "
           "AND CAST(substr(replace(x, '-', ''), 5, 2) AS INTEGER) BETWEEN 1 AND 31")
IP_OK = ("lambda x: list_bool_and(list_transform(string_split(x, '.'), "
         "lambda p: CAST(p AS INTEGER) <= 255))")


def _str_count(col: str, kind: str) -> str:
    if kind == "email":
        return f"len(regexp_extract_all({col}, {_q(EMAIL)}))"
    if kind == "phone":
        return f"len(regexp_extract_all({col}, {_q(PHONE)}))"
    if kind == "nric":
        return f"len(list_filter(regexp_extract_all({col}, {_q(NRIC)}), {NRIC_OK}))"
    return f"len(list_filter(regexp_extract_all({col}, {_q(IPV4)}), {IP_OK}))"


def _num_count(col: str, kind: str) -> str:
    t = f"CAST({col} AS VARCHAR)"
    ok = f"({col} IS NOT NULL AND {col} >= 0 AND {col} <= 9007199254740991)"
    if kind == "phone":
        rule = f"regexp_matches({t}, '^601[0-46-9][0-9]{{7,8}}$')"
    else:
        rule = (f"(regexp_matches({t}, '^[0-9]{{12}}$') AND CAST(substr({t}, 3, 2) AS INTEGER) "
                f"BETWEEN 1 AND 12 AND CAST(substr({t}, 5, 2) AS INTEGER) BETWEEN 1 AND 31)")
    return f"CASE WHEN {ok} AND {rule} THEN 1 ELSE 0 END"


def base(group: str, full: bool = True) -> str:
    """CTEs over the audited documents view (or its text alone, with id, split and label);
    ``g`` is the release id."""
    # one key for all features: equal exactly when every normalised feature is
    norm = " || chr(1) || ".join([f"coalesce(lower(trim(regexp_replace({c}, {_q(WS + '+')}, ' ', 'g'))), 'null')"
                                  for c in ("text", "lang", "source")] + ["coalesce(CAST(n_chars AS VARCHAR), 'null')"]
                                 if full else [f"coalesce(lower(trim(regexp_replace(text, {_q(WS + '+')}, ' ', 'g'))), 'null')"])
    toks_all = " || ".join(f"coalesce(regexp_extract_all(lower({c}), {_q(TOKEN)}), [])" for c in ("text", "lang", "source"))
    pii_parts = []
    for col_pos, (col, numeric) in enumerate((("doc_id", True), ("text", False), ("lang", False), ("source", False),
                                              ("n_chars", True), ("split", False), ("label", True))):
        for kind in ("email", "phone", "nric", "ip"):
            if numeric and kind in ("email", "ip"):
                continue
            cnt = _num_count(col, kind) if numeric else f"coalesce({_str_count(col, kind)}, 0)"
            pii_parts.append(
                f"SELECT g, r, {col_pos} AS col_pos, '{col}' AS \"column\", '{kind}' AS kind, "
                f"CAST({cnt} AS BIGINT) AS matches FROM v")
    pii_union = "\n    UNION ALL ".join(pii_parts)
    return f"""
v AS (
  SELECT {group} AS g, d.doc_id, d.text, d.lang, d.source, d.n_chars,
         CASE WHEN d.doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
         l.quality AS label,
         CAST(row_number() OVER (PARTITION BY {group} ORDER BY d.doc_id) - 1 AS BIGINT) AS r
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
),
n AS (
  SELECT g, r, doc_id, text, split, label,
         {norm} AS n_text, split AS n_split, coalesce(CAST(label AS VARCHAR), 'null') AS n_label,
         {toks_all} AS toks_all
  FROM v
),
tk AS (
  SELECT g, r, n_text, list_distinct(toks_all) AS toks, false AS at_limit
  FROM n
),
tk2 AS (SELECT *, len(toks) AS k FROM tk),
cnt AS (SELECT g, count(*) AS rows FROM n GROUP BY g),
pc AS (
  SELECT * FROM (
    {pii_union}
  ) WHERE matches > 0
),
eg AS (
  SELECT g, n_text, n_split, n_label, count(*) AS c, min(r) AS gf
  FROM n GROUP BY ALL HAVING count(*) > 1
),
ls AS (
  SELECT g, n_text, n_label, n_split, count(*) AS ns, min(r) AS fs
  FROM n WHERE split IS NOT NULL AND n_split <> '' GROUP BY ALL
),
lg AS (
  SELECT g, n_text, n_label, sum(ns) AS nn, count(*) AS splits,
         CAST((sum(ns) * sum(ns) - sum(ns * ns)) / 2 AS BIGINT) AS pairs
  FROM ls GROUP BY ALL HAVING (sum(ns) * sum(ns) - sum(ns * ns)) > 0
),
gfirst AS (SELECT g, n_text, n_label, min(r) AS gf FROM n GROUP BY ALL),
cl AS (SELECT g, n_text, n_label, min(r) AS fl FROM n GROUP BY ALL),
cg AS (SELECT g, n_text, count(*) AS labels, min(fl) AS fr FROM cl GROUP BY ALL HAVING count(*) >= 2),
ld AS (
  SELECT g, CASE WHEN n_label = '' THEN '(empty)' ELSE n_label END AS lab,
         count(*) AS c, min(r) AS f
  FROM n GROUP BY ALL
),
np AS (
  SELECT a.g, a.r AS l, b.r AS rr, i, a.k AS ka, b.k AS kb FROM (
    SELECT a.g, a.r, b.r AS br, len(list_intersect(a.toks, b.toks)) AS i
    FROM tk2 a JOIN tk2 b ON a.g = b.g AND a.r < b.r
    WHERE a.k >= 5 AND b.k >= 5 AND a.n_text <> b.n_text
      AND 4 * least(a.k, b.k) >= 3 * greatest(a.k, b.k)
  ) x JOIN tk2 a ON a.g = x.g AND a.r = x.r JOIN tk2 b ON b.g = x.g AND b.r = x.br
  WHERE 100 * i >= 82 * (a.k + b.k - i)
),
ts AS (
  SELECT g, count(*) AS rows, count(*) FILTER (WHERE k >= 5) AS eligible_rows,
         count(*) FILTER (WHERE at_limit) AS rows_at_token_limit,
         CAST(count(*) FILTER (WHERE k >= 5) * (count(*) - 1)
              - coalesce(sum(r) FILTER (WHERE k >= 5), 0) AS BIGINT) AS total_comparisons
  FROM tk2 GROUP BY g
)"""


DOC = "'documents'"
SRC = "d.source"


def _with(group: str, body: str, full: bool = True) -> str:
    return "WITH " + base(group, full).lstrip() + "\n" + body


PCT = "CAST(round(i / (ka + kb - i) * 100) AS BIGINT)"

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["cell_limit_violations"] = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", 'cell-characters' AS rule, "
    f"count(*) FILTER (WHERE length({c}) + length(regexp_replace({c}, "
    f"'[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) > 4096) AS violations FROM {t}"
    for t, cols in (("documents", ("text", "lang", "source")), ("pages", ("url", "html")),
                    ("conversations", ("role", "text")), ("benchmark", ("text",)))
    for c in cols)

ORACLE_SQL["scalar_violations"] = "\nUNION ALL\n".join([
    "SELECT 'embeddings' AS \"table\", 'embedding' AS \"column\", 'non-scalar' AS rule, "
    "count(embedding) AS violations FROM embeddings",
    "SELECT 'events' AS \"table\", 'value' AS \"column\", 'non-finite' AS rule, "
    "count(*) FILTER (WHERE isnan(value) OR isinf(value)) AS violations FROM events",
] + [
    f"SELECT 'lineitem' AS \"table\", '{c}' AS \"column\", 'non-finite' AS rule, "
    f"count(*) FILTER (WHERE isnan({c}) OR isinf({c})) AS violations FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
])

ORACLE_SQL["pii_cells"] = _with(DOC, """
SELECT g AS release_id, r + 1 AS row, "column", kind, matches FROM pc""")

ORACLE_SQL["pii_by_kind"] = _with(DOC, """
SELECT g AS release_id, kind, count(*) AS cells, CAST(sum(matches) AS BIGINT) AS matches
FROM pc GROUP BY ALL""")

ORACLE_SQL["pii_cell_count"] = _with(DOC, """
SELECT c.g AS release_id, CAST(coalesce(x.cells, 0) AS BIGINT) AS pii_cells
FROM cnt c LEFT JOIN (SELECT g, count(DISTINCT (r, col_pos)) AS cells FROM pc GROUP BY g) x
  USING (g)""")

ORACLE_SQL["pii_pages"] = "WITH pv AS (SELECT page_id, url, html FROM pages),\npc AS (\n" + \
    "\nUNION ALL\n".join(
        f"SELECT '{k}' AS kind, CAST({_str_count(c, k)} AS BIGINT) AS m FROM pv"
        for c in ("url", "html") for k in ("email", "phone", "nric", "ip")) + \
    """)
SELECT 'pages' AS release_id, kind, count(*) AS cells, CAST(sum(m) AS BIGINT) AS matches
FROM pc WHERE m > 0 GROUP BY kind"""

ORACLE_SQL["exact_duplicate_groups"] = _with(DOC, """
SELECT g AS release_id, gf + 1 AS first_row, c AS n FROM eg""")

ORACLE_SQL["exact_duplicate_pairs"] = _with(DOC, """
SELECT g AS release_id, count(*) AS groups, CAST(sum(c * (c - 1) / 2) AS BIGINT) AS pairs
FROM eg GROUP BY g""")

ORACLE_SQL["exact_duplicate_evidence"] = _with(DOC, """,
em AS (SELECT n.g, n.r, eg.gf FROM n JOIN eg USING (g, n_text, n_split, n_label)),
ep AS (SELECT a.g, a.gf, a.r + 1 AS l, b.r + 1 AS rr FROM em a JOIN em b
       ON a.g = b.g AND a.gf = b.gf AND a.r < b.r)
SELECT g AS release_id, 'exact:' || l || ':' || rr AS key, l AS row, rr AS other_row,
       row_number() OVER (PARTITION BY g ORDER BY gf, l, rr) AS ordinal
FROM ep QUALIFY ordinal <= 6""")

ORACLE_SQL["token_stats"] = _with(DOC, """
SELECT g AS release_id, rows, eligible_rows, rows_at_token_limit, total_comparisons FROM ts""")

ORACLE_SQL["near_duplicate_pairs"] = _with(DOC, """
SELECT g AS release_id, count(*) AS pairs FROM np GROUP BY g""")

ORACLE_SQL["near_duplicate_evidence"] = _with(DOC, f"""
SELECT g AS release_id, 'near:' || (l + 1) || ':' || (rr + 1) AS key, l + 1 AS row,
       rr + 1 AS other_row, row_number() OVER (PARTITION BY g ORDER BY l, rr) AS ordinal,
       'The token sets agree by ' || {PCT} || '%.' AS detail
FROM np QUALIFY ordinal <= 6""")

ORACLE_SQL["split_leakage_groups"] = _with(DOC, """
SELECT lg.g AS release_id, gfirst.gf + 1 AS first_row, CAST(nn AS BIGINT) AS n, splits, pairs
FROM lg JOIN gfirst USING (g, n_text, n_label)""", full=False)

ORACLE_SQL["split_leakage_pairs"] = _with(DOC, """
SELECT g AS release_id, count(*) AS groups, CAST(sum(pairs) AS BIGINT) AS pairs
FROM lg GROUP BY g""", full=False)

_LEAK_EV = """
lev AS (
  SELECT x.g, gf.gf, x.r AS xr, s.fs
  FROM n x
  JOIN ls s ON s.g = x.g AND s.n_text = x.n_text AND s.n_label = x.n_label
       AND s.n_split <> x.n_split AND s.fs < x.r
  JOIN gfirst gf ON gf.g = x.g AND gf.n_text = x.n_text AND gf.n_label = x.n_label
  WHERE x.split IS NOT NULL AND x.n_split <> ''
)"""

ORACLE_SQL["split_leakage_evidence"] = _with(DOC, "," + _LEAK_EV + """
SELECT g AS release_id, 'leakage:' || (fs + 1) || ':' || (xr + 1) AS key, fs + 1 AS row,
       xr + 1 AS other_row, row_number() OVER (PARTITION BY g ORDER BY gf, xr, fs) AS ordinal
FROM lev QUALIFY ordinal <= 6""", full=False)

ORACLE_SQL["conflicting_labels"] = _with(DOC, """
SELECT g AS release_id, count(*) AS groups FROM cg GROUP BY g""", full=False)

_CONF_EV = """
cev AS (
  SELECT cg.g, cg.fr, cg.labels, min(cl.fl) AS sr
  FROM cg JOIN cl ON cl.g = cg.g AND cl.n_text = cg.n_text AND cl.fl > cg.fr
  GROUP BY ALL
)"""

ORACLE_SQL["conflict_evidence"] = _with(DOC, "," + _CONF_EV + """
SELECT g AS release_id, 'conflict:' || (fr + 1) || ':' || (sr + 1) AS key, fr + 1 AS row,
       sr + 1 AS other_row, row_number() OVER (PARTITION BY g ORDER BY fr) AS ordinal,
       labels || ' labels stand beside one set of features.' AS detail
FROM cev QUALIFY ordinal <= 6""", full=False)

_LD = """
ldn AS (
  SELECT g, c, CAST(row_number() OVER (PARTITION BY g ORDER BY f) AS VARCHAR) AS idx FROM ld
)"""

ORACLE_SQL["label_distribution"] = _with(DOC, "," + _LD + """
SELECT g AS release_id, 'class-' || lpad(idx, CAST(greatest(2, length(idx)) AS INTEGER), '0') AS category,
       c AS count FROM ldn""")

_IMB = """
imb AS (
  SELECT l.g, c.rows, count(*) AS classes, max(l.c) AS largest, min(l.c) AS smallest,
         max(l.c) / c.rows AS maj, min(l.c) / c.rows AS mnr
  FROM ld l JOIN cnt c USING (g) GROUP BY l.g, c.rows
),
imb2 AS (
  SELECT *, rows >= 10 AND classes >= 2 AND (maj > 0.75 OR mnr < 0.15) AS imbalanced FROM imb
)"""

ORACLE_SQL["class_imbalance"] = _with(DOC, "," + _IMB + """
SELECT g AS release_id, rows, classes, largest, smallest,
       CAST(CAST(round(maj * 100) AS BIGINT) AS VARCHAR) AS majority_pct,
       CAST(CAST(round(mnr * 100) AS BIGINT) AS VARCHAR) AS minority_pct, imbalanced
FROM imb2""")

_REL = f"""
rel AS (
  SELECT source AS release_id, source AS dataset_name,
         regexp_replace(source, {_q('^' + WS + '+|' + WS + '+$')}, '', 'g') AS provenance,
         regexp_replace(coalesce(min_by(line, doc_id) FILTER (WHERE line <> ''), ''),
                        {_q('^' + WS + '+|' + WS + '+$')}, '', 'g') AS license,
         '' AS purpose, 'label' AS label_column, 'split' AS split_column, 'doc_id' AS id_column
  FROM (SELECT source, doc_id, regexp_extract(text, {_q(LICENSE_LINE)}, 0) AS line FROM documents)
  GROUP BY source
),
gov AS (
  SELECT release_id, 'missing-provenance' AS finding_id, 'block' AS severity FROM rel
  WHERE trim(regexp_replace(provenance, {_q('^' + WS + '+|' + WS + '+$')}, '', 'g')) = ''
     OR regexp_matches(regexp_replace(provenance, {_q('^' + WS + '+|' + WS + '+$')}, '', 'g'),
                       {_q(PLACEHOLDER)})
  UNION ALL
  SELECT release_id, 'missing-license', 'block' FROM rel
  WHERE regexp_replace(license, {_q('^' + WS + '+|' + WS + '+$')}, '', 'g') = ''
     OR regexp_matches(regexp_replace(license, {_q('^' + WS + '+|' + WS + '+$')}, '', 'g'),
                       {_q(PLACEHOLDER)})
)"""

ORACLE_SQL["governance_findings"] = "WITH " + _REL.lstrip() + """
SELECT release_id, finding_id, severity, CAST(1 AS BIGINT) AS count FROM gov"""

# all findings of the per-source audit (exact near-duplicate mode)
_FINDINGS = "," + _REL + "," + _IMB + """,
fnd AS (
  SELECT g AS release_id, 'pii-' || kind AS finding_id, 'block' AS severity, count(*) AS count
  FROM pc GROUP BY ALL
  UNION ALL SELECT g, 'exact-duplicates', 'warn', CAST(sum(c * (c - 1) / 2) AS BIGINT) FROM eg GROUP BY g
  UNION ALL SELECT g, 'near-duplicates', 'warn', count(*) FROM np GROUP BY g
  UNION ALL SELECT g, 'split-leakage', 'block', CAST(sum(pairs) AS BIGINT) FROM lg GROUP BY g
  UNION ALL SELECT g, 'conflicting-labels', 'block', count(*) FROM cg GROUP BY g
  UNION ALL SELECT g, 'class-imbalance', 'warn', 1 FROM imb2 WHERE imbalanced
  UNION ALL SELECT release_id, finding_id, severity, 1 FROM gov
),
gate AS (
  SELECT r.release_id,
         CAST(count(*) FILTER (WHERE f.severity = 'block') AS BIGINT) AS block_count,
         CAST(count(*) FILTER (WHERE f.severity = 'warn') AS BIGINT) AS warning_count
  FROM rel r LEFT JOIN fnd f USING (release_id) GROUP BY r.release_id
),
gate2 AS (
  SELECT *, CASE WHEN block_count > 0 THEN 'BLOCK' WHEN warning_count > 0 THEN 'WARN'
                 ELSE 'PASS' END AS status FROM gate
)"""

ORACLE_SQL["audit_findings"] = _with(SRC, _FINDINGS + """
SELECT release_id, finding_id, severity, CAST(count AS BIGINT) AS count FROM fnd""")

ORACLE_SQL["gate_status"] = _with(SRC, _FINDINGS + """
SELECT release_id, status, block_count, warning_count FROM gate2""")

ORACLE_SQL["audit_summary"] = _with(SRC, _FINDINGS + """
SELECT g2.release_id, g2.status, ts.rows AS row_count, CAST(7 AS BIGINT) AS column_count,
       g2.block_count, g2.warning_count,
       CAST(coalesce(pcc.cells, 0) AS BIGINT) AS pii_cell_count,
       CAST(coalesce(ex.pairs, 0) AS BIGINT) AS exact_duplicate_pairs,
       CAST(coalesce(nr.pairs, 0) AS BIGINT) AS near_duplicate_pairs,
       CAST(coalesce(lk.pairs, 0) AS BIGINT) AS leakage_pairs,
       CAST(coalesce(cf.groups, 0) AS BIGINT) AS conflicting_groups,
       ts.total_comparisons AS near_comparisons, CAST(coalesce(lc.classes, 0) AS BIGINT) AS label_classes,
       'label' AS label_column, 'split' AS split_column, 'doc_id' AS id_column
FROM gate2 g2
JOIN ts ON ts.g = g2.release_id
LEFT JOIN (SELECT g, count(DISTINCT (r, col_pos)) AS cells FROM pc GROUP BY g) pcc ON pcc.g = g2.release_id
LEFT JOIN (SELECT g, sum(c * (c - 1) / 2) AS pairs FROM eg GROUP BY g) ex ON ex.g = g2.release_id
LEFT JOIN (SELECT g, count(*) AS pairs FROM np GROUP BY g) nr ON nr.g = g2.release_id
LEFT JOIN (SELECT g, sum(pairs) AS pairs FROM lg GROUP BY g) lk ON lk.g = g2.release_id
LEFT JOIN (SELECT g, count(*) AS groups FROM cg GROUP BY g) cf ON cf.g = g2.release_id
LEFT JOIN (SELECT g, count(*) AS classes FROM ld GROUP BY g) lc ON lc.g = g2.release_id""")

# evidence of the documents audit (exact mode), capped at 6 per finding
_ALL_EV = "," + _LEAK_EV + "," + _CONF_EV + "," + _IMB + """,
em AS (SELECT n.g, n.r, eg.gf FROM n JOIN eg USING (g, n_text, n_split, n_label)),
ep AS (SELECT a.g, a.gf, a.r + 1 AS l, b.r + 1 AS rr FROM em a JOIN em b
       ON a.g = b.g AND a.gf = b.gf AND a.r < b.r),
ev AS (
  SELECT g, 'pii-' || kind AS finding_id, 'pii:' || kind || ':' || (r + 1) || ':' || "column" AS key,
         r + 1 AS row, CAST(NULL AS BIGINT) AS other_row, "column",
         '[' || kind || ' redacted]' AS masked_value,
         row_number() OVER (PARTITION BY g, kind ORDER BY r, col_pos) AS ordinal
  FROM pc
  UNION ALL
  SELECT g, 'exact-duplicates', 'exact:' || l || ':' || rr, l, rr, NULL, NULL,
         row_number() OVER (PARTITION BY g ORDER BY gf, l, rr) FROM ep
  UNION ALL
  SELECT g, 'near-duplicates', 'near:' || (l + 1) || ':' || (rr + 1), l + 1, rr + 1, NULL, NULL,
         row_number() OVER (PARTITION BY g ORDER BY l, rr) FROM np
  UNION ALL
  SELECT g, 'split-leakage', 'leakage:' || (fs + 1) || ':' || (xr + 1), fs + 1, xr + 1, 'split',
         NULL, row_number() OVER (PARTITION BY g ORDER BY gf, xr, fs) FROM lev
  UNION ALL
  SELECT g, 'conflicting-labels', 'conflict:' || (fr + 1) || ':' || (sr + 1), fr + 1, sr + 1,
         'label', NULL, row_number() OVER (PARTITION BY g ORDER BY fr) FROM cev
  UNION ALL
  SELECT g, 'class-imbalance', 'imbalance:label-distribution', NULL, NULL, 'label', NULL, 1
  FROM imb2 WHERE imbalanced
),
evc AS (SELECT * FROM ev WHERE ordinal <= 6)"""

ORACLE_SQL["evidence_capped"] = _with(DOC, _ALL_EV + """
SELECT g AS release_id, finding_id, key, CAST(row AS BIGINT) AS row,
       CAST(other_row AS BIGINT) AS other_row, "column", masked_value,
       CAST(ordinal AS BIGINT) AS ordinal
FROM evc""")

_KEYS = _ALL_EV + """,
ids AS (SELECT g, r + 1 AS row, CAST(doc_id AS VARCHAR) AS id_text FROM v),
kv AS (
  SELECT e.g, e.finding_id,
         CASE WHEN e.finding_id LIKE 'pii-%' THEN e.finding_id
              WHEN e.finding_id = 'exact-duplicates' THEN 'exact-duplicate'
              WHEN e.finding_id = 'near-duplicates' THEN 'near-duplicate'
              WHEN e.finding_id = 'conflicting-labels' THEN 'conflicting-label'
              ELSE e.finding_id END AS category,
         e."column", a.id_text AS ia, b.id_text AS ib
  FROM evc e LEFT JOIN ids a ON a.g = e.g AND a.row = e.row
  LEFT JOIN ids b ON b.g = e.g AND b.row = e.other_row
),
pk AS (
  SELECT DISTINCT g AS case_id, category,
         g || '|' || category || '|' || CASE
           WHEN category = 'class-imbalance' THEN coalesce("column", 'label')
           WHEN category LIKE 'pii-%' THEN ia || '|' || coalesce("column", 'unknown')
           ELSE array_to_string(list_sort(list_filter([ia, ib], lambda x: x IS NOT NULL AND x <> '')), '|')
         END AS key
  FROM kv
)"""

ORACLE_SQL["prediction_keys"] = _with(DOC, _KEYS + """
SELECT case_id, category, key FROM pk""")

ORACLE_SQL["clean_rows_flagged"] = _with(DOC, _ALL_EV + """
SELECT e.g AS release_id, count(DISTINCT v.doc_id) AS clean_rows_flagged
FROM (SELECT g, row FROM evc UNION ALL SELECT g, other_row FROM evc) e
JOIN v ON v.g = e.g AND v.r + 1 = e.row
GROUP BY e.g""")


ORACLE_SQL["dataset_fingerprint"] = """
WITH rows AS (
  SELECT 'documents' AS g,
         CAST(row_number() OVER (ORDER BY d.doc_id) - 1 AS BIGINT) AS r,
         sha256('{"doc_id":' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')
                || ',"text":' || coalesce(to_json(d.text), 'null')
                || ',"lang":' || coalesce(to_json(d.lang), 'null')
                || ',"source":' || coalesce(to_json(d.source), 'null')
                || ',"n_chars":' || coalesce(CAST(d.n_chars AS VARCHAR), 'null')
                || ',"split":' || to_json(CASE WHEN d.doc_id % 5 = 0 THEN 'test' ELSE 'train' END)
                || ',"label":' || coalesce(CAST(l.quality AS VARCHAR), 'null') || '}') AS h
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
),
h1 AS (SELECT g, r // 65536 AS c, sha256(string_agg(h, '' ORDER BY r)) AS h FROM rows GROUP BY ALL),
h2 AS (SELECT g, sha256(string_agg(h, '' ORDER BY c)) AS h FROM h1 GROUP BY g)
SELECT g AS release_id, h AS dataset_hash FROM h1 WHERE (SELECT max(r) FROM rows) < 65536
UNION ALL
SELECT g, h FROM h2 WHERE (SELECT max(r) FROM rows) >= 65536"""

_IDENT = """
ident AS (
  SELECT o_orderkey AS id, 60110000000 + o_orderkey % 10000000 AS contact,
         (year(o_orderdate) % 100 * 10000 + o_orderkey % 15 * 100 + day(o_orderdate)) AS d, o_custkey AS c
  FROM orders),
held AS (
  SELECT id, contact, CAST(d * 1000000 + c % 1000000 AS BIGINT) AS holder,
         lpad(CAST(d AS VARCHAR), 6, '0') || '-14-' || lpad(CAST(c % 10000 AS VARCHAR), 4, '0') AS holder_text
  FROM ident)"""

ORACLE_SQL["pii_identifiers"] = "WITH " + _IDENT.lstrip() + """
SELECT "column", kind, count(*) AS cells, CAST(sum(matches) AS BIGINT) AS matches FROM (
""" + "\n  UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{kind}' AS kind, {_num_count(c, kind) if c != 'holder_text' else _str_count(c, kind)} AS matches FROM held"
    for c in ("contact", "holder", "holder_text") for kind in ("email", "phone", "nric", "ip")
    if c == "holder_text" or kind in ("phone", "nric")) + """
) WHERE matches > 0 GROUP BY ALL"""

ORACLE_SQL["row_shape_violations"] = """
WITH k AS (
  SELECT event_id + 1 AS row, list_sort(list_transform(json_keys(props), lambda x: lower(trim(x)))
           || CASE WHEN event_type = 'purchase' THEN ['amount'] ELSE [] END) AS keys FROM events)
SELECT row, CASE WHEN len(keys) = 0 THEN 'no-columns' WHEN len(keys) <> len(list_distinct(keys)) THEN 'colliding-columns'
                 ELSE 'schema-mismatch' END AS rule
FROM k WHERE len(keys) = 0 OR len(keys) <> len(list_distinct(keys)) OR keys <> (SELECT keys FROM k ORDER BY row LIMIT 1)"""

ORACLE_SQL["table_hash"] = """
WITH rows AS (
  SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS r,
         sha256('{"doc_id":' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ',"quality":' || coalesce(CAST(quality AS VARCHAR), 'null')
                || ',"toxic":' || coalesce(CAST(toxic AS VARCHAR), 'null') || '}') AS h FROM labels),
h1 AS (SELECT r // 65536 AS c, sha256(string_agg(h, '' ORDER BY r)) AS h FROM rows GROUP BY ALL),
h2 AS (SELECT sha256(string_agg(h, '' ORDER BY c)) AS h FROM h1)
SELECT h AS table_hash FROM h1 WHERE (SELECT max(r) FROM rows) < 65536
UNION ALL SELECT h FROM h2 WHERE (SELECT max(r) FROM rows) >= 65536"""

ORACLE_SQL["configuration_hash"] = "WITH " + _REL.lstrip() + f"""
SELECT release_id, sha256('{{"detector":"{DETECTOR_VERSION}","metadata":{{"datasetName":'
  || to_json(dataset_name) || ',"idColumn":' || to_json(id_column) || ',"labelColumn":'
  || to_json(label_column) || ',"license":' || to_json(license) || ',"provenance":'
  || to_json(provenance) || ',"purpose":' || to_json(purpose) || ',"splitColumn":'
  || to_json(split_column) || '}},"schemaVersion":"{SCHEMA_VERSION}"}}') AS configuration_hash
FROM rel"""

ORACLE_SQL["metadata_violations"] = "WITH " + _REL.lstrip() + "\n" + "\nUNION ALL\n".join(
    f"SELECT release_id, '{c}' AS field, 'too-long' AS rule FROM rel WHERE length({c}) > 24"
    for c in ("dataset_name", "provenance", "license"))

# keys of the audit of each source, named like those of the whole table
_SOURCE_KEYS = _with(SRC, "," + _REL + _KEYS + """
SELECT 'documents' AS case_id, category, 'documents' || substr(key, length(case_id) + 1) AS key FROM pk
UNION SELECT 'documents', finding_id, 'documents|' || finding_id || '|metadata' FROM gov""")
_TABLE_KEYS = _with(DOC, _KEYS + "\nSELECT case_id, category, key FROM pk")
_SCORE = f"""WITH sj AS (
  SELECT coalesce(p.case_id, x.case_id) AS case_id, coalesce(p.category, x.category) AS category,
         p.key IS NOT NULL AS p, x.key IS NOT NULL AS gld
  FROM ({_SOURCE_KEYS}) p FULL OUTER JOIN ({_TABLE_KEYS}) x ON p.case_id = x.case_id AND p.key = x.key
)"""
_TALLY = """count(*) FILTER (WHERE gld) AS expected,
       count(*) FILTER (WHERE p AND gld) AS matched,
       count(*) FILTER (WHERE p AND NOT gld) AS unexpected,
       count(*) FILTER (WHERE gld AND NOT p) AS missed"""

ORACLE_SQL["score_by_category"] = _SCORE + f"""
SELECT c.category, CAST(coalesce(t.expected, 0) AS BIGINT) AS expected,
       CAST(coalesce(t.matched, 0) AS BIGINT) AS matched,
       CAST(coalesce(t.unexpected, 0) AS BIGINT) AS unexpected,
       CAST(coalesce(t.missed, 0) AS BIGINT) AS missed
FROM (VALUES {", ".join(f"('{c}')" for c in CATEGORIES)}) c(category)
LEFT JOIN (SELECT category, {_TALLY} FROM sj GROUP BY category) t USING (category)"""

ORACLE_SQL["score_by_case"] = _SCORE + f"""
SELECT case_id, {_TALLY} FROM sj GROUP BY case_id"""

ORACLE_SQL["score_overall"] = _SCORE + f"""
SELECT {_TALLY} FROM sj"""
