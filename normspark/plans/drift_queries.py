"""Queries of the schema drift operator, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normspark.operators import schema_drift
from normspark.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of every file against the file before it in its series."""
    return schema_drift.drift_log(table(spark, sf_dir, "macro_metrics_raw")).select("file_name", "drift_kind", "field_before", "field_after")


def p4_lifespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The islands of files in which a producer's field lives with one type."""
    return schema_drift.lifespans(schema_drift.catalogue(table(spark, sf_dir, "macro_metrics_raw")))


def p4_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column of the consistent table that each lifespan of a field is part of."""
    return schema_drift.Drift(table(spark, sf_dir, "macro_metrics_raw")).aliases()


def p4_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One consistent table of all readable records."""
    return schema_drift.unified(table(spark, sf_dir, "macro_metrics_raw"))


def p4_column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per series and column of the consistent table the number of its values."""
    rows = p4_unified(spark, sf_dir)
    own = [c for c in rows.columns if c not in schema_drift.INPUT]
    counts = rows.groupBy("report_series").agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in own))
    entries = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_values")) for c in own))
    return counts.select("report_series", F.explode(entries).alias("e")).select("report_series", F.col("e.column").alias("column_name"), "e.n_values").where("n_values > 0")


_FIELDS = r"""
WITH RECURSIVE raw AS (SELECT * FROM macro_metrics_raw WHERE report_series IS NOT NULL AND file_name IS NOT NULL),
files AS (SELECT report_series, file_name, row_number() OVER (PARTITION BY report_series ORDER BY min(written_at), file_name) AS idx, count(*) OVER (PARTITION BY report_series) AS n_files FROM raw GROUP BY report_series, file_name),
good AS (SELECT report_series, file_name, line_no, entry_id, raw_record FROM raw WHERE json_valid(raw_record) AND regexp_matches(raw_record, '^\s*\{')),
keyed AS (SELECT *, unnest(json_keys(raw_record)) AS field FROM good),
vals AS (SELECT report_series, file_name, idx, n_files, line_no, entry_id, raw_record, field, json_extract(raw_record, '$."' || field || '"') AS v,
  CASE WHEN json_type(raw_record, '$."' || field || '"') IN ('BIGINT', 'UBIGINT', 'HUGEINT') THEN 'integer' ELSE CASE json_type(raw_record, '$."' || field || '"') WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' END END AS kind
  FROM keyed JOIN files USING (report_series, file_name)),
cat AS (SELECT report_series, file_name, idx, n_files, field, array_to_string(list_sort(list(DISTINCT kind) FILTER (kind IS NOT NULL AND NOT (kind = 'integer' AND has_double))), '|') AS k
  FROM (SELECT *, bool_or(coalesce(kind = 'double', false)) OVER (PARTITION BY report_series, file_name, field) AS has_double FROM vals) GROUP BY ALL),
foot AS (SELECT report_series, file_name, idx, n_files, field, nullif(k, '') AS kind FROM cat),
gone AS (SELECT a.report_series, a.idx + 1 AS at, a.field FROM foot a WHERE a.idx < a.n_files AND NOT EXISTS (SELECT 1 FROM foot b WHERE b.report_series = a.report_series AND b.idx = a.idx + 1 AND b.field = a.field)),
fresh AS (SELECT a.report_series, a.idx AS at, a.field FROM foot a WHERE a.idx > 1 AND NOT EXISTS (SELECT 1 FROM foot b WHERE b.report_series = a.report_series AND b.idx = a.idx - 1 AND b.field = a.field)),
entry AS (SELECT report_series, idx, field, entry_id, min(t) AS lo, max(t) AS hi FROM (SELECT *, kind || ':' || CASE WHEN kind = 'double' THEN CAST(CAST(v AS DOUBLE) AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS t FROM vals WHERE kind IS NOT NULL AND entry_id IS NOT NULL) GROUP BY ALL),
renamed AS (SELECT g.report_series, g.at, g.field AS old, f.field AS new FROM gone g JOIN fresh f ON f.report_series = g.report_series AND f.at = g.at
  JOIN entry a ON a.report_series = g.report_series AND a.idx = g.at - 1 AND a.field = g.field JOIN entry b ON b.report_series = g.report_series AND b.idx = g.at AND b.field = f.field AND b.entry_id = a.entry_id
  GROUP BY ALL HAVING bool_and(a.lo = a.hi AND b.lo = b.hi AND a.lo = b.lo)),
"""

P4_FOUND = _FIELDS + """
changes AS (SELECT report_series, "at", 'renamed' AS drift_kind, old AS field_before, new AS field_after FROM renamed
  UNION ALL SELECT g.report_series, g.at, 'removed', g.field, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.report_series = g.report_series AND r.at = g.at AND r.old = g.field)
  UNION ALL SELECT g.report_series, g.at, 'added', '', g.field FROM fresh g WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.report_series = g.report_series AND r.at = g.at AND r.new = g.field)
  UNION ALL SELECT a.report_series, b.idx, 'retyped', a.field, a.field FROM foot a JOIN foot b ON b.report_series = a.report_series AND b.idx = a.idx + 1 AND b.field = a.field WHERE a.kind <> b.kind)
SELECT file_name, drift_kind, field_before, field_after FROM changes c JOIN files f ON f.report_series = c.report_series AND f.idx = c.at
"""

P4_LIFESPANS = _FIELDS + """
marked AS (SELECT *, CASE WHEN lag(idx) OVER w = idx - 1 AND lag(kind) OVER w IS NOT DISTINCT FROM kind THEN 0 ELSE 1 END AS new FROM foot WINDOW w AS (PARTITION BY report_series, field ORDER BY idx)),
islands AS (SELECT *, sum(new) OVER (PARTITION BY report_series, field ORDER BY idx) AS island FROM marked)
SELECT report_series, field, any_value(kind) AS kind, min(idx)::INTEGER AS first_idx, max(idx)::INTEGER AS last_idx, max(n_files)::INTEGER AS n_files FROM islands GROUP BY report_series, field, island
"""

_ALIASES = _FIELDS + """
present AS (SELECT *, CASE WHEN lag(idx) OVER w = idx - 1 THEN 0 ELSE 1 END AS new FROM foot WINDOW w AS (PARTITION BY report_series, field ORDER BY idx)),
spans AS (SELECT report_series, field, min(idx) AS first_idx, max(idx) AS last_idx FROM (SELECT *, sum(new) OVER (PARTITION BY report_series, field ORDER BY idx) AS island FROM present) GROUP BY report_series, field, island),
links AS (SELECT a.report_series AS s, a.first_idx AS i, a.field AS f, b.first_idx AS j, b.field AS g FROM renamed r JOIN spans a ON a.report_series = r.report_series AND a.field = r.old AND a.last_idx = r.at - 1 JOIN spans b ON b.report_series = r.report_series AND b.field = r.new AND b.first_idx = r.at),
both_ways AS (SELECT s, i, f, j, g FROM links UNION SELECT s, j, g, i, f FROM links),
reach(s, i, f, j, g) AS (SELECT report_series, first_idx, field, first_idx, field FROM spans UNION SELECT r.s, r.i, r.f, l.j, l.g FROM reach r JOIN both_ways l ON l.s = r.s AND l.i = r.j AND l.f = r.g),
roots AS (SELECT s, i, f, min(struct_pack(i := j, f := g)) AS root FROM reach GROUP BY s, i, f),
named AS (SELECT report_series, field, first_idx, last_idx, root FROM spans JOIN roots ON s = report_series AND i = first_idx AND f = field),
places AS (SELECT DISTINCT report_series, root, unnest(range(first_idx, last_idx + 1)) AS idx FROM named),
later AS (SELECT DISTINCT report_series, root FROM (SELECT *, row_number() OVER (PARTITION BY report_series, root.f, idx ORDER BY root) AS p FROM places) WHERE p > 1),
aliases AS (SELECT n.report_series, field, first_idx::INTEGER AS first_idx, last_idx::INTEGER AS last_idx, CASE WHEN l.root IS NULL THEN n.root.f ELSE n.root.f || '@' || n.root.i END AS "column" FROM named n LEFT JOIN later l ON l.report_series = n.report_series AND l.root = n.root)
"""

P4_ALIASES = _ALIASES + "SELECT * FROM aliases"

P4_COLUMN_COUNTS = _ALIASES + """
, once AS (SELECT DISTINCT report_series, file_name, idx, line_no, entry_id, raw_record, field FROM vals WHERE kind IS NOT NULL)
SELECT o.report_series, a."column" AS column_name, count(*) AS n_values FROM once o JOIN aliases a ON a.report_series = o.report_series AND a.field = o.field AND o.idx BETWEEN a.first_idx AND a.last_idx GROUP BY ALL
"""

QUERIES = {f.__name__: f for f in (p4_found, p4_lifespans, p4_aliases, p4_unified, p4_column_counts)}
ORACLES: dict[str, str] = {"p4_found": P4_FOUND, "p4_lifespans": P4_LIFESPANS, "p4_aliases": P4_ALIASES, "p4_column_counts": P4_COLUMN_COUNTS}
