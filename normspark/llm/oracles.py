"""SQL for DuckDB that gives the rows of the queries by brute force, at the scale of the comparison."""

_LEDGER = """
WITH RECURSIVE r AS (SELECT sample_id, arg_min(category, ingested_at) AS category, lower(trim(arg_min(split, ingested_at))) AS split, min(ingested_at) AS arrived FROM manifest WHERE sample_id IS NOT NULL AND category IS NOT NULL AND ingested_at IS NOT NULL GROUP BY sample_id),
a AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY arrived, sha256(sample_id), sample_id) AS arrival FROM r WHERE split = 'train'),
n AS (SELECT category, max(arrival) AS n FROM a GROUP BY category),
q AS (SELECT name AS experiment, seed, quick_train AS q, greatest(1, round(quick_train * 0.05))::BIGINT AS g FROM experiment_settings WHERE quick_train > 0),
base AS (SELECT experiment, seed, q, g, slot, sum(1 + floor(6 * (slot - 1)::DOUBLE / q)::BIGINT) OVER (PARTITION BY experiment ORDER BY slot) AS opens FROM (SELECT *, unnest(range(1, q + 1)) AS slot FROM q)),
more AS (SELECT experiment, seed, q + g * (e - 1) + j AS slot, big * (1 << e)::BIGINT AS opens FROM (SELECT experiment, any_value(seed) AS seed, any_value(q) AS q, any_value(g) AS g, max(opens) AS big FROM base GROUP BY experiment) CROSS JOIN range(1, 20) t(e) CROSS JOIN LATERAL (SELECT unnest(range(1, g + 1)) AS j)),
sl AS (SELECT experiment, seed, slot, opens FROM base UNION ALL SELECT experiment, seed, slot, opens FROM more),
h AS (SELECT experiment, category, arrival, sample_id, sha256(seed || ':' || category || ':' || sample_id) AS h FROM a CROSS JOIN q),
f(experiment, category, slot, taken) AS (SELECT experiment, category, 0::BIGINT, []::VARCHAR[] FROM q CROSS JOIN n
  UNION ALL SELECT f.experiment, f.category, f.slot + 1, list_append(f.taken, arg_min(h.sample_id, struct_pack(h := h.h, i := h.sample_id)))
  FROM f JOIN sl ON sl.experiment = f.experiment AND sl.slot = f.slot + 1 JOIN n ON n.category = f.category AND n.n >= sl.opens JOIN h ON h.experiment = f.experiment AND h.category = f.category AND h.arrival <= sl.opens
  WHERE NOT list_contains(f.taken, h.sample_id) GROUP BY f.experiment, f.category, f.slot, f.taken),
drawn AS (SELECT experiment, category, slot, taken[-1] AS sample_id FROM f WHERE slot > 0)
"""

P1_SAMPLE = _LEDGER + "SELECT experiment, category, sample_id FROM drawn"

P1_LEDGER_GROWTH = _LEDGER + """
, span AS (SELECT epoch_us(min(ingested_at)) AS lo, epoch_us(max(ingested_at)) AS hi FROM manifest),
upto AS (SELECT category, d, count(*) FILTER (epoch_us(arrived) <= m) AS n FROM a CROSS JOIN (SELECT unnest([0, 1, 2]) AS d, unnest([lo + (hi - lo) // 10, lo + (hi - lo) // 2, hi]) AS m FROM span) GROUP BY category, d)
SELECT experiment, x.category, sample_id, min(d)::INTEGER AS drawn_by FROM drawn x JOIN sl USING (experiment, slot) JOIN upto u ON u.category = x.category AND u.n >= sl.opens GROUP BY ALL
"""

P2_FOUND = """
WITH r AS (SELECT sample_id, arg_min(dataset_version, ingested_at) AS dv, arg_min(category, ingested_at) AS category, lower(trim(arg_min(split, ingested_at))) AS split, arg_min(image_path, ingested_at) AS image_path,
  ltrim(replace(lower(arg_min(image_sha256, ingested_at)), '0x', ''), '0') AS sha, CAST('0x' || lpad(replace(lower(arg_min(perceptual_hash, ingested_at)), '0x', ''), 16, '0') AS UBIGINT) AS bits FROM manifest GROUP BY sample_id),
k AS (SELECT * FROM r WHERE split IN ('train', 'validation', 'test')),
g AS (SELECT DISTINCT image_path, list_transform(thumbnail, lambda x: x - floor(list_avg(thumbnail))) AS t FROM grouping_records WHERE len(thumbnail) = 1024),
m AS (SELECT k.*, t FROM k JOIN g USING (image_path) WHERE bits IS NOT NULL),
near AS (SELECT a.sample_id AS a, b.sample_id AS b, a.t AS ta, b.t AS tb, v.perceptual_max_normalized_mae AS mae FROM m a JOIN m b ON a.dv = b.dv AND a.category = b.category JOIN visa_config v ON v.dataset_version = a.dv
  WHERE a.split = 'train' AND b.split <> 'train' AND bit_count(xor(a.bits, b.bits)) <= v.perceptual_max_dhash_distance),
pairs AS (SELECT a, b FROM near WHERE list_sum(list_transform(list_zip(ta, tb), lambda z: abs(z[1] - z[2]))) / 1024.0::DOUBLE <= mae
  UNION SELECT a.sample_id, b.sample_id FROM k a JOIN k b ON a.sha = b.sha WHERE a.split = 'train' AND b.split <> 'train')
SELECT DISTINCT least(a, b) AS sample_id_a, greatest(a, b) AS sample_id_b FROM pairs
"""

P2_REPORT = P2_FOUND.replace("SELECT DISTINCT least(a, b) AS sample_id_a, greatest(a, b) AS sample_id_b FROM pairs", """
, files AS (SELECT DISTINCT a.sample_id AS a, b.sample_id AS b FROM k a JOIN k b ON a.sha = b.sha WHERE a.split = 'train' AND b.split <> 'train')
SELECT k.split, k.dv AS dataset_version, k.category, count(*) AS n_pairs, count(DISTINCT p.b) AS n_eval_records, count(f.a) AS n_same_file FROM (SELECT DISTINCT a, b FROM pairs) p JOIN k ON k.sample_id = p.b LEFT JOIN files f ON f.a = p.a AND f.b = p.b GROUP BY ALL""")

_NEAR = """
WITH v AS (SELECT DISTINCT patch_id, vec FROM patches JOIN memory_stats USING (category) WHERE len(vec) = projected_dimension AND list_bool_and(list_transform(vec, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(vec, lambda x: x <> 0))),
n AS (SELECT q.patch_id AS query_id, v.patch_id AS id, list_cosine_similarity(q.vec::DOUBLE[], v.vec::DOUBLE[]) AS cosine FROM v q JOIN v ON q.patch_id <> v.patch_id WHERE {asked}),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS place FROM n QUALIFY place <= 10)
"""

P3_FOUND = _NEAR.format(asked="q.patch_id IN (SELECT patch_id FROM probe_patches)") + "SELECT DISTINCT least(query_id, id) AS patch_a, greatest(query_id, id) AS patch_b FROM top"

_SOURCES = """
WITH s AS (SELECT experiment, model, category, sample_id, min(score) AS score FROM calibration_scores WHERE lower(trim(split)) = 'validation' AND lower(trim(label)) = 'normal' AND score IS NOT NULL AND isfinite(score) GROUP BY ALL),
n AS (SELECT s.*, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY experiment, model, category) AS n, image_threshold_quantile AS q FROM s JOIN experiment_settings e ON e.name = s.experiment WINDOW w AS (PARTITION BY experiment, model, category ORDER BY score)),
c AS (SELECT experiment, model, category, max(q) AS fraction, max(n) AS n_records, max(score) FILTER (place = ceil(q * (n - 1))) AS cutoff FROM n GROUP BY ALL)
"""

P5_FOUND = _SOURCES + "SELECT DISTINCT s.model, s.category, s.sample_id FROM s JOIN c USING (experiment, model, category) WHERE score > cutoff"
P5_CUTOFFS = _SOURCES + "SELECT experiment, model, category, max(fraction) AS fraction, max(n_records) AS n_records, max(cutoff) AS cutoff, count(*) FILTER (score <= cutoff) AS n_kept FROM s JOIN c USING (experiment, model, category) GROUP BY ALL"

_PASSAGES = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(nfc_normalize(text), '[\x{00AD}\x{200B}\x{200C}\x{200D}\x{FEFF}]', '', 'g')), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(regexp_replace(nfc_normalize(text), '[\x{00AD}\x{200B}\x{200C}\x{200D}\x{FEFF}]', '', 'g')), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
iw AS (SELECT item_id, least(12, len(w)) AS size, unnest(list_transform(range(1, len(w) - least(12, len(w)) + 2), lambda k: array_to_string(w[k:k + least(12, len(w)) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda k: array_to_string(w[k:k + size - 1], ' '))) AS g FROM d CROSS JOIN sizes WHERE len(w) >= size),
found AS (SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (size, g))
"""

P7_FOUND = _PASSAGES + "SELECT doc_id, item_id FROM found"
P7_ITEMS = _PASSAGES + "SELECT suite, e.item_id, count(f.doc_id) AS n_documents FROM (SELECT item_id, min(suite) AS suite FROM eval_items GROUP BY item_id) e LEFT JOIN found f USING (item_id) GROUP BY ALL"

P8_STATISTICS = r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\x{00AD}\x{200B}\x{200C}\x{200D}\x{FEFF}]', '', 'g'), '</?[A-Za-z][^<>]{0,500}>', ' ', 'g'), '\*\*|__|``?|~~', '', 'g') AS x FROM documents),
s AS (SELECT k, doc_id, x, regexp_replace(x, '[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]', '', 'g') AS solid, regexp_extract_all(regexp_replace(lower(x), '([\x{3040}-\x{30FF}\x{3400}-\x{9FFF}])', ' \1 ', 'g'), '\p{L}+') AS w,
  list_filter(regexp_split_to_array(x, '[\n\r\x{85}\x{2028}\x{2029}]'), lambda l: regexp_matches(l, '[^\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]')) AS lines FROM t),
c AS (SELECT list(DISTINCT lower(word)) AS common FROM common_words)
SELECT doc_id, len(w) AS n_words, round(list_sum(list_transform(w, lambda a: length(a)))::DOUBLE / nullif(len(w), 0), 6) AS mean_word_length,
  round(length(regexp_replace(solid, '[\p{L}\p{Nd}²³¹]', '', 'g'))::DOUBLE / nullif(length(solid), 0), 6) AS symbol_ratio, round(length(regexp_replace(solid, '[^\p{Nd}²³¹]', '', 'g'))::DOUBLE / nullif(length(solid), 0), 6) AS digit_ratio,
  round(len(list_filter(lines, lambda l: regexp_matches(l, '[.!?…。！？:;]["''”’»)\]*」]*[\s\p{Z}]*$')))::DOUBLE / nullif(len(lines), 0), 6) AS punctuated_lines,
  round(len(list_filter(w, lambda a: list_contains(common, a)))::DOUBLE / nullif(len(w), 0), 6) AS common_share, round(len(w)::DOUBLE / nullif(len(lines), 0), 6) AS words_per_line
FROM s CROSS JOIN c
"""

ORACLES = {
    "p8_statistics": P8_STATISTICS,
    "p1_sample": P1_SAMPLE,
    "p1_ledger_growth": P1_LEDGER_GROWTH,
    "p2_found": P2_FOUND,
    "p2_report": P2_REPORT,
    "p3_found": P3_FOUND,
    "p5_found": P5_FOUND,
    "p5_cutoffs": P5_CUTOFFS,
    "p7_found": P7_FOUND,
    "p7_items": P7_ITEMS,
}
