"""Queries over manifests, duplicates, splits, vectors and grids, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normspark.functions import ordered, predicates
from normspark.functions.hashing import sample_id as make_sample_id
from normspark.functions.hashing import stable_bucket as bucket_of
from normspark.operators import duplicates, gates, grids, neighbours, relations, splits
from normspark.session import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- manifests, ids and contracts

_RECORDS = """
WITH records AS (SELECT sample_id, arg_min(category, ingested_at) AS category, arg_min(dataset_version, ingested_at) AS dataset_version, lower(trim(arg_min(split, ingested_at))) AS split,
  arg_min(source_split, ingested_at) AS source_split, arg_min(label, ingested_at) AS label, arg_min(image_path, ingested_at) AS image_path, lower(arg_min(image_sha256, ingested_at)) AS sha FROM manifest GROUP BY sample_id)
"""


def records(s: SparkSession, d: str) -> DataFrame:
    """Each manifest record once, with its earliest delivery's values."""
    names = ["category", "dataset_version", "split", "source_split", "label", "image_path", "image_sha256"]
    first = table(s, d, "manifest").groupBy("sample_id").agg(*(F.min_by(c, "ingested_at").alias(c) for c in names))
    return first.withColumns({"split": F.lower(F.trim("split")), "sha": F.lower("image_sha256")}).drop("image_sha256")


@query("SELECT category, image_path, substr(sha256(category || chr(0) || image_path), 1, 24) AS made_id FROM (SELECT DISTINCT category, image_path FROM manifest WHERE category IS NOT NULL AND image_path IS NOT NULL)")
def sample_id(s, d):
    rows = table(s, d, "manifest").where("category IS NOT NULL AND image_path IS NOT NULL").select("category", "image_path").distinct()
    return rows.withColumn("made_id", make_sample_id("category", "image_path"))


@query("SELECT event_id, CAST(CAST('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 16) AS UBIGINT) % 7 AS INTEGER) AS bucket FROM events")
def stable_bucket(s, d):
    return table(s, d, "events").select("event_id", bucket_of("event_id", 7).alias("bucket"))


@query(
    "SELECT image_path, NOT regexp_matches(image_path, '[\\\\:]') AND len(list_filter(string_split(image_path, '/'), lambda p: p IN ('', '.', '..'))) = 0 AS safe FROM (SELECT DISTINCT image_path FROM grouping_records)"
)
def safe_path(s, d):
    return table(s, d, "grouping_records").select("image_path").distinct().withColumn("safe", predicates.safe_path(F.col("image_path")))


@query("SELECT c_custkey, regexp_matches(c_name, '^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$') AS raw_ok, regexp_matches(replace(c_name, '#', '-'), '^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$') AS ok FROM customer")
def identifier_check(s, d):
    c = F.col("c_name")
    return table(s, d, "customer").select("c_custkey", predicates.identifier_ok(c).alias("raw_ok"), predicates.identifier_ok(F.regexp_replace(c, "#", "-")).alias("ok"))


@query("SELECT image_path, regexp_extract(image_path, '([^/]*)$', 1) AS name FROM (SELECT DISTINCT image_path FROM grouping_records)")
def upload_name(s, d):
    return table(s, d, "grouping_records").select("image_path").distinct().withColumn("name", predicates.upload_name(F.col("image_path")))


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS text, o_orderdate <= TIMESTAMP '1999-01-01' AS ok FROM orders"
)
def timestamp_contract(s, d):
    text = F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(s, d, "orders").select("o_orderkey", text.alias("text"), predicates.timestamp_ok(text, F.lit("1999-01-01T00:00:00Z").cast("timestamp")).alias("ok"))


@query(_RECORDS + ", n AS (SELECT split, label, category, count(*) AS n FROM records GROUP BY ALL), s(split) AS (VALUES ('train'), ('validation'), ('test')), l(label) AS (VALUES ('normal'), ('anomaly')), c AS (SELECT DISTINCT category FROM memory_stats)"
    " SELECT split, label, category, coalesce(n, 0) AS n_rows FROM s CROSS JOIN l CROSS JOIN c LEFT JOIN n USING (split, label, category)")
def nested_counts(s, d):
    categories = [r[0] for r in table(s, d, "memory_stats").select("category").distinct().collect()]  # a fixed dimension
    return relations.nested_counts(records(s, d), {"split": ["train", "validation", "test"], "label": ["normal", "anomaly"], "category": categories})


@query(_RECORDS + " SELECT category, split, image_path, row_number() OVER (PARTITION BY category ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 WHEN 'test' THEN 2 END, image_path, sample_id) AS place FROM records WHERE split IN ('train', 'validation', 'test')")
def canonical_order(s, d):
    """Every record's place in its category."""
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1).when(F.col("split") == "test", 2)
    rows = records(s, d).where(rank.isNotNull()).select("sample_id", "category", "split", "image_path", rank.alias("_rank"))
    return ordered.places(rows, ["category"], ["_rank", "image_path", "sample_id"]).select("category", "split", "image_path", "place")


@query(_RECORDS + " SELECT category, split, label, image_path FROM records WHERE split IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category, split, label ORDER BY image_path) <= 3")
def stratified_head(s, d):
    return splits.stratified_head(records(s, d).where("split IS NOT NULL"), ["category", "split", "label"], ["image_path"], 3).select("category", "split", "label", "image_path")


@query("SELECT 'missing' AS side, image_path FROM (SELECT DISTINCT image_path FROM manifest EXCEPT SELECT image_path FROM grouping_records) UNION ALL SELECT 'unexpected', image_path FROM (SELECT DISTINCT image_path FROM grouping_records EXCEPT SELECT image_path FROM manifest)")
def inventory_diff(s, d):
    return relations.inventory_difference(table(s, d, "manifest"), table(s, d, "grouping_records"), "image_path").select("side", "image_path")


@query("SELECT sample_id, count(DISTINCT lower(trim(split))) AS n_splits, count(*) AS n_rows FROM manifest WHERE sample_id IS NOT NULL GROUP BY sample_id HAVING count(*) > 1 OR count(DISTINCT lower(trim(split))) > 1")
def leakage_check(s, d):
    return relations.leakage(table(s, d, "manifest").withColumn("split", F.lower(F.trim("split"))), "sample_id", "split")


@query("WITH e AS (SELECT DISTINCT c.model, m.sample_id FROM (SELECT DISTINCT model FROM calibration_scores) c CROSS JOIN manifest m WHERE label = 'normal' AND lower(trim(split)) = 'validation'), a AS (SELECT model, sample_id, count(*) AS n FROM calibration_scores WHERE split = 'validation' GROUP BY ALL)"
    " SELECT CASE WHEN e.sample_id IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' ELSE 'duplicate' END AS problem, coalesce(e.model, a.model) AS model, coalesce(e.sample_id, a.sample_id) AS sample_id, coalesce(n, 0) AS n_actual FROM e FULL JOIN a ON e.model = a.model AND e.sample_id = a.sample_id WHERE e.sample_id IS NULL OR n IS NULL OR n > 1")
def coverage_check(s, d):
    """Every model scores every normal validation record, once."""
    scores = table(s, d, "calibration_scores").where("split = 'validation'")
    models = [r[0] for r in table(s, d, "calibration_scores").where("model IS NOT NULL").select("model").distinct().collect()]  # a fixed dimension
    expected = table(s, d, "manifest").where("label = 'normal' AND lower(trim(split)) = 'validation'").select("sample_id", F.explode(F.array(*(F.lit(m) for m in models))).alias("model"))
    return relations.coverage_gaps(expected, scores, ["model", "sample_id"])


@query(_RECORDS + ", g AS (SELECT DISTINCT image_path, label, source_split FROM grouping_records) SELECT coalesce(r.image_path, g.image_path) AS image_path, CASE WHEN g.image_path IS NULL THEN 'only_old' WHEN r.image_path IS NULL THEN 'only_new' ELSE 'different' END AS problem"
    " FROM records r FULL JOIN g ON r.image_path = g.image_path WHERE g.image_path IS NULL OR r.image_path IS NULL OR r.label IS DISTINCT FROM g.label OR r.source_split IS DISTINCT FROM g.source_split")
def paired_alignment(s, d):
    new = table(s, d, "grouping_records").select("image_path", "label", "source_split").distinct()
    return relations.paired_alignment(records(s, d), new, "image_path", ["label", "source_split"])


@query(_RECORDS + " SELECT c.model, c.sample_id, r.image_path, r.sample_id IS NULL AS missing FROM (SELECT DISTINCT model, sample_id FROM calibration_scores) c LEFT JOIN records r USING (sample_id)")
def decision_lookup(s, d):
    scores = table(s, d, "calibration_scores").select("model", "sample_id").distinct()
    return relations.lookup(scores, records(s, d), ["sample_id"], ["image_path"]).select("model", "sample_id", "image_path", "missing")


@query(_RECORDS + " SELECT sample_id, category FROM records r WHERE split = 'validation' AND EXISTS (SELECT 1 FROM calibration_scores c WHERE c.sample_id = r.sample_id AND c.category = r.category)")
def semi_subset(s, d):
    return records(s, d).where("split = 'validation'").join(table(s, d, "calibration_scores"), ["sample_id", "category"], "left_semi").select("sample_id", "category")


_CAPTURES = "WITH c AS (SELECT o_orderkey, o_orderpriority, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS nation, o_totalprice, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey)"


def _captures(s: SparkSession, d: str) -> DataFrame:
    joined = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", "o_orderpriority", "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"), "o_totalprice", "c_custkey")


@query(_CAPTURES + " SELECT CASE WHEN grouping(o_orderpriority) = 0 THEN 'o_orderpriority' WHEN grouping(c_mktsegment) = 0 THEN 'c_mktsegment' ELSE 'nation' END AS dimension, coalesce(o_orderpriority, c_mktsegment, nation) AS value, count(*) AS n_rows, round(avg(o_totalprice), 3) AS mean_price"
    " FROM c GROUP BY GROUPING SETS ((o_orderpriority), (c_mktsegment), (nation))")
def group_metrics_sets(s, d):
    return relations.group_tables(_captures(s, d), ["o_orderpriority", "c_mktsegment", "nation"], [F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("o_totalprice"), 3).alias("mean_price")])


@query(_CAPTURES + " SELECT c_mktsegment, count(*) AS n_rows, count(DISTINCT c_custkey) AS n_objects, count(DISTINCT nation) AS n_sessions, round(avg((o_totalprice > 200000)::INT), 6) AS rate_all, round(avg((o_totalprice > 200000)::INT) FILTER (o_orderpriority <> '5-LOW'), 6) AS rate_evaluated, round(quantile_cont(o_totalprice, 0.5), 3) AS median FROM c GROUP BY c_mktsegment")
def study_rates(s, d):
    high = (F.col("o_totalprice") > 200000).cast("double")
    return _captures(s, d).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("c_custkey").alias("n_objects"), F.countDistinct("nation").alias("n_sessions"), F.round(F.avg(high), 6).alias("rate_all"),
        F.round(F.avg(F.when(F.col("o_orderpriority") != "5-LOW", high)), 6).alias("rate_evaluated"), F.round(F.percentile("o_totalprice", 0.5), 3).alias("median"),
    )


@query("SELECT category, sha256(string_agg(sample_id, '' ORDER BY sample_id)) AS digest FROM (SELECT DISTINCT category, sample_id FROM manifest) GROUP BY category")
def ordered_digest(s, d):
    """The ids of a category go into one digest, so they are one row by definition."""
    rows = table(s, d, "manifest").select("category", "sample_id").distinct()
    return rows.groupBy("category").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sample_id")), ""), 256).alias("digest"))


@query("SELECT category, max(raw_candidate_bytes)::BIGINT AS raw_bytes, sum(bank_bytes + projection_bytes)::BIGINT AS artifact_bytes, sum(selected_count::BIGINT * projected_dimension * 784)::BIGINT AS multiply_adds FROM memory_stats GROUP BY category")
def footprint(s, d):
    return table(s, d, "memory_stats").groupBy("category").agg(
        F.max("raw_candidate_bytes").alias("raw_bytes"), F.sum(F.col("bank_bytes") + F.col("projection_bytes")).alias("artifact_bytes"),
        F.sum(F.col("selected_count").cast("long") * F.col("projected_dimension") * 784).alias("multiply_adds"),
    )


# --- splits


@query(_RECORDS + ", t AS (SELECT category, image_path, sha256('7' || chr(0) || category || chr(0) || image_path) AS h, count(*) OVER (PARTITION BY category) AS n FROM records WHERE split = 'train' AND category IS NOT NULL AND image_path IS NOT NULL)"
    " SELECT category, image_path, CASE WHEN row_number() OVER (PARTITION BY category ORDER BY h) <= greatest(1, least(n - 1, floor(n * 0.18::DOUBLE + 0.5))) THEN 'validation' ELSE 'train' END AS assigned FROM t")
def hash_split(s, d):
    rows = records(s, d).where("split = 'train' AND category IS NOT NULL AND image_path IS NOT NULL").select("category", "image_path")
    return splits.hash_split(rows, "category", "image_path", 7, 0.18)


@query("SELECT category, sample_id FROM (SELECT DISTINCT category, sample_id FROM manifest) QUALIFY row_number() OVER (PARTITION BY category ORDER BY sha256('11:' || sample_id)) <= 10")
def budget_partition(s, d):
    return splits.budget(table(s, d, "manifest").select("category", "sample_id").distinct(), ["category"], "sample_id", 11, 10)


_GROUPS = "WITH RECURSIVE g AS (SELECT lang, source, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL)"


def _groups(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query(_GROUPS + """
, o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('5' || chr(0) || lang || chr(0) || source)) AS i, count(*) OVER (PARTITION BY lang) AS m,
    greatest(1, least(sum(n) OVER (PARTITION BY lang) - 1, floor(sum(n) OVER (PARTITION BY lang) * 0.2::DOUBLE + 0.5))) AS target FROM g),
f AS (SELECT lang, 0::BIGINT AS i, 0::DOUBLE AS k, false AS took, false AS some FROM (SELECT DISTINCT lang FROM g)
  UNION ALL SELECT f.lang, o.i, CASE WHEN NOT f.some OR abs(o.target - f.k - o.n) <= abs(o.target - f.k) THEN f.k + o.n ELSE f.k END,
    NOT f.some OR abs(o.target - f.k - o.n) <= abs(o.target - f.k), f.some OR NOT f.some OR abs(o.target - f.k - o.n) <= abs(o.target - f.k)
  FROM f JOIN o ON o.lang = f.lang AND o.i = f.i + 1 WHERE o.i < o.m)
SELECT o.lang, o.source, CASE WHEN f.took THEN 'validation' ELSE 'train' END AS assigned FROM o LEFT JOIN f ON o.lang = f.lang AND o.i = f.i""")
def grouped_greedy_split(s, d):
    return splits.greedy_split(_groups(s, d), "lang", "source", "n", 5, 0.2)


@query(_GROUPS + ", o AS (SELECT *, sha256('5:' || lang || ':' || source) AS h, sum(n) OVER (PARTITION BY lang) AS total FROM g)"
    " SELECT lang, source, CASE WHEN coalesce(sum(n) OVER (PARTITION BY lang ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < round_even(total * 0.2::DOUBLE, 0) AND lead(source) OVER (PARTITION BY lang ORDER BY h) IS NOT NULL THEN 'validation' ELSE 'train' END AS assigned FROM o")
def cumulative_split(s, d):
    return splits.cumulative_split(_groups(s, d), "lang", "source", "n", 5, 0.2)


# --- duplicates


@query("SELECT sha256(text) AS digest, count(*) AS n_rows, min(doc_id) AS first_key FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(s, d):
    return duplicates.exact_groups(table(s, d, "documents").withColumn("digest", F.sha2("text", 256)), "digest", "doc_id")


_HASHES = """
WITH RECURSIVE h AS (SELECT sample_id, arg_min(dataset_version, ingested_at) AS dv, arg_min(category, ingested_at) AS category, lower(trim(arg_min(split, ingested_at))) AS split, arg_min(image_path, ingested_at) AS image_path,
   CAST('0x' || lpad(replace(lower(arg_min(perceptual_hash, ingested_at)), '0x', ''), 16, '0') AS UBIGINT) AS bits FROM manifest WHERE perceptual_hash IS NOT NULL GROUP BY sample_id),
g AS (SELECT DISTINCT image_path, list_transform(thumbnail, lambda x: x - floor(list_avg(thumbnail))) AS t FROM grouping_records WHERE len(thumbnail) = 1024),
k AS (SELECT h.*, t, perceptual_max_dhash_distance AS d, perceptual_max_normalized_mae AS mae FROM h JOIN g USING (image_path) JOIN visa_config v ON v.dataset_version = dv WHERE category IS NOT NULL),
near AS (SELECT a.sample_id AS key_a, b.sample_id AS key_b, CAST(bit_count(xor(a.bits, b.bits)) AS INTEGER) AS distance, a.t AS ta, b.t AS tb, a.mae AS mae FROM k a JOIN k b ON a.dv = b.dv AND a.category = b.category AND a.sample_id < b.sample_id
  WHERE bit_count(xor(a.bits, b.bits)) <= a.d AND len(list_filter([0, 16, 32, 48], lambda i: ((a.bits >> i::UBIGINT) & 65535::UBIGINT) = ((b.bits >> i::UBIGINT) & 65535::UBIGINT))) > 0),
pairs AS (SELECT DISTINCT key_a, key_b, distance FROM near WHERE list_sum(list_transform(list_zip(ta, tb), lambda z: abs(z[1] - z[2]))) / 1024.0::DOUBLE <= mae)
"""


def _hashes(s: SparkSession, d: str) -> DataFrame:
    names = ["dataset_version", "category", "split", "image_path", "perceptual_hash"]
    first = table(s, d, "manifest").where("perceptual_hash IS NOT NULL").groupBy("sample_id").agg(*(F.min_by(c, "ingested_at").alias(c) for c in names))
    bits = F.conv(F.regexp_replace(F.lower("perceptual_hash"), "^0x", ""), 16, -10).cast("long")
    return first.select("sample_id", "dataset_version", "category", F.lower(F.trim("split")).alias("split"), "image_path", bits.alias("bits"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs that look the same under the limits of their dataset_version."""
    return duplicates.near_duplicates(_hashes(s, d), table(s, d, "grouping_records"), table(s, d, "visa_config"))


@query(_HASHES + "SELECT * FROM pairs")
def banded_near_dup(s, d):
    return _pairs(s, d)


@query(_HASHES + ", links AS (SELECT key_a AS a, key_b AS b FROM pairs UNION SELECT key_b, key_a FROM pairs), reach(node, other) AS (SELECT a, a FROM links UNION SELECT a, b FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other) SELECT node, min(other) AS component FROM reach GROUP BY node")
def components(s, d):
    return duplicates.components(_pairs(s, d))


@query(_HASHES + " SELECT key_a, key_b, distance, a.split AS split_a, b.split AS split_b FROM pairs JOIN h a ON key_a = a.sample_id JOIN h b ON key_b = b.sample_id WHERE a.split <> b.split")
def cross_split_duplicates(s, d):
    return duplicates.cross_boundary(_pairs(s, d), _hashes(s, d), "sample_id", "split")


# --- vectors

_VECTORS = "WITH v AS (SELECT vec_id, label, embedding, sha256('3:' || vec_id) AS h FROM embeddings), b AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY h, vec_id) - 1 AS slot, embedding, vec_id AS source FROM v QUALIFY slot < 20)"
_DISTANCE = "round(sqrt(min(list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))))), 6) AS score"


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings")


def _bank(s: SparkSession, d: str) -> DataFrame:
    return neighbours.random_bank(_vectors(s, d), "label", "vec_id", "embedding", 20, 3)


@query(_VECTORS + " SELECT label, slot::INTEGER AS slot, source FROM b")
def random_bank(s, d):
    return _bank(s, d).select("label", "slot", "source")


@query(_VECTORS + f" SELECT q.vec_id, q.label, {_DISTANCE} FROM v q JOIN b USING (label) GROUP BY q.vec_id, q.label")
def nn_score(s, d):
    return rounded(neighbours.nearest_score(_vectors(s, d), _bank(s, d), "label", "vec_id", "embedding"), ["score"])


@query(_VECTORS + f" SELECT q.vec_id, q.label, {_DISTANCE} FROM v q JOIN b ON q.label <> b.label WHERE slot < 5 GROUP BY q.vec_id, q.label")
def leave_one_out_nn(s, d):
    bank = neighbours.unified_bank(_bank(s, d), 5)
    return rounded(neighbours.nearest_score(_vectors(s, d), bank, "label", "vec_id", "embedding", own=False), ["score"])


@query(_VECTORS + " SELECT label, slot::INTEGER AS slot, source FROM b WHERE slot < 4")
def unified_bank(s, d):
    return neighbours.unified_bank(_bank(s, d), 4).select("label", "slot", "source")


@query(_VECTORS + f", s AS (SELECT q.vec_id, q.label, {_DISTANCE} FROM v q JOIN b USING (label) GROUP BY q.vec_id, q.label) SELECT label, count(*) AS candidate_count, max(score) AS coverage_radius FROM s GROUP BY label")
def coverage_radius(s, d):
    return rounded(neighbours.coverage_radius(_vectors(s, d), _bank(s, d), "label", "vec_id", "embedding"), ["coverage_radius"])


@query(_VECTORS + ", m AS (SELECT label, i, avg(x::DOUBLE) AS m, CASE WHEN stddev_pop(x::DOUBLE) > 0 THEN stddev_pop(x::DOUBLE) ELSE 1 END AS s FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM v) GROUP BY ALL),"
    " z AS (SELECT vec_id, v.label, list((v.embedding[i] - m.m) / m.s ORDER BY i) AS embedding FROM v JOIN m ON m.label = v.label GROUP BY ALL)"
    f" SELECT q.vec_id, q.label, {_DISTANCE} FROM z q JOIN z b ON b.label = q.label AND b.vec_id IN (SELECT source FROM b) GROUP BY q.vec_id, q.label")
def standardized_nn(s, d):
    return rounded(neighbours.standardized_score(_vectors(s, d), _vectors(s, d), _bank(s, d), "label", "vec_id", "embedding"), ["score"])


@query()
def kcenter(s, d):
    return neighbours.k_center(_vectors(s, d), "label", "vec_id", "embedding", 8, 4_096, 3).select("label", "slot", "source", F.round("radius", 6).alias("radius"))


# --- grids: each order is a frame of 16 x 16 pixels filled by its line items

_GRID = """
WITH RECURSIVE pix AS (SELECT l_orderkey AS image, (l_partkey % 16)::INTEGER AS y, (l_suppkey % 16)::INTEGER AS x, max(l_extendedprice) AS score, max(l_quantity) > 40 AS mask, max(l_discount) > 0.05 AS support, min(l_tax) AS other FROM lineitem GROUP BY ALL)
"""


def _labels(connectivity: int) -> str:
    """SQL: ``lab``, the connected components of the mask of ``pix``, numbered in reading order."""
    near = "abs(a.y - b.y) + abs(a.x - b.x) = 1" if connectivity == 4 else "greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1"
    return f"""
, m AS (SELECT image, y, x FROM pix WHERE mask), e AS (SELECT a.image, a.y, a.x, b.y AS ty, b.x AS tx FROM m a JOIN m b ON a.image = b.image WHERE {near}),
r(image, y, x, ty, tx) AS (SELECT image, y, x, y, x FROM m UNION SELECT r.image, r.y, r.x, e.ty, e.tx FROM r JOIN e ON e.image = r.image AND e.y = r.ty AND e.x = r.tx),
lab AS (SELECT image, y, x, dense_rank() OVER (PARTITION BY image ORDER BY first)::INTEGER AS region_id FROM (SELECT image, y, x, min(ty * 16 + tx) AS first FROM r GROUP BY ALL))
"""


def _grid(s: SparkSession, d: str) -> DataFrame:
    """Pixels of one frame per order."""
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("image"), (F.col("l_partkey") % 16).cast("int").alias("y"), (F.col("l_suppkey") % 16).cast("int").alias("x")).agg(
        F.max("l_extendedprice").alias("score"), (F.max("l_quantity") > 40).alias("mask"), (F.max("l_discount") > 0.05).alias("support"), F.min("l_tax").alias("other")
    )


@query(_GRID + ", r AS (SELECT *, count(*) OVER (PARTITION BY image) AS n, row_number() OVER (PARTITION BY image ORDER BY score DESC, y, x) AS r FROM pix) SELECT image, round(avg(score), 3) AS image_score, count(*) AS n_pixels FROM r WHERE r <= greatest(1, ceil(n * 0.01::DOUBLE)) GROUP BY image")
def top_fraction_mean(s, d):
    return rounded(grids.top_fraction_mean(_grid(s, d), ["image"], "score", 0.01, ["y", "x"]), ["image_score"], 3)


@query(_GRID + ", r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, y, x) AS a, row_number() OVER (PARTITION BY image ORDER BY other DESC, y, x) AS b FROM pix) SELECT image, round(count(*) FILTER (a <= 10 AND b <= 10)::DOUBLE / count(*) FILTER (a <= 10 OR b <= 10), 6) AS iou FROM r GROUP BY image")
def topk_support_iou(s, d):
    return rounded(grids.top_support_iou(_grid(s, d), ["image"], "score", "other", 10, ["y", "x"]), ["iou"])


_MASKS = _GRID + """
, m AS (SELECT image, CASE WHEN image % 3 = 0 THEN 'normal' ELSE 'anomaly' END AS label, count(*) FILTER (mask) AS mask_pixels, count(*) FILTER (support) AS support_pixels, count(*) FILTER (mask AND support) AS intersection, count(*) FILTER (mask OR support) AS un, count(*) AS n_pixels FROM pix GROUP BY ALL),
mm AS (SELECT *, label = 'anomaly' AND mask_pixels > 0 AS v FROM m),
measured AS (SELECT image, label, mask_pixels, support_pixels, intersection, un AS "union", n_pixels,
  round(CASE WHEN v THEN coalesce(intersection::DOUBLE / nullif(un, 0), 0) END, 6) AS foreground_iou, round(CASE WHEN v THEN coalesce(2.0::DOUBLE * intersection / nullif(mask_pixels + support_pixels, 0), 0) END, 6) AS foreground_dice,
  round(CASE WHEN v THEN coalesce(intersection::DOUBLE / nullif(support_pixels, 0), 0) END, 6) AS foreground_precision, round(CASE WHEN v THEN coalesce(intersection::DOUBLE / nullif(mask_pixels, 0), 0) END, 6) AS foreground_recall,
  round(coalesce(intersection::DOUBLE / nullif(un, 0), 1), 6) AS all_image_iou FROM mm)
"""
_MEASURED = ["foreground_iou", "foreground_dice", "foreground_precision", "foreground_recall", "all_image_iou"]


def _measured(s: SparkSession, d: str) -> DataFrame:
    labelled = _grid(s, d).withColumn("label", F.when(F.col("image") % 3 == 0, "normal").otherwise("anomaly"))
    return rounded(grids.mask_measurements(labelled, "image", "label", "mask", "support"), _MEASURED)


@query(_MASKS + "SELECT * FROM measured")
def mask_measurements(s, d):
    return _measured(s, d)


@query(_MASKS + "SELECT image % 5 AS grp, count(*) AS n_images, count(foreground_iou) AS n_visible, round(avg(foreground_iou), 5) AS foreground_iou, round(avg(foreground_dice), 5) AS foreground_dice, round(avg(foreground_recall), 5) AS foreground_recall, round(sum(support_pixels) FILTER (label = 'normal')::DOUBLE / sum(n_pixels) FILTER (label = 'normal'), 5) AS normal_pixel_fpr, round(avg(all_image_iou), 5) AS all_image_iou FROM measured GROUP BY 1")
def localization_summary(s, d):
    out = grids.localization_summary(_measured(s, d).withColumn("grp", F.col("image") % 5), ["grp"], "label")
    return rounded(out, ["foreground_iou", "foreground_dice", "foreground_recall", "normal_pixel_fpr", "all_image_iou"], 5)


_REGIONS = _GRID + _labels(8) + ", reg AS (SELECT image, region_id, count(*) AS region_pixels, count(*) / 256.0::DOUBLE AS region_fraction, avg(support::INT) AS region_recall, (avg(support::INT) >= 0.1)::INTEGER AS region_hit FROM pix JOIN lab USING (image, y, x) GROUP BY ALL)"


def _regions(s: SparkSession, d: str) -> DataFrame:
    return grids.region_measurements(grids.labelled_pixels(_grid(s, d), ["image"], "mask"), ["image"], "region_id", "support", 256)


@query(_REGIONS + " SELECT image, region_id, region_pixels, round(region_fraction, 6) AS region_fraction, round(region_recall, 6) AS region_recall, region_hit FROM reg")
def region_measurements(s, d):
    return rounded(_regions(s, d), ["region_fraction", "region_recall"])


@query(_REGIONS + ", st AS (SELECT *, CASE WHEN region_fraction <= 0.01 THEN 'tiny' WHEN region_fraction <= 0.03 THEN 'small' ELSE 'large' END AS stratum FROM reg), ex AS (SELECT * EXCLUDE (stratum), unnest(CASE WHEN stratum = 'large' THEN ['large', 'all'] ELSE [stratum, 'small_inclusive', 'all'] END) AS stratum FROM st)"
    " SELECT stratum, count(*) AS n_regions, sum(region_hit)::BIGINT AS n_hits, count(DISTINCT image) AS n_images, round(avg(region_hit), 6) AS hit_rate, round(avg(region_recall), 6) AS mean_recall FROM ex GROUP BY stratum")
def overlapping_strata(s, d):
    return rounded(grids.overlapping_strata(grids.strata(_regions(s, d), 0.01, 0.03), [], "image"), ["hit_rate", "mean_recall"])


@query("WITH f AS (SELECT DISTINCT height, width FROM manifest WHERE height >= 448 AND width >= 448), t AS (SELECT height, width, unnest(list_distinct(list_concat(range(0, height - 448 + 1, 224), [height - 448]))) AS top FROM f) SELECT height, width, top::INTEGER AS top, unnest(list_distinct(list_concat(range(0, width - 448 + 1, 224), [width - 448])))::INTEGER AS \"left\" FROM t")
def tile_layout(s, d):
    return grids.tile_layout(table(s, d, "manifest").where("height >= 448 AND width >= 448").select("height", "width").distinct(), "height", "width", 448, 224)


@query(_GRID + ", w AS (SELECT image // 3 AS frame, (image % 3) * 8 AS top, 0 AS \"left\", y, x, score, (0.05 + 0.95 * pow(sin(pi() * (y + 0.5) / 16), 2)) * (0.05 + 0.95 * pow(sin(pi() * (x + 0.5) / 16), 2)) AS w FROM pix) SELECT frame, (top + y)::INTEGER AS frame_y, (\"left\" + x)::INTEGER AS frame_x, round(sum(w * score) / sum(w), 5) AS score FROM w GROUP BY 1, 2, 3")
def tile_blend(s, d):
    """Three orders with keys in a row are the overlapping tiles of one frame."""
    tiles = _grid(s, d).select(F.expr("image DIV 3").alias("frame"), (F.col("image") % 3 * 8).cast("int").alias("top"), F.lit(0).alias("left"), "y", "x", "score")
    return rounded(grids.tile_blend(tiles, ["frame"], 16), ["score"], 5)


@query(_GRID + ", c AS (SELECT y, x, median(score) AS center FROM pix GROUP BY ALL), a AS (SELECT y, x, center, median(abs(score - center)) * 1.4826 AS mad FROM pix JOIN c USING (y, x) GROUP BY ALL), fl AS (SELECT greatest(median(mad) * 0.1, 1e-5) AS f FROM a)"
    " SELECT image, p.y, p.x, round((score - center) / greatest(mad, f), 5) AS z FROM pix p JOIN a USING (y, x) CROSS JOIN fl")
def cell_zscore(s, d):
    pixels = _grid(s, d).withColumn("k", F.lit(0))
    return rounded(grids.cell_zscore(pixels, grids.cell_scale(pixels, ["k"], "score"), ["k"], "score").select("image", "y", "x", "z"), ["z"], 5)


_AUPRO = _GRID + _labels(4) + """
, q AS (SELECT image % 5 AS grp, image, region_id AS region, score::DOUBLE AS score FROM pix LEFT JOIN lab USING (image, y, x)), span AS (SELECT grp, max(score) AS hi, min(score) AS lo, count(*) FILTER (region IS NULL) AS total FROM q GROUP BY grp),
t AS (SELECT grp, i, total, (hi - lo) / 99.0::DOUBLE AS step, hi - i * ((hi - lo) / 99.0::DOUBLE) AS t FROM span, range(100) n(i)),
rs AS (SELECT grp, image, region, count(*) AS size FROM q WHERE region IS NOT NULL GROUP BY ALL), nr AS (SELECT grp, count(*) AS n FROM rs GROUP BY grp),
o AS (SELECT t.grp, t.i, sum(1.0::DOUBLE / size) / any_value(n) AS pro FROM t JOIN q ON q.grp = t.grp AND q.score > t.t + 1e-9 * t.step JOIN rs ON rs.grp = q.grp AND rs.image = q.image AND rs.region = q.region JOIN nr ON nr.grp = t.grp GROUP BY ALL),
bg AS (SELECT t.grp, t.i, count(*)::DOUBLE / any_value(t.total) AS fpr FROM t JOIN q ON q.grp = t.grp AND q.score > t.t + 1e-9 * t.step WHERE q.region IS NULL GROUP BY ALL),
cu AS (SELECT t.grp, coalesce(fpr, 0) AS fpr, coalesce(pro, 0) AS pro FROM t LEFT JOIN o ON o.grp = t.grp AND o.i = t.i LEFT JOIN bg ON bg.grp = t.grp AND bg.i = t.i),
c0 AS (SELECT grp, fpr, max(pro) AS pro FROM (SELECT * FROM cu UNION ALL SELECT grp, 0.0, 0.0 FROM span) WHERE fpr <= 0.3 GROUP BY ALL),
mono AS (SELECT grp, fpr, max(pro) OVER (PARTITION BY grp ORDER BY fpr) AS pro FROM c0), st AS (SELECT *, lag(fpr) OVER w AS pf, lag(pro) OVER w AS pp, lead(fpr) OVER w AS nf FROM mono WINDOW w AS (PARTITION BY grp ORDER BY fpr))
SELECT grp, round(sum(coalesce((fpr - pf) * (pro + pp) / 2, 0) + CASE WHEN nf IS NULL THEN (0.3 - fpr) * pro ELSE 0 END) / 0.3, 5) AS aupro FROM st GROUP BY grp
"""


@query(_AUPRO)
def aupro(s, d):
    pixels = grids.labelled_pixels(_grid(s, d), ["image"], "mask", 4).withColumn("grp", F.col("image") % 5)
    return rounded(grids.aupro(cut(pixels), ["grp"], "image", "region_id", "score"), ["aupro"], 5)


# --- frames: each supplier is a frame of 16 x 16 pixels, most of them filled

_FRAMES = """
WITH RECURSIVE pix AS (SELECT l_suppkey AS image, (l_partkey % 16)::INTEGER AS y, ((l_orderkey + l_linenumber) % 16)::INTEGER AS x, max(l_extendedprice)::DOUBLE AS score, max(l_quantity) > 48 AS mask, max(l_tax)::DOUBLE AS other FROM lineitem GROUP BY ALL)
"""


def _frames(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("image"), (F.col("l_partkey") % 16).cast("int").alias("y"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 16).cast("int").alias("x")).agg(
        F.max("l_extendedprice").cast("double").alias("score"), (F.max("l_quantity") > 48).alias("mask"), F.max("l_tax").cast("double").alias("other")
    )


@query(_FRAMES + _labels(8) + " SELECT image, y, x, region_id FROM lab")
def connected_regions(s, d):
    return grids.labelled_pixels(_frames(s, d), ["image"], "mask").where("region_id IS NOT NULL").select("image", "y", "x", "region_id")


@query(_FRAMES + _labels(4) + " SELECT image, y, x, region_id FROM lab")
def connected_regions_4(s, d):
    return grids.labelled_pixels(_frames(s, d), ["image"], "mask", 4).where("region_id IS NOT NULL").select("image", "y", "x", "region_id")


_SEEDED = _FRAMES.replace("pix AS", "raw AS") + """
, pix AS (SELECT image, y, x, score, true AS mask FROM raw c WHERE score > 50000 AND EXISTS (SELECT 1 FROM raw h WHERE h.image = c.image AND h.score > 85000 AND abs(h.y - c.y) <= 2 AND abs(h.x - c.x) <= 2))
""" + _labels(8) + " SELECT image, y, x, region_id FROM pix JOIN lab USING (image, y, x) WHERE (image, region_id) IN (SELECT (image, region_id) FROM pix JOIN lab USING (image, y, x) GROUP BY image, region_id HAVING max(score) > 85000 AND count(*) >= 4)"


@query(_SEEDED)
def hysteresis_regions(s, d):
    pixels = _frames(s, d).withColumns({"low": F.lit(50_000.0), "high": F.lit(85_000.0)})
    return grids.seeded_regions(pixels, ["image"], "score", "low", "high", 4, 2)


_PIXELS = _FRAMES + """
, q AS (SELECT image % 4 AS grp, image, mask, score FROM pix), iou AS (SELECT grp, image, coalesce(count(*) FILTER (mask AND score > 80000)::DOUBLE / nullif(count(*) FILTER (mask OR score > 80000), 0), 1) AS iou FROM q GROUP BY ALL),
per AS (SELECT grp, score, count(*) FILTER (mask) AS p, count(*) FILTER (NOT mask) AS n FROM q GROUP BY ALL),
cu AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY grp) AS bp, sum(n) OVER (PARTITION BY grp) AS bn FROM per WINDOW w AS (PARTITION BY grp ORDER BY score DESC)),
rk AS (SELECT grp, sum(n * (tp - p / 2.0::DOUBLE)) / (any_value(bp)::DOUBLE * any_value(bn)) AS auroc, sum(p * tp / (tp + fp)::DOUBLE) / any_value(bp) AS ap, (any_value(bp) + any_value(bn))::BIGINT AS c FROM cu GROUP BY grp)
SELECT grp, count(*) AS n_images, round(avg(iou), 6) AS pixel_iou_mean, round(any_value(auroc), 6) AS pixel_auroc, round(any_value(ap), 6) AS pixel_ap, any_value(c) AS pixel_count FROM iou JOIN rk USING (grp) GROUP BY grp
"""


@query(_PIXELS)
def pixel_metrics(s, d):
    pixels = _frames(s, d).withColumns({"grp": F.col("image") % 4, "threshold": F.lit(80_000.0)})
    return rounded(grids.pixel_metrics(pixels, ["grp"], "image", "mask", "score", "threshold"), ["pixel_iou_mean", "pixel_auroc", "pixel_ap"])


@query(_FRAMES + " SELECT image, round(CASE WHEN min(score) = max(score) OR min(other) = max(other) THEN min((score = other)::INT) ELSE corr(score, other) END, 6) AS correlation FROM pix GROUP BY image")
def map_correlation(s, d):
    return rounded(grids.map_correlation(_frames(s, d), ["image"], "score", "other"), ["correlation"])


# --- capture-quality gate on document measurements

_GATE = """
WITH m AS (SELECT doc_id, source AS category, (CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS UBIGINT) % 3)::INTEGER AS role, unnest(['chars', 'words', 'digits']) AS metric,
  unnest([length(text)::DOUBLE, len(string_split(text, ' '))::DOUBLE, length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE]) AS value FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
c AS (SELECT category, metric, median(value) AS center, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349 AS iqr, count(*) AS n_rows FROM m WHERE role = 0 GROUP BY ALL HAVING count(*) >= 16),
fit AS (SELECT m.category, m.metric, n_rows, center, greatest(median(abs(value - center)) * 1.4826, iqr, 1e-5) AS scale FROM m JOIN c USING (category, metric) WHERE role = 0 GROUP BY m.category, m.metric, n_rows, center, iqr),
dev AS (SELECT doc_id, category, role, metric, CASE metric WHEN 'chars' THEN abs((value - center) / scale) WHEN 'words' THEN greatest(-(value - center) / scale, 0) ELSE greatest((value - center) / scale, 0) END AS deviation FROM m JOIN fit USING (category, metric)),
q AS (SELECT doc_id, category, role, max(deviation) AS quality_score, list(metric ORDER BY deviation DESC, metric)[1:2] AS contributors FROM dev GROUP BY ALL)
"""


def _measurements(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("text IS NOT NULL AND source IS NOT NULL")
    values = {"chars": F.length("text"), "words": F.size(F.split("text", " ")), "digits": F.length(F.regexp_replace("text", "[^0-9]", ""))}
    entries = F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()))
    return docs.select("doc_id", F.col("source").alias("category"), bucket_of("doc_id", 3).alias("role"), F.explode(entries).alias("e")).select("doc_id", "category", "role", "e.*")


def _gate(s: SparkSession, d: str) -> DataFrame:
    rows = _measurements(s, d)
    directions = s.createDataFrame([("chars", "two_sided"), ("words", "lower"), ("digits", "upper")], "metric string, direction string")
    model = gates.robust_scale(rows.where("role = 0"), ["category", "metric"], "value")
    return gates.gate_scores(gates.deviations(rows, model, directions, "category"), ["doc_id", "category", "role"])


@query(_GATE + "SELECT category, metric, n_rows, round(center, 6) AS center, round(scale, 6) AS scale FROM fit")
def robust_location_scale(s, d):
    return rounded(gates.robust_scale(_measurements(s, d).where("role = 0"), ["category", "metric"], "value"), ["center", "scale"])


@query(_GATE + "SELECT doc_id, array_to_string(contributors, ',') AS contributors FROM q")
def top_contributors(s, d):
    return _gate(s, d).select("doc_id", F.array_join("contributors", ",").alias("contributors"))


@query(_GATE + ", p AS (SELECT t.doc_id, t.category, (1 + (SELECT count(*) FROM q c WHERE c.role = 1 AND c.category = t.category AND c.quality_score >= t.quality_score))::DOUBLE / nullif((SELECT nullif(count(*), 0) FROM q c WHERE c.role = 1 AND c.category = t.category) + 1, 0) AS quality_p FROM q t WHERE role = 2)"
    " SELECT doc_id, round(quality_p, 6) AS quality_p, CASE WHEN quality_p <= 0.05 THEN 'recapture' WHEN quality_p > 0.05 THEN 'accept' END AS quality_status FROM p")
def quality_gate(s, d):
    scores = cut(_gate(s, d))
    out = gates.evaluate_gate(scores.where("role = 2"), scores.where("role = 1"), "category", 0.05)
    return rounded(out.select("doc_id", "quality_p", "quality_status"), ["quality_p"])


_CELLS = """
WITH g AS (SELECT user_id % 12 AS category, event_type AS family, (event_type = 'error')::INT AS target, CASE WHEN value > 20 THEN 'anomalous' ELSE 'normal' END AS decision, event_id % 7 = 0 AS rejected FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL),
cells AS (SELECT category, family, count(*) AS n_rows, count(*) FILTER (rejected) AS n_rejected, count(*) FILTER ((target = 0) = (decision = 'anomalous')) AS n_wrong, count(*) FILTER (rejected AND (target = 0) = (decision = 'anomalous')) AS n_intercepted FROM g GROUP BY ALL)
"""


def _gated(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").where("value IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL").select(
        (F.col("user_id") % 12).alias("category"), F.col("event_type").alias("family"), (F.col("event_type") == "error").cast("int").alias("target"),
        F.when(F.col("value") > 20, "anomalous").otherwise("normal").alias("decision"), (F.col("event_id") % 7 == 0).alias("rejected"),
    )


def _cells(s: SparkSession, d: str) -> DataFrame:
    return gates.gate_aggregate(_gated(s, d), ["category", "family"])


@query(_CELLS + "SELECT * FROM cells")
def gate_aggregate(s, d):
    return _cells(s, d)


@query(_CELLS.replace("cells AS (SELECT category, family", "gg AS (SELECT 'v1' AS gate, * FROM g UNION ALL SELECT 'v2', * REPLACE (rejected AND target = 0 AS rejected) FROM g), cells AS (SELECT gate, family").replace("AS n_intercepted FROM g", "AS n_intercepted FROM gg") + "SELECT gate, family, n_rows, n_rejected, n_wrong, n_intercepted, round(n_rejected::DOUBLE / n_rows, 6) AS rejection_rate FROM cells")
def gate_comparison(s, d):
    """Two gates over the same captures; the intervals are compared in a test."""
    rows = _gated(s, d)
    both = rows.withColumn("gate", F.lit("v1")).unionByName(rows.withColumns({"gate": F.lit("v2"), "rejected": F.col("rejected") & (F.col("target") == 0)}))
    return rounded(gates.gate_comparison(both, "gate", ["family"]).drop("rejection_ci_low", "rejection_ci_high"), ["rejection_rate"])


@query(_CELLS + "SELECT family, sum(n_rows)::BIGINT AS n_rows, round(sum(n_rejected)::DOUBLE / sum(n_rows), 6) AS rejection_rate, round(sum(n_intercepted)::DOUBLE / nullif(sum(n_wrong), 0), 6) AS interception_rate FROM cells GROUP BY family")
def gate_macro(s, d):
    return rounded(gates.gate_macro(_cells(s, d), ["family"]), ["rejection_rate", "interception_rate"])


