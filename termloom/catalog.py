"""Queries over the driver's tables, one or more for each operator, with their DuckDB twins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import StorageError
from .functions import bytestr, validate
from .operators import completions, dictionary, search, shape
from .plans import api
from .plans.store import Store
from .schema import Config
from .sources import terms
from .streaming import ingest


def _work_dir(spark: SparkSession) -> str:
    """A folder of its own in the shared one. Where none is set, a local session gets a
    temporary one that goes with the process; on a cluster that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared}/store-{uuid.uuid4().hex}"
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise StorageError("spark.checkpoint.dir has to name a folder that the executors share")
    folder = tempfile.mkdtemp(prefix="termloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _docs(spark, d) -> DataFrame:
    return dictionary.from_terms(terms.document_terms(spark, d))


def _parts(spark, d) -> DataFrame:
    return dictionary.from_terms(terms.part_terms(spark, d))


DOC_TERMS = """WITH d AS (SELECT tenant, term, CAST(count(*) AS BIGINT) AS frequency FROM (
  SELECT lang AS tenant, unnest(regexp_split_to_array(text, '\\s+')) AS term FROM documents) WHERE term <> '' GROUP BY ALL)
"""
PART_TERMS = "WITH d AS (SELECT p_brand AS tenant, p_name AS term, CAST(count(*) AS BIGINT) AS frequency FROM part GROUP BY ALL)\n"
OPS = """WITH ops AS (SELECT event_id AS seq, 'u' || CAST(user_id % 5 AS VARCHAR) AS tenant, props AS term,
  CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'set' ELSE 'index' END AS op,
  CAST(floor(value) AS BIGINT) AS weight FROM events)
"""
FOLD = (
    OPS
    + """, marked AS (SELECT *, max(CASE WHEN op IN ('delete', 'set') THEN seq END) OVER (PARTITION BY tenant, term) AS last FROM ops),
d AS (SELECT tenant, term, CAST(sum(weight) AS BIGINT) AS frequency FROM marked
  WHERE op <> 'delete' AND seq >= coalesce(last, -1) GROUP BY tenant, term)
"""
)
STATS = """, o AS (SELECT tenant, encode(term) AS t, lag(encode(term)) OVER (PARTITION BY tenant ORDER BY term) AS p FROM d),
h AS (SELECT tenant, hex(t) AS t, hex(p) AS p FROM o),
l AS (SELECT tenant, t, 2 * len(list_filter(range(1, least(length(t), coalesce(length(p), 0)) // 2 + 1), lambda i: t[1:2 * i] = p[1:2 * i])) AS l FROM h),
n AS (SELECT tenant, CAST(count(DISTINCT s) AS BIGINT) AS nodes FROM (
  SELECT tenant, t AS s FROM l UNION ALL SELECT tenant, t[1:l] FROM l) WHERE s <> '' GROUP BY tenant)
SELECT tenant, any_value(nodes) AS nodes, CAST(count(*) AS BIGINT) AS terms, CAST(sum(length(t) - l) // 2 AS BIGINT) AS bytes
FROM l JOIN n USING (tenant) GROUP BY tenant"""


def _prefix(source, tenant: str, prefix: str, k: int):
    sql = DOC_TERMS if source is _docs else PART_TERMS
    written = prefix.replace("'", "''")
    return (
        lambda spark, d: search.prefix_topk(source(spark, d), tenant, prefix, k),
        f"{sql}SELECT term, frequency AS score FROM d WHERE tenant = '{tenant}' AND starts_with(term, '{written}') ORDER BY score DESC, term LIMIT {k}",
    )


def _fuzzy(tenant: str, query: str, edits: int, k: int):
    return (
        lambda spark, d: search.fuzzy_topk(_docs(spark, d), tenant, query, edits, k),
        f"""{DOC_TERMS}SELECT term, frequency AS score, CAST(levenshtein(term, '{query}') AS INTEGER) AS distance FROM d
WHERE tenant = '{tenant}' AND levenshtein(term, '{query}') <= {edits} ORDER BY score DESC, term LIMIT {k}""",
    )


def _requests_sql(typo: int, k: int) -> str:
    return f", r AS (SELECT item_id AS query_id, 'en' AS tenant, regexp_split_to_array(text, '\\s+')[1] AS query, {k} AS k, {typo} AS typo FROM benchmark)\n"


def _members(spark, d) -> DataFrame:
    wanted = terms.benchmark_requests(spark, d).select("tenant", F.col("query").alias("term")).distinct()
    return search.members(_docs(spark, d), wanted)


def _distances(spark, d) -> DataFrame:
    """Each item's first word and its second one."""
    words = F.split("text", "\\s+")
    pairs = terms.table(spark, d, "benchmark").select(
        "item_id", F.coalesce(F.get(words, F.lit(0)), F.lit("")).alias("query"), F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("other")
    )
    return pairs.withColumn("distance", bytestr.byte_levenshtein(F.col("query"), F.col("other")))


def _raw_topk(spark, d) -> DataFrame:
    rows = terms.table(spark, d, "part").select(F.col("p_size").alias("score"), F.col("p_partkey").alias("item"))
    return search.topk_largest_ties(rows, "score", "item", 25)


def _rejects(spark, d) -> DataFrame:
    rows = terms.table(spark, d, "pages").select(F.col("url").alias("tenant"), F.lit("t").alias("term"), F.lit(1).alias("weight"))
    names = terms.table(spark, d, "nation").select(F.col("n_name").alias("tenant"), F.lit("").alias("term"), F.lit(1).alias("weight"))
    good = terms.table(spark, d, "part").select(F.col("p_brand").alias("tenant"), F.col("p_name").alias("term"), F.lit(1).alias("weight"))
    _, bad = validate.split_valid(rows.unionByName(names).unionByName(good))
    return bad.select("tenant", "term", "status")


def _keys(spark, d) -> DataFrame:
    parts = terms.part_terms(spark, d).select("tenant", "term").distinct()
    key = bytestr.decode_key(bytestr.encode_key(F.col("tenant"), F.col("term")))
    return parts.select(key.alias("k")).select("k.tenant", "k.term")


def _hits_json(spark, d) -> DataFrame:
    hits = search.prefix_topk_by_tenant(_docs(spark, d), "", 5).where("tenant = 'en'")
    return api.hits_json(hits)


def _stream(spark, d) -> DataFrame:
    folder = _work_dir(spark)
    terms.event_ops(spark, d).repartition(4, "seq").write.parquet(f"{folder}/in")
    store = Store(spark, f"{folder}/store")
    query = ingest.write_ops(ingest.read_ops(spark, f"{folder}/in"), store, f"{folder}/checkpoint", available_now=True)
    query.awaitTermination()
    return store.dictionary()


def _json_calls(spark, d) -> DataFrame:
    """Index calls as JSON texts, a third of them without a weight."""
    call = F.to_json(F.struct(F.col("lang").alias("tenant"), F.col("source").alias("term"), F.expr("if(doc_id % 3 <> 0, n_chars, null)").alias("weight")))
    calls = terms.json_input(terms.table(spark, d, "documents").select(call.alias("value")))
    return dictionary.from_terms(calls.where("tenant is not null and term is not null"))


def _running(spark, d) -> DataFrame:
    """A running dictionary fed with the events in order, a quarter of them a micro-batch;
    the last row of a term counts."""
    folder = _work_dir(spark)
    ops = terms.event_ops(spark, d)
    cuts = [-1, *ops.agg(F.percentile_approx("seq", [0.25, 0.5, 0.75])).first()[0], 2**62]
    for k, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        ops.where((F.col("seq") > low) & (F.col("seq") <= high)).coalesce(1).write.parquet(f"{folder}/in/part{k}")
    stream = ingest.read_ops(spark, f"{folder}/in/part*", Config(max_batch=1))
    ingest.write_changes(ingest.running_dictionary(stream), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return ingest.latest(spark, f"{folder}/out")


def _recovered(spark, d) -> DataFrame:
    store = Store(spark, _work_dir(spark))
    ops = terms.event_ops(spark, d)
    half = ops.agg(F.percentile_approx("seq", 0.5)).first()[0]
    store.append(ops.where(F.col("seq") <= half))
    store.compact()
    store.append(ops.where(F.col("seq") > half))
    return Store(spark, store.path).dictionary()


def _batch(spark, d) -> DataFrame:
    return search.prefix_topk_batch(_docs(spark, d), terms.benchmark_requests(spark, d, k=5))


def _fuzzy_batch(spark, d) -> DataFrame:
    return search.fuzzy_topk_batch(_docs(spark, d), terms.benchmark_requests(spark, d, typo=1, k=5))


def _pairs(spark, d) -> DataFrame:
    queries = terms.benchmark_requests(spark, d, typo=2, k=1).groupBy("tenant", "query", "typo").agg(F.max("k").alias("_most"))
    return search.fuzzy_pairs(_docs(spark, d), queries).drop("_most", "typo", "score")


_TOP_EACH = "SELECT tenant, CAST(rank AS INTEGER) AS rank, term, score FROM (SELECT tenant, term, frequency AS score, row_number() OVER (PARTITION BY tenant ORDER BY frequency DESC, term) AS rank FROM d WHERE starts_with(term, '{}')) WHERE rank <= {}"

#: Name -> (query, SQL or None).
CATALOG = {
    "index_part_terms": (_parts, PART_TERMS + "SELECT * FROM d"),
    "index_doc_terms": (_docs, DOC_TERMS + "SELECT * FROM d"),
    "prefix_topk_en_th": _prefix(_docs, "en", "th", 10),
    "prefix_topk_empty_prefix": _prefix(_docs, "de", "", 10),
    "prefix_topk_no_match": _prefix(_docs, "en", "qqqqqq", 10),
    "prefix_topk_unknown_tenant": _prefix(_docs, "nowhere", "a", 10),
    "prefix_topk_k0": _prefix(_docs, "en", "th", 0),
    "prefix_topk_wildcard_chars": _prefix(_docs, "en", "of%", 10),
    "prefix_topk_multibyte": _prefix(_docs, "fr", "é", 20),
    "prefix_topk_ties_part": _prefix(_parts, "Brand#11", "", 10),
    "prefix_topk_per_tenant": (
        lambda spark, d: search.prefix_topk_by_tenant(_docs(spark, d), "a", 7),
        DOC_TERMS + _TOP_EACH.format("a", 7),
    ),
    "prefix_topk_requests": (
        _batch,
        DOC_TERMS + _requests_sql(0, 5) + """SELECT query_id, CAST(rank AS INTEGER) AS rank, term, score FROM (
  SELECT query_id, term, frequency AS score, row_number() OVER (PARTITION BY query_id ORDER BY frequency DESC, term) AS rank
  FROM r JOIN d ON d.tenant = r.tenant AND starts_with(d.term, r.query)) WHERE rank <= 5""",
    ),
    "fuzzy_b0_exact": _fuzzy("en", "the", 0, 10),
    "fuzzy_b1_en": _fuzzy("en", "the", 1, 10),
    "fuzzy_b2_en": _fuzzy("en", "thre", 2, 20),
    "fuzzy_b1_fr_multibyte": _fuzzy("fr", "ouè", 1, 10),
    "fuzzy_evicts_exact": _fuzzy("en", "tha", 1, 2),
    "fuzzy_empty_query": _fuzzy("en", "", 2, 10),
    "fuzzy_requests_batch": (
        _fuzzy_batch,
        DOC_TERMS + _requests_sql(1, 5) + """SELECT query_id, CAST(rank AS INTEGER) AS rank, term, score, CAST(distance AS INTEGER) AS distance FROM (
  SELECT query_id, term, frequency AS score, levenshtein(d.term, r.query) AS distance,
    row_number() OVER (PARTITION BY query_id ORDER BY frequency DESC, term) AS rank
  FROM r JOIN d ON d.tenant = r.tenant AND levenshtein(d.term, r.query) <= 1) WHERE rank <= 5""",
    ),
    "fuzzy_deletion_join": (
        _pairs,
        DOC_TERMS + _requests_sql(2, 1) + """SELECT DISTINCT r.tenant, query, term, CAST(levenshtein(d.term, r.query) AS INTEGER) AS distance
FROM r JOIN d ON d.tenant = r.tenant AND levenshtein(d.term, r.query) <= 2""",
    ),
    "byte_distance_pairs": (
        _distances,
        """SELECT item_id, query, other, CAST(levenshtein(query, other) AS INTEGER) AS distance FROM (
  SELECT item_id, coalesce(regexp_split_to_array(text, '\\s+')[1], '') AS query, coalesce(regexp_split_to_array(text, '\\s+')[2], '') AS other FROM benchmark)""",
    ),
    "exact_lookup": (
        lambda spark, d: search.exact(_docs(spark, d), "fr", "été"),
        DOC_TERMS + "SELECT frequency FROM d WHERE tenant = 'fr' AND term = 'été'",
    ),
    "exact_lookup_found": (
        lambda spark, d: search.exact(_docs(spark, d), "en", "the"),
        DOC_TERMS + "SELECT frequency FROM d WHERE tenant = 'en' AND term = 'the'",
    ),
    "membership_semi": (
        _members,
        DOC_TERMS + _requests_sql(0, 1) + "SELECT DISTINCT r.tenant, query AS term FROM r SEMI JOIN d ON d.tenant = r.tenant AND d.term = r.query",
    ),
    "topk_raw_desc_ties": (_raw_topk, "SELECT p_size AS score, p_partkey AS item FROM part ORDER BY score DESC, item DESC LIMIT 25"),
    "ops_fold": (lambda spark, d: dictionary.fold_ops(terms.event_ops(spark, d)), FOLD + "SELECT * FROM d"),
    "ops_rejected_deletes": (
        lambda spark, d: dictionary.rejected_deletes(terms.event_ops(spark, d), 512),
        OPS + """SELECT seq, tenant, term FROM (SELECT *, lag(op) OVER (PARTITION BY tenant, term ORDER BY seq) AS before FROM ops)
WHERE op = 'delete' AND coalesce(before, 'delete') = 'delete'""",
    ),
    "ops_running_totals": (
        lambda spark, d: dictionary.running_totals(terms.event_ops(spark, d), 512),
        OPS + """, e AS (SELECT *, sum(CASE WHEN op <> 'index' THEN 1 ELSE 0 END) OVER (PARTITION BY tenant, term ORDER BY seq) AS epoch FROM ops)
SELECT seq, tenant, term, op, CASE WHEN op <> 'delete' THEN CAST(sum(CASE WHEN op = 'delete' THEN 0 ELSE weight END) OVER (
  PARTITION BY tenant, term, epoch ORDER BY seq) AS BIGINT) END AS total FROM e""",
    ),
    "ops_last_write_wins": (
        lambda spark, d: dictionary.last_write_wins(terms.event_ops(spark, d)),
        OPS + """SELECT tenant, term, op, CASE WHEN op <> 'delete' THEN weight END AS weight FROM ops
QUALIFY row_number() OVER (PARTITION BY tenant, term ORDER BY seq DESC) = 1""",
    ),
    "set_terms": (
        lambda spark, d: dictionary.set_terms(terms.event_ops(spark, d)),
        OPS + "SELECT tenant, term, arg_max(weight, seq) AS frequency FROM ops GROUP BY ALL",
    ),
    "tenant_stats": (lambda spark, d: shape.tenant_stats(_docs(spark, d)), DOC_TERMS + STATS),
    "max_freq_per_prefix": (
        lambda spark, d: shape.highest_below(_parts(spark, d)),
        PART_TERMS + "SELECT tenant, term[1:n] AS prefix, max(frequency) AS max_frequency FROM (SELECT *, unnest(range(0, length(term) + 1)) AS n FROM d) GROUP BY ALL",
    ),
    "tenant_count": (
        lambda spark, d: dictionary.tenant_count(_docs(spark, d)),
        DOC_TERMS + "SELECT count(DISTINCT tenant) AS tenants FROM d",
    ),
    "term_count": (
        lambda spark, d: dictionary.term_counts(_docs(spark, d)),
        DOC_TERMS + "SELECT tenant, count(*) AS terms FROM d GROUP BY tenant",
    ),
    "validate_rejects": (
        _rejects,
        """SELECT url AS tenant, 't' AS term, 400 AS status FROM pages WHERE url IS NULL OR url = '' OR regexp_matches(url, '[\\s/]')
UNION ALL SELECT n_name, '', 400 FROM nation
UNION ALL SELECT p_brand, p_name, 400 FROM part WHERE p_brand = '' OR p_name = '' OR regexp_matches(p_brand, '[\\s/]')""",
    ),
    "key_roundtrip": (_keys, "SELECT DISTINCT p_brand AS tenant, p_name AS term FROM part"),
    "completions_table": (
        lambda spark, d: completions.completions(_parts(spark, d), 3),
        PART_TERMS + """SELECT tenant, prefix, CAST(rank AS INTEGER) AS rank, term, score FROM (
  SELECT tenant, term[1:n] AS prefix, term, frequency AS score,
    row_number() OVER (PARTITION BY tenant, term[1:n] ORDER BY frequency DESC, term) AS rank
  FROM (SELECT *, unnest(range(0, length(term) + 1)) AS n FROM d)) WHERE rank <= 3""",
    ),
    "http_hits_json": (
        _hits_json,
        DOC_TERMS + """SELECT '[' || string_agg('{"term":' || CAST(to_json(term) AS VARCHAR) || ',"score":' || score || '}', ',' ORDER BY score DESC, term) || ']' AS json
FROM (SELECT term, frequency AS score FROM d WHERE tenant = 'en' ORDER BY frequency DESC, term LIMIT 5)""",
    ),
    "index_json_calls": (
        _json_calls,
        """SELECT lang AS tenant, source AS term, CAST(sum(coalesce(n, 1)) AS BIGINT) AS frequency FROM (
  SELECT lang, source, CASE WHEN doc_id % 3 <> 0 THEN n_chars END AS n FROM documents) WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL""",
    ),
    "stream_running_dictionary": (_running, FOLD + "SELECT * FROM d"),
    "stream_index_available_now": (_stream, FOLD + "SELECT * FROM d"),
    "snapshot_recover": (_recovered, FOLD + "SELECT * FROM d"),
}


def queries() -> dict:
    return {name: query for name, (query, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items() if sql}
