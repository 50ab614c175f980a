"""Exact, prefix and typo-tolerant lookups over a dictionary.

Results are ordered by frequency from the highest, then by term (bytes ascending);
distance is no ranking key. Terms are compared as they are: case counts, nothing is
trimmed or folded. Prefix tests are ``startswith``, which Parquet scans take as a pushed
filter; a top-K is a sort with a limit, so each task sends K rows at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytestr import byte_levenshtein, deletion_neighbours, latin1

#: Terms of more bytes have too many deletions to list; they are compared by length.
NEIGHBOUR_BYTES = 32
#: Distinct queries that go to every task; more are met by a shuffle.
BROADCAST_QUERIES = 100_000


def _top(hits: DataFrame, k: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), F.asc("term")).limit(max(0, k))


def exact(dictionary: DataFrame, tenant: str, term: str) -> DataFrame:
    return dictionary.where((F.col("tenant") == tenant) & (F.col("term") == term)).select("frequency")


def members(dictionary: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted (tenant, term)`` that the dictionary has."""
    return wanted.join(dictionary.select("tenant", "term"), ["tenant", "term"], "left_semi")


def prefix_topk(dictionary: DataFrame, tenant: str, prefix: str, k: int) -> DataFrame:
    """``(term, score)``; an empty prefix takes all terms, an unknown tenant gives none."""
    hits = dictionary.where((F.col("tenant") == tenant) & F.col("term").startswith(prefix))
    return _top(hits.select("term", F.col("frequency").alias("score")), k)


def fuzzy_topk(dictionary: DataFrame, tenant: str, query: str, edits: int, k: int) -> DataFrame:
    """``(term, score, distance)`` of terms within ``edits`` byte edits of the query."""
    size = len(query.encode())
    near = dictionary.where((F.col("tenant") == tenant) & F.octet_length("term").between(size - edits, size + edits))
    hits = near.select(
        "term", F.col("frequency").alias("score"), byte_levenshtein(F.col("term"), F.lit(query), edits).alias("distance")
    )
    return _top(hits.where("distance >= 0"), k)


def topk_largest_ties(rows: DataFrame, score: str, item: str, k: int) -> DataFrame:
    """The K rows with the highest score; of equal scores, the larger items first."""
    return rows.orderBy(F.desc(score), F.desc(item)).limit(max(0, k))


def prefix_topk_by_tenant(dictionary: DataFrame, prefix: str, k: int) -> DataFrame:
    """``(tenant, rank, term, score)`` for every tenant at once."""
    hits = dictionary.where(F.col("term").startswith(prefix)).withColumnRenamed("frequency", "score")
    order = Window.partitionBy("tenant").orderBy(F.desc("score"), F.asc("term"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("tenant", "rank", "term", "score")


def _distinct_queries(requests: DataFrame, *more: str) -> DataFrame:
    return requests.groupBy("tenant", "query", *more).agg(F.max("k").alias("_most"))


def _ranked(hits: DataFrame, requests: DataFrame, keys: list[str], columns: list[str], most: int) -> DataFrame:
    """Ranks each key's hits once, then hands them to all its requests. The limit on the
    rank lets Spark cut the hits of a key in each task before they are shuffled, so a key
    that all terms match moves ``most`` rows a task."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("term"))
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return requests.join(best, keys).where("rank <= k").select("query_id", "rank", *columns)


def prefix_topk_batch(dictionary: DataFrame, requests: DataFrame) -> DataFrame:
    """``(query_id, rank, term, score)`` for requests ``(query_id, tenant, query, k)``.

    The prefix test becomes an equality: terms are cut to the lengths that their tenant's
    queries have. What nobody asks for is left out early where the queries are few enough
    to go to every task; either way a prefix's terms are ranked before they meet requests.
    """
    queries = _distinct_queries(requests)
    known = queries.agg(F.count("*").alias("n"), F.coalesce(F.max("_most"), F.lit(0)).alias("most")).first()
    sizes = queries.groupBy("tenant").agg(F.collect_set(F.char_length("query")).alias("_sizes"))
    cut = dictionary.join(sizes, "tenant").select(
        "tenant", "term", F.col("frequency").alias("score"), F.explode("_sizes").alias("_n")
    )
    cut = cut.where("_n <= char_length(term)").withColumn("query", F.expr("substring(term, 1, _n)"))
    if known["n"] <= BROADCAST_QUERIES:
        cut = cut.join(F.broadcast(queries.select("tenant", "query")), ["tenant", "query"], "left_semi")
    return _ranked(cut, requests, ["tenant", "query"], ["term", "score"], known["most"])


def fuzzy_pairs(dictionary: DataFrame, queries: DataFrame) -> DataFrame:
    """``(tenant, query, typo, _most, term, score, distance)``, each pair once.

    Terms are cut to the lengths that a query of their tenant allows. For up to two edits,
    short terms and queries meet where they share a string with as many bytes left out. All
    others meet by tenant and length. Only the budgets that are asked for are worked out.
    """
    terms = dictionary.select("tenant", "term", F.col("frequency").alias("score")).withColumn("_size", F.octet_length("term"))
    asked = queries.where("typo >= 0").withColumn("_bytes", F.octet_length("query"))
    short = (F.col("_bytes") + F.col("typo") <= NEIGHBOUR_BYTES) & (F.col("typo") <= 2)
    reach = F.explode(F.sequence(F.greatest(F.lit(0), F.col("_bytes") - F.col("typo")), F.col("_bytes") + F.col("typo"))).alias("_size")
    budgets = {r["typo"] for r in asked.where(short).select("typo").distinct().collect()}
    parts = []
    for edits in sorted(budgets):
        mine = asked.where(short & (F.col("typo") == edits))
        keyed = mine.withColumn("_key", F.explode(deletion_neighbours(latin1(F.col("query")), edits)))
        near = terms.join(mine.select("tenant", reach).distinct(), ["tenant", "_size"], "left_semi")
        listed = near.withColumn("_key", F.explode(deletion_neighbours(latin1(F.col("term")), edits)))
        met = keyed.join(listed, ["tenant", "_key"]).drop("_key")
        parts.append(met.dropDuplicates(["tenant", "query", "typo", "term"]))
    wide = asked.where(~short)
    parts.append(wide.select("*", reach).join(terms, ["tenant", "_size"]))
    columns = ["tenant", "query", "typo", "_most", "term", "score"]
    every = parts[0].select(*columns)
    for part in parts[1:]:
        every = every.unionByName(part.select(*columns))
    distance = F.levenshtein(latin1(F.col("term")), latin1(F.col("query")))
    return every.withColumn("distance", distance).where("distance <= typo")


def fuzzy_topk_batch(dictionary: DataFrame, requests: DataFrame) -> DataFrame:
    """``(query_id, rank, term, score, distance)`` for requests with a ``typo`` budget."""
    most = requests.agg(F.coalesce(F.max("k"), F.lit(0)).alias("m")).first()["m"]
    hits = fuzzy_pairs(dictionary, _distinct_queries(requests, "typo"))
    return _ranked(hits, requests, ["tenant", "query", "typo"], ["term", "score", "distance"], most)
