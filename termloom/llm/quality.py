"""Quality rules combined by weak supervision.

Each rule votes "bad", "good" or abstains on a document. How often a rule votes bad
on good and on bad documents is not set by hand: expectation-maximisation estimates it
from how the rules' votes fall together over all documents, and the posterior
probability of being good decides. EM needs only how many documents have each vote
pattern, at most 3 ** rules rows, whatever the number of documents.

Repeated windows are compared by 64-bit hashes within one document; for a document of
a million words the chance of any false match is about 3e-8.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, whole_text

WINDOW = 8
#: Words in which different ones are counted; the rest of a text past its last whole part is one more.
PART = 100
#: A document below this posterior probability of being good is rejected.
THRESHOLD = 0.5
ROUNDS = 60

#: Common function words of the languages covered.
FUNCTION_WORDS = (
    "the of and to in that is for it with as was on be by this are or an at "
    "le la les de des et un une du en que qui est pour dans "
    "der die das und ist ein eine zu den von mit nicht auf "
    "el los las y del se por con para una"
).split()

#: Votes by rule name: (bad if, good if), SQL over the columns of ``features``.
RULES = {
    "symbols": ("n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    "repeats": ("n_repeat_words > 0.2 * n_words", "n_words >= 9 and n_repeat_words <= 0.05 * n_words"),
    "lines": ("n_dup_lines > 0.3 * n_lines", "n_lines > 1 and n_dup_lines <= 0.1 * n_lines"),
    "distinct": ("n_words >= 20 and n_distinct < 0.35 * n_words", "n_distinct >= 0.5 * n_words"),
    "stutter": ("n_words >= 5 and n_stutter > 0.15 * n_words", "n_words >= 5 and n_stutter <= 0.05 * n_words"),
    "word_length": ("word_chars < 2 * n_words or word_chars > 12 * n_words", "word_chars between 3 * n_words and 8 * n_words"),
    "function_words": ("n_words >= 50 and n_function = 0", "n_function >= 2"),
}


def features(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """``carry`` and the counts the rules use; a null text has no words."""
    function_words = F.array(*map(F.lit, dict.fromkeys(FUNCTION_WORDS)))
    rows = docs.select(*carry, whole_text().alias("_t"))
    rows = rows.withColumn("_w", F.array_remove(F.split("_t", SPACE), "")).withColumn("n_words", F.size("_w").cast("long"))
    rows = rows.withColumn(
        "_h",
        F.expr(f"if(n_words > {WINDOW}, transform(sequence(1, int(n_words) - {WINDOW - 1}), i -> xxhash64(slice(_w, i, {WINDOW}))), array())"),
    )
    rows = rows.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    # Only documents with some window twice go on to the sort.
    rows = rows.withColumn(
        "_s",
        F.expr("if(size(array_distinct(_h)) < size(_h), array_sort(transform(_h, (h, i) -> struct(h, i))), cast(array() as array<struct<h:bigint,i:int>>))"),
    )
    rows = rows.withColumn(
        "_p",
        F.expr(
            """array_sort(transform(filter(_s, (x, j) ->
                 (j > 0 and get(_s, j - 1).h = x.h) or (j + 1 < size(_s) and get(_s, j + 1).h = x.h)), x -> x.i))"""
        ),
    )
    covered = F.expr(
        f"if(size(_p) = 0, 0L, aggregate(sequence(1, size(_p)), 0L, (a, j) -> a + if(j = size(_p), {WINDOW}, least({WINDOW}, _p[j] - _p[j - 1]))))"
    )
    return rows.select(
        *[c for c in rows.columns if c not in ("_t", "_w", "_h", "_l", "_s", "_p", "n_words")],
        "n_words",
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        # by parts, so that the share of different words does not fall with the length
        F.expr(f"aggregate(sequence(1, greatest(int(n_words), 1), {PART}), 0L, (a, i) -> a + size(array_distinct(slice(_w, i, {PART}))))").alias("n_distinct"),
        F.expr("if(n_words > 1, size(filter(sequence(1, int(n_words) - 1), i -> _w[i] = _w[i - 1])), 0)").cast("long").alias("n_stutter"),
        F.size(F.array_intersect("_w", function_words)).cast("long").alias("n_function"),
    )


def votes() -> Column:
    """The vote pattern as a number in base 3, the first rule first: 0 abstains, 1 bad, 2 good."""
    digits = [f"(case when {bad} then 1 when {good} then 2 else 0 end) * {3**i}" for i, (bad, good) in enumerate(RULES.values())]
    return F.expr(" + ".join(digits)).cast("int")


def estimate(patterns: dict[int, int], rounds: int = ROUNDS) -> dict[int, float]:
    """Pattern -> posterior probability of being good, by EM over pattern counts.

    Two latent classes; given the class, rules that don't abstain vote independently.
    A rule is never taken to vote bad more often on good documents than on bad ones,
    which fixes which class is which. One pseudo-document keeps rates off 0 and 1.
    """
    n = len(RULES)
    digits = {p: [p // 3**i % 3 for i in range(n)] for p in patterns}
    total = sum(patterns.values())
    prior, on_good, on_bad = 0.8, [0.02] * n, [0.5] * n
    posterior: dict[int, float] = {}
    for _ in range(rounds):
        for p, ds in digits.items():
            log_odds = math.log(prior) - math.log(1 - prior)
            for i, d in enumerate(ds):
                if d == 1:
                    log_odds += math.log(on_good[i]) - math.log(on_bad[i])
                elif d == 2:
                    log_odds += math.log1p(-on_good[i]) - math.log1p(-on_bad[i])
            posterior[p] = 1 / (1 + math.exp(-max(-700.0, min(700.0, log_odds))))
        prior = min(0.99, max(0.01, (sum(patterns[p] * posterior[p] for p in patterns) + 0.8) / (total + 1)))
        for i in range(n):
            rates = []
            for good, start in ((True, 0.02), (False, 0.5)):
                bad_votes, cast_votes = start, 1.0
                for p, ds in digits.items():
                    weight = patterns[p] * (posterior[p] if good else 1 - posterior[p])
                    bad_votes += weight * (ds[i] == 1)
                    cast_votes += weight * (ds[i] > 0)
                rates.append(bad_votes / cast_votes)
            on_good[i] = min(0.5, rates[0])
            on_bad[i] = max(rates[1], on_good[i])
    return posterior


def judge(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """``carry``, the counts, ``base_failed``, ``p_good`` and ``kept`` for every row.

    The counts are taken once and kept in the shared folder, for EM and for the result.
    Repeated rows are judged alike, each for itself; empty texts fail the base rule. An
    empty table gives an empty result. A carried column may not have the name of a count.
    """
    counted = materialize(features(docs, carry).withColumn("votes", votes()), "quality")
    patterns = {r["votes"]: r["n"] for r in counted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    posterior = estimate(patterns)
    lookup = (
        F.create_map(*[F.lit(x) for p, v in sorted(posterior.items()) for x in (p, v)])
        if posterior
        else F.lit(None).cast("map<int,double>")
    )
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    judged = counted.withColumn("p_good", F.element_at(lookup, F.col("votes"))).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= THRESHOLD))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    judged = judge(docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")])
    return judged.where("kept").select("_doc.*")
