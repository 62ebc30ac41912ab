"""Hybrid recall: vector and keyword candidates of many queries, fused from six signals in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import signals
from palimpsest.functions.text import analyzed_tokens
from palimpsest.functions.vectors import code_distance, cosine_distance, norm, sign_code, similarity
from palimpsest.operators import entities as ent
from palimpsest.operators.tables import live_facts
from palimpsest.schemas import PAIR
from palimpsest.settings import RecallSettings
from palimpsest.sources.segments import staged, staged_together


SMALL_ROWS = 100_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most `most` rows; they are counted first. A larger one is joined as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def asked_pairs(queries: DataFrame) -> DataFrame:
    return queries.select(*PAIR).distinct()


def asked_terms(queries: DataFrame) -> DataFrame:
    """(qid, pair, term): the distinct terms of each query."""
    return queries.select("qid", *PAIR, F.explode(F.array_distinct("query_tokens")).alias("term"))


SMALL_VECTORS = 10_000


def distances(queries: DataFrame, facts: DataFrame, now: Column, where: Column | None = None) -> DataFrame:
    """(qid, id, distance) of every query and every live fact of its pair, by cosine.

    Up to SMALL_VECTORS queries go to the facts, wherever these are; of more, both sides are plain exchanges on the
    pair, so that a large one can be split."""
    rows = live_facts(facts, now).where("embedding is not null")
    rows = (rows if where is None else rows.where(where)).select(*PAIR, "id", "embedding", norm(F.col("embedding")).alias("_n"))
    asked = small(queries.select("qid", *PAIR, "query_vector", norm(F.col("query_vector")).alias("_qn")), SMALL_VECTORS)
    d = rows.join(asked, list(PAIR))
    return d.select("qid", "id", cosine_distance(F.col("embedding"), F.col("query_vector"), F.col("_n"), F.col("_qn")).alias("distance"))


def semantic(queries: DataFrame, facts: DataFrame, now: Column, k: int, where: Column | None = None) -> DataFrame:
    """(qid, id, distance, sem): each query's k nearest live facts of its pair, ties to smaller ids.

    Exact: a query meets every vector of its pair, and the window keeps k rows a query in every task before any is
    shuffled; semantic_by_size answers large pairs approximately.
    """
    d = distances(queries, facts, now, where)
    near = d.withColumn("_rn", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))).where(F.col("_rn") <= k)
    return near.select("qid", "id", "distance", similarity(F.col("distance")).alias("sem"))


def semantic_by_code(queries: DataFrame, facts: DataFrame, now: Column, k: int, where: Column | None = None, oversample: int = 20, bits: int = 256) -> DataFrame:
    """semantic, approximately: facts are first ranked by codes of a few bytes, and the k * oversample best by their vectors.

    facts may carry `embedding_code` (vectors.sign_code, made when the vector is set), so that a search reads vectors of
    candidates only; without that column codes are made on the way. The first ranking keeps its best rows in every
    task, runs on integers in generated code, and its cost a row does not depend on the vectors' length.
    """
    rows = live_facts(facts, now).where("embedding is not null")
    rows = rows if where is None else rows.where(where)
    code = F.col("embedding_code") if "embedding_code" in facts.columns else sign_code(F.col("embedding"), bits)
    coded = rows.select(*PAIR, "id", code.alias("_c"))
    asked = queries.select("qid", *PAIR, sign_code(F.col("query_vector"), bits).alias("_qc"))
    first = asked.join(coded, list(PAIR)).select("qid", *PAIR, "id", code_distance(F.col("_c"), F.col("_qc"), bits).alias("_d"))
    first = first.withColumn("_rn", F.row_number().over(Window.partitionBy("qid").orderBy("_d", "id"))).where(F.col("_rn") <= k * oversample)
    d = first.select("qid", *PAIR, "id").join(rows.select(*PAIR, "id", "embedding"), [*PAIR, "id"]).join(queries.select("qid", "query_vector"), "qid")
    d = d.select("qid", "id", cosine_distance(F.col("embedding"), F.col("query_vector")).alias("distance"))
    near = d.withColumn("_rn", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))).where(F.col("_rn") <= k)
    return near.select("qid", "id", "distance", similarity(F.col("distance")).alias("sem"))


def semantic_by_size(queries: DataFrame, facts: DataFrame, now: Column, k: int, where: Column | None = None, exact_below: int = 50_000) -> DataFrame:
    """semantic for pairs with fewer than exact_below live vectors, semantic_by_code for the larger ones."""
    sizes = live_facts(facts, now).where("embedding is not null").join(small(asked_pairs(queries)), list(PAIR), "left_semi").groupBy(*PAIR).agg(F.count("*").alias("_n"))
    large = small(sizes.where(F.col("_n") >= exact_below).select(*PAIR))
    exact = semantic(queries.join(large, list(PAIR), "left_anti"), facts, now, k, where)
    return exact.unionByName(semantic_by_code(queries.join(large, list(PAIR), "left_semi"), facts, now, k, where))


def semantic_scores(queries: DataFrame, facts: DataFrame, now: Column, ids: DataFrame) -> DataFrame:
    """(qid, id, sem) of given (qid, id), unfiltered."""
    rows = live_facts(facts, now).where("embedding is not null").select(*PAIR, "id", "embedding", norm(F.col("embedding")).alias("_n"))
    d = ids.join(queries.select("qid", *PAIR, "query_vector", norm(F.col("query_vector")).alias("_qn")), "qid").join(rows, [*PAIR, "id"])
    return d.select("qid", "id", similarity(cosine_distance(F.col("embedding"), F.col("query_vector"), F.col("_n"), F.col("_qn"))).alias("sem"))


def corpus_stats(facts: DataFrame, now: Column) -> DataFrame:
    """(pair, n_docs, mean_length) over live facts, whatever a request filters; texts without tokens don't enter the mean."""
    size = F.size(analyzed_tokens(F.col("content_analyzed")))
    return live_facts(facts, now).groupBy(*PAIR).agg(F.count("*").alias("n_docs"), F.avg(F.when(size > 0, size)).alias("mean_length"))


def postings(facts: DataFrame, now: Column, queries: DataFrame | None = None) -> DataFrame:
    """(pair, id, term, tf, length) of live facts; with queries only of their pairs and terms.

    Other pairs' facts are dropped before they are split into tokens, other terms before they are grouped; the tokens of
    a fact lie in one task, so that what is shuffled is one row a fact and term asked for.
    """
    rows = live_facts(facts, now).select(*PAIR, "id", "content_analyzed")
    if queries is not None:
        rows = rows.join(small(asked_pairs(queries)), list(PAIR), "left_semi")
    rows = rows.select(*PAIR, "id", analyzed_tokens(F.col("content_analyzed")).alias("_t")).select(*PAIR, "id", F.size("_t").alias("length"), F.explode("_t").alias("term"))
    if queries is not None:
        rows = rows.join(small(asked_terms(queries).select(*PAIR, "term").distinct()), [*PAIR, "term"], "left_semi")
    return rows.groupBy(*PAIR, "id", "length", "term").agg(F.count("*").alias("tf"))


def document_frequency(queries: DataFrame, facts: DataFrame, now: Column) -> DataFrame:
    """(qid, term, df): one row for each distinct term of a query, 0 if no fact of the pair has it."""
    df = postings(facts, now, queries).groupBy(*PAIR, "term").agg(F.count("*").alias("df"))
    return asked_terms(queries).join(df, [*PAIR, "term"], "left").select("qid", "term", F.coalesce("df", F.lit(0)).alias("df"))


def counted(facts: DataFrame, now: Column, terms: DataFrame) -> DataFrame:
    """(pair, id, length, term, tf) of live facts in the pairs of terms (qid, pair, term): a row for each term that is asked for, and one with term null for each fact.

    The tokens of a fact lie in one task, where all that nobody asks for fall into the row without term.
    """
    pairs = small(terms.select(*PAIR).distinct())
    rows = live_facts(facts, now).select(*PAIR, "id", "content_analyzed").join(pairs, list(PAIR), "left_semi")
    rows = rows.select(*PAIR, "id", analyzed_tokens(F.col("content_analyzed")).alias("_t"))
    rows = rows.select(*PAIR, "id", F.size("_t").alias("length"), F.explode(F.concat("_t", F.array(F.lit(None).cast("string")))).alias("term"))
    asked = small(terms.select(*PAIR, "term").distinct().withColumn("_a", F.lit(1)))
    rows = rows.join(asked, [*PAIR, "term"], "left").select(*PAIR, "id", "length", F.when(F.col("_a") == 1, F.col("term")).alias("term"))
    return rows.groupBy(*PAIR, "id", "length", "term").agg(F.count("*").alias("tf"))


def keyword_scores(queries: DataFrame, facts: DataFrame, now: Column) -> DataFrame:
    """(qid, id, kw_raw): BM25 of every live fact of the pair that has a term of the query.

    The facts of the pairs are read and split into tokens once; statistics, document frequencies and scores then come
    from the small table that is left.
    """
    terms = staged(asked_terms(queries))
    rows = staged(counted(facts, now, terms))
    post = rows.where("term is not null")
    df = post.groupBy(*PAIR, "term").agg(F.count("*").alias("df"))
    stats = rows.where("term is null").groupBy(*PAIR).agg(F.count("*").alias("n_docs"), F.avg(F.when(F.col("length") > 0, F.col("length"))).alias("mean_length"))
    hits = post.join(terms.join(df, [*PAIR, "term"]).join(stats, list(PAIR)), [*PAIR, "term"])
    part = signals.bm25_term(F.col("tf"), F.col("df"), F.col("n_docs"), F.col("length"), F.coalesce("mean_length", F.lit(0.0)))
    return hits.groupBy("qid", "id").agg(signals.bm25_total(part).alias("kw_raw"))


def keyword(queries: DataFrame, facts: DataFrame, now: Column, k: int, where: Column | None = None) -> DataFrame:
    """(qid, id, kw_raw): each query's k best by BM25, ties to smaller ids."""
    scores = keyword_scores(queries, facts, now)
    if where is not None:
        scores = scores.join(facts.where(where).select("id"), "id", "left_semi")
    best = Window.partitionBy("qid").orderBy(F.desc("kw_raw"), "id")
    return scores.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= k).drop("_rn")


def recall(queries: DataFrame, facts: DataFrame, entities: DataFrame, links: DataFrame, now: Column, settings: RecallSettings = RecallSettings(), limit: int = 10, where: Column | None = None, vector_search=semantic) -> DataFrame:
    """Ranked facts of every query, with the signals that explain each score.

    queries: qid, pair, query_tokens (all tokens, repeats too), query_vector. A fact is a candidate if it is among
    the k nearest by vector or the k best by BM25 (k = min(1000, limit * oversample)); each candidate gets both scores
    whichever path found it. Rows: qid, rank, id, sem, kw, ent, reinf, rec, lvl, score, matched_entities,
    candidates_considered. Missing signals are 0; ties go to smaller ids. The pair is an equality in every join.
    Facts of other pairs are dropped before anything else is done with facts. Keyword scores, candidates and boosts are
    tables of a few rows a question, each computed once and written. vector_search finds the k nearest by vector:
    semantic (exact), semantic_by_code, semantic_by_size, or a kept index's searcher().
    """
    k = settings.candidates(limit)
    queries = staged(queries)
    facts = facts.join(small(asked_pairs(queries)), list(PAIR), "left_semi")
    kw_all, near, boost = staged_together(
        lambda: keyword_scores(queries, facts, now), lambda: vector_search(queries, facts, now, k, where).select("qid", "id"),
        lambda: ent.boosts(ent.match_entities(queries, entities, links, facts, settings.entity_top_k), links, settings.entity_cut),
    )
    allowed = kw_all if where is None else kw_all.join(facts.where(where).select("id"), "id", "left_semi")
    best = allowed.withColumn("_rn", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("kw_raw"), "id"))).where(F.col("_rn") <= k)
    ids = staged(near.select("qid", "id").union(best.select("qid", "id")).distinct())
    rows = ids.join(queries.select("qid", *PAIR, "query_vector", F.size("query_tokens").alias("n_terms")), "qid")
    columns = ["content", "level", "times_derived", "last_reinforced_at", "embedding"]
    rows = rows.join(live_facts(facts, now).select(*PAIR, "id", *columns), [*PAIR, "id"]).join(kw_all, ["qid", "id"], "left")
    rows = rows.join(boost.withColumnRenamed("conclusion_id", "id"), ["qid", "id"], "left")
    sem = F.coalesce(similarity(cosine_distance(F.col("embedding"), F.col("query_vector"))), F.lit(0.0))
    rows = rows.select(
        "qid", "id", "content", "level", "times_derived", sem.alias("sem"), signals.keyword_curve(F.coalesce("kw_raw", F.lit(0.0)), F.col("n_terms")).alias("kw"),
        F.coalesce("ent", F.lit(0.0)).alias("ent"), signals.reinforcement(F.col("times_derived")).alias("reinf"), signals.recency(F.col("last_reinforced_at"), now, settings.half_life_days).alias("rec"),
        signals.level_weight(F.col("level")).alias("lvl"), F.coalesce("matched_entities", F.array().cast("array<string>")).alias("matched_entities"),
    )
    rows = rows.withColumn("score", signals.fused(settings.weights, *[F.col(c) for c in ("sem", "kw", "ent", "reinf", "rec", "lvl")]))
    rows = rows.withColumn("candidates_considered", F.count("*").over(Window.partitionBy("qid"))).where(F.col("score") >= settings.threshold)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= limit)


def reinforced_between(start: Column | None, end: Column | None) -> Column:
    """Filter for recall over a stretch of time: last_reinforced_at in [start, end), either side open if None."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col("last_reinforced_at") >= start)
    return out if end is None else out & (F.col("last_reinforced_at") < end)
