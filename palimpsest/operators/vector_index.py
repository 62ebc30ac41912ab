"""An inverted-file index of fact vectors, kept as tables: each large pair's vectors are parted into lists around
coarse centroids, and a search reads only the lists whose centroids are nearest to its query."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.vectors import cosine_distance, norm, similarity
from palimpsest.schemas import PAIR
from palimpsest.sources.segments import Segments, staged

_PAIR = "workspace_name string, observer string, observed string"
CENTROIDS = f"{_PAIR}, list int, centroid array<float>, dims int"
LISTS = f"{_PAIR}, list int, id string, embedding array<float>, expires_at timestamp, cell int"
GONE = f"{_PAIR}, id string"
UNLISTED = -1


def fit_lists(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means: unit centroids of unit vectors, at most `lists`; empty lists keep their centroid."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.unique(x[:lists], axis=0)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.where(size > 0, size, 1), c)
    return c


class VectorIndex:
    """Tables `centroids` (a row a list), `lists` (a row a vector, partitioned by cell) and `gone` (ids taken out).

    Pairs with fewer than exact_below vectors when the index is built, vectors of another length than their pair's
    centroids and vectors without direction stand in the list -1, which every search of the pair reads, so that they are found exactly. A cell is
    a folder that holds the lists of one hash value; a search names the cells of the lists that it probes, and the scan
    opens no others. Writes append segments; a row counts until its id is taken out by a later segment.
    """

    def __init__(self, spark: SparkSession, root: str, cells: int = 256):
        self.spark, self.cells, self.store = spark, cells, Segments(spark, root)

    # Writing

    def build(self, facts: DataFrame, exact_below: int = 5000, most_lists: int = 1024, sample: int = 64, group_rows: int = 20_000, seed: int = 11) -> VectorIndex:
        """Write the index of all undeleted facts that have a vector, in place of what the folder held.

        A pair of n vectors gets about sqrt(n) lists, at most most_lists. Their centroids are fitted on a sample of about
        `sample` vectors a list, drawn by a hash of the id; every vector is then assigned, in groups of about group_rows,
        so that a large pair's vectors lie in many tasks.
        """
        seq = self.store.next()
        rows = self._rows(facts)
        usable = rows.where("_n > 0")
        sizes = usable.groupBy(*PAIR, F.size("embedding").alias("dims")).agg(F.count("*").alias("n"))
        sizes = sizes.withColumn("_r", F.row_number().over(Window.partitionBy(*PAIR).orderBy(F.desc("n"), "dims"))).where("_r = 1").drop("_r").where(F.col("n") >= exact_below)
        sizes = staged(sizes.withColumn("k", F.least(F.round(F.sqrt("n")), F.lit(most_lists)).cast("int")))
        share = (F.xxhash64(F.lit(seed), "id").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)) < F.least(F.lit(1.0), F.col("k") * sample / F.col("n"))
        drawn = usable.join(sizes, list(PAIR)).where((F.size("embedding") == F.col("dims")) & share).select(*PAIR, "k", "id", "embedding")

        def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            order = np.random.default_rng(seed).permutation(len(pdf))
            c = fit_lists(np.stack(pdf["embedding"].to_list()).astype(np.float64)[order], int(pdf["k"].iloc[0]))
            return pd.DataFrame(dict(zip(PAIR, key)) | {"list": range(len(c)), "centroid": list(c.astype(np.float32)), "dims": c.shape[1]})

        self.store.write(drawn.groupBy(*PAIR).applyInPandas(fit, CENTROIDS), "centroids", seq)
        centroids = self.spark.read.schema(CENTROIDS).parquet(self.store.path("centroids", seq))
        self._write_lists(rows, centroids, seq, group_rows)
        self.store.commit(seq, base=True)
        return self

    def insert(self, facts: DataFrame, group_rows: int = 20_000) -> None:
        """Add facts; those whose ids the index holds replace them."""
        seq = self.store.next()
        rows = self._rows(facts)
        self._write_lists(rows, self.centroids(), seq, group_rows)
        self.store.write(facts.select(*PAIR, "id"), "gone", seq)
        self.store.commit(seq)

    def delete(self, ids: DataFrame) -> None:
        """Take out facts, given as (pair, id)."""
        seq = self.store.next()
        self.store.write(ids.select(*PAIR, "id").distinct(), "gone", seq)
        self.store.commit(seq)

    def compact(self) -> None:
        """Write what counts as one segment; centroids stay as they are."""
        seq = self.store.next()
        self.store.write(self.centroids(), "centroids", seq)
        self._save(self.rows().drop("seq", "cell"), seq)
        self.store.commit(seq, base=True)

    def _rows(self, facts: DataFrame) -> DataFrame:
        expires = F.col("expires_at") if "expires_at" in facts.columns else F.lit(None).cast("timestamp")
        alive = facts.where("deleted_at is null") if "deleted_at" in facts.columns else facts
        return alive.where("embedding is not null").select(*PAIR, "id", F.col("embedding").cast("array<float>").alias("embedding"), expires.alias("expires_at"), norm(F.col("embedding")).alias("_n"))

    def _write_lists(self, rows: DataFrame, centroids: DataFrame, seq: int, group_rows: int) -> None:
        known = centroids.groupBy(*PAIR).agg(F.max("dims").alias("_d"))
        rows = rows.join(known, list(PAIR), "left")
        listed = (F.col("_n") > 0) & (F.size("embedding") == F.col("_d"))
        # a pair's rows are dealt over as many groups as its size asks for, and its centroids go to each
        sizes = rows.where(listed).groupBy(*PAIR).agg(F.ceil(F.count("*") / group_rows).cast("int").alias("_g"))
        dealt = rows.where(listed).join(sizes, list(PAIR)).withColumn("_s", F.pmod(F.xxhash64("id"), F.col("_g")).cast("int")).select(*PAIR, "_s", "id", "embedding", "expires_at")
        copies = centroids.select(*PAIR, "list", "centroid").join(sizes, list(PAIR)).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_g") - 1))).drop("_g")

        def assign(v: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            if len(v):
                x, y = np.stack(v["embedding"].to_list()).astype(np.float64), np.stack(c["centroid"].to_list()).astype(np.float64)
                v = v.assign(list=c["list"].to_numpy()[(x @ y.T).argmax(1)].astype(np.int32))
            else:
                v = v.assign(list=pd.Series(dtype=np.int32))
            return v[[*PAIR, "list", "id", "embedding", "expires_at"]]

        keys = [*PAIR, "_s"]
        near = dealt.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(assign, f"{_PAIR}, list int, id string, embedding array<float>, expires_at timestamp")
        rest = rows.where(~F.coalesce(listed, F.lit(False))).select(*PAIR, F.lit(UNLISTED).alias("list"), "id", "embedding", "expires_at")
        self._save(near.unionByName(rest), seq)

    def _cell(self) -> Column:
        return F.pmod(F.xxhash64(*PAIR, "list"), F.lit(self.cells)).cast("int")

    def _save(self, rows: DataFrame, seq: int) -> None:
        out = rows.withColumn("cell", self._cell()).repartition("cell", F.pmod(F.xxhash64("id"), F.lit(4)))
        self.store.write(out.sortWithinPartitions("cell", *PAIR, "list"), "lists", seq, ["cell"])

    # Reading

    def centroids(self) -> DataFrame:
        return self.store.read("centroids", CENTROIDS).drop("seq")

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """Rows that count; with cells, those of these folders only."""
        lists, gone = self.store.read("lists", LISTS), self.store.read("gone", GONE)
        lists = lists if cells is None else lists.where(F.col("cell").isin(cells))
        last = gone.groupBy(*PAIR, "id").agg(F.max("seq").alias("_last"))
        return lists.join(last, [*PAIR, "id"], "left").where("_last is null or seq >= _last").drop("_last")

    def probes(self, queries: DataFrame, nprobe: int | None) -> DataFrame:
        """(qid, pair, list, cell): the nprobe lists nearest to each query and its pair's unlisted one; all lists if None, or for a query without direction."""
        d = queries.select("qid", *PAIR, "query_vector", norm(F.col("query_vector")).alias("_qn")).join(self.centroids(), list(PAIR))
        d = d.select("qid", *PAIR, "list", "_qn", cosine_distance(F.col("centroid"), F.col("query_vector")).alias("_d"))
        d = d.withColumn("_rn", F.row_number().over(Window.partitionBy("qid").orderBy("_d", "list")))
        near = d if nprobe is None else d.where((F.col("_rn") <= nprobe) | (F.col("_qn") == 0))
        near = near.select("qid", *PAIR, "list").unionByName(queries.select("qid", *PAIR, F.lit(UNLISTED).alias("list")))
        return near.withColumn("cell", self._cell())

    def search(self, queries: DataFrame, now: Column, k: int, nprobe: int | None = 16, where: Column | None = None, facts: DataFrame | None = None) -> DataFrame:
        """(qid, id, distance, sem) as recall.semantic gives them, over the probed lists; exactly those if nprobe is None.

        Facts expired by now are left out; `where` needs `facts` to judge it by. What goes through the driver is a list of
        cells, at most as many as the index has.
        """
        probes = staged(self.probes(queries, nprobe))
        cells = [r.cell for r in probes.select("cell").distinct().collect()]
        rows = self.rows(cells).where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
        if where is not None:
            rows = rows.join(facts.where(where).select(*PAIR, "id"), [*PAIR, "id"], "left_semi")
        d = probes.drop("cell").join(rows.select(*PAIR, "list", "id", "embedding"), [*PAIR, "list"])
        d = d.join(queries.select("qid", "query_vector"), "qid").select("qid", "id", cosine_distance(F.col("embedding"), F.col("query_vector")).alias("distance"))
        near = d.withColumn("_rn", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))).where(F.col("_rn") <= k)
        return near.select("qid", "id", "distance", similarity(F.col("distance")).alias("sem"))

    def searcher(self, nprobe: int | None = 16) -> Callable[..., DataFrame]:
        """For recall's vector_search."""
        return lambda queries, facts, now, k, where=None: self.search(queries, now, k, nprobe, where, facts)
