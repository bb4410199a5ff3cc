"""Exact top-k inner products by norm-bucketed retrieval.

All vectors are sorted by length and cut into buckets, longest first. A query with a lower bound
of its k-th best product needs, of a bucket, only vectors within a cosine threshold: the bound over
the query's length times that of the bucket's longest vector. Above one, the bucket is skipped.
Otherwise the threshold decides how candidates are found: a large one by coordinate (the component along
the query's largest axis must lie within an interval, a binary search in that coordinate's sorted
list), a small one by length (the bucket's first vectors, up to where the bound is out of reach).
Candidates are then verified by their exact integer products.

Buckets are searched in waves that grow, so that the bounds are high before most buckets are read;
queries go to the tasks in portions of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import NULL_ID, given_id, saved

#: vectors in a bucket; vectors in a partition of the sorted table, about
BUCKET, PARTITION = 2_048, 65_536
#: each wave reads so many times the buckets of all before
WAVE = 16
#: bytes of a portion of the queries (components as 64-bit numbers): broadcast, and held by the driver
PORTION_BYTES = 32 << 20
#: queries multiplied with a bucket at once
ROWS = 512
#: coordinates are tried from this local cosine threshold on ...
COORDINATE_FROM = 0.5
#: ... and used where they leave at most this share of the candidates by length
COORDINATE_SHARE = 0.125
#: for rounding in bounds; products themselves are exact
SLACK = 1e-9

PACKED = (
    "_part int, _bucket int, _dim int, _longest double, "
    "_ids array<long>, _norms array<long>, _codes array<long>, _slots array<int>"
)
QUERY = "_part int, _bucket int, _slot int, _dim int, _id long, _norm long, _codes array<long>"
FOUND = "_query int, _score long, _id long"


def integer_vectors(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(_id, _dim, _codes, _norm, _asks): whole-number components and their squared length.

    Vectors that are null, hold nulls or non-finite components, or have a squared length beyond
    63 bits are left out.
    """
    rows = vectors.select(
        F.coalesce(vectors[id_col].cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.coalesce(is_query, F.lit(False)).alias("_asks"),
        vectors[vector_col].cast("array<double>").alias("_vector"),
    )
    fits = F.forall("_vector", lambda v: F.coalesce(F.abs(v * scale) < F.lit(2.0**31.5), F.lit(False)))
    codes = F.when(fits, F.transform("_vector", lambda v: F.floor(v * scale)))
    square = F.aggregate("_codes", F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double"))
    norm = F.aggregate("_codes", F.lit(0).cast("long"), lambda total, v: total + v * v)
    return (
        rows.select("_id", "_asks", codes.alias("_codes"))
        .filter("_codes is not null")
        .filter(square < F.lit(2.0**62.9))
        .select("_id", F.size("_codes").alias("_dim"), "_codes", norm.alias("_norm"), "_asks")
    )


def _pack(bucket_rows: int):
    """Consecutive rows of one dimension as buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, bucket, held, dim = TaskContext.get().partitionId(), 0, [], None

        def packed(rows):
            table = pa.Table.from_batches(rows).combine_chunks()
            norms = table["_norm"].combine_chunks()
            slots = np.flatnonzero(np.asarray(table["_asks"].combine_chunks())).astype(np.int32)
            codes = table["_codes"].combine_chunks().flatten()
            lists = [table["_id"].combine_chunks(), norms, codes, pa.array(slots, pa.int32())]
            return pa.record_batch(
                [
                    pa.array([part], pa.int32()), pa.array([bucket], pa.int32()), pa.array([dim], pa.int32()),
                    pa.array([float(np.sqrt(float(norms[0].as_py())))], pa.float64()),
                    *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists),
                ],
                ["_part", "_bucket", "_dim", "_longest", "_ids", "_norms", "_codes", "_slots"],
            )

        for batch in batches:
            dims = np.asarray(batch.column(batch.schema.names.index("_dim")))
            at = 0
            while at < len(dims):
                if held and (dims[at] != dim or sum(len(x) for x in held) == bucket_rows):
                    yield packed(held)
                    bucket, held = bucket + 1, []
                dim = int(dims[at])
                room = bucket_rows - sum(len(x) for x in held)
                same = np.flatnonzero(dims[at : at + room] != dim)
                size = int(same[0]) if len(same) else min(room, len(dims) - at)
                held.append(batch.slice(at, size))
                at += size
        if held:
            yield packed(held)

    return run


def _lists(batch: pa.RecordBatch, row: int) -> dict[str, np.ndarray | int | float]:
    out = {}
    for name, column in zip(batch.schema.names, batch.columns):
        value = column[row]
        out[name] = np.asarray(value.values) if pa.types.is_list(column.type) else value.as_py()
    return out


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The queries of each bucket, one row each."""
    for batch in batches:
        for row in range(batch.num_rows):
            b = _lists(batch, row)
            slots, dim = b["_slots"], b["_dim"]
            n = len(slots)
            if not n:
                continue
            codes = b["_codes"].reshape(-1, dim)[slots] if dim else np.zeros((n, 0), np.int64)
            yield pa.record_batch(
                [
                    *(pa.array(np.full(n, b[c]), pa.int32()) for c in ("_part", "_bucket")),
                    pa.array(slots, pa.int32()), pa.array(np.full(n, dim), pa.int32()),
                    pa.array(b["_ids"][slots]), pa.array(b["_norms"][slots]),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(codes.ravel())),
                ],
                ["_part", "_bucket", "_slot", "_dim", "_id", "_norm", "_codes"],
            )


class Portion:
    """Some queries of one dimension: components, lengths, where each has its own row, and the
    bounds of their k-th best products (minus infinity: none yet)."""

    def __init__(self, numbers, codes, norms, own, bounds):
        self.numbers, self.codes, self.norms, self.own = numbers, codes, np.sqrt(norms.astype(float)), own
        self.bounds = bounds
        self.axis = np.abs(codes).argmax(axis=1) if codes.shape[1] else np.zeros(len(codes), int)

    def candidates_by_coordinate(self, asking, local, unit, order):
        """For queries with local cosine thresholds: (first, last) in the sorted list of each
        query's axis. ``order``: argsort per axis, filled as needed."""
        axis = self.axis[asking]
        along = self.codes[asking, axis] / self.norms[asking]
        local = np.clip(local - SLACK, 0.0, 1.0)
        reach = np.sqrt(np.maximum(0.0, 1 - along * along) * (1 - local * local))
        low = np.where(along > -local, along * local - reach, -1.0) - SLACK
        high = np.where(along < local, along * local + reach, 1.0) + SLACK
        first, last = np.zeros(len(asking), int), np.zeros(len(asking), int)
        for a in np.unique(axis):
            if a not in order:
                order[a] = np.argsort(unit[:, a], kind="stable")
            values, those = unit[order[a], a], axis == a
            first[those] = np.searchsorted(values, low[those], "left")
            last[those] = np.searchsorted(values, high[those], "right")
        return first, last


class Best:
    """The k best (score, id) so far of each query of a portion, within one task."""

    def __init__(self, bounds: np.ndarray, k: int):
        self.bounds, self.k = bounds.copy(), k
        self.held = [np.zeros(0, np.int64) for _ in range(3)]
        self.new: list[tuple] = []
        self.size = 0

    def add(self, query, score, ids):
        if len(query):
            self.new.append((query, score, ids))
            self.size += len(query)
            if self.size > 500_000:
                self.settle()

    def settle(self):
        if not self.new:
            return
        query, score, ids = (np.concatenate(x) for x in zip(self.held, *self.new))
        order = np.lexsort((ids, -score, query))  # squared lengths stay below 2**63, so -score exists
        query, score, ids = query[order], score[order], ids[order]
        edge = np.flatnonzero(np.diff(query, prepend=-1))
        rank = np.arange(len(query)) - np.repeat(edge, np.diff(np.append(edge, len(query))))
        keep, last = rank < self.k, rank == self.k - 1
        self.bounds[query[last]] = np.maximum(self.bounds[query[last]], score[last])
        self.held = [query[keep], score[keep], ids[keep]]
        self.new, self.size = [], 0


def _search_bucket(p: Portion, b: dict, best: Best, k: int) -> None:
    norms = np.sqrt(b["_norms"].astype(float))
    codes = b["_codes"].reshape(len(norms), -1)
    ids, longest = b["_ids"], norms[0]
    positive = best.bounds > 0
    reach = p.norms * longest
    asking = np.flatnonzero(~positive | (reach * (1 + SLACK) >= best.bounds))
    if not len(asking):
        return
    own = np.full(len(p.numbers), -1)
    here = (p.own[:, 0] == b["_part"]) & (p.own[:, 1] == b["_bucket"])
    own[here] = p.own[here, 2]

    # by length: the vectors before the first that is too short
    need = np.where(positive[asking], best.bounds[asking] / np.maximum(p.norms[asking], 1e-300) * (1 - SLACK), -1.0)
    prefix = len(norms) - np.searchsorted(norms[::-1], need, "left")
    # products are exact in a type that holds the largest possible one
    bound = float(p.norms[asking].max() * longest) * (1 + SLACK)
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64

    local = np.where(positive[asking], best.bounds[asking] / np.maximum(reach[asking], 1e-300), 0.0)
    tried = np.flatnonzero((local >= COORDINATE_FROM) & (prefix > 0))
    by_coordinate = np.zeros(len(asking), bool)
    if len(tried):
        unit, order = codes / np.maximum(norms, 1e-300)[:, None], {}
        first, last = p.candidates_by_coordinate(asking[tried], local[tried], unit, order)
        few = last - first <= COORDINATE_SHARE * prefix[tried]
        by_coordinate[tried[few]] = True
        for q, lo, hi in zip(asking[tried[few]].tolist(), first[few].tolist(), last[few].tolist()):
            rows = order[p.axis[q]][lo:hi]
            rows = rows[rows != own[q]]
            score = codes[rows] @ p.codes[q]
            good = score >= best.bounds[q]
            best.add(np.full(int(good.sum()), q), score[good], ids[rows[good]])

    dense = np.flatnonzero(~by_coordinate & (prefix > 0))
    dense = dense[np.argsort(prefix[dense], kind="stable")]
    typed = codes.astype(kind).T
    for at in range(0, len(dense), ROWS):
        block = dense[at : at + ROWS]
        q, width = asking[block], int(prefix[block].max())
        score = p.codes[q].astype(kind) @ typed[:, :width]
        good = score >= best.bounds[q][:, None]
        mine = np.flatnonzero((own[q] >= 0) & (own[q] < width))
        good[mine, own[q[mine]]] = False
        many = np.flatnonzero(good.sum(axis=1) > 4 * k)
        if len(many):  # the k-th best here is a bound already
            sure = np.where(good[many], score[many], np.iinfo(np.int64).min if kind is np.int64 else -np.inf)
            kth = np.partition(sure, width - k, axis=1)[:, width - k]
            good[many] &= score[many] >= kth[:, None]
        i, j = np.nonzero(good)
        best.add(q[i], score[i, j].astype(np.int64), ids[j])


def _searcher(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        portions = {p.codes.shape[1]: p for p in sent.value}
        bests = {dim: Best(p.bounds, k) for dim, p in portions.items()}
        for batch in batches:
            for row in range(batch.num_rows):
                b = _lists(batch, row)
                if b["_dim"] in portions:
                    _search_bucket(portions[b["_dim"]], b, bests[b["_dim"]], k)
                    bests[b["_dim"]].settle()
        for dim, best in bests.items():
            query, score, ids = best.held
            numbers = portions[dim].numbers[query]
            yield pa.record_batch(
                [pa.array(numbers, pa.int32()), pa.array(score, pa.int64()), pa.array(ids, pa.int64())],
                ["_query", "_score", "_id"],
            )

    return run


def _best_k(found: DataFrame, k: int) -> DataFrame:
    """(_query, _best): the k best of each query, best first; a group has at most k rows a task."""
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("_score")).alias("_less"), "_id")))
    return found.groupBy("_query").agg(F.slice(ranked, 1, k).alias("_best"))


def _portions(rows: pa.Table, bounds: dict[int, int], k: int) -> list[Portion]:
    numbers = np.arange(rows.num_rows, dtype=np.int32)
    column = {c: np.asarray(rows[c].combine_chunks()) for c in ("_part", "_bucket", "_slot", "_dim", "_norm")}
    start = np.full(rows.num_rows, -np.inf)
    for q, bound in bounds.items():
        start[q] = bound
    lists = rows["_codes"].combine_chunks()
    out = []
    for dim in np.unique(column["_dim"]):
        those = np.flatnonzero(column["_dim"] == dim)
        codes = np.asarray(lists.take(pa.array(those)).flatten()).reshape(len(those), dim)
        own = np.stack([column[c][those] for c in ("_part", "_bucket", "_slot")], axis=1)
        out.append(Portion(numbers[those], codes, column["_norm"][those], own, start[those]))
    return out


def top_products(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: float = 256.0, bucket_rows: int | None = None, partition_rows: int | None = None, portion_bytes: int | None = None,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row where ``is_query`` holds, the ``k`` other
    rows of ``vectors`` with the highest inner products of components floor(scale * x).

    Ties go to the smaller id, a null id before all. A query has fewer rows if there are
    fewer vectors. Rows are told apart, not ids: of repeated rows each is a query, and a candidate
    of the others. Vectors that are null, or hold null or non-finite components, take no part, nor do those
    with a squared length beyond 62.9 bits, whose products might not be longs. Vectors of
    different dimensions have no product. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bucket_rows, partition_rows = bucket_rows or BUCKET, partition_rows or PARTITION
    rows = integer_vectors(vectors, is_query, id_col, vector_col, scale)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // partition_rows))
    order = [F.col("_dim"), F.col("_norm").desc(), F.col("_id"), F.monotonically_increasing_id()]
    index = saved(
        rows.withColumn("_row", order.pop())
        .repartitionByRange(parts, *order, F.col("_row"))
        .sortWithinPartitions(*order, F.col("_row"))
        .drop("_row")
        .mapInArrow(_pack(bucket_rows), PACKED)
    )
    queries = saved(index.filter(F.size("_slots") > 0).mapInArrow(_ask, QUERY))
    size = queries.agg(F.count("*").alias("n"), F.sum(F.col("_dim") + 8).alias("components")).first()
    portions = max(1, -(-8 * (size["components"] or 0) // (portion_bytes or PORTION_BYTES)))
    portion = F.pmod(F.xxhash64("_part", "_bucket", "_slot"), F.lit(portions))
    results = [_search_portion(index, queries.filter(portion == n), parts, k) for n in range(portions) if size["n"]]
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out


def _search_portion(index: DataFrame, portion: DataFrame, parts: int, k: int) -> DataFrame:
    """Waves over the index for queries that fit the driver."""
    spark = index.sparkSession
    asked = portion.toArrow()
    waves, first = ["_part = 0 and _bucket = 0", "_part = 0 and _bucket > 0"], 1
    while first < parts:
        waves.append(f"_part >= {first} and _part < {first * WAVE}")
        first *= WAVE
    best, bounds = None, {}
    for wave in waves:
        sent = spark.sparkContext.broadcast(_portions(asked, bounds, k))
        found = index.filter(wave).mapInArrow(_searcher(sent, k), FOUND)
        if best is not None:
            held = best.select("_query", F.inline("_best")).select("_query", (-F.col("_less")).alias("_score"), "_id")
            found = found.unionByName(held)
        best = saved(_best_k(found, k))
        sent.unpersist()
        full = best.filter(F.size("_best") == k).select("_query", (-F.element_at("_best", k)["_less"]).alias("_bound"))
        table = full.toArrow()
        bounds = dict(zip(table["_query"].to_pylist(), table["_bound"].to_pylist()))
    names = spark.createDataFrame(
        pa.table({"_query": pa.array(range(asked.num_rows), pa.int32()), "_asker": asked["_id"].combine_chunks()}),
        "_query int, _asker long",
    )
    ranked = best.select("_query", F.posexplode("_best").alias("_at", "_hit"))
    return ranked.join(names, "_query").select(
        F.col("_asker").alias("query_id"), (F.col("_at") + 1).cast("int").alias("rank"),
        given_id("_hit._id").alias("vec_id"), (-F.col("_hit._less")).alias("score"),
    )


ORACLE = """
WITH vectors AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS codes
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), ranked AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.codes, v.codes)::BIGINT AS score
  FROM vectors AS q JOIN vectors AS v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id
), numbered AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
  FROM ranked
)
SELECT query_id, rank, vec_id, score FROM numbered WHERE rank <= 5
"""
