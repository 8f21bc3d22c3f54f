"""Exact top-k by integer inner product, with MaxScore over shards.

The vectors are dealt into shards. A shard is an inverted index: a term is a
component's place, its postings are the vectors whose component isn't zero,
and its bounds are the extremes of these components. For a query the terms are
ordered by the most that each can add. From a first set of well-placed vectors
comes a threshold: the k-th best score so far. The terms at the end of the order
that together can't reach it are non-essential: a vector in none of the other,
essential postings can't get in. The essential postings are traversed, and the
remaining terms are probed for the vectors that can still reach the threshold,
which rises on the way. The shards' lists are merged per query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
SCALE = 256
#: Vectors of a shard, and queries that are taken to it at once.
SHARD = 8_192
QUERIES = 2_048
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)


def whole(values: list[float], scale: int = SCALE) -> list[int]:
    """floor(scale * x) as unbounded integers."""
    return [math.floor(v * scale) if abs(v) < 1e300 else int(v) * scale for v in values]


class Shard:
    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.columns = np.ascontiguousarray(rows.T)
        self.postings = [np.flatnonzero(c) for c in self.columns]
        self.high, self.low = rows.max(0), rows.min(0)  # 0 among them where a vector lacks the term
        self.by_value = np.argsort(self.columns, axis=1, kind="stable")

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best vectors but those of ``query_id``; ties to the smaller id."""
        n = len(self.ids)
        other = self.ids != query_id
        ends = np.stack([query * self.high, query * self.low])
        upper, lower = np.maximum(ends.max(0), 0), np.minimum(ends.min(0), 0)
        terms = np.argsort(-upper, kind="stable")
        terms = terms[query[terms] != 0]
        rest_up = np.concatenate([np.cumsum(upper[terms][::-1])[::-1], [0]])
        rest_low = np.concatenate([np.cumsum(lower[terms][::-1])[::-1], [0]])
        threshold = self._start(query, terms[:8], other, k)

        essential = int(np.argmax(rest_up < threshold)) if (rest_up < threshold).any() else len(terms)
        score, met = np.zeros(n), np.zeros(n, bool)
        for t in terms[:essential]:
            docs = self.postings[t]
            if len(docs) == n:
                score += query[t] * self.columns[t]
                met[:] = True
            else:
                score[docs] += query[t] * self.columns[t][docs]
                met[docs] = True
        if essential == len(terms):
            met[:] = True  # no bound holds anything back: a vector without any of the terms scores 0
        live = np.flatnonzero(met & other & (score + rest_up[essential] >= threshold))
        done = essential
        while done < len(terms) and len(live):
            step = terms[done : done + 4]
            score[live] += self.rows[np.ix_(live, step)] @ query[step]
            done += len(step)
            if len(live) > k:
                sure = score[live] + rest_low[done]
                threshold = max(threshold, np.partition(sure, len(live) - k)[len(live) - k])
            live = live[score[live] + rest_up[done] >= threshold]
        if len(live) > k:
            last = np.partition(score[live], len(live) - k)[len(live) - k]
            live = live[score[live] >= last]
        live = live[np.lexsort((self.ids[live], -score[live]))][:k]
        return live, score[live]

    def _start(self, query: np.ndarray, terms: np.ndarray, other: np.ndarray, k: int) -> float:
        """The k-th best score of the vectors in the best places of the first terms' postings."""
        first = [self.by_value[t][-32:] if query[t] > 0 else self.by_value[t][:32] for t in terms]
        docs = np.unique(np.concatenate([np.zeros(0, np.int64), *first]))
        docs = docs[other[docs]]
        if len(docs) < k:
            return -np.inf
        return np.partition(self.rows[docs] @ query, len(docs) - k)[len(docs) - k]


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for i, v in enumerate(lists.to_pylist()):
        out[i, : len(v)] = v
    return out


def _exact(ids: list[int], rows: list[list[int]], query_id: int, query: list[int], k: int) -> list[tuple[int, int]]:
    """The same by unbounded integers, for components that doubles can't hold products of."""
    scored = [(-sum(a * b for a, b in zip(query, r, strict=False)), i) for i, r in zip(ids, rows, strict=True) if i != query_id]
    return [(i, -s) for s, i in sorted(scored)[:k]]


def search_shard(vectors: pa.Table, queries: pa.Table, k: int, in_doubles: bool) -> pa.Table:
    """Each query's best vectors of one shard."""
    names = ["query", "query_id", "vec_id", "score", "exact"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    out: list[list] = [[] for _ in names]
    if len(vectors) and len(queries):
        ids, numbers, query_ids = vectors["id"].to_numpy(), queries["query"].to_pylist(), queries["id"].to_pylist()
        rows_list, queries_list = vectors["vector"].combine_chunks(), queries["vector"].combine_chunks()
        width = int(max(np.diff(rows_list.offsets.to_numpy()).max(), np.diff(queries_list.offsets.to_numpy()).max()))
        if in_doubles:
            rows, asked = (np.floor(_matrix(x, width) * SCALE) for x in (rows_list, queries_list))
            shard = Shard(ids, rows)
            found = [[(int(ids[p]), int(s)) for p, s in zip(*shard.best(i, q, k), strict=True)] for i, q in zip(query_ids, asked, strict=True)]
        else:
            exact_rows = [whole(v) for v in rows_list.to_pylist()]
            found = [_exact(ids.tolist(), exact_rows, i, whole(v), k) for i, v in zip(query_ids, queries_list.to_pylist(), strict=True)]
        for number, query_id, best in zip(numbers, query_ids, found, strict=True):
            for vec_id, score in best:
                # an order of text that is the order of numbers, beyond 64 bits too
                shown = "" if in_doubles else f"{score + (1 << 2200):0600x}"
                for column, value in zip(out, (number, query_id, vec_id, min(max(score, -(1 << 63)), (1 << 63) - 1), shown), strict=True):
                    column.append(value)
    return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    shard: int = SHARD,
    block: int = QUERIES,
) -> DataFrame:
    """Each query's ``k`` best vectors: query_id, rank (from 1), vec_id, score.

    Components are floor(256 * x); shorter vectors count as if filled up with
    zeros. Rows of the query's own id are no candidates; ties go to the smaller
    id. Rows with a NULL id, a NULL vector or NULL or non-finite components take
    no part. Repeated rows are candidates each; a repeated query (id and vector
    alike) is asked once, and one id with several vectors is ranked for each of them.
    Scores beyond 64 bits are ranked exactly and shown as the nearest long. No
    queries or no candidates, no rows. Other columns are left out.
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(
        F.col("id").isNotNull() & F.coalesce(finite, F.lit(False))
    )
    rows, asked = clean(vectors), clean(queries).distinct()
    largest = F.max(F.array_max(F.transform("vector", lambda x: F.abs(x))))
    size = rows.union(asked).agg(largest.alias("value"), F.max(F.size("vector")).alias("width")).first()
    n_shards, n_blocks = max(1, -(-rows.count() // shard)), max(1, -(-asked.count() // block))
    most = min(size["value"] or 0.0, EXACT) * SCALE + 1
    in_doubles = most * most * max(1, size["width"] or 0) < EXACT
    number = F.xxhash64("id", "vector")
    each = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    # Each block of queries meets each shard once; both are of bounded size, and equal rows are dealt out too.
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_shards))).withColumn("block", F.explode(each(n_blocks)))
    asked = asked.withColumns({"query": number, "block": F.pmod(number, F.lit(n_blocks))}).withColumn("shard", F.explode(each(n_shards)))
    schema = "query long, query_id long, vec_id long, score long, exact string"
    pairs = rows.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
    found = pairs.applyInArrow(lambda left, right: search_shard(left, right, k, in_doubles), schema)
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("exact"), F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
