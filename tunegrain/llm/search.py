"""Exact inner-product search by exhaustive term-at-a-time accumulation.

Candidates lie in blocks of postings: for each term (component) the places that hold it and their weights. Queries
are sparse rows. For a tile of queries and a block of candidates the weights of one term after the
other are scattered, times the queries' own, into a dense array of scores; partition selection takes
the best of each row, and what blocks and tasks have found is merged by score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunegrain.operators.ranking import with_rank
from tunegrain.runtime import materialize, new_folder

TOP = 5
EVERY = 50
SCALE = 256
CANDIDATE_ROWS, QUERY_ROWS = 2048, 1024  # rows of a block
BLOCK_WEIGHTS = 1 << 17  # and its weights, unless one row alone has more
CHUNK_BLOCKS = 16  # query blocks that are broadcast together: 26 MB at the most
TILE = 64


_BLOCK = "first long, ids array<long>, rows array<long>, terms array<int>, sizes array<int>, places array<int>, weights array<double>"


def usable(vector: str = "embedding") -> Column:
    """Vectors that are not null and hold neither null nor non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def scaled(vector: str = "embedding", scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as a double; from 2 ** 53 on every double is whole."""

    def whole(x: Column) -> Column:
        y = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(y) < F.lit(float(1 << 53)), F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, whole)


def _cuts(sizes: np.ndarray, rows: int, weights: int) -> list[int]:
    """Ends of blocks of at most `rows` rows and `weights` weights; one row alone may have more."""
    ends, total, since = [], 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > since and (i - since >= rows or total + size > weights):
            ends.append(i)
            total, since = 0, i
        total += size
    return [*ends, len(sizes)]


def _postings(vectors: pa.ListArray, order: np.ndarray):
    """terms, sizes, places and weights of some rows: for each term the places in `order` that hold it, ascending.

    A term that more than half of the rows hold has a weight for every row, zeros among them, and no places.
    """
    offsets = np.asarray(vectors.offsets).astype(np.int64)
    values = np.asarray(vectors.values)
    lengths = (offsets[1:] - offsets[:-1])[order]
    place = np.repeat(np.arange(len(order)), lengths)
    term = np.arange(len(place)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    weight = values[np.repeat(offsets[:-1][order], lengths) + term]
    held = weight != 0
    place, term, weight = place[held], term[held], weight[held]
    by_term = np.argsort(term, kind="stable")
    place, term, weight = place[by_term], term[by_term], weight[by_term]
    terms, starts, counts = np.unique(term, return_index=True, return_counts=True)
    sizes, places, weights = [], [np.zeros(0, np.int64)], [np.zeros(0)]
    for a, n in zip(starts.tolist(), counts.tolist()):
        if 2 * n > len(order):
            dense = np.zeros(len(order))
            dense[place[a: a + n]] = weight[a: a + n]
            sizes.append(-1)
            weights.append(dense)
        else:
            sizes.append(n)
            places.append(place[a: a + n])
            weights.append(weight[a: a + n])
    return terms, sizes, np.concatenate(places), np.concatenate(weights)


def pack(vectors: DataFrame, rows: int, weights: int = BLOCK_WEIGHTS) -> DataFrame:
    """Rows (row, id, vector) as blocks of postings; within a block the rows ascend by id, null last."""

    def blocks(batches):
        for batch in batches:
            ids, numbers, column = (batch.column(c) for c in ("id", "row", "vector"))
            at = 0
            for end in _cuts(np.asarray(pa.compute.list_value_length(column)), rows, weights) if batch.num_rows else ():
                part = slice(at, end)
                known = np.asarray(ids.is_valid())[part]
                value = np.asarray(pa.compute.fill_null(ids, 0))[part]
                order = np.lexsort((value, ~known))
                terms, sizes, places, held = _postings(column, at + order)
                cells = (
                    int(numbers[at].as_py()), ids.take(pa.array(at + order)).to_pylist(), np.asarray(numbers)[part][order].tolist(),
                    terms, sizes, places, held,
                )
                kinds = (pa.int64(), *[pa.list_(t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())])
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)], names=_NAMES)
                at = end

    return vectors.select("row", "id", "vector").mapInArrow(blocks, _BLOCK)


_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]


class Postings:
    """A block read back: ids, rows and for each term its places (None: every row) and weights."""

    def __init__(self, cell):
        ids = cell("ids")
        self.known = np.asarray(ids.is_valid())
        self.ids = np.asarray(pa.compute.fill_null(ids, 0))
        self.rows = np.asarray(cell("rows"))
        places, weights = np.asarray(cell("places")), np.asarray(cell("weights"))
        self.largest = float(np.abs(weights).max(initial=0))
        self.terms: dict[int, tuple[np.ndarray | None, np.ndarray]] = {}
        p = w = 0
        for term, size in zip(cell("terms").to_pylist(), cell("sizes").to_pylist()):
            n = len(self.ids) if size < 0 else size
            self.terms[term] = (None if size < 0 else places[p: p + size], weights[w: w + n])
            p, w = p + max(size, 0), w + n
        self._typed: dict = {}

    def typed(self, kind):
        """The postings with weights of another type; whole numbers of any size for objects."""
        if kind not in self._typed:
            change = (lambda w: np.array([int(x) for x in w], object)) if kind is object else (lambda w: w.astype(kind))
            self._typed = {kind: {term: (places, change(w)) for term, (places, w) in self.terms.items()}}
        return self._typed[kind]


def score_type(queries: Postings, candidates: Postings):
    """The narrowest type in which all products and sums of two blocks are exact."""
    shared = len(queries.terms.keys() & candidates.terms.keys())
    bound = queries.largest * candidates.largest * shared
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object


def accumulate(queries: Postings, candidates: Postings, start: int, stop: int, kind) -> np.ndarray:
    """Scores of the queries `start` to `stop` against a block, term after term."""
    scores = np.zeros((stop - start, len(candidates.ids)), kind)
    others = candidates.typed(kind)
    for term, (rows, own) in queries.typed(kind).items():
        if term not in others:
            continue
        places, weights = others[term]
        if rows is None:
            at, own = slice(None), own[start:stop]
        else:
            a, b = np.searchsorted(rows, (start, stop))
            at, own = rows[a:b] - start, own[a:b]
        if not len(own):
            continue
        parts = np.multiply.outer(own, weights)
        if places is None:
            scores[at] += parts
        elif rows is None:
            scores[:, places] += parts
        else:
            scores[np.ix_(at, places)] += parts
    return scores


def select(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores by partition, ties to the smaller place; ascending."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.sort(np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]]))


class Best:
    """The best k candidates of each query of a block so far."""

    def __init__(self, queries: Postings, k: int):
        self.queries, self.k = queries, k
        self.found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(queries.ids)
        self.least = np.full(len(queries.ids), -np.inf, object)  # a row of k has to be reached

    def add(self, candidates: Postings) -> None:
        kind = score_type(self.queries, candidates)
        _, mine, own = np.intersect1d(self.queries.rows, candidates.rows, assume_unique=True, return_indices=True)
        for start in range(0, len(self.queries.ids), TILE):
            stop = min(start + TILE, len(self.queries.ids))
            scores = accumulate(self.queries, candidates, start, stop, kind)
            if kind is object:  # sums beyond a long are its limits
                scores = np.minimum(np.maximum(scores, -(1 << 63)), (1 << 63) - 1)
            inside = (mine >= start) & (mine < stop)
            scores[mine[inside] - start, own[inside]] = -np.inf  # a query is not its own candidate
            reached = scores >= self.least[start:stop].astype(kind)[:, None]
            reached &= scores > -np.inf
            for i in np.flatnonzero(reached.any(axis=1)).tolist():
                self._merge(start + i, np.flatnonzero(reached[i]), scores[i], candidates)

    def _merge(self, query: int, places: np.ndarray, scores: np.ndarray, candidates: Postings) -> None:
        places = places[select(scores[places], self.k)]
        new = scores[places].astype(np.int64), candidates.ids[places], candidates.known[places]
        score, ids, known = (np.concatenate(p) for p in zip(self.found[query], new))
        order = np.lexsort((ids, ~known, ~score))[: self.k]
        self.found[query] = score[order], ids[order], known[order]
        if len(order) == self.k:
            self.least[query] = int(score[order[-1]])

    def result(self) -> pa.RecordBatch:
        sizes = [len(f[0]) for f in self.found]
        score, ids, known = (np.concatenate([f[i] for f in self.found]) for i in range(3))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.queries.rows, sizes)), pa.array(np.repeat(self.queries.ids, sizes)), pa.array(ids, mask=~known), pa.array(score)],
            names=["query_row", "query_id", "vec_id", "score"],
        )


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        candidates, number = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda name, i=i: batch.column(name)[i].values
                block = batch.column("q_first")[i].as_py()
                if block not in best:
                    best[block] = Best(Postings(lambda name: cell(f"q_{name}")), k)
                if number != batch.column("first")[i].as_py():
                    candidates, number = Postings(cell), batch.column("first")[i].as_py()
                best[block].add(candidates)
        for part in best.values():
            yield part.result()

    return run


def top_products(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = TOP, scale: int = SCALE,
    chunk_blocks: int = CHUNK_BLOCKS, candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` highest inner products of floor(scale * x) for each query.

    Queries are the rows whose id is divisible by `every`; candidates all other rows, those with the query's id or
    vector among them. Ties go to the smaller id, null ids last. Rows without a usable vector take no part; of
    vectors of different lengths the shorter one ends in zeros, and an empty one scores 0. Each of several rows with one query id has its own
    result. Scores are exact; beyond a long they are its limits. An empty table, or one without queries, gives an empty table.

    Every candidate is scored, none is left out by an index. Queries are met chunk by chunk: a chunk of bounded size is broadcast, and a task keeps
    k rows for each of its queries, so what is merged does not depend on the number of candidates in a task.
    """
    spark = vectors.sparkSession
    used = vectors.filter(usable(vector)).select(F.col(id_column).cast("long").alias("id"), scaled(vector, scale).alias("vector"))
    stored = materialize(used.withColumn("row", F.monotonically_increasing_id()), "vectors")
    candidates = materialize(pack(stored, candidate_rows), "postings")
    queries = with_rank(pack(stored.filter(F.col("id") % every == 0), query_rows), ["first"], "number")
    queries = queries.select(*[F.col(c).alias(f"q_{c}") for c in _NAMES], F.floor(F.col("number") / chunk_blocks).alias("chunk"))
    chunks = queries.agg(F.coalesce(F.max("chunk"), F.lit(-1))).first()[0] + 1
    path = new_folder(spark, "products")
    schema = "query_row long, query_id long, vec_id long, score long"
    for chunk in range(max(1, chunks)):
        # chunk_blocks blocks of a bounded number of weights
        some = F.broadcast(queries.filter(F.col("chunk") == chunk))
        candidates.withColumn("chunk", F.lit(chunk).cast("long")).join(some, "chunk").mapInArrow(_search(k), schema).write.parquet(f"{path}/chunk={chunk}")
    found = spark.read.schema(schema).parquet(path)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


PRODUCTS_SQL = f"""
with vector as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), product as (
  select q.r, q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from vector q join vector c on q.r <> c.r where q.vec_id % {EVERY} = 0
)
select query_id, (row_number() over (partition by r order by score desc, vec_id))::int as rank, vec_id, score from product
qualify rank <= {TOP}
"""
