"""Top-k search over vectors: a stated query set against all rows, in blocks.

Queries and candidates are each written in files of bounded rows in the shared folder. A task has one file of queries and
runs its share of the candidates' files past it, keeping k for each query; nothing is shuffled but its results, and neither
driver nor task holds more than a block of either side. Where there are fewer files of queries than cores, several tasks
share one and divide the candidates. The tasks' results are merged by query.

Rows that share a vec_id count once: as a query with the smallest of their vectors, as a candidate with the best score.
Vectors that are null, hold nulls or non-finite components, or have another length than the most common one (ties to the
shorter) take no part: there is no product of vectors of different lengths. Without candidates a query has no rows; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import discard, filesystem, materialise, prepare, shared_dir

#: Rows of a file of queries and of one of candidates, candidate rows that are scored at once, and partitions of a search.
QUERY_ROWS, FILE_ROWS, BLOCK, MOST_PARTITIONS = 4096, 1 << 16, 4096, 10_000


def usable(vectors: DataFrame, vec_id: str, embedding: str, zero: bool) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that take part, and their length."""
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if not zero:
        rows = rows.filter(F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().filter("n > 0").orderBy(F.desc("count"), "n").limit(1).collect()
    return (rows.filter(F.size("v") == sizes[0]["n"]), sizes[0]["n"]) if sizes else (rows.filter(F.lit(False)), 0)


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of distinct ids, ties to the smaller id: a partition bounds the score, then few are sorted."""
    while True:
        if len(ids) > k:
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= edge
            kept, found = ids[keep], scores[keep]
        else:
            kept, found = ids, scores
        order = np.lexsort((kept, -found))
        kept, found = kept[order], found[order]
        _, first = np.unique(kept, return_index=True)
        if len(first) == len(kept):
            return kept[:k], found[:k]
        first.sort()
        if len(first) >= k:
            return kept[first][:k], found[first][:k]
        # Repeated ids hid others: keep one row of each and select again.
        order = np.lexsort((-scores, ids))
        ids, scores = ids[order], scores[order]
        one = np.concatenate([[True], ids[1:] != ids[:-1]])
        ids, scores = ids[one], scores[one]


def written(df: DataFrame, prefix: str, rows: int) -> str:
    """df as Parquet files of at most so many rows in the shared folder."""
    path = shared_dir(df.sparkSession, prefix)
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return path


def part_files(uri: str) -> list[str]:
    system, path = filesystem(uri)
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("part-") and f.base_name.endswith(".parquet"))


def blocks_of(system: fs.FileSystem, path: str, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """ids, vectors and further columns of some thousand rows of a file at a time."""
    with pq.ParquetFile(path, filesystem=system) as file:
        for b in file.iter_batches(BLOCK):
            if b.num_rows:
                more = [b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names if c not in ("vec_id", "v")]
                yield b.column("vec_id").to_numpy(), matrix(b.column("v"), dim), more


def in_blocks(spark: SparkSession, queries: str, candidates: str, dim: int, k: int, score_type: str, prefix: str, scorer: Callable) -> DataFrame:
    """query_id, rank, vec_id and score of tables written as files. scorer(query matrix, further columns) gives a function
    of (candidate ids, matrix, further columns) to blocks of (position of the query, candidate ids, scores)."""
    schema = f"query_id long, vec_id long, score {score_type}"
    kind = {"long": pa.int64(), "double": pa.float64()}[score_type]
    asked, sides = len(part_files(queries)), len(part_files(candidates))
    shares = max(1, min(sides, -(-2 * spark.sparkContext.defaultParallelism // max(1, asked))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(queries)
        for batch in batches:
            for number in batch.column("id").to_pylist():
                parts = [*blocks_of(system, part_files(queries)[number // shares], dim)]
                if not parts:
                    continue
                q_ids, q = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                score = scorer(q, [np.concatenate(x) for x in zip(*(p[2] for p in parts), strict=True)])
                kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                for path in part_files(candidates)[number % shares :: shares]:
                    for block in blocks_of(system, path, dim):
                        for at, ids, scores in score(*block):
                            others = ids != q_ids[at]
                            ids, scores = ids[others], scores[others]
                            if at in kept:
                                ids, scores = np.concatenate([kept[at][0], ids]), np.concatenate([kept[at][1], scores])
                            kept[at] = best(ids, scores, k)
                if kept:
                    sizes = [len(ids) for ids, _ in kept.values()]
                    columns = [np.repeat(q_ids[[*kept]], sizes), *(np.concatenate(x) for x in zip(*kept.values(), strict=True))]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), kind), strict=True)], ["query_id", "vec_id", "score"])

    n = asked * shares if sides else 0
    tasks = spark.range(0, n, 1, min(max(1, n), MOST_PARTITIONS))
    found = materialise(tasks.mapInArrow(run, schema), prefix).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def chosen(rows: DataFrame, every: int) -> DataFrame:
    """The queries, dealt out in as many partitions as they fill files, or as there are cores for: finding a query's cells
    takes longer than its row is large."""
    rows = rows.filter(F.col("vec_id") % every == 0)
    n = rows.count()
    parts = max(1, -(-n // QUERY_ROWS), min(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-n // 64)))
    # By a digest: dealing by vec_id again counts as done where the number of shuffle partitions is the same, and those get merged.
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).repartition(parts, F.xxhash64("vec_id"))


def term_at_a_time(dim: int, scale: float) -> Callable:
    """Scores by postings: each component that a query has scatters its weight times the postings' weights into a dense
    array of scores."""

    def scorer(q: np.ndarray, more: list) -> Callable:
        weights = np.floor(scale * q).astype(np.int64)
        terms = [(np.nonzero(w)[0].tolist(), w) for w in weights]

        def score(ids: np.ndarray, v: np.ndarray, more: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            values = np.floor(scale * v).astype(np.int64)
            postings = []
            for t in range(dim):
                rows = np.nonzero(values[:, t])[0]
                postings.append((slice(None) if len(rows) == len(ids) else rows, np.ascontiguousarray(values[rows, t])))
            scores = np.empty(len(ids), np.int64)
            for at, (own_terms, w) in enumerate(terms):
                scores[:] = 0
                for t in own_terms:
                    rows, posting = postings[t]
                    scores[rows] += w[t] * posting
                yield at, ids, scores.copy()

        return score

    return scorer


def exact_top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k candidates of the largest integer inner product for each query, a row whose vec_id is divisible by `every`.

    Components become floor(scale * x). Scores must fit 64 bits. See the module for what takes part.
    """
    spark = prepare(vectors.sparkSession)
    rows, dim = usable(vectors, vec_id, embedding, zero=True)
    return in_blocks(spark, written(chosen(rows, every), "top-k-queries", QUERY_ROWS), written(rows, "top-k-candidates", FILE_ROWS), dim, k, "long", "top-k", term_at_a_time(dim, scale))


EXACT_ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

#: Of the inverted multi-index: least and most centroids of each half (their number grows with the root of the rows'), vectors
#: that they are fitted on, rounds of fitting, the share of all entries that a query's cells hold together, and their least
#: number. The share is what vectors without any clusters need for a recall of 0.9; clustered ones need less.
CENTROIDS, SAMPLE, ROUNDS, VISIT, VISIT_LEAST = (16, 1024), 20_000, 12, 0.3, 1000


def k_means(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centroids by farthest-first starts and Lloyd's rounds, without chance."""
    k = min(k, len(np.unique(x, axis=0)))
    centres = [x[int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))]]
    gap = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        centres.append(x[int(np.argmax(gap))])
        gap = np.minimum(gap, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        near = nearest(x, c)
        for j in range(len(c)):
            if (mine := near == j).any():
                c[j] = x[mine].mean(0)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin(distances(x, c), 1)


def multi_sequence(left: np.ndarray, right: np.ndarray, counts: list[int], want: int) -> float:
    """Goes through the cells, left * len(right) + right, by ascending sum of distances until they hold `want` entries; gives
    the last sum. All cells up to it are visited.

    The heap holds, for each left centroid reached, its next right centroid; a left centroid enters when the one before
    it, in order of distance, gives its first pair.
    """
    a, b = np.argsort(left, kind="stable").tolist(), np.argsort(right, kind="stable").tolist()
    x, y, n = left[a].tolist(), right[b].tolist(), len(right)
    heap, last, got = [(x[0] + y[0], 0, 0)], 0.0, 0
    while heap and got < want:
        last, i, j = heap[0]
        got += counts[a[i] * n + b[j]]
        if j + 1 < n:
            heapq.heapreplace(heap, (x[i] + y[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if not j and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return last


def nearest_neighbours(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding", centroids: int | None = None, visit: float = VISIT) -> DataFrame:
    """The k candidates found of the largest cosine for each query, a row whose vec_id is divisible by `every`.

    An inverted multi-index on unit vectors: centroids of both halves are fitted on about SAMPLE vectors, chosen by a
    digest; every row is entered under its pair of nearest centroids, and the entries are written in the order of their
    cells. A query goes through the pairs by summed distance until they hold the share `visit` of all entries and
    VISIT_LEAST at least; of each file it reads the rows of those cells alone and reranks them by the cosine of the original
    vectors in double precision. Zero vectors take no part either; see the module.
    """
    spark = prepare(vectors.sparkSession)
    rows, dim = usable(vectors, vec_id, embedding, zero=False)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    least, most = CENTROIDS
    centroids = centroids or min(max(round(1.5 * math.sqrt(n)), least), most)
    first, second = fitted(rows, n, dim, centroids)
    half, cells = max(1, dim // 2), len(first) * len(second)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = unit(matrix(b.column("v"), dim)) if b.num_rows else np.zeros((0, dim))
            cell = nearest(v[:, :half], first) * len(second) + nearest(v[:, half:], second)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cell.astype(np.int32))], ["vec_id", "v", "cell"])

    entered = materialise(rows.mapInArrow(enter, "vec_id long, v array<double>, cell int"), "multi-index-rows")
    counts = [0] * cells
    for r in entered.groupBy("cell").count().collect():  # at most the most centroids squared
        counts[r["cell"]] = r["count"]
    # By cell, and, as a cell may hold any share of the rows, by id within it.
    parts = max(spark.sparkContext.defaultParallelism, -(-n // FILE_ROWS))
    order = ("cell", "vec_id")
    index = written(entered.repartitionByRange(parts, *order).sortWithinPartitions(*order), "multi-index", FILE_ROWS)
    discard(entered)
    want = max(math.ceil(visit * n), VISIT_LEAST)

    def halves(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = unit(v)
        return distances(u[:, :half], first), distances(u[:, half:], second)

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reach = [multi_sequence(x, y, counts, want) for x, y in zip(*halves(matrix(b.column("v"), dim)), strict=True)] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(reach, pa.float64())], ["vec_id", "v", "reach"])

    def scorer(q: np.ndarray, more: list[np.ndarray]) -> Callable:
        left, right = halves(q)
        # Sums of distances differ in their last bits by how many are computed at once.
        reach = more[0] * (1 + 1e-9) + 1e-12
        closest, norms = right.min(1), np.sqrt((q * q).sum(1))

        def score(ids: np.ndarray, v: np.ndarray, more: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            starts = np.flatnonzero(np.concatenate([[True], np.diff(more[0]) != 0]))
            sizes = np.diff(np.concatenate([starts, [len(ids)]]))
            a, b = np.divmod(more[0][starts], len(second))
            inner = np.sqrt((v * v).sum(1))
            for at in np.flatnonzero(left[:, np.unique(a)].min(1) + closest <= reach).tolist():
                cells = np.flatnonzero(left[at, a] + right[at, b] <= reach[at])
                if not len(cells):
                    continue
                ends = np.cumsum(sizes[cells])
                m = np.arange(ends[-1]) + np.repeat(starts[cells] - ends + sizes[cells], sizes[cells])
                if len(m) > 8 * k:
                    # Repeated ids and the query's own row can fill some places of the rough choice.
                    rough = (v[m] @ q[at]) / inner[m]
                    edge = np.partition(rough, len(m) - 4 * k)[len(m) - 4 * k]
                    keep = m[rough >= edge - 1e-9 * abs(edge)]
                    if len(np.unique(ids[keep])) > k:
                        m = keep
                # One sum after another for each pair, so that equal vectors have equal scores.
                yield at, ids[m], (v[m] * q[at]).sum(1) / (inner[m] * norms[at])

        return score

    asked = chosen(rows, every).mapInArrow(traverse, "vec_id long, v array<double>, reach double")
    return in_blocks(spark, written(asked, "multi-index-queries", QUERY_ROWS), index, dim, k, "double", "neighbours", scorer)


def fitted(rows: DataFrame, n: int, dim: int, centroids: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of both halves of the unit vectors, from rows whose digest falls below a threshold."""
    digest = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1_000_000))
    sample = rows.filter(digest < math.ceil(min(1.0, SAMPLE / n) * 1_000_000)).select("v").limit(2 * SAMPLE).toArrow()
    if not sample.num_rows:  # few different rows, none of them below it
        sample = rows.select("v").limit(SAMPLE).toArrow()
    x = unit(matrix(sample.column("v").combine_chunks(), dim))
    x = x[np.lexsort(x.T[::-1])]  # whatever order the rows came in
    half = max(1, dim // 2)
    return k_means(x[:, :half], centroids, ROUNDS), k_means(x[:, half:], centroids, ROUNDS) if dim > half else np.zeros((1, 0))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that huge and tiny components neither overflow nor vanish."""
    v = v / np.abs(v).max(1, keepdims=True) if len(v) else v
    return v / np.sqrt((v * v).sum(1, keepdims=True))
