"""The most similar vectors of every vector, by an inverted multi-index or a scan of all pairs.

How many entries a query must see is measured: of a sample of vectors the true neighbours are found among all, and the
index searches as far as RECALL of them lie. Where that is so far that comparing all pairs costs less, all are compared, and
the result is exact; vectors without clusters leave an index nothing to skip.

Vectors are scaled to length one and cut in two halves, each quantised by its own k-means (fitted on a bounded sample). A cell
is a pair of centroids. A query visits cells in the order of its summed distance to both centroids, taken from a heap, until
the cells hold enough entries; those are ranked by their exact cosines. Exact copies are one entry; they come back as the
nearest neighbours that they are, the lowest ids first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .common import arrow_map, maybe_broadcast

#: Rows that the centroids are fitted on.
SAMPLE = 20_000
#: Entries that a cell has on average, and those that a query's cells hold together at least, however few would do.
CELL_ENTRIES, CANDIDATES = 50, 500
#: Vectors whose true neighbours are looked up, and the share of these that the index must reach.
PROBES, RECALL = 400, 0.97
#: Comparing with this many entries in a scan costs about as much as with one in the index.
SCAN_GAIN = 100
#: Entries of a block of the scan.
SCAN_BLOCK = 10_000
#: Centroids of a half at most; more vectors then make larger cells.
MOST_CENTROIDS = 1024
#: Entries, and queries, of a cell that one task compares.
BLOCK = 2000


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, c).argmin(1)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c.astype(np.float32)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


def _unit(blobs: list[bytes], size: int) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), np.float32).reshape(-1, size).astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def usable(vectors: DataFrame, size: int) -> DataFrame:
    """vec_id and vectors of those of the given size that aren't all zero and have no NULL, NaN or infinite member."""
    fine = F.coalesce((F.size("vectors") == size) & F.forall("vectors", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vectors", lambda x: x != 0), F.lit(False))
    return vectors.select("vec_id", "vectors").where(F.col("vec_id").isNotNull() & fine)


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        blobs = [np.asarray(v, np.float32).tobytes() for v in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blobs, pa.binary())], names=["vec_id", "blob"])


def _visits(centroids: tuple[np.ndarray, np.ndarray], counts: np.ndarray, enough: int, size: int):
    """Rows (cell, vec_id, blob, entry): a vector as an entry of its own cell, and as a query of each cell that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ca, cb = centroids
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, blobs = batch.column(0), batch.column(1).to_pylist()
            x = _unit(blobs, size)
            da, db = _distances(x[:, : size // 2], ca), _distances(x[:, size // 2 :], cb)
            oa, ob = da.argsort(1, kind="stable"), db.argsort(1, kind="stable")
            cells, rows, entry = [], [], []
            for i in range(len(x)):
                a, b, da_i, db_i = oa[i].tolist(), ob[i].tolist(), da[i], db[i]
                cells.append(a[0] * len(cb) + b[0])
                rows.append(i)
                entry.append(True)
                heap, seen, held = [(float(da_i[a[0]] + db_i[b[0]]), 0, 0)], {(0, 0)}, 0
                while heap and held < enough:
                    _, p, q = heapq.heappop(heap)
                    cell = a[p] * len(cb) + b[q]
                    if counts[cell]:
                        held += int(counts[cell])
                        cells.append(cell)
                        rows.append(i)
                        entry.append(False)
                    for s, t in ((p + 1, q), (p, q + 1)):
                        if s < len(a) and t < len(b) and (s, t) not in seen:
                            seen.add((s, t))
                            heapq.heappush(heap, (float(da_i[a[s]] + db_i[b[t]]), s, t))
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), ids.take(take), batch.column(1).take(take), pa.array(entry)], names=["cell", "vec_id", "blob", "entry"])

    return run


def _cells(centroids, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ca, cb = centroids
        for b in batches:
            if b.num_rows:
                x = _unit(b.column(0).to_pylist(), size)
                cell = _distances(x[:, : size // 2], ca).argmin(1) * len(cb) + _distances(x[:, size // 2 :], cb).argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32))], names=["cell"])

    return run


def _compare(k: int, least: float, size: int):
    """Of each query of a block its k nearest entries of the block with a cosine of at least least."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        e, q = rows[rows["entry"]], rows[~rows["entry"]]
        out_q, out_e, out_c = [], [], []
        if len(e) and len(q):
            x, ids, asked = _unit(e["blob"].tolist(), size).astype(np.float64), e["vec_id"].to_numpy(), q["vec_id"].to_numpy()
            for at in range(0, len(q), 500):
                c = _unit(q["blob"].tolist()[at : at + 500], size).astype(np.float64) @ x.T
                c[asked[at : at + 500, None] == ids[None, :]] = -2
                top = np.argsort(-c, axis=1, kind="stable")[:, :k] if c.shape[1] > k else np.tile(np.arange(c.shape[1]), (len(c), 1))
                best = np.take_along_axis(c, top, 1)
                i, j = np.nonzero(best >= max(least, -1.5))
                out_q.append(asked[at : at + 500][i])
                out_e.append(ids[top[i, j]])
                out_c.append(best[i, j])
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pd.DataFrame({"query": cat(out_q, np.int64), "other": cat(out_e, np.int64), "cosine": cat(out_c, float)})

    return run


def _top(x: np.ndarray, y: np.ndarray, x_ids: np.ndarray, y_ids: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, cosine): the k rows of y nearest to each of x, ties by id, without the same id; cosines of at least least."""
    out = []
    step = max(1, -(-len(y) // max(64, 4 * k)))
    starts = np.arange(0, len(y), step)
    for at in range(0, len(x), 500):
        c = x[at : at + 500] @ y.T
        bound = np.full(len(c), least)
        if len(starts) > k + 1:  # k + 1 parts have a maximum of at least this; one of those may be the vector itself
            bound = np.maximum(bound, np.partition(np.maximum.reduceat(c, starts, axis=1), len(starts) - k - 1, axis=1)[:, len(starts) - k - 1])
        i, j = np.nonzero(c >= (bound - 1e-5)[:, None].astype(np.float32))
        other = x_ids[at + i] != y_ids[j]
        i, j = at + i[other], j[other]
        exact = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[i[s : s + 20_000]].astype(np.float64), y[j[s : s + 20_000]].astype(np.float64)) for s in range(0, len(i), 20_000))])
        order = np.lexsort((y_ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = (rank < k) & (exact >= least)
        out.append((i[keep], j[keep], exact[keep]))
    return tuple(np.concatenate([o[n] for o in out]) if out else np.zeros(0, t) for n, t in enumerate((int, int, float)))


def _scan_block(k: int, least: float, size: int):
    """Of each vector of a pair of blocks its k nearest in the other one (in its own, if both are the same)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows["a"].iloc[0], rows["b"].iloc[0]
        sides = {at: (_unit(r["blob"].tolist(), size), r["vec_id"].to_numpy()) for at, r in rows.groupby("own")}
        out = []
        for p, q in {(a, b), (b, a)}:
            if p in sides and q in sides:
                (x, xi), (y, yi) = sides[p], sides[q]
                i, j, c = _top(x, y, xi, yi, k, least)
                out.append(pd.DataFrame({"query": xi[i], "other": yi[j], "cosine": c}))
        return pd.concat(out) if out else pd.DataFrame({"query": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "cosine": np.zeros(0)})

    return run


def _scan(groups: DataFrame, n: int, k: int, least: float, size: int) -> DataFrame:
    """(query, other, cosine) from all pairs of blocks: exact."""
    blocks = -(-n // SCAN_BLOCK)
    own = groups.select(F.col("rep").alias("vec_id"), "blob", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("own"))
    pairs = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = pairs.select(F.least("own", "with").alias("a"), F.greatest("own", "with").alias("b"), "own", "vec_id", "blob")
    return pairs.groupBy("a", "b").applyInPandas(_scan_block(k, least, size), "query bigint, other bigint, cosine double")


def _probe(ids: np.ndarray, x: np.ndarray, centroids, k: int, least: float, size: int):
    """Rows (query, cell, cosine, other): the k nearest entries of a partition to each of x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ca, cb = centroids
        for b in batches:
            if not b.num_rows:
                continue
            y, y_ids = _unit(b.column(1).to_pylist(), size), b.column(0).to_numpy()
            i, j, c = _top(x, y, ids, y_ids, k, least)
            cell = _distances(y[:, : size // 2], ca).argmin(1) * len(cb) + _distances(y[:, size // 2 :], cb).argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(cell[j].astype(np.int32)), pa.array(c), pa.array(y_ids[j])], names=["query", "cell", "cosine", "other"])

    return run


def _enough(groups: DataFrame, ids: np.ndarray, x: np.ndarray, centroids, counts: np.ndarray, k: int, least: float, size: int) -> int:
    """Entries that a query's cells must hold so that RECALL of the probes' true neighbours are among them."""
    near = arrow_map(groups.select("rep", "blob"), _probe(ids, x, centroids, k, least, size), "query int, cell int, cosine double, other bigint")
    best = Window.partitionBy("query").orderBy(F.desc("cosine"), "other")
    true = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "cell").toPandas()  # PROBES x k rows
    if not len(true):
        return CANDIDATES
    da, db = _distances(x[:, : size // 2], centroids[0]), _distances(x[:, size // 2 :], centroids[1])
    needed = []
    for i, cells in true.groupby("query")["cell"]:
        order = (da[i][:, None] + db[i][None, :]).ravel().argsort(kind="stable")
        before = np.empty(len(counts), np.int64)
        before[order] = np.cumsum(counts[order]) - counts[order]
        needed += (before[cells.to_numpy()] + 1).tolist()
    return max(CANDIDATES, int(np.quantile(needed, RECALL, method="higher")))


def _indexed(groups: DataFrame, centroids, counts: np.ndarray, candidates: int, k: int, least: float, size: int) -> DataFrame:
    """(query, other, cosine) from the cells that a query visits until they hold so many candidates."""
    visits = arrow_map(groups.select(F.col("rep").alias("vec_id"), "blob"), _visits(centroids, counts, candidates, size), "cell int, vec_id bigint, blob binary, entry boolean")
    visits = materialise(visits)
    blocks = visits.groupBy("cell").agg(F.count_if("entry").alias("e"), F.count_if(~F.col("entry")).alias("q"))
    blocks = blocks.select("cell", F.ceil(F.col("e") / BLOCK).cast("int").alias("e"), F.ceil(F.col("q") / BLOCK).cast("int").alias("q")).where("e > 0 AND q > 0")
    dealt = visits.join(maybe_broadcast(blocks, 16), "cell")
    own = F.pmod(F.xxhash64("vec_id"), F.when(F.col("entry"), F.col("e")).otherwise(F.col("q"))).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, if(entry, q, e) - 1)")))
    dealt = dealt.select("cell", F.when(F.col("entry"), F.col("own")).otherwise(F.col("other")).alias("eb"), F.when(F.col("entry"), F.col("other")).otherwise(F.col("own")).alias("qb"), "vec_id", "blob", "entry")
    return dealt.groupBy("cell", "eb", "qb").applyInPandas(_compare(k, least, size), "query bigint, other bigint, cosine double")


def nearest(vectors: DataFrame, k: int = 5, least: float = -1.0, size: int = 64, candidates: int | None = None, scan: bool = True) -> DataFrame:
    """(vec_id, neighbour, cosine, rank): the k nearest others of every usable vector, ties by id; only cosines of at least least.

    candidates: entries that the index looks at for a vector; by default as many as a measured recall of RECALL takes. Recall is
    that of the true neighbours with a cosine of at least least, so a high bound needs few. scan: whether all pairs may be
    compared instead where that costs less.

    Unusable vectors have no rows and are nobody's neighbours; equal rows are one; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    base = materialise(arrow_map(usable(vectors, size), _blobs, "vec_id bigint, blob binary").dropDuplicates(["vec_id"]))
    groups = materialise(base.groupBy("blob").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    n = groups.count()
    if not n:
        return spark.createDataFrame([], "vec_id bigint, neighbour bigint, cosine double, rank int")
    if scan and candidates is None and n <= CANDIDATES * SCAN_GAIN:
        near = _scan(groups, n, k, least, size)
    else:
        rows = groups.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("rep", "blob").collect()
        sample = _unit([bytes(r[1]) for r in rows], size)
        kk = int(max(1, min(MOST_CENTROIDS, round((n / CELL_ENTRIES) ** 0.5), len(sample))))
        centroids = _kmeans(sample[:, : size // 2], kk, 1), _kmeans(sample[:, size // 2 :], kk, 2)
        held = arrow_map(groups.select("blob"), _cells(centroids, size), "cell int").groupBy("cell").count().collect()  # MOST_CENTROIDS squared at most
        counts = np.zeros(len(centroids[0]) * len(centroids[1]), np.int64)
        for cell, m in held:
            counts[cell] = m
        if candidates is None:
            ids = np.array([r[0] for r in rows[:PROBES]], np.int64)
            candidates = _enough(groups, ids, sample[:PROBES], centroids, counts, k, least, size)
            scan = scan and candidates * SCAN_GAIN >= n
        else:
            scan = False
        near = _scan(groups, n, k, least, size) if scan else _indexed(groups, centroids, counts, candidates, k, least, size)
    # Copies: of a group's members only the k + 1 lowest ids can be anyone's neighbours; cosines of equal rank are compared rounded.
    first = Window.partitionBy("blob").orderBy("vec_id")
    low = base.join(groups.where("copies > 1").select("blob", "rep"), "blob").withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1).groupBy("rep").agg(F.collect_list("vec_id").alias("low"))
    low = materialise(low)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "other"))).where(F.col("rank") <= k).drop("rank")
    far = ranked.join(low.withColumnRenamed("rep", "other"), "other", "left").select(F.col("query").alias("rep"), F.explode(F.coalesce("low", F.array("other"))).alias("neighbour"), "cosine")
    copies = base.join(groups.where("copies > 1").select("blob", "rep"), "blob").select("vec_id", "rep")
    single = groups.where("copies = 1").select(F.col("rep").alias("vec_id"), "rep")
    pairs = copies.unionByName(single).join(far, "rep").select("vec_id", "neighbour", "cosine")
    if least <= 1.0:
        twins = copies.join(low, "rep").select("vec_id", F.explode("low").alias("neighbour"), F.lit(1.0).alias("cosine")).where("vec_id <> neighbour")
        pairs = pairs.unionByName(twins)
    best = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "neighbour")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
