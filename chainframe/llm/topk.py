"""Exact top-k inner products with pruning.

Vectors are put into blocks by descending length, neighbouring blocks into groups. The longest vectors give each query a first floor,
its k-th best score among them. A block of queries is then sent only to groups in which length times length can reach a floor
of its own. There the blocks are met the longest first, so that a running k-th best score soon rules out whole
blocks. Within a block the leading coordinates after an SVD rotation give partial sums; by Cauchy-Schwarz the rest adds at
most the product of the remaining lengths. Only pairs that this bound cannot rule out are scored, in integers:
of 64 bits where the lengths show that these suffice, else of any width.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainframe.llm import common

BLOCK = 2048
QUERY_BLOCK = 512
#: Blocks of vectors that share one task's unit of work.
GROUP_BLOCKS = 8
#: Vectors that give the first floors, dimensions that get any, and the largest of these: the driver holds and sends no more than these.
LEAD_ROWS, LEAD_DIMS, LEAD_WIDTH = 256, 8, 4096
#: Pairs whose product of lengths is below this are scored without Python's integers; neither the score nor a partial sum can pass a long.
SAFE = float(1 << 62)
#: Stands for every score below the range; a score must lie between this and 2^63, both left out.
BELOW = -(1 << 63)


def quantised(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as doubles that hold it exactly; null for vectors that take no part."""
    x = F.col(vector).cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = lambda v: F.when(F.abs(v * scale) < F.lit(float(1 << 53)), F.floor(v * scale).cast("double")).otherwise(v * scale)
    return F.when(F.col(vector).isNotNull() & good, F.transform(x, whole))


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components one after the other, and where each vector begins and ends."""
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])


def _by_dim(batch: pa.RecordBatch):
    """(dimension, row numbers, ids, vectors) of the rows of each dimension."""
    rows_of, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "id"))
    flat, ends = _numbers(batch.column("v"))
    dims = np.diff(ends)
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        yield int(dim), rows_of[rows], ids[rows], flat[ends[rows][:, None] + np.arange(dim)] if dim else np.zeros((len(rows), 0))


def _lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths, also of components whose squares pass a double."""
    most = np.abs(x).max(1, initial=1.0)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(1))


def rotations(vectors: DataFrame, fan_in: int = 32) -> dict[int, np.ndarray]:
    """For each dimension an orthogonal matrix that puts the directions of most weight first.

    Sums X'X over all vectors: one matrix a task and dimension, added up in two steps; at most fan_in of each come to the driver.
    """

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, _, x in _by_dim(batch):
                x = x / np.maximum(1, np.abs(x).max(1, initial=0, keepdims=True) / (1 << 27))  # any rotation is right; long vectors mustn't overflow its sums
                total[dim] = total.get(dim, 0) + x.T @ x
        for dim, gram in total.items():
            yield pa.RecordBatch.from_pydict({"dim": [dim], "part": [int(np.abs(gram).sum()) % fan_in if gram.size else 0], "gram": [gram.tobytes()]}, schema=pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("gram", pa.binary())]))

    def add(key, table):
        grams = [np.frombuffer(x, float) for x in table["gram"].to_pylist()]
        return pa.table({"dim": [key[0].as_py()], "gram": [np.sum(grams, 0).tobytes()]}, schema=pa.schema([("dim", pa.int32()), ("gram", pa.binary())]))

    parts = vectors.select("row", "id", "v").mapInArrow(sums, "dim int, part int, gram binary")
    total: dict[int, np.ndarray] = {}
    for row in parts.groupBy("dim", "part").applyInArrow(add, "dim int, gram binary").collect():
        total[row.dim] = total.get(row.dim, 0) + np.frombuffer(row.gram, float).reshape(row.dim, row.dim)
    return {dim: np.linalg.svd(gram)[0] for dim, gram in total.items()}


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """(row, id, v, length2) -> blocks of vectors by descending length: dim, longest, n, rows, ids, ints."""
    by_length = vectors.repartitionByRange(common.partitions(vectors.sparkSession), F.desc("length2"), "row").sortWithinPartitions(F.desc("length2"), "row")

    def run(batches):
        schema = common.arrow_schema(schema_of)
        held: dict[int, tuple] = {}

        def out(dim, numbers, ids, x):
            if not np.isfinite(x).all():
                raise OverflowError("a component times the scale passes a double")
            longest = float(_lengths(x).max()) if dim else 0.0
            wide = bool(np.abs(x).max(initial=0) >= 1 << 31)
            return pa.RecordBatch.from_pydict({"dim": [dim], "longest": [longest], "n": [len(ids)], "rows": [numbers.astype("<i8").tobytes()], "ids": [ids.astype("<i8").tobytes()], "wide": [wide], "ints": [x.astype("<f8" if wide else "<i4").tobytes()]}, schema=schema)

        for batch in batches:
            for dim, *some in _by_dim(batch):
                if dim in held:
                    some = [np.concatenate(x) for x in zip(held[dim], some, strict=True)]
                while len(some[0]) >= rows:
                    yield out(dim, *(x[:rows] for x in some))
                    some = [x[rows:] for x in some]
                held[dim] = tuple(some)
        for dim, some in held.items():
            if len(some[0]):
                yield out(dim, *some)

    schema_of = common.T._parse_datatype_string("dim int, longest double, n int, rows binary, ids binary, wide boolean, ints binary")
    return by_length.select("row", "id", "v").mapInArrow(run, schema_of)


def _unpacked(rows: bytes, ids: bytes, ints: bytes, wide: bool, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    return np.frombuffer(rows, "<i8"), ids, np.frombuffer(ints, "<f8" if wide else "<i4").reshape(len(ids), dim).astype(float)


def _scores(q: np.ndarray, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two arrays of whole numbers, given each pair's product of lengths."""
    if bound.max(initial=0) < 1 << 52:  # neither the sum nor a part of it leaves a double's whole numbers
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    safe = bound < SAFE
    out = np.zeros(len(q), np.int64)
    out[safe] = np.einsum("ij,ij->i", q[safe].astype(np.int64), x[safe].astype(np.int64))
    for i in np.flatnonzero(~safe):
        score = sum(int(a) * int(b) for a, b in zip(q[i].tolist(), x[i].tolist(), strict=True))
        if score >= 1 << 63:
            raise OverflowError(f"a score of {score} does not fit a long")  # one of the best, as no lower score can displace it
        out[i] = max(score, BELOW)
    return out


def best(queries: tuple, block: tuple, floor: np.ndarray, turn: np.ndarray, k: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of every pair that can be among the k best, given each query's floor."""
    (q_rows, q), (rows, ids, x) = queries, block
    q_len, x_len = _lengths(q), _lengths(x)
    slack = 1e-6 * (1 + q_len[:, None] * x_len.max(initial=0))
    live = np.flatnonzero(~(q_len * x_len.max(initial=0) + slack[:, 0] < floor))
    if not len(live) or not len(ids):
        return (np.zeros(0, np.int64),) * 3
    q_turned, x_turned = q[live] @ turn, x @ turn
    rest = lambda a: _lengths(a[:, lead:])
    bound = q_turned[:, :lead] @ x_turned[:, :lead].T + np.outer(rest(q_turned), rest(x_turned)) + slack[live]
    bound[np.isnan(bound)] = np.inf  # beyond a double nothing is known
    bound[q_rows[live][:, None] == rows[None, :]] = -np.inf
    # the k largest lower bounds of this block raise the floor before anything is scored
    if len(ids) > k:
        low = bound - 2 * (np.outer(rest(q_turned), rest(x_turned)) + slack[live])
        low = np.partition(np.where(np.isfinite(bound) & np.isfinite(low), low, -np.inf), len(ids) - k, axis=1)[:, len(ids) - k]
        floor_now = np.maximum(floor[live], low)
    else:
        floor_now = floor[live]
    row, col = np.nonzero((bound >= floor_now[:, None]) & ~np.isneginf(bound))
    most = q_len[live[row]] * x_len[col]
    score = np.concatenate([_scores(q[live[row[i : i + 65536]]], x[col[i : i + 65536]], most[i : i + 65536]) for i in range(0, len(row), 65536)] or [np.zeros(0, np.int64)])
    return live[row], ids[col], score


def _keep(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each row's k best: highest score, then smallest id."""
    order = np.lexsort((ids, ~score, row))
    first = np.r_[True, row[order][1:] != row[order][:-1]] if len(order) else np.zeros(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else order
    return order[rank < k]


def _floors(found: tuple[np.ndarray, ...], n: int, k: int) -> np.ndarray:
    """Each query's k-th best score so far, or minus infinity."""
    least = np.full(n, np.inf)
    np.minimum.at(least, found[0], found[2].astype(float))
    return np.where(np.bincount(found[0], minlength=n) >= k, least, -np.inf)


def _with_needs(asks: DataFrame, leads: dict[int, tuple], turns, k: int, lead_share: float) -> DataFrame:
    """Adds floors (of each query) and need: the least length with which a vector can be among the k best of any query of the block."""
    sent = asks.sparkSession.sparkContext.broadcast(leads)
    struct = common.T.StructType([*asks.schema.fields, *common.T._parse_datatype_string("floors binary, need double").fields])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                rows, _, q = _unpacked(r["rows"], r["ids"], r["ints"], r["wide"], dim)
                floor = np.full(len(rows), -np.inf)
                if dim in sent.value:
                    with np.errstate(over="ignore", invalid="ignore"):
                        found = best((rows, q), sent.value[dim], floor, turns.value[dim], k, max(1, int(dim * lead_share)))
                    found = tuple(x[_keep(*found, k)] for x in found)
                    floor = _floors(found, len(rows), k)
                length = _lengths(q)
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(floor > 0, floor * (1 - 1e-6) / np.maximum(length, 1e-300) - 1, -np.inf)
                yield pa.RecordBatch.from_pylist([{**r, "floors": floor.tobytes(), "need": float(need.min())}], schema=common.arrow_schema(struct))

    return asks.mapInArrow(run, struct)


def top_k(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", lead_share: float = 0.25) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products; ties go to the smaller id.

    Vectors that are null or hold a null or non-finite component take no part; nor do null ids. Components may be of any
    size; a score among the best that doesn't fit a long (or is the least long) fails the query.
    Vectors of different length don't meet. A query meets every row but its own; rows repeated or under a repeated id all count, and
    each is a query of its own. An empty table gives an empty result; other columns are left out, whatever their names.
    """
    spark = df.sparkSession
    vectors = df.select(F.col(key).cast("long").alias("id"), quantised(vector).alias("v"), is_query.alias("is_query")).where("id is not null and v is not null")
    vectors = vectors.withColumn("length2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).withColumn("row", F.monotonically_increasing_id())
    with common.Scratch(spark) as scratch:
        vectors = scratch.table(vectors)
        turns = spark.sparkContext.broadcast(rotations(vectors))
        rows = scratch.table(blocks(vectors, BLOCK).withColumn("no", F.monotonically_increasing_id()))
        asks = blocks(vectors.where("is_query"), QUERY_BLOCK).withColumn("query_block", F.monotonically_increasing_id())
        first = rows.where(F.col("dim") <= LEAD_WIDTH).groupBy("dim").agg(F.min("no").alias("no")).orderBy("dim").limit(LEAD_DIMS)
        leads = {r.dim: tuple(x[:LEAD_ROWS] for x in _unpacked(r.rows, r.ids, r.ints, r.wide, r.dim)) for r in rows.join(F.broadcast(first), ["dim", "no"]).toLocalIterator()}
        asks = scratch.table(_with_needs(asks, leads, turns, k, lead_share))
        # blocks of one range of lengths, GROUP_BLOCKS at a time
        part = F.shiftright("no", 33) * F.lit(1 << 24) + F.floor(F.col("no").bitwiseAND(F.lit((1 << 33) - 1)) / GROUP_BLOCKS)
        x = rows.withColumn("part", part)
        groups = x.groupBy("dim", "part").agg(F.max("longest").alias("top"))
        # only numbers of blocks and lengths meet here; the blocks themselves go where these say
        sent = asks.select("dim", "query_block", "need").join(groups, "dim").where("top >= need").select("query_block", "part")
        q = sent.join(asks.select("dim", "query_block", "floors", *[F.col(c).alias(f"q_{c}") for c in ("rows", "ids", "wide", "ints")]), "query_block")
        pairs = x.select("dim", "part", "longest", "rows", "ids", "wide", "ints").join(q.hint("shuffle_hash"), ["dim", "part"])
        pairs = pairs.sortWithinPartitions("query_block", F.desc("longest"))

        def run(batches):
            schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
            now, found = None, None

            def done():
                if found is not None and len(found[0]):
                    yield pa.RecordBatch.from_pydict({"query": now[1][found[0]], "query_id": now[2][found[0]], "vec_id": found[1], "score": found[2]}, schema=schema)

            for batch in batches:
                for r in batch.to_pylist():
                    dim = r["dim"]
                    if now is None or now[0] != r["query_block"]:
                        yield from done()
                        now = (r["query_block"], *_unpacked(r["q_rows"], r["q_ids"], r["q_ints"], r["q_wide"], dim))
                        found, floor = (np.zeros(0, np.int64),) * 3, np.frombuffer(r["floors"], float)
                    block = _unpacked(r["rows"], r["ids"], r["ints"], r["wide"], dim)
                    with np.errstate(over="ignore", invalid="ignore"):
                        more = best((now[1], now[3]), block, floor, turns.value[dim], k, max(1, int(dim * lead_share)))
                    found = tuple(np.concatenate(p) for p in zip(found, more, strict=True))
                    found = tuple(p[_keep(*found, k)] for p in found)
                    floor = np.maximum(floor, _floors(found, len(floor), k))
            yield from done()

        found = pairs.select("dim", "query_block", "floors", "q_rows", "q_ids", "q_wide", "q_ints", "rows", "ids", "wide", "ints").mapInArrow(run, "query long, query_id long, vec_id long, score long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        fits = F.when(F.col("score") == F.lit(BELOW), F.raise_error(F.lit("a score does not fit a long")).cast("long")).otherwise(F.col("score"))
        out = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", fits.alias("score"))
        return common.write_stage(out, "best")
