"""Exact top-k inner-product search with vector-approximation files.

``build`` packs the vectors of each task, as integers floor(scale * x), into
chunks: a grid of cells over every dimension, a byte per component that names
its cell, and, in a column of their own, the exact vectors.  Queries are rows
too, packed into a table of blocks, and every block meets every chunk.

``search`` goes over the file twice.  The first scan reads cells alone; it gives
for each query its k best lower bounds and the chunks whose best upper bound
reaches them.  The k-th best lower bound over all chunks then leaves only the
chunks in doubt, and the second scan reads the exact vectors of those, in the
order of their upper bounds until the k-th result is certain.  A window merges
the k rows that a chunk gives a query.

Defined results: vectors that are null, empty or hold a null or non-finite
component take no part, nor do rows without id.  Vectors of unlike length are
never compared.  Equal scores rank by the smaller id; a repeated row counts each
time, save where it bears the query's own id; a query id that occurs with several
vectors asks with the least of them.  Scores are exact 64-bit integers; a scaled
component beyond 62 bits, or a score among the candidates beyond 64, raises
OverflowError.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.llm.common import bounded_batches, by_value, durable

by_value(__name__)

#: Queries in a block at most, about, and bytes of their vectors.
QUERY_BLOCK, BLOCK_BYTES = 512, 2_000_000
#: Bytes of all query vectors, and rows of the table of chunks in doubt, that are broadcast; larger ones are joined, blocks by salt too.
MOST_SENT, MOST_DOUBTS, SALT = 32_000_000, 500_000, 64
#: Vectors in a chunk at most.
CHUNK_ROWS = 4096
CELLS = 256
#: Blocks whose bounds a task holds at once.
HELD_BLOCKS = 16
CHUNK_SCHEMA = "chunk long, dims int, ids binary, low binary, step binary, cells binary, exact binary"


def whole(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id and vector (doubles) of the rows that take part."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id_column).isNotNull() & (F.size(vector) > 0) & usable).select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))


def integers(vectors: pd.Series, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places and the rows floor(scale * x)."""
    lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
    out = {}
    for dims in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dims)
        scaled = np.floor(scale * np.stack(vectors.to_numpy()[at]).astype(np.float64))
        if np.abs(scaled).max() >= 2.0**62:
            raise OverflowError("a scaled component exceeds 62 bits")
        out[dims] = at, scaled.astype(np.int64)
    return out


def build(vectors: DataFrame, *, id_column: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """The approximation file, a row for each chunk, written to the shared folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start in range(0, len(batch), CHUNK_ROWS):
                part = batch.iloc[start : start + CHUNK_ROWS]
                ids = part["id"].to_numpy(np.int64)
                for dims, (at, rows) in integers(part["vector"], scale).items():
                    low = rows.min(0)
                    step = np.maximum(1, -(-(rows.max(0) - low + 1) // CELLS))
                    cells = ((rows - low) // step).astype(np.uint8)
                    yield pd.DataFrame([[number, dims, *(x.tobytes() for x in (ids[at], low, step, cells, rows))]], columns=["chunk", "dims", "ids", "low", "step", "cells", "exact"])
                    number += 1

    return durable(whole(vectors, id_column, vector).mapInPandas(run, CHUNK_SCHEMA), "va-file")


def query_blocks(vectors: DataFrame, is_query: Column, id_column: str, vector: str, scale: float) -> tuple[DataFrame, int, int]:
    """(block, dims, query_ids, queries), a row for the queries of one length in a block; the number of blocks; bytes of all."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["id"].to_numpy(np.int64)
        return pd.DataFrame([[group["block"].iloc[0], dims, ids[at].tobytes(), rows.tobytes()] for dims, (at, rows) in integers(group["vector"], scale).items()], columns=["block", "dims", "query_ids", "queries"])

    asked = whole(vectors.where(is_query), id_column, vector).groupBy("id").agg(F.min("vector").alias("vector"))
    asked = durable(asked, "queries")
    count, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector") * 8), F.lit(0))).first()
    blocks = max(1, -(-2 * count // QUERY_BLOCK) if count > QUERY_BLOCK else 1, -(-2 * size // BLOCK_BYTES) if size > BLOCK_BYTES else 1)
    packed = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(pack, "block int, dims int, query_ids binary, queries binary")
    return durable(packed, "query-blocks"), blocks, size


def with_queries(rows: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """``rows`` (chunk, block, dims, ...) joined to their block's queries."""
    if size <= MOST_SENT:
        return rows.join(F.broadcast(blocks), ["block", "dims"])
    salted = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(SALT)).cast("int")).join(salted, ["block", "dims", "salt"]).drop("salt")


def bounds(row, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By query and vector of a chunk: the middle between both bounds on the score; by query: how far they lie from it."""
    low, step = np.frombuffer(row.low, np.int64), np.frombuffer(row.step, np.int64)
    half = (step - 1) / 2
    estimate = queries.astype(np.float64) @ (low + np.frombuffer(row.cells, np.uint8).reshape(-1, len(low)) * step + half).T
    # a cell's reach, and rounding
    return estimate, np.abs(queries) @ half + 1e-9 * (1 + np.abs(queries).astype(np.float64) @ np.maximum(np.abs(low), np.abs(low + CELLS * step.astype(np.float64))))


def marked(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, block, chunk, bound: chunks with their best upper bound, and without chunk the k best lower bounds in a task."""

    def rows(query_ids: np.ndarray, block: int, chunk: int | None, bound: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"query_id": query_ids, "block": block, "chunk": pd.array([chunk] * len(query_ids), "Int64"), "bound": bound})

    def told(name: tuple[int, int], held: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
        ids, best = held
        fine = best > -np.inf
        return rows(np.repeat(ids, fine.sum(1)), name[0], None, best[fine])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                name, ids, query_ids = (int(row.block), int(row.dims)), np.frombuffer(row.ids, np.int64), np.frombuffer(row.query_ids, np.int64)
                estimate, reach = bounds(row, np.frombuffer(row.queries, np.int64).reshape(len(query_ids), -1))
                estimate[query_ids[:, None] == ids] = -np.inf
                if name not in held:
                    if len(held) >= HELD_BLOCKS:
                        first = next(iter(held))
                        yield told(first, held.pop(first))
                    held[name] = query_ids, np.full((len(query_ids), k), -np.inf)
                lower = estimate - reach[:, None]
                if lower.shape[1] > k:
                    lower = np.partition(lower, lower.shape[1] - k, axis=1)[:, -k:]
                best = np.sort(np.concatenate([held[name][1], lower], axis=1), axis=1)[:, -k:]
                held[name] = query_ids, best
                upper = estimate.max(1) + reach
                near = (upper >= best[:, 0]) & (upper > -np.inf)
                yield rows(query_ids[near], name[0], int(row.chunk), upper[near])
        for name, last in held.items():
            yield told(name, last)

    return pairs.mapInPandas(run, "query_id long, block int, chunk long, bound double")


def scores_of(exact: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    if float(np.abs(exact).max(initial=0)) * float(np.abs(query).max(initial=0)) * len(query) < 2.0**62:
        return exact @ query
    wide = exact.astype(object) @ query.astype(object)
    if any(not -(2**63) <= x < 2**63 for x in wide):
        raise OverflowError("a score exceeds 64 bits")
    return wide.astype(np.int64)


def settled(doubts: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best vectors of each chunk for the queries (wanted: query_id, floor) that doubt it."""

    def best(ids: np.ndarray, exact: np.ndarray, query: np.ndarray, bound: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        places = np.flatnonzero((bound >= least) & (bound > -np.inf))
        places = places[np.argsort(-bound[places], kind="stable")]
        found, scores, at = np.empty(0, np.int64), np.empty(0, np.int64), 0
        while at < len(places) and (len(scores) < k or bound[places[at]] >= scores[-1]):
            part = places[at : at + max(4 * k, at)]
            at += len(part)
            found, scores = np.r_[found, ids[part]], np.r_[scores, scores_of(exact[part], query)]
            order = np.lexsort((found, ~scores))[:k]
            found, scores = found[order], scores[order]
        return found, scores

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, query_ids = np.frombuffer(row.ids, np.int64), np.frombuffer(row.query_ids, np.int64)
                queries, exact = np.frombuffer(row.queries, np.int64).reshape(len(query_ids), -1), np.frombuffer(row.exact, np.int64).reshape(len(ids), -1)
                least = {x["query_id"]: x["floor"] for x in row.wanted}
                at = np.flatnonzero(np.isin(query_ids, list(least)))
                estimate, reach = bounds(row, queries[at])
                estimate[query_ids[at][:, None] == ids] = -np.inf
                for q, middle, far in zip(at.tolist(), estimate, reach):
                    floor = least[int(query_ids[q])]
                    if len(ids) > k:  # the chunk's own k-th best lower bound
                        floor = max(floor, np.partition(middle, len(ids) - k)[len(ids) - k] - far)
                    found, scores = best(ids, exact, queries[q], middle + far, floor)
                    yield pd.DataFrame({"query_id": query_ids[q], "vec_id": found, "score": scores})

    return doubts.mapInPandas(run, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, is_query: Column, *, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row where ``is_query`` holds."""
    bounded_batches(vectors.sparkSession)
    file = build(vectors, id_column=id_column, vector=vector, scale=scale)
    blocks, count, size = query_blocks(vectors, is_query, id_column, vector, scale)
    every = file.drop("exact").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    marks = durable(marked(with_queries(every, blocks, size), k), "bounds")
    best = Window.partitionBy("query_id").orderBy(F.desc("bound"))
    floors = marks.where("chunk is null").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).groupBy("query_id").agg(F.min("bound").alias("floor"), F.count(F.lit(1)).alias("n"))
    floors = floors.select("query_id", F.when(F.col("n") < k, float("-inf")).otherwise(F.col("floor")).alias("floor"))
    doubts = marks.where("chunk is not null").join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))).where("bound >= floor")
    doubts = durable(doubts.groupBy("chunk", "block").agg(F.collect_list(F.struct("query_id", "floor")).alias("wanted")), "doubts")  # a block's queries at most
    listed = doubts.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()[0]
    out = settled(with_queries(file.join(F.broadcast(doubts) if listed <= MOST_DOUBTS else doubts, "chunk"), blocks, size), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
