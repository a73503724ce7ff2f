"""Exact top-k search by inner product, with a three-phase uniform threshold.

A vector's score is the sum of local scores, one for each group of components. (1) Every block of candidates gathers,
for each query, the entries that lead the local list of some group; only these are added up, and the k-th best of all
of them is a safe cutoff. (2) The cutoff is sent to all blocks, spread evenly over the groups above each group's
smallest local score: what stays below the spread cutoff in every group cannot reach the cutoff in sum, so only entries
that reach it in some group are collected. (3) The collected entries are added up exactly, and the best k kept. All
other pairs never get a score.

Queries and candidates are dealt into blocks, one row with one matrix each, and meet block by block. A block of
candidates is read once per ``QUERY_ROWS`` queries and a block of queries once per ``CANDIDATE_ROWS`` candidates, so
the shuffle is queries * candidates * (1 / QUERY_ROWS + 1 / CANDIDATE_ROWS) vectors. Inside a task ``STRIP_ROWS``
queries are looked at together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apidrift.llm.common import drop, written

SCALE = 256
GROUPS = 4
CANDIDATE_ROWS, QUERY_ROWS, STRIP_ROWS = 8192, 8192, 128
LONG = 2**63 - 1


def whole_vectors(table: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(at, vec_id, v): components floor(scale * x) as little-endian doubles; rows that take no part are left out."""

    def run(batches):
        for batch in batches:
            rows = []
            for at, vec_id, vector in zip(batch["at"].to_pylist(), batch["vec_id"].to_pylist(), batch["v"].to_pylist()):
                if vec_id is not None and vector is not None and None not in vector:
                    v = np.array(vector, np.float64)
                    if np.isfinite(v).all():
                        rows.append((at, vec_id, np.floor(scale * v).astype("<f8").tobytes()))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["at", "vec_id", "v"])

    narrow = table.select(F.monotonically_increasing_id().alias("at"), F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v"))
    return narrow.mapInArrow(run, "at bigint, vec_id bigint, v binary")


def _blocks(vectors: DataFrame, name: str, rows: int) -> tuple[DataFrame, int]:
    """(name, at, id, v): the vectors dealt by a hash of their number into blocks of about ``rows``, and how many blocks.

    A block is one row: row numbers and ids as little-endian longs, the vectors as one matrix, shorter ones filled with zeros.
    """
    n = max(1, -(-vectors.count() // rows))
    number = F.pmod(F.xxhash64("at"), F.lit(n)).alias(name)
    columns = [name, *[f"{name}_{part}" for part in ("at", "id", "v")]]

    def run(batches):
        for batch in batches:
            for block, members in zip(batch[name], batch["members"]):
                members = members.values
                vectors = members.field("v").to_pylist()
                width = max(map(len, vectors))
                ids = [members.field(part).to_numpy(zero_copy_only=False).astype("<i8").tobytes() for part in ("at", "vec_id")]
                values = [block.as_py(), *ids, b"".join(v.ljust(width, b"\0") for v in vectors)]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), *[pa.binary()] * 3))], names=columns)

    dealt = vectors.groupBy(number).agg(F.collect_list(F.struct("at", "vec_id", "v")).alias("members"))
    return dealt.mapInArrow(run, ", ".join(f"{c} {'bigint' if c == name else 'binary'}" for c in columns)), n


def _matrix(pair: dict, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, row numbers and ids of a block."""
    at, ids = (np.frombuffer(pair[f"{name}_{part}"], "<i8") for part in ("at", "id"))
    return np.frombuffer(pair[f"{name}_v"], "<f8").reshape(len(at), -1), at, ids


def _local_scores(queries: np.ndarray, candidates: np.ndarray, groups: int, strip: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Strips of ``strip`` queries: the first one's place and, per group of components, the (queries, candidates) local scores.

    They are doubles while these are exact, else integers.
    """
    width = min(queries.shape[1], candidates.shape[1])
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(width, 1)
    if largest < 2**53:
        kind = np.float64
    else:
        kind = np.int64 if largest < 2**62 else object
    as_kind = (lambda m: np.vectorize(int, otypes=[object])(m) if m.size else m.astype(object)) if kind is object else (lambda m: m.astype(kind))
    cut = np.linspace(0, width, groups + 1).astype(int)
    lists = [as_kind(candidates[:, a:b]).T for a, b in zip(cut, cut[1:])]
    for start in range(0, len(queries), strip):
        q = as_kind(queries[start : start + strip, :width])
        yield start, [q[:, a:b] @ c if b > a else np.zeros((len(q), len(candidates)), kind) for a, b, c in zip(cut, cut[1:], lists)]


def _best(scores: np.ndarray, ids: np.ndarray, ats: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, then smaller id, then row number."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i], ats[i]))[:k], np.int64)
    return np.lexsort((ats, ids, -scores))[:k]


def _clipped(total) -> int:
    return int(max(min(total, LONG), -LONG - 1))


def _lists(pairs: DataFrame, k: int, groups: int) -> DataFrame:
    """Phase 1: (query, at, total, lows): per query and block the best leaders of the local lists, and the lists' ends."""

    def run(batches):
        for batch in batches:
            for pair in batch.to_pylist():
                yield from one(pair)

    def one(pair) -> Iterator[pa.RecordBatch]:
        queries, q_at, _ = _matrix(pair, "q")
        candidates, c_at, c_id = _matrix(pair, "c")
        n = len(c_at)
        for start, parts in _local_scores(queries, candidates, groups, STRIP_ROWS):
            lows = np.stack([p.min(axis=1).astype(float) for p in parts], axis=1)
            # One more than k, as the query itself may lead.
            leaders = [np.argpartition(-p, min(k, n - 1), axis=1)[:, : k + 1] if p.dtype != object else np.argsort(-p, axis=1)[:, : k + 1] for p in parts]
            out = []
            for i, at in enumerate(q_at[start : start + STRIP_ROWS]):
                found = np.unique(np.concatenate([lead[i] for lead in leaders]))
                found = found[c_at[found] != at]
                total = sum(p[i, found] for p in parts)
                top = _best(total, c_id[found], c_at[found], k)
                out += [(at, c_at[found[j]], float(total[j]), lows[i].tolist()) for j in top] or [(at, None, None, lows[i].tolist())]
            columns = zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["query", "at", "total", "lows"])

    return pairs.mapInArrow(run, "query bigint, at bigint, total double, lows array<double>")


def _cutoffs(lists: DataFrame, k: int, groups: int) -> DataFrame:
    """(query, cutoffs): the spread cutoff per group; null where fewer than k candidates are known."""
    lows = lists.groupBy("query").agg(*[F.min(F.col("lows")[j]).alias(f"low_{j}") for j in range(groups)])
    ranked = lists.filter("at is not null").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("total"), "at")))
    kth = ranked.filter(F.col("rank") == k).select("query", F.col("total").alias("cutoff"))
    spare = (F.col("cutoff") - sum(F.col(f"low_{j}") for j in range(groups))) / groups
    # A little below, so that rounding cannot lift the sum of the parts over the cutoff.
    each = [F.col(f"low_{j}") + spare - 1 - F.abs(spare) * 1e-9 - F.abs(F.col(f"low_{j}")) * 1e-9 for j in range(groups)]
    return lows.join(kth, "query", "left").select("query", F.when(F.col("cutoff").isNotNull(), F.array(*each)).alias("cutoffs"))


def _resolved(pairs: DataFrame, k: int, groups: int) -> DataFrame:
    """Phases 2 and 3: (query, query_id, at, vec_id, score, n_resolved): the entries that reach the cutoff in some group, added up.

    ``n_resolved`` stands on the first row of a query and block, 0 on the others: how many entries were added up there.
    """

    def run(batches):
        for batch in batches:
            for pair in batch.to_pylist():
                yield from one(pair, {x["query"]: x["cutoffs"] for x in pair["limits"]})

    def one(pair, limits) -> Iterator[pa.RecordBatch]:
        queries, q_at, q_id = _matrix(pair, "q")
        candidates, c_at, c_id = _matrix(pair, "c")
        for start, parts in _local_scores(queries, candidates, groups, STRIP_ROWS):
            out = []
            for i, at in enumerate(q_at[start : start + STRIP_ROWS]):
                cutoffs = limits.get(int(at))
                reached = c_at != at
                if cutoffs is not None:
                    reached &= np.logical_or.reduce([np.asarray(p[i] >= t, bool) for p, t in zip(parts, cutoffs)])
                found = np.flatnonzero(reached)
                total = sum(p[i, found] for p in parts)
                for place, j in enumerate(_best(total, c_id[found], c_at[found], k)):
                    out.append((at, q_id[start + i], c_at[found[j]], c_id[found[j]], _clipped(total[j]), 0 if place else len(found)))
            columns = list(zip(*out)) or [()] * 6
            names = ["query", "query_id", "at", "vec_id", "score", "n_resolved"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return pairs.mapInArrow(run, "query bigint, query_id bigint, at bigint, vec_id bigint, score bigint, n_resolved bigint")


def _scored(
    table: DataFrame, every: int, k: int, scale: int, groups: int, id_col: str, vector_col: str
) -> tuple[DataFrame, list[str]]:
    """The rows of ``_resolved`` for a table, and the folders that they are read from."""
    spark = table.sparkSession
    vectors, vectors_path = written(whole_vectors(table, scale, id_col, vector_col), "vectors")
    candidates, n_c = _blocks(vectors, "c", CANDIDATE_ROWS)
    queries, n_q = _blocks(vectors.filter(F.col("vec_id") % every == 0), "q", QUERY_ROWS)
    candidates, candidates_path = written(candidates, "candidate-blocks")
    queries, queries_path = written(queries, "query-blocks")
    spread_c = candidates.withColumn("q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_q - 1).cast("bigint"))))

    def paired(blocks: DataFrame) -> DataFrame:
        spread_q = blocks.withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_c - 1).cast("bigint"))))
        # Blocks are spread after their size is estimated, so a broadcast would outgrow its limit.
        return spread_q.hint("merge").join(spread_c, ["q", "c"])

    lists, lists_path = written(_lists(paired(queries), k, groups), "local-lists")
    number = F.pmod(F.xxhash64("query"), F.lit(n_q)).alias("q")
    limits = _cutoffs(lists, k, groups).groupBy(number).agg(F.collect_list(F.struct("query", "cutoffs")).alias("limits"))
    limited, limited_path = written(queries.hint("merge").join(limits, "q"), "limited-queries")
    drop(spark, vectors_path, lists_path, queries_path)
    return _resolved(paired(limited), k, groups), [candidates_path, limited_path]


def top_k(
    table: DataFrame, every: int = 50, k: int = 5, scale: int = SCALE, groups: int = GROUPS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best scores of every row whose id is divisible by ``every``.

    Components become floor(scale * x); the score is their inner product as a long (beyond one, its limit). A query
    meets every row but itself; ties go to the smaller id, then to the row read first. Rows with a null id, a null
    vector, or a null or non-finite component take no part. Of vectors of different lengths the missing components
    count as zero. Repeated rows are rows of their own: a repeated query has its answers once per row. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    scored, paths = _scored(table, every, k, scale, groups, id_col, vector_col)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "at")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    answers, _ = written(ranked.select("query_id", "rank", "vec_id", "score"), "answers")
    drop(table.sparkSession, *paths)
    return answers
