"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes from learned rotations. A code is cut into substrings and each
substring is an index of its own. By the pigeonhole principle every code within a
Hamming radius agrees with the query in some substring up to a small distance, so a
query visits only the cells of near substrings; what it finds is filtered by the whole
code and reranked with the original vectors. A query that has found too few rows is asked
again with a wider radius, at last with one that reaches every row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BITS, SUB = 128, 16
PARTS = BITS // SUB
#: Rows on which rotations and radius are learned, at most (smallest key hashes).
FIT_ROWS, FIT_QUERIES = 8000, 400
#: Share of the true neighbours in the sample that the radius must cover.
COVER = 0.97
#: Widest radius worth probing for; beyond it, reading every row once costs less.
WIDEST = 40
#: Rows and queries that meet in one group, about.
CELL, BLOCK = 16_384, 4096

_POP = np.array([bin(i).count("1") for i in range(1 << SUB)], np.uint8)


@dataclass(frozen=True)
class Coder:
    """Centre, rotations and norm bound for inner products; ``radius`` in bits."""

    mean: np.ndarray
    rotation: np.ndarray
    norm: float
    radius: int

    def _codes(self, lifted: np.ndarray) -> np.ndarray:
        bits = ((lifted - self.mean) @ self.rotation > 0).astype(np.uint8)
        return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Codes of stored vectors: one more coordinate makes all norms equal."""
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return self._codes(np.column_stack([x, rest]))

    def queries(self, x: np.ndarray) -> np.ndarray:
        scale = self.norm / np.sqrt((x * x).sum(1))
        return self._codes(np.column_stack([x * scale[:, None], np.zeros(len(x))]))

    def radii(self) -> list[int]:
        """Distance allowed in each substring so that none within ``radius`` is lost.

        With all bits allowed the first substring alone reaches every row.
        """
        if self.radius >= BITS:
            return [SUB] + [-1] * (PARTS - 1)
        low, rest = divmod(self.radius, PARTS)
        return [low if i <= rest else low - 1 for i in range(PARTS)]


def distances(codes: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Hamming distance by substring; one row per code."""
    return _POP[codes ^ query]


def learn(x: np.ndarray, norm: float, k: int, total: int, seed: int = 7, steps: int = 30) -> Coder:
    """Rotations by iterative quantisation and a radius from exact neighbours of the sample.

    In a sample of a share s of all rows, a query's k * s nearest stand for its k nearest.
    """
    lifted = np.column_stack([x, np.sqrt(np.maximum(norm**2 - (x * x).sum(1), 0))])
    mean = lifted.mean(0)
    _, axes = np.linalg.eigh(np.cov((lifted - mean).T) if len(x) > 1 else np.eye(lifted.shape[1]))
    axes = axes[:, ::-1][:, : min(64, x.shape[1])]
    low = (lifted - mean) @ axes
    rng, parts = np.random.default_rng(seed), []
    while sum(p.shape[1] for p in parts) < BITS:
        turn = np.linalg.qr(rng.standard_normal((low.shape[1],) * 2))[0]
        for _ in range(steps):
            u, _, v = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
            turn = (u @ v).T
        parts.append(axes @ turn)
    coder = Coder(mean, np.concatenate(parts, 1)[:, :BITS], norm, BITS)
    codes, near = coder.rows(x), []
    want = min(max(3, -(-k * len(x) // max(total, 1))), k, len(x) - 1)
    picked = rng.permutation(len(x))[:FIT_QUERIES]
    for i, q in zip(picked, coder.queries(x[picked]), strict=True):
        score = x @ x[i]
        score[i] = -np.inf
        best = np.argpartition(-score, want - 1)[:want] if want > 0 else []
        near.extend(distances(codes[best], q).sum(1) if want > 0 else [])
    radius = int(np.quantile(near, COVER, method="higher")) if near else BITS
    return Coder(mean, coder.rotation, norm, radius)


def _dense(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _coded(df: DataFrame, coder: Coder, kind: str) -> DataFrame:
    """Add the code as an array of substrings."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                codes = getattr(coder, kind)(_dense(batch.column("embedding")))
                yield batch.append_column("code", pa.array(codes.astype(np.int32).tolist(), pa.list_(pa.int32())))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, code array<int>")


def _search(k: int, radius: int, allowed: list[int]):
    """Function over (index cell, queries): the best ``k + 1`` ids of each query there."""
    limits = np.array(allowed, np.int64)

    def run(key, cell: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_id, out_s = [], [], []
        if cell.num_rows and queries.num_rows:
            j = key[0].as_py()
            codes = np.array(cell.column("code").to_pylist(), np.uint16)
            vectors, ids = _dense(cell.column("embedding")), cell.column("ids").to_pylist()
            # the substring's index: its occupied values, and the rows of each
            order = np.argsort(codes[:, j], kind="stable")
            values, first = np.unique(codes[order, j], return_index=True)
            last = np.append(first[1:], len(order))
            asked = np.array(queries.column("code").to_pylist(), np.uint16)
            wanted = _dense(queries.column("embedding"))
            for q, code, vector in zip(queries.column("cls").to_pylist(), asked, wanted, strict=True):
                hit = np.flatnonzero(_POP[values ^ code[j]] <= allowed[j])
                if not len(hit):
                    continue
                size = last[hit] - first[hit]
                rows = order[np.repeat(first[hit] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                d = distances(codes[rows], code)
                # each pair counts in the first substring that finds it
                mine = (d.sum(1, dtype=np.int64) <= radius) & ~(d[:, :j] <= limits[:j]).any(1)
                rows = rows[mine]
                score = vectors[rows] @ vector
                if len(rows) > k + 1:
                    least = -np.partition(-score, k)[k]
                    rows, score = rows[score >= least], score[score >= least]
                best = sorted((-s, i) for r, s in zip(rows.tolist(), score.tolist(), strict=True) for i in ids[r])
                for s, i in best[: k + 1]:
                    out_q.append(q)
                    out_id.append(i)
                    out_s.append(-s)
        return pa.table({"cls": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_id, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return run


def wider(radius: int) -> int:
    """The next radius for queries that ``radius`` leaves short."""
    return radius * 2 if 0 < radius * 2 <= WIDEST else BITS


def _near(bits: int, radius: int) -> list[int]:
    """Numbers of ``bits`` bits with at most ``radius`` ones."""
    return [
        sum(1 << b for b in places)
        for n in range(min(bits, radius) + 1)
        for places in combinations(range(bits), n)
    ]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part.

    Left out: null vectors or ids, null or non-finite components, zero vectors, and
    vectors whose length differs from the most frequent one.
    """
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0").where(~bad)
    v = v.where(F.exists("embedding", lambda x: x != 0))
    usual = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return v.where(F.size("embedding") == (usual[0] if usual else 0))


def _by_part(df: DataFrame, head: int) -> DataFrame:
    """One row per substring, with the cell that its first ``head`` bits name."""
    part = df.select("*", F.posexplode("code").alias("part", "_sub"))
    return part.withColumn("_cell", F.shiftright("_sub", SUB - head)).drop("_sub")


def _probed(index: DataFrame, wanted: DataFrame, head: int, k: int, coder: Coder) -> DataFrame:
    """cls, vec_id, score: the best ``k + 1`` ids within the radius of each query."""
    allowed = coder.radii()
    used = [i for i, r in enumerate(allowed) if r >= 0]
    every = F.sequence(F.lit(0), F.lit((1 << head) - 1))
    masks = {r: every if r >= head else F.array(*map(F.lit, _near(head, r))) for r in {allowed[i] for i in used}}
    mask = F.coalesce(*(F.when(F.col("part") == i, masks[allowed[i]]) for i in used))
    index, probes = (df.where(F.col("part").isin(used)) for df in (index, _by_part(wanted, head)))
    probes = probes.select("*", F.explode(mask).alias("_mask"))
    probes = probes.withColumn("_cell", F.col("_cell").bitwiseXOR(F.col("_mask"))).drop("_mask")
    probes = stored(probes, "neighbours-probes")
    # a cell with many rows or many queries is split; both numbers are counted first
    sizes = index.groupBy("part", "_cell").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("_salts"))
    asks = probes.groupBy("part", "_cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    cells = sizes.join(asks, ["part", "_cell"])
    deal = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(cells, ["part", "_cell"]).select("*", deal("_salts").alias("_salt"), each("_blocks").alias("_block"))
    right = probes.join(cells, ["part", "_cell"]).select("*", deal("_blocks").alias("_block"), each("_salts").alias("_salt"))
    keys, drop = ["part", "_cell", "_salt", "_block"], ["_salts", "_blocks"]
    found = (
        left.drop(*drop).groupBy(*keys).cogroup(right.drop(*drop).groupBy(*keys))
        .applyInArrow(_search(k, coder.radius, allowed), "cls long, vec_id long, score double")
    )
    best = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("_r", best).where(F.col("_r") <= k + 1).drop("_r")


def search(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """The ``k`` nearest by inner product of each vector whose id divides by ``every``.

    query_id, rank, vec_id, score. A query has fewer than ``k`` rows only where fewer
    candidates exist: those left short are asked again with a wider radius. Equal vectors are searched as one and stand in for
    each other with their smallest ids, so groups of copies stay small and lose nothing.
    A repeated row (same id, same vector) counts once.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    classes = rows.distinct().withColumn("_r", rank).where(F.col("_r") <= k + 1)
    classes = stored(
        classes.groupBy("embedding").agg(F.min("vec_id").alias("cls"), F.sort_array(F.collect_list("vec_id")).alias("ids")),
        "neighbours-classes",
    )
    asked = rows.where(F.col("vec_id") % every == 0).distinct().join(classes.select("embedding", "cls"), "embedding")
    asked = stored(asked.select(F.col("vec_id").alias("query_id"), "cls"), "neighbours-queries")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    total, longest, held = classes.agg(F.count(F.lit(1)), F.max(norm), F.sum(F.size("ids"))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if total < 2 and not classes.where(F.size("ids") > 1).head(1):
        return spark.createDataFrame([], schema)
    sample = classes.orderBy(F.xxhash64("cls"), "cls").limit(FIT_ROWS).select("embedding").collect()
    coder = learn(np.array([r[0] for r in sample]), longest, k, total)
    head = min(SUB, max(0, int(total // CELL).bit_length()))  # bits of a substring that name its cell
    index = _by_part(_coded(classes, coder, "rows"), head)
    wanted = classes.join(asked.select("cls").distinct(), "cls", "left_semi").select("cls", "embedding")
    radius, answers = coder.radius, []
    while True:
        found = stored(_probed(index, _coded(wanted, coder, "queries"), head, k, replace(coder, radius=radius)), "neighbours-found")
        if radius >= BITS:
            break
        enough = found.groupBy("cls").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min(k + 1, held))
        wanted = stored(wanted.join(enough, "cls", "left_anti"), "neighbours-short")
        if not wanted.head(1):
            break
        answers.append(found.join(enough.select("cls"), "cls", "left_semi"))
        radius = wider(radius)
    found = reduce(DataFrame.unionByName, answers, found)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    pairs = asked.join(found, "cls").where("query_id <> vec_id")
    return pairs.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
