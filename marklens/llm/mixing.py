"""Mixing sources to target weights by min-cost flow.

Documents are summed up by membership pattern (the set of sources they belong to). A
flow network routes the words of each pattern to the quotas of its sources; a further
repetition of the same words costs more than the one before (convex), so the flow
repeats only where a quota asks for it. Within a pattern, documents are then chosen in
a seeded order until the routed number of words is reached.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stored

#: Bits of the seeded order by which documents are summed up before single ones are looked at.
RANGE_BITS = 16


def water_fill(sizes: list[int], weights: list[float], total: float, limit: float) -> list[float]:
    """Shares of ``total`` by weight, each at most ``limit`` times its size.

    What exceeds a limit is shared again by weight among those below theirs.
    """
    targets, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if rest * weights[i] / weight > limit * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = rest * weights[i] / weight
            break
        for i in full:
            targets[i] = float(limit * sizes[i])
            rest -= targets[i]
            open_.discard(i)
    return targets


def min_cost_flow(arcs: list[tuple[int, int, int, int]], nodes: int, source: int, sink: int) -> list[int]:
    """Flow per arc (from, to, capacity, cost) of a cheapest maximum flow.

    Successive shortest paths with potentials; costs are not negative.
    """
    graph: list[list[int]] = [[] for _ in range(nodes)]
    to, left, cost = [], [], []
    for a, b, capacity, price in arcs:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            left.append(c)
            cost.append(p)
    potential = [0] * nodes
    while True:
        best, via, heap = {source: 0}, {}, [(0, source)]
        while heap:
            d, node = heapq.heappop(heap)
            if d > best[node]:
                continue
            for e in graph[node]:
                if left[e] and (new := d + cost[e] + potential[node] - potential[to[e]]) < best.get(to[e], 1 << 62):
                    best[to[e]], via[to[e]] = new, e
                    heapq.heappush(heap, (new, to[e]))
        if sink not in best:
            return [left[2 * i + 1] for i in range(len(arcs))]
        far = max(best.values())
        for node in range(nodes):
            potential[node] += best.get(node, far)
        path, node = [], sink
        while node != source:
            path.append(via[node])
            node = to[via[node] ^ 1]
        push = min(left[e] for e in path)
        for e in path:
            left[e] -= push
            left[e ^ 1] += push


def route(
    patterns: dict[tuple, int], quotas: dict, repeats: int
) -> dict[tuple, int]:
    """Words to take of each pattern; ``patterns``: total words by sources."""
    order, names = sorted(patterns, key=repr), list(quotas)
    start, end = 0, 1
    pattern_node = {p: 2 + i for i, p in enumerate(order)}
    source_node = {s: 2 + len(order) + i for i, s in enumerate(names)}
    arcs, entry = [], []
    for p in order:
        for level in range(repeats):
            entry.append((p, len(arcs)))
            arcs.append((start, pattern_node[p], patterns[p], level * level))
        arcs += [(pattern_node[p], source_node[s], repeats * patterns[p], 0) for s in p if s in source_node]
    arcs += [(source_node[s], end, quotas[s], 0) for s in names]
    flow = min_cost_flow(arcs, 2 + len(order) + len(names), start, end)
    taken = dict.fromkeys(order, 0)
    for p, arc in entry:
        taken[p] += flow[arc]
    return taken


def mix(
    docs: DataFrame, members: Column, size: Column, quotas: dict, repeats: int = 2, seed: int = 17
) -> DataFrame:
    """Add ``size`` and ``taken`` (words the mix takes, repeats counted) to documents.

    ``members`` is an array of source names (null is a source too), ``quotas`` the
    words wanted by source. Patterns and quotas are sums by source set, so the driver
    sees one row for each set of sources and never a document. A document is taken
    whole, once more than another of its pattern at most. Rows that agree in ``doc_id``
    and size are chosen together, but for those at which the quota is reached: of them
    as many rows as it asks for. Empty documents take 0.
    """
    key = F.to_json(F.sort_array(F.array_distinct(members)), {"ignoreNullFields": "false"})
    sized = docs.withColumn("size", size).withColumn("_pattern", key).withColumn("_id", F.monotonically_increasing_id())
    sums = {r[0]: int(r[1]) for r in sized.groupBy("_pattern").agg(F.sum("size")).collect()}
    sources = {key: tuple(json.loads(key)) for key in sums}
    taken = route({sources[k]: n for k, n in sums.items()}, quotas, repeats)
    rows = [(k, *divmod(taken[sources[k]], n)) for k, n in sums.items() if n]
    spark = docs.sparkSession
    # one row per set of sources, as above
    plan = F.broadcast(spark.createDataFrame(rows, "_pattern string, _times long, _rest long"))
    ranked = sized.join(plan, "_pattern", "left").withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id"))
    ranked = ranked.withColumn("_range", F.shiftrightunsigned("_hash", 64 - RANGE_BITS))
    before = Window.partitionBy("_pattern").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        ranked.where("_rest > 0")
        .groupBy("_pattern", "_range", "_rest")
        .agg(F.sum("size").alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    )
    edge = ranges.where("_before < _rest AND _before + _sum >= _rest").select(
        "_pattern", F.col("_range").alias("_edge"), "_before"
    )
    # at most one edge range per set of sources
    ranked = ranked.join(F.broadcast(edge), "_pattern", "left")
    inside = ranked.where("_range = _edge").groupBy("_pattern", "_before", "_rest", "_hash", "doc_id", "size").agg(
        F.count(F.lit(1)).alias("_rows")
    )
    order = Window.partitionBy("_pattern").orderBy("_hash", "doc_id", "size")
    inside = inside.withColumn("_upto", F.col("_before") + F.sum(F.col("size") * F.col("_rows")).over(order))
    start = F.col("_upto") - F.col("size") * F.col("_rows")
    wanted = F.floor((F.col("_rest") - start) / F.col("size") + 0.5)
    inside = inside.where("size > 0").withColumn("_take", F.least("_rows", F.greatest(wanted, F.lit(0)))).where("_take > 0")
    group = ["_pattern", "_hash", "size", "_doc"]
    inside = stored(inside.withColumnRenamed("doc_id", "_doc").select(*group, "_rows", "_take"), "mix-edge")
    chosen = inside.where("_take = _rows").select(*(F.col(c).alias(f"{c}_2") for c in group), F.lit(True).alias("_in"))
    part = _first_rows(ranked.where("_range = _edge"), inside.where("_take < _rows"))
    ranked = ranked.join(
        chosen,
        (ranked["_pattern"] == chosen["_pattern_2"])
        & (ranked["_range"] == ranked["_edge"])
        & (ranked["_hash"] == chosen["_hash_2"])
        & ranked["doc_id"].eqNullSafe(chosen["_doc_2"])
        & (ranked["size"] == chosen["size_2"]),
        "left",
    ).join(part, "_id", "left")
    extra = F.when((F.col("_range") < F.col("_edge")) | F.coalesce("_in", "_in_part", F.lit(False)), 1).otherwise(0)
    times = F.coalesce("_times", F.lit(0)) + F.when(F.col("_rest") > 0, extra).otherwise(0)
    return ranked.withColumn("taken", (F.col("size") * times).cast("long")).drop(
        "_pattern", "_times", "_rest", "_hash", "_range", "_edge", "_before", "_in", "_in_part", "_id",
        "_pattern_2", "_hash_2", "size_2", "_doc_2",
    )


def _first_rows(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(_id, _in_part) of the first ``_take`` rows of each group; at most one group a pattern.

    Rows are numbered within the partitions that their ids name, so a group of many equal
    rows is not one task.
    """
    asked = F.broadcast(groups.select("_pattern", F.col("_hash").alias("_hash_2"), F.col("size").alias("size_2"), "_doc", "_take"))
    same = (F.col("_hash") == F.col("_hash_2")) & (F.col("size") == F.col("size_2")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    own = rows.join(asked, "_pattern").where(same).select("_pattern", "_id", "_take", F.shiftright("_id", 33).alias("_part"))
    before = Window.partitionBy("_pattern").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy("_pattern", "_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_pattern", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_pattern", "_part").orderBy("_id"))
    numbered = own.withColumn("_place", place).join(starts, ["_pattern", "_part"])
    return numbered.where("_start + _place <= _take").select("_id", F.lit(True).alias("_in_part"))


def targets(sizes: DataFrame, share: float = 1.5, limit: float = 2.0) -> list[tuple]:
    """(source, size, target) by the 3, 1, 2 weights; ``sizes``: source, size."""
    rows = [(r[0], int(r[1])) for r in sizes.groupBy("source").agg(F.sum("size")).collect()]
    rows.sort(key=lambda r: (r[0] is None, r[0] or ""))
    weights = [(3.0, 1.0, 2.0)[i % 3] for i in range(len(rows))]
    wanted = water_fill([r[1] for r in rows], weights, share * sum(r[1] for r in rows), limit)
    return [(s, n, t) for (s, n), t in zip(rows, wanted, strict=True)]


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document row.

    A null text has size 0; a null source is a source of its own, sorted last.
    """
    sizes = stored(docs.select("doc_id", "source", n_words().alias("size")), "mix-sizes")
    plan = targets(sizes)
    quotas = {s: round(t) for s, _, t in plan}
    out = mix(sizes, F.array("source"), F.col("size"), quotas, 2, seed)
    spark = docs.sparkSession
    # one row per source
    facts = F.broadcast(spark.createDataFrame(plan, "_source string, source_size long, target double"))
    return out.join(facts, out["source"].eqNullSafe(facts["_source"]), "left").drop("_source")
