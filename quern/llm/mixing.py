"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are summed up by the set of sources that they belong to. A flow network then routes the words of each pattern
to the quotas of its sources: of a pattern's words the first use costs nothing, the second use more, and so on
(convex costs of repetition). The network has a node for each pattern and source, not for each document. The words that
a pattern gives are then taken from its documents in a seeded order: all of them as often as the flow uses the pattern
up, and once more those before a threshold. Running sums for the threshold are taken by cells of the order first, so
that only the cell with the threshold is put in order row by row.

Defined results: a null text has no words; a null source is a source of its own, the last in order; documents without
words are taken 0 words; rows that repeat are documents of their own; other columns are ignored; an empty table gives an
empty result. The last document before a threshold may be taken in part, which makes every sum exact.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import PARTS, joined_by_size, text_or_empty, written

CELLS = 4096
SEED = 7
#: Patterns that the driver solves the flow for. With more, documents of one source each need no flow and are summed on the
#: cluster (`single_plan`); overlapping sources are refused then, not cut.
MAX_PATTERNS = 20_000


@dataclass
class Arc:
    to: int
    room: int
    back: int


class Network:
    """Integer maximum flow by blocking flows."""

    def __init__(self, nodes: int) -> None:
        self.arcs: list[list[Arc]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, room: int) -> tuple[int, int]:
        self.arcs[a].append(Arc(b, room, len(self.arcs[b])))
        self.arcs[b].append(Arc(a, 0, len(self.arcs[a]) - 1))
        return a, len(self.arcs[a]) - 1

    def flow(self, arc: tuple[int, int]) -> int:
        a = self.arcs[arc[0]][arc[1]]
        return self.arcs[a.to][a.back].room

    def augment(self, s: int, t: int) -> int:
        total = 0
        while True:
            level = [-1] * len(self.arcs)
            level[s] = 0
            queue = deque([s])
            while queue:
                x = queue.popleft()
                for a in self.arcs[x]:
                    if a.room and level[a.to] < 0:
                        level[a.to] = level[x] + 1
                        queue.append(a.to)
            if level[t] < 0:
                return total
            at = [0] * len(self.arcs)
            while True:
                path, x = [], s
                while x != t:
                    while at[x] < len(self.arcs[x]):
                        a = self.arcs[x][at[x]]
                        if a.room and level[a.to] == level[x] + 1:
                            break
                        at[x] += 1
                    else:
                        if not path:
                            break
                        x, _ = path.pop()
                        at[x] += 1
                        continue
                    path.append((x, a))
                    x = a.to
                if x != t:
                    break
                push = min(a.room for _, a in path)
                for _, a in path:
                    a.room -= push
                    self.arcs[a.to][a.back].room += push
                total += push


def route(patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int], epochs: int = 2) -> list[int]:
    """Words that each pattern gives: a maximum flow of least cost.

    Costs arise only where flow leaves the start, at k for the k-th use of a pattern. Cheapest paths first therefore
    means: fill with first uses, then let second uses in, and so on, always keeping what has been routed open to rerouting.
    """
    n = len(patterns)
    s, t = n + len(quotas), n + len(quotas) + 1
    net = Network(t + 1)
    for p, (sources, size) in enumerate(patterns):
        for q in sources:
            net.add(p, n + q, size * epochs)
    for q, quota in enumerate(quotas):
        net.add(n + q, t, quota)
    uses: list[list[tuple[int, int]]] = [[] for _ in patterns]
    for _ in range(epochs):
        for p, (_, size) in enumerate(patterns):
            uses[p].append(net.add(s, p, size))
        net.augment(s, t)
    return [sum(map(net.flow, arcs)) for arcs in uses]


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, total: int | None = None) -> dict[str | None, float]:
    """Target of each source: `share` times all sizes, dealt by weight, at most `most` times the source's own size.

    total: all sizes, by default the sum; less where sources overlap.
    """
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: weights[i % len(weights)] for i, x in enumerate(names)}
    left, open_, out = share * (sum(sizes.values()) if total is None else total), list(names), {}
    while open_:
        parts = sum(weight[x] for x in open_)
        over = [x for x in open_ if left * weight[x] / parts > most * sizes[x]]
        if not over:
            return out | {x: left * weight[x] / parts for x in open_}
        for x in over:
            out[x] = most * sizes[x]
        left -= sum(out[x] for x in over)
        open_ = [x for x in open_ if x not in out]
    return out


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def flow_plan(spark: SparkSession, found: Sequence[Row], weights: Sequence[float], share: float, epochs: int) -> DataFrame:
    """(members, source_size, target, full, rest) of each pattern: how often all of it is used, and how many words once more."""
    by_source: dict[str | None, int] = defaultdict(int)
    for r in found:
        for x in r["members"] or [None]:
            by_source[x] += r["size"]
    goal = targets(by_source, weights, share, float(epochs), sum(r["size"] for r in found))
    names = sorted(goal, key=lambda x: (x is None, x or ""))
    number = {x: i for i, x in enumerate(names)}
    given = route([([number[x] for x in r["members"] or [None]], r["size"]) for r in found], [round(goal[x]) for x in names], epochs)
    plan = []
    for r, words in zip(found, given, strict=True):
        first = min((number[x] for x in r["members"] or [None]))
        full, rest = divmod(words, r["size"]) if r["size"] else (0, 0)
        plan.append((r["members"], by_source[names[first]], goal[names[first]], full, rest))
    return spark.createDataFrame(plan, "members array<string>, source_size long, target double, full long, rest long")


def single_plan(sums: DataFrame, weights: Sequence[float], share: float, epochs: int) -> DataFrame:
    """The same, with `n`, for documents of one source each, without a limit: a source's flow is its target or all it has.

    Sources are numbered by parts of their order. The level to which targets are filled up comes from sums, one row a round.
    """
    source = F.col("members")[0]
    parts = written(sums.orderBy(source.asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    ahead, before = 0, []
    for r in parts.groupBy("part").count().orderBy("part").collect():
        before.append((r["part"], ahead))
        ahead += r["count"]
    starts = F.broadcast(sums.sparkSession.createDataFrame(before, "part int, ahead long"))
    place = F.col("ahead") + F.row_number().over(W.partitionBy("part").orderBy(source.asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    of = written(parts.join(starts, "part").select("members", "size", "n", weight.alias("weight")), "weights")
    room = F.col("size") * float(epochs)
    total, open_weight, n = of.agg(F.sum("size"), F.sum("weight"), F.count(F.lit(1))).first()
    level, closed = share * total / open_weight, 0
    while True:
        full = room < F.col("weight") * level
        over, used, left = of.agg(F.count_if(full), F.sum(F.when(full, room).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if over == closed:
            break
        closed, level = over, (share * total - used) / left if left else math.inf
        if over == n:
            break
    target = F.least(room, F.col("weight") * level)
    given = F.least(F.bround(target).cast("long"), F.col("size") * epochs)
    some = F.col("size") > 0
    return written(of.select(
        "members", F.col("size").alias("source_size"), target.alias("target"), "n",
        F.when(some, F.floor(given / F.col("size"))).otherwise(0).cast("long").alias("full"), F.when(some, given % F.col("size")).otherwise(0).cast("long").alias("rest"),
    ), "plan")


@dataclass
class Mix:
    """rows: (doc_id, members, size, spot, cell). plan: what is taken of each pattern, and the cell where the threshold lies.

    join: joins a frame with `members` with the plan.
    """

    rows: DataFrame
    join: Callable[[DataFrame], DataFrame]

    def edge(self) -> DataFrame:
        """(doc_id, spot, size, taken, ...) of the rows in cells with a threshold, put in order row by row."""
        edge = self.join(self.rows).where("cell = cut")
        order = W.partitionBy("members").orderBy("spot", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
        ahead = F.coalesce(F.sum("size").over(order), F.lit(0))
        more = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("cut_before") - ahead))
        return edge.withColumn("taken", F.col("full") * F.col("size") + more)


def drawn(docs: DataFrame, members: Column, id_col: str, text_col: str, seed: int, cells: int) -> dict[str, Column]:
    """What decides about a document: its sources, its size, its place in the seeded order and the cell of that place."""
    text = text_or_empty(text_col)
    size = word_count(text)
    spot = F.xxhash64(id_col, F.xxhash64(text), F.lit(seed))
    return {"members": members, "size": size, "spot": spot, "cell": F.pmod(spot, F.lit(cells))}


def planned(docs: DataFrame, members: Column, id_col: str, text_col: str, weights: Sequence[float], share: float, epochs: int, seed: int, cells: int) -> Mix:
    what = drawn(docs, members, id_col, text_col, seed, cells)
    rows = written(docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in what.items()]), "sizes")
    sums = written(rows.groupBy("members").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "patterns")
    found = sums.limit(MAX_PATTERNS + 1).collect()
    few = len(found) <= MAX_PATTERNS
    if few:
        plan = flow_plan(docs.sparkSession, found, weights, share, epochs)
    elif sums.where(F.size("members") != 1).isEmpty():
        plan = single_plan(sums, weights, share, epochs)
    else:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of overlapping sources")
    small = F.broadcast if few else lambda df: df
    before = W.partitionBy("members").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cell_sums = rows.groupBy("members", "cell").agg(F.sum("size").alias("words"))
    run = cell_sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).join(small(plan.drop("n")), "members")
    # the cell in which the threshold lies; none where nothing or everything is taken once more
    cuts = run.where("before < rest and rest <= before + words").select("members", F.col("cell").alias("cut"), F.col("before").alias("cut_before"))
    plan = written(plan.join(small(cuts), "members", "left"), "plan")
    if few:
        return Mix(rows, lambda df: df.join(F.broadcast(plan), "members"))
    many = max(1000, rows.count() // PARTS)
    return Mix(rows, lambda df: joined_by_size(df, plan, "members", "n", many).drop("n"))


def mix(docs: DataFrame, members: Column | None = None, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = SEED, cells: int = CELLS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of `docs`.

    members: the array of a document's sources, by default its `source` alone. With several, `source_size` and `target`
    are those of the first in order.
    """
    members = F.array("source") if members is None else F.sort_array(F.array_distinct(members))
    m = planned(docs, members, id_col, text_col, weights, share, epochs, seed, cells)
    out = ["doc_id", "size", "source_size", "target", "taken"]
    once_more = F.when(F.col("cell") < F.col("cut"), F.col("size")).otherwise(F.lit(0).cast("long"))
    plain = m.join(m.rows).where("cell <> cut or cut is null").withColumn("taken", F.col("full") * F.col("size") + once_more)
    return plain.select(*out).unionByName(m.edge().select(*out))


def copies(docs: DataFrame, id_col: str, text_col: str = "text", name: str = "copies", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = SEED, cells: int = CELLS) -> DataFrame:
    """`docs` with the column `name`: how often the mix of its `source` uses a document, in part counting whole.

    Outside the cells with a threshold this follows from the plan where the document is read; only documents of those
    cells are joined by id. Rows that are equal in id and text get the largest number of theirs.
    """
    m = planned(docs, F.array("source"), id_col, text_col, weights, share, epochs, seed, cells)
    what = drawn(docs, F.array("source"), id_col, text_col, seed, cells)
    wide = m.join(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in what.items()]))
    some = F.col("size") > 0
    plain = wide.where("cell <> cut or cut is null").withColumn("n", F.when(some, F.col("full") + F.when(F.col("cell") < F.col("cut"), 1).otherwise(0)).otherwise(0))
    ceil = F.when(some, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)
    edge = written(m.edge().withColumn("n", ceil).groupBy(F.col("spot").alias("at"), F.col("doc_id").alias("id")).agg(F.max("n").alias("n")), "edge")
    inside = wide.where("cell = cut").join(edge, (F.col("spot") == F.col("at")) & F.col(f"row.`{id_col}`").eqNullSafe(F.col("id")))
    return plain.select("row", "n").unionByName(inside.select("row", "n")).select("row.*", F.col("n").cast("int").alias(name))
