"""Near copies: texts whose sets of five-word shingles have a similarity (shared over all) of at least 4/5, joined exactly.

Texts with the same set are one node. SimHash comes first: 64-bit fingerprints of the five-word shingles are joined within
`BUDGET` bits by the binary tries of `simhash`, and the links are verified by whole sets. A fingerprint can't show all pairs
of this similarity (two texts at 0.83 may differ in 17 bits), so what it leaves in different components is
joined by shared rare shingles (a prefix filter). Shingles are ordered, rare ones first as far as a table of counts of fixed size
tells, the rest by hash. Two sets that are similar enough share one of the first n - ceil(4n/5) + 1 shingles of each, so
nodes are dealt to the cells of these alone. What stands together in a cell is compared by whole sets: first all with the
cell's most central node, and once these links are joined, what is left between different components, pair by pair.
No pair is lost, whatever the counts; they only decide how many pairs have to be compared.

Whole sets are the largest thing here, so they move last and are never kept for all texts. Each node has a bitmap of its set:
a bit that one of two sets has alone stands for a shingle that it has alone. Pairs that are too far apart by that go,
without loss; only for the nodes of the others are texts read again and sets made, and these go when they are compared.

Defined results: a null text is the empty text; texts without words have the empty set and are one node; texts of up to
five words have one shingle; rows that repeat get the same result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_written, filter_of, made, may_have, ship_package, text_or_empty, written
from .simhash import bits_of, components, hamming_links, shingle_hashes

WORDS = 5
#: The least similarity as a fraction.
NUM, DEN = 4, 5
#: Bits in which fingerprints may differ to be linked at once.
BUDGET = 3
#: Slots of the tables of counts, and slots that are summed in one row.
SLOTS, CHUNK = 1 << 19, 1 << 14
#: Bits of a set's bitmap.
MARKS = 1024
#: Rounds of comparing with a cell's most central node, before what is left is compared pair by pair.
ROUNDS = 3
#: Texts whose cells or sets a worker hands on at once.
BATCH = 500


def shingle_set(text: bytes, k: int = WORDS) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, k), dtype="<u8"))


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def chunked(counts: np.ndarray) -> pd.DataFrame:
    cuts = counts.reshape(-1, CHUNK)
    some = np.flatnonzero(cuts.any(axis=1))
    return pd.DataFrame({"chunk": some, "counts": [cuts[i].tobytes() for i in some]})


def summed(chunks: DataFrame) -> np.ndarray:
    """The sum of tables of counts that come in rows (chunk, counts)."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "counts": [np.sum([np.frombuffer(c, "<i8") for c in pdf["counts"]], axis=0, dtype="<i8").tobytes()]})

    out = np.zeros(SLOTS, np.int64)
    for r in chunks.groupBy("chunk").applyInPandas(add, "chunk long, counts binary").collect():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], "<i8")
    return out


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def marks_of(shingles: np.ndarray) -> np.ndarray:
    bits = np.zeros(MARKS, bool)
    bits[(shingles >> np.uint64(32)) & np.uint64(MARKS - 1)] = True
    return np.packbits(bits, bitorder="little").view("<i8")


def sliced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for i in range(0, len(pdf), BATCH):
            yield pdf.iloc[i : i + BATCH]


def keys_and_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The carried columns with node, fingerprint, size and bitmap of each text; at the end the table of counts of the task."""
    counts, empty = np.zeros(SLOTS, np.int64), None
    for pdf in frames:
        nodes, prints, sizes, marks = [], [], [], []
        for t in pdf["text"]:
            hashes = np.array(shingle_hashes(t.encode(), WORDS), dtype="<u8")
            s = np.unique(hashes)
            nodes.append(node_of(s))
            prints.append(bits_of(hashes))
            sizes.append(len(s))
            marks.append(marks_of(s))
            np.add.at(counts, slots(s), 1)
        kept = {c: pdf[c].astype("object") if pd.api.types.is_string_dtype(pdf[c]) else pdf[c] for c in pdf.columns if c != "text"}
        out = pd.DataFrame(kept).assign(node=nodes, fp=np.array(prints, np.uint64).view(np.int64), size=sizes, marks=pd.Series(marks, dtype="object", index=pdf.index), chunk=pd.array([None] * len(pdf), "Int64"), counts=None)
        empty = out.iloc[:0] if empty is None else empty
        yield out
    if empty is not None:
        sums = chunked(counts)
        yield pd.DataFrame({c: sums[c] if c in sums else pd.Series([None] * len(sums), dtype="object") for c in empty.columns})


def first_cells(frames: Iterator[pd.DataFrame], counts: np.ndarray) -> Iterator[pd.DataFrame]:
    for pdf in sliced(frames):
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for t in pdf["text"]:
            s = shingle_set(t.encode())
            n = len(s)
            if not n:
                continue
            seen = counts[slots(s)]
            p = n - -(-NUM * n // DEN) + 1
            first = s[np.lexsort((s, seen))[:p]]
            for column, x in zip(out, (first.view(np.int64), np.full(p, node_of(s)), np.full(p, n), np.arange(p), np.full(p, int(seen.mean()))), strict=True):
                column.append(x)
        if out[0]:
            yield pd.DataFrame(dict(zip(("cell", "node", "size", "pos", "central"), map(np.concatenate, out), strict=True)))


def sets_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in sliced(frames):
        sets = [shingle_set(t.encode()) for t in pdf["text"]]
        yield pd.DataFrame({"node": [node_of(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]})


def may_reach(a: str, b: str) -> Column:
    """Whether two sets can be similar enough if the shingle of this cell is the first that they share."""
    size = lambda x: F.col(f"{x}size")
    after = lambda x: F.col(f"{x}size") - F.col(f"{x}pos")
    return F.least(after(a), after(b)) * (NUM + DEN) >= NUM * (size(a) + size(b))


def may_be_similar() -> Column:
    """Whether two sets can be similar enough by sizes and bitmaps (sizea, sizeb, marksa, marksb)."""

    def alone(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(f"marks{x}", f"marks{y}", lambda m, n: F.bit_count(m.bitwiseAND(F.bitwise_not(n)))), F.lit(0), lambda n, m: n + m)

    both = F.least(F.col("sizea") - alone("a", "b"), F.col("sizeb") - alone("b", "a"))
    return both * (NUM + DEN) >= NUM * (F.col("sizea") + F.col("sizeb"))


def linked(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. nodes: (node, text_key, size, marks); texts: (text_key, text)."""
    before = made()
    end = lambda x: nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("text_key", "size", "marks")])
    near = written(pairs.distinct().join(end("a"), "a").join(end("b"), "b").where(may_be_similar()).select("a", "b", "text_keya", "text_keyb"), "pairs")
    wanted = near.select(F.explode(F.array("text_keya", "text_keyb")).alias("text_key")).distinct()
    # one text of each node that a pair names; a filter tells most others before they move
    named = may_have(texts, "text_key", filter_of(wanted, "text_key", wanted.count())).where("__may").dropDuplicates(["text_key"]).join(wanted, "text_key", "left_semi")
    sets = written(named.select("text").mapInPandas(sets_of, "node long, shingles array<long>"), "sets")
    whole = near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    similar = written(whole.where(both * (NUM + DEN) >= NUM * (F.size("sa") + F.size("sb"))).select("a", "b"), "similar")
    drop_written(pairs.sparkSession, before, keep=1)
    return similar


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that SimHash proposes, by way of one node for each fingerprint. nodes: (node, fp)."""
    heads = written(nodes.groupBy("fp").agg(F.min("node").alias("head")), "prints")
    same = nodes.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    links = hamming_links(heads.select("fp"), BUDGET)
    ends = lambda x: heads.select(F.col("fp").alias(x), F.col("head").alias(f"{x}_head"))
    near = links.join(ends("a"), "a").join(ends("b"), "b").select(F.least("a_head", "b_head").alias("a"), F.greatest("a_head", "b_head").alias("b"))
    return same.unionByName(near).where("a <> b")


def similar_links(texts: DataFrame, nodes: DataFrame, counts: np.ndarray, proposed: DataFrame) -> DataFrame:
    """Links (a, b) between nodes whose connected components are those of all pairs that are similar enough. texts and nodes as for `linked`; proposed: pairs to look at first."""
    spark = texts.sparkSession
    table = spark.sparkContext.broadcast(counts.astype(np.int32 if counts.max(initial=0) < 1 << 31 else np.int64))
    cell = W.partitionBy("cell")
    cells = texts.select("text").mapInPandas(lambda it: first_cells(it, table.value), "cell long, node long, size long, pos long, central long")
    ends = lambda c, cells: cells.withColumn("lo", F.min(c).over(cell)).withColumn("hi", F.max(c).over(cell)).where("lo < hi").drop("lo", "hi")
    cells = written(ends("node", cells).distinct(), "shared-cells")

    links = linked(proposed, nodes, texts)

    def more(pairs: DataFrame) -> DataFrame:
        return links.unionByName(linked(pairs, nodes, texts))

    def open_cells(cells: DataFrame) -> DataFrame:
        """The cells with nodes of different components."""
        roots = written(components(links), "roots")
        return written(ends("root", cells.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))), "open-cells")

    cells = open_cells(cells)
    for _ in range(ROUNDS):
        if cells.isEmpty():
            return links
        head = F.first(F.struct("node", "size", "pos", "root")).over(cell.orderBy(F.desc("central"), "node"))
        cells = written(cells.withColumn("h", head).select("*", *[F.col(f"h.{c}").alias(f"h_{c}") for c in ("node", "size", "pos", "root")]).drop("h").where("node <> h_node"), "headed")
        # what is in the head's component already need not be compared with it
        links = more(cells.where(F.col("root") != F.col("h_root")).where(may_reach("", "h_")).select(F.least("node", "h_node").alias("a"), F.greatest("node", "h_node").alias("b")))
        cells = open_cells(cells.drop("root", "h_node", "h_size", "h_pos", "h_root"))
    a, b = (cells.select("cell", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "size", "pos", "root")]) for x in "ab")
    return more(a.join(b, (a.cell == b.cell) & (F.col("a_node") < F.col("b_node")) & (F.col("a_root") != F.col("b_root")) & may_reach("a_", "b_")).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))


def near_copy_groups(rows: DataFrame) -> DataFrame:
    """The columns of `rows` but `text`, and `root`: a number that is the same for near copies, the near copies of these, and so on.

    rows: `text` and columns without nulls.
    """
    ship_package(rows.sparkSession)
    carried = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in carried] + ["text_key long", "node long", "fp long", "size long", "marks array<long>", "chunk long", "counts binary"])
    text_key = F.xxhash64("text").alias("text_key")
    both = written(rows.select(*[f.name for f in carried], text_key, "text").mapInPandas(keys_and_counts, schema), "nodes")
    keys = both.where("chunk is null")
    nodes = written(keys.groupBy("node").agg(F.min("text_key").alias("text_key"), F.first("size").alias("size"), F.first("marks").alias("marks")), "sizes")
    proposed = simhash_pairs(keys.select("node", "fp").distinct())
    links = similar_links(rows.select(text_key, "text"), nodes, summed(both.where("chunk is not null").select("chunk", "counts")), proposed)
    roots = written(components(links), "roots")
    return keys.select(*[f.name for f in carried], "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of every row of `docs`: the smallest id among its near copies, the near copies of these, and so on."""
    no_id = F.col(id_col).isNull()
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), no_id.alias("no_id"), text_or_empty(text_col).alias("text"))
    groups = written(near_copy_groups(rows).withColumn("doc_id", F.when(~F.col("no_id"), F.col("id"))), "groups")
    ids = groups.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return groups.join(ids, "root").select("doc_id", "component_id")
