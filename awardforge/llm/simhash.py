"""SimHash near-duplicates by BK-trees.

The fingerprints are cut into blocks: two that differ in ``radius`` bits or fewer agree on all but
``radius`` of the blocks, so for each choice of the agreeing blocks those fingerprints that share
their bits form one shard. Each shard becomes a BK-tree (children keyed by their Hamming distance to
the parent) and its members search it, following only edges within the radius. Trees go to the tasks
through a shuffle, because their total grows with the corpus; a shard over ``tree_limit`` members is
cut into several trees that all of its members search, so no task holds an unbounded tree and no link is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import jaccard, shared
from .graph import components

BITS = 64


def _fingerprint(text: bytes, shingle: int, seed: int) -> int:
    from xxhash import xxh64_intdigest

    tokens = text.split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(tokens) > shingle:
        starts, ends = starts[: 1 - shingle or None], ends[shingle - 1 :]
    else:
        starts, ends = [0], [len(joined)]
    votes, n = np.zeros(BITS, np.int64), len(starts)
    for at in range(0, n, 100_000):
        pairs = zip(map(int, starts[at : at + 100_000]), map(int, ends[at : at + 100_000]), strict=True)
        h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in pairs], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` for each row: fp holds the 64 bits as a signed long. A null text is an empty one, with fingerprint zero."""
    shared.small_batches(docs.sparkSession)

    def task(batches):
        for batch in batches:
            data, offsets = shared.text_buffer(batch.column("text"))
            data = shared._LOWER[data].tobytes()
            fp = np.array([_fingerprint(data[offsets[k] : offsets[k + 1]], shingle, seed) for k in range(batch.num_rows)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(task, "doc_id long, fp long")


class BKTree:
    """A metric tree over 64-bit integers under Hamming distance."""

    def __init__(self, values: list[int]):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        for k in range(1, len(values)):
            self._add(k)

    def _add(self, k: int) -> None:
        at, value = 0, self.values[k]
        while True:
            d = (self.values[at] ^ value).bit_count()
            child = self.children[at].get(d)
            if child is None:
                self.children[at][d] = k
                return
            at = child

    def within(self, value: int, radius: int):
        """The members at ``radius`` or less from ``value``."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield self.values[at]
            children = self.children[at]
            if len(children) <= 2 * radius + 1:
                todo.extend(c for e, c in children.items() if d - radius <= e <= d + radius)
            else:
                todo.extend(children[e] for e in range(d - radius, d + radius + 1) if e in children)


def _shard_keys(fp: Column, radius: int, blocks: int) -> list[Column]:
    """One key for each choice of ``blocks - radius`` blocks: the choice's number and the bits of its blocks."""
    width = -(-BITS // blocks)
    keys = []
    for choice in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << width) - 1) << (width * b) for b in choice) & (2**64 - 1)
        signed = mask - 2**64 if mask >= 2**63 else mask
        keys.append(F.struct(F.lit(len(keys)).alias("choice"), fp.bitwiseAND(F.lit(signed).cast("long")).alias("bits")))
    return keys


def near_links(distinct: DataFrame, radius: int = 2, blocks: int = 4, tree_limit: int = 1000) -> DataFrame:
    """Links ``(a long, b long)`` between distinct fingerprints ``fp`` at ``radius`` bits or fewer, each found at least once.

    All pairs inside a shard are not made: a tree's search gives only members within the radius.
    """
    member = distinct.select("fp", F.explode(F.array(*_shard_keys(F.col("fp"), radius, blocks))).alias("k")).select("fp", "k.choice", "k.bits")
    sizes = member.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    trees = F.ceil(F.col("n") / tree_limit).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    placed = member.join(sizes, ["choice", "bits"]).withColumn("trees", trees).withColumn("own", own)
    # a member stands in its own tree (role 0) and searches that tree and the later ones (role 1)
    seats = F.transform(F.sequence(F.col("own"), F.col("trees") - 1), lambda t: F.struct(t.alias("tree"), (t == F.col("own")).alias("stands")))
    seated = placed.select("fp", "choice", "bits", F.explode(seats).alias("s")).select("choice", "bits", "s.tree", "s.stands", "fp")
    parts = shared.partitions(distinct.sparkSession)
    dealt = seated.repartition(parts, "choice", "bits", "tree").sortWithinPartitions("choice", "bits", "tree")

    def task(batches):
        key, stand, seek = None, [], []

        def search():
            found = []
            if stand:
                tree = BKTree(stand)
                for a in stand + seek:
                    found.extend((a, b) for b in tree.within(a, radius) if b != a)
            return found

        out: list[tuple[int, int]] = []
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(4)]
            values = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64).tolist()
            for choice, bits, tree, stands, fp in zip(*cols, values, strict=True):
                if (choice, bits, tree) != key:
                    out.extend(search())
                    key, stand, seek = (choice, bits, tree), [], []
                (stand if stands else seek).append(fp)
            if len(out) > 20_000:
                yield _link_batch(out)
                out = []
        out.extend(search())
        if out:
            yield _link_batch(out)

    return dealt.mapInArrow(task, "a long, b long")


def _link_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(pairs, dtype=np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, 0])), pa.array(np.ascontiguousarray(ends[:, 1]))], names=["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, radius: int = 2, blocks: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each document; component_id is the smallest doc_id reachable over links.

    Equal fingerprints are one node, so copies are never paired. A null or empty text has fingerprint
    zero and links like any other; repeated rows come back each; a null doc_id stays null and is never
    the smallest (a class of null ids alone has a null component); extra columns are ignored.
    """
    marks = shared.saved(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = marks.groupBy("fp").agg(F.min("doc_id").alias("smallest"))
    nodes = components(shared.saved(near_links(distinct.select("fp"), radius, blocks), "links"))
    classes = distinct.join(nodes, distinct["fp"] == nodes["node"], "left").select("fp", "smallest", F.coalesce("component", "fp").alias("class"))
    least = classes.groupBy("class").agg(F.min("smallest").alias("component_id"))
    named = classes.join(least, "class").select("fp", "component_id")
    return marks.join(named, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(shared.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class of five-word Jaccard similarity 0.8 or more: of the smallest doc_id.

    Pairs of that similarity are about 10 bits apart, too far for block shards, so the classes come from
    :mod:`jaccard`. A doc_id that has several texts keeps those that stand for their class, one for each, not all that it has.
    Rows without a doc_id belong to no class and stay.
    """
    found = shared.saved(jaccard.classes(docs, shingle=5), "classes")
    # the texts of a class that its smallest doc_id has: the same one on every run
    chosen = found.where("doc_id = component_id").groupBy("class").agg(F.min(F.struct("doc_id", "node")).alias("x")).select("x.*")
    mixed = found.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc_id")
    named = docs.where("doc_id is not null")
    one = lambda df, *by: df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy("text"))).where("_n = 1").drop("_n")
    alone = one(named.join(chosen.join(mixed, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_semi"), "doc_id")
    # only rows of such a doc_id are read again for which text each has
    several = jaccard.with_node(named.join(chosen.join(mixed, "doc_id", "left_semi").select("doc_id").distinct(), "doc_id", "left_semi"), 5)
    several = one(several.join(chosen.withColumnRenamed("node", "_node"), ["doc_id", "_node"], "left_semi"), "doc_id", "_node")
    return alone.select(*docs.columns).unionByName(several.select(*docs.columns)).unionByName(docs.where("doc_id is null"))
