"""Near-duplicates on word shingles at a similarity, by covering hashing and an exact check (operator 3).

A SimHash of 64 bits tells texts apart that share 0.8 of their shingles: they differ in some
ten bits, and covering so large a radius takes thousands of tables. So the covering masks
are put over two descriptions of a text: its SimHash, where they guarantee that texts
within two bits meet, and a sketch of POSITIONS least hashes, of which two texts agree in a
share equal to their similarity. Over the sketch, the masks of radius r guarantee that texts
whose sketches differ in r positions at most meet in some table; there are SKETCHES
independent sketches, so that texts of similarity 0.8 hardly ever miss each other in all.

What meets is only a candidate: a link is an exact Jaccard similarity of the sets of
shingles. Shingles that one candidate alone holds bound what it can share with any other,
which leaves out texts and pairs that cannot be similar enough. Buckets do not become pairs:

1. each text is checked against the leader of its largest bucket, the member that shares
   most with others;
2. members are checked against the leaders of all their buckets, where the components that
   the links found so far make differ;
3. what then is left of buckets of several components is checked in blocks: every member
   outside the bucket's largest component against every member of it that is not in its own
   component. Tasks compare a block with a block and hand on a link for each text and
   component, so that no pairs are made and none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_and_text, row_hash, stored
from quarry.llm.components import components
from quarry.llm.simhash import bits_of, masks, signed

SIZE, SIMILARITY, SEED = 5, 0.8, 42
#: Positions of a sketch, differing positions that the masks cover, and sketches.
POSITIONS, RADIUS, SKETCHES = 16, 3, 3
#: Shingles of a block of members in the last step.
BLOCK = 400_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text, A-Z lower-cased; of a shorter text, of all its words."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = zip(*(words[k:] for k in range(size))) if len(words) >= size else [words]
    n = max(1, len(words) - size + 1)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, each), repeat(SEED)), np.uint64, n))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """(SKETCHES, POSITIONS) least hashes of the shingles, each under a function of its own."""
    out = np.full(SKETCHES * POSITIONS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        mixed = (part[:, None] ^ SALTS[None, :]) * MIX
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        out = np.minimum(out, mixed.min(axis=0))
    return out.reshape(SKETCHES, POSITIONS)


SALTS = np.array([xxhash.xxh64_intdigest(b"position %d" % k) for k in range(SKETCHES * POSITIONS)], np.uint64)
SKETCH_MASKS = np.array([[m >> k & 1 for k in range(POSITIONS)] for m in masks(RADIUS, POSITIONS)], bool)
WEIGHTS = np.array([xxhash.xxh64_intdigest(b"weight %d" % k) | 1 for k in range(POSITIONS)], np.uint64)
BIT_MASKS = np.array(masks(), np.uint64)


def bucket_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of all buckets of a text: tables over its SimHash, then over its sketches."""
    print_ = np.uint64(bits_of(hashes))
    tables = [(print_ & BIT_MASKS) * MIX + np.arange(len(BIT_MASKS), dtype=np.uint64)]
    for k, own in enumerate(sketch(hashes)):
        summed = ((own * WEIGHTS)[None, :] * SKETCH_MASKS).sum(axis=1, dtype=np.uint64)
        tables.append(summed ^ (np.uint64(1 + len(BIT_MASKS) + k * len(SKETCH_MASKS)) + np.arange(len(SKETCH_MASKS), dtype=np.uint64)) * MIX)
    return np.concatenate(tables)


SKETCHED = "doc_id bigint, row bigint, node bigint, n int, keys array<bigint>"


def node_of(hashes: np.ndarray) -> int:
    """Texts of equal sets of shingles are one node."""
    return signed(xxhash.xxh64_intdigest(hashes.tobytes()))


def sketched(rows: DataFrame, size: int) -> DataFrame:
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(text.as_py(), size) for text in batch.column(2)]
            keys = [bucket_keys(h).view(np.int64) for h in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([node_of(h) for h in own], pa.int64()), pa.array([len(h) for h in own], pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "row", "node", "n", "keys"])

    return rows.select("doc_id", "row", "text").mapInArrow(compute, SKETCHED)


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """(node, hashes) of the rows' texts."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(text.as_py(), size) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.view(np.int64) for h in own], pa.list_(pa.int64()))], names=["node", "hashes"])

    return rows.select("node", "text").mapInArrow(compute, "node bigint, hashes array<bigint>")


def checked(pairs: DataFrame, sets: DataFrame, similarity: float, tried: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Those of the pairs (a, b) whose sets of shingles are as similar as that, and all that are tried by now."""
    pairs = pairs.distinct()
    if tried is not None:
        pairs = pairs.join(tried.hint("merge"), ["a", "b"], "left_anti")
    pairs = stored(pairs, "candidate-pairs")
    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")).hint("merge"), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")).hint("merge"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = stored(both.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint"), "links")
    return links, pairs if tried is None else tried.union(pairs)


def merged(comp: DataFrame, links: DataFrame) -> DataFrame | None:
    """The components (node, c) after these links (a, b); None if the links join nothing."""
    left, right = (comp.select(F.col("node").alias(x), F.col("c").alias(f"c{x}")).hint("merge") for x in ("a", "b"))
    edges = stored(links.join(left, "a").join(right, "b").where("ca <> cb").select(F.col("ca").alias("u"), F.col("cb").alias("v")).distinct(), "component-links")
    if edges.isEmpty():
        return None
    found = components(edges).withColumnRenamed("node", "c")
    return stored(comp.join(stored(found, "joined-components").hint("merge"), "c", "left").select("node", F.coalesce("component", "c").alias("c")), "node-components")


def members_of(nodes: DataFrame, sets: DataFrame, keys: DataFrame, similarity: float) -> DataFrame:
    """(key, node, n, core) of the members of buckets that may have a partner there.

    ``core`` are the shingles of a text that some other candidate has too.
    """
    each = sets.select("node", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    own = stored(each.groupBy("node").agg(F.count("*").alias("alone")), "shingles-alone")
    able = stored(nodes.join(own.hint("merge"), "node", "left").select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("core")).where(F.col("core") >= similarity * F.col("n")), "able-nodes")
    return stored(keys.join(able.hint("merge"), "node").select("key", "node", "n", "core"), "bucket-members")


def links_of_blocks(now: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): of each member outside its bucket's largest component, a link to every other component it has
    one with. ``now``: (key, node, n, core, c) of the members of split buckets.

    Buckets of the same members are taken once. A bucket of any size is many blocks of some
    ``BLOCK`` shingles (a longer text is one of its own).
    """
    marks = now.groupBy("key").agg(F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"), F.count("*").alias("m")).groupBy("mark", "m").agg(F.min("key").alias("key"))
    one = now.join(stored(marks.select("key"), "different-buckets").hint("merge"), "key")
    main = one.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "c")).alias("main"))
    placed = stored(one.join(stored(main, "main-components").hint("merge"), "key").select("key", "node", "n", "core", "c", (F.col("c") != F.col("main.c")).alias("outside")), "placed-members")
    member = F.struct("node", "n", "core", "c", "hashes").alias("member")

    def blocks(members: DataFrame, name: str) -> DataFrame:
        sizes = stored(members.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks")), f"{name}-sizes")
        dealt = members.join(sizes.hint("merge"), "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        whole = dealt.join(sets.hint("merge"), "node").select("key", "block", member)
        return stored(whole.groupBy("key", "block").agg(F.collect_list("member").alias(name)), f"{name}-blocks").drop("block")

    both = blocks(placed.where("outside"), "outer").join(blocks(placed, "inner").hint("merge"), "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for outer, inner in zip(batch.column("outer"), batch.column("inner")):
                found = linked(outer.values, inner.values, similarity)
                yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], names=["a", "b"])

    return stored(both.select("outer", "inner").mapInArrow(compare, "a bigint, b bigint").distinct(), "links-of-blocks")


def linked(outer: pa.StructArray, inner: pa.StructArray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of an outer and an inner member that are similar, one for each outer member and component."""
    node, n, core, c = (inner.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("node", "n", "core", "c"))
    lists = inner.field("hashes")
    flat = lists.flatten().to_numpy()
    owner = np.repeat(np.arange(len(node)), lists.value_lengths().to_numpy(zero_copy_only=False))
    known, place = np.unique(flat, return_inverse=True)
    out: list[tuple[int, int]] = []
    for x in range(len(outer)):
        own, size, able, group = (outer.field(f)[x].as_py() for f in ("node", "n", "core", "c"))
        hashes = outer.field("hashes")[x].values.to_numpy()
        at = np.searchsorted(known, hashes)
        at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == hashes)] if len(known) else at[:0]
        held = np.zeros(len(known), bool)
        held[at] = True
        shared = np.bincount(owner[held[place]], minlength=len(node))
        most = np.minimum(core, able)
        near = (c != group) & (most >= similarity * (n + size - most)) & (shared >= similarity * (n + size - shared))
        _, first = np.unique(c[near], return_index=True)
        out += [(own, int(y)) for y in node[near][first]]
    return out


def node_components(rows: DataFrame, nodes: DataFrame, size: int, similarity: float, repeated: bool) -> DataFrame:
    """(node, c) of the nodes that share buckets with others: the component of each.

    ``nodes``: (node, n, keys) and the doc_id and row of one of its texts; ``repeated`` says
    whether rows repeat these.
    """
    each = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = stored(each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "shared-buckets")
    keys = stored(each.join(shared.hint("merge"), "key").select("key", "node"), "shared-keys")
    chosen = stored(nodes.join(keys.select("node").distinct().hint("merge"), "node", "left_semi").select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "node", "n"), "candidate-nodes")
    texts = rows.join(chosen.hint("merge"), (rows["row"] == chosen["__row"]) & rows["doc_id"].eqNullSafe(chosen["__id"])).select("node", "text")
    sets = shingle_sets(texts, size)
    sets = stored(sets.dropDuplicates(["node"]) if repeated else sets, "shingle-sets")
    members = members_of(chosen.select("node", "n"), sets, keys, similarity)
    comp = stored(members.select("node", F.col("node").alias("c")).distinct(), "node-components")
    most = F.least("core", "lead.core")  # that the two can share
    able = (F.col("c") != F.col("lead.c")) & (most >= similarity * (F.col("n") + F.col("lead.n") - most))
    own = F.struct("core", "n", "node", "c").alias("own")
    tried = None
    for turn in range(3):
        now = stored(members.join(comp.hint("merge"), "node").select("key", "node", "n", "core", "c"), "members-by-component")
        stats = now.groupBy("key").agg(F.count("*").alias("m"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key", "m")
        now = stored(now.join(stored(stats, "split-buckets").hint("merge"), "key"), "split-members")
        if turn == 2:
            links = links_of_blocks(now.drop("m"), sets, similarity)
        else:
            leaders = stored(now.select("key", "m", own).groupBy("key").agg(F.max("own").alias("lead"), F.max("m").alias("size")), "leaders")
            if leaders.isEmpty():
                return comp
            met = now.join(leaders.hint("merge"), "key")
            if turn == 0:  # the leader of each text's largest bucket
                met = met.groupBy("node", "n", "core", "c").agg(F.max(F.struct("size", "lead")).alias("best")).select("node", "n", "core", "c", "best.lead")
            pairs = met.where(able).select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"))
            links, tried = checked(pairs, sets, similarity, tried)
        comp = merged(comp, links) or comp
    return comp


def near_copies(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, component_id, kept) of every row; ``row`` is a hash of its text.

    Texts link where the sets of their shingles of ``size`` words, A-Z lower-cased, have a
    Jaccard similarity of ``similarity`` or more. Texts without words link with each other
    only; null texts are empty. component_id is the smallest id reachable, null where all
    are. One row of a component is kept: that of the smallest id, of equal ids that of
    the least text hash; a null id is larger than any other. Rows that repeat an id and a
    text are reported each and share their decision. An empty table gives no rows; other
    columns are not read. A text is held whole with its words and shingles, one at a time.

    All candidates, texts that share a bucket, are linked exactly as checking each pair of
    them would.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("row", row_hash(F.col("text")))
    seen = stored(sketched(rows, size), "sketches")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    nodes = stored(seen.groupBy("node").agg(F.min(order).alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys")), "nodes")
    named = nodes.select("node", "n", "keys", F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("row"))
    repeated = not seen.groupBy("doc_id", "row").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    found = node_components(rows, named, size, similarity, repeated)
    in_one = nodes.select("node", "first").join(found.withColumnRenamed("c", "component").hint("merge"), "node", "left").select("node", "first", F.coalesce("component", "node").alias("c"))
    in_one = stored(in_one, "nodes-by-component")
    least = stored(in_one.groupBy("c").agg(F.min("first").alias("least")), "component-heads")
    by_node = in_one.join(least.hint("merge"), "c").select("node", "least")
    out = seen.select("doc_id", "row", "node").join(stored(by_node, "node-heads").hint("merge"), "node")
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("row") == F.col("least.row"))
    return out.select("doc_id", "row", F.col("least.doc_id").alias("component_id"), kept.alias("kept"))
