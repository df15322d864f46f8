"""Exact dedup over an extendible-hash index on shared files (operator 9).

DataFrame functions only.

1. Directory. The low bits of a text's 64-bit key are its slot. The directory maps slots to
   buckets: it starts with one bucket and doubles while some bucket is over its capacity and
   as deep as the directory. Each owner task has a range of buckets with about as many rows
   as any other.
2. Index. Rows go through the directory to the owner of their bucket. Equal texts meet there
   byte by byte, in an aggregation, and each owner writes the entries of its buckets as one
   sorted file: a key's smallest id, its number of rows, and how many different texts share
   the key (its chain).
3. Probe. Ids and keys go through the directory to the same owners, which look them up in
   the files of their buckets. Only rows of keys with a longer chain compare bytes again.

A key with more rows than an owner's share is dealt out among several owners, whose entries
of it are put together; there are at most as many such keys as owners.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bytewise import xxhash
from quarry.llm.common import WORD_GAP, id_and_text, partitions, stored

#: Keys a bucket holds before it is split, and the most slots (as bits) of the directory. With
#: more keys than TARGET buckets of that capacity hold, buckets hold more, so that the directory
#: is always deep enough to split any that is over its capacity.
CAPACITY, MAX_DEPTH, TARGET = 4096, 16, 1 << 14


def directory(cells: dict[int, int], capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[int, list[int]]:
    """(global depth, bucket of each directory entry) for numbers of keys by their low max_depth bits."""

    def keys_in(low: int, depth: int) -> int:
        return sum(cells.get(x, 0) for x in range(low, 1 << max_depth, 1 << depth))

    depth, entries = 0, [(0, 0)]  # an entry: the low bits and the depth of its bucket
    waiting = [(0, 0)]
    while waiting:
        low, local = waiting.pop()
        if local == max_depth or keys_in(low, local) <= capacity:
            continue
        if local == depth:
            depth, entries = depth + 1, entries + entries
        halves = [(low, local + 1), (low | 1 << local, local + 1)]
        for half, own in halves:
            for x in range(half, 1 << depth, 1 << own):
                entries[x] = (half, own)
        waiting += halves
    number = {bucket: k for k, bucket in enumerate(sorted(set(entries)))}
    return depth, [number[bucket] for bucket in entries]


def owners(weights: list[int], n: int) -> list[int]:
    """The owner, of ``n``, of each bucket: ranges of buckets with about equal weights."""
    total, before, out = max(sum(weights), 1), 0, []
    for w in weights:
        out.append(min(n - 1, (2 * before + w) * n // (2 * total)))
        before += w
    return out


class Router:
    """Sends (doc_id, key) rows through the directory to the owners of their buckets."""

    def __init__(self, keys: DataFrame, capacity: int = CAPACITY):
        spark = keys.sparkSession
        self.owners = partitions(spark)
        counts = stored(keys.groupBy("key").agg(F.count("*").alias("n")), "key-counts")
        cell = F.expr(f"cast(key & {(1 << MAX_DEPTH) - 1} as int)")
        cells = counts.groupBy(cell.alias("cell")).agg(F.count("*").alias("keys"), F.sum("n").alias("rows")).collect()  # 2 ** MAX_DEPTH rows at most
        capacity = max(capacity, sum(r["keys"] for r in cells) // TARGET)
        self.depth, buckets = directory({r["cell"]: r["keys"] for r in cells}, capacity)
        rows = [0] * (max(buckets) + 1)
        for r in cells:
            rows[buckets[r["cell"] & (1 << self.depth) - 1]] += r["rows"]
        own = owners(rows, self.owners)
        self.entries = spark.createDataFrame([(slot, b, own[b]) for slot, b in enumerate(buckets)], "slot int, bucket int, owner int")
        share = max(1, sum(rows) // self.owners)
        # at most one key for each owner
        self.hot = counts.where(F.col("n") > share).select("key", F.ceil(F.col("n") / share).cast("int").alias("shares"))

    def __call__(self, rows: DataFrame) -> DataFrame:
        """Adds bucket, owner (of one share of the rows, where a key has several) and shares."""
        slotted = rows.withColumn("slot", F.expr(f"cast(key & {(1 << self.depth) - 1} as int)")).join(F.broadcast(self.entries), "slot").drop("slot")
        dealt = slotted.join(F.broadcast(self.hot), "key", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
        turn = F.pmod(F.xxhash64("doc_id") + F.spark_partition_id(), F.col("shares")).cast("int")
        return dealt.withColumn("owner", (F.col("owner") + turn) % self.owners)

    def owned(self, rows: DataFrame) -> DataFrame:
        """One task an owner."""
        return rows.repartitionById(self.owners, F.col("owner"))


def write_index(texts: DataFrame, router: Router) -> DataFrame:
    """Index entries of (doc_id, key, norm), written by their owners as sorted files and read back.

    A key that is dealt out has an entry, with its text, for each of its owners.
    """
    met = router.owned(router(texts)).groupBy("owner", "bucket", "key", "shares", "norm").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    shown = met.select("owner", "bucket", "key", "shares", "first", "n", F.sha2("norm", 256).alias("sha"), F.when(F.col("shares") > 1, F.col("norm")).alias("body"))
    entries = shown.groupBy("owner", "bucket", "key", "shares").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.count("*").cast("int").alias("chain"), F.max("sha").alias("text_sha256"), F.max("body").alias("body"))
    return stored(entries.sortWithinPartitions("bucket", "key"), "dedup-index")


def complete(index: DataFrame, router: Router) -> DataFrame:
    """One entry a key at each owner that may be asked for it."""
    fields = ["owner", "bucket", "key", "first", "n", "chain", "text_sha256"]
    dealt = index.where("shares > 1").groupBy("bucket", "key", "shares").agg(
        F.min("owner").alias("owner"), F.min("first").alias("first"), F.sum("n").alias("n"), F.max("text_sha256").alias("text_sha256"),
        F.greatest(F.max("chain"), F.when(F.min("body") == F.max("body"), 1).otherwise(2)).alias("chain"),
    )
    # its rows may come to any owner within ``shares`` of the bucket's own
    base = dealt.drop("owner").withColumn("slot", F.expr(f"cast(key & {(1 << router.depth) - 1} as int)")).join(F.broadcast(router.entries.drop("bucket")), "slot")
    copies = base.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumn("owner", (F.col("owner") + F.col("turn")) % router.owners)
    return index.where("shares = 1").select(*fields).unionByName(copies.select(*fields))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64) -> DataFrame:
    """(doc_id, key, norm) of every row. Fewer key bits make keys collide, for tests."""
    rows = id_and_text(docs, id_col, text_col)
    norm = F.regexp_replace("text", WORD_GAP, " ")
    return rows.select("doc_id", norm.alias("norm")).select("doc_id", xxhash(F.col("norm"), key_bits).alias("key"), "norm")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64, capacity: int = CAPACITY) -> DataFrame:
    """Group of equal normalised texts of every row; dropped rows are returned too.

    Texts are equal when identical after each run of white space is one space. Of a
    group the row with the smallest id stays. Null texts are empty texts. A null id is
    larger than any other, so such a row stays only where its group has no id; rows that
    repeat an id and a text are reported each, kept or not together. An empty table gives
    an empty result.
    """
    texts = keyed(docs, id_col, text_col, key_bits)
    keys = stored(texts.select("doc_id", "key"), "dedup-keys")
    router = Router(keys, capacity)
    index = write_index(texts, router)
    entries = complete(index, router)
    found = router.owned(router(keys).select("doc_id", "key", "bucket", "owner")).join(router.owned(entries).hint("merge"), ["owner", "bucket", "key"])
    out = found.where("chain = 1").select("doc_id", F.col("first").alias("keep_id"), F.col("n").alias("group_size"), "text_sha256")
    chained = entries.where("chain > 1").select("key").distinct()
    if not chained.isEmpty():
        out = out.union(compared(stored(texts.join(chained.hint("merge"), "key", "left_semi"), "chained-texts")))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def compared(texts: DataFrame) -> DataFrame:
    """Groups of equal bytes among the texts of keys that more than one text shares."""
    links = stored(texts.groupBy("key", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "chains")
    return texts.join(links.hint("merge"), ["key", "norm"]).select("doc_id", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, one for each distinct text."""
    groups = stored(exact_groups(docs, id_col, text_col), "exact-groups")
    kept = groups.where("kept").select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_sha")).distinct()
    same_id = docs[id_col].cast("long").eqNullSafe(kept["__kept_id"])
    if groups.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        return docs.join(kept.hint("merge"), same_id, "left_semi")
    # an id is repeated: its rows are told apart by their texts
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WORD_GAP, " "), 256)
    row = F.struct(*docs.columns)
    own = docs.select(row.alias("__row"), F.col(id_col).cast("long").alias("__id"), sha.alias("__sha"))
    joined = own.join(kept.hint("merge"), own["__id"].eqNullSafe(kept["__kept_id"]) & (own["__sha"] == kept["__kept_sha"]), "left_semi")
    return joined.dropDuplicates(["__id", "__sha"]).select("__row.*")


SQL = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
