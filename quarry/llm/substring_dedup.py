"""Substring dedup through prefix-partitioned suffix trees (operator 4).

A window is WINDOW consecutive words; it is removed if its words also start in a document
with a smaller id. That is the question which leaves lie under each suffix-tree node that
is WINDOW words deep. Only suffixes that can share such a node are put into trees:

1. Anchors. Of the K-word stretches in a window the one with the least hash is its anchor,
   so equal windows have equal anchors, and consecutive windows mostly have the same one. A
   row is written for each run of windows of one anchor: the anchor's hash, and the hash of
   all the run's words. Rows of one hash pair are one path without branches: all windows of
   all its occurrences but those in its first document are removed as they stand.
2. Suffixes. Only where runs of one anchor differ do the windows of each run's first
   document have to be told apart. They become suffixes, written as BLOCKS symbols, each
   the hash of WINDOW / BLOCKS words.
3. Trees. Suffixes are dealt out by prefixes of variable length: a prefix that more than a
   group's share of suffixes have is lengthened by a symbol. A task sorts its suffixes,
   takes the lengths of the prefixes that neighbours share, and from these the internal
   nodes of its subtrees. The nodes WINDOW words deep hold the repeats; their first leaf lies
   in the smallest document. Suffixes that are equal throughout and too many for a group are
   one node; its minimum is aggregated.
4. The words under removed windows are left out of the text.

Deep nodes of one document that follow each other word by word are one maximal repeat: see
``maximal_repeats``. Words are compared by their hashes, 128 bits of a run and 160 of a suffix;
``maximal_repeats`` returns the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_and_text, partitions, stored
from quarry.llm.rolling import Rolling

WINDOW, K, BLOCKS = 50, 10, 5
#: Most suffixes that share a prefix before it is lengthened, and the least such number.
GROUP, LEAST_GROUP = 1_000_000, 1_000
#: Long prefixes that are sent to every task: 24 MB at most.
SENT = 1_000_000
SYMBOLS = [f"s{k}" for k in range(BLOCKS)]

RUNS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("anchor", pa.int64()), ("content", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
RUNS_DDL = "doc_id bigint, row bigint, anchor bigint, content bigint, start int, end int"


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def runs_of(words: list[bytes], window: int, k: int) -> tuple[np.ndarray, ...]:
    """(anchor, content, first window, last window) of each run of windows with one anchor."""
    rolling = Rolling(word_hashes(words))
    gram = rolling.windows(k)
    span = window - k + 1
    at = np.lib.stride_tricks.sliding_window_view(gram, span).argmin(axis=1) + np.arange(len(gram) - span + 1)
    start = np.nonzero(np.r_[True, at[1:] != at[:-1]])[0]
    end = np.r_[start[1:], len(at)] - 1
    place = at[start]
    # where the anchor stands in the run, and how long the run is, belong to what it holds
    shape = (place - start) * np.int64(1 << 20) + (end - start)
    return gram[place], rolling.stretches(start, end + window) ^ Rolling(shape.astype(np.uint64)).windows(1), start, end


def anchored(rows: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for doc_id, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = text.as_py().encode("utf-8").split()
                if len(words) >= window:
                    anchor, content, start, end = runs_of(words, window, k)
                    found.append((np.full(len(start), doc_id), np.full(len(start), row), anchor.view(np.int64), content.view(np.int64), start.astype(np.int32), end.astype(np.int32)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], schema=RUNS)

    return rows.where("doc_id IS NOT NULL").select("doc_id", "row", "text").mapInArrow(compute, RUNS_DDL)


SUFFIXES_DDL = "doc_id bigint, row bigint, start int, " + ", ".join(f"{s} int" for s in SYMBOLS)


def suffixes(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """The windows of ``runs`` (array of start, end) of each text as suffixes of BLOCKS symbols."""
    size = window // BLOCKS

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = []
            head: list[np.ndarray] = []
            for doc_id, row, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                block = Rolling(word_hashes(text.as_py().encode("utf-8").split())).windows(size)
                starts = np.unique(np.concatenate([np.arange(r["start"], r["end"] + 1) for r in runs]))
                found.append((block[starts[:, None] + size * np.arange(BLOCKS)] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                head.append(np.stack([np.full(len(starts), doc_id), np.full(len(starts), row), starts], axis=1))
            if found:
                ids, symbols = np.concatenate(head), np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(ids[:, 2].astype(np.int32)), *(pa.array(symbols[:, k]) for k in range(BLOCKS))], names=["doc_id", "row", "start", *SYMBOLS])

    return texts.select("doc_id", "row", "text", "runs").mapInArrow(compute, SUFFIXES_DDL)


def shared_prefixes(symbols: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """How many symbols each of the sorted suffixes shares with the one before; the first with ``last``."""
    before = np.concatenate([symbols[:1] if last is None else last[None, :], symbols[:-1]])
    out = np.cumprod(symbols == before, axis=1).sum(axis=1)
    if last is None and len(out):
        out[0] = 0
    return out


def internal_nodes(shared: np.ndarray) -> list[tuple[int, int, int]]:
    """(depth, first leaf, last leaf) of the internal nodes of the tree of sorted suffixes, from
    the prefixes that neighbours share, by a stack of the nodes that are still open."""
    nodes, open_nodes = [], [(0, 0)]
    for k in range(1, len(shared) + 1):
        depth, left = int(shared[k]) if k < len(shared) else 0, k - 1
        while open_nodes[-1][0] > depth:
            own, left = open_nodes.pop()
            nodes.append((own, left, k - 1))
        if open_nodes[-1][0] < depth:
            open_nodes.append((depth, left))
    return nodes


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves (doc_id, row, start) under deep internal nodes that lie in a later document than
    the node's first; the suffixes come sorted by symbols, then document."""
    last, least = None, None  # the leaf that the batch before ended in, and the first document of its node
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        symbols = np.stack([batch.column(3 + k).to_numpy() for k in range(BLOCKS)], axis=1)
        doc = batch.column(0).to_numpy()
        shared = shared_prefixes(symbols, last)
        first = doc.copy()
        # only nodes as deep as the suffixes matter: where neighbours share less, the tree is cut before it is built
        deep = np.nonzero(shared == BLOCKS)[0]
        for part in np.split(deep, np.nonzero(np.diff(deep) > 1)[0] + 1) if len(deep) else ():
            left = max(int(part[0]) - 1, 0)
            for _, low, high in internal_nodes(np.r_[0, shared[left + 1 : part[-1] + 1]]):
                first[left + low : left + high + 1] = doc[left + low]
        going_on = int(np.argmax(shared < BLOCKS)) if (shared < BLOCKS).any() else n
        if going_on:  # the node that the batch before ended in
            first[:going_on] = least
        last, least = symbols[-1], first[-1]
        later = pa.array(doc > first)
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(later) for k in range(3)], names=["doc_id", "row", "start"])


def later_leaves(leaves: DataFrame, group: int = GROUP, least_group: int = LEAST_GROUP) -> DataFrame:
    """(doc_id, row, start) of the suffixes whose words also start in an earlier document."""
    spark = leaves.sparkSession
    n = partitions(spark)
    most = max(least_group, min(group, leaves.count() // (4 * n)))
    depth, large = F.lit(1), False
    flat = leaves
    for k in range(1, BLOCKS + 1):
        prefix = SYMBOLS[:k]
        # at most one in ``most`` suffixes
        long = stored(leaves.groupBy(*prefix).agg(F.count("*").alias("c")).where(F.col("c") > most).select(*prefix, F.lit(True).alias(f"long{k}")), "long-prefixes")
        found = long.count()
        if not found:
            break
        # sent to the tasks up to a size, as long prefixes are hot keys; beyond it they are dealt out
        flat = flat.join(F.broadcast(long) if found <= SENT else long.hint("merge"), prefix, "left")
        depth, large = F.when(F.col(f"long{k}"), F.lit(k + 1)).otherwise(depth), k == BLOCKS
    fields = ["doc_id", "row", "start", *SYMBOLS]
    flat = flat.select(*fields, depth.alias("depth"))
    key = F.coalesce(*[F.when(F.col("depth") == k, F.xxhash64(*SYMBOLS[:k])) for k in range(1, BLOCKS + 1)])
    trees = flat.where(F.col("depth") <= BLOCKS).withColumn("key", key).repartition(n, "key").sortWithinPartitions(*SYMBOLS, "doc_id")
    out = trees.select(*fields).mapInArrow(walk, "doc_id bigint, row bigint, start int")
    if large:
        single = flat.where(F.col("depth") > BLOCKS)
        least = stored(single.groupBy(*SYMBOLS).agg(F.min("doc_id").alias("least")), "large-nodes")
        out = out.union(single.join(F.broadcast(least) if found <= SENT else least.hint("merge"), SYMBOLS).where("doc_id > least").select("doc_id", "row", "start"))
    return out


CLEANED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])


def cleaned(texts: DataFrame, window: int, digest: bool) -> DataFrame:
    """The words that are left of each text, as a text or as its SHA-256."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, gone in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = text.as_py().encode("utf-8").split()
                n = len(words)
                if gone:
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, [g["start"] for g in gone], 1)
                    np.add.at(edge, [g["end"] + window for g in gone], -1)
                    words = [words[k] for k in np.nonzero(np.cumsum(edge)[:n] == 0)[0].tolist()]
                left = b" ".join(words)
                out.append((doc_id, n, n - len(words), hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8")))
            columns = zip(*out) if out else [[]] * len(CLEANED)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, CLEANED)], schema=CLEANED)

    return texts.select("doc_id", "text", "gone").mapInArrow(compute, "doc_id bigint, n_words bigint, n_removed bigint, text string")


def repeated_windows(rows: DataFrame, window: int, k: int, group: int, least_group: int) -> DataFrame:
    """(doc_id, row, start, end): windows, by the first and the last of a run, that also start in an earlier document."""
    runs = stored(anchored(rows, window, k), "runs")
    paths = runs.groupBy("anchor", "content").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    paths = stored(paths, "paths")
    branches = stored(paths.groupBy("anchor").agg(F.min("first").alias("low"), F.max("first").alias("high"), F.count("*").alias("kinds")).where("kinds > 1 AND low < high").select("anchor", F.lit(True).alias("branch")), "branches")
    wanted = stored(paths.join(branches.hint("merge"), "anchor", "left").where("branch OR first < last").select("anchor", "content", "first", "branch"), "wanted-paths")
    marked = stored(runs.join(wanted.hint("merge"), ["anchor", "content"]).select("doc_id", "row", "start", "end", (F.col("doc_id") > F.col("first")).alias("copy"), "branch"), "marked-runs")
    told = marked.where("branch AND NOT copy").groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    leaves = stored(suffixes(rows.join(told.hint("merge"), ["doc_id", "row"]), window), "suffixes")
    later = later_leaves(leaves, group, least_group).select("doc_id", "row", "start", F.col("start").alias("end"))
    return marked.where("copy").select("doc_id", "row", "start", "end").union(later)


def maximal_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, least_group: int = LEAST_GROUP) -> DataFrame:
    """(doc_id, row, start, n_words, passage) of every maximal stretch of windows that are repeated from earlier documents.

    ``start`` counts words from 0; ``passage`` is the stretch's words, one space between.
    Longer by a word on either side, a stretch would hold a window that no earlier document
    has. Null texts and null ids as in ``substring_dedup``.
    """
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("row"), "text")
    gone = repeated_windows(rows, window, k, group, least_group).groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "end")).alias("gone"))
    texts = rows.join(gone.hint("merge"), ["doc_id", "row"])

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, row, text, gone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                words = text.as_py().encode("utf-8").split()
                low = high = None
                for start, end in [*sorted((g["start"], g["end"]) for g in gone), (len(words) + 1, 0)]:
                    if high is not None and start > high + 1:
                        out.append((doc_id, row, low, high - low + window, b" ".join(words[low : high + window]).decode("utf-8")))
                        high = None
                    low, high = (start, end) if high is None else (low, max(high, end))
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "row", "start", "n_words", "passage"])

    return texts.select("doc_id", "row", "text", "gone").mapInArrow(stretch, "doc_id bigint, row bigint, start bigint, n_words bigint, passage string")


def substring_dedup(docs: DataFrame, digest: bool = False, window: int = WINDOW, k: int = K, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, least_group: int = LEAST_GROUP) -> DataFrame:
    """(doc_id, n_words, n_removed, text) of every row; with ``digest`` text is the SHA-256 of the text.

    Null texts have no words. Rows with a null id lose no words and take none from others.
    Rows that repeat an id count as one document: none removes another's words. An empty table
    gives no rows; other columns are not read.
    """
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("row"), "text")
    gone = repeated_windows(rows, window, k, group, least_group)
    gone = gone.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "end")).alias("gone"))
    return cleaned(rows.join(gone.hint("merge"), ["doc_id", "row"], "left"), window, digest)
