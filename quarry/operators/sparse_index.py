"""A stored inverted index with block-max pruning for BM25.

Documents of a collection are dealt into ranges of 32 by their length, as texts of one length
gain alike from a term, which keeps bounds close. The index holds what each range has of each
term, with the most that a document of it can gain from the term; a row is one term in a
block of ranges that follow each other. Only the rows of words that are asked leave their
files. A question adds
these bounds up by range; its best ranges are scored first,
and ranges whose bound cannot reach the k-th of those scores are never read. So no table of
questions by documents is formed, but one of questions by ranges, of bounds alone.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from quarry.functions.text import clean_text
from quarry.functions.vectors import tokens
from quarry.sources.scratch import stored

K1, B = 1.2, 0.75
#: Documents of a range, folders that terms are dealt into, ranges that are scored first, and ways a term's ranges are split.
RANGE, FOLDERS, FIRST, SALTS = 32, 64, 32, 16
#: Scores that agree to six decimals are ties, so a bound may fall short by that much.
SLACK = 1e-5
#: Bytes of text whose words a task holds at a time (one range at least), and rows of postings that it hands on at a time.
HELD, ROWS = 16_000_000, 20_000
#: White space beyond ASCII in UTF-8, what becomes of the bytes that stay, and those that go.
WIDE_SPACE = [chr(c).encode() for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
SPACES = b"\t\n\x0b\f\r "
TABLE = bytes.maketrans(SPACES + string.ascii_uppercase.encode(), b" " * len(SPACES) + string.ascii_lowercase.encode())
REMOVED = bytes(sorted(set(range(256)) - set(SPACES + f"{string.ascii_letters}{string.digits}_.-".encode())))


def gain(tf: np.ndarray, length: np.ndarray, average: np.ndarray) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def plain(text: bytes) -> bytes:
    """A text in UTF-8 with the words that ``clean_text`` gives; between them may be more spaces."""
    if not text.isascii():
        for space in WIDE_SPACE:
            text = text.replace(space, b" ")
    return text.translate(TABLE, REMOVED)


def cleaned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [plain(t) if t else b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        lengths = pa.array([len(t.split()) for t in texts], pa.int32())
        columns = [batch.column("g"), batch.column("key"), pa.array(texts, pa.binary()).cast(pa.string()), lengths]
        yield pa.RecordBatch.from_arrays(columns, names=["g", "key", "cleaned", "length"])


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole ranges of one collection, as many as hold some HELD bytes of text, of documents sorted by collection."""
    pieces: list[pa.RecordBatch] = []
    own, n, size = None, 0, 0
    for batch in batches:
        start = 0
        sizes = pc.binary_length(batch.column("cleaned")).to_pylist()
        for at, (g, length) in enumerate(zip(batch.column("g").to_pylist(), sizes)):
            if n and (g != own or (n % RANGE == 0 and size >= HELD)):
                yield pa.Table.from_batches([*pieces, batch.slice(start, at - start)])
                pieces, start, n, size = [], at, 0, 0
            own, n, size = g, n + 1, size + length + 64
        pieces.append(batch.slice(start))
    if n:
        yield pa.Table.from_batches(pieces)


def postings_of(docs: pa.Table, number: int, schema: pa.Schema) -> pa.RecordBatch:
    """A row for each word of a block: its ranges, numbered from ``number``, and its documents, of which
    those of a range end at the range's place in ``ends``."""
    words = pc.ascii_split_whitespace(docs.column("cleaned").combine_chunks())
    flat, doc = words.flatten(), pc.list_parent_indices(words).to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.not_equal(flat, "")
    flat, doc = flat.filter(some).dictionary_encode(), doc[some.to_numpy(zero_copy_only=False)]
    n = len(docs)
    lengths = np.bincount(doc, minlength=n)
    cell, tf = np.unique(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + doc, return_counts=True)
    token, doc = cell // n, cell % n
    of = doc // RANGE
    gains = gain(tf, lengths[doc], docs.column("average").to_numpy()[doc])
    new_token = np.diff(token, prepend=-1) != 0
    starts = np.nonzero(new_token | (np.diff(of, prepend=-1) != 0))[0]  # of each word in each range
    firsts = np.nonzero(new_token[starts])[0]  # of each word, among those
    outer, inner = pa.array(np.r_[firsts, len(starts)], pa.int32()), pa.array(np.r_[starts[firsts], len(cell)], pa.int32())
    ends = np.r_[starts, len(cell)][1:] - np.repeat(starts[firsts], np.diff(np.r_[firsts, len(starts)]))
    best = np.maximum.reduceat(gains, starts) if len(starts) else gains
    by_range = lambda values, kind: pa.ListArray.from_arrays(outer, pa.array(values, kind))
    by_document = lambda values: pa.ListArray.from_arrays(inner, values)
    columns = {
        "g": docs.column("g").combine_chunks().take(pa.array(np.zeros(len(firsts), np.int64))),
        "token": flat.dictionary.take(pa.array(token[starts[firsts]])),
        "ranges": by_range(docs.column("part")[0].as_py() << 32 | number + of[starts], pa.int64()),
        "bests": by_range(best, pa.float64()),
        "ends": by_range(ends, pa.int32()),
        "keys": by_document(docs.column("key").combine_chunks().take(pa.array(doc))),
        "tfs": by_document(pa.array(tf, pa.int32())),
        "lengths": by_document(pa.array(lengths[doc], pa.int32())),
    }
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


def ranges(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Postings by word of blocks of documents, which come sorted by collection and length."""
    number = 0
    for docs in blocks(batches):
        rows = postings_of(docs, number, schema)
        number += -(-len(docs) // RANGE)
        for at in range(0, len(rows), ROWS):
            yield rows.slice(at, ROWS)


def folder(token: str = "token") -> Column:
    return F.pmod(F.xxhash64(token), F.lit(FOLDERS)).cast("int")


@dataclass(frozen=True)
class SparseIndex:
    """Postings and collections under one folder."""

    spark: SparkSession
    folder: str
    key: str
    key_type: str
    group_type: str

    @classmethod
    def build(cls, rows: DataFrame, path: str, key: str = "doc_id", text: str = "text", by: str | None = None) -> SparseIndex:
        """Indexes every text. ``by`` names a column whose values are collections of their own.

        A null text has no words, but counts as a document; rows without a key or, with ``by``,
        without a collection are left out. Texts are cleaned and written once; one task holds
        the postings of one block at a time.
        """
        spark = rows.sparkSession
        group = F.col(by) if by else F.lit(0)
        docs = rows.select(group.alias("g"), F.col(key).alias("key"), F.col(text).alias("text")).where("g IS NOT NULL AND key IS NOT NULL")
        index = cls(spark, path, key, docs.schema["key"].dataType.simpleString(), docs.schema["g"].dataType.simpleString())
        docs = stored(docs.mapInArrow(cleaned, f"g {index.group_type}, key {index.key_type}, cleaned string, length int"), "cleaned")
        docs.groupBy("g").agg(F.count("*").alias("n"), F.avg("length").alias("average")).write.parquet(f"{path}/collections")
        kinds = {f.name: to_arrow_type(f.dataType) for f in docs.schema}
        schema = pa.schema([("g", kinds["g"]), ("token", pa.string()), ("ranges", pa.list_(pa.int64())), ("bests", pa.list_(pa.float64())), ("ends", pa.list_(pa.int32())), ("keys", pa.list_(kinds["key"])), ("tfs", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32()))])
        # collections are read from files, whose size Spark knows: few are sent, many shuffled
        sorted_docs = docs.join(index.read("collections"), "g").repartitionByRange("g", "length", "key").sortWithinPartitions("g", "length", "key").select("g", "key", "cleaned", "average", F.spark_partition_id().cast("long").alias("part"))
        postings = sorted_docs.mapInArrow(lambda batches: ranges(batches, schema), index.ddl("postings").rsplit(",", 1)[0]).withColumn("folder", folder())
        postings.hint("rebalance", F.col("folder")).sortWithinPartitions("folder", "token", "g").write.partitionBy("folder").parquet(f"{path}/postings")
        return index

    def ddl(self, name: str) -> str:
        return {
            "collections": f"g {self.group_type}, n bigint, average double",
            "postings": f"g {self.group_type}, token string, ranges array<bigint>, bests array<double>, ends array<int>, keys array<{self.key_type}>, tfs array<int>, lengths array<int>, folder int",
        }[name]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromDDL(self.ddl(name))).parquet(f"{self.folder}/{name}")

    def wanted(self, queries: DataFrame, query: str, question: str, by: str | None) -> tuple[DataFrame, DataFrame]:
        """(q, g, token, idf, average), the words of each question that its collection has, and their postings.

        The rows of the words that are asked are written once; nothing else of the index is shuffled.
        """
        group = F.col(by) if by else F.lit(0)
        words = F.explode(F.array_distinct(tokens(clean_text(F.col(question)))))
        asked = stored(queries.select(F.col(query).alias("q"), group.alias("g"), words.alias("token")).withColumn("folder", folder()), "question-words")
        distinct = stored(asked.select("folder", "g", "token").distinct(), "asked-words")
        # both are read from files, whose size Spark knows: few words are sent to the postings, many shuffled
        own = self.read("postings").where(F.col("folder").isin(self.folders(distinct))).join(distinct, ["folder", "g", "token"], "left_semi")
        own = stored(own.withColumn("helds", F.expr("transform(ends, (e, i) -> e - if(i > 0, ends[i - 1], 0))")), "asked-postings")
        df = stored(own.groupBy("g", "token").agg(F.sum(F.size("keys")).alias("df")), "asked-terms")
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        wanted = asked.join(df, ["g", "token"]).join(self.read("collections"), "g").select("q", "g", "token", idf.alias("idf"), "average")
        return stored(wanted, "wanted-words"), own

    @staticmethod
    def folders(asked: DataFrame) -> list[int]:
        return [r["folder"] for r in asked.select("folder").distinct().collect()]  # FOLDERS at most

    def bounds(self, wanted: DataFrame, postings: DataFrame) -> DataFrame:
        """(q, g, range, bound, postings): the most a document of a range can score for a question.

        Terms that many ranges hold are split by range, so that a common word is no hot key.
        """
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        salted = wanted.select("q", "g", "token", "idf", salts.alias("salt"))
        own = postings.select("g", "token", F.arrays_zip("ranges", "bests", "helds").alias("each"), F.pmod(F.xxhash64(F.col("ranges")[0]), F.lit(SALTS)).cast("int").alias("salt"))
        met = own.join(salted.hint("shuffle_hash"), ["g", "token", "salt"]).select("q", "g", "idf", F.explode("each").alias("r"))
        bound = F.sum(F.col("idf") * F.col("r.bests")).alias("bound")
        return stored(met.groupBy("q", "g", F.col("r.ranges").alias("range")).agg(bound, F.sum("r.helds").alias("postings")), "bounds")

    def scores(self, wanted: DataFrame, postings: DataFrame, chosen: DataFrame) -> DataFrame:
        """(q, key, score) of all documents of the chosen (q, range) that hold a word of the question."""
        terms = stored(chosen.select("q", "range").join(wanted.hint("shuffle_hash"), "q"), "chosen-ranges")
        part = lambda name: f"'{name}', slice({name}, ends[i] - helds[i] + 1, helds[i])"
        each = F.expr(f"transform(ranges, (r, i) -> named_struct('range', r, {part('keys')}, {part('tfs')}, {part('lengths')}))")
        own = postings.select("g", "token", F.explode(each).alias("r")).select("g", "token", "r.*")
        met = own.join(terms.hint("merge"), ["g", "token", "range"])
        each = met.select("q", "idf", "average", F.explode(F.arrays_zip("keys", "tfs", "lengths")).alias("p"))
        tf, length = F.col("p.tfs"), F.col("p.lengths")
        part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("average")))
        return each.select("q", F.col("p.keys").alias("key"), part.alias("part")).groupBy("q", "key").agg(F.sum("part").alias("score"))

    def survivors(self, wanted: DataFrame, postings: DataFrame, bounds: DataFrame, k: int) -> DataFrame:
        """The bounds that reach the k-th score among each question's first ranges, less the slack."""
        best = Window.partitionBy("q").orderBy(F.desc("bound"), "range")
        first = bounds.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= FIRST)
        by_score = Window.partitionBy("q").orderBy(F.desc("score"))
        least = self.scores(wanted, postings, first).withColumn("turn", F.row_number().over(by_score)).where(F.col("turn") <= k)
        least = stored(least.groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("found")).where(F.col("found") == k), "thresholds")
        return bounds.join(least.hint("shuffle_hash"), "q", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK)

    def search(self, queries: DataFrame, k: int = 10, query: str = "query_id", question: str = "question", by: str | None = None) -> DataFrame:
        """(query, key, score, rank): the k best by BM25, exactly; ties to six decimals go by key."""
        wanted, postings = self.wanted(queries, query, question, by)
        left = self.survivors(wanted, postings, self.bounds(wanted, postings), k)
        order = Window.partitionBy("q").orderBy(F.desc(F.round("score", 6)), "key")
        top = self.scores(wanted, postings, left).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return top.select(F.col("q").alias(query), F.col("key").alias(self.key), "score", "rank")

    def reading(self, queries: DataFrame, k: int = 10, query: str = "query_id", question: str = "question", by: str | None = None) -> DataFrame:
        """(query, postings, read): the postings of each question's words, and those of ranges that are scored."""
        wanted, own = self.wanted(queries, query, question, by)
        bounds = self.bounds(wanted, own)
        read = self.survivors(wanted, own, bounds, k).groupBy("q").agg(F.sum("postings").alias("read"))
        both = bounds.groupBy("q").agg(F.sum("postings").alias("postings")).join(read.hint("shuffle_hash"), "q", "left")
        return both.select(F.col("q").alias(query), "postings", F.coalesce("read", F.lit(0)).alias("read"))
