"""SimHash near-duplicates through covering locality-sensitive hashing (operator 3).

Tables. For radius r each bit of a fingerprint gets a code of r + 1 bits that is not zero
(in groups of neighbouring bits here). There is one table for each vector v <> 0 of r + 1
bits; its mask keeps the bits whose code has an odd inner product with v. Two fingerprints
that differ in r bits at most have r differing codes, which some v <> 0 is orthogonal to:
in that table the mask hides every differing bit, so the pair is certain to collide.

Members of a small bucket, as chance makes them, are compared with each other. Inside a
large one no pairs are formed. Two fingerprints differ in two bits at most if, and
only if, some value lies within one bit of both, so each member of the bucket names the values within one bit of it (its hidden bits only), and those that name
the same value are linked in a star. Such a group holds at most one more than there are
hidden bits, however large the bucket is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_and_text, stored
from quarry.llm.components import components

BITS, RADIUS, SEED = 64, 2, 42
#: Shingles whose hashes lie in memory at a time.
PIECE = 1 << 16


def simhash(words: list[bytes], size: int) -> int:
    """A bit is 1 if it is set in more than half of the shingles' hashes."""
    if not words:
        return 0
    if len(words) < size:
        shingles, n = iter([words]), 1
    else:
        shingles, n = zip(*(words[k:] for k in range(size))), len(words) - size + 1
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(SEED))
    counts, left = np.zeros(BITS, np.int64), n
    while left:
        now = min(left, PIECE)
        add_bits(counts, np.fromiter(hashes, "<u8", now))
        left -= now
    return majority(counts, n)


def add_bits(counts: np.ndarray, h: np.ndarray) -> None:
    """Adds to ``counts`` how many of the hashes have each bit."""
    bits = np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little")
    # rows are added in lanes of bytes, at most 255 at a time
    for k in range(0, len(h), 255 * 64):
        part = bits[k : k + 255 * 64]
        full = len(part) // 255 * 255
        if full:
            counts += part[:full].reshape(-1, 255, 8, 8).view(np.uint64).sum(axis=1).view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
        counts += part[full:].sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def bits_of(hashes: np.ndarray) -> int:
    """The fingerprint of hashes that are at hand."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), PIECE):
        add_bits(counts, np.ascontiguousarray(hashes[k : k + PIECE], "<u8"))
    return majority(counts, len(hashes))


FINGERPRINTS = "doc_id bigint, fingerprint bigint"
FINGERPRINTS_ARROW = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64())])


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint as a signed long) of every whole text, A-Z lower-cased."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((simhash(text.as_py().encode("utf-8").lower().split(), size) for text in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out.view(np.int64))], schema=FINGERPRINTS_ARROW)

    return id_and_text(docs, id_col, text_col).mapInArrow(compute, FINGERPRINTS)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The mask of each table: bits whose code is not orthogonal to the table's vector."""
    codes = (1 << (radius + 1)) - 1
    code = [bit * codes // bits + 1 for bit in range(bits)]
    return [sum(1 << bit for bit in range(bits) if (code[bit] & v).bit_count() % 2) for v in range(1, codes + 1)]


#: Members of a bucket that are compared with each other directly; larger buckets use centres.
SMALL = 16


def links(prints: DataFrame, fp: str = "fingerprint", small: int = SMALL) -> DataFrame:
    """Edges (u, v) whose components are those of "differs in two bits at most".

    ``prints`` holds each fingerprint once. Buckets of up to ``small`` members, as chance
    makes them, are compared inside; the links are the same either way.
    """
    tables = masks()
    keyed = prints.select(F.col(fp).alias("fp"), F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col(fp).bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(tables)])).alias("b")).select("fp", "b.t", "b.key")
    shared = stored(keyed.groupBy("t", "key").agg(F.count("*").alias("c")).where("c > 1"), "shared-buckets")
    members = stored(keyed.join(shared.hint("merge"), ["t", "key"]).select("t", "key", "c", "fp"), "bucket-members")
    few = members.where(F.col("c") <= small).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    pairs = f"flatten(transform(fps, a -> transform(filter(fps, b -> b > a AND bit_count(a ^ b) <= {RADIUS}), b -> struct(a AS u, b AS v))))"
    direct = few.select(F.explode(F.expr(pairs)).alias("p")).select("p.u", "p.v")
    hidden = [[1 << b for b in range(BITS) if not m >> b & 1] for m in tables]

    def near(flips: list[int]) -> Column:
        return F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(x))) for x in flips])

    centre = reduce(lambda out, k: out.when(F.col("t") == k, near(hidden[k])), range(1, len(tables)), F.when(F.col("t") == 0, near(hidden[0])))
    named = members.where(F.col("c") > small).select("t", "fp", F.explode(centre).alias("centre"))
    # at most 1 + len(hidden[t]) fingerprints name one centre in a table
    stars = named.groupBy("t", "centre").agg(F.min("fp").alias("u"), F.collect_set("fp").alias("vs")).where(F.size("vs") > 1)
    return stars.select("u", F.explode("vs").alias("v")).where("u <> v").union(direct).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of every document.

    Fingerprints link at two or fewer differing bits; a component's id is its smallest
    doc_id. A null text is empty; a text without words has fingerprint zero. A row with
    a null id gets its component, but never names one unless all ids of it are null.
    Rows of equal ids are reported each. An empty table gives no rows; other columns are not
    read. A text is held whole with its words, one at a time.
    """
    prints = stored(fingerprints(docs, size, id_col, text_col), "fingerprints")
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    found = stored(components(links(distinct)), "fingerprint-components")
    named = distinct.join(found.hint("merge"), distinct["fingerprint"] == found["node"], "left").select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("c"))
    named = stored(named, "named-fingerprints")
    least = stored(named.groupBy("c").agg(F.min("first").alias("component_id")), "component-ids")
    named = named.join(least.hint("merge"), "c").select("fingerprint", "component_id")
    out = prints.join(stored(named, "fingerprint-ids").hint("merge"), "fingerprint")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
