"""Source divergence audit over a transducer vocabulary (operator 13).

Terms that enough documents of a language use are kept and sorted; runs of them become
minimal acyclic transducers, whose outputs add up to a term's ordinal, its place in byte
order among the kept terms of its language. All texts are then streamed through the
transducers, many terms in lockstep, which recounts the kept terms as (language, source,
ordinal, count). Everything after that is arithmetic on ordinals in whole numbers; they
also break ties, as their order is that of the terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import stored

#: A term's bytes: ASCII letters, lower-cased, and everything beyond ASCII; others end it.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCALE, PRIOR = 1_000_000_000, 5
#: Terms and bytes of terms of one transducer, and bytes of transducers that are sent to the tasks at a time.
TERMS_EACH, BYTES_EACH, SENT = 65_536, 1 << 20, 48 << 20
#: Terms and bytes of text after which a task hands on what it has counted; bytes of text that are streamed together.
HELD, HELD_BYTES, CHUNK = 300_000, 64 << 20, 4 << 20
#: Ordinals and sources of a block in which distances between sources are summed.
ORDINALS, SOURCES = 4096, 64


class Transducer:
    """Minimal acyclic automaton of sorted distinct terms; outputs along a term's path add up to its place."""

    def __init__(self, terms: list[bytes]):
        known: dict[tuple, int] = {}
        path: list[tuple[list[bool], list[tuple[int, int]]]] = [([False], [])]

        def close(depth: int, last: bytes) -> None:
            """Folds the open states below ``depth`` into states that are known or new."""
            while len(path) > depth + 1:
                final, edges = path.pop()
                state = known.setdefault((final[0], tuple(edges)), len(known))
                path[-1][1].append((last[len(path) - 1], state))

        last = b""
        for term in terms:
            shared = 0
            for a, b in zip(last, term):
                if a != b:
                    break
                shared += 1
            close(shared, last)
            path.extend(([False], []) for _ in range(len(term) - shared))
            path[-1][0][0] = True
            last = term
        close(0, last)
        self.root = known.setdefault((path[0][0][0], tuple(path[0][1])), len(known))
        below = np.zeros(len(known), np.int64)
        keys, targets, before = [], [], []
        for state, (final, edges) in enumerate(known):  # a state is known after those it leads to
            n = int(final)
            for byte, target in edges:
                keys.append(state << 8 | byte)
                targets.append(target)
                before.append(n)
                n += int(below[target])
            below[state] = n
        self.final = np.fromiter((final for final, _ in known), bool, len(known))
        self.keys, self.targets, self.before = np.array(keys, np.int64), np.array(targets, np.int32), np.array(before, np.int32)
        self.longest = max(map(len, terms), default=0)
        self.size = len(terms)

    def to_bytes(self) -> bytes:
        head = np.array([self.root, self.longest, self.size, len(self.final), len(self.keys)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.final, self.keys, self.targets, self.before))

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        out = cls.__new__(cls)
        out.root, out.longest, out.size, states, edges = np.frombuffer(data, np.int64, 5).tolist()
        at = 40
        out.final = np.frombuffer(data, bool, states, at)
        out.keys = np.frombuffer(data, np.int64, edges, at := at + states)
        out.targets = np.frombuffer(data, np.int32, edges, at := at + 8 * edges)
        out.before = np.frombuffer(data, np.int32, edges, at + 4 * edges)
        return out

    def ordinals(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The place of each term of the text, -1 where it is not kept: all terms take a step together."""
        out = np.full(len(starts), -1, np.int64)
        live = np.nonzero((lengths > 0) & (lengths <= self.longest))[0] if len(self.keys) else np.zeros(0, np.int64)
        state, place, step = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64), 0
        while len(live):
            key = (state << 8) | text[starts[live] + step]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == key
            live, at = live[hit], at[hit]
            place = place[hit] + self.before[at]
            state = self.targets[at].astype(np.int64)
            step += 1
            ended = lengths[live] == step
            kept = ended & self.final[state]
            out[live[kept]] = place[kept]
            live, state, place = live[~ended], state[~ended], place[~ended]
        return out

    def terms(self) -> Iterator[bytes]:
        """The terms in order, their places being 0, 1, ..."""
        ends = np.searchsorted(self.keys, np.arange(len(self.final) + 1, dtype=np.int64) << 8)
        todo = [(self.root, b"")]
        while todo:
            state, term = todo.pop()
            if self.final[state]:
                yield term
            todo.extend((int(self.targets[e]), term + bytes([int(self.keys[e]) & 255])) for e in range(ends[state + 1] - 1, ends[state] - 1, -1))


def read(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Strings of labels as they are, the text, last, as bytes."""
    yield from zip(*(batch.column(n).to_pylist() for n in names), (x.as_buffer().to_pybytes() if x.as_buffer() else b"" for x in batch.column("text").cast(pa.binary())))


DF_ARROW = pa.schema([("lang", pa.string()), ("term", pa.string()), ("df", pa.int64())])


def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each language that hold a term, of a bounded stretch of the task's rows at a time."""
    found: dict[str, Counter] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, own in found.items():
            terms = list(own)
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([t.decode("utf-8") for t in some], pa.string()), pa.array([own[t] for t in some], pa.int64())], schema=DF_ARROW)
        found.clear()

    for batch in batches:
        for lang, text in rows(batch, "lang"):
            found.setdefault(lang, Counter()).update(set(text.translate(LETTERS).split()))
            size += len(text)
            if size > HELD_BYTES or sum(map(len, found.values())) > HELD:
                yield from flush()
                size = 0
    yield from flush()


SHARD_ARROW = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("place", pa.int32()), ("terms", pa.int64()), ("bytes", pa.int64()), ("transducer", pa.binary())])


def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A transducer for each run of sorted terms of one language."""
    lang, part, place, terms, size = None, 0, 0, [], 0

    def shard() -> pa.RecordBatch:
        data = Transducer(terms).to_bytes()
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([len(terms)], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], schema=SHARD_ARROW)

    for batch in batches:
        for own, number, term in zip(batch.column("lang").to_pylist(), batch.column("part").to_pylist(), batch.column("term").to_pylist()):
            term = term.encode("utf-8")
            if terms and (own != lang or len(terms) >= TERMS_EACH or size + len(term) > BYTES_EACH):
                yield shard()
                terms, size, place = [], 0, place + 1
            lang, part = own, number
            terms.append(term)
            size += len(term)
    if terms:
        yield shard()


COUNT_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("ordinal", pa.int64()), ("count", pa.int64())])


class Recount:
    """Counts of (source, ordinal) of one language's texts, merged as they grow."""

    def __init__(self, shards: list[tuple[int, Transducer]]):
        self.shards, self.sources = shards, {}
        self.codes, self.counts, self.loose = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        self.loose_size = 0

    def stream(self, texts: list[tuple[str, bytes]]) -> None:
        joined = b" ".join(text for _, text in texts).translate(LETTERS)
        data = np.frombuffer(joined, np.uint8)
        edges = np.nonzero(np.diff(np.r_[False, data != 32, False].view(np.int8)))[0]
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        offsets = np.cumsum([0, *(len(text) + 1 for _, text in texts)])
        source = np.array([self.sources.setdefault(s, len(self.sources)) for s, _ in texts], np.int64)
        owner = source[np.searchsorted(offsets, starts, "right") - 1]
        for base, transducer in self.shards:
            place = transducer.ordinals(data, starts, lengths)
            kept = place >= 0
            codes, counts = np.unique(owner[kept] << 40 | place[kept] + base, return_counts=True)
            self.loose.append((codes, counts))
            self.loose_size += len(codes)
        if self.loose_size > HELD:
            self.merge()

    def merge(self) -> None:
        codes = np.concatenate([self.codes, *(c for c, _ in self.loose)])
        counts = np.concatenate([self.counts, *(n for _, n in self.loose)])
        self.codes, at = np.unique(codes, return_inverse=True)
        self.counts = np.zeros(len(self.codes), np.int64)
        np.add.at(self.counts, at, counts)
        self.loose, self.loose_size = [], 0

    def flush(self, lang: str) -> Iterator[pa.RecordBatch]:
        self.merge()
        names = np.array(list(self.sources), object)
        for at in range(0, len(self.codes), 50_000):
            codes = self.codes[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(names[codes >> 40].tolist(), pa.string()), pa.array(codes & (1 << 40) - 1), pa.array(self.counts[at : at + 50_000])], schema=COUNT_ARROW)
        self.__init__(self.shards)


def recounted(docs: DataFrame, shards: list[tuple[str, int, bytes]]) -> DataFrame:
    """(lang, source, ordinal, count) of the terms of these transducers, partial sums of tasks."""
    sent = docs.sparkSession.sparkContext.broadcast(shards)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list] = {}
        for lang, base, data in sent.value:
            own.setdefault(lang, []).append((base, Transducer.from_bytes(data)))
        state = {lang: Recount(found) for lang, found in own.items()}
        waiting: dict[str, list] = {}
        size = 0

        def drain() -> Iterator[pa.RecordBatch]:
            for lang, texts in waiting.items():
                state[lang].stream(texts)
                if len(state[lang].codes) > HELD or len(state[lang].sources) > HELD:
                    yield from state[lang].flush(lang)
            waiting.clear()

        for batch in batches:
            for lang, source, text in rows(batch, "lang", "source"):
                if lang in state:
                    waiting.setdefault(lang, []).append((source, text))
                    size += len(text)
                    if size > CHUNK:
                        yield from drain()
                        size = 0
        yield from drain()
        for lang, counts in state.items():
            yield from counts.flush(lang)

    return docs.mapInArrow(count, "lang string, source string, ordinal bigint, count bigint")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), in decimals, as counts may be large."""
    wide = lambda c: c.cast("decimal(19,0)")
    above, under = wide(count + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + PRIOR * terms)
    return F.when(terms > 0, 1 + F.call_function("div", above, under)).cast("long")


PAIR_DDL = "lang string, a string, b string, part bigint"


def block_distances(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
    """Sums of differences over one stretch of ordinals, between the sources of two buckets."""
    width = int(block["width"].iloc[0])
    values = np.repeat(block["p0"].to_numpy(np.int64)[:, None], width, axis=1)
    for k, (at, p) in enumerate(zip(block["ats"], block["ps"])):
        if at is not None and len(at):
            values[k, np.asarray(at, np.int64)] = np.asarray(p, np.int64)
    names, bucket = block["source"].to_numpy(), block["bucket"].to_numpy()
    order = np.argsort(names, kind="stable")
    a, b, part = [], [], []
    lang, _, i, j = key
    for x, k in enumerate(order):
        later = order[x + 1 :]
        later = later if i == j else later[bucket[later] != bucket[k]]  # each pair in the block of its two buckets
        a += [names[k]] * len(later)
        b += names[later].tolist()
        part += np.abs(values[later] - values[k]).sum(axis=1).tolist()
    return pd.DataFrame({"lang": pd.Series([lang] * len(a), dtype=object), "a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object), "part": np.array(part, np.int64)})


def vocabulary(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, term) used by ``least`` documents of the language or more, and their transducers in order."""
    df = docs.mapInArrow(document_counts, "lang string, term string, df bigint")
    kept = stored(df.groupBy("lang", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= least).select("lang", "term"), "kept-terms")
    parts = max(1, -(-kept.count() // TERMS_EACH))
    in_order = kept.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term").select("lang", "term", F.spark_partition_id().alias("part"))
    return kept, stored(in_order.mapInArrow(built, "lang string, part int, place int, terms bigint, bytes bigint, transducer binary"), "transducers")


def source_divergence(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from others and from its language.

    Part ``pair``: the other sources of the language by summed differences over all kept terms.
    Part ``term``: the ``top`` terms that the source uses more than its language does. Nulls of
    text, lang and source are ''. Every row counts as a document, repeated ones too. A group
    without terms has no ``term`` rows; a language without kept terms has pairs of value 0; a
    language of one source has no pairs; an empty table gives no rows. Ties go by byte order of
    the item. Other columns of ``docs`` are not read. A text is held whole with its distinct
    terms, one at a time; texts are read three times and never shuffled. The vocabulary is kept
    in transducers of at most 65,536 terms, and sent to the tasks in rounds of at most 48 MB
    (a term over a megabyte long has one of its own): a larger vocabulary takes more rounds.
    """
    spark, base = docs.sparkSession, read(docs)
    kept, shards = vocabulary(base, least)
    numbered, start, rounds, size = [], Counter(), [], SENT
    for r in sorted(shards.drop("transducer").collect(), key=lambda r: (r["lang"].encode("utf-8"), r["part"], r["place"])):  # one row for 65,536 terms
        numbered.append((r["lang"], r["part"], r["place"], start[r["lang"]]))
        start[r["lang"]] += r["terms"]
        if size + r["bytes"] > SENT:
            rounds.append([])
            size = 0
        rounds[-1].append(numbered[-1])
        size += r["bytes"]
    bases = spark.createDataFrame(numbered, "lang string, part int, place int, base bigint")
    placed = shards.join(bases.hint("shuffle_hash"), ["lang", "part", "place"])
    partial = spark.createDataFrame([], "lang string, source string, ordinal bigint, count bigint")
    for own in rounds:
        chosen = spark.createDataFrame([x[:3] for x in own], "lang string, part int, place int")
        sent = [(r["lang"], r["base"], bytes(r["transducer"])) for r in placed.join(chosen.hint("shuffle_hash"), ["lang", "part", "place"]).select("lang", "base", "transducer").collect()]  # SENT bytes at most
        partial = partial.union(stored(recounted(base, sent).groupBy("lang", "source", "ordinal").agg(F.sum("count").alias("count")), "recounted"))
    return divergences(base.select("lang", "source").distinct(), kept, partial, placed, top)


def spelled(placed: DataFrame) -> DataFrame:
    """(lang, ordinal, term), read from the transducers."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, base, data in zip(*(batch.column(n).to_pylist() for n in ("lang", "base", "transducer"))):
                terms = [t.decode("utf-8") for t in Transducer.from_bytes(data).terms()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array(range(base, base + len(terms)), pa.int64()), pa.array(terms, pa.string())], names=["lang", "ordinal", "term"])

    return placed.select("lang", "base", "transducer").mapInArrow(spell, "lang string, ordinal bigint, term string")


def divergences(groups: DataFrame, kept: DataFrame, counts: DataFrame, placed: DataFrame, top: int) -> DataFrame:
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    sums = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    sized = groups.join(terms.hint("shuffle_hash"), "lang", "left").join(sums.hint("shuffle_hash"), ["lang", "source"], "left")
    sized = stored(sized.select("lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("total", F.lit(0)).alias("total")), "groups")
    total = sized.join(sized.groupBy("lang").agg(F.sum("total").alias("whole")).hint("shuffle_hash"), "lang")
    cells = counts.join(total.hint("shuffle_hash"), ["lang", "source"])
    cells = stored(cells.select("lang", "source", "ordinal", "count", "whole", "terms", share(F.col("count"), F.col("total"), F.col("terms")).alias("p")), "shares")

    overall = cells.groupBy("lang", "ordinal").agg(F.sum("count").alias("count"), F.max("whole").alias("whole"), F.max("terms").alias("terms"))
    overall = overall.select("lang", "ordinal", share(F.col("count"), F.col("whole"), F.col("terms")).alias("q"))
    above = cells.join(overall.hint("shuffle_hash"), ["lang", "ordinal"]).where("p > q").select("lang", "source", "ordinal", (F.col("p") - F.col("q")).alias("value"))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    best = stored(above.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top), "terms-above")
    wanted = best.select("lang", "ordinal").distinct()
    names = spelled(placed).join(wanted.hint("shuffle_hash"), ["lang", "ordinal"], "left_semi")
    by_term = best.join(names.hint("merge"), ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_pair = source_distances(total, cells).withColumn("rank", F.row_number().over(ranked))
    return by_pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").union(by_term)


def source_distances(total: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language: matrices of at most 2 x 64 sources
    (as the hash deals them out) and 4,096 ordinals, whose partial sums are added up."""
    most = total.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-most // SOURCES))
    packed = cells.groupBy("lang", "source", F.floor(F.col("ordinal") / ORDINALS).alias("stretch")).agg(F.collect_list(F.struct((F.col("ordinal") % ORDINALS).cast("int").alias("at"), "p")).alias("cells"))
    stretches = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("terms") - 1) / ORDINALS), F.lit(0))))
    grid = total.select("lang", "source", "terms", F.coalesce(share(F.lit(0), F.col("total"), F.col("terms")), F.lit(0)).alias("p0"), stretches.alias("stretch"))
    width = F.least(F.lit(ORDINALS).cast("long"), F.col("terms") - F.col("stretch") * ORDINALS)
    both = grid.join(packed.hint("merge"), ["lang", "source", "stretch"], "left").select(
        "lang", "source", "stretch", "p0", width.alias("width"), F.col("cells.at").alias("ats"), F.col("cells.p").alias("ps"), F.pmod(F.xxhash64("source"), F.lit(buckets)).alias("bucket"),
    )
    other = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    dealt = both.withColumn("other", other).withColumn("i", F.least("bucket", "other")).withColumn("j", F.greatest("bucket", "other"))
    partial = dealt.groupBy("lang", "stretch", "i", "j").applyInPandas(block_distances, PAIR_DDL)
    summed = partial.groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return summed.select("lang", "value", sides.alias("side")).select("lang", "side.source", "side.item", "value")


ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{ASCII}', '{ASCII.lower()}') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY ALL),
f AS (SELECT g.lang, g.source, kept.term, coalesce(c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c, 0) + 5) // (coalesce(n, 0) + 5 * v) AS p
FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
l AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(c) + 5)::HUGEINT // ((sum(sum(c)) OVER (PARTITION BY lang))::HUGEINT + 5 * any_value(v)) AS q FROM f JOIN v USING (lang) GROUP BY lang, term),
pairs AS (SELECT g.lang, g.source, o.source AS item FROM g JOIN g o ON o.lang = g.lang AND o.source <> g.source),
d2 AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN d2 USING (lang, source, item)),
tm AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM f JOIN l USING (lang, term) WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tm))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
