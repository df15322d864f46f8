"""Benchmark decontamination through template canonicalisation (operator 5).

Words become template tokens: numbers, units after a number, and names (capitalised words
inside a sentence) become typed placeholders, anything else its bare lower-case form.
Windows of template tokens of documents and benchmark items are joined by hash. An item's
window of mostly placeholders says too little as a template; it is joined by its values
instead, so that such items are found verbatim only. A document leaks an item if found
windows hold COVERAGE or more of the item's tokens, WINDOW of them at least, or RUN tokens
in a row, and if its slots are consistent: wherever the item repeats a value, the document
has one value for it. Slots that are all equal make a verbatim leak, others a
re-parameterised question.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_and_text, rows_of, stored, text_hash
from quarry.llm.rolling import Rolling

WINDOW, COVERAGE, CONSISTENT = 8, 0.5, 0.8
#: Least share of a window's tokens that are no placeholders.
LITERAL = 0.5
#: Tokens in a row that are a leak by themselves, and the shortest windows of short items.
RUN, SHORTEST = 13, 3
#: Item windows that may be sent to every task to sift documents' windows before the join.
#: With more, nothing is sifted and every window of the documents is joined.
SIFTED = 1_000_000
#: Fixed values.
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset("mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons tonne tonnes oz lb lbs pound pounds ml l litre litres liter liters ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw kwh v a j kj n pa k c f % percent $ € £ usd eur gbp dollar dollars cent cents euro euros kmh mph kbps mbps gb mb kb tb".split())
NUMBER = re.compile(r"[-+]?[$€£]?\d+(?:[.,:/]\d+)*%?")
EDGE = re.compile(r"^[^\w$€£%+-]+|[^\w$€£%]+$")
ENDS = re.compile(r"[.!?:][\"'”’)\]]*$")
LITERAL_TOKEN, NUMBER_TOKEN, UNIT_WORD, NAME_WORD, END, EMPTY = 0, 1, 2, 4, 8, 16
WORDS_KEPT = 500_000
#: Tells hashes of values from hashes of templates.
VALUES = np.uint64(xxhash.xxh64_intdigest("<values>"))
PLACEHOLDERS = {kind: np.uint64(xxhash.xxh64_intdigest(f"<{kind}>")) for kind in ("number", "unit", "name")}


def bare(word: str) -> str:
    return EDGE.sub("", word)


class Tokens(dict):
    """word -> 59 bits of its bare form's hash, and its flags."""

    def __missing__(self, word: str) -> int:
        own = bare(word)
        low = own.lower()
        flags = LITERAL_TOKEN if own else EMPTY
        if NUMBER.fullmatch(own) or low in NUMBERS:
            flags |= NUMBER_TOKEN
        if low in UNITS:
            flags |= UNIT_WORD
        if own[:1].isupper() and own[1:] == own[1:].lower():
            flags |= NAME_WORD
        if ENDS.search(word):
            flags |= END
        code = (xxhash.xxh64_intdigest(low) >> 5 << 5) | flags
        if len(self) < WORDS_KEPT:
            self[word] = code
        return code


def template(words: list[str], tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, hash of the value, is a slot, place in ``words``) of the template tokens."""
    code = np.fromiter(map(tokens.__getitem__, words), np.uint64, len(words))
    place = np.nonzero((code & np.uint64(EMPTY)) == 0)[0]
    code = code[place]
    flag = (code & np.uint64(31)).astype(np.int64)
    number = (flag & NUMBER_TOKEN) > 0
    unit = (flag & UNIT_WORD > 0) & np.r_[False, number[:-1]][: len(flag)] & ~number
    inside = ~np.r_[True, (flag[:-1] & END) > 0][: len(flag)]
    name = (flag & NAME_WORD > 0) & inside & ~number & ~unit
    plain = code >> np.uint64(5)
    out = plain.copy()
    for kind, mask in (("number", number), ("unit", unit), ("name", name)):
        out[mask] = PLACEHOLDERS[kind]
    return out, plain, number | unit | name, place


def literal(slots: np.ndarray, size: int) -> np.ndarray:
    """Whether each window of ``size`` tokens has enough literal tokens."""
    taken = np.r_[0, np.cumsum(slots)]
    return (taken[size:] - taken[:-size]) <= (1 - LITERAL) * size


def sizes_of(n: int) -> list[int]:
    """Of the windows of an item of ``n`` tokens: a replaced word leaves WINDOW tokens in them.

    Up to WINDOW tokens are one window. Up to twice as many have shorter ones besides.
    """
    return [n] if n <= WINDOW else sorted({max(SHORTEST, min(WINDOW, n - WINDOW)), WINDOW})


class Sift:
    """Which of many hashes are among the known; a table of their lowest bits turns most away."""

    def __init__(self, known: np.ndarray):
        self.known = known
        size = 1 << min(24, max(10, (16 * len(known)).bit_length()))
        self.low = np.uint64(size - 1)
        self.table = np.zeros(size, bool)
        self.table[known & self.low] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = np.nonzero(self.table[h & self.low])[0]
        if not len(at):
            return at
        own = h[at]
        return at[self.known[np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)] == own]


FOUND = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("size", pa.int32()), ("n", pa.int64()), ("places", pa.int64()), ("at", pa.int64()), ("hash", pa.int64()), ("exact", pa.bool_()), ("slots", pa.list_(pa.string()))])
FOUND_DDL = "id bigint, row bigint, size int, n bigint, places bigint, at bigint, hash bigint, exact boolean, slots array<string>"


def found_windows(rows: DataFrame, sizes: dict[int, set[bool]] | None, known: dict[int, np.ndarray] | None) -> DataFrame:
    """Windows of (doc_id, text) with the values of their slots, in order.

    ``sizes``: of the windows, and whether they are joined by template, by values
    (``exact``) or both; None gives each text those of an item, joined by values where
    literal tokens are too few.
    ``known``: hashes by size; other windows are left out. ``n``: tokens of the text;
    ``places``: its windows of the size that are joined by template.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        sift = {size: Sift(own) for size, own in (known or {}).items()}
        for batch in batches:
            out: list[tuple] = []

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), FOUND)], schema=FOUND)

            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                words = text.split()
                value, plain, slot, place = template(words, tokens)
                rolling, exactly, row = Rolling(value), None, None
                for size in sizes or sizes_of(len(value)):
                    if not 0 < size <= len(value):
                        continue
                    full = literal(slot, size)
                    for exact in sorted(sizes[size]) if sizes else (False, True):
                        if exact:
                            if not sizes and full.all():
                                continue
                            exactly = exactly or Rolling(plain)
                            h, take = exactly.windows(size) ^ VALUES, np.ones(len(full), bool) if sizes else ~full
                        else:
                            h, take = rolling.windows(size), full
                        if known is None:
                            hits = np.nonzero(take)[0]
                        else:
                            hits = sift[size](h)
                            hits = hits[take[hits]]
                        if not len(hits):
                            continue
                        row = text_hash(text) if row is None else row
                        places = int(full.sum())
                        for k, x in zip(hits.tolist(), h[hits].view(np.int64).tolist()):
                            values = [bare(words[place[j]]).lower() for j in range(k, k + size) if slot[j]]
                            out.append((doc_id, row, size, len(value), places, k, x, exact, values))
                if len(out) >= 20_000:
                    yield made()
                    out = []
            if out:
                yield made()

    return rows.mapInArrow(compute, FOUND_DDL)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, coverage, verbatim, short) of every document that holds a benchmark item.

    Null and empty texts and items hold no windows and never match. A row with a null id
    is reported with it. Rows or items that repeat an id are judged one by one and
    reported once. An item shorter than a window is a window of its own length. Every
    item with a token has a window: where all are mostly slots, verbatim ones are found.
    Items of fewer than SHORTEST tokens are found wherever their words stand, so they are
    marked ``short`` and nothing is removed for them. Windows shorter than WINDOW count
    together only if they lie near each other. ``coverage`` is the share of the item's
    tokens, or of its template windows if larger. An empty table gives an empty result.
    """
    judged = judged_rows(docs, benchmark, id_col, text_col, item_col)
    return judged.groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.max("coverage").alias("coverage"), F.max("same").alias("verbatim"), (F.max("n") < SHORTEST).alias("short"))


def judged_rows(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str) -> DataFrame:
    """(id, row, item_id, n, coverage, same) of each text that leaks an item of ``n`` tokens; ``row`` is the text's hash."""
    rows, items = id_and_text(docs, id_col, text_col), id_and_text(benchmark, item_col, text_col)
    asked = stored(found_windows(items, None, None), "item-windows")
    sizes: dict[int, set[bool]] = {}  # of at most WINDOW
    for r in asked.select("size", "exact").distinct().collect():
        sizes.setdefault(r["size"], set()).add(r["exact"])
    known = None
    if asked.count() <= SIFTED:
        each = asked.select("size", "hash").distinct().toPandas()
        known = {s: np.sort(each["hash"].to_numpy(np.int64)[each["size"].to_numpy() == s].view(np.uint64)) for s in sizes}
    asked = asked.select(F.col("id").alias("item_id"), F.col("row").alias("item_row"), "size", "n", F.when(F.col("size") == F.least("n", F.lit(WINDOW)), F.col("places")).alias("places"), F.col("at").alias("place"), "hash", "exact", F.col("slots").alias("asked"))
    if not sizes:
        return rows.limit(0).select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("coverage"), F.lit(True).alias("same"))
    hits = found_windows(rows, sizes, known).select("id", "row", "size", "at", "hash", "exact", "slots")
    joined = hits.join(F.broadcast(asked) if known is not None else asked.hint("merge"), ["size", "hash", "exact"])
    # an occurrence lies on one diagonal, or on some if words were put in or taken out
    # windows of equal values have the item's slots; a text's first word is a name in others
    joined = joined.withColumn("slots", F.expr("IF(exact, asked, slots)"))
    pairs = F.expr("transform(arrays_zip(asked, slots), x -> struct(x.asked AS a, x.slots AS b))")
    key = ["id", "row", "item_id", "item_row", "n"]
    window = F.struct("place", "size", (~F.col("exact") & F.col("places").isNotNull()).alias("counts"))
    runs = joined.groupBy(*key, (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set(window).alias("found"), F.max("places").alias("places"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    # values less those with a second partner: how many have one value of the document
    runs = runs.withColumn("values", F.expr("size(array_distinct(pairs.a))")).where(2 * F.col("values") - F.size("pairs") >= CONSISTENT * F.col("values"))
    step = "IF(x.place <= a.end, a.start, x.place)"
    runs = runs.withColumn("longest", F.expr(f"aggregate(array_sort(found), struct(-1L AS start, -1L AS end, 0L AS best), (a, x) -> struct({step} AS start, greatest(a.end, x.place + x.size) AS end, greatest(a.best, x.place + x.size - {step}) AS best), a -> a.best)"))
    # of two regions that overlap by half, one holds all diagonals of an occurrence
    near = F.expr(f"IF(n >= {2 * WINDOW}, array(0L), array(2 * floor(diagonal / (2 * n)), 2 * floor((diagonal + n) / (2 * n)) + 1))")
    whole = runs.withColumn("region", F.explode(near)).groupBy(*key, "region").agg(F.array_distinct(F.flatten(F.collect_set("found"))).alias("found"), F.max("places").alias("places"), F.max("longest").alias("longest"), F.min(F.expr("forall(pairs, x -> x.a = x.b)")).alias("same"))
    whole = whole.withColumn("covered", F.expr("size(array_distinct(flatten(transform(found, x -> sequence(x.place, x.place + x.size - 1)))))"))
    of_windows = F.expr("coalesce(size(array_distinct(transform(filter(found, x -> x.counts), x -> x.place))) / nullif(places, 0), 0)")
    whole = whole.withColumn("coverage", F.greatest(F.col("covered") / F.col("n"), of_windows))
    enough = (F.col("coverage") >= COVERAGE) & (F.col("covered") >= F.least("n", F.lit(WINDOW)))
    return whole.where(enough | (F.col("longest") >= RUN)).select("id", "row", "item_id", "n", "coverage", "same")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` whose own text holds no benchmark item of SHORTEST tokens or more."""
    found = stored(judged_rows(docs, benchmark, id_col, text_col, item_col).where(F.col("n") >= SHORTEST).select(F.col("id").alias("doc_id"), "row").distinct(), "leaking-rows")
    return rows_of(docs, found, "left_anti", id_col, text_col)
