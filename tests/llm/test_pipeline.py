import random
import re
from collections import defaultdict

import corpus_pipeline
from quarry.llm.toxicity import toxicity
from tests.llm.test_near_copies import brute_sets, similar
from tests.llm.test_simhash import brute_components
from tests.llm.test_toxicity import corpus


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(500)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    item = prose(30)
    texts = {i: prose(rng.randrange(20, 300)) for i in range(300)}
    labels = {i: 0 for i in texts}
    for i in range(0, 300, 4):
        texts[i] += " idiot moron trash " + prose(3)
        labels[i] = 1
    for i in range(301, 321, 2):
        texts[i] = texts[i - 300].replace(" ", "  ")
    for i in range(401, 421, 2):
        texts[i] = texts[i - 300] + "\tx"
    texts |= {501: f"{prose(40)}. {item}. {prose(5)}", 502: "", 503: None, 504: prose(6000)}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    where = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    docs = spark.read.parquet(f"{where}/documents.parquet")

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "packing"]
    kept = {i: texts[i] or "" for i in texts}
    bad = {r["doc_id"] for r in toxicity(docs, spark.read.parquet(f"{where}/labels.parquet")).where("predicted = 1").collect()}
    assert len(bad & {i for i in labels if labels[i]}) >= 70 and not bad - {i for i in labels if labels[i]}
    wanted = []
    kept = {i: t for i, t in kept.items() if i not in bad}
    wanted.append(set(kept))
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i]), i)
    kept = {i: kept[i] for i in first.values()}
    wanted.append(set(kept))
    # five words and a similarity of 0.8, the general rule for near-copies
    own = {i: brute_sets(t) for i, t in kept.items()}
    group, least = brute_components(kept, lambda a, b: similar(own[a], own[b])), {}
    for i in sorted(kept):
        least.setdefault(group[i], i)
    kept = {i: kept[i] for i in least.values()}
    wanted.append(set(kept))
    kept.pop(501)
    wanted.append(set(kept))

    now = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], wanted):
        now = stage(spark, now, where)
        assert now.columns == docs.columns, name
        assert {r["doc_id"] for r in now.select("doc_id").collect()} == want, name
    packed = corpus_pipeline.run(spark, where).collect()
    assert {r["doc_id"] for r in packed} == wanted[-1]
    held = defaultdict(int)
    for r in packed:
        held[r["sequence_id"]] += r["length"]
    assert max(held.values()) <= 2048


def test_odd_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts, clashing columns and an empty table, in every stage."""
    rows, labels = corpus(120, 3)
    item = "which of these seven rivers flows from the high lakes to the northern sea"
    odd = [(None, None), (None, ""), (7001, ""), (None, "You idiot moron idiot!"), (None, f"so {item} then"), (None, "plain words of a clean row here"), (7002, "same id first text of two"), (7002, "and quite another one for the same id"), (7002, "same id first text of two")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in [*(r[:2] for r in rows), *odd]], "doc_id long, text string, __row int, score int, node int")
    where = str(tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, where)
        assert now.columns == docs.columns
        assert stage(spark, docs.limit(0), where).count() == 0
    left = [(r["doc_id"], r["text"]) for r in now.where("doc_id IS NULL OR doc_id > 7000").collect()]
    assert sorted(left, key=str) == sorted([(7001, ""), (None, "plain words of a clean row here"), (7002, "same id first text of two"), (7002, "and quite another one for the same id")], key=str)
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), where).count() == 0
