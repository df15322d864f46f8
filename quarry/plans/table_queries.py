"""Queries of table maintenance, lookups and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import tables
from quarry.operators.bots import created_bots
from quarry.operators.pages import PageIndex
from quarry.plans.registry import query
from quarry.plans.scenario import CUSTOMERS, FILES, customers, files, questions, table
from quarry.sources.scratch import scratch_path


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def lookup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.first_match(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("WITH bots AS (SELECT source AS bot_id, count(*) AS files FROM documents GROUP BY 1) SELECT item_id AS query_id, 'src' || (item_id % 25) AS bot_id, files, files IS NOT NULL AS found FROM benchmark LEFT JOIN bots ON bots.bot_id = 'src' || (item_id % 25)")
def lookup_bot_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bots = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("bot_id")).agg(F.count("*").alias("files"))
    asked = questions(spark, sf_dir).select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 25).cast("string")).alias("bot_id"))
    return asked.join(bots, "bot_id", "left").select("query_id", "bot_id", "files", F.col("files").isNotNull().alias("found"))


@query(f"WITH {CUSTOMERS} SELECT c_custkey, nation, region FROM customers WHERE region = 'EUROPE'")
def nested_field_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).where("owner.region = 'EUROPE'").select("c_custkey", "owner.nation", "owner.region")


@query(f"WITH {CUSTOMERS} SELECT c_custkey, array_to_string(users, ',') AS users FROM customers WHERE list_contains(users, '1-URGENT')")
def array_contains_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).where(F.array_contains("users", "1-URGENT")).select("c_custkey", F.array_join("users", ",").alias("users"))


@query(f"WITH {CUSTOMERS} SELECT c_custkey, c_mktsegment = 'BUILDING' OR list_contains(users, '2-HIGH') AS readable FROM customers")
def access_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    readable = tables.may_read(F.col("c_mktsegment") == "BUILDING", F.col("users"), F.lit("2-HIGH"))
    return customers(spark, sf_dir).select("c_custkey", readable.alias("readable"))


@query(f"WITH {CUSTOMERS} SELECT c_custkey, len(users) AS members, orders, len(users) <> orders AS mismatch FROM customers")
def member_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).select("c_custkey", F.size("users").cast("long").alias("members"), "orders", (F.size("users") != F.col("orders")).alias("mismatch"))


@query("SELECT event_id, user_id, c_name AS owner_name, c_custkey IS NOT NULL AS valid FROM events LEFT JOIN customer ON c_custkey = user_id * 11")
def referential_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the customer that owns them embedded, and those without one."""
    events = table(spark, sf_dir, "events").withColumn("owner_key", F.col("user_id") * 11)
    good, bad = tables.with_owner(events, table(spark, sf_dir, "customer"), "owner_key", "c_custkey", ["c_custkey", "c_name"])
    return good.select("event_id", "user_id", F.col("owner.c_name").alias("owner_name"), F.lit(True).alias("valid")).union(bad.select("event_id", "user_id", F.lit(None), F.lit(False)))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 693")
def paginate_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundredth page of seven orders, from the part of the index that it lies in."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return PageIndex.build(rows, scratch_path(spark, "page-index"), ["o_orderkey"], part=200).page(100, 7)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 50 orders."""
    return tables.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", 3, 50)


@query(
    """WITH l AS (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k, max(event_id) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS gone FROM events)
SELECT user_id, arg_max(value, event_id) FILTER (event_type IN ('click', 'purchase')) AS value, arg_max(k, event_id) FILTER (event_type = 'view') AS k, arg_max(event_type, event_id) AS kind,
min(ts) AS created_at, max(ts) AS updated_at, count(*) AS versions FROM l WHERE event_type <> 'error' AND (gone IS NULL OR event_id > gone) GROUP BY user_id"""
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log of users: an error deletes, clicks and purchases set the value, views set k."""
    log = table(spark, sf_dir, "events").select(
        "user_id", F.col("event_id").alias("seq"), F.col("ts").alias("at"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_type").alias("kind"),
        F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"),
        F.when(F.col("event_type").isin("click", "purchase"), F.array(F.lit("value"), F.lit("kind"))).when(F.col("event_type") == "view", F.array(F.lit("k"), F.lit("kind"))).otherwise(F.array(F.lit("kind"))).alias("changed"),
    )
    return tables.latest_state(log, "user_id", ["value", "k", "kind"])


@query(f"WITH {FILES}, dead AS (SELECT bot_id, file_hash, max(doc_id) AS gone FROM files WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY ALL) SELECT doc_id, files.bot_id, file_name FROM files LEFT JOIN dead USING (bot_id, file_hash) WHERE gone IS NULL OR doc_id > gone")
def delete_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of low quality are tombstones for what their bot stored of that content up to then."""
    own = files(spark, sf_dir)
    dead = own.join(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi")
    return tables.without_deleted(own, dead, ["bot_id", "file_hash"], "doc_id").select("doc_id", "bot_id", "file_name")


@query("SELECT l.doc_id, quality, toxic FROM labels l JOIN documents d USING (doc_id) WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING avg(quality) < 0.85)")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bots of low mean quality are torn down; the labels of their files go with them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    dead = rows.groupBy("source").agg(F.avg("quality").alias("mean")).where("mean < 0.85").select("source")
    return rows.join(dead, "source", "left_anti").select("doc_id", "quality", "toxic")


@query("SELECT 'document' AS kind, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.orphans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    buyers = tables.orphans(table(spark, sf_dir, "customer"), orders, "c_custkey")
    return docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id")).union(buyers.select(F.lit("customer"), "c_custkey"))


@query(
    f"WITH {FILES}, o AS (SELECT f.doc_id, CASE WHEN quality = 0 THEN 'old' ELSE file_hash END AS h FROM files f JOIN labels USING (doc_id)), n AS (SELECT doc_id, file_hash AS h FROM files WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) "
    "SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'gone' WHEN o.h = n.h THEN 'same' ELSE 'changed' END AS status FROM o FULL JOIN n ON o.doc_id = n.doc_id"
)
def file_change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled files are the old state, those of low quality with other content; the new state has no toxic files."""
    own, labels = files(spark, sf_dir).select("doc_id", "file_hash"), table(spark, sf_dir, "labels")
    old = own.join(labels, "doc_id").select("doc_id", F.when(F.col("quality") == 0, "old").otherwise(F.col("file_hash")).alias("file_hash"))
    new = own.join(labels.where("toxic = 1"), "doc_id", "left_anti")
    return tables.changes(old, new, ["doc_id"])


@query("SELECT doc_id, unnest(list_filter([CASE WHEN quality IS NULL THEN 'quality is required' END, CASE WHEN toxic IS NULL THEN 'toxic is required' END, CASE WHEN coalesce(trim(text), '') = '' THEN 'text is required' END], lambda x: x IS NOT NULL)) AS violation FROM documents LEFT JOIN labels USING (doc_id)")
def validate_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return tables.violations(rows, ["doc_id"], [tables.required(f) for f in ("quality", "toxic", "text")])


@query("SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'o_orderstatus is not allowed' END, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') THEN 'o_orderpriority is not allowed' END], lambda x: x IS NOT NULL)) AS violation FROM orders")
def validate_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [tables.one_of("o_orderstatus", "O", "F"), tables.one_of("o_orderpriority", "1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")]
    return tables.violations(table(spark, sf_dir, "orders"), ["o_orderkey"], rules)


@query("SELECT sha256(text) AS file_hash, count(*) AS rows FROM documents GROUP BY text HAVING count(*) > 1")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.repeated(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("file_hash")), ["file_hash"])


@query(
    "WITH RECURSIVE e AS (SELECT event_id, epoch_us(ts) // 1000 AS n, '' AS s FROM events UNION ALL SELECT event_id, n // 36, substr('0123456789abcdefghijklmnopqrstuvwxyz', (n % 36)::INT + 1, 1) || s FROM e WHERE n > 0) "
    "SELECT event_id, 'bot_' || s || '_' || upper(substr(sha256(event_id::VARCHAR), 1, 6)) AS bot_key, trim(event_type) AS kind, coalesce(CASE WHEN event_type <> 'view' THEN value END, 0) AS value FROM e JOIN events USING (event_id) WHERE n = 0"
)
def normalize_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("kind"), F.when(F.col("event_type") != "view", F.col("value")).alias("value"))
    key = tables.entity_key("bot", F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id").cast("string"))
    return tables.normalised(events, ["kind"], {"value": 0.0}).select("event_id", key.alias("bot_key"), "kind", "value")


@query(
    """WITH RECURSIVE u AS (SELECT 'user' || c_custkey || '@example.com' AS email, c_name FROM customer), r AS (SELECT event_id, epoch_us(ts) // 1000 AS n, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE event_type || ' ' || event_id END AS name, 'user' || user_id || '@example.com' AS owner FROM events),
e AS (SELECT event_id, n, '' AS s FROM r UNION ALL SELECT event_id, n // 36, substr('0123456789abcdefghijklmnopqrstuvwxyz', (n % 36)::INT + 1, 1) || s FROM e WHERE n > 0),
m AS (SELECT r.event_id, name, owner, c_name, 'bot_' || s || '_' || upper(substr(sha256(r.event_id::VARCHAR), 1, 6)) AS key FROM r JOIN e ON e.event_id = r.event_id AND e.n = 0 LEFT JOIN u ON u.email = r.owner),
f AS (SELECT *, CASE WHEN c_name IS NULL THEN 'Owner not found' WHEN trim(name) = '' THEN 'bot_name is required' WHEN right(key, 1) = '7' THEN 'Failed to create bot: full' END AS error FROM m)
SELECT event_id AS request_id, error, c_name AS owner_name, CASE WHEN error IS NULL THEN key END AS bot_id, CASE WHEN error IS NULL THEN name END AS bot_name, CASE WHEN error IS NULL THEN 'vector_table_' || key END AS vector_table, CASE WHEN error IS NULL THEN owner END AS member, CASE WHEN error IS NULL THEN 'semantic' END AS kb_search_method FROM f"""
)
def create_bots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events ask for bots of customers; tables whose names end in 7 cannot be opened."""
    events, customer = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer")
    mail = lambda c: F.concat(F.lit("user"), F.col(c).cast("string"), F.lit("@example.com"))
    users = customer.select(mail("c_custkey").alias("email"), "c_name")
    name = F.when(F.col("event_id") % 11 == 0, " ").otherwise(F.concat_ws(" ", "event_type", F.col("event_id").cast("string")))
    asked = events.select(F.col("event_id").alias("request_id"), name.alias("bot_name"), F.lit(None).cast("string").alias("bot_desc"), mail("user_id").alias("owner"), "ts")
    made = created_bots(asked, users, F.unix_millis(F.col("ts").cast("timestamp")), lambda names: ["full" if n.endswith("7") else None for n in names])
    return made.select("request_id", "error", F.col("owner.c_name").alias("owner_name"), "bot_id", "bot_name", "vector_table", F.col("bot_users.users")[0].alias("member"), "kb_search_method")


@query(f"WITH {CUSTOMERS} SELECT 'all' AS kind, count(*) AS customers FROM customers UNION ALL SELECT 'one', count(*) FROM customers WHERE list_contains(users, '3-MEDIUM')")
def optional_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a value the filter leaves all rows, with one those that hold it."""
    rows = customers(spark, sf_dir)
    counts = [tables.where_given(rows, "users", v).agg(F.count("*").alias("customers")).select(F.lit(kind).alias("kind"), "customers") for kind, v in (("all", None), ("one", "3-MEDIUM"))]
    return counts[0].union(counts[1])


@query("SELECT event_id, CASE WHEN floor(value)::INT % 3 = 0 THEN 10 ELSE floor(value)::INT % 3 END AS top FROM events")
def falsy_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number of hits that is missing or zero is ten."""
    asked = F.floor("value").cast("int") % 3
    return table(spark, sf_dir, "events").select("event_id", tables.or_default(asked, 10).alias("top"))
