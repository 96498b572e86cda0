"""The operators of this library on the driver's tables, each with the SQL of the same result.

Every query reads whole tables, prunes columns at the scan and keeps sums of doubles out of its result or
rounds them, so that values can be compared.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradelake.functions import scalars as S
from gradelake.operators import fanin, ops, oracle, scans
from gradelake.operators.gradetree import first_criteria, nodes, run_commands
from gradelake.operators.selection import Selection, TagFilter, Variants, any_set_matches, expected_matrix, group_by_language, matches_columns, matrix_json, select_entries, shard_matrix, total_evaluations
from gradelake.plans import report
from gradelake.sources import files, specs
from gradelake.sources.staging import shared_dir, written
from gradelake.streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- pass rates (A1-A4, F7, F8, J4) -----------------------------------------------------------------


def labelled(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return docs.join(table(spark, d, "labels"), "doc_id", "left")


@query(
    """SELECT lang, source, count(*) AS trials, count(*) FILTER (quality = 1) AS passed, count(quality) AS total,
        CAST(round(1000.0 * count(*) FILTER (quality = 1) / nullif(count(quality), 0)) AS BIGINT) AS permille
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang, source"""
)
def pass_rate_by_group(spark, d):
    passed = F.count_if(F.col("quality") == 1)
    out = labelled(spark, d).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("trials"), passed.alias("passed"), F.count("quality").alias("total"))
    return out.withColumn("permille", F.when(F.col("total") > 0, F.round(1000.0 * F.col("passed") / F.col("total")).cast("long")))


@query(
    """SELECT CASE WHEN grouping(lang) = 0 THEN 'shard' WHEN grouping(toxic) = 0 THEN 'service' ELSE 'variant' END AS level,
        lang AS language, toxic AS service, source AS variant, count(*) AS trials, count(*) FILTER (quality = 1) AS passed
    FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang, source), (source), (toxic, source))"""
)
def pass_rate_three_levels(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id")
    return spark.sql(
        """SELECT CASE WHEN grouping(lang) = 0 THEN 'shard' WHEN grouping(toxic) = 0 THEN 'service' ELSE 'variant' END AS level,
            lang AS language, toxic AS service, source AS variant, count(*) AS trials, count_if(quality = 1) AS passed
        FROM {t} GROUP BY GROUPING SETS ((lang, source), (source), (toxic, source))""",
        t=rows,
    )


@query(
    """SELECT l_returnflag AS variant, count(*) FILTER (k = 'prompt') AS prompt_total, count(*) FILTER (k = 'prompt' AND ok) AS prompt_passed,
        count(*) FILTER (k = 'language') AS language_total, count(*) FILTER (k = 'other') AS other_total
    FROM (SELECT l_returnflag, l_quantity >= 25 AS ok, CASE WHEN l_linenumber <= 2 THEN 'prompt' WHEN l_linenumber <= 4 THEN 'language' ELSE 'other' END AS k FROM lineitem) GROUP BY 1"""
)
def criterion_counts(spark, d):
    name = F.when(F.col("l_linenumber") <= 2, "prompt/x").when(F.col("l_linenumber") <= 4, "language/x").otherwise("x")
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") >= 25).alias("ok"), S.criterion_kind(name).alias("k"))
    return rows.groupBy(F.col("l_returnflag").alias("variant")).agg(
        F.count_if(F.col("k") == "prompt").alias("prompt_total"), F.count_if((F.col("k") == "prompt") & F.col("ok")).alias("prompt_passed"), F.count_if(F.col("k") == "language").alias("language_total"), F.count_if(F.col("k") == "other").alias("other_total")
    )


@query(
    """SELECT source, count(*) FILTER (quality = 1) || '/' || count(quality) AS result, CASE WHEN count(quality) = 0 THEN 'n/a' ELSE 'rated' END AS state
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"""
)
def result_count(spark, d):
    rows = labelled(spark, d).groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("p"), F.count("quality").alias("t"))
    state = F.when(S.percentage("p", "t") == "n/a", "n/a").otherwise("rated")
    return rows.select("source", S.ratio("p", "t").alias("result"), state.alias("state"))


# -- joins (J1, J2, J5-J11) -------------------------------------------------------------------------


@query("SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def unlabelled_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def orphan_labels(spark, d):
    return table(spark, d, "labels").select("doc_id", "quality").join(table(spark, d, "documents").where("lang = 'en'").select("doc_id"), "doc_id", "left_anti")


@query(
    """SELECT coalesce(c_custkey, o_custkey) AS custkey, c_custkey IS NULL AS unexpected, n IS NULL AS missing, coalesce(n, 0) AS found, coalesce(n, 0) <> 10 AS incomplete
    FROM customer FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey"""
)
def coverage_full_outer(spark, d):
    seen = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    both = table(spark, d, "customer").select("c_custkey").join(seen, F.col("c_custkey") == F.col("o_custkey"), "full_outer")
    n = F.coalesce("n", F.lit(0))
    return both.select(F.coalesce("c_custkey", "o_custkey").alias("custkey"), F.col("c_custkey").isNull().alias("unexpected"), F.col("n").isNull().alias("missing"), n.alias("found"), (n != 10).alias("incomplete"))


@query("SELECT p_partkey, p_name FROM part SEMI JOIN lineitem ON p_partkey = l_partkey")
def suite_semi(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name").join(table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def suite_missing(spark, d):
    large = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(large, "p_partkey", "left_anti")


_ROLES = ("user", "assistant")


@query(
    """WITH want AS (SELECT conv_id, role, k FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES (0, 'user'), (1, 'assistant')) AS r(k, role)),
    seen AS (SELECT conv_id, role, count(*) AS n, bool_and(length(text) > 0) AS ok FROM conversations GROUP BY ALL)
    SELECT conv_id, role AS name, k IS NOT NULL AS needed, coalesce(n, 0) AS seen, k IS NOT NULL AND coalesce(n, 0) = 1 AND coalesce(ok, false) AS passed
    FROM want FULL JOIN seen USING (conv_id, role)"""
)
def required_checks(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", (F.length("text") > 0).alias("ok"))
    programs = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("name"), F.col("ok").alias("passed"))))
    trials = turns.groupBy(F.col("conv_id").alias("id")).agg(programs.alias("programs")).withColumn("language", F.lit("any"))
    checks = fanin.check_counts(trials, fanin.required_checks(spark, {"any": _ROLES}))
    return checks.select(F.col("id").alias("conv_id"), "name", "needed", "seen", "passed")


@query(
    """SELECT u.conv_id, u.turn, length(u.text) AS asked, length(a.text) AS answered
    FROM conversations u LEFT JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'"""
)
def positional_zip(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("t"))
    shifted = F.slice("t", 2, F.greatest(F.size("t"), F.lit(1)))
    pairs = rows.select("conv_id", F.explode(ops.zip_by_position(F.col("t"), shifted)).alias("z")).where("z.left.role = 'user'")
    follows = (F.col("z.right.turn") == F.col("z.left.turn") + 1) & (F.col("z.right.role") == "assistant")
    return pairs.select("conv_id", F.col("z.left.turn").alias("turn"), F.col("z.left.n").alias("asked"), F.when(follows, F.col("z.right.n")).alias("answered"))


@query(
    """SELECT f.o_orderkey, f.status FROM (SELECT o_orderkey, o_orderstatus AS status FROM orders) f
    LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'O' END AS old FROM orders WHERE o_orderkey % 5 <> 0) c USING (o_orderkey)
    WHERE o_orderkey % 5 = 0 OR f.status IS DISTINCT FROM c.old"""
)
def changed_settings(spark, d):
    fresh = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    cached = fresh.where("o_orderkey % 5 <> 0").select("o_orderkey", F.expr("if(o_orderkey % 7 = 0, null, 'O')").alias("status"))
    return ops.changed_settings(cached, fresh, ["o_orderkey"], ["status"])


@query(
    """SELECT conv_id, turn, conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system') AS accepted FROM conversations WHERE role = 'user'"""
)
def feedback_split(spark, d):
    rows = table(spark, d, "conversations")
    yes, no = ops.accepted_feedback(rows.where("role = 'user'").select("conv_id", "turn"), rows.where("role = 'system'"), ["conv_id"])
    return yes.withColumn("accepted", F.lit(True)).union(no.withColumn("accepted", F.lit(False)))


# -- predicates and selection (P1-P5, P10-P18, J8, A9, A10) -----------------------------------------


@query("SELECT p_partkey FROM part WHERE p_brand IN (SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 3) AND p_size IN (1, 5, 10, 20) AND p_type IS NOT NULL")
def tag_filter_and_or(spark, d):
    part = table(spark, d, "part").where("p_type is not null")
    brands = [r[0] for r in part.select("p_brand").distinct().orderBy("p_brand").limit(3).collect()]
    return part.where(matches_columns([TagFilter("p_brand", tuple(brands)), TagFilter("p_size", (1, 5, 10, 20))])).select("p_partkey")


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'R' AND l_linestatus IN ('F', 'O') AND l_linenumber IN (1, 2))")
def exists_forall_tags(spark, d):
    tags = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus"), F.lit("line"), F.col("l_linenumber").cast("string"))
    sets = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(tags).alias("tag_sets"))
    wanted = [TagFilter("flag", ("R",)), TagFilter("status", ("F", "O")), TagFilter("line", ("1", "2"))]
    return sets.where(any_set_matches("tag_sets", wanted)).select("l_orderkey")


@query(
    """SELECT r_name AS language, v.variant, count(*) AS evaluations FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('a'), ('b'), ('c')) AS v(variant)
    WHERE NOT (r_name = 'ASIA' AND v.variant = 'c') GROUP BY ALL"""
)
def shard_matrix_query(spark, d):
    entries = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    entries = entries.select(F.col("n_nationkey").alias("ord"), F.col("r_name").alias("language"), F.lit("x").alias("experiment"), F.col("n_name").alias("filter"))
    return shard_matrix(group_by_language(entries), Variants(("a", "b", "c"), {"ASIA": ("a", "b")})).drop("ord")


@query("SELECT n_regionkey AS language, string_agg(n_name, ',' ORDER BY n_nationkey) AS filters, count(*) AS evaluations FROM nation GROUP BY 1")
def grouped_filters(spark, d):
    entries = table(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_regionkey").alias("language"), F.lit("x").alias("experiment"), F.col("n_name").alias("filter"))
    return group_by_language(entries).select("language", F.array_join("filters", ",").alias("filters"), F.size("filters").cast("long").alias("evaluations"))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_brand = 'Brand#13'")
def param_filter(spark, d):
    return ops.parameter_filter(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "p_brand", "Brand#13")


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#0000000') AND c_mktsegment = 'BUILDING'")
def prefix_filter(spark, d):
    return ops.prefixed(table(spark, d, "customer"), "c_name", "Customer#0000000", F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name")


@query(
    """SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'normal' END AS priority,
        CASE WHEN o_totalprice > 100000 THEN o_orderdate + INTERVAL 30 SECONDS END AS deliver_at FROM orders"""
)
def threshold_route(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *ops.route("o_totalprice", 100000, now=F.col("o_orderdate")))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '1995-01-01' + INTERVAL 30 DAYS")
def expiry_window(spark, d):
    return ops.expiring(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "30 DAYS", F.lit("1995-01-01").cast("timestamp"))


@query("SELECT c_custkey, CASE WHEN CASE WHEN c_acctbal > 5000 THEN NULL ELSE c_acctbal > 0 END = false THEN 'disabled' ELSE 'enabled' END AS state FROM customer")
def enabled_state(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") <= 5000, F.col("c_acctbal") > 0).alias("e")).select("c_custkey", ops.enabled_label("e").alias("state"))


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' ORDER BY conv_id, turn")
def assistant_turns(spark, d):
    return ops.assistant_texts(table(spark, d, "conversations"), parts="text").drop("pos")


@query("SELECT user_id, bool_or(event_type = 'error') AS running FROM events GROUP BY user_id")
def any_running(spark, d):
    return ops.any_running(table(spark, d, "events"), ["user_id"], F.col("event_type") == "error")


# -- ordering, pages, windows (W1-W5, O1-O7, A12-A14) -----------------------------------------------


@query("SELECT event_id, user_id, event_type, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_wins_dedup(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return ops.first_by(rows, ["user_id", "event_type"], F.struct("ts", "event_id"))


@query("SELECT doc_id, 'Duplicate text of ' || doc_id AS problem FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1")
def duplicate_report(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    # Written first: both sides of the join are then plain exchanges, and a text that many share can be split.
    first = written(docs.groupBy("h").agg(F.min("doc_id").alias("f")), "first")
    return docs.join(first, "h").where("doc_id <> f").select("doc_id", F.concat(F.lit("Duplicate text of "), F.col("doc_id").cast("string")).alias("problem"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, min(event_id) AS first_seen FROM events GROUP BY user_id")
def last_wins_by_key(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return ops.last_by(rows, ["user_id"], F.col("event_id")).drop("event_id")


@query("SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 256) AS BIGINT) AS chunk FROM orders")
def chunk_256(spark, d):
    return ops.chunks(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 256)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 50")
def keyset_page(spark, d):
    return ops.keyset_page(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey", 50, 500)


@query(
    """WITH RECURSIVE s AS (SELECT user_id, event_id, event_id % 40 + 1 AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    f AS (SELECT user_id, event_id, k, size AS used, CAST(0 AS BIGINT) AS batch FROM s WHERE k = 1
        UNION ALL SELECT s.user_id, s.event_id, s.k, CASE WHEN used + size > 100 THEN size ELSE used + size END, batch + CASE WHEN used + size > 100 THEN 1 ELSE 0 END FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1)
    SELECT user_id, event_id, batch FROM f"""
)
def greedy_batches(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 40 + 1).alias("size"))
    return scans.bounded_batches(rows, ["user_id"], ["event_id"], "size", 100).select("user_id", "event_id", "batch")


@query(
    """WITH r AS (SELECT user_id, event_id, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events),
    s AS (SELECT user_id, event_id, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY event_id) AS BIGINT) AS streak FROM r)
    SELECT user_id, event_id, streak, streak >= 3 AS open FROM s"""
)
def consecutive_failures(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return ops.consecutive_failures(rows, ["user_id"], "event_id", F.col("event_type") == "error").select("user_id", "event_id", "streak", "open")


@query("SELECT o_orderkey, coalesce(bool_or(l_quantity > 49), false) AS changed FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def bool_or_changed(spark, d):
    flags = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_quantity") > 49).alias("c"))
    orders = table(spark, d, "orders").select("o_orderkey").distinct()
    return orders.join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("c", F.lit(False)).alias("changed"))


@query("SELECT DISTINCT lang, source FROM documents")
def locale_sort(spark, d):
    return ops.locale_sorted(table(spark, d, "documents").select("lang", "source").distinct(), "source", "lang")


@query("SELECT l_returnflag, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS charge, count(*) AS rows FROM lineitem GROUP BY 1")
def request_charge(spark, d):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return ops.total_charge(table(spark, d, "lineitem"), ["l_returnflag"], cents, "long").withColumnRenamed("pages", "rows")


# -- sets (U1-U7) -----------------------------------------------------------------------------------


@query(
    """SELECT o.l_orderkey, array_to_string(list_sort(list_filter(o.a, lambda x: NOT list_contains(coalesce(r.b, []), x))), ',') AS added
    FROM (SELECT l_orderkey, list_distinct(list(l_partkey)) AS a FROM lineitem GROUP BY 1) o
    LEFT JOIN (SELECT l_orderkey, list_distinct(list(l_partkey)) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) r ON o.l_orderkey = r.l_orderkey"""
)
def array_except_sorted(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("a"), F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("b"))
    return rows.select("l_orderkey", F.array_join(ops.new_ids(F.col("b"), F.col("a")), ",").alias("added"))


@query("SELECT event_type, min(event_id) AS ord FROM events GROUP BY event_type")
def ordered_distinct(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min("event_id").alias("ord")).orderBy("ord")


@query("SELECT DISTINCT l_partkey AS partkey FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size > 10")
def unexpected_names(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("partkey")).join(table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("partkey")), "partkey", "left_anti").distinct()


@query(
    """SELECT doc_id, 0 AS k, 'quality' AS category, replace(source || '|' || lang, '|', '\\|') AS evidence FROM documents JOIN labels USING (doc_id) WHERE quality = 0
    UNION ALL SELECT doc_id, 1, 'toxic', replace(source || '|' || lang, '|', '\\|') FROM documents JOIN labels USING (doc_id) WHERE toxic = 1"""
)
def failure_listing(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id")
    kinds = F.array_compact(F.array(F.when(F.col("quality") == 0, F.struct(F.lit(0).alias("k"), F.lit("quality").alias("c"))), F.when(F.col("toxic") == 1, F.struct(F.lit(1).alias("k"), F.lit("toxic").alias("c")))))
    return rows.select("doc_id", F.explode(kinds).alias("x"), S.markdown_cell(F.concat_ws("|", "source", "lang")).alias("evidence")).select("doc_id", F.col("x.k").alias("k"), F.col("x.c").alias("category"), "evidence")


# -- scalars (F1-F25) -------------------------------------------------------------------------------

_WORD = "('0x' || substr(sha256('BetaCheckout:' || c_name), 1, 16))::UBIGINT"


@query(f"SELECT c_custkey, CAST({_WORD} % 100 AS BIGINT) AS bucket FROM customer")
def rollout_bucket_py(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.rollout_bucket(F.lit("BetaCheckout"), "c_name").alias("bucket"))


@query(f"SELECT c_custkey, CAST(((CAST({_WORD} AS HUGEINT) - CASE WHEN {_WORD} >= 9223372036854775808 THEN 18446744073709551616::HUGEINT ELSE 0 END) % 100 + 100) % 100 AS BIGINT) AS bucket FROM customer")
def rollout_bucket_java(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.rollout_bucket_signed(F.lit("BetaCheckout"), "c_name").alias("bucket"))


@query(f"SELECT c_custkey, CAST({_WORD} % 10000 AS DOUBLE) / 100 AS bucket FROM customer")
def rollout_bucket_go(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.rollout_percentile(F.lit("BetaCheckout"), "c_name").alias("bucket"))


@query(
    """SELECT event_id, code, CASE WHEN code IN (408, 429, 500, 502, 503, 504) THEN 'transient' WHEN code IN (400, 401, 403, 404, 409) THEN 'permanent' ELSE 'other' END AS retry,
        CASE code WHEN 404 THEN 'not found' WHEN 403 THEN 'forbidden' WHEN 409 THEN 'conflict' WHEN 429 THEN 'throttled' ELSE 'other' END AS message
    FROM (SELECT event_id, CAST(400 + event_id % 110 AS INTEGER) AS code FROM events)"""
)
def status_class(spark, d):
    rows = table(spark, d, "events").select("event_id", (400 + F.col("event_id") % 110).cast("int").alias("code"))
    return rows.select("event_id", "code", S.retry_class("code").alias("retry"), S.status_message("code").alias("message"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_first_match(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || '/x/y' AS moved FROM pages")
def url_parts(spark, d):
    bare = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, d, "pages").select("page_id", F.try_parse_url("url", F.lit("PROTOCOL")).alias("scheme"), F.try_parse_url("url", F.lit("AUTHORITY")).alias("host"), S.blob_url(bare, F.lit("/x/y")).alias("moved"))


@query(
    """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice < 0 THEN 'negative price' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'invalid status' END,
        CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'late' END], lambda x: x IS NOT NULL), '; ') AS errors FROM orders"""
)
def row_validation(spark, d):
    rules = F.array(F.when(F.col("o_totalprice") < 0, "negative price"), F.when(~F.col("o_orderstatus").isin("F", "O"), "invalid status"), F.when(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"), "late"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.array_compact(rules), "; ").alias("errors"))


@query("SELECT l_orderkey, count(*) AS lines, count(*) FILTER (l_linenumber = 1) AS firsts FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linenumber = 1) <> 1")
def invariants(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    broken = ops.broken_invariants(rows, ["l_orderkey"], {"one first line": (F.col("l_linenumber") == 1, 1, 1)})
    lines = rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    return broken.join(lines, "l_orderkey").select("l_orderkey", "lines", F.col("found").alias("firsts"))


@query("SELECT r_name AS language, count(*) AS evaluations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def scenario_matrix(spark, d):
    rows = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return oracle.language_matrix(rows.select(F.col("r_name").alias("language")))


@query(
    """SELECT o_orderkey, o_orderpriority AS key, 'P' || substr(o_orderpriority, 1, 1) || '!' || substr(o_orderpriority, 2) AS marked, o_orderpriority NOT LIKE '%SPEC%' AS named FROM orders"""
)
def text_edits(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", p.alias("key"), F.concat(F.lit("P"), S.insert_after(p, "^.", "!")).alias("marked"), (~p.contains("SPEC")).alias("named"))


@query("SELECT page_id, NOT contains(substr(url, 9), '..') AND regexp_matches(replace(substr(url, 9), '?', ''), '^[A-Za-z0-9._/-]+$') AS safe FROM pages")
def safe_paths(spark, d):
    rest = F.replace(F.expr("substr(url, 9)"), F.lit("?"), F.lit(""))
    return table(spark, d, "pages").select("page_id", S.safe_path(rest).alias("safe"))


# -- trees (R1-R3) ----------------------------------------------------------------------------------


@query(
    """WITH leaf AS (SELECT conv_id, turn, role, length(text) > 200 AS ok FROM conversations)
    SELECT conv_id AS id, (SELECT count(*) FROM conversations c WHERE c.conv_id = l.conv_id) AS n_commands, count(*) FILTER (ok) AS passed, count(*) FILTER (role = 'system') AS errors,
        1 + count(*) AS n_criteria FROM leaf l GROUP BY conv_id"""
)
def grade_tree(spark, d):
    leaf = F.struct(F.lit("run-command").alias("graderType"), F.concat(F.lit("program/"), F.col("turn").cast("string")).alias("name"), (F.length("text") > 200).alias("passed"), F.when(F.col("role") == "system", "error").otherwise("done").alias("status"))
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.collect_list(leaf).alias("leaves"))
    criteria = F.concat(F.array(F.struct(F.lit("prompt/x").alias("name"), F.lit(True).alias("passed"))), F.transform("leaves", lambda x: F.struct(x["name"].alias("name"), x["passed"].alias("passed"))))
    inner = F.struct(F.struct(criteria.alias("criteria")).alias("metadata"), F.col("leaves").alias("details"))
    trees = rows.select("id", F.parse_json(F.to_json(F.struct(F.array(inner).alias("details")))).alias("tree"))
    walked = nodes(trees)
    commands = run_commands(walked).groupBy("id").agg(F.count(F.lit(1)).alias("n_commands"), F.count_if("passed").alias("passed"), F.count_if("error").alias("errors"))
    return commands.join(first_criteria(walked).select("id", F.size("criteria").cast("long").alias("n_criteria")), "id")


# -- fan-in of result lines (S8, R1, R2, J5, A1-A5) ---------------------------------------------------


@query(
    """WITH t AS (SELECT lang AS language, 'svc' || (doc_id % 3) AS service, source AS variant, quality = 1 AS p, toxic = 0 AS l, n_chars > 1000 AS c FROM documents JOIN labels USING (doc_id))
    SELECT CASE WHEN grouping(language) = 0 THEN 'shard' WHEN grouping(service) = 0 THEN 'service' ELSE 'variant' END AS level, language, service, variant, count(*) AS trials,
        count(*) FILTER (p) AS prompt_passed, count(*) AS prompt_total, count(*) FILTER (l) AS language_passed, count(*) AS language_total, count(*) AS other_passed, count(*) AS other_total,
        count(*) FILTER (c) AS program_passed, count(*) AS program_total
    FROM t GROUP BY GROUPING SETS ((language, variant), (variant), (service, variant))"""
)
def trial_totals(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    criterion = lambda name, ok: F.struct(F.lit(name).alias("name"), ok.alias("passed"))
    criteria = F.array(criterion("prompt/q", F.col("quality") == 1), criterion("language/t", F.col("toxic") == 0), criterion("x", F.lit(True)))
    command = F.struct(F.lit("run-command").alias("graderType"), F.lit("program/c").alias("name"), (F.col("n_chars") > 1000).alias("passed"))
    panel = F.struct(F.struct(criteria.alias("criteria")).alias("metadata"), F.array(command).alias("details"))
    line = F.struct(F.col("doc_id").cast("string").alias("evalName"), F.col("source").alias("variant"), F.lit("success").alias("status"), F.concat(F.lit("svc"), (F.col("doc_id") % 3).cast("string")).alias("service"), F.struct(F.array(panel).alias("details")).alias("gradeResult"))
    trials = written(files.trials(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), F.to_json(line).alias("text"))), "trials")
    checks = fanin.check_counts(trials, fanin.required_checks(spark, {k: ("program/c",) for k in ("en", "de", "fr", "es")}))
    return fanin.totals(fanin.trial_counts(trials, checks))


# -- streams (T1s-T9s) ------------------------------------------------------------------------------

_EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _stream(spark, d):
    # A folder and a pattern: the table is one file at some sizes and a folder of files at others.
    whole = f"{d}/events.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(whole)
    is_dir = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    return streams.read_events(spark, whole if is_dir else d, _EVENTS, glob="*.parquet" if is_dir else "events.parquet")


def _work(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("SELECT event_id, user_id, event_type FROM events")
def stream_checkpoint(spark, d):
    work = _work(spark)
    for _ in range(2):  # the second run finds nothing new behind its checkpoint
        streams.ingest(_stream(spark, d).select("event_id", "user_id", "event_type"), f"{work}/out", f"{work}/checkpoint")
    return spark.read.schema("event_id bigint, user_id bigint, event_type string").parquet(f"{work}/out")


@query(
    """SELECT CASE WHEN event_type = 'error' THEN 'abandon' WHEN coalesce(value >= 10, false) THEN 'complete' ELSE 'dead-letter' END AS settlement, count(*) AS n, min(event_id) AS first_id
    FROM events GROUP BY 1"""
)
def dead_letter_split(spark, d):
    work = _work(spark)
    rows = _stream(spark, d).select("event_id", "event_type", "value")
    streams.route_settled(rows, F.col("value") >= 10, F.col("event_type") == "error", f"{work}/out", f"{work}/checkpoint")
    out = spark.read.schema("event_id bigint, event_type string, value double, settlement string").parquet(f"{work}/out")
    return out.groupBy("settlement").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events")
def session_fifo(spark, d):
    work = _work(spark)
    streams.session_sequences(_stream(spark, d).select("event_id", "user_id"), "user_id", "event_id", work, f"{work}/checkpoint")
    return spark.read.schema("event_id bigint, user_id bigint, sequence bigint").parquet(f"{work}/rows").select("event_id", "user_id", "sequence")


# -- the evaluation operators on data made from the tables --------------------------------------------

#: Defects of results by document number: what divides it, and what it does.
_VARIANT = "'v' || (doc_id % 3)"
_TRIALS = f"""t AS (SELECT doc_id, lang, {_VARIANT} AS shard_variant, CASE WHEN doc_id % 29 = 0 THEN 'other' ELSE {_VARIANT} END AS variant, 'e' || doc_id AS name, quality, toxic
    FROM documents JOIN labels USING (doc_id) WHERE doc_id % 37 <> 0)"""
_SHARDS = "sh AS (SELECT lang, shard_variant, count(*) AS n, count(*) + sum(CASE WHEN doc_id % 31 = 0 THEN 1 ELSE 0 END) AS seen FROM t GROUP BY ALL)"


def _result_files(spark, d):
    """(root, expected, services) for a fan-in: a folder for each language and variant, with a manifest and result lines."""
    docs = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    number = F.col("doc_id")
    divides = lambda n: number % n == 0
    variant = F.concat(F.lit("v"), (number % 3).cast("string"))
    check = lambda name, when=F.lit(True): F.when(when, F.struct(F.lit("run-command").alias("graderType"), F.lit(name).alias("name"), (F.col("quality") == 1).alias("passed"), F.array(F.struct(F.when(F.col("toxic") == 1, "error").otherwise("done").alias("status"))).alias("details")))
    criterion = lambda name, ok: F.struct(F.lit(name).alias("name"), ok.alias("passed"))
    listed = F.array(criterion("prompt/q", F.col("quality") == 1), criterion("language/t", F.col("toxic") == 0), criterion("x", F.lit(True)))
    criteria = F.when(divides(17), F.slice(listed, 1, 0)).otherwise(listed)
    programs = F.when(divides(7), F.slice(F.array(check("program/c")), 1, 0)).otherwise(F.array_compact(F.array(check("program/c"), check("program/c", divides(11)), check("program/extra", divides(13)))))
    tree = F.struct(F.array(F.struct(F.struct(criteria.alias("criteria")).alias("metadata"), programs.alias("details"))).alias("details"))
    row = F.struct(F.concat(F.lit("e"), number.cast("string")).alias("evalName"), F.when(divides(29), "other").otherwise(variant).alias("variant"), F.when(divides(23), "error").otherwise("success").alias("status"), F.when(~divides(19), F.concat(F.lit("svc"), (number % 4).cast("string"))).alias("service"), tree.alias("gradeResult"))
    line = F.when(divides(37), '{"a":1} trailing').otherwise(F.to_json(row))
    lines = docs.select(F.concat_ws("-", "lang", variant).alias("shard"), "doc_id", F.explode(F.array_repeat(line, F.when(divides(31) & ~divides(37), 2).otherwise(1).cast("int"))).alias("value"))
    root = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    # One file for each shard, its lines by document; blank ones between them don't count.
    spaced = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("\u00a0\n"), F.col("value"), F.lit("\r"))).otherwise(F.col("value"))
    lines.repartition("shard").sortWithinPartitions("shard", "doc_id").select("shard", spaced.alias("value")).write.partitionBy("shard").text(f"{root}/a")
    spark.createDataFrame([("en-v0", "en", "v0", 1)], "shard string, language string, variant string, expectedEvaluations bigint").coalesce(1).write.partitionBy("shard").json(f"{root}/b")
    shards = docs.where(~divides(37)).groupBy("lang", variant.alias("variant")).agg(F.count(F.lit(1)).alias("n"))
    shards.select(F.concat_ws("-", "lang", "variant").alias("shard"), F.col("lang").alias("language"), "variant", F.col("n").alias("expectedEvaluations")).write.mode("append").partitionBy("shard").json(f"{root}/a")
    known = shards.where("not (lang = 'es' and variant = 'v2')").select(F.col("lang").alias("language"), "variant", (F.col("n") + F.when(F.col("variant") == "v1", 1).otherwise(0)).alias("evaluations"))
    expected = known.union(spark.createDataFrame([("xx", "v0", 1)], "language string, variant string, evaluations bigint")).withColumn("ord", F.struct("language", "variant"))
    services = docs.where("doc_id % 2 = 0").select(F.concat(F.lit("e"), number.cast("string")).alias("eval_name"), F.lit("looked-up").alias("service"))
    return root, written(expected, "expected"), services


def _fan_in(spark, d):
    root, expected, services = _result_files(spark, d)
    return fanin.fan_in(spark, root, expected, services, {k: ("program/c",) for k in ("en", "de", "fr", "es")}, results="*.txt", manifest="*.json")


@query(
    f"""WITH {_TRIALS}, {_SHARDS}, lab AS (SELECT lang, {_VARIANT} AS v, doc_id FROM documents JOIN labels USING (doc_id)),
    placed AS (SELECT lang, v, doc_id, CAST(sum(CASE WHEN doc_id % 31 = 0 AND doc_id % 37 <> 0 THEN 2 ELSE 1 END) OVER (PARTITION BY lang, v ORDER BY doc_id) AS BIGINT) AS place FROM lab),
    want AS (SELECT lang, shard_variant, n + CASE WHEN shard_variant = 'v1' THEN 1 ELSE 0 END AS n FROM sh WHERE NOT (lang = 'es' AND shard_variant = 'v2')),
    p AS (
        SELECT 'Missing shard artifact: xx/v0' AS problem
        UNION ALL SELECT 'Unexpected shard artifact: es/v2' FROM sh WHERE lang = 'es' AND shard_variant = 'v2'
        UNION ALL SELECT 'Duplicate shard manifest: en/v0'
        UNION ALL SELECT 'Malformed result in ' || lang || '/' || v || ' (file:' || place || ')' FROM placed WHERE doc_id % 37 = 0
        UNION ALL SELECT 'Manifest count mismatch in ' || lang || '/' || shard_variant || ': expected ' || want.n || ', manifest reports ' || sh.n FROM want JOIN sh USING (lang, shard_variant) WHERE want.n <> sh.n
        UNION ALL SELECT 'Incomplete shard ' || lang || '/' || shard_variant || ': expected ' || want.n || ' result(s), found ' || seen FROM want JOIN sh USING (lang, shard_variant) WHERE want.n <> seen
        UNION ALL SELECT 'Duplicate result: ' || variant || '/' || name FROM t WHERE doc_id % 31 = 0
        UNION ALL SELECT 'Variant mismatch in ' || lang || '/' || shard_variant || ': result ' || name || ' reports ' || variant FROM t WHERE variant <> shard_variant
        UNION ALL SELECT 'Unsuccessful trial in ' || lang || '/' || shard_variant || ': ' || name || ' has status error' FROM t WHERE doc_id % 23 = 0
        UNION ALL SELECT 'Service tag not found for ' || name FROM t WHERE doc_id % 19 = 0 AND doc_id % 2 = 1
        UNION ALL SELECT 'No criterion results found: ' || variant || '/' || name FROM t WHERE doc_id % 17 = 0
        UNION ALL SELECT 'No program check results found: ' || variant || '/' || name FROM t WHERE doc_id % 7 = 0
        UNION ALL SELECT 'Missing program check: ' || variant || '/' || name || '/program/c' FROM t WHERE doc_id % 7 = 0
        UNION ALL SELECT 'Duplicate program check: ' || variant || '/' || name || '/program/c' FROM t WHERE doc_id % 7 <> 0 AND doc_id % 11 = 0
        UNION ALL SELECT 'Unexpected program check: ' || variant || '/' || name || '/program/extra' FROM t WHERE doc_id % 7 <> 0 AND doc_id % 13 = 0
        UNION ALL SELECT 'Program check error: ' || variant || '/' || name || '/program/c' FROM t, range(2) AS r(k) WHERE toxic = 1 AND doc_id % 7 <> 0 AND (k = 0 OR doc_id % 11 = 0)
        UNION ALL SELECT 'Program check error: ' || variant || '/' || name || '/program/extra' FROM t WHERE toxic = 1 AND doc_id % 7 <> 0 AND doc_id % 13 = 0
    ) SELECT problem, count(*) AS n FROM p GROUP BY problem"""
)
def fan_in_problems(spark, d):
    # The file of a malformed line has a random name, and the words of the parser are its own.
    problem = F.regexp_replace("problem", r"^(Malformed result in [^ ]+) \([^:]*:([0-9]+)\).*$", "$1 (file:$2)")
    return _fan_in(spark, d).problems.groupBy(problem.alias("problem")).agg(F.count(F.lit(1)).alias("n"))


def _rate(p: str, t: str) -> str:
    """SQL of the text of a pass rate: passed/total and per cent to one place, half up."""
    tenths = f"((2000 * {p} + {t}) // (2 * {t}))"
    return f"{p} || '/' || {t} || ' (' || CASE WHEN {t} = 0 THEN 'n/a' ELSE ({tenths} // 10) || '.' || ({tenths} % 10) || '%' END || ')'"


@query(
    f"""WITH {_TRIALS}, r AS (SELECT lang AS language, CASE WHEN doc_id % 19 <> 0 THEN 'svc' || (doc_id % 4) WHEN doc_id % 2 = 0 THEN 'looked-up' ELSE 'unknown' END AS service, variant,
        doc_id % 17 <> 0 AS has, quality = 1 AS good, toxic = 0 AS clean, doc_id % 7 <> 0 AND doc_id % 11 <> 0 AS once FROM t),
    g AS (SELECT CASE WHEN grouping(language) = 0 THEN 'shard' WHEN grouping(service) = 0 THEN 'service' ELSE 'variant' END AS level, language, service, variant, count(*) AS trials,
        count(*) FILTER (has) AS prompt_total, count(*) FILTER (has AND good) AS prompt_passed, count(*) FILTER (has) AS language_total, count(*) FILTER (has AND clean) AS language_passed,
        count(*) AS program_total, count(*) FILTER (once AND good) AS program_passed
        FROM r GROUP BY GROUPING SETS ((language, variant), (variant), (service, variant)))
    SELECT level, language, service, variant, trials, {_rate('prompt_passed', 'prompt_total')} AS prompt, {_rate('language_passed', 'language_total')} AS "languages", {_rate('program_passed', 'program_total')} AS program FROM g"""
)
def fan_in_totals(spark, d):
    cell = lambda k: F.concat(S.ratio(f"{k}_passed", f"{k}_total"), F.lit(" ("), S.percentage(f"{k}_passed", f"{k}_total"), F.lit(")"))
    return _fan_in(spark, d).totals.select("level", "language", "service", "variant", "trials", cell("prompt").alias("prompt"), cell("language").alias("languages"), cell("program").alias("program"))


@query(
    f"""WITH {_TRIALS}, sh AS (SELECT lang, shard_variant AS v, count(*) AS n FROM t GROUP BY ALL), c AS (SELECT variant AS v, lang, count(*) AS trials FROM t GROUP BY ALL),
    rows AS (SELECT lang, v, n + CASE WHEN v = 'v1' THEN 1 ELSE 0 END AS n FROM sh WHERE NOT (lang = 'es' AND v = 'v2') UNION ALL SELECT 'xx', 'v0', 1)
    SELECT row_number() OVER (ORDER BY lang, v) AS place, '| ' || lang || ' | ' || v || ' | ' || coalesce(trials, 0) || '/' || n || ' |' AS line FROM rows LEFT JOIN c USING (lang, v)"""
)
def fan_in_report_lines(spark, d):
    """The lines of the report's table of shards, in its order."""
    root, expected, services = _result_files(spark, d)
    result = fanin.fan_in(spark, root, expected, services, {k: ("program/c",) for k in ("en", "de", "fr", "es")}, results="*.txt", manifest="*.json")
    text, _ = report.fan_in_report(result, expected)
    lines = text.split("## Shards")[1].split("##")[0].strip().split("\n")[2:]
    short = ["|".join(x.split("|")[:4]) + "|" for x in lines]
    return spark.createDataFrame(list(enumerate(short, 1)), "place bigint, line string")


@query(
    f"""WITH {_TRIALS}, r AS (SELECT CASE WHEN doc_id % 19 <> 0 THEN 'svc' || (doc_id % 4) WHEN doc_id % 2 = 0 THEN 'looked-up' ELSE 'unknown' END AS service, variant FROM t),
    v AS (SELECT variant, count(*) AS n FROM r GROUP BY 1), s AS (SELECT service, variant, count(*) AS n FROM r GROUP BY ALL),
    sh AS (SELECT DISTINCT lang, {_VARIANT} AS v FROM documents JOIN labels USING (doc_id) WHERE doc_id % 37 <> 0),
    e AS (SELECT lang, v FROM sh WHERE NOT (lang = 'es' AND v = 'v2') UNION ALL SELECT 'xx', 'v0'),
    o AS (SELECT v AS variant, min(lang || v) AS k FROM e GROUP BY 1)
    SELECT 'variants' AS part, row_number() OVER (ORDER BY k) AS place, '| ' || variant || ' | ' || coalesce(n, 0) || ' |' AS line FROM o LEFT JOIN v USING (variant)
    UNION ALL SELECT 'services', row_number() OVER (ORDER BY service, variant), '| ' || service || ' | ' || variant || ' | ' || n || ' |' FROM s
    UNION ALL SELECT 'head', 1, 'Completed ' || (SELECT count(*) FROM r) || ' trial(s) across ' || (SELECT count(*) FROM sh) || '/' || (SELECT count(*) FROM e) || ' shard(s).'"""
)
def fan_in_report_order(spark, d):
    """The report's sentence of what was completed and its tables of variants, in the order of the matrix, and of services, in locale order."""
    root, expected, services = _result_files(spark, d)
    result = fanin.fan_in(spark, root, expected, services, {k: ("program/c",) for k in ("en", "de", "fr", "es")}, results="*.txt", manifest="*.json")
    text, _ = report.fan_in_report(result, expected)
    rows = [("head", 1, next(x for x in text.split("\n") if x.startswith("Completed ")))]
    for part, title, cells in (("variants", "## Variant totals", 3), ("services", "## Service totals", 4)):
        lines = text.split(title)[1].split("##")[0].strip().split("\n")[2:]
        rows += [(part, k, "|".join(x.split("|")[:cells]) + "|") for k, x in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "part string, place bigint, line string")


def _oracle_rows(spark, d):
    """(ord, row VARIANT) made from orders, with defects by order number; a thousand rows to a path."""
    k = F.col("o_orderkey")
    category = lambda p, t, f: F.struct(p.alias("passed"), t.alias("total"), f.alias("failures"))
    none = F.expr("cast(array() as array<struct<name:string,evidence:string>>)")
    one = F.array(F.struct(F.when(k % 9 == 0, " ").otherwise("prompt/x").alias("name"), F.lit("e|v").alias("evidence")))
    row = F.struct(
        F.when(k % 101 == 0, " ").otherwise(F.concat(F.lit("s"), F.col("o_custkey").cast("string"))).alias("scenario"),
        F.when(k % 103 != 0, F.col("o_orderpriority")).alias("language"),
        F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", "failed").when(k % 2 == 0, "error").otherwise("odd").alias("status"),
        F.when(k % 5 == 0, "boom").alias("error"),
        category(k % 6, F.lit(4), F.when(k % 3 == 0, one).otherwise(none)).alias("prompt"),
        F.when(k % 107 != 0, category(k % 2, F.lit(1), none)).alias("languageChecks"),
        category(F.when(k % 109 == 0, F.lit(-1.0)).otherwise(F.lit(1.0)), F.when(k % 113 == 0, F.lit(1.5)).otherwise(F.lit(1.0)), none).alias("program"),
    )
    rows = table(spark, d, "orders").select("o_orderkey", F.format_string("%012d", F.floor(k / 1000)).alias("path"), F.to_json(row, {"ignoreNullFields": "false"}).alias("j"))
    line = F.row_number().over(Window.partitionBy("path").orderBy("o_orderkey")).cast("long")
    return written(rows.select(F.struct("path", line.alias("line")).alias("ord"), F.parse_json("j").alias("row")), "oracle-rows")


_ORACLES = """o AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS n, o_orderkey AS k, CASE WHEN o_orderkey % 101 = 0 THEN ' ' ELSE 's' || o_custkey END AS scenario,
        CASE WHEN o_orderkey % 103 <> 0 THEN o_orderpriority END AS language, CASE WHEN o_orderstatus = 'F' THEN 'passed' WHEN o_orderstatus = 'O' THEN 'failed' WHEN o_orderkey % 2 = 0 THEN 'error' ELSE 'odd' END AS status,
        o_orderkey % 5 = 0 AS boom FROM orders),
    e AS (SELECT *, 'Result ' || n AS l FROM o),
    v AS (SELECT *, list_filter([
        CASE WHEN scenario = ' ' THEN l || ' has an invalid scenario' END, CASE WHEN language IS NULL THEN l || ' has an invalid language' END, CASE WHEN status = 'odd' THEN l || ' has an invalid status' END,
        CASE WHEN status = 'error' AND NOT boom THEN l || ' error status requires an error message' END, CASE WHEN status <> 'error' AND boom THEN l || ' non-error status must have error: null' END,
        CASE WHEN k % 6 > 4 THEN l || '.prompt.passed cannot exceed ' || l || '.prompt.total' END, CASE WHEN k % 9 = 0 THEN l || '.prompt.failures[0] is invalid' END,
        CASE WHEN k % 107 = 0 THEN l || '.languageChecks must be an object' END,
        CASE WHEN k % 109 = 0 THEN l || '.program.passed must be a non-negative integer' END, CASE WHEN k % 113 = 0 THEN l || '.program.total must be a non-negative integer' END,
        CASE WHEN status = 'passed' AND (k % 6 <> 4 OR k % 109 = 0 OR k % 113 = 0) THEN l || ' passed status conflicts with check totals' END], lambda x: x IS NOT NULL) AS errors FROM e),
    ok AS (SELECT * FROM v WHERE len(errors) = 0)"""


@query(f"WITH {_ORACLES} SELECT n, array_to_string(errors, '; ') AS errors FROM v")
def oracle_validation(spark, d):
    return oracle.validate(_oracle_rows(spark, d)).select("n", F.array_join("errors", "; ").alias("errors"))


@query(
    f"""WITH {_ORACLES} SELECT row_number() OVER (ORDER BY language) AS place, language, count(*) AS scenarios, {_rate('CAST(sum(k % 6) AS BIGINT)', '(4 * count(*))')} AS prompt,
        {_rate('CAST(sum(k % 2) AS BIGINT)', 'count(*)')} AS checks, CAST(count(*) AS BIGINT) || '/' || count(*) AS program, count(*) FILTER (status = 'error') AS errors FROM ok GROUP BY language"""
)
def oracle_totals(spark, d):
    totals = oracle.summarize(_oracle_rows(spark, d), 0).totals
    cell = lambda k: F.concat(S.ratio(f"{k}_passed", f"{k}_total"), F.lit(" ("), S.percentage(f"{k}_passed", f"{k}_total"), F.lit(")"))
    # Few languages: their places are numbered in the order of the report.
    place = F.row_number().over(Window.orderBy(F.expr("language COLLATE UNICODE"))).cast("long")
    return totals.select(place.alias("place"), "language", "scenarios", cell("prompt").alias("prompt"), cell("language").alias("checks"), S.ratio("program_passed", "program_total").alias("program"), "errors")


@query(
    f"""WITH {_ORACLES} SELECT n, CAST(0 AS INTEGER) AS k, scenario, 'infrastructure' AS category, '-' AS name, 'boom' AS evidence FROM ok WHERE boom
    UNION ALL SELECT n, CASE WHEN boom THEN 1 ELSE 0 END, scenario, 'prompt', 'prompt/x', 'e\\|v' FROM ok WHERE k % 3 = 0"""
)
def oracle_failures(spark, d):
    failures = oracle.summarize(_oracle_rows(spark, d), 0).failures
    return failures.select("n", "k", "scenario", "category", "name", S.markdown_cell("evidence").alias("evidence"))


@query(
    f"""WITH {_ORACLES}, again AS (SELECT n, 'Duplicate scenario result: ' || scenario AS problem FROM ok QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY n) > 1)
    SELECT 0 AS part, n, unnest(errors) AS problem FROM v UNION ALL SELECT 1, n, problem FROM again UNION ALL SELECT 2, 0, 'Expected 7 scenario results, received ' || count(*) FROM v"""
)
def oracle_integrity(spark, d):
    return oracle.summarize(_oracle_rows(spark, d), 7).integrity.select("part", "n", "problem")


@query(
    """WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS pt, count(*) FILTER (role = 'user' AND length(text) > 200) AS pp, count(*) FILTER (role = 'assistant') AS lt,
        count(*) FILTER (role = 'assistant' AND length(text) > 100) AS lp, count(*) FILTER (role = 'system') AS gt,
        coalesce(string_agg('prompt/' || turn, ',' ORDER BY turn) FILTER (role = 'user' AND length(text) <= 200), '') AS failed FROM conversations GROUP BY conv_id)
    SELECT conv_id, CASE WHEN conv_id % 5 = 0 OR conv_id % 7 = 0 THEN 'error' WHEN pt = 0 OR pp < pt OR lp < lt THEN 'failed' ELSE 'passed' END AS status,
        CASE WHEN conv_id % 5 = 0 THEN 'boom' WHEN conv_id % 7 = 0 THEN 'Oracle did not return a grade result' END AS error,
        CASE WHEN conv_id % 5 = 0 OR conv_id % 7 = 0 THEN '0/0 0/0 0/0' ELSE pp || '/' || pt || ' ' || lp || '/' || lt || ' ' || gt || '/' || gt END AS counts,
        CASE WHEN conv_id % 5 = 0 OR conv_id % 7 = 0 THEN '' ELSE failed END AS failed FROM c"""
)
def oracle_classified(spark, d):
    number = F.col("turn").cast("string")
    user, command = F.col("role") == "user", F.col("role") == "system"
    name = F.concat(F.when(user, "prompt/").otherwise("language/"), number)
    leaf = F.struct(
        F.when(~command, F.concat(F.lit("panel/criterion/"), number)).otherwise("program/c").alias("name"), F.when(command, "run-command").alias("graderType"), F.struct(F.when(~command, name).alias("criterion")).alias("metadata"),
        F.when(command, True).when(user, F.length("text") > 200).otherwise(F.length("text") > 100).alias("passed"), F.lit("e").alias("evidence"),
    )
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", leaf.alias("leaf")))).alias("t"))
    tree = F.when(F.col("conv_id") % 7 != 0, F.struct(F.array(F.struct(F.transform("t", lambda x: x["leaf"]).alias("details"))).alias("details")))
    broken = F.col("conv_id") % 5 == 0
    outcome = F.struct(F.when(broken, "error").otherwise("success").alias("status"), F.when(broken, "boom").alias("error"), tree.alias("gradeResult"))
    out = oracle.classify(rows.select(F.col("conv_id").alias("id"), F.parse_json(F.to_json(outcome)).alias("outcome")))
    counts = F.concat_ws(" ", *(S.ratio(f"{c}.passed", f"{c}.total") for _, c in oracle.CATEGORIES))
    return out.select(F.col("id").alias("conv_id"), "status", "error", counts.alias("counts"), F.array_join(F.transform("prompt.failures", lambda x: x["name"]), ",").alias("failed"))


def _catalog(spark, d):
    """Parts as evaluations with two tag sets each, and suites of those that large line items name."""
    part = table(spark, d, "part")
    tags = F.array(F.create_map(F.lit("service"), F.col("p_type"), F.lit("plane"), F.lit("data"), F.lit("scope"), (F.col("p_size") % 5).cast("string")), F.create_map(F.lit("service"), F.lit("other"), F.lit("plane"), F.lit("control")))
    path = lambda k: F.concat(F.lit("p/"), k.cast("string"))
    entries = part.select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("language"), F.lit("x").alias("experiment"), F.col("p_name").alias("filter"), path(F.col("p_partkey")).alias("repo_path"), tags.alias("tag_sets"))
    large = table(spark, d, "lineitem").where("l_quantity > 45").select(path(F.col("l_partkey")).alias("repo_path")).distinct()
    named = large.join(entries.select("repo_path"), "repo_path", "left_semi").select(F.lit("large").alias("suite"), F.lit(0).alias("suite_ord"), F.lit(0).alias("ord"), "repo_path")
    return entries, named


_PICKED = "p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_size % 5 IN (1, 2)"


@query(f"SELECT p_partkey AS ord, p_brand AS language, p_name AS filter FROM part WHERE {_PICKED}")
def selected_entries(spark, d):
    """A suite, a structured filter and free tags together; only the first tag set of an entry has both tags."""
    entries, suites = _catalog(spark, d)
    return select_entries(entries, suites, Selection(mode="suite", suite=" large ", plane="data", tags="scope=1,2")).select("ord", "language", "filter")


@query(f"SELECT p_brand AS language, v.variant, count(*) AS evaluations FROM part, (VALUES ('a'), ('b')) AS v(variant) WHERE {_PICKED} AND NOT (p_brand = 'Brand#13' AND v.variant = 'b') GROUP BY ALL")
def selected_matrix(spark, d):
    entries, suites = _catalog(spark, d)
    picked = select_entries(entries, suites, Selection(mode="suite", suite="large", plane="data", tags="scope=1,2"))
    text = matrix_json(shard_matrix(group_by_language(picked), Variants(("a", "b"), {"Brand#13": ("a",)})))
    return expected_matrix(spark, text).select("language", "variant", "evaluations")  # as it is sent to the shards and read there


@query(f"SELECT count(*) AS evaluations FROM part WHERE {_PICKED}")
def evaluations_in_all(spark, d):
    entries, suites = _catalog(spark, d)
    return total_evaluations(group_by_language(select_entries(entries, suites, Selection(mode="suite", suite="large", plane="data", tags="scope=1,2"))))


@query("SELECT n_regionkey AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS ord, '../n/' || n_name || '/eval.yaml' AS path FROM nation")
def catalog_evals(spark, d):
    item = F.concat(F.lit("  - '../n/"), "n_name", F.lit("/eval.yaml'"))
    rows = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", item.alias("x")))), lambda r: r["x"]).alias("lines"))
    text = F.concat(F.lit("name: x\nevals:\n"), F.array_join("lines", "\n"), F.lit("\nvary:\n  - model\n"))
    return rows.select("region", F.posexplode(files.experiment_evals(text)).alias("ord", "path")).withColumn("ord", F.col("ord").cast("long"))


@query("SELECT p_partkey, 'x ' || p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part")
def catalog_tags(spark, d):
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("stimuli:\n  - name: a\n    tags:\n      brand: 'x "), "p_brand", F.lit("'\n      size: 0\n      size: "), size, F.lit("\n    graders: []\n"))
    return table(spark, d, "part").select("p_partkey", files.tag_sets(text)[0].alias("t")).select("p_partkey", F.col("t")["brand"].alias("brand"), F.col("t")["size"].alias("size"))


_SPEC_RULES = specs.CatalogRules(
    criteria={"go": 0, "python": 2}, programs={"go": (specs.Program("program/tests", "go", ("test", "./..."), "3m"),), "python": (specs.Program("program/compiles", "python", ("check.py",), "30s"),)},
    model="m-1", scopes=("small", "large"), files=(("../ignore", ".ignore"),), own_files={"python": ("../check.py", "check.py")},
)


#: Specs that one task reads, about.
SPECS_OF_A_TASK = 10_000


def _specs(spark, d):
    """A spec for each part, with defects by its number."""
    key = F.col("p_partkey")
    line = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs), F.lit("\n"))
    unless = lambda n, good, bad="": F.when(key % n != 0, good).otherwise(bad)
    python = key % 3 == 1
    language = F.when(key % 50 == 0, "cobol").when(python, "python").otherwise("go")
    criteria = F.array_join(F.transform(F.slice(F.array(*(F.lit(i) for i in range(4))), 1, (key % 4).cast("int")), lambda i: F.concat(F.lit("            - name: language/c"), i.cast("string"), F.lit("\n"))), "")
    program = F.when(python, "      - type: run-command\n        name: program/compiles\n        config:\n          command: python\n          args:\n            - check.py\n          timeout: 30s\n").otherwise("      - type: run-command\n        name: program/tests\n        config:\n          command: go\n          args:\n            - test\n            - ./...\n          timeout: 3m\n")
    text = F.concat(
        line("name: s", key.cast("string")), line("agent_environment:\n  files:\n    - src: ../ignore\n      dest: .ignore"), F.when(python, "    - src: ../check.py\n      dest: check.py\n").otherwise(""),
        line("scoring:\n  weights:", unless(11, " {}", "\n    a: 1")), line("stimuli:\n  - name: '", F.col("p_name"), "'\n    prompt: |-\n      required: ", F.col("p_type"), "\n        - type: panel"),
        line("    tags:\n      language: ", language, "\n      scope: ", unless(13, "small", "huge")), line("    graders:\n      - type: ", unless(7, "panel", "paper"), "\n        name: prompt/all\n        config:\n          prompt: |-\n            ", F.col("p_type")),
        line("          models:\n            - m-", unless(17, "1", "2"), "\n          threshold: 0\n          overall_threshold: 0\n          evidence:\n            - diff\n          criteria:\n            - name: prompt/a"),
        criteria, unless(5, program),
    )
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    # A spec is much work and its row few bytes, which splits by size don't see: tasks follow the number of rows.
    n = part.count()
    tasks = max(-(-n // SPECS_OF_A_TASK), min(spark.sparkContext.defaultParallelism, -(-n // 500)), 1)
    return part.repartition(tasks, "p_partkey").select("p_partkey", text.alias("value"))


@query(
    """WITH s AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 50 = 0 THEN 'cobol' WHEN p_partkey % 3 = 1 THEN 'python' ELSE 'go' END AS lang, p_partkey % 3 = 1 AS python FROM part)
    SELECT k AS p_partkey, 'one panel' AS rule, CAST(0 AS BIGINT) AS found, CAST(1 AS BIGINT) AS wanted FROM s WHERE k % 7 = 0
    UNION ALL SELECT k, 'no weights', 0, 1 FROM s WHERE k % 11 = 0
    UNION ALL SELECT k, 'one scope', 0, 1 FROM s WHERE k % 13 = 0
    UNION ALL SELECT k, 'first model', 0, 1 FROM s WHERE k % 17 = 0
    UNION ALL SELECT k, 'a known language', 0, 1 FROM s WHERE lang = 'cobol'
    UNION ALL SELECT k, 'program graders', 0, 1 FROM s WHERE k % 5 = 0 AND lang <> 'cobol'
    UNION ALL SELECT k, CASE WHEN python THEN 'program grader program/compiles' ELSE 'program grader program/tests' END, 0, 1 FROM s WHERE k % 5 = 0 AND lang <> 'cobol'
    UNION ALL SELECT k, 'language criteria', k % 4, CASE WHEN python THEN 2 ELSE 0 END FROM s WHERE lang <> 'cobol' AND k % 4 <> CASE WHEN python THEN 2 ELSE 0 END
    UNION ALL SELECT k, 'staged file check.py', 1, 0 FROM s WHERE python AND lang = 'cobol'"""
)
def catalog_rules(spark, d):
    return specs.broken_rules(_specs(spark, d), _SPEC_RULES, "p_partkey").select("p_partkey", "rule", F.col("found").cast("bigint"), F.col("wanted").cast("bigint"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'paper' ELSE 'panel' END AS type, 'prompt/all' AS name, NULL AS command, '' AS args FROM part
    UNION ALL SELECT p_partkey, 'run-command', CASE WHEN p_partkey % 3 = 1 THEN 'program/compiles' ELSE 'program/tests' END, CASE WHEN p_partkey % 3 = 1 THEN 'python' ELSE 'go' END, CASE WHEN p_partkey % 3 = 1 THEN 'check.py' ELSE 'test ./...' END FROM part WHERE p_partkey % 5 <> 0"""
)
def catalog_graders(spark, d):
    return specs.grader_rows(_specs(spark, d)).select("p_partkey", "type", "name", "command", F.array_join("args", " ").alias("args"))


@query("SELECT lower(r_name) AS suite, 'e/' || n_name || '/eval.yaml' AS repo_path FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'MIDDLE EAST'")
def catalog_suites(spark, d):
    rows = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region").where("r_name <> 'MIDDLE EAST'")), F.col("n_regionkey") == F.col("r_regionkey"))  # five rows
    item = F.concat(F.lit("      - e/./x/../"), "n_name", F.lit("/eval.yaml"))
    named = rows.groupBy("r_name").agg(F.concat(F.lit("  "), F.lower(F.first("r_name")), F.lit(":\n    evals:\n"), F.array_join(F.collect_list(item), "\n")).alias("x"))
    return files.suites(named.agg(F.concat(F.lit("suites:\n"), F.array_join(F.collect_list("x"), "\n"), F.lit("\nother: 1\n")).alias("value"))).select("suite", "repo_path")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, length(text) AS asked, lang AS ground_truth FROM documents")
def evaluation_cases(spark, d):
    path = f"{shared_dir(spark)}/cases-{uuid.uuid4().hex}"
    table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("query"), F.col("lang").alias("groundTruth")).write.json(path)
    return files.eval_cases(spark, path).select("id", F.length("query").alias("asked"), "ground_truth")


@query(
    """SELECT conv_id, turn, 'text' AS kind, NULL AS file_id, text FROM conversations WHERE role = 'assistant'
    UNION ALL SELECT conv_id, turn, 'citation', 'f' || turn, NULL FROM conversations WHERE role = 'assistant' AND turn % 2 = 1
    UNION ALL SELECT conv_id, turn, 'result', 's' || turn, 't' FROM conversations WHERE role = 'system'"""
)
def response_citations(spark, d):
    number = F.col("turn").cast("string")
    notes = F.array(F.struct(F.when(F.col("turn") % 2 == 1, "file_citation").otherwise("url").alias("type"), F.concat(F.lit("f"), number).alias("file_id")))
    content = F.array(F.struct(F.lit("output_text").alias("type"), F.col("text").alias("text"), notes.alias("annotations")))
    kind = F.when(F.col("role") == "assistant", "message").when(F.col("role") == "system", "file_search_call").otherwise("other")
    item = F.struct(kind.alias("type"), content.alias("content"), F.array(F.struct(F.concat(F.lit("s"), number).alias("file_id"), F.lit("t").alias("text"))).alias("results"))
    bodies = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.parse_json(F.to_json(F.struct(F.array(item).alias("output")))).alias("body"))
    return ops.citations(bodies).select("id.conv_id", "id.turn", "kind", "file_id", "text")


@query(
    """WITH RECURSIVE s AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
    f AS (SELECT user_id, event_id, k, CAST(NULL AS BIGINT) AS opened, CASE WHEN bad THEN CAST(1 AS BIGINT) ELSE 0 END AS streak, false AS refused FROM s WHERE k = 1
        UNION ALL SELECT user_id, event_id, k, CASE WHEN refused THEN was WHEN streak >= 3 THEN us END, streak, refused FROM (
            SELECT s.user_id, s.event_id, s.k, s.us, opened AS was, opened IS NOT NULL AND s.us - opened < 86400000000 AS refused,
                CASE WHEN opened IS NOT NULL AND s.us - opened < 86400000000 THEN streak WHEN NOT bad THEN 0 WHEN opened IS NOT NULL THEN 1 ELSE streak + 1 END AS streak
            FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1))
    SELECT user_id, event_id, refused, streak FROM f"""
)
def circuit_breaker(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return scans.circuit(rows, ["user_id"], "ts", F.col("event_type") == "error", F.lit(False), seconds=86400).select("user_id", "event_id", "refused", "streak")


@query(
    """SELECT p_partkey, p_name AS bare, upper(trim(p_type)) || '|' || p_brand AS listed, CAST(len(list_distinct([upper(trim(p_type)), p_brand])) AS INTEGER) AS n, p_brand AS first, CASE p_partkey % 3 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/html' ELSE 'application/vnd.ms-outlook' END AS media,
        p_size > 10 AND p_partkey % 4 <> 0 AS supported, p_name || chr(10) || chr(10) || p_brand AS context, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) WHEN p_partkey % 5 = 0 THEN p_size * 1000.0 END AS delay, p_brand || '/' || p_size AS key FROM part"""
)
def text_values(spark, d):
    odd = F.col("p_partkey") % 2 == 1
    size = F.col("p_size").cast("string")
    listed = F.concat(F.lit(" , "), F.upper("p_type"), F.lit(" ,,"), "p_brand", F.lit(","), "p_brand")
    ending = F.when(F.col("p_partkey") % 3 == 0, ".TXT").when(F.col("p_partkey") % 3 == 1, ".htm").otherwise(".msg")
    cited = F.when(F.col("p_size") > 10, F.array(size)).otherwise(F.slice(F.array(size), 1, 0))
    said = F.when(F.col("p_partkey") % 4 == 0, "  unsupported: x").otherwise("It is unsupported: x")
    headers = F.when(~odd, F.create_map(F.lit("retry-after-ms"), size, F.lit("retry-after"), F.lit("9"))).when(F.col("p_partkey") % 5 == 0, F.create_map(F.lit("retry-after"), size)).otherwise(F.create_map(F.lit("x"), size))
    rows = table(spark, d, "part").withColumn("delay", S.retry_delay(headers)).withColumn("key", S.composite_key("p_brand", size.alias("size")))
    return rows.select(
        "p_partkey", S.unquote(F.concat(F.lit(' "'), "p_name", F.lit('" '))).alias("bare"), F.array_join(F.array_distinct(S.filter_values(listed)), "|").alias("listed"), F.size(S.distinct_values(listed)).alias("n"),
        S.first_group(F.concat(F.lit("x: y\nbrand: "), "p_brand", F.lit("\n")), r"^brand:\s*(\S+)\s*$").alias("first"), S.media_type(F.concat(F.lit("a.b/c"), ending)).alias("media"), S.supported_answer(cited, said).alias("supported"),
        S.context_text(F.array("p_name", "p_brand")).alias("context"), "delay", F.concat_ws("/", "key.p_brand", "key.size").alias("key"),
    )


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS amount, c_name AS name, c_custkey % 2 = 0 AS flag, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 100 AS DOUBLE) END AS percent,
        'c' || c_custkey AS container, 'a b+/' || c_name AS blob FROM customer"""
)
def typed_values(spark, d):
    key = F.col("c_custkey")
    v = F.parse_json(F.to_json(F.struct(F.when(key % 3 == 0, F.col("c_acctbal")).alias("amount"), F.col("c_name").alias("name"), (key % 2 == 0).alias("flag"))))
    first = F.struct(F.when(key % 4 == 0, "Vendor.Other").otherwise("Vendor.Percentage").alias("name"), F.struct((key % 100).alias("Value")).alias("parameters"))
    conditions = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("Other").alias("name"), F.struct(F.lit(1).alias("Value")).alias("parameters")), first).alias("client_filters")).alias("conditions")))
    subject = S.checked_subject(F.concat(F.lit("/x/containers/c"), key.cast("string"), F.lit("/blobs/a%20b+/"), "c_name"))
    rows = table(spark, d, "customer").select("c_custkey", v.alias("v"), S.feature_percentage(conditions).alias("percent"), subject.alias("s"))
    return rows.select("c_custkey", S.typed_field("v", "$.amount", "number").alias("amount"), S.typed_field("v", "$.name", "string", True).alias("name"), S.typed_field("v", "$.flag", "boolean", True).alias("flag"), "percent", "s.container", "s.blob")


@query("SELECT o_orderkey, 'order' AS kind, o_totalprice AS value FROM orders WHERE o_orderstatus = 'F'")
def kind_filter(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "order").otherwise("other").alias("kind"), F.col("o_totalprice").alias("value"))
    return ops.of_kind(rows, "kind", "order")


@query("SELECT event_id, event_type, CASE WHEN event_type IN ('click', 'view') THEN upper(event_type) WHEN event_type = 'error' THEN 'ERROR ' || (event_id % 10) END AS call FROM events WHERE event_type IN ('click', 'view', 'error')")
def tool_dispatch(spark, d):
    rows = table(spark, d, "events").where("event_type in ('click', 'view', 'error')").select("event_id", "event_type", F.when(F.col("event_type") == "error", F.concat(F.lit("ERROR "), (F.col("event_id") % 10).cast("string"))).otherwise(F.upper("event_type")).alias("a"))
    allowed = {"click": lambda x: x == "CLICK", "view": lambda x: x == "VIEW", "error": lambda x: x.rlike("^ERROR [0-9]$")}
    return rows.select("event_id", "event_type", ops.dispatch_checked("event_type", F.col("a"), allowed).alias("call"))


@query(
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN CAST(3 AS BIGINT) ELSE 2 END AS version, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS v, o_orderkey % 6 = 1 AS conflict FROM orders"""
)
def version_checks(spark, d):
    now = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(2).cast("long").alias("version"), F.col("o_orderstatus").alias("v"))
    changes = now.where("k % 3 = 0 or k % 6 = 1").select("k", F.when(F.col("k") % 3 == 0, 2).otherwise(1).cast("long").alias("version"), F.lit("new").alias("v"))
    return ops.upsert_versions(now, changes, "k")


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE (SELECT count(*) FROM orders WHERE o_orderkey % 100 = 0) > 0")
def sentinel_refresh(spark, d):
    fresh = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    cached = fresh.where("o_orderkey % 100 <> 0").withColumn("status", F.lit("old"))
    return ops.refreshed(cached, fresh, F.col("o_orderkey") % 100 == 0, ["o_orderkey"], ["status"])


# -- scans of small files made from the tables --------------------------------------------------------


def _write_text(spark, path: str, text: str) -> None:
    """A small file, through the file system that Spark uses."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def _scenario_files(spark, d) -> str:
    """A folder of experiments, one for each region, and scenarios, one for each nation; 30 small files at any scale."""
    root = f"{shared_dir(spark)}/scan-{uuid.uuid4().hex}"
    regions = {r["r_regionkey"]: r["r_name"] for r in table(spark, d, "region").collect()}
    nations = table(spark, d, "nation").orderBy("n_nationkey").collect()
    for key, name in regions.items():
        evals = "\n".join(f"  - ../../scenarios/{r['n_name'].replace(' ', '_')}/eval.yaml" for r in nations if r["n_regionkey"] == key)
        _write_text(spark, f"{root}/experiments/{key}/experiment.yaml", f"name: {name}\nevals:\n{evals}\nvary:\n  - model\n")
    for r in nations:
        service = "" if r["n_nationkey"] % 6 == 0 else f"      service: s.{r['n_nationkey'] % 3}\n"
        text = f"name: {r['n_name'].replace(' ', '_')}\nstimuli:\n  - name: a\n    tags:\n{service}      language: '{r['n_regionkey']}'\n    graders: []\n"
        _write_text(spark, f"{root}/scenarios/{r['n_name'].replace(' ', '_')}/eval.yaml", text)
    return root


@query(
    """SELECT CAST(n_regionkey AS VARCHAR) AS language, 'scenarios/' || replace(n_name, ' ', '_') || '/eval.yaml' AS repo_path, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS place,
        CASE WHEN n_nationkey % 6 <> 0 THEN 's.' || (n_nationkey % 3) END AS service FROM nation"""
)
def scanned_catalog(spark, d):
    keys = sorted(r[0] for r in table(spark, d, "region").select("r_regionkey").collect())
    entries = files.catalog(spark, _scenario_files(spark, d), [(str(k), f"experiments/{k}/experiment.yaml") for k in keys])
    return entries.select("language", "repo_path", F.col("ord.n").cast("long").alias("place"), F.try_element_at(F.col("tag_sets")[0], F.lit("service")).alias("service"))


@query("SELECT replace(n_name, ' ', '_') AS eval_name, 's.' || (n_nationkey % 3) AS service FROM nation WHERE n_nationkey % 6 <> 0")
def scanned_services(spark, d):
    return files.eval_services(spark, _scenario_files(spark, d))


@query("SELECT row_number() OVER (ORDER BY replace(n_name, ' ', '_')) AS place, replace(n_name, ' ', '_') AS scenario FROM nation WHERE n_nationkey % 6 <> 0 AND n_nationkey % 3 = 1")
def scanned_scenarios(spark, d):
    found = files.scenario_directories(spark, f"{_scenario_files(spark, d)}/scenarios", service="s.1")
    # A folder for each scenario: few rows are numbered in order.
    return found.select(F.row_number().over(Window.orderBy(F.expr("scenario COLLATE UNICODE"))).cast("long").alias("place"), "scenario")


def _listing(spark, d):
    number = F.col("page_id")
    folder = F.when(number % 10 == 0, "node_modules/").when(number % 10 == 1, "skill/").otherwise("src/")
    name = F.when(number % 10 == 2, "node_modules.py").otherwise("a.py")
    paths = table(spark, d, "pages").select(F.concat(F.lit("golden/app"), (number % 7).cast("string"), F.lit("/"), folder, number.cast("string"), F.lit("/"), name).alias("path"))
    return paths.union(spark.createDataFrame([("golden/app3/skill/SKILL.md",)], "path string"))


@query(
    """SELECT 'golden/app' || (page_id % 7) || '/' || CASE WHEN page_id % 10 = 1 THEN 'skill/' ELSE 'src/' END || page_id || CASE WHEN page_id % 10 = 2 THEN '/node_modules.py' ELSE '/a.py' END AS path
    FROM pages WHERE page_id % 10 <> 0 AND NOT (page_id % 10 = 1 AND page_id % 7 = 3)"""
)
def pruned_walk(spark, d):
    return files.pruned(_listing(spark, d), ["node_modules", ".git"], "SKILL.md")


@query("SELECT CASE WHEN page_id % 10 = 0 THEN 'node_modules/' WHEN page_id % 10 = 1 THEN 'skill/' ELSE 'src/' END || page_id || CASE WHEN page_id % 10 = 2 THEN '/node_modules.py' ELSE '/a.py' END AS name FROM pages WHERE page_id % 7 = 2")
def listing_under(spark, d):
    return files.under(_listing(spark, d), "golden/app2/").select("name")


@query(
    f"""WITH {_ORACLES}, g AS (SELECT language, count(*) AS scenarios, CAST(sum(k % 6) AS BIGINT) AS pp, 4 * count(*) AS pt, CAST(sum(k % 2) AS BIGINT) AS cp, count(*) AS ct, count(*) FILTER (status = 'error') AS errors FROM ok GROUP BY language)
    SELECT row_number() OVER (ORDER BY language) AS place, '| ' || language || ' | ' || scenarios || ' | ' || {_rate('pp', 'pt')} || ' | ' || {_rate('cp', 'ct')} || ' | ' || ct || '/' || ct || ' (100.0%) | ' || errors || ' |' AS line FROM g"""
)
def oracle_report_lines(spark, d):
    """The rows written as JSON lines, read again, summed up and reported: the report's lines of languages."""
    path = f"{shared_dir(spark)}/oracle-{uuid.uuid4().hex}"
    rows = written(oracle.validate(_oracle_rows(spark, d)), "checked").where("size(errors) = 0").select(F.from_json(F.to_json("row"), files.ORACLE_SCHEMA).alias("r")).select("r.*")
    files.write_oracle_rows(rows, path)
    back = files.oracle_lines(spark, path, "*.json")
    text, _ = report.oracle_report(oracle.summarize(back, 0), 0)
    lines = text.split("|---|---:|---:|---:|---:|---:|\n")[1].split("\n\n")[0].split("\n")
    return spark.createDataFrame(list(enumerate(lines, 1)), "place bigint, line string")


@query("SELECT max(o_orderkey) AS token FROM (SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 50)")
def next_page_token(spark, d):
    page = ops.keyset_page(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 50, 500)
    return spark.createDataFrame([(ops.next_token(page, "o_orderkey"),)], "token bigint")


@query(
    """WITH w AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(lower(p_type || ' x ' || p_brand), '[^a-z0-9]+'), lambda x: x <> '') AS b FROM part),
    n AS (SELECT *, list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) AS same FROM w)
    SELECT p_partkey, CASE WHEN same = 0 THEN 0 ELSE round(2.0 * same / (len(a) + len(b)), 6) END AS f1 FROM n"""
)
def token_overlap(spark, d):
    f1 = ops.token_f1(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" x ", "p_type", "p_brand"))
    return table(spark, d, "part").select("p_partkey", F.round(f1, 6).alias("f1"))


# -- streams and queues -------------------------------------------------------------------------------


@query("SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'rest' END AS route, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def stream_routes(spark, d):
    work = _work(spark)
    folders = {"click": f"{work}/click", "view": f"{work}/view", None: f"{work}/rest"}
    streams.by_type(_stream(spark, d).select("event_id", "event_type"), folders, "event_type", f"{work}/checkpoint")
    parts = [spark.read.schema("event_id bigint, event_type string").option("recursiveFileLookup", "true").parquet(f).select(F.lit(k or "rest").alias("route"), "event_id") for k, f in folders.items()]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT 'errors' AS subscription, event_id FROM events WHERE event_type = 'error' UNION ALL SELECT 'large', event_id FROM events WHERE value > 20")
def topic_fan_out(spark, d):
    work = _work(spark)
    copy = f"{work}/topic"
    table(spark, d, "events").select("event_id", "event_type", "value").write.parquet(copy)
    subscriptions = {"errors": F.col("event_type") == "error", "large": F.col("value") > 20}
    streams.fan_out(spark, copy, "event_id bigint, event_type string, value double", subscriptions, f"{work}/out", f"{work}/checkpoint")
    parts = [spark.read.schema("event_id bigint").parquet(f"{work}/out/{k}").select(F.lit(k).alias("subscription"), "event_id") for k in subscriptions]
    return parts[0].union(parts[1])


@query(
    """SELECT event_id, event_type, consumer, (row_number() OVER (PARTITION BY consumer ORDER BY event_id) - 1) // 5 AS receive
    FROM (SELECT event_id, event_type, CAST(CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 3 AS INTEGER) AS consumer FROM events)"""
)
def queue_receive(spark, d):
    """All messages, each dealt to one of three consumers in receives of five."""
    return streams.received(table(spark, d, "events").select("event_id", "event_type"), "event_id", 3)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 4 < 3 THEN CAST(event_id % 4 + 1 AS INTEGER) END AS next_attempt, CASE WHEN event_id % 3 = 0 AND event_id % 4 < 3 THEN ts + INTERVAL 1500 MILLISECONDS END AS deliver_at FROM events")
def throttled_retries(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", F.when(F.col("event_id") % 3 == 0, 429).otherwise(500).alias("status"), (F.col("event_id") % 4).cast("int").alias("attempt"))
    return streams.retry_schedule(rows, "status", "attempt", F.lit(1500), F.col("ts")).select("event_id", "next_attempt", "deliver_at")


@query("SELECT o_orderkey FROM orders WHERE (o_orderkey % 3 = 0 OR o_orderdate <= TIMESTAMP '1996-01-01') AND o_orderkey % 7 <> 0")
def scheduled_messages(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("at"), F.when(F.col("o_orderkey") % 7 == 0, True).alias("off"))
    return streams.scheduled(rows, "at", F.lit("1996-01-01").cast("timestamp"), "off").select("o_orderkey")


@query("SELECT 'a' || event_id AS event_id, event_type, 'u' || user_id AS subject FROM events UNION ALL SELECT 'b' || event_id, 'cloud', NULL FROM events")
def payload_events(spark, d):
    key = F.col("event_id").cast("string")
    one = F.struct(F.concat(F.lit("a"), key).alias("id"), F.col("event_type").alias("eventType"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject"))
    two = F.struct(F.concat(F.lit("b"), key).alias("id"), F.lit("cloud").alias("type"))
    payload = F.concat(F.lit("["), F.to_json(one), F.lit(","), F.to_json(two), F.lit("]"))
    return streams.flattened(table(spark, d, "events").select(payload.alias("payload")))


@query("SELECT (place - 1) // 100 AS batch, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS place FROM events) GROUP BY 1")
def event_batches(spark, d):
    """Batches of a hundred at most, each with its size and rims."""
    work = _work(spark)

    def handle(rows, number):
        rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")).write.mode("overwrite").parquet(f"{work}/out/part={number}")

    streams.event_batches(_stream(spark, d).select("event_id"), handle, f"{work}/checkpoint", 100, "event_id")
    return spark.read.parquet(f"{work}/out").select("batch", "n", "first_id", "last_id")


@query(
    """WITH dead AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS place FROM events WHERE NOT coalesce(value >= 10, false) AND event_type <> 'error')
    SELECT event_id, place <= 50 AND coalesce(value >= 5, false) AS complete FROM dead"""
)
def dead_letters_again(spark, d):
    """Dead letters, the first fifty of them looked at again."""
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    dead = streams.settled(rows, F.col("value") >= 10, F.col("event_type") == "error").where("settlement = 'dead-letter'").drop("settlement")
    return streams.retried(dead, F.col("value") >= 5, 50, "event_id").select("event_id", (F.col("settlement") == "complete").alias("complete"))


@query(
    """SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN 9007199254740993 + event_id END AS large, CAST(CASE WHEN event_id % 3 = 0 THEN event_id * 0.01 END AS DECIMAL(30, 10)) AS price,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events"""
)
def session_values(spark, d):
    """Sessions over two micro-batches, with longs that no double holds beside nulls, and decimals."""
    work = _work(spark)
    large = F.when(F.col("event_id") % 2 == 0, F.lit(9007199254740993) + F.col("event_id"))
    price = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("decimal(30,10)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(30,10)")
    rows = table(spark, d, "events").select("event_id", "user_id", large.alias("large"), price.alias("price"))
    half = rows.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    for part in (F.col("event_id") <= half, F.col("event_id") > half):
        rows.where(part).write.mode("append").parquet(f"{work}/in")
        streams.session_sequences(streams.read_events(spark, f"{work}/in", rows.schema), "user_id", "event_id", work, f"{work}/checkpoint")
    return spark.read.parquet(f"{work}/rows").select("event_id", "user_id", "large", "price", "sequence")


@query("SELECT p_partkey, p_partkey % 4 <> 0 AND p_partkey % 7 <> 0 AS has FROM part")
def filter_given(spark, d):
    """Whether a filter holds more than blanks."""
    key = F.col("p_partkey")
    value = F.when(key % 7 != 0, F.when(key % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_brand")))
    return table(spark, d, "part").select("p_partkey", S.has_value(value).alias("has"))


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN text END AS said,
        CASE turn % 3 WHEN 0 THEN 'Expected one oracle result, received 0' WHEN 2 THEN 'Expected one oracle result, received 2' END AS error FROM conversations"""
)
def stdout_outcomes(spark, d):
    """Outputs of commands with none, one and two values."""
    one = F.to_json(F.struct(F.col("text").alias("said")))
    text = F.concat(F.lit("\r\n\ufeff \n"), F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, one).otherwise(F.concat(one, F.lit("\r\n"), one)), F.lit("\n"))
    rows = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), text.alias("stdout"))
    return files.outcomes(rows).select("id.conv_id", "id.turn", F.try_variant_get("outcome", "$.said", "string").alias("said"), "error")


@query("SELECT event_id, event_type, value FROM events")
def produced_events(spark, d):
    """Events appended to a folder in small files, and received by a run that is bounded in time."""
    work = _work(spark)
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    streams.produce(rows, f"{work}/in", max(1, rows.count() // 20))
    streams.ingest(streams.read_events(spark, f"{work}/in", rows.schema, 5), f"{work}/out", f"{work}/checkpoint", 600)
    return spark.read.schema(rows.schema).parquet(f"{work}/out")


@query(
    """WITH n AS (SELECT count(*) FILTER (p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)) AS missing FROM part)
    SELECT 'mode' AS "case", 'Unknown selection mode "some".' AS message
    UNION ALL SELECT 'name', 'Suite selection requires --suite <name>.'
    UNION ALL SELECT 'suite', 'Unknown suite "none". Available suites: all, large'
    UNION ALL SELECT 'tags', 'Tag selection requires at least one key=value filter.'
    UNION ALL SELECT 'nothing', 'The requested selection matched no experiment evaluations.'
    UNION ALL SELECT 'undeclared', 'Suite "all" contains evaluations not declared by a language experiment: ' || missing FROM n"""
)
def selection_errors(spark, d):
    """What wrong selections are told; of undeclared evaluations, how many there are."""
    entries, large = _catalog(spark, d)
    every = entries.select(F.lit("all").alias("suite"), F.lit(-1).alias("suite_ord"), F.lit(0).alias("ord"), "repo_path")
    suites = written(every.union(large), "suites")
    declared = entries.join(large.select("repo_path"), "repo_path", "left_semi")
    cases = {"mode": Selection(mode="some"), "name": Selection(mode="suite", suite=" "), "suite": Selection(mode="suite", suite="none"), "tags": Selection(mode="tags"), "nothing": Selection(mode="all", plane="other"), "undeclared": Selection(mode="suite", suite="all")}
    rows = []
    for name, want in cases.items():
        try:
            select_entries(declared, suites, want)
        except ValueError as e:
            told = str(e)
            if name == "undeclared":
                head, _, names = told.partition(": ")
                listed, _, more = names.partition(" and ")
                told = f"{head}: {len(listed.split(', ')) + int((more or '0').split()[0])}"
            rows.append((name, told))
    return spark.createDataFrame(rows, "case string, message string")


@query(
    """SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'user ' || user_id WHEN 'view' THEN CAST(user_id * 2 AS VARCHAR) END AS result
    FROM events WHERE event_type IN ('click', 'view')"""
)
def function_calls(spark, d):
    """Calls by name of functions of the session, with their arguments as the caller wrote them."""
    from gradelake.operators.registry import Functions

    known = Functions(spark)
    known.scalar("named_user", {"id": "bigint"}, "string", "concat('user ', id)", "id >= 0")
    known.scalar("doubled", {"x": "bigint"}, "bigint", "2 * x")
    user = F.col("user_id").cast("string")
    text = F.when(F.col("event_type") == "click", F.concat(F.lit('{"id":'), user, F.lit("}"))).otherwise(F.concat(F.lit('{"x":'), user, F.lit("}")))
    name = F.when(F.col("event_type") == "click", "named_user").otherwise("doubled")
    calls = table(spark, d, "events").where("event_type in ('click', 'view')").select("event_id", "event_type", name.alias("name"), F.parse_json(text).alias("arguments"))
    return known.called(calls).select("event_id", "event_type", "result")


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '  command: cmd.exe' || chr(10) || '  args:' || chr(10) || '    - /d' || chr(10) || '    - /s' || chr(10) || '    - /c' || chr(10) || '    - npm' || chr(10) ELSE '  command: npm' || chr(10) || '  args:' || chr(10) END
        || '    - ' || p_name AS spec FROM part"""
)
def shell_specs(spark, d):
    text = F.concat(F.lit("  command: npm\n  args:\n    - "), "p_name")
    return table(spark, d, "part").select("p_partkey", S.shell_commands(text, F.when(F.col("p_partkey") % 2 == 0, "win32").otherwise("linux")).alias("spec"))


@query(
    """SELECT part, (place - 1) // 100 AS batch, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id
    FROM (SELECT event_id, user_id % 4 AS part, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS place FROM events) GROUP BY 1, 2"""
)
def partition_batches(spark, d):
    """Batches of a hundred at most inside each of four partitions."""
    work = _work(spark)

    def handle(rows, number):
        rows.groupBy("part", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")).write.mode("overwrite").parquet(f"{work}/out/micro_batch={number}")

    rows = _stream(spark, d).select("event_id", (F.col("user_id") % 4).alias("part"))
    streams.event_batches(rows, handle, f"{work}/checkpoint", 100, "event_id", "part")
    return spark.read.parquet(f"{work}/out").select("part", "batch", "n", "first_id", "last_id")


@query(
    """SELECT 'file' AS kind, 'kind=' || k || '/sub=' || s AS folder, count(*) AS n FROM (SELECT CASE WHEN page_id % 5 = 0 THEN 'skill' ELSE 'src' || page_id % 5 END AS k, CASE WHEN page_id % 3 = 0 THEN 'build' ELSE 'a' || page_id % 3 END AS s FROM pages)
        WHERE k <> 'skill' AND s <> 'build' GROUP BY ALL
    UNION ALL SELECT 'listed', k, 1 FROM (SELECT DISTINCT CASE WHEN page_id % 5 = 0 THEN 'kind=skill' ELSE 'kind=src' || page_id % 5 END AS k FROM pages)"""
)
def walked_files(spark, d):
    """Pages written to folders, and walked: lines of the files found, and folders of the first level, which are all listed, by their names."""
    root = f"{shared_dir(spark)}/walk-{uuid.uuid4().hex}"
    number = F.col("page_id")
    kind = F.when(number % 5 == 0, "skill").otherwise(F.concat(F.lit("src"), (number % 5).cast("string")))
    sub = F.when(number % 3 == 0, "build").otherwise(F.concat(F.lit("a"), (number % 3).cast("string")))
    table(spark, d, "pages").select("page_id", kind.alias("kind"), sub.alias("sub")).repartition("kind", "sub").write.partitionBy("kind", "sub").json(f"{root}/in")
    _write_text(spark, f"{root}/in/kind=skill/SKILL.md", "x")
    found, listed = files.walked(spark, f"{root}/in", ["sub=build", "_temporary"], "SKILL.md")
    paths = found.where("path like '%.json' and not contains(path, '/.')")
    lines = spark.read.option("recursiveFileLookup", "true").json(f"{root}/in", schema="page_id bigint").select(F.regexp_extract(F.col("_metadata.file_path"), "(kind=.*)$", 1).alias("path"))
    files_ = lines.join(paths, "path").select(F.lit("file").alias("kind"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"))
    folders = listed.where("path <> '' and not contains(path, '/')").select(F.lit("listed").alias("kind"), F.col("path").alias("folder"))
    return files_.union(folders).groupBy("kind", "folder").agg(F.count(F.lit(1)).alias("n"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: pass rates by language and source, with the rate as it stands in the report, in locale order."""
    rows = pass_rate_by_group(spark, sf_dir)
    return ops.locale_sorted(rows.withColumn("rate", S.percentage("passed", "total")), "lang", "source")
