"""Saving and restoring review sessions; here every customer is a session and their orders are its items."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from labelsieve.operators import review
from labelsieve.operators.session_state import latest_headers, restore_sessions, save_sessions, saved_items
from labelsieve.plans import oracle_views as sql
from labelsieve.plans import views
from labelsieve.plans.registry import query
from labelsieve.plans.review_queries import _FOLD
from labelsieve.session import ensure_checkpoint_dir


def _folder(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/sessions-{uuid.uuid4().hex}"


def _reviewed_sessions(spark, d):
    """(items with their review, identity, stacks): one or two commands for every reviewed item, some waiting to be redone."""
    orders = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_custkey").cast("string").alias("session_key"))
    items = views.queue_items(spark, d).join(orders, "ordinal").select("session_key", "id", "ordinal", "original_label", "label", "status")
    customers = views.table(spark, d, "customer")
    identity = customers.select(
        F.col("c_custkey").cast("string").alias("session_key"), F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("number"),
        F.concat(F.lit("customers/"), F.col("c_custkey").cast("string")).alias("source"), F.md5("c_name").alias("source_hash"), F.md5("c_mktsegment").alias("layout_hash"))
    reviewed = review.reviewed_items(items)
    twice = F.col("ordinal") % 5 == 0

    def command(step, before_label, before_status, after_label, after_status):
        return F.struct(
            F.col("ordinal").alias("ordinal"), F.lit(step).alias("step"), F.col("id").alias("item_id"), before_label.alias("before_label"),
            before_status.alias("before_status"), after_label.alias("after_label"), after_status.alias("after_status"))

    start, pending, middle = F.col("original_label"), F.lit("pending"), F.lit("uncertain")
    end = (F.col("label"), F.col("status"))
    steps = F.when(twice, F.array(command(0, start, pending, start, middle), command(1, start, middle, *end))).otherwise(
        F.array(command(0, start, pending, *end)))
    undone = F.when(F.col("ordinal") % 3 == 0, command(0, *end, F.lit("F"), F.lit("skipped")))
    dropped = ("ordinal", "step")
    stacks = reviewed.groupBy("session_key").agg(
        F.sort_array(F.flatten(F.collect_list(steps))).alias("undo"), F.sort_array(F.collect_list(undone)).alias("redo"))
    stacks = stacks.withColumns({c: F.transform(c, lambda x: x.dropFields(*dropped)) for c in ("undo", "redo")})
    return items, identity, stacks


def _restored(spark, d):
    """Sessions saved, then loaded again while some sources, classes, items or files had changed."""
    items, identity, stacks = _reviewed_sessions(spark, d)
    path = _folder(spark)
    last = F.col("session_key").cast("long") % 10
    wrong = stacks.withColumns({
        "undo": F.when(last == 1, F.transform("undo", lambda c: c.withField("after_status", F.lit("pending")))).otherwise(F.col("undo")),
        "redo": F.when(last == 2, F.transform("redo", lambda c: c.withField("after_label", F.lit("Z")))).otherwise(F.col("redo"))})
    save_sessions(items.drop("ordinal"), identity.filter("nation <> 4"), wrong, path)
    headers = latest_headers(spark, path).join(identity.select("session_key", "nation"), "session_key").withColumns({
        "format": F.when(F.col("nation") == 5, 1).otherwise(F.col("format")),
        "n_items": F.when(F.col("nation") == 6, F.col("n_items") + 1).otherwise(F.col("n_items"))}).drop("nation")
    saved = saved_items(spark, path, headers).withColumn(
        "status", F.when((last == 8) & (F.col("status") == "skipped"), "odd").otherwise(F.col("status")))
    now = identity.withColumns({
        "source": F.when(F.col("nation") == 1, "moved").otherwise(F.col("source")),
        "source_hash": F.when(F.col("nation") == 2, F.lit(None)).otherwise(F.col("source_hash")),
        "layout_hash": F.when(F.col("nation") == 3, F.md5("layout_hash")).otherwise(F.col("layout_hash"))})
    fresh = items.filter("ordinal % 50 <> 0").select("session_key", "id", F.col("original_label").alias("label"), F.lit("pending").alias("status"))
    names = F.when(F.col("number") % 10 == 7, F.array(F.lit("F"), F.lit("O"))).otherwise(F.array(F.lit("F"), F.lit("O"), F.lit("P")))
    classes = identity.select("session_key", F.explode(names).alias("class_name"))
    return restore_sessions(headers, saved, fresh, now, classes)


_SESSIONS = """
si AS (SELECT qi.*, CAST(o_custkey AS VARCHAR) AS session_key, o_custkey FROM qi JOIN orders ON o_orderkey = ordinal),
rev AS (SELECT * FROM si WHERE label <> original_label OR status <> 'pending'),
facts AS (
  SELECT session_key, count(*) AS n, sum(CASE WHEN ordinal % 5 = 0 THEN 2 ELSE 1 END) AS n_undo, count(*) FILTER (ordinal % 3 = 0) AS n_redo,
         bool_or(ordinal % 50 = 0) AS gone, bool_or(label = 'P') AS p_label, bool_or(status = 'skipped') AS skipped,
         bool_or(label = 'P' OR original_label = 'P') AS p_step
  FROM rev GROUP BY session_key
),
judged AS (
  SELECT CAST(c_custkey AS VARCHAR) AS session_key, c_custkey % 10 AS last, coalesce(n, 0) AS n, coalesce(n_undo, 0) AS n_undo,
         coalesce(n_redo, 0) AS n_redo, coalesce(p_step, false) AS p_step,
         CASE WHEN c_nationkey = 4 THEN 'no_saved_state' WHEN c_nationkey = 5 THEN 'other_format' WHEN c_nationkey = 1 THEN 'other_source'
              WHEN c_nationkey = 2 THEN 'other_source_hash' WHEN c_nationkey = 3 THEN 'other_layout' WHEN c_nationkey = 6 THEN 'incomplete'
              WHEN gone THEN 'unknown_item' WHEN c_custkey % 10 = 7 AND p_label THEN 'unknown_label'
              WHEN c_custkey % 10 = 8 AND skipped THEN 'unknown_status' END AS reason
  FROM customer LEFT JOIN facts ON facts.session_key = CAST(c_custkey AS VARCHAR)
),
decided AS (
  SELECT *, reason IS NULL AND NOT (last = 1 AND n_undo > 0 OR last = 2 AND n_redo > 0 OR last = 7 AND p_step) AS kept FROM judged
)"""


@query("""
SELECT session_key, reason IS NULL AS restored, reason, kept AS stacks_kept, CASE WHEN reason IS NULL THEN n ELSE 0 END AS n_items,
       CAST(CASE WHEN kept THEN n_undo ELSE 0 END AS BIGINT) AS n_undo, CASE WHEN kept THEN n_redo ELSE 0 END AS n_redo
FROM decided
""", (sql.QUEUE_ITEMS, _SESSIONS))
def restore_decisions(spark, d):
    """Which sessions are restored, why others are refused, and which lose their stacks."""
    return _restored(spark, d).decisions


@query("""
SELECT si.session_key, id, CASE WHEN reason IS NULL THEN label ELSE original_label END AS label,
       CASE WHEN reason IS NULL THEN status ELSE 'pending' END AS status
FROM si JOIN decided ON decided.session_key = si.session_key WHERE ordinal % 50 <> 0
""", (sql.QUEUE_ITEMS, _SESSIONS))
def restored_items(spark, d):
    return _restored(spark, d).items


@query("""
SELECT v.call, CAST(CASE v.call WHEN 1 THEN count(*) WHEN 2 THEN 0 ELSE count(*) FILTER (c_nationkey = 7) END AS BIGINT) AS sessions_saved
FROM customer, (VALUES (1), (2), (3)) v(call) GROUP BY v.call
""")
def session_versions(spark, d):
    """A first save, one without any change, and one after the stacks of some sessions were cleared or filled."""
    items, identity, stacks = _reviewed_sessions(spark, d)
    path, shown = _folder(spark), items.drop("ordinal")
    first = save_sessions(shown, identity, stacks, path)
    same = save_sessions(shown, identity, stacks, path)
    seventh = identity.filter("nation = 7").select("session_key")
    command = F.array(F.struct(*[F.lit(v).alias(n) for n, v in (
        ("item_id", "i"), ("before_label", "F"), ("before_status", "pending"), ("after_label", "O"), ("after_status", "modified"))]))
    more = stacks.join(seventh, "session_key", "left_anti").unionByName(seventh.select("session_key", command.alias("undo"), command.alias("redo")))
    changed = save_sessions(shown, identity, more, path)
    return spark.createDataFrame([(1, first), (2, same), (3, changed)], "call int, sessions_saved long")


@query(_FOLD[:_FOLD.index("ends AS (")].rstrip().rstrip(",") + """
SELECT session_id, len(undo) AS n_undo, len(redo) AS n_redo,
       array_to_string(list_transform(undo, lambda c: concat_ws('/', c.i, coalesce(c.bl, '-'), coalesce(c.bs, '-'), coalesce(c.al, '-'), coalesce(c.s2, '-'))), ',') AS undo,
       array_to_string(list_transform(redo, lambda c: concat_ws('/', c.i, coalesce(c.bl, '-'), coalesce(c.bs, '-'), coalesce(c.al, '-'), coalesce(c.s2, '-'))), ',') AS redo
FROM st QUALIFY n = max(n) OVER (PARTITION BY session_id)
""")
def session_stacks(spark, d):
    """The undo and redo stacks that a log of commands leaves behind."""
    found = review.session_stacks(views.session_commands(spark, d))

    def shown(stack):
        parts = ("item_id", "before_label", "before_status", "after_label", "after_status")
        return F.array_join(F.transform(stack, lambda c: F.concat_ws("/", *[F.coalesce(c[p], F.lit("-")) for p in parts])), ",").alias(stack)

    return found.select(
        "session_id", F.size("undo").cast("long").alias("n_undo"), F.size("redo").cast("long").alias("n_redo"), shown("undo"), shown("redo"))
