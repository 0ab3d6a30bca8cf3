"""Review log, review state, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from labelsieve.operators import review
from labelsieve.plans import oracle_views as sql
from labelsieve.plans import views
from labelsieve.plans.registry import query, r6
from labelsieve.session import ensure_checkpoint_dir
from labelsieve.streaming import review_stream as stream


@query("""
SELECT item_id, arg_max(label, seq) AS label, arg_max(status, seq) AS status FROM rl GROUP BY item_id
""", (sql.REVIEW_LOG,))
def current_state(spark, d):
    return review.current_state(views.review_log(spark, d))


_HISTORY = """
hist AS (
  SELECT seq, item_id, lag(label) OVER w AS before_label, label AS after_label,
         lag(status) OVER w AS before_status, status AS after_status
  FROM rl WINDOW w AS (PARTITION BY item_id ORDER BY seq)
  QUALIFY before_label IS NULL OR before_label <> after_label OR before_status <> after_status
)"""


@query("SELECT * FROM hist", (sql.REVIEW_LOG, _HISTORY))
def effective_updates(spark, d):
    return review.effective_updates(views.review_log(spark, d))


@query("""
, st(item_id, label, status) AS (SELECT DISTINCT item_id, 'class_1', 'correct' FROM rl),
logged AS (SELECT 0 AS ord, -1 AS seq, item_id, label, status FROM st UNION ALL SELECT 1, seq, item_id, label, status FROM rl),
steps AS (
  SELECT *, lag(label) OVER w AS bl, lag(status) OVER w AS bs FROM logged WINDOW w AS (PARTITION BY item_id ORDER BY ord, seq)
)
SELECT item_id, count(*) AS changes FROM steps WHERE ord = 1 AND (bl <> label OR bs <> status) GROUP BY item_id
""", (sql.REVIEW_LOG,))
def change_counts(spark, d):
    """Effective updates per item, counted from a known start state."""
    log = views.review_log(spark, d)
    start = log.select("item_id").distinct().withColumns({"label": F.lit("class_1"), "status": F.lit("correct")})
    return review.effective_updates(log, start).groupBy("item_id").agg(F.count("*").alias("changes"))


_FOLD = """
WITH RECURSIVE cmd AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
         CASE event_type WHEN 'view' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'update' END AS op,
         'i' || (CAST(floor(value) AS BIGINT) % 7) AS item,
         CASE WHEN CAST(floor(value) AS BIGINT) % 3 <> 0 THEN 'class_' || (CAST(floor(value) AS BIGINT) % 4) END AS label,
         CASE event_type WHEN 'click' THEN 'correct' WHEN 'purchase' THEN 'modified' END AS status
  FROM events
),
st AS (
  SELECT DISTINCT session_id, 0::BIGINT AS n, []::STRUCT(i VARCHAR, bl VARCHAR, bs VARCHAR, al VARCHAR, s2 VARCHAR)[] AS undo,
         []::STRUCT(i VARCHAR, bl VARCHAR, bs VARCHAR, al VARCHAR, s2 VARCHAR)[] AS redo,
         MAP([]::VARCHAR[], []::STRUCT(l VARCHAR, s VARCHAR)[]) AS items
  FROM cmd
  UNION ALL
  SELECT session_id, n,
         CASE WHEN eff THEN list_append(undo, {'i': item, 'bl': bl, 'bs': bs, 'al': al, 's2': s2})[-2048:]
              WHEN op = 'undo' THEN undo[1:len(undo) - 1]
              WHEN op = 'redo' AND len(redo) > 0 THEN list_append(undo, redo[-1])[-2048:] ELSE undo END,
         CASE WHEN eff THEN [] WHEN op = 'undo' AND len(undo) > 0 THEN list_append(redo, undo[-1])
              WHEN op = 'redo' THEN redo[1:len(redo) - 1] ELSE redo END,
         CASE WHEN eff THEN map_concat(items, MAP([item], [{'l': al, 's': s2}]))
              WHEN op = 'undo' AND len(undo) > 0 THEN map_concat(items, MAP([undo[-1].i], [{'l': undo[-1].bl, 's': undo[-1].bs}]))
              WHEN op = 'redo' AND len(redo) > 0 THEN map_concat(items, MAP([redo[-1].i], [{'l': redo[-1].al, 's': redo[-1].s2}]))
              ELSE items END
  FROM (
    SELECT st.session_id, c.n, op, item, undo, redo, items, items[item].l AS bl, items[item].s AS bs,
           coalesce(label, items[item].l) AS al, coalesce(status, items[item].s) AS s2,
           op = 'update' AND (coalesce(label, items[item].l) IS DISTINCT FROM items[item].l
                              OR coalesce(status, items[item].s) IS DISTINCT FROM items[item].s) AS eff
    FROM st JOIN cmd c ON c.session_id = st.session_id AND c.n = st.n + 1
  )
),
ends AS (SELECT session_id, unnest(map_entries(items)) AS e FROM st QUALIFY n = max(n) OVER (PARTITION BY session_id))
SELECT session_id, e.key AS item_id, e.value.l AS label, e.value.s AS status FROM ends
"""


@query(_FOLD)
def undo_redo_fold(spark, d):
    return review.undo_redo_fold(views.session_commands(spark, d))


_START = """
st AS (
  SELECT s.session_id, 0::BIGINT AS n, []::STRUCT(i VARCHAR, bl VARCHAR, bs VARCHAR, al VARCHAR, s2 VARCHAR)[] AS undo,
         []::STRUCT(i VARCHAR, bl VARCHAR, bs VARCHAR, al VARCHAR, s2 VARCHAR)[] AS redo,
         map_from_entries(list_transform(range(7), lambda k: {'k': 'i' || k, 'v': {'l': 'class_' || (k % 2), 's': 'pending'}})) AS items
  FROM (SELECT DISTINCT session_id FROM cmd) s
  UNION ALL"""


@query(_FOLD[:_FOLD.index("st AS (")] + _START.strip() + _FOLD[_FOLD.index("UNION ALL") + len("UNION ALL"):].replace(
    "SELECT session_id, e.key AS item_id, e.value.l AS label, e.value.s AS status FROM ends",
    "SELECT session_id, e.key AS item_id, e.value.l AS label, e.value.s AS status FROM ends "
    "WHERE e.key IN (SELECT item FROM cmd WHERE cmd.session_id = ends.session_id AND op = 'update' AND (label IS NOT NULL OR status IS NOT NULL))"))
def undo_redo_fold_from_start(spark, d):
    """The fold over items with a start state; rows of items that the session's updates name."""
    commands = views.session_commands(spark, d)
    places = F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k")
    start = commands.select("session_id").distinct().select("session_id", places).select(
        "session_id", F.concat(F.lit("i"), F.col("k").cast("string")).alias("item_id"),
        F.concat(F.lit("class_"), (F.col("k") % 2).cast("string")).alias("label"), F.lit("pending").alias("status"))
    named = commands.filter("op = 'update' AND (label IS NOT NULL OR status IS NOT NULL)").select("session_id", "item_id").distinct()
    folded = review.undo_redo_fold(commands, start).join(named, ["session_id", "item_id"])
    first = start.withColumnsRenamed({"label": "_label", "status": "_status"})
    return folded.join(first, ["session_id", "item_id"]).select(
        "session_id", "item_id", F.coalesce("label", "_label").alias("label"), F.coalesce("status", "_status").alias("status"))


@query(_FOLD)
def review_stream(spark, d):
    """The same fold as a stream over the event file; equals ``undo_redo_fold`` for the items it touched."""
    ensure_checkpoint_dir(spark)
    work = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    source = views.table(spark, d, "events")
    own = stream.stream_session(spark)
    events = own.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    commands = views.as_session_commands(events)

    def append(batch, _):
        batch.write.mode("append").parquet(f"{work}/changes")

    run = (stream.review_stream(commands).writeStream.outputMode("update").foreachBatch(append)
           .option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start())
    run.awaitTermination()
    return stream.latest_changes(spark.read.parquet(f"{work}/changes"))


_ARRIVAL = """
timed AS (
  SELECT *, epoch_ms(ts) AS ms, CAST(floor(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) / 6) AS BIGINT)
    + CASE event_id % 11 WHEN 3 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS batch
  FROM events
),
marks AS (SELECT batch, max(max(ms)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 172800000 AS mark FROM timed GROUP BY batch),
placed AS (SELECT timed.*, coalesce(ms < mark, false) AS late FROM timed JOIN marks USING (batch)),"""


@query(_FOLD.replace("WITH RECURSIVE", "WITH RECURSIVE" + _ARRIVAL).replace("ORDER BY event_id", "ORDER BY ms, event_id").replace(
    "  FROM events\n),\nst AS", "  FROM placed WHERE NOT late\n),\nst AS") + """
UNION ALL
SELECT CAST(user_id AS VARCHAR), CASE WHEN event_type NOT IN ('view', 'signup') THEN 'i' || (CAST(floor(value) AS BIGINT) % 7) END,
       CAST(event_id AS VARCHAR), 'late' FROM placed WHERE late
""")
def ordered_review_stream(spark, d):
    """Commands that arrive in six-day batches, some of them one or two batches behind: the states they lead to in the
    order of their times, and those that came more than two days after the watermark had passed them."""
    ensure_checkpoint_dir(spark)
    work = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    own = stream.stream_session(spark)
    events = views.table(own, d, "events")
    instant = F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))")  # whatever the time zone
    own.conf.set("spark.sql.session.timeZone", "UTC")
    first = events.agg(F.min(F.to_date("ts")).alias("first"))
    behind = F.when(F.col("seq") % 11 == 3, 1).when(F.col("seq") % 11 == 5, 2).otherwise(0)
    commands = views.as_session_commands(events).join(events.select(F.col("event_id").alias("seq"), instant.alias("ts")), "seq").join(first)
    commands = commands.withColumn("batch", F.floor(F.datediff(F.to_date("ts"), "first") / 6) + behind).drop("first")
    commands.write.partitionBy("batch").parquet(f"{work}/arrivals")
    schema = commands.drop("batch").schema
    batches = sorted(row.batch for row in own.read.parquet(f"{work}/arrivals").select("batch").distinct().collect())
    end = own.createDataFrame([("", "update", "i0")], "session_id string, op string, item_id string").select(
        F.lit(-1).cast("long").alias("seq"), "session_id", "op", "item_id", *[F.lit(None).cast("string").alias(c) for c in ("label", "status")],
        F.lit("2200-01-01").cast("timestamp").alias("ts"))  # its time lets the watermark pass all others
    parts = [own.read.schema(schema).parquet(f"{work}/arrivals/batch={batch}") for batch in batches] + [end]

    def append(batch, _):
        batch.write.mode("append").parquet(f"{work}/changes")

    for part in parts:
        part.write.mode("append").parquet(f"{work}/in")
        arriving = own.readStream.schema(schema).parquet(f"{work}/in")
        run = (stream.ordered_review_stream(arriving, "ts", "2 days").writeStream.outputMode("append").foreachBatch(append)
               .option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start())
        run.awaitTermination()
    rows = spark.read.parquet(f"{work}/changes").filter("session_id <> ''")
    late = stream.late_of(rows).select("session_id", "item_id", F.col("seq").cast("string").alias("label"), F.lit("late").alias("status"))
    return stream.latest_changes(stream.changes_of(rows)).unionByName(late)


@query("""
SELECT status, count(*) AS n FROM rl GROUP BY status
""", (sql.REVIEW_LOG,))
def status_count_stream(spark, d):
    ensure_checkpoint_dir(spark)
    work = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    source = views.table(spark, d, "events")
    events = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d)

    def replace(batch, _):
        batch.write.mode("overwrite").parquet(f"{work}/counts")

    run = (stream.status_count_stream(views.as_review_log(events)).writeStream.outputMode("complete").foreachBatch(replace)
           .option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.parquet(f"{work}/counts")


@query("""
SELECT s.status, count(qi.id) AS n
FROM (VALUES ('pending'), ('correct'), ('modified'), ('uncertain'), ('skipped')) s(status)
LEFT JOIN qi ON qi.status = s.status GROUP BY s.status
""", (sql.QUEUE_ITEMS,))
def status_counts(spark, d):
    return review.status_counts(views.queue_items(spark, d))


@query("""
SELECT s.analysis_state, count(qi.id) AS n FROM (VALUES ('not_analyzed'), ('analyzed'), ('demo')) s(analysis_state)
LEFT JOIN qi ON qi.analysis_state = s.analysis_state GROUP BY s.analysis_state
""", (sql.QUEUE_ITEMS,))
def analysis_state_counts(spark, d):
    return review.analysis_state_counts(views.queue_items(spark, d))


@query("SELECT count(*) AS changed_count FROM qi WHERE label <> original_label", (sql.QUEUE_ITEMS,))
def changed_count(spark, d):
    return review.changed_count(views.queue_items(spark, d))


@query("SELECT id, label, original_label, status FROM qi WHERE label <> original_label OR status <> 'pending'", (sql.QUEUE_ITEMS,))
def reviewed_items(spark, d):
    return review.reviewed_items(views.queue_items(spark, d)).select("id", "label", "original_label", "status").orderBy("id")


@query("""
SELECT sha256('orders' || chr(0) || session) AS session_key, id, label, status FROM qi
WHERE label <> original_label OR status <> 'pending'
""", (sql.QUEUE_ITEMS,))
def session_snapshot(spark, d):
    key = F.sha2(F.concat(F.lit("orders\0"), F.col("session")), 256)
    return review.session_snapshot(views.queue_items(spark, d), key)


@query("""
SELECT id, CASE WHEN session = 'left' THEN label ELSE original_label END AS label,
       CASE WHEN session = 'left' THEN status ELSE 'pending' END AS status
FROM qi
""", (sql.QUEUE_ITEMS,))
def restore_session(spark, d):
    """Fresh items with the saved snapshot of one session applied."""
    items = views.queue_items(spark, d)
    saved = review.session_snapshot(items.filter("session = 'left'"), F.lit("left")).select(
        F.col("id").alias("item_id"), "label", "status")
    fresh = items.withColumns({"label": F.col("original_label"), "status": F.lit("pending")})
    classes = items.select(F.col("original_label").alias("class_name"))
    return review.restore_session(saved, fresh, classes, identity_matches=True).select("id", "label", "status")


@query("""
SELECT id, label, status, 'analyzed' AS analysis_state, x / 2 AS x, y + 1 AS y,
       100 - o_totalprice / 5000.0::DOUBLE AS suspicion_score, original_label AS suggested_label,
       o_totalprice / 500000.0::DOUBLE AS label_confidence, o_totalprice / 600000.0::DOUBLE AS neighbor_support
FROM qi JOIN orders ON o_orderkey = ordinal
""", (sql.QUEUE_ITEMS,))
def apply_analysis(spark, d):
    """A complete, valid batch replaces every item's analysis in one step."""
    items = views.queue_items(spark, d)
    orders = views.table(spark, d, "orders")
    price = F.col("o_totalprice")
    batch = orders.select(
        F.col("o_orderkey").cast("string").alias("id"), (price / 1000.0 / 2).alias("x"),
        (views.epoch_day("o_orderdate") / 10.0 + 1).alias("y"), (100 - price / 5000.0).alias("suspicion_score"),
        F.col("o_orderstatus").alias("suggested_label"), (price / 500000.0).alias("label_confidence"),
        (price / 600000.0).alias("neighbor_support"))
    classes = items.select(F.col("original_label").alias("class_name"))
    merged = review.apply_analysis(items, batch, classes)
    return merged.select("id", "label", "status", "analysis_state", "suggested_label", "x", "y", "suspicion_score",
                         "label_confidence", "neighbor_support")


_BASE = ("SELECT id, label, status, {state} AS analysis_state, round({x}, 6) AS x, round({y}, 6) AS y, "
         "{score} AS suspicion_score, CAST({cleared} AS BIGINT) AS cleared FROM {source}")


@query(_BASE.format(
    state="'not_analyzed'", x="CASE WHEN analysis_state = 'analyzed' THEN ordinal ELSE x END",
    y="CASE WHEN analysis_state = 'analyzed' THEN -ordinal ELSE y END", score="CAST(NULL AS DOUBLE)",
    cleared="analysis_state = 'analyzed'", source="qi"), (sql.QUEUE_ITEMS,))
def clear_analysis(spark, d):
    items = views.queue_items(spark, d)
    return _cleared(review.clear_analysis(items, _start(items)))


def _start(items):
    return items.select("id", F.col("ordinal").cast("double").alias("x"), (-F.col("ordinal")).cast("double").alias("y"))


def _cleared(rows):
    return rows.select("id", "label", "status", "analysis_state", r6("x").alias("x"), r6("y").alias("y"),
                       "suspicion_score", F.col("cleared").cast("long").alias("cleared"))


_STALE = """
snap AS (
  SELECT qi.*, o_custkey AS owner, o_totalprice AS price FROM qi JOIN orders ON o_orderkey = ordinal
),
stale AS (SELECT owner, count(*) AS stale_items FROM snap WHERE price > 499000 GROUP BY owner)"""


@query("""
, j AS (
  SELECT snap.*, stale.owner IS NOT NULL AND analysis_state = 'analyzed' AS cleared
  FROM snap LEFT JOIN stale ON stale.owner = snap.owner
)
SELECT id, label, status, CASE WHEN cleared THEN 'not_analyzed' ELSE analysis_state END AS analysis_state,
       round(CASE WHEN cleared THEN ordinal ELSE x END, 6) AS x, round(CASE WHEN cleared THEN -ordinal ELSE y END, 6) AS y,
       CASE WHEN NOT cleared THEN suspicion_score END AS suspicion_score, CAST(cleared AS BIGINT) AS cleared
FROM j
""", (sql.QUEUE_ITEMS, _STALE))
def stale_invalidation(spark, d):
    """One changed input clears the analysis of its whole session (here: a customer)."""
    items, owned, digests = _owned(spark, d)
    return _cleared(review.invalidate_stale(owned, digests, _start(items)))


@query("SELECT CAST(owner AS VARCHAR) AS session, stale_items FROM stale", (sql.QUEUE_ITEMS, _STALE))
def stale_sessions(spark, d):
    _, owned, digests = _owned(spark, d)
    return review.stale_sessions(owned, digests)


def _owned(spark, d):
    items = views.queue_items(spark, d)
    orders = views.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("ordinal"), F.col("o_custkey").cast("string").alias("session"), "o_totalprice")
    owned = items.drop("session").join(orders, "ordinal").withColumn("preview_sha256", F.sha2("id", 256))
    digests = owned.select("id", F.when(F.col("o_totalprice") <= 499000, F.sha2("id", 256)).otherwise(
        F.lit("changed")).alias("current_sha256"))
    return items, owned.drop("o_totalprice"), digests


@query("""
SELECT id, relative_path, label, suggested_label, suspicion_score, x, y, preview_url, status, original_label,
       label_confidence, neighbor_support, analysis_state
FROM qi
""", (sql.QUEUE_ITEMS,))
def public_projection(spark, d):
    return review.public_projection(views.queue_items(spark, d))


_GAPS = """
kept AS (SELECT * FROM hist WHERE NOT (after_status = 'skipped' AND before_status IS NOT DISTINCT FROM 'pending')),
linked AS (
  SELECT *, lead(before_label) OVER w AS nl, lead(before_status) OVER w AS ns, lead(seq) OVER w AS nseq
  FROM kept WINDOW w AS (PARTITION BY item_id ORDER BY seq)
),
curr AS (SELECT item_id, arg_max(label, seq) AS label, arg_max(status, seq) AS status FROM rl GROUP BY item_id)"""


@query("""
SELECT 'broken_chain' AS rule, item_id AS item, CAST(seq AS VARCHAR) AS detail FROM linked
WHERE nseq IS NOT NULL AND (nl IS DISTINCT FROM after_label OR ns IS DISTINCT FROM after_status)
UNION ALL
SELECT 'end_differs_from_state', l.item_id, CAST(seq AS VARCHAR) FROM linked l JOIN curr USING (item_id)
WHERE nseq IS NULL AND (label <> after_label OR status <> after_status)
""", (sql.REVIEW_LOG, _HISTORY, _GAPS))
def history_chain_check(spark, d):
    """Undo histories from which some commands were lost."""
    log = views.review_log(spark, d)
    lost = (F.col("after_status") == "skipped") & F.coalesce(F.col("before_status") == "pending", F.lit(False))
    return review.history_chain_violations(review.effective_updates(log).filter(~lost), review.current_state(log))


@query("""
, turned AS (
  SELECT -seq AS seq, item_id, lag(after_label) OVER w AS nl, lag(after_status) OVER w AS ns, lag(seq) OVER w AS nseq,
         before_label, before_status FROM kept WINDOW w AS (PARTITION BY item_id ORDER BY seq)
)
SELECT 'broken_chain' AS rule, item_id AS item, CAST(seq AS VARCHAR) AS detail FROM turned
WHERE nseq IS NOT NULL AND (nl IS DISTINCT FROM before_label OR ns IS DISTINCT FROM before_status)
UNION ALL
SELECT 'end_differs_from_state', t.item_id, CAST(t.seq AS VARCHAR) FROM turned t
WHERE nseq IS NULL AND (before_label IS NOT NULL OR before_status IS NOT NULL)
""", (sql.REVIEW_LOG, _HISTORY, _GAPS))
def redo_chain_check(spark, d):
    """The undone log as a redo stack: latest command at the bottom, the state before everything on top."""
    history = review.effective_updates(views.review_log(spark, d))
    lost = (F.col("after_status") == "skipped") & F.coalesce(F.col("before_status") == "pending", F.lit(False))
    stack = history.filter(~lost).withColumn("seq", -F.col("seq"))
    blank = history.select("item_id").distinct().withColumns(
        {"label": F.lit(None).cast("string"), "status": F.lit(None).cast("string")})
    return review.redo_chain_violations(stack, blank)

