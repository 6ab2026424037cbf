"""Queries over plans, gaps, rounds, questions and evaluations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.operators import dedup, joins, planning, questions, tasks
from sievewright.operators import evaluation as E
from sievewright.plans.base import CHUNKS_SQL, chunks, spread, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def md5(c):
    return F.md5(c.cast("binary"))


#: A small plan, as callers write it: mode, count, difficulty, ratio and place.
PLAN = [("multiple_choice", 24012, "easy", 0.25, 0), ("multiple_choice", 24012, "medium", 0.5, 1), ("multiple_choice", 24012, "hard", 0.25, 2), ("qa", 7001, "easy", 0.33, 3), ("qa", 7001, "medium", 0.34, 4), ("qa", 7001, "hard", 0.33, 5)]
#: plan(mode, count, difficulty, ratio, pos) with targets.
APPORTIONED_SQL = "ex AS (SELECT *, round(count * ratio, 9) AS e FROM plan), fl AS (SELECT *, floor(e)::INTEGER AS f, round(e - floor(e), 9) AS part FROM ex), tg AS (SELECT mode, count, difficulty, pos, (f + CASE WHEN row_number() OVER (PARTITION BY mode ORDER BY part DESC, pos) <= count - sum(f) OVER (PARTITION BY mode) THEN 1 ELSE 0 END)::INTEGER AS target FROM fl)"
PLAN_SQL = f"plan(mode, count, difficulty, ratio, pos) AS (VALUES {', '.join(f"('{m}', {c}, '{d}', {r}::DOUBLE, {p})" for m, c, d, r, p in PLAN)}), {APPORTIONED_SQL}"


def _plan(spark):
    return planning.apportioned(spark.createDataFrame(PLAN, "mode string, count int, difficulty string, ratio double, pos int"))


#: Shares of the difficulties, in order.
SHARES = [("easy", 0.25), ("medium", 0.5), ("hard", 0.25)]


SHARED_SQL = f"""plan AS (SELECT source AS mode, count(*)::INTEGER AS count, difficulty, ratio, pos FROM documents, (VALUES {', '.join(f"('{x}', {r}::DOUBLE, {k})" for k, (x, r) in enumerate(SHARES))}) s(difficulty, ratio, pos) GROUP BY source, difficulty, ratio, pos)"""


@query(f"WITH {SHARED_SQL}, {APPORTIONED_SQL} SELECT mode, difficulty, target FROM tg")
def target_expand(spark, d):
    """As many questions for each source as it has documents, dealt to difficulties by their shares."""
    shares = F.array(*(F.struct(F.lit(x).alias("difficulty"), F.lit(r).alias("ratio"), F.lit(k).alias("pos")) for k, (x, r) in enumerate(SHARES)))
    plan = table(spark, d, "documents").groupBy(F.col("source").alias("mode")).agg(F.count("*").cast("int").alias("count")).select("mode", "count", F.inline(shares))
    return planning.apportioned(plan).select("mode", "difficulty", "target")


TOPICS_SQL = "topics AS (SELECT source AS topic, row_number() OVER (ORDER BY source) - 1 AS tpos, count(*) OVER () AS nt FROM (SELECT DISTINCT source FROM documents))"
DEALT_SQL = f"{PLAN_SQL}, {TOPICS_SQL}, tt AS (SELECT topic, mode, difficulty, pos, (target // nt + CASE WHEN tpos < target % nt THEN 1 ELSE 0 END)::INTEGER AS target FROM tg, topics)"


def _dealt(spark, d):
    from sievewright.schemas import key_of

    topics = table(spark, d, "documents").select(F.col("source").alias("topic")).distinct()
    topics = planning.numbered(topics, "topic")
    order = spark.createDataFrame([(m, x, p) for m, _, x, _, p in PLAN], "mode string, difficulty string, pos int")
    t = planning.topic_targets(_plan(spark).select("mode", "difficulty", "target"), topics)
    return t.join(F.broadcast(order), ["mode", "difficulty"]).withColumn("key", key_of(F.col("mode"), F.col("difficulty")))


@query(f"WITH {DEALT_SQL} SELECT topic, mode, difficulty, target FROM tt")
def topic_targets(spark, d):
    return _dealt(spark, d).select("topic", "mode", "difficulty", "target")


KEYS_SQL = "CASE user_id % 6 WHEN 0 THEN 'multiple_choice:easy' WHEN 1 THEN 'multiple_choice:medium' WHEN 2 THEN 'multiple_choice:hard' WHEN 3 THEN 'qa:easy' WHEN 4 THEN 'qa:medium' ELSE 'qa:hard' END"
GAPS_SQL = f"{DEALT_SQL}, done AS (SELECT 'src' || (event_id % 20) AS topic, {KEYS_SQL} AS key, count(*) AS n FROM events GROUP BY ALL), gaps AS (SELECT t.topic, t.mode || ':' || t.difficulty AS key, pos, target, coalesce(n, 0)::BIGINT AS completed, greatest(0, target - coalesce(n, 0))::BIGINT AS remaining FROM tt t LEFT JOIN done ON done.topic = t.topic AND done.key = t.mode || ':' || t.difficulty)"


def _gaps(spark, d):
    keys = F.array(*[F.lit(f"{m}:{x}") for m, _, x, _, _ in PLAN])
    done = table(spark, d, "events").select(F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string")).alias("topic"), F.get(keys, (F.col("user_id") % 6).cast("int")).alias("key"))
    return planning.remaining(_dealt(spark, d).select("topic", "key", "target", "pos"), done.groupBy("topic", "key").agg(F.count("*").alias("n")))


@query(f"WITH {GAPS_SQL} SELECT topic, key, target, completed, remaining FROM gaps")
def remaining_gaps(spark, d):
    return _gaps(spark, d).select("topic", "key", "target", "completed", "remaining")


@query(f"WITH {GAPS_SQL} SELECT key, sum(completed)::BIGINT AS completed, sum(remaining)::BIGINT AS remaining, CASE WHEN sum(remaining) > 0 THEN 'partial' ELSE 'completed' END AS status FROM gaps GROUP BY key")
def report_totals(spark, d):
    return planning.report_totals(_gaps(spark, d))


@query(f"WITH {GAPS_SQL} SELECT topic, round(avg(completed::DOUBLE / greatest(target, 1)), 6) AS coverage FROM gaps GROUP BY topic")
def coverage(spark, d):
    return planning.coverage(_gaps(spark, d)).withColumn("coverage", F.round("coverage", 6))


@query(f"WITH {GAPS_SQL} SELECT topic, key, target, completed, remaining, round(CASE WHEN target > 0 THEN completed::DOUBLE / target ELSE 1.0 END, 6) AS progress FROM gaps")
def coverage_by_key(spark, d):
    return planning.coverage_by_key(_gaps(spark, d)).select("topic", "key", "target", "completed", "remaining", F.round("progress", 6).alias("progress"))


HARD = "CASE WHEN key LIKE '%hard%' THEN 1 WHEN key LIKE '%medium%' THEN 2 WHEN key LIKE '%easy%' THEN 3 ELSE 4 END"
MAIN_SQL = f"{GAPS_SQL}, main AS (SELECT topic, key, remaining FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY {HARD}, remaining DESC, pos, key) AS p FROM gaps WHERE remaining > 0) WHERE p = 1)"


@query(f"WITH {MAIN_SQL} SELECT * FROM main")
def main_gap(spark, d):
    return planning.main_gap(_gaps(spark, d))


@query(f"WITH {GAPS_SQL} SELECT key, sum(remaining)::BIGINT AS remaining, string_agg(topic, ',' ORDER BY topic) AS topics FROM gaps WHERE remaining > 0 AND topic IN (SELECT topic FROM gaps GROUP BY topic HAVING count(*) FILTER (remaining > 0) > 1) GROUP BY key ORDER BY sum(remaining) DESC, {HARD}, key LIMIT 1")
def global_gap(spark, d):
    g = _gaps(spark, d)
    deferred = g.groupBy("topic").agg(F.count_if(F.col("remaining") > 0).alias("open")).where("open > 1")
    return planning.global_gap(g, deferred)


@query(f"WITH {GAPS_SQL} SELECT topic, bool_and(completed >= target) AS is_complete, bool_or(remaining > 0) AS has_gap FROM gaps GROUP BY topic")
def topic_completion(spark, d):
    return planning.completion(_gaps(spark, d))


@query(f"WITH {MAIN_SQL} SELECT topic, (CASE WHEN remaining <= 5 THEN remaining + 1 ELSE remaining + 2 END)::BIGINT AS least, (CASE WHEN remaining <= 2 THEN remaining + 2 WHEN remaining <= 5 THEN remaining + 3 ELSE remaining + 4 END)::BIGINT AS target FROM main")
def batch_request(spark, d):
    low, high = planning.request_size(F.col("remaining"))
    return planning.main_gap(_gaps(spark, d)).select("topic", low.alias("least"), high.alias("target"))


@query(f"WITH {MAIN_SQL} SELECT topic, CASE WHEN key LIKE '%hard' AND remaining % 2 = 0 THEN 'expand_retrieval' WHEN key LIKE '%hard' THEN 'increase_multi_chunk' ELSE 'continue_generation' END AS action, 'continue_generation' || CASE WHEN key LIKE '%hard' THEN ',expand_retrieval,increase_multi_chunk,hardening' ELSE '' END || CASE WHEN remaining % 4 + 1 >= 3 THEN ',defer_topic' ELSE '' END AS allowed FROM main")
def next_step(spark, d):
    hard = F.col("key").endswith("hard")
    return planning.main_gap(_gaps(spark, d)).select("topic", planning.next_step(hard, F.col("remaining") % 2 == 1).alias("action"), F.array_join(planning.allowed_actions(hard, F.col("remaining") % 4, F.lit(3)), ",").alias("allowed"))


@query(f"""WITH {MAIN_SQL}, o AS (SELECT topic, key, remaining, remaining % 3 AS round FROM main), p AS (SELECT *, remaining = 0 OR round >= 2 AS done, split_part(key, ':', 2) AS dif FROM o)
SELECT topic, CASE WHEN done THEN 'finish_topic' ELSE 'generate_questions' END AS next_action, CASE WHEN NOT done THEN split_part(key, ':', 1) END AS target_mode, CASE WHEN NOT done THEN dif END AS target_difficulty,
 CASE WHEN NOT done THEN CASE WHEN remaining <= 2 THEN remaining + 2 WHEN remaining <= 5 THEN remaining + 3 ELSE remaining + 4 END END::BIGINT AS requested_questions, CASE WHEN NOT done THEN CASE WHEN round > 0 THEN 'gap_driven' ELSE 'broad_exploration' END END AS strategy,
 CASE WHEN NOT done THEN least(5, remaining + 2) END::BIGINT AS num_evidence, CASE WHEN NOT done THEN dif = 'hard' AND remaining % 2 = 1 END AS prefer_multi_chunk FROM p""")
def rule_policy(spark, d):
    o = planning.main_gap(_gaps(spark, d)).select("topic", (F.col("remaining") % 3).alias("round"), F.lit(2).alias("max_rounds"), F.col("remaining").alias("gap_remaining"), F.col("key").alias("primary_gap"), (F.col("remaining") % 2).alias("multi_efficiency"), F.lit(0.5).alias("single_efficiency"))
    return planning.rule_policy(o)


@query("""WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'generate_questions' WHEN 1 THEN 'finish_topic' WHEN 2 THEN 'sing' END AS a, CASE WHEN event_id % 9 = 0 THEN '' ELSE 'src' || user_id END AS t, CASE WHEN event_id % 7 = 0 THEN 'qa-hard' ELSE 'qa:hard' END AS g, event_id % 25 - 1 AS n FROM events)
SELECT event_id, concat_ws(',', CASE WHEN a IS NULL OR a = 'sing' THEN 'error:unknown_action' END, CASE WHEN t = '' THEN 'error:missing_topic' END, CASE WHEN g = 'qa-hard' THEN 'warning:gap_format' END, CASE WHEN n > 20 THEN 'warning:too_many' END, CASE WHEN n <= 0 THEN 'warning:too_few' END) AS issues FROM e""")
def decision_issues(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select(
        "event_id", F.when(i % 4 == 0, "generate_questions").when(i % 4 == 1, "finish_topic").when(i % 4 == 2, "sing").alias("next_action"), F.when(i % 9 == 0, "").otherwise(F.concat(F.lit("src"), F.col("user_id").cast("string"))).alias("topic"),
        F.when(i % 7 == 0, "qa-hard").otherwise("qa:hard").alias("target_gap"), (i % 25 - 1).alias("requested_questions"),
    )
    return planning.decision_issues(e).select("event_id", F.array_join("issues", ",").alias("issues"))


@query("SELECT user_id, round(list_reduce(list_concat([0.0::DOUBLE], list(value::DOUBLE ORDER BY event_id)), lambda a, v: 0.3::DOUBLE * v + 0.7::DOUBLE * a), 6) AS ewma FROM events GROUP BY user_id")
def ewma(spark, d):
    return planning.ewma(table(spark, d, "events"), "user_id", "event_id", "value").withColumn("ewma", F.round("ewma", 6))


@query("""WITH b AS (SELECT user_id, event_id, (event_id % 3)::DOUBLE AS s, (event_id % 2)::DOUBLE AS m, floor(value)::DOUBLE AS c, (event_id % 4)::DOUBLE AS v FROM events),
r AS (SELECT user_id, event_id, 'single' AS kind, 'candidate_rate' AS measure, '' AS label, c / s AS x FROM b WHERE s > 0 UNION ALL SELECT user_id, event_id, 'single', 'valid_rate', '', v / s FROM b WHERE s > 0
UNION ALL SELECT user_id, event_id, 'multi', 'candidate_rate', '', c / (s + m) FROM b WHERE m > 0 UNION ALL SELECT user_id, event_id, 'multi', 'valid_rate', '', v / (s + m) FROM b WHERE m > 0
UNION ALL SELECT user_id, event_id, 'single', 'mode', 'qa', 1 / v FROM b WHERE s > 0 AND v > 0 UNION ALL SELECT user_id, event_id, 'single', 'mode', 'multiple_choice', (v - 1) / v FROM b WHERE s > 0 AND v > 1
UNION ALL SELECT user_id, event_id, 'multi', 'difficulty', 'hard', s / v FROM b WHERE m > 0 AND v > 0)
SELECT user_id, kind, measure, label, round(list_reduce(list_concat([0.0::DOUBLE], list(x ORDER BY event_id)), lambda a, y: 0.3::DOUBLE * y + 0.7::DOUBLE * a), 6) AS value FROM r GROUP BY user_id, kind, measure, label""")
def evidence_stats(spark, d):
    i, v = F.col("event_id"), F.col("event_id") % 4
    modes = F.when(v > 1, F.create_map(F.lit("qa"), F.lit(1).cast("long"), F.lit("multiple_choice"), v - 1)).otherwise(F.create_map(F.lit("qa"), F.lit(1).cast("long")))
    none = F.lit(None).cast("map<string,long>")
    b = table(spark, d, "events").select(
        "user_id", "event_id", (i % 3).alias("used_single_chunks"), (i % 2).alias("used_multi_chunks"), F.floor("value").alias("candidate_count"), v.alias("valid_count"),
        modes.alias("single_mode_counts"), none.alias("single_difficulty_counts"), none.alias("multi_mode_counts"), F.create_map(F.lit("hard"), i % 3).alias("multi_difficulty_counts"),
    )
    return planning.evidence_stats(b, "user_id", "event_id").withColumn("value", F.round("value", 6))


@query("""WITH c AS (SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT *, n AS gap, sum(n) OVER w / 10000.0::DOUBLE AS cov, row_number() OVER w AS i FROM c WINDOW w AS (PARTITION BY event_type ORDER BY day)),
l AS (SELECT *, lag(gap, 2) OVER w AS g2, lag(cov, 2) OVER w AS c2, lag(gap) OVER w AS g1 FROM g WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, day, coalesce(g2 - gap < 1 AND cov - c2 < 0.05, false) AS is_stuck, coalesce(max(CASE WHEN g1 - gap >= 1 THEN i END) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING), 0)::INTEGER AS last_progress FROM l""")
def loop_guard(spark, d):
    c = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("gap"))
    c = c.withColumn("cov", F.sum("gap").over(Window.partitionBy("event_type").orderBy("day")) / F.lit(10000.0))
    return planning.loop_guard(c, "event_type", "day", "gap", "cov").select("event_type", "day", "is_stuck", "last_progress")


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT user_id, coalesce(min(n) FILTER (NOT value < 60) - 1, count(*))::BIGINT AS streak FROM r WHERE n <= 5 GROUP BY user_id""")
def failure_streak(spark, d):
    return planning.failure_streak(table(spark, d, "events"), "user_id", "event_id", F.col("value") < 60)


ROUND_SQL = """r AS (SELECT user_id::VARCHAR AS topic, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS round, value AS gap, (event_id % 50)::DOUBLE / 100 AS coverage, value < 60 AS failed, value FROM events),
l AS (SELECT *, lag(gap) OVER w AS g1, lag(gap, 2) OVER w AS g2, lag(coverage, 2) OVER w AS c2, list(value::DOUBLE) OVER (w ROWS UNBOUNDED PRECEDING) AS vs, max(CASE WHEN NOT failed THEN round END) OVER (w ROWS UNBOUNDED PRECEDING) AS good FROM r WINDOW w AS (PARTITION BY topic ORDER BY round))"""


@query(f"""WITH {ROUND_SQL} SELECT topic, round, coalesce(g2 - gap < 1 AND coverage - c2 < 0.05, false) AS is_stuck, coalesce(max(CASE WHEN g1 - gap >= 1 THEN round END) OVER (PARTITION BY topic ORDER BY round ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS last_progress,
 least(round - coalesce(good, 0), 5)::BIGINT AS streak, round(list_reduce(list_concat([0.0::DOUBLE], vs), lambda a, v: 0.3::DOUBLE * v + 0.7::DOUBLE * a), 6) AS ewma FROM l""")
def round_state(spark, d):
    """The events of each user as rounds, written to files in no order, folded by a stream a few files at a time."""
    from sievewright.session import shared_folder
    from sievewright.streaming import round_state as S

    place = Window.partitionBy("user_id").orderBy("event_id")
    log = table(spark, d, "events").select(F.col("user_id").alias("topic"), F.row_number().over(place).alias("round"), F.col("value").alias("gap"), (F.col("event_id") % 50 / F.lit(100.0)).alias("coverage"), (F.col("value") < 60).alias("failed"), "value", F.col("ts").cast("timestamp").alias("at"), "event_id")
    folder = shared_folder(spark, "round-state")
    log.repartition(6, F.hash("event_id")).write.parquet(f"{folder}/log")
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(2 * spark.sparkContext.defaultParallelism))  # a store each
    stream = own.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/log")
    S.started(S.round_state(stream), f"{folder}/states", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(S.OUT).parquet(f"{folder}/states").withColumn("ewma", F.round("ewma", 6))


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT user_id, event_id FROM r WHERE n <= 5")
def history_tail(spark, d):
    return planning.history_tail(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("""WITH r AS (SELECT user_id, event_id % 2 = 0 AS p, (value::BIGINT) % 4 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM (SELECT user_id, event_id, floor(value) AS value FROM events)) SELECT user_id, sum(CASE WHEN p THEN v ELSE 0 END)::BIGINT AS multi, sum(CASE WHEN NOT p THEN v ELSE 0 END)::BIGINT AS single, sum(CASE WHEN p THEN v ELSE 0 END) > sum(CASE WHEN NOT p THEN v ELSE 0 END) * 1.5 AS multi_better FROM r WHERE n <= 5 GROUP BY user_id""")
def success_by_kind(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 2 == 0).alias("prefer_multi"), (F.floor("value").cast("long") % 4).alias("valid_count"))
    return planning.success_by_kind(e, "user_id", "event_id")


def _results(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "source", "lang"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").withColumn("is_correct", F.col("quality") == 1)


RES = "res AS (SELECT d.doc_id, source, lang, quality, toxic FROM documents d JOIN labels l USING (doc_id))"


@query(f"WITH {RES} SELECT source, count(*) AS n, sum(quality)::BIGINT AS correct, round(avg(quality), 3) AS accuracy FROM res GROUP BY source")
def accuracy_by_category(spark, d):
    return E.accuracy(_results(spark, d), "source")


@query(f"WITH {RES} SELECT (doc_id % 3)::INTEGER AS iteration, source, count(*) AS n, sum(quality)::BIGINT AS correct, round(avg(quality), 3) AS accuracy FROM res GROUP BY ALL")
def accuracy_over_history(spark, d):
    r = _results(spark, d)
    return E.accuracy_over_history([r.where(F.col("doc_id") % 3 == i) for i in range(3)], "source")


@query(f"WITH {RES}, p AS (SELECT source, quality, doc_id, ((row_number() OVER (PARTITION BY source, quality ORDER BY doc_id) - 1) // 50)::INTEGER AS page FROM res) SELECT source, quality, page, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS items FROM p GROUP BY ALL")
def correct_incorrect_lists(spark, d):
    return E.listed_by_outcome(_results(spark, d), "source", "quality", "doc_id", page=50)


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 'qa' ELSE 'multiple_choice' END AS mode, event_type AS difficulty, count(*) FILTER (NOT value > 50)::BIGINT AS single, count(*) FILTER (value > 50)::BIGINT AS multi FROM events GROUP BY ALL")
def batch_counts(spark, d):
    ids = F.when(F.col("value") > 50, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    return E.batch_counts(table(spark, d, "events").select(F.when(F.col("event_id") % 2 == 0, "qa").otherwise("multiple_choice").alias("mode"), F.col("event_type").alias("difficulty"), ids.alias("chunk_ids")))


@query(f"WITH {RES}, x AS (SELECT quality, unnest(CASE WHEN toxic = 1 THEN [lang, 'toxic'] WHEN lang = 'de' THEN ['uncategorized'] ELSE [lang] END) AS label FROM res) SELECT label, count(*) AS n, sum(quality)::BIGINT AS correct, round(avg(quality), 3) AS accuracy FROM x GROUP BY label")
def capability_accuracy(spark, d):
    some = F.when(F.col("toxic") == 1, F.array("lang", F.lit("toxic"))).when(F.col("lang") == "de", F.array().cast("array<string>")).otherwise(F.array("lang"))
    return E.capability_accuracy(_results(spark, d).withColumn("labels", some), "labels")


@query("SELECT lang, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY lang")
def distributions(spark, d):
    return E.distribution(table(spark, d, "documents"), "lang").withColumn("share", F.round("share", 6))


@query(f"WITH {RES} SELECT source, count(*) AS generated, count(*) FILTER (quality = 1) AS validated, count(*) FILTER (quality <> 1) AS rejected, count(*) FILTER (toxic = 1) AS failures FROM res GROUP BY source")
def report_counts(spark, d):
    return E.report_counts(_results(spark, d), "source", F.col("quality") == 1, F.col("toxic") == 1)


@query(f"WITH {RES} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN (lower(trim(lang)) = lower(trim('EN ')))::INTEGER ELSE quality END AS score FROM res")
def score_auto(spark, d):
    r = _results(spark, d)
    mode = F.when(F.col("doc_id") % 2 == 0, "multiple_choice").otherwise("qa")
    return r.select("doc_id", E.score_auto(mode, F.col("lang"), F.lit("EN "), F.when(F.col("quality") == 1, " True ").otherwise("false")).alias("score"))


METRICS_SQL = f"""WITH {RES}, a AS (SELECT doc_id AS q, 'm' || m AS model, CASE WHEN (doc_id + m) % 3 = 0 OR quality = 1 THEN 'true' ELSE 'false' END AS v, toxic, (doc_id % 10 + m) / 10.0::DOUBLE AS s FROM res, (VALUES (0), (1)) t(m)), f AS (SELECT q, count(DISTINCT v) > 1 AS differ FROM a GROUP BY q)
SELECT model, count(*) AS n, round(avg((v = 'true')::INTEGER), 6) AS accuracy, round(avg(toxic), 6) AS refusal_rate, round(avg(s), 6) AS mean_judge_score, round(avg(differ::INTEGER), 6) AS disagreement_rate FROM a JOIN f USING (q) GROUP BY model"""


@query(METRICS_SQL)
def model_metrics(spark, d):
    r = _results(spark, d)
    answers = {f"m{m}": r.select(F.col("doc_id").alias("question_id"), F.when(((F.col("doc_id") + m) % 3 == 0) | F.col("is_correct"), "true").otherwise("false").alias("verdict"), (F.col("toxic") == 1).alias("refused"), ((F.col("doc_id") % 10 + m) / F.lit(10.0)).alias("judge_score")) for m in (0, 1)}
    return E.model_metrics(dedup.union_models(answers))


WILSON = "(correct::DOUBLE / n {0} 1.96::DOUBLE * 1.96::DOUBLE / (2 * n::DOUBLE)"


TREE_SQL = f"""{RES}, leaf AS (SELECT lang, lang || '/' || source AS b, lang || '/' || source || '/' || CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE 'y' END AS c, lang || '/' || source || '/' || CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE 'y' END || '/' || (doc_id % 2) AS category, toxic FROM res WHERE lang IS NOT NULL AND source IS NOT NULL),
edges AS (SELECT DISTINCT lang AS node, 'all' AS parent FROM leaf UNION SELECT b, lang FROM leaf UNION SELECT c, b FROM leaf UNION SELECT category, c FROM leaf),
up AS (SELECT node, parent AS ancestor FROM edges UNION SELECT u.node, e.parent FROM up u JOIN edges e ON e.node = u.ancestor),
own AS (SELECT category, count(*) AS n, sum((toxic = 1)::INT) AS correct FROM leaf GROUP BY category), nodes AS (SELECT node FROM edges UNION SELECT parent FROM edges),
pairs AS (SELECT node, ancestor FROM up UNION ALL SELECT node, node FROM nodes), sums AS (SELECT ancestor AS node, sum(n)::BIGINT AS n, sum(correct)::BIGINT AS correct FROM pairs JOIN own ON own.category = pairs.node GROUP BY ancestor),
bounds AS (SELECT *, correct::DOUBLE / n AS p FROM sums), scored AS (SELECT node, n, correct, (p + 3.8416::DOUBLE / (2 * n) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n) AS high FROM bounds)"""


def _tree(spark, d):
    """Labelled documents as results in a tree of five levels: all, language, source, and two of the id."""
    third = F.when(F.col("doc_id") % 3 == 0, "x").otherwise("y")
    path = lambda *c: F.concat_ws("/", *c)
    r = _results(spark, d).where("lang IS NOT NULL AND source IS NOT NULL").select("lang", path("lang", "source").alias("b"), path("lang", "source", third).alias("c"), path("lang", "source", third, (F.col("doc_id") % 2).cast("string")).alias("category"), (F.col("toxic") == 1).alias("is_correct"))
    steps = [("lang", F.lit("all")), ("b", F.col("lang")), ("c", F.col("b")), ("category", F.col("c"))]
    edges = None
    for node, parent in steps:
        part = r.select(F.col(node).alias("category"), parent.alias("parent_category")).distinct()
        edges = part if edges is None else edges.unionByName(part)
    return edges, r.select("category", "is_correct")


@query(f"WITH RECURSIVE {TREE_SQL} SELECT node, n, correct, round(high, 6) AS high FROM scored")
def capability_tree(spark, d):
    """Share of toxic documents in every subtree, with Wilson's upper bound."""
    from sievewright.operators import trees

    return trees.rolled_up(*_tree(spark, d)).select("node", "n", "correct", F.round("high", 6).alias("high"))


@query(f"WITH RECURSIVE {TREE_SQL}, f AS (SELECT * FROM scored WHERE high < 0.3) SELECT node, n, correct, round(high, 6) AS high FROM f WHERE node NOT IN (SELECT ancestor FROM up JOIN f USING (node))")
def lowest_failing(spark, d):
    """The lowest subtrees whose share is below 0.3 for sure."""
    from sievewright.operators import trees

    edges, results = _tree(spark, d)
    return trees.lowest_failing(edges, trees.rolled_up(edges, results), 0.3).select("node", "n", "correct", F.round("high", 6).alias("high"))


@query(f"""WITH {RES}, g AS (SELECT lang, source, count(*) AS n, sum(toxic)::BIGINT AS correct FROM res GROUP BY ROLLUP (lang, source)), w AS (SELECT *, correct::DOUBLE / n AS p FROM g WHERE lang IS NOT NULL),
b AS (SELECT *, (p + 3.8416::DOUBLE / (2 * n) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n) AS high, (p + 3.8416::DOUBLE / (2 * n) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n) AS low FROM w)
SELECT lang, source, n, correct, round(low, 6) + 0.0 AS low, round(high, 6) AS high FROM b WHERE high < 0.3""")
def weaknesses(spark, d):
    r = _results(spark, d).withColumn("toxic", F.col("toxic") == 1)
    return E.weaknesses(r, "lang", "source", 0.3, "toxic").select("lang", "source", "n", "correct", (F.round("low", 6) + F.lit(0.0)).alias("low"), F.round("high", 6).alias("high"))


@query("SELECT d.doc_id AS id, (lower(trim(d.lang)) = lower(trim(CASE WHEN l.quality = 1 THEN ' EN' ELSE 'fr' END)))::INTEGER AS match FROM documents d JOIN labels l USING (doc_id)")
def gold_pred_join(spark, d):
    gold = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("lang").alias("gold_answer"))
    pred = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, " EN").otherwise("fr").alias("test_answer"))
    return E.matched_answers(gold, pred).select("id", "match")


@query("SELECT doc_id AS id, (lower(trim(lang)) = lower(trim('  En')))::INTEGER AS match FROM documents")
def exact_match(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.exact_match(F.col("lang"), F.lit("  En")).alias("match"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)) WHERE n = 1")
def anti_seen(spark, d):
    return joins.unseen_first(table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "source", "doc_id").select("doc_id")


def _citations(spark, d):
    """Each item cites the first, third and ninth chunk of a document; short documents lack some of them."""
    b, chunk = table(spark, d, "benchmark"), F.array(*[F.lit(x) for x in CITED])
    return b.select("item_id", F.explode(F.transform(chunk, lambda c: F.concat((F.col("item_id") * 7).cast("string"), c))).alias("chunk_id"), "text")


CITED = ("::chunk_0000", "::chunk_0002", "::chunk_0008")
CITES = f"cites AS (SELECT item_id, (item_id * 7)::VARCHAR || k AS chunk_id, text FROM benchmark, (VALUES {', '.join(f"('{c}')" for c in CITED)}) t(k))"
W = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"


@query(f"WITH {CHUNKS_SQL}, {CITES}, o AS (SELECT item_id, CASE WHEN len({W.format('x.text')}) > 0 THEN len(list_intersect({W.format('x.text')}, {W.format('c.text')}))::DOUBLE / len({W.format('x.text')}) ELSE 0.0 END AS v FROM cites x JOIN chunks c USING (chunk_id)) SELECT item_id, round(max(v), 6) AS best_overlap FROM o GROUP BY item_id")
def citation_grounding(spark, d):
    return joins.citation_grounding(_citations(spark, d), chunks(spark, d)).groupBy("item_id").agg(F.round(F.max("overlap"), 6).alias("best_overlap"))


@query(f"WITH {CHUNKS_SQL}, {CITES} SELECT item_id, chunk_id FROM cites WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks)")
def dangling_citations(spark, d):
    return joins.dangling_citations(_citations(spark, d), chunks(spark, d)).select("item_id", "chunk_id")


def _said(spark, d):
    i, t = F.col("doc_id"), F.col("text")
    return table(spark, d, "documents").select("doc_id", F.when(i % 3 == 0, F.concat(F.lit("because <a>x</a> ## no ## "), F.when(i % 2 == 0, " true ").otherwise("false"))).when(i % 3 == 1, F.concat(F.lit("<a> open "), t)).otherwise(F.concat(F.lit("doc_chunk_"), i.cast("string"))).alias("said"))


SAID = "said AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'because <a>x</a> ## no ## ' || CASE WHEN doc_id % 2 = 0 THEN ' true ' ELSE 'false' END WHEN 1 THEN '<a> open ' || text ELSE 'doc_chunk_' || doc_id END AS said FROM documents)"


@query(f"WITH {SAID} SELECT doc_id AS id, trim(string_split(said, '##')[-1]) AS value FROM said")
def verdict_parse(spark, d):
    return _said(spark, d).select(F.col("doc_id").alias("id"), T.verdict(F.col("said")).alias("value"))


@query(f"WITH {SAID} SELECT doc_id AS id, trim(CASE WHEN regexp_matches(said, '(?s)<a>.*?</a>') THEN regexp_extract(said, '(?s)<a>(.*?)</a>', 1) ELSE regexp_extract(said, '(?s)<a>(.*)', 1) END, E' \\t\\r\\n') AS value FROM said")
def tag_extract(spark, d):
    return _said(spark, d).select(F.col("doc_id").alias("id"), T.xml_tag(F.col("said"), "a").alias("value"))


@query(f"WITH {SAID} SELECT doc_id AS id, coalesce(try_cast(coalesce(nullif(regexp_extract(said, 'chunk_(\\d+)', 1), ''), nullif(regexp_extract(said, '(\\d+)$', 1), '')) AS INTEGER), 0) AS value FROM said")
def chunk_index(spark, d):
    return _said(spark, d).select(F.col("doc_id").alias("id"), T.chunk_number(F.col("said")).alias("value"))


def _questions(spark, d):
    """A question for each document, spoilt in one way by doc_id % 11."""
    i, c = F.col("doc_id"), F.col("doc_id") % 11
    text = F.regexp_replace("text", r"\s+", " ")
    options = F.array(*[F.lit(x) for x in ("one", "two", "(C) three", "four")])
    return table(spark, d, "documents").select(
        "doc_id", F.when(c == 0, "").when(c == 6, "Why?").otherwise(F.concat(F.lit("What follows from: "), text)).alias("question"),
        F.when(c == 1, F.lit(None)).when(c == 7, "no").when(c == 8, "E").when(c == 9, "b").otherwise(F.concat(F.lit("It says: "), text)).alias("answer"),
        F.when(c == 2, "riddle").when(c.isin(5, 8, 9), "multiple_choice").otherwise("qa").alias("question_mode"),
        F.when(c == 3, "12").when(i % 2 == 0, (i % 10 + 1).cast("string")).otherwise("Hard").alias("estimated_difficulty"),
        F.when(c == 5, F.slice(options, 1, 3)).otherwise(options).alias("choices"), F.when(c == 4, F.array().cast("array<string>")).otherwise(F.array("lang")).alias("citations"),
        F.when(c == 10, "guess").otherwise("Factual").alias("question_type"),
    )


QS = r"""qs AS (SELECT doc_id, doc_id % 11 AS c, CASE doc_id % 11 WHEN 0 THEN '' WHEN 6 THEN 'Why?' ELSE 'What follows from: ' || regexp_replace(text, '\s+', ' ', 'g') END AS question,
 CASE doc_id % 11 WHEN 1 THEN NULL WHEN 7 THEN 'no' WHEN 8 THEN 'E' WHEN 9 THEN 'b' ELSE 'It says: ' || regexp_replace(text, '\s+', ' ', 'g') END AS answer, CASE WHEN doc_id % 11 = 2 THEN 'riddle' WHEN doc_id % 11 IN (5, 8, 9) THEN 'multiple_choice' ELSE 'qa' END AS mode,
 CASE WHEN doc_id % 11 = 3 THEN '12' WHEN doc_id % 2 = 0 THEN (doc_id % 10 + 1)::VARCHAR ELSE 'Hard' END AS dif FROM documents)"""


@query(f"WITH {QS} SELECT doc_id AS id, CASE c WHEN 0 THEN 'missing_question' WHEN 1 THEN 'missing_answer' WHEN 2 THEN 'bad_mode' WHEN 3 THEN 'bad_difficulty' WHEN 4 THEN 'no_citations' WHEN 5 THEN 'bad_choices' WHEN 6 THEN 'short_question' WHEN 7 THEN 'short_answer' WHEN 8 THEN 'bad_choice_answer' WHEN 10 THEN 'bad_type' END AS reason FROM qs")
def question_filter(spark, d):
    return _questions(spark, d).select(F.col("doc_id").alias("id"), questions.reject_reason().alias("reason"))


@query(f"WITH {QS}, n AS (SELECT doc_id AS id, mode AS question_mode, CASE WHEN try_cast(dif AS INTEGER) <= 3 THEN 'easy' WHEN try_cast(dif AS INTEGER) <= 7 THEN 'medium' WHEN try_cast(dif AS INTEGER) IS NOT NULL THEN 'hard' ELSE lower(dif) END AS estimated_difficulty, CASE WHEN mode <> 'multiple_choice' THEN 'one|two|(C) three|four' WHEN c = 5 THEN '(A) one|(B) two|(C) three' ELSE '(A) one|(B) two|(C) three|(D) four' END AS choices, CASE WHEN mode = 'multiple_choice' AND len(answer) = 1 THEN upper(answer) ELSE answer END AS answer FROM qs) SELECT * FROM n")
def normalize_mcq(spark, d):
    return questions.normalized(_questions(spark, d)).select(F.col("doc_id").alias("id"), "question_mode", "estimated_difficulty", F.array_join("choices", "|").alias("choices"), "answer")


@query(rf"""WITH {CHUNKS_SQL}, {QS}, q AS (SELECT doc_id, question, answer, CASE WHEN doc_id % 5 = 0 THEN 'none' ELSE doc_id || '::chunk_0000' END AS chunk_id FROM qs), f AS (SELECT *, min(doc_id) OVER (PARTITION BY regexp_replace(lower(trim(question)), '\s+', ' ', 'g')) < doc_id AS dup FROM q),
r AS (SELECT doc_id, list_filter([CASE WHEN coalesce(question, '') = '' THEN 'empty_question' END, CASE WHEN coalesce(answer, '') = '' THEN 'empty_answer' END, CASE WHEN coalesce(question, '') <> '' AND dup THEN 'duplicate' END, CASE WHEN chunk_id NOT IN (SELECT chunk_id FROM chunks) THEN 'missing_evidence' END], lambda x: x IS NOT NULL) AS x FROM f)
SELECT doc_id AS id, array_to_string(x, ',') AS reasons, CASE WHEN len(x) = 0 THEN 'accepted' WHEN len(list_filter(x, lambda y: y NOT IN ('missing_evidence', 'empty_answer'))) = 0 THEN 'repairable' ELSE 'rejected' END AS status FROM r""")
def validator_reasons(spark, d):
    q = _questions(spark, d).select(F.col("doc_id").alias("question_id"), "question", "answer", F.when(F.col("doc_id") % 5 == 0, "none").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit("::chunk_0000"))).alias("chunk_id"))
    return questions.validator_reasons(q, chunks(spark, d)).select(F.col("question_id").alias("id"), F.array_join("reasons", ",").alias("reasons"), "status")


#: Answers made of whole documents, in the shapes that models give them: by doc_id % 12.
SHAPES = 12


def _answers(spark, d):
    i, text = F.col("doc_id"), F.col("text")

    def item(k: int):
        return F.struct(F.concat(F.lit(f"What is in part {k} of "), i.cast("string"), F.lit("?")).alias("question"), text.alias("answer"), F.lit(k).alias("estimated_difficulty"), F.array(F.struct(F.lit(f"c{k}").alias("chunk_id"), text.alias("text"))).alias("citations"))

    one, two, both = F.to_json(item(1)), F.to_json(item(2)), F.to_json(F.array(item(1), item(2)))
    glued = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    shapes = [
        both, glued("Here they are.\n<output_json>\n", both, "\n</output_json>\nDone."), glued("```json\n", both, "\n``` as asked"), glued("<output_json>```json\n", both, "\n```</output_json>"),
        glued('{"questions": ', both, "}"), glued('{"items": "none", "results": ', both, "}"), one, glued("See [1] and {this}: ", both, " [end of answer]"),
        F.substr(both, F.lit(1), F.length(both) - 3), text, glued("First ", one, " and then ", two, "."), glued("[3, ", one, ', null, "x", ', two, "]"),
    ]
    said = shapes[-1]
    for k, shape in reversed(list(enumerate(shapes[:-1]))):
        said = F.when(i % SHAPES == k, shape).otherwise(said)
    return spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", said.alias("said"))


ITEM_SQL = """json_object('question', 'What is in part {0} of ' || doc_id || '?', 'answer', text, 'estimated_difficulty', {0}, 'citations', json_array(json_object('chunk_id', 'c{0}', 'text', text)))::VARCHAR"""
ANSWERS_SQL = f"""items AS (SELECT doc_id, text, {ITEM_SQL.format(1)} AS one, {ITEM_SQL.format(2)} AS two FROM documents), pairs AS (SELECT *, '[' || one || ',' || two || ']' AS duo FROM items),
answers AS (SELECT doc_id, CASE doc_id % {SHAPES} WHEN 0 THEN duo WHEN 1 THEN E'Here they are.\\n<output_json>\\n' || duo || E'\\n</output_json>\\nDone.' WHEN 2 THEN E'```json\\n' || duo || E'\\n``` as asked' WHEN 3 THEN E'<output_json>```json\\n' || duo || E'\\n```</output_json>'
 WHEN 4 THEN '{{"questions": ' || duo || '}}' WHEN 5 THEN '{{"items": "none", "results": ' || duo || '}}' WHEN 6 THEN one WHEN 7 THEN 'See [1] and {{this}}: ' || duo || ' [end of answer]'
 WHEN 8 THEN left(duo, length(duo) - 3) WHEN 9 THEN text WHEN 10 THEN 'First ' || one || ' and then ' || two || '.' ELSE '[3, ' || one || ', null, "x", ' || two || ']' END AS said FROM pairs)"""
#: The same arms by DuckDB's JSON functions: the first valid candidate; else the widest stretch from [{{ to }}]; else every object that a pattern cuts out.
PARSED_SQL = r"""cands AS (SELECT doc_id, said, list_filter([said, regexp_extract(said, '<output_json>(.*?)</output_json>', 1, 's'), regexp_extract(said, '```(?:json)?(.*?)```', 1, 's'), regexp_extract(said, '(\[\{.*\}\])', 1, 's')], lambda c: c <> '' AND json_valid(c))[1]::JSON AS v FROM answers),
lists AS (SELECT doc_id, CASE WHEN v IS NULL THEN list_transform(list_filter(regexp_extract_all(said, '\{"question".*?"citations":\[\{.*?\}\]\}', 0, 's'), lambda c: json_valid(c)), lambda c: c::JSON)
 WHEN json_type(v) = 'ARRAY' THEN from_json(v, '["json"]') WHEN json_type(v, '$.questions') = 'ARRAY' THEN from_json(json_extract(v, '$.questions'), '["json"]') WHEN json_type(v, '$.results') = 'ARRAY' THEN from_json(json_extract(v, '$.results'), '["json"]') ELSE [v] END AS found FROM cands),
objects AS (SELECT doc_id, unnest(found) AS q, generate_subscripts(found, 1) AS pos FROM (SELECT doc_id, list_filter(found, lambda q: json_type(q) = 'OBJECT') AS found FROM lists))"""


@query(f"""WITH {ANSWERS_SQL} SELECT doc_id AS id, md5(j->>'$[0].answer') AS answer_md5, json_array_length(j)::INTEGER AS n_items, arm FROM (SELECT doc_id, CASE WHEN doc_id % {SHAPES} IN (1, 2, 3) THEN 'marked' ELSE 'brackets' END AS arm,
 CASE doc_id % {SHAPES} WHEN 7 THEN '[1]' WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 8 THEN NULL WHEN 9 THEN NULL WHEN 10 THEN NULL ELSE regexp_extract(said, '(\\[.*\\])', 1, 's') END::JSON AS j FROM answers) WHERE j IS NOT NULL""")
def extract_json_array(spark, d):
    """The first JSON array of answers that hold whole documents."""
    found = questions.extracted_arrays(_answers(spark, d), "doc_id", "said").withColumn("v", F.parse_json("array_json"))
    answer = F.try_variant_get("v", "$[0].answer", "string")
    return found.select(F.col("doc_id").alias("id"), md5(answer).alias("answer_md5"), F.size(questions.variant_list(F.col("v"))).alias("n_items"), "arm")


@query(f"""WITH {ANSWERS_SQL}, {PARSED_SQL} SELECT doc_id AS id, (pos - 1)::INTEGER AS pos, q->>'$.question' AS question, md5(q->>'$.answer') AS answer_md5, json_array_length(q, '$.citations')::INTEGER AS n_citations, md5(q->>'$.citations[0].text') AS citation_md5 FROM objects""")
def parse_llm(spark, d):
    """Questions, answers and citations of answers that hold whole documents, in a dozen good and broken shapes."""
    found = questions.parsed(_answers(spark, d), "doc_id", "said").withColumn("v", F.parse_json("question_json"))
    text = lambda path: F.try_variant_get("v", path, "string")
    return found.select(F.col("doc_id").alias("id"), "pos", text("$.question").alias("question"), md5(text("$.answer")).alias("answer_md5"), F.size(questions.variant_list(F.col("v"), "$.citations")).alias("n_citations"), md5(text("$.citations[0].text")).alias("citation_md5"))


@query(r"SELECT doc_id, CASE WHEN f <> doc_id THEN f END AS dup_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY regexp_replace(lower(trim(text)), '\s+', ' ', 'g')) AS f FROM documents)")
def exact_dedup(spark, d):
    return dedup.exact_duplicates(table(spark, d, "documents"), "doc_id", "text")


PAIRS_SQL = r"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
g AS (SELECT doc_id, md5(string_agg(s, '|' ORDER BY s)) AS h, count(*) AS n FROM s GROUP BY doc_id), k AS (SELECT min(doc_id) AS doc_id, n FROM g GROUP BY h, n), u AS (SELECT s.doc_id, s, n FROM s JOIN k USING (doc_id)),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*)::DOUBLE / (x.n + y.n - count(*)) AS similarity FROM u x JOIN u y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n)"""


@query(f"WITH {PAIRS_SQL} SELECT a, b, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.8")
def near_dup(spark, d):
    return dedup.near_duplicates(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text"), "doc_id", "text").select("a", "b", F.round("similarity", 6).alias("similarity"))


#: The closure of all pairs, and equal sets with their least document.
@query(f"""WITH RECURSIVE {PAIRS_SQL}, l AS (SELECT a, b FROM p WHERE similarity >= 0.8), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS id, min(least(a, b)) AS root FROM r GROUP BY a), o AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h, n) AS id FROM g)
SELECT d.doc_id, coalesce(c.root, o.id, d.doc_id) AS representative FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id LEFT JOIN c ON c.id = o.id""")
def near_dup_groups(spark, d):
    """The group of each document, by MinHash bands and exact comparison."""
    return dedup.near_duplicate_groups(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text"), "doc_id", "text")


@query(f"WITH {CHUNKS_SQL} SELECT m AS model, chunk_id, md5(coalesce(nullif(left(trim(split_part(text, '.', 1)), 200), ''), 'nothing is said')) AS answer_md5 FROM chunks, (VALUES ('first'), ('second')) t(m)")
def union_models(spark, d):
    """What two models answer to every chunk, in one table."""
    from sievewright.models.clients import OfflineClient, responses

    c = chunks(spark, d).select("chunk_id", F.col("text").alias("prompt"))
    both = {m: responses(c, OfflineClient(m)).drop("model") for m in ("first", "second")}
    return dedup.union_models(both).select("model", "chunk_id", md5(_answer(F.col("text"))).alias("answer_md5"))


def _answer(said):
    """The first question's answer of a well-formed response."""
    return F.try_variant_get(F.get(questions.well_formed_questions(said), F.lit(0)), "$.answer", "string")


@query()
def capability_clusters(spark, d):
    return E.capability_clusters(table(spark, d, "embeddings"), 4).groupBy("cluster").agg(F.count("*").alias("n"))


def _exam(spark, d):
    """A question for each document; every second one has choices."""
    i = F.col("doc_id")
    choices = F.when(i % 2 == 0, F.array(F.concat(F.lit("(A) "), "lang"), F.concat(F.lit("(B) "), "source")))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("What does this say: "), "text").alias("question"), choices.alias("choices"), F.when(i % 3 == 0, F.upper("source")).otherwise(F.col("lang")).alias("test_answer"), F.concat(F.lit(" "), "source").alias("gold_answer"))


EXAM = """exam AS (SELECT doc_id, 'What does this say: ' || text AS question, CASE WHEN doc_id % 2 = 0 THEN E'(A) ' || lang || E'\\n(B) ' || source END AS choices, CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE lang END AS test_answer, source FROM documents)"""
PROMPT_SQL = """CASE WHEN choices IS NULL THEN E'Answer the following question.\\n\\nQuestion:\\n' || question || E'\\n\\nReturn only the answer. Do not include explanation unless necessary.' ELSE E'Question:\\n' || question || E'\\n\\nChoices:\\n' || choices || E'\\n\\nReturn the best option letter and answer text.' END"""


@query(f"WITH {EXAM} SELECT doc_id, md5({PROMPT_SQL}) AS prompt_md5 FROM exam")
def evaluation_prompt(spark, d):
    return _exam(spark, d).select("doc_id", F.md5(tasks.evaluation_prompt(F.col("question"), F.col("choices")).cast("binary")).alias("prompt_md5"))


@query(f"WITH {EXAM}, p AS (SELECT length({PROMPT_SQL}) AS n, choices IS NULL AS open FROM exam) SELECT open, count(*) AS n, avg(n) AS mean_length, min(n)::INTEGER AS min_length, max(n)::INTEGER AS max_length FROM p GROUP BY open")
def prompt_performance(spark, d):
    rows = _exam(spark, d).select(F.col("choices").isNull().alias("open"), tasks.evaluation_prompt(F.col("question"), F.col("choices")).alias("prompt"))
    return tasks.prompt_performance(rows, "open")


@query(f"WITH {EXAM} SELECT doc_id, lower(test_answer) = source AS is_correct FROM exam")
def judged(spark, d):
    from sievewright.models.clients import JudgeClient

    return tasks.judged(_exam(spark, d).drop("choices"), JudgeClient()).select("doc_id", "is_correct")


@query(f"WITH {EXAM} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE test_answer END AS text FROM exam")
def padded_responses(spark, d):
    """Answers are missing for every fifth call, and map to empty texts."""
    rows = _exam(spark, d)
    return tasks.mapped(rows.select("doc_id"), rows.where("doc_id % 5 <> 0").select("doc_id", F.col("test_answer").alias("text")), "doc_id")


@query("SELECT doc_id, list_sort(list_distinct(list_concat([lang], string_split(source, 'c')))) AS tags FROM documents")
def tag_union(spark, d):
    from sievewright.operators import units

    return table(spark, d, "documents").select("doc_id", units.merged_tags(F.array(F.array("lang"), F.split("source", "c"))).alias("tags"))


@query("SELECT doc_id, coalesce(n, 0)::BIGINT AS usage_count, least(coalesce(n, 0)::DOUBLE / 5, 1.0::DOUBLE) AS penalty FROM documents LEFT JOIN (SELECT event_id % 997 AS doc_id, count(*) AS n FROM events GROUP BY ALL) USING (doc_id)")
def usage_penalty(spark, d):
    from sievewright.functions import signals
    from sievewright.operators import sampling

    ledger = table(spark, d, "events").select((F.col("event_id") % 997).alias("doc_id"))
    return sampling.with_usage(table(spark, d, "documents").select("doc_id"), ledger, "doc_id").select("doc_id", "usage_count", signals.usage(F.col("usage_count")).alias("penalty"))


@query(f"WITH {EXAM} SELECT doc_id, md5(coalesce(nullif(left(trim(split_part({PROMPT_SQL}, '.', 1), E' \\t\\r\\n\\x0b\\x0c'), 200), ''), 'nothing is said')) AS answer_md5, true AS ok FROM exam")
def test_taker(spark, d):
    """What the client answers to every question."""
    from sievewright.models.clients import OfflineClient

    said = tasks.answered(_exam(spark, d).drop("test_answer"), OfflineClient())
    return said.select("doc_id", md5(_answer(F.col("test_answer"))).alias("answer_md5"), F.col("error").isNull().alias("ok"))


@query()
def silhouette_clusters(spark, d):
    """The cluster of each vector, two levels deep; tests hold the silhouettes against all pairs in SQL."""
    return E.clusters_by_silhouette(table(spark, d, "embeddings").select("vec_id", "embedding"), most=4).select("vec_id", "cluster")
