"""Queries of stage state and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.store import shared_dir
from ..streaming import propagation, results
from ..streaming import state as T
from . import runs
from .registry import query
from .views import table, view

c = F.col
LATEST = "l as (select entity, stage, arg_max(status, epoch_us(ts)::hugeint * 10000000 + event_id) as status, max(ts) as updated_at, count(*) as records from {stage_log} group by 1, 2)"
GRID = f"{LATEST}, e as (select distinct entity from {{stage_log}}), s as (select distinct event_type as stage from events), g as (select entity, stage, coalesce(status, 'pending') as status from e cross join s left join l using (entity, stage))"


def latest(spark, sf_dir):
    return T.latest(view(spark, sf_dir, "stage_log"), ["entity", "stage"], ["ts", "event_id"])


def grid(spark, sf_dir):
    log = view(spark, sf_dir, "stage_log")
    return T.status_grid(latest(spark, sf_dir), log.select("stage").distinct(), log.select("entity").distinct())


@query(f"with {LATEST} select entity, stage, status, records from l")
def stage_latest(spark, sf_dir):
    return latest(spark, sf_dir).select("entity", "stage", "status", "records")


@query(f"with {GRID} select * from g")
def stage_status(spark, sf_dir):
    return grid(spark, sf_dir).select("entity", "stage", "status")


@query(f"with {GRID} select entity, bool_and(status in ('succeeded', 'skipped', 'adopted')) as ok, count(*) filter (status in ('succeeded', 'skipped', 'adopted')) as done, count(*) filter (status = 'failed') as failed from g group by 1")
def run_summary(spark, sf_dir):
    return T.run_summary(grid(spark, sf_dir))


@query(f"""with {GRID}, n(stage, needs) as (values ('view', 'click'), ('purchase', 'view'), ('purchase', 'signup')), w as (select entity, stage as needs from g where status not in ('succeeded', 'skipped', 'adopted'))
select entity, g.stage, string_agg(distinct needs, ',' order by needs) as missing from g join n on g.stage = n.stage join w using (entity, needs) group by 1, 2""")
def dependency_readiness(spark, sf_dir):
    needs = spark.createDataFrame([("view", "click"), ("purchase", "view"), ("purchase", "signup")], "stage string, needs string")
    return T.blocked(grid(spark, sf_dir), needs).withColumn("missing", F.array_join("missing", ","))


@query(f"with {LATEST} select entity, stage, 'f' || (entity % 3) as fingerprint from l where not (status = 'succeeded' and entity % 3 <> 1)")
def resume_antijoin(spark, sf_dir):
    s = latest(spark, sf_dir)
    own = F.concat(F.lit("f"), (c("entity") % 3).cast("string"))
    state = s.withColumn("fingerprint", F.when(c("entity") % 3 == 1, F.lit("old")).otherwise(own))
    return T.to_run(s.select("entity", "stage", own.alias("fingerprint")), state)


@query(f"""with {LATEST} select entity, stage, case when entity % 11 = 0 then 'run' when status = 'succeeded' and entity % 3 <> 1 and records % 2 = 0 then 'skipped' else 'run' end as action from l""")
def stage_gate(spark, sf_dir):
    g = T.gate(c("status"), c("entity") % 3 != 1, c("records") % 2 == 0, c("entity") % 11 == 0)
    return latest(spark, sf_dir).select("entity", "stage", g.alias("action"))


@query("with m as (select max(ts) as now from events) select event_id, user_id from events, m where epoch(now) - epoch(ts) > 86400")
def stale_locks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return T.stale(e.withColumn("now", e.agg(F.max("ts").alias("m")).scalar()), c("now")).select("event_id", "user_id")


@query("""with g as (select *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (partition by object order by frame) > 86400000000, false) as gap from {shots}),
l as (select *, count(*) filter (gap) over (partition by object order by frame) + count(*) filter (kind = 'remove') over (partition by object order by frame rows between unbounded preceding and 1 preceding) as life,
    count(*) filter (kind = 'reset') over (partition by object order by frame) as resets from g),
f as (select *, row_number() over (partition by object, life order by frame) as pos, max(case when kind = 'prompt' then frame end) over (partition by object, life, resets order by frame) as cond,
    min(case when kind = 'prompt' then frame end) over (partition by object, life, resets order by frame) as start from l where kind in ('frame', 'prompt'))
select object, frame, 'forward' as direction, case kind when 'prompt' then 'prompt' else 'tracked' end as source, cond,
    coalesce((select list(c.frame order by c.frame) from (select c.frame from f c where c.object = f.object and c.life = f.life and c.resets = f.resets and c.frame < f.frame and c.start is not null order by c.frame desc limit 6) c), []) as memory
    from f where start is not null union all
select a.object, a.frame, 'back', 'tracked', b.frame, (select list(c.frame order by c.frame desc) from f c where c.object = a.object and c.life = a.life and c.pos > a.pos and c.pos <= a.pos + 6 and c.frame <= b.frame)
    from f a join f b on a.object = b.object and a.life = b.life and b.frame = b.start and a.pos < b.pos and a.pos >= b.pos - 16""")
def frame_propagation(spark, sf_dir):
    return propagation.propagate(view(spark, sf_dir, "shots"))


@query("""with r as (select case when event_id % 13 = 0 then null when event_id % 17 = 0 then '' else event_type end as stage,
    case event_id % 5 when 0 then 'succeeded' when 1 then 'failed' when 2 then 'timed_out' when 3 then 'done?' else 'blocked' end as status, case when event_id % 19 <> 0 then ts end as time, value - 5 as seconds from events)
select case when stage is null or stage = '' then 'no stage' when status = 'done?' then 'unknown status' when time is null then 'no time' when seconds < 0 then 'negative seconds' end as why, count(*) as n from r group by 1""")
def state_validation(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stage = F.when(c("event_id") % 13 == 0, None).when(c("event_id") % 17 == 0, "").otherwise(c("event_type"))
    status = F.get(F.array(*map(F.lit, ("succeeded", "failed", "timed_out", "done?", "blocked"))), (c("event_id") % 5).cast("int"))
    rows = e.select(stage.alias("stage"), status.alias("status"), F.when(c("event_id") % 19 != 0, c("ts")).alias("at"), (c("value") - 5).alias("seconds"))
    good, bad = runs.load_state(rows)
    return good.withColumn("why", F.lit(None).cast("string")).unionByName(bad).groupBy("why").agg(F.count(F.lit(1)).alias("n"))


@query("select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def incremental_results(spark, sf_dir):
    """The events as a stream whose batches are written once each, then summed from the batches' own sums."""
    schema = table(spark, sf_dir, "events").schema
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    # as a pattern, so that one file is taken as well as a folder
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    sums = lambda df, batch: df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).withColumn("batch", F.lit(batch).cast("long"))
    results.once(stream, f"{base}/out", f"{base}/checkpoint", sums).trigger(availableNow=True).start().awaitTermination()
    back = results.read_results(spark, f"{base}/out", "event_type string, n long, total double, batch long")
    return back.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))
