"""The limiter and tasks in flight over the events: each event asks and completes later; time runs by event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import limiter as M
from .registry import query
from .views import Views, pick, sql_pick

MODELS = ("claude-a", "gpt-b", "anthropic/c", "other")
SMALL = {"openai": (9, 400, 60), "anthropic": (6, 250, 30)}
TOKEN = "secret"


def requests(v: Views) -> DataFrame:
    """A reservation of each event and, some seconds later, its completion or cancellation."""
    k = F.col("event_id")
    ask = F.struct(F.lit("reserve").alias("kind"), (k * 200_000).alias("us"), (k % 50).alias("tokens_in"), (k % 7).alias("tokens_out"))
    end = F.struct(F.when(k % 5 > 0, "record").otherwise("cancel").alias("kind"), (k * 200_000 + k % 90 * 1_000_000).alias("us"), (k % 31).alias("tokens_in"), (k % 11).alias("tokens_out"))
    return v.table("events").select((F.col("user_id") % 20).alias("account"), pick(k, MODELS).alias("model"), k.alias("reservation"), F.explode(F.array(ask, end)).alias("x")).select("account", "model", "reservation", "x.*")


@query(
    "limiter_reservations",
    sql=f"""WITH RECURSIVE r AS (SELECT user_id % 20 AS account, {sql_pick("event_id", MODELS)} AS model, event_id AS id, 2 AS ord, event_id * 200000 AS us, event_id % 50 AS i, event_id % 7 AS o FROM events
        UNION ALL SELECT user_id % 20, {sql_pick("event_id", MODELS)}, event_id, CASE WHEN event_id % 5 > 0 THEN 0 ELSE 1 END, event_id * 200000 + event_id % 90 * 1000000, event_id % 31, event_id % 11 FROM events),
    e AS (SELECT *, CASE WHEN starts_with(model, 'claude') OR starts_with(model, 'anthropic') THEN 'anthropic' ELSE 'openai' END AS provider FROM r),
    n AS (SELECT *, row_number() OVER (PARTITION BY account, provider ORDER BY us, ord, id) AS rk, CASE provider WHEN 'openai' THEN [8, 360, 54] ELSE [5, 225, 27] END AS most FROM e),
    step AS (SELECT account, provider, CAST(0 AS BIGINT) AS rk, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS us, CAST(NULL AS BOOLEAN) AS admitted, CAST(NULL AS BIGINT) AS retry_us, CAST([] AS STRUCT(us BIGINT, i BIGINT, o BIGINT)[]) AS used, CAST([] AS STRUCT(id BIGINT, i BIGINT, o BIGINT)[]) AS held FROM n GROUP BY 1, 2
        UNION ALL SELECT account, provider, rk, id, us, CASE WHEN ord = 2 THEN ok END, CASE WHEN ord = 2 THEN CASE WHEN ok THEN 0 ELSE least(5000000, greatest(100000, coalesce(list_min(list_transform(live, lambda x: x.us)) + 60000000 - us, 120000000))) END END,
            CASE WHEN ord = 0 AND mine THEN list_append(live, {{'us': us, 'i': i, 'o': o}}) ELSE live END, CASE WHEN ord < 2 THEN list_filter(held, lambda x: x.id <> id) WHEN ok THEN list_append(held, {{'id': id, 'i': i, 'o': o}}) ELSE held END
        FROM (SELECT *, list_contains(list_transform(held, lambda x: x.id), id) AS mine, len(live) + len(held) + 1 <= most[1] AND coalesce(list_sum(list_transform(live, lambda x: x.i)), 0) + coalesce(list_sum(list_transform(held, lambda x: x.i)), 0) + i <= most[2]
                AND coalesce(list_sum(list_transform(live, lambda x: x.o)), 0) + coalesce(list_sum(list_transform(held, lambda x: x.o)), 0) + o <= most[3] AS ok
            FROM (SELECT n.*, held, list_filter(step.used, lambda x: x.us > n.us - 60000000) AS live FROM step JOIN n ON n.account = step.account AND n.provider = step.provider AND n.rk = step.rk + 1)))
    SELECT account, provider, id AS reservation, us, admitted, retry_us FROM step WHERE admitted IS NOT NULL""",
)
def limiter_reservations(v: Views) -> DataFrame:
    """Requests of twenty accounts over two providers, with reservations that are recorded or cancelled later."""
    return M.limited(requests(v), SMALL)


def calls(v: Views) -> DataFrame:
    """Each event submits a task or ends one; some are test calls, some lack the right token."""
    k = F.col("event_id")
    return v.table("events").select(
        k.alias("call_id"),
        F.when(k % 37 == 0, pick(k, ("test", "", "Ping"))).otherwise(F.concat(F.lit("t"), F.col("user_id") % 40)).alias("task_id"),
        F.when(k % 3 == 2, "done").otherwise("submit").alias("kind"),
        F.when(k % 11 == 0, "token wrong").when(k % 13 > 0, "token secret").alias("authorization"),
        F.when(k % 17 > 0, "https://x").alias("repository"),
        (k * 1000).alias("us"),
    )


@query(
    "in_flight",
    sql=f"""WITH c AS (SELECT event_id AS call_id, CASE WHEN event_id % 37 = 0 THEN {sql_pick("event_id", ("test", "", "Ping"))} ELSE 't' || (user_id % 40) END AS task_id, event_id % 3 < 2 AS submit, event_id % 11 > 0 AND event_id % 13 > 0 AS may, event_id % 37 = 0 OR event_id % 17 = 0 AS ping FROM events),
    t AS (SELECT *, lag(submit) OVER (PARTITION BY task_id ORDER BY call_id) AS before FROM c WHERE NOT submit OR may AND NOT ping)
    SELECT call_id, task_id, CASE WHEN before THEN 'already_processing' ELSE 'accepted' END AS status FROM t WHERE submit
    UNION ALL SELECT call_id, task_id, CASE WHEN NOT may THEN 'unauthorized' ELSE 'test' END FROM c WHERE submit AND (NOT may OR ping)""",
)
def in_flight(v: Views) -> DataFrame:
    """Submissions by what becomes of them; a task may be submitted again after its completion."""
    return M.in_flight(calls(v), TOKEN)
