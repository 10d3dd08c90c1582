"""What went wrong in a step of a trace: its kind, its class of failure and the reason, all as column expressions.

steps(event, requested, executed, evaluated, observed, details, source_id): the five fields are JSON or plain text; details holds the members
screen, loop, verify, repair and gate of a step.  Null or empty fields count as absent.  The first rule that holds decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.plans.dialect import LazyOracle
from lakewright.plans.registry import query

#: Words of a step that was stopped, of a blocked domain, of a failed check; ends of a session without a result.
STOP_WORDS = ("captcha", "login", "log in", "sign in", "injection", "401", "402", "paywall", "bot_wall", "http_403")
BLOCK_WORDS = (
    "domain_not_allowed", "not allowlisted", "not_allowlisted", "egress_blocked", "blocked_domain", "domain blocked", "outside allowed_domains",
    "not in allowed_domains", "outside allowed domains", "outside_registrable_domain",
)
FAIL_WORDS = ("fail", "captcha", "timeout", "error", "refused")
UNACHIEVED = ("not_achieved", "not_achievable", "trace_missing", "action_blocked")
#: A request that the sandbox sends to a host of .invalid to prove that it is shut in; an element of an array of flat objects.
PROBE = r'(?<=[\[,])\s*\{[^{}]*"host"\s*:\s*"[^"{}]*\.invalid"[^{}]*\}\s*,?'


def without_probes(field: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(field, PROBE, ""), r",\s*\]", "]")


def first_word(text: Column, words: tuple[str, ...]) -> Column:
    """The first of words, in their order, that the text holds; null if it holds none."""
    return F.coalesce(*(F.when(text.contains(w), F.lit(w)) for w in words))


def _member(field: str, name: str) -> Column:
    return F.nullif(F.get_json_object(field, f"$.{name}"), F.lit(""))


def _holds(name: str) -> Column:
    return F.coalesce(_member("details", name).startswith("{"), F.lit(False))


def step_kind() -> Column:
    """quarantine, loop, verify, repair, gate, kill or null, over the columns of steps."""
    event = F.coalesce("event", F.lit(""))
    verified = _holds("verify") | F.coalesce(_member("requested", "tool").contains("vision"), F.lit(False)) | _member("evaluated", "verdict").isNotNull()
    return (
        F.when((event == "quarantine") | F.coalesce(_member("details", "screen.flagged") == "true", F.lit(False)), "quarantine")
        .when((event == "loop") | _holds("loop"), "loop").when((event == "verify") | verified, "verify").when((event == "repair") | _holds("repair"), "repair")
        .when((event == "action_gate") | _holds("gate"), "gate").when(event == "limit_kill", "kill")
    )


def classify(steps: DataFrame) -> DataFrame:
    """steps with kind, failure (class of what went wrong, null if nothing did) and reason (the word or status that decided, if one did)."""
    steps = steps.withColumn("kind", step_kind())
    steps = steps.withColumns({c: without_probes(F.col(c)) for c in ("requested", "executed", "evaluated", "observed")})
    text = F.lower(F.concat_ws(" ", "requested", "executed", "evaluated"))
    event, kind = F.coalesce("event", F.lit("")), F.coalesce("kind", F.lit(""))
    bare = (event == "") & (kind == "")
    stop, blocked = first_word(text, STOP_WORDS), first_word(text, BLOCK_WORDS)
    tool = F.coalesce(_member("requested", "tool"), _member("requested", "action"))
    goal = F.coalesce(_member("evaluated", "goal_status"), F.when(tool == "browser_agent.session.act", _member("evaluated", "status")))
    attempt = F.coalesce(*(_member(c, "attempt").try_cast("int") for c in ("requested", "observed", "executed")), F.lit(0))
    # a structured result is judged by its status, not by words in its details
    result = F.lower(F.when(F.col("evaluated").startswith("{"), F.coalesce(_member("evaluated", "status"), _member("evaluated", "result"))).otherwise(F.col("evaluated")))
    outcome = _member("details", "gate.outcome")
    word = F.when(text.contains("error") | text.contains("exception"), "error").when(text.contains("timeout"), "timeout").otherwise("failed")
    rules = [
        (kind == "quarantine", "quarantine", F.lit(None)),
        ((kind == "kill") | (event == "limit_kill"), "limit_kill", F.coalesce(_member("evaluated", "reason"), _member("executed", "reason"))),
        ((kind == "gate") & F.coalesce(outcome.isin("pending_approval", "denied"), F.lit(False)), "gate", outcome),
        (kind == "gate", None, F.lit(None)),
        ((event == "hard_stop") & blocked.isNotNull(), "blocked_domain", blocked),
        (_member("evaluated", "status") == "refused", "refusal", _member("evaluated", "reason")),
        (bare & goal.isin(*UNACHIEVED) & stop.isNotNull(), "stop", stop),
        (bare & goal.isin(*UNACHIEVED), "failure", goal),
        ((event == "hard_stop") | ((event == "failure") & stop.isNotNull()), "stop", F.coalesce(stop, _member("evaluated", "reason"), F.lit("hard stop"))),
        (blocked.isNotNull(), "blocked_domain", blocked),
        (event == "escalation", "escalation", F.lit(None)),
        ((attempt > 1) & (kind != "repair"), "escalation", attempt.cast("string")),
        ((event == "failure") | (bare & (first_word(result, FAIL_WORDS)).isNotNull()), "failure", word),
        (text.contains("dropped") & F.col("source_id").isNotNull(), "source_dropped", F.lit(None)),
    ]
    failure = reason = None
    for holds, name, why in rules:
        failure = failure.when(holds, F.lit(name)) if failure is not None else F.when(holds, F.lit(name))
        reason = reason.when(holds, why) if reason is not None else F.when(holds, why)
    return steps.select("*", failure.alias("failure"), reason.cast("string").alias("reason"))


#: Steps of the fixture: (event, requested, executed, evaluated, observed, details) -> (kind, failure, reason).
STEPS = (
    ((None, '{"tool":"fetch"}', None, '{"status":"ok"}', None, None), (None, None, None)),
    (("quarantine", None, None, "captcha", None, None), ("quarantine", "quarantine", None)),
    ((None, None, None, None, None, '{"screen":{"flagged":true}}'), ("quarantine", "quarantine", None)),
    (("limit_kill", None, None, '{"reason":"memory"}', None, None), ("kill", "limit_kill", "memory")),
    ((None, None, None, "login", None, '{"gate":{"outcome":"denied"}}'), ("gate", "gate", "denied")),
    (("action_gate", None, None, "captcha error", None, '{"gate":{"outcome":"approved"}}'), ("gate", None, None)),
    (("hard_stop", '{"url":"x"}', None, '{"reason":"domain_not_allowed"}', None, None), (None, "blocked_domain", "domain_not_allowed")),
    ((None, None, None, '{"status":"refused","reason":"incomplete"}', None, None), (None, "refusal", "incomplete")),
    ((None, None, "sign in first", '{"goal_status":"not_achieved"}', None, None), (None, "stop", "sign in")),
    ((None, '{"tool":"browser_agent.session.act"}', None, '{"status":"trace_missing"}', None, None), (None, "failure", "trace_missing")),
    ((None, '{"tool":"other"}', None, '{"status":"trace_missing"}', None, None), (None, None, None)),
    (("hard_stop", None, None, '{"reason":"policy"}', None, None), (None, "stop", "policy")),
    (("hard_stop", None, None, None, None, None), (None, "stop", "hard stop")),
    (("failure", None, "HTTP 402 Paywall", None, None, None), (None, "stop", "402")),
    ((None, None, '{"egress_events":[{"host":"a.org","decision":"block","reason":"egress_blocked"}]}', None, None, None), (None, "blocked_domain", "egress_blocked")),
    ((None, None, '{"egress_events":[{"host":"p.invalid","reason":"domain_not_allowed"},{"host":"a.org","reason":"allowed"}]}', None, None, None), (None, None, None)),
    (("escalation", None, None, None, None, None), (None, "escalation", None)),
    ((None, '{"attempt":3}', None, "timeout", None, None), (None, "escalation", "3")),
    (("repair", '{"attempt":3}', None, "timeout", None, None), ("repair", None, None)),
    (("failure", None, "an Exception", None, None, None), (None, "failure", "error")),
    ((None, None, None, '{"status":"Timeout"}', None, None), (None, "failure", "timeout")),
    ((None, None, None, '{"status":"ok","note":"no error"}', None, None), (None, None, None)),
    ((None, None, "source dropped", None, None, None), (None, "source_dropped", None)),
    ((None, '{"tool":"vision.check"}', None, '{"verdict":"pass"}', None, None), ("verify", None, None)),
    (("loop", None, None, "dropped", None, None), ("loop", "source_dropped", None)),
)
FIELDS = ("event", "requested", "executed", "evaluated", "observed", "details")


def _sql(x: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if x is None else "'" + x + "'"


@query(
    "failure_classes",
    LazyOracle(
        "SELECT event_id, kind, failure, reason FROM events JOIN ("
        + " UNION ALL ".join(f"SELECT {i} AS v, {_sql(want[0])} AS kind, {_sql(want[1])} AS failure, {_sql(want[2])} AS reason" for i, (_, want) in enumerate(STEPS))
        + f") w ON v = event_id % {len(STEPS)}"
    ),
)
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind and class of failure of every event, each a step of the fixture."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % len(STEPS)).cast("int").alias("v"))
    given = F.array(*(F.struct(*(F.lit(x).cast("string").alias(c) for c, x in zip(FIELDS, step, strict=True))) for step, _ in STEPS))
    steps = events.select("event_id", F.get(given, F.col("v")).alias("s")).select("event_id", "s.*", F.lit("src").alias("source_id"))
    return classify(steps).select("event_id", "kind", "failure", "reason")
