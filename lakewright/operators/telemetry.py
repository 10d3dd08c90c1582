"""Trace, call-log and job analytics: group-bys, log attribution, windows, loops, failures, diffs over time."""

from lakewright.plans.dialect import relation, sql_query

relation("anchor", "SELECT max(us) AS at_us FROM trace")
relation(
    "failures",
    """SELECT step_id, run_id, source_id, phase, us, CASE WHEN event = 'limit_kill' THEN 'limit_kill' WHEN event = 'hard_stop' THEN 'stop' WHEN event = 'failure' THEN 'failure'
      WHEN mode = 'S2' AND parent_id IS NOT NULL AND phase = 5 THEN 'escalation' END AS kind FROM trace""",
)

sql_query(
    "cost_grouping_sets",
    """SELECT CAST(phase AS STRING) AS phase, model, mode, source_id, CAST(sum(est_usd) AS DOUBLE) AS usd, count_if(priced AND est_usd IS NOT NULL) AS priced, count_if(priced AND est_usd IS NULL) AS unpriced, count(*) AS steps,
    CAST(sum(input_tokens) AS BIGINT) AS tokens_in, CAST(sum(output_tokens) AS BIGINT) AS tokens_out FROM trace WHERE mode IS NOT NULL AND source_id IS NOT NULL GROUP BY GROUPING SETS ((phase), (model), (mode), (source_id))""",
)
sql_query("mode_counts", "SELECT run_id, count_if(mode = 'D0') AS d0, count_if(mode = 'D1') AS d1, count_if(mode = 'S1') AS s1, count_if(mode = 'S2') AS s2 FROM trace WHERE event IS NULL OR event <> 'loop' GROUP BY run_id")
sql_query("code_only_share", "SELECT run_id, CASE WHEN count(mode) = 0 THEN NULL ELSE round(CAST(count_if(mode IN ('D0', 'D1')) AS DOUBLE) / count(mode), 6) END AS share FROM trace WHERE event IS NULL OR event <> 'loop' GROUP BY run_id")
sql_query("loop_rollup", "SELECT phase, count(*) AS iterations, CAST(sum(est_usd) AS DOUBLE) AS usd, max(output_tokens) AS largest FROM trace WHERE event = 'loop' GROUP BY phase")
sql_query("jobs_completed", "SELECT source_id, count(DISTINCT job_id) AS jobs FROM jobs WHERE failure_reason IS NULL GROUP BY source_id")
sql_query("spent_strict", "SELECT session_id, CASE WHEN count_if(priced AND est_usd IS NULL) > 0 THEN NULL ELSE CAST(sum(est_usd) AS DOUBLE) END AS spent FROM trace WHERE priced GROUP BY session_id")
sql_query(
    "shares_topn_other",
    """SELECT CASE WHEN place <= 4 THEN session_id ELSE 'other' END AS name, CAST(sum(n) AS BIGINT) AS n, round(CAST(sum(n) AS DOUBLE) / max(total), 6) AS share FROM (
      SELECT session_id, n, row_number() OVER (ORDER BY n DESC, session_id) AS place, sum(n) OVER () AS total FROM (SELECT session_id, count(*) AS n FROM trace GROUP BY session_id) c) r GROUP BY 1""",
)
sql_query("unit_cost", "SELECT usd, gold, CASE WHEN gold = 0 THEN NULL ELSE round(usd / gold, 8) END AS per_value FROM (SELECT CAST(sum(est_usd) AS DOUBLE) AS usd FROM trace WHERE priced) u CROSS JOIN (SELECT count(*) AS gold FROM gold_fields WHERE status = 'gold') g")
sql_query("inference_rollup", "SELECT purpose, model, count(*) AS calls, count_if(status = 200) AS ok, round(CAST(median(latency_ms) AS DOUBLE), 6) AS median_latency, CAST(sum(input_tokens) AS BIGINT) AS tokens_in, CAST(sum(output_tokens) AS BIGINT) AS tokens_out, CAST(sum(est_usd) AS DOUBLE) AS usd FROM calls GROUP BY purpose, model")
sql_query("decider_counts", "SELECT CASE WHEN mode IN ('D0', 'D1') THEN 'code' WHEN mode IS NULL THEN 'none' WHEN event_id % 4 = 0 THEN 'aux' ELSE 'model' END AS decider, count(*) AS n FROM trace GROUP BY 1")
sql_query(
    "failure_stats",
    """SELECT source_id, count_if(kind = 'stop') AS stops, count_if(kind = 'limit_kill') AS kills, count_if(kind = 'failure') AS failures, count_if(kind = 'escalation') AS escalations,
    round(CAST(100 AS DOUBLE) * count(kind) / count(*), 6) AS per_100_steps, count_if(kind IS NOT NULL AND us > at_us - CAST(900000000 AS BIGINT)) AS last_15_min FROM failures CROSS JOIN anchor WHERE source_id IS NOT NULL GROUP BY source_id""",
)
sql_query("failure_classify", "SELECT coalesce(kind, 'none') AS kind, phase, count(*) AS n FROM failures GROUP BY coalesce(kind, 'none'), phase")
sql_query("phase_pipeline", "SELECT run_id, phase, count(*) AS steps, max(us) - min(us) AS elapsed_us, CAST(sum(est_usd) AS DOUBLE) AS usd, count_if(event = 'hard_stop') AS stops FROM trace GROUP BY run_id, phase")
sql_query("step_summary", "SELECT run_id, count(*) AS steps, count(DISTINCT mode) AS modes, count(event) AS events, count(source_id) AS with_source, count(DISTINCT session_id) AS sessions FROM trace GROUP BY run_id")
sql_query("step_kinds", "SELECT event_id, coalesce(event, mode, 'none') AS kind, coalesce(lag(mode) OVER (PARTITION BY user_id ORDER BY us, event_id), '-') AS before FROM trace")
sql_query("progress_steps", "SELECT run_id, count(*) AS progress FROM trace WHERE mode IS NOT NULL AND (event IS NULL OR event = 'loop') GROUP BY run_id")
sql_query("gate_answered", "SELECT g.event_id FROM trace g LEFT JOIN (SELECT DISTINCT parent_id AS answered FROM trace WHERE event IS NULL) c ON answered = g.event_id WHERE g.event = 'hard_stop' AND answered IS NULL")
# attribution: by step and session, else by run, else by time inside a run, else orphan
relation("run_spans", "SELECT run_id AS span_run, min(us) AS lo, max(us) AS hi FROM trace WHERE event_id % 4 = 1 GROUP BY run_id")
# a run is looked for in the days it spans only: an equality join, not every call with every run
relation("run_days", "SELECT span_run, lo, hi, idiv(lo, CAST(86400000000 AS BIGINT)) + k - 1 AS span_day FROM (SELECT span_run, lo, hi, each_of(upto(idiv(hi, CAST(86400000000 AS BIGINT)) - idiv(lo, CAST(86400000000 AS BIGINT)) + 1)) AS k FROM run_spans) d")
relation("calls_in_runs", "SELECT x.event_id, min(span_run) AS span_run FROM calls x JOIN run_days ON span_day = idiv(x.us, CAST(86400000000 AS BIGINT)) AND x.us BETWEEN lo AND hi GROUP BY x.event_id")
relation(
    "attributed",
    """SELECT c.event_id, CASE WHEN t.event_id IS NOT NULL THEN 'step' WHEN c.run_id IS NOT NULL THEN 'run' WHEN w.event_id IS NOT NULL THEN 'window' ELSE 'orphan' END AS how, coalesce(t.run_id, c.run_id, w.span_run) AS run_id, c.step_id, c.est_usd
    FROM calls c LEFT JOIN trace t ON t.step_id = c.step_id AND (c.session_id IS NULL OR t.session_id = c.session_id) LEFT JOIN calls_in_runs w ON w.event_id = c.event_id""",
)
sql_query(
    "call_attribution",
    "SELECT how, run_id, count(*) AS n, CAST(sum(est_usd) AS DOUBLE) AS usd FROM attributed GROUP BY how, run_id",
    """SELECT how, run_id, count(*) AS n, CAST(sum(est_usd) AS DOUBLE) AS usd FROM (
      SELECT CASE WHEN t.event_id IS NOT NULL THEN 'step' WHEN c.run_id IS NOT NULL THEN 'run' WHEN w.span_run IS NOT NULL THEN 'window' ELSE 'orphan' END AS how, coalesce(t.run_id, c.run_id, w.span_run) AS run_id, c.est_usd
      FROM (SELECT *, (SELECT min(span_run) FROM run_spans s WHERE calls.us BETWEEN s.lo AND s.hi) AS span_run FROM calls) c LEFT JOIN trace t ON t.step_id = c.step_id AND t.session_id = c.session_id
      LEFT JOIN (SELECT DISTINCT span_run FROM run_spans) w ON w.span_run = c.span_run) a GROUP BY how, run_id""",
)
sql_query("unmatched_model_steps", "SELECT t.event_id FROM trace t LEFT JOIN (SELECT DISTINCT step_id AS called FROM calls WHERE step_id IS NOT NULL) c ON called = t.step_id WHERE t.mode IN ('S1', 'S2') AND called IS NULL")
sql_query("orphan_calls", "SELECT c.event_id, CASE WHEN c.step_id IS NULL THEN 'no step' ELSE 'unknown step' END AS reason FROM calls c LEFT JOIN trace t ON t.step_id = c.step_id WHERE t.step_id IS NULL AND c.run_id IS NULL")
sql_query("jobs_latest", "SELECT job_id, event_id, failure_reason, source_id FROM (SELECT j.*, row_number() OVER (PARTITION BY job_id ORDER BY us DESC, event_id DESC) AS place FROM jobs j) r WHERE place = 1")
sql_query("jobs_steps", "SELECT j.event_id, j.job_id, coalesce(t.run_id, 'unknown') AS run_id, coalesce(t.phase, 0) AS phase FROM jobs j LEFT JOIN trace t ON t.step_id = j.step_id")
sql_query(
    "job_proof_matrix",
    """SELECT checkpoint, count_if(state = 1 AND failure_reason IS NULL) AS passed, count_if(state = 0) AS pending, count_if(state = 1 AND failure_reason IS NOT NULL) AS failed FROM (
      SELECT 'created' AS checkpoint, created AS state, failure_reason FROM jobs UNION ALL SELECT 'sealed', sealed, failure_reason FROM jobs UNION ALL SELECT 'ran', ran, failure_reason FROM jobs UNION ALL SELECT 'collected', collected, failure_reason FROM jobs) u GROUP BY checkpoint""",
)
sql_query("recent_jobs", "SELECT source_id, job_id, event_id FROM (SELECT j.*, row_number() OVER (PARTITION BY source_id ORDER BY us DESC, event_id DESC) AS place FROM jobs j) r WHERE place <= 8")
sql_query("egress_recent", "SELECT session_id, event_id, purpose FROM (SELECT c.*, row_number() OVER (PARTITION BY session_id ORDER BY us DESC, event_id DESC) AS place FROM calls c) r WHERE place <= 32")
sql_query("http_outcome", "SELECT status, CASE WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status IN (401, 403) THEN 'blocked' WHEN status = 429 THEN 'limited' WHEN status >= 500 THEN 'server' ELSE 'failed' END AS outcome, count(*) AS n FROM calls GROUP BY status")
sql_query("trace_append_valid", "SELECT CASE WHEN mode IS NULL AND event IS NULL THEN 'neither mode nor event' WHEN parent_id IS NOT NULL AND parent_id = event_id THEN 'own parent' ELSE 'accepted' END AS outcome, count(*) AS n FROM trace GROUP BY 1")
sql_query("trace_merge", "SELECT count_if(b.step_id IS NULL) AS kept, count_if(a.step_id IS NULL) AS added, count_if(a.h = b.h) AS skipped, count_if(a.h <> b.h) AS clashes FROM (SELECT step_id, sha(step_id || coalesce(mode, '-')) AS h FROM trace WHERE event_id % 10 <> 0) a FULL JOIN (SELECT step_id, sha(step_id || CASE WHEN event_id % 101 = 0 THEN 'x' ELSE coalesce(mode, '-') END) AS h FROM trace WHERE event_id % 10 <> 1) b ON a.step_id = b.step_id")
sql_query("status_changes", "SELECT event_id, user_id, event_type FROM (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS before FROM trace) s WHERE before IS NULL OR before <> event_type")
sql_query("throughput_windows", "SELECT phase, count_if(us > at_us - CAST(900000000 AS BIGINT)) AS last_15, count_if(us > at_us - CAST(3600000000 AS BIGINT)) AS last_60, count_if(us > at_us - CAST(86400000000 AS BIGINT)) AS last_day, count(*) AS whole FROM trace CROSS JOIN anchor GROUP BY phase")
# the last hour of a run, or all of it if it is younger; a run whose window holds no priced step has no rate
relation("run_windows", "SELECT run_id, us, est_usd, max(us) OVER (PARTITION BY run_id) AS end_us, greatest(max(us) OVER (PARTITION BY run_id) - CAST(3600000000 AS BIGINT), min(us) OVER (PARTITION BY run_id)) AS start_us FROM trace")
relation("run_burn", "SELECT run_id, count(est_usd) AS priced, CAST(sum(est_usd) AS DOUBLE) AS usd, CAST(max(end_us) - max(start_us) AS DOUBLE) / 3600000000 AS hours FROM run_windows WHERE us >= start_us GROUP BY run_id")
relation("run_caps", "SELECT run_id, CASE run_id WHEN 'run-0' THEN CAST(NULL AS DOUBLE) WHEN 'run-1' THEN CAST(0 AS DOUBLE) ELSE CAST(1000000 AS DOUBLE) END AS cap, CAST(sum(est_usd) AS DOUBLE) AS spent FROM trace GROUP BY run_id")
sql_query(
    "burn_rate",
    "SELECT run_id, CASE WHEN priced > 0 AND hours > 0 THEN round(usd / hours, 4) END AS usd_per_hour, round(coalesce(usd, CAST(0 AS DOUBLE)), 6) AS usd, round(hours, 4) AS hours FROM run_burn",
    """SELECT r.run_id, CASE WHEN count(t.est_usd) = 0 OR hi = lo THEN NULL ELSE round(CAST(sum(t.est_usd) AS DOUBLE) / (least(hi - lo, 3600000000) / 3600000000.0::DOUBLE), 4) END AS usd_per_hour,
      round(coalesce(CAST(sum(t.est_usd) AS DOUBLE), 0), 6) AS usd, round(least(hi - lo, 3600000000) / 3600000000.0::DOUBLE, 4) AS hours
      FROM (SELECT run_id, min(us) AS lo, max(us) AS hi FROM trace GROUP BY run_id) r LEFT JOIN trace t ON t.run_id = r.run_id AND t.us BETWEEN hi - 3600000000 AND hi GROUP BY r.run_id, lo, hi""",
)
sql_query(
    "budget_projection",
    """SELECT c.run_id, spent, round(cap - spent, 6) AS remaining, CASE WHEN cap IS NULL OR spent IS NULL THEN NULL WHEN round(cap - spent, 6) <= 0 THEN CAST(0 AS DOUBLE)
      WHEN priced > 0 AND hours > 0 AND round(usd / hours, 4) <> 0 THEN round(round(cap - spent, 6) / round(usd / hours, 4), 3) END AS hours_left FROM run_caps c LEFT JOIN run_burn b ON b.run_id = c.run_id""",
)
sql_query("progress_stall", "SELECT run_id, max(us) - max(CASE WHEN mode IS NOT NULL AND event IS NULL THEN us END) AS quiet_us, count_if(event_type = 'error') AS errors FROM trace GROUP BY run_id")
sql_query("liveness", "SELECT run_id, CASE WHEN at_us - max(us) <= CAST(3600000000 AS BIGINT) THEN 'live' WHEN at_us - max(us) <= CAST(86400000000 AS BIGINT) THEN 'quiet' ELSE 'stale' END AS state, at_us - max(us) AS age_us FROM trace CROSS JOIN anchor GROUP BY run_id, at_us")
sql_query("bronze_growth", "SELECT run_id, count(*) AS now, coalesce(max(CASE WHEN us < at_us - CAST(86400000000 AS BIGINT) THEN place END), min(place)) AS baseline FROM (SELECT t.*, row_number() OVER (PARTITION BY run_id ORDER BY us, event_id) AS place FROM trace t) t CROSS JOIN anchor GROUP BY run_id")
sql_query("mode_escalations", "SELECT c.event_id, p.mode AS before, c.mode AS after FROM trace c JOIN trace p ON p.event_id = c.parent_id WHERE c.mode IN ('S1', 'S2') AND p.mode IN ('D0', 'D1') AND p.phase = 5")
sql_query("revision_diff", "SELECT conv_id, turn, length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS grown, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '-') AS before FROM conversations")
sql_query("run_durations", "SELECT run_id, row_number() OVER (ORDER BY min(us), run_id) AS place, idiv(max(us) - min(us), CAST(3600000000 AS BIGINT)) AS hours, count(*) AS steps FROM trace GROUP BY run_id")
sql_query("growth_over_runs", "SELECT run_id, n, sum_n FROM (SELECT run_id, n, CAST(sum(n) OVER (ORDER BY run_id) AS BIGINT) AS sum_n FROM (SELECT run_id, count(DISTINCT user_id) AS n FROM trace GROUP BY run_id) a) b")
sql_query("learning_trend", "SELECT run_id, source_id, round(avg(CASE WHEN mode IN ('D0', 'D1') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS code_share, count_if(event = 'failure') AS repairs FROM trace WHERE source_id IS NOT NULL GROUP BY run_id, source_id")
sql_query("global_spent", "SELECT upstream, CAST(sum(CASE WHEN status = 200 THEN est_usd END) AS DOUBLE) AS spent, count_if(status <> 200) AS refused FROM calls GROUP BY upstream")
sql_query("session_budget", "SELECT session_id, min(us) AS over_us FROM (SELECT session_id, us, sum(est_usd) OVER (PARTITION BY session_id ORDER BY us, event_id) AS spent FROM calls WHERE status = 200) c WHERE spent > 0.05 GROUP BY session_id")
sql_query("price_calls", "SELECT c.event_id, c.input_tokens * coalesce(usd_in, 3) + c.output_tokens * coalesce(usd_out, 15) AS micro_usd FROM calls c LEFT JOIN prices p ON p.model = c.model AND c.model <> 'm2'")
sql_query("activity_sessions", "SELECT user_id, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM (SELECT user_id, us, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id) AS part FROM (SELECT user_id, us, event_id, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) <= CAST(36000000000 AS BIGINT) THEN 0 ELSE 1 END AS fresh FROM trace) a) b GROUP BY user_id, part")
sql_query("stop_cause", "SELECT run_id, event AS cause, event_id FROM (SELECT t.*, row_number() OVER (PARTITION BY run_id ORDER BY us DESC, event_id DESC) AS place FROM trace t WHERE event IS NOT NULL) r WHERE place = 1")
sql_query("failure_strips", "SELECT 'step' AS strip, source_id, count(*) AS n FROM failures WHERE kind IS NOT NULL AND source_id IS NOT NULL GROUP BY source_id UNION ALL SELECT 'job', source_id, count(*) FROM jobs WHERE failure_reason IS NOT NULL GROUP BY source_id UNION ALL SELECT 'checkpoint', source_id, count_if(collected = 0) FROM jobs GROUP BY source_id")
sql_query("provenance_flags", "SELECT 'unmatched' AS flag, count(*) AS n FROM calls c LEFT JOIN trace t ON t.step_id = c.step_id WHERE t.step_id IS NULL UNION ALL SELECT 'aux', count(*) FROM calls WHERE upstream = 'aux' UNION ALL SELECT 'unpriced', count_if(priced AND est_usd IS NULL) FROM trace")
sql_query("actors", "SELECT actor, count(*) AS n FROM (SELECT CASE WHEN event_type = 'signup' THEN 'human' WHEN event_type = 'error' THEN 'runner' WHEN mode IN ('D0', 'D1') THEN 'engine' ELSE 'model' END AS actor FROM trace) a GROUP BY actor")
sql_query("critic_outcomes", "SELECT phase, model, count_if(event IS NULL) AS passed, count_if(event = 'loop') AS looped, count_if(event IN ('failure', 'hard_stop', 'limit_kill')) AS failed FROM trace GROUP BY phase, model")
sql_query("trace_sources", "SELECT run_id, names_of(source_id) AS sources, count(DISTINCT source_id) AS n FROM trace GROUP BY run_id")
sql_query(
    "loop_threads",
    """SELECT user_id, thread, count(*) AS steps, min(event_id) AS first_step, max(phase) AS last_phase FROM (
      SELECT user_id, event_id, phase, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id) AS thread FROM (
        SELECT user_id, event_id, phase, us, CASE WHEN phase < lag(phase) OVER (PARTITION BY user_id ORDER BY us, event_id) THEN 1 ELSE 0 END AS fresh FROM trace) a) b GROUP BY user_id, thread""",
)
sql_query("reopen_markers", "SELECT event_id, run_id, phase FROM trace WHERE event = 'loop' AND phase IN (2, 3, 4)")
sql_query("attention", "SELECT run_id, CASE WHEN stops > 10 THEN 'critical' WHEN kills > 10 THEN 'warning' ELSE 'ok' END AS severity, stops, kills FROM (SELECT run_id, count_if(event = 'hard_stop') AS stops, count_if(event = 'limit_kill') AS kills FROM trace GROUP BY run_id) r")
sql_query("inbox_latest", "SELECT run_id, event_id, event FROM (SELECT t.*, row_number() OVER (PARTITION BY run_id, event ORDER BY us DESC, event_id DESC) AS place FROM trace t WHERE event IN ('hard_stop', 'loop')) r WHERE place = 1")
sql_query("stream_page", "SELECT place, event_id FROM (SELECT event_id, row_number() OVER (ORDER BY us DESC, event_id DESC) AS place FROM trace) r WHERE place BETWEEN 51 AND 100")
sql_query("latest_run", "SELECT max_by(run_id, us * 1000 + event_id % 1000) AS run_id, count(DISTINCT run_id) AS runs FROM trace")
sql_query("source_health", "SELECT source_id, CASE WHEN ok = 0 THEN 'dropped' WHEN failed * 4 > ok THEN 'degraded' ELSE 'healthy' END AS health, ok, failed FROM (SELECT source_id, count_if(mode IS NOT NULL) AS ok, count_if(event_type = 'error') AS failed FROM trace WHERE source_id IS NOT NULL GROUP BY source_id) s")
sql_query("backend_of", "SELECT run_id, CASE min(CASE WHEN event_id % 97 = 0 THEN 0 WHEN event_id % 2 = 0 THEN 1 ELSE 2 END) WHEN 0 THEN 'recorded' WHEN 1 THEN 'remote' ELSE 'local' END AS backend FROM trace WHERE event_id % 50 <> 0 GROUP BY run_id")
sql_query("replay_safe", "SELECT event_id, coalesce(max(CASE WHEN event IN ('hard_stop', 'limit_kill') THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, phase ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS safe FROM trace WHERE source_id IS NOT NULL")
relation("filled", "SELECT user_id, event_id, us, event_type, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS part FROM trace")
sql_query("asof_screenshot", "SELECT event_id, min(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id, part) AS screenshot FROM filled")
sql_query("macro_step_asof", "SELECT p.event_id, min_by(c.event_id, c.us * 1000 + c.event_id % 1000) AS macro FROM trace p JOIN trace c ON c.parent_id = p.event_id WHERE p.mode = 'D0' GROUP BY p.event_id")
sql_query("sidecar_binding", "SELECT c.event_id, c.model = t.model AND c.session_id = t.session_id AS bound FROM calls c JOIN trace t ON t.step_id = c.step_id")
sql_query("checkpoint_invalidate", "SELECT user_id, count_if(us >= at_us - CAST(21600000000 AS BIGINT)) AS kept, count_if(us < at_us - CAST(21600000000 AS BIGINT)) AS expired, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS changed FROM trace CROSS JOIN anchor GROUP BY user_id, at_us")
sql_query("capture_reuse", "SELECT source_id, phase, max_by(event_id, us * 1000 + event_id % 1000) AS newest FROM trace WHERE mode = 'D0' AND source_id IS NOT NULL GROUP BY source_id, phase")
sql_query("bronze_replay", "SELECT sha(t.source_id || ':' || t.step_id || ':' || CAST(t.phase AS STRING)) AS replay_id, t.event_id, coalesce(m.n, 0) AS children FROM trace t LEFT JOIN (SELECT parent_id, count(*) AS n FROM trace WHERE parent_id IS NOT NULL GROUP BY parent_id) m ON m.parent_id = t.event_id WHERE t.mode = 'D0' AND t.source_id IS NOT NULL")
sql_query("scan_jsonl_tolerant", "SELECT event_type, count_if(matches(props, '^[{].*[}]$')) AS good, count_if(NOT matches(props, '^[{].*[}]$')) AS torn, CAST(sum(key_of(props)) AS BIGINT) AS total FROM events GROUP BY event_type")
# messages of the user or a tool: what page tags enclose, or else a long text as a whole
relation("screened", "SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN 'see <page_content>' || text || '</page_content> and <page_content>' || role || '</page_content>' ELSE text END AS text FROM conversations WHERE role IN ('user', 'tool')")
relation("chunked", "SELECT conv_id, turn, text, regex_all(text, '(?s)<page_content>(.*?)</page_content>', 1) AS tagged FROM screened")
sql_query("screen_chunks", "SELECT conv_id, turn, each_of(tagged) AS chunk FROM chunked UNION ALL SELECT conv_id, turn, text FROM chunked WHERE length_of(tagged) = 0 AND length(text) > 2000")
sql_query("screen_verdict", "SELECT turn, count_if(length(text) % 10 >= 8 OR turn % 5 = 4) AS flagged, count_if(NOT (length(text) % 10 >= 8 OR turn % 5 = 4)) AS passed FROM conversations GROUP BY turn")
sql_query("time_helpers", "SELECT event_id, second_of(ts) AS iso, idiv(us, CAST(60000000 AS BIGINT)) - idiv(lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id), CAST(60000000 AS BIGINT)) AS minutes FROM trace")
sql_query("safe_ratios", "SELECT run_id, CASE WHEN count(mode) = 0 THEN 0.0 ELSE round(CAST(count_if(mode = 'D0') AS DOUBLE) / count(mode), 4) END AS share, CASE WHEN count_if(event = 'none') = 0 THEN NULL ELSE 1.0 END AS empty FROM trace GROUP BY run_id")
sql_query("throughput_tumbling", "SELECT phase, idiv(us, CAST(3600000000 AS BIGINT)) * CAST(3600000000 AS BIGINT) AS start_us, count(*) AS steps FROM trace GROUP BY 1, 2")
relation("slides", "SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3")
sql_query("throughput_sliding", "SELECT idiv(us, CAST(900000000 AS BIGINT)) * CAST(900000000 AS BIGINT) - k * CAST(900000000 AS BIGINT) AS start_us, count(*) AS steps, count_if(event IS NOT NULL) AS events FROM trace CROSS JOIN slides GROUP BY 1")
