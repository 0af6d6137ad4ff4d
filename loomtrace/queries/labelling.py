"""Projections, filters, labels (P) and scalar functions (F)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import traces
from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import labels as lb
from ..oracle import sql

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


_PRIMITIVE = "CASE WHEN tool IS NULL THEN 'invalid' WHEN trim(lower(command)) IN ('inventory', 'look') THEN trim(lower(command)) " + " ".join(f"WHEN starts_with(trim(lower(command)), '{p}') AND length(trim(lower(command))) > {len(p)} THEN '{a}'" for p, a in lb.PREFIXES) + " ELSE 'invalid' END"
_EVENT = "CASE p " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lb.PRIMITIVE_EVENTS.items()) + " END"
_RAW = """CASE WHEN tool = 'take_action' THEN command ELSE '{"arguments":{"action":"' || command || '"},"name":null}' END"""


def _raw(c="command"):
    return F.when(F.col("tool") == "take_action", F.col(c)).otherwise(F.concat(F.lit('{"arguments":'), F.to_json(F.create_map(F.lit("action"), F.col(c))), F.lit(',"name":null}')))


@query("p01_step_transitions", sql("commands", f"SELECT trajectory_id || ':step:' || step_index AS transition_id, trajectory_id, step_index, goal, {_RAW} AS raw_action, p AS primitive_action FROM (SELECT *, {_PRIMITIVE} AS p FROM commands)"))
def p01(spark, sf):
    c = traces.commands(spark, sf)
    nested = c.groupBy("trajectory_id", "goal").agg(F.array_sort(F.collect_list(F.struct("step_index", "tool", "command"))).alias("steps"))
    flat = nested.select("trajectory_id", "goal", F.explode("steps").alias("s")).select("trajectory_id", "goal", "s.*")
    return flat.select(F.concat_ws(":", "trajectory_id", F.lit("step"), "step_index").alias("transition_id"), "trajectory_id", "step_index", "goal", _raw().alias("raw_action"), lb.household_action(F.col("tool"), F.col("command")).alias("primitive_action"))


@query("p02_raw_action", sql("shop", """SELECT trajectory_id, step_index, '{"arguments":' || CASE WHEN keywords IS NOT NULL THEN '{"keywords":"' || keywords || '"}' WHEN value IS NOT NULL THEN '{"value":"' || value || '"}' ELSE 'null' END || ',"name":' || coalesce('"' || tool || '"', 'null') || '}' AS raw_action FROM shop"""))
def p02(spark, sf):
    args = F.map_filter(F.create_map(F.lit("value"), F.col("value"), F.lit("keywords"), F.col("keywords")), lambda k, v: v.isNotNull())
    ordered = F.map_from_entries(F.array_sort(F.map_entries(args)))
    body = F.when(F.size(ordered) > 0, F.to_json(ordered)).otherwise("null")
    name = F.coalesce(F.concat(F.lit('"'), "tool", F.lit('"')), F.lit("null"))
    return traces.shop(spark, sf).select("trajectory_id", "step_index", F.concat(F.lit('{"arguments":'), body, F.lit(',"name":'), name, F.lit("}")).alias("raw_action"))


@query("p03_transition_text", sql("commands", f"SELECT trajectory_id, step_index, 'Goal:' || chr(10) || goal || chr(10) || chr(10) || 'Action:' || chr(10) || {_PRIMITIVE} || ' | ' || command AS transition_text FROM commands"))
def p03(spark, sf):
    c = traces.commands(spark, sf)
    return c.select("trajectory_id", "step_index", F.format_string("Goal:\n%s\n\nAction:\n%s | %s", "goal", lb.household_action(F.col("tool"), F.col("command")), "command").alias("transition_text"))


@query("p04_household_action", sql("commands", f"SELECT command, tool, {_PRIMITIVE} AS primitive, count(*) AS n FROM commands GROUP BY ALL"))
def p04(spark, sf):
    return traces.commands(spark, sf).withColumn("primitive", lb.household_action(F.col("tool"), F.col("command"))).groupBy("command", "tool", "primitive").agg(F.count("*").alias("n"))


@query("p05_shop_action", sql("shop", "SELECT CASE WHEN tool = 'search_action' AND keywords IS NOT NULL THEN 'search' WHEN tool = 'click_action' AND value IS NOT NULL THEN 'click' ELSE 'invalid' END AS primitive, count(*) AS n FROM shop GROUP BY 1"))
def p05(spark, sf):
    return traces.shop(spark, sf).groupBy(lb.shop_action(F.col("tool"), F.col("keywords"), F.col("value")).alias("primitive")).agg(F.count("*").alias("n"))


@query("p06_event_labels", sql("commands", f"SELECT p AS primitive, {_EVENT} AS event, count(*) AS n FROM (SELECT {_PRIMITIVE} AS p FROM commands) GROUP BY ALL"))
def p06(spark, sf):
    p = traces.commands(spark, sf).select(lb.household_action(F.col("tool"), F.col("command")).alias("primitive"))
    return p.groupBy("primitive", lb.event_of(F.col("primitive")).alias("event")).agg(F.count("*").alias("n"))


_PAGE = "CASE WHEN l = 'webshop search page.' THEN 'search' WHEN l LIKE 'search results page%' THEN 'results' WHEN l LIKE 'product:%' THEN 'item' WHEN regexp_matches(l, '^(description|features|reviews|attributes):') THEN 'item_detail' WHEN l LIKE 'purchase completed%' THEN 'terminal' ELSE 'unknown' END"


@query("p07_page_type", sql("shop", f"SELECT page, count(*) AS n FROM (SELECT {_PAGE} AS page FROM (SELECT trim(lower(string_split(before, chr(10))[1])) AS l FROM shop)) GROUP BY 1"))
def p07(spark, sf):
    return traces.shop(spark, sf).groupBy(lb.page_type(F.col("before")).alias("page")).agg(F.count("*").alias("n"))


@query("p08_legal_events", sql("shop", f"""SELECT page, unnest(CASE page WHEN 'search' THEN ['query_formulation', 'query_refinement'] WHEN 'results' THEN ['candidate_selection', 'result_navigation', 'search_backtracking']
  WHEN 'item' THEN ['attribute_inspection', 'option_selection', 'purchase_decision', 'search_backtracking'] WHEN 'item_detail' THEN ['detail_backtracking', 'search_backtracking'] ELSE ['other_click'] END) AS event
  FROM (SELECT DISTINCT {_PAGE} AS page FROM (SELECT trim(lower(string_split(before, chr(10))[1])) AS l FROM shop))"""))
def p08(spark, sf):
    pages = traces.shop(spark, sf).select(lb.page_type(F.col("before")).alias("page")).distinct()
    return pages.select("page", F.explode(lb.legal_events(F.col("page"))).alias("event"))


@query("p08_admissible_events", sql("commands", f"SELECT DISTINCT trajectory_id, {_EVENT} AS event FROM (SELECT trajectory_id, {_PRIMITIVE} AS p FROM commands) WHERE p <> 'invalid'"))
def p08_admissible(spark, sf):
    c = traces.commands(spark, sf).where("tool is not null").groupBy("trajectory_id").agg(F.collect_set("command").alias("admissible"))
    primitive = F.transform("admissible", lambda a: lb.household_action(F.lit("take_action"), a))
    return c.select("trajectory_id", F.explode(F.array_distinct(F.transform(F.filter(primitive, lambda p: p != "invalid"), lb.event_of))).alias("event"))


@query("p09_goal_events", sql("commands", "SELECT goal, unnest(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(goal), '{p}')" for p in ps) + f" THEN '{e}' END" for e, ps in sorted(lb.GOAL_PHRASES.items())) + "], lambda x: x IS NOT NULL)) AS event FROM (SELECT DISTINCT goal FROM commands)"))
def p09(spark, sf):
    return traces.commands(spark, sf).select("goal").distinct().select("goal", F.explode(lb.goal_events(F.col("goal"))).alias("event"))


@query("p10_goal_extraction", sql("commands", r"""SELECT trajectory_id, step_index, trim(regexp_replace(lower(regexp_extract(observation, '(?i)your task is to:\s*([^\n]+?)(?:\n|$)', 1)), '\s+', ' ', 'g')) AS normalised,
  trim(regexp_extract(observation, '(?im)^your task is to:\s*([^\n]+?)[ ]*$', 1)) AS line_goal, coalesce(nullif(trim(regexp_extract(observation, '(?i)your task is to:\s*([^\n]+?)(?:\n|$)', 1)), ''), goal) AS with_fallback FROM commands"""))
def p10(spark, sf):
    o = F.col("observation")
    return traces.commands(spark, sf).select("trajectory_id", "step_index", lb.observed_goal(o).alias("normalised"), lb.line_goal(o).alias("line_goal"), lb.observed_goal_or(o, F.col("goal")).alias("with_fallback"))


_PRICE = r"list_transform(regexp_extract_all(after, '(?i)(?:Price:\s*|\|\s*\$)(\d+(?:\.\d+)?)', 1), lambda x: x::DOUBLE)"


@query("p11_bands_and_signals", sql("shop goals", f"""SELECT s.trajectory_id, step_index, CASE WHEN reward / 100 >= 0.999 THEN 'exact' WHEN reward / 100 >= 0.5 THEN 'partial' ELSE 'low' END AS band,
  CASE len(options) WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'multiple' END AS option_count,
  CASE WHEN price_upper IS NULL OR list_min({_PRICE}) IS NULL THEN 'unknown' WHEN list_min({_PRICE}) <= price_upper THEN 'within_limit' ELSE 'over_limit' END AS price_signal FROM shop s JOIN goals g ON s.sample_id = g.goal_index"""))
def p11(spark, sf):
    rows = traces.shop(spark, sf).join(traces.goals(spark, sf), F.col("sample_id") == F.col("goal_index"))
    return rows.select("trajectory_id", "step_index", lb.reward_band(F.col("reward") / 100).alias("band"), lb.count_bucket(F.size("options")).alias("option_count"), lb.price_signal(F.col("after"), F.col("price_upper")).alias("price_signal"))


OFFICIAL = ("goto", "pick", "put", "open", "close", "toggle", "heat", "clean", "cool", "slice")


@query("p12_grounding_actions", sql("commands", f"""SELECT goal, p AS action, n::DOUBLE / total AS share, list_position({list(OFFICIAL)!r}, p)::INTEGER AS rank FROM (
  SELECT goal, p, count(*) AS n, sum(count(*)) OVER (PARTITION BY goal) AS total FROM (SELECT goal, {_PRIMITIVE} AS p FROM commands) GROUP BY goal, p) WHERE list_contains({list(OFFICIAL)!r}, p) AND n >= 0.05 * total"""))
def p12(spark, sf):
    c = traces.commands(spark, sf).select("goal", lb.household_action(F.col("tool"), F.col("command")).alias("action"))
    counts = c.groupBy("goal", "action").agg(F.count("*").alias("n"))
    totals = counts.groupBy("goal").agg(F.sum("n").alias("total"))
    rank = F.array_position(F.array(*[F.lit(a) for a in OFFICIAL]), F.col("action")).cast("int")
    return counts.join(totals, "goal").where(F.col("action").isin(*OFFICIAL) & (F.col("n") >= 0.05 * F.col("total"))).select("goal", "action", (F.col("n") / F.col("total")).alias("share"), rank.alias("rank"))


@query("p15_evidence_pool", sql("episodes", """SELECT trajectory_id, CASE WHEN success THEN 'success' WHEN any_success THEN 'contrast_to_success' ELSE 'partial_evidence' END AS reason FROM (
  SELECT *, bool_or(success) OVER (PARTITION BY sample_id) AS any_success FROM episodes) WHERE success OR any_success OR primary_score >= 0.5"""))
def p15(spark, sf):
    e = traces.episodes(spark, sf)
    flags = e.groupBy("sample_id").agg(F.bool_or("success").alias("any_success"))
    j = e.join(flags, "sample_id").where("success or any_success or primary_score >= 0.5")
    return j.select("trajectory_id", F.when(F.col("success"), "success").when(F.col("any_success"), "contrast_to_success").otherwise("partial_evidence").alias("reason"))


@query("p16_manifest_selection", sql("episodes", "SELECT sample_id, repeat_id, method FROM episodes WHERE sample_id IN (SELECT goal_index FROM (SELECT p_partkey AS goal_index FROM part WHERE p_partkey % 3 = 0)) AND repeat_id = 0"))
def p16(spark, sf):
    wanted = traces.goals(spark, sf).where("goal_index % 3 = 0").select(F.col("goal_index").alias("sample_id"))
    return traces.episodes(spark, sf).where("repeat_id = 0").join(wanted, "sample_id", "left_semi").select("sample_id", "repeat_id", "method")


@query("p17_successful_trajectories", sql("episodes", "SELECT sample_id, min(trajectory_id) AS first_success, count(*) AS n FROM episodes WHERE success GROUP BY 1"))
def p17(spark, sf):
    return traces.episodes(spark, sf).where("success").groupBy("sample_id").agg(F.min("trajectory_id").alias("first_success"), F.count("*").alias("n"))


@query("p18_chat_history", sql("commands", """m AS (SELECT trajectory_id, 0 AS pos, 'system' AS role, 'act' AS content FROM (SELECT DISTINCT trajectory_id FROM commands)
  UNION ALL SELECT trajectory_id, 1, 'user', goal FROM (SELECT DISTINCT trajectory_id, goal FROM commands WHERE step_index = 0)
  UNION ALL SELECT trajectory_id, 2 + 2 * step_index, 'assistant', command FROM commands
  UNION ALL SELECT trajectory_id, 3 + 2 * step_index, CASE WHEN tool IS NULL THEN 'user' ELSE 'tool' END, 'reward ' || round(reward)::BIGINT FROM commands) SELECT trajectory_id, pos::INTEGER AS pos, role, content FROM m"""))
def p18(spark, sf):
    c = traces.commands(spark, sf).withColumn("goal", F.first("goal").over(Window.partitionBy("trajectory_id").orderBy("step_index")))
    seq = c.groupBy("trajectory_id", "goal").agg(F.array_sort(F.collect_list(F.struct("step_index", "tool", "command", "reward"))).alias("s"))
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    pairs = F.flatten(F.transform("s", lambda x: F.array(message(F.lit("assistant"), x["command"]), message(F.when(x["tool"].isNull(), "user").otherwise("tool"), F.concat(F.lit("reward "), F.round(x["reward"]).cast("long"))))))
    head = F.array(message(F.lit("system"), F.lit("act")), message(F.lit("user"), F.col("goal")))
    return seq.select("trajectory_id", F.posexplode(F.concat(head, pairs)).alias("pos", "m")).select("trajectory_id", "pos", "m.role", "m.content")


@query("p19_tool_schema_map", sql("shop", "SELECT tool, min(step_index)::INTEGER AS first_step FROM shop WHERE tool IS NOT NULL GROUP BY tool"))
def p19(spark, sf):
    t = traces.shop(spark, sf).where("tool is not null").groupBy("tool").agg(F.min("step_index").alias("first_step"))
    as_map = t.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "first_step")))).alias("m"))
    return as_map.select(F.explode("m").alias("tool", "first_step"))


@query("p20_plan_step_lines", r"""WITH l AS (SELECT item_id, list_transform(string_split(replace(text, '. ', chr(10)), chr(10)), lambda x: trim(x)) AS lines, text FROM benchmark),
  k AS (SELECT item_id, text, list_filter(lines, lambda x: (starts_with(x, '#') OR starts_with(lower(x), 'step') OR length(x) > 10) AND length(x) >= 5) AS kept FROM l)
  SELECT item_id, unnest(CASE WHEN len(kept) = 0 THEN [text] ELSE kept END) AS line FROM k""")
def p20(spark, sf):
    b = traces.read(spark, sf, "benchmark")
    lines = F.transform(F.split(F.replace("text", F.lit(". "), F.lit("\n")), "\n"), F.trim)
    kept = F.filter(lines, lambda x: (x.startswith("#") | F.lower(x).startswith("step") | (F.length(x) > 10)) & (F.length(x) >= 5))
    return b.select("item_id", F.explode(F.when(F.size(kept) == 0, F.array("text")).otherwise(kept)).alias("line"))


@query("p21_procedure_lines", sql("commands", r"SELECT trajectory_id, step_index, trim(regexp_replace(step_index || '. ' || command, '^\s*(?:\d+[.)]|[-*])\s*', '')) AS line FROM commands"))
def p21(spark, sf):
    c = traces.commands(spark, sf)
    return c.select("trajectory_id", "step_index", F.trim(F.regexp_replace(F.concat_ws(". ", F.col("step_index").cast("string"), "command"), r"^\s*(?:\d+[.)]|[-*])\s*", "")).alias("line"))


@query("p22_card_text", sql("commands", """SELECT trajectory_id, '# ' || trajectory_id || chr(10) || string_agg((step_index + 1) || '. ' || command, chr(10) ORDER BY step_index) AS card FROM commands GROUP BY trajectory_id"""))
def p22(spark, sf):
    seq = traces.commands(spark, sf).groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("step_index", "command"))).alias("s"))
    lines = F.transform("s", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["command"]))
    return seq.select("trajectory_id", F.concat_ws("\n", F.concat(F.lit("# "), "trajectory_id"), F.array_join(lines, "\n")).alias("card"))


@query("p23_feedback_projection", sql("episodes", "SELECT sample_id, repeat_id, method, success, steps FROM episodes"))
def p23(spark, sf):
    return traces.episodes(spark, sf).select("sample_id", "repeat_id", "method", "success", "steps")


@query("p24_primary_bundle", sql("steps", "SELECT trajectory_id, list_filter(list(CASE WHEN k % 2 = 0 THEN 'high_' || (k % 7) ELSE 'mid_' || (k % 7) END ORDER BY step_index), lambda x: starts_with(x, 'high_'))[1] AS bundle FROM steps GROUP BY 1"))
def p24(spark, sf):
    ids = F.when(F.col("k") % 2 == 0, F.concat(F.lit("high_"), F.col("k") % 7)).otherwise(F.concat(F.lit("mid_"), F.col("k") % 7))
    seq = traces.steps(spark, sf).groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("step_index", ids.alias("id")))).alias("s"))
    high = F.filter(F.transform("s", lambda x: x["id"]), lambda x: x.startswith("high_"))
    return seq.select("trajectory_id", F.when(F.size(high) > 0, F.element_at(high, 1)).alias("bundle"))


@query("p25_result_page", """WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
  SELECT p_brand, p_partkey, n > 20 AS has_next, true AS has_prev FROM r WHERE rn BETWEEN 11 AND 20""")
def p25(spark, sf):
    page = 2
    ranked = traces.read(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("ids"))
    sliced = ranked.select("p_brand", F.slice("ids", (page - 1) * 10 + 1, 10).alias("page"), (F.size("ids") > page * 10).alias("has_next"), F.lit(page > 1).alias("has_prev"))
    return sliced.select("p_brand", F.explode("page").alias("p_partkey"), "has_next", "has_prev")


@query("p26_policy_flags", sql("steps", "SELECT sample_id, bool_or(event_type = 'view') AS has_search, bool_or(event_type = 'purchase') AS has_purchase, bool_or(event_type = 'error') AS has_error FROM steps GROUP BY 1"))
def p26(spark, sf):
    """Which parts a rendered policy would have; its prose is out of scope."""
    has = lambda e: F.bool_or(F.col("event_type") == e)
    return traces.steps(spark, sf).groupBy("sample_id").agg(has("view").alias("has_search"), has("purchase").alias("has_purchase"), has("error").alias("has_error"))


@query("p27_trajectory_context", sql("steps", "SELECT trajectory_id, string_agg(event_type, '>' ORDER BY step_index) AS events, string_agg(k::VARCHAR, ',' ORDER BY step_index) AS actions FROM steps GROUP BY 1"))
def p27(spark, sf):
    seq = traces.steps(spark, sf).groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("step_index", "event_type", "k"))).alias("s"))
    return seq.select("trajectory_id", F.array_join("s.event_type", ">").alias("events"), F.array_join(F.transform("s", lambda x: x["k"].cast("string")), ",").alias("actions"))


@query("p28_last_action", sql("steps", """l AS (SELECT sample_id, method, repeat_id, arg_max(event_type, step_index) AS last_event, max(step_index)::INTEGER AS last_step FROM steps GROUP BY ALL)
  SELECT a.sample_id, a.repeat_id, a.last_event AS baseline_last, b.last_event AS candidate_last, b.last_step - a.last_step AS extra_steps FROM l a JOIN l b USING (sample_id, repeat_id) WHERE a.method = 'baseline' AND b.method = 'candidate'"""))
def p28(spark, sf):
    last = traces.steps(spark, sf).groupBy("sample_id", "method", "repeat_id").agg(F.max_by("event_type", "step_index").alias("e"), F.max("step_index").alias("s"))
    a = last.where("method = 'baseline'").select("sample_id", "repeat_id", F.col("e").alias("baseline_last"), F.col("s").alias("s1"))
    b = last.where("method = 'candidate'").select("sample_id", "repeat_id", F.col("e").alias("candidate_last"), F.col("s").alias("s2"))
    return a.join(b, ["sample_id", "repeat_id"]).select("sample_id", "repeat_id", "baseline_last", "candidate_last", (F.col("s2") - F.col("s1")).alias("extra_steps"))


# ---- scalar functions


@query("f01_normalise", rf"SELECT doc_id, md5(trim(regexp_replace({tx.folded_sql('text')}, '\s+', ' ', 'g'))) AS digest FROM documents")
def f01(spark, sf):
    return traces.read(spark, sf, "documents").select("doc_id", F.md5(tx.normalise(F.col("text"), fold=True)).alias("digest"))


@query("f02_entity", sql("commands", r"SELECT DISTINCT command, regexp_replace(trim(regexp_replace(lower(command), '\s+', ' ', 'g')), '\s+\d+$', '') AS entity FROM commands"))
def f02(spark, sf):
    return traces.commands(spark, sf).select("command", tx.without_number(F.col("command")).alias("entity")).distinct()


_N = r"trim(regexp_replace(lower(command), '\s+', ' ', 'g'))"


def _ent(pattern, i):
    return rf"regexp_replace(regexp_extract(a, '{pattern}', {i}), '\s+\d+$', '')"


_TAKE, _PUT, _WITH, _UN = r"^(?:take|pick)\s+(.+?)\s+from\s+(.+?)$", r"^(?:put|move)\s+(.+?)\s+(?:to|in/on|in|on)\s+(.+?)$", r"^(clean|heat|cool|slice)\s+(.+?)\s+with\s+(.+?)$", r"^(go to|open|close|use|toggle|examine)\s+(.+?)$"


@query("f03_action_signature", sql("commands", rf"""SELECT DISTINCT command, CASE WHEN a IN ('inventory', 'look', 'help') THEN upper(a) WHEN regexp_matches(a, '{_TAKE}') THEN 'PICK_UP(' || {_ent(_TAKE, 1)} || ', ' || {_ent(_TAKE, 2)} || ')'
  WHEN regexp_matches(a, '{_PUT}') THEN 'PUT(' || {_ent(_PUT, 1)} || ', ' || {_ent(_PUT, 2)} || ')' WHEN regexp_matches(a, '{_WITH}') THEN upper(regexp_extract(a, '{_WITH}', 1)) || '(' || {_ent(_WITH, 2)} || ', ' || {_ent(_WITH, 3)} || ')'
  WHEN regexp_matches(a, '{_UN}') THEN upper(replace(regexp_extract(a, '{_UN}', 1), ' ', '_')) || '(' || {_ent(_UN, 2)} || ')' ELSE upper(regexp_replace(a, '\s+\d+\b', '', 'g')) END AS signature FROM (SELECT command, {_N} AS a FROM commands)"""))
def f03(spark, sf):
    return traces.commands(spark, sf).select("command").distinct().select("command", tx.action_signature(F.col("command")).alias("signature"))


@query("f04_segment_signature", sql("segments", """x AS (SELECT *, lag(event_type) OVER w AS p, lead(event_type) OVER w AS n FROM segments WINDOW w AS (PARTITION BY trajectory_id ORDER BY start_step))
  SELECT segment_id, 'Event context: ' || coalesce(p, 'START') || ' -> ' || event_type || ' -> ' || coalesce(n, 'END') || chr(10) || 'Length: ' || n_steps AS signature FROM x"""))
def f04(spark, sf):
    from ..operators.sequences import segments, with_context

    s = with_context(segments(traces.steps(spark, sf)))
    text = F.format_string("Event context: %s -> %s -> %s\nLength: %d", "previous_event", "event_type", "next_event", "n_steps")
    return s.select("segment_id", text.alias("signature"))


@query("f04_page_context", sql("shop", rf"SELECT DISTINCT before, page || ':' || left(trim(regexp_replace(l, '\s+', ' ', 'g')), 240) AS context FROM (SELECT before, l, {_PAGE} AS page FROM (SELECT before, trim(lower(string_split(before, chr(10))[1])) AS l FROM shop))"))
def f04_page(spark, sf):
    s = traces.shop(spark, sf).select("before").distinct()
    return s.select("before", F.concat_ws(":", lb.page_type(F.col("before")), F.substring(tx.normalise(tx.first_line(F.col("before"))), 1, 240)).alias("context"))


@query("f05_terms_visible", """SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_terms, len(list_intersect(['the', 'of'], regexp_extract_all(lower(text), '[a-z0-9]+'))) = 2 AS visible FROM documents""")
def f05(spark, sf):
    d = traces.read(spark, sf, "documents")
    return d.select("doc_id", F.size(tx.terms(F.col("text"))).cast("long").alias("n_terms"), tx.phrase_visible(F.lit("The of"), F.col("text")).alias("visible"))


@query("f06_action_value", sql("shop", "SELECT trajectory_id, string_agg(coalesce(keywords, value), ' ' ORDER BY step_index) AS action_value FROM shop WHERE coalesce(keywords, value) IS NOT NULL GROUP BY 1"))
def f06(spark, sf):
    raw = p02(spark, sf)
    v = F.try_parse_json("raw_action")
    value = F.coalesce(F.try_variant_get(v, "$.arguments.keywords", "string"), F.try_variant_get(v, "$.arguments.value", "string"))
    seq = raw.select("trajectory_id", "step_index", value.alias("v")).where("v is not null").groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("step_index", "v"))).alias("s"))
    return seq.select("trajectory_id", F.array_join("s.v", " ").alias("action_value"))


@query("f07_selected_count", sql("shop", r"SELECT after, count(*) AS n, length(regexp_extract(after, '(?is)Selected:\s*\{(.*?)\}', 1)) - length(replace(regexp_extract(after, '(?is)Selected:\s*\{(.*?)\}', 1), ':', '')) AS selected FROM shop GROUP BY after"))
def f07(spark, sf):
    return traces.shop(spark, sf).groupBy("after").agg(F.count("*").alias("n")).select("after", "n", tx.selected_count(F.col("after")).cast("long").alias("selected"))


@query("f08_min_price", sql("shop", f"SELECT after, list_min({_PRICE}) AS min_price FROM (SELECT DISTINCT after FROM shop)"))
def f08(spark, sf):
    return traces.shop(spark, sf).select("after").distinct().select("after", F.array_min(tx.prices(F.col("after"))).alias("min_price"))


@query("f10_outcome_consistency", """SELECT a.o_orderpriority AS l, b.o_orderpriority AS r, round((a.f * b.f + a.o * b.o + a.p * b.p) / (sqrt(a.f * a.f + a.o * a.o + a.p * a.p) * sqrt(b.f * b.f + b.o * b.o + b.p * b.p)), 6) AS consistency FROM
  (SELECT o_orderpriority, avg((o_orderstatus = 'F')::INT) f, avg((o_orderstatus = 'O')::INT) o, avg((o_orderstatus = 'P')::INT) p FROM orders GROUP BY 1) a, (SELECT o_orderpriority, avg((o_orderstatus = 'F')::INT) f, avg((o_orderstatus = 'O')::INT) o, avg((o_orderstatus = 'P')::INT) p FROM orders GROUP BY 1) b""")
def f10(spark, sf):
    share = lambda s: F.avg((F.col("o_orderstatus") == s).cast("double"))
    d = traces.read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.array(share("F"), share("O"), share("P")).alias("d"))
    a, b = d.select(F.col("o_orderpriority").alias("l"), F.col("d").alias("x")), d.select(F.col("o_orderpriority").alias("r"), F.col("d").alias("y"))
    return a.crossJoin(b).select("l", "r", F.round(vx.cosine(F.col("x"), F.col("y"), 0.0), 6).alias("consistency"))  # five by five priorities


@query("f11_unit_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS unit_l1 FROM embeddings")
def f11(spark, sf):
    v = traces.read(spark, sf, "embeddings").select("vec_id", vx.unit(F.col("embedding").cast("array<double>")).alias("u"))
    return v.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("unit_l1"))


@query("f12_cosine", "SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(a.embedding::DOUBLE[], lambda x: x * x))) * sqrt(list_sum(list_transform(b.embedding::DOUBLE[], lambda x: x * x)))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def f12(spark, sf):
    v = traces.read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    w = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return v.join(w, "vec_id").select("vec_id", F.round(vx.cosine(F.col("a"), F.col("b"), -1.0), 6).alias("cosine"))


@query("f14_content_ids", sql("steps", "SELECT trajectory_id, 'high_' || left(sha256(string_agg(event_type, chr(31) ORDER BY step_index)), 12) AS path_id FROM steps GROUP BY 1"))
def f14(spark, sf):
    seq = traces.steps(spark, sf).groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("step_index", "event_type"))).alias("s"))
    return seq.select("trajectory_id", tx.content_id("high_", F.col("s.event_type")).alias("path_id"))


@query("f15_guarded_saving", sql("episodes", """p AS (SELECT a.sample_id, a.repeat_id, a.success s1, b.success s2, a.steps n1, b.steps n2 FROM episodes a JOIN episodes b USING (sample_id, repeat_id) WHERE a.method = 'baseline' AND b.method = 'candidate')
  SELECT sample_id, repeat_id, round(CASE WHEN s2 < s1 THEN least((n1 - n2) / greatest(n1, 1), 0) ELSE (n1 - n2) / greatest(n1, 1) END, 6) AS saving FROM p"""))
def f15(spark, sf):
    from ..operators.evaluation import guarded_saving, paired

    return paired(traces.episodes(spark, sf)).select("sample_id", "repeat_id", F.round(guarded_saving(), 6).alias("saving"))


@query("f16_tagged_text", r"""SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '<li>')) AS n_items FROM pages""")
def f16(spark, sf):
    p = traces.read(spark, sf, "pages")
    return p.select("page_id", tx.tagged(F.col("html"), "title").alias("title"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("n_items"))


@query("f17_token_sum", sql("episodes", "SELECT trajectory_id, input_tokens + max_k + billable_tokens AS total FROM episodes"))
def f17(spark, sf):
    return traces.episodes(spark, sf).select("trajectory_id", (F.col("input_tokens") + F.col("max_k") + F.col("billable_tokens")).alias("total"))


@query("f18_batch_normalise", "SELECT label, count(*) AS n, round(sum(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))), 4) AS norm_sum, count(*)::DOUBLE AS unit_sum FROM embeddings GROUP BY 1")
def f18(spark, sf):
    v = traces.read(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return v.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(vx.norm(F.col("v"))), 4).alias("norm_sum"), F.round(F.sum(vx.norm(vx.unit(F.col("v")))), 4).alias("unit_sum"))
