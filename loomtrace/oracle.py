"""Common table expressions of the oracle SQL: the canonical tables of ``traces`` in DuckDB's dialect."""

from __future__ import annotations

from .traces import CLICKS, COMMANDS, GOALS, PAGES


def _list(options: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + o.replace("{{", "{").replace("}}", "}").replace("'", "''") + "'" for o in options) + "]"


def _pick(options: tuple[str, ...], index: str, n: str) -> str:
    return f"replace({_list(options)}[(({index}) % {len(options)}) + 1], '{{n}}', ({n})::VARCHAR)"


_STEPS = """steps AS (
  SELECT 'u' || user_id || '-w' || week AS trajectory_id, user_id AS sample_id, CASE WHEN (week % 4 + 4) % 4 < 2 THEN 'baseline' ELSE 'candidate' END AS method,
    (2 * floor(week / 4) + (week % 2 + 2) % 2)::INTEGER AS repeat_id, (row_number() OVER (PARTITION BY user_id, week ORDER BY ts, event_id) - 1)::INTEGER AS step_index,
    event_type, (props->>'k')::INTEGER AS k, value AS reward, event_id
  FROM (SELECT *, floor(date_diff('day', DATE '2024-01-01', ts::DATE) / 7)::INTEGER AS week FROM events))"""

_EPISODES = """episodes AS (
  SELECT *, primary_score >= 0.999 AS success FROM (
    SELECT trajectory_id, sample_id, method, repeat_id,
      count(*) FILTER (event_type = 'purchase') / greatest(count(*) FILTER (event_type IN ('purchase', 'error')), 1) AS primary_score,
      count(*) AS steps, count(*) FILTER (event_type = 'error') AS invalid_actions, sum(k)::BIGINT AS input_tokens,
      CASE WHEN max(k) >= 20 THEN min(k) END AS billable_tokens, max(k) AS max_k, round(sum(reward), 2) AS latency_ms
    FROM steps GROUP BY ALL))"""

_COMMANDS = f"""commands AS (
  SELECT trajectory_id, sample_id, method, repeat_id, step_index, reward, CASE WHEN k % 19 <> 0 THEN 'take_action' END AS tool,
    {_pick(COMMANDS, "k", "step_index")} AS command, {_pick(GOALS, "sample_id", "k")} AS goal,
    'Room.' || chr(10) || 'Your task is to: ' || {_pick(GOALS, "sample_id", "k")} || ' .' || chr(10) || 'You see a shelf.' AS observation
  FROM steps)"""

_SHOP = f"""shop AS (
  SELECT trajectory_id, sample_id, method, repeat_id, step_index, reward, k,
    CASE event_type WHEN 'view' THEN 'search_action' WHEN 'error' THEN NULL ELSE 'click_action' END AS tool,
    CASE WHEN event_type = 'view' THEN 'small Ring red ' || k END AS keywords,
    CASE event_type WHEN 'purchase' THEN 'buy now' WHEN 'signup' THEN 'Back to Search' WHEN 'click' THEN {_pick(CLICKS, "k", "k")} END AS value,
    {_pick(PAGES, "k", "k")} AS before, {_pick(PAGES, "k + step_index", "k")} AS after
  FROM steps)"""

_SEGMENTS = """islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY trajectory_id ORDER BY step_index) AS run FROM (
    SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY trajectory_id ORDER BY step_index) THEN 1 ELSE 0 END AS fresh FROM steps)
), segments AS (
  SELECT trajectory_id || ':segment:' || min(step_index) || '-' || max(step_index) AS segment_id, trajectory_id, sample_id, method, repeat_id,
    min(step_index) AS start_step, max(step_index) AS end_step, event_type, count(*) AS n_steps, sum(k)::BIGINT AS k_sum
  FROM islands GROUP BY trajectory_id, sample_id, method, repeat_id, event_type, run)"""

_GOALS = """goals AS (
  SELECT p_partkey AS goal_index, lower(p_name) AS query, string_split(lower(p_name), ' ') AS attributes,
    CASE p_size % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['red'] ELSE ['red', 'large'] END AS options,
    CASE WHEN p_size % 4 <> 0 THEN p_size::DOUBLE END AS price_upper FROM part)"""

_NODES = """nodes AS (
  SELECT vec_id AS segment_id, vec_id // 10 AS trajectory_id, (vec_id % 10)::INTEGER AS start_step, label AS event_type,
    ((vec_id // 10) % 3 <> 0)::INTEGER::DOUBLE AS outcome, embedding::DOUBLE[] AS embedding FROM embeddings)"""

_TOK = "regexp_extract_all(lower({x}), '[a-z0-9]+')"


def _tok(x: str) -> str:
    return _TOK.format(x=x)


def _visible(phrase: str, text: str) -> str:
    return f"(len({_tok(phrase)}) > 0 AND list_has_all({_tok(text)}, {_tok(phrase)}))"


_V = "trim(lower(s.value))"
_ASIN = "regexp_full_match(trim(s.value), '[A-Za-z0-9]{8,16}')"
_MACHINE = f"""machine AS (
  SELECT DISTINCT trajectory_id, -1 AS step_index, 'search' AS page, false AS searched, NULL::VARCHAR AS event FROM shop
  UNION ALL
  SELECT trajectory_id, step_index, CASE WHEN e IN ('query_formulation', 'query_refinement', 'result_navigation') THEN 'results' WHEN e IN ('candidate_selection', 'option_selection', 'detail_backtracking') THEN 'item'
    WHEN e = 'attribute_inspection' THEN 'item_detail' WHEN e = 'search_backtracking' THEN 'search' WHEN e = 'purchase_decision' THEN 'terminal' ELSE page END, searched OR e IN ('query_formulation', 'query_refinement'), e
  FROM (SELECT s.trajectory_id, s.step_index, m.page, m.searched, CASE
      WHEN s.tool = 'search_action' AND s.keywords IS NOT NULL THEN CASE WHEN m.searched THEN 'query_refinement' ELSE 'query_formulation' END
      WHEN s.tool = 'click_action' AND s.value IS NOT NULL THEN CASE WHEN {_V} = 'buy now' THEN 'purchase_decision' WHEN {_V} = 'back to search' THEN 'search_backtracking'
        WHEN m.page = 'results' AND {_V} IN ('next >', '< prev') THEN 'result_navigation' WHEN m.page = 'item_detail' AND {_V} = '< prev' THEN 'detail_backtracking'
        WHEN m.page = 'item' AND {_V} IN ('description', 'features', 'reviews', 'attributes') THEN 'attribute_inspection' WHEN m.page = 'results' THEN 'candidate_selection'
        WHEN m.page = 'unknown' AND {_ASIN} THEN 'candidate_selection' WHEN m.page = 'item' AND NOT {_ASIN} THEN 'option_selection' ELSE 'other_click' END
      ELSE 'other_click' END AS e FROM machine m JOIN shop s ON s.trajectory_id = m.trajectory_id AND s.step_index = m.step_index + 1))"""

_FIRST = "string_split(after, chr(10))[1]"
_PRICES = r"list_min(list_transform(regexp_extract_all(lower(before || chr(10) || after), '(?i)(?:Price:\s*|\|\s*\$)(\d+(?:\.\d+)?)', 1), lambda x: x::DOUBLE))"
_SELECTED_N = r"(length(regexp_extract(after, '(?is)Selected:\s*\{(.*?)\}', 1)) - length(replace(regexp_extract(after, '(?is)Selected:\s*\{(.*?)\}', 1), ':', '')))"
_ANY = "len(list_filter({list}, lambda c: {test})) > 0"
_DECISIONS = f"""decided AS (
  SELECT *, coalesce(keywords, value, '') AS action FROM (SELECT s.*, m.event AS event_type FROM shop s JOIN machine m USING (trajectory_id, step_index)) s JOIN goals ON goal_index = sample_id
), decisions AS (
  SELECT *, 'webnode_' || left(sha256('{{"attribute_count":"' || attribute_count || '","event_type":"' || event_type || '","option_count":"' || option_count || '","price_signal":"' || price_signal || '","repeated_event":' || repeated_event || ',"requires_price_check":' || requires_price_check || ',"signal":"' || signal || '"}}'), 12) AS node_id FROM (
    SELECT trajectory_id, sample_id, step_index, reward, event_type, CASE len(attributes) WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'multiple' END AS attribute_count, CASE len(options) WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'multiple' END AS option_count,
      price_upper IS NOT NULL AS requires_price_check, row_number() OVER (PARTITION BY trajectory_id, event_type ORDER BY step_index) > 1 AS repeated_event,
      CASE WHEN price_upper IS NULL OR {_PRICES} IS NULL THEN 'unknown' WHEN {_PRICES} <= price_upper THEN 'within_limit' ELSE 'over_limit' END AS price_signal,
      CASE WHEN event_type IN ('query_formulation', 'query_refinement') THEN CASE WHEN contains(lower(after), 'search is not available') THEN 'query_unavailable' WHEN {_ANY.format(list="list_concat(attributes, options)", test=_visible("c", "action"))} THEN 'query_constrained' ELSE 'query_broad' END
        WHEN event_type = 'candidate_selection' THEN CASE WHEN len(list_intersect({_tok("query")}, {_tok(_FIRST)})) = 0 THEN 'candidate_weak' WHEN {_ANY.format(list="list_concat(attributes, options)", test=_visible("c", "after"))} THEN 'candidate_constrained' ELSE 'candidate_category' END
        WHEN event_type = 'option_selection' THEN CASE WHEN len(options) > 0 AND {_SELECTED_N} >= len(options) THEN 'option_complete' WHEN {_ANY.format(list="options", test=_visible("action", "c"))} THEN 'option_required' ELSE 'option_other' END
        WHEN event_type = 'attribute_inspection' THEN CASE WHEN lower(action) IN ('description', 'features', 'reviews', 'attributes') THEN 'inspect_' || lower(action) ELSE 'other' END
        WHEN event_type = 'result_navigation' THEN 'result_navigation' WHEN event_type = 'detail_backtracking' THEN 'detail_backtrack' WHEN event_type = 'search_backtracking' THEN 'search_backtrack' WHEN event_type = 'purchase_decision' THEN 'purchase' ELSE 'other' END AS signal
    FROM decided))"""
_KEYS = "event_type, attribute_count, option_count, requires_price_check, signal, price_signal, repeated_event"
_BRANCH = f"""dr AS (SELECT * REPLACE (floor(least(reward / 60, 1.0) * 1024) / 1024 AS reward) FROM decisions),
db AS (SELECT *, CASE WHEN reward >= 0.999 THEN 2 WHEN reward >= 0.5 THEN 1 ELSE 0 END AS band FROM dr),
bn AS (SELECT node_id, {_KEYS}, count(*) AS support, avg(reward) AS mean_reward, avg((band = 0)::INT) AS b0, avg((band = 1)::INT) AS b1, avg((band = 2)::INT) AS b2, count(*) AS members FROM db GROUP BY ALL),
tr AS (SELECT source, target, count(*) AS support, avg(reward) AS mean_reward, avg((band = 0)::INT) AS b0, avg((band = 1)::INT) AS b1, avg((band = 2)::INT) AS b2 FROM (SELECT node_id AS source, lead(node_id) OVER (PARTITION BY trajectory_id ORDER BY step_index) AS target, reward, band FROM db) WHERE target IS NOT NULL GROUP BY 1, 2),
ts AS (SELECT *, support / sum(support) OVER (PARTITION BY source) AS strength FROM tr),
pct AS (SELECT a.node_id AS source, b.node_id AS target, 25 * (a.event_type = b.event_type)::INT + 10 * (a.attribute_count = b.attribute_count)::INT + 10 * (a.option_count = b.option_count)::INT + 10 * (a.requires_price_check = b.requires_price_check)::INT + 25 * (a.signal = b.signal)::INT + 10 * (a.price_signal = b.price_signal)::INT + 10 * (a.repeated_event = b.repeated_event)::INT AS percent, a.event_type = b.event_type AS same_event,
  (a.b0 * b.b0 + a.b1 * b.b1 + a.b2 * b.b2) / (sqrt(a.b0 * a.b0 + a.b1 * a.b1 + a.b2 * a.b2) * sqrt(b.b0 * b.b0 + b.b1 * b.b1 + b.b2 * b.b2)) AS outcome, a.b0 AS s0, a.b1 AS s1, a.b2 AS s2, b.b0 AS t0, b.b1 AS t1, b.b2 AS t2 FROM bn a, bn b),
be AS (SELECT p.source, p.target, coalesce(support, 0) AS support, percent / 100 AS semantic, coalesce(strength, 0) AS strength, outcome, t.b0, t.b1, t.b2, s0, s1, s2, t0, t1, t2,
  CASE WHEN support > 0 THEN 0.4 * percent / 100 + 0.4 * strength + 0.2 * outcome ELSE 0.6 * percent / 100 + 0.4 * outcome END AS weight FROM pct p LEFT JOIN ts t ON t.source = p.source AND t.target = p.target WHERE support > 0 OR (same_event AND percent >= 75 AND p.source <> p.target))"""

_NEEDS = {"machine": (_MACHINE, ("shop",)), "decisions": (_DECISIONS, ("machine", "goals")), "branches": (_BRANCH, ("decisions",)), "steps": (_STEPS, ()), "episodes": (_EPISODES, ("steps",)), "commands": (_COMMANDS, ("steps",)), "shop": (_SHOP, ("steps",)), "segments": (_SEGMENTS, ("steps",)), "goals": (_GOALS, ()), "nodes": (_NODES, ())}


def sql(needs: str, body: str) -> str:
    """``body`` behind the named canonical tables; it may begin with further common tables (``name AS (...) SELECT ...``)."""
    parts: list[str] = []

    def add(name: str) -> None:
        text, before = _NEEDS[name]
        for b in before:
            add(b)
        if text not in parts:
            parts.append(text)

    for name in needs.split():
        add(name)
    body = body.strip()
    if body.lower().startswith("select"):
        return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + body
    return f"WITH RECURSIVE {', '.join([*parts, body])}"
