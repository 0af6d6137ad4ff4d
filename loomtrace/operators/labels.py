"""Labelling of steps: action parsers, page types, events, decision keys. Rule tables are data; the first rule that holds wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx

#: Command prefixes and their primitive actions, in order.
PREFIXES = (
    ("go to ", "goto"), ("take ", "pick"), ("pick ", "pick"), ("put ", "put"), ("move ", "put"), ("open ", "open"), ("close ", "close"), ("use ", "toggle"),
    ("toggle ", "toggle"), ("heat ", "heat"), ("clean ", "clean"), ("cool ", "cool"), ("slice ", "slice"), ("examine ", "examine"),
)
#: Event label of each primitive action.
PRIMITIVE_EVENTS = {
    "goto": "goto_location", "pick": "pickup_object", "put": "put_object", "open": "open_object", "close": "close_object", "toggle": "toggle_object", "slice": "slice_object",
    "clean": "clean_object", "heat": "heat_object", "cool": "cool_object", "inventory": "scan", "examine": "scan", "look": "scan", "invalid": "invalid_action",
}
#: Phrases in a goal that call for an event (substrings, so "flight" holds "light").
GOAL_PHRASES = {
    "clean_object": ("clean", "wash", "washed", "wet", "rinse", "rinsed"), "heat_object": ("heat", "heated", "hot", "warm", "microwaved", "cooked"),
    "cool_object": ("cool", "cooled", "cold", "chill", "chilled", "frozen"), "slice_object": ("slice", "sliced", "cut"), "toggle_object": ("lamp", "light", "turn on", "toggle", "illuminate"),
}
#: Fixed value: the first line of a search page, lower-cased, as logs have it.
SEARCH_PAGE = "webshop search page."
#: Details of a product page, page types with the events that are legal on them, and the page that follows an event.
DETAILS = ("description", "features", "reviews", "attributes")
PAGE_EVENTS = {
    "search": ("query_formulation", "query_refinement"), "results": ("candidate_selection", "result_navigation", "search_backtracking"),
    "item": ("attribute_inspection", "option_selection", "purchase_decision", "search_backtracking"), "item_detail": ("detail_backtracking", "search_backtracking"),
}
NEXT_PAGE = {
    "query_formulation": "results", "query_refinement": "results", "result_navigation": "results", "candidate_selection": "item", "option_selection": "item",
    "attribute_inspection": "item_detail", "detail_backtracking": "item", "search_backtracking": "search", "purchase_decision": "terminal",
}
SHOP_EVENTS = ("query_formulation", "query_refinement", "candidate_selection", "result_navigation", "option_selection", "attribute_inspection", "detail_backtracking", "search_backtracking", "purchase_decision", "other_click")
#: Kinds of clickable values that the state machine asks for.
PRODUCT_LINK, OPTION = "product_link", "option"
COUNTS, PRICE_SIGNALS = ("zero", "one", "multiple"), ("unknown", "within_limit", "over_limit")
SIGNALS = (
    "query_broad", "query_constrained", "query_unavailable", "candidate_weak", "candidate_category", "candidate_constrained", "option_required", "option_other", "option_complete",
    "inspect_description", "inspect_features", "inspect_attributes", "inspect_reviews", "result_navigation", "detail_backtrack", "search_backtrack", "purchase", "other",
)


def lookup(table: dict, key: Column, otherwise: Column | None = None) -> Column:
    out = F.lit(None) if otherwise is None else otherwise
    for k, v in reversed(list(table.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def household_action(tool: Column, command: Column) -> Column:
    """Primitive action of a command; a prefix must leave something behind it."""
    a = F.trim(F.lower(command))
    out = F.lit("invalid")
    for prefix, action in reversed(PREFIXES):
        out = F.when(a.startswith(prefix) & (F.length(a) > len(prefix)), action).otherwise(out)
    out = F.when(a.isin("inventory", "look"), a).otherwise(out)
    return F.when((tool == "take_action") & command.isNotNull(), out).otherwise("invalid")


def shop_action(tool: Column, keywords: Column, value: Column) -> Column:
    return F.when((tool == "search_action") & keywords.isNotNull(), "search").when((tool == "click_action") & value.isNotNull(), "click").otherwise("invalid")


def event_of(primitive: Column) -> Column:
    return lookup(PRIMITIVE_EVENTS, primitive)


def page_type(observation: Column) -> Column:
    line = F.trim(F.lower(tx.first_line(observation)))
    detail = F.lit(False)
    for d in DETAILS:
        detail = detail | line.startswith(f"{d}:")
    return (
        F.when(line == SEARCH_PAGE, "search").when(line.startswith("search results page"), "results").when(line.startswith("product:"), "item")
        .when(detail, "item_detail").when(line.startswith("purchase completed"), "terminal").otherwise("unknown")
    )


def legal_events(page: Column) -> Column:
    out = F.array(F.lit("other_click"))
    for p, events in PAGE_EVENTS.items():
        out = F.when(page == p, F.array(*[F.lit(e) for e in sorted(events)])).otherwise(out)
    return out


def goal_events(goal: Column) -> Column:
    g = F.lower(goal)
    hits = []
    for event, phrases in sorted(GOAL_PHRASES.items()):
        found = F.lit(False)
        for p in phrases:
            found = found | g.contains(p)
        hits.append(F.when(found, event))
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


#: Where an observation names its goal, anywhere and as a line of its own.
GOAL, GOAL_LINE = r"(?i)your task is to:\s*(.+?)(?:\n|$)", r"(?im)^your task is to:\s*(.+?)\s*$"


def observed_goal(observation: Column) -> Column:
    """Goal behind "your task is to:", normalised; empty if there is none."""
    return tx.normalise(F.regexp_extract(observation, GOAL, 1))


def observed_goal_or(observation: Column, task_goal: Column) -> Column:
    """The same with its case kept; the task's goal where nothing is observed."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(observation, GOAL, 1)), F.lit("")), task_goal)


def line_goal(observation: Column) -> Column:
    """Goal of a line that begins with the words, case kept."""
    return F.trim(F.regexp_extract(observation, GOAL_LINE, 1))


def reward_band(score: Column) -> Column:
    return F.when(score >= 0.999, "exact").when(score >= 0.5, "partial").otherwise("low")


def count_bucket(n: Column) -> Column:
    return F.when(n == 0, "zero").when(n == 1, "one").otherwise("multiple")


def price_signal(text: Column, limit: Column) -> Column:
    least = F.array_min(tx.prices(text))
    return F.when(limit.isNull() | least.isNull(), "unknown").when(least <= limit, "within_limit").otherwise("over_limit")


def classify_shop(rows: DataFrame, trajectory: str = "trajectory_id") -> DataFrame:
    """Adds ``shop_event``: the page-state machine over a trajectory's ordered steps, as a fold with state (page, searched).

    A column ``clickable_types`` (map of clickable values to their kinds), if there, tells candidates and options by
    ``PRODUCT_LINK`` and ``OPTION``; steps without clickable types select them by exclusion."""
    types = F.col("clickable_types") if "clickable_types" in rows.columns else F.lit(None).cast("map<string,string>")
    kinds = F.array_sort(F.transform(F.map_entries(types), lambda e: F.struct(F.lower(e["key"]).alias("clickable"), F.lower(e["value"]).alias("kind"))))
    step = F.struct("step_index", "tool", "keywords", "value", F.coalesce(kinds, F.array().cast("array<struct<clickable:string,kind:string>>")).alias("kinds"))
    seq = rows.groupBy(trajectory).agg(F.array_sort(F.collect_list(step)).alias("seq"))
    state = F.struct(F.lit("search").alias("page"), F.lit(False).alias("searched"), F.array().cast("array<string>").alias("out"))
    asin = r"^[A-Za-z0-9]{8,16}$"

    def fold(s: Column, x: Column) -> Column:
        v, page = F.trim(F.lower(x["value"])), s["page"]
        is_asin, untyped = F.trim(x["value"]).rlike(asin), F.size(x["kinds"]) == 0
        kind = F.coalesce(F.get(F.filter(x["kinds"], lambda c: c["clickable"] == v), F.lit(0))["kind"], F.lit(""))
        candidate = (page == "results") & (untyped | (kind == PRODUCT_LINK))
        option = (page == "item") & F.when(untyped, ~is_asin).otherwise(kind == OPTION)
        click = (
            F.when(v == "buy now", "purchase_decision").when(v == "back to search", "search_backtracking")
            .when((page == "results") & v.isin("next >", "< prev"), "result_navigation").when((page == "item_detail") & (v == "< prev"), "detail_backtracking")
            .when((page == "item") & v.isin(*DETAILS), "attribute_inspection").when(candidate | ((page == "unknown") & is_asin), "candidate_selection")
            .when(option, "option_selection").otherwise("other_click")
        )
        event = (
            F.when((x["tool"] == "search_action") & x["keywords"].isNotNull(), F.when(s["searched"], "query_refinement").otherwise("query_formulation"))
            .when((x["tool"] == "click_action") & x["value"].isNotNull(), click).otherwise("other_click")
        )
        return F.struct(lookup(NEXT_PAGE, event, page).alias("page"), (s["searched"] | event.isin("query_formulation", "query_refinement")).alias("searched"), F.concat(s["out"], F.array(event)).alias("out"))

    folded = seq.select(trajectory, F.arrays_zip(F.col("seq.step_index").alias("step_index"), F.aggregate("seq", state, fold, lambda s: s["out"]).alias("shop_event")).alias("z"))
    flat = folded.select(trajectory, F.explode("z").alias("z")).select(trajectory, "z.*")
    return rows.join(flat, [trajectory, "step_index"])


def decision_signal(event: Column, action: Column, before: Column, after: Column, query: Column, attributes: Column, options: Column) -> Column:
    constraints = F.concat(attributes, options)
    covered = F.exists(constraints, lambda c: tx.phrase_visible(c, action))
    category = F.size(F.array_intersect(tx.terms(query), tx.terms(tx.first_line(after)))) > 0
    constraint = F.exists(constraints, lambda c: tx.phrase_visible(c, after))
    complete = (F.size(options) > 0) & (tx.selected_count(after) >= F.size(options))
    asked = F.exists(options, lambda o: tx.phrase_visible(action, o))
    return (
        F.when(event.isin("query_formulation", "query_refinement"), F.when(F.lower(after).contains("search is not available"), "query_unavailable").when(covered, "query_constrained").otherwise("query_broad"))
        .when(event == "candidate_selection", F.when(category & constraint, "candidate_constrained").when(category, "candidate_category").otherwise("candidate_weak"))
        .when(event == "option_selection", F.when(complete, "option_complete").when(asked, "option_required").otherwise("option_other"))
        .when(event == "attribute_inspection", lookup({d: f"inspect_{d}" for d in DETAILS}, F.lower(action), F.lit("other")))
        .otherwise(lookup({"result_navigation": "result_navigation", "detail_backtracking": "detail_backtrack", "search_backtracking": "search_backtrack", "purchase_decision": "purchase"}, event, F.lit("other")))
    )


def decisions(shop: DataFrame, goals: DataFrame) -> DataFrame:
    """Shop steps with their decision key (seven fields) and its node id. The goal dimension is joined by the sample's number."""
    rows = classify_shop(shop).join(goals, F.col("sample_id") == F.col("goal_index"))
    repeated = F.row_number().over(Window.partitionBy("trajectory_id", "shop_event").orderBy("step_index")) > 1
    action = F.coalesce("keywords", "value", F.lit(""))
    keyed = rows.select(
        "*", F.col("shop_event").alias("event_type"), count_bucket(F.size("attributes")).alias("attribute_count"), count_bucket(F.size("options")).alias("option_count"), F.col("price_upper").isNotNull().alias("requires_price_check"),
        decision_signal(F.col("shop_event"), action, F.col("before"), F.col("after"), F.col("query"), F.col("attributes"), F.col("options")).alias("signal"),
        price_signal(F.lower(F.concat_ws("\n", "before", "after")), F.col("price_upper")).alias("price_signal"), repeated.alias("repeated_event"),
    )
    return keyed.withColumn("node_id", node_id())


KEY = ("event_type", "attribute_count", "option_count", "requires_price_check", "signal", "price_signal", "repeated_event")


def node_id() -> Column:
    """Content id of a decision key: SHA-256 over its canonical JSON (sorted names, no blanks)."""
    part = lambda c, quoted=True: F.concat(F.lit(f'"{c}":' + ('"' if quoted else "")), F.col(c).cast("string"), F.lit('"' if quoted else ""))
    fields = [part(c, c not in ("requires_price_check", "repeated_event")) for c in sorted(KEY)]
    return F.concat(F.lit("webnode_"), F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")), 256), 1, 12))


def decision_vector() -> Column:
    """39 numbers: one-hot events, counts, signals and price signals, then the two flags."""
    hot = vx.one_hot
    return F.concat(hot(SHOP_EVENTS, F.col("event_type")), hot(COUNTS, F.col("attribute_count")), hot(COUNTS, F.col("option_count")), hot(SIGNALS, F.col("signal")), hot(PRICE_SIGNALS, F.col("price_signal")), F.array(F.col("requires_price_check").cast("double"), F.col("repeated_event").cast("double")))
