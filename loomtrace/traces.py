"""Canonical trajectory tables from the driver tables.

A trajectory is one user's week: of every four weeks, counted from 2024-01-01, the first two are baseline and the others
candidate episodes, with two more ``repeat_id`` each time. Steps are numbered by (ts, event_id); all later operators order by ``step_index``, never by
input order. Every table is a lazy DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Commands of the household domain by number, with the step's entity number put in; the last is no known action.
COMMANDS = (
    "go to shelf {n}", "take mug {n} from shelf 2", "pick apple {n} from desk 1", "put mug {n} in/on shelf 3", "move mug {n} to drawer 1",
    "open drawer {n}", "close drawer {n}", "use lamp {n}", "toggle lamp {n}", "heat mug {n} with microwave 1", "clean mug {n} with sinkbasin 1",
    "cool mug {n} with fridge 1", "slice apple {n} with knife 1", "examine shelf {n}", " Inventory ", "look", "dance  {n}",
)
CLICKS = ("Buy Now", "Back to Search", "Next >", "< Prev", "Description", "Features", "B0{n}XYZ12", "red", "Attributes", "Reviews")
PAGES = (
    "WebShop search page.\nenter a query", "Search results page 1\nB01ABCDEF | small ring | $12.50", "Product: small ring {n}\nPrice: 31.75\nSelected: {{color: red; size: {n}}}",
    "Features:\n | $8.00 cotton", "Purchase completed\nscore", "nothing here",
)
GOALS = ("clean the mug", "look at a mug under the desk lamp", "find a flight case", "put a hot apple in the fridge", "cut bread and chill it")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(options: tuple[str, ...], index: F.Column, n: F.Column) -> F.Column:
    """The option with this number, ``{n}`` replaced by ``n``."""
    chosen = F.element_at(F.array(*[F.lit(o.replace("{{", "{").replace("}}", "}")) for o in options]), (index % len(options) + 1).cast("int"))
    return F.replace(chosen, F.lit("{n}"), n.cast("string"))


def weekly(events: DataFrame) -> DataFrame:
    """Events with their trajectory: trajectory_id, sample_id, method, repeat_id, ts, event_type, k, reward, event_id, week. Row by row, so
    of a stream as well."""
    e = events.select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    e = e.withColumn("week", F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7).cast("int"))
    return e.select(
        F.concat(F.lit("u"), "user_id", F.lit("-w"), "week").alias("trajectory_id"), F.col("user_id").alias("sample_id"), F.when(F.pmod("week", F.lit(4)) < 2, "baseline").otherwise("candidate").alias("method"),
        (2 * F.floor(F.col("week") / 4) + F.pmod("week", F.lit(2))).cast("int").alias("repeat_id"), "ts", "event_type", "k", F.col("value").alias("reward"), "event_id", "week",
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trajectory_id, sample_id, method, repeat_id, step_index, event_type, k, reward, event_id."""
    n = F.row_number().over(Window.partitionBy("sample_id", "week").orderBy("ts", "event_id")) - 1
    return weekly(read(spark, sf_dir, "events")).select("trajectory_id", "sample_id", "method", "repeat_id", n.alias("step_index"), "event_type", "k", "reward", "event_id")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trajectory: primary_score = purchases / max(purchases + errors, 1), steps, invalid_actions, tokens."""
    count = lambda e: F.count_if(F.col("event_type") == e)
    g = steps(spark, sf_dir).groupBy("trajectory_id", "sample_id", "method", "repeat_id").agg(
        (count("purchase") / F.greatest(count("purchase") + count("error"), F.lit(1))).alias("primary_score"), F.count("*").alias("steps"), count("error").alias("invalid_actions"), F.sum("k").alias("input_tokens"),
        F.when(F.max("k") >= 20, F.min("k")).alias("billable_tokens"), F.max("k").alias("max_k"), F.round(F.sum("reward"), 2).alias("latency_ms"),
    )
    return g.withColumn("success", F.col("primary_score") >= 0.999)


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the household domain: tool, command and goal."""
    s = steps(spark, sf_dir)
    return s.select(
        "trajectory_id", "sample_id", "method", "repeat_id", "step_index", "reward", F.when(F.col("k") % 19 != 0, "take_action").alias("tool"), pick(COMMANDS, F.col("k"), F.col("step_index")).alias("command"),
        pick(GOALS, F.col("sample_id"), F.col("k")).alias("goal"), F.concat(F.lit("Room.\nYour task is to: "), pick(GOALS, F.col("sample_id"), F.col("k")), F.lit(" .\nYou see a shelf.")).alias("observation"),
    )


def shop_action() -> list[Column]:
    """Tool, keywords and clicked value of a step of the shop domain."""
    tool = F.when(F.col("event_type") == "view", "search_action").when(F.col("event_type") == "error", F.lit(None)).otherwise("click_action")
    value = F.when(F.col("event_type") == "purchase", "buy now").when(F.col("event_type") == "signup", "Back to Search").when(F.col("event_type") == "click", pick(CLICKS, F.col("k"), F.col("k")))
    return [tool.alias("tool"), F.when(F.col("event_type") == "view", F.concat(F.lit("small Ring red "), "k")).alias("keywords"), value.alias("value")]


def shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the shop domain: tool with keywords or a clicked value, pages before and after."""
    return steps(spark, sf_dir).select(
        "trajectory_id", "sample_id", "method", "repeat_id", "step_index", "reward", "k", *shop_action(), pick(PAGES, F.col("k"), F.col("k")).alias("before"), pick(PAGES, F.col("k") + F.col("step_index"), F.col("k")).alias("after"),
    )


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goal dimension: one row per sample, from parts."""
    p = read(spark, sf_dir, "part")
    attributes = F.split(F.lower("p_name"), " ")
    options = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).when(F.col("p_size") % 3 == 1, F.array(F.lit("red"))).otherwise(F.array(F.lit("red"), F.lit("large")))
    return p.select(F.col("p_partkey").alias("goal_index"), F.lower("p_name").alias("query"), attributes.alias("attributes"), options.alias("options"), F.when(F.col("p_size") % 4 != 0, F.col("p_size").cast("double")).alias("price_upper"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with vectors: segment_id, trajectory_id, start_step, event_type, outcome, embedding."""
    v = read(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("segment_id"), F.floor(F.col("vec_id") / 10).alias("trajectory_id"), (F.col("vec_id") % 10).cast("int").alias("start_step"), F.col("label").alias("event_type"), (F.floor(F.col("vec_id") / 10) % 3 != 0).cast("double").alias("outcome"), F.col("embedding").cast("array<double>").alias("embedding"))
