"""Views over the test tables with the shape the library works on.

The SELECTs run in Spark SQL and DuckDB; ``{table}`` stands for a table. ``{nan}`` is NaN in
Spark and NULL in DuckDB: to the library both mean that a value is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrank.session import dealt
from tallyrank.spec import Terms

TERMS = Terms(
    names=("red", "blue", "small", "old", "large"),
    places=("nation_1", "nation_2", "nation_3", "nation_5", "nation_7", "nation_12", "nation_24"),
    song_text=("ring",),
    song_name=("hot",),
    topic=(
        "promo", "economy", "standard", "medium", "brand#1", "brand#2",
        "widget", "plate", "gear", "bolt", "rod", "anvil",
    ),
)
GROUP_TERM = "red"
TEXT_TERMS = ("sing", "ing", "the")
SOURCE_TERMS = ("src1", "src10")
DEFAULT = {"id": -1, "title": "no match", "rating": 0.0, "image": "img/none", "link": "vid/none"}

# settings of the boosting and search queries
ROUNDS = 3
BOOSTED = (("linear", 0.25), ("square", 0.5), ("exponential", 0.6))
DRAWS, FOLDS, SEED, TURNS = 2, 4, 7, 2
# rounds that the searches of retrain_until draw from; random_search draws from the whole range of training
SEARCH_ROUNDS = (3, 9)

#: Lines of a partition when they are joined with their parts.
LINE_ROWS = 500_000

NAN = "cast('NaN' as double)"

ITEMS = """
select o_orderkey as id, concat(o_orderpriority, ' ', o_orderstatus) as title,
  case when o_orderkey % 19 = 0 then null else cast(o_orderdate as date) end as air_date,
  cast(year(o_orderdate) - 1994 as bigint) as season,
  cast(month(o_orderdate) as bigint) as number_in_season,
  case when o_orderkey % 10 = 0 then null else o_totalprice / cast(20000 as double) end as viewers,
  case when o_orderkey % 13 = 0 then null when o_orderkey % 17 = 0 then {nan}
       else cast(floor(10 + 90 * o_totalprice / 500000) as double) / cast(10 as double) end as rating,
  concat('img/', cast(o_orderkey as varchar(20))) as image,
  concat('vid/', cast(o_orderkey as varchar(20))) as link
from {orders}
"""

LINES = """
select l_orderkey as item_id,
  case when l_suppkey % 17 = 0 then null else p_name end as who,
  case when l_suppkey % 23 = 0 then null else l_suppkey end as place_id,
  n_name as place,
  concat(p_type, ' ', p_name, ' ', p_brand) as txt,
  case when l_linenumber = 7 then null else l_linestatus = 'F' end as speaking,
  case when l_suppkey % 31 = 0 then {nan} else l_quantity * 3 end as words
from {lineitem}
join {part} on l_partkey = p_partkey
join {supplier} on l_suppkey = s_suppkey
join {nation} on s_nationkey = n_nationkey
"""

SERIES = """
select event_id, user_id, case when event_id % 7 in (0, 1) then null when event_id % 11 = 3 then {nan} else value end as value
from {events}
"""


def pick(column: str, values) -> str:
    """SQL that picks ``values[column]``, and the last value beyond the list."""
    cases = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values[:-1]))
    return f"case {column} {cases} else '{values[-1]}' end"


REQUESTS = f"""
select c_custkey as request_id,
  {pick('c_custkey % 6', (*TERMS.names, 'unheard'))} as name,
  {pick('c_custkey % 7', TERMS.places)} as place,
  {pick('c_custkey % 2', ('Characters', 'Location'))} as priority,
  {pick('c_custkey % 3', ('True', 'False', 'true'))} as song,
  {pick('c_custkey % 5', ('False', 'True', 'False', 'False', 'True'))} as politics
from {{customer}}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str, *tables: str, **given: DataFrame) -> DataFrame:
    return spark.sql(sql.replace("{nan}", NAN), **{t: table(spark, sf_dir, t) for t in tables}, **given)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ITEMS, "orders")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are dealt by part first where there are many: with many parts the join sorts them."""
    many = dealt(table(spark, sf_dir, "lineitem"), "l_partkey", LINE_ROWS)
    return _view(spark, sf_dir, LINES, "part", "supplier", "nation", lineitem=many)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SERIES, "events")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, REQUESTS, "customer")


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line of text of every document."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"), "lang", "source"
    )


# The same views for DuckDB, as common table expressions.
_NAMES = ("orders", "lineitem", "part", "supplier", "nation", "events", "customer")


def _duck(sql: str) -> str:
    return sql.format(nan="null", **{t: t for t in _NAMES})


CTE = {
    "items": _duck(ITEMS),
    "lines": _duck(LINES),
    "series": _duck(SERIES),
    "requests": _duck(REQUESTS),
    "text_lines": """
select doc_id, unnest(string_split(text, chr(10))) as line, lang, source from documents
""",
}
