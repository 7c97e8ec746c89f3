"""Dirty views over the driver's tables, written once as SQL text that both
Spark and DuckDB run (``{q}`` is the identifier quote of the engine)."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "customer_dirty": """
select c_custkey as row_id, c_name as {q}Name{q},
  case when c_custkey % 11 = 0 then 'N/A'
       when c_custkey % 13 = 0 then concat('  ', c_mktsegment, ' ')
       when c_custkey % 17 = 0 then '####'
       when c_custkey % 29 = 0 then ''
       else c_mktsegment end as {q}Mkt Segment{q},
  case when c_custkey % 7 = 0 then null else c_acctbal end as acctbal,
  case when c_custkey % 19 = 0 then '?'
       when c_custkey % 23 = 0 then 'abc'
       else cast(c_nationkey as string) end as nation_txt,
  cast(null as string) as notes,
  'crm' as origin,
  case when c_custkey % 3 = 0 then null else cast(c_custkey % 4 as string) end as {q}Unnamed: 7{q},
  cast(null as string) as {q}Unnamed: 8{q}
from customer""",
    "orders_dup": """
select o_orderkey as row_id, o_custkey % 50 as cust_bucket, o_orderstatus,
  case when o_orderkey % 10 = 0 then null else o_orderpriority end as o_orderpriority
from orders""",
    "orders_text": """
select o_orderkey as row_id,
  case when o_orderkey % 9 = 0 then 'not a date'
       else cast(cast(o_orderdate as date) as string) end as order_date_txt,
  case when o_orderkey % 5 = 0 then concat('$', cast(cast(floor(o_totalprice) as bigint) as string))
       when o_orderkey % 31 = 0 then '12abc3'
       else cast(cast(floor(o_totalprice) as bigint) as string) end as total_txt,
  case o_orderkey % 6 when 0 then 'yes' when 1 then 'No' when 2 then '1'
       when 3 then 'F' when 4 then 'maybe' else null end as flag_txt
from orders""",
    "orders_ids": """
select o_orderkey as row_id, cast(9007199254740993 + o_orderkey as string) as big_txt, o_orderstatus
from orders""",
    "orders_bigint": """
select o_orderkey as row_id, cast(9007199254740993 + o_orderkey as bigint) as big_id, o_orderstatus
from orders""",
    "orders_dates": """
select o_orderkey as row_id,
  case o_orderkey % 5
    when 0 then concat(cast(month(o_orderdate) as string), '/', cast(day(o_orderdate) as string), '/',
                       cast(year(o_orderdate) as string))
    when 1 then concat(cast(cast(o_orderdate as date) as string), 'T10:11:12.5Z')
    when 2 then concat(substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(3 * month(o_orderdate) - 2 as int), 3), ' ',
                       cast(day(o_orderdate) as string), ', ', cast(year(o_orderdate) as string))
    when 3 then concat(cast(cast(o_orderdate as date) as string), ' 23:30:00+02:00')
    else concat(cast(day(o_orderdate) as string), ' ',
                substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(3 * month(o_orderdate) - 2 as int), 3), ' ',
                cast(year(o_orderdate) as string), ' 3:04 PM') end as when_txt
from orders""",
    "customer_notes": """
select c_custkey as row_id, c_name as name,
  case when c_custkey % 3 = 0 then concat('first; line', chr(10), 'says "', c_mktsegment, '"') else 'café' end as note
from customer""",
    "events_odd": """
select event_id as row_id, case when event_id % 7 = 0 then cast('NaN' as double)
  when event_id % 11 = 0 then cast('Infinity' as double) else value end as value
from events""",
    "events_gaps": """
select event_id as row_id, user_id,
  case when event_id % 8 = 0 then null else event_type end as event_type,
  case when event_id % 6 = 0 then null else value end as value, ts
from events""",
    "documents_labeled": """
select d.doc_id as row_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
from documents d left join labels l on d.doc_id = l.doc_id""",
    "documents_text": """
select doc_id as row_id, text, lang, source
from documents""",
}


def view_sql(name: str, engine: str = "spark") -> str:
    q = "`" if engine == "spark" else '"'
    return VIEWS[name].format(q=q).strip()


_NEEDS = {
    "customer_dirty": ["customer"],
    "orders_dup": ["orders"],
    "orders_text": ["orders"],
    "orders_ids": ["orders"],
    "orders_bigint": ["orders"],
    "orders_dates": ["orders"],
    "customer_notes": ["customer"],
    "events_odd": ["events"],
    "events_gaps": ["events"],
    "documents_labeled": ["documents", "labels"],
    "documents_text": ["documents"],
}


def view_over(spark: SparkSession, name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The named dirty view over the given tables; no view of the session is made or replaced."""
    text = re.sub(r"\b(from|join)\s+(" + "|".join(tables) + r")\b", r"\1 {\2}", view_sql(name, "spark"))
    return spark.sql(text, **tables)


def load_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named dirty view over the parquet tables of ``sf_dir``."""
    return view_over(spark, name, {t: spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")) for t in _NEEDS[name]})


def oracle_with(names, body: str) -> str:
    """DuckDB text: the dirty views as CTEs, then ``body``."""
    ctes = ",\n".join(f"{n} as ({view_sql(n, 'duckdb')})" for n in names)
    return f"with {ctes}\n{body.strip()}"
