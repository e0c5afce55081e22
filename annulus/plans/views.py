"""Genomic relations derived from the star-schema tables by integer arithmetic, the same in Spark and in any SQL engine.

``spark_view`` gives a DataFrame, ``SQL`` the same relation as a common table expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: name -> (tables it reads, query). Plain SQL that both engines understand; div is written as (a - a % b) / b cast to bigint.
SQL = {
    # a call for each distinct line of an order
    "sv": """select distinct ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey as ord,
        concat('sv', l_orderkey, '_', l_linenumber) as sv_id,
        concat('chr', 1 + l_suppkey % 22) as chr1, 10000 + (l_partkey * 997) % 1000000 as pos1,
        case when l_linenumber < 5 then concat('chr', 1 + l_suppkey % 22) else concat('chr', 1 + l_partkey % 22) end as chr2,
        10000 + (l_partkey * 997) % 1000000 + (l_orderkey * 131) % 200000 as pos2,
        case l_linenumber % 5 when 0 then 'DEL' when 1 then 'DUP' when 2 then 'INV' when 3 then 'BND' else 'TRA' end as svtype,
        (l_orderkey * 131) % 200000 as svlen,
        case l_suppkey % 4 when 0 then '+-' when 1 then '-+' when 2 then '++' else '--' end as strand,
        cast(floor(l_quantity) as bigint) as dv, l_partkey % 40 as dr, '0/1' as gt, l_linenumber = 7 as secondary, cast(null as {string}) as mate, cast(null as {string}) as error
        from lineitem""",
    # runs of 50 bases for each part, laid along 22 chromosomes
    "coverage": """select concat('chr', 1 + p_partkey % 22) as chr, cast((p_partkey - p_partkey % 22) / 22 as bigint) * 50 as start,
        cast((p_partkey - p_partkey % 22) / 22 as bigint) * 50 + 50 as "end", cast(p_size as double) as value from part""",
    "chrom": """select concat('chr', 1 + p_partkey % 22) as chr, max(cast((p_partkey - p_partkey % 22) / 22 as bigint) * 50 + 50) as length from part group by 1""",
    # cuts on the same chromosomes, one for each supplier
    "cut": """select concat('chr', 1 + s_suppkey % 22) as chr, 20 + (s_suppkey * 7919) % (select max(cast((p_partkey - p_partkey % 22) / 22 as bigint)) * 50 + 20 from part) as pos, s_suppkey as ord, 0 as side from supplier""",
    # an aligned read for each event
    "read": """select concat('r', event_id) as name, concat('chr', 1 + user_id % 22) as chr, (event_id * 7919) % 1000000 as ref_start,
        (event_id * 7919) % 1000000 + 500 + (user_id * 37) % 5000 as ref_end, 500 + (user_id * 37) % 5000 as query_length, event_id % 17 <> 0 as is_mapped, event_id % 5 = 0 as is_secondary from events""",
    # a signed path for each order: its lines' parts, inverted where the line came back
    "path_step": """select l_orderkey as circ_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as i,
        case when l_returnflag = 'R' then -l_partkey else l_partkey end as x from lineitem""",
    "circle_fragment": """select l_orderkey as circ_id, l_partkey as fid, count(*) as mult, max(cast(1000 + l_partkey % 5000 as double)) as len from lineitem group by 1, 2""",
    # pieces of circles on the genome, in order
    "piece": """select l_orderkey as circ_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as i,
        concat('chr', 1 + l_orderkey % 5 + case when l_partkey % 11 = 0 then 1 else 0 end) as chr, (l_orderkey % 50) * 100000 + (l_partkey % 40) * 700 as start,
        (l_orderkey % 50) * 100000 + (l_partkey % 40) * 700 + 600 + (l_suppkey % 7) * 900 as "end", case when l_returnflag = 'R' then '-' else '+' end as strand,
        concat('f', l_partkey % 40) as frag, cast(l_quantity as double) as cov from lineitem""",
    # a graph of which every order is a part: a fragment for each of its lines; ids follow from order and line, of which there are fewer than 64
    "order_fragment": """select 4 * r + 1 as fid, concat('chr', 1 + l_orderkey % 22) as chr, n * 5000 as start, n * 5000 + 300 + (l_partkey % 9) * 500 as "end",
        4 * r + 2 as tail, 4 * r + 3 as head, 4 * r + 4 as edge_id, cast(l_quantity as double) as coverage, cast(300 + (l_partkey % 9) * 500 as double) as len, l_orderkey as grp, n, m,
        n > 1 and l_returnflag = 'R' as minus
        from (select *, l_orderkey * 64 + n as r from (select *, count(*) over (partition by l_orderkey) as m,
              row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as n from lineitem) q) t""",
    # a fragment for each part
    "part_fragment": """select 4 * (p_partkey - 1) + 1 as fid, concat('chr', 1 + p_partkey % 22) as chr, p_partkey * 5000 as start, p_partkey * 5000 + 300 + p_size * 50 as "end", cast(p_size as double) as coverage from part where p_partkey > 0""",
    # reads as long as those of events, laid on the tracked part of the chromosomes
    "near_read": """select concat('r', event_id) as name, concat('chr', 1 + user_id % 22) as chr, (event_id * 7919) % span as ref_start,
        (event_id * 7919) % span + 500 + (user_id * 37) % 5000 as ref_end, 500 + (user_id * 37) % 5000 as query_length, event_id % 17 <> 0 as is_mapped, event_id % 5 = 0 as is_secondary
        from events cross join (select max(cast((p_partkey - p_partkey % 22) / 22 as bigint)) * 50 + 20 as span from part) s""",
}

NEEDS = {"sv": ["lineitem"], "coverage": ["part"], "chrom": ["part"], "cut": ["supplier", "part"], "read": ["events"], "path_step": ["lineitem"], "circle_fragment": ["lineitem"], "piece": ["lineitem"], "order_fragment": ["lineitem"], "part_fragment": ["part"], "near_read": ["events", "part"]}


def spark_view(spark: SparkSession, sf_dir: str, name: str, *, repeats: bool = False) -> DataFrame:
    """The relation, read from the tables' files; tables are named only inside the query, so sessions stay clean.

    repeats: a relation of distinct rows with all their repeats, for steps that these change nothing in, or that drop them later.
    """
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in NEEDS[name]}
    text = SQL[name].replace("{string}", "string").replace('"end"', "`end`")
    if repeats:
        text = text.replace("select distinct", "select", 1)
    for t in NEEDS[name]:
        text = re.sub(rf"from {t}\b", f"from {{{t}}}", text)
    return spark.sql(text, **tables)


def duck(*names: str, more: str = "") -> str:
    """WITH clause of the relations. Each is computed once, however often it is named."""
    parts = [f"{n} as ({SQL[n].replace('{string}', 'varchar')})" for n in names]
    text = ",\n".join(parts) + (",\n" + more if more else "")
    return "with recursive " + re.sub(r"(\w) as \((select|with)", r"\1 as materialized (\2", text) + "\n"
