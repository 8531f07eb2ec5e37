"""Deterministic views over the driver's tables that have the operators' input shapes.

The texts run on both engines: <name> stands for a table, <emb:k> for the k-th number of an embedding.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "motion": """select l_orderkey * 10 + l_linenumber as id, l_orderkey as entity, l_quantity as px, l_discount * 100e0 as py, l_tax * 100e0 as pz,
        l_tax * 100e0 as gx, l_quantity as gy, l_discount * 100e0 as gz, l_discount as plo, l_tax as phi, l_quantity / 50e0 as glo, l_tax as ghi,
        case l_returnflag when 'A' then 'B' when 'N' then 'C' end as ptype, case l_linestatus when 'O' then 'B' else 'C' end as gtype from <lineitem>""",
    "objects": """select l_orderkey * 10 + l_linenumber as id, cast(p_size as double) as p0, p_retailprice / 100e0 as p1, l_quantity as p2,
        l_quantity as g0, p_size * 1.1e0 as g1, p_retailprice / 90e0 as g2, l_extendedprice / 1000e0 as pmass, p_retailprice / 50e0 as gmass,
        case when l_linenumber = 7 then null else p_type end as pcat, case when l_linenumber % 2 = 0 then upper(p_type) else p_brand end as gcat
        from <lineitem> join <part> on l_partkey = p_partkey""",
    "phys": """select l_orderkey * 10 + l_linenumber as id, l_orderkey as entity, p_partkey as part,
        case p_partkey % 6 when 0 then 'metal' when 1 then 'plastic' when 2 then 'wood' when 3 then 'glass' when 4 then 'rubber' else 'other' end as material,
        p_retailprice * 8e0 as density, l_quantity * 4e9 as young, p_size * 20e0 as hardness, l_discount * 6e0 as poisson, l_tax * 40e0 as friction,
        l_linenumber as affordance, l_returnflag = 'A' as graspable, l_extendedprice / 1e6 as volume,
        case when l_linenumber = 3 then null else p_retailprice * 7e0 end as g_density, l_extendedprice * 1e5 as g_young, p_size * 25e0 as g_hardness,
        l_discount * 5e0 as g_poisson, l_tax * 30e0 as g_friction, p_size % 5 as g_affordance, l_linestatus = 'O' as g_graspable,
        case l_suppkey % 6 when 0 then 'metal' when 1 then 'plastic' when 2 then 'wood' when 3 then 'glass' when 4 then 'rubber' else 'other' end as g_material
        from <lineitem> join <part> on l_partkey = p_partkey""",
    "members": "select l_orderkey as id, l_partkey % 7 as p, l_suppkey % 7 as g from <lineitem>",
    "points": """select vec_id as idx, cast(label as bigint) as part, cast(<emb:0> as double) as x, cast(<emb:1> as double) as y, cast(<emb:2> as double) as z,
        cast(<emb:3> as double) as nx, cast(<emb:4> as double) as ny, cast(<emb:5> as double) as nz, cast(floor(abs(<emb:6>) * 100) as bigint) % 256 as r,
        cast(floor(abs(<emb:7>) * 100) as bigint) % 256 as g, cast(floor(abs(<emb:8>) * 100) as bigint) % 256 as b from <embeddings>""",
    "pixels": """select cast(l_linenumber as bigint) as view, l_orderkey % 64 as prow, l_partkey % 64 as pcol, l_partkey % 500 as face, l_suppkey % 10 as mask,
        l_orderkey * 10 + l_linenumber as seq from <lineitem>""",
    "bits": "select user_id as mask, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, case when event_type = 'click' then 1 else 0 end as bit from <events>",
    "boxes": """select l_orderkey * 10 + l_linenumber as id, l_orderkey % 50 as grp, l_quantity as x0, l_discount * 500e0 as y0, l_quantity + 5 + l_tax * 100e0 as x1,
        l_discount * 500e0 + 5 + l_tax * 100e0 as y1, l_extendedprice as score from <lineitem>""",
    "baskets": "select distinct l_orderkey as basket, l_partkey % 20 as item from <lineitem>",
    "edges": """select p_partkey % 40 as entity, p_partkey % 11 + 1 as src, p_size % 11 + 1 as dst,
        case p_partkey % 7 when 0 then 'D' when 1 then 'B' when 2 then 'C' else 'A' end as kind, p_partkey as seq, cast(p_size as double) as lo, p_retailprice as hi from <part>
        where p_partkey % 11 <> p_size % 11""",
    "faces": """select p_partkey as fid, p_partkey % 500 as v0, (p_partkey + 1) % 500 as v1, (p_partkey + 7) % 500 as v2, p_partkey % 10 as part from <part>""",
    # boxes (label 0) and tetrahedra (label 1) with their sides and their least corner
    "solids": """select s_suppkey as id, s_nationkey as nation, cast(floor(s_suppkey / 2) as bigint) as entity, s_suppkey % 2 as label, 1.13e0 + s_suppkey % 7 as a, 1.37e0 + s_nationkey % 5 as b,
        1.71e0 + s_suppkey % 3 as c, 0.0317e0 + s_nationkey * 0.0131e0 as ox, 0.0533e0 + s_suppkey % 11 * 0.0172e0 as oy, 0.0719e0 + s_suppkey % 5 * 0.0191e0 as oz from <supplier>""",
    # a customer's orders as the bodies of one object: every fourth hangs on the one before, the others on the one at half their number
    "bodies": """select entity, part, case when part = 0 then null when part % 4 = 3 then part - 1 else cast(floor((part - 1) / 2) as bigint) end as parent, kind,
        px, py, pz, ax, ay, az, lo, hi, damping from (select o_custkey as entity, row_number() over (partition by o_custkey order by o_orderkey) - 1 as part,
        case o_orderstatus when 'F' then 'B' when 'O' then 'C' end as kind, (o_orderkey % 400) / 100e0 as px, (o_custkey % 300) / 100e0 as py, (o_orderkey % 7) / 4e0 as pz,
        o_orderkey % 2 * 1e0 as ax, 1e0 - o_orderkey % 2 as ay, 0e0 as az, -(o_orderkey % 5) / 8e0 as lo, (o_orderkey % 9) / 8e0 as hi, (o_orderkey % 3) / 2e0 as damping from <orders>) o""",
    "messages": "select conv_id, turn, role, text from <conversations>",
    "frames": "select user_id as object, row_number() over (partition by user_id order by ts, event_id) - 1 as frame, event_type, value from <events>",
    # clicks are prompts; every third error removes the object and every third resets it
    "shots": """select user_id as object, row_number() over (partition by user_id order by ts, event_id) - 1 as frame, ts,
        case when event_type = 'click' then 'prompt' when event_type = 'error' and event_id % 3 = 0 then 'remove' when event_type = 'error' and event_id % 3 = 1 then 'reset' else 'frame' end as kind from <events>""",
    "stage_log": """select user_id % 97 as entity, event_type as stage, case when value < 20 then 'failed' when value < 40 then 'running' else 'succeeded' end as status,
        ts, event_id from <events>""",
    "annotations": """select o_custkey as entity, o_orderkey as part, o_orderstatus as status, o_totalprice as price, o_orderpriority as priority, c_mktsegment as category,
        c_acctbal as acctbal from <orders> join <customer> on o_custkey = c_custkey""",
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = re.sub(r"<emb:(\d+)>", r"embedding[\1]", VIEWS[name])
    return spark.sql(re.sub(r"<(\w+)>", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", text))


def duck(name: str) -> str:
    text = re.sub(r"<emb:(\d+)>", lambda m: f"embedding[{int(m[1]) + 1}]", VIEWS[name])
    return re.sub(r"<(\w+)>", r"\1", text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(text: str) -> str:
    """SQL with {view} placeholders, for the oracle."""
    return re.sub(r"\{([a-z_]+)\}", lambda m: f"({duck(m[1])})", text)
