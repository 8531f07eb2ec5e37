"""Queries of body trees: paths, roles of bodies in a motion, and models in XML."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bodies as B
from .registry import query
from .views import view

c = F.col

#: Bodies with path and level, from the root down.
TREE = """with recursive b as (select * from {bodies}),
t as (select *, lpad(part::varchar, 10, '0') as path, 0 as level from b where parent is null
    union all select b.*, t.path || '/' || lpad(b.part::varchar, 10, '0'), t.level + 1 from b join t on b.entity = t.entity and b.parent = t.part)"""


@query(f"{TREE} select entity, part, path, level::int as level, null::varchar as error from t")
def body_paths(spark, sf_dir):
    return B.body_paths(view(spark, sf_dir, "bodies"))


@query(f"""{TREE} select m.entity, m.part as motion, count(*) filter (t.part <> m.part and starts_with(t.path, m.path || '/')) as children,
    count(*) filter (not starts_with(t.path || '/', m.path || '/')) as base,
    coalesce(string_agg(t.part::varchar, ',' order by t.path) filter (t.part <> m.part and starts_with(t.path, m.path || '/')), '') as moved
from t m join t on t.entity = m.entity where m.kind is not null group by 1, 2""")
def motion_roles(spark, sf_dir):
    tree = B.body_tree(view(spark, sf_dir, "bodies"))
    roles = B.motion_roles(tree).join(tree.select("entity", "part", "path"), ["entity", "part"])
    moved = F.array_sort(F.collect_list(F.when(c("role") == "child", F.struct("path", "part"))))
    counts = [F.count_if(c("role") == r).alias(n) for r, n in (("child", "children"), ("base", "base"))]
    out = roles.groupBy("entity", "motion").agg(*counts, moved.alias("m"))
    return out.select("entity", "motion", "children", "base", F.array_join(F.transform("m", lambda x: x["part"].cast("string")), ",").alias("moved"))


@query(f"""{TREE},
r as (select t.*, t.px - coalesce(u.px, 0) as x, t.py - coalesce(u.py, 0) as y, t.pz - coalesce(u.pz, 0) as z, repeat('  ', t.level + 2) as pad,
    case t.kind when 'B' then 'slide' when 'C' then 'hinge' end as joint from t left join t u on t.entity = u.entity and t.parent = u.part),
l as (select entity, '0' as place, '<mujoco model="' || entity || '">' || chr(10) || '  <compiler angle="radian"/>' || chr(10) || '  <option timestep="0.002" gravity="0 0 -9.81"/>' || chr(10) || '  <asset>' || chr(10) as line from r where level = 0
    union all select entity, '1' || lpad(part::varchar, 10, '0'), '    <mesh name="mesh_' || part || '" file="' || part || '.obj"/>' || chr(10) from r
    union all select entity, '2', '  </asset>' || chr(10) || '  <worldbody>' || chr(10) from r where level = 0
    union all select entity, '3' || path, pad || '<body name="part_' || part || '" pos="' || printf('%.6f %.6f %.6f', x + 0e0, y + 0e0, z + 0e0) || '">' || chr(10)
        || pad || '  <inertial pos="0 0 0" mass="' || case when level = 0 then '3' when joint is not null then '5' else '2' end || '" diaginertia="0.2 0.2 0.2"/>' || chr(10)
        || pad || '  <geom type="mesh" mesh="mesh_' || part || '" pos="' || printf('%.6f %.6f %.6f', -px + 0e0, -py + 0e0, -pz + 0e0) || '"/>' || chr(10)
        || case when joint is null then '' else pad || '  <joint name="joint_' || part || '" type="' || joint || '" axis="' || printf('%.6f %.6f %.6f', ax, ay, az)
            || '" range="' || printf('%.6f %.6f', lo, hi) || '" damping="' || printf('%.6f', damping) || '"/>' || chr(10) end from r
    union all select entity, '3' || path || '~', pad || '</body>' || chr(10) from r
    union all select entity, '4', '  </worldbody>' || chr(10) || '</mujoco>' || chr(10) from r where level = 0)
select entity, string_agg(line, '' order by place) as xml from l group by 1""")
def body_models(spark, sf_dir):
    return B.body_models(B.body_tree(view(spark, sf_dir, "bodies")))
