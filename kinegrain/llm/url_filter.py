"""URL filters by a path-template tree, in DataFrame functions only.

A url's path is a branch: all its segments, in which runs of digits become ``#``. Below
every prefix of a host, sibling branches that a test of proportions can't tell from
all their siblings together, in where their urls end and in how many are labelled and
blocked, are merged into the wildcard ``*`` if there are MANY of them. Labelled urls
are those that a rule decides. A template's purity is the share of blocked among its
labelled urls, smoothed by its parent's purity, and so on up to the host, whose purity is
smoothed by ``prior``. A branch without any label takes its parent's purity. Rules pick
whole branches, so what they leave out isn't a random sample: above a template itself,
an unlabelled url counts as ``unlabelled`` clean ones. Urls of templates with a
purity of ``reject`` or more are blocked.

All counting is done on (host, template) groups, so a hot host is summed in map
tasks; urls are joined once with their group's verdict, and a hot group's urls are
split by the adaptive skew join or not shuffled at all. Rounds are as many as levels at
which branches can merge, whatever the longest path; prefixes are told by MD5.

Defined cases: a null url, or one without ``://``, has an empty host and path; an
empty path is the root template; paths of any number of segments are judged whole; where several rules fit, the longest host and path
wins, then the path; repeated rows are judged alike; an empty table gives an empty
result; the operator's rules are a bounded parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, discard, stored

#: (host, path prefix, verdict): a rule fits its host and all subdomains.
Rule = tuple[str, str, str]
#: Similar siblings that make a wildcard, and the squared deviation up to which one counts as similar (95 %).
MANY, DEVIATION = 3, 3.84
PRIOR, STRENGTH, REJECT, UNLABELLED = 0.2, 4.0, 0.5, 1.0


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_fields(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule as written, verdict) of the longest rule that fits; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """All segments with runs of digits as '#'."""
    return F.split(F.regexp_replace(F.regexp_replace(path, r"[0-9]+", "#"), r"^/", ""), "/")


def _alike(share: str) -> Column:
    """Whether a branch's share of its urls is like that of its parent's (``all``, ``all_*``)."""
    p = F.col(f"all_{share}") / F.col("all")
    far = F.col(share) / F.col("n") - p
    return far * far <= F.lit(DEVIATION) * p * (1 - p) * (1 / F.col("n") - 1 / F.col("all"))


def _prefixes(segs: Column) -> Column:
    """Array of identities of every prefix of a host's branch, the host itself first: each the MD5 of the one above and its segment."""
    start = F.array(F.md5(F.col("host").cast("binary")))
    step = lambda ids, s: F.concat(ids, F.array(F.md5(F.concat(F.element_at(ids, -1), F.lit("/"), s).cast("binary"))))
    return F.aggregate(segs, start, step)


def _merged_level(tree: DataFrame, k: int) -> DataFrame:
    """tree with its segments at place k merged under every prefix where MANY siblings are alike."""
    named = tree.withColumns({"at": F.get("ids", F.lit(k)), "seg": F.get("s", F.lit(k)), "ends": F.when(F.size("t") == k + 1, F.col("n")).otherwise(0)})
    branch = named.where("seg is not null").groupBy("at", "seg").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked", "ends")])
    parent = branch.groupBy("at").agg(F.sum("n").alias("all"), *[F.sum(c).alias(f"all_{c}") for c in ("labelled", "blocked", "ends")])
    alike = stored(branch.join(parent, "at").where(_alike("ends") & _alike("labelled") & _alike("blocked")).select("at", "seg"), "alike")
    wide = alike.groupBy("at").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") >= MANY).select("at")
    wild = alike.join(wide, "at").select("at", "seg", F.lit("*").alias("wild"))
    joined = named.join(wild, ["at", "seg"], "left")
    segs = F.when(F.col("wild").isNull(), F.col("s")).otherwise(F.concat(F.slice("s", F.lit(1), F.lit(k)), F.array("wild"), F.slice("s", F.lit(k + 2), F.size("s"))))
    out = stored(joined.select("host", "t", "n", "labelled", "blocked", segs.alias("s")), "templates")
    discard(alike)
    return out


def templates(urls: DataFrame) -> DataFrame:
    """host, t (segments), n, labelled, blocked, and s (segments after merging) from (host, path, label).

    Levels are merged from the top, since merged branches share what is below them; a level
    under none of whose prefixes MANY branches stand can merge nothing and costs no round.
    """
    base = urls.groupBy("host", segments(F.col("path")).alias("t")).agg(
        F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.count_if(F.col("label") == "block").alias("blocked")
    )
    tree, done = stored(base.withColumn("s", F.col("t")), "templates"), 0
    while True:
        placed = tree.withColumn("ids", _prefixes(F.col("s")))
        below = placed.select(F.posexplode(F.arrays_zip(F.slice("ids", F.lit(1), F.size("s")).alias("at"), F.col("s").alias("seg"))).alias("k", "x")).where(F.col("k") >= done)
        kinds = below.groupBy("k", "x.at", "x.seg").agg(F.lit(1).alias("one")).groupBy("k", "at").count().where(F.col("count") >= MANY)
        k = kinds.agg(F.min("k")).first()[0]
        if k is None:
            return tree
        grown = _merged_level(placed, k)
        discard(tree)
        tree, done = grown, k + 1


def template_verdicts(tree: DataFrame, *, prior: float = PRIOR, strength: float = STRENGTH, reject: float = REJECT, unlabelled: float = UNLABELLED) -> DataFrame:
    """tree's host and t with template, purity and method verdict: sums of all prefixes at once, then a fold of each template's from the host down."""
    each = tree.select("host", "t", "n", "labelled", "blocked", F.posexplode(_prefixes(F.col("s"))).alias("k", "at"))
    sums = each.groupBy("at").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.sum("n").alias("a"))
    above = each.join(sums, "at").groupBy("host", "t").agg(F.array_sort(F.collect_list(F.struct("k", "l", "b", "a"))).alias("above"))
    rows = tree.select("host", "t", "s").join(above, ["host", "t"])

    def smoothed(purity: Column, x: Column) -> Column:
        # a template that ends here has only its labelled urls; above it the others weigh a little
        others = F.when(F.size("t") <= x["k"], 0.0).otherwise(unlabelled) * (x["a"] - x["l"])
        known = x["l"] > 0  # without labels it is the parent's purity
        return (F.when(known, x["b"]).otherwise(0) + F.lit(strength) * purity) / (F.when(known, x["l"] + others).otherwise(0.0) + F.lit(strength))

    out = rows.withColumn("purity", F.aggregate("above", F.lit(prior), smoothed))
    template = F.concat(F.lit("/"), F.array_join("s", "/"))
    return out.select("host", "t", template.alias("template"), "purity", F.when(F.col("purity") >= reject, "block").otherwise("allow").alias("method"))


def judge_urls(pages: DataFrame, rules: list[Rule], **how) -> DataFrame:
    """pages with host, path, rule, verdict, template and purity; the rule's verdict, else the method's."""
    taken = {"host", "path", "rule", "verdict", "template", "purity"}
    kept = [c for c in pages.columns if c not in taken]
    rows = pages.select(F.struct(*kept).alias("row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = rule_fields(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "label": verdict})
    judged = stored(template_verdicts(templates(rows.select("host", "path", "label")), **how), "judged")
    rows = rows.withColumn("t", segments(F.col("path")))
    found = rows.join(checked_broadcast(judged), ["host", "t"], "left")
    return found.select("row.*", "host", "path", "rule", F.coalesce("label", "method").alias("verdict"), "template", "purity")


def verdict_sql(
    rules: list[Rule], levels: int = 4, prior: float = PRIOR, strength: float = STRENGTH, reject: float = REJECT, unlabelled: float = UNLABELLED
) -> str:
    """The same judgement of ``pages`` as DuckDB SQL, for paths of at most ``levels`` segments: page_id, host, path, rule, verdict."""
    name, verdict = "null", "null"
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[1]), r)):
        fits = f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
        name, verdict = f"case when {fits} then '{h + p}' else {name} end", f"case when {fits} then '{v}' else {verdict} end"
    cut = "string_split(regexp_replace(regexp_replace(path, '[0-9]+', '#', 'g'), '^/', ''), '/')"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = [
        f"""split as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages)""",
        f"urls as (select *, {name} as rule, {verdict} as label, {cut} as t from split)",
        "tree0 as (select host, t, count(*) as n, count(label) as labelled, count(*) filter (label = 'block') as blocked from urls group by all)",
    ]
    for k in range(levels):
        above = ["host", *[f"s{i}" for i in range(k)]]
        keys = ", ".join(above)
        alike = " and ".join(
            f"power({x} / b.n::double - all_{x} / total::double, 2) <= {DEVIATION} * (all_{x} / total::double) * (1 - all_{x} / total::double) * (1 / b.n::double - 1 / total::double)"
            for x in ("ends", "labelled", "blocked")
        )
        on = " and ".join(f"x.{c} = w.{c}" for c in (*above, "seg"))
        parts += [
            f"seg{k} as (select *, t[{k + 1}] as seg, case when len(t) = {k + 1} then n else 0 end as ends from tree{k})",
            f"branch{k} as (select {keys}, seg, sum(n) as n, sum(labelled) as labelled, sum(blocked) as blocked, sum(ends) as ends from seg{k} where seg is not null group by all)",
            f"parent{k} as (select {keys}, sum(n) as total, sum(labelled) as all_labelled, sum(blocked) as all_blocked, sum(ends) as all_ends from branch{k} group by all)",
            f"alike{k} as (select {keys}, seg from branch{k} b join parent{k} using ({keys}) where {alike})",
            f"wild{k} as (select {keys}, seg from (select *, count(*) over (partition by {keys}) as kinds from alike{k}) where kinds >= {MANY})",
            f"tree{k + 1} as (select x.* exclude (seg, ends), case when w.seg is not null then '*' else x.seg end as s{k} from seg{k} x left join wild{k} w on {on})",
        ]
    sums, purity = "", f"{prior}::double"
    for k in range(levels + 1):
        keys = ["host", *[f"s{i}" for i in range(k)]]
        over = f"over (partition by {', '.join(keys)})"
        sums += f", sum(labelled) {over} as l{k}, sum(blocked) {over} as b{k}, sum(n) {over} as a{k}"
        others = f"(case when len(t) <= {k} then 0.0 else {unlabelled} end)::double * (a{k} - l{k})"
        known = f"case when l{k} > 0 and len(t) >= {k} then"
        purity = f"(({known} b{k} else 0 end + {strength}::double * {purity}) / ({known} l{k} + {others} else 0.0::double end + {strength}::double))"
    parts.append(f"judged as (select host, t, case when {purity} >= {reject} then 'block' else 'allow' end as method from (select *{sums} from tree{levels}))")
    return "with " + ",\n".join(parts) + "\nselect page_id, host, path, rule, coalesce(label, method) as verdict from urls left join judged using (host, t)"
