"""The queries of the training-data operators: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, decontaminate, filter_audit, html_extract, jaccard_join, language_id, lexical_search, mixing, quality, token_output, toxicity, url_filter
from .common import table

TOKENIZER_FILE = "byte_bpe_50k.json"
RANKS_FILE = "byte_bpe_50k.tiktoken"


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the doc_id as text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: Host, path prefix, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


#: The tools of the derived calls: name, required properties, types of properties.
TOOLS = [
    ("lookup", ["n"], {"n": "integer", "of": "string"}), ("count", ["n"], {"n": "string", "of": "string"}), ("join", ["n", "of"], {"n": "integer", "of": "string"}),
]
#: ``conversations`` hold no calls, so each assistant's turn is made to call a tool, which needs the result of the
#: assistant's turn before (or, in turns of a length divisible by 13, that of the next, which needs it in turn) and two of
#: three calls get a result; the texts run on both engines.
DERIVED = """with a as (select conv_id, turn, role, text, coalesce(length(text), 0) as n from <conversations>),
c as (select *, concat('c', cast(turn as string)) as id,
    case n % 4 when 0 then 'lookup' when 1 then 'count' when 2 then 'join' else 'other' end as name,
    case when n % 13 = 0 then concat('c', cast(turn + 2 as string)) when turn >= 3 and n % 5 <> 0 then concat('c', cast(turn - 2 as string)) end as need
    from a where role = 'assistant'),
j as (select *, concat('{', case when n % 7 = 0 then '"m":true' else concat('"n":', cast(n as string)) end,
    case when need is null then '' else concat(',"of":"$', need, '"') end, '}') as arguments from c)"""
MESSAGES = """select conv_id, turn, role, text from a where role is null or role <> 'assistant' union all
select conv_id, turn, role, to_json(named_struct('content', text, 'tool_calls', array(named_struct('id', id, 'name', name, 'arguments', arguments))), map('ignoreNullFields', 'false')) as text from j union all
select conv_id, turn, 'tool' as role, concat('{"tool_call_id":"', id, '","content":"', cast(n as string), '"}') as text from j where n % 3 <> 0 union all
select conv_id, turn, 'tool' as role, '{"tool_call_id":"gone","content":"?"}' as text from j where n % 17 = 0"""


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = spark.sql(f"{DERIVED} {MESSAGES}".replace("<conversations>", f"parquet.`{sf_dir}/conversations.parquet`"))
    tools = spark.createDataFrame(TOOLS, "name string, required array<string>, types map<string,string>")
    return chat_format.link_tool_calls(messages, tools)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    folder, manifest = token_output.write_token_shards(docs, public_tokenizers.path(TOKENIZER_FILE))
    return token_output.token_digest(token_output.read_token_shards(spark, folder, manifest))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = fold(F.col("doc_id"), 3) != 1
    model = toxicity.fit(toxicity.labelled_texts(docs.where(learn), labels.where(learn)))
    held = F.coalesce(~learn, F.lit(False))
    return toxicity.score_toxicity(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    protos = language_id.prototypes(docs.where(~held).select("text", "lang"))
    return language_id.detect_language(docs.select("doc_id", held.alias("held_out"), "text"), protos)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quality.quality_verdicts(table(spark, sf_dir, "documents"))
    return v.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = byte_bpe.Model(docs, public_tokenizers.path(RANKS_FILE), public_tokenizers.PATTERN)
    return byte_bpe.digest(byte_bpe.decode_ids(byte_bpe.encode_texts(docs, model), model))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_url_filter": op2_url_filter,
    "op3_chat_format": op3_chat_format,
    "op4_token_output": op4_token_output,
    "op5_toxicity": op5_toxicity,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_decontamination": op7_decontamination,
    "op8_language_id": op8_language_id,
    "op9_mixing": op9_mixing,
    "op10_quality_rules": op10_quality_rules,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_lexical_search": op12_lexical_search,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE: dict[str, str] = {
    "op12_lexical_search": lexical_search.SEARCH_SQL,
    "op13_filter_audit": filter_audit.AUDIT_SQL,
    "op2_url_filter": url_filter.verdict_sql(URL_RULES),
    "op3_chat_format": "with recursive" + DERIVED.removeprefix("with").replace("<conversations>", "conversations") + """,
calls as (select j.*, k.id is not null as waits from j left join j k on k.conv_id = j.conv_id and k.id = j.need),
levels as (select conv_id, id, 0 as level from calls where not waits union all
    select c.conv_id, c.id, l.level + 1 from levels l join calls c on c.conv_id = l.conv_id and c.need = l.id and c.waits),
tools(tool, required, types) as (values ('lookup', ['n'], {'n': 'integer', 'of': 'string'}), ('count', ['n'], {'n': 'string', 'of': 'string'}),
    ('join', ['n', 'of'], {'n': 'integer', 'of': 'string'})),
judged as (select c.*, level, tool, n % 7 = 0 as odd, n % 3 <> 0 as answered,
    case when tool is null then ['unknown_tool'] else list_concat(
        case when n % 7 = 0 then ['missing:n'] else [] end, case when need is null and list_contains(required, 'of') then ['missing:of'] else [] end,
        case when n % 7 = 0 then ['unknown:m'] else [] end, case when n % 7 <> 0 and types.n = 'string' then ['type:n'] else [] end) end as wrong
    from calls c left join levels l using (conv_id, id) left join tools on tool = name),
errors as (select *, list_concat(wrong, case when level is null then ['cycle'] else [] end) as errors from judged)
select conv_id, turn, role, turn as order_turn, 0::int as order_level, 0::bigint as n_calls, 0::bigint as n_results, 0::bigint as n_errors,
    json_object('content', text, 'role', role)::varchar as message from a where role is null or role <> 'assistant' union all
select conv_id, turn, role, turn, 0, 1, answered::bigint, len(errors)::bigint, concat('{"content":', coalesce(to_json(text)::varchar, 'null'), ',"role":"assistant","tool_calls":[{"arguments":', arguments,
    ',"errors":', to_json(errors)::varchar, ',"id":"', id, '","level":', coalesce(level::varchar, 'null'), ',"name":"', name, '","result":', case when answered then concat('"', n, '"') else 'null' end, '}]}')
    from errors union all
select conv_id, turn, 'tool', turn, coalesce(level, 0) + 1, 0, 1, 0, concat('{"content":"', n, '","role":"tool","tool_call_id":"', id, '"}') from errors where answered union all
select conv_id, turn, 'tool', turn, 1, 0, 0, 1, '{"content":"?","role":"tool","tool_call_id":"gone"}' from j where n % 17 = 0""",
    "op9_mixing": r"""
with sized as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
           md5('7:' || coalesce(doc_id::varchar, 'null')) as ord, coalesce('s' || source, 'n') as key
    from documents),
sources as (select key, source, sum(size)::bigint as source_size from sized group by all),
ranked as (
    select *, row_number() over (order by source asc nulls last) as rnk,
           [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int] as weight
    from sources),
capped as (select *, source_size * 2.0::double as cap, source_size * 2.0::double / weight as ratio from ranked),
levels as (
    select *, (sum(source_size) over () * 1.5::double
               - coalesce(sum(cap) over (order by ratio, rnk rows between unbounded preceding and 1 preceding), 0.0))
              / sum(weight) over (order by ratio, rnk rows between current row and unbounded following) as lvl
    from capped),
water as (select arg_min(lvl, rnk_r) as water from (
    select lvl, row_number() over (order by ratio, rnk) as rnk_r, ratio from levels) where lvl <= ratio),
targets as (
    select key, source_size, least(cap, coalesce(weight * water, cap)) as target from levels cross join water),
plan as (
    select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole,
           case when source_size > 0 then round(target)::bigint - floor(target / source_size)::bigint * source_size else 0 end as need
    from targets),
placed as (
    select d.*, p.source_size, p.target, p.whole, p.need,
           coalesce(sum(size) over (partition by d.key order by ord, size rows between unbounded preceding and 1 preceding), 0)::bigint as prior
    from sized d join plan p using (key))
select doc_id, size, source_size, target,
       (size * whole + greatest(0, least(size, need - prior)))::bigint as taken
from placed""",
}
