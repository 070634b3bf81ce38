"""Registered queries of reports, candidates and code, beside those of plans.queries.

As there, columns of the driver's tables stand in for records that they have no counterpart of.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import formats, text as T
from textloom.operators import code, order, prefer, report
from textloom.plans import lineage
from textloom.plans.queries import _choice, _chosen, query
from textloom.session import table


@query("select o_orderstatus, string_agg(distinct o_orderpriority, ', ' order by o_orderpriority) as labels from orders group by 1")
def joined_labels(spark, sf_dir):
    return report.joined_labels(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query("select user_id, event_type, arg_max(value, event_id) as last, max(value) as largest, min(value) as least from events where value is not null group by 1, 2")
def scalar_series(spark, sf_dir):
    """Events as scalar logs: a series for each user and type."""
    return report.scalar_series(table(spark, sf_dir, "events"), "user_id", "event_type", step="event_id")


@query("""select split_part(url, ':', 1) as scheme, count(*) filter (ends_with(url, '.html')) as reports, count(*) filter (contains(url, '/en/')) as english,
count(*) filter (starts_with(url, 'https://m.') and ends_with(url, '#top')) as mobile_tops from pages group by 1""")
def bundle_counts(spark, sf_dir):
    """Urls stand in for the paths of a bundle."""
    pages = table(spark, sf_dir, "pages").withColumn("scheme", F.substring_index("url", ":", 1))
    url = F.col("url")
    return report.path_counts(pages, "url", {"reports": url.endswith(".html"), "english": url.contains("/en/"), "mobile_tops": url.startswith("https://m.") & url.endswith("#top")}, "scheme")


@query("select page_id, url from pages where starts_with(url, 'https://m.') or starts_with(url, 'http://blog.')")
def clean_export(spark, sf_dir):
    return report.with_prefix(table(spark, sf_dir, "pages"), "url", ["https://m.", "http://blog."]).select("page_id", "url")


@query("select user_id || '/' || event_type as path, min(event_id) as pos, arg_max(coalesce(value, -1), event_id) as value from events group by 1")
def last_entry_wins(spark, sf_dir):
    entries = table(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("path"), F.col("event_id").alias("pos"), F.coalesce("value", F.lit(-1.0)).alias("value"))
    return report.last_entries(entries, "path", "pos")


@query("select o_custkey, o_orderstatus, string_agg('order-' || lpad(o_orderkey::varchar, 9, '0'), ',' order by o_orderkey) as files from orders group by 1, 2")
def artifact_files(spark, sf_dir):
    """Orders stand in for files, customer and status for the artifact."""
    entries = table(spark, sf_dir, "orders").withColumn("path", F.format_string("order-%09d", "o_orderkey"))
    return report.artifact_files(entries, "o_custkey", "o_orderstatus").withColumn("files", F.array_join("files", ","))


@query("""with e as (select user_id as run, case when event_id % 7 = 0 then -1 else event_id end as step, value, event_id as path from events where value is not null)
select run, first(path order by step desc, path) as latest, first(path order by value, step, path) as best_loss, first(path order by value desc, step, path) as best_rate from e group by 1""")
def checkpoint_choice(spark, sf_dir):
    """Events stand in for evaluations; every seventh has no step."""
    e = table(spark, sf_dir, "events").where("value is not null").select(F.col("user_id").alias("run"), F.expr("if(event_id % 7 = 0, null, event_id)").alias("step"), F.col("value").alias("loss"), F.col("value").alias("rate"), F.col("event_id").alias("path"))
    return report.chosen_checkpoints(e, "run", "step", "loss", "rate", "path")


@query("""select l_orderkey as step, round(avg(l_discount), 9) as loss, round(avg(l_tax), 9) as norm, sum(l_quantity) as tokens, max(l_discount) filter (l_linenumber = 1) as first_rank_loss from lineitem group by 1""")
def rank_reduce(spark, sf_dir):
    """Lines of an order stand in for the ranks of a step."""
    rows = table(spark, sf_dir, "lineitem").withColumn("rank", F.col("l_linenumber") - 1).withColumnRenamed("l_orderkey", "step")
    out = report.over_ranks(rows, "step", "rank", "l_discount", "l_tax", "l_quantity")
    return out.withColumn("loss", F.round("loss", 9)).withColumn("norm", F.round("norm", 9))


@query("""select l_orderkey, l_linenumber, ((l_linenumber - 1) // 2)::BIGINT as node, ((l_linenumber - 1) % 2)::BIGINT as local_rank,
round(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows unbounded preceding) / greatest(l_extendedprice, 1e-9), 9) as tokens_per_second from lineitem""")
def training_throughput(spark, sf_dir):
    """Quantities as tokens and prices as seconds of the steps (lines) of a run (order)."""
    rows = report.throughput(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity", "l_extendedprice")
    return rows.select("l_orderkey", "l_linenumber", *report.topology(F.col("l_linenumber") - 1, 2), F.round("tokens_per_second", 9).alias("tokens_per_second"))


@query("""with s as (select l_orderkey, sum(l_quantity) as t, count(*) as n, sum(case when l_orderkey % 5 = 0 then 0 else l_linenumber end) as s from lineitem group by 1)
select l_orderkey, l_linenumber, round(case when s > 0 then t / s else 0 end, 9) as tokens_per_second, round(case when s > 0 then n / s else 0 end, 9) as sequences_per_second from lineitem join s using (l_orderkey)""")
def batch_throughput(spark, sf_dir):
    """Orders stand in for generation batches; every fifth takes no time."""
    rows = table(spark, sf_dir, "lineitem").withColumn("seconds", F.expr("if(l_orderkey % 5 = 0, 0, l_linenumber)"))
    out = report.batch_throughput(rows, "l_orderkey", "l_quantity", "seconds")
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 9).alias(c) for c in ("tokens_per_second", "sequences_per_second")])


@query("select o_orderkey, o_custkey, o_orderdate::date::varchar as made from orders where o_orderkey % 4 = 0")
def evaluation_targets(spark, sf_dir):
    """Orders stand in for checkpoint events, customers for the artifacts that made them."""
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"), F.col("o_custkey").alias("fingerprint"), F.col("o_orderdate").cast("date").cast("string").alias("made"))
    artifacts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("fingerprint")).distinct()
    return report.evaluation_targets(events, artifacts, 4).select(F.col("step").alias("o_orderkey"), F.col("fingerprint").alias("o_custkey"), "made")


@query("""select l_returnflag as g, case when min(l_partkey) = max(l_partkey) then format('{:,}', min(l_partkey)) else format('{:,}', min(l_partkey)) || '-' || format('{:,}', max(l_partkey)) end as parts,
printf('%.4f', avg(l_tax)) as mean, printf('%.2f%%', avg(l_discount) * 100) as share, printf('%+.4f', avg(l_tax) - avg(l_discount)) as delta, printf('%+.2f pp', (avg(l_tax) - avg(l_discount)) * 100) as points, format('{:,}', count(*)) as n from lineitem group by 1""")
def number_formats(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b"), F.avg("l_tax").alias("t"), F.avg("l_discount").alias("d"), F.count(F.lit(1)).alias("n"))
    gap = F.col("t") - F.col("d")
    return x.select("g", formats.integer_range(F.col("a"), F.col("b")).alias("parts"), formats.decimal(F.col("t")).alias("mean"), formats.percent(F.col("d")).alias("share"), formats.delta(gap).alias("delta"), formats.percent_delta(gap).alias("points"), formats.integer(F.col("n")).alias("n"))


@query("select conv_id, turn, ((row_number() over (order by conv_id * 1000 + turn) - 1) // 8)::BIGINT as batch from conversations where role = 'user'")
def prompt_batches(spark, sf_dir):
    """User turns in batches of eight."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("pos", F.col("conv_id") * 1000 + F.col("turn"))
    return order.batches(rows, 8).select("conv_id", "turn", "batch")


_DIGITS = "('0x' || substr(sha256({0}), 1, 15))::BIGINT"


def _permuted_in_sql(rounds: int) -> str:
    """c{rounds}: the choices (id, turn, x, n) after all rounds."""
    out = []
    for r in range(rounds):
        mirror = f"(({_DIGITS.format(f"'7:' || turn || ':{r}'")} - x) % n + n) % n"
        bit = _DIGITS.format(f"'7:' || turn || ':{r}:' || greatest(x, m)")
        out.append(f"c{r + 1} as (select id, turn, n, case when {bit} % 2 = 1 then m else x end as x from (select *, {mirror} as m from c{r}))")
    return ", ".join(out)


@query(f"""with b as (select k, row_number() over (order by {_DIGITS.format("'7:' || k")}, k) - 1 as spot from (select distinct p_brand as k from part)),
c0 as (select id, id // n as turn, id % n as x, n from (select unnest(range(0, 70)) as id, (select count(*) from b) as n)), {_permuted_in_sql(16)}
select id::BIGINT as seed_id, k from c16 join b on spot = x""")
def seeded_choice(spark, sf_dir):
    """Seventy brands of fewer, drawn in new orders until there are enough: the operator's own limit."""
    return order.seeded_choice(table(spark, sf_dir, "part").select(F.col("p_brand").alias("k")).distinct(), "k", 70, 7, "seed_id").select("seed_id", "k")


@query("""select a.o_orderkey as prompt, b.o_orderkey as output from (select o_orderkey, row_number() over (order by o_orderkey) as r from orders) a join (select o_orderkey, row_number() over (order by o_orderkey desc) as r from orders) b using (r)""")
def strict_zip(spark, sf_dir):
    """Orders beside the orders in reverse: prompts and outputs by place."""
    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    return order.zip_strict(keys.select(F.col("o_orderkey").alias("prompt")), keys.select(F.col("o_orderkey").alias("output"), (-F.col("o_orderkey")).alias("back")), "prompt", "back").select("prompt", "output")


@query("""with s as (select o_custkey as shard, count(*) as n from orders group by 1), i as (select shard, n, sum(n) over (order by shard) - n as start from s),
r as (select (row_number() over (order by o_orderkey) - 1) as row_id from orders)
select row_id, shard, (row_id - start)::BIGINT as place from r join i on row_id >= start and row_id < start + n""")
def row_to_shard(spark, sf_dir):
    """Customers stand in for shards of as many rows as they have orders."""
    orders = table(spark, sf_dir, "orders")
    index = order.shard_index(orders.groupBy(F.col("o_custkey").alias("shard")).agg(F.count(F.lit(1)).alias("rows")))
    ids = order.number(orders.select("o_orderkey"), "o_orderkey", "row_id")
    return order.locate(ids, index, width=64).select("row_id", "shard", "place")


@query("select p_partkey as shard, (row_number() over (order by sha256('3:1:' || p_partkey)) - 1)::BIGINT as place, ((row_number() over (order by sha256('3:1:' || p_partkey)) - 1) % 6)::BIGINT as worker from part")
def shuffled_shards(spark, sf_dir):
    """Parts stand in for the shards that six workers read in an epoch."""
    return order.shuffled_shards(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("shard")), "shard", 3, 1, 6)


@query("select doc_id as pos, sha256(text) as h from documents union all select (select max(doc_id) + 1 from documents) + item_id, sha256(text) from benchmark")
def corpus_union(spark, sf_dir):
    """documents and, behind them, benchmark, as one ordered corpus."""
    part = lambda name, key: table(spark, sf_dir, name).select(F.col(key).alias("pos"), F.sha2("text", 256).alias("h"))
    return order.concat(part("documents", "doc_id"), part("benchmark", "item_id"))


@query("""select l_orderkey, l_linenumber, p_brand, p_size from lineitem join (select p_partkey, p_brand, p_size from part) on l_partkey = p_partkey""")
def candidate_tasks(spark, sf_dir):
    """Order lines stand in for candidates, parts for their tasks; each part comes twice and the last counts."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    twice = part.withColumn("v", F.lit(1)).unionByName(part.withColumn("p_size", F.lit(-1)).withColumn("v", F.lit(0)))
    return prefer.with_tasks(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), twice, "v", "l_partkey").select("l_orderkey", "l_linenumber", "p_brand", "p_size")


AXES = {"edge": ["return None", "return zero"], "output": ["a boolean", "a number or None", "a dictionary"], "style": ["early return", "comprehension", "dictionary accumulator", "loop"], "operation": ["find the first item", "check each item", "sum the items"]}


def _axes() -> list[tuple[str, list[str], int]]:
    """The axes with their values and by how much a part's key is divided before it chooses one."""
    out, by = [], 1
    for name, values in AXES.items():
        out.append((name, values, by))
        by *= len(values)
    return out


@query(f"""select * from (select p_partkey, {', '.join(f"({values})[(p_partkey // {by}) % {len(values)} + 1] as {name}" for name, values, by in _axes())} from part)
where not (contains(edge, 'return None') and not contains(output, 'or None')) and not (contains(style, 'dictionary accumulator') and not contains(output, 'dictionary'))
and not (contains(style, 'comprehension') and starts_with(operation, 'find the first'))
and not (contains(style, 'early return') and not (output = 'a boolean' or contains(output, 'or None') or starts_with(operation, 'find') or starts_with(operation, 'check')))""")
def seed_compatible(spark, sf_dir):
    """A task seed for each part, of which those stay whose axes go together."""
    chosen = [F.get(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("p_partkey") / by) % len(values)).cast("int")).alias(name) for name, values, by in _axes()]
    return table(spark, sf_dir, "part").select("p_partkey", *chosen).where(prefer.compatible())


@query("""select conv_id, turn, sha256(case when a is null then '' else a end || case when turn % 2 = 0 and not starts_with(b, chr(10)) and b != '' then chr(10) else '' end || b) as h from
(select conv_id, turn, (case when turn % 2 = 0 then 'def f(x):' else 'x = ' end) as a, text as b from conversations)""")
def completion_source(spark, sf_dir):
    """Turns stand in for generated texts that repeat their prompt; what is left goes behind the runnable part of the prompt."""
    prompt = F.concat(F.lit("Say it.\n\n"), F.when(F.col("turn") % 2 == 0, "def f(x):").otherwise("x = "))
    rows = table(spark, sf_dir, "conversations").withColumn("prompt", T.inference_prompt(prompt, F.lit(None).cast("string"))).withColumn("generated", F.concat("prompt", "text"))
    return rows.select("conv_id", "turn", F.sha2(T.append_completion(T.executable_suffix("prompt"), T.strip_prompt("generated", "prompt")), 256).alias("h"))


@query("""select conv_id, turn, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g'))) as key, trim(split_part(regexp_replace(text, '^\\s+', ''), chr(10), 1)) as first_line from conversations""")
def description_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.sha2(T.description_key("text"), 256).alias("key"), T.signature_line("text").alias("first_line"))


@query("""select o_orderkey, o_orderkey % 3 != 0 as found, case when o_orderkey % 3 != 0 then o_custkey else 0 end::BIGINT as passed, case when o_orderkey % 3 != 0 then o_custkey + 1 else 0 end::BIGINT as total from orders""")
def marker_parse(spark, sf_dir):
    """Outputs made from order and customer numbers, a third without a marker."""
    line = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("\n CHECKS "), F.col("o_custkey").cast("string"), F.lit(" "), (F.col("o_custkey") + 1).cast("string"), F.lit(" \nCHECKS 9 9"))).otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.check_marker(F.concat(F.lit("ok CHECKS 1 1"), line)).alias("m")).select("o_orderkey", "m.*")


@query("""select l_orderkey, l_linenumber, round(ln(1 + exp(-0.1::DOUBLE * ((l_tax - l_discount) - (l_discount - l_quantity)))), 9) as loss from lineitem""")
def preference_loss(spark, sf_dir):
    """Columns of order lines stand in for log probabilities."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(prefer.preference_loss(c("l_tax"), c("l_discount"), c("l_discount"), c("l_quantity"), 0.1), 9).alias("loss"))


@query("""with p as (select o_orderkey, (o_orderkey % 3 + 1)::INT as a, (o_orderkey % 5 + 1)::INT as b, (o_orderkey % 4 + 1)::INT as c from orders), n as (select max(a + greatest(b, c)) + 2 as n from p)
select o_orderkey, '8 ' || repeat('1 ', a) || repeat('5 ', b) || '9 ' || repeat('0 ', n - a - b - 2) as chosen, '8 ' || repeat('1 ', a) || repeat('6 ', c) || '9 ' || repeat('0 ', n - a - c - 2) as rejected, b + 1 as chosen_tokens, c + 1 as rejected_tokens from p, n""")
def preference_encode(spark, sf_dir):
    """Prompts and completions of lengths from order numbers, each between its marks, padded to the longest."""
    ids = lambda token, n: F.array_repeat(F.lit(token), (F.col("o_orderkey") % n + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", ids(1, 3).alias("prompt_ids"), ids(5, 5).alias("chosen_ids"), ids(6, 4).alias("rejected_ids"))
    e = prefer.encode(rows, 0, bos=8, eos=9)
    text = lambda c: F.concat(F.array_join(F.transform(c, lambda x: x.cast("string")), " "), F.lit(" "))
    return e.select("o_orderkey", text("chosen_input").alias("chosen"), text("rejected_input").alias("rejected"), *[F.size(F.filter(f"{s}_mask", lambda x: x)).alias(f"{s}_tokens") for s in ("chosen", "rejected")])


@query("select s_suppkey, 's' || s_suppkey || '_d' || d || '_w' || w as name, d, w, d * w as cells from supplier, (select unnest([2, 4, 10])::INT as d), (select unnest([64, 128])::INT as w)")
def sweep_grid(spark, sf_dir):
    """A sweep over two axes for the configuration of each supplier."""
    made = lineage.swept(table(spark, sf_dir, "supplier").select("s_suppkey"), {"d": [2, 4, 10], "w": [64, 128]}, "s{s_suppkey}_d{d}_w{w}")
    return made.withColumn("cells", F.col("d") * F.col("w"))


_WITH_IMPORTS = ["import os\nfrom re import (\n    sub,\n)\n\ndef f{k}(x):\n    return x\n", "import os\nx = {k}\ndef f(): pass\n", "def broken{k}(:", "def f{k}(x):\n    return x\n", "import os; import sys\ndef f{k}(x):\n    return x", "import os{k}\n"]
_WITHOUT = ["def f{k}(x):\n    return x", *_WITH_IMPORTS[1:4], "def f{k}(x):\n    return x", _WITH_IMPORTS[5]]


@query(f"select p_partkey, {_choice(_WITHOUT)} as code from part")
def strip_imports(spark, sf_dir):
    """Sources made of the numbers of parts."""
    rows = table(spark, sf_dir, "part").select("p_partkey", _chosen(_WITH_IMPORTS).alias("code"))
    return rows.select("p_partkey", code.strip_imports("code").alias("code"))


_ANSWERS = ['```json\n{"checks": ["f({k}) == 1", " f(2) "]}\n```', "not json {k}", "[{k}]", '{"checks": {k}}', '{"checks": ["{k}"]}', '{"checks": ["{k}", "def"]}']
_FOUND = ["f({k}) == 1;f(2)", None, None, None, None, None]
_AGAINST = [None, "invalid_checks_json", "checks_json_not_object", "checks_missing_or_not_list", "wrong_check_count", "invalid_check_expression"]


@query(f"select p_partkey, {_choice(_FOUND)} as checks, {_choice(_AGAINST)} as reason from part")
def parse_checks(spark, sf_dir):
    """Answers made of the numbers of parts."""
    rows = table(spark, sf_dir, "part").select("p_partkey", _chosen(_ANSWERS).alias("answer")).withColumn("c", code.parse_checks("answer", 2, 5))
    return rows.select("p_partkey", F.array_join("c.checks", ";").alias("checks"), "c.reason")


#: Sources of this module by kind. The checks name a part's size, the only thing of a row that gets into them.
TRUSTED = ["def add(a, b):\n    return a + b\n", "def add(a, b):\n    return a - b\n", "raise SystemExit(3)\n", "import os\nos._exit(0)\n", "import time\ntime.sleep(60)\n"]
_SIZE = "987654321"


@query("""select p_size, kind, case kind when 2 then 3 when 4 then null else 0 end::INT as return_code, kind < 2 as found, case kind when 0 then 2 when 1 then 1 else 0 end::INT as passed, case when kind < 2 then 2 else 0 end::INT as total,
case kind when 1 then 'checks_do_not_pass_reference' when 2 then 'checks_execution_failed' when 3 then 'checks_marker_missing' when 4 then 'checks_timed_out' end as reason
from (select distinct p_size, case when p_partkey % 4 = 3 and p_size % 25 = 0 then 4 else p_partkey % 4 end::INT as kind from part)""")
def run_checks(spark, sf_dir):
    """Two checks, of the size of a part, against sources of this module, for each size and kind of parts; no row of a table is ever run."""
    kind = F.when((F.col("p_partkey") % 4 == 3) & (F.col("p_size") % 25 == 0), 4).otherwise(F.col("p_partkey") % 4).cast("int")
    rows = table(spark, sf_dir, "part").select(F.col("p_size").cast("int").alias("p_size"), kind.alias("kind")).distinct().repartition(spark.sparkContext.defaultParallelism)
    texts = F.array(*[F.lit(code.harness(s, [f"add({_SIZE}, 0) == {_SIZE}", f"add(1, {_SIZE}) == {_SIZE} + 1"])) for s in TRUSTED])
    sources = rows.withColumn("source", F.replace(F.get(texts, F.col("kind")), F.lit(_SIZE), F.col("p_size").cast("string")))
    m = code.run_sources(sources, "source", 5.0, allow=True).withColumn("m", T.check_marker("output"))
    reason = code.reference_reason(F.col("timed_out"), F.col("return_code"), F.col("m.found"), F.col("m.passed"), F.col("m.total"))
    return m.select("p_size", "kind", "return_code", "m.found", F.col("m.passed").cast("int").alias("passed"), F.col("m.total").cast("int").alias("total"), reason.alias("reason"))


@query("select replace(replace(replace('python_' || replace(lower(p_type), ' ', '_') || '_small', 'python_', ''), '_small', ''), '_', '-') as short, count(*) as n from part group by 1")
def short_name(spark, sf_dir):
    """Part types stand in for experiments; the replacements follow each other."""
    long = F.concat(F.lit("python_"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")), F.lit("_small"))
    return table(spark, sf_dir, "part").groupBy(T.replace_all(long, [("python_", ""), ("_small", ""), ("_", "-")]).alias("short")).agg(F.count(F.lit(1)).alias("n"))
