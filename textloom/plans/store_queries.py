"""Registered queries of readers, writers, archives, stages and tokenizers: what is written of a table, and read again.

Files go to the session's shared folder. Local sources and stages need it to be a local one.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import functions as F

from textloom.operators import curate, order, tokenize
from textloom.plans import lineage
from textloom.plans.queries import docs, query
from textloom.session import spread, table, temporary
from textloom.sources import archives, manifests, readers, scalars


def _local(spark, name: str) -> Path:
    """A folder for local sources and stages, for which the shared folder has to be a local one."""
    path = Path(re.sub("^file:/*", "/", temporary(spark, name)))
    path.mkdir(parents=True)
    return path


@query("select 'inline-' || lpad((row_number() over (order by n_nationkey) - 1)::varchar, 6, '0') as document_id, n_name as text, null::VARCHAR as split, row_number() over (order by n_nationkey) - 1 as pos from nation")
def inline_documents(spark, sf_dir):
    """The names of nations as inline documents."""
    names = [r[0] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]
    return readers.documents(spark, {"type": "inline_text", "documents": names})


@query("select sha256(text) as h, row_number() over (order by lpad(item_id::varchar, 6, '0')) - 1 as pos, true as named from benchmark")
def local_documents(spark, sf_dir):
    """Benchmark items as local files, found by a pattern and by name; pos is that of the path."""
    folder = _local(spark, "texts")
    rows = table(spark, sf_dir, "benchmark").select(F.format_string("%06d.txt", "item_id").alias("name"), "text")

    def put(part):
        for r in part:
            (folder / r["name"]).write_text(r["text"], encoding="utf-8")

    rows.foreachPartition(put)  # each task writes its files into the folder that all share
    config = {"type": "local_text", "glob_patterns": [f"{folder}/**/*.txt"], "paths": [str(folder / rows.agg(F.min("name")).first()[0])]}
    got = readers.documents(spark, config)
    return got.select(F.sha2("text", 256).alias("h"), "pos", F.col("document_id").rlike("^local-text-[0-9a-f]{24}$").alias("named"))


@query("select doc_id, sha256(text) as h from documents where source = 'src0'")
def shard_scan(spark, sf_dir):
    """One split of documents that were written as shards by source."""
    path = temporary(spark, "shards")
    readers.write_shards(table(spark, sf_dir).withColumn("split", F.col("source")), path, 100)
    return readers.documents(spark, {"type": "shards", "path": path, "split": "src0"}).select("doc_id", F.sha2("text", 256).alias("h"))


@query("select 'p' || o_orderkey as task_id, o_totalprice as chosen_score, o_custkey::DOUBLE as rejected_score, o_totalprice - o_custkey as score_margin from orders")
def preference_lines(spark, sf_dir):
    """Orders as preference records, written as lines of JSON and read with their fixed fields."""
    path = temporary(spark, "preferences")
    rows = table(spark, sf_dir, "orders").select(F.format_string("p%d", "o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("prompt"), F.lit("x").alias("chosen_completion"), F.lit("y").alias("rejected_completion"), F.col("o_totalprice").alias("chosen_score"), F.col("o_custkey").cast("double").alias("rejected_score"), (F.col("o_totalprice") - F.col("o_custkey")).alias("score_margin"), F.lit(0).alias("chosen_sample_index"), F.lit(1).alias("rejected_sample_index"))
    manifests.write_json_lines(rows, path)
    return readers.preferences(spark, path).select("task_id", "chosen_score", "rejected_score", "score_margin")


@query("select 't' || p_partkey as task_id, p_name as prompt, 2 as n_checks, row_number() over (order by p_partkey) as place from part order by p_partkey limit 300")
def task_lines(spark, sf_dir):
    """The first 300 tasks of a file of lines: the operator's own limit."""
    path = temporary(spark, "tasks")
    rows = table(spark, sf_dir, "part").orderBy("p_partkey").select(F.format_string("t%d", "p_partkey").alias("task_id"), F.col("p_name").alias("prompt"), F.array(F.lit("a"), F.lit("b")).alias("checks"))
    manifests.write_json_lines(rows.coalesce(1), path)
    return order.number(readers.tasks(spark, path, 300), out="place").select("task_id", "prompt", F.size("checks").alias("n_checks"), (F.col("place") + 1).alias("place"))


@query("select distinct l_orderkey as seed_id, l_linenumber as sample_index from lineitem where l_orderkey % 3 != 0")
def completed_attempts(spark, sf_dir):
    """A log of attempts in which a third of the lines are damaged."""
    path = temporary(spark, "attempts")
    whole = F.to_json(F.struct(F.struct(F.col("l_orderkey").alias("seed_id")).alias("seed"), F.col("l_linenumber").alias("sample_index")))
    table(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 3 == 0, F.substr(whole, F.lit(1), F.lit(12))).otherwise(whole).alias("value")).write.text(path)
    return readers.completed_attempts(spark, path).select(F.col("seed_id"), F.col("sample_index"))


@query("select 'outer-' || doc_id // 1000 || '.zip!inner-' || doc_id // 100 || '.zip' as inside, lpad(doc_id::varchar, 6, '0') || '.txt' as path, strlen(text)::BIGINT as size, sha256(text) as h, null::VARCHAR as damaged from documents where text is not null")
def archive_scan(spark, sf_dir):
    """Documents as files of an archive for each hundred ids, ten of which stand in another one."""
    ids = lambda kind, by: F.concat(F.lit(kind), F.floor(F.col("doc_id") / by).cast("string"), F.lit(".zip"))
    rows = table(spark, sf_dir).where("text is not null").select("doc_id", F.format_string("%06d.txt", "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"), ids("inner-", 100).alias("archive"))
    inner = archives.zipped(rows, "archive")
    number = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    outer = archives.zipped(inner.withColumn("archive", F.concat(F.lit("outer-"), F.floor(number / 10).cast("string"), F.lit(".zip"))), "archive")
    return archives.nested_in(outer).select(F.col("archive").alias("inside"), "path", "size", F.sha2("content", 256).alias("h"), "damaged")


@query("select o_orderpriority || '/' || o_orderstatus as path, arg_max(o_clerk, o_orderkey) as content from (select *, 'order ' || o_orderkey as o_clerk from orders) group by 1")
def bundle_entries(spark, sf_dir):
    """Orders as entries of a bundle by priority and status, of which the last of a path wins; the files of the bundle."""
    entries = table(spark, sf_dir, "orders").select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("path"), F.encode(F.format_string("order %d", "o_orderkey"), "UTF-8").alias("content"), F.col("o_orderkey").alias("pos"))
    target = f"{temporary(spark, 'bundle')}.zip"
    archives.bundle(entries, target, pos="pos", manifest="bundle_manifest.json")
    got = archives.nested(spark, target)
    return got.where("path != 'bundle_manifest.json'").select("path", F.decode("content", "UTF-8").alias("content"))


_PRINT = "sha256('{\"config\":\"' || sha256('{\"k\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}') || '\",\"parents\":' || {0} || ',\"stage\":\"{1}\",\"version\":1}')"


@query(f"""with a as (select n_nationkey, n_name, {_PRINT.replace('{0}', "'{}'").replace('{1}', 'a')} as p from nation)
select n_nationkey::BIGINT as k, p as parent, {_PRINT.replace('{0}', "('{" + chr(34) + "a" + chr(34) + ":" + chr(34) + "' || p || '" + chr(34) + "}')").replace('{1}', 'b')} as child from a""")
def stage_fingerprints(spark, sf_dir):
    """Nations as configurations of two stages, one the other's parent."""
    config = F.to_json(F.struct(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name")))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), config.alias("config"))
    return rows.withColumn("parent", lineage.fingerprint_of("a", F.col("config"), {})).withColumn("child", lineage.fingerprint_of("b", F.col("config"), {"a": F.col("parent")})).drop("config")


@query("""select * from (values ('first', 'a', 'complete'), ('first', 'b', 'failed: ValueError: bad'), ('first', 'c', 'skipped'), ('first', 'd', 'complete'), ('again', 'a', 'cached'), ('again', 'b', 'failed: ValueError: bad'), ('again', 'c', 'skipped'), ('again', 'd', 'cached'),
('changed', 'a', 'complete'), ('changed', 'b', 'failed: ValueError: bad'), ('changed', 'c', 'skipped'), ('changed', 'd', 'cached')) t(run, stage, status)""")
def stage_runs(spark, sf_dir):
    """Four stages, one of which fails, run three times under a lock; the configuration of the first is changed before the last run."""
    folder = _local(spark, "stages")

    def bad(_):
        raise ValueError("bad")

    stages = [lineage.Stage("a", {"x": 1}), lineage.Stage("b", {}, ["a"], bad), lineage.Stage("c", {}, ["b"]), lineage.Stage("d", {})]
    out = []
    for run in ("first", "again", "changed"):
        lock = lineage.Lock(folder)
        if not lock.acquire(run) or lineage.Lock(folder).acquire(run):
            raise RuntimeError("the lock does not hold")
        stages[0].config["x"] = 2 if run == "changed" else 1
        out += [(run, stage, status) for stage, status in lineage.run_all(stages, folder).items()]
        lock.release()
    return spark.createDataFrame(out, "run string, stage string, status string")


@query("select n_name as name, n_regionkey::BIGINT as region, n_nationkey::BIGINT * 2 as width from nation")
def configurations(spark, sf_dir):
    """A configuration file for each nation, found by a pattern, loaded and overridden."""
    folder = _local(spark, "configs")
    keys = {}
    for r in table(spark, sf_dir, "nation").collect():
        readers.export_config({"name": r["n_name"], "model": {"region": int(r["n_regionkey"]), "width": int(r["n_nationkey"])}}, str(folder / f"{r['n_name']}.yaml"))
        keys[r["n_name"]] = int(r["n_nationkey"])
    made = [readers.load_config(p) for p in readers.expand([f"{folder}/*.yaml"])]
    made = [readers.with_overrides(c, [f"model.width={2 * keys[c['name']]}"]) for c in made]
    return spark.createDataFrame([(c["name"], c["model"]["region"], c["model"]["width"]) for c in made], "name string, region long, width long")


@query("select doc_id as pos, (strlen(text) - len(regexp_extract_all(text, 'th')))::INT as tokens, (4 + strlen(text) - len(regexp_extract_all(text, 'th')))::INT as marked, text as back from documents where text is not null")
def merged_pairs(spark, sf_dir):
    """Documents under one merge, by themselves and between marks with a special token before them."""
    tokens = tokenize.BytePairs(((b"t", b"h"),), ("<m>",), "<bos>", "<eos>", "<pad>")
    rows = table(spark, sf_dir).where("text is not null").select(F.col("doc_id").alias("pos"), "text")
    rows = rows.withColumn("plain", tokenize.bpe_encode(tokens)("text")).withColumn("around", tokenize.bpe_encode(tokens, True, True)(F.concat(F.lit("<m>"), "text", F.lit("<m>"))))
    return rows.select("pos", F.size("plain").alias("tokens"), F.size("around").alias("marked"), tokenize.bpe_decode(tokens)("around").alias("back"))


@query("select doc_id as pos, length(text)::INT as characters, (strlen(text) - len(regexp_extract_all(text, 'th')))::INT as pairs from documents where text is not null")
def tokenizer_files(spark, sf_dir):
    """Documents under a character vocabulary and byte pairs that were saved, and loaded again."""
    folder, rows = temporary(spark, "tokenizers"), spread(table(spark, sf_dir).where("text is not null").select(F.col("doc_id").alias("pos"), "text"))
    tokenize.save_characters(spark, {r["token"]: r["id"] for r in tokenize.character_vocabulary(rows).collect()}, f"{folder}/characters")
    tokenize.BytePairs(((b"t", b"h"),), eos="<eos>").save(spark, f"{folder}/pairs")
    counted = tokenize.character_encode(rows, tokenize.load_characters(spark, f"{folder}/characters")).withColumn("characters", F.size("tokens"))
    return counted.withColumn("ids", tokenize.bpe_encode(tokenize.BytePairs.load(spark, f"{folder}/pairs"))("text")).select("pos", "characters", F.size("ids").alias("pairs"))


@query("select doc_id as pos, true as same, true as fewer from documents where text is not null")
def library_pairs(spark, sf_dir):
    """Documents under the library's merges of a bounded sample: whether they come back whole, from fewer tokens than bytes."""
    tokens = tokenize.LibraryPairs.train(order.bounded_prefix(docs(spark, sf_dir), 200, 200_000, strict=True), 400)
    rows = table(spark, sf_dir).where("text is not null").select(F.col("doc_id").alias("pos"), "text").withColumn("ids", tokenize.library_encode(tokens)("text"))
    return rows.select("pos", (tokenize.library_decode(tokens)("ids") == F.col("text")).alias("same"), (F.size("ids") <= F.octet_length("text")).alias("fewer"))


@query("select count(*) as documents, sum(strlen(nfc_normalize(text)))::BIGINT as bytes from documents")
def normal_forms(spark, sf_dir):
    """All forms of normalisation of all documents, the composed one summed up; the compatible ones are compared with it."""
    rows = table(spark, sf_dir).withColumn("split", F.lit("all"))
    forms = {f: curate.normalize_unicode(f)(rows).select("doc_id", F.col("text").alias(f)) for f in ("NFC", "NFD", "NFKC", "NFKD")}
    both = forms["NFC"].join(forms["NFD"], "doc_id").join(forms["NFKC"], "doc_id").join(forms["NFKD"], "doc_id")
    longer = F.octet_length("NFD") >= F.octet_length("NFC")
    checked = F.when(longer & F.col("NFKD").isNotNull() & F.col("NFKC").isNotNull(), F.octet_length("NFC"))
    return both.agg(F.count(F.lit(1)).alias("documents"), F.sum(checked.cast("long")).alias("bytes"))


_SCALARS = "(select event_type as run, event_id as step, user_id % 5 as tag, event_id // 400 as part, value, event_id % 400 as place from events where value is not null)"


@query(f"""with s as {_SCALARS}, files as (select run, part, max(place) as last from s group by all), whole as (select s.* from s join files using (run, part) where part % 4 != 1 or place < last)
select run, 'tag' || tag as tag, count(*) as points, min(step) as first_step, max(step) as last_step, round(sum(value::FLOAT::DOUBLE), 3) as total from whole group by all""")
def scalar_logs(spark, sf_dir):
    """Events as scalars in event files, one for each type and 400 ids; of every fourth file the last record is cut off and does not count."""
    rows = table(spark, sf_dir, "events").where("value is not null").select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), F.floor(F.col("event_id") / 400).alias("part"), scalars.event_record("event_id", F.concat(F.lit("tag"), (F.col("user_id") % 5).cast("string")), "value").alias("record"))
    # A file has 400 records at most.
    files = rows.groupBy("run", "part").agg(F.array_sort(F.collect_list(F.struct("step", "record"))).alias("all"))
    content = F.aggregate("all", F.lit(b""), lambda whole, r: F.concat(whole, r["record"]))
    made = files.select(F.concat_ws("/", "run", "part").alias("path"), "part", content.alias("content"))
    path = temporary(spark, "event-files")
    made.select("path", F.when(F.col("part") % 4 == 1, F.expr("substring(content, 1, octet_length(content) - 3)")).otherwise(F.col("content")).alias("content")).write.parquet(path)
    found = scalars.scalars_in(spark.read.parquet(path))
    return found.groupBy(F.substring_index("path", "/", 1).alias("run"), "tag").agg(F.count(F.lit(1)).alias("points"), F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.round(F.sum("value"), 3).alias("total"))
