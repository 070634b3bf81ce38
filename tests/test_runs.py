"""Sources, sinks, tokenizers, packing runs and stages: the cases that tables do not hold."""

import hashlib
import json
import struct
import zipfile
from io import BytesIO
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textloom import session
from textloom.functions import json_fields, text as T
from textloom.operators import code, curate, measure, order, pack, prefer, tokenize
from textloom.plans import lineage
from textloom.sources import archives, manifests, readers, scalars


def rows(df):
    return [tuple(r) for r in df.collect()]


# Learning rates, keys, fences: values worked out by hand.


@pytest.mark.parametrize(("kind", "want"), [("linear", [0.05, 0.1, 0.1, 0.06142857142857142, 0.01]), ("cosine", [0.05, 0.1, 0.1, 0.06501344202803415, 0.01])])
def test_learning_rate_falls_to_its_ratio(spark, kind, want):
    df = spark.createDataFrame([(s,) for s in (1, 2, 3, 6, 10)], "s long")
    assert [r[0] for r in rows(df.select(measure.learning_rate(F.col("s"), kind, 0.1, 2, 10, 0.1)))] == pytest.approx(want)


def test_learning_rate_of_one_step_behind_the_warmup(spark):
    df = spark.createDataFrame([(3,)], "s long")
    assert rows(df.select(measure.learning_rate(F.col("s"), "linear", 0.1, 2, 3, 0.1))) == [(0.1,)]
    with pytest.raises(PySparkException, match="outside"):
        df.select(measure.learning_rate(F.col("s"), "fixed", 0.1, 0, 2)).collect()


def test_middle_is_cut_by_hashes_of_the_id(spark):
    df = readers.inline(spark, ["abcdefghijklmnopqrstuvwxyz"])
    import hashlib

    number = lambda key, n: int(hashlib.sha256(key.encode()).hexdigest()[:16], 16) % n
    first = 3 + number("inline-000000:fill_in_middle:first", 26 - 9 + 1)
    second = first + 3 + number("inline-000000:fill_in_middle:second", 26 - first - 3 - 3 + 1)
    assert rows(curate.fill_in_middle(df, 1.0, 3).select("first", "second")) == [(first, second)]


def test_slugs(spark):
    df = spark.createDataFrame([("a--b",), ("__Ünï 1__",)], "t string")
    assert rows(df.select(T.slug("t"))) == [("a_b",), ("ünï_1",)]
    with pytest.raises(PySparkException, match="letter"):
        spark.createDataFrame([("--",)], "t string").select(T.slug("t")).collect()


def test_fences_are_whole_texts(spark):
    texts = ["```json\n{}\n```", " ```\nx ``` y\n``` \n", "see ```json x ``` and more", " plain "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows(df.select(T.strip_fence("t")))] == ["{}", "x ``` y", "see ```json x ``` and more", " plain "]


def test_unicode_forms(spark):
    df = spark.createDataFrame([("e\u0301 \ufb01 \u00e9",), ("ascii",), (None,)], "t string")
    for form, want in (("NFC", "\u00e9 \ufb01 \u00e9"), ("NFD", "e\u0301 \ufb01 e\u0301"), ("NFKC", "\u00e9 fi \u00e9"), ("NFKD", "e\u0301 fi e\u0301")):
        assert rows(df.select(T.unicode_normalize("t", form))) == [(want,), ("ascii",), (None,)]


def test_columns_have_to_be_texts(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "t string, n int")
    with pytest.raises(TypeError):
        T.text_column(df, "n")
    with pytest.raises(TypeError):
        T.text_column(df, "missing")
    with pytest.raises(PySparkException, match="null"):
        df.select(T.text_column(df, "t")).collect()


def test_typed_fields(spark):
    df = spark.createDataFrame([(json.dumps({"s": "x", "n": 3, "x": 1.5, "b": True, "a": [1, 2], "o": {"k": 1}, "z": None}),)], "j string")
    get = lambda *a, **k: rows(df.select(json_fields.field("j", *a, **k)))[0][0]
    assert (get("s", "string"), get("n", "long"), get("x", "double"), get("n", "double"), get("b", "long")) == ("x", 3, 1.5, 3.0, 1)
    assert json.loads(get("a", "array")) == [1, 2] and json.loads(get("o", "object")) == {"k": 1}
    assert get("z", "string", optional=True) is None and get("none", "long", optional=True) is None
    for name, kind, optional in (("s", "long", True), ("x", "long", False), ("n", "string", False), ("none", "long", False), ("z", "double", False), ("o", "array", True)):
        with pytest.raises(PySparkException, match="expected"):
            get(name, kind, optional=optional)
    assert rows(df.select(json_fields.count_of("j", "a"), json_fields.count_of("j", "n"), json_fields.count_of("j", "z"))) == [(2, 3, None)]
    with pytest.raises(PySparkException, match="expected"):
        df.select(json_fields.count_of("j", "s")).collect()


# Counters.


def test_counters_of_a_chain(spark):
    texts = ["Caf\u0065\u0301\r\n", "caf\u00e9\n", "x", "def f(a):\n    return a\n\n\ndef g():\n    pass\n", "def broken(:", "def f(a):\n    return a\n"]
    df = readers.inline(spark, texts)
    steps = [("normalize_unicode", {}), ("normalize_line_endings", {}), ("lower_case", {}), ("min_length", {"min_characters": 2}), ("extract_python_functions", {}), ("exact_deduplication", {}), ("assign_split", {"train": 1.0, "validation": 0.0})]
    found = curate.counted(df, steps)
    got = found.transform(curate.counters).first().asDict()
    assert got == {
        "input_documents": 6, "input_bytes": sum(len(t.encode()) for t in texts), "input_characters": sum(map(len, texts)), "rejected_documents": 5,
        "output_documents": 2, "output_bytes": 23 + 18, "output_characters": 23 + 18,
        "unicode_normalized_documents": 1, "line_endings_normalized_documents": 1, "lower_cased_documents": 1, "deduplicated_documents": 1, "split_assigned_documents": 2,
        "python_parse_failed_documents": 1, "python_extracted_functions": 3,
    }
    assert sorted(rows(curate.preprocessed(found).select("document_id", "split"))) == [("inline-000003__function_0000_f", "train"), ("inline-000003__function_0001_g", "train")]
    assert curate.counters(curate.counted(df.limit(0), steps)).first()["input_documents"] == 0


def test_functions_keep_other_columns(spark):
    df = spark.createDataFrame([("m", "class A:\n    def f(self):\n        pass\n    async def g(self):\n        pass\n", "train", 7)], "document_id string, text string, split string, n int")
    assert rows(code.extract_functions(df, methods=True, asynchronous=True)) == [("m__function_0000_f", "def f(self):\n    pass\n", "train", 7), ("m__function_0001_g", "async def g(self):\n    pass\n", "train", 7)]


def test_parse_results(spark):
    df = spark.createDataFrame([("x = 1",), ("def broken(:",), (None,)], "code string")
    got = [r[0] for r in rows(df.select(code.parse_result()))]
    assert got[0] == (True, None) and not got[1][0] and "invalid syntax" in got[1][1] and got[2] == (False, None)


# Tables of results.


@pytest.mark.parametrize("n", [1, 2, 5, 10, 999, 1000])
def test_exact_median(spark, n):
    import statistics

    values = [float((i * 7919) % 1009) for i in range(n)] + [1e9] * (n % 3)
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None), ("a", None), ("c", 1.0), ("c", 1.0)], "g string, v double")
    got = dict(rows(measure.exact_median(df, "g", "v", accuracy=100)))
    assert got["a"] == statistics.median(values) and got["c"] == 1.0


def test_findings_and_ties(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", None)], "g string, v double")
    assert sorted(rows(measure.findings(df, "g", {"x": (F.col("v"), None), "y": (F.col("v"), F.col("g") != "a")}))) == [("x", "a"), ("y", "b")]


@pytest.mark.parametrize(("family", "dim", "layers", "hidden", "want"), [("dense", 104, 2, 416, 992_992), ("moe", 88, 4, 352, 995_984), ("modern_moe", 88, 4, 256, 924_440)])
def test_parameter_counts(spark, family, dim, layers, hidden, want):
    """Active parameters of published models with 6000 tokens, tied, with one of four experts."""
    df = spark.createDataFrame([(family, 6000, dim, layers, hidden, 4, 1, True)], "f string, v long, d long, l long, h long, e long, a long, t boolean")
    assert rows(df.select(measure.parameter_counts(*[F.col(c) for c in "fvdlheat"])["active"])) == [(want,)]


def test_pending_seeds_and_compatible(spark):
    seeds = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "seed_id long, t string")
    done = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (2, 7)], "seed_id long, sample_index int")
    assert sorted(rows(prefer.pending_seeds(seeds, 2, done))) == [(2, "b"), (3, "c")]


# Sources and sinks.


def test_paths_are_resolved_in_order(tmp_path):
    for name in ("b.txt", "A.txt", "sub/c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    want = [str((tmp_path / n).resolve()) for n in ("A.txt", "b.txt", "sub/c.txt")]
    assert readers.resolve([str(tmp_path / "b.txt")], [f"{tmp_path}/**/*.txt"]) == want == readers.resolve([], [(str(tmp_path), "*.txt")])
    with pytest.raises(FileNotFoundError):
        readers.resolve([str(tmp_path / "none")], [])
    assert readers.expand([f"{tmp_path}/*.txt", "literal.yaml"]) == [*want[:2], "literal.yaml"]
    with pytest.raises(ValueError):
        readers.expand([])


def test_configurations(tmp_path):
    path = str(tmp_path / "c.yaml")
    readers.export_config({"a": {"b": 1}, "c": "x"}, path)
    config = readers.load_config(path)
    assert readers.with_overrides(config, ["a.b=2", "c=plain"]) == {"a": {"b": 2}, "c": "plain"} and config["a"]["b"] == 1
    with pytest.raises(KeyError):
        readers.with_overrides(config, ["a.z=2"])
    (tmp_path / "list.yaml").write_text("[1]")
    with pytest.raises(ValueError):
        readers.load_config(str(tmp_path / "list.yaml"))


def test_sources_by_type(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"one\r\n")
    assert rows(readers.documents(spark, {"type": "inline_text", "documents": ["a"]})) == [("inline-000000", "a", None, 0)]
    assert rows(readers.documents(spark, {"type": "local_text", "glob_patterns": [f"{tmp_path}/*.txt"]}).select("text")) == [("one\n",)]
    with pytest.raises(ValueError):
        readers.documents(spark, {"type": "other"})


def test_rows_of_files_keep_their_order(spark, tmp_path):
    for f, n in (("b", 700), ("a", 900)):
        (tmp_path / f"{f}.jsonl").write_text("".join(json.dumps({"task_id": f"{f}{i:04d}", "checks": ["1"]}) + "\n" + "\n" * (i % 2) for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = [r["task_id"] for r in readers.tasks(spark, str(tmp_path)).orderBy("pos").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"a{i:04d}" for i in range(900)] + [f"b{i:04d}" for i in range(700)]
    assert [r["task_id"] for r in readers.tasks(spark, str(tmp_path / "b.jsonl"), 2).collect()] == ["b0000", "b0001"]
    (tmp_path / "bad.jsonl").write_text("{\n")
    with pytest.raises(Exception, match="read"):
        readers.preferences(spark, str(tmp_path / "bad.jsonl")).collect()


def test_splits_filter_skip_and_take(spark, tmp_path):
    data = [("print('a')", "py", "mit"), ("x", "c", "mit"), ("print('skip')", "py", "mit"), ("print('emit')", "py", "mit")]
    spark.createDataFrame(data, "code string, language string, license string").coalesce(1).write.parquet(str(tmp_path / "t"))
    config = {"type": "table", "path": str(tmp_path / "t"), "text_column": "code", "allowed": {"language": ["py"], "license": ["mit"]}, "splits": [{"split": "validation", "skip_documents": 1, "max_documents": 1}, {"split": "rest", "skip_documents": 2}]}
    assert rows(readers.documents(spark, config).orderBy("pos")) == [("validation-00000000", "print('skip')", "validation", 0), ("rest-00000000", "print('emit')", "rest", 1)]


def test_shards_and_their_manifest(spark, tmp_path):
    df = readers.inline(spark, [f"text {i}" for i in range(25)]).withColumn("split", F.when(F.col("pos") < 20, "train"))
    path = str(tmp_path / "corpus")
    said = readers.write_shards(df.coalesce(1), path, 10)
    assert [(s["split"], s["documents"], s["shards"]) for s in said["splits"]] == [("train", 20, 2), ("unsplit", 5, 1)]
    assert sorted(rows(readers.shard_list(spark, path).groupBy("split").count()), key=str) == [("train", 2), (None, 1)]
    assert readers.shard_list(spark, path, "train").count() == 2 and readers.read_shards(spark, path, "train").count() == 20
    merged = curate.merged(order.union([manifests.read_manifest(spark, path)] * 2)).orderBy("split").collect()
    assert [(r["split"], r["documents"], r["shards"]) for r in merged] == [("train", 40, 4), ("unsplit", 10, 2)]


def test_small_files_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "x" / "m.json")
    for text in ("one", "two \u00e9"):
        manifests.write_text(spark, path, text)
        assert manifests.read_text(spark, path) == text
    assert not [p for p in (tmp_path / "x").iterdir() if "pending" in p.name and not p.name.endswith(".crc")] and manifests.exists(spark, path)


def _field(number: int, data: bytes) -> bytes:
    return bytes([number << 3 | 2, len(data)]) + data


def test_checksums_are_those_of_the_format():
    """Known values of CRC-32C, before they are turned."""
    turned = lambda c: ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF
    assert scalars.checksum(b"123456789") == turned(0xE3069283) and scalars.checksum(b"") == turned(0) and scalars.checksum(bytes(32)) == turned(0x8A9136AA)


def test_scalar_events(spark, tmp_path):
    tensor = _field(1, b"t") + _field(8, b"\x08\x01" + _field(4, struct.pack("<f", 2.5)))
    version = scalars.record(b"\x09" + struct.pack("<d", 0.0) + _field(3, b"brain.Event:2"))
    data = version + scalars.record(scalars.event(2, "loss", 0.5)) + scalars.record(scalars.event(1, "loss", 1.0)) + scalars.record(b"\x10\x07" + _field(5, _field(1, tensor))) + b"cut off"
    (tmp_path / "events.out.tfevents.1").write_bytes(data)
    (tmp_path / "events.out.tfevents.2").write_bytes(b"")
    found = scalars.scalar_events(spark, str(tmp_path))
    assert sorted(rows(found.select("tag", "step", "value"))) == [("loss", 1, 1.0), ("loss", 2, 0.5), ("t", 7, 2.5)]
    points = {r["tag"]: [tuple(p) for p in r["points"]] for r in scalars.series(found).collect()}
    assert points["loss"] == [(1, 1.0), (2, 0.5)] and rows(scalars.step_of(found)) == [(7,)]


@pytest.mark.parametrize("piece", [40, 333, 5000])
def test_files_are_read_in_pieces_up_to_their_damage(spark, monkeypatch, piece):
    """A file that is whole, one cut off, and ones with a wrong byte in a length, in data and in a checksum; the same rows for any size of pieces."""
    step = lambda i: (i * i) << (i % 3 * 20)
    made = [scalars.record(scalars.event(step(i), "x" * (i % 40), i / 2)) for i in range(60)]
    at = [sum(map(len, made[:i])) for i in range(61)]
    whole = b"".join(made)
    bad = lambda place: whole[:place] + bytes([whole[place] ^ 1]) + whole[place + 1 :]
    files = {"whole": (whole, 60), "cut": (whole[: at[50] + 20], 50), "length": (bad(at[33] + 1), 33), "data": (bad(at[20] + 14), 20), "check": (bad(at[8] - 1), 7), "first": (bad(0), 0), "none": (b"", 0), "text": (b"no event file at all, " * 50, 0)}
    monkeypatch.setattr(scalars, "PIECE", piece)
    monkeypatch.setattr(scalars, "LARGEST", 200)
    df = spark.createDataFrame([(k, bytearray(v)) for k, (v, _) in files.items()] + [("null", None)], "path string, content binary")
    got = rows(scalars.scalars_in(df))
    assert sorted(got) == sorted((k, "x" * (i % 40), step(i), i / 2) for k, (_, n) in files.items() for i in range(n))


def test_bundles_list_their_files(spark, tmp_path, monkeypatch):
    """Any reader opens a bundle; it holds the last entry of each path, in order, also in many pieces."""
    rows_ = [("b", bytearray(b"old"), 0), ("a", bytearray(b"x"), 1), ("b", bytearray(b"new"), 2), ("d/\u00e9", bytearray(b""), 3), ("e", None, 4), ("z" * 300, bytearray(bytes(range(256)) * 99), 5)]
    rows_ += [(f"k{i:03d}", bytearray(f"member {i} ".encode() * (i % 7)), 9) for i in range(200)]
    df = spark.createDataFrame(rows_, "path string, content binary, pos long").repartition(5)
    for piece in (1 << 24, 500):
        monkeypatch.setattr(archives, "PIECE", piece)
        size = archives.bundle(df, f"{tmp_path}/b{piece}.zip", pos="pos", manifest="manifest.json")
        data = (tmp_path / f"b{piece}.zip").read_bytes()
        with zipfile.ZipFile(BytesIO(data)) as z:
            want = {p: bytes(c or b"") for p, c, _ in rows_ if p != "b"} | {"b": b"new"}
            assert size == len(data) and z.testzip() is None
            assert z.namelist() == ["manifest.json", *sorted(want)] and all(z.read(n) == c for n, c in want.items())
            told = json.loads(z.read("manifest.json"))["files"]
            assert [(f["path"], f["size"], f["sha256"]) for f in told] == [(n, len(want[n]), hashlib.sha256(want[n]).hexdigest()) for n in sorted(want)]
    assert not [p for p in tmp_path.iterdir() if p.name.endswith("pending")]
    with pytest.raises(ValueError, match="one path"):
        archives.bundle(df, f"{tmp_path}/c.zip")
    archives.bundle(df.limit(0), f"{tmp_path}/none.zip")
    assert zipfile.ZipFile(f"{tmp_path}/none.zip").namelist() == []


def test_directories_of_large_bundles():
    """Offsets beyond 4 GB and more members than 16 bits count stand in the longer fields."""
    members = [archives.Member(f"m{i}", 1, 3, 0x12345678, "") for i in range(70_000)]
    found = [(m, i * 100_000) for i, m in enumerate(members)]
    at = 7_000_000_000

    class Sparse(BytesIO):
        """A file whose first bytes are not there."""

        def __init__(self, data):
            super().__init__(data)

        def seek(self, to, how=0):
            return at + super().seek(to - at if how == 0 else to, how)

        def tell(self):
            return at + super().tell()

    with zipfile.ZipFile(Sparse(b"".join(archives._directory(found, at)))) as z:
        assert len(z.infolist()) == 70_000 and all(i.header_offset == k * 100_000 and i.CRC == 0x12345678 for k, i in enumerate(z.infolist()))


def test_shared_folder_has_to_be_named():
    made = lambda master, path=None: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: path or default), sparkContext=SimpleNamespace(master=master, applicationId="test"))
    assert session.shared_dir(made("local[2]")).startswith("file:") and session.shared_dir(made("spark://host:7077", "hdfs:/x")) == "hdfs:/x"
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        session.shared_dir(made("spark://host:7077"))


# Tokenizers and packing.


def test_merges_and_marks():
    t = tokenize.BytePairs(((b"a", b"b"), (b"ab", b"ab")), ("<fim_prefix>", "<fim_prefix>x"), eos="<eos>")
    ids = t.encode("ababab<fim_prefix>x\u00e9<fim_prefix>", eos=True)
    assert t.marks == ("<eos>", "<fim_prefix>", "<fim_prefix>x") and ids == [3 + 257, 3 + 256, 2, 3 + 0xC3, 3 + 0xA9, 1, 0]
    assert t.decode(ids) == "ababab\u00e9" and t.decode([3 + 250]) == "\ufffd"
    assert tokenize.BytePairs.from_json(t.to_json()) == t
    assert tokenize.BytePairs(((b"a", b"b"),), eos="<eos>").size == 1 + 256 + 1
    with pytest.raises(ValueError):
        tokenize.BytePairs(((b"ab", b"c"),))


def test_batch_encoding_is_that_of_the_definition():
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randrange(40))) for _ in range(60)]
    merges = tokenize.train_merges(iter(texts), 12)
    t = tokenize.BytePairs(tuple(merges), ("c ",))
    rank = {p: i for i, p in enumerate(merges)}

    def plain(part):
        tokens = [bytes([b]) for b in part.encode()]
        while len(tokens) > 1:
            best = min(zip(tokens, tokens[1:], strict=False), key=lambda p: rank.get(p, len(rank)))
            if best not in rank:
                break
            tokens = tokenize.merge(tokens, *best)
        return [1 + t.table.index(x) for x in tokens]

    want = [[y for k, p in enumerate(tokenize._pieces(x, t.specials)) for y in (plain(p) if k % 2 == 0 else [0])] for x in texts]
    assert [x.tolist() for x in t.encode_all(texts)] == want


def test_characters_with_marks(spark, tmp_path):
    specials = ("<bos>", "<eos>", "<pad>", "<m>")
    df = spark.createDataFrame([(0, "a\U0001f600<m>b"), (1, ""), (2, None)], "pos long, text string")
    vocabulary = {t: i for i, t in enumerate([*specials, "a", "b", "\U0001f600"])}
    out = tokenize.character_encode(df, vocabulary, specials=specials)
    assert [r["tokens"] for r in out.orderBy("pos").collect()] == [[4, 6, 3, 5], [], None]
    assert [r["decoded"] for r in tokenize.character_decode(out, vocabulary, specials=specials).orderBy("pos").collect()] == ["a\U0001f600b", "", None]
    with pytest.raises(PySparkException, match="unknown character"):
        tokenize.character_encode(df, {"a": 0}).collect()
    tokenize.save_characters(spark, vocabulary, str(tmp_path))
    assert tokenize.load_characters(spark, str(tmp_path)) == vocabulary
    t = tokenize.BytePairs(((b"a", b"b"),), ("<m>",))
    t.save(spark, str(tmp_path / "b"))
    assert tokenize.BytePairs.load(spark, str(tmp_path / "b")) == t


def test_bounded_prefix_needs_a_document(spark):
    df = readers.inline(spark, ["aaaa", "bbbb", "cccc"])
    assert order.bounded_prefix(df, 10, 8, strict=True).count() == 2
    with pytest.raises(ValueError, match="larger"):
        order.bounded_prefix(df, 10, 3, strict=True)
    with pytest.raises(ValueError, match="no document"):
        order.bounded_prefix(df.limit(0), 10, 3, strict=True)


def test_packing_run(spark, tmp_path):
    t = tokenize.BytePairs((), ("<p>", "<s>", "<m>"), bos="<bos>", eos="<eos>", pad="<pad>")
    encode = lambda df: df.withColumn("tokens", tokenize.bpe_encode(t)("text"))
    docs = readers.inline(spark, ["abcdefghi", "xyz"])
    packed = pack.pack(docs, encode, 4, t.id_of("<pad>"), t.id_of("<bos>"), t.id_of("<eos>"), fim={"probability": 1.0, "least": 3, "marks": ("<p>", "<s>", "<m>")})
    one = [6 + ord(c) if len(c) == 1 else t.id_of(c) for c in ("<bos>", "<p>", "a", "b", "c", "<s>", "g", "h", "i", "<m>", "d", "e", "f", "<eos>", "<bos>", "x", "y", "z", "<eos>")]
    want = [(one[4 * k : 4 * k + 5] + [t.id_of("<pad>")] * 5)[:5] for k in range(5)]
    assert [r["token_ids"] for r in packed.orderBy("k").collect()] == want
    index = pack.write_shards(packed, str(tmp_path / "out"), 5, 11).orderBy("shard").collect()
    assert [(r["shard"], r["sequences"], r["first_sequence"], r["tokens"]) for r in index] == [(0, 2, 0, 10), (1, 2, 2, 10), (2, 1, 4, 5)]
    flat = pack.uint16(spark.read.parquet(str(tmp_path / "out/shards"))).orderBy("shard").collect()
    assert bytes(flat[0]["data"]) == struct.pack("<10H", *want[0], *want[1]) and [r["sequences"] for r in flat] == [2, 2, 1]
    alone = pack.pack(docs, encode, 4, 9, across=False).orderBy("k").collect()
    assert [r["k"] for r in alone] == [0, 1, 2] and alone[2]["token_ids"][:4] == [6 + ord(c) for c in "xyz"] + [9]
    with pytest.raises(ValueError, match="no rows"):
        pack.write_shards(packed.limit(0), str(tmp_path / "none"), 5, 11)
    with pytest.raises(ValueError):
        pack.write_shards(packed, str(tmp_path / "small"), 5, 4)


def test_tokenizers_take_arrow_arrays(spark):
    """Texts and ids without an object an id: nulls, empty texts and slices; the library's encoding stands once in a plan."""
    assert tokenize._lists([None, np.array([1, 2]), [], [3]]).to_pylist() == [None, [1, 2], [], [3]]
    assert [x if x is None else x.tolist() for x in tokenize._arrays(pa.array([[9], None, [], [4, 5]], pa.list_(pa.int32())).slice(1))] == [None, [], [4, 5]]
    df = spark.createDataFrame([(0, "héab"), (1, None), (2, ""), (3, "bb")], "pos long, text string").coalesce(1)
    vocabulary = {"<bos>": 0, "a": 1, "b": 2, "h": 3, "é": 4}
    got = tokenize.character_decode(tokenize.character_encode(df, vocabulary), vocabulary).orderBy("pos").collect()
    assert [(r["tokens"], r["decoded"]) for r in got] == [([3, 4, 1, 2], "héab"), (None, None), ([], ""), ([2, 2], "bb")]
    pairs = tokenize.BytePairs(((b"a", b"b"),))
    back = df.withColumn("ids", tokenize.bpe_encode(pairs)("text")).withColumn("back", tokenize.bpe_decode(pairs)("ids")).orderBy("pos").collect()
    assert [r["back"] for r in back] == ["héab", None, "", "bb"] and [r["ids"] and len(r["ids"]) for r in back] == [4, None, [], 2]
    once = df.withColumn("ids", tokenize.library_encode(tokenize.LibraryPairs("{}"))("text")).select(F.size("ids"), F.array_max("ids"))
    assert once._jdf.queryExecution().optimizedPlan().toString().count("run(text") == 1


def test_small_shards_share_files(spark, tmp_path):
    """300 shards of a row each in a file, and one a file where shards are large; whole either way."""
    rows = spark.range(300).select(F.col("id").alias("k"), F.array(F.col("id").cast("int"), F.lit(1)).alias("token_ids")).repartition(3)
    for most, files in ((2, 1), (1 << 20, 1), (200, 1)):
        out = tmp_path / str(most)
        index = pack.write_shards(rows, str(out), 2, most)
        per = most // 2
        assert sorted((r["shard"], r["sequences"], r["first_sequence"]) for r in index.collect()) == [(s, min(per, 300 - s * per), s * per) for s in range(-(-300 // per))]
        assert sorted((r["shard"], r["k"], r["token_ids"]) for r in spark.read.parquet(str(out / "shards")).collect()) == [(k // per, k, [k, 1]) for k in range(300)]
        assert len(list((out / "shards").rglob("*.parquet"))) == files


def test_training_split(spark):
    df = readers.inline(spark, ["a", "b"]).withColumn("split", F.when(F.col("pos") == 0, "train"))
    assert pack.training_split(df).count() == 1 and pack.training_split(df.where("pos = 1")).count() == 1


def test_merges_of_all_documents_can_be_counted(spark):
    assert rows(tokenize.pair_counts(readers.inline(spark, ["aa\u00e9", "a", ""])).orderBy("left", "right")) == [(97, 97, 1), (97, 0xC3, 1), (0xC3, 0xA9, 1)]


# Stages.


def test_stages_write_manifests(tmp_path):
    ran = []

    def fail(folder):
        raise RuntimeError("no disk")

    stages = [lineage.Stage("a", {"x": 1}, [], lambda f: ran.append("a") or {"metrics": {"n": 1}}), lineage.Stage("b", {}, ["a"], fail), lineage.Stage("c", {}, ["b"], lambda f: ran.append("c"))]
    assert lineage.run_all(stages, tmp_path) == {"a": "complete", "b": "failed: RuntimeError: no disk", "c": "skipped"} and ran == ["a"]
    assert lineage.read_manifest(tmp_path / "a")["metrics"] == {"n": 1} and "no disk" in lineage.read_manifest(tmp_path / "b")["cause"]
    assert lineage.run_all(stages, tmp_path)["a"] == "cached"
    stages[0].config["x"] = 2
    assert lineage.run_all(stages, tmp_path)["a"] == "complete" and ran == ["a", "a"]
    assert {p.name for p in tmp_path.rglob("*") if p.is_file()} == {"manifest.json"}
