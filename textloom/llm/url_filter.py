"""URL filter: a trie over reversed host labels and path segments, with longest-match precedence."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm._spark import written

#: Rules up to this number make a trie that is broadcast (about 300 bytes each in a worker); longer lists meet the addresses by joins, with the same results.
BROADCAST_RULES = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = str.maketrans(_UPPER, _LOWER)


def _rank(verdict: str, rule: str) -> tuple[bool, str]:
    return verdict != "allow", rule


class Trie:
    """Rules (verdict, "host/path"). A rule fits its host and all subdomains if the path starts with the rule's.

    Of the rules that fit, the one with the most host labels wins, then the longest path; of
    equal rules allow, and then the smallest as it is written.
    """

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for verdict, rule in rules:
            host, slash, rest = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_ASCII_LOWER).split(".")):
                node = node.setdefault(("h", label), {})
            *whole, tail = (slash + rest).split("/")
            for segment in whole:
                node = node.setdefault(("p", segment), {})
            tails = node.setdefault("tails", {})  # the last piece is a prefix of a segment
            if tail not in tails or _rank(verdict, rule) < _rank(*reversed(tails[tail])):
                tails[tail] = (rule, verdict)

    def _path(self, node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            if "tails" in node:
                tails = node["tails"]
                fits = [t for t in tails if segment.startswith(t)] if len(tails) <= 16 else [segment[:k] for k in range(len(segment) + 1) if segment[:k] in tails]
                if fits:
                    best = tails[max(fits, key=len)]
            node = node.get(("p", segment))
            if node is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(("h", label))
            if node is None:
                break
            best = self._path(node, segments) or best
        return best


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first :// up to / ? # or the end, the path from there up to ? # or the end; both empty without :// or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    whole = F.regexp_extract(rest, "^[^?#]*", 0)
    host = F.regexp_extract(whole, "^[^/]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(F.substr(whole, F.length(host) + 1), F.lit(""))


_FOUND = pa.struct([("rule", pa.string()), ("verdict", pa.string())])


def _by_trie(addresses: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """rows (page_id, host, path) with found, the rule that fits and its verdict, or null."""
    shared = addresses.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            found = [trie.find(host, path) for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            column = pa.array([f and {"rule": f[0], "verdict": f[1]} for f in found], _FOUND)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=["page_id", "host", "path", "found"])

    return addresses.mapInArrow(run, "page_id long, host string, path string, found struct<rule:string,verdict:string>")


def _by_join(addresses: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """The same for rules of any number: host suffixes, then path prefixes of the lengths that a host's rules have, meet the rules by equality."""
    spark = addresses.sparkSession
    listed = spark.createDataFrame(rules, "verdict string, rule string")
    whole = F.regexp_extract("rule", "^[^/]*", 0)
    listed = listed.select(F.translate(whole, _UPPER, _LOWER).alias("suffix"), F.substr("rule", F.length(whole) + 1).alias("prefix"), F.struct((F.col("verdict") != "allow").alias("last"), "rule", "verdict").alias("r"))
    listed = written(listed.groupBy("suffix", "prefix").agg(F.min("r").alias("r")).select("suffix", "prefix", F.struct("r.rule", "r.verdict").alias("found")), "rules")
    lengths = listed.groupBy("suffix").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    asked = written(addresses.select("host", "path").distinct(), "addresses")
    labels = F.split("host", "\\.")
    parts = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("suffix"), (-i).alias("depth"))))
    each = asked.select("host", "path", parts.alias("p")).select("host", "path", "p.suffix", "p.depth").join(lengths, "suffix")
    each = each.select("host", "path", "suffix", "depth", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("path")).withColumn("prefix", F.substr("path", F.lit(1), F.col("n")))
    best = each.join(listed, ["suffix", "prefix"]).groupBy("host", "path").agg(F.max_by("found", F.struct("depth", "n")).alias("found"))
    return addresses.join(best, ["host", "path"], "left")


def judge(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", page: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of each page row; without a rule that fits, rule is null and the verdict the default.

    A null url, or one without ://, has an empty host and path and gets the default unless a rule fits these. Each row is judged by itself, whether or not others share its id or url.
    """
    host, path = split_url(F.col(url).cast("string"))
    addresses = pages.select(F.col(page).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    found = (_by_trie if len(rules) <= BROADCAST_RULES else _by_join)(addresses, list(rules))
    return found.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
