"""Allow and block rules for URLs, looked up in a trie of reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rule set of at most this many bytes is sent to every executor as a trie; a larger one is joined.
MAX_BROADCAST_BYTES = 8 << 20
#: Pages of one host are dealt over so many groups where rules are joined.
SALTS = 16


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for ``host``, its subdomains and paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def weight(self) -> tuple:
        """The longest rule wins; at equal length the longer host, then block before allow."""
        return len(self.text), len(self.host), self.verdict == "block"


@dataclass
class _Node:
    children: dict = field(default_factory=dict)
    paths: _Node | None = None
    #: rules that end inside a segment, by the part of that segment they fix
    partial: dict = field(default_factory=dict)


class RuleTrie:
    """Host labels from the right, then path segments; a lookup walks one path of each."""

    def __init__(self, rules: Iterable[Rule]):
        self.root = _Node()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.children.setdefault(label, _Node())
            node.paths = node.paths or _Node()
            node = node.paths
            *whole, part = rule.path.split("/")
            for segment in whole:
                node = node.children.setdefault(segment, _Node())
            held = node.partial.get(part)
            if held is None or rule.weight > held.weight:
                node.partial[part] = rule

    def find(self, host: str, path: str) -> Rule | None:
        best = None
        segments = path.split("/")
        node = self.root
        for label in reversed(host.split(".")):
            node = node.children.get(label)
            if node is None:
                break
            at = node.paths
            for segment in segments:
                if at is None:
                    break
                for part, rule in at.partial.items():
                    if segment.startswith(part) and (best is None or rule.weight > best.weight):
                        best = rule
                at = at.children.get(segment)
        return best


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null and for texts without it."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def judge_urls(
    df: DataFrame,
    rules: Iterable[Rule] | DataFrame,
    url: str = "url",
    default: str = "allow",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """``df`` with columns host, path, rule and verdict; columns of ``df`` with these names are replaced.

    ``rules`` is a collection of `Rule` or a frame (host, path, verdict). A frame's size is
    measured first: up to ``max_broadcast_bytes`` its trie goes to every executor, beyond it the
    rules are joined by host suffix and leading path. A null URL, or one without
    ``://``, has an empty host and path and so no rule. Repeated rules count once.
    """
    parts = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if isinstance(rules, DataFrame):
        rules = rules.select("host", "path", "verdict").dropna().distinct()
        size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
        if size > max_broadcast_bytes:
            return _judge_by_join(parts, rules, default)
        rules = [Rule(*r) for r in rules.collect()]
    return _judge_by_trie(parts, list(rules), default)


def _judge_by_trie(parts: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    sent = parts.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    @F.arrow_udf("struct<rule: string, verdict: string>")
    def judged(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        trie = sent.value
        found = [trie.find(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
        return pa.StructArray.from_arrays(
            [
                pa.array([None if r is None else r.text for r in found], pa.string()),
                pa.array([default if r is None else r.verdict for r in found], pa.string()),
            ],
            names=["rule", "verdict"],
        )

    out = parts.withColumn("__judged", judged("host", "path"))
    return out.withColumns({"rule": F.col("__judged.rule"), "verdict": F.col("__judged.verdict")}).drop("__judged")


def _judge_by_join(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """For rule sets of any size: each distinct (host, path) meets, for each suffix of its host that has
    rules, those that equal its path's start of each length that the suffix's rules have.

    Both joins are by equality with a table of one row a key, so a page meets a rule only if it fits.
    Pages of one host, however many, are dealt over `SALTS` groups; rules are repeated in each.
    """
    salted = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    block = F.max(F.col("verdict") == "block").alias("block")
    rule = rules.groupBy(F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).agg(block)
    lengths = rule.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pages = parts.select("host", "path").distinct()
    probes = (
        pages.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
        .withColumn("rule_host", F.explode(suffixes))
        .join(lengths.select("*", salted), ["rule_host", "salt"])
        .withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))))
        .withColumn("rule_path", F.substr("path", F.lit(1), F.col("n")))
    )
    weight = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("n"),
        F.length("rule_host").alias("h"),
        "block",
        F.concat("rule_host", "rule_path").alias("rule"),
    )
    best = probes.join(rule.select("*", salted), ["rule_host", "rule_path", "salt"]).groupBy("host", "path").agg(F.max(weight).alias("best"))
    out = parts.drop("rule", "verdict").join(best, ["host", "path"], "left")
    verdict = F.when(F.col("best.block"), F.lit("block")).when(~F.col("best.block"), F.lit("allow")).otherwise(F.lit(default))
    return out.withColumns({"rule": F.col("best.rule"), "verdict": verdict}).drop("best")
