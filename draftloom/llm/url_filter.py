"""URL allow and block lists: a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules above this count are joined instead of broadcast.
MAX_BROADCAST_RULES = 200_000

#: (host, path, verdict) of the registered query.
QUERY_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


@dataclass(slots=True)
class Node:
    """Below a host: ``labels`` by the next label to the left. Below a path: ``segments`` by whole segment.
    ``ends`` holds (text that must start the next segment, rule, verdict) of rules that end here."""

    labels: dict = field(default_factory=dict)
    segments: dict = field(default_factory=dict)
    ends: list = field(default_factory=list)


def build_trie(rules: Sequence[tuple[str, str, str]]) -> Node:
    """Of two entries with the same host and path the block entry holds. A rule's path is a plain prefix of the URL's path."""
    root = Node()
    for host, path, verdict in sorted(set(rules), key=lambda r: (r[0], r[1], r[2] == "allow")):
        node = root
        for label in reversed(host.split(".")):
            node = node.labels.setdefault(label, Node())
        *whole, rest = path.split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        if all(end[0] != rest for end in node.ends):
            node.ends.append((rest, host + path, verdict))
            node.ends.sort(key=lambda end: -len(end[0]))
    return root


def longest_match(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """The rule with the most host labels and, of those, the longest path; (rule, verdict), or None."""
    hosts, node = [], root
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        hosts.append(node)
    segments = path.split("/")
    for node in reversed(hosts):
        best = None
        for segment in segments:
            best = next((end for end in node.ends if segment.startswith(end[0])), best)
            node = node.segments.get(segment)
            if node is None:
                break
        if best:
            return best[1], best[2]
    return None


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(found, upper, upper.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(
    df: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    url_col: str = "url",
    default: str = "allow",
    max_broadcast_rules: int = MAX_BROADCAST_RULES,
) -> DataFrame:
    """Add host, path, rule and verdict to ``df``, in place of columns with these names.

    The longest rule that fits decides: more host labels first, then the longer path; without one the verdict is
    ``default``. A rule fits its host and all subdomains if the URL's path starts with its path. Null URLs and URLs
    without ``://`` have empty host and path and fit no rule (hosts of rules are never empty). Repeated rows stay;
    an empty table gives an empty result. Up to ``max_broadcast_rules`` rules the trie is broadcast; beyond, the
    candidates of each URL are joined with the rules.
    """
    if any(not host for host, _, _ in rules):
        raise ValueError("a rule needs a host")
    out = df.withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    if len(rules) > max_broadcast_rules:
        return _by_join(out, df.sparkSession, rules, default)
    trie = df.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("struct<rule string, verdict string>")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        root = trie.value
        for hosts, paths in batches:
            found = [longest_match(root, h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    # the struct's name must not clash with a column of the input
    name = "judged"
    while name in out.columns:
        name += "_"
    judged = out.withColumn(name, judge("host", "path"))
    return judged.withColumns({"rule": F.col(f"{name}.rule"), "verdict": F.col(f"{name}.verdict")}).drop(name)


def _by_join(out: DataFrame, spark: SparkSession, rules: Sequence[tuple[str, str, str]], default: str) -> DataFrame:
    """Distinct (host, path) pairs, exploded to host suffixes and whole-segment prefixes, meet the rules by equality."""
    entries = [(h, p[: p.rfind("/") + 1], p[p.rfind("/") + 1 :], h + p, v, len(h.split(".")), len(p)) for h, p, v in rules]
    table = spark.createDataFrame(entries, "r_host string, r_lead string, r_rest string, r_rule string, r_verdict string, r_labels int, r_len int")
    keys = out.select(F.col("host").alias("k_host"), F.col("path").alias("k_path")).distinct()
    labels, parts = F.split("k_host", r"\."), F.split("k_path", "/")
    near = (
        keys.withColumn("r_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
        .withColumn("cut", F.explode(F.sequence(F.lit(0), F.size(parts) - 1)))
        .withColumn("r_lead", F.when(F.col("cut") == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), F.col("cut")), "/"), F.lit("/"))))
    )
    best = (
        near.join(table, ["r_host", "r_lead"])
        .where(F.startswith(F.col("k_path"), F.concat("r_lead", "r_rest")))
        .groupBy("k_host", "k_path")
        .agg(F.max(F.struct("r_labels", "r_len", (F.col("r_verdict") == "block").alias("blocks"), "r_rule", "r_verdict")).alias("best"))
    )
    joined = out.drop("rule", "verdict").join(best, (out.host == best.k_host) & (out.path == best.k_path), "left")
    return joined.withColumns({"rule": F.col("best.r_rule"), "verdict": F.coalesce("best.r_verdict", F.lit(default))}).drop("k_host", "k_path", "best")
