"""URL verdicts from a trie over reversed host labels and path segments."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import written

#: Above so many rules, or bytes of a trie of them, the trie isn't broadcast; judge_urls() then joins.
MAX_BROADCAST_RULES, MAX_BROADCAST_BYTES = 1_000_000, 256 << 20
#: Bytes of a rule in the trie besides its text, and of each step, at most.
RULE_BYTES, STEP_BYTES = 400, 600

DEFAULT_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@dataclass
class Node:
    """A step of the trie. hosts: the next label to the left; paths: the next whole segment; tails: rules by their last segments, which
    fit as prefixes, and the lengths of these, longest first."""

    hosts: dict
    paths: dict
    tails: dict
    lengths: tuple = ()


def _node() -> Node:
    return Node({}, {}, {})


def trie_bytes(rules: list[tuple[str, str, str]]) -> int:
    """No less than what a trie of the rules takes."""
    return sum(RULE_BYTES + 4 * (len(h) + len(p)) + STEP_BYTES * (2 + h.count(".") + p.count("/")) for _, h, p in rules)


def build_trie(rules: list[tuple[str, str, str]]) -> Node:
    """Rules are (verdict, host, path); of two with one host and path the later holds."""
    root, ends = _node(), []
    for verdict, host, path in rules:
        at = root
        for label in reversed(host.lower().split(".")) if host else ():
            at = at.hosts.setdefault(label, _node())
        at = at.paths.setdefault(None, _node())  # where this host's paths begin
        *whole, tail = path.split("/")
        for segment in whole:
            at = at.paths.setdefault(segment, _node())
        at.tails[tail] = (f"{host}{path}", verdict)
        ends.append(at)
    for at in ends:
        if not at.lengths:
            at.lengths = tuple(sorted({len(t) for t in at.tails}, reverse=True))
    return root


def _along_path(top: Node, segments: list[str]) -> tuple | None:
    """The rule with the longest path that segments start with."""
    best, at = None, top
    for segment in segments:
        for n in at.lengths:  # no more than the longest segment has characters, however many rules end here
            if n <= len(segment) and (rule := at.tails.get(segment[:n])):
                best = rule
                break
        at = at.paths.get(segment)
        if at is None:
            break
    return best


def longest_match(root: Node, host: str, path: str) -> tuple | None:
    """(rule, verdict) of the rule with the most host labels that fits, and among those the longest path."""
    segments, best, at = path.split("/"), None, root
    for label in [None, *reversed(host.split("."))] if host else [None]:
        if label is not None:
            at = at.hosts.get(label)
            if at is None:
                break
        if None in at.paths and (found := _along_path(at.paths[None], segments)):
            best = found
    return best


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased. Path: from there up to '?', '#' or the end. Both empty without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def _by_join(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The same result where there are too many rules to broadcast: every (host suffix, path prefix) that some rule's lengths allow is looked up in the rules."""
    spark = pages.sparkSession
    table = spark.createDataFrame([(h.lower(), p, f"{h}{p}", v, i) for i, (v, h, p) in enumerate(rules)], "rh string, rp string, rule string, verdict string, seq int")
    table = table.groupBy("rh", "rp").agg(F.max_by("rule", "seq").alias("rule"), F.max_by("verdict", "seq").alias("verdict"))
    lengths = sorted({len(p) for _, _, p in rules})
    keyed = written(pages.withColumn("__row", F.monotonically_increasing_id()))  # read twice: numbers have to stay
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    probes = keyed.select("__row", F.explode(suffixes).alias("rh"), F.col("path")).withColumn("rp", F.explode(prefixes)).drop("path")
    best = probes.join(table, ["rh", "rp"]).groupBy("__row").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rh"), F.length("rp"))).alias("m"))
    return keyed.join(best, "__row", "left").select(*pages.columns, F.col("m.rule").alias("rule"), F.coalesce("m.verdict", F.lit("allow")).alias("verdict"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, default: str = "allow", max_broadcast: int = MAX_BROADCAST_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages(page_id, url).

    A rule fits its host and all subdomains if the path starts with the rule's path. The rule with the most host labels
    holds, then the one with the longest path; without one, verdict is `default` and rule is null. A null or malformed
    url has an empty host and path. Repeated rows are judged each; other columns are not read. The trie is built on the
    driver and sent with the task, up to max_broadcast rules and MAX_BROADCAST_BYTES; beyond that the rules are joined.
    """
    rules = DEFAULT_RULES if rules is None else rules
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    if len(rules) > max_broadcast or trie_bytes(rules) > MAX_BROADCAST_BYTES:
        return _by_join(parts, rules)
    trie = build_trie(rules)
    held = pages.sparkSession.sparkContext.broadcast(trie)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, seen = held.value, {}
        for batch in batches:
            out = []
            for key in zip(batch["host"].to_pylist(), batch["path"].to_pylist()):
                if key not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen[key] = longest_match(root, *key) or (None, default)
                out.append(seen[key])
            rule, verdict = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return parts.mapInArrow(judged, f"page_id {dict(parts.dtypes)['page_id']}, host string, path string, rule string, verdict string")
