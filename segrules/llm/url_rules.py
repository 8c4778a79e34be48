"""Allow and block rules for urls by a trie over reversed host labels and path segments.

The first levels of the trie are the labels of a rule's host from the last to the first, so a host's
subdomains lie below it.  From any host node the whole segments of the path lead on,
and what a rule has after its last slash is kept at the node as a prefix of the next segment.
A walk goes as far as the url does; of the rules that it meets the one with the deepest host, then the
longest path decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segrules.llm.common import ascii_lower, pick
from segrules.session import cut_lineage

ALLOW, BLOCK = "allow", "block"
#: Up to so many rules, and code points in them, go to every task as a trie; more are joined.
TRIE_RULES, TRIE_POINTS = 200_000, 10_000_000

Rule = tuple[str, str, str]  # action, host, path


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))


def labels(host: str) -> list[str]:
    return host.split(".")[::-1] if host else []


class Node:
    """A place in the trie: ways on by host label and by whole path segment, and rules that end here,
    by the beginning of the next segment that they ask for."""

    __slots__ = ("hosts", "segments", "ends", "lengths")

    def __init__(self) -> None:
        self.hosts: dict[str, Node] = {}
        self.segments: dict[str, Node] = {}
        self.ends: dict[str, tuple[str, str]] = {}
        self.lengths: list[int] = []  # of the keys of ``ends``, longest first

    def on(self, ways: str, key: str) -> Node:
        return getattr(self, ways).setdefault(key, Node())


def build_trie(rules: Iterable[Rule]) -> Node:
    """The trie of (action, host, path); of equal rules with both actions the block counts."""
    root = Node()
    for action, host, path in rules:
        node = root
        for label in labels(host):
            node = node.on("hosts", label)
        *whole, rest = path.split("/")
        for segment in whole:
            node = node.on("segments", segment)
        if node.ends.get(rest, (ALLOW,))[0] != BLOCK:
            node.ends[rest] = (action, host + path)
            node.lengths = sorted({len(x) for x in node.ends}, reverse=True)
    return root


def longest_path(node: Node, path: str) -> tuple[str, str] | None:
    """The rule with the longest path that ``path`` starts with, from a host's node on."""
    found, start = None, 0
    while True:
        stop = path.find("/", start)
        end = len(path) if stop < 0 else stop
        # a rule's rest may end anywhere in the next segment, the empty rest at once
        for n in node.lengths:
            if n <= end - start and path[start : start + n] in node.ends:
                found = node.ends[path[start : start + n]]
                break
        if stop < 0:
            return found
        node = node.segments.get(path[start:stop])
        if node is None:
            return found
        start = stop + 1


def longest_rule(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """(action, rule) of the rule with the deepest host, then the longest path that fits; None if none does."""
    node, found = root, longest_path(root, path)
    for label in labels(host):
        node = node.hosts.get(label)
        if node is None:
            break
        found = longest_path(node, path) or found
    return found


def normalised_rules(rules: DataFrame) -> DataFrame:
    """Distinct (action, host, path): hosts lower-cased, nulls as empty, rules without an action gone."""
    return (
        pick(rules, "action", "host", "path")
        .where(F.col("action").isNotNull())
        .select("action", F.coalesce(ascii_lower(F.col("host")), F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
        .groupBy("host", "path")
        .agg(F.max("action").alias("action"))  # block, if any
        .select("action", "host", "path")
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = ALLOW, trie_rules: int = TRIE_RULES, trie_points: int = TRIE_POINTS) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    ``rules`` has action (allow or block, others raise), host and path.  A rule fits its host and the
    host's subdomains, if the url's path starts with the rule's.  Of the rules that fit the one with the most host labels
    counts, then the one with the longest path, of two equal ones the block; ``rule`` is its host and path.
    Without one ``rule`` is null and the verdict ``default``.

    Edge cases: a null url and one without ``://`` have an empty host and path, which only a rule with
    an empty host and path fits (it fits every url); a null host or path of a rule is empty, a rule
    without an action is none; hosts of rules are lower-cased as those of urls are; ports and
    user names belong to the host, as they stand.  Repeated rows are judged each; other columns are
    ignored; empty tables give an empty result, or the default for all.

    Scale: one scan without a shuffle while the rules are few (``trie_rules`` and ``trie_points``, counted before
    they are collected); beyond that a join on host and whole path segments, see :func:`judge_by_join`.
    """
    known = cut_lineage(normalised_rules(rules), "rules")
    n, points, odd = known.agg(
        F.count("*"), F.coalesce(F.sum(F.char_length("host") + F.char_length("path")), F.lit(0)), F.count_if(~F.col("action").isin(ALLOW, BLOCK))
    ).first()
    if odd:
        raise ValueError(f"an action is {ALLOW!r} or {BLOCK!r}")
    places = pick(pages, "page_id", "url").select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    if n > trie_rules or points > trie_points:
        return judge_by_join(places, known, default)
    trie = pages.sparkSession.sparkContext.broadcast([tuple(r) for r in known.collect()])  # within the two bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = build_trie(trie.value)
        for b in batches:
            found = [longest_rule(root, h, p) or (default, None) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            out = [pa.array([f[1] for f in found], pa.string()), pa.array([f[0] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *out], ["page_id", "host", "path", "rule", "verdict"])

    kind = dict(places.dtypes)["page_id"]
    return places.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def judge_by_join(places: DataFrame, rules: DataFrame, default: str = ALLOW) -> DataFrame:
    """The same verdicts for rule lists of any length; ``places`` has page_id, host and path.

    The trie's edges become join keys: a url goes once to each of its host's suffixes and each of its path's whole
    segments (as far as the rules at the deepest go), a rule waits at its own.  Places are judged once however often they
    occur, so a hot place is one row; what is joined are a url's labels times segments, never rules with rules.
    """
    depth = F.size(F.split("host", r"\.")) * (F.col("host") != "").cast("int")
    slashes = F.char_length("path") - F.char_length(F.replace("path", F.lit("/"), F.lit("")))
    at = rules.select(
        F.col("host").alias("rule_host"), F.expr("left(path, length(path) - length(substring_index(path, '/', -1)))").alias("rule_dir"),
        F.col("path").alias("rule_path"), "action", depth.alias("rule_depth"),
    )
    deepest, most = rules.agg(F.coalesce(F.max(depth), F.lit(0)), F.coalesce(F.max(slashes), F.lit(0))).first()
    distinct = cut_lineage(places.select("host", "path").distinct().withColumn("place", F.monotonically_increasing_id()), "places")
    hosts = F.transform(
        F.sequence(F.lit(0), F.least(depth, F.lit(deepest))), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i)
    )
    dirs = F.transform(
        F.sequence(F.lit(0), F.least(slashes, F.lit(most))),
        lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), i), F.lit("/"))),
    )
    keys = distinct.select("place", "path", F.explode(hosts).alias("rule_host"), dirs.alias("dirs"))
    keys = keys.select("place", "path", "rule_host", F.explode("dirs").alias("rule_dir"))
    fits = keys.join(at, ["rule_host", "rule_dir"]).where(F.col("path").startswith(F.col("rule_path")))
    best = fits.groupBy("place").agg(
        F.max_by(F.struct("action", F.concat("rule_host", "rule_path").alias("rule")), F.struct("rule_depth", F.char_length("rule_path"))).alias("best")
    )
    judged = distinct.join(best, "place", "left").select(
        "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
    return places.join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict")
