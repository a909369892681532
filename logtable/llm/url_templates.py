"""URL filtering: given rules first, then a tree of path templates learned from labelled urls.

**Rules** are pairs of host and path. A rule fits its host and all subdomains if the url's path starts with the
rule's; the longest wins (by characters of host and path), of equally long ones the first in code point order.

**The tree.** Urls of a host hang on the segments of their paths, the host being the root. Runs of digits and
long hexadecimal ids are typed places ({n}, {h}) from the start. Level by level, and apart for every node:

1. *Generalise.* A segment with at least ``MIN_URLS`` urls and ``MIN_SHARE`` of its node's urls is a branch
   of its own; so a node has at most 1/MIN_SHARE of them. All others are variable: one wildcard branch {*}.
2. *Merge.* Branches are taken by urls, the most first. One joins the first branch whose profile lies within
   ``MERGE_DISTANCE`` of its own (total variation). A profile is the share of urls by label (blocked, allowed,
   none) and by what follows (the path's end, a typed place, a word). Merged branches go on as one node.

The leaves are templates. A template is rejected if the share of blocked among its labelled urls, smoothed towards
the table's by ``PRIOR_URLS`` urls, is at least ``REJECT_FROM``; without a labelled url it never is.

**Spark.** The tree grows over distinct (host, typed path) rows with counts, one aggregation and one join a level;
levels beyond ``DEPTH`` hang on as one segment, so no path is cut. Joins by node or path broadcast the few
hot keys (``joined_by_key``): a host with a third of all urls is not gathered. A node's decision sees at most
1/MIN_SHARE branches, already counted. Levels are written tables.

Defined cases: a null url or one without ``://`` has an empty host and path, and is judged like any other; a host
is everything up to ``/``, ``?``, ``#`` or the end, port and user included; repeated rows count each and are all
judged; equal counts go by code point; without labels nothing is rejected; an empty table gives no rows. Extra
columns of a clashing name are replaced by the operator's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtable.llm.rows import joined_by_key
from logtable.session import shared_dir

ALLOW, BLOCK = "allow", "block"
DEPTH = 8
MIN_URLS = 3
MIN_SHARE = 0.02
MERGE_DISTANCE = 0.2
PRIOR_URLS = 4
REJECT_FROM = 0.8

_LABELS = ("blocked", "allowed", "unlabelled")
_NEXT = ("end", "typed", "word")
_PROFILE = [(label, then) for label in _LABELS for then in _NEXT]


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def with_parts(frame: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    text = F.col(url)
    start = F.instr(text, "://")
    rest = F.when(start > 0, F.substr(text, start + 3))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A[^?#]*", 0)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return frame.withColumns({"host": F.coalesce(lowered, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def rule_columns(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits ``host`` and ``path``; null without one."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):  # the last one put on top wins
        own = F.col("host") == rule.host
        fits = (own | F.endswith("host", F.lit("." + rule.host))) & F.startswith("path", F.lit(rule.path))
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def typed_segments(path: Column) -> Column:
    """Segments of a path with typed places; braces of the path itself are doubled. What lies beyond the
    depth is the last segment."""
    plain = F.replace(path, F.lit("{"), F.lit("{{"))
    ids = F.regexp_replace(plain, r"(?<=/)(?:[0-9a-fA-F]{16,}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})(?=/|\z)", "{h}")
    typed = F.regexp_replace(ids, "[0-9]+", "{n}")
    # the empty piece before the first slash is no segment
    return F.slice(F.split(typed, "/", DEPTH + 1), 2, DEPTH)


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def _follows(level: int) -> Column:
    """What comes behind the segment of this level."""
    after = F.get("segments", level + 1)
    return F.when(after.isNull(), "end").when(after.contains("{n}") | after.contains("{h}"), "typed").otherwise("word")


def _distance(a: Sequence[int], b: Sequence[int]) -> float:
    """Total variation between two profiles of counts."""
    return sum(abs(x / sum(a) - y / sum(b)) for x, y in zip(a, b)) / 2


def branches(children: Sequence[tuple[str, int, Sequence[int]]], urls: int, profile: Sequence[int]) -> tuple[dict, tuple]:
    """Merged branches of a node: segment -> (name, urls), and the branch of all other segments.

    ``children`` are the segments that stand for themselves, with counts; ``urls`` and ``profile`` are the
    whole node's.
    """
    other = [n - sum(c[2][i] for c in children) for i, n in enumerate(profile)]
    items = [(n, segment, list(p)) for segment, n, p in children]
    items.sort(key=lambda item: (-item[0], item[1]))
    rest = urls - sum(n for n, _, _ in items)
    if rest:
        items.append((rest, None, other))
    merged: list[tuple[list, list[int]]] = []
    for n, segment, own in items:
        near = next((m for m in merged if _distance(m[1], own) <= MERGE_DISTANCE), None)
        if near is None:
            merged.append(([segment], own))
        else:
            near[0].append(segment)
            near[1][:] = [a + b for a, b in zip(near[1], own)]
    named, others = {}, ("{*}", rest)
    for segments, counts in merged:
        words = sorted(s for s in segments if s is not None)
        name = "{*}" if None in segments else words[0] if len(words) == 1 else "{" + "|".join(words) + "}"
        branch = (name, sum(counts))
        named.update(dict.fromkeys(words, branch))
        others = branch if None in segments else others
    return named, others


def _decided(nodes: DataFrame) -> DataFrame:
    """``node, paths`` and the branches of each node as parallel arrays."""
    shape = "node string, paths bigint, segments array<string>, names array<string>, urls array<bigint>, other string, other_urls bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                children = [(c["segment"], c["urls"], [c[f"c{i}"] for i in range(len(_PROFILE))]) for c in row["children"]]
                named, other = branches(children, row["urls"], [row[f"c{i}"] for i in range(len(_PROFILE))])
                out.append((row["node"], row["paths"], list(named), [b[0] for b in named.values()], [b[1] for b in named.values()], *other))
            columns = list(zip(*out)) or [()] * 7
            types = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.string(), pa.int64()]
            names = ["node", "paths", "segments", "names", "urls", "other", "other_urls"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return nodes.mapInArrow(run, shape)


def _written(frame: DataFrame, label: str) -> DataFrame:
    path = shared_dir(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def _grown(paths: DataFrame, level: int, whole: int) -> DataFrame:
    """The rows of ``paths`` one level further down their trees."""
    ended = paths.filter(F.size("segments") <= level)
    live = paths.filter(F.size("segments") > level)
    counts = {"blocked": F.col("blocked"), "allowed": F.col("allowed"), "unlabelled": F.col("n") - F.col("blocked") - F.col("allowed")}
    sums = [
        F.sum(F.when(F.col("follows") == then, counts[label]).otherwise(0)).alias(f"c{i}")
        for i, (label, then) in enumerate(_PROFILE)
    ]
    children = (
        live.withColumns({"segment": F.get("segments", level), "follows": _follows(level)})
        .groupBy("node", "segment")
        .agg(F.max("node_urls").alias("node_urls"), F.count("*").alias("paths"), F.sum("n").alias("urls"), *sums)
    )
    stands = (F.col("urls") >= MIN_URLS) & (F.col("urls") >= F.col("node_urls") * MIN_SHARE)
    profile = [f"c{i}" for i in range(len(_PROFILE))]
    nodes = children.groupBy("node").agg(
        F.sum("paths").alias("paths"),
        F.sum("urls").alias("urls"),
        *(F.sum(c).alias(c) for c in profile),
        F.collect_list(F.when(stands, F.struct("segment", "urls", *profile))).alias("children"),
    )
    decided = _written(_decided(nodes), "url-nodes").withColumnsRenamed({"segments": "known", "names": "branch_names", "urls": "branch_urls"})
    met = joined_by_key(live, decided, ["node"], "paths", whole)
    place = F.array_position("known", F.get("segments", level)).cast("int")
    chosen = F.when(place > 0, F.get("branch_names", place - 1)).otherwise(F.col("other"))
    urls = F.when(place > 0, F.get("branch_urls", place - 1)).otherwise(F.col("other_urls"))
    onward = met.select(
        "path_id", "host", "segments", "n", "blocked", "allowed",
        F.concat("template", F.lit("/"), chosen).alias("template"), urls.alias("node_urls"),
    )
    onward = onward.withColumn("node", _digest(F.col("host"), F.col("template")))
    return _written(ended.unionByName(onward), "url-paths")


def templates(urls: DataFrame) -> DataFrame:
    """``host, path, label`` (1 blocked, 0 allowed, null unlabelled) -> a row per distinct typed path:
    ``path_id, n, template, urls, blocked, labelled, purity, rejected``."""
    paths = with_path_id(urls).groupBy("path_id").agg(
        F.first("host").alias("host"),
        F.first(typed_segments(F.col("path"))).alias("segments"),
        F.count("*").alias("n"),
        F.count_if(F.col("label") == 1).alias("blocked"),
        F.count_if(F.col("label") == 0).alias("allowed"),
    )
    paths = paths.withColumns({"template": F.lit(""), "node": _digest(F.col("host"), F.lit(""))})
    paths = _written(paths, "url-paths")
    totals = paths.agg(
        F.count("*").alias("paths"), F.max(F.size("segments")).alias("levels"), F.sum("blocked").alias("blocked"),
        F.sum(F.col("blocked") + F.col("allowed")).alias("labelled"),
    ).first()
    whole, base = totals["paths"], totals["blocked"] / totals["labelled"] if totals["labelled"] else 0.0
    hosts = _written(paths.groupBy("node").agg(F.count("*").alias("paths"), F.sum("n").alias("node_urls")), "url-hosts")
    paths = joined_by_key(paths, hosts, ["node"], "paths", whole)
    for level in range(totals["levels"] or 0):
        paths = _grown(paths, level, whole)
    labelled = F.sum(F.col("blocked") + F.col("allowed"))
    purity = (F.sum("blocked") + PRIOR_URLS * F.lit(base)) / (labelled + PRIOR_URLS)
    leaves = paths.groupBy("node").agg(
        F.count("*").alias("paths"), F.sum("n").alias("urls"), F.sum("blocked").alias("template_blocked"),
        labelled.alias("labelled"), purity.alias("purity"),
    )
    rejected = (F.col("labelled") > 0) & (F.col("purity") >= REJECT_FROM)
    leaves = _written(leaves.withColumn("rejected", rejected), "url-templates")
    found = joined_by_key(paths, leaves, ["node"], "paths", whole)
    return found.select(
        "path_id", "n", "template", "urls", F.col("template_blocked").alias("blocked"), "labelled", "purity", "rejected"
    )


def with_path_id(urls: DataFrame) -> DataFrame:
    """Adds ``path_id``, the key of a host and typed path."""
    return urls.withColumn("path_id", _digest(F.col("host"), F.array_join(F.transform(typed_segments(F.col("path")), lambda s: F.concat(F.lit("/"), s)), "")))


def judged(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """Adds ``host, path, rule, template, purity, verdict`` to every row. Urls that a rule decides are the labelled ones."""
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "template", "purity", "verdict", "path_id", "by_rule")]
    parts = with_parts(pages.select(*(F.col(f"`{c}`") for c in kept)), url)
    name, verdict = rule_columns(rules)
    rows = with_path_id(parts.withColumns({"rule": name, "by_rule": verdict}))
    label = F.when(F.col("by_rule") == BLOCK, 1).when(F.col("by_rule") == ALLOW, 0)
    tree = _written(templates(rows.select("host", "path", label.alias("label"))), "url-verdicts")
    facts = tree.select("path_id", "n", "template", "purity", "rejected")
    whole = tree.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = joined_by_key(rows, facts, ["path_id"], "n", whole)
    learned = F.when(F.col("rejected"), BLOCK).otherwise(ALLOW)
    out = found.withColumn("verdict", F.coalesce("by_rule", learned))
    return out.select(*(F.col(f"`{c}`") for c in kept), "host", "path", "rule", "template", "purity", "verdict")
