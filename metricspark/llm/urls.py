"""URL filters: rules first, then trust and distrust that flow along links between hosts.

A rule has a host and a path. It fits its host and all subdomains where the URL's path starts with the
rule's; of several the longest wins. Rules are joined to the different hosts by host suffix, so neither
the rules nor the pages are compared all with all.

Hosts that no rule settles are judged by their links. Host edges are the links of all pages, counted per
pair of hosts. Trust is a personalised PageRank that starts from hosts in proportion to their allowed
pages and follows links; distrust starts from hosts in proportion to their blocked pages and runs along
the links backwards, so it reaches hosts that link to blocked ones. A host is blocked if distrust makes up
more than `threshold` of its trust, distrust and undecided pages together; without evidence it is allowed.

Ranks are tables of (host, rank); a step is a join with the edges and a sum per host, written to the
shared folder, until the ranks move by less than `tolerance` of their sum. What a step moves is a row per
edge between hosts, however many pages and links stand behind it.

Defined results: a null URL, or one without `://`, has an empty host and path, fits no rule and is allowed;
null html has no links; links that name no host stay on their own host and are not edges; of rules with
the same host, path the first counts; repeated rows are judged one by one. Other columns pass through unless
they are named like the added ones, which replace them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricspark.llm import frames

DAMPING = 0.85
TOLERANCE = 1e-4
STEPS = 60
# A host whose own pages are blocked in this share, or that links to little but blocked hosts, is blocked.
THRESHOLD = 0.45

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Where an anchor's attributes begin, and one attribute: its name, and its value in quotes of either kind or without.
# All repetitions are possessive, so each character of a page is looked at a few times at most.
_ANCHOR = re.compile(r"<a(?=[\s/])", re.IGNORECASE)
_ATTRIBUTE = re.compile(
    r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)|(?=>)))?+"""
)
_HOST_END = re.compile(r"[/?#]")
_LOWERED = str.maketrans(UPPER, LOWER)


def _rest(url: Column) -> Column:
    """What follows the first ://, empty without one."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rules(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, fitting): for each host that rules fit, these rules with the longest first."""
    first: dict[tuple[str, str], str] = {}
    for host, path, verdict in rules:
        first.setdefault((host.lower(), path), verdict)
    rows = [(h, p, h + p, v) for (h, p), v in first.items()]
    table = pages.sparkSession.createDataFrame(rows, "suffix string, path string, rule string, verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = pages.select("host").distinct().where("host <> ''")
    fits = hosts.withColumn("suffix", F.explode(suffixes)).join(table, "suffix")
    rule = F.struct(F.length("rule").alias("n"), "rule", "path", "verdict")
    return fits.groupBy("host").agg(F.sort_array(F.collect_list(rule), asc=False).alias("fitting"))


def links(html: str) -> Iterator[str]:
    """The href of every anchor of a page, however long its attributes are and whatever they hold in quotes.

    An anchor is looked for where the attributes of the one before end, so a page is read through once.
    """
    at = 0
    while (anchor := _ANCHOR.search(html, at)) is not None:
        at, found = anchor.end(), None
        while (attribute := _ATTRIBUTE.match(html, at)) is not None:
            at = attribute.end()
            if found is None and attribute[1].lower() == "href":
                # the first of a name counts
                found = (attribute[2] or attribute[3] or attribute[4] or "").strip()
        if found is not None:
            yield found


def linked_host(link: str) -> str:
    """The host that a link names, by the rule of `host_of`; empty if it stays on its own."""
    at = link.find("://")
    rest = link[2:] if link.startswith("//") else link[at + 3 :] if at >= 0 else ""
    return _HOST_END.split(rest, maxsplit=1)[0].translate(_LOWERED)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host pairs of the links of pages, counted per slice."""
    for batch in frames.slices(batches, 1):
        counts: Counter[tuple[str, str]] = Counter()
        for src, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for link in links(html or ""):
                dst = linked_host(link)
                if dst and dst != src:
                    counts[src, dst] += 1
        columns = [[s for s, _ in counts], [d for _, d in counts], list(counts.values())]
        kinds = (pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["src", "dst", "n"])


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): how many links lead from one host to another."""
    found = pages.where("host <> ''").select("host", "html").mapInArrow(_edges, "src string, dst string, n bigint")
    return found.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def personalised_rank(
    edges: DataFrame,
    seeds: DataFrame,
    damping: float = DAMPING,
    tolerance: float = TOLERANCE,
    steps: int = STEPS,
) -> DataFrame:
    """(host, rank) for walks that start at `seeds` (host, weight), follow an edge (src, dst, n) in proportion
    to n with probability `damping`, and end otherwise or where no edge leads on: a host's rank is
    (1 - `damping`) times the walks that come to it, at least that much of its own weight."""
    total = seeds.agg(F.sum("weight")).first()[0] or 0.0
    if total <= 0:
        return seeds.select("host", F.lit(0.0).alias("rank"))
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    flow = frames.stage(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("p")), "flow")
    start = frames.stage(seeds.select("host", ((1 - damping) * F.col("weight")).alias("start")), "ranks")
    ranks, zero = start.withColumnRenamed("start", "rank"), F.lit(0.0)
    for _ in range(steps):
        moved = (
            ranks.join(flow, ranks["host"] == flow["src"])
            .groupBy(F.col("dst").alias("host"))
            .agg((damping * F.sum(F.col("rank") * F.col("p"))).alias("moved"))
        )
        after = start.join(moved, "host", "full").select(
            "host", (F.coalesce("start", zero) + F.coalesce("moved", zero)).alias("rank")
        )
        after = frames.stage(after, "ranks")
        old = ranks.select("host", F.col("rank").alias("old"))
        change = after.join(old, "host", "full").agg(F.sum(F.abs(F.coalesce("rank", zero) - F.coalesce("old", zero))))
        ranks, moved_by = after, change.first()[0] or 0.0
        if moved_by <= tolerance * total:
            break
    return ranks


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    url_col: str = "url",
    html_col: str = "html",
    threshold: float = THRESHOLD,
    damping: float = DAMPING,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """`pages` with host, path, rule (the longest that fits, or null), verdict (allow or block) and the host's
    trust and distrust. `rules` are (host, path, verdict)."""
    added = ("host", "path", "rule", "verdict", "trust", "distrust")
    url = F.col(url_col)
    slim = pages.select(host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_col).cast("string").alias("html"))
    fitting = frames.stage(_rules(slim, rules), "rules")
    best = lambda path: F.get(F.filter("__fitting", lambda r: F.startswith(path, r["path"])), F.lit(0))
    counted = slim.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    ruled = counted.join(fitting.withColumnRenamed("fitting", "__fitting"), "host", "left")
    verdict = best(F.col("path"))["verdict"]
    share = lambda v: (F.sum(F.when(v, F.col("n")).otherwise(0)) / F.sum("n"))
    hosts = frames.stage(
        ruled.where("host <> ''")
        .groupBy("host")
        .agg(
            share(verdict == "allow").alias("allowed"),
            share(verdict == "block").alias("blocked"),
            share(verdict.isNull()).alias("open"),
        ),
        "hosts",
    )
    edges = frames.stage(host_edges(slim), "host_edges")
    trust = personalised_rank(edges, hosts.where("allowed > 0").select("host", F.col("allowed").alias("weight")), damping, tolerance)
    backwards = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = personalised_rank(
        backwards, hosts.where("blocked > 0").select("host", F.col("blocked").alias("weight")), damping, tolerance
    )
    zero = F.lit(0.0)
    scores = (
        hosts.select("host", "open")
        .join(trust.withColumnRenamed("rank", "trust"), "host", "left")
        .join(distrust.withColumnRenamed("rank", "distrust"), "host", "left")
        .join(fitting, "host", "left")
        .select(
            F.col("host").alias("__host"), "open", F.col("fitting").alias("__fitting"),
            F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"),
        )
    )
    # undecided pages weigh as much as a seed of their share
    evidence = F.col("trust") + F.col("distrust") + (1 - damping) * F.col("open")
    scores = frames.stage(scores.withColumn("__blocked", F.col("distrust") > threshold * evidence), "host_scores")
    given = pages.drop(*added).withColumn("host", host_of(url)).withColumn("path", path_of(url))
    joined = given.join(scores, F.col("host") == F.col("__host"), "left")
    rule = best(F.col("path"))
    by_links = F.when(F.col("__blocked"), "block").otherwise("allow")
    return (
        joined.withColumn("rule", rule["rule"])
        .withColumn("verdict", F.coalesce(rule["verdict"], by_links))
        .withColumn("trust", F.coalesce("trust", zero))
        .withColumn("distrust", F.coalesce("distrust", zero))
        .drop("__host", "__fitting", "__blocked", "open")
    )
