"""URL filter: host and path rules, and a tree of path templates for the rest.

Per host, paths are split into segments. A node holds paths with the same way down to it. While all of its
paths go on with the same segment, the node goes on with them (so long chains are one node). Else its children, by
next segment, become one wildcard (for each file suffix) if they vary: at least VARIED values, and more
than half as many values as rows. Sibling branches with the same kinds of segments below are
merged if their labels speak for one share rather than two: ordered by share, a branch joins the one
before it while the Bayes factor of "one share" against "two" (beta-binomial, uniform priors) is at least
SIMILAR. Branches without labels are not merged. A node ends where its paths end, and so does the way of a path that is
the only one left. Labels are the verdicts of the rules. A template's purity is its share of blocked labels, smoothed by PRIOR labels of its
parent's purity; at the root of a host the parent is the same template over all hosts, and above that the share over all
labels. Templates of purity over REJECT are rejected.

Nodes of more than LOCAL paths are grown a level at a time by grouped counts, so a hot host is pre-aggregated, and
branches to merge are first grouped by their counts, so what a task holds is a node's different pairs of
counts. What is below a smaller node is grown in one task by the same rules, many nodes a task; so the rounds are
those of large nodes only, however deep the paths are. A node's number is a 64-bit hash of the names on its way, the same on every host.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from math import lgamma, log
from re import search

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tasks_for, tidy, written

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
VARIED, SIMILAR, PRIOR, REJECT = 8, 1.0, 4.0, 0.5
LOCAL, HOT = 20_000, 1_000  # paths below a node that one task may grow; a node with a HOT-th of all rows is joined by a broadcast
STATE = "host string, segs array<string>, rows long, bad long, known long, node long, nodes array<long>, names array<string>, at int"


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_urls(pages: DataFrame, *keep: str) -> DataFrame:
    """page_id, host, path, and the columns ``keep``; host and path are empty without "://"."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    p = pages.select("page_id", rest.alias("rest"), *keep)
    host = F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1)
    return p.select("page_id", _ascii_lower(host).alias("host"), path.alias("path"), *keep)


def apply_rules(urls: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """``urls`` (host, path) with rule (host and path text of the longest fitting rule, else null) and label (its verdict)."""
    rule = label = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, label = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(label)
    return urls.withColumn("rule", rule).withColumn("label", label)


def segments(path: str) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _suffix(c: Column) -> Column:
    return F.regexp_extract(c, r"(\.[A-Za-z0-9]{1,8})$", 1)


def one_share(a: int, n: int, b: int, m: int) -> float:
    """Log of the Bayes factor of one share behind a of n and b of m against two."""
    def beta(x: int, y: int) -> float:
        return lgamma(x + 1) + lgamma(y + 1) - lgamma(x + y + 2)

    return beta(a + b, n - a + m - b) - beta(a, n - a) - beta(b, m - b)


def merged(counts: list[tuple[int, int, int, str]]) -> list[str]:
    """The name of the branch that each of (bad, known, number of branches with these counts, least name) goes to."""
    order = sorted(range(len(counts)), key=lambda i: ((counts[i][0] + 1) / (counts[i][1] + 2), counts[i][1], counts[i][0]))
    out, own, a, k = [""] * len(counts), [], 0, 0
    for i in order:
        bad, known, n, _ = counts[i]
        if not own or one_share(a, k, bad, known) < log(SIMILAR):
            own.append([])
            a = k = 0
        own[-1].append(i)
        a, k = a + bad * n, k + known * n
    for group in own:
        least = min(counts[i][3] for i in group)
        for i in group:
            out[i] = least
    return out


def _alike(pdf: pd.DataFrame) -> pd.DataFrame:
    to = merged(list(zip(pdf.bad.tolist(), pdf.known.tolist(), pdf.n.tolist(), pdf.one.tolist(), strict=True)))
    return pdf.assign(to=to)[["host", "node", "shape", "bad", "known", "to"]]


def _named(kids: DataFrame) -> DataFrame:
    """host, node, seg and to: the branch of each child."""
    up = kids.groupBy("host", "node").agg(F.sum("rows").alias("all_rows"), F.count("*").alias("values"))
    wild = (F.col("values") >= VARIED) & (F.col("values") * 2 > F.col("all_rows"))
    name = F.when(wild, F.concat(F.lit("*"), _suffix(F.col("seg")))).otherwise(F.col("seg"))
    named = written(kids.join(up, ["host", "node"]).withColumn("name", name), "named")
    sums = [F.sum("bad").alias("bad"), F.sum("known").alias("known"), F.bit_or("shape").alias("shape")]
    sib = named.groupBy("host", "node", "name").agg(*sums).where("known > 0")
    pairs = sib.groupBy("host", "node", "shape", "bad", "known").agg(F.count("*").alias("n"), F.min("name").alias("one"))
    kind = "host string, node long, shape long, bad long, known long, to string"
    alike = pairs.groupBy("host", "node", "shape").applyInPandas(_alike, kind)
    to = written(sib.join(alike, ["host", "node", "shape", "bad", "known"]).where("name <> to").select("host", "node", "name", "to"), "merged")
    out = written(named.join(to, ["host", "node", "name"], "left").select("host", "node", "seg", F.coalesce("to", "name").alias("to")), "branches")
    tidy(named, to)
    return out


def _grown(level: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A level of large nodes (STATE) one level further: rows that go on, and rows that ended."""
    rest = F.slice("segs", F.col("at") + 1, F.size("segs"))
    ends = level.groupBy("host", "node").agg(F.min(rest).alias("lo"), F.max(rest).alias("hi"))  # what these two share, all share
    same = F.transform(F.arrays_zip("lo", "hi"), lambda x: x["lo"].eqNullSafe(x["hi"]))
    n = F.array_position(same, F.lit(False))
    chain = F.slice("lo", F.lit(1), F.when(n > 0, n - 1).otherwise(F.size("lo")).cast("int"))
    down = level.join(ends.select("host", "node", chain.alias("chain")), ["host", "node"])
    node = F.aggregate("chain", F.col("node"), lambda i, s: F.xxhash64(i, s))
    nodes = F.when(F.size("chain") == 0, F.col("nodes")).otherwise(F.concat(F.when(F.size("nodes") == 1, F.col("nodes")).otherwise(F.slice("nodes", F.lit(1), F.size("nodes") - 1)), F.array(node)))
    kept = ["host", "segs", "rows", "bad", "known"]
    down = down.select(*kept, node.alias("node"), nodes.alias("nodes"), F.concat("names", "chain").alias("names"), (F.col("at") + F.size("chain")).alias("at"))
    down = written(down, "down")
    on = down.where("at < size(segs)").withColumn("seg", F.get("segs", F.col("at")))
    below = F.get("segs", F.col("at") + 1)
    kind = F.when(below.isNull(), "").otherwise(F.concat(F.when(below.rlike("^[0-9]"), "#").otherwise("a"), F.when(F.size("segs") == F.col("at") + 2, _suffix(below)).otherwise("")))
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(kind), 64) as int))")
    kids = on.withColumn("kind", kind).groupBy("host", "node", "seg").agg(F.sum("rows").alias("rows"), F.sum("bad").alias("bad"), F.sum("known").alias("known"), F.bit_or(bit).alias("shape"))
    branches = _named(written(kids, "children"))
    to = F.xxhash64("node", "to")
    on = on.join(branches, ["host", "node", "seg"]).select(*kept, to.alias("node"), F.concat("nodes", F.array(to)).alias("nodes"), F.concat("names", F.array("to")).alias("names"), (F.col("at") + 1).alias("at"))
    return on, down.where("at = size(segs)")


def _number(node: int, name: str) -> int:
    """The same 64-bit hash as in SQL."""
    h = xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), xxhash.xxh64_intdigest((node & (1 << 64) - 1).to_bytes(8, "little"), 42))
    return h - (1 << 64) if h >> 63 else h


def _end(seg: str) -> str:
    m = search(r"(\.[A-Za-z0-9]{1,8})\Z", seg)
    return m[1] if m else ""


def _kind(segs: list[str], at: int) -> int:
    """The bit of the kind of segment at a place."""
    if at >= len(segs):
        kind = ""
    else:
        kind = ("#" if segs[at][:1] in tuple("0123456789") else "a") + (_end(segs[at]) if len(segs) == at + 1 else "")
    return 1 << (xxhash.xxh64_intdigest(kind.encode(), 42) % 64)


def _subtree(segs: list[list[str]], rows: list[int], bad: list[int], known: list[int], node: int, at: int) -> Iterable[tuple[int, list[int], list[str]]]:
    """For each path its nodes from ``node`` on (in its place, if it goes on in a chain; but the root, 0, stays), and the names after ``at``."""
    todo = [(list(range(len(segs))), at, node, [node], [])]
    while todo:
        own, at, node, nodes, names = todo.pop()
        first = segs[own[0]]
        start = at
        while len(first) > at and all(len(segs[i]) > at and segs[i][at] == first[at] for i in own):
            at += 1
        if at > start:
            for name in first[start:at]:
                node = _number(node, name)
            names = names + first[start:at]
            nodes = (nodes[:-1] if nodes != [0] else nodes) + [node]
        kids: dict[str, list[int]] = defaultdict(list)
        for i in own:
            if len(segs[i]) == at:
                yield i, nodes, names
            else:
                kids[segs[i][at]].append(i)
        wild = len(kids) >= VARIED and 2 * len(kids) > sum(rows[i] for k in kids.values() for i in k)
        branch: dict[str, list[int]] = defaultdict(list)
        for seg, k in kids.items():
            branch[f"*{_end(seg)}" if wild else seg] += k
        shapes: dict[int, dict[tuple[int, int], list[str]]] = defaultdict(lambda: defaultdict(list))
        for name, k in branch.items():
            if m := sum(known[i] for i in k):
                shape = 0
                for i in k:
                    shape |= _kind(segs[i], at + 1)
                shapes[shape][sum(bad[i] for i in k), m].append(name)
        to = {name: name for name in branch}
        for alike in shapes.values():
            counts = [(b, m, len(of), min(of)) for (b, m), of in alike.items()]
            for (_, of), name in zip(alike.items(), merged(counts), strict=True):
                to |= dict.fromkeys(of, name)
        after: dict[str, list[int]] = defaultdict(list)
        for name, k in branch.items():
            after[to[name]] += k
        for name, k in after.items():
            n = _number(node, name)
            todo.append((k, at + 1, n, [*nodes, n], [*names, name]))


def _local(pdf: pd.DataFrame) -> pd.DataFrame:
    """Some small nodes with all of their paths, grown to the end."""
    out = []
    for (host, node), g in pdf.groupby(["host", "node"], sort=False):
        segs, had, named = [list(x) for x in g.segs], list(g.nodes), list(g.names)
        for i, nodes, names in _subtree(segs, g.rows.tolist(), g.bad.tolist(), g.known.tolist(), int(node), int(g["at"].iloc[0])):
            out.append((host, segs[i], [*had[i][:-1], *nodes], [*named[i], *names], int(g.bad.iloc[i]), int(g.known.iloc[i])))
    return pd.DataFrame(out, columns=["host", "segs", "nodes", "names", "bad", "known"])


def templates(urls: DataFrame) -> DataFrame:
    """host, segs, nodes, names, bad, known of each distinct path of ``urls`` (host, path, label): the nodes on its way down its host's tree, from 0, and the names on it."""
    paths = urls.groupBy("host", segments("path").alias("segs")).agg(
        F.count("*").alias("rows"), F.count(F.when(F.col("label") == "block", 1)).alias("bad"), F.count("label").alias("known"))
    root = F.lit(0).cast("long")
    level = paths.withColumns({"node": root, "nodes": F.array(root), "names": F.array().cast("array<string>"), "at": F.lit(0)})
    ended = small = None
    while True:
        level = written(level, "level")
        size = level.groupBy("host", "node").agg((F.count("*") > LOCAL).alias("large"))
        level = written(level.join(size, ["host", "node"]), "sized")
        part = level.where("not large").drop("large")
        small = part if small is None else small.unionByName(part)
        if level.where("large").isEmpty():
            break
        level, done = _grown(level.where("large").drop("large"))
        ended = done if ended is None else ended.unionByName(done)
    kept = ["host", "segs", "nodes", "names", "bad", "known"]
    n = max(tasks_for(small), small.count() // LOCAL + 1)
    bucket = F.pmod(F.xxhash64("host", "node"), F.lit(n))
    grown = small.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(_local, "host string, segs array<string>, nodes array<long>, names array<string>, bad long, known long")
    return written(grown if ended is None else grown.unionByName(ended.select(*kept)), "tree")


def _beside(flat: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """``flat`` with the sums of its keys; keys of many rows (HOT at most) are joined where the rows are."""
    n = max(flat.count() // HOT, HOT)
    sums = written(sums, "sums")
    hot, rest = F.broadcast(sums.where(F.col("n") > n).drop("n")), sums.where(F.col("n") <= n).drop("n")
    return flat.join(hot, keys).unionByName(flat.join(hot.select(*keys), keys, "left_anti").join(rest, keys))


def purity(tree: DataFrame) -> DataFrame:
    """host, node and purity of each template of ``templates``, ``node`` being its last one."""
    t = tree.groupBy("host", F.element_at("nodes", -1).alias("last")).agg(F.first("nodes").alias("nodes"), F.sum("bad").alias("bad"), F.sum("known").alias("known"))
    t = written(t, "templates")
    total = t.agg(F.sum("bad").alias("b"), F.sum("known").alias("k")).first()
    share = 0.5 if total["k"] is None else (total["b"] + PRIOR / 2) / (total["k"] + PRIOR)
    flat = written(t.select("host", "last", "bad", "known", F.posexplode("nodes").alias("level", "node")), "ways")

    def sums(*by: str) -> DataFrame:
        return flat.groupBy(*by).agg(F.struct(F.sum("bad").alias("b"), F.sum("known").alias("k")).alias("over" if len(by) == 1 else "within"), F.count("*").alias("n"))

    way = written(_beside(flat, sums("node"), ["node"]), "over")
    way = _beside(way, sums("host", "node"), ["host", "node"])
    way = way.groupBy("host", "last").agg(F.sort_array(F.collect_list(F.struct("level", "over", "within"))).alias("way"))
    steps = F.concat(F.transform("way", lambda x: x["over"]), F.transform("way", lambda x: x["within"]))
    p = F.aggregate(steps, F.lit(float(share)), lambda p, x: F.when(x["k"] > 0, (x["b"] + PRIOR * p) / (x["k"] + PRIOR)).otherwise(p))
    return way.select("host", F.col("last").alias("node"), p.alias("purity"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for each row of ``pages`` (page_id, url).

    A fitting rule decides; else the template's purity. A url that is null or has no
    "://" has an empty host and path and is judged like any other. Repeated rows are
    judged alike; other columns are ignored; an empty table gives no rows.
    """
    urls = apply_rules(split_urls(pages), rules)
    tree = templates(urls)
    name = F.when(F.size("names") > 0, F.concat(F.lit("/"), F.array_join("names", "/"))).otherwise(F.lit(""))
    found = written(tree.withColumn("node", F.element_at("nodes", -1)).join(purity(tree), ["host", "node"]).select("host", "segs", "purity", name.alias("template")), "purity")
    tidy(tree)
    out = urls.withColumn("segs", segments("path")).join(found, ["host", "segs"], "left")
    verdict = F.coalesce("label", F.when(F.col("purity") > REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
