"""Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups' roots, and a proof for each row.

Leaves are range-sorted by group and key once, as an RDD whose shuffle all passes share. A first pass counts the groups of
each partition; only a partition's first and last group can go on in another one, so the driver learns two counts for each
partition, and from these every leaf's place in its group. A second pass builds all complete aligned subtrees that lie in
one partition; nodes whose parent spans partitions are ragged, some dozens for each partition. These meet by coordinate
(group, parent), at most one run at a time, level by level, up to each group's root. The roots of the groups are leaves of
the same procedure. Paths then go down the runs to the ragged nodes, are dealt to the partitions that own them, and a third
pass gives every leaf its path.

H is sha256 in hexadecimal over concatenated inputs, digests being hexadecimal text too. A run of nodes, also of one, becomes
their H as long as a level holds more than one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby
from typing import Any

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.prefix import parts_for, range_sorted
from palimpsest.llm.storage import materialize
from palimpsest.session import ship

FANOUT = 16
_PATH = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def field_text(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field_text, values)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]), 256))


def run_digest(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def level_sizes(total: int, fanout: int) -> list[int]:
    sizes = [total]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // fanout))
    return sizes


def grow(digests: list[str], offset: int, total: int, fanout: int) -> tuple[list[tuple[int, list[str]]], list[tuple[int, int, bool]]]:
    """The levels (first index, nodes) of the complete subtrees over the leaves [offset, offset + len) of a group, and the
    coordinates (level, index, whether it is the group's root) of nodes whose parent isn't among them."""
    sizes = level_sizes(total, fanout)
    levels, ragged = [(offset, digests)], []
    for level, size in enumerate(sizes[:-1]):
        lo, nodes = levels[-1]
        hi = lo + len(nodes)
        first = -(-lo // fanout)
        last = -(-hi // fanout) if hi == size else hi // fanout
        if last <= first:
            return levels, ragged + [(level, j, False) for j in range(lo, hi)]
        ragged += [(level, j, False) for j in (*range(lo, first * fanout), *range(last * fanout, hi))]
        levels.append((first, [run_digest(nodes[j * fanout - lo : (j + 1) * fanout - lo]) for j in range(first, last)]))
    return levels, [*ragged, (len(sizes) - 1, 0, True)]


@dataclass(frozen=True)
class Span:
    """How the groups of a partition lie in the whole: of its first and last group the leaves there are in all, and where
    its first one starts."""

    groups: int
    offset: int
    first_total: int
    last_total: int


def _summary(part: int, rows: Iterator) -> Iterator[tuple]:
    counts: list[list] = []
    groups = 0
    for group, members in groupby(rows, key=lambda r: r[0]):
        name = hashlib.sha256(f"{group is None}:{group}".encode("utf-8", "surrogatepass")).digest()[:16]
        n = sum(1 for _ in members)
        counts = [*counts[:1], [name, n]]
        groups += 1
    if counts:
        yield part, groups, counts


def spans(summaries: list[tuple]) -> tuple[dict[int, Span], int]:
    """A span for each partition that has rows, and the size of the largest group that lies in several."""
    ends = [(part, k, name, n) for part, _, counts in sorted(summaries) for k, (name, n) in enumerate(counts)]
    placed, most = {}, 0
    for _, run in groupby(ends, key=lambda e: e[2]):
        run = list(run)
        total, at = sum(e[3] for e in run), 0
        most = max(most, total if len(run) > 1 else 0)
        for part, k, _, n in run:
            placed[part, k] = (at, total)
            at += n
    return {part: Span(groups, *placed[part, 0], placed[part, len(counts) - 1][1]) for part, groups, counts in summaries}, most


def _segments(rows: Iterator, span: Span | None) -> Iterator[tuple[Any, list, int, int]]:
    """(group, its rows here, place of the first one, leaves in all)."""
    for k, (group, members) in enumerate(groupby(rows, key=lambda r: r[0])):
        members = list(members)
        total = span.first_total if k == 0 else span.last_total if k == span.groups - 1 else len(members)
        yield group, members, span.offset if k == 0 else 0, total


@dataclass
class Forest:
    """Sorted leaves, where partitions begin, the runs above ragged nodes by level, and the groups' roots."""

    leaves: RDD
    spans: Any
    fanout: int
    runs: list[DataFrame] = field(default_factory=list)
    roots: DataFrame | None = None


def _same_group(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def build(rows: DataFrame, fanout: int, label: str) -> Forest:
    """The forest over ``rows`` (group, key, leaf, carried): leaves ascend by key, those of one key by digest; a null group
    and a null key come first."""
    spark = rows.sparkSession
    ship(spark)
    placed = materialize(rows, f"{label}-leaves")
    order = [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf").asc()]
    leaves = range_sorted(placed, parts_for(placed, placed.count()), *order).rdd.map(tuple)
    found, most = spans(leaves.mapPartitionsWithIndex(_summary).collect())
    known = spark.sparkContext.broadcast(found)  # four numbers for each partition

    def nodes_of(part: int, members: Iterator) -> Iterator[tuple]:
        for group, own, offset, total in _segments(members, known.value.get(part)):
            levels, ragged = grow([bytes(r[2]).hex() for r in own], offset, total, fanout)
            for level, j, top in ragged:
                lo, nodes = levels[level]
                yield group, level, j, total, nodes[j - lo], part, top

    kind = placed.schema["group"].dataType.simpleString()
    schema = f"group {kind}, level int, j long, total long, digest string, part int, top boolean"
    nodes = materialize(spark.createDataFrame(leaves.mapPartitionsWithIndex(nodes_of), schema, verifySchema=False), f"{label}-nodes")
    forest = Forest(leaves, known, fanout)
    roots = nodes.filter("top")
    made = nodes.limit(0)
    for level in range(len(level_sizes(most, fanout)) - 1):
        here = nodes.filter((F.col("level") == level) & ~F.col("top")).unionByName(made.filter("not top"))
        members = F.sort_array(F.collect_list(F.struct("j", "digest", "part"))).alias("members")
        runs = here.groupBy("group", "total", F.expr(f"j div {fanout}").alias("parent")).agg(members)
        forest.runs.append(materialize(runs, f"{label}-runs"))
        digest = F.sha2(F.array_join(F.transform("members", lambda m: m["digest"]), ""), 256)
        top = F.expr(f"(total - 1) div {fanout ** (level + 1)} = 0")
        made = forest.runs[-1].select(
            "group", F.lit(level + 1).alias("level"), F.col("parent").alias("j"), "total", digest.alias("digest"), F.lit(None).cast("int").alias("part"), top.alias("top")
        )
        roots = roots.unionByName(made.filter("top"))
    forest.roots = materialize(roots, f"{label}-roots")
    return forest


def _down(forest: Forest, roots: DataFrame, label: str) -> DataFrame:
    """(part, group, level, j, root, path) for each ragged node, from the paths of the groups' ``roots``."""
    names = ["part", "group", "level", "j", "root", "path"]
    done = [roots.filter("part is not null").select(names)]
    above = roots.limit(0)
    for level in reversed(range(len(forest.runs))):
        parents = roots.filter((F.col("level") == level + 1) & F.col("part").isNull()).select(names).unionByName(above.select(names))
        parents = parents.select(F.col("group").alias("g"), F.col("j").alias("p"), "root", F.col("path").alias("up"))
        runs = forest.runs[level]
        each = runs.join(parents, _same_group(F.col("group"), F.col("g")) & (F.col("parent") == F.col("p")))
        each = each.select("group", "root", "up", "members", F.posexplode("members").alias("at", "m"))

        def side(start: Column, length: Column) -> Column:
            return F.array_join(F.transform(F.slice("members", start, length), lambda m: m["digest"]), "")

        step = F.struct(side(F.lit(1), F.col("at")).alias("left"), side(F.col("at") + 2, F.lit(forest.fanout)).alias("right"))
        found = each.select(F.col("m.part").alias("part"), "group", F.lit(level).alias("level"), F.col("m.j").alias("j"), "root", F.concat(F.array(step), "up").alias("path"))
        found = materialize(found, f"{label}-paths")
        done.append(found.filter("part is not null"))
        above = found.filter("part is null")
    return reduce(DataFrame.unionByName, done)


def _prove(forest: Forest, roots: DataFrame, label: str) -> RDD:
    """(group, key, leaf, carried, root, path) for each leaf. A partition meets its paths by zipping: both are one list
    there, the leaves of one range part and some dozens of paths."""
    fanout, known, leaves = forest.fanout, forest.spans, forest.leaves
    context = leaves.context
    parts = leaves.getNumPartitions()
    paths = _down(forest, roots, label).rdd.map(lambda r: (r["part"], (r["group"], r["level"], r["j"], r["root"], [tuple(s) for s in r["path"]])))
    paths = paths.partitionBy(parts, int)
    more = paths.getNumPartitions() - parts  # a session may deal to more partitions than asked
    if more > 0:
        leaves = context.union([leaves, context.parallelize([], more)])

    def prove(part: int, pairs: Iterator) -> Iterator[tuple]:
        for rows, dealt in pairs:
            above = {p[:3]: p[3:] for _, p in dealt}
            for group, own, offset, total in _segments(rows, known.value.get(part)):
                levels, _ = grow([bytes(r[2]).hex() for r in own], offset, total, fanout)
                up: list[tuple[str, list]] = []
                for level in reversed(range(len(levels))):
                    lo, nodes = levels[level]
                    begin, parents = (levels[level + 1][0], up) if level + 1 < len(levels) else (0, [])

                    def place(k: int, level=level, lo=lo, nodes=nodes, begin=begin, parents=parents, group=group) -> tuple[str, list]:
                        at = lo + k
                        run = at // fanout
                        if not begin <= run < begin + len(parents):
                            return above[group, level, at]
                        start = run * fanout - lo
                        root, rest = parents[run - begin]
                        return root, [("".join(nodes[start:k]), "".join(nodes[k + 1 : start + fanout])), *rest]

                    if level:
                        up = [place(k) for k in range(len(nodes))]
                    else:
                        for k, row in enumerate(own):
                            yield (*row, *place(k))

    return leaves.glom().zip(paths.glom()).mapPartitionsWithIndex(prove)


def proofs(docs: DataFrame, group: Column, key: Column, leaf: Column, carry: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """(group, key, leaf, subroot, root, path, carried): one row per row of ``docs``.

    ``leaf`` is a row's digest; leaves of a group ascend by ``key``, those of one key by digest, nulls first. subroot is the
    group's root, root that of all groups' roots in the order of their names (null first, bytewise). path lists, from the
    leaf up, the digests that stand before and after a node in its run, each as one text: ``fold(leaf, path)`` is the
    root. ``carried`` is a struct of the columns of ``carry``, moved with the leaf; other columns are ignored, so their names
    can't clash.

    Null groups are one group; repeated rows are leaves of their own, equal ones in any order. Texts count only by their
    digest, which whole texts make, however long. An empty table gives no rows. A group may hold most rows: it is spread over
    partitions like any other. Names of groups are sorted as strings."""
    held = F.struct(*[c.alias(n) for n, c in (carry or {"nothing": F.lit(0)}).items()]).alias("carried")
    rows = docs.select(group.cast("string").alias("group"), key.alias("key"), F.unhex(leaf).alias("leaf"), held)
    forest = build(rows, fanout, "merkle")
    spark = docs.sparkSession
    names = F.struct(F.col("level"), F.col("part")).alias("carried")
    upper = build(forest.roots.select(F.lit("").alias("group"), F.col("group").alias("key"), F.unhex("digest").alias("leaf"), names), fanout, "merkle-top")
    top = upper.roots.withColumn("root", F.col("digest")).withColumn("path", F.array().cast(_PATH))
    proved = _prove(upper, top, "merkle-top").map(lambda r: (r[1], r[3][0], 0, r[3][1], bytes(r[2]).hex(), r[4], r[5]))
    columns = "group string, level int, j long, part int, subroot string, root string, path array<struct<left:string,right:string>>"
    roots = materialize(spark.createDataFrame(proved, columns, verifySchema=False), "merkle-roots")
    last = roots.select("root").first()
    out = T.StructType(
        [rows.schema["group"], rows.schema["key"], T.StructField("leaf", T.StringType()), rows.schema["carried"], T.StructField("subroot", T.StringType()), T.StructField("path", _PATH)]
    )
    each = _prove(forest, roots.withColumn("root", F.col("subroot")), "merkle").map(lambda r: (r[0], r[1], bytes(r[2]).hex(), *r[3:]))
    found = spark.createDataFrame(each, out, verifySchema=False)
    return found.select("group", "key", "leaf", "subroot", F.lit(last[0] if last else None).cast("string").alias("root"), "path", "carried")
