"""Parent-child rows to full hierarchies: components, co-located depth-first traversal, loops.

Connected components are found on 64-bit hashes of the nodes: should two hashes be equal, two components merely share a
place, for all further work is on the nodes themselves. The rows of a component are brought together and traversed
by an iterative depth-first search with node colouring; one task streams through its components one at a time. Components
above ``local_bound`` rows, which no single task should hold, are solved by pointer doubling instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialize
from .components import connected_components

WHITE, GREY, BLACK = 0, 1, 2
ON_LOOP, BELOW_LOOP = -1, -2


def traverse(parent_of: dict[str, str]) -> Iterator[tuple[str, str, int, list[str]]]:
    """(node, root, depth, path) of every node of a forest that may have loops. No recursion.

    Walks upwards colour nodes grey until they meet a known (black) node, a root, or a grey node, which closes a loop:
    the link into that node is the back edge. From each root and loop a walk downwards then emits its nodes; only the
    open line is kept, however long the paths are.
    """
    colour: dict[str, int] = {}
    loops: list[list[str]] = []
    tops: list[str] = []
    below: dict[str, list[str]] = {}
    for child, parent in parent_of.items():
        below.setdefault(parent, []).append(child)
    for start in [*parent_of, *dict.fromkeys(parent_of.values())]:
        walk: list[str] = []
        node: str | None = start
        while node is not None and colour.get(node, WHITE) == WHITE:
            colour[node] = GREY
            walk.append(node)
            node = parent_of.get(node)
        if node is None:
            tops.append(walk[-1])
        elif colour[node] == GREY:  # back edge
            loop = walk[walk.index(node) :][::-1]  # from parent to child
            i = loop.index(min(loop))
            loops.append(loop[i:] + loop[:i])
        for x in walk:
            colour[x] = BLACK
    for top in tops:
        yield top, top, 0, [top]
        yield from _down(below, top, [top], top, 0, frozenset())
    for loop in loops:
        on = frozenset(loop)
        for x in loop:
            yield x, loop[0], ON_LOOP, loop
            yield from _down(below, x, loop, loop[0], ON_LOOP, on)


def _down(below: dict[str, list[str]], top: str, line: list[str], root: str, depth: int, but: frozenset[str]) -> Iterator[tuple[str, str, int, list[str]]]:
    """The nodes below ``top``, children in turn, with ``line`` as the path so far; nodes of the loop itself are left out."""
    line = list(line)
    todo = [iter(below.get(top, ()))]
    while todo:
        x = next(todo[-1], None)
        if x is None:
            todo.pop()
            if todo:
                line.pop()
        elif x not in but:
            line.append(x)
            yield x, root, depth + len(todo) if depth >= 0 else BELOW_LOOP, line[:]
            todo.append(iter(below.get(x, ())))


def traverse_flat(parent_of: dict[str, str]) -> Iterator[tuple[str, str, int]]:
    """``traverse`` without paths, in time and memory linear in the component."""
    colour: dict[str, int] = {}
    known: dict[str, tuple[str, int]] = {}
    for start in [*parent_of, *dict.fromkeys(parent_of.values())]:
        stack: list[str] = []
        node: str | None = start
        while node is not None and colour.get(node, WHITE) == WHITE:
            colour[node] = GREY
            stack.append(node)
            node = parent_of.get(node)
        if node is not None and colour[node] == GREY:
            at = stack.index(node)
            first = min(stack[at:])
            for x in stack[at:]:
                known[x] = (first, ON_LOOP)
                colour[x] = BLACK
            del stack[at:]
        while stack:
            x = stack.pop()
            up = parent_of.get(x)
            if up is None:
                known[x] = (x, 0)
            else:
                root, depth = known[up]
                known[x] = (root, depth + 1 if depth >= 0 else BELOW_LOOP)
            colour[x] = BLACK
    for node, (root, depth) in known.items():
        yield node, root, depth


def _search(with_path: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "root", "depth"] + ["path"] * with_path
        types = [pa.string(), pa.string(), pa.int32()] + [pa.list_(pa.string())] * with_path
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out.clear()
            size = 0
            return b

        def solve(links: dict[str, str]) -> Iterator[pa.RecordBatch]:
            nonlocal size
            for row in traverse(links) if with_path else traverse_flat(links):
                out.append(row)
                size += len(row[3]) if with_path else 1
                if size > 20_000:
                    yield flush()

        comp, links = None, {}
        for b in batches:
            for c, parent, child in zip(*(x.to_pylist() for x in b.columns)):
                if c != comp:
                    yield from solve(links)
                    comp, links = c, {}
                links[child] = parent
        yield from solve(links)
        if out:
            yield flush()

    return run


def hierarchy(edges: DataFrame, with_path: bool = True, local_bound: int = 500_000) -> DataFrame:
    """(node, root, depth[, path]) of every node of ``edges`` (parent, child), each node once.

    depth counts the links from the root, 0 for a root, which is its own root; path runs from the root to the node.
    On a loop (also of one node) depth is -1, below a loop -2; root is then the smallest node of that loop in code
    point order, and path begins with the whole loop from that node on, followed by the way down.
    Rows with a null end are ignored and repeated rows count once. A child with several parents keeps the smallest
    one here; ``extra_links`` has the others. An empty table gives an empty result. Other columns are not read.
    ``local_bound`` changes only how a component of more rows is solved, not the result.
    """
    links = edges.select("parent", "child").filter("parent is not null and child is not null")
    links = materialize(links.groupBy("child").agg(F.min("parent").alias("parent")).select("parent", "child"), "links")
    comps = connected_components(links.select(F.xxhash64("parent").alias("u"), F.xxhash64("child").alias("v")))
    placed = materialize(links.withColumn("id", F.xxhash64("child")).join(comps, "id").select("component", "parent", "child"), "placed")
    discard(links)
    big = placed.groupBy("component").count().filter(F.col("count") > local_bound).select("component")
    big = materialize(big, "big")  # at most rows / local_bound of them
    none = big.isEmpty()
    small = placed if none else placed.join(big, "component", "left_anti")
    schema = "node string, root string, depth int" + ", path array<string>" * with_path
    out = small.repartition("component").sortWithinPartitions("component").mapInArrow(_search(with_path), schema)
    if none:
        return out
    return out.unionByName(_doubling(placed.join(big, "component", "left_semi").select("parent", "child"), with_path))


def _doubling(links: DataFrame, with_path: bool) -> DataFrame:
    """The same by pointer doubling: every round, each node's known ancestor line doubles in length."""
    nodes = links.select(F.col("parent").alias("node")).distinct().join(links.withColumnRenamed("child", "node").select("node"), "node", "left_anti")
    roots = nodes.select("node", F.col("node").alias("up"), F.lit(0).alias("steps"), F.col("node").alias("low"), F.lit(True).alias("done"))
    inner = links.select(F.col("child").alias("node"), F.col("parent").alias("up"), F.lit(1).alias("steps"), F.least("parent", "child").alias("low"), F.lit(False).alias("done"))
    now = materialize(inner.unionByName(roots), "line")
    n, reach = now.count(), 1
    while reach < n and not now.filter("not done").isEmpty():
        up = now.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("low").alias("low2"), F.col("done").alias("done2"))
        done = now.filter("done")
        step = now.filter("not done").join(up, "up").select(
            "node",
            F.col("up2").alias("up"),
            (F.col("steps") + F.col("steps2")).alias("steps"),
            F.least("low", "low2").alias("low"),
            F.col("done2").alias("done"),
        )
        nxt = materialize(done.unionByName(step), "line")
        discard(now)
        now, reach = nxt, reach * 2
    trees = now.filter("done").select("node", F.col("up").alias("root"), F.col("steps").alias("depth"))
    looped = now.filter("not done")
    on = looped.select(F.col("up").alias("node")).distinct()
    lows = looped.join(on, "node", "left_semi").select(F.col("node").alias("up"), F.col("low").alias("root"), F.lit(True).alias("hit"))
    rest = (
        looped.select("node", "up").join(lows.select("up", "root"), "up")
        .join(on.withColumn("hit", F.lit(True)), "node", "left")
        .select("node", "root", F.when(F.col("hit"), ON_LOOP).otherwise(BELOW_LOOP).alias("depth"))
    )
    flat = trees.unionByName(rest)
    return _paths(links, materialize(flat, "flat")) if with_path else flat


def _paths(links: DataFrame, flat: DataFrame) -> DataFrame:
    """``flat`` (node, root, depth) with paths, by doubling lines that are cut where they would run round a loop.

    A loop is cut above its least node, and a way down from a loop below the loop, which is then put before it.
    """
    on = flat.filter(F.col("depth") == ON_LOOP).select(F.col("node").alias("parent"), F.lit(True).alias("hit"))
    placed = flat.join(links.withColumnRenamed("child", "node"), "node", "left").join(on, "parent", "left")
    first = (F.col("depth") == ON_LOOP) & (F.col("node") == F.col("root"))
    below = (F.col("depth") == BELOW_LOOP) & F.col("hit").isNotNull()
    now = materialize(placed.select("node", F.when(~(first | below), F.col("parent")).alias("up"), F.array("node").alias("path")), "way")
    while not now.filter("up is not null").isEmpty():
        up = now.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        nxt = now.join(up, "up", "left").select("node", F.col("up2").alias("up"), F.when(F.col("path2").isNull(), F.col("path")).otherwise(F.concat("path2", "path")).alias("path"))
        nxt = materialize(nxt, "way")
        discard(now)
        now = nxt
    ways = flat.join(now, "node")
    # The longest line of a loop is the whole of it.
    whole = ways.filter(F.col("depth") == ON_LOOP).groupBy("root").agg(F.max_by("path", F.size("path")).alias("loop"))
    path = F.when(F.col("depth") >= 0, F.col("path")).when(F.col("depth") == ON_LOOP, F.col("loop")).otherwise(F.concat("loop", "path"))
    return ways.join(whole, "root", "left").select("node", "root", "depth", path.alias("path"))


def descendants(paths: DataFrame) -> DataFrame:
    """(node, descendant) from a hierarchy with paths: every node of a path is above the path's end. Strict."""
    return paths.select(F.explode("path").alias("node"), F.col("node").alias("descendant")).filter("node <> descendant")


def loops(paths: DataFrame) -> DataFrame:
    """(root, length, members) of each loop of a hierarchy with paths."""
    return paths.filter((F.col("depth") == ON_LOOP) & (F.col("node") == F.col("root"))).select("root", F.size("path").alias("length"), F.col("path").alias("members"))


def extra_links(edges: DataFrame) -> DataFrame:
    """(parent, child) of the links that ``hierarchy`` leaves out because the child has a smaller parent."""
    links = edges.select("parent", "child").filter("parent is not null and child is not null").distinct()
    kept = links.groupBy("child").agg(F.min("parent").alias("parent")).select("parent", "child")
    return links.join(kept, ["parent", "child"], "left_anti")
