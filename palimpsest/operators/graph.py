"""Graph operators on an edge table (src, dst): closures by frontier loops whose rounds are written to the shared folder.

Edges have set semantics; (a, b) reads "a depends on b". Null ends are dropped. ``reachable`` joins only the newest frontier
with the edges, and compares it with the nodes known before; ``reached_by_other`` also merges it into the known nodes. No
node or edge is ever collected to the driver. Graphs that fit one task are closed there in a single job, with equal results.
"""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialize

#: Rounds of a closure kept as tables of their own before they are written together.
LAYERS = 8
#: Links that one task strips to the core, or closes from its seeds, in memory; beyond, every round is a pair of joins.
STRIPPED_BY_ONE = 500_000
#: Links, as two numbers each, and nodes together, of which one task counts descendants; beyond, by joins.
LINKS_BY_ONE = 24_000_000
#: Pairs of components that this task keeps at a time; a graph that has more is divided.
MOST_PAIRS = 64_000_000


def edge_set(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").filter("src is not null and dst is not null").distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def _coded(batches: Iterator[pa.RecordBatch]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Names, link ends and seeds by number, of rows (src, dst) that are links and rows (seed, null)."""
    number: dict[str, int] = {}
    ends: list[list[int]] = [[], [], []]
    for x in batches:
        for src, dst in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
            i = number.setdefault(src, len(number))
            if dst is None:
                ends[2].append(i)
            else:
                ends[0].append(i)
                ends[1].append(number.setdefault(dst, len(number)))
    return list(number), *(np.array(e, np.int64) for e in ends)


def _names(names: list[str], hit: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(hit)
    for i in range(0, len(at), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array([names[j] for j in at[i : i + 50_000]], pa.string())], ["id"])


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``reachable`` over all links of one task: a breadth-first search in whole frontiers."""
    names, a, b, seeds = _coded(batches)
    order = np.argsort(a, kind="stable")
    first, to = np.searchsorted(a[order], np.arange(len(names) + 1)), b[order]
    hit = np.zeros(len(names), bool)
    frontier = np.unique(seeds)
    while len(frontier):
        sizes = first[frontier + 1] - first[frontier]
        at = np.repeat(first[frontier] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        found = np.unique(to[at])
        frontier = found[~hit[found]]
        hit[frontier] = True
    yield from _names(names, hit)


def _reach_other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``reached_by_other`` over all links of one task: least and greatest seed of each strong component, from the top down."""
    names, a, b, seeds = _coded(batches)
    n = len(names)
    if not len(a):
        return
    comp = strong_components(a, b, n)
    none = n
    lo, hi = [none] * (comp.max() + 1), [-1] * (comp.max() + 1)
    seed = np.zeros(n, bool)
    seed[seeds] = True
    order = np.lexsort((comp[a] != comp[b], -comp[a]))  # of a component's links, those within it come first
    for u, cu, cv in zip(a[order].tolist(), comp[a][order].tolist(), comp[b][order].tolist()):
        low, high = lo[cu], hi[cu]
        if seed[u]:
            low, high = min(low, u), max(high, u)
        if low < lo[cv]:
            lo[cv] = low
        if high > hi[cv]:
            hi[cv] = high
    lo, hi, own = np.array(lo)[comp], np.array(hi)[comp], np.arange(n)
    yield from _names(names, (hi >= 0) & ((lo != own) | (hi != own)))


def _by_one(run, links: DataFrame, seeds: DataFrame) -> DataFrame:
    rows = links.unionByName(seeds.select(F.col("id").alias("src"), F.lit(None).cast("string").alias("dst")).filter("src is not null"))
    return materialize(rows.coalesce(1).mapInArrow(run, "id string"), "closure")


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id) of every node that some seed (id) reaches over one link or more; a seed only if it is reached again."""
    links = materialize(edge_set(edges), "edges")
    if links.count() <= STRIPPED_BY_ONE:
        return _by_one(_reach, links, seeds.select("id").distinct())
    first = seeds.select(F.col("id").alias("src")).distinct().join(links, "src").select(F.col("dst").alias("id")).distinct()
    layers = [materialize(first, "layer")]
    while not layers[-1].isEmpty():
        if len(layers) > LAYERS:  # the last one stays by itself: it is the frontier
            whole = materialize(_union(layers[:-1]), "layers")
            for x in layers[:-1]:
                discard(x)
            layers = [whole, layers[-1]]
        nxt = layers[-1].select(F.col("id").alias("src")).join(links, "src").select(F.col("dst").alias("id")).distinct()
        layers.append(materialize(nxt.join(_union(layers), "id", "left_anti"), "layer"))
    return _union(layers)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def descendants_of(edges: DataFrame, start: str) -> DataFrame:
    """Strict: the start is left out even where it lies on a cycle. An unknown start has none."""
    seed = edges.sparkSession.range(1).select(F.lit(start).alias("id"))
    return reachable(edges, seed).filter(F.col("id") != start)


def ancestors_of(edges: DataFrame, start: str) -> DataFrame:
    return descendants_of(reverse(edges), start)


def has_path(edges: DataFrame, start: str, end: str) -> bool:
    """Whether ``end`` can be reached; a node reaches itself; unknown nodes reach nothing."""
    if start == end:
        return not edge_set(edges).filter((F.col("src") == start) | (F.col("dst") == start)).isEmpty()
    return not descendants_of(edges, start).filter(F.col("id") == end).isEmpty()


def reached_by_other(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id) of every node that a seed other than the node itself reaches.

    Each node keeps the least and the greatest seed that reach it: if there are two, one of them is not the node. Both
    spread by min and max alone, so one loop serves all nodes at once.
    """
    links = materialize(edge_set(edges), "edges")
    if links.count() <= STRIPPED_BY_ONE:
        return _by_one(_reach_other, links, seeds.select("id").distinct())
    start = seeds.select(F.col("id").alias("src")).distinct().join(links, "src").groupBy(F.col("dst").alias("id"))
    known = materialize(start.agg(F.min("src").alias("lo"), F.max("src").alias("hi")), "known")
    frontier = known
    while not frontier.isEmpty():
        sent = frontier.withColumnRenamed("id", "src").join(links, "src").groupBy(F.col("dst").alias("id")).agg(F.min("lo").alias("lo2"), F.max("hi").alias("hi2"))
        merged = known.join(sent, "id", "full").select(
            "id", F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi"),
            (F.col("lo").isNull() | F.coalesce(F.col("lo2") < F.col("lo"), F.lit(False)) | F.coalesce(F.col("hi2") > F.col("hi"), F.lit(False))).alias("fresh"),
        )
        merged = materialize(merged, "known")
        discard(known)
        known = merged
        frontier = known.filter("fresh").select("id", "lo", "hi")
    return known.filter("lo <> id or hi <> id").select("id")


def ending_with(nodes: DataFrame, ends: list[str], any_case: bool) -> DataFrame:
    c = F.lower("id") if any_case else F.col("id")
    test = F.lit(False)
    for e in ends:
        test = test | c.endswith(e.lower() if any_case else e)
    return nodes.filter(test)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, centrality): links at the node in either direction, and that over one less than all nodes."""
    links = edge_set(edges)
    d = links.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    n = d.count()
    return d.withColumn("centrality", F.col("degree") / F.lit(max(n - 1, 1)).cast("double"))


def strong_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The strong component of each of ``n`` nodes, numbered so that links between components lead to smaller numbers.

    Nodes without a way out or in are components of their own: they are stripped in whole arrays while they are many, those
    without a way out numbered from below and those without a way in from above. Over the core that is left goes an iterative
    depth-first search (Tarjan).
    """
    out, lower, upper = np.full(n, -1, np.int32), 0, []
    links = 2 * len(a) + 2
    while len(a) < links - links // 32:
        links = len(a)
        alive = out == -1
        last = np.ones(n, bool)
        last[a] = False
        first = np.ones(n, bool)
        first[b] = False
        last, first = np.flatnonzero(last & alive), np.flatnonzero(first & ~last & alive)
        out[last] = np.arange(lower, lower + len(last))
        lower += len(last)
        out[first] = -2
        upper.append(first)
        kept = (out[a] == -1) & (out[b] == -1)
        a, b = a[kept], b[kept]
    core = np.flatnonzero(out == -1)
    number = np.zeros(n, np.int32)
    number[core] = np.arange(len(core))
    out[core] = lower + _searched(number[a], number[b], len(core))
    lower = out.max(initial=-1) + 1
    for first in reversed(upper):
        out[first] = np.arange(lower, lower + len(first))
        lower += len(first)
    return out.astype(np.int64)


def _searched(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """``strong_components`` by depth-first search alone."""
    order = np.argsort(a, kind="stable")
    first = array("i", np.searchsorted(a[order], np.arange(n + 1)).astype(np.int32).tobytes())
    to = array("i", b[order].astype(np.int32).tobytes())
    del order
    index, low, comp = array("i", bytes(4 * n)), array("i", bytes(4 * n)), array("i", [-1]) * n
    path: list[int] = []
    count = found = 0
    for root in range(n):
        if index[root]:
            continue
        work = [(root, first[root])]
        while work:
            v, at = work.pop()
            if at == first[v] and not index[v]:
                count += 1
                index[v] = low[v] = count
                path.append(v)
            down = False
            while at < first[v + 1]:
                x = to[at]
                at += 1
                if not index[x]:
                    work.append((v, at))
                    work.append((x, first[x]))
                    down = True
                    break
                if comp[x] < 0 and index[x] < low[v]:
                    low[v] = index[x]
            if down:
                continue
            if low[v] == index[v]:
                while True:
                    x = path.pop()
                    comp[x] = found
                    if x == v:
                        break
                found += 1
            if work and low[v] < low[work[-1][0]]:
                low[work[-1][0]] = low[v]
    return np.array(comp, np.int32)


#: Words of 64 bits in one sweep: so many times 64 components are looked for at once.
SWEEP_WORDS = 8
#: Links whose ends are numbered at once.
ENDS_AT_ONCE = 4_000_000
#: Pairs of components brought together at once where they are listed.
PAIRS_AT_ONCE = 4_000_000


def _once(x: np.ndarray) -> np.ndarray:
    """The values of ``x``, which is sorted in place, each once: faster than ``np.unique``, which hashes."""
    x.sort()
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def _ends(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The node of each number, in order, and the ends of all links (a, b) by number; in groups, to hold little besides them."""
    ids, groups, some, rows = np.zeros(0, np.int64), [], [], 0
    for x in itertools.chain(batches, [None]):
        if x is not None:
            some.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
            rows += x.num_rows
        if some and (x is None or rows >= ENDS_AT_ONCE):
            groups.append(np.concatenate([c[i] for i in (0, 1) for c in some]))
            ids = _once(np.concatenate([ids, groups[-1]]))
            some, rows = [], 0
    a, b = (np.empty(sum(map(len, groups)) // 2, np.int32) for _ in range(2))
    at = len(a)
    while groups:
        group = groups.pop()
        order = np.argsort(group)
        number = np.empty(len(group), np.int32)
        number[order] = np.searchsorted(ids, group[order])
        half = len(group) // 2
        a[at - half : at], b[at - half : at] = number[:half], number[half:]
        at -= half
    return ids, a, b


def _condensed(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strong component of each node; of the components, their sizes, the links (up, down) among them in order of height and up, and their heights."""
    comp = strong_components(a, b, n)
    size = np.bincount(comp)
    m = len(size)
    links = comp[a]
    links *= m
    links += comp[b]
    del a, b
    links = _once(links)
    up = (links // m).astype(np.int32)
    down = (links - up * np.int64(m)).astype(np.int32)
    del links
    up, down = up[up != down], down[up != down]
    height = [0] * m  # links on the longest way down
    for i in range(0, len(up), 100_000):
        for x, y in zip(up[i : i + 100_000].tolist(), down[i : i + 100_000].tolist()):  # in order of x, and y < x
            if height[y] >= height[x]:
                height[x] = height[y] + 1
    height = np.array(height, np.int32)
    order = np.argsort(height[up].astype(np.uint16) if height.max(initial=0) < 1 << 16 else height[up], kind="stable")
    up = up[order]
    return comp.astype(np.int32), size, up, down[order], height


def _counts_out(ids: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(ids), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]) for x in (ids, counts)], ["h", "n"])


def _layers(up: np.ndarray, height: np.ndarray) -> list[tuple[int, int]]:
    """The runs of links whose upper ends are of one height, of links in order of it."""
    ends = np.flatnonzero(np.diff(height[up])) + 1
    return list(itertools.pairwise([0, *ends.tolist(), len(up)]))


def _reached(up: np.ndarray, down: np.ndarray, seeds: np.ndarray, layers: list[tuple[int, int]], upwards: bool = False) -> np.ndarray:
    """The ``seeds``, a mask over all components, and what they reach over the links, or what reaches them."""
    hit = seeds.copy()
    one, other = (down, up) if upwards else (up, down)
    for i, j in layers if upwards else reversed(layers):
        hit[other[i:j][hit[one[i:j]]]] = True
    return hit


def _weak(up: np.ndarray, down: np.ndarray, m: int) -> np.ndarray:
    """The least component that each is linked with in any direction."""
    least = np.arange(m, dtype=np.int32)
    while True:
        a, b = least[up], least[down]
        apart = a != b
        if not apart.any():
            return least
        up, down, a, b = up[apart], down[apart], a[apart], b[apart]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(least, further := least[least]):
            least = further


def _listed(up: np.ndarray, down: np.ndarray, size: np.ndarray, layers: list[tuple[int, int]], most: int) -> np.ndarray | None:
    """Nodes strictly below each component, by lists that grow from the bottom up; None if these hold over ``most`` pairs."""
    m = len(size)
    lists, used, work = np.empty(most, np.int32), 0, 0
    start, length, total = (np.zeros(m, np.int64) for _ in range(3))
    for i, j in layers:
        first = np.flatnonzero(np.diff(up[i:j], prepend=-1))
        nodes = up[i:j][first]
        first = np.append(first, j - i)
        before = np.concatenate([[0], np.cumsum(1 + length[down[i:j]])])[first]
        p = 0
        while p < len(nodes):
            q = max(p + 1, int(np.searchsorted(before, before[p] + PAIRS_AT_ONCE, "right")) - 1)
            work += before[q] - before[p]
            if before[q] - before[p] > 4 * PAIRS_AT_ONCE or work > 8 * most:
                return None
            u, d = up[i + first[p] : i + first[q]], down[i + first[p] : i + first[q]]
            n = length[d]
            at = np.repeat(start[d] - np.cumsum(n) + n, n) + np.arange(n.sum())
            u = u.astype(np.int64) * m
            u, d = np.divmod(_once(np.concatenate([u + d, np.repeat(u, n) + lists[at]])), m)
            if used + len(d) > most:
                return None
            lists[used : used + len(d)] = d
            at = np.searchsorted(u, nodes[p:q])
            start[nodes[p:q]], length[nodes[p:q]] = used + at, np.diff(np.append(at, len(u)))
            total[nodes[p:q]] = np.add.reduceat(size[d], at)
            used += len(d)
            p = q
    return total


def _compact(ids: np.ndarray, up: np.ndarray, down: np.ndarray, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same graph without components that have no link; all stay in order."""
    there = np.zeros(len(ids), bool)
    there[up] = there[down] = True
    number = np.cumsum(there, dtype=np.int32) - np.int32(1)
    return ids[there], number[up], number[down], sources[there]


def _below_sinks(up: np.ndarray, down: np.ndarray, size: np.ndarray, sinks: np.ndarray, layers: list[tuple[int, int]]) -> np.ndarray:
    """Nodes of at most 64 ``sinks`` below each component, in one sweep with a bit for each of them."""
    bits = np.zeros(len(size), np.uint64)
    bits[sinks] = np.uint64(1) << np.arange(len(sinks), dtype=np.uint64)
    for i, j in layers:
        first = np.flatnonzero(np.diff(up[i:j], prepend=-1))
        bits[up[i:j][first]] = np.bitwise_or.reduceat(bits[down[i:j]], first)
    bits[sinks] = 0
    total = np.bitwise_count(bits).astype(np.int64)
    for k in np.flatnonzero(size[sinks] > 1):
        total += ((bits >> np.uint64(k)) & np.uint64(1)).astype(np.int64) * (size[sinks[k]] - 1)
    return total


def _add_below(up: np.ndarray, down: np.ndarray, height: np.ndarray, size: np.ndarray, sources: np.ndarray, counts: np.ndarray, most: int = MOST_PAIRS) -> bool:
    """Adds to ``counts`` the nodes strictly below each of the ``sources``; False if there are too many pairs to list.

    The sinks with most links are counted first, by bits, and left out: what is linked by them alone falls apart. All that
    reaches a hub has all that is below the hub below it, which is counted once. A graph of many pairs is so divided at a
    hub in each of its parts: those above the hub seek only what is not below it, and the others, which reach nothing above
    it, seek without what is above. The pairs that are left are listed, from fewer a link on the less a graph is divided.
    Dividing ends when it has taken about the work of the sweeps that would follow (``_sweep``).
    """
    if not most:
        return False
    left = len(up) * (48 + len(size) // 8000)
    todo = [(np.arange(len(size), dtype=np.int32), up, down, sources, 0)]
    del up, down
    while todo:
        ids, up, down, sources, depth = todo.pop()
        left -= len(up)
        layers = _layers(up, height[ids])
        kept = _reached(up, down, sources, layers)[up]
        ids, up, down, sources = _compact(ids, up[kept], down[kept], sources)
        if not len(up):
            continue
        layers = _layers(up, height[ids])
        ins = np.bincount(down, minlength=len(ids))
        ins[up] = 0
        sinks = np.argpartition(ins, -64)[-64:] if len(ids) > 64 else np.arange(len(ids))
        sinks = sinks[ins[sinks] > 0]
        found = _below_sinks(up, down, size[ids], sinks, layers)
        counts[ids[sources]] += found[sources]
        swept = np.zeros(len(ids), bool)
        swept[sinks] = True
        kept = ~swept[down]
        ids, up, down, sources = _compact(ids, up[kept], down[kept], sources)
        if not len(up):
            continue
        m, own, layers = len(ids), size[ids], _layers(up, height[ids])
        part = _weak(up, down, m)
        weight = (np.bincount(down, minlength=m) + 1.0) * (np.bincount(up, minlength=m) + 1.0) * own
        best = np.zeros(m)
        np.maximum.at(best, part, weight)
        hubs = np.zeros(m, bool)
        best = np.flatnonzero(weight == best[part])
        hubs[best[np.unique(part[best], return_index=True)[1]]] = True
        del found, swept, ins, kept, weight, best
        below, above = _reached(up, down, hubs, layers), _reached(up, down, hubs, layers, upwards=True)
        least = np.bincount(part[above], minlength=m).astype(float) @ np.bincount(part[below], minlength=m)
        bound = min(most, 8 * (depth + 1) * len(up) + 1_000_000) if left > 0 else most
        if least <= bound and (total := _listed(up, down, own, layers, bound)) is not None:
            counts[ids[sources]] += total[sources]
            continue
        if left <= 0:
            return False
        nodes = np.bincount(part[below], own[below], minlength=m).astype(np.int64)
        over = sources & above
        counts[ids[over]] += nodes[part[over]]
        counts[ids[over & hubs]] -= own[over & hubs]
        for out, rest in ((above, sources & ~above), (below, over & ~hubs)):
            kept = ~(out[up] | out[down])
            todo.append((*_compact(ids, up[kept], down[kept], rest), depth + 1))
    return True


def _below(most: int):
    """Counts strict descendants of every node of all links (a, b) of one task; no rows if there are too many pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, *ends = _ends(batches)
        if not len(ids):
            return
        comp, size, *links, height = _condensed(ends.pop(0), ends.pop(0), len(ids))  # given away, so that they are freed there
        counts = size - 1
        if _add_below(links.pop(0), links.pop(0), height, size, np.ones(len(size), bool), counts, most):
            yield from _counts_out(ids, counts[comp])

    return run


def _sweep(parts: int):
    """Counts strict descendants of every node among each ``parts``-th block of components, from all links (a, b, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [x for x in batches if x.num_rows]
        if not whole:
            return
        part = whole[0].column(2)[0].as_py()
        ids, a, b = _ends(whole)
        order = np.lexsort((b, a))  # so that all tasks number the components alike
        comp, size, up, down, height = _condensed(a[order], b[order], len(ids))
        m = len(size)
        layers = [(down[i:j], *np.unique(up[i:j], return_index=True)) for i, j in _layers(up, height)] if len(up) else []
        counts = np.zeros(m, np.int64)
        for block in range(part, -(-m // (64 * SWEEP_WORDS)), parts):
            at = np.arange(block * 64 * SWEEP_WORDS, min(m, (block + 1) * 64 * SWEEP_WORDS))
            own = at - at[0]
            bits = np.zeros((m, SWEEP_WORDS), np.uint64)
            bits[at, own >> 6] = np.uint64(1) << (own & 63).astype(np.uint64)
            for below, nodes, starts in layers:
                bits[nodes] |= np.bitwise_or.reduceat(bits[below], starts, axis=0)
            counts += np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
            for c in at[size[at] > 1]:
                word, bit = divmod(int(c - at[0]), 64)
                counts += ((bits[:, word] >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) * (size[c] - 1)
        counts -= int(part == 0)  # a node is not below itself
        yield from _counts_out(ids, counts[comp])

    return run


def _hash(column: str, seed: int) -> Column:
    return F.xxhash64(F.col(column), F.lit(seed))


def _hashed(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(id, h) of every node, h being a number of its own, the links (a, b) by these numbers, each once, and the number of nodes."""
    given = materialize(edges.select("src", "dst").filter("src is not null and dst is not null"), "edges")
    names = materialize(nodes_of(given), "nodes")
    n = names.count()
    # Two nodes of one hash would be one node: another seed then parts them.
    seed = next(i for i in itertools.count() if names.select(_hash("id", i).alias("h")).distinct().count() == n)
    links = materialize(given.select(_hash("src", seed).alias("a"), _hash("dst", seed).alias("b")).distinct(), "links")
    discard(given)
    return names.select("id", _hash("id", seed).alias("h")), links, n


def impact_counts(edges: DataFrame, nodes: DataFrame | None = None, max_depth: int | None = None, links_by_one: int = LINKS_BY_ONE, most: int = MOST_PAIRS) -> DataFrame:
    """(id, impact_count): strict descendants of each node, 0 included for ``nodes`` (id) without any.

    Up to ``links_by_one`` links and nodes, one task takes all of them as numbers, condenses strong components, divides what remains
    at its hubs (``_add_below``) and lists the pairs that are left. Where these are more than ``most``, every task takes all
    links and sweeps upwards through their layers, with the descendants among some blocks of components as bits: the work
    is links times nodes over 64, in whole arrays, and only counts leave a task. Beyond, all pairs are kept as rows, as an
    exact count then requires. The counts are the same. ``max_depth`` bounds the distance, for which pairs are kept too.
    """
    ids, links, known = _hashed(edges)
    n = links.count()
    if max_depth is None and n + known <= links_by_one:
        found = materialize(links.repartition(1).mapInArrow(_below(most), "h bigint, n bigint"), "counts")
        if n and found.isEmpty():
            parts = max(1, min(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), known // (64 * SWEEP_WORDS * 4)))
            copies = links.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartitionById(parts, F.col("part"))
            found = copies.mapInArrow(_sweep(parts), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    else:
        found = _counted_pairs(links, max_depth)
    counts = ids.join(found, "h", "left").select("id", F.coalesce("n", F.lit(0)).alias("impact_count"))
    if nodes is None:
        return counts
    return nodes.select("id").distinct().join(counts, "id", "left").select("id", F.coalesce("impact_count", F.lit(0)).alias("impact_count"))


def _counted_pairs(links: DataFrame, max_depth: int | None) -> DataFrame:
    """(h, n): nodes other than h that h reaches over links (a, b)."""
    layers = [materialize(links.select(F.col("a").alias("id"), F.col("b").alias("to")), "pairs")]
    depth = 1
    while not layers[-1].isEmpty() and (max_depth is None or depth < max_depth):
        if len(layers) > LAYERS:
            whole = materialize(_union(layers[:-1]), "pairs")
            for x in layers[:-1]:
                discard(x)
            layers = [whole, layers[-1]]
        step = layers[-1].join(links, F.col("to") == F.col("a")).select("id", F.col("b").alias("to")).distinct()
        layers.append(materialize(step.join(_union(layers), ["id", "to"], "left_anti"), "pairs"))
        depth += 1
    return _union(layers).filter("id <> to").groupBy(F.col("id").alias("h")).agg(F.count(F.lit(1)).alias("n"))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rounds of ``cyclic_core`` over all links of one task."""
    links = [x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    n = None
    while n != len(links):
        n = len(links)
        ins, outs = {b for _, b in links}, {a for a, _ in links}
        links = [(a, b) for a, b in links if a in ins and b in outs]
    for i in range(0, n, 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*links[i : i + 20_000])], ["src", "dst"])


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The links that remain when nodes without a way in or out are stripped, again and again: all cycles lie in them."""
    links = materialize(edge_set(edges), "core")
    n = links.count()
    while n:
        if n <= STRIPPED_BY_ONE:
            kept = materialize(links.coalesce(1).mapInArrow(_strip, "src string, dst string"), "core")
            discard(links)
            return kept
        kept = links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        kept = materialize(kept.select("src", "dst"), "core")
        m = kept.count()
        discard(links)
        links = kept
        if m == n:
            break
        n = m
    return links


def elementary_cycles(edges: DataFrame, max_length: int | None = None, at_least: int | None = None) -> DataFrame:
    """(cycle ARRAY<STRING>, length): every elementary cycle once, from its least node on.

    Paths grow from each node of the core through greater nodes only, so a cycle is met exactly once. Their number can
    grow exponentially with the core; ``max_length`` bounds it. ``at_least`` ends the search with the first length by
    which so many are found: all cycles up to that length are there, so the first ``at_least`` by length are exact.
    """
    core = cyclic_core(edges)
    schema = "cycle array<string>, length int"
    found = [core.sparkSession.createDataFrame([], schema)]
    paths = core.filter("src <= dst").select(F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"))
    loops = paths.filter("first = last").select(F.array("first").alias("cycle"), F.lit(1).alias("length"))
    found.append(loops)
    n = 0 if at_least is None else loops.count()
    paths = materialize(paths.filter("first < last"), "paths")
    length = 2
    while not paths.isEmpty() and (max_length is None or length <= max_length) and (at_least is None or n < at_least):
        closed = paths.join(core, (F.col("last") == F.col("src")) & (F.col("first") == F.col("dst")))
        closed = materialize(closed.select(F.col("path").alias("cycle"), F.size("path").alias("length")), "closed")
        found.append(closed)
        n += 0 if at_least is None else closed.count()
        grown = paths.join(core, F.col("last") == F.col("src")).filter((F.col("dst") > F.col("first")) & ~F.array_contains("path", F.col("dst")))
        grown = materialize(grown.select("first", F.col("dst").alias("last"), F.concat("path", F.array("dst")).alias("path")), "paths")
        discard(paths)
        paths = grown
        length += 1
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out
