"""Graph operators over edge tables unique on (from_stop, to_stop).

Transit graphs have thousands of edges while origin-destination pairs may be many, so pairs are what is distributed: kernels get
the adjacency as a broadcast whose size is checked. Beyond that bound shortest paths come from a frontier search over partitioned edges.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from routelab.shipping import ship
from routelab.staging import Scratch, staged

MAX_BROADCAST_EDGES = 2_000_000
BUCKET_LINKS = 250_000

Adjacency = dict[str, list[tuple[str, float]]]


def adjacency(edges: DataFrame) -> Adjacency:
    """from -> [(to, seconds)], for graphs of at most MAX_BROADCAST_EDGES edges."""
    rows = edges.select("from_stop", "to_stop", "duration").limit(MAX_BROADCAST_EDGES + 1).collect()
    if len(rows) > MAX_BROADCAST_EDGES:
        raise ValueError(f"more than {MAX_BROADCAST_EDGES} edges: frontier_paths needs no copy of the graph")
    out: Adjacency = {}
    for a, b, seconds in rows:
        out.setdefault(a, []).append((b, float(seconds)))
        out.setdefault(b, [])
    for ends in out.values():
        ends.sort()
    return out


def dijkstra(graph: Adjacency, origin: str, banned_nodes: frozenset = frozenset(), banned_links: frozenset = frozenset(), dest: str | None = None) -> dict[str, tuple[float, tuple[str, ...]]]:
    """Least (seconds, path) of every node; the smallest path in string order among those as short."""
    done: dict[str, tuple[float, tuple[str, ...]]] = {}
    heap = [(0.0, (origin,))]
    while heap:
        seconds, path = heapq.heappop(heap)
        node = path[-1]
        if node in done:
            continue
        done[node] = (seconds, path)
        if node == dest:
            break
        for to, cost in graph.get(node, ()):
            if to not in done and to not in banned_nodes and (node, to) not in banned_links:
                heapq.heappush(heap, (seconds + cost, (*path, to)))
    return done


def yen(graph: Adjacency, origin: str, dest: str, k: int) -> list[tuple[float, tuple[str, ...]]]:
    """The k shortest simple paths, ascending, by Yen's deviations."""
    cost = {(a, b): c for a, ends in graph.items() for b, c in ends}
    first = dijkstra(graph, origin, dest=dest).get(dest) if origin in graph else None
    found, waiting = [first] if first else [], []
    seen = {p for _, p in found}
    while found and len(found) < k:
        last = found[-1][1]
        for at in range(len(last) - 1):
            root = last[: at + 1]
            links = frozenset((p[at], p[at + 1]) for _, p in found if p[: at + 1] == root and len(p) > at + 1)
            spur = dijkstra(graph, root[-1], frozenset(root[:-1]), links, dest).get(dest)
            if spur and (path := root[:-1] + spur[1]) not in seen:
                seen.add(path)
                heapq.heappush(waiting, (sum(cost[a, b] for a, b in zip(path, path[1:])), path))
        if not waiting:
            break
        found.append(heapq.heappop(waiting))
    return found


def shortest_paths(edges: DataFrame, origins: DataFrame) -> DataFrame:
    """origin, dest, seconds and path of every node that an origin (``origin``) reaches, itself included.

    A kernel over a broadcast graph of up to MAX_BROADCAST_EDGES edges; :func:`frontier_paths` beyond, with the same result.
    """
    spark = edges.sparkSession
    if edges.limit(MAX_BROADCAST_EDGES + 1).count() > MAX_BROADCAST_EDGES:
        return frontier_paths(edges, origins)
    ship(spark)
    graph = spark.sparkContext.broadcast(adjacency(edges))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(o, d, s, list(p)) for o in batch["origin"] if o in graph.value for d, (s, p) in dijkstra(graph.value, o).items()]
            yield pd.DataFrame(rows, columns=["origin", "dest", "seconds", "path"])

    return origins.select("origin").distinct().mapInPandas(run, "origin string, dest string, seconds double, path array<string>")


def all_pairs(edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.col("from_stop").alias("origin")).union(edges.select("to_stop"))
    return shortest_paths(edges, nodes)


def frontier_paths(edges: DataFrame, origins: DataFrame, delta: float | None = None, with_path: bool = True, to_origin: bool = False) -> DataFrame:
    """origin, dest, seconds (and path) of every node that the asked origins reach, by delta-stepping over partitioned edges.

    The state has a row for each origin and node met so far, nothing else: k origins need k times the nodes. In a round those nodes whose
    time improved since they were last left, and is less than ``delta`` seconds (unset: a quarter of the mean link, or the least link where
    that is longer) above that of the nearest of them, send their successors a message; messages to one node are combined with its state in
    one aggregate. So few nodes are left before their time is final, and most links are followed once. Links are dealt by their first node
    once, into a bucketed table: a round reads them, but shuffles only nodes to leave and messages. A round is staged; it repeats after a
    lost executor. Equal times go to the smallest path in string order. ``to_origin`` follows edges backwards: the times
    are those from each dest to the origin, and paths end there.
    """
    spark = edges.sparkSession
    tail, head = ("to_stop", "from_stop") if to_origin else ("from_stop", "to_stop")
    with Scratch(spark) as scratch:
        every = edges.select(F.col(tail).alias("node"), F.col(head).alias("next"), F.col("duration").cast("double").alias("cost"))
        links = scratch.bucketed(every, "links", "node", max(spark.sparkContext.defaultParallelism, 1 + edges.count() // BUCKET_LINKS))
        mean, least = links.agg(F.avg("cost"), F.min("cost")).first()
        delta = delta or max((mean or 4.0) / 4, least or 0.0)
        path = [F.array("node").alias("path")] if with_path else []
        # times alone are least by hash aggregates; a struct would have every message sorted
        best, found = (F.struct("seconds", "path"), "best.*") if with_path else (F.col("seconds"), F.col("best").alias("seconds"))
        asked = origins.select(F.col("origin").alias("node"))
        start = links.select("node").union(links.select("next")).join(asked, "node", "left_semi").distinct()
        known = scratch(start.select(F.col("node").alias("origin"), "node", F.lit(0.0).alias("seconds"), *path, F.lit(True).alias("open")), "frontier")
        while True:
            nearest = known.filter("open").agg(F.min("seconds")).first()[0]
            if nearest is None:
                return staged(known.select("origin", F.col("node").alias("dest"), "seconds", *[c for c in known.columns if c == "path"]), "shortest")
            onward = F.concat(F.array("next"), "path") if to_origin else F.concat("path", F.array("next"))
            leaves = F.col("open") & (F.col("seconds") < nearest + delta)
            sent = known.filter(leaves).hint("shuffle_hash").join(links, "node").select("origin", F.col("next").alias("node"), (F.col("seconds") + F.col("cost")).alias("seconds"), *([onward.alias("path")] if with_path else []))
            kept = known.withColumns({"open": F.col("open") & ~leaves, "was": F.lit(True)})
            both = kept.unionByName(sent.withColumns({"open": F.lit(True), "was": F.lit(False)}))
            merged = both.groupBy("origin", "node").agg(F.min(best).alias("best"), F.min(F.when(F.col("was"), best)).alias("before"), F.bool_or(F.when(F.col("was"), F.col("open"))).alias("waits"))
            better = F.col("before").isNull() | (F.col("best") < F.col("before"))
            known = scratch(merged.select("origin", "node", found, (better | F.coalesce("waits", F.lit(False))).alias("open")), "frontier")


def min_plus_times(edges: DataFrame) -> DataFrame:
    """origin, dest and least seconds of all pairs by doubling path lengths: joins and minima only, for graphs too large to broadcast.

    Stops when a round shortens and finds no pair, after about log2 of the longest path's links; each round is staged.
    """
    links = edges.groupBy(F.col("from_stop").alias("origin"), F.col("to_stop").alias("dest")).agg(F.min("duration").alias("seconds"))
    nodes = links.select("origin").union(links.select("dest")).distinct()
    now = links.unionByName(nodes.select("origin", F.col("origin").alias("dest"), F.lit(0.0).alias("seconds"))).groupBy("origin", "dest").agg(F.min("seconds").alias("seconds"))
    while True:
        onward = now.select(F.col("origin").alias("via"), F.col("dest").alias("end"), F.col("seconds").alias("rest"))
        both = now.join(onward, F.col("dest") == F.col("via")).withColumn("through", F.col("seconds") + F.col("rest"))
        before = F.min(F.when(F.col("via") == F.col("end"), F.col("seconds")))
        after = staged(both.groupBy("origin", F.col("end").alias("dest")).agg(F.min("through").alias("seconds"), before.alias("before")), "times")
        now = after.select("origin", "dest", "seconds")
        if after.filter("before is null or seconds < before").isEmpty():
            return now


def dealt(df: DataFrame) -> DataFrame:
    """Few rows that each take long, over all cores."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def asked_pairs(edges: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """Distinct (origin, dest); without pairs every node with a null dest, which stands for all others."""
    if pairs is not None:
        return dealt(pairs.select("origin", "dest").distinct())
    nodes = edges.select(F.col("from_stop").alias("origin")).union(edges.select("to_stop")).distinct()
    return dealt(nodes.select("origin", F.lit(None).cast("string").alias("dest")))


def reversed_graph(graph: Adjacency) -> Adjacency:
    out: Adjacency = {a: [] for a in graph}
    for a, ends in graph.items():
        for b, cost in ends:
            out[b].append((a, cost))
    return out


def links_left(back: Adjacency, dest: str, closed: set[str], wanted: set[str]) -> dict[str, int]:
    """Fewest links from nodes to ``dest`` that stay out of ``closed``; ends once all of ``wanted`` are known."""
    known, layer, left = {dest: 0}, [dest], wanted - {dest}
    while layer and left:
        new = []
        for node in layer:
            for other, _ in back[node]:
                if other not in known and other not in closed:
                    known[other] = known[node] + 1
                    left.discard(other)
                    new.append(other)
        layer = new
    return known


def walks(graph: Adjacency, back: Adjacency, origin: str, dest: str, max_links: int | None = None) -> Iterator[tuple[float, tuple[str, ...]]]:
    """(seconds, path) of the simple paths from ``origin`` to ``dest``, depth first, which end where they arrive.

    A step is only taken to a node from which the destination can still be reached, so every branch gives a path and the first
    n paths cost no more than n times a path's links times the graph.
    """
    if origin == dest or origin not in graph or dest not in graph:
        return

    def onward(path: list[str], visited: set[str]) -> Iterator[tuple[str, float]]:
        ends = [(v, cost) for v, cost in graph[path[-1]] if v not in visited]
        left = links_left(back, dest, visited, {v for v, _ in ends})
        return iter([(v, cost) for v, cost in ends if v in left and (max_links is None or left[v] <= max_links - len(path))])

    path, visited, seconds = [origin], {origin}, [0.0]
    stack = [onward(path, visited)]
    while stack:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            visited.discard(path.pop())
            seconds.pop()
        elif step[0] == dest:
            yield seconds[-1] + step[1], (*path, dest)
        else:
            path.append(step[0])
            visited.add(step[0])
            seconds.append(seconds[-1] + step[1])
            stack.append(onward(path, visited))


def simple_paths(edges: DataFrame, pairs: DataFrame | None = None, max_links: int | None = None, max_paths: int | None = None) -> DataFrame:
    """origin, dest, path and seconds of all simple paths of at least one link, between ``pairs`` (origin, dest) or all nodes.

    With ``max_paths`` a pair that has more raises as soon as one path more is found; nothing is cut off.
    """
    spark = edges.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(adjacency(edges))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = shared.value
        back, nodes, columns = reversed_graph(graph), sorted(graph), ["origin", "dest", "path", "seconds"]
        for batch in batches:
            for origin, asked in zip(batch["origin"], batch["dest"]):
                rows = []
                for dest in nodes if asked is None else [asked]:
                    for n, (seconds, path) in enumerate(walks(graph, back, origin, dest, max_links)):
                        if n == max_paths:
                            raise ValueError(f"more than {max_paths} simple paths from {origin} to {dest}")
                        rows.append((origin, dest, list(path), seconds))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                yield pd.DataFrame(rows, columns=columns)

    return asked_pairs(edges, pairs).mapInPandas(run, "origin string, dest string, path array<string>, seconds double")


def path_counts(edges: DataFrame, pairs: DataFrame | None = None, max_paths: int = 500) -> DataFrame:
    """origin, dest, n_paths and hops (fewest links) of ``pairs``, or of all pairs, that have a path.

    Counting ends at ``max_paths`` + 1, which stands for too many: a pair of a large network may have more paths than can be counted.
    """
    spark = edges.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(adjacency(edges))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = shared.value
        back, nodes = reversed_graph(graph), sorted(graph)
        for batch in batches:
            rows = []
            for origin, asked in zip(batch["origin"], batch["dest"]):
                for dest in nodes if asked is None else [asked]:
                    n = sum(1 for _ in islice(walks(graph, back, origin, dest), max_paths + 1))
                    if n:
                        rows.append((origin, dest, n, links_left(back, dest, set(), {origin})[origin]))
            yield pd.DataFrame(rows, columns=["origin", "dest", "n_paths", "hops"])

    return asked_pairs(edges, pairs).mapInPandas(run, "origin string, dest string, n_paths bigint, hops bigint")


def shortest_of(paths: DataFrame, k: int) -> DataFrame:
    """The k shortest of each pair's paths with their rank; ties by the path's text."""
    order = Window.partitionBy("origin", "dest").orderBy("seconds", F.array_join("path", "|"))
    return paths.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def k_shortest(edges: DataFrame, pairs: DataFrame | None = None, k: int = 10) -> DataFrame:
    """origin, dest, path, seconds and rank of the k shortest simple paths of each pair, or of all: no enumeration, one kernel call a pair."""
    spark = edges.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(adjacency(edges))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = shared.value
        nodes = sorted(graph)
        for batch in batches:
            for origin, asked in zip(batch["origin"], batch["dest"]):
                ends = nodes if asked is None else [asked]
                rows = [(origin, dest, list(p), s, n) for dest in ends if dest != origin for n, (s, p) in enumerate(yen(graph, origin, dest, k), 1)]
                yield pd.DataFrame(rows, columns=["origin", "dest", "path", "seconds", "rank"])

    return asked_pairs(edges, pairs).mapInPandas(run, "origin string, dest string, path array<string>, seconds double, rank int")


def richest_pair(counts: DataFrame, least: int = 2, most: int = 500) -> DataFrame:
    """The pair of most paths among those with ``least`` to ``most``, of a table that :func:`path_counts` made; ties by ids."""
    return counts.filter(F.col("n_paths").between(least, most)).orderBy(F.desc("n_paths"), "origin", "dest").limit(1)
