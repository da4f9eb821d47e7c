"""Iterative graph operators: cycles, reachability and shortest chains.

Nodes are numbered once (:mod:`srcweave.operators.keys`) and all rounds run on longs.  Each round is a
few joins whose result is written once, so plans stay short and the work survives lost executors; whether
another is needed is observed while writing.  ``edges`` carry ``project_id, source, target``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcweave.operators.keys import encoded, number_nodes, numbered
from srcweave.session import Grown, write_counted, write_once

_NODE = ["project_id", "id"]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# Strongly connected components ----------------------------------------------


def trimmed(pairs: DataFrame, n_pairs: int, least_share: float = 0.05) -> tuple[DataFrame, int]:
    """Edges left after nodes that nothing enters or leaves have gone, again and again.

    Such nodes lie on no cycle.  Goes on while a round takes at least that share of the edges: what is
    left of long chains is quicker to settle by labels.
    """
    while n_pairs:
        rest = pairs
        for _ in range(2):  # two rounds a table
            entered, left = rest.select(F.col("b").alias("a")), rest.select(F.col("a").alias("b"))
            rest = rest.join(entered, "a", "left_semi").join(left, "b", "left_semi").select("a", "b")
        pairs, n_left = write_counted(rest)
        n_pairs, gone = n_left, n_pairs - n_left
        if gone < least_share * (n_left + gone):
            break
    return pairs, n_pairs


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Who speaks to whom: forward edges carry ``up`` labels, backward ones ``down``."""
    ways = F.array(
        F.struct(F.col("a").alias("n"), F.col("b").alias("to"), F.lit(True).alias("up_way")),
        F.struct(F.col("b").alias("n"), F.col("a").alias("to"), F.lit(False).alias("up_way")),
    )
    return pairs.select(F.inline(ways))


def _spread_labels(ways: DataFrame, labels: DataFrame) -> DataFrame:
    """One round: each node takes the least label it hears of.

    ``up`` is the least number known to reach the node, ``down`` the least known to
    be reached from it.  A node hears its neighbours and, so that long chains
    settle in few rounds, the nodes its own labels name.
    """
    asked = F.array(
        F.struct(F.col("up").alias("n"), F.col("n").alias("to"), F.lit(True).alias("up_way")),
        F.struct(F.col("down").alias("n"), F.col("n").alias("to"), F.lit(False).alias("up_way")),
    )
    calls = ways.unionByName(labels.select(F.inline(asked)))
    heard = calls.join(labels, "n").select(
        F.col("to").alias("n"), F.when(F.col("up_way"), F.col("up")).alias("up"),
        F.when(~F.col("up_way"), F.col("down")).alias("down"),
        F.lit(None).cast("long").alias("old_up"), F.lit(None).cast("long").alias("old_down"),
    )
    own = labels.select("n", "up", "down", F.col("up").alias("old_up"), F.col("down").alias("old_down"))
    return own.unionByName(heard).groupBy("n").agg(*[F.min(c).alias(c) for c in ("up", "down", "old_up", "old_down")])


def _settled_labels(pairs: DataFrame) -> DataFrame:
    ways = _both_ways(pairs)
    # written, so that a node with very many edges can be split in the joins
    labels = write_once(
        pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct().select("n", F.col("n").alias("up"), F.col("n").alias("down"))
    )
    moved = F.count_if((F.col("up") != F.col("old_up")) | (F.col("down") != F.col("old_down")))
    while True:
        # two rounds a table: what the second leaves as it was has settled
        step, n_moved = write_counted(_spread_labels(ways, _spread_labels(ways, labels)), moved)
        labels = step.select("n", "up", "down")
        if n_moved == 0:
            return labels


def strong_components(pairs: DataFrame) -> DataFrame:
    """``n`` and ``scc`` (the least number of its component) of the nodes in components of two and more.

    ``pairs`` are distinct edges ``a, b``.
    """
    rest, n_pairs = trimmed(*write_counted(pairs.where("a <> b")))
    found: list[DataFrame] = []
    while n_pairs:
        labels = _settled_labels(rest)
        # Only edges between nodes with equal labels can lie in one component.
        done = labels.where("up = down")
        found.append(done.select("n", F.col("up").alias("scc")))
        open_nodes = labels.where("up <> down")
        left, right = open_nodes.toDF("a", "a_up", "a_down"), open_nodes.toDF("b", "b_up", "b_down")
        inner = rest.join(left, "a").join(right, "b").where("a_up = b_up AND a_down = b_down").select("a", "b")
        rest, n_pairs = trimmed(*write_counted(inner))
    if not found:
        return pairs.sparkSession.createDataFrame([], "n long, scc long")
    # a node that only joins others is settled with its own label
    sizes = _union(found).groupBy("scc").agg(F.count("*").alias("size")).where("size > 1").select("scc")
    return _union(found).join(sizes, "scc").select("n", "scc")


def _cyclic(pairs: DataFrame) -> DataFrame:
    """``n``, ``scc`` and ``size`` of all nodes on a cycle, written once; a loop is a component of its own."""
    members = write_once(strong_components(pairs))
    alone = pairs.where("a = b").select(F.col("a").alias("n")).join(members, "n", "left_anti")
    sizes = members.groupBy("scc").agg(F.count("*").alias("size"))
    return write_once(
        members.join(sizes, "scc").select("n", "scc", "size")
        .unionByName(alone.select("n", F.col("n").alias("scc"), F.lit(1).cast("long").alias("size")))
    )


def cyclic_components(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle, with their strongly connected component.

    ``scc`` is the least id of the component, ``size`` its number of nodes.  A
    node alone counts only when it has an edge to itself.
    """
    nodes = number_nodes(edges)
    return _named(_cyclic(encoded(edges, nodes)), nodes, "n", "scc").select(*_NODE, "scc", "size")


def _named(rows: DataFrame, nodes: DataFrame, node: str, *others: str) -> DataFrame:
    """Rows with numbers replaced by ids; ``node`` becomes ``id``."""
    rows = rows.join(nodes.withColumnRenamed("n", node), node).drop(node)
    for column in others:
        rows = rows.withColumnRenamed(column, "_n").join(
            nodes.select(F.col("n").alias("_n"), F.col("id").alias(column)), "_n"
        ).drop("_n")
    return rows


# One cycle of each component --------------------------------------------------


def _rings(steps: DataFrame) -> DataFrame:
    """``n`` and ``to`` of the nodes on the rings of a function, by squaring it until its image is stable."""
    power = steps.select("n", "to")
    _, size = write_counted(power.select("to").distinct())
    while True:
        for _ in range(2):
            next_ = power.select(F.col("n").alias("to"), F.col("to").alias("far"))
            power = power.join(next_, "to").select("n", F.col("far").alias("to"))
        power = write_once(power)
        image, smaller = write_counted(power.select(F.col("to").alias("n")).distinct())
        if smaller == size:
            return write_once(steps.join(image, "n", "left_semi").select("n", "to", "scc"))
        size = smaller


def _heads(rings: DataFrame) -> DataFrame:
    """The rings with ``head``, the least node of the own ring, known by doubling."""
    state = write_once(rings.select("n", "to", F.col("n").alias("head")))
    while True:
        ahead = state.select(F.col("n").alias("to"), F.col("to").alias("far"), F.col("head").alias("other"))
        state, changed = write_counted(
            state.join(ahead, "to").select(
                "n", F.col("far").alias("to"), F.least("head", "other").alias("head"), (F.col("other") < F.col("head")).alias("changed")
            ),
            F.count_if("changed"),
        )
        state = state.drop("changed")
        if not changed:
            return rings.join(state.select("n", "head"), "n")


def _ranked(rings: DataFrame) -> DataFrame:
    """``n``, ``head`` and ``left``, the number of steps from a node to the last one before the head."""
    last = F.col("to") == F.col("head")
    state = write_once(rings.select(
        "n", "head", F.when(~last, F.col("to")).alias("to"), F.when(last, 0).otherwise(1).cast("long").alias("left")
    ))
    while True:
        ahead = state.select(F.col("n").alias("to"), F.col("to").alias("far"), F.col("left").alias("more"))
        state, open_nodes = write_counted(
            state.join(ahead, "to", "left").select(
                "n", "head", F.col("far").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")
            ),
            F.count("to"),
        )
        if not open_nodes:
            return state


def cycle_witness(edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One simple closed path through each cyclic component, of any length, a row for each step.

    ``project_id, scc, size, length, severity, pos, id``: position 0 is the least node of the path, which comes again
    at position ``length``.  From every node the edge to its least successor in the component is followed;
    these edges hold at least one ring for each component, and the ring with the least node is told.
    Rings, heads and positions are found by doubling, so a ring of a million nodes takes
    twenty rounds.  ``names`` (``project_id, id, label``) adds ``label``.
    """
    nodes = number_nodes(edges)
    pairs = encoded(edges, nodes)
    members = _cyclic(pairs)
    inside = members.where("size > 1").select("n", "scc")
    inner = (
        pairs.where("a <> b").join(inside.toDF("a", "scc"), "a").join(inside.toDF("b", "other"), "b").where("scc = other")
    )
    steps = write_once(inner.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("to"), F.min("scc").alias("scc")))
    rings = write_once(_heads(_rings(steps)))
    told = rings.groupBy("scc").agg(F.min("head").alias("head"))
    kept = write_once(rings.join(told, ["scc", "head"]).select("n", "to", "scc", "head"))
    lengths = kept.groupBy("scc").agg(F.count("*").cast("int").alias("length"))
    ranked = _ranked(kept).join(kept.select("n", "scc"), "n").join(lengths, "scc")
    at = (F.col("length") - 1 - F.col("left")).cast("int")
    closing = F.when(at == 0, F.array(F.lit(0), F.col("length"))).otherwise(F.array(at))
    walked = ranked.select("scc", "length", "n", F.explode(closing).alias("pos"))
    loops = members.where("size = 1").select(
        "scc", F.lit(1).alias("length"), "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos")
    )
    sizes = members.select("scc", "size").distinct()
    rows = _named(walked.unionByName(loops).join(sizes, "scc"), nodes, "n", "scc").select(
        "project_id", "scc", "size", "length", cycle_severity(F.col("length")).alias("severity"), "pos", "id"
    )
    return rows if names is None else rows.join(names.select(*_NODE, "label"), _NODE, "left")


def witness_paths(steps: DataFrame) -> DataFrame:
    """The steps of :func:`cycle_witness` with names, one row for each path: ``path`` and ``labels``."""
    rows = steps.groupBy("project_id", "scc", "length", "severity").agg(
        F.array_sort(F.collect_list(F.struct("pos", "id", F.coalesce("label", "id").alias("label")))).alias("steps")
    )
    return rows.select(
        "project_id", F.col("steps.id").alias("path"), "length", "severity", F.col("steps.label").alias("labels")
    )


# Bounded simple cycles --------------------------------------------------------


def cycle_severity(length: Column) -> Column:
    return F.when(length <= 2, "high").otherwise("medium")


def short_cycles(
    edges: DataFrame, max_length: int = 4, names: DataFrame | None = None
) -> DataFrame:
    """Simple cycles of up to ``max_length`` nodes, each once, from its least node.

    The length bound is what is asked for; within it every cycle is reported.
    ``names`` (``project_id, id, label``) adds the path in words.
    """
    plain = edges.select("project_id", "source", "target").distinct()
    on_cycle = write_once(cyclic_components(edges).select(*_NODE, "scc"))
    inner = write_once(
        plain.join(on_cycle.toDF("project_id", "source", "s"), ["project_id", "source"])
        .join(on_cycle.toDF("project_id", "target", "t"), ["project_id", "target"])
        .where("s = t")
        .select("project_id", "source", "target")
    )
    closed = [inner.where("source = target").select("project_id", F.array("source").alias("path"))]
    paths = inner.where("source < target").select(
        "project_id", F.col("source").alias("start"), F.col("target").alias("last"),
        F.array("source", "target").alias("path"),
    )
    hop = inner.select("project_id", F.col("source").alias("last"), F.col("target").alias("next"))
    for length in range(2, max_length + 1):
        longer = paths.join(hop, ["project_id", "last"]).where("next >= start")
        longer = write_once(
            longer.where((F.col("next") == F.col("start")) | ~F.array_contains("path", F.col("next")))
        )
        closed.append(longer.where("next = start").select("project_id", "path"))
        paths = longer.where("next <> start").select(
            "project_id", "start", F.col("next").alias("last"),
            F.concat("path", F.array("next")).alias("path"),
        )
    length = F.size("path")
    cycles = _union(closed).select(
        "project_id", F.concat("path", F.array(F.get("path", F.lit(0)))).alias("path"),
        length.alias("length"), cycle_severity(length).alias("severity"),
    )
    if names is None:
        return cycles
    steps = cycles.withColumn("key", F.array_join("path", " ")).select(
        "project_id", "key", "path", "length", "severity", F.posexplode("path").alias("pos", "id")
    )
    labelled = steps.join(names.select("project_id", "id", "label"), ["project_id", "id"], "left")
    return (
        labelled.groupBy("project_id", "key", "path", "length", "severity")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("pos", F.coalesce("label", "id").alias("label")))
            ).alias("steps")
        )
        .select(
            "project_id", "path", "length", "severity",
            F.col("steps.label").alias("labels"),
        )
    )


def cycle_text(path: Column) -> Column:
    return F.array_join(path, " -> ")


# Reachability ----------------------------------------------------------------

#: Seeds whose bits share one long.
_SEEDS = 64
_WAVE = "n long, word long, bits long, depth int"


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(number, F.lit(_SEEDS)).cast("int"))


def _waves(
    pairs: DataFrame, starts: DataFrame, max_depth: int | None, wanted: DataFrame | None = None
) -> DataFrame:
    """Breadth-first search from all seeds at once: which seeds' bits reach a node first at which depth.

    ``starts`` holds ``n`` and ``seed`` (dense numbers).  A node keeps 64 seeds in a long, and what has been seen is
    one table of the bits of each node, made anew each round; so a round costs what it finds plus that table, however
    many rounds there were.  The waves are appended to one table, which is read once at the end.
    With ``wanted`` (``n``, ``word``, ``bits``) the search ends as soon as every wanted bit has reached its node.
    """
    waves = Grown(pairs.sparkSession, _WAVE)
    word = F.floor(F.col("seed") / _SEEDS)
    seen, n_new = write_counted(
        starts.groupBy("n", word.alias("word")).agg(F.bit_or(_bit(F.col("seed"))).alias("fresh")).select(
            "n", "word", F.col("fresh").alias("bits"), "fresh"
        )
    )
    depth = 0
    while n_new:
        wave = seen.where("fresh <> 0").select("n", "word", F.col("fresh").alias("bits"), F.lit(depth).alias("depth"))
        waves.add(wave)
        if wanted is not None:
            got = wave.select("n", "word", F.col("bits").alias("got"))
            still = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("got", F.lit(0).cast("long"))))
            missing = wanted.join(got, ["n", "word"], "left").select("n", "word", still.alias("bits"))
            wanted, n_wanted = write_counted(missing.where(F.col("bits") != 0))
            if not n_wanted:
                break
        depth += 1
        if max_depth is not None and depth > max_depth:
            break
        reached = (
            wave.join(pairs.toDF("n", "next"), "n").groupBy(F.col("next").alias("n"), "word")
            .agg(F.bit_or("bits").alias("fresh"))
        )
        before = seen.select("n", "word", "bits", F.lit(0).cast("long").alias("fresh"))
        merged = before.unionByName(reached.select("n", "word", F.lit(0).cast("long").alias("bits"), "fresh"))
        merged = merged.groupBy("n", "word").agg(F.bit_or("bits").alias("old"), F.bit_or("fresh").alias("new"))
        seen, n_new = write_counted(
            merged.select(
                "n", "word", F.col("old").bitwiseOR(F.col("new")).alias("bits"),
                F.col("new").bitwiseAND(F.bitwise_not("old")).alias("fresh"),
            ),
            F.count_if(F.col("fresh") != 0),
        )
    return waves.table


def _squared(jumps: DataFrame, most: int) -> DataFrame | None:
    """Pairs of nodes that two jumps join, or none if there are more than so many ways to make them."""
    entering, leaving = (jumps.groupBy(F.col(c).alias("n")).agg(F.count("*").alias(c)) for c in ("b", "a"))
    n_ways = entering.join(leaving, "n").agg(F.sum(F.col("a") * F.col("b"))).head()[0] or 0
    if n_ways > most:
        return None
    return write_once(jumps.toDF("a", "_by").join(jumps.toDF("_by", "b"), "_by").select("a", "b").distinct())


def _spans(pairs: DataFrame, starts: DataFrame, max_depth: int | None) -> DataFrame:
    """The table of :func:`_waves` without ``wanted``, made a span of depths at a time.

    A jump joins the nodes that a walk of ``stride`` edges joins.  A shortest path to a node at depth ``d + stride`` passes one at
    depth ``d``, so the next depths are found a jump away from the last ``stride`` ones; of all ways to a node the first counts.
    The stride doubles for as long as jumps stay few, so a long chain or ring takes as many rounds as its length has binary digits.
    """
    waves = Grown(pairs.sparkSession, _WAVE)
    word = F.floor(F.col("seed") / _SEEDS)
    first = starts.groupBy("n", word.alias("word")).agg(F.bit_or(_bit(F.col("seed"))).alias("bits"))
    if not waves.add_counted(first.select("*", F.lit(0).alias("depth")), F.count("*")):
        return waves.table
    jumps, stride, n_depths, most = pairs, 1, 1, 2 * pairs.count()
    earlier = Window.partitionBy("n", "word").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    while max_depth is None or n_depths <= max_depth:
        seen = waves.table
        last = seen.where(F.col("depth") >= n_depths - stride)
        depth = (F.col("depth") + stride).alias("depth")
        reached = last.join(jumps.toDF("n", "next"), "n").select(F.col("next").alias("n"), "word", "bits", depth)
        if max_depth is not None:
            reached = reached.where(F.col("depth") <= max_depth)
        reached = reached.groupBy("n", "word", "depth").agg(F.bit_or("bits").alias("bits")).select(*seen.columns)
        known = F.coalesce(F.bit_or("bits").over(earlier), F.lit(0).cast("long"))
        fresh = seen.unionByName(reached).withColumn("known", known).where(F.col("depth") >= n_depths).select(
            "n", "word", F.col("bits").bitwiseAND(F.bitwise_not("known")).alias("bits"), "depth"
        )
        deepest = waves.add_counted(fresh.where("bits <> 0"), F.max("depth"))
        n_depths += stride
        if deepest < n_depths - 1:  # a depth without nodes has none behind it
            break
        longer = _squared(jumps, most) if n_depths == 2 * stride else None
        if longer is not None:
            jumps, stride = longer, 2 * stride
    return waves.table


def _seeds(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """``n`` and ``seed``: seeds numbered so that those of one project lie side by side."""
    found = seeds.select(*_NODE).join(nodes, _NODE).select("n")
    return numbered(found, ["n"], "seed")


def _seed_rows(waves: DataFrame, starts: DataFrame) -> DataFrame:
    """``start``, ``n`` and ``depth`` of each bit of the waves; ``start`` is the node of the seed."""
    several = F.filter(F.sequence(F.lit(0), F.lit(_SEEDS - 1)), lambda i: F.getbit("bits", i) == 1)
    each = F.when(F.bit_count("bits") == 1, F.array(F.length(F.bin("bits")) - 1)).otherwise(several)
    rows = waves.select("n", "depth", "word", F.explode(each).alias("i")).select(
        "n", "depth", (F.col("word") * _SEEDS + F.col("i")).alias("seed")
    )
    return rows.join(starts.toDF("start", "seed"), "seed").drop("seed")


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Every node each seed reaches, with its distance; the seed itself has 0."""
    nodes = number_nodes(edges, seeds)
    starts = _seeds(seeds, nodes)
    rows = _seed_rows(_spans(encoded(edges, nodes), starts, max_depth), starts)
    return _named(rows, nodes, "n", "start").select(
        "project_id", F.col("start").alias("seed"), "id", "depth"
    )


def impact_set(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """What depends on each seed: reachability against the edges."""
    turned = edges.select(
        "project_id", F.col("target").alias("source"), F.col("source").alias("target")
    )
    return reachable(turned, seeds, max_depth)


def dependency_chain(
    edges: DataFrame, pairs: DataFrame, max_depth: int | None = None
) -> DataFrame:
    """A shortest path for each ``(project_id, source, target)`` pair that has one.

    Among paths of one length the least in id order is taken.  Distances come from one search
    backwards from all targets, which ends when every pair that was asked for is settled; then every source steps to its least neighbour that is one nearer, so no
    path is carried that doesn't lead to its target.
    """
    pair = ["project_id", "source", "target"]
    ends = pairs.select("project_id", F.explode(F.array("source", "target")).alias("id"))
    nodes = number_nodes(edges, ends)
    hops = encoded(edges, nodes)
    asked = encoded(pairs, nodes)
    starts = _seeds(pairs.select("project_id", F.col("target").alias("id")), nodes)
    goal = asked.join(starts.toDF("b", "seed"), "b").withColumn("word", F.floor(F.col("seed") / _SEEDS))
    wanted = goal.groupBy(F.col("a").alias("n"), "word").agg(F.bit_or(_bit(F.col("seed"))).alias("bits"))
    waves = _waves(hops.select(F.col("b").alias("a"), F.col("a").alias("b")), starts, max_depth, wanted)
    near = waves.select(F.col("n").alias("a"), "word", "bits", "depth")
    walk, n_open = write_counted(
        goal.join(near, ["a", "word"]).where(F.col("bits").bitwiseAND(_bit(F.col("seed"))) != 0).select(
            "a", "b", "seed", "word", F.col("a").alias("at"), F.col("depth").alias("left"), F.col("depth").alias("length")
        ),
        F.count_if(F.col("left") > 0),
    )
    steps = Grown(edges.sparkSession, "a long, b long, length int, pos int, at long")
    steps.add(walk.select("a", "b", "length", F.lit(0).alias("pos"), "at"))
    depth = 0
    while n_open:
        depth += 1
        hop = hops.toDF("at", "next")
        ahead = waves.select(F.col("n").alias("next"), "word", "bits", (F.col("depth") + 1).alias("left"))
        walk, n_open = write_counted(
            walk.where("left > 0").join(hop, "at").join(ahead, ["next", "word", "left"])
            .where(F.col("bits").bitwiseAND(_bit(F.col("seed"))) != 0)
            .groupBy("a", "b", "seed", "word", "length", "left").agg(F.min("next").alias("at"))
            .select("a", "b", "seed", "word", "at", (F.col("left") - 1).alias("left"), "length"),
            F.count_if(F.col("left") > 0),
        )
        steps.add(walk.select("a", "b", "length", F.lit(depth).alias("pos"), "at"))
    named = _named(steps.table, nodes, "at", "a", "b").select(
        "project_id", F.col("a").alias("source"), F.col("b").alias("target"), "length", "pos", "id"
    )
    paths = named.groupBy(*pair, "length").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("steps"))
    return paths.select(*pair, F.col("steps.id").alias("path"), "length")
