"""Graph operators over edges (src, dst, kind, conf): filters, bounded traversal, expansion, impact, closure, waves, name lookup."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators.common import checkpoint_dir, cut_lineage, sent, stored, top

# Confidences in order, and the weights of paths whose weakest edge has them.
CONFIDENCES = ("exact", "heuristic", "ambiguous")
CONF_WEIGHT = {"exact": 1.0, "heuristic": 0.6, "ambiguous": 0.3}


def conf_rank(conf: Column) -> Column:
    return F.array_position(F.array(*(F.lit(c) for c in CONFIDENCES)), conf).cast("int") - 1


def conf_name(rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(c) for c in CONFIDENCES)), rank + 1)


def edge_filter(edges: DataFrame, kinds: tuple[str, ...] | None = None, worst: str = "ambiguous") -> DataFrame:
    """Edges of the kinds given that are at least as certain as `worst`."""
    kept = edges.where(conf_rank(F.col("conf")) <= CONFIDENCES.index(worst))
    return kept.where(F.col("kind").isin(*kinds)) if kinds else kept


def best_edges(edges: DataFrame) -> DataFrame:
    """One edge for each src, dst and kind: the most certain."""
    return edges.groupBy("src", "dst", "kind").agg(F.min(conf_rank(F.col("conf"))).alias("r")).select("src", "dst", "kind", conf_name(F.col("r")).alias("conf"))


def edge_stats(edges: DataFrame, unresolved: DataFrame | None = None) -> DataFrame:
    """(kind, conf, n); with `unresolved`, the calls without a target, a row more that counts them: (calls, unresolved, n)."""
    stats = edges.groupBy("kind", "conf").agg(F.count("*").alias("n"))
    return stats if unresolved is None else stats.unionByName(unresolved.agg(F.lit("calls").alias("kind"), F.lit("unresolved").alias("conf"), F.count("*").alias("n")))


def callers(edges: DataFrame, worst: str = "ambiguous") -> DataFrame:
    """(symbol, caller) over calls."""
    return edge_filter(edges, ("calls",), worst).select(F.col("dst").alias("symbol"), F.col("src").alias("caller")).distinct()


def callees(edges: DataFrame, worst: str = "ambiguous") -> DataFrame:
    """(symbol, callee) over calls."""
    return edge_filter(edges, ("calls",), worst).select(F.col("src").alias("symbol"), F.col("dst").alias("callee")).distinct()


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    """(at, to, r) in the direction out, in or both; the most certain edge of each pair."""
    out = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), conf_rank(F.col("conf")).alias("r"))
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), conf_rank(F.col("conf")).alias("r"))
    both = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return both.groupBy("at", "to").agg(F.min("r").alias("r"))


def reach(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "out") -> DataFrame:
    """(seed, node, hop, r) within `hops` of each seed, itself at 0: the fewest hops, and the best weakest rank among the shortest paths.

    Each hop joins the frontier, not all that was reached, to the edges, keeps one row for each seed and node, and drops the visited.
    Frontiers are checkpointed, so the plan does not grow; a cycle ends where nothing is new.
    """
    steps = _steps(edges, direction)
    frontier = seeds.select(F.col("seed"), F.col("seed").alias("node"), F.lit(0).alias("hop"), F.lit(0).alias("r")).distinct()
    seen = frontier
    for hop in range(1, hops + 1):
        after = frontier.join(steps, frontier["node"] == steps["at"]).select("seed", F.col("to").alias("node"), F.lit(hop).alias("hop"), F.greatest(frontier["r"], steps["r"]).alias("r"))
        after = after.groupBy("seed", "node", "hop").agg(F.min("r").alias("r")).join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        frontier = cut_lineage(after)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def neighbors(edges: DataFrame, seeds: DataFrame, hops: int = 2, kinds: tuple[str, ...] | None = None, direction: str = "out", worst: str = "ambiguous") -> DataFrame:
    """(seed, node, hop): the nodes within `hops`, seeds themselves left out."""
    return reach(edge_filter(edges, kinds, worst), seeds, hops, direction).where("hop > 0").select("seed", "node", "hop")


@dataclass(frozen=True)
class ExpandConfig:
    hops: int = 2
    decay: float = 0.5
    direction: str = "both"
    kinds: tuple[str, ...] = ("calls", "inherits")
    worst: str = "heuristic"
    max_nodes: int = 20
    include_overrides: bool = False
    conf_weight: dict = field(default_factory=lambda: dict(CONF_WEIGHT))


def expand(edges: DataFrame, seeds: DataFrame, config: ExpandConfig = ExpandConfig(), by: str | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """(by, node, score): what is reached from seeds (by, seed, score), seeds of the group left out.

    score = seed score * decay^hop * weight of the weakest edge, the best over seeds. With include_overrides, methods of
    the same name on subclasses of a reached or seed method's class (symbols: qualname, kind, parent) take its score.
    """
    given = seeds if by else seeds.withColumn("__by", F.lit(0))
    key = by or "__by"
    found = reach(edge_filter(edges, config.kinds, config.worst), given.select("seed").distinct(), config.hops, config.direction)
    weight = F.element_at(F.create_map(*(x for k, v in config.conf_weight.items() for x in (F.lit(k), F.lit(v)))), conf_name(F.col("r")))
    scored = given.join(found, "seed").withColumn("s", F.col("score") * F.pow(F.lit(config.decay), F.col("hop")) * weight)
    best = scored.where("hop > 0").groupBy(key, "node").agg(F.max("s").alias("score"))
    own = given.select(key, F.col("seed").alias("node")).distinct()
    if config.include_overrides and symbols is not None:
        every = best.unionByName(given.groupBy(key, F.col("seed").alias("node")).agg(F.max("score").alias("score")))
        over = every.join(overrides(every, symbols, ancestors(classes_of(symbols), edges)), "node").groupBy(key, F.col("override").alias("node")).agg(F.max("score").alias("score"))
        best = best.unionByName(over.join(best.select(key, "node"), [key, "node"], "left_anti"))
    out = best.join(own, [key, "node"], "left_anti")
    return out if by else out.drop("__by")


def chunk_evidence(scored: DataFrame, node_chunks: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The k best chunks of scored (by, node, score) through node_chunks (node, chunk_id): score desc, node, chunk."""
    best = scored.join(node_chunks, "node").groupBy(*by, "chunk_id").agg(F.max_by(F.struct("score", "node"), F.struct(F.col("score"), F.col("node"))).alias("x"))
    flat = best.select(*by, "chunk_id", "x.node", F.round("x.score", 6).alias("score"))
    return top(flat, k, by, F.col("score").desc(), F.col("node"), F.col("chunk_id"))


def impact(edges: DataFrame, seeds: DataFrame, hops: int = 2, worst: str = "ambiguous") -> DataFrame:
    """(seed, symbol, hop): callers up to `hops` away, the seed itself at 0."""
    return reach(edge_filter(edges, ("calls",), worst), seeds, hops, "in").select("seed", F.col("node").alias("symbol"), "hop")


def impacted_tests(impacted: DataFrame, coverage: DataFrame, by: list[str]) -> DataFrame:
    """Distinct tests of the impacted symbols, through coverage (symbol, test)."""
    return impacted.join(coverage, "symbol").select(*by, "test").distinct()


def descendants(edges: DataFrame, kind: str = "inherits", most: int | None = None) -> DataFrame:
    """(ancestor, node_below): the transitive closure of src -> dst edges of a kind, from dst down to src.

    Closed by squaring: each round doubles the length of the paths that are known, so the rounds grow as the logarithm of the longest
    shortest path. Goes on until nothing is new. With `most`, nodes that lie more steps below raise UnfinishedError.
    """
    far = cut_lineage(edges.where(F.col("kind") == kind).select(F.col("dst").alias("ancestor"), F.col("src").alias("node_below")).distinct())
    found = far.withColumn("depth", F.lit(1))
    for k in count():
        # far: pairs exactly 2^k apart; found: pairs less than 2^(k+1) apart, each with the fewest steps between them.
        ends = far.select(F.col("ancestor").alias("node_below"), F.col("node_below").alias("next"))
        twice = far.join(ends, "node_below").select("ancestor", F.col("next").alias("node_below")).distinct()
        far = cut_lineage(twice.join(found, ["ancestor", "node_below"], "left_anti"))
        if far.isEmpty():
            break
        if most is not None and 2 << k > most:
            raise UnfinishedError(f"nodes lie more than {most} steps below")
        step = found.select(F.col("ancestor").alias("node_below"), F.col("node_below").alias("next"), "depth")
        beyond = far.join(step, "node_below").select("ancestor", F.col("next").alias("node_below"), (F.col("depth") + (2 << k)).alias("depth"))
        new = far.withColumn("depth", F.lit(2 << k)).unionByName(beyond).groupBy("ancestor", "node_below").agg(F.min("depth").alias("depth"))
        found = cut_lineage(found.unionByName(new.join(found, ["ancestor", "node_below"], "left_anti")))
    if most is not None and not found.where(F.col("depth") > most).isEmpty():
        raise UnfinishedError(f"nodes lie more than {most} steps below")
    return found.select("ancestor", "node_below")


#: Rounds of ancestors() after which its steps become twice as long.
ROUNDS = 32


def ancestors(asked: DataFrame, edges: DataFrame, kind: str = "inherits") -> DataFrame:
    """(ancestor, node_below): those pairs of descendants() whose node_below is asked (node).

    Each round goes one step on from the pairs that were new in the last, so a pair is met once for each step that leads to it, and only
    pairs of asked nodes are held. They lie in a table bucketed by both columns, where new pairs meet them without a shuffle. After every
    ROUNDS rounds steps become twice as long, so the rounds grow as the logarithm of the longest shortest path where that is long.
    """
    spark, pair = edges.sparkSession, ["node_below", "ancestor"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def bucketed(df: DataFrame, name: str, *by: str, mode: str = "error", **options) -> DataFrame:
        df.write.mode(mode).bucketBy(n, *by).options(**options).saveAsTable(name)
        return spark.table(name)

    def steps(df: DataFrame) -> DataFrame:
        name = f"steps_{uuid.uuid4().hex}"
        return bucketed(df.repartition(n, "ancestor"), name, "ancestor", path=f"{checkpoint_dir(spark)}/{name}")

    name = f"pairs_{uuid.uuid4().hex}"
    step = steps(edges.where(F.col("kind") == kind).select(F.col("src").alias("ancestor"), F.col("dst").alias("next")).distinct())
    first = step.join(asked.select(F.col("node").alias("ancestor")).distinct(), "ancestor", "left_semi").select(F.col("ancestor").alias("node_below"), F.col("next").alias("ancestor"))
    found = bucketed(first.repartition(n, *pair).withColumn("round", F.lit(0)), name, *pair, path=f"{checkpoint_dir(spark)}/{name}")
    for k in count(1):
        last = found.where(F.col("round") == k - 1)
        if last.isEmpty():
            return found.select("ancestor", "node_below")
        if k % ROUNDS == 0:
            ahead = step.select(F.col("ancestor").alias("next"), F.col("next").alias("then"))
            step = steps(step.unionByName(step.join(ahead, "next").select("ancestor", F.col("then").alias("next"))).distinct())
        new = last.select(*pair).join(step, "ancestor").select("node_below", F.col("next").alias("ancestor")).distinct().join(found.select(*pair), pair, "left_anti")
        found = bucketed(new.withColumn("round", F.lit(k)), name, *pair, mode="append")


def inherited(asked: DataFrame, bases: DataFrame, members: DataFrame) -> DataFrame:
    """(cls, name, owner): which class an asked member (cls, name) comes from: the class itself or the first, depth first, of its bases.

    bases: (cls, pos, base); members: (owner, name). Questions share what they ask of their bases: each (class, name) that is asked on
    the way is one node, and so cycles end and diamonds cost no more than their classes. Nodes above which nobody has the member are
    dropped. A depth-first search goes from a node to the first base that is left; where these steps end at an owner it is found, and
    pointers along them double each round. What is left are nodes whose first steps lead into a cycle, where the way out depends on
    where the search began: these have the owner of the first walked node that their steps lead to, as _around() says.
    """
    question = ["cls", "name"]
    up = lambda df: df.select(F.col("cls").alias("base"), "name", *(c for c in df.columns if c not in question))
    step = stored(bases.select("cls", F.col("pos").cast("int").alias("pos"), "base").distinct())
    nodes = frontier = first_asked = stored(asked.select(*question).distinct())
    holds = stored(members.select(F.col("owner").alias("cls"), "name").join(sent(nodes.select("name").distinct()), "name", "left_semi").select(*question).distinct())
    edges = step.join(nodes.select("name").limit(0), F.lit(True)).select(*question, "pos", "base")
    for k in count(1):
        ways = stored(frontier.join(holds, question, "left_anti").join(step, "cls").select(*question, "pos", "base"))
        edges = edges.unionByName(ways)
        frontier = stored(ways.select(F.col("base").alias("cls"), "name").distinct().join(nodes, question, "left_anti"))
        if frontier.isEmpty():
            break
        nodes = nodes.unionByName(frontier)
        if k % 8 == 0:
            nodes, edges = stored(nodes), stored(edges)
    edges = stored(edges)
    live = frontier = stored(nodes.join(holds, question, "left_semi"))
    for k in count(1):
        frontier = stored(edges.join(up(frontier), ["base", "name"], "left_semi").select(*question).distinct().join(live, question, "left_anti"))
        if frontier.isEmpty():
            break
        live = live.unionByName(frontier)
        if k % 8 == 0:
            live = stored(live)
    ways = stored(edges.join(up(live), ["base", "name"], "left_semi"))
    first = stored(ways.groupBy(*question).agg(F.min_by("base", "pos").alias("to")))
    known, left = _followed(first, nodes.join(holds, question, "left_semi").select(*question, F.col("cls").alias("owner")))
    owned = known if left.isEmpty() else known.unionByName(_around(first, left, ways, known))
    return owned.join(first_asked, question, "left_semi").select(*question, "owner")


def _followed(first: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ends (cls, name, owner) and the nodes whose steps first (cls, name, to) lead to one, with its owner; and the other nodes, each with a node of the cycle that it leads into.

    Pointers double each round. Where no owner is found any more, the nodes that pointers lead to become fewer until they are those on
    cycles, each of which is led to by one of its own cycle.
    """
    known, left, before = ends, first, None
    none = F.lit(None).cast("string")
    while True:
        ahead = known.select(F.col("cls").alias("to"), "name", "owner", none.alias("next")).unionByName(left.select(F.col("cls").alias("to"), "name", none.alias("owner"), F.col("to").alias("next")))
        moved = stored(left.join(ahead, ["to", "name"]).select("cls", "name", "owner", "next"))
        left, found = moved.where("owner is null").select("cls", "name", F.col("next").alias("to")), moved.where("owner is not null")
        if found.isEmpty():
            now = left.select("to", "name").distinct().count()
            if now in (0, before):
                return stored(known), left
            before = now
        known = known.unionByName(found.select("cls", "name", "owner"))


def _around(first: DataFrame, left: DataFrame, ways: DataFrame, known: DataFrame) -> DataFrame:
    """(cls, name, owner) of the nodes left (cls, name, to), whose first steps lead into cycles.

    The nodes on cycles are walked. A search from any other first takes the steps to a walked node, and then goes on as that one's search
    does, unless the walked node's way to its owner leads over one of the steps taken. A node on that way is walked too, and those
    whose steps lead to it first ask it instead, until no way leads over a step taken.
    """
    question = ["cls", "name"]
    todo, walks = stored(left.select(F.col("to").alias("cls"), "name").distinct()), None
    tails = first.join(left.select(*question), question, "left_semi")
    while True:
        new = stored(_walks(todo, ways, known))
        walks = new if walks is None else walks.unionByName(new)
        at, _ = _followed(stored(tails.join(walks, question, "left_anti")), walks.select(*question, F.col("cls").alias("owner")))
        over = walks.select(F.col("cls").alias("owner"), "name", F.explode("via").alias("cls")).where("cls <> owner")
        todo = stored(at.where("cls <> owner").join(over, [*question, "owner"], "left_semi").select(*question))
        if todo.isEmpty():
            return at.withColumnRenamed("owner", "to").join(walks.select(F.col("cls").alias("to"), "name", "owner"), ["to", "name"]).select(*question, "owner")


def _walks(asked: DataFrame, ways: DataFrame, known: DataFrame) -> DataFrame:
    """(cls, name, owner, via) of asked (cls, name): the owner of the known (cls, name, owner) node that a depth-first search over ways (cls, name, pos, base) meets first, and the classes on the way to it.

    A walk's place in depth-first order is its route, the array of positions taken, and routes compare as arrays. All walks go one
    step a round; each class is kept once for each question, by its first route, a walk ends at a known node, and others end that lie
    behind it. A known node's own search never meets the walk, or it would itself not be known.
    """
    question = ["cls", "name"]
    held = known.select(F.col("cls").alias("base"), "name", "owner")
    step = stored(ways.join(known, question, "left_anti").join(held, ["base", "name"], "left").select(F.col("cls").alias("at"), "name", "pos", "base", "owner"))
    none = F.lit(None).cast("string").alias("owner")
    seen = frontier = stored(asked.select(*question, F.col("cls").alias("at"), none, F.array().cast("array<int>").alias("route"), F.array().cast("array<string>").alias("via")))
    found = frontier.select(*question, F.struct("route", "owner", "via").alias("hit")).limit(0)
    while True:
        on = frontier.where("owner is null").drop("owner").join(found, question, "left").where("hit is null or route < hit.route")
        after = on.join(step, ["at", "name"]).groupBy(*question, F.col("base").alias("at"), "owner").agg(F.min(F.struct(F.concat("route", F.array("pos")).alias("route"), F.concat("via", F.array("at")).alias("via"))).alias("x"))
        old = seen.select(*question, "at", F.col("route").alias("old"))
        frontier = stored(after.select(*question, "at", "owner", "x.*").join(old, [*question, "at"], "left").where("old is null or route < old").drop("old"))
        if frontier.isEmpty():
            return found.select(*question, "hit.owner", "hit.via")
        found = stored(found.unionByName(frontier.where("owner is not null").select(*question, F.struct("route", "owner", "via").alias("hit"))).groupBy(*question).agg(F.min("hit").alias("hit")))
        seen = stored(seen.unionByName(frontier).groupBy(*question, "at").agg(F.min(F.struct("route", "owner", "via")).alias("x")).select(*question, "at", "x.owner", "x.route", "x.via"))


def classes_of(symbols: DataFrame) -> DataFrame:
    """(node): what symbols (qualname) stand in, the only classes where overrides() may find one."""
    return symbols.where(F.contains("qualname", F.lit("."))).select(F.regexp_replace("qualname", r"\.[^.]*$", "").alias("node")).distinct()


def overrides(asked: DataFrame, symbols: DataFrame, below: DataFrame) -> DataFrame:
    """(node, override): asked methods (node) and the methods of the same name on classes below theirs.

    symbols: (qualname, kind, parent); below: (ancestor, node_below), as descendants() gives them, or ancestors() of
    classes_of(symbols).
    """
    method = symbols.where("kind = 'method'").select(F.col("qualname").alias("node"), F.col("parent").alias("ancestor"), F.element_at(F.split("qualname", r"\."), -1).alias("name"))
    there = symbols.select(F.col("qualname").alias("override")).distinct()
    return asked.select("node").distinct().join(method, "node").join(below, "ancestor").select("node", F.concat_ws(".", "node_below", "name").alias("override")).join(there, "override").distinct().select("node", "override")


class CycleError(ValueError):
    """A dependency graph has a cycle."""


class UnfinishedError(RuntimeError):
    """A bound on the number of steps was reached with work left."""


#: Slots by which the edges of topological_waves() are stored.
SLOTS = 64


def topological_waves(nodes: DataFrame, depends: DataFrame, most: int | None = None) -> DataFrame:
    """(node, wave): the first wave (1) has no known dependency, every other comes one wave after its last.

    depends: (node, on); unknown ones are ignored. Each node counts its open dependencies; a wave lowers the counts of those that
    depend on it, and only they are looked at for the next. Edges are stored by slots of the node that they lead to, and a wave reads
    only the slots of its own nodes. A cycle raises CycleError. With `most`, nodes left after so many waves raise UnfinishedError.
    """
    spark = nodes.sparkSession
    every = cut_lineage(nodes.select("node").distinct())
    known = depends.select("node", "on").join(every, "node", "left_semi").join(every.select(F.col("node").alias("on")), "on", "left_semi").select("node", "on").distinct()
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int").alias("slot")
    place = f"{checkpoint_dir(spark)}/waves-{uuid.uuid4().hex}"
    known.withColumn("slot", slot("on")).repartition("slot").write.partitionBy("slot").parquet(place)
    edges = spark.read.schema(known.schema.add("slot", T.IntegerType())).parquet(place)
    now = cut_lineage(every.join(edges.select("node").distinct(), "node", "left_anti"))
    left, waves = edges.groupBy("node").agg(F.count("*").alias("open")), []
    for wave in count(1):
        here = now.count()
        if not here:
            break
        if most is not None and wave > most:
            raise UnfinishedError(f"nodes are left after {most} waves")
        waves.append(now.withColumn("wave", F.lit(wave)))
        slots = [r["slot"] for r in now.select(slot("node")).distinct().collect()]  # SLOTS of them at most
        fewer = edges.where(F.col("slot").isin(slots)).join(now.select(F.col("node").alias("on")), "on", "left_semi").groupBy("node").agg(F.count("*").alias("less"))
        lowered = cut_lineage(fewer.join(left, "node").select("node", (F.col("open") - F.col("less")).alias("open")))
        now = cut_lineage(lowered.where("open = 0").select("node"))
        still = lowered.where("open > 0")
        left = left.join(lowered.select("node"), "node", "left_anti").unionByName(still)
        if wave % 8 == 0:  # the counts are brought up to date; in between, what was lowered is set aside
            left = cut_lineage(left)
    done = cut_lineage(reduce(DataFrame.unionByName, waves)) if waves else every.select("node", F.lit(0).alias("wave")).limit(0)
    if done.count() < every.count():
        raise CycleError("the dependencies have a cycle")
    return done


def suffix_index(modules: DataFrame) -> DataFrame:
    """(suffix, module) of dotted module names: every exact name, and each proper suffix that only one module has; else module is null."""
    parts = F.split("module", r"\.")
    cut = lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("suffix"), F.when(i > 1, F.array_join(F.slice(parts, F.lit(1), i - 1), ".")).alias("ahead"))
    each = modules.select(F.inline(F.transform(F.sequence(F.lit(1), F.size(parts)), cut)))
    found = each.groupBy("suffix").agg(F.max(F.col("ahead").isNull()).alias("exact"), F.min("ahead").alias("low"), F.max("ahead").alias("high"))
    return found.select("suffix", F.when(F.col("exact"), F.col("suffix")).when(F.col("low") == F.col("high"), F.concat("low", F.lit("."), "suffix")).alias("module"))


def lookup(names: DataFrame, qualnames: DataFrame) -> DataFrame:
    """(name, qualname) where the qualified name is the name or ends in `.name`, by an equi-join on dotted suffixes."""
    parts = F.split("qualname", r"\.")
    suffixes = qualnames.select("qualname", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("name"))
    return names.select("name").distinct().join(suffixes, "name").distinct()


def enclosing(names: DataFrame, owners: DataFrame) -> DataFrame:
    """(qualname, owner): the longest proper dotted prefix of each name that is in owners (owner)."""
    parts = F.split("qualname", r"\.")
    prefixes = names.where(F.size(parts) > 1).select("qualname", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("n"))
    prefixes = prefixes.withColumn("owner", F.array_join(F.slice(parts, F.lit(1), F.col("n")), "."))
    return prefixes.join(owners.select("owner").distinct(), "owner").groupBy("qualname").agg(F.max_by("owner", "n").alias("owner"))


def heuristic_match(calls: DataFrame, methods: DataFrame, max_ambiguity: int = 4, keep: list[str] | None = None) -> DataFrame:
    """(src, keep, dst, conf): calls (src, method) to every method (qualname, method) of the name, if there are at most max_ambiguity."""
    few = methods.groupBy("method").agg(F.count("*").alias("n")).where(F.col("n") <= max_ambiguity)
    return calls.join(few, "method").join(methods, "method").select("src", *(keep or []), F.col("qualname").alias("dst"), F.when(F.col("n") == 1, "heuristic").otherwise("ambiguous").alias("conf"))
