"""Near-duplicate documents by a grouped prefix join on word shingles.

Two documents link when the Jaccard similarity of their sets of shingles is at least `percent`/100, and the result is the connected
components of all links. Sets are of 64-bit hashes; a document's node is a 64-bit hash of its whole set, so exact copies are
one node from the start.

1. A fixed-size table counts, over all documents, how many shingles fall into each of 2^20 slots. Ordering a set by (slot count,
   hash) puts rare shingles first, and linked sets share a shingle within their prefixes under any common order.
2. Documents with the same prefix and size form one group. Prefix shingles, with node and group, are sorted by shingle; those of
   a single node, which are most, are dropped there. Copies collapse in each task before the shuffle and again here.
3. First rounds: per shingle a node is paired with the nodes that have the shingle earliest, and with the one before it, members of a
   group being neighbours: as many pairs as rows, however many nodes share a shingle, of which each node tries those seen most.
   Pairs that may link by size and by the shingle's places are verified on the texts, and components are formed. This goes on, for
   as many turns as TRIES has, while links are found and pairing all that is left would take more than twice the rows there are.
4. Last round, for the rest: per shingle, groups that lie in different components are paired, filtered by size and by how much
   overlap the shingle's places in both prefixes still allow; the pairs left are expanded to their members and verified. Linkable
   documents pass at their first common shingle, so none escape: they are either verified or already in one component. The
   smaller set's place must be in the first seventh (at 75 %) of its set, so shingles that are common, and so come late in
   most prefixes, pair hardly any rows.

So a group of thousands of near copies costs rows in proportion to its size, not to its square, and no list of a shingle's
or a component's documents is ever gathered.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. With fewer words than a shingle has the whole text is one shingle; without words
(or null) the set is empty and linked with nothing: its component is the document's own id. Repeated rows are exact copies. A row
with a null id links as any other, only its id is no candidate for the smallest: a component's id is null where all its rows lack
one. Long texts are used whole; an empty table gives no rows; columns besides the two named aren't read.

A set's name is a 64-bit hash; a second one shows where several sets have the same name, and those are named by it instead.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.common import cut, each, map_arrow, materialise, may_hold, membership, release, worker_cache
from cairn.llm.components import connected

SLOT_BITS, CHUNKS, GROUP_BITS = 20, 256, 24
KEPT_WORDS, KEPT_NODES = 200_000, 200_000
#: Bytes of text that a worker turns into sets at once.
AT_ONCE = 1_000_000
#: Partners that a node tries in each turn of the early rounds; earliest nodes of a shingle that a turn looks at.
TRIES, HUBS = (2, 8, 32), 3
#: Nodes whose 64-bit names collide that are told to the workers; with more the names are not good enough.
COLLISIONS = 10_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    get = worker_cache(("words",), WordHashes).__getitem__
    words = [np.array([get(w) for w in t.lower().split()], np.uint64) if t else np.zeros(0, np.uint64) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(flat) - size + 1), np.uint64)
    for k in range(size):
        rolled = rolled * _BASE + flat[k : k + len(rolled)]
    rolled = _mixed(rolled)
    first = np.cumsum(n) - n
    out = []
    for w, at, m in zip(words, first.tolist(), n.tolist(), strict=True):
        if m >= size:
            out.append(np.unique(rolled[at : at + m - size + 1]))
        elif m:
            h = np.full(1, m, np.uint64)
            for k in range(m):
                h = h * _BASE + w[k : k + 1]
            out.append(_mixed(h))
        else:
            out.append(w)
    return out


def _names(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set."""
    h = xxhash.xxh3_128_intdigest(s.tobytes(), len(s))
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def _node(s: np.ndarray, collided: frozenset[int]) -> int:
    """A set's name: its first hash, or the second where several sets have the first."""
    first, second = _names(s)
    return second if first in collided else first


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _at(id_col: str, text_col: str) -> Column:
    """What rows are found by, null ids too: two hashes of id and text."""
    key = [F.col(id_col).isNull(), F.col(id_col), F.col(text_col)]
    return F.struct(F.xxhash64(*key).alias("x"), F.xxhash64(*key[::-1]).alias("y"))


def describe(df: DataFrame, id_col: str, text_col: str, size: int) -> tuple[DataFrame, np.ndarray, frozenset[int]]:
    """(id, at, n, node) of every row, node null for empty sets; the shingle count of each slot over all rows; and the first hashes that several sets have."""
    kind = df.schema[id_col].dataType.simpleString()
    width = (1 << SLOT_BITS) // CHUNKS

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        count = np.zeros(1 << SLOT_BITS, np.int64)
        for b in batches:
            n, names = [], []
            for some in cut(b["text"], AT_ONCE):
                for s in shingle_sets(some, size):
                    count[_slots(s)] += 1  # a set that has two shingles in a slot counts once
                    n.append(len(s))
                    names.append(_names(s) if len(s) else (None, None))
            none = [None] * len(n)
            yield {"id": b["id"], "at": b["at"], "n": n, "node": [x for x, _ in names], "other": [y for _, y in names], "chunk": none, "counts": none}
        parts = count.reshape(CHUNKS, width)
        used = np.flatnonzero(parts.any(1)).tolist()
        none = [None] * len(used)
        yield {"id": none, "at": none, "n": none, "node": none, "other": none, "chunk": used, "counts": [zlib.compress(parts[k].tobytes(), 1) for k in used]}

    def fold(batches: Iterator[dict]) -> Iterator[dict]:
        total: dict[int, np.ndarray] = {}  # at most CHUNKS arrays, however many rows
        for b in batches:
            for k, c in zip(b["chunk"].to_pylist(), b["counts"].to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(zlib.decompress(c), np.int64)
        yield {"chunk": list(total), "counts": [c.tobytes() for c in total.values()]}

    read = df.select(F.col(id_col).alias("id"), _at(id_col, text_col).alias("at"), F.col(text_col).alias("text"))
    rows = materialise(map_arrow(read, run, f"id {kind}, at struct<x:bigint,y:bigint>, n long, node long, other long, chunk int, counts binary"))
    partial = rows.where("chunk is not null").select("chunk", "counts")
    slots = np.zeros((CHUNKS, width), np.int64)
    for r in map_arrow(partial.repartition(16, "chunk"), fold, "chunk int, counts binary").collect():  # CHUNKS rows of fixed size
        slots[r.chunk] = np.frombuffer(r.counts, np.int64)
    rows = rows.where("chunk is null")
    twice = rows.where("node is not null").groupBy("node").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high").select("node")
    collided = frozenset(r.node for r in twice.limit(COLLISIONS + 1).collect())  # chance alone makes n * n / 2^65 of them
    if len(collided) > COLLISIONS:
        raise RuntimeError("too many sets share a 64-bit hash")
    named = F.when(F.col("node").isin(*collided), F.col("other")).otherwise(F.col("node")) if collided else F.col("node")
    return rows.select("id", "at", "n", named.alias("node")), slots.ravel(), collided


def prefix_rows(df: DataFrame, slots: np.ndarray, collided: frozenset[int], text_col: str, size: int, percent: int) -> DataFrame:
    """(token, node, tag, pos) for each prefix shingle of each set, pos being its place; tag is the set's size times 2^GROUP_BITS plus a hash of its prefix.

    Prefixes whose hashes are equal by chance only widen a group, whose members are verified one by one.
    """
    shared = df.sparkSession.sparkContext.broadcast(slots)  # 2^SLOT_BITS numbers

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        count = shared.value
        seen: set[int] = set()  # nodes that this task has sent; forgetting some only sends them again
        for b in batches:
            for some in cut(b["text"], AT_ONCE):
                prefixes, nodes, tags = [np.zeros(0, np.int64)], [], []
                for s in shingle_sets(some, size):
                    n = len(s)
                    if not n or (node := _node(s, collided)) in seen:
                        continue
                    if len(seen) >= KEPT_NODES:
                        seen.clear()
                    seen.add(node)
                    prefix = s[np.argsort(count[_slots(s)], kind="stable")[: n - -(-percent * n // 100) + 1]]  # s is sorted: ties by hash
                    prefixes.append(prefix.view(np.int64))
                    nodes.append(node)
                    tags.append((n << GROUP_BITS) + (xxhash.xxh64_intdigest(prefix.tobytes()) >> (64 - GROUP_BITS)))
                length = [len(x) for x in prefixes[1:]]
                yield {"token": np.concatenate(prefixes), "node": np.repeat(np.array(nodes, np.int64), length), "tag": np.repeat(np.array(tags, np.int64), length), "pos": np.concatenate([np.arange(k, dtype=np.int32) for k in (0, *length)])}

    return map_arrow(df.selectExpr(f"`{text_col}` text"), run, "token long, node long, tag long, pos int")


def verified(pairs: DataFrame, nodes: DataFrame, collided: frozenset[int], df: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of nodes, a checkpointed table, whose sets are similar enough, as edges (u, v), by their whole texts.

    A node's text is that of one row, found by its hashes. A filter of fixed size (common.membership) leaves out most texts that no
    pair asks for; the others are shuffled once, repeated rows falling together, and serve both sides.
    """
    place = lambda side: [f"{side}_x", f"{side}_y"]
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("rep.x").alias(f"{side}_x"), F.col("rep.y").alias(f"{side}_y")), side)
    pairs = materialise(pairs)
    bits = membership(pairs.select(F.explode(F.array("a_x", "b_x")).alias("x")), "x")
    at = _at(id_col, text_col)
    read = df.select(at.getField("x").alias("x"), at.getField("y").alias("y"), F.col(text_col).alias("text"))
    texts = read.where(F.col("text").isNotNull() & may_hold(F.col("x"), bits)).dropDuplicates(["x", "y"])
    release(df.sparkSession)
    left = pairs.join(texts.toDF(*place("a"), "text_a"), place("a"))
    both = left.join(texts.toDF(*place("b"), "text_b"), place("b")).select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            u, v = [], []
            for x, y, s, t in zip(b["a"].to_pylist(), b["b"].to_pylist(), each(b["text_a"]), each(b["text_b"]), strict=True):
                s, t = shingle_sets([s, t], size)
                if _node(s, collided) != x or _node(t, collided) != y:
                    raise RuntimeError("a text is not the one that was read before")
                common = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * common >= percent * (len(s) + len(t) - common):
                    u.append(x)
                    v.append(y)
            yield {"u": u, "v": v}

    return map_arrow(both, run, "u long, v long")


def _size(tag: str) -> Column:
    return F.shiftright(tag, GROUP_BITS)


def _may_link(a: str, a_pos: str, b: str, b_pos: str, percent: int) -> Column:
    """Whether sets of two tags whose first common shingle has these places may be similar enough."""
    n, m = _size(a), _size(b)
    sized = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return sized & ((100 + percent) * F.least(n - F.col(a_pos), m - F.col(b_pos)) >= percent * (n + m))


def _early(tag: str, pos: str, percent: int) -> Column:
    """Whether a place is early enough to be that of the smaller of two linked sets."""
    return (100 + percent) * (_size(tag) - F.col(pos)) >= 2 * percent * _size(tag)


def _with(rows: DataFrame, others: list[str], percent: int) -> DataFrame:
    """(node, a, b, seen): rows paired with each of the struct columns `others` (node, tag, pos, comp) that may link, and in how many shingles."""
    pairs = rows.select("node", "tag", "pos", "comp", F.explode(F.array(*others)).alias("o")).where("o is not null and o.comp <> comp")
    pairs = pairs.select("node", "tag", "pos", F.col("o.node").alias("b"), F.col("o.tag").alias("b_tag"), F.col("o.pos").alias("b_pos")).where(_may_link("tag", "pos", "b_tag", "b_pos", percent))
    return pairs.groupBy("node", F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).agg(F.count("*").alias("seen"))


def _few(pairs: DataFrame, most: int) -> DataFrame:
    """Distinct pairs (a, b): of each node those seen in most shingles."""
    best = Window.partitionBy("node").orderBy(F.desc("seen"), "a", "b")
    return pairs.withColumn("k", F.row_number().over(best)).where(F.col("k") <= most).select("a", "b").distinct()


def hub_pairs(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of nodes in different components: with a shingle's HUBS nodes that have it earliest, at first also with the node before.

    Where many near copies share a shingle, those with the fewest changes have it earliest and link with most others. Each turn
    looks at the next HUBS and keeps TRIES partners of a node at most; what no turn tries is left to the last round.
    """
    order = Window.partitionBy("token").orderBy("pos", "tag", "node")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = F.struct("node", "tag", "pos", "comp")
    names = [f"h{k}" for k in range(turn * HUBS + 1, (turn + 1) * HUBS + 1)]
    seen = rows.select("*", *(F.nth_value(one, int(n[1:])).over(upto).alias(n) for n in names), F.lag(one).over(order).alias("before"))
    return _few(_with(seen, names if turn else ["before", *names], percent), TRIES[turn])


def mixed_rows(live: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """(token, node, tag, pos, comp) of the shingles that lie in several components, one of them early."""
    tested = live.withColumn("met", may_hold(F.col("node"), membership(comp, "node")))  # only nodes that may have a component are shuffled to it
    met = tested.where("met").drop("met").join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    rows = met.unionByName(tested.where("not met").drop("met").withColumn("comp", F.col("node")))
    mixed = rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.bool_or(_early("tag", "pos", percent)).alias("early")).where("low < high and early").select("token")
    return materialise(rows.join(mixed, "token"))


def work(rows: DataFrame, percent: int) -> tuple[int, int]:
    """How many pairs of components the last round would meet, and the number of rows."""
    per = rows.groupBy("token", "comp").agg(F.count("*").alias("n"), F.max(_early("tag", "pos", percent).cast("long")).alias("early"))
    per = per.groupBy("token").agg((F.sum("early") * F.count("*")).alias("pairs"), F.sum("n").alias("n"))
    got = per.agg(F.sum("pairs"), F.sum("n")).first()
    return int(got[0] or 0), int(got[1] or 0)


def rest_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of nodes in different components that may still link, of mixed_rows."""
    group = rows.select("token", "tag", "pos", "comp").distinct()  # a group's members in one component
    early = group.where(_early("tag", "pos", percent)).select("token", *(F.col(c).alias(f"{c}1") for c in ("tag", "pos", "comp")))
    other = group.select("token", *(F.col(c).alias(f"{c}2") for c in ("tag", "pos", "comp")))
    # Components first, then the rows of both sides, so rows of one component never meet. A component's sizes and first place already
    # rule out most partners.
    n1, n2 = _size("tag1"), _size("tag2")
    span2 = other.groupBy("token", "comp2").agg(F.min(n2).alias("low2"), F.max(n2).alias("high2"), F.min("pos2").alias("first2"))
    span1 = early.groupBy("token", "comp1").agg(F.min(n1).alias("low1"), F.min("pos1").alias("first1"), F.max(n1).alias("high1"))
    able = (F.col("comp1") != F.col("comp2")) & (F.col("high2") >= F.col("low1")) & (100 * F.col("high1") >= percent * F.col("low2")) & (100 * F.col("high2") >= percent * F.col("low1") + (100 + percent) * F.col("first2"))
    able &= 100 * F.col("high1") >= percent * F.col("low2") + (100 + percent) * F.col("first1")
    apart = span1.join(span2, "token").where(able).select("token", "comp1", "comp2", "low2", "high2", "first2")
    fits = (F.col("high2") >= n1) & (100 * n1 >= percent * F.greatest(n1, "low2") + (100 + percent) * F.col("pos1")) & (100 * F.col("high2") >= percent * n1 + (100 + percent) * F.col("first2"))
    one = apart.join(early, ["token", "comp1"]).where(fits).select("token", "comp1", "tag1", "pos1", "comp2")
    two = one.join(other, ["token", "comp2"]).where((n1 <= n2) & _may_link("tag1", "pos1", "tag2", "pos2", percent))
    x, y = F.struct(F.col("comp1").alias("comp"), F.col("tag1").alias("tag")), F.struct(F.col("comp2").alias("comp"), F.col("tag2").alias("tag"))
    pairs = two.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).distinct()  # sets of one size meet in both orders
    pairs = pairs.select(F.col("x.comp").alias("comp1"), F.col("x.tag").alias("tag1"), F.col("y.comp").alias("comp2"), F.col("y.tag").alias("tag2"))
    member = rows.select("comp", "tag", "node").distinct()
    grown = pairs.join(member.select(F.col("comp").alias("comp1"), F.col("tag").alias("tag1"), F.col("node").alias("a")), ["comp1", "tag1"])
    grown = grown.join(member.select(F.col("comp").alias("comp2"), F.col("tag").alias("tag2"), F.col("node").alias("b")), ["comp2", "tag2"])
    return grown.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per row of df: id, n_shingles and component_id (the smallest id that links reach, itself included)."""
    rows, slots, collided = describe(df, id_col, text_col, size)
    nodes = materialise(rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.min("at").alias("rep")))
    order = Window.partitionBy("token").orderBy("tag", "node")
    useful = F.bool_or(_early("tag", "pos", percent)).over(Window.partitionBy("token")).alias("useful")
    seen = prefix_rows(df, slots, collided, text_col, size, percent).select("*", F.lag("node").over(order).alias("prev"), F.lead("node").over(order).alias("next"), useful)
    # Of a node's repeated rows the first stays; a shingle of one node only may stay once, and pairs with nothing. A shingle that is early in
    # no set is not needed: linked sets share one that is early in the smaller of them.
    live = materialise(seen.where("useful and (prev is null or prev <> node) and (prev is not null or next is not null)").select("token", "node", "tag", "pos"))
    del seen
    release(df.sparkSession)
    check = lambda pairs: materialise(verified(pairs, nodes, collided, df, id_col, text_col, size, percent))
    pairs = materialise(hub_pairs(live.withColumn("comp", F.col("node")), 0, percent))
    tried = comp = None
    joined = lambda comp, found: connected(found if comp is None else found.unionByName(comp.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    turn = 0
    while True:
        found = check(pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        comp = joined(comp, found)
        release(df.sparkSession)
        rows_left = mixed_rows(live, comp, percent)
        ahead, there = work(rows_left, percent)
        if ahead <= 2 * there or turn == len(TRIES) - 1 or found.isEmpty():
            break
        turn += 1
        pairs = materialise(hub_pairs(rows_left, turn, percent).join(tried, ["a", "b"], "left_anti"))
    last = check(materialise(rest_pairs(rows_left, percent).join(tried, ["a", "b"], "left_anti")))
    comp = joined(comp, last)
    # Only nodes with a link need their component's smallest id; the join back is salted, so a large component is spread.
    linked = nodes.join(comp, "node").select("node", "least", F.col("component").alias("comp"), F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int").alias("salt"))
    least = linked.groupBy("comp").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    named = linked.join(least, ["comp", "salt"]).select("node", "component_id")
    alone = nodes.join(comp, "node", "left_anti").select("node", F.col("least").alias("component_id"))
    out = rows.join(named.unionByName(alone), "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
