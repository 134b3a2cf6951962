"""Exact duplicates by a tree-merge of sorted digest runs.

Each task turns its rows into sorted runs of digests, one entry for each digest of a run: the row to be kept so far and how many rows
there are. Runs are then exchanged in binomial rounds: partitions are numbered by bits, and in a round those that differ in a few bits
only (WAYS of them) exchange what belongs to each other, by the digests' leading bits, merge what they got and combine equal digests.
After the last round a partition holds all of the digests whose leading bits are its number. So a digest that a third of all rows
share is one entry a run from the start and never gathers, and no partition ever holds more than its share of distinct digests.
Whenever entries are combined, a second digest and the length are compared as well, so what is retained is verified at every level.

What was found goes back to the rows by (digest, run), so the rows of a hot digest lie in as many tasks as there are runs.

Texts are equal if they are after A-Z is lower-cased. A null text counts as empty, and empty texts are copies of each other. Of equal
texts the row with the largest id stays (or the smallest); a null id gives way to any other; of rows with one id, or with none,
exactly one stays. Long texts are hashed whole. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import each, map_arrow, materialise
from cairn.llm.runs import BLOCK, RUN, merge

#: A-Z to a-z in UTF-8, other bytes as they are.
LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
#: Bits of a partition's number that a round settles: 2^BITS partitions exchange runs.
BITS = 3
WAYS = 1 << BITS
#: A run's number is task << SPLIT | its place in the task.
SPLIT = 20
#: What an entry has behind its digest.
FIELDS = ("check", "n_bytes", "id", "row", "n")


def digests(docs: DataFrame, kind: str) -> DataFrame:
    """docs (id, text) as (id, sha, check, n_bytes, run, row): a row for each, numbered, with the run that it is in."""

    def digest(batches: Iterator[dict]) -> Iterator[dict]:
        task, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            sha, check, size = [], [], []
            for text in each(b["text"]):
                normal = (text or b"").translate(LOWER)
                sha.append(sha256(normal).digest())
                check.append(int.from_bytes(blake2b(normal, digest_size=8).digest(), "big", signed=True))
                size.append(len(normal))
            at = range(seen, seen + len(sha))
            seen += len(sha)
            run = [(task << SPLIT) + k // RUN for k in at]
            yield {"id": b["id"], "sha": sha, "check": check, "n_bytes": size, "run": run, "row": [r * RUN + k % RUN for r, k in zip(run, at, strict=True)]}

    return map_arrow(docs, digest, f"id {kind}, sha binary, check long, n_bytes long, run long, row long")


class Keeper:
    """Combines entries (digest, check, n_bytes, id, row, n) of one digest: rows are added, the better id is retained."""

    def __init__(self, keep: str):
        if keep not in ("largest", "smallest"):
            raise ValueError("keep is largest or smallest")
        self.largest = keep == "largest"

    def better(self, a: tuple, b: tuple) -> tuple:
        (x, i), (y, j) = a[3:5], b[3:5]
        if x == y:
            return a if i < j else b
        if x is None or y is None:
            return b if x is None else a
        return a if (x > y) == self.largest else b

    def combined(self, sorted_entries: Iterator[tuple]) -> Iterator[tuple]:
        now = None
        for e in sorted_entries:
            if now is None or now[0] != e[0]:
                if now is not None:
                    yield now
                now = e
            else:
                if now[1:3] != e[1:3]:
                    raise ValueError(f"different texts have the SHA-256 digest {e[0].hex()}")
                now = (*self.better(now, e)[:5], now[5] + e[5])
        if now is not None:
            yield now


class Exchange:
    """Where entries go: the partition of a digest in each round, of 2^depth partitions."""

    def __init__(self, depth: int):
        self.depth = depth
        self.rounds = max(1, -(-depth // BITS))

    def final(self, sha: bytes) -> int:
        return int.from_bytes(sha[:8], "big") >> (64 - self.depth)

    def to(self, at: int, sha: bytes, k: int) -> int:
        """In round k the bits k * BITS to (k + 1) * BITS of the partition become those of the digest's own."""
        mask = (WAYS - 1) << (k * BITS)
        return (at & ~mask) | (self.final(sha) & mask)

    def blocks(self, entries: Iterator[tuple], at: int, run: int, k: int) -> Iterator[dict]:
        """Sorted entries that lie in a partition, cut into blocks by the partition that they go to in round k."""
        waiting: dict[int, list[tuple]] = {}
        for e in entries:
            to = self.to(at, e[0], k)
            block = waiting.setdefault(to, [])
            block.append(e)
            if len(block) >= BLOCK:
                yield self.block(to, run, waiting.pop(to))
        for to, block in waiting.items():
            yield self.block(to, run, block)

    @staticmethod
    def block(to: int, run: int, entries: list[tuple]) -> dict:
        sha, *fields = zip(*entries, strict=True)
        return {"to": [to], "run": [run], "first": [sha[0]], "sha": [b"".join(sha)]} | {c: [list(v)] for c, v in zip(FIELDS, fields, strict=True)}


def _entries(b: dict, k: int) -> list[tuple]:
    sha = b["sha"][k].as_py()
    return list(zip((sha[i : i + 32] for i in range(0, len(sha), 32)), *(b[c][k].as_py() for c in FIELDS), strict=True))


def exact_duplicates(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256): a row for each document, those that go included."""
    keeper = Keeper(keep)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = materialise(digests(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), kind))
    parts = (rows.agg(F.max("run")).first()[0] or 0) >> SPLIT
    exchange = Exchange(parts.bit_length())
    block_type = f"to int, run long, first binary, sha binary, check array<long>, n_bytes array<long>, id array<{kind}>, row array<long>, n array<long>"

    def local(batches: Iterator[dict]) -> Iterator[dict]:
        """Runs in order, with one entry for each digest."""

        def leave() -> Iterator[dict]:
            for run, some in held.items():
                yield from exchange.blocks(keeper.combined(iter(sorted(some, key=lambda e: e[0]))), run >> SPLIT, run, 0)

        held: dict[int, list[tuple]] = {}
        for b in batches:
            for run, *e in zip(b["run"].to_pylist(), *(b[c].to_pylist() for c in ("sha", *FIELDS[:-1])), strict=True):
                if run not in held and len(held) > 1:
                    yield from leave()
                    held.clear()
                held.setdefault(run, []).append((*e, 1))
        yield from leave()

    def merged(k: int):
        """What a partition got in round k, merged; it goes on in blocks, or after the last round row by row."""

        def run(batches: Iterator[dict]) -> Iterator[dict]:
            def own() -> Iterator[tuple]:
                while todo[0] is not None and todo[0][0] == at:
                    _, source, some = todo[0]
                    yield source, some
                    todo[0] = next(stream, None)

            stream = ((b["to"][i].as_py(), b["run"][i].as_py(), _entries(b, i)) for b in batches for i in range(len(b["to"])))
            todo = [next(stream, None)]
            while todo[0] is not None:
                at = todo[0][0]
                one = keeper.combined(merge(own()))
                if k + 1 < exchange.rounds:
                    yield from exchange.blocks(one, at, at, k + 1)
                else:
                    while some := [e for e, _ in zip(one, range(BLOCK))]:  # noqa: B905  a block at a time
                        sha, _, _, name, row, n = zip(*some, strict=True)
                        yield {"sha": list(sha), "keep_id": list(name), "keep_row": list(row), "group_size": list(n)}

        return run

    blocks = map_arrow(rows.select("run", "sha", *FIELDS[:-1]), local, block_type)
    for k in range(exchange.rounds):
        dealt = blocks.repartitionById(1 << exchange.depth, "to").sortWithinPartitions("to", "first")
        blocks = map_arrow(dealt, merged(k), block_type if k + 1 < exchange.rounds else f"sha binary, keep_id {kind}, keep_row long, group_size long")
    answers = rows.select("sha", "run").distinct().join(blocks, "sha")
    found = rows.select("id", "sha", "run", "row").join(answers, ["sha", "run"])
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
