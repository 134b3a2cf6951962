"""Benchmark decontamination by a stored positional inverted index that is distributed by documents.

The index is a table of segments, each of about SEGMENT bytes of documents: a segment's words, and of each word its posting list,
the sorted positions at which it stands in the segment. It is built once, stored in the shared checkpoint folder, and can be searched
for any items. A window of an item is searched list by list: the positions of its rarest word, shifted back by its place, are
intersected with the lists of the other words, shifted likewise, from the rarer to the commoner; what is left are the exact phrase
matches. Proximity matches come from the same lists. Documents are never shuffled, and each lies in one segment, so neither a hot
passage nor a hot source gathers in a task.

The test items go to the tasks in blocks of a checked size (`block_bytes`), through the driver; one longer item is a block of its
own. Each block is searched over the stored segments, and a document's finds are united over the blocks.

Words are runs of ASCII letters (A-Z lower-cased), digits and any characters beyond ASCII. A null text has no words and matches
nothing; an item without words has no windows; items and documents may repeat (each row is judged); an empty items table marks
nothing; other columns aren't read. A long text is indexed whole, in a segment of its own. Items are named by their ids as strings,
of whatever type they are; items with a null id are searched like others, count as one item, and are left out of the digest of names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut, map_arrow, materialise, may_hold, membership

_ASCII = bytes(range(128))
_WORD = bytes(c for c in _ASCII if chr(c).isalnum())
TO_WORDS = bytes.maketrans(_ASCII, bytes((c | 0x20 if 0x41 <= c <= 0x5A else c) if c in _WORD else 0x20 for c in _ASCII))
#: Bytes of text in a segment, or one longer text.
SEGMENT = 2_000_000
#: Candidate positions that are intersected at once.
AT_ONCE = 2_000_000


def words(text: bytes | None) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a UTF-8 text whose A-Z are lower-cased."""
    return text.translate(TO_WORDS).split() if text else []


def _packed(a: np.ndarray) -> bytes:
    """Numbers below 2^32, byte by byte, compressed."""
    return pa.Codec("zstd", compression_level=1).compress(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True) if len(a) else b""


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    raw = pa.Codec("zstd").decompress(packed, 4 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


class Segment:
    """Posting lists of some texts. A position is the number of words before it, texts being one apart."""

    def __init__(self, terms: list[bytes], count: np.ndarray, at: np.ndarray, n_words: np.ndarray):
        self.number = {t: k for k, t in enumerate(terms)}
        self.count, self.n_words = count, n_words
        self.start = np.cumsum(n_words + 1) - n_words - 1
        self.reach = int((n_words + 1).sum()) + 1  # more than any position
        self.first = np.cumsum(count) - count
        self.at = at
        #: Of each posting, its word's number times reach plus its position: sorted, so a list holds a position if this does.
        self.keys = np.repeat(np.arange(len(count)), count) * self.reach + at

    @staticmethod
    def index(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """The distinct words, how many postings each has, the postings word by word, and each text's number of words."""
        number: dict[bytes, int] = {}
        put = number.setdefault
        split = [words(t) for t in texts]
        n = np.array([len(w) for w in split], np.int64)
        ids = np.array([put(w, len(number)) for some in split for w in some], np.int32)
        place = np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)
        small = ids.astype(np.uint16) if len(number) < 1 << 16 else ids  # sorted in linear time
        return list(number), np.bincount(ids, minlength=len(number)), place[np.argsort(small, kind="stable")], n

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether the terms' lists hold the positions."""
        key = term * self.reach + position
        at = np.searchsorted(self.keys, key)
        return (position >= 0) & (position < self.reach) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key)

    def candidates(self, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """In parts: windows all of whose words occur, a position of their rarest word, their places from the rarest word on, their terms here."""
        if not len(items.windows) or not len(self.keys):
            return
        here = np.array([self.number.get(t, -1) for t in items.terms], np.int64)
        term = np.where(items.windows >= 0, here[items.windows], -2)
        live = np.flatnonzero((term != -1).all(1))
        term = term[live]
        often = np.where(term >= 0, self.count[term], np.iinfo(np.int64).max)
        order = np.argsort(often, axis=1, kind="stable")
        rarest = term[np.arange(len(live)), order[:, 0]]
        ends = np.cumsum(self.count[rarest])
        low = 0
        while low < len(live):
            done = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
            n = self.count[rarest[low:high]]
            of = np.repeat(np.arange(low, high), n)
            within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            yield live[of], self.at[self.first[rarest[of]] + within], order[of], term[of]
            low = high

    def phrases(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        """Windows and where they start, for every exact occurrence."""
        windows, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for window, at, order, term in self.candidates(items):
            start = at - order[:, 0]
            row = np.arange(len(window))
            for k in range(1, items.size):  # the next list, from the rarer word to the commoner
                place = order[row, k]
                t = term[row, place]
                keep = (t < 0) | self.holds(t, start[row] + place)
                row = row[keep]
                if not len(row):
                    break
            row = row[start[row] >= 0]
            windows.append(window[row])
            starts.append(start[row])
        return np.concatenate(windows), np.concatenate(starts)

    def near(self, items: Items, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows and positions of their rarest word, where all the window's words stand, in any order, within its length plus slop words."""
        windows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for window, at, order, term in self.candidates(items):
            span = items.length[window] + slop
            doc = np.searchsorted(self.start, at, "right") - 1
            stop = self.start[doc] + self.n_words[doc]
            hit = np.zeros(len(window), bool)
            for back in range(int(span.max(initial=0))):  # every stretch of that many words that holds the position
                begin = at - back
                row = np.flatnonzero(~hit & (back < span) & (begin >= self.start[doc]))
                for k in range(items.size):
                    t = term[row, k]
                    key = t * self.reach + begin[row]
                    next_ = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] - t * self.reach
                    row = row[(t < 0) | (next_ >= begin[row]) & (next_ < np.minimum(begin[row] + span[row], stop[row]))]
                hit[row] = True
            windows.append(window[hit])
            places.append(at[hit])
        return np.concatenate(windows), np.concatenate(places)


class Items:
    """The windows of a block of test items: `size` consecutive words, or a whole item of fewer; -1 stands for no word."""

    def __init__(self, rows: list[tuple[str | None, bytes | None]], size: int):
        self.size = size
        number: dict[bytes, int] = {}
        named: dict[str | None, int] = {}
        windows, item = [], []
        for key, text in rows:
            ids = [number.setdefault(w, len(number)) for w in words(text)]
            for at in range(max(1, len(ids) - size + 1) if ids else 0):
                part = ids[at : at + size]
                windows.append(part + [-1] * (size - len(part)))
                item.append(named.setdefault(key, len(named)))
        self.windows = np.array(windows, np.int64).reshape(-1, size)
        self.length = (self.windows >= 0).sum(1)
        self.item = np.array(item, np.int64)
        self.terms, self.names = list(number), list(named)


def build_index(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of all rows of docs: a row per segment with its documents' keys and its posting lists."""
    kind = docs.schema[key_col].dataType.simpleString()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            done = 0
            for texts in cut(b["text"], SEGMENT):
                terms, count, at, n = Segment.index(texts)
                first = np.repeat(np.cumsum(count) - count, count)
                gaps = np.diff(at, prepend=0)
                gaps = np.where(np.arange(len(at)) == first, at, gaps)  # of a list: its first position, then distances
                yield {
                    "segment": [uuid.uuid4().hex],
                    "keys": pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), b["key"].slice(done, len(texts))),
                    "n_words": pa.array([n.tolist()], pa.list_(pa.int64())),
                    "terms": [b" ".join(terms)],
                    "count": [_packed(count)],
                    "n_postings": [len(at)],
                    "postings": [_packed(gaps)],
                }
                done += len(texts)

    read = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    return materialise(map_arrow(read, run, f"segment string, keys array<{kind}>, n_words array<long>, terms binary, count binary, n_postings long, postings binary"))


def _read(terms: bytes, count: bytes, n_postings: int, postings: bytes, n_words: list[int]) -> Segment:
    names = terms.split()
    counted = _unpacked(count, len(names))
    gaps = _unpacked(postings, n_postings)
    total = np.cumsum(gaps)
    first = np.cumsum(counted) - counted
    before = (total - gaps)[first] if len(first) else total  # what the lists before have added
    return Segment(names, counted, total - np.repeat(before, counted), np.array(n_words, np.int64))


def _blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The items, block by block; a block is of about block_bytes, or one item."""
    rows = items.select(F.col(item_col).cast("string").alias("k"), F.col(text_col).cast("binary").alias("t"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 16)).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == b)
        yield [(r.k, bytes(r.t) if r.t is not None else None) for r in part.collect()]


def search(index: DataFrame, items: DataFrame, size: int = 13, item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 16 << 20, slop: int | None = None) -> DataFrame:
    """One row per document of an index: key, n_words, `items` (sorted distinct ids of items that match, as strings, null first) and `spans` (merged [start, end) word ranges that matches cover).

    slop None: exact phrases. Otherwise proximity: all words of a window, in any order, within its length plus slop words; spans
    then hold the place of the window's rarest word.
    """
    sc = index.sparkSession.sparkContext
    kind = index.schema["keys"].dataType.elementType.simpleString()
    schema = f"segment string, doc int, key {kind}, n_words long, items array<string>, spans array<long>"
    found = None
    for block in _blocks(items, item_col, item_text_col, block_bytes):
        part = map_arrow(index, _searched(sc.broadcast((block, size)), slop), schema)
        found = part if found is None else found.unionByName(part)
        several = found is not part
    if several:  # a row for each block: at most as many as there are blocks meet
        united = found.groupBy("segment", "doc").agg(F.first("key").alias("key"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))

        def merge(batches: Iterator[dict]) -> Iterator[dict]:
            for b in batches:
                yield b | {"items": [_sorted(x) for x in b["items"].to_pylist()], "spans": pa.array([merged(x) for x in b["spans"].to_pylist()], pa.list_(pa.int64()))}

        found = map_arrow(united, merge, schema)
    pairs = F.transform(F.sequence(F.lit(0), F.expr("int(size(spans) div 2) - 1")), lambda i: F.struct(F.get("spans", 2 * i).alias("start"), F.get("spans", 2 * i + 1).alias("end")))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return found.select("key", "n_words", "items", F.when(F.size("spans") > 0, pairs).otherwise(empty).alias("spans"))


def _searched(shared, slop: int | None):
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        items = Items(*shared.value)
        for b in batches:
            for k in range(len(b["segment"])):
                n_words = b["n_words"][k].as_py()
                segment = _read(b["terms"][k].as_py(), b["count"][k].as_py(), b["n_postings"][k].as_py(), b["postings"][k].as_py(), n_words)
                window, at = segment.phrases(items) if slop is None else segment.near(items, slop)
                length = items.length[window] if slop is None else np.ones(len(window), np.int64)
                doc = np.searchsorted(segment.start, at, "right") - 1
                names: list[list] = [[] for _ in n_words]
                spans: list[list[int]] = [[] for _ in n_words]
                for d, i in np.unique(np.stack([doc, items.item[window]], 1), axis=0).tolist():
                    names[d].append(items.names[i])
                for d, s, e in zip(doc.tolist(), (at - segment.start[doc]).tolist(), (at - segment.start[doc] + length).tolist(), strict=True):
                    spans[d] += [s, e]
                keys = b["keys"].slice(k, 1).flatten()
                yield {"segment": [b["segment"][k].as_py()] * len(keys), "doc": np.arange(len(keys), dtype=np.int32), "key": keys, "n_words": n_words, "items": [_sorted(x) for x in names], "spans": pa.array([merged(x) for x in spans], pa.list_(pa.int64()))}

    return run


def _sorted(names: list[str | None]) -> list[str | None]:
    return sorted(set(names), key=lambda k: (k is not None, k or ""))


def merged(flat: list[int]) -> list[int]:
    """Flat [start, end, ...] ranges as their union."""
    out: list[int] = []
    for s, e in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def phrase_hits(docs: DataFrame, items: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """search() over an index of docs; the key is the id. Options are those of search."""
    return search(build_index(docs, id_col, text_col), items, size, **options).withColumnRenamed("key", id_col)


def contamination(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256, contaminated.

    contaminated: n_hit > 0 and share * n_hit >= n_words. Options are those of phrase_hits.
    """
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    digest = F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256)
    out = phrase_hits(docs, items, size, id_col, **options).select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns, whatever their names.

    Rows are named by id and text hash. Only those that a filter of fixed size takes for contaminated meet the names that are, so no
    other text is shuffled.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("of"))
    named = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    gone = contamination(named, items, id_col="key", **options).where("contaminated").select("key", F.xxhash64("key").alias("at")).distinct()
    gone = materialise(gone)
    rows = docs.select(key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.withColumn("met", may_hold(F.xxhash64("key"), membership(gone, "at")))
    left = rows.where("met").alias("d").join(gone.alias("g"), F.col("d.key").eqNullSafe(F.col("g.key")), "left_anti").select("row")
    return left.unionByName(rows.where("not met").select("row")).select("row.*")
