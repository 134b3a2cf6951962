"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For each prefix of a text the last token of its encoding is unique. An automaton over the vocabulary lists the tokens that end
at each position; of those, the last token is the one that starts where the prefix before it ends in a token that it is
compatible with, that is, where the pair encodes to itself. Walking the table backwards from the end gives the ids.

The table is built per segment. Where no vocabulary entry has a space mark after another character, no merge crosses the start
of a run of marks, so a text falls into segments (marks, then other characters) that are encoded once each and kept by the
worker in a table of bounded size. A vocabulary that breaks this rule is encoded over whole texts.

Nulls, empty and huge texts: a null text is empty and has no ids. Texts are never cut: a segment of any length is encoded in
time linear in its length. Repeated rows each give a row; an empty table gives none; columns besides the two named aren't read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut, map_arrow, row_of, row_type, with_row, worker_cache

MARK = "▁"
#: What a worker remembers at most: twice so many segments (about 120 bytes each), and pairs (about 90). Two workers share an executor's memory with its JVM.
KEPT_SEGMENTS = 150_000
KEPT_PAIRS = 400_000
KEPT_CHARS = 64


class PieceCodec:
    """encode() and decode() of one SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        if any(sp.is_unused(i) for i in plain):
            raise ValueError("models with unused pieces are not supported")
        self.score = {self.piece[i]: sp.get_score(i) for i in plain}
        self.id = {self.piece[i]: i for i in plain}
        self.byte_id = {int(self.piece[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        if len(self.byte_id) != 256:
            raise ValueError("only models with byte fallback are supported")
        self.chars = {p for p in self.id if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id)
        self.segments = (lambda s: [s] if s else []) if crossing else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        unknown = "".join(sorted(self.chars - {MARK}))
        self.known_run = re.compile(f"[{MARK}{re.escape(unknown)}]+|.", re.DOTALL)
        self.pairs: dict[int, bool] = {}
        self.table: dict[str, str | tuple[str, str]] = {}
        self.older: dict[str, str | tuple[str, str]] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging itself: the best score first, then the leftmost pair."""
        n = len(text)
        part: list[str] = list(text)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-self.score[p], i, p) for i in range(n - 1) if (p := text[i : i + 2]) in self.score]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = right[i]
            if not part[i] or j >= n or part[i] + part[j] != p:
                continue
            part[i], part[j] = p, ""
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                if (q := p + part[right[i]]) in self.score:
                    heapq.heappush(heap, (-self.score[q], i, q))
            if left[i] >= 0 and (q := part[left[i]] + p) in self.score:
                heapq.heappush(heap, (-self.score[q], left[i], q))
        return [p for p in part if p]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the two tokens side by side encode to themselves."""
        return self.merged(self.piece[a] + self.piece[b]) == [self.piece[a], self.piece[b]]

    def known_ids(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are in the vocabulary, by the prefix table."""
        last = [-1] * (len(text) + 1)  # last[k]: the last token of the encoding of the first k characters
        pairs, piece, size = self.pairs, self.piece, len(self.piece)
        if len(pairs) > KEPT_PAIRS:
            pairs.clear()
        for end, (length, token) in self.automaton.iter(text):
            if last[end + 1] >= 0:
                continue
            before = end + 1 - length
            previous = last[before]  # -1 before the first character
            if before and previous < 0:
                continue
            key = previous * size + token  # below 0 where there is none before
            fits = pairs.get(key)
            if fits is None:
                fits = pairs[key] = self.compatible(previous, token) if before else self.merged(piece[token]) == [piece[token]]
            if fits:
                last[end + 1] = token
        ids = []
        at = len(text)
        while at:
            ids.append(last[at])
            at -= len(piece[last[at]])
        return ids[::-1]

    def ids(self, segment: str) -> list[int]:
        out: list[int] = []
        for run in self.known_run.findall(segment):
            if len(run) > 1 or run in self.chars:
                out += self.known_ids(run)
            else:  # merges never reach a character that is no piece; its bytes stand for it
                out += [self.byte_id[b] for b in run.encode("utf-8")]
        return out

    def decoded(self, ids: list[int]) -> str:
        """The text of ids, without the first dummy space."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            out.append(self.piece[i])
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ").removeprefix(" ")

    def entry(self, segment: str) -> str | tuple[str, str]:
        """A segment's ids as text; with what they decode to inside a text, if that is not the segment itself."""
        found = self.older.get(segment)
        if found is None:
            ids = self.ids(segment)
            # A mark in front keeps decoded() from taking the segment's own space for the dummy one.
            back = self.decoded([self.id[MARK], *ids])
            found = ",".join(map(str, ids))
            if back != segment.replace(MARK, " "):
                found = (found, back)
        if len(segment) <= KEPT_CHARS:
            if len(self.table) >= KEPT_SEGMENTS:  # what was not asked for since the last such turn goes
                self.older, self.table = self.table, {}
            self.table[segment] = found
        return found

    def encoded(self, text: str) -> tuple[str, str]:
        """The ids joined by commas, and the decoded text."""
        whole = self.sp.normalize(text)
        segments = self.segments(whole)
        get = self.table.get
        found = [get(s) or self.entry(s) for s in segments]
        if any([type(f) is tuple for f in found]):
            whole = "".join([f[1] if type(f) is tuple else s for s, f in zip(segments, found, strict=True)])
            found = [f[0] if type(f) is tuple else f for f in found]
        ids = ",".join(found)
        return ids, whole.replace(MARK, " ").removeprefix(" ")

    def encode(self, text: str) -> list[int]:
        ids = self.encoded(text)[0]
        return [int(x) for x in ids.split(",")] if ids else []

    def digest(self, text: str) -> tuple[int, str, str]:
        """How many ids, the SHA-256 of the ids joined by commas, and that of the decoded text."""
        ids, back = self.encoded(text)
        return ids.count(",") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def codec(path: str) -> PieceCodec:
    return worker_cache(("codec", path), lambda: PieceCodec(path))


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id and `ids`, the token ids of its text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        c = codec(model_path)
        for b in batches:
            yield {id_col: b["id"], "ids": [c.encode(t.decode()) for some in cut(b["text"], 1_000_000) for t in some]}

    return map_arrow(df.selectExpr(f"`{id_col}` id", f"`{text_col}` text"), run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Each row's id and `text`, what its ids decode to; null ids give an empty text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        c = codec(model_path)
        for b in batches:
            yield {id_col: b["id"], "text": [c.decoded(x or []) for x in b["ids"].to_pylist()]}

    return map_arrow(df.selectExpr(f"`{id_col}` id", f"`{ids_col}` ids"), run, f"`{id_col}` {kind}, text string")


def digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", passed: list[str] | None = None) -> DataFrame:
    """Each row's id (or the columns to be passed on, in a struct `__row`), n_tokens, ids_sha256 and decoded_sha256; ids don't leave the worker."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        c = codec(model_path)
        for b in batches:
            rows = [c.digest(t.decode()) for some in cut(b["text"], 1_000_000) for t in some]
            yield row_of(b) | {"id": b["id"], "n_tokens": [r[0] for r in rows], "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]}

    out = map_arrow(with_row(df, passed, id=id_col, text=text_col), run, f"{row_type(df, passed)}id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select("__row" if passed else F.col("id").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256")
