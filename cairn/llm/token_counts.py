"""Token counts without ids: pieces are counted once per distinct pre-token and joined to per-document frequencies.

Byte-level BPE never merges across a pre-token's border, so a document's count is the sum over its distinct pre-tokens of
frequency times pieces. Each task keeps a pre-token -> pieces table, fills it with one batched call of the library for the
pre-tokens that it lacks, and joins the documents' frequencies to it. The join stays in the task: as a Spark join it would
shuffle a row for each (document, pre-token), more bytes than the texts themselves, to save work that a table in memory saves too.

Nulls, empty and huge texts: a null text counts as empty (0 bytes, 0 tokens). Repeated rows each give a row. An empty table
gives no rows. Columns besides the two named are not read, whatever their names.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame

from cairn.llm.common import cut, map_arrow, worker_cache

# The pre-tokeniser pattern of byte-level BPE files.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters on whose class every Unicode version of the libraries agrees; texts with others are cut by the library's own pre-tokeniser.
AGREED = regex.compile("[^\x00-՗ -⁯]")

#: Entries and entry length of the pre-token table that a worker keeps from batch to batch; others are counted and forgotten.
KEPT_ENTRIES = 600_000
KEPT_CHARS = 64
#: Bytes of text that a worker counts at once.
AT_ONCE = 4_000_000


class PieceCounter:
    """Counts the tokens of texts for a tokenizers .json file with byte-level pre-tokens, as its encode() would."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level tokenizers without a normalizer or prefix space are supported")
        added = spec.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that strip or need word borders are not supported")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.cut = regex.compile(BYTE_LEVEL_PATTERN).findall
        self.pieces: dict[str, int] = {}

    def pre_tokens(self, text: str) -> list[str]:
        if AGREED.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.cut(text)

    def frequencies(self, text: str) -> tuple[int, Counter]:
        """How many special strings a text has, and how often each pre-token."""
        if not self.special or not self.special.search(text):
            return 0, Counter(self.pre_tokens(text))
        parts = self.special.split(text)
        found: Counter = Counter()
        for part in parts:
            found.update(self.pre_tokens(part))
        return len(parts) - 1, found

    def count(self, texts: list[str]) -> list[int]:
        of = [self.frequencies(t) for t in texts]
        pieces = self.pieces
        lacking = list({p for _, f in of for p in f if p not in pieces})
        if len(pieces) + len(lacking) > KEPT_ENTRIES:
            pieces = self.pieces = {}
            lacking = list({p for _, f in of for p in f})
        long = []
        for at in range(0, len(lacking), 20_000):
            part = lacking[at : at + 20_000]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                pieces[p] = len(e)
                if len(p) > KEPT_CHARS:
                    long.append(p)
        out = [special + sum(n * pieces[p] for p, n in f.items()) for special, f in of]
        for p in long:
            del pieces[p]
        return out


def token_counts(df: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: its id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    tokenizer_path must be readable at the same place on every executor, as the installed tokenizer package is.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        counter = worker_cache(("pieces", tokenizer_path), lambda: PieceCounter(tokenizer_path))
        for b in batches:
            n: list[int] = []
            size: list[int] = []
            for some in cut(b["text"], AT_ONCE):
                size += map(len, some)
                n += counter.count([x.decode("utf-8") for x in some])
            yield {id_col: b["id"], "n_bytes": size, "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_arrow(df.selectExpr(f"`{id_col}` id", f"`{text_col}` text"), run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
