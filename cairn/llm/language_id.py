"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads every byte of a document, white space too, in both directions, and labels every position with a probability for
each language; a document's probabilities are the means over all its positions. Long documents are read in overlapping windows: the
states of a window's positions have run over the WARM bytes before (backwards: behind) them first, so that every position has seen
its neighbourhood, across words and lines, and windows of many documents move on together, one position a step. A document of WIDTH
bytes or fewer is one window, read from its ends.

Training is numpy back-propagation through time with Adam, on the driver, from a bounded sample: `learn_windows` stretches, spread
over the whole text, of each of at most `learn_docs` documents. The documents (those with small hashes) are taken in turn from
each language, so a rare language is learned too, up to `learn_docs` languages.

Only the text is an input of a prediction. Nulls and odd cases: a null text, or one without any letter (of Unicode's class L, so number
signs aren't), is `und` with score 0; rows
with a null language don't teach; if no language can be learned, every row is `und`. Ties go to the language that sorts first. Long
texts are read whole. Repeated rows are predicted each; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut, map_arrow
from cairn.operators.common import top

WIDTH, WARM = 256, 32
#: Windows that move on together, and bytes of text whose windows are dealt out at once.
ABREAST, AT_ONCE = 1024, 2_000_000
#: Length of the stretches that the network learns from.
STRETCH = 64
#: What stands outside a document; it leaves a state as it is.
PAD, HOLD = 256, 30.0
LETTER = regex.compile(r"\p{L}")
SALTS = 16


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteTagger:
    """Two gated recurrent layers, one a direction, and a softmax over both at each position.

    Arrays have the direction (forward, backward) as an axis, so both are computed by the same calls.
    """

    def __init__(self, languages: list[str], hidden: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.p = {
            "x": rng.normal(0, 0.3, (2, PAD + 1, 3 * hidden)),  # what a byte adds to update gate, reset gate and candidate
            "u": rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 3 * hidden)),
            "o": rng.normal(0, 1 / np.sqrt(2 * hidden), (2, hidden, len(languages))),
            "c": np.zeros(len(languages)),
        }
        self._hold()

    def _hold(self) -> None:
        self.p["x"][:, PAD] = 0
        self.p["x"][:, PAD, : self.hidden] = HOLD

    def _steps(self, ahead: np.ndarray) -> list[tuple]:
        """Per step: state before, update gate, reset gate, candidate, what the state gives the candidate, state after. ahead: (steps, 2, n) rows of x."""
        h, u = self.hidden, self.p["u"]
        x = self.p["x"].reshape(-1, 3 * h)
        state = np.zeros((2, ahead.shape[2], h))
        out = []
        for rows in ahead:
            a, g = x[rows], state @ u
            z, r = _sigmoid(a[:, :, :h] + g[:, :, :h]), _sigmoid(a[:, :, h : 2 * h] + g[:, :, h : 2 * h])
            n = np.tanh(a[:, :, 2 * h :] + r * g[:, :, 2 * h :])
            new = n + z * (state - n)
            out.append((state, z, r, n, g[:, :, 2 * h :], new))
            state = new
        return out

    @staticmethod
    def _ahead(runs: np.ndarray) -> np.ndarray:
        """Rows of x in reading order, for both directions, of byte runs of one length."""
        return np.stack([runs.T, runs.T[::-1] + PAD + 1], 1)

    def probabilities(self, runs: np.ndarray) -> np.ndarray:
        """(runs, positions, languages) of byte runs of one length, read from their ends."""
        return self._labelled(self._steps(self._ahead(runs)))

    def _labelled(self, steps: list[tuple]) -> np.ndarray:
        states = np.stack([s[5] for s in steps])
        logits = states[:, 0] @ self.p["o"][0] + states[::-1, 1] @ self.p["o"][1] + self.p["c"]
        e = np.exp(logits - logits.max(2, keepdims=True))
        return (e / e.sum(2, keepdims=True)).transpose(1, 0, 2)

    def gradients(self, runs: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions but padding, by back-propagation through time."""
        h, u = self.hidden, self.p["u"]
        ahead = self._ahead(runs)
        steps = self._steps(ahead)
        d_logit = self._labelled(steps).transpose(1, 0, 2)
        d_logit[:, np.arange(len(runs)), label] -= 1
        there = (runs.T != PAD)[:, :, None]
        d_logit = d_logit * there / max(1, there.sum())
        states = np.stack([s[5] for s in steps])
        both = (d_logit, d_logit[::-1])
        g = {"o": np.stack([np.einsum("tnh,tnl->hl", states[:, d], both[d]) for d in (0, 1)]), "c": d_logit.sum((0, 1)), "u": np.zeros_like(u)}
        d_state = np.stack([both[d] @ self.p["o"][d].T for d in (0, 1)], 1)
        carry = np.zeros_like(states[0])
        d_x = np.zeros((len(steps), 2, len(runs), 3 * h))
        back = u.transpose(0, 2, 1)
        for t in range(len(steps) - 1, -1, -1):
            old, z, r, cand, given, _ = steps[t]
            d = d_state[t] + carry
            d_cand = d * (1 - z) * (1 - cand * cand)
            d_z = d * (old - cand) * z * (1 - z)
            d_r = d_cand * given * r * (1 - r)
            d_x[t] = np.concatenate([d_z, d_r, d_cand], 2)
            d_g = np.concatenate([d_z, d_r, d_cand * r], 2)
            carry = d * z + d_g @ back
            g["u"] += old.transpose(0, 2, 1) @ d_g
        rows = ahead.ravel()
        flat = d_x.reshape(-1, 3 * h)
        order = np.argsort(rows, kind="stable")
        used, first = np.unique(rows[order], return_index=True)
        g["x"] = np.zeros((2 * (PAD + 1), 3 * h))
        g["x"][used] = np.add.reduceat(flat[order], first)
        g["x"] = g["x"].reshape(2, PAD + 1, 3 * h)
        g["x"][:, PAD] = 0
        return g

    def fit(self, runs: np.ndarray, label: np.ndarray, steps: int = 350, batch: int = 128, rate: float = 2e-2, seed: int = 9) -> ByteTagger:
        """Languages teach alike, however many runs they have."""
        rng = np.random.default_rng(seed)
        own = [np.flatnonzero(label == k) for k in range(len(self.languages))]
        m, s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            chosen = np.array([own[k][rng.integers(len(own[k]))] for k in rng.integers(len(own), size=batch)])
            g = self.gradients(runs[chosen], label[chosen])
            norm = np.sqrt(sum((v * v).sum() for v in g.values()))
            now = rate * min(1.0, 2 * (1 - step / steps) + 0.02)
            for k, v in g.items():
                v = v * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        self._hold()
        return self

    def totals(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: the sums over all its positions of the languages' probabilities, and its number of positions."""
        size = np.array([len(t) for t in texts], np.int64)
        flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16)
        first = np.cumsum(size) - size
        n = -(-size // WIDTH)
        doc = np.repeat(np.arange(len(texts)), n)
        start = first[doc] + WIDTH * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        end = (first + size)[doc]
        length = np.minimum(end - start, WIDTH)
        total = np.zeros((len(texts), len(self.languages)))
        order = np.argsort(length, kind="stable")  # short windows together, so few steps are spent on padding
        for at in range(0, len(order), ABREAST):
            w = order[at : at + ABREAST]
            width = int(length[w[-1]])
            step = np.arange(WARM + width)[:, None]
            forward, backward = start[w] - WARM + step, start[w] + width + WARM - 1 - step
            ahead = np.empty((WARM + width, 2, len(w)), np.intp)
            ahead[:, 0] = np.where((forward >= first[doc[w]]) & (forward < end[w]), flat[np.clip(forward, 0, len(flat) - 1)], PAD)
            ahead[:, 1] = np.where(backward < end[w], flat[np.minimum(backward, len(flat) - 1)], PAD)
            ahead[:, 1] += PAD + 1
            prob = self._windows(ahead, width)
            prob[np.arange(width)[:, None] >= length[w]] = 0
            np.add.at(total, doc[w], prob.sum(0, dtype=float))
        return total, size

    def _windows(self, ahead: np.ndarray, width: int) -> np.ndarray:
        """(width, windows, languages): as probabilities(), behind WARM steps that only warm the states, without keeping states."""
        h, x, u, o = self.hidden, self._light["x"], self._light["u"], self._light["o"]
        n = ahead.shape[2]
        state = np.zeros((2, n, h), np.float32)
        a, g = np.empty((2, n, 3 * h), np.float32), np.empty((2, n, 3 * h), np.float32)
        gates, cand = np.empty((2, n, 2 * h), np.float32), np.empty((2, n, h), np.float32)
        logits = np.empty((2, width, n, len(self.languages)), np.float32)
        z, r = gates[:, :, :h], gates[:, :, h:]
        for t, rows in enumerate(ahead):
            np.take(x, rows, 0, out=a)
            np.matmul(state, u, out=g)
            np.add(a[:, :, : 2 * h], g[:, :, : 2 * h], out=gates)  # both at half size: a sigmoid is a tanh of the half
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            np.multiply(r, g[:, :, 2 * h :], out=cand)
            cand += a[:, :, 2 * h :]
            np.tanh(cand, out=cand)
            state -= cand
            state *= z
            state += cand
            if t >= WARM:
                np.matmul(state, o, out=logits[:, t - WARM])
        e = logits[0] + logits[1, ::-1] + self._light["c"]
        e -= e.max(2, keepdims=True)
        np.exp(e, out=e)
        e /= e.sum(2, keepdims=True)
        return e

    def light(self) -> ByteTagger:
        """In single precision as well, for labelling."""
        half = np.repeat([0.5, 0.5, 1.0], self.hidden)
        self._light = {"x": (self.p["x"] * half).reshape(-1, 3 * self.hidden).astype(np.float32), "u": (self.p["u"] * half).astype(np.float32), "o": self.p["o"].astype(np.float32), "c": self.p["c"].astype(np.float32)}
        return self


def stretches(text: bytes, most: int) -> list[bytes]:
    """At most `most` stretches of STRETCH bytes, spread over the whole text; a shorter text is one."""
    n = max(1, min(most, len(text) // STRETCH))
    gap = max(0, len(text) - STRETCH) / max(1, n - 1)
    return [text[int(k * gap) : int(k * gap) + STRETCH] for k in range(n)] if text else []


def learn(df: DataFrame, id_col: str, text_col: str, lang_col: str, learn_docs: int, learn_windows: int) -> ByteTagger | None:
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null and id is not null")
    # In two steps, so no task gathers learn_docs rows of a language from every other task: of each salt its share, then ranks by language.
    ids = rows.select("lang", "id", F.xxhash64("id").alias("h")).withColumn("salt", F.pmod(F.shiftright("h", 20), F.lit(SALTS)))
    some = top(ids, -(-learn_docs // SALTS), ["lang", "salt"], F.col("h"), F.col("id")).drop("rank")
    ranked = top(some, learn_docs, ["lang"], F.col("h"), F.col("id"))
    chosen = ranked.orderBy("rank", "h", "id", "lang").limit(learn_docs).select("id").distinct()
    taught = rows.join(F.broadcast(chosen), "id").select("lang", "text")  # learn_docs ids at most are broadcast

    def sample(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            langs = iter(b["lang"].to_pylist())
            for some in cut(b["text"], AT_ONCE):
                found = [(lang, s) for t, lang in zip(some, langs) for s in stretches(t, learn_windows)]
                yield {"lang": [lang for lang, _ in found], "run": [s for _, s in found]}

    # A repeated id may bring more rows than were chosen.
    runs = map_arrow(taught, sample, "lang string, run binary").orderBy(F.xxhash64("run", "lang"), "run", "lang").limit(learn_docs * learn_windows)
    found = runs.toArrow()
    languages = sorted(set(found["lang"].to_pylist()))
    if not languages:
        return None
    number = {k: i for i, k in enumerate(languages)}
    text = np.full((len(found), STRETCH), PAD, np.int64)
    for k, r in enumerate(found["run"].to_pylist()):
        text[k, : len(r)] = np.frombuffer(r, np.uint8)
    return ByteTagger(languages).fit(text, np.array([number[x] for x in found["lang"].to_pylist()])).light()


def identify(df: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn_docs: int = 3000, learn_windows: int = 8) -> DataFrame:
    """One row per row of df: id, held_out, lang_pred (a learned language or `und`) and score (the mean probability of lang_pred).

    held_out: a Column over id_col; rows for which it is true are not learned from.
    """
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    model = learn(df.where(~held), id_col, text_col, lang_col, learn_docs, learn_windows)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        model = shared.value
        for b in batches:
            named: list[str] = []
            score: list[float] = []
            for some in cut(b["text"], AT_ONCE):
                if model is None:
                    named += ["und"] * len(some)
                    score += [0.0] * len(some)
                    continue
                total, n = model.totals(some)
                mean = total / np.maximum(n, 1)[:, None]
                best = mean.argmax(1)
                lettered = [bool(LETTER.search(t.decode())) for t in some]
                named += [model.languages[k] if ok else "und" for k, ok in zip(best.tolist(), lettered, strict=True)]
                score += [float(min(1.0, m[k])) if ok else 0.0 for m, k, ok in zip(mean, best, lettered, strict=True)]
            yield {"id": b["id"], "lang_pred": named, "score": score}

    out = map_arrow(df.selectExpr(f"`{id_col}` id", f"`{text_col}` text"), run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
    return out.select(id_col, held.alias("held_out"), "lang_pred", "score")
