"""Language identification by cross-parsing against labelled text.

For each language a suffix automaton of its training text gives the longest match from any place of a new text. Parsing
greedily into longest matches, the text costs c phrases of log2(n) bits against n training characters; the language with
the fewest phrases, weighted by log2(n) and divided by the text's length, wins.

Text is read as lower-case letters with one space for any run of other characters. To parse many texts at once, each is
cut into lanes of `LANE` characters that run side by side, first as if a phrase began at each lane. Then every lane runs again
from the state in which the lane before it ended, until both runs begin a phrase at the same place, from where on they are one. A
lane that never meets passes its new end state on, so the phrases are those of the parse of the whole text.
"""

from __future__ import annotations

import base64
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import struct, text_function

#: Bounds of the training sample of one language: documents asked of the table, and characters that whole documents fill (one document at least is taken).
TRAIN_DOCS, TRAIN_CHARS = 400, 60_000
LANE, BATCH_BYTES = 256, 4 << 20
#: Width of the dense tables of transitions of branching states; code points beyond it are looked up in sorted keys.
ALPHABET = 96
_lower: list[np.ndarray] = []
_models: dict[str, Model] = {}


def _table() -> np.ndarray:
    """Code point to lower-case letter, 32 for anything else; code points above the BMP fold to themselves if letters."""
    if not _lower:
        t = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                y = x.lower()
                t[c] = ord(y) if len(y) == 1 else c
        _lower.append(t)
    return _lower[0]


def letters(text: str | None) -> np.ndarray:
    """Code points of the normalised text, with a space at both ends; empty if it has no letter."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    t = np.concatenate(([32], _table()[raw], [32])).astype(np.uint32)
    keep = np.ones(len(t), bool)
    keep[1:] = (t[1:] != 32) | (t[:-1] != 32)
    t = t[keep]
    return t if len(t) > 1 else t[:0]


def suffix_automaton(seq: list[int]) -> list[dict[int, int]]:
    """Transitions by character of the states of the suffix automaton of `seq`; state 0 is the root."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in seq:
        cur = len(link)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return step


class Model:
    """The automata of all languages, over every code point of their texts; any other is matched by nothing.

    Most states have one transition, which is held as a pair. Of states with more, the most frequent code points have a dense
    table of transitions, the others sorted (state, code) keys.
    """

    def __init__(self, texts: Mapping[str, str]):
        self.langs = sorted(texts)
        seqs = [letters(texts[x]) for x in self.langs]
        points, n = np.unique(np.concatenate(seqs) if seqs else np.zeros(0, np.uint32), return_counts=True)
        points = points[np.argsort(-n, kind="stable")]
        self.points = len(points)
        self.code = np.full(0x110000, self.points, np.int32)
        self.code[points] = np.arange(self.points)
        self.dense = min(self.points, ALPHABET - 1)
        self.width = self.dense + 1
        self.bits = np.array([np.log2(max(2, len(s))) for s in seqs])
        self.steps = [self._tables(suffix_automaton(self.code[s].tolist())) for s in seqs]

    def _tables(self, step: list[dict[int, int]]):
        """Code and target of states with one transition; of the others the row of the dense table, the table, keys and
        targets of rare codes; the root's transitions by code."""
        ones = np.array([next(iter(d.items())) if len(d) == 1 else (-1, -1) for d in step], np.int32)
        forks = [s for s, d in enumerate(step) if len(d) > 1]
        row = np.zeros(len(step), np.int32)
        row[forks] = np.arange(1, len(forks) + 1)
        edges = np.array([(s, c, to) for s in forks for c, to in step[s].items()], np.int64).reshape(-1, 3)
        table = np.full((len(forks) + 1, self.width), -1, np.int32)
        often = edges[:, 1] < self.dense
        s, c, to = edges[often].T
        table[row[s], c] = to
        s, c, to = edges[~often].T
        keys = s * (self.points + 1) + c
        order = np.argsort(keys)
        root = np.full(self.points + 1, -1, np.int32)
        root[list(step[0])] = list(step[0].values())
        return ones[:, 0].copy(), ones[:, 1].copy(), row, table.ravel(), np.append(keys[order], np.iinfo(np.int64).max), np.append(to[order], -1).astype(np.int32), root

    def _step(self, k: int, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after codes `c`, and whether each code begins a phrase (a code that no text has is one by itself)."""
        code, target, row, table, keys, targets, root = self.steps[k]
        to = table[row[state] * self.width + np.minimum(c, self.dense)]
        one = np.flatnonzero(code[state] == c)
        to[one] = target[state[one]]
        rare = np.flatnonzero((c >= self.dense) & (c < self.points) & (to < 0))
        if len(rare):
            key = state[rare].astype(np.int64) * (self.points + 1) + c[rare]
            at = np.searchsorted(keys, key)
            to[rare] = np.where(keys[at] == key, targets[at], -1)
        begins = (state == 0) | (to < 0)
        cut = np.flatnonzero(to < 0)
        to[cut] = np.maximum(root[c[cut]], 0)
        return to, begins

    def phrases(self, columns: np.ndarray) -> np.ndarray:
        """Phrases (columns, languages) of sequences of codes in the columns of an array, -1 after the end."""
        return self.parse([c[c >= 0] for c in columns.T])

    def parse(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Phrases (texts, languages) of the greedy parse of each sequence of codes."""
        text, begin, size = (np.array(x, np.int64) for x in zip(*((i, a, min(LANE, len(s) - a)) for i, s in enumerate(seqs) for a in range(0, len(s), LANE)), strict=True)) if any(map(len, seqs)) else (np.zeros(0, np.int64),) * 3
        out = np.zeros((len(seqs), len(self.langs)), np.int64)
        if not len(text):
            return out
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        before = np.where(begin > 0, place[np.maximum(np.arange(len(order)) - 1, 0)], -1)[order]
        text, begin, size = text[order], begin[order], size[order]
        grid = np.full((int(size[0]), len(size)), self.points, np.int32)
        for j, (i, a, n) in enumerate(zip(text.tolist(), begin.tolist(), size.tolist(), strict=True)):
            grid[:n, j] = seqs[i][a : a + n]
        live = len(size) - np.searchsorted(size[::-1], np.arange(len(grid)), "right")
        for k in range(len(self.langs)):
            np.add.at(out[:, k], text, self._lanes(k, grid, live, size, before))
        return out

    def _lanes(self, k: int, grid: np.ndarray, live: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Phrases that begin in each lane (column of `grid`, `size` codes), `before` being the lane ahead of it in its text or -1."""
        own = np.zeros(grid.shape, bool)
        state = np.zeros(len(size), np.int32)
        for i, m in enumerate(live):
            state[:m], own[i, :m] = self._step(k, state[:m], grid[i, :m])
        count = own.sum(0)
        last, extra = state.copy(), np.zeros(len(size), np.int64)
        todo = np.flatnonzero(before >= 0)
        while len(todo):
            now, more, end = last[before[todo]], np.zeros(len(todo), np.int64), state[todo]
            on = np.arange(len(todo))
            for i in range(len(grid)):
                out = size[todo[on]] <= i
                if out.any():  # never met the first run
                    end[on[out]] = now[on[out]]
                    on = on[~out]
                if not len(on):
                    break
                lane = todo[on]
                now[on], begins = self._step(k, now[on], grid[i, lane])
                first = own[i, lane]
                more[on] += begins.astype(np.int64) - first
                on = on[~(begins & first)]
            else:
                end[on] = now[on]
            changed = end != last[todo]
            last[todo], extra[todo] = end, more
            todo = np.flatnonzero(np.isin(before, todo[changed]))
        return count + extra

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; the score is the runner-up's cost over the sum of the two, 0.5 to 1."""
        seqs = [self.code[letters(t)] for t in texts]
        out = []
        for s, c in zip(seqs, self.parse(seqs) * self.bits, strict=True):
            if not len(s) or not self.langs:
                out.append(("und", 0.0))
                continue
            order = np.argsort(c, kind="stable")
            second = c[order[1]] if len(order) > 1 else c[order[0]]
            out.append((self.langs[order[0]], float(second / (c[order[0]] + second))))
        return out


def train_texts(labelled: DataFrame, docs: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> dict[str, str]:
    """Training text by language from rows (doc_id, text, lang), a bounded sample of whole documents.

    Of each language about `docs` rows are drawn by a hash of doc_id and text, at a rate set from the language's count, and
    taken in the order of that hash as long as their texts fit into `chars` characters; a text that does not fit is passed
    over, but one text at least is taken. Rows with a null language or text teach nothing, an empty table gives no language; further columns, of any name, are ignored. The driver receives a hash and a length for each drawn row, then the chosen texts.
    """
    rows = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    rate = F.create_map(*(x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, docs / n)))))[F.col("lang")]
    key = F.xxhash64(F.lit("train"), "doc_id", "text")
    drawn = rows.withColumn("key", key).where(F.pmod("key", F.lit(1 << 20)) / (1 << 20) < rate)
    used, chosen = dict.fromkeys(counts, 0), set()
    for r in drawn.select("lang", F.shiftrightunsigned("key", 20).alias("turn"), "key", F.length("text").alias("n")).orderBy("lang", "turn", "key").toLocalIterator():
        if not used[r["lang"]] or used[r["lang"]] + r["n"] <= chars:
            used[r["lang"]] += max(1, r["n"])
            chosen.add(r["key"])
    out: dict[str, list[str]] = {}
    for r in drawn.where(F.col("key").isin(sorted(chosen))).dropDuplicates(["lang", "key"]).select("lang", "key", "text").orderBy("lang", "key").toLocalIterator():
        out.setdefault(r["lang"], []).append(r["text"])
    return {k: "\n".join(v) for k, v in out.items()}


def identify(docs: DataFrame, texts: Mapping[str, str]) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of `docs` (doc_id, text; further columns are ignored and never used).

    `texts` is training text by language. A text without letters, or null, is `und` with score 0; ties go to the
    language that sorts first; repeated rows and null doc_ids are kept; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dict(texts))  # a bounded sample for each language
    token = base64.b64encode(repr(sorted((k, hash(v)) for k, v in texts.items())).encode()).decode()

    def work(part: list[str | None]) -> pa.Array:
        if token not in _models:
            _models.clear()
            _models[token] = Model(shared.value)
        found = _models[token].predict(part)
        return struct(lang_pred=pa.array([x for x, _ in found], pa.string()), score=pa.array([x for _, x in found], pa.float64()))

    named = text_function(work, "lang_pred string, score double", BATCH_BYTES)("text")
    return docs.select("doc_id", named.alias("of")).select("doc_id", "of.*")
