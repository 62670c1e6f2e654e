"""SentencePiece models of the merge type: encoding by backtracking, and decoding.

A merge-type encoder joins the best-scored adjacent pair of parts, the leftmost of equal ones, until no pair is a piece. Two
facts give its result without doing the merges of a whole text:

* Merges inside a span happen in the order in which they would happen if the span stood alone. So a sequence of pieces is the
  encoding of its text exactly if every two neighbours, merged anew as a text of their own, come out as these two pieces.
* Where two characters stand side by side in no piece, no merge can join them, so a text falls apart into short spans there.

Within a span an Aho-Corasick automaton finds the longest piece at every place. Pieces are tried from the longest to its shorter
prefixes, each checked against the piece before it. Where none fits, the place is marked as failed in a bitfield and the
last piece is taken back. Only one encoding of a prefix exists, so a place that failed once never has to be tried again.

Supported are models of the merge type with byte fallback, the identity normalizer and no user-defined or unused pieces;
others raise ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .arrow import list_function, struct, text_function

SPACE = "▁"
SLICE_CHARS = 1 << 20  # characters of a text that are looked through at once
MEMO_SPANS, MEMO_CHARS, MEMO_PAIRS = 1 << 18, 48, 1 << 18
#: Kinds of pieces and the merge type, as model files number them.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_TYPE = 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift += 7
            at += 1
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            if size is None:
                size, at = varint(at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


class Model:
    """The pieces of a model file; `encode` and `decode` work as the library's do."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        trainer = dict(x for n, v in parts if n == 2 for x in _fields(v))
        rules = dict(x for n, v in parts if n == 3 for x in _fields(v))
        pieces = [dict(_fields(v)) for n, v in parts if n == 1]
        kinds = [p.get(3, NORMAL) for p in pieces]
        names = [p.get(1, b"").decode() for p in pieces]
        if trainer.get(3, 1) != MERGE_TYPE or not trainer.get(35, 0) or kinds.count(BYTE) != 256:
            raise ValueError("not a model of the merge type with byte fallback")
        if rules.get(2, b"") or rules.get(4, 1) or not rules.get(5, 1) or trainer.get(24, 0):
            raise ValueError("the model has a normalizer other than identity, or treats white space as a suffix")
        if USER_DEFINED in kinds or UNUSED in kinds:
            raise ValueError("the model has user-defined or unused pieces")
        self.prefix = SPACE if rules.get(3, 1) else ""
        self.unknown = trainer.get(44, " ⁇ ".encode())
        self.bos, self.eos = (names.index(trainer.get(n, d).decode()) for n, d in ((46, b"<s>"), (47, b"</s>")))
        self.score = {s: np.frombuffer(p[2], "<f4").item() if 2 in p else 0.0 for s, k, p in zip(names, kinds, pieces, strict=True) if k == NORMAL}
        self.id = {s: i for i, (s, k) in enumerate(zip(names, kinds, strict=True)) if k == NORMAL}
        self.byte = np.zeros(256, np.int32)
        for i in (i for i, k in enumerate(kinds) if k == BYTE):
            self.byte[int(names[i][1:-1], 16)] = i
        self.kinds = kinds
        self.surface = [s.replace(SPACE, " ").encode() if k == NORMAL else bytes([int(s[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else self.unknown for s, k in zip(names, kinds, strict=True)]
        self.silent = {i for i, k in enumerate(kinds) if k in (CONTROL, UNKNOWN)}
        self.bytes_of = [np.array(self.byte[list(t.encode("utf-8", "surrogatepass"))] if t not in self.id else [self.id[t]], "<i4").tobytes() for t in self._table()]

    def _table(self) -> list[str]:
        """Number the tokens: pieces, and characters that occur in pieces only, as they are parts of merges, too. Build what encoding looks up."""
        self.tokens = [*self.id, *sorted(set("".join(self.id)) - self.id.keys())]
        self.length = [len(t) for t in self.tokens]
        number = {t: k for k, t in enumerate(self.tokens)}
        self.shorter = [next((number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in number), -1) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for t, k in number.items():
            self.automaton.add_word(t, k)
        self.automaton.make_automaton()
        pairs = {(ord(a), ord(b)) for t in self.id for a, b in zip(t, t[1:], strict=False)}
        self.seams = np.sort(np.array([a << 32 | b for a, b in pairs], np.int64))
        self.spans: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        return self.tokens

    def merged(self, text: str) -> list[str]:
        """The parts of `text` after all merges; for short texts."""
        parts = list(text)
        while True:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and score > best:
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, key: int) -> bool:
        """Whether two tokens (left * number of tokens + right; left is -1 at the start) come out as they are when merged anew."""
        left, right = divmod(key, len(self.tokens))
        parts = [self.tokens[left], self.tokens[right]] if left >= 0 else [self.tokens[right]]
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        self.pairs[key] = fits = self.merged("".join(parts)) == parts
        return fits

    def _span(self, text: str) -> list[int]:
        """The tokens of a span whose characters are all tokens, by backtracking."""
        length, shorter, pairs, n = self.length, self.shorter, self.pairs, len(self.tokens)
        size = len(text)
        longest = [0] * (size + 1)
        for end, k in self.automaton.iter(text):
            longest[end - length[k] + 1] = k  # ends ascend, so the last one is the longest
        failed: bytearray | None = None  # bitfield of the places that no encoding goes through
        found: list[int] = []
        at, base, token = 0, -n, longest[0]
        while at < size:
            while token >= 0:
                end = at + length[token]
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    fits = pairs.get(base + token)
                    if self._fits(base + token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                found.append(token)
                at, base, token = end, token * n, longest[end]
            else:
                if failed is None:
                    failed = bytearray(size // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                token = found.pop()
                at -= length[token]
                base = found[-1] * n if found else -n
        return found

    def _ids(self, span: str) -> bytes:
        """Ids of a span that is not in the memo."""
        if len(span) == 1 and span not in self.automaton:
            return self.byte[list(span.encode("utf-8", "surrogatepass"))].astype("<i4").tobytes()
        ids = b"".join(map(self.bytes_of.__getitem__, self._span(span)))
        if len(span) <= MEMO_CHARS:
            if len(self.spans) >= MEMO_SPANS:
                self.spans.clear()
            self.spans[span] = ids
        return ids

    def encode(self, text: str | None, bos: bool = False, eos: bool = False) -> bytes:
        """Ids of a text as little-endian integers of four bytes; null is empty."""
        out = [np.int32(self.bos).tobytes()] if bos else []
        if text:
            text = self.prefix + text.replace(" ", SPACE)
            held = ""  # the span that goes on in the next slice
            for start in range(0, len(text), SLICE_CHARS):
                part = text[start : start + SLICE_CHARS + 1]  # and the first character of the next slice
                code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                pair = code[:-1] << 32 | code[1:]
                near = np.minimum(np.searchsorted(self.seams, pair), len(self.seams) - 1)
                cuts = [0, *(np.flatnonzero(self.seams[near] != pair) + 1).tolist()]
                spans = [part[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                if spans:
                    spans[0], held = held + spans[0], ""
                out += [self._ids(x) if ids is None else ids for x, ids in zip(spans, map(self.spans.get, spans), strict=True)]
                held += part[cuts[-1] : SLICE_CHARS]
            if held:
                out.append(self.spans.get(held) or self._ids(held))
        if eos:
            out.append(np.int32(self.eos).tobytes())
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids are silent, the prefix's space goes, bytes that are no UTF-8 become U+FFFD one by one."""
        first, last = 0, len(ids)
        while first < last and self.kinds[ids[first]] == CONTROL:
            first += 1
        while last > first and self.kinds[ids[last - 1]] == CONTROL:
            last -= 1
        own = ids[first:last]
        if not own:
            return ""
        skip = 1 if self.prefix and self.kinds[own[0]] == NORMAL and self.surface[own[0]].startswith(b" ") else 0
        try:
            if not self.silent.isdisjoint(own):
                raise UnicodeError
            return b"".join(map(self.surface.__getitem__, own))[skip:].decode()
        except UnicodeError:
            return self._decode_runs(own)

    def _decode_runs(self, ids: list[int]) -> str:
        text, run = "", b""
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == BYTE:
                run += self.surface[i]
                continue
            text += _lenient(run)
            run = b""
            if i is not None:
                piece = self.surface[i].decode()
                text += piece[1:] if not text and self.prefix and self.kinds[i] == NORMAL and piece.startswith(" ") else piece
        return text


_CHARACTER = re.compile(rb"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}|(?s:.)")


def _lenient(raw: bytes) -> str:
    """UTF-8, each byte that is part of no character as U+FFFD."""
    return "".join(x.decode("utf-8", "replace") for x in _CHARACTER.findall(raw))


_loaded: dict[str, Model] = {}


def model_of(path: str) -> Model:
    """The model of a file that every machine has at `path`; read once in each worker."""
    if path not in _loaded:
        _loaded[path] = Model(path)
    return _loaded[path]


def encode_column(text: Column | str, path: str, bos: bool = False, eos: bool = False) -> Column:
    """Ids (array<int>) of a string column, as the model at `path` gives them; with the begin and end ids if asked for.

    Null is the empty text, which has no ids of its own. Whole texts are encoded, in slices of `SLICE_CHARS` characters whose last
    span goes on in the next; a span without a place to cut, such as one character repeated a million times, is encoded whole,
    in time and memory in proportion to its length.
    """

    def work(texts: list[str | None]) -> pa.Array:
        model = model_of(path)
        coded = [model.encode(t, bos, eos) for t in texts]
        ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in coded])))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4")))

    return text_function(work, "array<int>")(text)


def decode_column(ids: Column | str, path: str) -> Column:
    """The text of a column of ids (array<int>); null is empty, a null id or one outside the model raises."""
    return list_function(lambda lists: pa.array([model_of(path).decode(x or []) for x in lists.to_pylist()], pa.string()), "string")(ids)


def encode_documents(docs: DataFrame, path: str, bos: bool = True, eos: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for each row of `docs` (doc_id, text; further columns, of any name, are ignored).

    ids is binary, four bytes for each id with the lowest first, which is how token ids are stored for training; `encode_column` gives
    arrays. decoded is the text that the model decodes these ids to. A null or empty text has only the begin and end ids and decodes to the empty
    text; very long texts are encoded whole (see `encode_column`); repeated rows and null doc_ids are kept; an empty table gives no rows. Nothing is
    shuffled, texts enter Python once, and doc_id never does.
    """

    def work(texts: list[str | None]) -> pa.Array:
        model = model_of(path)
        coded = [model.encode(t, bos, eos) for t in texts]
        text = pa.array([model.decode(np.frombuffer(x, "<i4").tolist()) for x in coded], pa.string())
        return struct(n_tokens=pa.array([len(x) // 4 for x in coded], pa.int64()), ids=pa.array(coded, pa.binary()), decoded=text)

    made = text_function(work, "struct<n_tokens:bigint,ids:binary,decoded:string>")("text")
    return docs.select("doc_id", made.alias("made")).select("doc_id", "made.*")
