"""SentencePiece encoding by unigram Viterbi over a double-array trie, and decoding.

Spaces become the whitespace marker and one marker is put in front. The best path
maximises the sum of piece scores; a character that no piece covers falls back to its
UTF-8 byte pieces. No piece has a marker after another character (checked when the
pieces are read), so no path crosses such a place and the runs between them are
solved independently and remembered.

A null text gives null ids, an empty one none. Decoding gives back the text, except
that a marker character in the source comes back as a space. Repeated rows encode
alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.text import Memo

MARK = "▁"
RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
UNKNOWN_PENALTY = 10.0


class DoubleArray:
    """A trie in two integer arrays: child = base[node] + code, valid if check[child] == node."""

    def __init__(self, words: dict[str, int]):
        self.codes = {c: i + 1 for i, c in enumerate(sorted({c for w in words for c in w}))}
        tree: dict = {}
        for word, value in words.items():
            node = tree
            for c in word:
                node = node.setdefault(self.codes[c], {})
            node[0] = value
        width = len(self.codes) + 1
        size = 4 * width + 4 * sum(len(w) for w in words)
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0], free = 0, 1
        todo = [(0, tree)]
        while todo:
            at, node = todo.pop()
            if 0 in node:
                self.value[at] = node[0]
            codes = sorted(c for c in node if c)
            if not codes:
                continue
            b = first = max(1, free - codes[0])
            while any(self.check[b + c] != -1 for c in codes):
                b += 1
            if b - first > 50:  # the places before are nearly full
                free = b + codes[0]
            self.base[at] = b
            for c in codes:
                self.check[b + c] = at
                todo.append((b + c, node[c]))
        end = max(i for i, x in enumerate(self.check) if x != -1) + width + 1
        for name in ("base", "check", "value"):
            setattr(self, name, getattr(self, name)[:end])


@dataclass(frozen=True)
class PieceSet:
    """Pieces by id with their scores; ``byte_ids``: the id of each byte's piece."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    usable: tuple[bool, ...]
    byte_ids: tuple[int, ...]


def read_pieces(path: str) -> PieceSet:
    """The pieces of a model file, read on the driver; their number is fixed by the file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(p.get_piece_size())
    names = tuple(p.id_to_piece(i) for i in ids)
    special = [p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i) for i in ids]
    if any(a != MARK and b == MARK for n, s in zip(names, special, strict=True) if not s for a, b in zip(n, n[1:], strict=False)):
        raise ValueError("a piece has the whitespace marker after another character")
    by_name = {names[i]: i for i in ids if p.is_byte(i)}
    return PieceSet(names, tuple(p.get_score(i) for i in ids), tuple(not s for s in special), tuple(by_name[f"<0x{b:02X}>"] for b in range(256)))


class PieceCoder:
    """Encodes and decodes with one set of pieces."""

    def __init__(self, source: PieceSet):
        self.source = source
        self.trie = DoubleArray({p: i for i, (p, u) in enumerate(zip(source.pieces, source.usable, strict=True)) if u})
        self.unknown = min(s for s, u in zip(source.scores, source.usable, strict=True) if u) - UNKNOWN_PENALTY
        self.raw = [p.replace(MARK, " ").encode() if u else b"" for p, u in zip(source.pieces, source.usable, strict=True)]
        for b, i in enumerate(source.byte_ids):
            self.raw[i] = bytes([b])
        self.by_run = Memo(lambda run: tuple(self.best_path(MARK + run)), 300_000)

    def best_path(self, text: str) -> list[int]:
        """Viterbi over all segmentations; on equal sums the longest first piece of those found first stays."""
        n, scores, trie = len(text), self.source.scores, self.trie
        base, check, value = trie.base, trie.check, trie.value
        codes = [trie.codes.get(c, 0) for c in text]
        best, back = [-np.inf] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here, node, single = best[i], 0, False
            for j in range(i, n):  # down the trie along the text
                code = codes[j]
                child = base[node] + code
                if not code or check[child] != node or not base[node]:
                    break
                node = child
                piece = value[node]
                if piece >= 0:
                    single |= j == i
                    s = here + scores[piece]
                    if s > best[j + 1]:
                        best[j + 1], back[j + 1] = s, (i, piece)
            if not single and here + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = here + self.unknown, (i, -1)
        out: list[int] = []
        at = n
        while at:
            start, piece = back[at]
            out.extend([piece] if piece >= 0 else [self.source.byte_ids[b] for b in reversed(text[start:at].encode())])
            at = start
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        runs = text.replace(MARK, " ").split(" ")
        if "" in runs:
            runs = [r[1:] for r in RUNS.findall(MARK + MARK.join(runs))]
        return list(chain.from_iterable(map(self.by_run.__getitem__, runs)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace")[1:]


CODERS = Memo(PieceCoder, 2)


def encode_texts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, token_ids, n_tokens, n_byte_tokens, n_chars_decoded, and whether decoding gives the text back."""
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(model))  # as many as the file has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = CODERS[pieces.value]
        is_byte = np.zeros(len(pieces.value.pieces), bool)
        is_byte[list(pieces.value.byte_ids)] = True
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                flat, ends, rest = [], [0], []
                for value in part.column(1):
                    t = value.as_py()
                    ids = np.fromiter(own := coder.encode(t or ""), np.int32, len(own))
                    back = coder.decode(own)
                    flat.append(ids)
                    ends.append(ends[-1] + len(ids))
                    rest.append((None if t is None else len(ids), None if t is None else int(is_byte[ids].sum()), None if t is None else len(back), None if t is None else back == t.replace(MARK, " ")))
                offsets = pa.array([None if r[0] is None else e for r, e in zip(rest, ends, strict=False)] + [ends[-1]], pa.int32())
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat), pa.int32()))
                cols = [pa.array(c, k) for c, k in zip(zip(*rest, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), ids, *cols], names=[key, "token_ids", "n_tokens", "n_byte_tokens", "n_chars_decoded", "round_trip"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, token_ids array<int>, n_tokens long, n_byte_tokens long, n_chars_decoded long, round_trip boolean")
