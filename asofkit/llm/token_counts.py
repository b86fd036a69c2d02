"""Token counts of a word-level BPE vocabulary, without emitting ids.

A word starts as one symbol per UTF-8 byte, the last one marked as word end. A heap
holds adjacent pairs that a merge rule knows; the lowest rank, leftmost on ties, is
popped, its two symbols are joined in a linked list, and the new neighbours are
pushed. The count is the number of initial symbols less the merges done. Words are
independent, so counts are remembered by word.

Words come from lower-cased text by the vocabulary's own pattern. Characters beyond
Latin, whose normal forms and classes depend on Unicode tables, are split by the
vocabulary file's own normaliser and splitter. Special strings inside a text count as
one token each, as the vocabulary's library does by default.

A null text is empty and has 0 tokens. Repeated rows count alike; extra columns are
ignored.
"""

from __future__ import annotations

import heapq
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.text import Memo, map_rows

#: Characters whose class and normal form do not depend on Unicode tables newer than Latin Extended-B.
BEYOND = re.compile("[^\\x00-\\x1b\\x20-\\x84\\x86-ɏ‐-‧€]")
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏⱥⱦɐ-ʯ]+|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ɏⱥⱦɐ-ʯ0-9²³¹¼-¾]+")


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class MergeCounter:
    """Counts tokens by the merge rules of a tokenizer file's text (JSON)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.source, self.library = source, None
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))))
        ids = model["vocab"]
        signs, suffix = byte_characters(), model["end_of_word_suffix"]
        self.inner = [ids[c] for c in signs]
        self.final = [ids[c + suffix] for c in signs]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank, self.joined = {}, []
        for rank, (a, b) in enumerate(pairs):
            self.rank[ids[a] << 16 | ids[b]] = rank
            self.joined.append(ids[a + b])
        self.by_word = Memo(self.count_word, 700_000)
        self.by_chunk = Memo(lambda chunk: sum(map(self.by_word.__getitem__, WORDS.findall(chunk))), 400_000)

    def count_word(self, word: str) -> int:
        raw = word.encode()
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.final[raw[-1]]
        return len(symbols) - self.merges(symbols)

    def merges(self, symbols: list[int]) -> int:
        """How many merges end with no rule left to apply; lowest rank first, leftmost on ties.

        A heap entry is rank << 32 | place of the left symbol; symbols of 16 bits make a pair's key.
        """
        n, rank_of, joined, done = len(symbols), self.rank.get, self.joined, 0
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            if (r := rank_of(symbols[i] << 16 | symbols[i + 1])) is not None:
                heap.append(r << 32 | i)
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            j = right[i]
            if j >= n or symbols[i] < 0 or rank_of(symbols[i] << 16 | symbols[j]) != rank:
                continue  # a symbol of this pair has been merged since
            symbols[i], symbols[j] = joined[rank], -1
            right[i] = k = right[j]
            done += 1
            if k < n:
                left[k] = i
                if (r := rank_of(symbols[i] << 16 | symbols[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            if (h := left[i]) >= 0 and (r := rank_of(symbols[h] << 16 | symbols[i])) is not None:
                heapq.heappush(heap, r << 32 | h)
        return done

    def plain(self, text: str) -> int:
        if not BEYOND.search(text):
            return sum(map(self.by_chunk.__getitem__, text.lower().split()))
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.source)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        back = self.__dict__.setdefault("byte_of", {c: b for b, c in enumerate(byte_characters())})
        total = 0
        for piece, _ in pieces:
            total += self.by_word[bytes(back[c] for c in piece).decode(errors="surrogateescape")] if piece else 0
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)


COUNTERS = Memo(MergeCounter, 4)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, UTF-8 bytes, tokens, and whether the tokens exceed ``limit``.

    ``vocabulary``: path of a tokenizer JSON file on the driver; its text (a fixed
    file, under 2 MB) goes to the executors by broadcast.
    """
    with open(vocabulary, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def one(k, t):
        n = COUNTERS[source.value].count(t)
        yield (k, len(t.encode()) if t else 0, n, n > limit)

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(F.col(key), F.col(text)), one, f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean")
