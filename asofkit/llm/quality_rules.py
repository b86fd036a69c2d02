"""Weak supervision: rules vote good, bad or abstain; expectation-maximisation weighs them.

Each rule's vote is modelled given the hidden quality of a text (P(vote | good),
P(vote | bad)). The votes of all texts are counted per vote pattern in Spark, at
most 3^rules rows whatever the corpus, and the fit runs on these counts. A text is
then judged by its posterior probability of being good, not by passing every rule.

Null and empty texts have no words and fail the base rule. Repeated rows are judged
alike. Extra columns are ignored by ``quality_table`` and kept by ``keep_good``. On
an empty table the rules keep their starting accuracies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.text import WHITE, gram_hashes, keep_rows, map_rows, word_hashes

SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
LETTERS = UPPER + LOWER + bytes(range(128, 256))
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS, MAX_REPEAT_PCT = 50, 50


def features(text: bytes | None) -> dict[str, int]:
    """Counts of one text; words are runs of bytes other than ASCII white space."""
    text = text or b""
    h = word_hashes(text)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    n, repeated, stuttered = len(h), 0, 0
    if n >= 2:
        stuttered = int((h[1:] == h[:-1]).sum())
        if n >= 3:
            g = gram_hashes(h, 3)
            order = np.argsort(g)
            inorder = g[order]
            same = inorder[1:] == inorder[:-1]
            if same.any():
                twice = np.zeros(n - 2, bool)
                twice[order[1:][same]] = twice[order[:-1][same]] = True
                covered = np.zeros(n, bool)
                for i in range(3):
                    covered[i : n - 2 + i] |= twice
                repeated = int(covered.sum())
    dense = text.translate(None, WHITE)
    return {
        "n_words": n,
        "word_chars": len(dense.decode()),
        "n_symbols": len(text) - len(text.translate(None, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated,
        "n_lines": len(lines),
        "n_stuttered": stuttered,
        "n_upper": len(text) - len(text.translate(None, UPPER)),
        "n_lower": len(text) - len(text.translate(None, LOWER)),
        "n_shouts": text.count(b"!"),
        "n_ends": text.count(b"."),
        "n_function": int((FUNCTION_HASHES[np.minimum(np.searchsorted(FUNCTION_HASHES, h), len(FUNCTION_HASHES) - 1)] == h).sum()),
        "n_marked": marked_words(text),
        "n_bytes": len(dense),
        "n_other_bytes": len(dense.translate(None, LETTERS)),
    }


def base_failed(f: dict[str, int]) -> bool:
    return f["n_words"] < MIN_WORDS or 100 * f["n_repeat_words"] > MAX_REPEAT_PCT * f["n_words"]


@dataclass(frozen=True)
class Rule:
    """Votes bad from ``bad`` on, good up to ``good``, and abstains between."""

    name: str
    measure: str
    good: float
    bad: float

    def vote(self, m: dict[str, float]) -> int:
        x = m[self.measure]
        return 1 if x <= self.good else -1 if x >= self.bad else 0


RULES = (
    Rule("symbols", "symbols_per_word", 0.03, 0.15),
    Rule("marked words", "marked_share", 0.05, 0.30),
    Rule("letters", "non_letter_share", 0.10, 0.16),
    Rule("function words", "missing_function_words", -0.08, -0.02),
    Rule("capitals", "upper_share", 0.15, 0.45),
    Rule("shouting", "shouts_per_word", 0.05, 0.25),
    Rule("repetition", "repeat_share", 0.20, 0.45),
    Rule("stutter", "stutter_share", 0.05, 0.15),
    Rule("word length", "odd_length", 4.0, 9.0),
    Rule("full stops", "words_per_stop", 60.0, 400.0),
)

#: Common function words of the four languages, as they stand in running text.
FUNCTION_WORDS = frozenset(
    b"the of and to in is that was for on with be by this as are it at from not "
    b"le la les de des et un une est que qui dans pour au du en par sur pas il "
    b"der die das und ist von mit ein eine nicht den dem zu auf im als sich des "
    b"el los las y una por con para del se lo su al es no mi".split()
)
MARKS = b"#*$%&|<>!~^=_{}[]\\/`@"


FUNCTION_HASHES = np.sort(word_hashes(b" ".join(sorted(FUNCTION_WORDS))))


def marked_words(text: bytes) -> int:
    """Words with a character that prose rarely has."""
    if len(text.translate(None, MARKS)) == len(text):
        return 0
    return sum(len(w.translate(None, MARKS)) < len(w) for w in text.split())


def measures(f: dict[str, int]) -> dict[str, float]:
    n, letters = max(1, f["n_words"]), max(1, f["n_upper"] + f["n_lower"])
    return {
        "symbols_per_word": f["n_symbols"] / n,
        "marked_share": f["n_marked"] / n,
        "non_letter_share": f["n_other_bytes"] / max(1, f["n_bytes"]),
        "missing_function_words": -f["n_function"] / n,
        "upper_share": f["n_upper"] / letters,
        "shouts_per_word": f["n_shouts"] / n,
        "repeat_share": max(f["n_repeat_words"] / n, f["n_dup_lines"] / max(1, f["n_lines"])),
        "stutter_share": f["n_stuttered"] / n,
        "odd_length": abs(f["word_chars"] / n - 5.5),
        "words_per_stop": n / max(1, f["n_ends"]),
    }


def votes(f: dict[str, int], rules: tuple[Rule, ...] = RULES) -> list[int]:
    m = measures(f)
    return [r.vote(m) for r in rules]


@dataclass(frozen=True)
class Weights:
    """``logs[c, j, v + 1]``: log P(vote v of rule j | class c), class 1 good; ``prior``: P(good)."""

    logs: np.ndarray
    prior: float

    def posterior(self, pattern: list[int]) -> float:
        at = np.arange(self.logs.shape[1]), np.asarray(pattern) + 1
        bad, good = (self.logs[c][at].sum() for c in (0, 1))
        return float(1 / (1 + np.exp(np.clip(np.log1p(-self.prior) + bad - np.log(self.prior) - good, -700, 700))))


#: Where the fit starts, and what it leans to: votes (bad, abstain, good) given a bad and given a good text.
START = np.array([[0.30, 0.15, 0.55], [0.01, 0.09, 0.90]])


def fit_weights(patterns: list[list[int]], counts: list[int], n_rules: int, steps: int = 200, lean: float = 0.02) -> Weights:
    """EM over counted vote patterns. ``lean``: weight of the starting table, as a share of all rows."""
    tables, prior = np.repeat(START[:, None, :], n_rules, axis=1), 0.85
    if not counts:
        return Weights(np.log(tables), prior)
    v, n = np.asarray(patterns, int) + 1, np.asarray(counts, float)
    seen = np.eye(3)[v]  # pattern, rule, vote
    n /= n.sum()
    for _ in range(steps):
        logs = np.log(tables)
        score = np.einsum("pjv,cjv->cp", seen, logs) + np.log([[1 - prior], [prior]])
        good = 1 / (1 + np.exp(np.clip(score[0] - score[1], -700, 700)))
        share = np.stack([n * (1 - good), n * good])
        new = np.einsum("cp,pjv->cjv", share, seen) + lean * START[:, None, :]
        new /= new.sum(axis=2, keepdims=True)
        moved = np.abs(new - tables).max()
        tables, prior = new, float(np.clip(share[1].sum(), 0.05, 0.95))
        if moved < 1e-9:
            break
    return Weights(np.log(tables), prior)


def weigh_rules(docs: DataFrame, text: str = "text") -> Weights:
    """Fits the rules' vote tables on the votes of every text that passes the base rule."""

    def pattern(t: bytes | None):
        f = features(t)
        if not base_failed(f):
            yield (votes(f),)

    seen = map_rows(docs.select(F.col(text).cast("binary")), pattern, "pattern array<int>")
    counted = seen.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()  # 3^rules rows at most
    return fit_weights([r["pattern"] for r in counted], [r["n"] for r in counted], len(RULES))


def quality_table(docs: DataFrame, weights: Weights | None = None, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: the key, base counts, ``base_failed``, ``posterior`` of a good text and ``kept``."""
    weights = weights or weigh_rules(docs, text)

    def judge(k, t):
        f = features(t)
        failed, p = base_failed(f), weights.posterior(votes(f))
        yield (k, *(f[x] for x in FEATURES), failed, p, not failed and p >= threshold)

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, F.col(text).cast("binary")), judge, f"{key} {kind}, " + ", ".join(f"{x} long" for x in FEATURES) + ", base_failed boolean, posterior double, kept boolean")


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that ``quality_table`` keeps, with all their columns."""
    weights = weigh_rules(docs, text)

    def good(t: str | None) -> bool:
        f = features((t or "").encode())
        return not base_failed(f) and weights.posterior(votes(f)) >= threshold

    return keep_rows(docs, text, good)
