"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs, address
schemes and identifier cues. A local parser expands each anchor to its span and
validates it. Digit chains (addresses in dotted form, card numbers) have no literal
anchor; they are found as maximal digit chains, which takes linear time.

The base kinds equal leftmost non-overlapping matches of fixed patterns (email, ip,
card, phone; see ``base_spans``). Added kinds, each after a cue and each validated:
``account`` (IBAN by its check number, US social security numbers by their ranges),
``address`` (user information in a URL). Cues count in any mixture of cases, and a few
linking words may stand between a cue and its number. Added spans never overlap a base
span: where one would, its parts outside base spans are kept, those of user
information under the kind ``user``.

Offsets are code points, ends exclusive. A null or empty text has no spans. Repeated
rows are searched alike. Extra columns are ignored by ``span_table`` and kept by
``masked``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.text import map_rows

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "address", "user")
KINDS = BASE + ADDED

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LINK = r"(?:[\s:#.=(\"'-]{0,3}[^\W\d_]{1,12}(?!\w)){0,3}?[\s:#.=(\"'-]{0,3}"  # up to three words
IBAN = re.compile(LINK + r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
SOCIAL = re.compile(LINK + r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
USER_INFO = re.compile(r"([^\s/@:<>\"']++:[^\s/@<>\"']++)@[A-Za-z0-9]")

CUES = {"iban": IBAN, "ssn": SOCIAL, "social security number": SOCIAL}
SCHEMES = ("http://", "https://", "ftp://", "ssh://")


def automaton() -> ahocorasick.Automaton:
    """Anchors in lower case, as ``folded`` texts have them."""
    a = ahocorasick.Automaton()
    a.add_word("@", ("at", "@"))
    a.add_word("+", ("plus", "+"))
    for group, words in (("cue", CUES), ("scheme", SCHEMES)):
        for word in words:
            a.add_word(word, (group, word))
    a.make_automaton()
    return a


ANCHORS = automaton()
LOWER = {c: c + 32 for c in range(65, 91)}


def folded(text: str) -> str:
    """The text in lower case, each character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(LOWER)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def email_at(text: str, at: int, left: int) -> tuple[int, int] | None:
    """The address around the at-sign: its local part reaches back to ``left`` at most."""
    start = at
    while start > left and text[start - 1] in LOCAL_CHARS:
        start -= 1
    if start == at or not (m := DOMAIN.match(text, at + 1)):
        return None
    return start, m.end()


def phone_at(text: str, plus: int) -> tuple[int, int] | None:
    """The longest run after a plus sign that a number may take, valid or not."""
    m = PHONE.match(text, plus)
    return m.span() if m else None


def dotted_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Each four parts in turn of every maximal dotted chain, parts up to 255."""
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        at, parts = m.start(), m[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:] or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def iban_valid(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def account_at(text: str, cue: str, end: int) -> tuple[int, int] | None:
    """The account number after a cue, validated."""
    m = CUES[cue].match(text, end)
    if not m:
        return None
    value = m[1].replace(" ", "")
    if cue == "iban":
        for size in range(min(34, len(value)), 14, -1):  # spaces may lead into the next word
            if iban_valid(value[:size]):
                stop, left = m.start(1), size
                while left:
                    left -= text[stop] != " "
                    stop += 1
                return m.start(1), stop
        return None
    area, group, serial = value.split("-")
    return m.span(1) if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000" else None


def user_info_at(text: str, end: int) -> tuple[int, int] | None:
    m = USER_INFO.match(text, end)
    return m.span(1) if m else None


def uncovered(a: int, b: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a span outside ``taken`` spans, which are in order."""
    out = []
    for x, y in taken:
        if y > a and x < b:
            if x > a:
                out.append((a, x))
            a = max(a, y)
    return [*out, (a, b)] if a < b else out


def find_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """All spans by kind, each list in order and without overlaps."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return found
    extra: list[tuple[int, int, str]] = []
    email_end = phone_end = 0
    for last, (kind, word) in ANCHORS.iter(folded(text)):
        if kind == "at":
            if last >= email_end and (span := email_at(text, last, email_end)):
                found["email"].append(span)
                email_end = span[1]
        elif kind == "plus":
            if last >= phone_end and (span := phone_at(text, last)):
                phone_end = span[1]
                if 9 <= sum(c in "0123456789" for c in text[span[0] : span[1]]) <= 15:
                    found["phone"].append(span)
        elif kind == "cue":
            before = last - len(word)
            if (before < 0 or not text[before].isalnum()) and (span := account_at(text, word, last + 1)):
                extra.append((*span, "account"))
        elif span := user_info_at(text, last + 1):
            extra.append((*span, "address"))
    found["ip"].extend(dotted_addresses(text))
    found["card"].extend(cards(text))
    if extra:
        taken = sorted(s for k in BASE for s in found[k])
        reach = 0
        for a, b, kind in sorted(extra):
            if a >= reach:
                left = uncovered(a, b, taken)
                found["user" if kind == "address" and left != [(a, b)] else kind].extend(left)
                reach = b
    return found


def written(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def span_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, counts of the base kinds, their digest, all spans, and counts of added kinds."""

    def one(k, t):
        f = find_spans(t)
        yield (k, *(len(f[x]) for x in BASE), hashlib.sha256(written(f, BASE).encode()).hexdigest(), written(f), *(len(f[x]) for x in ADDED))

    kind = docs.schema[key].dataType.simpleString()
    counts = ", ".join(f"n_{x} long" for x in BASE)
    return map_rows(docs.select(key, text), one, f"{key} {kind}, {counts}, base_sha256 string, spans string, " + ", ".join(f"n_{x} long" for x in ADDED))


def mask(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union is replaced once."""
    if not text:
        return text
    found = find_spans(text)
    spans = sorted((a, b, k) for k in KINDS for a, b in found[k])
    if not spans:
        return text
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """The rows with personal data masked; ``chars``, where there is such a column, holds the new length."""
    columns = docs.columns

    def run(batches):
        for batch in batches:
            at = columns.index(text)
            new = [mask(v.as_py()) for v in batch.column(at)]
            arrays = list(batch.columns)
            arrays[at] = pa.array(new, batch.schema.field(at).type)
            out = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            yield out

    done = docs.mapInArrow(run, docs.schema)
    if chars in columns:
        kind = docs.schema[chars].dataType
        done = done.withColumn(chars, F.coalesce(F.length(F.col(text)).cast(kind), F.col(chars)))
    return done
