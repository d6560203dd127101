"""Personal items in free text: finding them and putting typed placeholders in their place."""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.crf import TokenScores, emissions, train, viterbi
from threadloom.llm.pii_table import TYPES, labelled_table

#: Labels: 0 outside, then the first and the further tokens of each type.
N_LABELS = 1 + 2 * len(TYPES)
PLACEHOLDERS = {t: f"[{t.upper()}]" for t in TYPES}

_TOKEN = re.compile(r"[^\S\n]+|[^\W\d_]+|\d+|.|\n", re.DOTALL)
#: Marks a token that follows the one before without a blank, a word whose spelling is hidden, a chain of numbers, and the
#: shapes around a token.
GLUED, HIDDEN, CHAIN, AROUND = "\x01", "\x02", "\x03", "\x04"
#: Shares of the words of names, and of other words, in the labelled table whose spelling is hidden, so that shapes and
#: neighbours are learned too.
HIDE_NAMES, HIDE_OTHERS = 0.5, 0.3
#: Shapes: border, capital alone, capitals, capitalised, small, mixed, number, and signs of which some stand for themselves.
_SHAPES = "^IUClm9s.,-'(@№"
_WIDE = {ord("０") + i: str(i) for i in range(10)}
#: Numbers, and codes of capitals and digits, with what may stand between their groups.
_CHAIN = re.compile(
    r"(?:[+＋][(（]?|[(（])?(?:[A-Z]{1,4}[ -]?(?=\d))?\d[\dA-Z]*(?:(?:[ \u00a0.\-‑–/№)）(（]|[)）][ \u00a0-]|[ \u00a0][(（]|[ \u00a0]№[ \u00a0]?)[A-Z]{0,2}\d[\dA-Z]*)*(?:[ -]?[A-Z](?![^\W\d_]))?"
)


def chains_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, pattern) of the chains of numbers in a text; the pattern keeps signs and lengths of groups."""
    return [(m.start(), m.end(), CHAIN + _pattern(m.group())) for m in _CHAIN.finditer(text)]


@lru_cache(maxsize=500_000)
def _shape(token: str) -> int:
    """Number of a token's shape in ``_SHAPES``."""
    if token[:1].isalpha():
        kind = ("I" if len(token) == 1 else "U") if token.isupper() else "l" if token.islower() else "C" if token[0].isupper() and token[1:].islower() else "m"
    else:
        kind = "9" if token.isdigit() else token if token in _SHAPES[8:] else "s"
    return _SHAPES.index(kind)


def surroundings(shapes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One number per token for its shape and those of two neighbours on each side within its sequence."""
    place, code = np.arange(len(shapes)), np.zeros(len(shapes), np.int64)
    for offset in (-2, -1, 0, 1, 2):
        at = place + offset
        inside = (at >= begins) & (at < ends)
        code *= len(_SHAPES)
        code[inside] += shapes[at[inside]]
    return code


def around(code: int) -> str:
    """The mark of a number of ``surroundings``."""
    out = ""
    for _ in range(5):
        code, kind = divmod(code, len(_SHAPES))
        out = _SHAPES[kind] + out
    return AROUND + out


@lru_cache(maxsize=200_000)
def _pattern(chain: str) -> str:
    chain = chain.translate(_WIDE)
    first = re.match(r"[^\d]*(00|0|[789]|\d)", chain)
    shape = re.sub(r"\d+", lambda m: str(len(m.group())), re.sub(r"[A-Z]", "A", chain.replace("\u00a0", " ").replace("‑", "-").replace("–", "-")))
    return f"{first.group(1) if first and first.group(1) in ('00', '0', '7', '8', '9') else '5'}|{sum(map(str.isdigit, chain))}|{shape[:40]}"


def tokens_of(text: str) -> list[str]:
    """Pieces of a text that put together give it again: blanks, words, digits and single signs."""
    return _TOKEN.findall(text)


def normal_form(token: str) -> str:
    """What the features of a token depend on: digits but leading zeros are alike."""
    if token[0] in (CHAIN, AROUND):
        return token
    if token.isdigit():
        plain = token.translate(_WIDE)
        wide = "w" if plain != token else ""
        rest = plain.lstrip("0")
        lead = rest[:1] if rest[:1] in "789" and len(plain) in (1, 11) else "9" if rest else ""
        return wide + "0" * (len(plain) - len(rest)) + lead + "9" * (len(rest) - 1 if rest else 0)
    return token


def features(token: str) -> Iterable[str]:
    """Word-shape features of a token in normal form; GLUED before it tells that no blank stands there."""
    if token[0] == CHAIN:
        first, digits, shape = token[1:].split("|", 2)
        signs = "".join(sorted(set(re.sub(r"[\dA]", "", shape))))
        start = shape[0] if shape[0] in "+＋(（A" else first
        yield "chain"
        yield f"chain:{shape}"
        yield f"chain:{first}:{shape}"
        yield f"chain:{digits}"
        yield f"chain:{start}:{digits}"
        yield f"chain:{signs}:{min(len(re.findall(r'[0-9]+', shape)), 6)}"
        yield f"chain:{start}:{signs}"
        if "A" in shape:
            yield f"chain:letters:{shape.count('A')}:{digits}"
        return
    if token[0] == AROUND:
        for lo, hi in ((0, 5), (0, 3), (1, 3), (1, 4), (2, 4), (2, 5)):
            yield f"around{lo}:{token[1 + lo : 1 + hi]}"
        return
    yield "bias"
    if token[0] == GLUED:
        yield "glued"
        token = token[1:]
        if not token[:1].isalnum():
            yield "glued=" + token
    hidden = token[:1] == HIDDEN
    token = token[hidden:]
    if token[-1:] in "0123456789":
        yield "number"
        yield f"number:{min(len(token), 13)}"
        yield "=" + token[:14]
        zeros = len(token.lstrip("w")) - len(token.lstrip("w").lstrip("0"))
        yield f"zeros:{min(zeros, 3)}"
        return
    if not token[:1].isalpha():
        yield "=" + token
        yield "sign"
        return
    low = token.lower()
    shape = "X" if token.isupper() and len(token) == 1 else "XX" if token.isupper() else "xx" if token.islower() else "Xx" if token[0].isupper() and token[1:].islower() else "xX"
    script = "cyr" if "Ѐ" <= low[0] <= "ӿ" else "lat"
    yield "word"
    yield "shape:" + shape
    yield f"shape:{shape}:{script}"
    yield f"long:{min(len(low), 12)}"
    for n in (2, 3, 4):
        if len(low) > n:
            yield f"end{n}:" + low[-n:]
    if len(low) > 3:
        yield f"{shape}:end3:{low[-3:]}"
    if not hidden:
        yield "=" + low
        if len(low) > 4:
            yield "start4:" + low[:4]


def fit(table: Iterable[list[tuple[str, str | None]]]) -> tuple[np.ndarray, dict[str, int], np.ndarray, np.ndarray]:
    """The field that a labelled table of sentences teaches."""
    chance = random.Random(11)
    sequences, marks, labels = [], [], []
    for sentence in table:
        tokens: list[str] = []
        parts: list[str] = []
        own: list[int] = []
        shapes: list[int] = []
        # Pieces are split together, as running text would be.
        text = "".join(p for p, _ in sentence)
        owner = np.concatenate([np.full(len(p), i) for i, (p, _) in enumerate(sentence)])
        chain_at = {i: pattern for lo, hi, pattern in chains_of(text) for i in range(lo, hi)}
        at, before, glued = 0, -1, False
        for token in tokens_of(text):
            piece, begin = int(owner[at]), at
            at += len(token)
            if token.isspace():
                glued = False
                continue
            kind = sentence[piece][1]
            own.append(0 if kind is None else 1 + 2 * TYPES.index(kind) + (before == piece))
            hide = token[0].isalpha() and chance.random() < (HIDE_NAMES if kind == "name" else HIDE_OTHERS)
            shapes.append(_shape(token))
            tokens.append(GLUED * glued + HIDDEN * hide + normal_form(token))
            parts.append(chain_at.get(begin, ""))
            before, glued = piece, True
        size = np.full(len(tokens), len(tokens))
        codes = surroundings(np.array(shapes, np.int64), np.zeros_like(size), size)
        sequences.append(tokens)
        marks.append([part or around(int(code)) for part, code in zip(parts, codes, strict=True)])
        labels.append(own)
    return train(sequences, marks, labels, N_LABELS, features)


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, dict[str, int], np.ndarray, np.ndarray]:
    """The trained field; training takes some seconds once per process that asks for it."""
    return fit(labelled_table())


# ------------------------------------------------------------------------------------------- exact check

_MAIL = re.compile(
    r"(?<![\w.+'’-])[\w.+'’-]++(?:\s?[@＠]\s?|\s?[\[({]\s?(?:at|собака|arroba)\s?[\])}]\s?|\s+(?:собака|arroba)\s+|\s+at\s+(?=[\w-]+\s+dot\s))"
    r"[\w-]+(?:(?:\.|\s?[\[({]\s?(?:dot|точка|punto)\s?[\])}]\s?|\s+(?:точка|dot|punto)\s+)[\w-]+)*",
    re.IGNORECASE,
)
_NUMBER_START = re.compile(r"[+＋(（]*\d|[A-Za-z]")
_PHONE_START = re.compile(r"[+＋]?[(（]?\d")


@lru_cache(maxsize=64)
def _mails(line: str) -> list[re.Match]:
    """Everything in a line that is spelled like a mailbox; once per line, however many items it holds."""
    return list(_MAIL.finditer(line))


def _check(kind: str, line: str, lo: int, hi: int) -> tuple[int, int] | None:
    """The exact bounds of a candidate item, or None where it can't be one."""
    text = line[lo:hi]
    if kind == "email":
        for m in _mails(line):
            if m.start() < hi and lo < m.end():
                host = re.split(r"[@＠]|\bat\b|собака|arroba", m.group(), flags=re.IGNORECASE)[-1]
                tail = re.split(r"[.\s\])}]", host.strip(" ])}."))[-1]
                if re.search(r"[^\W\d_]", tail) and len(host) > 2:
                    return m.start() + (len(m.group()) - len(m.group().lstrip(".'’-+"))), m.end()
        return None
    if kind == "phone":
        m = _PHONE_START.search(text)
        if m is None or not 7 <= sum(ch.isdigit() for ch in text) <= 20:
            return None
        return lo + m.start(), hi
    if kind == "id_number":
        m = _NUMBER_START.search(text)
        if m is None or not 6 <= sum(ch.isdigit() for ch in text) <= 16:
            return None
        return lo + m.start(), hi
    m = re.search(r"\w", text)
    if m is None:
        return None
    if kind == "address":
        return (lo + m.start(), hi) if any(ch.isdigit() for ch in text) and re.search(r"[^\W\d_]{2}", text) else None
    words = re.findall(r"[^\W\d_]+", text)
    if len(words) < 2 or not any(len(w) > 1 for w in words):
        return None
    return lo + m.start(), hi


class Finder:
    """Finds the personal items of batches of texts with a trained field."""

    def __init__(self, trained: tuple[np.ndarray, dict[str, int], np.ndarray, np.ndarray]) -> None:
        weights, index, self.transitions, self.first = trained
        self.scores = TokenScores(weights, index, features, normal_form, GLUED)

    def lines(self, lines: list[str]) -> dict[int, list[tuple[str, int, int]]]:
        """(type, start, end) items, in code points, by number of line; ``lines`` hold no line feed."""
        found: dict[int, list[tuple[str, int, int]]] = {}
        if not lines:
            return found
        tokens = tokens_of("\n".join(lines))
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        start = np.cumsum(size) - size
        feed = np.fromiter((t == "\n" for t in tokens), bool, len(tokens))
        blank = np.fromiter((t.isspace() for t in tokens), bool, len(tokens))
        keep = np.flatnonzero(~blank)
        if not len(keep):
            return found
        spans = chains_of("\n".join(lines))
        kept = [tokens[i] for i in keep]
        line_of = np.cumsum(feed)[keep]
        starts = np.flatnonzero(np.r_[True, np.diff(line_of) > 0])
        lengths = np.diff(np.r_[starts, len(keep)])
        begins, ends = np.repeat(starts, lengths), np.repeat(starts + lengths, lengths)
        codes, which = np.unique(surroundings(np.fromiter(map(_shape, kept), np.int64, len(kept)), begins, ends), return_inverse=True)
        every = self.scores.ids(kept + [around(int(c)) for c in codes] + [c[2] for c in spans])
        ids, marks, rows = np.split(every, [len(kept), len(kept) + len(codes)])
        marks = marks[which]
        glued = np.zeros(len(keep), np.int64)
        glued[1:] = (np.diff(keep) == 1) & (np.diff(line_of) == 0)
        ids += glued
        chain_from = np.array([c[0] for c in spans], np.int64)
        chain_to = np.array([c[1] for c in spans], np.int64)
        inside = np.searchsorted(chain_from, start[keep], side="right") - 1
        chained = np.flatnonzero((inside >= 0) & (start[keep] < np.append(chain_to, 0)[inside]))
        marks[chained] = rows[inside[chained]]
        score = emissions(self.scores.table, ids, begins, ends, marks)
        labels = viterbi(score, starts, lengths, self.transitions, self.first)
        kind = (labels + 1) // 2  # 0 outside, then the type from 1
        inside = np.flatnonzero(kind)
        if not len(inside):
            return found
        opens = np.ones(len(inside), bool)
        opens[1:] = (np.diff(inside) > 1) | (np.diff(line_of[inside]) > 0) | (np.diff(kind[inside]) != 0) | (labels[inside[1:]] % 2 == 1)
        first_of = np.flatnonzero(opens)
        last_of = np.r_[first_of[1:], len(inside)] - 1
        line_start = np.cumsum([0, *[len(x) + 1 for x in lines]])
        for a, b in zip(inside[first_of], inside[last_of], strict=True):
            n = int(line_of[a])
            lo, hi = int(start[keep[a]] - line_start[n]), int(start[keep[b]] + size[keep[b]] - line_start[n])
            name = TYPES[int(kind[a]) - 1]
            exact = _check(name, lines[n], lo, hi)
            if exact is not None:
                items = found.setdefault(n, [])
                if not items or exact[0] >= items[-1][2]:
                    items.append((name, *exact))
        return found

    def texts(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """The items of each text; a line that occurs in several texts is looked at once."""
        number: dict[str, int] = {}
        where: list[list[tuple[int, int]]] = []
        for text in texts:
            at, own = 0, []
            for line in (text or "").split("\n"):
                if line:
                    own.append((number.setdefault(line, len(number)), at))
                at += len(line) + 1
            where.append(own)
        found = self.lines(list(number))
        if not found:
            return [[] for _ in texts]
        return [[(k, lo + at, hi + at) for n, at in own if n in found for k, lo, hi in found[n]] for own in where]


def find_items(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(row_key, pii_type, start_codepoint, end_codepoint): every personal item of every row.

    Types are email, phone, id_number, address and name; positions count code points from 0, the end is
    exclusive. Null and empty texts hold none; repeated rows give their items repeatedly; keys come out as
    they are; other columns are ignored; an empty table gives an empty table. Items don't cross lines.

    Tokens are labelled by a linear-chain conditional random field over word shapes, trained from a small
    labelled table on the driver and decoded by Viterbi in batches where the texts are read: no shuffle.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in batches:
            items = finder.texts(batch.column(1).to_pylist())
            take = [i for i, own in enumerate(items) for _ in own]
            flat = [x for own in items for x in own]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(take, pa.int64())),
                    pa.array([x[0] for x in flat], pa.string()),
                    pa.array([x[1] for x in flat], pa.int64()),
                    pa.array([x[2] for x in flat], pa.int64()),
                ],
                ["row_key", "pii_type", "start_codepoint", "end_codepoint"],
            )

    kind = rows.schema[key].dataType.simpleString()
    return rows.where(F.length(text) > 0).select(key, text).mapInArrow(
        run, f"row_key {kind}, pii_type string, start_codepoint bigint, end_codepoint bigint"
    )


def redact(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, redacted, n_items): the text with a placeholder like [EMAIL] for each item, else unchanged.

    Null texts stay null and have no items. See ``find_items`` for what counts.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out, counts = [], []
            for value, own in zip(texts, finder.texts(texts), strict=True):
                counts.append(len(own))
                if own:
                    parts, at = [], 0
                    for kind, lo, hi in own:
                        parts += [value[at:lo], PLACEHOLDERS[kind]]
                        at = hi
                    value = "".join(parts) + value[at:]
                out.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.string()), pa.array(counts, pa.int32())], [key, "redacted", "n_items"]
            )

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, redacted string, n_items int")
