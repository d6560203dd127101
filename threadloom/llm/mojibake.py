"""Passages that were decoded with the wrong character encoding: finding and restoring them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings as which UTF-8 bytes may have been read.
READ_AS = ("cp1252", "latin-1", "cp1251", "koi8-r", "cp866", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "iso8859-15")
_CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic")
_WESTERN = ("cp1252", "cp850", "mac_roman", "cp1250", "iso8859-2")
_OTHER = ("latin-1", "cp437")
#: (encoding the text was written in, encoding it was read as), both with one byte per character.
SWAPPED = tuple((w, r) for w in (*_CYRILLIC, *_WESTERN) for r in (*_CYRILLIC, *_WESTERN, *_OTHER) if w != r)
#: A passage is restored when its cost falls by so many nats: UTF-8 read as another encoding, and one one-byte encoding as another.
FALL, FALL_SWAPPED = 4.0, 9.0
#: Nats that any character saves by going, which is no merit of a reading that joins several into one.
PER_CHAR = 1.8
#: Nats that each character of a swapped passage must save besides, since so many swaps are tried.
FALL_PER_CHAR = 0.6
#: A run of which each character costs less than this is sound as written: letters aren't read as Unicode, and no swap is tried.
SOUND_LETTERS, SOUND = 2.8, 3.0
#: Share that the classes of characters have in the chance of a pair, and the count of a pair of classes never seen.
CLASS_SHARE, CLASS_SMOOTH = 0.03, 0.02
REPLACEMENT = "�"
#: Sound text that is counted with every corpus, so many times, so that Cyrillic is known to a corpus without it.
SAMPLE_COUNTS = 100
SAMPLE = (
    "Когда наступила весна, мы решили вернуться в старый дом у реки. Дорога была долгой, но никто не жаловался: дети смотрели в окно, "
    "а взрослые вспоминали, что было здесь раньше. Вечером хозяин рассказал нам, как они жили эти годы, почему уехал его брат и кто теперь "
    "работает в школе. Я хотел спросить ещё о многом, однако чувствовал, что всему своё время. Если можно, объясните, где найти хорошего "
    "врача; это очень важно для меня и моей семьи. Люди часто говорят, будто счастье нужно заслужить, хотя сами ждут только чуда. "
    "Сегодня цены выше, чем вчера, и поэтому каждый покупатель считает деньги. Шум машин, холодный ветер, жёлтый свет фонаря — всё "
    "казалось чужим. Пожалуйста, передайте отцу письмо и общую фотографию; об этом просила его сестра, которую он давно не видел. "
    "Сьогодні ми знову їдемо до міста, щоб побачити друзів і купити ґудзики; є надія, що погода буде кращою, ніж учора. Їхній дім "
    "стоїть біля лісу, де живе їжак, а в єдиному вікні ще горить світло. "
    "Später fuhren wir über die Brücke nach Köln, wo größere Häuser stehen; dort dürfen Gäste müde Füße ausruhen. Über Österreich weiß er natürlich mehr. "
    "L’été dernier, à Besançon, le garçon a mangé une crêpe près de l’hôtel où sa sœur était déjà allée ; ça coûtait 5 € à Noël. Être là, voilà. "
    "Mañana el señor Núñez irá a León; ¿qué más dirá? ¡Nadie lo sabrá aún! El pingüino comió después, según él. "
    "Não há razão para ficar aí: amanhã vocês virão à estação, e três irmãs também. A maçã está lá, avó. "
    "Zażółć gęślą jaźń; żółw śpi, bo jest już późno. Łódź płynie wśród źdźbeł, a dziś pięć osób tańczy. Příliš žluťoučký kůň úpěl ďábelské ódy. Szép őszi idő, hűvös eső. "
    "Når våren kommer, går vi på den gamle stien; på øya spiser vi smør og brød. Från början såg hon två små båtar på sjön. Het geïnde bedrag, coöperatie. O relatório é ótimo, só há três episódios. "
    "«Да… возможно», — сказал он; её дом, твоё имя, моё дело. Её, моё, «Ё», «С», «В», «А» и «Б», класс «К»; А… и Б…, С… или Я… Р… В… К… О…, РФ, США, СПб, МВД, ГОСТ, г. Москва, п. 5, № 7 и №8 — всё. "
    "It wasn’t easy – “maybe,” she’d said… and then… ‘no’—never… • one • two; 20 °C ± 1, 5 × 3, § 4, ½ l, ¼, ¾, x², © 2020, TM™, A® B. «Oui… peut-être», dit-il… „Nein…“, sagte er… "
    "ÉTÉ, NÃO, ÜBER, SEÑOR, ÇA, ÀS, É, Â, Å, ÖL, À, Ø, ÉCOLE; nº 5, nº 8, 1ª, 2º, 3.º; « Oui », dit-il, « non » ; 10 €, £5, ¥9; → ← ≈ ≤ ≥ ≠ √2 ∞ Δx, μ = 1, σ, π.\n├── a\n│   └── b\n═══"
)

# ---------------------------------------------------------------------------------------------- bytes


@lru_cache(maxsize=64)
def _byte_of(codec: str) -> dict[str, int]:
    """Byte of each character of a one-byte encoding above ASCII; a byte it doesn't define is read as the control of that number."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return table


@lru_cache(maxsize=64)
def _sequences(codec: str) -> re.Pattern:
    """Matches maximal runs of characters whose bytes in ``codec`` are well-formed UTF-8 beyond ASCII."""
    char = {b: c for c, b in _byte_of(codec).items()}

    def group(lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(char[b]) for b in range(lo, hi + 1) if b in char) + "]"

    tail = group(0x80, 0xBF)
    forms = (
        group(0xC2, 0xDF) + tail,
        group(0xE0, 0xE0) + group(0xA0, 0xBF) + tail,
        group(0xE1, 0xEC) + tail + tail,
        group(0xED, 0xED) + group(0x80, 0x9F) + tail,
        group(0xEE, 0xEF) + tail + tail,
        group(0xF0, 0xF0) + group(0x90, 0xBF) + tail + tail,
        group(0xF1, 0xF3) + tail + tail + tail,
        group(0xF4, 0xF4) + group(0x80, 0x8F) + tail + tail,
    )
    return re.compile("(?:" + "|".join(forms) + ")+")


@lru_cache(maxsize=64)
def _roles(codec: str) -> np.ndarray:
    """For each code point the length of the UTF-8 sequence that its byte in ``codec`` opens, 1 where it goes on, else 0."""
    roles = np.zeros(0x110000, np.uint8)
    for ch, b in _byte_of(codec).items():
        roles[ord(ch)] = 1 if b < 0xC0 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
    return roles


#: For each encoding the character of each byte as which UTF-8 is decoded again.
_BYTES = {codec: {ord(ch): b for ch, b in _byte_of(codec).items()} for codec in READ_AS}


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _sequence_starts(points: np.ndarray, codec: str) -> np.ndarray:
    """Where sequences of UTF-8 read as ``codec`` may begin, as a mask over the code points."""
    roles = _roles(codec)[points]
    begins = np.zeros(len(points), bool)
    opens = np.flatnonzero(roles[:-1] > 1)
    opens = opens[roles[opens + 1] == 1]
    for n in (3, 4):
        far = roles[opens] >= n
        end = np.minimum(opens + n - 1, len(points) - 1)
        opens = opens[~far | (roles[end] == 1)]
    begins[opens] = True
    return begins


@lru_cache(maxsize=256)
def _exchange(written: str, read: str) -> dict[int, str]:
    """Character as which each one beyond ASCII of ``read`` was written in ``written``; those without one are missing."""
    out = {}
    for ch, b in _byte_of(read).items():
        try:
            out[ord(ch)] = bytes([b]).decode(written)
        except UnicodeDecodeError:
            continue
    return out


#: Characters beyond ASCII that each swap can undo.
_ALLOWED = {way: frozenset(map(chr, _exchange(*way))) for way in SWAPPED}

# ----------------------------------------------------------------------------------------------- cost


def _class_of(n: int) -> int:
    """One of about thirty classes: script, case and kind of sign."""
    ch = chr(n)
    if n < 0x80:
        if ch.isalpha():
            return 1 + ch.isupper()
        return 3 if ch.isdigit() else 0 if ch in " \t\r\n" else 4 if ch in ".,;:!?" else 5 if ch in "\"'()[]{}<>" else 6 if n >= 0x20 else 7
    if n < 0xA0:
        return 7
    if n == 0xA0 or 0x2000 <= n <= 0x200B:
        return 8
    if ch in "«„“‘‚‹":
        return 9
    if ch in "»”’›":
        return 10
    if ch in "–—…•":
        return 11
    if ch in "¡¿":
        return 12
    if n < 0xC0 or n in (0xD7, 0xF7):
        return 14 if ch in "§°±№²³¼½¾©®" else 13
    if n < 0x100:
        return 15 + ch.isupper()
    if n < 0x250:
        return 17 + ch.isupper()
    if 0x370 <= n < 0x400:
        return 19
    if 0x410 <= n <= 0x44F or n in (0x401, 0x451):
        return 20 + ch.isupper()
    if 0x400 <= n < 0x530:
        return 22 + ch.isupper()
    if 0x2500 <= n < 0x25A0:
        return 24
    if n in (0x2116, 0x20AC):
        return 14
    if 0x2010 <= n < 0x2C00 or 0x2C6 <= n <= 0x2DD:
        return 25
    if 0x300 <= n < 0x370:
        return 26
    if 0x590 <= n < 0x780:
        return 27
    if 0x2E80 <= n < 0xE000:
        return 28
    if 0xE000 <= n < 0xF900 or 0xFFF0 <= n < 0x10000 or n >= 0xE0000:
        return 29
    if 0x1F000 <= n:
        return 30
    return 31


N_CLASSES = 32
#: Characters that the cost model tells apart; each other one counts as any character of its class.
_SEEN = [*range(0x20, 0x7F), *range(0x80, 0x180), *range(0x2C6, 0x2DE), *range(0x391, 0x3CA), *range(0x400, 0x530), *range(0x2010, 0x2045), 0x20AC, *range(0x2100, 0x21A0), *range(0x2200, 0x2266), *range(0x2500, 0x25A1), *range(0xFB00, 0xFB07)]
_SEEN_SET = frozenset(_SEEN)
ALPHABET_SIZE = N_CLASSES + len(_SEEN)
#: Nats that tell a character from the others of its class, for those that have no code of their own: the logarithm of their number.
_WITHIN = {7: 3.5, 13: 3.0, 17: 5.0, 18: 5.0, 19: 4.5, 22: 4.0, 23: 4.0, 24: 3.0, 25: 7.0, 26: 4.7, 27: 6.0, 28: 10.6, 29: 9.0, 30: 7.0, 31: 11.5}
#: Pairs of codes, then pairs of classes.
TABLE_SIZE = ALPHABET_SIZE**2 + N_CLASSES**2
#: Class of small letters for each class of capitals, and each other class itself.
_FOLDED = np.arange(N_CLASSES)
_FOLDED[[2, 16, 18, 21, 23]] = [1, 15, 17, 20, 22]


@lru_cache(maxsize=1)
def _alphabet() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each code point, class of each code point, class of each code); case has a class but no code."""
    class_at = np.full(0x110000, 31, np.int32)
    for lo, hi in ((0, 0x600), (0x2000, 0x2C00)):
        class_at[lo:hi] = [_class_of(n) for n in range(lo, hi)]
    for lo, hi in ((0x590, 0x780), (0x2E80, 0xE000), (0xE000, 0xF900), (0xFFF0, 0x10000), (0xE0000, 0x110000), (0x1F000, 0x20000)):
        class_at[lo:hi] = _class_of(lo)
    codes = _FOLDED[class_at]
    codes[_SEEN] = N_CLASSES + np.arange(len(_SEEN))
    for n in _SEEN:
        low = chr(n).lower()
        if len(low) == 1 and ord(low) in _SEEN_SET:
            codes[n] = codes[ord(low)]
    codes[class_at == 0] = 0
    return codes, class_at, np.r_[_FOLDED, _FOLDED[class_at[_SEEN]]]


def _codes(points: np.ndarray) -> np.ndarray:
    return _alphabet()[0][points]


def _plain(lines: list[str]) -> list[str]:
    """The lines without a UTF-8 sequence of three or more bytes, or two side by side, read as one encoding: they show nothing about sound text."""
    if not lines:
        return lines
    points = _points("\n".join(lines) + "\n\n\n\n\n\n")
    bad = np.zeros(len(points), bool)
    for codec in READ_AS:
        begins = _sequence_starts(points, codec)
        if codec == "cp866":
            # Sound words of small letters are such sequences, too.
            begins &= _roles(codec)[points] == 2
        at = np.flatnonzero(begins[:-5])
        length = _roles(codec)[points[at]]
        bad[at[begins[at + length] | (length > 2)]] = True
    ends = np.flatnonzero(points == 10)
    hit = set(np.searchsorted(ends, np.flatnonzero(bad)).tolist())
    return [line for i, line in enumerate(lines) if i not in hit]


def _pairs(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each pair of codes and of each pair of classes of neighbours."""
    codes, classes = _codes(points).astype(np.int64), _alphabet()[1][points]
    return codes[:-1] * ALPHABET_SIZE + codes[1:], classes[:-1] * N_CLASSES + classes[1:]


def count_pairs(lines: list[str]) -> np.ndarray:
    """How often each pair of codes and each pair of classes stands in the lines, as a flat table."""
    codes, classes = _pairs(_points("\n" + "\n".join(_plain(lines)) + "\n"))
    return np.r_[np.bincount(codes, minlength=ALPHABET_SIZE**2), np.bincount(classes, minlength=N_CLASSES**2)]


def pair_counts(documents: DataFrame, text: str = "text") -> np.ndarray:
    """How often each pair of characters follows one another over the distinct lines of all documents and ``SAMPLE``.

    Copies count once, so a garbled text doesn't become sound by being repeated. Every batch of lines is
    counted where it is and sends its non-zero counts; the result has at most ``TABLE_SIZE`` rows
    whatever the corpus holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TABLE_SIZE, np.int64)
        for batch in batches:
            total += count_pairs([t for t in batch.column(0).to_pylist() if t])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["pair", "n"])

    rows = (
        documents.select(F.explode(F.split(F.col(text), "\n")).alias("line"))
        .distinct()
        .mapInArrow(run, "pair bigint, n bigint")
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    counts = np.zeros(TABLE_SIZE)
    for pair, n in rows:
        counts[pair] = n
    return with_sample(counts)


def with_sample(counts: np.ndarray) -> np.ndarray:
    return counts + SAMPLE_COUNTS * count_pairs([SAMPLE])


class Costs:
    """Garbling cost of text: nats of each character after the one before.

    Letters are counted without their case, so that the bulk of sound text outweighs garbled text in rare letters;
    pairs never seen fall back on their classes; a letter's case costs what the case has after such a character.
    """

    def __init__(self, table: np.ndarray) -> None:
        counts = table[: ALPHABET_SIZE**2].reshape(ALPHABET_SIZE, ALPHABET_SIZE)
        cases = table[ALPHABET_SIZE**2 :].reshape(N_CLASSES, N_CLASSES) + 0.5
        self.counts, self.totals = counts.ravel(), counts.sum(1)
        classes = _alphabet()[2]
        member = np.zeros((N_CLASSES, ALPHABET_SIZE))
        member[classes, np.arange(ALPHABET_SIZE)] = 1
        between = member @ counts @ member.T + CLASS_SMOOTH
        of_class = counts.sum(0) + 0.5
        of_class /= (member @ of_class)[classes]
        back = (between / between.sum(1, keepdims=True))[np.ix_(classes, classes)] * of_class
        self.back = (CLASS_SHARE * back).ravel()
        self.within = np.zeros(ALPHABET_SIZE)
        self.within[list(_WITHIN)] = list(_WITHIN.values())
        fold = np.eye(N_CLASSES)[_FOLDED]
        self.case = (np.log((cases @ fold)[:, _FOLDED]) - np.log(cases)).ravel()

    def along(self, points: np.ndarray, counted: bool) -> np.ndarray:
        """Cost of everything before each code point; with ``counted`` each pair is left out of the counts once."""
        pairs, case = _pairs(points)
        seen = self.counts[pairs] - counted
        cost = -np.log((1 - CLASS_SHARE) * np.maximum(seen, 0) / (self.totals[pairs // ALPHABET_SIZE] + 1) + self.back[pairs]) + self.case[case] + self.within[pairs % ALPHABET_SIZE]
        return np.r_[0.0, np.cumsum(cost)]

    def sums(self, texts: list[str], own: bool) -> np.ndarray:
        """Cost of each text from its first character to its last; ``own`` leaves the text itself out of the counts."""
        points = _points("\n".join(texts) + "\n")
        pairs, case = _pairs(points)
        first = pairs // ALPHABET_SIZE
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(size + 1)
        inner = np.ones(len(pairs), bool)
        inner[ends[:-1] - 1] = False
        inner[ends - 2] = False
        text = np.repeat(np.arange(len(texts)), size + 1)[:-1]
        seen, total = self.counts[pairs], self.totals[first]
        if own:
            for values, key in ((seen, pairs), (total, first)):
                _, which, n = np.unique(text * (ALPHABET_SIZE**2) + key, return_inverse=True, return_counts=True)
                values -= np.minimum(values, n[which])
        cost = -np.log((1 - CLASS_SHARE) * seen / (total + 1) + self.back[pairs]) + self.case[case] + self.within[pairs % ALPHABET_SIZE]
        return np.bincount(text[inner], cost[inner], len(texts))


# --------------------------------------------------------------------------------------------- repair

_RUN = re.compile("[^\x00-\x7f�]+")
#: UTF-16 read as latin-1: every other character is a high byte of ASCII or Cyrillic.
_WIDE = re.compile("(?:[\x09-\xff][\x00\x04]){2,}")
_WIDE_BIG = re.compile("(?:[\x00\x04][\x09-\xff]){2,}")


def _replace(line: str, passages: Iterable[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for lo, hi, restored in passages:
        parts += [line[at:lo], restored]
        at = hi
    return "".join(parts) + line[at:]


class _Text:
    """Lines put together, each after a line feed, with their code points and their running cost."""

    def __init__(self, lines: list[str], costs: Costs, counted: bool) -> None:
        self.joined = "\n" + "\n".join(lines) + "\n\n\n\n"
        self.points = _points(self.joined)
        size = np.fromiter(map(len, lines), np.int64, len(lines))
        self.starts = 1 + np.cumsum(size + 1) - size - 1
        self.cost = costs.along(self.points, counted)

    def line_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last place of every run of characters beyond ASCII."""
        beyond = np.r_[False, (self.points > 0x7F) & (self.points != 0xFFFD), False]
        edge = np.flatnonzero(beyond[1:] != beyond[:-1])
        return edge[::2], edge[1::2]


class Repairer:
    """Finds and restores wrongly decoded passages, given the pair counts of the corpus."""

    def __init__(self, counts: np.ndarray) -> None:
        self.costs = Costs(counts)
        self._known: dict[bool, dict[str, dict[tuple[str, str], tuple[float, str]]]] = {True: {}, False: {}}

    def _decodable(self, lines: list[str], text: "_Text") -> Iterator[tuple[int, int, int, str, tuple[str, str]]]:
        """(line, start, end, restored, (written, read)) of every odd passage that strictly decodes as Unicode."""
        cost, starts = text.cost.tolist(), text.starts.tolist()
        for codec in READ_AS:
            at = np.flatnonzero(_sequence_starts(text.points, codec))
            letters = codec == "cp866"  # Here sound words of small letters are such sequences, too.
            if letters:
                at = at[text.cost[at + 1] - text.cost[at - 1] > 2 * SOUND_LETTERS]
            for i in np.unique(text.line_of(at)).tolist():
                base = starts[i]
                for m in _sequences(codec).finditer(lines[i]):
                    lo, hi = m.span()
                    if not letters or cost[base + hi] - cost[base + lo - 1] > SOUND_LETTERS * (hi - lo + 1):
                        yield i, lo, hi, m.group().translate(_BYTES[codec]).encode("latin-1").decode("utf-8"), ("utf-8", codec)
        for i in np.unique(text.line_of(np.flatnonzero((text.points == 0) | (text.points == 4)))).tolist():
            for pattern, written in ((_WIDE, "utf-16-le"), (_WIDE_BIG, "utf-16-be")):
                for m in pattern.finditer(lines[i]):
                    yield i, m.start(), m.end(), m.group().encode("latin-1").decode(written), (written, "latin-1")

    def _undo_decoding(self, lines: list[str], text: "_Text", counted: bool) -> tuple[list[str | None], list[float], list[float]]:
        """Each line with the one wrong reading of Unicode undone that lowers its cost most, or None; by how much; share of characters."""
        out: list[str | None] = [None] * len(lines)
        fell, share = [0.0] * len(lines), [0.0] * len(lines)
        found = list(self._decodable(lines, text))
        if not found:
            return out, fell, share
        before, after = [], []
        for i, lo, hi, restored, _ in found:
            left, right = lines[i][lo - 1] if lo else "\t", lines[i][hi : hi + 1] or "\t"
            before.append(left + lines[i][lo:hi] + right)
            after.append(left + restored + right)
        shorter = np.array([hi - lo - len(restored) for _, lo, hi, restored, _ in found])
        fall = self._by_text(before, counted) - self._by_text(after, False) - PER_CHAR * shorter
        ways: dict[int, dict[tuple[str, str], list[int]]] = {}
        for n in np.flatnonzero(fall > 0).tolist():
            ways.setdefault(found[n][0], {}).setdefault(found[n][4], []).append(n)
        for i, options in ways.items():
            best = max((own for own in options.values() if fall[own].max() > FALL), key=lambda own: fall[own].sum(), default=None)
            if best:
                out[i] = _replace(lines[i], [found[n][1:4] for n in best])
                fell[i] = float(fall[best].sum())
                share[i] = sum(found[n][2] - found[n][1] for n in best) / max(1, sum(map(len, _RUN.findall(lines[i]))))
        return out, fell, share

    def _undo_swap(self, lines: list[str], text: "_Text", among: np.ndarray, counted: bool) -> list[tuple[str | None, float]]:
        """Each line with the one swap of one-byte encodings undone that lowers its cost most, or None; and by how much."""
        out: list[tuple[str | None, float]] = [(None, 0.0)] * len(lines)
        lo, hi = text.runs()
        line = text.line_of(lo)
        cost = text.cost[hi] - text.cost[lo - 1]
        odd_runs = np.flatnonzero((cost > 0.9 * np.maximum(FALL_SWAPPED, SOUND * (hi - lo + 1))) & among[line])
        if not len(odd_runs):
            return out
        runs: dict[str, int] = {}
        where: dict[int, list[tuple[int, int, int]]] = {}
        for i, begin, end in zip(line[odd_runs].tolist(), lo[odd_runs].tolist(), hi[odd_runs].tolist(), strict=True):
            base = int(text.starts[i])
            where.setdefault(i, []).append((runs.setdefault(text.joined[begin - 1 : end + 1], len(runs)), begin - base, end - base))
        texts = list(runs)
        better = self._swaps_of(texts, counted)
        if not any(better):
            return out
        chosen: dict[int, tuple[str, str]] = {}
        for i, own in where.items():
            gains: dict[tuple[str, str], float] = {}
            proven = set()
            for n, begin, end in own:
                for way, (gain, _) in better[n].items():
                    gains[way] = gains.get(way, 0.0) + gain
                    if gain > FALL_SWAPPED and gain > FALL_PER_CHAR * (end - begin):
                        proven.add(way)
            if proven:
                chosen[i] = max(proven, key=lambda w: (gains[w], w))
        # Beside a proven passage any fall is enough, also for runs that are not odd by themselves.
        ends = np.searchsorted(line, list(chosen), side="right")
        rest: dict[str, int] = {}
        for i, first, last in zip(chosen, np.searchsorted(line, list(chosen)).tolist(), ends.tolist(), strict=True):
            base = int(text.starts[i])
            where[i] = []
            for begin, end in zip(lo[first:last].tolist(), hi[first:last].tolist(), strict=True):
                around = text.joined[begin - 1 : end + 1]
                n = runs.get(around)
                if n is None:
                    n = len(texts) + rest.setdefault(around, len(rest))
                where[i].append((n, begin - base, end - base))
        texts += list(rest)
        better += [{} for _ in rest]
        more = list({(n, way) for i, way in chosen.items() for n, _, _ in where[i] if way not in better[n] and _ALLOWED[way].issuperset(texts[n][1:-1])})
        if more:
            restored = [texts[n][0] + texts[n][1:-1].translate(_exchange(*way)) + texts[n][-1] for n, way in more]
            fall = self._by_text([texts[n] for n, _ in more], counted) - self._by_text(restored, False)
            for k in np.flatnonzero(fall > 0).tolist():
                better[more[k][0]] = {**better[more[k][0]], more[k][1]: (float(fall[k]), restored[k][1:-1])}
        for i, way in chosen.items():
            hits = [(begin, end, *better[n][way]) for n, begin, end in where[i] if way in better[n]]
            out[i] = _replace(lines[i], [(begin, end, restored) for begin, end, _, restored in hits]), sum(gain for _, _, gain, _ in hits)
        return out

    def _swaps_of(self, texts: list[str], counted: bool) -> list[dict[tuple[str, str], tuple[float, str]]]:
        """For each run between its neighbours the swaps that lower its cost, with the fall and the restored run."""
        known = self._known[counted]
        if len(known) > 200_000:
            known.clear()
        new = [t for t in texts if t not in known]
        if new:
            odd = self._by_text(new, counted)
            tried: list[tuple[int, tuple[str, str], str]] = []
            for n in np.flatnonzero(odd > np.maximum(FALL_SWAPPED, SOUND * np.fromiter(map(len, new), np.int64, len(new)))).tolist():
                run = new[n][1:-1]
                for way in SWAPPED:
                    if _ALLOWED[way].issuperset(run) and (restored := run.translate(_exchange(*way))) != run:
                        tried.append((n, way, new[n][0] + restored + new[n][-1]))
            known.update((t, {}) for t in new)
            if tried:
                fall = odd[[n for n, _, _ in tried]] - self._by_text([t for _, _, t in tried], False)
                for k in np.flatnonzero(fall > 0).tolist():
                    n, way, restored = tried[k]
                    known[new[n]][way] = (float(fall[k]), restored[1:-1])
        return [known[t] for t in texts]

    def layer(self, lines: list[str], counted: bool) -> list[str | None]:
        """Each line with the one wrong decoding undone that lowers its cost most, or None where none does.

        ``counted`` tells that the lines stand in the corpus and are no evidence for themselves. Bytes that form Unicode
        are the stronger evidence: where they explain most of a line's characters, no swap is tried.
        """
        text = _Text(lines, self.costs, counted)
        out, fall, share = self._undo_decoding(lines, text, counted)
        rest = np.array(share) < 0.5
        for i, (line, more) in enumerate(self._undo_swap(lines, text, rest, counted)):
            if line is not None and more > fall[i]:
                out[i] = line
        return out

    def _by_text(self, texts: list[str], own: bool) -> np.ndarray:
        number: dict[str, int] = {}
        which = [number.setdefault(t.replace("\n", "\t"), len(number)) for t in texts]
        return self.costs.sums(list(number), own)[which]

    def repair(self, texts: list[str | None]) -> list[tuple[str | None, int, bool]]:
        """(restored text, layers undone, whether the text holds a garbled passage) of each text.

        Layers are undone until none lowers the cost; every one lowers it, so there is an end.
        """
        number: dict[str, int] = {}
        where: list[list[int] | None] = []
        for text in texts:
            odd = text and not (text.isascii() and "\x00" not in text and "\x04" not in text)
            where.append([number.setdefault(line, len(number)) for line in text.split("\n")] if odd else None)
        lines, layers = list(number), [0] * len(number)
        pending = [i for i, line in enumerate(lines) if not line.isascii() or "\x00" in line or "\x04" in line]
        while pending:
            changed = []
            for i, better in zip(pending, self.layer([lines[i] for i in pending], not any(layers)), strict=True):
                if better is not None:
                    lines[i] = better
                    layers[i] += 1
                    changed.append(i)
            pending = changed
        out = []
        for text, own in zip(texts, where, strict=True):
            if own is None:
                out.append((text, 0, False))
            else:
                most = max(layers[i] for i in own)
                out.append(("\n".join(lines[i] for i in own) if most else text, most, most > 0 or REPLACEMENT in text))
        return out


def repair_texts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, garbled, layers, repaired) of every row.

    ``garbled`` tells whether the text holds a passage that was decoded with the wrong encoding, whether
    or not it can be restored (a replacement character marks one that can't); ``repaired`` is the text with
    every recoverable passage restored and all else unchanged; ``layers`` counts the wrong decodings
    undone. Null texts give false, 0 and null; repeated rows come out repeatedly; other columns are
    ignored; an empty table gives an empty table.

    Each passage that can be re-encoded under a candidate encoding and strictly decoded as another one is
    weighed with its neighbours: it is restored when its garbling cost drops by more than ``FALL`` (after a
    swap of one-byte encodings ``FALL_SWAPPED``), or at all beside such a passage of the same line and kind; this
    repeats for nested layers until nothing drops. The cost comes from the pairs of characters of the distinct
    lines of the whole corpus, a table of fixed size. Texts are repaired where they are read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(pair_counts(documents, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix = Repairer(shared.value)
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                out = fix.repair(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([o[2] for o in out], pa.bool_()),
                        pa.array([o[1] for o in out], pa.int32()),
                        pa.array([o[0] for o in out], pa.string()),
                    ],
                    [key, "garbled", "layers", "repaired"],
                )

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, garbled boolean, layers int, repaired string")
