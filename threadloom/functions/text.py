"""Text functions over columns; all but NFC run inside the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions import lexicon as L

TOKEN = r"[\p{L}\p{N}_-]+"


def normalize_text(text: Column) -> Column:
    """Line ends as line feeds, then Unicode NFC; texts in ASCII never leave the JVM."""

    @F.pandas_udf("string")
    def nfc(values: pd.Series) -> pd.Series:
        return values.str.normalize("NFC")

    lines = F.regexp_replace(text, "\r\n?", "\n")
    return F.when(lines.rlike(r"[^\x00-\x7F]"), nfc(lines)).otherwise(lines)


def tokens(text: Column, least: int = 1) -> Column:
    """Lower-case tokens of letters, digits, underscores and hyphens, of ``least`` characters at least."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))
    return F.filter(found, lambda t: F.length(t) >= least) if least > 1 else found


def sentences(text: Column) -> Column:
    """Array of (start, end, sentence) by code points; ends are exclusive, blanks around are cut off.

    A sentence ends at runs of . ! ? … or at a line feed. A text without any sentence is one by itself.
    """
    raw = F.regexp_extract_all(text, F.lit(r"([^.!?…\n]+[.!?…]*)"), F.lit(1))
    empty = F.array().cast("array<struct<start:int,end:int,sentence:string>>")

    def step(state: Column, piece: Column) -> Column:
        at = F.position(piece, text, state["at"])
        left = F.length(piece) - F.length(F.regexp_replace(piece, r"^(?U)\s+", ""))
        body = F.regexp_replace(piece, r"(?U)^\s+|\s+$", "")
        start = at - 1 + left
        found = F.struct(start.alias("start"), (start + F.length(body)).alias("end"), body.alias("sentence"))
        return F.struct(
            (at + F.length(piece)).alias("at"),
            F.when(F.length(body) > 0, F.array_append(state["out"], found)).otherwise(state["out"]).alias("out"),
        )

    out = F.aggregate(raw, F.struct(F.lit(1).alias("at"), empty.alias("out")), step, lambda s: s["out"])
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("sentence")))
    return F.when(F.size(out) > 0, out).when(F.length(text) > 0, whole).otherwise(empty)


def has_words(text: Column, words: list[str], anchored: bool = False) -> Column:
    """Whether any of ``words`` occurs as a whole word; null texts have none."""
    return F.coalesce(text.rlike("(?iu)" + L.whole_words(words, anchored)), F.lit(False))


def dialogue_acts(text: Column) -> Column:
    """Labels of the acts that a text performs, in fixed order; ASSERT where there is none."""
    unnegated = F.regexp_replace(text, "(?iu)не (" + "|".join(L.NEGATABLE) + ")", "#")
    tests = {
        "QUESTION": text.contains("?") | has_words(text, L.ACTS["QUESTION"]),
        "PROPOSE": has_words(text, L.ACTS["PROPOSE"]),
        "AGREE": has_words(unnegated, L.ACTS["AGREE"]),
        "DISAGREE": has_words(text, L.ACTS["DISAGREE"]),
        "COMMIT": has_words(text, L.ACTS["COMMIT"]),
        "ACKNOWLEDGE": has_words(text, L.ACKNOWLEDGE, anchored=True),
    }
    found = F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("ASSERT")))


def grounding(text: Column) -> Column:
    """CLARIFICATION_REQUESTED, REPAIRED, ACKNOWLEDGED or null: the first that holds."""
    return (
        F.when(has_words(text, L.CLARIFICATION), "CLARIFICATION_REQUESTED")
        .when(has_words(text, L.REPAIR), "REPAIRED")
        .when(has_words(text, L.ACKNOWLEDGE, anchored=True), "ACKNOWLEDGED")
    )


def rare_cue(text: Column) -> Column:
    """The first rare cue that a text holds, else none."""
    out = F.lit("none")
    for name, words in reversed(L.RARE_CUES.items()):
        if name == "concession":
            test = F.coalesce(text.rlike(rf"(?iu)(^|[^\p{{L}}\p{{N}}_])({'|'.join(words)}).{{0,79}}[^\p{{L}}\p{{N}}_\n]но([^\p{{L}}\p{{N}}_]|$)"), F.lit(False))
        else:
            test = has_words(text, words)
        out = F.when(test, name).otherwise(out)
    return out


def n_words(text: Column) -> Column:
    """Pieces between blanks."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def is_proposition(text: Column, acts: Column) -> Column:
    """Three words at least, not a mere acknowledgement and no question."""
    return (n_words(text) >= 3) & (acts != F.array(F.lit("ACKNOWLEDGE"))) & ~F.array_contains(acts, "QUESTION")


def commitment(text: Column) -> Column:
    """0.45 where the wording is uncertain, else 0.78."""
    return F.when(has_words(text, L.UNCERTAIN), 0.45).otherwise(0.78)


def _share(words: Column, these: list[str]) -> Column:
    hits = F.size(F.filter(words, lambda w: w.isin(these)))
    return hits / F.greatest(F.size(words), F.lit(1))


def style(text: Column) -> Column:
    """Six rates between 0 and 1: function words, pronouns, particles, punctuation, emoji, length."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    size = F.greatest(F.length(text), F.lit(1))
    marks = F.length(text) - F.length(F.translate(text, ".,!?;:", ""))
    emoji = F.length(text) - F.length(F.regexp_replace(text, r"[\x{1F300}-\x{1FAFF}]", ""))
    return F.array(
        _share(words, L.FUNCTION_WORDS),
        _share(words, L.PRONOUNS),
        _share(words, L.PARTICLES),
        marks / size,
        emoji / size,
        F.least(F.size(words), F.lit(100)) / 100,
    )


def style_similarity(left: Column, right: Column) -> Column:
    """Mean of 1 − |difference| over the rates, each difference at most 1."""
    parts = F.zip_with(left, right, lambda a, b: 1 - F.least(F.abs(a - b), F.lit(1.0)))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(left)


def affect(text: Column) -> Column:
    """Struct of valence, arousal, dominance and five emotions: lexicon hits per token."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([а-яёa-z][а-яёa-z-]*)"), F.lit(1))
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

    def hits(name: str) -> Column:
        single = [w for w in L.AFFECT[name] if " " not in w]
        count = F.size(F.filter(words, lambda w: w.isin(single))).cast("double")
        for phrase in L.AFFECT[name]:
            if " " in phrase:
                count = count + F.when(joined.contains(phrase), 1.0).otherwise(0.0)
        return count

    n = F.greatest(F.size(words), F.lit(1))
    rate = {name: hits(name) / n for name in L.AFFECT}
    return F.struct(
        (rate["positive"] - rate["negative"]).alias("valence"),
        rate["arousal"].alias("arousal"),
        (rate["dominant"] - rate["hedge"]).alias("dominance"),
        *[rate[e].alias(e) for e in ("anger", "fear", "sadness", "joy", "frustration")],
    )


def redact(text: Column, mark: str = "[REDACTED]") -> Column:
    """Pages, mailboxes, telephone numbers and handles replaced by ``mark``."""
    for pattern, kept in L.REDACTED:
        text = F.regexp_replace(text, pattern, kept + mark)
    return text


def n_redactions(text: Column) -> Column:
    """How many of them ``redact`` replaces."""
    total = F.lit(0)
    for pattern, kept in L.REDACTED:
        total = total + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, kept + "[REDACTED]")
    return total


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two numeric arrays of one size; 0 where a norm is 0, null where sizes differ."""
    dot = F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(left) * norm(right)
    return F.when(F.size(left) == F.size(right), F.when(size > 0, dot / size).otherwise(0.0))
