"""Word lists and patterns of the rule-based text measures, as data."""

from __future__ import annotations

# Alternatives of each rule, matched as whole words whatever their case.
ACTS = {
    "QUESTION": ["почему", "зачем", "когда", "где", "кто", "что именно", "как"],
    "PROPOSE": ["давайте", "давай", "предлагаю", "можем", "нужно", "стоит"],
    "AGREE": ["согласен", "согласна", "согласны", "верно", "точно", "поддерживаю"],
    "DISAGREE": ["не согласен", "не согласна", "возражаю", "неверно", "нет,", "но это не"],
    "COMMIT": ["сделаю", "возьму", "обещаю", "отпишусь", "проверю", "исправлю"],
}
NEGATABLE = ["согласен", "согласна", "согласны"]
ACKNOWLEDGE = ["ок", "понял", "поняла", "поняли", "ясно", "вижу", "принято"]
UNCERTAIN = ["не уверен", "не уверена", "возможно", "кажется", "наверное", "может быть", "похоже"]
CLARIFICATION = ["уточни", "уточните", "что значит", "не понял", "не поняла", "правильно ли"]
REPAIR = ["точнее", "я имел в виду", "я имела в виду", "поправлюсь", "не так выразил"]
ARGUMENT = ["потому что", "так как", "поэтому", "следовательно", "из-за того"]
DISCOURSE = {
    "ACKNOWLEDGES": ["понял", "поняла", "поняли", "ясно", "спасибо", "ок", "окей", "принято"],
    "CORRECTS": ["нет,", "нет:", "нет ", "не так", "поправка", "поправлю", "точнее говоря"],
    "CONTRASTS": ["но", "однако", "зато", "впрочем"],
    "CLARIFIES": ["точнее", "то есть", "имею в виду", "уточню", "уточнение"],
    "ACCEPTS": ["согласен", "согласна", "согласны", "принимаю", "давайте", "давай", "поддерживаю"],
    "REJECTS": ["не согласен", "не согласна", "не согласны", "не подходит", "отклоняю", "отклоняем", "против"],
}
# Words of argument roles and relations; a star stands for any further letters.
EVIDENCE = ["по данным", "исследовани*", "показыва*", "наблюдени*", "согласно"]
PREMISE = ["потому что", "так как", "поскольку", "ведь", "поэтому", "следовательно"]
SUPPORT = ["соглас*", "верно", "поддержива*", "именно", "да,", "да "]
ATTACK = ["не соглас*", "неверно", "нет,", "нет ", "нет:", "ошиб*", "против", "однако", "но "]
# Cues that are rare, in order; a concession is one of its words and "но" within 80 characters of a line.
RARE_CUES = {
    "repair": ["точнее", "поправлюсь", "имел в виду", "имела в виду", "имели в виду", "не так выразил"],
    "concession": ["согласен", "согласна", "допустим", "пусть"],
    "attribution": ["по словам", "считает", "утверждает", "говорят", "якобы"],
    "uncertainty": ["возможно", "кажется", "наверное", "не уверен", "не уверена"],
    "argument": ["потому что", "так как", "поэтому", "следовательно", "однако"],
}
# Modal words and negations of the linguistic measures.
MODALS = ["мочь", "должный", "нужно", "необходимо", "следовать", "хотеть", "возможно", "вероятно"]
NEGATIONS = ["не", "ни"]
# Words of the style rates.
FUNCTION_WORDS = ["и", "а", "но", "что", "как", "если", "то", "же", "ли", "бы", "не"]
PRONOUNS = ["я", "ты", "он", "она", "мы", "вы", "они", "это", "тот", "эта"]
PARTICLES = ["же", "ли", "бы", "ведь", "вот", "даже", "только", "именно"]
# Words and phrases of each affect.
AFFECT = {
    "anger": ["злой", "злость", "бесит", "ярость", "возмущён", "ненавижу"],
    "fear": ["страшно", "страх", "боюсь", "опасно", "тревожно", "риск"],
    "sadness": ["грустно", "печально", "жаль", "потеря", "разочарован"],
    "joy": ["рад", "рада", "радость", "отлично", "счастлив", "ура"],
    "frustration": ["устал", "надоело", "опять", "не получается", "тупик", "раздражает"],
    "positive": ["хорошо", "отлично", "рад", "успех", "получилось", "спасибо"],
    "negative": ["плохо", "ошибка", "провал", "проблема", "страх", "злость"],
    "dominant": ["точно", "обязательно", "решено", "делаем", "требую", "нужно"],
    "hedge": ["возможно", "кажется", "наверное", "может", "не уверен"],
    "arousal": ["срочно", "немедленно", "ужас", "ура", "бесит", "критично"],
}
# Pages, mailboxes, telephone numbers and handles that are redacted; the last two keep the sign before them.
REDACTED = [
    (r"(?i)https?://\S+", ""),
    (r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}", ""),
    (r"(^|[^\p{L}\p{N}_])(\+?\p{Nd}[\p{Nd} ()-]{7,}\p{Nd})(?![\p{L}\p{N}_])", "$1"),
    (r"(^|[^\p{L}\p{N}_])@[A-Za-z0-9_]{3,}", "$1"),
]

#: A border between words, without look-around, so that every engine reads it alike.
_EDGE = r"[^\p{L}\p{N}_]"


def whole_words(words: list[str], anchored: bool = False) -> str:
    """A pattern for any of ``words`` as whole words; give it ``(?iu)`` in Java, ``(?i)`` in RE2.

    A word that ends in a sign or blank needs a word right after it, as a border between the two demands.
    """
    either = "|".join(w.replace("-", r"\-") for w in words)
    if anchored:
        return rf"^({either})[.! ]*$"
    plain = lambda w: w.replace("-", r"\-").replace("*", r"[\p{L}\p{N}_]*")
    tight = "|".join(plain(w) for w in words if w[-1].isalpha() or w[-1] == "*")
    loose = "|".join(plain(w) for w in words if not (w[-1].isalpha() or w[-1] == "*"))
    parts = [rf"(^|{_EDGE})({tight})({_EDGE}|$)"] if tight else []
    parts += [rf"(^|{_EDGE})({loose})[\p{{L}}\p{{N}}_]"] if loose else []
    return "|".join(parts)
