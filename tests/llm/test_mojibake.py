"""Wrongly decoded text: every listed encoding there and back, and sound text left alone."""

import pytest

from threadloom.llm.mojibake import repair_texts

CLEAN = [
    "Разметчик отметил согласие, хотя прототип упомянут вскользь.", "Сессия длилась 12 минут, пауза перед ней — больше ночи.", "Вывод осторожный: архив и отчёт встречаются вместе.",
    "The annotator’s “agree” leans on a passing mention… so far", "Die Prüferin wählte „Zustimmung“, obwohl Öl und Übermaß größer sind", "La séance a duré ; l’âge du fil, déjà oublié",
    "No episódio 5, as vozes NÃO concordam sobre o relatório.", "SÃO TRÊS PÁGINAS, E NÃO DUAS.", "Ґанок і їжак, єдність", "対話の記録", "مرحبا שלום", "├── import\n│   └── media", "√2 ≈ 1.414; Δ < 0.05; ±1.96·σ",
    "naïve café coöperation", "Â ce stade, à bientôt", "ПРОВЕРЕНО: РС-2, СТ-17, АРХИВ ЗАКРЫТ", "été й", "👩🏽‍💻 🇪🇺", "μ=0,5 °C ± 2", "ага, спасибо", "Её ждёт Сёма; класс С… и «В»", "наивно??? нет",
]
BODY = CLEAN * 12


def garble(text, codec):
    out = []
    for b in text.encode("utf-8"):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def run(spark, texts):
    rows = [(i, t, "x") for i, t in enumerate([*texts, *BODY])]
    got = {x.doc_id: x for x in repair_texts(spark.createDataFrame(rows, "doc_id long, text string, repaired string")).collect()}
    return [got[i] for i in range(len(rows))]


def test_encodings_there_and_back(spark):
    cases = []
    for codec in ("cp1252", "latin-1", "cp1251", "koi8-r", "cp866", "mac_roman", "cp437", "cp850"):
        cases += [(t, garble(t, codec)) for t in (CLEAN[0], CLEAN[3], CLEAN[4], CLEAN[6])]
        cases.append((CLEAN[1] + "\n" + CLEAN[4], CLEAN[1] + "\n" + garble(CLEAN[4], codec)))
    cases += [(t, garble(garble(t, "cp1252"), "cp1252")) for t in (CLEAN[0], CLEAN[3], CLEAN[6])]
    for written, read in (("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251")):
        t = "Разметчик отметил согласие, хотя прототип упомянут вскользь."
        cases.append((t, t.encode(written).decode(read)))
    cases = [(a, b) for a, b in cases if a != b]
    got = run(spark, [b for _, b in cases])
    assert all(x.garbled for x in got[: len(cases)])
    wrong = [(a, x.repaired) for (a, _), x in zip(cases, got) if x.repaired != a]
    assert len(wrong) <= 1, wrong
    assert not any(x.garbled for x in got[len(cases) :])
    assert [x.repaired for x in got[len(cases) :]] == BODY


@pytest.mark.parametrize("case", ["nÃ£o Ã©", "the sampleâ€™s", "die grГ¶Гџe", "ок ╨╛╨║", "lost �"])
def test_short_passages(spark, case):
    assert run(spark, [case])[0].garbled


def test_nulls_blanks_long_and_empty(spark):
    long = "чистый текст " * 20_000
    got = run(spark, [None, "", " ", long, long + garble("ёлка", "cp1252")])
    assert [x.garbled for x in got[:5]] == [False, False, False, False, True]
    assert got[0].repaired is None and got[4].repaired == long + "ёлка"
    assert repair_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_copies_of_a_garbled_text_stay_garbled(spark):
    clean = "Разметчик отметил согласие, хотя прототип упомянут вскользь."
    copies = len(BODY) // 2
    for written, read in (("koi8-r", "cp1251"), ("cp1251", "koi8-r")):
        got = run(spark, [clean.encode(written).decode(read)] * copies)
        assert [x.repaired for x in got[:copies]] == [clean] * copies
        assert [x.repaired for x in got[copies:]] == BODY
    assert all(x.garbled for x in run(spark, [clean.encode("cp866").decode("cp1251")] * copies)[:copies])


def test_single_signs_and_letters_restored(spark):
    clean = ["tâche nº 5", "le cœur du fil", "© 2023", "prix 15 £", "Smørrebrød", "il a noté « accord » hier", "łódka"]
    got = run(spark, [garble(t, "cp1252") for t in clean])
    assert [x.repaired for x in got[: len(clean)]] == clean
    assert [x.repaired for x in got[len(clean) :]] == BODY


#: (text, written in, read as): western and Central European letters, two letters alone, and UTF-16.
SHORT = [
    ("ok да ok", "koi8-r", "cp1251"), ("größer", "latin-1", "cp1251"), ("señor Núñez", "latin-1", "cp437"), ("größer", "utf-8", "cp1250"), ("żółw śpi", "utf-8", "cp1250"),
    ("é já não", "cp1252", "mac_roman"), ("größer Text", "utf-16-le", "latin-1"), ("Привет всем", "utf-16-le", "latin-1"), ("nada más", "utf-8", "mac_roman"),
]


def test_other_encodings_and_short_runs(spark):
    texts = [t.encode(w).decode(r, "replace") if "utf-8" != w else garble(t, r) for t, w, r in SHORT]
    got = run(spark, texts)
    wrong = [(t, x.repaired) for (t, _, _), x in zip(SHORT, got) if x.repaired != t]
    assert len(wrong) <= 2, wrong
    assert [x.repaired for x in got[len(SHORT) :]] == BODY


def test_layers_are_undone_to_the_last(spark):
    text = clean = "Überprüfung der Größe"
    for _ in range(6):
        text = garble(text, "cp1252")
    got = run(spark, [text])[0]
    assert (got.repaired, got.layers) == (clean, 6)
