"""The small labelled table from which the personal-information model learns, made by rule from a seed.

Names are common real ones of many countries and ones put together from syllables, the rest is made up: sentence
frames with slots for personal items, and frames without any. Nothing is taken from the texts the model is used
on. A sentence is a list of (text, label) pieces; label is one of ``TYPES`` or None.

Every list is split by place: ``share="learn"`` leaves out each fifth frame, name and word, ``share="held"`` uses
those alone, so that a model can be measured on frames and names that it never saw.
"""

from __future__ import annotations

import random
import re
from collections.abc import Sequence

TYPES = ("email", "phone", "id_number", "address", "name")

# ------------------------------------------------------------------------------------------------ names

RU_MEN = "Александр Алексей Анатолий Андрей Антон Аркадий Артём Борис Вадим Валентин Валерий Василий Виктор Виталий Владимир Вячеслав Геннадий Георгий Григорий Даниил Денис Дмитрий Евгений Егор Иван Игорь Илья Кирилл Константин Лев Леонид Максим Матвей Михаил Никита Николай Олег Павел Пётр Роман Руслан Савелий Семён Сергей Станислав Степан Тарас Тимофей Фёдор Эдуард Юрий Яков Ярослав Рустам Марат Азамат".split()
RU_WOMEN = "Александра Алина Алла Анастасия Ангелина Анна Валентина Валерия Варвара Вера Вероника Виктория Галина Дарья Диана Евгения Екатерина Елена Елизавета Жанна Зинаида Зоя Инна Ирина Карина Кристина Ксения Лариса Лидия Людмила Маргарита Марина Мария Надежда Наталья Нина Оксана Ольга Полина Раиса Регина Светлана София Таисия Тамара Татьяна Ульяна Юлия Яна Гульнара Лейла".split()
RU_FAMILIES = "Иванов Смирнов Кузнецов Попов Васильев Петров Соколов Михайлов Новиков Фёдоров Морозов Волков Алексеев Лебедев Семёнов Егоров Козлов Степанов Николаев Орлов Андреев Макаров Никитин Захаров Зайцев Соловьёв Борисов Яковлев Григорьев Романов Воробьёв Сергеев Фролов Гусев Кудрявцев Пушкин Лермонтов Достоевский Островский Жуковский Белинский Чайковский Шевченко Бондаренко Ткаченко Коваленко Лысенко Савченко Гончар Мельник Седых Черных Долгих Ким Цой Мурадян Гиоргадзе".split()
EN_GIVEN = (
    "James John Robert Michael William David Richard Joseph Charles Christopher Daniel Matthew Anthony Andrew Steven George Kevin Brian Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric "
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Betty Sandra Ashley Kimberly Emily Donna Michelle Amanda Melissa Deborah Stephanie Rebecca Laura Helen "
    "Priya Arjun Deepika Rahul Ananya Vikram Wei Li Xin Mei Hiroshi Yuki Kenji Sakura Min-jun Ji-woo Fatima Omar Ahmed Layla Yusuf Amina Hassan Kwame Chidi Ngozi Amara Zanele Aoife Siobhan Liam Seamus"
).split()
DE_GIVEN = "Hans Peter Klaus Wolfgang Jürgen Dieter Manfred Uwe Günter Horst Bernd Frank Stefan Andreas Matthias Sebastian Florian Lukas Felix Leon Moritz Ursula Monika Petra Sabine Renate Heike Gisela Brigitte Katrin Anja Birgit Claudia Nicole Johanna Lena Hannah Katharina Jörg Björn Jean-Luc Chloé Amélie Giulia Lorenzo Matteo Sven Ingrid Lars Astrid Zofia Tomasz Agnieszka".split()
ES_GIVEN = "José Antonio Manuel Francisco Juan Luis Javier Carlos Jesús Miguel Ángel Rafael Fernando Pablo Sergio Alejandro Jorge Alberto Álvaro Enrique Raúl Rubén Ana Carmen Isabel Dolores Josefa Teresa Lucía Cristina Marta Paula Guadalupe Rosario Concepción Beatriz Silvia Rocío Inmaculada Ximena Joaquim Rui João Catarina Inês Thiago".split()
EN_FAMILIES = "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Thomas Moore Jackson Martin Thompson White Harris Clark Lewis Robinson Walker Young Allen Wright Scott Hill Green Adams Baker Nelson Carter Mitchell Roberts Turner Phillips Campbell Parker Evans Edwards Collins Stewart Watson Morgan Cooper Bailey Kelly Howard Cox Patel Sharma Singh Gupta Raghunathan Krishnamurthy Zhang Wang Chen Nguyen Tanaka Suzuki Park Choi Hassan Al-Sayed El-Amin Okafor Mensah Dlamini O'Brien O'Connor McDonald MacGregor Picard Dubois Rossi Bianchi Kowalski Nowak".split()
DE_FAMILIES = "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Schäfer Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun Krüger Hofmann Hartmann Lange Schmitt Werner Krause Lehmann Köhler Herrmann König Walter Mayer Huber Kaiser Fuchs Peters Scholz Möller Weiß Jung Hahn Vogel Friedrich Keller Günther Berger Winkler Lorenz".split()
ES_FAMILIES = "García Rodríguez González Fernández López Martínez Sánchez Pérez Gómez Martín Jiménez Ruiz Hernández Díaz Moreno Muñoz Álvarez Romero Alonso Gutiérrez Navarro Torres Domínguez Vázquez Ramos Gil Ramírez Serrano Blanco Molina Morales Suárez Ortega Delgado Castro Ortiz Rubio Marín Sanz Iglesias Núñez Medina Garrido Silva Ferreira Costa".split()

_RU_HEADS = "ба бел бор вар вет вол гал гор гра гус дав дем дол дор ерм жар жел зар зол зуб кар ков кол кон кор кра куз куп лаз лап лис лук мак мар мед мир мор нос обр ор пав пан пет пол при рад раз рог руб сав сан сер син ско сок сол сто суд там тер тих тру уш фил хар хол цар чай чер шар шил шум щег юд яг яр".split()
_RU_MIDDLES = "а ав ад ак ал ан ап ар ат ач ев ед ел ем ен ер ец ик ил им ин ир ит иц иш об ов ог ок ол он оп ор ос от ох оч уг ук ул ун уп ур ус ут уш ыг ык ыл ын ыт ыш ян яч".split()
_RU_ENDS = "ов ов ов ев ин ин ин ёв ский цкий енко енко ук юк чук ян швили их ых ец".split()
_HEADS = "ab ad al an ar bal bar bel ber bir bon bra bre bur cal can car cas cor cra dal dan dar del der don dra dun ed el em far fel fen fin for gal gar gil gor gra gre hal ham har hel hol hud ing jar jen kar kel ken kir lan lar lem lin lor mal man mar mel mer mil mor nal nel nor ol or par pel per pin por pra ram ran rel ric ros sal san sel ser sil sor stan tal tan tar tel ter tol tra tur ul ur val van var ver vil vor wal war wel wil win wor yar zel zim".split()
_MIDDLES = "a e i o u an en in on ar er or el al il ad ed and end ing ist ost ast ett ill all ell ick ock ack ath eth am em im om av ev".split()
_ENDS = "son sen ton ham ley ford wood man mann berg stein feld bach burg er ez es ero illo ano ini elli etti sky ski wicz ic os is as an ian yan ez ado ard ell ett ley low den dale by thwaite more combe gate worth well ridge stock hurst nd ck th le ne ra ma ya".split()


class _Draw:
    """Chance with a share of every list: all of it, what a model learns from, or what is held out."""

    def __init__(self, seed: int, share: str) -> None:
        self.random, self.share = random.Random(seed), share

    def among(self, options: Sequence) -> object:
        """One of the options that the share holds; lists too short to split are whole in every share."""
        if self.share != "all" and len(options) >= 5:
            options = options[::5] if self.share == "held" else [o for i, o in enumerate(options) if i % 5]
        return self.random.choice(options)

    def form(self, options: Sequence) -> object:
        """One of the options, whatever the share: spellings of the same item."""
        return self.random.choice(options)

    def chance(self, p: float) -> bool:
        return self.random.random() < p

    def digits(self, n: int) -> str:
        return "".join(self.random.choice("0123456789") for _ in range(n))

    def letter(self) -> str:
        return self.random.choice("ABCDEFGHJKLMNPRSTUVWXYZ")


def _ru_case(d: _Draw, word: str, woman: bool, family: bool, case: int) -> str:
    """``word`` in one of the cases: 0 nominative, 1 genitive, 2 dative, 3 instrumental, 4 prepositional."""
    if not case:
        return word
    k = case - 1
    if family:
        if word.endswith(("ский", "цкий")):
            return word[:-2] + ("ого", "ому", "им", "ом")[k]
        if word.endswith(("ская", "цкая")):
            return word[:-2] + "ой"
        if word.endswith(("ова", "ева", "ёва", "ина")):
            return word[:-1] + ("ой", "ой", "ой", "ой")[k]
        if word.endswith(("ов", "ев", "ёв", "ин")):
            return word + ("а", "у", "ым", "е")[k]
        if woman or word.endswith(("енко", "ых", "их", "дзе", "швили")):
            return word
        return word + ("а", "у", "ом", "е")[k]
    if word.endswith("ия"):
        return word[:-1] + ("и", "и", "ей", "и")[k]
    if word.endswith("ий"):
        return word[:-1] + ("я", "ю", "ем", "и")[k]
    if word.endswith(("й", "ь")):
        return word[:-1] + ("я", "ю", "ем", "е")[k]
    if word.endswith("я"):
        return word[:-1] + ("и", "е", "ей", "е")[k]
    if word.endswith("а"):
        return word[:-1] + ("ы", "е", "ой", "е")[k]
    base = {"Лев": "Льв", "Пётр": "Петр", "Павел": "Павл"}.get(word, word)
    return base + ("а", "у", "ом", "е")[k]


def _ru_parts(d: _Draw) -> tuple[str, str, str]:
    """(given name, patronymic, family name), all in one case."""
    woman, case = d.chance(0.5), d.form([0, 0, 0, 0, 1, 2, 3, 4])
    given = d.among(RU_WOMEN if woman else RU_MEN)
    if d.chance(0.25):
        given = (d.form(_RU_HEADS) + d.form(_RU_MIDDLES) + (d.form(["а", "ия", "я", "ина"]) if woman else d.form(["", "ий", "ей", "ан", "ис"]))).capitalize()
    if d.chance(0.3):
        family = d.among(RU_FAMILIES)
    else:
        family = (d.form(_RU_HEADS) + (d.form(_RU_MIDDLES) if d.chance(0.75) else "") + (d.form(_RU_MIDDLES) if d.chance(0.15) else "") + d.form(_RU_ENDS)).capitalize()
    if woman:
        family = family[:-2] + "ая" if family.endswith(("ский", "цкий")) else family + "а" if family.endswith(("ов", "ев", "ёв", "ин")) else family
    father = d.among(RU_MEN).rstrip("йьа")
    patronymic = father + (d.form(["овна", "евна"]) if woman else d.form(["ович", "евич"]))
    return _ru_case(d, given, woman, False, case), _ru_case(d, patronymic, woman, not woman, case), _ru_case(d, family, woman, True, case)


def _made_up(d: _Draw, ends: Sequence[str]) -> str:
    return (d.form(_HEADS) + (d.form(_MIDDLES) if d.chance(0.6) else "") + d.form(ends)).capitalize()


def _other_parts(d: _Draw, lang: str) -> tuple[str, str]:
    givens, families = {"en": (EN_GIVEN, EN_FAMILIES), "de": (DE_GIVEN, DE_FAMILIES), "es": (ES_GIVEN, ES_FAMILIES)}[lang if d.chance(0.8) else d.form(["en", "de", "es"])]
    given = d.among(givens) if d.chance(0.5) else _made_up(d, ["", "a", "o", "ie", "us", "en", "in", "is", "elle", "ine", "ard", "il", "ya", "eth"])
    family = d.among(families) if d.chance(0.35) else _made_up(d, _ENDS)
    if d.chance(0.1):
        family += "-" + (d.among(families) if d.chance(0.3) else _made_up(d, _ENDS))
    elif d.chance(0.05):
        family = d.form(["von ", "van ", "de ", "de la ", "da ", "di ", "O'", "Mc", "Al-", "van der "]) + family
    return given, family


def name(d: _Draw, lang: str) -> str:
    middle = ""
    if lang == "ru":
        given, patronymic, family = _ru_parts(d)
        middle = patronymic if d.chance(0.12) else ""
    else:
        given, family = _other_parts(d, lang)
        if lang == "es" and d.chance(0.15):
            family += " " + d.among(ES_FAMILIES)
        elif d.chance(0.05):
            middle = d.letter() + "."
    one, two = given[0] + ".", d.form("АБВГДЕЗИКЛМНОПРСТФЮЯ" if lang == "ru" else "ABCDEFGHIJKLMNOPRSTW") + "."
    gap = d.form([" ", "", " ", " "])
    whole = f"{given} {middle} {family}" if middle else f"{given} {family}"
    last = f"{family} {given} {middle}" if middle and lang == "ru" else f"{family} {given}"
    text = d.form([whole, whole, whole, whole, last, last, f"{family}, {given}", f"{one}{gap}{family}", f"{one}{gap}{two}{gap}{family}", f"{family} {one}{gap}{two}", f"{family} {one}", f"{family}, {one}"])
    shape = d.random.random()
    return text.upper() if shape < 0.08 else text.lower() if shape < 0.2 and "." not in text else text


# ---------------------------------------------------------------------------------------------- numbers


def _grouped(d: _Draw, sizes: Sequence[int], gap: str) -> str:
    return gap.join(d.digits(n) for n in sizes)


def phone(d: _Draw, lang: str) -> str:
    gap = d.form([" ", " ", "-", "-", ".", "", "‑", " "])
    if lang == "ru":
        code, rest = d.form(["9", "9", "4", "8", "3", "0"]) + d.digits(2), d.form([(3, 2, 2), (3, 2, 2), (3, 4), (2, 2, 3)])
        inner = _grouped(d, rest, d.form([gap, gap, "-", " "]))
        text = d.form([f"+7{gap}{code}{gap}{inner}", f"8{gap}{code}{gap}{inner}", f"+7 ({code}) {inner}", f"8 ({code}) {inner}", f"+7({code}){inner}", f"8({code}){inner}", f"({code}) {inner}", f"+7{code}{d.digits(7)}", f"8{code}{d.digits(7)}", f"{code}-{d.digits(3)}-{d.digits(2)}-{d.digits(2)}", f"+375{gap}{d.digits(2)}{gap}{_grouped(d, (3, 2, 2), gap)}"])
        tail = d.form([" доб. ", " доб ", ", доб. ", " (доб. "])
    else:
        abroad = d.form({"en": ["1", "44", "61", "353", "91", "1"], "de": ["49", "43", "41", "33", "48", "39"], "es": ["34", "52", "351", "54", "57", "55"]}[lang])
        sizes = d.form({"en": [(3, 3, 4), (3, 3, 4), (4, 6), (4, 3, 3), (2, 4, 4), (5, 5), (2, 3, 4)], "de": [(2, 8), (3, 7), (2, 5, 3), (3, 4, 3), (2, 3, 2, 2), (4, 6), (1, 2, 2, 2, 2), (2, 6), (3, 3, 3)], "es": [(3, 3, 3), (3, 2, 2, 2), (2, 3, 2, 2), (2, 4, 4), (3, 6), (9,), (2, 3, 4)]}[lang])
        inner = _grouped(d, sizes, gap)
        first, others = inner[: sizes[0]], inner[sizes[0] :].lstrip("-. ‑ ")
        area = d.digits(sizes[0])
        text = d.form([f"+{abroad}{gap}{inner}", f"+{abroad} {inner}", f"00{abroad}{gap}{inner}", f"00{abroad} {inner}", f"+{abroad} ({area}) {others}", f"({area}) {others}", f"(0{area}) {others}", f"0{inner}", f"0{area}/{others}" if lang == "de" else f"({area}){others}", f"{first}{gap or '-'}{others}" if sum(sizes) > 8 else f"0{inner}", f"+{abroad}{d.digits(sum(sizes))}", f"0{d.digits(9)}"])
        tail = {"en": d.form([" ext. ", " x", " ext "]), "de": d.form([" App. ", " Durchwahl "]), "es": d.form([" ext. ", " int. "])}[lang]
    text = text.strip()
    if d.chance(0.07):
        text = text.translate({ord(c): ord(c) + 0xFEE0 for c in "0123456789"})
    return text + tail + d.digits(d.form([2, 3])) if d.chance(0.1) else text


def _code(d: _Draw, pattern: str) -> str:
    """``pattern`` with a digit for each 9 and a letter for each A."""
    return "".join(d.random.choice("0123456789") if c == "9" else d.letter() if c == "A" else c for c in pattern)


ID_KINDS = {
    "ru": [
        (["паспорт ", "паспорт: ", "номер паспорта ", "паспорт серии ", "загранпаспорт ", "серия и номер: ", "данные паспорта "], ["9999 999999", "99 99 999999", "9999999999", "9999 № 999999", "9999№999999", "99 9999999"]),
        (["СНИЛС ", "СНИЛС: ", "снилс ", "номер СНИЛС ", "страховое свидетельство "], ["999-999-999 99", "999 999 999 99", "99999999999", "999-999-99999"]),
        (["ИНН ", "ИНН: ", "инн ", "налоговый номер "], ["999999999999", "9999999999", "9999 999999 99"]),
        (["удостоверение ", "удостоверение личности ", "документ ", "документ № ", "полис ", "водительское "], ["9999999999", "9999 999999", "99 99 999999", "AA 9999999"]),
    ],
    "en": [
        (["passport ", "passport number ", "passport no ", "Passport: ", "travel document "], ["A99999999", "999999999", "AA9999999", "AA 999999", "99 9999999"]),
        (["SSN ", "SSN: ", "social security number ", "social security no. ", "social "], ["999-99-9999", "999 99 9999", "999999999"]),
        (["NI number ", "NINO ", "insurance number ", "National Insurance no. "], ["AA 99 99 99 A", "AA999999A", "AA 999999 A"]),
        (["identity card ", "ID number ", "ID: ", "identity no. ", "driving licence "], ["999999999", "A99999999", "AA999999", "99999999", "AAA999999"]),
        (["tax id ", "TIN ", "taxpayer number ", "tax reference ", "UTR "], ["99 9999999", "9999999999", "99999 99999", "999-99-9999", "99-9999999"]),
    ],
    "de": [
        (["Ausweis ", "Ausweis-Nr. ", "Personalausweisnummer ", "Ausweis Nummer: "], ["A99A99A999", "A99999999", "AA9A9A999", "A9AA99A99"]),
        (["Steuernummer ", "Steueridentifikationsnummer ", "IdNr. ", "Steuer-Nr. "], ["99 999 999 999", "99999999999", "99/999/99999", "999/999/99999"]),
        (["Reisepassnummer ", "Pass-Nr. ", "Pass ", "Passnummer: "], ["A99A99A99", "A99999999", "AA9999999"]),
        (["Versicherungsnummer ", "SV-Nummer ", "Rentenversicherung ", "Sozialversicherung: "], ["99 999999 A 999", "99999999A999", "9999 999999"]),
    ],
    "es": [
        (["DNI ", "DNI: ", "DNI nº ", "documento de identidad ", "carnet "], ["99999999A", "99999999-A", "99.999.999-A", "99999999 A"]),
        (["NIE ", "NIE nº ", "tarjeta de extranjero "], ["A9999999A", "A-9999999-A", "A 9999999 A"]),
        (["número de pasaporte ", "pasaporte nº ", "pasaporte: "], ["AAA999999", "A99999999", "AA999999"]),
        (["Seguridad Social ", "NIF ", "número fiscal ", "afiliación "], ["99 99999999 99", "999999999999", "99/99999999/99", "99999999A"]),
    ],
}
ID_TAILS = {
    "ru": ["", "", ".", ", выдан в прошлом году", " просрочен", ", сверьте", " — мой", ", копию отправила"],
    "en": ["", "", ".", ", copy enclosed", " was issued last year", ", please verify", " is mine", " (valid)"],
    "de": ["", "", ".", ", Kopie folgt", " ist abgelaufen", ", bitte abgleichen", " gehört mir"],
    "es": ["", "", ".", ", copia enviada", " está caducado", ", compruébalo", " es mío"],
}
ID_LEADS = {
    "ru": ["", "", "мой ", "вот ", "её ", "указан ", "у меня "],
    "en": ["", "", "my ", "here is the ", "her ", "use ", "his "],
    "de": ["", "", "mein ", "meine ", "hier ", "sein "],
    "es": ["", "", "mi ", "su ", "aquí el ", "el "],
}


def id_number(d: _Draw, lang: str) -> tuple[str, str, str]:
    """(what stands before, the number, what stands after)."""
    kinds, patterns = d.form(ID_KINDS[lang])
    if d.chance(0.15):
        lang = d.form(["en", "de", "es"])
        patterns = d.form(ID_KINDS[lang])[1]
    number = _code(d, d.form(patterns))
    if d.chance(0.4) and number[0].isdigit():
        zeros = d.form([1, 2, 3])
        number = "".join("0" if c.isdigit() and i < zeros else c for i, c in enumerate(number))
    lead, kind = d.among(ID_LEADS[lang]), d.among(kinds)
    if d.chance(0.1):
        kind = kind.rstrip(" :") + d.form([" № ", " — ", " = ", " # "])
    if lang == "es" or lang == "en":
        kind = kind.rstrip() + d.form([" ", " ", " is ", ": "]) if lang == "en" and d.chance(0.3) else kind.rstrip() + d.form([" ", " es "]) if lang == "es" and d.chance(0.3) else kind
    return lead + kind, number, d.among(ID_TAILS[lang])


# ---------------------------------------------------------------------------------------------- places

RU_ADJECTIVES = "Советская Молодёжная Центральная Школьная Набережная Октябрьская Первомайская Вокзальная Солнечная Полевая Луговая Рабочая Московская Гагаринская Кирова Ленина Пушкина Гоголя Чехова Мира Победы Труда Космонавтов Строителей Шахтёров Железнодорожная Невская Тверская Арбатская Ямская".split()
RU_TOWNS = "Москва Казань Самара Омск Пермь Тула Рязань Томск Уфа Вологда Псков Тверь Минск Саратов Воронеж".split()
EN_NOUNS = "Main Church High Park Oak Pine Maple Cedar Washington Victoria Station Queen King Bridge Lake Hill Spring River Meadow Franklin Highland Willow Baker Albert Kingston Windsor Sunset Jefferson Lincoln Cherry".split()
EN_KINDS = "Street Street Avenue Road Road Lane Drive Close Court Square Place Way Terrace Boulevard Crescent Gardens Row Hill Street St Ave Rd".split()
EN_TOWNS = "London Boston Leeds Denver Austin Bristol Dublin Seattle Glasgow Toronto Sydney Oxford York Portland".split()
DE_STEMS = "Haupt Bahnhof Garten Berg Dorf Kirch Wald Ring Wiesen Schiller Goethe Mozart Rosen Sonnen Schul Post Markt Burg Friedrich Kaiser Bismarck Lessing Buchen Eichen Tannen Ahorn".split()
DE_TOWNS = "Berlin Hamburg München Köln Frankfurt Bremen Leipzig Dresden Bonn Kassel Ulm Mainz Kiel".split()
ES_NAMES = "Mayor|del Carmen|Real|Alcalá|de la Constitución|San Juan|San Pedro|Cervantes|Goya|Velázquez|Serrano|del Sol|de la Paz|Colón|de España|Santa Ana|Nueva|Libertad|Gran Vía|Aragón|de los Reyes|las Flores|Buenavista|Zurbano|Lope de Vega".split("|")
ES_TOWNS = "Madrid Sevilla Valencia Bilbao Granada Zaragoza Málaga Murcia Vigo Toledo Salamanca".split()


def _street(d: _Draw, lang: str) -> str:
    if lang == "ru":
        if d.chance(0.4):
            return d.among(RU_ADJECTIVES)
        stem = (d.form(_RU_HEADS) + d.form(_RU_MIDDLES)).capitalize()
        way = d.random.random()
        if way < 0.5:
            return stem + d.form(["ская", "ная", "овская", "ная", "инская", "чная", "вая", "ий", "ый", "ская"])
        if way < 0.7:
            return stem + d.form(["ова", "ина", "ого", "ов", "ей", "ников", "а", "и", "ских"])
        return d.form(["Большая", "Малая", "Нижняя", "Верхняя", "Старая", "Новая", "Первая", "Третья", "Малой", "Большого", "Старого", "Второго", "Верхних", "Сухой", "8 Марта", "Красных", "Героев"]) + " " + stem + d.form(["ская", "ная", "ого", "ина", "ов", "ы", "а", "и", "ки"])
    if lang == "en":
        if d.chance(0.45):
            return d.among(EN_NOUNS)
        way = d.random.random()
        return _made_up(d, _ENDS) if way < 0.6 else d.form(["Old", "New", "North", "South", "West", "East", "Upper", "Lower", "Great", "Little", "St", "Long", "Saint"]) + " " + (d.among(EN_NOUNS) if d.chance(0.5) else _made_up(d, _ENDS))
    if lang == "de":
        stem = d.among(DE_STEMS) if d.chance(0.4) else _made_up(d, ["", "er", "en", "s", "bach", "en", "feld", "hof", "berg", "er"])
        kind = d.form(["straße", "straße", "str.", "weg", "gasse", "allee", "platz", "ufer", "ring", "damm", "steig", "graben", "pfad", "strasse"])
        way = d.random.random()
        if way < 0.6:
            return stem + kind
        if way < 0.75:
            return stem + d.form(["er ", " ", "er "]) + kind.capitalize()
        if way < 0.88:
            return d.form(["Alte", "Neue", "Kleine", "Große", "Obere", "Untere", "Lange", "Breite", "Hohe"]) + " " + stem + kind
        return d.form(["Am", "An der", "Im", "Zum", "Auf dem", "Unter den", "Zur", "Am Alten", "In der"]) + " " + stem + d.form(["berg", "tor", "markt", "brunnen", "mühle", "hof", "wall", "linden", "see", ""])
    if d.chance(0.45):
        return d.among(ES_NAMES)
    stem = _made_up(d, ["a", "o", "as", "os", "al", "ero", "illa", "edo", "anes", "ura"])
    return d.form(["", "", "de ", "del ", "la ", "La ", "El ", "Los ", "San ", "Santa ", "de las "]) + stem + d.form(["", "", "", " Alto", " Vieja", " Nuevo", " Real"])


def address(d: _Draw, lang: str) -> str:
    n, m = str(d.random.randint(1, 199)), str(d.random.randint(1, 99))
    s = _street(d, lang)
    if lang == "ru":
        kind = d.form(["ул. ", "ул. ", "улица ", "ул ", "ул.", "пр. ", "пр-т ", "проспект ", "пер. ", "переулок ", "пл. ", "площадь ", "бульвар ", "б-р ", "наб. ", "набережная ", "ш. ", "шоссе ", "проезд ", "тупик "])
        house = d.form([f" {n}", f", {n}", f", д. {n}", f", д.{n}", f" д. {n}", f", дом {n}", f" дом {n}", f", {n}{d.form('абк')}", f", {n}/{m}", f", {n}к{m[0]}", f", д. {n} корп. {m[0]}", f", д. {n}, стр. {m[0]}"])
        flat = d.form(["", "", "", f", кв. {m}", f"-{m}", f", кв.{m}", f", квартира {m}", f" кв {m}", f", оф. {m}", f", под. {m[0]}, кв. {m}"])
        back = d.form([" ул.", " улица", " пер.", " проезд", " наб.", " пр-т", " шоссе", " бульвар"])
        text = d.form([f"{kind}{s}{house}{flat}"] * 6 + [f"{s}{back}{house}{flat}"] * 3 + [f"кв. {m}, {kind}{s}{house}", f"д. {n}, {kind}{s}", f"дом {n} по {s}{back}", f"{n}, {kind}{s}"])
        town = d.among(RU_TOWNS)
    elif lang == "en":
        k = d.form(EN_KINDS)
        house = d.form([n, n, n, n, n + d.form("ABCabc"), f"{n}-{m}", f"{n}/{m}"])
        after = d.form(["", "", "", "", f", Apt {m}", f", flat {m}", f" #{m}", f", unit {m}", f", suite {m}", f", floor {m[0]}", f", Apt. {m}B"])
        text = d.form([f"{house} {s} {k}{after}"] * 6 + [f"Flat {m}, {house} {s} {k}", f"Apt {m}, {house} {s} {k}", f"Unit {m}/{house} {s} {k}", f"Apartment {m}, {house} {s} {k}", f"{s} {k} {n}", f"Suite {m}, {house} {s} {k}", f"Flat {m}B, {house} {s} {k}"])
        town = d.among(EN_TOWNS)
    elif lang == "de":
        text = d.form([f"{s} {n}", f"{s} {n}", f"{s} {n}{d.form('abc')}", f"{s} {n} {d.form('abc')}", f"{s} {n}/{m}", f"{s} {n}-{m}", f"{s} {n}, {m[0]}. Stock", f"{s} {n}, Wohnung {m}", f"{s} Nr. {n}", f"Wohnung {m}, {s} {n}"])
        town = f"{d.digits(5)} {d.among(DE_TOWNS)}"
    else:
        kind = d.form(["calle ", "calle ", "C/ ", "C/", "Calle ", "c/ ", "avenida ", "Avda. ", "Av. ", "plaza ", "Plaza ", "paseo ", "Pza. ", "carrera ", "camino ", "ronda ", "travesía ", "c. ", "rúa ", "Paseo "])
        house = d.form([f" {n}", f", {n}", f" nº {n}", f", nº {n}", f" número {n}", f", n.º {n}", f" {n}{d.form('AB')}", f" #{n}"])
        flat = d.form(["", "", "", f", {m[0]}º {d.form('ABCD')}", f", {m[0]}º{d.form('ABCD')}", f", piso {m[0]}", f", {m[0]}º dcha.", f", bajo", f", puerta {m}", f", ático"])
        text = d.form([f"{kind}{s}{house}{flat}"] * 8 + [f"piso {m[0]}, {kind}{s}{house}", f"puerta {m}, {kind}{s}{house}"])
        town = d.among(ES_TOWNS)
    if d.chance(0.25):
        text = f"{text}, {town}"
    elif lang == "ru" and d.chance(0.06):
        text = f"{text}, г. {town}"
    shape = d.random.random()
    return text.lower() if shape < 0.08 else text.upper() if shape < 0.12 else text


_BOXES = "support office anna ivan.petrov j.smith helpdesk mkl-22 b_ross team user k.w мария admin вопросы o'neil lena contact d.lopez nik_nik frontdesk hr zz9 purchase".split()
_DOMAINS = "example example sample acme mymail webbox inbox uni-city city-library school12 openlab posta bigcorp пример студия north-lab".split()
_SUFFIXES = "com org net ru de es co.uk info io edu test invalid example com.br рф онлайн".split()


def email(d: _Draw) -> str:
    local = d.among(_BOXES) if d.chance(0.6) else _made_up(d, _ENDS).lower()
    if d.chance(0.12):
        local = d.form(_RU_HEADS) + d.form(_RU_MIDDLES) + d.form(["", "ка", "ник", "ов"])
    elif d.chance(0.3):
        local = d.form([d.letter().lower() + d.form([".", "_", "-", ""]) + local, local + d.form([".", "_", "-"]) + _made_up(d, _ENDS).lower()])
    if d.chance(0.4):
        local += d.form(["", "_", ".", "-"]) + d.digits(d.random.randint(1, 4))
    if d.chance(0.1):
        local += d.form(["+news", "+spam", "+shop", "+a1"])
    host = (d.among(_DOMAINS) if d.chance(0.4) else _made_up(d, _ENDS).lower()) + "." + d.form(_SUFFIXES)
    if d.chance(0.1):
        host = d.form(_RU_HEADS) + d.form(_RU_MIDDLES) + "." + d.form(["рф", "москва", "онлайн", d.form(_RU_HEADS) + d.form(_RU_MIDDLES)])
    elif d.chance(0.12):
        host = _made_up(d, _ENDS).lower() + d.form(["-", ".", d.digits(1) + "."]) + host
    if d.chance(0.25):
        host = d.form(["mail.", "post.", "smtp.", "my.", "de."]) + host
    at, dot = d.form(["@"] * 12 + ["＠", " @ ", " [at] ", "[at]", " (at) ", "(at)", " {at} ", " собака ", " at ", " arroba ", " [собака] "]), "."
    if at.strip() not in ("@", "＠"):
        dot = d.form({"соб": [" точка ", ".", " [точка] "], "arr": [" punto ", "."]}.get(re.sub(r"\W", "", at)[:3], [" [dot] ", ".", " (dot) ", " dot ", "[dot]"]))
        if at == " at ":
            dot = " dot "
    text = local + at + host.replace(".", dot)
    return text.upper() if d.chance(0.08) else text


# ---------------------------------------------------------------------------------------------- frames

#: Frames with one item each: {} stands for it.
FRAMES = {
    "ru": {
        "name": ["договор оформлен на {}", "{} придёт позже", "{} просил передать привет", "{} не отвечает", "директор {}", "с уважением, {}", "Меня зовут {}, добрый день", "отправил {}, ответа нет", "со слов {} всё готово", "спроси {} про отпуск", "поговорил с {} вчера", "{}: согласен", "автор — {}", "врач {} принимает по средам", "участники: {}", "говорила {} с нами, она не против", "по просьбе {} добавляю", "за подписью {}", "г-н {} приехал", "тов. {}, зайдите", "назначили {} старшим", "нашла {} в списке", "{} и остальные согласны", "ведёт группу {}", "пишет {}", "встречались с {} на той неделе", "поздравьте {}!", "{}", "это был {}?", "капитан {} на месте", "тренер {}", "позовите {} к телефону"],
        "phone": ["мобильный: {}", "позвоните по {}", "телефон для связи {}, спросите дежурного", "мой телефон {}", "дозвониться можно так: {}", "тел {}", "{} (рабочий)", "запиши номер: {}", "номер для справок {}", "ватсап {}", "контакт {}", "перезвони на {} вечером", "{}", "смс сюда {}, спасибо", "горячая линия {}"],
        "address": ["мы переехали: {}", "доставка по адресу {}", "прописан {}", "встречаемся у {}", "проживает: {}", "склад находится {}", "приезжайте на {}", "курьер ждёт, {}", "адрес {} верный", "забрать можно здесь: {}", "отправьте документы на {}", "{}", "{}, вход со двора", "сдаётся квартира, {}", "наш дом — {}"],
        "email": ["отправьте на {}", "электронная почта: {}", "мой ящик {}", "ответ на {}, пожалуйста", "e-mail {}", "почтой: {}", "{}", "адрес почты {} не работает", "дублирую на {}", "письма сюда: <{}>", "связь через {}"],
    },
    "en": {
        "name": ["contract prepared for {}", "{} will be late", "{} sends regards", "{} did not answer", "director {}", "sincerely, {}", "Hello, I am {} from accounting", "forwarded to {}, no reply yet", "according to {} it is done", "ask {} about the holiday", "spoke with {} yesterday", "{}: agreed", "author - {}", "Doctor {} sees patients on Tuesday", "attendees: {}", "she met {} last year", "on behalf of {} I add this", "signature: {}", "Mrs. {} arrived", "Prof. {}, come in", "we made {} the lead", "found {} in the register", "{} and the others approve", "led by {}", "written by {}", "lunch with {} on Monday", "congratulations to {}!", "{}", "was it {}?", "Captain {} reports", "Coach {} agreed", "Miss {} phoned", "put {} on the line", "thanks, {}", "{} called me", "the patient {} was admitted", "I think {} wrote that part", "then {} said no"],
        "phone": ["mobile: {}", "reach me at {}", "contact number {}, ask for the desk", "my phone {}", "you can dial {}", "ph. {}", "{} (work)", "write down this number: {}", "hotline {}", "WhatsApp {}", "fax {}", "ring {} tonight", "{}", "sms here {}, thanks", "call me back on {}", "cell {}"],
        "address": ["we moved: {}", "ship it to {}", "registered at {}", "let us meet at {}", "residence: {}", "the warehouse is at {}", "come to {}", "courier waits, {}", "the address {} is right", "pick it up here: {}", "mail the papers to {}", "{}", "{}, back entrance", "flat for rent, {}", "she lives at {}"],
        "email": ["forward to {}", "e-mail address: {}", "my inbox {}", "reply to {}, please", "email {}", "by mail: {}", "{}", "the box {} bounces", "copy goes to {}", "write here: <{}>", "reachable through {}"],
    },
    "de": {
        "name": ["Vertrag läuft auf {}", "{} kommt später", "{} lässt grüßen", "{} antwortet nicht", "Leiter {}", "mit freundlichen Grüßen, {}", "Ich heiße {}, guten Tag", "weitergeleitet an {}", "laut {} ist alles fertig", "fragen Sie {}", "gesprochen mit {}", "{}: einverstanden", "Autor: {}", "Dr. {} ist da", "Teilnehmer: {}", "im Auftrag von {}", "Hr. {} war hier", "Fr. {} bitte", "{} und die anderen stimmen zu", "geleitet von {}", "{}", "war das {}?", "Kapitän {} meldet", "Trainer {}", "danke, {}"],
        "phone": ["mobil: {}", "erreichbar unter {}", "meine Telefonnummer {}", "Telefon {}", "Fax {}", "{} (Büro)", "Rückruf an {} bitte", "{}", "wählen Sie {}", "Hotline {}", "Kontakt {}"],
        "address": ["wir sind umgezogen: {}", "Paket nach {}", "gemeldet in {}", "wohnhaft {}", "Treffpunkt {}", "das Lager ist {}", "Adresse {} stimmt", "Lieferadresse {}", "Büro {}", "Standort {}", "Firmensitz {}", "Wohnung {}", "Filiale {}", "Abholung hier: {}", "{}", "{}, Hintereingang", "zieht in die {}"],
        "email": ["weiterleiten an {}", "E-Mail-Adresse: {}", "mein Postfach {}", "Antwort an {} bitte", "per Mail: {}", "{}", "Kopie geht an {}", "schreiben Sie hierher: <{}>"],
    },
    "es": {
        "name": ["contrato a nombre de {}", "{} llegará tarde", "{} manda recuerdos", "{} no contesta", "director {}", "atentamente, {}", "Me llamo {}, buenos días", "reenviado a {}", "según {} está hecho", "habla con {}", "hablé con {} ayer", "{}: de acuerdo", "autor: {}", "la doctora {} atiende hoy", "asistentes: {}", "en nombre de {}", "Sra. {} llegó", "D. {} vendrá", "{} y los demás aprueban", "dirigido por {}", "{}", "¿era {}?", "el capitán {} avisa", "señor {}", "gracias, {}"],
        "phone": ["móvil: {}", "me encuentras en el {}", "teléfono de contacto {}", "mi teléfono {}", "marca el {}", "fax {}", "{} (trabajo)", "apunta este número: {}", "{}", "whatsapp {}", "llámame al {} luego"],
        "address": ["nos mudamos: {}", "envíalo a {}", "empadronado en {}", "quedamos en {}", "domicilio: {}", "el almacén está en {}", "la dirección {} es correcta", "recogida aquí: {}", "{}", "{}, entrada trasera", "vive en {}"],
        "email": ["reenvía a {}", "correo electrónico: {}", "mi buzón {}", "responde a {}, por favor", "email {}", "{}", "copia a {}", "escríbeme aquí: <{}>"],
    },
}

THINGS = {
    "ru": "договор|счёт|модель|сервер|задача|правка|таблица|вопрос|ответ|документ|книга|встреча|проект|машина|погода|музыка|кофе|ключ|дверь|команда|файл|кнопка|страница|глава|урок|поезд|рынок|заказ|список|план|код|тест|запрос|ошибка|группа|чат|канал|обед|окно|стул|цена|решение|пример|правило|версия|сборка|ветка|станция|доска|коробка|лекция|перевод|раздел|обзор|ремонт|двигатель|печь|линия|фильтр|экран|кабель|провод|бак|труба".split("|"),
    "en": "contract|invoice|model|server|task|patch|table|question|answer|document|book|meeting|project|car|weather|music|coffee|key|door|team|file|button|page|chapter|lesson|train|market|order|list|plan|code|test run|request|error|group|chat|channel|lunch|window|chair|price|decision|example|rule|version|branch|station|board|box|lecture|translation|section|review|repair|engine|oven|line|filter|screen|cable|wire|tank|pipe".split("|"),
    "de": "Vertrag Rechnung Modell Server Aufgabe Tabelle Frage Antwort Dokument Buch Treffen Projekt Auto Wetter Musik Kaffee Schlüssel Tür Gruppe Datei Knopf Seite Kapitel Zug Markt Bestellung Liste Plan Fehler Anfrage Fenster Stuhl Preis Beispiel Regel Fassung Bahnhof Kiste Vorlesung Übersetzung Abschnitt Prüfung Reparatur Motor Ofen Leitung Filter Bildschirm Kabel Rohr Termin Besprechung Lösung Messung Anlage".split(),
    "es": "contrato factura modelo servidor tarea tabla pregunta respuesta documento libro reunión proyecto coche tiempo música café llave puerta equipo archivo botón página capítulo lección tren mercado pedido lista plan código prueba error grupo canal ventana silla precio decisión ejemplo regla versión rama estación caja traducción sección revisión motor horno línea filtro pantalla cable tubo".split(),
}
#: The commonest nouns, weekdays and months of a language that capitalises them, and some of the others.
COMMON = {
    "ru": "время год человек дело жизнь день рука раз работа слово место лицо друг глаз мир дом случай город сторона голова ребёнок сила конец вид система часть женщина деньги земля мать история власть закон война бог путь право мысль месяц минута ночь тело школа неделя утро вечер час голос сердце имя центр область улица начало дорога процесс образ смысл условие мера язык цель результат интерес".split(),
    "en": "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work government number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city community name".split(),
    "de": "Zeit Jahr Tag Mensch Frau Mann Kind Welt Leben Haus Hand Land Stadt Weg Thema Ende Grund Teil Woche Monat Stunde Minute Seite Name Wort Bild Ort Fall Arbeit Schule Freund Mutter Vater Auge Kopf Nacht Abend Morgen Mittag Wasser Geld Recht Staat Krieg Problem Punkt Sache Stelle Zahl Form Art Weise Ziel Sinn Folge Raum Zimmer Straße Platz Grenze Kraft Licht Luft Erde Buch Brief Bericht Titel Text Satz Sprache Stimme Meinung Idee Gefühl Gespräch Anfang Mal Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag Januar Februar März April Mai Juni Juli August September Oktober November Dezember Firma Chef Kunde Büro Nummer Telefon Adresse Post".split(),
    "es": "tiempo año día cosa hombre mujer vida mundo casa vez mano parte país lugar trabajo punto forma caso niño hora noche ciudad agua historia problema grupo semana mes palabra madre padre amigo ojo cabeza dinero calle tierra guerra ley gobierno fuerza luz idea razón cuerpo lado nombre final verdad mesa sistema escuela número empresa campo centro cuenta".split(),
}
WHEN = {
    "ru": "вчера|через час|в среду|в понедельник|весной|ночью|скоро|потом|в прошлом году|к обеду|на неделе|в марте|во вторник|за месяц|уже".split("|"),
    "en": "yesterday|in an hour|on Wednesday|on Monday|in spring|at night|soon|later|last year|by noon|this week|in March|on Tuesday|within a month|already".split("|"),
    "de": "gestern|in einer Stunde|am Mittwoch|am Montag|im Frühling|nachts|bald|später|letztes Jahr|bis Mittag|diese Woche|im März|am Dienstag|schon".split("|"),
    "es": "ayer|en una hora|el miércoles|el lunes|en primavera|de noche|pronto|luego|el año pasado|a mediodía|esta semana|en marzo|el martes|ya".split("|"),
}
HOW = {
    "ru": "большой важный простой готовый чужой лишний полный серый быстрый странный верный хороший трудный красный пустой длинный".split(),
    "en": "big important simple ready foreign extra full grey quick strange correct good hard red empty long".split(),
    "de": "groß wichtig einfach fertig fremd voll grau schnell seltsam richtig gut schwer rot leer lang".split(),
    "es": "grande importante simple listo ajeno lleno gris rápido extraño correcto bueno difícil rojo vacío largo".split(),
}
#: Capitalised or personal-looking words that name no person with surname, and no address.
TITLES = {
    "ru": "Красная Площадь|Большой Театр|Зелёный Мыс|Чёрное Море|Белая Ночь|Центральный Офис|Старый Город|Служба Поддержки|Южный Полюс|Новая Волна|Первый Канал|Синий Кит|Тёмная Комната|Главный Корпус|Зимний Сад|Общий Чат|Третий Этаж|Добрый День|Железная Дорога|Северный Ветер|Летний Лагерь|Открытый Урок|Важная Задача|Малый Совет".split("|"),
    "en": "Great Wall|Red Square|Black Friday|Open Source|Blue Team|Daily News|White House|Central Office|Green Light|Long Story|Big Bang|Dark Room|Happy Birthday|User Guide|Third Floor|North Pole|Silver Lake|Good Morning|Change Request|Winter Garden|Data Science|Machine Learning|Four Winds|Nine Lives|Iron Gate|Summer Camp|Quality Report|Test Plan|Common Room|Golden Hour|Meeting Room|Two Towers|Lost Letters|Status Update".split("|"),
    "de": "Schwarzer Freitag|Rotes Kreuz|Großer Saal|Guten Morgen|Blaues Band|Alte Brücke|Frohes Fest|Neue Woche|Weißer Turm|Offene Frage|Dritte Etage|Kalter Winter".split("|"),
    "es": "Gran Muralla|Plaza Roja|Viernes Negro|Buenos Días|Casa Blanca|Nuevo Plan|Sala Grande|Tercera Planta|Polo Norte|Feliz Año|Luz Verde|Jardín Botánico".split("|"),
}
COUNTS = {
    "ru": "Один Два Три Четыре Пять Шесть Семь Восемь Девять Десять Сто Первый Второй Третий Пятый".split(),
    "en": "One Two Three Four Five Six Seven Eight Nine Ten Twelve Hundred First Second Third".split(),
    "de": "Eins Zwei Drei Vier Fünf Sechs Sieben Acht Neun Zehn Zwölf Hundert Erste Zweite Dritte".split(),
    "es": "Uno Dos Tres Cuatro Cinco Seis Siete Ocho Nueve Diez Doce Cien Primera Segunda Tercera".split(),
}
#: Frames without an item; T thing, W when, H how, N number, V version, D date, A amount, P parcel, G node, C place on a map, R ticket, U handle, X title.
PLAIN = {
    "ru": [
        "T закончили W", "Нужно поправить: T и T", "W обсудим, как сделать H T", "не понимаю, зачем нам T", "T и T не совпадают на N процентов", "Кто видел T?", "Давно пора, T ждёт W", "Всё сделано, T можно закрывать",
        "по плану T W", "По-моему, H T лишний", "у меня N вариантов про T", "жду ответа W", "Спасибо! T работает", "Нет, T не при чём, смотри T", "обновили до V, T жив", "T перешёл на V W", "сборка V упала", "заявка R висит W",
        "закрыли R и R", "смотри R, там T", "сервер G недоступен", "пинг G идёт, T нет", "T поднят на G:N", "посылка P в пути", "накладная P, внутри T", "отправление P пришло W", "сумма A за T", "перевели A рублей", "цена A, скидка N процентов",
        "дата D, T готов", "с D по D был T", "в журнале D пусто", "координаты C, C", "точка C C на карте, там T", "U посмотри T", "спроси у U про T", "U, ты где?", "X сегодня закрыт", "статья называется X", "X переносим, T занят", "Скоро X, а T не готов", "смотрели X W",
        "любовь к T не лечится", "надежда на T умерла W", "роман про T дочитал", "слава богу, T найден", "улица пустая, T не едет", "дом N самый дальний", "в доме тепло, T не нужен", "проспект закрыли на ремонт, T стоит", "квартира большая, N комнат", "этаж N, кабинет N", "почта не работает W",
        "телефон сел, T потом", "паспорт забыл дома", "ИНН нужен для T?", "номер заказа NNN, T едет", "пункт N.N про T", "страница N, строка N", "версия документа N от D", "N штук по A", "осталось N из N", "да", "нет", "ок", "спасибо", "ха", "+N", "T", "T?", "Хорошо, T W", "T. Потом T. Потом T.", "и что, T опять H?", "я бы взял H T, а не H", "Какой T, такой и T",
        "мы с ней решили, что T W", "и она сказала, что T H", "Пока без T, W посмотрим", "сам проверь, T или T", "если T H, то T нет", "когда T будет H?", "T был H, стал H", "по телефону сказали, что T W", "шифр полки N-N", "гость пришёл, T накрыт",
    ],
    "en": [
        "the T was done W", "We should fix the T and the T", "W we discuss how to make a H T", "no idea why we need the T", "T and T differ by N percent", "Who has seen the T?", "High time, the T waits W", "All done, the T can be closed",
        "as planned the T comes W", "In my view the H T is too much", "I have N options for the T", "waiting for an answer W", "Thanks! The T works", "No, not the T, look at the T", "updated to V, T is alive", "T moved to V W", "build V failed", "request R is open W",
        "closed R and R", "see R for the T", "server G unreachable", "ping G fine, T not", "T listens on G:N", "parcel P on its way", "waybill P, one T inside", "shipment P came W", "sum of A for the T", "paid A for it", "price A, discount N percent",
        "date D, T ready", "from D to D we had the T", "nothing in the log of D", "coordinates C, C", "spot C C on the map, the T is there", "U look at the T", "ask U about the T", "U where are you?", "X is closed today", "the paper is called X", "X moved, T is busy", "X comes soon and the T is not ready", "we watched X W",
        "will the T work W?", "mark it as H", "grace period for the T ended W", "rose by N percent", "hope is not a T", "may be H", "the street is empty, no T", "house N is the last one", "the road is closed, T stuck", "flat and H T", "floor N, room N", "lane N, T N", "mail is down W", "drive the T home W",
        "phone is dead, T later", "left my passport at home", "is a tax id needed for the T?", "order number NNN, T ships", "item N.N on the T", "page N, line N", "draft N of D", "N pieces at A", "N of N left", "yes", "no", "ok", "thanks", "haha", "+N", "T", "T?", "Fine, T W", "First the T. Then the T. Then the T.", "so the T is H again?", "I would take the H T, not the H one", "Such a T, such a T",
        "she and I agreed that the T comes W", "and he said the T is H", "Without the T for now, see W", "check it yourself, T or T", "if the T is H there is no T", "when will the T be H?", "the T was H and became H", "The T looks H. Can You check?", "So far The T is fine", "Please Read The T", "shelf N-N", "at the T we wait", "dot by dot the T grows", "look at this T W", "meet at the T W",
    ],
    "de": [
        "T ist W fertig", "Wir sollten T und T ändern", "W reden wir über T", "keine Ahnung, warum T", "T und T weichen um N Prozent ab", "Wer hat T gesehen?", "Alles erledigt, T kann weg", "nach Plan kommt T W", "Ich habe N Ideen für T", "warte W auf Antwort", "Danke! T läuft",
        "Nein, nicht T, sondern T", "auf V gehoben, T lebt", "Bau V schlug fehl", "Anfrage R ist W offen", "siehe R zum T", "Server G nicht erreichbar", "T lauscht auf G:N", "Paket P unterwegs", "Sendung P kam W", "Summe A für T", "A bezahlt", "Datum D, T bereit", "vom D bis D lief T", "Punkt C, C auf der Karte",
        "U schau auf T", "frag U nach T", "X ist heute zu", "der Artikel heißt X", "X kommt bald, T fehlt", "Straße leer, kein T", "Haus N ist das letzte", "Der Weg ist H", "Stock N, Raum N", "Post kommt W nicht", "Handy leer, T später", "Pass vergessen", "Bestellnummer NNN, T kommt", "Punkt N.N zum T", "Seite N, Zeile N", "N Stück zu A", "ja", "nein", "gut", "T", "Erst T. Dann T.", "ist T wieder H?", "Punkt T", "Projekt T, Stufe N", "Stichwort T", "Bereich T: T", "Montag T, Dienstag T", "Team T meldet T", "T N, T N", "T und T, T W", "vor T, nach T", "T, T W", "Name, T, T", "Abteilung T W", "T, T und T", "kurze Frage, Sache T", "T: T", "T war H und wurde H", "Wann wird T H?", "Der Ring ist H", "am T warten wir",
    ],
    "es": [
        "el T se terminó W", "Hay que cambiar T y T", "W hablamos de T", "ni idea de por qué T", "T y T difieren en N por ciento", "¿Quién ha visto T?", "Todo hecho, T puede cerrarse", "según el plan T llega W", "Tengo N ideas para T", "espero respuesta W", "¡Gracias! T funciona",
        "No, no es T, mira T", "subido a V, T vive", "la compilación V falló", "petición R abierta W", "mira R por T", "servidor G caído", "T escucha en G:N", "paquete P en camino", "el envío P llegó W", "suma A por T", "pagué A", "fecha D, T listo", "del D al D hubo T", "punto C, C en el mapa",
        "U mira T", "pregunta a U por T", "X está cerrado hoy", "el artículo se llama X", "llega X y falta T", "calle vacía, sin T", "la casa N es la última", "plaza llena, T H", "piso N, sala N", "el correo no va W", "sin batería, T luego", "olvidé el pasaporte", "pedido número NNN, T sale", "punto N.N sobre T", "página N, línea N", "N piezas a A", "sí", "no", "bien", "T", "Primero T. Luego T.", "¿T otra vez H?", "T era H y se volvió H", "¿Cuándo será T H?", "el paseo fue H",
    ],
}


#: Words of which ordinary sentences are put together: openings, subjects, verbs, small words and links.
GRAMMAR = {
    "ru": {
        "open": "Да,|Нет,|Хорошо,|Ладно,|Понял,|Ясно,|Кстати,|Значит,|Конечно,|Возможно,|Ну,|А|И|Но|Поэтому|Тогда|Сейчас|Может,|Привет,|Извините,|Наверное,|Итак,|Вообще|Опять|Здесь|Там|Вот|Просто|Жаль,|Верно,|Точно,|Готово,|Спасибо,|Внимание,|Коллеги,|Друзья,".split("|"),
        "who": "я|мы|он|она|они|ты|вы|кто-то|никто|все|это|Я|Мы|Он|Она|Они|Ты|Вы|Все|Кто|Это|Никто|Каждый".split("|"),
        "do": "делаю|сделаем|видел|видела|хочу|хотим|могу|можем|проверю|проверил|закончу|закончили|начнём|смотрим|посмотрел|думаю|считаю|знаю|помню|забыл|забыла|взял|взяли|отдам|принёс|пишу|написал|прочитал|жду|ждём|найду|нашли|потерял|исправлю|исправил|покажу|показал|собрал|запустим|остановил|обещал|предлагаю|сообщу|спрошу|поменяю|добавил|убрал|перенесу|согласую|уточню|отправлю|получил|починил|не могу|не вижу|не буду|не знаю".split("|"),
        "small": "тоже|ещё|уже|только|снова|очень|совсем|почти|сразу|быстро|сам|вместе|лучше|хуже|иногда|всегда|никогда|пока|опять|даже|точно|заново|целиком|осторожно".split("|"),
        "link": "и|или|но|а|чтобы|потому что|если|когда|где|как|что|из|на|для|про|без|под|над|у|с|в|по|до|от|после|перед|вместо|кроме|через|между".split("|"),
    },
    "en": {
        "open": "Yes,|No,|Well,|Okay,|Right,|Sure,|Maybe|Perhaps|Then|Now|So|But|And|Also,|Still,|Hello,|Sorry,|Please|Here|There|Just|Again|Today|Finally,|Noted,|Understood,|Done,|Great,|Thanks,|Folks,|Everyone,|Actually,|Anyway,|Too bad,|Good,|Exactly,|Indeed,|Attention,".split("|"),
        "who": "I|we|he|she|they|you|it|someone|nobody|We|He|She|They|You|It|Everybody|Who|This|That|These|Both|Some|None|The others|My team|Our side".split("|"),
        "do": "will do|will make|will write|will ask|will send|can see|can do|could read|should start|should finish|must stop|may move|might keep|would like|want to have|need|needs|have|has|had|am checking|is checking|are waiting for|was reading|were writing|do not see|does not need|did not get|cannot open|finished|started|checked|looked at|forgot|found|lost|fixed|broke|added|removed|moved|sent|got|kept|asked about|think about|know|remember|believe in|expect|prefer|suggest|propose|shall return".split("|"),
        "small": "also|still|already|only|again|very much|almost|quickly|together|better|worse|sometimes|always|never|once more|too|exactly|carefully|completely|later|soon|a bit|at all|otherwise".split("|"),
        "link": "and|or|but|so that|because|if|when|where|how|that|of|on|for|about|without|under|over|at|with|in|by|until|from|after|before|instead of|except|through|between|than|with the|of the|in the|to the|on a|for this".split("|"),
    },
    "de": {
        "open": "Ja,|Nein,|Gut,|Also,|Klar,|Vielleicht|Dann|Jetzt|Aber|Und|Hallo,|Bitte|Hier|Dort|Genau,|Verstanden,|Erledigt,|Danke,|Leider|Heute|Wieder|Stimmt,|Richtig,|Schade,|Übrigens,|Achtung,|Kollegen,|Erst|Zuerst|Eigentlich|Abgemacht,|Einig,|Fertig,|Bestätigt,|Gesehen,|Gelesen,|Geschafft,|Gefunden,|Besprochen,|Geklärt,".split("|"),
        "who": "ich|wir|er|sie|ihr|es|jemand|niemand|alle|Ich|Wir|Er|Sie|Ihr|Es|Alle|Wer|Das|Dies|Jeder|Keiner|Man".split("|"),
        "do": "mache|machen|sehe|sah|will|wollen|kann|können|prüfe|prüfte|beende|starte|schaue|denke|glaube|weiß|vergaß|nahm|bringe|schreibe|las|warte auf|finde|fand|verlor|zeige|baue|stoppe|verspreche|melde|frage nach|ändere|verschiebe|kläre|sende|bekam|repariere|habe|hat|hatten|brauche|braucht|nicht sehe|muss ändern|soll bleiben".split("|"),
        "small": "auch|noch|schon|nur|wieder|sehr|fast|sofort|schnell|selbst|zusammen|besser|manchmal|immer|nie|genau|ganz|vorsichtig|leider|kaum|später|lieber".split("|"),
        "link": "und|oder|aber|damit|weil|wenn|wo|wie|dass|von|auf|für|über|ohne|unter|an|mit|in|bei|bis|aus|nach|vor|statt|außer|durch|zwischen|als|mit der|von der|in dem|zu dem|für das|Punkt|Stand|Sache|Projekt|Stichwort|Bereich".split("|"),
    },
    "es": {
        "open": "Sí,|No,|Bueno,|Vale,|Claro,|Quizá|Entonces|Ahora|Pero|Y|Hola,|Perdón,|Aquí|Allí|Exacto,|Entendido,|Hecho,|Gracias,|Hoy|Otra vez|Además,|Verdad,|Lástima,|Atención,|Compañeros,|Primero|Después|Por cierto,|Hay".split("|"),
        "who": "yo|nosotros|él|ella|ellos|tú|usted|alguien|nadie|todos|Yo|Nosotros|Él|Ella|Ellos|Usted|Todos|Quién|Esto|Eso|Cada uno|Ninguno".split("|"),
        "do": "hago|hacemos|veo|vio|quiero|queremos|puedo|podemos|reviso|revisó|termino|empiezo|miro|pienso|creo|sé|recuerdo|olvidé|tomó|traigo|escribo|leí|espero|busco|encontró|perdió|muestro|armo|paré|prometo|aviso|pregunto por|cambio|muevo|aclaro|envío|recibió|arreglo|tengo|tiene|necesito|no veo|no puedo abrir|propongo|llevamos".split("|"),
        "small": "también|todavía|ya|solo|otra vez|muy|casi|enseguida|rápido|juntos|mejor|peor|a veces|siempre|nunca|incluso|justo|con cuidado|luego|apenas|más|menos".split("|"),
        "link": "y|o|pero|para que|porque|si|cuando|donde|como|que|de|en|para|sobre|sin|bajo|a|con|por|hasta|desde|tras|antes de|en vez de|salvo|entre|del|al|de la|en el|con los".split("|"),
    },
}
_ARTICLES = {"ru": ["", "", "", "этот ", "наш ", "тот "], "en": ["the ", "the ", "a ", "this ", "our ", "that ", ""], "de": ["die ", "der ", "das ", "ein ", "", "", "", ""], "es": ["el ", "la ", "un ", "este ", "nuestra ", "", ""]}


def _sentence(d: _Draw, lang: str, item: str = "") -> str:
    """An ordinary sentence; ``{}`` stands for an item of kind ``item``, if one is asked for."""
    words = GRAMMAR[lang]
    # Two nouns side by side are common, in a language that capitalises them too.
    pair = lambda: d.among(COMMON[lang]) + d.form([" ", " ", ", "]) + _slot(d, lang, "T")
    thing = lambda: pair() if d.chance(0.25 if lang == "de" else 0.1) else _slot(d, lang, "X") if d.chance(0.08) else d.form(_ARTICLES[lang]) + (d.among(HOW[lang]) + " " if d.chance(0.25) else "") + _slot(d, lang, "T")
    role = d.form(["who", "who", "who", "whom", "link"] if item == "name" else ["who", "whom", "link", "link", "end"]) if item else ""
    out = [d.among(words["open"])] if d.chance(0.5 if role != "who" else 0.25) else []
    if role == "who":
        out += ["{}"] + ([d.among(words["small"])] if d.chance(0.35) else [])
    elif d.chance(0.6):
        who = d.among(words["who"])
        out += [who if not out or who == "I" else who.lower()] + ([d.among(words["small"])] if d.chance(0.3) else [])
    elif d.chance(0.6):
        out.append(thing())
    if role != "who" or d.chance(0.85):
        out.append(d.among(words["do"]))
    if role == "whom":
        out.append("{}")
    if d.chance(0.25):
        out.append(d.form([": ", " "]).strip() or thing())
    if role in ("who", "whom") and d.chance(0.5):
        out += [d.among(words["link"]), thing()] if d.chance(0.5) else []
    elif d.chance(0.2):
        out += [str(d.random.randint(2, 60)), _slot(d, lang, "T")]
    else:
        out.append(thing())
    for _ in range(d.form([0, 0, 1, 1, 2])):
        out += [d.among(words["link"]), d.form([thing, thing, lambda: d.among(WHEN[lang]), lambda: d.among(words["who"]).lower() + " " + d.among(words["do"])])()]
    if role == "link":
        out += [d.among(words["link"]), "{}"] if d.chance(0.7) else [d.form([":", "—", "-", "(", ","]), "{}"]
    if d.chance(0.3):
        out.append(d.form([d.among(WHEN[lang]), d.among(words["small"])]))
    if role == "end":
        out += [d.form([":", "—", "-", "=", ">", ""]), "{}"]
    text = " ".join(out).replace(" :", ":").replace("( ", "(").replace(" ,", ",")
    if d.chance(0.15):
        text = text.replace(" ", ", ", 1) if ", " not in text else text
    return text[0].upper() + text[1:] if d.chance(0.6) else text


def _word(d: _Draw, lang: str) -> str:
    """A made-up common word."""
    if lang == "ru":
        return d.form(_RU_HEADS) + d.form(_RU_MIDDLES) + d.form(["ка", "ость", "ние", "тель", "ник", "ция", "ок", "ие", "ть", "ает", "ный", "ная", "ом", "ами", "ить", "о"])
    word = d.form(_HEADS) + (d.form(_MIDDLES) if d.chance(0.4) else "") + d.form({"en": ["ing", "tion", "ment", "er", "ness", "ity", "ed", "ly", "al", "ous", "age", "s"], "de": ["ung", "keit", "schaft", "en", "er", "lich", "ig", "e", "tum", "heit", "nis", "ling", "werk", "zeug", "plan", "stelle", "gang", "stück", "raum", "teil", "bericht", "liste"], "es": ["ción", "dad", "ado", "ar", "ero", "mente", "aje", "oso", "ía"]}[lang])
    return word.capitalize() if lang == "de" and d.chance(0.5) else word


def _slot(d: _Draw, lang: str, slot: str) -> str:
    if slot == "T":
        return d.among(d.form([THINGS, COMMON])[lang]) if d.chance(0.6) else _word(d, lang)
    if slot in "WH":
        return d.among({"W": WHEN, "H": HOW}[slot][lang])
    if slot == "X":
        if d.chance(0.4):
            return d.among(TITLES[lang])
        first = d.form([d.among(HOW[lang]), d.form(COUNTS[lang]), d.among(d.form([THINGS, COMMON])[lang])]).capitalize()
        return first + " " + d.among(d.form([THINGS, COMMON])[lang]).title() + (d.form(["s", "s", ""]) if lang != "ru" else d.form(["", "ы", "и"]))
    if slot == "N":
        return str(d.random.randint(0, 120))
    if slot == "NNN":
        return d.digits(d.form([3, 4, 5, 6, 7, 8]))
    if slot == "V":
        return d.form(["", "", "v"]) + ".".join(str(d.random.randint(0, 40)) for _ in range(d.form([2, 3, 3, 4]))) + d.form(["", "", "-rc1", "-beta"])
    if slot == "D":
        day, month, year = d.random.randint(1, 28), d.random.randint(1, 12), d.random.randint(1998, 2029)
        day2, month2, clock = f"{day:02}", f"{month:02}", d.form(["", "", f" {d.random.randint(0, 23):02}:{d.random.randint(0, 59):02}", f" {d.random.randint(0, 23):02}:{d.random.randint(0, 59):02}:{d.random.randint(0, 59):02}"])
        return d.form([f"{day2}.{month2}.{year}", f"{year}-{month2}-{day2}", f"{day2}/{month2}/{year}", f"{day}.{month}.{year % 100:02}", f"{month}/{day}/{year}", f"{year}{month2}{day2}", f"{day2}-{month2}-{year}"]) + clock
    if slot == "A":
        n = d.digits(d.form([1, 2, 3]))
        return d.form(["", "", "$", "€"]) + d.form([f"{n} {d.digits(3)}", f"{n} {d.digits(3)} {d.digits(3)}", f"{n},{d.digits(3)}", f"{n}.{d.digits(2)}", f"{n}.{d.digits(3)},{d.digits(2)}", f"{n} {d.digits(3)} {d.digits(3)}", d.digits(5)]) + d.form(["", "", " EUR", " USD"])
    if slot == "P":
        return d.form([f"{d.letter()}{d.letter()}{d.digits(9)}{d.letter()}{d.letter()}", d.digits(14), _grouped(d, (4, 4, 4, 2), " "), _grouped(d, (4, 4, 4), " "), "1Z" + d.digits(6) + d.digits(10), _grouped(d, (5, 5, 4), " "), d.digits(20), d.digits(6) + " " + d.digits(8)])
    if slot == "G":
        return d.form([".".join(str(d.random.randint(0, 255)) for _ in range(4)), f"10.{d.random.randint(0, 255)}.{d.random.randint(0, 255)}.{d.random.randint(1, 254)}", f"host-{d.digits(2)}", "fe80::" + d.digits(1) + "a:" + d.digits(2)])
    if slot == "C":
        return d.form(["", "", "-"]) + f"{d.random.randint(1, 179)}.{d.digits(d.form([3, 4, 5, 6]))}"
    if slot == "U":
        return "@" + _made_up(d, _ENDS).lower() + d.form(["", "_" + d.digits(2), "_bot", d.digits(3), "_" + _made_up(d, _ENDS).lower()])
    return d.form([f"#{d.digits(d.form([3, 4, 5, 6]))}", f"№ {d.digits(d.form([3, 4, 5]))}", f"№{d.digits(d.form([3, 4, 5, 6]))}", f"{d.letter()}{d.letter()}{d.letter()}-{d.digits(d.form([3, 4, 5]))}", f"{d.letter()}{d.letter()}-{d.digits(4)}", f"20{d.digits(2)}-{d.digits(3)}-{d.digits(3)}", f"INC{d.digits(7)}", f"{d.digits(4)}-{d.digits(4)}", f"{d.digits(3)}/{d.digits(2)}"])


def _plain(d: _Draw, lang: str) -> str:
    return re.sub(r"\b(?:NNN|[TWHNVDAPGCRUX])\b", lambda m: _slot(d, lang, m.group()), d.among(PLAIN[lang]))


def _part(d: _Draw, lang: str) -> list[tuple[str, str | None]]:
    kind = d.form([None] * 12 + ["name"] * 7 + ["address"] * 3 + ["phone"] * 2 + ["id_number"] * 2 + ["email"] * 2)
    if kind is None:
        text = _plain(d, lang) if d.chance(0.5) else _sentence(d, lang)
        if d.chance(0.2):
            text += d.form(["!", "!!", "...", " ?", "?", " :)", " ))", " 🙂", " 👌", " (!)", "…"])
        return [(text.lower() if d.chance(0.1) else text[:1].upper() + text[1:] if d.chance(0.3) else text, None)]
    if kind == "id_number":
        before, number, after = id_number(d, lang)
        if d.chance(0.3):
            first, last = _sentence(d, lang, kind).split("{}")
            before, after = first + before, last
        return [(before, None), (number, kind), (after, None)]
    fill = {"name": name, "phone": phone, "address": address}.get(kind)
    frame = d.among(FRAMES[lang][kind]) if d.chance(0.55) else _sentence(d, lang, kind)
    before, after = frame.split("{}")
    item = fill(d, lang if d.chance(0.92) else d.form(["ru", "en", "de", "es"])) if fill else email(d)
    if d.chance(0.15):
        before, after = before[:1].upper() + before[1:], d.form([after, after + ".", after + "!"])
    if kind == "phone" and d.chance(0.05):
        after += d.form([" или ", " / ", ", "])
        return [(before, None), (item, kind), (after, None), (phone(d, lang), kind)]
    return [(before, None), (item, kind), (after, None)]


def labelled_table(sentences: int = 12000, seed: int = 7, share: str = "all") -> list[list[tuple[str, str | None]]]:
    """``sentences`` labelled sentences, the same ones for the same seed and share (all, learn or held)."""
    d = _Draw(seed, share)
    table = []
    for _ in range(sentences):
        lang = d.form(["ru", "ru", "en", "en", "de", "es"])
        pieces: list[tuple[str, str | None]] = [(d.form(["> ", "- ", "— ", "* "]), None)] if d.chance(0.08) else []
        for i in range(d.form([1, 1, 2, 2, 3])):
            if i:
                pieces.append((d.form([" ", ". ", ". ", ", ", "; ", " — "]), None))
            pieces += _part(d, lang)
        table.append([p for p in pieces if p[0]])
    return table
