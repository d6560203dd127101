"""The rules on texts written out for DuckDB, apart from the operators' own lists, so that each checks the other."""

from __future__ import annotations

_W = r"[\p{L}\p{N}_]"
_E = r"[^\p{L}\p{N}_]"


def word(tight: str, column: str = "text", loose: str = "") -> str:
    """SQL: ``column`` holds one of the alternatives as a whole word; ``loose`` ones end in a sign and need a word after it."""
    parts = [rf"(^|{_E})({tight})({_E}|$)"] if tight else []
    parts += [rf"(^|{_E})({loose}){_W}"] if loose else []
    return f"coalesce(regexp_matches({column}, '(?i){'|'.join(parts)}'), false)"


def acts(column: str) -> str:
    """SQL: a list of dialogue acts with null for those that don't hold."""
    plain = rf"regexp_replace({column}, '(?i)не (согласен|согласна|согласны)', '#', 'g')"
    return f"""[CASE WHEN {word('почему|зачем|когда|где|кто|что именно|как', column)} OR contains({column}, '?') THEN 'QUESTION' END,
  CASE WHEN {word('давайте|давай|предлагаю|можем|нужно|стоит', column)} THEN 'PROPOSE' END,
  CASE WHEN {word('согласен|согласна|согласны|верно|точно|поддерживаю', plain)} THEN 'AGREE' END,
  CASE WHEN {word('не согласен|не согласна|возражаю|неверно|но это не', column, 'нет,')} THEN 'DISAGREE' END,
  CASE WHEN {word('сделаю|возьму|обещаю|отпишусь|проверю|исправлю', column)} THEN 'COMMIT' END,
  CASE WHEN {acknowledged(column)} THEN 'ACKNOWLEDGE' END]"""


def acknowledged(column: str) -> str:
    return f"coalesce(regexp_matches({column}, '(?i)^(ок|понял|поняла|поняли|ясно|вижу|принято)[.! ]*$'), false)"


ACTS = acts("text")[1:-1]
GROUNDING = f"""CASE WHEN {word('уточни|уточните|что значит|не понял|не поняла|правильно ли')} THEN 'CLARIFICATION_REQUESTED'
  WHEN {word('точнее|я имел в виду|я имела в виду|поправлюсь|не так выразил')} THEN 'REPAIRED' WHEN {acknowledged('text')} THEN 'ACKNOWLEDGED' END"""
COMMITMENT = f"CASE WHEN {word('не уверен|не уверена|возможно|кажется|наверное|может быть|похоже')} THEN 0.45 ELSE 0.78 END::DOUBLE"


def sentences(source: str, key: str) -> str:
    """CTE bodies: ``sent(key, i, body)``, the sentences of ``source(key, text)``."""
    return rf"""parts AS (SELECT {key}, text, list_filter(list_transform(regexp_extract_all(text, '[^.!?…\n]+[.!?…]*'), lambda p: regexp_replace(p, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')), lambda p: p <> '') AS p
  FROM {source} WHERE text IS NOT NULL AND text <> ''),
sent AS (SELECT {key}, unnest(CASE WHEN len(p) > 0 THEN p ELSE [text] END) AS body, generate_subscripts(CASE WHEN len(p) > 0 THEN p ELSE [text] END, 1) AS i FROM parts)"""


def said(source: str = "m", key: str = "row_id", most: int = 5) -> str:
    """CTE bodies: ``said(key, ordinal, body)``, the first ``most`` propositions of each text."""
    return rf"""{sentences(source, key)},
acted AS (SELECT {key}, i, body, list_filter({acts('body')}, lambda x: x IS NOT NULL) AS acts, len(list_filter(regexp_split_to_array(body, '\s+'), lambda w: w <> '')) AS words FROM sent),
said AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) AS ordinal, body FROM acted WHERE words >= 3 AND acts <> ['ACKNOWLEDGE'] AND NOT list_contains(acts, 'QUESTION')
  QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY i) <= {most})"""


#: CTE bodies after ``m``: ``cand``, the ranked candidates that a message may answer.
CANDIDATES = r"""f AS (SELECT conversation_id, row_id, external_id, reply, sent_at, coalesce(trim(text, ' ') <> '', false) AS filled, text FROM m WHERE sent_at IS NOT NULL),
b AS (SELECT *, sum(filled::INT) OVER (PARTITION BY conversation_id ORDER BY sent_at, row_id ROWS UNBOUNDED PRECEDING) - filled::INT AS k FROM f),
tf AS (SELECT row_id, t, count(*) AS c FROM (SELECT row_id, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_-]+'), lambda x: length(x) >= 2)) AS t FROM f) GROUP BY ALL),
nm AS (SELECT row_id, sqrt(sum(c * c)::DOUBLE) AS n FROM tf GROUP BY row_id),
near AS (SELECT s.row_id AS source, t.row_id AS target, t.sent_at AS at_, t.external_id AS e, s.reply FROM b s JOIN b t ON t.conversation_id = s.conversation_id AND t.filled
    AND ((t.k < s.k AND t.k >= s.k - 40 AND t.sent_at >= s.sent_at - INTERVAL 8 HOUR) OR (s.reply <> '' AND t.external_id = s.reply AND t.row_id <> s.row_id))),
dots AS (SELECT source, target, sum(x.c * y.c)::DOUBLE AS d FROM near JOIN tf x ON x.row_id = source JOIN tf y ON y.row_id = target AND y.t = x.t GROUP BY source, target),
sc AS (SELECT near.source, near.target, at_, coalesce(e = reply, false) AS source_native, coalesce(reply, '') <> '' AS has, round(coalesce(d / (a.n * z.n), 0), 9) AS score FROM near
    LEFT JOIN dots ON dots.source = near.source AND dots.target = near.target LEFT JOIN nm a ON a.row_id = near.source LEFT JOIN nm z ON z.row_id = near.target),
rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, at_ DESC, target) AS r FROM sc),
bl AS (SELECT *, max(CASE WHEN source_native AND r > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY source) AS below FROM rk),
cand AS (SELECT source, target, score, least(r, 5)::INT AS rank, source_native,
    CASE WHEN has THEN source_native ELSE least(r, 5) = 1 AND score >= 0.15 END AS eligible,
    CASE WHEN has AND source_native THEN 'source_native_reply_target' WHEN has THEN 'source_native_reply_target_takes_precedence' WHEN r <> 1 THEN 'only_rank_1_is_relation_eligible'
      WHEN score < 0.15 THEN 'lexical_similarity_below_0.15' ELSE 'rank_1_lexical_similarity_at_least_0.15' END AS reason
  FROM bl WHERE CASE WHEN below = 1 THEN r < 5 OR source_native ELSE r <= 5 END)"""
RARE = rf"""CASE WHEN {word('точнее|поправлюсь|имел в виду|имела в виду|имели в виду|не так выразил')} THEN 'repair'
  WHEN coalesce(regexp_matches(text, '(?i)(^|{_E})(согласен|согласна|допустим|пусть)[^\n]{{0,79}}[^\p{{L}}\p{{N}}_\n]но({_E}|$)'), false) THEN 'concession'
  WHEN {word('по словам|считает|утверждает|говорят|якобы')} THEN 'attribution' WHEN {word('возможно|кажется|наверное|не уверен|не уверена')} THEN 'uncertainty'
  WHEN {word('потому что|так как|поэтому|следовательно|однако')} THEN 'argument' ELSE 'none' END"""
_N = lambda c: rf"len(list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> ''))"
#: CTE bodies after ``cand``: ``disc(source, target, label)``.
DISCOURSE = f"""dp AS (SELECT source, target, score, coalesce(s.text, '') AS st, coalesce(t.text, '') AS tt FROM cand JOIN m s ON s.row_id = source JOIN m t ON t.row_id = target WHERE eligible),
disc AS (SELECT source, target, unnest(list_filter([
  CASE WHEN {word('понял|поняла|поняли|ясно|спасибо|ок|окей|принято', 'st')} THEN 'ACKNOWLEDGES' END, CASE WHEN {word('не так|поправка|поправлю|точнее говоря', 'st', 'нет,|нет:|нет ')} THEN 'CORRECTS' END,
  CASE WHEN {word('но|однако|зато|впрочем', 'st')} THEN 'CONTRASTS' END, CASE WHEN {word('точнее|то есть|имею в виду|уточню|уточнение', 'st')} THEN 'CLARIFIES' END,
  CASE WHEN {word('согласен|согласна|согласны|принимаю|давайте|давай|поддерживаю', 'st')} THEN 'ACCEPTS' END,
  CASE WHEN {word('не согласен|не согласна|не согласны|не подходит|отклоняю|отклоняем|против', 'st')} THEN 'REJECTS' END,
  CASE WHEN contains(tt, '?') AND NOT contains(st, '?') AND {_N('st')} >= 2 THEN 'ANSWERS' END, CASE WHEN score > 0 AND {_N('st')} > {_N('tt')} THEN 'ELABORATES' END], lambda x: x IS NOT NULL)) AS label FROM dp)"""
COMPONENT = f"""CASE WHEN {word('по данным|исследовани[а-яё]*|показыва[а-яё]*|наблюдени[а-яё]*|согласно', 'body')} THEN 'EVIDENCE'
  WHEN {word('потому что|так как|поскольку|ведь|поэтому|следовательно', 'body')} THEN 'PREMISE' ELSE 'CLAIM' END"""
ATTACKS = word(f"не соглас{_W}*|неверно|ошиб{_W}*|против|однако", "body", "нет,|нет |нет:|но ")
SUPPORTS = word(f"соглас{_W}*|верно|поддержива{_W}*|именно", "body", "да,|да ") + " OR " + word("потому что|так как|поскольку|ведь|поэтому|следовательно", "body")
