"""Queries of the conversation analytics operators over the stored tables, and SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import evaluation as E
from threadloom.operators import graph as G
from threadloom.operators import participation as P
from threadloom.operators import replies as R
from threadloom.operators import retrieval as Q
from threadloom.operators import sampling as S
from threadloom.operators import series as X
from threadloom.operators import snapshots as V
from threadloom.operators import themes as H
from threadloom.operators.messages import latest_messages, non_blank
from threadloom.operators.running import row_numbers
from threadloom.plans.registry import Measurement, Registry, artifact_json
from threadloom.sources.tables import table

#: Query vectors that one block of a search broadcasts, twice what an even deal gives it.
QUERY_BLOCK = 100_000
BASE_COLUMNS = ["message_id", "sender", "sent_at", "message_type", "reply", "text"]


def base(spark: SparkSession, d: str, columns: list[str] = BASE_COLUMNS) -> DataFrame:
    """The latest row of every message, with ``sender`` and ``reply`` for their long names."""
    rows = table(spark, d, "messages").withColumnsRenamed({"sender_external_id": "sender", "reply_to_external_id": "reply"})
    return latest_messages(rows, columns)


def events(spark: SparkSession, d: str, columns: tuple[str, ...] = ("sender", "sent_at")) -> DataFrame:
    return R.reply_events(base(spark, d, [*columns, "reply"]), columns)


def edges(spark: SparkSession, d: str) -> DataFrame:
    return G.reply_edges(events(spark, d))


QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_M = """m AS (
  SELECT row_id, message_id, conversation_id, external_id, sender_external_id AS sender, sent_at, message_type, reply_to_external_id AS reply, text
  FROM messages
  QUALIFY row_number() OVER (PARTITION BY conversation_id, external_id ORDER BY imported_at DESC, row_id DESC) = 1
)"""
_EV = f"""{_M},
ev AS (
  SELECT s.conversation_id, s.row_id AS source, t.row_id AS target, s.sender AS source_sender, t.sender AS target_sender,
         s.sent_at AS source_sent_at, t.sent_at AS target_sent_at, s.text AS source_text, t.text AS target_text
  FROM m s JOIN m t ON t.conversation_id = s.conversation_id AND t.external_id = s.reply AND s.reply <> ''
)"""
_ED = f"""{_EV},
ed AS (SELECT source_sender AS src, target_sender AS dst, count(*) AS weight FROM ev WHERE source_sender <> target_sender GROUP BY ALL)"""
_MONTHS = f"{_M}, mo AS (SELECT strftime(sent_at, '%Y-%m') AS month, count(*) AS n FROM m WHERE sent_at IS NOT NULL GROUP BY 1)"
_TOK = r"[\p{L}\p{N}_-]+"


# ------------------------------------------------------------------------------------------ counts


@query(f"""WITH {_M} SELECT count(*)::BIGINT AS n_messages, count(*) FILTER (message_type = 'service')::BIGINT AS n_service,
  count(*) FILTER (sender IS NULL)::BIGINT AS n_unresolved, count(*) FILTER (reply <> '')::BIGINT AS n_replies,
  count(*) FILTER (text IS NULL OR NOT regexp_matches(text, '[^ \\t\\r\\n\\x{{00A0}}\\x{{200B}}]'))::BIGINT AS n_empty, coalesce(sum(length(text)), 0)::BIGINT AS n_chars,
  epoch_us(min(sent_at)) AS first_us, epoch_us(max(sent_at)) AS last_us, count(DISTINCT conversation_id)::BIGINT AS n_conversations FROM m""")
def overview_counters(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(F.col("message_type") == "service").alias("n_service"),
        F.count_if(F.col("sender").isNull()).alias("n_unresolved"),
        F.count_if(F.col("reply") != "").alias("n_replies"),
        F.count_if(~non_blank(F.col("text"))).alias("n_empty"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"),
        F.unix_micros(F.min("sent_at")).alias("first_us"),
        F.unix_micros(F.max("sent_at")).alias("last_us"),
        F.count_distinct("conversation_id").alias("n_conversations"),
    )


@query(f"""WITH {_M} SELECT sender, count(*)::BIGINT AS n_messages, coalesce(sum(length(text)), 0)::BIGINT AS n_chars,
  count(*) FILTER (contains(text, '?'))::BIGINT AS n_questions FROM m WHERE sender IS NOT NULL GROUP BY sender""")
def sender_activity(spark: SparkSession, d: str) -> DataFrame:
    return P.sender_counts(base(spark, d))


@query(f"""WITH {_M}, c AS (SELECT sender, count(*) AS n FROM m WHERE sender IS NOT NULL GROUP BY sender)
SELECT sender, n::BIGINT AS n_messages, n / (SELECT sum(n) FROM c) AS share FROM c""")
def participation_share(spark: SparkSession, d: str) -> DataFrame:
    return P.participation_share(base(spark, d, ["sender"]))


@query(f"""WITH {_M}, t AS (SELECT count(*) AS total FROM m), c AS (SELECT sender, count(*) AS n FROM m WHERE sender IS NOT NULL GROUP BY sender),
r AS (SELECT *, row_number() OVER (ORDER BY n) AS i FROM c), a AS (SELECT *, row_number() OVER (ORDER BY n DESC, sender) AS k FROM c),
e AS (SELECT -sum(n / total * log2(n / total)) AS h, count(*) AS s, sum(n) AS sn FROM c, t),
g AS (SELECT 2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*) AS gini FROM r)
SELECT h AS entropy_bits, h / log2(s) AS normalized_entropy, gini, s::BIGINT AS n_senders, total::BIGINT AS n_messages,
  (SELECT max(n) FROM c) / total AS top_1_share, (SELECT sum(n) FROM a WHERE k <= 10) / total AS top_10_share FROM e, g, t""")
def participation_concentration(spark: SparkSession, d: str) -> DataFrame:
    return P.concentration(base(spark, d, ["sender"]))


@query(f"""WITH {_M} SELECT sender, count(*)::BIGINT AS n_messages FROM m WHERE sender IS NOT NULL GROUP BY sender ORDER BY 2 DESC, 1 LIMIT 20""")
def top_senders(spark: SparkSession, d: str) -> DataFrame:
    counts = P.sender_counts(base(spark, d)).select("sender", "n_messages")
    return counts.orderBy(F.desc("n_messages"), "sender").limit(20)


@query(f"WITH {_MONTHS} SELECT month, n::BIGINT AS n FROM mo")
def monthly_activity(spark: SparkSession, d: str) -> DataFrame:
    return P.monthly_counts(base(spark, d, ["sent_at"]))


@query(f"""WITH {_MONTHS}, x AS (SELECT month, lag(n) OVER (ORDER BY month) AS previous, n, ln(1 + n) - ln(1 + lag(n) OVER (ORDER BY month)) AS c FROM mo),
y AS (SELECT * FROM x WHERE c IS NOT NULL), m1 AS (SELECT median(c) AS ce FROM y), m2 AS (SELECT median(abs(c - ce)) AS mad FROM y, m1),
z AS (SELECT month, previous, n, c, CASE WHEN mad > 0 THEN abs(c - ce) / (1.4826 * mad) ELSE abs(c - ce) END AS s FROM y, m1, m2)
SELECT month, previous::BIGINT AS previous, n::BIGINT AS n, c AS log_change, s AS robust_score, CASE WHEN c > 0 THEN 'increase' ELSE 'decrease' END AS direction
FROM z WHERE s >= 2 ORDER BY s DESC, month LIMIT 6""")
def monthly_change_points(spark: SparkSession, d: str) -> DataFrame:
    return P.robust_change_points(P.monthly_counts(base(spark, d, ["sent_at"])))


@query(f"""WITH {_MONTHS}, a AS (SELECT month, n::DOUBLE AS x, row_number() OVER (ORDER BY month) AS i, count(*) OVER () AS k, lead(month) OVER (ORDER BY month) AS nx FROM mo),
b AS (SELECT p.i, p.k, p.nx, (SELECT sum((x - (SELECT avg(x) FROM a)) ^ 2) FROM a)
    - (SELECT sum((q.x - (SELECT avg(x) FROM a WHERE i <= p.i)) ^ 2) FROM a q WHERE q.i <= p.i)
    - (SELECT sum((q.x - (SELECT avg(x) FROM a WHERE i > p.i)) ^ 2) FROM a q WHERE q.i > p.i) AS gain,
    abs((SELECT sum(x) FROM a q WHERE q.i <= p.i) - p.i * (SELECT avg(x) FROM a)) AS dev FROM a p WHERE p.i < p.k AND p.k >= 6)
(SELECT 'binary_segmentation_sse' AS method, nx AS month, gain AS score FROM b WHERE i >= 2 AND i <= k - 2 ORDER BY gain DESC, i DESC LIMIT 1)
UNION ALL (SELECT 'cusum_max_deviation', nx, dev FROM b ORDER BY dev DESC, i LIMIT 1)""")
def change_splits(spark: SparkSession, d: str) -> DataFrame:
    return P.change_splits(P.monthly_counts(base(spark, d, ["sent_at"])))


@query(f"""WITH {_M}, w AS (SELECT row_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '{_TOK}'), lambda x: length(x) >= 4))) AS term FROM m WHERE text IS NOT NULL)
SELECT term, count(*)::BIGINT AS df FROM w GROUP BY term""")
def term_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return Q.document_frequency(base(spark, d, ["text"]), "text")


@query(f"""WITH {_M}, t AS (SELECT list_distinct(list_filter(regexp_extract_all(lower(text), '{_TOK}'), lambda x: length(x) >= 4)) AS w FROM m WHERE text IS NOT NULL),
v AS (SELECT term FROM (SELECT unnest(w) AS term FROM t) GROUP BY term HAVING count(*) >= 5 ORDER BY count(*) DESC, term LIMIT 80),
s AS (SELECT list_slice(list_sort(list_intersect(w, (SELECT list(term) FROM v))), 1, 15) AS w FROM t),
p AS (SELECT w[i] AS a, w[j] AS b FROM s, unnest(range(1, len(w) + 1)) r(i), unnest(range(1, len(w) + 1)) q(j) WHERE i < j)
SELECT a, b, count(*)::BIGINT AS n FROM p GROUP BY a, b HAVING count(*) >= 3""")
def term_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    rows = base(spark, d, ["text"])
    top = Q.document_frequency(rows, "text").where(F.col("df") >= 5).orderBy(F.desc("df"), "term").limit(80)
    return Q.cooccurrence(rows, "text", top)


# ------------------------------------------------------------------------------------------ replies


@query(f"""WITH {_EV}, l AS (SELECT (epoch_us(source_sent_at) - epoch_us(target_sent_at)) / 60000000 AS x FROM ev),
o AS (SELECT list_sort(list(x)) AS v FROM l WHERE x BETWEEN 0 AND 43200)
SELECT (SELECT count(*) FROM m)::BIGINT AS n_messages, (SELECT count(*) FROM m WHERE reply <> '')::BIGINT AS n_marked, (SELECT count(*) FROM ev)::BIGINT AS n_resolved,
  len(v)::BIGINT AS n_timed, v[1 + round_even((len(v) - 1) * 0.5, 0)::INT] AS p50_minutes, v[1 + round_even((len(v) - 1) * 0.9, 0)::INT] AS p90_minutes,
  ((SELECT count(*) FROM m WHERE reply <> '') - (SELECT count(*) FROM ev))::BIGINT AS n_missing FROM o""")
def reply_structure(spark: SparkSession, d: str) -> DataFrame:
    return R.reply_structure(base(spark, d, ["reply"]), events(spark, d))


@query(f"""WITH {_ED}, b AS (SELECT a.weight, least(a.weight, coalesce(z.weight, 0)) AS mu FROM ed a LEFT JOIN ed z ON z.src = a.dst AND z.dst = a.src)
SELECT sum(mu)::BIGINT AS reciprocated, sum(weight)::BIGINT AS replies, sum(mu) / sum(weight) AS reciprocity FROM b""")
def reply_reciprocity(spark: SparkSession, d: str) -> DataFrame:
    return R.reciprocity(events(spark, d))


@query(f"WITH {_EV} SELECT target AS row_id, count(*)::BIGINT AS n_replies FROM ev GROUP BY target")
def reply_counts(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy(F.col("target").alias("row_id")).agg(F.count(F.lit(1)).alias("n_replies"))


_KM = f"""{_EV}, f AS (SELECT target, min(source_sent_at) AS at FROM ev GROUP BY target), c AS (SELECT conversation_id, max(sent_at) AS en FROM m GROUP BY 1),
du AS (SELECT greatest((epoch_us(coalesce(f.at, c.en)) - epoch_us(m.sent_at)) / 60000000, 0) AS minutes, f.at IS NOT NULL AS replied
       FROM m LEFT JOIN f ON f.target = m.row_id JOIN c USING (conversation_id))"""


@query(f"""WITH {_KM}, t AS (SELECT minutes, count(*) FILTER (replied) AS ev_n, count(*) FILTER (NOT replied) AS ce FROM du GROUP BY 1),
r AS (SELECT *, sum(ev_n + ce) OVER (ORDER BY minutes DESC) AS risk FROM t)
SELECT minutes, risk::BIGINT AS at_risk, ev_n::BIGINT AS events, ce::BIGINT AS censored,
  CASE WHEN max(CASE WHEN ev_n = risk THEN 1 ELSE 0 END) OVER (ORDER BY minutes) = 1 THEN 0
       ELSE exp(sum(CASE WHEN ev_n < risk THEN ln(1 - ev_n / risk) ELSE 0 END) OVER (ORDER BY minutes)) END AS survival FROM r""")
def reply_survival(spark: SparkSession, d: str) -> DataFrame:
    rows = base(spark, d, ["sender", "sent_at", "reply"])
    return R.kaplan_meier(R.first_reply_durations(rows, R.reply_events(rows)))


@query(rf"""WITH {_EV}, b0 AS (SELECT sender, coalesce(text, '') AS t_b, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS w_b FROM m WHERE sender IS NOT NULL AND text <> ''), b1 AS (SELECT sender, [len(list_filter(w_b, lambda x: x IN ('и','а','но','что','как','если','то','же','ли','бы','не'))) / greatest(len(w_b), 1), len(list_filter(w_b, lambda x: x IN ('я','ты','он','она','мы','вы','они','это','тот','эта'))) / greatest(len(w_b), 1), len(list_filter(w_b, lambda x: x IN ('же','ли','бы','ведь','вот','даже','только','именно'))) / greatest(len(w_b), 1),
  (length(t_b) - length(translate(t_b, '.,!?;:', ''))) / greatest(length(t_b), 1), (length(t_b) - length(regexp_replace(t_b, '[\x{{1F300}}-\x{{1FAFF}}]', '', 'g'))) / greatest(length(t_b), 1), least(len(w_b), 100) / 100] AS s FROM b0),
mb AS (SELECT sender, [avg(s[1]), avg(s[2]), avg(s[3]), avg(s[4]), avg(s[5]), avg(s[6])] AS base FROM b1 GROUP BY sender),
e0 AS (SELECT source_sender, target_sender, coalesce(source_text, '') AS t_r, regexp_extract_all(lower(coalesce(source_text, '')), '[\p{{L}}\p{{N}}_]+') AS w_r, coalesce(target_text, '') AS t_t, regexp_extract_all(lower(coalesce(target_text, '')), '[\p{{L}}\p{{N}}_]+') AS w_t FROM ev WHERE source_sender <> target_sender), e1 AS (SELECT source_sender, target_sender, [len(list_filter(w_r, lambda x: x IN ('и','а','но','что','как','если','то','же','ли','бы','не'))) / greatest(len(w_r), 1), len(list_filter(w_r, lambda x: x IN ('я','ты','он','она','мы','вы','они','это','тот','эта'))) / greatest(len(w_r), 1), len(list_filter(w_r, lambda x: x IN ('же','ли','бы','ведь','вот','даже','только','именно'))) / greatest(len(w_r), 1),
  (length(t_r) - length(translate(t_r, '.,!?;:', ''))) / greatest(length(t_r), 1), (length(t_r) - length(regexp_replace(t_r, '[\x{{1F300}}-\x{{1FAFF}}]', '', 'g'))) / greatest(length(t_r), 1), least(len(w_r), 100) / 100] AS r, [len(list_filter(w_t, lambda x: x IN ('и','а','но','что','как','если','то','же','ли','бы','не'))) / greatest(len(w_t), 1), len(list_filter(w_t, lambda x: x IN ('я','ты','он','она','мы','вы','они','это','тот','эта'))) / greatest(len(w_t), 1), len(list_filter(w_t, lambda x: x IN ('же','ли','бы','ведь','вот','даже','только','именно'))) / greatest(len(w_t), 1),
  (length(t_t) - length(translate(t_t, '.,!?;:', ''))) / greatest(length(t_t), 1), (length(t_t) - length(regexp_replace(t_t, '[\x{{1F300}}-\x{{1FAFF}}]', '', 'g'))) / greatest(length(t_t), 1), least(len(w_t), 100) / 100] AS t FROM e0),
e2 AS (SELECT target_sender AS initiator, source_sender AS responder, list_avg(list_transform(range(1, 7), lambda i: 1 - least(abs(t[i] - r[i]), 1.0))) - list_avg(list_transform(range(1, 7), lambda i: 1 - least(abs(t[i] - base[i]), 1.0))) AS d FROM e1 JOIN mb ON mb.sender = source_sender)
SELECT initiator, responder, count(*)::BIGINT AS n, avg(d) AS delta, avg(d) - 1.96 * CASE WHEN count(*) > 1 THEN stddev_samp(d) / sqrt(count(*)) ELSE 0 END AS lower, avg(d) + 1.96 * CASE WHEN count(*) > 1 THEN stddev_samp(d) / sqrt(count(*)) ELSE 0 END AS upper FROM e2 GROUP BY 1, 2""")
def style_coordination(spark: SparkSession, d: str) -> DataFrame:
    rows = base(spark, d, ["sender", "reply", "text"])
    return R.coordination(rows, R.reply_events(rows, ("sender", "text")))


@query(f"""WITH {_EV}, k AS (SELECT * FROM ev WHERE source_sender IS NOT NULL AND target_sender IS NOT NULL),
pe AS (SELECT DISTINCT conversation_id, sender AS candidate FROM m WHERE sender IS NOT NULL),
a AS (SELECT k.source, k.source_sender, k.target_sender, k.source_sent_at AS at_, pe.candidate,
  count(*) OVER (PARTITION BY source) AS n, max(CASE WHEN candidate = target_sender THEN 1 ELSE 0 END) OVER (PARTITION BY source) AS ok
  FROM k JOIN pe USING (conversation_id) WHERE candidate <> source_sender),
q AS (SELECT * FROM a WHERE n > 1 AND ok = 1)
SELECT source, candidate, candidate = target_sender AS chosen,
  ln(1 + (SELECT count(*) FROM k WHERE k.source_sender = q.source_sender AND k.target_sender = q.candidate AND (k.source_sent_at, k.source) < (q.at_, q.source))) AS repetition,
  ln(1 + (SELECT count(*) FROM k WHERE k.source_sender = q.candidate AND k.target_sender = q.source_sender AND (k.source_sent_at, k.source) < (q.at_, q.source))) AS reciprocity,
  ln(1 + (SELECT count(*) FROM k WHERE k.target_sender = q.candidate AND (k.source_sent_at, k.source) < (q.at_, q.source))) AS popularity,
  coalesce(exp(-(epoch_us(at_) - epoch_us((SELECT max(k.source_sent_at) FROM k WHERE k.source_sender = q.source_sender AND k.target_sender = q.candidate
    AND (k.source_sent_at, k.source) < (q.at_, q.source)))) / 3600000000 / 24), 0) AS recency FROM q""")
def choice_features(spark: SparkSession, d: str) -> DataFrame:
    rows = base(spark, d, ["sender", "sent_at", "reply"])
    return R.choice_features(rows, R.reply_events(rows))


# ------------------------------------------------------------------------------------------ networks


def _page_rank_sql(rounds: int = 10) -> str:
    parts = [
        f"WITH {_ED}, o AS (SELECT src, sum(weight) AS w FROM ed GROUP BY src), v AS (SELECT src AS id FROM ed UNION SELECT dst FROM ed)",
        "n AS (SELECT count(*) AS n FROM v), mv AS (SELECT ed.src, ed.dst, ed.weight / o.w AS p FROM ed JOIN o USING (src))",
        "r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM v, n)",
    ]
    for i in range(rounds):
        parts.append(
            f"""r{i + 1} AS (SELECT v.id, 0.15 / n.n + 0.85 * (coalesce(g.got, 0) + l.lost / n.n) AS rank FROM v
  LEFT JOIN (SELECT mv.dst, sum(mv.p * r.rank) AS got FROM mv JOIN r{i} r ON r.id = mv.src GROUP BY mv.dst) g ON g.dst = v.id, n,
  (SELECT coalesce(sum(rank), 0) AS lost FROM r{i} WHERE id NOT IN (SELECT src FROM o)) l)"""
        )
    return ",\n".join(parts) + f" SELECT id, rank FROM r{rounds}"


@query(_page_rank_sql())
def page_rank(spark: SparkSession, d: str) -> DataFrame:
    return G.page_rank(edges(spark, d))


@query(f"""WITH {_ED} SELECT (SELECT count(*) FROM ed a JOIN ed b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst)::BIGINT AS reciprocal_dyads,
  (SELECT count(*) FROM ed a JOIN ed b ON a.dst = b.src AND a.src <> b.dst JOIN ed c ON c.src = a.src AND c.dst = b.dst)::BIGINT AS transitive_triples""")
def motif_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.motif_counts(edges(spark, d))


_ROLES = f"""{_ED}, sc AS (SELECT sender, count(*) AS n_messages, coalesce(sum(length(text)), 0) AS n_chars, count(*) FILTER (contains(text, '?')) AS q FROM m WHERE sender IS NOT NULL GROUP BY sender HAVING count(*) >= 5),
st AS (SELECT src AS sender, sum(weight) AS w FROM ed GROUP BY 1), rt AS (SELECT dst AS sender, sum(weight) AS w FROM ed GROUP BY 1),
ro AS (SELECT sc.sender, n_messages, n_chars / n_messages AS mean_chars, q / n_messages AS question_share, coalesce(st.w, 0) AS sent, coalesce(rt.w, 0) AS received FROM sc LEFT JOIN st USING (sender) LEFT JOIN rt USING (sender)),
at_ AS (SELECT round_even((count(*) - 1) * 0.75, 0)::INT + 1 AS i FROM ro),
mk AS (SELECT list_sort(list(sent))[any_value(i)] AS ms, list_sort(list(received))[any_value(i)] AS mr, list_sort(list(question_share))[any_value(i)] AS mq, list_sort(list(mean_chars))[any_value(i)] AS mc FROM ro, at_),
rp AS (SELECT sender, n_messages::BIGINT AS n_messages, mean_chars, question_share, sent::BIGINT AS sent, received::BIGINT AS received, CASE WHEN sent >= ms AND sent > 0 AND received >= mr AND received > 0 THEN 'broker' WHEN received >= mr AND received > 0 THEN 'initiator'
  WHEN sent >= ms AND sent > 0 THEN 'responder' WHEN question_share >= mq AND question_share > 0 THEN 'questioner' WHEN mean_chars >= mc AND mean_chars > 0 THEN 'broadcaster' ELSE 'participant' END AS role FROM ro, mk)"""


@query(f"WITH {_ROLES} SELECT * FROM rp ORDER BY CASE WHEN role = 'broker' THEN 0 ELSE 1 END, n_messages DESC, sender LIMIT 30".replace("SELECT * FROM rp", "SELECT *, row_number() OVER (ORDER BY CASE WHEN role = 'broker' THEN 0 ELSE 1 END, n_messages DESC, sender)::INT AS place FROM rp"))
def top_roles(spark: SparkSession, d: str) -> DataFrame:
    return G.top_roles(role_profiles(spark, d))


@query(f"WITH {_ROLES} SELECT * FROM rp")
def role_profiles(spark: SparkSession, d: str) -> DataFrame:
    return G.role_profiles(P.sender_counts(base(spark, d)), edges(spark, d))


@query()
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    return G.betweenness(edges(spark, d))


@query()
def communities(spark: SparkSession, d: str) -> DataFrame:
    return G.communities(edges(spark, d))


@query()
def dyad_null(spark: SparkSession, d: str) -> DataFrame:
    return G.dyad_null(events(spark, d))


@query(f"""WITH {_M}, b AS (SELECT sender, count(*) AS n FROM m WHERE sender IS NOT NULL GROUP BY sender ORDER BY n DESC, sender LIMIT 10),
r AS (SELECT conversation_id, sender, epoch_us(sent_at) AS us, n FROM m JOIN b USING (sender)),
p AS (SELECT x.sender AS source, y.sender AS target, count(*) AS pairs, sum(exp(-(y.us - x.us) / 3600000000 / 24)) AS s, max(x.n) AS n
  FROM r x JOIN r y USING (conversation_id) WHERE y.us > x.us AND y.us - x.us <= 120 * 3600000000 GROUP BY 1, 2),
h AS (SELECT sender AS target, (max(us) - min(us)) / 3600000000 AS h, max(n) AS k FROM r GROUP BY 1)
SELECT source, target, pairs::BIGINT AS pairs, greatest(s / n - CASE WHEN h > 0 THEN k / h ELSE 0 END * 24, 0) AS excess FROM p JOIN h USING (target)""")
def excitation(spark: SparkSession, d: str) -> DataFrame:
    return G.excitation(base(spark, d, ["sender", "sent_at"]))


# ------------------------------------------------------------------------------------------ structure


@query(f"""WITH {_M}, n AS (SELECT conversation_id, row_id, row_number() OVER w - 1 AS ordinal, count(*) OVER (PARTITION BY conversation_id) AS k FROM m WINDOW w AS (PARTITION BY conversation_id ORDER BY sent_at, row_id))
SELECT conversation_id, CASE WHEN ordinal // 40 = (k - 1) // 40 AND (k - 1) // 40 > 0 AND k - (k - 1) // 40 * 40 < 10 THEN ordinal // 40 - 1 ELSE ordinal // 40 END::BIGINT AS window_no,
  row_id, ordinal::INT AS ordinal FROM n""")
def episode_windows(spark: SparkSession, d: str) -> DataFrame:
    return H.windows_of_messages(base(spark, d, ["sent_at"]))


@query(f"""WITH {_M}, n AS (SELECT conversation_id, row_id, external_id, reply, row_number() OVER (PARTITION BY conversation_id ORDER BY sent_at, row_id) AS i FROM m),
c AS (SELECT a.row_id AS anchor, b.row_id AS member, (b.i - a.i)::INT AS place FROM n a JOIN n b USING (conversation_id) WHERE b.i BETWEEN a.i - 3 AND a.i + 1),
l AS (SELECT a.row_id AS anchor, b.row_id AS member, NULL::INT AS place FROM n a JOIN n b ON b.conversation_id = a.conversation_id AND b.external_id = a.reply
  WHERE a.reply <> '' AND NOT b.i BETWEEN a.i - 3 AND a.i + 1)
SELECT * FROM c UNION ALL SELECT * FROM l""")
def message_context(spark: SparkSession, d: str) -> DataFrame:
    rows = row_numbers(base(spark, d, ["sent_at", "reply"]), ["conversation_id"], "sent_at", "row_id", "i").select(
        "conversation_id", "row_id", "external_id", "reply", F.col("i").cast("int").alias("i")
    )
    right = rows.select(F.col("conversation_id").alias("_c"), F.col("row_id").alias("member"), F.col("external_id").alias("_e"), F.col("i").alias("_i"))
    near = rows.withColumn("_at", F.explode(F.sequence(F.col("i") - 3, F.col("i") + 1))).join(
        right, (F.col("conversation_id") == F.col("_c")) & (F.col("_at") == F.col("_i"))
    )
    far = rows.where(F.col("reply") != "").join(right, (F.col("conversation_id") == F.col("_c")) & (F.col("reply") == F.col("_e"))).where(
        ~F.col("_i").between(F.col("i") - 3, F.col("i") + 1)
    )
    return near.select(F.col("row_id").alias("anchor"), "member", (F.col("_i") - F.col("i")).alias("place")).unionByName(
        far.select(F.col("row_id").alias("anchor"), "member", F.lit(None).cast("int").alias("place"))
    )


@query("""WITH o AS (SELECT *, lag(text_hash) OVER w IS NOT DISTINCT FROM text_hash AND row_number() OVER w > 1 AS same FROM messages
  WINDOW w AS (PARTITION BY conversation_id, external_id ORDER BY imported_at, row_id))
SELECT conversation_id, external_id, row_number() OVER (PARTITION BY conversation_id, external_id ORDER BY imported_at, row_id)::INT AS revision_no, row_id,
  epoch_us(imported_at) AS imported_us, text_hash FROM o WHERE NOT same""")
def message_revisions(spark: SparkSession, d: str) -> DataFrame:
    return V.revisions(table(spark, d, "messages")).withColumn("imported_us", F.unix_micros("imported_at")).drop("imported_at")


_MEMBERS = """SELECT conversation_id, external_id, arg_max(row_id, (imported_at, row_id)) AS row_id, arg_max(text_hash, (imported_at, row_id)) AS text_hash FROM (
  SELECT *, lag(text_hash) OVER w IS NOT DISTINCT FROM text_hash AND row_number() OVER w > 1 AS same FROM messages
  WINDOW w AS (PARTITION BY conversation_id, external_id ORDER BY imported_at, row_id)) WHERE NOT same AND imported_at <= TIMESTAMPTZ '2024-01-01 00:00:00+00' GROUP BY ALL"""


@query(_MEMBERS)
def snapshot_members(spark: SparkSession, d: str) -> DataFrame:
    return V.members_at(V.revisions(table(spark, d, "messages")), "2024-01-01 00:00:00")


@query(f"""WITH mb AS ({_MEMBERS}),
e AS (SELECT conversation_id, sha256(concat_ws(chr(1), external_id, text_hash)) AS h FROM mb), f AS (SELECT conversation_id, substr(h, 1, 5) AS five, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM e GROUP BY ALL),
c AS (SELECT conversation_id, substr(five, 1, 2) AS two, sum(n) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM f GROUP BY conversation_id, substr(five, 1, 2)) SELECT conversation_id, sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY h)) AS manifest FROM c GROUP BY conversation_id""")
def snapshot_manifest(spark: SparkSession, d: str) -> DataFrame:
    return V.manifest(V.members_at(V.revisions(table(spark, d, "messages")), "2024-01-01 00:00:00"))


@query("""WITH RECURSIVE e AS (
  SELECT message_id AS source_id, 'e' || evidence_id AS target_id FROM evidence_items WHERE message_id IS NOT NULL
  UNION SELECT message_id, 'f' || feature_id FROM message_features WHERE message_id IS NOT NULL
  UNION SELECT 'f' || feature_id, 's' || snapshot_id FROM message_features WHERE snapshot_id IS NOT NULL),
c AS (SELECT DISTINCT message_id AS start_id, message_id AS id FROM evidence_items WHERE message_id IS NOT NULL
  UNION SELECT c.start_id, e.target_id FROM c JOIN e ON e.source_id = c.id)
SELECT start_id, id FROM c WHERE start_id <> id""")
def lineage_closure(spark: SparkSession, d: str) -> DataFrame:
    ev, fe = table(spark, d, "evidence_items"), table(spark, d, "message_features")
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    links = (
        ev.select(F.col("message_id").alias("source_id"), named("e", "evidence_id").alias("target_id"))
        .unionByName(fe.select(F.col("message_id").alias("source_id"), named("f", "feature_id").alias("target_id")))
        .unionByName(fe.select(named("f", "feature_id").alias("source_id"), named("s", "snapshot_id").alias("target_id")))
    )
    start = ev.where(F.col("message_id").isNotNull()).select(F.col("message_id").alias("id"))
    return V.lineage_closure(links, start).select("start_id", "id")


# ------------------------------------------------------------------------------------------ text rules

@query(r"""WITH RECURSIVE s AS (SELECT evidence_id, text, regexp_extract_all(text, '[^.!?…\n]+[.!?…]*') AS parts FROM evidence_items WHERE text IS NOT NULL AND text <> ''),
p AS (SELECT evidence_id, text, parts, 0 AS i, 1 AS at_, NULL::VARCHAR AS piece, 0 AS pos FROM s
  UNION ALL SELECT evidence_id, text, parts, i + 1, at_ + strpos(substr(text, at_), parts[i + 1]) - 1 + length(parts[i + 1]), parts[i + 1], at_ + strpos(substr(text, at_), parts[i + 1]) - 1
  FROM p WHERE i < len(parts)),
q AS (SELECT evidence_id, pos - 1 + length(piece) - length(regexp_replace(piece, '^[\s\x{00A0}\x{200B}]+', '')) AS st, regexp_replace(piece, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') AS body FROM p WHERE i > 0)
SELECT evidence_id, st::INT AS start_codepoint, (st + length(body))::INT AS end_codepoint, body AS sentence FROM q WHERE body <> ''
UNION ALL SELECT evidence_id, 0, length(text)::INT, text FROM s WHERE evidence_id NOT IN (SELECT evidence_id FROM q WHERE body <> '')""")
def sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "evidence_items").where(F.col("text").isNotNull()).select("evidence_id", F.explode(T.sentences(F.col("text"))).alias("_s"))
    return rows.select("evidence_id", F.col("_s.start").alias("start_codepoint"), F.col("_s.end").alias("end_codepoint"), F.col("_s.sentence").alias("sentence"))


@query(f"""WITH {_M}, a AS (SELECT strftime(sent_at, '%Y-%m') AS month, regexp_extract_all(lower(text), '[а-яёa-z][а-яёa-z-]*') AS w FROM m WHERE text <> ''), j AS (SELECT month, w, ' ' || array_to_string(w, ' ') || ' ' AS j FROM a),
r AS (SELECT month, (len(list_filter(w, lambda x: x IN ('хорошо', 'отлично', 'рад', 'успех', 'получилось', 'спасибо')))) / greatest(len(w), 1) - (len(list_filter(w, lambda x: x IN ('плохо', 'ошибка', 'провал', 'проблема', 'страх', 'злость')))) / greatest(len(w), 1) AS valence,
  (len(list_filter(w, lambda x: x IN ('срочно', 'немедленно', 'ужас', 'ура', 'бесит', 'критично')))) / greatest(len(w), 1) AS arousal,
  (len(list_filter(w, lambda x: x IN ('точно', 'обязательно', 'решено', 'делаем', 'требую', 'нужно')))) / greatest(len(w), 1) - (len(list_filter(w, lambda x: x IN ('возможно', 'кажется', 'наверное', 'может'))) + CASE WHEN contains(j, 'не уверен') THEN 1 ELSE 0 END) / greatest(len(w), 1) AS dominance,
  (len(list_filter(w, lambda x: x IN ('злой', 'злость', 'бесит', 'ярость', 'возмущён', 'ненавижу')))) / greatest(len(w), 1) AS anger,
  (len(list_filter(w, lambda x: x IN ('страшно', 'страх', 'боюсь', 'опасно', 'тревожно', 'риск')))) / greatest(len(w), 1) AS fear,
  (len(list_filter(w, lambda x: x IN ('грустно', 'печально', 'жаль', 'потеря', 'разочарован')))) / greatest(len(w), 1) AS sadness,
  (len(list_filter(w, lambda x: x IN ('рад', 'рада', 'радость', 'отлично', 'счастлив', 'ура')))) / greatest(len(w), 1) AS joy,
  (len(list_filter(w, lambda x: x IN ('устал', 'надоело', 'опять', 'тупик', 'раздражает'))) + CASE WHEN contains(j, 'не получается') THEN 1 ELSE 0 END) / greatest(len(w), 1) AS frustration FROM j)
SELECT month, count(*)::BIGINT AS n, count(*) FILTER (valence <> 0 OR arousal <> 0 OR dominance <> 0 OR anger <> 0 OR fear <> 0 OR sadness <> 0 OR joy <> 0 OR frustration <> 0)::BIGINT AS n_signal, avg(valence) AS valence, avg(arousal) AS arousal, avg(dominance) AS dominance, avg(anger) AS anger, avg(fear) AS fear, avg(sadness) AS sadness, avg(joy) AS joy, avg(frustration) AS frustration FROM r GROUP BY month""")
def affect_by_month(spark: SparkSession, d: str) -> DataFrame:
    rows = base(spark, d, ["text", "sent_at"]).where(F.col("text") != "").select(F.date_format("sent_at", "yyyy-MM").alias("month"), T.affect(F.col("text")).alias("a"))
    names = ["valence", "arousal", "dominance", "anger", "fear", "sadness", "joy", "frustration"]
    any_signal = None
    for n in names:
        any_signal = (F.col(f"a.{n}") != 0) if any_signal is None else any_signal | (F.col(f"a.{n}") != 0)
    return rows.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.count_if(any_signal).alias("n_signal"), *[F.avg(f"a.{n}").alias(n) for n in names])


@query("""SELECT message_id, external_id, sha256(text) AS text_sha, coalesce(nullif(trim(display_name, ' '), ''), p.external_id_p, 'unknown') AS shown FROM (
  SELECT message_id, external_id, text, sender_external_id FROM messages WHERE text IS NOT NULL) m
LEFT JOIN (SELECT external_id AS external_id_p, display_name FROM participants) p ON p.external_id_p = m.sender_external_id""")
def display_names(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "participants").select(F.col("external_id").alias("_p"), "display_name")
    rows = table(spark, d, "messages").where(F.col("text").isNotNull()).join(people, F.col("sender_external_id") == F.col("_p"), "left")
    shown = F.coalesce(F.nullif(F.trim("display_name"), F.lit("")), F.col("_p"), F.lit("unknown"))
    return rows.select("message_id", "external_id", F.sha2("text", 256).alias("text_sha"), shown.alias("shown"))


# ------------------------------------------------------------------------------------------ retrieval and themes


@query(rf"""WITH {_M}, qs AS (SELECT budget_id AS query_id, lower(replace(purpose, '_', ' ')) AS ph FROM token_budgets),
t AS (SELECT row_id, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS term FROM m WHERE text IS NOT NULL), tf AS (SELECT row_id, term, count(*) AS tf FROM t GROUP BY ALL),
qt AS (SELECT DISTINCT query_id, ph, unnest(regexp_extract_all('schedule archive pump отчёт склад', '{_TOK}')) AS term FROM qs), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n FROM m WHERE text IS NOT NULL),
sc AS (SELECT query_id, row_id, sum((1 + ln(tf)) * ln(1 + n.n / (1 + df))) AS s FROM tf JOIN dfs USING (term) JOIN qt USING (term), n GROUP BY ALL),
r AS (SELECT query_id, row_id, round(s + CASE WHEN contains(lower(text), 'schedule archive pump отчёт склад') THEN 3 ELSE 0 END, 9) AS score, sent_at FROM sc JOIN m USING (row_id))
SELECT query_id, row_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sent_at, row_id) AS rank FROM r) WHERE rank <= 20""")
def lexical_retrieval(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "token_budgets").select(F.col("budget_id").alias("query_id"), F.lit("schedule archive pump отчёт склад").alias("query"))
    return Q.search(base(spark, d, ["text", "sent_at"]), asked, "row_id", "text", "sent_at")


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0), p AS (
  SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, vec_id, score, rank::INT AS rank FROM r WHERE rank <= 10""")
def embedding_search(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all vectors, the queries broadcast in blocks of at most ``QUERY_BLOCK`` of them."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = vectors.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q"))
    blocks = max(1, -(-2 * asked.count() // QUERY_BLOCK))
    pairs = None
    for block in range(blocks):
        part = vectors.join(F.broadcast(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)), F.col("vec_id") != F.col("query_id"))
        pairs = part if pairs is None else pairs.unionByName(part)
    scored = pairs.select("query_id", "vec_id", F.round(T.cosine(F.col("_q"), F.col("embedding")), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 10)


_TFIDF = rf"""w AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_-]+'), lambda x: length(x) >= 4)) AS term FROM documents WHERE text IS NOT NULL), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
n AS (SELECT count(DISTINCT doc_id) AS n FROM documents WHERE text IS NOT NULL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), v AS (SELECT term, df FROM df, n WHERE df >= 2 AND df <= 0.9 * n ORDER BY df DESC, term LIMIT 262144),
x AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN v USING (term), n), tw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM x)"""


@query(f"WITH {_TFIDF} SELECT doc_id, term, weight FROM tw")
def document_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return H.tfidf(table(spark, d, "documents"), "doc_id", "text")


@query()
def embedding_clusters(spark: SparkSession, d: str) -> DataFrame:
    return H.clusters(table(spark, d, "embeddings"), "vec_id", "embedding")


@query()
def topics_lda(spark: SparkSession, d: str) -> DataFrame:
    return H.topics_lda(table(spark, d, "documents"), "doc_id", "text")


@query()
def topics_nmf(spark: SparkSession, d: str) -> DataFrame:
    return H.topics_nmf(H.tfidf(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


@query(rf"""WITH {_M}, g AS (SELECT message_id, arg_min(vec_values::DOUBLE[], feature_id) AS v FROM message_features WHERE len(vec_values) = 64 AND len(list_filter(vec_values, lambda x: x IS NOT NULL AND NOT isnan(x))) = 64 GROUP BY 1),
r AS (SELECT row_id, text, row_number() OVER (ORDER BY sent_at, row_id) - 1 AS i, count(*) OVER () AS n, CASE WHEN list_dot_product(v, v) > 0 THEN list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) ELSE v END AS u FROM m JOIN g USING (message_id) WHERE text IS NOT NULL AND sent_at IS NOT NULL),
t AS (SELECT unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_-]+'), lambda x: length(x) >= 4))) AS term, i >= n // 2 AS late, u FROM r WHERE n >= 6),
c AS (SELECT term, count(*) FILTER (NOT late) AS n_early, count(*) FILTER (late) AS n_late FROM t GROUP BY term HAVING count(*) FILTER (NOT late) >= 2 AND count(*) FILTER (late) >= 2),
e AS (SELECT term, late, unnest(u) AS x, generate_subscripts(u, 1) AS k FROM t SEMI JOIN c USING (term)), a AS (SELECT term, k, avg(x) FILTER (NOT late) AS a, avg(x) FILTER (late) AS b FROM e GROUP BY ALL),
d AS (SELECT term, round(1 - sum(a * b), 9) AS distance, sqrt(sum((a - b) * (a - b))) AS shift FROM a GROUP BY term) SELECT term, n_early::BIGINT AS n_early, n_late::BIGINT AS n_late, distance, shift FROM d JOIN c USING (term) ORDER BY distance DESC, term LIMIT 50""")
def semantic_change(spark: SparkSession, d: str) -> DataFrame:
    good = table(spark, d, "message_features").where((F.size("vec_values") == 64) & ~F.exists("vec_values", lambda x: x.isNull() | F.isnan(x)))
    one = good.groupBy("message_id").agg(F.min_by(F.transform("vec_values", lambda x: x.cast("double")), "feature_id").alias("vec"))
    rows = base(spark, d).join(one, "message_id")
    return H.semantic_change(rows.drop("vec"), rows.select("row_id", "vec"))


# ------------------------------------------------------------------------------------------ states


def _states(spark: SparkSession, d: str) -> DataFrame:
    rows = base(spark, d, ["sender", "sent_at", "text"]).withColumn("kind", S.length_bucket(F.col("text")))
    return X.weekly_states(rows, "kind")


_WEEKS = f"""{_M}, w AS (SELECT sender, date_trunc('week', sent_at)::DATE AS week, CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty' WHEN length(text) < 40 THEN 'short'
  WHEN length(text) < 200 THEN 'medium' ELSE 'long' END AS state, sent_at, row_id FROM m WHERE sender IS NOT NULL AND sent_at IS NOT NULL),
c AS (SELECT sender, week, state, count(*) AS n, min((sent_at, row_id)) AS f FROM w GROUP BY ALL),
st AS (SELECT sender, week, state FROM c QUALIFY row_number() OVER (PARTITION BY sender, week ORDER BY n DESC, f) = 1)"""


@query(f"WITH {_WEEKS} SELECT sender, week::VARCHAR AS week, state FROM st")
def weekly_states(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d).withColumn("week", F.col("week").cast("string"))


@query(f"""WITH {_WEEKS}, t AS (SELECT a.sender AS target, a.week, a.state AS z, b.state AS y FROM st a JOIN st b ON b.sender = a.sender AND b.week = a.week + 7),
tr AS (SELECT s.sender AS source, t.target, x.state AS x, t.y, t.z FROM t JOIN st x ON x.week = t.week AND x.sender <> t.target JOIN (SELECT DISTINCT sender FROM st) s ON s.sender = x.sender),
k AS (SELECT source, target, count(*) AS n FROM tr GROUP BY ALL HAVING count(*) >= 20), f AS (SELECT tr.* FROM tr SEMI JOIN k USING (source, target)),
h AS (SELECT source, target, 'yz' AS p, y || '|' || z AS v FROM f UNION ALL SELECT source, target, 'xz', x || '|' || z FROM f UNION ALL SELECT source, target, 'z', z FROM f
  UNION ALL SELECT source, target, 'xyz', x || '|' || y || '|' || z FROM f),
g AS (SELECT source, target, p, v, count(*) AS n FROM h GROUP BY ALL), e AS (SELECT source, target, p, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM g GROUP BY ALL)
SELECT k.source, k.target, k.n::BIGINT AS n, greatest(sum(CASE WHEN p IN ('yz', 'xz') THEN h ELSE -h END), 0) AS bits FROM k JOIN e USING (source, target) GROUP BY ALL""")
def transfer_entropy(spark: SparkSession, d: str) -> DataFrame:
    return X.transfer_entropy(_states(spark, d))


@query(f"""WITH {_M}, t AS (SELECT CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty' WHEN length(text) < 40 THEN 'short' WHEN length(text) < 200 THEN 'medium' ELSE 'long' END AS y, coalesce(message_type, '?') AS x1, coalesce(reply, '') <> '' AS x2 FROM m),
n AS (SELECT count(*) AS n FROM t), py AS (SELECT y, count(*) AS k FROM t GROUP BY y), a1 AS (SELECT y, x1 AS x, count(*) AS k FROM t GROUP BY ALL), a2 AS (SELECT y, x2::VARCHAR AS x, count(*) AS k FROM t GROUP BY ALL),
s1 AS (SELECT a1.y, sum(a1.k / py.k * log2(a1.k * n / (m1.k * py.k))) AS s FROM a1 JOIN py USING (y) JOIN (SELECT x, sum(k) AS k FROM a1 GROUP BY x) m1 ON m1.x = a1.x, n GROUP BY a1.y),
s2 AS (SELECT a2.y, sum(a2.k / py.k * log2(a2.k * n / (m2.k * py.k))) AS s FROM a2 JOIN py USING (y) JOIN (SELECT x, sum(k) AS k FROM a2 GROUP BY x) m2 ON m2.x = a2.x, n GROUP BY a2.y),
i AS (SELECT sum(py.k / n * least(s1.s, s2.s)) AS r, sum(py.k / n * s1.s) AS i1, sum(py.k / n * s2.s) AS i2 FROM py JOIN s1 USING (y) JOIN s2 USING (y), n),
h AS (SELECT (SELECT -sum(p * log2(p)) FROM (SELECT count(*) / (SELECT count(*) FROM t) AS p FROM t GROUP BY y)) + (SELECT -sum(p * log2(p)) FROM (SELECT count(*) / (SELECT count(*) FROM t) AS p FROM t GROUP BY x1, x2)) - (SELECT -sum(p * log2(p)) FROM (SELECT count(*) / (SELECT count(*) FROM t) AS p FROM t GROUP BY x1, x2, y)) AS total)
SELECT 'all' AS scope, n::BIGINT AS n, r AS redundancy, i1 - r AS unique_1, i2 - r AS unique_2, total - i1 - i2 + r AS synergy FROM n, i, h WHERE n >= 30""")
def information_atoms(spark: SparkSession, d: str) -> DataFrame:
    rows = base(spark, d, ["sender", "sent_at", "text", "message_type", "reply"])
    triples = rows.select(
        F.lit("all").alias("scope"),
        S.length_bucket(F.col("text")).alias("y"),
        F.coalesce("message_type", F.lit("?")).alias("x1"),
        (F.coalesce(F.col("reply"), F.lit("")) != "").cast("string").alias("x2"),
    )
    return X.information_atoms(triples, ["scope"])


@query()
def hidden_states(spark: SparkSession, d: str) -> DataFrame:
    return X.hidden_states(X.monthly_vector(base(spark, d)), "month", ["n", "mean_chars", "question_share", "reply_share", "entropy"])


@query(f"""WITH {_M}, x AS (SELECT *, strftime(sent_at, '%Y-%m') AS month FROM m WHERE sent_at IS NOT NULL),
h AS (SELECT month, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM (SELECT month, sender, count(*) AS n FROM x WHERE sender IS NOT NULL GROUP BY ALL) GROUP BY month)
SELECT month, count(*)::BIGINT AS n, avg(coalesce(length(text), 0)) AS mean_chars, count(*) FILTER (contains(text, '?')) / count(*) AS question_share,
  count(*) FILTER (reply <> '') / count(*) AS reply_share, coalesce(any_value(entropy), 0) AS entropy FROM x LEFT JOIN h USING (month) GROUP BY month""")
def monthly_vector(spark: SparkSession, d: str) -> DataFrame:
    return X.monthly_vector(base(spark, d))


# ------------------------------------------------------------------------------------------ labels


_GOLD = """g AS (SELECT unit_id, task, annotator, upper(trim(label, ' ')) AS label, slot, submitted_at, judgment_id FROM gold_task_judgments
  WHERE status = 'PRESENT' AND label IS NOT NULL AND annotator IS NOT NULL)"""


@query(f"""WITH {_GOLD}, a AS (SELECT DISTINCT unit_id, task, label FROM g WHERE slot = 'A'), b AS (SELECT DISTINCT unit_id, task, label FROM g WHERE slot = 'B'),
j AS (SELECT coalesce(a.label, b.label) AS label, a.label IS NOT NULL AS ga, b.label IS NOT NULL AS gb FROM a FULL JOIN b ON a.unit_id = b.unit_id AND a.task = b.task AND a.label = b.label),
c AS (SELECT label, count(*) FILTER (ga AND gb) AS tp, count(*) FILTER (gb AND NOT ga) AS fp, count(*) FILTER (ga AND NOT gb) AS fn FROM j GROUP BY label),
al AS (SELECT * FROM c UNION ALL SELECT 'MICRO', sum(tp), sum(fp), sum(fn) FROM c),
r AS (SELECT label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM al)
SELECT * FROM r UNION ALL SELECT 'MACRO', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, avg(precision), avg(recall), avg(f1) FROM r WHERE label <> 'MICRO'""")
def label_scores(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gold_task_judgments").where((F.col("status") == "PRESENT") & F.col("label").isNotNull() & F.col("annotator").isNotNull())
    g = g.select("unit_id", "task", "slot", F.upper(F.trim("label")).alias("label"))
    return E.precision_recall(g.where("slot = 'A'"), g.where("slot = 'B'"), ["unit_id", "task"], "label")


@query(f"""WITH {_M}, x AS (SELECT i.resolution_confidence AS p, CASE WHEN i.sent_at IS NOT NULL THEN 1.0 ELSE 0.0 END AS y FROM import_messages i WHERE resolution_confidence IS NOT NULL),
b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my, sum((p - y) ^ 2) AS s FROM x GROUP BY 1)
SELECT sum(n)::BIGINT AS n, sum(s) / sum(n) AS brier, sum(abs(mp - my) * n) / sum(n) AS ece FROM b""")
def confidence_calibration(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "import_messages").select("resolution_confidence", F.col("sent_at").isNotNull().alias("ok"))
    return E.calibration(rows, "resolution_confidence", "ok")


@query(f"""WITH {_M}, h AS (SELECT row_id, coalesce(message_type, '') AS kind, CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty' WHEN length(text) < 40 THEN 'short' WHEN length(text) < 200 THEN 'medium' ELSE 'long' END AS size,
  sha256('pilot:' || row_id) AS h FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY kind, size ORDER BY h, row_id) AS depth FROM h),
o AS (SELECT *, row_number() OVER (ORDER BY depth, sha256('pilot:' || kind || '|' || size), row_id) AS place FROM k)
SELECT row_id, kind, size, depth::INT AS depth, place::INT AS place FROM o WHERE place <= 200""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = base(spark, d, ["message_type", "text"]).select("row_id", F.coalesce("message_type", F.lit("")).alias("kind"), S.length_bucket(F.col("text")).alias("size"))
    return S.stratified_sample(rows, "row_id", ["kind", "size"], 200, "pilot")


@query("""WITH u AS (SELECT DISTINCT unit_id FROM gold_task_judgments), r AS (SELECT unit_id, row_number() OVER (ORDER BY sha256('double:' || unit_id), unit_id) AS i, count(*) OVER () AS n FROM u)
SELECT unit_id FROM r WHERE i <= round_even(n * 0.3, 0)""")
def double_cohort(spark: SparkSession, d: str) -> DataFrame:
    return S.lowest_hashes(table(spark, d, "gold_task_judgments").select("unit_id").distinct(), "unit_id", 0.3, "double")


@query()
def conversation_split(spark: SparkSession, d: str) -> DataFrame:
    return S.balanced_split(table(spark, d, "messages"), "conversation_id", {"train": 0.6, "dev": 0.2, "test": 0.2}, "split")


@query("""SELECT u.unit_id, t.task, s.slot FROM (SELECT DISTINCT unit_id FROM gold_task_judgments) u, (VALUES ('dialogue_act'), ('stance'), ('grounding')) t(task), (VALUES ('A'), ('B')) s(slot)
WHERE NOT EXISTS (SELECT 1 FROM gold_task_judgments g WHERE g.unit_id = u.unit_id AND g.task = t.task AND g.slot = s.slot)""")
def missing_tasks(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gold_task_judgments")
    return S.missing_tasks(g, g, ["dialogue_act", "stance", "grounding"], ["A", "B"])


# ------------------------------------------------------------------------------------------ measurements


def registry() -> Registry:
    """The built-in measurements over the tables ``messages`` and ``events``."""
    r = Registry()
    r.register(Measurement("participation.share", "1", lambda t: P.participation_share(t["messages"])))
    r.register(Measurement("participation.concentration", "1", lambda t: P.concentration(t["messages"])))
    r.register(Measurement("activity.months", "1", lambda t: P.monthly_counts(t["messages"])))
    r.register(Measurement("activity.changes", "1", lambda t: P.robust_change_points(P.monthly_counts(t["messages"]))))
    r.register(Measurement("replies.reciprocity", "1", lambda t: R.reciprocity(t["events"])))
    r.register(Measurement("replies.structure", "1", lambda t: R.reply_structure(t["messages"], t["events"])))
    r.register(Measurement("network.motifs", "1", lambda t: G.motif_counts(G.reply_edges(t["events"]))))
    return r


@query()
def measurement_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Every registered measurement as canonical JSON with its hash."""
    r = registry()
    tables = {"messages": base(spark, d, ["sender", "sent_at", "reply"]), "events": events(spark, d)}
    parts = [artifact_json(r.execute(i, tables, inputs=d.rstrip("/").rsplit("/", 1)[-1])) for i in r.definitions()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
