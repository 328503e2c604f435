"""SQL that gives the same results as the queries, for a second engine."""

from __future__ import annotations

import re

from caseloom.functions import constants as K
from caseloom.operators.drafting import (
    NO_CASES, NO_HISTORY, PROMPT_CASES, PROMPT_HEAD, PROMPT_TASK, PROMPT_TASK_NO_CASES,
)
from caseloom.operators.sweeps import VALIDATION_GRID
from checks.queries import LANGUAGE_RULES, SMALL_BRANDS
from checks.views import PHRASES

OTHER = K.OTHER
W = r"[\p{L}\p{N}_]"
SPACES = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def half(x: str, n: int) -> str:
    s = f"{10**n}e0"
    return f"(floor(({x})::DOUBLE * {s} + 0.5e0) / {s})"


def num(x: float) -> str:
    return f"{x!r}e0"


def edged(pattern: str) -> str:
    """Word edges as consumed characters, which works for any letters."""
    body = pattern.removeprefix(r"\b").removesuffix(r"\b")
    return rf"(^|[^\p{{L}}\p{{N}}_])(?:{body})($|[^\p{{L}}\p{{N}}_])"


def any_of(text: str, patterns: list[str], flags: str = "") -> str:
    opt = f", {q(flags)}" if flags else ""
    return "(" + " OR ".join(f"regexp_matches({text}, {q(p)}{opt})" for p in patterns) + ")"


def hits(text: str, patterns: list[str], flags: str = "", edges: bool = False) -> str:
    opt = f", {q(flags)}" if flags else ""
    found = [edged(p) if edges else p for p in patterns]
    return "(" + " + ".join(f"regexp_matches({text}, {q(p)}{opt})::INT" for p in found) + ")"


def labelled(source: str, text: str, rules=K.INTENT_PATTERNS, edges: bool = False) -> str:
    """Source rows with hits h0.., intent and intent_confidence."""
    cols = ", ".join(f"{hits('lt', p, edges=edges)} AS h{i}" for i, p in enumerate(rules.values()))
    tops = ", ".join(f"h{i}" for i in range(len(rules)))
    whens = " ".join(f"WHEN h{i} = top THEN {q(n)}" for i, n in enumerate(rules))
    return f"""SELECT *, CASE WHEN top = 0 THEN {q(OTHER)} {whens} END AS intent,
      CASE WHEN top = 0 THEN 0e0 ELSE least(1e0, {half('top * 0.4e0 + 0.2e0', 2)}) END AS intent_confidence
    FROM (SELECT *, greatest({tops}) AS top FROM (
      SELECT *, {cols} FROM (SELECT *, lower({text}) AS lt FROM {source})))"""


def phrase(i: str) -> str:
    return "[" + ", ".join(q(p) for p in PHRASES) + f"][({i}) + 1]"


def clean(text: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(coalesce({text}, ''), "
            rf"'[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '{SPACES}', ' ', 'g'))")


# --- views ------------------------------------------------------------------------------------

TWEETS = f"""
turns AS (SELECT conv_id, turn, role FROM conversations WHERE role <> 'system'),
linked AS (
  SELECT t.conv_id, t.turn, t.role, p.turn IS NOT NULL AS has_prev, n.turn IS NOT NULL AS has_next,
         m.turn IS NOT NULL AS has_next2
  FROM turns t
  LEFT JOIN turns p ON p.conv_id = t.conv_id AND p.turn = t.turn - 1
  LEFT JOIN turns n ON n.conv_id = t.conv_id AND n.turn = t.turn + 1
  LEFT JOIN turns m ON m.conv_id = t.conv_id AND m.turn = t.turn + 2),
made AS (
  SELECT conv_id, NOT has_prev AS is_first, (conv_id * 100 + turn)::VARCHAR AS tweet_id,
    CASE WHEN role = 'user' THEN 'cust_' || (conv_id % 37) ELSE 'Brand' || (conv_id % 4) END AS author_id,
    role = 'user' AS inbound,
    strftime(TIMESTAMP '2017-10-01' + to_hours(conv_id) + to_minutes(turn), '%a %b %d %H:%M:%S +0000 %Y') AS created_at,
    {phrase("CASE WHEN role = 'user' THEN (conv_id * 7 + turn * 3) % 20 ELSE 20 + (conv_id + turn) % 4 END")} AS text,
    CASE WHEN NOT has_prev AND has_next AND has_next2 AND conv_id % 5 = 0
           THEN (conv_id * 100 + turn + 1)::VARCHAR || ', ' || (conv_id * 100 + turn + 2)::VARCHAR
         WHEN has_next THEN (conv_id * 100 + turn + 1)::VARCHAR END AS response_tweet_id,
    CASE WHEN has_prev THEN (conv_id * 100 + turn - 1)::VARCHAR END AS in_response_to_tweet_id
  FROM linked),
tweets AS (
  SELECT tweet_id, author_id, inbound, created_at, text, response_tweet_id, in_response_to_tweet_id FROM made
  UNION ALL
  SELECT tweet_id, author_id, inbound, created_at, text, response_tweet_id, in_response_to_tweet_id FROM made
  WHERE conv_id % 10 = 3
  UNION ALL
  SELECT (conv_id * 100 + 99)::VARCHAR, author_id, inbound, created_at, '   ', NULL, NULL FROM made
  WHERE conv_id % 10 = 4 AND is_first),
cleaned AS (
  SELECT DISTINCT *, {clean('text')} AS cleaned_text FROM tweets
  WHERE tweet_id IS NOT NULL AND author_id IS NOT NULL AND {clean('text')} <> '')"""

# Every walk from a root along the reply lists; a message belongs to its smallest label.
THREADS = TWEETS + f""",
listed AS (
  SELECT tweet_id AS parent, unnest(string_split(response_tweet_id, ',')) AS raw,
         generate_subscripts(string_split(response_tweet_id, ','), 1) - 1 AS position
  FROM cleaned WHERE response_tweet_id IS NOT NULL),
edges AS (
  SELECT parent, trim(raw) AS child, min(position) AS position FROM listed
  WHERE trim(raw) IN (SELECT tweet_id FROM cleaned) GROUP BY ALL),
roots AS (
  SELECT tweet_id FROM cleaned WHERE inbound AND (in_response_to_tweet_id IS NULL
    OR in_response_to_tweet_id NOT IN (SELECT tweet_id FROM cleaned))),
walks AS (
  SELECT tweet_id, tweet_id AS root_id, tweet_id::BIGINT AS root_number, 0 AS depth, []::BIGINT[] AS path FROM roots
  UNION ALL
  SELECT e.child, w.root_id, w.root_number, w.depth + 1, list_append(w.path, e.position::BIGINT)
  FROM walks w JOIN edges e ON e.parent = w.tweet_id),
labels AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY root_number, depth, path) AS k FROM walks)
  WHERE k = 1),
turns_ AS (
  SELECT 'conv_' || l.root_id AS conversation_id, l.root_id AS root_tweet_id, l.depth, l.path, c.tweet_id, c.author_id,
         c.inbound, c.created_at, c.cleaned_text AS text,
         row_number() OVER (PARTITION BY l.root_id ORDER BY l.depth, l.path) AS position
  FROM labels l JOIN cleaned c USING (tweet_id)),
replies AS (
  SELECT conversation_id, author_id AS brand, text AS brand_response FROM (
    SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY position) AS k FROM turns_ WHERE NOT inbound)
  WHERE k = 1),
convs AS (
  SELECT t.conversation_id, t.root_tweet_id, r.brand, t.author_id AS customer_id, t.created_at AS timestamp,
         t.text AS customer_message, r.brand_response, s.turns, s.resolution_available
  FROM turns_ t JOIN replies r USING (conversation_id)
  JOIN (SELECT conversation_id, count(*) AS turns,
          bool_or(inbound AND position > 1 AND {any_of('lower(text)', K.RESOLUTION_PATTERNS)}) AS resolution_available
        FROM turns_ GROUP BY 1) s USING (conversation_id)
  WHERE t.position = 1)"""

MESSAGES = f"""
phrases AS (SELECT unnest(range({len(PHRASES)})) AS i),
phrase_texts AS (SELECT i, {phrase('i')} AS phrase FROM phrases),
phrase_intents AS (SELECT list(intent ORDER BY i) AS pi FROM ({labelled('phrase_texts', 'phrase')})),
raw_messages AS (
  SELECT event_id AS message_id, user_id AS customer_id,
    CASE WHEN event_id % 5 = 0 THEN '@115821 ' ELSE '' END
    || CASE WHEN event_id % 11 = 0 THEN upper({phrase('event_id % 20')}) ELSE {phrase('event_id % 20')} END
    || CASE WHEN event_id % 7 = 0 THEN ' https://t.co/x' ELSE '' END AS message,
    pi[(event_id + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END) % 20 + 1] AS true_intent,
    ((event_id * 37) % 100) / 100e0 AS confidence,
    ((event_id * 53) % 100) / 100e0 AS top_similarity,
    [{{'rank': 1, 'similarity_score': {half("((event_id * 53) % 100) / 100e0 * (1.1e0 - 0.1e0 * 1)", 4)},
       'message': {phrase('(event_id + 1) % 20')}, 'reply': {phrase('20 + (event_id + 1) % 4')},
       'intent': pi[(event_id + 1) % 20 + 1], 'id': 'conv_' || (event_id + 1)}},
     {{'rank': 2, 'similarity_score': {half("((event_id * 53) % 100) / 100e0 * (1.1e0 - 0.1e0 * 2)", 4)},
       'message': {phrase('(event_id + 2) % 20')}, 'reply': {phrase('20 + (event_id + 2) % 4')},
       'intent': pi[(event_id + 2) % 20 + 1], 'id': 'conv_' || (event_id + 2)}},
     {{'rank': 3, 'similarity_score': {half("((event_id * 53) % 100) / 100e0 * (1.1e0 - 0.1e0 * 3)", 4)},
       'message': {phrase('(event_id + 3) % 20')}, 'reply': {phrase('20 + (event_id + 3) % 4')},
       'intent': pi[(event_id + 3) % 20 + 1], 'id': 'conv_' || (event_id + 3)}}] AS cases,
    {phrase('20 + event_id % 4')} AS true_reply
  FROM events, phrase_intents),
messages AS ({labelled('raw_messages', 'message')}),
predicted AS (SELECT *, confidence < 0.1e0 AS is_uncertain FROM messages)"""


def with_(views: str, sql: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}\n{sql}"


def tweets(sql: str) -> str:
    return with_(TWEETS, sql)


def threads(sql: str) -> str:
    return with_(THREADS, sql, recursive=True)


def messages(sql: str, extra: str = "") -> str:
    return with_(MESSAGES + extra, sql)


def epoch(text: str) -> str:
    return f"epoch(try_strptime({text}, '%a %b %d %H:%M:%S %z %Y'))::BIGINT"


# --- splits ---------------------------------------------------------------------------------------


def split_of(source: str, key: str) -> str:
    return f"""SELECT *, CASE WHEN place <= floor(total * 0.7e0) THEN 'train'
      WHEN place <= floor(total * 0.7e0) + floor(total * 0.15e0) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY md5({key}::VARCHAR || ':42'), {key}) AS place,
          count(*) OVER () AS total FROM {source})"""


def temporal_of(source: str, order: str) -> str:
    return f"""SELECT *, seat > floor(seats * (1e0 - 0.15e0)) AS is_temporal_test
    FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS seat, count(*) OVER () AS seats FROM {source})"""


def audit(source: str, subjects: list[str], temporal: bool = False) -> str:
    names = ["train", "val", "test"] + (["temporal_test"] if temporal else [])
    test = {n: f"split = '{n}'" for n in names} | {"temporal_test": "is_temporal_test"}
    parts = []
    for s in subjects:
        marks = ", ".join(f"bool_or({test[n]}) AS m_{n}" for n in names)
        for i, a in enumerate(names):
            for b in names[i:]:
                parts.append(
                    f"SELECT '{a}' AS left_split, '{b}' AS right_split, count(*) FILTER (m_{a} AND m_{b}) AS shared, "
                    f"'{s}' AS subject FROM (SELECT {s}, {marks} FROM {source} WHERE {s} IS NOT NULL GROUP BY {s})"
                )
    return " UNION ALL ".join(parts)


# --- features -----------------------------------------------------------------------------------------


def counts_of(source: str, key: str, text: str, bigrams: bool = True) -> str:
    tokens = rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}')"
    grams = "tk"
    if bigrams:
        grams = "list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1]))"
    return f"""SELECT {key}, term, count(*) AS tf FROM (
      SELECT {key}, unnest({grams}) AS term FROM (SELECT {key}, {tokens} AS tk FROM {source})) GROUP BY ALL"""


def tfidf_views(source: str, key: str, text: str, bigrams: bool, limit: int) -> str:
    return f"""counts AS ({counts_of(source, key, text, bigrams)}),
    vocab AS (SELECT term, df, total, ln((1e0 + n) / (1e0 + df)) + 1e0 AS idf FROM (
      SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM counts GROUP BY term HAVING count(*) >= 2
      ORDER BY total DESC, term LIMIT {limit}), (SELECT count(*) AS n FROM {source}))"""


def tfidf_per_document(key: str, sublinear: bool) -> str:
    tf = "1e0 + ln(tf)" if sublinear else "tf"
    return f""", raw AS (SELECT {key}, term, ({tf}) * idf AS raw FROM counts JOIN vocab USING (term)),
    weighted AS (SELECT {key}, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})) AS weight FROM raw)
    SELECT {key}, count(*) AS n_known_terms, {half('sum(weight)', 5)} AS weight_sum, {half('max(weight)', 5)} AS weight_max,
      first(term ORDER BY {half('weight', 6)} DESC, term) AS top_term FROM weighted GROUP BY {key}"""


def pair_views(source: str, key: str, a: str, b: str) -> str:
    """TF-IDF cosine of two texts per row, each pair being its own corpus."""
    return f"""ca AS ({counts_of(source, key, a)}), cb AS ({counts_of(source, key, b)}),
    both_ AS (SELECT {key}, term, coalesce(ca.tf, 0) AS ta, coalesce(cb.tf, 0) AS tb FROM ca FULL JOIN cb USING ({key}, term)),
    w AS (SELECT {key}, ta * idf AS wa, tb * idf AS wb FROM (
      SELECT *, ln(3e0 / (1e0 + (ta > 0)::INT + (tb > 0)::INT)) + 1e0 AS idf FROM both_)),
    sims AS (SELECT {key}, coalesce({half('sum(wa * wb) / nullif(sqrt(sum(wa * wa)) * sqrt(sum(wb * wb)), 0)', 6)}, 0e0) AS similarity
      FROM w GROUP BY {key})"""


def unit_weights(name: str, counts: str, key: str) -> str:
    return f"""{name} AS (SELECT {key}, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})) AS weight
      FROM (SELECT {key}, term, (1e0 + ln(tf)) * idf AS raw FROM {counts} JOIN vocab USING (term)))"""


ASKED_NEIGHBOURS = f"""SELECT vec_id, rank, neighbour_id, s FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour_id)::INT AS rank FROM (
    SELECT a.vec_id, b.vec_id AS neighbour_id, {half('list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])', 6)} AS s
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0))
  WHERE rank <= 5"""

# Requests in the parts in which they arrive, and those that the watermark of the parts before lets through.
ARRIVALS = """, spans AS (SELECT min(epoch_us(ts)) AS oldest, max(epoch_us(ts)) AS latest, max(ts) AS newest FROM events),
  placed AS (SELECT event_id, ts, (epoch_us(ts) - oldest) // ((latest - oldest) // 4 + 1) AS part FROM events, spans),
  arrivals AS (SELECT event_id, ts, part + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS turn FROM placed
    UNION ALL SELECT event_id, ts, part + 1 FROM placed WHERE event_id % 7 = 0),
  marks AS (SELECT turn, date_trunc('millisecond', max(max(ts)) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) - INTERVAL 2 DAY AS mark
    FROM arrivals GROUP BY turn),
  accepted AS (SELECT DISTINCT event_id, ts FROM arrivals JOIN marks USING (turn) WHERE mark IS NULL OR ts > mark)"""


# --- classification metrics ---------------------------------------------------------------------------------

PER_CLASS = """
conf AS (SELECT truth, predicted, count(*) AS n FROM judged GROUP BY ALL),
classes AS (SELECT truth AS class FROM conf UNION SELECT predicted FROM conf),
scores AS (SELECT class, support, hits_, CASE WHEN guesses > 0 THEN hits_::DOUBLE / guesses ELSE 0e0 END AS precision,
    CASE WHEN support > 0 THEN hits_::DOUBLE / support ELSE 0e0 END AS recall,
    CASE WHEN support + guesses > 0 THEN 2e0 * hits_ / (support + guesses) ELSE 0e0 END AS f1
  FROM (SELECT class,
      (SELECT coalesce(sum(n), 0) FROM conf WHERE truth = class)::BIGINT AS support,
      (SELECT coalesce(sum(n), 0) FROM conf WHERE predicted = class)::BIGINT AS guesses,
      (SELECT coalesce(sum(n), 0) FROM conf WHERE predicted = class AND truth = class)::BIGINT AS hits_
    FROM classes))"""

OVERALL = "sum(support)::BIGINT AS rows, " + half("sum(hits_)::DOUBLE / sum(support)", 4) + " AS accuracy, " + ", ".join(
    [f"{half(f'avg({k})', 4)} AS macro_{k}" for k in ("precision", "recall", "f1")]
    + [f"{half(f'sum({k} * support) / sum(support)', 4)} AS weighted_{k}" for k in ("precision", "recall", "f1")]
)


def rules_predicted(source: str, text: str, threshold: float = 0.30) -> str:
    rules = K.RULE_CLASSIFIER_PATTERNS
    cols = ", ".join(f"{hits(text, p, 'i')} AS r{i}" for i, p in enumerate(rules.values()))
    every = [f"r{i}" for i in range(len(rules))]
    whens = " ".join(f"WHEN r{i} = rtop THEN {q(n)}" for i, n in enumerate(rules))
    return f"""SELECT *, CASE WHEN rconf < {num(threshold)} THEN {q(OTHER)} ELSE raw_intent END AS predicted_intent,
      rconf < {num(threshold)} AS rule_uncertain FROM (
    SELECT *, CASE WHEN rsum = 0 THEN {q(OTHER)} {whens} END AS raw_intent,
      CASE WHEN rsum = 0 THEN 1e0 WHEN rtop = 1 THEN 0.5e0 ELSE {half('rtop::DOUBLE / rsum', 4)} END AS rconf FROM (
    SELECT *, greatest({', '.join(every)}) AS rtop, {' + '.join(every)} AS rsum FROM (
    SELECT *, {cols} FROM {source})))"""


def majority_predicted(train: str, asked: str) -> str:
    return f"""SELECT a.*, m.label AS predicted_intent, m.share FROM {asked} a, (
      SELECT true_intent AS label, n::DOUBLE / sum(n) OVER () AS share FROM (
        SELECT true_intent, count(*) AS n FROM {train} GROUP BY 1) ORDER BY n DESC, true_intent LIMIT 1) m"""


MESSAGE_SPLIT = f", parted AS ({split_of('predicted', 'message_id')})"
RULES_JUDGED = f""", ruled AS ({rules_predicted('messages', 'message')}),
judged AS (SELECT true_intent AS truth, predicted_intent AS predicted FROM ruled),""" + PER_CLASS


def comparison() -> str:
    def scored(model: str, split: str, rows: str) -> str:
        return (f"SELECT '{model}' AS model, '{split}' AS split, o.* FROM (WITH judged AS ({rows}), {PER_CLASS} "
                f"SELECT {OVERALL} FROM scores) o")

    parts = []
    for split in ("val", "test"):
        asked = f"(SELECT * FROM parted WHERE split = '{split}')"
        train = "(SELECT * FROM parted WHERE split = 'train')"
        majority = majority_predicted(train, asked)
        parts += [
            scored("majority", split, f"SELECT true_intent AS truth, predicted_intent AS predicted FROM ({majority})"),
            scored("rules", split, f"SELECT true_intent AS truth, predicted_intent AS predicted FROM ({rules_predicted(asked, 'message')})"),
            scored("labeller", split, f"SELECT true_intent AS truth, intent AS predicted FROM {asked}"),
        ]
    return " UNION ALL ".join(parts)


def learned(label: str) -> str:
    """The most frequent ``label`` of each phrase in training: what a model of the words must find.

    The phrases differ in many words and twelve of thirteen messages of a phrase have one label, so
    every trained model is far from a tie.
    """
    return f"""learned AS (SELECT i, label FROM (SELECT message_id % 20 AS i, {label} AS label,
      row_number() OVER (PARTITION BY message_id % 20 ORDER BY count(*) DESC, {label}) AS k
      FROM parted WHERE split = 'train' GROUP BY 1, 2) WHERE k = 1)"""


def learned_rows(split: str, label: str) -> str:
    return f"""SELECT p.{label} AS truth, l.label AS predicted FROM parted p
      JOIN learned l ON l.i = p.message_id % 20 WHERE p.split = '{split}'"""


def fitted_metrics() -> str:
    return f", judged AS ({learned_rows('test', 'intent')}), {PER_CLASS}"


def trained() -> str:
    """The old models as in :func:`comparison`, the trained ones by what they must learn."""
    parts = ["SELECT * FROM comparison WHERE model IN ('majority', 'rules')"]
    for split in ("val", "test"):
        one = f"(WITH judged AS ({learned_rows(split, 'true_intent')}), {PER_CLASS} SELECT {OVERALL} FROM scores)"
        parts.append(f"SELECT unnest(['centroid', 'tfidf_logistic', 'lsa_logistic']) AS model, '{split}' AS split, o.* FROM {one} o")
    return ", trained AS (" + " UNION ALL ".join(parts) + ")"


COMPARISON = MESSAGE_SPLIT + f", comparison AS ({comparison()})"

CENTROIDS = f"""
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u
  FROM embeddings),
parts AS (SELECT label, generate_subscripts(u, 1) AS pos, unnest(u) AS x FROM v),
means AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM parts GROUP BY ALL) GROUP BY label),
sims AS (SELECT vec_id, v.label AS truth, means.label::VARCHAR AS class,
    {half('list_cosine_similarity(u, c)', 6)} AS s FROM v, means),
best AS (SELECT vec_id, truth, first(class ORDER BY s DESC, class) AS raw_intent, max(s) AS s FROM sims GROUP BY ALL)"""

NEIGHBOURS = f"""
pairs AS (SELECT a.vec_id, b.vec_id AS neighbour_id, a.label AS true_intent, b.label AS intent,
    {half('list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])', 6)} AS s
  FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour_id) AS rank FROM pairs) WHERE rank <= 5),
judged AS (SELECT vec_id, true_intent, min(rank) FILTER (intent = true_intent) AS first_hit FROM near GROUP BY ALL),
marked AS (SELECT *, coalesce(first_hit <= 1, false) AS hit_1, coalesce(first_hit <= 3, false) AS hit_3,
    coalesce(first_hit <= 5, false) AS hit_5 FROM judged)"""

# --- policy -----------------------------------------------------------------------------------------------------

SHORT = "length(trim(regexp_replace(regexp_replace(message, 'https?://\\S+', '', 'g'), '@\\w+', '', 'g'))) < 5"
ACTION = any_of("message", K.UNAVAILABLE_ACTION_PATTERNS, "i")
PHRASE_RULE = any_of("message", K.AMBIGUOUS_PATTERNS, "i")
CONFLICT = "(len(cases) >= 3 AND NOT list_contains(list_transform(cases[1:3], lambda c: c.intent), intent))"
TOP = "coalesce(cases[1].similarity_score, 0e0)"

DECIDED = f""", decided AS (SELECT *, rule_id <> 'NONE' AS escalate, CASE rule_id
    WHEN 'ACTION' THEN {q(K.REASON_ACTION)} WHEN 'TOO_SHORT' THEN {q(K.REASON_AMBIGUOUS)}
    WHEN 'AMBIGUOUS' THEN {q(K.REASON_AMBIGUOUS)} WHEN 'TAXONOMY' THEN {q(K.REASON_TAXONOMY)}
    WHEN 'CONFIDENCE' THEN printf({q(K.REASON_CONFIDENCE)}, confidence, 0.45e0)
    WHEN 'NO_CASES' THEN {q(K.REASON_NO_CASES)}
    WHEN 'SIMILARITY' THEN printf({q(K.REASON_SIMILARITY)}, {TOP}, 0.40e0)
    WHEN 'CONFLICT' THEN {q(K.REASON_CONFLICT)} ELSE '' END AS escalation_reason FROM (
  SELECT *, CASE WHEN {ACTION} THEN 'ACTION' WHEN {SHORT} THEN 'TOO_SHORT' WHEN {PHRASE_RULE} THEN 'AMBIGUOUS'
    WHEN intent = {q(OTHER)} OR is_uncertain THEN 'TAXONOMY' WHEN confidence < 0.45e0 THEN 'CONFIDENCE'
    WHEN len(cases) = 0 THEN 'NO_CASES' WHEN {TOP} < 0.40e0 THEN 'SIMILARITY' WHEN {CONFLICT} THEN 'CONFLICT'
    ELSE 'NONE' END AS rule_id FROM predicted))"""

HUMAN = f"(true_intent = {q(OTHER)} OR confidence < 0.3e0)"


def rate(part: str, whole: str = "n_total", n: int = 4) -> str:
    return f"CASE WHEN {whole} > 0 THEN {half(f'({part})::DOUBLE / {whole}', n)} ELSE 0e0 END"


POLICY_COUNTS = f"""SELECT count(*) AS n_total, count(*) FILTER (NOT escalate) AS n_auto, count(*) FILTER (escalate) AS n_escalated,
    count(*) FILTER {'(' + HUMAN + ')'} AS n_needs_human, count(*) FILTER (NOT escalate AND {HUMAN}) AS n_false_auto,
    count(*) FILTER (escalate AND NOT {HUMAN}) AS n_false_escalation,
    count(*) FILTER (NOT escalate AND intent = true_intent) AS n_right FROM decided"""

# --- drafting -----------------------------------------------------------------------------------------------------


def drafted(source: str) -> str:
    """Rows with handle, evidence text, cleaned reply and draft."""
    return f"""SELECT *, CASE WHEN length(cl) > 10 THEN CASE WHEN handle <> '' AND NOT starts_with(cl, handle)
        THEN handle || ' ' || cl ELSE cl END ELSE trim(handle || ' ' || {q(K.APOLOGY_REPLY)}) END AS draft FROM (
      SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(ev, '^\\s*@\\d+\\s*', ''), '^\\s*@[A-Za-z0-9_]+\\s*', ''),
        'https?://\\S+', '', 'g')) AS cl FROM (
      SELECT *, trim(regexp_extract(coalesce(cases[1].reply, ''), '^([^\\n"]+)', 1)) AS ev,
        regexp_extract(regexp_extract(message, '^([^\\n"]+)', 1), '(@\\d+|@[A-Za-z0-9_]+)', 1) AS handle FROM {source}))"""


HISTORY = """, storied AS (SELECT * REPLACE (cases[1:(message_id % 4)] AS cases),
    [{'inbound': true, 'text': message}, {'inbound': false, 'text': true_reply}, {'inbound': true, 'text': message},
     {'inbound': false, 'text': true_reply}, {'inbound': true, 'text': message}, {'inbound': false, 'text': true_reply}]
     [1:(message_id % 4) * 2] AS history FROM predicted)"""


def cut(x: str, cuts: list[tuple[float, int]]) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {num(c)} THEN {s}" for c, s in cuts) + " ELSE 1 END"


KEYWORDS = " ".join(
    f"WHEN {q(n)} THEN ({' + '.join(f'contains(lower(draft), {q(w)})::INT' for w in ws)})::DOUBLE / {len(ws)}"
    for n, ws in K.REPLY_KEYWORDS.items()
)
MARKS = " + ".join(f"contains(lower(draft), {q(m)})::INT" for m in K.POSITIVE_MARKERS)
RUDE = " OR ".join(f"contains(lower(draft), {q(m)})" for m in K.AGGRESSIVE_MARKERS)


def tone_of(draft: str) -> str:
    marks, rude = MARKS.replace("draft", draft), RUDE.replace("draft", draft)
    words = f"len(list_filter(regexp_split_to_array({draft}, '\\s+'), lambda w: w <> ''))"
    return (f"CASE WHEN {draft} = '' THEN 1 WHEN {rude} THEN 1 WHEN ({marks}) >= 3 THEN 5 WHEN ({marks}) = 2 THEN 4 "
            f"WHEN ({marks}) = 1 THEN 3 WHEN {words} >= 10 THEN 2 ELSE 1 END")


def claims_of(text: str) -> str:
    found = ", ".join(f"regexp_extract({text}, {q('(' + p + ')')}, 1, 'i')" for p in K.UNSUPPORTED_CLAIM_PATTERNS)
    return f"list_filter([{found}], lambda m: m <> '')"


def named_pairs(source: str, key: str, a: str, b: str, prefix: str) -> str:
    views = pair_views(source, key, a, b)
    for name in ("ca", "cb", "both_", "w", "sims"):
        views = _rename(views, name, f"{prefix}_{name}")
    return views


def _rename(sql: str, old: str, new: str) -> str:
    return re.sub(rf"(?<![A-Za-z0-9_]){old}(?![A-Za-z0-9_])", new, sql)


def scored_views(source: str) -> str:
    """``scored`` from rows with draft, ev, message, intent, true_reply and message_id."""
    return f""", {named_pairs(source, 'message_id', 'draft', 'ev', 'e')},
    {named_pairs(source, 'message_id', 'draft', 'message', 'm')},
    {named_pairs(source, 'message_id', 'draft', 'true_reply', 't')},
    scored AS (SELECT *, groundedness + relevance + tone AS base, greatest(1, least(5, (groundedness + relevance + tone) // 3)) AS helpfulness,
      {half('(groundedness + relevance + tone + correctness + greatest(1, least(5, (groundedness + relevance + tone) // 3))) / 5e0', 2)} AS overall
    FROM (SELECT d.*, CASE WHEN draft = '' THEN 1 WHEN ev = '' THEN 2 ELSE {cut('coalesce(e_sims.similarity, 0e0)', K.GROUNDEDNESS_CUTS)} END AS groundedness,
      CASE WHEN draft = '' THEN 1 ELSE {cut(half(f"0.5e0 * (CASE intent {KEYWORDS} ELSE 0e0 END) + 0.5e0 * coalesce(m_sims.similarity, 0e0)", 6), K.RELEVANCE_CUTS)} END AS relevance,
      {tone_of('draft')} AS tone,
      CASE WHEN draft = '' THEN 1 ELSE least(5, greatest(1, floor(coalesce(t_sims.similarity, 0e0) * 10)::INT + 1)) END AS correctness,
      {claims_of('draft')} AS claims
    FROM {source} d LEFT JOIN e_sims USING (message_id) LEFT JOIN m_sims USING (message_id) LEFT JOIN t_sims USING (message_id)))"""


def summary(auto: str, names: tuple[str, ...], default: str = "") -> str:
    wrap = (lambda x: f"coalesce({x}, {default})") if default else (lambda x: x)
    return ", ".join(f"{half(wrap(f'avg({s}) FILTER ({auto})'), 3)} AS avg_{s}" for s in names)


SCORES = ("groundedness", "relevance", "tone", "correctness", "helpfulness", "overall")
DRAFTED = f", drafts AS ({drafted('decided')})"
FINAL = DECIDED + DRAFTED


# A message's draft depends on it and its cases only, so each setting is the same drafting over
# changed cases.
def ablation_views() -> str:
    none = "[]::STRUCT(rank INTEGER, similarity_score DOUBLE, message VARCHAR, reply VARCHAR, intent VARCHAR, id VARCHAR)[]"
    parts = []
    for setting, source in (
        ("a", f"(SELECT * REPLACE ({none} AS cases) FROM predicted)"),
        ("b", "predicted"),
    ):
        body = f", d_{setting} AS (SELECT *, false AS escalate FROM ({drafted(source)}))" + scored_views(f"d_{setting}")
        for name in [f"{p}_{n}" for p in "emt" for n in ("ca", "cb", "both_", "w", "sims")] + ["scored"]:
            body = _rename(body, name, f"{setting}_{name}")
        parts.append(body)
    body = ", d_c AS (SELECT *  REPLACE (CASE WHEN escalate THEN '' ELSE draft END AS draft) FROM drafts)" + scored_views("d_c")
    for name in [f"{p}_{n}" for p in "emt" for n in ("ca", "cb", "both_", "w", "sims")] + ["scored"]:
        body = _rename(body, name, f"c_{name}")
    parts.append(body)
    every = " UNION ALL ".join(
        f"SELECT '{s.upper()}' AS setting, escalate, {', '.join(SCORES)}, len(claims) > 0 AS claims_any FROM {s}_scored" for s in "abc"
    )
    names = ("groundedness", "relevance", "tone", "correctness", "overall")
    return FINAL + "".join(parts) + f""", settings AS ({every}),
    ablated AS (SELECT setting, count(*) AS n_total, count(*) FILTER (NOT escalate) AS n_auto, count(*) FILTER (escalate) AS n_escalated,
      {rate('count(*) FILTER (NOT escalate)', 'count(*)')} AS auto_rate, {summary('NOT escalate', names, '0e0')},
      {rate('count(*) FILTER (NOT escalate AND claims_any)', 'count(*) FILTER (NOT escalate)')} AS unsupported_claim_rate
    FROM settings GROUP BY setting)"""


def grid_sql(grid) -> str:
    pairs = [(c, s) for c in grid[0] for s in grid[1]]
    rows = ", ".join(f"({num(c)}, {num(s)}, {num(round(c, 2))}, {num(round(s, 2))})" for c, s in pairs)
    return f"(VALUES {rows}) AS g(c, s, conf_threshold, sim_threshold)"


VALIDATION = f""", cells AS (SELECT conf_threshold, sim_threshold, count(*) AS n_total,
    count(*) FILTER (auto) AS n_auto, count(*) FILTER (auto AND human) AS n_false_auto,
    count(*) FILTER (NOT auto AND NOT human) AS n_false_escalation
  FROM (SELECT *, {HUMAN} AS human, NOT {HUMAN} AND confidence >= c AND top_similarity >= s AS auto
        FROM predicted, {grid_sql(VALIDATION_GRID)}) GROUP BY ALL),
validation AS (SELECT conf_threshold, sim_threshold, {rate('n_auto')} AS auto_rate, {rate('n_total - n_auto')} AS escalation_rate,
    {rate('n_false_auto')} AS false_auto_rate, {rate('n_false_escalation')} AS false_escalation_rate, n_false_auto, n_false_escalation FROM cells)"""

SHAPE = [("tweet_id", "string"), ("author_id", "string"), ("inbound", "boolean"), ("created_at", "string"), ("text", "string"),
         ("response_tweet_id", "string"), ("in_response_to_tweet_id", "string")]
NAMES = [n for n, _ in SHAPE]


def lengths_sql(source: str) -> str:
    n = "length(coalesce(text, ''))"
    return f"""SELECT min({n})::INT AS min_length, max({n})::INT AS max_length, {half(f'sum({n})::DOUBLE / count(*)', 2)} AS mean_length,
      median({n})::DOUBLE AS median_length, count(*) FILTER ({n} < 10) AS short_texts, count(*) FILTER ({n} > 280) AS long_texts FROM {source}"""


BRANDS = f""", vocab AS (SELECT brand, count(DISTINCT word) AS vocab_size FROM (
    SELECT brand, unnest(regexp_split_to_array(lower(customer_message), '\\s+')) AS word FROM convs) WHERE word <> '' GROUP BY 1),
counted AS (SELECT brand, count(*) AS total_conversations, sum(turns)::BIGINT AS total_turns,
    count(*) FILTER (turns >= 3) AS multi_turn_convs, count(*) FILTER (resolution_available) AS resolutions_count FROM convs GROUP BY 1),
rated AS (SELECT brand, total_conversations, multi_turn_convs, {half('multi_turn_convs::DOUBLE / total_conversations * 100', 1)} AS multi_turn_pct,
    {half('total_turns::DOUBLE / total_conversations', 2)} AS avg_turns, resolutions_count,
    {half('resolutions_count::DOUBLE / total_conversations * 100', 1)} AS res_pct, coalesce(vocab_size, 0) AS vocab_size
  FROM counted LEFT JOIN vocab USING (brand) WHERE total_conversations >= {SMALL_BRANDS}),
scaled AS (SELECT *, total_conversations::DOUBLE / nullif(max(total_conversations) OVER (), 0) AS score_vol,
    multi_turn_convs::DOUBLE / nullif(max(multi_turn_convs) OVER (), 0) AS score_multi,
    vocab_size::DOUBLE / nullif(max(vocab_size) OVER (), 0) AS score_vocab, res_pct / nullif(max(res_pct) OVER (), 0) AS score_res FROM rated),
weighed AS (SELECT *, 0.4e0 * score_vol + 0.3e0 * score_multi + 0.2e0 * score_vocab + 0.1e0 * score_res AS composite FROM scaled)"""

TAXONOMY_ROWS = ", ".join(
    f"({i}, {q(n)}, {q(K.INTENT_TEXTS[n][0])}, {q(K.INTENT_TEXTS[n][1])}, {q(K.INTENT_TEXTS[n][2])})"
    for i, n in enumerate([*K.INTENT_PATTERNS, OTHER])
)
# What the preparation has written, by its number of rows.
PREPARED = " UNION ALL ".join(
    f"SELECT '{name}' AS artifact, n AS rows, n > 0 AS ok FROM ({sql}) t(n)" for name, sql in {
        "conversations": "SELECT count(*) FROM convs",
        "history": "SELECT count(DISTINCT conversation_id) FROM turns_",
        "splits": "SELECT count(*) FROM convs WHERE brand = (SELECT brand FROM weighed ORDER BY composite DESC NULLS LAST, brand LIMIT 1)",
        "taxonomy": "SELECT 1::BIGINT",  # one JSON document
        "profile": "SELECT 7::BIGINT",
        "brand_ranking": "SELECT least(count(*), 10) FROM rated",
    }.items()
)
TAXONOMY = f"(VALUES {TAXONOMY_ROWS}) AS t(intent_order, name, description, inclusion_criteria, exclusion_criteria)"
EXAMPLES = """, examples AS (SELECT intent, message_id, message, rank FROM (
    SELECT intent, message_id, message, row_number() OVER (PARTITION BY intent ORDER BY message_id) AS rank FROM messages
    WHERE len(list_filter(regexp_split_to_array(message, '\\s+'), lambda w: w <> '')) >= 4) WHERE rank <= 5)"""

CHECKS = [
    ("Supported Intent Taxonomy", f"intent <> {q(OTHER)}", "'Intent ''' || intent || ''' is recognized.'",
     "'Intent is unknown / outside taxonomy.'"),
    ("Intent Confidence (>= 45%)", "confidence >= 0.45e0",
     *["'Model confidence is ' || printf('%.1f', confidence * 100) || '% (threshold: 45%).'"] * 2),
    ("Historical Grounding (>= 40% sim)", f"{TOP} >= 0.4e0 AND len(cases) > 0",
     *[f"'Top similarity is ' || printf('%.1f', {TOP} * 100) || '% (threshold: 40%).'"] * 2),
    ("Permitted Action Scope", f"NOT {ACTION}", "'Permitted within autonomous response bounds.'",
     "'Requires human-only action (financial refund, account deletion, or fraud/legal).'"),
    ("Query Clarity & Specificity", f"NOT ({SHORT} OR {PHRASE_RULE})", "'Query is sufficiently specific.'",
     "'Query is ambiguous or lacks necessary context.'"),
    ("Consistent Historical Guidance", f"NOT {CONFLICT}", "'Historical evidence aligns with predicted intent.'",
     "'Historical evidence shows conflicting intents.'"),
]

PROMPT_SQL = f"""{q(PROMPT_HEAD)} || message || '"' || chr(10) || chr(10) || 'Predicted Intent: `' || intent || '`' || chr(10)
  || 'Intent Confidence: ' || printf('%.4f', confidence) || chr(10) || chr(10) || 'Conversation History (most recent):' || chr(10)
  || CASE WHEN len(history) = 0 THEN {q(NO_HISTORY)} ELSE array_to_string(list_transform(history[greatest(len(history) - 3, 1):],
       lambda t: '  [' || CASE WHEN t.inbound THEN 'Customer' ELSE 'AmazonHelp' END || ']: ' || t.text), chr(10)) END
  || {q(PROMPT_CASES.format(brand='AmazonHelp'))}
  || CASE WHEN len(cases) = 0 THEN {q(NO_CASES)} ELSE array_to_string(list_transform(cases, lambda c:
       '  Case ' || c.rank || ' [Similarity: ' || printf('%.4f', c.similarity_score) || ', Intent: ' || c.intent || ']' || chr(10)
       || '    Customer: "' || c.message || '"' || chr(10) || '    Historical Response: "' || c.reply || '"'), chr(10)) END
  || {q(PROMPT_TASK)}"""
BARE_SQL = f"""'Customer Message: "' || message || '"' || chr(10) || 'Predicted Intent: `' || intent || '`' || chr(10)
  || 'Intent Confidence: ' || printf('%.4f', confidence) || chr(10) || chr(10) || {q(PROMPT_TASK_NO_CASES)}"""

TARGETS = "(VALUES " + ", ".join(f"({q(m)}, {q(d)}, {num(t)})" for m, d, t in K.METRIC_TARGETS) + ") AS t(metric, direction, target)"

ORACLES = {
    "profile_shape": tweets("SELECT n AS rows, position::INT AS position, \"column\", type FROM (SELECT count(*) AS n FROM tweets), (VALUES "
        + ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(SHAPE, 1)) + ") AS s(position, \"column\", type)"),
    "profile_missing": tweets(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing, {half(f'count(*) FILTER ({c} IS NULL) * 100e0 / count(*)', 2)} AS missing_pct FROM tweets"
        for c in NAMES)),
    "profile_duplicates": tweets("""SELECT ((SELECT count(*) FROM tweets) - (SELECT count(*) FROM (SELECT DISTINCT * FROM tweets))) AS exact_duplicates,
        ((SELECT count(*) FROM tweets) - (SELECT count(*) FROM (SELECT DISTINCT tweet_id FROM tweets))) AS duplicate_tweet_ids"""),
    "profile_directions": tweets(f"""SELECT *, {half('customer_tweets * 100e0 / rows', 2)} AS customer_pct, {half('brand_tweets * 100e0 / rows', 2)} AS brand_pct
        FROM (SELECT count(*) AS rows, count(*) FILTER (inbound) AS customer_tweets, count(*) FILTER (NOT inbound) AS brand_tweets FROM tweets)"""),
    "profile_top_brand_authors": tweets("SELECT author_id, count(*) AS tweets FROM tweets WHERE NOT inbound GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
    "profile_authors": tweets("SELECT count(DISTINCT author_id) AS unique_authors, count(DISTINCT author_id) FILTER (NOT inbound) AS unique_brands FROM tweets"),
    "profile_authors_compat": tweets("""SELECT (SELECT count(DISTINCT author_id) FROM tweets) AS unique_authors,
        (SELECT count(DISTINCT n) FROM (SELECT count(*) AS n FROM tweets WHERE NOT inbound GROUP BY author_id)) AS unique_brands"""),
    "profile_text_lengths": tweets(lengths_sql("tweets")),
    "profile_document_lengths": lengths_sql("documents"),
    "profile_date_range": tweets(f"""SELECT min({epoch('created_at')}) AS first_epoch, max({epoch('created_at')}) AS last_epoch,
        count(*) FILTER ({epoch('created_at')} IS NULL) AS unreadable FROM tweets"""),
    "profile_links": tweets("SELECT count(in_response_to_tweet_id) AS with_parent, count(response_tweet_id) AS with_replies FROM tweets"),
    "clean_rows": tweets("SELECT * FROM cleaned"),
    "clean_counts": tweets(f"""SELECT sum(n)::BIGINT AS rows_in, sum(n - 1)::BIGINT AS dropped_duplicates,
        count(*) FILTER (tweet_id IS NULL OR author_id IS NULL) AS dropped_missing_keys,
        count(*) FILTER (tweet_id IS NOT NULL AND author_id IS NOT NULL AND {clean('text')} = '') AS dropped_empty_text,
        count(*) FILTER (tweet_id IS NOT NULL AND author_id IS NOT NULL AND {clean('text')} <> '') AS rows_out
        FROM (SELECT *, count(*) AS n FROM tweets GROUP BY ALL)"""),
    "clean_document_text": f"SELECT doc_id, length({clean('text')}) AS clean_length, md5({clean('text')}) AS clean_md5 FROM documents",
    "conv_roots": threads("SELECT tweet_id FROM roots"),
    "conv_edges": threads("SELECT parent, child, position::INT AS position, count(*) OVER (PARTITION BY parent) AS siblings FROM edges"),
    "conv_labels": threads("SELECT tweet_id, conversation_id, depth::BIGINT AS depth FROM turns_"),
    "conv_positions": threads("SELECT conversation_id, position, tweet_id, inbound FROM turns_"),
    "conv_records": threads("SELECT * FROM convs"),
    "conv_history": threads("""SELECT conversation_id, 0::INT AS page, count(*) AS turns,
        string_agg(tweet_id || '|' || author_id || '|' || text, ' ~ ' ORDER BY position) AS history FROM turns_ GROUP BY 1"""),
    "brand_counts": with_(THREADS + BRANDS, "SELECT * FROM counted", True),
    "brand_vocabulary": with_(THREADS + BRANDS, "SELECT * FROM vocab", True),
    "brand_ranking": with_(THREADS + BRANDS, f"""SELECT brand, total_conversations, multi_turn_convs, multi_turn_pct, avg_turns, resolutions_count, res_pct,
        vocab_size, {half('score_vol', 4)} AS score_vol, {half('score_multi', 4)} AS score_multi, {half('score_vocab', 4)} AS score_vocab,
        {half('score_res', 4)} AS score_res, {half('composite', 4)} AS composite_score,
        row_number() OVER (ORDER BY composite DESC NULLS LAST, brand)::INT AS rank FROM weighed ORDER BY rank LIMIT 10""", True),
    "brand_best_conversations": with_(THREADS + BRANDS, """SELECT conversation_id, brand, turns FROM convs
        WHERE brand = (SELECT brand FROM weighed ORDER BY composite DESC NULLS LAST, brand LIMIT 1)""", True),
    "intent_hits": messages(" UNION ALL ".join(
        f"SELECT message_id, {q(n)} AS intent, h{i} AS hits FROM messages WHERE h{i} > 0" for i, n in enumerate(K.INTENT_PATTERNS))),
    "intent_labels": messages("SELECT message_id, intent, intent_confidence FROM messages"),
    "intent_counts": messages("SELECT intent, count(*) AS sample_count FROM messages GROUP BY 1"),
    "intent_examples": messages("SELECT intent, message_id, message, rank::INT AS rank FROM examples", EXAMPLES),
    "intent_taxonomy": messages(f"""SELECT t.*, coalesce(n, 0) AS sample_count, coalesce(ex, '') AS representative_examples FROM {TAXONOMY}
        LEFT JOIN (SELECT intent AS name, count(*) AS n FROM messages GROUP BY 1) USING (name)
        LEFT JOIN (SELECT intent AS name, string_agg(message, ' ~ ' ORDER BY rank) AS ex FROM examples GROUP BY 1) USING (name)""", EXAMPLES),
    "intent_distribution": messages(f"""SELECT name, intent_order, coalesce(n, 0) AS sample_count,
        {half('coalesce(n, 0) * 100e0 / sum(coalesce(n, 0)) OVER ()', 2)} AS share_pct FROM {TAXONOMY}
        LEFT JOIN (SELECT intent AS name, count(*) AS n FROM messages GROUP BY 1) USING (name)"""),
    "intent_documents": f"SELECT doc_id, intent, intent_confidence FROM ({labelled('documents', 'text', LANGUAGE_RULES, True)})",
    "intent_conversations": threads(f"SELECT conversation_id, brand, intent, intent_confidence FROM ({labelled('convs', 'customer_message')})"),
    "split_random": f"SELECT doc_id, split FROM ({split_of('documents', 'doc_id')})",
    "split_sizes": f"SELECT split, count(*) AS rows FROM ({split_of('documents', 'doc_id')}) GROUP BY 1",
    "split_bucket": """SELECT CASE WHEN p < 7000 THEN 'train' WHEN p < 8500 THEN 'val' ELSE 'test' END AS split, count(*) AS rows
        FROM (SELECT CAST('0x' || substr(md5(doc_id || ':42'), 1, 8) AS BIGINT) % 10000 AS p FROM documents) GROUP BY 1""",
    "split_temporal": f"SELECT event_id, is_temporal_test FROM ({temporal_of('events', 'ts NULLS FIRST, event_id')})",
    "split_temporal_tweets": tweets(f"SELECT tweet_id, is_temporal_test FROM ({temporal_of('cleaned', epoch('created_at') + ' NULLS FIRST, tweet_id')})"),
    "leak_audit": f"WITH parted AS ({split_of('documents', 'doc_id')}) {audit('parted', ['doc_id', 'text', 'source'])}",
    "leak_audit_temporal": f"""WITH parted AS ({temporal_of('(' + split_of('events', 'event_id') + ')', 'ts NULLS FIRST, event_id')})
        {audit('parted', ['event_id', 'user_id'], True)}""",
    "leak_index": f"SELECT split, count(*) AS indexed FROM ({split_of('documents', 'doc_id')}) WHERE split = 'train' GROUP BY 1",
    "tfidf_vocabulary": f"WITH {tfidf_views('documents', 'doc_id', 'text', True, 35000)} SELECT term, df, total, {half('idf', 6)} AS idf FROM vocab",
    "tfidf_documents": f"WITH {tfidf_views('documents', 'doc_id', 'text', True, 35000)} {tfidf_per_document('doc_id', True)}",
    "tfidf_turns_plain": "WITH t AS (SELECT conv_id * 100 + turn AS turn_id, text FROM conversations), "
        + tfidf_views("t", "turn_id", "text", False, 30000) + tfidf_per_document("turn_id", False),
    "cosine_neighbour_turns": f"""WITH p AS (SELECT a.conv_id * 100 + a.turn AS turn_id, a.text AS a, b.text AS b FROM conversations a
        JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1), {pair_views('p', 'turn_id', 'a', 'b')}
        SELECT p.turn_id, similarity FROM p LEFT JOIN sims USING (turn_id)""",
    # A known text has a vector of length 1, whatever its direction.
    "lsa_embedding": f"""WITH d AS (SELECT doc_id::VARCHAR AS conversation_id, text, coalesce(lang, {q(OTHER)}) AS intent FROM documents
        WHERE trim(text) <> '' AND trim(source) <> ''), {tfidf_views('d', 'conversation_id', 'text', True, 35000)},
        known AS (SELECT conversation_id, count(*) AS n FROM counts JOIN vocab USING (term) GROUP BY 1)
        SELECT conversation_id, intent, coalesce(n, 0)::INT AS n_known_terms, CASE WHEN n > 0 THEN 1e0 ELSE 0e0 END AS length
        FROM d LEFT JOIN known USING (conversation_id)""",
    "dense_unit": f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, generate_subscripts(e, 1) - 1 AS pos,
        {half('unnest(e) / sqrt(list_inner_product(e, e))', 6)} AS value FROM v""",
    "cls_majority": messages(f"""SELECT message_id, predicted_intent, {half('share', 6)} AS confidence, false AS is_uncertain
        FROM ({majority_predicted("(SELECT * FROM parted WHERE split = 'train')", "(SELECT message_id FROM parted WHERE split = 'test')")})""", MESSAGE_SPLIT),
    "cls_rules": messages(f"SELECT message_id, predicted_intent, raw_intent, rconf AS confidence, rule_uncertain AS is_uncertain FROM ({rules_predicted('messages', 'message')})"),
    "cls_rules_uncertain": messages(f"SELECT message_id, predicted_intent, raw_intent, rconf AS confidence, rule_uncertain AS is_uncertain FROM ({rules_predicted('messages', 'message', 0.55)})"),
    "cls_rules_probabilities": messages(" UNION ALL ".join(
        [f"SELECT message_id, {q(n)} AS intent, {half(f'r{i}::DOUBLE / rsum', 4)} AS probability FROM ruled WHERE r{i} > 0" for i, n in enumerate(K.RULE_CLASSIFIER_PATTERNS)]
        + [f"SELECT message_id, {q(OTHER)}, 1e0 FROM ruled WHERE rsum = 0"]), f", ruled AS ({rules_predicted('messages', 'message')})"),
    "cls_centroid": f"""WITH {CENTROIDS} SELECT vec_id, CASE WHEN s < 0.35e0 THEN {q(OTHER)} ELSE raw_intent END AS predicted_intent, raw_intent,
        {half('s', 4)} AS confidence, s < 0.35e0 AS is_uncertain FROM best""",
    "cls_centroid_probabilities": f"""WITH {CENTROIDS} SELECT vec_id, class AS label, {half('e / sum(e) OVER (PARTITION BY vec_id)', 4)} AS probability
        FROM (SELECT *, exp((s - max(s) OVER (PARTITION BY vec_id)) * 5e0) AS e FROM sims)""",
    "metrics_overall": messages(f"SELECT {OVERALL} FROM scores", RULES_JUDGED),
    "metrics_per_class": messages(f"SELECT class, {half('precision', 4)} AS precision, {half('recall', 4)} AS recall, {half('f1', 4)} AS f1, support FROM scores", RULES_JUDGED),
    "metrics_quality_labels": f"WITH judged AS (SELECT quality::VARCHAR AS truth, (1 - toxic)::VARCHAR AS predicted FROM labels), {PER_CLASS} SELECT {OVERALL} FROM scores",
    "confusion_long": messages("SELECT * FROM conf", RULES_JUDGED),
    "confusion_wide": f"WITH {CENTROIDS} SELECT c::VARCHAR AS truth, " + ", ".join(
        f"count(*) FILTER (raw_intent = '{i}') AS p{i}" for i in range(10)) + " FROM range(10) r(c) LEFT JOIN best ON best.truth = c GROUP BY 1",
    "most_confused": messages("SELECT * FROM conf WHERE truth <> predicted ORDER BY n DESC, truth, predicted LIMIT 10", RULES_JUDGED),
    "model_comparison": messages("SELECT * FROM comparison", COMPARISON),
    "model_best": messages("SELECT * FROM comparison WHERE split = 'val' ORDER BY macro_f1 DESC, model LIMIT 1", COMPARISON),
    "model_improvements": messages(f"""SELECT b.model AS best_model, o.model AS baseline, {half('b.macro_f1 - o.macro_f1', 4)} AS absolute_gain,
        {half('(b.macro_f1 - o.macro_f1) * 100e0 / greatest(o.macro_f1, 1e-5)', 2)} AS relative_gain_pct
        FROM comparison b, comparison o WHERE b.split = 'test' AND o.split = 'test' AND o.model <> b.model
        AND b.model = (SELECT model FROM comparison WHERE split = 'val' ORDER BY macro_f1 DESC, model LIMIT 1)""", COMPARISON),
    "model_trained": messages("""SELECT *, model = (SELECT model FROM trained WHERE split = 'val' ORDER BY macro_f1 DESC, model LIMIT 1)
        AS chosen FROM trained""", COMPARISON + ", " + learned("true_intent") + trained()),
    "cls_stored": messages("""SELECT p.message_id, l.label AS predicted_intent, l.label AS raw_intent FROM parted p
        JOIN learned l ON l.i = p.message_id % 20 WHERE p.split = 'test'""", MESSAGE_SPLIT + ", " + learned("true_intent")),
    "cls_logistic": messages(f"SELECT {OVERALL} FROM scores", MESSAGE_SPLIT + ", " + learned("intent") + fitted_metrics()),
    "cls_lsa_logistic": messages(f"SELECT {OVERALL} FROM scores", MESSAGE_SPLIT + ", " + learned("intent") + fitted_metrics()),
    "plan_prepare": with_(THREADS + BRANDS, PREPARED, True),
    "plan_decide_rules": messages(f"""SELECT message_id, predicted_intent AS intent, rconf AS confidence, early_rule,
        CASE WHEN early_rule IS NOT NULL THEN 'ESCALATE' END AS early_decision,
        CASE WHEN early_rule IS NOT NULL THEN 'ESCALATED_PRE_GENERATION' END AS early_stage, true AS stopped_escalates,
        true AS draft_unless_stopped, true AS similarity_in_range FROM (
          SELECT *, CASE WHEN {ACTION} THEN 'ACTION' WHEN {SHORT} THEN 'TOO_SHORT' WHEN {PHRASE_RULE} THEN 'AMBIGUOUS'
            WHEN predicted_intent = {q(OTHER)} OR rule_uncertain THEN 'TAXONOMY' WHEN rconf < 0.45e0 THEN 'CONFIDENCE' END AS early_rule
          FROM ({rules_predicted('messages', 'message')}))"""),
    "dense_topk": f"WITH {NEIGHBOURS} SELECT vec_id, rank::INT AS rank, neighbour_id, {half('greatest(s, 0e0)', 4)} AS similarity_score FROM near",
    "stored_topk": f"SELECT vec_id, rank, neighbour_id, {half('greatest(s, 0e0)', 4)} AS similarity_score FROM ({ASKED_NEIGHBOURS})",
    "approx_recall": f"SELECT count(DISTINCT vec_id) AS queries, count(*) AS expected, true AS enough FROM ({ASKED_NEIGHBOURS})",
    "sparse_topk": f"""WITH counts AS ({counts_of('documents', 'doc_id', 'text', False)}), asked AS ({counts_of('benchmark', 'item_id', 'text', False)}),
        vocab AS (SELECT term, ln((1e0 + any_value(n)) / (1e0 + count(*))) + 1e0 AS idf FROM counts, (SELECT count(*) AS n FROM documents) GROUP BY term HAVING count(*) >= 2),
        {unit_weights('stored', 'counts', 'doc_id')}, {unit_weights('wanted', 'asked', 'item_id')}
        SELECT item_id, rank, doc_id, similarity FROM (
          SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id)::INT AS rank FROM (
            SELECT item_id, doc_id, {half('sum(s.weight * w.weight)', 6)} AS similarity FROM wanted w JOIN stored s USING (term) GROUP BY item_id, doc_id))
        WHERE rank <= 5""",
    "stream_escalations": messages("""SELECT strftime(date_trunc('day', a.ts), '%Y-%m-%d') AS day, rule_id, count(*) AS requests, count(*) FILTER (escalate) AS escalated
        FROM accepted a JOIN decided ON message_id = event_id, spans
        WHERE date_trunc('day', a.ts) + INTERVAL 1 DAY <= date_trunc('millisecond', newest) - INTERVAL 2 DAY GROUP BY ALL""", DECIDED + ARRIVALS),
    "source_csv_head": tweets("SELECT * REPLACE (text || chr(10) || '\"quoted\", line ' AS text) FROM tweets ORDER BY ALL NULLS FIRST LIMIT 500"),
    "retrieval_hits": f"WITH {NEIGHBOURS} SELECT vec_id, true_intent, coalesce(first_hit, 0)::INT AS first_hit, hit_1, hit_3, hit_5 FROM marked",
    "retrieval_metrics": f"WITH {NEIGHBOURS} SELECT count(*) AS queries, " + ", ".join(
        f"{half(f'avg(hit_{n}::INT)', 4)} AS recall_at_{n}" for n in (1, 3, 5)) + f", {half('avg(coalesce(1e0 / first_hit, 0e0))', 4)} AS mrr FROM marked",
    "retrieval_examples": f"""WITH {NEIGHBOURS} SELECT * FROM (SELECT vec_id, hit_1, coalesce(first_hit, 0)::INT AS first_hit,
        row_number() OVER (PARTITION BY hit_1 ORDER BY vec_id)::INT AS example FROM marked) WHERE example <= 5""",
    "retrieval_best_case": f"""WITH parted AS ({split_of('embeddings', 'vec_id')}) SELECT vec_id, case_id, {half('greatest(s, 0e0)', 4)} AS similarity_score, stored_label
        FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, case_id) AS k FROM (
          SELECT a.vec_id, b.vec_id AS case_id, b.label AS stored_label, {half('list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])', 6)} AS s
          FROM parted a, parted b WHERE a.split <> 'train' AND b.split = 'train')) WHERE k = 1""",
    "index_status": """SELECT count(*) AS index_size, coalesce(max(len(embedding)), 0)::INT AS dimension, 0.45e0 AS min_intent_confidence,
        0.4e0 AS min_retrieval_similarity FROM embeddings""",
    "policy_decisions": messages("SELECT message_id, rule_id, escalate, escalation_reason FROM decided", DECIDED),
    "policy_reason_counts": messages("SELECT escalation_reason AS reason, count(*) AS n FROM decided WHERE escalate GROUP BY 1", DECIDED),
    "policy_rule_shares": messages(f"""SELECT rule_id, n, {half('n * 100e0 / sum(n) OVER ()', 2)} AS share_pct
        FROM (SELECT rule_id, count(*) AS n FROM decided WHERE escalate GROUP BY 1)""", DECIDED),
    "policy_metrics": messages(f"""SELECT n_total, n_auto, n_escalated, n_needs_human, n_false_auto, n_false_escalation, {rate('n_auto')} AS coverage,
        {rate('n_escalated')} AS escalation_rate, {rate('n_false_auto')} AS false_auto_rate, {rate('n_false_escalation')} AS false_escalation_rate,
        {half('(n_auto - n_false_auto)::DOUBLE / greatest(n_auto, 1)', 4)} AS selective_accuracy_proxy,
        {rate('n_right', 'n_auto')} AS selective_accuracy_label FROM ({POLICY_COUNTS})""", DECIDED),
    "trust_checks": messages(" UNION ALL ".join(
        f"SELECT message_id, {q(n)} AS \"check\", ({c}) AS passed, CASE WHEN {c} THEN {good} ELSE {bad} END AS detail FROM predicted"
        for n, c, good, bad in CHECKS)),
    "decision_records": messages(f"""SELECT message_id, CASE WHEN escalate THEN 'ESCALATE' ELSE 'AUTO-HANDLE' END AS decision,
        CASE WHEN escalate THEN 'ESCALATED_PRE_GENERATION' ELSE 'AUTO_HANDLED' END AS pipeline_stage,
        CASE WHEN escalate THEN '' ELSE draft END AS draft_reply, CASE WHEN escalate THEN '' ELSE ev END AS evidence, escalation_reason,
        {half(TOP, 4)} AS top_similarity FROM drafts""", FINAL),
    "decision_responses": messages(f"""SELECT message_id, CASE WHEN escalate THEN 'ESCALATE' ELSE 'AUTO-HANDLE' END AS decision,
        CASE WHEN escalate THEN escalation_reason END AS escalation_reason, intent, {half('confidence', 4)} AS intent_confidence, {half(TOP, 4)} AS top_similarity,
        array_to_string(list_transform(cases, lambda c: c.id || '|' || c.message || '|' || c.reply || '|' || c.intent || '|' || c.rank || '|'
          || printf('%.4f', {half('c.similarity_score', 4)})), ' ~ ') AS retrieved_cases,
        ({' + '.join(f'({c})::INT' for _, c, _, _ in CHECKS)})::BIGINT AS passed_checks,
        CASE WHEN escalate THEN 'ESCALATED_PRE_GENERATION' ELSE 'AUTO_HANDLED' END AS pipeline_stage FROM decided""", DECIDED),
    "request_check": tweets("""SELECT tweet_id, CASE WHEN trim(text) = '' THEN text ELSE trim(text) END AS message,
        CASE WHEN trim(text) = '' THEN 'Message cannot be empty.' END AS error FROM tweets"""),
    "sweep_policy": messages(f"""SELECT conf_threshold, sim_threshold, n_auto, n_false_auto, {rate('n_auto')} AS auto_rate, {rate('n_false_auto')} AS false_auto_rate
        FROM (SELECT conf_threshold, sim_threshold, count(*) AS n_total, count(*) FILTER (auto) AS n_auto, count(*) FILTER (auto AND {HUMAN}) AS n_false_auto
          FROM (SELECT *, NOT blocked AND confidence >= c AND {TOP} >= s AS auto FROM (SELECT *, ({ACTION} OR {SHORT} OR {PHRASE_RULE}
            OR intent = {q(OTHER)} OR is_uncertain OR len(cases) = 0 OR {CONFLICT}) AS blocked FROM predicted), {grid_sql(K.POLICY_GRID)}) GROUP BY ALL)"""),
    "sweep_validation": messages("SELECT * FROM validation", VALIDATION),
    "sweep_safe_thresholds": messages("SELECT * FROM validation ORDER BY false_auto_rate, escalation_rate, conf_threshold, sim_threshold LIMIT 1", VALIDATION),
    "target_check": messages(f"""SELECT metric, value, direction, target, coalesce(CASE direction WHEN '>=' THEN value >= target ELSE value <= target END, false) AS met
        FROM {TARGETS} LEFT JOIN (SELECT 'macro_f1' AS metric, macro_f1 AS value FROM (SELECT {OVERALL} FROM scores)
          UNION ALL SELECT 'selective_accuracy', {rate('n_right', 'n_auto')} FROM ({POLICY_COUNTS})) USING (metric)""",
        DECIDED + ", judged AS (SELECT true_intent AS truth, intent AS predicted FROM decided)," + PER_CLASS),
    "draft_prompts": messages(f"""SELECT message_id, length(p) AS prompt_length, md5(p) AS prompt_md5, md5(b) AS bare_prompt_md5
        FROM (SELECT message_id, {PROMPT_SQL} AS p, {BARE_SQL} AS b FROM storied)""", HISTORY),
    "draft_replies": messages(f"SELECT message_id, handle, ev AS evidence, draft AS draft_reply FROM ({drafted('storied')})", HISTORY),
    "draft_overrides": messages("""SELECT message_id, CASE WHEN escalate OR message_id % 3 = 0 THEN '' ELSE true_reply END AS draft_reply,
        CASE WHEN message_id % 4 = 0 THEN 0.5e0 ELSE confidence END AS confidence, escalate OR message_id % 6 = 0 AS escalate,
        CASE WHEN escalate THEN escalation_reason WHEN message_id % 12 = 0 THEN 'needs a person'
          WHEN message_id % 6 = 0 THEN 'LLM determined escalation required.' ELSE '' END AS escalation_reason,
        CASE WHEN escalate THEN 'ESCALATED_PRE_GENERATION' WHEN message_id % 6 = 0 THEN 'ESCALATED_POST_GENERATION' ELSE 'AUTO_HANDLED' END AS pipeline_stage,
        CASE WHEN escalate OR message_id % 6 = 0 THEN 'ESCALATE' ELSE 'AUTO-HANDLE' END AS decision FROM decided""", DECIDED),
    "quality_scores": messages("SELECT message_id, " + ", ".join(f"{s}::DOUBLE AS {s}" for s in SCORES)
        + ", array_to_string(claims, ' ~ ') AS unsupported_claims, len(claims) > 0 AS has_unsupported_claim FROM scored",
        f", drafts AS ({drafted('predicted')})" + scored_views("drafts")),
    "quality_summary": messages(f"""SELECT count(*) FILTER (NOT escalate) AS replies, {summary('NOT escalate', SCORES)},
        {rate('count(*) FILTER (NOT escalate AND len(claims) > 0)', 'count(*) FILTER (NOT escalate)')} AS unsupported_claim_rate FROM scored""",
        FINAL + scored_views("drafts")),
    "quality_by_intent": messages(f"SELECT true_intent, {half('avg(overall)', 3)} AS avg_overall, count(*) AS replies FROM scored GROUP BY 1",
        f", drafts AS ({drafted('predicted')})" + scored_views("drafts")),
    "quality_turn_text": f"SELECT conv_id * 100 + turn AS turn_id, ({tone_of('text')})::BIGINT AS tone, md5(trim(text)) AS text_md5 FROM conversations",
    "unsupported_claims": tweets(f"""SELECT tweet_id, array_to_string(c, ' ~ ') AS claims, len(c) AS n_claims
        FROM (SELECT tweet_id, {claims_of('cleaned_text')} AS c FROM cleaned WHERE NOT inbound)"""),
    "ablation_metrics": messages("SELECT * FROM ablated", ablation_views()),
    "ablation_deltas": messages("SELECT * FROM (SELECT setting, lag(setting) OVER (ORDER BY setting) AS compared_with, " + ", ".join(
        f"{half(f'{c} - lag({c}) OVER (ORDER BY setting)', 4)} AS delta_{c}" for c in
        ("auto_rate", "avg_groundedness", "avg_relevance", "avg_overall", "unsupported_claim_rate")) + " FROM ablated) WHERE compared_with IS NOT NULL", ablation_views()),
    "source_csv": tweets("SELECT * REPLACE (text || chr(10) || '\"quoted\", line ' AS text) FROM tweets"),
    "source_json": threads(f"""SELECT conversation_id, root_tweet_id, brand, customer_id, timestamp, customer_message, brand_response, turns,
        resolution_available, intent, intent_confidence FROM ({labelled('convs', 'customer_message')})"""),
    "source_json_damaged": """SELECT count(*) AS n_rows, count(*) FILTER (doc_id % 10 = 3) AS n_without_id,
        count(*) FILTER (doc_id % 10 = 7) AS n_corrupt,
        CAST(coalesce(sum(length(text)) FILTER (doc_id % 10 <> 7), 0) AS BIGINT) AS n_chars FROM documents""",
    "index_cases": """SELECT CAST(doc_id AS VARCHAR) AS conversation_id,
        CAST(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS BIGINT) AS message_length,
        'reply ' || doc_id AS brand_response,
        CASE WHEN doc_id % 3 <> 0 THEN lang ELSE 'OTHER / UNKNOWN' END AS intent,
        'Brand: AmazonHelp | Turns: 2' AS context
        FROM documents WHERE doc_id % 7 <> 0 AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''""",
    "source_head": messages(f"SELECT message_id, message, intent FROM messages WHERE intent <> {q(OTHER)} ORDER BY message_id LIMIT 500"),
}
