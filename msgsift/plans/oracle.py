"""DuckDB SQL for each registered query (independent formulations).

Scores use the sparse Naive Bayes form (only non-zero token/class pairs plus
a per-document base term), so they cross-check the dense arrays used on
Spark. Ranks use plain ``row_number()``; Spark uses bucketed ranks.
"""

from __future__ import annotations

from ..functions.keys import sql_hash_key as hk
from ..operators.softmax import BITS, RATE, REG, STEPS

TOKENS = r"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
PY_WS = (r"[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
NA = ("'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', "
      "'<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'n/a', 'nan', 'null'")


MSG_ID = "coalesce(CAST(conv_id AS VARCHAR), '') || ':' || coalesce(CAST(turn AS VARCHAR), '')"


def toks(t: str) -> str:
    return TOKENS.format(t=t)


LAB = """lab AS (
  SELECT d.doc_id, d.text,
         d.lang || '_q' || CAST(l.quality AS VARCHAR) || '_t' || CAST(l.toxic AS VARCHAR) AS intent
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

LABTAB = """labtab AS (
  SELECT intent, CAST(row_number() OVER (ORDER BY intent) - 1 AS BIGINT) AS label
  FROM (SELECT DISTINCT intent FROM lab))"""

ULAB = """ulab AS (
  SELECT d.doc_id, d.text FROM documents d
  WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))"""

SPLIT = f"""cnt AS (SELECT intent, count(*) AS n_c FROM lab GROUP BY intent),
q0 AS (
  SELECT intent, n_c, sum(n_c) OVER () AS n,
         CAST(ceil(0.2::DOUBLE * CAST(sum(n_c) OVER () AS DOUBLE)) AS BIGINT) AS n_test
  FROM cnt WHERE n_c > 1),
q1 AS (
  SELECT intent, n_c, n, n - n_test AS n_train,
         (n_c * (n - n_test)) // n AS base, (n_c * (n - n_test)) % n AS rem FROM q0),
q2 AS (
  SELECT intent, base, n_train - sum(base) OVER () AS extra,
         row_number() OVER (ORDER BY rem DESC, intent) AS r FROM q1),
quota AS (
  SELECT intent, base + CASE WHEN r <= extra THEN 1 ELSE 0 END AS n_train_c FROM q2
  UNION ALL SELECT intent, n_c FROM cnt WHERE n_c = 1),
ranked AS (
  SELECT lab.*, row_number() OVER (PARTITION BY intent ORDER BY {hk(42, 'doc_id')}, doc_id) AS rk FROM lab),
split AS (
  SELECT r.doc_id, r.text, r.intent, t.label,
         CASE WHEN r.rk <= q.n_train_c THEN 'train' ELSE 'test' END AS part
  FROM ranked r JOIN quota q ON r.intent = q.intent JOIN labtab t ON r.intent = t.intent),
trn AS (SELECT * FROM split WHERE part = 'train'),
tst AS (SELECT * FROM split WHERE part = 'test')"""


def second_split(src: str, seed: int, p: str = "v") -> str:
    """The stratified split SQL again over ``src`` (doc_id, intent) with its own seed;
    defines ``{p}split(doc_id, intent, part)``."""
    return f"""{p}cnt AS (SELECT intent, count(*) AS n_c FROM {src} GROUP BY intent),
{p}q0 AS (
  SELECT intent, n_c, sum(n_c) OVER () AS n,
         CAST(ceil(0.2::DOUBLE * CAST(sum(n_c) OVER () AS DOUBLE)) AS BIGINT) AS n_test
  FROM {p}cnt WHERE n_c > 1),
{p}q1 AS (
  SELECT intent, n_c, n, n - n_test AS n_train,
         (n_c * (n - n_test)) // n AS base, (n_c * (n - n_test)) % n AS rem FROM {p}q0),
{p}q2 AS (
  SELECT intent, base, n_train - sum(base) OVER () AS extra,
         row_number() OVER (ORDER BY rem DESC, intent) AS r FROM {p}q1),
{p}quota AS (
  SELECT intent, base + CASE WHEN r <= extra THEN 1 ELSE 0 END AS n_train_c FROM {p}q2
  UNION ALL SELECT intent, n_c FROM {p}cnt WHERE n_c = 1),
{p}ranked AS (
  SELECT s.doc_id, s.intent,
         row_number() OVER (PARTITION BY s.intent ORDER BY {hk(seed, 's.doc_id')}, s.doc_id) AS rk FROM {src} s),
{p}split AS (
  SELECT r.doc_id, r.intent, CASE WHEN r.rk <= q.n_train_c THEN 'train' ELSE 'validation' END AS part
  FROM {p}ranked r JOIN {p}quota q ON r.intent = q.intent)"""


def vocab_cte(name: str, src: str) -> str:
    """Vocabulary over a ``(doc_id, token)`` relation ``src``."""
    return f"""{name}_pair AS (SELECT doc_id, token, count(*) AS tf FROM {src} GROUP BY doc_id, token),
{name}_stat AS (SELECT token, sum(tf) AS tf, count(*) AS df FROM {name}_pair GROUP BY token),
{name} AS (
  SELECT token, CAST(row_number() OVER (ORDER BY tf DESC, token) + 3 AS BIGINT) AS token_id,
         CAST(df AS BIGINT) AS df, CAST(tf AS BIGINT) AS tf
  FROM {name}_stat)"""


TTOK = f"ttok AS (SELECT doc_id, intent, unnest({toks('text')}) AS token FROM trn)"
ETOK = f"etok AS (SELECT doc_id, unnest({toks('text')}) AS token FROM tst)"


def nb_ctes(background: bool = False, score_src: str = "etok", key: str = "doc_id",
            keys_sql: str = "SELECT doc_id FROM tst") -> str:
    """Model + sparse scores ``scores(key, intent, score)`` over ``score_src(key, token)``."""
    parts = [TTOK]
    if background:
        parts += [ULAB, f"utok AS (SELECT doc_id, unnest({toks('text')}) AS token FROM ulab)",
                  "allt AS (SELECT doc_id, token FROM ttok UNION ALL SELECT doc_id, token FROM utok)",
                  vocab_cte("vocab", "allt")]
    else:
        parts += [vocab_cte("vocab", "ttok")]
    parts += [
        """cnt_tc AS (SELECT t.token, t.intent, count(*) AS n_tc FROM ttok t JOIN vocab v ON t.token = v.token
            GROUP BY t.token, t.intent)""",
        """ntot AS (SELECT c.intent, c.n_docs, coalesce(s.n, 0) AS n_tok
            FROM (SELECT intent, count(*) AS n_docs FROM trn GROUP BY intent) c
            LEFT JOIN (SELECT intent, sum(n_tc) AS n FROM cnt_tc GROUP BY intent) s ON c.intent = s.intent)""",
        "consts AS (SELECT (SELECT count(*) FROM vocab) AS v, (SELECT count(*) FROM trn) AS ntr)",
        f"""etf AS (SELECT e.{key}, e.token, count(*) AS tf FROM {score_src} e JOIN vocab v ON e.token = v.token
            GROUP BY e.{key}, e.token)""",
        f"em AS (SELECT {key}, sum(tf) AS m FROM etf GROUP BY {key})",
    ]
    if not background:
        parts += [
            f"""sparse AS (SELECT f.{key}, c.intent, sum(f.tf * ln(c.n_tc + 1)) AS s
                FROM etf f JOIN cnt_tc c ON f.token = c.token GROUP BY f.{key}, c.intent)""",
            f"""keys AS ({keys_sql})""",
            f"""scores AS (
              SELECT k.{key}, n.intent,
                     ln(CAST(n.n_docs AS DOUBLE) / (SELECT ntr FROM consts))
                     - coalesce(em.m, 0) * ln(n.n_tok + (SELECT v FROM consts)) + coalesce(sp.s, 0) AS score
              FROM keys k CROSS JOIN ntot n
              LEFT JOIN em ON em.{key} = k.{key}
              LEFT JOIN sparse sp ON sp.{key} = k.{key} AND sp.intent = n.intent)""",
        ]
    else:
        parts += [
            """bg AS (SELECT u.token, count(*) AS c FROM utok u JOIN vocab v ON u.token = v.token GROUP BY u.token)""",
            """pbg AS (SELECT v.token, (coalesce(bg.c, 0) + 1.0) /
                 ((SELECT sum(c) FROM bg) + (SELECT v FROM consts)) AS p
               FROM vocab v LEFT JOIN bg ON v.token = bg.token)""",
            f"""base AS (SELECT f.{key}, sum(f.tf * ln(1000.0 * p.p)) AS b
                FROM etf f JOIN pbg p ON f.token = p.token GROUP BY f.{key})""",
            f"""sparse AS (SELECT f.{key}, c.intent,
                   sum(f.tf * ln((c.n_tc + 1000.0 * p.p) / (1000.0 * p.p))) AS s
                FROM etf f JOIN cnt_tc c ON f.token = c.token JOIN pbg p ON f.token = p.token
                GROUP BY f.{key}, c.intent)""",
            f"""keys AS ({keys_sql})""",
            f"""scores AS (
              SELECT k.{key}, n.intent,
                     ln(CAST(n.n_docs AS DOUBLE) / (SELECT ntr FROM consts)) + coalesce(b.b, 0)
                     - coalesce(em.m, 0) * ln(n.n_tok + 1000.0) + coalesce(sp.s, 0) AS score
              FROM keys k CROSS JOIN ntot n
              LEFT JOIN em ON em.{key} = k.{key}
              LEFT JOIN base b ON b.{key} = k.{key}
              LEFT JOIN sparse sp ON sp.{key} = k.{key} AND sp.intent = n.intent)""",
        ]
    parts += [
        f"""proba AS (
          SELECT {key}, intent, score, e / sum(e) OVER (PARTITION BY {key}) AS p
          FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY {key})) AS e FROM scores))""",
        f"""top1 AS (
          SELECT {key}, intent AS pred_intent, p AS p_top FROM (
            SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, intent) AS rn FROM proba)
          WHERE rn = 1)""",
    ]
    return ",\n".join(parts)


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def nb_sql(select: str, background: bool = False, extra: tuple[str, ...] = ()) -> str:
    return _with(LAB, LABTAB, SPLIT, ETOK, nb_ctes(background), *extra) + select


METRIC_BASE = """pj AS (SELECT t.doc_id, t.intent AS y, p.pred_intent AS yhat, t.label
  FROM tst t JOIN top1 p ON t.doc_id = p.doc_id),
conf AS (SELECT y, yhat, count(*) AS n FROM pj GROUP BY y, yhat),
pc0 AS (SELECT cls, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM (
    SELECT y AS cls, CASE WHEN y = yhat THEN n ELSE 0 END AS tp, n AS support, 0 AS predicted FROM conf
    UNION ALL SELECT yhat, 0, 0, n FROM conf) GROUP BY cls),
pc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
  FROM (SELECT cls, tp, support, predicted,
               CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0.0 END AS recall FROM pc0))"""

VAL_BATCH = f"""vb AS (SELECT *, (row_number() OVER (ORDER BY {hk(42, '0', 'doc_id')}, doc_id) - 1) // 8 AS batch_id FROM pj),
bconf AS (SELECT batch_id, y, yhat, count(*) AS n FROM vb GROUP BY batch_id, y, yhat),
bpc0 AS (SELECT batch_id, cls, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM (
    SELECT batch_id, y AS cls, CASE WHEN y = yhat THEN n ELSE 0 END AS tp, n AS support, 0 AS predicted FROM bconf
    UNION ALL SELECT batch_id, yhat, 0, 0, n FROM bconf) GROUP BY batch_id, cls),
bpc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
  FROM (SELECT batch_id, cls, tp, support,
               CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0.0 END AS recall FROM bpc0)),
bw AS (SELECT batch_id, sum(tp)::DOUBLE / sum(support) AS accuracy,
              sum(precision * support) / sum(support) AS precision,
              sum(recall * support) / sum(support) AS recall,
              sum(f1 * support) / sum(support) AS f1 FROM bpc GROUP BY batch_id),
bmean AS (SELECT avg(accuracy) AS accuracy, avg(precision) AS precision, avg(recall) AS recall,
                 avg(f1) AS f1, count(*) AS n_batches FROM bw)"""

WHOLE = """whole AS (SELECT sum(tp)::DOUBLE / sum(support) AS accuracy,
              sum(precision * support) / sum(support) AS precision,
              sum(recall * support) / sum(support) AS recall,
              sum(f1 * support) / sum(support) AS f1 FROM pc)"""

LSE = """lse AS (SELECT s.doc_id, max(m) + ln(sum(exp(s.score - m))) AS z
  FROM scores s JOIN (SELECT doc_id, max(score) AS m FROM scores GROUP BY doc_id) x ON s.doc_id = x.doc_id
  GROUP BY s.doc_id)"""

LOSSES = f"""{LSE},
vloss_rows AS (
  SELECT t.doc_id, coalesce(z.z - p.score, -ln(1e-6)) AS loss,
         (row_number() OVER (ORDER BY {hk(42, '0', 't.doc_id')}, t.doc_id) - 1) // 8 AS batch_id
  FROM tst t JOIN lse z ON z.doc_id = t.doc_id
  LEFT JOIN scores p ON p.doc_id = t.doc_id AND p.intent = t.intent),
losses AS (
  SELECT 'validation' AS part, avg(l) AS mean_loss, count(*) AS n_batches
  FROM (SELECT batch_id, avg(loss) AS l FROM vloss_rows GROUP BY batch_id))"""


def train_score_sql(select: str, extra: tuple[str, ...] = ()) -> str:
    """NB model scored on the training part (key doc_id)."""
    ctt = f"etok AS (SELECT doc_id, unnest({toks('text')}) AS token FROM trn)"
    return _with(LAB, LABTAB, SPLIT, ctt, nb_ctes(False, keys_sql="SELECT doc_id FROM trn"), *extra) + select


def _train_loss_ctes() -> tuple[str, ...]:
    return (LSE, f"""tl_rows AS (
  SELECT t.doc_id, coalesce(z.z - p.score, -ln(1e-6)) AS loss,
         (row_number() OVER (ORDER BY {hk(42, '0', 't.doc_id')}, t.doc_id) - 1) // 8 AS batch_id
  FROM trn t JOIN lse z ON z.doc_id = t.doc_id
  LEFT JOIN scores p ON p.doc_id = t.doc_id AND p.intent = t.intent)""",
            """tloss AS (SELECT 'train' AS part, avg(l) AS mean_loss, count(*) AS n_batches
  FROM (SELECT batch_id, avg(loss) AS l FROM tl_rows GROUP BY batch_id))""")


def _mlm_ctes() -> str:
    return f"""{ULAB},
lines AS (SELECT doc_id, line_no, line FROM (
    SELECT doc_id, generate_subscripts(a, 1) - 1 AS line_no, unnest(a) AS line
    FROM (SELECT doc_id, regexp_split_to_array(text, '{LINE_BREAKS}') AS a FROM ulab))
  WHERE length(regexp_replace(line, '{PY_WS}', '', 'g')) > 0),
ltok AS (SELECT doc_id, line_no, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token
         FROM (SELECT doc_id, line_no, {toks('line')} AS t FROM lines)),
{vocab_cte('cvocab', 'ltok')},
cids AS (SELECT l.doc_id, l.line_no, l.pos, coalesce(v.token_id, 3) AS token_id
         FROM ltok l LEFT JOIN cvocab v ON l.token = v.token),
vs AS (SELECT count(*) AS v FROM cvocab)"""


def _mask_select(prefix: str) -> str:
    """Columns sel/how/rnd for the position rows of ``cids``: three segments of one md5."""
    parts = prefix + ["doc_id", "line_no", "pos"]
    sel, how, rnd = (hk(1, *parts, segment=k) for k in range(3))
    return (f"(token_id >= 4 AND {sel} % 100 < 15) AS sel, {how} % 100 AS how, "
            f"{rnd} % (SELECT v FROM vs) + 4 AS rnd")


def softmax_ctes(bits: int = BITS, steps: int = STEPS, rate: float = RATE, reg: float = REG) -> tuple[str, ...]:
    """M2: hashed features, then every gradient step as its own pair of tables; ``tp`` holds the held-out probabilities."""
    out = [f"""fx AS MATERIALIZED (SELECT part, doc_id, label, b, ln(1 + count(*)) AS x FROM (
  SELECT part, doc_id, label, {hk_plain('token')} % {1 << bits} AS b FROM (
    SELECT part, doc_id, label, unnest({toks('text')}) AS token FROM split)) GROUP BY part, doc_id, label, b)""",
           """fv AS MATERIALIZED (SELECT f.part, f.doc_id, f.label, f.b, f.x / n.n AS v
  FROM fx f JOIN (SELECT doc_id, sqrt(sum(x * x)) AS n FROM fx GROUP BY doc_id) n USING (doc_id))""",
           "cls AS (SELECT label, intent, count(*)::DOUBLE / (SELECT count(*) FROM trn) AS share FROM trn GROUP BY label, intent)",
           "w0 AS (SELECT 0::BIGINT AS b, label, 0.0::DOUBLE AS w FROM cls WHERE false)",
           "b0 AS (SELECT label, ln(share) AS w FROM cls)"]

    def probabilities(name: str, part: str, k: int) -> list[str]:
        rows = "trn" if part == "train" else "tst"
        return [f"""{name}z AS MATERIALIZED (SELECT d.doc_id, c.label, c.w + coalesce(s.z, 0) AS z
  FROM (SELECT doc_id FROM {rows}) d CROSS JOIN b{k} c
  LEFT JOIN (SELECT f.doc_id, w.label, sum(f.v * w.w) AS z FROM fv f JOIN w{k} w ON f.b = w.b
             WHERE f.part = '{part}' GROUP BY f.doc_id, w.label) s ON s.doc_id = d.doc_id AND s.label = c.label)""",
                f"""{name} AS MATERIALIZED (SELECT doc_id, label, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY doc_id) AS p
  FROM (SELECT *, max(z) OVER (PARTITION BY doc_id) AS m FROM {name}z))"""]
    for k in range(steps):
        out += probabilities(f"p{k}", "train", k)
        out.append(f"""e{k} AS MATERIALIZED (SELECT p.doc_id, p.label, p.p - CASE WHEN t.label = p.label THEN 1 ELSE 0 END AS e
  FROM p{k} p JOIN trn t ON t.doc_id = p.doc_id)""")
        out.append(f"""w{k + 1} AS MATERIALIZED (SELECT g.b, g.label, coalesce(w.w, 0) - {rate} * (g.g / (SELECT count(*) FROM trn) + {reg} * coalesce(w.w, 0)) AS w
  FROM (SELECT f.b, e.label, sum(f.v * e.e) AS g FROM fv f JOIN e{k} e ON f.doc_id = e.doc_id WHERE f.part = 'train' GROUP BY f.b, e.label) g
  LEFT JOIN w{k} w ON w.b = g.b AND w.label = g.label)""")
        out.append(f"""b{k + 1} AS MATERIALIZED (SELECT b.label, b.w - {rate} * s.g / (SELECT count(*) FROM trn) AS w
  FROM b{k} b JOIN (SELECT label, sum(e) AS g FROM e{k} GROUP BY label) s ON s.label = b.label)""")
    return (*out, *probabilities("tp", "test", steps))


def hk_plain(column: str) -> str:
    """First 32 bits of the md5 of a text column."""
    return f"('0x' || substr(md5({column}), 1, 8))::BIGINT"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["label_map"] = _with(LAB) + """
SELECT intent, CAST(row_number() OVER (ORDER BY intent) - 1 AS BIGINT) AS corresponding_label,
       CAST(n AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY n DESC, intent) AS BIGINT) AS freq_rank
FROM (SELECT intent, count(*) AS n FROM lab GROUP BY intent)"""
    q["class_stats"] = _with(LAB) + """
SELECT CAST(count(DISTINCT intent) AS BIGINT) AS n_classes, CAST(count(*) AS BIGINT) AS n_samples FROM lab"""
    q["label_roundtrip"] = _with(LAB, LABTAB) + """
SELECT l.doc_id, t.label, t.intent, CAST(1 AS BIGINT) AS same FROM lab l JOIN labtab t ON l.intent = t.intent"""
    q["feature_filter"] = f"""
WITH a AS (
  SELECT d.doc_id, d.text, CASE WHEN d.lang = 'en' THEN d.text END AS tr,
         CASE WHEN l.doc_id IS NULL THEN NULL
              ELSE d.lang || '_q' || CAST(l.quality AS VARCHAR) || '_t' || CAST(l.toxic AS VARCHAR) END AS intent
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
b AS (
  SELECT doc_id, CASE WHEN text IN ({NA}) THEN NULL ELSE text END AS text,
         CASE WHEN intent IN ({NA}) THEN NULL ELSE intent END AS intent
  FROM a WHERE tr NOT IN ({NA}))
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, intent,
       CASE WHEN text IS NULL THEN 'missing_feature' WHEN intent IS NULL THEN 'missing_label' ELSE 'ok' END
       AS status
FROM b"""
    q["corpus_lines"] = _with(ULAB) + f"""
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM (
  SELECT doc_id, generate_subscripts(a, 1) - 1 AS line_no, unnest(a) AS line
  FROM (SELECT doc_id, regexp_split_to_array(text, '{LINE_BREAKS}') AS a FROM ulab))
WHERE length(regexp_replace(line, '{PY_WS}', '', 'g')) > 0"""
    q["annotated_csv"] = q["feature_filter"]
    q["prepared_labelled"] = f"""SELECT doc_id, n_chars, intent,
       CASE WHEN n_chars IS NULL THEN 'feature' WHEN intent IS NULL THEN 'label' ELSE 'ok' END AS reason
FROM ({q["feature_filter"]})"""
    q["prepared_scored"] = f"""SELECT {MSG_ID} AS msg_id,
       CASE WHEN role = 'user' THEN CAST(length(text) AS BIGINT) END AS n_chars,
       CASE WHEN role = 'user' AND text IS NOT NULL THEN 'ok' ELSE 'feature' END AS reason FROM conversations"""
    q["corpus_file_lines"] = f"""SELECT line, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_keys
FROM ({q['corpus_lines']}) GROUP BY line"""
    q["split_stratified"] = _with(LAB, LABTAB, SPLIT) + "SELECT doc_id, intent, label, part FROM split"
    q["split_three_way"] = _with(LAB, LABTAB, SPLIT, second_split("trn", 43)) + """
SELECT doc_id, intent, part FROM vsplit UNION ALL SELECT doc_id, intent, 'test' FROM tst"""
    q["split_random"] = _with(LAB) + f"""
SELECT doc_id, intent,
       CASE WHEN row_number() OVER (ORDER BY {hk(0, 'doc_id')}, doc_id)
                 <= count(*) OVER () - CAST(ceil(0.2::DOUBLE * CAST(count(*) OVER () AS DOUBLE)) AS BIGINT)
            THEN 'train' ELSE 'test' END AS part
FROM lab"""
    q["batches_shuffled"] = _with(LAB, LABTAB, SPLIT) + f"""
SELECT epoch, doc_id, CAST((rk - 1) // 8 AS BIGINT) AS batch_id, CAST((rk - 1) % 8 AS BIGINT) AS batch_pos
FROM (SELECT e.epoch, t.doc_id,
             row_number() OVER (PARTITION BY e.epoch ORDER BY {hk(42, 'e.epoch', 't.doc_id')}, t.doc_id) AS rk
      FROM trn t, (SELECT CAST(range AS BIGINT) AS epoch FROM range(3)) e)"""
    # ranks by hash, then a Feistel network per epoch over 2 * half bits, walked until the result is a rank
    q["batches_epochs"] = "WITH RECURSIVE " + _with(LAB, LABTAB, SPLIT).strip()[len("WITH "):] + f""",
rk AS (SELECT doc_id, row_number() OVER (ORDER BY {hk(42, 'doc_id')}, doc_id) - 1 AS r FROM trn),
dim AS (SELECT count(*) AS n, greatest(4, (length(format('{{:b}}', greatest(count(*) - 1, 1))) + 1) // 2) AS half FROM rk),
walk(epoch, doc_id, x, l, r, k) AS (
  SELECT e.epoch, doc_id, rk.r, rk.r >> half, rk.r & ((1::BIGINT << half) - 1), 0
  FROM rk, dim, (SELECT CAST(range AS BIGINT) AS epoch FROM range(15)) e
  UNION ALL
  SELECT epoch, doc_id, x2, CASE WHEN k = 6 THEN x2 >> half ELSE r END,
         CASE WHEN k = 6 THEN x2 & (m - 1) ELSE xor(l, ((t * t) // (1::BIGINT << (half // 2)) + t * 25173 + epoch + 1 + k) % m) END,
         CASE WHEN k = 6 THEN 0 ELSE k + 1 END
  FROM (SELECT w.*, half, n, 1::BIGINT << half AS m,
               (r * (2 * (((epoch + 1) * 7919 + k * 104729 + 42) % (1::BIGINT << half)) + 1)
                + (epoch + 1) * 40503 + k * 9176 + 42 * 613) % (1::BIGINT << half) AS t,
               CASE WHEN k = 6 THEN (l << half) | r ELSE x END AS x2 FROM walk w, dim)
  WHERE NOT (k = 6 AND x2 < n))
SELECT epoch, doc_id, CAST(((l << half) | r) // 8 AS BIGINT) AS batch_id, CAST(((l << half) | r) % 8 AS BIGINT) AS batch_pos
FROM walk, dim WHERE k = 6 AND ((l << half) | r) < n"""
    q["batches_ordered"] = _with(LAB, LABTAB, SPLIT) + """
SELECT doc_id, CAST((rk - 1) // 64 AS BIGINT) AS batch_id, CAST((rk - 1) % 64 AS BIGINT) AS batch_pos
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rk FROM tst)"""
    q["step_counts"] = _with(LAB, LABTAB, SPLIT) + """
SELECT CAST(n AS BIGINT) AS n_rows, CAST(b AS BIGINT) AS batch_size, CAST((n + b - 1) // b AS BIGINT) AS steps_per_epoch,
       CAST(e AS BIGINT) AS epochs, CAST(((n + b - 1) // b) * e AS BIGINT) AS total_steps, part
FROM (SELECT count(*) AS n, 8 AS b, 3 AS e, 'train' AS part FROM trn
      UNION ALL SELECT count(*), 128, 1, 'test' FROM tst)"""
    q["tokens"] = f"""
SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS pos, unnest(t) AS token
FROM (SELECT doc_id, {toks('text')} AS t FROM documents)"""
    q["vocab_topk"] = _with(f"dtok AS (SELECT doc_id, unnest({toks('text')}) AS token FROM documents)",
                            vocab_cte("vocab", "dtok")) + "SELECT token, token_id, df, tf FROM vocab"
    q["encoded_padded"] = _with(LAB, LABTAB, SPLIT, TTOK, vocab_cte("vocab", "ttok")) + f"""
, et AS (SELECT part, doc_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token
         FROM (SELECT part, doc_id, {toks('text')} AS t FROM split)),
ids AS (SELECT e.part, e.doc_id, e.pos // 248 AS chunk, e.pos, coalesce(v.token_id, 3) AS token_id
        FROM et e LEFT JOIN vocab v ON e.token = v.token),
ch AS (SELECT part, doc_id, chunk, list(token_id ORDER BY pos) AS ids FROM ids GROUP BY part, doc_id, chunk
       UNION ALL SELECT part, doc_id, 0, [] FROM split WHERE len({toks('text')}) = 0),
wide AS (SELECT *, max(len(ids)) OVER (PARTITION BY part) + 2 AS w FROM ch)
SELECT part, doc_id, CAST(chunk AS BIGINT) AS chunk,
       array_to_string(list_resize(list_concat([0], ids, [2]), w, 1), ' ') AS input_ids,
       array_to_string(list_resize(list_transform(list_concat([0], ids, [2]), lambda x: 1), w, 0), ' ')
         AS attention_mask,
       CAST(len(ids) AS BIGINT) AS n_tokens
FROM wide"""
    q["mlm_mask"] = _with(_mlm_ctes()) + f"""
, m AS (SELECT *, {_mask_select([])} FROM cids)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(pos AS BIGINT) AS pos, CAST(token_id AS BIGINT) AS token_id,
       CAST(CASE WHEN NOT sel THEN token_id WHEN how < 80 THEN (SELECT v FROM vs) + 4
                 WHEN how < 90 THEN rnd ELSE token_id END AS BIGINT) AS input_id,
       CAST(CASE WHEN sel THEN token_id END AS BIGINT) AS target_id
FROM m"""
    q["mlm_epoch_file"] = _with(_mlm_ctes()) + f"""
, ep AS (SELECT c.*, e.epoch FROM cids c, (SELECT CAST(range AS BIGINT) AS epoch FROM range(15)) e),
m AS (SELECT *, {_mask_select(['epoch'])} FROM ep),
r AS (SELECT epoch, doc_id, token_id, line_no * 31 + pos + 1 AS place,
             CASE WHEN NOT sel THEN token_id WHEN how < 80 THEN (SELECT v FROM vs) + 4
                  WHEN how < 90 THEN rnd ELSE token_id END AS input_id,
             CASE WHEN sel THEN token_id END AS target_id FROM m)
SELECT epoch, doc_id, CAST(count(*) AS BIGINT) AS n_positions, CAST(count(target_id) AS BIGINT) AS n_targets,
       CAST(sum(token_id * place) AS BIGINT) AS token_sum, CAST(sum(input_id * place) AS BIGINT) AS input_sum,
       CAST(coalesce(sum(target_id * place), 0) AS BIGINT) AS target_sum
FROM r GROUP BY epoch, doc_id"""
    q["mlm_epochs"] = _with(_mlm_ctes()) + f"""
, ep AS (SELECT c.*, e.epoch FROM cids c, (SELECT CAST(range AS BIGINT) AS epoch FROM range(15)) e),
m AS (SELECT *, {_mask_select(['epoch'])} FROM ep)
SELECT epoch, CAST(count(*) AS BIGINT) AS n_positions,
       CAST(sum(CASE WHEN sel THEN 1 ELSE 0 END) AS BIGINT) AS n_selected,
       CAST(sum(CASE WHEN sel AND how < 80 THEN 1 ELSE 0 END) AS BIGINT) AS n_masked,
       CAST(sum(CASE WHEN sel AND how >= 80 AND how < 90 THEN 1 ELSE 0 END) AS BIGINT) AS n_random,
       CAST(sum(CASE WHEN sel AND how >= 90 THEN 1 ELSE 0 END) AS BIGINT) AS n_same
FROM m GROUP BY epoch"""
    q["nb_weights"] = nb_sql("""
SELECT c.token, c.intent, CAST(c.n_tc AS BIGINT) AS n_tc,
       round(ln((c.n_tc + 1.0) / (n.n_tok + (SELECT v FROM consts))), 6) AS log_p
FROM cnt_tc c JOIN ntot n ON c.intent = n.intent""")
    q["nb_scores"] = nb_sql("SELECT doc_id, intent, round(score, 4) AS score FROM scores")
    q["nb_proba"] = nb_sql("SELECT doc_id, intent, round(p, 6) AS p FROM proba")
    q["nb_predict"] = nb_sql("""
SELECT t.doc_id, t.intent AS true_intent, p.pred_intent, round(p.p_top, 6) AS p_top
FROM tst t JOIN top1 p ON t.doc_id = p.doc_id""")
    q["background_weights"] = nb_sql("""
SELECT c.token, c.intent, CAST(c.n_tc AS BIGINT) AS n_tc,
       round(ln((c.n_tc + 1000.0 * p.p) / (n.n_tok + 1000.0)), 6) AS log_p
FROM cnt_tc c JOIN ntot n ON c.intent = n.intent JOIN pbg p ON c.token = p.token""", background=True)
    q["background_predict"] = nb_sql("""
SELECT t.doc_id, t.intent AS true_intent, p.pred_intent, round(p.p_top, 6) AS p_top
FROM tst t JOIN top1 p ON t.doc_id = p.doc_id""", background=True)
    q["label_width"] = nb_sql("""
SELECT label, 'never_scored' AS problem FROM labtab
WHERE intent NOT IN (SELECT pred_intent FROM top1)""")
    msg = (f"""mtok AS (SELECT {MSG_ID} AS msg_id, unnest({toks('text')}) AS token
             FROM conversations)""")
    q["answer_map"] = _with(
        LAB, LABTAB, SPLIT, msg,
        nb_ctes(False, "mtok", "msg_id", f"SELECT {MSG_ID} AS msg_id FROM conversations")
    ) + "SELECT msg_id, intent, round(p, 6) AS p FROM proba"
    # M7: the JSON text itself. Probabilities are rounded to k / 10^6; the JVM prints such a
    # double as the shortest decimal with at least one fraction digit when k >= 1000, and as
    # d.dddE-n below 10^-3 (checked for every k in 0..10^6).
    num = ("CASE WHEN k = 0 THEN '0.0' "
           "WHEN k >= 1000 THEN CAST(k // 1000000 AS VARCHAR) || '.' || "
           "coalesce(nullif(rtrim(lpad(CAST(k % 1000000 AS VARCHAR), 6, '0'), '0'), ''), '0') "
           "ELSE substr(rtrim(CAST(k AS VARCHAR), '0'), 1, 1) || '.' || "
           "coalesce(nullif(substr(rtrim(CAST(k AS VARCHAR), '0'), 2), ''), '0') || 'E' || "
           "CAST(length(CAST(k AS VARCHAR)) - 7 AS VARCHAR) END")
    q["answer_json"] = _with(
        LAB, LABTAB, SPLIT, msg,
        nb_ctes(False, "mtok", "msg_id", f"SELECT {MSG_ID} AS msg_id FROM conversations")
    ) + f""", pk AS (SELECT msg_id, intent, CAST(round(round(p, 6) * 1000000) AS BIGINT) AS k FROM proba)
SELECT msg_id, '[{{' || string_agg('"' || intent || '":' || ({num}), ',' ORDER BY intent) || '}}]' AS json
FROM pk GROUP BY msg_id"""
    q["stream_score"] = q["answer_map"]
    q["answers_file"] = q["answer_map"]
    q["predictions_csv"] = nb_sql("""
SELECT p.doc_id, t.label AS predicted_label FROM top1 p JOIN labtab t ON p.pred_intent = t.intent""")
    # M8: NB scores of each encoded chunk (248 content tokens), key doc_id * 1e6 + chunk
    chunk_tok = f"""ctok AS (
  SELECT doc_id * 1000000 + (pos // 248) AS ck, token FROM (
    SELECT doc_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token
    FROM (SELECT doc_id, {toks('text')} AS t FROM tst)))"""
    chunk_keys = (f"SELECT DISTINCT ck FROM ctok UNION "
                  f"SELECT doc_id * 1000000 FROM tst WHERE len({toks('text')}) = 0")
    q["plug_score"] = _with(LAB, LABTAB, SPLIT, chunk_tok, nb_ctes(False, "ctok", "ck", chunk_keys)) + """
SELECT CAST(ck // 1000000 AS BIGINT) AS doc_id, CAST(ck % 1000000 AS BIGINT) AS chunk, pred_intent FROM top1"""
    q["plug_predict"] = nb_sql("SELECT doc_id, pred_intent, round(p_top, 6) AS p_top FROM top1")
    q["lr_predict"] = _with(LAB, LABTAB, SPLIT, *softmax_ctes()) + """
SELECT t.doc_id, t.intent AS pred_intent, round(t.p, 6) AS p_top
FROM (SELECT s.doc_id, c.intent, s.p, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.p DESC, s.label) AS r
      FROM tp s JOIN cls c ON c.label = s.label) t WHERE r = 1"""
    # M2: what any fitted classifier must give; the last column is the accuracy floor it has to pass
    q["lr_coverage"] = _with(LAB, LABTAB, SPLIT) + """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_ids,
       CAST(count(*) AS BIGINT) AS n_known, CAST(count(*) AS BIGINT) AS n_probabilities,
       CAST(1 AS BIGINT) AS beats_biggest_class FROM tst"""
    q["accuracy"] = nb_sql("""
SELECT round(avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END), 6) AS accuracy, CAST(count(*) AS BIGINT) AS n FROM pj""",
                           extra=(METRIC_BASE,))
    q["weighted_prf"] = nb_sql("""
SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1 FROM whole""", extra=(METRIC_BASE, WHOLE))
    q["batch_mean_metrics"] = nb_sql("""
SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, CAST(n_batches AS BIGINT) AS n_batches FROM bmean""", extra=(METRIC_BASE, VAL_BATCH))
    q["report"] = nb_sql("""
SELECT cls AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM pc
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp)::DOUBLE / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pc
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       CAST(sum(support) AS BIGINT) FROM pc
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM pc""", extra=(METRIC_BASE,))
    # losses: validation scored on tst, train scored on trn (second model pass)
    val_loss = nb_sql("""
SELECT part, round(mean_loss, 6) AS mean_loss, CAST(n_batches AS BIGINT) AS n_batches FROM losses""",
                      extra=(LOSSES,))
    trn_loss = train_score_sql("""
SELECT part, round(mean_loss, 6) AS mean_loss, CAST(n_batches AS BIGINT) AS n_batches FROM tloss""",
                               extra=_train_loss_ctes())
    q["mean_loss"] = f"SELECT * FROM ({val_loss}) UNION ALL SELECT * FROM ({trn_loss})"
    q["every10_accuracy"] = train_score_sql(f"""
SELECT CAST(batch_id AS BIGINT) AS batch_id, round(avg(CASE WHEN t.intent = p.pred_intent THEN 1.0 ELSE 0.0 END), 6)
       AS accuracy, CAST(count(*) AS BIGINT) AS n
FROM (SELECT doc_id, intent,
             (row_number() OVER (ORDER BY {hk(42, '0', 'doc_id')}, doc_id) - 1) // 8 AS batch_id FROM trn) t
JOIN top1 p ON t.doc_id = p.doc_id
WHERE batch_id % 10 = 0 AND batch_id > 0
GROUP BY batch_id""")
    summ = nb_sql("""
SELECT 'accuracy' AS metric, accuracy AS value FROM whole
UNION ALL SELECT 'precision', precision FROM whole
UNION ALL SELECT 'recall', recall FROM whole
UNION ALL SELECT 'f1', f1 FROM whole
UNION ALL SELECT 'batch_accuracy', accuracy FROM bmean
UNION ALL SELECT 'batch_precision', precision FROM bmean
UNION ALL SELECT 'batch_recall', recall FROM bmean
UNION ALL SELECT 'batch_f1', f1 FROM bmean
UNION ALL SELECT 'validation_loss', mean_loss FROM losses""", extra=(METRIC_BASE, WHOLE, VAL_BATCH, LOSSES))
    tl = train_score_sql("SELECT 'train_loss' AS metric, mean_loss AS value FROM tloss",
                         extra=_train_loss_ctes())
    q["run_summary"] = (f"SELECT metric, round(value, 6) AS value FROM ({summ}) "
                        f"UNION ALL SELECT metric, round(value, 6) FROM ({tl})")
    q["pred_alignment"] = nb_sql("""
SELECT CAST(count(p.doc_id) AS BIGINT) AS n_matched,
       CAST(sum(CASE WHEN p.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_truth_only,
       CAST(0 AS BIGINT) AS n_pred_only, CAST(0 AS BIGINT) AS n_duplicate_keys
FROM lab l LEFT JOIN top1 p ON l.doc_id = p.doc_id""")
    q["test_alignment"] = nb_sql("""
SELECT CAST(count(*) AS BIGINT) AS n_matched, CAST(0 AS BIGINT) AS n_truth_only, CAST(0 AS BIGINT) AS n_pred_only,
       CAST(0 AS BIGINT) AS n_duplicate_keys, CAST(count(*) FILTER (y = yhat) AS BIGINT) AS n_right FROM pj""",
                                 extra=(METRIC_BASE,))
    q["prepared_counts"] = f"""
WITH p AS ({q["prepared_labelled"]}), r AS (SELECT unnest(['ok', 'feature', 'label']) AS reason)
SELECT r.reason, CAST(count(p.reason) AS BIGINT) AS n_counted, CAST(count(p.reason) AS BIGINT) AS n_written,
       CAST(sum(doc_id) AS BIGINT) AS id_sum FROM r LEFT JOIN p ON p.reason = r.reason GROUP BY r.reason"""
    q["run_table"] = nb_sql("""
SELECT v.version, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1 FROM whole, (SELECT CAST(range AS BIGINT) AS version FROM range(2)) v""", extra=(METRIC_BASE, WHOLE))
    q["csv_roundtrip"] = _with(LAB) + """
SELECT intent, CAST(row_number() OVER (ORDER BY intent) - 1 AS BIGINT) AS corresponding_label
FROM (SELECT DISTINCT intent FROM lab)"""
    q["split_roundtrip"] = _with(LAB, LABTAB, SPLIT) + \
        "SELECT doc_id, label, part, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM split"
    q["model_roundtrip"] = q["nb_predict"]
    q["model_latest"] = q["nb_predict"]
    return q
