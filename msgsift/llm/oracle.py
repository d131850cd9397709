"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# crc32 of an id's decimal text: the reflected polynomial, byte by byte and bit by bit
_CRC = ("xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: "
        "CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), "
        "lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)")


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
                                   for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


ORACLE_SQL = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_NORM} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY t)""",
    "op8_decontamination": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_NORM}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_NORM}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        item AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS t
                FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM item)),
        dw AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
               FROM d, (SELECT DISTINCT n FROM item) WHERE len(w) >= n),
        hit AS (SELECT doc_id, k, x.n, item_id FROM (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS t FROM dw) x
                JOIN win ON x.n = win.n AND x.t = win.t),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                  FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_items,
                         string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
                  FROM hit GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_minmax_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_NORM}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + n - 1], ' ') AS t
              FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
                    FROM (SELECT doc_id, w, least(len(w), 5) AS n FROM d WHERE len(w) > 0))),
        c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id
                 GROUP BY a.doc_id, b.doc_id),
        link AS (SELECT a, b FROM pair JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b
                 WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
        reach(node, other) AS (SELECT a, b FROM link UNION
                               SELECT reach.node, link.b FROM reach JOIN link ON reach.other = link.a),
        comp AS (SELECT node, min(other) AS m FROM reach GROUP BY node)
        SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
               d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
        FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN comp ON comp.node = d.doc_id""",
    "op11_substring_dedup": """
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
        win AS (SELECT doc_id, i, sha256(array_to_string(w[i + 1:i + 35], ' ')) AS t
                FROM (SELECT doc_id, w, unnest(range(len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
        again AS (SELECT t FROM win GROUP BY t HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM win SEMI JOIN again USING (t)),
        n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
        word AS (SELECT doc_id, i, w[i + 1] AS x FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d)),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op12_merkle_manifest": f"""
        WITH RECURSIVE leaf AS (
            SELECT doc_id, lang, {_leaf("n_chars")} AS h, {_leaf("n_chars + 1")} AS bad, {_CRC} % 7 = 0 AS touched FROM documents),
        d AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
                     row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS p FROM leaf),
        tree(g, lv, p, h, n) AS (
            SELECT g, 0, p, h, count(*) OVER (PARTITION BY g) FROM d UNION ALL
            SELECT g, lv + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (n + 1) // 2 FROM tree WHERE n > 1
            GROUP BY g, lv, p // 2, n),
        sub AS (SELECT g AS p, h FROM tree WHERE n = 1),
        ttree(lv, p, h, n) AS (
            SELECT 0, p, h, count(*) OVER () FROM sub UNION ALL
            SELECT lv + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (n + 1) // 2 FROM ttree WHERE n > 1
            GROUP BY lv, p // 2, n),
        top AS (SELECT h AS root FROM ttree WHERE n = 1),
        depth AS (SELECT g, max(lv) AS up FROM tree GROUP BY g),
        step AS (
            SELECT d.g, d.p, n.lv, n.p < (d.p >> n.lv) AS before, n.h AS sib FROM d JOIN tree n
                ON n.g = d.g AND n.n > 1 AND n.p = xor(d.p >> n.lv, 1)
            UNION ALL
            SELECT d.g, d.p, up + t.lv, t.p < (d.g >> t.lv), t.h FROM d JOIN depth USING (g) JOIN ttree t
                ON t.n > 1 AND t.p = xor(d.g >> t.lv, 1)),
        steps AS (SELECT d.g, d.p, up + (SELECT max(lv) FROM ttree) AS height FROM d JOIN depth USING (g)),
        proof AS (SELECT g, p, string_agg(sib, '' ORDER BY lv) AS sibs FROM step GROUP BY g, p),
        fold(g, p, lv, h) AS (
            SELECT g, p, 0, CASE WHEN touched THEN bad ELSE h END FROM d UNION ALL
            SELECT f.g, f.p, f.lv + 1, sha256(CASE WHEN s.sib IS NULL THEN f.h WHEN s.before THEN s.sib || f.h ELSE f.h || s.sib END)
            FROM fold f JOIN steps x ON x.g = f.g AND x.p = f.p AND f.lv < x.height
                 LEFT JOIN step s ON s.g = f.g AND s.p = f.p AND s.lv = f.lv)
        SELECT d.doc_id, d.h AS leaf, sub.h AS subroot, root, sha256(coalesce(sibs, '')) AS proof_sha256,
               fold.h AS folded_root, fold.h = root AS verified
        FROM d JOIN sub ON sub.p = d.g CROSS JOIN top JOIN steps ON steps.g = d.g AND steps.p = d.p
             JOIN fold ON fold.g = d.g AND fold.p = d.p AND fold.lv = steps.height
             LEFT JOIN proof ON proof.g = d.g AND proof.p = d.p""",
    "op13_periodic_runs": f"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w, {_CRC} AS h FROM documents),
        e AS (SELECT doc_id, w, h, len(w) AS n, (h // 10) % len(w) AS a, (h // 10) % 8 AS m FROM d WHERE len(w) > 0),
        v AS (SELECT *, 1 + (n - a) // (3 + m) AS p FROM e),
        word AS (SELECT doc_id, i, w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS x
                 FROM (SELECT *, unnest(range(n)) AS i FROM v)),
        tri AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS t
                FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM tri x JOIN tri y ON x.doc_id = y.doc_id AND x.t = y.t AND x.i < y.i),
        isle AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pair),
        cand AS (SELECT doc_id, q, min(i) AS s, count(*) + 2 + q AS len FROM isle GROUP BY doc_id, q, k
                 HAVING count(*) + 2 + q >= greatest(6, 4 * q)),
        run AS (SELECT * FROM cand c WHERE NOT EXISTS (
            SELECT 1 FROM cand b WHERE b.doc_id = c.doc_id AND b.q < c.q AND b.s <= c.s AND b.s + b.len >= c.s + c.len)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM run),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
        per AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t,
                       first(s ORDER BY len DESC, s, q) AS start, first(len ORDER BY len DESC, s, q) AS length,
                       first(q ORDER BY len DESC, s, q) AS period FROM run GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
               sha256(coalesce(per.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
        FROM d LEFT JOIN per ON per.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id""",
}
