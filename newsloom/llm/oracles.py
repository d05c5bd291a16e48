"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from newsloom.llm import quality_rules

_SPACE = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
_LINES = "string_split(coalesce(text, ''), chr(10))"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

LINE_DEDUP = f"""WITH l AS (SELECT doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
d AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id"""

_W = f"w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, {_WORDS} AS ws FROM documents))"


def _grams(k: int) -> str:
    frame = f"OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)"
    return f"g{k} AS (SELECT doc_id, i, win FROM (SELECT doc_id, i, string_agg(word, ' ') {frame} AS win, count(*) {frame} AS n FROM w) WHERE n = {k})"


def _covered(k: int, marked: str) -> str:
    """Words of w with gone = 1 if a marked window of k words lies over them."""
    frame = f"OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"(SELECT w.*, max(CASE WHEN r.dup THEN 1 ELSE 0 END) {frame} AS gone FROM w LEFT JOIN ({marked}) r ON r.doc_id = w.doc_id AND r.i = w.i)"


# the number of factors isn't in here: it says how the spans were found, not which words go
SUBSTRING_DEDUP = f"""WITH {_W}, {_grams(20)},
c AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept
 FROM {_covered(20, "SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS dup FROM g20")} GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id"""


def repetition_rules() -> str:
    q = quality_rules
    parts = [_W, *(_grams(k) for k in range(2, 11))]
    parts.append("b AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars FROM w GROUP BY doc_id)")
    parts.append(f"n3 AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n FROM {_covered(3, 'SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) > 1 AS dup FROM g3')} GROUP BY doc_id)")
    for k in q.REPEATED:
        marked = f"SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, win ORDER BY i) > 1 AS dup FROM g{k}"
        parts.append(f"c{k} AS (SELECT doc_id, CAST(sum(CASE WHEN gone = 1 THEN length(word) ELSE 0 END) AS BIGINT) AS chars FROM {_covered(k, marked)} GROUP BY doc_id)")
    for k in q.TOP:
        counts = f"SELECT doc_id, m, max(size) AS size FROM (SELECT doc_id, win, count(*) AS m, length(win) - {k - 1} AS size FROM g{k} GROUP BY doc_id, win) GROUP BY doc_id, m"
        parts.append(f"t{k} AS (SELECT doc_id, CASE WHEN max(m) >= {q.TOP_TIMES} THEN max(m) * arg_max(size, m) ELSE 0 END AS chars FROM ({counts}) GROUP BY doc_id)")
    parts.append(rf"""l AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (later) AS n_dup, CAST(coalesce(sum(chars) FILTER (later), 0) AS BIGINT) AS dup_chars FROM
 (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS later, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars
  FROM (SELECT doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS pos FROM documents) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) GROUP BY doc_id)""")
    names = [f"c{k}" for k in q.REPEATED] + [f"t{k}" for k in q.TOP]
    columns = ", ".join(f"coalesce({n}.chars, 0) AS {n}" for n in names)
    joins = " ".join(f"LEFT JOIN {n} ON {n}.doc_id = d.doc_id" for n in ("b", "n3", "l", *names))
    parts.append(
        f"""m AS (SELECT d.doc_id, coalesce(b.n_words, 0) AS n_words, coalesce(b.word_chars, 0) AS word_chars, CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(dup_chars, 0) AS dup_chars, coalesce(n3.n, 0) AS n_repeat_words, {columns} FROM documents d {joins})"""
    )
    failed = f"(n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words)"
    rules = {"base": failed} | {f"repeated_{k}": f"100 * c{k} > {p} * word_chars" for k, p in q.REPEATED.items()} | {f"top_{k}": f"100 * t{k} > {p} * word_chars" for k, p in q.TOP.items()}
    some = f"n_dup_lines >= {q.MIN_DUP_LINES}"
    rules |= {"lines": f"{some} AND 100 * n_dup_lines > {q.LINES} * n_lines", "line_chars": f"{some} AND 100 * dup_chars > {q.LINE_CHARS} * word_chars"}
    reasons = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in rules.items())
    return f"""WITH {", ".join(parts)} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, r = '' AS kept, r AS reasons
FROM (SELECT *, array_to_string(list_filter([{reasons}], lambda x: x IS NOT NULL), ',') AS r FROM m)"""


def centroid_clustering(k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024) -> str:
    """One set of centroids and one assignment a round; a centroid without vectors stays."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
 WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {k}))",
    ]
    near = "SELECT v.row, min({d} * 16 + j) AS best FROM v CROSS JOIN c{r} c GROUP BY v.row"
    d = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT row, CAST(best % 16 AS BIGINT) AS j, CAST(best // 16 AS BIGINT) AS d FROM ({near.format(d=d, r=r)}))")
        if r < rounds:
            mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT j, list({mean} ORDER BY i) AS x FROM
 (SELECT a.j, i, CAST(sum(v.x[i]) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM a{r} a JOIN v USING (row) CROSS JOIN range(1, {dims + 1}) q(i) GROUP BY a.j, i) GROUP BY j) m ON m.j = c.j)""")
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(a.j AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
 CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v USING (row) JOIN c{rounds} c ON c.j = a.j"""


_BREAKS = r"[.,;:!?\x0A-\x0D]"
COLLOCATIONS = rf"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT id, lang, unnest(string_split_regex(t, '{_BREAKS}')) AS piece, generate_subscripts(string_split_regex(t, '{_BREAKS}'), 1) AS pos FROM d),
w AS (SELECT id, lang, pos, unnest(regexp_extract_all(piece, '[^\x20\x09]+')) AS word, generate_subscripts(regexp_extract_all(piece, '[^\x20\x09]+'), 1) AS i FROM p),
g AS (SELECT lang, word AS x, lead(word, 1) OVER o AS y, lead(word, 2) OVER o AS z FROM w WINDOW o AS (PARTITION BY id, pos ORDER BY i)),
f1 AS (SELECT lang, x, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY lang, x), f2 AS (SELECT lang, x, y, CAST(count(*) AS HUGEINT) AS f FROM g WHERE y IS NOT NULL GROUP BY lang, x, y),
f3 AS (SELECT lang, x, y, z, CAST(count(*) AS HUGEINT) AS f FROM g WHERE z IS NOT NULL GROUP BY lang, x, y, z HAVING count(*) >= 10),
n AS (SELECT lang, count(*) AS n FROM g GROUP BY lang),
shadow AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y AS x, z AS y, f FROM f3) GROUP BY lang, x, y),
cut AS (SELECT lang, p.x || ' ' || p.y AS phrase, p.f AS a, 1 AS k, l.f AS l, r.f AS r FROM f2 p JOIN f1 l USING (lang, x) JOIN f1 r ON r.lang = p.lang AND r.x = p.y LEFT JOIN shadow s ON s.lang = p.lang AND s.x = p.x AND s.y = p.y
  WHERE p.f >= 10 AND coalesce(100 * s.f < 50 * p.f, TRUE)
 UNION ALL SELECT lang, p.x || ' ' || p.y || ' ' || p.z, p.f, 1, l.f, r.f FROM f3 p JOIN f1 l USING (lang, x) JOIN f2 r ON r.lang = p.lang AND r.x = p.y AND r.y = p.z
 UNION ALL SELECT lang, p.x || ' ' || p.y || ' ' || p.z, p.f, 2, l.f, r.f FROM f3 p JOIN f2 l USING (lang, x, y) JOIN f1 r ON r.lang = p.lang AND r.x = p.z),
scored AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS best FROM (SELECT *, 1000000 * a * a // (l * r) AS score FROM cut)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored WHERE best = 1)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


SQL = {"op4_line_dedup": LINE_DEDUP, "op5_substring_dedup": SUBSTRING_DEDUP, "op7_repetition_rules": repetition_rules(), "op11_centroid_clustering": centroid_clustering(), "op12_phrase_collocations": COLLOCATIONS}
