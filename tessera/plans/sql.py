"""SQL counterparts of the operators, for comparison on another engine."""

from __future__ import annotations

from tessera.functions import text as T
from tessera.operators import layout
from tessera.sources.blocks import HEADINGS


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tokens(x: str) -> str:
    stops = ", ".join(map(quoted, T.STOPWORDS))
    return f"""list_transform(list_filter(list_transform(regexp_extract_all({x}, {quoted(T.TOKEN)}), lambda t: lower(t)), lambda t: t NOT IN ({stops})), lambda w:
      CASE WHEN length(w) > 5 AND suffix(w, 'ies') THEN left(w, length(w) - 3) || 'y'
           WHEN length(w) > 5 AND suffix(w, 'ing') THEN left(w, length(w) - 3)
           WHEN length(w) > 4 AND suffix(w, 'ed') THEN left(w, length(w) - 2)
           WHEN length(w) > 3 AND suffix(w, 's') AND NOT suffix(w, 'ss') THEN left(w, length(w) - 1)
           ELSE w END)"""


def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def count(x: str) -> str:
    return f"len({words(x)})::BIGINT"


def sentences(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '([.!?])\s+([A-Z0-9(\[])', '\1' || chr(1) || '\2', 'g'), chr(1))"


def normalised(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def label(kind: str, number: str) -> str:
    return f"""(CASE rtrim(rtrim(lower({kind}), 's'), '.') WHEN 'fig' THEN 'Figure' WHEN 'figure' THEN 'Figure' WHEN 'table' THEN 'Table' ELSE 'Equation' END || ' ' || upper({number}))"""


def mentions(x: str) -> str:
    """A list of labels with repeats, in order."""
    m = quoted(T.MENTION)
    return f"list_transform(list_zip(regexp_extract_all({x}, {m}, 1), regexp_extract_all({x}, {m}, 2)), lambda p: {label('p[1]', 'p[2]')})"


def distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def strip_numbering(x: str) -> str:
    return f"trim(rtrim(trim(regexp_replace({x}, {quoted(T.NUMBERING)}, '')), ':'))"


def section_kind(x: str) -> str:
    t = f"trim(lower({strip_numbering(x)}), ' .:')"
    whens = " ".join(f"WHEN regexp_full_match({t}, {quoted(p)}) THEN '{k}'" for k, p in T.SECTION_KINDS.items())
    return f"CASE {whens} END"


_H = ", ".join(map(quoted, HEADINGS))
BLOCKS = f"""
lines AS (
  SELECT doc_id, i - 1 AS i, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE trim(line) <> ''
), sided AS (
  SELECT *, i // 20 AS page, i % 20 AS slot, CASE WHEN i % 7 = 0 THEN 'full' WHEN i % 2 = 0 THEN 'left' ELSE 'right' END AS col FROM lines
), body AS (
  SELECT doc_id, page, i AS ord, CASE WHEN col = 'right' THEN 316.0::DOUBLE ELSE 66.0 END AS x0, (60 + 34 * slot)::DOUBLE AS y0,
         CASE WHEN col = 'left' THEN 296.0::DOUBLE ELSE 546.0 END AS x1, (84 + 34 * slot)::DOUBLE AS y1,
         CASE WHEN i % 11 = 5 THEN ([{_H}])[(i // 11) % 6 + 1]
              WHEN i % 13 = 9 THEN 'Figure ' || (i % 4 + 1) || '. ' || line
              WHEN i % 5 = 3 THEN line || ' See Figure ' || (i % 4 + 1) || ' and Table ' || (i % 3 + 1) || '.'
              ELSE line END AS text,
         CASE WHEN i = 0 THEN 18.0::DOUBLE WHEN i % 11 = 5 THEN 12.0 WHEN i % 13 = 9 THEN 9.0 ELSE 10.0 END AS size,
         i = 0 OR i % 11 = 5 AS bold
  FROM sided
), blocks AS (
  SELECT * FROM body UNION ALL
  SELECT DISTINCT doc_id, page, 100000 + page, 66.0::DOUBLE, 10.0::DOUBLE, 546.0::DOUBLE, 20.0::DOUBLE, 'Running head ' || (page + 1), 8.0::DOUBLE, false FROM body
)"""

#: Blocks of ``from_close_lines``, with their captions, as ``close`` and ``marks``.
CLOSE = """
near_lines AS (
  SELECT doc_id, i - 1 AS i, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE trim(line) <> ''
), placed AS (
  SELECT *, i // 20 AS page, (i % 20) // 5 AS grp, i % 5 AS place, 60 + 165 * ((i % 20) // 5) AS base FROM near_lines
), boxed AS (
  SELECT *, CASE place WHEN 0 THEN base WHEN 1 THEN base + 34 WHEN 2 THEN base + 68 WHEN 3 THEN base + 82 + (doc_id + i) % 7 ELSE base + 94 + (doc_id + i - 1) % 7 + 2 * (i % 4) END AS y0,
         CASE WHEN place = 3 THEN 66 + 6 * (i % 3) ELSE 66 END AS x0
  FROM placed
), close AS (
  SELECT doc_id, page::BIGINT AS page, i::BIGINT AS ord, x0::DOUBLE AS x0, y0::DOUBLE AS y0, 546.0::DOUBLE AS x1,
         (y0 + CASE WHEN place < 2 THEN 24 WHEN place = 2 THEN 14 ELSE 12 END)::DOUBLE AS y1,
         CASE WHEN i % 20 = 0 THEN (['1. Introduction', '2 Methods', '3. Results', '4. Discussion', '5 Conclusion', 'Appendix'])[page % 6 + 1]
              WHEN place = 2 THEN CASE WHEN grp % 2 = 0 THEN 'Table ' ELSE 'Figure ' END || (i % 4 + 1) || '. ' || line
              WHEN i % 15 = 1 THEN line || ' = λ (' || (i % 7 + 1) || ')'
              WHEN i % 15 = 6 THEN line || ' See Figure ' || (i % 4 + 1) || ' and Table ' || (i % 3 + 1) || '.' ELSE line END AS text,
         CASE WHEN i % 20 = 0 THEN 12 WHEN place >= 2 THEN 9 ELSE 10 END AS size, i % 20 = 0 AS bold
  FROM boxed
), close_body AS (
  SELECT doc_id, arg_max(size, (chars, -seen)) AS body_size FROM (SELECT doc_id, size, sum(length(text)) AS chars, min(ord) AS seen FROM close GROUP BY doc_id, size) GROUP BY doc_id
), marks AS (
  SELECT *, regexp_extract(text, '(?i)^\\s*(Supplementary\\s+|Extended\\s+Data\\s+)?(Fig(?:ure)?|Table)s?\\.?\\s*(S?\\d{1,3})(?:([A-Za-z0-9])|\\s*([.:|–—-])?)', ['supp', 'kind', 'num', 'more', 'sep']) AS m
  FROM close JOIN close_body USING (doc_id)
), caps AS (
  SELECT * EXCLUDE (m), CASE WHEN lower(m.kind) LIKE 'fig%' THEN 'Figure' ELSE 'Table' END AS kind, upper(m.num) AS number FROM marks
  WHERE m.kind <> '' AND m.more = '' AND (m.sep <> '' OR size < body_size - 0.3)
)"""

#: The close blocks as ``blocks``, in the place of those above.
CLOSE_BLOCKS = CLOSE[: CLOSE.index(", close_body AS")] + ", blocks AS (SELECT * FROM close)"

_G = lambda k: f"regexp_extract(text, {quoted(layout.CAPTION)}, {k})"
_CAPTION = f"({_G(2)} <> '' AND {_G(4)} = '' AND ({_G(5)} <> '' OR bold OR size < body_size - 0.3))"

SIZED = f"""{BLOCKS}, sizes AS (
  SELECT doc_id, size, sum(length(text)) AS chars, min((page, ord)) AS seen FROM blocks GROUP BY doc_id, size
), body_sizes AS (
  SELECT doc_id, size AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, seen) AS n FROM sizes) WHERE n = 1
)"""

FURNITURE = f"""{SIZED}, keyed AS (
  SELECT *, (y1 < 0.08 * 792 OR y0 > 0.92 * 792) AS margin,
         CASE WHEN y1 < 0.08 * 792 OR y0 > 0.92 * 792 THEN substr(regexp_replace(lower(text), '\\d+', '#', 'g'), 1, 80) END AS fkey FROM blocks
), marked AS (
  SELECT *, margin AND (regexp_full_match(text, '\\W*\\d{{1,4}}\\W*')
         OR (max(page) OVER (PARTITION BY doc_id) + 1 >= 3
             AND count(*) OVER (PARTITION BY doc_id, fkey) >= greatest(2.0, 0.4 * (max(page) OVER (PARTITION BY doc_id) + 1)))) AS is_furniture
  FROM keyed
)"""

ROLES = f"""{FURNITURE}, role1 AS (
  SELECT marked.*, body_size, CASE WHEN is_furniture THEN 'furniture' WHEN {_CAPTION} THEN 'caption'
         WHEN regexp_extract(text, {quoted(layout.EQUATION)}, 2) <> '' AND {count("text")} <= 40 AND regexp_matches(regexp_extract(text, {quoted(layout.EQUATION)}, 1), '{layout.MATH}') THEN 'equation'
         ELSE 'body' END AS role,
         CASE WHEN x1 - x0 > 612 * 0.58 OR (x0 < 306 - 612 * 0.06 AND x1 > 306 + 612 * 0.06) THEN 'full' WHEN (x0 + x1) / 2 < 306 THEN 'left' ELSE 'right' END AS side
  FROM marked JOIN body_sizes USING (doc_id)
), role2 AS (
  SELECT *, sum(CASE WHEN side = 'left' THEN length(text) ELSE 0 END) OVER p > 0.2 * greatest(sum(length(text)) OVER p, 1)
        AND sum(CASE WHEN side = 'right' THEN length(text) ELSE 0 END) OVER p > 0.2 * greatest(sum(length(text)) OVER p, 1) AS two,
         coalesce(sum((side = 'full')::INT) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS band
  FROM role1 WINDOW p AS (PARTITION BY doc_id, page)
), roles AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN two THEN band ELSE 0 END,
         CASE WHEN NOT two THEN 0 WHEN side = 'left' THEN 0 WHEN side = 'right' THEN 1 ELSE 2 END, round(y0, 1), x0, ord) - 1 AS pos
  FROM role2
)"""

_T, _S = "trim(text)", strip_numbering("trim(text)")
_NUM = f"regexp_extract({_T}, {quoted(layout.NUMBERED)}, 1)"
_BARE = f"rtrim({_NUM}, '.)')"
_UP = lambda x: f"(upper({x}) = {x} AND lower({x}) <> {x})"
_DOTS = lambda x: f"(length({x}) - length(replace({x}, '.', '')) + 1)"

SECTIONED = f"""{ROLES}, heads1 AS (
  SELECT *, {section_kind(_T)} AS kind0, (bold OR size >= body_size * 1.08 OR ({_UP(_T)} AND {count(_T)} <= 6)) AS strong FROM roles
  WHERE role = 'body' AND {count(_T)} <= 14 AND length({_T}) >= 3
), heads2 AS (
  SELECT *, kind0 IS NOT NULL AND strong AND {count(_S)} <= 7 AND NOT regexp_matches({_T}, '[,;]$') AS named FROM heads1
), heads3 AS (
  SELECT *, CASE
      WHEN named THEN CASE WHEN {_NUM} <> '' AND regexp_matches({_T}, '^[0-9]') THEN {_DOTS(f"split_part({_T}, ' ', 1)")} ELSE 1 END
      WHEN {_NUM} <> '' AND strong AND NOT regexp_matches({_T}, '[.,;]$') AND {count(_T)} <= 12 THEN CASE WHEN regexp_matches({_BARE}, '^[0-9]') THEN {_DOTS(_BARE)} ELSE 1 END
      WHEN size >= body_size * 1.2 AND bold AND {count(_T)} <= 10 AND NOT regexp_matches({_T}, '[.,]$') THEN 1 END AS level0
  FROM heads2
), heads AS (
  SELECT doc_id, page, ord, least(level0, 3)::BIGINT AS level, {_S} AS title, coalesce(kind0, 'other') AS kind FROM heads3 WHERE level0 IS NOT NULL
), sec1 AS (
  SELECT r.doc_id, r.page, r.pos, r.ord, r.text, r.x0, r.y0, r.x1, r.y1, h.level AS hlevel, h.title, h.kind,
         last_value(CASE WHEN h.level = 1 THEN h.kind END IGNORE NULLS) OVER (PARTITION BY r.doc_id ORDER BY r.page, r.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top_kind
  FROM roles r LEFT JOIN heads h ON r.doc_id = h.doc_id AND r.page = h.page AND r.ord = h.ord WHERE r.role = 'body'
), sectioned AS (
  SELECT doc_id, page, pos, ord, text, x0, y0, x1, y1, hlevel IS NOT NULL AS is_heading,
         sum((hlevel IS NOT NULL)::INT) OVER w::BIGINT AS section_idx,
         coalesce(last_value(title IGNORE NULLS) OVER w, 'Front matter') AS section,
         coalesce(last_value(CASE WHEN hlevel > 1 AND kind = 'other' THEN coalesce(top_kind, 'other') ELSE kind END IGNORE NULLS) OVER w, 'front') AS section_kind,
         coalesce(last_value(hlevel IGNORE NULLS) OVER w, 0)::BIGINT AS level
  FROM sec1 WINDOW w AS (PARTITION BY doc_id ORDER BY page, pos ROWS UNBOUNDED PRECEDING)
)"""

PARAGRAPHS = f"""{SECTIONED}, par1 AS (
  SELECT * FROM sectioned WHERE NOT is_heading AND (length(text) >= 25 OR {count("text")} >= 4)
), par2 AS (
  SELECT *, NOT coalesce(NOT regexp_matches(lag(text) OVER w, '[.!?:;)"”]\\s*$') AND regexp_matches(text, '^\\p{{Ll}}'), false) AS starts
  FROM par1 WINDOW w AS (PARTITION BY doc_id, section_idx ORDER BY page, pos)
), par3 AS (
  SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id, section_idx ORDER BY page, pos ROWS UNBOUNDED PRECEDING)::BIGINT AS paragraph FROM par2
), paragraphs AS (
  SELECT doc_id, section_idx, section, section_kind, paragraph, min(page)::BIGINT AS page, string_agg(text, ' ' ORDER BY page, pos) AS text,
         first(x0 ORDER BY page, pos) AS x0, first(y0 ORDER BY page, pos) AS y0, first(x1 ORDER BY page, pos) AS x1, first(y1 ORDER BY page, pos) AS y1
  FROM par3 GROUP BY doc_id, section_idx, section, section_kind, paragraph
)"""

MENTION_SENTENCES = f"""{PARAGRAPHS}, sent AS (
  SELECT doc_id, section_idx, paragraph, unnest({sentences("text")}) AS sentence, generate_subscripts({sentences("text")}, 1) AS i
  FROM paragraphs WHERE section_kind NOT IN ('front', 'references')
), said AS (
  SELECT DISTINCT doc_id, section_idx, paragraph, i, sentence, unnest({mentions("sentence")}) AS label FROM sent WHERE {count("sentence")} <= 70
), nth AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY section_idx, paragraph, i) AS n FROM said WHERE NOT starts_with(lower(sentence), lower(label) || '.')
)"""


def split_long(source: str) -> str:
    """``<source>_pieces(id, i, piece)`` of ``<source>(id, text)``; for a recursive WITH."""
    return f"""{source}_s AS (
  SELECT id, text, {sentences("text")} AS s, {count("text")} AS words FROM {source}
), {source}_folded AS (
  SELECT id, s, 1 AS k, 0 AS piece, s[1] AS cur, {count("s[1]")} AS n FROM {source}_s WHERE words > 260
  UNION ALL
  SELECT id, s, k + 1, CASE WHEN n + w > 260 THEN piece + 1 ELSE piece END, CASE WHEN n + w > 260 THEN s[k] ELSE cur END || ' ' || s[k + 1], CASE WHEN n + w > 260 THEN {count("s[k]")} ELSE n END + w
  FROM (SELECT *, {count("s[k + 1]")} AS w FROM {source}_folded WHERE k < len(s))
), {source}_pieces AS (
  SELECT id, 0 AS i, text AS piece FROM {source}_s WHERE words <= 260 UNION ALL SELECT id, piece, arg_max(cur, k) FROM {source}_folded GROUP BY id, piece
)"""


#: ``chunks(doc_id, ord, page, section, section_kind, text, x0, y0, x1, y1)`` of ``paragraphs``; for a recursive WITH.
TEXT_CHUNKS = f"""paras AS (
  SELECT *, row_number() OVER () AS id FROM paragraphs WHERE section_kind NOT IN ('front', 'abstract', 'references')
), {split_long("paras")}, parts AS (
  SELECT doc_id, section_idx, section, section_kind, page, piece, {count("piece")} AS w, x0, y0, x1, y1, dense_rank() OVER (ORDER BY doc_id, section_idx, page) AS run,
         row_number() OVER (PARTITION BY doc_id, section_idx, page ORDER BY paragraph, i) AS n
  FROM paras JOIN paras_pieces USING (id)
), packed AS (
  SELECT run, n, 0 AS chunk, piece AS cur, w AS words, x0, y0, x1, y1 FROM parts WHERE n = 1
  UNION ALL
  SELECT p.run, p.n, CASE WHEN o.full THEN k.chunk + 1 ELSE k.chunk END, CASE WHEN o.anew THEN p.piece ELSE k.cur || ' ' || p.piece END, CASE WHEN o.full THEN 0 ELSE k.words END + p.w,
         CASE WHEN o.anew THEN p.x0 ELSE least(k.x0, p.x0) END, CASE WHEN o.anew THEN p.y0 ELSE least(k.y0, p.y0) END, CASE WHEN o.anew THEN p.x1 ELSE greatest(k.x1, p.x1) END, CASE WHEN o.anew THEN p.y1 ELSE greatest(k.y1, p.y1) END
  FROM packed k JOIN parts p ON p.run = k.run AND p.n = k.n + 1, LATERAL (SELECT k.words > 0 AND k.words + p.w > 260 AS full, k.words = 0 OR k.words + p.w > 260 AS anew) o
), closed AS (
  SELECT DISTINCT ON (run, chunk) * FROM packed ORDER BY run, chunk, n DESC
), grouped AS (
  SELECT *, sum((chunk = 0 OR words >= 30)::INT) OVER (PARTITION BY run ORDER BY chunk ROWS UNBOUNDED PRECEDING) AS grp FROM closed
), joined_chunks AS (
  SELECT run, grp, trim(string_agg(cur, ' ' ORDER BY chunk)) AS text, first(x0 ORDER BY chunk) AS x0, first(y0 ORDER BY chunk) AS y0, first(x1 ORDER BY chunk) AS x1, first(y1 ORDER BY chunk) AS y1 FROM grouped GROUP BY ALL
), chunks AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_idx, page, grp) - 1 AS ord, page, section, section_kind, text, x0, y0, x1, y1
  FROM joined_chunks JOIN (SELECT DISTINCT run, doc_id, section_idx, section, section_kind, page FROM parts) USING (run)
)"""


def bm25(query: str) -> str:
    """``scored(id, score)``, of documents."""
    return f"""terms AS (
  SELECT doc_id AS id, {tokens("text")} AS terms FROM documents
), asked AS (
  SELECT DISTINCT unnest({tokens(quoted(query))}) AS term
), stats AS (
  SELECT count(*) AS n, avg(len(terms)) AS avg_length FROM terms
), tf AS (
  SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(terms) AS length, unnest(terms) AS term FROM terms) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), idf AS (
  SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf, avg_length FROM tf, stats GROUP BY term, n, avg_length
), scored AS (
  SELECT id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg_length))) AS score FROM tf JOIN idf USING (term) GROUP BY id
)"""


def fused(query: str, where: str = "true") -> str:
    """``fused(id, dense_rank, sparse_rank, score)`` of documents and embeddings."""
    return f"""{bm25(query)}, asked_vector AS (
  SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0
), dense AS (
  SELECT vec_id AS id, label, list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda p: p[1] * p[2])) AS score FROM embeddings, asked_vector
), dense_ranked AS (
  SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS dense_rank FROM dense WHERE {where} QUALIFY dense_rank < 30
), sparse_ranked AS (
  SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS sparse_rank FROM scored LEFT JOIN embeddings ON id = vec_id WHERE {where.replace("label", "coalesce(label, -1)")} QUALIFY sparse_rank < 30
), fused AS (
  SELECT id, dense_rank, sparse_rank, coalesce(1.0::DOUBLE / (60 + dense_rank + 1), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank + 1), 0) AS score
  FROM dense_ranked FULL JOIN sparse_ranked USING (id)
)"""
