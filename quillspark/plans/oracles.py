"""DuckDB SQL for the registered queries, written apart from the Spark plans."""

from __future__ import annotations

from quillspark.functions.contacts import MONTHS
from quillspark.functions.language import FREQUENT
from quillspark.functions.metrics import PUNCTUATION
from quillspark.functions.text import KEPT_ABBREVIATIONS, SIGNATURE_LABEL
from quillspark.operators.spelling import CONFUSED
from quillspark.plans.fixtures import DUCK, GRID_COLUMNS, GRID_ROWS

ORACLES: dict[str, str] = {}
K = "doc_id, page_no, elem_idx"
W = r"[\p{L}\p{N}_]"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def strip(x: str) -> str:
    return sub(x, r"^\s+|\s+$", "")


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def add(name: str, select: str, more: str = "", recursive: bool = False) -> None:
    ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{DUCK}{', ' + more if more else ''} {select}"


def underscores(x: str) -> str:
    return sub(sub(sub(sub(x, r"(_\s+){2,}_", "___"), "_{3,}", "___"), r"(:\s*)\s{3,}", r"\1___"), " {2,}", " ")


def encoding(x: str) -> str:
    return f"replace(translate({x}, '\u00a0\u2018\u2019\u201c\u201d\u2013\u2014', ' ''''\"\"--'), '\u2026', '...')"


def clean(x: str) -> str:
    return f"trim({sub(sub(encoding(x), '<[^>]+>', ''), chr(92) + 's+', ' ')})"


KEPT = str(KEPT_ABBREVIATIONS)


def period(x: str) -> str:
    t = rf"regexp_replace({x}, '\s+$', '')"
    cut = f"substr({t}, 1, length({t}) - 1)"
    last = rf"lower(regexp_extract({cut}, '(\S+)\s*$', 1))"
    return rf"CASE WHEN ends_with({t}, ' .') THEN regexp_replace(substr({t}, 1, length({t}) - 2), '\s+$', '') WHEN ends_with({t}, '.') THEN CASE WHEN {last} IN {KEPT} OR {has(last, '^' + chr(92) + 'pL$')} THEN {t} ELSE {cut} END ELSE {t} END"


def parenthesis(x: str) -> str:
    more = f"length({x}) - length(replace({x}, ')', '')) > length({x}) - length(replace({x}, '(', ''))"
    return f"CASE WHEN {more} THEN {sub(x, chr(92) + 'b([a-zA-Z]{2,}?)([Ee][Ss]|[Ss])' + chr(92) + ')', chr(92) + '1(' + chr(92) + '2)')} ELSE {x} END"


def shown(x: str) -> str:
    t = strip(sub(f"coalesce({x}, '')", r"\n|<br>", " "))
    return f"CASE WHEN length({t}) > 35 THEN substr({t}, 1, 34) || '\u2026' ELSE {t} END"


add("n_scalars", f"SELECT {K}, {underscores('content')} AS underscores, {sub('content', '<[^>]+>', '')} AS markup, {encoding('content')} AS encoding, {clean('content')} AS cleaned, {period('content')} AS period, {parenthesis('content')} AS parenthesis, {shown('content')} AS shown FROM texts")

_spaced = f"'( ' || {sub('content', '([.,;:])', ' ' + chr(92) + '1 ')} || ' ) it ''s self - made'"
for _p, _r in (
    (r"\s+([.,;:!?])", r"\1"),
    (r"([(\[{])\s+", r"\1"),
    (r"\s+([)\]}])", r"\1"),
    (r"([!?.,;:])\s+([!?.,;:])", r"\1\2"),
    (rf"({W})\s+-\s+({W})", r"\1-\2"),
    (rf"({W})\s+''\s*({W})", r"\1''\2"),
    (rf"({W})\s+''", r"\1''"),
    (rf"''\s+({W})", r"''\1"),
    (" {2,}", " "),
):
    _spaced = sub(_spaced, _p, _r)
add("n3_punctuation_spacing", f"SELECT {K}, {strip(_spaced)} AS spaced FROM texts")


def dash(x: str) -> tuple[str, str]:
    """(fixed, skip); without look-around, so neighbours are matched and put back."""
    dotted = sub(x, "\u2022(\\d)", r".\1")
    skip = f"({has(dotted, chr(92) + 'd{1,2}[/-]' + chr(92) + 'd{1,2}[/-]' + chr(92) + 'd{2,4}')} OR {has(dotted, chr(92) + '(?' + chr(92) + 'd{3}' + chr(92) + ')?[-.' + chr(92) + 's]' + chr(92) + 'd{3}[-.' + chr(92) + 's]' + chr(92) + 'd{4}')})"
    once = lambda y: sub(y, r"(^|\s)-(\d{2,4})(\s|$|[,;:!?)\]])", r"\1.\2\3")
    return f"CASE WHEN {skip} THEN {dotted} ELSE {sub(once(once(dotted)), '([A-Z]{2,})-(' + chr(92) + 'd{2,4})([^0-9/a-zA-Z-]|$)', chr(92) + '1.' + chr(92) + '2' + chr(92) + '3')} END", skip


_f, _s = dash("c")
add("n7_decimal_dash", f"SELECT {K}, {_f} AS fixed, NOT {_s} AND ({_f}) <> c AS repaired FROM (SELECT *, content || ' \u20225' AS c FROM texts) q")


def deduplicated(x: str) -> tuple[str, str]:
    w = words(x)
    kept = f"list_filter({w}, lambda v, i: i = 1 OR lower(v) <> lower(({w})[i - 1]))"
    removed = f"(len({w}) - len({kept}))"
    return f"CASE WHEN {removed} > 0 THEN array_to_string({kept}, ' ') ELSE {x} END", removed


_t, _n = deduplicated("content")
add("n9_duplicate_words", f"SELECT {K}, {_t} AS deduplicated, {_n}::INT AS removed FROM texts")


def cased(shape: str, text: str) -> str:
    a, b = words(shape), words(text)
    upper = lambda v: f"upper(replace({v}, 'ß', 'SS'))"
    letters = lambda v: sub(v, r"[^\p{L}]", "")
    by_word = f"array_to_string(list_transform(range(1, len({a}) + 1), lambda i: CASE WHEN {has(letters(f'({a})[i]'), '^' + chr(92) + 'p{Lu}+$')} THEN {upper(f'({b})[i]')} ELSE ({b})[i] END), ' ')"
    share = f"length({sub(shape, '[^' + chr(92) + 'p{Lu}]', '')}) / nullif(length({letters(shape)}), 0)"
    return f"CASE WHEN len({a}) = 0 THEN {text} WHEN len({a}) = len({b}) THEN {by_word} WHEN {share} >= 0.70 THEN {upper(text)} ELSE {text} END"


add("n10_case_transfer", f"SELECT {K}, {cased('content', 'r')} AS cased FROM (SELECT *, CASE WHEN g % 4 = 0 THEN lower(content) || ' extra' ELSE lower(content) END AS r FROM texts) q")

# --- geometry


def overlap(a: str, b: str, over: str) -> str:
    w, h = f"(least({a}x2, {b}x2) - greatest({a}x1, {b}x1))", f"(least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
    areas = [f"(({p}x2 - {p}x1) * ({p}y2 - {p}y1))" for p in (a, b)]
    whole = {"least": f"least({areas[0]}, {areas[1]})", "a": areas[0], "b": areas[1]}[over]
    need = f"{areas[0]} > 0 AND {areas[1]} > 0" if over == "least" else f"{whole} > 0"
    return f"CASE WHEN {w} > 0 AND {h} > 0 AND {need} THEN {w} * {h} / {whole} ELSE 0.0 END"


def touching(a: str, b: str) -> str:
    return f"({a}x1 < {b}x2 AND {a}x2 > {b}x1 AND {a}y1 < {b}y2 AND {a}y2 > {b}y1)"


def too_large(label: str, w: float, h: float) -> str:
    bw, bh = f"(least({w}, x2) - greatest(0, x1))", f"(least({h}, y2) - greatest(0, y1))"
    limit = f"CASE lower({label}) WHEN 'human face' THEN 0.10 WHEN 'signature' THEN 0.25 WHEN 'logo' THEN 0.30 ELSE 0.50 END"
    return f"CASE WHEN {bw} <= 0 OR {bh} <= 0 THEN TRUE ELSE {bw} * {bh} / ({w} * {h}) > {limit} END"


add("g_page_size", "SELECT doc_id, page_no, greatest(max(x2), 500.0) AS width, greatest(max(y2), 400.0) AS height FROM elements GROUP BY ALL")
add("g_overlaps", f"SELECT a.doc_id, a.page_no, a.elem_idx, b.elem_idx AS o_idx, round({overlap('a.', 'b.', 'least')}, 6) AS of_smaller, round({overlap('a.', 'b.', 'a')}, 6) AS of_first, {touching('a.', 'b.')} AS touching FROM elements a JOIN elements b USING (doc_id, page_no) WHERE a.type = 'text' AND b.type <> 'text'")

_WORDS = f"""
src AS (SELECT {K}, x1, y1, x2, y2, {words('content')} AS w FROM texts),
sized AS (SELECT *, (x2 - x1) / (list_sum(list_transform(w, lambda v: greatest(length(v), 1)))::DOUBLE + (len(w) - 1) * 0.5) AS unit FROM src WHERE len(w) > 0),
wb AS (SELECT {K}, x1, y1, x2, y2, w, unit, 0 AS i, x1 AS a, CASE WHEN len(w) = 1 THEN x2 ELSE least(x1 + greatest(greatest(length(w[1]), 1) * unit, 10.0), x2) END AS b FROM sized
  UNION ALL SELECT {K}, x1, y1, x2, y2, w, unit, i + 1, b + 0.5 * unit, least(b + 0.5 * unit + greatest(greatest(length(w[i + 2]), 1) * unit, 10.0), x2) FROM wb WHERE i + 1 < len(w))"""
add("g5_word_boxes", f"SELECT {K}, i, w[i + 1] AS word, round(a, 4) AS x1, round(b, 4) AS x2 FROM wb", _WORDS, True)
add("g6_too_large", f"SELECT {K}, type, {too_large('type', 612.0, 340.0)} AS too_large FROM elements")
add("i2_padded_boxes", f"SELECT {K}, greatest(0.0, x1 - 12) AS x1, greatest(0.0, y1 - 12) AS y1, least(612.0, x2 + 12) AS x2, least(792.0, y2 + 12) AS y2 FROM texts")

# --- scores

_A, _B = r"(\d{3})", r"(\d{4})"
_D = r"\d{1,2}"
_VALID = (
    "^[a-zA-Z0-9][)]$", "^[&*@#]+[.,:;]?$", r"^\.\d+$", "^[A-Z]{2,}$", "^[A-Z][a-z]+$", r"^[A-Z][a-z]*[.]?\s*$", "(?i)^[A-Z]{2,}$", "(?i)^[A-Z]+[.,;:!?]?$",
    rf"^{_D}[-/.]{_D}[-/.]\d{{2,4}}$", r"^\d+[.,]?\d*$", "^[$\u00a3\u20ac]\\d+[.,]?\\d*$", rf"^\({_A}\)\s*{_A}[-\s]?{_B}$", r"(?i)^[\w.%+-]+@[a-z0-9.-]+\.[a-z]{2,}$", "(?i)^https?://", r"(?i)^www\.",
)


def scored(table: str, width: str) -> str:
    """A subquery over a table of elements that adds pattern, patterns, valid, repeats, score and signals."""
    valid = " OR ".join(has("s", p) for p in _VALID)
    lw = words("lower(content)")
    names = lambda *xs: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in xs) + "], lambda z: z IS NOT NULL), '|')"
    pats = (("same", "all_same_char"), ("digits", "isolated_digits"), ("numbers", "short_numbers"), ("punct", "only_punctuation"), ("unusual", "unusual_chars"), ("yr", "isolated_year"), ("cmd", "latex_command"))
    every = (("conf < 0.50", "very_low_confidence"), ("conf >= 0.50 AND conf < 0.70", "low_confidence"), ("n <= 2", "very_short"), ("n > 2 AND n <= 4", "short"), *pats, ("tiny", "tiny_bbox"), ("tall", "abnormal_aspect"), ("NOT valid", "not_valid_text"), ("repeats", "repetition"), ("edge AND n <= 4", "margin_fragment_short"), ("edge AND n > 4", "margin_position"))
    return rf"""(SELECT *, {names(*pats)} AS patterns, {names(*every)} AS signals,
  least(0.0::DOUBLE + (CASE WHEN conf < 0.50 THEN 0.15 WHEN conf < 0.70 THEN 0.10 WHEN conf < 0.85 THEN 0.05 ELSE 0.0 END)::DOUBLE + (CASE WHEN n <= 2 THEN 0.10 WHEN n <= 4 THEN 0.06 ELSE 0.0 END)::DOUBLE + pattern * 0.25::DOUBLE
   + (CASE WHEN tiny THEN 0.15 WHEN tall THEN 0.10 ELSE 0.0 END)::DOUBLE + (CASE WHEN NOT valid THEN 0.15 ELSE 0.0 END)::DOUBLE + (CASE WHEN repeats THEN 0.10 ELSE 0.0 END)::DOUBLE + (CASE WHEN edge THEN CASE WHEN n <= 4 THEN 0.25 ELSE 0.10 END ELSE 0.0 END)::DOUBLE, 1.0::DOUBLE) AS score
 FROM (SELECT *, least(0.0::DOUBLE + (CASE WHEN same THEN 0.8 ELSE 0.0 END)::DOUBLE + (CASE WHEN digits THEN 0.30 WHEN numbers THEN 0.35 ELSE 0.0 END)::DOUBLE + (CASE WHEN punct THEN 0.6 ELSE 0.0 END)::DOUBLE + (CASE WHEN unusual THEN 0.3 ELSE 0.0 END)::DOUBLE + (CASE WHEN yr THEN 0.25 ELSE 0.0 END)::DOUBLE + (CASE WHEN cmd THEN 0.5 ELSE 0.0 END)::DOUBLE, 1.0::DOUBLE) AS pattern,
   h > 0 AND NOT tiny0 AND wd > 0 AND h / nullif(wd, 0) > 5 AS tall, tiny0 AS tiny
  FROM (SELECT *, solid <> '' AND replace(solid, substr(solid, 1, 1), '') = '' AND length(content) > 2 AS same, {has('s', '^' + chr(92) + 'd+$')} AND n <= 3 AS digits,
    NOT ({has('s', '^' + chr(92) + 'd+$')} AND n <= 3) AND {has('s', '^[' + chr(92) + 'd' + chr(92) + 's]+$')} AND n <= 4 AS numbers, {has('solid', "^[.,;:!?" + chr(92) + "-_'']*$")} AS punct,
    {has('content', '[^' + chr(92) + 'x{00}-' + chr(92) + 'x{7F}' + chr(92) + 'x{C0}-' + chr(92) + 'x{24F}' + chr(92) + 'x{1E00}-' + chr(92) + 'x{1EFF}]')} AS unusual, {has('s', '^(19|20)' + chr(92) + 'd{2}s?$')} AS yr, {has('s', '^' + chr(92) * 2 + '[a-zA-Z]{2,}$')} AS cmd,
    (wd < 20 OR h < 10) AND n > 2 AS tiny0,
    CASE WHEN s = '' THEN FALSE WHEN n = 1 THEN {has('s', '^[' + chr(92) + 'p{L}' + chr(92) + 'p{N}#.,;:!?()' + chr(92) + '[' + chr(92) + ']{}"' + "''" + ']$')} ELSE {valid} OR (contains(s, ' ') AND n > 5) OR length({sub('s', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]', '')}) / n > 0.7 END AS valid,
    len(lw) >= 2 AND (len(list_filter(lw, lambda v, i: i > 1 AND v = lw[i - 1] AND length(v) > 1)) > 0 OR (len(list_distinct(lw)) = 1 AND len(lw) > 2)) AS repeats,
    ((x1 < pw * 0.03 AND x2 < pw * 0.10) OR (x1 > pw * (1 - 0.10::DOUBLE) AND x2 > pw * (1 - 0.03::DOUBLE))) AND NOT {has('s', '^' + chr(92) + 'd+$')} AS edge
   FROM (SELECT *, coalesce(confidence, 1.0) AS conf, {strip('content')} AS s, length({strip('content')}) AS n, replace(content, ' ', '') AS solid, x2 - x1 AS wd, y2 - y1 AS h, {lw} AS lw, {width} AS pw FROM {table}) z1) z2) z3)"""


add("h_scores", f"SELECT {K}, round(score, 6) AS score, signals, round(pattern, 6) AS pattern_score, patterns, valid, repeats FROM {scored('texts', '612.0')} q")

_NUMERIC = f"""
sizes AS (SELECT doc_id, page_no, max(x2) AS pw FROM elements GROUP BY ALL),
cand AS (SELECT e.*, (x1 + x2) / 2 AS xc, pw * 0.03 AS tol FROM elements e JOIN sizes USING (doc_id, page_no) WHERE type = 'text' AND length({strip('content')}) <= 4 AND {has(strip('content'), '^[' + chr(92) + 'd.,]+%?$')}),
isl AS (SELECT *, sum(CASE WHEN gap > tol THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY xc, elem_idx ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, xc - lag(xc) OVER (PARTITION BY doc_id, page_no ORDER BY xc, elem_idx) AS gap FROM cand) q),
reach AS (SELECT doc_id, page_no, c, min(xc) - any_value(tol) AS lo, max(xc) + any_value(tol) AS hi FROM isl GROUP BY ALL HAVING count(*) >= 3),
numeric AS (SELECT DISTINCT {K} FROM cand JOIN reach USING (doc_id, page_no) WHERE xc BETWEEN lo AND hi)"""
add("h2_numeric_columns", f"SELECT {K} FROM numeric", _NUMERIC)

# --- steps

_corner = lambda i, c: f"CASE WHEN g % 11 IN (0, 1) THEN NULL ELSE {c} END AS {c}"
add("step0_sanitize", f"SELECT {K}, CASE WHEN g % 13 <> 0 THEN type ELSE 'unknown' END AS type, content, {', '.join(_corner(0, c) for c in ('x1', 'y1', 'x2', 'y2'))}, CASE g % 7 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE confidence END AS confidence FROM elements")
add("step1_filter_empty_regions", f"SELECT {K}, type FROM elements e WHERE type NOT IN ('table', 'layout_region') OR EXISTS (SELECT 1 FROM texts t WHERE t.doc_id = e.doc_id AND t.page_no = e.page_no AND {overlap('e.', 't.', 'least')} >= 0.3)")
_has = "type = 'text' AND content <> ''"
add("step2_underscore_fields", f"SELECT {K}, CASE WHEN {_has} THEN {strip(underscores('content'))} ELSE content END AS content FROM elements")


def islands(x: str, tol: str, name: str) -> str:
    order = f"OVER (PARTITION BY doc_id, page_no, t_idx ORDER BY {x}, elem_idx"
    return f"sum(CASE WHEN {name}_gap > {tol} THEN 1 ELSE 0 END) {order} ROWS UNBOUNDED PRECEDING) AS {name}"


_MEASURES = f"""
pw AS (SELECT doc_id, page_no, max(x2) / 1000.0 AS k FROM elements GROUP BY ALL),
pairs AS (SELECT e.doc_id, e.page_no, e.elem_idx AS t_idx, coalesce(e.confidence, 0.5) AS conf, k, (e.x2 - e.x1) * (e.y2 - e.y1) AS area, t.elem_idx, t.x1, t.y1, t.x2, t.y2
  FROM elements e JOIN texts t USING (doc_id, page_no) JOIN pw USING (doc_id, page_no) WHERE e.type = 'table' AND {overlap('e.', 't.', 'least')} >= 0.3),
gaps AS (SELECT *, x1 - lag(x1) OVER (PARTITION BY doc_id, page_no, t_idx ORDER BY x1, elem_idx) AS c_gap, y1 - lag(y1) OVER (PARTITION BY doc_id, page_no, t_idx ORDER BY y1, elem_idx) AS r_gap FROM pairs),
runs AS (SELECT *, {islands('x1', '40 * k', 'c')}, {islands('y1', '15 * k', 'r')} FROM gaps),
cols AS (SELECT doc_id, page_no, t_idx, c, avg(x1) AS cx FROM runs GROUP BY ALL), rws AS (SELECT doc_id, page_no, t_idx, r, avg(y1) AS cy FROM runs GROUP BY ALL),
nearc AS (SELECT doc_id, page_no, t_idx, elem_idx, arg_min(c, (abs((x1 + x2) / 2 - cx), c)) AS c FROM pairs JOIN cols USING (doc_id, page_no, t_idx) WHERE abs((x1 + x2) / 2 - cx) < 80 * k GROUP BY ALL),
nearr AS (SELECT doc_id, page_no, t_idx, elem_idx, arg_min(r, (abs((y1 + y2) / 2 - cy), r)) AS r FROM pairs JOIN rws USING (doc_id, page_no, t_idx) WHERE abs((y1 + y2) / 2 - cy) < 30 * k GROUP BY ALL),
occ AS (SELECT doc_id, page_no, t_idx, count(DISTINCT (c, r)) AS n FROM nearc JOIN nearr USING (doc_id, page_no, t_idx, elem_idx) GROUP BY ALL),
base AS (SELECT doc_id, page_no, t_idx, any_value(conf) AS conf, least(sum(CASE WHEN x2 > x1 AND y2 > y1 THEN (x2 - x1) * (y2 - y1) ELSE 0 END) / any_value(area), 1.0) AS density, (max(c) + 1)::INT AS nc, (max(r) + 1)::INT AS nr FROM runs GROUP BY ALL),
cov AS (SELECT base.*, CASE WHEN nc < 2 OR nr < 2 THEN 0.0 ELSE coalesce(n, 0) / (nc * nr) END AS coverage FROM base LEFT JOIN occ USING (doc_id, page_no, t_idx)),
measures AS (SELECT doc_id, page_no, t_idx AS elem_idx, density, nc, nr, coverage,
  (CASE WHEN nc >= 3 THEN 40 WHEN nc = 2 THEN 25 ELSE 0 END + CASE WHEN nr >= 3 THEN 25 WHEN nr = 2 THEN 15 ELSE 0 END + CASE WHEN coverage >= 0.3 THEN 20 WHEN coverage >= 0.15 THEN 10 ELSE 0 END + CASE WHEN density BETWEEN 0.03 AND 0.80 THEN 10 ELSE 0 END + CASE WHEN conf >= 0.95 THEN 5 ELSE 0 END)::DOUBLE AS structure_score,
  array_to_string(list_filter([CASE WHEN nc >= 2 THEN 'columns:' || nc ELSE 'single_column' END, CASE WHEN nr >= 2 THEN 'rows:' || nr ELSE 'few_rows' END, CASE WHEN coverage >= 0.15 THEN 'grid_coverage:' ELSE 'sparse_grid:' END || round(coverage * 100)::INT || '%',
   CASE WHEN density BETWEEN 0.03 AND 0.80 THEN 'density_ok:' ELSE 'density_bad:' END || round(density * 100, 1)::DECIMAL(12, 1) || '%', CASE WHEN conf >= 0.95 THEN 'high_confidence' END], lambda z: z IS NOT NULL), '|') AS signals FROM cov)"""
add("step3_table_measures", f"SELECT {K}, round(density, 6) AS density, nc AS num_columns, nr AS num_rows, round(coverage, 6) AS grid_coverage, structure_score, signals FROM measures", _MEASURES)
add("step3_filter_tables", f"SELECT {K}, type, structure_score FROM elements LEFT JOIN measures USING ({K}) WHERE type <> 'table' OR structure_score >= 50", _MEASURES)
add("step4_deduplicate_layout", f"SELECT {K}, type FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, type, round(x1, 2), round(y1, 2), round(x2, 2), round(y2, 2) ORDER BY elem_idx) AS n FROM elements) q WHERE type <> 'layout_region' OR n = 1")
_EXEMPT = f"EXISTS (SELECT 1 FROM elements t WHERE t.type = 'table' AND t.doc_id = e.doc_id AND t.page_no = e.page_no AND {touching('e.', 't.')})"
add(
    "step5_hallucinations",
    f"SELECT {K}, type, coalesce(NOT exempt AND score > 0.30, FALSE) AS flagged, CASE WHEN NOT exempt AND score > 0.30 THEN round(score, 3) END AS hallucination_score, CASE WHEN NOT exempt AND score > 0.30 THEN signals END AS signals FROM ("
    f"SELECT s.*, {_EXEMPT.replace('e.', 's.').replace('typs.', 'type.')} OR nu.doc_id IS NOT NULL AS exempt FROM {scored('sized_texts', 'page_w')} s LEFT JOIN numeric nu USING ({K})) q WHERE exempt OR score < 0.50 UNION ALL SELECT {K}, type, FALSE, NULL, NULL FROM elements WHERE type <> 'text'",
    _NUMERIC + ", sized_texts AS (SELECT t.*, pw AS page_w FROM texts t JOIN sizes USING (doc_id, page_no))",
)
add("step6_rotated_margin", f"SELECT {K}, type FROM (SELECT *, max(x2) OVER (PARTITION BY doc_id, page_no) AS pw FROM elements) q WHERE NOT (type = 'text' AND x1 > pw * 0.92 AND x2 - x1 < pw * 0.04 AND NOT ({has(strip('content'), '^' + chr(92) + 'd{3,}$')}))")
add("step7_clean_text", f"SELECT {K}, CASE WHEN type = 'text' THEN {clean('content')} ELSE content END AS content FROM elements")
_TYPED = "typed AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'typed' WHEN 1 THEN 'mixed' ELSE 'handwritten' END AS document_type FROM elements)"
add(
    "step8_classification_override",
    f"SELECT doc_id, page_no, CASE WHEN o THEN 'handwritten' ELSE document_type END AS document_type, CASE WHEN o THEN document_type END AS original, CASE WHEN o THEN 'trocr_majority' END AS reason, CASE WHEN o THEN round(share, 2) END AS trocr_ratio FROM (SELECT doc_id, page_no, document_type, share, coalesce(share >= 0.5 AND document_type <> 'handwritten', FALSE) AS o FROM (SELECT doc_id, page_no, document_type, avg(CASE WHEN type = 'text' AND {strip('content')} <> '' THEN (source_model = 'trocr')::INT END) AS share FROM typed GROUP BY ALL) a) b",
    _TYPED,
)
add("step9_trailing_periods", f"SELECT {K}, CASE WHEN {_has} AND source_model = 'trocr' AND document_type <> 'handwritten' THEN {period('content')} ELSE content END AS content FROM typed", _TYPED)
_f, _s = dash("content")
add("step10_decimal_dashes", f"SELECT {K}, CASE WHEN gate AND {_has} THEN {_f} ELSE content END AS content, coalesce(gate AND {_has} AND NOT {_s} AND ({_f}) <> content, FALSE) AS repaired FROM (SELECT *, coalesce(bool_or({_has} AND {has('content', chr(92) + 'b' + chr(92) + 'd+' + chr(92) + '.' + chr(92) + 'd+' + chr(92) + 'b')}) OVER (PARTITION BY doc_id, page_no), FALSE) AS gate FROM elements) q")
add("step11_parentheses", f"SELECT {K}, CASE WHEN {_has} THEN {parenthesis('content')} ELSE content END AS content FROM elements")
_SIGN = SIGNATURE_LABEL.replace("(?iU)", "(?i)").replace("(?=", "(")
add("step13_signature_text", f"SELECT {K}, CASE WHEN {_has} THEN {sub('content', _SIGN, chr(92) + '1 (signature)' + chr(92) + '3')} ELSE content END AS content FROM elements")
_one = f"type = 'text' AND len({words('content')}) = 1 AND NOT {has('regexp_replace(' + strip('content') + ', ' + chr(39) + '[.,]+$' + chr(39) + ', ' + chr(39) * 2 + ')', '^' + chr(92) + 'd{1,2}[-/][[:alpha:]]{3,9}[-/]' + chr(92) + 'd{2,4}$|^' + chr(92) + 'd{1,2}[-/]' + chr(92) + 'd{1,2}[-/]' + chr(92) + 'd{2,4}$')}"
add("step14_signature_garbage", f"SELECT {K}, type FROM elements e WHERE NOT coalesce({_one}, FALSE) OR NOT EXISTS (SELECT 1 FROM elements s WHERE lower(s.type) = 'signature' AND s.doc_id = e.doc_id AND s.page_no = e.page_no AND {overlap('e.', 's.', 'least')} > 0.5)")
_t, _n = deduplicated("content")
add("step15_duplicate_words", f"SELECT {K}, CASE WHEN {_has} AND source_model = 'trocr' THEN {_t} ELSE content END AS content, CASE WHEN {_has} AND source_model = 'trocr' AND {_n} > 0 THEN {_n}::INT END AS duplicate_words_removed FROM elements")


def _lines(boxes: list, low: int, high: int, outer: tuple[str, str]) -> str:
    values = ", ".join(f"({b[low]}::DOUBLE, {b[high]}::DOUBLE)" for b in boxes)
    n = len(boxes)
    half = f"(SELECT list_sort(list(hi - lo))[{n // 2 + 1}] FROM (VALUES {values}) v(lo, hi)) / 2"
    return (
        f"SELECT (row_number() OVER (ORDER BY lo) - 1)::INT AS i, CASE WHEN lag(hi) OVER (ORDER BY lo) IS NULL THEN greatest(lo - {half}, {outer[0]}) ELSE (lag(hi) OVER (ORDER BY lo) + lo) / 2 END AS a, "
        f"CASE WHEN lead(lo) OVER (ORDER BY lo) IS NULL THEN least(hi + {half}, {outer[1]}) ELSE (hi + lead(lo) OVER (ORDER BY lo)) / 2 END AS b FROM (VALUES {values}) v(lo, hi)"
    )


_h = GRID_ROWS[0]
_CELLS = (
    _WORDS
    + f""", rr AS ({_lines(GRID_ROWS, 1, 3, ('20.0', '300.0'))}), cc AS ({_lines(GRID_COLUMNS, 0, 2, ('30.0', '600.0'))}),
tabs AS (SELECT doc_id, page_no, elem_idx AS t_idx, x1, y1, x2, y2 FROM elements WHERE type = 'table' AND elem_idx = 100),
hits AS (SELECT wb.doc_id, wb.page_no, t_idx, wb.elem_idx, wb.i, wb.w[wb.i + 1] AS word, min(rr.i) AS row, min(cc.i) AS col FROM wb JOIN tabs t USING (doc_id, page_no) JOIN rr ON round(rr.a, 2) <= (wb.y1 + wb.y2) / 2 AND (wb.y1 + wb.y2) / 2 <= round(rr.b, 2) JOIN cc ON round(cc.a, 2) <= (wb.a + wb.b) / 2 AND (wb.a + wb.b) / 2 <= round(cc.b, 2)
  WHERE {overlap('t.', 'wb.', 'least')} >= 0.5 GROUP BY ALL),
filled AS (SELECT doc_id, page_no, t_idx, row, col, string_agg(word, ' ' ORDER BY elem_idx, i) AS content FROM hits GROUP BY ALL),
cells AS (SELECT doc_id, page_no, t_idx, rr.i AS row, cc.i AS col, round(cc.a, 2) AS x1, round(rr.a, 2) AS y1, round(cc.b, 2) AS x2, round(rr.b, 2) AS y2, {_h[0]} < cc.b AND {_h[2]} > cc.a AND {_h[1]} < rr.b AND {_h[3]} > rr.a AS is_header, coalesce(content, '') AS content FROM tabs CROSS JOIN rr CROSS JOIN cc LEFT JOIN filled f USING (doc_id, page_no, t_idx) WHERE f.doc_id IS NULL OR (f.row = rr.i AND f.col = cc.i)),
grid AS (SELECT tabs.doc_id, tabs.page_no, tabs.t_idx, rr.i AS row, cc.i AS col, round(cc.a, 2) AS x1, round(rr.a, 2) AS y1, round(cc.b, 2) AS x2, round(rr.b, 2) AS y2, {_h[0]} < cc.b AND {_h[2]} > cc.a AND {_h[1]} < rr.b AND {_h[3]} > rr.a AS is_header FROM tabs CROSS JOIN rr CROSS JOIN cc),
full_grid AS (SELECT g.*, coalesce(f.content, '') AS content FROM grid g LEFT JOIN filled f ON f.doc_id = g.doc_id AND f.page_no = g.page_no AND f.t_idx = g.t_idx AND f.row = g.row AND f.col = g.col),
moved AS (SELECT doc_id, page_no, t_idx AS elem_idx, min(elem_idx) AS dest FROM (SELECT doc_id, page_no, t_idx, elem_idx FROM hits) q GROUP BY ALL),
left_over AS (SELECT e.*, dest FROM elements e LEFT JOIN moved m ON m.doc_id = e.doc_id AND m.page_no = e.page_no AND m.elem_idx = e.elem_idx WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = e.doc_id AND h.page_no = e.page_no AND h.elem_idx = e.elem_idx)),
ordered AS (SELECT *, elem_idx AS old_idx, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY coalesce(dest, elem_idx), CASE WHEN dest IS NOT NULL THEN 0 ELSE 1 END, elem_idx) - 1 AS new_idx FROM left_over)"""
)
_CELLS = _CELLS.replace(_CELLS[_CELLS.index("cells AS (SELECT") : _CELLS.index("grid AS (SELECT")], "", 1)
add("step16_table_cells", "SELECT doc_id, page_no, t_idx, row, col, x1, y1, x2, y2, is_header, content FROM full_grid", _CELLS, True)
add("step16_absorb_tables", f"SELECT doc_id, page_no, new_idx AS elem_idx, type, content, CASE WHEN type = 'table' AND old_idx = 100 THEN {len(GRID_ROWS)} END AS num_rows, CASE WHEN type = 'table' AND old_idx = 100 THEN {len(GRID_COLUMNS)} END AS num_columns FROM ordered", _CELLS, True)
_meta = has(f"lower({strip('content')})", r"^(name:\s*|\s*)$")
add(
    "e7_document_text",
    f"SELECT doc_id, md5({underscores('t')}) AS text_md5, length({underscores('t')})::INT AS n FROM (SELECT doc_id, coalesce(string_agg(part, ' ' ORDER BY page_no, new_idx, row, col), '') AS t FROM (SELECT d.doc_id, o.page_no, new_idx, 0 AS row, 0 AS col, content AS part FROM (SELECT DISTINCT doc_id FROM elements) d LEFT JOIN (SELECT * FROM ordered WHERE type = 'text' AND NOT {_meta}) o USING (doc_id) "
    f"UNION ALL SELECT o.doc_id, o.page_no, new_idx, f.row, f.col, {strip('f.content')} FROM ordered o JOIN full_grid f ON f.doc_id = o.doc_id AND f.page_no = o.page_no AND f.t_idx = o.old_idx WHERE o.type = 'table' AND f.content <> '') p GROUP BY doc_id) q",
    _CELLS,
    True,
)

_P = [rf"\({_A}\)\s*{_A}[- ]?{_B}", f"{_A}-{_A}-{_B}", f"{_A}/{_A}-{_B}", rf"{_A}\s+{_A}\s+{_B}", rf"{_A}[-\s/.]{_A}[-\s.]?{_B}"]


def phones(x: str) -> str:
    """Numbers of a text, false positives masked first; ten digits in a row are found as whole runs."""
    masked = x
    for p in (r"\d{5}-\d{4}", rf"{_D}/{_D}/\d{{2,4}}", r"[0-9]{4}/[0-9]{2}/[0-9]{2}"):
        masked = sub(masked, p, "#")
    lists = [f"list_transform(regexp_extract_all({masked}, '{p}'), lambda m: regexp_replace(m, '^{p}$', '(\\1) \\2-\\3'))" for p in _P]
    runs = f"list_transform(list_filter(regexp_extract_all({masked}, '\\d+'), lambda m: length(m) = 10), lambda m: '(' || m[1:3] || ') ' || m[4:6] || '-' || m[7:10])"
    every = "list_concat(" * 5 + lists[0] + "".join(f", {x_})" for x_ in (*lists[1:], runs))
    return f"CASE WHEN {has(strip(x), '^' + chr(92) + 'd{1,2}[/-]' + chr(92) + 'd{1,2}[/-]' + chr(92) + 'd{2,4}$')} THEN [] ELSE list_filter({every}, lambda m, i: NOT list_contains(({every})[1:i - 1], m)) END"


def zip_or_date(x: str) -> str:
    s = strip(x)
    return "(" + " OR ".join(has(s, p) for p in (r"^[0-9]{5}(-[0-9]{4})?$", rf"^{_D}[-/]{_D}[-/]\d{{2,4}}$", rf"^{_D}[-/]{_D}[-/]\d{{2,4}}\s+{_D}:[0-9]{{2}}", r"[a-zA-Z]+,?\s+[a-zA-Z]{2}\s+[0-9]{5}(-[0-9]{4})?$")) + ")"


_kind = r"CASE WHEN regexp_matches(content, '(?i)\b(FAX|FACSIMILE|TELECOPY)\b') THEN 'fax' WHEN regexp_matches(content, '(?i)\b(PHONE|TELEPHONE|TEL|CALL)\b') THEN 'phone' ELSE '' END"
add("step17_phones", f"SELECT {K}, CASE WHEN len(p) = 1 THEN p[1] END AS normalized_phone, CASE WHEN len(p) > 1 THEN array_to_string(p, '|') END AS normalized_phones, CASE WHEN len(p) > 0 AND kind <> '' THEN kind END AS phone_type FROM (SELECT *, CASE WHEN {zip_or_date('content')} THEN [] ELSE {phones('content')} END AS p, {_kind} AS kind FROM texts) q")
add("p6_date_or_zip", f"SELECT {K}, {zip_or_date('content')} AS date_or_zip, {_kind} AS kind FROM texts")


def dates(x: str) -> str:
    """raw;format;valid;issues of each date; a two-digit year is one that isn't followed by a digit."""
    made = lambda m, name: (
        f"{m}.raw || ';{name};' || CASE WHEN {m}.mo BETWEEN 1 AND 12 AND {m}.da BETWEEN 1 AND 31 THEN 'true' ELSE 'false' END || ';' || array_to_string(list_filter([CASE WHEN NOT {m}.mo BETWEEN 1 AND 12 THEN 'invalid_month' END, CASE WHEN NOT {m}.da BETWEEN 1 AND 31 THEN 'invalid_day' END, CASE WHEN {m}.da = 0 THEN 'missing_digit' END], lambda z: z IS NOT NULL), '|')"
    )
    parts = lambda p: f"list_transform(regexp_extract_all({x}, '{p}'), lambda r: {{'raw': regexp_extract(r, '\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d+'), 'mo': regexp_extract(r, '^(\\d+)', 1)::INT, 'da': regexp_extract(r, '^\\d+[/-](\\d+)', 1)::INT}})"
    four = f"list_transform({parts(chr(92) + 'd{1,2}[/-]' + chr(92) + 'd{1,2}[/-]' + chr(92) + 'd{4}')}, lambda m: {made('m', 'MM/DD/YYYY')})"
    two = f"list_transform({parts(chr(92) + 'd{1,2}[/-]' + chr(92) + 'd{1,2}[/-]' + chr(92) + 'd{2}(?:[^0-9]|$)')}, lambda m: {made('m', 'MM/DD/YY')})"
    months = f"list_transform(regexp_extract_all({x}, '(?i)({MONTHS})[a-z]*\\.?\\s+\\d{{1,2}},?\\s+\\d{{4}}'), lambda r: r || ';Month DD, YYYY;true;')"
    return f"list_concat(list_concat({four}, {two}), {months})"


add(
    "step18_validation",
    f"SELECT {K}, CASE WHEN gate AND len(p) > 0 THEN CASE WHEN len(list_filter(p, lambda m: replace(replace(replace(replace(replace(m, '(', ''), ') ', ''), '-', ''), m[2], ''), ' ', '') = '')) > 0 THEN 'invalid' ELSE 'valid' END END AS phone_status, CASE WHEN gate AND len(p) > 0 THEN array_to_string(p, '|') END AS phones, "
    f"CASE WHEN dgate AND len(d) > 0 THEN CASE WHEN len(list_filter(d, lambda m: contains(m, ';false;'))) > 0 THEN 'suspicious' ELSE 'valid' END END AS date_status, CASE WHEN dgate AND len(d) > 0 THEN array_to_string(d, '|') END AS dates FROM (SELECT *, {phones('content')} AS p, {dates('content')} AS d, "
    f"({has('content', '(?i)phone|fax|tel|call')} OR {has('content', chr(92) + '(' + chr(92) + 'd{3}' + chr(92) + ')')}) AND {has('content', chr(92) + 'd{3}')} AS gate, {has('content', chr(92) + 'd+[/-]')} OR {has('content', '(?i)(' + MONTHS + ')')} AS dgate FROM texts) q",
)

_allowed = ", ".join(f"'{p}', '{p[::-1]}'" for p in CONFUSED)
add(
    "k1_plausible",
    f"SELECT word, len(d) BETWEEN 1 AND 2 AND len(list_filter(d, lambda p: p NOT IN ({_allowed}))) = 0 AS swapped, {has('word', '^[a-jl-rt-wy]')} AS shorter FROM (SELECT word, list_filter(list_transform(range(1, length(word) + 1), lambda i: word[i] || translate(word, 'eot', 'cof')[i]), lambda p: p[1] <> p[2]) AS d FROM ew) q",
    "ew AS (SELECT DISTINCT w AS word FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents WHERE lang = 'en') s WHERE length(w) >= 3)",
)

# --- layout and routing

_ROWS = """
seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y1, elem_idx) AS n, greatest(8.0, max(y2) OVER (PARTITION BY doc_id, page_no) * 0.012) AS near FROM texts),
fold AS (SELECT doc_id, page_no, elem_idx, x1, y1, n, 0 AS row_id, y1 AS anchor FROM seq WHERE n = 1
  UNION ALL SELECT s.doc_id, s.page_no, s.elem_idx, s.x1, s.y1, s.n, CASE WHEN abs(s.y1 - f.anchor) < s.near THEN f.row_id ELSE f.row_id + 1 END, CASE WHEN abs(s.y1 - f.anchor) < s.near THEN f.anchor ELSE s.y1 END FROM fold f JOIN seq s ON s.doc_id = f.doc_id AND s.page_no = f.page_no AND s.n = f.n + 1)"""
add("r9_cluster_rows", f"SELECT {K}, row_id, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY row_id, x1, y1, elem_idx) - 1 AS reading_idx FROM fold", _ROWS, True)

_boxes = "SELECT doc_id, page_no, elem_idx AS det_idx, x1, y1, x2, y2 + 30 AS y2 FROM texts WHERE g % 5 = 0 UNION ALL SELECT doc_id, page_no, elem_idx + 40, x1 + 2, y1, x2, y2 + 30 FROM texts WHERE g % 10 = 0"
_gone = "len(list_filter(f.kept, lambda k: least(s.x2, k.x2) > greatest(s.x1, k.x1) AND least(s.y2, k.y2) > greatest(s.y1, k.y1) AND (least(s.x2, k.x2) - greatest(s.x1, k.x1)) * (least(s.y2, k.y2) - greatest(s.y1, k.y1)) / ((s.x2 - s.x1) * (s.y2 - s.y1)) > 0.5)) > 0"
_REGIONS = f"""
hw AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY det_idx, x1, y1, x2, y2) AS n FROM ({_boxes}) b),
fold2 AS (SELECT doc_id, page_no, n, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM hw WHERE n = 1
  UNION ALL SELECT s.doc_id, s.page_no, s.n, CASE WHEN {_gone} THEN f.kept ELSE list_append(f.kept, {{'x1': s.x1, 'y1': s.y1, 'x2': s.x2, 'y2': s.y2}}) END FROM fold2 f JOIN hw s ON s.doc_id = f.doc_id AND s.page_no = f.page_no AND s.n = f.n + 1),
last AS (SELECT doc_id, page_no, arg_max(kept, n) AS kept FROM fold2 GROUP BY ALL),
both_kinds AS (SELECT doc_id, page_no, 0 AS o, elem_idx AS i, 'signature' AS type, x1, y1, x2, y2 FROM elements WHERE type = 'signature'
  UNION ALL SELECT doc_id, page_no, 1, i, 'handwriting', kept[i].x1, kept[i].y1, kept[i].x2, kept[i].y2 FROM last, unnest(range(1, len(kept) + 1)) t(i))"""
add("r2_handwritten_regions", "SELECT doc_id, page_no, (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY o, i) - 1)::INT AS region_idx, type, x1, y1, x2, y2 FROM both_kinds", _REGIONS, True)

# --- spelling, by comparing every unknown word with every dictionary word of about its length

_OTHERS = r"""others AS (SELECT v, row_number() OVER (ORDER BY v) AS n FROM (SELECT DISTINCT unnest(string_split(regexp_replace(lower(text), '[\x00-\x7F]', '', 'g'), '')) AS v FROM (SELECT text FROM documents UNION ALL SELECT '“”–…') d) q WHERE v <> ''),
 codes AS (SELECT coalesce(string_agg(v, '' ORDER BY n), '') AS from_, coalesce(string_agg(chr((CASE WHEN n <= 26 THEN 64 + n WHEN n <= 34 THEN n - 26 ELSE n - 21 END)::INT), '' ORDER BY n), '') AS to_ FROM others)"""


def coded(x: str) -> str:
    """x, in lower case, with a free byte for each other character than ASCII: DuckDB's distances are of bytes."""
    return f"translate({x}, (SELECT from_ FROM codes), (SELECT to_ FROM codes))"


_PAIRS = sorted({*CONFUSED, *(p[::-1] for p in CONFUSED)})
_apart = "list_filter(range(1, length(wrong) + 1), lambda i: wrong[i] <> word[i])"
_swapped = f"(len({_apart}) = 2 AND ({_apart})[2] = ({_apart})[1] + 1 AND wrong[({_apart})[1]] = word[({_apart})[2]] AND wrong[({_apart})[2]] = word[({_apart})[1]])"
_long, _short = "CASE WHEN length(wrong) < length(word) THEN word ELSE wrong END", "CASE WHEN length(wrong) < length(word) THEN wrong ELSE word END"
_lost = f"list_filter(range(1, length({_long}) + 1), lambda i: substr({_long}, 1, i - 1) || substr({_long}, i + 1) = ({_short}))"
_plausible = (
    f"CASE WHEN length(wrong) = length(word) THEN len({_apart}) BETWEEN 1 AND 2 AND len(list_filter({_apart}, lambda i: wrong[i] || word[i] NOT IN {tuple(_PAIRS)})) = 0 "
    f"ELSE coalesce(regexp_matches(({_long})[({_lost})[1]], '^[a-jl-rt-wy]$'), FALSE) END"
)
_VOCABULARY = r"""voc AS MATERIALIZED (SELECT word, count(*) AS freq FROM (SELECT unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS word FROM documents) q WHERE word <> '' GROUP BY word HAVING count(*) >= 2)"""


def corrections() -> str:
    """CTEs from unknown (wrong) to best (wrong, right)."""
    return f"""
u AS MATERIALIZED (SELECT wrong, length(wrong) AS n, {coded('wrong')} AS cw FROM unknown), v AS MATERIALIZED (SELECT word, freq, length(word) AS n, {coded('word')} AS cv FROM voc),
same AS MATERIALIZED (SELECT wrong, word, freq, hamming(cw, cv) AS h FROM u JOIN v USING (n) WHERE hamming(cw, cv) <= 2),
one AS MATERIALIZED (SELECT wrong, word, freq FROM same WHERE h = 1 OR h = 2 AND {_swapped} UNION ALL SELECT wrong, word, freq FROM u JOIN v ON v.n = u.n + 1 WHERE levenshtein(cw, cv) = 1 UNION ALL SELECT wrong, word, freq FROM u JOIN v ON v.n = u.n - 1 WHERE levenshtein(cw, cv) = 1),
near AS (SELECT * FROM one UNION ALL SELECT wrong, word, freq FROM same WHERE h = 2 AND wrong NOT IN (SELECT wrong FROM one)),
best AS MATERIALIZED (SELECT wrong, arg_min(word, (-freq, word)) AS "right" FROM near WHERE {_plausible} GROUP BY wrong)"""


ORACLES["step12_spelling"] = f"""
WITH {_OTHERS}, {_VOCABULARY},
unknown AS MATERIALIZED (SELECT DISTINCT translate(word, 'eo', 'co') AS wrong FROM voc WHERE length(word) >= 5 AND translate(word, 'eo', 'co') NOT IN (SELECT word FROM voc)), {corrections()}
SELECT wrong, "right" FROM best"""

_upper = "regexp_matches(st, '^[^\\p{Ll}]*\\p{Lu}[^\\p{Ll}]*$')"
_eligible = f"length(st) >= 5 AND NOT ({_upper} AND length(st) <= 6) AND NOT regexp_matches(st, '[\\p{{Nd}}/-]') AND NOT (regexp_matches(st, '^\\p{{Lu}}') AND NOT {_upper})"
_shout = lambda x: f"upper(replace({x}, 'ß', 'SS'))"
add(
    "step12_correct_texts",
    f"SELECT {K}, coalesce(fixed, content) AS content FROM heard LEFT JOIN lines2 USING (doc_id, page_no, elem_idx)",
    f"{_OTHERS}, {_VOCABULARY}, heard AS MATERIALIZED (SELECT {K}, translate(content, 'eo', 'co') AS content FROM texts),"
    f" tokens AS (SELECT {K}, i, w[i] AS token, regexp_replace(w[i], '[:.,;!?]+$', '') AS st FROM (SELECT {K}, {words('content')} AS w FROM heard) q, unnest(range(1, len(w) + 1)) t(i)),"
    f" named AS MATERIALIZED (SELECT *, CASE WHEN {_eligible} THEN lower(st) END AS wrong FROM tokens),"
    f" unknown AS MATERIALIZED (SELECT DISTINCT wrong FROM named WHERE wrong IS NOT NULL AND wrong NOT IN (SELECT word FROM voc)), {corrections()},"
    f" lines2 AS (SELECT {K}, string_agg(coalesce(CASE WHEN st = {_shout('st')} THEN {_shout('b.right')} ELSE b.right END || substr(token, length(st) + 1), token), ' ' ORDER BY i) AS fixed FROM named LEFT JOIN best b USING (wrong) GROUP BY ALL)",
)

_re2_spaced = "lower(text)"
for _p, _r in ((r"\s+([.,;:!?])", r"\1"), (r"([(\[{])\s+", r"\1"), (r"\s+([)\]}])", r"\1"), (r"([!?.,;:])\s+([!?.,;:])", r"\1\2"), (r"(\w)\s+-\s+(\w)", r"\1-\2"), (r"(\w)\s+''\s*(\w)", r"\1''\2"), (r"(\w)\s+''", r"\1''"), (r"''\s+(\w)", r"''\1"), (" {2,}", " ")):
    _re2_spaced = sub(_re2_spaced, _p, _r)
add(
    "r_route_lines",
    f"SELECT {K}, region_type, route, CASE WHEN take THEN CASE WHEN route = 'ensemble' THEN {cased('text', 'spaced')} ELSE spaced END ELSE text END AS content, CASE WHEN take THEN 'trocr' ELSE 'surya' END AS source_model, doc_id % 2 = 0 AND y1 / 600.0 >= 0.8 AS in_signature_region FROM ("
    f"SELECT *, CASE route WHEN 'handwriting' THEN readable AND hw >= 0.15 WHEN 'ensemble' THEN CASE WHEN region_type = 'signature' THEN readable AND hw > confidence AND hw >= 0.9 ELSE readable AND hw > confidence END ELSE FALSE END AS take FROM ("
    f"SELECT *, CASE WHEN region_type IS NOT NULL THEN 'ensemble' WHEN doc_id % 3 = 2 AND sure >= 0.45 THEN 'handwriting' WHEN doc_id % 3 = 1 OR sure < 0.45 THEN 'ensemble' WHEN doc_id % 3 = 0 AND confidence < 0.6 AND {strip('text')} <> '' THEN 'handwriting' ELSE 'print' END AS route, {strip(_re2_spaced)} AS spaced, {strip('lower(text)')} <> '' AS readable FROM ("
    f"SELECT {K}, content AS text, confidence, y1, ((g * 53) % 101)::DOUBLE / 100 AS hw, [0.3, 0.5, 0.7, 0.9][doc_id % 4 + 1] AS sure, CASE WHEN EXISTS (SELECT 1 FROM elements s WHERE s.type = 'signature' AND s.doc_id = e.doc_id AND s.page_no = e.page_no AND {touching('e.', 's.')}) THEN 'signature' END AS region_type FROM texts e) a) b "
    "WHERE confidence >= CASE WHEN region_type IS NOT NULL THEN 0.15 ELSE 0.4 END) c",
)
add("r8_page_text", f"SELECT doc_id, page_no, md5(t) AS text_md5, length({strip('t')}) > 20 AS long_enough FROM (SELECT doc_id, page_no, string_agg(content, ' ' ORDER BY elem_idx) AS t FROM texts GROUP BY ALL) q")
_fit = f"type <> 'text' AND NOT {too_large('type', 612.0, 340.0)}"
add("r10_visual_elements", f"SELECT {K}, type, '' AS description FROM elements WHERE {_fit} AND type IN ('table', 'logo', 'signature') UNION ALL SELECT {K}, type, 'Detected ' || upper(type[1]) || type[2:] FROM elements WHERE {_fit}")
add("r12_append_order", "SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY CASE type WHEN 'text' THEN 0 WHEN 'table' THEN 1 ELSE 2 END, elem_idx) - 1 AS elem_idx, type FROM elements")
ORACLES["i7_calibration"] = "SELECT event_id, round(greatest(0.0, least(1.0, 1.0 + (-value / 40) / 2.5)), 6) AS confidence FROM events"
_agg = lambda name, key, cond: f"coalesce(string_agg({key}, '|' ORDER BY {name}) FILTER ({cond}), '')"
add(
    "i9_structure_parts",
    f"SELECT doc_id, page_no, {_agg('y1, elem_idx', '(y1 + 20)::INT::VARCHAR', 'k = 0')} AS rows, {_agg('x1, elem_idx', '(x1 + 30)::INT::VARCHAR', 'k = 1')} AS columns, {_agg('elem_idx', '(y1 + 20)::INT::VARCHAR', 'k IN (2, 4)')} AS headers, {_agg('elem_idx', '(y1 + 20)::INT::VARCHAR', 'k IN (3, 5)')} AS cells FROM (SELECT *, g % 6 AS k FROM texts WHERE confidence > 0.5) q GROUP BY ALL",
)

# --- classification and metrics

add("i8_table_detections", f"SELECT {K}, confidence FROM texts WHERE confidence > 0.7 AND g % 3 = 0")
ORACLES["i5_line_skew"] = """
WITH l AS (SELECT user_id, (event_id * 13 % 50 - 10)::DOUBLE AS dx, (event_id * 17 % 7 - 2)::DOUBLE AS dy FROM events),
 a AS (SELECT user_id, CASE WHEN abs(dx) > 10 THEN degrees(atan2(dy, dx)) END AS a FROM l),
 m AS (SELECT user_id, count(*) AS n, count(a) FILTER (a > -30 AND a < 30) AS k, median(a) FILTER (a > -30 AND a < 30) AS mid FROM a GROUP BY user_id)
SELECT user_id, round(CASE WHEN n >= 10 AND k >= 5 AND abs(mid) BETWEEN 0.5 AND 15 THEN mid ELSE 0.0 END, 6) AS skew FROM m"""
ORACLES["c_pixels"] = """
WITH s AS (SELECT s_suppkey, 2 + s_suppkey % 3 AS t, 15 + s_suppkey % 61 AS body, CASE WHEN s_suppkey % 2 = 1 THEN 20 + s_suppkey % 40 ELSE 0 END AS head, CASE WHEN s_suppkey % 3 = 0 THEN 15 + s_suppkey % 30 ELSE 0 END AS foot FROM supplier),
 h AS (SELECT *, CASE WHEN body >= 20 THEN body * t ELSE 0 END + CASE WHEN head >= 20 THEN head * t ELSE 0 END + CASE WHEN foot >= 20 THEN foot * 6 ELSE 0 END AS horizontal,
  foot > 20 AND foot * 6 > 50 AND foot * 6 / 8800.0 BETWEEN 0.003 AND 0.15 AS signed, head >= 25 AND head * t > 20 AND head * t / 6600.0 > 0.02 AND head * t / 6600.0 < 0.25 AS fax FROM s)
SELECT s_suppkey, horizontal::INT AS horizontal, 0 AS vertical, round(least(horizontal::DOUBLE / 44000 / 0.01, 1.0), 6) AS form, signed AS has_signature, fax AS has_fax_header, CASE WHEN signed THEN '0.0,0.8,1.0,1.0' END AS zone FROM h"""
_votes = ", ".join(f"len(list_filter(w, lambda x: x IN {names})) AS {k}" for k, names in FREQUENT.items())
ORACLES["i11_language"] = f"""
WITH w AS (SELECT doc_id, length({strip('text')}) AS n, list_transform({words('lower(text)')}, lambda x: {sub('x', '[^' + chr(92) + 'pL]', '')}) AS w FROM documents),
 v AS (SELECT doc_id, n, {_votes} FROM w)
SELECT doc_id, CASE WHEN n > 20 THEN CASE WHEN en >= greatest(de, fr, es) THEN 'en' WHEN de >= greatest(fr, es) THEN 'de' WHEN fr >= es THEN 'fr' ELSE 'es' END ELSE 'en' END AS language FROM v"""
ORACLES["e8_metadata"] = "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 AND doc_id % 3 <> 1 THEN coalesce(lang, 'unknown') ELSE 'unknown' END AS doc_type, CASE WHEN doc_id % 4 <> 0 THEN coalesce((n_chars % 100) / 100.0, 0.0)::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM documents"

ORACLES["c_features"] = """
WITH e AS (SELECT user_id, (value % 40) + 5 AS h, (event_id * 7 % 61 - 30)::DOUBLE AS a, (event_id % 900)::DOUBLE AS area FROM events)
SELECT user_id, round(CASE WHEN count(h) < 10 THEN 0.5 ELSE greatest(0.0, least(1.0, 1.0 - stddev_pop(h) / avg(h) / 0.4)) END, 6) AS uniformity,
 round(CASE WHEN count(*) < 5 THEN 0.5 ELSE avg((abs(a) < 5 OR abs(a) > 175)::INT) END, 6) AS line, round(var_pop(a), 4) AS angle_variance,
 round(CASE WHEN count(h) >= 100 AND avg(h) >= 0.1 THEN least(stddev_pop(h) / avg(h) / 0.5, 1.0) ELSE 0.5 END, 6) AS stroke,
 round(CASE WHEN count(*) FILTER (a > -30 AND a < 30) >= 5 THEN quantile_cont(a, 0.5) FILTER (a > -30 AND a < 30) ELSE 0.0 END, 6) AS skew,
 count(*) FILTER (area > 50 AND area < 12000 AND h > 20) BETWEEN 1 AND 15 AS signature FROM e GROUP BY user_id"""
ORACLES["c_page_class"] = """
WITH f AS (SELECT o_orderkey AS k, o_orderkey * 7 % 11 / 11.0::DOUBLE AS stroke, o_orderkey * 13 % 101 / 101.0::DOUBLE AS line, o_orderkey * 5 % 13 / 13.0::DOUBLE AS form, o_orderkey * 3 % 17 / 17.0::DOUBLE AS uni,
  (o_orderkey * 37 % 2000)::DOUBLE AS angle, o_orderkey * 11 % 20 / 100.0::DOUBLE AS edge, o_orderkey % 3 = 0 AS sig, o_orderkey % 5 = 0 AS fax FROM orders),
 r AS (SELECT *, line >= 0.95 AND form < 0.25 AND angle > 300 AND angle < 700 AS ruled FROM f),
 t AS (SELECT *, 0.0::DOUBLE + (CASE WHEN stroke < 0.3 THEN 0.20 WHEN stroke < 0.5 THEN 0.10 ELSE 0.0 END)::DOUBLE + (CASE WHEN line > 0.7 THEN 0.12 WHEN line > 0.5 THEN 0.06 ELSE 0.0 END)::DOUBLE
  + (CASE WHEN angle < 400 THEN 0.10 WHEN angle < 800 THEN 0.05 WHEN angle > 1500 AND form < 0.3 THEN -0.15 WHEN angle > 1200 AND form < 0.3 THEN -0.08 ELSE 0.0 END)::DOUBLE + (CASE WHEN edge > 0.02 AND edge < 0.15 THEN 0.08 WHEN edge < 0.02 THEN 0.04 ELSE 0.0 END)::DOUBLE
  + (CASE WHEN form > 0.5 THEN 0.30 WHEN form > 0.2 THEN 0.20 WHEN form > 0.1 THEN 0.12 ELSE 0.0 END)::DOUBLE + (CASE WHEN uni > 0.7 THEN 0.12 WHEN uni > 0.4 THEN 0.06 ELSE 0.0 END)::DOUBLE + (CASE WHEN fax THEN 0.20 ELSE 0.0 END)::DOUBLE
  + (CASE WHEN sig AND form > 0.2 THEN 0.10 ELSE 0.0 END)::DOUBLE + (CASE WHEN ruled THEN -0.12 ELSE 0.0 END)::DOUBLE AS total FROM r),
 s AS (SELECT k, CASE WHEN k % 97 = 0 THEN NULL ELSE greatest(0.0, least(1.0, CASE WHEN edge < 0.02 AND form > 0.15 AND NOT ruled AND total < 0.65 THEN 0.65 ELSE total END)) END AS sc FROM t)
SELECT k AS o_orderkey, round(sc, 6) AS typed_score, CASE WHEN sc IS NULL THEN 'mixed' WHEN sc >= 0.65 THEN 'typed' WHEN sc <= 0.45 THEN 'handwritten' ELSE 'mixed' END AS document_type,
 round(CASE WHEN sc IS NULL THEN 0.3 WHEN sc >= 0.65 THEN least(sc, 0.95) WHEN sc <= 0.45 THEN least(1.0 - sc, 0.95) ELSE 0.5 END, 6) AS confidence FROM s"""
_punct = PUNCTUATION.replace("'", "''")
_chars = lambda x, flex: f"translate(replace(lower({x}), ' ', ''), '{_punct}', '')" if flex else f"replace(lower({x}), ' ', '')"


def cer(flex: bool) -> str:
    t, h = ("ft", "fh") if flex else ("st", "sh")
    return f"CASE WHEN length({t}) = 0 THEN 0.0::DOUBLE ELSE levenshtein({coded(t)}, {coded(h)})::DOUBLE / length({t}) END"


_heard = r"CASE WHEN line_no % 2 = 0 THEN regexp_replace(translate(line, 'eo.', 'co,'), '^\S+\s+', '') ELSE translate(line, 'eo.', 'co,') END"
_lines = "SELECT doc_id, i - 1 AS line_no, a[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents) q, unnest(range(1, len(a) + 1)) t(i)"


def measures(truth: str) -> str:
    """CTEs up to measured: error rates of each line, truth being an expression of it.

    Words are bytes where a line has few enough; else their distance goes by anti-diagonals, whose cells don't depend on each other; d1 and d2 are the last two of them.
    """
    spaced = lambda x: f"translate(lower({x}), '{_punct}', '{' ' * len(PUNCTUATION)}')"
    low = lambda k: f"greatest(0, {k} - m)"
    cell = f"CASE WHEN i = 0 OR i = k + 1 THEN k + 1 ELSE least(d1[i - {low('k')}] + 1, d1[i - {low('k')} + 1] + 1, d2[i - {low('(k - 1)')}] + CASE WHEN a[i] = b[k + 1 - i] THEN 0 ELSE 1 END) END"
    as_bytes = lambda x: f"array_to_string(list_transform({x}, lambda v: chr(v::INT)), '')"
    rate = lambda d, n: f"CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE {d}::DOUBLE / {n} END"
    return rf"""t AS ({_lines}), {_OTHERS},
 p AS MATERIALIZED (SELECT doc_id, line_no, {truth} AS truth, {_heard} AS heard FROM t),
 c AS (SELECT *, {_chars('truth', False)} AS st, {_chars('heard', False)} AS sh, {_chars('truth', True)} AS ft, {_chars('heard', True)} AS fh FROM p),
 chars AS MATERIALIZED (SELECT doc_id, line_no, {cer(False)} AS strict_cer, {cer(True)} AS flexible_cer, length(st)::INT AS total_ref_chars FROM c),
 w AS (SELECT doc_id, line_no, 0 AS flex, {words('lower(truth)')} AS x, {words('lower(heard)')} AS y FROM p UNION ALL SELECT doc_id, line_no, 1, {words(spaced('truth'))}, {words(spaced('heard'))} FROM p),
 coded_words AS MATERIALIZED (SELECT doc_id, line_no, flex, list_transform(x, lambda v: list_position(known, v)) AS a, list_transform(y, lambda v: list_position(known, v)) AS b, len(x) AS n, len(y) AS m, len(known) AS size FROM (SELECT *, list_distinct(list_concat(x, y)) AS known FROM w) q),
 diagonal(doc_id, line_no, flex, k, a, b, n, m, d1, d2) USING KEY (doc_id, line_no, flex) AS (SELECT doc_id, line_no, flex, 0::BIGINT, a, b, n, m, [0::BIGINT], []::BIGINT[] FROM coded_words WHERE size > 127
  UNION SELECT doc_id, line_no, flex, k + 1, a, b, n, m, list_transform(range({low('(k + 1)')}, least(k + 1, n) + 1), lambda i: {cell}), d1 FROM diagonal WHERE k < n + m),
 done AS MATERIALIZED (SELECT doc_id, line_no, flex, n, d1[1] AS d FROM diagonal WHERE k = n + m
  UNION ALL SELECT doc_id, line_no, flex, n, levenshtein({as_bytes('a')}, {as_bytes('b')}) FROM coded_words WHERE size <= 127),
 rates AS (SELECT s.doc_id, s.line_no, {rate('s.d', 's.n')} AS strict_wer, {rate('f.d', 'f.n')} AS flexible_wer, s.n::INT AS total_ref_words FROM done s JOIN done f ON s.doc_id = f.doc_id AND s.line_no = f.line_no AND s.flex = 0 AND f.flex = 1),
 errors AS (SELECT *, trunc(flexible_wer * greatest(total_ref_words, 1))::INT AS content_errors FROM rates),
 measured AS MATERIALIZED (SELECT *, greatest(0, trunc(strict_wer * greatest(total_ref_words, 1))::INT - content_errors) AS formatting_errors FROM errors JOIN chars USING (doc_id, line_no))"""


_all = ", ".join(f"round({c}, 9) AS {c}" for c in ("strict_wer", "flexible_wer", "strict_cer", "flexible_cer"))
ORACLES["e_character_metrics"] = rf"""
WITH t AS ({_lines}), {_OTHERS},
 p AS (SELECT doc_id, line_no, line AS truth, {_heard} AS heard FROM t),
 c AS (SELECT *, {_chars('truth', False)} AS st, {_chars('heard', False)} AS sh, {_chars('truth', True)} AS ft, {_chars('heard', True)} AS fh FROM p)
SELECT doc_id, line_no, round({cer(False)}, 9) AS strict_cer, round({cer(True)}, 9) AS flexible_cer, len({words('lower(truth)')})::INT AS total_ref_words, length(st)::INT AS total_ref_chars FROM c"""
ORACLES["e_metrics"] = f"WITH RECURSIVE {measures('line')} SELECT doc_id, line_no, {_all}, formatting_errors, content_errors, total_ref_words, total_ref_chars FROM measured"
_scored = f"""WITH RECURSIVE {measures(underscores('line'))},
 kinds AS (SELECT *, doc_id * 1000000 + line_no AS id FROM measured), typed AS (SELECT *, CASE id % 3 WHEN 0 THEN 'typed' WHEN 1 THEN 'handwritten' ELSE 'other' END AS kind FROM kinds),
 limits AS (SELECT *, CASE kind WHEN 'handwritten' THEN 0.2 ELSE 0.4 END::DOUBLE AS wer_limit, CASE kind WHEN 'handwritten' THEN 0.1 WHEN 'typed' THEN 0.3 ELSE 0.2 END::DOUBLE AS cer_limit FROM typed),
 scored AS MATERIALIZED (SELECT *, flexible_wer <= wer_limit AS wer_pass, flexible_cer <= cer_limit AS cer_pass FROM limits),
 total AS (SELECT count(*) AS n, count(*) FILTER (wer_pass AND cer_pass) AS passed, avg(strict_wer) AS wer, avg(strict_cer) AS cer, avg(flexible_wer) AS fwer, avg(flexible_cer) AS fcer, sum(formatting_errors)::BIGINT AS formatting_errors, sum(content_errors)::BIGINT AS content_errors FROM scored)"""
ORACLES["e9_pass_fail"] = f"{_scored} SELECT id AS doc_id, kind AS truth_type, round(flexible_wer, 9) AS flexible_wer, round(flexible_cer, 9) AS flexible_cer, wer_limit, cer_limit, wer_pass, cer_pass, wer_pass AND cer_pass AS passed FROM scored"
ORACLES["e10_summary"] = f"{_scored} SELECT n AS expected, n AS total, passed, round(wer, 9) AS avg_wer, round(cer, 9) AS avg_cer, round(fwer, 9) AS avg_flexible_wer, round(fcer, 9) AS avg_flexible_cer, formatting_errors, content_errors, n > 0 AND passed = n AS succeeded FROM total"
ORACLES["e11_baseline"] = f"{_scored} SELECT round((0.25 - wer) * 100, 7) AS wer_delta, round((0.10 - cer) * 100, 7) AS cer_delta, passed - 1 AS passed_before, passed, n AS total_before, n AS total FROM total"
add(
    "v_display",
    "SELECT doc_id, CASE WHEN type = 'text' AND source_model = 'trocr' THEN 'text_trocr' ELSE type END AS kind, CASE WHEN confidence >= 0.40 THEN '#ff3232' WHEN type = 'text' AND source_model = 'trocr' THEN '#ff8c00' ELSE CASE type WHEN 'text' THEN '#1e90ff' WHEN 'table' THEN '#0064c8' WHEN 'signature' THEN '#9400d3' WHEN 'logo' THEN '#00b4b4' WHEN 'layout_region' THEN '#b4b4b4' ELSE '#c8c8c8' END END AS colour, count(*) AS n FROM elements GROUP BY ALL",
)
