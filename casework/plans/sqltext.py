"""SQL twins of the column functions, for the DuckDB oracles.

DuckDB's regex engine is RE2: ``\\s`` is ASCII whitespace and ``\\b`` is an
ASCII word edge, so word edges are spelled out with Unicode classes.  The
driver tables only contain space and newline as whitespace.
"""

from __future__ import annotations

import re

from casework import lexicon
from casework.operators.validate import Rules
from casework.sources.fixtures import sql_str


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({expr}, ''), '[\\s\\x1c-\\x1f]+'), lambda w: w <> '')"


def word_count(expr: str) -> str:
    return f"CAST(len({words(expr)}) AS BIGINT)"


def char_count(expr: str) -> str:
    return f"CAST(length({expr}) AS BIGINT)"


def py_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$', '', 'g')"


def prefix_word_any(expr: str, ws) -> str:
    alts = "|".join(re.escape(w) for w in ws)
    return f"regexp_matches(lower({expr}), '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])({alts})')"


def tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def clean_text(expr: str, mapping=lexicon.CONTRACTIONS) -> str:
    out = expr
    for short, full in mapping:
        out = f"regexp_replace({out}, {sql_str('(?i)' + re.escape(short))}, {sql_str(full)}, 'g')"
    out = f"regexp_replace({out}, {sql_str('[^' + lexicon.ALLOWED_CHARS_CLASS + ']')}, ' ', 'g')"
    out = f"regexp_replace({out}, '\\s+', ' ', 'g')"
    return py_strip(f"lower({out})")


def repeated_word_cte(table: str, key: str, text: str, rules: Rules) -> str:
    """CTE body: (key, hit) -- alphabetically first over-represented long word."""
    return f"""SELECT {key}, min(w) FILTER (WHERE length(w) >= {rules.repeat_min_len}
                 AND cnt / n > {rules.repeat_share}) AS hit
FROM (SELECT {key}, w, count(*) AS cnt, any_value(n) AS n
      FROM (SELECT {key}, unnest(ws) AS w, len(ws) AS n
            FROM (SELECT {key}, {words(f'lower({text})')} AS ws FROM {table}))
      GROUP BY {key}, w)
GROUP BY {key}"""


def verdict_code(text: str, nw: str, nc: str, hit: str, rules: Rules, category: str | None = None) -> str:
    parts = [
        f"WHEN {text} IS NULL OR {nw} = 0 THEN 'empty'",
        f"WHEN {nw} < {rules.min_words} THEN 'few_words'",
        f"WHEN {nw} > {rules.max_words} THEN 'many_words'",
        f"WHEN {nc} < {rules.min_chars} THEN 'few_chars'",
        f"WHEN {nc} > {rules.max_chars} THEN 'many_chars'",
        f"WHEN {hit} IS NOT NULL THEN 'repetitive'",
        f"WHEN {prefix_word_any(text, rules.profanity)} THEN 'profanity'",
    ]
    if category is not None:
        parts.append(f"WHEN NOT {category_relevant(text, category, rules.category_keywords)} THEN 'irrelevant'")
    return "(CASE " + " ".join(parts) + " ELSE 'ok' END)"


def category_relevant(text: str, category: str, keywords) -> str:
    whens = " ".join(
        f"WHEN {category} = {sql_str(cat)} THEN ("
        + " OR ".join(f"contains(lower({text}), {sql_str(w)})" for w in ws) + ")"
        for cat, ws in keywords.items())
    return f"(CASE {whens} ELSE TRUE END)"


def verdict_reason(code: str, nw: str, nc: str, hit: str, rules: Rules, category: str | None = None) -> str:
    parts = [
        f"WHEN {code} = 'empty' THEN 'Text is empty'",
        f"WHEN {code} = 'few_words' THEN 'Too short: ' || CAST({nw} AS VARCHAR) || ' words (min {rules.min_words})'",
        f"WHEN {code} = 'many_words' THEN 'Too long: ' || CAST({nw} AS VARCHAR) || ' words (max {rules.max_words})'",
        f"WHEN {code} = 'few_chars' THEN 'Too short: ' || CAST({nc} AS VARCHAR) || ' chars (min {rules.min_chars})'",
        f"WHEN {code} = 'many_chars' THEN 'Too long: ' || CAST({nc} AS VARCHAR) || ' chars (max {rules.max_chars})'",
        f"WHEN {code} = 'repetitive' THEN 'Repetitive word detected: ''' || {hit} || ''''",
        f"WHEN {code} = 'profanity' THEN 'Contains explicit profanity'",
    ]
    if category is not None:
        parts.append(f"WHEN {code} = 'irrelevant' THEN 'No ''' || {category} || ''' keywords found in text'")
    return "(CASE " + " ".join(parts) + " ELSE '' END)"


def validated_select(table: str, key: str, text: str, rules: Rules, category: str | None = None,
                     extra_cols: str = "") -> tuple[list[tuple[str, str]], str]:
    """(ctes, select) producing key, passed, reason_code, reason, word_count, char_count."""
    base = (f"SELECT *, {word_count(text)} AS _nw, {char_count(text)} AS _nc FROM {table}")
    ctes = [("_vbase", base), ("_vrep", repeated_word_cte(table, key, text, rules))]
    code = verdict_code(f"b.{text}", "b._nw", "b._nc", "r.hit", rules,
                        f"b.{category}" if category else None)
    coded = (f"SELECT b.*, r.hit AS _hit, {code} AS reason_code FROM _vbase b "
             f"LEFT JOIN _vrep r ON b.{key} = r.{key}")
    ctes.append(("_vcoded", coded))
    reason = verdict_reason("reason_code", "_nw", "_nc", "_hit", rules, category)
    sel = (f"SELECT {key}, reason_code = 'ok' AS passed, reason_code, {reason} AS reason, "
           f"_nw AS word_count, _nc AS char_count{extra_cols} FROM _vcoded")
    return ctes, sel


def stop_filter(list_expr: str, stop_words) -> str:
    sw = ", ".join(sql_str(w) for w in sorted(set(stop_words)))
    return f"list_filter({list_expr}, lambda w: NOT list_contains([{sw}], w))"


def tfidf_ctes(p: str, table: str, id_expr: str, text_expr: str, spec, max_features: int | None = None,
               min_df: int = 1, vocab_from: str | None = None) -> list[tuple[str, str]]:
    """CTEs ``{p}_tc`` (id, term, tf), ``{p}_voc`` (term, idx, df, ttf, idf) unless
    ``vocab_from`` is given, and ``{p}_nw`` (id, term, idx, weight)."""
    base = clean_text(text_expr) if spec.clean else text_expr
    toks = tokens(base)
    if spec.stop_words:
        toks = stop_filter(toks, spec.stop_words)
    out = [(f"{p}_tok", f"SELECT {id_expr} AS id, {toks} AS t FROM {table}")]
    if spec.bigrams:
        out.append((f"{p}_terms", f"SELECT id, list_concat(t, list_transform(range(1, len(t)), "
                                  f"lambda i: t[i] || ' ' || t[i + 1])) AS terms FROM {p}_tok"))
    else:
        out.append((f"{p}_terms", f"SELECT id, t AS terms FROM {p}_tok"))
    out.append((f"{p}_tc", f"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term "
                           f"FROM {p}_terms) GROUP BY ALL"))
    voc = vocab_from
    if voc is None:
        voc = f"{p}_voc"
        having = f" HAVING count(*) >= {min_df}" if min_df > 1 else ""
        lim = f" ORDER BY ttf DESC, term LIMIT {max_features}" if max_features else ""
        out.append((f"{p}_st", f"SELECT term, count(*) AS df, sum(tf) AS ttf FROM {p}_tc GROUP BY term{having}"))
        out.append((voc, f"SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, df, ttf, "
                         f"ln((1 + (SELECT count(*) FROM {table})) / (1 + df)) + 1 AS idf "
                         f"FROM (SELECT * FROM {p}_st{lim})"))
    out.append((f"{p}_w", f"SELECT tc.id, tc.term, v.idx, (1 + ln(tc.tf)) * v.idf AS w "
                          f"FROM {p}_tc tc JOIN {voc} v ON tc.term = v.term"))
    out.append((f"{p}_nw", f"SELECT id, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight "
                           f"FROM {p}_w"))
    return out
