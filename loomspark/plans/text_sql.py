"""Folded and stemmed terms in SQL, written from the rules and not from the code that they check."""

from __future__ import annotations

from loomspark.functions.stemming import LONGEST, SHORTEST, STEP_2, STEP_3, STEP_4

#: Lower-case runs of letters and digits without accents, and those that keep _ - . /
PROSE = r"list_filter(string_split_regex(lower(strip_accents({0})), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
SCREEN = r"list_filter(string_split_regex(lower(strip_accents({0})), '[^\p{{L}}\p{{N}}_\-./]+'), lambda x: x <> '')"


def _shape(w: str) -> str:
    """V for a vowel, c for any other character; y is none after a vowel or at the beginning."""
    marked = rf"regexp_replace(regexp_replace({w}, '(^|[aeiou])y', '\1Y', 'g'), 'yy', 'yY', 'g')"
    return f"regexp_replace(regexp_replace({marked}, '[aeiouy]', 'V', 'g'), '[^V]', 'c', 'g')"


def _measure(w: str) -> str:
    return f"len(regexp_extract_all({_shape(w)}, 'Vc'))"


def _short(w: str) -> str:
    return f"(regexp_matches({_shape(w)}, 'cVc$') AND NOT regexp_matches({w}, '[wxy]$'))"


def _longest(rules: dict[str, str], least: int, extra: str = "true") -> str:
    """The longest of the suffixes that w ends in gives way, if its base has the measure."""
    when = []
    for suffix in sorted(rules, key=len, reverse=True):
        base = f"left(w, length(w) - {len(suffix)})"
        also = extra.format(base=base) if suffix == "ion" else "true"
        when.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {_measure(base)} > {least} AND {also} THEN {base} || '{rules[suffix]}' ELSE w END")
    return f"CASE {' '.join(when)} ELSE w END"


def stems(vocabulary: str) -> str:
    """Table expressions up to ``stems`` (term, stem), over ``vocabulary`` (term)."""
    cut = lambda n: f"left(w, length(w) - {n})"
    twice = "regexp_matches(b, '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yy)$')"
    steps = [
        f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {cut(2)} WHEN ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') THEN {cut(1)} ELSE w END",
        f"""CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_measure(cut(3))} > 0 THEN {cut(1)} ELSE w END
  WHEN ends_with(w, 'ed') AND contains({_shape(cut(2))}, 'V') THEN {cut(2)} || '+' WHEN ends_with(w, 'ing') AND contains({_shape(cut(3))}, 'V') THEN {cut(3)} || '+' ELSE w END""",
        f"""CASE WHEN NOT ends_with(w, '+') THEN w ELSE (SELECT CASE WHEN ends_with(b, 'at') OR ends_with(b, 'bl') OR ends_with(b, 'iz') THEN b || 'e' WHEN {twice} AND ends_with({_shape('b')}, 'c') THEN left(b, length(b) - 1)
  WHEN {_measure('b')} = 1 AND {_short('b')} THEN b || 'e' ELSE b END FROM (SELECT {cut(1)} AS b)) END""",
        f"CASE WHEN ends_with(w, 'y') AND contains({_shape(cut(1))}, 'V') THEN {cut(1)} || 'i' ELSE w END",
        _longest(STEP_2, 0),
        _longest(STEP_3, 0),
        _longest(dict.fromkeys(STEP_4, ""), 1, "(ends_with({base}, 's') OR ends_with({base}, 't'))"),
        f"CASE WHEN ends_with(w, 'e') AND ({_measure(cut(1))} > 1 OR ({_measure(cut(1))} = 1 AND NOT {_short(cut(1))})) THEN {cut(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {_measure('w')} > 1 THEN {cut(1)} ELSE w END",
    ]
    out = [f"stem0 AS (SELECT DISTINCT term, term AS w FROM {vocabulary})"]
    out += [f"stem{i + 1} AS (SELECT term, {step} AS w FROM stem{i})" for i, step in enumerate(steps)]
    out.append(f"stems AS (SELECT term, CASE WHEN length(term) BETWEEN {SHORTEST} AND {LONGEST} THEN w ELSE term END AS stem FROM stem{len(steps)})")
    return ",\n".join(out)
