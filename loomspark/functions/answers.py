"""What a reader sees of a text: cited, highlighted, framed for a stream. Native columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds that a citation may name, characters before which no space is left, terms and marks of a highlight.
_KIND = "(?:transcript|ocr|frame)"
_TIGHT = ",.;:!?)]}\n"
MOST_TERMS, MOST_MARKS = 8, 40

# Fixed values of a snippet: its words, what stands for what is left out, a window's worth for each term and each repetition of one,
# and what a window gains that begins a text or a sentence.
SNIPPET_WORDS, LEFT_OUT = 64, " … "
TERM_WORTH, AGAIN_WORTH, TEXT_WORTH, SENTENCE_WORTH = 1000, 1, 120, 100
_WORD = r"[\p{L}\p{N}]+"
#: What lies before the first word of a sentence.
_NEXT_SENTENCE = r"[.:][ \t\r\n]+\z"

_MARKER = rf"([ \t]*)\[(\d{{1,2}})(?:[ ,:]+{_KIND}(?:\+{_KIND})?)?\]([ \t]*)"


def cite(text: Column, known: Column) -> Column:
    """``answer``: markers of ``known`` numbers as [n], others gone with the gap they would leave; ``used``: the numbers that stay, ascending.

    The text is cut at its markers and put together again from left to right, as what
    a dropped marker leaves behind depends on what has been written so far. Null stays null.
    """
    group = lambda g: F.regexp_extract_all(text, F.lit(_MARKER), F.lit(g))
    between = F.split(text, _MARKER, -1)
    empty = F.lit("")
    marks = F.arrays_zip(group(1).alias("pre"), group(2).alias("n"), group(3).alias("post"), F.slice(between, F.lit(2), F.greatest(F.size(between), F.lit(1))).alias("after"))
    start = F.struct(F.element_at(between, 1).alias("out"), F.lit(0).alias("i"))

    def step(acc: Column, m: Column) -> Column:
        last = F.right(acc["out"], F.lit(1))
        # What follows: the next piece, or a further marker, which is never tight; nothing after the last one.
        ends = (acc["i"] + 1 == F.size(marks)) & (m["after"] == "")
        tight = ends | ((m["after"] != "") & F.contains(F.lit(_TIGHT), F.left(m["after"], F.lit(1))))
        gap = (last != "") & ~last.isin(" ", "\t", "\n") & ~tight & ((m["pre"] != "") | (m["post"] != ""))
        stays = F.concat(m["pre"], F.lit("["), m["n"].cast("int").cast("string"), F.lit("]"), m["post"])
        written = F.when(F.array_contains(known, m["n"].cast("int")), stays).when(gap, F.lit(" ")).otherwise(empty)
        return F.struct(F.concat(acc["out"], written, m["after"]).alias("out"), (acc["i"] + 1).alias("i"))

    answer = F.regexp_replace(F.aggregate(marks, start, step, lambda a: a["out"]), r"^\s+|\s+$", "")
    used = F.array_sort(F.array_intersect(F.transform(group(2), lambda n: n.cast("int")), known))
    return F.when(text.isNotNull(), F.struct(answer.alias("answer"), used.alias("used")))


def highlight_terms(query: str) -> list[str]:
    """The longest distinct words of a query, of two characters and more."""
    words = {w for w in re.split(r"[^\w'-]+", query.lower()) if len(w) > 1}
    return sorted(words, key=lambda w: (-len(w), w))[:MOST_TERMS]


def highlight(text: Column, query: str) -> Column:
    """array<struct<text, hit>>: the text in order, the first ``MOST_MARKS`` places of the query's words apart. Null or empty: no parts."""
    part = lambda t, hit: F.struct(t.alias("text"), F.lit(hit).alias("hit"))
    terms = highlight_terms(query)
    if not terms:
        whole = F.array(part(text, False))
    else:
        pattern = "(?iu)" + "|".join(rf"\Q{t}\E" for t in terms)
        rest = F.split(text, pattern, MOST_MARKS + 1)
        hits = F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(1), F.lit(MOST_MARKS))
        both = F.flatten(F.zip_with(rest, hits, lambda a, b: F.array(part(a, False), part(b, True))))
        whole = F.filter(both, lambda p: p["text"].isNotNull() & (p["text"] != ""))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<struct<text:string,hit:boolean>>")).otherwise(whole)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often a lambda looks at it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _window(marks: Column, sentences: Column) -> Column:
    """Where the best ``SNIPPET_WORDS`` words begin, from 0; null without a term.

    ``marks`` has each word's place and its term, if it is one. Windows are tried at each term, then centred on the terms
    in them, and at the beginning of each term's sentence. The best holds most different terms; the first of equal ones.
    """
    n, size = F.size(marks), F.lit(SNIPPET_WORDS)
    terms = lambda since, words: F.filter(F.slice(marks, since + 1, words), lambda m: m["term"].isNotNull())
    worth = lambda held: F.size(held) * AGAIN_WORTH + F.size(F.array_distinct(F.transform(held, lambda m: m["term"]))) * (TERM_WORTH - AGAIN_WORTH)
    choice = lambda worth, at, centred, begin: F.struct(worth.alias("worth"), (-at).alias("at"), F.lit(centred).alias("centred"), begin.alias("begin"))

    def centred(m: Column) -> Column:
        middle = lambda held: m["at"] - F.floor((size - (F.element_at(held, -1)["at"] + 1 - m["at"])) / 2).cast("int")
        return _let(terms(m["at"], size), lambda held: choice(worth(held), m["at"], True, F.greatest(F.lit(0), F.least(middle(held), n - size))))

    def begun(s: Column, k: Column) -> Column:
        first = F.get(terms(s + 1, F.coalesce(F.get(sentences, k + 1), n) - s - 1), F.lit(0))["at"]
        more = F.when(s == 0, TEXT_WORTH).otherwise(SENTENCE_WORTH)
        return F.when((n > size) & first.isNotNull(), choice(worth(terms(s, size)) + more, first, False, s))

    every = F.concat(F.transform(F.filter(marks, lambda m: m["term"].isNotNull()), centred), F.transform(sentences, begun))
    return F.array_max(every)["begin"]


def snippet(text: Column, terms: Sequence[str]) -> Column:
    """The 64 words of a text that say most of a query's terms, as they stand there, with ellipses where the text goes on; the whole text without any term.

    Chosen as the snippet function of SQLite's FTS5 does. Terms are lower-case words.
    """
    words, gaps = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.split(text, _WORD, -1)
    known = F.array(*map(F.lit, terms)).cast("array<string>")
    marks = F.transform(words, lambda w, i: F.struct(i.alias("at"), F.nullif(F.array_position(known, F.lower(w)), F.lit(0).cast("long")).alias("term")))
    begins = F.transform(F.slice(gaps, F.lit(1), F.size(words)), lambda g, i: F.when((i == 0) | g.rlike(_NEXT_SENTENCE), i))

    def cut(at: Column) -> Column:
        size, n = F.lit(SNIPPET_WORDS), F.size(words)
        inner = F.concat(F.slice(gaps, at + 2, F.least(size, n - at) - 1), F.array(F.lit("")))
        body = F.array_join(F.zip_with(F.slice(words, at + 1, size), inner, lambda w, g: F.concat(w, g)), "")
        left = F.lit(LEFT_OUT)
        return F.concat(F.when(at > 0, left).otherwise(F.get(gaps, F.lit(0))), body, F.when(at + size >= n, F.get(gaps, n)).otherwise(left))

    begin = _let(marks, lambda m: _let(F.array_compact(begins), lambda s: _window(m, s)))
    return F.coalesce(_let(begin, cut), text)


def json_line(event: Column) -> Column:
    """One event, one line: JSON escapes the line breaks inside."""
    return F.to_json(event)


def sse_frame(name: Column, event: Column) -> Column:
    """The same for an event stream: a named event of one data line and an empty one."""
    clean = F.coalesce(F.nullif(F.regexp_replace(name, r"[\r\n]", ""), F.lit("")), F.lit("message"))
    return F.concat(F.lit("event: "), clean, F.lit("\ndata: "), json_line(event), F.lit("\n\n"))
