"""Text, time and number functions as Column expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize(text: Column) -> Column:
    """Lower case, punctuation to blanks, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def middle_truncate(text: Column, n: int) -> Column:
    """At most n characters: the middle gives way to an ellipsis."""
    side = n // 2
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.left(text, F.lit(side)), F.lit("…"), F.right(text, F.lit(side))))


def around(text: Column, needle: str, before: int, n: int) -> Column:
    """n characters that begin a little before the first match."""
    at = F.greatest(F.lit(1), F.instr(F.lower(text), needle) - before)
    return F.substring(text, at, F.lit(n))


def valid_tag(tag: Column) -> Column:
    return tag.rlike("^[a-z0-9]+:[a-z0-9][a-z0-9._-]{0,63}$")


#: White space as Unicode has it: a no-break space as well.
BLANK = r"[\s\p{Z}\x1C-\x1F\x85]"
#: The longest tail that is taken for an attribution.
TAIL_CHARS = 70


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def split_title(title: Column) -> tuple[Column, Column, Column]:
    """(title, speaker, organisation) at the last dash between blanks; the tail splits at its first comma.

    A tail that is empty, long or ends in a question mark is no attribution: the whole title stays, null is empty.
    """
    text = strip(F.coalesce(title, F.lit("")))
    cut = f"{BLANK}+[-–—]{BLANK}+"
    tail = F.element_at(F.split(text, cut), -1)
    head = strip(F.regexp_replace(F.left(text, F.length(text) - F.length(tail)), f"{cut}$", ""))
    split = (head != "") & (tail != "") & (F.length(tail) <= TAIL_CHARS) & ~tail.endswith("?")
    comma = F.instr(tail, ",")
    speaker = F.when(comma > 0, strip(F.left(tail, comma - 1))).otherwise(tail)
    org = F.when(comma > 0, strip(F.substring(tail, comma + 1, F.length(tail)))).otherwise("")
    return F.when(split, head).otherwise(text), F.when(split, speaker).otherwise(""), F.when(split, org).otherwise("")


def primary_language(tag: Column) -> Column:
    """en-US, pt_BR -> en, pt; null for anything else."""
    first = F.element_at(F.split(F.lower(tag), "[-_]"), 1)
    return F.when(first.rlike("^[a-z]{2,3}$"), first)


def deeplink(video: Column, seconds: Column) -> Column:
    """Two seconds of run-up; null for an id with a colon, which names another source."""
    url = F.concat(F.lit("https://youtu.be/"), video.cast("string"), F.lit("?t="), F.greatest(F.lit(0), F.floor(seconds) - 2).cast("string"))
    return F.when(~video.cast("string").contains(":"), url)


def clock(seconds: Column) -> Column:
    """h:mm:ss from an hour on, else m:ss."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours, minutes = F.floor(seconds / 3600), F.floor(seconds / 60)
    long = F.concat(hours.cast("string"), F.lit(":"), two(minutes % 60), F.lit(":"), two(seconds % 60))
    return F.when(seconds >= 3600, long).otherwise(F.concat(minutes.cast("string"), F.lit(":"), two(seconds % 60)))


def offset_seconds(text: Column) -> Column:
    """[h:]m:s or seconds, as whole seconds; null for anything else."""
    part = lambda k: F.try_element_at(F.reverse(F.split(text, ":")), F.lit(k)).cast("long")
    total = part(1) + 60 * F.coalesce(part(2), F.lit(0)) + 3600 * F.coalesce(part(3), F.lit(0))
    return F.when(text.rlike(r"^(\d+:){0,2}\d+$"), total)


#: Seconds of a unit; a month has 30 days and a year 365.
_UNITS = {"s": 1, "sec": 1, "secs": 1, "m": 60, "min": 60, "mins": 60, "h": 3600, "hr": 3600, "hrs": 3600, "d": 86400, "w": 604800, "mo": 2592000, "y": 31536000}
_DAY = r"\d{4}-\d{2}-\d{2}"
_CLOCK = r"\d{2}:\d{2}(:\d{2}(\.\d+)?)?"
_ZONE = r"(Z|[+-]\d{2}:\d{2})"


def corpus_time(text: Column, now: int) -> Column:
    """now, today, yesterday, ``N unit ago``, unix seconds of 9 digits or more, ISO days and stamps -> unix seconds.

    A stamp without a zone is UTC. Null for anything else, and for more than 64 characters.
    """
    said = F.when(F.length(text) <= 64, F.lower(strip(text)))
    # Spark's cast wants seconds before a zone.
    iso = F.regexp_replace(F.upper(said), rf"^({_DAY}[T ]\d{{2}}:\d{{2}})({_ZONE}?)$", "$1:00$2")
    ago = rf"^(\d+){BLANK}*({'|'.join(_UNITS)}){BLANK}*ago$"
    unit = F.create_map(*[F.lit(x) for kv in _UNITS.items() for x in kv])
    count = F.regexp_extract(said, ago, 1).try_cast("long")
    midnight = now - now % 86400
    stamp = lambda x: F.unix_timestamp(x.try_cast("timestamp"))
    return (
        F.when(said == "now", F.lit(now).cast("long"))
        .when(said == "today", F.lit(midnight).cast("long"))
        .when(said == "yesterday", F.lit(midnight - 86400).cast("long"))
        .when(said.rlike(ago), F.lit(now) - count * F.element_at(unit, F.regexp_extract(said, ago, 2)))
        .when(said.rlike(r"^\d{9,}$"), said.try_cast("long"))
        .when(iso.rlike(f"^{_DAY}$"), stamp(F.concat(iso, F.lit("T00:00:00Z"))))
        .when(iso.rlike(f"^{_DAY}[T ]{_CLOCK}{_ZONE}$"), stamp(iso))
        .when(iso.rlike(f"^{_DAY}[T ]{_CLOCK}$"), stamp(F.concat(iso, F.lit("Z"))))
    )


def snap(value: Column, allowed: list[int]) -> Column:
    """The nearest allowed value; of two as near the smaller."""
    return F.array_min(F.array(*[F.struct(F.abs(value - F.lit(a)).alias("d"), F.lit(a).alias("v")) for a in allowed]))["v"]


def tsv(df: DataFrame, columns: list[str]) -> Column:
    """One line: null is empty, booleans are 1 and 0, tabs and line ends are blanks."""
    types = dict(df.dtypes)
    cell = lambda c: F.col(c).cast("int").cast("string") if types[c] == "boolean" else F.regexp_replace(F.col(c).cast("string"), r"[\t\n\r]", " ")
    return F.concat_ws("\t", *[F.coalesce(cell(c), F.lit("")) for c in columns])
