"""Text functions as column expressions; lengths and offsets count code points."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmill.functions import fixed


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def matches(text: str | Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether the pattern occurs; word characters are Unicode ones, `$` aside.

    Of an ASCII text a pattern asks the same without Unicode's classes, which Java is slow with.
    """
    plain = F.octet_length(col(text)) == F.length(col(text))
    return F.when(plain, col(text).rlike(("(?i)" if ignore_case else "") + pattern)).otherwise(col(text).rlike(("(?iU)" if ignore_case else "(?U)") + pattern))


def token_estimate(text: str | Column) -> Column:
    """Estimated tokens: letter runs 1 + (n - 1) / 6, digit runs n / 2, other symbols 0.9, rounded up.

    Summed as doubles from left to right, since the order decides how tenths round. That can
    only tell where the tenths come to a whole number, so that other texts are counted at once.
    """
    text = col(text)
    runs = F.regexp_extract_all(text, F.lit(r"([A-Za-z]+|[0-9]+|[^\sA-Za-z0-9])"), F.lit(1))
    first = lambda r, low, high: F.ascii(r).between(ord(low), ord(high))
    cost = lambda r: (
        F.when(first(r, "A", "Z") | first(r, "a", "z"), (F.floor((F.length(r) - 1) / 6) + 1).cast("double"))
        .when(first(r, "0", "9"), F.length(r) / F.lit(2.0))
        .otherwise(F.lit(0.9).cast("double"))
    )
    summed = F.ceil(F.aggregate(runs, F.lit(0.0).cast("double"), lambda a, r: a + cost(r))).cast("long")
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    tenths = 10 * F.regexp_count(text, F.lit("[A-Za-z]{1,6}")) + 5 * left("[^0-9]+") + 9 * left(r"[\sA-Za-z0-9]+")
    whole = lambda x: F.when((x % 10 == 0) | (x > 100_000_000), summed).otherwise(F.ceil(x / 10).cast("long"))
    return F.get(F.transform(F.array(tenths), whole), F.lit(0))


def fact_score(line: str | Column) -> Column:
    """How many fact patterns match the line; 0 for an empty one."""
    line = col(line)
    every = sum((line.rlike(("(?iU)" if i else "(?U)") + p).cast("int") for p, i in fixed.FACT_PATTERNS), F.lit(0))
    small = F.lower(line)
    holds = {"0": line.rlike("[0-9]"), "/": line.contains("/") | line.contains("\\"), ".": line.contains(".")}

    def found(k: int, pattern: str, ignore_case: bool) -> Column:
        """Whether an ASCII line matches, which is only asked where it holds what a match needs."""
        needs = [holds[fixed.FACT_NEEDS[k]]] if fixed.FACT_NEEDS[k] else []
        if k in fixed.FACT_HINTS:
            needs.append(reduce(or_, (small.contains(w) for w in fixed.FACT_HINTS[k])))
        if k in fixed.FACT_SIGNS:
            needs.append(line.rlike(fixed.FACT_SIGNS[k]))
        return reduce(and_, [*needs, line.rlike(("(?i)" if ignore_case else "") + pattern)]).cast("int")

    plain = sum((found(k, p, i) for k, (p, i) in enumerate(fixed.FACT_PATTERNS)), F.lit(0))
    return F.when(F.length(line) == 0, 0).when(F.octet_length(line) == F.length(line), plain).otherwise(F.coalesce(every, F.lit(0)))


def fact_tokens(text: str | Column) -> Column:
    """Distinct candidate tokens: runs with a digit, and longer words with a separator, without trailing `. : ,`."""
    found = lambda p: F.regexp_extract_all(col(text), F.lit(f"({p})"), F.lit(1))
    bare = lambda t: F.rtrim(t, F.lit(".:,"))
    digits = F.transform(F.filter(found(fixed.DIGIT_TOKEN), lambda t: t.rlike("[0-9]")), bare)
    words = F.filter(found(fixed.WORD_TOKEN), lambda t: t.rlike("[/_.]") & ~t.rlike("[0-9]") & (F.length(bare(t)) >= 8))
    return F.array_union(digits, F.transform(words, bare))


def char_slice(text: str | Column, start: int, end: int) -> Column:
    """Characters from `start` (from 0) up to `end`."""
    return F.substring(col(text), start + 1, max(end - start, 0))


#: How a text says that it was condensed; further spellings can be given.
CONDENSED = r"\[condensed: (?:omitted|truncated) "


def is_condensed(text: str | Column, patterns: tuple[str, ...] = (CONDENSED,)) -> Column:
    return col(text).rlike("|".join(f"(?:{p})" for p in patterns))


def named_values(text: str | Column) -> Column:
    """Distinct paths, hexadecimal runs and numbers of a text."""
    return F.array_distinct(F.regexp_extract_all(col(text), F.lit(f"(?iU)({fixed.FACT_TOKEN})"), F.lit(1)))


def occurs_apart(text: str | Column, token: Column) -> Column:
    """Whether the token occurs without a letter or digit on either side."""
    apart = r"[\p{IsAlphabetic}\p{N}]"
    quoted = F.concat(F.lit("\\Q"), F.replace(token, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.rlike(col(text), F.concat(F.lit(f"(?<!{apart})"), quoted, F.lit(f"(?!{apart})")))


def kept_note(tool_use_id: str | Column) -> Column:
    return F.concat(F.lit("the full output stays in the transcript under `"), col(tool_use_id), F.lit("`"))


def saved_note(path: str | Column) -> Column:
    return F.concat(F.lit("the full output is saved at "), col(path), F.lit("; read it for what is not kept here"))


def share_text(part: Column, whole: Column) -> Column:
    """A share in whole per cent; of nothing, 0 %."""
    return F.concat(F.coalesce(F.round(F.try_divide(100.0 * part, whole)), F.lit(0.0)).cast("long").cast("string"), F.lit("%"))


def age_text(ms: Column) -> Column:
    """An age in the largest unit that it fills."""
    for_unit = lambda size, name: F.concat(F.floor(ms / size).cast("string"), F.lit(name))
    return F.when(ms >= 86_400_000, for_unit(86_400_000, "d")).when(ms >= 3_600_000, for_unit(3_600_000, "h")).when(ms >= 60_000, for_unit(60_000, "m")).otherwise(for_unit(1000, "s"))


def as_object(value: str | Column) -> Column:
    """JSON of a call's arguments: an object as it is, a text as {"raw": text}, nothing as {}."""
    value = col(value)
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", "{}").when(F.json_object_keys(value).isNotNull() & F.trim(value).startswith("{"), value).otherwise(F.to_json(F.struct(value.alias("raw"))))


def truncated(text: str | Column, limit: int) -> Column:
    text = col(text)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit - 1)), F.lit("…")))


def abridged(text: str | Column, head: int, tail: int) -> Column:
    text = col(text)
    left_out = (F.length(text) - head - tail).cast("string")
    short = F.concat(F.left(text, F.lit(head)), F.lit("\n[… "), left_out, F.lit(" chars omitted …]\n"), F.right(text, F.lit(tail)))
    return F.when(F.length(text) <= head + tail + 40, text).otherwise(short)


def file_safe(name: str | Column) -> Column:
    """A file name: at most 200 characters of `[A-Za-z0-9_.-]`, no leading dot, never empty."""
    safe = F.regexp_replace(F.left(col(name), F.lit(200)), "[^A-Za-z0-9_.-]", "_")
    safe = F.regexp_replace(safe, "^[.]", "_")
    return F.when(safe == "", "_").otherwise(safe)


def short_hash(text: str | Column) -> Column:
    return F.left(F.sha2(col(text).cast("string"), 256), F.lit(12))


def _command(source: Column, name: str) -> Column:
    """A command of a call's arguments: a text, or an array of words."""
    whole = F.get_json_object(source, f"$.{name}")
    words = F.from_json(F.concat(F.lit('{"x":'), whole, F.lit("}")), "x array<string>").x
    return F.when(F.trim(whole).startswith("["), F.coalesce(F.array_join(words, " "), whole)).otherwise(whole)


def writes_file(command: str | Column) -> Column:
    return col(command).rlike(fixed.FILE_REDIRECT)


def reproducible(tool: str | Column, input_json: str | Column) -> Column:
    """Whether running the call again gives its result back: a read of files, not of the world."""
    tool, source = col(tool), col(input_json)
    command = F.coalesce(_command(source, "command"), _command(source, "cmd"), F.lit(""))
    quiet = F.regexp_replace(command, fixed.REDIRECT_NOISE, "")

    def reads(segment: Column) -> Column:
        words = F.trim(segment)
        for prefix in fixed.PREFIXES:
            words = F.regexp_replace(words, prefix, "")
        verb = F.lower(F.regexp_replace(F.regexp_extract(words, r"^(\S*)", 1), "^[\"']+|[\"']+$", ""))
        measured = verb.isin(fixed.METADATA_VERBS) | words.rlike(fixed.LONG_LISTING) | words.rlike(fixed.SED_IN_PLACE)
        return (words == "") | words.rlike(fixed.GIT_READS) | (~measured & verb.isin(fixed.READ_VERBS))

    shell = (command != "") & ~writes_file(quiet) & ~quiet.rlike(fixed.TEE_OR_SHELL) & F.forall(F.split(command, fixed.SEGMENTS), reads)
    return ~matches(source, fixed.MUTABLE_SOURCE, True) & (tool.isin(fixed.READ_TOOLS) | (tool.isin(fixed.SHELL_TOOLS) & shell))
