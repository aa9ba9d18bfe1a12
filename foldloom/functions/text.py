"""Column functions over message text: markers, commands, identifiers, sections, tokens.

All are built-in expressions. Substring markers are tested one by one with ``contains`` (no alternation that backtracks).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of errors and of successful checks.
ERROR_MARKERS = (
    "traceback (most recent call last)", "error", "exception", "command not found", "no such file", "failed", "failure",
    "assertionerror", "syntaxerror", "modulenotfounderror", "non-zero exit", "permission denied", "fatal:", "cannot ",
    "unable to", "not permitted", "timed out", "timeout", "connection refused", "segmentation fault", "killed",
)
VERIFY_MARKERS = (
    "passed", "0 failed", "all tests pass", "tests passed", "=== passed", "succeeded", "verification passed",
    "validation passed", "check passed", "no errors", "build succeeded",
)
# Commands that only read (detection, and the wider list of the recall audit).
READ_ONLY = r"^\s*(cat|ls|grep|find|head|tail|pwd|cd|echo|which|wc|tree|git (status|log|diff|show))\b"
READ_ONLY_RECALL = r"^\s*(cat|ls|cd|grep|find|head|tail|pwd|echo|which|wc|tree|less|more|sed -n)\b"
# Identifiers worth remembering.
PATH = r"[A-Za-z0-9_./-]+\.(?:py|cfg|yml|yaml|json|toml|cpp|cc|hpp|js|ts|go|rs|java|sh|rst|txt|ini|html)(?::\d+(?:-\d+)?)?"
#: A path begins where its run of characters does, or right after the match before it; so a run without one is read once,
#: not from each of its characters on.
PATH_START = r"(?:\G|(?<![\w./-]))"
BACKTICK = r"`([A-Za-z_][A-Za-z0-9_./]{2,60})`"
DOTTED = r"\b([A-Za-z_][A-Za-z0-9_]+(?:\.[A-Za-z_][A-Za-z0-9_]+)+)\b"
ERROR_CLASS = r"\b([A-Z][A-Za-z0-9_]*(?:Error|Exception))\b"
#: The same for Java, which tests ``\\w`` in one step and ranges one by one; a run that only its end can follow isn't
#: given back character by character.
JAVA_PATH = PATH_START + PATH.replace("A-Za-z0-9_", r"\w")
JAVA_BACKTICK = BACKTICK.replace("A-Za-z0-9_./", r"\w./")
JAVA_DOTTED = DOTTED.replace("[A-Za-z0-9_]+", r"\w++")
# Section headers of a memory block, in order; the pinned section only in rolling memories.
PINNED = "[Pinned]"
HEADERS = ("[Goal]", "[Attempts & Results]", "[Environment Feedback]", "[Active Constraints]", "[Dead Ends]", "[Open Threads]", "[Next]")
# What a fold says it was triggered by.
PLAN, VERIFIED, FIRST_ACTION, RECOVERY, EXPANSION = "structural:plan", "structural:verified", "structural:first_action", "error_recovery", "expansion"
PHRASES = {
    PLAN: "I'm at a planning milestone, so I'll consolidate the earlier history into long-term memory.",
    VERIFIED: "I've confirmed this subtask is on track, so I'll consolidate the work so far into long-term memory before continuing.",
    FIRST_ACTION: "I've finished gathering context and am moving to act, so I'll consolidate what I've learned into long-term memory.",
    RECOVERY: "I've recovered from the earlier failures and found a workable direction, so I'll consolidate that history into long-term memory.",
    EXPANSION: "The context has grown large, so I'll consolidate the earlier history into long-term memory to stay focused.",
    "structural:testpass": "I've confirmed this subtask is on track, so I'll consolidate the work so far into long-term memory before continuing.",
    "structural:first_write": "I've finished gathering context and am moving to act, so I'll consolidate what I've learned into long-term memory.",
}
DEFAULT_PHRASE = "I'll consolidate the earlier history into long-term memory to keep my working context compact."
ACKNOWLEDGED = "Context condensed. The summary has been saved as your long-term memory and the corresponding earlier raw history has been removed from the working context."

#: The default token: a word, or any other character that isn't blank.
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]"
#: What stripping removes, and what lines end at.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def lines(x: Column) -> Column:
    return F.split(x, LINE_END)


def contains_any(x: Column, markers: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(x, F.lit("")))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(m)) for m in markers))


def has_error(x: Column) -> Column:
    return contains_any(x, ERROR_MARKERS)


def has_verified(x: Column) -> Column:
    return contains_any(x, VERIFY_MARKERS)


#: The older name of the same predicate.
has_testpass = has_verified


def reads_only(command: Column, pattern: str = READ_ONLY) -> Column:
    return strip(command).rlike(pattern)


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(TOKEN), F.lit(0))


def token_count(x: Column) -> Column:
    """How many ``tokens`` there are, without making them: characters that are left of one a word and no blanks."""
    words = F.regexp_replace(F.coalesce(x, F.lit("")), r"\w+", "a")
    return F.length(F.regexp_replace(words, r"[ \t\r\n]+", "")).cast("long")


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")


def argument(arguments: Column, name: str) -> Column:
    """A field of a call's arguments; null where they aren't an object."""
    return F.get_json_object(arguments, f"$.{name}")


def coerced(arguments: Column) -> Column:
    """Arguments as an object: of a JSON string the object that it holds; nothing or anything else that can't be read
    is an empty one."""
    plain = F.from_json(F.concat(F.lit('{"x":'), arguments, F.lit("}")), "x string")["x"]
    held = F.when(F.startswith(F.ltrim(plain), F.lit("{")) & F.try_parse_json(plain).isNotNull(), plain)
    given = F.when(F.startswith(F.ltrim(arguments), F.lit('"')), held).when(F.trim(arguments) != "null", arguments)
    return F.coalesce(given, F.lit("{}"))


def text_of(content: Column, calls: Column) -> Column:
    """Content, then name and arguments of each call; empty parts left out."""
    parts = F.flatten(F.transform(F.coalesce(calls, F.array().cast(calls_type())), lambda c: F.array(F.coalesce(c["function"]["name"], F.lit("")), F.coalesce(c["function"]["arguments"], F.lit("null")))))
    joined = F.array_join(F.filter(F.concat(F.array(F.coalesce(content, F.lit(""))), parts), lambda p: p != ""), "\n")
    return F.when(F.size(calls) > 0, joined).otherwise(F.coalesce(content, F.lit("")))


def calls_type() -> str:
    return "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"


def identifiers(x: Column) -> Column:
    """Distinct identifiers of three characters or more. A pattern is only searched for where the text has what all its
    matches have."""

    def every(t: Column) -> Column:
        has = lambda *some: reduce(lambda a, b: a | b, (F.contains(t, F.lit(s)) for s in some))
        found = lambda p, g, test: F.when(test, F.regexp_extract_all(t, F.lit(p), F.lit(g))).otherwise(F.array().cast("array<string>"))
        made = F.concat(
            F.transform(found(JAVA_PATH, 0, has(".")), lambda p: F.split_part(p, F.lit(":"), F.lit(1))),
            F.transform(found(JAVA_BACKTICK, 1, has("`")), lambda p: F.split_part(p, F.lit("("), F.lit(1))),
            found(JAVA_DOTTED, 1, has(".")), found(ERROR_CLASS, 1, has("Error", "Exception")),
        )
        return F.filter(F.array_distinct(made), lambda p: F.length(p) >= 3)

    # An array of one binds the text, so that it is made once and not for every pattern.
    return F.element_at(F.transform(F.array(F.coalesce(x, F.lit(""))), every), 1)


def mentioned(item: Column, memory: Column) -> Column:
    """The item, or the last part of its path (also in lower case), is in the memory."""
    base = F.element_at(F.split(item, "/"), -1)
    return F.contains(memory, item) | ((base != "") & (F.contains(memory, base) | F.contains(F.lower(memory), F.lower(base))))


def section(memory: Column, header: str) -> Column:
    """Text under a header up to the next other header, stripped of blanks, colons and line ends; else empty."""
    at = F.instr(memory, header)
    tail = F.substring(memory, at + len(header), F.length(memory))
    stops = [F.instr(tail, h) for h in (PINNED, *HEADERS) if h != header]
    first = F.array_min(F.filter(F.array(*stops), lambda s: s > 0))
    body = F.when(first.isNull(), tail).otherwise(F.substring(tail, F.lit(1), first - 1))
    return F.when(at == 0, F.lit("")).otherwise(F.btrim(body, F.lit(": \n")))


def all_headers(memory: Column) -> Column:
    return reduce(lambda a, b: a & b, (F.contains(memory, F.lit(h)) for h in HEADERS))


def with_pinned(memory: Column, pinned: Column) -> Column:
    """The memory with its pinned section set: put first if there is none, else replaced in place."""
    block = F.rtrim(F.concat(F.lit(PINNED + "\n"), pinned), F.lit(BLANKS))
    at = F.instr(memory, PINNED)
    tail = F.substring(memory, at + len(PINNED), F.length(memory))
    first = F.array_min(F.filter(F.array(*(F.instr(tail, h) for h in HEADERS)), lambda s: s > 0))
    after = F.when(first.isNull(), F.lit("")).otherwise(F.substring(tail, first, F.length(memory)))
    inside = strip(F.concat(F.substring(memory, F.lit(1), at - 1), block, F.lit("\n\n"), after))
    return F.when(at == 0, F.concat(block, F.lit("\n\n"), strip(memory))).otherwise(inside)


def merged_pinned(carried: Column, new: Column) -> Column:
    """Carried lines, then new ones; of lines equal when stripped the first stays; fillers go."""
    every = F.concat(lines(F.coalesce(carried, F.lit(""))), lines(F.coalesce(new, F.lit(""))))
    good = F.filter(every, lambda x: (strip(x) != "") & ~F.btrim(F.lower(strip(x)), F.lit("-• ")).isin("", "none", "none yet"))
    # An array of one binds the lines, so that they are made and stripped once.
    both = F.transform(F.array(good), lambda a: F.struct(a.alias("a"), F.transform(a, strip).alias("s")))
    first = lambda b: F.transform(F.array_distinct(b["s"]), lambda s: F.rtrim(F.element_at(b["a"], F.array_position(b["s"], s).cast("int")), F.lit(BLANKS)))
    return F.element_at(F.transform(both, lambda b: F.when(F.size(b["s"]) > 0, F.array_join(first(b), "\n")).otherwise(F.lit("None yet"))), 1)


def phrase(signal: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in PHRASES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, signal), F.lit(DEFAULT_PHRASE))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    short = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), short), F.slice(b, F.lit(1), short), lambda x, y: x.eqNullSafe(y))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, short.cast("long"))
