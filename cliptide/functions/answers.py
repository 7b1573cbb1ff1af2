"""Answer parsing: option letters, open answers, route labels, agent actions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cliptide.functions import text as X

# Markers that make a question complex, caption and graph variant.
COMPLEX_MARKERS = {
    "caption": [
        "after", "all ", "before", "both", "compare", "count", "difference", "differences", "each",
        "final", "first", "how many", "last", "multiple", "number of", "relationship", "sequence",
        "several", "then", "three", "why",
    ],
}

# Words that name a retrieval route.
ROUTE_WORDS = {
    "A": ["zero", "no retrieval", "no-retrieval", "none"],
    "B": ["single", "one-step", "1-step", "one hop", "single-step"],
    "C": ["multi", "complex", "multi-step", "multihop", "multi-hop"],
}

# Phrases cut before the first option letter is read; two entries are joined
# pairs, so their parts are not cut on their own.
ANSWER_PREFIXES = [
    "The best answer is",
    "The correct answer is",
    "The answer is",
    "The answer",
    "The best option isThe correct option is",
    "Best answer:Best option:",
]


def normalize_plain(text: Column) -> Column:
    """Trimmed, lower case, single spaces."""
    return F.lower(X.squeeze(F.coalesce(text, F.lit(""))))


def extract_option(text: Column) -> Column:
    """Letter A to D at the start or after ANSWER / OPTION; empty if there is none."""
    upper = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    first = F.regexp_extract(upper, r"^[ \t\r\n]*\(?([A-D])\)?(?:[. \t\r\n:]|$)", 1)
    later = F.regexp_extract(upper, r"(?:ANSWER|OPTION)[ \t\r\n]*[:=]?[ \t\r\n]*\(?([A-D])\)?", 1)
    return F.when(first != "", first).otherwise(later)


def exact_form(text: Column) -> Column:
    """Lower case, single spaces, outer punctuation removed."""
    return F.btrim(normalize_plain(text), F.lit(X.PUNCTUATION + " "))


def _stripped(response: Column, newline: str) -> Column:
    """Response without newlines and outer punctuation, padded with blanks."""
    body = F.regexp_replace(response, "\n", newline) if newline is not None else response
    for mark in [",", ".", "!", "?", ";", ":", "'"]:
        body = F.btrim(body, F.lit(mark))
    return F.concat(F.lit(" "), body, F.lit(" "))


def _last_position(text: Column, needle: str) -> Column:
    """1-based place of the last occurrence, zero if absent."""
    turned = F.instr(F.reverse(text), F.lit(needle[::-1]))
    return F.when(turned == 0, 0).otherwise(F.length(text) - turned - len(needle) + 2)


def _pick(body: Column, choices: str, found: dict[str, Column], shape: str) -> Column:
    """Letter whose shaped mark occurs last among the found letters, first letter on ties."""
    places = [
        F.when(found[c], F.struct(_last_position(body, shape.format(c)).alias("at"), F.lit(-i).alias("i"), F.lit(c).alias("c")))
        for i, c in enumerate(choices)
    ]
    return F.array_max(F.array_compact(F.array(*places)))["c"]


def choice_letter(
    response: Column, choices: str = "ABCD", newline: str | None = "", exclusive: bool = False
) -> Column:
    """Option letter by the marks ``X.``, ``X:``, ``(X)`` and ``X `` in that order.

    The first kind of mark that occurs decides (``exclusive``); otherwise period and colon marks
    count together. Among several letters the one occurring last wins. ``newline`` is what a line
    break becomes (None leaves it).
    """
    body = _stripped(F.coalesce(response, F.lit("")), newline)
    has = {s: {c: body.contains(s.format(c)) for c in choices} for s in ("{}.", "{}:", "({})", "{} ")}

    def some(found: dict[str, Column]) -> Column:
        out = F.lit(False)
        for test in found.values():
            out = out | test
        return out

    period, colon, bracket, blank = (has[s] for s in ("{}.", "{}:", "({})", "{} "))
    if exclusive:
        picked = (
            F.when(some(period), _pick(body, choices, period, "{}."))
            .when(some(colon), _pick(body, choices, colon, "{}:"))
            .when(some(bracket), _pick(body, choices, bracket, "({})"))
            .when(some(blank), _pick(body, choices, blank, "{} "))
        )
    else:
        # a letter found by its colon only is placed by its (absent) period mark when any period
        # mark exists, exactly as the list of periods is searched first
        either = {c: period[c] | colon[c] for c in choices}
        picked = (
            F.when(some(period), _pick(body, choices, either, "{}."))
            .when(some(colon), _pick(body, choices, colon, "{}:"))
            .when(some(bracket), _pick(body, choices, bracket, "({})"))
            .when(some(blank), _pick(body, choices, blank, " {} "))
        )
    unusable = response.isNull() | response.isin("", "API Error")
    return F.when(unusable, F.lit("")).otherwise(F.coalesce(picked, F.lit("")))


def first_letter(text: Column, letters: str = "ABCD") -> Column:
    """First option letter after cutting the usual answer phrases."""
    body = F.trim(F.coalesce(text, F.lit("")))
    for prefix in ANSWER_PREFIXES:
        body = F.replace(body, F.lit(prefix), F.lit(""))
    return F.regexp_extract(body, f"[{letters}]", 0)


def letter_before_bracket(text: Column) -> Column:
    """Character before the first closing bracket, the whole text without one."""
    place = F.instr(text, F.lit(")"))
    return F.when(place > 1, F.substring(text, place - 1, F.lit(1))).when(
        place == 1, F.substring(text, F.length(text), F.lit(1))
    ).otherwise(text)


def choice_with_options(response: Column, options: Column) -> Column:
    """Letter named in the response, else the option whose text opens it; null if none."""
    body = F.translate(F.trim(response), "*`", "  ")
    named = F.upper(F.regexp_extract(body, r"(?i)\b(?:answer|option|choice)[ \t]*[::]?[ \t]*\**[ \t]*([ABCD])\b", 1))
    alone = F.upper(F.regexp_extract(body, r"(?i)^[ \t]*\**[ \t]*([ABCD])[ \t]*[.):\-]?[ \t]*$", 1))
    word = F.upper(F.regexp_extract(body, r"(?i)\b([ABCD])\b", 1))
    known = F.map_keys(options)
    lowered = normalize_plain(response)
    opening = F.filter(
        F.array_sort(F.map_entries(options)), lambda e: lowered.startswith(normalize_plain(e["value"]))
    )
    direct = F.coalesce(
        *[F.when(F.array_contains(known, letter), letter) for letter in (named, alone, word)],
        F.get(opening, 0)["key"],
    )
    return F.when(response.isNull() | (response == "") | (F.size(options) == 0), F.lit(None)).otherwise(direct)


def route_label(value: Column, fallback: str | None = "B") -> Column:
    """A, B or C from a label, a lone letter or a describing word."""
    upper = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    lowered = F.lower(upper)
    lone = F.regexp_extract(upper, r"\b([ABC])\b", 1)
    out = F.when(upper.isin("A", "B", "C"), upper).when(lone != "", lone)
    for label in ("A", "B", "C"):
        test = F.lit(False)
        for word in ROUTE_WORDS[label]:
            test = test | lowered.contains(word)
        out = out.when(test, F.lit(label))
    return out.otherwise(F.lit(fallback if fallback is not None else ""))


def heuristic_route(question: Column, markers: list[str]) -> Column:
    """C for questions holding a complexity marker, else B."""
    body = X.text_key(question)
    test = F.lit(False)
    for marker in markers:
        test = test | body.contains(marker)
    return F.when(test, F.lit("C")).otherwise(F.lit("B"))


def agent_action(response: Column) -> Column:
    """Action and content of an agent turn, read after the reasoning block."""
    tail = F.element_at(F.split(response, "</think>"), -1)
    pattern = r"(?s)Action: \[(.*)\].*Content: (.*)"
    found = tail.rlike(pattern)
    return F.struct(
        F.when(found, F.regexp_extract(tail, pattern, 1)).otherwise(F.lit("Search")).alias("action"),
        F.when(found, X.strip(F.regexp_extract(tail, pattern, 2))).alias("content"),
    )


def build_query(question: Column, options: Column) -> Column:
    """Question followed by one lettered line per option."""
    lines = F.transform(
        F.coalesce(options, F.array().cast("array<string>")),
        lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o),
    )
    asked = X.strip(F.coalesce(question, F.lit("")))
    return X.strip(F.array_join(F.concat(F.array(asked), lines), "\n"))


def token_cost(tokens: Column, usd_per_million: Column) -> Column:
    return tokens.cast("double") * usd_per_million / 1_000_000.0
