"""Parsers for model output: open answers, JSON payloads, plans, scores and option texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cliptide.functions import answers as R
from cliptide.functions import text as X

# Phrases after which an open answer usually names its result.
KEY_PHRASES = [
    "could be ", "so ", "is ", "thus ", "therefore ", "final ", "answer ", "result ", "are ", "in total ", "total ",
    "identify ", "recognize ", "calculated as ", "counted as ", "measured as ", "observed as ", "concluded as ",
    "found to be ", "equals ", "determined to be ", "number of ", "value is ", "adds up to ", "have ", "has ",
]
# Shapes of numbers with thousands commas, in scientific and in plain notation.
NUMBERS = [
    r"-?\b\d{1,3}(?:,\d{3})+\b",
    r"-?\d+(?:\.\d+)?[eE][+-]?\d+",
    r"-?(?:\d+\.\d+|\.\d+|\d+\b)(?![eE][+-]?\d+)(?![,\d])",
]
#: A whole text that is a number once its commas are gone.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _number(text: Column) -> Column:
    """The number that a text is, to two decimals, else null."""
    bare = F.replace(X.strip(text), F.lit(","), F.lit(""))
    return F.when(bare.rlike(NUMBER), F.round(bare.try_cast("double"), 2))


def _words(text: Column) -> Column:
    """Forms that a text is looked up with if it is no number: lower case, a single letter with a blank on either side."""
    low = F.lower(X.strip(text))
    padded = F.array(F.concat(F.lit(" "), low), F.concat(low, F.lit(" ")))
    return F.when(_number(text).isNotNull(), F.array().cast("array<string>")).when(F.length(low) == 1, padded).otherwise(F.array(low))


def _tail(line: Column, last: Column) -> Column:
    """The shortest text after the last place of a key phrase, of equally short ones that of the first phrase."""
    signs = [*KEY_PHRASES, "="]
    tails = F.array(
        *[
            F.when(
                F.contains(line, F.lit(sign)) & (last if sign == "=" else F.lit(True)),
                F.struct(F.lit(0).alias("size"), F.lit(n).alias("n"), X.strip(F.substring_index(line, sign, -1)).alias("tail")),
            )
            for n, sign in enumerate(signs)
        ]
    )
    sized = F.transform(F.filter(tails, lambda t: t["tail"] != ""), lambda t: t.withField("size", F.length(t["tail"])))
    best = F.array_min(sized)["tail"]
    return F.when(~best.isin(*":,.!?;'\""), best)


def open_answer_pieces(response: Column) -> Column:
    """Texts that may hold the result of an open answer, and the numbers in them.

    Per line what follows a key phrase; the whole answer if no line has one. Null, empty and failed answers have none.
    """
    body = F.lower(F.btrim(X.strip(response), F.lit(".")))
    lines = F.split(body, "\n")
    tails = F.filter(F.transform(lines, lambda x, i: _tail(x, i == F.size(lines) - 1)), lambda t: t.isNotNull())
    texts = F.when(F.size(tails) > 0, tails).otherwise(F.array(body))
    numbers = F.flatten(
        F.transform(texts, lambda t: F.concat(*[F.regexp_extract_all(t, F.lit(shape), F.lit(0)) for shape in NUMBERS]))
    )
    none = F.array().cast("array<string>")
    return F.when(response.isNull() | response.isin("", "API Error"), none).otherwise(F.concat(texts, numbers))


def open_answer_correct(prediction: Column, gold: Column) -> Column:
    """Whether a gold text occurs in a text of the answer, or a gold number equals one of its numbers."""
    pieces = open_answer_pieces(prediction)
    golds = F.coalesce(gold, F.array().cast("array<string>"))
    wanted_words = F.flatten(F.transform(golds, _words))
    wanted_numbers = F.filter(F.transform(golds, _number), lambda n: n.isNotNull())
    said_words = F.flatten(F.transform(pieces, _words))
    said_numbers = F.filter(F.transform(pieces, _number), lambda n: n.isNotNull())
    text_hit = F.exists(said_words, lambda said: F.exists(wanted_words, lambda g: F.contains(said, g)))
    return text_hit | F.arrays_overlap(said_numbers, wanted_numbers)


def option_parts(text: Column) -> Column:
    """(letter, text) of an answer like ``B`` or ``Answer: B) text``; no letter keeps the whole text."""
    body = X.strip(F.replace(F.coalesce(text, F.lit("")), F.lit("*"), F.lit("")))
    shape = r"(?i)Answer:\s*([A-E])\)?\.?\s*(.*)"
    alone, tagged = body.rlike("(?i)^[A-E]$"), body.rlike(shape)
    return F.struct(
        F.when(alone, F.upper(body)).when(tagged, F.upper(F.regexp_extract(body, shape, 1))).alias("letter"),
        F.when(alone, F.lit("")).when(tagged, F.trim(F.regexp_extract(body, shape, 2))).otherwise(body).alias("text"),
    )


def option_match(response: Column, letter: Column, text: Column) -> Column:
    """Same option: equal letters with texts that agree if both are given, or equal texts without letters."""
    said = option_parts(response)
    same_text = F.lower(said["text"]) == F.lower(F.coalesce(text, F.lit("")))
    both = said["letter"].isNotNull() & letter.isNotNull() & (letter != "")
    partial = (said["text"] == "") | (F.coalesce(text, F.lit("")) == "")
    return F.when(both, (said["letter"] == letter) & (partial | same_text)).otherwise(same_text)


def choice_or_content(response: Column, options: Column, choices: str = "ABCD") -> Column:
    """Option letter by its marks, else (in a longer response) the option text that occurs last."""
    marked = R.choice_letter(response, choices, None)
    low = F.lower(response)
    places = F.transform(
        F.map_entries(options),
        lambda e: F.struct(
            (F.length(low) - F.instr(F.reverse(low), F.reverse(F.lower(e["value"])))).alias("at"),
            F.contains(low, F.lower(e["value"])).alias("found"),
            e["key"].alias("key"),
        ),
    )
    last = F.array_max(F.filter(places, lambda p: p["found"]))["key"]
    many = F.size(F.split(X.squeeze(response), " ")) > 5
    return F.when(response.isNull() | response.isin("", "API Error"), F.lit("API Error")).otherwise(
        F.coalesce(F.nullif(marked, F.lit("")), F.when(many, last), F.lit("No Answer Found."))
    )


def subset_name(identifier: Column) -> Column:
    """Subset between the split prefix and the trailing number of an item id."""
    return F.regexp_extract(identifier, r"^[^_]+_(.+?)_[0-9]+$", 1)


def json_payload(text: Column) -> Column:
    """First readable JSON of a reply as a variant: unfenced text, else its outermost braces or brackets."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "(?m)^\\s*```[a-zA-Z]*\\s*$", ""))
    braces = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    brackets = F.regexp_extract(bare, r"(?s)\[.*\]", 0)
    return F.coalesce(*[F.try_parse_json(F.nullif(c, F.lit(""))) for c in (bare, braces, brackets)])


def float_list(text: Column) -> Column:
    """Comma list of numbers, clipped to [1e-6, 1], distinct and sorted."""
    numbers = F.transform(F.split(text, ","), lambda t: F.trim(t).try_cast("double"))
    clipped = F.transform(
        F.filter(numbers, lambda x: x.isNotNull()), lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1.0))
    )
    return F.array_sort(F.array_distinct(clipped))


def plan_steps(text: Column, question: Column) -> Column:
    """Steps of a plan: a JSON list, else the lines without their list marks, else the question."""
    body = X.strip(F.coalesce(text, F.lit("")))

    def kept(items: Column) -> Column:
        return F.filter(F.transform(items, X.strip), lambda t: t != "")

    is_list = F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("ARRAY"), F.lit(False))
    listed = F.when(is_list, kept(F.from_json(body, "array<string>")))
    lines = kept(
        F.transform(F.split(body, "\n"), lambda t: F.regexp_replace(t, r"^\s*(?:[-*]|[0-9]+[.):：-])\s*", ""))
    )
    return (
        F.when(F.size(listed) > 0, listed).when(F.size(lines) > 0, lines).otherwise(F.array(X.strip(question)))
    )


def total_score(text: Column) -> Column:
    """Number after "total score:", else the sum of all "score:" numbers, else the last number, else zero."""
    number = r"(-?[0-9]+(?:\.[0-9]+)?)"
    named = F.regexp_extract(text, rf"(?i)total\s+score\s*[:：]\s*{number}", 1)
    scores = F.regexp_extract_all(text, F.lit(rf"(?i)\bscore\s*[:：]\s*{number}"), F.lit(1))
    numbers = F.regexp_extract_all(text, F.lit(number), F.lit(1))
    summed = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return (
        F.when(named != "", named.try_cast("double"))
        .when(F.size(scores) > 0, summed)
        .when(F.size(numbers) > 0, F.element_at(numbers, -1).try_cast("double"))
        .otherwise(F.lit(0.0))
    )


def cache_key(value: Column) -> Column:
    """SHA-1 of a value's JSON form."""
    return F.sha1(F.to_json(value).cast("binary"))


def detail_text(value: Column) -> Column:
    """One paragraph from JSON text: a string, a list of strings or the values of an object."""
    parsed = F.try_parse_json(value)
    kind = F.schema_of_variant(parsed)
    listed = F.array_join(F.filter(F.from_json(value, "array<string>"), lambda t: F.trim(t) != ""), " ")
    mapped = F.array_join(F.map_values(F.from_json(value, "map<string,string>")), " ")
    return X.squeeze(
        F.when(kind.startswith("ARRAY"), listed)
        .when(kind.startswith("OBJECT"), mapped)
        .when(kind == "STRING", F.variant_get(parsed, "$", "string"))
        .otherwise(value)
    )


def choice_map(options: Column) -> Column:
    """Options keyed by letter, A to D only, in order."""
    return F.map_from_entries(
        F.array_sort(F.filter(F.map_entries(options), lambda e: F.upper(e["key"]).isin("A", "B", "C", "D")))
    )


def options_by_letter(options: Column) -> Column:
    """List of options as a letter-keyed map."""
    return F.map_from_arrays(F.transform(options, lambda o, i: F.char(i + 65)), options)


def merged_memories(given: Column, extra: Column, mode: str) -> Column:
    """Replace, append or prepend extra memories; the first of equal texts stays."""
    if mode == "replace":
        joined = extra
    elif mode == "append":
        joined = F.concat(given, extra)
    elif mode == "prepend":
        joined = F.concat(extra, given)
    else:
        raise ValueError(f"unknown memory mode: {mode}")
    return F.array_distinct(joined)


def clip_text(texts: Column, clip: Column, limit: int | None = None) -> Column:
    """Clip text for a reranking prompt, cut to ``limit`` characters if one is given; a clip without text is named."""
    joined = X.strip(F.array_join(F.filter(texts, lambda t: t != ""), "\n"))
    known = F.when(joined != "", joined).otherwise(
        F.concat(F.lit("Memory evidence from CLIP_"), clip.cast("string"), F.lit("."))
    )
    if limit is None:
        return known
    cut = F.concat(F.rtrim(F.substring(known, 1, limit)), F.lit("..."))
    return F.when(F.length(known) > limit, cut).otherwise(known)
