"""Text functions as column expressions: answers, choices, numbers, structure, prompts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that answers, numbers, steps and fences are told by.
NUMBER = r"-?\d+(?:\.\d+)?"
FINAL_LINE = r"(?i)FINAL_?ANSWER\s*:\s*([^\n]+)"
CHOICE_LINE = r"^[\(\[]?([A-Ja-j])[\)\]\.\,\:\-]?$"
CHOICE_SAID = r"(?i)(?:final answer|answer|option|choose)\s*(?:is|:)?\s*[\(\[]?([A-J])[\)\]]?"
BOOL_SAID = r"(?:final answer|answer|label|classification)\s*(?:is|:)?\s*(true|false|yes|no)"
CODE_BLOCK = r"(?is)```(?:python)?\s*(.*?)```"
WORD = r"[\p{L}\p{N}_]+"
ORDINALS = "(首先|其次|然后|最后)"
SENTENCE_ENDS = (".", "?", "!", "。", "？", "！", ":", "：")
STEP_MARKS = (("step ", ":"), ("", "reasoning:"))  # in the text, and in its last 24 characters
REASONING = (
    r"(?is)<think>.*?</think>",
    r"(?is)<\|startofthink\|>.*?<\|endofthink\|>",
    r"(?is)<\|begin_of_thought\|>.*?<\|end_of_thought\|>",
)
ASSERTED = r"(?i)assert\s+([A-Za-z_][A-Za-z0-9_]*)\s*(?:\(|==|!=|<=|>=|<|>|is\b|in\b)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the last match, null if there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def prompt_form(text: Column) -> Column:
    """White space squeezed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def _integer_text(n: Column) -> Column:
    """All digits of a double without a fraction; below 10^38."""
    high = F.floor(F.abs(n) / F.lit(2.0**62))  # exact, as is what is left
    whole = high.cast("decimal(19,0)") * F.lit(2**62).cast("decimal(19,0)") + (F.abs(n) - high * F.lit(2.0**62)).cast("bigint").cast("decimal(19,0)")
    return F.when(F.abs(n) < 2.0**62, n.cast("bigint").cast("string")).otherwise(F.concat(F.when(n < 0, F.lit("-")).otherwise(F.lit("")), whole.cast("string")))


def _fraction_text(n: Column) -> Column:
    """The shortest digits of a double with a fraction, plain from 0.0001 on, else with an exponent of two digits."""
    plain = lambda places: F.regexp_replace(n.cast(f"decimal(38,{places})").cast("string"), "0+$", "")
    return F.when(F.abs(n) >= 1e7, plain(18)).when(F.abs(n) >= 1e-3, n.cast("string")).when(F.abs(n) >= 1e-4, plain(24)).otherwise(F.regexp_replace(n.cast("string"), r"(?:\.0)?E-(\d)$", "e-0$1"))


def number_text(value: Column) -> Column:
    """A number's plain form: no commas, integers without a point; anything else, and what has 39 digits or more, stays as it is."""

    def form(s: Column) -> Column:
        return let(s.try_cast("double"), lambda n: F.when(n.isNull() | F.isnan(n) | (F.abs(n) >= 1e38), s).when(F.abs(n - F.rint(n)) < 1e-9, let(F.rint(n), _integer_text)).otherwise(_fraction_text(n)))

    return let(strip(F.regexp_replace(value, ",", "")), form)


def written_number(text: Column) -> Column:
    """The last number as it is written, commas left out; empty if there is none."""
    return F.coalesce(last_match(F.regexp_replace(text, ",", ""), NUMBER, 0), F.lit(""))


def last_number(text: Column) -> Column:
    """Plain form of the last number, commas left out; empty if there is none."""
    return let(written_number(text), number_text)


def _choice(s: Column) -> Column:
    final = F.nullif(F.regexp_extract(F.upper(strip(last_match(s, FINAL_LINE))), CHOICE_LINE, 1), F.lit(""))
    said = F.upper(last_match(s, CHOICE_SAID))
    lines = F.filter(F.split(s, r"\r\n|[\n\r\x0b\x0c]", -1), lambda x: strip(x).rlike(CHOICE_LINE))
    lone = F.upper(F.nullif(F.regexp_extract(strip(F.try_element_at(lines, F.lit(-1))), CHOICE_LINE, 1), F.lit("")))
    token = last_match(F.upper(s), r"(?<![\p{L}\p{N}_])([A-J])(?![\p{L}\p{N}_])")
    return F.coalesce(final, said, lone, token, F.upper(F.substring(s, 1, 1)))


def choice(text: Column) -> Column:
    """Letter A to J: final line, explicit mention, lone line, standalone letter, first character, in this order."""
    return let(strip(text), _choice)


def _balanced(tail: Column) -> Column:
    """A text up to the brace that closes the one before it, or whole."""
    kind = "struct<depth:int,n:int>"
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n")).cast(kind)

    def step(a: Column, ch: Column) -> Column:
        depth = a["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        return F.when(a["depth"] == 0, a).otherwise(F.struct(depth.alias("depth"), (a["n"] + 1).alias("n")).cast(kind))

    walked = F.aggregate(F.split(tail, ""), start, step)
    return let(walked, lambda w: F.when(w["depth"] == 0, F.substring(tail, F.lit(1), w["n"] - 1)).otherwise(tail))


def boxed(text: Column) -> Column:
    """Content of the last ``\\boxed{``, braces balanced; to the end if they are not; empty without one."""
    tail = F.element_at(F.split(text, r"\\boxed\{", -1), -1)
    return F.when(F.contains(text, F.lit("\\boxed{")), strip(let(tail, _balanced))).otherwise(F.lit(""))


def _tight(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", ""), r"^\$+|\$+$", "")


def _math(s: Column) -> Column:
    tail = strip(F.element_at(F.split(s, "####", -1), -1))
    marked = let(tail, lambda t: F.coalesce(F.nullif(last_number(t), F.lit("")), _tight(t)))
    number = F.nullif(last_number(s), F.lit(""))
    symbolic = lambda c: (c != "") & (F.length(c) <= 80) & (F.contains(c, F.lit("\\")) | c.rlike("[A-Za-z]"))
    other = let(_tight(s), lambda c: F.when(symbolic(c), c).otherwise(F.coalesce(number, c)))
    return F.when(F.contains(s, F.lit("####")), marked).otherwise(let(boxed(s), lambda b: F.when(b != "", _tight(b)).otherwise(other)))


def math_text(text: Column) -> Column:
    """Normal form of a mathematical answer: final line, ``####`` tail, boxed content, short symbols, last number."""
    return let(strip(text), lambda s: let(F.coalesce(F.when(last_match(s, FINAL_LINE).isNotNull(), strip(last_match(s, FINAL_LINE))), s), _math))


def math_candidate(text: Column) -> Column:
    """Final line, else boxed content, else the text."""

    def pick(s: Column) -> Column:
        final = last_match(s, FINAL_LINE)
        return F.when(final.isNotNull(), strip(final)).otherwise(F.coalesce(F.nullif(boxed(s), F.lit("")), s))

    return let(strip(text), pick)


def bool_text(text: Column) -> Column:
    """``true``, ``false`` or empty: the last explicit mention, else the last such word."""
    word = r"(?<![\p{L}\p{N}_])(true|false|yes|no)(?![\p{L}\p{N}_])"
    token = let(F.lower(strip(text)), lambda s: F.coalesce(last_match(s, BOOL_SAID), last_match(s, word)))
    return let(token, lambda t: F.when(t.isin("true", "yes"), F.lit("true")).when(t.isNotNull(), F.lit("false")).otherwise(F.lit("")))


def code_text(text: Column) -> Column:
    """The last fenced block (or all), without blank lines, spaces squeezed."""
    s = strip(text)
    block = last_match(s, CODE_BLOCK)
    body = F.when(block.isNotNull(), strip(block)).otherwise(s)
    lines = F.transform(F.split(body, r"\r\n|[\n\r\x0b\x0c]", -1), lambda x: F.regexp_replace(strip(x), r"(?U)\s+", " "))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def answer(text: Column, category: Column) -> Column:
    """Extracted answer by category."""

    def pick(s: Column) -> Column:
        logic = F.coalesce(F.nullif(bool_text(s), F.lit("")), _choice(s))
        return F.when(s == "", F.lit("")).when(category == "logic", logic).when(category == "math", math_text(s)).when(category == "code", code_text(s)).otherwise(s)

    return let(strip(text), pick)


def code_match(prediction: Column, reference: Column) -> Column:
    """1.0 if the reference's code is that of the prediction or inside it."""
    match = lambda p, r: F.when((p == "") | (r == ""), F.lit(0.0)).when((p == r) | F.contains(p, r), F.lit(1.0)).otherwise(F.lit(0.0))
    return let(code_text(prediction), lambda p: let(code_text(reference), lambda r: match(p, r)))


def correctness(label: Column, prediction: Column, reference: Column, category: Column) -> Column:
    """An explicit label first; else by category: booleans or letters, normal forms, strict equality; code needs a label."""

    def graded(p: Column, t: Column) -> Column:
        logic = let(bool_text(t), lambda b: F.when(b != "", b == bool_text(p)).otherwise(_choice(p) == _choice(t)))
        math = let(math_text(p), lambda m: (m != "") & (m == math_text(t)))
        verdict = F.when(category == "logic", logic).when(category == "math", math).when(category == "code", F.lit(None)).otherwise(p == t)
        return F.when((p != "") & (t != ""), verdict.cast("double"))

    return F.coalesce(label, let(strip(prediction), lambda p: let(strip(reference), lambda t: graded(p, t))))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)))


def structure_counts(text: Column) -> dict[str, Column]:
    """Fenced blocks, formula blocks, numbered steps."""
    n = lambda p: F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0)))
    return {
        "n_code_blocks": n(r"(?s)```.*?```"),
        "n_latex_blocks": n(r"(?s)\$\$.*?\$\$|\$[^$\n]+\$"),
        "n_numbered_steps": n(r"(?im)^\s*(?:step\s+\d+\s*[:.\-]|\d+[.)]\s+)") + n(ORDINALS),
    }


def without_reasoning(text: Column) -> Column:
    """Reasoning blocks in three tag styles give way to a space; then only what follows the last closing tag, if anything does."""
    s = F.coalesce(text, F.lit(""))
    for tags in REASONING:
        s = F.regexp_replace(s, tags, " ")
    tail = strip(F.element_at(F.split(s, r"(?i)</think>", -1), -1))
    return F.when(s.rlike(r"(?i)</think>") & (tail != ""), tail).otherwise(s)


def asserted_names(tests: Column) -> Column:
    """Names that assertions begin with, in order, once each."""
    return F.array_distinct(F.regexp_extract_all(tests, F.lit(ASSERTED), F.lit(1)))


def choice_prompt(question: Column, options: Column) -> Column:
    """A question, its options lettered from A, and the request for a letter."""
    letters = F.array(*[F.lit(chr(65 + k)) for k in range(26)])
    listed = F.transform(options, lambda x, i: F.concat(F.get(letters, i), F.lit(". "), x))
    return F.array_join(F.concat(F.array(question, F.lit("")), listed, F.array(F.lit(""), F.lit("Answer with one choice letter."))), "\n")


def rotation(key: Column, n: int) -> Column:
    """A stable offset below ``n`` from the first eight hexadecimal digits of a digest."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def rotated(options: Column, offset: Column) -> Column:
    """Options turned left by an offset."""
    return F.concat(F.slice(options, offset + 1, F.size(options)), F.slice(options, F.lit(1), offset))


def rotated_letter(offset: Column, n: int = 4) -> Column:
    """Where the first option stands after the turn."""
    return F.get(F.array(*[F.lit(x) for x in "ABCDEFGHIJ"[:n]]), F.pmod(-offset, F.lit(n)))


def boundary_kind(text: Column) -> Column:
    """``newline``, ``punct``, ``step_marker`` or empty, looked for in this order."""
    whole = F.coalesce(text, F.lit(""))
    s = F.regexp_replace(whole, r"(?U)\s+$", "")
    low = F.lower(s)
    end = F.right(low, F.lit(24))
    return (
        F.when(F.contains(whole, F.lit("\n")), F.lit("newline"))
        .when(F.right(s, F.lit(1)).isin(*SENTENCE_ENDS), F.lit("punct"))
        .when(reduce(Column.__or__, [F.contains(low, F.lit(a)) & F.contains(end, F.lit(b)) for a, b in STEP_MARKS]), F.lit("step_marker"))
        .otherwise(F.lit(""))
    )
