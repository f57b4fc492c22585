"""Normal forms of mathematical answers as column expressions, and their comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.symbolic import equal_answers
from tidemark.functions.text import correctness, let, math_candidate, strip

# Fixed value: the dataset whose answers are graded as expressions.
SYMBOLIC_DATASET = "math_500"
# Literal texts that vanish or change before comparison, and units.
ANSWER_REPLACEMENTS = (
    ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""),
    ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""),
)
GRADER_REPLACEMENTS = (
    ("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "),
    ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12"),
)
LATEX_WORDS = (
    ("\\tfrac", "\\frac"), ("\\dfrac", "\\frac"), ("\\cdot", "*"), ("\\times", "*"), ("\\pi", "pi"), ("\\infty", "inf"), ("\\cup", "U"),
    ("√", "sqrt"), ("π", "pi"), ("∞", "inf"), ("∪", "U"), ("·", "*"), ("×", "*"),
)
UNITS = (
    "degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour",
    "day", "week", "month", "year", "foot", "feet", "inch", "yard",
)


def _each(text: Column, pairs) -> Column:
    return reduce(lambda s, p: F.replace(s, F.lit(p[0]), F.lit(p[1])), pairs, text)


def _unwrapped(text: Column) -> Column:
    """Content of a whole-answer text command (two backslashes in the source)."""
    return F.when(text.rlike(r"^\\\\text\{(.+?)\}$"), strip(F.regexp_extract(text, r"^\\\\text\{(.+?)\}$", 1))).otherwise(text)


def normal_answer(text: Column) -> Column:
    """Answer with fractions, roots, units, leading points and ``x =`` in one form."""
    s = _each(_unwrapped(strip(text)), ANSWER_REPLACEMENTS)
    s = F.when(F.contains(s, F.lit("\\text{ ")), F.substring_index(s, "\\text{ ", 1)).otherwise(s)
    s = _each(s, (("\\%", ""), (" .", " 0."), ("{.", "{0.")))
    s = F.when(F.startswith(s, F.lit(".")), F.concat(F.lit("0"), s)).otherwise(s)
    # one equals sign with a name of up to two characters before it
    s = F.regexp_replace(s, r"^[^=]{0,2}=([^=]*)$", "$1")
    s = F.regexp_replace(s, r"\\sqrt([^{])", r"\\sqrt{$1}")
    s = F.replace(s, F.lit(" "), F.lit(""))
    s = F.regexp_replace(s, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    s = F.regexp_replace(s, r"\\frac([^{])(\{)", r"\\frac{$1}$2")
    s = F.when(s == "0.5", F.lit("\\frac{1}{2}")).otherwise(s)
    return F.regexp_replace(s, r"^(-?(?:0|[1-9][0-9]*))/(-?(?:0|[1-9][0-9]*))$", r"\\frac{$1}{$2}")


def without_commas(text: Column) -> Column:
    """Without commas that part thousands properly."""
    return F.regexp_replace(text, r"(?<=\d),(?=\d\d\d(?:$|\D|,\d\d\d))", "")


def _whole(text: Column) -> Column:
    """Integer text of a number without a fraction, else null."""
    number = without_commas(text).try_cast("double")
    return F.when(F.abs(number - F.rint(number)) <= 1e-7, F.rint(number).cast("decimal(38,0)").cast("string"))


def plain_notation(text: Column) -> Column:
    """Fractions, roots and signs of the typesetting language as plain text; single numbers and letters keep no brackets."""
    s = _each(text, LATEX_WORDS)
    inner = r"\{([^{}]*)\}"
    for _ in range(4):  # from the inside outwards
        s = F.regexp_replace(s, rf"\\sqrt *{inner}", r"sqrt($1)")
        s = F.regexp_replace(s, r"\\frac *\{(\w+)\} *\{(\w+)\}", r"$1/$2")
        s = F.regexp_replace(s, rf"\\frac *{inner} *{inner}", r"($1)/($2)")
    return s


def grader_form(text: Column) -> Column:
    """Answer without currency, percent, units and spaces; magnitudes as powers; mixed numbers as sums; plain notation."""

    def bare(s: Column) -> Column:
        for unit in UNITS:
            s = F.regexp_replace(s, rf"{unit}(?:es)?s? *(?:\^[0-9]+)?", "")
        s = F.regexp_replace(s, r"\^ *\\circ", "")
        s = F.regexp_replace(s, r"^\{(.*)\}$", "$1")
        return F.regexp_replace(s, r",\\! *", "")

    def tight(s: Column) -> Column:
        s = F.regexp_replace(s, r"- *", "-")
        s = F.regexp_replace(s, r"([0-9]) +([0-9])", "$1+$2")
        return F.lower(F.translate(s, " {}", ""))

    number = lambda s: F.coalesce(F.when(s.try_cast("double").isNotNull(), _whole(s)), s)
    plain = lambda s: F.when(F.contains(s, F.lit("\\")) | s.rlike("[√π∞∪·×]"), plain_notation(s)).otherwise(s)
    whole = lambda s: F.coalesce(_whole(s), s)
    return let(bare(_each(_unwrapped(text), GRADER_REPLACEMENTS)), lambda s: let(number(s), lambda n: let(tight(let(n, plain)), whole)))


def _apart(value: Column) -> Column:
    """A value that is computed before the Python stage that reads it.

    The optimizer would put its expression into the arguments of that stage, which cannot take nested lambdas; it leaves
    alone what is not deterministic, so a condition that always holds is made of such a part.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def compare_answers(rows: DataFrame, given: Column, truth: Column, name: str = "equal", forms: bool = True) -> DataFrame:
    """Add ``name boolean``: whether an answer counts as the truth; null where either is null.

    Answers are equal in normal form (unless ``forms`` is false), or else in grader form: the same brackets and as many
    elements, each equal to its like; fractions and whole numbers as they are written, the rest as expressions. Only what
    normal forms leave open reaches the Python stage. All columns stay.
    """
    packed = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("row"), _apart(given).alias("g"), _apart(truth).alias("t"))
    same = F.coalesce(F.col("g") == F.col("t") if not forms else let(F.col("g"), normal_answer) == let(F.col("t"), normal_answer), F.lit(False))
    formed = packed.select("row", "g", "t", _apart(same).alias("same"))
    open_ = lambda c: _apart(F.when(~F.col("same"), let(F.col(c), grader_form)))
    ready = formed.select("row", (F.col("g").isNotNull() & F.col("t").isNotNull()).alias("both"), "same", open_("g").alias("g"), open_("t").alias("t"))
    verdict = F.when(F.col("both"), F.col("same") | F.coalesce(equal_answers(F.col("g"), F.col("t")), F.lit(False)))
    return ready.select(*[F.col("row")[c].alias(c) for c in rows.columns if c != name], verdict.alias(name))


def grade_rows(rows: DataFrame, label: Column, prediction: Column, reference: Column, category: Column, dataset: Column, name: str = "correctness") -> DataFrame:
    """Add ``name double``: :func:`text.correctness`, but mathematical answers of :data:`SYMBOLIC_DATASET` as expressions."""
    asked = label.isNull() & (category == "math") & (strip(dataset) == SYMBOLIC_DATASET)
    plain = rows.withColumn(name, correctness(label, prediction, reference, category))
    given, truth = (F.when(asked, F.nullif(let(strip(x), math_candidate), F.lit(""))) for x in (prediction, reference))
    verdict = f"{name}_as_expression"
    out = compare_answers(plain, given, truth, verdict)
    return out.withColumn(name, F.coalesce(F.col(verdict).cast("double"), F.col(name))).drop(verdict)
