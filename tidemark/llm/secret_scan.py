r"""Secret scanning: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Patterns give the base spans. Further tokens are scored by two first-order character models, one trained on random
strings, one on ordinary words and identifiers; a token whose log-likelihood ratio exceeds a margin is a span of its own.
Training counts character pairs with DataFrame operations, on labelled samples: generated digests in several alphabets
(random), and the words of a bounded sample of documents (ordinary). A fifth of either sample is held out, and the margin
is what no held-out ordinary token exceeds. Scoring is a lookup in a constant table inside an expression. Everything here
is a DataFrame expression, and its cost grows with the length of a text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, the number of their characters that makes a match count, in the order of listing.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = "[A-Za-z0-9+/_=-]"
SAMPLE_DOCS = 2000
RANDOM_STRINGS = 4000
#: The margin where no ordinary token was held out.
MARGIN = 20.0
HELD_OUT = 5
_BLOCK = 64
_SPAN = "struct<start:int,kind:int,end:int>"
_NONE = f"cast(array() as array<{_SPAN}>)"


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios of character pairs, row by first and column by second character, and the margin."""

    table: list[float]
    margin: float = MARGIN

    def least_length(self) -> int:
        """Shorter tokens cannot exceed the margin, whatever their characters."""
        top = max(self.table)
        return max(2, int(self.margin // top) + 2) if top > 0 else 1 << 30


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each value, ``op`` over all values before it.

    Arrays cannot grow in place, so the values are taken in blocks: prefixes within each block, and of the blocks.
    """
    kind = "struct<at:bigint,out:array<bigint>>"
    nothing = F.expr("cast(array() as array<bigint>)")
    start = lambda at: F.struct(at.cast("bigint").alias("at"), nothing.alias("out")).cast(kind)
    step = lambda a, v: F.struct(op(a["at"], v).cast("bigint").alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")).cast(kind)
    running = lambda xs, at: F.aggregate(xs, start(at), step, lambda a: a["out"])

    def over(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / _BLOCK).cast("int")), lambda b: F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK)))
        return _let(parts, lambda ps: F.flatten(F.zip_with(ps, running(F.transform(ps, lambda p: F.aggregate(p, F.lit(zero).cast("bigint"), lambda a, x: op(a, x).cast("bigint"))), F.lit(zero)), running)))

    return _let(F.transform(values, lambda x: x.cast("bigint")), over)


def _matches(text: str, pattern: str, kind: int, value: Column | None = None, words: bool = False) -> Column:
    """Spans of all matches, in code points; ``value``: strings beside the matches that must have 8 characters or more.

    The pieces between matches and the matches tile the text, so their lengths give the places. ``words`` keeps the
    matches' texts as ``w``.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    told = lambda w: [w.alias("w")] if words else []
    tiles = F.zip_with(
        F.split(text, pattern, -1),
        F.arrays_zip(found.alias("m"), (value if value is not None else found).alias("v")),
        lambda g, x: F.struct(F.length(g).alias("g"), F.length(x["m"]).alias("m"), F.length(x["v"]).alias("v"), *told(x["m"])),
    )

    def placed(ts: Column) -> Column:
        at = _before(F.transform(ts, lambda t: t["g"] + F.coalesce(t["m"], F.lit(0))), lambda a, x: a + x, 0)
        spans = F.zip_with(ts, at, lambda t, a: F.struct((a + t["g"]).cast("int").alias("start"), F.lit(kind).alias("kind"), (a + t["g"] + t["m"]).cast("int").alias("end"), t["v"].alias("v"), *told(t["w"] if words else t["v"])))
        wanted = F.filter(spans, lambda x: x["end"].isNotNull() & (x["v"] >= (8 if value is not None else 1)))
        return F.transform(wanted, lambda x: F.struct(x["start"], x["kind"], x["end"], *told(x["w"] if words else x["v"])))

    if words:
        return _let(tiles, placed)
    return F.when(F.col(text).rlike(pattern), _let(tiles, placed)).otherwise(F.expr(_NONE))


def _loose(base: Column, tokens: Column) -> Column:
    """The token spans that touch no base span: a sweep over both, in the order of their places."""
    far = 1 << 40

    def sweep(s: Column) -> Column:
        covered = _before(F.transform(s, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0)), lambda a, x: F.greatest(a, x), 0)
        ahead = F.reverse(_before(F.reverse(F.transform(s, lambda x: F.when(x["kind"] < 3, x["start"]).otherwise(F.lit(far)))), lambda a, x: F.least(a, x), far))
        listed = F.zip_with(F.zip_with(s, covered, lambda x, c: F.struct(x.alias("x"), c.alias("c"))), ahead, lambda y, n: F.struct(y["x"].alias("x"), y["c"].alias("c"), n.alias("n")))
        return F.transform(F.filter(listed, lambda y: (y["x"]["kind"] == 3) & (y["c"] <= y["x"]["start"]) & (y["n"] >= y["x"]["end"])), lambda y: y["x"])

    return F.when(F.size(base) == 0, tokens).otherwise(_let(F.sort_array(F.concat(base, tokens)), sweep))


def _pairs(tokens: DataFrame) -> DataFrame:
    """``(label, pair, n)``: counts of neighbouring characters; a token is taken apart once, however often it stands there."""
    several = tokens.groupBy("label", "token").agg(F.count(F.lit(1)).alias("times"))
    last = F.greatest(F.length("token") - 1, F.lit(1))
    each = several.select("label", "times", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring("token", i, F.lit(2)))).alias("pair"))
    return each.where(F.length("pair") == 2).groupBy("label", "pair").agg(F.sum("times").alias("n"))


def training_tokens(docs: DataFrame, id_col: str, text_col: str, sample_docs: int, random_strings: int) -> DataFrame:
    """``(label, token, held)``: 1 random, 0 ordinary; ``held``: not trained on. All spellings of a word are on one side."""
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    alphabets = [F.base64(digest), F.hex(digest), F.lower(F.hex(digest)), F.regexp_replace(F.base64(digest), "[+/=]", ""), F.translate(F.base64(digest), "+/=", "-_")]
    random = docs.sparkSession.range(random_strings).select(F.lit(1).alias("label"), F.explode(F.array(*alphabets)).alias("token"), (F.col("id") % HELD_OUT == 0).alias("held"))
    ids = docs.select(F.col(id_col).alias("sample_id")).where("sample_id is not null").orderBy(F.xxhash64("sample_id"), "sample_id").limit(sample_docs)
    texts = docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("t")).join(F.broadcast(ids.distinct()), "sample_id")
    words = texts.select(F.explode(F.regexp_extract_all("t", F.lit(r"[A-Za-z0-9_-]+"), F.lit(0))).alias("token"))
    # one- and two-word identifiers in the usual spellings; what the base patterns would take is no ordinary word
    plain = words.where(F.length("token").between(4, 40) & ~F.col("token").rlike(f"{ACCESS}|{HEX}|[0-9].*[A-Za-z].*[0-9]"))
    held = (F.pmod(F.xxhash64(F.lower("token")), F.lit(HELD_OUT)) == 0).alias("held")
    spelt = plain.select(F.lit(0).alias("label"), F.explode(F.array(F.col("token"), F.lower("token"), F.upper("token"), F.concat(F.lower("token"), F.lit("_"), F.lower("token")), F.concat(F.lower("token"), F.initcap("token")))).alias("token"), held)
    return random.unionByName(spelt)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, random_strings: int = RANDOM_STRINGS) -> Model:
    """The model of a table of documents: add-one smoothed pair ratios, and the margin from the tokens held out.

    At most ``len(ALPHABET)`` squared counts for each of the two models reach the driver, and one number.
    """
    tokens = training_tokens(docs, id_col, text_col, sample_docs, random_strings)
    counts = {(r["label"], r["pair"]): r["n"] for r in _pairs(tokens.where("not held")).collect()}
    size, table = len(ALPHABET), []
    for a in ALPHABET:
        rows = [[counts.get((label, a + b), 0) + 1.0 for b in ALPHABET] for label in (1, 0)]
        totals = [sum(r) for r in rows]
        table += [log(rows[0][k] / totals[0]) - log(rows[1][k] / totals[1]) for k in range(size)]
    table = [round(x, 4) for x in table]
    ordinary = tokens.where("held and label = 0").select("token").distinct()
    top = ordinary.agg(F.max(score(F.col("token"), table)).alias("top")).first()["top"]
    return Model(table, MARGIN if top is None else max(ceil(top * 100) / 100, 1.0))


def score(token: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a token of :data:`ALPHABET`: above 0 it looks random, below 0 like an identifier."""
    size, at = len(ALPHABET), {ord(c): k for k, c in enumerate(ALPHABET)}
    by_code = ((at.get(i), at.get(j)) for i in range(128) for j in range(128))
    # one literal that is parsed once, not an expression for each number
    ratios = F.split(F.lit(",".join("0" if i is None or j is None else str(table[i * size + j]) for i, j in by_code)), ",").cast("array<double>")
    rated = lambda cs: F.zip_with(cs, F.slice(cs, F.lit(2), F.greatest(F.size(cs) - 1, F.lit(1))), lambda a, b: F.get(ratios, a * 128 + b))
    return F.aggregate(_let(F.transform(F.split(token, ""), F.ascii), rated), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, model: Model | None = None
) -> DataFrame:
    """Per row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    ``spans`` lists kind:start:end by start, then kind in the order assign, access, hex, markov; places are code points,
    the end exclusive. ``base_sha256`` is the digest of the list without markov spans. Markov spans that touch a base
    span are left to it. A null or empty text has no spans; rows with a null id and repeated rows give a result row each;
    an empty table gives an empty result. Other columns are not read. Nothing is shuffled but pair counts.
    """
    model = train(docs, id_col, text_col, sample_docs) if model is None else model
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # no shorter token can exceed the margin
    token = f"{TOKEN}{{{model.least_length()},}}"
    random = lambda w: score(w, model.table) > model.margin
    # places are told in texts that hold such a token only
    placed = F.filter(_matches("t", token, 3, words=True), lambda x: random(x["w"]))
    likely = F.when(F.exists(F.regexp_extract_all("t", F.lit(token), F.lit(0)), random), F.transform(placed, lambda x: F.struct(x["start"], x["kind"], x["end"]).cast(_SPAN))).otherwise(F.expr(_NONE))
    base = texts.select(
        "doc_id",
        _matches("t", ASSIGN, 0, F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2))).alias("assign"),
        _matches("t", ACCESS, 1).alias("access"),
        _matches("t", HEX, 2).alias("hex"),
        likely.alias("likely"),
    )
    scored = base.select("doc_id", "assign", "access", "hex", F.sort_array(F.concat("assign", "access", "hex")).alias("base"), "likely")
    found = scored.select("doc_id", "assign", "access", "hex", "base", _loose(F.col("base"), F.col("likely")).alias("more"))
    names = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(text(F.col("base")), 256).alias("base_sha256"),
        text(F.sort_array(F.concat("base", "more"))).alias("spans"),
    )
