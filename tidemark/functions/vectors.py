"""Array functions as column expressions: distributions, norms, encodings, policy scores."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from tidemark.functions.text import let

_TOKEN = re.compile(r"\w+|[^\w\s]")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_RUN = 1 << 20


def rounded(value: Column | str, digits: int) -> Column:
    """A double to ``digits`` places: scaled, half away from zero, and scaled back, as SQL engines do.

    ``F.round`` rounds the shortest decimal of the double instead, and so takes 0.23834999999999998 down at four places.
    """
    scale = 10.0**digits
    return F.round((F.col(value) if isinstance(value, str) else value) * F.lit(scale)) / F.lit(scale)


def vsum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return vsum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / by)


def softmax(a: Column, temperature: float = 1.0) -> Column:
    """Shifted by the maximum; the sum is 1e-8 at least."""
    by = F.lit(max(1e-6, temperature))
    total = lambda e: let(F.greatest(vsum(e), F.lit(1e-8)), lambda t: scaled(e, t))
    shifted = lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp((x - top) / by)))
    return let(a, lambda v: let(shifted(v), total))


def l2_normal(a: Column) -> Column:
    """Divided by its length, or by 1e-8 if that is smaller."""
    return let(a, lambda v: let(F.greatest(F.sqrt(dot(v, v)), F.lit(1e-8)), lambda n: scaled(v, n)))


def group_means(a: Column, groups: int, size: int) -> Column:
    """Means of consecutive groups: joint action scores to info scores."""
    return F.array(*[vsum(F.slice(a, g * size + 1, size)) / size for g in range(groups)])


def argmax(a: Column) -> Column:
    """Index of the largest value, the first one where equal."""
    return let(a, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def dense_scores(scores: Column, size: int, penalty: float = 2.0) -> Column:
    """A map from action index to score as an array; absent actions get the smallest score less a penalty."""
    low = F.array_min(F.map_values(scores))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(scores, i), low - penalty))


def _digits(tokens: list[str]) -> np.ndarray:
    """The first eight digits of each token's MD5, as a number: a hash that has an SQL form."""
    return np.array([int(hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) for t in tokens], dtype=np.int64)


def _token_counts(texts: list[str], dim: int) -> np.ndarray:
    """Occurrences of words, punctuation and character 3- to 5-grams by text and bucket; each different token is digested once."""
    out = np.zeros(len(texts) * dim, dtype=np.int64)

    def add(owner: np.ndarray, code: np.ndarray, digits: np.ndarray) -> None:
        out[:] += np.bincount(owner * dim + (digits % dim)[code], minlength=len(out))

    words = [_TOKEN.findall(t) for t in texts]
    code, different = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
    add(np.repeat(np.arange(len(texts)), [len(ws) for ws in words]), code, _digits([f"w:{w}" for w in different]))
    compact = [" ".join(t.split()) for t in texts]
    joined = "".join(compact)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in compact])
    for n in (3, 4, 5):
        count = max(0, len(points) - n + 1)
        gram = np.zeros(count, dtype=np.uint64)
        for k in range(n):
            gram = gram * _ODD + points[k : k + count]
        own = np.flatnonzero(owner[:count] == owner[n - 1 : n - 1 + count])  # within one text
        code, different = pd.factorize(gram[own])
        first = np.zeros(len(different), dtype=np.int64)
        first[code[::-1]] = own[::-1]
        add(owner[own], code, _digits([f"c{n}:{joined[i : i + n]}" for i in first.tolist()]))
    return out.reshape(len(texts), dim)


def _batch_counts(texts: pd.Series, dim: int) -> list[np.ndarray]:
    """Counts of a batch, worked off in runs of about :data:`_RUN` characters."""
    out: list[np.ndarray] = []
    run, size = [], 0
    for text in texts:
        run.append((text or "").lower())
        size += len(run[-1])
        if size >= _RUN:
            out += [*_token_counts(run, dim)]
            run, size = [], 0
    return out + ([*_token_counts(run, dim)] if run else [])


def hashed_counts(text: Column, dim: int = 64) -> Column:
    """``array<bigint>``: how many of a text's words, punctuation marks and character 3- to 5-grams fall into each bucket.

    An Arrow UDF: as column expressions, every gram of every text would be digested, at twenty times the cost.
    """
    return pandas_udf(lambda texts: pd.Series(_batch_counts(texts, dim), dtype=object), ArrayType(LongType()))(text)


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """L2-normalised bucket counts of a text; zeros for an empty one."""
    return l2_normal(hashed_counts(text, dim))


def repeat_ratio(tokens: Column, n: int = 3, window: int = 128) -> Column:
    """Share of n-grams among the last ``window`` tokens that came before."""

    def ratio(last: Column) -> Column:
        count = F.size(last) - n + 1
        grams = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.array(*[F.get(last, i + k) for k in range(n)]))
        return F.when(count <= 0, F.lit(0.0)).otherwise((count - F.size(F.array_distinct(grams))) / count)

    # bound once each, or the tokens would be made anew for every n-gram
    return let(tokens, lambda t: let(F.slice(t, F.greatest(F.size(t) - window + 1, F.lit(1)), F.lit(window)), ratio))


def token_distribution(logprobs: Column, eos: int = 0) -> Column:
    """Entropy, margin, two best probabilities, mass of five, and the end token's probability and rank.

    ``logprobs``: array of structs ``(id, lp)``, best first.
    """
    p = F.transform(logprobs, lambda x: F.exp(x["lp"]))
    at = lambda i: F.coalesce(F.get(p, F.lit(i)), F.lit(0.0))
    entropy = F.aggregate(p, F.lit(0.0), lambda acc, x: acc - F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0)))
    place = F.array_position(F.transform(logprobs, lambda x: x["id"]), F.lit(eos))
    return F.struct(
        entropy.alias("entropy"), (at(0) - at(1)).alias("margin"), at(0).alias("top1_prob"), at(1).alias("top2_prob"),
        vsum(F.slice(p, 1, 5)).alias("topk_mass"), F.coalesce(F.get(p, (place - 1).cast("int")), F.lit(0.0)).alias("eos_prob"), place.cast("int").alias("eos_rank"),
    )


def policy_scores(
    prior: Column, boundary: Column, current: Column, remaining: Column, budgets: Sequence[int],
    prior_weight: float = 0.15, boundary_weight: float = 1.0, switch_cost: float = 0.1, hysteresis: float = 0.05, guardrail: float = 0.35,
) -> Column:
    """Joint action scores at a thinking boundary: weighted logits, a bonus for staying, costs for switching and for budgets beyond what is left."""
    budget = F.array(*map(F.lit, budgets))
    n = len(budgets)
    mixed = F.zip_with(prior, boundary, lambda a, b: prior_weight * a + boundary_weight * b)
    return F.transform(
        mixed,
        lambda x, i: x + F.when(i == current, F.lit(hysteresis)).otherwise(F.lit(-switch_cost)) - F.when(F.get(budget, i % n) > remaining, F.lit(guardrail)).otherwise(F.lit(0.0)),
    )


def answer_scores(prior: Column, answer: Column, info: Column, cot: Column, prior_weight: float = 0.15, boundary_weight: float = 1.0, switch_cost: float = 0.1, hysteresis: float = 0.05, infos: int = 4, cots: int = 5, invalid: float = 1e9) -> Column:
    """Joint action scores in the answer zone: only info modes compete, at the current budget level."""
    mixed = F.zip_with(group_means(prior, infos, cots), answer, lambda a, b: prior_weight * a + boundary_weight * b)
    scores = F.transform(mixed, lambda x, i: x + F.when(i == info - 1, F.lit(hysteresis)).otherwise(F.lit(-switch_cost)))
    return F.transform(F.sequence(F.lit(0), F.lit(infos * cots - 1)), lambda i: F.when(i % cots == cot, F.get(scores, F.floor(i / cots).cast("int"))).otherwise(F.lit(-invalid)))


def pairwise_loss(margin: Column) -> Column:
    """``log(1 + exp(-margin))``."""
    return F.log1p(F.exp(-margin))


def soft_cross_entropy(target: Column, logits: Column) -> Column:
    total = lambda v: let(F.array_max(v), lambda top: F.log(vsum(F.transform(v, lambda x: F.exp(x - top)))) + top)
    return let(logits, lambda v: let(total(v), lambda t: vsum(F.zip_with(target, v, lambda p, x: -p * (x - t)))))


def sampling_filter(rows: DataFrame, logits: str, temperature: float = 1.0, top_k: int = 0, top_p: float = 1.0, min_p: float = 0.0) -> DataFrame:
    """``rows`` with ``kept array<struct<p, i>>``: the tokens left by temperature, top-k, min-p and top-p, best first, summing to 1.

    A temperature of 0 leaves the best token. A token stays in the nucleus while those before it sum to less than ``top_p``.
    Each step is bound once, so that none is evaluated anew for every token.
    """
    first = 1 if not temperature else top_k
    empty = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    weights = lambda e: F.transform(e, lambda x: x["p"])

    def nucleus(ranked: Column, total: Column) -> Column:
        """The first tokens of ``ranked``, up to the share of ``top_p``."""
        size = F.aggregate(ranked, empty, lambda a, x: F.struct((a["sum"] + x["p"] / total).alias("sum"), (a["n"] + F.when(a["sum"] < top_p, 1).otherwise(0)).alias("n")), lambda a: a["n"])
        return F.slice(ranked, F.lit(1), size)

    def likely(ranked: Column) -> Column:
        """The ``top_k`` first, less those below ``min_p`` of the best one."""
        best = lambda b: F.filter(F.slice(ranked, 1, first) if first else ranked, lambda x: x["p"] >= min_p * b)
        return let(F.get(ranked, F.lit(0))["p"], best)

    def shares(kept: Column) -> Column:
        return let(vsum(weights(kept)), lambda t: F.transform(kept, lambda x: F.struct((x["p"] / t).alias("p"), (-x["n"]).alias("i"))))

    def cut(e: Column) -> Column:
        chosen = lambda total: let(let(F.reverse(F.array_sort(e)), likely), lambda ranked: nucleus(ranked, total))
        return let(let(vsum(weights(e)), chosen), shares)

    lifted = lambda z: let(F.array_max(z), lambda top: F.transform(z, lambda x, i: F.struct(F.exp(x - top).alias("p"), (-i).alias("n"))))
    scaled_logits = F.transform(logits, lambda x: x.cast("double") / (temperature or 1.0))
    return rows.withColumn("kept", let(let(scaled_logits, lifted), cut))
