"""Queries over sources, sinks, item loaders and execution."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.functions.execution import execute, humaneval_programs, mbpp_program
from tidemark.functions.vectors import rounded
from tidemark.plans.registry import query
from tidemark.sources import files
from tidemark.sources.fixtures import TRACES, table, traces
from tidemark.sources.items import SOURCES, eval_items, render_template


#: Weights of a small network that SQL can state too: 8 to 6 to 4 to 5, biases a tenth of the place.
_SIZES = (8, 6, 4, 5)
_LAYERS = [(np.array([[((i * 3 + j * 5 + k) % 7 - 3) / 4 for j in range(b)] for i in range(a)]), np.arange(b) / 10) for k, (a, b) in enumerate(zip(_SIZES, _SIZES[1:], strict=False))]
_W = ", ".join(f"({k}, {i}, {j}, {w[i][j]}::double)" for k, (w, _) in enumerate(_LAYERS) for i in range(len(w)) for j in range(len(w[0])))


def _nation(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("name"))


_NATION = "select cast(n_nationkey as bigint) as k, n_name as name from nation"


@query("SRC1", _NATION)
def src1(spark, sf_dir):
    path = files.scratch(spark, "src1")
    files.write_jsonl(_nation(spark, sf_dir), path)
    return files.read_jsonl_strict(spark, path, "k bigint, name string")


@query("SRC2", f"select k, name from ({_NATION}) where k % 5 <> 0")
def src2(spark, sf_dir):
    path = files.scratch(spark, "src2")
    line = F.when(F.col("k") % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("k", "name")))
    _nation(spark, sf_dir).select(line.alias("value")).write.text(path)
    return files.read_jsonl_lax(spark, path, "k bigint, name string")[0]


@query("SRC3", _NATION)
def src3(spark, sf_dir):
    path = files.scratch(spark, "src3")
    rows = _nation(spark, sf_dir).agg(F.to_json(F.array_sort(F.collect_list(F.struct("k", "name")))).alias("value"))  # 25 rows
    rows.write.text(path)
    return files.read_json(spark, path, "k bigint, name string")


@query("SRC9", f"select k, name, case when k % 2 = 0 then 'v5' else 'v4' end as phase from ({_NATION})")
def src9(spark, sf_dir):
    base = files.scratch(spark, "src9")
    for n, phase in enumerate(("v5", "v4")):
        files.write_jsonl(_nation(spark, sf_dir).where(F.col("k") % 2 == n), f"{base}/run_{phase}_wide")
    return files.read_tagged(spark, f"{base}/run_*_wide", "k bigint, name string", {"phase": r"run_([^_/]+)_wide"})


@query("AGG15", f"select case when k % 2 = 0 then 'part_a' else 'part_b' end as folder, count(*) as n from ({_NATION}) group by 1")
def agg15(spark, sf_dir):
    base = files.scratch(spark, "agg15")
    for n, name in enumerate(("part_a", "part_b")):
        files.write_jsonl(_nation(spark, sf_dir).where(F.col("k") % 2 == n), f"{base}/{name}")
    return files.file_counts(spark.read.schema("k bigint, name string").json(f"{base}/*"))


@query("SNK1", "select cast(n_nationkey as bigint) as k, case when n_nationkey % 3 = 0 then null else n_name end as name from nation")
def snk1(spark, sf_dir):
    path = files.scratch(spark, "snk1")
    files.write_jsonl(_nation(spark, sf_dir).withColumn("name", F.when(F.col("k") % 3 != 0, F.col("name"))), path)
    return spark.read.schema("k bigint, name string").json(path)


@query("SNK3", f"select 'names' as report, k, name from ({_NATION}) union all select 'keys', k, null from ({_NATION}) where k % 2 = 0")
def snk3(spark, sf_dir):
    path, rows = files.scratch(spark, "snk3"), _nation(spark, sf_dir)
    files.write_report({"names": rows, "keys": rows.where("k % 2 = 0").select("k")}, path)
    read = lambda name, schema: spark.read.csv(f"{path}/{name}", header=True, schema=schema)
    keys = read("keys", "k bigint").select(F.lit("keys").alias("report"), "k", F.lit(None).cast("string").alias("name"))
    return read("names", "k bigint, name string").select(F.lit("names").alias("report"), "k", "name").unionByName(keys)


_SUMMARY = "select count(*) as n, round(avg(n_nationkey), 6) as mean_key, cast(null as varchar) as note from nation"


@query("SNK2", _SUMMARY)
def snk2(spark, sf_dir):
    path = files.scratch(spark, "snk2")
    summary = _nation(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("k"), 6).alias("mean_key"), F.lit(None).cast("string").alias("note"))
    files.write_summary(summary, path)
    return files.read_object(spark, path, summary.schema)


@query("SRC4", _SUMMARY.replace("cast(null as varchar)", "min(n_name)"))
def src4(spark, sf_dir):
    path = files.scratch(spark, "src4")
    summary = _nation(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("k"), 6).alias("mean_key"), F.min("name").alias("note"))
    files.write_summary(summary, path)
    return files.read_object(spark, path, summary.schema)


@query("SNK4", "select doc_id, text as prediction, case when lang = 'en' then 1.0::double else 0.0::double end as is_correct from documents")
def snk4(spark, sf_dir):
    path, schema = files.scratch(spark, "snk4"), "doc_id bigint, prediction string, lang string, is_correct double"
    files.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prediction"), "lang", F.lit(None).cast("double").alias("is_correct")), path)
    graded = F.when(F.col("lang") == "en", F.lit(1.0)).otherwise(F.lit(0.0))
    at = files.relabel(spark, path, lambda rows: rows.withColumn("is_correct", graded), schema)
    return spark.read.schema(schema).json(at).select("doc_id", "prediction", "is_correct")


@query("SNK6", f"with {TRACES} select dataset, count(*) as n, cast(sum(token_count) as bigint) as tokens from traces where info_mode = 3 group by dataset")
def snk6(spark, sf_dir):
    path = files.scratch(spark, "snk6")
    files.write_shards(traces(spark, sf_dir), path, ["info_mode", "dataset"])
    return files.read_shards(spark, path, info_mode=3).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").cast("bigint").alias("tokens"))


@query("SNK7", f"with {TRACES} select 'policy_' || info_mode as baseline, input_order, token_count from traces")
def snk7(spark, sf_dir):
    path = files.scratch(spark, "snk7")
    rows = traces(spark, sf_dir).select(F.concat(F.lit("policy_"), F.col("info_mode").cast("string")).alias("baseline"), "input_order", "token_count")
    files.write_by_name(rows, path, "baseline")
    return spark.read.schema("input_order bigint, token_count bigint, baseline string").json(path).select("baseline", "input_order", "token_count")


@query("SRC5", "select cast(n_nationkey as bigint) as k, 3 + 2 * n_nationkey as v from nation where n_nationkey < 10")
def src5(spark, sf_dir):
    from tidemark.sources.config import load_config

    folder = tempfile.mkdtemp()  # a configuration is a driver's file
    with open(f"{folder}/c.yaml", "w", encoding="utf-8") as f:
        f.write("base: 3\nslope: 2\nlimits:\n  below: 10\n")
    c = load_config(f"{folder}/c.yaml")
    return _nation(spark, sf_dir).where(F.col("k") < c["limits"]["below"]).select("k", (c["base"] + c["slope"] * F.col("k")).alias("v"))


@query("FLT5", "select cast(n_nationkey as bigint) as k, 'file' as source, 7 as lam from nation where n_nationkey < 5")
def flt5(spark, sf_dir):
    from tidemark.sources.config import merged

    c = merged({"lam": 1, "below": 3, "source": "default"}, {"lam": 2, "source": "file", "below": 5}, {"lam": 7, "source": None, "below": ""}, ["source"])
    return _nation(spark, sf_dir).where(F.col("k") < c["below"]).select("k", F.lit(c["source"]).alias("source"), F.lit(c["lam"]).alias("lam"))


@query("FLT4", "select * from (values (0, 'segmented_global_best_no_switch'), (1, 'dynamic_global_best_start'), (2, 'dynamic_category_best_start')) t(place, baseline)")
def flt4(spark, sf_dir):
    from tidemark.sources.config import POLICIES, POLICY_ALIASES, ordered_names

    names = ["torch_dynamic_category_best_start", "dynamic_global_best_start", "none_such", "torch_global_best_no_switch", "segmented_global_best_no_switch"]
    return spark.createDataFrame(list(enumerate(ordered_names(names, POLICY_ALIASES, POLICIES))), "place int, baseline string")


_SPLITS = "case when item_id % 3 = 0 then 'test' else 'train' end"


@query("SRC6", f"""with b as (select item_id, text, {_SPLITS} as split from benchmark) select 'mbpp' as name, item_id, text from b where split = 'train' union all select 'gsm8k', item_id, text from b where split = 'test'
  union all select 'arc_challenge', item_id, text from b union all select 'gpqa_diamond', item_id, text from b where split = 'train'""")
def src6(spark, sf_dir):
    from tidemark.sources.benchmarks import load_benchmark

    root, out = files.scratch(spark, "src6"), None
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text", F.when(F.col("item_id") % 3 == 0, F.lit("test")).otherwise(F.lit("train")).alias("split"))
    for name in ("mbpp", "gsm8k", "arc_challenge", "gpqa_diamond"):
        for split in ("test", "train"):
            rows.where(F.col("split") == split).drop("split").write.parquet(f"{root}/{name}/{split}")
        read = load_benchmark(spark, root, name, least=1 << 30).select(F.lit(name).alias("name"), "item_id", "text")
        out = read if out is None else out.unionByName(read)
    return out


@query("SRC12", f"""with w as (select * from (values {_W}) t(layer, i, j, w)), x as (select vec_id, unnest(range(8)) as i, cast(unnest(embedding[1:8]) as double) as v from embeddings),
  h as (select vec_id, j as i, greatest(0, sum(v * w) + j / 10.0) as v from x join w on w.layer = 0 and w.i = x.i group by vec_id, j), g as (select vec_id, j as i, greatest(0, sum(v * w) + j / 10.0) as v from h join w on w.layer = 1 and w.i = h.i group by vec_id, j)
  select vec_id, cast(j as integer) as action, round(sum(v * w) + j / 10.0, 6) as logit from g join w on w.layer = 2 and w.i = g.i group by vec_id, j""")
def src12(spark, sf_dir):
    from tidemark.operators.slots import mlp_scores
    from tidemark.sources.artifacts import Artifact, read_artifact, write_artifact

    path = files.scratch(spark, "src12")
    write_artifact(spark, Artifact([0, 64], np.eye(2), np.full((2, 5), 0.2), networks={"prior": _LAYERS}), path)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("x"))
    out = mlp_scores(rows, "x", read_artifact(spark, path).networks["prior"], ["vec_id"])
    return out.select("vec_id", F.posexplode("logits").alias("action", "logit")).select("vec_id", "action", rounded("logit", 6).alias("logit"))


@query("WIN4", "select conv_id, cast(i - 1 as integer) as position, w as word from (select conv_id, string_split(string_agg(text, ' ' order by turn), ' ') as ws from conversations group by conv_id), unnest(ws) with ordinality as t(w, i)")
def win4(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    words = turns.select("conv_id", F.split(F.array_join(F.transform("t", lambda x: x["text"]), " "), " ", -1).alias("w"))
    return words.select("conv_id", F.posexplode("w").alias("position", "word"))


@query("WIN5", "select event_id, row_number() over (order by event_id) as input_index from events")
def win5(spark, sf_dir):
    from tidemark.operators.ordering import dense_index

    return dense_index(table(spark, sf_dir, "events").select("event_id"), ["event_id"], name="input_index", start=1)


@query("SRT1", f"with {TRACES} select dataset, problem_id, row_number() over (order by dataset, problem_id) - 1 as place from (select distinct dataset, problem_id from traces)")
def srt1(spark, sf_dir):
    from tidemark.operators.ordering import dense_index

    return dense_index(traces(spark, sf_dir).select("dataset", "problem_id").distinct(), ["dataset", "problem_id"])


@query("SNK5", f"with {TRACES} select input_order, token_count from traces where dataset = 'click' and info_mode = 2")
def snk5(spark, sf_dir):
    path = files.scratch(spark, "snk5")
    files.write_shards(traces(spark, sf_dir), path, ["dataset", "info_mode"])
    return spark.read.parquet(path).where("dataset = 'click' and info_mode = 2").select("input_order", "token_count")


#: Bytes of a shard.
SHARD_BYTES = 16 << 20
_STREAM = "case when doc_id % 10 = 0 then 'val' else 'train' end"
_ZONE = "case when lang = 'en' then 'think' else 'answer' end"


@query("SNK5_sized", f"select doc_id, {_STREAM} as split, {_ZONE} as zone, md5(text) as text_md5, cast(8 + 4 + strlen(text) + 4 + length({_STREAM}) + 4 + length({_ZONE}) as bigint) as bytes, true as fits from documents")
def snk5_sized(spark, sf_dir):
    """All documents through four streams of size-bounded shards, and whether each one's shard keeps to the bound."""
    from tidemark.sources import shards

    path, streams = files.scratch(spark, "snk5-sized"), ["split", "zone"]
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.expr(_STREAM).alias("split"), F.expr(_ZONE).alias("zone"))
    shards.write_sized_shards(rows, path, streams, ["doc_id"], SHARD_BYTES)
    fits = (F.col("bytes") <= SHARD_BYTES) | (F.col("examples") == 1)
    told = shards.read_manifest(spark, path).select(*streams, "shard", fits.alias("fits"))
    back = shards.read_sized_shards(spark, path).join(told, [*streams, "shard"])
    return back.select("doc_id", *streams, F.md5("text").alias("text_md5"), "bytes", "fits")


_ITEM_SQL = {
    "gsm8k": ("'q ' || text", "'a' || item_id"), "svamp": ("text || ' ' || 'q ' || text", "'A' || item_id"), "math_500": ("'p ' || text", "case when item_id % 2 = 0 then 's' || item_id else 'a' || item_id end"),
    "arc_challenge": ("'q ' || text || chr(10) || chr(10) || 'A. one' || chr(10) || 'B. ' || item_id || chr(10) || chr(10) || 'Answer with one choice letter.'", "case when item_id % 2 = 0 then 'B' else 'A' end"),
    "mmlu_pro": ("'q ' || text || chr(10) || chr(10) || 'A. x' || chr(10) || 'B. ' || text || chr(10) || chr(10) || 'Answer with one choice letter.'", "'a' || item_id"),
    "gpqa_diamond": ("'q ' || text || chr(10) || chr(10) || 'A. ' || o[1 + t] || chr(10) || 'B. ' || o[1 + (1 + t) % 4] || chr(10) || 'C. ' || o[1 + (2 + t) % 4] || chr(10) || 'D. ' || o[1 + (3 + t) % 4] || chr(10) || chr(10) || 'Answer with one choice letter.'", "chr(cast(65 + (4 - t) % 4 as integer))"),
    "mbpp": ("text", "'c' || item_id"), "aime2024": ("'p ' || text", "'s' || item_id"), "aime2025": ("'p ' || text", "'a' || item_id"), "humaneval": ("'def ' || text", "'k' || item_id"),
}
_TURN = "cast(('0x' || substr(md5('gpqa_r' || item_id), 1, 8)) as bigint) % 4"


@query("PRJ13", f"with b as (select item_id, text, ['w' || item_id, 'w1', 'w2', text] as o, {_TURN} as t from benchmark) " + " union all ".join(f"select '{n}' as dataset, cast(item_id as varchar) as problem_id, {p} as prompt, {a} as reference, '{SOURCES[n][0]}' as category from b" for n, (p, a) in _ITEM_SQL.items()))
def prj13(spark, sf_dir):
    t, k, i = F.col("text"), F.col("item_id").cast("string"), F.col("item_id")
    made = lambda letter: F.concat(F.lit(letter), k)
    b = table(spark, sf_dir, "benchmark").select(
        "item_id", "text", F.concat(F.lit("q "), t).alias("question"), F.when(i % 2 != 0, made("a")).otherwise(F.lit("")).alias("math_answer"), made("a").alias("answer"), t.alias("Body"), F.concat(F.lit("p "), t).alias("problem"),
        made("s").alias("solution"), F.concat(F.lit("def "), t).alias("prompt"), made("k").alias("canonical_solution"), made("c").alias("code"), F.array(F.lit("x"), t).alias("options"),
        F.struct(F.array(F.lit("A"), F.lit("B")).alias("label"), F.array(F.lit("one"), k).alias("text")).alias("choices"), F.when(i % 2 == 0, F.lit("B")).otherwise(F.lit("A")).alias("answerKey"),
        made("r").alias("Record ID"), made("w").alias("Correct Answer"), F.lit("w1").alias("Incorrect Answer 1"), F.lit("w2").alias("Incorrect Answer 2"), t.alias("Incorrect Answer 3"),
    )
    out = None
    for source in SOURCES:
        rows = b.withColumn("answer", F.col("math_answer")) if source == "math_500" else b.withColumn("answer", made("A")) if source == "svamp" else b
        items = eval_items(rows, source, i).select("dataset", "problem_id", "prompt", "reference", "category")
        out = items if out is None else out.unionByName(items)
    return out


@query("STR28", "select item_id, 'Q: ' || text || ' / ' || item_id || '!' as rendered from benchmark")
def str28(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", render_template("Q: {q} / {id}!", {"q": F.col("text"), "id": F.col("item_id").cast("string")}).alias("rendered"))


@query("VEC11", """with l as (select vec_id, cast(unnest(range(len(embedding))) as integer) as i, cast(unnest(embedding) as double) / 0.7 as z from embeddings), e as (select *, exp(z - max(z) over (partition by vec_id)) as p, row_number() over (partition by vec_id order by z desc, i) as place from l),
  k as (select *, p / sum(p) over (partition by vec_id) as share, max(p) over (partition by vec_id) as best from e), t as (select * from k where place <= 20 and p >= 0.05 * best), n as (select *, coalesce(sum(share) over (partition by vec_id order by place rows between unbounded preceding and 1 preceding), 0) as before from t),
  f as (select * from n where before < 0.6) select vec_id, i, round(share / sum(share) over (partition by vec_id), 6) as p from f""")
def vec11(spark, sf_dir):
    kept = V.sampling_filter(table(spark, sf_dir, "embeddings"), "embedding", 0.7, top_k=20, top_p=0.6, min_p=0.05)
    return kept.select("vec_id", F.inline("kept")).select("vec_id", "i", rounded("p", 6).alias("p"))


@query("UDF1", "select cast(n_nationkey as bigint) as k, n_nationkey % 2 = 0 as passed from nation")
def udf1(spark, sf_dir):
    """Fixed programs, so that running them is safe."""
    good, bad = mbpp_program("def f(x):\n    return x", "", ["assert f(1) == 1"]), mbpp_program("def f(x):\n    return 0", "", ["assert f(1) == 1"])
    rows = _nation(spark, sf_dir).select("k", F.when(F.col("k") % 2 == 0, F.lit(good)).otherwise(F.lit(bad)).alias("program"))
    return execute(rows, "program", ["k"], allow=True).select("k", "passed")


@query("UDF2", "select cast(n_nationkey as bigint) as k, case n_nationkey % 5 when 0 then true when 1 then true when 2 then false when 3 then true else false end as passed, n_nationkey % 5 = 4 as empty from nation")
def udf2(spark, sf_dir):
    """Fixed programs, so that running them is safe: a completion with its head, one without, a wrong one, one under another name, an empty one."""
    prompt, test = "def f(x):\n", "def check(c):\n    assert c(1) == 2"
    bodies = ("def f(x):\n    return x + 1", "    return x + 1", "def f(x):\n    return x", "def g(x):\n    return x + 1", " ")
    cases = [humaneval_programs(prompt, b, test, "f") for b in bodies]
    # text that is indented code loses its indent, so the second one is given on the head's line
    cases[1] = humaneval_programs("def f(x): ", "return x + 1", test, "f")
    programs = F.get(F.array(*[F.array(*map(F.lit, c)) if c else F.array().cast("array<string>") for c in cases]), (F.col("k") % 5).cast("int"))
    out = execute(_nation(spark, sf_dir).select("k", programs.alias("programs")), "programs", ["k"], allow=True)
    return out.select("k", "passed", (F.col("error") == "empty_code").alias("empty"))


@query("UDF3", """select doc_id, case doc_id % 4 when 0 then doc_id % 3 = 0 when 1 then doc_id % 3 <> 1 when 2 then regexp_matches(text, '\\S') else doc_id % 3 = 2 end as correct from documents""")
def udf3(spark, sf_dir):
    from tidemark.functions import text as T

    i, k, third = F.col("doc_id").cast("string"), F.col("doc_id") % 4, F.col("doc_id") % 3
    given = (
        F.when(k == 0, F.concat(F.lit("FINAL_ANSWER: "), F.when(third == 0, i).otherwise(F.lit("-1"))))
        .when(k == 1, F.when(third == 1, F.lit("so the answer is (B)")).otherwise(F.lit("The answer is C")))
        .when(k == 2, F.concat(F.lit(" "), F.col("text"))).otherwise(F.when(third == 2, F.lit("label: yes")).otherwise(F.lit("no")))
    )
    wanted = F.when(k == 0, F.concat(F.lit("#### "), i)).when(k == 1, F.lit("C")).when(k == 2, F.col("text")).otherwise(F.lit("true"))
    kind = F.when(k == 0, F.lit("math")).when(k == 2, F.lit("qa")).otherwise(F.lit("logic"))
    right = T.correctness(F.lit(None).cast("double"), given, wanted, kind)
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(right == 1, F.lit(False)).alias("correct"))
