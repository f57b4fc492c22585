"""The pipeline's stages against plain Python, each on its own input."""

import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tiktoken = pytest.importorskip("tiktoken")


def test_pipeline_end_to_end(spark, tmp_path):
    import public_tokenizers

    from tests.llm.test_duplicates_and_archives import plain_fingerprint, plain_lines, union
    from tidemark.llm import bpe

    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(4000)}"
    prose = lambda lines=6: "\n".join(" ".join(word() for _ in range(12)) for _ in range(lines))
    item = " ".join(word() for _ in range(14))
    docs = [(i, prose(), 1) for i in range(80)]
    docs += [(200 + i, " ".join(f"{word()} ### $$$" for _ in range(40)), 0) for i in range(40)]
    docs += [(300, docs[0][1], 1), (301, docs[1][1].replace(docs[1][1].split()[3], "changed"), 1), (302, prose() + "\n" + item + "\n" + prose(), 1), (303, "few words", 1), (304, docs[2][1].split("\n")[0] + "\n" + prose(), 1)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q in docs], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = [(i, t) for i, t, q in docs if q and len(t.split()) >= 10]
    gone = plain_lines(kept)
    kept = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])) for i, t in kept]
    fps = {i: plain_fingerprint(t) for i, t in kept}
    group = union(list(fps), [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    kept = [(i, t) for i, t in kept if group[i] == i]
    texts = {}
    for i, t in kept:
        spans = [m.span() for m in re.finditer(r"[a-z0-9]+", t)]
        words, wanted = [t[a:b] for a, b in spans], item.split()
        hit = sorted({p + q for p in range(len(words)) for r in range(len(wanted) - 9) if words[p : p + 10] == wanted[r : r + 10] for q in range(10)})
        if len(hit) <= 0.8 * len(words):
            for last in reversed(hit):  # a hit word leaves, and what is between it and the hit word before it
                first = spans[last][0] if last - 1 not in hit else spans[last - 1][1]
                t = t[:first] + t[spans[last][1] :]
            texts[i] = t
    assert set(range(80)) <= set(texts) and not {303, 200} & set(texts)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert {i: r.ids for i, r in got.items()} == {i: reference.encode_ordinary(t) for i, t in texts.items()}
    assert item not in reference.decode(got[302].ids)


def test_stages_return_document_columns(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash", "decontamination", "bpe"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    empty = spark.createDataFrame([], schema)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() == 0, name
