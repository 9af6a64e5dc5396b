import corpus_pipeline
from medalmart.llm.token_planes import tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer


def test_stages_follow_each_other(spark, tmp_path, docs, rows):
    """Each stage's effect, on a small corpus, against what the stages' own tests establish."""
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    leak = rows[2][1]
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "tokens"]
    now, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder)
        seen[name] = now.select("doc_id").collect()
        if name != "tokens":
            assert now.columns == docs.columns
    ids = {n: [r["doc_id"] for r in v] for n, v in seen.items()}
    letterless = {i for i, t, _, _ in rows if not any(c.isalpha() for c in t or "")}
    assert letterless.isdisjoint(ids["language"])
    assert len(ids["near_duplicates"]) == len(set(ids["near_duplicates"])) < len(ids["language"])
    assert set(ids["near_duplicates"]) - set(ids["decontamination"]) == {2}
    assert set(ids["mixing"]) <= set(ids["decontamination"]) and max(map(ids["mixing"].count, ids["mixing"])) <= 2
    t, text = Tokenizer.from_file(tokenizer_path()), {r[0]: r[1] for r in rows}
    lengths = {i: len(t.encode(text[i] or "", add_special_tokens=False).ids) + 1 for i in set(ids["mixing"])}
    out = sorted(got.collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == sorted(ids["mixing"])
    assert [r["start"] for r in out] == [sum(lengths[r["doc_id"]] for r in out[:i]) for i in range(len(out))]
    assert got.agg(F.sum("n_tokens")).first()[0] == sum(lengths[i] for i in ids["mixing"])
