"""The pipeline's stages on invented documents."""

import corpus_pipeline
from veilgraph.llm.common import materialise

from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, tmp_path):
    rows = [(i, brute.varied(500 + i, 60 + i % 30), "aa", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[0][1], "aa", "s0"), (101, rows[0][1] + " tail", "aa", "s1"), (101, rows[0][1] + " tail", "aa", "s1")]
    passage = brute.varied(77, 55)
    rows += [(110 + i, f"{brute.varied(600 + i, 100)} {passage} {brute.varied(700 + i, 80)}", "aa", "s2") for i in range(3)]
    item = brute.varied(88, 40)
    rows += [(120, f"{brute.varied(800, 30)} {item} {brute.varied(801, 30)}", "aa", "s0"), (130, None, "aa", "s0"), (131, "12 34 !!", "aa", None), (132, "жжж " * 400, None, "s1"), (None, brute.varied(900, 50), None, None)]
    spark.createDataFrame([(*r, len(r[1]) if r[1] else 0) for r in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows, passage


def test_stages(spark, tmp_path):
    rows, passage = tables(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = materialise(stage(spark, docs, str(tmp_path)))
        seen[name] = docs
        if name != "mixing":
            assert docs.columns == before
    ids = lambda name: sorted((r["doc_id"] for r in seen[name].collect()), key=lambda x: (x is None, x or 0))
    clean = [i for i in range(60)] + [110, 111, 112, 120]
    assert ids("language ID") == clean[:60] + [100, 101, 101, 110, 111, 112, 120, None]
    assert ids("near-dedup") == [*clean, None]
    cut = {r["doc_id"]: r for r in seen["substring dedup"].collect()}
    plain = {k: kept for k, _, _, kept in brute.cut([(r["doc_id"], r["text"]) for r in seen["near-dedup"].collect()], 35)}
    assert {k: r["text"] for k, r in cut.items()} == plain
    assert all(passage not in r["text"] and r["n_chars"] == len(r["text"]) for r in cut.values())
    assert ids("decontamination") == [i for i in [*clean, None] if i != 120]
    mixed = seen["mixing"].collect()
    assert mixed and all(r["taken"] % r["size"] == 0 and 0 < r["taken"] <= 3 * r["size"] for r in mixed)
    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "text", "taken").collect()
    assert sorted(map(str, whole)) == sorted(str(r) for r in seen["mixing"].select("doc_id", "text", "taken").collect())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "mixing" or out.columns == docs.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_clashing_columns_and_long_texts(spark, tmp_path):
    spark.createDataFrame([(1, brute.varied(88, 40))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["gone", "N_WORDS", "n_removed", "kept_sha256", "size", "Taken", "lang_pred", "score", "node", "once", "block", "keep", "rejected", "item_id", "held_out", "_Taken"]
    long = " ".join(brute.varied(i, 5000) for i in range(40))
    assert len(long) > 1_000_000
    rows = [(i, brute.varied(500 + i, 60), "aa", "s0", 1) for i in range(20)] + [(50, long, "aa", "s1", 1), (51, long + " end", "aa", "s1", 1), (52, f"{long[:700_000]} {brute.varied(88, 40)}", "aa", "s1", 1)]
    docs = spark.createDataFrame([(*r, *[f"{n} {r[0]}" for n in names]) for r in rows], SCHEMA + "".join(f", {n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, str(tmp_path)))
        if name != "mixing":
            assert out.columns == docs.columns
            docs = out
        passed = [n for n in names if n not in ("size", "Taken", "_Taken")]
        assert out.count() and all(r[n] == f"{n} {r['doc_id']}" for r in out.collect() for n in passed)
        assert name == "mixing" or 50 in {r["doc_id"] for r in out.collect()}
    assert {"size", "source_size", "target", "taken", "_size", "_Taken", "__Taken"} <= set(out.columns)
    assert all((r["_size"], r["_Taken"], r["__Taken"]) == (f"size {r['doc_id']}", f"_Taken {r['doc_id']}", f"Taken {r['doc_id']}") for r in out.collect())
