"""The pipeline's stages on a small table, and its queries' registration."""

import importlib
from collections import Counter


import corpus_pipeline
from ledgerloom.llm import queries as registered

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, SF))
        assert out.columns == columns, name
        assert out.where("text is not null and n_chars <> length(text)").count() == 0
        before, after = (Counter(r[0] for r in x.select("doc_id").collect()) for x in (docs, out))
        assert not after - before and after
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in pieces.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_stage_decisions(spark):
    """A second run of a deduplicating or filtering stage finds nothing left to do."""
    docs = corpus_pipeline.stored(spark.read.parquet(f"{SF}/documents.parquet"))
    for stage in (corpus_pipeline.line_stage, corpus_pipeline.simhash_stage, corpus_pipeline.benchmark_stage):
        once = corpus_pipeline.stored(stage(spark, docs, SF))
        twice = stage(spark, once, SF)
        assert once.count() == twice.count()
        assert once.exceptAll(twice).count() == 0


def test_line_stage_drops_documents_that_lost_all_lines(spark):
    rows = [(1, "the very same line of prose", "en", "s", 27), (2, "The very same line of prose", "en", "s", 27), (3, "", "en", "s", 0), (4, None, None, None, None)]
    docs = corpus_pipeline.stored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert sorted(r[0] for r in corpus_pipeline.line_stage(spark, docs, SF).select("doc_id").collect()) == [1, 3, 4]


def written(spark, folder, documents, labels, benchmark):
    for name, rows, schema in (
        ("documents", documents, "doc_id long, text string, lang string, source string, n_chars int, rest string, component long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", benchmark, "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_run_on_awkward_tables(spark, tmp_path):
    """The whole chain, on rows whose fate each stage's rules give."""
    words = lambda k, n: " ".join(f"w{k}x{i * i % 97}" for i in range(n))
    item = " ".join(f"bench{i}" for i in range(14))
    texts = [
        (1, words(1, 40)), (2, words(1, 40) + " "), (3, words(3, 60) + "\n" + words(4, 50)), (4, words(5, 30) + "\n" + words(4, 50)), (5, "so " + item + " ends"),
        (6, None), (7, ""), (8, None), (None, words(8, 40)), (9, words(9, 60_000)), (10, words(10, 40)), (10, words(10, 40)), (11, words(11, 8) + " <|endoftext|> " + words(12, 8)),
    ]
    rows = [(i, t, "en", "s", len(t or ""), "clash", 5) for i, t in texts]
    folder = written(spark, tmp_path / "all", rows, [], [(1, item), (2, None), (None, "null")])
    got = corpus_pipeline.run(spark, folder).collect()
    # no labels: none rejected; 2 loses its only line; 4 loses a line; of the texts without words one stays; 5 is contaminated
    kept = Counter(r["doc_id"] for r in got if r["piece"] == 0)
    assert kept == Counter([1, 3, 4, 6, None, 9, 10, 11])
    assert all(0 <= r["offset"] and r["offset"] + r["length"] <= 2048 for r in got)
    assert sum(r["length"] for r in got if r["doc_id"] == 9) > 60_000
    lost = sum(r["length"] for r in got if r["doc_id"] == 4)
    assert lost < sum(r["length"] for r in got if r["doc_id"] == 3)
    none = written(spark, tmp_path / "none", [], [], [])
    assert corpus_pipeline.run(spark, none).count() == 0


def test_scratch_tables_of_a_run_are_deleted(spark, tmp_path):
    from ledgerloom.llm.common import scope, stored

    with scope(spark):
        inside, kept = stored(spark.range(5)), stored(spark.range(7), scoped=False)
    assert kept.count() == 7
    p = spark._jvm.org.apache.hadoop.fs.Path(inside._ledgerloom_path)
    assert not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def test_registered():
    names = registered.queries()
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in names} - {"pipeline"}
    assert set(registered.oracle_sql()) <= set(names)
    assert importlib.import_module("__spark_entry__").queries().keys() >= names.keys()


def test_top_level_query_is_native(spark):
    plan = registered.queries()["op2_url_rules"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
