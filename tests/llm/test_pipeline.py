import corpus_pipeline as P
from tidewater.llm.common import Scratch
from tidewater.llm.decontaminate import contaminated
from tidewater.llm.near_dups import near_dup_groups
from tidewater.llm.toxicity import toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels, bench = spark.read.parquet(f"{FOLDER}/labels.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    scratch, columns = Scratch(spark), docs.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    got = {}
    for name, stage in P.STAGES:
        before, docs = docs, scratch.cut(stage(spark, docs, FOLDER))
        got[name] = docs
        if name == "toxicity":
            assert ids(docs) == ids(toxicity(before, labels).where("predicted = 0"))
        elif name == "near_dups":
            assert ids(docs) == ids(near_dup_groups(before, 5, 80).where("kept"))
        elif name == "decontamination":
            assert ids(docs) == sorted(set(ids(before)) - set(ids(contaminated(before, bench))))
        elif name == "mixing":
            assert set(ids(docs)) <= set(ids(before))
        else:
            assert ids(docs) == ids(before)
        assert docs.columns == columns + (["shard", "slot"] if name == "sharding" else [])
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dups", "decontamination", "mixing", "sharding"]
    again = P.run(spark, FOLDER)
    key = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in df.collect())
    assert key(again) == key(got["sharding"])


def test_stages_take_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows and names that the stages use themselves."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    names = ["_row", "_document", "_times", "block", "score", "component_id", "_twin"]
    wide = docs.withColumns({n: F.lit(1) for n in names})
    odd = spark.createDataFrame([(None, "a b c", None, None, None), (None, None, None, None, None), (9001, "", "en", None, 0), (9002, "word " * 150000, None, "web", 1), (9003, "w x", "en", "web", 1), (9003, "w x", "en", "web", 1)], docs.schema).withColumns({n: F.lit(None).cast("int") for n in names})
    for rows in (wide.unionAll(odd), wide.limit(0)):
        at = rows
        for name, stage in P.STAGES:
            at = Scratch(spark).cut(stage(spark, at, FOLDER))
            assert at.columns[: len(wide.columns)] == wide.columns, name
        assert (at.count() > 0) == (rows.count() > 0)
        if at.count():
            kept = {r.doc_id for r in at.collect()}
            assert {None, 9001, 9002, 9003} <= kept
