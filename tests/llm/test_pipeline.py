"""The pipeline end to end on a small table, and the registration of all queries."""

import corpus_pipeline
import __spark_entry__
from conftest_words import words
from pyspark.sql import functions as F


def test_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert not set(__spark_entry__.oracle_sql()) & {n for n in names if n.startswith("op")}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "pii", "packing"]


def test_stages(spark, docs, tmp_path):
    clean = [(i, f"{words(i, 80)}\n{words(i + 500, 80)}") for i in range(40)]
    copies = [(100, clean[3][1]), (101, clean[4][1])]
    private = [(200, words(900, 40) + " card 4539578763621486 " + words(901, 40))]
    boiler = [(300 + i, f"all rights reserved by the author of this page\n{words(i + 2000, 60)}") for i in range(5)]
    toxic = [(400 + i, words(i + 3000, 40) + " you idiot moron " + words(i + 4000, 40)) for i in range(40)]
    odd = [(500, None), (501, ""), (None, words(6000, 30))]
    df = docs(clean + copies + private + boiler + toxic + odd)
    folder = str(tmp_path / "sf")
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 400)) for i, _ in clean + toxic], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    now, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, folder)
        assert out.columns == df.columns
        out.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        kept[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    assert not {i for i, _ in toxic} & set(kept["toxicity"]) and {i for i, _ in clean} <= set(kept["toxicity"])
    assert sum("all rights reserved" in (t or "") for t in kept["line_dedup"].values()) == 1 and kept["line_dedup"][100] == ""
    assert {i for i, _ in clean} <= set(kept["simhash_near_dedup"]) and not {100, 101} <= set(kept["simhash_near_dedup"])
    assert "4539578763621486" not in kept["pii"][200]
    assert now.where(F.coalesce(F.length("text"), F.lit(0)) != F.coalesce("n_chars", F.lit(0))).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, folder)
    assert {r["doc_id"] for r in pieces.collect()} == set(kept["pii"])
    assert corpus_pipeline.run(spark, folder).count() == pieces.count()
