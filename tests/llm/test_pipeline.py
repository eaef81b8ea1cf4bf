"""The stages on a small corpus, each against what its operator should keep."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tracemill.llm.decontaminate import find_leaks
from tests.llm.test_copies import plain_kept, rows_of
from tracemill.session import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(settle(stage(spark, out[-1], d)))
    return d, out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_every_stage_does_its_part(spark, steps):
    d, (docs, clean, single, free, masked, mixed) = steps
    toxic = {r["doc_id"] for r in entry.queries()["op4_toxicity"](spark, d).filter("predicted = 1").collect()}
    assert ids(docs) - ids(clean) == toxic and toxic
    assert ids(single) == plain_kept(rows_of(clean))
    leaks = ids(find_leaks(single, spark.read.parquet(f"{d}/benchmark.parquet")))
    assert ids(single) - ids(free) == leaks and leaks
    assert ids(masked) == ids(free)
    assert masked.filter("text rlike 'AKIA[A-Z0-9]{14}|[0-9a-f]{16}'").count() == 0
    assert masked.filter("n_chars <> length(text)").count() == 0
    assert all(df.columns == COLUMNS for df in (clean, single, free, masked))
    # Texts without a secret stay as they are.
    assert free.join(masked, ["doc_id", "text"], "left_anti").count() == masked.filter("text like '%[SECRET]%'").count()


def test_mix_meets_targets(steps):
    rows = steps[1][-1].collect()
    by = {}
    for r in rows:
        assert r["copies"] > 0 and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(n - t) < 0.05 * t for t, n in by.values())


def test_odd_rows_go_through(spark, odd, tmp_path):
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "none of this")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    odd.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").write.parquet(f"{tmp_path}/empty/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
