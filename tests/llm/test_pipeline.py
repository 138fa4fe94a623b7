"""Each stage of the pipeline on its own input."""

from helpers import SF
from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark, awkward, nothing, tmp_path):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), awkward, nothing):
        columns = docs.columns
        before = docs
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, before, SF).write.mode("overwrite").parquet(str(tmp_path / name))
            after = spark.read.parquet(str(tmp_path / name))
            if k < 4:
                assert after.columns == columns
            if k < 2:
                assert after.exceptAll(before).count() == 0
            if k == 2:
                assert after.count() == before.count()
            if k == 4:
                assert after.where(F.size("ids") != F.col("n_tokens")).count() == 0
                assert after.count() == before.count()
                assert after.select("text").exceptAll(before.select(F.coalesce("text", F.lit("")).alias("text"))).count() == 0
            before = after


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
