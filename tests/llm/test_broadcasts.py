"""No table that grows with the input is broadcast, however small Spark takes it for."""

from fixtures import table
from pyspark.sql import functions as F

from freightdocs.llm import line_chunks, minhash


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_keys_of_signatures_are_shuffled(spark, tmp_path):
    rows = minhash.shingled(table(spark), 3).filter("sig IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("rep"), "sig")
    rows.write.parquet(f"{tmp_path}/rows")
    found = spark.read.parquet(f"{tmp_path}/rows")  # a table of known size
    posts = minhash._postings(found, 20)
    assert "Broadcast" not in plan(posts)
    posts.select("rep", "held", "token", F.col("rep").alias("part"), F.lit(3).cast("long").alias("n")).write.parquet(f"{tmp_path}/posts")
    assert "Broadcast" not in plan(minhash._partners(spark.read.parquet(f"{tmp_path}/posts"), found, 20))


def test_rows_and_their_components_are_shuffled(spark):
    assert "Broadcast" not in plan(minhash.near_duplicates(table(spark), 3))
    assert "Broadcast" not in plan(minhash.representatives(table(spark), 3))


def test_gathered_lines_are_shuffled(spark):
    assert "Broadcast" not in plan(line_chunks.deduplicated(table(spark)))
