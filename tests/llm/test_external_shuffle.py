from collections import Counter

from pyspark.sql import functions as F

from toposcope.llm import external_shuffle as X


def dealt(rows, shards):
    """Slots of each shard are gapless, counts at most one apart."""
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert set(slots) <= set(range(shards)) and max(counts) - min(counts) <= 1


def order(rows):
    return [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]


def test_all_rows_once_also_a_hot_one_and_odd_columns(spark, tmp_path):
    rows = [(i, "x" * (i % 50), "a") for i in range(700)] + [(7, "hot", "b")] * 350 + [(None, None, None), (None, "", "z"), (1, "é😀" * 40_000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Slot string").withColumn("a.b", F.lit(1)).withColumn("list", F.array("doc_id"))
    got = X.external_shuffle(df, f"file://{tmp_path}/a", shards=5, bucket_bytes=20_000).collect()
    dealt(got, 5)
    assert Counter((r.doc_id, r.text) for r in got) == Counter(r[:2] for r in rows)
    assert set(got[0].asDict()) == {"doc_id", "text", "a.b", "list", "shard", "slot"}
    # the copies of one row spread over all shards
    hot = Counter(r.shard for r in got if r.text == "hot")
    assert len(hot) == 5 and max(hot.values()) < 120


def test_same_seed_same_order_whatever_the_splits_and_another_seed_another(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text")).repartition(3).write.parquet(path)
    run = lambda name, seed=1: X.external_shuffle(spark.read.parquet(path), f"file://{tmp_path}/{name}", 7, seed, 10_000, stored=True).collect()
    first = run("one")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        again = run("two")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    other = run("three", 2)
    dealt(first, 7)
    assert order(first) == order(again) != order(other)
    assert sorted(order(other)) == list(range(3000))


def test_order_is_uniform(spark, tmp_path):
    """Each tenth of the input meets each tenth of the output alike (chi-square, 81 degrees of freedom)."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).coalesce(1)
    seen = order(X.external_shuffle(df, f"file://{tmp_path}/u", 4, bucket_bytes=60_000).collect())
    cells = Counter((i // 2000, d // 2000) for i, d in enumerate(seen))
    chi = sum((cells[i, j] - 200) ** 2 / 200 for i in range(10) for j in range(10))
    assert 35 < chi < 150
    neighbours = sum(abs(a - b) == 1 for a, b in zip(seen, seen[1:], strict=False))
    assert neighbours < 20


def test_few_rows_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    dealt(X.external_shuffle(df, f"file://{tmp_path}/f").collect(), 24)
    empty = X.external_shuffle(df.limit(0), f"file://{tmp_path}/e")
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "shard", "slot"]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = X.op12_external_shuffle(spark, sf).collect()
    dealt(got, 24)
    text = F.coalesce("text", F.lit(""))
    want = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", (F.length(F.encode(text, "utf-8")) + 8).alias("size"), F.crc32(text.cast("binary")).alias("c")).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(map(tuple, want))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
