from ledgerloom.streaming import sightings as S


def test_stream_keeps_one_of_equal_sightings(spark, tmp_path, data):
    source = tmp_path / "in"
    rows = spark.read.parquet(f"{data}/net_l2.parquet").where("ts_micro is not null").select(*[c.split(" ")[0] for c in S.SCHEMA.split(", ")])
    rows.unionByName(rows.limit(50)).write.parquet(str(source))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    q = S.append(S.once(S.arriving(spark, str(source)), "400 days"), out, mark)
    q.awaitTermination()
    expected = rows.select("txid", "ts_micro", "src_ip").distinct().count()
    assert spark.read.parquet(out).count() == expected
    # nothing new: a second run adds nothing
    S.append(S.once(S.arriving(spark, str(source)), "400 days"), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == expected


def test_windows(spark, tmp_path, data):
    source = tmp_path / "in"
    spark.read.parquet(f"{data}/net_l2.parquet").write.parquet(str(source))
    q = S.per_window(S.arriving(spark, str(source))).writeStream.format("memory").queryName("per_window").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    n = spark.read.parquet(str(source)).where("ts_micro is not null").count()
    assert spark.table("per_window").where("start is not null").selectExpr("sum(sightings)").first()[0] == n
