from roomtide.functions.scalars import bucket
from roomtide.plans import dashboard
from roomtide.streaming import live


def test_stream_equals_batch(spark, tmp_path, at):
    rows = [(at(i), "z" if i % 3 else "y", 60.0 + i % 20) for i in range(200)]
    batch = spark.createDataFrame(rows, "timestamp timestamp_ntz, space_id string, zone_temp double")
    batch.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    writer = live.live_comfort(stream).writeStream.outputMode("complete").format("memory").queryName("live_comfort")
    run = writer.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.timestamp, r.space_id): (r.avg_temp, r.comfort_exceedance_pct, r.samples) for r in spark.table("live_comfort").collect()}
    parts = batch.withColumn("space_id", batch.space_id).withColumn("at", bucket("timestamp", 900))
    expected = {}
    for moment in {r.at for r in parts.select("at").collect()}:
        for r in dashboard.hvac_zone_stats(batch, start=moment, end=moment.replace(second=59, minute=moment.minute + 14)).collect():
            expected[(moment, r.space_id)] = (r.avg_temp, r.comfort_exceedance_pct, r.samples)
    assert got == expected


def test_live_occupancy_equals_batch(spark, tmp_path, at):
    rows = [(at(i), "z" if i % 4 else "y", float(i % 9) if i % 11 else None) for i in range(180)]
    batch = spark.createDataFrame(rows, "timestamp timestamp_ntz, zone_id string, occupancy_count double")
    batch.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    writer = live.live_occupancy(stream).writeStream.outputMode("complete").format("memory").queryName("live_occupancy")
    run = writer.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.timestamp, r.zone_id): (r.avg_occ, r.peak_occ, r.samples) for r in spark.table("live_occupancy").collect()}
    expected = {}
    for moment, zone in {(at(i // 15 * 15), "z" if i % 4 else "y") for i in range(180)}:
        own = [v for t, z, v in rows if z == zone and 0 <= (t - moment).total_seconds() < 900]
        known = [v for v in own if v is not None]
        expected[moment, zone] = (sum(known) / len(known), max(known), len(own))
    assert got == expected
