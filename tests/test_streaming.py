"""Rules on a stream give the same plan as the batch run."""

import os
import uuid

import pytest

from reclaim.operators import first_match, reclaim_by_rule
from reclaim.plans.queries import five_rules
from reclaim.session import checkpoint_dir
from reclaim.sources.tables import INVENTORY_COLUMNS, read_inventory
from reclaim.streaming.plan_stream import plan_stream, reclaim_totals_stream, write_plan_stream

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_stream_plan_equals_batch(spark, stored):
    src = stored
    batch = read_inventory(spark, src)
    stream = spark.readStream.schema(batch.schema).parquet(src).select(*INVENTORY_COLUMNS)
    plan = plan_stream(stream, five_rules())
    base = checkpoint_dir(spark)
    out = f"{base}/stream-plan-{uuid.uuid4().hex}"
    q = write_plan_stream(plan, out, f"{base}/stream-ckpt-{uuid.uuid4().hex}", trigger_once=True)
    q.awaitTermination(120)
    got = {(r.id, r.rule) for r in spark.read.parquet(out).select("id", "rule").collect()}
    want = {(r.id, r.rule) for r in first_match(batch, five_rules()).select("id", "rule").collect()}
    assert got == want and got

    totals = reclaim_totals_stream(plan_stream(
        spark.readStream.schema(batch.schema).parquet(src).select(*INVENTORY_COLUMNS), five_rules()))
    name = "totals_" + uuid.uuid4().hex[:8]
    tq = totals.writeStream.format("memory").queryName(name).outputMode("complete") \
        .option("checkpointLocation", f"{base}/stream-ckpt-{uuid.uuid4().hex}").start()
    tq.processAllAvailable()
    tq.stop()
    got_t = {(r.rule, r.files, r.bytes) for r in spark.sql(f"SELECT * FROM {name}").collect()}
    want_t = {(r.rule, r.files, r.bytes) for r in reclaim_by_rule(first_match(batch, five_rules())).collect()}
    assert got_t == want_t


def test_stream_refuses_rules_needing_directory_rows(spark, stored):
    from reclaim.plans.catalogue import file_rulebook
    from reclaim.plans.queries import AS_OF
    src = stored
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    with pytest.raises(ValueError):
        plan_stream(stream, file_rulebook(AS_OF).rules(["cmake"]))
