from reclaim.streaming.plan_stream import plan_stream, reclaim_totals_stream, write_plan_stream
