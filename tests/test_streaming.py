"""Streams over files that are not in time order."""

import datetime
import os

from tessel import plans


def test_deduplication_keeps_late_rows_and_finds_far_repeats(spark, tmp_path):
    day = datetime.datetime(2024, 1, 10, tzinfo=datetime.timezone.utc)
    rows = [[(3 * k + i, 7, day + datetime.timedelta(days=-k if k % 2 else k, hours=i)) for i in range(3)] for k in range(11)]
    rows.append([(1, 7, day + datetime.timedelta(days=30))])  # the id of the first file again
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "event_id long, user_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"{k}"))
        made = next((tmp_path / f"{k}").glob("*.parquet"))
        made.rename(folder / f"part-{k:03}.parquet")
        os.utime(folder / f"part-{k:03}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    got = plans.QUERIES["streaming_deduplicate"](spark, str(tmp_path)).collect()
    assert sorted((r.event_id, r.user_id) for r in got) == [(i, 7) for i in range(33)]
