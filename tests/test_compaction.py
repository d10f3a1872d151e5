"""Many small batches: what lies in the drop folder's store stays bounded, and its result is that of one batch."""

import datetime
import random

from marquee.operators import dedup
from marquee.plans.queries import P
from marquee.schema import LISTING
from marquee.streaming import landing


def test_fifty_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"act {rng.randint(0, 9)}", rng.choice(["The Shell", "Shell", "Bar", "Hall"]), P.anchor_date + datetime.timedelta(days=rng.randint(0, 1)), rng.choice([None, "7 PM"]), "S", None, "s", 0, "f", i)
            for i in range(150)]
    order = rng.sample(rows, len(rows))
    store = landing.Store(str(tmp_path / "store"), 2, 8)

    def files(path):
        return [f for f in (tmp_path / "store" / path).rglob("part-*")]

    def published():
        return sorted(r.pos for r in spark.read.parquet(store.published).select("pos").collect())

    most = 0
    for n in range(50):  # some are published as well, the last ones among them
        step = landing.apply_batch if n % 16 == 5 or n > 46 else landing.land
        step(spark.createDataFrame(order[n * 3 : n * 3 + 3], LISTING).coalesce(1), n, store, P)
        most = max(most, len(files("landed")) + len(files("merged")))
    assert most <= 2 * 2 + 8 * 3  # a generation's dates and buckets, and the rows of the batches since
    assert len(list((tmp_path / "store" / "merged").iterdir())) == 1
    assert sorted(r.pos for r in landing.read_landed(spark, store).collect()) == list(range(150))
    want = sorted(r.pos for r in dedup.deduplicate(spark.createDataFrame(rows, LISTING)).select("pos").collect())
    assert published() == want
    # a batch that runs again, whether its rows were merged or not
    for n in (3, 8, 49):
        landing.apply_batch(spark.createDataFrame(order[n * 3 : n * 3 + 3], LISTING).coalesce(1), n, store, P)
    assert sorted(r.pos for r in landing.read_landed(spark, store).collect()) == list(range(150)) and published() == want


def test_unfinished_folders_do_not_count(spark, tmp_path):
    store = landing.Store(str(tmp_path / "store"), 2, 2)
    rows = [("a", "Shell", P.anchor_date, None, "S", None, "s", 0, "f", 0)]
    landing.apply_batch(spark.createDataFrame(rows, LISTING), 0, store, P)
    half = tmp_path / "store" / "merged" / "generation=7" / "date=2026-02-15" / "bucket=0"
    half.mkdir(parents=True)
    assert landing.read_landed(spark, store).count() == 1
    assert spark.read.parquet(store.published).count() == 1
