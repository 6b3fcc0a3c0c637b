"""How often near-duplicates deal out what grows with the corpus."""

import random

from deltaspan.llm import dedup


def _records(spark) -> int:
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_band_keys_are_dealt_out_twice(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(250)]
    texts += [f"{texts[0]} more{i}" for i in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before, held = _records(spark), spark.conf.get(name)
    # Without broadcasts, as where all sides are large.
    spark.conf.set(name, "-1")
    try:
        out = {r.doc_id: r.component_id for r in dedup.near_duplicates(docs).collect()}
    finally:
        spark.conf.set(name, held)
    assert out == {i: 0 if i >= 250 else i for i in range(254)}
    # For leaders and for the members of shared buckets; other steps have a few rows a document.
    assert _records(spark) - before < 3 * len(texts) * dedup.Config().bands
