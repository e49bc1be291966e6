"""Whether keys are sent to every executor or shuffled, the rows are the same."""

import pytest

from plumbline.llm import common, nearcopies, simhash


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_either_way_of_joining(spark, sf, most, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    a, b = nearcopies.drop_similar(docs), simhash.drop_near_duplicates(docs)
    assert ("BroadcastHashJoin" in a._jdf.queryExecution().executedPlan().toString()) == (most > 0) or most == 0
    kept = [sorted(r.doc_id for r in x.collect()) for x in (a, b)]
    test_either_way_of_joining.seen.append(kept)
    assert all(k == test_either_way_of_joining.seen[0] for k in test_either_way_of_joining.seen) and len(kept[0]) < docs.count()


test_either_way_of_joining.seen = []
