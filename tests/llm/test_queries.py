"""The registered queries: SQL where there is some, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from leafmill.llm.queries import ORACLES, QUERIES
from leafmill.plans.check import compare, duck
from leafmill.plans.catalog import ORACLES as OTHER_ORACLES
from leafmill.plans.catalog import QUERIES as OTHER_QUERIES
from leafmill.shared import shared_folder

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name, monkeypatch):
    monkeypatch.setitem(OTHER_QUERIES, name, QUERIES[name])
    monkeypatch.setitem(OTHER_ORACLES, name, ORACLES[name])
    outcome = compare(spark, duck(FOLDER), FOLDER, name)
    assert outcome.startswith("ok"), outcome


def test_every_operator_is_registered():
    assert {int(q[2:].split("_")[0]) for q in QUERIES if q.startswith("op")} >= set(range(1, 14)) and "pipeline" in QUERIES


def test_pipeline_stages(spark):
    from leafmill.llm import decontaminate, minhash, toxicity

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = shared_folder(spark, "test-stage")
        stage(spark, before, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns
        gone = ids(before) - ids(after)
        if name == "toxicity":
            assert gone == {r.doc_id for r in toxicity.scores(before, labels).filter("predicted = 1").collect()}
        elif name == "minhash_near_dedup":
            assert gone == {r.doc_id for r in minhash.groups(before, 5, (80, 100)).filter("not kept").collect()} and gone
        elif name == "benchmark_decontamination":
            assert gone == {r.doc_id for r in decontaminate.passages(before, benchmark).collect()}
        else:
            assert not gone
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, FOLDER).collect()
    assert {d for r in packed for d in r.doc_ids} == {r.doc_id for r in before.filter("text <> ''").collect()}


def test_stages_act_on_rows_with_null_and_repeated_ids(spark):
    import random
    from collections import Counter

    from leafmill.llm import decontaminate, minhash, toxicity

    chance = random.Random(3)
    text = lambda n=40: " ".join(f"w{chance.randint(0, 900)}" for _ in range(n))
    kept = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    table = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")

    clean, passage = [text() for _ in range(6)], text()
    rows = [(None, clean[0]), (None, f"{clean[1]} {passage}"), (7, clean[2]), (7, f"{passage} {clean[3]}"), (8, passage), (9, None), (None, None)]
    benchmark = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    wanted = Counter([rows[i] for i in (0, 2, 5, 6)])
    assert kept(decontaminate.without_passages(table(rows), benchmark)) == wanted

    same = [(None, clean[0]), (None, clean[1]), (None, clean[1]), (3, clean[1]), (4, clean[2]), (4, clean[2]), (5, clean[2]), (4, clean[3]), (6, clean[3]), (2, clean[4]), (9, None), (10, ""), (None, clean[5])]
    found = kept(minhash.first_of_each_group(table(same)))
    assert found == Counter([same[i] for i in (0, 1, 4, 7, 9, 12)] + [(9, None), (10, "")])

    bad = lambda: " ".join([text(10)] + [f"vile{chance.randint(0, 9)}" for _ in range(10)])
    train = [(i, bad() if i % 3 == 0 else text(20)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id bigint, toxic int")
    odd = [(None, clean[0]), (None, bad()), (1000, clean[2]), (1000, bad())]
    found = kept(toxicity.without_toxic(table(train + odd), labels))
    assert [row in found for row in odd] == [True, False, True, False]
