import json
import os
import tempfile

from aftershock.streaming.facts_stream import _batch_writer, ingest_company_facts, landed_failures, landed_series


def _doc(cik, val):
    fact = {"end": "2020-12-31", "val": val, "form": "10-K", "filed": "2021-02-01", "fy": 2020, "fp": "FY"}
    return json.dumps({"cik": cik, "facts": {"us-gaap": {"Assets": {"units": {"USD": [fact]}}}}})


def test_stream_ingests_each_file_once(spark):
    base = tempfile.mkdtemp(prefix="aftershock-stream-")
    landing, out = os.path.join(base, "landing"), os.path.join(base, "out")
    os.makedirs(landing)
    for cik, val in [(1, 10.0), (2, 20.0)]:
        with open(os.path.join(landing, f"CIK{cik}.json"), "w") as fh:
            fh.write(_doc(cik, val))
    with open(os.path.join(landing, "broken.json"), "w") as fh:
        fh.write("{oops")
    ingest_company_facts(spark, landing, out, name=os.path.basename(base)).awaitTermination()
    # a second run over the same files adds nothing (checkpointed file source)
    ingest_company_facts(spark, landing, out, name=os.path.basename(base)).awaitTermination()
    assert sorted((r.cik, r.value) for r in landed_series(spark, out).collect()) == [(1, 10.0), (2, 20.0)]
    assert landed_failures(spark, out).count() == 1
    # a second filing of filer 1, in a later batch, and a retry of that batch: still one row a filer and year
    for _ in range(2):
        _batch_writer(out)(spark.createDataFrame([("later", _doc(1, 11.0))], "doc string, json string"), 7)
    got = landed_series(spark, out)
    assert sorted((r.cik) for r in got.collect()) == [1, 2]
