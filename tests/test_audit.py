"""The audit taken while companies are written, against the one of a second pass."""

import json

from vendorlake.operators import audit, ingest
from vendorlake.sources import dims


def payloads(spark):
    record = lambda i, **k: {"id": i, "name": f"n{i}", "website": "https://x.example", "country": "US", "verticals": [], "products": ["P"], "score": 5} | k
    runs = {
        "a": [record(i % 7, employees="11–50" if i % 2 else "many", ownership="VC-Backed" if i % 3 else "Secret") for i in range(22)],
        "b": [record(1, revenue="< $1M", foundedYear="soon"), None, 5, record(1, score="9"), record(None, products=["Q"])], "c": [], "d": "no list",
    }
    rows = [(k, "P", json.dumps({"content": [{"type": "text", "text": json.dumps(r) if isinstance(r, list) else r}]})) for k, r in runs.items()] + [("e", "P", "oops")]
    return spark.createDataFrame(rows, "run_id string, product string, body string")


def rows(df):
    return sorted((r["rule"], r["n_checked"], r["n_broken"]) for r in df.collect())


def test_observed_audit_is_the_audit(spark):
    df, seen = payloads(ingest.allow_repeated_keys(spark)), []
    want = rows(audit.audit(ingest.exploded(ingest.parsed(df))))
    got = audit.ingest_audited(df, lambda c: seen.append(c.drop("raw").toArrow().num_rows))
    assert rows(got) == want and seen == [25]
    options = dims.dim_option(spark).where("ord > 0").select("attribute", "label")
    assert rows(audit.ingest_audited(df, lambda c: c.drop("raw").collect(), options)) == want


def test_vocabularies_may_change(spark):
    df = payloads(ingest.allow_repeated_keys(spark))
    options = spark.createDataFrame([("size", "many"), ("ownership", "Secret"), ("ownership", "VC-Backed"), ("ownership", "Secret")], "attribute string, label string")
    got = {r[0]: r[1:] for r in rows(audit.ingest_audited(df, lambda c: c.drop("raw").collect(), options))}
    assert got["C5 employees"] == (25, 11) and got["C6 ownership"] == (25, 0) and got["C5 revenue"] == (25, 1)


def test_the_payloads_are_scanned_once(spark, tmp_path):
    payloads(ingest.allow_repeated_keys(spark)).write.parquet(str(tmp_path / "in"))
    plans = []
    audit.ingest_audited(spark.read.parquet(str(tmp_path / "in")), lambda c: plans.append((c.drop("raw").collect(), c.drop("raw")._jdf.queryExecution().executedPlan().toString())[1]))
    assert plans[0].count("FileScan") == 1


def test_no_payloads(spark):
    none = payloads(ingest.allow_repeated_keys(spark)).where("false")
    assert all(r[1:] == (0, 0) for r in rows(audit.ingest_audited(none, lambda c: c.drop("raw").collect())))
