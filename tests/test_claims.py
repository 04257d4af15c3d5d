import random

from pyspark.sql import functions as F

from talentloom.operators.claims import SURE, Claim, resolved, resolved_rows, unpivoted

CLAIMS = [Claim("mail", "email", 0.9), Claim("e mail.2", "email", 0.72), Claim("contact", "email", 0.85), Claim("who", "name", 0.6), Claim("field", "name", 0.95), Claim("value", "name", 0.7), Claim("n", "years", 0.9), Claim("m", "years", 0.9)]
SCHEMA = "id int, mail string, `e mail.2` string, contact string, who string, field string, value string, n double, m double"


def quality(value, field):
    if value is None:
        return 0
    if not isinstance(value, str):
        return 6 if value > 0 else 2
    points = 2 + 2 * (len(value.strip()) > 0) + 2 * (len(value.strip()) > 5)
    fits = {"email": "@" in value and "." in value, "name": bool(value.strip()) and not any(c.isdigit() for c in value)}
    return min(10, points + 4 * fits.get(field, False))


def plain(row):
    out = {}
    for c in CLAIMS:
        v = row[c.column]
        if v is None or (isinstance(v, str) and not v.strip()):
            continue
        if c.field not in out:
            out[c.field] = (v, c.column, 1)
            continue
        held, column, n = out[c.field]
        a, b = quality(held, c.field), quality(v, c.field)
        out[c.field] = (v, c.column, n + 1) if b > a or (b == a and c.confidence > SURE) else (held, column, n + 1)
    return out


def rows(n=300):
    rng = random.Random(5)
    text = [None, "", "  ", "a@b.c", "ann@mail.example", "ann", "Ann Smith", "ann7", "x@y", "a longer text", " Bo "]
    return [(i, *(rng.choice(text) for _ in range(6)), rng.choice([None, 0.0, 3.0]), rng.choice([None, -1.0, 4.0])) for i in range(n)]


def test_any_number_of_columns(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    names = df.columns
    for r in resolved(df, CLAIMS, ["id"]).collect():
        want = plain(dict(zip(names, data[r["id"]])))
        for field in ("email", "name", "years"):
            got = r[field]
            assert (got["value"], got["source"], got["n_claims"]) == want.get(field, (None, None, 0)), (r, want)
            assert (got["reason"] == "absent") == (field not in want)


def test_the_same_by_rows(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    by_row = {(r["id"], r["field"]): (r["value"], r["source"], r["quality"], r["n_claims"]) for r in resolved_rows(unpivoted(df, CLAIMS, ["id"]), ["id"]).collect()}
    want = {}
    for r in resolved(df, CLAIMS, ["id"]).collect():
        want |= {(r["id"], f): (str(r[f]["value"]), r[f]["source"], r[f]["quality"], r[f]["n_claims"]) for f in ("email", "name", "years") if r[f]["n_claims"]}
    assert by_row == want


def test_types_that_differ_and_lists(spark):
    df = spark.createDataFrame([(1, ["a", "b"], "a longer list", None), (2, None, " ", None), (3, ["x"], None, {"k": 1})], "id int, s array<string>, t string, u map<string,int>")
    got = {r["id"]: r["skills"] for r in resolved(df, [Claim("s", "skills"), Claim("t", "skills", 0.5), Claim("u", "skills", 0.5)], ["id"]).collect()}
    assert [(got[k]["value"], got[k]["reason"]) for k in (1, 2, 3)] == [("a, b", "kept_existing"), (None, "absent"), ('{"k":1}', "higher_quality")]
    assert resolved(df.limit(0), [Claim("s", "skills")], ["id"]).count() == 0


def test_no_shuffle_within_rows(spark):
    plan = resolved(spark.createDataFrame(rows(5), SCHEMA), CLAIMS, ["id"])._jdf.queryExecution().toString()
    assert "Exchange" not in plan
    assert resolved_rows(unpivoted(spark.createDataFrame([], SCHEMA), CLAIMS, ["id"]), ["id"]).filter(F.lit(True)).count() == 0


def test_claims_are_dealt_out_before_they_are_sorted(spark):
    hot = spark.range(4000, numPartitions=1).selectExpr("1 AS id", "'email' AS field", "'mail' AS source", "0 AS place", "concat('a', id, '@b.org') AS value", "10 AS quality", "true AS sure")
    found = resolved_rows(hot, ["id"])
    assert [(r.value, r.n_claims) for r in found.collect()] == [("a9@b.org", 4000)]
    assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString()
