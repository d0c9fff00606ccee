from citeframe.operators import proposals as pr


def test_values_of_odd_proposals(spark):
    texts = [
        '{"noi":1,"units":"n/a","deal_name":" x ","market":null,"other":3}', '{"noi":"12","submarket":"N/A.","address":7}',
        "[1]", "bad{", None, "{}", '{"noi":true,"evidence":[]}',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, p string")
    values = pr.proposal_values(df, "p", ["id"])
    assert sorted(map(tuple, values.collect()), key=str) == sorted([
        (0, "noi", 1.0, None, True), (0, "units", None, None, True), (0, "deal_name", None, "x", True), (0, "market", None, None, True),
        (1, "noi", None, None, True), (1, "submarket", None, None, True), (1, "address", None, None, True), (6, "noi", None, None, True),
    ], key=str)
    # The fields are rows when they are read: the plan names each type test once, not once per field.
    plan = values._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("schema_of_variant(") <= 4
