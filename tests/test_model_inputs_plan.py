from quern.sources import folds


def test_files_of_a_fold_come_together_once(spark):
    names = ["f/x_model_0.cif", "f/x_full_data_0.json", "f/x_job_request.json", "f/x_model_+1.cif", "f/_model_2.cif", "f/notes.txt"]
    found = spark.createDataFrame([(n, b'{"modelSeeds": [7]}') for n in names], "locator string, content binary")
    t = folds.model_inputs(found)
    plan = t._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    got = {(r.source, r.model, r.cif, r.data, r.seed, r.problem) for r in t.collect()}
    assert got == {("f", 0, names[0], names[1], 7, None), ("f", 2, names[4], None, None, "data")}
