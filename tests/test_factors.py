from explainkit.catalog import modelling
from explainkit.operators import factors


def test_every_training_user_is_ranked(spark):
    d = "/root/testdata/sf0.01"
    want = {r["user_id"] for r in modelling.train(spark, d).select("user_id").distinct().collect()}
    found = modelling.QUERIES["bperj_topk"][0](spark, d).collect()
    assert {r["user_id"] for r in found} == want and len(found) == 10 * len(want)


def test_blocks_learn_what_users_like(spark):
    rows = [(n, n % 200, n % 7, [n % 200 % 2]) for n in range(4000)]
    table = spark.createDataFrame(rows, "interaction_id long, user_id long, item_id long, statement_ids array<long>")
    users, statements, _ = factors.user_factors(table, 20, dim=8, rate=0.05, epochs=2, block=1000)
    first = {r["user_id"]: r["sid"] for r in factors.best_statements(users, statements, 2).collect() if r["rank"] <= 2 and r["sid"] < 2}
    assert len(first) == 200
