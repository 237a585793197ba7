import pytest

from tesserapy.operators import catalog


@pytest.fixture()
def samples(spark):
    rows = [(0, 1, "a", [0, 1, 2, 0]), (1, 2, "a", [2, 1, 0, 2]), (2, 3, "b", [0, 0, 0, 0]), (3, 4, "b", [0, -1, 1, 0])]
    return spark.createDataFrame(rows, "plan_id long, step long, sample_tag string, plan_vector array<int>")


def test_catalog_orders_by_appearance_and_keeps_empty_districts(spark, samples):
    expanded = catalog.expand_samples(samples, 3)
    districts = catalog.district_catalog(expanded)
    got = {r["district_str"]: r["district_uid"] for r in districts.collect()}
    assert got == {"0.3": 0, "1": 1, "2": 2, "0.1.2.3": 3, "": 4}
    plans = catalog.summarize_plans(catalog.attach_district_ids(expanded, districts))
    rows = {r["plan_id"]: (r["plan"], r["plan_str"]) for r in plans.collect()}
    assert rows[0] == ([0, 1, 2], "0.1.2") and rows[1] == ([2, 1, 0], "0.1.2") and rows[2] == ([3, 4, 4], "3.4.4")
    dist = {(r["sample_tag"], r["plan_str"]): (r["count"], r["freq"], r["plan_uid"]) for r in catalog.distributions(plans).collect()}
    assert dist[("a", "0.1.2")] == (2, 1.0, 0) and dist[("b", "3.4.4")][1] == 0.5
    assert catalog.num_districts_of(plans) == 3
    assert catalog.encode_district(districts, [3, 0]) == 0
    with pytest.raises(KeyError):
        catalog.encode_district(districts, [1, 2])


def test_decode_takes_the_later_district_and_zero_where_uncovered(spark):
    districts = spark.createDataFrame([(0, [0, 1]), (1, [1, 2])], "district_uid long, members array<int>")
    plans = spark.createDataFrame([(7, [0, 1])], "plan_uid long, plan_vector array<bigint>")
    got = {r["precinct"]: r["district_id"] for r in catalog.decode_plans(plans, districts, 4).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0}
