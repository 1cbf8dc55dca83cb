from trajectorium import catalog
from trajectorium.plans.views import obs

SF = "/root/testdata/sf0.01"


def test_all_ids_are_resolved(spark):
    found = catalog.queries()["c02_resolved_tracks"](spark, SF).select("tid", "frame").collect()
    wanted = obs(spark, SF).select("tid", "frame").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, wanted))
    decided = catalog.queries()["c04_guarded_decisions"](spark, SF).select("video").distinct().collect()
    assert len(decided) == len({r["tid"] // 10 for r in wanted})


def test_matchings_of_all_rosters(spark):
    found = catalog.queries()["j25_unique_matchings"](spark, SF).collect()
    at = {r["event_id"]: (r["tid"] // 4, r["frame"]) for r in obs(spark, SF).select("event_id", "tid", "frame").collect()}
    assert {r["roster"] for r in found} == {x for x, _ in at.values()}
    assert all(at[r["source"]] == (r["roster"], r["frame"]) and at[r["target"]] == (r["roster"], r["frame"] + 1) for r in found)
