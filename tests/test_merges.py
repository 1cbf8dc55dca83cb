import pytest

from trajectorium.operators import graph, merges

NODES = "video string, frame bigint, node bigint, area double, cx double, cy double, length double, normal boolean, edge boolean, roi_edge boolean, unknown boolean"


class Scene:
    """Blobs by name and frame; links by overlap."""

    def __init__(self, video):
        self.video, self.nodes, self.links, self.flags = video, {}, [], {}

    def blob(self, name, frames, area, x, y=0.0):
        for f in frames:
            self.nodes[name, f] = [float(area), float(x), float(y)]
        for f in frames[1:]:
            self.link(name, f - 1, name, f, area)

    def link(self, a, f, b, g, overlap):
        self.links.append(((a, f), (b, g), float(overlap)))

    def flag(self, name, frame, what):
        self.flags.setdefault((name, frame), set()).add(what)


def bystanders(scene, count=3, frames=12):
    """Animals that keep apart, so that there is a scale."""
    for k in range(count):
        scene.blob(f"z{k}", range(frames), 100, 1000 + 200 * k, 1000)


def meeting(scene, split=True):
    """a and b run alone for frames 0 to 3, are one blob m for 4 to 7 and part."""
    scene.blob("a", range(4), 100, 0)
    scene.blob("b", range(4), 110, 12)
    scene.blob("m", range(4, 8), 190, 6)
    scene.link("a", 3, "m", 4, 95)
    scene.link("b", 3, "m", 4, 100)
    if split:
        scene.blob("c", range(8, 12), 102, 0)
        scene.blob("d", range(8, 12), 108, 12)
        scene.link("m", 7, "c", 8, 90)
        scene.link("m", 7, "d", 8, 95)
    bystanders(scene)


def run(spark, *scenes, **options):
    ids, nodes, links = {}, [], []
    for s in scenes:
        for (name, f), (area, x, y) in s.nodes.items():
            ids[s.video, name, f] = len(ids) + 1
            own = s.flags.get((name, f), set())
            nodes.append((s.video, f, ids[s.video, name, f], area, x, y, 20.0, "outlier" not in own, "edge" in own, "roi" in own, "unknown" in own))
        links += [(ids[(s.video, *a)], ids[(s.video, *b)], o) for a, b, o in s.links]
    g = merges.graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(links, "src bigint, dst bigint, overlap double"), **options)
    found = merges.evidence(g)
    names = {i: k for k, i in ids.items()}
    level = {names[r["node"]]: (r["n_forward"], r["n_backward"], r["level"]) for r in merges.levels(g, found).collect()}
    rows = {names[r["chain"]]: r for r in merges.intervals(g, found).collect()}
    kinds = {names[r["chain"]]: (r["frame_start"], r["frame_end"], r["start_kind"], r["end_kind"]) for r in g.chains.collect()}
    return level, rows, kinds


@pytest.fixture(scope="module")
def scenes(spark):
    """One run over many videos, so that they are also told apart."""
    made = {}

    def scene(name):
        made[name] = Scene(name)
        return made[name]

    meeting(scene("meet"))
    meeting(scene("merge_only"), split=False)
    s = scene("edge")
    meeting(s)
    s.flag("m", 5, "edge")
    s = scene("roi")
    meeting(s, split=False)
    s.flag("m", 5, "roi")
    s = scene("doubtful")  # one of the arms never was a normal blob
    meeting(s, split=False)
    for f in range(4):
        s.flag("b", f, "unknown")
    s = scene("fragments")  # one animal breaks up and rejoins
    s.blob("w", range(4), 200, 0)
    s.blob("p", range(4, 7), 110, -5)
    s.blob("q", range(4, 7), 90, 5)
    s.blob("v", range(7, 12), 200, 0)
    for a, f, b, g, o in (("w", 3, "p", 4, 100), ("w", 3, "q", 4, 80), ("p", 6, "v", 7, 100), ("q", 6, "v", 7, 80)):
        s.link(a, f, b, g, o)
    bystanders(s)
    s = scene("shared")  # three meet; a pair and a single part
    for k, x in enumerate((0, 12, 24)):
        s.blob(f"a{k}", range(4), 100, x)
        s.link(f"a{k}", 3, "m", 4, 95)
    s.blob("m", range(4, 7), 300, 12)
    s.blob("pair", range(7, 12), 200, 6)
    s.blob("one", range(7, 12), 100, 24)
    s.link("m", 6, "pair", 7, 190)
    s.link("m", 6, "one", 7, 95)
    bystanders(s)
    s = scene("crossing")  # two meet and part at once: each is matched to itself by its size
    s.blob("a", range(4), 100, 0)
    s.blob("b", range(4), 160, 30)
    s.blob("m", range(4, 5), 250, 15)
    s.blob("c", range(5, 12), 160, 31)
    s.blob("d", range(5, 12), 100, 1)
    for a, f, b, g, o in (("a", 3, "m", 4, 95), ("b", 3, "m", 4, 150), ("m", 4, "c", 5, 150), ("m", 4, "d", 5, 95)):
        s.link(a, f, b, g, o)
    bystanders(s)
    s = scene("leaves")  # the merged blob loses half its area just as a new blob begins beside it
    meeting(s, split=False)
    s.blob("rest", range(8, 12), 100, 6)
    s.link("m", 7, "rest", 8, 100)
    s.blob("gone", range(8, 12), 90, 40)
    level, rows, kinds = run(spark, *made.values())
    pick = lambda table, v: {k[1:]: x for k, x in table.items() if k[0] == v}
    return lambda v: (pick(level, v), pick(rows, v), pick(kinds, v))


def test_two_that_meet_and_part(scenes):
    level, rows, kinds = scenes("meet")
    assert level == {("m", f): (2, 2, merges.HIGH) for f in range(4, 8)}
    assert kinds["m", 4] == (4, 7, "merge", "split")
    assert kinds["a", 0] == (0, 3, "scan_start", "merge") and kinds["c", 8] == (8, 11, "split", "scan_end")
    row = rows["m", 4]
    assert (row["confidence"], row["high_blobs"], row["first_flagged_frame"], row["excluded_blobs"], row["reliable"]) == ("high", 4, 4, 0, False)
    assert "forward merge@4 n=2 source=independent" in row["reasons"] and "backward split@7 n=2 source=independent" in row["reasons"]


def test_one_direction(scenes):
    level, rows, kinds = scenes("merge_only")
    assert level == {("m", f): (2, 1, merges.MEDIUM) for f in range(4, 8)}
    assert kinds["m", 4][3] == "death" and rows["m", 4]["confidence"] == "medium"


def test_edges_reset_counts(scenes):
    level, rows, kinds = scenes("edge")
    # forward evidence ends at frame 4, backward evidence begins after frame 5
    assert level == {("m", 4): (2, 1, merges.MEDIUM), ("m", 6): (1, 2, merges.MEDIUM), ("m", 7): (1, 2, merges.MEDIUM)}
    assert kinds["m", 5] == (5, 5, "reset", "reset")
    level, _, _ = scenes("roi")
    assert level == {("m", f): (2, 1, merges.MEDIUM if f < 5 else merges.UNCERTAIN) for f in range(4, 8)}


def test_arms_must_be_sure(scenes):
    level, rows, _ = scenes("doubtful")
    assert not level and "arms_not_confirmed" in rows["m", 4]["reasons"]


def test_fragments_of_one_count_once(scenes):
    level, rows, _ = scenes("fragments")
    # p and q come from one split: they aren't two animals when they rejoin; backward likewise
    assert not level
    assert "forward merge@7 n=1 source=none" in rows["v", 7]["reasons"]


def test_shares_by_mass(scenes):
    level, rows, _ = scenes("shared")
    assert {level["m", f][0] for f in range(4, 7)} == {3}
    assert {level["pair", f][0] for f in range(7, 12)} == {2}
    assert ("one", 7) not in level
    assert "split_share@7 n=2 source=mass_share" in rows["pair", 7]["reasons"]


def test_matched_through_a_contact(scenes):
    level, _, _ = scenes("crossing")
    assert level == {("m", 4): (2, 2, merges.HIGH)}


def test_a_way_to_leave(scenes):
    level, rows, _ = scenes("leaves")
    assert {k for k in level if level[k][0] > 1} == {("m", f) for f in range(4, 8)}
    assert any("forward_stop:" in r["reasons"] for r in rows.values())


def test_cliques():
    one = [frozenset([k]) for k in range(8)]
    every = {(i, j): True for i in range(8) for j in range(i + 1, 8)}
    assert merges.best_clique(one, every) == list(range(8))
    assert merges.best_clique(one + [frozenset([9])], every) == [] and merges.best_clique(one[:1], {}) == []
    some = {p: p in {(0, 1), (1, 2), (0, 2), (3, 4)} for p in every}
    assert merges.best_clique(one, some) == [0, 1, 2]
    assert merges.best_clique([frozenset([5]), frozenset([1, 2]), frozenset([3])], {(0, 1): True, (0, 2): True, (1, 2): False}) == [0, 1]


def test_graph_helpers(spark):
    from trajectorium.operators import graph

    path = [(k, k + 1) for k in range(1, 40)] + [(50, 51), (60, 60)]
    links = spark.createDataFrame(path, "a bigint, b bigint")
    wanted = {**{k: 1 for k in range(1, 41)}, 50: 50, 51: 50}
    assert {r["node"]: r["component"] for r in graph.components(links).collect()} == wanted | {60: 60}
    assert {r["node"]: r["chain"] for r in graph.chains(links.where("a <> b")).collect()} == wanted
    assert graph.components(links.limit(0)).count() == graph.chains(links.limit(0)).count() == 0


def test_graph_tables_stay_off_the_driver(spark):
    """Failed before: tables of a few MB in files, many times that in memory, were sent whole through the driver for joins."""
    links = [(10 * k, 10 * k + 1) for k in range(40)]
    parts = graph.components(spark.createDataFrame(links, "a bigint, b bigint"))
    kept = parts.where("component < 200").groupBy("component").count().withColumnRenamed("component", "node")
    plan = parts.join(kept, "node")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
