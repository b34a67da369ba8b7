"""The agent's survey and node look-up: ways of naming a node, caps, ties, nulls, empty graphs."""

from lattica.operators import agent

NODE = "id string, type string, label string, summary string"
EDGE = "src string, dst string, weight long"


def test_explored_resolves_in_order_and_caps(spark):
    nodes = [("a", "tag", "Alpha", None), ("b", "tag", "alpha beta", None), ("c", "tag", "Same", None), ("d", "tag", "same", None), ("e", "tag", None, None)]
    nodes += [(f"m{i:02}", "note", "Many", None) for i in range(12)]
    edges = [("a", f"m{i:02}", i % 3) for i in range(12)] + [("m00", "gone", 9), ("b", "a", 50)]
    edges += [("b", f"x{i:02}", 1) for i in range(20)]
    refs = [("a",), (" ALPHA ",), ("beta",), ("same",), ("many",), ("",), (None,), ("none such",), ("e",)]
    got = agent.explored(spark.createDataFrame(refs, "ref string"), spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)).collect()
    heads = {}
    for r in got:
        if r.kind != "connection":
            heads.setdefault(r.ref, []).append((r.kind, r.id))
    assert {k: sorted(v) for k, v in heads.items()} == {
        "a": [("node", "a")], "ALPHA": [("node", "a")], "beta": [("node", "b")], "e": [("node", "e")],
        "same": [("candidate", "c"), ("candidate", "d")], "many": [("candidate", f"m{i:02}") for i in range(8)],
    }
    near = {k: sorted((r.position, r.id, r.weight) for r in got if r.kind == "connection" and r.ref == k) for k in ("a", "beta")}
    order = sorted([(-(i % 3), f"m{i:02}") for i in range(12)] + [(-50, "b")])
    assert near["a"] == [(p, i, -w) for p, (w, i) in enumerate(order, 1)]
    assert near["beta"] == [(1, "a", 50)] + [(p + 2, f"x{p:02}", 1) for p in range(14)]
    assert agent.explored(spark.createDataFrame([], "ref string"), spark.createDataFrame(nodes, NODE), spark.createDataFrame([], EDGE)).count() == 0


def test_overview_counts_and_top_tags(spark):
    nodes = [("r", "region", "Home", "  one\ntwo " + "x" * 300), ("q", "region", None, None)] + [(f"t{i}", "tag", f"T{i}", None) for i in range(4)]
    got = agent.overview(spark.createDataFrame(nodes, NODE), spark.createDataFrame([("t1", "t2", 5), ("t3", "t1", 2)], EDGE), top=3).collect()
    assert {(r.section, r.key, r.n) for r in got if r.section in ("type", "edges")} == {("type", "region", 2), ("type", "tag", 4), ("edges", "edges", 2)}
    assert {r.key: r.text for r in got if r.section == "region"} == {"r": "Home: " + ("one two " + "x" * 300)[:200], "q": ": "}
    assert sorted((r.key, r.n) for r in got if r.section == "tag") == [("t1", 7), ("t2", 5), ("t3", 2)]
    empty = agent.overview(spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE)).collect()
    assert [(r.section, r.n) for r in empty] == [("edges", 0)]
