import json

import pytest
from pyspark.sql import functions as F

from strataq.operators import nested


def brute(analyses, reports):
    """The same positions by plain loops over Python objects."""
    out = []
    listed = lambda x: x if isinstance(x, list) else ([] if x is None else [x])
    for a in analyses:
        for i, u in enumerate(a["crypto"] or []):
            if u is None:
                continue
            out.append(("usage", a["analysis_id"], i, -1, -1))
            out += [("call_step", a["analysis_id"], i, j, -1) for j, s in enumerate(u["call_path"] or []) if s is not None]
            for j, t in enumerate(u["traces"] or []):
                out += [("trace_step", a["analysis_id"], i, j, k) for k, s in enumerate((t or {}).get("call_steps") or []) if s is not None]
    for r in reports:
        try:
            v = r["payload"]
            while isinstance(v, str):
                v = json.loads(v.lstrip("﻿"))
        except ValueError:
            continue
        if not isinstance(v, dict):
            continue
        n = r["report_id"]
        for i, run in enumerate(listed(v.get("runs"))):
            if run is None:
                continue
            rules = listed(((run.get("tool") or {}).get("driver") or {}).get("rules"))
            ids = [q and q.get("id") for q in rules]
            out += [("sarif_rule", n, i, j, -1) for j, q in enumerate(rules) if q is not None]
            for j, q in enumerate(listed(run.get("results"))):
                if q is None:
                    continue
                rid = q.get("ruleId")
                out.append(("sarif_result", n, i, j, ids.index(rid) if rid is not None and rid in ids else -1))
                out += [("sarif_location", n, i, j, k) for k, x in enumerate(listed(q.get("locations"))) if x is not None]
        for i, c in enumerate(listed(v.get("components"))):
            functions = listed((((c or {}).get("cryptoProperties") or {}).get("algorithmProperties") or {}).get("cryptoFunctions"))
            out += [("cbom_function", n, i, j, -1) for j, x in enumerate(functions) if x is not None]
    return sorted(out)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_positions_equal_plain_loops(spark, sf):
    a, r = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("package_analysis", "report_document"))
    want = brute([x.asDict(True) for x in a.collect()], [x.asDict() for x in r.collect()])
    got = sorted(map(tuple, nested.flat_positions(a, r).collect()))
    assert got == want


REPORTS = "report_id bigint, report_format string, payload string"


def test_unreadable_and_wrapped_payloads(spark):
    doc = json.dumps({"runs": {"tool": {"driver": {"rules": [None, {"id": "A"}]}}, "results": [{"ruleId": "A", "locations": {"x": 1}}, None, {"ruleId": "B"}], "properties": {"results": [1]}}})
    rows = [(1, None, doc), (2, "x", "﻿\n" + json.dumps(doc)), (3, "x", doc[:-1]), (4, "x", "null"), (5, "x", ""), (6, "x", None), (7, "x", doc + "}"), (8, "x", "[]"), (9, "x", doc + " {}")]
    a = spark.createDataFrame([], "analysis_id bigint, crypto array<struct<call_path: array<string>, traces: array<struct<call_steps: array<string>>>>>")
    got = sorted(map(tuple, nested.flat_positions(a, spark.createDataFrame(rows, REPORTS)).collect()))
    want = [(k, n, *p) for n in (1, 2) for k, p in (("sarif_rule", (0, 1, -1)), ("sarif_result", (0, 0, 1)), ("sarif_result", (0, 2, -1)), ("sarif_location", (0, 0, 0)))]
    assert got == sorted(want)


def test_equal_objects_are_one_node_and_differences_count(spark):
    u = ("a", ["s", None], [("e", ["x", "y"])])
    same_but_null = ("a", ["s"], [("e", ["x", "y"])])
    schema = "analysis_id bigint, crypto array<struct<func_name: string, call_path: array<string>, traces: array<struct<entry_point: string, call_steps: array<string>>>>>"
    df = spark.createDataFrame([(1, [u, None, u]), (2, [u, same_but_null]), (3, None), (4, [])], schema)
    forest = nested.flatten(df, "analysis_id", nested.USAGE_EDGES)
    assert forest.nodes.where("kind = 'usage'").count() == 2
    assert forest.nodes.where("kind = 'trace'").count() == 1
    assert sorted((r.record_id, r.ordinal) for r in forest.roots.collect()) == [(1, 0), (1, 2), (2, 0), (2, 1)]
    assert nested.walk(forest, "usage", "trace", "step").count() == 8
    assert forest.bridges.where("edge = 'call_step'").select(F.count("*")).first()[0] == 2


def test_payloads_wrapped_many_times(spark):
    doc = json.dumps({"runs": {"tool": {"driver": {"rules": [{"id": "A"}]}}}})
    rows, text = [], doc
    for n in range(11):
        rows.append((n, None, "\n" + text + " "))
        text = json.dumps(text)
    rows.append((99, None, text + text))
    a = spark.createDataFrame([], "analysis_id bigint, crypto array<struct<call_path: array<string>, traces: array<struct<call_steps: array<string>>>>>")
    got = sorted(map(tuple, nested.flat_positions(a, spark.createDataFrame(rows, REPORTS)).collect()))
    assert got == [("sarif_rule", n, 0, 0, -1) for n in range(11)]


def test_runs_that_differ_outside_their_lists(spark):
    """Two runs with equal rules and results are two objects if their tools differ."""
    run = lambda name: {"tool": {"driver": {"name": name, "rules": [{"id": "r"}]}}, "results": [{"ruleId": "r", "locations": [{"x": 1}]}]}
    rows = [(1, json.dumps({"runs": [run("a"), run("b"), run("a")]})), (2, json.dumps({"runs": [run("b")]}))]
    forest = nested.report_forest(spark.createDataFrame(rows, "report_id bigint, payload string"))
    kinds = [r.kind for r in forest.nodes.collect()]
    assert {k: kinds.count(k) for k in set(kinds)} == {"run": 2, "rule": 1, "result": 1, "location": 1}
    body = [json.loads(r.content)["body"] for r in forest.nodes.where("kind = 'run'").collect()]
    assert sorted(json.loads(b[-1])["name"] for b in body) == ["a", "b"]
