"""Reports as ordered lines: the text, its parts on disk, and what the driver sees."""

import json
import random

import pytest
from pyspark.sql import functions as F

from linkweave.functions.scalar import strength_label
from linkweave.operators import linking, report
from linkweave.schemas import BOUNDARY, LEGACY, TABLES

RUN = {"run_id": "r1", "started_at": "then\nnow", "params_json": '{"a":1}'}


@pytest.fixture(scope="module")
def run(spark):
    dice, rows = random.Random(4), []
    for n in range(60):
        for _ in range(dice.randrange(1, 4)):
            rows.append((f"0x{n:040d}" if n % 7 else f'odd "{n}\\\n', dice.choice(["safe_owner", "funded_by", "ens_handle"]), f"key-of-some-length-{dice.randrange(30)}", dice.choice([2, 3]), f"s{dice.randrange(2)}", 0, None))
    rows += [(f"0x{n:040d}", "funded_by", "popular\nkey", 2, "s", 0, None) for n in range(55)]
    evidence = spark.createDataFrame(rows, TABLES["evidence"])
    members = linking.clusters(evidence.select("address").distinct(), evidence, LEGACY, 1)
    return evidence, members, linking.service_keys(evidence, LEGACY)


def _short(v):
    return f"{v[:6]}…{v[-4:]}" if len(v) >= 12 else v


def _quoted(v):
    return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def _dot(evidence, members, services):
    """The graph as one string, from collected rows."""
    edges = report.passing_edges(evidence, members)
    phrase = {r["cluster_id"]: r["descriptor"] for r in report.cluster_descriptors(members, edges).collect()}
    flat = lambda t: str(t).replace("\n", " ").replace("\r", " ")
    out = ["graph linkweave {", "  rankdir=LR;", "  node [shape=box];", *[f"  // {k}: {flat(v)}" for k, v in RUN.items()], f"  // {BOUNDARY}"]
    groups = {}
    for r in members.collect():
        groups.setdefault(r["cluster_id"], []).append(r["address"])
    for n, cluster in enumerate(sorted(groups)):
        own = sorted(groups[cluster])
        noun = "identifier" if len(own) == 1 else "identifiers"
        out += [f"  subgraph cluster_{n} {{", f"    label={_quoted(f'{phrase[cluster]} {_short(cluster)} ({len(own)} {noun})')};", *[f"    {_quoted(a)} [label={_quoted(_short(a))}];" for a in own], "  }"]
    for e in sorted(edges.withColumn("s", strength_label(F.col("strength"))).collect(), key=lambda e: (e["source"], e["target"], e["kind"])):
        label = f"{e['kind']} {e['s']}: " + ", ".join(map(_short, e["keys"]))
        out.append(f"  {_quoted(e['source'])} -- {_quoted(e['target'])} [label={_quoted(label)}];")
    out += [f"  // service key {flat(s['kind'])} {flat(s['key'])}: {s['fan_out']} rows" for s in sorted(services.collect(), key=lambda s: (-s["fan_out"], s["kind"], s["key"]))]
    return "\n".join([*out, "}", ""])


def _parts(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_dot_is_the_same_text_in_parts(spark, run, tmp_path):
    want = _dot(*run)
    assert "service key funded_by popular key" in want
    lines = report.dot_lines(RUN, *run)
    assert report.text_of(lines) == want == report.render_dot(RUN, *run)
    report.write_ordered(lines, f"{tmp_path}/dot")
    assert _parts(tmp_path / "dot") == want


def test_markdown_and_json(spark, run, tmp_path):
    evidence, members, services = run
    text = report.render_markdown(RUN, *run)
    sizes = sorted(((r["size"], r["cluster_id"]) for r in report.cluster_sizes(members).where("size > 1").collect()), key=lambda r: (-r[0], r[1]))
    heads = [line for line in text.split("\n") if line.startswith("### ")]
    assert [h.split("`")[1] for h in heads] == [_short(c) for _, c in sizes[:10]] and all(f"({n} identifiers)" in h for h, (n, _) in zip(heads, sizes, strict=False))
    first = text.split("### ")[1]
    own = sorted(r["address"] for r in members.where(F.col("cluster_id") == sizes[0][1]).collect())
    assert first.split("Members:\n")[1].startswith("\n".join(f"- `{a}`" for a in own))
    assert first.index("Evidence keys") < first.index("Members:") and "| `funded_by` | `popular\nkey` | 55 |" in text
    report.write_ordered(report.json_lines(RUN, members, services), f"{tmp_path}/json")
    found = json.loads(_parts(tmp_path / "json"))
    assert found["run"] == RUN and found["n_clusters"] == members.select("cluster_id").distinct().count() and found["service_keys"] == [{"kind": "funded_by", "key": "popular\nkey", "fan_out": 55}]


def test_nothing_to_report(spark, run):
    evidence, members, services = (df.where("false") for df in run)
    assert "_No cluster has more than one identifier._" in report.render_markdown(RUN, evidence, members, services)
    assert report.render_dot(RUN, evidence, members, services).endswith("}\n")
    assert json.loads(report.report_json(RUN, members, services))["service_keys"] == []


def test_numbers_over_ranges(spark):
    rows = spark.range(0, 5000, 1, 7).selectExpr("id % 5000 * 7919 % 100003 as k").repartition(11)
    got = report.numbered(rows, "k", "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(5000)) and [r["k"] for r in got] == sorted(r["k"] for r in got)
