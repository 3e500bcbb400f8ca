"""Scores of regions, by hand and without links of files that are summed or placed by a shuffle of their own."""

from codeloom import catalogue
from codeloom.operators import analytics as A

SF = "/root/testdata/sf0.001"


def test_scores_of_regions(spark):
    edges = spark.createDataFrame(
        [("m", "b", "CALLS"), ("a", "b", "IMPORTS"), ("b", "a", "REFERENCES"), ("a", "c", "IMPORTS"), ("c", "a", "CALLS"), ("m", "a", "CALLS"), ("a", "x", "CALLS"), ("x", "b", "CALLS"), ("b", "c", "CONTAINS")],
        "src string, dst string, predicate string",
    )
    file_of = spark.createDataFrame([(f, f) for f in "abcdx"] + [("m", "a")], "id string, file string")
    member = spark.createDataFrame([("a", "R"), ("b", "R"), ("c", "S"), ("d", "T")], "id string, region string")
    got = {r.region: (r.files, r.internal, r.external, r.boundary, r.cohesion, r.boundary_ratio, r.confidence, r.label) for r in A.region_scores(A.region_links(edges, file_of, member), member).collect()}
    assert got == {"R": (2, 6.0, 5.0, 1, 0.5455, 0.5, 0.2727, "Fuzzy"), "S": (1, 0.0, 5.0, 1, 0.0, 1.0, 0.0, "Fuzzy"), "T": (1, 0.0, 0.0, 0, 0.0, 0.0, 0.0, "Fuzzy")}


def test_links_of_files_are_not_shuffled(spark):
    """Where nothing is broadcast: edges are dealt by what they point to, then by where they start, then summed by file."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        plan = catalogue.QUERIES["region_scores"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "least(" not in plan and "greatest(" not in plan and plan.count("Generate explode") == 1
