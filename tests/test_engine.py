"""Tiny graphs and files with results known by hand."""

import json

import pytest
from pyspark.sql import functions as F

from codeloom import ids
from codeloom.functions import text as X
from codeloom.operators import analytics as A
from codeloom.operators import context as C
from codeloom.operators import indexes as I
from codeloom.operators import patches as P
from codeloom.operators import resolve as R
from codeloom.operators import revisions as V
from codeloom.operators import traverse as W
from codeloom.sources import extract as E
from codeloom.sources import files as S
from codeloom.streaming import watch


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_ids(spark):
    import hashlib

    h = hashlib.sha256(b"ws:a/b.ts:C.m").hexdigest()
    want = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"
    assert one(spark, ids.node_id(F.lit("ws"), F.lit("A\\b.ts"), ids.qualified_key(F.lit("C"), F.lit("m")))) == want
    assert one(spark, ids.stable_id(F.lit("repo:/x"))) == hashlib.sha256(b"repo:/x").hexdigest()[:8]


def test_text(spark):
    assert one(spark, X.normalize_path(F.lit("a/./b/../c"))) == "a/c"
    assert one(spark, X.camel_to_snake(F.lit("parseHTTPHeader"))) == "parse_http_header"
    assert one(spark, X.tokens(F.lit("registerApi_x"))) == ["register", "api", "x"]
    assert one(spark, X.js_round(F.lit(-0.5))) == 0
    assert one(spark, X.llm_line("n", a=F.lit("x y"), b=F.lit(None).cast("string"), c=F.lit(1))) == 'n a="x y" c=1'


EDGES = [("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "a", "CALLS"), ("a", "d", "IMPORTS"), ("d", "c", "CONTAINS")]


def test_traversal(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string, predicate string")
    seed = spark.createDataFrame([("a",)], "id string")
    assert rows(W.closure(edges, seed, "out", ["CALLS"], 5), "id", "depth") == [("a", 0), ("b", 1), ("c", 2)]
    assert W.shortest_path(edges, "a", "c", None, 4).first().path in (["a", "c"], ["a", "c"])
    assert W.shortest_path(edges, "a", "zz", None, 4).count() == 0
    t = W.tree(edges, "a", ["CALLS", "IMPORTS", "CONTAINS"], "out", 3)
    assert [c["id"] for c in t["children"]] == ["b", "d"]
    assert t["children"][0]["children"][0]["children"][0] == {"id": "a", "predicate": "CALLS", "cycle": True, "children": []}
    assert t["children"][1]["children"][0]["cycle"]


def test_communities(spark):
    links = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "xy" for i in range(4) for j in range(i)] + [("x0", "y0", 0.1)]
    got = {r.id: r.community for r in A.communities(spark.createDataFrame([tuple(sorted(e[:2])) + e[2:] for e in links], "a string, b string, weight double")).collect()}
    assert len({got[f"x{i}"] for i in range(4)}) == len({got[f"y{i}"] for i in range(4)}) == 1 and got["x0"] != got["y0"]


def test_roles_and_risk(spark):
    facts = spark.createDataFrame([("registerApi", "function", "src/cli/main.ts", 3, 1, 0), ("UserModel", "class", "src/m.ts", 1, 0, 0), ("x", "function", "pkg/tests/x.ts", 0, 1, 0), ("run", "function", "a.go", 0, 2, 0)], "name string, kind string, path string, callers int, callees int, members int")
    facts = facts.withColumns({c: F.lit(0) for c in ("importers", "dependents", "member_callers", "buckets")}).withColumns({c: F.lit("") for c in ("container_name", "container_kind")})
    assert rows(A.infer_role(facts), "name", "inferred_role") == [("UserModel", "data-model"), ("registerApi", "registration-function"), ("run", "entry-point"), ("x", "test")]
    assert dict(rows(A.risk(facts), "name", "risk_level"))["UserModel"] == "low"


def test_file_roles_and_languages(spark):
    paths = ["pkg/tests/a.py", "tests/x.ts", "src/a.spec.ts", "x/vendor/y.go", "Makefile", "a/gen/x.ts", "src/a.ts", "a\\.github\\x.yml"]
    got = spark.createDataFrame([(p,) for p in paths], "path string").select("path", S.file_role(F.col("path")).alias("r"), S.language(F.col("path")).alias("l"))
    assert {r.path: r.r.role for r in got.collect()} == dict(zip(paths, ["test", "production", "test", "external", "tooling", "generated", "production", "tooling"], strict=True))
    assert {r.path: r.l for r in got.collect()}["Makefile"] == "makefile"


def test_revisions(spark):
    log = spark.createDataFrame([("a", 1, "UpsertNode", 1.0), ("b", 2, "UpsertNode", 2.0), ("a", 3, "DeleteNode", None), ("b", 4, "UpsertNode", 5.0)], "id string, rev long, op string, value double")
    assert rows(V.snapshot(log, 3), "id", "value") == [("b", 2.0)]
    assert rows(V.as_of(V.intervals(log), 2), "id") == [("a",), ("b",)]
    assert rows(V.diff(V.snapshot(log, 2), V.snapshot(log, 4)), "id", "change") == [("a", "removed"), ("b", "modified")]
    patches = spark.createDataFrame([("p1", 1, "x"), ("p2", 2, "y"), ("p1", 3, "z")], "patch_id string, seq long, payload string")
    empty = spark.createDataFrame([], "patch_id string, seq long, payload string, rev long")
    status, after = V.commit(empty, patches, 0)
    assert status == "Ok" and rows(after, "patch_id", "payload", "rev") == [("p1", "x", 1), ("p2", "y", 2)]
    assert V.commit(after, patches)[0] == "Idempotent" and V.commit(after, patches, 9)[0] == "BaseRevMismatch"
    old, new = (spark.createDataFrame([("k", t)], "key string, text string") for t in ("a\nb", "a\nc\nd"))
    assert sorted(r.line for r in V.line_diff(old, new).collect()) == [1, 2]


def test_build_patch(spark):
    files = spark.createDataFrame([("ws", "a.ts", "h")], "ws string, path string, source_hash string")
    entities = spark.createDataFrame([("a.ts", 1, "f", "function", None), ("a.ts", 2, "f", "function", None)], "path string, seq long, name string, kind string, container string")
    rels = spark.createDataFrame([("a.ts", 1, "f", "g", "CALLS"), ("a.ts", 2, "f", "g", "CALLS"), ("a.ts", 3, "f", "lib::h", "CALLS")], "path string, seq long, src string, dst string, predicate string")
    chunks = spark.createDataFrame([("a.ts", 1, "f", "function", None, 1), ("a.ts", 2, None, "file_body", None, 5)], "path string, seq long, name string, kind string, container string, line_start int")
    ops = P.build_patch(files, entities, rels, chunks).orderBy("op_seq").collect()
    assert [r.op_type for r in ops] == ["UpsertNode", "UpsertNode", "UpsertEdge", "UpsertEdge", "UpsertNode", "UpsertEdge", "UpsertEdge", "UpsertEdge", "UpsertNode", "UpsertEdge", "AssertClaim", "AssertClaim"]
    assert [r.predicate for r in ops if r.predicate] == ["CONTAINS_CHUNK", "DEFINES", "CONTAINS_CHUNK", "NEXT", "CALLS", "CALLS"]
    assert [(r.name, r.field) for r in ops if r.field == "external"] == [("h", "external")] and [r.field for r in ops if r.op_type == "AssertClaim"] == ["calls:g", "calls:lib::h"]


def test_reconcile_and_retry(spark):
    row = lambda op, id_, seq, pred=None: ("a.ts", seq, op, id_, None, None, None, None, pred, None, None)
    schema = "path string, op_seq long, op_type string, id string, kind string, name string, src string, dst string, predicate string, field string, value string"
    current = spark.createDataFrame([row("UpsertNode", "n1", 1), row("UpsertEdge", "e1", 2), row("AssertClaim", "n1", 3)], schema)
    previous = spark.createDataFrame([("a.ts", "n1", "function"), ("a.ts", "n2", "function"), ("a.ts", "c1", "chunk")], "path string, id string, kind string")
    edges = spark.createDataFrame([("e1", "n1", "n2", "CALLS", "a.ts"), ("e2", "n2", "n9", "CALLS", "b.ts"), ("e3", "c1", "n1", "NEXT", "a.ts")], "edge_id string, src string, dst string, predicate string, path string")
    ops, dependents = P.reconciled(current, previous, edges, map_mode=True)
    assert [(r.op_type, r.id) for r in ops.orderBy("op_seq").collect()] == [("DeleteNode", "n2"), ("UpsertNode", "n1"), ("DeleteEdge", "e2"), ("UpsertEdge", "e1"), ("AssertClaim", "n1")]
    assert rows(dependents, "dependent") == [("b.ts",)]
    tries = []
    assert P.with_retry(lambda: tries.append(1) or (1 / (len(tries) - 3) if len(tries) < 3 else "done"), wait=lambda k: None) in ("done", -0.5)
    clash = spark.createDataFrame([("a.ts", 1, "e", "x", "y", "CALLS", "1"), ("a.ts", 2, "e", "x", "z", "CALLS", "2")], "path string, op_seq long, id string, src string, dst string, predicate string, attrs string")
    with pytest.raises(Exception, match="different ends"):
        P.dedupe_edges(clash).collect()


def test_numbered(spark):
    """One numbering over many ranges, whatever adaptive execution makes of them."""
    n = 300_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.rand(1).alias("x"))
    got = V.numbered(df, "k", "rev", 10).agg(F.min("rev"), F.max("rev"), F.count_distinct("rev"), F.count_if(F.col("rev") != F.col("k") + 11)).first()
    assert tuple(got) == (11, n + 10, n, 0)


def test_cascade(spark):
    files = spark.createDataFrame([(f"{n}.ts", "typescript", None) for n in "abcd"] + [("s.scala", "scala", None)], "path string, language string, repo string")
    entities = spark.createDataFrame([("b.ts", "run", None), ("c.ts", "deep", None), ("s.scala", "only", None), ("d.ts", "m", "K"), ("a.ts", "own", None)], "path string, name string, container string").withColumns({"seq": F.lit(0), "start": F.lit(1), "end": F.lit(2)})
    rels = spark.createDataFrame([(1, "a.ts", "run2", "CALLS"), (2, "a.ts", "deep", "CALLS"), (3, "a.ts", "only", "CALLS"), (4, "a.ts", "K.m", "CALLS"), (5, "a.ts", "own", "CALLS"), (6, "a.ts", "run", "CALLS")], "id long, path string, name string, predicate string").withColumns({"src": F.lit("f"), "bound": F.lit(None).cast("boolean")})
    imports = spark.createDataFrame([("a.ts", "b.ts"), ("b.ts", "c.ts")], "path string, target string")
    got = {r.id: (r.tier, r.verdict, r.target) for r in R.cascade(files, entities, rels, imports).collect()}
    assert got == {2: ("2.5-transitive", "emit", "c.ts"), 4: ("1b-qualifier", "emit", "d.ts"), 5: ("1-same-file", "stop", None), 6: ("2-import", "emit", "b.ts")}


def test_imports_and_indexes(spark):
    files = spark.createDataFrame([("src/b/index.ts", "typescript", "r"), ("src/b.ts", "typescript", "r"), ("src/a/x.ts", "typescript", "r"), ("lib/index.ts", "typescript", "q")], "path string, language string, repo string")
    index = I.build(files)
    imports = spark.createDataFrame([(1, "../b"), (2, "react"), (3, "./no"), (4, "@q/pkg")], "id long, raw string").withColumns({"path": F.lit("src/a/x.ts"), "language": F.lit("typescript")}).withColumn("module", I.captured_import(F.col("raw"), F.col("language")))
    assert {r.id: r.target for r in I.relative_files(imports, index).collect()} == {1: "src/b.ts", 3: None}
    packages = spark.createDataFrame([("@q/pkg", "q")], "key string, repo string")
    assert {r.id: (r.target, r.how) for r in R.import_edges(imports, files, index, None, packages).collect()} == {1: ("src/b.ts", "file"), 4: ("lib/index.ts", "package")}
    mapped = S.path_mappings(spark.createDataFrame([("tsconfig.json", '{ // base\n "compilerOptions": {"baseUrl": ".", "paths": {"@q/*": ["lib/*", "src/*"],}}}')], "path string, content string"))
    asked = spark.createDataFrame([(1, "@q/b"), (2, "@q/none"), (3, "src/b"), (4, "react")], "id long, raw string").withColumns({"path": F.lit("src/a/x.ts"), "language": F.lit("typescript")})
    assert {r.id: r.target for r in S.configured_targets(asked, mapped, index).collect()} == {1: "src/b.ts", 2: None, 3: "src/b.ts"}
    assert rows(I.suffix_index(spark.createDataFrame([("com/acme/X.java",)], "path string")), "suffix") == [("acme",), ("com.acme",)]
    reg = S.package_registry(spark.createDataFrame([("r1", "@acme/core-lib"), ("r2", "@other/core-lib"), ("r3", "solo")], "repo string, name string"))
    # A name with underscores for its hyphens is a key as well where one repository has it.
    assert rows(reg, "key", "repo") == [("@acme/core-lib", "r1"), ("@acme/core_lib", "r1"), ("@other/core-lib", "r2"), ("@other/core_lib", "r2"), ("solo", "r3")]
    deps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert R.repo_closure(deps).count() == 9


def test_manifests(spark):
    rows_ = [
        ("r1", "r1/package.json", '{"name": "@acme/a", "dependencies": {"left": "1"}, "devDependencies": {"jest": "1"}}'), ("r2", "r2/Cargo.toml", '[package]\nname = "crab"\n[dependencies]\nserde = "1"\n[dev-dependencies]\ncriterion = "1"\n'),
        ("r3", "r3/go.mod", "module github.com/x/y\nrequire (\n  github.com/a/b v1.0.0\n)\n"), ("r4", "r4/pom.xml", "<project><parent><artifactId>up</artifactId></parent><artifactId>own</artifactId><dependencies><dependency><artifactId>dep</artifactId></dependency></dependencies></project>"),
    ]
    m = spark.createDataFrame(rows_, "repo string, path string, content string")
    assert rows(S.package_names(m), "repo", "name") == [("r1", "@acme/a"), ("r2", "crab"), ("r3", "github.com/x/y"), ("r4", "own")]
    assert rows(S.package_deps(m), "repo", "name") == [("r1", "left"), ("r2", "serde"), ("r3", "github.com/a/b"), ("r4", "dep")]
    files = spark.createDataFrame([("/w", "a/package.json"), ("/w", "b/go.mod"), ("/w", "c/x.py"), ("/m", ".git/HEAD"), ("/m", "a/package.json"), ("/m", "b/go.mod")], "root string, path string")
    assert rows(S.systems(files), "root", "member") == [("/w", "a"), ("/w", "b")]


def test_sources(spark):
    assert S.languages(" TS, c++,go ,") == ["typescript", "cpp", "go"]
    paths = spark.createDataFrame([("/r/a/../x.ts", 1), ("/r/x.ts", 2), ("/rest/y.ts", 3), ("/r/X.ts", 4)], "path string, seq long")
    inside, outside = S.confined(paths, "/r/")
    assert rows(inside, "path") == [("/r/X.ts",), ("/r/x.ts",)] and outside.first()[0] == 1
    listed = S.listed(spark.createDataFrame([("tests/a.py", 0), ("b.pb.go", 1)], "path string, seq long"), spark.createDataFrame([("tests/a.py", 0), ("c.rs", 1), ("d.bin", 2)], "path string, seq long"))
    assert rows(listed, "path", "language") == [("c.rs", "rust"), ("tests/a.py", "python")]
    commits = spark.sql("select 'o/r' as repo, 'abc' as sha, 'me' as author, '2024' as created_at, 'fix\\nmore' as message, array(named_struct('filename', 'a.py', 'status', 'modified')) as files")
    assert sorted((r.op, r.name, r.predicate) for r in S.commit_ops(commits).collect()) == [("UpsertEdge", None, "REFERENCES"), ("UpsertNode", "fix", None)]


def test_diffs(spark):
    old, new = (spark.createDataFrame([("k", t)], "key string, text string") for t in ("a\nb\nc\nd", "a\nB\nc\nd\ne"))
    hunks = V.unified_diff(old, new)
    assert [r.line for r in hunks.orderBy("n").collect()] == ["@@ -1,4 +1,5 @@", " a", "-b", "+B", " c", " d", "+e"]
    cut = V.hunks_in_span(hunks, spark.createDataFrame([("k", 2, 2)], "key string, first int, last int"))
    assert sorted(r.line for r in cut.collect()) == ["+B", "-b"]
    modes = spark.createDataFrame([(True, True, False, None), (True, False, True, None), (False, False, True, 5), (False, True, False, 5)], "summary boolean, content boolean, full boolean, limit int")
    assert [r.conflict for r in V.diff_mode(modes).collect()] == ["summary excludes content", "summary ignores full and limit", "full excludes limit", None]


def test_investigations(spark, tmp_path):
    part = lambda ids: {p: spark.createDataFrame([("s", i, i, "p") for i in ids], "seed string, id string, src string, dst string").withColumn("predicate", F.lit("p")) for p in C.SAVED}
    C.save_investigation(part(["a", "b"]), str(tmp_path), "one", "2024-01-01")
    assert rows(C.list_investigations(spark, str(tmp_path)), "investigation", "entities") == [("one", 2)]
    got = C.diff_investigations(C.load_investigation(spark, str(tmp_path), "one"), part(["b", "c"]))
    assert rows(got.where("part = 'entities'"), "change", "key") == [("added", "s|c"), ("removed", "s|a")]


def test_stitch(spark):
    provides = spark.createDataFrame([("p", "lib", "p:index")], "ws string, name string, node string")
    consumes = spark.createDataFrame([("c", "lib", "c:main")], "ws string, name string, node string")
    exports = spark.createDataFrame([("p", "run", "p:run")], "ws string, name string, node string")
    symbols = spark.createDataFrame([("c", "lib", "run", "c:f"), ("c", None, "run", "c:g"), ("c", "other", "run", "c:h")], "ws string, package string, name string, caller string")
    edges, systems = C.stitch_all(provides, consumes, exports, symbols)
    assert rows(edges, "src", "dst", "predicate") == [("c:f", "p:run", "CALLS"), ("c:g", "p:run", "CALLS"), ("c:main", "p:index", "IMPORTS")]
    assert systems.select("system_id").distinct().count() == 1 and systems.count() == 2


def test_map_levels(spark):
    links = spark.createDataFrame([(f"{g}{i}", f"{g}{j}", 5.0) for g in "ab" for i in range(4) for j in range(i + 1, 4)] + [("a0", "b0", 0.5)], "a string, b string, weight double")
    member = A.levels(links, spark.createDataFrame([(f"{g}{i}",) for g in "ab" for i in range(4)] + [("z",)], "id string"))
    one = {r.id: r.region for r in member.where("level = 1").collect()}
    assert len({one[f"a{i}"] for i in range(4)}) == 1 and one["a0"] != one["b0"] and one["z"] == "z"
    assert A.region_edges(member).where("src like '1:%'").count() == 9


def test_context(spark):
    e = spark.createDataFrame([("g", 1, "a", "xxx"), ("g", 2, "b", "y" * 20), ("g", 3, "c", "z")], "grp string, rank int, id string, text string")
    assert rows(C.evidence_budget(e, "grp", 5, 10), "id") == [("a",)]
    assert C.clamp("entities", 999) == 500 and C.clamp("chars", None) == 12_000


SAMPLES = {
    "a.py": ("python", "import os\nfrom x.y import z\nclass A(B):\n    def m(self):\n        self.n()\n        f()\n"),
    "b.yaml": ("yaml", "a:\n  b: 1\n  c:\n    - d: 2\n"),
    "c.toml": ("toml", "[x.y]\nk = 1\n"),
    "d.md": ("markdown", "# T\n```\n# no\n```\n## U\ntext\n"),
    "e.json": ("json", json.dumps({"p": [{"q": 1}]})),
    "f.sql": ("sql", "create table t (a int);\ncreate view v as select * from t join u on 1 = 1;"),
    "Dockerfile": ("dockerfile", "FROM base AS b\nCOPY --from=other x y\n"),
    "g.tex": ("latex", "\\section{S}\n\\label{l}\\ref{k}\n\\usepackage{amsmath}"),
    "h.ts": ("typescript", "import { a } from './m';\nexport class K {}\nfunction f() {\n  go();\n}\n"),
    "i.html": ("html", '<a href="/x">y</a><my-tag></my-tag>'),
    "bad.py": ("python", "def ("),
}


def test_extract(spark):
    df = spark.createDataFrame([(p, lang, c) for p, (lang, c) in SAMPLES.items()], "path string, language string, content string")
    got = E.extract(df).collect()
    names = {(r.path, r.name, r.container) for r in got if r.row == "entity"}
    rels = {(r.path, r.source, r.target, r.predicate) for r in got if r.row == "relationship"}
    assert {("a.py", "m", "A"), ("b.yaml", "b", "a"), ("b.yaml", "d", "a.c"), ("c.toml", "k", "x.y"), ("d.md", "U", "T"), ("e.json", "q", "p"), ("f.sql", "v", None), ("Dockerfile", "b", None), ("g.tex", "l", "S"), ("h.ts", "K", None), ("i.html", "my-tag", None)} <= names
    assert not any(n == "no" for _, n, _ in names)
    assert {("a.py", "A", "B", "EXTENDS"), ("a.py", "m", "A.n", "CALLS"), ("a.py", None, "y", "IMPORTS"), ("f.sql", "v", "u", "REFERENCES"), ("Dockerfile", "b", "other", "IMPORTS"), ("g.tex", None, "amsmath.sty", "IMPORTS"), ("h.ts", None, "./m", "IMPORTS"), ("h.ts", "f", "go", "CALLS"), ("i.html", None, "/x", "IMPORTS")} <= rels
    assert [r.error for r in got if r.path == "bad.py" and r.row == "error"] == ["SyntaxError"]


def test_discover(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/mock_a.js").write_text("x")
    (tmp_path / "node_modules/b.py").write_text("x")
    assert [r.path.rsplit("/", 1)[-1] for r in S.discover(spark, str(tmp_path)).collect()] == ["a.py"]


def test_watch_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"path": "a", "mtime": 1, "hash": "x", "deleted": false}\n{"path": "a", "mtime": 2, "hash": "y", "deleted": false}\n{"path": "b", "mtime": 1, "hash": "z", "deleted": false}\n')
    stream = watch.changes(watch.watch_files(spark, str(source), "path string, mtime long, hash string, deleted boolean"))
    q = stream.writeStream.format("memory").queryName("watched").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    (source / "2.json").write_text('{"path": "a", "mtime": 2, "hash": "y", "deleted": false}\n{"path": "b", "mtime": 9, "hash": "z", "deleted": true}\n')
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("watched"), "path", "change") == [("a", "changed"), ("a", "new"), ("b", "deleted"), ("b", "new")]


def test_extract_faults():
    """Facts that patterns once got wrong."""
    ents = lambda lang, src: [(e[0], e[1], e[3]) for e in E.EXTRACTORS[lang](src)[0]]
    rels = lambda lang, src: E.EXTRACTORS[lang](src)[1]
    java = "class A { int f; A() { g(); } void pkg(int x) { if (x > 0) { h(); } } Runnable r = new Runnable() { public void run() {} }; }"
    assert {("A", "method"), ("pkg", "method"), ("run", "method")} <= {e[:2] for e in ents("java", java.replace("; ", ";\n").replace("{ ", "{\n"))}
    assert {n for n, _, _ in ents("java", java)} == {"A", "pkg", "run"}
    assert {t for _, t, p in rels("java", java) if p == "CALLS"} & {"pkg", "if", "A"} == set() and {"g", "h"} <= {t for _, t, p in rels("java", java) if p == "CALLS"}
    go = 'package p\nimport (\n\t"fmt"\n\tx "a/b"\n)\nvar (\n\tv = 1\n)\nfunc F() {\n\tg()\n}\n'
    assert {r for r in rels("go", go) if r[2] == "CALLS"} == {("F", "g", "CALLS")} and {t for _, t, p in rels("go", go) if p == "IMPORTS"} == {"fmt", "a/b"}
    php = "<?php\nuse A\\{B, C as D};\nuse E\\F;\nclass K {\n  function m() { n(); }\n}\nfunction top() {}\n"
    assert {t for _, t, p in rels("php", php) if p == "IMPORTS"} == {"A\\B", "A\\C", "E\\F"}
    assert {e[:2] for e in ents("php", php)} == {("K", "class"), ("m", "method"), ("top", "function")}
    assert {t for _, t, p in rels("scala", "import a.b.{C, D => E, _}\nimport x.Y\n") if p == "IMPORTS"} == {"a.b.C", "a.b.D", "x.Y"}
    docker = "FROM a AS s\nRUN x \\\n  && y \\\n  && z\n\nCOPY f g\n"
    assert [(n, k) for n, _, k in ents("dockerfile", docker)] == [("s", 1), ("a", 1), ("run", 2), ("copy:f", 6)]
    assert [(e[0], e[2], e[3]) for e in E.EXTRACTORS["json"]('{"a": 1,\n "b": [{"c": "x, y"},\n {"d": {"e\\"": []}}],\n"f": "{"}')[0]] == [("a", None, 1), ("b", None, 2), ("c", "b", 2), ("d", "b", 3), ('e"', "b.d", 3), ("f", None, 4)]
    python = "class A(b.C[int], D):\n  pass\ndef f(x: Foo, n: int, y: 'Bar' = None) -> list[Baz]:\n  x.go()\n  n.go()\n"
    assert {(s, t) for s, t, p in rels("python", python) if p == "EXTENDS"} == {("A", "C"), ("A", "D")}
    assert {t for _, t, p in rels("python", python) if p == "REFERENCES"} == {"Foo", "Bar"} and ("f", "Foo.go", "CALLS") in rels("python", python)
