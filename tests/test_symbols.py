"""Facts of hand-made modules, and who calls whom across them."""

from revlytics.operators import symbols

FILES = {
    "app/__init__.py": "from .core import run as start\nstart()\n",
    "app/core.py": (
        "import os\nimport app.util as u\nfrom app import util\nfrom app.util import helper, Tool as T\n\n\ndef run(x=helper()):\n    def inner():\n        return helper() + deep()\n    def deep():\n        return inner()\n    u.helper()\n    util.other()\n    return inner()\n\n\n"
        "class Job:\n    def a(self):\n        self.b()\n        b()\n        os.path.join('x')\n        return T()\n    def b(self):\n        return run()\n    @staticmethod\n    def c():\n        (lambda: run())()\n        make().go()\n"
    ),
    "app/util.py": "def helper():\n    return 1\nasync def other():\n    return await missing()\nclass Tool:\n    pass\n",
    "bad.py": "def (:\n", "empty.py": "", "notes.txt": "def f(): pass",
}


def made(spark):
    return symbols.facts(spark.createDataFrame([(1, p, s) for p, s in FILES.items()] + [(2, "app/core.py", "run()\n"), (2, "none.py", None)], "repo int, path string, content string").repartition(3), ["repo"])


def test_facts(spark):
    rows = made(spark).where("repo = 1").collect()
    assert {(r["path"], r["scope"], r["name"], r["detail"]) for r in rows if r["kind"] == "def"} == {
        ("app/core.py", "", "run", "FunctionDef"), ("app/core.py", "run", "inner", "FunctionDef"), ("app/core.py", "run", "deep", "FunctionDef"), ("app/core.py", "", "Job", "ClassDef"), ("app/core.py", "Job", "a", "FunctionDef"),
        ("app/core.py", "Job", "b", "FunctionDef"), ("app/core.py", "Job", "c", "FunctionDef"), ("app/util.py", "", "helper", "FunctionDef"), ("app/util.py", "", "other", "AsyncFunctionDef"), ("app/util.py", "", "Tool", "ClassDef"),
    }
    assert {(r["name"], r["owner"], r["target"]) for r in rows if r["kind"] == "import"} == {("start", "app.core", "run"), ("os", "os", ""), ("u", "app.util", ""), ("util", "app", "util"), ("helper", "app.util", "helper"), ("T", "app.util", "Tool")}
    assert [(r["path"], bool(r["detail"])) for r in rows if r["kind"] == "error"] == [("bad.py", True)]


def test_calls_are_resolved(spark):
    got = {(r["path"], r["line"], r["scope"], r["owner"], r["name"]): (r["to_path"], r["to_scope"], r["how"]) for r in symbols.resolved_calls(made(spark), ["repo"]).where("repo = 1").collect()}
    core, util = "app/core.py", "app/util.py"
    assert got == {
        ("app/__init__.py", 2, "", "", "start"): (core, "", "import"), (core, 7, "", "", "helper"): (util, "", "import"), (core, 9, "run.inner", "", "helper"): (util, "", "import"), (core, 9, "run.inner", "", "deep"): (core, "run", "local"),
        (core, 11, "run.deep", "", "inner"): (core, "run", "local"), (core, 12, "run", "u", "helper"): (util, "", "module"), (core, 13, "run", "util", "other"): (util, "", "module"), (core, 14, "run", "", "inner"): (core, "run", "local"),
        (core, 19, "Job.a", "self", "b"): (core, "Job", "method"), (core, 20, "Job.a", "", "b"): (None, None, None), (core, 21, "Job.a", "os.path", "join"): (None, None, None), (core, 22, "Job.a", "", "T"): (util, "", "import"),
        (core, 24, "Job.b", "", "run"): (core, "", "local"), (core, 27, "Job.c", "", "run"): (core, "", "local"), (core, 28, "Job.c", "", "make"): (None, None, None), (core, 28, "Job.c", "?", "go"): (None, None, None), (util, 4, "other", "", "missing"): (None, None, None),
    }
    other = symbols.resolved_calls(made(spark), ["repo"]).where("repo = 2").collect()
    assert [(r["name"], r["to_path"]) for r in other] == [("run", None)]  # another repository's names don't count


def test_symbols(spark):
    got = {r["name"]: r for r in symbols.symbol(made(spark), ["repo"], 3).where("repo = 1").collect()}
    assert [(x["path"], x["line"], x["symbol"]) for x in got["helper"]["callers"]] == [("app/core.py", 7, "helper"), ("app/core.py", 9, "helper"), ("app/core.py", 12, "helper")]
    assert [(x["line"], x["symbol"]) for x in got["run"]["callees"]] == [(9, "deep"), (9, "helper"), (11, "inner")]  # three of six
    assert [(x["path"], x["symbol"]) for x in got["Tool"]["definitions"]] == [("app/util.py", "ClassDef")] and got["Tool"]["callees"] == []


def test_node_counts(spark):
    df = spark.createDataFrame([(1, "a.py", "x = f(1) + f(2)\n"), (1, "b.py", "def ("), (1, "c.py", "")], "repo int, path string, content string")
    got = {(r["path"], r["type"]): r["n"] for r in symbols.node_counts(df, ["repo"]).collect()}
    assert got["a.py", "Call"] == 2 and got["a.py", "Module"] == 1 and got["c.py", "Module"] == 1 and not any(p == "b.py" for p, _ in got)
    assert symbols.facts(df.where("false"), ["repo"]).collect() == []
