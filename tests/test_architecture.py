"""Facts, views and runtime stages."""

from orrery.operators import architecture as a
from orrery.sources.files import docker_instructions

DOCKER = """FROM node:20 AS deps
ENV A=1 B="two words"
ENV C old style
FROM deps
COPY --from=0 /x /y
ADD --from=nginx:1 /x /y
EXPOSE 80/tcp 443
VOLUME ["/d"]
FROM scratch AS final
COPY --from=stage-2 /x /y
ENTRYPOINT ["/run"]
CMD serve
CMD serve --fast
"""


def test_stages(spark):
    rows = docker_instructions(spark.createDataFrame([("p/Dockerfile", DOCKER), ("q", "RUN echo\n"), ("r", "")], "path string, text string"))
    got = {r.name: r for r in a.build_stages(rows).collect()}
    assert set(got) == {"deps", "stage-2", "final"}
    assert got["deps"].environment == {"A": "1", "B": "two words", "C": "old style"} and got["deps"].base == "node:20" and got["deps"].role == "build"
    two = got["stage-2"]
    assert (two.base, two.copies_from, two.ports, two.volumes, two.environment) == ("deps", ["deps", "nginx:1"], ["443", "80/tcp"], ["/d"], {})
    final = got["final"]
    assert (final.role, final["index"], final.copies_from, final.command, final.entrypoint, final.workdir) == ("runtime", 2, ["stage-2"], "serve --fast", '["/run"]', None)
    assert {r.name: r.role for r in a.build_stages(rows, ["deps"]).collect()} == {"deps": "runtime", "stage-2": "build", "final": "build"}


def test_facts_and_views(spark):
    schema = "element string, kind string, relation string, target string, evidence string"
    one = spark.createDataFrame([("a", "package", "depends-on", "b", "x:1"), ("a", "package", "depends-on", "b", "x:2"), (None, "k", "uses", "c", "e"), ("lone", "package", None, None, "y")], schema)
    two = spark.createDataFrame([("a", "module", "depends-on", "b", "x:1"), ("a", "module", "runs", "img", None)], schema)
    f = a.facts({"workspace": one, "runtime": two})
    got = {(r.element, r.relation, r.target): (r.kind, r.evidence, r.sources) for r in f.collect()}
    assert got == {("a", "depends-on", "b"): ("module", ["x:1", "x:2"], ["runtime", "workspace"]), ("a", "runs", "img"): ("module", [], ["runtime"]), ("lone", None, None): ("package", ["y"], ["workspace"])}
    assert {tuple(r) for r in a.elements(f).select("element", "kind", "relations").collect()} == {("a", "module", 2), ("lone", "package", 0), ("b", "external", 0), ("img", "external", 0)}
    assert {tuple(r) for r in a.overview(f).collect()} == {("system-context", False, 0, 0), ("deployment", True, 2, 1), ("component", True, 2, 1)}
    assert {r.available for r in a.overview(f.filter("false")).collect()} == {False}
