"""Files as rows: source trees, Markdown, HTML, office documents, logs, graph JSON, configuration and manifests."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders that a scan leaves out, languages by extension, and files never to be read.
IGNORED = ("node_modules", ".git", "dist", "build", "target", "__pycache__", ".venv", "vendor")
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "py": "python", "go": "go", "java": "java", "rs": "rust"}
SENSITIVE = r"(?i)(^|/)(\.env(\..*)?|.*\.(pem|key|p12|pfx)|id_rsa.*|.*credentials.*|.*secret.*)$"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def scan_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, language, size) of files below ``root`` outside ignored folders; unknown extensions have a null language."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    kept = files.filter(~F.col("path").rlike("/(" + "|".join(re.escape(x) for x in IGNORED) + ")/"))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return kept.select("path", F.element_at(table, extension(F.col("path"))).alias("language"), F.col("length").alias("size"))


def classify(path: Column) -> Column:
    """document, api-spec, image or null; sensitive files are nothing."""
    return (
        F.when(path.rlike(SENSITIVE), None).when(path.rlike(r"(?i)(openapi|swagger)[^/]*\.(json|ya?ml)$"), "api-spec")
        .when(path.rlike(r"(?i)\.(md|mdx|rst|txt|adoc)$"), "document").when(path.rlike(r"(?i)\.(png|jpe?g|gif|svg|webp)$"), "image")
    )


def markdown_documents(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, title, links, text): ids are paths below ``root``, titles first H1 headings, links targets in order."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    path = F.regexp_replace(F.input_file_name(), r"^.*?" + re.escape(root.rstrip("/")) + "/", "")
    rows = raw.select(path.alias("doc_id"), F.col("value").alias("text"))
    return rows.select("doc_id", F.nullif(F.trim(F.regexp_extract("text", r"(?m)^# +(.+)$", 1)), F.lit("")).alias("title"), F.regexp_extract_all("text", F.lit(r"\[[^\]]*\]\(([^)\s]+)"), F.lit(1)).alias("links"), "text")


def llms_index(text: DataFrame) -> DataFrame:
    """(title, url) of the link list in ``text`` (value)."""
    links = F.regexp_extract_all("value", F.lit(r"\[([^\]]+)\]\((\S+?)\)"), F.lit(0))
    one = text.select(F.explode(links).alias("l"))
    return one.select(F.regexp_extract("l", r"\[([^\]]+)\]", 1).alias("title"), F.regexp_extract("l", r"\((\S+?)\)$", 1).alias("url"))


class _Text(HTMLParser):
    SKIP, BREAK = {"script", "style", "nav", "footer", "aside", "noscript"}, {"p", "div", "li", "br", "h1", "h2", "h3", "h4", "tr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        if tag in ("h1", "h2", "h3", "h4"):
            self.out.append("\n" + "#" * int(tag[1]) + " ")
        elif tag in self.BREAK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in self.SKIP and self.skip > 0
        if tag in self.BREAK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def html_to_markdown(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``title`` and ``markdown``: headings and text without navigation and scripts."""

    @F.pandas_udf("string")
    def body(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out = []
            for html in b:
                p = _Text()
                p.feed(html or "")
                out.append(re.sub(r"\n\s*\n+", "\n\n", "".join(p.out)).strip())
            yield pd.Series(out)

    return pages.withColumn("title", F.regexp_extract(html_col, "(?is)<title[^>]*>(.*?)</title>", 1)).withColumn("markdown", body(F.col(html_col)))


def office_text(files: DataFrame) -> DataFrame:
    """(path, text) of docx and pptx in ``files`` (path, content); entries that point outside the archive are not read."""

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out = []
            for blob in b:
                try:
                    with zipfile.ZipFile(io.BytesIO(blob)) as z:
                        names = sorted(n for n in z.namelist() if re.match(r"(word/document|ppt/slides/slide\d+)\.xml$", n) and ".." not in n)
                        xml = "\n".join(z.read(n).decode("utf-8", "replace") for n in names)
                    out.append("\n".join("".join(re.findall(r"<(?:w|a):t[^>]*>([^<]*)", para)) for para in re.findall(r"(?s)<(?:w|a):p[ >].*?</(?:w|a):p>", xml)))
                except (zipfile.BadZipFile, TypeError):
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return files.select("path", extract("content").alias("text"))


def read_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, one row with the number of invalid lines) of JSON lines; blank lines are neither."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    valid = parsed.filter("r IS NOT NULL AND r._bad IS NULL").select("r.*").drop("_bad")
    return valid, parsed.agg(F.count(F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), 1)).alias("invalid"))


GRAPH = T.StructType([
    T.StructField("nodes", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("id", "kind", "label")] + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]))),
    T.StructField("links", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("source", "target", "relation", "confidence")] + [T.StructField("confidenceScore", T.DoubleType())]))),
])


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of node-link JSON, with a fixed schema."""
    raw = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    nodes = raw.select(F.explode("nodes").alias("n")).select("n.*")
    return nodes, raw.select(F.explode("links").alias("e")).select("e.*").withColumnRenamed("confidenceScore", "score")


def stale_format(nodes: DataFrame, root: str) -> DataFrame:
    """Absolute ids outside ``root`` that aren't flagged external; a fresh graph has none."""
    top = root.rstrip("/")
    return nodes.filter(F.col("id").startswith("/") & ~F.col("id").startswith(top + "/") & (F.col("id") != top)).filter(F.coalesce(F.col("metadata")["external"], F.lit("false")) != "true")


def config_entries(files: DataFrame) -> DataFrame:
    """(path, key, type, value) of key = value lines of .env and TOML files (path, text); sections prefix keys."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    from pyspark.sql import Window

    section = F.nullif(F.regexp_extract("line", r"^\s*\[+([^\]]+)\]+\s*$", 1), F.lit(""))
    lines = lines.withColumn("section", F.last(section, ignorenulls=True).over(Window.partitionBy("path").orderBy("at")))  # one file's lines
    entry = r"^\s*(?:export\s+)?([A-Za-z_][\w.-]*)\s*=\s*(.*?)\s*$"
    rows = lines.filter(F.col("line").rlike(entry) & ~F.col("line").rlike(r"^\s*#"))
    value = F.regexp_replace(F.regexp_extract("line", entry, 2), "^[\"']|[\"']$", "")
    kind = F.when(value.rlike("^(?i:true|false)$"), "boolean").when(value.rlike(r"^-?\d+(\.\d+)?$"), "number").otherwise("string")
    return rows.select("path", F.concat_ws(".", "section", F.regexp_extract("line", entry, 1)).alias("key"), kind.alias("type"), value.alias("value"))


def docker_instructions(files: DataFrame) -> DataFrame:
    """(path, at, instruction, argument, stage): stages count FROM lines from 0."""
    from pyspark.sql import Window

    joined = F.regexp_replace("text", r"\\\s*\n\s*", " ")
    lines = files.select("path", F.posexplode(F.split(joined, "\n")).alias("at", "line")).filter(F.col("line").rlike(r"^\s*[A-Za-z]+\s") & ~F.col("line").rlike(r"^\s*#"))
    rows = lines.select("path", "at", F.upper(F.regexp_extract("line", r"^\s*([A-Za-z]+)", 1)).alias("instruction"), F.trim(F.regexp_extract("line", r"^\s*[A-Za-z]+\s+(.*)$", 1)).alias("argument"))
    return rows.withColumn("stage", F.sum(F.when(F.col("instruction") == "FROM", 1).otherwise(0)).over(Window.partitionBy("path").orderBy("at")) - 1)


def npm_lock_versions(files: DataFrame) -> DataFrame:
    """(path, package, version) of npm lockfiles (path, text)."""
    schema = "packages map<string, struct<version: string>>, dependencies map<string, struct<version: string>>"
    both = files.select("path", F.from_json("text", schema).alias("j"))
    v2 = both.select("path", F.explode("j.packages").alias("k", "v")).select("path", F.regexp_replace("k", "^.*node_modules/", "").alias("package"), "v.version")
    v1 = both.filter("j.packages IS NULL").select("path", F.explode("j.dependencies").alias("package", "v")).select("path", "package", "v.version")
    return v2.unionByName(v1).filter("package <> '' AND version IS NOT NULL").distinct()


def openapi_operations(files: DataFrame) -> DataFrame:
    """(path, endpoint, method, operation_id) of OpenAPI JSON (path, text)."""
    ops = "map<string, map<string, struct<operationId: string>>>"
    paths = files.select("path", F.from_json(F.get_json_object("text", "$.paths"), ops).alias("p"))
    each = paths.select("path", F.explode("p").alias("endpoint", "m")).select("path", "endpoint", F.explode("m").alias("method", "o"))
    return each.filter(F.col("method").isin("get", "put", "post", "delete", "patch", "head", "options")).select("path", "endpoint", F.upper("method").alias("method"), F.col("o.operationId").alias("operation_id"))


def changed_files(diff: DataFrame) -> DataFrame:
    """(path, status) of unified diffs (value: a whole diff each): added, deleted, renamed or modified, by the lines of each file's head."""
    parts = diff.select(F.explode(F.split("value", r"(?m)^(?=diff --git )")).alias("d")).filter(F.col("d").startswith("diff --git "))
    head = F.regexp_extract("d", r"(?s)^(.*?)(?=\n@@|\z)", 1)
    path = F.regexp_extract("d", r"^diff --git a/.* b/(.*)", 1)
    status = F.when(head.rlike(r"(?m)^new file mode"), "added").when(head.rlike(r"(?m)^deleted file mode"), "deleted").when(head.rlike(r"(?m)^rename to "), "renamed").otherwise("modified")
    return parts.select(path.alias("path"), status.alias("status")).filter("path <> ''").distinct()


def porcelain(status: DataFrame) -> DataFrame:
    """(status, path) of `git status --porcelain` lines; a rename gives its new path."""
    rows = status.filter(F.length("value") > 3).select(F.trim(F.substring("value", 1, 2)).alias("status"), F.substring("value", 4, 4096).alias("path"))
    return rows.withColumn("path", F.regexp_replace("path", r"^.* -> ", ""))


def scan_counts(spark: SparkSession, root: str) -> DataFrame:
    """(language, files) of a tree, and with a null language the files of extensions that aren't supported."""
    return scan_tree(spark, root).groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def llms_documents(index: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, title, url, text) of the pages (url, markdown, title) that an index (title, url) lists, once each: ids are the
    urls' hosts and paths, titles those of the pages, else of the index."""
    doc_id = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", ""), r"(\.md|\.html?|/)$", "")
    first = index.groupBy("url").agg(F.min("title").alias("listed"))
    rows = first.join(pages, "url").select(doc_id.alias("doc_id"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), "listed").alias("title"), "url", F.col("markdown").alias("text"))
    return rows.groupBy("doc_id").agg(F.min(F.struct("url", "title", "text")).alias("r")).select("doc_id", "r.title", "r.url", "r.text")


def documents(spark: SparkSession, root: str | None = None, index: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, title, text, links) from a folder of Markdown or from an index with its pages; one of them is required."""
    if (root is None) == (index is None):
        raise ValueError("a folder or an index, and not both")
    if root is not None:
        return markdown_documents(spark, root).select("doc_id", "title", "text", "links")
    links = F.regexp_extract_all("text", F.lit(r"\[[^\]]*\]\(([^)\s]+)"), F.lit(1))
    return llms_documents(index, pages).select("doc_id", "title", "text", links.alias("links"))


def markdown_artifacts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of Markdown files (path, text): a document and its headings, that it contains, and the files that it links to."""
    nodes = files.select(F.col("path").alias("id"), F.lit("document").alias("kind"), F.coalesce(F.nullif(F.trim(F.regexp_extract("text", r"(?m)^# +(.+)$", 1)), F.lit("")), "path").alias("label"))
    fenced = F.regexp_replace("text", r"(?ms)^(```|~~~).*?^\1[^\n]*$", "")
    heads = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all(fenced, F.lit(r"(?m)^#{2,6} +(.+?) *$"), F.lit(1)))).alias("head"))
    sections = heads.select(F.concat("path", F.lit("#"), F.regexp_replace(F.lower("head"), r"[^\p{L}\p{N}]+", "-")).alias("id"), F.lit("section").alias("kind"), F.col("head").alias("label"), "path").dropDuplicates(["id"])
    links = files.select(F.col("path").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[[^\]]*\]\(([^)\s#]+)"), F.lit(1)))).alias("target")).filter(~F.col("target").rlike("^[a-z]+:"))
    edges = sections.select(F.col("path").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("relation")).unionByName(links.withColumn("relation", F.lit("references")))
    return nodes.unionByName(sections.select("id", "kind", "label")), edges


def openapi_artifacts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of OpenAPI files: the interface and its operations, that it contains."""
    ops = openapi_operations(files)
    node = F.concat("path", F.lit("::"), "method", F.lit(" "), "endpoint")
    nodes = files.select(F.col("path").alias("id"), F.lit("api-schema").alias("kind"), F.coalesce(F.get_json_object("text", "$.info.title"), "path").alias("label"))
    return nodes.unionByName(ops.select(node.alias("id"), F.lit("api-endpoint").alias("kind"), F.coalesce("operation_id", F.concat("method", F.lit(" "), "endpoint")).alias("label"))), ops.select(F.col("path").alias("source"), node.alias("target"), F.lit("contains").alias("relation"))


def extract_artifacts(files: DataFrame, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, cache rows) of the files (path, text) that are documents or interfaces and whose content isn't in
    ``cache`` (path, hash); a file that can't be read gives its own node at most."""
    rows = files.withColumn("artifact", classify(F.col("path"))).filter("artifact IS NOT NULL AND text IS NOT NULL").withColumn("hash", F.sha2("text", 256))
    if cache is not None:
        rows = rows.join(cache.select("path", "hash"), ["path", "hash"], "left_anti")
    n1, e1 = markdown_artifacts(rows.filter("artifact = 'document'"))
    n2, e2 = openapi_artifacts(rows.filter("artifact = 'api-spec'"))
    return n1.unionByName(n2), e1.unionByName(e2), rows.select("path", "hash")


def pnpm_lock_versions(files: DataFrame) -> DataFrame:
    """(path, package, version) of pnpm and yarn lockfiles (path, text); lockfiles of other ecosystems have a null package."""
    pnpm = files.filter(F.col("path").endswith("pnpm-lock.yaml")).select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^  ['\"]?/?(@?[^@\s'\"(]+@\d[^:'\"(\s]*)"), F.lit(1))).alias("e"))
    pnpm = pnpm.select("path", F.regexp_extract("e", r"^(@?[^@]+)@", 1).alias("package"), F.regexp_extract("e", r"@([^@]+)$", 1).alias("version"))
    yarn = files.filter(F.col("path").endswith("yarn.lock")).select("path", F.explode(F.regexp_extract_all("text", F.lit(r'(?m)^"?(@?[^@\s",]+@[^:\n]*:\n  version:? "?[^"\n]+)'), F.lit(1))).alias("e"))
    yarn = yarn.select("path", F.regexp_extract("e", r"^(@?[^@]+)@", 1).alias("package"), F.regexp_extract("e", r'version:? "?([^"]+)$', 1).alias("version"))
    other = files.filter(F.col("path").rlike(r"(^|/)(Cargo\.lock|poetry\.lock|go\.sum|Gemfile\.lock|composer\.lock)$")).select("path", F.lit(None).cast("string").alias("package"), F.lit(None).cast("string").alias("version"))
    return pnpm.unionByName(yarn).distinct().unionByName(other)


def yaml_pairs(text: str) -> list[tuple[str, str]]:
    """(key path, value) of the plain part of YAML: nested maps by indentation, items of lists by number, comments left out.
    Block texts, anchors and flow collections stay as they are written."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[int, str, int]] = []  # indentation, key, items so far
    for line in text.split("\n"):
        bare = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not bare.strip() or bare.strip() in ("---", "..."):
            continue
        indent, rest = len(bare) - len(bare.lstrip()), bare.lstrip()
        while rest:
            item = rest == "-" or rest.startswith("- ")
            while stack and (stack[-1][0] > indent or (stack[-1][0] == indent and not (item and not stack[-1][1].startswith("[")))):
                if item and stack[-1][0] == indent and stack[-1][1].startswith("["):
                    break
                stack.pop()
            if item:
                if stack and stack[-1][0] == indent and stack[-1][1].startswith("["):
                    n = stack.pop()[2] + 1
                else:
                    n = 0
                stack.append((indent, f"[{n}]", n))
                indent, rest = indent + 2 + len(rest[1:]) - len(rest[1:].lstrip()) - 1, rest[1:].lstrip()
                continue
            m = re.match(r"""(?:"([^"]+)"|'([^']+)'|([^:\s][^:]*?))\s*:(?:\s+(.*))?$""", rest)
            path = [k for _, k, _ in stack]
            if not m:
                out.append((".".join(path).replace(".[", "["), rest.strip("\"'")))
            else:
                key = m[1] or m[2] or m[3]
                if m[4]:
                    out.append((".".join([*path, key]).replace(".[", "["), m[4].strip().strip("\"'")))
                else:
                    stack.append((indent, key, 0))
            break
    return out


def yaml_entries(files: DataFrame) -> DataFrame:
    """(path, key, type, value) of YAML files (path, text), as ``config_entries`` has them of others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, k, v) for p, t in zip(b["path"], b["text"], strict=True) if t for k, v in yaml_pairs(t)], columns=["path", "key", "value"])

    rows = files.select("path", "text").mapInPandas(run, "path string, key string, value string")
    kind = F.when(F.col("value").rlike("^(?i:true|false)$"), "boolean").when(F.col("value").rlike(r"^-?\d+(\.\d+)?$"), "number").otherwise("string")
    return rows.select("path", "key", kind.alias("type"), "value")


def skill_rows(files: DataFrame) -> DataFrame:
    """(path, name, description, sections) of skill files (path, text): the fields of their front matter and their H2 headings."""
    front = F.regexp_extract("text", r"(?s)^---[^\n]*\n(.*?)\n---", 1)
    field = lambda n: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(front, rf"(?m)^{n}:[ \t]*(.*)$", 1), r"^[\"']|[\"']$", "")), F.lit(""))
    return files.select("path", field("name").alias("name"), field("description").alias("description"), F.regexp_extract_all("text", F.lit(r"(?m)^## +(.+?) *$"), F.lit(1)).alias("sections"))
