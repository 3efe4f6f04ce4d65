"""Queries of the command-output processors, over documents that follow a block of evidence lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import processors as P
from tessera.plans.registry import query, table

#: A command for each rule, and for each form of its own.
COMMANDS = [
    "npm test", "git show HEAD", "git branch", "git push origin", "docker build .", "docker ps", "docker compose up", "docker inspect x", "kubectl get pods", "kubectl describe pod", "kubectl events", "terraform plan",
    "terraform apply", "helm list", "pulumi up", "cargo build", "cargo clippy", "cargo test", "mvn install", "./gradlew test", "ruff check", "eslint src", "pylint a", "tsc", "mypy a", "jq . a", "python -m ruff; clippy", "pyright .", "dotnet test",
    "npm run build", "pip install x", "pytest -q", "git diff", "git log", "git status", "go build ./...", "go test ./...", "rg x", "docker logs x", "echo hi",
]
EVIDENCE = (
    "FAIL a.test.js", "commit 0123", "From origin", "#1 [internal] load", "Created", "Name: pod", "Plan: 1 to add", "Apply complete!", "STATUS: deployed", "Resources: 2", "error[E0308]: mismatch", "test result: ok", "[ERROR] x", "BUILD FAILED",
    "a.py:1:2: E501 long", "12:3 error no-undef", "a.py:1:2: C0114: doc", "a.ts(1,2): error TS1: x", "a.py:1: error: x", "Finished dev", "--- FAIL: T", "added 3 packages", "plain line", "",
)


def _outputs(spark, d):
    pick = F.get(F.array(*[F.lit(c) for c in COMMANDS]), (F.col("doc_id") % len(COMMANDS)).cast("int"))
    text = F.concat(F.lit("\n".join(EVIDENCE) + "\n"), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", pick.alias("command"), text.alias("text"), (F.col("doc_id") % 3 == 0).alias("failed"))


_q = lambda s: s.replace("'", "''")
_RULES = sorted([(p, n, c, h) for n, p, c, _, _, h, _, _ in P.LINE_FILTERS] + [(p, n, c, h) for n, p, c, h in P.OWN_FORMS])
_ROUTE = "CASE " + " ".join(f"WHEN regexp_matches(command, '(?i){_q(c)}'){'' if h else ' AND NOT failed'} THEN '{n}'" for _, n, c, h in _RULES) + " ELSE 'generic' END"
_KEPT = "CASE processor " + " ".join(f"WHEN '{n}' THEN list_filter(a, lambda x: regexp_matches(x, '(?i){_q(rx)}'))" for n, _, _, rx, *_ in P.LINE_FILTERS) + " END"
_LIMIT = "CASE processor " + " ".join(f"WHEN '{n}' THEN {1 << 30 if every else max(least, 80)}" for n, *_, least, every in P.LINE_FILTERS) + " END"
_LABEL = "CASE processor " + " ".join(f"WHEN '{n}' THEN '{label}'" for n, _, _, _, label, *_ in P.LINE_FILTERS) + " END"
_TEXTS = f"SELECT doc_id, {COMMANDS}[CAST(doc_id % {len(COMMANDS)} AS INT) + 1] AS command, array_to_string({list(EVIDENCE)}, chr(10)) || chr(10) || coalesce(text, '') AS text, doc_id % 3 = 0 AS failed FROM documents"


@query("p10_route", f"SELECT doc_id, {_ROUTE} AS processor FROM ({_TEXTS})")
def _(spark, d):
    return _outputs(spark, d).select("doc_id", P.route(F.col("command"), F.col("failed")).alias("processor"))


@query(
    "p10_line_filters",
    f"""WITH o AS (SELECT *, {_ROUTE} AS processor FROM ({_TEXTS})), l AS (SELECT *, string_split(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), chr(10)) AS w FROM o), a AS (SELECT *, CASE WHEN w[-1] = '' THEN w[1:len(w) - 1] ELSE w END AS a FROM l),
 k AS (SELECT *, ({_KEPT})[1:{_LIMIT}] AS k FROM a WHERE processor IN ({", ".join(f"'{n}'" for n, *_ in P.LINE_FILTERS)})),
 c AS (SELECT *, '[filtered ' || {_LABEL} || ': ' || len(a) || ' lines → ' || len(k) || ' kept, ' || (len(a) - len(k)) || ' omitted]' || chr(10) || array_to_string(k, chr(10)) || chr(10) AS c FROM k)
 SELECT doc_id, processor, CASE WHEN len(k) > 0 AND len(k) < len(a) AND strlen(c) < strlen(text) THEN md5(c) ELSE 'whole' END AS md5 FROM c""",
)
def _(spark, d):
    spec = F.create_map(*[x for n, _, _, rx, label, _, least, every in P.LINE_FILTERS for x in (F.lit(n), F.struct(F.lit(P.ignoring_case(rx)).alias("rx"), F.lit(label).alias("label"), F.lit((1 << 30) if every else max(least, 80)).alias("limit")))])
    own = _outputs(spark, d).withColumn("processor", P.route(F.col("command"), F.col("failed"))).withColumn("s", spec[F.col("processor")]).where("s is not null")
    return own.select("doc_id", "processor", F.coalesce(F.md5(P.line_filtered(F.col("text"), F.col("s.rx"), F.col("s.label"), F.col("s.limit"), F.lit(None).cast("string")).cast("binary")), F.lit("whole")).alias("md5"))


@query("p_compressed")
def _(spark, d):
    own = P.compressed(_outputs(spark, d))
    return own.select("doc_id", "processor", "changed", F.octet_length("text").cast("long").alias("bytes"), F.octet_length("result").cast("long").alias("result_bytes"), F.md5(F.col("result").cast("binary")).alias("md5"))
