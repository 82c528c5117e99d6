"""Registered queries: documents, tasks, answers, contracts, files, sinks and streams."""

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import answers as N, contract as K, pages as D, run as X, tasks as J
from ..schemas import EVIDENCE, RECORD
from ..sources import files as S, lines as L, sinks as O
from ..staging import new_path
from ..streaming import submissions as Z
from . import standins as T
from .views_sql import with_views

QUERIES, ORACLE = {}, {}


def query(name, views=None, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(views, sql) if views else sql.strip()
        return fn
    return register


# --- documents and tasks --------------------------------------------------------

TRIM = "regexp_replace({},'^\\s+|\\s+$','g')".replace("'g'", "'','g'")
PAGE = "'## Page '||(turn+1)||chr(10)||text"


@query("split_pages", None, f"""
SELECT 'conv-'||conv_id||'-'||(turn//100) AS document_id, 'text-p'||(turn+1) AS evidence_id, (turn+1)::INTEGER AS page, {TRIM.format(PAGE)} AS text FROM conversations
UNION ALL SELECT 'doc-'||doc_id, 'text-document', NULL, text FROM documents WHERE {TRIM.format('text')}<>''""")
def _(spark, d):
    plain = T.load(spark, d, "documents").select(T.text("doc-", F.col("doc_id")).alias("document_id"), F.col("text").alias("markdown"))
    rows = D.split_pages(T.page_documents(spark, d).unionByName(plain))
    return rows.select("document_id", "evidence_id", "page", "text")


TABLES = """
, ln AS (SELECT document_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)),1) AS n FROM tabled),
fl AS (SELECT *, length(line)-length(replace(line,'|',''))>=2 AS hit FROM ln),
isl AS (SELECT *, n-row_number() OVER (PARTITION BY document_id, hit ORDER BY n) AS g FROM fl),
num AS (SELECT *, row_number() OVER (PARTITION BY document_id, g ORDER BY n) AS r FROM isl WHERE hit),
runs AS (SELECT document_id, g, min(n) AS first_n, string_agg(line, chr(10) ORDER BY n) AS text, count(*) AS c, bool_or(r<=3 AND line LIKE '%---%') AS ok FROM num GROUP BY document_id, g),
tabs AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY first_n)::INTEGER AS table_number, text FROM runs WHERE c>=2 AND ok)"""


@query("markdown_tables", "tabled", TABLES + " SELECT document_id, table_number, text FROM tabs")
def _(spark, d):
    return D.markdown_tables(T.table_documents(spark, d))


def page_evidence(spark, d):
    return D.split_pages(T.page_documents(spark, d))


@query("text_tasks", None, f"""
SELECT 'conv-'||conv_id||'-'||(turn//100) AS document_id, 'tx-'||substr(sha256('text|text-p'||(turn+1)||CASE WHEN i=0 THEN '' ELSE '#'||(i+1) END),1,32) AS task_id, 'page '||(turn+1) AS ctx,
 substr(content, i*100+1, 100) AS content, '1.0.0' AS instruction_version
FROM (SELECT *, unnest(range(0, greatest(1, ceil(length(content)/100)::INTEGER))) AS i FROM (SELECT conv_id, turn, {TRIM.format(PAGE)} AS content FROM conversations))""")
def _(spark, d):
    rows = J.text_tasks(page_evidence(spark, d), max_chars=100)
    ctx = F.regexp_extract("instructions", r"Context: (page \d+)", 1)
    return rows.select("document_id", "task_id", ctx.alias("ctx"), F.col("assets.text").alias("content"), "instruction_version")


@query("render_prompt", None, f"""
SELECT 'conv-'||conv_id||'-'||(turn//100) AS document_id, 'text-p'||(turn+1) AS evidence_id, 'On page '||(turn+1)||' read: '||{TRIM.format(PAGE)}||' <end>' AS prompt FROM conversations""")
def _(spark, d):
    template = {"text": "On <<PAGE_CONTEXT>> read: <<CONTENT>> <end>"}
    prompt = J.render_prompt("text", {"<<PAGE_CONTEXT>>": F.concat(F.lit("page "), F.col("page").cast("string")), "<<CONTENT>>": F.col("text")}, template)
    return page_evidence(spark, d).select("document_id", "evidence_id", prompt.alias("prompt"))


@query("task_id", "tsk", """
SELECT document_id, evidence_id, kind, CASE kind WHEN 'text' THEN 'tx' WHEN 'table' THEN 'tt' ELSE 'st' END||'-'||substr(sha256(kind||'|'||evidence_id),1,32) AS id FROM tsk""")
def _(spark, d):
    e = F.col("evidence_ids")[0]
    return T.tasks(spark, d).select("document_id", e.alias("evidence_id"), "kind", ids.task_id("kind", e).alias("id"))


def mixed_evidence(spark, d):
    """parts as table and image evidence, some with an image, some without text."""
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "table").when(k % 3 == 1, "image").otherwise("text")
    return T.load(spark, d, "part").select(
        T.text("doc-", k % 10).alias("document_id"), T.text("e", k).alias("evidence_id"), kind.alias("kind"), (k % 30).cast("int").alias("page"),
        T.text("img/", k, ".png").alias("source_path"), F.when(k % 2 == 0, T.text("img/", k + 1, ".png")).alias("asset_path"),
        F.when(k % 5 != 0, F.col("p_name")).alias("text"), F.lit(None).cast("array<double>").alias("bbox"),
    )


@query("table_tasks", None, """
SELECT 'doc-'||(p_partkey%10) AS document_id, 'tt-'||substr(sha256('table|e'||p_partkey),1,32) AS task_id, CASE WHEN p_partkey%5<>0 THEN p_name END AS text,
 CASE WHEN p_partkey%2=0 THEN 'img/'||(p_partkey+1)||'.png' END AS image FROM part WHERE p_partkey%3=0 AND (p_partkey%5<>0 OR p_partkey%2=0)""")
def _(spark, d):
    rows = J.table_tasks(mixed_evidence(spark, d))
    return rows.select("document_id", "task_id", F.col("assets.text").alias("text"), F.get("assets.images", F.lit(0))["path"].alias("image"))


def image_list(spark, d):
    k = F.col("p_partkey")
    own = T.load(spark, d, "part").filter(k % 3 != 2)
    return own.select(T.text("doc-", k % 10).alias("document_id"), T.text("img/", k, ".png").alias("path"))


STRUCTURE_TASKS = """
WITH ev AS (SELECT p_partkey AS k, 'doc-'||(p_partkey%10) AS document_id FROM part),
t AS (SELECT document_id, 'img/'||(k+1)||'.png' AS path FROM ev WHERE k%3=0 AND k%2=0)
SELECT e.document_id, 'img/'||e.k||'.png' AS path, CASE WHEN e.k%3=1 THEN 'e'||e.k END AS evidence_id, CASE WHEN e.k%3=1 THEN (e.k%30)::INTEGER END AS page
FROM ev e WHERE e.k%3<>2 AND NOT EXISTS (SELECT 1 FROM t WHERE t.document_id=e.document_id AND t.path='img/'||e.k||'.png')"""


@query("image_to_evidence", None, STRUCTURE_TASKS)
def _(spark, d):
    return J.image_to_evidence(image_list(spark, d), mixed_evidence(spark, d))


@query("structure_tasks", None, f"""
SELECT document_id, 'st-'||substr(sha256('structure|'||path),1,32) AS task_id, substr(path,5)||coalesce('; page '||page,'') AS context, evidence_id FROM ({STRUCTURE_TASKS})""")
def _(spark, d):
    rows = J.structure_tasks(image_list(spark, d), mixed_evidence(spark, d))
    return rows.select("document_id", "task_id", F.col("assets.images")[0]["context"].alias("context"), F.get("evidence_ids", F.lit(0)).alias("evidence_id"))


@query("fallback_tasks", "tabled", TABLES + """
SELECT document_id, 'tx-'||substr(sha256('text|'||document_id),1,32) AS task_id, 'text' AS kind, markdown AS content FROM tabled
UNION ALL SELECT document_id, 'tt-'||substr(sha256('table|markdown:'||table_number),1,32), 'table', text FROM tabs""")
def _(spark, d):
    none = J.text_tasks(spark.createDataFrame([], EVIDENCE))
    rows = J.fallback_tasks(T.table_documents(spark, d), none, none)
    return rows.select("document_id", "task_id", "kind", F.col("assets.text").alias("content"))


@query("adjudication_tasks", "rcd evid", """
SELECT r.document_id, r.reaction_id, 'ad-'||substr(sha256('adjudication|'||r.reaction_id),1,32) AS task_id, e1 AS first_evidence,
 (SELECT count(*) FROM evid e WHERE e.document_id=r.document_id AND e.evidence_id IN (r.e1, r.e2)) AS n_evidence
FROM rcd r WHERE review_status='needs_review' AND NOT has_error""")
def _(spark, d):
    rows = J.adjudication_tasks(T.records(spark, d), T.evidence(spark, d))
    found = F.from_json("assets.text", "evidence array<struct<evidence_id:string>>, record struct<reaction_id:string>")
    return rows.select(
        "document_id", found["record"]["reaction_id"].alias("reaction_id"), "task_id", F.col("evidence_ids")[0].alias("first_evidence"),
        F.size(found["evidence"]).cast("bigint").alias("n_evidence"),
    )


# --- the whole chain ------------------------------------------------------------

def given_answers(tasks):
    """Answers of this query's text tasks, one reaction each, from the length of the text; other tasks wait."""
    n = F.length("assets.text")
    product = F.concat(T.text('{"label":"b', n % 3, '"'), F.when(n % 3 == 0, ',"smiles":"P"').otherwise(""), F.lit("}"))
    body = T.text('{"reactions":[{"reactants":[{"label":"a', n % 7, '","smiles":"R"}],"products":[', product, '],"confidence":0.9}]}')
    return tasks.filter("kind = 'text'").select("document_id", "task_id", body.alias("answer"))


def chain(spark, d):
    plain = T.load(spark, d, "documents").select(T.text("doc-", F.col("doc_id")).alias("document_id"), F.col("text").alias("markdown"))
    return X.run_documents(T.page_documents(spark, d).unionByName(plain), given_answers, T.PARSER)


CHAIN = f"""
WITH docs AS (SELECT 'conv-'||conv_id||'-'||(turn//100) AS document_id, 'text-p'||(turn+1) AS ev, {TRIM.format(PAGE)} AS content FROM conversations
 UNION ALL SELECT 'doc-'||doc_id, 'text-document', text FROM documents),
parts AS (SELECT document_id, ev, content, unnest(range(0, ceil(length(content)/50000.0)::INTEGER)) AS i FROM docs WHERE {TRIM.format('content')}<>''),
cnd AS (SELECT document_id, ev, length(substr(content, i*50000+1, 50000)) AS n FROM parts),
grp AS (SELECT document_id, n%7 AS a, n%3 AS b, count(*) AS n_candidates, count(DISTINCT ev) AS n_evidence FROM cnd GROUP BY ALL)
"""


@query("run_documents", None, CHAIN + """
SELECT d.document_id, count(g.a) AS records_count, count(*) FILTER (g.b<>0) AS review_count,
 CASE WHEN count(g.a)=0 THEN 'completed_empty' WHEN count(*) FILTER (g.b<>0)>0 THEN 'partial' ELSE 'success' END AS status
FROM (SELECT DISTINCT document_id FROM docs) d LEFT JOIN grp g ON g.document_id=d.document_id GROUP BY d.document_id""")
def _(spark, d):
    return chain(spark, d).status


@query("run_records", None, CHAIN + """
SELECT document_id, 'a'||a AS reactant, 'b'||b AS product, n_candidates, n_evidence, CASE WHEN b=0 THEN 'accepted' ELSE 'needs_review' END AS review_status FROM grp""")
def _(spark, d):
    rows = chain(spark, d).assembly.records
    return rows.select(
        "document_id", F.col("sig_reactants")[0].alias("reactant"), F.col("sig_products")[0].alias("product"),
        "n_candidates", F.col("n_evidence").cast("bigint").alias("n_evidence"), "review_status",
    )


# --- answers --------------------------------------------------------------------

ANSWERED = """
WITH a AS (SELECT *, concat_ws('-','tx',l_orderkey,l_linenumber,l_partkey,l_suppkey) AS task_id, 'doc-'||(l_orderkey%10) AS document_id FROM lineitem JOIN part ON l_partkey=p_partkey)"""


@query("parse_model_answers", None, ANSWERED + """
SELECT document_id, task_id, l_orderkey%50<>0 AS parsed, CASE WHEN l_orderkey%50=0 THEN 'answer contained incomplete or malformed JSON' END AS error FROM a""")
def _(spark, d):
    rows = N.parse_model_answers(T.answers(spark, d))
    return rows.select("document_id", "task_id", F.col("payload").isNotNull().alias("parsed"), "error")


@query("reaction_candidates", None, ANSWERED + """
SELECT document_id, task_id, p_name||'/'||p_size AS reactant, p_type AS product, 'water|'||l_linenumber AS solvents, trunc(l_quantity)::DOUBLE AS temperature_c,
 trunc(round(l_tax*1000,1))::DOUBLE AS yield_pct, round(1-4*l_discount,2) AS confidence, 'O'||l_orderkey AS evidence FROM a WHERE l_orderkey%50<>0""")
def _(spark, d):
    parsed = N.parse_model_answers(T.answers(spark, d)).drop("answer", "error")
    rows = N.reaction_candidates(parsed)
    return rows.select(
        "document_id", "task_id", F.col("reactants")[0]["label"].alias("reactant"), F.col("products")[0]["label"].alias("product"),
        F.array_join("solvents", "|").alias("solvents"), "temperature_c", "yield_pct", "confidence", F.col("evidence_ids")[0].alias("evidence"),
    )


@query("structure_candidates", None, """
SELECT p_partkey, CASE p_partkey%3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE p_partkey::VARCHAR END AS label, p_type AS smiles,
 CASE WHEN p_partkey%4=0 THEN 0.25 ELSE 0.5 END::DOUBLE AS confidence FROM part WHERE p_partkey%5<>0 AND p_partkey%7<>0""")
def _(spark, d):
    k = F.col("p_partkey")
    label = F.when(k % 3 == 0, T.text('"compound_label":"', F.col("p_name"), '"')).when(k % 3 == 1, T.text('"label":"', F.col("p_brand"), '"')).otherwise(T.text('"compound_id":', k))
    smiles = F.when(k % 5 == 0, F.lit('"smiles":""')).otherwise(T.text(F.when(k % 2 == 0, '"smiles":"').otherwise('"canonical_smiles":"'), F.col("p_type"), '"'))
    confidence = F.when(k % 7 == 0, '"confidence":7').when(k % 4 == 0, '"confidence":"0.25"').otherwise('"confidence":null')
    payload = F.try_parse_json(F.concat(F.lit('{"structures":[{'), label, F.lit(","), smiles, F.lit(","), confidence, F.lit("}]}")))
    rows = T.load(spark, d, "part").select("p_partkey", payload.alias("payload"), F.array(T.text("e", k)).alias("evidence_ids"))
    return N.structure_candidates(rows).select("p_partkey", F.col("compound_label").alias("label"), "smiles", "confidence")


# --- contracts ------------------------------------------------------------------

def submission_lines(spark, d):
    """order rows as submission lines with planted faults."""
    k = F.col("o_orderkey")
    task = F.when(k % 11 == 0, F.lit("")).when(k % 11 == 1, F.lit('"task_id":5,')).otherwise(T.text('"task_id":"t', k, '",'))
    producer = (
        F.when(k % 7 == 0, '"producer":"me",').when(k % 7 == 1, '"producer":{"kind":"robot"},').when(k % 7 == 2, '"producer":{"kind":"human","extra":1},')
        .when(k % 7 == 3, '"producer":{"kind":"human","attempt":0},').otherwise('"producer":{"kind":"host_agent","model":"m","attempt":2},')
    )
    outputs = (
        F.when(k % 13 == 0, '"outputs":[]').when(k % 13 == 1, '"outputs":[{"reactants":[{"label":"a","smiles":null}],"yield":180}]')
        .when(k % 13 == 2, '"outputs":[{"smiles":" "}]').when(k % 13 == 3, '"outputs":[{"candidate_id":"x","label":"a","smiles":"C"}]')
        .when(k % 13 == 4, '"outputs":[{"products":[],"solvents":["w",3],"confidence":2}]')
        .otherwise('"outputs":[{"label":"a \\"candidate_id\\": b","smiles":"C"}]')
    )
    return T.load(spark, d, "orders").select(k.alias("line"), F.concat(F.lit("{"), task, producer, outputs, F.lit("}")).alias("value"))


CONTRACT = """
SELECT k AS line, error FROM (SELECT o_orderkey AS k FROM orders) o, LATERAL (VALUES
 (k%11=0, 'missing ''task_id'''), (k%11=1, '''task_id'' must be a string'),
 (k%7=0, 'missing or invalid ''producer'' block'), (k%7=1, '''producer.kind'' must be ''human'' or ''host_agent'''), (k%7=2, 'unknown producer fields extra'),
 (k%7=3, '''producer.attempt'' must be an integer >= 1'), (k%13=0, '''outputs'' must be a non-empty array'),
 (k%13=1, 'outputs[0].reactants[0] missing ''role'''), (k%13=1, 'outputs[0].yield_pct is outside 0..100'),
 (k%13=2, 'outputs[0] missing a label key'), (k%13=2, 'outputs[0].smiles must be a non-empty string'), (k%13=3, 'forbidden key ''candidate_id'''),
 (k%13=4, 'outputs[0].solvents[1] must be a string'), (k%13=4, 'outputs[0].confidence is outside 0..1')) t(hit, error) WHERE hit"""


@query("submission_contract", None, CONTRACT)
def _(spark, d):
    good, _ = L.parse_json_lines(submission_lines(spark, d))
    return K.submission_contract(good)


@query("adjudication_contract", None, """
SELECT k AS line, error FROM (SELECT o_orderkey AS k FROM orders) o, LATERAL (VALUES
 (k%3=0, '''decision'' must be ''accept'' or ''keep_review'''), (k%5=0, '''rationale'' must be a string'), (k%7=0, 'missing ''reaction_id''')) t(hit, error) WHERE hit""")
def _(spark, d):
    k = F.col("o_orderkey")
    value = F.concat(
        T.text('{"task_id":"t', k, '",'), F.when(k % 7 != 0, T.text('"reaction_id":"r', k, '",')).otherwise(F.lit("")),
        F.when(k % 3 == 0, '"decision":"maybe",').otherwise('"decision":"accept",'), F.when(k % 5 == 0, '"rationale":5,').otherwise('"rationale":null,'),
        F.lit('"producer":{"kind":"human"}}'),
    )
    good, _ = L.parse_json_lines(T.load(spark, d, "orders").select(k.alias("line"), value.alias("value")))
    return K.submission_contract(good, "adjudications")


@query("forbid_key", None, "SELECT o_orderkey AS line FROM orders WHERE o_orderkey%13=3")
def _(spark, d):
    good, _ = L.parse_json_lines(submission_lines(spark, d))
    return K.forbid_key(good).select("line")


@query("record_domain_checks", None, """
SELECT 'r'||k AS reaction_id, error FROM (SELECT o_orderkey AS k FROM orders) o, LATERAL (VALUES
 (k%11<>0 AND k%100>95, 'yield_pct outside 0..100'), (k%100>90, 'confidence outside 0..1'), (k%17=0, 'review_status not allowed')) t(hit, error) WHERE hit""")
def _(spark, d):
    k = F.regexp_extract("reaction_id", r"\d+", 0).cast("bigint")
    r = T.records(spark, d).withColumn("yield_pct", F.when(k % 100 > 95, F.col("yield_pct") + 100).otherwise(F.col("yield_pct")))
    r = r.withColumn("confidence", F.when(k % 100 > 90, F.lit(1.5)).otherwise(F.col("confidence")))
    r = r.withColumn("review_status", F.when(k % 17 == 0, "maybe").otherwise(F.col("review_status")))
    return K.record_domain_checks(r).select("reaction_id", "error")


@query("decision_domain_checks", "dec", """
SELECT decision_id, error FROM dec, LATERAL (VALUES (ord%41=0, 'reviewer must be non-empty'),
 (ord%43=0 AND conclusion IN ('pending','not_applicable','insufficient_evidence'), 'reason is required'), (ord%47=0, 'target_kind not allowed')) t(hit, error) WHERE hit""")
def _(spark, d):
    n = F.col("ord")
    dec = T.decisions(spark, d).withColumn("reviewer", F.when(n % 41 == 0, " ").otherwise(F.col("reviewer")))
    dec = dec.withColumn("reason", F.when(n % 43 != 0, F.col("reason"))).withColumn("target_kind", F.when(n % 47 == 0, "page").otherwise(F.col("target_kind")))
    return K.decision_domain_checks(dec).select("decision_id", "error")


# --- line sources ---------------------------------------------------------------

def written_lines(spark, df, name):
    """Lines written as text files, to be read back with their line numbers."""
    path = new_path(spark, name)
    df.select("value").write.text(path)
    return path


LINE_COUNTS = """
SELECT count(*) AS n_rows, sum(k)::BIGINT AS key_sum, (SELECT count(*) FROM orders WHERE o_orderkey%50=0)::BIGINT AS n_errors,
 (SELECT count(*) FROM orders WHERE o_orderkey%50<>1)::BIGINT AS n_numbered FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey%50>1)"""


@query("read_jsonl_strict", None, LINE_COUNTS)
def _(spark, d):
    k = F.col("o_orderkey")
    value = F.when(k % 50 == 0, T.text('{"k":', k)).when(k % 50 == 1, "  ").otherwise(T.text('{"k":', k, "}"))
    path = written_lines(spark, T.load(spark, d, "orders").select(value.alias("value")), "jsonl")
    good, errors = L.read_jsonl_strict(spark, path)
    rows = good.select("file", "line", F.try_variant_get("value", F.lit("$.k"), "long").alias("k"), F.lit(0).alias("bad")).unionByName(
        errors.select("file", "line", F.lit(None).cast("bigint").alias("k"), F.lit(1).alias("bad"))
    )
    numbered = rows.groupBy("file", "line").agg(F.sum("k").alias("k"), F.sum("bad").alias("bad"), F.count("*").alias("n"))
    return numbered.agg(
        F.sum(F.when(F.col("bad") == 0, F.col("n"))).alias("n_rows"), F.sum("k").alias("key_sum"), F.sum("bad").alias("n_errors"), F.count("*").alias("n_numbered")
    )


def gold_lines(spark, d):
    k = F.col("o_orderkey")
    status = F.when(k % 19 == 0, "maybe").otherwise("accepted")
    extra = F.when(k % 23 == 0, ',"note":1').otherwise("")
    value = T.text('{"schema_version":"1.0","reaction_id":"r', k, '","reactants":[{"label":"C', F.col("o_custkey"), '"}],"confidence":', F.when(k % 29 == 0, "1.5").otherwise("0.5"), ',"review_status":"', status, '"', extra, "}")
    return T.load(spark, d, "orders").select(F.lit("gold.jsonl").alias("file"), k.alias("line"), F.when(k % 31 == 0, "{").otherwise(value).alias("value"))


@query("read_gold", None, """
SELECT o_orderkey AS line, 'r'||o_orderkey AS reaction_id, 'C'||o_custkey AS label, 'accepted' AS review_status FROM orders
WHERE o_orderkey%19<>0 AND o_orderkey%23<>0 AND o_orderkey%29<>0 AND o_orderkey%31<>0""")
def _(spark, d):
    good, _ = L.gold_rows(gold_lines(spark, d))
    return good.select("line", "reaction_id", F.col("reactants")[0]["label"].alias("label"), "review_status")


@query("gold_errors", None, """
SELECT k AS line, error FROM (SELECT o_orderkey AS k FROM orders) o, LATERAL (VALUES (k%31=0, 'invalid JSON'), (k%31<>0 AND k%19=0, 'review_status not allowed'),
 (k%31<>0 AND k%23=0, 'unknown fields note'), (k%31<>0 AND k%29=0, 'confidence outside 0..1')) t(hit, error) WHERE hit""")
def _(spark, d):
    return L.gold_rows(gold_lines(spark, d))[1].select("line", "error")


@query("gold_source", None, """
SELECT 'gold-'||(o_orderkey//1000)||'.jsonl' AS file_name, count(*) AS entry_count, '1.0' AS gold_schema_version, sha256(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS file_hash
FROM orders GROUP BY o_orderkey//1000""")
def _(spark, d):
    k = F.col("o_orderkey")
    path = T.text("/gold/gold-", F.floor(k / 1000), ".jsonl")
    o = T.load(spark, d, "orders")
    content = F.encode(F.array_join(F.array_sort(F.collect_list(k)), ","), "UTF-8")
    files = o.groupBy(path.alias("path")).agg(content.alias("content"))
    records = o.select(path.alias("file"), k.alias("line"), F.lit("1.0").alias("schema_version"))
    return L.gold_source(files, records).select("file_name", "entry_count", "gold_schema_version", "file_hash")


@query("read_submissions", None, """
SELECT CASE WHEN o_orderkey%11>1 THEN 't'||o_orderkey WHEN o_orderkey%11=1 THEN '5' END AS task_id, CASE o_orderkey%7 WHEN 0 THEN NULL WHEN 1 THEN 'robot' WHEN 2 THEN 'human' WHEN 3 THEN 'human' ELSE 'host_agent' END AS producer_kind,
 CASE WHEN o_orderkey%13=0 THEN 0 ELSE 1 END::INTEGER AS n_outputs FROM orders""")
def _(spark, d):
    path = written_lines(spark, submission_lines(spark, d), "submissions")
    rows, _ = L.read_submissions(spark, path)
    return rows.select("task_id", F.col("producer.kind").alias("producer_kind"), F.size(F.try_variant_get("outputs", F.lit("$"), "array<variant>")).alias("n_outputs"))


@query("read_external_structures", None, """
SELECT p_partkey AS line, CASE WHEN p_partkey%2=0 THEN 's'||p_partkey END AS given_id, p_name AS compound_label, p_type AS smiles,
 CASE WHEN p_partkey%2=0 THEN 'e1' ELSE 'manual-line-'||p_partkey END AS evidence FROM part""")
def _(spark, d):
    k = F.col("p_partkey")
    full = T.text('{"candidate_id":"s', k, '","compound_label":"', F.col("p_name"), '","smiles":"', F.col("p_type"), '","evidence_ids":["e1"]}')
    short = T.text('{"label":"', F.col("p_name"), '","smiles":"', F.col("p_type"), '"}')
    lines = T.load(spark, d, "part").select(k.alias("line"), F.when(k % 2 == 0, full).otherwise(short).alias("value"))
    rows = L.external_structures(L.parse_json_lines(lines)[0])
    given = F.when(~F.startswith("candidate_id", F.lit("structure-")), F.col("candidate_id"))
    return rows.select("line", given.alias("given_id"), "compound_label", "smiles", F.col("evidence_ids")[0].alias("evidence"))


# --- files ----------------------------------------------------------------------

def page_files(spark, d):
    """Every page as a file, and one page in ten as a second file with the same content."""
    k = F.col("page_id")
    folders = F.when(k % 10 == 0, F.array(F.lit("/pages/"), F.lit("/copies/"))).otherwise(F.array(F.lit("/pages/")))
    rows = T.load(spark, d, "pages").withColumn("folder", F.explode(folders))
    return rows.select(T.text(F.col("folder"), k, ".html").alias("path"), F.encode("html", "UTF-8").alias("content"))


PAGE_FILES = """
WITH files AS (SELECT '/pages/'||page_id||'.html' AS path, sha256(html) AS sha256 FROM pages
 UNION ALL SELECT '/copies/'||page_id||'.html', sha256(html) FROM pages WHERE page_id%10=0)
"""


@query("file_digest", None, PAGE_FILES + """
SELECT path, sha256, CASE WHEN row_number() OVER (PARTITION BY sha256 ORDER BY path)>1 OR sha256 IN (SELECT sha256(html) FROM pages WHERE page_id%7=1)
 THEN 'duplicate' ELSE 'applied' END AS status FROM files""")
def _(spark, d):
    seen = T.load(spark, d, "pages").filter("page_id % 7 = 1").select(F.sha2("html", 256).alias("sha256"))
    return S.file_digests(page_files(spark, d), seen)


@query("document_id", None, PAGE_FILES + "SELECT path, substr(sha256,1,16) AS document_id FROM files")
def _(spark, d):
    return S.document_ids(page_files(spark, d))


def part_files(spark, d):
    k = F.col("p_partkey")
    suffix = F.when(k % 4 == 0, ".PNG").when(k % 4 == 1, ".jpeg").when(k % 4 == 2, ".txt").otherwise(".webp")
    stem = F.when(k % 3 == 0, T.text("fig_page-", k % 50)).when(k % 3 == 1, T.text("P", k % 9)).otherwise(T.text("x", k))
    return T.load(spark, d, "part").select(T.text("doc-", k % 10).alias("document_id"), T.text("/img/", F.lpad(k.cast("string"), 9, "0"), "/", stem, suffix).alias("path"))


@query("image_evidence", None, """
SELECT document_id, 'image-'||lpad(rn::VARCHAR, greatest(4, length(rn::VARCHAR))::INTEGER, '0') AS evidence_id, page, path AS source_path FROM (
 SELECT 'doc-'||(p_partkey%10) AS document_id, row_number() OVER (PARTITION BY p_partkey%10 ORDER BY p_partkey) AS rn,
  (CASE p_partkey%3 WHEN 0 THEN p_partkey%50 WHEN 1 THEN p_partkey%9 END)::INTEGER AS page,
  '/img/'||lpad(p_partkey::VARCHAR,9,'0')||'/'||CASE p_partkey%3 WHEN 0 THEN 'fig_page-'||(p_partkey%50) WHEN 1 THEN 'P'||(p_partkey%9) ELSE 'x'||p_partkey END
  ||CASE p_partkey%4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpeg' ELSE '.webp' END AS path FROM part WHERE p_partkey%4<>2)""")
def _(spark, d):
    rows = S.image_evidence(part_files(spark, d))
    return rows.select("document_id", "evidence_id", "page", "source_path")


@query("pick_layout_file", None, """
WITH f AS (SELECT o_custkey%97 AS g, o_orderkey%(2+o_custkey%97%5) AS v, o_orderkey FROM orders),
n AS (SELECT DISTINCT g, CASE WHEN g%4=0 THEN 'paper_content_list.json' WHEN g%4=1 AND v=0 THEN 'x_content_list_v2.json' WHEN g%4=2 AND v=0 THEN 'doc'||g||'_a.json' ELSE 'other'||v||'.json' END AS name FROM f),
c AS (SELECT g, count(*) AS n, min(name) AS one, count(*) FILTER (name LIKE '%\\_content\\_list\\_v2.json' ESCAPE '\\') AS n2, min(name) FILTER (name LIKE '%\\_content\\_list\\_v2.json' ESCAPE '\\') AS v2,
 count(*) FILTER (contains(name,'doc'||g)) AS ns, min(name) FILTER (contains(name,'doc'||g)) AS sn FROM n GROUP BY g)
SELECT 'doc'||g AS document_id, CASE WHEN n=1 THEN one WHEN n2=1 THEN v2 WHEN ns=1 THEN sn END AS path,
 CASE WHEN n>1 AND n2<>1 AND ns<>1 THEN CASE WHEN ns>1 THEN 'several layout files match the name' ELSE 'several layout files found' END END AS error FROM c""")
def _(spark, d):
    g = F.col("o_custkey") % 97
    v = F.col("o_orderkey") % (g % 5 + 2)
    name = (
        F.when(g % 4 == 0, "paper_content_list.json").when((g % 4 == 1) & (v == 0), "x_content_list_v2.json")
        .when((g % 4 == 2) & (v == 0), T.text("doc", g, "_a.json")).otherwise(T.text("other", v, ".json"))
    )
    files = T.load(spark, d, "orders").select(T.text("doc", g).alias("document_id"), T.text("doc", g).alias("stem"), name.alias("path")).distinct()
    return S.pick_layout_file(files)


def layout_files(spark, d):
    k = F.col("p_partkey")
    row = F.concat(
        T.text('{"type":"', F.when(k % 4 == 3, "text").when(k % 2 == 0, "table").otherwise("image"), '"'),
        F.when(k % 3 == 0, T.text(',"page_idx":', k % 12)).otherwise(T.text(',"page":', k % 12)),
        F.when(k % 5 == 0, F.lit(',"bbox":[1,2,3]')).otherwise(T.text(',"bbox":[1,2,3.5,', k % 10, "]")),
        T.text(',"img_path":"', F.when(k % 6 == 0, "images/").otherwise("up/"), k, '.png","text":"","table_body":"', F.col("p_name"), '"}'),
    )
    content = F.when(k % 7 == 0, F.concat(F.lit('{"content_list":['), row, F.lit("]}"))).when(k % 11 == 0, F.lit("[{")).otherwise(F.concat(F.lit("["), row, F.lit("]")))
    return T.load(spark, d, "part").select(T.text("doc-", k).alias("document_id"), T.text("/d/", k, "/auto/layout.json").alias("path"), content.alias("content"))


LAYOUT = """
SELECT 'doc-'||p_partkey AS document_id, 'layout-0000' AS evidence_id, CASE WHEN p_partkey%2=0 THEN 'table' ELSE 'image' END AS kind,
 (CASE WHEN p_partkey%3=0 THEN p_partkey%12+1 ELSE p_partkey%12 END)::INTEGER AS page, p_name AS text,
 CASE WHEN p_partkey%5<>0 THEN (p_partkey%10)::DOUBLE END AS y1, p_partkey AS k FROM part WHERE p_partkey%4<>3 AND (p_partkey%11<>0 OR p_partkey%7=0)"""


@query("read_layout", None, f"SELECT document_id, evidence_id, kind, page, text, y1 FROM ({LAYOUT})")
def _(spark, d):
    rows = S.layout_rows(layout_files(spark, d))
    return rows.select("document_id", "evidence_id", "kind", "page", "text", F.get("bbox", F.lit(3)).alias("y1"))


@query("resolve_asset", None, f"""
SELECT document_id, CASE WHEN k%6=0 AND k%2=0 THEN '/d/'||k||'/auto/images/'||k||'.png' WHEN k%6<>0 AND k%5=0 THEN '/d/'||k||'/up/'||k||'.png' END AS asset_path FROM ({LAYOUT})""")
def _(spark, d):
    k = F.col("p_partkey")
    part = T.load(spark, d, "part")
    near = part.filter(k % 2 == 0).select(T.text("/d/", k, "/auto/images/", k, ".png").alias("path"))
    above = part.filter(k % 5 == 0).select(T.text("/d/", k, "/up/", k, ".png").alias("path"))
    return S.resolve_assets(S.layout_rows(layout_files(spark, d)), near.unionByName(above)).select("document_id", "asset_path")


# --- sinks ----------------------------------------------------------------------

@query("write_jsonl", "rcd", "SELECT document_id, reaction_id, temperature_c, r_label AS label FROM rcd")
def _(spark, d):
    path = new_path(spark, "records-jsonl")
    r = T.records(spark, d)
    O.write_jsonl(r, path)
    return spark.read.schema(RECORD).json(path).select("document_id", "reaction_id", "temperature_c", F.col("reactants")[0]["label"].alias("label"))


@query("append_sidecar", "dec", "SELECT document_id, count(*) AS n, sum(ord)::BIGINT AS ord_sum FROM dec GROUP BY ALL")
def _(spark, d):
    path = new_path(spark, "sidecar")
    dec = T.decisions(spark, d)
    O.append_sidecar(dec.filter("ord % 2 = 0"), path)
    O.append_sidecar(dec.filter("ord % 2 = 1"), path)
    return spark.read.schema(dec.schema).parquet(path).groupBy("document_id").agg(F.count("*").alias("n"), F.sum("ord").alias("ord_sum"))


@query("write_outputs", "rcd", """
SELECT 'records' AS output, count(*) AS n FROM rcd UNION ALL SELECT 'review', count(*) FROM rcd WHERE review_status='needs_review'""")
def _(spark, d):
    path = new_path(spark, "outputs")
    O.write_outputs(T.records(spark, d), path)
    names = {"records": "records_jsonl", "review": "review_jsonl"}
    read = [spark.read.schema(RECORD).json(f"{path}/{folder}").select(F.lit(n).alias("output")) for n, folder in names.items()]
    return read[0].unionByName(read[1]).groupBy("output").agg(F.count("*").alias("n"))


@query("read_table_or_empty", "evid", "SELECT document_id, evidence_id, FALSE AS corrected FROM evid")
def _(spark, d):
    path = new_path(spark, "evidence")
    e = T.evidence(spark, d)
    e.write.parquet(path)
    there = O.read_table_or_empty(spark, path, e.schema)
    absent = O.read_table_or_empty(spark, new_path(spark, "absent"), e.schema)
    fixed = absent.select("document_id", "evidence_id", F.lit(True).alias("corrected"))
    return there.join(fixed, ["document_id", "evidence_id"], "left").select("document_id", "evidence_id", F.coalesce("corrected", F.lit(False)).alias("corrected"))


# --- streams --------------------------------------------------------------------

def stream_folder(spark, d):
    k = F.col("o_orderkey")
    value = F.when(k % 40 == 0, "{").otherwise(T.text('{"document_id":"doc-', k % 5000 % 10, '","task_id":"t', F.floor(k % 5000 / 10), '","producer":{"kind":"human"},"outputs":[{"v":', k % 2, "}]}"))
    path = new_path(spark, "stream")
    T.load(spark, d, "orders").select(value.alias("value")).repartition(4, "value").write.text(path)
    return path


def run_to_table(spark, stream, name):
    target, checkpoint = new_path(spark, name), new_path(spark, f"{name}-state")
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


@query("submission_stream", None, """
SELECT CASE WHEN o_orderkey%40=0 THEN NULL ELSE 'doc-'||(o_orderkey%5000%10) END AS document_id, CASE WHEN o_orderkey%40=0 THEN NULL ELSE 't'||(o_orderkey%5000//10) END AS task_id, CASE WHEN o_orderkey%40=0 THEN 'invalid JSON' END AS error, count(*) AS n FROM orders GROUP BY ALL""")
def _(spark, d):
    stream = Z.submission_stream(spark, stream_folder(spark, d)).select("document_id", "task_id", "error", "submission_hash")
    return run_to_table(spark, stream, "arrived").groupBy("document_id", "task_id", "error").agg(F.count("*").alias("n"))


@query("submission_stream_errors", None, """
SELECT o_orderkey AS k, 'invalid JSON' AS error, true AS same FROM orders WHERE o_orderkey%40=0""")
def _(spark, d):
    """Error lines of the stream, found again by file and line in a plain read of the folder."""
    k = F.col("o_orderkey")
    value = F.when(k % 40 == 0, T.text('{"broken ', k)).when(k % 7 == 0, " ").otherwise(T.text('{"task_id":"t', k, '"}'))
    path, target, checkpoint = (new_path(spark, n) for n in ("stream", "taken", "taken-state"))
    T.load(spark, d, "orders").select(value.alias("value")).repartition(4, "value").write.text(path)
    Z.take_submissions(spark, path, target, checkpoint, files_per_trigger=2).awaitTermination()
    errors = spark.read.parquet(f"{target}/errors").select("file", "line", "error")
    found = errors.join(L.read_lines(spark, path), ["file", "line"], "left")
    number = F.regexp_extract("value", r"broken (\d+)", 1)
    return found.select(number.cast("bigint").alias("k"), "error", (F.length(number) > 0).alias("same"))


@query("dedup_submissions", None, """
SELECT 'doc-'||(o_orderkey%5000%10) AS document_id, 't'||(o_orderkey%5000//10) AS task_id, count(DISTINCT o_orderkey%2) AS n FROM orders WHERE o_orderkey%40<>0 GROUP BY ALL""")
def _(spark, d):
    path, state = new_path(spark, "deduplicated"), new_path(spark, "deduplicated-state")
    stream = Z.good_rows(Z.submission_stream(spark, stream_folder(spark, d), files_per_trigger=2))
    Z.dedup_submissions(stream, path, state).awaitTermination()
    return spark.read.parquet(path).groupBy("document_id", "task_id").agg(F.count("*").alias("n"))


@query("live_task_board", None, """
WITH t AS (SELECT DISTINCT o_orderkey%6000 AS k FROM orders), a AS (SELECT DISTINCT o_orderkey%5000 AS k FROM orders WHERE o_orderkey%40<>0)
SELECT 'doc-'||(t.k%10) AS document_id, CASE WHEN t.k%2=0 THEN 'text' ELSE 'table' END AS kind,
 count(*) FILTER (a.k IS NULL) AS awaiting, count(*) FILTER (a.k IS NOT NULL) AS fulfilled FROM t LEFT JOIN a ON a.k=t.k GROUP BY ALL""")
def _(spark, d):
    k = F.col("o_orderkey") % 6000
    tasks = T.load(spark, d, "orders").select(k.alias("k")).select(
        T.text("doc-", F.col("k") % 10).alias("document_id"), T.text("t", F.floor(F.col("k") / 10)).alias("task_id"), F.when(F.col("k") % 2 == 0, "text").otherwise("table").alias("kind")
    )
    folder, board, state = (new_path(spark, n) for n in ("tasks", "board", "board-state"))
    tasks.repartition(3, "task_id").write.parquet(folder)
    stream = Z.good_rows(Z.submission_stream(spark, stream_folder(spark, d), files_per_trigger=2))
    arriving = spark.readStream.schema(tasks.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    Z.live_task_board(stream, arriving, board, state, compact_every=2).awaitTermination()
    return Z.latest_board(spark, board)
