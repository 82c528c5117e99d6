"""Views that shape the supplied order, part, event and conversation tables like the
package's own inputs, so each operator can run over whole tables of any size."""

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import COMPOUND

EMPTY_STRINGS = "array<string>"


BIG_TABLES = ("lineitem", "orders")
PART = 1 << 19  # rows of a big table that one task takes


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table; a big one that comes as few files is spread over the cores, and so that no task takes more than
    PART rows: what a task sorts or holds stays the same however large the table is."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in BIG_TABLES:
        parts = max(spark.sparkContext.defaultParallelism, -(-table.count() // PART))
        if len(table.inputFiles()) < parts:
            return table.repartition(parts)
    return table


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def compound(label=None, name=None, smiles=None, role="unknown") -> Column:
    get = lambda v: F.lit(None).cast("string") if v is None else v
    return F.struct(
        get(label).alias("label"), get(name).alias("name"), get(smiles).alias("smiles"), F.lit(role).alias("role")
    ).cast(COMPOUND)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x part as reaction candidates."""
    c = F.col
    own = F.when(c("l_linenumber") == 7, text("own-", c("p_type"))).when(
        c("l_linenumber") == 6, text("bad(", c("p_type"))
    )
    line = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
        "l_discount", "l_tax", "l_quantity",
    )
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_type")
    return line.join(part, c("l_partkey") == c("p_partkey")).select(
        text("doc-", c("l_orderkey") % 10).alias("document_id"),
        F.concat_ws("-", F.lit("li"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c("l_quantity").cast("int")).alias("candidate_id"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("ord"),
        F.when(c("l_returnflag") == "R", "text").when(c("l_returnflag") == "N", "table").otherwise("scheme").alias("source"),
        F.array(compound(text(c("p_name"), "/", c("p_size")), smiles=own, role="reactant")).alias("reactants"),
        F.array(compound(c("p_type"), role="product")).alias("products"),
        F.array(text("reagent-", c("l_suppkey") % 5), c("l_linestatus")).alias("reagents"),
        F.array(text("solvent-", c("l_partkey") % 3)).alias("solvents"),
        c("l_quantity").alias("temperature_c"),
        text(c("l_linenumber"), " h").alias("time"),
        F.round(c("l_tax") * 1000, 1).alias("yield_pct"),
        F.array(text("O", c("l_orderkey"))).alias("evidence_ids"),
        F.round(1 - 4 * c("l_discount"), 2).alias("confidence"),
    )


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One structure per (document, part), and per (document, part type) in even documents."""
    c = F.col
    line = load(spark, sf_dir, "lineitem").select((c("l_orderkey") % 10).alias("d"), "l_partkey").distinct()
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_type", "p_brand")
    used = line.join(part, c("l_partkey") == c("p_partkey"))
    smiles = F.when(c("p_size") % 10 == 0, text("bad(", c("p_brand"))).otherwise(
        text(c("p_brand"), "-", c("p_type"), "-", c("p_size"))
    )
    by_part = used.select(
        text("doc-", c("d")).alias("document_id"), text("s-", c("p_partkey")).alias("candidate_id"),
        text(c("p_name"), "/", c("p_size")).alias("compound_label"), smiles.alias("smiles"),
    )
    by_type = used.filter(c("d") % 2 == 0).select("d", "p_type").distinct().select(
        text("doc-", c("d")).alias("document_id"), text("t-", c("p_type")).alias("candidate_id"),
        c("p_type").alias("compound_label"), c("p_type").alias("smiles"),
    )
    both = by_part.unionByName(by_type)
    return both.select(
        "document_id", "candidate_id", c("candidate_id").alias("ord"), "compound_label", "smiles",
        F.array().cast(EMPTY_STRINGS).alias("evidence_ids"), F.lit(0.5).alias("confidence"),
    )


# Stand-in for a structure parser: texts starting with "bad(" do not parse, the rest
# is upper-cased; "@" marks stereo and a final 3 an open centre.
PARSER = {
    "iso": lambda raw: F.when(~raw.startswith("bad("), F.upper(raw)),
    "noniso": lambda raw: F.when(~raw.startswith("bad("), F.replace(F.upper(raw), F.lit("@"), F.lit(""))),
    "n_unspecified": lambda raw: F.when(~raw.startswith("bad("), raw.endswith("3").cast("int")),
}


def pandas_parser(raw: pd.Series) -> pd.DataFrame:
    good = ~raw.str.startswith("bad(")
    iso = raw.str.upper().where(good)
    return pd.DataFrame({
        "iso": iso, "noniso": iso.str.replace("@", "", regex=False),
        "n_unspecified": raw.str.endswith("3").where(good).astype("Int32"),
    })


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as predicted records, one in twenty under an id and a label of its own."""
    c = F.col
    key = c("o_orderkey")
    alone = key % 20 == 1
    label = F.when(alone, text("Z", key)).otherwise(text("C", c("o_custkey")))
    base = text("C", c("o_custkey") % 5, "N")
    v = key % 9
    smiles = (
        F.when(v == 0, F.lit(None)).when(v == 1, "bad(x").when(v == 2, text(base, "@")).when(v == 3, text("[13", base, "+]"))
        .when(v == 4, text(base, ".[Cl-]")).when(v == 5, text("X", base)).otherwise(base)
    )
    return load(spark, sf_dir, "orders").select(
        text("doc-", c("o_custkey") % 10).alias("document_id"), key.alias("ord"), text(F.when(alone, "x").otherwise("r"), key).alias("reaction_id"),
        F.array(compound(label, smiles=smiles, role="reactant")).alias("reactants"),
        F.array(compound(c("o_orderpriority"), smiles=F.when(key % 2 == 1, text("P-", c("o_orderpriority"))), role="product")).alias("products"),
        F.round(c("o_totalprice") % 100, 2).alias("yield_pct"),
        c("o_orderstatus").alias("profile"),
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as benchmark records: unlike any other, other id, doubled or same id by key."""
    c = F.col
    key = c("o_orderkey")
    alone = key % 5 == 0
    label = F.when(alone, text("Y", key)).otherwise(text("C", c("o_custkey")))
    shift = F.when(key % 3 == 0, 0.0).when(key % 3 == 1, 0.5).otherwise(3.0)
    copies = F.when(key % 5 == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    smiles = F.when(key % 11 != 0, text("C", c("o_custkey") % 5, "N"))
    return load(spark, sf_dir, "orders").withColumn("copy", F.explode(copies)).select(
        text("doc-", c("o_custkey") % 10).alias("document_id"), (key * 2 + c("copy")).alias("ord"),
        text(F.when(alone, "a").when(key % 5 == 1, "g").otherwise("r"), key).alias("reaction_id"),
        F.array(compound(label, smiles=smiles, role="reactant")).alias("reactants"),
        F.array(compound(c("o_orderpriority"), smiles=F.when(key % 2 == 1, text("P-", c("o_orderpriority"))), role="product")).alias("products"),
        F.round(F.round(c("o_totalprice") % 100, 2) + shift, 2).alias("yield_pct"),
        c("o_orderstatus").alias("profile"),
    )


def participant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same-order compound lists with repeated labels and structure-only matches."""
    c = F.col
    key = c("o_orderkey")
    pick = lambda n, prefix: text(prefix, key % n)
    p = F.array(
        compound(pick(2, "a"), smiles=pick(3, "S"), role="reactant"), compound(pick(3, "A "), smiles=pick(2, "S"), role="reactant"),
        compound(name=pick(4, "n"), smiles=pick(5, "S"), role="reactant"), compound(smiles=pick(2, "U"), role="product"),
        compound(F.lit("a0"), smiles=F.lit("bad(y"), role="product"),
    )
    g = F.array(
        compound(pick(3, "A"), smiles=pick(2, "S"), role="reactant"), compound(pick(2, "a"), smiles=pick(4, "S"), role="reactant"),
        compound(name=pick(5, "m"), smiles=pick(3, "S"), role="reactant"), compound(smiles=pick(3, "U"), role="product"),
        compound(F.lit("a0"), smiles=pick(7, "S"), role="product"), compound(F.lit("extra"), role="reagent"),
    )
    return load(spark, sf_dir, "orders").select(
        key.alias("pair_id"), p.alias("predicted_compounds"), g.alias("gold_compounds")
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as review decisions."""
    c = F.col
    kind = (
        F.when(c("event_type") == "click", "condition").when(c("event_type") == "view", "participant_identity")
        .when((c("event_type") == "purchase") & (c("user_id") % 4 != 0), "reaction").when(c("event_type").isin("purchase", "signup"), "completeness").otherwise("stereo")
    )
    e = c("event_id")
    conclusion = (
        F.when(e % 397 == 0, "rejected").when(e % 31 == 0, "pending").when(e % 37 == 0, "insufficient_evidence")
        .when(e % 7 == 0, "not_applicable").otherwise("confirmed")
    )
    rows = load(spark, sf_dir, "events").withColumn("target_kind", kind).withColumn("conclusion", conclusion)
    rid = text("r", c("user_id"))
    return rows.select(
        text("doc-", c("user_id") % 10).alias("document_id"), e.alias("ord"), text("d", e).alias("decision_id"),
        rid.alias("reaction_id"), "target_kind",
        F.when(c("target_kind").isin("reaction", "completeness"), rid).otherwise(text(rid, ":", e % 3)).alias("target_id"),
        "conclusion",
        F.when(c("conclusion").isin("pending", "not_applicable", "insufficient_evidence"), "r").alias("reason"),
        text("u", c("user_id") % 3).alias("reviewer"),
        text("h", F.floor(c("user_id") / 2), "-", (e % 5 == 0).cast("int")).alias("record_hash"),
        c("ts").cast("string").alias("created_at"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as text evidence, one in fifty under an id that no record names."""
    c = F.col
    key = c("o_orderkey")
    return load(spark, sf_dir, "orders").select(
        text("doc-", key % 10).alias("document_id"), text(F.when(key % 50 == 0, "Q").otherwise("O"), key).alias("evidence_id"), F.lit("text").alias("kind"),
        (key % 20).cast("int").alias("page"), F.lit("orders.md").alias("source_path"),
        F.lit(None).cast("string").alias("asset_path"), c("o_orderpriority").alias("text"),
        F.lit(None).cast("array<double>").alias("bbox"),
    )


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as paged documents of at most a hundred turns."""
    c = F.col
    turn = F.concat(text("## Page ", c("turn") + 1), F.lit("\n"), c("text"))
    rows = load(spark, sf_dir, "conversations").withColumn("block", F.floor(c("turn") / 100)).groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))).alias("turns")
    )
    joined = F.array_join(F.transform("turns", lambda x: x["t"]), "\n")
    return rows.select(text("conv-", c("conv_id"), "-", c("block")).alias("document_id"), joined.alias("markdown"))


def table_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part rows as small markdown documents: one per thousand part keys and brand."""
    c = F.col
    line = text("| ", c("p_partkey"), " | ", c("p_name"), " |")
    rows = load(spark, sf_dir, "part").withColumn("block", F.floor(c("p_partkey") / 1000)).groupBy("block", "p_brand").agg(
        F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("t")))).alias("rows")
    )
    header = F.concat(text("Brand ", c("p_brand")), F.lit("\n| key | name |\n"), F.when(c("p_brand") != "Brand#3", F.lit("|---|---|\n")).otherwise(F.lit("")))
    body = F.array_join(F.transform("rows", lambda x: x["t"]), "\n")
    markdown = F.concat(header, body, F.lit("\nplain line\n| lone | row |\nend"))
    return rows.select(text("b", c("block"), "-", c("p_brand")).alias("document_id"), markdown.alias("markdown"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidates as raw model answers with varying key names, fences and cut texts."""
    c = F.col
    k = c("l_orderkey")
    line = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_discount"
    )
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_type")
    rows = line.join(part, c("l_partkey") == c("p_partkey"))
    product = F.when(k % 2 == 0, F.lit("product")).otherwise(F.lit("products"))
    share = F.when(k % 3 == 0, F.lit("yield")).otherwise(F.lit("yield_pct"))
    body = text(
        '{"reactions":[{"reactants":[{"label":"', c("p_name"), "/", c("p_size"), '"}],"', product, '":"', c("p_type"),
        '","solvent":"water; ', c("l_linenumber"), '","temperature":"', c("l_quantity").cast("int"), ' °C","', share, '":"',
        F.round(c("l_tax") * 1000, 1).cast("int"), '%","confidence":', F.round(1 - 4 * c("l_discount"), 2), "}]}",
    )
    cut = F.when(k % 50 == 0, F.substring(body, 1, 40)).otherwise(body)
    fenced = F.when(k % 4 == 0, text("```json\n", cut, "\n```")).otherwise(cut)
    told = F.when(k % 5 == 0, text("<think>", "{hm}", "</think>\nAnswer: ", fenced, " done")).otherwise(fenced)
    return rows.select(
        text("doc-", k % 10).alias("document_id"),
        F.concat_ws("-", F.lit("tx"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("task_id"),
        told.alias("answer"), F.lit("text").alias("source"), F.array(text("O", k)).alias("evidence_ids"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as finished records with every kind of gap."""
    c, k = F.col, F.col("o_orderkey")
    none = F.lit(None).cast("string")
    label = text("L", k % 50)
    smiles = F.when(k % 3 == 0, F.lit(None)).when(k % 7 == 0, "bad(z").otherwise(text("c", k % 5))

    def issue(code, severity, message):
        return F.struct(
            F.lit(code).alias("code"), F.lit(severity).alias("severity"), label.alias("target_id"),
            F.lit(message).alias("message"), none.alias("suggested_value"),
        )

    warning, error = issue("A002_STRUCTURE_MISSING", "warning", "missing"), issue("V005_LABEL_STRUCTURE_CONFLICT", "error", "conflict")
    found = F.array_compact(F.array(F.when(k % 3 == 0, warning), F.when(k % 7 == 0, error)))
    strings = "array<string>"
    return load(spark, sf_dir, "orders").select(
        text("doc-", k % 10).alias("document_id"), F.lit("1.0").alias("schema_version"), text("r", k).alias("reaction_id"),
        F.array(compound(label, smiles=smiles, role="reactant"), compound(name=text("N", k % 4), role="reactant")).alias("reactants"),
        F.array(compound(text("P", k % 20), smiles=F.lit("PP"), role="product")).alias("products"),
        F.when(k % 2 == 0, F.array(text("rg", k % 4))).otherwise(F.array().cast(strings)).alias("reagents"),
        F.array(text("sv", k % 3)).alias("solvents"),
        F.when(k % 4 != 0, (k % 90).cast("double")).alias("temperature_c"),
        F.when(k % 5 != 0, text(k % 6, " h")).alias("time"),
        F.when(k % 11 != 0, (k % 100).cast("double")).alias("yield_pct"),
        F.array(text("O", k), text("O", k + 10)).alias("evidence_ids"),
        F.round((k % 100) / 100, 2).alias("confidence"),
        F.when(k % 13 == 0, "rejected").when(F.size(found) > 0, "needs_review").otherwise("accepted").alias("review_status"),
        found.alias("issues"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem rows as open tasks."""
    c = F.col
    n = c("l_linenumber") % 3
    return load(spark, sf_dir, "lineitem").select(
        text("doc-", c("l_orderkey") % 10).alias("document_id"),
        F.concat_ws("-", F.lit("t"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c("l_quantity").cast("int")).alias("task_id"),
        F.when(n == 0, "text").when(n == 1, "table").otherwise("structure").alias("kind"),
        F.array(text("O", c("l_orderkey"))).alias("evidence_ids"), F.lit("1.0.0").alias("instruction_version"),
        c("l_suppkey").alias("supplier"), c("l_linestatus").alias("flag"),
    )


def task_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored state of the tasks of even suppliers."""
    rows = tasks(spark, sf_dir).filter("supplier % 2 = 0")
    producer = F.struct(
        F.when(F.col("supplier") % 4 == 0, "human").otherwise("host_agent").alias("kind"), text("client-", F.col("supplier")).alias("client_name"),
        F.lit("1").alias("client_version"), F.when(F.col("supplier") % 3 == 0, text("m", F.col("supplier"))).alias("model"),
        F.lit(None).cast("string").alias("policy"), F.lit(1).alias("attempt"),
    )
    return rows.select(
        "document_id", "task_id", "kind", F.lit("fulfilled").alias("status"), text("hash-", F.col("supplier")).alias("submission_hash"),
        producer.alias("producer"),
    )
