"""Enrichment and the findings graph as node and edge tables.

Every enrichment join is a broadcast of the knowledge base, so findings are not
shuffled for it.  Nodes are ``id, label, name, attrs``; edges ``src, dst, label``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..knowledge import KnowledgeBase
from ..session import cut_lineage, local_table, small
from .findings import check_positive, endpoints, latest

NODE_LABELS = ("Finding", "Endpoint", "CWE", "OWASP", "Mitigation", "AttackVector", "CodeExample")
EDGE_LABELS = ("found_at", "is_instance_of", "exploitable_via", "belongs_to", "fixed_by", "demonstrates", "targets")
#: Edges that lead to nodes of the knowledge base, of which there are few; the others lead to endpoints.
KNOWLEDGE_EDGES = ("is_instance_of", "exploitable_via", "belongs_to", "fixed_by", "demonstrates")
#: Where a finding was seen and what it looked like.
EVIDENCE = (
    "description", "url", "method", "client", "header", "field", "commit", "path", "location", "key", "original_length", "status",
)
STATS = ("findings", "endpoints", "cwes", "owasps", "mitigations", "attack_vectors", "code_examples")


# --- enrichment -------------------------------------------------------------


def with_cwe(findings: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """Add ``cwe_id``: the first mapping that lists the finding's type or its pattern."""
    spark = findings.sparkSession
    by = kb.type_cwe(spark)
    of_type = by.select(F.col("t").alias("type"), F.struct("ord", "cwe_id").alias("_by_type"))
    of_pattern = by.select(F.col("t").alias("pattern"), F.struct("ord", "cwe_id").alias("_by_pattern"))
    return (
        findings.join(of_type, "type", "left")
        .join(of_pattern, "pattern", "left")
        .withColumn("cwe_id", F.least("_by_type", "_by_pattern")["cwe_id"])
        .select(*findings.columns, "cwe_id")
    )


def with_owasp(enriched: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """One row per risk category; findings without one stay, with null."""
    return enriched.join(kb.cwe_owasp(enriched.sparkSession), "cwe_id", "left")


def with_mitigation(enriched: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """One row per distinct mitigation; findings without one stay, with null."""
    fixes = kb.cwe_mitigation(enriched.sparkSession).select("cwe_id", "mitigation_id").distinct()
    return enriched.join(F.broadcast(fixes) if len(kb.owasp) < 10_000 else fixes, "cwe_id", "left")


def with_attack_vectors(enriched: DataFrame, kb: KnowledgeBase) -> DataFrame:
    vectors = kb.attack_vectors(enriched.sparkSession).withColumnRenamed("name", "vector_name")
    return enriched.join(vectors, "cwe_id")


# --- graph ------------------------------------------------------------------


def _id(prefix: str, c) -> Column:
    return F.concat(F.lit(prefix + ":"), S.col(c))


def _attrs(*cols: str) -> Column:
    pairs = [x for c in cols for x in (F.lit(c), F.col(c).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def evidence() -> Column:
    """Metadata of a finding together with all that says where it was seen, as one map."""
    seen, own = _attrs(*EVIDENCE), F.coalesce("metadata", F.expr("CAST(map() AS map<string,string>)"))
    return F.map_concat(seen, F.map_filter(own, lambda k, _: ~F.map_contains_key(seen, k)))


def _node(df: DataFrame, label: str, prefix: str, key: str, name: str, *attrs: str) -> DataFrame:
    return df.select(
        _id(prefix, key).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name"), _attrs(*attrs).alias("attrs")
    )


def _edge(df: DataFrame, src: Column, dst: Column, label: str) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(label).alias("label"))


def facts(findings: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """Distinct (finding, endpoint, weakness); every edge of a finding derives from it."""
    endpoint = F.when(S.first_text("url").isNotNull(), S.endpoint_id("method", "url"))
    return with_cwe(findings, kb).select("finding_id", endpoint.alias("endpoint_id"), "cwe_id").distinct()


def static_nodes(spark, kb: KnowledgeBase) -> DataFrame:
    """Categories, mitigations and code examples, present even without findings."""
    return (
        _node(kb.owasp_categories(spark), "OWASP", "owasp", "owasp_id", "name", "owasp_id", "description", "year", "rank")
        .unionByName(_node(kb.mitigation(spark), "Mitigation", "mitigation", "mitigation_id", "name", "mitigation_id", "description"))
        .unionByName(
            _node(kb.code_examples(spark), "CodeExample", "code_example", "example_id", "filename", "filename", "mitigation_id")
            .groupBy("id", "label", "name").agg(F.max("attrs.mitigation_id").alias("m"))
            .select("id", "label", "name", F.create_map(F.lit("filename"), "name", F.lit("mitigation_id"), "m").alias("attrs"))
        )
    )


def static_edges(spark, kb: KnowledgeBase) -> DataFrame:
    """Mitigation to code example."""
    return _edge(kb.code_examples(spark), _id("mitigation", "mitigation_id"), _id("code_example", "example_id"), "demonstrates")


def build_graph(findings: DataFrame, kb: KnowledgeBase) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges.

    The facts are checkpointed, so the findings are read once for all edges; the
    facts hold three ids and are far smaller than the findings.
    """
    f = cut_lineage(facts(findings, kb))
    return nodes(findings, kb, f), edges(findings, kb, f)


def nodes(findings: DataFrame, kb: KnowledgeBase, known: DataFrame | None = None) -> DataFrame:
    """All nodes.  Weaknesses and attack vectors exist only where a finding has them."""
    spark = findings.sparkSession
    hit = (facts(findings, kb) if known is None else known).select("cwe_id").distinct()
    rows = latest(findings).withColumn("metadata", F.to_json(evidence()))
    vectors = hit.join(kb.attack_vectors(spark), "cwe_id").select("vector_id", "attack_type", "name").distinct()
    return reduce(
        DataFrame.unionByName,
        [
            _node(rows, "Finding", "finding", "finding_id", "summary",
                  "type", "severity", "source", "summary", "snippet", "pattern", "ts", "scan_id", "occurrence_count", *EVIDENCE, "metadata"),
            _node(endpoints(findings), "Endpoint", "endpoint", "endpoint_id", "url", "url", "method", "first_seen", "last_seen"),
            _node(kb.cwe(spark).join(hit, "cwe_id", "left_semi"), "CWE", "cwe", "cwe_id", "name", "cwe_id", "severity", "description"),
            _node(vectors, "AttackVector", "attack_vector", "vector_id", "name", "attack_type"),
            static_nodes(spark, kb),
        ],
    )


def edges(findings: DataFrame, kb: KnowledgeBase, known: DataFrame | None = None) -> DataFrame:
    """All edges, one per (src, dst)."""
    spark = findings.sparkSession
    f = facts(findings, kb) if known is None else known
    of_cwe = f.where(F.col("cwe_id").isNotNull())
    hit = of_cwe.select("cwe_id").distinct()
    vectors = kb.attack_vectors(spark)
    finding, cwe = _id("finding", "finding_id"), _id("cwe", "cwe_id")
    endpoint, vector = _id("endpoint", "endpoint_id"), _id("attack_vector", "vector_id")
    at = f.where(F.col("endpoint_id").isNotNull())
    instance = of_cwe.select("finding_id", "cwe_id").distinct()
    reached = of_cwe.where(F.col("endpoint_id").isNotNull()).select("cwe_id", "endpoint_id").distinct()
    return reduce(
        DataFrame.unionByName,
        [
            _edge(at.select("finding_id", "endpoint_id").distinct(), finding, endpoint, "found_at"),
            _edge(instance, finding, cwe, "is_instance_of"),
            _edge(instance.join(vectors, "cwe_id").select("finding_id", "vector_id").distinct(), finding, vector, "exploitable_via"),
            _edge(kb.cwe_owasp(spark).join(hit, "cwe_id", "left_semi").distinct(), cwe, _id("owasp", "owasp_id"), "belongs_to"),
            _edge(
                kb.cwe_mitigation(spark).join(hit, "cwe_id", "left_semi").select("cwe_id", "mitigation_id").distinct(),
                cwe, _id("mitigation", "mitigation_id"), "fixed_by",
            ),
            static_edges(spark, kb),
            _edge(reached.join(vectors, "cwe_id").select("vector_id", "endpoint_id").distinct(), vector, endpoint, "targets"),
        ],
    )


def graph_stats(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Counts per node kind and of all edges; kinds without nodes count 0."""
    spark = node_table.sparkSession
    names = local_table(spark, list(zip(NODE_LABELS, STATS)), "label string, kind string")
    counted = node_table.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    per_kind = F.broadcast(names).join(counted, "label", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))
    return per_kind.unionByName(edge_table.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("kind"), "n"))


def finding_paths(edge_table: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """Paths finding, weakness, category and a mitigation of that category.

    There are few weaknesses, so their side is joined first and broadcast after a
    count; a shuffle on the weakness would put most findings in a few tasks.
    """
    def of(label: str, src: str, dst: str) -> DataFrame:
        return edge_table.where(F.col("label") == label).select(F.col("src").alias(src), F.col("dst").alias(dst))

    pairs = kb.owasp_mitigation(edge_table.sparkSession).select(_id("owasp", "owasp_id").alias("owasp"), _id("mitigation", "mitigation_id").alias("mitigation"))
    weakness = of("belongs_to", "cwe", "owasp").join(F.broadcast(pairs.distinct()), "owasp").join(of("fixed_by", "cwe", "mitigation"), ["cwe", "mitigation"])
    return of("is_instance_of", "finding", "cwe").join(small(weakness), "cwe").select("finding", "cwe", "owasp", "mitigation")


def reachable(edge_table: DataFrame, start: DataFrame, max_depth: int, labels: Sequence[str] | None = None) -> DataFrame:
    """``start, node, depth`` of all nodes within ``max_depth`` edges of each ``start(id)``, with the least number of edges.

    One round an edge: the pairs found last meet the edges that leave their nodes, and pairs known before are left out, so cycles
    end by themselves and no pair is extended twice.  Many starts share few nodes, so the edges in use are broadcast where a count
    shows that they are few; otherwise the join is a shuffle whose skewed parts Spark splits.  A start is not reached by itself, unless over a cycle.
    """
    check_positive("max_depth", max_depth)
    used = (edge_table if labels is None else edge_table.where(F.col("label").isin(*labels))).select("src", "dst").distinct()
    new = cut_lineage(start.select(F.col("id").alias("start"), F.col("id").alias("node")).where("start is not null").distinct())
    found = None
    for depth in range(1, max_depth + 1):
        leaving = used.join(new.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
        pairs = new.join(small(leaving), F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        if found is not None:
            pairs = pairs.join(found.select("start", "node"), ["start", "node"], "left_anti")
        new = cut_lineage(pairs)
        level = new.withColumn("depth", F.lit(depth))
        found = level if found is None else found.unionByName(level)
        if new.isEmpty():
            break
    return found


def successors(node_table: DataFrame, edge_table: DataFrame, src: str | Column, label: str | None = None) -> DataFrame:
    """Neighbours of a node, or of all nodes whose id starts with a prefix like ``cwe:``.

    Most findings share a few weaknesses, so nodes of the knowledge base are broadcast after a count; only
    edges to endpoints are joined by a shuffle.
    """
    start = F.col("src").startswith(src) if isinstance(src, str) and src.endswith(":") else F.col("src") == src
    out = edge_table.where(start)
    if label is not None:
        out = out.where(F.col("label") == label)
    right = node_table.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"), F.col("name").alias("dst_name"))
    known, seen = F.col("label").isin(*KNOWLEDGE_EDGES), F.col("dst_label").isin("Finding", "Endpoint")
    parts = []
    if label is None or label in KNOWLEDGE_EDGES:
        parts.append(out.where(known).join(small(right.where(~seen)), "dst"))
    if label is None or label not in KNOWLEDGE_EDGES:
        parts.append(out.where(~known).join(right, "dst"))
    return reduce(DataFrame.unionByName, parts).select("src", "label", "dst", "dst_label", "dst_name")


# --- relational form --------------------------------------------------------


def store_tables(findings: DataFrame, kb: KnowledgeBase) -> dict[str, DataFrame]:
    """Relational tables of the findings, keys without node prefixes."""
    spark = findings.sparkSession
    seen = facts(findings, kb).where(F.col("cwe_id").isNotNull())
    rows = latest(findings)
    return {
        "findings": rows.select(
            "finding_id",
            F.coalesce("type", F.lit("unknown")).alias("type"),
            F.coalesce("severity", F.lit("UNKNOWN")).alias("severity"),
            F.coalesce("source", F.lit("unknown")).alias("source"),
            F.coalesce("summary", F.lit("")).alias("summary"),
            F.coalesce("snippet", F.lit("[REDACTED]")).alias("snippet"),
            F.to_json(evidence()).alias("metadata"),
            F.coalesce("scan_id", F.lit("default")).alias("scan_id"),
            F.col("ts").alias("timestamp"),
        ),
        "endpoints": endpoints(findings).drop("n"),
        "cwe_entries": kb.cwe(spark).join(seen.select("cwe_id").distinct(), "cwe_id", "left_semi"),
        "finding_cwe_map": seen.select("finding_id", "cwe_id").distinct().withColumn("confidence", F.lit(1.0)),
        "owasp_categories": kb.owasp_categories(spark),
        "cwe_owasp_map": kb.cwe_owasp(spark),
        "mitigations": kb.mitigation(spark).join(
            kb.code_examples(spark).groupBy("mitigation_id").agg(F.array_join(F.sort_array(F.collect_list("filename")), ", ").alias("code_example")),
            "mitigation_id", "left",
        ).join(
            kb.cwe_mitigation(spark).groupBy("mitigation_id").agg(F.array_join(F.sort_array(F.collect_set("cwe_id")), ", ").alias("applicable_to")),
            "mitigation_id", "left",
        ),
    }


def merge_tables(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The store after an upsert: a new row replaces the old one of its key, old rows without a new one stay.

    Keys are unique on both sides, so the anti joins have no hot keys.  An endpoint keeps the first time it was
    seen.  The tables of the knowledge base are those of ``new``.
    """
    keys = {"findings": ["finding_id"], "cwe_entries": ["cwe_id"], "finding_cwe_map": ["finding_id", "cwe_id"]}
    merged = {n: old[n].join(new[n].select(*k), k, "left_anti").unionByName(new[n]) for n, k in keys.items()}
    seen = old["endpoints"].unionByName(new["endpoints"]).groupBy("endpoint_id", "url", "method")
    merged["endpoints"] = seen.agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return {n: merged.get(n, df) for n, df in new.items()}


def store_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of the four main tables."""
    names = {"findings": "findings", "endpoints": "endpoints", "cwes": "cwe_entries", "finding_cwe_maps": "finding_cwe_map"}
    counts = [
        tables[t].agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, t in names.items()
    ]
    return reduce(DataFrame.unionByName, counts)
