"""Queries over policies: packs, contexts, evaluation of results, merged requirements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.plans import policy as P
from tessera.plans.base import SQL, entities, scan_results


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context per result: each entity's count, and a confidence by its type."""
    sure = F.when(F.col("entity_type") == "CREDIT_CARD", 0.99).when(F.col("entity_type") == "EMAIL", 0.75).otherwise(0.65)
    e = entities(scan_results(spark, sf_dir)).select("doc_id", F.lower("entity_type").alias("t"), F.struct(F.col("n").cast("long").alias("n"), sure.alias("c")).alias("v"))
    return e.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("ctx"))


POLICY_SQL = SQL + """, pol AS (SELECT doc_id, 'PCI-DSS' AS policy, 'critical' AS risk, 100 AS priority FROM scan WHERE n_card > 0 UNION ALL
 SELECT doc_id, 'GDPR Personal Data', 'high', 90 FROM scan WHERE n_email + n_phone + n_ip > 0 UNION ALL SELECT doc_id, 'CCPA/CPRA', 'high', 85 FROM scan WHERE n_card > 0 UNION ALL
 SELECT doc_id, 'GLBA', 'high', 85 FROM scan WHERE n_card > 0 UNION ALL SELECT doc_id, 'SOC2 Trust Services', 'high', 60 FROM scan WHERE n_card > 0)"""


@query("policy_context", SQL + "SELECT doc_id, lower(entity_type) AS entity_type, n::bigint AS n FROM ents")
def policy_context(spark, sf_dir):
    return contexts(spark, sf_dir).select("doc_id", F.explode("ctx").alias("entity_type", "v")).select("doc_id", "entity_type", F.col("v.n").alias("n"))


@query("policy_evaluate", POLICY_SQL + " SELECT doc_id, policy, risk, priority::int AS priority FROM pol")
def policy_evaluate(spark, sf_dir):
    """Which packs each result falls under."""
    return P.evaluate(contexts(spark, sf_dir)).select("doc_id", F.explode("applied").alias("a")).select("doc_id", "a.policy", "a.risk", "a.priority")


@query("policy_merge", POLICY_SQL + """ SELECT doc_id, case when bool_or(risk = 'critical') then 'critical' else 'high' end AS risk_level, max(case policy when 'GLBA' then 2555 when 'SOC2 Trust Services' then 365 end)::int AS min_days, min(case policy when 'PCI-DSS' then 365 end)::int AS max_days,
 min(case policy when 'PCI-DSS' then 90 when 'GDPR Personal Data' then 365 when 'CCPA/CPRA' then 365 when 'SOC2 Trust Services' then 90 end)::int AS review_days, bool_or(policy = 'PCI-DSS') AS has_pci, bool_or(policy = 'GDPR Personal Data') AS has_gdpr, bool_or(policy = 'PCI-DSS') AS masking_required, bool_or(policy IN ('GDPR Personal Data', 'CCPA/CPRA')) AS right_erasure FROM pol GROUP BY 1""")
def policy_merge(spark, sf_dir):
    """The most restrictive requirements of all packs that apply."""
    m = P.merged(P.evaluate(contexts(spark, sf_dir)).where(F.size("applied") > 0))
    return m.select("doc_id", "risk_level", "min_days", "max_days", "review_days", "has_pci", "has_gdpr", "masking_required", "right_erasure")


REGION_PACKS = (
    P.Pack("mail", "custom", "low", P.Trigger(("email",)), allowed=("EU", "UK", "US"), prohibited=("RU",), priority=90),
    P.Pack("phones", "custom", "low", P.Trigger(("phone",)), allowed=("UK", "US"), prohibited=("KP", "RU"), priority=80),
    P.Pack("addresses", "custom", "low", P.Trigger(("ip_address",)), allowed=("EU", "UK"), priority=70),
    P.Pack("cards", "custom", "low", P.Trigger(("credit_card",)), allowed=("JP",), priority=60),
)


@query("policy_regions", SQL + """, l AS (SELECT *, n_email + n_phone + n_ip AS others, [x for x in ['EU', 'UK', 'US'] if (n_phone = 0 or x <> 'EU') and (n_ip = 0 or x <> 'US')] AS shared FROM scan)
SELECT doc_id, array_to_string(case when n_card > 0 and others > 0 then [] when n_card > 0 then ['JP'] else shared end, ',') AS allowed,
  array_to_string(case when n_phone > 0 then ['KP', 'RU'] when n_email > 0 then ['RU'] else [] end, ',') AS prohibited FROM l""")
def policy_regions(spark, sf_dir):
    """Regions that all packs that apply allow, and those that any of them prohibits."""
    m = P.merged(P.evaluate(contexts(spark, sf_dir), REGION_PACKS).where(F.size("applied") > 0), REGION_PACKS)
    return m.select("doc_id", F.array_join("allowed_regions", ",").alias("allowed"), F.array_join("prohibited_regions", ",").alias("prohibited"))


@query("policy_packs", "SELECT name, risk, priority::int AS priority FROM (VALUES " + ", ".join(f"('{p.name}', '{p.risk}', {p.priority})" for p in P.PACKS) + ") t(name, risk, priority)")
def policy_packs(spark, sf_dir):
    return spark.createDataFrame([(p.name, p.risk, p.priority) for p in P.in_order()], "name string, risk string, priority int")


@query("policy_any_min_count", SQL + "SELECT doc_id FROM scan WHERE n_email >= 2")
def policy_any_min_count(spark, sf_dir):
    c = contexts(spark, sf_dir)
    return c.where(P.matches(F.col("ctx"), P.Trigger(("email",), min_confidence=0.7, min_count=2))).select("doc_id")


@query("policy_combination", SQL + "SELECT doc_id FROM scan WHERE n_email > 0 AND n_ip > 0")
def policy_combination(spark, sf_dir):
    c = contexts(spark, sf_dir)
    return c.where(P.matches(F.col("ctx"), P.Trigger(combinations=(("email", "ip_address"),), min_confidence=0.6))).select("doc_id")


@query("policy_exclude_if_only", SQL + "SELECT doc_id FROM scan WHERE n_ip > 0 AND n_email + n_phone + n_card > 0")
def policy_exclude_if_only(spark, sf_dir):
    c = contexts(spark, sf_dir)
    return c.where(P.matches(F.col("ctx"), P.Trigger(("ip_address",), exclude_if_only=("ip_address",)))).select("doc_id")


@query("policy_action_plan", POLICY_SQL + " SELECT doc_id, case when bool_or(risk = 'critical') then 'quarantine' else 'monitor' end AS action FROM pol GROUP BY 1")
def policy_action_plan(spark, sf_dir):
    """What would be done for each result; nothing is done here."""
    e = P.evaluate(contexts(spark, sf_dir)).where(F.size("applied") > 0)
    return e.select("doc_id", F.when(F.exists("applied", lambda x: x["risk"] == "critical"), "quarantine").otherwise("monitor").alias("action"))
