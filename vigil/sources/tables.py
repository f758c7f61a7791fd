"""The supplied tables and views derived from them, in SQL that any engine of the standard runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
AS_OF = "2024-06-30"

CASES = """
SELECT o_orderkey AS id, o_orderkey AS arrival_idx,
  concat(c_name, CASE o_orderkey % 4 WHEN 0 THEN ' Pvt Ltd' WHEN 1 THEN ' Technologies Limited' WHEN 2 THEN ' Bank of India' ELSE ' Services Inc.' END) AS company,
  CASE WHEN o_orderkey % 5 = 0 THEN concat(n_name, ' / ', r_name) WHEN o_orderkey % 11 = 0 THEN '' ELSE n_name END AS authority,
  CASE r_regionkey WHEN 0 THEN 'dpdpa_board' WHEN 1 THEN 'sectoral_regulators' WHEN 2 THEN 'cert_in_breach' WHEN 3 THEN 'courts_case_law' ELSE 'unsorted' END AS section,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Fintech' WHEN 'AUTOMOBILE' THEN 'Insurance' WHEN 'MACHINERY' THEN 'Social Media / Tech' WHEN 'HOUSEHOLD' THEN 'Government' ELSE 'Other' END AS sector,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS date,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE round(o_totalprice * 1000, 2) END AS penalty_amount_inr,
  CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN concat('Rs ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ' lakh')
    WHEN 2 THEN concat('₹', CAST(o_orderkey % 90 + 1 AS STRING), ',00,000 and 2.5 crore') WHEN 3 THEN '$2.5 million' WHEN 4 THEN 'a sum of five lakh'
    ELSE concat('INR ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)) END AS penalty_amount,
  CASE o_orderkey % 4 WHEN 0 THEN 'Section 8(5) DPDP Act' WHEN 1 THEN 'IT Act Section 43A' WHEN 2 THEN concat('Sec. ', CAST(o_orderkey % 20 + 3 AS STRING), ' and Section 9') ELSE '' END AS dpdpa_section,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Breach' ELSE 'Consent' END AS violation_type,
  CASE o_orderstatus WHEN 'F' THEN 'Fine imposed' WHEN 'O' THEN 'Investigation Ongoing' ELSE 'Consultation' END AS outcome,
  CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
  concat('Order on ', c_name, CASE WHEN o_orderkey % 2 = 0 THEN ' after an inquiry' ELSE '' END) AS summary,
  concat('https://www.', CASE o_orderkey % 3 WHEN 0 THEN 'news.example.co.in' WHEN 1 THEN 'm.paper.org' ELSE 'daily.com' END, '/case/', CAST(o_custkey AS STRING), '?ref=1') AS source_url,
  CASE WHEN o_orderkey % 4 = 1 THEN concat('https://authority.gov.in/orders/', CAST(o_orderkey AS STRING)) ELSE '' END AS official_source_url,
  CASE WHEN o_orderkey % 9 = 0 THEN 'press' ELSE '' END AS stored_tier,
  o_orderkey % 7 = 0 AS needs_review,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(NULL AS DATE) ELSE CAST(o_orderdate AS DATE) END AS last_checked
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

ITEMS = """
SELECT o_orderkey AS arrival_idx,
  CASE o_orderkey % 10 WHEN 0 THEN concat('Supreme Court hearing on ', c_name, ' data breach petition') WHEN 1 THEN concat('RBI fines ', c_name, ' Rs 5,00,000 over KYC lapses')
    WHEN 2 THEN concat('MeitY notifies DPDPA rules deadline for ', c_name, ' under section 8') WHEN 3 THEN concat('Webinar: how to prepare for privacy compliance with ', c_name)
    WHEN 4 THEN concat(c_name, ' raises $40 million funding round') WHEN 5 THEN concat('Data Protection Board issues penalty order against ', lower(c_name), ' pvt ltd')
    WHEN 6 THEN concat('CERT-In advisory on breach notification 6 hour rule for ', n_name) WHEN 7 THEN concat(n_name, ' weather update') WHEN 8 THEN '' ELSE concat('Infosys consent management audit in ', n_name, ' - Daily Paper') END AS title,
  CASE o_orderkey % 7 WHEN 0 THEN 'The reserve bank cited DPDPA rules and personal data of customers.' WHEN 1 THEN 'Investigation ongoing; 3 crore sought in the appeal.' WHEN 2 THEN 'Cross-border transfer and GDPR questions remain.' ELSE concat('No further details from ', n_name, '.') END AS summary,
  CASE o_orderkey % 6 WHEN 0 THEN 'indiankanoon.org' WHEN 1 THEN 'economictimes' WHEN 2 THEN 'RBI' WHEN 3 THEN 'DSCI' WHEN 4 THEN 'iapp' ELSE 'High Court feed' END AS source,
  CAST(DATE '2024-06-30' - CAST(o_orderkey % 900 AS INT) AS STRING) AS published,
  concat('https://www.site', CAST(o_orderkey % 7 AS STRING), '.co.in/n/', CAST(o_orderkey % 5000 AS STRING)) AS url,
  o_orderkey % 13 = 0 AS carried
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

EVIDENCE = """
SELECT l_orderkey AS action_id, concat('https://reg.gov.in/', CAST(l_partkey AS STRING)) AS url,
  CASE l_returnflag WHEN 'R' THEN 'strong' WHEN 'A' THEN 'moderate' ELSE 'weak' END AS strength, l_linenumber AS arrival
FROM {lineitem}
"""

CLAIMS = """
SELECT l_orderkey AS event_id, CASE WHEN l_linenumber % 2 = 0 THEN 'penalty' ELSE 'date' END AS field,
  CASE WHEN l_linenumber % 2 = 0 THEN concat('Rs ', CAST(CAST(floor(l_quantity) AS BIGINT) % 4 AS STRING), ',000') ELSE concat(' ', l_returnflag, CASE WHEN l_linenumber > 3 THEN ' ' ELSE '' END) END AS value
FROM {lineitem}
"""

STORIES = """
SELECT event_id AS story_id, CAST(floor(value) AS BIGINT) % 21 AS score, CAST(ts AS TIMESTAMP) AS processed_at, concat('feed', CAST(user_id % 12 AS STRING)) AS source,
  concat('Story ', CAST(event_id AS STRING)) AS headline, CASE WHEN event_type = 'click' THEN 'alerted' WHEN event_type = 'view' THEN 'scanned' ELSE 'suppressed' END AS action
FROM {events}
"""

DECISIONS = """
SELECT doc_id % 200 AS id, CASE WHEN toxic = 1 THEN 'discard' WHEN quality = 1 THEN 'verify' ELSE 'unpublish' END AS action, doc_id AS decided_at FROM {labels}
"""

VIEWS = {"cases": CASES, "items": ITEMS, "evidence": EVIDENCE, "claims": CLAIMS, "stories": STORIES, "decisions": DECISIONS}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = [n for n in NAMES if f"{{{n}}}" in VIEWS[name]]
    return spark.sql(VIEWS[name], **{n: table(spark, sf_dir, n) for n in used})


def plain(name: str) -> str:
    """A view's SQL over tables of their own names."""
    return VIEWS[name].format(**{n: n for n in NAMES})
