"""Claims over the order tables: one claim per order, and the same claim written out in one of several ways."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

AS_OF = date(2000, 6, 1)

# The form's lines.
FORM = (
    ("", "MOTOR VEHICLE INSURANCE CLAIM FORM"), ("", ""), ("Claim Reference: ", "claim_id"), ("Policy Number: ", "policy_no"), ("Date of Incident: ", "date"), ("", ""),
    ("Full Name: ", "Asha Example"), ("Contact Number: ", "phone"), ("Email Address: ", "email"), ("", ""), ("Registration Number: ", "XX-01-YZ-0001"), ("Make: ", "Sample"),
    ("Model: ", "Demo"), ("Year: ", "2020"), ("", ""), ("Insured Amount: ₹", "insured_amount"), ("Nature of Damage: ", "damage"), ("Estimated Repair Cost: ", "amount_estimated"),
)
LETTER = (
    ("", "To the desk,"), ("Our clm ref ", "claim_id"), ("under pn ", "policy_no"), ("written ", "date"), ("Call 12345678 or ", "phone"), ("or write to ", "email"), ("", ""),
    ("Vehicle Details: ", "Sample Demo"), ("", "with a roof rack"), ("", "NOTES BELOW"), ("", "plate KA-05-MN-1234"), ("Loss: ", "damage"), ("", "seen by a neighbour"), ("", ""),
    ("", "Total Estimated Cost"), ("", "amount_estimated"), ("", "as quoted"), ("Insured Amount: Rs. ", "insured_amount"), ("Claimant Signature: ", "Asha Example"),
)
NOTE = (("", "Ravi Kumar"), ("", "wrote in about a dent."), ("Asks for ", "amount_estimated"), ("mail ", "email"), ("", "Registration Number - AB 12 CD 3456"), ("Year: ", "2019"), ("", "No damage to others"))
COLUMNS = ("claim_id", "policy_no", "date", "phone", "email", "insured_amount", "damage", "amount_estimated")


def claims_sql(grouped: str, orders: str = "orders", customer: str = "customer") -> str:
    """``grouped``: the engine's expression for ``{x}`` with commas and two places."""
    price = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"
    day = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
    nine = "lpad(CAST(o_custkey % 1000000000 AS STRING), 9, '0')"
    local = "lower(replace(c_name, '#', '.'))"
    return f"""SELECT o_orderkey AS claim_key, c_mktsegment AS segment, c_nationkey AS nationkey,
  'CLM-' || CAST(o_orderkey AS STRING) AS claim_id,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'POL-' || CAST(o_custkey AS STRING) END AS policy_no,
  c_name AS claimant_name,
  CASE o_custkey % 5 WHEN 0 THEN '9' || {nine} WHEN 1 THEN '09' || {nine} WHEN 2 THEN '+91 9' || {nine} WHEN 3 THEN '0000000000' ELSE '12345' END AS phone,
  CASE o_custkey % 6 WHEN 0 THEN {local} || '@example.com' WHEN 1 THEN upper({local}) || '@EXAMPLE.COM' WHEN 2 THEN {local} || '@gmai.com'
    WHEN 3 THEN {local} || '(at)example.com' WHEN 4 THEN {local} || '@example.cm' ELSE NULL END AS email,
  CASE WHEN o_orderkey % 7 = 0 THEN '  Sample   Demo ' ELSE 'Sample Demo' END AS vehicle,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Total loss' WHEN '2-HIGH' THEN 'Fire damage' ELSE 'Front bumper' END AS damage,
  CASE WHEN o_orderkey % 19 = 0 THEN 'n/a' WHEN o_orderkey % 23 = 0 THEN replace({day}, '-', '') ELSE {day} END AS date,
  'Rs. ' || CASE WHEN o_orderkey % 2 = 0 THEN {grouped.format(x="CAST(o_totalprice AS DECIMAL(18,2))")} ELSE {price} END AS amount_estimated,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(CAST((c_acctbal + 1000) * 40 AS DECIMAL(18,2)) AS STRING) END AS insured_amount,
  CAST(o_orderdate AS TIMESTAMP) AS modified
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""


def lines_sql(form: tuple) -> str:
    return " || chr(10) || ".join("''" if not (a or b) else (f"'{a}' || coalesce({b}, '')" if b in COLUMNS else f"'{a}{b}'") for a, b in form)


def form_sql(claims: str) -> str:
    """Of ten claims four are forms, two letters, two notes, one is empty and one holds nothing readable."""
    return f"""SELECT claim_key, CASE WHEN claim_key % 5 = 2 THEN {lines_sql(LETTER)} WHEN claim_key % 5 = 3 THEN {lines_sql(NOTE)}
  WHEN claim_key % 10 = 4 THEN '' WHEN claim_key % 10 = 9 THEN repeat('é', 2100) ELSE {lines_sql(FORM)} END AS raw_text FROM ({claims})"""


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores is dealt out again; a large one stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    orders = spread(orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate"))
    return spark.sql(claims_sql("format_number({x}, 2)", "{orders}", "{customer}"), orders=orders, customer=customer)


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(form_sql("SELECT * FROM {c}"), c=claims(spark, sf_dir))
