"""Labels of counterparties and accounts, and the matching of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.registry import query
from tidemark.sources import domain as d

#: Texts as banks and people write them, one for each style, from an entity's name and number.
_RAW = """raw AS (SELECT entity_id, seq, display_name, style, CASE style WHEN 0 THEN display_name WHEN 1 THEN upper(display_name) || ' TEAM12/Payment ' || seq || ' PERF' WHEN 2 THEN 'INV-' || seq WHEN 3 THEN display_name || ' test'
  WHEN 4 THEN 'mail' || seq || '@shop.example.com' WHEN 5 THEN 'GreyHeron' || display_name || ' (deleted)' WHEN 6 THEN 'Quick  Books ' || display_name || ' invoice #' || seq WHEN 7 THEN NULL ELSE 'OrsolVINTCo ' || seq END AS raw
  FROM entities, range(9) t(style))"""


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    n, s = F.col("display_name"), F.col("seq").cast("string")
    j = lambda *x: F.concat(*[y if isinstance(y, Column) else F.lit(y) for y in x])
    texts = [n, j(F.upper(n), " TEAM12/Payment ", s, " PERF"), j("INV-", s), j(n, " test"), j("mail", s, "@shop.example.com"), j("GreyHeron", n, " (deleted)"), j("Quick  Books ", n, " invoice #", s), F.lit(None).cast("string"), j("OrsolVINTCo ", s)]
    return d.entities(spark, sf).select("entity_id", "seq", "display_name", F.posexplode(F.array(*texts)).alias("style", "raw"))


def _camel(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"


def _form(x: str) -> str:
    return f"regexp_replace(lower({_camel(f'coalesce({x}, {chr(39)}{chr(39)})')}), '[^a-z0-9]', '', 'g')"


def _clean(x: str) -> str:
    out = _camel(rf"trim(regexp_replace({x}, '(?i)\s*\(deleted\)\s*$', ''))")
    out = rf"trim(regexp_replace(regexp_replace(regexp_replace({out}, '\s+', ' ', 'g'), '\b([a-z])([A-Z][a-z])', '\1 \2', 'g'), '\b([A-Z][a-z]+)([A-Z][a-z])', '\1 \2', 'g'))"
    for pattern, brand in labels.BRANDS:
        out = f"regexp_replace({out}, '{pattern}', '{brand}', 'g')"
    return out


_SLUDGE, _TEST = (f"coalesce(regexp_matches(trim(raw), '{p}'), false)" for p in (labels.SLUDGE, labels.TEST))
_CLEAN = f"coalesce(length(raw) >= 2 AND NOT regexp_matches(raw, '{labels.EMAIL}') AND NOT regexp_matches(raw, '{labels.SLUDGE}') AND NOT {_TEST}, false)"


@query(
    "label_tests",
    d.with_tables(f"WITH {_RAW} SELECT entity_id, style::INTEGER AS style, {_form('raw')} AS match_form, {_SLUDGE} AS is_sludge, {_TEST} AS is_test, {_CLEAN} AS is_clean FROM raw", "entities"),
)
def label_tests(spark: SparkSession, sf: str) -> DataFrame:
    """The form for matching, and whether a text is invoice sludge, a test, or clean enough to show."""
    r = F.col("raw")
    return _raw(spark, sf).select("entity_id", "style", labels.match_form(r).alias("match_form"), labels.is_sludge(r).alias("is_sludge"), F.coalesce(labels.is_test(r), F.lit(False)).alias("is_test"), labels.is_clean(r).alias("is_clean"))


_OWNS = lambda x: f"(length({_form(x)}) >= 2 AND (contains({_form(x)}, {_form('owner')}) OR contains({_form('owner')}, {_form(x)})))"


@query(
    "display_labels",
    d.with_tables(
        f"""WITH {_RAW}, o AS (SELECT *, CASE WHEN seq % 5 = 0 THEN display_name ELSE 'Orsol Vint Co' END AS owner, CASE WHEN seq % 3 = 0 THEN raw END AS preferred FROM raw)
SELECT entity_id, style::INTEGER AS style, CASE WHEN preferred IS NOT NULL AND {_CLEAN} THEN CASE WHEN {_OWNS('preferred')} THEN 'Owner' ELSE {_clean('preferred')} END
  WHEN raw IS NULL OR {_TEST} OR {_SLUDGE} THEN '—' WHEN {_OWNS('raw')} THEN 'Owner' ELSE {_clean('raw')} END AS label FROM o""",
        "entities",
    ),
)
def display_labels(spark: SparkSession, sf: str) -> DataFrame:
    """What is shown for a counterparty; here each fifth entity is an owner's, and each third text is preferred."""
    o = _raw(spark, sf).withColumns({"owner": F.when(F.col("seq") % 5 == 0, F.col("display_name")).otherwise("Orsol Vint Co"), "preferred": F.when(F.col("seq") % 3 == 0, F.col("raw"))})
    return o.select("entity_id", "style", labels.display_label(F.col("raw"), F.col("preferred"), F.col("owner")).alias("label"))


_PART = rf"trim(regexp_replace(trim(raw), '{labels.PAYMENT}', ''))"


@query(
    "descriptor_entities",
    d.with_tables(
        rf"""WITH {_RAW}, a AS (SELECT *, {_PART} AS part, coalesce(nullif(regexp_extract(trim(raw), '{labels.PAYMENT}', 1), ''), regexp_extract(trim(raw), '{labels.INVOICE}', 1)) AS number FROM raw),
b AS (SELECT *, CASE WHEN regexp_extract(part, '{labels.TEAM}', 1) <> '' THEN trim(regexp_extract(part, '{labels.TEAM}', 1)) ELSE part END AS p FROM a),
c AS (SELECT *, CASE WHEN p = upper(p) AND length(p) > 2 THEN array_to_string(list_transform(string_split_regex(p, '[\s/]+'), lambda w: left(w, 1) || lower(substr(w, 2))), ' ') WHEN p = '' THEN 'Customer' ELSE p END AS name FROM b)
SELECT entity_id, style::INTEGER AS style, CASE WHEN length(trim(raw)) >= 2 AND NOT {_SLUDGE} AND length(name) >= 2 THEN name || CASE WHEN number <> '' THEN ' (Invoice ' || number || ')' ELSE '' END END AS extracted FROM c""",
        "entities",
    ),
)
def descriptor_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Names and invoice numbers out of bank texts."""
    return _raw(spark, sf).select("entity_id", "style", labels.entity_of_descriptor(F.col("raw")).alias("extracted"))


_ALIAS = f"""m AS (SELECT movement_id, raw_description, counterparty, {_form("raw_description")} AS x, {_form("counterparty")} AS y FROM movements)"""


@query(
    "alias_matches",
    d.with_tables(
        f"""WITH {_ALIAS} SELECT movement_id, x = y OR (least(length(x), length(y)) >= 3 AND (contains(x, y) OR contains(y, x) OR
  left(x, ceil(least(length(x), length(y)) * 85 / 100)::INTEGER) = left(y, ceil(least(length(x), length(y)) * 85 / 100)::INTEGER))) AS matches FROM m""",
        "movements",
    ),
)
def alias_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a bank's text and its counterparty are aliases."""
    return d.movements(spark, sf).select("movement_id", labels.alias_match(F.col("raw_description"), F.col("counterparty")).alias("matches"))


def _plain(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


_STOP = ", ".join(f"'{w}'" for w in labels.STOPWORDS)
_NAMES = f"""n AS (SELECT movement_id, {_plain("raw_description")} AS x, {_plain("counterparty")} AS y FROM movements),
w AS (SELECT *, list_distinct(list_filter(string_split(x, ' '), lambda t: length(t) > 2 AND NOT list_contains([{_STOP}], t))) AS u, list_distinct(list_filter(string_split(y, ' '), lambda t: length(t) > 2 AND NOT list_contains([{_STOP}], t))) AS v,
  list_distinct(list_filter(string_split(x, ' '), lambda t: length(t) > 1)) AS p, list_distinct(list_filter(string_split(y, ' '), lambda t: length(t) > 1)) AS q FROM n)"""


@query(
    "name_matches",
    d.with_tables(
        f"""WITH {_NAMES} SELECT movement_id, x <> '' AND y <> '' AND (x = y OR (length(x) >= 8 AND length(y) >= 8 AND (contains(x, y) OR contains(y, x)))
  OR (least(len(u), len(v)) >= 2 AND len(list_intersect(u, v)) >= 2 AND 2 * len(list_intersect(u, v)) >= least(len(u), len(v)))) AS receivable,
  x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x) OR len(list_intersect(p, q)) >= least(len(p), len(q), 2)) AS payable FROM w""",
        "movements",
    ),
)
def name_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Whether bank text and counterparty match by the rule for receivables and by that for payables."""
    a, b = F.col("raw_description"), F.col("counterparty")
    return d.movements(spark, sf).select("movement_id", labels.receivable_names_match(a, b).alias("receivable"), labels.payable_names_match(a, b).alias("payable"))


_SIM = """(CASE WHEN {a} = {b} THEN 0.4 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 0.4 * (1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))) END
  + 0.6 * CASE WHEN len(list_distinct(list_concat({x}, {y}))) = 0 THEN 1.0 ELSE len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y}))) END)"""
_TOK = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({}), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: length(w) > 1))"


@query(
    "entity_name_match",
    d.with_tables(
        f"""WITH m AS (SELECT movement_id, trim(lower(raw_description)) AS a, trim(lower(counterparty)) AS b, trim(lower('SP ' || counterparty || ' WHOLESALE')) AS c, {_TOK.format("raw_description")} AS x, {_TOK.format("counterparty")} AS y, {_TOK.format("'SP ' || counterparty || ' WHOLESALE'")} AS z FROM movements),
s AS (SELECT *, {_SIM.format(a="a", b="b", x="x", y="y")} AS direct, {_SIM.format(a="a", b="c", x="x", y="z")} AS alias FROM m)
SELECT movement_id, direct >= 0.8 OR alias >= 0.8 OR contains(a, b) OR contains(b, a) AS matches, round(CASE WHEN direct >= 0.8 THEN direct WHEN alias >= 0.8 THEN alias WHEN contains(a, b) THEN 0.88 WHEN contains(b, a) THEN 0.85 ELSE direct END, 6)::DOUBLE AS score,
  CASE WHEN direct >= 0.8 THEN 'direct' WHEN alias >= 0.8 THEN 'alias' WHEN contains(a, b) THEN 'contains' WHEN contains(b, a) THEN 'contains_reverse' ELSE 'none' END AS method FROM s""",
        "movements",
    ),
)
def entity_name_match(spark: SparkSession, sf: str) -> DataFrame:
    """Bank text against its counterparty's name and one alias: match, score and method."""
    b = F.col("counterparty")
    found = labels.entity_match(F.col("raw_description"), b, F.array(F.concat(F.lit("SP "), b, F.lit(" WHOLESALE")))).alias("m")
    return d.movements(spark, sf).select("movement_id", found).select("movement_id", F.col("m.match").alias("matches"), F.round("m.score", 6).alias("score"), F.col("m.method").alias("method"))


_ACCOUNTS = """a AS (SELECT entity_id, seq, CASE seq % 4 WHEN 0 THEN 'Union Parent Account:J. ' || display_name || ' (4821) - 2' WHEN 1 THEN 'First Bank:' || display_name || ' (' || (1000 + seq % 9000) || ')' WHEN 2 THEN 'Personal ' || display_name ELSE '  ' END AS raw,
  CASE seq % 3 WHEN 0 THEN 'depository' WHEN 1 THEN 'credit' END AS kind, CASE seq % 5 WHEN 0 THEN 'checking' WHEN 1 THEN 'savings' WHEN 2 THEN 'credit card' WHEN 3 THEN 'money market' END AS subtype FROM entities)"""


@query(
    "account_labels",
    d.with_tables(
        rf"""WITH {_ACCOUNTS}, b AS (SELECT *, trim(raw) AS s, coalesce(kind, '') AS t, coalesce(subtype, '') AS u, lower(concat_ws(' ', trim(raw), coalesce(kind, ''), coalesce(subtype, ''))) AS every FROM a)
SELECT entity_id, CASE WHEN s = '' THEN 'External / unlinked account' WHEN regexp_matches(s, '(?i)\bparent\s*account\b') OR (t = 'credit' AND regexp_matches(s, '(?i)parent|personal')) THEN 'Owner credit card' WHEN t = 'credit' OR u = 'credit card' THEN 'Credit card'
  WHEN u = 'checking' OR (t = 'depository' AND every LIKE '%check%') THEN 'Business checking' WHEN u IN ('savings', 'money market') OR regexp_matches(every, 'savings|money\s*market|mma') THEN 'Business MMA' WHEN t = 'depository' THEN 'Business checking'
  WHEN regexp_matches(s, '^([^:]+)(?::.*?)?\s*\((\d{{4}})\)') THEN trim(regexp_extract(s, '^([^:]+)(?::.*?)?\s*\((\d{{4}})\)', 1)) || ' (' || regexp_extract(s, '^([^:]+)(?::.*?)?\s*\((\d{{4}})\)', 2) || ')'
  WHEN length(s) > 40 THEN left(s, 37) || '...' ELSE s END AS label FROM b""",
        "entities",
    ),
)
def account_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Names of bank accounts for people."""
    n, k = F.col("display_name"), F.col("seq")
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit("Union Parent Account:J. "), n, F.lit(" (4821) - 2"))).when(k % 4 == 1, F.concat(F.lit("First Bank:"), n, F.lit(" ("), (1000 + k % 9000).cast("string"), F.lit(")")))
        .when(k % 4 == 2, F.concat(F.lit("Personal "), n)).otherwise("  ")
    )
    kind = F.when(k % 3 == 0, "depository").when(k % 3 == 1, "credit")
    subtype = F.when(k % 5 == 0, "checking").when(k % 5 == 1, "savings").when(k % 5 == 2, "credit card").when(k % 5 == 3, "money market")
    return d.entities(spark, sf).select("entity_id", labels.account_label(raw, kind, subtype).alias("label"))
