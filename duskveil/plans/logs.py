"""Log records with sensitive values, derived from the customer table by SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskveil.functions.patterns import DEFAULTS

LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR")


def digits(n: int, width: int) -> str:
    """The key, modulo n, as that many digits."""
    return f"lpad(cast(k % {n} as string), {width}, '0')"


#: A value of each label, by SQL over the key ``k``.
VALUES = {
    "hetu": f"concat({digits(10**6, 6)}, '-', {digits(1000, 3)}, 'A')",
    "ehic": f"concat({digits(100, 2)}, ' ', {digits(10**4, 4)}, ' ', {digits(997, 4)}, ' ', {digits(991, 4)}, ' ', {digits(10, 1)})",
    "ukbank": f"concat({digits(10**6, 6)}, ' ', {digits(10**8, 8)})",
    "cabank": f"concat({digits(10**5, 5)}, '-', {digits(10**7, 7)})",
    "casin": f"concat({digits(1000, 3)}, ' ', {digits(997, 3)}, ' ', {digits(991, 3)})",
    "usssn": f"concat({digits(1000, 3)}, '-', {digits(100, 2)}, '-', {digits(10**4, 4)})",
    "medicare": f"concat({digits(1000, 3)}, ' ', {digits(100, 2)}, ' ', {digits(10**4, 4)})",
    "ukni": f"concat('AB', {digits(10**6, 6)}, 'C')",
    "passport": f"concat('A', {digits(10**6, 6)})",
    "iban": f"concat('FI', {digits(100, 2)}, ' ', {digits(10**4, 4)}, ' ', {digits(997, 4)}, ' ', {digits(991, 4)}, ' ', {digits(97, 2)})",
    "iban_compact": f"concat('FI', {digits(10**8, 16)})",
    "cc": "lpad(cast(4000000000000000 + k as string), 16, '0')",
    "cc_literal": "case when k % 2 = 0 then '4111 1111 1111 1111' else '340000000000009' end",
    "dob": "concat('19', lpad(cast(50 + k % 50 as string), 2, '0'), '-0', cast(1 + k % 9 as string), '-1', cast(k % 10 as string))",
    "dob_slashes": "concat('1', cast(k % 10 as string), '/0', cast(1 + k % 9 as string), '/1987')",
    "phone": f"concat('+358 40 ', {digits(10**7, 7)})",
    "email": "concat('user', cast(k as string), '@example.com')",
    "token": f"concat('Bearer eyJhbGciOi', {digits(10**6, 6)})",
    "apikey": f"concat('sk_test_4eC39HqLyjWD', {digits(10**6, 6)})",
    "mac": f"concat('00:1A:2B:', {digits(100, 2)}, ':', {digits(97, 2)}, ':5E')",
    "ipv6": f"concat('2001:0db8:85a3:0000:0000:8a2e:', {digits(10**4, 4)})",
    "ipv4": "concat('10.', cast(k % 256 as string), '.', cast((k * 7) % 256 as string), '.1')",
    "vehicle": f"concat('ABC-', {digits(10**4, 4)})",
    "vehicle_reverse": f"concat({digits(1000, 3)}, '-XYZ')",
    "near_miss": "concat(cast(k % 100 as string), ' AB-', cast(k % 10 as string), ' x@y A12 +')",
}

NAMED = f"""
select k, {VALUES['email']} as email, {VALUES['usssn']} as ssn, {VALUES['cc']} as card, {VALUES['ipv4']} as ip, {VALUES['phone']} as phone,
       name, seg, case k % 4 when 0 then 'DEBUG' when 1 then 'INFO' when 2 then 'WARNING' else 'ERROR' end as level, lower(seg) as channel,
       k % 97 as age, k % 3 = 0 as consent, cast(k as double) / 4 as score,
       concat('user ', {VALUES['email']}, ' ssn ', {VALUES['usssn']}, ' card ', {VALUES['cc']}, ' from ', {VALUES['ipv4']}, ' call ', {VALUES['phone']}) as message
from (select cast(c_custkey as bigint) as k, c_name as name, c_mktsegment as seg from {{customer}})
"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, email, ssn, card, ip, phone, name, seg, level, channel, age, consent, score, message."""
    return spark.sql(NAMED.format(customer="{customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def logs_sql() -> str:
    return f"({NAMED.format(customer='customer')})"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records: k, level, channel, message, and context struct<user: struct<...>, age, active, score, note, tags>."""
    user = F.struct("email", "ssn", "card", "name", F.col("consent").alias("agreed"))
    ctx = F.struct(user.alias("user"), "age", F.col("consent").alias("active"), "score", F.col("phone").alias("note"), F.array("ip", "name").alias("tags"))
    return logs(spark, sf_dir).select("k", "level", "channel", "message", ctx.alias("context"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(source: str) -> tuple[str, str]:
    """A default pattern for RE2, and what its replacement starts with: a lookbehind becomes a kept first group."""
    body = source[1 : source.rfind("/")].replace("\\/", "/")
    return (body.replace("(?<![\\d+])", "(^|[^\\d+])"), "\\1") if "(?<!" in body else (body, "")


def duck_chain(value: str, table=DEFAULTS) -> str:
    """DuckDB SQL of a value after patterns in turn."""
    for source, replacement in table:
        body, first = re2(source)
        value = f"regexp_replace({value}, {quoted(body)}, {quoted(first + replacement)}, 'g')"
    return value
