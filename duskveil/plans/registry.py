"""The queries that this library registers with the driver, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskveil.functions import callbacks, generalize, jsonmask, sanitize, serialized
from duskveil.functions.constants import FILTERED, REDACTED, TYPE_MASKS, mask
from duskveil.functions.patterns import DEFAULTS, Pattern, apply_patterns, compiled, matched_labels, matches, scrubbed_utf8
from duskveil.operators import audit, http, recovery, rules
from duskveil.operators import strategies as S
from duskveil.operators.config import Builder, Config, FieldMask, Plugin
from duskveil.operators.processor import Processor
from duskveil.operators.ratelimit import RateLimiter, epoch_seconds, limited_events
from duskveil.operators.retention import RetentionPolicy
from duskveil.streaming import stream

from .logs import VALUES, duck_chain, logs, logs_sql, quoted, re2, records

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}
LOGS = logs_sql()
EMAIL, SSN, CC, IP, PHONE = (mask(x) for x in ("EMAIL", "USSSN", "CC", "IPv4", "PHONE"))
MASKED_MESSAGE = quoted(f"user {EMAIL} ssn {SSN} card {CC} from {IP} call {PHONE}")
AS_OF = "2024-01-01 00:00:00"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        FOUND[name] = (f, sql)
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- patterns


@query("mask_documents", f"select doc_id, {duck_chain('text')} as masked from documents")
def _(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", apply_patterns(F.col("text"), compiled()).alias("masked"))


@query("mask_documents_stats", f"select lang, count(*) as processed, count(*) filter (where {duck_chain('text')} <> text) as masked from documents group by lang")
def _(spark, sf_dir):
    changed = apply_patterns(F.col("text"), compiled()) != F.col("text")
    return _table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("processed"), F.count_if(changed).alias("masked"))


_LABELS = list(dict.fromkeys(r for _, r in DEFAULTS))
_ANY = {label: " or ".join(f"regexp_matches(text, {quoted(re2(p)[0])})" for p, r in DEFAULTS if r == label) for label in _LABELS}


@query("label_counts", " union all ".join(f"select {quoted(label)} as label, count(*) as n_docs from documents where {test} having count(*) > 0" for label, test in _ANY.items()))
def _(spark, sf_dir):
    found = _table(spark, sf_dir, "documents").select(F.explode(matched_labels(F.col("text"), compiled())).alias("label"))
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n_docs"))


_EMAIL_PATTERN = next(p for p, r in DEFAULTS if r == EMAIL)


@query("pattern_matches", f"select doc_id, len(regexp_extract_all(text, {quoted(re2(_EMAIL_PATTERN)[0])})) as n, array_to_string(regexp_extract_all(text, {quoted(re2(_EMAIL_PATTERN)[0])}), '|') as found from documents where regexp_matches(text, {quoted(re2(_EMAIL_PATTERN)[0])})")
def _(spark, sf_dir):
    found = matches(F.col("text"), Pattern(_EMAIL_PATTERN, EMAIL))
    return _table(spark, sf_dir, "documents").select("doc_id", found.alias("f")).where("size(f) > 0").select("doc_id", F.size("f").cast("long").alias("n"), F.array_join("f", "|").alias("found"))


def _value_query(name: str, expression: str) -> None:
    text = f"concat('got ', {expression}, ' in row')"
    base = f"select cast(c_custkey as bigint) as k, {text.replace('k %', 'cast(c_custkey as bigint) %').replace('+ k', '+ cast(c_custkey as bigint)').replace('(k *', '(cast(c_custkey as bigint) *').replace('cast(k as', 'cast(cast(c_custkey as bigint) as')} as message from customer"

    @query(f"mask_{name}", f"select k, {duck_chain('message')} as masked from ({base})")
    def _(spark, sf_dir):
        rows = _table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as bigint) as k").selectExpr("k", f"{text} as message")
        return rows.select("k", apply_patterns(F.col("message"), compiled()).alias("masked"))


for _name, _expression in VALUES.items():
    _value_query(_name, _expression)


@query("mask_whole_value_key", f"select k, {quoted(mask('APIKEY'))} as masked from {LOGS}")
def _(spark, sf_dir):
    key = F.concat(F.lit("abcdefghijklmnopqrst"), F.translate(F.col("k").cast("string"), "0123456789", "abcdefghij"))
    return logs(spark, sf_dir).select("k", apply_patterns(key, compiled()).alias("masked"))


@query("mask_message", f"select k, {MASKED_MESSAGE} as message from {LOGS}")
def _(spark, sf_dir):
    return Processor().mask(logs(spark, sf_dir).select("k", "message"))


@query("mask_malformed_utf8", f"select k, concat('card ', {quoted(CC)}, ' raw=', chr(65533), '(') as masked from {LOGS}")
def _(spark, sf_dir):
    raw = F.concat(F.lit("card ").cast("binary"), F.col("card").cast("binary"), F.lit(" raw=").cast("binary"), F.lit(bytearray(b"\xc3(")))
    return logs(spark, sf_dir).select("k", apply_patterns(scrubbed_utf8(raw), compiled()).alias("masked"))


# --- fields, callbacks, types


def _flat(df: DataFrame) -> DataFrame:
    return df.select("k", "context.user.*", F.col("context.note").alias("note"))


@query("field_remove", f"select k, email, card, name, consent as agreed, {quoted(PHONE)} as note from (select k, {quoted(EMAIL)} as email, {quoted(CC)} as card, name, consent from {LOGS})")
def _(spark, sf_dir):
    return _flat(Processor(Config(fields={"user.ssn": FieldMask.remove()})).mask(records(spark, sf_dir)))


@query("field_replace", f"select k, {quoted(EMAIL)} as email, {quoted(SSN)} as ssn, 'MASKED' as card, 'gone' as name, consent as agreed, {quoted(PHONE)} as note from {LOGS}")
def _(spark, sf_dir):
    return _flat(Processor(Config(fields={"user.card": FieldMask.replace("MASKED"), "user.name": "gone"})).mask(records(spark, sf_dir)))


@query("field_regex", f"select k, {quoted(EMAIL)} as email, concat('###-##', substring(ssn, 7)) as ssn, {quoted(CC)} as card, name, consent as agreed, {quoted(PHONE)} as note from {LOGS}")
def _(spark, sf_dir):
    return _flat(Processor(Config(fields={"user.ssn": FieldMask.regex(r"/^\d{3}-\d{2}/", "###-##")})).mask(records(spark, sf_dir)))


@query("field_regex_backreference", f"select k, concat(substring(ssn, 8), ':', substring(ssn, 1, 3)) as ssn from {LOGS}")
def _(spark, sf_dir):
    return Processor(Config(fields={"user.ssn": FieldMask.regex(r"/^(\d+)-\d+-(\d+)$/", r"$2:\1")})).mask(records(spark, sf_dir)).select("k", "context.user.ssn")


@query("field_processor_patterns", f"select k, {quoted(EMAIL)} as email, name, cast(age as varchar) as age, case when consent then '1' else '' end as active from {LOGS}")
def _(spark, sf_dir):
    own = FieldMask.processor_patterns()
    out = Processor(Config(fields={"user.email": own, "age": own, "active": own})).mask(records(spark, sf_dir))
    return out.select("k", "context.user.email", "context.user.name", "context.age", "context.active")


@query("field_missing", f"select k, {quoted(EMAIL)} as email, name from {LOGS}")
def _(spark, sf_dir):
    out = Processor(Config(fields={"user.nothing": FieldMask.remove(), "no.such": "x"})).mask(records(spark, sf_dir))
    return out.select("k", "context.user.email", "context.user.name")


@query("field_on_json_container", f"select k, replace(concat('{{\"ip\":\"', ip, '\"}}'), '.', '-') as net from {LOGS}")
def _(spark, sf_dir):
    df = logs(spark, sf_dir).select("k", F.lit("").alias("message"), F.struct(F.struct("ip").alias("net")).alias("context"))
    return Processor(Config(fields={"net": FieldMask.regex(r"/\./", "-")})).mask(df).select("k", "context.net")


@query("callback_constant", f"select k, 'X' as email, upper(name) as name from {LOGS}")
def _(spark, sf_dir):
    config = Config(fields={"user.name": "unused"}, callbacks={"user.email": callbacks.constant("X"), "user.name": F.upper})
    return Processor(config).mask(records(spark, sf_dir)).select("k", "context.user.email", "context.user.name")


@query("callback_hash", f"select k, concat(substring(sha256(email), 1, 8), '...') as email, md5(ssn) as ssn from {LOGS}")
def _(spark, sf_dir):
    config = Config(callbacks={"user.email": callbacks.hashed(), "user.ssn": callbacks.hashed("md5", 0)})
    return Processor(config).mask(records(spark, sf_dir)).select("k", "context.user.email", "context.user.ssn")


@query("callback_partial", f"select k, concat(substring(card, 1, 2), repeat('*', length(card) - 4), right(card, 2)) as card, repeat('#', length(ssn)) as ssn from {LOGS}")
def _(spark, sf_dir):
    config = Config(callbacks={"user.card": callbacks.partial(), "user.ssn": callbacks.partial(6, 6, "#")})
    return Processor(config).mask(records(spark, sf_dir)).select("k", "context.user.card", "context.user.ssn")


@query("callback_opaque", f"select k, reverse(name) as name, card from {LOGS}")
def _(spark, sf_dir):
    def fails(x):
        raise ValueError(x)

    config = Config(callbacks={"user.name": callbacks.opaque(lambda x: x[::-1]), "user.card": callbacks.opaque(fails)})
    return Processor(config).mask(records(spark, sf_dir)).select("k", "context.user.name", "context.user.card")


@query("json_context_fields", f"select k, cast(null as varchar) as ssn, 'MASKED' as card, '{EMAIL}' as email, sha256(name) as name, 'X' as tag0, name as tag1, {quoted(PHONE)} as note, cast(age as varchar) as age from {LOGS}")
def _(spark, sf_dir):
    text = records(spark, sf_dir).withColumn("context", F.to_json("context"))
    config = Config(fields={"user.ssn": FieldMask.remove(), "user.card": FieldMask.replace("MASKED"), "user.email": FieldMask.processor_patterns(), "tags.0": "X", "user.none": "Y"}, callbacks={"user.name": callbacks.hashed("sha256", 0)})
    at = {"ssn": "user.ssn", "card": "user.card", "email": "user.email", "name": "user.name", "tag0": "tags[0]", "tag1": "tags[1]", "note": "note", "age": "age"}
    return Processor(config).mask(text).select("k", *(F.get_json_object("context", f"$.{p}").alias(n) for n, p in at.items()))


@query("json_context_rule", f"select k, case when consent and age = 5 then {MASKED_MESSAGE} else message end as message from {LOGS}")
def _(spark, sf_dir):
    text = records(spark, sf_dir).withColumn("context", F.to_json("context"))
    held = {"there": rules.has_field("user.ssn"), "on": rules.field_equals("active", True), "five": rules.field_equals("age", 5), "first": rules.has_field("tags.1")}
    return Processor(Config(rules=held)).mask(text).select("k", "message")


@query("json_context_rule_absent", f"select k, message from {LOGS}")
def _(spark, sf_dir):
    text = records(spark, sf_dir).withColumn("context", F.to_json("context"))
    return Processor(Config(rules={"none": rules.has_field("user.nothing"), "text": rules.field_equals("age", "5")})).mask(text).select("k", "message")


@query("map_nested_field", f"select k, 'MASKED' as a_ssn, '{EMAIL}' as a_email, '{SSN}' as b_ssn, cast(null as varchar) as b_email from {LOGS}")
def _(spark, sf_dir):
    df = logs(spark, sf_dir).select("k", "message", F.create_map(F.lit("a"), F.struct("ssn", "email"), F.lit("b"), F.struct("ssn", "email")).alias("context"))
    out = Processor(Config(fields={"a.ssn": "MASKED", "b.email": FieldMask.remove()})).mask(df)
    return out.select("k", *(F.col("context")[m][f].alias(f"{m}_{f}") for m in "ab" for f in ("ssn", "email")))


@query("list_fields", f"select k, 'FIRST' as first, '{EMAIL}' as second, 1 as n_left, 'GONE' as inner_ssn, {quoted(SSN)} as other_ssn from {LOGS}")
def _(spark, sf_dir):
    df = logs(spark, sf_dir).select("k", "message", F.struct(F.array("name", "email").alias("a"), F.array("ip", "card").alias("b"), F.array(F.struct("ssn"), F.struct("ssn")).alias("c")).alias("context"))
    out = Processor(Config(fields={"a.0": "FIRST", "b.1": FieldMask.remove(), "c.0.ssn": "GONE"})).mask(df)
    c = F.col("context")
    return out.select("k", c.a[0].alias("first"), c.a[1].alias("second"), F.size(c.b).alias("n_left"), c.c[0].ssn.alias("inner_ssn"), c.c[1].ssn.alias("other_ssn"))


@query("type_masks", f"select k, {quoted(TYPE_MASKS['integer'])} as age, {quoted(TYPE_MASKS['boolean'])} as active, cast(0 as double) as score, {quoted(PHONE)} as note, {quoted(EMAIL)} as email, {quoted(TYPE_MASKS['string'])} as name from {LOGS}")
def _(spark, sf_dir):
    config = Config(type_masks={"integer": TYPE_MASKS["integer"], "boolean": TYPE_MASKS["boolean"], "double": "0.0", "string": TYPE_MASKS["string"]})
    out = Processor(config).mask(records(spark, sf_dir))
    return out.select("k", "context.age", "context.active", "context.score", "context.note", "context.user.email", "context.user.name")


@query("type_masks_kept", f"select k, cast(7 as bigint) as age, true as active, score, {quoted(TYPE_MASKS['array'])} as tags from {LOGS}")
def _(spark, sf_dir):
    df = records(spark, sf_dir).withColumn("context", F.col("context").dropFields("user"))
    out = Processor(Config(type_masks={"integer": "7", "boolean": "true", "array": TYPE_MASKS["array"]})).mask(df)
    return out.select("k", "context.age", "context.active", "context.score", F.array_join("context.tags", ",").alias("tags"))


@query("type_masks_null", f"select k, case when k % 2 = 0 then {quoted(TYPE_MASKS['NULL'])} else cast(age as varchar) end as age from {LOGS}")
def _(spark, sf_dir):
    df = logs(spark, sf_dir).select("k", F.lit("").alias("message"), F.struct(F.when(F.col("k") % 2 != 0, F.col("age")).alias("age")).alias("context"))
    return Processor(Config(type_masks={"NULL": TYPE_MASKS["NULL"]})).mask(df).select("k", "context.age")


@query("type_sweep_after_fields", f"select k, 'S' as name, 'S' as note, concat('S', ',', 'S') as tags, 'kept' as email from {LOGS}")
def _(spark, sf_dir):
    out = Processor(Config(fields={"user.email": "kept"}, type_masks={"string": "S", "array": "A"})).mask(records(spark, sf_dir))
    return out.select("k", "context.user.name", "context.note", F.array_join("context.tags", ",").alias("tags"), "context.user.email")


@query("nested_recursive", f"select k, {quoted(EMAIL)} as email, {quoted(IP)} as first_tag, name as second_tag from {LOGS}")
def _(spark, sf_dir):
    return Processor().mask(records(spark, sf_dir)).select("k", "context.user.email", F.col("context.tags")[0].alias("first_tag"), F.col("context.tags")[1].alias("second_tag"))


@query("nested_max_depth", f"select k, {quoted(PHONE)} as note, email from {LOGS}")
def _(spark, sf_dir):
    return Processor(Config(max_depth=1)).mask(records(spark, sf_dir)).select("k", "context.note", "context.user.email")


@query("nested_map", f"select k, {quoted(EMAIL)} as mail, name as who from {LOGS}")
def _(spark, sf_dir):
    df = logs(spark, sf_dir).select("k", F.lit("").alias("message"), F.create_map(F.lit("mail"), F.col("email"), F.lit("who"), F.col("name")).alias("context"))
    return Processor().mask(df).select("k", F.col("context")["mail"].alias("mail"), F.col("context")["who"].alias("who"))


@query("map_fields", f"select k, 'M' as mail, cast(1 as bigint) as n from {LOGS}")
def _(spark, sf_dir):
    df = logs(spark, sf_dir).select("k", F.lit("").alias("message"), F.create_map(F.lit("mail"), F.col("email"), F.lit("who"), F.col("name")).alias("context"))
    out = Processor(Config(fields={"mail": "M", "who": FieldMask.remove()})).mask(df)
    return out.select("k", F.col("context")["mail"].alias("mail"), F.size("context").cast("long").alias("n"))


# --- JSON and dumps

_JSON = """concat('got {"id": ', cast(k as varchar), ', "email": "', email, '", "tags": [], "meta": {}, "n": 10.0} from ', ip)"""


@query("json_in_message", f"""select k, concat('got {{"id":', cast(k as varchar), ',"email":"{EMAIL}","tags":[],"meta":{{}},"n":10}} from {IP}') as masked from {LOGS}""")
def _(spark, sf_dir):
    df = logs(spark, sf_dir).select("k", F.expr(_JSON.replace("varchar", "string")).alias("m"))
    return df.select("k", jsonmask.mask_message(F.col("m"), jsonmask.ValueMasker(compiled())).alias("masked"))


@query("json_in_json", f"""select k, '{{"inner":"{{\\"ip\\":\\"{IP}\\"}}"}}' as masked from {LOGS}""")
def _(spark, sf_dir):
    inner = F.concat(F.lit('{"inner": "{\\"ip\\": \\"'), F.col("ip"), F.lit('\\"}"}'))
    return logs(spark, sf_dir).select("k", jsonmask.mask_message(inner, jsonmask.ValueMasker(compiled())).alias("masked"))


@query("json_invalid", f"""select k, 'broken {{"a": {IP}' as masked from {LOGS}""")
def _(spark, sf_dir):
    m = F.concat(F.lit('broken {"a": '), F.col("ip"))
    return logs(spark, sf_dir).select("k", jsonmask.mask_message(m, jsonmask.ValueMasker(compiled())).alias("masked"))


@query("json_context", f"""select k, concat('{{"user":{{"email":"{EMAIL}","name":"', name, '"}},"age":"{TYPE_MASKS['integer']}"}}') as context from {LOGS}""")
def _(spark, sf_dir):
    ctx = F.to_json(F.struct(F.struct("email", "name").alias("user"), "age"))
    df = logs(spark, sf_dir).select("k", F.lit("").alias("message"), ctx.alias("context"))
    return Processor(Config(type_masks={"integer": TYPE_MASKS["integer"]})).mask(df).select("k", "context")


@query("serialized_string", f"""select k, 's:11:"{EMAIL}";' as masked from {LOGS}""")
def _(spark, sf_dir):
    m = F.concat(F.lit("s:"), F.length("email").cast("string"), F.lit(':"'), F.col("email"), F.lit('";'))
    return logs(spark, sf_dir).select("k", serialized.mask_dumps(m, compiled()).alias("masked"))


@query("serialized_print_r", f"select k, concat('Array\n(\n    [name] => ', name, '\n    [email] => {EMAIL}\n)') as masked from {LOGS}")
def _(spark, sf_dir):
    m = F.concat(F.lit("Array\n(\n    [name] => "), F.col("name"), F.lit("\n    [email] => "), F.col("email"), F.lit("\n)"))
    return logs(spark, sf_dir).select("k", serialized.mask_dumps(m, compiled()).alias("masked"))


@query("serialized_var_export", f"select k, 'array ( ''email'' => ''{EMAIL}'', ''n'' => 3 )' as masked from {LOGS}")
def _(spark, sf_dir):
    m = F.concat(F.lit("array ( 'email' => '"), F.col("email"), F.lit("', 'n' => 3 )"))
    return logs(spark, sf_dir).select("k", serialized.mask_dumps(m, compiled()).alias("masked"))


# --- rules and strategies


def _ruled(spark, sf_dir, **named) -> DataFrame:
    return Processor(Config(rules=named)).mask(records(spark, sf_dir)).select("k", "message")


def _when(test: str) -> str:
    return f"select k, case when {test} then {MASKED_MESSAGE} else message end as message from {LOGS}"


@query("rule_level", _when("level in ('ERROR', 'WARNING')"))
def _(spark, sf_dir):
    return _ruled(spark, sf_dir, level=rules.level_in("ERROR", "WARNING"))


@query("rule_channel", _when("channel = 'building'"))
def _(spark, sf_dir):
    return _ruled(spark, sf_dir, channel=rules.channel_in("building"))


@query("rule_field_present", _when("true"))
def _(spark, sf_dir):
    return _ruled(spark, sf_dir, field=rules.has_field("user.agreed"))


@query("rule_field_missing", _when("false"))
def _(spark, sf_dir):
    return _ruled(spark, sf_dir, field=rules.has_field("user.nothing"))


@query("rule_field_value", _when("consent"))
def _(spark, sf_dir):
    return _ruled(spark, sf_dir, value=rules.field_equals("user.agreed", True))


@query("rule_value_of_other_type", _when("false"))
def _(spark, sf_dir):
    return _ruled(spark, sf_dir, value=rules.field_equals("age", "5"))


@query("rule_and", _when("level = 'ERROR' and consent and k % 2 = 1"))
def _(spark, sf_dir):
    return _ruled(spark, sf_dir, level=rules.level_in("ERROR"), value=rules.field_equals("user.agreed", True), own=lambda schema: F.col("k") % 2 == 1)


@query("rule_custom_error_passes", _when("true"))
def _(spark, sf_dir):
    return _ruled(spark, sf_dir, broken=rules.custom(lambda level: 1 / 0, "level"))


_CHANGED = {"message": "regex", "user.email": "regex", "user.ssn": "regex", "user.card": "callback", "user.agreed": "data_type", "active": "data_type", "age": "field_path", "note": "regex", "tags": "data_type"}


@query("audit_events", f"select path, original_type, operation, count(*) as n from (select 'conditional_skip' as path, 'array' as original_type, 'conditional' as operation from {LOGS} where level <> 'ERROR' union all select unnest({list(_CHANGED)}) as path, unnest(['string', 'string', 'string', 'string', 'boolean', 'boolean', 'integer', 'string', 'array']) as original_type, unnest({list(_CHANGED.values())}) as operation from {LOGS} where level = 'ERROR') group by all")
def _(spark, sf_dir):
    config = Config(rules={"level": rules.level_in("ERROR")}, fields={"age": "hidden"}, callbacks={"user.card": callbacks.partial()}, type_masks={"boolean": "B"})
    return Processor(config).audit(records(spark, sf_dir)).groupBy("path", "original_type", "operation").agg(F.count(F.lit(1)).alias("n"))


@query("audit_event_kinds", f"select unnest(['conditional_error', 'json_masked', 'malformed_utf8_scrubbed', 'message', 'user.name_callback_error']) as path, unnest([count(*), count(*), count(*) filter (where k % 3 = 0), count(*), count(*)]) as n from {LOGS}")
def _(spark, sf_dir):
    text = F.concat(F.lit('{"ip":"'), F.col("context.tags")[0], F.lit('"} '))
    df = records(spark, sf_dir).withColumn("message", F.when(F.col("k") % 3 == 0, F.concat(text.cast("binary"), F.unhex(F.lit("C328")))).otherwise(text.cast("binary")))

    def fails(*values):
        raise ValueError("no")

    config = Config(rules={"bad": rules.custom(fails, "level")}, callbacks={"user.name": callbacks.opaque(fails)}, fields={"user.email": FieldMask.remove(), "user.ssn": FieldMask.remove(), "user.card": FieldMask.remove(), "note": FieldMask.remove(), "tags": FieldMask.remove()})
    found = Processor(config).audit(df).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return found.where("path not in ('user.email', 'user.ssn', 'user.card', 'note', 'tags')")


@query("audit_depth", f"select path, n from (select 'max_depth_reached' as path, count(*) as n from {LOGS} union all select 'message', count(*) from {LOGS} union all select 'note', count(*) from {LOGS})")
def _(spark, sf_dir):
    df = records(spark, sf_dir).withColumn("context", F.struct("context.user", "context.note"))
    return Processor(Config(max_depth=1)).audit(df).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("audit_anonymized", f"select 'k-anonymity.age' as path, 'bigint' as original_type, count(*) as n from {LOGS}")
def _(spark, sf_dir):
    return generalize.Anonymizer().age("age").numeric("missing", 5).audit(logs(spark, sf_dir)).groupBy("path", "original_type").agg(F.count(F.lit(1)).alias("n"))


@query("strategy_priority", f"select k, 'PATH' as email, {quoted(SSN)} as ssn, {quoted(TYPE_MASKS['string'])} as name, '5' as age from {LOGS}")
def _(spark, sf_dir):
    manager = S.StrategyManager([S.DataTypeStrategy(masks={"string": TYPE_MASKS["string"], "integer": "5"}), S.RegexStrategy(patterns=dict(DEFAULTS), include=["user.*"]), S.FieldPathStrategy(fields={"user.email": "PATH"})])
    return manager.mask(records(spark, sf_dir)).select("k", "context.user.email", "context.user.ssn", "context.user.name", "context.age")


@query("strategy_include_exclude", f"select k, email, {quoted(SSN)} as ssn, phone as note from {LOGS}")
def _(spark, sf_dir):
    manager = S.StrategyManager([S.RegexStrategy(patterns=dict(DEFAULTS), include=["user.*"], exclude=["*.email"])])
    return manager.mask(records(spark, sf_dir)).select("k", "context.user.email", "context.user.ssn", "context.note")


@query("strategy_list", f"select k, {quoted(IP)} as first, 'N' as second, {quoted(EMAIL)} as mail, phone as note from {LOGS}")
def _(spark, sf_dir):
    manager = S.StrategyManager([S.RegexStrategy(patterns=dict(DEFAULTS), include=["tags.*"]), S.FieldPathStrategy(fields={"tags.1": "N"})])
    df = records(spark, sf_dir).withColumn("context", F.struct(F.concat("context.tags", F.array("context.user.email")).alias("tags"), "context.note"))
    return manager.mask(df).select("k", F.col("context.tags")[0].alias("first"), F.col("context.tags")[1].alias("second"), F.col("context.tags")[2].alias("mail"), "context.note")


@query("strategy_map", f"select k, 'C' as card, {quoted(EMAIL)} as email, phone as note, upper(name) as name from {LOGS}")
def _(spark, sf_dir):
    manager = S.StrategyManager([S.FieldPathStrategy(fields={"card": "C"}), S.RegexStrategy(patterns={p: r for p, r in DEFAULTS if r == EMAIL}), S.CallbackStrategy(path="who.name", callback=F.upper)])
    flat = F.create_map(*(x for c in ("card", "email") for x in (F.lit(c), F.col(c))), F.lit("note"), F.col("phone"))
    df = logs(spark, sf_dir).select("k", "message", F.struct("name", "card").alias("who"), flat.alias("context"))
    left = manager.mask(df.drop("who"))
    right = manager.mask(df.select("k", F.struct(F.create_map(F.lit("name"), F.col("who.name")).alias("who")).alias("context"))).select("k", F.col("context.who")["name"].alias("name"))
    return left.select("k", *(F.col("context")[n].alias(n) for n in ("card", "email", "note"))).join(right, "k")


@query("strategy_conditional_or", f"select k, case when level = 'ERROR' or consent then 'C' else email end as email from {LOGS}")
def _(spark, sf_dir):
    inner = S.FieldPathStrategy(fields={"user.email": "C"})
    manager = S.StrategyManager([S.ConditionalStrategy(inner=inner, rules={"a": rules.level_in("ERROR"), "b": rules.field_equals("user.agreed", True)}, require_all=False)])
    return manager.mask(records(spark, sf_dir)).select("k", "context.user.email")


@query("strategy_conditional_error", f"select k, email from {LOGS}")
def _(spark, sf_dir):
    inner = S.FieldPathStrategy(fields={"user.email": "C"})
    manager = S.StrategyManager([S.ConditionalStrategy(inner=inner, rules={"a": rules.custom(lambda x: 1 / 0, "level", on_error=False)})])
    return manager.mask(records(spark, sf_dir)).select("k", "context.user.email")


@query("strategy_callback", f"select k, upper(name) as name, 'w' as ssn from {LOGS}")
def _(spark, sf_dir):
    manager = S.StrategyManager([S.CallbackStrategy(path="user.name", callback=F.upper), S.CallbackStrategy(path="*.ssn", callback=callbacks.constant("w"), exact=False)])
    return manager.mask(records(spark, sf_dir)).select("k", "context.user.name", "context.user.ssn")


@query("strategy_field_types", f"select k, cast(null as varchar) as ssn, cast(3 as bigint) as age, true as active, concat('#', substring(card, 5)) as card from {LOGS}")
def _(spark, sf_dir):
    manager = S.StrategyManager([S.FieldPathStrategy(fields={"user.ssn": FieldMask.remove(), "age": FieldMask.replace("3"), "active": FieldMask.replace("yes"), "*.card": FieldMask.regex(r"/^\d{4}/", "#")})])
    return manager.mask(records(spark, sf_dir)).select("k", "context.user.ssn", "context.age", "context.active", "context.user.card")


@query("strategy_applicable", f"select k, case when k % 2 = 0 then 'FieldPathStrategy,RegexStrategy' else 'FieldPathStrategy' end as names from {LOGS}")
def _(spark, sf_dir):
    df = logs(spark, sf_dir).select("k", F.when(F.col("k") % 2 == 0, F.col("email")).otherwise(F.lit("plain")).alias("v"))
    manager = S.StrategyManager([S.RegexStrategy(patterns=dict(DEFAULTS)), S.FieldPathStrategy(fields={"v": "x"})])
    return df.select("k", F.array_join(manager.applicable("v", F.col("v"), df.schema["v"].dataType, df.schema), ",").alias("names"))


class _Shout(Plugin):
    name, priority = "shout", 10

    def before_message(self, message):
        return F.concat(F.lit("1"), message)

    def after_message(self, message):
        return F.concat(message, F.lit("!"))


class _Mark(Plugin):
    name = "mark"

    def patterns(self):
        return {r"/\buser\b/": "person"}

    def before_message(self, message):
        return F.concat(F.lit("2"), message)

    def after_message(self, message):
        return F.concat(message, F.lit("?"))


@query("plugins", f"select k, concat('21', message, '?!') as message from (select k, replace({MASKED_MESSAGE}, 'user ', 'user ') as message from {LOGS})")
def _(spark, sf_dir):
    built = Builder().default_patterns().plugin(_Mark()).plugin(_Shout()).build()
    return built.mask(logs(spark, sf_dir).select("k", "message"))


@query("builder_order", f"select k, replace({MASKED_MESSAGE}, {quoted(EMAIL)}, 'first') as message from {LOGS}")
def _(spark, sf_dir):
    built = Builder().pattern(_EMAIL_PATTERN, "zero").default_patterns().pattern(_EMAIL_PATTERN, "first").build()
    return built.mask(logs(spark, sf_dir).select("k", "message"))


# --- generalization and retention

_PEOPLE = "(select cast(c_custkey as bigint) as k, cast(c_custkey % 97 as bigint) as age, lpad(cast(c_custkey % 100000 as varchar), 5, '0') as zip_code, cast(c_acctbal as double) as balance from customer)"


def _people(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as bigint) as k", "cast(c_custkey % 97 as bigint) as age", "lpad(cast(c_custkey % 100000 as string), 5, '0') as zip_code", "cast(c_acctbal as double) as balance")


def _range(value: str, size: int) -> str:
    low = f"cast(floor({value} / {size}.0) * {size} as bigint)"
    return f"concat(cast({low} as varchar), '-', cast({low} + {size - 1} as varchar))"


@query("anonymize_age", f"select k, {_range('age', 10)} as tens, {_range('age', 5)} as fives from {_PEOPLE}")
def _(spark, sf_dir):
    return _people(spark, sf_dir).select("k", generalize.age_range(F.col("age")).alias("tens"), generalize.age_range(F.col("age"), 5).alias("fives"))


@query("anonymize_number", f"select k, {_range('balance', 1000)} as balance from {_PEOPLE}")
def _(spark, sf_dir):
    return generalize.Anonymizer().numeric("balance", 1000).anonymize(_people(spark, sf_dir)).select("k", "balance")


@query("anonymize_location", f"select k, concat(substring(zip_code, 1, 3), '**') as zip_code from {_PEOPLE}")
def _(spark, sf_dir):
    return generalize.Anonymizer().location("zip_code").anonymize(_people(spark, sf_dir)).select("k", "zip_code")


@query("anonymize_date", "select o_orderkey, strftime(o_orderdate, '%Y') as y, concat(strftime(o_orderdate, '%Y'), '-Q', cast(quarter(o_orderdate) as varchar)) as q, strftime(o_orderdate, '%Y-%m') as m from orders")
def _(spark, sf_dir):
    d = F.col("o_orderdate")
    return _table(spark, sf_dir, "orders").select("o_orderkey", *(generalize.date_part(d, p).alias(n) for n, p in (("y", "year"), ("q", "quarter"), ("m", "month"))))


@query("anonymize_defaults", f"select k, {_range('age', 10)} as age, concat(substring(zip_code, 1, 3), '**') as zip_code, balance from {_PEOPLE}")
def _(spark, sf_dir):
    return generalize.Anonymizer.defaults().anonymize(_people(spark, sf_dir))


@query("group_sizes", f"select {_range('age', 10)} as age, concat(substring(zip_code, 1, 3), '**') as zip_code, count(*) as group_size, count(*) >= 5 as k_ok from {_PEOPLE} group by 1, 2")
def _(spark, sf_dir):
    return generalize.group_sizes(generalize.Anonymizer.defaults().anonymize(_people(spark, sf_dir)), ["age", "zip_code"], 5)


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query("retention_within", f"select event_id from events where ts >= timestamp '{AS_OF}' - interval 30 days")
def _(spark, sf_dir):
    return RetentionPolicy.delete_after(30).apply(_table(spark, sf_dir, "events"), "ts", _as_of()).select("event_id")


@query("retention_archive", f"select event_id, not (ts >= timestamp '{AS_OF}' - interval 2555 days) as archived from events")
def _(spark, sf_dir):
    policy, df = RetentionPolicy.archive(), _table(spark, sf_dir, "events")
    kept, moved = (x.select("event_id", F.lit(a).alias("archived")) for x, a in ((policy.apply(df, "ts", _as_of()), False), (policy.archived(df, "ts", _as_of()), True)))
    return kept.unionByName(moved)


@query("retention_anonymize", f"select event_id, case when ts >= timestamp '{AS_OF}' - interval 90 days then cast(event_type as varchar) else {quoted(REDACTED)} end as event_type from events")
def _(spark, sf_dir):
    return RetentionPolicy.anonymize(["event_type"], 90).apply(_table(spark, sf_dir, "events"), "ts", _as_of()).select("event_id", "event_type")


# --- limiter and audit

_CALLS = "(select event_id, event_type, cast(floor(epoch(ts)) as bigint) as s from events)"


def _limited_sql(limit: int, window: int) -> str:
    return f"""
with recursive e as (select *, row_number() over (partition by event_type order by s, event_id) as n from {_CALLS}),
r as (
  select event_type, event_id, n, [s] as held, true as allowed from e where n = 1
  union all
  select event_type, event_id, n, case when len(live) < {limit} then list_append(live, s) else live end, len(live) < {limit}
  from (select e.event_type, e.event_id, e.n, e.s, list_filter(r.held, lambda x: x > e.s - {window}) as live from r join e on e.event_type = r.event_type and e.n = r.n + 1)
)
select event_id, event_type, allowed from r"""


def _calls(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", "event_type", epoch_seconds(F.col("ts")).alias("s"))


@query("rate_limit", _limited_sql(3, 3600))
def _(spark, sf_dir):
    return RateLimiter(3, 3600).allowed(_calls(spark, sf_dir), "event_type", "s", "event_id").select("event_id", "event_type", "allowed")


@query("rate_limit_status", f"with a as ({_limited_sql(3, 3600)}), c as (select a.event_type, s from a join {_CALLS} c using (event_id) where allowed), m as (select max(s) as now from {_CALLS}) select event_type, count(*) as current_requests, greatest(0, 3 - count(*)) as remaining_requests, greatest(0, min(s) + 3600 - any_value(now)) as time_until_reset from c, m where s > now - 3600 group by event_type")
def _(spark, sf_dir):
    calls = _calls(spark, sf_dir)
    now = calls.agg(F.coalesce(F.max("s"), F.lit(0))).scalar()
    return RateLimiter(3, 3600).status(calls, "event_type", "s", "event_id", now)


_PATHS = "case k % 6 when 0 then 'json_masked' when 1 then 'conditional_skip' when 2 then 'regex_error' when 3 then 'preg_replace_error' when 4 then 'x_callback_error' else 'user.email' end"
_GROUP = "case when path like '%json\\_%' escape '\\' then 'json_operations' when path like '%conditional\\_%' escape '\\' then 'conditional_operations' when path like '%regex\\_%' escape '\\' then 'regex_operations' when path like '%preg\\_replace\\_%' escape '\\' then 'regex_operations' when path like '%error%' then 'error_operations' else 'general_operations' end"


@query("audit_groups", f"select path, {_GROUP} as operation_group, count(*) as n from (select {_PATHS} as path from {LOGS}) group by path")
def _(spark, sf_dir):
    df = logs(spark, sf_dir).select(F.expr(_PATHS).alias("path"))
    return df.groupBy("path", audit.operation_group(F.col("path")).alias("operation_group")).agg(F.count(F.lit(1)).alias("n"))


def _sliding(name: str, rows: str, limit: int, window: int) -> str:
    """Common table ``name`` (g, s, o, allowed) of calls (g: group, s: second, o: order) under a sliding log."""
    return f"""
{name}_calls as (select *, row_number() over (partition by g order by s, o) as n from ({rows})),
{name} as (
  select g, s, o, n, [s] as held, true as allowed from {name}_calls where n = 1
  union all
  select g, s, o, n, case when len(live) < {limit} then list_append(live, s) else live end, len(live) < {limit}
  from (select c.g, c.s, c.o, c.n, list_filter(r.held, lambda x: x > c.s - {window}) as live from {name} r join {name}_calls c on c.g = r.g and c.n = r.n + 1)
)"""


_EVENTS = f"select {_GROUP} as g, floor(k / 50) as s, k as o from (select {_PATHS} as path, k from {LOGS})"
_LIMITED = f"""
with recursive {_sliding('judged', _EVENTS, 50, 60)}, denied as materialized (select g, s, o from judged where not allowed),
{_sliding('warned', 'select * from denied', 1, 60)},
p as (select {_PATHS} as path, k from {LOGS})
select path, count(*) as n from (select path from p join judged on k = o where allowed union all select 'rate_limit_exceeded' from warned where allowed) group by path"""


@query("audit_limited", _LIMITED)
def _(spark, sf_dir):
    events = logs(spark, sf_dir).select(F.expr(_PATHS).alias("path"), (F.col("k") / 50).cast("long").alias("s"), F.col("k").alias("seq"))
    out = limited_events(events, RateLimiter(50, 60), "s", "seq")
    return out.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("audit_without_values", f"select 'user.email' as path, 'string' as original_type, k % 2 = 0 as was_masked, count(*) as n from {LOGS} group by k % 2 = 0")
def _(spark, sf_dir):
    masked = F.when(F.col("k") % 2 == 0, F.lit(EMAIL)).otherwise(F.col("email"))
    events = logs(spark, sf_dir).select(F.lit("user.email").alias("path"), F.col("email").alias("original"), masked.alias("masked"))
    return audit.without_values(events).groupBy("path", "original_type", "was_masked").agg(F.count(F.lit(1)).alias("n"))


@query("audit_structured", f"select 'regex' as operation_type, 'failed' as status, 'password=[REDACTED] at [PATH]' as error, count(*) as n from {LOGS}")
def _(spark, sf_dir):
    error = F.concat(F.lit("password="), F.col("ssn"), F.lit(" at /home/"), F.col("k").cast("string"))
    out = audit.structured(logs(spark, sf_dir), "regex", "failed", 2, error).select("audit_context.*")
    return out.groupBy("operation_type", "status", F.replace("error", F.lit("/[PATH_REDACTED]"), F.lit("[PATH]")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


# --- errors, fallbacks, HTTP


@query("sanitize_errors", f"select k, concat('fail password=*** host=*** user=*** token=*** sk_*** at /***/secret/*** net ***.***.*** ', case when k % 2 = 0 then concat(repeat('x', 500 - length('fail password=*** host=*** user=*** token=*** sk_*** at /***/secret/*** net ***.***.*** ')), '... (truncated for security)') else 'end' end) as message from {LOGS}")
def _(spark, sf_dir):
    tail = F.when(F.col("k") % 2 == 0, F.repeat(F.lit("x"), F.lit(600))).otherwise(F.lit("end"))
    m = F.concat(F.lit("fail password="), F.col("ssn"), F.lit(" host=db-1.local user="), F.col("email"), F.lit(" token=abc sk_live9 at /etc/app/secret/x.pem net "), F.col("ip"), F.lit(" "), tail)
    return logs(spark, sf_dir).select("k", sanitize.sanitize_message(m).alias("message"))


@query("fallback_masks", f"select k, concat('***STRING*** (', cast(length(email) as varchar), ' chars)') as email, '***STRING***' as short, '***INT***' as age, '***BOOL***' as consent, '***ARRAY*** (2 items)' as tags, '***REDACTED***' as closed, email as opened, '***NULL***' as nothing from {LOGS}")
def _(spark, sf_dir):
    df, fb = logs(spark, sf_dir).withColumns({"tags": F.array("ip", "name"), "short": F.lit("ten chars!"), "nothing": F.lit(None).cast("string")}), recovery.FallbackMask()
    one = lambda c: fb.column(F.col(c), df.schema[c].dataType).alias(c)
    modes = [fb.column(F.col("email"), df.schema["email"].dataType, m).alias(n) for n, m in (("closed", recovery.FailureMode.CLOSED), ("opened", recovery.FailureMode.OPEN))]
    return df.select("k", *map(one, ("email", "short", "age", "consent", "tags", "nothing")), *modes)


@query("http_headers", f"select k, {quoted(FILTERED)} as auth, {quoted(FILTERED)} as cookie, 'curl' as agent, {quoted(IP)} as ip from {LOGS}")
def _(spark, sf_dir):
    headers = F.create_map(F.lit("Authorization"), F.array("email"), F.lit("cookie"), F.array("ssn"), F.lit("Agent"), F.array(F.lit("curl")))
    df = logs(spark, sf_dir).select("k", "ip", headers.alias("headers"))
    out = http.mask_http(df.select("ip", "headers", F.col("k").alias("k")), Processor())
    return out.select("k", F.col("headers")["Authorization"][0].alias("auth"), F.col("headers")["cookie"][0].alias("cookie"), F.col("headers")["Agent"][0].alias("agent"), "ip")


@query("http_levels", f"select k, case when k % 700 >= 500 then 'error' when k % 700 >= 400 then 'warning' else 'info' end as level, case when k % 2 = 0 and k % 3 = 0 then name end as body from {LOGS}")
def _(spark, sf_dir):
    method = F.when(F.col("k") % 2 == 0, F.lit("POST")).otherwise(F.lit("GET"))
    kind = F.when(F.col("k") % 3 == 0, F.lit("application/json; charset=utf-8"))
    return logs(spark, sf_dir).select("k", http.level_of(F.col("k") % 700).alias("level"), http.request_body(method, kind, F.col("name")).alias("body"))


@query("http_bodies", f"""select k, case when k % 3 = 0 then concat('{{"mail":"{EMAIL}"}}') when k % 3 = 1 then '{{"error":"Invalid JSON response"}}' else concat(repeat('é', 500), '...') end as body, 'a' as fields from {LOGS}""")
def _(spark, sf_dir):
    kind = F.when(F.col("k") % 3 < 2, F.lit("application/json")).otherwise(F.lit("text/plain"))
    body = F.when(F.col("k") % 3 == 0, F.concat(F.lit('{"mail": "'), F.col("email"), F.lit('"}'))).when(F.col("k") % 3 == 1, F.lit("{no json")).otherwise(F.lit("é" * 501))
    form = F.create_map(F.lit("a"), F.lit("1"), F.lit("_token"), F.lit("t"))
    df = logs(spark, sf_dir).select("k", http.response_body(body, kind).alias("body"), F.array_join(F.map_keys(http.form_fields(form)), ",").alias("fields"))
    return http.mask_http(df.select("body", "fields", F.col("k").alias("k")), Processor()).select("k", "body", "fields")


# --- streams


@query("stream_statistics", f"select count(*) as processed, count(*) as masked, cast(0 as bigint) as errors from {LOGS}")
def _(spark, sf_dir):
    return stream.statistics(records(spark, sf_dir).select("message", "context", "k"), Processor())


@query("stream_masked", f"select {MASKED_MESSAGE} as message, {quoted(EMAIL)} as email from {LOGS}")
def _(spark, sf_dir):
    return stream.mask_stream(records(spark, sf_dir), Processor(Config(rules={"never": lambda schema: F.lit(False)}))).select("message", "context.user.email")


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
