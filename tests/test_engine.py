import json

import pytest
from pyspark.sql import functions as F

from duskveil.functions import generalize, jsonmask, serialized
from duskveil.functions.errors import ConfigurationError, StreamError
from duskveil.functions.patterns import compiled
from duskveil.operators import recovery, report, strategies
from duskveil.operators.config import Builder, Config, FieldMask
from duskveil.operators.processor import Processor
from duskveil.operators.ratelimit import Log, RateLimiter
from duskveil.operators.retention import RetentionPolicy
from duskveil.sources import files
from duskveil.streaming import stream

SECRET = jsonmask.ValueMasker(compiled({"/secret/": "***"}))


@pytest.mark.parametrize("text,want", [
    ('{"meta": {}, "v": "secret"}', '{"meta":{},"v":"***"}'),
    ('{"note": "array literal [] here", "meta": {}, "v": "secret"}', '{"note":"array literal [] here","meta":{},"v":"***"}'),
    ('{"a": {}, "b": {"c": {}}, "v": "secret"}', '{"a":{},"b":{"c":{}},"v":"***"}'),
    ('{"list": [], "meta": {}, "v": "secret"}', '{"list":[],"meta":{},"v":"***"}'),
    ('a {"x": 1} b [1, 2.0, "secret"] c', 'a {"x":1} b [1,2,"***"] c'),
    ('{"broken": secret', '{"broken": ***'), ("[not json secret]", "[not json ***]"), ('{"q": "a\\"}b", "v": "secret"}', '{"q":"a\\"}b","v":"***"}'),
    ('{"i": "{\\"v\\": \\"secret\\"}"}', '{"i":"{\\"v\\":\\"***\\"}"}'), ("", ""), ("[[[", "[[["), ('{"u":"é/ü"}', '{"u":"é/ü"}'), ('{"n":12345678901234567890}', '{"n":1.2345678901234567e+19}'),
])
def test_json_in_messages(text, want):
    assert SECRET.message(text) == want


def test_json_depth_and_types():
    m = jsonmask.ValueMasker(compiled({}), {"integer": "***INT***", "boolean": "false", "NULL": "***NULL***", "array": "recursive", "double": "0"}, max_depth=3)
    assert m.nested({"a": 1, "b": True, "c": None, "d": 1.5, "e": {"f": 2}}) == {"a": "***INT***", "b": False, "c": "***NULL***", "d": 0.0, "e": {"f": "***INT***"}}
    deep = json.loads('{"a":{"a":{"a":{"a":1}}}}')
    assert m.nested(deep) == deep and m.nested({"a": {"a": {"n": 1}}}) == {"a": {"a": {"n": "***INT***"}}}
    assert jsonmask.ValueMasker([], {"array": "***ARRAY***"}).nested({"x": [1]}) == {"x": ["***ARRAY***"]}


EMAILS = serialized.DumpMasker(lambda s: s.replace("john@example.com", "***EMAIL***").replace("test@example.com", "***EMAIL***"))


@pytest.mark.parametrize("text,want", [
    ("Array\n(\n    [name] => John\n    [email] => john@example.com\n    [sub] => Array\n        (\n            [e] => john@example.com\n        )\n)", "Array\n(\n    [name] => John\n    [email] => ***EMAIL***\n    [sub] => Array\n        (\n            [e] => ***EMAIL***\n        )\n)"),
    ("array ( 'email' => 'john@example.com', )", "array ( 'email' => '***EMAIL***', )"),
    ('s:16:"test@example.com";', 's:11:"***EMAIL***";'), ('s:99:"test@example.com";', 's:99:"test@example.com";'),
    ('x {"a": {}, "e": "john@example.com"}', 'x {"a":[],"e":"***EMAIL***"}'), ("plain john@example.com", "plain john@example.com"), ("", ""),
])
def test_dumps(text, want):
    assert EMAILS.process(text) == want


def test_dump_audit():
    seen = []
    serialized.DumpMasker(lambda s: "X", lambda *e: seen.append(e)).process('{"a": ["b"]}')
    assert seen == [("json.a.0", "b", "X")]


def test_json_inside_arrays_and_maps(spark):
    df = spark.createDataFrame([(["plain", '{"v": "secret"}', None], {"k": '["secret"]', "n": None}, [("secret [x]", 5)]), (None, {}, [])], "a array<string>, m map<string,string>, s array<struct<t:string,n:long>>")
    row = df.select("*", F.struct("a", "m", "s").alias("context"), F.lit("secret").alias("message")).select("message", "context")
    out = [r["context"].asDict(True) for r in Processor(Config(patterns={"/secret/": "***"})).mask(row).collect()]
    assert out[0] == {"a": ["plain", '{"v":"***"}', None], "m": {"k": '["***"]', "n": None}, "s": [{"t": "*** [x]", "n": 5}]}
    assert out[1] == {"a": None, "m": {}, "s": []}


def test_rules_keep_records_whole(spark):
    df = spark.createDataFrame([(1, "ERROR", "a@b.co", ("a@b.co", 5)), (2, "INFO", "a@b.co", ("a@b.co", 5))], "k long, level string, message string, context struct<m:string,n:long>")
    out = Builder().default_patterns().type_mask("integer", "***INT***").rule("l", __import__("duskveil.operators.rules", fromlist=["x"]).level_in("ERROR")).build().mask(df)
    got = {r["k"]: (r["message"], json.loads(r["context"])) for r in out.collect()}
    assert got == {1: ("***EMAIL***", {"m": "***EMAIL***", "n": "***INT***"}), 2: ("a@b.co", {"m": "a@b.co", "n": 5})}


def test_masking_is_one_projection(spark):
    plan = Processor(Config(fields={"n": "x"})).mask(spark.createDataFrame([("m", (1, "s"))], "message string, context struct<n:long,s:string>"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_field_mask_dicts():
    for how in (FieldMask.remove(), FieldMask.replace("x"), FieldMask.processor_patterns(), FieldMask.regex("/a::b/", "c")):
        assert FieldMask.from_dict(how.to_dict()) == how
    for bad in ({"type": "replace"}, {"type": "nope"}, {"type": "mask_regex", "pattern": "/(a+)+/"}):
        with pytest.raises(Exception):  # noqa: B017
            FieldMask.from_dict(bad)
    with pytest.raises(ConfigurationError):
        Config(max_depth=0)


def test_generalization(spark):
    df = spark.createDataFrame([(25, "2024-08-15", "12345", 52500.0), (None, None, None, None), (-3, "junk", "12", -1.0)], "age long, created_at string, zip_code string, salary double")
    out = generalize.Anonymizer.defaults().numeric("salary", 1000).anonymize(df).collect()
    assert [tuple(r) for r in out] == [("20-29", "2024-08", "123**", "52000-52999"), (None, None, None, None), ("-10--1", None, "12", "-1000--1")]


def test_limiter_against_a_plain_log(spark):
    import random

    rng = random.Random(1)
    rows = [(f"k{rng.randrange(3)}", rng.randrange(200), i) for i in range(800)]
    want, logs = {}, {}
    for k, s, i in sorted(rows, key=lambda r: (r[1], r[2])):
        live = logs[k] = [t for t in logs.get(k, []) if t > s - 20]
        want[i] = len(live) < 5
        if want[i]:
            live.append(s)
    df = spark.createDataFrame(rows, "key string, s long, i long")
    assert {r["i"]: r["allowed"] for r in RateLimiter(5, 20).allowed(df, "key", "s", "i").collect()} == want
    assert RateLimiter.profile("strict").limit == 50 and RateLimiter.profile("other").limit == 100
    log = Log(2, 10)
    assert [log.take(t, 3) for t in (0, 5, 10, 10, 20)] == [2, 0, 2, 0, 2]


def test_retention_boundary(spark):
    df = spark.sql("select * from values (1, timestamp_ntz'2024-01-01 00:00:00'), (2, timestamp_ntz'2023-12-02 00:00:00'), (3, timestamp_ntz'2023-12-01 23:59:59'), (4, cast(null as timestamp_ntz)) t(id, ts)")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    assert [r["id"] for r in RetentionPolicy.delete_after(30).apply(df, "ts", now).collect()] == [1, 2, 4]
    with pytest.raises(ConfigurationError):
        RetentionPolicy("x", 1, "shred")


def test_recovery():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("again")
        return "ok"

    assert recovery.Retry(base_ms=1).run(flaky, "v") == recovery.Outcome("ok", "recovered", 3)
    out = recovery.Retry.none().run(lambda: 1 / 0, "longer than ten")
    assert (out.value, out.kind) == ("***STRING*** (15 chars)", "fallback")
    assert recovery.Retry.thorough().run(lambda: 1 / 0, 5).value == "***REDACTED***"
    assert [recovery.Retry().delay_ms(n) for n in (1, 2, 3, 4, 5)] == [10, 20, 40, 80, 100]
    assert not recovery.Retry.recoverable(recovery.OperationError("ReDoS found")) and recovery.Retry.recoverable(ValueError())
    fb = recovery.FallbackMask()
    assert [fb.value(v) for v in (1, 1.5, True, None, [], [1, 2], "short")] == ["***INT***", "***FLOAT***", "***BOOL***", "***NULL***", "***ARRAY***", "***ARRAY*** (2 items)", "***STRING***"]


def test_strategies_on_the_driver():
    m = strategies.StrategyManager.defaults()
    assert [s.priority for s in m.ordered] == [60, 40] and m.statistics()["priority_distribution"] == {"60-79 (Medium-High)": 1, "40-59 (Medium)": 1}
    assert m.remove_kind(strategies.RegexStrategy) == 1 and m.remove(m.strategies[0]) and m.strategies == []
    with pytest.raises(Exception):  # noqa: B017
        m.add(strategies.RegexStrategy(patterns={"/(a+)+/": "x"}))
    with pytest.raises(ConfigurationError):
        m.add(strategies.FieldPathStrategy(fields={"a": FieldMask.processor_patterns()}))
    assert strategies.path_matches("a.b.c", "a.*") and strategies.path_matches("a.b.c", "*.c") and not strategies.path_matches("a.b", "a")
    assert strategies.parsed_list('["a",1]') == ["a", "1"] and strategies.parsed_list("[a,b]") == ["a", "b"] and strategies.parsed_list("") == []


def test_report():
    out = report.try_patterns("a@b.co 12", {"/\\d+/": "#", "/(a+)+/": "x"})
    assert out == {"masked": "a@b.co #", "matches": {"/\\d+/": ["12"]}, "errors": ["Invalid or unsafe pattern: /(a+)+/"]}
    assert report.describe(Config())["patterns"] == 25


def test_line_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("  mail a@b.co \n\n   \nplain\n")
    got = stream.mask_stream(files.read_lines(spark, str(tmp_path / "in")), Processor())
    assert sorted(r["message"] for r in got.collect()) == ["mail ***EMAIL***", "plain"]
    assert files.write_lines(got, str(tmp_path / "out"), F.col("message")) == 2
    assert files.write_lines(got, str(tmp_path / "out"), F.upper("message")) == 2
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["MAIL ***EMAIL***", "PLAIN"]
    with pytest.raises(StreamError):
        files.read_lines(spark, str(tmp_path / "none"))


def test_stream_runs_like_a_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / f"in/{k}.txt").write_text(f"mail u{k}@b.co\nplain {k}x\n")
    total, seen = stream.Statistics(), []
    df = files.stream_lines(spark, str(tmp_path / "in"), files_per_batch=1)
    q = stream.run_to(df, Processor(), lambda part, n: seen.extend(r["message"] for r in part.collect()), str(tmp_path / "cp"), total)
    q.awaitTermination(120)
    assert sorted(seen) == ["mail ***EMAIL***"] * 3 + ["plain 0x", "plain 1x", "plain 2x"]
    assert (total.processed, total.masked, total.errors) == (6, 3, 0)


def test_limit_stream_keeps_state(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", 1), ("a", 1), ("a", 1), ("b", 1)], [("a", 5), ("a", 12), ("a", 12), ("a", 12)]
    for part in rows:
        spark.createDataFrame(part, "key string, s long").coalesce(1).write.mode("append").parquet(src)
    df = spark.readStream.schema("key string, s long").option("maxFilesPerTrigger", 1).parquet(src)
    seen = []
    q = stream.limit_stream(df, RateLimiter(2, 10), "key", "s").writeStream.foreachBatch(lambda p, n: seen.extend(map(tuple, p.collect()))).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert sorted(seen) == [("a", 1, 3, 2), ("a", 5, 1, 0), ("a", 12, 3, 2), ("b", 1, 1, 1)] or sorted(seen) == sorted([("a", 1, 3, 2), ("a", 5, 1, 0), ("a", 12, 3, 2), ("b", 1, 1, 1)])
