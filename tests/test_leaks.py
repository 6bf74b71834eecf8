"""Contexts of every shape: nothing that is configured to be masked stays, and what can't be masked raises."""

import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from duskveil.functions import callbacks, jsonmask, serialized
from duskveil.functions.errors import ConfigurationError
from duskveil.functions.patterns import compiled
from duskveil.operators import rules, strategies
from duskveil.operators.config import Config, FieldMask
from duskveil.operators.processor import Processor

MAIL = "a@b.co"


def masked(spark, context, config, kind="string"):
    df = spark.createDataFrame([("m", json.dumps(context) if kind == "string" else context)], f"message string, context {kind}")
    return json.loads(Processor(config).mask(df).select(F.col("context") if kind == "string" else F.to_json("context")).first()[0])


def test_fields_of_json_text(spark):
    config = Config(
        fields={"user.ssn": FieldMask.remove(), "user.mail": FieldMask.processor_patterns(), "user.n": FieldMask.regex("/\\d/", "#"), "list.1.x": "X", "a.b": "dotted", "none.at.all": "Z", "t": FieldMask.processor_patterns()},
        callbacks={"user.name": callbacks.hashed("md5", 4), "user.code": callbacks.partial(1, 1), "list.0": callbacks.partial()},
        type_masks={"boolean": "false", "integer": "7"},
    )
    got = masked(spark, {"user": {"ssn": "hello", "mail": f"x {MAIL}", "n": 12, "name": "é", "code": "secret"}, "list": [{"x": 1}, {"x": 2, "y": MAIL}], "a.b": 1, "t": True, "on": True, "k": 3, "s": MAIL}, config)
    assert got == {"user": {"mail": "x ***EMAIL***", "n": "##", "name": hashlib.md5("é".encode()).hexdigest()[:4] + "...", "code": "s****t"}, "list": ["[OBJECT]", {"x": "X", "y": "***EMAIL***"}], "a.b": "dotted", "t": "1", "on": False, "k": 7, "s": "***EMAIL***"}
    assert masked(spark, {"s": MAIL, "x": MAIL}, Config(fields={"x": "X"}, type_masks={"string": "S"})) == {"s": "S", "x": "X"}
    with pytest.raises(ConfigurationError):
        masked(spark, {"x": 1}, Config(callbacks={"x": lambda c: c}))


def test_rules_on_json_text(spark):
    rows = [('{"u":{"a":1,"z":null,"t":"s","f":1.5,"b":true},"l":[{"k":2}],"d.e":1}',), ("no json",), (None,), ("[1]",)]
    df = spark.createDataFrame(rows, "context string")
    holds = lambda r: [x[0] for x in df.select(r(df.schema)).collect()]
    assert holds(rules.all_of([rules.has_field("u.a")])) == [True, False, False, False]
    for path in ("u.z", "l.0.k", "u"):
        assert holds(rules.all_of([rules.has_field(path)]))[0], path
    for path in ("u.y", "l.1", "u.a.b", "l.0.x"):
        assert not holds(rules.all_of([rules.has_field(path)]))[0], path
    for path, value, want in (("u.a", 1, True), ("u.a", "1", False), ("u.a", 1.0, False), ("u.f", 1.5, True), ("u.t", "s", True), ("u.b", True, True), ("u.b", False, False), ("u.z", None, True), ("u.y", None, True), ("u.a", None, False)):
        assert holds(rules.all_of([rules.field_equals(path, value)]))[0] is want, (path, value)


def test_paths_below_keys_and_places(spark):
    config = Config(fields={"m.k.s": "X", "m.gone": FieldMask.remove(), "l.0": FieldMask.remove(), "l.1": "L", "n.0.s": FieldMask.remove()})
    kind = "struct<m:map<string,struct<s:string,t:string>>,l:array<string>,n:array<struct<s:string,t:string>>>"
    got = masked(spark, ({"k": (MAIL, MAIL), "o": (MAIL, "t"), "gone": ("a", "b")}, ["a", "b", MAIL], [("s", MAIL), ("s", "t")]), config, kind)
    assert got["m"] == {"k": {"s": "X", "t": "***EMAIL***"}, "o": {"s": "***EMAIL***", "t": "t"}}
    assert got["l"] == ["L", "***EMAIL***"] and got["n"] == [{"t": "***EMAIL***"}, {"s": "s", "t": "t"}]


def test_strategies_below_lists_and_maps(spark):
    kind = "struct<tags:array<string>,m:map<string,string>,items:array<struct<mail:string,n:long>>>"
    df = spark.createDataFrame([("m", ([MAIL, "x"], {"mail": MAIL, "b": "b"}, [(MAIL, 1), ("z", 2)]))], f"message string, context {kind}")
    run = lambda *s: strategies.StrategyManager(list(s)).mask(df).select(F.to_json("context")).first()[0]
    regex = strategies.RegexStrategy(patterns={"/[a-z]@b.co/": "E"}, include=["tags.*", "items.*"])
    assert json.loads(run(regex)) == {"tags": ["E", "x"], "m": {"mail": MAIL, "b": "b"}, "items": [{"mail": "E", "n": 1}, {"mail": "z", "n": 2}]}
    path = strategies.FieldPathStrategy(fields={"*.mail": "P", "tags.1": "T", "items.1.n": "9"})
    assert json.loads(run(path)) == {"tags": [MAIL, "T"], "m": {"mail": "P", "b": "b"}, "items": [{"mail": "P", "n": 1}, {"mail": "P", "n": 9}]}
    with pytest.raises(ConfigurationError):
        run(strategies.FieldPathStrategy(fields={"m.ma*": "P"}))
    with pytest.raises(ConfigurationError):
        strategies.StrategyManager([path]).mask(df.withColumn("context", F.to_json("context")))


def plain_structures(text):
    """What ``structures`` gives, bracket by bracket."""
    out = {}
    for start, opened in enumerate(text):
        if opened not in "{[":
            continue
        depth, quoted, k = 0, False, start
        while k < len(text):
            ch = text[k]
            if quoted:
                k += ch == "\\"
                quoted = ch != '"' or text[k] != ch
            elif ch == '"':
                quoted = True
            elif ch in (opened, jsonmask.PAIRS[opened]):
                depth += 1 if ch == opened else -1
                if not depth:
                    out[start] = k + 1
                    break
            k += 1
    return out


def test_structures_are_found_in_one_pass():
    import random

    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice('{}[]"\\a') for _ in range(rng.randrange(24)))
        assert jsonmask.structures(text) == plain_structures(text), text
    masker, dump = jsonmask.ValueMasker(compiled({})), serialized.DumpMasker(lambda x: x)
    began = time.perf_counter()
    for text in ("{" * 300_000 + "}", '["' * 100_000, '{"\\"' * 80_000):
        assert masker.embedded(text)[:1000] == text[:1000] and dump.process(text)[:1000] == text[:1000]
    assert time.perf_counter() - began < 10  # the quadratic way takes hours


def test_brackets_in_strings_are_no_nesting():
    text = json.dumps({"a": "[" * 600, "n": 1})
    assert json.loads(jsonmask.ValueMasker([], {"integer": "#"}).context_json(text)) == {"a": "[" * 600, "n": "#"}


def test_settings_are_brought_within_bounds():
    from duskveil.operators.config import settings

    got = settings({"max_depth": "5000", "chunk_size": "abc", "max_pattern_length": 20, "audit_enabled": "On", "strict_regex_validation": "0", "audit_channel": "  "})
    assert got == {"max_depth": 1000, "chunk_size": 100, "garbage_collection_threshold": 10000, "max_pattern_length": 20, "max_field_path_length": 100, "audit_enabled": True, "allow_empty_patterns": False, "strict_regex_validation": False, "audit_channel": "gdpr-audit"}


def test_retries_and_previews(spark):
    from duskveil.operators.recovery import Retry

    def flaky(x):
        if x.startswith("bad"):
            raise ValueError(x)
        return x.upper()

    df = spark.createDataFrame([("good",), ("bad thing",), (None,)], "t string")
    how = callbacks.opaque(flaky, Retry(2, 1, 2))
    assert [tuple(r) for r in df.select(how(F.col("t")), how.failed(F.col("t"))).collect()] == [("GOOD", False), ("***STRING***", True), (None, False)]
    assert how.on_values("bad one, a longer one").startswith("***STRING***")
    row = spark.createDataFrame([("x" * 120, [1, 2])], "s string, a array<int>")
    got = row.select(*(strategies.value_preview(F.col(f.name), f.dataType) for f in row.schema.fields)).first()
    assert tuple(got) == ("x" * 100 + "...", "[1,2]")


def test_binary_messages_and_unknown_masks(spark):
    df = spark.createDataFrame([(bytearray(b"card 4111111111111111 raw=\xc3\x28 end"), ("x",))], "message binary, context struct<f:string>")
    out = Processor(Config(fields={"f": FieldMask("nonsense")})).mask(df).first()
    assert out["message"] == "card ***CC*** raw=\ufffd( end" and out["context"]["f"] == "nonsense"
    assert masked(spark, {"f": "x"}, Config(fields={"f": FieldMask("nonsense")})) == {"f": "nonsense"}
