import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duskveil.functions import sanitize, validate
from duskveil.functions.constants import mask
from duskveil.functions.errors import PatternError
from duskveil.functions.patterns import DEFAULTS, Pattern, apply_patterns, apply_text, compiled, guards, matched_labels

GOLDEN = [
    ("FI21 1234 5600 0007 85", "***IBAN***"), ("FI2112345600000785", "***IBAN***"), ("FI21 1234 5600 000 85A", None),
    ("+358 40 1234567", "***PHONE***"), ("123-45-6789", "***USSSN***"), ("123456789", None),
    ("1990-12-31", "***DOB***"), ("31/12/1990", "***DOB***"), ("1990/31/12", None),
    ("A123456", "***PASSPORT***"), ("A1234", None),
    ("4111 1111 1111 1111", "***CC***"), ("5500-0000-0000-0004", "***CC***"), ("340000000000009", "***CC***"), ("6011000000000004", "***CC***"), ("1234 5678 9012", None),
    ("Bearer eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9", "***TOKEN***"), ("bearer token", None),
    ("sk_test_4eC39HqLyjWDarj1", "***APIKEY***"), ("shortkey", None),
    ("00:1A:2B:3C:4D:5E", "***MAC***"), ("00-1A-2B-3C-4D-5E", "***MAC***"), ("001A2B3C4D5E", None),
    ("abcdefghijklmnopqrstuvwxyz", "***APIKEY***"), ("deployment finished successfully without any errors", None),
    ("ABC-1234", "***VEHICLE***"), ("AB", None), ("123-ABC", "***VEHICLE***"), ("AB123456C", "***UKNI***"), ("AB12345", None),
    ("123-456-789", "***CASIN***"), ("123456-12345678", "***UKBANK***"), ("12345-1234567", "***CABANK***"), ("123 45 6789", "***MEDICARE***"),
    ("2001:0db8:85a3:0000:0000:8a2e", "***IPv6***"), ("010190-123A", "***HETU***"), ("10.0.0.1", "***IPv4***"),
    ("mail bob@example.com now", "mail ***EMAIL*** now"), ("é123-45-6789", "é***USSSN***"), ("٣٣٣٣٣٣-123A", "***HETU***"), ("", None),
]


def texts(spark):
    return spark.createDataFrame([(k, t, t if w is None else w) for k, (t, w) in enumerate(GOLDEN)], "k long, text string, want string")


def test_golden(spark):
    from pyspark.sql import functions as F

    df = texts(spark).select("text", "want", apply_patterns(F.col("text"), compiled()).alias("a"), apply_patterns(F.col("text"), compiled(), guarded=False).alias("b"))
    for r in df.collect():
        assert r["a"] == r["b"] == r["want"], r
        assert apply_text(r["text"], compiled()) == r["want"], r


ALPHABET = "aAFI019 -+:@._\n/{}é٣sk_Bearer"


def test_java_and_python_agree(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [(t,) for t, _ in GOLDEN] + [("".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))),) for _ in range(800)]
    rows += [(" ".join(rng.choice(GOLDEN)[0] for _ in range(4)),) for _ in range(300)]
    df = spark.createDataFrame(rows, "text string").select("text", apply_patterns(F.col("text"), compiled()).alias("m"))
    for r in df.collect():
        assert r["m"] == apply_text(r["text"], compiled()), r["text"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=40))
def test_prefilter_misses_nothing(text):
    import re

    literals, regexes = guards(compiled())
    found = any(x in text for x in literals) or any(re.search(re.sub(r"\(\?d[a-z]*U?\)", "", x).replace("(?U:\\d)", "\\d"), text) for x in regexes)
    assert found or apply_text(text, compiled()) == text


def test_labels(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("bob@x.org from 10.0.0.1 and 10.0.0.2",)], "t string")
    assert df.select(matched_labels(F.col("t"), compiled())).first()[0] == ["***EMAIL***", "***IPv4***"]


def test_replacements_and_flags(spark):
    from pyspark.sql import functions as F

    cases = [(r"/(a)(b)/", r"\2$1${2}", "ab", "bab"), (r"#x/y#i", "$0!", "X/Y", "X/Y!"), (r"/a$/D", "z", "a\n", "a\n"), (r"/a$/", "z", "a\n", "z\n"), (r"{a+}", "\\\\", "aa", "\\\\\\\\"[:2]), (r"/^b/m", "z", "a\nb", "a\nz"), (r"/a.b/s", "z", "a\nb", "z")]
    for source, replacement, text, want in cases:
        p = Pattern(source, replacement)
        df = spark.createDataFrame([(text,)], "t string")
        assert p.text(text) == want, source
        assert df.select(p.column(F.col("t"))).first()[0] == want, source


@pytest.mark.parametrize("source", ["/(a+)+/", "/(a*)*/", "/(a|a)*/", "/(.*)+/", "/[a-z]**/", "/(a|ab|abc)*/", "/x", "ab", "/(/", "xax", "/(.*|.*)/", "/a/q"])
def test_rejected(spark, source):
    assert not validate.valid_pattern(source)


@pytest.mark.parametrize("source", ["/a/", "/\\d{3}-\\d{2}/", "#foo#i", "/^[a-z]+$/u", "~x~", *(p for p, _ in DEFAULTS[:2])])
def test_accepted(spark, source):
    assert validate.valid_pattern(source)


def test_checks():
    with pytest.raises(PatternError):
        validate.check_patterns({"/(a+)+/": "x"})
    for bad in (("nope", "x"), ("string", " ")):
        with pytest.raises(Exception):  # noqa: B017
            validate.check_type_masks(dict([bad]))
    for limit, window in ((0, 1), (10**6 + 1, 1), (1, 0), (1, 86_401)):
        with pytest.raises(Exception):  # noqa: B017
            validate.check_limiter(limit, window)
    for key in ("", "x" * 251, "a\x01"):
        with pytest.raises(Exception):  # noqa: B017
            validate.check_limiter_key(key)
    for depth in (0, 1001):
        with pytest.raises(Exception):  # noqa: B017
            validate.check_max_depth(depth)


def test_sanitizer(spark):
    from pyspark.sql import functions as F

    cases = [
        ("password=hunter2 ok", "password=*** ok"), ("mysql://u:p@db:3306 x", "mysql://***:***@***:*** x"),
        ("at /etc/app/secret/k.pem", "at /***/secret/***"), ("C:\\app\\config\\x.ini", "C:\\***\\config\\***"), ("ip 192.168.1.9", "ip ***.***.***"),
        ("super_secret_1", mask("SECRET")), ("x" * 500, "x" * 500), ("x" * 501, "x" * 500 + sanitize.SUFFIX),
    ]
    df = spark.createDataFrame(cases, "m string, want string")
    for r in df.select("m", "want", sanitize.sanitize_message(F.col("m")).alias("got")).collect():
        assert r["got"] == r["want"] == sanitize.sanitize_text(r["m"])
    bad = spark.createDataFrame([("token=abc, user:bob at /var/log/x",)], "m string").select(sanitize.sanitize_context_error(F.col("m"))).first()[0]
    assert bad == "token=[REDACTED], user=[REDACTED] at /[PATH_REDACTED]"
