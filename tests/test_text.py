import __spark_entry__ as entry
import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text

REDACTIONS = [
    ("Authorization: Bearer abc.def", "Authorization=[REDACTED]"), ("x-api-key: zzz", "x-api-key=[REDACTED]"),
    ("proxy-authorization: Basic xyz", "proxy-authorization=[REDACTED] xyz"), ("cookie: a=b; c=d", "cookie: [REDACTED]"), ("set-cookie: s=1", "set-cookie: [REDACTED]"),
    ("use Bearer abc123 now", "use Bearer [REDACTED] now"), ("my sk-abcdefgh", "my [REDACTED_API_KEY]"), ('api_key = "k1"', "api_key=[REDACTED]"),
    ('{"password":"p"}', '{"password":"[REDACTED]"}'), ("\"secret\" : 'q'", '"secret" : "[REDACTED]"'), ("credential=abc, next", "credential=[REDACTED], next"),
    ("OPENAI_API_KEY=sk-abcdefgh1", "OPENAI_API_KEY=[REDACTED]"), ('token = "abc"', 'token = "abc"'), ("ésecret=abc", "ésecret=[REDACTED]"), (None, None), ("", ""),
]


def one(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_redaction_and_idempotence(spark):
    raw, want = zip(*REDACTIONS, strict=True)
    got = one(spark, raw, text.redact)
    assert tuple(got) == want and one(spark, got, text.redact) == got


def test_own_patterns_come_first_and_broken_ones_are_skipped(spark):
    assert one(spark, ['token = "ab12"'], lambda c: text.redact(c, ["([", r'token\s*=\s*"[0-9a-f]+"'])) == ["[REDACTED]"]
    assert one(spark, ["a", "my sk-abcdefgh", None], text.credential_like) == [False, True, None]


def test_tokens(spark):
    assert one(spark, ["", "abcd", "abcde", "a😀b", "😀😀😀", None], text.token_estimate) == [0, 1, 2, 1, 2, 0]


def test_display_hash(spark):
    assert one(spark, ["abcd", "é", "a😀b", ""], text.display_hash) == ["2d9442", "e9", "372b75e", "0"]


@pytest.mark.parametrize("most,want", [(0, ""), (1, "…"), (4, "abc…"), (6, "abcdef"), (9, "abcdef")])
def test_truncation(spark, most, want):
    assert one(spark, ["abcdef"], lambda c: text.truncate(c, most)) == [want]


@pytest.mark.parametrize("most,want", [(1, "…"), (2, "…"), (3, "😀…"), (4, "😀…"), (5, "😀😀…"), (6, "😀😀😀"), (9, "😀😀😀")])
def test_truncation_counts_utf16_units(spark, most, want):
    got = one(spark, ["😀😀😀"], lambda c: text.truncate(c, most))
    assert got == [want] and len(got[0].encode("utf-16-le")) // 2 <= most


def test_truncation_of_long_astral_texts(spark):
    got = one(spark, ["😀" * 300, "a" + "😀" * 300, "é" * 300, "a" * 240], lambda c: text.redact_and_truncate(c, 240))
    assert [len(t.encode("utf-16-le")) // 2 for t in got] == [239, 240, 240, 240]


def test_html(spark):
    assert one(spark, ["<a href=\"x\">'&"], text.html_escape) == ["&lt;a href=&quot;x&quot;&gt;&#39;&amp;"]


def test_every_document_is_redacted(spark, tmp_path):
    rows = [(1, 'Token = "ab12"'), (2, "password=p"), (3, 'token="0f" Bearer x'), (4, "plain"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.redacted for r in entry.queries()["redact_custom"](spark, str(tmp_path)).collect()}
    assert got == {1: "[REDACTED]", 2: "password=[REDACTED]", 3: "[REDACTED] Bearer [REDACTED]", 4: "plain", 5: None}
    duck = duckdb.sql(entry.oracle_sql()["redact_custom"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'"))
    assert dict(duck.fetchall()) == got
