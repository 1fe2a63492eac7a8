import pytest
from pyspark.sql import functions as F

from quarry.functions import completions, lexicon, requests
from quarry.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [("高血压", "高 血 高血 压 血压"), ("CHF-2 用药 x_y", "chf-2 用 药 用药 x_y"), ("Été naïve", "t na ve"), ("a高b血 压", "a 高 b 血 压"), ("  ", ""), (None, ""), ("K9", "9")],
)
def test_tokens(spark, text, tokens):
    assert one(spark, T.tokenize(F.lit(text).cast("string"))) == tokens.split()


def test_collapse_and_visible(spark):
    assert one(spark, T.collapse_space(F.lit("　 a \t b\n"))) == "a b"
    assert one(spark, T.visible_chars(F.lit("a b　\x07c"))) == 3
    assert one(spark, T.visible_chars(F.lit(None).cast("string"))) == 0


def test_clean_text(spark):
    text = "\r\n  Title  here \r\n\r\n\r\n\r\n12\nPage 3 of 9\nrepeat ME\nbody\n"
    assert one(spark, T.clean_text(F.lit(text), F.array(F.lit("repeat me")))) == "Title here\n\nbody"
    assert one(spark, T.clean_text(F.lit(None).cast("string"))) is None


def test_content_guard(spark):
    long = "患者" + "x" * 30
    assert one(spark, T.looks_like_content(F.lit(long)))
    assert not one(spark, T.looks_like_content(F.lit("患者")))


def test_preview(spark):
    assert one(spark, T.preview(F.lit("x" * 301))) == "x" * 300 + "…"
    assert one(spark, T.preview(F.lit("x" * 300))) == "x" * 300


@pytest.mark.parametrize(
    ("text", "expanded"),
    [("心衰怎么治", "心衰怎么治 心力衰竭 慢性心衰 CHF"), ("高血压急症", "高血压急症 高血压危象 高血压危症 高血压病 原发性高血压"), ("hello", "hello")],
)
def test_expansion(spark, text, expanded):
    assert one(spark, lexicon.expand_query(F.lit(text))) == expanded


def test_tags_are_capped(spark):
    assert len(one(spark, lexicon.tag(F.lit(" ".join(lexicon.CANONICAL))))) == 16


def test_message_content(spark):
    none = F.lit(None).cast("array<string>")
    assert one(spark, requests.message_content(F.lit('a "b"\n'), none)) == '"a \\"b\\"\\n"'
    with_image = one(spark, requests.message_content(F.lit("t"), F.array(F.lit("http://x"), F.lit(" "))))
    assert with_image == '[{"type":"text","text":"t"},{"type":"image_url","image_url":{"url":"http://x"}}]'
    assert one(spark, requests.message_content(F.lit(" "), F.array(F.lit("http://x")))).startswith('[{"type":"image_url"')


def test_upstream_error(spark):
    assert one(spark, requests.upstream_error(F.lit(429), F.lit("x"))).startswith("429")
    assert one(spark, requests.upstream_error(F.lit(500), F.lit("y" * 300))) == "500: " + "y" * 240


def test_nested_content(spark):
    payload = '{"choices":[{"delta":{"content":[{"text":"a"},"b",{"content":"c"},5]}}]}'
    assert one(spark, completions.content_text(F.lit(payload))) == "abc"
    assert one(spark, completions.content_text(F.lit("[1]"))) == ""


def test_deeply_nested_content(spark):
    for depth in (3, 5, 40):
        inner = '"x"'
        for _ in range(depth):
            inner = f'[{{"text":{inner},"content":"y"}}]'
        assert one(spark, completions.content_text(F.lit(f'{{"content":{inner}}}'))) == "x" + "y" * depth
