from __future__ import annotations

import json

from storyloom import sql
from storyloom.sources import events as E
from storyloom.sources import html as H
from storyloom.sources.sampling import bounded_sample
from storyloom.sources.scratch import shared_folder, written
from storyloom.streaming import event_log as S

PAGE = """<style>.zq{display : none}</style><a href="/x">home</a><div class="Chapter-Content"><p>One <b>two</b></p><p class="zq">stolen</p>Three<br>four<script>var a="</p>";</script>
<a href="/chapter/2">Second</a><a href="/chapter/1">First</a><a href="/chapter/2">again</a><a href="/chapter/3">3 days ago</a></div><p>outside</p>"""


def test_pages(spark):
    text, links = H.parse_page(PAGE)
    assert text.startswith("One two Three\n\nfour") and "stolen" not in text and "var a" not in text and "outside" not in text
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id int, html string")
    got = sorted((r["number"], r["title"]) for r in H.chapter_links(df, "id", "html").collect())
    assert got == [(1, "First"), (2, "Second")]
    doc = {"type": "doc", "content": [{"type": "heading", "content": [{"type": "text", "text": "T"}]}, {"type": "paragraph", "content": [{"type": "text", "text": "a"}, {"type": "hardBreak"}, {"type": "text", "text": "b"}]}]}
    assert H.document_text(json.dumps(doc)) == "T\n\na\nb" and H.document_text("{") is None


def event(i, kind="done", ts="2024-01-01T00:00:00Z"):
    return json.dumps({"id": i, "ts": ts, "type": kind, "fiction_id": "f", "book": 1, "chapter": i % 2, "detail": {"a": i}})


def test_event_log(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join([event(1), "broken", event(2, "failed"), "{}"]))
    log = E.read_events(spark, str(folder))
    assert [(r["id"], r["severity"]) for r in log.orderBy("id").collect()] == [(1, "info"), (2, "info")]
    assert [r["id"] for r in E.events_since(log, 1).collect()] == [2] and E.events_since(log, 0, 5, "done").count() == 1
    new = spark.createDataFrame([("2024-01-02", "x"), ("2024-01-01", "y")], "ts string, type string")
    E.append_events(new, log, str(tmp_path / "out"))
    assert sorted((r["id"], r["type"]) for r in spark.read.json(str(tmp_path / "out")).collect()) == [(3, "y"), (4, "x")]


def test_streams_resume_where_they_stopped(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.jsonl").write_text(event(1) + "\n" + event(1))
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    run = lambda: S.run_available(S.unique_events(S.event_stream(spark, str(folder))), out, cp)
    run()
    (folder / "b.jsonl").write_text(event(2))
    run()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_counts_by_window(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(event(i, ts=f"2024-01-01T0{i}:00:00Z") for i in range(4)))
    q = S.counts_by_window(S.event_stream(spark, str(folder))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").count() == 4


def test_latest_by_key(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join([event(1), event(3, "failed"), event(2)]))
    q = S.latest_by_key(S.event_stream(spark, str(folder)), ["chapter"]).writeStream.format("memory").queryName("latest").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["chapter"], r["id"], r["type"]) for r in spark.table("latest").collect()) == [(0, 2, "done"), (1, 3, "failed")]


def test_scratch_and_samples(spark):
    df = spark.range(1000)
    t = written(df)
    assert t.count() == 1000 and shared_folder(spark) in t.inputFiles()[0]
    assert bounded_sample(df, "id", 5000).count() == 1000
    n = bounded_sample(df, "id", 100).count()
    assert 50 < n < 200 and n == bounded_sample(df.repartition(3), "id", 100).count()


def test_registered_functions(spark):
    sql.register(spark)
    assert spark.sql("select seq_ratio('ab', 'ab'), speak('£3k'), number_to_words(42)").first()[:] == (1.0, "three thousand pounds", "forty-two")
    assert [r["text"] for r in spark.sql("select * from chunk_text('One. Two.\n\nThree.', 'short')").collect()] == ["One. Two.", "Three."]
