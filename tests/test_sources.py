"""Corpora, chunks, logs and streams."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from sievework.sources import archives, binding, corpus, logs
from sievework.streaming import jobs

ROW = "path string, version int, ts timestamp, content binary, tombstone boolean, archive string"


def table(spark, rows):
    return spark.createDataFrame([(p, v, None, c, t, a) for p, v, c, t, a in rows], ROW)


def test_directory_scan(spark, tmp_path):
    for name in ("a.txt", "sub/b.md", ".hidden", ".git/x", "_drafts/c.md", "sub/.d"):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True, parents=True)
        f.write_text(name)
    got = corpus.scan_directory(spark, str(tmp_path))
    assert sorted(r["path"] for r in got.collect()) == ["a.txt", "sub/b.md"]
    assert [bytes(r["content"]) for r in corpus.scan_directory(spark, f"file://{tmp_path}", "sub/").collect()] == [b"sub/b.md"]
    for bad in ("../x", "/x", "a//b", "", "a\\b"):
        with pytest.raises(ValueError):
            corpus.checked_path(bad)
    assert corpus.checked_path("a/b") == "a/b"
    assert corpus.migrate(spark, str(tmp_path), str(tmp_path / "out.parquet")) == 2


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a1.zip", "w") as z:
        z.writestr("1/doc.md", "one")
        z.writestr("2/doc.md", "two")
        z.writestr("1/old.md", "x")
        z.writestr("2/old.md.tombstone", "")
        z.writestr("meta.json", "{}")
    df = corpus.scan_archives(spark, str(tmp_path))
    assert df.count() == 4
    live = corpus.current(df).collect()
    assert [(r["path"], r["version"], bytes(r["content"])) for r in live] == [("doc.md", 2, b"two")]


def test_versions(spark):
    df = table(spark, [("a", 1, b"x", False, "z1"), ("a", 2, b"y", False, "z2"), ("b", 1, b"x", False, "z1"), ("b", 2, None, True, "z2"), ("c", 1, b"q", False, "z1")])
    assert sorted((r["path"], r["version"]) for r in corpus.current(df).collect()) == [("a", 2), ("c", 1)]
    assert bytes(corpus.version_of(df, "a", 1).first()["content"]) == b"x"
    assert [r["version"] for r in corpus.history(df, "b").collect()] == [1, 2]
    assert corpus.exists(df, "a") and not corpus.exists(df, "b")
    new = spark.createDataFrame([("a", None, b"n"), ("d", None, b"m")], "path string, ts timestamp, content binary")
    assert sorted((r["path"], r["version"]) for r in corpus.appended(df, new).collect()) == [("a", 3), ("d", 1)]
    assert [(r["path"], r["version"], r["tombstone"]) for r in corpus.deleted(df, ["a", "b"], "2024-01-01").collect()] == [("a", 3, True)]
    assert sorted((r["path"], r["version"]) for r in corpus.compacted(df).collect()) == [("a", 2), ("c", 1)]
    assert sorted((r["path"], r["version"]) for r in corpus.compacted(df, "TOMBSTONES_ONLY").collect()) == [("a", 1), ("a", 2), ("c", 1)]
    assert corpus.compacted(df, closed=F.col("archive") == "z1").count() == 5
    diff = corpus.changes(df.where("version = 1"), corpus.current(df))
    assert {r["path"]: r["change"] for r in diff.collect()} == {"a": "MODIFIED", "b": "DELETED"}
    missing, orphans = corpus.reconcile(df.where("path <> 'c'"), corpus.current(df))
    assert [r["path"] for r in missing.collect()] == ["c"] and [r["path"] for r in orphans.collect()] == ["b"]


def test_integrity(spark):
    df = table(spark, [("a", 1, b"x", False, "z1"), ("b", 1, b"y", False, "z2")])
    facts = corpus.archive_facts(df)
    manifest = corpus.recovered_manifest(facts)
    assert corpus.integrity(manifest, facts, full=True).count() == 0
    assert corpus.status(corpus.integrity(manifest, facts)).first()["status"] == "HEALTHY"
    broken = table(spark, [("a", 1, b"other", False, "z1"), ("c", 1, b"y", False, "z3")])
    found = {r["archive"]: r["problem"] for r in corpus.integrity(manifest, corpus.archive_facts(broken), full=True).collect()}
    assert found == {"z1": "HASH_MISMATCH", "z2": "ARCHIVE_MISSING", "z3": "ARCHIVE_ORPHANED"}
    assert corpus.status(corpus.integrity(manifest, corpus.archive_facts(broken))).first()["status"] == "CORRUPT"
    chain = {r["archive"]: r for r in corpus.retire(manifest, "z1", "z9").collect()}
    assert chain["z1"]["status"] == "RETIRED" and chain["z2"]["predecessor"] == "z9"


def test_text(spark):
    html = "<html><script>x<1</script><p>a &amp; b</p><!-- c --><style>p{}</style>\n<b>d</b></html>"
    assert spark.range(1).select(corpus.plain_text(F.lit(html)).alias("t")).first()["t"] == "a & b d"
    assert corpus.split_text("") == [] and corpus.split_text("  ") == [] and corpus.split_text("abc") == ["abc"]
    text = "\n\n".join(f"Paragraph {i}. " + "word " * 40 for i in range(20))
    parts = corpus.split_text(text, 500, 100)
    assert all(len(p) <= 500 for p in parts) and all(f"Paragraph {i}." in " ".join(parts) for i in range(20))
    assert [len(p) for p in corpus.split_text("x" * 2500, 1000, 0)] == [1000, 1000, 500]
    df = spark.createDataFrame([(1, "ab" * 900), (2, ""), (3, None)], "id int, text string")
    assert corpus.chunks(df, size=1000, overlap=0).count() == 2
    fixed = corpus.fixed_chunks(df.where("id < 3")).collect()
    assert [(r["id"], r["chunk_index"], len(r["content"])) for r in fixed] == [(1, 0, 1000), (1, 1, 1000)]
    stored = spark.createDataFrame([("a", 1), ("b", 1)], "source_document_id string, v int")
    new = spark.createDataFrame([("a", 2), ("a", 3)], "source_document_id string, v int")
    assert sorted((r[0], r[1]) for r in corpus.upserted(stored, new).collect()) == [("a", 2), ("a", 3), ("b", 1)]
    assert corpus.without_documents(stored, ["a"]).count() == 1
    vectors = spark.createDataFrame([([1.0, 2.0],)], "e array<double>")
    assert corpus.check_collection(vectors, "e", 2).count() == 1
    with pytest.raises(Exception, match="dimensions"):
        corpus.check_collection(vectors, "e", 3).collect()


def test_logs(spark):
    rows = spark.createDataFrame([("r", "q", "c", 5, None, [("d", 0.5), ("d", 0.7)])], "retrieval_id string, query_text string, corpus string, max_results int, ts timestamp, documents array<struct<doc:string,score:double>>")
    records, found = logs.log_rows(rows)
    assert records.count() == 1 and [tuple(r) for r in found.collect()] == [("r", "d", 0.7)]


def test_ingest_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("hello " * 300)
    run = lambda: jobs.ingest_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), size=1000, overlap=0).awaitTermination(60)
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    (tmp_path / "in/b.txt").write_text("more")
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    diff, now = jobs.ingest_changes(spark, str(tmp_path / "in"), None)
    assert {r["change"] for r in diff.collect()} == {"ADDED"} and now.count() == 2


def test_outcome_stream(spark, tmp_path):
    schema = "case_id string, observed_at timestamp, seq long, rate double"
    source = str(tmp_path / "events")
    batches = [[("c", "2024-01-02", 1, 0.0), ("d", "2024-01-01", 1, 1.0)], [("c", "2024-01-01", 2, 0.0), ("c", "2024-01-03", 3, 0.5)]]
    out = {}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for batch in batches:
        df = spark.createDataFrame(batch, "case_id string, observed_at string, seq long, rate double")
        df.withColumn("observed_at", F.col("observed_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        rows = jobs.outcome_confidence(spark.readStream.schema(schema).parquet(source))
        query = rows.writeStream.outputMode("update").foreachBatch(lambda b, _: out.update({r["case_id"]: (r["confidence"], r["applied"]) for r in b.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(90)
    assert out["c"] == (pytest.approx(0.8 * 0.8 + 0.2 * 0.5), 2) and out["d"] == (pytest.approx(1.0), 1)


def test_quarantine_stream(spark, tmp_path):
    spark.createDataFrame([(1,), (None,)], "v int").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("v int").parquet(str(tmp_path / "in"))
    jobs.append_valid(rows, F.col("v") > 0, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 1 and spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_binding(spark, tmp_path):
    from sievework.sources.binding import Binding, Ingestion, Storage

    (tmp_path / "a.md").write_text("text " * 10)
    b = Binding("t", "c", str(tmp_path))
    assert b.chunks(spark).select("tenant_id", "source_document_id", "chunk_index").collect() == [("t", "a.md", 0)]
    assert Binding("t", "c", str(tmp_path), mode=Ingestion.NONE).chunks(spark, manual=True) is None
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("1/doc.md", "one")
    assert [r["path"] for r in Binding("t", "c", str(tmp_path), Storage.ZIP).documents(spark).collect()] == ["doc.md"]


def entries(spark):
    rows = [(f"d/{i}.txt", 1, f"text {i} ".encode() * 200, False) for i in range(40)] + [("d/3.txt", 2, b"new", False), ("d/4.txt", 2, None, True)]
    return spark.createDataFrame([(p, v, None, c, t, None) for p, v, c, t in rows], ROW).repartition(2)


def test_archives_roll_over_and_hold_their_record(spark, tmp_path):
    root = f"file://{tmp_path}/zips"
    facts = archives.write_archives(entries(spark), root, most=600)
    assert facts.count() > 2
    back = corpus.scan_archives(spark, root)
    want = {(r["path"], r["version"], bytes(r["content"]) if r["content"] is not None else None, r["tombstone"]) for r in entries(spark).collect()}
    assert {(r["path"], r["version"], bytes(r["content"]) if r["content"] is not None else None, r["tombstone"]) for r in back.collect()} == want
    seen = corpus.archive_facts(back)
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, facts.collect()))
    manifest, meta = corpus.recovered_manifest(facts), archives.records(spark, root)
    assert corpus.integrity(manifest, seen, True, meta).count() == 0
    names = sorted(r["archive"] for r in facts.collect())
    with zipfile.ZipFile(f"{tmp_path}/zips/{names[1]}", "a") as z:
        z.writestr("9/late.txt", "x")  # an entry that neither the manifest nor the record knows
    with zipfile.ZipFile(f"{tmp_path}/zips/plain.zip", "w") as z:
        z.writestr("1/a.txt", "x")
    (tmp_path / "zips" / "broken.zip").write_bytes(b"no archive")
    good = corpus.scan_archives(spark, root, "[cp]*.zip")
    problems = corpus.integrity(manifest, corpus.archive_facts(good), True, archives.records(spark, root))
    assert {(r["archive"], r["problem"]) for r in problems.collect()} == {(names[1], "ENTRY_COUNT_MISMATCH"), ("plain.zip", "ARCHIVE_ORPHANED"), ("broken.zip", "ARCHIVE_UNREADABLE")}
    assert corpus.status(problems).first()["status"] == "CORRUPT"
    listed = manifest.unionByName(corpus.archive_facts(good).where("archive = 'plain.zip'").selectExpr("archive", "99 sequence", "'CLOSED' status", "cast(null as string) predecessor", "entries", "hash", "cast(null as string) replaced_by"))
    assert [tuple(r) for r in corpus.integrity(listed, corpus.archive_facts(good), False, archives.records(spark, root)).where("archive = 'plain.zip'").collect()] == [("plain.zip", "RECORD_MISSING", "WARNING")]
    assert [r["problem"] for r in corpus.integrity(None, seen).collect()] == ["MANIFEST_MISSING"]


def test_equal_entries_do_not_cancel(spark):
    one, two = (corpus.archive_facts(table(spark, [("a", 1, b"x", False, "z")] * n)).first()["hash"] for n in (1, 3))
    assert one != two and one != corpus.archive_facts(table(spark, [("b", 1, b"x", False, "z")])).first()["hash"]


def test_chain(spark):
    facts = spark.createDataFrame([("a", 3, "1"), ("b", 2, "2"), ("c", 5, "3")], archives.FACTS)
    chain = corpus.opened(corpus.recovered_manifest(facts.where("archive < 'c'")), "c")
    assert [(r["archive"], r["sequence"], r["status"], r["predecessor"]) for r in chain.orderBy("sequence").collect()] == [("a", 0, "CLOSED", None), ("b", 1, "CLOSED", "a"), ("c", 2, "ACTIVE", "b")]
    with pytest.raises(Exception, match="active"):
        corpus.opened(chain, "d").collect()
    last = corpus.closed(chain, facts).where("archive = 'c'").first()
    assert (last["status"], last["entries"], last["hash"]) == ("CLOSED", 5, "3")


def test_ingest_applies_deletions_and_moves_its_cursor_on_success_only(spark, tmp_path):
    root, state = tmp_path / "docs", f"file://{tmp_path}/state"
    root.mkdir()
    for name in ("a", "b", "c"):
        (root / f"{name}.txt").write_text(f"text of {name}")
    held = lambda: {r["source_document_id"]: r["content"] for r in jobs.ingested(spark, state).collect()}
    assert jobs.ingest_once(spark, str(root), state) == {"ADDED": 3, "MODIFIED": 0, "DELETED": 0}
    (root / "b.txt").unlink()
    (root / "c.txt").write_text("other text of c")
    os.utime(root / "c.txt", (2_000_000_000, 2_000_000_000))
    (root / "d.txt").write_text("text of d")

    def refuse(_):
        raise RuntimeError("not now")

    with pytest.raises(RuntimeError, match="not now"):
        jobs.ingest_once(spark, str(root), state, fail=refuse)
    assert jobs.last_run(spark, state) == 1 and held() == {"a.txt": "text of a", "b.txt": "text of b", "c.txt": "text of c"}
    assert jobs.ingest_once(spark, str(root), state) == {"ADDED": 1, "MODIFIED": 1, "DELETED": 1}
    assert held() == {"a.txt": "text of a", "c.txt": "other text of c", "d.txt": "text of d"}
    assert jobs.ingest_once(spark, str(root), state) == {"ADDED": 0, "MODIFIED": 0, "DELETED": 0}


def test_debounced(spark):
    rows = [("a", "CREATED", "2024-01-01 00:00:00"), ("a", "MODIFIED", "2024-01-01 00:00:01"), ("a", "DELETED", "2024-01-01 00:00:09"), (".git/x", "MODIFIED", "2024-01-01 00:00:00"), ("s/.t/x", "MODIFIED", "2024-01-01 00:00:00"), (None, "OVERFLOW", "2024-01-01 00:00:03")]
    df = spark.createDataFrame(rows, "path string, change string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((str(r["path"]), r["change"], r["ts"].second) for r in jobs.debounced(df).collect())
    assert got == [("None", "OVERFLOW", 3), ("a", "DELETED", 9), ("a", "MODIFIED", 1)]


def test_parsed(spark):
    df = spark.createDataFrame([("---\ntitle: 'own'\nlang: en\n---\nbody", {"title": "given"}), ("plain", None)], "content string, meta map<string,string>")
    got = corpus.parsed(df, kind="text", metadata="meta").collect()
    assert [(r["text"], r["metadata"]) for r in got] == [("body", {"title": "given", "lang": "en"}), ("plain", {})]
    assert {r["k"] for r in corpus.documents_of(spark.createDataFrame([("a",), ("a",), ("b",)], "k string"), "k").collect()} == {"a", "b"}


def test_tracker_failures_stay_apart(spark):
    seen = []

    def bad(_):
        raise RuntimeError("tracker")

    df = spark.range(3)
    assert logs.tracked(df, bad, seen.append).count() == 3 and str(seen[0]) == "tracker"


def test_bindings_write_through(spark, tmp_path):
    root, zips = f"file://{tmp_path}/flat", f"file://{tmp_path}/zips"
    (tmp_path / "flat").mkdir()
    both = binding.Binding("t", "c", root, binding.Storage.COMPOSITE, archives=zips)
    rows = table(spark, [("a/b.txt", 1, b"one", False, None), ("c.txt", 1, b"two", False, None)])
    assert both.append(rows, "first").agg(F.sum("entries")).first()[0] == 2
    assert sorted((r["path"], bytes(r["content"])) for r in corpus.scan_directory(spark, root).collect()) == [("a/b.txt", b"one"), ("c.txt", b"two")]
    both.append(table(spark, [("c.txt", 2, None, True, None), ("a/b.txt", 2, b"new", False, None)]), "second")
    assert [(r["path"], bytes(r["content"])) for r in both.documents(spark).collect()] == [("a/b.txt", b"new")]
    assert [(r["path"], bytes(r["content"])) for r in corpus.scan_directory(spark, root).collect()] == [("a/b.txt", b"new")]
    with pytest.raises(Exception, match="not a corpus path"):
        archives.write_files(table(spark, [("../x", 1, b"", False, None)]), root)


def test_one_file_and_compacted_archives(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one")
    got = corpus.read_file(spark, f"file://{tmp_path}", "d/a.txt").first()
    assert (got["path"], bytes(got["content"])) == ("d/a.txt", b"one")
    with pytest.raises(ValueError):
        corpus.read_file(spark, str(tmp_path), "../a.txt")
    old, new = f"file://{tmp_path}/old", f"file://{tmp_path}/new"
    names = sorted(r["archive"] for r in archives.write_archives(entries(spark).coalesce(1), old, most=2000).collect())
    for mode, closed, kept in (("FULL", None, 39), ("TOMBSTONES_ONLY", None, 40), ("FULL", names[:1], None)):
        facts = archives.compact(spark, old, f"{new}-{mode}-{closed is None}", mode, closed)
        back = corpus.scan_archives(spark, f"{new}-{mode}-{closed is None}")
        assert back.where("tombstone").isEmpty() and back.count() == facts.agg(F.sum("entries")).first()[0]
        assert back.count() == (kept or corpus.current(corpus.scan_archives(spark, old).where(F.col("archive") == names[0])).count())
