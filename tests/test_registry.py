from pyspark.sql import functions as F

from quirework.functions import vectors as V
from quirework.operators import ingestion, registry as G, supersede as S
from quirework.sources import readers, schemas, sinks

AT = F.lit("2026-01-01 00:00:00")


def documents(spark, rows):
    """(id, year, scopes, status) rows as registry rows."""
    columns = [f.strip().split(" ", 1) for f in "document_id string|edition_year_be smallint|scopes array<string>|status string".split("|")]
    df = spark.createDataFrame(rows, ", ".join(" ".join(c) for c in columns))
    return df.withColumn("archived_at", F.lit(None).cast("timestamp"))


def settled(spark, rows, passed=()):
    docs = documents(spark, rows)
    chunks = docs.select("document_id", F.concat(F.lit("c-"), "document_id").alias("chunk_id"))
    newly = spark.createDataFrame([(p,) for p in passed], "document_id string")
    out, left = S.promote(docs, chunks, newly, AT)
    return {r["document_id"]: r["status"] for r in out.collect()}, {r["document_id"] for r in left.collect()}


F_, I_, H_ = "fungicide", "insecticide", "herbicide"


def test_full_cover_archives_and_partial_does_not(spark):
    status, left = settled(spark, [("old", 2565, [F_, I_], "active"), ("new", 2568, [F_, I_], "pending")], ["new"])
    assert status == {"old": "archived", "new": "active"} and left == {"new"}
    status, left = settled(spark, [("old", 2565, [F_, I_], "active"), ("new", 2568, [I_], "pending")], ["new"])
    assert status == {"old": "active", "new": "active"} and left == {"old", "new"}


def test_union_of_newer_documents_covers(spark):
    rows = [("old", 2565, [F_, I_, H_], "active"), ("a", 2566, [F_], "active"), ("b", 2567, [I_], "archived"), ("c", 2568, [H_], "pending")]
    assert settled(spark, rows, ["c"])[0]["old"] == "archived"
    assert settled(spark, rows)[0]["old"] == "active"  # a pending document covers nothing


def test_equal_years_do_not_supersede(spark):
    status, _ = settled(spark, [("a", 2568, [F_], "active"), ("b", 2568, [F_], "active")])
    assert set(status.values()) == {"active"}


def test_pending_documents_keep_no_chunks(spark):
    assert settled(spark, [("a", 2568, [F_], "pending")]) == ({"a": "pending"}, set())


def test_a_passed_archived_document_stays_archived(spark):
    assert settled(spark, [("a", 2568, [F_], "archived")], ["a"])[0] == {"a": "archived"}


def test_claims(spark):
    good = "uploads/" + "0123456789abcdef" * 2 + ".pdf"
    names = [good, good.replace("0", "1"), good.replace("1", "2"), "uploads/x.pdf", "x/" + good, good + "\n", good.upper()]
    listing = spark.createDataFrame([(good, 10), (good.replace("1", "2"), 100)], "object_name string, size bigint")
    rows = G.claim_objects(spark.createDataFrame([(n,) for n in names], "object_name string"), listing, 50).collect()
    reasons = {r["object_name"]: r["reason"] for r in rows}
    assert [reasons[n] for n in names] == [None, "missing", "too large"] + ["bad name"] * 4


def test_model_pin(spark):
    rows = [("active", "a"), ("active", None), ("archived", "b")]
    docs = spark.createDataFrame(rows, "status string, embedding_model string")
    assert [r[0] for r in G.models_off_pin(docs, "a").collect()] == [None]
    assert G.models_off_pin(docs.limit(0), "a").isEmpty()


def test_file_hashes_and_attack_reader(spark, tmp_path):
    import hashlib

    (tmp_path / "a.pdf").write_bytes(b"one")
    row = readers.read_file_hashes(spark, str(tmp_path), "*.pdf").first()
    assert row["file_hash"] == hashlib.sha256(b"one").hexdigest()
    (tmp_path / "attacks.json").write_text('{"id": "a1", "expect": "answer"}\n{"id": "a2", "expect": "refuse"}\n')
    rows = readers.read_attacks(spark, str(tmp_path / "attacks.json")).orderBy("id").collect()
    assert [r["answerable"] for r in rows] == [True, False]


def test_large_files_are_hashed_in_parts(spark, tmp_path):
    """a file was one value of one task, whatever its size."""
    import hashlib
    import random

    drawn = random.Random(5)
    contents = {
        "bytes.bin": drawn.randbytes(70_001),
        "line end.txt": b"\xef\xbb\xbf" + b"one\r\n\n" * 9_000,
        "mark.txt": b"\xef\xbb\xbf" + b"a line" * 5 + b"\n\xef\xbb\xbf" + drawn.randbytes(50_000) + b"x",
        "ends.bin": b"\n" * 33_000,
        "long.bin": b"\0" * 66_000 + b"\n" + b"\xff" * 40_000,
        "small.bin": b"one\n",
        "edge.bin": drawn.randbytes(16_384),
        "name.gz": drawn.randbytes(40_000),
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    split, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    kept = {key: spark.conf.get(key) for key in (split, cost)}
    try:
        spark.conf.set(split, 8_000)
        spark.conf.set(cost, 1)
        hashes = readers.read_file_hashes(spark, str(tmp_path), part_bytes=16_384)
        found = {r["path"].rpartition("/")[2].replace("%20", " "): (r["length"], r["file_hash"]) for r in hashes.collect()}
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert found == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items()}


def test_table_reader_pads_and_renders(spark, tmp_path):
    raw = spark.createDataFrame(
        [("d", 1, 1, None, 2, 2, [["a"], ["b", "c"]], None)], schemas.TABLES
    )
    raw.write.parquet(str(tmp_path / "t"))
    row = readers.read_tables(spark, str(tmp_path / "t")).first()
    assert row["cells"] == [["a", ""], ["b", "c"]] and row["markdown"] == "|a||\n|---|---|\n|b|c|"


def test_chunk_sink_replaces_only_its_documents(spark, tmp_path):
    path, kind = str(tmp_path / "chunks"), "document_id string, content string"

    def write(rows, replaced):
        ids = spark.createDataFrame([(d,) for d in replaced], "document_id string")
        sinks.write_chunks(spark.createDataFrame(rows, kind), ids, path)
        return {tuple(r) for r in sinks.read_chunks(spark, path, kind).collect()}

    first = {(d, d * 2) for d in "abcdefgh"}
    assert write(sorted(first), []) == first
    assert write([("b", "3")], ["b"]) == first - {("b", "bb")} | {("b", "3")}
    assert write([], "abcdefgh") == set()  # re-ingested documents without any chunk


def test_statistics_of_passed_documents_without_chunks(spark):
    kind = "document_id string, chunk_count bigint, embedding_model string"
    docs = spark.createDataFrame([("a", None, None), ("b", 7, "old"), ("c", None, None)], kind)
    passed = spark.createDataFrame([("a",), ("b",)], "document_id string")
    chunks = spark.createDataFrame([("b",), ("b",)], "document_id string")
    rows = G.chunk_statistics(docs, passed, chunks, "m").collect()
    assert sorted(map(tuple, rows)) == [("a", 0, "m"), ("b", 2, "m"), ("c", None, None)]


def test_any_scope_can_be_superseded(spark):
    status, _ = settled(spark, [("old", 2565, ["other"], "active"), ("new", 2568, ["other"], "active")])
    assert status == {"old": "archived", "new": "active"}


THAI = "ฝนตกหนักที่เชียงใหม่ พรุ่งนี้น่าจะหยุด"


def corpus(spark, *volumes):
    """(document_id, text, year, scopes, page_count) volumes as ingest inputs."""
    meta = spark.createDataFrame(
        [(d, d, d, y, s, f"hash-{d}", n) for d, _, y, s, n in volumes],
        "document_id string, source string, title_th string, edition_year_be smallint, scopes array<string>, file_hash string, page_count int",
    )
    pages = spark.createDataFrame(
        [(d, 1, 1, t) for d, t, *_ in volumes], schemas.PAGES
    )
    blocks = spark.createDataFrame(
        [(d, 0, 1, (0.0, 0.0, 9.0, 9.0), "\n".join(f"{t} line {i}" + "abcdefghij"[i] for i in range(9))) for d, t, *_ in volumes],
        schemas.BLOCKS,
    )
    tables = spark.createDataFrame([], schemas.TABLES)
    return meta, pages, blocks, tables


def run_ingest(spark, registry, chunks, *volumes):
    documents, chunks, qa = ingestion.ingest(
        *corpus(spark, *volumes), registry, chunks, V.hashing_embedder(8), 8, "m", AT
    )
    states = {r["document_id"]: (r["status"], r["chunk_count"]) for r in documents.collect()}
    held = {r["document_id"] for r in chunks.collect()}
    return documents, chunks, states, held


def test_ingest_lifecycle(spark):
    registry = spark.createDataFrame([], schemas.DOCUMENTS)
    chunks = spark.createDataFrame([], schemas.CHUNKS).select(
        "chunk_id", "document_id", "page_number", "kind_rank", "position", "part", "section", "kind", "content",
        "content_sha256", "tokens", "embedding",
    )
    good, broken = ("a", THAI, 2565, [F_], 1), ("b", "no thai here", 2566, [I_], 1)
    registry, chunks, states, held = run_ingest(spark, registry, chunks, good, broken)
    assert states == {"a": ("active", 1), "b": ("pending", None)} and held == {"a"}
    assert S.check_corpus(registry, chunks, 8).isEmpty()

    # a code without a repair in a block fails the document as one on a page would
    meta, pages, blocks, tables = corpus(spark, ("d", THAI, 2567, [F_], 1))
    blocks = blocks.withColumn("text", F.concat("text", F.lit("\uf707")))
    coded, none, qa = ingestion.ingest(meta, pages, blocks, tables, registry, chunks, V.hashing_embedder(8), 8, "m", AT)
    assert coded.filter("document_id = 'd'").first()["status"] == "pending" and none.filter("document_id = 'd'").isEmpty()
    failed = qa.filter("document_id = 'd' AND NOT passed").collect()
    assert [(r["check"], r["measured"]) for r in failed] == [("unmapped_pua_codepoints", '["U+F707"]')]

    # a pending hash comes back under another id and keeps the stored one
    meta, *rest = corpus(spark, ("x", "still none", 2566, [I_], 1))
    meta = meta.withColumn("file_hash", F.lit("hash-b"))
    again_pending, _, _ = ingestion.ingest(meta, *rest, registry, chunks, V.hashing_embedder(8), 8, "m", AT)
    assert {r["document_id"] for r in again_pending.collect()} == {"a", "b"}

    fixed, again, newer = ("b", THAI, 2566, [I_], 1), ("a", "changed", 2565, [F_], 1), ("c", THAI, 2568, [F_], 1)
    registry, chunks, states, held = run_ingest(spark, registry, chunks, fixed, again, newer)
    assert states == {"a": ("archived", 1), "b": ("active", 1), "c": ("active", 1)} and held == {"b", "c"}
    assert registry.filter("document_id = 'a'").first()["qa"]["no_thai_consonants"]["passed"]
