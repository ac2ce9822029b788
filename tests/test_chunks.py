import hashlib

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from quirework.operators import chunks as C, layout as L, pages as P, tables as B
from quirework.plans import layout_plans
from quirework.sources.schemas import BBOX

X = F.col("x")


def test_cells_to_markdown(evaluate):
    cases = [
        [["a", "", "b"], ["c", "", "d"]],
        [["a", "", "b"], ["c", "note", "d"]],
        [["a", "b"], ["", ""], ["c", "d"]],
        [["Phakopsora\npachyrhizi", "x"]],
        [["a|b", "c"]],
        [["", ""], ["", ""]],
        [["a"], ["b", "c"]],
        [],
    ]
    assert evaluate(B.cells_to_markdown(X), cases, "array<array<string>>") == [
        "|a|b|\n|---|---|\n|c|d|",
        "|a||b|\n|---|---|---|\n|c|note|d|",
        "|a|b|\n|---|---|\n|c|d|",
        "|Phakopsora pachyrhizi|x|\n|---|---|",
        "|a\\|b|c|\n|---|---|",
        "",
        "|a||\n|---|---|\n|b|c|",
        "",
    ]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(2, 40), max_size=4), st.integers(90, 300), st.lists(st.integers(2, 40), max_size=4))
def test_a_row_above_the_limit_is_a_part_of_its_own(evaluate, before, wide, after):
    row = lambda w: "|" + "z" * w + "|"
    table = "\n".join(["|name|", "|---|", *map(row, [*before, wide, *after])])
    (parts,) = evaluate(B.split_table(X, 80), [table])
    alone = f"|name|\n|---|\n{row(wide)}"
    assert parts.count(alone) == 1 and [r for p in parts for r in p.split("\n")[2:]] == table.split("\n")[2:]


def test_small_and_empty_tables(evaluate):
    assert evaluate(B.split_table(X, 100), ["|h|\n|---|\n|a|", ""]) == [["|h|\n|---|\n|a|"], []]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(1, 60), max_size=25), min_size=1, max_size=8))
def test_split_tables_keep_every_row_and_pack_tightly(evaluate, widths):
    tables = ["\n".join(["|head|", "|---|", *("|" + "r" * w + "|" for w in ws)]) for ws in widths]
    limit = 80
    for table, parts in zip(tables, evaluate(B.split_table(X, limit), tables)):
        rows = [r for part in parts for r in part.split("\n")[2:]]
        assert rows == table.split("\n")[2:] if len(table) > limit else parts == [table]
        assert all(p.startswith("|head|\n|---|") for p in parts)
        assert all(len(p) <= limit or len(p.split("\n")) == 3 for p in parts)
        for before, after in zip(parts, parts[1:]):
            assert len(before) + 1 + len(after.split("\n")[2]) > limit


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(20, 60), st.integers(0, 15))
def test_prose_chunks_hold_the_contract(text, size, overlap):
    chunks = C.split_text(text, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    at = 0
    for chunk in chunks:
        found = text.find(chunk, max(0, at - overlap - size))
        assert found >= 0
        at = found + len(chunk)
    assert "".join(text.split()) == "" or set("".join(text.split())) == set("".join("".join(chunks).split()))


def test_prose_boundaries():
    assert C.split_text("aaaa\n\nbbbb", 6, 0) == ["aaaa", "bbbb"]
    assert C.split_text("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]
    assert C.split_text("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert C.split_text("  ", 10, 0) == []


def test_short_and_long_prose_agree_with_the_helper(evaluate):
    texts = ["short", "", "x" * 99, "word " * 60, "para\n\n" * 40]
    assert evaluate(C.split_prose(X, 100, 10), texts) == [C.split_text(t, 100, 10) for t in texts]


def blocks_of(spark, rows):
    return spark.createDataFrame(
        [("d", i, page, (0.0, float(y0), 500.0, float(y1)), text) for i, (page, y0, y1, text) in enumerate(rows)],
        f"document_id string, ordinal int, page_number int, bbox {BBOX}, text string",
    )


def tables_of(spark, rows):
    return spark.createDataFrame(
        [("d", i, page, (0.0, float(y0), 500.0, float(y0) + 100), md) for i, (page, y0, md) in enumerate(rows)],
        f"document_id string, ordinal int, page_number int, bbox {BBOX}, markdown string",
    )


def plain_section(blocks, page, top):
    """The nearest heading that ends above ``top`` on the page, read off one by one."""
    above = [(y1, -i, text.split("\n")[0]) for i, (p, _, y1, text) in enumerate(blocks) if p == page and y1 <= top and text.endswith(")")]
    return max(above)[2] if above else None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.integers(1, 3), st.integers(0, 40), st.booleans()), max_size=12),
    st.lists(st.tuples(st.integers(1, 4), st.integers(0, 45)), min_size=1, max_size=8, unique=True),
)
def test_each_table_takes_the_heading_above_it(spark, placed, wanted):
    blocks = [(p, 20 * y, 20 * y + 10, f"หัวข้อ (Topic {chr(97 + i)})" if heads else f"ข้อความ {i}") for i, (p, y, heads) in enumerate(placed)]
    tables = tables_of(spark, [(p, 20 * y, f"t{i}") for i, (p, y) in enumerate(wanted)])
    found = L.section_for_tables(tables, blocks_of(spark, blocks)).collect()
    assert {r["markdown"]: r["section"] for r in found} == {f"t{i}": plain_section(blocks, p, 20 * y) for i, (p, y) in enumerate(wanted)}


def test_touching_rectangles_do_not_overlap(spark):
    blocks = blocks_of(spark, [(1, 0, 100, "above"), (1, 150, 160, "inside"), (1, 200, 220, "below")])
    kept = L.prose_blocks(blocks, tables_of(spark, [(1, 100, "t")])).collect()
    assert {r["text"] for r in kept} == {"above", "below"}


def test_chunk_documents(spark):
    """Page 2: prose around two tables with one heading between them; 8: no heading; 11: a table without any block."""
    blocks = blocks_of(
        spark,
        [(2, 300, 310, "ฝน (Rain)"), (2, 0, 8, "first words"), (2, 120, 130, "covered"), (2, 600, 640, "last\nwords"), (8, 50, 60, "8"), (8, 70, 90, "prose of eight")],
    )
    tables = tables_of(spark, [(2, 320, "|low|\n|---|"), (2, 100, "|high|\n|---|"), (8, 200, "|low|\n|---|"), (11, 0, "|none|\n|---|")])
    pages = spark.createDataFrame([], "document_id string, page_number int, raw_text string")
    rows = C.chunk_documents(blocks, tables, P.running_lines(pages)).orderBy("page_number", "kind_rank", "position").collect()
    assert [(r["page_number"], r["kind"], r["content"], r["section"]) for r in rows] == [
        (2, "prose", "first words\nฝน (Rain)\nlast\nwords", None),
        (2, "table", "|high|\n|---|", None),
        (2, "table", "|low|\n|---|", "ฝน (Rain)"),
        (8, "prose", "prose of eight", None),
    ]
    for r in rows:
        assert r["content_sha256"] == hashlib.sha256(r["content"].encode()).hexdigest()


def test_wrong_dimension_fails(spark):
    chunks = spark.createDataFrame([("c", "a b")], "chunk_id string, content string")
    short = lambda tokens: F.array(F.lit(1.0).cast("float"))
    with pytest.raises(Exception, match="expected 64 dimensions"):
        C.embed_chunks(chunks, short, 64).collect()


def test_the_first_copy_limit_runs_before_the_shuffle(spark):
    chunks = spark.range(1000).selectExpr("id % 2 AS document_id", "'same' AS content_sha256", "id AS ordinal")
    plan = C.keep_first_copies(chunks, ["ordinal"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.index("WindowGroupLimit") < text.rindex("Exchange hashpartitioning") < text.rindex("WindowGroupLimit")
    assert {r["ordinal"] for r in plan.collect()} == {0, 1}


def test_a_table_is_normalised_once(spark):
    """the normalisation stood in the plan once per use."""
    box = "bbox struct<x0: double, y0: double, x1: double, y1: double>"
    blocks = spark.createDataFrame([("d", 1, 1, (0.0, 0.0, 9.0, 9.0), "text")], f"document_id string, page_number int, ordinal int, {box}, text string")
    tables = spark.createDataFrame(
        [("d", 1, 1, (0.0, 50.0, 9.0, 90.0), [["a"]], "|a  b|\n|---|\n|e\u0301|"), ("d", 1, 2, (0.0, 60.0, 9.0, 90.0), [["a"]], "")],
        f"document_id string, page_number int, ordinal int, {box}, cells array<array<string>>, markdown string",
    )
    running = spark.createDataFrame([], "document_id string, running_key string")
    found = C.chunk_documents(blocks, tables, running)
    assert sorted(r["content"] for r in found.collect()) == ["text", "|a b|\n|---|\n|\u00e9|"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode(CASE WHEN (normalized" in plan


def test_cells_that_need_no_cleaning_stay_and_others_are_cleaned(evaluate):
    cells = ["plain", "", "a|b", " a", "a\u2003\u2003b", "a\x85", "|", "\n", None]
    assert evaluate(B.clean_cell(F.col("x")), cells, "string") == ["plain", "", "a\\|b", "a", "a b", "a", "\\|", "", None]


def test_blocks_and_tables_cross_the_shuffle_once(spark, tmp_path):
    """tables were shuffled five times, twice as bands and once with markdown; passages crossed with their hashes."""
    orders = [(k, k % 7, "FOP"[k % 3], f"{k % 5 + 1}-LEVEL") for k in range(60)]
    items = [(k, n, k % 9, k % 4) for k in range(60) for n in (1, 2)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([*items, *items], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = layout_plans.chunk_documents(spark, str(tmp_path))
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    pages = {(c, k % 3 + 1) for k, c, *_ in orders}
    wanted = [(p, s % 3 + 1, f"|order|line|supplier|\n|---|---|---|\n|{k}|{n}|{s}|") for k, n, p, s in items if (p, s % 3 + 1) in pages]
    tables = [(r["document_id"], r["page_number"], r["content"]) for r in rows if r["kind"] == "table"]
    assert sorted(tables) == sorted(wanted) and {(r["document_id"], r["page_number"]) for r in rows if r["kind"] == "prose"} <= pages
    assert all(r["content_sha256"] == hashlib.sha256(r["content"].encode()).hexdigest() for r in rows)
    moved = [line for line in plan.split("\n") if " Exchange " in line]
    assert plan.count("FileScan parquet [l_") == 1 and "band" not in plan
    assert not any("sha256" in line or "ordinal" in line for line in moved), moved


def test_a_block_inside_a_table_takes_along_those_of_its_ordinal(spark):
    box = lambda y: (0.0, float(y), 10.0, float(y) + 5)
    blocks = spark.createDataFrame(
        [("d", 1, 1, box(50), "in"), ("d", 1, 1, box(0), "same ordinal"), ("d", 1, None, box(50), "in, without one"), ("d", 1, 2, box(10), "out"), ("d", 2, 1, box(50), "next page"), (None, 1, 3, box(50), "no document")],
        f"document_id string, page_number int, ordinal int, bbox {BBOX}, text string",
    )
    tables = spark.createDataFrame([("d", 1, box(48)), (None, 1, box(48))], f"document_id string, page_number int, bbox {BBOX}")
    found = {(r["document_id"], r["page_number"]): r["prose"] for r in L.prose_text(blocks, tables).collect()}
    assert found == {("d", 1): "out\nin, without one", ("d", 2): "next page", (None, 1): "no document"}


def test_a_table_has_its_place_on_the_page(spark):
    blocks = blocks_of(spark, [(1, 0, 10, "words"), (1, 30, 35, "ฝน (Rain)")])
    tables = tables_of(spark, [(1, 40, "b"), (1, 20, "a"), (1, 40, "c"), (2, 5, "d")])
    found = {r["markdown"]: (r["position"], r["section"]) for r in L.section_for_tables(tables, blocks).collect()}
    assert found == {"a": (1, None), "b": (2, "ฝน (Rain)"), "c": (3, "ฝน (Rain)"), "d": (1, None)}
