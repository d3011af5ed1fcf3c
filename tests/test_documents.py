"""Small cases of document, source and streaming operators."""

from pyspark.sql import functions as F

from sedge.operators import cleaning, documents, retrieval
from sedge.sources import corpus


def test_grid_with_spans():
    grid = documents.grid_of("<table><tr><td rowspan=2>a</td><td colspan=2> b <b>c</b></td></tr><tr><td>d</td></tr><tr><td>e</table>")
    assert grid == [["a", "b c", ""], ["a", "d", ""], ["", "", ""]]


def test_replies(spark):
    given = ['{"a": {"b": "}"}}', 'x ```json\n{"a": 1}\n``` y', 'so {"a": "}{"} end {', 'so {"a": [1,],} end', "[1]", "", None]
    frame = spark.createDataFrame(list(enumerate(given)), "id int, reply string")
    assert [r.parse_stage for r in documents.parse_llm_json(frame).orderBy("id").collect()] == ["whole", "fenced", "braces", "repaired", "failed", "failed", "failed"]


def test_chunks(spark):
    text = "\n\n".join(["a" * 300, "b" * 300, " ", "c" * 900, "d"])
    frame = spark.createDataFrame([(1, "s", text), (2, "s", "short"), (3, "s", None), (4, "s", "")], "doc_id long, source string, text string")
    made = documents.chunk_documents(frame)
    got = {(r.doc_id, r.chunk_index): r.text for r in made.collect()}
    assert got == {(1, 0): "a" * 300 + "\n\n" + "b" * 300, (1, 1): "c" * 900, (1, 2): "d", (2, None): "short", (4, None): ""}
    lapped = {(r.doc_id, r.chunk_index): r.text for r in documents.chunk_overlap(made).collect()}
    assert lapped[1, 1] == "b" * 105 + "\n" + "c" * 900 and lapped[1, 2] == "c" * 105 + "\nd"


def test_text_files(spark, tmp_path):
    for name, text in (("a.md", "x\ny"), ("b.txt", ""), ("c.pdf", "no")):
        (tmp_path / name).write_text(text)
    assert {(r.file_name, r.ext, r.text) for r in corpus.scan_text_corpus(spark, f"file://{tmp_path}").collect()} == {("a.md", "md", "x\ny")}
    assert {r.length for r in corpus.scan_file_inventory(spark, f"file://{tmp_path}").collect()} == {3, 2}


def test_chunks_of_sections(spark):
    long = "\n\n".join(["# B", "b" * 400, "c" * 400, "", "s" * 300 + "." + "t" * 350 + "！" + "u" * 200 + "? ", "end"])
    text = "intro\n\n# A\nshort\n" + long + "\n#### deep\nx\n## C\n"
    frame = spark.createDataFrame([(1, "s", text), (2, "s", "# one\n\n" + "x" * 800)], "doc_id long, source string, text string")
    made = documents.chunk_documents(frame)
    got = [(r.section, r.strategy, r.text) for r in made.where("doc_id = 1").orderBy("chunk_index").collect()]
    assert got == [
        (None, "heading", "intro"), (None, "heading", "# A\nshort"), (2, "paragraph", "# B\n\n" + "b" * 400), (2, "paragraph", "c" * 400 + "\n\n"),
        (2, "sentence", "s" * 300 + "." + "t" * 350 + "！"), (2, "sentence", "u" * 200 + "?"), (2, "paragraph", "end\n#### deep\nx"), (None, "heading", "## C"),
    ]
    assert {(r.chunk_index, r.chunk_total) for r in made.where("doc_id = 1").collect()} == {(k, 8) for k in range(8)}
    assert [(r.strategy, len(r.text)) for r in made.where("doc_id = 2").orderBy("chunk_index").collect()] == [("paragraph", 5), ("paragraph", 800)]
    lapped = [r.text for r in documents.chunk_overlap(made).where("doc_id = 1").orderBy("chunk_index").collect()]
    assert lapped[2] == got[2][2] and lapped[3] == "b" * 105 + "\n" + got[3][2] and lapped[6] == got[5][2][-105:] + "\n" + got[6][2] and lapped[7] == "## C"


def test_noisy_chunks_keep_every_word(spark):
    made = documents.chunk_documents(cleaning.noisy_texts(spark, "/root/testdata/sf0.001").withColumn("source", F.lit("s")))
    parts = made.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("chunk_index", F.lit(0)), "text"))), lambda x: x["text"]).alias("t"))
    both = cleaning.noisy_texts(spark, "/root/testdata/sf0.001").join(parts, "doc_id", "left")
    squeezed = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    assert both.where(~squeezed(F.col("text")).eqNullSafe(squeezed(F.array_join("t", "")))).count() == 0
    assert made.where("strategy <> 'paragraph' and strategy <> 'sentence' and length(text) > 700").count() == 0


def test_vectors_in_blocks(spark):
    spec = "chunk_id long, text string, embedding array<double>"
    rows = [(k, "t", [float(k % 5), float(k % 7), 1.0]) for k in range(60)] + [(90, "t", None), (91, "t", [1.0, None, 1.0]), (92, "t", [float("nan")] * 3), (93, "t", [1.0, 2.0])]
    chunks = spark.createDataFrame(rows, spec)
    asked = spark.createDataFrame([(k, "q", [float(k % 3), 2.5, 1.0]) for k in range(9)] + [(9, " ", [1.0, 1.0, 1.0]), (10, "q", [1.0, 2.0]), (11, "q", None)], spec.replace("chunk_id", "query_id"))
    sent = sorted(map(tuple, retrieval.vector_search(chunks, asked, 4).collect()))
    dealt = sorted(map(tuple, retrieval.vector_search(chunks, asked, 4, query_block=3, chunk_block=11).collect()))
    want = []
    for q, _, v in (tuple(r) for r in asked.where("query_id < 9").collect()):
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(v, x, strict=True)) ** 0.5, 9), k) for k, _, x in rows[:60])[:4]
        want += [(q, r, k, d) for r, (d, k) in enumerate(near, 1)]
    want.append((10, 1, 93, 0.0))
    assert sent == dealt == sorted(want)
    assert retrieval.vector_search(chunks.limit(0), asked, 4, query_block=3).count() == retrieval.vector_search(chunks, asked.limit(0)).count() == 0


def test_python_gets_few_texts_at_once(spark):
    """What Arrow hands to a worker at once is bounded, whatever the session says before."""
    from sedge.functions.segment import dictionary_tokenizer
    from sedge.operators import paragraphs

    docs = spark.createDataFrame([(1, "a", "one text")], "doc_id long, source string, text string")
    words = spark.createDataFrame([("一", 1)], "word string, freq long")
    for make in (lambda: documents.chunk_documents(docs), lambda: paragraphs.review_segments(docs), lambda: dictionary_tokenizer(words)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        make()
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512


def test_grouped_rows_are_dealt_over_all_cores(spark, monkeypatch):
    """Groups of short rows keep all cores busy, and more rows make more partitions."""
    from sedge import workspace
    from sedge.operators import batches

    sf = "/root/testdata/sf0.001"
    assert batches.html_tables(spark, sf).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(workspace.dealt_by, "__defaults__", (100, 4))
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    for frame in (batches.html_tables(spark, sf), batches.QUERIES["sampled_modal_style"](spark, sf)):
        assert frame.rdd.getNumPartitions() == -(-rows // 100) > 16
