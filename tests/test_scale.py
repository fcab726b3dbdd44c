"""What keeps the cost of a row from growing: texts made once, rows dealt out, small batches to Python."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from leadloom.functions import markup
from leadloom.operators import listing, pages as pg
from leadloom.session import spread


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_label_texts_are_made_once(spark):
    row = dict(id=1, company="Blue Star", person="CEO - Asha Rao\nCFO - X", phone="9812345678", email="a@b.in c@d.in", address="",
               industry="Pumps", revenue="Not publicly documented", erp=" SAP ")
    found = pg.label_spans(spark.createDataFrame([row]), "id")
    unnested = found.select("id", "template", "text", F.inline("spans"))
    assert _plan(unnested).count("instr(") == 16  # two for each of eight labels
    rows = unnested.collect()
    assert rows and all(r["text"][r["start"]:r["end"]] in ("Blue Star", "Asha Rao", "9812345678", "a@b.in", "Pumps", "SAP") for r in rows)


def test_short_rows_are_always_dealt_out(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t"))
    assert spread(one, rows=True).rdd.getNumPartitions() >= 4 * cores
    many = one.repartition(cores)  # as many splits as cores are not enough: some may be empty
    assert spread(many).rdd.getNumPartitions() == cores
    assert spread(many, rows=True).rdd.getNumPartitions() >= 4 * cores


def test_unnested_elements_are_found_once(spark):
    pages = spark.createDataFrame([(1, "<li>CEO Ravi Kumar leads</li><h3>director X</h3>" + " " * 500)], "page_id long, html string")
    for found in (pg.decision_makers(pages), pg.page_addresses(pages), listing.listing_seeds(pages), listing.card_seeds(pages)):
        assert _plan(found).count("monotonically_increasing_id") >= 1  # what is unnested is pinned, no filter holds a copy of it
    assert [r["person"] for r in pg.decision_makers(pages).orderBy("rank").collect()] == ["Ravi Kumar (CEO Ravi Kumar leads)", "director X"]


def test_elements_leave_a_worker_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        pages = spark.range(1500).select(F.col("id").alias("page_id"), F.lit("<p class='a b'>x<br>y</p>").alias("html")).coalesce(1)
        parsed = markup.with_elements(pages)
        assert int(spark.conf.get(key)) <= 512
        assert parsed.filter(F.size("nodes") == 2).count() == 1500
    finally:
        spark.conf.set(key, before)


def test_element_arrays():
    got = markup._arrays(["<ul><li>a<li>b</ul><img itemprop=q href=h>", None, "", "<script>x</script>y"]).to_pylist()
    assert [[n["step"] for n in p["nodes"]] for p in got] == [["ul.", "li.", "li.", "img.@q."], [], [], ["script."]]
    assert [p["texts"] for p in got] == [["a", "b"], [], [], ["y"]]
    assert [(n["i"], n["last"], n["t0"], n["t1"], n["href"]) for n in got[0]["nodes"]] == [
        (0, 2, 0, 2, None), (1, 1, 0, 1, None), (2, 2, 1, 2, None), (3, 3, 2, 2, "h")]
    assert markup._arrays([]).type == pa.struct([("nodes", markup._arrays(["<p>"]).type.field("nodes").type), ("texts", pa.list_(pa.string()))])


def test_page_records_are_read_written(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(i, "https://a.in/", "<title>Blue Star Works</title><p>We make pumps in Pune for every mill.</p>") for i in range(3)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    merged = entry.queries()["dedupe_exact_pages"](spark, str(tmp_path))
    assert "html" not in _plan(merged)  # the merge reads its rows twice, not the pages
    assert [r["n_records"] for r in merged.collect()] == [3]


def test_few_line_hashes_take_little_memory():
    from leadloom.llm import lines

    rng = np.random.default_rng(1)
    first, second = rng.integers(0, 1 << 63, 3000).astype(np.uint64), rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    few, many = lines.TwoFilters(1 << 22), lines.TwoFilters(1 << 22)
    many.add(rng.integers(0, 1 << 63, 1 + (1 << 14)).astype(np.uint64))
    for filters in (few, many):
        filters.add(first)
        filters.add(np.concatenate([second, second[:5], first[:7]]))
    assert few.once is None and few.hashes.nbytes + few.times.nbytes < 100_000 and many.once is not None and many.hashes is None
    for filters in (few, many):
        twice = np.zeros((1 << 22) // 8, np.uint8)
        for i, once, again in filters.pieces():
            at = slice(i * lines.PIECE // 8, (i + 1) * lines.PIECE // 8)
            twice[at] = lines.unpacked(again)
            assert not (twice[at] & ~lines.unpacked(once)).any()
        held = filters.holds(twice, filters.places(np.concatenate([first, second]), 1 << 22))
        assert held[:7].all() and held[3000:3005].all() and held.sum() < 300


def test_words_kept_have_a_bound_and_can_be_given_back(monkeypatch):
    from leadloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHED", 20)
    made = tokens.Encoder(tokens.word_tokenizer())
    for text in [" ".join(f"Wo{chr(97 + i % 26)}rd{i}, na\u00efve's" for i in range(100)), "it's (caf\u00e9) ''s \u00c0\u00dfx"]:
        wanted = np.array(made.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert made.ids(text) == wanted == made.ids(text)
        assert len(made.words) <= 10 and len(made.words.before) <= 10
    made.forget()
    assert not made.words and not made.words.before
