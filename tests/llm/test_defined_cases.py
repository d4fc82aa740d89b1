"""Empty tables, repeated rows and columns with clashing names, where other tests don't have them."""

import collections
import io

import pytest

import corpus_pipeline
from voluma.llm import common, warc

DATA = "/root/testdata/sf0.001"


def test_warc_with_clashing_columns_and_repeated_rows(spark, tmp_path):
    page = "<html>" + "p" * 300
    rows = [(1, "u", page, 7, "d", "x", 0, "f"), (1, "u", page, 7, "d", "x", 0, "f"), (2, None, page, None, None, None, None, None), (3, "v", "é" * 100_000, 1, "d", "y", 2, "g")]
    spark.createDataFrame(rows, "page_id long, url string, html string, page int, digest string, payload string, n_bytes int, first string").write.parquet(f"{tmp_path}/pages.parquet")
    out = warc.op7_warc(spark, str(tmp_path)).collect()
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in out) == {(1, 306, "response", None): 2, (2, 306, "revisit", 1): 1, (3, 200_000, "response", None): 1}


def test_warc_refuses_a_damaged_payload():
    row = {"page": 1, "url": "u", "payload": b"some payload", "n_bytes": 12, "digest": "0" * 64, "refers_to": None}
    with pytest.raises(ValueError, match="differ"):
        warc.verified(warc.parse(warc.record(row)))
    archive = warc.Archive(stream := io.BytesIO())
    stream.close = lambda: None
    archive.add(warc.record(row))
    archive.close()
    cut = io.BytesIO(stream.getvalue()[:-9])
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.frames(cut))


@pytest.mark.parametrize("rows", [0, 3])
def test_pipeline_of_an_empty_table_and_of_repeated_rows(spark, tmp_path, rows):
    docs = common.read(spark, DATA, "documents")
    few = docs.where("doc_id < 40") if rows else docs.limit(0)
    for _ in range(rows - 1):
        few = few.union(docs.where("doc_id < 40"))
    few.write.parquet(f"{tmp_path}/documents.parquet")
    common.read(spark, DATA, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = collections.Counter((r["doc_id"], r["piece"]) for r in out)
    assert bool(out) == bool(rows) and set(pieces.values()) <= {1}  # of the repeated rows of an id one is left
