"""The registered queries over the small tables: names, columns, and the rows of their SQL texts."""

import pytest

from reelframe.llm.queries import QUERIES, SQL

COLUMNS = {
    "op1_quality_crf": ["doc_id", "held_out", "score", "predicted"], "op2_pseudo_likelihood": ["doc_id", "n_tokens", "pll", "score"], "op3_simhash": ["doc_id", "fingerprint", "component_id"],
    "op4_suffix_index": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "op5_leaks": ["doc_id", "item_id", "n_shared", "n_item", "containment"],
    "op6_exact": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], "op7_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op8_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"], "op9_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op10_licenses": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op11_spelling": ["word", "form", "root", "n", "n_near", "form_n"], "op12_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op13_lexical": ["item_id", "rank", "doc_id", "score"],
}


def test_all_queries():
    assert list(QUERIES) == list(COLUMNS) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(SQL))
def test_rows_of_the_sql_text(spark, con, data, name):
    df = QUERIES[name](spark, data)
    names = sorted(df.columns)
    want = con.execute(SQL[name])
    at = {d[0]: i for i, d in enumerate(want.description)}
    assert sorted(at) == names
    plain = lambda rows: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert plain(tuple(r[n] for n in names) for r in df.collect()) == plain(tuple(r[at[n]] for n in names) for r in want.fetchall())


@pytest.mark.parametrize("name", [n for n in COLUMNS if n not in SQL])
def test_columns_and_rows(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns[:len(COLUMNS[name])] == COLUMNS[name]
    whole = spark.read.parquet(f"{data}/{'pages' if name == 'op7_url_filter' else 'documents'}.parquet")
    if name == "op11_spelling":
        assert 0 < df.count() == df.select("word").distinct().count()
    elif name == "op8_packing":
        assert df.select("doc_id").distinct().count() == whole.count()
    else:
        assert df.count() == whole.count()
