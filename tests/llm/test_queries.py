"""Every registered query over its whole tables: the contract's columns, against the libraries or brute force."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from oreflow.llm import queries
from test_corpus import _brute, _roots

SF = "/root/testdata/sf0.001"


def _rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_the_ten_queries_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize(("name", "part", "learned"), [("op1_quality_classifier", 3, 1), ("op8_language_id", 4, 2)])
def test_scores(spark, texts, name, part, learned):
    found = _rows(spark, name)
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % part == learned) and 0 <= r.score <= 1
    if part == 3:
        labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
        assert all(r.predicted == int(r.score >= 0.5) for r in found)
        held = [r.predicted == labels[r.doc_id] for r in found if r.held_out and r.doc_id in labels]
    else:
        lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        held = [r.lang_pred == lang[r.doc_id] for r in found if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert len(held) > 10 and np.mean(held) >= 0.9


def test_media(spark, texts):
    found = _rows(spark, "op2_png_media")
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        data = texts[r.doc_id].encode()
        whole = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
        assert r.media_bytes > 0 and len(r.media_sha256) == 64 and r.feature


def test_packing(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    pieces, sequences = {}, {}
    for r in _rows(spark, "op3_packing"):
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for runs, size in [(sorted(v), len(ids[k])) for k, v in pieces.items()] + [(sorted(v), None) for v in sequences.values()]:
        at = 0
        for start, length in runs:
            assert start == at and length > 0
            at += length
        assert at == size if size else at <= 4096
    assert set(pieces) == set(texts)


def test_records(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = _rows(spark, "op4_warc_derivatives")
    assert sorted((r.page_id, r.record_type) for r in found) == sorted((i, kind) for i in pages for kind in ("conversion", "metadata"))
    for r in found:
        head, block = bytes(r.record).split(b"\r\n\r\n", 1)
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert block[int(fields[b"Content-Length"]) :] == b"\r\n\r\n" and fields[b"WARC-Target-URI"].decode() == pages[r.page_id].url and fields[b"WARC-Refers-To"].decode() == r.refers_to


def test_url_rules_against_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    found = queries.QUERIES["op5_bloom_cascade"](spark, SF)
    columns = found.columns
    wanted = con.execute(queries.ORACLE_SQL["op5_bloom_cascade"])
    names = [x[0] for x in wanted.description]
    assert sorted(names) == sorted(columns)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(str(tuple(r[names.index(c)] for c in columns)) for r in wanted.fetchall())


def test_pieces(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = _rows(spark, "op6_sentencepiece")
    assert sorted(r.doc_id for r in found) == sorted(texts)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in found:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))


def test_fingerprints(spark, texts):
    assert sorted(tuple(r) for r in _rows(spark, "op7_simhash")) == sorted(_brute(list(texts.items())))


def test_token_files(spark, texts):
    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    found = {r.doc_id: r for r in _rows(spark, "op9_token_files")}
    assert sorted(found) == sorted(texts)
    for i in sorted(texts):
        ids = np.array([*tokenizer.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    known = [r for r in rows if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)]
    x = np.array([r.embedding for r in known], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [r.vec_id for r in known]
    root = _roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    links = dict(zip(ids, near.sum(axis=1).tolist()))
    found = _rows(spark, "op10_metric_join")
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == sorted((r.vec_id, links.get(r.vec_id, 0), root.get(r.vec_id, r.vec_id), root.get(r.vec_id, r.vec_id) == r.vec_id) for r in rows)


def test_pipeline_over_whole_tables(spark, texts):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, SF).collect()
    kept = {r.doc_id for r in found}
    assert 0 < len(kept) < len(texts) and kept <= set(texts)
