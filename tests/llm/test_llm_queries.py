"""Queries of this folder against their SQL, or against brute force where SQL cannot express them."""

import hashlib
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.helpers import cells, duck
from tests.llm.test_fingerprints import all_hashes, expected_rows as neighbours
from tests.llm.test_ngram_join import expected as similar_texts
from tests.llm.test_periodic_runs import expected as runs_in, planted, words_of
from tests.llm.test_suffix_dedup import expected as repeated_bytes
from zeitton.llm.oracle import SQL
from zeitton.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    found = duck(FOLDER).execute(SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(names)
    assert cells(df.collect(), df.columns) == cells(found.fetchall(), names)


@pytest.fixture(scope="module")
def texts():
    return dict(duck(FOLDER).execute("select doc_id, text from documents order by doc_id").fetchall())


def result(spark, name):
    rows = QUERIES[name](spark, FOLDER).collect()
    return {r.doc_id: r for r in rows}, rows


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


def test_op1_ids_and_round_trip(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found, _ = result(spark, "op1_sentencepiece")
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        assert found[i].ids == library.encode(text) and found[i].n_ids == len(found[i].ids)
        assert found[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_op2_removed_bytes(spark, texts):
    found, _ = result(spark, "op2_suffix_dedup")
    want = repeated_bytes(list(texts.values()))
    for i, (n_bytes, n_removed, n_spans, kept) in zip(texts, want, strict=True):
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans) == (n_bytes, n_removed, n_spans)
        assert found[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_op4_shards(spark, texts):
    found, rows = result(spark, "op4_sharding")
    assert found.keys() == texts.keys() and len(rows) == len(texts)
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(16)}
    assert {len(v) for v in slots.values()} <= {len(texts) // 16, len(texts) // 16 + 1}
    assert all(v == list(range(len(v))) for v in slots.values())
    for i, text in texts.items():
        raw = text.encode()
        assert (found[i].size, found[i].text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert (found[i].law, found[i].grown_shard) == ("rows", None)


def test_op8_pieces(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    _, rows = result(spark, "op8_packing")
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()}
    bins = defaultdict(list)
    for r in rows:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert (zlib.crc32(piece.tobytes()), len(ids[r.doc_id])) == (r.ids_crc32, r.doc_tokens)
        bins[r.sequence_id].append((r.offset, r.length))
    total = sum(map(len, ids.values()))
    assert sum(r.length for r in rows) == total and len(bins) <= -(-total // 4096) + 1
    assert all(sum(n for _, n in v) <= 4096 for v in bins.values())


def test_op10_links(spark, texts):
    found, _ = result(spark, "op10_ngram_join")
    assert {i: (r.class_id, r.n_links, r.kept) for i, r in found.items()} == similar_texts(list(texts.values()))


def test_op11_runs(spark, texts):
    found, rows = result(spark, "op11_periodic_runs")
    assert found.keys() == texts.keys() and len(rows) == len(texts)
    edited = 0
    for i, text in texts.items():
        words = planted(i, words_of(text))
        edited += words != words_of(text)
        runs, rest = runs_in(words)
        shown = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
        best = max(runs, key=lambda r: (Fraction(r[2], r[1]), -r[0], -r[1]), default=None)
        row = found[i]
        assert row.n_runs == len(runs)
        assert (row.start, row.period, row.length) == (best or (None, None, None))
        assert row.exponent_milli == (1000 * best[2] // best[1] if best else None)
        assert row.runs_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(rest.encode()).hexdigest()
    assert edited > 5


def test_op12_fingerprints(spark, texts):
    (found, rows), errors = result(spark, "op12_fingerprints"), []
    assert found.keys() == texts.keys() and len(rows) == len(texts)
    for i, text, edited, shown, shown_edited, near_edited, near_next in neighbours(list(texts.items())):
        row = found[i]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (row.fingerprint, row.edited_fingerprint) == (shown, shown_edited)
        assert (row.near_edited, row.near_next) == (near_edited, near_next)
        if len(text) > 3000:  # the estimate against all shingles
            whole, changed = all_hashes(text), all_hashes(edited)
            errors.append(near_edited - len(np.intersect1d(whole, changed)) / min(len(whole), len(changed)))
    assert len(errors) > 20 and abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08
