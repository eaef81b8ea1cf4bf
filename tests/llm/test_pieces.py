"""Ids and decoded texts against the library, text by text."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as entry
from tracemill.llm import pieces
from tracemill.llm.pieces import encode_pieces, piece_digest, read_model

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_every_kind_of_text(docs_of, sp):
    rng = random.Random(3)
    alphabet = list("abcdeABC  \t\n.,-'0123456789éß漢字ñ▁​ 　\U0001F600\x00\r") + ["the ", " ing", "  ", "<s>", "</s>", "<0x0A>", "<unk>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += [None, "", " ", "   ", "▁", "▁▁a", " a", "a ", "a  b", "\n", "x" * 20_000, "ab" * 5_000 + " c"]
    rows = encode_pieces(docs_of(texts), MODEL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = sp.encode(texts[r["doc_id"]] or "")
        assert (r["ids"], r["decoded"]) == (ids, sp.decode(ids))


def test_blocks_share_words(docs_of, sp, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 200)
    monkeypatch.setattr(pieces, "BUCKET_WORDS", 3)
    texts = [f"the same word {i % 7} again and again, the" for i in range(200)] + ["w" * 500] + [None] * 40
    rows = encode_pieces(docs_of(texts), MODEL).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {i: sp.encode(t or "") for i, t in enumerate(texts)}


def test_odd_rows_and_empty(odd, sp):
    got = sorted((str(r["doc_id"]), r["ids"]) for r in encode_pieces(odd, MODEL).collect())
    assert got == sorted((str(r["doc_id"]), sp.encode(r["text"] or "")) for r in odd.collect())
    assert encode_pieces(odd.limit(0), MODEL).count() == 0


def test_other_models_are_refused(monkeypatch):
    class Crossing:
        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "of▁the"

    monkeypatch.setattr(pieces, "_library", lambda model: Crossing())
    with pytest.raises(ValueError, match="cross"):
        read_model(MODEL)


def test_query(spark, sf_dir, sp):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:4] for r in entry.queries()["op13_pieces"](spark, sf_dir).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in docs:
        ids = sp.encode(r["text"] or "")
        assert got[r["doc_id"]] == (len(ids), digest(",".join(map(str, ids))), digest(sp.decode(ids)))
