import pytest
from tokenizers import Tokenizer

from lotwise.llm import bpe
from lotwise.llm.queries import word_vocabulary
from texts import descriptions, listings, none


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_vocabulary())


def test_ids_and_texts_equal_the_library(spark, library):
    texts = [*descriptions(), "it's THE Ünïcode ﬁ ΣΑΣ ⅷ é don't!!...#12345", "x\x1cy\x85z"]
    encoded = bpe.encode_descriptions(listings(spark, texts), word_vocabulary())
    rows = {r.id: r for r in bpe.decode_descriptions(encoded, word_vocabulary()).collect()}
    assert len(rows) == len(texts)
    for n, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert rows[n].token_ids == ids
        assert rows[n].description == library.decode(ids, skip_special_tokens=False)


def test_repeated_rows_null_ids_and_empty_table(spark, library):
    rows = spark.createDataFrame([(1, "flat"), (1, "flat"), (None, "plot")], "id long, description string")
    found = bpe.encode_descriptions(rows, word_vocabulary()).collect()
    assert sorted((r.id or 0, len(r.token_ids)) for r in found) == [(0, 1), (1, 1), (1, 1)]
    assert bpe.encode_descriptions(none(spark), word_vocabulary()).count() == 0


def test_decoding_skips_what_is_no_id(spark):
    rows = spark.createDataFrame([(1, [320, None, 99_999_999, -4]), (2, None), (3, [])], "id long, token_ids array<int>")
    found = {r.id: r.description for r in bpe.decode_descriptions(rows, word_vocabulary()).collect()}
    assert found[1] == bpe.vocabulary_pieces(word_vocabulary())[320] and found[2] == "" and found[3] == ""


def test_blocks_are_cut_and_joined_back(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 200)
    texts = descriptions(5)
    found = {r.id: r.token_ids for r in bpe.encode_descriptions(listings(spark, texts), word_vocabulary()).collect()}
    assert found == {n: library.encode(t or "", add_special_tokens=False).ids for n, t in enumerate(texts)}
