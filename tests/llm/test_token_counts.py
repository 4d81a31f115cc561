import pytest

from tidemark.llm.queries import PIECES, vocabulary
from tidemark.llm.token_counts import token_counts, whole_tokens


def check(df, limit=4096):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    rows = df.select("doc_id", "text").collect()
    expected = [(r.doc_id, len((r.text or "").encode()), n := len(m.encode(r.text or "")), n > limit) for r in rows]
    got = token_counts(df, vocabulary(PIECES), limit=limit)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_odd(odd):
    check(odd)


def test_sample(sample):
    check(sample, 300)


def test_empty(empty):
    check(empty)


def test_repeated(repeated):
    check(repeated)


@pytest.mark.parametrize("text", [" ", "   a", "a  ", "a   b\n\n  c ", "▁", "▁ ▁▁a ▁", "a▁ b", "\n", "a\tb  \t c", "\0 a\0", "<s> </s> <unk> <0x0A>", "日本 語", "12 345 6789", "é    x"])
def test_blanks_and_odd_characters(spark, text):
    check(spark.createDataFrame([(1, text)], "doc_id long, text string"))


def test_whole_tokens_are_single():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    words = whole_tokens(vocabulary(PIECES))
    assert len(words) > 10_000 and all(len(m.encode(w.decode())) == 1 for w in words[:500])
