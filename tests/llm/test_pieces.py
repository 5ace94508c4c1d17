import hashlib
import random

import pytest

from wayline.llm.pieces import Pieces, encode_documents

tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def both():
    path = tokenizers.path("piece_bpe_32k.model")
    return Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path), path


def texts():
    rng = random.Random(1)
    odd = ["", None, " ", "   a", " a b  c   d    e", "\n\n\n", "\t\tx\r\n y", "a" * 1500, "▁▁a ▁b", "<s></s><0x41>", "日本語テキスト🙂🙂👩‍👩‍👧", "\x00a\x00", " " * 500, "abab" * 300, "1234567890" * 20, "İstanbul ß ſ", "don't.stop,now!! 50%%% |x|"]
    return odd + ["".join(rng.choice("ab cdethin ▁\n\t.éß日🙂,!1 ") for _ in range(rng.randint(0, 80))) for _ in range(2000)]


def test_ids_and_texts_equal_the_library(both):
    own, library, _ = both
    for text, (ids, n, decoded) in zip(texts(), own.rows(texts())):
        want = library.encode(text or "", add_eos=True)
        assert ids == " ".join(map(str, want)) and n == len(want)
        assert decoded == library.decode(want) == own.decode(want)


def test_query_columns(spark, both):
    _, library, path = both
    rows = [(i, t) for i, t in enumerate(texts()[:60])] + [(None, "a b"), (3, "a b")]
    frame = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, n_tokens int")
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((i, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))))
    assert sorted(map(str, map(tuple, encode_documents(frame, path).collect()))) == sorted(map(str, want))
    full = {r.doc_id: r for r in encode_documents(frame.where("doc_id = 4"), path, full=True).collect()}
    assert full[4].ids == library.encode(rows[4][1], add_eos=True)
    assert encode_documents(frame.limit(0), path).count() == 0


def test_long_unbroken_texts(both):
    own, library, _ = both
    rng = random.Random(5)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000))
    long = [letters, "a" * 20_000, "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(8_000)), "the" * 8_000, "🙂日" * 3_000, "word " * 60_000, "x" * 63 + "qz" * 70]
    for text, ids in zip(long, own.encode(long), strict=True):
        assert ids[:-1] == library.encode(text)
        assert own.decode(ids[:-1]) == library.decode(ids[:-1]) == text
