"""Token files and SentencePiece against their libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402

from tabsmith.llm import pieces, token_files  # noqa: E402

ODD = [
    (3, "Der Hund, die Katze.\nÜber ALLES... don't stop, it's 42!"), (1, None), (2, ""), (2, ""), (None, "a  b\t\tc"), (7, "日本語 é é ﬁ ΟΔΟΣ ΟΔΟΣ."),
    (9, "x" * 5000 + " " * 3000 + "the " * 4000), (10, "\x00▁▁▁ a▁b\r\n  z"), (11, "<|endoftext|> </s> <0x41> <unk>"), (12, "İ. Σ, ǅ., A.B,C."),
]


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def files(spark, docs, path):
    token_files.write_ids(docs, path, P.path("word_bpe_49k.json"))
    return token_files.read_ids(spark, path).orderBy("start").collect()


def test_token_files_hold_every_document_in_order(spark, texts, bpe, tmp_path):
    got = files(spark, texts(ODD), str(tmp_path / "f"))
    assert [r["doc_id"] for r in got] == [1, 2, 2, 3, 7, 9, 10, 11, 12, None]
    text = {i: t for i, t in ODD}
    start = 0
    for r in got:
        ids = [*bpe(text[r["doc_id"]]), 1]
        assert r["ids"] == ids and r["start"] == start and r["n_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_files_give_single_documents(spark, texts, bpe, tmp_path):
    path = str(tmp_path / "f")
    pairs = [(i, f"document number {i} of the set, with words") for i in range(400)]
    token_files.write_ids(texts(pairs), path, P.path("word_bpe_49k.json"))
    known = spark.read.parquet(f"{path}/dictionary").first()
    assert hashlib.sha256(bytes(known["dictionary"])).hexdigest() == known["dict_hash"]
    got = token_files.read_ids(spark, path, [7, 333, 9999]).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: [*bpe(pairs[i][1]), 1] for i in (7, 333)}
    assert spark.read.parquet(f"{path}/blocks").filter("dict_hash != '" + known["dict_hash"] + "'").count() == 0


def test_words_equal_the_library_with_a_cache_that_forgets(bpe, monkeypatch):
    monkeypatch.setattr(token_files, "GENERATION", 50)
    monkeypatch.setattr(token_files, "JOINED", 7)
    coder = token_files.WordCoder(P.path("word_bpe_49k.json"), 2)
    rng = random.Random(2)
    signs = [*" .,\nabZé中İΣ'ǅﬁ0-\t\u0301ⅷ", "the", "ΟΔΟΣ", "<|endoftext|>", "<|EndOfText|>", "don't", "we'LL", "  ", "...", "x" * 150, "ﬁ–«é_1²"]
    for _ in range(60):
        part = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 16))) for _ in range(50)]
        assert [np.frombuffer(x, "<u2").tolist() for x in coder.encode(part)] == [bpe(t) for t in part]
        assert len(coder.young) < 2000 and not any(len(w) > 100 for w in coder.young)


def test_ascii_pieces_are_parted_in_one_go(bpe, monkeypatch):
    """One search parts all pieces of a call; before, each piece took one of its own."""
    calls = []

    class Counted:
        def findall(self, text):
            calls.append(text)
            return runs.findall(text)

    runs = token_files.RUNS
    monkeypatch.setattr(token_files, "RUNS", Counted())
    coder = token_files.WordCoder(P.path("word_bpe_49k.json"), 2)
    odd = ["it's", "IT'S", "a_b", "__", "x1y22", "tab\tin", "\t", "a\rb", "\x0b", "\x1c,", "...", "'ll'LL", "A<|ENDOFTEXT|>b", "<|startoftext|>", "a<|endoftext|>,b", "<|x|>", "y" * 150 + ".", "\x00z"]
    text = [*odd, " ".join(odd), "\n".join(odd * 3), "", " ", "  \n ", "Ärger, ÉTÉ. e\u0301! ΟΔΟΣ, İ. 漢字 a", "plain words only"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in coder.encode(text)] == [bpe(t) for t in text]
    assert sum(t.isascii() for t in calls) <= 2


def test_a_slice_of_usual_texts_is_one_batch():
    """Words that several texts share are looked up once; 2 MB batches cut such a slice in two."""
    assert list(token_files._batches(["x" * 3400] * 1000)) == [(0, 1000)]


def test_another_tokenizer_is_an_error():
    with pytest.raises(ValueError, match="known way"):
        token_files.WordCoder(P.path("byte_bpe_50k.json"), 2)
    with pytest.raises(ValueError, match="do not fit"):
        token_files.WordCoder(P.path("word_bpe_49k.json"), 1)


def test_token_files_of_an_empty_table(spark, texts, tmp_path):
    assert files(spark, texts([]), str(tmp_path / "f")) == []


def test_pieces_equal_the_library_on_odd_texts(texts, sp):
    got = sorted(pieces.encode_pieces(texts(ODD), P.path("piece_bpe_32k.model")).collect(), key=str)
    want = sorted([(i, sp.encode(t or ""), sp.decode(sp.encode(t or ""))) for i, t in ODD], key=lambda x: str(x))
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in got) == sorted((str(a), b, c) for a, b, c in want)


def test_pieces_equal_the_library_on_random_texts(sp):
    model = pieces.PieceModel.of(P.path("piece_bpe_32k.model"))
    rng = random.Random(5)
    signs = " ab\n\t▁日é😀.,\x00thesion{}()0123'\"ABC"
    parts = [p.replace("▁", " ") for p in model.id]
    for n in range(4000):
        s = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) if n % 2 else "".join(rng.choice(parts) for _ in range(rng.randint(1, 6)))
        s = s.replace("b", " " * rng.randint(0, 40)) if n % 3 == 0 else s
        assert model.encode(s) == sp.encode(s), s


def test_backtracking_equals_plain_merging():
    model = pieces.PieceModel.of(P.path("piece_bpe_32k.model"))
    rng = random.Random(6)
    for _ in range(500):
        s = "▁" + "".join(rng.choice("abcdehinorst") for _ in range(rng.randint(1, 25)))
        assert model.backtrack(s) == [model.id[p] for p in model.merge(s)]


def test_piece_digests_and_empty_table(texts, sp):
    got = pieces.piece_digests(texts([(1, "one two"), (2, None)]), P.path("piece_bpe_32k.model")).orderBy("doc_id").collect()
    ids = sp.encode("one two")
    assert got[0]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[0]["n_tokens"] == len(ids)
    assert got[1]["n_tokens"] == 0 and got[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pieces.piece_digests(texts([]), P.path("piece_bpe_32k.model")).count() == 0
