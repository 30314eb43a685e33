import collections
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from rankloom.llm import repacking as R
from rankloom.llm.queries import op13_best_fit_packing

SMALL = "/root/testdata/sf0.001"


def brute_pieces(rows, length=R.LENGTH):
    tokenizer = Tokenizer.from_file(R.tokenizer_path())
    out = collections.Counter()
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [R.END_ID]
        for number, at in enumerate(range(0, len(ids), length)):
            part = np.asarray(ids[at : at + length], dtype="<u4")
            out[(doc_id, number, at, len(part), zlib.crc32(part.tobytes()))] += 1
    return out


def assert_packed(rows, length=R.LENGTH):
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        place = 0
        for offset, size in sorted(parts):
            assert offset == place
            place += size
        assert place <= length
    return len(sequences)


@pytest.mark.parametrize("row", [7, 4096])
def test_best_fit_decreasing_and_bound(row):
    rng = np.random.default_rng(row)
    lengths = rng.integers(1, row + 1, 5000)
    sequence, offset, rooms = R.best_fit_decreasing(lengths, row)
    used = np.bincount(sequence, weights=lengths, minlength=len(rooms))
    assert (used + rooms == row).all()
    assert R.lower_bound(lengths, row) <= len(rooms) <= R.lower_bound(lengths, row) * 1.02 + 1
    assert R.lower_bound(np.array([row // 2 + 1] * 9), row) == 9


def test_edge_rows_every_piece_once(spark, edge_docs):
    rows = R.pack_pieces(R.token_pieces(edge_docs)).collect()
    got = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == brute_pieces(edge_docs.select("doc_id", "text").collect())
    assert assert_packed(rows) == R.lower_bound(np.array([r.length for r in rows]), R.LENGTH)


def test_exchange_rounds_pack_as_tightly(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    pieces = R.token_pieces(docs)
    once = R.pack_pieces(pieces, rounds=1, group_tokens=20_000).collect()
    rounds = R.pack_pieces(pieces, rounds=4, group_tokens=20_000).collect()
    whole = R.pack_pieces(pieces).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, rounds)) == sorted(map(key, whole)) == sorted(map(key, once))
    bound = R.lower_bound(np.array([r.length for r in whole]), R.LENGTH)
    assert bound <= assert_packed(whole) <= bound + 1
    assert bound <= assert_packed(rounds) < assert_packed(once)
    assert assert_packed(rounds) <= bound + 2


def test_empty_string_ids_and_query(spark, empty_docs):
    assert R.pack_pieces(R.token_pieces(empty_docs)).count() == 0
    named = spark.createDataFrame([("a", None, 1), ("b", "x y", 2)], "doc_id string, text string, sequence_id int")
    rows = R.pack_pieces(R.token_pieces(named)).collect()
    assert sorted(r.doc_id for r in rows) == ["a", "b"] and assert_packed(rows) == 1
    out = op13_best_fit_packing(spark, SMALL)
    assert out.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() >= spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_words_give_the_ids_of_whole_texts(monkeypatch):
    import random

    import pyarrow as pa

    from rankloom.llm import word_ids

    tokenizer = Tokenizer.from_file(R.tokenizer_path())
    texts = [
        None, "", " ", "\t\n ", "  lead and trail \n", "It's 10 o'clock, they'll've 2007-08-10 0 00 x0y 0", "<|endoftext|> a<|startoftext|>0",
        "é ́x ạ̈ 가 Ω İI ΣΣ σ", "a b　c\u0085d\x1ce\x0bf\x0cg\r\nh i", "中文\U0001f600 x\x00y ٠١²",
        "a" * 3000, "word " * 5000, "</w> 0</w> '0' ",
    ]
    chance = random.Random(5)
    signs = [*"aab0 \t\n\r\x0b\x0c\x85 'st<|>.́̈İᅡᄀ٠Åßǅ", "<|endoftext|>", "'ll"]
    texts += ["".join(chance.choices(signs, k=chance.randint(1, 80))) for _ in range(3000)]
    monkeypatch.setattr(word_ids, "MEMORY_WORDS", 500)
    encoder = word_ids.WordIds(tokenizer)
    assert encoder.by_word
    for at in range(0, len(texts), 400):
        part = texts[at : at + 400]
        ids, sizes = encoder.encode(pa.array(["left out", *part], pa.string()).slice(1))
        whole = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]
        assert sizes.tolist() == [len(w) for w in whole]
        assert ids.tolist() == [i for w in whole for i in w]
    assert encoder.encode(pa.array([], pa.string()))[0].size == 0
    assert encoder.encode(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0]


def test_a_word_is_encoded_once():
    import pyarrow as pa

    from rankloom.llm import word_ids

    class Counting:
        """A tokenizer that counts the characters it is given."""

        def __init__(self):
            self.given, self.own = 0, Tokenizer.from_file(R.tokenizer_path())
            self.to_str, self.encode = self.own.to_str, self.own.encode

        def encode_batch_fast(self, texts, add_special_tokens):
            self.given += sum(map(len, texts))
            return self.own.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    counting = Counting()
    encoder = word_ids.WordIds(counting)
    for _ in range(3):
        encoder.encode(pa.array(["seldom heard words " * 1000] * 5))
    assert counting.given < 100


def test_a_word_is_encoded_once_whatever_its_case_and_signs():
    import pyarrow as pa

    from rankloom.llm import word_ids

    class Counting:
        """A tokenizer that counts the characters it is given."""

        def __init__(self):
            self.given, self.own = 0, Tokenizer.from_file(R.tokenizer_path())
            self.to_str, self.encode = self.own.to_str, self.own.encode

        def encode_batch_fast(self, texts, add_special_tokens):
            self.given += sum(map(len, texts))
            return self.own.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    counting = Counting()
    text = " ".join(
        f"{before}{word}{behind}"
        for before in ("", "(", "--", "7")
        for word in ("heard", "Heard", "HEARD", "wêre", "Wêre")
        for behind in ("", ",", ".", "!", ";)", "$$$", "2")
    )
    ids, sizes = word_ids.WordIds(counting).encode(pa.array([text, None, text]))
    whole = counting.encode(text, add_special_tokens=False).ids
    assert sizes.tolist() == [len(whole), 0, len(whole)] and ids.tolist() == whole * 2
    assert counting.given < 120 < len(text)


def test_cuts_between_signs_give_the_ids_of_whole_texts(monkeypatch):
    import random

    import pyarrow as pa

    from rankloom.llm import word_ids

    tokenizer = Tokenizer.from_file(R.tokenizer_path())
    texts = [
        "J\u030c H\u0331x T\u0308. j\u030c e\u0301, E\u0301! =\u0338 a=\u0338", "it's IT'S 'Store o'clock ''s 7's é's '\u017f 'é", "a×b é÷ß ÿ",
        "<|ENDOFTEXT|> <|endoftext|> The,End", "<|EndOfText|> The,End", "x<|startoftext|>Y.<|endoftext|>z", "ΑΣ.Α aΣ'b aΣ.b Σb", "İI.İ ıK Åb",
        "“Word” —a— 中A文.b", "\x00a\x1cB\x7f.c\u0085D", None, "", ".", " . ",
    ]
    chance = random.Random(7)
    signs = [*"aAbJjTs0 \t'.,<|>=×éÉßΣİı中—”\u030c\u0338\u0301\u0323\x1c\u0085\u3000", "<|endoftext|>", "<|ENDOFTEXT|>", "'LL"]
    texts += ["".join(chance.choices(signs, k=chance.randint(1, 60))) for _ in range(3000)]
    monkeypatch.setattr(word_ids, "MEMORY_WORDS", 500)
    encoder = word_ids.WordIds(tokenizer)
    assert encoder.by_word and encoder.ends.any()
    for at in range(0, len(texts), 400):
        part = texts[at : at + 400]
        ids, sizes = encoder.encode(pa.array(part, pa.string()))
        whole = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]
        assert sizes.tolist() == [len(w) for w in whole]
        assert ids.tolist() == [i for w in whole for i in w]
