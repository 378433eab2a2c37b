import zlib

import numpy as np
import pytest

from portflow.llm import simple8b as S
from portflow.llm.tokens import WordMemoEncoder, default_vocabulary, encoder


@pytest.mark.parametrize("seed", range(6))
def test_pack_round_trip_with_escapes(seed):
    g = np.random.default_rng(seed)
    v = (g.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) >> g.integers(0, 64, 5000).astype(np.uint64)
    v[g.integers(0, 5000, 20)] = np.uint64((14 << 60) + 5)  # a raw word that looks like an escape
    v[100:400] = 0
    words = S.pack(v)
    assert np.array_equal(S.unpack(words, len(v)), v)
    assert len(S.pack(np.zeros(600, np.uint64))) == 10
    assert len(S.pack(v[:0])) == 0


def test_blocks_round_trip():
    docs = [np.arange(k, dtype="<u4").tobytes() for k in (0, 1, 7, 50_000, 0, 3)]
    assert S.read_block(S.write_block(docs)) == docs
    with pytest.raises(ValueError):
        S.read_block(b"x" * 64)


HARD = ["", None, "  a\n\n b'll ½ ²x <|endoftext|> 　漢字  x\t\ty\r\n z", "\n", " ", "\x85a\x1cb c ​ d",
        "x́é—“q” 😀 👍🏽­a² 3½ l'été don't I'M", "word " * 30_000]


def test_memo_encoder_is_the_library():
    e = encoder(default_vocabulary())
    for t in HARD:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.tok.encode(t or "", add_special_tokens=False).ids


def test_write_and_read(spark):
    rows = [(5, HARD[2]), (None, "null id"), (3, None), (3, "again"), (3, "again"), (-4, ""), (9, HARD[-1])]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, start string, shard int").repartition(3)
    got = S.read_ids(S.write_ids(df)).orderBy("start").collect()
    tok = encoder(default_vocabulary()).tok
    want = sorted((i is not None, i or 0, np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for i, t in rows)
    assert [r.doc_id for r in got] == [i if k else None for k, i, _ in want]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(b) // 4, zlib.crc32(b)) for _, _, b in want)
    assert S.read_ids(S.write_ids(df.limit(0))).count() == 0


def test_added_tokens_are_those_of_a_fresh_tokenizer():
    from tokenizers import Tokenizer

    path = default_vocabulary()
    fresh, e = Tokenizer.from_file(path), encoder(path)
    for t in ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>\n", "<|endoftext", *HARD]:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == fresh.encode(t or "", add_special_tokens=False).ids
    assert np.frombuffer(e.encode("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]


def test_pieces_reach_the_merges_in_the_byte_level_alphabet():
    from tokenizers import Tokenizer

    path = default_vocabulary()
    tok, enc = Tokenizer.from_file(path), WordMemoEncoder(path, memo=3)
    for t in ("a b  c", " ~!x", "tab\tand\x7f\x00\x1f", "line\n\n  end ", "ü b", "a\xa0b", "   "):
        assert enc.encode(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_the_files_encoder_remembers_the_pieces_of_a_long_corpus():
    from portflow.llm.tokens import WordMemoEncoder

    e = WordMemoEncoder(default_vocabulary())
    memo, merged = e.get.__self__, []
    merge = memo.merge
    memo.merge = lambda piece: merged.append(piece) or merge(piece)
    text = "".join(f" {a}x{b}" for a in range(300) for b in "abcdefghij") + "".join(f" w{'abcdefghij'[i % 10] * (i // 10 % 9 + 1)}" for i in range(90))
    many = [f" {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576 % 26)}q" for i in range(300_000)]
    first = [e.encode(text), *map(e.encode, many)]
    seen = len(merged)
    assert [e.encode(text), *map(e.encode, many)] == first
    assert len(merged) == seen  # none is merged again


def test_words_tried_first_are_split_as_by_the_whole_pattern():
    import regex

    from portflow.llm.tokens import PATTERN, WordMemoEncoder

    e = WordMemoEncoder(default_vocabulary())
    for t in ("I'll don't 'tis ''s 're 12's x'm'd  'vex", " 'sa 's 12'll\n\n 'd é'é", "a'b 'S'T  1a a1 --'s ", "l'été «x» 'ß"):
        assert e.plain(t) == regex.findall(PATTERN, t)
