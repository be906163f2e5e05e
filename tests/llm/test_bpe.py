"""Encoding and decoding against the tokenizers library, and exact round trips."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from riskweave.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
CODEC = bpe.load(PATH)
THEIRS = tokenizers.Tokenizer.from_file(PATH)


def same(text):
    want = THEIRS.encode(text, add_special_tokens=False).ids
    assert CODEC.encode(text) == want
    assert CODEC.decode(want) == THEIRS.decode(want, skip_special_tokens=False) == text
    names, back = CODEC.round_trip(text)
    assert names == ",".join(map(str, want)) and back == text


@pytest.mark.parametrize("text", [
    "", " ", "  a", "a  ", "\n\n x\t\ty", "it's we'll I'D you've", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoft",
    "x" * 3000, "ab" * 2000, "été Straße ñandú 你好 🙂🙂", "1234567 ١٢٣ ⅷ²", "\x00\x1c\x1d\x1e\x1f\x85\xa0 ​ a",
    "é क्षि", "!!!???...---===", "a\r\nb", "　wide", "ſ 's 'S"])
def test_cases(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab th'sreinlgd  \n\t.,!é1漢<|>", max_size=120))
def test_dense_text(text):
    same(text)


def test_every_letter_class():
    for block in range(0, 0x3100, 64):
        same("a" + " ".join(chr(c) + "b" for c in range(block, block + 64) if not 0xD800 <= c < 0xE000))


def test_forced_cuts_and_long_merges():
    inside = {t[i:i + 2] for k, t in CODEC.bytes_of.items() if k not in CODEC.added.values() for i in range(len(t) - 1)}
    for a in range(0, 256, 5):
        for b in range(0, 256, 3):
            assert (CODEC.pairs[a << 8 | b] == bpe.FORCED) == (bytes([a, b]) not in inside)
    same("théâtre漢字" * 9)
    word = b"thereinafter" * 20
    ids = [CODEC.first[b] for b in word]
    best = [CODEC.pairs[a << 8 | b] for a, b in zip(word, word[1:])]
    assert CODEC._merge_long(list(ids)) == CODEC._merge_short(list(ids), best)


def wide(shift):
    """The vocabulary file with every id moved up."""
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["vocab"] = {k: i + shift for k, i in spec["model"]["vocab"].items()}
    for t in spec["added_tokens"]:
        t["id"] += shift
    return spec


def test_ids_beyond_16_bits():
    spec = wide(3_000_000)
    codec = bpe.Codec(spec)
    for text in ("it's a théâtre 漢字 <|endoftext|> thereinafter " * 3, "ab" * 400, "x" * 100):
        ids = [i + 3_000_000 for i in CODEC.encode(text)]
        assert codec.encode(text) == ids and codec.decode(ids) == text
        assert codec.round_trip(text) == (",".join(map(str, ids)), text)


@pytest.mark.parametrize("change", [
    lambda s: s.update(normalizer={"type": "NFC"}), lambda s: s["pre_tokenizer"].update(add_prefix_space=True),
    lambda s: s.update(pre_tokenizer={"type": "Whitespace"}), lambda s: s["model"].update(ignore_merges=True),
    lambda s: s["model"].update(byte_fallback=True), lambda s: s["added_tokens"][0].update(lstrip=True),
    lambda s: s.update(pre_tokenizer=None), lambda s: s["model"].update(type="WordPiece")])
def test_files_that_ask_for_more_are_refused(tmp_path, change):
    spec = wide(0)
    change(spec)
    (tmp_path / "v.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        bpe.load(str(tmp_path / "v.json"))


def test_table_limit(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_LIMIT", 3)
    c = bpe.load(PATH)
    text = "one two three four five six seven one two"
    assert c.round_trip(text) == CODEC.round_trip(text) and len(c.pieces) <= 3 and len(c.older) <= 3


def test_table_stays_small():
    import tracemalloc
    c = bpe.load(PATH)
    text = "".join(f" {k:05d}q" for k in range(20_000)).translate(str.maketrans("0123456789", "abcdefghij"))
    tracemalloc.start()
    c.round_trip(text)
    held = tracemalloc.get_traced_memory()[0] / len(c.pieces)
    tracemalloc.stop()
    assert len(c.pieces) == 20_000 and held * 2 * bpe.TABLE_LIMIT < 90e6


def test_pieces_that_decode_to_other_bytes():
    c = bpe.load(PATH)
    (i,) = c.encode(" the")
    c.bytes_of[i] = b"<the>"
    for text in (" the cat the", " the", "no such piece", " the<|endoftext|> the"):
        assert c.round_trip(text) == (",".join(map(str, c.encode(text))), c.decode(c.encode(text)))
        assert " the" not in c.pieces and not c.odd


def test_report(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (3, "again"), (None, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "'z' as ids")
    got = {(r["doc_id"], r["n_tokens"]): r for r in bpe.round_trip_report(df, CODEC).collect()}
    assert len(got) == 5
    for i, t in rows:
        ids = THEIRS.encode(t or "", add_special_tokens=False).ids
        r = got[i, len(ids)]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    full = {r["doc_id"]: r for r in bpe.encode(df.filter("doc_id = 1"), CODEC).collect()}
    assert full[1]["decoded"] == "Hello world"
    assert bpe.round_trip_report(df.limit(0), CODEC).collect() == []
