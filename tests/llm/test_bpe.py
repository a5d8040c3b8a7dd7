import hashlib
import random
import tracemalloc

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from attestor.llm import bpe

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def texts():
    rng = random.Random(1)
    made = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéèüñçΣİßœ") for _ in range(n)) for n in [5, 50, 400, 3000] * 8]
    made += ["".join(rng.choice("theaniro") for _ in range(6000)), "a" * 5000, "ab" * 3000, "the" * 2000, "!" * 4000, "-=" * 2000, "1" * 900]
    made += ["<|endoftext|>x <|startoftext|> y<|endoftext|>", "it's we'll 'S I'D \x1c a\x1cb \x85 \xa0 x y  \n\n z ", "", " ", "é ΑΣ ΟΔΟΣ", "😀 漢字 ｆｕｌｌ ²³ Ⅷ ٣"]
    return made


@pytest.mark.parametrize("name", NAMES)
def test_ids_and_text_equal_the_library(name):
    ours, theirs = bpe.load(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    for text in texts():
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert list(ours.encode(text)) == ids, text[:50]
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", NAMES)
def test_stream_equals_whole_with_constant_memory(name):
    merges = bpe.load(public_tokenizers.path(name)).merges
    rng = random.Random(7)
    for letters in ["theanirosdl", "ab", "-=", "!", "ĠĊe"]:
        symbols = [rng.choice(letters) for _ in range(8 * merges.lookahead)]
        assert list(bpe.stream_tokens(symbols, merges)) == merges.apply(list(symbols))
    held = []

    def endless():
        for i in range(200_000):
            held.append(i)
            yield rng.choice("theaniros")

    stream = bpe.stream_tokens(endless(), merges)
    for _ in range(50):
        next(stream)
    assert len(held) <= 2 * merges.lookahead + 2000


def test_lookahead_is_sufficient_for_small_random_lists():
    rng = random.Random(3)
    for _ in range(150):
        tokens, pairs = list("abc"), []
        for _ in range(rng.randint(1, 12)):
            pair = (rng.choice(tokens), rng.choice(tokens))
            if pair not in pairs and pair[0] + pair[1] not in tokens:
                pairs.append(pair)
                tokens.append(pair[0] + pair[1])
        merges = bpe.Merges({p: i for i, p in enumerate(pairs)})
        symbols = rng.choices("abc", k=400)
        assert list(bpe.stream_tokens(symbols, merges)) == merges.apply(list(symbols)), pairs


def test_decoder_gives_text_as_bytes_become_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, theirs = bpe.load(path), Tokenizer.from_file(path)
    ids = theirs.encode("héllo 漢字 😀", add_special_tokens=False).ids
    ours.decoder.reset()
    steps = [ours.decoder.feed(i) for i in ids]
    assert "".join(steps) + ours.decoder.finish() == "héllo 漢字 😀" and "�" not in "".join(steps)
    assert ours.decode(ids[:-1]).endswith("�") and ours.decode([]) == ""


@pytest.mark.parametrize("name", NAMES)
def test_digests_and_columns(spark, name):
    path = public_tokenizers.path(name)
    theirs = Tokenizer.from_file(path)
    given = [None, *texts(), "x", "x"]
    docs = spark.createDataFrame([(i % 40, t, [1]) for i, t in enumerate(given)], "doc_id long, text string, ids array<int>")
    found = sorted((r.id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, path).collect())
    want = []
    for i, t in enumerate(given):
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        spelled, text = " ".join(map(str, ids)), theirs.decode(ids, skip_special_tokens=False)
        want.append((i % 40, len(ids), hashlib.sha256(spelled.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert found == sorted(want)
    back = bpe.decode(bpe.encode(docs, path), path)
    assert back.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted(r.decoded for r in back.collect()) == sorted(theirs.decode(theirs.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for t in given)
    assert bpe.digests(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("window", [3, 40])
def test_windows_change_nothing(monkeypatch, name, window):
    monkeypatch.setattr(bpe, "WINDOW", window)
    ours, theirs = bpe.load(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    rng = random.Random(11)
    signs = ["a", "the", "É", "e\u0301", "\u0301", " ", "  ", "\n", " \u0301", "12", "'s", "'", "٣", "!", "漢", "Σ", "\x1c", "\u2028", "<|endoftext|>", "\u1100", "\u1161", "İ"]
    for _ in range(400):
        text = "".join(rng.choices(signs, k=rng.randint(1, 60)))
        assert list(ours.encode(text)) == theirs.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("unit", ["thea", "the a ", "漢字", "x1"])
def test_digests_hold_little_besides_the_text(unit):
    digests = bpe._load_digests(public_tokenizers.path("word_bpe_49k.json"))
    text = unit * (200_000 // len(unit))
    digests.digest(unit * 1000)
    tracemalloc.start()
    digests.digest(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(text.encode()) + 1_500_000  # lists of all pieces or ids would take ten times the text and more
