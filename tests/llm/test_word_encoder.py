"""The encoder of op2: what it encodes once, what it keeps, and ids equal to the library's for odd characters."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from duskwatch.llm import tokenfile

PIECES = ["a", "B", "é", "ɏ", "ɐ", "ß", "ª", "ж", "中", "🙂", "́", "1", "٣", "½", ",", ".", "'", "'s", "'ll", "(", "-", "_", "¿", "—", "×", " ", " ", "  ", "\n", "\n"]
PIECES += ["\n\n", "\r\n", "\t", "\v", "\x1c", "\x85", "\xa0", " ", "᠎", " ", " ", "​", "　", "\0", "<|endoftext|>", " the", " tion", "Ġ", "Ċ"]


def vocabulary():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def odd_texts(n, seed=1, without=()):
    rng = random.Random(seed)
    pieces = [p for p in PIECES if p not in without]
    return ["".join(rng.choices(pieces, k=rng.randrange(14))) for _ in range(n)]


def library_ids(rules, texts, added=True):
    library = Tokenizer.from_str(rules)
    library.encode_special_tokens = not added
    return [np.array(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]


@pytest.mark.parametrize("added", [True, False])
@pytest.mark.parametrize("without", [(), ("\0", "<|endoftext|>", "  ")])
def test_ids_equal_the_library_for_odd_characters(added, without):
    texts = odd_texts(6000, without=without)
    rules = vocabulary()
    words = tokenfile.WordEncoder(rules, added)
    for size in (1, 50, 6000):
        some = texts[: 200 * size]
        got = [ids for a in range(0, len(some), size) for ids in words.encode(some[a : a + size])]
        assert got == library_ids(rules, some, added)


def test_ids_equal_the_library_if_no_byte_level_pattern_cuts():
    rules = json.loads(vocabulary())
    rules["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [rules["pre_tokenizer"]]}
    texts = odd_texts(500)
    assert list(tokenfile.WordEncoder(json.dumps(rules), True).encode(texts)) == library_ids(json.dumps(rules), texts)


def test_a_word_is_encoded_once_whatever_marks_stand_beside_it(monkeypatch):
    learned = []
    learn = tokenfile.WordEncoder.learn
    monkeypatch.setattr(tokenfile.WordEncoder, "learn", lambda self, words: (learned.extend(words), learn(self, words))[1])
    text = " word, word. word; word\n word's word"
    words = tokenfile.WordEncoder(vocabulary(), True)
    assert list(words.encode([text])) == library_ids(vocabulary(), [text])
    assert sum("word" in w for w in learned) == 1


def test_a_worker_keeps_its_words_between_tasks(monkeypatch):
    tokenfile.encoder.cache_clear()
    first = tokenfile.encoder(vocabulary(), True)
    list(first.encode(["some words", "words"]))
    again = tokenfile.encoder(vocabulary(), True)
    monkeypatch.setattr(again, "learn", lambda words: pytest.fail(f"learns {words}") if words else None)
    assert list(again.encode(["words words", "some"])) == library_ids(vocabulary(), ["words words", "some"])
    tokenfile.encoder.cache_clear()


def test_what_is_remembered_is_bounded_and_ids_stay_right(monkeypatch):
    monkeypatch.setattr(tokenfile, "REMEMBER", 40)
    words = tokenfile.WordEncoder(vocabulary(), True)
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(15)) for i in range(200)]
    got = []
    for text in texts:
        got += words.encode([text])
        assert len(words.known) + len(words.older) <= 40
    assert got == library_ids(vocabulary(), texts)
