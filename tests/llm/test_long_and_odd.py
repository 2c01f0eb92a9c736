"""Letters that normal forms take apart, and long texts without spaces or with context words only."""

import random
import time

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from paperweave.llm import secrets, toxicity
from paperweave.llm.packing import WordCoder


def test_word_ids_of_odd_letters():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        content = file.read()
    coder, library = WordCoder(content), Tokenizer.from_str(content)
    draw = random.Random(3)
    letters = "abZÉéàß.,,..'- \n  ज़ड़ढ़य़ΣσςİıſﬁÅΑΆשׁ日本0١½_ªºǅʰ़́̇\t"
    texts = ["पेड़,", "ΑΣİ,", *["".join(draw.choice(letters) for _ in range(draw.randrange(14))) for _ in range(20_000)]]
    for text, packed in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_long_texts_take_linear_time():
    start = time.time()
    assert secrets.find_spans("token ok " * 111_111) == []
    assert not toxicity.is_odd("日本語文" * 250_000) and not toxicity.is_odd("ab" * 500_000)
    assert toxicity.is_odd("ab" * 500_000 + "." + "a")
    assert time.time() - start < 10


def test_a_run_beyond_the_window_is_whole():
    run = "".join(random.Random(4).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=300))
    spans = secrets.find_spans(f"credential: {run} and more")
    assert [(a, b) for a, b, _ in spans] == [(12, 12 + len(run))]
