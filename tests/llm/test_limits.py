"""What workers and executors keep between pieces of work."""

from itertools import islice, product
from string import ascii_lowercase

import numpy as np
import public_tokenizers
import pytest

from fissure.llm.encoding import LETTER_BYTES, OTHER_BYTES, Encoder


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_makes_each_of_many_words_once(name):
    encoder, made = Encoder(public_tokenizers.path(name)), []
    running = encoder._running
    encoder._running = lambda stems: made.extend(stems) or running(stems)
    words = ["".join(w) for w in islice(product(ascii_lowercase, repeat=5), 0, 3_000_000, 25)]
    texts = [" ".join(words[i : i + 1000]) + "." for i in range(0, len(words), 1000)]
    for _ in range(2):
        ids = encoder.encode(texts)
    assert len(made) == len(set(made)) == len(words)
    plain = encoder.tokenizer.encode_batch_fast(texts[:5], add_special_tokens=False)
    assert ids[:5] == [np.array(x.ids, "<u4").tobytes() for x in plain]


def test_encoder_forgets_within_its_bounds():
    """Far more words than fit, some of them again and again, with marks and odd pieces: ids stay right, memory bounded."""
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.letters.most, encoder.others.most = 2000, 1000
    words = ["".join(w) for w in islice(product(ascii_lowercase, repeat=4), 0, 400_000, 400)]
    texts = [f"The é{w}, of {w}! {i} \"{w}\"\n{w}s; the" for i, w in enumerate(words)] + ["", " x ", None]
    for at in range(0, len(texts), 40):
        some = texts[at : at + 40]
        plain = encoder.tokenizer.encode_batch_fast([t or "" for t in some], add_special_tokens=False)
        assert encoder.encode(some) == [np.array(x.ids, "<u4").tobytes() for x in plain]
        assert encoder.letters.young.bytes() <= 2000 and encoder.others.young.bytes() <= 1000
    assert LETTER_BYTES + OTHER_BYTES <= 38_000_000


def test_stages_begin_with_a_collection(spark):
    import corpus_pipeline
    from fissure.llm.shared import table

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    corpus_pipeline.pack(spark, table(spark, "/root/testdata/sf0.001", "documents"), "/root/testdata/sf0.001")
    assert full() > before
