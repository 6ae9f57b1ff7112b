"""Words of letters go to the library without its search for words, and get the ids that it gives to whole texts."""

import numpy as np
from public_tokenizers import path

from allelica.llm.token_codec import Encoder


def test_words_of_letters_are_not_searched_for_words():
    own = Encoder(path("byte_bpe_50k.json"))
    calls, plain = [], own.library
    own.library = own.known.ids = lambda text: calls.append(text) or plain(text)
    texts = ["0 " + " ".join(f"Wörd{chr(97 + k % 26)}x{'lm'[k % 2]} été, Ünï日本? it's we'll ǅab ª a1b{k} ٣٤" for k in range(30)), "one\ntwo three.\nfour, ²x ⅷ"]
    got = own.encode(texts, 2)
    for t, raw in zip(texts, got, strict=True):
        assert np.frombuffer(raw, own.width).tolist() == [*own.tokenizer.encode(t, add_special_tokens=False).ids, 2]
    assert not any("Wörd" in t for t in calls) and any("a1b" in t for t in calls)
