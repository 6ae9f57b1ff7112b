"""Words that begin lines are encoded many to a call, as those within lines, with the library's ids."""

import numpy as np
from public_tokenizers import path

from allelica.llm.token_codec import Encoder


def test_line_starts_are_encoded_together():
    own = Encoder(path("byte_bpe_50k.json"))
    calls, plain = [], own.library
    own.library = own.known.ids = lambda text: calls.append(text) or plain(text)
    texts = ["\n".join(f"Zq{chr(97 + k % 26)}w{k}, then x{j}y." for k in range(40 * j, 40 * j + 40)) for j in range(5)]
    got = own.encode(texts, 2)
    assert len(calls) < 30  # one for each line start before
    for t, raw in zip(texts, got, strict=True):
        assert np.frombuffer(raw, own.width).tolist() == [*own.tokenizer.encode(t, add_special_tokens=False).ids, 2]
