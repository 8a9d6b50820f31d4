"""Every code point is classed as the tokenizers library classes it."""

import numpy as np
from tokenizers import Tokenizer

from postpulse.llm.bpe import Encoder, load
from postpulse.llm.queries import TOKENIZERS

PATH = f"{TOKENIZERS}/byte_bpe_50k.json"


def test_all_code_points_between_letters_and_before_suffixes():
    library, encoder = Tokenizer.from_file(PATH), Encoder(load(PATH))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for low in range(0, len(points), 6000):
        text = "\n".join(f"a{c}'s 1{c}b!" for c in points[low : low + 6000])
        ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, hex(low)


def test_long_runs_of_disputed_characters():
    library, encoder = Tokenizer.from_file(PATH), Encoder(load(PATH))
    for c in ("՘", "࢏", "౜", "₝", "\U0001e6c0", "\U000323b0", "Ᲊ", "\U000105c0", "\U00010d40"):
        for text in (c * 900, f"ab{c}cd 12{c}34 {c}'s", f"{c} {c}{c}\n{c}é"):
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
