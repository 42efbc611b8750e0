"""Words in disguise: the same as the pattern finds, and long words without digits or symbols cost little."""

import random
import re
import time

from sentrymill.llm import toxicity


def test_all_and_only_what_the_pattern_finds():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1é²٣_ @$!|*9Z·\ud8007ßあ") for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    for t in [*texts, "7up @@you_1a _a1_", "x" * 50 + "1" + "y" * 50, "9a 99bb a9 b9c9!!"]:
        assert toxicity.disguised(t) == toxicity.DISGUISED.findall(t)


def test_a_long_word_costs_no_square_of_its_length():
    at = time.process_time()
    toxicity.features("a" * 200_000 + " b1", {})
    assert time.process_time() - at < 2


def test_capitals_are_those_of_the_pattern():
    t = "".join(map(chr, range(0x3000))) + "\ud800"
    assert round(toxicity.features(t, {})[8] * sum(map(len, toxicity.WORD.findall(t.lower())))) == len(re.findall(r"[A-ZÀ-ÖØ-Þ]", t))


def test_kept_weights_change_no_feature(monkeypatch):
    lexicon, known = {"=idiot": 3.0, "idio-": 2.5, "bad": 2.0}, {}
    monkeypatch.setattr(toxicity, "KNOWN", 2)
    for t in ("you idiot, you", "bad BAD 1d1ot idiocy", None, "fine words only here", "idiot bad"):
        assert toxicity.features(t, lexicon, known) == toxicity.features(t, lexicon)
