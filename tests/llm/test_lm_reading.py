"""What a scoring task keeps of a text."""

from collections import Counter

import numpy as np

from churnlens.llm import lm_scoring as lm


def test_a_text_is_read_to_ids_and_rare_words_only():
    words = [(lm.END, 9), *[(b"w%d" % i, 2) for i in range(3000)]]
    tails = np.zeros((lm.TAILS, 2), np.int64)
    for w, c in words:
        tails[lm.tail_of(w)] += (c, 1)
    v = lm.Vocabulary(words, 6009, 3001, tails)
    text = b"W1 w2999 w7 rare w2999 Rare  odd\n" + b"w5 " * 1000
    ids, known, logs, in_tail, rare = lm.read(v, text)
    own = lm.tokens(text)
    want, rank = v.encode(own)
    assert ids.tolist() == want.tolist() and known == len(own) - 3 and rare == Counter({b"rare": 2, b"odd": 1})
    assert np.isclose(logs, sum(np.log10(dict(words)[w] + 0.5) for w in own if w in dict(words)))
    assert np.isclose(in_tail, 2 * np.log10(2.5)) and v.words < 2999
    assert lm.read(v, b"")[0].tolist() == [0]
