"""A stretch whose coverage reaches the least is reported however few distinct words it keeps."""

import collections

from voluma.llm import licenses


def test_single_words_replaced():
    words = licenses.words_of(licenses.TEMPLATES[8][2])
    ones = [w for w, n in collections.Counter(words).items() if n == 1 and w not in (b"sublicense", words[0])][:13]
    text = b" ".join(b"zz%d" % ones.index(w) if w in ones else w for w in words).decode()
    (found,) = [x for x in licenses.Scanner().scan(text) if x[0] == "MIT"]
    assert found[4] == 54 and found[5] >= 0.8
