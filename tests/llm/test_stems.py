"""Misspelt beginnings of words that the lexicon holds as stems."""

import numpy as np
from parley.llm import toxicity
from test_models import edits


def test_automaton_finds_stems_one_edit_away():
    rng = np.random.default_rng(6)
    words = sorted({"".join(rng.choice(list("abcd"), rng.integers(3, 10))) for _ in range(500)})
    terms = [w[:7] + "*" if i % 2 else w for i, w in enumerate(words[::12])]
    trie = toxicity.Trie(terms)

    def close(token, term):
        if term[-1] != "*":
            return edits(token, term) <= 1
        return any(edits(token[:i], term[:-1]) <= 1 for i in range(len(token) + 1))

    assert [trie.near(t) for t in words] == [next((n for n, term in enumerate(terms) if close(t, term)), None) for t in words]


def test_misspelt_form_of_a_stem_is_a_hit():
    m = toxicity.Matcher(["moron*"], [3.0])
    fuzzy = toxicity.FEATURES.index("fuzzy")
    assert m.features("quite mroonic")[fuzzy] == 0 and m.features("quite mironically")[fuzzy] > 0 and m.features("quite moroonic")[fuzzy] > 0
