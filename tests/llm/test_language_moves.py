"""Expected transitions of the language model against enumeration, finite differences and the plain recursion."""

import itertools

import numpy as np

from assayer.llm import language


def path_weights(s, t):
    for path in itertools.product(range(s.shape[1]), repeat=len(s)):
        yield path, np.exp(sum(s[k, y] for k, y in enumerate(path)) + sum(t[a, b] for a, b in itertools.pairwise(path)))


def log_partition(s, t, lengths):
    ends = np.cumsum(lengths)
    return sum(np.log(sum(w for _, w in path_weights(s[e - n : e], t))) for n, e in zip(lengths, ends, strict=True) if n)


def test_moves_equal_enumeration_and_differences():
    rng = np.random.default_rng(1)
    t, lengths = np.eye(3) * 2.5 + rng.normal(size=(3, 3)), [1, 6, 0, 5]
    s = rng.normal(size=(12, 3))
    got = np.zeros((3, 3))
    language.forward_backward(s, t, lengths, got)
    want, at = np.zeros((3, 3)), 0
    for n in lengths:
        found = list(path_weights(s[at : at + n], t))
        z = sum(w for _, w in found)
        for path, w in found:
            for a, b in itertools.pairwise(path):
                want[a, b] += w / z
        at += n
    assert np.allclose(got, want) and np.isclose(got.sum(), 9)
    for i, j in itertools.product(range(3), repeat=2):
        step = np.zeros((3, 3))
        step[i, j] = 1e-5
        slope = (log_partition(s, t + step, lengths) - log_partition(s, t - step, lengths)) / 2e-5
        assert np.isclose(got[i, j], slope, atol=1e-6)


def test_moves_across_blocks():
    rng = np.random.default_rng(2)
    t, s = rng.normal(size=(4, 4)), rng.normal(size=(3 * language.STEP + 5, 4))
    n = len(s)
    alpha, beta = np.zeros_like(s), np.ones_like(s)
    alpha[0] = np.exp(s[0])
    for k in range(1, n):
        alpha[k] = alpha[k - 1] @ np.exp(t) * np.exp(s[k])
        alpha[k] /= alpha[k].sum()
    for k in range(n - 2, -1, -1):
        beta[k] = np.exp(t) @ (np.exp(s[k + 1]) * beta[k + 1])
        beta[k] /= beta[k].sum()
    want = np.zeros((4, 4))
    for k in range(1, n):
        pair = alpha[k - 1][:, None] * np.exp(t) * (np.exp(s[k]) * beta[k])[None, :]
        want += pair / pair.sum()
    got = np.zeros((4, 4))
    language.forward_backward(s, t, [n], got)
    assert np.allclose(got, want)


def test_code_switched_words_get_their_language():
    """Held-out sequences of two languages that share a third of their words: nine tenths of the words at least are right."""
    rng = np.random.default_rng(3)
    shared = [f"mo{k}ta" for k in "abcdefgh"]
    own = {"aa": [f"{k}{x}ing" for k in "bdfgklmprt" for x in "aei"], "bb": [f"{k}{x}nung" for k in "bdfgklmprt" for x in "aou"]}

    def stretch(lang, n):
        return [str(rng.choice(shared if rng.random() < 1 / 3 else own[lang])) for _ in range(n)]

    model = language.train([(" ".join(stretch(lang, 60)), lang) for _ in range(100) for lang in ("aa", "bb")])
    right = total = 0
    for _ in range(200):
        first, second = rng.permutation(["aa", "bb"])
        words, gold = stretch(first, 10) + stretch(second, 10), [first] * 10 + [second] * 10
        p, _ = language.labelled_words([words], language.WordTable(model))
        right += sum(model.labels[k] == y for k, y in zip(p.argmax(axis=1), gold, strict=True))
        total += len(words)
    assert right / total >= 0.9, right / total
