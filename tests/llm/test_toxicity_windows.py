import numpy as np

from webdelta.llm import toxicity


def test_a_text_takes_its_highest_window_wherever_it_starts(monkeypatch):
    monkeypatch.setattr(toxicity, "WINDOW", 8)
    rng = np.random.default_rng(6)
    for n in (0, 1, 7, 8, 9, 30, 31):
        parts = rng.normal(size=n)
        kept = parts * toxicity.fresh(parts)
        want = max(kept[a : a + 8].sum() / 8 for a in range(max(1, n - 7)))
        assert abs(toxicity.window_means(parts).max() - want) < 1e-12
    model = toxicity.Model(np.zeros(toxicity.BUCKETS), -2.0, 1.0, 0.0)
    # Words 7 places apart share a window; a word in front changes nothing.
    words = [f"w{i}" for i in range(40)]
    words[9], words[16] = "stinker", "Xstinkers"
    monkeypatch.setattr(toxicity.Model, "words", lambda self, words: np.array([{"stinker": 4.0, "xstinkers": 3.0}.get(w, 0.0) for w in words]))
    scores = [toxicity.score_texts(model, [" ".join(["more"] * k + words)])[0] for k in range(8)]
    assert np.allclose(scores, 1 / (1 + np.exp(1.125)))


def test_scores_equal_the_definition():
    """Word by word and window by window, without tables, running sums or batches."""
    rng = np.random.default_rng(9)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), 0.3, 1.7, -0.4)
    texts = [None, "", "  ", "one", "one one one", "Ärger in der Straße", "don't 日本 stop-it", " ".join(f"w{rng.integers(30)}" for _ in range(400))]

    def brute(text):
        words, size = toxicity.words_of(text), toxicity.WINDOW
        part = [float(model.parts[toxicity.grams_of([w])[0]].mean()) * (w not in words[max(0, i - size + 1) : i]) for i, w in enumerate(words)]
        best = max(sum(part[a : a + size]) / size for a in range(max(1, len(part) - size + 1)))
        return 1 / (1 + np.exp(-(model.scale * (best + model.bias) + model.shift)))

    assert np.allclose(toxicity.score_texts(model, texts), [brute(t) for t in texts])
