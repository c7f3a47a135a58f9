import pytest

from webdelta.llm import minhash


def test_bands_follow_the_threshold():
    assert minhash.bands_for(0.85) == (5, 20) and minhash.bands_for(0.8) == (4, 25) and minhash.bands_for(0.95) == (5, 20)
    for t in (0.15, 0.3, 0.5, 0.6, 0.7):
        rows, bands = minhash.bands_for(t)
        assert (1 - t**rows) ** bands <= 1e-5
    with pytest.raises(ValueError):
        minhash.bands_for(0.1)
