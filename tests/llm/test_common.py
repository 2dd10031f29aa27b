import numpy as np
from loomseq.llm.common import viterbi


def test_long_sequences_keep_small_differences():
    """At sums of 1e9 single precision steps by 64; a difference of 1 a position must still outweigh the switch."""
    n = 1000
    emit = np.full((n, 2), -1e6, np.float32)
    emit[: n // 2, 1] -= 1
    emit[n // 2 :, 0] -= 1
    trans = (np.eye(2, dtype=np.float32) - 1) * 12
    assert viterbi(emit, np.array([n]), trans).tolist() == [0] * (n // 2) + [1] * (n // 2)
    assert viterbi(emit, np.array([n]), 12.0).tolist() == [0] * (n // 2) + [1] * (n // 2)


def test_penalty_equals_matrix_for_hundreds_of_states():
    rng = np.random.default_rng(3)
    lengths = np.array([5, 0, 40, 1, 17])
    emit = rng.normal(size=(lengths.sum(), 300)).astype(np.float32) * 6
    emit[:5, 299] += 90
    trans = (np.eye(300, dtype=np.float32) - 1) * 12
    got = viterbi(emit, lengths, 12.0)
    assert got.tolist() == viterbi(emit, lengths, trans).tolist() and set(got[:5]) == {299}
