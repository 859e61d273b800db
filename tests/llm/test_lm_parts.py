"""The numerics of the language model."""

import numpy as np

from pagewake.llm import lm_score

RNG = np.random.default_rng(4)


def test_softmax_is_exact_for_scores_that_lie_far_apart():
    h1 = np.concatenate([RNG.normal(0, 1, (3000, 24)), np.ones((3000, 1))], 1).astype(np.float32)
    h1[::7, :-1] *= 30  # scores of some hundreds
    table = RNG.normal(0, 1, (40, 25)).astype(np.float32)
    at = RNG.integers(0, 40, 3000)
    scores = h1.astype(np.float64) @ table.T.astype(np.float64)
    top = scores.max(1)
    want = scores[np.arange(3000), at] - top - np.log(np.exp(scores - top[:, None]).sum(1))
    assert np.abs(lm_score.log_softmax_at(h1, table, at) - want).max() < 2e-3
    assert np.abs(lm_score.log_softmax_at(h1[1:7], table, at[1:7]) - want[1:7]).max() < 1e-5


def test_a_step_takes_no_logarithms_of_the_whole_vocabulary(monkeypatch):
    shape = lm_score.Shape(2000)
    frequency = np.full(shape.predicted, 1 / shape.predicted)
    trainer = lm_score.Trainer(shape, lm_score.initial(shape, frequency), frequency, 1)
    taken = []
    monkeypatch.setattr(np, "log", lambda x, *a, real=np.log, **b: taken.append(np.size(x)) or real(x, *a, **b))
    before = trainer.flat.copy()
    trainer.learn(np.array([shape.start, shape.start, *RNG.integers(0, shape.end, 500), shape.end]))
    assert not taken and (trainer.flat != before).any()
