import numpy as np

from drawpool.llm import language_mixture as lm


def test_result_depends_on_the_own_text_alone():
    """A document whose best set has three languages but that does not gain at
    two gets it whatever other documents are in its block."""
    for seed in range(2000):
        rng = np.random.default_rng(seed)
        model = np.full((lm.BUCKETS, 4), 1e-6)
        model[:12] = rng.dirichlet(np.full(12, 0.3), 4).T + 1e-4
        share = np.append(rng.dirichlet(np.full(3, 20.0)), 0)
        odd = rng.choice(12, 40, p=(model[:12] @ share) / (model[:12] @ share).sum())
        two = np.repeat(model[:12, :2].argmax(axis=0), 200)  # gains at two languages
        alone, _ = lm.infer(np.zeros(40, np.int64), odd, 1, model)
        among, _ = lm.infer(np.append(np.zeros(40, np.int64), np.ones(400, np.int64)), np.append(odd, two), 2, model)
        assert np.allclose(alone[0], among[0]), seed
