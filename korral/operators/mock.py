"""A mock generation backend with known solve rates and the pathologies that grading must survive."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd

SCHEMA = "sample_uid string, model_key string, dataset_key string, variant string, sampling_id string, problem_idx bigint, problem_uid string, sample_idx bigint, seed bigint, text string, n_completion_tokens bigint, finish_reason string"
#: The shape of the latent solve rates and the rl arm's lift.
ALPHA, BETA, LIFT, CAP = 0.8, 2.0, 0.18, 0.98


def solve_rate(problem_uid: str, rl: bool) -> float:
    """The latent rate of a problem, a function of its identity alone."""
    p = float(np.random.default_rng(int(hashlib.sha256(problem_uid.encode()).hexdigest()[:16], 16)).beta(ALPHA, BETA))
    return min(CAP, p + LIFT * (1 - p)) if rl else p


def backend(dirty: bool = True):
    """A batch function for ``planning.generate``: each sample depends on its own seed only."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        rates: dict[tuple[str, bool], float] = {}
        texts, tokens, reasons = [], [], []
        for r in batch.itertuples():
            rl = r.model_key.startswith("rl")
            rate = rates.setdefault((r.problem_uid, rl), solve_rate(r.problem_uid, rl))
            rng = np.random.default_rng(int(r.seed))
            hit = rng.random() < rate
            n = int(rng.lognormal(5.5 + 0.6 * rl, 0.4)) + 1
            answer = r.answer if hit else str(int(rng.integers(0, 1000)) + 1000)
            text, reason, u = f"Working it through.\nThe final answer is \\boxed{{{answer}}}.", "stop", rng.random()
            if dirty and u < 0.04:  # cut off inside the box
                text, reason = f"Working it through.\nSo \\boxed{{{answer[:1]}", "length"
            elif dirty and u < 0.06:  # repeats itself
                text, reason = "and so on, again and again, to the limit. " * 40, "length"
            elif dirty and u < 0.08:  # a guess without reasoning
                text = f"\\boxed{{{int(rng.integers(0, 1000))}}}"
            elif dirty and u < 0.10:  # two boxes
                text += f" Or \\boxed{{{answer}}}?"
            texts.append(text)
            tokens.append(n)
            reasons.append(reason)
        cols = ["sample_uid", "model_key", "dataset_key", "variant", "sampling_id", "problem_idx", "problem_uid", "sample_idx", "seed"]
        return batch[cols].assign(text=texts, n_completion_tokens=tokens, finish_reason=reasons)

    return run
