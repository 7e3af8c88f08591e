"""Gradient steps as pure functions: (theta, gradient at a point, state) to (theta, state).

Each optimizer says at which point it wants the gradient (Nesterov's look ahead), so the caller computes it, for
example as one Spark aggregate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

NAMES = ("sgd", "momentum", "nesterov", "adagrad", "rmsprop", "adadelta", "adam", "adamax", "nadam")


@dataclass
class Optimizer:
    """name is one of NAMES. momentum is the share of the last step that stays; decay_1 and decay_2 those of the
    running means of the gradient and of its square."""

    name: str = "sgd"
    rate: float = 0.01
    momentum: float = 0.9
    decay_1: float = 0.9
    decay_2: float = 0.999
    tiny: float = 1e-8
    state: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.name not in NAMES:
            raise ValueError(f"optimizers are {NAMES}")

    def point(self, theta: np.ndarray) -> np.ndarray:
        """Where the next gradient is taken."""
        return theta + self.momentum * self.state.get("v", 0.0) if self.name == "nesterov" else theta

    def step(self, theta: np.ndarray, g: np.ndarray) -> np.ndarray:
        s = self.state
        t = s["t"] = s.get("t", 0) + 1
        zero = np.zeros_like(theta, dtype=float)
        if self.name == "sgd":
            return theta - self.rate * g
        if self.name in ("momentum", "nesterov"):
            s["v"] = self.momentum * s.get("v", zero) - self.rate * g
            return theta + s["v"]
        if self.name == "adagrad":
            s["n"] = s.get("n", zero) + g * g
            return theta - self.rate * g / (np.sqrt(s["n"]) + self.tiny)
        if self.name == "rmsprop":
            s["n"] = self.decay_1 * s.get("n", zero) + (1 - self.decay_1) * g * g
            return theta - self.rate * g / (np.sqrt(s["n"]) + self.tiny)
        if self.name == "adadelta":
            s["n"] = self.decay_1 * s.get("n", zero) + (1 - self.decay_1) * g * g
            move = -np.sqrt(s.get("d", zero) + self.tiny) / np.sqrt(s["n"] + self.tiny) * g
            s["d"] = self.decay_1 * s.get("d", zero) + (1 - self.decay_1) * move * move
            return theta + move
        s["m"] = self.decay_1 * s.get("m", zero) + (1 - self.decay_1) * g
        mean = s["m"] / (1 - self.decay_1**t)
        if self.name == "adamax":
            s["n"] = np.maximum(self.decay_2 * s.get("n", zero), np.abs(g))
            return theta - self.rate * mean / (s["n"] + self.tiny)
        s["n"] = self.decay_2 * s.get("n", zero) + (1 - self.decay_2) * g * g
        spread = np.sqrt(s["n"] / (1 - self.decay_2**t)) + self.tiny
        if self.name == "nadam":
            mean = self.decay_1 * mean + (1 - self.decay_1) * g / (1 - self.decay_1**t)
        return theta - self.rate * mean / spread


def minimise(gradient: Callable[[np.ndarray], np.ndarray], theta: np.ndarray, how: Optimizer, steps: int = 100, stop: float = 0.0) -> list[np.ndarray]:
    """The points passed, from the start on; ends early once a step is shorter than `stop`."""
    path = [np.asarray(theta, float)]
    for _ in range(steps):
        path.append(how.step(path[-1], gradient(how.point(path[-1]))))
        if not np.isfinite(path[-1]).all() or np.linalg.norm(path[-1] - path[-2]) < stop:
            break
    return path
