"""Scoring models. Each works on a (rows x features) matrix inside a task.

A model is anything with ``features`` (column names in input order) and ``proba(x)`` returning
p(class 1) per row; ``gradient(x)`` is needed only by the gradient-guided searches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterfair.functions.scalar import fixed, q, sum_columns

PROBABILITY_DIGITS = 9
# Gradients are used by sign; sums that cancel must not leave one.
GRADIENT_DIGITS = 12


def fixed_np(values: np.ndarray, digits: int = PROBABILITY_DIGITS) -> np.ndarray:
    scale = float(10**digits)
    return np.floor(values * scale + 0.5) / scale


@dataclass(frozen=True)
class LogisticModel:
    """One linear layer; also available as a plain Column expression."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float

    def logit_column(self) -> Column:
        terms = [q(f).cast("double") * F.lit(w) for f, w in zip(self.features, self.weights)]
        return sum_columns([F.lit(self.bias), *terms])

    def column(self) -> Column:
        return fixed(F.lit(1.0) / (F.lit(1.0) + F.exp(-self.logit_column())), PROBABILITY_DIGITS)

    def proba(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for i, w in enumerate(self.weights):
            z = z + x[:, i] * w
        return fixed_np(1.0 / (1.0 + np.exp(-z)))

    def gradient(self, x: np.ndarray) -> np.ndarray:
        """Cross-entropy gradient against the model's own class."""
        p = self.proba(x)
        own = (p > 0.5).astype(float)
        return (p - own)[:, None] * np.asarray(self.weights)[None, :]


@dataclass(frozen=True)
class MlpModel:
    """ReLU layers with a softmax head. ``layers`` holds (weights[in, out], bias[out]) pairs."""

    features: tuple[str, ...]
    layers: tuple[tuple[np.ndarray, np.ndarray], ...]

    @property
    def hidden_count(self) -> int:
        return len(self.layers) - 1

    def width(self, layer: int) -> int:
        """Units of hidden layer ``layer`` (1-based)."""
        return self.layers[layer - 1][0].shape[1]

    def activations(self, x: np.ndarray, top: int | None = None) -> list[np.ndarray]:
        """Every hidden layer's ReLU output, then the logits; only the first ``top`` layers if given."""
        out, h = [], x
        for number in range(1, (top or len(self.layers)) + 1):
            h = self._layer(number, h)
            out.append(h)
        return out

    def _layer(self, number: int, h: np.ndarray) -> np.ndarray:
        w, b = self.layers[number - 1]
        z = h @ w + b
        return np.maximum(z, 0.0) if number < len(self.layers) else z

    def proba_forced(self, hidden: np.ndarray, layer: int, neuron: int, value: float) -> np.ndarray:
        """p(class 1) from the output of ``layer`` with one of its neurons replaced by a constant."""
        h = hidden.copy()
        h[:, neuron] = value
        for number in range(layer + 1, len(self.layers) + 1):
            h = self._layer(number, h)
        return fixed_np(self.softmax(h)[:, 1])

    def forced_probas(self, hidden: np.ndarray, layer: int, cells: list[tuple[int, float]]) -> Iterator[np.ndarray]:
        """``proba_forced`` for each (neuron, value).

        The sums of the layer above are worked out once; forcing a neuron adds its change times its row of weights.
        Units are rows here, so that every step runs along the samples.
        """
        w, b = self.layers[layer]
        outputs = np.ascontiguousarray(hidden.T)
        base = w.T @ outputs + b[:, None]
        for neuron, value in cells:
            z = base + w[neuron][:, None] * (value - outputs[neuron])
            for above, bias in self.layers[layer + 1 :]:
                z = above.T @ np.maximum(z, 0.0, out=z) + bias[:, None]
            e = np.exp(z - z.max(axis=0))
            yield fixed_np(e[1] / e.sum(axis=0))

    @staticmethod
    def softmax(logits: np.ndarray) -> np.ndarray:
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def proba(self, x: np.ndarray) -> np.ndarray:
        logits = np.ascontiguousarray(self.activations(x)[-1].T)  # two long rows instead of many short ones
        e = np.exp(logits - logits.max(axis=0))
        return fixed_np(e[1] / e.sum(axis=0))

    def backward(self, acts: list[np.ndarray], delta: np.ndarray, top: int) -> np.ndarray:
        """Push ``delta`` (gradient at the output of layer ``top``) down to the inputs."""
        for number in range(top, 0, -1):
            if number < len(self.layers):
                delta = delta * (acts[number - 1] > 0)
            delta = delta @ self.layers[number - 1][0].T
        return fixed_np(delta, GRADIENT_DIGITS)

    def gradient(self, x: np.ndarray) -> np.ndarray:
        """Cross-entropy gradient against the model's own class (ties share the target)."""
        acts = self.activations(x)
        probs = self.softmax(acts[-1])
        target = (probs == probs.max(axis=1, keepdims=True)).astype(float)
        target /= target.sum(axis=1, keepdims=True)
        return self.backward(acts, probs - target, len(self.layers))

    def pair_gradient(self, x: np.ndarray, other: np.ndarray, layer: int, mask: np.ndarray) -> np.ndarray:
        """Gradient at ``x`` of cross-entropy between masked hidden vectors of ``x`` and ``other``."""
        acts = self.activations(x, layer)
        mine = acts[layer - 1] * mask
        theirs = self.activations(other, layer)[-1] * mask
        delta = (self.softmax(mine) - theirs) * mask
        return self.backward(acts, delta, layer)


def mlp_from_table(weights: DataFrame, features: list[str], widths: list[int]) -> MlpModel:
    """Model from a ``weights(layer, i, j, w)`` table; i = -1 holds the bias.

    ``widths`` declares the units of every layer, the logits included, and so how many weights come to the driver. A
    table that has more, fewer or others is an error.
    """
    sizes = [len(features), *widths]
    count = sum((a + 1) * b for a, b in zip(sizes, widths))
    layers = [(np.full((a, b), np.nan), np.full(b, np.nan)) for a, b in zip(sizes, widths)]
    rows = weights.select("layer", "i", "j", "w").limit(count + 1).collect()
    try:
        for layer, i, j, value in rows:
            w, b = layers[layer - 1 if layer > 0 else count]
            if i < 0:
                b[j] = value
            else:
                w[i, j] = value
    except IndexError as error:
        raise ValueError(f"the network is not of the widths {widths}") from error
    if len(rows) != count or any(np.isnan(w).any() or np.isnan(b).any() for w, b in layers):
        raise ValueError(f"the network is not of the widths {widths}")
    return MlpModel(tuple(features), tuple(layers))
