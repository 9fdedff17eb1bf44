"""Forward and backward passes on one batch held in a task.

Parameters live in a dict of arrays: ``enc0.W``, ``enc0.b``, ``enc0.gain``,
``enc0.shift`` and the running ``enc0.mean``, ``enc0.var``; ``A`` for the code
layer of ``rsr`` and ``lne``; ``in.mu`` and ``in.sigma`` for a standardised input.
Detectors of the same shapes are trained together (``fit_alike``): every array then
has a first axis for the detector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import asdict
from itertools import groupby

import numpy as np

from textanomaly.detectors.spec import DetectorSpec
from textanomaly.operators.losses import norm_family

BN_EPS = 1e-5
BN_MOMENTUM = 0.1
# distances, and gradients of listed neighbours, held at once
BLOCK_CELLS = 1 << 23
# distances held at once in a small batch, and rows of such a batch for each neighbour
CACHE_CELLS, MATRIX_SHARE = 1 << 17, 64
# shorter lists are gathered
MATRIX_LEAST = 16
# detectors trained together
STACK = 4
STATE = ("mean", "var", "mu", "sigma", "mask")


def seeded(*parts) -> np.random.Generator:
    digest = hashlib.sha256("|".join(str(p) for p in parts).encode()).digest()
    return np.random.default_rng(int.from_bytes(digest[:8], "little"))


def trainable(params: dict) -> list[str]:
    return [name for name in params if name.rsplit(".", 1)[-1] not in STATE]


def layers(spec: DetectorSpec, dim: int, part: str) -> list[tuple[str, int, int, bool]]:
    """(name, inputs, outputs, dropout) of the encoder's or decoder's layers."""
    widths = [dim, *spec.hidden_dims]
    if part == "enc":
        return [(f"enc{i}", a, b, True) for i, (a, b) in enumerate(zip(widths, widths[1:]))]
    widths = widths[::-1]
    first = [spec.latent_dim] if spec.family in ("rsr", "lne") else widths[:1]
    inputs = first + widths[1:]
    return [(f"dec{i}", inputs[i], widths[i + 1], i < len(widths) - 2) for i in range(len(widths) - 1)]


def initial(spec: DetectorSpec, dim: int, rng: np.random.Generator, dtype=np.float32) -> dict:
    if spec.input_dim is not None and spec.input_dim != dim:
        raise ValueError(f"{spec.detector_id} expects {spec.input_dim} features, got {dim}")
    params = {}
    linear = []
    for name, a, b, _ in layers(spec, dim, "enc") + layers(spec, dim, "dec"):
        bound = 1 / np.sqrt(a)
        params[f"{name}.W"] = rng.uniform(-bound, bound, (b, a)).astype(dtype)
        params[f"{name}.b"] = rng.uniform(-bound, bound, b).astype(dtype)
        linear += [f"{name}.W", f"{name}.b"]
        if spec.batchnorm:
            params[f"{name}.gain"] = np.ones(b, dtype)
            params[f"{name}.shift"] = np.zeros(b, dtype)
            params[f"{name}.mean"] = np.zeros(b, dtype)
            params[f"{name}.var"] = np.ones(b, dtype)
    if spec.family in ("rsr", "lne"):
        params["A"] = rng.standard_normal((spec.hidden_dims[-1], spec.latent_dim)).astype(dtype)
    if spec.family == "masked":
        for name in linear[::2]:
            params[f"{name}.mask"] = (rng.random(params[name].shape) < spec.connection_prob).astype(dtype)
    elif spec.prune_ratio > 0:
        sizes = [params[n].size for n in linear]
        keep = np.ones(sum(sizes), dtype)
        keep[rng.choice(len(keep), round(spec.prune_ratio * len(keep)), replace=False)] = 0
        for name, chunk in zip(linear, np.split(keep, np.cumsum(sizes)[:-1])):
            params[f"{name}.mask"] = chunk.reshape(params[name].shape)
    apply_masks(params)
    return params


def starting(spec: DetectorSpec, dim: int, rng: np.random.Generator, start: dict | None = None, dtype=np.float32) -> dict:
    """Copies of the given weights, in their own type, or else seeded ones."""
    if start is None:
        return initial(spec, dim, rng, dtype)
    if start["enc0.W"].shape[1] != dim:
        raise ValueError(f"{spec.detector_id} starts from {start['enc0.W'].shape[1]} features, got {dim}")
    params = {name: np.array(value) for name, value in start.items()}
    apply_masks(params)
    return params


def apply_masks(params: dict) -> None:
    for name in [n for n in params if n.endswith(".mask")]:
        params[name[: -len(".mask")]] *= params[name]


def standardized(params: dict, x: np.ndarray) -> np.ndarray:
    if "in.mu" not in params:
        return x
    return (x - params["in.mu"]) / params["in.sigma"]


def _activate(kind: str, z: np.ndarray) -> np.ndarray:
    if kind == "relu":
        return np.maximum(z, 0)
    return np.tanh(z) if kind == "tanh" else 1 / (1 + np.exp(-z))


def _slope(kind: str, a: np.ndarray) -> np.ndarray:
    if kind == "relu":
        return a > 0
    return 1 - a * a if kind == "tanh" else a * (1 - a)


def _turned(a: np.ndarray) -> np.ndarray:
    return a.swapaxes(-1, -2)


def _row(a: np.ndarray) -> np.ndarray:
    """A vector (of every detector) beside the rows of a batch."""
    return a[..., None, :]


def _noise(rng, like: np.ndarray) -> np.ndarray:
    """Uniform numbers; several detectors have a generator each."""
    if not isinstance(rng, list):
        return rng.random(like.shape, dtype=like.dtype)
    out = np.empty_like(like)
    for own, part in zip(rng, out):
        own.random(out=part, dtype=like.dtype)
    return out


def _run(spec, params, plan, h, rng, stats):
    """Pass ``h`` through layers; with ``stats`` (a dict) in training mode."""
    tape = []
    for name, _, _, drop in plan:
        step = {"name": name, "input": h}
        h = _activate(spec.activation, h @ _turned(params[f"{name}.W"]) + _row(params[f"{name}.b"]))
        step["active"] = h
        if spec.batchnorm:
            if stats is None:
                mean, var = params[f"{name}.mean"], params[f"{name}.var"]
                centred = h - _row(mean)
            else:
                n, mean = h.shape[-2], h.mean(axis=-2)
                centred = h - _row(mean)
                var = np.einsum("...ij,...ij->...j", centred, centred) / n
                stats[name] = (mean, var * n / max(n - 1, 1))
            step["inv"] = 1 / np.sqrt(var + h.dtype.type(BN_EPS))
            step["unit"] = centred * _row(step["inv"])
            h = step["unit"] * _row(params[f"{name}.gain"]) + _row(params[f"{name}.shift"])
        if stats is not None and drop and spec.dropout_rate > 0:
            keep = 1 - spec.dropout_rate
            step["kept"] = (_noise(rng, h) < keep) * h.dtype.type(1 / keep)
            h = h * step["kept"]
        tape.append(step)
    return h, tape


def _back(spec, params, tape, grad, grads):
    for step in reversed(tape):
        name = step["name"]
        if "kept" in step:
            grad = grad * step["kept"]
        if spec.batchnorm:
            unit, n = step["unit"], grad.shape[-2]
            along, total = np.einsum("...ij,...ij->...j", grad, unit), grad.sum(axis=-2)
            grads[f"{name}.gain"], grads[f"{name}.shift"] = along, total
            grad = _row(step["inv"] * params[f"{name}.gain"]) * (grad - _row(total / n) - unit * _row(along / n))
        grad = grad * _slope(spec.activation, step["active"])
        grads[f"{name}.W"] = _turned(grad) @ step["input"]
        grads[f"{name}.b"] = grad.sum(axis=-2)
        if name != "enc0":  # nothing needs the gradient of the input
            grad = grad @ params[f"{name}.W"]
    return grad


def distance_blocks(x: np.ndarray, cells: int):
    """Numbers of some rows and their squared distances to all rows, infinite to themselves; so many cells at a time."""
    n = len(x)
    squares = np.einsum("ij,ij->i", x, x)
    step = max(1, cells // n)
    for first in range(0, n, step):
        rows = np.arange(first, min(first + step, n))
        gap = np.add.outer(squares[rows], squares)
        gap -= (2 * x[rows]) @ x.T
        gap[np.arange(len(rows)), rows] = np.inf
        yield rows, gap


def nearest_others(x: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the ``k`` nearest others of every row (n x k, unordered), ``k`` below n; distances by blocks of rows."""
    chosen = np.empty((len(x), k), np.int64)
    for rows, gap in distance_blocks(x, BLOCK_CELLS):
        chosen[rows] = np.argpartition(gap, k - 1, axis=1)[:, :k]
    return chosen


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest others of every row, ``k`` below n: lists of row numbers, or a matrix with a 1 for each of them.

    The matrix is taken for small batches where a list is long, since products with it are then faster than gathering.
    """
    n = len(x)
    if n * n > BLOCK_CELLS or k < MATRIX_LEAST or n > MATRIX_SHARE * k or not np.isfinite(x).all():
        return nearest_others(x, k)
    marks = np.empty((n, n), x.dtype)
    for rows, gap in distance_blocks(x, CACHE_CELLS):
        chosen = gap <= np.partition(gap, k - 1, axis=1)[:, k - 1 : k]
        tied = np.flatnonzero(np.count_nonzero(chosen, axis=1) != k)
        if len(tied):  # of equal distances as many as are left
            chosen[tied] = False
            chosen[tied[:, None], np.argpartition(gap[tied], k - 1, axis=1)[:, :k]] = True
        marks[rows] = chosen
    return marks


def gather_sum(values: np.ndarray, near: np.ndarray | list | None) -> np.ndarray:
    """Sum of the listed (or marked) rows for every row; without lists every row's sum is over all rows, itself too."""
    if near is None:
        return np.repeat(values.sum(axis=-2, keepdims=True), values.shape[-2], axis=-2)
    if isinstance(near, list):  # of several detectors
        return np.stack([gather_sum(*own) for own in zip(values, near)])
    if near.dtype.kind == "f":
        return near @ values
    total = values[near[:, 0]]
    for column in near.T[1:]:
        total += values[column]
    return total


def scatter_add(values: np.ndarray, near: np.ndarray | list | None) -> np.ndarray:
    """Every row's value added to the rows it lists: the transpose of ``gather_sum``."""
    if near is None:
        return gather_sum(values, None)
    if isinstance(near, list):
        return np.stack([scatter_add(*own) for own in zip(values, near)])
    if near.dtype.kind == "f":
        return (values.T @ near).T
    flat = near.ravel()
    order = np.argsort(flat, kind="stable")
    total = np.zeros_like(values)
    step = max(1, BLOCK_CELLS // values.shape[1])
    for first in range(0, len(order), step):
        part = order[first : first + step]
        to = flat[part]
        starts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        total[to[starts]] += np.add.reduceat(values[part // near.shape[1]], starts, axis=0)
    return total


def _code(spec, params, encoded, x, train):
    """Latent rows, and what their gradient needs."""
    if spec.family == "rsr":
        raw = encoded @ params["A"]
        if not spec.normalize:
            return raw, {}
        norm = np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)
        return raw / norm, {"norm": norm}
    if spec.family == "lne":
        outer = spec.locality == "outer" and train
        near = None
        if spec.n_neighbors < len(x):
            if outer or encoded.ndim == 2:
                near = neighbours(x if outer else encoded, spec.n_neighbors)
                near = near if encoded.ndim == 2 else [near] * len(encoded)
            else:
                near = [neighbours(own, spec.n_neighbors) for own in encoded]
        gathered = gather_sum(encoded, near)
        return gathered @ params["A"], {"near": near, "gathered": gathered}
    return encoded, {}


def _norm(gap, kind):
    """Mean row norm of ``gap`` and its gradient."""
    n = gap.shape[-2]
    family = norm_family(kind)
    if family == "squared":
        return (gap * gap).sum(axis=(-2, -1)) / n, gap * (2 / n)
    if family == "absolute":
        return np.abs(gap).sum(axis=(-2, -1)) / n, np.sign(gap) / n
    size = np.linalg.norm(gap, axis=-1, keepdims=True)
    return size.sum(axis=(-2, -1)) / n, gap / np.where(size == 0, 1, size) / n


def loss_and_grads(spec: DetectorSpec, params: dict, x: np.ndarray, rng, with_grads: bool = True):
    """Loss of one batch, gradients by parameter, and its normalisation statistics.

    With parameters of several detectors ``rng`` is a list, ``lambda1`` and ``lambda2`` are arrays, and so is the loss.
    """
    dim = x.shape[1]
    stats: dict = {}
    encoded, enc_tape = _run(spec, params, layers(spec, dim, "enc"), x, rng, stats)
    latent, held = _code(spec, params, encoded, x, True)
    decoded, dec_tape = _run(spec, params, layers(spec, dim, "dec"), latent, rng, stats)
    plain = spec.family not in ("rsr", "lne")
    if plain and spec.loss == "mean":
        gap = decoded - x
        loss, d_decoded = (gap * gap).mean(), gap * (2 / gap.size)
    else:
        loss, d_decoded = _norm(decoded - x, spec.loss if plain else spec.loss_norm_type)
    grads: dict = {}
    d_encoded, d_latent_extra = 0, 0
    if not plain and spec.robust and not spec.all_alt:
        a = params["A"]
        weight = np.asarray(spec.lambda1 + (spec.local_weight if spec.family == "lne" else 0), a.dtype)
        pull = np.asarray(4 * spec.lambda2 / a.shape[-1] ** 2, a.dtype)
        term, d_gap = _norm(encoded - latent @ _turned(a), spec.norm_type)
        gram = _turned(a) @ a - np.eye(a.shape[-1], dtype=a.dtype)
        second = np.asarray(spec.lambda2, a.dtype).reshape(np.shape(term))
        loss = loss + weight.reshape(np.shape(term)) * term + second * (gram * gram).mean(axis=(-2, -1))
        d_encoded = weight * d_gap
        d_latent_extra = -weight * (d_gap @ a)
        grads["A"] = -weight * (_turned(d_gap) @ latent) + pull * (a @ gram)
    loss = float(loss) if np.ndim(loss) == 0 else loss
    if not with_grads:
        return loss, {}, stats
    d_latent = _back(spec, params, dec_tape, d_decoded, grads) + d_latent_extra
    if plain:
        d_encoded = d_latent
    else:
        if "norm" in held:
            along = (d_latent * latent).sum(axis=1, keepdims=True)
            d_latent = (d_latent - latent * along) / held["norm"]
        source = held.get("gathered", encoded)
        grads["A"] = grads.get("A", 0) + _turned(source) @ d_latent
        d_source = d_latent @ _turned(params["A"])
        d_encoded = d_encoded + (scatter_add(d_source, held["near"]) if "near" in held else d_source)
    _back(spec, params, enc_tape, d_encoded, grads)
    for name in grads:
        if f"{name}.mask" in params:
            grads[name] = grads[name] * params[f"{name}.mask"]
    return loss, grads, stats


def update_running(params: dict, stats: dict) -> None:
    for name, (mean, var) in stats.items():
        for part, value in (("mean", mean), ("var", var)):
            old = params[f"{name}.{part}"]
            params[f"{name}.{part}"] = ((1 - BN_MOMENTUM) * old + BN_MOMENTUM * value).astype(old.dtype)


class Adam:
    """Adam with weight decay added to the gradient; moments are kept in one vector (of every detector)."""

    def __init__(self, learning_rate: float, weight_decay: float = 0.0, betas=(0.9, 0.999), eps: float = 1e-8, lead: tuple = ()):
        self.rate, self.decay, self.betas, self.eps = learning_rate, weight_decay, betas, eps
        self.lead = lead  # number of detectors, if several
        self.steps, self.first, self.second, self.room = 0, None, None, None

    def step(self, params: dict, grads: dict) -> None:
        names = trainable(params)
        lead = self.lead
        flat = np.concatenate([grads[n].reshape(*lead, -1) for n in names], axis=-1)
        if self.decay:
            flat = flat + self.decay * np.concatenate([params[n].reshape(*lead, -1) for n in names], axis=-1).astype(flat.dtype)
        if self.first is None:
            self.first, self.second, self.room = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
        self.steps += 1
        b1, b2 = self.betas
        rate = self.rate / (1 - b1**self.steps)
        root = np.sqrt(1 - b2**self.steps).astype(flat.dtype)
        for one, first, second, room in zip(*[v.reshape(-1, flat.shape[-1]) for v in (flat, self.first, self.second, self.room)]):
            np.subtract(one, first, out=room)
            room *= 1 - b1
            first += room
            np.multiply(one, one, out=room)
            room -= second
            room *= 1 - b2
            second += room
            np.sqrt(second, out=room)
            room /= root
            room += self.eps
            np.divide(first, room, out=room)
            room *= rate
        at, detectors = 0, lead[0] if lead else 1
        for name in names:
            size = params[name].size // detectors
            params[name] -= self.room[..., at : at + size].reshape(params[name].shape).astype(params[name].dtype, copy=False)
            at += size
        apply_masks(params)


def _mean(parts: list[tuple[int, np.ndarray]], rows: int) -> np.ndarray:
    """Row-weighted mean."""
    total = parts[0][0] * parts[0][1]
    for n, value in parts[1:]:
        total += n * value
    total /= rows
    return total


def fit(
    spec: DetectorSpec,
    x: np.ndarray,
    *key,
    batches: np.ndarray | None = None,
    name: str = "",
    dtype=np.float32,
    start: dict | None = None,
) -> tuple[dict, float]:
    """Train on rows held in one task; returns parameters and the last epoch's loss.

    ``batches`` numbers the batch of each row (default: slices in row order). A step takes ``batches_per_step`` of
    them in order and moves the weights by their row-weighted mean gradient; noise is seeded by batch and epoch.
    Training begins at the weights in ``start``, if given, and keeps their type.
    """
    params = starting(spec, np.shape(x)[1], seeded(spec.seed, spec.detector_id, *key), start, dtype)
    params, loss = _trained(spec, params, x, batches, lambda *at: seeded(spec.seed, spec.detector_id, name, *at))
    return params, float(loss)


def _trained(spec: DetectorSpec, params: dict, x: np.ndarray, batches: np.ndarray | None, noise) -> tuple[dict, np.ndarray]:
    """Parameters after all epochs, and the last one's loss; ``noise`` gives the generators of a batch and epoch."""
    x = np.asarray(x, params["enc0.W"].dtype)
    if spec.standardize:
        sigma = x.std(axis=0)
        params["in.mu"], params["in.sigma"] = x.mean(axis=0), np.where(sigma == 0, 1, sigma).astype(x.dtype)
    x = standardized(params, x)
    optimizer = Adam(spec.learning_rate, spec.weight_decay, lead=params["enc0.W"].shape[:-2])
    losses = [float("nan")]
    numbers = np.arange(len(x)) // spec.batch_size if batches is None else np.asarray(batches)
    rows_of = [np.flatnonzero(numbers == number) for number in range(int(numbers.max(initial=-1)) + 1)]
    for epoch in range(spec.epochs):
        losses = []
        for first in range(0, len(rows_of), spec.batches_per_step):
            parts, rows = [], 0
            for number in range(first, min(first + spec.batches_per_step, len(rows_of))):
                if held := len(rows_of[number]):
                    parts.append((held, *loss_and_grads(spec, params, x[rows_of[number]], noise(number, epoch))))
                    rows += held
            if parts:
                optimizer.step(params, {n: _mean([(p[0], p[2][n]) for p in parts], rows) for n in parts[0][2]})
                update_running(
                    params, {n: tuple(_mean([(p[0], p[3][n][i]) for p in parts], rows) for i in (0, 1)) for n in parts[0][3]}
                )
                losses.append(sum(p[0] * p[1] for p in parts) / rows)
    return params, np.mean(losses, axis=0)


def _likeness(spec: DetectorSpec, start: dict | None) -> tuple:
    """What detectors have in common that are trained together."""
    own = ("detector_id", "seed", "lambda1", "lambda2", "lambda3")
    types = None if start is None else [(n, np.asarray(v).dtype.str, np.shape(v)) for n, v in start.items()]
    alone = spec.detector_id if spec.family != "lne" or spec.standardize else None
    return alone, types, {k: v for k, v in asdict(spec).items() if k not in own}


def fit_alike(
    specs: list[DetectorSpec],
    x: np.ndarray,
    *key,
    batches=None,
    name: str = "",
    start: dict[str, dict] | None = None,
) -> Iterator[tuple[DetectorSpec, dict]]:
    """Every detector and its parameters as ``fit`` trains it, in the given order.

    Neighbour detectors that follow each other and differ in their weights of the loss only take the same steps, so
    up to ``STACK`` of them are trained by the same calls. ``batches`` gives the batch of each row for a detector.
    """
    start = start or {}
    for (alone, _, _), run in groupby(specs, lambda s: _likeness(s, start.get(s.detector_id))):
        run = list(run)
        for at in range(0, len(run), STACK):
            some, first = run[at : at + STACK], run[at]
            own = None if batches is None else batches(first)
            if alone is not None or len(some) == 1:
                for spec in some:
                    yield spec, fit(spec, x, *key, batches=own, name=name, start=start.get(spec.detector_id))[0]
                continue
            models = [starting(s, np.shape(x)[1], seeded(s.seed, s.detector_id, *key), start.get(s.detector_id)) for s in some]
            params = {n: np.stack([m[n] for m in models]) for n in models[0]}
            weights = {n: np.array([getattr(s, n) for s in some])[:, None, None] for n in ("lambda1", "lambda2")}
            noise = lambda *place, some=some: [seeded(s.seed, s.detector_id, name, *place) for s in some]
            params, _ = _trained(first.but(**weights), params, x, own, noise)
            for i, spec in enumerate(some):
                yield spec, {n: value[i] for n, value in params.items()}


def scores(spec: DetectorSpec, params: dict, x: np.ndarray, *key) -> np.ndarray:
    """Euclidean reconstruction distance of the rows of one batch."""
    dtype = params["enc0.W"].dtype
    x = standardized(params, np.asarray(x, dtype))
    noisy = spec.score_mode == "train" and spec.family in ("rsr", "lne")
    rng = seeded(spec.seed, spec.detector_id, "score", *key)
    stats = {} if noisy else None
    encoded, _ = _run(spec, params, layers(spec, x.shape[1], "enc"), x, rng, stats)
    latent, _ = _code(spec, params, encoded, x, False)
    decoded, _ = _run(spec, params, layers(spec, x.shape[1], "dec"), latent, rng, stats)
    gap = (decoded - x).astype(np.float64)
    return np.sqrt((gap * gap).sum(axis=1))
